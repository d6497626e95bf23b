import random
import struct

import numpy as np
import pytest

from fotarium.sources import tiff

SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 7: "B", 10: "ii", 13: "I"}


def build(order, directories, blobs=(), links=()):
    """A TIFF file: directories as lists of (tag, type, values), values `("dir", i)` or `("blob", i)` being places;
    the next one of directory i is links[i]."""
    mark = {"<": b"II", ">": b"MM"}[order]
    at, places = 8 + sum(map(len, blobs)), []
    for entries in directories:
        places.append(at)
        at += 6 + 12 * len(entries) + sum(len(v) * struct.calcsize("=" + SIZES[t]) + 1 for _, t, v in entries if not isinstance(v, tuple))
    blob_at = [8 + sum(map(len, blobs[:i])) for i in range(len(blobs))]
    out = mark + struct.pack(order + "HI", 42, places[0]) + b"".join(blobs)
    for k, entries in enumerate(directories):
        body, tail, tail_at = b"", b"", places[k] + 6 + 12 * len(entries)
        for tag, kind, values in entries:
            if isinstance(values, tuple):
                values = [(places if values[0] == "dir" else blob_at)[values[1]]]
            if kind == 2:
                data = bytes(values)
            else:
                data = b"".join(struct.pack(order + SIZES[kind], *(v if isinstance(v, tuple) else (v,))) for v in values)
            body += struct.pack(order + "HHI", tag, kind, len(values))
            if len(data) <= 4:
                body += data.ljust(4, b"\0")
            else:
                body += struct.pack(order + "I", tail_at + len(tail))
                tail += data
        following = places[links[k]] if k < len(links) and links[k] is not None else 0
        out += struct.pack(order + "H", len(entries)) + body + struct.pack(order + "I", following) + tail
        out = out.ljust(places[k + 1], b"\xa5") if k + 1 < len(places) else out
    return out


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\x00\xff\xd9"


def lossless(samples, predictor, bits=12, parts=1, shift=0):
    """An encoder: every category has a code of five bits."""
    height, width = samples.shape[0], samples.shape[1] // parts
    s = (samples.astype(int) >> shift).reshape(height, width, parts)
    stream = ""
    for y in range(height):
        for x in range(width):
            for p in range(parts):
                a, b, c = (s[y, x - 1, p] if x else 0), (s[y - 1, x, p] if y else 0), (s[y - 1, x - 1, p] if x and y else 0)
                guess = 1 << (bits - shift - 1) if not x and not y else a if not y else b if not x else tiff.PREDICTORS.get(predictor, lambda a, b, c: a)(a, b, c)
                d = (int(s[y, x, p]) - int(guess) + 32768) % 65536 - 32768
                n = 16 if d == -32768 else abs(d).bit_length()
                stream += f"{n:05b}" + ("" if n in (0, 16) else f"{d if d > 0 else d + (1 << n) - 1:0{n}b}")
    stream += "1" * (-len(stream) % 8)
    body = bytes(int(stream[i : i + 8], 2) for i in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0")
    table = bytes([0, 0, 0, 0, 17, *[0] * 11]) + bytes(range(17))
    part = lambda mark, data: struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data
    frame = struct.pack(">BHHB", bits, height, width, parts) + b"".join(bytes([p, 0x11, 0]) for p in range(parts))
    scan = bytes([parts]) + b"".join(bytes([p, 0]) for p in range(parts)) + bytes([predictor, 0, shift])
    return b"\xff\xd8" + part(0xC4, b"\0" + table) + part(0xC3, frame) + part(0xDA, scan) + body + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_round_trip(predictor):
    rnd = np.random.default_rng(predictor)
    for parts, shift in ((1, 0), (2, 0), (1, 2)):
        samples = (rnd.integers(0, 1 << 12, (7, 10)) >> shift << shift).astype(np.uint16)
        assert (tiff.lossless_samples(lossless(samples, predictor, 12, parts, shift)) == samples).all()


def test_no_lossless_stream():
    good = lossless(np.zeros((4, 4), np.uint16), 1)
    for bad in (b"", b"\xff\xd8", jpeg(4, 4), good[:-8], good.replace(b"\xff\xc3", b"\xff\xc1")):
        with pytest.raises((ValueError, KeyError, IndexError, struct.error)):
            tiff.lossless_samples(bad)


def photo(order):
    samples = np.zeros((6, 8), np.uint16)
    samples[0::2, 0::2] = 4095  # every red cell
    samples[1, 1] = 4090
    strips = [lossless(samples[:4], 1), lossless(samples[4:], 6)]
    top = [
        (tiff.SUBFILE, 4, [1]), (tiff.COMPRESSION, 3, [7]), (tiff.MAKE, 2, b"Corvane \0"), (tiff.MODEL, 2, b"M11\0"), (tiff.STRIPS, 4, ("blob", 0)), (tiff.ORIENTATION, 3, [6]), (tiff.STRIP_BYTES, 4, [len(jpeg(60, 40))]),
        (tiff.SUB_IFDS, 13, ("dir", 2)), (tiff.EXIF_IFD, 4, ("dir", 1)),
    ]
    held = [(tiff.EXPOSURE, 5, [(1, 125)]), (tiff.ISO, 3, [400]), (tiff.TAKEN, 2, b"2025:09:14 16:14:54\0"), (tiff.APERTURE, 5, [(45, 10)]), (tiff.FOCAL, 5, [(35, 1)]), (tiff.SUBSEC_TAKEN, 2, b"42\0"), (tiff.LENS_SPEC, 5, [(35, 1), (35, 1), (2, 1), (0, 0)]), (tiff.LENS, 2, b"Orrin 35 f/2\0")]
    raw = [(tiff.SUBFILE, 4, [0]), (tiff.WIDTH, 4, [8]), (tiff.HEIGHT, 4, [6]), (tiff.BITS, 3, [12]), (tiff.COMPRESSION, 3, [7]), (tiff.STRIPS, 4, [8 + len(jpeg(60, 40)) + len(jpeg(9, 6)), 8 + len(jpeg(60, 40)) + len(jpeg(9, 6)) + len(strips[0])]), (tiff.STRIP_BYTES, 4, [len(s) for s in strips]), (tiff.CFA_SHAPE, 3, [2, 2]), (tiff.CFA, 1, [0, 1, 1, 2])]
    small = [(tiff.SUBFILE, 4, [1]), (tiff.COMPRESSION, 3, [6]), (tiff.JPEG_AT, 4, ("blob", 1)), (tiff.JPEG_BYTES, 4, [len(jpeg(9, 6))])]
    return build(order, [top, held, raw, small], [jpeg(60, 40), jpeg(9, 6), *strips], [3, None, None, 0])


@pytest.mark.parametrize("order", "<>")
def test_tags_previews_and_raw(order):
    data = photo(order)
    assert tiff.exif(data) == {
        "make": "Corvane", "model": "M11", "lens": "Orrin 35 f/2", "exposure_time": 1 / 125, "f_number": 4.8, "f_number_estimated": True, "iso": 400, "focal_length": 35.0, "max_aperture": 2.0,
        "date_time_original": "2025:09:14 16:14:54", "subsec": "42",
    }
    assert [(p["width"], p["height"], p["orientation"]) for p in tiff.previews(data)] == [(60, 40, 6), (9, 6, 6)]
    layout = tiff.raw_layout(data)
    assert (layout["width"], layout["white"], layout["cfa"], len(layout["strips"])) == (8, 4095, [0, 1, 1, 2], 2)
    assert tiff.raw_clipping(data) == {"highlight_pct": 100 * 13 / 48, "channel_pct": {"R": 100.0, "G": 0.0, "B": 100 / 12}, "white_level": 4095}


def test_torn_files_never_crash():
    rnd = random.Random(7)
    data = photo("<")
    for _ in range(400):
        bad = bytearray(data[: rnd.randrange(len(data))] if rnd.random() < 0.5 else data)
        for _ in range(rnd.randrange(6)):
            if bad:
                bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        tiff.exif(bytes(bad)), tiff.previews(bytes(bad)), tiff.raw_layout(bytes(bad)), tiff.raw_clipping(bytes(bad))


def test_as_tables(spark, tmp_path):
    (tmp_path / "a.DNG").write_bytes(photo("<"))
    (tmp_path / "b.dng").write_bytes(b"no photo")
    files = tiff.contents(spark, [str(tmp_path)])
    tags = {r["path"].rsplit("/")[-1]: r for r in tiff.exif_rows(files).collect()}
    assert tags["a.DNG"]["f_number"] == 4.8 and tags["b.dng"]["make"] is None
    found = tiff.preview_rows(files)
    assert [r["width"] for r in tiff.chosen_previews(found).collect()] == [60]
    assert [[r["width"] for r in tiff.chosen_previews(found, e).collect()] for e in (5, 10, 100)] == [[9], [60], [60]]
    assert [len(r["strips"]) for r in tiff.raw_rows(files).collect()] == [2]
    assert [r["channel_pct"]["R"] for r in tiff.clip_rows(files).collect()] == [100.0]
