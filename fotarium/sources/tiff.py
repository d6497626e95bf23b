"""Raw photo files (TIFF containers): camera tags, embedded previews, raw layout, lossless-JPEG samples.

Files come as `binaryFile` rows. A file is parsed in one go inside an Arrow batch; what leaves the task are small
rows, never the content. Files that are no TIFF, and tags that lie outside the file, give nulls."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field types (size, format) and tags of TIFF, EXIF and DNG.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "B"), 9: (4, "i"), 10: (8, "ii"), 13: (4, "I")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, ORIENTATION, STRIP_BYTES = 0x0100, 0x0101, 0x0102, 0x0103, 0x0111, 0x0112, 0x0117
SUBFILE, MAKE, MODEL, TILES, SUB_IFDS, JPEG_AT, JPEG_BYTES = 0x00FE, 0x010F, 0x0110, 0x0144, 0x014A, 0x0201, 0x0202
EXIF_IFD, EXPOSURE, F_NUMBER, ISO, TAKEN, APERTURE, FOCAL = 0x8769, 0x829A, 0x829D, 0x8827, 0x9003, 0x9202, 0x920A
SUBSEC_TAKEN, LENS_SPEC, LENS, CFA_SHAPE, CFA, BLACK, WHITE = 0x9291, 0xA432, 0xA434, 0x828D, 0x828E, 0xC61A, 0xC61D
MOST_DIRECTORIES, MOST_ENTRIES, MOST_TEXT = 64, 4096, 4096
COLOURS = "RGB"

EXIF = "make string, model string, lens string, exposure_time double, f_number double, f_number_estimated boolean, iso int, focal_length double, max_aperture double, date_time_original string, subsec string"
PREVIEW = "place int, at bigint, bytes bigint, width int, height int, orientation int"
RAW = "width int, height int, bits int, compression int, tiled boolean, white int, black int, cfa array<int>, strips array<struct<at:bigint,bytes:bigint>>"
CLIP = "highlight_pct double, channel_pct map<string,double>, white_level int"


class Tiff:
    """One file's directories."""

    def __init__(self, data: bytes):
        self.data = data
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("no TIFF file")
        self.order, self.first = order, struct.unpack_from(order + "I", data, 4)[0]

    def directory(self, at: int) -> tuple[dict[int, tuple[int, int, int]], int]:
        """({tag: (type, count, place of its value field)}, place of the next directory)."""
        if at + 2 > len(self.data):
            raise ValueError("directory outside the file")
        (n,) = struct.unpack_from(self.order + "H", self.data, at)
        if not 0 < n <= MOST_ENTRIES or at + 6 + 12 * n > len(self.data):
            raise ValueError("no directory")
        rows = [struct.unpack_from(self.order + "HHI", self.data, at + 2 + 12 * i) for i in range(n)]
        return {tag: (kind, count, at + 10 + 12 * i) for i, (tag, kind, count) in enumerate(rows)}, struct.unpack_from(self.order + "I", self.data, at + 2 + 12 * n)[0]

    def values(self, entries: dict, tag: int, kinds: tuple[int, ...]) -> list | None:
        """The numbers of a tag, rationals as pairs; None if it is missing, of another type, or outside the file."""
        kind, count, at = entries.get(tag, (0, 0, 0))
        if kind not in kinds or not 0 < count <= 1 << 16:
            return None
        size, form = TYPES[kind]
        if size * count > 4:
            (at,) = struct.unpack_from(self.order + "I", self.data, at)
        if at + size * count > len(self.data):
            return None
        flat = struct.unpack_from(self.order + form * count, self.data, at)
        return list(zip(flat[::2], flat[1::2], strict=True)) if len(form) == 2 else list(flat)

    def whole(self, entries: dict, tag: int) -> int | None:
        found = self.values(entries, tag, (3, 4, 13))
        return found[0] if found else None

    def text(self, entries: dict, tag: int) -> str | None:
        found = self.values(entries, tag, (2,)) if entries.get(tag, (0, 0))[1] <= MOST_TEXT else None
        return None if found is None else b"".join(found).rstrip(b"\0").decode("utf-8", "replace").strip()

    def ratio(self, entries: dict, tag: int, i: int = 0) -> float | None:
        found = self.values(entries, tag, (5, 10))
        return found[i][0] / found[i][1] if found and i < len(found) and found[i][1] else None

    def directories(self) -> Iterator[dict]:
        """Directories in the order in which they are linked: next ones and sub-directories, each once."""
        todo, seen = [self.first], set()
        while todo and len(seen) < MOST_DIRECTORIES:
            at = todo.pop(0)
            if not at or at in seen or at >= len(self.data):
                continue
            seen.add(at)
            try:
                entries, following = self.directory(at)
            except ValueError:
                continue
            todo += [following] * (following != 0) + (self.values(entries, SUB_IFDS, (3, 4, 13)) or [])
            yield entries


def exif(data: bytes) -> dict | None:
    """The camera's tags of a file; None for no TIFF. Without an aperture its APEX estimate, to a tenth, is marked."""
    try:
        tiff = Tiff(data)
        top, _ = tiff.directory(tiff.first)
    except ValueError:
        return None
    out = {"make": tiff.text(top, MAKE), "model": tiff.text(top, MODEL), "date_time_original": tiff.text(top, TAKEN), "f_number_estimated": False}
    at = tiff.whole(top, EXIF_IFD)
    try:
        held = tiff.directory(at)[0] if at else {}
    except ValueError:
        held = {}
    number, apex = tiff.ratio(held, F_NUMBER), tiff.ratio(held, APERTURE)
    if not number or number < 0:
        number = None
        if apex is not None:
            number, out["f_number_estimated"] = float(np.floor(2 ** (apex / 2) * 10 + 0.5) / 10), True
    taken = tiff.text(held, TAKEN)
    return out | {
        "lens": tiff.text(held, LENS), "exposure_time": tiff.ratio(held, EXPOSURE), "f_number": number, "iso": tiff.whole(held, ISO), "focal_length": tiff.ratio(held, FOCAL),
        "max_aperture": tiff.ratio(held, LENS_SPEC, 2), "date_time_original": out["date_time_original"] if taken is None else taken, "subsec": tiff.text(held, SUBSEC_TAKEN),
    }


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG stream by its frame header."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 9 < len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def previews(data: bytes) -> list[dict]:
    """The JPEG previews embedded in a file, in the order of its directories."""
    try:
        tiff = Tiff(data)
    except ValueError:
        return []
    out, turn = [], None
    for entries in tiff.directories():
        if turn is None:
            turn = tiff.whole(entries, ORIENTATION) or 1
            turn = turn if 1 <= turn <= 8 else 1
        if not (tiff.whole(entries, SUBFILE) or 0) & 1 or tiff.whole(entries, COMPRESSION) not in (6, 7):
            continue
        at, size = tiff.whole(entries, JPEG_AT), tiff.whole(entries, JPEG_BYTES)
        if at is None or size is None:
            strips, sizes = tiff.values(entries, STRIPS, (3, 4)) or [], tiff.values(entries, STRIP_BYTES, (3, 4)) or []
            if len(strips) != 1 or len(sizes) != 1:
                continue
            at, size = strips[0], sizes[0]
        shape = jpeg_size(data[at : at + size]) if size >= 4 and at + size <= len(data) else None
        if shape:
            out.append({"place": len(out), "at": at, "bytes": size, "width": shape[0], "height": shape[1], "orientation": turn})
    return out


def raw_layout(data: bytes) -> dict | None:
    """Where and how the full-resolution raw image is stored; None if there is none."""
    try:
        tiff = Tiff(data)
    except ValueError:
        return None
    for entries in tiff.directories():
        if (tiff.whole(entries, SUBFILE) or 0) != 0 or WIDTH not in entries:
            continue
        bits = tiff.whole(entries, BITS) or 0
        white = tiff.whole(entries, WHITE)
        black = tiff.whole(entries, BLACK)
        black = tiff.ratio(entries, BLACK) if black is None else black
        strips = zip(tiff.values(entries, STRIPS, (3, 4)) or [], tiff.values(entries, STRIP_BYTES, (3, 4)) or [], strict=False)
        cells = tiff.values(entries, CFA, (1,)) if tiff.values(entries, CFA_SHAPE, (3, 4)) == [2, 2] else None
        return {
            "width": tiff.whole(entries, WIDTH) or 0, "height": tiff.whole(entries, HEIGHT) or 0, "bits": bits, "compression": tiff.whole(entries, COMPRESSION) or 0, "tiled": TILES in entries,
            "white": white if white is not None else (1 << bits) - 1 if 0 < bits <= 16 else 0, "black": int(black or 0), "cfa": cells if cells and len(cells) == 4 else None, "strips": [{"at": a, "bytes": b} for a, b in strips],
        }
    return None


# --- lossless JPEG (ITU-T T.81, process 14) ---------------------------------------------------------


def _codes(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits ahead, length << 8 | symbol of the code they begin with; 0 for none."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if code >= 1 << length:
                raise ValueError("more codes than fit")
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def _differences(data: bytes, tables: list[np.ndarray], n: int) -> np.ndarray:
    """The first n differences of a scan, the tables taken in turn."""
    end = 0
    while (end := data.find(b"\xff", end)) >= 0 and data[end + 1 : end + 2] == b"\0":
        end += 2
    body = (data if end < 0 else data[:end]).replace(b"\xff\0", b"\xff")
    out, lists = np.zeros(n, np.int64), [t.tolist() for t in tables]
    held, width, at, size = 0, 0, 0, len(body)
    for i in range(n):
        while width < 32:
            held, width, at = held << 8 | (body[at] if at < size else 0), width + 8, at + 1
        entry = lists[i % len(lists)][held >> (width - 16) & 0xFFFF]
        if not entry:
            raise ValueError("no such code")
        width -= entry >> 8
        more = entry & 0xFF
        if more == 16:
            out[i] = 32768
        elif more:
            value = held >> (width - more) & ((1 << more) - 1)
            width -= more
            out[i] = value if value >> (more - 1) else value - (1 << more) + 1
        held &= (1 << width) - 1
        if (at - width // 8) > size:
            raise ValueError("scan ends early")
    return out


PREDICTORS: dict[int, Callable[[int, int, int], int]] = {
    2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1,
}


def lossless_samples(data: bytes) -> np.ndarray:
    """The samples (rows, width x components) of a lossless Huffman JPEG; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    tables: dict[int, np.ndarray] = {}
    frame, at = None, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        if mark == 0xFF:
            at += 1
            continue
        body = data[at + 4 : at + 2 + size]
        if mark == 0xC4:
            while len(body) >= 17:
                n = sum(body[1:17])
                tables[body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xC3:
            frame = struct.unpack_from(">BHHB", body)
            if any(body[7 + 3 * c] != 0x11 for c in range(frame[3])):
                raise ValueError("subsampled components")
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("not lossless Huffman")
        elif mark == 0xDD and body[:2] != b"\0\0":
            raise ValueError("restart intervals")
        elif mark == 0xDA:
            if frame is None or body[0] != frame[3]:
                raise ValueError("no frame for the scan")
            precision, height, width, parts = frame
            used = [tables[body[2 + 2 * c] >> 4] for c in range(parts)]
            predictor, shift = body[1 + 2 * parts], body[3 + 2 * parts] & 15
            if not 1 <= predictor <= 7 or shift >= precision:
                raise ValueError("no such predictor")
            diffs = _differences(data[at + 2 + size :], used, height * width * parts).reshape(height, width, parts)
            return (_predicted(diffs, predictor, 1 << (precision - shift - 1)) << shift & 0xFFFF).astype(np.uint16).reshape(height, width * parts)
        at += 2 + size
    raise ValueError("no scan")


def _predicted(diffs: np.ndarray, predictor: int, first: int) -> np.ndarray:
    """Samples from differences: the first row from the left, the first column from above, others by the predictor."""
    out = np.zeros_like(diffs)
    height, width, parts = diffs.shape
    if not height or not width:
        return out
    out[0] = (first + diffs[0].cumsum(axis=0)) & 0xFFFF
    rule = PREDICTORS.get(predictor)
    for y in range(1, height):
        above, row = out[y - 1], diffs[y].copy()
        row[0] += above[0]
        if rule is None:  # from the left: a running sum
            out[y] = row.cumsum(axis=0) & 0xFFFF
        elif predictor in (2, 3):  # from above: no chain along the row
            row[1:] += above[1:] if predictor == 2 else above[:-1]
            out[y] = row & 0xFFFF
        else:
            for p in range(parts):
                line, b, left = row[:, p].tolist(), above[:, p].tolist(), int(row[0, p]) & 0xFFFF
                line[0] = left
                for x in range(1, width):
                    left = (rule(left, b[x], b[x - 1]) + line[x]) & 0xFFFF
                    line[x] = left
                out[y, :, p] = line
    return out


def raw_clipping(data: bytes) -> dict | None:
    """Shares of raw samples at the clip level (white less a 500th of the range, 1 at least), overall and by colour;
    None where the raw isn't striped lossless JPEG or can't be decoded."""
    layout = raw_layout(data)
    if layout is None or not layout["bits"] or layout["white"] <= layout["black"] or layout["compression"] != 7 or layout["tiled"] or not layout["strips"]:
        return None
    level = layout["white"] - max(1, (layout["white"] - layout["black"]) // 500)
    try:
        rows = np.concatenate([lossless_samples(data[s["at"] : s["at"] + s["bytes"]]) for s in layout["strips"]])
    except (ValueError, KeyError, IndexError, struct.error):
        return None
    if not rows.size:
        return None
    hit, parts = rows >= level, {}
    if layout["cfa"]:
        for i, c in enumerate(layout["cfa"]):
            if c < 3:
                cells = hit[i // 2 :: 2, i % 2 :: 2]
                n, k = parts.get(COLOURS[c], (0, 0))
                parts[COLOURS[c]] = (n + cells.size, k + int(cells.sum()))
    return {"highlight_pct": 100 * float(hit.mean()), "channel_pct": {c: 100 * k / n for c, (n, k) in parts.items() if n} if layout["cfa"] else None, "white_level": layout["white"]}


# --- as tables ------------------------------------------------------------------------------------------


def contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of raw files, for the readers below."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _per_file(files: DataFrame, ddl: str, read: Callable[[bytes], list[dict]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("path", T.StringType()), *T.StructType.fromDDL(ddl).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [{"path": path.as_py(), **r} for r in read(content.as_py() or b"")]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def exif_rows(files: DataFrame) -> DataFrame:
    """(path, EXIF) of every file; all null for what is no TIFF."""
    return _per_file(files, EXIF, lambda data: [exif(data) or {}])


def preview_rows(files: DataFrame) -> DataFrame:
    """(path, PREVIEW): one row per embedded JPEG preview; files without one have none."""
    return _per_file(files, PREVIEW, previews)


def raw_rows(files: DataFrame) -> DataFrame:
    """(path, RAW) of every file that has a full-resolution raw image."""
    return _per_file(files, RAW, lambda data: [r] if (r := raw_layout(data)) else [])


def clip_rows(files: DataFrame) -> DataFrame:
    """(path, CLIP) of every file whose raw can be decoded."""
    return _per_file(files, CLIP, lambda data: [{**r, "channel_pct": list(r["channel_pct"].items()) if r["channel_pct"] is not None else None}] if (r := raw_clipping(data)) else [])


def chosen_previews(found: DataFrame, least_edge: int | None = None) -> DataFrame:
    """Of each file's previews the largest, or, given an edge, the smallest whose long edge has it, else the one with
    the longest edge; of equal ones the first."""
    cells = F.struct(*[F.col(c) for c in found.columns if c != "path"])
    edge = F.greatest("width", "height")
    if least_edge is None:
        best = F.max_by(cells, F.struct((F.col("width").cast("bigint") * F.col("height")).alias("a"), (-F.col("place")).alias("p")))
    else:
        fits = edge >= least_edge
        best = F.max_by(cells, F.struct(fits.alias("f"), F.when(fits, -edge).otherwise(edge).alias("e"), (-F.col("place")).alias("p")))
    return found.groupBy("path").agg(best.alias("r")).select("path", "r.*")
