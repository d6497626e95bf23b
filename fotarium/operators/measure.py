"""Image statistics over decoded planes: histograms, fingerprints, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fotarium.functions import vectors as V
from fotarium.functions.scalars import round_half_away
from fotarium.operators.ranges import with_previous, with_running_sum


def luma_statistics(pixels: DataFrame, keys: list[str], value: str, dark: float = 3, shadow: float = 16, bright: float = 250) -> DataFrame:
    """Per key: n, mean (1 place), p1, p50, p99 (the first value whose count reaches ceil(p * n)), and shares in
    percent at most `dark`, below `shadow`, at least `bright`.

    Values are counted first, and the counts summed up in range partitions, so a key with any number of
    pixels, or of distinct values, meets no single task."""
    counts = pixels.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    share = lambda test: round_half_away(100.0 * F.sum(F.when(test, F.col("c")).otherwise(0)) / F.sum("c"), 4)
    walked = with_running_sum(counts, keys, [value], "c", "u", "luma")
    every = walked.groupBy(*keys).agg(F.sum("c").alias("n"))
    walked = walked.join(every, keys)
    first = lambda p: F.min(F.when(F.col("u") >= F.ceil(F.lit(p) * F.col("n")), F.col(value)))
    v = F.col(value)
    return walked.groupBy(*keys).agg(
        F.sum("c").alias("n"), round_half_away(F.sum(v * F.col("c")) / F.sum("c"), 1).alias("mean"), first(0.01).alias("p1"), first(0.5).alias("p50"), first(0.99).alias("p99"),
        share(v <= dark).alias("dark_pct"), share(v < shadow).alias("shadow_pct"), share(v >= bright).alias("bright_pct"),
    )


def junk_kind(dark_pct, bright_pct, contrast):
    """`black` from 98 % dark, else `white` from 95 % bright, else `uniform` below contrast 3, else null."""
    return F.when(dark_pct >= 98, "black").when(bright_pct >= 95, "white").when(contrast < 3, "uniform")


def clip_shares(samples: DataFrame, channel: str, value: str, white: float, black: float) -> DataFrame:
    """(channel, samples, clipped_pct): samples at or above the clip level, white less a 500th of the range
    (1 at least), per colour channel."""
    level = white - max(1.0, (white - black) / 500)
    return samples.groupBy(F.col(channel).alias("channel")).agg(F.count(value).alias("samples"), round_half_away(100.0 * F.count_if(F.col(value) >= level) / F.count(value), 4).alias("clipped_pct"))


def fine_to_coarse(plane, side: int, noise: float = 0.0):
    """How much fine detail stands over coarse: Laplacian variance less noise, over that of the plane reduced
    four times."""
    found = V.fine_coarse(plane, side)
    return F.greatest(found["fine"] - noise, F.lit(0.0)) / (found["coarse"] + 1e-6)


def junk_detail(kind, dark_pct, bright_pct, contrast):
    """Why a frame is junk, with the number that decided it; null for none."""
    return (
        F.when(kind == "black", F.format_string("black (%.2f%% of pixels near-black)", dark_pct))
        .when(kind == "white", F.format_string("white (%.2f%% of pixels blown)", bright_pct))
        .when(kind.isNotNull(), F.format_string("%s (thumbnail contrast %.2f)", kind, contrast))
    )


def junk_summary(frames: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """(keys..., junk, black, white, uniform): how many frames of each kind; frames of kind null are none."""
    kinds = ("black", "white", "uniform")
    return frames.groupBy(*(keys or [])).agg(F.count(kind).alias("junk"), *[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def landed_cells(cells: DataFrame, keys: list[str], cell: str, k: int) -> DataFrame:
    """(keys..., cell, ratio, rank): where focus landed, the `k` cells of a frame with the most fine detail for
    their coarse detail, among those with structure; ties by cell.

    `cells`: `fine`, `coarse`, `mean` (see vectors.fine_coarse()) and `excluded` of each cell of a frame. The
    noise (taken off the fine detail) is the fine variance at a tenth of the cells neither clipped nor
    flat (of all, if there are none). Structure: the coarse variance is in the frame's top quarter and at
    least a quarter of the median fine one. A frame has a bounded number of cells."""
    floors = noise_and_floor(cells, keys)
    rows = cells.join(floors, keys).filter((F.col("coarse") > 0) & (F.col("coarse") >= F.col("floor")) & ~F.coalesce("excluded", F.lit(False)))
    rows = rows.withColumn("ratio", F.greatest(F.col("fine") - F.col("noise"), F.lit(0.0)) / (F.col("coarse") + 1e-6))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ratio").desc(), cell)))
    return ranked.filter(F.col("rank") <= k).select(*keys, cell, "ratio", "rank")


def look_steps(planes: DataFrame) -> DataFrame:
    """(label, vec_id, before_id, distance): look distance of each 8 x 8 plane to the one before of its label."""
    grey = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 128).cast("double"))
    rows = planes.select("label", "vec_id", V.levelled(grey).alias("look"))
    rows = with_previous(rows, ["label"], ["vec_id"], {"before_id": "vec_id", "before_look": "look"}, "looks").filter(F.col("before_id").isNotNull())
    return rows.select("label", "vec_id", "before_id", round_half_away(V.look_distance(F.col("look"), F.col("before_look")), 9).alias("distance"))


def noise_and_floor(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., noise, floor) of a frame's cells (`fine`, `coarse`, `mean`), see landed_cells()."""
    listed = lambda test, c: F.sort_array(F.collect_list(F.when(test, F.col(c))))
    clear = (F.col("fine") > 0) & F.col("mean").between(16, 239)
    sorted_ = cells.groupBy(*keys).agg(listed(F.lit(True), "fine").alias("_f"), listed(F.lit(True), "coarse").alias("_c"), listed(clear, "fine").alias("_m"))
    m, n, nc = F.when(F.size("_m") > 0, F.col("_m")).otherwise(F.col("_f")), F.size("_f"), F.size("_c")
    at = lambda a, i: F.try_element_at(a, (i + 1).cast("int"))
    quarter = F.greatest(F.lit(1), F.floor(nc / 4))
    return sorted_.select(*keys, at(m, F.floor(F.size(m) / 10)).alias("noise"), F.greatest(at(F.col("_f"), F.floor(n / 2)) / 4, at(F.col("_c"), nc - quarter)).alias("floor"))


def best_face(faces, least: float = 0.0):
    """Of an array of structs (q, area), those with a certainty of at least `least` and half the best one's: the
    largest, of equal ones the surest; null without any."""
    known = F.filter(faces, lambda f: f["q"] >= least)
    best = F.array_max(F.transform(known, lambda f: f["q"]))
    sure = F.filter(known, lambda f: f["q"] >= best / 2)
    return F.array_max(F.transform(sure, lambda f: F.struct(f["area"].alias("area"), f["q"].alias("q"))))


def faces_by_certainty(faces, least: float):
    """Faces of at least `least`, the surest first, of equal ones the larger."""
    known = F.filter(faces, lambda f: f["q"] >= least)
    pairs = F.transform(known, lambda f: F.struct(f["q"].alias("q"), f["area"].alias("area")))
    return F.sort_array(pairs, asc=False)
