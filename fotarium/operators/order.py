"""Capture order, sequences, event splits, ranks and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fotarium.functions.scalars import base_name, dcf_counter, dcf_folder
from fotarium.operators.ranges import range_table, with_previous, with_rank, with_running_sum
from fotarium.session import materialize


def camera_order(frames: DataFrame, group: str, path: str) -> DataFrame:
    """Add `camera_class`, `camera_folder`, `camera_counter`, `camera_base`: sorting by them (and the path)
    puts camera names first, by folder number and counter, and other names after them by name.
    Folder numbers count only in groups where every camera name has one."""
    out = frames.withColumns({"_f": dcf_folder(F.col(path)), "camera_counter": dcf_counter(F.col(path)), "camera_base": F.lower(base_name(F.col(path)))})
    out = out.withColumn("camera_class", F.when(F.col("camera_counter") >= 0, 0).otherwise(1))
    lone = out.filter("camera_class = 0").groupBy(group).agg(F.min("_f").alias("_least"))
    out = out.join(lone, group, "left")
    folder = F.when((F.col("camera_class") == 0) & (F.col("_least") > 0), F.col("_f")).otherwise(0)
    return out.withColumn("camera_folder", folder).withColumn("camera_counter", F.greatest(F.col("camera_counter"), F.lit(0))).drop("_f", "_least")


CAMERA_KEYS = ["camera_class", "camera_folder", "camera_counter", "camera_base"]


def capture_order(frames: DataFrame, group: str, at_us: str, path: str) -> DataFrame:
    """Add `pos`, the 0-based place in capture order: by time where every frame of the group has one,
    then in camera order, then by path."""
    timed = frames.groupBy(group).agg(F.bool_and(F.col(at_us).isNotNull()).alias("_timed"))
    keyed = camera_order(frames.join(timed, group), group, path).withColumn("_at", F.when(F.col("_timed"), F.col(at_us)).otherwise(0))
    return with_rank(keyed, ["_at", *CAMERA_KEYS, path], "capture", "pos", [group]).drop("_timed", "_at", *CAMERA_KEYS)


def sequences(items: DataFrame, group: str, order: list[str], carry: list[str], linked: Column, most: int = 40) -> DataFrame:
    """(group, set_id, order..., set_size): items in sets of successive linked ones.

    `linked` may use the item's columns and, as `before_<c>`, those of the item before it for c in
    `carry`; null counts as not linked, and so does the first item. A run is cut after every
    `most` items, sets of one are dropped, sets are numbered from 1 in order. `order` ends in
    a unique column. No group is gathered in one task: items are sorted into range partitions once,
    windows run inside these, and what continues from one into the next is a row a partition."""
    rows = range_table(items, [group, *order], "sequence", part_col="_part")
    within = Window.partitionBy("_part", group).orderBy(*order)
    at = F.row_number().over(within)
    ends = rows.groupBy("_part").agg(F.min(F.struct(group)).alias("lo"), F.max(F.struct(group, *order, *[c for c in carry if c not in (group, *order)])).alias("hi"))
    # the last row before each partition, where it belongs to the partition's first group: a row a partition
    ahead = Window.orderBy("_part")
    heads = ends.select(F.col("_part").alias("_p"), F.col(f"lo.`{group}`").alias("_first"), F.lag("hi").over(ahead).alias("_last"))
    heads = F.broadcast(heads.filter(F.col("_last").isNotNull() & F.col("_first").eqNullSafe(F.col(f"_last.`{group}`"))))
    known = rows.withColumns({"_n": at, **{f"before_{c}": F.lag(c).over(within) for c in carry}})
    known = known.join(heads, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_first")) & (F.col("_n") == 1), "left")
    carried = F.col("_last").isNotNull()
    known = known.withColumns({f"before_{c}": F.when(carried, F.col(f"_last.`{c}`")).otherwise(F.col(f"before_{c}")) for c in carry})
    joins = ((F.col("_n") > 1) | carried) & F.coalesce(linked, F.lit(False))
    known = known.withColumn("_open", F.when(joins, 0).otherwise(1))
    known = known.withColumns({"_run": F.sum("_open").over(within), "_start": F.max(F.when(F.col("_open") == 1, F.col("_n"))).over(within)})
    keep = list(dict.fromkeys([group, *order]))
    known = materialize(known.select("_part", *keep, "_n", "_run", "_start"), "runs")
    # what continues into a partition: the runs of its first group so far, and the length of the open one
    tail = known.groupBy("_part").agg(F.max_by(F.struct(group, "_run", "_start", "_n"), F.struct(*keep)).alias("t"), F.min(F.struct(group)).alias("f")).orderBy("_part")
    offsets, runs, length, before = [], 0, 0, None
    for r in tail.collect():  # a row a partition
        goes_on = before is not None and before[0] == r["f"][0]
        runs, length = (runs, length) if goes_on else (0, 0)
        if goes_on:
            offsets.append((r["_part"], runs, length))
        t = r["t"]
        if not goes_on or t[0] != before[0]:
            runs, length = 0, 0
        runs, length = runs + t["_run"], t["_n"] - (t["_start"] or 1) + 1 + (length if t["_start"] is None else 0)
        before = (t[0],)
    off = F.broadcast(items.sparkSession.createDataFrame(offsets, "_p int, _runs bigint, _length bigint"))
    firsts = F.broadcast(tail.select(F.col("_part").alias("_p"), F.col(f"f.`{group}`").alias("_first")))
    off = off.join(firsts, "_p")
    rows = known.join(F.broadcast(off), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_first")), "left")
    place = F.col("_n") - F.coalesce("_start", F.lit(1)) + F.when(F.col("_start").isNull(), F.coalesce("_length", F.lit(0))).otherwise(0)
    rows = rows.select(*keep, (F.col("_run") + F.coalesce("_runs", F.lit(0))).alias("_run"), F.floor(place / most).cast("bigint").alias("_cut"))
    size = rows.groupBy(group, "_run", "_cut").agg(F.count(F.lit(1)).alias("set_size")).filter("set_size > 1")
    numbered = with_rank(size, ["_run", "_cut"], "sets", "_id", [group])
    found = rows.join(numbered.withColumnsRenamed({group: "_g", "_run": "_r", "_cut": "_c"}), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("_r")) & (F.col("_cut") == F.col("_c")))
    return found.withColumn("set_id", F.col("_id") + 1).select(group, "set_id", *[c for c in keep if c != group], "set_size")


def events_of(items: DataFrame, group: str, at_us: str, unique: str, gap_us: int = 7_200_000_000) -> DataFrame:
    """Add `event_no` (from 1): a new event after a gap longer than `gap_us` or on another calendar day."""
    rows = with_previous(items, [group], [at_us, unique], {"_before": at_us}, "events")
    day = lambda c: F.floor(F.col(c) / 86_400_000_000)
    new = F.col("_before").isNull() | (F.col(at_us) - F.col("_before") > gap_us) | (day(at_us) != day("_before"))
    rows = rows.withColumn("_new", F.when(new, 1).otherwise(0)).drop("_before")
    return with_running_sum(rows, [group], [at_us, unique], "_new", "event_no", "events").drop("_new")


def broken_clocks(items: DataFrame, group: str, at_us: str, unique: str) -> DataFrame:
    """(group, pairs, same, broken): successive items that share a second; broken from 10 pairs on if at
    least nine in ten do."""
    rows = with_previous(items, [group], [at_us, unique], {"_before": at_us}, "clocks")
    pair = F.col("_before").isNotNull()
    same = pair & (F.floor(F.col(at_us) / 1_000_000) == F.floor(F.col("_before") / 1_000_000))
    out = rows.groupBy(group).agg(F.count_if(pair).alias("pairs"), F.count_if(same).alias("same"))
    return out.withColumn("broken", (F.col("pairs") >= 10) & (F.col("same") * 10 >= F.col("pairs") * 9))


def best_of(sets: DataFrame, keys: list[str], by: list[Column], keep: int) -> DataFrame:
    """Add `rank` (from 1) within each set by the given order, and `best` (rank within `keep`, at least the
    first). Sets are bounded (sequences() cuts them), so a window over a set is too."""
    ranked = sets.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.withColumn("best", F.col("rank") <= max(1, keep))


def score_order(pos: str, evaluation: str = "evaluation") -> list[Column]:
    """The order of a set by scores: assessed frames first, then by sharpness, open eyes, composition and exposure;
    equal ones in capture order."""
    e = lambda path: F.col(f"{evaluation}.{path}")
    return [F.col(evaluation).isNull(), e("sharpness.score").desc(), (~F.coalesce(e("people.eyes") == "open", F.lit(False))), e("composition.score").desc(), e("exposure.score").desc(), F.col(pos)]


def event_orders(events: DataFrame, group: str, path: str) -> DataFrame:
    """Add `event_pos` (from 0): the place of each file in its event (events_of()), back in camera order."""
    keyed = camera_order(events, group, path)
    return with_rank(keyed, [*CAMERA_KEYS, path], "event-order", "event_pos", [group, "event_no"]).drop(*CAMERA_KEYS)


def chunk_of(pos: Column, n: Column, most: int = 8) -> tuple[Column, Column]:
    """(chunk, chunks): the part of a set of n that position `pos` falls in, of ceil(n / most) parts as equal
    as they can be."""
    chunks = F.ceil(n / most).cast("bigint")
    return F.floor(((pos + 1) * chunks - 1) / n).cast("bigint"), chunks


def finalists(chunks: Column, keep: Column, most: int = 8) -> Column:
    """How many of each chunk go on: most // chunks, but enough for `keep`, and one at least."""
    return F.greatest(F.floor(F.lit(most) / chunks).cast("bigint"), F.ceil(keep / chunks).cast("bigint"), F.lit(1))


def rank_calls(n: Column, twice: bool = False, most: int = 8) -> Column:
    """The calls that rank a set of n: its chunks, and one more to merge several or to rank in reverse."""
    chunks = F.ceil(n / most).cast("bigint")
    return chunks + F.when((chunks > 1) | F.lit(twice), 1).otherwise(0)


def to_rank(sets: DataFrame, force: bool = False) -> DataFrame:
    """Sets (of, by) of two or more frames that can be ranked and have no model order yet; all of them by force."""
    need = F.col("of") >= 2
    return sets.filter(need if force else need & ~F.col("by").eqNullSafe("model"))


def final_positions(chunks: DataFrame, keys: list[str], keep: int, most: int = 8) -> DataFrame:
    """(keys..., positions): the frames of the final round, the first few of each chunk, in capture order. `chunks`:
    keys, chunk, chunk_rank (from 1), pos. Sets are bounded."""
    many = chunks.groupBy(*keys).agg(F.countDistinct("chunk").alias("_chunks"))
    kept = chunks.join(many, keys).filter(F.col("chunk_rank") <= finalists(F.col("_chunks"), F.lit(keep), most))
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def reversed_order(order: Column) -> Column:
    return F.reverse(order)


def is_permutation(answer: Column, n: Column) -> Column:
    """Whether an array has each of 1 to n once; false for null."""
    right = (F.size(answer) == n) & (F.array_sort(answer) == F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")))
    return F.coalesce(right, F.lit(False))


def request_batches(requests: DataFrame, order: list[str], size: str, limit: int = 32 * 1024 * 1024, most: int = 10_000, chunk: int = 1_000_000) -> DataFrame:
    """Add `batch_no` (from 1): requests in order, a new batch where the sum of sizes would exceed `limit` or the
    number `most`; each has one at least. `order` ends in a unique column; a null size counts as 0.

    Each cut depends on the one before. Requests get their place and running sum by range partitions; then the
    cuts are found chunk by chunk of `chunk` places: a chunk needs only where the open batch began, and from
    a cut the next one is found by bisection. So a task never holds more than a chunk."""
    rows = with_rank(requests.withColumn("_size", F.coalesce(F.col(size).cast("bigint"), F.lit(0))).withColumn("_all", F.lit(0)), order, "requests", "_pos", ["_all"])
    rows = materialize(with_running_sum(rows, ["_all"], ["_pos"], "_size", "_upto", "requests").withColumn("_chunk", F.floor(F.col("_pos") / chunk).cast("bigint")), "requests", ["_chunk"])
    n = rows.count()

    def cuts(first: int, base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
            out: list[tuple[int, int]] = []
            if held is not None and held.num_rows:
                pos, upto, sizes = (held.column(i).to_numpy() for i in range(3))
                sorted_ = np.argsort(pos)
                pos, upto, sizes = pos[sorted_], upto[sorted_], sizes[sorted_]
                start, before = first, base
                while True:
                    at = min(int(np.searchsorted(upto, before + limit, "right")), max(0, start + most - int(pos[0])))
                    at = max(at, start + 1 - int(pos[0]))
                    if at >= len(pos):
                        break
                    start, before = int(pos[at]), int(upto[at] - sizes[at])
                    out.append((start, before))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["_cut", "_base"])

        return run

    found, state = [], (0, 0)
    for c in range(-(-n // chunk)):
        part = rows.filter(F.col("_chunk") == c).select("_pos", "_upto", "_size").repartition(1)
        found.append(materialize(part.mapInArrow(cuts(*state), "_cut bigint, _base bigint"), "cuts"))
        last = found[-1].agg(F.max(F.struct("_cut", "_base"))).first()[0]
        state = state if last is None else (last["_cut"], last["_base"])
    if not found:
        return requests.withColumn("batch_no", F.lit(1).cast("bigint"))
    marks = reduce(DataFrame.unionByName, found).select("_cut", F.lit(1).alias("_new"))
    rows = rows.join(marks, F.col("_pos") == F.col("_cut"), "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    out = with_running_sum(rows, ["_all"], ["_pos"], "_new", "batch_no", "batches").withColumn("batch_no", F.col("batch_no") + 1)
    return out.select(*requests.columns, "batch_no")


def request_size(system: Column, texts: Column, jpegs: Column) -> Column:
    """The size of a request: a fixed part, the bytes of its texts, and those of its images (an array of byte counts)
    as base64, each rounded down."""
    words = F.aggregate(texts, F.lit(0).cast("bigint"), lambda a, t: a + F.coalesce(F.octet_length(t), F.lit(0)))
    images = F.aggregate(jpegs, F.lit(0).cast("bigint"), lambda a, b: a + F.floor(F.coalesce(b, F.lit(0)) * 4 / 3))
    return F.lit(2048) + F.coalesce(F.octet_length(system), F.lit(0)) + F.coalesce(words, F.lit(0)) + F.coalesce(images, F.lit(0))


def upper_median(groups: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, median): the element n // 2 of each group's sorted values, by ranks, ungathered."""
    rows = groups.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    rows = with_running_sum(rows, keys, [value], "_c", "_upto", "median")
    total = rows.groupBy(*keys).agg(F.sum("_c").alias("n"))
    at = F.floor(F.col("n") / 2)
    return rows.join(total, keys).filter((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(*keys, "n", F.col(value).alias("median"))


def carry_order(members: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., set_id, order, covers): the stored order that each current set takes over, restricted to
    its current members, and whether it covers all that can be ranked.

    `members`: keys, set_id, file, pos, rankable; `stored`: keys, stored_id, order (array of files). A file in
    several stored orders belongs to the first. A set takes the stored order of its first rankable
    member found in one, else of its first member found. Sets are bounded, so their arrays are."""
    placed = stored.select(*keys, "stored_id", F.explode("order").alias("file")).groupBy(*keys, "file").agg(F.min("stored_id").alias("stored_id"))
    met = members.join(placed, [*keys, "file"], "left")
    pick = met.groupBy(*keys, "set_id").agg(
        F.min(F.when(F.col("stored_id").isNotNull(), F.struct(~F.col("rankable"), F.col("pos"), F.col("stored_id")))).alias("first"),
        F.collect_set("file").alias("files"), F.collect_set(F.when(F.col("rankable"), F.col("file"))).alias("needed"),
    )
    found = pick.select(*keys, "set_id", "files", "needed", F.col("first.stored_id").alias("stored_id")).join(stored, [*keys, "stored_id"])
    kept = F.filter("order", lambda f: F.array_contains("files", f))
    return found.select(*keys, "set_id", kept.alias("order"), (F.size(F.array_except("needed", kept)) == 0).alias("covers"))


def merge_orders(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Add `rank` (from 1) of a set ranked in chunks: finalists by `final_rank`, then the others by their rank
    in the chunk (`chunk_rank`), then by chunk. Sets are bounded, so is the window."""
    by = [F.col("final_rank").isNull(), F.col("final_rank"), F.col("chunk_rank"), F.col("chunk")]
    return chunks.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def disputed(first: Column, second: Column, keep: int) -> Column:
    """Whether exactly one of two ranks lies within `keep`; false if either is missing."""
    return F.coalesce((first <= keep) != (second <= keep), F.lit(False))


def set_difference(a: DataFrame, b: DataFrame, keys: list[str], set_id: str, member: str) -> DataFrame:
    """(keys..., members, side): sets (as sorted member lists) that only one of two groupings has. The
    sets must be bounded, as sequences() makes them."""
    lists = lambda df: df.groupBy(*keys, set_id).agg(F.sort_array(F.collect_list(member)).alias("members")).drop(set_id)
    left, right = lists(a), lists(b)
    return left.exceptAll(right).withColumn("side", F.lit("first")).unionByName(right.exceptAll(left).withColumn("side", F.lit("second")))
