"""Plans of new names and what stands in their way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotarium.operators.ranges import with_rank, with_running_sum
from fotarium.session import materialize


def numbered(frames: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add `n`, the number of each frame of its group in the order given, from 1."""
    return with_rank(frames, order, "numbers", "n", [group]).withColumn("n", F.col("n") + 1)


def collisions(plan: DataFrame, group: str, new_name: str) -> DataFrame:
    """(group, name, n): new names that several frames of a group would take, case aside."""
    return plan.groupBy(group, F.lower(new_name).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def ghosts(manifest: DataFrame, present: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Names in the manifest whose frame is gone; they stay taken."""
    return manifest.select(*keys, name).distinct().join(present.select(*keys).distinct(), keys, "left_anti")


def dotted_prefixes(name: Column) -> Column:
    """Every prefix of a lower-case name that ends before a dot: `a.b.c` has `a` and `a.b`."""
    parts = F.split(F.lower(name), r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def stem_conflicts(stems: DataFrame, files: DataFrame, group: str, stem: str, name: str) -> DataFrame:
    """(group, stem, name): files of the group whose name begins with a stem and a dot. A file's possible
    stems are expanded, so it is an equi join and not a comparison of all pairs."""
    heads = files.select(group, F.col(name).alias("_file")).select(group, F.col("_file"), F.explode(dotted_prefixes(F.col("_file"))).alias("stem")).withColumnRenamed("_file", "name")
    return stems.select(group, F.lower(stem).alias("stem")).distinct().join(heads, [group, "stem"])


def name_problem(name: Column) -> Column:
    """Why a file name can't be used: `long` (over 255 bytes), `characters` (/, : or NUL), `hidden`; else null."""
    return F.when(F.octet_length(name) > 255, "long").when(F.regexp_like(name, F.lit("[/:\\x00]")), "characters").when(F.startswith(name, F.lit(".")), "hidden")


def paths_mapped(path: Column, moves: dict[str, str]) -> Column:
    """A path, or each of an array of paths, under its new name: all moves at once, so names can be swapped.
    `moves` is a short plan; mapped() takes a table of any size."""
    table = F.create_map(*[F.lit(x) for pair in moves.items() for x in pair]) if moves else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, path), path)


def mapped(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """`rows` with the paths of a column (text, or an array of texts, in order) under their new names by `moves`
    (old, new): each stored path is looked up once, so frames that swap names swap. A path with
    several new names takes the least."""
    to = moves.filter(F.col("old").isNotNull()).groupBy("old").agg(F.min("new").alias("new"))
    if not rows.schema[column].dataType.simpleString().startswith("array"):
        return rows.join(to.withColumnsRenamed({"old": "_old", "new": "_new"}), F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
    named = rows.select(F.explode(column).alias("old")).distinct().join(to, "old")
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    cells = keyed.select("_row", F.posexplode(column).alias("_pos", "old")).join(named, "old", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("new", "old").alias("v")))).alias("_cells"))
    return keyed.join(cells, "_row", "left").withColumn(column, F.coalesce(F.transform("_cells", lambda c: c["v"]), column)).drop("_row", "_cells")


def numbers_on(files: DataFrame, taken: DataFrame, group: str, order: list[str], name: str, regex: str, skip: Column) -> DataFrame:
    """Add `n`: files (without those that `skip`, whose n is null) are numbered in order within their group, from
    one past the greatest number among the taken names that the pattern made (group 1 of `regex`)."""
    number = F.regexp_extract(name, regex, 1).try_cast("bigint")
    last = taken.groupBy(F.col(group).alias("_g")).agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))
    held = files.withColumn("_skip", F.coalesce(skip, F.lit(False)))
    new = with_rank(held.filter("not _skip"), order, "numbers-on", "n", [group])
    new = new.join(last, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("n", F.col("n") + 1 + F.coalesce("_last", F.lit(0)))
    out = new.drop("_g", "_last").unionByName(held.filter("_skip").withColumn("n", F.lit(None).cast("bigint")))
    return out.drop("_skip")


def split_at(files: DataFrame, group: str, order: list[str], stem: Column, starts: DataFrame) -> DataFrame:
    """Add `event_no` (from 1): the first file of a group opens an event, and so does each whose stem is in `starts`
    (group, stem). Starts that no file has are an error."""
    named = starts.select(F.col(group).alias("_g"), F.lower("stem").alias("_s")).distinct()
    rows = files.withColumn("_stem", stem)
    gone = named.join(rows.select(F.col(group).alias("_g"), F.col("_stem").alias("_s")).distinct(), ["_g", "_s"], "left_anti").select("_s").first()
    if gone is not None:
        raise ValueError(f"no such file to split at: {gone[0]}")
    rows = rows.join(named, (F.col(group) == F.col("_g")) & (F.col("_stem") == F.col("_s")), "left").withColumn("_new", F.col("_s").isNotNull().cast("int"))
    ranked = with_running_sum(rows, [group], order, "_new", "event_no", "split-at")
    first = rows.groupBy(group).agg(F.min_by("_new", F.struct(*order)).alias("_opens")).withColumnRenamed(group, "_g0")
    out = ranked.join(first, F.col(group).eqNullSafe(F.col("_g0")))
    return out.withColumn("event_no", F.col("event_no") + 1 - F.col("_opens")).drop("_stem", "_g", "_s", "_new", "_opens", "_g0")


def order_changes(frames: DataFrame, group: str, before: list[str], after: list[str]) -> DataFrame:
    """(group, moved): how many frames of a group have another place in the order `after` than in `before`."""
    keyed = frames.withColumn("_id", F.monotonically_increasing_id())
    keyed = materialize(keyed.select("_id", group, *dict.fromkeys([*before, *after])), "order-before")
    one, two = (with_rank(keyed, [*by, "_id"], "order", "_rank", [group]).select("_id", group, "_rank") for by in (before, after))
    both = one.join(two.select("_id", F.col("_rank").alias("_then")), "_id")
    return both.groupBy(group).agg(F.count_if(F.col("_rank") != F.col("_then")).alias("moved"))


def earliest(files: DataFrame, group: str, at: str, order: list[str], name: str) -> DataFrame:
    """(group, day, first_file): the calendar day of a group's earliest time, and the first file in order that has it."""
    first = files.filter(F.col(at).isNotNull()).groupBy(group).agg(F.min(F.struct(at, *order, name)).alias("_f"))
    return first.select(group, F.date_format(F.col(f"_f.`{at}`"), "yyyy-MM-dd").alias("day"), F.col(f"_f.`{name}`").alias("first_file"))


def space_needed(files: DataFrame, volume: Column, size: str, margin: float = 0.01, floor: int = 512 * 1024 * 1024) -> DataFrame:
    """(volume, files, bytes, needed): what a plan copies to each volume, and the room it needs: a share more, and a fixed rest."""
    out = files.groupBy(volume.alias("volume")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return out.withColumn("needed", F.col("bytes") + F.floor(F.col("bytes") * margin).cast("bigint") + floor)


def plan_summary(plan: DataFrame, group: str, order: list[str], name: str, skip: str, size: str) -> DataFrame:
    """(group, files, copies, bytes, already_copied, in_manifest, first_name, last_name) of a copy plan whose `skip`
    says why a file isn't copied (null: it is); first and last by order."""
    copied = F.col(skip).isNull()
    place = F.when(copied, F.struct(*order, name))
    out = plan.groupBy(group).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(copied).alias("copies"), F.coalesce(F.sum(F.when(copied, F.col(size))), F.lit(0)).alias("bytes"),
        F.count_if(F.col(skip) == "already copied").alias("already_copied"), F.count_if(F.col(skip) == "in manifest").alias("in_manifest"), F.min(place).alias("_lo"), F.max(place).alias("_hi"),
    )
    return out.withColumns({"first_name": F.col(f"_lo.`{name}`"), "last_name": F.col(f"_hi.`{name}`")}).drop("_lo", "_hi")


def reconciled(recorded: DataFrame, listing: DataFrame, places: tuple[str, ...] = ("keep", "review", "cull", "culled")) -> DataFrame:
    """(file, at, to): where recorded files are that moved without being told: not at `at` any more, and exactly one
    of the home and the folders beside it holds the same size and time. `recorded`: file, at, size,
    mtime_us; `listing`: path, size, mtime_us."""
    head, base = F.regexp_extract("file", r"^(.*/)?([^/]*)$", 1), F.regexp_extract("file", r"^(.*/)?([^/]*)$", 2)
    ways = F.array(F.col("file"), *[F.concat(head, F.lit(f"{p}/"), base) for p in places])
    held = listing.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime_us").alias("_t"))
    lost = recorded.join(held, F.col("at") == F.col("_p"), "left_anti")
    met = lost.select("file", "at", "size", "mtime_us", F.explode(F.array_distinct(ways)).alias("_way")).filter(F.col("_way") != F.col("at"))
    met = met.join(held, (F.col("_way") == F.col("_p")) & F.col("size").eqNullSafe(F.col("_s")) & F.col("mtime_us").eqNullSafe(F.col("_t")))
    return met.groupBy("file", "at").agg(F.count(F.lit(1)).alias("_n"), F.min("_way").alias("to")).filter("_n = 1").drop("_n")


def capture_day(dates_set: Column, exif_time: Column, folder: Column) -> Column:
    """YYYYMMDD for names: of the date that was set, else of the camera (unless all zeros), else of the folder's
    leading date; null without any."""
    digits = lambda text, mark: F.regexp_extract(F.replace(text, F.lit(mark), F.lit("")), r"^(\d{8})", 1)
    own, camera = F.nullif(digits(dates_set, "-"), F.lit("")), F.nullif(digits(exif_time, ":"), F.lit(""))
    from_folder = F.nullif(F.replace(F.regexp_extract(folder, r"(?:^|/)(\d{4}-\d{2}-\d{2})[^/]*$", 1), F.lit("-"), F.lit("")), F.lit(""))
    return F.coalesce(own, F.when(camera != "00000000", camera), from_folder)


def rewrite_paths(path: Column, old: str, new: str) -> Column:
    """A path with its folder `old` (or itself, if it is `old`) put under `new`."""
    rest = F.right(path, F.length(path) - len(old))
    return F.when(path == old, F.lit(new)).when(F.startswith(path, F.lit(old + "/")), F.concat(F.lit(new), rest)).otherwise(path)
