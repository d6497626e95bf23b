"""Append-only logs, incremental work and verification against listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotarium.functions.scalars import base_name


def fold_last(log: DataFrame, keys: list[str], seq: str, removed: Column | None = None) -> DataFrame:
    """The last entry (greatest `seq`) of each key; entries whose last one is `removed` are gone.

    Partial aggregation keeps one row a key and task, so a hot key costs no task more than others.
    Null keys form a key of their own; of entries equal in `seq` the greatest values win."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("_seq"), *rest)).alias("_last"))
    out = last.select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest])
    return out if removed is None else out.filter(~F.coalesce(removed, F.lit(False)))


def fold_first(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first entry of each key; later ones of it are repeats."""
    rest = [c for c in log.columns if c not in keys]
    first = log.groupBy(*keys).agg(F.min(F.struct(F.col(seq).alias("_seq"), *rest)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.`{c}`").alias(c) for c in rest])


def label_fold(log: DataFrame) -> DataFrame:
    """The standing label entry of each (dir, file): the last one, unless it is empty all over."""
    empty = (F.coalesce("label", F.lit("")) == "") & (F.coalesce("stars", F.lit(0)) == 0) & F.col("ev").isNull()
    return fold_last(log, ["dir", "file"], "log_id", empty)


def manifest_fold(manifest: DataFrame) -> DataFrame:
    """The last line of each card file (name without case, size), with where it first appeared. Null names and
    sizes are keys like others; of lines equal in entry_id the greatest values win."""
    rest = ["dir", "name", "src", "file_sha256", "sha256", "dates_set"]
    keyed = manifest.select(F.lower("orig").alias("orig_key"), "size", "entry_id", *[F.col(c) if c in manifest.columns else F.lit(None).cast("string").alias(c) for c in rest])
    last = keyed.groupBy("orig_key", "size").agg(F.max(F.struct("entry_id", *rest)).alias("_last"), F.min("entry_id").alias("first_id"))
    out = last.select("orig_key", "size", "_last.*", "first_id")
    return out.withColumn("current_sha256", F.coalesce(F.nullif(F.trim("file_sha256"), F.lit("")), "sha256"))


def digest_text(text: Column) -> Column:
    """A SHA-256 digest as 64 lower-case hex digits, whatever blanks, case or name it was written with; null if it is
    none."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"[\s\u00a0]+", "")), "^sha-?256[:=]", "")
    return F.when(F.regexp_like(bare, F.lit("^[0-9a-f]{64}$")), bare)


def with_manifest(frames: DataFrame, folded: DataFrame, name: Column) -> DataFrame:
    """Frames with `dates_set`, `card_name` and `digest` of their line in manifest_fold(): the line of the same dir
    whose `orig_key` is the lower-case `name`; of several (other sizes) the last one. Frames without a
    line keep what they have in columns of these names, as a line does where it says nothing."""
    lines = folded.filter(F.col("orig_key").isNotNull() & F.col("dir").isNotNull())
    lines = lines.groupBy(F.col("dir").alias("_d"), F.col("orig_key").alias("_k")).agg(F.max_by(F.struct(F.nullif(F.trim("dates_set"), F.lit("")).alias("d"), card_name(F.col("src"), F.col("orig_key")).alias("c"), digest_text(F.col("current_sha256")).alias("h")), "entry_id").alias("_m"))
    out = frames.withColumn("_key", F.lower(name)).join(lines, (F.col("dir") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    for field, at in (("dates_set", "d"), ("card_name", "c"), ("digest", "h")):
        held = F.col(f"_m.{at}")
        out = out.withColumn(field, F.coalesce(held, F.col(field)) if field in frames.columns else held)
    return out.drop("_key", "_d", "_k", "_m")


def card_name(src: Column, orig: Column) -> Column:
    """The camera's folder and file name on the card: `107CORVN/L1234567.DNG`; without a folder the name alone."""
    parts = F.split(src, "/")
    return F.concat_ws("/", F.when(F.size(parts) > 1, F.nullif(F.element_at(parts, -2), F.lit(""))), F.coalesce(F.nullif(F.element_at(parts, -1), F.lit("")), orig))


def import_labels(entries: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The entries to append, if the frames have every one of them; else an error that names the first stranger
    by name, and nothing is imported."""
    strangers = entries.join(frames.select(*keys).distinct(), keys, "left_anti")
    one = strangers.select(F.min(F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("(null)")) for k in keys]))).first()[0]
    if one is not None:
        raise ValueError(f"no such frame, nothing imported: {one}")
    return entries


def uncharged(answers: DataFrame, used: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """One row (n, tokens...): answers that are neither charged nor used by this run, with their tokens."""
    open_ = answers.filter(~F.coalesce("charged", F.lit(False))).join(used.select(key).distinct(), key, "left_anti")
    return open_.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in tokens])


def path_of(recorded: DataFrame, listing: DataFrame, path: str, places: tuple[str, ...] = ("culled", "keep", "review", "cull")) -> DataFrame:
    """(path, found): where each recorded file is now: at its path, else in the first of the folders beside it that
    has it; null if it is in none. One equi join on the possible paths."""
    parts = F.regexp_extract(F.col(path), r"^(.*/)?([^/]*)$", 1), F.regexp_extract(F.col(path), r"^(.*/)?([^/]*)$", 2)
    ways = F.array(F.col(path), *[F.concat(parts[0], F.lit(f"{p}/"), parts[1]) for p in places])
    asked = recorded.select(path).distinct().select(path, F.posexplode(ways).alias("_rank", "_at"))
    met = asked.join(listing.select(F.col(path).alias("_at"), F.lit(True).alias("_is")).distinct(), "_at", "left")
    return met.groupBy(path).agg(F.min(F.when(F.col("_is"), F.struct("_rank", "_at"))).alias("_f")).select(path, F.col("_f._at").alias("found"))


def label_entry_ok(file: Column, label: Column, stars: Column, ev: Column) -> Column:
    """A base name, a known label or none, stars 0 to 5, an adjustment within 5 either way."""
    named = (file != "") & ~F.regexp_like(file, F.lit(r"[/\\]")) & ~file.isin(".", "..")
    known = F.coalesce(label, F.lit("")).isin("", "keep", "review", "cull")
    rated = F.coalesce(stars, F.lit(0)).between(0, 5)
    return F.coalesce(named, F.lit(False)) & known & rated & (ev.isNull() | (ev.between(-5, 5) & ~F.isnan(ev)))


def effective(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames with the verdict that holds: the hand label of (dir, base name) if there is one, else the
    recorded decision, whether it is by hand, and the stars and exposure (`hand_ev`) set by hand."""
    named = frames.withColumn("_base", base_name(F.col("file")))
    marks = labels.select(F.col("dir").alias("_dir"), F.col("file").alias("_file"), F.nullif("label", F.lit("")).alias("_label"), F.col("stars").alias("_stars"), F.col("ev").alias("_ev"))
    joined = named.join(marks, (F.col("dir") == F.col("_dir")) & (F.col("_base") == F.col("_file")), "left")
    out = joined.withColumns({"verdict": F.coalesce("_label", F.nullif("decision", F.lit(""))), "by_hand": F.col("_label").isNotNull(), "stars": F.coalesce("_stars", F.lit(0)), "hand_ev": F.col("_ev")})
    return out.drop("_base", "_dir", "_file", "_label", "_stars", "_ev")


def pending(listing: DataFrame, done: DataFrame, version: list[str]) -> DataFrame:
    """Rows of the listing whose version key is not done yet; null keys are never done."""
    return listing.join(done.select(*version).distinct(), version, "left_anti")


def resume(listing: DataFrame, results: DataFrame, path: str, version: list[str], kept: Column) -> DataFrame:
    """(path, state) of an incremental run: `carried` (kept, unchanged), `redo` (changed or not kept),
    `new`, `gone` (no longer listed)."""
    old = results.select(path, *[F.col(c).alias(f"_old_{c}") for c in version], F.coalesce(kept, F.lit(False)).alias("_kept"), F.lit(True).alias("_was"))
    both = listing.select(path, *version, F.lit(True).alias("_is")).join(old, path, "full")
    same = F.lit(True)
    for c in version:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    state = F.when(F.col("_is").isNull(), "gone").when(F.col("_was").isNull(), "new").when(same & F.col("_kept"), "carried").otherwise("redo")
    return both.select(path, state.alias("state"))


def repeated_names(frames: DataFrame, keys: list[str], name: Column) -> DataFrame:
    """Names held by several frames of a folder, with how many and the first by file."""
    return frames.groupBy(*keys, name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first_file")).filter(F.col("n") > 1)


def verify(recorded: DataFrame, listing: DataFrame, key: list[str], size: str, digest: str) -> DataFrame:
    """(key..., state): `missing`, `size`, `digest`, `same` for recorded files, `unrecorded` for others."""
    there = listing.select(*key, F.col(size).alias("_size"), F.col(digest).alias("_digest"), F.lit(True).alias("_there"))
    both = recorded.select(*key, size, digest, F.lit(True).alias("_known")).join(there, key, "full")
    state = (
        F.when(F.col("_known").isNull(), "unrecorded").when(F.col("_there").isNull(), "missing")
        .when(~F.col(size).eqNullSafe(F.col("_size")), "size").when(~F.col(digest).eqNullSafe(F.col("_digest")), "digest").otherwise("same")
    )
    return both.select(*key, state.alias("state"))


def content_match(size_a: Column, size_b: Column, digest_a: Column, digest_b: Column) -> Column:
    """Whether two matched files hold the same: `same` or `other` by size and digests (however written), `unverified` where a
    digest is missing and the sizes are equal."""
    a, b = digest_text(digest_a), digest_text(digest_b)
    return F.when(~size_a.eqNullSafe(size_b), "other").when(a.isNull() | b.isNull(), "unverified").when(a == b, "same").otherwise("other")


def near_match(left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str, within_us: int) -> DataFrame:
    """Pairs equal in `keys` whose times differ by at most `within_us`: an equi join on keys and a time
    bucket of that width (the right side in its own and both next buckets), then the exact test,
    so that one hot key is spread over its buckets."""
    bucket = lambda c: F.floor(F.col(c) / within_us)
    a = left.withColumn("_bucket", bucket(left_us))
    b = right.withColumn("_bucket", F.explode(F.array(*[bucket(right_us) + d for d in (-1, 0, 1)])))
    return a.join(b, [*keys, "_bucket"]).filter(F.abs(F.col(left_us) - F.col(right_us)) <= within_us).drop("_bucket")
