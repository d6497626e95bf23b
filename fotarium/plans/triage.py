"""Queries of the reference-shaped operators over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotarium.functions import scalars as S
from fotarium.functions import vectors as V
from fotarium.operators import compare, logs, measure, names, order
from fotarium.plans.triage_sql import SQL  # noqa: F401
from fotarium.session import table
from fotarium.sources import reports


def frames_once(spark: SparkSession, base: str) -> DataFrame:
    """Frames, each delivered row once (deliveries of a frame are alike but for loaded_at)."""
    rows = table(spark, base, "frames")
    rest = [c for c in rows.columns if c not in ("frame_id", "loaded_at")]
    return rows.groupBy("frame_id").agg(F.first(F.struct(*rest)).alias("r")).select("frame_id", "r.*")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def label_fold(spark, base):
    return logs.label_fold(table(spark, base, "label_log")).select("dir", "file", "log_id", "label", "stars", "ev")


def label_entries_ok(spark, base):
    log = table(spark, base, "label_log")
    return log.groupBy(logs.label_entry_ok(F.col("file"), F.col("label"), F.col("stars"), F.col("ev")).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def manifest_fold(spark, base):
    lines = table(spark, base, "manifest").dropDuplicates(["entry_id"])
    return logs.manifest_fold(lines).select("orig_key", "size", "entry_id", "dir", "name", "first_id", "current_sha256")


def effective_verdicts(spark, base):
    labels = logs.label_fold(table(spark, base, "label_log"))
    return logs.effective(frames_once(spark, base), labels).select("frame_id", "verdict", "by_hand", "stars")


def _judged(spark, base):
    marks = logs.label_fold(table(spark, base, "label_log")).select(F.col("dir").alias("d"), F.col("file").alias("f"), F.nullif("label", F.lit("")).alias("label"))
    frames = frames_once(spark, base).filter(F.col("error").isNull())
    return frames.join(marks, (F.col("dir") == F.col("d")) & (S.base_name(F.col("file")) == F.col("f")))


def confusion_matrix(spark, base):
    return compare.confusion(_judged(spark, base), "label", "decision")


def confusion_rates(spark, base):
    return compare.rates(compare.confusion(_judged(spark, base), "label", "decision"))


def run_difference(spark, base):
    frames = frames_once(spark, base)
    first = frames.filter("evaluation is not null").select("frame_id", "decision", F.col("evaluation.sharpness.status").alias("status"), F.col("evaluation.sharpness.score").alias("score"))
    marked = logs.effective(frames, logs.label_fold(table(spark, base, "label_log"))).filter("by_hand")
    second = marked.select("frame_id", F.col("verdict").alias("decision"), F.col("evaluation.exposure.status").alias("status"), F.col("evaluation.exposure.score").alias("score"))
    return compare.run_difference(first, second, ["frame_id"], "decision", "status", "score")


def change_summary(spark, base):
    return compare.change_summary(effective_verdicts(spark, base).join(frames_once(spark, base).select("frame_id", "decision"), "frame_id"), "decision", "verdict")


def repeated_names(spark, base):
    lines = table(spark, base, "manifest").select("entry_id", "dir", "orig", F.col("name").alias("file")).distinct()
    return logs.repeated_names(lines, ["dir"], F.lower("orig"))


def pending_files(spark, base):
    listing = table(spark, base, "card_files").select("file_id", F.lower("orig").alias("orig"), "size").distinct()
    done = table(spark, base, "manifest").select(F.lower("orig").alias("orig"), "size")
    return logs.pending(listing, done, ["orig", "size"])


def _card_files(spark, base):
    """The last delivery of each card file."""
    rows = table(spark, base, "card_files").filter("file_id is not null")
    return rows.groupBy("file_id").agg(F.max(F.struct("loaded_at", "src", "orig", "size", "sha256")).alias("r")).select("file_id", "r.*")


def resume_states(spark, base):
    listing = _card_files(spark, base).filter("src is not null").groupBy("src").agg(F.max(F.struct("file_id", "size")).alias("r")).select("src", "r.size")
    lines = table(spark, base, "manifest").filter("src is not null and entry_id is not null").groupBy("src").agg(F.max(F.struct("entry_id", "size", "sha256")).alias("r"))
    results = lines.select("src", "r.size", logs.digest_text(F.col("r.sha256")).alias("digest"))
    out = logs.resume(listing, results, "src", ["size"], F.col("digest").isNotNull())
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def verify_files(spark, base):
    folded = logs.manifest_fold(table(spark, base, "manifest").dropDuplicates(["entry_id"]))
    recorded = folded.groupBy(F.col("orig_key").alias("orig"), "size").agg(F.max(F.struct("entry_id", "current_sha256")).alias("r")).select("orig", "size", logs.digest_text(F.col("r.current_sha256")).alias("digest"))
    listing = _card_files(spark, base).groupBy(F.lower("orig").alias("orig"), "size").agg(F.max(F.struct("file_id", "sha256")).alias("r")).select("orig", "size", logs.digest_text(F.col("r.sha256")).alias("digest"))
    return logs.verify(recorded.withColumn("bytes", F.col("size")), listing.withColumn("bytes", F.col("size")), ["orig", "size"], "bytes", "digest")


def near_matches(spark, base):
    lines = table(spark, base, "manifest").select("entry_id", "dir", _micros("recorded_at").alias("a_us")).distinct()
    marks = table(spark, base, "label_log").select("log_id", "dir", _micros("logged_at").alias("b_us"))
    return logs.near_match(lines, marks, ["dir"], "a_us", "b_us", 600_000_000).select("entry_id", "log_id")


def capture_order(spark, base):
    frames = frames_once(spark, base).filter("dir is not null and file is not null").select("frame_id", "dir", "file", F.when(F.col("evaluation").isNotNull(), _micros("mod_time")).alias("at_us"))
    return order.capture_order(frames, "dir", "at_us", "file").select("dir", "frame_id", "pos")


def _event_sets(spark, base, group, gap_us, look):
    items = table(spark, base, "events").select(group, "event_id", "value", _micros("ts").alias("at"))
    near = F.abs(F.col("value") - F.col("before_value")) <= look
    step = (F.col("at") - F.col("before_at")).between(0, gap_us) if gap_us else F.lit(True)
    return order.sequences(items, group, ["at", "event_id"], ["at", "value"], near & step)


def sequence_sets(spark, base):
    return _event_sets(spark, base, "user_id", 43_200_000_000, 40).select("user_id", "set_id", "event_id", "set_size")


def sequence_cut(spark, base):
    return _event_sets(spark, base, "event_type", 0, 100).select("event_type", "set_id", "event_id", "set_size")


def event_split(spark, base):
    items = table(spark, base, "events").select("user_id", "event_id", _micros("ts").alias("at_us"))
    return order.events_of(items, "user_id", "at_us", "event_id").select("user_id", "event_id", "event_no")


def broken_clocks(spark, base):
    items = frames_once(spark, base).filter("dir is not null").select("dir", "frame_id", _micros("mod_time").alias("at_us")).filter("at_us is not null")
    return order.broken_clocks(items, "dir", "at_us", "frame_id")


def _ranked_sets(spark, base):
    items = table(spark, base, "events").select("user_id", "event_id", "value")
    sets = sequence_sets(spark, base).join(items, ["user_id", "event_id"])
    return order.best_of(sets, ["user_id", "set_id"], [F.col("value").desc(), F.col("event_id")], 3)


def best_of_sets(spark, base):
    return _ranked_sets(spark, base).select("user_id", "set_id", "event_id", "rank", "best")


def keep_grid(spark, base):
    return compare.keep_grid(_ranked_sets(spark, base))


def chunk_plan(spark, base):
    sets = _ranked_sets(spark, base)
    chunk, chunks = order.chunk_of(F.col("rank") - 1, F.col("set_size"))
    return sets.select("user_id", "set_id", "event_id", chunk.alias("chunk"), order.finalists(chunks, F.lit(3)).alias("finalists"))


def upper_medians(spark, base):
    return order.upper_median(frames_once(spark, base), ["dir"], "size")


def frame_numbers(spark, base):
    frames = order.camera_order(frames_once(spark, base).filter("dir is not null and file is not null").select("dir", "frame_id", "file"), "dir", "file")
    plan = names.numbered(frames, "dir", [*order.CAMERA_KEYS, "file", "frame_id"])
    new = S.expand("{date}-{name}-{n:4}.dng", F.substring("dir", 9, 10), F.lit("set"), S.stem(F.col("file")), F.col("n").cast("int"))
    return plan.select("frame_id", "n", new.alias("new_name"), F.regexp_extract(new, S.pattern_regex("{date}-{name}-{n:4}.dng"), 1).alias("back"))


def name_collisions(spark, base):
    frames = frames_once(spark, base).filter("dir is not null").select("dir", F.concat(F.lit("x"), (F.col("size") % 97).cast("string"), F.lit(".dng")).alias("new_name"))
    return names.collisions(frames, "dir", "new_name")


def ghost_names(spark, base):
    manifest = table(spark, base, "manifest").select("dir", F.lower("orig").alias("orig"), "name")
    present = frames_once(spark, base).filter("moved_to is null").select("dir", F.lower(S.base_name(F.col("file"))).alias("orig"))
    return names.ghosts(manifest, present, ["dir", "orig"], "name")


def stem_conflicts(spark, base):
    frames = frames_once(spark, base).select("dir", S.stem(F.col("file")).alias("stem"))
    files = table(spark, base, "label_log").select("dir", "file").distinct()
    return names.stem_conflicts(frames, files, "dir", "stem", "file").distinct()


def name_problems(spark, base):
    return table(spark, base, "card_files").groupBy(names.name_problem(F.col("orig")).alias("problem")).agg(F.countDistinct("file_id").alias("n"))


def clean_keywords(spark, base):
    frames = frames_once(spark, base).filter("evaluation.keywords is not null")
    return frames.select("frame_id", F.array_join(S.keywords(F.filter("evaluation.keywords", lambda w: w.isNotNull())), "|").alias("keywords"))


def path_parts(spark, base):
    frames = frames_once(spark, base).filter("file is not null")
    f = F.col("file")
    return frames.select("frame_id", S.base_name(f).alias("base"), S.extension(f).alias("ext"), S.stem(f).alias("stem"), S.short_id(f).alias("id"), S.dcf_counter(f).alias("counter"), names.rewrite_paths(f, "/shoots", "/archive").alias("moved"))


def card_folders(spark, base):
    return table(spark, base, "manifest").filter("src is not null").groupBy(S.dcf_folder(F.col("src")).alias("folder")).agg(F.countDistinct("entry_id").alias("n"))


def boxes(spark, base):
    line = table(spark, base, "lineitem")
    a, b = (F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(0.9)), (F.lit(0.05), F.lit(0.02), F.lit(0.5), F.lit(0.5))
    turned = S.box_from_display(F.col("l_linenumber"), *a)
    return line.select("l_orderkey", "l_linenumber", S.box_valid(*a).alias("valid"), S.round_half_away(S.box_iou(a, b), 6).alias("iou"), S.round_half_away(turned["left"], 6).alias("left"), S.round_half_away(turned["bottom"], 6).alias("bottom"))


def luma_statistics(spark, base):
    return measure.luma_statistics(table(spark, base, "lineitem"), ["l_returnflag"], "l_quantity", dark=3, shadow=16, bright=48)


def usage_by_camera(spark, base):
    frames = frames_once(spark, base)
    return frames.groupBy(F.lower(F.trim("exif.make")).alias("make")).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("evaluation").isNotNull()).alias("evaluated"), F.sum("usage.input_tokens").alias("tokens_in"), F.sum("usage.output_tokens").alias("tokens_out"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def result_counts(spark, base):
    frames = frames_once(spark, base)
    state = F.when(F.col("error").isNotNull(), "error").when(F.nullif("decision", F.lit("")).isNull(), "measured").otherwise(F.col("decision"))
    return frames.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def plane_statistics(spark, base):
    plane = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 128).cast("double"))
    rows = table(spark, base, "embeddings").select("vec_id", plane.alias("plane"))
    return rows.select("vec_id", S.round_half_away(V.deviation(F.col("plane")), 4).alias("deviation"), S.round_half_away(V.laplacian_variance(F.col("plane"), 8), 6).alias("laplacian"), *[S.round_half_away(V.box_down(F.col("plane"), 8, 4)[i], 4).alias(f"block{i}") for i in range(4)])


def look_distances(spark, base):
    return measure.look_steps(table(spark, base, "embeddings"))


def clip_shares(spark, base):
    return measure.clip_shares(table(spark, base, "lineitem"), "l_linestatus", "l_quantity", white=50, black=0)


def report_runs(spark, base):
    return reports.runs(table(spark, base, "report_files"))


def report_frames(spark, base):
    return reports.frames(table(spark, base, "report_files"))


QUERIES = {
    f.__name__: f
    for f in (
        label_fold, label_entries_ok, manifest_fold, effective_verdicts, confusion_matrix, confusion_rates, run_difference, change_summary, repeated_names, pending_files,
        resume_states, verify_files, near_matches, capture_order, sequence_sets, sequence_cut, event_split, broken_clocks, best_of_sets, keep_grid, chunk_plan, upper_medians,
        frame_numbers, name_collisions, ghost_names, stem_conflicts, name_problems, clean_keywords, path_parts, card_folders, boxes, luma_statistics, usage_by_camera,
        result_counts, plane_statistics, look_distances, clip_shares, report_runs, report_frames,
    )
}
