"""Queries of plans, summaries and sinks over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotarium.functions import planes, shots
from fotarium.functions import scalars as S
from fotarium.functions import vectors as V
from fotarium.functions.times import normalise_times
from fotarium.operators import compare, logs, measure, names, order
from fotarium.plans.shoots_sql import SQL  # noqa: F401
from fotarium.plans.triage import _micros, _ranked_sets, frames_once, sequence_sets
from fotarium.session import table
from fotarium.sources import sidecars

# What the policies of these queries look for.
def _junk():
    return F.col("evaluation").isNull() & F.col("moved_to").isNotNull()


NAMES = "{n:5}-{orig}"
NUMBERED = r"^(\d+)-.+?\.[A-Za-z0-9]+$"


def _marked(spark, base) -> DataFrame:
    """Frames with their standing verdict and the tags of their shoot."""
    frames = logs.effective(frames_once(spark, base), logs.label_fold(table(spark, base, "label_log")))
    none = F.lit(None).cast("string")
    tags = F.struct(F.col("project"), none.alias("event"), none.alias("location"), F.lit(None).cast("array<string>").alias("keywords"))
    shoots = table(spark, base, "shoots").filter("dir is not null").groupBy(F.col("dir").alias("_d")).agg(F.min("project").alias("project")).select("_d", tags.alias("tags"))
    return frames.join(shoots, F.col("dir") == F.col("_d"), "left").drop("_d")


def _sides(spark, base) -> DataFrame:
    return sidecars.columns(_marked(spark, base), develop=True)


def sidecar_rows(spark, base):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return _sides(spark, base).select("frame_id", "rating", "color", joined("subjects"), joined("hierarchy"), "taken", "exposure")


def sidecar_texts(spark, base):
    return _sides(spark, base).select("frame_id", sidecars.text().alias("xmp"))


def script_rows(spark, base):
    return sidecars.script_rows(_sides(spark, base))


def contact_sheet(spark, base):
    return sidecars.cards(_marked(spark, base))


def move_plan(spark, base):
    return sidecars.move_plan(_marked(spark, base), "sorted", "verdict")


def cull_moves(spark, base):
    return sidecars.move_plan(_marked(spark, base), "culls", "verdict")


def restore_plan(spark, base):
    return sidecars.restore_plan(frames_once(spark, base))


def _folded(spark, base):
    return logs.manifest_fold(table(spark, base, "manifest").dropDuplicates(["entry_id"]))


def manifest_frames(spark, base):
    out = logs.with_manifest(frames_once(spark, base).filter("file is not null"), _folded(spark, base), S.base_name(F.col("file")))
    return out.select("frame_id", "dates_set", "card_name", "digest")


def capture_days(spark, base):
    out = logs.with_manifest(frames_once(spark, base).filter("file is not null"), _folded(spark, base), S.base_name(F.col("file")))
    return out.select("frame_id", names.capture_day(F.col("dates_set"), F.col("exif.date_time_original"), F.col("dir")).alias("day"))


def capture_order_timed(spark, base):
    frames = frames_once(spark, base).filter("dir is not null and file is not null").select("frame_id", "dir", "file", F.col("exif.date_time_original").alias("value"), F.col("exif.subsec").alias("fraction"))
    timed = normalise_times(frames, "value", "_instant", fraction="fraction", wall="at_us")
    return order.capture_order(timed.select("frame_id", "dir", "file", "at_us"), "dir", "at_us", "file").select("dir", "frame_id", "pos")


def calibration_summary(spark, base):
    frames = frames_once(spark, base).withColumn("name", S.base_name(F.col("file")))
    labels = logs.label_fold(table(spark, base, "label_log")).withColumnRenamed("file", "name")
    return compare.calibration(frames, labels, ["dir", "name"], F.col("evaluation").isNotNull() & F.col("moved_to").isNull(), F.col("moved_to").isNotNull() & (F.col("decision") == "cull"), F.concat_ws("/", "dir", "name"))


def _labelled_sets(spark, base):
    kinds = table(spark, base, "events").select("user_id", "event_id", "event_type")
    label = F.when(F.col("event_type") == "purchase", "keep").when(F.col("event_type") == "click", "review").when(F.col("event_type") == "view", "cull")
    return _ranked_sets(spark, base).join(kinds, ["user_id", "event_id"]).withColumn("label", label)


def set_statistics(spark, base):
    return compare.set_statistics(_labelled_sets(spark, base), ["user_id", "set_id"], 2)


def policy_grid(spark, base):
    decision = F.when(F.col("value") > 60, "keep").when(F.col("value") > 20, "review").otherwise("cull")
    judged = _labelled_sets(spark, base).select("label", decision.alias("decision"), "rank", "value")
    return compare.policy_grid(judged, F.col("rank") > F.col("keep_best"), F.col("value") > 95, current=(3, "review", "review"))


def status_counts(spark, base):
    frames = logs.effective(frames_once(spark, base), logs.label_fold(table(spark, base, "label_log")))
    return compare.status_counts(frames.withColumn("mark", F.when(F.col("by_hand"), F.col("verdict"))), _junk(), "mark", "stars")


def paid_work(spark, base):
    return compare.paid_work(frames_once(spark, base))


def run_safety(spark, base):
    cards = table(spark, base, "card_files").filter("file_id is not null").groupBy("file_id").agg(F.max(F.struct("loaded_at", "unverified", "sha256")).alias("r"))
    state = F.when(logs.digest_text(F.col("r.sha256")).isNull(), "failed").when(F.col("file_id") % 5 == 0, "skipped").otherwise("copied")
    return compare.run_safety(cards.select(state.alias("state"), (~F.col("r.unverified")).alias("verified")))


def junk_kinds(spark, base):
    grey = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 128))
    share = lambda test: 100.0 * F.size(F.filter("grey", test)) / F.size("grey")
    rows = table(spark, base, "embeddings").select("label", grey.alias("grey"))
    rows = rows.select("label", measure.junk_kind(share(lambda v: v < 140), share(lambda v: v >= 90), V.deviation(F.col("grey"))).alias("kind"))
    return measure.junk_summary(rows, "kind", ["label"])


def landed_cells(spark, base):
    grey = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 128).cast("double"))
    rows = table(spark, base, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("frame"), "vec_id", grey.alias("grey"))
    rows = rows.select("frame", "vec_id", V.fine_coarse(F.col("grey"), 8).alias("d"), V.deviation(F.col("grey")).alias("coarse"), (F.col("vec_id") % 7 == 0).alias("excluded"))
    cells = rows.select("frame", "vec_id", F.col("d.fine").alias("fine"), "coarse", F.col("d.mean").alias("mean"), "excluded")
    return measure.landed_cells(cells, ["frame"], "vec_id", 3).select("frame", "vec_id", S.round_half_away(F.col("ratio"), 4).alias("ratio"), "rank")


def next_numbers(spark, base):
    files = table(spark, base, "card_files").filter("file_id is not null and src is not null").groupBy("file_id").agg(F.min(F.struct("src", "orig", "size", "batch_no")).alias("r")).select("file_id", "r.*")
    held = table(spark, base, "manifest").select(F.lower("orig").alias("_o"), F.col("size").alias("_s")).filter("_o is not null and _s is not null").distinct().withColumn("_in", F.lit(True))
    files = files.join(held, (F.lower("orig") == F.col("_o")) & (F.col("size") == F.col("_s")), "left").drop("_o", "_s").withColumn("volume", F.split("src", "/")[2])
    taken = table(spark, base, "manifest").filter("src is not null").select(F.split("src", "/")[2].alias("volume"), "name")
    out = names.numbers_on(files, taken, "volume", ["src", "file_id"], "name", NUMBERED, F.col("_in"))
    new = S.expand(NAMES, F.lit(""), F.lit(""), F.regexp_replace("orig", r"\.[^.]*$", ""), F.col("n").cast("int"))
    return out.select("file_id", "n", F.when(F.col("n").isNotNull(), new).alias("new_name"))


def events_at_names(spark, base):
    frames = order.camera_order(frames_once(spark, base).filter("dir is not null and file is not null").select("dir", "frame_id", "file"), "dir", "file")
    known = frames.select("dir", S.stem(F.col("file")).alias("stem")).distinct()
    starts = table(spark, base, "label_log").filter("label = 'cull' and dir is not null and file is not null").select("dir", S.stem(F.col("file")).alias("stem")).distinct().join(known, ["dir", "stem"])
    return names.split_at(frames, "dir", [*order.CAMERA_KEYS, "file", "frame_id"], S.stem(F.col("file")), starts).select("frame_id", "event_no")


def order_changes(spark, base):
    frames = frames_once(spark, base).filter("dir is not null and file is not null and mod_time is not null").select("dir", "file", "frame_id", "mod_time")
    return names.order_changes(frames, "dir", ["file", "frame_id"], ["mod_time", "frame_id"])


def earliest_captures(spark, base):
    frames = order.camera_order(frames_once(spark, base).filter("dir is not null and file is not null").select("dir", "frame_id", "file", "mod_time"), "dir", "file")
    return names.earliest(frames, "dir", "mod_time", order.CAMERA_KEYS, "file")


def space_needed(spark, base):
    files = table(spark, base, "card_files").filter("file_id is not null").select("file_id", "src", "size").distinct()
    return names.space_needed(files, F.split("src", "/")[2], "size")


def copy_summary(spark, base):
    files = table(spark, base, "card_files").filter("file_id is not null").groupBy("file_id").agg(F.min(F.struct("batch_no", "src", "orig", "size", "sha256")).alias("r")).select("file_id", "r.*")
    held = table(spark, base, "manifest").filter("orig is not null and size is not null").select(F.lower("orig").alias("_o"), F.col("size").alias("_s")).distinct().withColumn("_in", F.lit(True))
    files = files.join(held, (F.lower("orig") == F.col("_o")) & (F.col("size") == F.col("_s")), "left")
    skip = F.when(F.col("_in"), "in manifest").when(F.col("sha256").isNull(), "already copied")
    return names.plan_summary(files.withColumn("skip", skip), "batch_no", ["file_id"], "orig", "skip", "size")


def _disk(frames: DataFrame) -> DataFrame:
    """A listing in which frames were moved by hand: each third into `review`, each fourth a copy in `keep` too."""
    head, name = F.regexp_extract("file", r"^(.*/)?([^/]*)$", 1), S.base_name(F.col("file"))
    at = F.array(F.when(F.col("frame_id") % 3 == 0, F.concat(head, F.lit("review/"), name)).otherwise(F.col("file")), F.when(F.col("frame_id") % 4 == 0, F.concat(head, F.lit("keep/"), name)))
    return frames.select("size", "mtime_us", F.explode(at).alias("path")).filter("path is not null")


def moved_files(spark, base):
    frames = frames_once(spark, base).filter("file is not null").select("frame_id", "file", "size", _micros("mod_time").alias("mtime_us"))
    return names.reconciled(frames.withColumn("at", F.col("file")), _disk(frames))


def found_paths(spark, base):
    frames = frames_once(spark, base).filter("file is not null").select("frame_id", "file", "size", _micros("mod_time").alias("mtime_us"))
    return logs.path_of(frames.select(F.col("file").alias("path")), _disk(frames), "path")


def renamed_paths(spark, base):
    frames = frames_once(spark, base).filter("dir is not null and file is not null").select("dir", "frame_id", "file")
    sets = frames.withColumn("block", F.floor(F.col("frame_id") / 8)).groupBy("dir", "block").agg(F.sort_array(F.collect_list("file")).alias("members"))
    # frames of odd and even ids swap their names
    pairs = frames.select(F.col("file").alias("old"), F.col("frame_id").alias("a")).join(frames.select(F.col("file").alias("new"), F.col("frame_id").bitwiseXOR(F.lit(1)).alias("a")), "a").drop("a")
    return names.mapped(sets, "members", pairs).select("dir", "block", F.array_join("members", "|").alias("members"))


def request_batches(spark, base):
    docs = table(spark, base, "documents").filter("doc_id is not null")
    size = order.request_size(F.lit("judge"), F.array("text"), F.array((F.col("n_chars") % 5000).cast("bigint")))
    return order.request_batches(docs.select("doc_id", size.alias("size")), ["doc_id"], "size", limit=100_000, most=25).select("doc_id", "batch_no")


def rank_calls(spark, base):
    sets = sequence_sets(spark, base).groupBy("user_id", "set_id").agg(F.max("set_size").alias("of"), F.when(F.min("event_id") % 3 == 0, "model").otherwise("scores").alias("by"))
    todo = order.to_rank(sets)
    return todo.groupBy("of").agg(F.sum(order.rank_calls(F.col("of"))).alias("calls"), F.sum(order.rank_calls(F.col("of"), True)).alias("calls_twice"))


def final_positions(spark, base):
    sets = _ranked_sets(spark, base)
    chunk, _ = order.chunk_of(F.col("rank") - 1, F.col("set_size"), 3)
    rows = sets.select("user_id", "set_id", F.col("rank").alias("pos"), chunk.alias("chunk")).join(sets.select("user_id", "set_id", F.col("rank").alias("pos"), "event_id"), ["user_id", "set_id", "pos"])
    ranked = order.best_of(rows, ["user_id", "set_id", "chunk"], [F.col("event_id")], 1).withColumnRenamed("rank", "chunk_rank")
    return order.final_positions(ranked, ["user_id", "set_id"], 3, 4).select("user_id", "set_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


def uncharged_answers(spark, base):
    frames = frames_once(spark, base).select("frame_id", (F.col("frame_id") % 5 == 0).alias("charged"), F.col("usage.input_tokens").alias("tokens_in"), F.col("usage.output_tokens").alias("tokens_out"))
    used = frames_once(spark, base).filter("error is not null").select("frame_id")
    return logs.uncharged(frames, used, "frame_id", ["tokens_in", "tokens_out"])


def clamped_scores(spark, base):
    e = "evaluation.{}.score"
    frames = frames_once(spark, base).filter("evaluation is not null")
    tall = lambda c: shots.score_clamped(F.col(e.format(c)) * 1.5 - 2).alias(c)
    return frames.select("frame_id", tall("sharpness"), tall("exposure"), tall("composition"), shots.ev_clamped(F.col("evaluation.exposure.ev_adjust") * 3).alias("ev"))


def frame_predicates(spark, base):
    frames = frames_once(spark, base)
    status, done = F.col("evaluation.sharpness.status"), F.col("evaluation").isNotNull()
    return frames.select(
        "frame_id", shots.rankable(done, F.col("decision")).alias("rankable"), shots.doubtful(status).alias("doubtful"), shots.escalates(status, F.col("evaluation.people.eyes"), ("soft", "eyes_closed")).alias("escalates"),
        shots.kept_result(F.col("error"), done, F.lit(False), F.coalesce(_junk(), F.lit(False))).alias("kept"), F.array_join(shots.other_statuses(status, F.col("evaluation.exposure.status")), "|").alias("others"),
    )


def pixel_boxes(spark, base):
    line = table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") * 30).alias("x"), F.floor(F.col("l_discount") * 9000).alias("y"), F.col("l_tax").cast("double").alias("t"), F.col("l_discount").cast("double").alias("d"))
    whole, frac = shots.to_pixels((F.col("d"), F.col("t"), F.lit(0.75), F.lit(0.9)), F.lit(1600), F.lit(1067)), shots.to_fractions((F.col("x"), F.col("y"), F.lit(1500), F.lit(1000)), F.lit(1600), F.lit(1067))
    box = shots.subject_square(F.col("x"), F.col("y"), F.col("l_linenumber") * 300, F.lit(1600), F.lit(1067))
    return line.select("l_orderkey", "l_linenumber", whole["left"].alias("p_left"), whole["right"].alias("p_right"), whole["bottom"].alias("p_bottom"), frac["left"].alias("f_left"), frac["top"].alias("f_top"), box["left"].alias("s_left"), box["top"].alias("s_top"), box["right"].alias("s_right"), box["bottom"].alias("s_bottom"))


def camera_texts(spark, base):
    e = lambda c: F.col(f"exif.{c}")
    return frames_once(spark, base).select("frame_id", shots.camera_text(e("make"), e("model")).alias("camera"), shots.exposure_text(e("exposure_time"), e("iso"), e("lens")).alias("exposure"))


def tag_rows(spark, base):
    shoots = table(spark, base, "shoots").select("shoot_id", "project", "time_zone")
    none = F.lit(None).cast("string")
    stored = F.struct(F.col("project"), F.lit("").alias("event"), F.col("time_zone").alias("location"), F.array(F.lit("a"), F.lit("b")).alias("keywords"))
    given = F.struct(F.when(F.col("shoot_id") % 3 == 0, "new").alias("project"), F.when(F.col("shoot_id") % 4 == 0, "fair").alias("event"), none.alias("location"), F.when(F.col("shoot_id") % 5 == 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("keywords"))
    rows = shoots.select("shoot_id", shots.merged_tags(stored, given).alias("tags"), shots.tag_problem(F.col("project")).alias("problem"))
    return rows.select("shoot_id", F.array_join(shots.tag_words(F.col("tags")), "|").alias("words"), F.array_join(shots.tag_paths(F.col("tags")), "|").alias("paths"), "problem")


def answers(spark, base):
    sets = _ranked_sets(spark, base).groupBy("user_id", "set_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "rank"))).alias("r"))
    return sets.select("user_id", "set_id", order.is_permutation(F.transform("r", lambda x: x["rank"].cast("int")), F.size("r")).alias("whole"), F.array_join(order.reversed_order(F.transform("r", lambda x: x["rank"].cast("string"))), ",").alias("backwards"))


def look_codes(spark, base):
    frames = frames_once(spark, base).filter("file is not null")
    code = planes.encode_look(F.encode(F.col("file"), "UTF-8"))
    cells = planes.decode_look(code)
    return frames.select("frame_id", code.alias("code"), F.size(cells).alias("n"), V.total(cells).alias("sum"))


def fixed_dates(spark, base):
    frames = frames_once(spark, base).filter("exif.date_time_original is not null")
    return frames.select("frame_id", shots.redated(F.col("exif.date_time_original"), "2025-09-14", "2025-10-01").alias("redated"), shots.quoted_shell(F.col("file")).alias("word"), shots.quoted_script(F.col("file")).alias("quoted"))


def _timed(spark, base) -> DataFrame:
    frames = frames_once(spark, base).filter("dir is not null and file is not null")
    frames = frames.select("frame_id", "dir", "file", "evaluation", F.col("exif.date_time_original").alias("value"), F.col("exif.subsec").alias("fraction"))
    return normalise_times(frames, "value", "_instant", fraction="fraction", wall="at").filter("at is not null").select("frame_id", "dir", "file", "at", "evaluation")


def frame_sets(spark, base):
    items = _timed(spark, base).select("dir", "at", "frame_id")
    return order.sequences(items, "dir", ["at", "frame_id"], ["at"], (F.col("at") - F.col("before_at")).between(0, 60_000_000)).select("dir", "set_id", "frame_id", "set_size")


def score_ranks(spark, base):
    sets = order.sequences(_timed(spark, base).select("dir", "at", "frame_id"), "dir", ["at", "frame_id"], ["at"], (F.col("at") - F.col("before_at")).between(0, 60_000_000))
    frames = frames_once(spark, base).select("frame_id", "evaluation")
    ranked = order.best_of(sets.join(frames, "frame_id").withColumn("pos", F.struct("at", "frame_id")), ["dir", "set_id"], order.score_order("pos"), 2)
    return ranked.select("dir", "set_id", "frame_id", "rank", "best")


def event_orders(spark, base):
    events = order.events_of(_timed(spark, base).drop("evaluation"), "dir", "at", "frame_id")
    return order.event_orders(events, "dir", "file").select("frame_id", "event_no", "event_pos")


def edge_summary(spark, base):
    return compare.edge_summary(table(spark, base, "part"), ["p_brand"], "p_size")


def name_keys(spark, base):
    frames = frames_once(spark, base).filter("file is not null and dir is not null")
    box = S.box_text(F.lit(0.1), F.lit(0.25), F.lit(0.5), F.lit(0.75))
    return frames.select("frame_id", S.list_key(F.array("file", "dir")).alias("key"), S.cache_name(S.base_name(F.col("file")), F.lit("subject"), F.col("size"), _micros("mod_time") * 1000, box).alias("cache"), logs.card_name(F.col("file"), F.lit("x")).alias("card"))


def matched_contents(spark, base):
    cards = table(spark, base, "card_files").filter("file_id is not null").groupBy("file_id").agg(F.min(F.struct("orig", "size", "sha256")).alias("r")).select("file_id", F.lower("r.orig").alias("orig_key"), F.col("r.size").alias("_s"), F.col("r.sha256").alias("_h"))
    met = cards.join(_folded(spark, base).select("orig_key", "size", "entry_id", "current_sha256"), "orig_key")
    return met.select("file_id", "entry_id", logs.content_match(F.col("size"), F.col("_s"), F.col("current_sha256"), F.col("_h")).alias("content"))


QUERIES = {
    f.__name__: f
    for f in (
        sidecar_rows, sidecar_texts, script_rows, contact_sheet, move_plan, cull_moves, restore_plan, manifest_frames, capture_days, capture_order_timed, calibration_summary, set_statistics,
        policy_grid, status_counts, paid_work, run_safety, junk_kinds, landed_cells, next_numbers, events_at_names, order_changes, earliest_captures, space_needed, copy_summary, moved_files, found_paths,
        renamed_paths, request_batches, rank_calls, final_positions, uncharged_answers, clamped_scores, frame_predicates, pixel_boxes, camera_texts, tag_rows, answers, look_codes, fixed_dates,
        frame_sets, score_ranks, event_orders, edge_summary, name_keys, matched_contents,
    )
}
