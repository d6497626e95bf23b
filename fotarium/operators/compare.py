"""Agreement of labels and decisions, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("keep", "review", "cull")


def confusion(judged: DataFrame, label: str, decision: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(label, one column per class, total): how often each label met each decision, with zeros."""
    known = judged.filter(F.col(label).isin(*classes) & F.col(decision).isin(*classes))
    counts = known.groupBy(F.col(label).alias("label")).agg(*[F.count_if(F.col(decision) == c).alias(c) for c in classes], F.count(F.lit(1)).alias("total"))
    spark = judged.sparkSession
    base = spark.createDataFrame([(c,) for c in classes], "label string")
    return base.join(counts, "label", "left").na.fill(0)


def calibration(judged: DataFrame, labels: DataFrame, keys: list[str], evaluated: Column, junk: Column, name: Column) -> DataFrame:
    """One row (n, missing, junk, junk_keeps, junk_keep_names): labelled frames that are decided without an error,
    by an assessment or as junk; labels without such a frame; junk among them, and junk labelled keep,
    with the names in order. `judged`: keys, decision, error; `labels`: keys, label, one row a key. The
    list of names is a report for reading: junk that was labelled keep by hand."""
    frames = judged.withColumns({"_junk": F.coalesce(junk, F.lit(False)), "_ok": F.coalesce(evaluated, F.lit(False)), "_name": name})
    frames = frames.filter((F.col("_ok") | F.col("_junk")) & (F.coalesce("error", F.lit("")) == "") & (F.coalesce("decision", F.lit("")) != ""))
    marked = labels.filter(F.coalesce("label", F.lit("")) != "").select(*keys, "label")
    met = marked.join(frames.select(*keys, "_junk", "_name"), keys, "left")
    kept = F.col("_junk") & (F.col("label") == "keep")
    per = met.groupBy(*keys).agg(F.count("_junk").alias("n"), F.count_if("_junk").alias("j"), F.count_if(kept).alias("k"), F.collect_list(F.when(kept, F.col("_name"))).alias("names"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("n").alias("n"), F.count_if(F.col("n") == 0).alias("missing"), total("j").alias("junk"), total("k").alias("junk_keeps"), F.array_join(F.array_sort(F.flatten(F.collect_list("names"))), ", ").alias("junk_keep_names"))


def set_statistics(members: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """One row (kept, kept_ranked_out, culled, culled_in_best, sets): how hand labels line up with ranks in sets of two
    or more. `members`: keys (of a set), set_size, rank (null: unranked), label. A `keep` of 0 counts as 1."""
    known = members.filter((F.col("set_size") >= 2) & (F.coalesce("label", F.lit("")) != ""))
    inside = F.coalesce(F.col("rank").between(1, max(1, keep)), F.lit(False))
    keeps, culls = F.col("label") == "keep", F.col("label").isin("cull", "review")
    per = known.groupBy(*keys).agg(F.count_if(keeps).alias("kept"), F.count_if(keeps & ~inside).alias("kept_ranked_out"), F.count_if(culls).alias("culled"), F.count_if(culls & inside).alias("culled_in_best"))
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept", "kept_ranked_out", "culled", "culled_in_best")], F.count(F.lit(1)).alias("sets"))


def policy_grid(judged: DataFrame, outranked: Column, clipped: Column, keeps: tuple[int, ...] = (1, 2, 3, 4, 5), actions: tuple[str, ...] = ("review", "cull"), current: tuple | None = None) -> DataFrame:
    """(keep_best, outranked, clipped, label columns..., false_cull, missed_cull, review_share, good, current): the
    agreement of labels and decisions under every combination of policies, in one job.

    `judged`: label, decision (before the policies), rank; `outranked` tells, with the column `keep_best`,
    whether a frame is beyond the cut, `clipped` whether it is clipped; each raises the decision to the
    policy's action. Frames are counted by what the policies look at first, so the policies meet these
    few counts and not the frames. `good`: under 1 % of kept frames are culled."""
    severity = lambda c: F.when(c == "cull", 2).when(c == "review", 1).otherwise(0)
    most = max(keeps)
    seen = judged.filter(F.col("label").isin(*CLASSES) & F.col("decision").isin(*CLASSES))
    seen = seen.groupBy("label", severity(F.col("decision")).alias("_base"), F.least("rank", F.lit(most + 1)).alias("rank"), F.coalesce(clipped, F.lit(False)).alias("_clipped")).agg(F.count(F.lit(1)).alias("_c"))
    policies = F.array(*[F.struct(F.lit(k).alias("keep_best"), F.lit(a).alias("outranked"), F.lit(b).alias("clipped")) for k in keeps for a in actions for b in actions])
    rows = seen.select("*", F.inline(policies))
    raised = F.greatest(F.col("_base"), F.when(F.coalesce(outranked, F.lit(False)), severity(F.col("outranked"))).otherwise(0), F.when(F.col("_clipped"), severity(F.col("clipped"))).otherwise(0))
    rows = rows.withColumn("_d", raised)
    cell = lambda label, d: F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("_d") == d), F.col("_c"))), F.lit(0))
    out = rows.groupBy("keep_best", "outranked", "clipped").agg(*[cell(x, i).alias(f"{x}_{y}") for x in CLASSES for i, y in enumerate(CLASSES)], F.sum("_c").alias("n"))
    row = lambda x: F.col(f"{x}_keep") + F.col(f"{x}_review") + F.col(f"{x}_cull")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"false_cull": share(F.col("keep_cull"), row("keep")), "missed_cull": share(F.col("cull_keep"), row("cull")), "review_share": share(F.col("keep_review") + F.col("review_review") + F.col("cull_review"), F.col("n"))})
    now = F.lit(False) if current is None else (F.col("keep_best") == current[0]) & (F.col("outranked") == current[1]) & (F.col("clipped") == current[2])
    return out.withColumns({"good": F.col("false_cull") < 0.01, "current": now})


def total_in(usage: Column) -> Column:
    """All tokens that went in: plain ones and those written to or read from a cache."""
    return sum((F.coalesce(usage[c], F.lit(0)) for c in ("cache_creation_input_tokens", "cache_read_input_tokens")), F.coalesce(usage["input_tokens"], F.lit(0)))


def edge_summary(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, least, median, most) of a measure such as the long edge; the median is the upper one."""
    from fotarium.operators.order import upper_median

    ends = frames.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return upper_median(frames, keys, value).join(ends, keys).select(*keys, "n", "least", "median", "most")


def paid_work(frames: DataFrame) -> DataFrame:
    """One row (evaluated, moved): what a fresh run would lose."""
    return frames.agg(F.count("evaluation").alias("evaluated"), F.count(F.nullif("moved_to", F.lit(""))).alias("moved"))


def status_counts(frames: DataFrame, junk: Column, label: str, stars: str) -> DataFrame:
    """One row: frames by what became of them (errors first, then assessed, then decided as junk, else open), their
    decisions, hand labels, ratings, labels that differ from the decision, and moved frames."""
    decision = F.nullif("decision", F.lit(""))
    error, done = F.coalesce("error", F.lit("")) != "", F.col("evaluation").isNotNull()
    junked = ~error & ~done & F.coalesce(junk, F.lit(False)) & decision.isNotNull()
    counted = (~error & done) | junked
    mark = F.nullif(label, F.lit(""))
    return frames.agg(
        F.count_if(error).alias("errors"), F.count_if(~error & done).alias("assessed"), F.count_if(junked).alias("junk"), *[F.count_if(counted & (decision == c)).alias(c) for c in CLASSES],
        F.count(mark).alias("labelled"), F.count_if(F.col(stars) > 0).alias("rated"), F.count_if(decision.isNotNull() & (mark != decision)).alias("disagree"), F.count(F.nullif("moved_to", F.lit(""))).alias("moved"),
    )


def run_safety(copies: DataFrame) -> DataFrame:
    """One row (planned, copied, skipped, failed, unverified, safe): whether the source may be cleared: nothing failed
    or is unverified, and every planned file is copied or skipped. `copies`: state, verified."""
    state = F.col("state")
    out = copies.agg(F.count(F.lit(1)).alias("planned"), F.count_if(state == "copied").alias("copied"), F.count_if(state == "skipped").alias("skipped"), F.count_if(state == "failed").alias("failed"), F.count_if((state == "copied") & ~F.coalesce("verified", F.lit(False))).alias("unverified"))
    return out.withColumn("safe", (F.col("failed") == 0) & (F.col("unverified") == 0) & (F.col("copied") + F.col("skipped") == F.col("planned")))


def rates(matrix: DataFrame) -> DataFrame:
    """One row: labelled n, share of keeps decided cull, of culls decided keep, and of reviews; 0 of nothing."""
    cell = lambda row, col: F.coalesce(F.sum(F.when(F.col("label") == row, F.col(col))), F.lit(0))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = F.coalesce(F.sum("total"), F.lit(0))
    return matrix.agg(n.alias("n"), share(cell("keep", "cull"), cell("keep", "total")).alias("false_cull"), share(cell("cull", "keep"), cell("cull", "total")).alias("missed_cull"), share(F.sum("review"), n).alias("review_share"))


def run_difference(a: DataFrame, b: DataFrame, keys: list[str], decision: str, status: str, score: str) -> DataFrame:
    """One row comparing two runs by key (keys that repeat in a run are an error): n in both, same decision, changes across keep and cull, status
    changes, mean absolute score difference, and keys in one run only."""
    side = lambda df, s: df.select(*keys, F.col(decision).alias(f"d{s}"), F.col(status).alias(f"s{s}"), F.col(score).alias(f"v{s}"), F.lit(True).alias(f"in{s}"))
    for df, run in ((a, "first"), (b, "second")):
        twice = df.groupBy(*keys).count().filter("count > 1").select(F.min(F.concat_ws("/", *keys))).first()[0]
        if twice is not None:
            raise ValueError(f"{twice} stands more than once in the {run} run: frames can't be told apart")
    both = side(a, 1).join(side(b, 2), keys, "full")
    met = F.col("in1").isNotNull() & F.col("in2").isNotNull()
    crossed = ((F.col("d1") == "keep") & (F.col("d2") == "cull")) | ((F.col("d1") == "cull") & (F.col("d2") == "keep"))
    return both.agg(
        F.count_if(met).alias("n"), F.count_if(met & F.col("d1").eqNullSafe(F.col("d2"))).alias("same"), F.count_if(met & crossed).alias("crossed"),
        F.count_if(met & ~F.col("s1").eqNullSafe(F.col("s2"))).alias("status_changes"), F.avg(F.when(met, F.abs(F.col("v1") - F.col("v2")))).alias("mean_delta"), F.count_if(~met).alias("missing"),
    )


def change_summary(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """(change, n): `before→after` of the rows that differ."""
    name = lambda c: F.coalesce(F.col(c), F.lit("none"))
    return pairs.filter(~F.col(before).eqNullSafe(F.col(after))).groupBy(F.concat(name(before), F.lit("→"), name(after)).alias("change")).agg(F.count(F.lit(1)).alias("n"))


def keep_grid(ranked: DataFrame, keeps: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    """(keep_best, kept, outranked): for each policy value, members of sets within and beyond it, in one
    job: the policies are expanded against each set's rank counts, not against the members."""
    counts = ranked.groupBy("rank").agg(F.count(F.lit(1)).alias("c"))
    grid = counts.withColumn("keep_best", F.explode(F.array(*[F.lit(k) for k in keeps])))
    return grid.groupBy("keep_best").agg(F.sum(F.when(F.col("rank") <= F.col("keep_best"), F.col("c")).otherwise(0)).alias("kept"), F.sum(F.when(F.col("rank") > F.col("keep_best"), F.col("c")).otherwise(0)).alias("outranked"))
