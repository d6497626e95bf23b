"""Total order without a single-task sort: range partitions plus small per-partition summaries.

A window over a key puts all rows of that key into one task. The helpers here sort by
(key, order...) into range partitions instead, so a hot key spreads over several, and carry
only one bounded record per partition from each to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fotarium.session import materialize


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def range_table(df: DataFrame, order: list[str], label: str, parts: int | None = None, part_col: str = "_part") -> DataFrame:
    """`df` written in `order`, with the number of the range partition of each row."""
    parts = parts or partitions_for(df.sparkSession)
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(part_col, F.spark_partition_id()), label)


def with_previous(df: DataFrame, keys: list[str], order: list[str], carry: dict[str, str], label: str) -> DataFrame:
    """Add, for each `new: old` in `carry`, the value of column `old` in the row before it.

    "Before" is by `order` within `keys`; the first row of a key gets null. Rows equal in
    `keys + order` are taken in an undefined order, so `order` should end in a unique column.
    A key may fill many partitions: within a partition a window does the work, and the first
    row of a key in a partition takes the last row of that key in the partitions before it.
    Columns that begin with `_fp_` are reserved."""
    if not df.columns:
        return df
    sorted_rows = range_table(df, [*keys, *order], label, part_col="_fp_part")
    inside = Window.partitionBy("_fp_part", *keys).orderBy(*order)
    kept = sorted_rows.withColumn("_fp_n", F.row_number().over(inside))
    for new, old in carry.items():
        kept = kept.withColumn(new, F.lag(old).over(inside))
    # only the first key of a partition can continue from before, from the last row of the one before it: a
    # row a partition, so it is broadcast
    whole = list(dict.fromkeys([*keys, *order, *carry.values()]))
    ends = sorted_rows.groupBy("_fp_part").agg(F.min(F.struct(*keys)).alias("_fp_lo"), F.max_by(F.struct(*whole), F.struct(*keys, *order)).alias("_fp_hi"))
    heads = ends.select(F.col("_fp_part").alias("_fp_p"), "_fp_lo", F.lag("_fp_hi").over(Window.orderBy("_fp_part")).alias("_fp_before"))
    same = F.col("_fp_before").isNotNull()
    for k in keys:
        same = same & F.col(f"_fp_lo.`{k}`").eqNullSafe(F.col(f"_fp_before.`{k}`"))
    on = (F.col("_fp_part") == F.col("_fp_p")) & (F.col("_fp_n") == 1)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_fp_lo.`{k}`"))
    out = kept.join(F.broadcast(heads.filter(same)), on, "left")
    for new, old in carry.items():
        out = out.withColumn(new, F.when(F.col("_fp_before").isNotNull(), F.col(f"_fp_before.`{old}`")).otherwise(F.col(new)))
    return out.drop("_fp_part", "_fp_n", "_fp_p", "_fp_lo", "_fp_before")


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, label: str) -> DataFrame:
    """Add the sum of column `value` from the start of each `keys` group up to the row itself, by `order`.

    Inside a range partition a window sums; each (partition, key) then adds the totals of the key's
    earlier partitions, so no group is gathered in one task. Columns beginning with `_fp_` are reserved."""
    sorted_rows = range_table(df, [*keys, *order], label, part_col="_fp_part")
    # sums of the first key of a partition in those before it: a row a partition, so they are broadcast
    totals = sorted_rows.groupBy("_fp_part", *keys).agg(F.sum(value).alias("_fp_c"))
    ends = totals.groupBy("_fp_part").agg(F.min(F.struct(*keys)).alias("_fp_lo"), F.max(F.struct(*keys, "_fp_c")).alias("_fp_hi"))
    key = F.struct(*[F.col(f"_fp_hi.`{k}`").alias(k) for k in keys])
    ends = ends.withColumns({"_fp_key": key, "_fp_c": F.coalesce("_fp_hi._fp_c", F.lit(0))})
    ends = ends.withColumn("_fp_upto", F.sum("_fp_c").over(Window.partitionBy("_fp_key").orderBy("_fp_part")))
    ahead = Window.orderBy("_fp_part")
    ends = ends.select(F.col("_fp_part").alias("_fp_p"), "_fp_lo", F.lag("_fp_key").over(ahead).alias("_fp_last"), F.lag("_fp_upto").over(ahead).alias("_fp_off"))
    ends = ends.filter(F.col("_fp_last").eqNullSafe(F.col("_fp_lo")))
    inside = Window.partitionBy("_fp_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("_fp_part") == F.col("_fp_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_fp_lo.`{k}`"))
    summed = sorted_rows.withColumn(out, F.sum(value).over(inside)).join(F.broadcast(ends), on, "left")
    return summed.withColumn(out, (F.col(out) + F.coalesce("_fp_off", F.lit(0))).cast(T.LongType())).drop("_fp_part", "_fp_p", "_fp_lo", "_fp_last", "_fp_off")


def with_rank(df: DataFrame, order: list[str], label: str, rank_col: str = "rank0", within: list[str] | None = None) -> DataFrame:
    """Add the 0-based position of each row in the total order `within + order`, counted from the
    start of its `within` group (of the table when none are given)."""
    keys = within or ["_fp_all"]
    rows = df if within else df.withColumn("_fp_all", F.lit(0))
    ranked = with_running_sum(rows.withColumn("_fp_one", F.lit(1)), keys, order, "_fp_one", rank_col, label)
    return ranked.withColumn(rank_col, F.col(rank_col) - 1).drop("_fp_one", "_fp_all")
