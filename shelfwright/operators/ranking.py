"""Position of a row inside its group, computed without putting a group in
one task.

``row_number() over (partition by g order by o)`` sends a whole group to
one task; one hot group (a third of all rows) would then be one straggler.
Here the keys are sorted globally instead (range partitioning splits a hot
group over many tasks), every row gets its position inside its sorted
partition from ``monotonically_increasing_id``, and a small per
(group, partition) count table turns that into the position inside the
group.  The sorted keys are checkpointed to the shared checkpoint folder,
so the partition numbers read back are the ones that were counted and a
lost executor recomputes nothing inconsistent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOCAL_BITS = 33


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    out = left.join(right, cond, "inner")
    for k in keys:
        out = out.drop(right[k])
    return out


def group_ordinal(df: DataFrame, group_cols: list[str], order_cols: list[str],
                  out: str = "ordinal") -> DataFrame:
    """Add ``out``: 0-based position of the row inside its group.

    ``group_cols + order_cols`` must identify a row.  Work is one global
    sort of the key columns, one checkpoint of them, a count per (group,
    partition) and a join back on the keys.
    """
    keys = group_cols + order_cols
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # the range sort samples its input before sorting it: persist the key
    # columns so that the input is computed once, not once per pass
    key_df = df.select(*keys).persist()
    s = (key_df.orderBy(*keys)
         .withColumn("_mid", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    key_df.unpersist()
    s = s.select(*keys,
                 F.shiftright(F.col("_mid"), _LOCAL_BITS).alias("_pid"),
                 (F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))).alias("_loc"))
    per = s.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                             F.min("_loc").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    ranked = _null_safe_join(s, per, group_cols + ["_pid"])
    ranked = ranked.select(*keys, (F.col("_off") + F.col("_loc") - F.col("_first")).alias(out))
    if set(df.columns) == set(keys):
        return ranked
    return _null_safe_join(df, ranked, keys)
