"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# A side is broadcast only if it has at most this many rows and this many
# bytes; beyond it the join is a shuffle join on a written table, whose hot
# keys the adaptive skew-join rule can split.  Override per session with
# ``shelfwright.broadcast.maxRows``.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20
MAX_ROWS_CONF = "shelfwright.broadcast.maxRows"


def bounded_broadcast(df: DataFrame, max_rows: int | None = None,
                      max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when ``df`` provably is small, else ``df``.

    The side is written first, so the check (footers: rows and file sizes)
    and the join share one computation and nothing stays cached.
    """
    table = written(df, "join-side")
    return F.broadcast(table) if is_small(table, max_rows, max_bytes) else table


def is_small(table: DataFrame, max_rows: int | None = None, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether a written table is within both bounds of a broadcast."""
    if max_rows is None:
        max_rows = int(table.sparkSession.conf.get(MAX_ROWS_CONF, str(BROADCAST_MAX_ROWS)))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= max_bytes and table.limit(max_rows + 1).count() <= max_rows


#: Bits of the bitmap of :func:`maybe_among`: 32 MB when all are in use.
BITMAP_BITS = 1 << 28


def maybe_among(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = BITMAP_BITS) -> DataFrame:
    """Rows whose key may be one of ``wanted``: all that are, and few others.

    The wanted keys' hashes set bits of a bitmap, cut into rows of 4 KB by
    Spark's bitmap functions; it is broadcast, as its size is bounded however
    many keys there are, and each row's bit is looked up without a shuffle.
    Keys with a NULL are none of ``wanted`` in a join and go."""
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marks = (wanted.dropna(subset=keys).select(place.alias("_p"))
             .groupBy(F.bitmap_bucket_number("_p").alias("_bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bitmap")))
    bit = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    return (rows.dropna(subset=keys).withColumn("_p", place).withColumn("_b", F.bitmap_bucket_number("_p"))
            .join(F.broadcast(marks), F.col("_b") == F.col("_bucket")).filter(held).select(*rows.columns))
