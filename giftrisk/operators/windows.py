"""Time windows per key that stay bounded under hot keys (W4, W9, W10, T3 batch
twins, J10 as-of form).

A plain ``Window.partitionBy(key)`` sends every row of a key to one task; one IP or
donor may hold a third of the data, and cells of (key, time bucket) grow with the data
as well. Here rows are range-partitioned by (key, time): the ranges are cut from the
data, so each holds about as many rows as the others, however the keys are spread. A
key's running total at a row is the total within its range plus the totals of the key's
earlier ranges (one row per key and range it lies in). Then

* a trailing frame [t - width, t] is the difference of two running totals: the one at
  the row, and the one at a probe row placed just before t - width;
* the next event at or after t is the range's, or the first of the later ranges.

Tables are written twice, rows with their numbers and the cut ranges, so a range's
number is fixed. Sums of doubles are differences of running totals, exact to rounding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giftrisk.session import write_stage

MICROS = 1_000_000


def ts_micros(ts: Column) -> Column:
    """Event time as integer microseconds (exact range arithmetic)."""
    return F.unix_micros(ts.cast("timestamp"))


def _cut(df: DataFrame, key: list[str], order: list[str], ranges: int | None) -> DataFrame:
    """``df`` range-partitioned by key and order, with the range's number ``_b``. Rows
    equal in key and order are in one range."""
    by = [F.col(c) for c in (*key, *order)]
    cut = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return write_stage(cut.withColumn("_b", F.spark_partition_id()), "time_ranges")


def _with(cut: DataFrame, totals: DataFrame, key: list[str]) -> DataFrame:
    """Join per-(key, range) totals, null keys included."""
    t = totals.withColumnsRenamed({c: f"_t{c}" for c in (*key, "_b")})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in (*key, "_b")])
    return cut.join(t, on).drop(*[f"_t{c}" for c in (*key, "_b")])


def _numbered(df: DataFrame) -> DataFrame:
    return write_stage(df.withColumn("_id", F.monotonically_increasing_id()), "time_rows")


def _running(cut: DataFrame, key: list[str], values: list[str], within: Window) -> DataFrame:
    """Adds ``_r<value>``: the running total of each value in ``within`` plus the totals
    of the key's earlier ranges."""
    totals = cut.groupBy(*key, "_b").agg(*[F.sum(v).alias(f"_s{v}") for v in values])
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, "_b", *[F.coalesce(F.sum(f"_s{v}").over(before), F.lit(0)).alias(f"_o{v}") for v in values])
    both = _with(cut, totals, key)
    return both.withColumns({f"_r{v}": F.col(f"_o{v}") + F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}).drop(
        *[f"_o{v}" for v in values])


def range_sums(df: DataFrame, key: list[str], t: str, width: int, values: dict[str, Column],
               ranges: int | None = None) -> DataFrame:
    """For each row, the sum of each value (``F.lit(1)`` counts) over the rows of the
    same key with t - width <= t' <= t."""
    rows = _numbered(df.withColumns({f"_v{n}": v for n, v in values.items()}))
    names = [f"_v{n}" for n in values]
    own = rows.select("_id", *key, (2 * F.col(t) + 1).alias("_s"), F.lit(True).alias("_own"), *names)
    # a probe comes before the rows of its time, which belong to the frame
    probe = rows.select("_id", *key, (2 * (F.col(t) - width)).alias("_s"), F.lit(False).alias("_own"),
                        *[F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names])
    cut = _cut(own.unionByName(probe), key, ["_s"], ranges)
    upto = Window.partitionBy(*key, "_b").orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    r = _running(cut, key, names, upto)
    at = lambda n, own_: F.max(F.when(F.col("_own") == own_, F.col(f"_r_v{n}")))
    frames = r.groupBy("_id").agg(*[(at(n, True) - at(n, False)).alias(n) for n in values])
    return rows.drop(*names).join(frames, "_id").drop("_id")


def next_event(df: DataFrame, key: list[str], t: str, event: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Adds ``name``: the time of the key's first row with ``event`` at or after the row."""
    cut = _cut(df.withColumn("_e", F.when(event, F.col(t))), key, [t], ranges)
    firsts = cut.groupBy(*key, "_b").agg(F.min("_e").alias("_f"))
    later = Window.partitionBy(*key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select(*key, "_b", F.min("_f").over(later).alias("_later"))
    onward = Window.partitionBy(*key, "_b").orderBy(t).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return (_with(cut, firsts, key).withColumn(name, F.coalesce(F.min("_e").over(onward), F.col("_later")))
            .drop("_b", "_e", "_later"))


def running_totals(df: DataFrame, key: list[str], t: str, value: str, tiebreak: str, ranges: int | None = None) -> DataFrame:
    """Per key, count and sum of ``value`` over strictly earlier rows
    (order by t, then tiebreak): ``hist_n`` and ``hist_sum``."""
    cut = _cut(df.withColumn("_n", F.when(F.col(value).isNotNull(), 1)).withColumn("_x", F.col(value)), key, [t, tiebreak], ranges)
    earlier = Window.partitionBy(*key, "_b").orderBy(t, tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    r = _running(cut, key, ["_n", "_x"], earlier)
    return r.withColumnsRenamed({"_r_n": "hist_n", "_r_x": "hist_sum"}).drop("_b", "_n", "_x")
