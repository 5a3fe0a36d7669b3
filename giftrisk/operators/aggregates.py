"""Aggregation operators.

Every operator aggregates with map-side partial aggregation first; windows are
only applied to the small grouped results (one row per category / label),
never to raw rows without a partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from giftrisk.operators.quantiles import exact_quantiles


def ordered_dimension(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """Fixed-order dimension (ord, name) for reindexing."""
    return spark.createDataFrame(list(enumerate(values)), f"ord int, {name} string")


def stack(df: DataFrame, columns: list[str], key: str = "dimension", value: str = "value",
          extra: list[str] | None = None) -> DataFrame:
    """Unpivot ``columns`` into (key, value) rows, one scan, values as strings."""
    extra = extra or []
    return df.select(*extra, F.inline(F.array(*[
        F.struct(F.lit(c).alias(key), F.col(c).cast("string").alias(value)) for c in columns])))


def rate_by_dimensions(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Count and mean label per value of each column: the GROUPING SETS of
    several one-key group-bys computed from a single scan (Expand + partial
    aggregation)."""
    return (stack(df, columns, extra=[label]).groupBy("dimension", "value")
            .agg(F.count("*").alias("n"), F.avg(label).alias("rate")))


def argmax_per_dimension(g: DataFrame, score: str = "rate") -> DataFrame:
    """Row with the highest ``score`` per dimension, ties to the smallest value;
    runs on the small grouped table."""
    w = Window.partitionBy("dimension").orderBy(F.col(score).desc(), F.col("value"))
    return g.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def group_quantiles(df: DataFrame, value: str, probs: dict[str, float], group: str | None = None,
                    groups: list | None = None) -> dict:
    """Exact linear-interpolation quantiles of ``value`` per group value, all
    (group, probability) pairs resolved together by the distributed selection
    (no group is gathered into one task). Returns {(group, name): value}."""
    specs, where = {}, {}
    for g in (groups if group else [None]):
        for name, p in probs.items():
            q = f"q{len(specs)}"
            specs[q] = (F.col(value), p)
            if group:
                where[q] = F.col(group) == F.lit(g)
    res = exact_quantiles(df, specs, where)
    out, i = {}, 0
    for g in (groups if group else [None]):
        for name in probs:
            out[(g, name)] = res[f"q{i}"]
            i += 1
    return out


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """describe(): count, mean, sample std, min, quartiles, max per column;
    moments in one aggregate, quartiles by the distributed exact selection."""
    aggs = []
    for c in columns:
        x = F.col(c)
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).cast("double").alias(f"{c}__min"), F.max(x).cast("double").alias(f"{c}__max")]
    qs = {}
    for c in columns:
        for (_, name), v in group_quantiles(df, c, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).items():
            qs[(c, name)] = v
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__mean").alias("mean"),
        F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("min"), F.lit(qs[(c, "p25")]).alias("p25"),
        F.lit(qs[(c, "p50")]).alias("p50"), F.lit(qs[(c, "p75")]).alias("p75"), F.col(f"{c}__max").alias("max"))
        for c in columns])))


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """count / unique / top / freq per categorical column (top ties to the
    smallest value)."""
    counts = (stack(df, columns, "column_name", "value").where(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count("*").alias("freq")))
    # partial aggregates over the values: no task sees a whole column
    top = F.min(F.struct((-F.col("freq")).alias("f"), "value"))
    return (counts.groupBy("column_name").agg(F.sum("freq").alias("n"), F.count("*").alias("n_unique"), top.alias("t"))
            .select("column_name", "n", "n_unique", F.col("t.value").alias("top"), (-F.col("t.f")).alias("freq")))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[(F.count("*") - F.count(c)).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null"))
                                          for c in columns]))).where("n_null > 0")


#: Columns whose correlations one aggregate works out.
CORRELATED = 6


def correlations(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Pearson r of every column with the label, sorted by |r|. A few columns go into an
    aggregate: one over all of them is a method too large to be compiled."""
    parts = []
    for i in range(0, len(columns), CORRELATED):
        some = columns[i:i + CORRELATED]
        wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in some])
        parts.append(wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in some]))))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.where(F.col("corr").isNotNull() & ~F.isnan("corr")).orderBy(F.abs("corr").desc())


def histogram(df: DataFrame, value: str, label: str, bins: int) -> DataFrame:
    """Equal-width density histogram per label over each label's own range."""
    stats = df.groupBy(label).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"), F.count("*").alias("_cnt"))
    x = F.col(value)
    b = F.least(F.floor((x - F.col("_mn")) * bins / (F.col("_mx") - F.col("_mn"))).cast("int"), F.lit(bins - 1))
    # stats has one row per label value: a size-bounded broadcast
    return (df.join(F.broadcast(stats), label).groupBy(label, b.alias("bin"))
            .agg(F.count("*").alias("n"), F.max("_cnt").alias("_cnt"), F.max("_mx").alias("_mx"),
                 F.max("_mn").alias("_mn"))
            .select(label, "bin", "n",
                    (F.col("n") / (F.col("_cnt") * ((F.col("_mx") - F.col("_mn")) / bins))).alias("density")))


def _label_lit(label: str, values: dict) -> Column:
    """Per-label scalar as a column (a CASE over the few label values)."""
    expr = None
    for g, v in values.items():
        cond = F.col(label) == F.lit(g)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def box_stats(df: DataFrame, value: str, label: str) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR of the box) and
    outlier count per label. Quartiles come from the distributed selection; the
    fences are per-label literals, so the second pass is one grouped aggregate."""
    labels = [r[0] for r in df.select(label).distinct().collect()]  # label values (0 / 1)
    q = group_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, label, labels)
    q1 = _label_lit(label, {g: q[(g, "q1")] for g in labels})
    q3 = _label_lit(label, {g: q[(g, "q3")] for g in labels})
    med = _label_lit(label, {g: q[(g, "median")] for g in labels})
    x = F.col(value)
    lo = q1 - 1.5 * (q3 - q1)
    hi = q3 + 1.5 * (q3 - q1)
    return (df.groupBy(label).agg(
        F.first(q1).alias("q1"), F.first(med).alias("median"), F.first(q3).alias("q3"),
        F.min(F.when(x >= lo, x)).alias("whisker_lo"), F.max(F.when(x <= hi, x)).alias("whisker_hi"),
        F.count_if((x < lo) | (x > hi)).alias("n_outliers")))


def medians_by_label(df: DataFrame, value: str, label: str) -> DataFrame:
    q = group_quantiles(df, value, {"median": 0.5}, label, [1, 0])
    return df.agg(F.count("*").alias("_n")).select(F.lit(q[(1, "median")]).alias("median_anomalous"),
                                                   F.lit(q[(0, "median")]).alias("median_legit"))


def kpis(df: DataFrame) -> DataFrame:
    y = F.col("Is_Anomalous")
    rate = lambda cond: F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))
    r6 = lambda c: F.round(c, 6) + F.lit(0.0)
    return df.agg(
        F.count("*").alias("total"), F.sum(y).cast("bigint").alias("n_anomalous"),
        r6(F.avg(y)).alias("anomaly_rate"), r6(F.avg("Donation_Amount")).alias("amount_mean"),
        r6(F.stddev_samp("Donation_Amount")).alias("amount_std"),
        r6(F.avg(F.when(F.col("Is_Night_Donation") == 1, y))).alias("night_rate"),
        F.sum(F.when(F.col("High_Risk_Platform") == 1, y).otherwise(0)).cast("bigint").alias("high_risk_n"),
        r6(F.avg("Refund_Requested")).alias("refund_rate"), r6(F.avg("Is_Anonymous")).alias("anon_rate"),
        r6(rate(F.col("IP_Country_Match") == 0)).alias("ip_mismatch_rate"),
        r6(F.avg("Is_VPN_Or_Proxy")).alias("vpn_rate"),
        r6(rate(F.col("IP_Velocity_24h") >= 3)).alias("high_velocity_rate"))


def donor_aggregates(df: DataFrame, key: str = "Donor_ID", amount: str = "Donation_Amount") -> DataFrame:
    x = F.col(amount)
    return df.groupBy(key).agg(
        F.count("*").alias("n_donations"), F.avg(x).alias("mean_amount"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std_amount"), F.max(x).alias("max_amount"),
        F.sum(x).alias("sum_amount"),
        F.countDistinct("Campaign_ID").alias("n_campaigns"), F.countDistinct("Donation_Platform").alias("n_platforms"))


def donor_deviation(df: DataFrame, key: str = "Donor_ID", amount: str = "Donation_Amount") -> DataFrame:
    """(x - donor mean) / (donor std + 1) and x / donor total, via aggregate +
    equi-join (no per-donor window: a hot donor never lands in one window task)."""
    a = donor_aggregates(df, key, amount).select(key, "mean_amount", "std_amount", "sum_amount")
    x = F.col(amount)
    return df.join(a, key).withColumns({
        "deviation": (x - F.col("mean_amount")) / (F.col("std_amount") + 1),
        "amount_to_cumulative": x / F.col("sum_amount"),
    })


def bias_audit(scored: DataFrame) -> DataFrame:
    flag = F.col("Risk_Tier").isin("Critical", "High")
    y = F.col("Is_Anomalous")
    band = (F.when(F.col("Age") < 25, "18-24").when(F.col("Age") < 40, "25-39")
            .when(F.col("Age") < 60, "40-59").otherwise("60+"))
    long = scored.select(flag.alias("flag"), y.alias("y"), F.inline(F.array(
        F.struct(F.lit("gender").alias("grp"), F.col("Gender").alias("value")),
        F.struct(F.lit("age_band").alias("grp"), band.alias("value")),
        F.struct(F.lit("country").alias("grp"), F.col("Donor_Country").alias("value")))))
    g = long.groupBy("grp", "value").agg(
        F.count("*").alias("n"), F.avg(F.col("flag").cast("double")).alias("flag_rate"),
        F.sum(F.when(F.col("flag"), F.col("y")).otherwise(0)).alias("_tp"), F.count_if("flag").alias("_f"),
        F.count_if(F.col("flag") & (F.col("y") == 0)).alias("_fp"), F.count_if(F.col("y") == 0).alias("_neg"))
    return g.select("grp", "value", "n", "flag_rate",
                    F.coalesce(F.try_divide(F.col("_tp") * 1.0, F.col("_f")), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.try_divide(F.col("_fp") * 1.0, F.col("_neg")), F.lit(0.0)).alias("fpr"))


def rate_spread(df: DataFrame, dims: dict[str, str], label: str) -> DataFrame:
    g = rate_by_dimensions(df, list(dims.values()), label)
    names = F.create_map(*[x for k, v in dims.items() for x in (F.lit(v), F.lit(k))])
    r6 = lambda c: F.round(c, 6) + F.lit(0.0)
    return (g.groupBy(names[F.col("dimension")].alias("dimension"))
            .agg(r6(F.min("rate")).alias("min_rate"), r6(F.max("rate")).alias("max_rate"),
                 r6(F.stddev_pop("rate")).alias("sd_rate")))


def top_amount_rate(df: DataFrame, amount: str, label: str, share: float = 0.01) -> DataFrame:
    """The label's rate among the rows at or over the exact (1 - share) quantile
    of the amount (all ties of the cut belong to them) beside the rate of all rows."""
    cut = exact_quantiles(df, {"cut": (F.col(amount), 1 - share)})["cut"]
    top = F.when(F.col(amount) >= F.lit(cut), F.col(label))
    return df.agg(F.lit(cut).cast("double").alias("cut"), F.count(top).alias("n_top"), F.avg(top).alias("top_rate"), F.avg(label).alias("base_rate"))
