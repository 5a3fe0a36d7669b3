"""Exact order statistics and quantiles that scale.

``percentile`` keeps a value->count map per group and merges it in one task,
and a rank window without ``partitionBy`` sorts the whole table in one task.
Neither survives a label group holding a third of 100 TB. Here an exact k-th
smallest value is found in four distributed passes:

1. ``count`` of the non-null values;
2. ``percentile_approx`` brackets ``[lo, hi]`` around every requested rank
   (rank error of the sketch is at most n / accuracy);
3. one aggregate counts rows ``< lo``, ``== lo``, strictly inside, ``<= hi``;
4. the few ranks that fall strictly inside a bracket are resolved with a
   ``row_number`` window partitioned by request; each partition holds only the
   bracket interior (at most ~4 n / accuracy rows, accuracy grows with n).

Only scalars reach the driver. If a bracket misses its rank (the sketch bound is
probabilistic in Spark's merge), the bracket is widened and the pass repeated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giftrisk.session import write_stage


#: Rows that one task may order. What is larger is narrowed down again: a bracket's
#: interior by brackets of its own, a set of ties by ranges.
MAX_ORDERED = 1_000_000


@dataclass(frozen=True)
class OrderStat:
    """k-th smallest (0-based) non-null value of ``value`` among rows where
    ``where`` holds."""
    value: Column
    k: int
    where: Column | None = None


def _accuracy(n: int) -> int:
    return int(min(1_000_000, max(10_000, n // 250_000)))


def _masked(req: OrderStat) -> Column:
    return req.value if req.where is None else F.when(req.where, req.value)


def count_nonnull(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    row = df.agg(*[F.count(v).alias(q) for q, v in values.items()]).first()
    return {q: int(row[q]) for q in values}


def order_stats(df: DataFrame, requests: dict[str, OrderStat],
                counts: dict[str, int] | None = None) -> dict[str, object]:
    """Exact k-th smallest values for every request, computed together."""
    if not requests:
        return {}
    masked = {q: _masked(r) for q, r in requests.items()}
    if counts is None:
        counts = count_nonnull(df, masked)
    for q, r in requests.items():
        if not 0 <= r.k < counts[q]:
            raise ValueError(f"rank {r.k} outside [0, {counts[q]}) for {q}")
    proj = df.select(*[m.alias(q) for q, m in masked.items()])
    widen = {q: 1 for q in requests}
    result: dict[str, object] = {}
    pending = dict(requests)
    while pending:
        # pass 2: sketch brackets; requests on the same values share a sketch
        sketches, spec = {}, {}
        for q, r in pending.items():
            n = counts[q]
            acc = _accuracy(n)
            margin = widen[q] * (2 * math.ceil(n / acc) + 2)
            p_lo = max(0.0, (r.k - margin) / n)
            p_hi = min(1.0, (r.k + margin) / n)
            sketches.setdefault((id(r.value), id(r.where), acc), []).append(q)
            spec[q] = (p_lo, p_hi)
        aggs = [F.percentile_approx(F.col(qs[0]), [p for q in qs for p in spec[q]], key[2]).alias(qs[0])
                for key, qs in sketches.items()]
        found = proj.agg(*aggs).first()
        brackets = {q: found[qs[0]][2 * i:2 * i + 2] for qs in sketches.values() for i, q in enumerate(qs)}
        bounds = {}
        for q in pending:
            lo, hi = brackets[q]
            if spec[q][0] <= 0.0:
                lo = None  # open below
            if spec[q][1] >= 1.0:
                hi = None  # open above
            bounds[q] = (lo, hi)
        # pass 3: counts around each bracket
        cnt = []
        for q, (lo, hi) in bounds.items():
            x = F.col(q)
            lo_c = F.lit(lo) if lo is not None else None
            hi_c = F.lit(hi) if hi is not None else None
            below = F.count_if(x < lo_c) if lo_c is not None else F.lit(0)
            eq_lo = F.count_if(x == lo_c) if lo_c is not None else F.lit(0)
            inner_cond = x.isNotNull()
            if lo_c is not None:
                inner_cond = inner_cond & (x > lo_c)
            if hi_c is not None:
                inner_cond = inner_cond & (x < hi_c)
            le_hi = F.count_if(x <= hi_c) if hi_c is not None else F.count(x)
            cnt += [below.alias(f"{q}__b"), eq_lo.alias(f"{q}__e"),
                    F.count_if(inner_cond).alias(f"{q}__i"), le_hi.alias(f"{q}__h")]
        c = proj.agg(*cnt).first()
        inner_jobs = {}
        for q, r in list(pending.items()):
            b, e, i, h = (int(c[f"{q}__b"]), int(c[f"{q}__e"]),
                          int(c[f"{q}__i"]), int(c[f"{q}__h"]))
            lo, hi = bounds[q]
            if r.k < b or r.k >= h:
                widen[q] *= 4  # sketch missed: widen and retry
                continue
            if lo is not None and r.k < b + e:
                result[q] = lo
            elif r.k < b + e + i:
                if i > MAX_ORDERED:
                    inside = masked[q].isNotNull()
                    if lo is not None:
                        inside = inside & (masked[q] > F.lit(lo))
                    if hi is not None:
                        inside = inside & (masked[q] < F.lit(hi))
                    narrow = OrderStat(masked[q], r.k - b - e, inside)
                    result[q] = order_stats(df, {q: narrow}, {q: i})[q]
                else:
                    inner_jobs[q] = (lo, hi, r.k - b - e)
            else:
                result[q] = hi
            del pending[q]
        if inner_jobs:
            result.update(_pick_inside(proj, inner_jobs))
    return result


def _pick_inside(proj: DataFrame, jobs: dict[str, tuple]) -> dict[str, object]:
    """Resolve ranks strictly inside brackets; each window partition is one
    bracket interior. Requests of one call share a value type."""
    entries, some = [], F.lit(False)
    for q, (lo, hi, j) in jobs.items():
        x = F.col(q)
        cond = x.isNotNull()
        if lo is not None:
            cond = cond & (x > F.lit(lo))
        if hi is not None:
            cond = cond & (x < F.lit(hi))
        some = some | cond
        entries.append(F.when(cond, F.struct(F.lit(q).alias("qid"), x.alias("x"), F.lit(j).alias("j"))))
    # one scan for all requests; few rows lie inside a bracket
    allp = proj.where(some).select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")
    w = Window.partitionBy("qid").orderBy("x")
    rows = (allp.withColumn("rn", F.row_number().over(w) - 1)
            .where(F.col("rn") == F.col("j")).select("qid", "x").collect())
    return {r["qid"]: r["x"] for r in rows}


def exact_quantiles(df: DataFrame, specs: dict[str, tuple[Column, float]],
                    where: dict[str, Column] | None = None,
                    counts: dict[str, int] | None = None) -> dict[str, float]:
    """Linear-interpolation quantiles (numpy/pandas default, DuckDB
    ``quantile_cont``): v[lo] + (v[hi] - v[lo]) * (h - lo), h = (n - 1) p.
    ``counts`` (non-null counts per spec) saves the counting pass when an
    earlier aggregate already produced them."""
    where = where or {}
    masked = {q: (col if where.get(q) is None else F.when(where[q], col)) for q, (col, _) in specs.items()}
    if counts is None or set(counts) != set(specs):
        counts = count_nonnull(df, masked)
    reqs, plan = {}, {}
    for q, (col, p) in specs.items():
        n = counts[q]
        if n == 0:
            plan[q] = None
            continue
        h = (n - 1) * p
        lo, hi = math.floor(h), math.ceil(h)
        reqs[f"{q}__lo"] = OrderStat(col, lo, where.get(q))
        reqs[f"{q}__hi"] = OrderStat(col, hi, where.get(q))
        plan[q] = (h, lo)
    sub_counts = {}
    for q in specs:
        if plan[q] is not None:
            sub_counts[f"{q}__lo"] = counts[q]
            sub_counts[f"{q}__hi"] = counts[q]
    vals = order_stats(df, reqs, sub_counts)
    out = {}
    for q, pl in plan.items():
        if pl is None:
            out[q] = None
            continue
        h, lo = pl
        v_lo, v_hi = float(vals[f"{q}__lo"]), float(vals[f"{q}__hi"])
        out[q] = v_lo + (v_hi - v_lo) * (h - lo)
    return out


def _kth_by_range(values: DataFrame, k: int):
    """k-th smallest (0-based) of ``values(t)``, of any orderable type: ties are cut
    into ranges, and only the range that holds the rank is ordered."""
    if k < MAX_ORDERED:
        return values.orderBy("t").offset(k).limit(1).first()["t"]
    cut = write_stage(write_stage(values, "ties").repartitionByRange("t").withColumn("b", F.spark_partition_id()), "tie_ranges")
    for r in cut.groupBy("b").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("b").collect():
        if k < r["n"]:
            mine = cut.where(F.col("b") == r["b"])
            return r["lo"] if r["lo"] == r["hi"] else mine.orderBy("t").offset(k).limit(1).first()["t"]
        k -= r["n"]
    raise ValueError("rank beyond the values")


def first_k_masks(df: DataFrame, draw: Column, tiebreak: Column,
                  requests: dict[str, tuple[int, Column | None]],
                  counts: dict[str, int] | None = None) -> dict[str, Column]:
    """Boolean columns, one per request (k, where), each true on exactly the
    ``k`` rows (among ``where``) that come first when ordered by
    (draw, tiebreak). All requests share the selection passes. Replaces
    ``row_number() <= k`` over a whole group without sorting the group in one
    task."""
    conds = {q: (F.lit(True) if w is None else w) for q, (_, w) in requests.items()}
    live = {q: k for q, (k, _) in requests.items() if k > 0}
    out = {q: F.lit(False) for q in requests if q not in live}
    if not live:
        return out
    known = {q: counts[q] for q in live} if counts and all(q in counts for q in live) else None
    vs = order_stats(df, {q: OrderStat(draw, k - 1, requests[q][1]) for q, k in live.items()}, known)
    # rows strictly below v, and the smallest tiebreak among ties on v
    aggs = []
    for q in live:
        v = F.lit(vs[q])
        aggs += [F.count_if(conds[q] & (draw < v)).alias(f"{q}__b"),
                 F.min(F.when(conds[q] & (draw == v), tiebreak)).alias(f"{q}__t")]
    row = df.agg(*aggs).first()
    for q, k in live.items():
        v = F.lit(vs[q])
        r = k - int(row[f"{q}__b"])  # rows to take among ties on v, by tiebreak
        if r == 1:
            t = row[f"{q}__t"]
        else:
            t = _kth_by_range(df.where(conds[q] & (draw == v)).select(tiebreak.alias("t")), r - 1)
        out[q] = conds[q] & ((draw < v) | ((draw == v) & (tiebreak <= F.lit(t))))
    return out


def first_k_mask(df: DataFrame, draw: Column, tiebreak: Column, k: int,
                 where: Column | None = None) -> Column:
    """Single-request form of ``first_k_masks``."""
    return first_k_masks(df, draw, tiebreak, {"m": (k, where)})["m"]
