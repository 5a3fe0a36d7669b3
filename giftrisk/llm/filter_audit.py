"""Filter interaction audit: what each filter removes at each place of each order,
from count-weighted decision diagrams of failure masks.

A document's failure mask has a bit per filter. Counts by (part, mask, good, toxic)
are all the audit needs: at most 2^filters * 4 numbers a part, summed by Spark. Per
part they become a decision diagram: a level per filter in the present order, a pass
and a fail edge at each node, count vectors (documents, good, toxic) at the leaves,
equal nodes kept once, and each node's weight the sum of its leaves. Following pass
edges from the root is applying the filters in order: a step keeps the pass child's
weight and removes the fail child's. Another order is reached by swapping adjacent
levels, which touches these two levels' nodes only; a chain of swaps
(Steinhaus-Johnson-Trotter) visits every order, one swap apart.

The first E-like filter (``equal to a smaller id's text``) is table-wide: rows are
first counted by (id, digest, part), so repeated rows and hot texts shrink before the
shuffle; a digest's smallest id is a small aggregate joined back (AQE splits a hot
one). Texts are never shuffled, only 256-bit digests.

Defined cases: null text is empty (fails ``few words`` only, unless it repeats); a null
id is not larger than any id, so its row never repeats one, and no label is its; of
repeated rows (same id) none is smaller; a null part is the empty string; an id with
several labels is good (toxic) if any row says so; very long texts are one row of one
task, linear in their length; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import WORD, documents, query

FILTERS = "ABCDE"
OUT = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
       "unique_fails long, good_lost long, toxic_lost long, shapley long")


class Diagram:
    """A quasi-reduced diagram of ``counts`` {mask: vector}: bit i of a mask is filter i.

    Nodes are (pass child, fail child) tuples kept once each, leaves are vectors;
    ``order`` holds the filter of each level from the root."""

    def __init__(self, counts: dict[int, tuple], n: int):
        self.order, self.nodes, self.weight = list(range(n)), {}, {}
        zero = (0,) * len(next(iter(counts.values())))

        def build(level: int, mask: int):
            if level == n:
                return counts.get(mask, zero)
            return self.node(build(level + 1, mask), build(level + 1, mask | 1 << level), level == n - 1)

        self.root = build(0, 0)

    def node(self, ok, fail, above_leaf: bool):
        """The one node with these children."""
        key = (id(ok), id(fail)) if not above_leaf else (ok, fail)
        found = self.nodes.get(key)
        if found is None:
            found = self.nodes[key] = (ok, fail)
            a, b = (x if above_leaf else self.weight[id(x)] for x in found)
            self.weight[id(found)] = tuple(p + q for p, q in zip(a, b))
        return found

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and ``level + 1``; all other levels stay,
        nodes above are rebuilt only where a child changed."""
        n, done = len(self.order), {}

        def rebuild(node, at: int):
            if id(node) not in done:
                ok, fail = node
                if at == level:
                    (oo, of), (fo, ff) = ok, fail
                    low = at + 2 == n
                    done[id(node)] = self.node(self.node(oo, fo, low), self.node(of, ff, low), False)
                else:
                    done[id(node)] = self.node(rebuild(ok, at + 1), rebuild(fail, at + 1), False)
            return done[id(node)]

        self.root = rebuild(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple, tuple]]:
        """(filter, kept, removed) along the all-pass path."""
        out, node = [], self.root
        for level, f in enumerate(self.order):
            ok, fail = node
            leaf = level + 1 == len(self.order)
            out.append((f, *((x if leaf else self.weight[id(x)]) for x in (ok, fail))))
            node = ok
        return out


def swap_chain(n: int) -> list[int]:
    """Levels to swap, one after the other, so that every order occurs once."""
    place, direction, out = list(range(n)), [-1] * n, []
    while True:
        movable = [x for x in range(n) if 0 <= (at := place.index(x)) + direction[x] < n and place[at + direction[x]] < x]
        if not movable:
            return out
        x = max(movable)
        at = place.index(x)
        to = at + direction[x]
        place[at], place[to] = place[to], place[at]
        out.append(min(at, to))
        direction = [-d if y > x else d for y, d in enumerate(direction)]


def audit_part(part: str, counts: dict[int, tuple], names: str) -> list[tuple]:
    """The audit's rows of one part; ``counts`` {mask: (documents, good, toxic)}."""
    n = len(names)
    diagram = Diagram(counts, n)
    orders = {tuple(diagram.order): diagram.steps()}
    for level in swap_chain(n):
        diagram.swap(level)
        orders[tuple(diagram.order)] = diagram.steps()
    assert len(orders) == math.factorial(n)
    fails, unique, shapley = [0] * n, [0] * n, [0] * n
    for steps in orders.values():
        fails[steps[0][0]] = steps[0][2][0]  # the first filter removes all that fail it,
        unique[steps[-1][0]] = steps[-1][2][0]  # the last one what fails nothing else
        for f, _, removed in steps:
            shapley[f] += removed[0]
    return [(part, "".join(names[f] for f in order), i + 1, names[f], kept[0], gone[0], fails[f] - gone[0], unique[f], gone[1], gone[2], shapley[f])
            for order, steps in orders.items() for i, (f, kept, gone) in enumerate(steps)]


def audit(masks: DataFrame, names: str) -> DataFrame:
    """Rows of every part, order and step from ``masks(part, mask, n, good, toxic)``,
    which may hold several rows of a mask. n! * n rows a part: meant for few filters."""
    if not 2 <= len(names) <= 7:
        raise ValueError("two to seven filters")
    sums = masks.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:  # a part has 2^filters rows at most
        counts = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in frame.itertuples()}
        return pd.DataFrame(audit_part(frame["part"].iloc[0], counts, names), columns=[x.split()[0] for x in OUT.split(", ")])

    return sums.groupBy("part").applyInPandas(run, OUT)


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one text; true where it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * capitals > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts over all documents; bits A to D as in
    ``text_filters``, then E, equal to the text of a smaller id."""
    text = F.coalesce("text", F.lit(""))
    own = reduce(lambda a, b: a + b, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_filters(text).values())))
    rows = (docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"),
                        F.sha2(text, 256).alias("digest"), own.alias("own"))
            .groupBy("id", "digest", "part", "own").agg(F.count("*").alias("c")))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(flag("quality").alias("q"), flag("toxic").alias("t"))
    groups = (rows.join(marks, "id", "left")
              .groupBy("digest", "part", "own", F.coalesce("q", F.lit(0)).alias("q"), F.coalesce("t", F.lit(0)).alias("t"))
              .agg(F.min("id").alias("low"), F.sum("c").alias("n"), F.min_by("c", "id").alias("c_low"),
                   F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("c_null")))
    first = groups.groupBy("digest").agg(F.min("low").alias("first"), F.count("*").alias("k"), F.sum("n").alias("all")).where("all > 1").select("digest", "first")
    joined = groups.join(first, "digest", "left")
    # of a group, the rows of the digest's smallest id and those without an id pass E
    clean = F.when(F.col("first").isNull(), F.col("n")).otherwise(
        F.col("c_null") + F.when(F.col("low") == F.col("first"), F.col("c_low")).otherwise(0))
    both = joined.select("part", "own", "q", "t", "n", clean.alias("clean"))
    e = 1 << 4
    split = both.select("part", "q", "t", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), F.col("clean").alias("n")),
        F.struct((F.col("own") + e).alias("mask"), (F.col("n") - F.col("clean")).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("q")).alias("good"), F.sum(F.col("x.n") * F.col("t")).alias("toxic"))


def _sql() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x,
             CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(q) AS good, sum(x) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT o, unnest(range(1, 6)) AS step FROM (VALUES {orders}) v(o)),
s AS (SELECT part, o, step, substr(o, step, 1) AS filter,
             sum(CASE WHEN translate(fails, substr(o, 1, step), '') = fails THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN contains(fails, substr(o, step, 1)) AND translate(fails, substr(o, 1, step - 1), '') = fails THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN contains(fails, substr(o, step, 1)) AND translate(fails, substr(o, 1, step - 1), '') <> fails THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN fails = substr(o, step, 1) THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN contains(fails, substr(o, step, 1)) AND translate(fails, substr(o, 1, step - 1), '') = fails THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN contains(fails, substr(o, step, 1)) AND translate(fails, substr(o, 1, step - 1), '') = fails THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, o GROUP BY part, o, step)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM s
"""


@query("op13_filter_diagrams", _sql())
def op13(spark, sf_dir):
    return audit(failure_masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")), FILTERS)
