"""Mixing sources to target weights by Poisson replication.

Each source group g gets the mean repetition rate
``rate(g) = weight(g) * budget / characters(g)``, where the budget is ``epochs``
times all characters. A document's number of copies is a Poisson draw with its
group's rate: the distribution is inverted at a uniform number made from the hash of
the document's id, text and the seed, so a retry, another partitioning or another
machine draws the same. Rates above ``STEP`` are drawn as a sum of draws with
smaller rates, as exp(-rate) would underflow. Copies are dealt out by a hash of
document, copy and row number and sorted by it: one shuffle, and a random global order,
in which repeated rows are spread like any others. The rows' numbers come from the
scan, so ``docs`` should be a table or a plan whose rows keep their order on a retry.

The characters of a group are one partial sum per task; a source with a third of all
rows needs no special case. The rates are one row per configured weight.

Defined cases: a null source or one without a weight falls into the group of the
rest, which shares ``rest`` by its natural proportions; weights of groups without
characters go to the others in proportion; a null text counts no characters and is
drawn at its group's rate (rate 0 if its group has no characters); a null doc_id is
hashed as the word null; repeated rows of one id and text draw alike; columns that have
the names of the result's give way to them in ``mix`` and stay in ``replicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import documents, query

SEED = 17
#: Largest rate of a single draw.
STEP = 200.0
#: What the result adds to a document.
ADDED = ["rate", "n_copies", "copy", "shuffle_key"]
#: Production target: half as much of the largest source as of an even split, the
#: rest even; sources that are not named share five hundredths.
WEIGHTS = {"src0": 0.07} | {f"src{i}": 0.05 for i in range(1, 20)}
REST = 0.05


def _group(weights: dict[str, float]) -> Column:
    return F.when(F.col("source").isin(*weights), F.col("source")).otherwise(F.lit(None).cast("string"))


def rates(docs: DataFrame, weights: dict[str, float], rest: float, epochs: float) -> dict[str | None, float]:
    """Mean repetition rate of each group (None: the rest); len(weights) + 1 rows at most."""
    chars = {r[0]: r[1] for r in docs.groupBy(_group(weights)).agg(F.sum(F.length("text"))).collect() if r[1]}
    target = {g: weights.get(g, rest) for g in chars}
    whole, budget = sum(target[g] for g in sorted(target, key=lambda g: (g is None, g))), epochs * sum(chars.values())
    return {g: target[g] / whole * budget / chars[g] if whole else 0.0 for g in chars}


def uniform(key: Column, part: Column) -> Column:
    """52 random bits of a key as a number in [0, 1)."""
    digest = F.md5(F.concat_ws("|", key, part.cast("string"), F.lit(str(SEED))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """Smallest k with u < P(X <= k): the terms are summed up to where what is left
    is under 2 ** -52. The accumulator carries rate and u, so that they are computed
    once and not again for every term."""
    top = F.ceil(rate + 9 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(rate.alias("rate"), u.alias("u"), F.exp(-rate).alias("p"), F.lit(0.0).alias("cdf"), F.lit(0).alias("k"))

    def step(acc, j):
        cdf = acc["cdf"] + acc["p"]
        return F.struct(acc["rate"].alias("rate"), acc["u"].alias("u"), (acc["p"] * acc["rate"] / j).alias("p"), cdf.alias("cdf"),
                        (acc["k"] + F.when(acc["u"] >= cdf, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["k"])


def copies(rate: Column, key: Column) -> Column:
    parts = F.greatest(F.ceil(rate / STEP).cast("int"), F.lit(1))
    share = rate / parts
    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda acc, i: acc + poisson(share, uniform(key, i)))


def _replicate(docs: DataFrame, weights: dict[str, float], rest: float, epochs: float) -> DataFrame:
    """Replicated rows of ``docs``, whose names must not clash with ADDED."""
    found = rates(docs, weights, rest, epochs)
    rate = F.lit(found.get(None, 0.0))
    for g in sorted(x for x in found if x is not None):
        rate = F.when(_group(weights) == g, F.lit(found[g])).otherwise(rate)
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    drawn = docs.withColumn("rate", rate).withColumn("_key", key).withColumn("n_copies", copies(F.col("rate"), F.col("_key")))
    out = drawn.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", "_key", F.col("copy").cast("string"), F.lit(f"order{SEED}")).cast("binary"))).drop("_key")
    # equal rows share a shuffle_key: their numbers in the table deal them out
    out = out.withColumn("_place", F.xxhash64("shuffle_key", "_row"))
    return out.repartition("_place").sortWithinPartitions("_place").drop("_place", "_row")


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with rows numbered (``_row``) and its columns besides doc_id, text and
    source under names that clash with nothing; and these names."""
    name = {c: c if c in ("doc_id", "text", "source") else f"_own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*name.values()).withColumn("_row", F.monotonically_increasing_id()), name


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, rest: float = REST, epochs: float = 1.0) -> DataFrame:
    """Replicated documents in random global order: the columns of ``docs`` and
    copy (from 1), n_copies, rate and shuffle_key, which take the place of columns of
    these names."""
    apart, name = _apart(docs)
    out = _replicate(apart, weights, rest, epochs)
    return out.select(*[F.col(n).alias(c) for c, n in name.items() if c.lower() not in ADDED], *ADDED)


def replicated(docs: DataFrame, weights: dict[str, float] = WEIGHTS, rest: float = REST, epochs: float = 1.0) -> DataFrame:
    """The rows of ``mix`` with just the columns of ``docs``, all with their own values."""
    apart, name = _apart(docs)
    return _replicate(apart, weights, rest, epochs).select(*[F.col(n).alias(c) for c, n in name.items()])


SQL = f"""
WITH w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in WEIGHTS.items())}) AS w(source, weight)),
d AS (SELECT doc_id, documents.source, w.source AS g, coalesce(weight, CAST({REST!r} AS DOUBLE)) AS weight, text,
             coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) AS key
      FROM documents LEFT JOIN w ON documents.source = w.source),
size AS (SELECT g, any_value(weight) AS weight, CAST(sum(length(text)) AS DOUBLE) AS chars FROM d GROUP BY g HAVING sum(length(text)) > 0),
rate AS (SELECT g, weight / (SELECT sum(weight) FROM size) * (SELECT sum(chars) FROM size) / chars AS rate FROM size),
cdf AS (SELECT g, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS c
        FROM rate, range(0, 200) AS r(k)),
u AS (SELECT d.*, rate, CAST(CAST('0x' || md5(key || '|0|{SEED}')[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496 AS u
      FROM d JOIN rate ON d.g IS NOT DISTINCT FROM rate.g),
n AS (SELECT u.doc_id, u.source, u.text, u.key, u.rate, (SELECT count(*) FROM cdf WHERE cdf.g IS NOT DISTINCT FROM u.g AND cdf.c <= u.u) AS n_copies FROM u)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, CAST(n_copies AS INTEGER) AS n_copies, round(rate, 6) AS rate,
       md5(key || '|' || CAST(copy AS VARCHAR) || '|order{SEED}') AS shuffle_key, md5(text) AS text_md5
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM n WHERE n_copies > 0)
"""


@query("op6_poisson_mix", SQL)
def op6(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select(
        "doc_id", "source", "copy", "n_copies", F.round("rate", 6).alias("rate"), "shuffle_key",
        F.md5(F.col("text").cast("binary")).alias("text_md5"))
