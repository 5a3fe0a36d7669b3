"""Quality classifier as a sparse rule ensemble (Friedman and Popescu, "Predictive
Learning via Rule Ensembles", 2008).

Statistics of whole texts feed a small random forest; every path from a root to a node
is a rule, a conjunction of bounds on statistics. Equal rules merge. A logistic
regression with an L1 penalty weighs the rules and leaves few; the score is compiled
into one Spark column expression over the statistics, without a model at run time.

One pass makes the statistics of all documents (no shuffle, per-text numpy work); they
are written as a narrow table, which fitting and scoring read. The fit uses the
labelled rows outside the held-out quarter, at most about ``max_fit_rows`` of them
chosen by hash (a documented bound of the fit alone); all documents are scored.

Defined cases: null text counts as empty, an empty text has all statistics 0 and is
scored like any other; several labels of a document: its label is 1 if their mean is
at least a half; null labels are left out; no labels: score 0.5 everywhere; one class
only: its smoothed share; repeated rows are scored one by one; a null doc_id matches no
label.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import BLANKS, documents, query, stage, texts
from giftrisk.llm.language_id import held_out

STATISTICS = ["log_words", "mean_word", "upper_share", "symbol_share", "exclaim_share", "pipe_share", "digit_share",
              "punct_share", "other_share", "distinct_words", "top_word", "same_next", "dup_lines", "line_words", "long_words"]

# Byte classes.
UPPER, LOWER = range(65, 91), range(97, 123)
DIGIT = range(48, 58)
SYMBOL = b"#*$%&<>@^~_=+\\{}[]"
PUNCT = b".,;:?'\"()-"


def statistics_of(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    many = lambda which: int(count[list(which)].sum())
    # a text's characters: all bytes but those that continue one, without blanks
    chars = max(1, len(text) - int(count[0x80:0xC0].sum()) - many(BLANKS))
    letters = max(1, many(UPPER) + many(LOWER))
    uses: dict[bytes, int] = {}
    for w in words:
        uses[w] = uses.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return [math.log1p(n), chars / n, many(UPPER) / letters, many(SYMBOL) / chars, many(b"!") / chars, many(b"|") / chars,
            many(DIGIT) / chars, many(PUNCT) / chars, int(count[0xC0:].sum()) / chars, len(uses) / n, max(uses.values()) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), n / len(lines),
            sum(len(w) > 20 for w in words) / n]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""
    def run(batches):
        for batch in batches:
            rows = np.array([statistics_of(t or b"") for t in texts(batch)], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(rows[:, i]) for i in range(len(STATISTICS))]], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple  # of (feature number, lower bound or None, upper bound or None): lower < x <= upper


def paths(tree: str) -> set[Rule]:
    """The rules of a printed tree: the path to every node but the root."""
    out, trail = set(), []
    for line in tree.split("\n"):
        if m := re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(line) - len(line.lstrip())
            trail = [t for t in trail if t[0] < depth] + [(depth, int(m[2]), m[3], float(m[4]))]
            bounds: dict[int, list] = {}
            for _, f, op, x in trail:
                b = bounds.setdefault(f, [None, None])
                if op == ">":
                    b[0] = x if b[0] is None else max(b[0], x)
                else:
                    b[1] = x if b[1] is None else min(b[1], x)
            out.add(tuple((f, *bounds[f]) for f in sorted(bounds)))
    return out


def holds(rule: Rule) -> Column:
    """A rule as a column expression."""
    tests = [t for f, lo, hi in rule for t in (
        [F.col(STATISTICS[f]) > lo] if lo is not None else []) + ([F.col(STATISTICS[f]) <= hi] if hi is not None else [])]
    whole = tests[0]
    for t in tests[1:]:
        whole = whole & t
    return whole


def fit(train: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> tuple[float, list[tuple[float, Rule]]]:
    """(intercept, weighted rules) from ``train(label, statistics...)``."""
    n = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    if len(n) < 2:
        share = (n.get(1.0, 0) + 1) / (sum(n.values()) + 2)
        return math.log(share / (1 - share)), []
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed)
    model = forest.fit(VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(train).select("label", "features"))
    rules = sorted(set().union(*(paths(t.toDebugString) for t in model.trees)), key=repr)
    if not rules:
        return math.log(n[1.0] / n[0.0]), []
    flags = train.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100, tol=1e-5).fit(flags)
    weights = lasso.coefficients.toArray()
    return float(lasso.intercept), [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-9]


def compile_score(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The ensemble as one column: logistic of the sum of the weights of held rules."""
    total = F.lit(intercept)
    for w, r in rules:
        total = total + F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 50_000) -> DataFrame:
    """doc_id, held_out, statistics, score and number of rules, for all documents."""
    stats = stage(statistics(docs), "quality_statistics")
    label = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.avg("quality") >= 0.5).cast("double").alias("label"))
    train = stats.where(~held_out(F.col("doc_id"))).join(label, "doc_id")
    train = stage(train, "quality_train")
    n = train.count()
    if n > max_fit_rows:
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * max_fit_rows / n))
    intercept, rules = fit(train)
    return stats.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", compile_score(intercept, rules)).withColumn("n_rules", F.lit(len(rules)))


@query("op10_rule_ensemble")
def op10(spark, sf_dir):
    scored = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
