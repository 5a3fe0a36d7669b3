"""Model operators.

MLlib covers label encoding, scaling, random forest, logistic regression and
isotonic calibration. The isolation forest (absent from MLlib) is distributed by
tree: rows are sampled with key-derived draws and dealt to trees, each tree is
grown in one ``applyInPandas`` group (at most ~3 x 256 rows), and scoring ships
the node table (trees x <= 511 nodes, size-bounded) to every task and walks it
vectorised in ``mapInPandas``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline as MLPipeline
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.functions.draws import uniform
from giftrisk.operators import windows
from giftrisk.operators.quantiles import first_k_masks
from giftrisk.session import write_stage


def encode_categoricals(df: DataFrame, cols=C.CAT_ENCODE) -> DataFrame:
    """M1: sorted-string label codes (StringIndexer alphabetAsc), as ints."""
    idx = StringIndexer(inputCols=[c for c in cols], outputCols=[f"{c}__idx" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    out = idx.fit(df).transform(df)
    return out.withColumns({c: F.col(f"{c}__idx").cast("int") for c in cols}).drop(*[f"{c}__idx" for c in cols])


def class_weights(df: DataFrame, label: str = "Is_Anomalous") -> DataFrame:
    """M4: balanced weights n / (2 n_c) per class."""
    g = df.groupBy(label).agg(F.count("*").alias("n_c"))
    tot = g.agg(F.sum("n_c")).first()[0]
    return g.select(label, "n_c", (F.lit(tot) / (2 * F.col("n_c"))).alias("weight"))


def stratified_split(df: DataFrame, label: str = "Is_Anomalous", test_share: float = 0.2,
                     key: str = "Donation_ID") -> DataFrame:
    """M2: exactly round(test_share * n_c) rows of each class go to test, the
    first by a key-derived draw (distributed selection, no per-class sort)."""
    d = df.withColumn("_sd", F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit("|split"))), 1, 15), 16, 10)
                      .cast("bigint"))
    # the counting and selection passes read keys and draws alone
    draws = write_stage(d.select(key, label, "_sd"), "split_draws")
    counts = {r[label]: r["n"] for r in draws.groupBy(label).agg(F.count("*").alias("n")).collect()}
    masks = first_k_masks(draws, F.col("_sd"), F.col(key),
                          {str(cls): (int(round(test_share * n)), F.col(label) == cls) for cls, n in counts.items()})
    mask = F.lit(False)
    for m in masks.values():
        mask = mask | m
    return d.withColumn("is_test", mask.cast("int")).drop("_sd")


def assembler(cols=C.MODEL_FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def weighted(df: DataFrame, label: str = "Is_Anomalous") -> DataFrame:
    w = class_weights(df, label).select(label, "weight")
    return df.join(F.broadcast(w), label)  # two rows


def positive_probability(df: DataFrame, col: str = "probability") -> DataFrame:
    return df.withColumn("score", vector_to_array(F.col(col))[1])


#: Parts of bounded fit rows, however many the table has.
FIT_PARTITIONS = 12


def fit_rows(train: DataFrame, max_rows: int, key: str = "Donation_ID") -> DataFrame:
    """All labelled rows, or about ``max_rows`` by hash, written once in
    ``FIT_PARTITIONS`` ordered parts. For a trial on few rows: the models of the queries
    are fitted on all."""
    n = train.count()
    if n <= max_rows:
        return train
    chosen = train.where(F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return write_stage(chosen.repartition(FIT_PARTITIONS, key).sortWithinPartitions(key), "fit_rows")


#: Bytes that the passes of a forest may keep beside the rows' bins: for each row and
#: tree a count of the bagging and a node number, the latter twice while it changes.
BAGGED_BYTES, BAGGED = 8 << 30, 12


def fit_random_forest(train: DataFrame, trees: int = C.FOREST_TREES, depth: int = C.FOREST_DEPTH,
                      min_leaf: int = C.FOREST_MIN_LEAF, seed: int = 42):
    """M5: RF with balanced class weights, sqrt feature subsets, on all rows of
    ``train``. The trees of a forest are independent: where the bagging of all would
    take more than ``BAGGED_BYTES``, they are grown so many at a time."""
    at_once = max(1, min(trees, BAGGED_BYTES // (BAGGED * max(1, train.count()))))
    rows = assembler().transform(weighted(train))
    parts = [RandomForestClassifier(labelCol="Is_Anomalous", featuresCol="features", weightCol="weight",
                                    numTrees=min(at_once, trees - first), maxDepth=depth, minInstancesPerNode=min_leaf,
                                    featureSubsetStrategy="sqrt", maxMemoryInMB=1024, cacheNodeIds=True, seed=seed + first).fit(rows)
             for first in range(0, trees, at_once)]
    return PipelineModel([assembler(), _one_forest(parts)])


def _one_forest(parts: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """The trees of several forests as one forest."""
    if len(parts) == 1:
        return parts[0]
    sc, first = SparkSession.active().sparkContext, parts[0]._java_obj
    of = sc._jvm.org.apache.spark.ml.classification
    grown = [t for p in parts for t in p._java_obj.trees()]
    trees = sc._gateway.new_array(of.DecisionTreeClassificationModel, len(grown))
    for i, t in enumerate(grown):
        trees[i] = t
    whole = of.RandomForestClassificationModel(first.uid(), trees, first.numFeatures(), first.numClasses())
    first.copyValues(whole, first.extractParamMap())
    whole.set(whole.getParam("numTrees"), len(grown))
    out = RandomForestClassificationModel(whole)
    out._transfer_params_from_java()
    return out


def fit_logistic(train: DataFrame, max_iter: int = C.LOGISTIC_ITERATIONS, n: int | None = None):
    """M6: L2 logistic regression on standardised features (C = 1 -> regParam 1/n),
    up to ``max_iter`` iterations; it ends before if it has converged."""
    n = n if n is not None else train.count()
    lr = LogisticRegression(labelCol="Is_Anomalous", featuresCol="scaled", weightCol="weight", maxIter=max_iter,
                            regParam=1.0 / n, elasticNetParam=0.0, standardization=False)
    return MLPipeline(stages=[assembler(), StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
                              lr]).fit(weighted(train))


def stratified_folds(train: DataFrame, folds: int, label: str = "Is_Anomalous", key: str = "Donation_ID") -> DataFrame:
    """Adds ``_fold``: the rows of each class dealt out evenly in hash order. Rows are
    written in ranges of (class, hash): a row's number is the one in its range plus the
    rows of the class's earlier ranges."""
    cut = windows._cut(train.withColumn("_h", F.xxhash64(key, F.lit("fold"))), [label], ["_h", key], None)
    earlier = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = cut.groupBy(label, "_b").agg(F.count("*").alias("_n")).select(label, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    within = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    return windows._with(cut, before, [label]).withColumn("_fold", ((F.col("_n") + within - 1) % folds).cast("int")).drop("_b", "_h", "_n")


def calibrated_logistic(train: DataFrame, test: DataFrame, folds: int = C.CALIBRATION_FOLDS,
                        max_iter: int = C.LOGISTIC_ITERATIONS) -> DataFrame:
    """M7: per fold, LR on the other folds + isotonic regression on the fold; the test
    score is the average of the calibrated fold models. Features are assembled and
    scaled once, for all rows, and written (a fit keeps its own copy in blocks); one
    weight per class; scores are grouped (4 digits) before the isotonic fit; all fold
    models score the test rows in one projection."""
    tr = stratified_folds(train, folds)
    prepare = MLPipeline(stages=[assembler(), StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]).fit(train)
    tr = write_stage(weighted(prepare.transform(tr)).select("Donation_ID", "Is_Anomalous", "weight", "_fold", "scaled"), "fold_rows")
    sizes = {r["_fold"]: r["count"] for r in tr.groupBy("_fold").count().collect()}  # <= folds rows
    total = sum(sizes.values())
    out = prepare.transform(test).select("Donation_ID", "scaled")
    for k in range(folds):
        lr = LogisticRegression(labelCol="Is_Anomalous", featuresCol="scaled", weightCol="weight", maxIter=max_iter,
                                regParam=1.0 / max(1, total - sizes.get(k, 0)), elasticNetParam=0.0, standardization=False,
                                probabilityCol=f"p{k}", rawPredictionCol=f"r{k}", predictionCol=f"d{k}")
        model = lr.fit(tr.where(F.col("_fold") != k))
        held = positive_probability(model.transform(tr.where(F.col("_fold") == k)), f"p{k}")
        held = held.groupBy(F.round("score", 4).alias(f"s{k}")).agg(F.avg("Is_Anomalous").alias("y"), F.count("*").cast("double").alias("w"))
        iso = IsotonicRegression(labelCol="y", featuresCol=f"s{k}", weightCol="w", predictionCol=f"c{k}").fit(held)
        out = model.transform(out).withColumn(f"s{k}", vector_to_array(F.col(f"p{k}"))[1]).drop(f"p{k}", f"r{k}", f"d{k}")
        out = iso.transform(out)
    mean = sum((F.col(f"c{k}") for k in range(folds)), F.lit(0.0)) / folds
    return out.select("Donation_ID", mean.alias("score"))


# ---------------------------------------------------------------- isolation forest
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Iterative isolation tree: returns node arrays (feature, threshold,
    left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []
    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        idx, depth, parent, side = stack.pop()
        nid = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if parent >= 0:
            (left if side == 0 else right)[parent] = nid
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            continue
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[nid], thr[nid] = f, t
        go_left = sub[:, f] < t
        stack.append((idx[~go_left], depth + 1, nid, 1))
        stack.append((idx[go_left], depth + 1, nid, 0))
    return feat, thr, left, right, size


def fit_isolation_forest(train: DataFrame, features: list[str], trees: int = C.ISOLATION_TREES,
                         psi: int = C.ISOLATION_ROWS, seed: int = 42) -> pd.DataFrame:
    """Grow ``trees`` isolation trees, each on ``psi`` rows drawn from all rows of
    ``train`` independently of the other trees' (or on all if there are fewer); returns
    the node table (small: trees x < 2 psi rows) as pandas for broadcasting."""
    p = min(1.0, 1.5 * psi / max(train.count(), 1))
    draw = lambda t: F.pmod(F.xxhash64("Donation_ID", t, F.lit("iso")), F.lit(1 << 30))
    # a draw per row and tree: written out they are compiled, a lambda's are not
    mine = F.array_compact(F.array(*[F.when(draw(F.lit(t)) < int(p * (1 << 30)), F.lit(t)) for t in range(trees)]))
    sample = (train.select("Donation_ID", F.explode(mine).alias("tree"), *[F.col(c).cast("double") for c in features])
              .withColumn("_o", draw(F.col("tree"))).drop("Donation_ID"))
    max_depth = int(math.ceil(math.log2(psi)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o").head(psi)
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + t)
        feat, thr, left, right, size = _grow(pdf[features].to_numpy(dtype=float), rng, max_depth)
        return pd.DataFrame({"tree": t, "node": np.arange(len(feat)), "feature": feat, "threshold": thr,
                             "left": left, "right": right, "size": size, "psi": len(pdf)})

    schema = "tree int, node long, feature long, threshold double, left long, right long, size long, psi long"
    return sample.groupBy("tree").applyInPandas(build, schema).toPandas()


#: Rows that walk the trees together; their features stay in a core's cache.
WALKED = 1024


def _flat_tree(nodes: pd.DataFrame, c_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree as (feature, threshold, [right, left] of each node, path length, levels): a
    leaf leads to itself, so that all rows take as many steps as the tree has levels."""
    feat, size = nodes["feature"].to_numpy(), nodes["size"].to_numpy()
    left, right = nodes["left"].to_numpy(), nodes["right"].to_numpy()
    own, leaf, depth = np.arange(len(feat)), feat < 0, np.zeros(len(feat), np.int64)
    for i in own[~leaf]:  # a parent comes before its children
        depth[left[i]] = depth[right[i]] = depth[i] + 1
    child = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], 1).ravel()
    return (np.where(leaf, 0, feat), nodes["threshold"].to_numpy(), child,
            depth + c_table[np.minimum(size, len(c_table) - 1)], int(depth.max()))


def _path_lengths(x: np.ndarray, trees) -> np.ndarray:
    """Summed path lengths of the rows; left when value < threshold."""
    total, flat, first = np.zeros(len(x)), x.ravel(), np.arange(len(x)) * x.shape[1]
    for feat, thr, child, length, levels in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(levels):
            node = child[2 * node + (flat[first + feat[node]] < thr[node])]
        total += length[node]
    return total


def score_isolation_forest(df: DataFrame, nodes: pd.DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Anomaly score 2^(-E[h(x)] / c(psi)) per row (higher = more anomalous)."""
    trees = [g.sort_values("node") for _, g in nodes.groupby("tree")]
    psi = int(nodes["psi"].max()) if len(nodes) else 1
    c_psi = _c(psi)
    c_table = np.array([_c(s) for s in range(0, 2 * psi + 2)])
    packed = [_flat_tree(g, c_table) for g in trees]

    def score(it):
        for pdf in it:
            x = pdf[features].to_numpy(dtype=float)
            depth_sum = np.concatenate([_path_lengths(np.ascontiguousarray(x[i:i + WALKED]), packed)
                                        for i in range(0, max(len(x), 1), WALKED)])
            e_h = depth_sum / max(len(packed), 1)
            out = pdf[keep].copy()
            out["score"] = np.power(2.0, -e_h / c_psi) if c_psi > 0 else 0.5
            yield out

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep) + ", score double"
    return df.select(*keep, *features).mapInPandas(score, schema)


# ---------------------------------------------------------------- tree-path attributions
def forest_node_tables(spark, path: str) -> list[tuple[np.ndarray, ...]]:
    """Node arrays (feature, threshold, left, right, p1) per tree of a saved MLlib
    random forest pipeline, read from the model's own Parquet files (bounded by the
    model's size, not the data); p1 is the node's class-1 share of its weight."""
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/stages/1_*/data").select(
        "treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"),
        n["impurityStats"].alias("stats")).toPandas()
    tables = []
    for _, g in nodes.sort_values(["treeID", "id"]).groupby("treeID"):
        stats = np.array(g["stats"].tolist(), float)
        p1 = stats[:, 1] / np.maximum(stats.sum(1), 1e-300)
        leaf = (g["left"] < 0).to_numpy()
        tables.append((np.where(leaf, -1, g["feature"]).astype(int), np.where(leaf, 0.0, g["threshold"]).astype(float),
                       g["left"].to_numpy(int), g["right"].to_numpy(int), p1))
    return tables


def tree_attributions(df: DataFrame, tables, features: list[str], key: str = "Donation_ID") -> DataFrame:
    """Per row and feature, the summed change of class-1 probability along the
    row's path (left when value <= threshold), averaged over trees, plus a
    ``__bias__`` row (mean root probability): bias + contributions equals the
    forest probability. Long form (key, feature, value)."""
    n_feat = len(features)
    bias = float(np.mean([t[4][0] for t in tables])) if tables else 0.0

    def attribute(it):
        for pdf in it:
            x = pdf[features].to_numpy(dtype=float)
            contrib = np.zeros((len(x), n_feat))
            for feat, thr, left, right, p1 in tables:
                node = np.zeros(len(x), dtype=np.int64)
                active = feat[node] >= 0
                while active.any():
                    rows = np.flatnonzero(active)
                    cur = node[rows]
                    f = feat[cur]
                    nxt = np.where(x[rows, f] <= thr[cur], left[cur], right[cur])
                    np.add.at(contrib, (rows, f), p1[nxt] - p1[cur])
                    node[rows] = nxt
                    active = feat[node] >= 0
            contrib /= max(len(tables), 1)
            keys = np.repeat(pdf[key].to_numpy(), n_feat + 1)
            names = np.tile(np.array(features + ["__bias__"], dtype=object), len(x))
            vals = np.hstack([contrib, np.full((len(x), 1), bias)]).ravel()
            yield pd.DataFrame({key: keys, "feature": names, "value": vals})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, feature string, value double"
    return df.select(key, *features).mapInPandas(attribute, schema)


# ---------------------------------------------------------------- TreeSHAP (path-dependent)
def _leaf_paths(feat, thr, left, right, p1, cover):
    """(features, above, up to, zero fractions, value) of each leaf: a row takes the
    path's branches on a feature if the feature lies in its interval; the zero fraction
    is the share of the cover that does."""
    out, todo = [], [(0, {})]
    while todo:
        at, box = todo.pop()
        if feat[at] < 0:
            f = sorted(box)
            if f and p1[at]:
                out.append((f, *(np.array([box[i][k] for i in f]) for k in range(3)), float(p1[at])))
            continue
        f, t = int(feat[at]), float(thr[at])
        low, high, zero = box.get(f, (-np.inf, np.inf, 1.0))
        for child, side in ((left[at], (low, min(high, t))), (right[at], (max(low, t), high))):
            todo.append((int(child), {**box, f: (*side, zero * cover[child] / cover[at])}))
    return out


def _pattern_values(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Shapley values of the game in which a coalition's value is the product of
    ``one`` over its features and of ``zero`` over the others, for each row of ``one``."""
    m = len(zero)
    size = np.arange(m)
    weight = np.array([math.exp(math.lgamma(s + 1) + math.lgamma(m - s) - math.lgamma(m + 1)) for s in size])
    out = np.empty(one.shape)
    for i in range(m):
        sums = np.zeros((len(one), m))  # by size, over the coalitions of the features so far
        sums[:, 0] = 1.0
        for j in size[size != i]:
            sums[:, 1:], sums[:, 0] = sums[:, 1:] * zero[j] + sums[:, :-1] * one[:, j, None], sums[:, 0] * zero[j]
        out[:, i] = (sums @ weight) * (one[:, i] - zero[i])
    return out


#: Paths with up to so many features have a table of the values of all sets of bits.
TABLED = 9


def _shap_paths(feat, thr, left, right, p1, cover):
    """Per leaf (features, above, up to, zero fractions, value, values of all bit sets)."""
    out = []
    for features, low, high, zero, value in _leaf_paths(feat, thr, left, right, p1, cover):
        m = len(features)
        sets = np.arange(1 << m)[:, None] >> np.arange(m) & 1 if m <= TABLED else None
        table = None if sets is None else np.ascontiguousarray((_pattern_values(zero, sets.astype(float)) * value).T)
        out.append((features, low, high, zero, value, table))
    return out


def tree_shap_batch(x: np.ndarray, feat, thr, left, right, p1, cover, paths=None) -> np.ndarray:
    """Exact path-dependent TreeSHAP values of one tree for all rows of ``x``
    (Lundberg et al.), leaf by leaf: of a path it only matters which of its features
    take the row along (a bit each), so the values are worked out once for each set of
    bits. ``paths`` are the tree's ``_shap_paths``, if at hand. Split rule: left when
    value <= threshold."""
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    for features, low, high, zero, value, table in paths or _shap_paths(feat, thr, left, right, p1, cover):
        bits = np.zeros(len(x), np.int64)
        for k, f in enumerate(features):
            c = columns[f]
            if low[k] > -np.inf:  # not c > low: a missing value goes right, as at the splits
                inside = ~(c <= low[k])
                inside = inside & (c <= high[k]) if high[k] < np.inf else inside
            else:
                inside = c <= high[k]
            bits |= inside.astype(np.int64) << k
        if table is None:
            sets, bits = np.unique(bits, return_inverse=True)
            table = (_pattern_values(zero, (sets[:, None] >> np.arange(len(features)) & 1).astype(float)) * value).T
        for k, f in enumerate(features):
            phi[f] += table[k][bits]
    return phi.T


def forest_shap_tables(rf_model) -> list[tuple[np.ndarray, ...]]:
    """Node arrays (feature, threshold, left, right, p1, cover) per tree; cover
    is the node's training weight."""
    tables = []
    for tree in rf_model.trees:
        feat, thr, left, right, p1, cover = [], [], [], [], [], []
        stack = [(tree._java_obj.rootNode(), -1, 0)]
        while stack:
            node, parent, side = stack.pop()
            nid = len(feat)
            stats = list(node.impurityStats().stats())
            total = float(sum(stats))
            p1.append(stats[1] / total if total > 0 and len(stats) > 1 else 0.0)
            cover.append(total)
            if parent >= 0:
                (left if side == 0 else right)[parent] = nid
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                feat.append(int(split.featureIndex())), thr.append(float(split.threshold()))
                left.append(-1), right.append(-1)
                stack.append((node.rightChild(), nid, 1))
                stack.append((node.leftChild(), nid, 0))
            else:
                feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1)
        tables.append(tuple(np.array(a) for a in (feat, thr, left, right, p1, cover)))
    return tables


def forest_shap(df: DataFrame, tables, features: list[str], key: str = "Donation_ID") -> DataFrame:
    """Exact TreeSHAP of the forest (mean over trees) per row and feature, plus
    ``__bias__`` (the expected value); long form (key, feature, value)."""
    n_feat = len(features)
    bias = float(np.mean([t[4][0] for t in tables])) if tables else 0.0

    def shap(it):
        paths = [_shap_paths(*t) for t in tables]
        for pdf in it:
            x = pdf[features].to_numpy(dtype=float)
            phi = np.zeros((len(x), n_feat))
            for t, p in zip(tables, paths):
                phi += tree_shap_batch(x, *t, p)
            phi /= max(len(tables), 1)
            keys = np.repeat(pdf[key].to_numpy(), n_feat + 1)
            names = np.tile(np.array(features + ["__bias__"], dtype=object), len(x))
            vals = np.hstack([phi, np.full((len(x), 1), bias)]).ravel()
            yield pd.DataFrame({key: keys, "feature": names, "value": vals})

    schema = f"{key} {df.schema[key].dataType.simpleString()}, feature string, value double"
    return df.select(key, *features).mapInPandas(shap, schema)
