import numpy as np
from pyspark.sql import functions as F

from giftrisk.operators import models as M


def node_tables(spark, model, folder):
    model.write().overwrite().save(f"file://{folder}/forest")
    return M.forest_node_tables(spark, f"file://{folder}/forest")


def test_tree_attributions_add_up_to_forest_probability(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        a, b = float(rng.random()), float(rng.random())
        rows.append((str(i), a, b, float(rng.random()), int(a + 0.3 * b > 0.7)))
    df = spark.createDataFrame(rows, "Donation_ID string, f0 double, f1 double, f2 double, Is_Anomalous int")
    feats = ["f0", "f1", "f2"]
    from pyspark.ml import Pipeline as MLPipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    model = MLPipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                               RandomForestClassifier(labelCol="Is_Anomalous", numTrees=8, maxDepth=4, seed=1)]
                       ).fit(df)
    prob = {r["Donation_ID"]: r["score"] for r in
            M.positive_probability(model.transform(df)).select("Donation_ID", "score").collect()}
    att = M.tree_attributions(df, node_tables(spark, model, tmp_path), feats)
    total = {r["Donation_ID"]: r["s"] for r in att.groupBy("Donation_ID").agg(F.sum("value").alias("s")).collect()}
    assert max(abs(total[k] - prob[k]) for k in prob) < 1e-9


def _brute_shapley(x, tables, m):
    """Shapley values of the forest with the path-dependent conditional
    expectation (unknown features follow both branches by cover)."""
    from itertools import combinations
    from math import factorial

    def cond_exp(tbl, node, known):
        feat, thr, left, right, p1, cover = tbl
        if feat[node] < 0:
            return p1[node]
        f = feat[node]
        if f in known:
            return cond_exp(tbl, left[node] if x[f] <= thr[node] else right[node], known)
        lw, rw = cover[left[node]], cover[right[node]]
        return (lw * cond_exp(tbl, left[node], known) + rw * cond_exp(tbl, right[node], known)) / (lw + rw)

    def f(known):
        return np.mean([cond_exp(t, 0, known) for t in tables])

    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for r in range(m):
            for sub in combinations(others, r):
                w = factorial(r) * factorial(m - r - 1) / factorial(m)
                phi[i] += w * (f(set(sub) | {i}) - f(set(sub)))
    return phi


def test_tree_shap_matches_brute_force_and_adds_up(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(500):
        a, b, c = (float(v) for v in rng.random(3))
        rows.append((str(i), a, b, c, int(a * b + 0.2 * c > 0.35)))
    df = spark.createDataFrame(rows, "Donation_ID string, f0 double, f1 double, f2 double, Is_Anomalous int")
    feats = ["f0", "f1", "f2"]
    from pyspark.ml import Pipeline as MLPipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    model = MLPipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"),
                               RandomForestClassifier(labelCol="Is_Anomalous", numTrees=5, maxDepth=4, seed=2)]
                       ).fit(df)
    tables = M.forest_shap_tables(model.stages[-1])
    x = np.array([[r[1], r[2], r[3]] for r in rows[:25]])
    phi = np.mean([M.tree_shap_batch(x, *t) for t in tables], axis=0)
    for i in range(len(x)):
        assert np.allclose(phi[i], _brute_shapley(x[i], tables, 3), atol=1e-9)
    prob = {r["Donation_ID"]: r["score"] for r in
            M.positive_probability(model.transform(df)).select("Donation_ID", "score").collect()}
    shap = M.forest_shap(df, tables, feats)
    total = {r["Donation_ID"]: r["s"] for r in shap.groupBy("Donation_ID").agg(F.sum("value").alias("s")).collect()}
    assert max(abs(total[k] - prob[k]) for k in prob) < 1e-9
