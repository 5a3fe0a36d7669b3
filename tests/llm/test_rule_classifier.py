import math

from helpers import EDGE, edge_frame, empty
from pyspark.sql import functions as F

from giftrisk.llm import rule_classifier as R


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = R.score(docs.join(lab.select("doc_id"), "doc_id", "left_semi"), lab).join(lab, "doc_id").where("held_out")
    right = out.agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.97
    assert 0 < out.first().n_rules < 200


def test_rules_of_a_printed_tree_and_their_columns(spark):
    tree = "\n".join(["x", "  If (feature 0 <= 1.5)", "   If (feature 0 <= 0.5)", "    Predict: 0.0", "   Else (feature 0 > 0.5)", "    Predict: 1.0",
                      "  Else (feature 0 > 1.5)", "   If (feature 2 <= 0.25)", "    Predict: 1.0", "   Else (feature 2 > 0.25)", "    Predict: 0.0"])
    rules = R.paths(tree)
    assert rules == {((0, None, 1.5),), ((0, None, 0.5),), ((0, 0.5, 1.5),), ((0, 1.5, None),), ((0, 1.5, None), (2, None, 0.25)), ((0, 1.5, None), (2, 0.25, None))}
    row = [0.0] * len(R.STATISTICS)
    row[0], row[2] = 2.0, 0.2
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{s} double" for s in R.STATISTICS))
    got = df.select(R.compile_score(0.5, [(1.0, ((0, 1.5, None), (2, None, 0.25))), (9.0, ((0, None, 1.5),))])).first()[0]
    assert abs(got - 1 / (1 + math.exp(-1.5))) < 1e-12


def test_edge_cases(spark):
    df = edge_frame(spark).drop("score")
    for rows in ([], [(1, 1, 0)], [(1, 1, 0), (1, 0, 0), (10, 0, None), (11, None, 0), (None, 1, 0), (7, 1, 0), (11, 0, 0), (6, 1, 1)]):
        got = R.score(df, labels(spark, rows)).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert R.score(empty(spark).drop("score"), labels(spark, [(1, 1, 0)])).count() == 0
    assert R.score(df, labels(spark, [])).first().score == 0.5
