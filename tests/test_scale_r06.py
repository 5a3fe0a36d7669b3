"""Steps of the round: late rows of many batches, models fitted on all rows."""

import gc
import inspect
from collections import defaultdict
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators import models as M
from giftrisk.plans import pipeline as PL
from giftrisk.plans import q_models as QM
from giftrisk.plans import q_stream2 as QS
from giftrisk.streaming import detectors as S

SMOKE = "/root/testdata/sf0.001"


def test_late_data_report_where_the_session_keeps_few_progress_records(spark, tmp_path):
    from giftrisk.sources.events import payment_events
    keep = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(keep)
    spark.conf.set(keep, "3")
    try:
        rep = S.late_data_report(payment_events(spark, SMOKE), str(tmp_path), files=12).collect()
        assert spark.conf.get(keep) == "3"
    finally:
        spark.conf.set(keep, before)
    assert sum(r["input_rows"] for r in rep) == payment_events(spark, SMOKE).count()
    assert [r["batch_id"] for r in rep] == list(range(len(rep))) and len(rep) >= 12


def labelled(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(C.MODEL_FEATURES))).round(3)
    rows = [(f"D{i}", int(v[0] + 0.3 * v[1] > 1.0), *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "Donation_ID string, Is_Anomalous int, " + ", ".join(f"{c} double" for c in C.MODEL_FEATURES))


def test_no_fit_of_a_query_has_a_bound_on_its_rows():
    bound = inspect.signature(M.fit_rows).parameters["max_rows"]
    assert bound.default is inspect.Parameter.empty and not hasattr(C, "MAX_FIT_ROWS")
    for module in (M, PL, QM, QS):
        assert "fit_rows(" not in inspect.getsource(module).replace("def fit_rows(", "")


def test_attributions_are_of_a_model_fitted_on_all_rows(spark, monkeypatch):
    rows, seen, fit = labelled(spark, 60), [], M.fit_logistic
    train = spark.range(60_000).select(F.concat(F.lit("T"), "id").alias("k")).crossJoin(F.broadcast(rows.limit(1).drop("Donation_ID"))).withColumnRenamed("k", "Donation_ID")
    monkeypatch.setattr(QM, "_train_test", lambda *a: (train, rows))
    monkeypatch.setattr(M, "fit_logistic", lambda tr, *a: (seen.append(tr.count()), fit(rows))[1])
    assert QS.linear_attribution(spark, "none").count() == 60 * len(C.MODEL_FEATURES)
    assert seen == [60_000]


def test_folds_are_dealt_in_ranges_as_one_window_deals_them(spark, monkeypatch):
    from pyspark.sql import Window
    rows = spark.range(4000).select(F.concat(F.lit("D"), "id").alias("Donation_ID"), (F.col("id") % 7 == 0).cast("int").alias("Is_Anomalous"))
    w = Window.partitionBy("Is_Anomalous").orderBy(F.xxhash64("Donation_ID", F.lit("fold")), "Donation_ID")
    want = {r.Donation_ID: r.f for r in rows.select("Donation_ID", ((F.row_number().over(w) - 1) % 5).alias("f")).collect()}
    cut, ranges = M.windows._cut, []

    def spy(df, key, order, _):
        ranges.append(cut(df, key, order, 9))
        return ranges[0]
    monkeypatch.setattr(M.windows, "_cut", spy)
    got = M.stratified_folds(rows, 5)
    assert got.columns == ["Donation_ID", "Is_Anomalous", "_fold"]
    assert {r.Donation_ID: r._fold for r in got.collect()} == want
    assert max(r["count"] for r in ranges[0].groupBy("_b").count().collect()) < 1500


def test_a_forest_grown_in_parts_has_all_trees(spark, monkeypatch, tmp_path):
    rows = labelled(spark, 400)
    monkeypatch.setattr(M, "BAGGED_BYTES", 400 * M.BAGGED * 5)
    model = M.fit_random_forest(rows, trees=12, depth=4)
    rf = model.stages[-1]
    assert rf.getNumTrees == 12 and len({t.toDebugString for t in rf.trees}) == 12
    model.write().overwrite().save(f"file://{tmp_path}/forest")
    again = PipelineModel.load(f"file://{tmp_path}/forest")
    assert again.stages[-1].getNumTrees == 12 and len(M.forest_node_tables(spark, f"file://{tmp_path}/forest")) == 12
    score = lambda m: {r.Donation_ID: r.score for r in M.positive_probability(m.transform(rows)).collect()}
    one, two = score(model), score(again)
    assert one == two
    # the whole forest votes with the mean of its trees
    tables = M.forest_node_tables(spark, f"file://{tmp_path}/forest")
    att = M.tree_attributions(rows, tables, list(C.MODEL_FEATURES)).groupBy("Donation_ID").agg(F.sum("value").alias("s"))
    assert all(abs(r.s - one[r.Donation_ID]) < 1e-9 for r in att.collect())
    right = sum((one[r.Donation_ID] > 0.5) == r.Is_Anomalous for r in rows.collect())
    assert right > 340 and abs(sum(rf.featureImportances.toArray()) - 1) < 1e-9


def test_isolation_trees_draw_from_all_rows_as_before(spark, monkeypatch):
    rows = labelled(spark, 3000)
    draw = lambda t: F.pmod(F.xxhash64("Donation_ID", t, F.lit("iso")), F.lit(1 << 30))
    limit = int(1.5 * 64 / 3000 * (1 << 30))
    mine = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda t: draw(t) < limit)
    per = {r.tree: min(64, r["count"]) for r in rows.select(F.explode(mine).alias("tree")).groupBy("tree").count().collect()}
    nodes = M.fit_isolation_forest(rows, list(C.MODEL_FEATURES), trees=10, psi=64)
    assert dict(nodes[nodes.node == 0].set_index("tree")["psi"]) == per


def test_scores_of_one_model_are_the_rows_of_all_models(spark, monkeypatch):
    """Repeated keys too: the three score tables are joined by key."""
    p = PL.Pipeline(spark, SMOKE)
    split = PL.Pipeline.get(spark, SMOKE).model_split()
    test = split.where("is_test = 1")
    p._model_split = split.union(test.limit(3)).localCheckpoint()
    fits = []

    def scores(m):
        fits.append(m)
        cols = {"RF": ["Is_Anomalous", F.lit(0.1).alias("RF_Score")], "LR": [F.lit(0.2).alias("LR_Score")],
                "IF": [F.lit(0.3).alias("IF_Score"), F.lit(1).alias("IF_Flag")]}[m]
        return p._model_split.where("is_test = 1").select("Donation_ID", *cols)
    monkeypatch.setattr(p, "model_scores", scores)
    few = {m: p.risk_scores(m) for m in ("RF", "LR", "IF")}
    assert fits == ["RF", "LR", "IF"]
    whole = p.risk_scores()
    assert whole.columns == ["Donation_ID", "Is_Anomalous", "RF_Score", "LR_Score", "IF_Score", "IF_Flag"]
    assert whole.count() == test.count() + 3 * 7
    for df in few.values():
        same = whole.select(*df.columns)
        assert len(df.columns) < 6 and df.exceptAll(same).count() == 0 and same.exceptAll(df).count() == 0


def test_stream_screen_needs_neither_draws_nor_anchors(spark, monkeypatch):
    p = PL.Pipeline(spark, SMOKE)
    monkeypatch.setattr(QS, "P", lambda *a: p)
    monkeypatch.setattr(p, "anchors", lambda: 1 / 0)
    got = QS.stream_screen(spark, SMOKE)
    q = PL.Pipeline.get(spark, SMOKE)
    q.donations()
    monkeypatch.setattr(QS, "P", lambda *a: q)
    want = QS.stream_screen(spark, SMOKE)
    assert got.dtypes == want.dtypes and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "donations" not in p.paths and "donor_names" in p.paths


def test_blocks_of_words_leave_nothing_for_the_collector(monkeypatch):
    """A task cuts many blocks; a block's dictionary goes when it is written."""
    from giftrisk.llm import lattice_lm as L

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run
    monkeypatch.setattr(L, "F", MagicMock())
    monkeypatch.setattr(L, "stage", lambda run, name: run)
    monkeypatch.setattr(L, "BLOCK_BYTES", 100)
    run = L.corpus_blocks(Docs())
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([f"one two three w{i} one " * 5 for i in range(50)])], ["doc_id", "text"])
    held = lambda: sum(type(o) is defaultdict and "one" in map(bytes.decode, filter(lambda k: isinstance(k, bytes), o)) for o in gc.get_objects())
    gc.collect()
    gc.disable()
    try:
        blocks = list(run([batch]))
        assert len(blocks) > 10 and held() == 0
    finally:
        gc.enable()
    words = blocks[0].column("words")[0].as_py()
    assert words == ["one", "two", "three", "w0"] and blocks[0].column("pair_count")[0].as_py() == [10, 5, 5, 5]
