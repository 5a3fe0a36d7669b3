"""Steps that were too slow on larger tables: what they read and write, and their results."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators import labels as L
from giftrisk.operators import models as M
from giftrisk.plans.pipeline import Pipeline
from giftrisk.streaming import detectors as S

SMOKE, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_large_generated_methods_are_compiled_and_no_stage_is_written_twice(spark):
    p = Pipeline(spark, SMOKE)
    Pipeline.get(spark, SMOKE)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    wide = L.assign_labels(L.add_noise(p.scored(), {}))
    got = p.labeled()
    assert got.columns == wide.columns
    assert got.exceptAll(wide).count() == 0 and wide.exceptAll(got).count() == 0


def test_fit_rows_of_many_parts_come_in_a_few(spark):
    rows = spark.range(0, 4000, 1, 300).select(F.col("id").cast("string").alias("Donation_ID"), F.lit(1).alias("x"))
    few = M.fit_rows(rows, 2000)
    assert 0 < few.count() < 3000 and few.rdd.getNumPartitions() <= M.FIT_PARTITIONS
    assert M.fit_rows(rows, 4000).count() == 4000


def test_isolation_scores_equal_a_walk_row_by_row(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 4)).round(1)
    x[7, 2] = np.nan
    trees = []
    for t in range(5):
        feat, thr, left, right, size = M._grow(x[:64][~np.isnan(x[:64]).any(1)], np.random.default_rng(t), 6)
        trees.append(pd.DataFrame({"tree": t, "node": np.arange(len(feat)), "feature": feat, "threshold": thr,
                                   "left": left, "right": right, "size": size, "psi": 64}))
    names = ["a", "b", "c", "d"]
    frame = spark.createDataFrame([(str(i), *map(float, v)) for i, v in enumerate(x)], "Donation_ID string, a double, b double, c double, d double")
    got = {q.Donation_ID: q.score for q in M.score_isolation_forest(frame, pd.concat(trees), names, ["Donation_ID"]).collect()}
    for i in (0, 7, 1023, 1024, 1499):
        total = 0.0
        for g in trees:
            at, depth = 0, 0
            while g.feature[at] >= 0:
                at, depth = (g.left if x[i, g.feature[at]] < g.threshold[at] else g.right)[at], depth + 1
            total += depth + M._c(g["size"][at])
        assert abs(got[str(i)] - 2 ** (-total / 5 / M._c(64))) < 1e-12
    assert len(got) == 1500


def test_shap_of_a_long_path_with_repeated_features_adds_up():
    """A chain of splits over more features than are tabled, and one twice."""
    n = M.TABLED + 3
    feat, thr = [i % (n - 1) for i in range(n)], [0.5 - i / 100 for i in range(n)]
    feat, thr = feat + [-1] * (n + 1), thr + [0.0] * (n + 1)
    left = [n + i for i in range(n)] + [-1] * (n + 1)
    right = [i + 1 for i in range(n - 1)] + [2 * n] + [-1] * (n + 1)
    cover = np.array([2.0 ** (n - i) for i in range(n)] + [2.0 ** (n - i - 1) for i in range(n)] + [1.0])
    p1 = np.array([0.0] * n + [((3 * i) % 7) / 7 for i in range(n + 1)])
    for i in reversed(range(n)):
        p1[i] = (cover[left[i]] * p1[left[i]] + cover[right[i]] * p1[right[i]]) / cover[i]
    tree = tuple(map(np.array, (feat, thr, left, right, p1, cover)))
    x = np.random.default_rng(0).random((50, n))
    x[0, 0] = np.nan
    phi = M.tree_shap_batch(x, *tree)
    for row, v in zip(x, phi):
        at = 0
        while tree[0][at] >= 0:
            at = left[at] if row[tree[0][at]] <= thr[at] else right[at]
        assert abs(p1[0] + v.sum() - p1[at]) < 1e-9


def test_first_reversals_by_buckets_of_donors(spark, tmp_path):
    """400 donors share a slot: a donor's reversal answers
    no one else's authorisation; events without a donor stay apart."""
    rows = []
    for d in range(400):
        rows += [(3 * d, 60 + d % 7, d, "purchase"), (3 * d + 1, 70 + d % 11, d, "error" if d % 2 else "view")]
    kinds = {v: k for k, v in C.EVENT_TO_WEBHOOK.items()}
    auth, rev = kinds["payment.authorised"], kinds["payment.reversed"]
    data = [(i, t, d, auth if k == "purchase" else rev if k == "error" else "other") for i, t, d, k in rows]
    data += [(5000, 10, None, auth), (5001, 20, 0, rev)]
    frame = spark.createDataFrame(data, "event_id long, s long, user_id long, event_type string")
    frame.selectExpr("event_id", "cast(timestamp_seconds(s) as timestamp_ntz) as ts", "user_id", "event_type", "1.0D as value",
                     "'{}' as props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = S.merge_first_reversals(S.run_to_table(S.first_reversals(S.event_stream(spark, str(tmp_path))), "few")).collect()
    want = sorted((3 * d, d, 10 + d % 11 - d % 7) for d in range(1, 400, 2) if 70 + d % 11 >= 60 + d % 7)
    assert sorted((r.auth_id, r.donor_id, (r.rev_us - r.auth_us) // 1_000_000) for r in out) == want


def test_late_data_report_keeps_state_in_few_partitions(spark, tmp_path):
    from giftrisk.sources.events import payment_events
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rep = S.late_data_report(payment_events(spark, SMOKE), str(tmp_path), files=2).collect()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(r["input_rows"] for r in rep) == payment_events(spark, SMOKE).count()
    assert len(list((tmp_path / "chk" / "state" / "0").glob("[0-9]*"))) <= S.REPORT_PARTITIONS


def test_stream_screen_gives_every_donation_of_a_name_its_hits(spark):
    from giftrisk.plans.q_screen import entities
    from giftrisk.plans.q_stream2 import stream_screen
    from giftrisk.operators import screening as SC
    d = Pipeline.get(spark, SMALL).donations().select("Donation_ID", F.col("Donor_Name").alias("name")).where("name is not null")
    e = entities(spark, SMALL).select("entity_id", SC.normalise_name(F.col("name")).alias("ne"))
    pairs = d.withColumn("na", SC.normalise_name(F.col("name"))).where("na != ''").crossJoin(e.where("ne != ''"))
    want = pairs.where(SC.similarity("na", "ne") >= 0.75).select("Donation_ID", "entity_id")
    got = stream_screen(spark, SMALL).select("Donation_ID", "entity_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() > 0
