"""Steps of the round: fired terms as bits, two draws a conversion, ranges of scores."""

from pyspark.sql import functions as F

from giftrisk.functions import draws as D
from giftrisk.operators import evaluate as EV
from giftrisk.operators import labels as L
from giftrisk.operators import rules as RU
from giftrisk.plans import pipeline as PL

SMOKE = "/root/testdata/sf0.001"


def test_draws_read_in_pairs_are_the_draws(spark):
    rows = spark.createDataFrame([("1",), ("",), ("donor 77",), (None,)], "k string").union(spark.range(500).select(F.col("id").cast("string")))
    keys = {"order": F.col("k"), "cust": F.concat(F.lit("c"), F.col("k"))}
    h = rows.withColumns(D.hash_columns(keys))
    pairs = h.withColumns(D.pair_columns())
    got = pairs.select(*[D.draw_of_pairs(n).alias(n) for n in D.DRAWS]).collect()
    assert got == h.select(*[D.draw_column(n).alias(n) for n in D.DRAWS]).collect()
    edge = spark.createDataFrame([("f" * 32,), ("0" * 32,), ("8" + "0" * 31,), ("7" + "f" * 31,)], "h string")
    for slot in range(4):
        a, b = D.uniform_from_pair(D.pair_from_hex(F.col("h"), slot // 2), slot), D.uniform_from_hex(F.col("h"), slot)
        assert edge.where(~a.eqNullSafe(b)).count() == 0


def test_labels_keep_the_fired_terms_as_bits(spark, monkeypatch):
    stored, write = {}, PL.write_stage

    def spy(df, name, *a):
        stored[name] = df.columns
        return write(df, name, *a)
    monkeypatch.setattr(PL, "write_stage", spy)
    p = PL.Pipeline(spark, SMOKE)
    got = p.labeled()
    # neither features nor rule groups nor the list of terms are written
    assert not {"Log_Donation_Amount", "Is_Night_Donation", "R1_10", "Rule_Score", "Fired_Terms"} & set(stored["labeled"])
    assert len(stored["labeled"]) < len(p.donations().columns) + 10
    want = L.assign_labels(L.add_noise(p.scored(), {}))
    assert got.dtypes == want.dtypes
    key = lambda r: r.Donation_ID
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_bits_of_rows_without_values(spark):
    p = PL.Pipeline.get(spark, SMOKE)
    some = p.donations().limit(40)
    nulls = some.select(*[F.lit(None).cast(t).alias(c) if c in ("Donation_Amount", "Donation_Time", "Is_Anonymous", "CVV_Check") else F.col(c)
                          for c, t in some.dtypes]).localCheckpoint()
    rows = some.localCheckpoint().union(nulls)
    want = RU.score_rules(rows, p.anchors())
    got = RU.rule_columns(RU.fire_rules(rows, p.anchors()), rows.columns, [])
    assert got.dtypes == want.dtypes
    key = lambda r: (r.Donation_ID, r.Donation_Amount is None)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_scores_are_ordered_in_ranges_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(EV, "RANGE_SCORES", 50)
    df = spark.range(1000).select((F.col("id") / 1000).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    ranges, write = [], EV.write_stage

    def spy(x, name):
        out = write(x, name)
        if name == "score_ranges":
            ranges.extend(r["count"] for r in out.groupBy("_b").count().collect())
        return out
    monkeypatch.setattr(EV, "write_stage", spy)
    c = EV.running_totals(EV.score_counts(df, "s", "y"), [])
    rows = {r.score: (r.cum_tp, r.cum_fp, r.P, r.N) for r in c.collect()}
    assert max(ranges) <= 150 and len(ranges) > 10
    assert rows == {i / 1000: (sum(1 for k in range(i, 1000) if k % 3 == 0), sum(1 for k in range(i, 1000) if k % 3), 334, 666) for i in range(1000)}
    # the totals are what is sent to all tasks, never the scores
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
