import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 30
    assert "Risk_Score" in df.columns and "Fired_Rules" in df.columns
    scores = [r["Risk_Score"] for r in rows]
    assert scores == sorted(scores, reverse=True)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_label_arithmetic(spark):
    """final positives = raw positives - int(.12 pos) + int(.005 neg)."""
    from giftrisk.plans.pipeline import Pipeline
    p = Pipeline.get(spark, E.SMOKE_DIR)
    p.labeled()
    s = p.label_stats
    pos = p.labeled().where("Is_Anomalous = 1").count()
    assert pos == s["n_pos"] - int(s["n_pos"] * 0.12) + int(s["n_neg"] * 0.005)
