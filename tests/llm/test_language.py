import numpy as np
import pandas as pd
from helpers import EDGE, edge_frame, empty, plain
from pyspark.sql import functions as F

from giftrisk.llm import language_id as L


def brute_viterbi(score, penalty):
    paths = {k: (score[0][k], [k]) for k in range(len(score[0]))}
    for row in score[1:]:
        paths = {k: max(((s + row[k] - (penalty if p[-1] != k else 0), p + [k]) for s, p in paths.values()), key=lambda x: x[0]) for k in range(len(row))}
    return max(paths.values(), key=lambda x: x[0])


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(3)
    sizes = [1, 7, 0, 30, 7]
    doc = np.repeat(np.arange(5), sizes)
    score = rng.normal(size=(len(doc), 3)).astype(np.float32) * 3
    lang = L.viterbi(score, np.arange(len(doc)), doc, 5, 2.5)
    for d in range(5):
        own = score[doc == d].astype(float)
        if len(own):
            path = lang[doc == d].tolist()
            value = own[np.arange(len(own)), path].sum() - 2.5 * sum(a != b for a, b in zip(path, path[1:]))
            assert abs(value - brute_viterbi(own.tolist(), 2.5)[0]) < 1e-3


def test_held_out_accuracy_and_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs)
    r = out.where(L.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert r > 0.99
    model = L.learn(docs)
    text = {r.lang: " ".join(r.text.split()[:40]) for r in docs.where("length(text) > 1000").collect()}
    mixed = plain(spark, [(1, f"{text['de']} {text['fr']} {text['en']}", None, None)])
    spans = L.language_spans(mixed, model).first().spans
    assert [s.lang for s in spans] == ["de", "fr", "en"]
    assert all(abs(s.first_word - 40 * i) <= 1 for i, s in enumerate(spans))


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, t, lang, "s") for i in (0, 1, 3, 4, 5) for lang, t in (("ru", "привет мир это текст"), ("el", "γεια σου κόσμε"), ("en", "hello wide world"))]
    got = {r.doc_id: r for r in L.language_spans(plain(spark, [(1, "это мир", None, None), (2, "κόσμε 123", None, None), (3, "日本", None, None),
                                                              (4, "!!! 12", None, None)]), L.learn(plain(spark, rows))).collect()}
    assert got[1].lang_pred == "ru" and got[2].lang_pred == "el" and got[4].lang_pred == "und" and got[4].score == 0
    assert got[3].lang_pred in ("el", "en", "ru") and got[3].score == 0


def test_edge_cases(spark):
    df = edge_frame(spark).withColumns({"spans": F.lit("own"), "lang_pred": F.lit(1)})
    got = L.identify(df).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None}
    assert by[3] == by[4] == by[5] == by[10] == "und" and by[1] == "en"
    assert all(0 <= r.score <= 1 for r in got)
    kept = L.accepted(df)
    assert kept.schema == df.schema and not {3, 4, 5, 10} & {r.doc_id for r in kept.collect()}
    assert kept.exceptAll(df).count() == 0 and kept.count() == sum(r.lang_pred != "und" and r.score >= 0.3 for r in got) > 0
    assert L.identify(empty(spark)).count() == L.accepted(empty(spark)).count() == 0
    none = L.identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_junk_is_rejected_at_any_corpus_size(spark):
    """The same junk under a model of few texts and one of a corpus 10,000 times as large
    in which noise has put something in every bucket."""
    held = [r.text.encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").orderBy("doc_id").collect()]
    w = L.Words(held[:100])
    n = np.bincount(w.bucket, np.bincount(w.code, minlength=w.n_forms)[w.form], 1 << L.HASH_BITS)
    script = pd.DataFrame({"lang": "en", "bucket": [-1 - 1], "n": [int(n.sum())]})

    def model(n):
        return L.Model(pd.concat([pd.DataFrame({"lang": "en", "bucket": np.flatnonzero(n), "n": n[n > 0]}), script]), 0.01)

    rng = np.random.default_rng(1)
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(300)).encode()]
    small, large = model(n), model(10_000 * n + rng.poisson(0.02 * 10_000 * n.sum() / len(n), len(n)))
    scores = [[x for _, _, x in L.predict(m, junk + held[100:104], 12.0)] for m in (small, large)]
    assert all(s[0] < 0.3 and min(s[1:]) > 0.8 for s in scores), scores
    assert abs(scores[0][0] - scores[1][0]) < 0.02
