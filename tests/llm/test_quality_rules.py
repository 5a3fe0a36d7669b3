import numpy as np
from helpers import EDGE, edge_frame, empty, oracle, plain, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from giftrisk.llm import quality_rules as Q


def brute(words, least):
    """Covered positions, longest repeat and maximal repeats of at least ``least``."""
    n, where = len(words), {}
    for i in range(n):
        for j in range(i + least, n + 1):
            where.setdefault(tuple(words[i:j]), []).append(i)
    repeats = {s: at for s, at in where.items() if len(at) > 1}
    covered = {p for s, at in repeats.items() for i in at for p in range(i, i + len(s))}
    end = lambda i: words[i] if 0 <= i < n else ("end", i)
    maximal = [s for s, at in repeats.items() if len({end(i - 1) for i in at}) > 1 and len({end(i + len(s)) for i in at}) > 1]
    return covered, max(map(len, repeats), default=0), len(maximal)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.integers(2, 5))
def test_suffix_array_repeats_match_brute_force(docs, least):
    word = np.array([w for d in docs for w in d], dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    mask, longest, count = Q.block_repeats(word, doc, len(docs), least)
    for k, d in enumerate(docs):
        covered, top, n = brute(d, least)
        assert set(np.flatnonzero(mask[doc == k])) == covered
        assert (longest[k], count[k]) == (top, n)


def test_edge_cases_match_sql(spark):
    df = edge_frame(spark)
    got = Q.judge(Q.repetition_stats(df, min_words=3)).drop("n_maximal_repeats").toPandas()
    assert len(got) == len(EDGE)
    want = oracle(Q.SQL, documents=df.select("doc_id", "text"))
    assert same_rows(got, want)
    assert not got[got.doc_id == 11].kept.any()


def test_empty_table(spark):
    assert Q.judge(Q.repetition_stats(empty(spark))).count() == 0


def test_blocks_do_not_change_results(spark, monkeypatch):
    df = edge_frame(spark)
    want = Q.repetition_stats(df).toPandas()
    monkeypatch.setattr(Q, "BLOCK_WORDS", 1)
    assert same_rows(Q.repetition_stats(df).toPandas(), want)


def test_short_phrases_decide_beyond_the_base_rule(spark, tmp_path):
    """Repeats under 8 words: the base rule passes them, the verdict does not."""
    fresh = [f"w{i}" for i in range(60)]
    phrases = [w for i in range(15) for w in ("buy", "cheap", "pills", "now", f"x{i}")]
    some = [w for i in range(4) for w in ("as", "we", "said", f"y{i}")] + fresh
    texts = [" ".join(phrases), " ".join("spam" if i % 9 else f"z{i}" for i in range(90)), " ".join(some), " ".join(fresh)]
    plain(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.op2(spark, str(tmp_path)).collect()}
    assert [got[i].kept for i in range(4)] == [False, False, True, True]
    assert not got[0].base_failed and got[0].n_repeat_words == 0
    assert same_rows(Q.op2(spark, str(tmp_path)).toPandas(), oracle(Q.SQL, documents=spark.read.parquet(f"{tmp_path}/documents.parquet")))
    for i, t in enumerate(texts):
        words = t.split()
        covered, longest, _ = brute(words, 3)
        assert got[i].covered_chars == sum(len(words[p]) for p in covered) and got[i].longest_repeat == longest
