import corpus_pipeline as P
from helpers import edge_frame
from test_simhash import brute_components, brute_print
from test_sharding import check

import __spark_entry__ as E
from giftrisk.llm import mixing
from giftrisk.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = documents(spark, SF)
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    one = P.language(spark, docs, SF)
    kept = sorted(r.doc_id for r in one.collect())
    assert one.columns == columns and len(kept) >= 0.97 * len(rows)
    two = P.near_duplicates(spark, one, SF)
    prints = [(i, brute_print(rows[i].text)) for i in kept]
    want = sorted(i for (i, _), c in zip(prints, brute_components(prints, 3)) if i == c)
    assert sorted(r.doc_id for r in two.collect()) == want and two.columns == columns
    three = P.decontaminate(spark, two, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [i for i in want if not any(t in rows[i].text for t in items)]
    got = [r.doc_id for r in three.collect()]
    assert set(got) <= set(clean) and len(got) >= len(clean) - 2 and three.columns == columns
    four = P.mix(spark, three, SF)
    copies = {r.doc_id: r.n_copies for r in mixing.mix(three).collect()}
    assert four.columns == columns and four.count() == sum(copies.values())
    last = four.collect()
    check(P.shard(spark, four, SF).collect(), [(r.doc_id, r.text) for r in last], 16)


def test_registered_and_run(spark):
    assert "pipeline" in E.queries()
    assert E.queries()["pipeline"](spark, SF).count() > 0


def test_stages_take_awkward_rows(spark):
    docs = edge_frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.limit(0)):
        now = start
        for _, step in P.STAGES:
            now = step(spark, now, SF)
        assert now.count() >= 0
