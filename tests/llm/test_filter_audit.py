import random
from itertools import permutations

import pytest
from helpers import EDGE, edge_frame, empty, oracle, plain, same_rows

from giftrisk.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int, rid long"


def labels(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], LABELS)


def brute(counts, names):
    """Each order applied to single documents."""
    docs = [(m, g, t) for m, rows in counts.items() for g, t in rows]
    orders = list(permutations(range(len(names))))
    out, total = {}, {f: 0 for f in range(len(names))}
    for order in orders:
        left = docs
        for i, f in enumerate(order):
            gone = [d for d in left if d[0] >> f & 1]
            left = [d for d in left if not d[0] >> f & 1]
            total[f] += len(gone)
            out["".join(names[x] for x in order), i + 1] = (
                names[f], len(left), len(gone), sum(d[0] >> f & 1 for d in docs) - len(gone), sum(d[0] == 1 << f for d in docs),
                sum(d[1] for d in gone), sum(d[2] for d in gone), f)
    return {k: (*v[:-1], total[v[-1]]) for k, v in out.items()}


@pytest.mark.parametrize("n", [2, 3, 5])
def test_diagram_matches_brute_force(n):
    rnd = random.Random(n)
    for _ in range(5):
        rows = {m: [(rnd.random() < 0.5, rnd.random() < 0.2) for _ in range(rnd.choice([0, 1, 7]))] for m in range(1 << n) if rnd.random() < 0.7}
        rows[0] = [(1, 0)]
        counts = {m: (len(x), sum(g for g, _ in x), sum(t for _, t in x)) for m, x in rows.items()}
        got = {(r[1], r[2]): r[3:] for r in A.audit_part("p", counts, A.FILTERS[:n])}
        assert got == brute(rows, A.FILTERS[:n])


def test_swaps_visit_every_order_and_share_nodes():
    for n in range(2, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in A.swap_chain(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n)))) == len(A.swap_chain(n)) + 1
    assert len(A.Diagram({0: (1, 0, 0)}, 5).nodes) == 9  # the all-zero side once a level


def test_edge_rows_match_sql(spark):
    rows = [*EDGE, (1, "The quick brown fox jumps over the lazy dog and runs away from the quiet house.", "de", "src0"), (20, "", "", "s"),
            (21, "Aa Bb #x " * 300, None, "s"), (22, " ".join(f"w{i}" for i in range(300)), "en", "s")]
    docs = edge_frame(spark, rows)
    marks = labels(spark, [(1, 1, 0), (2, 1, 1), (2, 0, 0), (None, 1, 1), (4, None, 1), (99, 1, 1), (22, 1, 0)])
    got = A.audit(A.failure_masks(docs, marks), A.FILTERS).toPandas()
    assert len(got) == 600 * 3 and got.groupby(["part", "filter_order"]).first().eval("kept + removed").groupby("part").nunique().eq(1).all()
    assert same_rows(got, oracle(A._sql(), documents=docs.select("doc_id", "text", "lang"), labels=marks.select("doc_id", "quality", "toxic")))


def test_hot_text_and_hot_id(spark):
    rows = [(i, "one text of all", "en" if i % 2 else "de", "s") for i in range(3000)] + [(7, "one text of all", "en", "s")] * 2000
    docs, marks = plain(spark, rows), labels(spark, [(7, 1, 1)])
    got = A.audit(A.failure_masks(docs, marks), A.FILTERS).toPandas()
    assert same_rows(got, oracle(A._sql(), documents=docs, labels=marks.select("doc_id", "quality", "toxic")))


def test_empty_tables(spark):
    assert A.audit(A.failure_masks(empty(spark), labels(spark, [])), A.FILTERS).count() == 0
    one = A.audit(A.failure_masks(plain(spark, [(1, None, None, None)]), labels(spark, [])), A.FILTERS).toPandas()
    assert len(one) == 600 and set(one.part) == {""} and one.loc[one["filter"] == "A", "removed"].eq(1).all()
