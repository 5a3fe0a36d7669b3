"""The tuple index of names against all pairs: low cuts of the edit distance, Jaro-Winkler."""
import random

import pytest
from pyspark.sql import functions as F

from giftrisk.operators import screening as SC


def _names():
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(n))
    base = [word(n) for n in (1, 2, 3, 3, 4, 5)] + [f"{word(rnd.randint(3, 7))} {word(rnd.randint(3, 9))}" for _ in range(60)]
    base += [" ".join(word(7) for _ in range(k)) for k in (5, 5, 6, 10)] + ["aaaa", "aaaaaaaa", "ab", "ba"]
    changed = []
    for b in base:
        x = list(b)
        for _ in range(rnd.randint(0, max(1, len(x) // 2))):
            i = rnd.randrange(len(x))
            x[i:i + 1] = rnd.choice(["", rnd.choice("abcdefgh"), x[i] + "s", x[i]])
            x = x or ["q"]
        changed.append("".join(x))
    clean = lambda names: sorted({" ".join(n.split()) for n in names} - {""})
    return clean(base), clean(changed)


def _frames(spark):
    left, right = _names()
    return (spark.createDataFrame([(n,) for n in left], "na string"), spark.createDataFrame([(n,) for n in right], "ne string"))


@pytest.mark.parametrize("cut", [0.5, 0.6, 0.74])
def test_low_cuts_lose_no_pair(spark, cut):
    a, e = _frames(spark)
    got = {(r.na, r.ne): r.match_score for r in SC.similar_names(a, e, cut).collect()}
    want = {(r.na, r.ne): r.s for r in a.crossJoin(e).withColumn("s", SC.similarity("na", "ne")).where(F.col("s") >= cut).collect()}
    assert got == want and len(want) > 30
    assert any(len(x) > SC.LONG for x, _ in want) and any(len(x) < 4 for x, _ in want)


@pytest.mark.parametrize("cut", [0.82, 0.9])
def test_jaro_winkler_loses_no_pair(spark, cut):
    left, right = _names()
    names = spark.createDataFrame([(n, n) for n in left], "name_id string, name string")
    ents = spark.createDataFrame([(n, n, "L") for n in right], "entity_id string, name string, list_name string")
    got = {(r.name_id, r.entity_id) for r in SC.jaro_winkler_hits(names, ents, cut, limit=10_000).collect()}
    want = {(x, y) for x in left for y in right if SC._jaro_winkler(x, y) >= cut}
    assert got == want and len(want) > 20


def test_candidates_are_few(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    a, e = (spark.createDataFrame([(f"{word(6)} {word(8)}",) for _ in range(n)], f"{c} string") for c, n in (("na", 400), ("ne", 300)))
    assert SC.segment_pairs(a, e, 0.74).count() < 0.01 * 400 * 300
    assert SC.segment_pairs(a, e, 0.6).count() < 0.06 * 400 * 300
