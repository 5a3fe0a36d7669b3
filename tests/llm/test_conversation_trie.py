import random
import zlib
from hashlib import sha256

import pandas as pd
import pytest
from helpers import oracle
from pyspark.sql import functions as F

from giftrisk.llm import conversation_trie as T

SCHEMA = "conv_id long, turn int, role string, text string, n long, d long, hi long, x long, own_hi long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def trie(df):
    return T.prefix_trie(*T.regrouped(T.numbered(df)))


def brute(rows):
    """Nodes of the rebuilt conversations by plain prefixes."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    at = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            at.setdefault(ts[:d], []).append(c)
    kids = {}
    for p in at:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, who in at.items():
        below = [q for q in at if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(p))))
        out.append((min(who), len(p), min(at[p[:-1]]) if p else None, len(who), len(kids.get(p, [])), sum(q not in kids for q in below),
                    sum((len(at[q]) - 1) * len(q[-1][1].encode()) for q in below if q), sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def check(spark, rows):
    df = table(spark, rows)
    got = rows_of(trie(df))
    assert got == sorted(brute(rows))
    want = oracle(T.SQL, conversations=df.select("conv_id", "turn", "role", "text"))
    assert got == sorted(tuple(None if pd.isna(v) else v for v in r) for r in want[COLUMNS].itertuples(index=False))


def test_random_conversations(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "bot"]), rnd.choice(["a", "bé"])) for c in range(60) for t in range(rnd.choice([1, 2, 3, 9, 12]))]
    check(spark, rows)


def test_awkward_rows(spark):
    long = "".join(chr(97 + i % 26) for i in range(200_000))
    check(spark, [(1, 0, "user", "x"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "bot", "x"), (2, 0, "user", long), (2, 1, "user", ""),
                  (None, 0, "user", "lost"), (None, None, None, None), (5, 0, None, ""), (7, 3, "user", "y"), (7, 3, "user", "x"),
                  (10, 0, "s", "t"), (11, 0, "s", "t"), (12, 0, "s", "t"), (13, 0, "s", "t"), (1000000007, 5, "s", None), (0, 0, "", "")])


def test_one_conversation_and_none(spark):
    check(spark, [(3, 0, "user", "hello"), (3, 1, "bot", "you")])
    assert trie(table(spark, [])).count() == 0
    assert trie(table(spark, [(None, 1, "a", "b")])).count() == 0


def test_hot_conversation_and_long_one(spark):
    """A third of all conversations alike, one of many turns that shares its start."""
    same = [(c, t, "user", f"t{t}") for c in range(0, 400) for t in range(5)]
    own = [(c, t, "user", f"t{t}" if t < 3 else f"c{c}") for c in range(1000, 1060) for t in range(6)]
    long = [(5000, t, "user", f"t{t}") for t in range(600)] + [(5005, t, "user", f"t{t}") for t in range(300)]
    rows = same + own + long
    got = rows_of(trie(table(spark, rows)))
    want = oracle(T.SQL, conversations=table(spark, rows).select("conv_id", "turn", "role", "text"))
    assert got == sorted(tuple(None if pd.isna(v) else v for v in r) for r in want[COLUMNS].itertuples(index=False))


def test_running_totals_span_tasks(spark):
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("i"), (F.col("id") * 31 % 17).alias("v"), F.xxhash64("id").alias("w"))
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = T.running(rows, "k", ["i"], ["v"], ["w"], [], "t")
        found = sorted((r.i, r.v, r.w, r.v_run, r.w_run) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    total = mark = 0
    for _, v, w, v_run, w_run in found:
        total, mark = total + v, mark ^ w
        assert (v_run, w_run) == (total, mark)


@pytest.mark.parametrize("a,b,want", [(0, 1, 1), (0, 7, 4), (4, 7, 6), (5, 7, 6), (6, 7, 7), (3, 9, 8), (8, 15, 12)])
def test_fattest(spark, a, b, want):
    row = spark.range(1).select(T.fattest(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("f")).first()
    assert row.f == want == max(range(a + 1, b + 1), key=lambda x: x & -x)
