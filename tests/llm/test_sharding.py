import zlib
from collections import Counter, defaultdict

from helpers import EDGE, edge_frame, empty, plain
from pyspark.sql import functions as F

from giftrisk.llm import sharding as S


def check(rows, docs, n):
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None for r in rows)
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    return [size[s] for s in range(n)]


def test_edge_cases(spark):
    check(S.shard(edge_frame(spark), 4).collect(), EDGE, 4)
    assert S.shard(empty(spark), 4).count() == 0


def test_even_and_groups_stay_together(spark):
    docs = [(i, f"text number {i} " * (1 + i % 40), "en", "s") for i in range(3000)]
    docs += [(10_000 + i, f"copy {i % 60} " * 12, "en", "s") for i in range(900)]
    rows = S.shard(plain(spark, docs), 8).collect()
    size = check(rows, docs, 8)
    assert max(size) < 1.01 * min(size)
    where = defaultdict(set)
    for r in rows:
        if r.doc_id >= 10_000:
            where[r.doc_id % 60].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 3


def test_a_group_with_a_third_of_all_rows_is_split_evenly(spark):
    docs = [(i, f"text number {i} here", "en", "s") for i in range(2000)] + [(5000 + i, "one and the same", "en", "s") for i in range(1500)]
    rows = S.shard(plain(spark, docs), 8).collect()
    size = check(rows, docs, 8)
    assert max(size) < 1.02 * min(size)
    full = sorted(Counter(r.shard for r in rows if r.doc_id >= 5000).values())
    assert sum(full[-7:]) > 1400  # seven pieces of half a shard each, whole but for what quotas moved


def test_quotas_hold_back_moves():
    share = S._admit({(0, 1): 50.0, (2, 1): 50.0}, [50.0, 60.0, 50.0], 100.0, 3)
    assert 60 + 100 * share[1] <= 100.1 and share[1] > 0.35
    assert S._admit({(0, 1): 40.0, (1, 0): 40.0}, [100.0, 100.0], 100.0, 2) == [1.0, 1.0]


def test_plan_has_no_python(spark):
    plan = S.shard(edge_frame(spark), 4).select(F.col("slot"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_rows_of_one_id_are_dealt_evenly(spark):
    """Half of the table has one id: with one text, with a text each, and with null."""
    rest = [(i, f"text number {i} here", "en", "s") for i in range(2000)]
    for same in ([(7, "one and the same text", "en", "s")] * 2000, [(7, f"a text {i:05d} of its own", "en", "s") for i in range(2000)],
                 [(None, f"a text {i:05d} of its own", "en", "s") for i in range(2000)]):
        rows = S.shard(plain(spark, rest + same), 16).collect()
        size = check(rows, rest + same, 16)
        assert max(size) < 1.02 * min(size), size
