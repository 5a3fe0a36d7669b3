import random
from hashlib import sha256

import numpy as np
import pytest
from helpers import EDGE, edge_frame, empty, oracle, plain, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from giftrisk.llm import bwt_dedup as B


def brute(docs, width):
    """{number: (n_removed, n_spans, kept)} of texts in document order."""
    seen, out = set(), {}
    for k, x in enumerate(docs):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            w = x[i:i + width]
            if w in seen:
                gone[i:i + width] = True
            seen.add(w)
        spans = int((gone & ~np.append([False], gone[:-1])).sum()) if len(x) else 0
        out[k] = (int(gone.sum()), spans, bytes(np.frombuffer(x, np.uint8)[~gone]))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(2, 9), st.integers(1, 40))
def test_merged_transforms_are_the_suffix_order(strings, depth, shard):
    parts, held = [], []
    for s in strings:
        held.append(s)
        if sum(map(len, held)) >= shard:
            parts.append(held)
            held = []
    parts += [held] if held else []
    shards, suffixes = [], []
    for p in parts:
        order, before, lf = B.shard_bwt(p)
        shards.append((before, lf, len(p)))
        joined = [(s[i:], (len(parts), k)) for k, s in enumerate(p) for i in range(len(s) + 1)]
        suffixes += [joined[i][0] for i in order]
    now, common = B.merge(shards, depth)
    assert sorted(now) == list(range(len(suffixes)))
    rows = [suffixes[i] for i in now]
    # sorted by the first symbols; an end mark is smaller than any byte
    heads = [[c + 1 for c in r[:depth]] + [0] * (len(r) < depth) for r in rows]
    assert heads == sorted(heads)
    for a, b, c in zip(rows, rows[1:], common[1:]):
        same = next((i for i in range(min(len(a), len(b), depth)) if a[i] != b[i]), min(len(a), len(b), depth))
        assert c == same


def texts_with_repeats(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.choice([2, 5, 8])))
    passages = [" ".join(word() for _ in range(40)) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rnd.choice([0, 3, 30]))) for _ in range(3)]
        for _ in range(rnd.choice([0, 1, 2])):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 2)
            parts.insert(rnd.randrange(3), p[a:a + rnd.choice([60, 120, 200])])
        out.append(" ".join(parts))
    return out + [out[3], out[3], "ha" * 400, "x" * 500, "", out[5] * 2]


def result(df, **how):
    return {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in B.remove_repeats(df, **how).collect()}


@pytest.mark.parametrize("group", [B.GROUP, 1])
def test_matches_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(B, "SHARD_BYTES", 600)
    monkeypatch.setattr(B, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(B, "BATCH_BYTES", 3000)
    texts = texts_with_repeats(1)
    df = plain(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(5)
    assert result(df, group=group) == brute([t.encode() for t in texts], B.WIDTH)


def test_hot_passage(spark):
    """A passage at another place of each of many documents, and very many copies."""
    rnd = random.Random(2)
    hot = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    texts = [f"{i:05d}{''.join(rnd.choice('abcdefgh ') for _ in range(rnd.randrange(30)))}{hot}{i * 7919 % 10007}" for i in range(400)] + ["copy " * 60] * 300
    df = plain(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(6)
    want = brute([t.encode() for t in texts], B.WIDTH)
    assert result(df) == want
    assert result(df, group=50) == want


def test_long_texts_in_pieces(monkeypatch):
    """Windows at the pieces' ends are found once each."""
    rnd = random.Random(4)
    text = bytes(rnd.choice(b"abc ") for _ in range(5000))
    whole = {}
    for a, b, h, _ in zip(*B.anchored_runs(np.frombuffer(text, np.uint8), np.array([len(text)]))):
        whole |= {int(i): int(h) for i in range(a, b + 1)}
    parts = {}
    for at in range(0, len(text) - B.WIDTH + 1, 700):
        piece = text[at:at + 700 + B.WIDTH - 1]
        for a, b, h, _ in zip(*B.anchored_runs(np.frombuffer(piece, np.uint8), np.array([len(piece)]))):
            for i in range(a, b + 1):
                assert parts.setdefault(int(at + i), int(h)) == int(h)
    assert parts == whole and len(whole) == len(text) - B.WIDTH + 1


def test_edge_rows(spark):
    rows = [*EDGE, (30, EDGE[10][1] if len(EDGE[10][1] or "") > 100 else "lorem ipsum " * 30, "en", "s"), (31, "lorem ipsum " * 30, "en", "s")]
    df = edge_frame(spark, rows)
    got = B.remove_repeats(df).toPandas()
    assert len(got) == len(rows)
    assert set(got.loc[got.n_bytes < 100, "n_removed"]) == {0}
    ids = [r for r in rows if r[0] not in (2, 7, None)]  # the SQL is quadratic in a text's length
    df = edge_frame(spark, ids)
    got = B.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).toPandas()
    assert same_rows(got, oracle(B.SQL, documents=df.select("doc_id", "text")))
    assert B.remove_repeats(empty(spark)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    t = "a text that is long enough to be removed when it comes again, " * 2
    df = plain(spark, [(5, t, "en", "s"), (5, t, "en", "s"), (None, t, "en", "s"), (9, t, "en", "s"), (1, t[:110], "en", "s")])
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed, r.n_spans, sha256(r.kept).hexdigest()) for r in B.remove_repeats(df).collect())
    want = {k: v for k, v in zip((1, 5, 9, None), brute([t[:110].encode(), t.encode(), t.encode(), t.encode()], B.WIDTH).values())}
    assert got == sorted((c is None, c, *want[c][:2], sha256(want[c][2]).hexdigest()) for c in (1, 5, 5, 9, None))
