import random

import numpy as np
import xxhash
from helpers import EDGE, edge_frame, empty, plain

from giftrisk.llm import simhash_dedup as S
from giftrisk.llm.components import components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, tau):
    """prints: list of (id or None, fingerprint); component id per row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= tau:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(prints))]


def test_edge_cases(spark):
    got = S.simhash_groups(edge_frame(spark)).collect()
    assert len(got) == len(EDGE)
    prints = [(r[0], brute_print(r[1])) for r in EDGE]
    comp = brute_components(prints, 3)
    want = sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(prints, comp))
    assert sorted((str(r.doc_id), f"{r.fp % 2**64:016x}", str(r.component_id)) for r in got) == want


def test_clusters_of_any_density_match_brute_force(spark):
    rng = random.Random(5)
    for tau in (1, 2, 3, 5):
        prints = []
        for _ in range(12):
            base = rng.getrandbits(64)
            for _ in range(rng.choice([1, 2, 40])):
                x = base
                for _ in range(rng.randint(0, tau + 2)):
                    x ^= 1 << rng.randrange(64)
                prints.append(x)
        prints = sorted(set(prints))
        signed = [x - (1 << 64) * (x >> 63) for x in prints]
        edges = S.links(spark.createDataFrame([(x, 1) for x in signed], "fp long, n long"), tau)
        tree = {r.node: r.root for r in components(edges).collect()}
        comp = brute_components(list(enumerate(prints)), tau)
        groups, want = {}, {}
        for x, c in zip(signed, comp):
            groups.setdefault(tree.get(x, x), []).append(x)
            want.setdefault(c, []).append(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and {got[1000 + i] for i in range(30)} == {1000}


def test_one_of_each_group_stays(spark):
    df = edge_frame(spark)
    kept = S.deduplicate(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids
    assert len(ids) == len(set(ids))


def test_empty_table(spark):
    assert S.simhash_groups(empty(spark)).count() == 0 and S.deduplicate(empty(spark)).count() == 0


def test_exact_copies_are_one_class(spark):
    rows = [(i, "many copies of one and the same text", "en", "s") for i in range(400, 100, -1)]
    got = S.simhash_groups(plain(spark, rows)).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [101]


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 701}" for i in range(5000))
    want = brute_print(text)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert np.int64(S.fingerprint(text.encode())).astype(np.uint64) == want
