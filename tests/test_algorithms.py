"""Property tests of the scale-oriented operators against brute force."""
import random

import numpy as np
from pyspark.sql import functions as F

from giftrisk.operators import evaluate as EV
from giftrisk.operators import screening as SC
from giftrisk.operators import windows as WN


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_ap_exact_with_ties(spark):
    rnd = random.Random(3)
    rows = [(round(rnd.random(), 1), int(rnd.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    m = EV.summary_metrics(df, "s", "y").first()
    assert abs(m["roc_auc"] - _auc_brute(*zip(*rows))) < 1e-12
    neg = df.select((-F.col("s")).alias("s"), "y")
    assert abs(EV.summary_metrics(neg, "s", "y").first()["roc_auc"] - (1 - m["roc_auc"])) < 1e-12
    # AP = sum over positives-by-threshold of precision * recall increment
    srt = sorted(rows, key=lambda r: -r[0])
    P = sum(y for _, y in rows)
    ap, tp, fp = 0.0, 0, 0
    for t in sorted({s for s, _ in rows}, reverse=True):
        at = [y for s, y in srt if s == t]
        tp += sum(at)
        fp += len(at) - sum(at)
        ap += sum(at) / P * tp / (tp + fp)
    assert abs(m["average_precision"] - ap) < 1e-12


def test_running_totals_bucketed_equals_single_window(spark):
    rows = [(random.Random(i).randint(0, 2), i * 7 % 101, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    small = WN.running_totals(df, ["k"], "t", "v", tiebreak="v", ranges=7)
    got = {(r["k"], r["v"]): (r["hist_n"], r["hist_sum"]) for r in small.collect()}
    for k, t, v in rows:
        before = [(t2, v2) for k2, t2, v2 in rows if k2 == k and (t2, v2) < (t, v)]
        assert got[(k, v)] == (len(before), float(sum(v2 for _, v2 in before)))


def test_range_sums_and_next_event_equal_brute_force_under_a_hot_key(spark):
    """A key with most of the rows: every range holds about the same number."""
    rnd = random.Random(5)
    rows = [(0 if i % 3 else rnd.randint(1, 40), rnd.randint(0, 900), i) for i in range(600)] + [(None, 5, 600), (None, 6, 601)]
    df = spark.createDataFrame(rows, "k int, t long, i long")
    got = {r["i"]: (r["n"], r["s"]) for r in WN.range_sums(df, ["k"], "t", 60, {"n": F.lit(1), "s": F.col("i")}, ranges=9).collect()}
    nxt = {r["i"]: r["e"] for r in WN.next_event(df, ["k"], "t", F.col("i") % 5 == 0, "e", ranges=9).collect()}
    for k, t, i in rows:
        frame = [i2 for k2, t2, i2 in rows if k2 == k and t - 60 <= t2 <= t]
        assert got[i] == (len(frame), sum(frame))
        assert nxt[i] == min((t2 for k2, t2, i2 in rows if k2 == k and t2 >= t and i2 % 5 == 0), default=None)
    sizes = [r["count"] for r in WN._cut(df, ["k"], ["t"], 9).groupBy("_b").count().collect()]
    assert max(sizes) < 3 * len(rows) / 9


def _lev(a, b):
    d = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, cb in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (ca != cb))
    return d[len(b)]


def test_fuzzy_blocking_loses_no_pair(spark):
    rnd = random.Random(11)
    alpha = "abcdefghij "
    names = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(3, 12))).strip() or "x" for _ in range(150)]
    ents = [n[:-1] if i % 3 == 0 else n[::-1] if i % 3 == 1 else n + "k" for i, n in enumerate(names[:60])]
    ndf = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "name_id string, name string")
    edf = spark.createDataFrame([(f"E{i}", n, "SDN", "individual", ["X"], "") for i, n in enumerate(ents)],
                                "entity_id string, name string, list_name string, entity_type string, "
                                "programs array<string>, remarks string")
    hits = SC.fuzzy_hits(ndf, edf, 0.75, limit=1000)
    got = {(r["name_id"], r["entity_id"]) for r in hits.collect()}
    norm = lambda s: " ".join(s.split())
    want = set()
    for i, n in enumerate(names):
        for j, e in enumerate(ents):
            a, b = norm(n), norm(e)
            if a and b and 1 - _lev(a, b) / max(len(a), len(b)) >= 0.75:
                want.add((str(i), f"E{j}"))
    assert got == want


def test_blank_name_is_invalid_not_blocked(spark):
    ndf = spark.createDataFrame([("1", "  "), ("2", "Kim Jong Un")], "name_id string, name string")
    edf = spark.createDataFrame([("E1", "kim jong un", "SDN", "individual", ["DPRK"], "")],
                                "entity_id string, name string, list_name string, entity_type string, "
                                "programs array<string>, remarks string")
    st = {r["name_id"]: r["status"] for r in SC.screening_status(ndf, SC.fuzzy_hits(ndf, edf)).collect()}
    assert st == {"1": "INVALID", "2": "BLOCKED"}
    demo = {r["name_id"] for r in SC.demo_substring_hits(ndf).collect()}
    assert demo == {"2"}


def test_threshold_sweep_matches_direct_counts(spark):
    rnd = np.random.default_rng(2)
    rows = [(float(s), int(y)) for s, y in zip(np.round(rnd.random(300), 2), rnd.random(300) < 0.3)]
    df = spark.createDataFrame(rows, "s double, y int")
    sw = {round(r["threshold"], 2): (r["tp"], r["fp"]) for r in EV.threshold_sweep(df, "s", "y").collect()}
    for k in range(10, 91):
        t = k / 100.0
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        assert sw[round(t, 2)] == (tp, fp)


def test_prefix_filter_loses_no_pair_under_edits(spark):
    rnd = random.Random(23)
    alpha = "abcdeilnorst "

    def edit(s):
        ops = rnd.randint(0, 3)
        s = list(s)
        for _ in range(ops):
            k = rnd.randrange(max(len(s), 1))
            op = rnd.choice("sidt")
            if op == "s" and s:
                s[k] = rnd.choice(alpha)
            elif op == "i":
                s.insert(k, rnd.choice(alpha))
            elif op == "d" and len(s) > 1:
                del s[k]
            elif op == "t" and k + 1 < len(s):
                s[k], s[k + 1] = s[k + 1], s[k]
        return "".join(s)

    base = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(3, 25))) for _ in range(60)]
    names = [edit(b) for b in base for _ in range(4)]
    ents = [edit(b) for b in base for _ in range(2)]
    ndf = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "name_id string, name string")
    edf = spark.createDataFrame([(f"E{i}", n, "SDN", "individual", ["X"], "") for i, n in enumerate(ents)],
                                "entity_id string, name string, list_name string, entity_type string, "
                                "programs array<string>, remarks string")
    got = {(r["name_id"], r["entity_id"]) for r in SC.fuzzy_hits(ndf, edf, 0.75, limit=10000).collect()}
    norm = lambda s: " ".join(s.split())
    want = set()
    for i, n in enumerate(names):
        for j, e in enumerate(ents):
            a, b = norm(n), norm(e)
            if a and b and 1 - _lev(a, b) / max(len(a), len(b)) >= 0.75:
                want.add((str(i), f"E{j}"))
    assert len(want) > 100
    assert got == want
