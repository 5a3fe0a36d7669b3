"""Removal of repeated byte strings, with Burrows-Wheeler transforms of shards merged
by interleave refinement (Holt and McMillan, "Merging of multi-string BWTs with
applications", 2014).

Every ``width``-byte string that also starts earlier (smaller doc_id, or earlier in the
same document) is removed where it stands. To find them without one index of the
whole corpus, strings are dealt by an anchor: the smallest hash of the ``K``-byte
pieces inside. Equal strings have equal anchors, so all copies meet.

1. A scan emits, per run of strings with one anchor, a row: the anchor's hash, a digest
   of the run's bytes and where it is. Runs equal within a batch are kept once there,
   so a hot passage leaves a row per batch, not per document.
2. Anchors that occur once are gone. Of runs equal in all bytes, all but the first are
   removed whole. Anchors with different runs go on with their bytes.
3. Runs are dealt by anchor. A task cuts them to the windows whose hash occurs twice
   there, keeps the first of equal pieces, sorts the suffixes of small shards and takes their transforms; then all shards of a block are merged: the interleave of their suffixes
   starts as one shard after the other and is refined by one symbol a round, through
   the transforms alone. A boundary that first shows in round k is a common prefix of
   k - 1 bytes. After ``width`` rounds, neighbours without a boundary are intervals of
   repeated strings; the earliest member stays. Suffixes that a boundary on both sides
   has settled drop out of later rounds.
4. An anchor with more than ``GROUP`` different runs (the edge of a passage that very
   many documents share) is not gathered: its strings are told apart by 128-bit
   hashes of their own, dealt by these hashes, so no task grows with the passage.
5. The removed runs of a document are united and cut from its text.

Digests are 128 bits (anchor and run hashes); everything that is merged is compared by
bytes. Memory: a batch of texts, a block of runs, one document.

Defined cases: null text is empty; a null doc_id comes after all others; rows of one id
with different texts are ordered by a hash of the text; repeated rows (same id and
text) are one document, each with its result; texts under ``width`` bytes keep
everything; very long texts are searched in pieces, linear in their length; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from giftrisk.llm.common import documents, query, stage, texts

WIDTH, K = 100, 20
#: Bytes of texts handled at once (about 150 bytes of memory each; longer texts are
#: taken in pieces), of runs merged at once, and of runs in a shard.
BATCH_BYTES, BLOCK_BYTES, SHARD_BYTES = 1 << 20, 1 << 20, 1 << 16
#: Different runs of an anchor that one task merges.
GROUP = 20_000
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n and more; kept for the next batch."""
    if len(_POWERS.get(base, ())) <= n:
        out = np.full(max(n + 1, BATCH_BYTES + WIDTH + 1), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out)
    return _POWERS[base]


class Rolling:
    """Hashes of any slice of a byte array, from sums of byte * base^-i."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        self.power, inverse = powers(base, n)[:n + 1], powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(data.astype(np.uint64) + np.uint64(base & 0xFFFF)) * inverse[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        # the same for equal bytes: multiplied back to the place 0
        return mix((self.sums[end] - self.sums[start]) * self.power[start])


def anchored_runs(data: np.ndarray, ends: np.ndarray, width: int = WIDTH):
    """Runs of windows with one anchor: (first window, last window, anchor hash,
    digest); no window crosses a document's end."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    roll = Rolling(data, 0x100000001B3)
    at = np.arange(n - K + 1)
    piece = roll.of(at, at + K)
    low = (piece >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)  # ties: the leftmost
    have, want = 1, width - K + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(n - width + 1)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:len(start)]
    ok = np.flatnonzero(start + width <= ends[doc])
    if not len(ok):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    cut = np.flatnonzero((np.diff(anchor[ok]) != 0) | (np.diff(ok) != 1) | (np.diff(doc[ok]) != 0)) + 1
    first, last = ok[np.append([0], cut)], ok[np.append(cut, len(ok)) - 1]
    digest = Rolling(data, 0xD6E8FEB86659FD93).of(first, last + width)
    shape = (anchor[first] - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
    return first, last, piece[anchor[first]], mix(digest + mix(shape * _M))


def united(key: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans joined where they touch or overlap within a key: (key, start, end)."""
    o = np.lexsort((start, key))
    key, start, end = key[o], start[o], end[o]
    top = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end + key.astype(np.int64) * top) if len(key) else end
    new = np.append([True], (key[1:] != key[:-1]) | (start[1:] + key[1:] * top > reach[:-1])) if len(key) else np.empty(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(key)) - 1
    return key[at], start[at], reach[last] - key[at] * top if len(at) else end


def shard_bwt(strings: list[bytes]):
    """Suffixes of the strings (each with an end mark of its own, in order) sorted:
    their places in the joined strings and the symbols before them; 0 is an end mark."""
    m = len(strings)
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    symbol = data + 1
    symbol[ends] = 0
    rank = symbol + m
    rank[ends] = np.arange(m)
    n, k = len(data), 1
    _, rank = np.unique(rank, return_inverse=True)
    while rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:n - k] = rank[k:] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        k *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = np.append([0], symbol[:-1])
    return order, before[order], rank[np.maximum(order - 1, 0)]


def merge(shards: list, depth: int):
    """Interleave of the shards' suffixes, sorted by their first ``depth`` symbols,
    and the boundaries: the length of each suffix's common prefix with the one before
    (``depth``: that or more). ``shards``: (symbols before, rank of the suffix before,
    number of strings), all in the shard's order. Suffixes are numbered through."""
    offset = np.cumsum([0] + [len(b) for b, _, _ in shards])
    symbol = np.concatenate([b for b, _, _ in shards])
    # at most 256 symbols beside the end mark; one byte sorts in one pass
    last = symbol == 0
    symbol = np.maximum(symbol - 1, 0).astype(np.uint8)
    back = np.concatenate([lf + at for (_, lf, _), at in zip(shards, offset)]).astype(np.int32)
    marks = np.concatenate([np.arange(m) + at for (_, _, m), at in zip(shards, offset)]).astype(np.int32)
    n = len(symbol)
    now = np.arange(n, dtype=np.int32)  # one shard after the other
    common = np.full(n + 1, depth, np.int32)
    common[[0, n]] = 0
    # round 1: by the first symbol; end marks are all different
    body = np.flatnonzero(~last).astype(np.int32)
    order = body[np.argsort(symbol[body], kind="stable")]
    head = symbol[order]
    now = np.concatenate([marks, back[order]])
    common[:len(marks) + 1] = 0
    common[len(marks) + 1:n][head[1:] != head[:-1]] = 0
    place = np.empty(n, np.int32)
    place[now] = np.arange(n, dtype=np.int32)
    live = np.arange(n, dtype=np.int32)
    for k in range(1, depth):
        move = now[live]
        body = ~last[move]
        move, block = move[body], np.cumsum(common[live] < depth, dtype=np.int32)[body]
        s = symbol[move]
        order = np.argsort(s, kind="stable")
        to = np.sort(place[back[move]])
        moved = back[move[order]]
        now[to] = moved
        place[moved] = to
        # a boundary between two neighbours shows one round after that of their tails
        s, block = s[order], block[order]
        split = (to[1:] == to[:-1] + 1) & ((s[1:] != s[:-1]) | (block[1:] != block[:-1]))
        new = to[1:][split]
        new = new[common[new] == depth]
        # places whose block had company before this round are looked at once more
        live = live[(common[live] == depth) | (common[live + 1] == depth)]
        common[new] = k
        if not len(live):
            break
    return now, common[:n]


def trimmed(rows: list[tuple], width: int) -> list[tuple]:
    """``rows`` cut to the windows whose hash another window of the block shares; the
    rest can't repeat. Equal bytes are left to the merge."""
    if not rows:
        return []
    data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
    sizes = np.array([len(r[2]) for r in rows])
    starts = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(rows)), sizes - width + 1)
    at = np.arange(len(which)) - np.repeat(np.cumsum(sizes - width + 1) - (sizes - width + 1), sizes - width + 1) + starts[which]
    _, back, count = np.unique(Rolling(data, 0x100000001B3).of(at, at + width), return_inverse=True, return_counts=True)
    kept = np.flatnonzero(count[back] > 1)
    if not len(kept):
        return []
    cut = np.flatnonzero((np.diff(kept) > 1) | (np.diff(which[kept]) > 0)) + 1
    out = []
    for a, b in zip(kept[np.append([0], cut)], kept[np.append(cut, len(kept)) - 1]):
        number, start, part = rows[which[a]]
        low, high = int(at[a] - starts[which[a]]), int(at[b] - starts[which[a]]) + width
        out.append((number, start + low, part[low:high]))
    return out


def block_repeats(rows: list[tuple], width: int = WIDTH):
    """Windows of ``rows`` (document number, start, bytes) that repeat an earlier one:
    (document number, start). Documents are numbered in their order."""
    # cut to what is shared, many strings are equal as a whole: the first one stays for
    # the merge, cut again to what the different ones share
    seen, rest, owners, begins = set(), [], [], []
    for r in sorted(trimmed(rows, width), key=lambda r: r[:2]):
        if r[2] in seen:
            begins.append(np.arange(r[1], r[1] + len(r[2]) - width + 1))
            owners.append(np.full(len(begins[-1]), r[0]))
        else:
            seen.add(r[2])
            rest.append(r)
    rows = trimmed(rest, width)
    if not rows:
        none = [np.empty(0, np.int64)]
        return np.concatenate(owners or none), np.concatenate(begins or none)
    shards, held, size, place = [], [], 0, []
    owner, begin = [], []

    def close():
        nonlocal held, size
        if held:
            order, before, lf = shard_bwt([r[2] for r in held])
            lengths = np.array([len(r[2]) + 1 for r in held])
            starts = np.cumsum(lengths) - lengths
            which = np.repeat(np.arange(len(held)), lengths)
            inside = np.arange(len(which)) - starts[which]
            left = lengths[which] - 1 - inside
            shards.append((before, lf, len(held)))
            owner.append(np.array([r[0] for r in held])[which][order])
            begin.append((np.array([r[1] for r in held])[which] + inside)[order])
            place.append(left[order])
        held, size = [], 0

    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= SHARD_BYTES:
            close()
    close()
    now, common = merge(shards, width)
    owner, begin, left = (np.concatenate(x)[now] for x in (owner, begin, place))
    whole = left >= width
    interval = np.cumsum(common < width)[whole]
    owner, begin = owner[whole], begin[whole]
    o = np.lexsort((begin, owner, interval))
    interval, owner, begin = interval[o], owner[o], begin[o]
    # runs may overlap in a text, so a window can be there twice: that is no repeat
    first = np.append([True], interval[1:] != interval[:-1])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = (owner != owner[lead]) | (begin != begin[lead])
    return np.concatenate([*owners, owner[again]]), np.concatenate([*begins, begin[again]])


RUNS = "hash long, digest long, doc long, tie long, start long, size int, gone boolean"
GONE = "doc long, tie long, start long, size int"


def _batch(columns, schema):
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, names)], [n for n, _ in names])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): the order of documents is that of (doc, tie)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def find_runs(rows: DataFrame, width: int) -> DataFrame:
    def emit(held):
        ids = np.array([(d, t) for d, t, _, _ in held], np.int64).reshape(-1, 2)
        sizes = np.array([len(x) for _, _, _, x in held], np.int64)
        ends = np.cumsum(sizes)
        first, last, anchor, digest = anchored_runs(np.frombuffer(b"".join(x for _, _, _, x in held), np.uint8), ends, width)
        doc = np.searchsorted(ends, first, side="right")
        base = (ends - sizes - np.array([at for _, _, at, _ in held], np.int64))[doc]
        d, t, start = ids[doc, 0], ids[doc, 1], first - base
        size = last - first + width
        h, g = anchor.view(np.int64), digest.view(np.int64)
        # of equal runs in the batch the earliest goes on; the others are gone
        o = np.lexsort((start, t, d, g, h))
        same = np.append([False], (h[o][1:] == h[o][:-1]) & (g[o][1:] == g[o][:-1])) if len(o) else np.empty(0, bool)
        lead = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(o) else o
        alike = same & (d[o] == d[o][lead]) & (t[o] == t[o][lead]) & (start[o] == start[o][lead]) if len(o) else same  # a repeated row
        keep, lose = o[~same], o[same & ~alike]
        yield _batch((h[keep], g[keep], d[keep], t[keep], start[keep], size[keep], np.zeros(len(keep), bool)), RUNS)
        key, a, b = united(doc[lose], start[lose], start[lose] + size[lose])
        # their hash only has to spread them
        spread = mix(ids[key, 1].astype(np.uint64) + a.astype(np.uint64) * _M).view(np.int64)
        for at in range(0, len(key), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield _batch((spread[s], spread[s], ids[key[s], 0], ids[key[s], 1], a[s], np.minimum(b - a, 2**31 - 1)[s], np.ones(len(key[s]), bool)), RUNS)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for d, t, x in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), texts(batch)):
                # a piece has the windows that start in it, so each window is in one
                for at in range(0, len(x) - width + 1, BATCH_BYTES):
                    held.append((d, t, at, x[at:at + BATCH_BYTES + width - 1]))
                    size += len(held[-1][3])
                    if size >= BATCH_BYTES:
                        yield from emit(held)
                        held, size = [], 0
        if held:
            yield from emit(held)

    return rows.mapInArrow(run, RUNS)


def repeated(found: DataFrame, width: int, group: int) -> DataFrame:
    """Runs that are gone, and first ones of anchors that have several (``gone``
    false); ``many`` tells anchors with more than ``group`` of these."""
    by = Window.partitionBy("hash").orderBy("digest", "doc", "tie", "start")
    every = Window.partitionBy("hash")
    before = F.lag(F.struct("digest", "doc", "tie", "start")).over(by)
    marked = found.withColumn("before", before).withColumns({"low": F.min("digest").over(every), "high": F.max("digest").over(every)})
    again = (F.col("before.digest") == F.col("digest")) & ~F.col("gone")
    # a repeated row's run is the same run
    itself = again & (F.col("before.doc") == F.col("doc")) & (F.col("before.tie") == F.col("tie")) & (F.col("before.start") == F.col("start"))
    marked = marked.where(~F.coalesce(itself, F.lit(False))).select(
        "hash", "doc", "tie", "start", "size", (F.col("gone") | F.coalesce(again, F.lit(False))).alias("gone"), (F.col("low") != F.col("high")).alias("several"))
    return marked.where("gone or several")


CUT = "hash long, doc long, tie long, start long, part binary"
SINGLE = "hash long, digest long, doc long, tie long, start long, size int, gone boolean"


def cut(rows: DataFrame, wanted: DataFrame, width: int, single: bool) -> DataFrame:
    """The bytes of wanted runs (hash, doc, tie, start, size); ``single``: instead each
    window of them as a run of its own, by hashes of its bytes."""
    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "size", "hash")).alias("runs"))  # at most a row per byte of the text

    def run(batches):
        for batch in batches:
            for d, t, x, runs in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), texts(batch), batch.column("runs").to_pylist()):
                if single:
                    at = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["size"] - width + 1) for r in runs]))
                    data = np.frombuffer(x, np.uint8)
                    h, g = (Rolling(data, b).of(at, at + width).view(np.int64) for b in (0x100000001B3, 0xD6E8FEB86659FD93))
                    yield _batch((h, g, np.full(len(at), d), np.full(len(at), t), at, np.full(len(at), width), np.zeros(len(at), bool)), SINGLE)
                else:
                    runs = [(r["hash"], d, t, r["start"], x[r["start"]:r["start"] + r["size"]]) for r in runs]
                    yield _batch(tuple(zip(*runs)), CUT)

    once = rows.dropDuplicates(["doc", "tie"])
    return once.join(lists, ["doc", "tie"]).mapInArrow(run, SINGLE if single else CUT)


def merged(parts: DataFrame, width: int) -> DataFrame:
    """Removed runs (doc, tie, start, size) of runs dealt by anchor, from merged
    transforms of blocks of whole anchors."""
    def solve(rows):
        ids = sorted({(d, t) for _, d, t, _, _ in rows})
        number = {x: i for i, x in enumerate(ids)}
        owner, begin = block_repeats([(number[d, t], s, p) for _, d, t, s, p in rows], width)
        key, a, b = united(owner, begin, begin + width)
        return _batch(([ids[k][0] for k in key], [ids[k][1] for k in key], a, b - a), GONE)

    def run(batches):
        held, size, last, alone = [], 0, None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and size >= BLOCK_BYTES:
                    yield solve(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return parts.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, GONE)


def remove_repeats(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Documents with what is left: doc_id, text's bytes, kept (binary), n_removed,
    n_spans."""
    rows = keyed(docs)
    marked = stage(repeated(find_runs(rows, width), width, group), "bwt_marked")
    first = marked.where("not gone")
    many = first.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > group).select("hash")
    few = stage(merged(cut(rows, first.join(many, "hash", "left_anti"), width, False), width), "bwt_merged")
    # the windows of anchors with very many runs: equal ones are runs with equal hashes
    rest = repeated(cut(rows, first.join(many, "hash", "left_semi"), width, True), width, group).where("gone")
    gone = marked.where("gone").select("doc", "tie", "start", "size").union(few).union(rest.select("doc", "tie", "start", "size"))
    spans = gone.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "size")).alias("gone"))
    todo = docs.withColumns({c: f for c, f in zip(("_doc", "_tie"), (F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce("text", F.lit("")))))})
    todo = todo.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("_doc").alias("doc"), F.col("_tie").alias("tie")).join(spans, ["doc", "tie"], "left")

    def run(batches):
        for batch in batches:
            out = []
            for c, x, spans in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("gone").to_pylist()):
                start = np.array([s["start"] for s in spans or ()], np.int64)
                end = start + np.array([s["size"] for s in spans or ()], np.int64)
                _, a, b = united(np.zeros(len(start), np.int64), start, end)
                at, kept = 0, []
                for s, e in zip(a.tolist(), b.tolist()):
                    kept.append(x[at:s])
                    at = e
                kept.append(x[at:])
                out.append((c, len(x), b"".join(kept), int((b - a).sum()), len(a)))
                if len(out) >= 256:
                    yield _batch(tuple(zip(*out)), KEPT)
                    out = []
            if out:
                yield _batch(tuple(zip(*out)), KEPT)

    return todo.select("doc_id", "text", "gone").mapInArrow(run, KEPT)


KEPT = "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long"

SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS m FROM (SELECT rid, doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
g AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY m ORDER BY doc_id NULLS LAST, rid, i) AS k FROM w) WHERE k > 1),
b AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM g),
r AS (SELECT rid, min(i) AS a, max(i) + 100 AS e FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS n FROM b) GROUP BY rid, n),
p AS (SELECT rid, a, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM r),
k AS (SELECT rid, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
      FROM p JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""


@query("op12_merged_bwt", SQL)
def op12(spark, sf_dir):
    left = remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
