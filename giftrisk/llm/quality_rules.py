"""Quality rules from word-level suffix arrays.

For every document a suffix array over its words gives the longest-common-prefix
(LCP) intervals. An interval whose suffixes are not all preceded by the same word
is a maximal repeated substring. The rules bound the share of the text's
characters inside the union of these repeats and the length of the longest one.

Only repeats of at least ``min_words`` words count, and every window of such a
repeat occurs twice, so words outside repeated windows are left out before the
suffix array is built (they can't be part of one). Windows are found exactly, by
rank doubling on (document, word) numbers; nothing is hashed.

Documents are independent: one pass, no shuffle. Memory is that of one block of
documents (about ``BLOCK_WORDS`` words, or one document if that is longer).

Defined cases: a null or blank text has no words (all counts 0) and fails the
base rule; repeated rows are judged one by one; a null ``doc_id`` is carried;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import BLANKS, documents, query, texts

#: Words held by one suffix array.
BLOCK_WORDS = 400_000
SYMBOLS = b"#*$%&|<>"

STATS_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                "n_repeat_words long, covered_chars long, longest_repeat long, n_maximal_repeats long")


def dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each tuple of keys (equal tuples share one) and the ranks' sizes."""
    key = keys[0]
    for k in keys[1:]:
        key = key * (int(k.max(initial=0)) + 2) + (k + 1)
    _, rank, size = np.unique(key, return_inverse=True, return_counts=True)
    return rank, size


def repeated_windows(word: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """True where a window of ``width`` words starts that its document has twice."""
    n = len(word)
    rank, size = dense(doc, word)
    alive = size[rank] > 1
    have = 1
    while have < width:
        step = min(have, width - have)  # windows of have + step words overlap two of have
        at = np.flatnonzero(alive[: n - step] & alive[step:] & (doc[: n - step] == doc[step:])) if n > step else np.empty(0, int)
        new = np.full(n, -1)
        alive = np.zeros(n, bool)
        if len(at):
            r, size = dense(rank[at], rank[at + step])
            new[at] = r
            alive[at] = size[r] > 1
        rank, have = new, have + step
    return alive


def spans_to_mask(start: np.ndarray, length, n: int) -> np.ndarray:
    """True for positions covered by any span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) > 0


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``s`` and the LCP of each suffix with its predecessor, by
    prefix doubling; the ranks of every doubling give the LCPs by descent."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    levels, k = [rank], 1
    while rank.max() < n - 1:
        after = np.full(n, -1)
        after[: n - k] = rank[k:] if k < n else after[: n - k]
        rank, _ = dense(rank, after)
        levels.append(rank)
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n, np.int64)
    for level in range(len(levels) - 2, -1, -1):
        r = np.append(levels[level], [-1])
        ra, rb = r[np.minimum(a, n)], r[np.minimum(b, n)]
        step = np.where((ra == rb) & (ra >= 0), 1 << level, 0)
        a += step
        b += step
        lcp[1:] += step
    return sa, lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the LCP intervals of at least ``least``."""
    out, stack = [], []  # of (length, first)
    values = lcp.tolist()
    for i in np.flatnonzero((lcp >= least) | (np.append([0], lcp[:-1]) >= least)).tolist() + [len(values)]:
        v = values[i] if i < len(values) else 0
        first = i - 1
        while stack and stack[-1][0] > v:
            length, first = stack.pop()
            out.append((length, first, i - 1))
        if v >= least and (not stack or stack[-1][0] < v):
            stack.append((v, first))
    return out


def block_repeats(word: np.ndarray, doc: np.ndarray, n_docs: int, least: int):
    """For a block of documents: mask of words in repeats; per document the
    longest maximal repeat and the number of maximal repeats."""
    n = len(word)
    longest, count = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    starts = np.flatnonzero(repeated_windows(word, doc, least)) if n >= least else np.empty(0, int)
    if not len(starts):
        return np.zeros(n, bool), longest, count
    kept = spans_to_mask(starts, least, n)
    at = np.flatnonzero(kept)
    # the repeated stretches, each followed by an end mark of its own
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) > 0)) + 1
    ids, _ = dense(doc[at], word[at])
    ends = np.append(cut, len(at))
    s = np.insert(ids, ends, ids.max() + 1 + np.arange(len(ends)))
    place = np.insert(at, ends, -1)
    sa, lcp = suffix_array(s)
    own = np.maximum(lcp, np.append(lcp[1:], 0))  # the longest repeat that starts at each suffix
    hit = own >= least
    mask = spans_to_mask(place[sa[hit]], own[hit], n)
    before = np.append([-1], s[:-1])[sa]
    changes = np.cumsum(np.append([0], before[1:] != before[:-1]))
    for length, lo, hi in lcp_intervals(lcp, least):
        if changes[hi] > changes[lo]:
            d = doc[place[sa[lo]]]
            count[d] += 1
            longest[d] = max(longest[d], length)
    return mask, longest, count


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _block(ids: list, docs: list[bytes], min_words: int, window: int) -> dict:
    words = [t.split() for t in docs]
    sizes = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [x for w in words for x in w]
    word, uniques = pd.factorize(flat)
    chars = np.array([len(x.decode("utf-8", "replace")) for x in uniques], np.int64)[word] if len(word) else np.empty(0, np.int64)
    mask, longest, count = block_repeats(word, doc, len(docs), min_words)
    rep = mask if window == min_words else (
        spans_to_mask(np.flatnonzero(repeated_windows(word, doc, window)), window, len(word)))
    per_doc = lambda x: np.bincount(doc, x, len(docs)).astype(np.int64)
    return {"doc_id": ids, "n_words": sizes, "word_chars": per_doc(chars),
            "n_symbols": [sum(t.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))) for t in docs],
            "n_dup_lines": [dup_lines(t) for t in docs], "n_repeat_words": per_doc(rep),
            "covered_chars": per_doc(chars * mask), "longest_repeat": longest, "n_maximal_repeats": count}


def repetition_stats(docs: DataFrame, min_words: int = 8, window: int = 8) -> DataFrame:
    """One row per document: base counts, and from the suffix array the characters
    inside maximal repeats of at least ``min_words`` words, the longest such repeat
    (words) and their number."""
    def run(batches):
        names = [x.split()[0] for x in STATS_SCHEMA.split(", ")]

        def out(ids, held):
            cols = _block(ids, held, min_words, window)
            return pa.RecordBatch.from_arrays([pa.array(cols[c], pa.int64()) for c in names], names)

        for batch in batches:
            ids, held, size = [], [], 0
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids.append(i)
                held.append(t or b"")
                size += len(held[-1]) // 5
                if size >= BLOCK_WORDS:
                    yield out(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield out(ids, held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, STATS_SCHEMA)


def judge(stats: DataFrame, max_covered: float = 0.4, max_longest: int = 60) -> DataFrame:
    """Adds base_failed and kept: a document stays if the base rule passes, at most
    ``max_covered`` of its word characters lie in repeats, and no repeat is longer
    than ``max_longest`` words."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    ok = (F.col("covered_chars") <= F.lit(max_covered) * F.col("word_chars")) & (F.col("longest_repeat") <= max_longest)
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ok)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win8 AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k
         FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup8 AS (SELECT rid, i, k FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM win8) WHERE c > 1),
words8 AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup8) GROUP BY rid),
win AS (SELECT rid, i, array_to_string(ws[i:i + 2], ' ') AS k
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT rid, i, k FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM dup)),
covered AS (SELECT rid, sum(length(ws[p])) AS ch FROM cov JOIN w USING (rid) GROUP BY rid),
pairs AS (SELECT a.rid, a.i, b.i - a.i AS gap FROM dup a JOIN dup b ON a.rid = b.rid AND a.k = b.k AND a.i < b.i),
runs AS (SELECT rid, gap, count(*) + 2 AS len FROM
         (SELECT rid, gap, i - row_number() OVER (PARTITION BY rid, gap ORDER BY i) AS g FROM pairs) GROUP BY rid, gap, g),
longest AS (SELECT rid, max(len) AS m FROM runs GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM
          (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
s AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
             coalesce(words8.n, 0) AS n_repeat_words, CAST(coalesce(covered.ch, 0) AS BIGINT) AS covered_chars,
             coalesce(longest.m, 0) AS longest_repeat
      FROM w LEFT JOIN words8 USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN longest USING (rid) LEFT JOIN lines USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND covered_chars <= 0.4 * word_chars AND longest_repeat <= 60 AS kept
FROM s
"""


@query("op2_suffix_repetition", SQL)
def op2(spark, sf_dir):
    """The verdict looks at repeats of 3 words or more; the base counts keep the
    window of 8."""
    return judge(repetition_stats(documents(spark, sf_dir), min_words=3)).drop("n_maximal_repeats")


@query("op2_phrase_repetition", SQL)
def op2_phrases(spark, sf_dir):
    """The name that this verdict had while ``op2_suffix_repetition`` looked at repeats
    of 8 words."""
    return op2(spark, sf_dir)
