"""Language identification of mixed-language text.

The letters of a word choose its script by code point ranges; only languages that
were seen in that script are candidates. Each candidate scores the word: the sum,
over its letters, of the log probability of the letter with its two neighbours in
that language (learned from labelled documents; anything but letters is a boundary).
A Viterbi pass over the words, with a penalty for switching the language, labels
spans. The document's language is the one whose spans hold most letters.

Learning counts all labelled documents: each task sums its counts, one aggregate adds
them up, and the model is languages * 2 ** HASH_BITS numbers (0.5 MB a language),
which is what the broadcast holds at any corpus size. Prediction is one pass without
a shuffle; documents of a block advance through Viterbi together, word by word.

Defined cases: null text, or one without a letter: ``und``, score 0, no spans; a word
in a script that no language was learned in says nothing about the language; no
labelled documents: ``und`` everywhere; ties go to the first language by name; a null
doc_id counts as the text '' for the split; repeated rows are predicted one by one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftrisk.llm.common import documents, query, texts

HASH_BITS = 17
#: Words held by one block.
BLOCK_WORDS = 1_000_000
#: Frequency given to letter triples a language never had.
FLOOR = 1e-6
#: Share of a language's letters whose contexts count as known.
KNOWN = 0.8

# Code point ranges of scripts (first, last).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + its script's number (the
    last number: other scripts)."""
    table = np.zeros(0x110000, np.uint8)
    other = len(SCRIPTS) + 1
    for c in range(0x30000):
        if chr(c).isalpha():
            table[c] = other
    for i, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            part = table[lo:hi + 1]
            part[part > 0] = i + 1
    return table


class Words:
    """The words of a block of texts that have a letter, and what their distinct
    forms are made of."""

    def __init__(self, block: list[bytes]):
        split = [t.split() for t in block]
        sizes = [len(w) for w in split]
        flat = np.empty(sum(sizes), object)
        flat[:] = [x for w in split for x in w]
        code, uniques = pd.factorize(flat)
        joined = b"\n".join(uniques).decode("utf-8", "replace").lower()
        cp = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "replace"), np.uint32)
        kind = letters()[cp]
        cp = np.where(kind > 0, cp, 0).astype(np.uint64)
        form = np.cumsum(np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "replace"), np.uint32) == 10) - 1
        at = np.flatnonzero(kind)
        triple = (cp[at - 1] * np.uint64(0x9E3779B97F4A7C15) + cp[at] * np.uint64(0xC2B2AE3D27D4EB4F)
                  + cp[at + 1] * np.uint64(0x165667B19E3779F9))
        triple ^= triple >> np.uint64(31)
        triple *= np.uint64(0xBF58476D1CE4E5B9)
        self.form = form[at]  # of each letter
        self.bucket = (triple >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        self.script = kind[at].astype(np.int64)
        self.n_forms = len(uniques)
        self.n_letters = np.bincount(self.form, minlength=self.n_forms)
        place = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.empty(0, int)
        doc = np.repeat(np.arange(len(block)), sizes)
        keep = self.n_letters[code] > 0 if len(code) else np.empty(0, bool)
        self.code, self.doc, self.place = code[keep], doc[keep], place[keep]
        self.n_docs = len(block)


def blocks(batches, *columns):
    """Texts in blocks of about BLOCK_WORDS words, with the values of other columns."""
    for batch in batches:
        rest = [batch.column(c).to_pylist() for c in columns]
        held, size, first = [], 0, 0
        for i, t in enumerate(texts(batch)):
            held.append(t or b"")
            size += len(held[-1]) // 5
            if size >= BLOCK_WORDS:
                yield held, [r[first:i + 1] for r in rest]
                held, size, first = [], 0, i + 1
        if held:
            yield held, [r[first:] for r in rest]


def known_contexts(n: np.ndarray) -> np.ndarray:
    """Weight of each bucket of a language: 0, or for the most frequent ones that hold
    KNOWN of its letters (and are above the mean of all buckets) one over the share they
    hold, so that a text like the corpus has weight 1 a letter. These shares converge as
    the corpus grows; whether a bucket was ever seen does not."""
    total = n.sum()
    if not total:
        return np.zeros(len(n))
    down = np.sort(n)[::-1]
    cut = down[np.searchsorted(np.cumsum(down), KNOWN * total)]
    known = (n >= cut) & (n > total / len(n))
    return known / max(n[known].sum() / total, KNOWN / 2)


class Model:
    """langs; per language and bucket the log probability; which languages were seen
    in which script; the weight of each (bucket, language) in the score."""

    def __init__(self, counts: pd.DataFrame, min_script_share: float):
        self.langs = sorted(set(counts.lang))
        index = {x: i for i, x in enumerate(self.langs)}
        table = np.zeros((1 << HASH_BITS, len(self.langs)), np.float64)
        scripts = np.zeros((len(SCRIPTS) + 2, len(self.langs)), np.float64)
        lang = counts.lang.map(index).to_numpy(int)
        bucket, n = counts.bucket.to_numpy(), counts.n.to_numpy(float)
        triple = bucket >= 0
        table[bucket[triple], lang[triple]] = n[triple]
        scripts[-1 - bucket[~triple], lang[~triple]] = n[~triple]
        self.known = np.zeros((1 << HASH_BITS, len(self.langs)), np.float32)
        for j in range(len(self.langs)):
            self.known[:, j] = known_contexts(table[:, j])
        self.logp = np.log(table / np.maximum(table.sum(0), 1) + FLOOR).astype(np.float32)
        self.candidate = scripts >= min_script_share * np.maximum(scripts.sum(0), 1)

    def score(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each form and language the log score and the letters in known contexts, weighted."""
        k = len(self.langs)
        score, known = np.zeros((w.n_forms, k), np.float32), np.zeros((w.n_forms, k), np.float32)
        scripts = np.zeros((w.n_forms, len(SCRIPTS) + 2), np.int32)
        np.add.at(scripts, (w.form, w.script), 1)
        main = scripts.argmax(1)
        ok = self.candidate[main]
        open_ = ok.any(1)
        for j in range(k):
            score[:, j] = np.bincount(w.form, self.logp[w.bucket, j], w.n_forms)
            known[:, j] = np.bincount(w.form, self.known[w.bucket, j], w.n_forms)
        score[~ok & open_[:, None]] = -1e6
        score[~open_] = 0
        return score, known


def viterbi(score: np.ndarray, code: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """Best language of each word; the documents advance together."""
    n, k = len(code), score.shape[1]
    size = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-size, kind="stable")
    start = (np.cumsum(size) - size)[order]
    active = len(order) - np.searchsorted(size[order][::-1], np.arange(size.max(initial=0)), side="right")
    back = np.zeros((n, k), np.int16 if k > 127 else np.int8)
    v = np.zeros((n_docs, k), np.float32)
    own = np.arange(k)
    for t, a in enumerate(active.tolist()):
        at, now = start[:a] + t, v[:a]
        if t:
            best = now.argmax(1)
            turn = now[np.arange(a), best] - np.float32(penalty)
            stay = now >= turn[:, None]
            back[at] = np.where(stay, own, best[:, None])
            now = np.where(stay, now, turn[:, None])
        now = now + score[code[at]]
        v[:a] = now - now.max(1, keepdims=True)
    lang = np.zeros(n, np.int64)
    cur = v.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        lang[at] = cur[:a]
        cur[:a] = back[at, cur[:a]]
    return lang


def held_out(docs_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(docs_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def learn(labelled: DataFrame, min_script_share: float = 0.01) -> Model:
    """Model of ``labelled(lang, text)``; all rows count."""
    def run(batches):
        total: dict = {}
        for held, (langs,) in blocks(batches, "lang"):
            w = Words(held)
            lang_of, names = pd.factorize(np.array(langs, object))
            for j, name in enumerate(names):
                weight = np.bincount(w.code[lang_of[w.doc] == j], minlength=w.n_forms).astype(float)[w.form]
                triples, scripts = total.setdefault(name, (np.zeros(1 << HASH_BITS), np.zeros(len(SCRIPTS) + 2)))
                triples += np.bincount(w.bucket, weight, 1 << HASH_BITS)
                scripts += np.bincount(w.script, weight, len(SCRIPTS) + 2)
        for name, (triples, scripts) in total.items():
            at, of = np.flatnonzero(triples), np.flatnonzero(scripts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + len(of))), pa.array(np.append(at, -1 - of), pa.int32()),
                 pa.array(np.append(triples[at], scripts[of]).astype(np.int64))], ["lang", "bucket", "n"])

    counts = (labelled.where("lang is not null and text is not null").select("lang", "text")
              .mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    return Model(counts.toPandas(), min_script_share)


#: What the result adds to a document; columns of these names give way to it.
ADDED = ("spans", "lang_pred", "score")
SPANS = "array<struct<lang:string,first_word:int,end_word:int,letters:long>>"


def language_spans(docs: DataFrame, model: Model, penalty: float = 12.0, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``spans``, ``lang_pred``
    and ``score``: the share of the text's letters that lie in lang_pred's spans and have
    a context frequent in that language, over the share such contexts have in its corpus."""
    columns = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("text", *ADDED)]
    with_text = keep is None or "text" in keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns, *(["text"] if with_text else [])).schema
    schema = schema.add("spans", T.DataType.fromDDL(SPANS)).add("lang_pred", "string").add("score", "double")
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("letters", pa.int64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            spans, langs, scores = [], [], []
            for held, _ in blocks([batch]):
                for s, lang, x in predict(m, held, penalty):
                    spans.append(s), langs.append(lang), scores.append(x)
            arrays = [batch.column(c) for c in columns] + ([batch.column("text")] if with_text else [])
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, kind), pa.array(langs), pa.array(scores)], schema.names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def predict(m: Model, held: list[bytes], penalty: float):
    """(spans, language, score) of each text."""
    w = Words(held)
    n, k = w.n_docs, len(m.langs)
    if not k or not len(w.code):
        return [([], "und", 0.0)] * n
    score, known = m.score(w)
    lang = viterbi(score, w.code, w.doc, n, penalty)
    count = w.n_letters[w.code]
    share = np.bincount(w.doc * k + lang, count, n * k).reshape(n, k)
    seen = np.bincount(w.doc * k + lang, known[w.code, lang], n * k).reshape(n, k)
    best, total = share.argmax(1), share.sum(1)
    first = np.flatnonzero(np.append([True], (np.diff(lang) != 0) | (np.diff(w.doc) != 0)))
    end = np.append(first[1:], len(lang)) - 1
    size = np.add.reduceat(count, first)
    spans: list = [[] for _ in range(n)]
    for d, x, a, b, s in zip(w.doc[first].tolist(), lang[first].tolist(), w.place[first].tolist(), w.place[end].tolist(), size.tolist()):
        spans[d].append({"lang": m.langs[x], "first_word": a, "end_word": b + 1, "letters": s})
    return [(spans[d], m.langs[best[d]], min(1.0, float(seen[d, best[d]] / total[d]))) if total[d] else ([], "und", 0.0) for d in range(n)]


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn from the labelled documents outside the held-out quarter, then predict all."""
    return language_spans(docs, learn(docs.where(~held_out(F.col("doc_id")))), keep=keep)


def accepted(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Documents with a language whose score is at least ``min_score``, with all their
    columns, also those that have names of the prediction's."""
    name = {c: c if c in ("doc_id", "lang", "text") else f"_own{i}" for i, c in enumerate(docs.columns)}
    found = identify(docs.toDF(*name.values())).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return found.select(*[F.col(n).alias(c) for c, n in name.items()])


@query("op7_viterbi_language")
def op7(spark, sf_dir):
    out = identify(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
