"""Benchmark decontamination by canonical templates.

Tokens are words without outer punctuation, lower-cased. Numbers, units (directly after
a number) and names (capitalised words) become the typed placeholders <num>, <unit> and
<name>; the value replaced is the slot's filling. A capitalised word that opens a
sentence or line may be a name or not: templates are made both ways. Two windows start
at each token: the plain words, and, where it holds a placeholder and at least half its
tokens are words, the template. Where placeholders are denser, the template is twice or
four times as wide, with as many words; and an item with more placeholders than words
is also searched as one template, whatever its length. Windows of documents and items
meet in a hash join.

Hits of a document and an item that lie on one diagonal (document position minus
item position) are one alignment. Template hits count only if the alignment's slots
are consistent: each filling of the item stands for one filling of the document
throughout, and for names the reverse holds too; templates with a word that may be a
name don't speak against those without. An item is in a document if the
aligned windows cover at least ``min_coverage`` of its tokens, or if ``min_run`` of its
tokens follow each other in the document word for word, however long the item is.

Scale: only windows whose hash is set in a bitmap of the items' windows leave the
scan. The bitmap has ``BITMAP_BITS`` bits whatever the benchmark's size (that is the
bound of the broadcast); with a large benchmark it lets more through, and the join
stays exact. So a shuffle carries hits, not the corpus.

Defined cases: null or blank texts and items have no tokens and never match; items
under ``width`` tokens are searched as one window, those under ``min_tokens`` as plain
words only, and those of one or two tokens not at all (they identify nothing); repeated rows of one id and text
give one result row per item; an item of placeholders alone is searched by its plain
words; a very long text is cut in a block of its own; a null doc_id or item_id is
carried; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import documents, query, stage, texts

BITMAP_BITS = 24
#: Factor of the windows' hash (odd).
FACTOR = 0x9E3779B97F4A7C15
#: So many possible names of a window are tried both ways; further ones are names.
MAYBE = 6
#: Items of fewer tokens are not searched.
SHORTEST = 3
#: Template windows made at once.
TEMPLATES = 2_000_000
#: Words held by one block of numpy work.
BLOCK_WORDS = 800_000

# Unit words, and number words.
UNITS = frozenset("""
mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles metre metres meter meters
kilometre kilometres kilometer kilometers centimetre centimetres centimeter centimeters
mg g kg t gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds
ml l litre litres liter liters gallon gallons pint pints cup cups
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
mph kph kmh km/h m/s hz khz mhz ghz
percent % ° °c °f degree degrees kelvin
v volt volts a amp amps w watt watts kw kwh j joule joules n newton newtons pa
byte bytes kb mb gb tb bit bits
dollar dollars euro euros cent cents pence usd eur gbp
""".split())
NUMBER_WORDS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split())

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(st|nd|rd|th)?")
QUANTITY = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d]+(?:/[^\W\d]+)?|%|°[cf]?)")
OUTER = re.compile(r"^[^\w$€£+%°-]+|[^\w%°]+$")

WORD, NUM, UNIT, CAP = 0, 1, 2, 3
PLACEHOLDER = {NUM: "<num>", UNIT: "<unit>", CAP: "<name>"}


def capitalised(core: str) -> bool:
    return core[:1].isupper() and core[1:] == core[1:].lower()


def analyse(word: str) -> tuple[list[tuple[str, int]], bool]:
    """(tokens with their kinds, whether a sentence ends after the word)."""
    core, ends = word, False
    if not word.isalpha():
        ends = word.rstrip("\"')]»”’").endswith((".", "!", "?", ":"))
        core = word.rstrip(".,;:!?")
        if not core.isalpha():
            core = OUTER.sub("", word)
    low = core.lower()
    if core.isalpha():
        kind = NUM if low in NUMBER_WORDS else UNIT if low in UNITS else CAP if capitalised(core) else WORD
        return [(low, kind)], ends
    if not any(c.isalnum() for c in core) and core not in ("%", "°"):
        return [], ends
    if NUMBER.fullmatch(low):
        return [(low, NUM)], ends
    if (m := QUANTITY.fullmatch(low)) and m[2] in UNITS:
        return [(m[1], NUM), (m[2], UNIT)], ends
    if low in UNITS:
        return [(low, UNIT)], ends
    return [(low, CAP if capitalised(core) else WORD)], ends


class Tokens:
    """Tokens of a block of texts: string ids, kinds and document numbers."""

    def __init__(self, block: list[bytes]):
        words, first, sizes = [], [], []
        for t in block:
            n = len(words)
            for line in t.split(b"\n"):
                if w := line.split():
                    first.append(len(words))
                    words += w
            sizes.append(len(words) - n)
        flat = np.empty(len(words), object)
        flat[:] = words
        code, uniques = pd.factorize(flat)
        strings: dict[str, int] = {}
        t1 = np.zeros(len(uniques), np.int64)
        t2, k1, n, ends, cap = t1.copy(), t1.copy(), t1.copy(), np.zeros(len(uniques), bool), np.zeros(len(uniques), bool)
        for i, w in enumerate(uniques):
            text = w.decode("utf-8", "replace")
            found, ends[i] = analyse(text)
            cap[i] = capitalised(OUTER.sub("", text))
            n[i] = len(found)
            if found:
                t1[i], k1[i] = strings.setdefault(found[0][0], len(strings)), found[0][1]
            if len(found) > 1:
                t2[i] = strings.setdefault(found[1][0], len(strings))
        opens = np.zeros(len(words), bool)
        opens[first] = True
        opens[1:] |= ends[code[:-1]]
        at = np.repeat(np.arange(len(words)), n[code])
        second = np.append([False], at[1:] == at[:-1])[: len(at)]
        c = code[at]
        self.string = np.where(second, t2[c], t1[c])
        kind = np.where(second, UNIT, k1[c])
        self.doc = np.repeat(np.arange(len(block)), sizes)[at]
        # a unit follows a number; elsewhere the word is a word ("a", "in") or a name
        after = np.append([False], (kind[:-1] == NUM) & (self.doc[1:] == self.doc[:-1]))[: len(at)]
        self.kind = np.where((kind == UNIT) & ~after, np.where(cap[c], CAP, WORD), kind)
        self.maybe = (self.kind == CAP) & opens[at]  # a name or the first word of a sentence
        self.strings = list(strings)
        hashes = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        self.plain = hashes[self.string] if len(strings) else np.empty(0, np.uint64)
        self.maybes = np.append([0], np.cumsum(self.maybe))
        types = np.array([0] + [xxhash.xxh64_intdigest(PLACEHOLDER[k]) for k in (NUM, UNIT, CAP)], np.uint64)
        # prefix sums of token * FACTOR ** -place: the hash of any window is a difference
        powers = lambda x: np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(at), x, np.uint64)))
        self.power, inverse = powers(FACTOR), powers(pow(FACTOR, -1, 1 << 64))[:-1]
        sums = lambda x: np.append(np.zeros(1, np.uint64), np.cumsum(x * inverse, dtype=np.uint64))
        self.sums = [sums(self.plain), sums(np.where((self.kind > 0) & ~self.maybe, types[self.kind], self.plain))]

    def windows(self, width: int, base: int, wide: bool, whole: bool):
        """(start, hash, whether it is a template, names) of the windows of ``width``
        tokens: plain words up to the width ``base``, and templates. A template of that
        width holds at least as many words as placeholders. ``wide``: a wider one holds as
        many words, and its first half does not. ``whole``: the width is that of a short
        item, or of one with more placeholders than words; one word is enough. The bit r
        of names is set if the r-th token that may be a name is taken as one."""
        n = len(self.doc) - width + 1
        if n <= 0:
            return
        inside = self.doc[:n] == self.doc[width - 1:]
        total = lambda sums, at: (sums[at + width] - sums[at]) * self.power[at + width - 1]
        final = lambda h: (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        if width <= base:
            at = np.flatnonzero(inside)
            yield at, final(total(self.sums[0], at)), False, np.zeros(len(at), np.int64)
        sure = np.append([0], np.cumsum((self.kind > 0) & ~self.maybe))
        half = width // 2
        slots, names = (x[width:] - x[:-width] for x in (sure, self.maybes))
        front, front_names = ((x[half:] - x[:len(x) - half])[:n] for x in (sure, self.maybes))
        ok = np.zeros(n, bool)
        if width == base:
            ok |= 2 * slots <= width
        if wide:
            ok |= (2 * (width - slots) >= base) & (2 * (half - front - front_names) < base)
        if whole:
            ok |= (slots < width) & ((width < base) | (2 * (slots + names) > width))
        at = np.flatnonzero(ok & inside & (slots + names > 0))
        made = np.cumsum(1 << np.minimum(names[at], MAYBE)) // TEMPLATES
        for part in np.split(at, np.flatnonzero(np.diff(made)) + 1):
            yield self._templates(part, total(self.sums[1], part), slots[part], front[part], width, base, wide, whole, final)

    def _templates(self, at, h, slots, front, width, base, wide, whole, final):
        names = np.zeros(len(at), np.int64)
        as_name = np.uint64(xxhash.xxh64_intdigest(PLACEHOLDER[CAP]))
        for k in range(width):
            here = np.flatnonzero(self.maybe[at + k])
            if not len(here):
                continue
            place = at[here] + k
            rank = self.maybes[place] - self.maybes[at[here]]
            new = (at[here], h[here] + (as_name - self.plain[place]) * self.power[width - 1 - k], slots[here] + 1, front[here] + (k < width // 2),
                   names[here] | np.where(rank < MAYBE, 1 << np.minimum(rank, MAYBE), 0))
            stay = np.ones(len(at), bool)
            stay[here[rank >= MAYBE]] = False
            at, h, slots, front, names = (np.append(x[stay], y) for x, y in zip((at, h, slots, front, names), new))
        ok = np.zeros(len(at), bool)
        if width == base:
            ok |= 2 * slots <= width
        if wide:
            ok |= (2 * (width - slots) >= base) & (2 * (width // 2 - front) < base)
        if whole:
            ok |= (slots < width) & ((width < base) | (2 * slots > width))
        ok &= slots > 0
        return at[ok], final(h[ok]), True, names[ok]

    def row(self, start: int, width: int, typed: bool, names: int) -> tuple[str, list[str], bool]:
        """The window's canonical text, its fillings with their types, and whether a
        token that may be a name is taken as one."""
        words, slots, rank, guess = [], [], 0, False
        part = slice(start, start + width)
        for s, k, maybe in zip(self.string[part].tolist(), self.kind[part].tolist(), self.maybe[part].tolist()):
            name = typed and maybe and (rank >= MAYBE or bool(names >> rank & 1))
            rank += maybe
            guess |= name
            if name or (typed and k and not maybe):
                slots.append(PLACEHOLDER[k] + self.strings[s])
                words.append(PLACEHOLDER[k])
            else:
                words.append(self.strings[s])
        return " ".join(words), slots, guess


HIT_SCHEMA = "id long, row_key long, pos int, n_tokens int, hash long, typed boolean, width int, window string, slots array<string>, guess boolean, rule int"


BASE, WIDE, WHOLE = 0, 1, 2


def windows(table: DataFrame, id_col: str, rules: dict[int, set[int]] | None, width: int, min_tokens: int, bitmap=None) -> DataFrame:
    """Windows of all texts. ``rules``: the lengths to cut and the rules they are cut by
    (None: for items, all rules). ``bitmap``: broadcast filter on the hashes."""
    def run(batches):
        for batch in batches:
            ids, keys, held, size = [], [], [], 0
            for i, k, t in zip(batch.column("id").to_pylist(), batch.column("row_key").to_pylist(), texts(batch)):
                ids.append(i), keys.append(k), held.append(t or b"")
                size += len(held[-1]) // 5
                if size >= BLOCK_WORDS:
                    yield rows(ids, keys, held)
                    ids, keys, held, size = [], [], [], 0
            if ids:
                yield rows(ids, keys, held)

    def rows(ids, keys, held):
        tokens = Tokens(held)
        begin = np.searchsorted(tokens.doc, np.arange(len(held)))
        total = np.bincount(tokens.doc, minlength=len(held))
        cols = [[] for _ in HIT_SCHEMA.split(", ")]
        if rules is not None:
            cuts = [(w, WIDE in r, WHOLE in r, BASE) for w, r in sorted(rules.items())]
        else:
            cuts = [(width, False, False, BASE), (2 * width, True, False, WIDE), (4 * width, True, False, WIDE)]
            cuts += [(w, False, True, WHOLE) for w in np.unique(total).tolist() if w >= SHORTEST]
        for w, wide, whole, rule in cuts:
            for at, h, typed, names in tokens.windows(w, width, wide, whole):
                if typed and w < min(min_tokens, width):
                    continue
                if rule == WHOLE:
                    here = total[tokens.doc[at]] == w
                    at, h, names = at[here], h[here], names[here]
                if bitmap is not None:
                    slot = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
                    here = (bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    at, h, names = at[here], h[here], names[here]
                for p, x, chosen in zip(at.tolist(), h.view(np.int64).tolist(), names.tolist()):
                    d = int(tokens.doc[p])
                    text, slots, guess = tokens.row(p, w, typed, chosen)
                    for c, v in zip(cols, (ids[d], keys[d], p - int(begin[d]), int(total[d]), x, typed, w, text, slots, guess, rule)):
                        c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in HIT_SCHEMA.split(", ")])

    return table.select(F.col(id_col).cast("long").alias("id"), row_key(id_col).alias("row_key"), "text").mapInArrow(run, HIT_SCHEMA)


def row_key(id_col: str = "doc_id"):
    return F.xxhash64(F.col(id_col).cast("long"), F.col("text"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 8, min_coverage: float = 0.5, min_tokens: int = 5,
                 min_run: int = 13) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, row_key, item_id,
    coverage of the item's tokens, matched tokens, position of the first and after the
    last matched token, and whether template windows were needed (reparameterised)."""
    spark = docs.sparkSession
    asked = stage(windows(items, "item_id", None, width, min_tokens).distinct().withColumnsRenamed(
        {"id": "item_id", "row_key": "item_key", "pos": "item_pos", "n_tokens": "item_tokens", "slots": "item_slots", "guess": "item_guess"}), "item_windows")
    slot = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    bit = F.call_function("shiftleft", F.lit(1), F.pmod(slot, F.lit(8)).cast("int"))
    for r in asked.groupBy(F.shiftright(slot, 3).alias("i")).agg(F.bit_or(bit).alias("v")).toLocalIterator():
        bitmap[r.i] = r.v  # at most 2 ** (BITMAP_BITS - 3) rows
    rules: dict[int, set[int]] = {}
    for r in asked.select("width", "rule").distinct().collect():  # at most the lengths of items
        rules.setdefault(r.width, set()).add(r.rule)
    seen = windows(docs, "doc_id", rules, width, min_tokens, spark.sparkContext.broadcast(bitmap)).drop("rule")
    hits = (seen.distinct().join(asked.drop("rule").distinct(), ["hash", "typed", "width", "window"])
            .select(F.col("id").alias("doc_id"), "row_key", "item_id", "item_key", "item_tokens", "pos", "item_pos", "width", "typed",
                    (F.col("item_guess") | F.col("guess")).alias("guess"),
                    (F.col("pos") - F.col("item_pos")).alias("diagonal"), F.arrays_zip("item_slots", "slots").alias("pairs")))
    key = ["doc_id", "row_key", "item_id", "item_key"]
    window, guess = F.struct("item_pos", "width"), F.col("guess")
    lines = hits.groupBy(*key, "diagonal").agg(
        F.max("item_tokens").alias("item_tokens"),
        F.collect_set(F.when(~F.col("typed"), window)).alias("plain"),
        F.collect_set(F.when(F.col("typed") & ~guess, window)).alias("templates"),
        F.collect_set(F.when(guess, window)).alias("guesses"),
        F.array_distinct(F.flatten(F.collect_set(F.when(~guess, F.col("pairs"))))).alias("sure_pairs"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    by = lambda c, side: F.size(F.array_distinct(F.transform(c, lambda p: p[side])))

    def consistent(pairs):
        names = F.filter(pairs, lambda p: p["item_slots"].startswith("<name>"))
        return (F.size(pairs) == by(F.col(pairs), "item_slots")) & (F.size(names) == by(names, "slots"))

    none = F.array_except("plain", "plain")
    at = F.array_union(F.array_union("plain", F.when(consistent("sure_pairs"), F.col("templates")).otherwise(none)),
                       F.when(consistent("pairs"), F.col("guesses")).otherwise(none))
    lines = lines.withColumn("at", at).where(F.size("at") > 0)
    tokens = lambda c: F.array_distinct(F.flatten(F.transform(
        c, lambda p: F.sequence(p["item_pos"], p["item_pos"] + p["width"] - 1))))
    plain = F.array_sort(tokens("plain"))
    # tokens of plain windows that touch on one diagonal are equal one by one
    run = F.when(F.size(plain) >= min_run, F.exists(F.sequence(F.lit(0), F.size(plain) - min_run),
                                                    lambda i: plain[i + (min_run - 1)] - plain[i] == min_run - 1))
    lines = lines.select(*key, "item_tokens", "diagonal", tokens("at").alias("tokens"), F.coalesce(run, F.lit(False)).alias("run"),
                         (F.size(F.array_except(tokens("at"), tokens("plain"))) > 0).alias("by_template"))
    out = lines.groupBy(*key).agg(
        F.max("item_tokens").alias("item_tokens"), F.size(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("matched_tokens"),
        F.min(F.array_min("tokens") + F.col("diagonal")).alias("first_token"),
        F.max(F.array_max("tokens") + F.col("diagonal") + 1).alias("end_token"), F.bool_or("by_template").alias("reparameterised"),
        F.bool_or("run").alias("run"))
    return (out.withColumn("coverage", F.col("matched_tokens") / F.col("item_tokens")).where((F.col("coverage") >= min_coverage) | F.col("run"))
            .drop("item_key", "run").distinct())


def decontaminate(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The documents in which no benchmark item is found; keeps the columns."""
    found = contaminated(docs, items, **parameters).select("doc_id", "row_key").distinct().alias("found")
    same = F.col("docs.doc_id").cast("long").eqNullSafe(F.col("found.doc_id")) & (
        F.xxhash64(F.col("docs.doc_id").cast("long"), F.col("docs.text")) == F.col("found.row_key"))
    return docs.alias("docs").join(found, same, "left_anti")


@query("op1_template_windows")
def op1(spark, sf_dir):
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "item_tokens", "matched_tokens", "coverage", "first_token", "end_token", "reparameterised")
