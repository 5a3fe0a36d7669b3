"""Sanctions screening (T-k, U1, X13-X16, J4-J7, W7, L6, T-h, T-i, T-j, F9-F11).

Names keep the letters of every script: lower case, accents folded, anything but
letters, marks and blanks a blank. A name without a letter can't be compared; it gets
a status of its own and is never CLEAR.

Fuzzy name join: distinct names are cut into elements (occurrence-numbered, so that
set overlap is multiset overlap) of which a qualifying pair must share some:

* cut >= 0.75: character bigrams. Strings of length L within edit distance d share at
  least L - 1 - 2d, and d <= (1 - cut) L, so at least max(1, ceil(len / 2 - 1));
* lower cuts, where no shared bigram is certain: positioned segments of the longer name
  (see ``_segment_keys``), one of which an edit script within the cut leaves whole.

By the prefix-filter lemma a pair that shares t elements shares k of them among the
first n - t + k of each name under one global order: bigrams meet one by one, characters
(Jaro-Winkler) in tuples, as single ones would make nearly all pairs meet. In the order, the elements most frequent in the lists come last in
it, which keeps them out of the join. Any order gives the same result, so only the
``FREQUENT`` most frequent elements are looked up. Scores are
1 - levenshtein / max(length), computed once per pair of distinct names. Entities of
one name tie, so the first ``limit`` of each name suffice for the top hits, which are
exact. Join strategies are left to AQE.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from giftrisk import constants as C
from giftrisk.sources.sanctions import ENTITY_SCHEMA, FIELDS

#: Elements whose place in the global order depends on their frequency.
FREQUENT = 512


def _fold_table() -> tuple[str, str]:
    """Accented letters of the Latin, Greek and Cyrillic blocks and their bases."""
    pairs = []
    for c in map(chr, [*range(0xDF, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and all(unicodedata.combining(m) for m in marks) and base.isalpha() and c == c.lower():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_table()
NOT_LETTER = r"[^\p{L}\p{M} ]"
#: Combining accents that follow their letter in decomposed text.
LOOSE_ACCENT = "[\u0300-\u036f]"


def _text(df: DataFrame, name: str) -> Column:
    """First element of an array field, the value of a scalar field; empty is null."""
    is_array = df.schema[name].dataType.simpleString().startswith("array")
    c = F.try_element_at(F.col(name), F.lit(1)) if is_array else F.col(name)
    c = c.cast("string")
    return F.when(F.length(c) > 0, c)


def _first(df: DataFrame, names: list[str], default: str | None = "") -> Column:
    """The first field that is there and not empty."""
    return F.coalesce(*[_text(df, n) for n in names if n in df.columns], F.lit(default).cast("string"))


def _as_array(df: DataFrame, names: list[str]) -> Column:
    """The first field that is there and not empty, scalar or array, as an array."""
    found = []
    for n in names:
        if n in df.columns:
            is_array = df.schema[n].dataType.simpleString().startswith("array")
            c = F.col(n).cast("array<string>") if is_array else F.array(F.col(n).cast("string"))
            found.append(F.when(F.size(F.filter(c, lambda x: F.length(x) > 0)) > 0, c))
    return F.coalesce(*found, F.array().cast("array<string>"))


def normalise_list(df: DataFrame, payload_key: str) -> DataFrame:
    """One payload -> entity rows: first non-empty name, programs as array,
    remarks truncated to 300, type lower-cased with the list default, id, country."""
    list_name, default_type = C.SANCTIONS_LISTS[payload_key]
    return df.select(
        _first(df, FIELDS["id"]).alias("entity_id"), _first(df, FIELDS["name"]).alias("name"),
        F.lit(list_name).alias("list_name"), F.lower(_first(df, FIELDS["type"], default_type)).alias("entity_type"),
        _as_array(df, FIELDS["programs"]).alias("programs"),
        F.substring(_first(df, FIELDS["remarks"]), 1, C.REMARKS_MAX).alias("remarks"),
        _first(df, FIELDS["country"], None).alias("country"))


def entities(payloads: dict[str, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Union of all lists in one schema; no list at all is an empty table."""
    frames = [normalise_list(df, key) for key, df in payloads.items()]
    if not frames:
        return (spark or SparkSession.active()).createDataFrame([], ENTITY_SCHEMA)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def normalise_name(c: Column) -> Column:
    """Lower case, accents folded, letters of any script, single spaces, trimmed."""
    c = F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), LOOSE_ACCENT, "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, NOT_LETTER, " "), " +", " "))


def pieces(norm: Column, size: int) -> Column:
    """All substrings of ``size`` characters (the name itself if it is shorter)."""
    last = F.greatest(F.length(norm) - (size - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(norm, i, size))


def gram_elements(norm: Column, size: int = 2) -> Column:
    """Multiset of substrings as unique elements: array<struct<g, occ>> where occ
    numbers repeated ones (so set overlap = multiset overlap)."""
    grams = pieces(norm, size)
    return F.transform(grams, lambda g, i: F.struct(
        g.alias("g"), F.size(F.filter(F.slice(grams, 1, i + 1), lambda y: y == g)).alias("occ")))


def element_size(min_match: float) -> int:
    return 2 if min_match >= 0.75 else 1


def prefix_elements(norm: Column, freq: Column, min_match: float = C.DEFAULT_MIN_MATCH) -> Column:
    """The first n - t + 1 elements in the global order (rarest first); see the
    module's text. ``freq`` maps frequent elements to their frequency."""
    size = element_size(min_match)
    elems = gram_elements(norm, size)
    keyed = F.transform(elems, lambda e: F.struct(F.coalesce(freq[e["g"]], F.lit(0)).alias("f"),
                                                  e["g"].alias("g"), e["occ"].alias("occ")))
    n = F.length(norm)
    # a hair less than the bound, against rounding up a whole number
    t = F.ceil(n / 2.0 - 1) if size == 2 else F.ceil(F.lit(min_match) * n - 1e-9)
    keep = F.greatest(F.size(elems) - F.greatest(F.lit(1), t.cast("int")) + 1, F.lit(1))
    return F.slice(F.array_sort(keyed), 1, keep)


def element_frequency(df: DataFrame, col: str, min_match: float = C.DEFAULT_MIN_MATCH) -> Column:
    """Literal map of the ``FREQUENT`` most frequent elements to the number of names
    that hold them; that many rows reach the driver at most."""
    g = F.explode(F.array_distinct(pieces(F.col(col), element_size(min_match))))
    top = df.select(g.alias("g")).groupBy("g").count().orderBy(F.desc("count"), "g").limit(FREQUENT).collect()
    if not top:
        return F.create_map().cast("map<string,bigint>")
    return F.create_map(*[x for r in top for x in (F.lit(r["g"]), F.lit(int(r["count"])))])


#: Names up to so many characters are joined by segments or tuples, whose number grows
#: faster than the length; pairs with a longer name meet on single characters.
LONG = 40


def _tuples(elems: Column, k: int, tag: list[Column]) -> Column:
    """Hashes of all k-tuples of an array of elements, in its order."""
    def extend(start, chosen):
        rest = F.slice(elems, start, F.size(elems))
        if len(chosen) == k - 1:
            return F.transform(rest, lambda e: F.xxhash64(*tag, *[x[f] for x in [*chosen, e] for f in ("g", "occ")]))
        return F.flatten(F.transform(rest, lambda e, i: extend(start + i + 1, [*chosen, e])))

    return extend(F.lit(1), [])


def _keys(*parts: Column) -> Column:
    none = F.array().cast("array<bigint>")
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _long_keys(name: str, share: float, right: bool) -> Column:
    """Keys of pairs with a name above ``LONG``: single characters. A long name of one
    side meets names of any length of the other."""
    n, elems = F.length(name), F.col("_elems")
    single = _tuples(F.slice(elems, 1, n - F.ceil(F.lit(share) * n - 1e-9).cast("int") + 1), 1, [F.lit("long")])
    long, other = n > LONG, (n <= LONG) & (n >= F.lit(share) * LONG - 1e-9)
    left_long = F.when(long | other if right else long, F.transform(single, lambda h: F.xxhash64(F.lit("left"), h)))
    right_long = F.when(long if right else other, F.transform(single, lambda h: F.xxhash64(F.lit("right"), h)))
    return _keys(left_long, right_long)


def _tuple_keys(name: str, share: float, k: int, same: int) -> Column:
    """Keys of pairs of names up to ``LONG`` that share at least ``share`` of the longer
    one's characters and begin with the same ``same`` ones: k-tuples, and single
    characters for those with fewer than k to share."""
    n, elems = F.length(name), F.col("_elems")
    t = F.greatest(F.ceil(F.lit(share) * n - 1e-9), F.lit(1)).cast("int")
    tag = [F.lit(same), F.substring(name, 1, same)]

    def keys(size, kind):
        return _tuples(F.slice(elems, 1, F.least(n - t + size, n)), size, [F.lit(kind), *tag])

    return _keys(F.when(t < k, keys(1, "short")), F.when(n <= LONG, keys(k, "tuple")))


def _segment_keys(name: str, cut: float, right: bool) -> Column:
    """Keys of pairs of names up to ``LONG`` at ``cut`` or more. The longer name, of n
    characters, is cut into d + 1 segments, d = (1 - cut) n edits being allowed. Some
    segment i (from 0) is untouched, has at most i edits before it and d - i after it, so
    the shorter name holds it at most i places off, and d - i counted from the end.
    Names of one length meet once, cut on the right."""
    n = F.length(name)

    def edits(size):
        return F.floor(size * (1 - cut) + 1e-9).cast("int")

    def segment(size, i):
        """(start from 0, length) of a segment; the shorter ones lie at the ends, where
        few places are tried."""
        parts = edits(size) + 1
        q, longer = F.floor(size / parts).cast("int"), size % parts
        before = F.ceil((parts - longer) / 2).cast("int")
        return (i * q + F.least(F.greatest(i - before, F.lit(0)), longer),
                q + F.when((i >= before) & (i < before + longer), 1).otherwise(0))

    def key(side, size, i, start, length):
        return F.xxhash64(F.lit(side), size, i, F.substring(F.col(name), start + 1, length))

    def probe(side, size, i):
        start, length = segment(size, i)
        d, delta = edits(size), n - size
        low = F.greatest(start - i, start + delta - (d - i), F.lit(0))
        high = F.least(start + i, start + delta + (d - i), n - length)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda s: key(side, size, i, s, length))
                      ).otherwise(F.array().cast("array<bigint>"))

    own, other = ("right", "left") if right else ("left", "right")
    segments = F.transform(F.sequence(F.lit(0), edits(n)), lambda i: key(own, n, i, *segment(n, i)))
    first, last = (n + 1 if right else n), F.least(F.floor(n / F.lit(cut) + 1e-9).cast("int"), F.lit(LONG))
    probes = F.when(first <= last, F.flatten(F.transform(F.sequence(first, last), lambda size: F.flatten(
        F.transform(F.sequence(F.lit(0), edits(size)), lambda i: probe(other, size, i))))))
    return F.when(n <= LONG, _keys(segments, probes))


def _meet(left: DataFrame, right: DataFrame, share: float, keys) -> DataFrame:
    """Candidate pairs (na, ne) of distinct names that have one of ``keys(name column,
    whether on the right)`` in common, or a name above ``LONG``; the shorter has at
    least ``share`` of the longer one's length."""
    freq = element_frequency(right, "ne", 0.5)

    def keyed(df, c, is_right):
        elems = F.transform(gram_elements(F.col(c), 1), lambda e: F.struct(
            F.coalesce(freq[e["g"]], F.lit(0)).alias("f"), e["g"].alias("g"), e["occ"].alias("occ")))
        all_keys = F.array_distinct(_keys(keys(c, is_right), _long_keys(c, share, is_right)))
        return df.select(c, F.array_sort(elems).alias("_elems")).select(c, F.explode(all_keys).alias("_key"))

    a, b = F.length("na"), F.length("ne")
    near = F.least(a, b) >= F.lit(share) * F.greatest(a, b) - 1e-9
    return keyed(left, "na", False).join(keyed(right, "ne", True), "_key").where(near).select("na", "ne").distinct()


def segment_pairs(left: DataFrame, right: DataFrame, cut: float) -> DataFrame:
    """All pairs at ``cut`` or more by edit distance, and some others."""
    return _meet(left, right, cut, lambda c, is_right: _segment_keys(c, cut, is_right))


def tuple_pairs(left: DataFrame, right: DataFrame, classes: list[tuple[float, int, int]]) -> DataFrame:
    """All pairs of one of the ``classes`` (share, k, same), and some others."""
    return _meet(left, right, min(x[0] for x in classes), lambda c, _: F.concat(*[_tuple_keys(c, *x) for x in classes]))


def similarity(a: str, b: str) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def similar_names(left: DataFrame, right: DataFrame, min_match: float) -> DataFrame:
    """Pairs (na, ne, match_score) of the distinct names ``left(na)``, ``right(ne)``."""
    if element_size(min_match) == 1:
        pairs = segment_pairs(left, right, min_match)
        return pairs.withColumn("match_score", similarity("na", "ne")).where(F.col("match_score") >= min_match)
    freq = element_frequency(right, "ne", min_match)
    a = left.select("na", F.inline(prefix_elements(F.col("na"), freq, min_match))).select("na", "g", "occ")
    e = right.select("ne", F.inline(prefix_elements(F.col("ne"), freq, min_match))).select("ne", "g", "occ")
    near = F.least(F.length("na"), F.length("ne")) >= F.lit(min_match) * F.greatest(F.length("na"), F.length("ne")) - 1e-9
    # few bytes, many pairs: a fixed number of parts isn't coalesced into one task
    spark = left.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    a, e = a.repartition(parts, "g", "occ"), e.repartition(parts, "g", "occ")
    return (a.join(e, ["g", "occ"]).where(near).select("na", "ne").distinct()
            .withColumn("match_score", similarity("na", "ne")).where(F.col("match_score") >= min_match))


def fuzzy_hits(names: DataFrame, ents: DataFrame, min_match: float = C.DEFAULT_MIN_MATCH,
               limit: int = C.SCREEN_LIMIT, entity_type: str | None = None, country: str | None = None) -> DataFrame:
    """names(name_id, name) x entities -> hits (name_id, entity_id, hit_name,
    list_name, entity_type, programs, remarks, match_score, hit_rank): the best
    ``limit`` entities of each name at ``min_match`` (0.5 to 1) or more. With a
    ``country``, entities of another country are left out (those of none stay)."""
    if not 0.5 <= min_match <= 1:
        raise ValueError("min_match runs from 0.5 to 1")
    if entity_type:
        ents = ents.where(F.col("entity_type") == entity_type)
    if country:
        ents = ents.where(F.col("country").isNull() | (F.lower("country") == country.lower()))
    a = (names.select("name_id", normalise_name(F.col("name")).alias("na"))
         .where(F.length("na") > 0).dropDuplicates(["name_id", "na"]))
    e = ents.select(F.col("entity_id"), F.col("name").alias("hit_name"), "list_name", "entity_type", "programs",
                    "remarks", normalise_name(F.col("name")).alias("ne")).where(F.length("ne") > 0)
    pairs = similar_names(a.select("na").distinct(), e.select("ne").distinct(), min_match)
    of_name = Window.partitionBy("ne").orderBy("entity_id", "list_name")
    first = e.withColumn("_n", F.row_number().over(of_name)).where(F.col("_n") <= limit).drop("_n")
    best = Window.partitionBy("na").orderBy(F.col("match_score").desc(), F.col("entity_id"), F.col("list_name"))
    top = (pairs.join(first, "ne").withColumn("hit_rank", F.row_number().over(best))
           .where(F.col("hit_rank") <= limit))
    # a donor known by several names keeps the best hits of all of them
    best = Window.partitionBy("name_id").orderBy(F.col("match_score").desc(), F.col("entity_id"), F.col("list_name"), F.col("na"))
    return (a.join(top.drop("hit_rank"), "na").withColumn("hit_rank", F.row_number().over(best))
            .where(F.col("hit_rank") <= limit)
            .select("name_id", "entity_id", "hit_name", "list_name", "entity_type", "programs", "remarks",
                    "match_score", "hit_rank"))


def screening_status(names: DataFrame, hits: DataFrame, lists_loaded: bool = True) -> DataFrame:
    """T-h: BLOCKED (any hit) / CLEAR / OFFLINE (no lists) / INVALID (blank
    name, never blocked) / UNREADABLE (no letter to compare, never clear), with
    action, top match, list and score. ``names`` has one row per name_id."""
    top = (hits.where(F.col("hit_rank") == 1)
           .select("name_id", F.col("hit_name").alias("top_match"), F.col("list_name").alias("top_list"),
                   F.col("match_score").alias("top_score")))
    cnt = hits.groupBy("name_id").agg(F.count("*").alias("n_hits"))
    s = names.join(top, "name_id", "left").join(cnt, "name_id", "left")
    blank = F.length(F.trim(F.coalesce(F.col("name"), F.lit("")))) == 0
    status = (F.when(blank, "INVALID").when(F.col("n_hits") > 0, "BLOCKED")
              .when(F.lit(not lists_loaded), "OFFLINE")
              .when(F.length(normalise_name(F.col("name"))) == 0, "UNREADABLE").otherwise("CLEAR"))
    action = F.create_map(*[x for k, v in C.SCREEN_ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return (s.withColumn("status", status)
            .withColumn("action", F.coalesce(action[F.col("status")], F.lit("Enter a name")))
            .withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("bigint"))))


def demo_substring_hits(names: DataFrame, spark=None) -> DataFrame:
    """J4 / T-j: case-insensitive substring match either way against the demo
    names (5-row literal, broadcast nested loop), blank names excluded."""
    spark = spark or names.sparkSession
    demo = spark.createDataFrame([(n,) for n in C.DEMO_SDN_NAMES], "demo_name string")
    a, b = F.lower(F.trim(F.col("name"))), F.lower(F.col("demo_name"))
    cond = (F.length(a) > 0) & (F.contains(b, a) | F.contains(a, b))
    h = C.DEMO_HIT
    return (names.join(F.broadcast(demo), cond, "inner")
            .select("name_id", "name", "demo_name", F.lit(h["entity_id"]).alias("entity_id"),
                    F.lit(h["match_score"]).alias("match_score"), F.lit(h["list_name"]).alias("list_name"),
                    F.lit(h["entity_type"]).alias("entity_type")))


def split_blocked(donations: DataFrame, blocked_ids: DataFrame, key: str = "Donor_ID"):
    """Blocked donations (left semi) never reach scoring (left anti)."""
    return (donations.join(blocked_ids, key, "left_semi"), donations.join(blocked_ids, key, "left_anti"))


def _jaro_winkler(a: str, b: str, p: float = 0.1) -> float:
    """Jaro-Winkler similarity of two strings (prefix scale 0.1, max 4)."""
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return 0.0
    window = max(la, lb) // 2 - 1
    ma, mb = [False] * la, [False] * lb
    m = 0
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(lb, i + window + 1)):
            if not mb[j] and b[j] == ch:
                ma[i] = mb[j] = True
                m += 1
                break
    if m == 0:
        return 0.0
    sa = [ch for ch, f in zip(a, ma) if f]
    sb = [ch for ch, f in zip(b, mb) if f]
    t = sum(x != y for x, y in zip(sa, sb)) // 2  # whole transpositions, as in Winkler's own code
    jaro = (m / la + m / lb + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * p * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched Jaro-Winkler (not built into Spark); applied only to
    blocked candidate pairs of distinct names."""
    return pd.Series([_jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler_hits(names: DataFrame, ents: DataFrame, min_match: float = 0.9,
                      limit: int = C.SCREEN_LIMIT) -> DataFrame:
    """Optional scorer: Jaro-Winkler. With p shared first letters (4 at most) JW >= cut
    means Jaro >= j = (cut - p / 10) / (1 - p / 10), and Jaro is at most
    (m / la + m / lb + 1) / 3 for m matching characters, so at least 3 j - 2 of the
    longer name is shared. One class of ``tuple_pairs`` for each p loses no pair, for
    any cut above 0.8."""
    shares = [3 * (min_match - p / 10) / (1 - p / 10) - 2 for p in range(5)]
    if min(shares) <= 0:
        raise ValueError("min_match must be above 0.8")
    a = (names.select("name_id", normalise_name(F.col("name")).alias("na"))
         .where(F.length("na") > 0).dropDuplicates(["name_id", "na"]))
    e = (ents.select("entity_id", F.col("name").alias("hit_name"), "list_name", normalise_name(F.col("name")).alias("ne"))
         .where(F.length("ne") > 0))
    dn, de = a.select("na").distinct(), e.select("ne").distinct()
    # letters in common make up for the shorter tuples
    pairs = tuple_pairs(dn, de, [(x, 4 if p < 2 else 3, p) for p, x in enumerate(shares)]).withColumn(
        "match_score", jaro_winkler(F.col("na"), F.col("ne"))).where(F.col("match_score") >= min_match)
    of_name = Window.partitionBy("ne").orderBy("entity_id", "list_name")
    first = e.withColumn("_n", F.row_number().over(of_name)).where(F.col("_n") <= limit).drop("_n")
    w = Window.partitionBy("na").orderBy(F.col("match_score").desc(), F.col("entity_id"), F.col("list_name"))
    top = pairs.join(first, "ne").withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= limit)
    return a.join(top, "na").select("name_id", "entity_id", "list_name", "match_score", "hit_rank")
