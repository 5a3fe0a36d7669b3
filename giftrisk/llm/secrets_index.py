"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query: the alternatives it can match
are spelt out as literal runs with gaps, the trigrams of an alternative's runs must
all occur, one alternative must hold. Trigrams are folded to lower case, which only
widens the query. A rule with an alternative that has no trigram is scanned in full.

The index has a posting (trigram, document) for every distinct trigram of a document
that some rule asks for (or all trigrams, ``vocabulary=None``); each task writes a
segment sorted by trigram. A query joins its trigrams to the postings, counts per
document and alternative, and keeps documents that have all: no posting list is ever
gathered in one task. Candidates are then verified by the expression on the whole
text. Spans come from the text's pieces between matches: their lengths, summed up,
are the matches' positions in code points.

Defined cases: null text is empty; a null doc_id is carried; repeated rows are scanned
one by one (they share a posting key); columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import documents, query, stage

# Kind, expression, group whose length counts, least length. The first
# three are the base rules.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]{20,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]
BASE = 3
GAP = "\0"
#: An expression part with more alternatives than this counts as a gap.
MOST = 64


def alternatives(expression: str) -> list[str]:
    """What the expression can match, as literal runs between gaps (lower case)."""
    def cross(left, right):
        out = list(dict.fromkeys(a + b for a in left for b in right))
        if len(out) > MOST:  # too many: forget what the longer side says
            out = [a + GAP for a in left] if len(left) <= MOST else [GAP]
        return out

    def whole(nodes):
        out = [""]
        for op, arg in nodes:
            out = cross(out, one(op, arg))
        return out

    def one(op, arg):
        if op is sre.LITERAL:
            return [chr(arg).lower()]
        if op is sre.IN:
            some = list(dict.fromkeys(chr(a).lower() for o, a in arg if o is sre.LITERAL))
            return some if len(some) <= 6 and all(o is sre.LITERAL for o, _ in arg) else [GAP]
        if op is sre.BRANCH:
            return list(dict.fromkeys(x for part in arg[1] for x in whole(part)))
        if op is sre.SUBPATTERN:
            return whole(arg[3])
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, item = arg
            inner = whole(item)
            if least == 0:
                return [*inner, ""] if most == 1 else [GAP]
            out = inner
            for _ in range(min(int(least), 8) - 1):
                out = cross(out, inner)
            return out if least == most and least <= 8 else cross(out, [GAP])
        return [""] if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT) else [GAP]

    return whole(sre_parser.parse(expression))


def trigram_query(expression: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams that must all occur; None: no trigram is mandatory."""
    sets = {frozenset(run[i:i + 3] for run in a.split(GAP) for i in range(len(run) - 2)) for a in alternatives(expression)}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def build_index(docs: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """Postings (trigram, row_key), one segment a task, sorted by trigram."""
    if vocabulary is None:
        wanted = "..."
    else:
        by_first: dict[str, list[str]] = {}
        for t in sorted(vocabulary):
            by_first.setdefault(t[0], []).append(t[1:])
        quote = lambda s: "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in s)
        wanted = "|".join(f"{quote(c)}(?:{'|'.join(map(quote, rest))})" for c, rest in by_first.items())
    found = F.regexp_extract_all("text", F.lit(f"(?is)(?=({wanted}))"), F.lit(1))
    postings = docs.where("text is not null").select(row_key().alias("row_key"), F.explode(F.array_distinct(F.transform(found, F.lower))).alias("trigram"))
    return stage(postings.select("trigram", "row_key").sortWithinPartitions("trigram"), "trigram_index")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(row_key, kinds): the documents whose trigrams answer a rule's query."""
    asked = [(kind, n, t, len(s)) for kind, sets in queries.items() for n, s in enumerate(sets) for t in sorted(s)]
    asked = F.broadcast(index.sparkSession.createDataFrame(asked, "kind string, n int, trigram string, need int"))  # as long as the rules
    have = index.distinct().join(asked, "trigram").groupBy("row_key", "kind", "n", "need").agg(F.count("*").alias("have"))
    return have.where("have = need").groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def spans(text: Column, order: int, kind: str, expression: str, group: int, least: int) -> Column:
    """Matches as array<struct(start, ord, end, kind)>, failing ones dropped.

    Positions are prefix sums of the lengths of pieces and matches. An array grows by
    being copied, so the m matches are cut to blocks of sqrt(m): the blocks' starts are
    summed first, then each block runs from its start."""
    match = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(expression), F.lit(group))
    parts = F.arrays_zip(F.split(text, expression, -1).alias("gap"), match.alias("match"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")

    def step(acc, part):
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"))
        found = F.when(F.length(part["value"]) >= least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), found.alias("out"))

    def cut(parts):
        width = F.ceil(F.sqrt(F.size(parts))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(parts), width), lambda at: F.slice(parts, at, width))

    def starts(blocks):
        length = lambda block: F.aggregate(
            block, F.lit(0), lambda n, part: n + F.length(part["gap"]) + F.coalesce(F.length(part["match"]), F.lit(0)))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, block: F.struct(
            (acc["at"] + length(block)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def run(blocks):
        return F.flatten(F.zip_with(blocks, starts(blocks), lambda block, at: F.aggregate(
            block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    return _bound(_bound(parts, cut), run)


def scan(docs: DataFrame, rules=RULES, vocabulary: list[str] | None = ()) -> DataFrame:
    """The doc_id, text and ``found``, the spans of all rules by start and kind."""
    queries = {kind: trigram_query(e) for kind, e, _, _ in rules}
    indexed = {k: q for k, q in queries.items() if q}
    terms = sorted({t for q in indexed.values() for s in q for t in s}) if vocabulary == () else vocabulary
    hit = candidates(build_index(docs, terms), indexed)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), row_key().alias("row_key")).join(hit, "row_key", "left")
    found = []
    for n, (kind, e, group, least) in enumerate(rules):
        # runs of one class are maximal, so a long run can be asked for at once
        e = f"{e[:-1]}{{{least},}}" if kind == "hex" else e
        maybe = F.array_contains("kinds", kind) if queries[kind] else F.col("text").rlike(e)
        found.append(F.when(maybe, spans(F.col("text"), n, kind, e, group, least)).otherwise(
            F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _sql() -> str:
    parts, sizes = [], []
    for n, (kind, e, group, least) in enumerate(RULES):
        e = e.replace("'", "''")
        parts.append(f"""k{n} AS (SELECT rid, {n} AS ord, '{kind}' AS kind, s AS start, s + length(m[i]) AS stop
  FROM (SELECT rid, m, v, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT rid, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM
              (SELECT rid, regexp_extract_all(t, '{e}', 0) AS m, regexp_extract_all(t, '{e}', {group}) AS v, string_split_regex(t, '{e}') AS g FROM d
               WHERE regexp_matches(t, '{e if kind != "hex" else "[0-9a-f]{32,}"}'))))
  WHERE length(v[i]) >= {least})""")
    every = " UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(len(RULES)))
    sizes = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k, *_ in RULES[:BASE])
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(parts)},
a AS (SELECT *, kind || ':' || start || ':' || stop AS w FROM ({every})),
g AS (SELECT rid, {sizes}, string_agg(w, ',' ORDER BY start, ord) FILTER (ord < {BASE}) AS base, string_agg(w, ',' ORDER BY start, ord) AS spans FROM a GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in RULES[:BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""


@query("op5_trigram_secrets", _sql())
def op5(spark, sf_dir):
    found = scan(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k, *_ in RULES[:BASE]],
                        F.sha2(_joined(F.filter("found", lambda x: x["ord"] < BASE)), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
