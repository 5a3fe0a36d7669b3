"""Conversation prefix trie: a z-fast trie (Belazzougui, Boldi, Pagh, Vigna, "Fast
Prefix Search in Little Space", 2010) of turn sequences, held in tables.

A turn is hashed to two 60-bit numbers; the hash of a prefix is the exclusive or of
its turns' numbers, each keyed by its place (Zobrist), so prefix hashes are running
totals and need no sequential pass over a conversation. Equal hashes count as equal
prefixes (120 bits).

The compacted trie has a row (rep, name, ext) per node: its prefixes are the first
``name`` to ``ext`` turns of conversation ``rep``. Of these depths the 2-fattest one
(most trailing zero bits) is the node's handle; the handle's hash finds the node.

* Locate: each conversation of a batch looks up the 2-fattest depth of the interval
  that can hold its exit, in a join with the handles, and halves the interval. About
  log2(longest) rounds for all conversations together, no walk along turns.
* Insert: where conversations leave the edge of their exit node, the edge is cut at
  the common prefix. Below it, new nodes are the prefixes, among the batch's own
  tails, that end a conversation or have two children.
* Batches are fixed shares of the distinct conversations (an 8th, the rest). Identical
  conversations are one string from the start, so a hot one is one row.
* Expand: each edge becomes a row per depth. Counts of a subtree are sums over the
  ancestor table, whose rows are at most twice the turns.

No step gathers a conversation, a node's members or a level in one task. Running
totals are made over range partitions with offsets per (conversation, partition), so
one very long conversation is spread over tasks. Members' ids are joined to chunks of
a few KB by range-partitioned tasks before a node's hash streams over the chunks.

Defined cases: rows without conv_id belong to no conversation and are left out; null
turns come first; turns of one number are ordered by role, then text; null role or text
is empty; repeated rows are turns of their own; very long texts are hashed where they
are read and never shuffled again; an empty table gives no nodes; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giftrisk.llm.common import drop_stage, query, stage

#: Batches, in 16ths of the conversations.
BATCHES = [(0, 2), (2, 16)]
#: Rounds of the search in one job.
ROUNDS = 3
#: Characters of joined ids in a chunk.
CHUNK = 8192
HASHES = ("hi", "lo")


def running(rows: DataFrame, key: str, order: list[str], sums: list[str], xors: list[str], drop: list[str], name: str) -> DataFrame:
    """Adds ``<c>_run`` for the long columns ``sums`` and ``xors``: sum or exclusive or
    of the rows of ``key`` up to and with this one. Rows equal in ``order`` come in any
    order. A key may span any number of tasks."""
    spread = [key, *order, "_salt"]
    parts = (rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*spread).sortWithinPartitions(*spread)
             .drop("_salt", *drop))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields]
    at = {c: parts.columns.index(c) for c in (key, *sums, *xors)}

    def run(batches):
        part = TaskContext.get().partitionId()
        last, carry = None, dict.fromkeys(sums + xors, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(at[key]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append([True], keys[1:] != keys[:-1]))
            group = np.cumsum(np.append([0], keys[1:] != keys[:-1]))
            out = []
            for c in sums + xors:
                v = batch.column(at[c]).to_numpy(zero_copy_only=False)
                if c in sums:
                    total = np.cumsum(v)
                    total = total - (total[first] - v[first])[group]
                    total[group == 0] += carry[c] if keys[0] == last else 0
                else:
                    total = np.bitwise_xor.accumulate(v)
                    total = total ^ (total[first] ^ v[first])[group]
                    total[group == 0] ^= carry[c] if keys[0] == last else 0
                carry[c] = int(total[-1])
                out.append(pa.array(total, pa.int64()))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out, pa.array(np.full(n, part), pa.int64())],
                                             [*batch.schema.names, *[f"{c}_run" for c in sums + xors], "_part"])

    local = stage(parts.mapInArrow(run, ", ".join([*fields, *[f"{c}_run long" for c in sums + xors], "_part long"])), name)
    # what a key's earlier partitions hold; a key of one partition has no row here
    totals = local.groupBy(key, "_part").agg(*[F.sum(c).alias(c) for c in sums], *[F.bit_xor(c).alias(c) for c in xors])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_part", *[F.sum(c).over(before).alias(f"{c}_off") for c in sums],
                            *[F.bit_xor(c).over(before).alias(f"{c}_off") for c in xors]).where(F.col(f"{(sums + xors)[0]}_off").isNotNull())
    off = lambda c: F.coalesce(f"{c}_off", F.lit(0))
    return local.join(offsets, [key, "_part"], "left").select(
        *parts.columns, *[(F.col(f"{c}_run") + off(c)).alias(f"{c}_run") for c in sums],
        *[F.col(f"{c}_run").bitwiseXOR(off(c)).alias(f"{c}_run") for c in xors])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, token, bytes): turns with their place from 0 in each conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("token"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    rows = running(rows, "conv_id", ["turn", "role", "text"], ["one"], [], ["turn", "role", "text"], "trie_turns")
    return rows.select("conv_id", (F.col("one_run") - 1).alias("i"), "token", "bytes")


def place_hash(token: Column, place: Column) -> list[Column]:
    """The numbers of a turn at a place."""
    digest = F.sha2(F.concat_ws(":", place.cast("string"), token), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(f"own_{c}") for c, at in zip(HASHES, (1, 16))]


def regrouped(turns: DataFrame, family: int = 5, shares: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with their family head's first turns: h = crc32(id) mod
    ``shares`` turns of conversation id - id mod ``family``, then the own ones after
    the first h. (conv_id, i, token, bytes) and the conversations' ids."""
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", (c - c % family).alias("head"), (F.crc32(c.cast("string").cast("binary")) % shares).alias("h"))
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    convs = stage(convs.join(heads, "head", "left").withColumn("k", F.least("h", F.coalesce("n_head", F.lit(0)))), "trie_convs")
    start = turns.where(F.col("i") < shares).withColumnRenamed("conv_id", "head").join(convs, "head").where("i < h")
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").where("i >= h")
    rows = start.select("conv_id", "i", "token", "bytes").union(own.select("conv_id", (F.col("k") + F.col("i") - F.col("h")).alias("i"), "token", "bytes"))
    return rows, convs.select("conv_id")


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] with the most trailing zero bits, for 0 <= a < b."""
    k = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, k), k)


class Trie:
    """The compacted trie of ``paths(x, d, hi, lo, own_hi, own_lo, bytes, upto)``: for
    each distinct conversation x and depth d from 0 the prefix hash, the last turn's
    numbers and bytes, and the bytes up to it; ``ends(x, n)`` holds the lengths."""

    def __init__(self, paths: DataFrame, ends: DataFrame):
        self.paths, self.ends = paths, ends
        self.longest = ends.agg(F.max("n")).first()[0] or 0
        self.nodes: DataFrame | None = None

    def at(self, rows: DataFrame, x: str, d: str, **names: str) -> DataFrame:
        """Adds columns of the path of ``x`` at depth ``d`` (null if it is shorter)."""
        side = self.paths.select(F.col("x").alias("_x"), F.col("d").alias("_d"), *[F.col(c).alias(n) for n, c in names.items()])
        return rows.join(side, (F.col(x) == F.col("_x")) & (F.col(d) == F.col("_d")), "left").drop("_x", "_d")

    def dressed(self, nodes: DataFrame) -> DataFrame:
        """(rep, name, ext) with the hashes at name, handle and extent, from one join."""
        handle = F.when(F.col("name") == 0, F.lit(0).cast("long")).otherwise(fattest(F.col("name") - 1, F.col("ext")))
        nodes = nodes.withColumn("f", handle)
        rows = self.at(nodes.withColumn("depth", F.explode(F.array_distinct(F.array("name", "f", "ext")))), "rep", "depth", hi="hi", lo="lo", own="bytes", upto="upto")
        pick = lambda d, c, as_: F.max(F.when(F.col("depth") == F.col(d), c)).alias(as_)
        return rows.groupBy("rep", "name", "ext", "f").agg(
            pick("name", F.col("hi"), "nhi"), pick("name", F.col("lo"), "nlo"), pick("name", F.col("upto") - F.col("own"), "base"),
            pick("f", F.col("hi"), "fhi"), pick("f", F.col("lo"), "flo"),
            pick("ext", F.col("hi"), "ehi"), pick("ext", F.col("lo"), "elo"), pick("ext", F.col("upto"), "upto"))

    def locate(self, batch: DataFrame) -> DataFrame:
        """(x, n, rep, name, ext, p): the exit node of each conversation and the
        length of its longest prefix in the trie."""
        held = ["rep", "name", "ext", "ehi", "elo"]
        root = self.nodes.where("name = 0").select(*held).first()
        now = batch.withColumns({c: F.lit(root[c]).cast("long") for c in held}).withColumn("a", F.col("ext")).withColumn("b", F.col("n"))
        handles = self.nodes.select(F.col("f").alias("hf"), "fhi", "flo", *[F.col(c).alias(f"h_{c}") for c in held])
        written = None
        for k in range(int(self.longest).bit_length() + 1):  # each round halves what is left of (a, b]
            ask = now.withColumn("f", F.when(F.col("a") < F.col("b"), fattest(F.col("a"), F.col("b"))))
            ask = self.at(ask, "x", "f", qhi="hi", qlo="lo")
            hit = ask.join(handles, (F.col("f") == F.col("hf")) & (F.col("qhi") == F.col("fhi")) & (F.col("qlo") == F.col("flo")), "left")
            found, tried = F.col("hf").isNotNull(), F.col("f").isNotNull()
            # a found edge need not be passed to its end: below it nothing is found then
            now = hit.select("x", "n", *[F.when(found, F.col(f"h_{c}")).otherwise(F.col(c)).alias(c) for c in held],
                             F.when(found, F.col("h_ext")).otherwise(F.col("a")).alias("a"),
                             F.when(tried & ~found, F.col("f") - 1).otherwise(F.col("b")).alias("b"))
            if (k + 1) % ROUNDS == 0:
                new = stage(now, "trie_search")
                if written is not None:
                    drop_stage(written)
                now = written = new
        # the exit lies in the node found, or in the child that the next turn names
        now = self.at(now.drop("a", "b"), "x", "ext", xhi="hi", xlo="lo")
        now = now.withColumn("full", F.coalesce((F.col("xhi") == F.col("ehi")) & (F.col("xlo") == F.col("elo")), F.lit(False))).drop("xhi", "xlo")
        now = self.at(now.withColumn("next", F.when(F.col("full"), F.col("ext") + 1)), "x", "next", qhi="hi", qlo="lo")
        names = self.nodes.select(F.col("name").alias("hn"), "nhi", "nlo", *[F.col(c).alias(f"h_{c}") for c in ("rep", "name", "ext")])
        now = now.join(names, (F.col("next") == F.col("hn")) & (F.col("qhi") == F.col("nhi")) & (F.col("qlo") == F.col("nlo")), "left")
        found = F.col("hn").isNotNull()
        now = now.select("x", "n", *[F.when(found, F.col(f"h_{c}")).otherwise(F.col(c)).alias(c) for c in ("rep", "name", "ext")],
                         (F.col("full") & ~found).alias("full"))
        # compare along the edge; a conversation has no more rows here than turns
        edge = now.withColumn("depth", F.explode(F.when(F.col("full"), F.array("ext")).otherwise(F.sequence("name", F.least("ext", "n")))))
        edge = self.at(self.at(edge, "x", "depth", hi="hi", lo="lo"), "rep", "depth", rhi="hi", rlo="lo")
        same = (F.col("hi") == F.col("rhi")) & (F.col("lo") == F.col("rlo"))
        return edge.groupBy("x", "n", "rep", "name", "ext").agg(F.max(F.when(same, F.col("depth"))).alias("p"))

    def insert(self, batch: DataFrame) -> None:
        """Insert the conversations ``batch(x, n)`` together."""
        if self.nodes is None:
            exits = batch.withColumn("p", F.lit(-1).cast("long"))
            old = None
        else:
            exits = stage(self.locate(batch), "trie_located")
            cuts = exits.where("p < ext").select("rep", "ext", "p").distinct()
            by = Window.partitionBy("rep", "ext").orderBy("p")  # at most a row per depth of the edge
            # a cut ends an upper piece; the last one also begins the rest of the edge
            pieces = cuts.join(self.nodes.select("rep", "ext", "name"), ["rep", "ext"]).select(
                "rep", F.coalesce(F.lag("p").over(by) + 1, F.col("name")).alias("name"), F.col("p").alias("ext"))
            rest = cuts.groupBy("rep", "ext").agg((F.max("p") + 1).alias("cut"))
            kept = self.nodes.select("rep", "name", "ext").join(rest, ["rep", "ext"], "left").select("rep", F.coalesce("cut", "name").alias("name"), "ext")
            old = kept.union(pieces)
        tails = self.paths.join(exits.select("x", "n", "p"), "x").where("d > p")
        key = ["d", "hi", "lo"]
        groups = tails.groupBy(*key).agg(F.min("x").alias("rep"), F.max(F.col("d") == F.col("n")).alias("end"), F.max("p").alias("p"),
                                         F.first(F.col("hi").bitwiseXOR(F.col("own_hi"))).alias("phi"), F.first(F.col("lo").bitwiseXOR(F.col("own_lo"))).alias("plo"))
        groups = stage(groups, "trie_groups")
        kids = groups.where("d > p + 1").groupBy((F.col("d") - 1).alias("d"), F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count("*").alias("kids"))
        made = groups.join(kids, key, "left").where("end or kids > 1").select(*key, "rep")
        on_path = tails.select("x", "p", *key).join(made, key)
        above = Window.partitionBy("x").orderBy("d")  # a row per node on the path
        new = on_path.withColumn("name", F.coalesce(F.lag("d").over(above), F.col("p")) + 1).where("x = rep").select("rep", "name", F.col("d").alias("ext"))
        self.nodes = stage(self.dressed(new if old is None else old.union(new)), "trie_nodes")

    def build(self) -> DataFrame:
        """All batches in turn; the nodes."""
        share = F.pmod(F.xxhash64("x"), F.lit(16))
        for low, high in BATCHES:
            batch = self.ends.where((share >= low) & (share < high))
            if self.nodes is None and not batch.head(1):
                continue
            self.insert(batch)
        return self.nodes


def member_hashes(members: DataFrame) -> DataFrame:
    """(n, hi, lo, ends_sha256): SHA-256 of the ascending, comma-joined ids of
    ``members(n, hi, lo, conv_id)``."""
    key = ["n", "hi", "lo"]
    sort = members.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def chunks(batches):
        now, ids, size = None, [], 0
        out: list = []

        def flush():
            if ids:
                out.append((*now, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for n, hi, lo, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (n, hi, lo) != now or size > CHUNK:
                    flush()
                    now, ids, size = (n, hi, lo), [], 0
                ids.append(c)
                size += 12
            if out:
                yield rows(out, "n hi lo first joined")
                out.clear()
        flush()
        if out:
            yield rows(out, "n hi lo first joined")

    def rows(found, names):
        kinds = [pa.string() if x in ("joined", "ends_sha256") else pa.int64() for x in names.split()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names.split())

    def digests(batches):
        now, state, out = None, None, []
        for batch in batches:
            for n, hi, lo, _, joined in zip(*(x.to_pylist() for x in batch.columns)):
                if (n, hi, lo) != now:
                    if now:
                        out.append((*now, state.hexdigest()))
                    now, state = (n, hi, lo), hashlib.sha256(joined.encode())
                else:
                    state.update(b"," + joined.encode())
            if out:
                yield rows(out, "n hi lo ends_sha256")
                out = []
        if now:
            yield rows([(*now, state.hexdigest())], "n hi lo ends_sha256")

    joined = sort.select(*key, "conv_id").mapInArrow(chunks, "n long, hi long, lo long, first long, joined string")
    return (joined.repartition(*key).sortWithinPartitions(*key, "first")
            .mapInArrow(digests, "n long, hi long, lo long, ends_sha256 string"))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows(conv_id, i, token, bytes)``; ``convs(conv_id)``
    holds every conversation, also those without turns."""
    rows = rows.select("conv_id", "i", "bytes", *place_hash(F.col("token"), F.col("i")))
    rows = running(rows, "conv_id", ["i"], ["bytes"], ["own_hi", "own_lo"], [], "trie_running")
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n"), *[F.bit_xor(f"own_{c}").alias(c) for c in HASHES])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    members = stage(convs.join(whole, "conv_id", "left").select("conv_id", *[zero(c) for c in ("n", *HASHES)]), "trie_members")
    ends = stage(members.groupBy("n", *HASHES).agg(F.min("conv_id").alias("x"), F.count("*").alias("held")), "trie_ends")
    paths = rows.join(ends.select(F.col("x").alias("conv_id")), "conv_id", "left_semi").select(
        F.col("conv_id").alias("x"), (F.col("i") + 1).alias("d"), F.col("own_hi_run").alias("hi"), F.col("own_lo_run").alias("lo"),
        "own_hi", "own_lo", "bytes", F.col("bytes_run").alias("upto"))
    none = [F.lit(0).cast("long").alias(c) for c in paths.columns[1:]]
    paths = stage(paths.union(ends.select("x", *none)), "trie_paths")
    trie = Trie(paths, ends.select("x", "n"))
    nodes = trie.build()
    if nodes is None:  # no conversation at all
        nodes = stage(trie.dressed(ends.select(F.col("x").alias("rep"), F.col("n").alias("name"), F.col("n").alias("ext"))), "trie_nodes")
    return expanded(trie, nodes, ends, member_hashes(members))


def expanded(trie: Trie, nodes: DataFrame, ends: DataFrame, hashes: DataFrame) -> DataFrame:
    """A row per depth of every edge."""
    node = ["ext", "ehi", "elo"]
    at_end = ends.select(F.col("n").alias("ext"), F.col("hi").alias("ehi"), F.col("lo").alias("elo"), F.col("x").alias("low"), "held")
    nodes = stage(nodes.join(at_end, node, "left").withColumn("id", F.monotonically_increasing_id()), "trie_numbered")
    # every node with its ancestors, itself included: nodes at the prefixes of its path
    up = nodes.select("id", "rep", "name", F.col("ext").alias("deep"), "held", "low")
    path = up.join(trie.paths.select(F.col("x").alias("rep"), "d", "hi", "lo"), "rep").where("d <= deep")
    top = nodes.select(F.col("id").alias("up"), F.col("ext").alias("d"), F.col("ehi").alias("hi"), F.col("elo").alias("lo"))
    above = stage(path.join(top, ["d", "hi", "lo"]).select("id", "up", "d", "name", "deep", "held", "low"), "trie_ancestors")
    kids = above.where("d = name - 1").select("id", "up")
    n_kids = kids.groupBy("up").agg(F.count("*").alias("kids"))
    leafy = above.join(n_kids.select(F.col("up").alias("id"), F.lit(0).alias("leaf")), "id", "left")
    sums = leafy.groupBy("up").agg(F.sum("held").alias("n_convs"), F.min("low").alias("conv_id"),
                                   F.sum(F.coalesce("leaf", F.lit(1))).cast("long").alias("n_leaves"))
    full = stage(nodes.drop("low").join(sums.withColumnRenamed("up", "id"), "id").join(n_kids.withColumnRenamed("up", "id"), "id", "left")
                 .join(kids.select("id", F.col("up").alias("parent")), "id", "left"), "trie_counts")
    edge = full.select("id", ((F.col("n_convs") - 1) * (F.col("upto") - F.col("base"))).alias("edge_saved"))
    saved = above.select("id", "up").join(edge, "id").groupBy(F.col("up").alias("id")).agg(F.sum("edge_saved").alias("below"))
    parents = full.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"))
    every = (full.join(saved, "id").join(parents, "parent", "left")
             .join(hashes.select(F.col("n").alias("ext"), F.col("hi").alias("ehi"), F.col("lo").alias("elo"), "ends_sha256"), node, "left"))
    every = every.select("rep", "name", "ext", "base", "conv_id", "n_convs", "kids", "n_leaves", "below", "above", "ends_sha256",
                         F.explode(F.sequence("name", "ext")).alias("depth"))
    every = trie.at(every, "rep", "depth", own="bytes", sofar="upto")
    last = F.col("depth") == F.col("ext")
    return every.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("name"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("kids", F.lit(0).cast("long"))).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("below") - (F.col("n_convs") - 1) * (F.col("sofar") - F.col("own") - F.col("base"))).alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"))


SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS ts FROM o GROUP BY conv_id),
h AS (SELECT conv_id, ts, conv_id - conv_id % 5 AS head,
             xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
               lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, j: xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)))), CAST(4294967295 AS BIGINT)) % 9 AS h FROM l),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1:h], h.ts[h + 1:]) AS ts FROM h LEFT JOIN l b ON b.conv_id = h.head),
p AS (SELECT conv_id, unnest(range(0, len(ts) + 1)) AS depth, ts FROM r),
n AS (SELECT depth, ts[1:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(ts) = depth), '') AS ends FROM p GROUP BY depth, ts[1:depth]),
c AS (SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.k[n.depth].text) END AS own FROM n LEFT JOIN c ON c.depth = n.depth AND c.k = n.k),
u AS (SELECT a AS depth, k[1:a] AS k, sum(own) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT x.*, unnest(range(0, depth + 1)) AS a FROM x) GROUP BY 1, 2)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN u ON u.depth = x.depth AND u.k = x.k LEFT JOIN n b ON b.depth = x.depth - 1 AND b.k = x.k[1:x.depth - 1]
"""


@query("op11_zfast_trie", SQL)
def op11(spark, sf_dir):
    return prefix_trie(*regrouped(stage(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie_turn_numbers")))
