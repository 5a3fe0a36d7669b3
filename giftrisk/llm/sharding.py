"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. A document starts in the shard its id and text
hash to. In each round a join brings every linked document the shard that holds most of
its link's bytes; it wants to move there. Quotas admit the moves: from the flows
between shards (at most shards * shards numbers) the driver finds for each shard the
share of its arrivals that keeps it within its capacity, and a link moves if its hash
lies in that share, so a link's documents go together. Links larger than half a shard
are cut into pieces beforehand. Rounds end when nothing moves.

At last sizes are made even (law ``bytes``). What is left of a link in a shard, and
each unlinked document, is a unit. Units over a ``FINE``-th of a shard are few by
arithmetic (their sizes add up to the whole), the others are summed in cells by shard
and hash. The driver places these numbers: each stays where it is if it fits,
otherwise it goes to the emptiest shard; units of links come first and unlinked cells
fill up. No rows but these bounded tables reach the driver.

Slots are gapless: rows are numbered within (shard, hash bucket), and each bucket
starts where the counts before it end, so no task numbers a whole shard.

Defined cases: a null text has no bytes (size 1) and is equal to an empty one; null
or repeated ids are rows like any other, however many rows one id has; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from giftrisk.llm.common import documents, drop_stage, query, stage

#: Units larger than a shard's FINE-th part are placed one by one.
FINE = 128
#: Cells of unlinked documents per shard, and of linked ones.
CELLS, LINK_CELLS = 512, 128
SLOT_ROWS = 2000


def _hash(col: str, salt: str, n: int):
    return F.pmod(F.xxhash64(F.col(col), F.lit(salt)), F.lit(n)).cast("int")


def _admit(flow: dict, load: list[float], capacity: float, n: int) -> list[float]:
    """Share of each shard's arrivals that keeps all shards within the capacity."""
    share = [1.0] * n
    for _ in range(50):
        after = [load[s] + sum(flow.get((f, s), 0) for f in range(n)) * share[s]
                 - sum(flow.get((s, t), 0) * share[t] for t in range(n)) for s in range(n)]
        over = [s for s in range(n) if after[s] > capacity * 1.0001 and share[s] > 0]
        if not over:
            break
        for s in over:
            arriving = sum(flow.get((f, s), 0) for f in range(n))
            share[s] = max(0.0, share[s] - (after[s] - capacity) / arriving) if arriving else 0.0
    return share


def propagate(linked: DataFrame, n: int, capacity: float, rounds: int = 8) -> DataFrame:
    """Move the documents of ``linked(rid, link, size, shard)`` towards their links'
    shards until nothing moves or ``rounds`` are over."""
    now = stage(linked, "shard_state")
    for _ in range(rounds):
        held = now.groupBy("link", "shard").agg(F.sum("size").alias("held"))
        want = held.groupBy("link").agg(F.max_by("shard", F.struct("held", "shard")).alias("want"))
        moves = held.join(want, "link").groupBy("shard", "want").agg(F.sum("held").alias("b")).collect()  # n * n rows at most
        load = [float(sum(r.b for r in moves if r.shard == s)) for s in range(n)]
        flow = {(r.shard, r.want): float(r.b) for r in moves if r.shard != r.want}
        if not flow:
            break
        share = F.element_at(F.array(*[F.lit(x) for x in _admit(flow, load, capacity, n)]), F.col("want") + 1)
        go = F.pmod(F.xxhash64("link", F.lit("admit")), F.lit(1_000_000)) < share * 1_000_000
        new = stage(now.join(want, "link").select("rid", "link", "size", F.when(go, F.col("want")).otherwise(F.col("shard")).alias("shard")), "shard_state")
        drop_stage(now)
        now = new
    return now


def place(units: list, n: int, load: list[float], capacity: float) -> list[int]:
    """Shard of each (size, present shard): where it is if it fits, else the emptiest;
    largest first."""
    out = [0] * len(units)
    for i in sorted(range(len(units)), key=lambda i: (-units[i][0], i)):
        size, s = units[i]
        if load[s] + size > capacity:
            s = min(range(n), key=lambda x: (load[x], x))
        load[s] += size
        out[i] = s
    return out


def shard(docs: DataFrame, n: int = 16, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = stage(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("group")), "shard_rows")
    base = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "group", F.lit("start")), F.lit(n)).cast("int"))
    groups = base.groupBy("group").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    whole = groups.agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).first()
    total, rows = whole.b or 0, whole.r or 0
    capacity = total / n
    pieces = F.ceil(F.col("bytes") / F.lit(max(capacity / 2, 1.0))).cast("int")
    # a table of its own, so that both sides of the join are plain exchanges, of which
    # AQE splits a hot group
    shared = stage(groups.where("rows > 1").select("group", pieces.alias("pieces")), "shard_groups")
    # rows of one id have hashes of their own: by their texts, and where these are equal
    # (only linked rows are) by their number in the table
    tied = base.join(shared, "group", "left").withColumn(
        "hash", F.when(F.col("pieces").isNull(), F.xxhash64("doc_id", "group")).otherwise(F.xxhash64("doc_id", "group", "rid")))
    link = F.when(F.col("pieces").isNotNull(), F.xxhash64("group", F.pmod(F.col("hash"), F.greatest("pieces", F.lit(1)))))
    tied = stage(tied.select("rid", "doc_id", "size", "text_crc32", "hash", "shard", link.alias("link")), "shard_links")
    moved = propagate(tied.where("link is not null").select("rid", "link", "size", "shard"), n, capacity, rounds)

    # what stands together: a link's part in a shard, or an unlinked document
    edge = F.lit(capacity / FINE)
    parts = moved.groupBy("link", "shard").agg(F.sum("size").alias("size"))
    alone = tied.where("link is null")
    big = [(r.unit, r.shard, r.size, r.linked) for r in
           parts.where(F.col("size") > edge).select(F.col("link").alias("unit"), "shard", "size", F.lit(True).alias("linked")).union(
               alone.where(F.col("size") > edge).select("rid", "shard", "size", F.lit(False))).collect()]  # at most n * FINE rows
    cell = lambda c, k: _hash(c, "cell", k)
    small = [(r.cell, r.shard, r.size, r.linked) for r in
             parts.where(F.col("size") <= edge).groupBy(cell("link", LINK_CELLS).alias("cell"), "shard").agg(F.sum("size").alias("size")).withColumn("linked", F.lit(True)).union(
                 alone.where(F.col("size") <= edge).groupBy(cell("hash", CELLS).alias("cell"), "shard").agg(F.sum("size").alias("size")).withColumn("linked", F.lit(False)))
             .collect()]  # at most n * (CELLS + LINK_CELLS) rows
    big.sort(), small.sort()
    load, plan = [0.0] * n, {}
    for name, these in (("big", [u for u in big if u[3]]), ("small", [u for u in small if u[3]]),
                        ("big", [u for u in big if not u[3]]), ("small", [u for u in small if not u[3]])):
        for u, to in zip(these, place([(u[2], u[1]) for u in these], n, load, capacity)):
            plan[name, u[3], u[0], u[1]] = to
    moves = [(name == "big", linked, unit, at, to) for (name, linked, unit, at), to in plan.items()]
    moves = F.broadcast(spark.createDataFrame(moves, "is_big boolean, linked boolean, unit long, shard int, to int"))

    size_of = parts.select("link", "shard", (F.col("size") > edge).alias("is_big"))
    a = moved.join(size_of, ["link", "shard"]).select(
        "rid", "shard", F.lit(True).alias("linked"), "is_big", F.when(F.col("is_big"), F.col("link")).otherwise(cell("link", LINK_CELLS).cast("long")).alias("unit"))
    b = alone.select("rid", "hash", "shard", F.lit(False).alias("linked"), (F.col("size") > edge).alias("is_big")).withColumn(
        "unit", F.when(F.col("is_big"), F.col("rid")).otherwise(cell("hash", CELLS).cast("long")))
    key = ["is_big", "linked", "unit", "shard"]
    final = tied.drop("shard", "link").join(a.union(b.select(*a.columns)).join(moves, key).select("rid", F.col("to").alias("shard")), "rid")
    out = slots(final, n, rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def slots(rows: DataFrame, n: int, count: int) -> DataFrame:
    """Adds a gapless slot from 0 within each shard, in hash order."""
    buckets = max(1, -(-count // (n * SLOT_ROWS)))
    rows = rows.withColumn("_b", _hash("hash", "slot", buckets))
    sizes = rows.groupBy("shard", "_b").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_b").orderBy("hash", "rid")
    return (rows.join(starts, ["shard", "_b"])
            .withColumn("slot", F.col("_start") + F.row_number().over(order) - 1).drop("_b", "_start"))


@query("op9_label_propagation_shards")
def op9(spark, sf_dir):
    return shard(documents(spark, sf_dir))
