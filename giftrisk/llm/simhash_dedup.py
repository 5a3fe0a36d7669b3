"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprint: 64 majority bits of the XXH64 hashes (seed 42) of a text's word
shingles, repeats included. Two fingerprints link at ``max_distance`` (tau) or
fewer differing bits.

Candidates (Qin and Xiao, "Pigeonring", VLDB 2018): cut the 64 bits into tau + 1
segments in a ring. If two fingerprints differ in at most tau bits, some segment
starts a chain in which the first l segments together differ in at most
l * tau / (tau + 1) bits, for every l. So the first segment is equal, and the
second differs in one bit at most: one of its halves is equal too. Fingerprints
meet on (segment, its bits, half, that half's bits), 24 bits for tau = 3, which
keeps groups small; the longer chains and the whole Hamming distance are then
checked. No pair within the distance is lost.

Copies collapse first: one row per distinct fingerprint goes on. Within a group a
pivot (the fingerprint with most documents) is linked first; two fingerprints that
both link to it are connected already and are never paired, so a dense group costs
its size times the few that missed the pivot, not its square. Components then come
from ``components``.

Defined cases: null or blank text has fingerprint zero and links like any other;
fewer words than a shingle: the whole sequence is the one shingle; repeated rows
are members like any other; a null ``doc_id`` is never the smallest id unless all
ids of its component are null (then component_id is null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from giftrisk.llm.common import documents, query, stage, texts
from giftrisk.llm.components import components

SEED = 42
#: Shingles whose bits are counted at a time (bounds memory for very long texts).
CHUNK = 100_000


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED) - (1 << 64) * (xxhash.xxh64_intdigest(joined, SEED) >> 63)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1:].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i:i + CHUNK], ends[i:i + CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, row_key, fp): row_key tells rows of one id but different text apart."""
    def run(batches):
        for batch in batches:
            fp = [fingerprint(t or b"", shingle) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(fp, pa.int64())], ["doc_id", "row_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), "text").mapInArrow(
        run, "doc_id long, row_key long, fp long")


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _bits(lo: int, hi: int) -> int:
    """Mask of bits lo (included) to hi, as a signed 64-bit number."""
    m = ((1 << hi) - 1) ^ ((1 << lo) - 1)
    return m - (1 << 64) if m >> 63 else m


def _ring(tau: int):
    """For each segment: its bit range, the next one's, and per chain length from 2
    on the mask of the chain and its budget."""
    m = tau + 1
    cut = [64 * i // m for i in range(m + 1)]
    for i in range(m):
        mask, chain = _bits(cut[i], cut[i + 1]), []
        for length in range(2, m + 1):
            j = (i + length - 1) % m
            mask |= _bits(cut[j], cut[j + 1])
            chain.append((mask, length * tau // m))
        n = (i + 1) % m
        yield i, (cut[i], cut[i + 1]), (cut[n], cut[n + 1]), chain


def _keys(fp: Column, tau: int) -> Column:
    """The group keys of a fingerprint: segment number and half, and their bits."""
    keys = []
    for i, (lo, hi), (nlo, nhi), _ in _ring(tau):
        mid = (nlo + nhi) // 2
        for h, (a, b) in enumerate(((nlo, mid), (mid, nhi))):
            seg = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            half = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
            keys.append(F.lit((2 * i + h) << 52).bitwiseOR(F.shiftleft(seg, b - a)).bitwiseOR(half))
    return F.array(*keys)


def _chain_ok(key: Column, x: Column, y: Column, tau: int) -> Column:
    """The chain that starts at the key's segment keeps its budgets, and so does the
    whole fingerprint."""
    diff = x.bitwiseXOR(y)
    slot = F.shiftright(key, 53)
    ok = F.lit(False)
    for i, _, _, chain in _ring(tau):
        good = F.lit(True)
        for mask, budget in chain[:-1]:
            good = good & (F.bit_count(diff.bitwiseAND(F.lit(mask))) <= budget)
        ok = F.when(slot == i, good).otherwise(ok)
    return ok & (F.bit_count(diff) <= tau)


def links(classes: DataFrame, tau: int = 3) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of ``classes(fp, n)`` just
    as all pairs within ``tau`` bits would."""
    if tau == 0:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    keyed = classes.select("fp", "n", F.explode(_keys(F.col("fp"), tau)).alias("key"))
    groups = (keyed.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("n", "fp")).alias("top"))
              .where("size > 1").select("key", F.col("top.fp").alias("pivot")))
    met = keyed.join(groups, "key").where("fp <> pivot").select(
        "key", "fp", "pivot", _chain_ok(F.col("key"), F.col("fp"), F.col("pivot"), tau).alias("linked"))
    met = stage(met, "simhash_groups")
    missed = met.where("not linked").select("key", F.col("fp").alias("a"))
    other = met.select("key", F.col("fp").alias("b"), "linked")
    near = missed.join(other, "key").where(
        (F.col("linked") | (F.col("a") < F.col("b"))) & _chain_ok(F.col("key"), F.col("a"), F.col("b"), tau))
    return met.where("linked").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).union(near.select("a", "b")).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row per document: doc_id, row_key, fp, group_fp (smallest fingerprint of
    the component) and component_id (its smallest doc_id)."""
    prints = stage(fingerprints(docs, shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    tree = components(links(classes.select("fp", "n"), max_distance)).select(
        F.col("node").alias("fp"), F.col("root").alias("group_fp"))
    tree = stage(tree, "simhash_tree")
    of = classes.select("fp", "first").join(tree, "fp", "left").withColumn("group_fp", F.coalesce("group_fp", "fp"))
    lowest = of.join(tree.select("group_fp").distinct(), "group_fp").groupBy("group_fp").agg(F.min("first").alias("low"))
    of = of.join(lowest, "group_fp", "left").select("fp", "group_fp", F.coalesce("low", "first").alias("component_id"))
    return prints.join(of, "fp")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id
    (repeated rows of it: one). Keeps the columns of ``docs``."""
    keep = (simhash_groups(docs, shingle, max_distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("group_fp").agg(F.min("row_key").alias("_row_key")))
    out = docs.withColumn("_row_key", row_key()).join(keep.select("_row_key").distinct(), "_row_key", "left_semi")
    return out.dropDuplicates(["_row_key", "doc_id"]).select(*docs.columns)


@query("op8_simhash_pigeonring")
def op8(spark, sf_dir):
    return simhash_groups(documents(spark, sf_dir)).select(
        "doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")
