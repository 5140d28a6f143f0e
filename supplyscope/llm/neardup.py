"""MinHash near-deduplication with b-bit signatures.

Words and shingles are those of ``textops`` (lower-cased A-Z, split at ASCII white space); a
document's set holds its distinct ``WIDTH``-word shingles as 64-bit hashes, with fewer words the
whole sequence as one shingle.  Two documents are linked if their full sets have a Jaccard
similarity of at least ``PERCENT`` / 100; groups are the connected components of these links.

1. Each document gets K minima (seeded multiply-add permutations of 32 bits), a key for each of
   BANDS bands of ROWS minima, and a signature of the lowest BITS bits of each minimum, packed.
   Pairs at 0.8 miss all bands with probability (1 - 0.8**5)**32 = 3e-6.
2. Documents with equal sets are one class, a node, from here on (its number is a 64-bit hash of the
   set: two different sets among n meet with probability n**2 / 2**65).
3. Nodes that share a bucket with another are dealt to blocks of bounded size: nodes of one
   neighbourhood (the smallest node of their buckets) together, large neighbourhoods over several
   blocks.  Two blocks meet if they have nodes in one bucket, and each block meets itself.
4. A meeting is one row, and one task finds its links: pairs whose signatures' bit counts allow 0.8
   are confirmed on the full sets.  The estimate is corrected for chance agreement,
   (m / K - C) / (1 - C) with C = 2**-BITS, and must reach 0.6: 5.3 standard errors below 0.8.
   Pairs that links found so far connect already are skipped, as they can't change the result, so a
   meeting returns fewer links than it has nodes, never all pairs.

Defined results: null, empty and wordless texts have an empty set, no node and no links; the
component of such a row is its own doc_id.  Null doc_ids never are the smallest of a component that
has others.  Repeated rows are copies like any others.  An empty table gives an empty result.  Other
columns pass through ``deduplicate`` untouched; the working columns are taken apart before joins, so
names can't clash.

Scale: texts are read twice and moved once; buckets are pre-aggregated before the shuffle, and joins on
hot buckets are sort-merge joins that adaptive execution splits.  A group of n near copies costs
(n / BLOCK_NODES)**2 / 2 meetings, which are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import textops as T
from supplyscope.llm.components import components

WIDTH = 5
PERCENT = 80
BANDS, ROWS, BITS = 32, 5, 2
K = BANDS * ROWS
LONGS = K * BITS // 64
#: Candidates need this corrected signature estimate.
LEAST_ESTIMATE = 0.6
#: A block has about so many nodes and so many shingles at most (a single larger set is a block of its own).
BLOCK_NODES = 512
BLOCK_SHINGLES = 1 << 20

_seeds = T.mix(np.arange(1, 2 * K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = (_seeds[:K] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_seeds[K:] >> np.uint64(32)).astype(np.uint32)
_BLOCK = 4096


def minima(hashes: np.ndarray) -> np.ndarray:
    """The K minima of a set of 64-bit hashes (K times 2**32 - 1 for an empty set)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _BLOCK):
        v = np.multiply.outer(_FACTOR, x[i:i + _BLOCK])
        v += _SHIFT[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """Bucket keys (rows, BANDS) of minima (rows, K); the band's number is part of the key."""
    m = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]).copy()
    for r in range(ROWS):
        acc = T.mix(acc + m[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
    return acc.view(np.int64)


def signatures(m: np.ndarray) -> np.ndarray:
    """Packed low bits (rows, LONGS) of minima (rows, K)."""
    per = 64 // BITS
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), LONGS, per)
    at = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(low << at, axis=2).view(np.int64)


def estimate(differing):
    """Similarity by the number of differing signature places, corrected for chance agreement."""
    chance = 2.0 ** -BITS
    return ((K - differing) / K - chance) / (1 - chance)


#: Signatures that differ in more places estimate less than LEAST_ESTIMATE.
MOST_DIFFERING = int(K - K * (LEAST_ESTIMATE * (1 - 2.0 ** -BITS) + 2.0 ** -BITS))


def node_of(hashes: np.ndarray) -> int | None:
    """The node of a sorted set; None for an empty one."""
    if len(hashes) == 0:
        return None
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``keys``, n_shingles, node, bands and signature of each row's ``text``."""
    T.ship(docs.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for batch in batches:
            data, offsets = T.utf8(batch.column(0))
            sizes, nodes, mins = [], [], []
            for s in T.shingle_sets(data, offsets, width):
                sizes.append(len(s))
                nodes.append(node_of(s))
                mins.append(minima(s))
            m = np.array(mins, np.uint32).reshape(len(sizes), K)
            flat = lambda a: pa.array(a.ravel())
            every = lambda n: pa.array(np.arange(0, len(sizes) * n + 1, n), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.ListArray.from_arrays(every(BANDS), flat(band_keys(m))),
                 pa.ListArray.from_arrays(every(LONGS), flat(signatures(m)))],
                names=[*keys, "n_shingles", "node", "bands", "signature"])

    thin = docs.select(F.col("text").cast("string").alias("text"), *keys)
    kinds = "".join(f"{k} {t}, " for k, t in thin.dtypes[1:])
    return thin.mapInArrow(one, f"{kinds}n_shingles long, node long, bands array<long>, signature array<long>")


def _sets(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the chosen nodes; ``chosen``: node and the key of one row that has it."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column(0))
            nodes = batch.column(1).to_pylist()
            found = [(n, s.tobytes()) for n, s in zip(nodes, T.shingle_sets(data, offsets, width)) if node_of(s) == n]
            yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in found], pa.int64()),
                                              "hashes": pa.array([s for _, s in found], pa.binary())})

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("key"), "text")
    # Always by a shuffle of the texts, also where the chosen rows are few, so that plans are alike at every size.
    return (texts.join(chosen.hint("merge"), "key").select("text", "node")
            .mapInArrow(one, "node long, hashes binary").dropDuplicates(["node"]))


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places where packed signature x differs from each row of y."""
    d = x ^ y
    folded = d.copy()
    for s in range(1, BITS):
        folded |= d >> np.uint64(s)
    folded &= np.uint64(sum(1 << i for i in range(0, 64, BITS)))
    return np.bitwise_count(folded).sum(axis=1, dtype=np.int64)


class _Block:
    """Nodes, signatures and sets of one block."""

    def __init__(self, rows: pa.StructArray):
        nodes, signatures, hashes = (rows.field(i) for i in range(3))
        self.nodes = nodes.to_numpy(zero_copy_only=False)
        self.signatures = signatures.flatten().to_numpy().reshape(len(rows), LONGS).view(np.uint64)
        self.sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in hashes]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)


def _links(a: _Block, b: _Block, percent: int) -> tuple[list[int], list[int]]:
    """Links that connect all linked nodes of two blocks (or of one with itself)."""
    same = a is b
    label = np.arange(len(a.nodes) if same else len(a.nodes) + len(b.nodes))
    own = label if same else label[len(a.nodes):]  # views: b's labels
    left, right = [], []
    for i in range(len(a.nodes)):
        first = i + 1 if same else 0
        sizes = b.sizes[first:]
        n = a.sizes[i]
        maybe = ((own[first:] != label[i]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))).nonzero()[0]
        if len(maybe):
            maybe = maybe[_differing(a.signatures[i], b.signatures[first:][maybe]) <= MOST_DIFFERING] + first
        if not len(maybe):
            continue
        # How many of x's hashes each candidate has.
        x = a.sets[i]
        every = np.concatenate([b.sets[j] for j in maybe])
        at = np.searchsorted(x, every)
        at[at == n] = 0
        shared = np.add.reduceat((x[at] == every).astype(np.int64),
                                 np.concatenate([[0], np.cumsum(b.sizes[maybe])[:-1]]))
        for j in maybe[100 * shared >= percent * (n + b.sizes[maybe] - shared)]:
            if own[j] != label[i]:
                left.append(a.nodes[i])
                right.append(b.nodes[j])
                label[label == own[j]] = label[i]
    return left, right


def _linked(meetings: DataFrame, percent: int) -> DataFrame:
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                a = _Block(batch.column(0)[i].values)
                b = _Block(batch.column(1)[i].values) if batch.column(1)[i].is_valid else a
                left, right = _links(a, b, percent)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())],
                                                 names=["a", "b"])

    return meetings.mapInArrow(link, "a long, b long")


def groups(docs: DataFrame, sketched: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(node, label) of all nodes that are linked with another; ``sketched``: the stored sketch with doc_id."""
    banded = sketched.where("node IS NOT NULL").select("node", F.explode("bands").alias("band"))
    shared = (banded.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
              .where("lo < hi").select("band", "lo"))
    members = T.stored(banded.join(shared, "band").distinct(), "members")  # node, band, lo
    around = members.groupBy("node").agg(F.min("lo").alias("around"))

    rows = sketched.join(around, "node")
    chosen = T.stored(rows.groupBy("node", "around").agg(
        F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63))).alias("key"),
        F.max("n_shingles").alias("n_shingles")), "chosen")
    size = chosen.groupBy("around").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(
        F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    placed = T.stored(chosen.join(size, "around").select("node", "key", F.xxhash64(
        "around", F.pmod(F.xxhash64("node"), "blocks")).alias("block")), "placed")

    sets = _sets(docs, placed.select("node", "key"), width)
    signed = sketched.select("node", "signature").join(placed.select("node", "block"), "node").dropDuplicates(["node"])
    blocks = T.stored(sets.join(signed, "node").groupBy("block").agg(
        F.collect_list(F.struct("node", "signature", "hashes")).alias("rows")), "blocks")

    found = members.join(placed, "node").select("band", "block").distinct()
    several = found.groupBy("band").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi")
    found = found.join(several.select("band"), "band", "left_semi")
    x, y = (found.select(F.col("band").alias(f"{s}_band"), F.col("block").alias(s)) for s in "xy")
    meet = x.join(y, (F.col("x_band") == F.col("y_band")) & (F.col("x") < F.col("y"))).select("x", "y").distinct()
    x, y = (blocks.select(F.col("block").alias(s), F.col("rows").alias(f"{s}_rows")) for s in "xy")
    two = meet.join(x, "x").join(y, "y").select("x_rows", "y_rows")
    one = blocks.where(F.size("rows") > 1).select("rows", F.lit(None).cast(blocks.schema["rows"].dataType))
    return components(T.stored(_linked(one.union(two), percent), "links"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = T.stored(sketch(docs, ["doc_id"], width), "sketch")
    labels = groups(docs, sketched, width, percent)
    smallest = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc"))
    labelled = smallest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_label = labelled.groupBy(F.col("label").alias("l")).agg(F.min("doc").alias("component_id"))
    of_node = labelled.join(of_label, F.col("label") == F.col("l")).select("node", "component_id")
    rows = sketched.select("doc_id", "n_shingles", "node")
    return (rows.join(of_node, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one of each group (that of the smallest doc_id), all columns as they are.

    Rows without words stay; rows that repeat in every column stay once.
    """
    names = docs.columns
    row = "_" * max(map(len, names)) + "_row"  # a name that no column has
    hashed = docs.withColumn(row, F.xxhash64(*names))
    thin = hashed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row_hash"), "text")
    sketched = T.stored(sketch(thin, ["doc_id", "row_hash"], width), "sketch")
    labels = groups(thin, sketched, width, percent)
    rows = sketched.select("node", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "row_hash")
    named = (rows.join(labels, "node", "left")
             # A row without words is alone: its label is its own hash.
             .withColumn("label", F.coalesce("label", "node", "row_hash"))
             .withColumn("alone", F.col("node").isNull()))
    first = named.groupBy("alone", "label").agg(F.min("d").alias("d0"))
    stay = (named.join(first, ["alone", "label"]).where("d = d0")
            .groupBy("alone", "label").agg(F.min("row_hash").alias(row)).select(row).distinct())
    return hashed.join(stay, row, "left_semi").dropDuplicates([row]).select(*names)
