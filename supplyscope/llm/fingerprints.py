"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint keeps the ``k`` smallest distinct 64-bit hashes of a text's five-word shingles
(texts with fewer words: the whole sequence as one shingle; texts without words: nothing).
Fingerprints of parts merge into the fingerprint of the whole, and two of them estimate

* resemblance: share of shared hashes among the k smallest of the union,
* containment: estimated shared shingles over the estimated shingles of the contained text,
* distinct shingles: exact below k, else (k - 1) / (k-th smallest as a share of the hash range).

Defined results: a null text is an empty text; an empty text has the empty fingerprint ``""``;
equal texts have equal fingerprints and likeness 1.0, also if both are empty; an empty and a
non-empty text have likeness 0.0.  Rows whose doc_id ties follow in text order; null doc_ids
come first; a single row is its own next document.  An empty table gives an empty result.  Other
columns of the input are not read, so their names can't clash.

Scale: texts move once, dealt to key ranges of about equal row counts, and only the first document
of each range is copied to the range before it.  A task holds one Arrow batch and a chunk's arrays.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

#: Hashes in a fingerprint: the standard error of a likeness of 0.8 is 0.035.
K = 128
#: Words in a shingle.
WIDTH = 5
_RANGE = float(1 << 64)


def to_string(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u8").tobytes()).decode()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def sketches(texts: list[str | None], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The fingerprint of each text as sorted hashes."""
    data, offsets = T.utf8(pa.array(texts, pa.large_string()))
    return [s[:k].copy() for s in T.shingle_sets(data, offsets, width)]


def merge(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The fingerprint of everything that the parts cover."""
    parts = list(parts)
    return T.distinct(np.concatenate(parts))[:k] if parts else np.zeros(0, np.uint64)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1.0) / _RANGE)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared shingles over all shingles of either text."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    h = np.concatenate([a, b])
    h.sort()
    twice = h[1:] == h[:-1]
    union = len(h) - int(np.count_nonzero(twice))
    if union <= k:
        return float(np.count_nonzero(twice)) / union
    first = np.concatenate([[True], ~twice])
    kth = h[first][k - 1]
    return float(np.count_nonzero(twice & (h[1:] <= kth))) / k


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1.0 for an empty a."""
    if len(a) == 0:
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge([a, b], k), k)
    return min(1.0, shared / distinct_count(a, k))


def fingerprint_parts(df: DataFrame, key: str, text: str = "text", k: int = K,
                      width: int = WIDTH) -> DataFrame:
    """One merged fingerprint for each value of ``key`` (for example a source).

    Each task merges what it reads into one sketch a key; those meet in groups salted by task,
    then in one merge a key, so a key with a third of all rows sends k hashes a task.
    Returns key, fingerprint, n_distinct (estimate).
    """
    T.ship(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            data, offsets = T.utf8(batch.column(1))
            for name, s in zip(batch.column(0).to_pylist(), T.shingle_sets(data, offsets, width)):
                held[name] = merge([held[name], s], k) if name in held else s[:k].copy()
            if len(held) > 10_000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "part_key": pa.array(list(held), arrow_kind),
            "part": pa.array([v.astype("<u8").tobytes() for v in held.values()], pa.binary())})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        s = merge((np.frombuffer(x, "<u8") for x in group.part), k)
        return pd.DataFrame({"part_key": group.part_key[:1].to_list(),
                             "part": [s.astype("<u8").tobytes()]})

    @F.pandas_udf("struct<fingerprint:string,n_distinct:double>")
    def final(part: pd.Series) -> pd.DataFrame:
        hs = [np.frombuffer(x, "<u8") for x in part]
        return pd.DataFrame({"fingerprint": [to_string(h) for h in hs],
                             "n_distinct": [distinct_count(h, k) for h in hs]})

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_kind = to_arrow_type(df.schema[key].dataType)
    schema = f"part_key {kind}, part binary"
    parts = df.select(F.col(key).alias("part_key"), F.col(text).alias("t")).mapInArrow(partial, schema)
    salted = (parts.withColumn("salt", F.spark_partition_id() % 32)
              .groupBy("part_key", "salt").applyInPandas(merged, schema))
    once = salted.groupBy("part_key").applyInPandas(merged, schema)
    return once.withColumn("f", final("part")).select(F.col("part_key").alias(key), "f.*")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, is_copy) by range and doc_id; each range ends with the next one's first row.

    Each range is one partition.  The last range is followed by the first.
    """
    T.ship(docs.sparkSession)
    n = T.partitions(docs.sparkSession)
    # Null doc_ids sort before all others; in Python a null would turn the ids into floats.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("key"))
    bounds = T.range_bounds(docs, "key", n)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy()).astype("int32"))

    # A row for each range: its number and smallest key.
    firsts = sorted(docs.groupBy(bucket("key").alias("bucket")).agg(F.min("key").alias("first")).collect())
    before = {r["first"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def targets(key: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, key.to_numpy()).tolist()
        return pd.Series([[b, before[k]] if k in before else [b] for b, k in zip(own, key.tolist())])

    dealt = docs.select("doc_id", "text", F.posexplode(targets("key")).alias("copy", "target"))
    return (dealt.select("doc_id", "text", (F.col("copy") > 0).alias("is_copy"), "target")
            .repartitionById(n, "target")
            .sortWithinPartitions("is_copy", F.col("doc_id").asc_nulls_first(), "text")
            .select("doc_id", "text", "is_copy"))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first code points of ``following``."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def fingerprint_documents(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses (module docstring)."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        copied = False
        size = 0

        def flush():
            texts = [t for _, t in held]
            edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
            own = sketches(texts, k, width)
            other = sketches(edited, k, width)
            strings = [to_string(s) for s in own[:-1]]
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d for d, _ in held[:-1]], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": strings,
                "edited_fingerprint": [to_string(s) for s in other],
                "near_edited": [resemblance(a, b, k) for a, b in zip(own, other)],
                "near_next": [resemblance(a, b, k) for a, b in zip(own, own[1:])]})

        for batch in batches:
            for doc_id, text, is_copy in zip(*(batch.column(i) for i in range(3))):
                if copied:  # only the first of several copies that tie counts
                    continue
                text = text.as_py() or ""
                held.append((doc_id.as_py(), text))
                size += len(text)
                copied = is_copy.as_py()
                if len(held) > 1 and (size > T.CHUNK_BYTES or copied):
                    yield flush()
                    held[:], size = held[-1:], len(text)
        if len(held) > 1:
            yield flush()

    return in_order(docs).mapInArrow(fingerprint, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"))
