"""Shared array helpers: words and shingles of whole Arrow batches as 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes after lower-casing A-Z (bytes of multi-byte
characters are never white space, so byte and character splitting agree).  The words of a chunk are
told apart by their bytes, in one Arrow dictionary, and each different word is hashed once by XXH3,
which mixes all bytes non-linearly.  The hash depends on the bytes alone, so a recomputed task gives
the same values.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.session import ensure_checkpoint_dir

#: Bytes of text that are hashed together; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

# Fixed odd multipliers (any odd 64-bit numbers do).
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1B54A32D192ED03)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators of plain words: every ASCII byte but letters and digits.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, CHUNK_BYTES + 1)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        # A table for one very long text isn't kept.
        if size <= CHUNK_BYTES + 1:
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that all their bits depend on all bits of the input."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``len + 1`` row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of every word, in text order, and which bytes are separators."""
    n = len(data)
    space = separators[data]
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, space
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = True
    last[inner - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, space


_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32


def word_codes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE, lower: bool = True
               ) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code and row of every word, in text order, and the different words (bytes) by code."""
    starts, ends, row, space = spans(data, offsets, separators)
    held = data[~space]
    if lower:
        held = _LOWER_BYTE[held]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts),
                                             [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(held))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), row, coded.dictionary


#: Hashes of words: digests of 64 bits each for one and two streams.
_DIGESTS = {1: xxhash.xxh3_64_digest, 2: xxhash.xxh3_128_digest}


def word_hashes(different: pa.Array, streams: int = 1) -> np.ndarray:
    """(streams, words): independent 64-bit hashes of each word, for one or two streams."""
    digest = _DIGESTS[streams]
    raw = b"".join([digest(w) for w in different.to_pylist()])
    return np.frombuffer(raw, ">u8").reshape(-1, streams).T.astype(np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE
          ) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, in text order.  ``offsets[0]`` is 0."""
    code, row, different = word_codes(data, offsets, separators)
    return word_hashes(different)[0][code], row


def words_and_beginnings(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lengths: tuple[int, ...]
                         ) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hash and row of every word, and for each length the hash and row of the first so many bytes of
    the words that are longer; in text order.  ``offsets[0]`` is 0.

    These are features' hashes: polynomials over the bytes modulo 2**64, finished by a mixer, of which
    a word and its beginnings share one cumulative sum.  Words can be built that collide."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return *none, [none] * len(lengths)
    space = separators[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = space[:-1]
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = True
    last[inner - 1] = True
    np.logical_not(space, out=space)
    starts, ends = np.flatnonzero(first & space), np.flatnonzero(last & space)
    total = _LOWER[data]
    total *= _power_table(_BASE, n)[:n]
    np.cumsum(total, out=total)
    h = total[ends]
    later = starts > 0
    before = np.zeros(len(starts), np.uint64)
    before[later] = total[starts[later] - 1]
    h -= before
    inverse = _power_table(_INVERSE, n)[starts]
    h *= inverse
    row = np.searchsorted(offsets, starts, "right") - 1
    beginnings = []
    for length in lengths:
        longer = np.flatnonzero(ends - starts >= length)
        part = (total[starts[longer] + length - 1] - before[longer]) * inverse[longer]
        beginnings.append((mix(part + np.uint64(length * int(_STEP) % (1 << 64))), row[longer]))
    return mix(h), row, beginnings


def shingles(word: np.ndarray, row: np.ndarray, rows: int, width: int
             ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the ``rows + 1`` offsets of each row's.

    A row with fewer words, but at least one, has its whole sequence as one shingle.
    """
    count = np.bincount(row, minlength=rows) if rows else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(count)])
    n = len(word)
    held = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.empty(int(held.sum()), np.uint64)
    at = np.concatenate([[0], np.cumsum(held)])
    full = max(0, n - width + 1)
    acc = np.full(full, width, np.uint64)
    for j in range(width):
        acc *= _STEP
        acc += word[j:full + j]
    place = np.ones(len(out), bool)
    for r in np.flatnonzero((count > 0) & (count < width)):
        h = np.array([count[r]], np.uint64)
        for w in word[begin[r]:begin[r + 1]]:
            h = h * _STEP + w
        out[at[r]] = h[0]
        place[at[r]] = False
    if full:
        out[place] = acc[row[:full] == row[width - 1:]]
    return mix(out), at


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row, chunk by chunk."""
    for lo, hi in chunks(offsets):
        at = offsets[lo:hi + 1] - offsets[lo]
        word, row = words(data[offsets[lo]:offsets[hi]], at)
        h, of = shingles(word, row, hi - lo, width)
        for i in range(hi - lo):
            yield distinct(h[of[i]:of[i + 1]])


_shipped: set[str] = set()
_BATCH_BYTES, _DEFAULT_BATCH_BYTES = "16m", "67108864b"


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, through Spark's own file distribution, once a session.

    Arrow batches are held to 16 MB, unless the session names another size than Spark's default:
    some texts and blocks are large, and both sides hold a batch or two."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, _DEFAULT_BATCH_BYTES) == _DEFAULT_BATCH_BYTES:
        spark.conf.set(limit, _BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "supplyscope_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


_slot: list = []


def kept(key, make):
    """A large object with caches that a Python worker keeps for its later tasks.

    There is one place for it: another key's object takes it, and ``forget`` empties it, so that a
    worker doesn't carry one operator's caches through the next one's tasks."""
    if not _slot or _slot[0] != key:
        _slot[:] = [key, make()]
    return _slot[1]


def forget() -> None:
    _slot.clear()


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, for operators that deal rows to numbered partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def range_bounds(df: DataFrame, key: str, n: int) -> np.ndarray:
    """At most ``n - 1`` bounds that cut the long column ``key`` into ranges of about equal rows.

    They come from an approximate percentile of the key column alone, so the other columns are
    read and moved once only.  ``np.searchsorted(bounds, key)`` is the number of a key's range.
    """
    if n < 2:
        return np.zeros(0, np.int64)
    at = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(key, at, max(10_000, 20 * n)).alias("b")).first()["b"]
    return np.unique(np.array(found or [], np.int64))
