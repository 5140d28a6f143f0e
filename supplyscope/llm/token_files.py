"""Token-id files: Simple-8b words with escapes and section offsets.

A file set is a Parquet table in one folder, written by Spark's own committer (a lost executor
leaves no half file).  A row is one block of whole documents:

* ``part``, ``block``: its place; blocks by (part, block) hold the documents in ascending doc_id order,
* ``ids_before``: ids of the part's earlier blocks, ``n_docs``, ``n_ids``,
* ``payload``: little-endian numbers: section count (u64), escape count (u64), words up to the end of
  each section (u64 each), escapes (u64 each), then the 64-bit words; and
* ``doc_id``, ``doc_ids`` arrays: each document's id and its number of token ids.

A section covers SECTION ids, so any section can be decoded alone, and all words with one selector
are decoded together by shifts.  The top four bits of a word select how many ids of how many bits the
other 60 hold (the last word of a section may hold fewer).  Selector 0 is an escape: the word holds
the place of an id of 60 bits or more in the escape list.

Defined results: a null or empty text has the end id alone; null doc_ids come first; rows that tie
follow in text order, repeated rows one after the other; an empty table gives an empty file set and
result.  Other columns of the input are not read, so their names can't clash.

Scale: texts move once, to key ranges of about equal row counts; each range is encoded and written as
one part, a block at a time.  Counts before a part come from one number a part.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyscope.llm import textops as T
from supplyscope.llm.bpe import Chunks
from supplyscope.session import ensure_checkpoint_dir

#: (ids, bits) by selector; fixed values of the word layout.  Selector 0 is the escape.
LAYOUT = [(1, 60), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
          (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNTS = np.array([n for n, _ in LAYOUT], np.int64)
SECTION = 16_384
#: Chunks whose ids a worker keeps.
KEPT_CHUNKS = 200_000
#: A letter and the signs that follow it up to a space or the end.
END_SIGNS = r"([a-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]+)(?: |$)"
#: Texts of about so many bytes are encoded together.
SLICE_BYTES = 2 << 20
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 262_144


def _runs(fits: np.ndarray, count: int) -> np.ndarray | None:
    """Places from which ``count`` places, or all up to the end, fit; None if there are none."""
    length = 1
    while length < count and fits.any():
        step = min(length, count - length)
        shorter, fits = fits, fits.copy()
        fits[:-step] &= shorter[step:]
        length += step
    return fits if fits.any() else None


def _pack(ids: np.ndarray, escapes: list[int]) -> np.ndarray:
    """The words of one section; large ids go to ``escapes``."""
    n = len(ids)
    large = ids >= np.uint64(1 << 60)
    values = ids
    if large.any():
        values = ids.copy()
        values[large] = np.arange(len(escapes), len(escapes) + int(large.sum()), dtype=np.uint64)
        escapes.extend(ids[large].tolist())
    # The largest count whose ids all fit, from each place on.
    selector = np.full(n, len(LAYOUT) - 1, np.int8)
    for s in range(len(LAYOUT) - 2, 0, -1):
        count, bits = LAYOUT[s]
        fits = values < np.uint64(1 << bits)
        fits &= ~large
        fits = _runs(fits, count)
        if fits is None:
            break  # fewer bits fit in no longer run either
        selector[fits] = s
    selector[large] = 0
    # The places where words start, from the first on: each pass takes as many steps as all before it.
    jump = np.append(np.minimum(np.arange(n) + _COUNTS[selector], n), n)
    at = np.zeros(1, np.int64)
    while True:
        more = jump[at]
        more = more[more < n]
        if not len(more):
            break
        at = np.concatenate([at, more])
        jump = jump[jump]
    at.sort()
    of = selector[at]
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    out = of.astype(np.uint64) << np.uint64(60)
    for s in np.unique(of):
        count, bits = LAYOUT[s]
        mine = np.flatnonzero(of == s)
        ids_of = padded[at[mine][:, None] + np.arange(count)]
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits % 60)
        # The last word of a section may reach into the padding, which is zeros.
        out[mine] |= np.bitwise_or.reduce(ids_of << shifts, axis=1)
    return out


def pack(ids: np.ndarray) -> bytes:
    """The payload of a block's ids (any unsigned 64-bit values)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    escapes: list[int] = []
    words = [_pack(ids[i:i + SECTION], escapes) for i in range(0, len(ids), SECTION)]
    ends = np.cumsum([len(w) for w in words]).astype("<u8")
    head = np.array([len(words), len(escapes)], "<u8")
    return b"".join(x.astype("<u8").tobytes() for x in [head, ends, np.array(escapes, np.uint64), *words])


def unpack(payload: bytes, n_ids: int, section: int | None = None) -> np.ndarray:
    """The ids of a payload, or of one of its sections."""
    raw = np.frombuffer(payload, "<u8")
    sections, n_escapes = int(raw[0]), int(raw[1])
    ends = np.concatenate([[0], raw[2:2 + sections].astype(np.int64)])
    escapes = raw[2 + sections:2 + sections + n_escapes]
    words = raw[2 + sections + n_escapes:]
    lo, hi = (0, sections) if section is None else (section, section + 1)
    sizes = np.minimum(SECTION, n_ids - SECTION * np.arange(lo, hi))
    words = words[ends[lo]:ends[hi]]
    of = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[of]
    # The last word of a section holds what is left of it.
    place = np.cumsum(counts) - counts
    firsts = ends[lo:hi] - ends[lo]
    word_section = np.searchsorted(firsts, np.arange(len(words)), "right") - 1
    began = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    place += (began - place[firsts])[word_section] if len(words) else 0
    total = int(sizes.sum())
    out = np.zeros(total + 60, np.uint64)
    # By falling place within a section no word overwrites another: surplus places of a section's
    # last word are zeros of the next section, so write those words first.
    tail = np.zeros(len(words), bool)
    tail[ends[lo + 1:hi + 1] - ends[lo] - 1] = True
    for late in (True, False):
        for s in np.unique(of[tail == late]):
            count, bits = LAYOUT[s]
            mine = np.flatnonzero((of == s) & (tail == late))
            if late:
                for w in mine[::-1]:
                    k = min(count, int(began[word_section[w]] + sizes[word_section[w]] - place[w]))
                    shifts = np.arange(k, dtype=np.uint64) * np.uint64(bits % 60)
                    got = (words[w] >> shifts) & np.uint64((1 << bits) - 1)
                    out[place[w]:place[w] + k] = escapes[got.astype(np.int64)] if s == 0 else got
                continue
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits % 60)
            got = (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            out[place[mine][:, None] + np.arange(count)] = escapes[got.astype(np.int64)] if s == 0 else got
    return out[:total]


class TextTokenizer:
    """Whole texts to ids by the tokenizers library, with the ids of frequent chunks kept.

    The tokenizer's split drops white space, so a text's ids are those of its chunks.  Chunks of plain
    Latin letters, digits and signs go to the library's model by matches of the split; all others
    through its whole pipeline.  A tokenizer of another make encodes whole texts.

    With ``added``, an added token's string in a text gets that token's id, as the library has it by default (such
    texts go through the library whole); without, it is ordinary text.
    """

    def __init__(self, content: str, added: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = not added
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        # Added tokens may be matched in the normalized text, so in any case.
        self.holds_added = regex.compile("|".join(map(regex.escape, strings)), regex.I).search if strings else None
        # Signs that they all begin with, found faster.
        self.sign = regex.match(r"[!-@\[-`{-~]*", os.path.commonprefix(strings))[0]
        split = self._split_pattern(content)
        self.local = split is not None
        if self.local:
            self.find = regex.compile(split).findall
            self.model = self.tokenizer.model
            self.plain = regex.compile(r"[!-~¡-¬®-ɏ--[İ]]+", regex.V1).fullmatch
            # The library's letters for bytes: printable Latin-1 stands for itself, others from 256 on.
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in set(own)]
            self.letters = {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}
            self.chunks = Chunks(self._chunk, KEPT_CHUNKS)

    @staticmethod
    def _split_pattern(content: str) -> str | None:
        """The split's pattern, if this is the pipeline that chunks may be cut for."""
        import json
        spec = json.loads(content)
        norm = (spec.get("normalizer") or {}).get("normalizers", [])
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if ([x["type"] for x in norm] != ["NFC", "Replace", "Lowercase"] or norm[1]["pattern"] != {"Regex": r"\s+"}
                or [x["type"] for x in pre] != ["Split", "ByteLevel"] or spec.get("post_processor")):
            return None
        split, level = pre
        if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
            return None
        return split["pattern"]["Regex"]

    def _match(self, match: str) -> bytes:
        word = match if match.isascii() else "".join(map(self.letters.__getitem__, match.encode()))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._match(chunk.lower())
        if self.plain(chunk):
            matches = self.find(chunk.lower())
            return self._match(matches[0]) if len(matches) == 1 else b"".join(map(self.chunks.__getitem__, matches))
        return self._whole(chunk)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array (null: none).

        The texts' chunks are told apart by Arrow, so each distinct one is looked up once, and the ids
        of all are gathered by array.  A to Z are lower-cased before, and signs at the end of a Latin
        word cut off, as the split does, so fewer chunks are distinct."""
        texts = pc.fill_null(texts, "")
        whole = np.ones(len(texts), bool)
        if self.local:
            whole[:] = False
            if self.holds_added is not None:
                for i in np.flatnonzero(pc.match_substring(texts, self.sign).to_numpy(zero_copy_only=False)):
                    whole[i] = self.holds_added(texts[int(i)].as_py()) is not None
        out = [np.zeros(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(whole):
            out[i] = np.frombuffer(self._whole(texts[int(i)].as_py()), "<u4")
        plain = np.flatnonzero(~whole)
        if not len(plain):
            return out
        lines = pc.replace_substring(pc.ascii_lower(texts.take(pa.array(plain))), "\n", " ")
        pieces = pc.split_pattern(pc.replace_substring_regex(lines, END_SIGNS, r"\1 \2 "), " ")
        ends = pieces.offsets.to_numpy()
        told = pieces.values.dictionary_encode()
        which = told.indices.to_numpy()
        found = [self.chunks[c] if c else b"" for c in told.dictionary.to_numpy(zero_copy_only=False)]
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) for x in found], np.int64) // 4
        begins = np.cumsum(sizes) - sizes
        held = sizes[which]
        at = np.concatenate([[0], np.cumsum(held)])
        places = np.repeat(begins[which] - at[:-1], held)
        places += np.arange(at[-1])
        ids = ids[places]
        for i, lo, hi in zip(plain, at[ends[:-1]], at[ends[1:]]):
            out[i] = ids[lo:hi]
        return out


def tokenizer(content: str) -> TextTokenizer:
    """The tokenizer of a file's content, as the library has it; a worker keeps one for its later tasks."""
    return T.kept(("tokenizer", zlib.crc32(content.encode())), lambda: TextTokenizer(content, added=True))


_BLOCKS = ("part int, block int, ids_before long, n_docs int, n_ids long, payload binary, "
           "doc_id array<long>, doc_ids array<long>")


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Encode every text, append ``end_id`` and write the ids to ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    T.ship(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        content = f.read()  # goes to the workers with the function below
    n = T.partitions(spark)
    thin = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("key"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = T.range_bounds(thin, "key", n)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy()).astype("int32"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(content)
        end = np.array([end_id], np.uint32)
        names, found, sizes, size, before, number, mine = [], [], [], 0, 0, 0, None

        def block() -> pa.RecordBatch:
            ids = np.concatenate(found)
            row = {"part": mine, "block": number, "ids_before": before, "n_docs": len(names), "n_ids": len(ids),
                   "payload": pack(ids), "doc_id": names, "doc_ids": sizes}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            parts, doc_ids, texts = batch.columns
            for lo, hi in T.chunks(T.utf8(texts)[1], SLICE_BYTES):
                for i, ids in zip(range(lo, hi), t.encode_all(texts.slice(lo, hi - lo))):
                    mine = parts[i].as_py()
                    names.append(doc_ids[i].as_py())
                    found += [ids, end]
                    sizes.append(len(ids) + 1)
                    size += len(ids) + 1
                    if size >= BLOCK_IDS:
                        yield block()
                        names, found, sizes, size, before, number = [], [], [], 0, before + size, number + 1
        if found:
            yield block()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_docs", pa.int32()),
                        ("n_ids", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.list_(pa.int64())),
                        ("doc_ids", pa.list_(pa.int64()))])
    (thin.withColumn("part", part("key")).repartitionById(n, "part")
     .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").select("part", "doc_id", "text")
     .mapInArrow(blocks, _BLOCKS).write.parquet(path))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids before each."""
    stored = spark.read.schema(_BLOCKS).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one number a part
    total, before = 0, {}
    for r in sorted(parts):
        before[r["part"]] = total
        total += r["n"]

    @F.pandas_udf("long")
    def first(part: pd.Series) -> pd.Series:
        return part.map(before).astype("int64")

    return stored.withColumn("start", first("part") + F.col("ids_before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids array<long> of every document."""
    return _read(spark, path, "start long, ids array<long>",
                 lambda ids, start, at: [pa.array(start + at[:-1], pa.int64()), pa.ListArray.from_arrays(
                     pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    def columns(ids, start, at):
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
        return [pa.array(start + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())]

    return _read(spark, path, "start long, n_tokens long, ids_crc32 long", columns)


def _read(spark: SparkSession, path: str, kinds: str, columns) -> DataFrame:
    T.ship(spark)
    names = ["doc_id", *(k.split()[0] for k in kinds.split(", "))]

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                start, n, payload, doc_id, sizes = (c[row] for c in batch.columns)
                ids = unpack(payload.as_buffer(), n.as_py())
                at = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())])
                yield pa.RecordBatch.from_arrays([doc_id.values, *columns(ids, start.as_py(), at)], names=names)

    return (_blocks(spark, path).select("start", "n_ids", "payload", "doc_id", "doc_ids")
            .mapInArrow(docs, f"doc_id long, {kinds}"))


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
