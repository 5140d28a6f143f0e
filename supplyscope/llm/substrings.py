"""Substring deduplication: seeds from winnowed anchors, extended both ways to maximal repeats.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A window is ``least`` consecutive words of one document; a
window is a repeat if its words also start in a document with a smaller doc_id.  The union of a
document's repeated windows is its maximal repeats of at least ``least`` words.

1. Anchors.  Word n-grams of GRAM words (a third of ``least`` at most) are hashed, and each window
   selects its smallest gram, the last one of equals.  Windows in a row that select the same gram are that
   gram's territory.  Equal windows select the same gram at the same place, so every repeat holds a seed.
2. Seeds.  Grams that are anchors in two documents at least.
3. Wide extension.  A seed's territory, all words that its windows reach to both sides, is compared as a
   whole: where a smaller document has the same, all its windows are repeats.  That settles copies and
   the inside of long repeats with one row for each territory.
4. Extension by words.  What is left, one document's territories of each kind (edges of repeats, and seeds
   in different surroundings), is extended word by word: each of its windows is met with those of the
   other documents around the same seed.
5. Adjoining windows merge into maximal repeats, and their words are removed.

Comparisons are by hashes: a gram's 64 bits and independent 64 bits of the window or territory, from 128
bits of each different word.

Defined results: null, empty and wordless texts have no words and no repeats.  Repeats within one document
don't count.  Rows that share a doc_id are no smaller than each other; repeated rows are treated alike.
A null doc_id is larger than all others.  An empty table gives an empty result.  Other columns are not
read by ``repeats`` and pass through ``remove_repeats`` untouched.

Scale: no pairs of documents are made.  Each step is an aggregate with a map-side combine (the smallest
document of a territory or window) and a join back to its members, so a passage that a third of all
documents share is a key with one small value, and sort-merge joins on it are split by adaptive
execution.  Texts are moved twice: to the territories to extend by words, and to the repeats to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

LEAST = 50
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def gram_words(least: int) -> int:
    """Words in an anchor: the largest power of two up to a third of the window."""
    return 1 << max(0, (least // 3).bit_length() - 1)


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values, by doubling; each step mixes, so orders of few words can't cancel."""
    if len(h) < width:
        return h[:0]
    size = 1
    while 2 * size <= width:
        h = T.mix(h[:-size] * _A + h[size:])
        size *= 2
    rest = width - size
    return T.mix(h[:-rest] * _B + h[rest:]) if rest else h


def winnowed(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the smallest, the last one of equals."""
    if len(g) < width:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(g)), 1
    while size < width:
        step = min(size, width - size)
        later = g[step:] <= g[:-step]
        at = np.where(later, at[step:], at[:-step])
        g = np.where(later, g[step:], g[:-step])
        size += step
    return at


class _Windows:
    """The windows of a chunk of documents: row, place, hash and anchor of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        code, row, different = T.word_codes(data, offsets, lower=False)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offsets) - 1))])
        width = gram_words(least)
        first, second = T.word_hashes(different, 2) if len(different) else np.zeros((2, 0), np.uint64)
        g = grams(first[code], width)
        anchor = winnowed(g, least - width + 1)
        inside = row[:len(anchor)] == row[least - 1:] if len(anchor) else np.zeros(0, bool)
        self.start = np.flatnonzero(inside)        # places in the chunk
        self.row = row[self.start]
        anchor = anchor[self.start]
        self.gram = g[anchor]
        self.before = (anchor - self.start).astype(np.uint64)  # words of the window before its anchor
        self.hash = grams(second[code], least)[self.start]
        # First windows of territories.
        self.runs = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else self.start

    def place(self, i: np.ndarray) -> np.ndarray:
        return self.start[i] - self.begin[self.row[i]]

    def territories(self) -> tuple[np.ndarray, ...]:
        """Row, gram, hash, first and last window of each territory."""
        lo = self.runs
        hi = np.concatenate([lo[1:], [len(self.start)]]).astype(np.int64) - 1 if len(lo) else lo
        size = (hi - lo).astype(np.uint64)
        # The first and last window overlap, so together they tell all words.
        area = T.mix(T.mix(self.hash[lo] * _A + self.hash[hi]) * _B + self.before[lo] * np.uint64(1 << 32) + size)
        return self.row[lo], self.gram[lo], area, self.place(lo), self.place(hi)


def _parts(texts: pa.Array, least: int) -> Iterator[tuple[int, int, _Windows]]:
    data, offsets = T.utf8(texts)
    for lo, hi in T.chunks(offsets):
        yield lo, hi, _Windows(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], least)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null ids last) and a text hash, by which repeated doc_ids are told apart; and the text."""
    text = F.col("text").cast("string")
    return docs.select(_doc().alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))


def anchors(keyed: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, text_hash, gram, area, first, last): the territories of all documents."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for batch in batches:
            for lo, hi, windows in _parts(batch.column(2), least):
                row, gram, area, first, last = windows.territories()
                own = [batch.column(i).slice(lo, hi - lo).take(pa.array(row)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(gram.view(np.int64)), pa.array(area.view(np.int64)), pa.array(first.astype(np.int32)),
                     pa.array(last.astype(np.int32))], names=["doc", "text_hash", "gram", "area", "first", "last"])

    return keyed.mapInArrow(one, "doc long, text_hash long, gram long, area long, first int, last int")


def _windows(wanted: DataFrame, least: int) -> DataFrame:
    """(doc, text_hash, place, around, hash) of the windows in the wanted territories (a list a row)."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, windows in _parts(batch.column(2), least):
                place = windows.place(np.arange(len(windows.start)))
                at = np.searchsorted(windows.row, np.arange(hi - lo + 1))
                chosen = []
                for r in range(hi - lo):
                    areas = batch.column(3)[lo + r].values
                    own = place[at[r]:at[r + 1]]
                    for a, b in zip(areas.field(0).to_pylist(), areas.field(1).to_pylist()):
                        chosen.append(np.arange(*np.searchsorted(own, [a, b + 1])) + at[r])
                i = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                own = [batch.column(k).slice(lo, hi - lo).take(pa.array(windows.row[i])) for k in (0, 1)]
                around = T.mix(windows.gram[i] + windows.before[i] * _B)
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(place[i].astype(np.int32)), pa.array(around.view(np.int64)),
                     pa.array(windows.hash[i].view(np.int64))], names=["doc", "text_hash", "place", "around", "hash"])

    return (wanted.select("doc", "text_hash", "text", "areas")
            .mapInArrow(one, "doc long, text_hash long, place int, around long, hash long"))


def _spans(keyed: DataFrame, least: int) -> DataFrame:
    """(doc, text_hash, spans): starts and ends of repeated stretches, not merged yet."""
    found = T.stored(anchors(keyed, least), "anchors")
    kinds = found.groupBy("gram", "area").agg(F.min("doc").alias("smallest"), F.max("doc").alias("largest"))
    seeds = (kinds.groupBy("gram").agg(F.min("smallest").alias("lo"), F.max("largest").alias("hi"), F.count("*").alias("n"))
             .where("lo < hi").select("gram", (F.col("n") > 1).alias("several")))
    told = kinds.join(seeds, "gram").where("smallest < largest OR several").select("gram", "area", "smallest", "several")
    members = T.stored(found.join(told, ["gram", "area"])
                       .select("doc", "text_hash", "first", "last", (F.col("doc") > F.col("smallest")).alias("whole"), "several")
                       .where("whole OR several"), "seeds")
    wide = members.where("whole").select("doc", "text_hash", F.col("first").alias("start"), (F.col("last") + least).alias("end"))

    wanted = (members.where("NOT whole").groupBy("doc", "text_hash")
              .agg(F.collect_set(F.struct("first", "last")).alias("areas")))
    windows = T.stored(_windows(keyed.join(wanted, ["doc", "text_hash"]), least), "windows")
    earlier = (windows.groupBy("around", "hash").agg(F.min("doc").alias("smallest"), F.max("doc").alias("largest"))
               .where("smallest < largest").select("around", "hash", "smallest"))
    narrow = (windows.join(earlier, ["around", "hash"]).where("doc > smallest")
              .select("doc", "text_hash", F.col("place").alias("start"), (F.col("place") + least).alias("end")))
    return (wide.unionByName(narrow).groupBy("doc", "text_hash")
            .agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of overlapping or adjoining ones."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def _cut(rows: DataFrame, keep: list[str], kinds: str) -> DataFrame:
    """``keep``, n_words, n_removed, spans (merged) and the text without their words of each row (text, spans)."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.utf8(batch.column(0))
            texts, counts, removed, spans = [], [], [], []
            for i in range(len(batch)):
                raw = data[offsets[i]:offsets[i + 1]]
                starts, ends, _, space = T.spans(raw, np.array([0, len(raw)]))
                counts.append(len(starts))
                gone = np.zeros(len(starts) + 1, np.int64)
                held = batch.column(1)[i].values
                if held is not None and len(held):
                    a, b = merged(*(held.field(k).to_numpy() for k in (0, 1)))
                    gone[a] += 1
                    gone[b] -= 1
                    spans.append(list(zip(a.tolist(), b.tolist())))
                else:
                    spans.append([])
                stay = np.cumsum(gone)[:-1] == 0
                removed.append(int(len(starts) - stay.sum()))
                # Words and one space after each, all bytes of words that stay.
                lengths = (ends - starts)[stay]
                of = np.zeros(len(raw) + 1, np.int64)
                of[starts[stay]] += 1
                of[ends[stay]] -= 1
                words = raw[np.cumsum(of)[:-1] > 0]
                at = np.cumsum(lengths)
                joined = np.full(len(words) + max(0, len(lengths) - 1), 32, np.uint8)
                place = np.ones(len(joined), bool)
                place[at[:-1] + np.arange(len(at) - 1)] = False
                joined[place] = words
                texts.append(joined.tobytes())
            pairs = pa.StructArray.from_arrays(
                [pa.array([x[k] for s in spans for x in s], pa.int32()) for k in (0, 1)], names=["start", "end"])
            cut = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.ListArray.from_arrays(cut, pairs), pa.array(texts, pa.binary()).cast(pa.string())],
                names=[*keep, "n_words", "n_removed", "spans", "kept_text"])

    return rows.select("text", "spans", *keep).mapInArrow(
        one, f"{kinds}n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (its maximal repeats as places of words, ends
    excluded) and kept_text (the words that stay, joined by one space)."""
    if least < 1:
        raise ValueError("a window has one word at least")
    T.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _spans(_keyed(docs), least)
    rows = docs.withColumns({"doc": _doc(), "text_hash": F.xxhash64("text")}).join(found, ["doc", "text_hash"], "left")
    return _cut(rows, ["doc_id"], "doc_id long, ")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All columns of ``docs``; texts that hold repeats have their kept words, joined by one space, others are as
    they were."""
    T.ship(docs.sparkSession)
    names = docs.columns
    doc, mark = (("_" * max(map(len, names))) + s for s in ("doc", "hash"))  # names that no column has
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _spans(_keyed(thin), least).select(F.col("doc").alias(doc), F.col("text_hash").alias(mark), "spans")
    cut = _cut(_keyed(thin).dropDuplicates(["doc", "text_hash"])
               .join(found, (F.col("doc") == F.col(doc)) & (F.col("text_hash") == F.col(mark))),
               ["doc", "text_hash"], "doc long, text_hash long, ")
    cut = cut.select(F.col("doc").alias(doc), F.col("text_hash").alias(mark), F.col("kept_text").alias(doc + "text"))
    marked = docs.withColumns({doc: _doc(), mark: F.xxhash64(F.col("text").cast("string"))})
    return (marked.join(cut, [doc, mark], "left")
            .select(*[F.coalesce(F.col(doc + "text"), F.col("text").cast("string")).alias("text") if n == "text"
                      else F.col(f"`{n}`") for n in names]))
