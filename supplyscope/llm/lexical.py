"""Ranked lexical search by presence masks.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` (ASCII letters and digits and all
other characters), with A-Z lower-cased.  The score of a document for an item sums, over the item's different
terms that the document holds,

    w * ((1000000000 * tf) div (1000 * tf + 20 * m)),  w = floor(1000 ln((2 N + 2) / (2 df + 1))),
    m = 100 - 50 + ((50 * n * N) div L)

with the N documents that have a term, their L terms, n terms of the document, tf of them the term, which
df documents hold; all but w in 64-bit integers.

1. One pass over the texts stores, for each document that holds a term of an item, its n and the
   occurrences of those terms, and counts N, L and df.
2. A task deals its documents to segments.  A segment has a bitmap over its documents for each term; an item
   takes those of its terms, and turned round they give each document's mask of matched terms.  Documents
   are grouped by mask, and a mask's score is at most the sum of its terms' weights times their largest
   factor in the segment.
3. Masks are evaluated by descending bound, some at a time, until the k-th best score, which all segments
   of the task share, is above the next bound: no document left can reach it, ties included.
4. The k best of each task and item meet in a ranking by item.

Items are taken in blocks of bounded size: a block's terms go to the tasks with their functions, and each
block is a pass over the texts.

Defined results: a null text has no terms; documents without a term of the item aren't ranked, nor are those
with score 0 (terms that all documents hold may weigh 0).  Every row of the documents is a document,
repeated rows too.  Equal scores rank by doc_id, null ids last.  Items that repeat in id and text count
once; texts that share an item_id are ranked each.  Items without terms and empty tables give no rows.
Other columns are not read.

Scale: texts are read once a block and not moved; stored is a number pair for each match of a term; a task
sends k rows an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

K = 50
#: Text of the items of a block (an item with a longer text is a block of its own).
BLOCK_BYTES = 1 << 20
#: Documents and matches of a segment.
SEGMENT_ROWS = 1 << 15
SEGMENT_MATCHES = 1 << 22
#: Documents that are scored together at first; each further step of an item takes four times as many.
FIRST_STEP = 2048

_LAST = np.iinfo(np.int64).max


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code and row of each term of each text, and the different terms by code."""
    data, offsets = T.utf8(texts)
    return T.word_codes(data, offsets, T.SIGNS)


@dataclass
class Items:
    """A block of items: their different terms, and each item's numbers of them."""

    ids: list
    vocabulary: pa.Array
    terms: list[np.ndarray]


def _block(rows: list) -> Items:
    code, row, different = terms(pa.array([r["text"] or "" for r in rows], pa.string()))
    cut = np.searchsorted(row, np.arange(len(rows) + 1))
    return Items([r["item_id"] for r in rows], different, [np.unique(code[a:b]) for a, b in zip(cut, cut[1:])])


def blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES of text."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))))
    for i in range(n):
        rows = dealt.where(F.col("block") == i).select("item_id", "text").collect()
        held = _block(rows)
        some = [j for j, t in enumerate(held.terms) if len(t)]
        if some:
            yield Items([held.ids[j] for j in some], held.vocabulary, [held.terms[j] for j in some])


def matches(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term at all; terms: numbers in the vocabulary, ascending."""
    T.ship(docs.sparkSession)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T.forget()
        for batch in batches:
            data, offsets = T.utf8(batch.column(1))
            for lo, hi in T.chunks(offsets):
                code, row, different = T.word_codes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], T.SIGNS)
                known = pc.fill_null(pc.index_in(different, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                n = np.bincount(row, minlength=hi - lo)
                term = known[code]
                found = term >= 0
                pair, tf = np.unique(row[found] * np.int64(len(vocabulary)) + term[found], return_counts=True)
                of, term = np.divmod(pair, max(1, len(vocabulary)))
                some = np.flatnonzero(n)
                cut = np.searchsorted(of, np.concatenate([some, [hi - lo]])).astype(np.int32)
                # Documents without a term have no matches, so the cuts of the others adjoin.
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some].astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(tf.astype(np.int64)))],
                    names=["doc_id", "n", "terms", "tfs"])

    thin = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return thin.mapInArrow(one, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Best:
    """The k best (score, doc_id) of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document with a lower score is not among them."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        some = score >= self.least
        score, doc = np.concatenate([self.score, score[some]]), np.concatenate([self.doc, doc[some]])
        order = np.lexsort((doc, -score))[:self.k]
        self.score, self.doc = score[order], doc[order]


class Segment:
    """Bitmaps and factors of some documents, by term."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.doc = doc
        order = np.argsort(term, kind="stable")
        self.of, term, tf = of[order], term[order], tf[order]
        self.factor = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.of])
        self.terms, begin = np.unique(term, return_index=True)
        self.begin = np.concatenate([begin, [len(term)]])
        self.most = np.maximum.reduceat(self.factor, begin) if len(term) else self.factor

    def bitmap(self, at: int) -> np.ndarray:
        bits = np.zeros(len(self.doc), bool)
        bits[self.of[self.begin[at]:self.begin[at + 1]]] = True
        return bits

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        """Raise ``best`` by the documents of the segment, for an item with these terms."""
        at = np.searchsorted(self.terms, wanted)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)] if len(self.terms) else at[:0]
        if not len(at):
            return
        w = weights[self.terms[at]]
        if int((w * self.most[at]).sum()) < best.least:
            return
        # Term bitmaps, packed across terms: a row of bytes, the mask, for each document.
        masks = np.ascontiguousarray(np.packbits(np.stack([self.bitmap(a) for a in at]), axis=0).T)
        wide = masks.shape[1]
        if wide <= 8:
            keys = np.zeros((len(masks), 8), np.uint8)
            keys[:, :wide] = masks
            keys = keys.view(np.uint64).ravel()
        else:
            keys = masks.view(f"V{wide}").ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        bits = np.unpackbits(masks[first], axis=1, count=len(at)).astype(np.int64)
        bound = bits @ (w * self.most[at])
        # Documents by their mask's bound, highest first; the empty mask has bound 0.
        place = np.argsort(-bound[group], kind="stable")
        bounds = bound[group][place]
        done, step = 0, FIRST_STEP
        while done < len(place) and bounds[done] >= max(1, best.least):
            end = min(len(place), done + step)
            # Whole masks only.
            end = int(np.searchsorted(-bounds, -bounds[end - 1], "right"))
            self._score(place[done:end], at, w, best)
            done, step = end, step * 4

    def _score(self, docs: np.ndarray, at: np.ndarray, w: np.ndarray, best: _Best) -> None:
        chosen = np.zeros(len(self.doc), bool)
        chosen[docs] = True
        total = np.zeros(len(self.doc), np.int64)
        for a, weight_ in zip(at, w):
            of = self.of[self.begin[a]:self.begin[a + 1]]
            mine = chosen[of]
            total[of[mine]] += weight_ * self.factor[self.begin[a]:self.begin[a + 1]][mine]
        best.add(total[docs], self.doc[docs])


def _ranked(found: DataFrame, items: Items, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in items.terms]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            doc, n, of, term, tf, base = [], [], [], [], [], 0
            for b in held:
                size = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
                doc.append(pc.fill_null(b.column(0), _LAST).to_numpy(zero_copy_only=False))
                n.append(b.column(1).to_numpy())
                of.append(np.repeat(np.arange(base, base + len(b)), size))
                term.append(b.column(2).flatten().to_numpy())
                tf.append(b.column(3).flatten().to_numpy())
                base += len(b)
            held.clear()
            m = 50 + np.array([50 * int(x) * documents // length for x in np.concatenate(n)], np.int64)
            segment = Segment(np.concatenate(doc), m, *(np.concatenate(x) for x in (of, term, tf)))
            for wanted, b in zip(items.terms, best):
                segment.search(wanted, weights, b)

        rows = matched = 0
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                held.append(part)
                rows += len(part)
                matched += len(part.column(2).flatten())
                if rows >= SEGMENT_ROWS or matched >= SEGMENT_MATCHES:
                    search()
                    rows = matched = 0
        if held:
            search()
        size = [len(b.score) for b in best]
        doc = np.concatenate([b.doc for b in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), size)), pa.array(doc),
             pa.array(np.concatenate([b.score for b in best]))], names=["item", "doc", "score"])

    tops = found.where(F.size("terms") > 0).mapInArrow(one, "item int, doc long, score long")
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (module docstring)."""
    spark = docs.sparkSession
    kind = items.select("item_id").schema["item_id"].dataType
    out = None
    for block in blocks(items):
        found = T.stored(matches(docs, block.vocabulary), "matches")
        documents, length = found.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        df = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = np.array([weight(documents, df.get(i, 0)) for i in range(len(block.vocabulary))], np.int64)
        ranked = _ranked(found, block, weights, documents, length, k)
        # The items' ids, a row each, by their number in the block.
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind.simpleString()}")
        part = ranked.join(names, "item").select(
            "item_id", "rank", F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out
