"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The vocabulary is a rank file (base64 of a token's bytes, its id; ids are merge ranks) and a pattern
that splits a text into matches encoded separately.  For a match, the table holds for every byte
prefix the last token of that prefix's encoding.  It is unique: a token t that ends at byte i and
starts at byte j is the one exactly if t is stable on its own and after the last token at j.  Two
tokens are stable side by side if no merge across their seam comes before the merges that built the
tokens next to the seam.  So

* appending bytes extends the table and leaves what is there as it is (exact appends),
* an edit cuts the table at its first byte and extends it again; matches that end before the edit
  or begin behind it, where the split has met the old one again, keep their ids.

A whole match that is a token is that token, as the tiktoken library has it.  Workers keep the bytes
of the ids of frequent text chunks (runs between single spaces or line ends) for the next texts.

Defined results: a null or empty text has no ids; every text round-trips, whatever its characters;
repeated rows give repeated rows; an empty table gives an empty result.  Other columns pass through
untouched where ``encode`` is given them; the ids' column must have a free name (ValueError).

Scale: one pass, no shuffle.  The vocabulary (the file's size bounds it) goes to every worker.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

#: The default split, a fixed value of the public vocabulary.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks whose ids a worker keeps; the cache is emptied when full.
KEPT_CHUNKS = 220_000
#: Prefixes of matches whose last tokens a worker keeps (only of matches up to LONG_WORD bytes).
KEPT_PREFIXES = 500_000
LONG_WORD = 64
KEPT_SEAMS = 250_000
_NEVER = 1 << 62
_OTHER_SPACE = re.compile(r"[^\S \n]")
_UNMADE, _BYTE = (-2, -2), (-1, -1)


class Vocabulary:
    """Ranks of a byte-level BPE and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self._sizes = {i: len(b) for b, i in ranks.items()}
        #: Ends of tokens: the id if an end is a token itself, else -1.
        self._ends = {b[k:]: -1 for b in ranks for k in range(len(b))} | ranks
        self._split: dict[int, tuple[int, int]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._seams: dict[tuple[int, int], bool] = {}
        self._prefixes: dict[bytes, int] = {}

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        """From the content of a rank file."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a})

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; marks for single bytes and for tokens no merge makes."""
        found = self._split.get(token)
        if found is None:
            found = self._split[token] = self._last_merge(token)
        return found

    def _last_merge(self, token: int) -> tuple[int, int]:
        word = self.bytes[token]
        if len(word) == 1:
            return _BYTE
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            pairs = [(self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(pairs)
            if rank == _NEVER:
                return _UNMADE
            if len(parts) == 2:
                return self.ranks[parts[0]], self.ranks[parts[1]]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return _UNMADE

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that lie at one end of ``token`` while it is built, each with the rank that ends it."""
        held = self._right if side else self._left
        found = held.get(token)
        if found is None:
            found, t, until = [], token, _NEVER
            while t >= 0:
                found.append((t, until))
                until, t = t, self.split(t)[side]
            held[token] = found
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is a, b."""
        key = (a, b)
        known = self._seams.get(key)
        if known is None:
            if len(self._seams) > KEPT_SEAMS:
                self._seams.clear()
            known = self._seams[key] = self._stable(a, b)
        return known

    def _stable(self, a: int, b: int) -> bool:
        if self.split(b) is _UNMADE:
            return False
        left, right = self._edge(a, 1), self._edge(b, 0)
        i, k = len(left) - 1, len(right) - 1
        # Follow the two tokens that touch the seam from single bytes up to a and b.
        while True:
            (x, x_until), (y, y_until) = left[i], right[k]
            merged = self.ranks.get(self.bytes[x] + self.bytes[y])
            # Merges of one rank run from left to right: x's own goes before, y's own after.
            if merged is not None and merged < x_until and merged <= y_until:
                return False
            if i == 0 and k == 0:
                return True
            if x_until <= y_until:
                i -= 1
            else:
                k -= 1

    def candidates(self, word: bytes, i: int) -> list[tuple[int, int]]:
        """(begin, token) of all tokens that end at byte ``i``, the longest last."""
        found, j = [], i - 1
        t = self._ends.get(word[j:i])
        while t is not None:
            if t >= 0:
                found.append((j, t))
            if j == 0:
                break
            j -= 1
            t = self._ends.get(word[j:i])
        return found

    def last(self, word: bytes, i: int, before) -> int:
        """The last token of ``word``'s first ``i`` bytes; ``before(j)`` is that of its first ``j``."""
        seams = self._seams
        for j, t in reversed(self.candidates(word, i)):
            if j == 0:
                if self.split(t) is not _UNMADE:
                    return t
                continue
            a = before(j)
            ok = seams.get((a, t))
            if self.stable(a, t) if ok is None else ok:
                return t
        raise ValueError(f"the vocabulary lacks the byte {word[i - 1]}")

    def extend(self, table: list[int], word: bytes) -> list[int]:
        """Add to ``table``, the last tokens of ``word``'s first prefixes, those of all the others."""
        for i in range(len(table) + 1, len(word) + 1):
            table.append(self.last(word, i, lambda j: table[j - 1]))
        return table

    def read(self, table: list[int]) -> list[int]:
        """The ids that a table's last entry ends."""
        ids, i = [], len(table)
        while i:
            ids.append(table[i - 1])
            i -= len(self.bytes[ids[-1]])
        return ids[::-1]

    def encode(self, word: bytes) -> list[int]:
        """The ids of one match of the pattern; its prefixes' last tokens serve later matches too."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(word) > LONG_WORD:
            return self.read(self.extend([], word))
        known = self._prefixes
        if len(known) > KEPT_PREFIXES:
            known.clear()
        n = i = len(word)
        while i and word[:i] not in known:
            i -= 1
        while i < n:
            i += 1
            known[word[:i]] = self.last(word, i, lambda j: known[word[:j]])
        ids = []
        while i:
            ids.append(t := known[word[:i]])
            i -= self._sizes[t]
        return ids[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Encoding:
    """A text with its matches, their tables and ids; appends and edits redo only what they touch."""

    def __init__(self, vocabulary: Vocabulary, text: str = "", pattern: str = PATTERN):
        self.vocabulary, self.text = vocabulary, ""
        self.pattern = regex.compile(pattern)
        self.matches: list[tuple[int, int, list[int]]] = []  # begin, end, table
        self.extended = 0  # prefixes computed so far
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace ``text[start:stop]``."""
        old, text = self.matches, self.text[:start] + new + self.text[stop:]
        shift = len(text) - len(self.text)
        # A match looks at two characters behind its end at most.
        kept = 0
        while kept < len(old) and old[kept][1] + 2 <= start:
            kept += 1
        matches = old[:kept]
        later = {b + shift: i for i, (b, _, _) in enumerate(old) if b >= stop}
        at = matches[-1][1] if matches else 0
        while (m := self.pattern.search(text, at)) is not None:
            begin, end = m.span()
            i = later.get(begin)
            if i is not None and begin >= start + len(new):
                matches += [(b + shift, e + shift, t) for b, e, t in old[i:]]
                break
            matches.append((begin, end, self._table(text[begin:end], begin, old, kept, start)))
            at = end
        self.text, self.matches = text, matches

    def _table(self, match: str, begin: int, old: list, kept: int, start: int) -> list[int]:
        word, table = match.encode(), []
        for b, e, t in old[kept:kept + 2]:
            if b == begin:  # the same match up to the edit
                same = min(len(match), e - b, max(0, start - b))
                table = t[:len(match[:same].encode())]
        self.extended += len(word) - len(table)
        return self.vocabulary.extend(table, word)

    @property
    def ids(self) -> list[int]:
        out = []
        for b, e, table in self.matches:
            whole = self.vocabulary.ranks.get(self.text[b:e].encode())
            out += [whole] if whole is not None else self.vocabulary.read(table)
        return out


def splits_at_spaces(text: str) -> bool:
    """Whether single spaces and line ends are all the white space, with none at the text's ends."""
    return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text
                or "\n " in text or _OTHER_SPACE.search(text))


class Chunks(dict):
    """Little-endian 32-bit ids of text chunks, made when first asked for.

    Two generations of entries: when the younger is full, it becomes the older one, from which
    entries come back when asked for again, so frequent chunks stay.
    """

    def __init__(self, encode, most: int = KEPT_CHUNKS):
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.encode(chunk)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found


class TextEncoder:
    """Whole texts to bytes of ids and back."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self.local = pattern == PATTERN
        self.chunks = Chunks(self._chunk)
        self.four = {i: i.to_bytes(4, "little") for i in vocabulary.bytes}

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.four.__getitem__, self.vocabulary.encode(word.encode())))

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._word, self.find(text)))

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # one match, with the space before it
            return self._word(" " + chunk)
        body, end = chunk[:-1], chunk[-1]
        if end in ".," and body.isalpha():
            return self._word(" " + body) + self._word(end)
        # A chunk that begins with a line end follows that; any other follows a space.
        return self._pieces(chunk if chunk[0] == "\n" else " " + chunk)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.local or not splits_at_spaces(text):
            return self._pieces(text)
        # Each space belongs to what follows, and each line end is a match.
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._pieces(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4").tolist())


def encoder(content: bytes, pattern: str = PATTERN) -> TextEncoder:
    """The encoder of a rank file's content; a worker keeps one for its later tasks."""
    key = ("bpe", hashlib.sha256(content).digest(), pattern)
    return T.kept(key, lambda: TextEncoder(Vocabulary.parse(content), pattern))


def _content(df: DataFrame, vocabulary: str) -> bytes:
    """The rank file's content, which goes to the workers with the functions that use it."""
    T.ship(df.sparkSession)
    with open(vocabulary, "rb") as f:
        return f.read()


def encode(df: DataFrame, vocabulary: str, pattern: str = PATTERN, text: str = "text",
           ids: str = "ids") -> DataFrame:
    """All columns but the text, and its ids as array<int> (``ids`` below 2**31)."""
    others = [c for c in df.columns if c != text]
    if ids in others:
        raise ValueError(f"the table has a column {ids!r} already")
    content = _content(df, vocabulary)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(content, pattern)
        for batch in batches:
            found = [e.encode(t.as_py() or "") for t in batch.column(0)]
            at = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(at), values)],
                                             names=[*others, ids])

    # Plain names on the way in: mapInArrow takes dots in names for fields.
    thin = df.select(F.col(f"`{text}`").cast("string").alias("text"),
                     *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    from pyspark.sql.types import ArrayType, IntegerType, StructType
    schema = StructType([*(df.schema[c] for c in others)]).add(ids, ArrayType(IntegerType()))
    return thin.mapInArrow(one, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """All columns and the bytes of the ids (null ids: none)."""
    content = _content(df, vocabulary)

    @F.pandas_udf("binary")
    def one(column):
        v = encoder(content).vocabulary
        return column.map(lambda x: v.decode(x.tolist() if x is not None else []))

    return df.withColumn(to, one(F.col(ids)))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document's whole text."""
    content = _content(docs, vocabulary)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(content, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = e.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(one, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
