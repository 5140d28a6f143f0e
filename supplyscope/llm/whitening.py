"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

A vector's entries c become longs x = floor(256 c).  The fit list is each distinct x once: n rows with
sums S by dimension.  With X the fit list's centred rows, each step multiplies X by one vector and X'
by the result, in one pass of Spark tasks over the stored fit list:

    u_k = (X v_k - beta_(k-1) u_(k-1)) / alpha_k,    v_(k+1) = (X'u_k - alpha_k v_k) / beta_k.

A left vector has a number for each row of the fit list.  It is not stored but held as the short
vector w_k with u_k = X w_k, from which tasks compute it again; so the driver holds vectors of the
embedding's dimension only, and a lost executor loses nothing.  Both sides are reorthogonalised fully
in each step: U'p = W'(X'p) needs no further pass unless p shrinks, when it is measured once more.
The singular values of the small bidiagonal matrix over sqrt(n) are the deviations, its right vectors
give the components.

Steps end when the components asked for have a residual below ``RESIDUAL`` of the largest singular
value and the variance not yet in the bidiagonal matrix can't hold a larger one, or when all dimensions
are used.  If a product vanishes (a subspace is complete), the next step starts from a fresh random
vector, so equal eigenvalues are all found.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and
those with an entry whose x is beyond a long.  Vectors of different lengths are fitted apart.  Repeated
rows are returned each, and count once in the fit.  Components that explain nothing (below
``NO_VARIANCE`` of the largest eigenvalue: fewer distinct vectors than components, or constant ones)
are left out, so a table whose vectors are all equal gives no components.  Equal eigenvalues have no
unique components; any orthonormal ones are returned, the same for all rows.  A component's entry of
largest size is positive.  A deviation beyond a long is null.  An empty table gives an empty result.
Null ids are kept.  Other columns are not read.

Scale: vectors are shuffled once, to find the distinct ones (copies meet in the map-side combine); a pass
reads the fit list as blocks of ``BLOCK_BYTES`` and shuffles one number a dimension and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyscope.llm import textops as T

SCALE = 256
COMPONENTS = 4
BLOCK_BYTES = 1 << 20
RESIDUAL = 1e-14
NO_VARIANCE = 1e-13
SEED = 11

_LONG = 2.0**63


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, x): the valid vectors as little-endian longs."""
    T.ship(df.sparkSession)
    thin = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                bad = ~((x >= -_LONG) & (x < _LONG))  # also what is null, NaN or infinite
            keep = lengths > 0
            of = np.repeat(np.arange(len(lengths)), lengths)
            keep[of[bad]] = False
            x = x[keep[of]].astype("<i8")
            at = np.concatenate([[0], np.cumsum(8 * lengths[keep])]).astype(np.int64)
            xs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()),
                                                                                   pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), pa.array(lengths[keep].astype(np.int32)), xs.cast(pa.binary())],
                names=["vec_id", "dim", "x"])

    return thin.mapInArrow(one, f"vec_id {thin.dtypes[0][1]}, dim int, x binary")


def _matrix(x: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<i8").reshape(-1, dim)


def fit_list(vectors: DataFrame) -> DataFrame:
    """(dim, rows, block): each distinct vector once, packed into blocks, stored."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}

        def block(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "rows": pa.array([len(rows)], pa.int64()),
                                               "block": pa.array([b"".join(rows)], pa.binary())})

        size = 0
        for batch in batches:
            for dim, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(dim, []).append(x)
                size += len(x)
                if len(held[dim]) * dim * 8 >= BLOCK_BYTES:
                    size -= len(held[dim]) * dim * 8
                    yield block(dim)
                elif size >= 8 * BLOCK_BYTES:  # many lengths, each with little
                    for d in list(held):
                        yield block(d)
                    size = 0
        for d in list(held):
            yield block(d)

    distinct = vectors.select("dim", "x").dropDuplicates(["dim", "x"])
    return T.stored(distinct.mapInArrow(pack, "dim int, rows long, block binary"), "whitening-fit-list")


def _summed(blocks: DataFrame, dim: int, one: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all blocks of ``one(block)``, a vector of fixed length; tasks add up their own first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column(0):
                part = one(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                             names=["at", "part"])

    rows = (blocks.select("block").mapInArrow(add, f"at int, part {kind}")
            .groupBy("at").agg(F.sum("part").alias("total")).collect())
    out = np.zeros(len(rows), object if kind == "long" else np.float64)
    for r in rows:
        out[r["at"]] = r["total"]
    return out


@dataclass
class Whitening:
    """Fitted components of vectors of one length."""

    n: int
    sums: list[int]            # of x by dimension
    components: np.ndarray     # a row each, unit length
    deviations: np.ndarray     # square roots of the eigenvalues
    total_variance: float
    steps: int
    identity_error: float = float("nan")

    @property
    def explained(self) -> np.ndarray:
        return self.deviations ** 2 / self.total_variance

    @property
    def shift(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean S/n as its whole part and the rest."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows x - S/n, each entry off by its own rounding only, however far the mean is."""
        whole, rest = self.shift
        far = x.astype(np.float64) - whole.astype(np.float64)
        with np.errstate(over="ignore"):
            near = (x - whole).astype(np.float64)
        return np.where(np.abs(far) < 2.0**62, near, far) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.components.T) / self.deviations

    def deviation(self, x: np.ndarray) -> np.ma.MaskedArray:
        """Exact sums of (n x - S)^2, masked beyond a long.

        Squares are added modulo 2**64, which is exact where the sum, known to 1e-9, is below 2**63."""
        about = (self.centred(x) ** 2).sum(axis=1) * float(self.n) ** 2
        y = x.astype(np.uint64) * np.uint64(self.n % 2**64) - np.array([s % 2**64 for s in self.sums], np.uint64)
        exact = (y * y).sum(axis=1, dtype=np.uint64).astype(np.int64)
        out = np.ma.masked_array(exact, mask=about > _LONG)
        for i in np.flatnonzero(np.abs(about - _LONG) < 1e-9 * _LONG):
            true = sum((self.n * int(a) - s) ** 2 for a, s in zip(x[i], self.sums))
            out[i] = true if true < 2**63 else np.ma.masked
        return out


def _unit(rng: np.random.Generator, dim: int, against: list[np.ndarray]) -> np.ndarray | None:
    """A random unit vector orthogonal to ``against``; None if these span everything."""
    if len(against) >= dim:
        return None
    v = rng.standard_normal(dim)
    for _ in range(3):
        for a in against:
            v -= (a @ v) * a
        v /= np.linalg.norm(v)
    return v


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dim: int, total: float,
                  wanted: int = COMPONENTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest singular values of X with their right vectors, and the number of steps.

    ``product(q)`` returns X'Xq and |Xq|^2, and ``total`` is the sum of X's squares."""
    rng = np.random.default_rng(seed)
    largest = 0.0  # so far, of the bidiagonal matrix's entries
    right: list[np.ndarray] = []
    left: list[np.ndarray] = []      # w with u = Xw
    images: list[np.ndarray] = []    # X'u
    diagonal: list[float] = []
    upper: list[float] = []          # above the diagonal, in the column of the same number
    v, beta = _unit(rng, dim, right), 0.0
    while v is not None:
        q = v - beta * left[-1] if left and beta else v.copy()
        g, size = product(q)
        for _ in range(4):
            if not left:
                break
            overlap = np.array(left) @ g  # U'Xq
            q -= overlap @ np.array(left)
            lost = float(overlap @ overlap)
            if lost <= 1e-16 * size:
                g = g - overlap @ np.array(images)
                size = max(0.0, size - lost)
                break
            g, size = product(q)  # most of it went: measure what is left
        alpha = float(np.sqrt(size))
        right.append(v)
        upper.append(beta)
        if alpha <= 1e-13 * np.sqrt(total):  # Xv lies in what is there already
            alpha, w, image = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, image = q / alpha, g / alpha
        left.append(w)
        images.append(image)
        diagonal.append(alpha)
        r = image - alpha * v
        for _ in range(2):
            r -= (np.array(right) @ r) @ np.array(right)
        beta = float(np.linalg.norm(r))
        largest = max(largest, alpha, beta)
        steps = len(diagonal)
        done = len(right) >= dim
        if beta <= 1e-13 * np.sqrt(total) or largest == 0.0:
            beta = 0.0
        small = np.diag(diagonal) + np.diag(upper[1:], 1)
        u, s, vt = np.linalg.svd(small)
        if not done and steps >= wanted:
            residual = beta * np.abs(u[-1, :wanted]).max()
            rest = total - float((s ** 2).sum())
            done = residual <= RESIDUAL * s[0] and rest < s[wanted - 1] ** 2
        if done or total == 0.0:
            break
        v = r / beta if beta else _unit(rng, dim, right)
    k = min(wanted, len(s))
    vectors = vt[:k] @ np.array(right)
    return s[:k], vectors, steps


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each vector length; ``vectors`` are those of ``quantised``."""
    blocks = fit_list(vectors)
    counts = {r["dim"]: r["n"] for r in blocks.groupBy("dim").agg(F.sum("rows").alias("n")).collect()}
    return {dim: _fit(blocks.where(F.col("dim") == dim), dim, n, components) for dim, n in counts.items()}


def _fit(blocks: DataFrame, dim: int, n: int, components: int) -> Whitening:
    # Sums of the upper and lower halves, so that no sum of a task can leave a long.
    halves = _summed(blocks, dim, lambda x: np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), "long")
    sums = [int(a) * 2**32 + int(b) for a, b in zip(halves[:dim], halves[dim:])]
    model = Whitening(n, sums, np.zeros((0, dim)), np.zeros(0), 0.0, 0)
    centred = model.centred
    total = float(_summed(blocks, dim, lambda x: np.array([(centred(x) ** 2).sum()]))[0])

    def product(q: np.ndarray) -> tuple[np.ndarray, float]:
        def one(x: np.ndarray) -> np.ndarray:
            rows = centred(x)
            p = rows @ q
            return np.concatenate([rows.T @ p, [p @ p]])
        both = _summed(blocks, dim, one)
        return both[:-1], float(both[-1])

    if total > 0.0:
        s, vectors, model.steps = bidiagonalise(product, dim, total, min(components, dim))
        keep = s ** 2 > NO_VARIANCE * s[0] ** 2
        s, vectors = s[keep], vectors[keep]
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        signs = np.sign(vectors[np.arange(len(s)), np.abs(vectors).argmax(axis=1)])
        model.components, model.deviations = vectors * signs[:, None], s / np.sqrt(n)
        model.total_variance = total / n
        model.identity_error = _identity_error(blocks, dim, model)
    return model


def _identity_error(blocks: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.components)

    def one(x: np.ndarray) -> np.ndarray:
        y = model.whitened(x)
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
    sums = _summed(blocks, dim, one) / model.n
    mean, second = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def transform(vectors: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, dim, deviation (long) and whitened (a number for each component) of every vector."""
    kind = vectors.dtypes[0][1]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                model = models[int(dim)]
                mine = batch.filter(pa.array(dims == dim))
                x = _matrix(mine.column(2), int(dim))
                y = model.whitened(x)
                deviation = model.deviation(x)
                at = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32) if y.shape[1] else np.zeros(len(y) + 1, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [mine.column(0), mine.column(1), pa.array(deviation.data, mask=np.ma.getmaskarray(deviation)),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(y.ravel()))],
                    names=["vec_id", "dim", "deviation", "whitened"])

    return vectors.mapInArrow(one, f"vec_id {kind}, dim int, deviation long, whitened array<double>")


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error, dim."""
    spark = df.sparkSession
    vectors = quantised(df, vec_id, vector)
    models = fit(vectors, components)
    facts = [(dim, i + 1, m.n, float(e), m.identity_error) for dim, m in models.items() for i, e in enumerate(m.explained)]
    told = spark.createDataFrame(facts, "dim int, component int, n long, explained double, identity_error double")
    rows = (transform(vectors, models)
            .select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .withColumn("component", F.col("at") + 1))
    return (rows.join(told, ["dim", "component"])
            .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "dim"))
