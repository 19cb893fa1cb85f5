"""Whitening of embeddings by a compensated covariance.

An entry c becomes the integer x = floor(SCALE * c) + SHIFT. The covariance of the x is accumulated in double-double numbers
(an unevaluated sum of a high and a low double, 106 bits):

* sums and the mean are double-doubles; a vector is centred in double-double before anything is multiplied;
* the centred outer products of a block of rows come by an error-free transformation of the matrix product: each column is cut
  into slices of so few bits that the products of two slices, summed over the block, are exact in double arithmetic, and these
  exact parts are added to the task's high and low part with two-sum;
* a task emits its high and low parts, one row for each row of the matrix, and these are merged by double-double additions in
  two rounds of tasks keyed by matrix row, the first salted, each streaming: a task holds its running sums alone.

The matrix (dimension squared, whatever the rows) then goes to the driver, where LAPACK's symmetric solver by tridiagonal
reduction and divide and conquer (syevd, numpy.linalg.eigh) gives the eigenpairs and one step of refinement in extended
precision against the double-double matrix mends what rounding the matrix cost. The projections are broadcast; the size is bounded by
the dimension, documented as a parameter of the data.

Scale: four passes over the vectors (lengths, sums, products, projections), no shuffle of vectors; shuffled are two doubles for
each matrix entry and task.

Defined cases: null vectors, those with a null or non-finite entry and empty ones are dropped. Where lengths differ, the most
frequent among what remains (of equally frequent ones the longest) is the dimension and other lengths are dropped like
vectors with missing entries. Entries beyond +-2^53 / SCALE count as that bound. Null and repeated ids are rows like any other, repeated
vectors count each time. A component without variance (one vector, a constant dimension) has null in `whitened`, and null in
`explained` where there is no variance at all; identity_error is of the components with variance. `deviation` is null where
it exceeds a long. Without vectors there are no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import bound_batches, give_back, map_batches, plain, staged

SCALE, SHIFT, COMPONENTS = 1024, 100000, 8
#: Rows of a block and bits of a slice: a sum of BLOCK products of two slices has at most 10 + 2 * 21 = 52 bits.
BLOCK, SLICE_BITS, SLICES = 1024, 21, 5
_PARTS = "i int, high array<double>, low array<double>"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as its rounded value and the exact rest."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double (high, low) plus (more, rest), normalised."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.broadcast_to(rest, np.shape(low)))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, mean: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x - (mean + rest) as double-doubles."""
    return add(x, np.zeros_like(x), np.broadcast_to(-mean, x.shape), np.broadcast_to(-rest, x.shape))


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Matrices that add up to high + low; entries of one column of a matrix are multiples of one power of two and fewer than SLICE_BITS bits long."""
    out = []
    for _ in range(SLICES):
        top = np.abs(high).max(axis=0)
        exponent = np.where(top > 0, np.frexp(top)[1], 0)
        unit = np.ldexp(1.0, exponent - SLICE_BITS + 1)
        part = np.rint(high / unit) * unit
        out.append(part)
        high, low = two_sum(high - part, low)
        if not high.any():
            break
    return out


def outer(high: np.ndarray, low: np.ndarray) -> Iterator[np.ndarray]:
    """The exact parts of the sum of outer products over a block's rows, the greatest first; products below 2^-100 of it are left out."""
    cut = slices(high, low)
    for total in range(2 * len(cut) - 1):
        for i in range(max(0, total - len(cut) + 1), min(total, len(cut) - 1) + 1):
            if total < SLICES:
                yield cut[i].T @ cut[total - i]


def vectors_of(batch: pa.RecordBatch, at: int, length: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The places of the batch's finite vectors of `length` and their entries in one matrix; without `length`, the places and lengths of all finite ones."""
    column = batch.column(at)
    if pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    if length is None:
        return np.flatnonzero(good), sizes[good], values
    places = np.flatnonzero(good & (sizes == length))
    return places, sizes[places], values[offsets[places][:, None] + np.arange(length)]


class Levels(NamedTuple):
    """How an entry becomes the number that is whitened: floor(scale * c) + shift, or the entry itself where there is no scale."""

    scale: float | None = SCALE
    shift: float = SHIFT

    def of(self, entries: np.ndarray) -> np.ndarray:
        return entries if self.scale is None else np.clip(np.floor(entries * self.scale) + self.shift, -(2.0**53), 2.0**53)


def _merge(parts: DataFrame, *keys: str) -> DataFrame:
    """Double-double sums of the parts by `i`, in tasks dealt by `keys`; a task streams its rows and holds one sum for each i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            high, low = (batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1) for k in (1, 2))
            for i, h, e in zip(batch.column(0).to_pylist(), high, low, strict=True):
                sums[i] = add(*sums[i], h, e) if i in sums else (h, e)
        if sums:
            yield _rows(sums)

    return parts.repartition(*keys).select("i", "high", "low").mapInArrow(run, _PARTS)


def _rows(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([s[k].tolist() for s in sums.values()], pa.list_(pa.float64())) for k in (0, 1))], names=["i", "high", "low"])


def _gathered(parts: DataFrame, rows: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged parts, rows by d numbers, on the driver: bounded by the dimension."""
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    high, low = np.zeros((rows, d)), np.zeros((rows, d))
    for r in _merge(_merge(salted, "i", "salt"), "i").collect():
        high[r.i], low[r.i] = r.high, r.low
    return high, low


def length_and_count(df: DataFrame, column: str) -> tuple[int, int]:
    """The most frequent length of the finite vectors and how many have it; (0, 0) without any."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, counts = np.unique(vectors_of(batch, 0)[1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(lengths, pa.int32()), pa.array(counts, pa.int64())], names=["length", "n"])

    found = map_batches(df.select(column), each, "length int, n long").groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return (found.length, found.n) if found else (0, 0)


def sums_of(df: DataFrame, column: str, d: int, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each dimension as a double-double: exact for integers while they are below 2^105."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(d), np.zeros(d)
        for batch in batches:
            x = levels.of(vectors_of(batch, 0, d)[2])
            while len(x) > 1:  # pairs of rows, so that a batch takes few steps; what rounding leaves goes to the low part
                if len(x) % 2:
                    high, low = add(high, low, x[-1])
                x, rest = two_sum(x[: len(x) // 2], x[len(x) // 2 : len(x) // 2 * 2])
                for e in rest[rest.any(axis=1)]:
                    high, low = add(high, low, e)
            for row in x:
                high, low = add(high, low, row)
        yield _rows({0: (high, low)})
        give_back()

    high, low = _gathered(df.select(column).mapInArrow(run, _PARTS), 1, d)
    return high[0], low[0]


def products_of(df: DataFrame, column: str, d: int, levels: Levels, mean: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the centred outer products as a double-double matrix."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            x = levels.of(vectors_of(batch, 0, d)[2])
            for at in range(0, len(x), BLOCK):
                for part in outer(*centred(x[at : at + BLOCK], mean, rest)):
                    high, low = add(high, low, part)
        for at in range(0, d, 64):
            yield _rows({i: (high[i], low[i]) for i in range(at, min(at + 64, d))})
        give_back()

    return _gathered(df.select(column).mapInArrow(run, _PARTS), d, d)


def divided(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(high + low) / n as a double-double, by exact integers: the numbers are few."""
    q = high / n
    rest = np.array([float(_exact(h) + _exact(e) - _exact(v) * n) / n for h, e, v in zip(high.flat, low.flat, q.flat, strict=True)]).reshape(q.shape)
    return two_sum(q, rest)


def _exact(v: float) -> Fraction:
    return Fraction(float(v))


def components_of(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of the symmetric matrix high + low.

    Divide and conquer on the tridiagonal form (syevd), then one step of iterative refinement in extended precision: with X
    nearly orthogonal, R = I - X'X and S = X'AX give a correction of X whose entry for two eigenvalues that differ is
    (S_ij + e_j R_ij) / (e_j - e_i), and R / 2 on the diagonal and where they don't.
    """
    values, x = np.linalg.eigh((high + high.T) / 2)
    wide = np.longdouble
    a, x = (high.astype(wide) + low.astype(wide)), x.astype(wide)
    a = (a + a.T) / 2
    r, s = np.eye(len(x), dtype=wide) - x.T @ x, x.T @ (a @ x)
    e = np.diag(s) / (1 - np.diag(r))
    apart = e[None, :] - e[:, None]
    near = np.abs(apart) <= 1e-9 * np.abs(e).max()
    x = x + x @ np.where(near, r / 2, (s + e[None, :] * r) / np.where(near, 1, apart))
    x /= np.sqrt((x * x).sum(axis=0))
    e = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    return e[order].astype(float), x[:, order].astype(float)


class Model(NamedTuple):
    """What whitening needs of the fit list: its size, sums, mean, eigenvalues, eigenvectors (columns) and trace. Components without variance have value 0."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    levels: Levels


def fit(df: DataFrame, column: str = "embedding", levels: Levels = Levels()) -> Model | None:
    """The model of all finite vectors of df; None without any."""
    d, n = length_and_count(df, column)
    if not n:
        return None
    total = sums_of(df, column, d, levels)
    mean, rest = divided(*total, n)
    high, low = divided(*products_of(df, column, d, levels, mean, rest), n)
    values, vectors = components_of(high, low)
    trace = float(np.trace(high) + np.trace(low))
    values = np.where(values > 1e-14 * d * max(values[0], 0), values, 0.0)
    return Model(n, [int(_exact(h) + _exact(e)) for h, e in zip(*total, strict=True)] if levels.scale else None, mean, rest, values, vectors, trace, levels)


def deviations(x: np.ndarray, model: Model) -> list[int | None]:
    """Sums over dimensions of (n * x - S)^2, exact; None beyond a long."""
    spread = float(np.abs(x - model.mean).max(initial=0)) * model.n + 2
    if len(model.mean) * spread**2 < 2.0**62 and model.n * float(np.abs(x).max(initial=0)) < 2.0**62 and max(map(abs, model.sums)) < 1 << 62:
        off = x.astype(np.int64) * model.n - np.array(model.sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = x.astype(np.int64).astype(object) * model.n - np.array(model.sums, object)
    return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def whiten(df: DataFrame, model: Model, key: str, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, `deviation` and `whitened`, the first components, of each finite vector of df. A component without variance is null."""
    d, k = len(model.mean), min(components, len(model.mean))
    shared: Broadcast = df.sparkSession.sparkContext.broadcast(model)  # as large as the dimension squared
    kind = df.schema[key].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        m: Model = shared.value
        places, _, entries = vectors_of(batch, 1, d)
        if not len(places):
            return None
        x = m.levels.of(entries)
        high, low = centred(x, m.mean, m.rest)
        scale = np.where(m.values[:k] > 0, 1 / np.sqrt(np.where(m.values[:k] > 0, m.values[:k], 1)), np.nan)
        w = (high @ m.vectors[:, :k] + low @ m.vectors[:, :k]) * scale
        flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(deviations(x, m), pa.int64()), pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32), flat)], names=["key", "deviation", "whitened"])

    return map_batches(df.select(key, column), each, f"key {kind}, deviation long, whitened array<double>")


def identity_error(df: DataFrame, n: int, kept: int) -> float | None:
    """The largest absolute entry of the covariance of `whitened` minus the identity, of its first `kept` components, by the same compensated sums."""
    if not kept:
        return None
    first, as_is = df.select(F.slice("whitened", 1, kept).alias("w")), Levels(None)
    high, low = divided(*products_of(first, "w", kept, as_is, *divided(*sums_of(first, "w", kept, as_is), n)), n)
    return float(np.abs(high - np.eye(kept) + low).max())


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each finite vector and component."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    df, names = plain(embeddings.select("vec_id", "embedding"))
    model = fit(df, names["embedding"])
    if model is None:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    made = staged(whiten(df, model, names["vec_id"], names["embedding"]), "whitened")
    k = min(COMPONENTS, len(model.mean))
    error = identity_error(made, model.n, int((model.values[:k] > 0).sum()))
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in model.values[:k]])
    flat = made.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select(F.col("key").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
