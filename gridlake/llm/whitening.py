"""Whitening of embeddings: a compensated covariance, its eigenvectors, and every vector in their coordinates.

Entries become integers x = floor(1024 * c) + 100000.  One pass counts vectors and sums each dimension exactly; the
mean S / n is held in double-double.  A second pass takes the mean off (the difference keeps a high and a low part)
and adds outer products.  An error-free transformation makes these exact: centred columns are split into slices of
21 bits, so that the product of two slices over 1,024 vectors is a whole number below 2^53, which a matrix product
of doubles gives without rounding; it is added to a double-double accumulator by two-sums.  Tasks hand over high and
low parts, which meet as a tree, so no task sees more than `FAN` of them, however many partitions there are.

The covariance, whose size is the square of the dimension, is solved by tridiagonal reduction and divide and conquer
(LAPACK's syevd) and refined with products in double-double until eigenvectors are right to double precision.  A last pass
projects every vector.  Whitened values are written before their own covariance is measured in the same way.

Vectors that are null or hold null or non-finite entries are dropped.  A shorter vector counts as filled up with
zeros, so an empty one is all zeros.  Entries beyond 2^40 count as 2^40.  Null and repeated ids and repeated rows
stay, one result each.  A component without variance (its eigenvalue below 1e-20 of the trace) has whitened null and
no part in identity_error; with no variance at all, explained and identity_error are null.  A deviation beyond a
long is null.  Empty table: empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**40
BITS, SLICES, ROWS = 21, 5, 1024  # 2 * 21 bits and 2^10 rows: exact in a double
FAN, BLOCK = 32, 1 << 20  # parts that meet in one task, bytes of a matrix in one row
FLAT = 1e-20
PART = "part int, block int, high binary, low binary"
Matrix = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Matrix:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(a: Matrix, b: Matrix) -> Matrix:
    """Sum of two double-double arrays."""
    s, e = two_sum(a[0], b[0])
    e = e + (a[1] + b[1])
    high = s + e
    return high, e - (high - s)


def _sliced(high: np.ndarray, low: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of high + low as whole numbers of BITS bits each, and the exponent of each column's first slice."""
    top = np.frexp(np.abs(high).max(axis=0, initial=0.0))[1]
    rest, out = high, []
    for k in range(SLICES):
        if k == 2:
            rest, low = two_sum(rest, low)
        elif k == 4:
            rest = rest + low
        whole = np.rint(np.ldexp(rest, BITS * (k + 1) - top))
        rest = rest - np.ldexp(whole, top - BITS * (k + 1))
        out.append(whole)
    return out, top


def product(a: Matrix, b: Matrix) -> Matrix:
    """Transpose of a times b in double-double, for at most ROWS rows."""
    (left, at), (right, bt) = _sliced(*a), _sliced(*b)
    total = np.zeros((a[0].shape[1], b[0].shape[1])), np.zeros((a[0].shape[1], b[0].shape[1]))
    for i in range(SLICES):
        for j in range(SLICES - i):
            exact = np.ldexp(left[i].T @ right[j], at[:, None] + bt[None, :] - BITS * (i + j + 2))
            total = added(total, (exact, np.zeros_like(exact)))
    return total


def long_product(a: Matrix, b: Matrix) -> Matrix:
    """Transpose of a times b in double-double, for any number of rows."""
    total = product(tuple(p[:ROWS] for p in a), tuple(p[:ROWS] for p in b))
    for k in range(ROWS, len(a[0]), ROWS):
        total = added(total, product(tuple(p[k : k + ROWS] for p in a), tuple(p[k : k + ROWS] for p in b)))
    return total


def _entries(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a batch as rows of width entries, filled up with zeros, and the length of each."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    if (lengths == width).all():
        return values.reshape(len(lengths), width), lengths
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out, lengths


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    return (np.floor(SCALE * np.clip(entries, -LARGEST, LARGEST)) + SHIFT).astype(np.int64)


def finite_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, c: vectors that are not null and hold only finite entries."""
    c = F.col("embedding").cast("array<double>")
    bad = F.exists(c, lambda e: F.coalesce(F.isnan(e) | (F.abs(e) == float("inf")), F.lit(True)))
    return embeddings.select("vec_id", c.alias("c")).where(F.col("c").isNotNull() & ~bad)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pos, s, n: sum and count of each dimension; pos -1 counts vectors."""
    sums, counts, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        entries, lengths = _entries(batch.column("c"))
        width = entries.shape[1]
        if width > len(sums):
            sums, counts = (np.pad(a, (0, width - len(a))) for a in (sums, counts))
        there = np.arange(width)[None, :] < lengths[:, None]
        sums[:width] += np.where(there, whole_numbers(entries), 0).sum(axis=0)
        counts[:width] += there.sum(axis=0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(sums)), pa.int32()), pa.array(np.append(0, sums), pa.int64()), pa.array(np.append(n, counts), pa.int64())], ["pos", "s", "n"])


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of x in each dimension."""
    rows = vectors.select("c").mapInArrow(_sums, "pos int, s long, n long").groupBy("pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("pos").collect()
    n = rows[0]["n"] if rows else 0
    return n, [r["s"] + (n - r["n"]) * SHIFT for r in rows[1:]] if n else []


def _doubled(values: list[Fraction]) -> Matrix:
    high = [float(v) for v in values]
    return np.array(high), np.array([float(v - Fraction(h)) for v, h in zip(values, high, strict=True)])


def _outer(column: str, mean: Matrix, integers: bool):
    """Centred outer products of a partition's vectors, in rows of at most BLOCK bytes."""
    d = len(mean[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            entries, _ = _entries(batch.column(column), d)
            values = whole_numbers(entries).astype(float) if integers else entries
            for k in range(0, len(values), ROWS):
                high, low = two_sum(values[k : k + ROWS], -mean[0])
                centred = two_sum(high, low - mean[1])
                total = added(total, product(centred, centred))
        lines = max(1, BLOCK // (8 * d))
        blocks = range(0, d, lines)
        parts = [[total[p][k : k + lines].tobytes() for k in blocks] for p in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int32()), pa.array([k // lines for k in blocks], pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], ["part", "block", "high", "low"])

    return run


def _met(table: pa.Table) -> pa.Table:
    """One row for the parts of a block."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = None
    for r in rows:
        part = np.frombuffer(r["high"]), np.frombuffer(r["low"])
        total = part if total is None else added(total, part)
    return pa.table({"part": pa.array([rows[0]["part"] // FAN], pa.int32()), "block": pa.array([rows[0]["block"]], pa.int32()), "high": [total[0].tobytes()], "low": [total[1].tobytes()]})


def covariance(vectors: DataFrame, column: str, n: int, mean: Matrix, integers: bool) -> Matrix:
    """Covariance (divisor n) of vectors, centred before multiplying, in double-double."""
    d = len(mean[0])
    parts = cut(vectors.select(column).mapInArrow(_outer(column, mean, integers), PART))
    count = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy(F.expr(f"part div {FAN}").alias("group"), "block").applyInArrow(_met, PART)
        count = -(-count // FAN)
        if count == 1:
            break
    rows = parts.orderBy("block").collect()  # as large as the square of the dimension
    high, low = (np.frombuffer(b"".join(bytes(r[p]) for r in rows)).reshape(d, d) for p in ("high", "low"))
    q = high / n
    up, down = float(n >> 26 << 26), float(n & (1 << 26) - 1)  # halves whose products with halves of q are exact
    rest = _residual(high, q, up) - down * q if up else _residual(high, q, down)
    return two_sum(q, (rest + low) / n)


def _residual(high: np.ndarray, q: np.ndarray, n: float) -> np.ndarray:
    """high - n * q, the product taken without rounding."""
    t = 134217729.0 * q  # 2^27 + 1 splits a double into halves
    qh = t - (t - q)
    return (high - n * qh) - n * (q - qh)


def eigenpairs(v: Matrix) -> Matrix:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric double-double matrix.

    The first guess is refined twice: products in double-double tell how far it is from orthogonal and diagonal, and
    the first-order correction is added (where two eigenvalues meet, only orthogonality is mended)."""
    _, x = np.linalg.eigh(v[0])
    zero = np.zeros_like(x)
    for last in (False, False, True):
        vx = long_product(v, (x, zero))  # v is symmetric
        s, g = long_product((x, zero), vx), long_product((x, zero), (x, zero))
        r = (np.eye(len(x)) - g[0]) - g[1]
        values = (s[0] + s[1]).diagonal() / (1 - r.diagonal())
        if last:
            break
        apart = values[None, :] - values[:, None]
        off = s[0] + values[None, :] * r
        least = 2 * (np.linalg.norm(s[0] - np.diag(s[0].diagonal())) + np.abs(values).max(initial=0.0) * np.linalg.norm(r))
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(np.abs(apart) > least, off / apart, r / 2)
        x = x + x @ e
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return values[order], x * np.where(signs == 0, 1.0, signs)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 for each vector, exact."""
    near = np.array(sums, float)
    if x.size and n * float(np.abs(x).max()) < 2.0**62 and np.abs(near).max() < 2.0**62:
        z = n * x - np.array(sums, np.int64)
        if ((z.astype(float) ** 2).sum(axis=1) < 2.0**62).all():
            return (z * z).sum(axis=1).tolist()
    exact = [sum((n * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def _projected(n: int, sums: list[int], mean: Matrix, axes: np.ndarray, roots: np.ndarray):
    d, k = axes.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(_entries(batch.column("c"), d)[0])
            high, low = two_sum(x.astype(float), -mean[0])
            whitened = (high @ axes + (low - mean[1]) @ axes) / roots
            offsets = pa.array(k * np.arange(len(x) + 1), pa.int32())
            values = pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(_deviation(x, n, sums), pa.int64()), values], ["vec_id", "deviation", "whitened"])

    return run


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every remaining vector and component."""
    vectors = finite_vectors(embeddings)
    kind = dict(vectors.dtypes)["vec_id"]
    n, sums = exact_sums(vectors)
    spark = embeddings.sparkSession
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sums:
        return spark.createDataFrame([], schema)
    mean = _doubled([Fraction(s, n) for s in sums])
    v = covariance(vectors, "c", n, mean, integers=True)
    values, axes = eigenpairs(v)
    k = min(components, len(sums))
    trace = float(v[0].trace() + v[1].trace())
    good = values[:k] > FLAT * trace
    count = int(good.sum())  # values fall, so these come first
    rows = vectors.mapInArrow(_projected(n, sums, mean, axes[:, :count], np.sqrt(values[:count])), f"vec_id {kind}, deviation long, whitened array<double>")
    rows = cut(rows)
    error = None
    if count:
        means = rows.agg(*(F.avg(F.get("whitened", F.lit(i))).alias(f"m{i}") for i in range(count))).first()
        own = covariance(rows, "whitened", n, (np.array(list(means)), np.zeros(count)), integers=False)
        error = float(np.abs((own[0] - np.eye(count)) + own[1]).max())
    explained = F.array(*(F.lit(float(values[i]) / trace if trace > 0 else None).cast("double") for i in range(k)))
    numbers = F.posexplode(explained).alias("place", "explained")
    out = rows.select("vec_id", "deviation", "whitened", numbers)
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.get("whitened", F.col("place")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"))
