"""Embedding whitening from an exact bit-sliced scatter matrix.

Entries become integers, the distinct integer vectors (the fit list) are cut
into blocks, and in a block every dimension is shifted to start at 0 and split
into bit planes, packed over the rows into 64-bit words.  A cross-product of two
dimensions is the sum over pairs of planes of 2^(a+b) times the number of bits
that both planes share (AND, popcount).  A dimension of ones gives counts and
sums in the same way.  Spark adds the blocks' products; ``n*C - S*S'`` is taken
in integers, so nothing is lost before the eigenvectors.

Results for odd input: a vector that is null or holds null or non-finite entries
takes no part and has no row; a vector without entries has no components, so no
row.  Vectors of several lengths are fitted apart, one list for each length.
Entries beyond the long range after scaling become its ends.  A null or repeated
``vec_id`` keeps its rows; repeated vectors count once in the fit list.  A
component whose eigenvalue isn't above rounding (a dimension or table without
spread) has ``whitened`` null, and ``explained`` is null without any spread;
``identity_error`` covers the components that could be whitened (null if none).
``deviation`` is null where it doesn't fit a long; ``deviation_text`` always
holds it.  Equal eigenvalues leave the choice of axes to the eigensolver.  An
empty table gives no rows; further columns of the table are not read.
The work of a block grows with the square of the vector length, and a d x d
matrix is held by one task, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Entries are scaled by this and cut to integers.
SCALE = 256
#: Components returned.
COMPONENTS = 4
#: Integers that a task holds before it packs its blocks (32 MB of longs).
BLOCK_VALUES = 4_000_000
#: Bytes of the models that one pass over the rows carries; with more lengths
#: than fit, further passes each take their lengths' rows.
MODEL_BYTES = 64_000_000
#: Cross-products travel as base-2^32 digits, the last one signed: sums of digits stay longs.
LIMBS = 6
_LIMB_COLS = [f"l{k}" for k in range(LIMBS)]


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of every vector whose entries are all finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
            .filter(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0))
            .select("vec_id", F.transform("embedding", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(0))
                    .alias("x")))


def bit_planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(planes as rows of words, dimension of each plane, bit of each plane) of
    unsigned columns: word k of a plane holds the bits of rows 64k to 64k+63."""
    n, d = u.shape
    most = u.max(axis=0)
    width = np.array([int(m).bit_length() for m in most])
    pad = -n % 64
    planes, dim, bit = [], [], []
    for b in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > b)
        bits = ((u[:, has] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        if pad:
            bits = np.concatenate([bits, np.zeros((pad, len(has)), np.uint8)])
        packed = np.packbits(bits, axis=0, bitorder="little").T
        planes.append(np.ascontiguousarray(packed).view(np.uint64))
        dim.append(has)
        bit.append(np.full(len(has), b))
    if not planes:
        return np.zeros((0, (n + pad) // 64), np.uint64), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(planes), np.concatenate(dim), np.concatenate(bit)


def scatter(x: np.ndarray) -> np.ndarray:
    """Exact cross-products (Python integers) of the columns of ``x`` and a last
    column of ones, by weighted popcounts of ANDed bit planes."""
    n, d = x.shape
    x = np.concatenate([x, np.ones((n, 1), np.int64)], axis=1)
    low = x.min(axis=0)
    low[d] = 0                                               # the ones stay a plane
    u = x.view(np.uint64) - low.view(np.uint64)              # wraps to the true difference
    planes, dim, bit = bit_planes(u)
    shared = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        shared[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
        shared[p:, p] = shared[p, p:]
    widest = int(bit.max(initial=0)) + 1
    safe = 2 * widest + int(n).bit_length() < 62             # weighted sums fit a long
    weight = np.zeros((d + 1, len(planes)), np.int64 if safe else object)
    weight[dim, np.arange(len(planes))] = [1 << int(b) for b in bit]
    cross = (weight @ (shared if safe else shared.astype(object)) @ weight.T).astype(object)
    low = low.astype(object)
    sums = cross[:, d]                                       # of the shifted columns
    return cross + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


def _scatter_rows(batches: Iterator[pa.RecordBatch], block_values: int) -> Iterator[pa.RecordBatch]:
    """Blocks of equally long vectors -> (d, i, j, limbs) of their cross-products."""
    held: dict[int, list[np.ndarray]] = {}
    total = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for d, parts in held.items():
            cross = scatter(np.concatenate(parts))
            i, j = np.triu_indices(d + 1)
            limbs = np.array([_limbs(int(v)) for v in cross[i, j]], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 *(pa.array(np.ascontiguousarray(limbs[:, k])) for k in range(LIMBS))],
                names=["d", "i", "j", *_LIMB_COLS])

    for batch in batches:
        for d, _, x in _matrices(batch.column("x")):
            held.setdefault(d, []).append(x)
            total += x.size
            if total >= block_values:
                yield from flush()
                held, total = {}, 0
    yield from flush()


def _matrices(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) for each length of the lists."""
    off = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, flat[off[rows][:, None] + np.arange(d)]


def components(pdf: pd.DataFrame) -> pd.DataFrame:
    """The model of one length from its summed cross-products."""
    d = int(pdf["d"].iloc[0])
    cross = np.zeros((d + 1, d + 1), object)
    limbs = pdf[_LIMB_COLS].to_numpy(np.int64)
    for i, j, row in zip(pdf["i"], pdf["j"], limbs):
        cross[i, j] = cross[j, i] = sum(int(v) << (32 * k) for k, v in enumerate(row))
    n, s = int(cross[d, d]), [int(v) for v in cross[:d, d]]
    cov = np.array([[(n * int(cross[i, j]) - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)], float)
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")[:COMPONENTS]
    axes = v[:, order].T
    # either sign would do: the largest entry is positive, so reruns agree
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    trace = float(sum(n * int(cross[i, i]) - s[i] * s[i] for i in range(d)) / (n * n))
    floor = d * np.finfo(float).eps * max(float(e.max()), 0.0)
    kept = [float(x) if x > floor else 0.0 for x in e[order]]
    return pd.DataFrame({
        "d": [d], "n": [n], "sums": [[str(x) for x in s]], "axes": [axes.ravel().tolist()], "eigen": [kept],
        "explained": [[x / trace if trace > 0 else None for x in kept]]})


_MODEL = "d int, n long, sums array<string>, axes array<double>, eigen array<double>, explained array<double>"


def fit(x: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """The model of each length: d, n, sums, axes (row after row), eigen (0 where
    not above rounding), explained.  One row for each vector length."""
    cross = (x.mapInArrow(lambda batches: _scatter_rows(batches, block_values),
                          "d int, i int, j int, " + ", ".join(f"{c} long" for c in _LIMB_COLS))
             .groupBy("d", "i", "j").agg(*(F.sum(c).alias(c) for c in _LIMB_COLS)))
    return cross.groupBy("d").applyInPandas(components, _MODEL)


class Model:
    """One length's model, ready for blocks of rows."""

    def __init__(self, row):
        self.d, self.n = row["d"], row["n"]
        self.sums = [int(s) for s in row["sums"]]
        self.axes = np.array(row["axes"], float).reshape(-1, self.d)
        self.eigen = np.array(row["eigen"], float)
        self.explained = list(row["explained"])
        self.error = None

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: longs where they and their squares' sums fit, else Python integers."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        reach = self.n * most + max((abs(s) for s in self.sums), default=0)
        if reach * reach * self.d < 2 ** 63:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        """One column a component; NaN where the eigenvalue is 0."""
        centred = (apart / self.n).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = centred @ self.axes.T / np.sqrt(self.eigen)
        scaled[:, self.eigen == 0] = np.nan
        return scaled


def _models(rows: list) -> dict[int, Model]:
    return {r["d"]: Model(r) for r in rows}


def _fit_errors(x: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened fit list - identity), by length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, m in _matrices(batch.column("x")):
                if d in models:
                    w = models[d].whitened(models[d].apart(m))
                    full = np.full((len(w), COMPONENTS), np.nan)
                    full[:, :w.shape[1]] = w
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(w), d, np.int32)),
                         *(pa.array(np.ascontiguousarray(full[:, k]), from_pandas=True) for k in range(COMPONENTS))],
                        names=["d", *(f"w{k}" for k in range(COMPONENTS))])

    w = x.mapInArrow(run, "d int, " + ", ".join(f"w{k} double" for k in range(COMPONENTS)))
    pairs = [(a, b) for a in range(COMPONENTS) for b in range(a, COMPONENTS)]
    cov = w.groupBy("d").agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs))
    out = {}
    for row in cov.collect():
        off = [abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs if row[f"c{a}_{b}"] is not None]
        out[row["d"]] = max(off) if off else None
    return out


_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double, deviation_text string")


def _whiten_rows(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _matrices(batch.column("x")):
                if d not in models:
                    continue
                m = models[d]
                apart = m.apart(x)
                dev = (apart * apart).sum(axis=1)
                text = [str(v) for v in dev]
                small = [int(v) if v < 2 ** 63 else None for v in dev]
                w = m.whitened(apart)
                ids = batch.column("vec_id").take(pa.array(at))
                k, size = w.shape[1], len(at)
                each = pa.array(np.repeat(np.arange(size), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, m.n, np.int64)), pa.array(small, pa.int64()).take(each),
                    pa.array(w.ravel(), pa.float64(), from_pandas=True), pa.array(m.explained[:k] * size, pa.float64()),
                    pa.array([m.error] * (size * k), pa.float64()), pa.array(text, pa.string()).take(each)], names=names)

    return rows.mapInArrow(run, _OUT)


def whiten(vectors: DataFrame, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Per row of finite entries and component: vec_id, component, n, deviation,
    whitened, explained, identity_error, deviation_text (see the module)."""
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = integer_rows(vectors)
    fit_list = common.staged(rows.select("x").distinct(), "whitening-fit")
    model = common.staged(fit(fit_list, block_values), "whitening-model")
    # lengths a pass can carry; one row a length comes to the driver
    passes, room = [[]], MODEL_BYTES
    for r in model.select("d").orderBy("d").collect():
        need = 64 * (COMPONENTS + 2) * r["d"]
        if need > room and passes[-1]:
            passes.append([])
            room = MODEL_BYTES
        passes[-1].append(r["d"])
        room -= need
    out = []
    for lengths in passes:
        models = _models(model.filter(F.col("d").between(lengths[0], lengths[-1])).collect()) if lengths else {}
        if len(passes) > 1:
            within = F.size("x").between(lengths[0], lengths[-1])
            some, some_fit = rows.filter(within), fit_list.filter(within)
        else:
            some, some_fit = rows, fit_list
        for d, error in _fit_errors(some_fit, models).items():
            models[d].error = error
        out.append(_whiten_rows(some, models))
    return reduce(DataFrame.unionByName, out)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding projected on its table's first four whitened components."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
