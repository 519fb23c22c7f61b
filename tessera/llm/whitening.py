"""Whitening of vectors: blockwise QR, Householder bidiagonalisation, dqds singular values, twisted factorisations."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import dropped, load, table

EPS = float(np.finfo(float).eps)
#: Rows of one QR step, R factors that one task reduces, components that are returned.
BLOCK, FAN, COMPONENTS = 1024, 32, 32
#: An entry c becomes floor(SCALE * c) + SHIFT; floor(SCALE * c) is held within +-LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**52


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections of a square matrix from both sides: r = U B V'. The diagonal of B, the one above it, and V."""
    a, n = r.astype(float).copy(), len(r)
    v = np.eye(n)
    for k in range(n):
        w = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector whose reflection leaves only the first entry of x; zero if there is nothing to do."""
    top = np.abs(x).max()
    if top == 0 or not x[1:].any():
        return np.zeros_like(x)
    w = x / top
    w[0] += np.copysign(np.linalg.norm(w), w[0])
    return w / np.linalg.norm(w)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, largest first, each to high relative accuracy.

    A step without shift gives the diagonal of the inverse, and with it a lower bound of the smallest value left, by which
    the next step shifts: quotients and differences never lose a sign. A value is split off where the entry above it has vanished.
    """
    found: list[float] = []
    todo = [(np.square(diagonal), np.square(above), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while len(q) > 1:
            gone = np.flatnonzero(e <= EPS * EPS * (moved + np.minimum(q[1:], q[:-1])))
            if len(gone):
                at = int(gone[-1]) + 1
                if at < len(q) - 1 or len(gone) > 1:
                    todo.append((q[:at], e[: at - 1], moved))
                    q, e = q[at:], e[at:]
                else:
                    found.append(moved + q[-1])
                    q, e = q[:-1], e[:-1]
                continue
            q, e, least = _qd_step(q, e, 0.0)
            with np.errstate(divide="ignore", over="ignore"):
                shift = (1 - 4 * EPS * len(q)) / np.sum(1 / least)
            if np.isfinite(shift) and shift > EPS * moved:
                q1, e1, left = _qd_step(q, e, shift)
                if left.min() >= 0:
                    q, e, moved = q1, e1, moved + shift
        found.extend(moved + q)
    return np.sort(np.array(found))[::-1]


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(q)
    q1, e1, left = np.zeros(n), np.zeros(n - 1), np.zeros(n)
    d = q[0] - shift
    for i in range(n - 1):
        left[i] = d
        q1[i] = d + e[i]
        t = q[i + 1] / q1[i] if q1[i] else 0.0
        e1[i] = e[i] * t
        d = d * t - shift
    q1[-1] = left[-1] = d
    return q1, e1, left


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """A unit eigenvector of B'B for its eigenvalue `value`; a, b: the diagonal of B, without zeros, and the one above it.

    The factorisation from above meets the one from below where their product is nearest to singular.
    """
    n = len(a)
    d, low = a * a, b / a[:-1]
    tiny = EPS * EPS * (d.max() + value) or 1.0
    s, p = np.full(n, -value), np.zeros(n)
    down, up = np.zeros(n), np.zeros(n)
    for i in range(n - 1):
        plus = s[i] + d[i]
        plus = plus if abs(plus) > tiny else tiny
        down[i] = d[i] * low[i] / plus
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        minus = d[i] * low[i] ** 2 + p[i + 1]
        minus = minus if abs(minus) > tiny else tiny
        up[i] = low[i] * d[i] / minus
        p[i] = d[i] / minus * p[i + 1] - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squared singular values of a square matrix, largest first, and its right singular vectors as columns.

    Vectors of values that nearly coincide are made orthogonal to each other; one that gets lost in that is found again by
    inverse iteration among what is left of their space. The sign makes the largest entry positive.
    """
    a, b, v = bidiagonal(r)
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a, b = a / scale, b / scale
    values = dqds(a, b)
    a = np.where(np.abs(a) < EPS, EPS, a)
    full = np.diag(a) + np.diag(b, 1)
    z, rng = np.zeros((len(a), len(a))), np.random.default_rng(5)
    for j, value in enumerate(values):
        near = [i for i in range(j) if values[i] - value <= 1e-3 * values[i] + 8 * EPS * values[0]]
        x = twisted(a, b, value)
        for turn in range(9):
            before = np.linalg.norm(x)
            for _ in range(2):
                x = x - z[:, near] @ (z[:, near].T @ x)
            if np.linalg.norm(x) > 0.1 * before:
                x /= np.linalg.norm(x)
                break
            x, apart = rng.standard_normal(len(a)), 8 * EPS * values[0] * (turn + 1)
            for _ in range(3):
                x -= z[:, near] @ (z[:, near].T @ x)
                x = np.linalg.solve(full.T @ full - (value - apart) * np.eye(len(a)), x)
                x /= np.linalg.norm(x)
        z[:, j] = x
    w = v @ z
    w *= np.sign(w[np.abs(w).argmax(axis=0), np.arange(len(a))])
    return values * scale * scale, w


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, one a row."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
    return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(float) - rest


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sums of (n * x - S)^2, exactly; null beyond 64 bits."""
    most = max(abs(n * int(v) - s) for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), sums, strict=True) for v in (lo, hi))
    if most * most * len(sums) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    return [t if (t := sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))) < 1 << 63 else None for row in x.tolist()]


def usable(df: DataFrame, column: str) -> DataFrame:
    """The rows whose vector is neither null nor empty and holds finite entries alone."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where((F.size(column) > 0) & finite)


def sums_of(rows: DataFrame) -> DataFrame:
    """For the most frequent length of vectors in rows (v) and each place of theirs: place, n, s, an exact sum of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                x = _matrix(v.filter(pa.array(sizes == d)), d)
                n, s = totals.get(d, (0, np.zeros(d, object)))
                totals[d] = (n + len(x), s + x.sum(axis=0).astype(object))
        for d, (n, s) in totals.items():
            sums = pa.array([Decimal(int(t)) for t in s], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array([n] * d, pa.int64()), sums], ["d", "place", "n", "s"])

    part = rows.select("v").mapInArrow(run, "d long, place long, n long, s decimal(38,0)")
    sums = table(part.groupBy("d", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")), "sums")
    best = sums.where("place = 0").orderBy(F.desc("n"), "d").select("d").limit(1)
    return sums.join(F.broadcast(best), "d")


def triangle(rows: DataFrame, d: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows: by blocks in each task, then FAN tasks' R a time, level by level."""

    def joined(r: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.concatenate([r, more]), mode="r")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                r = joined(r, _centred(_matrix(batch.column("v").slice(at, BLOCK), d), whole, rest))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for part in batch.column("r").to_pylist():
                r = joined(r, np.frombuffer(part).reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    level = rows.select("v").mapInArrow(first, "r binary")
    parts = level.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        level = level.repartition(parts).mapInArrow(again, "r binary")
    r = np.zeros((0, d))
    for row in level.collect():
        r = joined(r, np.frombuffer(bytes(row.r)).reshape(-1, d))
    return np.concatenate([r, np.zeros((d, d))])[:d]


SCHEMA = "{} long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector of df and each component: id, component, n, deviation, whitened, explained, identity_error.

    Whole numbers floor(64 c) + 1000000 stand for the entries c (floor(64 c) is held within +-2**52). Null or empty vectors and
    those with null or non-finite entries are left out, so are vectors of another length than the most frequent one (the
    shorter of two equally frequent). Rows that repeat an id are rows of their own, and a null id stays null. If fewer than d rows
    are left, or entries depend on each other, components beyond the rank have explained 0 and no whitened value; without
    any variance explained is null. deviation is null beyond 64 bits. Other columns aren't read; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = usable(df.select(F.col(id).cast("long").alias("i"), F.col(column).alias("v")), "v")
    sums = sums_of(rows)
    known = sorted(sums.collect(), key=lambda r: r.place)
    dropped(sums)
    if not known:
        return spark.createDataFrame([], SCHEMA.format(id))
    d, n, total = len(known), known[0].n, [int(r.s) for r in known]
    whole = np.array([s // n for s in total], np.int64)
    rest = np.array([(s - n * (s // n)) / n for s in total])
    rows = rows.where(F.size("v") == d)
    values, vectors = directions(triangle(rows, d, whole, rest))
    k = min(components, d)
    rank = int(np.sum(values[:k] > (4 * d * EPS) ** 2 * values[0]))
    project = vectors[:, :rank] / np.sqrt(values[:rank] / n)
    explained = [float(v / values.sum()) if values[0] > 0 else None for v in np.where(np.arange(k) < rank, values[:k], 0.0)]
    error = _identity_error(rows, d, n, whole, rest, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), d)
            w = np.full((len(x), k), np.nan)
            w[:, :rank] = _centred(x, whole, rest) @ project
            each = np.repeat(np.arange(len(x)), k)
            cols = [
                batch.column("i").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                pa.array(_deviations(x, n, total), pa.int64()).take(pa.array(each)), pa.array(w.ravel(), from_pandas=True), pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(k), len(x)))), pa.array([error] * len(each), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, [id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA.format(f"`{id}`"))


def _identity_error(rows: DataFrame, d: int, n: int, whole: np.ndarray, rest: np.ndarray, project: np.ndarray) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from sums over all rows."""
    k = project.shape[1]
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _centred(_matrix(batch.column("v"), d), whole, rest) @ project
                s, m = s + w.sum(axis=0), m + w.T @ w
        flat = np.concatenate([s, m.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "x"])

    got = rows.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(k + k * k)
    for r in got:
        flat[r["at"]] = r.x / n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def whitened_of(spark, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))
