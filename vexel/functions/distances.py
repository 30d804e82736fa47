"""Distances and similarities as Spark columns, computed in DOUBLE, and the same in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str


def _fold(a: Name, b: Name, term: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> {term}), 0D, (s, x) -> s + x)"


def l2_sq(a: Name, b: Name) -> Column:
    return F.expr(_fold(a, b, "(x - y) * (x - y)"))


def l2(a: Name, b: Name) -> Column:
    return F.sqrt(l2_sq(a, b))


def ip(a: Name, b: Name) -> Column:
    return F.expr(_fold(a, b, "x * y"))


def norm(a: Name) -> Column:
    return F.sqrt(ip(a, a))


def cosine(a: Name, b: Name) -> Column:
    """Cosine similarity; 0 if a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, ip(a, b) / size).otherwise(0.0)


def l1(a: Name, b: Name) -> Column:
    return F.expr(_fold(a, b, "abs(x - y)"))


def linf(a: Name, b: Name) -> Column:
    return F.expr(f"array_max(zip_with({a}, {b}, (x, y) -> abs(x - y)))")


def distance(metric: str, a: Name, b: Name) -> Column:
    """The engine's contract: smaller is nearer. L2 is a root; IP is negated; cosine is 1 - similarity."""
    return {"l2": lambda: l2(a, b), "l2_sq": lambda: l2_sq(a, b), "ip": lambda: -ip(a, b), "cosine": lambda: 1.0 - cosine(a, b), "l1": lambda: l1(a, b), "linf": lambda: linf(a, b),
        "hamming": lambda: hamming(a, b).cast("double"), "jaccard": lambda: 1.0 - jaccard(a, b)}[metric]()


# bit vectors are arrays of 64-bit words


def hamming(a: Name, b: Name) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0L, (s, x) -> s + x)")


def jaccard(a: Name, b: Name) -> Column:
    """Shared bits over all bits; 1 if neither has any."""
    both = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x & y)), 0L, (s, x) -> s + x)"
    either = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x | y)), 0L, (s, x) -> s + x)"
    return F.expr(f"IF({either} = 0, 1D, {both} / CAST({either} AS DOUBLE))")


def pack_bits(flags: str) -> Column:
    """An array of booleans as 64-bit words, lowest bit first."""
    word = f"aggregate(slice({flags}, w * 64 + 1, 64), struct(0L AS s, 0 AS i), (a, f) -> struct(a.s | IF(f, shiftleft(1L, a.i), 0L) AS s, a.i + 1 AS i), a -> a.s)"
    return F.expr(f"transform(sequence(0, (size({flags}) - 1) div 64), w -> {word})")


def sign_bits(vector: Name) -> Column:
    return pack_bits(f"transform({vector}, x -> x >= 0)")


def median_bits(vector: Name) -> Column:
    """Bit set where the value is above the vector's own upper median."""
    return pack_bits(f"transform({vector}, x -> x > get(sort_array({vector}), size({vector}) div 2))")


def to_sparse(vector: Name, threshold: float) -> Column:
    """(term, w) of the values whose size is above the threshold."""
    return F.expr(f"filter(transform({vector}, (x, i) -> struct(i AS term, x AS w)), e -> abs(e.w) > {threshold!r}D)")


def to_dense(sparse: Name, dim: int) -> Column:
    """A vector of `dim` values from (term, w); terms it doesn't have are 0, terms beyond it are left out."""
    return F.expr(f"transform(sequence(0, {dim - 1}), i -> coalesce(get(filter({sparse}, e -> e.term = i), 0).w, 0D))")


def minhash_distance(a: Name, b: Name) -> Column:
    """1 - the share of equal signature elements; 1 if the lengths differ or are zero."""
    same = f"aggregate(zip_with({a}, {b}, (x, y) -> IF(x <=> y, 1L, 0L)), 0L, (s, x) -> s + x)"
    return F.expr(f"IF(size({a}) = size({b}) AND size({a}) > 0, 1D - {same} / CAST(size({a}) AS DOUBLE), 1D)")


# half precision, by rounding and then computing in DOUBLE


def round_half(values: np.ndarray, kind: str) -> np.ndarray:
    """float32 values rounded to float16 or bfloat16 (to nearest, ties to even)."""
    values = np.asarray(values, np.float32)
    if kind == "float16":
        return values.astype(np.float16).astype(np.float32)
    bits = values.view(np.uint32)
    rounded = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(values), values, rounded.view(np.float32))


def matrix_distance(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of all queries (lines) to all rows (columns) of a block, by matrix products; of bit vectors (64-bit words)
    by counting bits."""
    if metric in ("l2", "l2_sq"):
        sq = np.maximum((queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * queries @ rows.T, 0)
        return sq if metric == "l2_sq" else np.sqrt(sq)
    if metric == "ip":
        return -(queries @ rows.T)
    if metric == "cosine":
        size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
        return 1 - np.divide(queries @ rows.T, size, out=np.zeros_like(size), where=size > 0)
    if metric in ("l1", "linf"):
        out = np.zeros((len(queries), len(rows)))
        for q, r in zip(queries.T, rows.T):
            out = out + np.abs(q[:, None] - r) if metric == "l1" else np.maximum(out, np.abs(q[:, None] - r))
        return out
    if metric in ("hamming", "jaccard"):
        pairs = [(q[:, None], r) for q, r in zip(queries.astype(np.int64).T, rows.astype(np.int64).T)]
        count = lambda f: sum((np.bitwise_count(f(q, r).view(np.uint64)).astype(np.float64) for q, r in pairs), np.zeros((len(queries), len(rows))))
        if metric == "hamming":
            return count(np.bitwise_xor)
        either = count(np.bitwise_or)
        return 1 - np.divide(count(np.bitwise_and), either, out=np.ones_like(either), where=either > 0)
    raise ValueError(f"unknown metric {metric!r}")


def rounded(values: np.ndarray, digits: int = 9) -> np.ndarray:
    """SQL's round(x, digits) + 0.0: the scaled value to the nearest integer, halves away from zero, and divided again."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = values * 10.0**digits
        out = np.rint(scaled)
        half = np.abs(scaled - out) == 0.5
        if half.any():
            out[half] = np.trunc(scaled[half]) + np.sign(scaled[half])
        out /= 10.0**digits
    out += 0.0
    return out if np.isfinite(out).all() else np.where(np.isfinite(out), out, values)


def _folded(term, queries: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(queries), columns.shape[1]))
    each = np.empty_like(out)
    for q, r in zip(queries.T, columns):
        out += term(r, q[:, None], each)
    return out


def _square(a, b, out):
    np.subtract(a, b, out=out)
    return np.multiply(out, out, out=out)


def _gap(a, b, out):
    return np.abs(np.subtract(a, b, out=out), out=out)


def _product(a, b, out):
    return np.multiply(a, b, out=out)


def norms(columns: np.ndarray) -> np.ndarray:
    """Norms of vectors given as columns, squares added in order of dimension."""
    out = np.zeros(columns.shape[1])
    for x in columns:
        out += x * x
    return np.sqrt(out)


def exact(metric: str, queries: np.ndarray, columns: np.ndarray, similar: bool = False, sizes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """What `distance` says of all queries (lines) and all rows (columns, a line a dimension), to the last bit: dimensions are
    added in their order, as the columns' folds and SQL add them. similar: products and similarities in place of distances.
    sizes: norms of both sides, for cosines."""
    if metric in ("l2", "l2_sq"):
        sq = _folded(_square, queries, columns)
        return np.sqrt(sq, out=sq) if metric == "l2" else sq
    if metric == "l1":
        return _folded(_gap, queries, columns)
    if metric == "ip":
        return _folded(_product, queries, columns) if similar else -_folded(_product, queries, columns)
    if metric == "cosine":
        nq, nr = sizes or (norms(queries.T), norms(columns))
        size = nr * nq[:, None]
        with np.errstate(invalid="ignore", over="ignore"):
            same = np.divide(_folded(_product, queries, columns), size, out=np.zeros_like(size), where=(size > 0) | np.isnan(size))
        return same if similar else np.subtract(1.0, same, out=same)
    far = matrix_distance(metric, queries, columns.T)
    return 1 - far if similar and metric == "jaccard" else far


def folded_square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared L2 of the lines of a and b, dimensions added in their order."""
    out = np.zeros(len(a))
    for x in ((a - b) ** 2).T:
        out += x
    return out


def _step_costs(a: np.ndarray, b: np.ndarray, cost: str, window: int | None, slope: float | None) -> np.ndarray:
    """What each pair of steps of two series costs; infinite outside of what is allowed."""
    each = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) if cost == "l2" else matrix_distance(cost, a, b)
    i, j = np.arange(len(a))[:, None], np.arange(len(b))[None]
    if window is not None:
        each = np.where(np.abs(i - j) <= window, each, np.inf)
    if slope is not None:
        ratio = (i + 1) / (j + 1)
        each = np.where((ratio <= max(slope, 1.0)) & (1 / ratio <= max(slope, 1.0)), each, np.inf)
    return each


def dtw(a: np.ndarray, b: np.ndarray, cost: str = "l2", window: int | None = None, slope: float | None = None) -> float:
    """Dynamic time warping of two series of steps, optionally inside a band |i - j| <= window, or where the
    steps' numbers, from 1, are in a ratio of at most `slope` either way.

    Infinite if a series is empty or no path stays inside.
    """
    return float(_warped(_step_costs(a, b, cost, window, slope)[None])[0]) if len(a) and len(b) else float("inf")


def dtw_many(a: np.ndarray, b: np.ndarray, cost: str = "l2", window: int | None = None, slope: float | None = None, pairs: int = 256) -> np.ndarray:
    """dtw of all series of numbers `a` (lines) with all of `b`, a matrix. Each side's are equally long. About `pairs` pairs are
    warped side by side, anti-diagonal by anti-diagonal, only over cells that are allowed; three diagonals are all that is kept."""
    n, m = a.shape[1], b.shape[1]
    out = np.full((len(a), len(b)), np.inf)
    if n and m:
        for j in range(0, len(b), pairs):
            some = b[j : j + pairs]
            for i in range(0, len(a), step := max(1, pairs // len(some))):
                out[i : i + step, j : j + pairs] = _warped_many(a[i : i + step], some, cost, window, slope)
    return out


def _allowed(n: int, m: int, k: int, window: int | None, slope: float | None) -> tuple[int, int]:
    """First line of anti-diagonal k that a path may cross, and the one after the last."""
    lo, hi = max(0, k - m + 1), min(n, k + 1)
    if window is None and slope is None:
        return lo, hi
    i = np.arange(lo, hi)
    ok = np.ones(len(i), bool) if window is None else np.abs(2 * i - k) <= window
    if slope is not None:
        ratio = (i + 1) / (k - i + 1)
        ok &= (ratio <= max(slope, 1.0)) & (1 / ratio <= max(slope, 1.0))
    i = i[ok]
    return (int(i[0]), int(i[-1]) + 1) if len(i) else (lo, lo)


def _warped_many(a: np.ndarray, b: np.ndarray, cost: str, window: int | None, slope: float | None) -> np.ndarray:
    n, m, width = a.shape[1], b.shape[1], len(a) * len(b)
    x = np.repeat(np.ascontiguousarray(a.T, np.float64), len(b), axis=1)
    y = np.tile(np.ascontiguousarray(b.T[::-1], np.float64), (1, len(a)))  # from the end, so that diagonals are slices
    before, last, now = (np.full((n + 1, width), np.inf) for _ in range(3))  # by line, from 1; two diagonals back, and one
    before[0] = 0.0
    costs = np.empty((n, width))
    for k in range(n + m - 1):
        lo, hi = _allowed(n, m, k, window, slope)
        if lo < hi:
            s, t, each, best = x[lo:hi], y[m - 1 - k + lo : m - 1 - k + hi], costs[: hi - lo], now[lo + 1 : hi + 1]
            if cost == "l2":
                np.abs(np.subtract(s, t, out=each), out=each)
            else:
                np.multiply(s, t, out=each)
                np.negative(each, out=each) if cost == "ip" else np.subtract(1.0, np.sign(each, out=each), out=each)
            np.minimum(last[lo:hi], last[lo + 1 : hi + 1], out=best)
            np.minimum(best, before[lo:hi], out=best)
            np.add(best, each, out=best)
        now[: lo + 1] = np.inf
        now[hi + 1 :] = np.inf
        before, last, now = last, now, before
    return last[n].reshape(len(a), len(b))


def _warped(each: np.ndarray) -> np.ndarray:
    """Least path costs through a stack of cost tables (pairs, n, m), one anti-diagonal of all tables at a time."""
    pairs, n, m = each.shape
    before, last = np.full((pairs, n + 1), np.inf), np.full((pairs, n + 1), np.inf)  # by line, from 1; two diagonals back, and one
    before[:, 0] = 0.0
    for k in range(n + m - 1):
        lo, hi = max(0, k - m + 1), min(n, k + 1)
        i = np.arange(lo, hi)
        best = np.minimum(np.minimum(last[:, i], last[:, i + 1]), before[:, i])
        now = np.full((pairs, n + 1), np.inf)
        now[:, i + 1] = each[:, i, k - i] + best
        before, last = last, now
    return last[:, n]
