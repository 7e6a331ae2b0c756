"""Vector code compression: product codebooks by Lloyd's rounds with Elkan's bounds, in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import discard, free_names, materialize, quoted, sized, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: What roots of whole numbers are moved by, so that an upper bound is never too low and a lower one never too high.
EPS = 1e-9
#: Rows that are worked on at once.
ROWS = 2048


@dataclass(frozen=True)
class Codebooks:
    """books[part, entry, component] in whole numbers; a vector of `dim` components fills its parts, the last with zeros."""

    books: np.ndarray
    dim: int
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry."""
    out = np.zeros((len(x), len(book)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - book[None, :, i]) ** 2
    return out


@dataclass(frozen=True)
class _Round:
    """What the tasks of one assignment need of the codebooks, all of it as large as they are.

    half: half the distances between entries (infinite to itself), near: the least of each row, step: what one unit of a
    stored lower bound means, move: how far each entry moved since the last assignment.
    """

    books: np.ndarray
    half: np.ndarray
    near: np.ndarray
    step: np.ndarray
    move: np.ndarray
    step_before: np.ndarray

    @staticmethod
    def of(books: np.ndarray, before: _Round | None = None) -> _Round:
        n, k, _ = books.shape
        gap = np.array([_roots(_squares(b, b)) for b in books]).reshape(n, k, k)
        half = gap / 2 * (1 - EPS)
        half[:, np.arange(k), np.arange(k)] = np.inf
        step = np.maximum(gap.reshape(n, -1).max(axis=1, initial=0) / 127, 1.0)
        move = np.zeros((n, k)) if before is None else _roots(((books - before.books) ** 2).sum(axis=2)) * (1 + EPS)
        return _Round(books, half, half.min(axis=2, initial=np.inf), step, move, step if before is None else before.step)


def _assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries, upper bounds and lower bounds, from all distances."""
    d = _squares(x, book)
    a = d.argmin(axis=1)
    r = _roots(d)
    return a, r[np.arange(len(x)), a] * (1 + EPS), r * (1 - EPS)


def _reassign(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, book: np.ndarray, half: np.ndarray, near: np.ndarray, move: np.ndarray) -> int:
    """The same from bounds, in place; returns how many distances to other entries were worked out.

    An entry is passed over only if a bound says that it is strictly farther; those that may tie are measured, and the
    least whole number decides, ties going to the lower index.
    """
    u += move[a]
    np.maximum(low - move, 0, out=low)
    r = np.flatnonzero(u >= near[a])
    may = (u[r, None] >= low[r]) & (u[r, None] >= half[a[r]])
    r = r[may.any(axis=1)]
    if not len(r):
        return 0
    at, every = a[r], np.arange(len(r))
    own = ((x[r] - book[at]) ** 2).sum(axis=1)
    tight = _roots(own)
    low[r, at] = tight * (1 - EPS)
    u[r] = tight = tight * (1 + EPS)
    i, c = np.nonzero((tight[:, None] >= low[r]) & (tight[:, None] >= half[at]))
    d = ((x[r[i]] - book[c]) ** 2).sum(axis=1)
    low[r[i], c] = _roots(d) * (1 - EPS)
    all_d = np.full((len(r), len(book)), np.iinfo(np.int64).max)
    all_d[i, c] = d
    all_d[every, at] = own
    a[r] = best = all_d.argmin(axis=1)
    u[r] = _roots(all_d[every, best]) * (1 + EPS)
    return len(i)


def _fixed(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A binary column of rows of equal size as an array (rows, width)."""
    size = np.dtype(dtype).itemsize * width
    start = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0] if len(column) else 0
    return np.frombuffer(column.buffers()[2], dtype, len(column) * width, int(start)).reshape(len(column), width) if len(column) and size else np.zeros((len(column), width), dtype)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    size = x.nbytes // max(1, len(x))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(x.tobytes())])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def _bound_rows(x, a, u, low, step):
    """What is kept of an assignment: codes, upper bounds rounded up to floats, lower bounds rounded down to a byte."""
    up = np.nextafter(u.astype(np.float32), np.float32(np.inf))
    return [_binary(x.astype(np.int32)), _binary(a.astype(np.uint8)), _binary(up), _binary(np.minimum(low / step[None, :, None], 255).astype(np.uint8))]


def _columns(b: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [b.column(b.schema.get_field_index(n)) for n in names]


@dataclass(frozen=True)
class _Names:
    row: str
    x: str
    a: str
    u: str
    low: str


def _start(q: DataFrame, n: _Names, parts: int, width: int, now: _Round) -> DataFrame:
    k, schema = now.books.shape[1], T.StructType([q.schema[n.row], *(T.StructField(c, T.BinaryType()) for c in (n.x, n.a, n.u, n.low))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            row, v = _columns(b, n.row, n.x)
            x = np.zeros((len(v), parts * width), np.int64)
            sizes = np.diff(v.offsets.to_numpy())
            at = np.repeat(np.arange(len(v)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x[at] = v.flatten().to_numpy(zero_copy_only=False)
            a, u, low = np.zeros((len(v), parts), np.int64), np.zeros((len(v), parts)), np.zeros((len(v), parts, k))
            for p in range(parts):
                a[:, p], u[:, p], low[:, p] = _assign(x[:, p * width : (p + 1) * width], now.books[p])
            yield pa.RecordBatch.from_arrays([row, *_bound_rows(x, a, u, low, now.step)], names=[n.row, n.x, n.a, n.u, n.low])

    return q.select(n.row, n.x).mapInArrow(run, schema)


def _bounded(b: pa.RecordBatch, n: _Names, parts: int, width: int, now: _Round):
    """A batch's rows, vectors, codes and bounds after the assignment to the entries that have moved."""
    k = now.books.shape[1]
    row, *kept = _columns(b, n.row, n.x, n.a, n.u, n.low)
    x, a = _fixed(kept[0], np.int32, parts * width).astype(np.int64), _fixed(kept[1], np.uint8, parts).astype(np.int64)
    u, low = _fixed(kept[2], np.float32, parts).astype(np.float64), _fixed(kept[3], np.uint8, parts * k).reshape(-1, parts, k) * now.step_before[None, :, None] * (1 - EPS)
    for p in range(parts):
        ap, upper, lower = a[:, p].copy(), u[:, p].copy(), low[:, p].copy()
        _reassign(x[:, p * width : (p + 1) * width], ap, upper, lower, now.books[p], now.half[p], now.near[p], now.move[p])
        a[:, p], u[:, p], low[:, p] = ap, upper, lower
    return row, x, a, u, low


def _again(state: DataFrame, n: _Names, parts: int, width: int, now: _Round) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            row, x, a, u, low = _bounded(b, n, parts, width, now)
            yield pa.RecordBatch.from_arrays([row, *_bound_rows(x, a, u, low, now.step)], names=[n.row, n.x, n.a, n.u, n.low])

    return state.select(n.row, n.x, n.a, n.u, n.low).mapInArrow(run, state.schema)


def _finish(state: DataFrame, n: _Names, parts: int, width: int, now: _Round, code: str, error: str) -> DataFrame:
    schema = T.StructType([state.schema[n.row], T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            row, x, a, _, _ = _bounded(b, n, parts, width, now)
            near = now.books[np.arange(parts)[None, :], a].reshape(len(a), -1)
            hexes = a.astype(np.uint8).tobytes().hex()
            said = [hexes[i : i + 2 * parts] for i in range(0, len(hexes), 2 * parts)]
            yield pa.RecordBatch.from_arrays([row, pa.array(said, pa.string()), pa.array(((x - near) ** 2).sum(axis=1), pa.int64())], names=[n.row, code, error])

    return state.select(n.row, n.x, n.a, n.u, n.low).mapInArrow(run, schema)


def _moved(state: DataFrame, n: _Names, parts: int, width: int, now: _Round) -> np.ndarray:
    """The codebooks after one update. A task sends one row for each entry it met; what reaches the driver is as large as the codebooks."""
    k, sums = now.books.shape[1], [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for b in _sliced(batches):
            x, a = _columns(b, n.x, n.a)
            slot = (_fixed(a, np.uint8, parts).astype(np.int64) + np.arange(parts)[None, :] * k).ravel()
            v = _fixed(x, np.int32, parts * width).astype(np.int64).reshape(-1, width)
            count += np.bincount(slot, minlength=parts * k)
            np.add.at(total, slot, v)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met]), *(pa.array(total[met, i]) for i in range(width))], names=["slot", "n", *sums])

    partial = state.select(n.x, n.a).mapInArrow(run, "slot int, n long, " + ", ".join(f"{s} long" for s in sums))
    books = now.books.copy().reshape(parts * k, width)
    for r in partial.groupBy("slot").agg(F.sum("n"), *(F.sum(s) for s in sums)).collect():
        books[r[0]] = [s // r[1] for s in r[2:]]
    return books.reshape(now.books.shape)


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, code: str = "code", error: str = "error"
) -> tuple[DataFrame, Codebooks]:
    """vectors without the vector's column, with code and error (in place of columns of these names), and the codebooks.

    Each component x is floor(scale * x). A vector is `parts` equal consecutive parts, and the codebook of a part starts as
    that part of the vectors of the `entries` smallest keys (ties by the vector, null keys never). Each round assigns
    every part to the nearest entry, ties to the lower index, then moves each entry to the floored mean of its parts;
    entries without parts stay. Then parts are assigned once more; error is the sum of the squared distances.

    The first assignment measures all distances and writes, for each part, an upper bound on the distance to its entry and
    a lower bound for each entry (one byte, rounded down). Later ones shift the bounds by how far entries moved, and
    measure what the triangle inequality leaves open. Distances are whole numbers, so ties are exact. There is no
    shuffle but of sums by entry, and no row meets another.

    Rows whose vector is null or has null or non-finite components go. Shorter vectors count as padded with zeros, and the
    length is that of the longest, rounded up to a multiple of the parts. Repeated rows and null keys stay. Fewer than
    `entries` vectors make smaller codebooks, keyless ones alone start from one entry of zeros; none make no rows. Vectors of which distances may pass 2^62 raise a
    ValueError. entries is 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rest = [c for c in vectors.columns if c.lower() not in {vector.lower(), code.lower(), error.lower()}]
    n = _Names(*free_names(vectors, "row", "x", "a", "u", "low"))
    x = F.transform(F.col(quoted(vector)), lambda c: c.cast("double"))
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    large = F.exists(x, lambda c: F.abs(c) * scale >= float(1 << 27))
    kept = vectors.where(F.col(quoted(vector)).isNotNull()).where(ok)
    dim, wide = kept.agg(F.coalesce(F.max(F.size(quoted(vector))), F.lit(0)), F.coalesce(F.max(large.cast("int")), F.lit(0))).first()
    dim = max(1, -(-dim // parts)) * parts
    if wide or dim > 64 << 10:
        raise ValueError("distances of these vectors may pass 2^62: scale them down")
    row = F.struct(*(F.col(quoted(c)) for c in rest)) if rest else F.struct(F.lit(None).cast("string").alias("none"))
    q = kept.select(row.alias(n.row), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias(n.x))
    first = kept.where(F.col(quoted(key)).isNotNull()).select(F.col(quoted(key)).alias("k"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    seeds = first.orderBy("k", "v").limit(entries).collect()
    width = dim // parts
    books = np.zeros((len(seeds), dim), np.int64)
    for i, s in enumerate(seeds):
        books[i, : len(s["v"])] = s["v"]
    if not seeds:  # only vectors without a key: nothing to start from but zeros
        books = np.zeros((1, dim), np.int64)
    now = _Round.of(np.ascontiguousarray(books.reshape(len(books), parts, width).transpose(1, 0, 2)))
    state = materialize(_start(q, n, parts, width, now))
    for done in range(rounds):
        now = _Round.of(_moved(state, n, parts, width, now), now)
        if done + 1 < rounds:
            state, old = materialize(_again(state, n, parts, width, now)), state
            discard(old)
    out = _finish(state, n, parts, width, now, code, error)
    return out.select(*(F.col(f"{n.row}.{quoted(c)}").alias(c) for c in rest), code, error), Codebooks(now.books, dim, scale)


def decode(codes: DataFrame, books: Codebooks, code: str = "code", out: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for: the middle of its entries' cells, scaled back."""
    parts, _, width = books.books.shape
    entries = F.array(*(F.array(*(F.array(*(F.lit((float(c) + 0.5) / books.scale) for c in e)) for e in part)) for part in books.books.tolist()))
    at = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(out, F.flatten(F.array(*(F.get(F.get(entries, F.lit(p)), at(p)) for p in range(parts)))))


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    out = materialize(out)
    by = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    j = out.join(sized(by), F.col("label").eqNullSafe(F.col("of")), "left")
    return j.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """One assignment to the books c{k} and the update to c{k + 1}."""
    return f"""
a{k} AS (SELECT r, p, any_value(v) AS v, min(d * 256 + e) AS de FROM (SELECT r, x.p, v, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c{k} USING (p)) GROUP BY r, p),
m{k} AS (SELECT p, de % 256 AS e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, de, i, sum(s)::DOUBLE AS s, count(*) AS n FROM (SELECT p, de % 256 AS de, unnest(v) AS s, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY p, de, i) GROUP BY p, de % 256),
c{k + 1} AS (SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e)),"""


SQL = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
x AS (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM v, range({PARTS}) AS t(p)),
c0 AS (SELECT p, r - 1 AS e, v AS c FROM x WHERE r <= {ENTRIES}),{_round_sql(0)}{_round_sql(1)}
f AS (SELECT r, p, min(d * 256 + e) AS de FROM (SELECT r, x.p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN c2 USING (p)) GROUP BY r, p),
g AS (SELECT r, string_agg(printf('%02x', de % 256), '' ORDER BY p) AS code, sum(de // 256)::BIGINT AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(s, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(c, ',') AS s FROM c2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN g USING (r), h"""
