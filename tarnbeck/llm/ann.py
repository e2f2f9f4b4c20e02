"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are projected to a few dimensions in several random ways, each with its own shift, and
ordered along a Hilbert curve there. Each ordering is cut into range partitions ("blocks") of
about equal size. A query looks at the blocks around its own place in each ordering, is scored
exactly against every vector in them, and what the orderings found is merged and ranked again.

How many blocks to look at is measured, not guessed: a bounded sample of queries is answered by
brute force, and the half-width is the smallest that finds the wanted share of true neighbours.
On vectors with structure it is small. On vectors without any (independent noise) no ordering
keeps neighbours together, and the half-width grows towards the whole ordering.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .tables import stash

#: A neighbour: minus its inner product, its id, and the number of its row; sorted as it stands, nearest first.
FOUND = "array<struct<loss:double,id:long,row:long>>"
#: Lists of one query that are merged at a time.
LISTS_AT_ONCE = 32


@dataclass(frozen=True)
class Curves:
    """Projections (curve, dim, axis), quantisation edges (curve, axis, level) and bits."""

    axes: np.ndarray
    edges: np.ndarray
    bits: int

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(n, curve) Hilbert indices."""
        return np.stack([self._key(vectors, c) for c in range(len(self.axes))], axis=1)

    def _key(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        low = vectors @ self.axes[curve]
        cells = np.stack(
            [np.searchsorted(e, low[:, k], side="right") for k, e in enumerate(self.edges[curve])], axis=1
        )
        return hilbert_index(cells.astype(np.int64), self.bits)


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (n, dims) with so many bits an axis
    (Skilling, "Programming the Hilbert curve", 2004), for all rows at once."""
    x = cells.T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for k in range(dims):
            up = (x[k] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    x ^= turn
    out = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            out = (out << 1) | ((x[k] >> level) & 1)
    return out


def fit_curves(sample: np.ndarray, curves: int, axes: int, bits: int, seed: int) -> Curves:
    """Random orthogonal projections, cells of equal frequency in the sample, and for each curve
    a random shift of the cells' edges by a part of a cell."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    planes, edges = [], []
    for _ in range(curves):
        plane = np.linalg.qr(rng.standard_normal((dim, min(axes, dim))))[0]
        planes.append(plane)
        shares = (np.arange(1, 1 << bits) - rng.random()) / (1 << bits)
        edges.append(np.quantile(sample @ plane, np.clip(shares, 0, 1), axis=0).T)
    return Curves(np.array(planes), np.array(edges), bits)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, and all components finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _best(
    queries: np.ndarray, base: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length of each query's list, loss, id, row) of the k best rows of a block for each query, by
    (loss, id, row). Products of whole matrices may round in another way, so every row that could be
    among the k best within the rounding error, however many tie there, is summed again from first
    component to last."""
    scores = queries @ base.T
    if k < scores.shape[1]:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        size = np.abs(queries) @ np.abs(base).max(axis=0)
        found = scores >= (edge - 1e-15 * queries.shape[1] * size)[:, None]
    else:
        found = np.ones(scores.shape, bool)
    query, at = np.nonzero(found)
    loss = np.concatenate(
        [np.empty(0), *(-np.cumsum(queries[query[s : s + 8192]] * base[at[s : s + 8192]], axis=1)[:, -1] for s in range(0, len(query), 8192))]
    )
    order = np.lexsort((rows[at], ids[at], loss, query))
    query, at, loss = query[order], at[order], loss[order]
    first = np.searchsorted(query, np.arange(len(queries)))
    keep = np.arange(len(query)) - first[query] < k
    return np.bincount(query[keep], minlength=len(queries)), loss[keep], ids[at[keep]], rows[at[keep]]


def _pack(asker: np.ndarray, part: np.ndarray, size: np.ndarray, loss: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(loss), pa.array(ids), pa.array(rows)], names=["loss", "id", "row"])
    return pa.RecordBatch.from_arrays(
        [pa.array(asker), pa.array(part), pa.ListArray.from_arrays(pa.array(offsets), entries)], names=["asker", "part", "found"]
    )


def _merge(found: DataFrame, k: int, orderings: int = 1, lists: int = 1) -> DataFrame:
    """(asker, part, found) to (asker, found): the k best of an asker's lists; a neighbour found in
    several orderings is kept once. A row stands once in each ordering, so the first k times that many
    entries hold the k best. An asker has as many lists as it looked at blocks, so they are merged
    LISTS_AT_ONCE at a time."""
    entries = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k * orderings)
    best = F.slice(F.array_distinct(entries), 1, k).alias("found")
    while lists > LISTS_AT_ONCE:
        lists = math.ceil(lists / LISTS_AT_ONCE)
        found = found.groupBy("asker", F.pmod("part", F.lit(lists)).alias("part")).agg(best)
    return found.groupBy("asker").agg(best)


def brute_force(base: DataFrame, askers: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(asker, found) of a bounded set of queries against every row of base (id, row, vec)."""
    dim = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                best = _best(vectors, _matrix(batch.column(2), dim), batch.column(0).to_numpy(), batch.column(1).to_numpy(), k)
                new = [np.repeat(np.arange(len(askers)), best[0]), *best[1:]]
                both = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
                order = np.lexsort((both[3], both[2], both[1], both[0]))
                query = both[0][order]
                keep = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
                held = [x[keep] for x in both]
        if held is not None:
            task = np.full(len(askers), TaskContext.get().partitionId(), np.int64)
            yield _pack(askers, task, np.bincount(held[0], minlength=len(askers)), *held[1:])

    lists = base.select("id", "row", "vec").mapInArrow(run, f"asker long, part long, found {FOUND}")
    return _merge(lists, k, lists=LISTS_AT_ONCE**2)


def _places(curves: Curves, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(n, curve): the Hilbert index with a hash of the id below it, so that a crowd in one cell
    still spreads over blocks."""
    low = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)
    return (curves.keys(vectors) << 12) | low[:, None]


def _cut_points(base: DataFrame, curves: Curves, dim: int, blocks: int, rows: int, a_block: int, seed: int) -> list[np.ndarray]:
    """For each curve, places that cut all rows into so many blocks of about equal size, by a sample
    of about a_block rows for each block."""
    if blocks == 1:
        return [np.empty(0, np.int64)] * len(curves.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _places(curves, batch.column(0).to_numpy(), _matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in places.T], names=[f"c{c}" for c in range(places.shape[1])])

    scale = 1 << 30
    share = min(scale, math.ceil(scale * a_block * blocks / max(1, rows)))
    picked = base.filter(F.pmod(F.xxhash64("row", F.lit(seed + 1)), F.lit(scale)) < share).select("row", "vec")
    table = picked.mapInArrow(run, ", ".join(f"c{c} long" for c in range(len(curves.axes)))).toArrow()
    cuts = []
    for column in table.columns:
        sample = np.sort(column.to_numpy())
        cuts.append(sample[np.arange(1, blocks) * len(sample) // blocks] if len(sample) else np.empty(0, np.int64))
    return cuts


def _half_width(distance: np.ndarray, blocks: int, recall: float) -> tuple[int, int]:
    """distance (pair, curve), in blocks, of probe queries and their true neighbours: the number
    of orderings, two at least, and the half-width that find the wanted share of the pairs while
    the fewest blocks are looked at."""
    best = None
    for n in range(min(2, distance.shape[1]), distance.shape[1] + 1):
        nearest = np.sort(distance[:, :n].min(axis=1))
        width = int(nearest[max(0, math.ceil(recall * len(nearest)) - 1)]) if len(nearest) else blocks
        cost = n * min(2 * width + 1, blocks)
        if best is None or cost < best[0]:
            best = cost, n, width
    return best[1:]


def _dealt(base: DataFrame, index: Index) -> DataFrame:
    """base (id, row, vec, ask) to (block, kind, id, row, vec): each row in its block of each
    ordering (kind 0), and the rows that ask in all blocks that they look at (kind 1)."""
    blocks, used, width, dim, curves, cuts = index.blocks, index.orderings, index.half_width, index.dim, index.curves, index.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            places = _places(curves, batch.column(1).to_numpy(), _matrix(batch.column(2), dim))
            for c in range(used):
                own = np.searchsorted(cuts[c], places[:, c], side="right")
                near = own[asks][:, None] + np.arange(-min(width, blocks), min(width, blocks) + 1)
                real = (near >= 0) & (near < blocks)
                for kind, rows, block in ((0, np.arange(len(own)), own), (1, np.repeat(asks, real.sum(axis=1)), near[real])):
                    for s in range(0, len(rows), 16384):
                        part = pa.array(rows[s : s + 16384])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(block[s : s + 16384].astype(np.int64) * used + c),
                                pa.array(np.full(len(part), kind, np.int32)),
                                *(batch.column(i).take(part) for i in range(3)),
                            ],
                            names=["block", "kind", "id", "row", "vec"],
                        )

    return base.select("id", "row", "vec", "ask").mapInArrow(run, f"block long, kind int, id long, row long, vec {base.schema['vec'].dataType.simpleString()}")


def _scan_blocks(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """rows (block, kind, id, row, vec) sorted by block with the base rows (kind 0) first: scores the
    queries of each block against it. A task holds one block and one batch of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            block, kind, ids, numbers = (batch.column(i).to_numpy() for i in range(4))
            matrix = _matrix(batch.column(4), dim)
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if lo == hi:
                    continue
                if block[lo] != at:
                    at, held = block[lo], []
                if kind[lo] == 0:
                    held.append((matrix[lo:hi], ids[lo:hi], numbers[lo:hi]))
                elif held:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                    for s in range(lo, hi, 256):
                        e = min(s + 256, hi)
                        yield _pack(numbers[s:e], block[s:e], *_best(matrix[s:e], *held[0], k))

    return rows.mapInArrow(run, f"asker long, part long, found {FOUND}")


@dataclass(frozen=True)
class Index:
    """Curves with their blocks, and what was measured: how many orderings are used, and how many
    blocks on either side of its own a query looks at in each. recall is that of the probes."""

    dim: int
    curves: Curves
    cuts: list[np.ndarray]
    orderings: int
    half_width: int
    recall: float

    @property
    def blocks(self) -> int:
        return len(self.cuts[0]) + 1

    @property
    def looked_at(self) -> float:
        """Share of all blocks that a query looks at, summed over the orderings used."""
        return self.orderings * min(2 * self.half_width + 1, self.blocks) / self.blocks


def fit_index(
    base: DataFrame, dim: int, k: int, curves: int = 8, axes: int = 8, bits: int = 5, block_rows: int = 2048, most_blocks: int = 1 << 16,
    fit_rows: int = 8192, cut_rows: int = 32, probe_queries: int = 192, recall: float = 0.97, seed: int = 11,
) -> Index:
    """base (id, row, vec, ask): projections are scaled on fit_rows rows, blocks are cut by a sample of
    cut_rows rows for each, and half-widths set by probe_queries queries that are answered by brute
    force. Blocks have about block_rows rows, and more where there would be over most_blocks; so what
    the driver holds is bounded."""
    rows = base.count()
    blocks = max(1, min(most_blocks, math.ceil(rows / block_rows)))
    by_chance = (F.xxhash64("row", F.lit(seed)), F.col("row"))
    sample = base.select("row", "vec").orderBy(*by_chance).limit(fit_rows).toArrow().combine_chunks()
    fitted = fit_curves(_matrix(sample["vec"].combine_chunks(), dim), curves, axes, bits, seed)
    cuts = _cut_points(base, fitted, dim, blocks, rows, cut_rows, seed)
    probes = base.filter("ask").select("row", "vec").orderBy(*by_chance).limit(probe_queries).toArrow().combine_chunks()
    if not probes.num_rows or blocks == 1:
        return Index(dim, fitted, cuts, min(2, curves) if blocks > 1 else 1, 0, 1.0)
    own_rows, own_vecs = probes["row"].to_numpy(), _matrix(probes["vec"].combine_chunks(), dim)
    truth = brute_force(base, own_rows, own_vecs, k + 1).select("asker", F.explode("found.row").alias("row"))
    pairs = truth.filter("asker <> row").join(base.select("row", "vec"), "row").toArrow().combine_chunks()
    if not pairs.num_rows:
        return Index(dim, fitted, cuts, min(2, curves), 0, 1.0)
    place = dict(zip(own_rows.tolist(), _places(fitted, own_rows, own_vecs), strict=True))
    one = np.stack([place[i] for i in pairs["asker"].to_pylist()])
    two = _places(fitted, pairs["row"].to_numpy(), _matrix(pairs["vec"].combine_chunks(), dim))
    block = [[np.searchsorted(cut, side[:, c], side="right") for c, cut in enumerate(cuts)] for side in (one, two)]
    apart = np.abs(np.array(block[0]) - np.array(block[1])).T
    used, width = _half_width(apart, blocks, recall)
    return Index(dim, fitted, cuts, used, width, float((apart[:, :used].min(axis=1) <= width).mean()))


def searchable(vectors: DataFrame, is_query: Column, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, ask, row) of the rows that take part; row is a number of its own for each."""
    kind = vectors.schema[vec_col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    vec = F.col(vec_col) if narrow else F.col(vec_col).cast("array<double>")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("ask"))
    return stash(clean.filter(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("row", F.monotonically_increasing_id()), "vectors")


def grouped(rows: DataFrame, k: int) -> DataFrame:
    """(id, row, vec, members, ask): equal vectors become one row, that of their smallest (id, row);
    members are the k + 1 smallest of them, as no more can be among the k nearest of any query. They are
    picked in two steps, so a vector that a third of all rows share is no one task's."""
    entry = F.struct("id", "row")
    few = F.slice(F.sort_array(F.collect_list("m")), 1, k + 1)
    salted = Window.partitionBy("vec", "salt").orderBy("id", "row")
    near = rows.withColumn("salt", F.pmod("row", F.lit(64))).withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= k + 1)
    groups = near.select("vec", entry.alias("m")).groupBy("vec").agg(few.alias("members"))
    asked = rows.filter("ask").groupBy("vec").agg(F.lit(True).alias("ask"))
    return groups.join(asked, "vec", "left").select(
        F.col("members")[0]["id"].alias("id"), F.col("members")[0]["row"].alias("row"), "vec", "members", F.coalesce("ask", F.lit(False)).alias("ask")
    )


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, **options
) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double) of each query's k nearest rows by
    inner product, ties to the smaller id; fewer if there are fewer candidates.

    Null vectors and ids, zero vectors and those with null or non-finite components take no part. A
    query's candidates are all rows but its own that have as many components as it has, as an inner product
    needs that. Rows that share an id are rows of their own, as queries and as candidates. Scores are
    sums in double precision of the vectors as they are, float or double. Equal vectors are
    indexed once. An empty table gives no rows. Columns other than the two named are not read.

    options are those of fit_index. Every row is indexed, and recall is what is aimed at. Vectors of
    each length have an index of their own.
    """
    rows = searchable(vectors, is_query, id_col, vec_col)
    lengths = sorted(r[0] for r in rows.select(F.size("vec")).distinct().collect())
    parts = [_search(rows.filter(F.size("vec") == dim), dim, k, options) for dim in lengths]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _search(rows: DataFrame, dim: int, k: int, options: dict) -> DataFrame:
    base = stash(grouped(rows, k), "base")
    index = fit_index(base, dim, k, **options)
    asked = rows.filter("ask").select("vec", F.col("id").alias("query_id"), F.col("row").alias("own"))
    queries = asked.join(base.filter("ask").select("vec", F.col("row").alias("asker")), "vec").select("query_id", "own", "asker")
    dealt = _dealt(base, index).repartition("block").sortWithinPartitions("block", "kind")
    lists = index.orderings * min(2 * index.half_width + 1, index.blocks)
    found = _merge(_scan_blocks(dealt, dim, k + 1), k + 1, index.orderings, lists).select("asker", F.inline("found"))
    members = found.select("asker", "loss", "row").join(base.select("row", "members"), "row").select("asker", "loss", F.explode("members").alias("m"))
    entry = F.struct("loss", F.col("m.id").alias("id"), F.col("m.row").alias("row"))
    whole = members.groupBy("asker").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("found"))
    ranked = queries.join(whole, "asker").select(
        "query_id", F.slice(F.filter("found", lambda x: x["row"] != F.col("own")), 1, k).alias("found")
    )
    return ranked.select("query_id", F.posexplode("found").alias("at", "f")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.loss")).alias("score")
    )
