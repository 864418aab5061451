"""Exact nearest vectors by inner product over an approximation file.

Every component is put in one of ``CELLS`` cells of equal width between the
least and greatest value of its dimension. The file of cell numbers, a byte per
component, is scanned block by block: the cells' edges bound each score from
both sides, and a candidate goes on if its upper bound reaches the kth greatest
lower bound. Where the bounds of a survivor differ, exact vectors are read in the
order of the upper bounds, first twice k of a query, then whatever can still
reach the kth score; the kth result is then certain.

Equal vectors are one candidate with up to k + 1 of its smallest ids, and equal
queries are answered once. Blocks of queries meet blocks of candidates by the
number of a group of blocks; no rows are paired with all rows.

Defined results: vectors that are null, or hold null or non-finite components,
and null ids take no part. Only vectors of one length are comparable. A row
repeated with its id counts once. Scores and components beyond a long are refused.
Other columns are not read. An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardflow.session import settle

CELLS = 256
BLOCK = 2048
QUERY_BLOCK = 256
# Blocks of candidates that one task scans for a block of queries.
GROUP_BLOCKS = 32


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component; null if the vector takes no part.

    A finite component whose product does not fit a long is refused.
    """
    wide = F.transform(vector, lambda x: x.cast("double") * factor)
    bad = F.exists(F.transform(vector, lambda x: x.cast("double")),
                   lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.transform(wide, lambda x: F.when(F.abs(x) < 2.0 ** 62, F.floor(x)).otherwise(
        F.raise_error(F.lit("a component is too large for whole numbers"))))
    return F.when(vector.isNotNull() & ~bad, fits)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` rows (id, vector): ids and components as bytes."""
    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                for k in range(0, own.num_rows, size):
                    part = own.slice(k, size)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([int(dim)], pa.int32()),
                        pa.array([part.column(0).to_numpy().tobytes()], pa.binary()),
                        pa.array([part.column(1).flatten().to_numpy().astype(np.int64)
                                  .tobytes()], pa.binary())], names=["dim", "ids", "data"])

    return rows.select("id", "vector", F.size("vector").alias("dim")).mapInArrow(
        run, "dim int, ids binary, data binary")


def _edges(classes: DataFrame, cells: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: each dimension's least value and cell width. One row a dimension."""
    rows = (classes.select(F.size("vector").alias("dim"), F.posexplode("vector"))
            .groupBy("dim", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high"))
            .orderBy("dim", "pos").collect())
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in rows}:
        low, high = (np.array([r[c] for r in rows if r["dim"] == dim], np.int64)
                     for c in ("low", "high"))
        found[dim] = (low, -(-(high - low + 1) // cells))
    return found


def _approximated(blocks: DataFrame, edges: dict, groups: int) -> DataFrame:
    """The approximation file: cell numbers of every block."""
    def run(batches):
        for batch in batches:
            codes = []
            for dim, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                 strict=True):
                values = np.frombuffer(data, np.int64).reshape(-1, dim or 1)[:, :dim]
                low, width = edges.get(dim, (np.zeros(0, np.int64), np.ones(0, np.int64)))
                codes.append(((values - low) // width).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.binary())],
                names=["dim", "ids", "codes"])

    coded = blocks.mapInArrow(run, "dim int, ids binary, codes binary")
    return settle(coded.withColumn("grp", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")),
                  "approximations")


def _bounds(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of queries with boxes of values."""
    most = float(np.abs(query).max(initial=0)) * max(
        float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0))) * query.shape[1]
    if most >= 2.0 ** 63:
        raise ValueError("a score does not fit a long")
    kind = np.float64 if most < 2.0 ** 53 else np.int64  # both exact in their range
    query, low, high = query.astype(kind), low.astype(kind), high.astype(kind)
    if (low == high).all():
        exact = (query @ low.T).astype(np.int64)
        return exact, exact
    plus, minus = np.maximum(query, 0), np.minimum(query, 0)
    return ((plus @ low.T + minus @ high.T).astype(np.int64),
            (plus @ high.T + minus @ low.T).astype(np.int64))


class _Survivors:
    """Candidates of a block of queries that may be among the first k."""

    def __init__(self, names: np.ndarray, k: int):
        self._names, self._k = names, k
        self._least = np.full((len(names), k), np.iinfo(np.int64).min)
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._held = 0

    def scan(self, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        both = np.concatenate([self._least, lower], axis=1)
        self._least = np.partition(both, both.shape[1] - self._k, axis=1)[:, -self._k:]
        row, col = np.nonzero(upper >= self._least.min(axis=1)[:, None])
        self._parts.append((row, ids[col], lower[row, col], upper[row, col]))
        self._held += len(row)
        if self._held > 1 << 21:
            self._prune()

    def _prune(self) -> tuple[np.ndarray, ...]:
        row, ids, lower, upper = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        keep = upper >= self._least.min(axis=1)[row]
        self._parts = [(row[keep], ids[keep], lower[keep], upper[keep])]
        self._held = int(keep.sum())
        return self._parts[0]

    def batch(self) -> pa.RecordBatch:
        row, ids, lower, upper = self._prune()
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (self._names[row], ids, lower, upper)],
            names=["query", "id", "lower", "upper"])


def _scanned(queries: DataFrame, approximations: DataFrame, edges: dict, groups: int,
             k: int) -> DataFrame:
    """Survivors of every block of queries in every group of candidate blocks."""
    def run(batches):
        at, state, query = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(0)[row].as_py()
                names = batch.column(2)[row].as_buffer()
                key = (dim, batch.column(1)[row].as_py(), hash(bytes(names)))
                if key != at:
                    if state is not None:
                        yield state.batch()
                    ids = np.frombuffer(bytes(names), np.int64)
                    query = np.frombuffer(batch.column(3)[row].as_py(), np.int64).reshape(
                        len(ids), dim)
                    at, state = key, _Survivors(ids, k)
                ids = np.frombuffer(batch.column(4)[row].as_py(), np.int64)
                codes = np.frombuffer(batch.column(5)[row].as_py(), np.uint8).reshape(
                    len(ids), dim).astype(np.int64)
                first, width = edges.get(dim, (np.zeros(0, np.int64), np.ones(0, np.int64)))
                low = first + codes * width
                state.scan(ids, *_bounds(query, low, low + width - 1))
        if state is not None:
            yield state.batch()

    spread = queries.select("dim", F.col("ids").alias("q_ids"), "data",
                            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    pairs = (spread.join(approximations, ["dim", "grp"])
             .select("dim", "grp", "q_ids", "data", "ids", "codes")
             # The block of queries is the same in the rows that follow each other.
             .repartition("dim", "grp", F.xxhash64("q_ids")).sortWithinPartitions("grp", "q_ids"))
    return pairs.mapInArrow(run, "query long, id long, lower long, upper long")


def _exact(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows with their exact score as both bounds."""
    query = vectors.select(F.col("id").alias("query"), F.col("vector").alias("_q"))
    score = F.aggregate(F.zip_with("_q", "vector", lambda a, b: a * b), F.lit(0).cast("long"),
                        lambda s, x: s + x)
    return (rows.join(query, "query").join(vectors, "id")
            .select("query", "id", score.alias("lower"), score.alias("upper")))


def _best(rows: DataFrame, k: int, column: str, tie: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(column), tie)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)


def _certain(found: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact scores of the first k candidates of each query."""
    least = (_best(found, k, "lower", "id").groupBy("query").agg(F.min("lower").alias("_least")))
    found = settle(found.join(least, "query").filter("upper >= _least").drop("_least"), "reached")
    known, open_rows = found.filter("lower = upper"), found.filter("lower < upper")
    if open_rows.isEmpty():
        return _best(known, k, "upper", "id").drop("_n")
    # The first by upper bound are read, then all that can still reach the kth score.
    first = settle(_best(found, 2 * k, "upper", "id").filter("lower < upper").drop("_n"), "first")
    known = settle(known.unionByName(_exact(first, vectors)), "known")
    least = _best(known, k, "upper", "id").groupBy("query").agg(
        F.min("upper").alias("_least"), F.count(F.lit(1)).alias("_known"))
    rest = (open_rows.join(first.select("query", "id"), ["query", "id"], "left_anti")
            .join(least, "query", "left")
            .filter((F.coalesce("_known", F.lit(0)) < k) | (F.col("upper") >= F.col("_least"))))
    return _best(known.unionByName(_exact(rest.select(*found.columns), vectors)), k, "upper",
                 "id").drop("_n")


def nearest(rows: DataFrame, queries: Column, k: int, vec_id: str = "vec_id",
            vector: str = "vector", cells: int = CELLS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k best other rows.

    ``vector``: an array of long, null for rows that take no part. ``queries``: a
    condition on ``vec_id``.
    """
    if not 1 <= cells <= 256:
        raise ValueError("a cell number is one byte")
    key = F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary"))
    rows = settle(rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
                  .filter("vec_id IS NOT NULL AND vector IS NOT NULL")
                  .withColumn("is_query", queries).withColumn("key", key), "vectors")
    classes = settle(rows.groupBy("key").agg(
        F.min("vec_id").alias("id"), F.first("vector").alias("vector"),
        F.max("is_query").alias("is_query")), "vector-classes")
    # Up to k + 1 ids of a class: more can never be among a query's first k others.
    order = Window.partitionBy("key").orderBy("vec_id")
    ids = settle(rows.select("key", "vec_id")
                 .withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= k + 1)
                 .groupBy("key").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
                 .select(F.col("ids")[0].alias("id"), "ids"), "class-ids")
    edges = _edges(classes, cells)
    blocks = settle(_packed(classes, BLOCK), "vector-blocks")
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    approximations = _approximated(blocks, edges, groups)
    asked = settle(_packed(classes.filter("is_query"), QUERY_BLOCK), "query-blocks")
    found = settle(_scanned(asked, approximations, edges, groups, k + 1), "survivors")
    vectors = classes.select("id", "vector")
    best = settle(_certain(found, vectors, k + 1), "best-classes")
    entries = _best(best.join(ids, "id").select(
        "query", F.col("upper").alias("score"), F.explode("ids").alias("vec_id")),
        k + 1, "score", "vec_id")
    answers = settle(entries.groupBy("query").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("entries"))
        .join(classes.select(F.col("id").alias("query"), "key"), "query")
        .select("key", "entries"), "answers")
    asking = rows.filter("is_query").select("key", F.col("vec_id").alias("query_id"))
    others = F.slice(F.filter("entries", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return (asking.join(answers, "key")
            .select("query_id", F.posexplode(others).alias("_n", "e"))
            .select("query_id", (F.col("_n") + 1).cast("int").alias("rank"),
                    F.col("e.vec_id").alias("vec_id"), (-F.col("e.minus")).alias("score")))
