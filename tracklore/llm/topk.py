"""Exact top-k by inner product: three-phase uniform threshold over slices of the dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, prepare

#: Nodes: each holds the scores that one slice of the dimensions gives.
SLICES = 2
#: Vectors and queries of a block; a node scores one block of queries against one of vectors at a time.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Best entries of a query that a node gives first, k + 1 at least: the more, the nearer is the cutoff to the final one.
LISTED = 64
#: Parts of scores beyond this count as this, so that no sum of them leaves 64 bits.
_FAR = 2**61
_PAIR = ["query_id", "vec_id"]


def _slices(dim: int) -> list[tuple[int, int]]:
    at = np.linspace(0, dim, SLICES + 1).astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def _in_block(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _blocks(rows: DataFrame, dim: int, n: int, extra: list[str]) -> DataFrame:
    """(slice, block) -> ids and the slice's part of their vectors, of ``n`` blocks."""
    spans = F.array(*(F.struct(F.lit(k).alias("slice"), F.slice("v", s + 1, e - s).alias("part")) for k, (s, e) in enumerate(_slices(dim))))
    dealt = rows.withColumn("block", _in_block("id", n)).select("block", "id", *extra, F.explode(spans).alias("s"))
    return dealt.groupBy("s.slice", "block").agg(F.collect_list(F.struct("id", *extra, F.col("s.part").alias("part"))).alias("rows"))


def _tasks(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each block of queries beside each block of vectors of its slice."""
    targets = vectors.select("slice", "block").groupBy("slice").agg(F.max("block").alias("last"))
    asked = queries.join(targets, "slice").select(
        "slice", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), F.col("rows").alias("asked")
    )
    return asked.join(vectors, ["slice", "block"]).select("slice", "asked", "rows")


def _parts(column: pa.Array, row: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    rows = column[row].values
    names = [f.name for f in rows.type]
    fields = {name: rows.field(i) for i, name in enumerate(names)}
    part = fields.pop("part")
    return {k: v.to_numpy(zero_copy_only=False) for k, v in fields.items()}, part.flatten().to_numpy().reshape(len(rows), -1)


def _reach(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _limited(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -_FAR, _FAR).astype(np.int64)


def _products(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Exact integer products, up to _FAR: in doubles where sums stay below 2 ** 53, in 64-bit or else in unbounded integers."""
    most = _reach(asked) * _reach(held) * asked.shape[1]
    if most < 2**53:
        return (asked.astype(np.float64) @ held.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return _limited(asked @ held.T)
    return _limited(asked.astype(object) @ held.astype(object).T)


def _row_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for row i of x and row i of y."""
    if _reach(x) * _reach(y) * x.shape[1] < 2**63:
        return _limited((x * y).sum(axis=1))
    return _limited((x.astype(object) * y.astype(object)).sum(axis=1))


_ENTRY = "query_id long, vec_id long, slice long, part long"


def _local(choose, extra: list[str]) -> object:
    """A function over task rows that yields (query, vector, slice, part, extra) where ``choose`` says so, query chunk by chunk."""
    names = [*_PAIR, "slice", "part", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column(0)[row].as_py()
                (asked, q), (held, v) = _parts(batch.column(1), row), _parts(batch.column(2), row)
                for at in range(0, len(q), 128):
                    some = {k: x[at : at + 128] for k, x in asked.items()}
                    scores = _products(q[at : at + 128], v)
                    i, j = choose(scores, some, held["id"])
                    columns = [some["id"][i], held["id"][j], np.full(len(i), number), scores[i, j], *(some[x][i] for x in extra)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the pairs listed beside a block of queries and one of vectors."""
    for batch in batches:
        for row in range(batch.num_rows):
            (asked, q), (held, v) = _parts(batch.column(1), row), _parts(batch.column(2), row)
            pairs = batch.column(0)[row].values
            query, vector = (pairs.field(i).to_numpy() for i in range(2))
            at = []
            for ids, wanted in ((asked["id"], query), (held["id"], vector)):
                order = np.argsort(ids)
                at.append(order[np.searchsorted(ids, wanted, sorter=order)])
            part = [_row_products(q[at[0][k : k + 4096]], v[at[1][k : k + 4096]]) for k in range(0, len(query), 4096)]
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(vector), pa.array(np.concatenate(part))], [*_PAIR, "part"])


def _resolved(entries: DataFrame, asked: DataFrame, held: DataFrame, n_asked: int, n_held: int) -> DataFrame:
    """``query_id``, ``vec_id`` and exact ``score`` of pairs with a ``part``, the ``n`` slices it is of and one of them, ``have``.

    The other slice gives what it has not sent: pairs come to its blocks in lists, not the
    vectors to each pair. A list holds pairs of a quarter of a block of queries and a block of vectors.
    """
    lists = entries.where(F.col("n") < SLICES).select(
        "query_id", "vec_id", (1 - F.col("have")).cast("int").alias("slice"), _in_block("query_id", n_asked).alias("q"),
        _in_block("vec_id", n_held).alias("block"), F.pmod(F.hash("query_id"), F.lit(4)).alias("quarter"),
    )
    lists = lists.groupBy("slice", "q", "block", "quarter").agg(F.collect_list(F.struct(*_PAIR)).alias("pairs"))
    asked = asked.select("slice", F.col("block").alias("q"), F.col("rows").alias("asked"))
    tasks = lists.join(held, ["slice", "block"]).join(asked, ["slice", "q"]).select("pairs", "asked", "rows")
    rest = tasks.mapInArrow(_missing, "query_id long, vec_id long, part long")
    return entries.select(*_PAIR, "part").unionByName(rest).groupBy(*_PAIR).agg(F.sum("part").alias("score"))


def _first(rows: DataFrame, k: int, by: list[str], score: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int, dim: int, *, id_col: str = "vec_id", vector_col: str = "vector"
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` rows of highest integer inner product.

    Queries are the rows where ``is_query`` holds; candidates are all rows but the query's own;
    ties go to the smaller id. The three phases: every node (a slice of the dimensions) lists
    its LISTED best for each query, and their exact scores give a safe cutoff, as the k-th of some
    rows is never above the k-th of all; a row that reaches the cutoff reaches its share,
    cutoff / nodes, in some node, so nodes then send all such rows; those that both nodes sent
    have exact scores, whose k-th raises the cutoff, and rows whose upper bound (their part, and
    less than the share in the other node) stays below it go; the rest are scored exactly.
    Equal vectors count as one until the end, with their k + 1 smallest ids. Blocks of queries
    meet blocks of vectors, so memory is bounded by the block sizes.

    Defined cases: rows whose vector is null, of another length than ``dim`` or holds a null, or
    whose id is null, take no part; of rows that share an id, the one with the least vector
    counts; fewer candidates than k are all returned; a slice's part of a score counts up to
    2 ** 61 either way, so that scores fit 64 bits; an empty table or no query gives an empty
    result; other columns are ignored.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull()))
    if rows.groupBy("id").count().where("count > 1").head(1):
        rows = cut(rows.groupBy("id").agg(F.min(F.struct("v", "asks")).alias("r")).select("id", "r.*"))
    order = Window.partitionBy("v").orderBy("id")
    equals = cut(rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1).select("id", "v", "at"))
    classes = cut(equals.where("at = 1").select("id", "v"))
    asking = cut(rows.where("asks").join(classes.withColumnRenamed("id", "class"), "v").select("id", "class"))
    queries = cut(classes.join(asking.select(F.col("class").alias("id")).distinct(), "id", "left_semi"))

    n_held, n_asked = (max(1, -(-x.count() // size)) for x, size in ((classes, BLOCK), (queries, QUERY_BLOCK)))
    held, asked = cut(_blocks(classes, dim, n_held, [])), cut(_blocks(queries, dim, n_asked, []))
    listed = max(LISTED, k + 1)

    def best(scores: np.ndarray, asked: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = min(listed, scores.shape[1])
        top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        return np.repeat(np.arange(len(scores)), n), top.reshape(-1)

    local = _first(_tasks(asked, held).mapInArrow(_local(best, []), _ENTRY), listed, ["query_id", "slice"], "part")
    gathered = local.groupBy(*_PAIR).agg(F.sum("part").alias("part"), F.count("*").alias("n"), F.min("slice").alias("have"))
    # The own class may hold only the query itself, so the cutoff is the k-th of the others.
    others = _resolved(cut(gathered), asked, held, n_asked, n_held).where("query_id != vec_id")
    cutoffs = _first(others, k, ["query_id"], "score").groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).alias("cutoff")
    )
    limited = queries.join(cutoffs.withColumnRenamed("query_id", "id"), "id", "left")
    limited = limited.withColumn("cutoff", F.coalesce("cutoff", F.lit(-(2**62))))
    limited = cut(limited.select("id", "v", "cutoff", F.shiftright("cutoff", 1).alias("least")))

    def enough(scores: np.ndarray, asked: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((scores >= asked["least"][:, None]) | (asked["id"][:, None] == ids[None, :]))

    bounds = ["cutoff", "least"]
    sent = _tasks(_blocks(limited, dim, n_asked, bounds), held).mapInArrow(_local(enough, bounds), _ENTRY + ", cutoff long, least long")
    partial = sent.groupBy(*_PAIR).agg(
        F.sum("part").alias("part"), F.count("*").alias("n"), F.min("slice").alias("have"), *(F.max(x).alias(x) for x in bounds)
    )
    exact = F.when((F.col("n") == SLICES) & (F.col("query_id") != F.col("vec_id")), F.col("part"))
    each = Window.partitionBy("query_id")
    partial = partial.withColumn("at", F.row_number().over(each.orderBy(exact.desc_nulls_last(), "vec_id")))
    partial = partial.withColumn("cutoff", F.greatest("cutoff", F.max(F.when(F.col("at") == k, exact)).over(each)))
    open_ = (F.col("n") == SLICES) | (F.col("part") + F.col("least") - 1 >= F.col("cutoff"))
    partial = cut(partial.where(open_).select(*_PAIR, "part", "n", "have"))
    scored = _resolved(partial, asked, held, n_asked, n_held)
    ranked = _first(scored, k + 1, ["query_id"], "score").select(F.col("query_id").alias("class"), F.col("vec_id").alias("found"), "score")

    members = equals.join(classes.withColumnRenamed("id", "found"), "v").select("found", F.col("id").alias("vec_id"))
    pairs = asking.withColumnRenamed("id", "query_id").join(ranked, "class").join(members, "found")
    return _first(pairs.where("query_id != vec_id"), k, ["query_id"], "score").select("query_id", "rank", "vec_id", "score")
