"""Embedding near-dedup: spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .runtime import cut, prepare

#: Links: cosine at least this.
COSINE = 0.95
#: A filter direction is one code word in each block of dimensions: words ** BLOCKS directions. There
#: are at least WORDS words a block, and as many directions as vectors, so that filters stay small.
BLOCKS, WORDS, MOST_WORDS = 4, 16, 215
#: Expected number of filters of a random vector: the first of these that finds RECALL of pairs at the threshold.
FILTERS, RECALL = (24, 32, 48, 64, 96, 128), 0.98
#: Members that one group of neighbouring filters has on average; a vector goes to each of its groups once.
GROUP = 1024
#: Members of a group that are compared in one task; larger groups are compared chunk by chunk.
CHUNK = 2048
#: Crowded groups of which the list is broadcast; more of them meet the members in a shuffle.
LISTED = 50_000


def codes(dim: int, words: int = WORDS) -> list[np.ndarray]:
    """Unit code words of each block, from a fixed seed."""
    rng = np.random.default_rng(20160109)
    found = [rng.standard_normal((words, len(part))) for part in np.array_split(np.arange(dim), BLOCKS)]
    return [x / np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(BLOCKS) for x in found]


def cap_height(dim: int, words: int = WORDS, filters: int = FILTERS[0]) -> float:
    """Inner product that a random unit vector has with about ``filters`` of all directions, or more."""
    rng = np.random.default_rng(7)
    probe = rng.standard_normal((200, dim))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    left, right = (x[:, rng.permutation(x.shape[1])[:512]] for x in _half_sums(probe, codes(dim, words)))
    return float(np.quantile((left[:, :, None] + right[:, None, :]).reshape(-1), 1 - filters / words**BLOCKS))


def probes(dim: int, n: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of random unit vectors with a cosine of COSINE."""
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    return a, COSINE * a + np.sqrt(1 - COSINE**2) * b / np.linalg.norm(b, axis=1, keepdims=True)


def recall_of(dim: int, words: int, filters: int) -> float:
    """Share of the probes that share a filter."""
    height = cap_height(dim, words, filters)
    x, y = (filters_of(v, codes(dim, words), height, filters) for v in probes(dim))
    return float(np.mean([bool(set(p) & set(q)) for p, q in zip(x, y, strict=True)]))


def settings(dim: int, vectors: int) -> tuple[int, int]:
    """Words a block and filters a vector for so many vectors."""
    words = min(max(WORDS, int(np.ceil(vectors ** (1 / BLOCKS)))), MOST_WORDS)
    return words, next((f for f in FILTERS if recall_of(dim, words, f) >= RECALL), FILTERS[-1])


def _half_sums(unit: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """Inner products with all code words of the first and of the second half of the blocks."""
    parts = np.split(unit, np.cumsum([w.shape[1] for w in words])[:-1], axis=1)
    s = [p @ w.T for p, w in zip(parts, words, strict=True)]
    return [(s[i][:, :, None] + s[i + 1][:, None, :]).reshape(len(unit), -1) for i in (0, 2)]


def filters_of(unit: np.ndarray, words: list[np.ndarray], height: float, filters: int = FILTERS[0]) -> list[np.ndarray]:
    """List decoding: of each vector, all filters whose direction it exceeds ``height`` with.

    The sums of both halves are sorted, so only the exceeding pairs are listed. A vector with
    fewer than a third of ``filters`` of them lowers its own height until it has as many.
    """
    left, right = _half_sums(unit, words)
    order_l, order_r = np.argsort(-left, axis=1), np.argsort(-right, axis=1)
    found = []
    for i in range(len(unit)):
        a, b, low = left[i, order_l[i]], right[i, order_r[i]], height
        while True:
            n = np.searchsorted(-b, -(low - a), side="right")
            if n.sum() >= filters // 3 or n.sum() == a.size * b.size:
                break
            low -= 0.02
        rows = np.repeat(np.arange(len(a)), n)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        found.append(np.sort(order_l[i][rows] * right.shape[1] + order_r[i][cols]).astype(np.int32))
    return found


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packed(x: np.ndarray) -> list[bytes]:
    """Bytes of each row, in single precision where that keeps the numbers."""
    short = x.astype(np.float32)
    same = (short == x).all(axis=1)
    return [(short if s else x)[i].tobytes() for i, s in enumerate(same)]


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in column.to_pylist()])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if kept and any(kept[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys)):
            yield pa.Table.from_batches(kept)
            kept.clear()
        start = 0
        for end in [*ends.tolist(), batch.num_rows]:
            kept.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept.clear()
            start = end
    if kept:
        yield pa.Table.from_batches(kept)


def _group_links(group: pa.Table, dim: int, span: int) -> np.ndarray | None:
    """Links within a group (g, chunk i, chunk j), of vectors that share one of its filters.

    Each pair counts in the group of the first filter that it shares, so once. For each vector
    with a link: the summed sizes of its newly counted partners, and the least id it reaches here.
    """
    g, i, j = (group.column(k)[0].as_py() for k in range(3))
    mine, ids, sizes = (group.column(k).to_numpy() for k in (3, 4, 5))
    unit = _unit(_unpacked(group.column(6).combine_chunks(), dim))
    lists = group.column(7).combine_chunks()
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    here = np.flatnonzero(flat // span == g)
    here = here[np.argsort(flat[here], kind="stable")]
    near = np.zeros((len(ids), len(ids)), bool)
    for of_filter in np.split(row[here], np.flatnonzero(np.diff(flat[here])) + 1):
        if len(of_filter) > 1:
            near[np.ix_(of_filter, of_filter)] |= unit[of_filter] @ unit[of_filter].T >= COSINE
    np.fill_diagonal(near, False)
    if i != j:
        near &= mine[:, None] != mine[None, :]
    touched = np.flatnonzero(near.any(axis=1))
    if not len(touched):
        return None
    near, ids, sizes = near[np.ix_(touched, touched)], ids[touched], sizes[touched]
    place = np.full(len(mine), -1)
    place[touched] = np.arange(len(touched))
    before = np.flatnonzero((flat // span < g) & (place[row] >= 0))
    names, col, times = np.unique(flat[before], return_inverse=True, return_counts=True)
    before, col = before[times[col] > 1], col[times[col] > 1]
    counted = np.zeros(near.shape, bool)
    for at in range(0, len(names), 4096):
        some = (col >= at) & (col < at + 4096)
        member = np.zeros((len(touched), min(4096, len(names) - at)), np.float32)
        member[place[row[before[some]]], col[some] - at] = 1
        counted |= member @ member.T > 0
    label = np.arange(len(ids), dtype=np.int32)
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], np.int32(len(ids))).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return np.stack([ids, least[label], (near & ~counted) @ sizes])


def near_vectors(
    vectors: DataFrame, dim: int, *, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors link at a cosine of COSINE or more, computed in double precision; ``n_links`` counts
    the other vectors that link directly, ``component_id`` is the smallest id reachable. Equal
    vectors are compared once, whatever their number. Candidates share a filter: a pair at the
    threshold, in random directions, shares one with a chance of RECALL or more, nearer ones with
    a higher one; ``settings`` chooses how many directions there are, as many as vectors, and how
    many each vector exceeds. A vector is sent once to each group of neighbouring filters that it
    has one in. Groups with many members are compared chunk by chunk, so no task holds more than two chunks.

    Defined cases: vectors that are null, zero, of another length than ``dim``, or hold null or
    non-finite components link with nothing; a null id likewise, with a null component, and is
    kept; rows that repeat an id and vector count as vectors of their own in ``n_links``; rows that
    share an id with unlike vectors have their own vectors' links; an empty table gives an empty
    result; other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.expr(f"vec_id is not null and size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x != 0)")
    # Adding 0.0 turns -0.0 into 0.0, so that equal vectors are equal keys.
    rows = rows.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))))
    # A node is a vector; numbers are given once, as the checkpoint keeps them.
    classes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    n = classes.count()
    words, filters = settings(dim, n)
    span = 1
    while 2 * span <= words**2 and n * filters * span < GROUP * words**BLOCKS:
        span *= 2
    shared = spark.sparkContext.broadcast((codes(dim, words), cap_height(dim, words, filters)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, height = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                x = _matrix(some.column(2))
                lists = filters_of(_unit(x), directions, height, filters)
                groups = [np.unique(f // span) for f in lists]
                columns = [*some.columns[:2], pa.array(_packed(x), pa.binary()), _lists(lists, pa.int32()), _lists(groups, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "v", "filters", "groups"])

    decoded = cut(classes.select("id", "size", "v").mapInArrow(decode, "id long, size long, v binary, filters array<int>, groups array<int>"))
    members = decoded.select(F.explode("groups").alias("g"), "id", "size", "v", "filters")
    crowded = members.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    crowded = cut(crowded.select("g", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    columns = ["g", "i", "j", "mine", "id", "size", "v", "filters"]
    zero = F.lit(0)
    n_crowded = crowded.count()
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= LISTED else crowded
        dealt = members.join(crowded, "g", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("chunks") - 1)))
        dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).select(*columns)
    else:
        dealt = members.withColumns({"i": zero, "j": zero, "mine": zero}).select(*columns)
    dealt = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            found = _group_links(group.combine_chunks(), dim, span) if group.num_rows > 1 else None
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "n"])

    found = cut(dealt.mapInArrow(compare, "a long, b long, n long"))
    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    parts = components(found.select("a", "b")).withColumnRenamed("node", "id")
    known = classes.join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("v", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(known, "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
