"""Near-duplicate documents: one-permutation hashing, banded buckets, stars, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .runtime import cut, prepare
from .stars import in_shared_buckets
from .textblocks import Block, blocks, combine, mix

SHINGLE = 5
#: Links: intersections of at least this many hundredths of the union.
PERCENT = 75
BINS, BANDS = 128, 32
#: Members compared at once, with twice as many others.
CHUNK = 256
_ROWS = BINS // BANDS
_RNG = np.random.default_rng(20170611)
#: For each empty bin, bins to borrow from, tried in this order (optimal densification).
_DONORS = _RNG.integers(0, BINS, (BINS, 4096))
_WEIGHTS = _RNG.integers(1, 2**63, (BINS,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(1, 2**63, (BANDS,), dtype=np.uint64)


def shingle_sets(block: Block) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of 5 words, or of all words where there are fewer."""
    words = block.words(fold=True)
    runs = combine(words.hash, SHINGLE)
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = last - first
        if n >= SHINGLE:
            found = np.sort(runs[first : last - SHINGLE + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        else:
            yield combine(words.hash[first:last], n) ^ np.uint64(n) if n else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash in each bin; an empty bin takes that of the first filled one in its own random order."""
    at = (shingles >> np.uint64(57)).astype(np.int64)
    new = np.concatenate([[True], at[1:] != at[:-1]])
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[at[new]], filled[at[new]] = shingles[new], True
    empty = np.flatnonzero(~filled)
    start, width = 0, 16
    while empty.size:
        if start >= _DONORS.shape[1]:
            out[empty] = shingles[0]
            break
        tried = filled[_DONORS[empty, start : start + width]]
        done = tried.any(axis=1)
        out[empty[done]] = out[_DONORS[empty[done], start + tried[done].argmax(axis=1)]]
        empty, start, width = empty[~done], start + width, min(2 * width, 512)
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One bucket key for each band of bins."""
    return mix((mix(signature(shingles)) * _WEIGHTS).reshape(BANDS, _ROWS).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def _sketch(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, block in blocks(batch.column(1)):
                size, mark, bands = [], [], []
                for found in shingle_sets(block):
                    size.append(len(found))
                    mark.append(_mark(found) if len(found) else None)
                    bands.append(band_keys(found) if len(found) else np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                columns = [batch.column(0).slice(start, stop - start), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), keys]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "mark", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, mark binary, bands array<long>")


def _mark(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                found = list(shingle_sets(block))
                columns = [pa.array([_mark(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["mark", "shingles"])

    return docs.select("text").mapInArrow(run, "mark binary, shingles binary")


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ..) with both sets, x of a and y of b; a skewed a is split by the join."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a")


def _numbers(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(v.as_buffer(), np.uint64) for v in column)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(_numbers(batch.column(2)), _numbers(batch.column(3)), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _both(pairs.select("a", "b"), sets).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with b's size ``n`` and ``diff``: the shingles that b adds to a's, and the complements of those it lacks."""
    names = pairs.columns
    rows, kept = _both(pairs, sets).select(*names, "x", "y"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, diff = [], []
            for x, y in zip(_numbers(batch.column(kept)), _numbers(batch.column(kept + 1)), strict=True):
                more, less = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                n.append(len(y))
                diff.append(np.concatenate([more, ~less]).tobytes())
            columns = [*batch.columns[:kept], pa.array(n, pa.int64()), pa.array(diff, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n", "diff"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return rows.mapInArrow(run, f"{kinds}, n long, diff binary")


def _far_from_centre(star: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of a centre that the star left in different components.

    Members not in the centre's component are compared with all others of the centre, in chunks
    of both. As all are near one centre, they are compared by how they differ from it: |x ^ y| is
    |d| + |e| - 2 |d & e| for the differences d and e, and the shared part of many differences is
    one product of matrices. Of each member's links to a component, one is given out.
    """
    parts = found.select(F.col("node").alias("b"), F.col("component").alias("part"))
    mine = found.select(F.col("node").alias("a"), F.col("component").alias("centre"))
    placed = star.join(parts, "b", "left").join(mine, "a", "left")
    placed = placed.select("a", "b", F.coalesce("part", "b").alias("part"), (F.coalesce("part", "b") != F.coalesce("centre", "a")).alias("far"))
    placed = cut(placed)
    counts = placed.groupBy("a").agg(F.count("*").alias("near"), F.count_if("far").alias("apart")).where("apart > 0 and near > 1")
    chunks = [F.ceil(F.col("apart") / CHUNK).cast("int").alias("i"), F.ceil(F.col("near") / (2 * CHUNK)).cast("int").alias("j")]
    open_ = placed.join(counts.select("a", *chunks), "a")
    rows = cut(_differences(open_, sets))
    at = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    far = rows.where("far").withColumns({"asks": F.lit(True), "ci": at("i"), "cj": F.explode(F.sequence(F.lit(0), F.col("j") - 1))})
    all_ = rows.withColumns({"asks": F.lit(False), "cj": at("j"), "ci": F.explode(F.sequence(F.lit(0), F.col("i") - 1))})
    dealt = far.unionByName(all_).select("a", "ci", "cj", "asks", "b", "part", "n", "diff")
    dealt = dealt.repartition("a", "ci", "cj").sortWithinPartitions("a", "ci", "cj")
    return dealt.mapInArrow(_compare_chunks, "a long, b long")


def _compare_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each (centre, chunk, chunk), whose rows come together."""
    held: list[pa.RecordBatch] = []

    def groups() -> Iterator[pa.Table]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if held and any(held[-1].column(k)[-1].as_py() != int(key[k, 0]) for k in range(3)):
                yield pa.Table.from_batches(held)
                held.clear()
            start = 0
            for end in [*ends.tolist(), batch.num_rows]:
                held.append(batch.slice(start, end - start))
                if end < batch.num_rows:
                    yield pa.Table.from_batches(held)
                    held.clear()
                start = end
        if held:
            yield pa.Table.from_batches(held)

    for group in groups():
        if found := _chunk_links(group.combine_chunks()):
            pairs = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _chunk_links(group: pa.Table) -> list[tuple[int, int]]:
    asks = group.column(3).to_numpy(zero_copy_only=False)
    if not asks.any() or asks.all():
        return []
    ids, part, n = (group.column(k).to_numpy() for k in (4, 5, 6))
    diffs = list(_numbers(group.column(7).combine_chunks()))
    size = np.array([len(d) for d in diffs])
    flat, row = np.concatenate(diffs), np.repeat(np.arange(len(diffs)), size)
    names, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    used = np.unique(col[shared])
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    overlap = np.zeros((len(x), len(y)), np.float32)
    place = np.cumsum(asks) - 1
    other = np.cumsum(~asks) - 1
    for at in range(0, len(used), 4096):
        some = used[at : at + 4096]
        mine = shared & (col >= some[0]) & (col <= some[-1])
        r, c = row[mine], np.searchsorted(some, col[mine])
        left, right = np.zeros((len(x), len(some)), np.float32), np.zeros((len(y), len(some)), np.float32)
        q = asks[r]
        left[place[r[q]], c[q]] = 1
        right[other[r[~q]], c[~q]] = 1
        overlap += left @ right.T
    apart = size[x][:, None] + size[y][None, :] - 2 * overlap
    total = n[x][:, None] + n[y][None, :]
    # intersection and union are (total - apart) / 2 and (total + apart) / 2.
    link = (100 * (total - apart) >= PERCENT * (total + apart)) & (part[x][:, None] != part[y][None, :])
    i, j = np.nonzero(link)
    _, first = np.unique(np.stack([i, part[y[j]]]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
    return list(zip(ids[x[i[first]]].tolist(), ids[y[j[first]]].tolist(), strict=True))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    A document's set holds its distinct 5-word shingles (A-Z in lower case; words are runs
    outside space and 09-0D); documents link where 100 * intersection >= 75 * union, and a
    component's id is its smallest doc_id, which is kept. Candidates share a band of a
    one-permutation signature with optimal densification (32 bands of 4 bins: a pair at 0.75 is
    missed with a chance of 5e-6); all links are confirmed on full sets, whose shingles are
    64-bit hashes (two of a pair's n shingles collide with a chance of n ** 2 / 2 ** 65).

    Pairs stay bounded: equal sets count as one from the start, and each bucket's members are
    paired with one centre, the member that shares most buckets with others. Members that this
    leaves outside their centre's component are then compared with all its members, in chunks
    (see ``_far_from_centre``), so that no candidate pair across components goes untested.

    Defined cases: null or wordless texts have an empty set and link with nothing; a null id
    links with nothing, has a null component and is kept; repeated rows each get a row; rows that
    share an id are one document in links, which any of their texts may give, and each has its
    own text's ``n_shingles``; an empty table gives an empty result; long texts count whole;
    other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = cut(_sketch(rows))
    known = sketch.where("n > 0 and doc_id is not null")
    # A node is a set; numbers are given once, as the checkpoint keeps them.
    nodes = known.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    members = in_shared_buckets(nodes.select(F.col("node").alias("id"), "n", F.explode("bands").alias("key")))
    wanted = nodes.join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "mark", "doc_id")
    texts = rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = cut(_sets(texts).join(wanted.select("mark", "node"), "mark").dropDuplicates(["node"]).select("node", "shingles"))
    busy = members.groupBy("id").agg(F.sum("size").alias("busy"))
    lead = members.join(busy, "id").groupBy("key").agg(F.max(F.struct("busy", "id")).getField("id").alias("a"))
    star = members.join(lead, "key").where("id != a").select("a", F.col("id").alias("b")).distinct()
    star = cut(star)
    links = cut(_confirm(star, sets))
    so_far = components(links)
    more = cut(_far_from_centre(star, so_far, sets))
    # Sets of one document are tied as well.
    of_document = known.join(nodes.select("mark", "node"), "mark").select("doc_id", "mark", "node")
    twins = of_document.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last")
    twins = cut(of_document.join(twins, "doc_id").where("node > a").select("a", F.col("node").alias("b")).distinct())
    more = more.unionByName(twins)
    if more.head(1):
        so_far = components(so_far.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    named = nodes.select("mark", "node", "doc_id").join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("mark", "component_id")
    out = sketch.select("doc_id", "n", "mark").join(named, "mark", "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
