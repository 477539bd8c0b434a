"""Substring dedup: repeated word windows found through super-k-mers dealt by their minimiser."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, prepare
from .textblocks import Words, blocks, combine, slice_hashes

#: Words of a window, and of the runs whose least hash is its minimiser.
WINDOW, RUN = 20, 4
#: A minimiser with more than this share of all super-k-mers is split by its windows' own hashes.
HOT_SHARE = 1 / 2000
#: Distinct windows that a task remembers of one bucket; those beyond meet by their own hashes.
SEEN = 1_000_000
#: Rounds in which the minimisers are dealt, each with this share of the strings on disk.
ROUNDS = 2
_PLACE = ["doc_id", "key", "place"]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


class SuperKmers:
    """Longest runs of windows of one text that share a minimiser, and their packed words."""

    def __init__(self, words: Words, window: int = WINDOW):
        n = len(words.hash)
        counts = np.diff(words.first)
        ends = np.repeat(words.first[1:], counts)
        at = np.flatnonzero(np.arange(n) + window <= ends)
        minimiser = _least(combine(words.hash, RUN), window - RUN + 1)[at] if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (minimiser[1:] != minimiser[:-1])
        start = np.flatnonzero(new)
        self.minimiser = minimiser[start].view(np.int64)
        #: First word and one after the last, in the block, and the text.
        self.first = at[start]
        self.last = at[np.append(start[1:], len(at))[: len(start)] - 1] + window if len(start) else at[:0]
        self.text = np.searchsorted(words.first, self.first, side="right") - 1
        #: Place of the first word in its text.
        self.place = self.first - words.first[self.text]
        self._words = words

    def pack(self, keep: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Words of the chosen ones joined by one space; all bytes, and where each one's begin and end."""
        w = self._words
        size = w.end - w.start + 1
        begin = np.concatenate([[0], np.cumsum(size)])
        data = np.full(begin[-1], 32, np.uint8)
        at = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        inside = at < np.repeat(size - 1, size)
        data[inside] = w.data[(np.repeat(w.start, size) + at)[inside]]
        s, e = begin[self.first[keep]], begin[self.last[keep]] - 1
        raw = data.tobytes()
        return [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)], data, s, e


def _each(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, SuperKmers]]:
    for batch in batches:
        for start, stop, block in blocks(batch.column(text)):
            yield batch.slice(start, stop - start), SuperKmers(block.words())


def hot_minimisers(rows: DataFrame) -> list[int]:
    """Minimisers of more than about HOT_SHARE of all super-k-mers, counted over all rows.

    A task names those with that share of its own, at most 1 / HOT_SHARE; a minimiser with the
    share overall has it in some task. At most 2 / HOT_SHARE are returned.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [k.minimiser for _, k in _each(batches, 0)]
        value, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        often = n >= max(HOT_SHARE * n.sum(), 2)
        yield pa.RecordBatch.from_arrays([pa.array(value[often]), pa.array(n[often]), pa.array(np.full(often.sum(), False))], ["m", "n", "all"])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([int(n.sum())]), pa.array([True])], ["m", "n", "all"])

    counts = cut(rows.select("text").mapInArrow(count, "m long, n long, all boolean"))
    total = counts.where("all").agg(F.sum("n")).first()[0] or 0
    often = counts.where("not all").groupBy("m").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_SHARE * total / 2, 2))
    return [r.m for r in often.orderBy(F.desc("n"), "m").limit(int(2 / HOT_SHARE)).collect()]


def super_kmers(rows: DataFrame, chosen: list[int], number: int | None) -> DataFrame:
    """Super-k-mers whose minimiser is among ``chosen``, or with a round's ``number`` that round's others.

    ``bucket`` is half of the minimiser: buckets may share it, which costs nothing, as windows are
    told apart by their own hashes. The chosen ones' equal strings share ``mark`` and ``mark2``.
    """
    shared = rows.sparkSession.sparkContext.broadcast(np.sort(np.array(chosen, np.int64)))
    hot = number is None
    names = ["bucket", *_PLACE, "packed", *["windows", "mark", "mark2"] * hot]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        for batch, kmers in _each(batches, 2):
            mine = np.isin(kmers.minimiser, listed)
            keep = np.flatnonzero(mine if hot else ~mine & (kmers.minimiser % ROUNDS == number))
            for at in range(0, len(keep), 20_000):
                some = keep[at : at + 20_000]
                packed, data, s, e = kmers.pack(some)
                text = pa.array(kmers.text[some])
                columns = [
                    pa.array((kmers.minimiser[some] >> 32).astype(np.int32)), batch.column(0).take(text), batch.column(1).take(text),
                    pa.array(kmers.place[some]), pa.array(packed, pa.binary()),
                ]
                if hot:
                    columns.append(pa.array(kmers.last[some] - kmers.first[some] - WINDOW + 1))
                    columns += [pa.array(slice_hashes(data, s, e, seed).view(np.int64)) for seed in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", windows long, mark long, mark2 long" * hot
    return rows.mapInArrow(run, "bucket int, doc_id long, key long, place long, packed binary" + extra)


def _windows(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number within its row, and two independent hashes of each window of packed strings."""
    words = next(blocks(packed.cast(pa.large_binary()).view(pa.large_string()), 1 << 62))[2].words()
    n = np.diff(words.first) - WINDOW + 1
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = words.first[row] + number
    hashes = (combine(words.hash, WINDOW)[at], combine(words.hashes(1), WINDOW, 1)[at])
    return row, number, *(h.view(np.int64) for h in hashes)


def _firsts(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal (h, g), the first's index; and each one's number among those."""
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    if (g[first[inverse]] == g).all():
        return first, inverse
    _, first, inverse = np.unique(np.stack([h, g]), axis=1, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def _runs(doc: np.ndarray, key: np.ndarray, row: np.ndarray, place: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive repeated windows of a row, as first and last window."""
    on = np.flatnonzero(again)
    new = np.ones(len(on), bool)
    new[1:] = (row[on[1:]] != row[on[:-1]]) | (place[on[1:]] != place[on[:-1]] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(on))[: len(start)] - 1
    arrays = [doc[row[on[start]]], key[row[on[start]]], place[on[start]], place[on[end]]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["doc_id", "key", "low", "high"])


_RUNS = "doc_id long, key long, low long, high long"


def _repeats_in_buckets(kmers: DataFrame) -> DataFrame:
    """Repeated windows within each minimiser's bucket, which is sorted by document and place.

    Of the bucket under way, the first SEEN distinct windows are remembered with their first
    places; strings are not. Windows beyond those that equal none of them are ``open``: they come
    out one by one with their hashes ``h`` and ``g``, in place of ``high``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, none = None, [np.zeros(0, np.int64)] * 5
        seen = none
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, doc, key, place = (batch.column(i).to_numpy() for i in range(4))
            row, number, h, g = _windows(batch.column(4))
            at = place[row] + number
            if bucket[0] != last:
                seen = none
            old = len(seen[0])
            every = [np.concatenate([x, y]) for x, y in zip(seen, (h, g, doc[row], key[row], at), strict=True)]
            first, inverse = _firsts(every[0], every[1])
            mine = first[inverse[old:]]
            again = (every[2][mine] != every[2][old:]) | (every[3][mine] != every[3][old:]) | (every[4][mine] != at)
            full = old >= SEEN
            beyond = (mine >= old) & (bucket[row] == last) if full else np.zeros(len(row), bool)
            runs = _runs(doc, key, row, at, again & ~beyond)
            some = np.flatnonzero(beyond)
            nothing = pa.nulls(runs.num_rows, pa.int64())
            names = ["doc_id", "key", "low", "high", "h", "g"]
            yield pa.RecordBatch.from_arrays([*runs.columns, nothing, nothing], names)
            if len(some):
                columns = [doc[row[some]], key[row[some]], at[some]]
                columns = [*map(pa.array, columns), pa.nulls(len(some), pa.int64()), pa.array(h[some]), pa.array(g[some])]
                yield pa.RecordBatch.from_arrays(columns, names)
            if full and bucket[-1] == last:
                continue
            fresh = first[first >= old]
            fresh = fresh[bucket[row[fresh - old]] == bucket[-1]]
            if bucket[-1] == last:
                fresh = np.concatenate([np.arange(old), fresh])
            last, seen = bucket[-1], [x[fresh] for x in every]

    dealt = kmers.select("bucket", *_PLACE, "packed").repartition("bucket")
    return dealt.sortWithinPartitions("bucket", *_PLACE).mapInArrow(run, _RUNS + ", h long, g long")


def _again(windows: DataFrame) -> DataFrame:
    """Runs of one window each, of ``windows`` (doc_id, key, place, h, g) that are not the first of their hashes."""
    firsts = windows.groupBy("h", "g").agg(F.min(F.struct(*_PLACE)).alias("f"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(firsts, ["h", "g"]).where(F.struct(*_PLACE) != F.col("f"))
    return later.select("doc_id", "key", F.col("place").alias("low"), F.col("place").alias("high"))


def _repeats_of_hot(kmers: DataFrame) -> DataFrame:
    """The same for minimisers with very many super-k-mers: equal strings are counted once, before
    the shuffle; their distinct windows then meet by their own hashes, where the first place names
    the string that owns the window. At a string's first place its own windows are new; all else is repeated."""
    strings = kmers.groupBy("mark", "mark2", "packed").agg(F.min(F.struct(*_PLACE)).alias("f"))
    strings = cut(strings.select("mark", "mark2", "packed", "f.*"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, number, h, g = _windows(batch.column(2))
                # In each string, the first of equal windows: rows and numbers ascend.
                order = np.lexsort((g, h, row))
                new = np.ones(len(order), bool)
                new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (row, h, g)], axis=0)
                first = order[new]
                row, number = row[first], number[first]
                mark, mark2, doc, key, place = (batch.column(i).to_numpy()[row] for i in (0, 1, 3, 4, 5))
                columns = [mark, mark2, number, h[first], g[first], doc, key, place + number]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mark", "mark2", "number", "h", "g", *_PLACE])

    windows = strings.mapInArrow(split, "mark long, mark2 long, number long, h long, g long, doc_id long, key long, place long")
    owners = windows.groupBy("h", "g").agg(F.min(F.struct(*_PLACE, "mark", "mark2", "number")).alias("o")).select("o.*")
    owned = owners.groupBy("mark", "mark2").agg(F.collect_list("number").alias("owned"))
    first = F.struct(*_PLACE).alias("f")
    known = cut(strings.select("mark", "mark2", first).join(owned, ["mark", "mark2"], "left"))

    def mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, place, windows = (batch.column(i).to_numpy() for i in range(4))
            later = np.any([batch.column(4).field(i).to_numpy() != x for i, x in enumerate((doc, key, place))], axis=0)
            begin = np.cumsum(windows) - windows
            row = np.repeat(np.arange(len(doc)), windows)
            at = place[row] + np.arange(len(row)) - begin[row]
            again = np.ones(len(row), bool)
            n_owned = pc.fill_null(pc.list_value_length(batch.column(5)), 0).to_numpy()
            owner = np.repeat(np.arange(len(doc)), n_owned)
            again[begin[owner] + batch.column(5).flatten().to_numpy()] = later[owner]
            yield _runs(doc, key, row, at, again)

    marked = kmers.select(*_PLACE, "windows", "mark", "mark2").join(known, ["mark", "mark2"]).select(*_PLACE, "windows", "f", "owned")
    return marked.mapInArrow(mark_runs, _RUNS)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``key`` (of rows that share an id, equal for equal texts) and ``text``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of repeated windows: ``doc_id``, ``key``, first window ``low`` and last ``high`` (word numbers from 0).

    A window, 20 consecutive words, is repeated if its words also start earlier: in a document
    with a smaller id, or earlier in the same one. ``key`` is the hash of the document's text,
    which tells apart and orders documents of one id. Runs may touch or overlap. Windows are the
    same if two independent 64-bit hashes of their words are: any two of 1e13 windows collide
    with a chance of 2e-13.

    Minimisers are dealt in ROUNDS rounds, so the packed strings on disk stay below 2.5 times the
    texts; a task holds at most SEEN windows of a bucket.
    """
    prepare(docs.sparkSession)
    rows = _rows(docs, id_col, text_col).where("doc_id is not null")
    hot = hot_minimisers(rows)
    found = [cut(_repeats_in_buckets(super_kmers(rows, hot, number))) for number in range(ROUNDS)]
    cold = found[0]
    for more in found[1:]:
        cold = cold.unionByName(more)
    open_ = cold.where("h is not null").select("doc_id", "key", F.col("low").alias("place"), "h", "g")
    out = cold.where("h is null").select("doc_id", "key", "low", "high")
    if open_.head(1):
        out = out.unionByName(cut(_again(open_)))
    if hot:
        out = out.unionByName(cut(_repeats_of_hot(cut(super_kmers(rows, hot, None)))))
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by one space.

    Each word under a repeated window (see ``repeated_windows``) is removed; windows are judged
    on the input. Words are runs of characters outside space and 09-0D, unchanged.

    Defined cases: a null or empty text has no words and an empty ``kept_text``; a document with
    a null id is neither compared nor changed; rows that repeat an id and text are one document
    and get a row each; rows that share an id with unlike texts are documents of their own, in
    the order of their texts' hashes; texts under 20 words lose nothing; an empty table gives an
    empty result; very long texts count whole; other columns are ignored.
    """
    spans = repeated_windows(docs, id_col=id_col, text_col=text_col)
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    rows = _rows(docs, id_col, text_col).join(spans, ["doc_id", "key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, block in blocks(batch.column(1)):
                words = block.words()
                spans = batch.column(2).slice(start, stop - start)
                n = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
                both = spans.flatten()
                base, most = np.repeat(words.first[:-1], n), np.repeat(words.first[1:], n)
                step = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(step, np.minimum(base + both.field(0).to_numpy(), most), 1)
                np.add.at(step, np.minimum(base + both.field(1).to_numpy() + WINDOW, most), -1)
                gone = np.cumsum(step)[:-1] > 0
                yield _kept(batch.column(0).slice(start, stop - start), words, gone)

    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _kept(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.RecordBatch:
    counts = np.concatenate([[0], np.cumsum(gone)])[words.first]
    keep = np.flatnonzero(~gone)
    size = words.end[keep] - words.start[keep] + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.full(begin[-1], 32, np.uint8)
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    inside = at < np.repeat(size - 1, size)
    data[inside] = words.data[(np.repeat(words.start[keep], size) + at)[inside]]
    raw, bound = data.tobytes(), begin[np.searchsorted(keep, words.first)].tolist()
    texts = [raw[s:e].rstrip(b" ") if e > s else b"" for s, e in zip(bound[:-1], bound[1:], strict=True)]
    columns = [ids, pa.array(np.diff(words.first)), pa.array(np.diff(counts)), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])
