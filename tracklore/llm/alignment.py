"""Two tokenizers' tokens of the same texts, aligned where they end, and how often ids end together.

The ends of a text's tokens are two ascending lists. The shorter drives an exponential and then
binary search into the longer (galloping), over all texts of a block at once; the common ends cut
both lists into groups, whose tokens are the differences of the common ends' ranks.

Of two tokens that end together the shorter one's bytes end the longer one's, so the id pairs that
can occur follow from the vocabularies: no more than their tokens have bytes (``pair_table``). The
counts of a whole corpus are that small, and fit every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteTable, byte_alphabet
from .pieces import PieceEncoder, sentencepiece_encoder, tokenizers_encoder
from .runtime import cut, prepare
from .textblocks import Block, blocks

#: Pairs in one row of counts.
_ROW = 50_000


def byte_level_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary of the tokenizers library."""
    from tokenizers import Tokenizer

    vocabulary, back = Tokenizer.from_file(path).get_vocab(), {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
    tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        tokens[i] = b"".join(back.get(c) or c.encode() for c in token)
    return tokens


def piece_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a SentencePiece vocabulary: U+2581 is a space, <0xHH> the byte HH."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]


def pair_table(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All id pairs (i, j), as i * len(b) + j in order, whose tokens can end together: one's bytes end the other's."""

    def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        for i, t in enumerate(tokens):
            if t:
                out.setdefault(t, []).append(i)
        return out

    at_a, at_b = by_bytes(a), by_bytes(b)
    keys = [i * len(b) + j for i, t in enumerate(a) for k in range(len(t)) for j in at_b.get(t[k:], ())]
    keys += [i * len(b) + j for j, t in enumerate(b) for k in range(1, len(t)) for i in at_a.get(t[k:], ())]
    return np.unique(np.array(keys, np.int64))


def gallop(short: np.ndarray, long: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Where each value of ``short`` is in ``long``, or -1; both ascend. The search doubles its steps from ``guess`` on, then halves."""
    if not len(long):
        return np.full(len(short), -1, np.int64)
    last = len(long) - 1
    low = np.clip(guess, 0, last)
    high = low.copy()
    for left, sign in ((np.flatnonzero(long[low] < short), 1), (np.flatnonzero(long[low] > short), -1)):
        step, near, far = 1, *((low, high) if sign > 0 else (high, low))
        while left.size:
            at = far[left]
            go = np.clip(at + sign * step, 0, last)
            near[left], far[left] = at, go
            more = (long[go] < short[left]) if sign > 0 else (long[go] > short[left])
            left = left[more & (go != (last if sign > 0 else 0))]
            step *= 2
    left = np.flatnonzero(high - low > 1)
    while left.size:
        mid = (low[left] + high[left]) >> 1
        under = long[mid] < short[left]
        low[left] = np.where(under, mid, low[left])
        high[left] = np.where(under, high[left], mid)
        left = left[high[left] - low[left] > 1]
    return np.where(long[high] == short, high, np.where(long[low] == short, low, -1))


class Aligner:
    """Encoders and token bytes of both vocabularies, and the id pairs that can end together."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(a_path)
        model.encode_special_tokens = True
        self.a, self.b = tokenizers_encoder(model), sentencepiece_encoder(b_path)
        a, b = byte_level_tokens(a_path), piece_tokens(b_path)
        self.a_bytes, self.b_bytes, self.n_b = ByteTable(a), ByteTable(b), len(b)
        self.pairs = pair_table(a, b)
        self.digits = ByteTable([b"%d," % i for i in range(max(len(a), len(b)))])

    @staticmethod
    def _ids(encoder: PieceEncoder, table: ByteTable, block: Block, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each text has, and whether their bytes are the text's."""
        ids, counts = encoder.ids(block)
        sound = table.size[ids] > 0
        data, at = table.join(np.where(sound, ids, np.argmax(table.size > 0)))
        ends, raw = at[np.concatenate([[0], np.cumsum(counts)])], data.tobytes()
        known = np.concatenate([[0], np.cumsum(~sound)])[np.concatenate([[0], np.cumsum(counts)])]
        same = [x == raw[s:e] for x, s, e in zip(whole, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return ids, counts, np.array(same, bool) & (np.diff(known) == 0)

    def align(self, block: Block) -> Aligned:
        """``block`` holds texts with a space before each."""
        raw, bounds = block.data.tobytes(), block.bounds
        whole = [raw[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        bare = Block(np.delete(block.data, bounds[:-1]), bounds - np.arange(len(bounds)))
        a, n_a, same_a = self._ids(self.a, self.a_bytes, block, whole)
        b, n_b, same_b = self._ids(self.b, self.b_bytes, bare, whole)
        ok = same_a & same_b & (np.diff(bounds) > 1)
        a, b = a[np.repeat(ok, n_a)].astype(np.int64), b[np.repeat(ok, n_b)].astype(np.int64)
        n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        # Both vocabularies give a text the same number of bytes, so ends count on from text to text.
        end_a, end_b = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        i, j = [], []
        for drives, (n, m), (x, y), (f, g), swap in ((n_a <= n_b, (n_a, n_b), (end_a, end_b), (first_a, first_b), False), (n_a > n_b, (n_b, n_a), (end_b, end_a), (first_b, first_a), True)):
            at = np.flatnonzero(np.repeat(drives, n))
            text = np.repeat(np.arange(len(n)), n)[at]
            guess = g[text] + (at - f[text]) * m[text] // np.maximum(n[text], 1)
            found = gallop(x[at], y, guess)
            at, found = at[found >= 0], found[found >= 0]
            i.append(found if swap else at)
            j.append(at if swap else found)
        i, j = (np.sort(np.concatenate(k)) for k in (i, j))
        return Aligned(self, a, b, n_a, n_b, i, j)


class Aligned:
    """Tokens ``a`` and ``b`` of some texts (``n_a``, ``n_b`` each), and ``i``, ``j``: the last token of each group in both."""

    def __init__(self, made: Aligner, a, b, n_a, n_b, i, j):
        self.made, self.a, self.b, self.n_a, self.n_b, self.i, self.j = made, a, b, n_a, n_b, i, j
        self.n_groups = np.diff(np.searchsorted(i, np.concatenate([[0], np.cumsum(n_a)])))

    def pairs(self) -> np.ndarray:
        """Place in ``pair_table`` of each group's last ids, which end together."""
        return np.searchsorted(self.made.pairs, self.a[self.i] * self.made.n_b + self.b[self.j]).astype(np.int32)

    def texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the groups' ids in order."""
        i, j = self.i, self.j
        size_a, size_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        before_b, through_a = j - size_b + 1, i + 1
        mixed = np.empty(len(self.a) + len(self.b), np.int64)
        mixed[np.arange(len(self.a)) + np.repeat(before_b, size_a)] = self.a
        mixed[np.arange(len(self.b)) + np.repeat(through_a, size_b)] = self.b
        data, at = self.made.digits.join(mixed)
        data[at[i + before_b + 1] - 1] = ord("|")
        data[at[j + through_a + 1] - 1] = ord(";")
        raw, ends = data.tobytes(), at[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [raw[s : max(e - 1, s)] for s, e in zip(ends[:-1], ends[1:], strict=True)]


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _spaced(column: pa.Array) -> pa.Array:
    """Texts with a space before each; null counts as empty."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    one, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    return pc.binary_join_element_wise(one, filled, none)


def align_tokens(
    docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False
) -> DataFrame:
    """One row per document: how the tokens of two vocabularies align, and how usual its id pairs are in the corpus.

    ``a_path`` is byte-level BPE (.json), given a space and the text; ``b_path`` SentencePiece
    (.model), which adds the space; both lie at the same path on every executor. Special strings
    are plain text. Columns: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (token
    pairs that end together), ``n_best`` (links whose id pair is linked most often in the corpus
    among the pairs of its B id), ``count_sum`` (of the links, how often their pair is linked),
    ``groups_sha256`` of ``a1,a2|b1;a3|b2,b3``, and ``with_groups`` that text itself.

    Texts are encoded once; their links wait in the checkpoint folder, 4 bytes each, until all are
    counted. Counts are summed in each task, then by pair; there are as many as ``pair_table`` has
    rows at most, whatever the corpus, so they are sent to all tasks.

    Defined cases: texts that are null or empty, or whose tokens' bytes are not a space and the
    text, have no tokens: zeros, and '' for the hash; a null id stays null; repeated rows count and
    come each; an empty table gives an empty result; long texts count whole; other columns are
    ignored, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = "n_a long, n_b long, n_groups long, groups_sha256 string, groups string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, key_type = _aligner(a_path, b_path), None
        names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links", "pair", "times"]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        total = np.zeros(len(aligner.pairs), np.int64)
        for batch in batches:
            key_type = batch.column(0).type
            for start, stop, block in blocks(_spaced(batch.column(1))):
                found = aligner.align(block)
                pairs, texts = found.pairs(), found.texts()
                total += np.bincount(pairs, minlength=len(total))
                ends = 4 * np.concatenate([[0], np.cumsum(found.n_groups)])
                links = pa.Array.from_buffers(pa.large_binary(), stop - start, [None, pa.py_buffer(ends), pa.py_buffer(pairs)]).cast(pa.binary())
                hashes = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                kept = [t.decode() for t in texts] if with_groups else [None] * len(texts)
                columns = [pa.array(c, t) for c, t in zip((found.n_a, found.n_b, found.n_groups, hashes, kept), types, strict=False)]
                nulls = [pa.nulls(stop - start, t) for t in types[6:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns, links, *nulls], names)
        some = np.flatnonzero(total)
        for at in range(0, len(some), _ROW):
            part = some[at : at + _ROW]
            lists = [pa.array([x], t) for x, t in zip((part.astype(np.int32), total[part]), types[6:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), *(pa.nulls(1, t) for t in types[:6]), *lists], names)

    first = cut(rows.mapInArrow(run, f"doc_id {kind}, {counts}, links binary, pair array<int>, times array<bigint>"))
    each = first.where("pair is not null").select(F.explode(F.arrays_zip("pair", "times")).alias("x")).select("x.*")
    sums = each.groupBy("pair").agg(F.sum("times").alias("times")).toArrow()
    shared = spark.sparkContext.broadcast((sums.column(0).to_numpy().astype(np.int64), sums.column(1).to_numpy().astype(np.int64)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        times, best = np.zeros(len(aligner.pairs), np.int64), np.zeros(aligner.n_b, np.int64)
        times[shared.value[0]] = shared.value[1]
        b_ids = aligner.pairs % aligner.n_b
        np.maximum.at(best, b_ids, times)
        top = (times == best[b_ids]).astype(np.int64)
        for batch in batches:
            links = batch.column(6)
            ends = np.frombuffer(links.buffers()[1], np.int32)[links.offset : links.offset + len(links) + 1].astype(np.int64) // 4
            flat = np.frombuffer(links.buffers()[2] or b"", np.int32)
            sums_of = lambda of: np.diff(np.concatenate([[0], np.cumsum(of[flat[ends[0] : ends[-1]]])])[ends - ends[0]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], batch.column(3), pa.array(sums_of(top)), pa.array(sums_of(times))], [*batch.schema.names[:6], "n_links", "n_best", "count_sum"]
            )

    out = first.where("links is not null").drop("pair", "times").mapInArrow(rate, f"doc_id {kind}, {counts}, n_links long, n_best long, count_sum long")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(*names, *["groups"] * with_groups)
