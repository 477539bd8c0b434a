"""Texts split at safe boundaries, each distinct piece given to a tokenizer library once.

A boundary is safe before a single space between two characters that are not white space:
byte-level BPE's pattern starts a match there, and no SentencePiece piece holds a space after
another character, so the pieces' encodings, put together, are the whole text's encoding.
Spaces beside other white space, or beside characters that share a lead byte with some, are
not cut at; texts without a safe boundary go to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np

from .textblocks import SPACE, Block, equal_slices, slice_hashes

#: Lead bytes of all white space outside ASCII, and of U+2581, which SentencePiece takes for a space.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII white space and the separators 1C-1F.
_BLANK = SPACE.copy()
_BLANK[0x1C:0x20] = True
_HEAD = np.uint64(0x9E3779B97F4A7C15)
#: Pieces of more bytes are encoded where they occur and not kept.
LONG = 256
#: Pieces that a library encodes in one call: its encodings take some hundred bytes each until they are read.
CALL = 4096
#: Pieces that a tokenizers library takes as the words of one text, which are encoded each by itself and put together.
TOGETHER = 256


def safe_cuts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start of each piece (texts that are empty have none), and which pieces begin a text."""
    data, n = block.data, len(block.data)
    stop = np.zeros(n + 1, bool)
    stop[block.bounds] = True
    space = np.flatnonzero(data == 32)
    space = space[(space > 2) & (space < n - 1)]
    ok = ~(stop[space] | stop[space + 1] | _BLANK[data[space - 1]] | _BLANK[data[space + 1]] | _LEAD[data[space + 1]])
    ok &= ~((data[space - 2] == 0xC2) | (_LEAD[data[space - 3]] & (data[space - 1] >= 0x80)))
    begins = np.unique(block.bounds[:-1][np.diff(block.bounds) > 0])
    cuts = np.concatenate([begins, space[ok]])
    order = np.argsort(cuts, kind="stable")
    return cuts[order], order < len(begins)


class PieceEncoder:
    """Ids of pieces from ``encode(pieces, begins)``, remembered for a bounded number of distinct short pieces.

    ``encode`` gives a list for each piece, or one array of all ids and the number of each piece's.

    The table starts anew once it holds ``most`` pieces, or ``budget`` bytes of pieces and ids; a
    piece of over LONG bytes (a text without a safe boundary) lasts for its block only, so memory
    is bounded whatever the script. Pieces are looked up by a 64-bit hash, in an open-addressing table that numpy probes for all
    pieces of a block at once; each hit counts only if its bytes are those of the piece kept there.
    """

    def __init__(self, encode: Callable[[list[str], list[bool]], Iterable[list[int]] | tuple[np.ndarray, np.ndarray]], most: int = 1_000_000, budget: int = 64 << 20):
        self._encode, self._most, self._budget = encode, most, budget
        self._slots = 1 << (2 * most).bit_length()
        self._clear()

    def _clear(self) -> None:
        self._mark = np.zeros(self._slots, np.uint64)
        self._row = np.zeros(self._slots, np.int32)
        self._flat = np.zeros(1 << 20, np.int32)
        self._size = np.zeros(1 << 19, np.int32)
        self._from = np.zeros(1 << 19, np.int64)
        self._rows = self._used = 0
        #: Bytes of the kept pieces, and where each row's begin and how many there are.
        self._bytes = np.zeros(1 << 20, np.uint8)
        self._byte_from, self._byte_size = np.zeros(1 << 19, np.int64), np.zeros(1 << 19, np.int64)
        self._byte_used = 0
        self._lasting = (0, 0, 0)

    def _forget(self) -> None:
        """Drop the rows that only the last block needed, and the table once it is over its budget."""
        self._rows, self._used, self._byte_used = self._lasting
        if self._byte_used + 4 * self._used > self._budget or 4 * len(self._flat) + len(self._bytes) > 4 * self._budget:
            self._clear()

    def _find(self, marks: np.ndarray) -> np.ndarray:
        """Table row of each mark, or -1."""
        rows = np.full(len(marks), -1, np.int64)
        left, at = np.arange(len(marks)), (marks & np.uint64(self._slots - 1)).astype(np.int64)
        while len(left):
            seen = self._mark[at]
            hit = seen == marks[left]
            rows[left[hit]] = self._row[at[hit]]
            go = ~hit & (seen != 0)
            left, at = left[go], (at[go] + 1) & (self._slots - 1)
        return rows

    def _add(self, marks: np.ndarray, rows: np.ndarray) -> None:
        at = (marks & np.uint64(self._slots - 1)).astype(np.int64)
        while len(marks):
            free = np.flatnonzero(self._mark[at] == 0)
            self._mark[at[free]] = marks[free]
            done = free[self._mark[at[free]] == marks[free]]
            self._row[at[done]] = rows[done]
            go = np.ones(len(marks), bool)
            go[done] = False
            marks, rows, at = marks[go], rows[go], (at[go] + 1) & (self._slots - 1)

    def _encoded(self, keys: list[bytes], begins: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of ids of each."""
        flat, size = [np.zeros(0, np.int32)], np.zeros(len(keys), np.int64)
        for at in range(0, len(keys), CALL):
            some = slice(at, at + CALL)
            got = self._encode([k.decode("utf-8", "replace") for k in keys[some]], begins[some])
            ids, size[some] = got if isinstance(got, tuple) else _end_to_end(got)
            flat.append(ids)
        return np.concatenate(flat), size

    def _learn(self, keys: list[bytes], begins: list[bool], lasting: bool = True) -> None:
        """New rows at the table's end; bytes are kept of lasting ones only."""
        flat, size = self._encoded(keys, begins)
        while self._used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._rows + len(size) > len(self._size):
            for name in ("_size", "_from", "_byte_from", "_byte_size"):
                x = getattr(self, name)
                setattr(self, name, np.concatenate([x, np.zeros_like(x)]))
        raw = np.frombuffer(b"".join(keys) if lasting else b"", np.uint8)
        while self._byte_used + len(raw) + 8 > len(self._bytes):
            self._bytes = np.concatenate([self._bytes, np.zeros_like(self._bytes)])
        self._bytes[self._byte_used : self._byte_used + len(raw)] = raw
        self._flat[self._used : self._used + len(flat)] = flat
        at = slice(self._rows, self._rows + len(size))
        self._size[at] = size
        self._from[at] = self._used + np.cumsum(size) - size
        n_bytes = np.fromiter(map(len, keys), np.int64, len(keys)) if lasting else np.zeros(len(keys), np.int64)
        self._byte_size[at] = n_bytes
        self._byte_from[at] = self._byte_used + np.cumsum(n_bytes) - n_bytes
        self._byte_used += len(raw)
        self._used += len(flat)
        self._rows += len(size)

    def _pieces(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Table row of each piece in order, and where each piece starts in the block."""
        self._forget()
        cut, begins = safe_cuts(block)
        if self._rows + len(cut) > self._slots // 2 or self._rows > self._most:
            self._clear()
            if len(cut) > self._slots // 2:
                self._slots = 1 << (2 * len(cut)).bit_length()
                self._clear()
        end = np.append(cut[1:], len(block.data))[: len(cut)]
        size, raw = end - cut, None

        def texts(at: np.ndarray) -> list[bytes]:
            nonlocal raw
            raw = raw or block.data.tobytes()
            return [raw[s:e] for s, e in zip(cut[at].tolist(), end[at].tolist(), strict=True)]

        short = np.flatnonzero(size <= LONG)
        mark = slice_hashes(block.data, cut[short], end[short])
        mark[begins[short]] ^= _HEAD
        mark[mark == 0] = 1
        found = self._find(mark)
        if (miss := np.flatnonzero(found < 0)).size:
            new, first = np.unique(mark[miss], return_index=True)
            at, base = short[miss[first]], self._rows
            self._learn(texts(at), begins[at].tolist())
            self._add(new, np.arange(base, self._rows))
            found[miss] = self._find(mark[miss])
        same = self._byte_size[found] == size[short]
        same[same] = equal_slices(block.data, cut[short[same]], self._bytes, self._byte_from[found[same]], size[short[same]])
        rows = np.full(len(cut), -1, np.int64)
        rows[short[same]] = found[same]
        self._lasting = (self._rows, self._used, self._byte_used)
        if (alone := np.flatnonzero(rows < 0)).size:  # long pieces, and those that share a hash with another
            base = self._rows
            self._learn(texts(alone), begins[alone].tolist(), lasting=False)
            rows[alone] = np.arange(base, self._rows)
        return rows, cut

    def lengths(self, block: Block) -> np.ndarray:
        """Number of ids of each text."""
        rows, cut = self._pieces(block)
        total = np.concatenate([[0], np.cumsum(self._size[rows])])
        return np.diff(total[np.searchsorted(cut, block.bounds)])

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        rows, cut = self._pieces(block)
        size = self._size[rows]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self._flat[np.repeat(self._from[rows] - total[:-1], size) + np.arange(total[-1])]
        return flat, np.diff(total[np.searchsorted(cut, block.bounds)])


def _end_to_end(lists: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and the number of ids of each list."""
    lists = list(lists)
    return np.fromiter(chain.from_iterable(lists), np.int32), np.fromiter(map(len, lists), np.int64, len(lists))


def sentencepiece_encoder(path: str) -> PieceEncoder:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(pieces: list[str], begins: list[bool]) -> list[list[int]]:
        # The library itself puts a space before a text; a piece that begins none has it already.
        return model.encode([p if b else p[1:] for p, b in zip(pieces, begins, strict=True)], num_threads=1)

    return PieceEncoder(encode)


def tokenizers_encoder(model) -> PieceEncoder:
    """``model``: a Tokenizer of the tokenizers library, byte-level BPE under the usual pattern.

    Pieces of letters alone are one match of the pattern, so they skip it.
    """
    import os

    from tokenizers import Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    plain = Tokenizer.from_str(model.to_str())
    plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    n_bytes = np.zeros(model.get_vocab_size(), np.int64)
    for token, i in model.get_vocab(with_added_tokens=False).items():
        n_bytes[i] = len(token)  # a character for each byte
    for i, token in model.get_added_tokens_decoder().items():
        n_bytes[i] = len(token.content.encode())

    def encoded(by, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces are words of a few texts; their ids are told apart by where their bytes end."""
        texts = [pieces[at : at + TOGETHER] for at in range(0, len(pieces), TOGETHER)]
        found = by.encode_batch_fast(texts, is_pretokenized=True, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32)
        last, ends = np.cumsum(n_bytes[flat]), np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        upto = np.searchsorted(last, ends, side="right")
        if n_bytes[flat].all() and np.array_equal(np.append(0, last)[upto], ends) and upto[-1:].sum() == len(flat):
            return flat, np.diff(upto, prepend=0)
        # Some bytes have no token, or tokens of other bytes.
        return _end_to_end([e.ids for e in by.encode_batch_fast(pieces, add_special_tokens=False)])

    def encode(pieces: list[str], _: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        word = np.fromiter(((p[1:] if p[:1] == " " else p).isalpha() for p in pieces), bool, len(pieces))
        order = np.argsort(~word, kind="stable")
        n_words, listed = int(word.sum()), [pieces[i] for i in order.tolist()]
        (short, short_size), (rest, rest_size) = encoded(plain, listed[:n_words]), encoded(model, listed[n_words:])
        flat, size = np.concatenate([short, rest]), np.concatenate([short_size, rest_size])
        start, back = np.cumsum(size) - size, np.argsort(order)
        size, start = size[back], start[back]
        total = np.cumsum(size)
        return flat[np.repeat(start - total + size, size) + np.arange(len(flat))], size

    return PieceEncoder(encode)
