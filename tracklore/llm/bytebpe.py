"""Byte-level BPE: ids and character offsets from ranks, and bytes or text back from ids."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceEncoder, tokenizers_encoder
from .runtime import prepare
from .textblocks import blocks


@cache
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank on each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``, found by merging below its own rank."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], limit), i))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@cache
def tokenizer_json(path: str, pattern: str) -> str:
    """The ranks as a definition that the tokenizers library reads."""
    ranks, letters = read_ranks(path), byte_alphabet()
    name = lambda token: "".join(letters[b] for b in token)
    ordered = sorted(ranks, key=ranks.__getitem__)
    merges = [[name(part) for part in last_merge(token, ranks)] for token in ordered if len(token) > 1]
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    to_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [],
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, to_bytes]},
            "model": {"type": "BPE", "vocab": {name(token): ranks[token] for token in ordered}, "merges": merges},
        }
    )


@cache
def _encoder(definition: str) -> PieceEncoder:
    from tokenizers import Tokenizer

    return tokenizers_encoder(Tokenizer.from_str(definition))


class ByteTable:
    """Bytes of each id, end to end."""

    def __init__(self, tokens: Sequence[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes in order, and where each id's bytes start (and the last ends)."""
        if ids.size and not (0 <= ids.min() and ids.max() < len(self.size) and self.size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(self.start[ids] - at[:-1], size) + np.arange(at[-1])], at


@cache
def _table(path: str) -> ByteTable:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ByteTable(tokens)


def char_offsets(data: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each id, the character of its text in which its first byte lies (an id may start inside one)."""
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    inside = np.append((data & 0xC0) == 0x80, False)
    first = np.repeat(begins[at[bounds[:-1]]], np.diff(bounds))
    return begins[at[:-1]] - first - inside[at[:-1]]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False
) -> DataFrame:
    """One row per document: ``doc_id`` and ``ids``, and with ``offsets`` the character each id starts in.

    Each match of ``pattern`` is encoded separately by the byte-level BPE of ``ranks_path``
    (the same path on every executor), with no special tokens.

    Defined cases: a null or empty text has no ids; a null id stays null; repeated rows each get
    their own row; an empty table gives an empty result; long texts are encoded whole; other
    columns are ignored, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    definition = spark.sparkContext.broadcast(tokenizer_json(ranks_path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _encoder(definition.value).ids
        for batch in batches:
            for start, stop, block in blocks(batch.column(1)):
                ids, counts = ids_of(block)
                columns = [batch.column(0).slice(start, stop - start), _lists(ids, counts, pa.int32())]
                if offsets:
                    data, at = _table(ranks_path).join(ids)
                    bounds = np.concatenate([[0], np.cumsum(counts)])
                    columns.append(_lists(char_offsets(data, at, bounds), counts, pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "offsets"][: len(columns)])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", offsets array<int>" * offsets)


def decode(encoded: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: ``doc_id``, ``ids`` and ``bytes``, the ids' bytes joined.

    Characters split over ids come out whole, as bytes are joined before anyone reads them as
    text; ``CAST(bytes AS STRING)`` gives the text.

    Defined cases: null ids give null bytes and no ids empty bytes; an id outside the vocabulary
    is an error; an empty table gives an empty result; other columns are ignored.
    """
    prepare(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(ranks_path)
        for batch in batches:
            ids = batch.column(1)
            counts = np.diff(ids.offsets.to_numpy())
            data, at = table.join(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            counts[np.asarray(ids.is_null())] = 0
            ends = pa.py_buffer(at[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32))
            known = pa.array(np.asarray(ids.is_valid())).buffers()[1]
            joined = pa.Array.from_buffers(pa.binary(), len(ids), [known, ends, pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, joined], ["doc_id", "ids", "bytes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, bytes binary")
