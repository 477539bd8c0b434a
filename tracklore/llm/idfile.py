"""Token-id files: a Spark data source, ``token_ids``, of range-coded, checksummed blocks.

A file is a run of groups. A group names its blocks (ids, bytes and CRC-32 of the ids of each),
then holds their payloads (see ``rangecoder``) and a table of the documents that begin in it
with their numbers of ids. Every task writes one file of its own name; what counts is listed in
``_manifest.json``, written once all tasks are done, so files of lost or repeated attempts are
never read. Files stand in the order of the partitions written.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .rangecoder import BLOCK, LANES, decode_blocks, encode_blocks
from .runtime import prepare
from .textblocks import blocks
from .tokencount import encoder

_MAGIC, _MANIFEST = b"IDRC0002", "_manifest.json"
#: Blocks, whether ids have over 16 bits, bytes of the documents' table and their CRC-32, and the CRC-32 of these and the blocks' entries.
_GROUP = struct.Struct("<IIIII")
#: Ids, bytes and CRC-32 of a block.
_ENTRY = struct.Struct("<III")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class IdWriter:
    """Documents' ids as one file, in ``out``; memory holds a group of ids and the ids of one document."""

    def __init__(self, out: io.IOBase, doc_type: pa.DataType, block: int = BLOCK, lanes: int = LANES):
        self._out, self._type, self._block, self._group = out, doc_type, block, block * lanes
        self._keys: list = []
        self._sizes: list[int] = []
        self._ids: list[np.ndarray] = []
        self._held = self.total = self.docs = 0
        out.write(_MAGIC)

    def add(self, key: object, ids: np.ndarray) -> None:
        self._keys.append(key)
        self._sizes.append(len(ids))
        self._ids.append(ids)
        self._held += len(ids)
        self.total += len(ids)
        self.docs += 1
        while self._held >= self._group:
            self._flush(self._group)

    def close(self) -> None:
        if self._held or self._keys:
            self._flush(self._held)

    def _flush(self, n: int) -> None:
        held = np.concatenate(self._ids) if self._ids else np.zeros(0, np.uint32)
        ids, rest = held[:n], held[n:]
        wide = bool(ids.max(initial=0) >> 16)
        table = io.BytesIO()
        batch = pa.record_batch([pa.array(self._keys, self._type), pa.array(self._sizes, pa.int64())], ["doc_id", "n"])
        with pa.ipc.new_stream(table, batch.schema) as stream:
            stream.write_batch(batch)
        payloads, docs = encode_blocks(ids, wide, self._block), table.getvalue()
        parts = (ids[k * self._block : (k + 1) * self._block] for k in range(len(payloads)))
        entries = b"".join(_ENTRY.pack(len(some), len(payload), _crc(some)) for some, payload in zip(parts, payloads, strict=True))
        head = len(payloads), int(wide), len(docs), zlib.crc32(docs)
        self._out.write(_GROUP.pack(*head, zlib.crc32(_GROUP.pack(*head, 0) + entries)) + entries)
        self._out.write(b"".join(payloads))
        self._out.write(docs)
        self._keys, self._sizes, self._ids, self._held = [], [], [rest] if len(rest) else [], len(rest)


def read_file(source: io.IOBase) -> Iterator[tuple[object, np.ndarray]]:
    """(key, ids) of each document of a file, group by group; a damaged block or table is an error."""

    def take(n: int) -> bytes:
        got = source.read(n)
        if len(got) != n:
            raise ValueError("a token-id file ends early")
        return got

    if take(len(_MAGIC)) != _MAGIC:
        raise ValueError("not a token-id file")
    waiting: deque[tuple[object, int]] = deque()
    held, have = [], 0
    while head := source.read(_GROUP.size):
        if len(head) < _GROUP.size:
            raise ValueError("a token-id file ends early")
        n_blocks, wide, n_docs, docs_crc, head_crc = _GROUP.unpack(head)
        listed = take(_ENTRY.size * n_blocks)
        if zlib.crc32(head[:-4] + bytes(4) + listed) != head_crc:
            raise ValueError("a group's head in a token-id file is damaged")
        entries = list(_ENTRY.iter_unpack(listed))
        payloads = [take(size) for _, size, _ in entries]
        docs = take(n_docs)
        if zlib.crc32(docs) != docs_crc:
            raise ValueError("the documents' table of a token-id file is damaged")
        found = decode_blocks(payloads, [n for n, _, _ in entries], bool(wide))
        if any(_crc(ids) != crc for ids, (_, _, crc) in zip(found, entries, strict=True)):
            raise ValueError("a block of a token-id file is damaged")
        table = pa.ipc.open_stream(docs).read_all()
        waiting.extend(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
        held += found
        have += sum(map(len, found))
        if waiting and waiting[0][1] <= have:
            ids, at = np.concatenate(held) if held else np.zeros(0, np.uint32), 0
            while waiting and waiting[0][1] <= have:
                key, n = waiting.popleft()
                yield key, ids[at : at + n]
                at, have = at + n, have - n
            held = [ids[at:]]
    if waiting or have:
        raise ValueError("a token-id file ends early")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str
    ids: int
    docs: int


@dataclass
class _File(InputPartition):
    path: str
    start: int


class TokenIds(DataSource):
    """Writes (doc_id, ids) and reads (doc_id, start, n_tokens, ids); ``ids`` are little-endian unsigned 32-bit integers."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return f"doc_id {_manifest(self.options['path'])['doc_type']}, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite)


def _manifest(path: str) -> dict:
    system, base = _files(path)
    with system.open_input_stream(f"{base}/{_MANIFEST}") as f:
        return json.loads(f.read())


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        if schema.names != ["doc_id", "ids"]:
            raise ValueError("token_ids takes the columns doc_id and ids")
        self.doc_type = schema["doc_id"].dataType.simpleString()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, base = _files(self.path)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        system.create_dir(base, recursive=True)
        try:
            with system.open_output_stream(f"{base}/{name}") as out:
                writer = None
                for batch in iterator:
                    writer = writer or IdWriter(out, batch.schema.field(0).type)
                    for key, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        writer.add(key, np.frombuffer(raw.as_buffer() or b"", "<u4"))
                if writer is None:
                    writer = IdWriter(out, pa.null())
                writer.close()
        except BaseException:
            _drop(system, f"{base}/{name}")
            raise
        return _Written(part, name, writer.total, writer.docs)

    def commit(self, messages: list[_Written | None]) -> None:
        system, base = _files(self.path)
        system.create_dir(base, recursive=True)
        if not self.overwrite and system.get_file_info(f"{base}/{_MANIFEST}").type != fs.FileType.NotFound:
            self.abort(messages)
            raise ValueError(f"{self.path} holds token ids already")
        files = sorted((m for m in messages if m), key=lambda m: m.part)
        listed = {"doc_type": self.doc_type, "files": [{"name": m.name, "ids": m.ids, "docs": m.docs} for m in files if m.docs]}
        fresh = f"{base}/_{uuid.uuid4().hex}"
        with system.open_output_stream(fresh) as f:
            f.write(json.dumps(listed).encode())
        system.move(fresh, f"{base}/{_MANIFEST}")
        for m in files:
            if not m.docs:
                _drop(system, f"{base}/{m.name}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, base = _files(self.path)
        for m in messages:
            if m:
                _drop(system, f"{base}/{m.name}")


def _drop(system: fs.FileSystem, path: str) -> None:
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[_File]:
        out, start = [], 0
        for f in _manifest(self.path)["files"]:
            out.append(_File(f"{self.path}/{f['name']}", start))
            start += f["ids"]
        return out or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        schema, start = to_arrow_schema(self.schema), partition.start
        system, base = _files(partition.path)
        rows: list[tuple] = []
        held = 0
        with system.open_input_stream(base) as source:
            for key, ids in read_file(source):
                rows.append((key, start, len(ids), ids.astype("<u4").tobytes()))
                start += len(ids)
                held += len(ids)
                if held > 1 << 19 or len(rows) == 2048:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def token_ids(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of each text under the tokenizers file, then ``end_id``; in ascending order of ids.

    Partitions are ranges of (id, hash of the text), so rows of one id may be many. The same
    path must hold the tokenizer on every executor.

    Defined cases: a null or empty text is ``end_id`` alone; null ids come first; repeated rows
    each have their ids; an empty table stays empty; long texts are encoded whole; other columns
    are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer_path).ids
        for batch in batches:
            for start, stop, block in blocks(batch.column(1)):
                ids, counts = ids_of(block)
                last = np.cumsum(counts)
                ids = np.insert(ids.astype("<u4"), last, end_id)
                ends = np.concatenate([[0], last + np.arange(1, len(counts) + 1)])
                packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * ends.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), packed.cast(pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def write_ids(encoded: DataFrame, path: str) -> None:
    """``encoded`` (doc_id, ids) as a folder of token-id files, in the order of its partitions."""
    prepare(encoded.sparkSession).dataSource.register(TokenIds)
    encoded.select("doc_id", "ids").write.format("token_ids").mode("append").save(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` of a folder of token-id files."""
    prepare(spark).dataSource.register(TokenIds)
    return spark.read.format("token_ids").load(path)
