"""Token counts: lengths only, computed in Arrow batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceEncoder, sentencepiece_encoder, tokenizers_encoder
from .runtime import prepare
from .textblocks import blocks


@cache
def encoder(path: str) -> PieceEncoder:
    """The encoder of a model file, made once in each Python worker."""
    if path.endswith(".model"):
        return sentencepiece_encoder(path)
    from tokenizers import Tokenizer

    return tokenizers_encoder(Tokenizer.from_file(path))


def count_tokens(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` under the model at ``model_path``.

    ``model_path`` ends in ``.model`` (SentencePiece) or ``.json`` (byte-level BPE of the
    tokenizers library) and is the same on every executor. Whole texts are counted, without
    added, begin or end tokens, with special strings handled as the library does by default.

    Defined cases: a null text counts as an empty one; an empty text has 0 bytes and 0 tokens;
    a null id stays null; repeated rows each get their own row; an empty table gives an empty
    result; a very long text is split at safe boundaries; other columns are ignored, whatever
    their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = encoder(model_path).lengths
        for batch in batches:
            n_bytes, n_tokens = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            for start, stop, block in blocks(batch.column(1), batch_bytes):
                n_bytes[start:stop] = np.diff(block.bounds)
                n_tokens[start:stop] = lengths(block)
            columns = [batch.column(0), pa.array(n_bytes), pa.array(n_tokens)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
