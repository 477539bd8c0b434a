import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracklore.llm.pieces import tokenizers_encoder
from tracklore.llm.textblocks import Block


class Counted:
    """A tokenizer that counts the inputs of its batches."""

    def __init__(self, model):
        self.model, self.inputs = model, 0

    def encode_batch_fast(self, texts, **options):
        self.inputs += len(texts)
        return self.model.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.model, name)


def test_new_pieces_are_encoded_together():
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = sorted(t.content for t in model.get_added_tokens_decoder().values())[:1]
    odd = ["naïve café", "a  b\n\tc", "數據 處理", "", "x" * 300 + " y", " lead", "trail ", "é \U0001f600!", "12,5 (x) it's", *special, *(f"z{s}z" for s in special)]
    texts = [*odd, *(f"number {i}, word{i} w{i:x}-{i}" for i in range(3000))]
    raw = [t.encode() for t in texts]
    counted = Counted(model)
    flat, size = tokenizers_encoder(counted).ids(Block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert size.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]
    assert counted.inputs < 200  # each new piece was an input before
