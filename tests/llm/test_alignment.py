"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_llm import DOCS
from tracklore.llm import alignment, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """{key: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)} of (key, text) by sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(alignment.byte_alphabet())}
    a_name = {i: t for t, i in a_model.get_vocab().items()}
    found, counts = [], Counter()
    for key, text in texts:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        a_bytes = [bytes(letters[c] for c in a_name[i]) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            found.append((key, [], [], [], ""))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        common = sorted(set(a_ends) & set(b_ends))
        groups, links, i, j = [], [], 0, 0
        for end in common:
            p, q = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        assert (i, j) == (len(a), len(b))
        counts.update(links)
        found.append((key, a, b, links, ";".join(groups)))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(key, len(a), len(b), len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups) for key, a, b, links, groups in found]


def test_gallop_finds_what_is_there():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 1), (40, 900), (300, 320), (1, 5000)):
        short, long = (np.sort(rng.choice(6000, k, replace=False)) for k in (n, m))
        for guess in (np.zeros(n, np.int64), np.arange(n) * m // max(n, 1), rng.integers(-5, m + 5, n)):
            got = alignment.gallop(short, long, guess)
            want = [long.tolist().index(x) if x in long else -1 for x in short]
            assert got.tolist() == want


def test_pairs_that_can_end_together():
    a, b = [b"ab", b"b", b"", b"xab", b"zz"], [b"b", b"ab", b"b", b"cxab", b"q"]
    assert alignment.pair_table(a, b).tolist() == [i * 5 + j for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))]
    whole = alignment._aligner(A, B)
    assert len(whole.pairs) <= whole.a_bytes.size.sum() * 2 + whole.b_bytes.size.sum()


def test_alignment_against_loops(spark):
    odd = ["▁under", "a▁b", "x y", "ﬁne", "  lead", "trail  ", "tab\tand\nline\r\n", "日本語のテキスト、です", "🙂🙂‍🙂 é", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00nul \x07", "한국어 텍스트"]
    texts = [*DOCS, *[(1000 + k, t) for k, t in enumerate(odd)], (None, "null id"), (None, "null id"), (5000, "word  " * 9000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, links int, pair string").repartition(5)
    got = alignment.align_tokens(df, A, B, with_groups=True).collect()
    want = brute(texts)
    key = lambda r: str(tuple(r))
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got), key=key) == sorted(want, key=key)
    assert sum(w[1] == 0 for w in want) > 4 and any(w[3] < min(w[1], w[2]) for w in want)
    assert alignment.align_tokens(df.limit(0), A, B).collect() == []


def test_alignment_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_alignment(spark, SF).collect()}
    want = {w[0]: (*w[1:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in brute(texts)}
    assert got == want
