"""What tells words, pieces, sets and windows apart: structured words, forced collisions, rows that share an id."""

import base64

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm import brute_repeats, by_id, prose
from tracklore.llm import minhash, packing, pieces, superkmer, textblocks
from tracklore.llm.bytebpe import decode, encode
from tracklore.llm.tokencount import count_tokens, encoder

public_tokenizers = pytest.importorskip("public_tokenizers")


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def structured():
    """Pairs of words that collide under any polynomial modulo 2**64 of odd base."""
    out = []
    for letters in ("ab", "qe", "xo", "AB"):
        for n in (1024, 2048, 4096):
            out += [thue_morse(n, letters), thue_morse(n, letters[::-1])]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(structured())), "doc_id long, text string").coalesce(1)


def test_slices_of_structured_words_differ():
    words = structured()
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    for seed in (0, 1):
        assert len(set(textblocks.slice_hashes(raw, ends - [len(w) for w in words], ends, seed).tolist())) == len(words)
    short = np.frombuffer(b"ab\0ab\0\0abcdefghabcdefgh\0", np.uint8)
    found = textblocks.slice_hashes(short, np.array([0, 3, 0, 3, 7, 7, 0]), np.array([2, 5, 3, 7, 15, 23, 0]))
    assert found[0] == found[1] and len(set(found.tolist())) == 6


def test_tokens_of_structured_words(spark, odd):
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    words = structured()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model")))
    assert [got[d].n_tokens for d in range(len(words))] == [len(model.encode(w)) for w in words]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    back = by_id(decode(encode(odd, path, public_tokenizers.PATTERN), path))
    assert [(back[d].ids, bytes(back[d].bytes)) for d in range(len(words))] == [(library.encode_ordinary(w), w.encode()) for w in words]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(packing.pack(odd, path).collect(), key=lambda r: r.start)
    for d, w in enumerate(words):
        want = [*library.encode(w, add_special_tokens=False).ids, 1]
        assert b"".join(bytes(r.ids) for r in rows if r.doc_id == d) == np.array(want, "<u4").tobytes()


def test_pieces_that_share_a_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(pieces, "slice_hashes", lambda data, start, end: np.full(len(start), 5, np.uint64))
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, library = pieces.tokenizers_encoder(Tokenizer.from_file(path)), Tokenizer.from_file(path)
    texts = ["alpha beta gamma beta", "", "beta alpha 12 alpha", "x"]
    for _ in range(2):
        for start, stop, block in textblocks.blocks(pa.array(texts)):
            ids, counts = mine.ids(block)
            want = [library.encode(t, add_special_tokens=False).ids for t in texts[start:stop]]
            assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert encoder.cache_info().maxsize is None


def test_structured_words_are_not_duplicates(spark, odd):
    got = minhash.near_duplicates(odd.union(spark.createDataFrame([(100, structured()[0].lower())], "doc_id long, text string"))).collect()
    # A-Z count as a-z, so the last pairs equal the first.
    assert {r.doc_id for r in got if not r.kept} == {*range(18, 24), 100}
    w = structured()
    texts = [" ".join([*(f"w{k}" for k in range(19)), x]) for x in w[:18]]
    removed = superkmer.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.n_removed for r in removed.collect()] == [0] * 18


@pytest.mark.parametrize("share", [2.0, 1e-9])
@pytest.mark.parametrize("most", [1_000_000, 3])
def test_substrings_of_large_buckets_and_shared_ids(spark, monkeypatch, share, most):
    import random

    rng = random.Random(8)
    monkeypatch.setattr(superkmer, "HOT_SHARE", share)
    monkeypatch.setattr(superkmer, "SEEN", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    texts = [prose(rng, 200)]
    for _ in range(30):
        start = rng.randrange(150)
        texts.append(prose(rng, rng.randrange(30)) + " " + " ".join(texts[0].split()[start : start + 60]) + " zed " + "la " * rng.randrange(60))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr("tracklore.llm.runtime.BATCH_ROWS", 7)
    got = by_id(superkmer.remove_repeats(df))
    monkeypatch.undo()
    assert {d: (r.n_words, r.n_removed, r.kept_text) for d, r in got.items()} == brute_repeats(docs)


def test_rows_that_share_an_id_do_not_touch_others(spark):
    import random

    rng = random.Random(7)
    long, short, third = prose(rng, 60), "three short words", prose(rng, 60)
    df = spark.createDataFrame([(1, long), (2, long), (2, short), (3, third), (2, third), (2, short)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in superkmer.remove_repeats(df).collect())
    assert got == [(1, 60, 0), (2, 3, 0), (2, 3, 0), (2, 60, 0), (2, 60, 60), (3, 60, 60)]
    near = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    n = len({tuple(long.split()[i : i + 5]) for i in range(56)})
    m = len({tuple(third.split()[i : i + 5]) for i in range(56)})
    assert near == sorted([(1, n, 1, True), (2, n, 1, False), (2, 1, 1, False), (2, 1, 1, False), (2, m, 1, False), (3, m, 1, False)])


def test_top_k_of_repeats_and_large_components(spark):
    from pyspark.sql import functions as F

    from tracklore.llm.topk import top_k

    rng = np.random.default_rng(3)
    rows = [(k, [int(x) for x in rng.integers(-5, 6, 6)]) for k in range(60)]
    rows += [(60, [10**11] * 6), (61, [-(10**11)] * 6), (62, [2**62] * 6), (63, [2**62] * 6), (64, [2**40] * 6), (None, [1] * 6), (65, None)]
    again = [(3, rows[3][1]), (60, rows[60][1]), (7, [1000] * 6)]
    df = spark.createDataFrame(rows + again, "vec_id long, vector array<long>").repartition(4)
    good = {k: v for k, v in rows if k is not None and v is not None}
    good[7] = min(good[7], [1000] * 6)
    most = 2**61

    def score(x, y):
        return sum(max(-most, min(most, sum(a * b for a, b in zip(x[s], y[s], strict=True)))) for s in (slice(0, 3), slice(3, 6)))

    want = []
    for q in (k for k in good if k % 5 == 0):
        best = sorted((-score(good[q], v), k) for k, v in good.items() if k != q)[:5]
        want += [(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)]
    got = top_k(df, F.col("vec_id") % 5 == 0, 5, 6).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want


def test_near_vectors_against_all_pairs(spark, monkeypatch):
    """Links, components and what is kept, with clusters, repeats, a shared id, and groups of any size."""
    from tracklore.llm import capfilter

    rng = np.random.default_rng(11)
    centres = rng.standard_normal((6, 16))
    x = np.concatenate([c + 0.09 * np.linalg.norm(c) * rng.standard_normal((40, 16)) / 4 for c in centres] + [rng.standard_normal((60, 16))])
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(len(x)), x, strict=True)]
    rows += [(400, rows[3][1]), (401, (2 * x[3]).tolist()), (5, rows[50][1]), (None, rows[3][1]), (402, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ids = [k for k, v in rows[:-2]]
    unit = np.array([v for _, v in rows[:-2]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    label = np.array(ids)
    while True:
        lower = np.where(near, label[None, :], 10**9).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    want = sorted((k, int(near[i].sum()) - 1, int(label[i]), bool(label[i] == k)) for i, k in enumerate(ids))
    monkeypatch.setattr(capfilter, "RECALL", 1.0)
    for chunk, group in ((2048, 1024), (7, 1024), (7, 1)):
        monkeypatch.setattr(capfilter, "CHUNK", chunk)
        monkeypatch.setattr(capfilter, "GROUP", group)
        got = sorted(tuple(r) for r in capfilter.near_vectors(df, 16).where("vec_id is not null and vec_id < 402").collect())
        assert got == want
    others = capfilter.near_vectors(df, 16).where("vec_id is null or vec_id = 402").collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in others) == [(-1, 0, -1, True), (402, 0, 402, True)]


def test_filters_grow_with_the_vectors():
    from tracklore.llm import capfilter

    assert capfilter.settings(64, 1000) == (16, 24)
    words, filters = capfilter.settings(64, 600_000)
    assert words**4 >= 600_000 and capfilter.recall_of(64, words, filters) >= 0.98


def test_memory_of_texts_without_boundaries_is_bounded():
    """Chinese texts are one piece each: none is kept, and the table of short pieces starts anew at its budget."""
    import random

    import pyarrow as pa
    import sentencepiece

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.sentencepiece_encoder(path)
    encoder._budget = 40_000
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(rng.choice([5, 90, 1600]))) for _ in range(300)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(60)] + [None, ""]
    rng.shuffle(texts)
    for _, _, block in textblocks.blocks(pa.array(texts), 1 << 15):
        at = block.bounds
        whole = [block.data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert encoder.lengths(block).tolist() == [len(library.encode(t)) for t in whole]
        rows, used, n_bytes = encoder._lasting
        assert n_bytes + 4 * used < 40_000 + 5 * (1 << 15) and encoder._byte_size[:rows].max(initial=0) <= pieces.LONG
        assert 4 * len(encoder._flat) < 16 << 20


def test_one_text_of_a_labelled_id_and_a_byte_budget(spark):
    from pyspark.sql import functions as F

    from tracklore.llm import quality

    labels = spark.createDataFrame([(d, d % 2) for d in range(30)], "doc_id long, quality int")
    rows = [(d, f"{'good words here' if d % 2 else 'BUY NOW !!!'} {d}") for d in range(30)]
    once = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert (quality.fit(spark.createDataFrame(rows * 40, "doc_id long, text string"), labels) == once).all()
    unlike = spark.createDataFrame([(d, t + f" v{k}") for d, t in rows for k in range(50)], "doc_id long, text string")
    least = unlike.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "t.text")
    assert (quality.fit(unlike, labels) == quality.fit(least, labels)).all()
    assert not quality.fit(unlike, labels, sample_bytes=10).any()
    assert quality.fit(unlike, labels, sample_bytes=60).any()
