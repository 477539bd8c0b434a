"""Operators against brute force on small tables with nulls, ties, repeats, empty and very long texts."""

import base64
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklore.llm import capfilter, linededup, minhash, packing, quality, superkmer
from tracklore.llm.bytebpe import decode, encode
from tracklore.llm.graph import components
from tracklore.llm.secrets import find_secrets, redact
from tracklore.llm.tokencount import count_tokens
from tracklore.llm.topk import top_k

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()) + rng.choice(["", "", "s", ",", "ed"]) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 90)) for _ in range(25)]
    near = [t.replace("alpha", "omega", 1) for t in base[:10]] + [t + " more" for t in base[10:20]]
    odd = [
        None, "", " ", "  two  spaces ", "a", "a a a a a", "Line one\nline  two\r\n\tline three  ", "é　日本 語  x", "word " * 300, "x" * 5000,
        "🙂 emoji 🙂🙂 and text", "<|endoftext|> and <s> stay", "it's we'll don't I'd", base[0].upper(), base[3] + "\n" + base[4] + "\n" + base[3],
        "tail spaces   ", "\n\n\n", "UPPER lower 123 4567", "▁under ▁line",
    ]
    texts = [*base, *base[:5], *near, *odd, " ".join(base * 3)]
    return list(enumerate(texts))


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "x", "y") for d, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, size string").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_counts(docs, none):
    import sentencepiece
    from tokenizers import Tokenizer

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(count_tokens(docs, path))
    for d, t in DOCS:
        assert (got[d].n_tokens, got[d].n_bytes) == (len(model.encode(t or "")), len((t or "").encode())), t
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = by_id(count_tokens(docs, path, batch_bytes=100))
    for d, t in DOCS:
        assert got[d].n_tokens == len(model.encode(t or "", add_special_tokens=False).ids), t
    assert count_tokens(none, path).count() == 0


def test_byte_bpe_round_trip(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = encode(docs, path, public_tokenizers.PATTERN, offsets=True)
    got, back = by_id(encoded), by_id(decode(encoded, path))
    for d, t in DOCS:
        ids = library.encode_ordinary(t or "")
        assert got[d].ids == ids
        assert bytes(back[d].bytes) == (t or "").encode()
        assert got[d].offsets == library.decode_with_offsets(ids)[1]
    assert decode(encode(none, path, public_tokenizers.PATTERN), path).count() == 0


def test_secrets(spark, none):
    texts = [
        "password=abc123def token", 'Secret : "hunter22", api_key=short token=token: abcdefgh', "AKIA" + "Q" * 16 + " AKIASHORT", "🙂 " + "0123456789abcdef" * 2, None, "", "x" * 100_000 + " passwd=longenough",
        "see kJ8s0Qz7Lm3Xv9Rt2Wp5Yb1N here", "kJ8s0Qz7Lm3Xv9RtEXAMPLEYb1N", "ordinarywordsthatarelongbutplain", "aaaaaaaaaa1111111111aaaaaaaaaa", "token=a token=b\ntoken=secretvalue",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secrets", F.lit(1))
    found = find_secrets(df)
    rules = [(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    got = by_id(found)
    for d, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(rules) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        assert [(s.start, s.kind_no, s.end) for s in got[d].secrets if s.kind_no < 3] == want
    entropy = {d: [(s.start, s.end) for s in r.secrets if s.kind == "entropy"] for d, r in got.items()}
    assert entropy[7] == [(4, 28)]
    assert not any(entropy[d] for d in (8, 9, 10))
    clean = by_id(redact(found))
    assert clean[0].text == "[SECRET] token"
    assert clean[4].text is None and clean[7].text == "see [SECRET] here"
    assert find_secrets(none).count() == 0


def test_entropy_is_the_windows_entropy(spark):
    rng = random.Random(3)
    strings = ["".join(rng.choice("abcdefgh01234567XYZ") for _ in range(rng.randint(20, 50))) for _ in range(30)]
    df = spark.createDataFrame([(s,) for s in strings], "s string").select("s", F.expr(capless("s", "3.4D")).alias("h"))
    for r in df.collect():
        ends = [i for i in range(20, len(r.s) + 1) if entropy_of(r.s[i - 20 : i]) >= 3.4]
        assert (r.h.first, r.h.last) == ((ends[0], ends[-1]) if ends else (0, 0))


def capless(column, least):
    from tracklore.llm.secrets import entropy_hits

    return entropy_hits(column, least)


def entropy_of(s):
    p = np.array([s.count(c) for c in set(s)]) / len(s)
    return float(-(p * np.log2(p)).sum())


def test_near_duplicates(docs, none):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, t in DOCS:
        w = WORD.findall((t or "").translate(fold))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = by_id(minhash.near_duplicates(docs.withColumn("bands", F.lit(0))))
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
    assert minhash.near_duplicates(none).count() == 0


def test_rows_with_null_or_repeated_ids(spark):
    text = prose(random.Random(1), 60)
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (7, text), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (4, 4, True), (4, 4, True), (7, 4, False)]
    removed = sorted((r.doc_id or -1, r.n_removed) for r in superkmer.remove_repeats(df).collect())
    assert removed == [(-1, 0), (-1, 0), (4, 0), (4, 0), (7, 60)]
    lines = sorted((r.doc_id or -1, r.n_lines_removed) for r in linededup.dedup_lines(df).collect())
    assert lines == [(-1, 0), (-1, 0), (4, 0), (4, 0), (7, 1)]


def test_signatures_borrow_alike():
    rng = np.random.default_rng(1)
    same = []
    for _ in range(60):
        values = np.sort(rng.integers(0, 2**64, 4, dtype=np.uint64))
        same.append((minhash.signature(values) == minhash.signature(values[:3])).mean())
    assert 0.65 < np.mean(same) < 0.85
    assert (minhash.band_keys(values) == minhash.band_keys(values.copy())).all()


def brute_repeats(docs):
    seen, out = set(), {}
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if (key := tuple(w[i : i + 20])) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("share", [1 / 2000, 2.0, 1e-9])
def test_substrings(docs, none, monkeypatch, share):
    monkeypatch.setattr(superkmer, "HOT_SHARE", share)
    got = by_id(superkmer.remove_repeats(docs))
    assert {d: (r.n_words, r.n_removed, r.kept_text) for d, r in got.items()} == brute_repeats(DOCS)
    assert superkmer.remove_repeats(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, size=128).collect()
    for d, t in DOCS:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *itertools.accumulate(r.length for r in mine)][:-1]
        assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
        assert {r.doc_tokens for r in mine} == {len(ids)}
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n == 128 or n & (n - 1) == 0 for n in sequences.values())
    assert packing.pack(none, path).count() == 0


def test_packer_minimises_the_sum_of_squares():
    packer = packing.Packer(10, 0)
    for n in (4, 4, 6):  # a second window of 4 would cost 3 more, one of 8 instead none
        packer.add(packing.Piece(0, 0, n, np.zeros(n, np.int32)))
    assert packer.level[8] == packer.level[6] == 1 and not packer.take()
    packer.add(packing.Piece(0, 0, 2, np.zeros(2, np.int32)))
    assert [r[2] for r in packer.take()] == [4, 4, 2]
    packer.finish()
    assert [(r[2], zlib.crc32(r[-1])) for r in packer.take()] == [(k, zlib.crc32(np.zeros(k, "<u4").tobytes())) for k in (4, 2)]


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = quality.fit(docs, labels)
    assert (quality.fit(docs, labels) == weights).all()
    scored = quality.score(docs.withColumn("quality_score", F.lit(9)), weights)
    held = scored.join(labels, "doc_id").where(quality.held_out("doc_id")).collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in held]) > 0.95
    # Labels of the held-out third are not used.
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, flipped) == weights).all()


def test_quality_of_odd_texts(spark, none):
    weights = quality.fit(none, none.select("doc_id", F.lit(1).alias("quality")))
    assert not weights.any()
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 100_000)], "doc_id long, text string")
    assert [r.quality_score for r in quality.score(odd, weights).collect()] == [0.5, 0.5, 0.5]
    assert quality.score(none, weights).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x[:20] + 0.02 * rng.standard_normal((20, 64))
    rows = [*x.tolist(), *near.tolist(), x[0].tolist(), x[0].tolist(), (3 * x[1]).tolist()]
    odd = [None, [], [0.0] * 64, [None, *[1.0] * 63], [float("nan")] * 64, [float("inf")] * 64, [1.0] * 63]
    return list(enumerate(rows + odd))


def test_near_vectors(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("size", F.lit("x"))
    sound = {k: np.array(v) for k, v in rows if v and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {(a, b) for a, b in itertools.combinations(sound, 2) if sound[a] @ sound[b] / np.linalg.norm(sound[a]) / np.linalg.norm(sound[b]) >= 0.95}
    for chunk in (2048, 1):
        monkeypatch.setattr(capfilter, "CHUNK", chunk)
        got = by_id(capfilter.near_vectors(df, 64), "vec_id")
        assert {k: got[k].n_links for k, _ in rows} == {k: sum(k in pair for pair in links) for k, _ in rows}
        for a, b in links:
            assert got[a].component_id == got[b].component_id <= a
    assert capfilter.near_vectors(df.where("vec_id < 0"), 64).count() == 0


def test_cap_filters_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    words, height = capfilter.codes(64), capfilter.cap_height(64)
    x, y = capfilter.filters_of(a, words, height), capfilter.filters_of(b, words, height)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(x, y, strict=True)]) > 0.97


def test_top_k(spark):
    rows = vectors()
    floor = F.transform("embedding", lambda v: F.floor(256 * v).cast("long"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    df = df.withColumn("vector", F.when(sound, floor))
    good = {k: np.floor(256 * np.array(v)).astype(int) for k, v in rows if v and len(v) == 64 and None not in v and np.isfinite(v).all()}
    want = []
    for q in (k for k in good if k % 10 == 0):
        best = sorted((-int(good[q] @ v), k) for k, v in good.items() if k != q)[:5]
        want += [(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)]
    got = top_k(df, F.col("vec_id") % 10 == 0, 5, 64).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == want
    few = df.where("vec_id in (0, 1, 20)")
    assert top_k(few, F.col("vec_id") % 10 == 0, 5, 64).count() == 4
    assert top_k(df.where("vec_id < 0"), F.col("vec_id") % 10 == 0, 5, 64).count() == 0


def test_lines(spark, none):
    rng = random.Random(9)
    line = prose(rng, 30)
    texts = [
        f"{line}\nshort\n{line}", f"{line.upper()}!\nshort", line.replace("alpha", "alpho", 1) + "\n" + prose(rng, 30), None, "", "\n\n", "one two three four", "one two three four", "w " * 70_000, "w " * 70_000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    got = by_id(linededup.dedup_lines(df))
    assert got[0].text == f"{line}\nshort" and (got[0].n_lines, got[0].n_lines_removed) == (3, 1)
    assert got[1].text == "short"
    assert got[3].text is None and got[4].text == "" and got[5].text == "\n\n"
    assert got[6].text == got[7].text == "one two three four"
    assert (got[8].n_lines_removed, got[9].n_lines_removed) == (0, 1) and got[9].text == ""
    assert linededup.dedup_lines(none).count() == 0


def test_block_keys_miss_no_close_simhash(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    shared = F.arrays_overlap(linededup._block_keys(F.col("a")), linededup._block_keys(F.col("b")))
    assert df.where(shared).count() == len(rows)


def edits_of(x, y):
    """Edit distance of two lists."""
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def edited(rng, line, n, spread):
    """The line after ``n`` edits at random, or of every fifth word."""
    line = list(line)
    for k in range(n):
        at = (4 + 5 * k) % len(line) if spread else rng.randrange(len(line))
        kind = 0 if spread else rng.randrange(3)
        line[at : at + (kind != 1)] = [] if kind == 2 else [f"new{rng.randrange(10**6)}"]
    return line


def test_lines_link_by_the_edit_rule(spark):
    """Against a brute-force edit join, by length: none missed up to 28 words; above, at the most edits, few."""
    rng = random.Random(12)
    lines, pairs = [], []
    for n in [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 19, 20, 24, 27, 40, 60]:
        for k in range(12):
            base = [f"v{rng.randrange(400)}" for _ in range(n)]
            most = max(n // 5, 1)
            other = edited(rng, base, (1, most, most)[k % 3], k % 3 == 2)
            pairs.append((len(lines), len(lines) + 1))
            lines += [base, other]
    want = {(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 5 * abs(len(lines[a]) - len(lines[b])) <= max(len(lines[a]), len(lines[b])) and min(len(lines[a]), len(lines[b])) >= 5 and 5 * edits_of(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b]))}
    assert len(want & set(pairs)) > 150
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in linededup.dedup_lines(df).where("n_lines_removed > 0").collect()}
    assert gone <= {b for _, b in want}
    missed = [(a, b) for a, b in want if b not in gone]
    assert not [x for x in missed if max(len(lines[k]) for k in x) <= 28]
    assert len(missed) <= 0.02 * len(want)


def test_short_lines(spark):
    chinese = "今天天气很好我们一起去公园散步然后回家吃晚饭看电视"
    texts = ["Home\nMenu | About\n\n", "home!\nUnlike\n\n\n---", f"{chinese}。\nMenu, about", f"{chinese.replace('晚', '午')}\nMenu about us", "---"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(linededup.dedup_lines(df, short_lines=True))
    assert [got[d].text for d in range(5)] == [texts[0], "Unlike\n\n\n---", f"{chinese}。", "Menu about us", "---"]
    assert [r.n_lines_removed for r in linededup.dedup_lines(df).orderBy("doc_id").collect()] == [0] * 5


def test_queries_remove_short_lines(spark, tmp_path):
    import corpus_pipeline
    from tracklore.llm import queries

    df = spark.createDataFrame([(1, "Home\nOne"), (2, "HOME\nTwo")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (queries.op4_lines(spark, str(tmp_path)), corpus_pipeline.drop_lines(spark, df, str(tmp_path))):
        assert {d: r.text for d, r in by_id(out).items()} == {1: "Home\nOne", 2: "Two"}


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(35)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = [docs]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
        if number < 4:
            assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in x.select("doc_id").distinct().collect()} for x in seen]
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4] == ids[5]
    # A near duplicate of the quality stage's documents goes, or keeps only what no other document has.
    before = {r.doc_id: r for r in minhash.near_duplicates(seen[1]).collect()}
    size = [{r.doc_id: len(r.text) for r in x.collect()} for x in seen[1:4]]
    assert 10 < sum(not r.kept for r in before.values()) and ids[1] - ids[2] and min(size[1].values()) > 0
    assert all(2 * size[2].get(d, 0) < size[0][d] for d, r in before.items() if not r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    assert all(labels.get(d, 0) == 0 for d in ids[0] - ids[1] if d in labels)
    final = seen[4].collect()
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r.text) for r in final)
    assert all(r.n_chars == len(r.text) for r in final)
    whole = {r.doc_id: r for r in minhash.near_duplicates(seen[2]).collect()}
    assert ids[3] == {d for d, r in whole.items() if r.kept}
