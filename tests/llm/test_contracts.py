"""All opN_ queries at the smallest size: against SQL, and the columns SQL cannot give against the libraries and loops."""

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_llm import edits_of
from tests.test_queries import rows
from tracklore.llm import queries

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    with duckdb.connect() as db:
        for t in ("documents", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(queries.oracle_sql()[name]).df()
    assert len(want) and rows(queries.queries()[name](spark, SF).toPandas()) == rows(want)


def test_token_query(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(queries.op2_token_counts(spark, SF))
    for d, t in texts.items():
        n = len(model.encode(t))
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(t.encode()), n, n > 4096)


def test_byte_bpe_query(spark, texts):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(queries.op3_byte_bpe(spark, SF))
    for d, t in texts.items():
        ids = library.encode_ordinary(t)
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == want


def test_packing_query(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, fill = {}, {}
    for r in queries.op8_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for d, t in texts.items():
        ids, at = [*library.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in fill.values():
        parts.sort()
        ends = list(itertools.accumulate(n for _, n in parts))
        assert [o for o, _ in parts] == [0, *ends[:-1]]
        assert ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0 and ends[-1] < 2048


def test_quality_query(spark, texts):
    got = by_id(queries.op9_quality(spark, SF))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def brute_quality(texts, labels):
    """The classifier in plain loops over whole texts: n-grams, updates and scores."""
    from tracklore.llm import quality, textblocks

    def hashed(token):
        raw = np.frombuffer(token.encode(), np.uint8)
        return textblocks.slice_hashes(raw, np.array([0]), np.array([len(raw)]))

    def grams(text):
        out, last, shapes, lowered = [], None, [], []
        for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\x20\x09-\x0D]+", text):
            t = m[0]
            low = "".join(c.lower() if c.isascii() else c for c in t)
            code = hashed(low)
            if re.match(r"[0-9A-Za-z\u0080-\U0010ffff]", t):
                upper, size = sum("A" <= c <= "Z" for c in t), len(t.encode())
                kind = 1 if re.search("[0-9]", t) else 2 if upper > 1 and 2 * upper > size else 3 if upper else 4
                shape = np.array([kind], np.uint64)
            else:
                shape = code
            shapes.append(textblocks.mix(shape * np.uint64(2) + np.uint64(low == last)))
            lowered.append(code)
            last = low
        token, shape = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (lowered, shapes))
        for g in (textblocks.mix(token), textblocks.combine(token, 2), textblocks.mix(shape + np.uint64(7)), textblocks.combine(shape, 2) ^ np.uint64(1), textblocks.combine(shape, 3)):
            out += (g >> np.uint64(64 - quality.BITS)).tolist()
        return out

    z, n = {}, {}
    bias = 1 << quality.BITS

    def weight(i):
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= 0.01 else -np.sign(x) * (abs(x) - 0.01) / ((1.0 + np.sqrt(n.get(i, 0.0))) / 0.5 + 0.1)

    def vector(text):
        found = grams(text)
        x = {i: 10 * found.count(i) / len(found) for i in set(found)}
        x[bias] = 1.0
        return x

    def chance(x):
        return 1 / (1 + np.exp(-np.clip(sum(weight(i) * v for i, v in x.items()), -35, 35)))

    rows_ = [(vector(texts[d]), y) for d, y in labels]
    share = np.mean([y for _, y in labels])
    for _ in range(4):
        for x, y in rows_:
            error = (chance(x) - y) * 0.5 / (share if y else 1 - share)
            w = {i: weight(i) for i in x}
            for i, v in x.items():
                g = error * v
                rate = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / 0.5
                z[i] = z.get(i, 0.0) + g - rate * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {d: float(chance(vector(t))) for d, t in texts.items()}


def test_quality_query_against_loops(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = {0: "Good plain words, that end.", 3: "BUY NOW!!! 99 cheap cheap cheap", 5: "", 6: "A second good line of words.", 7: "WIN 100 $$$ now now NOW", 8: "ünï good çode", 9: "words 12 and, so on"}
    labels = [(0, 1), (3, 0), (6, 1), (7, 0), (9, 1)]
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    known = spark.createDataFrame([(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1], "k long, y int")
    order = [(r.k, r.y) for r in known.orderBy(F.xxhash64("k"), "k").collect()]
    want = brute_quality(texts, order)
    got = {r.doc_id: r.score for r in queries.op9_quality(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in want) < 1e-4


def test_lines_query_against_loops(spark, tmp_path):
    """Every pair of lines by the edit rule, groups by union, and the texts that are left."""
    import random

    rng = random.Random(21)
    lines = [[f"v{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 10, 15, 20, 25]))] for _ in range(50)]
    for line in list(lines):
        for _ in range(rng.randrange(3)):
            other = list(line)
            for _ in range(rng.randrange(1 + len(line) // 4)):
                other[rng.randrange(len(other))] = f"new{rng.randrange(9)}"
            lines.append(other)
    rng.shuffle(lines)
    docs, at = [], 0
    while at < len(lines):
        n = rng.randrange(1, 6)
        docs.append((len(docs), "\n".join(rng.choice([" ", ", "]).join(x).capitalize() for x in lines[at : at + n]) + rng.choice(["", "\n", "\n--"])))
        at += n
    docs += [(len(docs), None), (len(docs) + 1, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    places = [(d, i, re.findall(r"[a-z0-9]+", x.lower())) for d, t in docs for i, x in enumerate((t or "").split("\n"))]
    places = [p for p in places if p[2]]
    parent = list(range(len(places)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(places)), 2):
        x, y = places[a][2], places[b][2]
        if x == y or min(len(x), len(y)) >= 5 and 5 * edits_of(x, y) <= max(len(x), len(y)):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    gone = {(d, i) for k, (d, i, _) in enumerate(places) if root(k) != k}
    assert 20 < len(gone) < len(places)
    got = by_id(queries.op4_lines(spark, str(tmp_path)))
    for d, t in docs:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        assert (got[d].text, got[d].n_lines_removed) == (kept, sum(x == d for x, _ in gone)), d
