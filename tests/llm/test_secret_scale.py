"""Secrets in long texts, in time in proportion to their length, and beside columns of any name."""

import random
import re
import time

from pyspark.sql import functions as F

from tests.llm.test_llm import prose
from tracklore.llm.secrets import find_secrets, redact

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = [(ASSIGN, 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]


def base(text):
    return sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(RULES) for m in re.finditer(p, text) if len(m[g]) >= least)


def test_many_matches_and_odd_runs(spark):
    rng = random.Random(4)
    some = ["token=ab", "token=abcdef", "face", "dead" * 7, "AKIA" * 3, "AKIAAKIA" + "Z9" * 8, "xAKIA" + "B" * 15, "é🙂", "secret:", "key", "0" * 23, "0" * 24 + "G"]
    texts = [rng.choice(["", " ", "="]).join(rng.choice(some) for _ in range(n)) for n in (1, 5, 255, 256, 257, 1500) for _ in range(3)]
    got = find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.start, s.kind_no, s.end) for s in r.secrets if s.kind_no < 3] for r in got} == {d: base(t) for d, t in enumerate(texts)}


def test_long_prose_takes_little_time(spark):
    rng = random.Random(5)
    text = prose(rng, 33_000) + " " + "0123456789abcdef" * 2
    assert len(text) > 200_000
    found = find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("secrets").alias("n"))
    assert found.first().n == 1
    began = time.perf_counter()
    assert found.first().n == 1
    assert time.perf_counter() - began < 1.5


def test_columns_of_the_operators_own_names_pass_through(spark):
    df = spark.createDataFrame([(1, "password=abc123def x", "a", "b", "c")], "doc_id long, text string, base string, found string, hits string")
    df = df.withColumn("_base", F.lit(7))
    out = redact(find_secrets(df))
    assert set(out.columns) == {*df.columns, "secrets"}
    row = out.first()
    assert (row.text, row.base, row.found, row.hits, row._base) == ("[SECRET] x", "a", "b", "c", 7)
    assert find_secrets(df.union(df)).count() == 2


def test_an_allowed_piece_counts_only_in_the_span(spark):
    key = "kJ8s0Qz7Lm3Xv9Rt2Wp5Yb1N"
    texts = [key, key[:10] + "Example" + key[10:], "a" * 60 + key, "www" + "a" * 40 + key]
    got = find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [bool(r.secrets) for r in got] == [True, False, True, True]


def test_redaction_in_time_with_the_text(spark):
    """Spans of several kinds that overlap or touch, in long texts, against a loop; a byte order mark stays."""
    rng = random.Random(9)
    some = ["token=abcdef", "dead" * 7, "AKIA" + "B" * 17, "\ufeff", "é🙂", " ", "password=" + "0" * 30, "kJ8s0Qz7Lm3Xv9Rt2Wp5Yb1N", "plain"]
    texts = [rng.choice(["", " "]).join(rng.choice(some) for _ in range(n)) for n in (1, 3, 40, 600)]
    texts += [" ".join(["token=abcdef"] * 8000), "\ufeff token=abcdef\ufeff", None, "none"]
    found = find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    got = {r.doc_id: r.text for r in redact(found, mark="<'\\>").collect()}
    for r in found.collect():
        out, at = "", 0
        for s in r.secrets:
            if s.start >= at:
                out += r.text[at : s.start] + "<'\\>"
            at = max(at, s.end)
        assert got[r.doc_id] == (out + r.text[at:] if r.secrets else r.text)
    began = time.perf_counter()
    redact(found).agg(F.sum(F.length("text"))).collect()
    assert time.perf_counter() - began < 3
