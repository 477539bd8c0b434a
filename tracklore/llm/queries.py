"""Queries over the given tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import oracle_sql as oracle_sql

#: The largest input, in tokens, of the model that texts are counted for.
TOKEN_LIMIT = 4096
#: Components of the given embeddings.
DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import RULES, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind_no"] == k)).cast("long")
    named = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("secrets", lambda s: s["kind_no"] < len(RULES))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(RULES)),
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("secrets")).alias("spans"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bytebpe import decode, encode

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = decode(encoded, ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
    return docs.select("doc_id", "n_lines", "n_lines_removed", "text")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .capfilter import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), DIMENSIONS)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .superkmer import remove_repeats

    removed = remove_repeats(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.when(sound, F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))
    return top_k(vectors.withColumn("vector", whole), F.col("vec_id") % 50 == 0, 5, DIMENSIONS)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damage, repair

    rows = table(spark, sf_dir, "conversations")
    found = repair(damage(rows)).withColumnRenamed("conv_id", "repaired_id")
    all_ids = rows.select("conv_id").distinct()
    out = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align_tokens

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .idfile import read_ids, token_ids, write_ids
    from .runtime import shared_folder

    path = shared_folder(spark, "token-ids")
    write_ids(token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_token_counts": op2_token_counts,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_lines": op4_lines,
        "op5_minhash": op5_minhash,
        "op6_embeddings": op6_embeddings,
        "op7_substrings": op7_substrings,
        "op8_packing": op8_packing,
        "op9_quality": op9_quality,
        "op10_topk": op10_topk,
        "op11_repair": op11_repair,
        "op12_alignment": op12_alignment,
        "op13_token_ids": op13_token_ids,
    }
