"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogable.llm.html import extract_html
from heliogable.llm.jaccard import jaccard_join
from heliogable.llm.mixing import mix
from heliogable.llm.neighbours import nearest
from heliogable.llm.oracles import ORACLES as ORACLES
from heliogable.llm.pieces import encode_pieces
from heliogable.llm.quality import quality
from heliogable.llm.substring import substring_dedup
from heliogable.llm.tokenfile import read_tokens, write_tokens
from heliogable.llm.toxicity import fit, held_out, score
from heliogable.llm.warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(_table(spark, sf_dir, "pages"))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")), digest=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality(_table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_warc(write_warc(_table(spark, sf_dir, "pages")), with_payload=False)
    return df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mix(_table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_token_binary": op2_token_binary,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_neighbours": op8_neighbours,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
}
