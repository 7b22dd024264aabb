"""A training corpus from ``documents``: five stages, each over all that the stage before kept.

1. toxicity: documents scored 0.5 or more go;
2. near duplicates: of each group linked at five-word Jaccard 0.8, the smallest doc_id stays;
3. repeated passages: words that an earlier document's 13-word passages cover go, n_chars follows the text;
4. mixing: documents are taken as often as their source's target weight says, rows repeat;
5. SentencePiece: the ids of each document (the result: doc_id, lang, source, ids, n_pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogable.llm import store
from heliogable.llm.jaccard import jaccard_join
from heliogable.llm.mixing import mix
from heliogable.llm.pieces import encode_pieces
from heliogable.llm.substring import substring_dedup
from heliogable.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, carry=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are compared by a key of their own, so ids may repeat; of a group the row of the smallest doc_id stays, of several the first by a hash of the row.

    Rows with a null doc_id stand for themselves and stay.
    """
    place = store.folder(spark, "near")
    keyed = store.keep(docs.select(*COLUMNS).withColumns({"row": F.monotonically_increasing_id(), "mark": F.xxhash64(*COLUMNS)}), f"{place}/rows")
    found = jaccard_join(keyed.filter("doc_id is not null"), id_col="row").filter("links > 0").select(F.col("doc_id").alias("row"), "class_id")
    linked = store.keep(found.join(keyed.select("row", "doc_id", "mark"), "row"), f"{place}/linked")
    first = linked.groupBy("class_id").agg(F.min(F.struct("doc_id", "mark", "row")).alias("first")).select("first.row")
    gone = linked.select("row").join(first, "row", "left_anti")
    return keyed.join(gone, "row", "left_anti").select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = substring_dedup(docs.select("doc_id", "text", "lang", "source"), carry=["lang", "source"])
    return done.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition, of rows with a null or repeated doc_id too.  Documents without words weigh nothing and fall out."""
    taken = mix(docs, carry=COLUMNS[1:]).filter("taken > 0")
    return taken.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=["lang", "source"], checked=False)
    return done.select("doc_id", "lang", "source", "ids", "n_pieces")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", drop_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Toxicity is a fitted model, and pieces are no SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    place, docs = store.folder(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), f"{place}/{name}")
    return docs
