"""A corpus pipeline: language, near-duplicates, repeats, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and
read again as the next stage's documents. All stages but the last return the
columns of documents. Null texts are as empty ones; documents with a null id go
through no comparison and stay; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm import decontaminate, jaccard_join, language_id, sentencepiece, suffix_dedup
from siftgrain.llm.pieces import Pieces
from siftgrain.llm.store import without_ids, write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text with so many n-grams of which less than the share stands in a text of a learned language is of none of them. (In labelled documents the least share is 0.84.)
LEAST_GRAMS, LEAST_SHARE = 8, 0.5
#: The public vocabulary of the last stage.
TOKENIZER = "piece_bpe_32k.model"


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names, with the predicted one as lang.

    Texts that are null or have no letter go, and texts whose n-grams speak against all of the languages; a short text, with
    little to speak for or against one, stays. Without labelled documents all go. Repeated rows, and rows with a null id, are
    judged like any other; of equal scores the language that sorts first is taken.
    """
    key = F.struct("doc_id", "source", "n_chars").alias("key")
    predicted = language_id.predict(docs.select(key, "text"), language_id.learned(docs), "key", keep_text=True)
    foreign = (F.col("n_grams") >= LEAST_GRAMS) & (F.col("n_known") < LEAST_SHARE * F.col("n_grams"))
    kept = predicted.filter((F.col("lang_pred") != language_id.UNKNOWN) & ~foreign)
    return kept.select("key.doc_id", "text", F.col("lang_pred").alias("lang"), "key.source", "key.n_chars")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates.

    Rows of one id and different texts are documents of their own; of one id and text one row stays (of its other columns
    any). Null and empty texts are like nothing and stay, and so do all rows with a null id.
    """
    groups = jaccard_join.similar_groups(docs, by_row=True)
    key = F.struct("doc_id", "digest").alias("row_key")
    keyed = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("row_key"))
    kept = without_ids(keyed, groups.filter("NOT first").select(key), "row_key")
    repeated = groups.filter("doc_id IS NOT NULL").select(key).groupBy("row_key").count().filter("count > 1").select("row_key")
    if repeated.limit(1).count():
        several = kept.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"])
        kept = without_ids(kept, repeated, "row_key").unionByName(several)
    return kept.select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of documents with a smaller id; documents of which nothing is left go.

    Null texts become empty ones, and these stay. Rows of one id don't count as earlier than each other, so they keep what
    they share; rows with a null id are kept whole.
    """
    text = F.col("kept").cast("string")
    left = (F.col("n_bytes") == 0) | text.rlike(r"\S")
    result = lambda out: out.filter(left).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))
    return suffix_dedup.remove_repeats(docs, carry=("lang", "source"), whole_chars=True, derive=result)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Each row is judged by its own text, rows with a null id and of one id alike; null and empty texts hold nothing and stay.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_row=True)
    gone = found.filter("contaminated").select(F.struct("doc_id", "digest").alias("row_key"))
    keyed = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("row_key"))
    return without_ids(keyed, gone, "row_key").select(*COLUMNS)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, how many they are, and the text that they decode to.

    Null and empty texts have no ids and decode to an empty text; every row, repeated or with a null id, gives a row.
    """
    pieces = Pieces.read(public_tokenizers.path(TOKENIZER))
    key = F.struct("doc_id", "lang", "source").alias("key")
    encoded = sentencepiece.encode(docs.select(key, "text"), pieces, "key", decoded=True)
    return encoded.select("key.doc_id", "key.lang", "key.source", F.col("decoded").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", by_language),
    ("n-gram Jaccard join", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece", as_tokens),
]
#: Kernel predictions can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = write_table(docs, "stage")
    return docs
