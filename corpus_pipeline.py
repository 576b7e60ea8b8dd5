"""The corpus pipeline: five stages over documents, each with an operator of gridlake.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next. All but the last return the columns of
documents. Nulls: a null text is rejected by the first stage; a null language
or source stays null or is filled in by the first stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import decontam, langid, pii, similar, tokens
from gridlake.llm.run import checkpoint_dir, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of ENOUGH characters whose best cosine is below UNLIKE is in none of the languages.
UNLIKE, ENOUGH = 0.2, 200


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, with that as their lang; the others go.

    Rejected are texts without any letter (null and empty ones among them) and
    texts of some length that are like none of the languages of docs.
    """
    found = langid.predict(docs.select(*COLUMNS), langid.train(docs))
    known = (F.col("lang_pred") != "und") & ((F.col("score") >= UNLIKE) | (F.length("text") < ENOUGH))
    return found.where(known).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (null last); of repeated rows one.

    Near duplicates share at least 0.8 of their five-word shingles (Jaccard), or are joined by others that do.
    Rows are known by id and text, so different texts under one id, or without one, stand for themselves.
    """
    found = similar.near_duplicates(docs).groupBy("root", "id", "fp").agg(F.count("*").alias("rows"))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "rows")
    kept = found.groupBy("root").agg(F.min(row).alias("x")).select("x.*")
    keyed = docs.withColumn("fp", F.xxhash64("text"))
    same = lambda k: keyed["doc_id"].eqNullSafe(k["id"]) & (keyed["fp"] == k["fp"])
    one, more = kept.where("rows = 1"), kept.where("rows > 1")
    once = keyed.join(one, same(one), "left_semi").select(*COLUMNS)
    again = keyed.join(more, same(more), "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)
    return once.unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; one of which no word is left goes."""
    found = decontam.find(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    left = (F.size("hit_spans") == 0) | (hit < F.col("hit_words"))
    return _columns(decontam.remove(found.where(left)))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind in brackets."""
    return _columns(pii.redact(pii.find(docs.select(*COLUMNS), pii.train(docs))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text's bytes."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = tokens.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern, round_trip="round_trip")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("encode", encode),
]

#: Trained models, codes and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's rows are deleted once the next one's are written."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if i:
                remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
