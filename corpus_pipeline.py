"""Documents to training tokens: five stages, each an operator of tessera.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its
predecessor kept and returns a DataFrame, which is written as Parquet and read as the next one's docs.
All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, jaccard_join, language_id, mixing
from tessera.llm.common import crc_mod, scratch, table, written

#: Good prose is wanted this many times as often as it is found; nothing is cut for that.
BOOST = {"good": 1.2}
#: Near copies share this percentage of their shingles of so many words. op8's own query has 4 words and 85.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go: null and empty texts, texts without a
    letter, and those whose margin is too narrow. Learns from the rows with a language. Repeated rows
    share their fate; without rows, or without languages to learn, nothing stays."""
    known = language_id.learn(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return language_id.identify(docs, known).filter(~F.col("rejected")).select(*docs.columns)


def remove_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that with the smallest id. Null texts count as
    empty ones. Of rows repeated whole one stays."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that similarity links. Null and empty
    texts and null ids link with nothing and stay. Rows that share an id are told apart by their texts."""
    return jaccard_join.one_of_each(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_domains(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at the rates that give domains their target shares of tokens; none is lost. Null texts
    count as empty; without labels or rows every document stays once."""
    fitted = mixing.fit_mix(docs, table(spark, sf_dir, "labels"), mixing.DOMAIN, boost=BOOST, least=1.0, whole_rows=True)
    return fitted.repeated()


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them; null and empty texts have none. Rows are independent."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.withColumn("ids", F.when(whole, F.col("ids")).otherwise(F.raise_error(F.lit("decoded bytes differ from the text")).cast("array<int>"))).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", remove_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing to target weights", mix_domains),
    ("byte-level BPE", encode),
]
#: SQL can express neither the classifier nor the mixture; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
