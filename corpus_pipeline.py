"""A training corpus from raw documents: quality, near-duplicates, repeated passages, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Each decides by row: rows
that share a doc_id, or have none, are judged by their own texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrolite.llm.common import small, table, without, written
from cirrolite.llm.contamination import keep_clean
from cirrolite.llm.ngram_join import ngram_components
from cirrolite.llm.packing import pack, token_pieces
from cirrolite.llm.passages import cut_passages
from cirrolite.llm.quality import fit_quality, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels that are not held out; too few of them are an error."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held)
    return keep_good(docs, fit_quality(labels, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, one without id only if none has an id; of rows that repeat id and text, one.

    A row is named by a 64-bit hash of its id and text: rows that share an id, or have none, are judged by their own texts.
    """
    own = "row"
    while own in docs.columns:
        own += "_"
    named = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    found = ngram_components(named, id=own).groupBy(own, "component_id").agg(F.count("*").alias("n"))
    found = written(found.join(named.select(own, "doc_id").distinct(), own))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", own)).getField(own).alias("first"), F.count("*").alias("rows"))
    gone = found.join(small(written(first.filter("rows > 1").select("component_id", "first"))), "component_id").filter(F.col(own) != F.col("first"))
    kept = without(named, gone, own)
    repeated = written(found.filter("n > 1").select(own))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(small(repeated), own, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(repeated), own, "left_anti").unionByName(once).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from the later one; n_chars follows."""
    cut = cut_passages(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least one in twenty lies in benchmark windows go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("n-gram join", near_duplicates), ("substring dedup", repeated_passages), ("decontamination", decontaminate), ("packing", packing)]

#: The stages learn, hash and pack: SQL cannot express them. tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
