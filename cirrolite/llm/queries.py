"""The registered query of each operator: the whole table, production parameters, the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chat import format_conversations, read_conversations
from .common import shared_dir, table
from .contamination import contamination
from .embedding_dedup import near_links
from .ngram_join import ngram_components
from .packing import pack, token_pieces
from .passages import cut_passages
from .periodic_runs import periodic_runs
from .quality import fit_quality, quality_scores
from .spelling import spelling_variants, varied_words
from .warc import read_archive, write_archive
from .suffix_dedup import remove_repeats
from .top_k import top_k
from .url_filters import url_verdicts

#: Fixed values of the contract: (host, path, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("select * from values " + ", ".join(map(str, URL_RULES)) + " as r(host, path, action)")
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"'\\### Assistant: </turn> ok'"
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) as c(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # rows by turn: each turn answers the row before it; rows with equal turns go by role and text
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    chain = rows.withColumn("node", F.row_number().over(order)).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
    chain = chain.withColumn("score", F.lit(0.0))
    back = read_conversations(format_conversations(chain, tree="conv_id"))
    said_all = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit_quality(labels.select("doc_id", "quality").filter(~held), docs)
    scores = quality_scores(docs, model)
    return scores.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_tokens")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.size("removed_spans").cast("bigint").alias("n_spans"), "removed_spans", F.sha2("text", 256).alias("kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_links(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    back = read_archive(spark, path, payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # of one document in ten, the words from a on repeat with period p
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("bigint"))
    g = F.expr("h div 10")
    docs = docs.withColumn("a", g % F.col("n")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    planted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    docs = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(docs)
    better = lambda r, best: r.length * best.period > best.length * r.period
    best = F.aggregate("runs", F.element_at("runs", 1), lambda b, r: F.when(better(r, b), r).otherwise(b))
    line = lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(varied_words(table(spark, sf_dir, "documents")))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_classifier, op3_benchmark_decontamination, op4_url_filters, op5_ngram_join, op6_packing, op7_chat_formatting, op8_substring_dedup, op9_embedding_dedup, op10_warc, op11_periodic_runs, op12_spelling_variants, op13_top_k)}
