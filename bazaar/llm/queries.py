"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm import align, bpe, decontaminate, exact, html_text, licences, quality, simhash, spans, toxicity, trie, warc, winnow
from bazaar.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(licences.paths_of(table(spark, sf_dir, "documents"))).withColumnRenamed("row", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op5_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.digest(F.col("chosen")).alias("fingerprint"), winnow.digest(F.col("edited_chosen")).alias("edited_fingerprint"),
        "near_edited", "near_next")


def op6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repeats(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("simhash").alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(texts, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"), every_digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.link_counts(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.branched(table(spark, sf_dir, "conversations"))).nodes.drop("node")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (
        op1_html_text, op2_licences, op3_toxicity, op4_decontamination, op5_winnow, op6_spans, op7_quality, op8_simhash, op9_warc,
        op10_bpe, op11_exact_dedup,
        op12_alignment, op13_prefix_trie, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": warc.ORACLE_SQL, "op11_exact_dedup": exact.ORACLE_SQL, "op13_prefix_trie": trie.ORACLE_SQL}
