"""Registered queries of the dealt operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import chat_format, collocations, decontam, html_text, language_id, license_scan, mtree, ngram_join, packing, periodic_runs, sharding, store, substring_dedup, warc


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_language_id(spark, sf_dir):
    """Predicted language of every document, learned from those that are not held out."""
    return language_id.report(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    """License notices in every document."""
    return license_scan.notices(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_chat_rotation(spark, sf_dir):
    """Every conversation from the perspective of each participant."""
    return chat_format.rotated(table(spark, sf_dir, "conversations"))


def op5_substring_dedup(spark, sf_dir):
    """Documents without the words of 20-word windows that start earlier elsewhere."""
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark, sf_dir):
    """Words of documents inside shared ten-word windows of benchmark items."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark, sf_dir):
    """Pages written as WARC records and read back."""
    path = store.shared_folder(spark)
    warc.archive(spark, table(spark, sf_dir, "pages"), path)
    return warc.page_report(spark, path)


def op8_packing(spark, sf_dir):
    """Documents as token pieces in windows of 1024."""
    return packing.pack_digest(table(spark, sf_dir, "documents"), byte_tokenizer())


def op9_ngram_jaccard(spark, sf_dir):
    """Components of documents linked by 3-word shingle Jaccard of 0.9 or more."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark, sf_dir):
    """Five best inner products for every fiftieth vector."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_collocations(spark, sf_dir):
    """The 2000 phrases of each language whose words keep company most."""
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    """Runs of repeated word blocks in every document, and what is left without them."""
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def op13_sharding(spark, sf_dir):
    """Documents in sixteen shards of near equal bytes."""
    return sharding.digests(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_language_id, op2_license_scan, op3_html_extraction, op4_chat_rotation, op5_substring_dedup,
    op6_benchmark_decontamination, op7_warc, op8_packing, op9_ngram_jaccard, op10_exact_top_k,
    op11_collocations, op12_periodic_runs, op13_sharding,
)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op4_chat_rotation": chat_format.ROTATED_SQL, "op11_collocations": collocations.PHRASES_SQL, "op13_sharding": sharding.DIGESTS_SQL}
