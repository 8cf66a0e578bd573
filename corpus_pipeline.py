"""Documents to packed training windows, as stages over written tables.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last returns packed pieces.  Between stages `run` writes a
Parquet table into the session's shared folder and reads it again, so a lost
executor never reaches back further than one stage.
"""

from __future__ import annotations

from tidemark.llm import decontam, language_id, ngram_join, packing, registry, store, substring_dedup


def language(spark, docs, sf_dir):
    """Documents without a letter or with a language known by less than even odds go."""
    return language_id.accepted(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def repeated_passages(spark, docs, sf_dir):
    """Words of 20-word windows that start earlier in the corpus are cut out."""
    return substring_dedup.clean(docs)


def benchmark_passages(spark, docs, sf_dir):
    """Documents that share a ten-word window with the benchmark go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark, docs, sf_dir):
    """Token pieces in windows of 1024."""
    return packing.pack_digest(docs, registry.byte_tokenizer())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]

# Learned languages, similarity groups and token ids are beyond SQL; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
