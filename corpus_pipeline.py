"""Corpus pipeline: from raw documents to a mixed, deduplicated training set.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm import decontaminate, line_mph, poisson_mix, simhash_trie, zstd_langid
from trestle.llm.common import fold, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters, or no clear margin) go."""
    return zstd_langid.keep_identified(docs, zstd_langid.learn(docs.where(fold(F.col("doc_id"), 4) != 2)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that 5 documents hold stay in one of them; n_chars follows the text."""
    original = docs.columns
    keyed = docs.withColumnsRenamed({c: f"__in_{i}" for i, c in enumerate(original)})
    at = {c: f"__in_{i}" for i, c in enumerate(original)}
    kept = line_mph.dedup_lines(keyed, min_chars=40, min_docs=5, id_col=at["doc_id"], text_col=at["text"])
    changed = F.col("n_dropped") > 0
    new = {
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col(at["text"])),
        "n_chars": F.when(changed, F.char_length("kept_text")).otherwise(F.col(at.get("n_chars", at["text"]))),
    }
    kinds = dict(docs.dtypes)
    return kept.select(*[new.get(c, F.col(at[c])).cast(kinds[c]).alias(c) for c in original])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id."""
    return simhash_trie.keep_one(docs, shingle=3, max_bits=3)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 10 consecutive words of a benchmark item go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"), n=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by the square root of their counts, repeated at random, in a global random order."""
    return poisson_mix.mix(docs, poisson_mix.tempered_rates(docs, exponent=0.5))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", remove_benchmarks),
    ("source_mixing", mix_sources),
]

#: Compression, SimHash components and the rest can't be put in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
