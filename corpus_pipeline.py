"""A training corpus from ``documents``: five stages, each over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last keep
the columns of ``documents``. ``run`` writes each stage's result to the shared folder and
rereads it, as a scheduler of single jobs would.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _common, decontaminate, mixing, simhash, token_output, toxicity
from tessera.llm.queries import held_out


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; held-out labels stay unseen."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: texts
    whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 3, 1, 2, 150 % of all words."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, max_repeat=2)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, read back: (doc_id, start, n_tokens, ids_crc32)."""
    path = token_output.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_output.checksums(token_output.read(spark, path))


STAGES = [("toxicity", reject_toxic), ("simhash near-dedup", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("mixing sources", mix_sources), ("token-ID output", encode_tokens)]

#: A classifier, fingerprints of UTF-8 hashes, a knapsack and a tokenizer: no SQL for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _common.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
