"""Training-data pipeline: quality, toxicity, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs. The two classifiers are fitted on the labelled documents
among their input.

Cases: see the operators. A document that has no other source of a decision stays. Documents with null or repeated ids
are judged row by row; of equal rows the near-duplicate stage keeps one. An empty table gives empty results.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers

from webmill.llm import minhash_dedup, packing, quality, toxicity
from webmill.llm.texts import stored


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark, docs, sf_dir):
    """Without the documents that the quality classifier rejects."""
    return quality.accepted(docs, quality.train(docs, labels(spark, sf_dir)))


def toxicity_stage(spark, docs, sf_dir):
    """Without the documents that the toxicity classifier rejects."""
    return toxicity.without_toxic(docs, toxicity.train(docs, labels(spark, sf_dir)))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.without_duplicates(docs)


def packing_stage(spark, docs, sf_dir):
    """The pieces of all documents with their place in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]
#: Two stages fit classifiers, which SQL can't express; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
