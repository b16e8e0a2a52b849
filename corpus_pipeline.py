"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next one's `docs`. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from barflow.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from barflow.llm.common import load
from barflow.session import checkpoint_dir, ship


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity classifier rejects by their language's threshold go; the labels are those of sf_dir."""
    ship(spark)
    model = toxicity.fit(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each class of linked documents stays: the one with the smallest id, and of repeated rows one."""
    ship(spark)
    return jaccard_join.one_of_each(docs)


def mask_secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark; all documents stay."""
    ship(spark)
    return secret_scan.redact(docs, secret_scan.train())


def mix_sources(spark, docs, sf_dir):
    """Every document as often as the mix takes it: none, once or twice."""
    ship(spark)
    return mixing.apply(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of at most 1024 tokens and the sequences they are packed into; copies of a document are packed each."""
    ship(spark)
    return packing.sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: a trained classifier, an iterative join and a bin packing cannot be put into SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
