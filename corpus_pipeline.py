"""The corpus pipeline: every stage is written as Parquet and read again as the next one's documents."""

from motifspark.llm import fm_decontaminate, language_id, ngram_jaccard, secret_scan, sentencepiece_array
from motifspark.llm.text import read
from motifspark.session import materialize


def known_language(spark, docs, sf_dir):
    """Documents whose language is known; those without letters or of no likely language go."""
    return language_id.keep_known(docs)


def one_of_each_group(spark, docs, sf_dir):
    """One document of each group of linked documents, the one with the smallest doc_id."""
    return ngram_jaccard.keep_one(docs)


def without_benchmark(spark, docs, sf_dir):
    """Benchmark passages are cut out of the texts; documents that are nothing else go."""
    return fm_decontaminate.removed(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark."""
    return secret_scan.masked(docs, secret_scan.train(docs))


def encoded(spark, docs, sf_dir):
    """Pieces of every document, with what identifies it."""
    return sentencepiece_array.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL expresses neither the models nor the encoder; tests compare `run` with a version by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
