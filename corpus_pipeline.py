"""The corpus pipeline: quality rules, near duplicates, secrets, mixing and tokenizing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of ``documents``, but for the last, which has
(doc_id, ids). ``run`` writes what a stage returns to the shared folder and hands the written table to the next. What a stage
returns is to be written before the next begins: that deletes the tables which those rows were read from. Stages lower the
session's Arrow batches to ``ROWS`` rows, also for that write; ``run`` puts the setting back at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskstream.llm import mixing, partenum, pieces, quality, secrets
from riskstream.llm.common import discard, documents, fewer_rows, materialize, small_batches
from riskstream.llm.queries import vocabulary


#: Rows that go to a Python worker at once: a larger batch of texts is held by the JVM and by the worker, several times over, and
#: neither returns all of it.
ROWS = 1000

#: Tables that the rows of a stage are read from while they are written, by application.
_held: dict[str, list[DataFrame]] = {}


def _release(spark: SparkSession, docs: DataFrame) -> None:
    """Delete the tables that earlier stages left, but for those that ``docs`` itself still reads."""
    held, read = _held.pop(spark.sparkContext.applicationId, []), None
    for t in held:
        read = docs.inputFiles() if read is None else read
        if any(f"/{t.materialized_path.split('/')[-1]}/" in f for f in read):
            _held.setdefault(spark.sparkContext.applicationId, []).append(t)
        else:
            discard(t)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or lie outside their language's perplexity band go."""
    fewer_rows(spark, ROWS)
    _release(spark, docs)
    out = quality.kept(docs)
    _held.setdefault(spark.sparkContext.applicationId, []).extend(out.read_tables)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays."""
    fewer_rows(spark, ROWS)
    _release(spark, docs)
    return partenum.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    fewer_rows(spark, ROWS)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or doubled so that their sources meet their shares."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of each document of the mix; the ids are decoded and compared with the text."""
    fewer_rows(spark, ROWS)
    return pieces.encoded(docs, vocabulary("piece_bpe_32k.model"), check=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: The perplexity model, the signatures and the piece search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    with small_batches(spark, ROWS):
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
            if before is not None:
                discard(before)
            before = docs
    return docs
