"""A corpus in five stages: toxicity, near duplicates, secrets, mixture, packing. Part of the llm subpackage.

Every stage works on all rows that the stage before it kept. Toxicity drops the documents that the classifier rejects; the
Jaccard join keeps one document of each group; secret scans replace what they find; mixing repeats documents until the
languages have their target weights, and drops none; packing gives the pieces of all documents and their sequences.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbtide.llm import blobs, jaccard, mixing, packing, toxicity
from ebbtide.llm.queries import table, toxicity_model
from ebbtide.llm.workspace import Workspace, opened, release, taken

#: Folders with the tables of the stage that ran last.
_held: list[str] = []


def stage(function):
    """A stage whose tables are deleted when the next one begins: by then its result has been written and read again."""

    @functools.wraps(function)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _held)
        mark = opened()
        out = function(spark, docs, sf_dir)
        _held[:] = taken(mark)
        return out

    return begin


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    model = toxicity_model(spark, docs, sf_dir)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")
    scored = toxicity.scored(docs.select("text", "lang", row), model)
    return scored.where(~model.rejects(F.col("lang"), F.col("toxicity"))).select("__doc.*")


@stage
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near duplicates."""
    return jaccard.keep_one(docs)


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text."""
    carried = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    found = blobs.secrets(carried)
    hit = F.size("spans") > 0
    text = F.when(hit, blobs.masked(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = found.withColumn("__text", text)
    changed = {
        "text": F.col("__text"),
        "n_chars": F.when(hit, F.length("__text").cast("bigint")).otherwise(F.col("__row.n_chars")),
    }
    return out.select(*(changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))


@stage
def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, and again as often as its rate says."""
    labels = table(spark, sf_dir, "labels")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")
    found = mixing.mixed(docs.select("doc_id", "text", "lang", row), labels, least=1.0)
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return found.select("__doc", again.alias("__copy")).select("__doc.*")


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and where they stand in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each),
    ("secret_scans", mask_secrets),
    ("mixing", mix_languages),
    ("packing", pack_sequences),
]

#: The classifier and the genetic algorithm have no SQL twin; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
