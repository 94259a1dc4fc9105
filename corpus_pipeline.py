"""A training corpus from raw documents: the stages, in order, each over all that its predecessor kept.

Every stage takes and gives any columns beside its own (``doc_id``, ``text``,
``source``), whatever their names. Ids may be null or repeated: a row is a
document of its own, unless another row is equal to it in all values. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import drop_leaks
from tessera.llm.jaccard_join import keep_one
from tessera.llm.mixing import mixed
from tessera.llm.quality_fm import fit, keep_good
from tessera.llm.token_frames import token_frames
from tessera.session import delete, scratch, shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; equal texts have equal verdicts, a null text counts as empty."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8 or more).

    It is the one of the smallest id, of equal ids any one, always the same; rows equal in all values are one.
    """
    return keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; repeated rows have equal verdicts."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources have their target weights.

    Documents without words go, as they have nothing to take. Rows of equal id and size share the cut evenly.
    """
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Token ids in seekable frames below ``folder``; one row per document, read back from the files."""
    return token_frames(docs, folder=folder)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("source mix", source_mix),
    ("token frames", tokens),
]

#: The learnt classifier and the tokenizer can't be expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; what a stage wrote is deleted when the next has written its own.

    The token files, with their manifest, are the product: they lie below
    ``folder``, a URI that all executors reach, or else in a new
    ``token-frames-`` folder of the shared one.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for place, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            if stage is tokens:
                docs = tokens(spark, docs, sf_dir, folder)
            else:
                before, path = path, shared_path(spark, f"stage-{place}")
                made = stage(spark, docs, sf_dir)
                made.write.parquet(path)
                docs = spark.read.schema(made.schema).parquet(path)
                delete(spark, [before] if before else [])
    delete(spark, [path])
    return docs
