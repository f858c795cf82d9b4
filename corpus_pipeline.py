"""A corpus pipeline of five stages; each is written as Parquet in the shared folder and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from leasegrain.llm import decontamination, langid, mixing, queries, similar, token_files
from leasegrain.llm.common import table
from leasegrain.session import staged

#: Bytes of a batch for the Python workers. Spark would fill 64 MB, which stand beside an executor's heap and again in the
#: worker, for each task; the stages work on slices of 1 to 12 MB anyway.
BATCH = "11m"


def in_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage in a session that hands its rows to Python in batches of ``BATCH`` bytes, also when its result is read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


@in_batches
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised without ambiguity; see ``langid.recognised``."""
    return langid.recognised(docs)


@in_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word Jaccard similarity of 0.8 or more; see ``similar.keep_first``."""
    return similar.keep_first(docs)


@in_batches
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; see ``decontamination.clean``."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@in_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows: a document once per pass, the last pass with its picked words; see ``mixing.mixed``."""
    return mixing.mixed(docs)


@in_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from the token files."""
    path = queries.fresh(spark, "pipeline-tokens")
    token_files.write_tokens(docs, path, queries.tokenizer_path())
    return token_files.read_tokens(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_languages),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]

#: SQL has neither the classifier nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
