"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``.  A result is to be written before the next stage is called:
the call deletes the working tables of the stages before, but those that its own docs
still rest on.  Language models, fingerprints and line templates have no
SQL form, so ``ORACLE_SQL`` is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, lines, packing, simhash
from millrace.plans.lineage import forget, recorded, working_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables of the stages that ran, by place in the pipeline.
_LEFT: dict[int, list[str]] = {}


def _stage(place: int) -> Callable[[Stage], Stage]:
    """A stage that deletes what the stages before it left behind, unless its docs still rest on that."""

    def of(fn: Stage) -> Stage:
        @wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = [p for n in sorted(_LEFT) if n < place for p in _LEFT.pop(n)]
            if before:
                files = docs.inputFiles()
                forget(spark, [p for p in before if not any(p.rsplit("/", 1)[-1] in f for f in files)])
            with recorded() as paths:
                out = fn(spark, docs, sf_dir)
            _LEFT.setdefault(place, []).extend(paths)
            return out

        return run_stage

    return of


@_stage(0)
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the others go.

    Null and empty texts and those without a letter go; a null language or source is no
    evidence; repeated rows are judged alike; an empty table gives an empty one; more
    columns stay, whatever their names.
    """
    return language.keep_identified(docs)


@_stage(1)
def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their boilerplate lines; ``n_chars`` follows the text.

    Null and empty texts stay; a text of nothing but boilerplate becomes empty; copies
    make nothing recur; repeated rows are treated alike; an empty table gives an empty
    one; more columns stay, whatever their names.
    """
    kept = lines.drop_recurring(docs)
    if "n_chars" not in kept.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


@_stage(2)
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id.

    Null texts stay; empty ones are copies of each other; rows equal in all columns
    count as one; an empty table gives an empty one; more columns stay.
    """
    return simhash.drop_near_duplicates(docs)


@_stage(3)
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts stay; repeated rows are judged alike; with an empty benchmark
    all stay; an empty table gives an empty one; more columns stay.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage(4)
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The slot of every piece of every document.

    Null and empty texts have none; repeated rows have slots of their own; an empty
    table has no slots; more columns are not returned.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with recorded() as paths:
            docs = stage(spark, docs, sf_dir)
        docs = working_table(docs, f"pipeline-{name}")
        forget(spark, paths)
    return docs
