"""From raw documents to a training mix: quality, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; n_chars follows the text where a stage changes it.

Odd cases. Null ids: such documents are judged, cleaned and mixed like others. Null and empty texts: kept by all stages
but the classifier, which judges them by their shape, and the mix, which takes no words of them. Very long texts are read
whole. Ties: of near-duplicates the smallest id stays. Repeated rows: judged and cleaned each on its own; of equal texts
one stays. Empty tables: every stage gives an empty result; without labels all documents are kept, without benchmark rows
nothing is cut. Further columns of documents are carried along whatever their names, but for those that the last stage
adds, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from targetry.llm import decontam, jaccard, mixing, pii, quality
from targetry.llm.common import TOKEN_PATTERN, forget, store, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is likely enough; toxic and low-quality ones go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, prefix="__quality_").where("__quality_keep").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that consist of them for the most part go."""
    return _counted(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken, with shard, copy and position in the shard; the one document of a source
    that is cut has its first words, joined by single spaces."""
    own = ("source_size", "target", "shard", "copy", "position", "words")
    docs = docs.drop(*(f"mix_{c}" for c in (*own, "size", "placements", "place")))
    out = mixing.mix(docs, carry=tuple(c for c in docs.columns if c != "doc_id"), prefix="mix_")
    out = out.withColumn("mix_place", F.explode("mix_placements")).select("*", *[F.col(f"mix_place.{c}").alias(f"mix_{c}") for c in own[2:]])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({TOKEN_PATTERN})"), 1), 1, F.col("mix_words").cast("int")), " ")
    text = F.when(F.col("mix_words") < F.col("mix_size"), cut).otherwise(F.col("text"))
    return _counted(out.withColumn("text", text)).select(*docs.columns, *[f"mix_{c}" for c in own])


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("mixing sources to target weights", mixed),
]

#: Trained models, digests and draws: SQL can't express the stages. Tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
        if last is not None:
            forget(last)
        last = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
