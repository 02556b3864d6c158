"""From raw documents to sharded training data: five stages, each written and read again.

The stages belong to the subpackage ``tablewright.llm``. Every stage takes ``(spark, docs,
sf_dir)``, works on all rows its predecessor kept and, but for the last, returns the columns of
``documents``. A row is lost only to a stage's decision: no language, a near copy, a test
passage, or a source over its budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, language_id, mixture, sharding, simhash
from tablewright.llm.queries import LEVELS, domain
from tablewright.session import scratch

#: the mixture: English may be half of each domain, and four fifths of all tokens are wanted
WEIGHTS = {("*", "en"): 3.0}
FRACTION = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language has at least half of the words; null and empty texts go, copies are
    judged alike, no rows give no rows. Like all stages it keeps the columns, whatever their names."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id; null ids lose against any
    other, texts without words are one another's copies, of repeated rows one stays, no rows give no rows."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in a benchmark item; null and empty texts stay, copies
    are judged alike, no rows give no rows."""
    return decontaminate.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources by weight; no document twice. Null languages and sources are leaves of
    their own, null texts have no tokens, ties go by the text's hash, no rows give no rows."""
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    kept = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    tree = docs.select(*kept, "doc_id", domain().alias("__domain"), F.col("lang").alias("__lang"), F.col("source").alias("__source"))
    levels = [f"__{c}" for c in LEVELS]
    text = F.col(names["text"])
    chosen = mixture.mix(tree, levels, WEIGHTS, mixture.token_length(text), tie=F.xxhash64(text), fraction=FRACTION, most_epochs=1)
    return chosen.select(*[F.col(n).alias(c) for c, n in names.items()])


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, null and repeated ids too; no rows give no rows."""
    return sharding.with_shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("shard", assign_shards),
]

#: Expectation-maximisation, SimHash and components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
