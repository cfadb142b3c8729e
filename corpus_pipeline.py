"""A training corpus from `documents` in five stages; each reads what the one before it wrote.

1. toxicity: scores every text by its nearest labelled examples and drops what is predicted toxic.
2. ngram_join: of each group of near copies (word 5-gram Jaccard of 0.8 or more) the smallest doc_id stays.
3. decontamination: documents with a 10-word window of a benchmark item go.
4. secret_scan: secrets are replaced by a mark in the texts.
5. mixing: the words that the mix takes of every document, repeats counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.llm import decontaminate, secret_scan, toxicity
from meshgrain.llm.common import own_folder, text_batches
from meshgrain.llm.mixing import mix_sources
from meshgrain.llm.ngram_join import ngram_join


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic; examples are labelled rows of docs. Rows alike go or stay together, null and empty texts are judged by the prior."""
    examples = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))
    return toxicity.without_toxic(docs, examples)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id, with all its rows. Rows with a null doc_id stay, and so do texts without words."""
    found = ngram_join(docs, size=5, percent=80)
    drop = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in which no benchmark window occurs; null and wordless texts stay, and with an empty benchmark all do."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a mark in place of every secret span of the text and n_chars counted anew; texts without one, null and empty ones stay as they are."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row that came this far; null texts have no words, a null source is one of its own."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("mixing", mix),
]
#: Nearest-example scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`; every stage's result is a table in the shared folder."""
    folder = own_folder(spark, "corpus")  # the stages' tables go when the driver ends
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
