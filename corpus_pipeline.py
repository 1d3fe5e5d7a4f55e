"""The corpus pipeline: ``documents`` to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet into the shared scratch folder and read again as the next stage's
``docs``, so that lineage ends there and a lost executor repeats one stage at
most. All stages but the last return the columns of ``documents``.

toxicity             texts with a score of 0.5 or more go
near_duplicates      one text of each near-duplicate group stays
repeated_passages    passages of 200 bytes or more that occur again are cut out
decontamination      texts that contain a benchmark passage go
token_ids            byte-pair ids of every text, and whether they decode to it
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsleuth.llm.bpe import encode_and_decode
from tabsleuth.llm.decontaminate import remove_contaminated
from tabsleuth.llm.minhash import drop_near_duplicates
from tabsleuth.llm.queries import prepare, tokenizer_path
from tabsleuth.llm.suffix_dedup import remove_repeats
from tabsleuth.llm.toxicity import remove_toxic
from tabsleuth.session import scratch_path, ship_package

#: SQL cannot express the classifier, the tokenizer or the byte-wise cuts.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    prepare(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The length column follows the text."""
    _ready(spark)
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, round_trip (the ids decode to the text)."""
    _ready(spark)
    path = tokenizer_path("byte_bpe_50k.json")
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    both = encode_and_decode(rows, path)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
