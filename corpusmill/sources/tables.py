"""Readers of tables and of JSON lines with strict schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, text string, page_start int, page_end int, strategy string, section string"
GOLDEN = "id string, question string, type string, answerable boolean, gold_pages array<struct<start:int,end:int>>, evidence_terms array<string>, must_not_contain array<string>, any_range boolean, key_facts array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; a row that doesn't fit the schema fails the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of a JSON-lines file whose first line may be a header (`_params`); a row that doesn't fit the schema fails the job."""
    rows = spark.read.schema(f"{CHUNKS}, _params map<string,string>").json(path, mode="FAILFAST")
    return rows.where("_params IS NULL").drop("_params")


def golden_problems(questions: DataFrame) -> DataFrame:
    """(id, problem) for every golden question that breaks a rule."""
    rules = {
        "answerable without gold pages": F.col("answerable") & (F.size(F.coalesce("gold_pages", F.array())) == 0),
        "unanswerable with gold pages": ~F.col("answerable") & (F.size(F.coalesce("gold_pages", F.array())) > 0),
        "range ends before it starts": F.exists("gold_pages", lambda r: r["end"] < r["start"]),
        "attack without forbidden text": (F.col("type") == "attack") & (F.size(F.coalesce("must_not_contain", F.array())) == 0),
    }
    found = questions.select("id", F.explode(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items()))).alias("problem")).where("problem IS NOT NULL")
    again = questions.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    return found.unionByName(again)
