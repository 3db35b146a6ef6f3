"""Chunk sets and traces as JSON lines: several tables read together, checked across each other, what fails set aside with its reason.

A chunk set is a folder with `<strategy>.jsonl` (a header line with the strategy and its parameters, then a chunk a line) and, where chunks have
parents, `<strategy>.parents.jsonl`. Either may be one file or a folder of part files, which is what `write_chunkset` makes. A trace file has a
question's stages and hits, nested, on each line.

Defined results: blank lines are passed over; a line that isn't a JSON object of the schema, or has a key the schema lacks, is rejected; so is
a row without an id, each further row with an id that stood before (all but the first, by line), a chunk whose pages end before they begin, a
chunk whose parent isn't among the parents (only if there are any, or the chunk names one), and a trace whose stages aren't numbered from 1 or
whose stage repeats a rank. A set without a header has no parameters. Rejects keep the line as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..operators import reports

CHUNK = "chunk_id string, text string, page_start int, page_end int, strategy string, section string, parent_id string, meta map<string,string>"
HEADER = "_params map<string,string>, _strategy string"
TRACE = "q_id long, question string, stages array<struct<stage_no:int,stage:string,kind:string,hits:array<struct<rank:int,doc_id:long,score:double>>>>, answer string, config map<string,string>"


@dataclass
class ChunkSet:
    strategy: str
    params: dict[str, str]
    rows: DataFrame
    parents: DataFrame
    rejects: DataFrame


def _first_reason(checks: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()))


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """lines(line) -> (line, row, reason): the row of the schema, and why there is none."""
    names = [f.name for f in _parse_datatype_string(schema).fields]
    row = F.from_json("line", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad"})
    read = lines.where(F.trim(F.coalesce("line", F.lit(""))) != "").withColumn("row", row).withColumn("keys", F.json_object_keys("line"))
    known = F.array(*(F.lit(n) for n in names))
    unknown = F.array_join(F.array_sort(F.array_except("keys", known)), ", ")
    reason = F.when(F.col("row.__bad").isNotNull() | F.col("keys").isNull(), "not a row of the schema").when(unknown != "", F.concat(F.lit("unknown key: "), unknown))
    return read.select("line", F.struct(*(F.col(f"row.{n}").alias(n) for n in names)).alias("row"), reason.alias("reason"))


def _without_repeats(rows: DataFrame, key: str) -> DataFrame:
    """rows(line, row, reason) with the reason `repeated id` on all but one of those that share an id: the least line stays.

    Only ids that stand twice meet in a window, and those of one id only."""
    good = rows.where("reason IS NULL")
    order = Window.partitionBy(f"row.{key}").orderBy("line")
    marked = good.withColumn("reason", F.when(F.row_number().over(order) > 1, "repeated id"))
    return marked.unionByName(rows.where("reason IS NOT NULL"))


def checked_chunks(lines: DataFrame, parent_lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines(line) of chunks without the header, and of parents -> (rows, parents, rejects(table, line, reason))."""

    def checks(read: DataFrame) -> DataFrame:
        r = F.col("row")
        found = _first_reason({"no chunk_id": F.coalesce(r["chunk_id"], F.lit("")) == "", "ends before it begins": r["page_end"] < r["page_start"]})
        return _without_repeats(read.withColumn("reason", F.coalesce("reason", found)), "chunk_id")

    empty = lines.limit(0) if parent_lines is None else parent_lines
    parents = checks(parsed(empty, CHUNK))
    ids = parents.where("reason IS NULL").select(F.col("row.chunk_id").alias("__parent"))
    rows = checks(parsed(lines, CHUNK)).withColumn("__id", F.col("row.parent_id")).join(ids, F.col("__id") == F.col("__parent"), "left")
    lost = F.when(F.col("__id").isNotNull() & F.col("__parent").isNull(), "parent isn't in the set")
    rows = rows.withColumn("reason", F.coalesce("reason", lost))
    aside = lambda df, name: df.where("reason IS NOT NULL").select(F.lit(name).alias("table"), "line", "reason")
    good = lambda df: df.where("reason IS NULL").select("row.*")
    return good(rows), good(parents), aside(rows, "chunks").unionByName(aside(parents, "parents"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_chunkset(spark: SparkSession, folder: str, strategy: str) -> ChunkSet:
    lines = _lines(spark, f"{folder}/{strategy}.jsonl")
    is_header = F.coalesce(F.array_contains(F.json_object_keys("line"), "_params"), F.lit(False))
    head = lines.where(is_header).select(F.from_json("line", HEADER).alias("h")).select("h.*").first()
    parents = f"{folder}/{strategy}.parents.jsonl"
    rows, above, rejects = checked_chunks(lines.where(~is_header), _lines(spark, parents) if _exists(spark, parents) else None)
    return ChunkSet(strategy, dict(head._params or {}) if head else {}, rows, above, rejects)


def _json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_chunkset(folder: str, strategy: str, params: dict[str, object], rows: DataFrame, parents: DataFrame | None = None) -> None:
    """A folder of part files for the chunks, the header a file of its own, and one for the parents."""
    spark = rows.sparkSession
    head = spark.range(1).select(F.to_json(F.struct(F.create_map(*(F.lit(str(x)) for kv in params.items() for x in kv)).alias("_params") if params else F.create_map().cast("map<string,string>").alias("_params"), F.lit(strategy).alias("_strategy"))).alias("value"))
    head.write.text(f"{folder}/{strategy}.jsonl")
    _json(rows).write.mode("append").text(f"{folder}/{strategy}.jsonl")
    if parents is not None:
        _json(parents).write.text(f"{folder}/{strategy}.parents.jsonl")


def checked_traces(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(line) of traces -> (nested traces, rejects(table, line, reason)); `reports.read_traces` makes them flat."""
    read = parsed(lines, TRACE)
    stages = F.coalesce("row.stages", F.array().cast(read.schema["row"].dataType["stages"].dataType))
    numbers = F.transform(stages, lambda s: s["stage_no"])
    counted = F.forall(F.transform(numbers, lambda n, i: F.coalesce(n == i + 1, F.lit(False))), lambda good: good)
    ranks = lambda s: F.transform(F.coalesce(s["hits"], F.array().cast("array<struct<rank:int,doc_id:long,score:double>>")), lambda h: h["rank"])
    again = F.exists(stages, lambda s: F.size(F.array_distinct(ranks(s))) < F.size(ranks(s)))
    found = _first_reason({"no question id": F.col("row.q_id").isNull(), "stages aren't numbered from 1": ~counted, "a stage repeats a rank": again})
    rows = _without_repeats(read.withColumn("reason", F.coalesce("reason", found)), "q_id")
    return rows.where("reason IS NULL").select("row.*"), rows.where("reason IS NOT NULL").select(F.lit("traces").alias("table"), "line", "reason")


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits of all stages as flat rows, rejects) of a trace file or a folder of them."""
    nested, rejects = checked_traces(_lines(spark, path))
    return reports.read_traces(nested.select("q_id", "stages")), rejects


def write_traces(path: str, nested: DataFrame) -> None:
    """One line a question, a folder of part files."""
    _json(nested).write.text(path)
