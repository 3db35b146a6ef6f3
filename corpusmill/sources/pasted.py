"""Golden questions pasted as JSON objects one after the other, often with broken quoting: split, repaired, checked.

An object begins at a brace before the key `id`, after the end of another, so one that doesn't parse doesn't hide those after it. Each
piece is repaired alone, in this order, and every change is listed with it:

- backslashes that begin no JSON escape go;
- a last key `notes` whose text holds raw quotation marks or line breaks is quoted anew, if the object doesn't parse as it stands;
- HTML entities are decoded;
- `must_not_contain` given as a text becomes a list, `ground_truth_answer` is read as `reference_answer`.

Defined results: null or blank texts have no objects; a piece that still doesn't parse, or that has no id, goes to the rejects with its
reason; a question said to be answerable without [start, end] pairs of pages keeps its row and has a problem.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the repair list says.
ESCAPES, NOTES, ENTITIES, LISTED, RENAMED = "removed invalid backslash escapes", "quoted notes anew", "decoded HTML entities", "must_not_contain converted to a list", "ground_truth_answer renamed"
_ESCAPE = r'(\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})|\\'
_LAST_NOTES = r'(?s)^(.*"notes":\s*")(.*)("\s*\})\s*$'


@F.pandas_udf(T.StringType())
def _decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def _parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _quoted(body: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(escaped))
    return body


def pieces(pasted: DataFrame, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """(source, nth, raw, repaired, repairs): each object of each text, as written and after the repairs of its text."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r'(?<=\})\s*(?=\{\s*"id"\s*:)')
    rows = pasted.select(F.col(id_col).alias("source"), F.posexplode(parts).alias("nth", "raw")).withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("raw <> ''")
    rows = rows.withColumn("__a", F.regexp_replace("raw", _ESCAPE, "$1"))
    again = F.concat(F.regexp_extract("__a", _LAST_NOTES, 1), _quoted(F.regexp_extract("__a", _LAST_NOTES, 2)), F.regexp_extract("__a", _LAST_NOTES, 3))
    rows = rows.withColumn("__b", F.when(~_parses(F.col("__a")) & F.col("__a").rlike(_LAST_NOTES), again).otherwise(F.col("__a")))
    rows = rows.withColumn("repaired", F.when(F.contains("__b", F.lit("&")), _decoded(F.col("__b"))).otherwise(F.col("__b")))
    made = F.array(F.when(F.col("__a") != F.col("raw"), ESCAPES), F.when(F.col("__b") != F.col("__a"), NOTES), F.when(F.col("repaired") != F.col("__b"), ENTITIES))
    return rows.select("source", "nth", "raw", "repaired", F.array_compact(made).alias("repairs"))


def questions(pieces_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`pieces` -> (rows, rejects). rows(source, nth, id, question, answerable, gold_pages, evidence_terms, must_not_contain, reference_answer,
    notes, repairs, problem); rejects(source, nth, raw, reason)."""
    read = pieces_.withColumn("v", F.try_parse_json("repaired"))
    get = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    name = get("id", "string")
    reason = F.when(F.col("v").isNull(), "not a JSON object").when(name.isNull(), "no id")
    rejects = read.select("source", "nth", "raw", reason.alias("reason")).where("reason IS NOT NULL")
    one = F.when(get("must_not_contain", "array<string>").isNull(), get("must_not_contain", "string"))
    renamed = get("reference_answer", "string").isNull() & get("ground_truth_answer", "string").isNotNull()
    pages = get("gold_pages", "array<array<int>>")
    paired = F.coalesce(F.forall(pages, lambda p: F.coalesce((F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull(), F.lit(False))), get("gold_pages", "string").isNull())
    problem = F.when(F.coalesce(get("answerable", "boolean"), F.lit(False)) & ~paired, "gold_pages is not a list of [start, end] pairs")
    repairs = F.concat("repairs", F.array_compact(F.array(F.when(one.isNotNull(), LISTED), F.when(renamed, RENAMED))))
    none = F.array().cast("array<string>")
    rows = read.where(reason.isNull()).select(
        "source", "nth", name.alias("id"), get("question", "string").alias("question"), get("answerable", "boolean").alias("answerable"), pages.alias("gold_pages"), F.coalesce(get("evidence_terms", "array<string>"), none).alias("evidence_terms"),
        F.coalesce(get("must_not_contain", "array<string>"), F.when(one.isNotNull(), F.array(one)), none).alias("must_not_contain"), F.coalesce(get("reference_answer", "string"), get("ground_truth_answer", "string")).alias("reference_answer"),
        F.coalesce(get("notes", "string"), F.lit("")).alias("notes"), repairs.alias("repairs"), problem.alias("problem"),
    )
    return rows, rejects
