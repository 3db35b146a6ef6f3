"""Which documents two versions of a store differ in, by a tree of fingerprints that is compared level by level.

A document's place in the tree is the beginning of its id's hash: DIGITS hexadecimal digits name its leaf, fewer name the nodes above. A
leaf's fingerprint covers its documents' ids and texts, a node's those of its (at most sixteen) children. `write_version` stores the
tree, and the documents' digests in folders by the first TOP digits. `changes` begins at the top and goes down only where two
fingerprints differ, so of the digests only the folders under a difference are read, and of the texts none.

Defined results: null text is empty; rows that share an id are one document with several texts, in any order; a null id is the id
'null'; two empty stores don't differ; versions of different depth aren't compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS, TOP = 4, 2


def _over(marks: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(marks)), ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = DIGITS, top: int = TOP) -> DataFrame:
    """(top, leaf, id, digest): one row a document."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    place = F.substring(F.sha2(name, 256), 1, digits)
    rows = docs.select(place.alias("leaf"), name.alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("d"))
    return rows.groupBy("leaf", "id").agg(_over(F.col("d")).alias("digest")).select(F.substring("leaf", 1, top).alias("top"), "leaf", "id", "digest")


def tree(rows: DataFrame, digits: int = DIGITS) -> DataFrame:
    """`digests` -> (level, node, n, fingerprint), level 0 the root and level `digits` the leaves. A level is made of the one below."""
    level = rows.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), _over(F.concat("id", F.lit(":"), "digest", F.lit(";"))).alias("fingerprint"))
    out = level.select(F.lit(digits).alias("level"), "node", "n", "fingerprint")
    for k in range(digits - 1, -1, -1):
        level = level.groupBy(F.substring("node", 1, k).alias("node")).agg(F.sum("n").alias("n"), _over(F.concat(F.substring("node", k + 1, 1), F.lit(":"), "fingerprint", F.lit(";"))).alias("fingerprint"))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "node", "n", "fingerprint"))
    return out


def write_version(docs: DataFrame, path: str, digits: int = DIGITS, top: int = TOP, **columns: str) -> None:
    """The digests and the tree of a version, under path. The tree is made of the stored digests, so texts are read once."""
    rows = digests(docs, digits=digits, top=top, **columns).repartitionByRange("leaf")  # a task writes few folders
    rows.write.partitionBy("top").parquet(f"{path}/digests")
    spark = docs.sparkSession
    tree(spark.read.schema("leaf string, id string, digest string, top string").parquet(f"{path}/digests"), digits).write.partitionBy("level").parquet(f"{path}/tree")


def differing_leaves(old: DataFrame, new: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(node): leaves that differ between two trees; a level is compared only below nodes that differ."""
    above = None
    for k in range(digits + 1):
        a, b = (t.where(F.col("level") == k).select("node", F.col("fingerprint").alias(f"f{i}")) for i, t in enumerate((old, new)))
        if above is not None:
            a, b = (t.withColumn("__up", F.substring("node", 1, k - 1)).join(above.withColumnRenamed("node", "__up"), "__up", "left_semi").drop("__up") for t in (a, b))
        above = a.join(b, "node", "full").where(~F.col("f0").eqNullSafe(F.col("f1"))).select("node")
    return above


def changes(spark: SparkSession, old: str, new: str, digits: int = DIGITS, top: int = TOP) -> DataFrame:
    """(id, change) of every document that was added, removed or changed between the versions stored at two paths."""
    trees = [spark.read.schema("node string, n long, fingerprint string, level int").parquet(f"{p}/tree") for p in (old, new)]
    if any(t.agg(F.max("level")).first()[0] not in (None, digits) for t in trees):
        raise ValueError("the versions' trees aren't of this depth")
    leaves = differing_leaves(*trees, digits)
    tops = sorted(r.top for r in leaves.select(F.substring("node", 1, top).alias("top")).distinct().collect())  # 16^top folders at most
    parts = []
    for p, name in ((old, "d0"), (new, "d1")):
        rows = spark.read.schema("leaf string, id string, digest string, top string").parquet(f"{p}/digests").where(F.col("top").isin(tops))
        parts.append(rows.join(leaves.withColumnRenamed("node", "leaf"), "leaf", "left_semi").select("id", F.col("digest").alias(name)))
    both = parts[0].join(parts[1], "id", "full").where(~F.col("d0").eqNullSafe(F.col("d1")))
    return both.select("id", F.when(F.col("d0").isNull(), "added").when(F.col("d1").isNull(), "removed").otherwise("changed").alias("change"))
