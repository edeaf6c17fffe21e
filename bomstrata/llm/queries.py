"""Queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomstrata.llm import canonical, encodings, leaks, mixing, names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = table(spark, sf_dir, "license_reference")
    a = canonical.map_to_list(table(spark, sf_dir, "spdx_package"), ref, "pkg_row_id", "license_declared").withColumn("field_name", F.lit("licenseDeclared"))
    b = canonical.map_to_list(table(spark, sf_dir, "license_declaration"), ref, "decl_id", "raw").withColumn("field_name", F.lit("raw"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("field_name", "row_id", "license_id")


def p2_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.misses(_mapped(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.same_party(table(spark, sf_dir, "spdx_package"), ["supplier", "originator"])


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.party_classes(table(spark, sf_dir, "spdx_package"), ["supplier", "originator"])


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.party_links(table(spark, sf_dir, "spdx_package"), ["supplier", "originator"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(_mix(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report


def p9_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_blocks(_mix(spark, sf_dir)).select("shard", "source", "k", "epoch", "block", F.size("pieces").alias("n_pieces"), F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_tokens"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encodings.restore_text(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.when(F.col("lost"), "").otherwise(F.md5(F.encode("restored", "UTF-8"))).alias("restored_md5"))


QUERIES = {f.__name__: f for f in (p2_found, p2_misses, p6_found, p6_classes, p6_links, p8_found, p9_found, p9_shares, p9_blocks, p10_found)}
#: The verdict on a source does not depend on the tokenizer, so characters stand in for tokens.
ORACLE: dict[str, str] = {
    "p9_found": """
WITH sizes AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(d.n_chars), 0) AS n FROM source_target t LEFT JOIN documents d USING (source) GROUP BY ALL)
SELECT source FROM sizes WHERE n * max_repeats < target_share * (SELECT sum(n) FROM sizes)""",
}
