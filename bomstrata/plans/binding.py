"""The SBOM tables as a corpus: a star of documents, components, files and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomstrata.operators import licenses
from bomstrata.operators.engine import Corpus

_DECL = "array<struct<raw:string,source:string,normalized:string,method:string>>"
_MAP = "map<string,string>"


#: Most entries of license_reference that are read on the driver.
MAX_LICENSES = 10_000


def reference_licenses(spark: SparkSession, sf_dir: str) -> list[str]:
    """The sorted ids of license_reference; a table above the bound is refused, not cut."""
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/license_reference.parquet").select("license_id").limit(MAX_LICENSES + 1).collect()]
    if len(ids) > MAX_LICENSES:
        raise ValueError(f"license_reference has more than {MAX_LICENSES} entries, the most that are read on the driver")
    return sorted(ids)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """Documents by ``sbom_id`` (of repeated deliveries the last), SPDX packages and CycloneDX components as delivered.

    A component's position is ``pkg_pos`` or ``comp_row_id``. Licences resolve against the public identifiers and
    those of license_reference, a table of fixed size that is read on the driver.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    tables = licenses.tables_with(reference_licenses(spark, sf_dir))
    none = lambda kind: F.lit(None).cast(kind)
    fields = ("sbom_format", "spec_version", "doc_encoding", "doc_name", "namespace_uri", "serial_number", "bom_version", "doc_timestamp", "creators", "tools", "lifecycles", "data_license", "signed")
    d = t("sbom_document").where(F.col("sbom_id").isNotNull()).groupBy("sbom_id").agg(F.max_by(F.struct(*fields), "doc_row_id").alias("d"))
    documents = d.select(
        F.col("sbom_id").alias("doc_id"), F.lower("d.sbom_format").alias("sbom_format"), "d.spec_version", F.col("d.doc_encoding").alias("encoding"), F.col("d.doc_name").alias("name"),
        F.coalesce("d.namespace_uri", "d.serial_number").alias("namespace"), F.col("d.doc_timestamp").alias("timestamp"), F.col("d.bom_version").cast("string").alias("sbom_version"), none("string").alias("supplier"), "d.data_license",
        "d.creators", "d.tools", none("array<string>").alias("tool_versions"), "d.lifecycles", "d.signed", none("string").alias("raw"), none("array<string>").alias("schema_errors"),
    )
    decl = lambda raw, source, x: F.struct(raw.alias("raw"), source.alias("source"), x["normalized"].alias("normalized"), x["method"].alias("method"))
    effective = F.transform("license_declarations", lambda x: F.coalesce(x["normalized"], x["raw"]))
    p = t("spdx_package").withColumn("x", licenses.normalise(F.col("license_declared"), tables))
    packages = p.select(
        F.col("sbom_id").alias("doc_id"), F.col("pkg_pos").cast("long").alias("pos"), F.col("spdxid").alias("bom_ref"), F.col("pkg_name").alias("name"), F.col("version_info").alias("version"), none("string").alias("type"), "purl", none("string").alias("cpe"),
        "supplier", F.col("originator").alias("author"), none("string").alias("publisher"), F.when(F.coalesce("license_declared", F.lit("")) != "", F.array(decl(F.col("license_declared"), F.lit("licenseDeclared"), F.col("x")))).otherwise(F.array().cast(_DECL)).alias("license_declarations"),
    )
    lic = t("license_declaration").where(F.col("raw").isNotNull() & (F.col("raw") != "")).withColumn("x", licenses.normalise(F.col("raw"), tables))
    lic = lic.groupBy("comp_row_id").agg(F.array_sort(F.collect_list(F.struct("decl_id", decl(F.col("raw"), F.col("slot"), F.col("x")).alias("d")))).alias("l"))  # declarations of one component
    c = t("cdx_component").join(lic, "comp_row_id", "left")
    comps = c.select(
        F.col("sbom_id").alias("doc_id"), F.col("comp_row_id").cast("long").alias("pos"), "bom_ref", F.col("comp_name").alias("name"), F.col("comp_version").alias("version"), F.col("comp_type").alias("type"), "purl", none("string").alias("cpe"),
        none("string").alias("supplier"), none("string").alias("author"), none("string").alias("publisher"), F.coalesce(F.transform("l", lambda x: x["d"]), F.array().cast(_DECL)).alias("license_declarations"),
    )
    components = packages.unionByName(comps).withColumns({"licenses": effective, "hashes": F.create_map().cast(_MAP), "external_refs": F.array().cast("array<string>"), "raw": none("string")})
    files = spark.createDataFrame([], "doc_id long, pos long, spdx_id string, name string, copyright string, hashes map<string,string>, licenses array<string>, raw string")
    edges = t("cdx_dependency").select(F.col("sbom_id").alias("doc_id"), F.col("dep_ref").alias("src"), F.explode_outer("depends_on").alias("dst"))
    return Corpus(documents, components, files, edges)


def raw_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus read from whole documents."""
    from bomstrata.sources.documents import read

    return read(spark.read.parquet(f"{sf_dir}/raw_sbom.parquet"), "raw_id", "payload")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/raw_sbom.parquet")
