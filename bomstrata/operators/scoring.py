"""Quality signals of documents and the scores that profiles weigh from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomstrata.functions.patterns import is_purl
from bomstrata.functions.text import is_null_token
from bomstrata.operators.engine import Corpus, context
from bomstrata.operators.profiles import CATEGORIES, Profile
from bomstrata.operators.validators import Value, hash_wellformed, rfc3339_reason


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(1.0))


def signals(c: Corpus) -> DataFrame:
    """One row per document: fourteen measures. A ratio over nothing is 1; absent components give ratios of 1.

    A document's components are aggregated with map-side combination; consistency of suppliers and digests takes a
    second aggregate over (document, purl) and (document, set of algorithms). Nulls count as absent.
    """
    k = c.components
    token = lambda x: x.isNull() | is_null_token(x)
    lic = F.when(F.size(F.coalesce("licenses", F.array().cast("array<string>"))) > 0, F.array_join("licenses", "; "))
    decl = F.coalesce("license_declarations", F.array().cast("array<struct<raw:string,source:string,normalized:string,method:string>>"))
    hashed = F.size(F.coalesce("hashes", F.create_map().cast("map<string,string>"))) > 0
    fine = F.expr(hash_wellformed(Value("map", "hashes"), {}, {})).isNull()
    purl = F.nullif(F.col("purl"), F.lit(""))
    part = k.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~token(F.col("version"))).alias("versions"), F.count_if(F.coalesce(is_purl(purl), F.lit(False))).alias("purls"), F.count_if(hashed & fine).alias("hashes"),
        F.sum(token(F.col("version")).cast("int") + token(F.col("supplier")).cast("int") + token(lic).cast("int")).alias("nulls"), F.sum(F.size(decl)).alias("decl"),
        F.sum(F.size(F.filter(decl, lambda d: d["normalized"].isNotNull()))).alias("resolved"), F.max(F.coalesce(F.col("supplier") != "", F.lit(False))).alias("any_supplier"),
    )
    by_purl = k.where(purl.isNotNull()).groupBy("doc_id", "purl").agg((F.min(F.coalesce("supplier", F.lit(""))) != F.max(F.coalesce("supplier", F.lit("")))).alias("differ"))
    by_purl = by_purl.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_purls"), F.count_if("differ").alias("n_differ"))
    algs = k.where(hashed).groupBy("doc_id", F.array_sort(F.array_distinct(F.transform(F.map_keys("hashes"), lambda x: F.lower(F.replace(x, F.lit("-"), F.lit("")))))).alias("a")).agg(F.count(F.lit(1)).alias("n"))
    algs = algs.groupBy("doc_id").agg(F.max("n").alias("usual"), F.sum("n").alias("n_hashed"))
    d = c.documents.join(context(c).select("doc_id", "version_tuple", "vex", "n_components", "n_refs", "n_orphans"), "doc_id")
    for x in (part, by_purl, algs):
        d = d.join(x, "doc_id", "left")
    z = lambda n: F.coalesce(n, F.lit(0))
    v, fmt = F.col("version_tuple"), F.col("sbom_format")
    at = lambda a, b: v >= F.array(F.lit(a), F.lit(b))
    current = F.when(fmt == "cyclonedx", F.when(at(1, 5), 1.0).when(at(1, 4), 0.7).otherwise(0.4)).when(fmt == "spdx", F.when(at(3, 0), 1.0).when(at(2, 3), 0.9).when(at(2, 2), 0.6).otherwise(0.3)).otherwise(0.5)
    some = lambda n: F.size(F.coalesce(n, F.array().cast("array<string>"))) > 0
    return d.select(
        "doc_id", _ratio(z("versions"), z("n")).alias("version_coverage"), _ratio(z("purls"), z("n")).alias("purl_coverage"), _ratio(z("hashes"), z("n")).alias("hash_coverage"), _ratio(z("nulls"), 3 * z("n")).alias("noassertion_density"),
        _ratio(z("resolved"), z("decl")).alias("license_normalization"), F.when((F.col("n_components") == 0) | ((F.col("n_refs") > 0) & (F.col("n_orphans") == 0)), 1.0).otherwise(0.0).alias("dependency_completeness"),
        F.when(z("n_purls") > 0, 1.0 - F.col("n_differ") / F.col("n_purls")).otherwise(1.0).alias("supplier_consistency"), _ratio(z("usual"), z("n_hashed")).alias("hash_consistency"),
        (some("tools") | some("creators")).alias("has_tool"), ((F.coalesce("supplier", F.lit("")) != "") | F.coalesce("any_supplier", F.lit(False))).alias("has_supplier"), F.coalesce("signed", F.lit(False)).alias("signed"),
        F.col("vex").alias("references_vex"), ((F.coalesce("timestamp", F.lit("")) != "") & F.expr(rfc3339_reason("timestamp")).isNull()).alias("timestamp_ok"), current.alias("version_current"),
    )


def compensated(terms: list[Column]) -> Column:
    """Sum of doubles with one running correction, as Python's ``sum`` has it."""
    s, lost = F.lit(0.0), F.lit(0.0)
    for t in terms:
        new = s + t
        lost = lost + F.when(F.abs(s) >= F.abs(t), (s - new) + t).otherwise((t - new) + s)
        s = new
    return s + lost


def scores(sig: DataFrame, p: Profile) -> DataFrame:
    """``doc_id, profile, score`` and the five category scores, of signals, under a profile's weights and thresholds."""
    c = F.col
    pick = lambda n, yes, no: F.when(c(n), yes).otherwise(no)
    mean = lambda *xs: F.bround(compensated(list(xs)) / len(xs) * 100, 0).cast("int")
    d = sig.select(
        "*", mean(c("version_coverage"), c("purl_coverage"), 1.0 - c("noassertion_density")).alias("Completeness"), mean(c("license_normalization"), c("purl_coverage"), c("hash_coverage"), pick("timestamp_ok", 1.0, 0.4)).alias("Accuracy"),
        mean(c("supplier_consistency"), c("license_normalization"), c("hash_consistency")).alias("Consistency"), mean(pick("has_tool", 1.0, 0.0), pick("has_supplier", 1.0, 0.0), pick("signed", 1.0, 0.3), pick("references_vex", 1.0, 0.4)).alias("Provenance"),
        mean(c("version_current"), pick("timestamp_ok", 1.0, 0.5)).alias("Freshness"),
    )
    for key, signal, category, over in (("noassertion_density_max", "noassertion_density", "Completeness", True), ("version_coverage_min", "version_coverage", "Completeness", False), ("license_normalization_min", "license_normalization", "Accuracy", False)):
        if key in p.thresholds:
            limit = float(p.thresholds[key])
            d = d.withColumn(category, F.when(c(signal) > limit if over else c(signal) < limit, F.greatest(F.lit(0), c(category) - 15)).otherwise(c(category)))
    w = {k: float(p.category_weights().get(k, 0.0)) for k in CATEGORIES}
    total = sum(w.values()) or 1.0
    score = F.bround(compensated([c(k) * F.lit(w[k]) for k in CATEGORIES]) / total, 0).cast("int")
    return d.select("doc_id", F.lit(p.id).alias("profile"), score.alias("score"), *CATEGORIES)
