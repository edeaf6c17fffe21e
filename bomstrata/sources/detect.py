"""What kind of bill of materials a text is, by JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of the formats.
_CDX_XML = r"cyclonedx\.org/schema/bom/(\d+\.\d+)"
_SPDX_CONTEXT = r"spdx\.org/rdf/(\d+\.\d+(?:\.\d+)?)"
_YAML = r"(?m)^[ \t]*(?:spdxVersion|dataLicense|documentNamespace|creationInfo|hasExtractedLicensingInfos|documentDescribes)[ \t]*:"
_YAML_VERSION = r"(?m)^[ \t]*spdxVersion[ \t]*:[ \t]*[\"']?SPDX-(\d+\.\d+)"
_TAG_VERSION = r"SPDXVersion:\s*SPDX-(\d+\.\d+)"


def detect(text: Column) -> Column:
    """``struct<sbom_format, spec_version, encoding, error>``; the error is null where a format is found.

    Null and blank texts are "empty"; texts that start like JSON but are none, and JSON or XML of other kinds, get
    an error and no format.
    """
    t = F.coalesce(text, F.lit(""))
    start = F.substring(F.regexp_replace(t, r"^\s+", ""), 1, 1)
    json = F.try_parse_json(t)
    s = lambda path: F.try_variant_get(json, path, "string")
    has = lambda path: F.try_variant_get(json, path, "variant").isNotNull()
    got = lambda pattern, other: F.coalesce(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")), F.lit(other))
    is_object = F.schema_of_variant(json).startswith("OBJECT")
    row = lambda f, v, e: F.struct(F.lit(f).cast("string").alias("sbom_format"), (v if isinstance(v, Column) else F.lit(v).cast("string")).alias("spec_version"), F.lit(e).cast("string").alias("encoding"), F.lit(None).cast("string").alias("error"))
    bad = lambda why: F.struct(F.lit(None).cast("string").alias("sbom_format"), F.lit(None).cast("string").alias("spec_version"), F.lit(None).cast("string").alias("encoding"), F.lit(why).alias("error"))
    cdx = (s("$.bomFormat") == "CycloneDX") | (has("$.specVersion") & has("$.components"))
    version = F.trim(F.coalesce(s("$.specVersion"), F.lit("")))
    plain = lambda c: F.trim(F.replace(c, F.lit("SPDX-"), F.lit("")))
    of_json = (
        F.when(~F.coalesce(is_object, F.lit(False)), bad("JSON document is neither CycloneDX nor SPDX."))
        .when(F.coalesce(cdx, F.lit(False)), F.when(version == "", bad("CycloneDX JSON missing specVersion.")).otherwise(row("cyclonedx", version, "json")))
        .when(has("$.spdxVersion"), row("spdx", plain(s("$.spdxVersion")), "json"))
        .when(has("$['@context']") & (t.rlike(_SPDX_CONTEXT) | F.lower(t).contains("spdx")), row("spdx", got(_SPDX_CONTEXT, "3.0.1"), "json"))
        .when(has("$.SPDXID"), row("spdx", "2.3", "json"))
        .otherwise(bad("JSON document is neither CycloneDX nor SPDX."))
    )
    return (
        F.when(start == "", bad("Document is empty."))
        .when(start.isin("{", "["), F.when(json.isNull(), bad("Looks like JSON but failed to parse.")).otherwise(of_json))
        .when(start == "<", F.when(t.rlike(_CDX_XML), row("cyclonedx", F.regexp_extract(t, _CDX_XML, 1), "xml")).when(F.lower(t).contains("spdx"), row("spdx", got(_SPDX_CONTEXT, "2.3"), "xml")).otherwise(bad("XML document is neither CycloneDX nor SPDX.")))
        .when(t.rlike(_YAML), row("spdx", got(_YAML_VERSION, "2.3"), "yaml"))
        .when(t.rlike(_TAG_VERSION) | t.contains("SPDXID:") | t.contains("DocumentNamespace:"), row("spdx", got(_TAG_VERSION, "2.3"), "tagvalue"))
        .otherwise(bad("Unrecognized SBOM format (not CycloneDX or SPDX)."))
    )
