"""Queries for the engine's own operators over the bound and the raw corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomstrata.operators import licenses, profiles, scoring
from bomstrata.operators.engine import context, findings, top_issues, verdicts
from bomstrata.operators.validators import CPE_22, CPE_23, DIGEST_LENGTHS, REGISTRY, Value, available
from bomstrata.plans import binding, reports
from bomstrata.sources.detect import detect

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: SQL pieces of the checks, for the oracle side.
_TOKEN = "(lower(trim({0}, E' \\t\\n\\r')) IN ('', 'noassertion', 'none', 'n/a', 'unknown'))"
_PLACEHOLDER = r"regexp_full_match({0}, '\s*(todo|tbd|changeme|change[_-]?me|xxx+|n/?a|unknown|example|placeholder|foo|bar|\$\{.*\}|<.*>|0\.0\.0|1\.0\.0-snapshot)\s*', 'i')"
_SEMVER = r"regexp_full_match(trim({0}, E' \t\n\r'), '(v?\d+\.\d+\.\d+([-+][0-9A-Za-z.-]+)?|\d{4}([.\-]\d{1,2}){1,2}([.\-][0-9A-Za-z]+)?)')"
_CPE = CPE_23.replace("'", "''")
_PURL = r"regexp_full_match({0}, '[pP][kK][gG]:/*[A-Za-z][A-Za-z0-9.+\-]*/+([^@?#\s]*/)?[^/@?#\s]+/*(@[^?#\s]*)?(\?([A-Za-z._\-][A-Za-z0-9._\-]*=[^#&\s]*(&[A-Za-z._\-][A-Za-z0-9._\-]*=[^#&\s]*)*)?)?(#\S*)?')"


def _fill(template: str, column: str) -> str:
    return template.replace("{0}", column)


def _rows(name: str, table: str, key: str, column: str, validator: str, params: dict, bad: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn("why", F.expr(REGISTRY[validator](Value("scalar", column), {}, params))).where(F.col("why").isNotNull()).select(F.col(key), F.col(column).alias("value"))

    run.__name__ = name
    _query(f"SELECT {key}, {column} AS value FROM {table} WHERE {bad}")(run)


_rows("v_present", "spdx_package", "pkg_row_id", "supplier", "present", {}, f"supplier IS NULL OR {_fill(_TOKEN, 'supplier')}")
_rows("v_non_placeholder", "spdx_package", "pkg_row_id", "version_info", "non_placeholder", {}, _fill(_PLACEHOLDER, "version_info"))
_rows("v_format_regex", "spdx_package", "pkg_row_id", "supplier", "format_regex", {"pattern": "^(Organization|Person): "}, "NOT regexp_matches(supplier, '^(Organization|Person): ')")
_rows("v_semver_or_calver", "spdx_package", "pkg_row_id", "version_info", "semver_or_calver", {}, f"NOT {_fill(_SEMVER, 'version_info')}")
_rows("v_purl_wellformed", "spdx_package", "pkg_row_id", "purl", "purl_wellformed", {}, f"purl <> '' AND NOT {_fill(_PURL, 'purl')}")
_rows("v_component_identifier", "spdx_package", "pkg_row_id", "purl", "component_identifier", {}, f"purl <> '' AND NOT (lower(purl) LIKE 'pkg:%' AND {_fill(_PURL, 'purl')}) AND NOT regexp_matches(purl, '^cpe:2\\.3:')")
_rows("v_declared", "spdx_package", "pkg_row_id", "license_declared", "declared", {}, "license_declared IS NULL OR license_declared = ''")
_rows("v_known_unknowns_declared", "spdx_package", "pkg_row_id", "version_info", "known_unknowns_declared", {}, "version_info IS NULL")
_RFC = (
    r"(regexp_full_match(trim(doc_timestamp), '[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})') "
    r"AND TRY_CAST(substr(trim(doc_timestamp), 1, 10) AS DATE) IS NOT NULL AND substr(trim(doc_timestamp), 1, 4) <> '0000' AND TRY_CAST(substr(trim(doc_timestamp), 12, 2) AS INT) <= 23 AND TRY_CAST(substr(trim(doc_timestamp), 15, 2) AS INT) <= 59 AND TRY_CAST(substr(trim(doc_timestamp), 18, 2) AS INT) <= 59 "
    r"AND coalesce(TRY_CAST(regexp_extract(trim(doc_timestamp), '[+-]([0-9]{2}):([0-9]{2})$', 1) AS INT), 0) <= 23 AND coalesce(TRY_CAST(regexp_extract(trim(doc_timestamp), '[+-]([0-9]{2}):([0-9]{2})$', 2) AS INT), 0) <= 59)"
)
_rows("v_rfc3339_utc", "sbom_document", "doc_row_id", "doc_timestamp", "rfc3339_utc", {}, f"doc_timestamp IS NOT NULL AND NOT {_RFC}")


@_query("""SELECT unnest(['component_identifier', 'cpe_wellformed', 'declared', 'dependency_completeness', 'format_regex', 'format_version_at_least', 'format_version_not_deprecated', 'hash_algorithm_in_set', 'hash_wellformed',
'known_unknowns_declared', 'license_in_spdx_field', 'license_spdx_normalized', 'non_placeholder', 'present', 'purl_wellformed', 'references_vex', 'rfc3339_utc', 'semver_or_calver', 'signed_with_x509', 'spdx_license_expression']) AS validator""")
def v_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in available()], "validator string")


_DOCS = "docs AS (SELECT sbom_id AS doc_id, arg_max(sbom_format, doc_row_id) AS fmt, arg_max(spec_version, doc_row_id) AS ver, arg_max(coalesce(signed, false), doc_row_id) AS signed, arg_max(coalesce(doc_timestamp, ''), doc_row_id) AS doc_timestamp, arg_max(coalesce(len(creators), 0), doc_row_id) AS n_creators, arg_max(coalesce(len(tools), 0), doc_row_id) AS n_tools, arg_max(coalesce(creators, []), doc_row_id) AS creators FROM sbom_document GROUP BY 1)"
_COMPS = (
    "comps AS (SELECT sbom_id AS doc_id, pkg_pos AS pos, spdxid AS bom_ref, pkg_name AS name, version_info AS version, purl, supplier, CASE WHEN license_declared = '' THEN NULL ELSE license_declared END AS lic FROM spdx_package "
    "UNION ALL SELECT c.sbom_id, c.comp_row_id, bom_ref, comp_name, comp_version, purl, NULL, l.lic FROM cdx_component c LEFT JOIN (SELECT comp_row_id, string_agg(raw, '; ' ORDER BY decl_id) AS lic FROM license_declaration WHERE raw <> '' GROUP BY 1) l ON l.comp_row_id = c.comp_row_id)"
)
_GRAPH = (
    "refs AS (SELECT DISTINCT sbom_id AS doc_id, ref FROM (SELECT sbom_id, dep_ref AS ref FROM cdx_dependency UNION ALL SELECT sbom_id, unnest(depends_on) FROM cdx_dependency) WHERE ref IS NOT NULL), "
    "graph AS (SELECT doc_id, count(*) AS n_refs FROM refs GROUP BY 1), "
    "orphans AS (SELECT c.doc_id, count(*) AS n_orphans FROM comps c WHERE (coalesce(bom_ref, '') <> '' OR coalesce(purl, '') <> '') AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = c.doc_id AND r.ref = c.bom_ref) AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = c.doc_id AND r.ref = c.purl) GROUP BY 1)"
)


@_query(f"WITH {_DOCS}, {_COMPS}, {_GRAPH}, n AS (SELECT doc_id, count(*) AS n FROM comps GROUP BY 1) SELECT d.doc_id, fmt AS sbom_format, signed, CAST(coalesce(n, 0) AS BIGINT) AS n_components, CAST(coalesce(n_refs, 0) AS BIGINT) AS n_refs, CAST(coalesce(n_orphans, 0) AS BIGINT) AS n_orphans FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN graph USING (doc_id) LEFT JOIN orphans USING (doc_id)")
def ref_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency completeness and the other facts of whole documents."""
    return context(binding.corpus(spark, sf_dir)).select("doc_id", "sbom_format", "signed", "n_components", "n_refs", "n_orphans")


_SIGNALS = f"""{_DOCS}, {_COMPS}, {_GRAPH},
part AS (SELECT doc_id, count(*) AS n, count(*) FILTER (version IS NOT NULL AND NOT {_fill(_TOKEN, 'version')}) AS versions, count(*) FILTER (coalesce({_fill(_PURL, 'purl')}, false)) AS purls,
  sum(CAST(version IS NULL OR {_fill(_TOKEN, 'version')} AS INT) + CAST(supplier IS NULL OR {_fill(_TOKEN, 'supplier')} AS INT) + CAST(lic IS NULL OR {_fill(_TOKEN, 'lic')} AS INT)) AS nulls, bool_or(coalesce(supplier, '') <> '') AS any_supplier FROM comps GROUP BY 1),
byp AS (SELECT doc_id, count(*) AS n_purls, count(*) FILTER (k > 1) AS n_differ FROM (SELECT doc_id, purl, count(DISTINCT coalesce(supplier, '')) AS k FROM comps WHERE purl <> '' GROUP BY 1, 2) GROUP BY 1),
sig AS (SELECT d.doc_id, CASE WHEN n > 0 THEN versions / n ELSE 1.0 END AS version_coverage, CASE WHEN n > 0 THEN purls / n ELSE 1.0 END AS purl_coverage, CASE WHEN n > 0 THEN 0.0 ELSE 1.0 END AS hash_coverage, CASE WHEN n > 0 THEN nulls / (3 * n) ELSE 1.0 END AS noassertion_density,
  CASE WHEN coalesce(n, 0) = 0 OR (coalesce(n_refs, 0) > 0 AND coalesce(n_orphans, 0) = 0) THEN 1.0 ELSE 0.0 END AS dependency_completeness, CASE WHEN n_purls > 0 THEN 1.0 - n_differ / n_purls ELSE 1.0 END AS supplier_consistency,
  n_creators + n_tools > 0 AS has_tool, coalesce(any_supplier, false) AS has_supplier, signed, doc_timestamp <> '' AND {_RFC} AS timestamp_ok,
  CASE fmt WHEN 'cyclonedx' THEN CASE WHEN ver >= '1.5' THEN 1.0 WHEN ver >= '1.4' THEN 0.7 ELSE 0.4 END WHEN 'spdx' THEN CASE WHEN ver >= '3.0' THEN 1.0 WHEN ver >= '2.3' THEN 0.9 WHEN ver >= '2.2' THEN 0.6 ELSE 0.3 END ELSE 0.5 END AS version_current
  FROM docs d LEFT JOIN part USING (doc_id) LEFT JOIN byp USING (doc_id) LEFT JOIN graph USING (doc_id) LEFT JOIN orphans USING (doc_id))"""
_NAMES = ("doc_id", "version_coverage", "purl_coverage", "hash_coverage", "noassertion_density", "dependency_completeness", "supplier_consistency", "has_tool", "has_supplier", "signed", "timestamp_ok", "version_current")


@_query(f"WITH {_SIGNALS} SELECT doc_id, CAST(version_coverage AS DOUBLE) AS version_coverage, CAST(purl_coverage AS DOUBLE) AS purl_coverage, CAST(hash_coverage AS DOUBLE) AS hash_coverage, CAST(noassertion_density AS DOUBLE) AS noassertion_density, CAST(dependency_completeness AS DOUBLE) AS dependency_completeness, CAST(supplier_consistency AS DOUBLE) AS supplier_consistency, has_tool, has_supplier, signed, timestamp_ok, CAST(version_current AS DOUBLE) AS version_current FROM sig")
def ref_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.signals(binding.corpus(spark, sf_dir)).select(*_NAMES)


@_query(f"WITH {_SIGNALS} SELECT doc_id, CAST(greatest(round_even((version_coverage + purl_coverage + (1 - noassertion_density)) / 3e0 * 100, 0) - CASE WHEN noassertion_density > 0.2 THEN 15 ELSE 0 END - CASE WHEN version_coverage < 0.9 AND (noassertion_density <= 0.2 OR round_even((version_coverage + purl_coverage + (1 - noassertion_density)) / 3e0 * 100, 0) > 15) THEN 15 ELSE 0 END, 0) AS INT) AS completeness, CAST(round_even((CASE WHEN has_tool THEN 10 ELSE 0 END + CASE WHEN has_supplier THEN 10 ELSE 0 END + CASE WHEN signed THEN 10 ELSE 3 END + 4) / 40e0 * 100, 0) AS INT) AS provenance, CAST(round_even((CAST(version_current * 10 AS INT) + CASE WHEN timestamp_ok THEN 10 ELSE 5 END) / 20e0 * 100, 0) AS INT) AS freshness FROM sig")
def ref_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.scores(scoring.signals(binding.corpus(spark, sf_dir)), profiles.load("baseline"))
    return s.select("doc_id", F.col("Completeness").alias("completeness"), F.col("Provenance").alias("provenance"), F.col("Freshness").alias("freshness"))


@_query()
def ref_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite and category scores under both profiles of the catalog."""
    sig = scoring.signals(binding.corpus(spark, sf_dir))
    return scoring.scores(sig, profiles.load("baseline")).unionByName(scoring.scores(sig, profiles.load("strict")))


#: Rules of a component as SQL: id, order, severity, category, verdict.
_PART_RULES = (
    ("part-name", 12, "MUST", "Completeness", f"CASE WHEN name IS NULL OR {_fill(_TOKEN, 'name')} OR {_fill(_PLACEHOLDER, 'name')} THEN 'FAIL' ELSE 'PASS' END"),
    ("part-version", 13, "MUST", "Completeness", f"CASE WHEN coalesce(version, '') = '' OR {_fill(_PLACEHOLDER, 'version')} OR NOT {_fill(_SEMVER, 'version')} THEN 'FAIL' ELSE 'PASS' END"),
    ("part-supplier", 14, "SHOULD", "Completeness", f"CASE WHEN supplier IS NULL OR {_fill(_TOKEN, 'supplier')} THEN 'WARN' ELSE 'PASS' END"),
    ("part-identifier", 15, "MUST_WHERE_AVAILABLE", "Accuracy", f"CASE WHEN purl IS NULL OR {_fill(_TOKEN, 'purl')} THEN 'WARN' WHEN {_fill(_PURL, 'purl')} OR regexp_matches(purl, '{_CPE}') THEN 'PASS' ELSE 'FAIL' END"),
)
_LABEL = "coalesce(nullif(purl, ''), nullif(name, '') || coalesce('@' || nullif(version, ''), ''), nullif(bom_ref, ''), '<unknown>')"
_OLD = "(fmt = 'cyclonedx' AND ver IN ('1.0', '1.1', '1.2')) OR (fmt = 'spdx' AND ver IN ('2.0', '2.1'))"
_TUPLE = "list_transform(list_filter(string_split(ver, '.'), lambda x: x <> ''), lambda x: TRY_CAST(x AS INT))"
_FOUND = f"""{_DOCS}, {_COMPS}, {_GRAPH}, n AS (SELECT doc_id, count(*) AS n FROM comps GROUP BY 1),
whole AS (SELECT * FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN graph USING (doc_id) LEFT JOIN orphans USING (doc_id)),
rules AS (
  {" UNION ALL ".join(f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, '{i}' AS rule_id, {k} AS ord, '{sev}' AS severity, '{cat}' AS category, {v} AS verdict, 'components[' || pos || ']:' || {_LABEL} AS path FROM comps SEMI JOIN docs USING (doc_id)" for i, k, sev, cat, v in _PART_RULES)}
  UNION ALL SELECT doc_id, -1, r.rule_id, r.ord, r.severity, r.category, 'WARN', 'components' FROM whole CROSS JOIN (VALUES {", ".join(f"('{i}', {k}, '{sev}', '{cat}')" for i, k, sev, cat, _ in _PART_RULES)}) r(rule_id, ord, severity, category) WHERE n IS NULL
  UNION ALL SELECT doc_id, -1, 'graph', 16, 'SHOULD', 'Completeness', CASE WHEN n IS NULL THEN 'PASS' WHEN coalesce(n_refs, 0) = 0 OR coalesce(n_orphans, 0) > 0 THEN 'WARN' ELSE 'PASS' END, 'dependencies' FROM whole
  UNION ALL SELECT doc_id, -1, 'doc-time', 11, 'SHOULD', 'Freshness', CASE WHEN doc_timestamp = '' OR {_fill(_TOKEN, 'doc_timestamp')} OR NOT {_RFC} THEN 'WARN' ELSE 'PASS' END, 'document' FROM docs
  UNION ALL SELECT doc_id, -1, 'doc-creator', 10, 'MUST', 'Provenance', CASE WHEN len(list_filter(creators, lambda x: x IS NOT NULL AND NOT {_fill(_TOKEN, 'x')})) = 0 OR len(list_filter(creators, lambda x: {_fill(_PLACEHOLDER, 'x')})) > 0 THEN 'FAIL' ELSE 'PASS' END, 'document' FROM docs
  UNION ALL SELECT doc_id, -1, 'schema-valid', 0, 'MUST', 'Accuracy', 'PASS', 'document' FROM docs
  UNION ALL SELECT doc_id, -1, 'schema-min-version', 1, 'MUST', 'Freshness', CASE WHEN (fmt = 'cyclonedx' AND {_TUPLE} < [1, 4]) OR (fmt = 'spdx' AND {_TUPLE} < [2, 2]) THEN 'FAIL' ELSE 'PASS' END, 'document.specVersion' FROM docs
  UNION ALL SELECT doc_id, -1, 'schema-version-not-deprecated', 2, 'MUST', 'Freshness', CASE WHEN {_OLD} THEN 'FAIL' ELSE 'PASS' END, 'document.specVersion' FROM docs)"""


def _found(spark: SparkSession, sf_dir: str, names: tuple[str, ...], passing: bool = False) -> DataFrame:
    return findings(binding.corpus(spark, sf_dir), [profiles.load(n) for n in names], passing=passing)


@_query(f"WITH {_FOUND} SELECT rule_id, severity, verdict, count(*) AS n FROM rules GROUP BY ALL")
def ref_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each rule by verdict, those that passed included."""
    return _found(spark, sf_dir, ("baseline",), True).groupBy("rule_id", "severity", "verdict").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_FOUND} SELECT doc_id, pos, rule_id, severity, category, verdict, path FROM rules WHERE verdict <> 'PASS'")
def ref_findings_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What did not pass under one profile, with the place of each finding."""
    return _found(spark, sf_dir, ("baseline",)).where(F.col("verdict") != "PASS").select("doc_id", "pos", "rule_id", "severity", "category", "verdict", "path")


@_query(f"WITH {_FOUND} SELECT doc_id, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'WARN') THEN 'WARN' ELSE 'PASS' END AS verdict, count(*) FILTER (verdict = 'FAIL' AND severity = 'MUST') AS must_violations FROM rules GROUP BY 1")
def ref_verdicts_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(_found(spark, sf_dir, ("baseline",))).drop("profile")


_RANK = "CASE verdict WHEN 'FAIL' THEN 0 ELSE 10 END + CASE severity WHEN 'MUST' THEN 0 WHEN 'MUST_WHERE_AVAILABLE' THEN 1 WHEN 'SHOULD' THEN 2 ELSE 3 END"


@_query(f"WITH {_FOUND} SELECT doc_id, CAST(issue_no AS INT) AS issue_no, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK}, ord, pos, rule_id) AS issue_no FROM rules WHERE verdict <> 'PASS') WHERE issue_no <= 3")
def ref_top_issues_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most serious findings of each document, in order."""
    return top_issues(_found(spark, sf_dir, ("baseline",))).select("doc_id", "issue_no", "rule_id")


@_query(f"WITH {_FOUND} SELECT doc_id, CASE WHEN n IS NULL THEN 'ok' WHEN coalesce(n_refs, 0) = 0 THEN 'dependency_completeness: no dependency relationships declared' WHEN coalesce(n_orphans, 0) > 0 THEN 'dependency_completeness: ' || n_orphans || ' component(s) absent from the dependency graph' ELSE 'ok' END AS message FROM whole")
def v_dependency_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, ("baseline",)).where("rule_id = 'graph'").select("doc_id", "message")


def _gate_rows(spark: SparkSession, sf_dir: str, rule: str, profile: str = "strict") -> DataFrame:
    return _found(spark, sf_dir, (profile,)).where(F.col("rule_id") == rule).select("doc_id", "verdict", "message")


@_query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN signed THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN signed THEN 'ok' ELSE 'SBOM is not signed' END AS message FROM docs")
def v_signed_with_x509(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate_rows(spark, sf_dir, "schema-require-signature")


@_query(f"WITH {_DOCS}, x AS (SELECT *, CASE WHEN fmt = 'cyclonedx' AND {_TUPLE} < [1, 4] THEN '1.4' WHEN fmt = 'spdx' AND {_TUPLE} < [2, 2] THEN '2.2' END AS least FROM docs) SELECT doc_id, CASE WHEN least IS NULL THEN 'PASS' ELSE 'FAIL' END AS verdict, coalesce(fmt || ' ' || ver || ' is below required minimum ' || least, 'ok') AS message FROM x")
def v_format_version_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate_rows(spark, sf_dir, "schema-min-version")


@_query(f"WITH {_DOCS} SELECT doc_id, CASE WHEN {_OLD} THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN {_OLD} THEN fmt || ' ' || ver || ' is deprecated (retired versions: ' || CASE fmt WHEN 'spdx' THEN '2.0, 2.1' ELSE '1.0, 1.1, 1.2' END || ')' ELSE 'ok' END AS message FROM docs")
def v_format_version_not_deprecated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate_rows(spark, sf_dir, "schema-version-not-deprecated", "baseline")


@_query()
def ref_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that did not pass, of both profiles, in one scan of the components."""
    return _found(spark, sf_dir, ("baseline", "strict")).where(F.col("verdict") != "PASS")


@_query()
def ref_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(_found(spark, sf_dir, ("baseline", "strict")))


@_query()
def ref_top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_issues(_found(spark, sf_dir, ("baseline",)))


@_query()
def ref_report_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = binding.raw_corpus(spark, sf_dir), profiles.load("baseline")
    return reports.console(findings(c, [p]), scoring.scores(scoring.signals(c), p))


@_query()
def ref_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = binding.raw_corpus(spark, sf_dir), profiles.load("strict")
    return reports.as_json(findings(c, [p]), scoring.scores(scoring.signals(c), p))


@_query()
def ref_report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(findings(binding.raw_corpus(spark, sf_dir), [profiles.load("strict")]))


@_query()
def ref_sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(findings(binding.raw_corpus(spark, sf_dir), [profiles.load("strict")]))


@_query("SELECT raw_id, CASE WHEN media LIKE 'cyclonedx%' THEN 'cyclonedx' ELSE 'spdx' END AS sbom_format FROM raw_sbom WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'")
def src_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = binding.texts(spark, sf_dir).select("raw_id", detect(F.col("payload")).alias("k"))
    return d.where(F.col("k.error").isNull()).select("raw_id", "k.sbom_format")


@_query()
def src_detect_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = binding.texts(spark, sf_dir).select("raw_id", detect(F.col("payload")).alias("k"))
    return d.where(F.col("k.error").isNotNull()).select("raw_id", "k.error")


def _json_text(node: str, path: str) -> str:
    """A scalar member as the reader takes it; containers are no text."""
    return f"CASE json_type({node}, '{path}') WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL WHEN 'BOOLEAN' THEN upper({node}->>'{path}'[1]) || ({node}->>'{path}')[2:] ELSE {node}->>'{path}' END"


def _json_list(node: str, name: str) -> str:
    return f"json_each(CASE json_type({node}, '$.{name}') WHEN 'ARRAY' THEN {node}->'$.{name}' END)"


#: Raw documents, their components (packages) in order, and the digests of these.
_RAW = f"""docs AS (SELECT raw_id AS doc_id, CASE WHEN media LIKE 'cyclonedx%' THEN 'cyclonedx' ELSE 'spdx' END AS fmt, payload AS p FROM raw_sbom WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
listed AS (
  SELECT doc_id, fmt, CAST(e.key AS BIGINT) AS ix, e.value AS node FROM (SELECT * FROM docs WHERE fmt = 'cyclonedx'), {_json_list('p', 'components')} e WHERE e.type = 'OBJECT'
  UNION ALL SELECT doc_id, fmt, CAST(e.key AS BIGINT), e.value FROM (SELECT * FROM docs WHERE fmt = 'spdx'), {_json_list('p', 'packages')} e WHERE e.type = 'OBJECT'),
comps AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS pos FROM listed),
entries AS (
  SELECT doc_id, pos, CAST(e.key AS BIGINT) AS ix, lower(e.value->>'$.alg') AS alg, {_json_text('e.value', '$.content')} AS v FROM (SELECT * FROM comps WHERE fmt = 'cyclonedx'), {_json_list('node', 'hashes')} e WHERE e.type = 'OBJECT' AND json_type(e.value, '$.alg') = 'VARCHAR'
  UNION ALL SELECT doc_id, pos, CAST(e.key AS BIGINT), lower(e.value->>'$.algorithm'), {_json_text('e.value', '$.checksumValue')} FROM (SELECT * FROM comps WHERE fmt = 'spdx'), {_json_list('node', 'checksums')} e WHERE e.type = 'OBJECT' AND json_type(e.value, '$.algorithm') = 'VARCHAR'),
digests AS (SELECT doc_id, pos, alg, min(ix) AS ix, arg_max(v, ix) AS v FROM entries WHERE trim(v, E' \t\n\r') <> '' GROUP BY ALL)"""


@_query(f"WITH {_RAW} SELECT doc_id, count(*) AS n FROM comps GROUP BY 1")
def src_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.raw_corpus(spark, sf_dir).components.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {_RAW} SELECT doc_id, fmt AS sbom_format, CASE fmt WHEN 'cyclonedx' THEN {_json_text('p', '$.metadata.component.name')} ELSE {_json_text('p', '$.name')} END AS name,
CASE fmt WHEN 'cyclonedx' THEN {_json_text('p', '$.serialNumber')} ELSE {_json_text('p', '$.documentNamespace')} END AS namespace,
CASE fmt WHEN 'cyclonedx' THEN {_json_text('p', '$.metadata.timestamp')} ELSE regexp_replace({_json_text('p', '$.creationInfo.created')}, '[Zz]$', '+00:00') END AS timestamp FROM docs""")
def src_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.raw_corpus(spark, sf_dir).documents.select("doc_id", "sbom_format", "name", "namespace", "timestamp")


def _spdx_ref(kinds: str) -> str:
    return f"(SELECT arg_min_null({_json_text('r.value', '$.referenceLocator')}, CAST(r.key AS INT)) FROM {_json_list('node', 'externalRefs')} r WHERE r.type = 'OBJECT' AND json_type(r.value, '$.referenceType') = 'VARCHAR' AND r.value->>'$.referenceType' IN ({kinds}))"


_FIELDS = f"""parts AS (SELECT doc_id, pos, {_json_text('node', '$.bom-ref').replace('$.bom-ref', '$."bom-ref"')} AS bom_ref, {_json_text('node', '$.name')} AS name, {_json_text('node', '$.version')} AS version, {_json_text('node', '$.purl')} AS purl, {_json_text('node', '$.cpe')} AS cpe FROM comps WHERE fmt = 'cyclonedx'
UNION ALL SELECT doc_id, pos, {_json_text('node', '$.SPDXID')}, {_json_text('node', '$.name')}, {_json_text('node', '$.versionInfo')}, {_spdx_ref("'purl'")}, {_spdx_ref("'cpe23Type', 'cpe22Type'")} FROM comps WHERE fmt = 'spdx')"""


@_query(f"WITH {_RAW}, {_FIELDS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, bom_ref, name, version, purl, cpe FROM parts")
def src_component_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifying fields of every component and package of the raw documents."""
    return binding.raw_corpus(spark, sf_dir).components.select("doc_id", "pos", "bom_ref", "name", "version", "purl", "cpe")


@_query(f"WITH {_RAW} SELECT doc_id, CAST(pos AS BIGINT) AS pos, alg, v AS digest FROM digests")
def src_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = binding.raw_corpus(spark, sf_dir).components
    return c.select("doc_id", "pos", F.explode("hashes").alias("alg", "digest"))


@_query()
def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.raw_corpus(spark, sf_dir).files.select("doc_id", "pos", "name", F.to_json("hashes").alias("hashes"))


@_query(f"WITH {_RAW}, f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(e.key AS INT)) - 1 AS pos, e.value AS node FROM (SELECT * FROM docs WHERE fmt = 'spdx'), {_json_list('p', 'files')} e WHERE e.type = 'OBJECT') SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_json_text('node', '$.SPDXID')} AS spdx_id, {_json_text('node', '$.fileName')} AS name, {_json_text('node', '$.copyrightText')} AS copyright FROM f")
def src_spdx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = binding.raw_corpus(spark, sf_dir)
    return c.files.join(c.documents.where("sbom_format = 'spdx'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "pos", "spdx_id", "name", "copyright")


@_query()
def ref_schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.raw_corpus(spark, sf_dir).documents.select("doc_id", "sbom_format", "spec_version", F.size("schema_errors").alias("n_errors"), F.get("schema_errors", F.lit(0)).alias("first_error"))


_PLAIN_ALG = "replace(replace(alg, '-', ''), '_', '')"
_LENGTHS = "CASE " + _PLAIN_ALG + " " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in DIGEST_LENGTHS.items()) + " END"


def _sql_quoted(x: str) -> str:
    t = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"
    return f"""CASE WHEN contains({t}, '''') AND NOT contains({t}, '"') THEN '"' || {t} || '"' ELSE '''' || replace({t}, '''', '\\''') || '''' END"""


@_query(f"""WITH {_RAW}, x AS (SELECT *, trim(v, E' \t\n\r') AS t, {_LENGTHS} AS want FROM digests),
y AS (SELECT *, CASE WHEN NOT regexp_full_match(t, '[a-fA-F0-9]+') THEN alg || ': digest is not hexadecimal (' || {_sql_quoted('t[1:16]')} || ')' WHEN length(t) <> want THEN alg || ': digest is ' || length(t) || ' hex chars, expected ' || want || ' for ' || alg END AS why FROM x)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, arg_min(why, ix) AS why FROM y WHERE why IS NOT NULL GROUP BY ALL""")
def v_hash_wellformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.raw_corpus(spark, sf_dir).components.select("doc_id", "pos", F.expr(REGISTRY["hash_wellformed"](Value("map", "hashes"), {}, {})).alias("why")).where(F.col("why").isNotNull())


@_query(f"""WITH {_RAW}, k AS (SELECT doc_id, pos, list_sort(list(alg)) AS algs, bool_or({_PLAIN_ALG} IN ('sha256', 'sha512')) AS ok FROM digests GROUP BY ALL)
SELECT c.doc_id, CAST(c.pos AS BIGINT) AS pos, CASE WHEN algs IS NULL THEN 'no hashes present' ELSE 'no hash in required set [''SHA-256'', ''SHA-512''] (have [''' || array_to_string(algs, ''', ''') || '''])' END AS why FROM comps c LEFT JOIN k ON k.doc_id = c.doc_id AND k.pos = c.pos WHERE NOT coalesce(ok, false)""")
def v_hash_algorithm_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.raw_corpus(spark, sf_dir).components.select("doc_id", "pos", F.expr(REGISTRY["hash_algorithm_in_set"](Value("map", "hashes"), {}, {"algs": ["SHA-256", "SHA-512"]})).alias("why")).where(F.col("why").isNotNull())


@_query(f"""WITH {_RAW}, {_FIELDS}, c AS (SELECT *, trim(cpe, E' \t\n\r') AS s FROM parts WHERE cpe IS NOT NULL), n AS (SELECT *, len(string_split(regexp_replace(s, '\\\\.', '', 'g'), ':')) AS k FROM c)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, cpe, CASE WHEN cpe = '' OR regexp_matches(s, '{_CPE}') THEN NULL WHEN starts_with(s, 'cpe:2.3:') THEN {_sql_quoted('cpe')} || ' is not a well-formed CPE 2.3 name' || CASE WHEN k <> 13 THEN ': expected 13 colon-separated components, found ' || k ELSE ' (NIST IR 7695 §6.2.2)' END
WHEN regexp_matches(s, '{CPE_22}') THEN NULL WHEN starts_with(lower(s), 'cpe:/') THEN {_sql_quoted('cpe')} || ' is not a well-formed CPE 2.2 URI (NIST IR 7695 §6.1)' ELSE {_sql_quoted('cpe')} || ' is not a CPE name (expected a ''cpe:2.3:'' or ''cpe:/'' prefix)' END AS why FROM n""")
def v_cpe_wellformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.raw_corpus(spark, sf_dir).components.select("doc_id", "pos", "cpe", F.expr(REGISTRY["cpe_wellformed"](Value("scalar", "cpe"), {}, {})).alias("why")).where(F.col("cpe").isNotNull())


@_query()
def lic_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each distinct licence text resolves, with the rows that hold it."""
    d = binding.corpus(spark, sf_dir).components.select(F.explode("license_declarations").alias("d")).select("d.*")
    return d.groupBy("raw", "source", "normalized", "method").agg(F.count(F.lit(1)).alias("n"))


_IDS = "ids AS (SELECT license_id AS raw, family FROM license_reference)"


@_query(f"WITH {_IDS} SELECT d.decl_id, CASE WHEN raw LIKE '%-or-later' THEN 'flag_for_review' ELSE 'approve' END AS action FROM license_declaration d JOIN ids USING (raw)")
def lic_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy actions of the declarations that are entries of the licence list as they stand."""
    p, tables, ids = _policy(spark, sf_dir)
    d = spark.read.parquet(f"{sf_dir}/license_declaration.parquet").where(F.col("raw").isNotNull())
    known = spark.read.parquet(f"{sf_dir}/license_reference.parquet").select(F.col("license_id").alias("raw"))
    return d.join(known, "raw", "left_semi").select("decl_id", licenses.decide(F.col("raw"), p, "distribution", tables).alias("action"))


def _policy(spark: SparkSession, sf_dir: str) -> tuple[licenses.Policy, licenses.LicenseTables, list[str]]:
    """A policy over the licence list: what allows later versions is looked at by people, all else listed is approved."""
    ids = binding.reference_licenses(spark, sf_dir)
    kinds = {i: "open-ended" if i.endswith("-or-later") else "fixed" for i in ids}
    return licenses.Policy(default="flag_for_review", types=kinds, conditions=[({"license_type": "open-ended"}, "flag_for_review"), ({"license_type": "fixed"}, "approve")]), licenses.tables_with(ids), ids


@_query()
def lic_policy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy actions of all declarations: OR takes the least, AND the most restrictive."""
    p, tables, _ = _policy(spark, sf_dir)
    d = spark.read.parquet(f"{sf_dir}/license_declaration.parquet").where(F.col("raw").isNotNull())
    return d.withColumn("action", licenses.decide(F.col("raw"), p, "distribution", tables)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_IDS} SELECT decl_id, CASE WHEN lower(trim(d.raw, E' \\t\\n\\r')) IN ('', 'noassertion', 'none', 'n/a', 'unknown') THEN 'declared-unknown' WHEN i.raw IS NOT NULL THEN 'spdx-expression' ELSE 'case-corrected' END AS method, i.raw AS normalized FROM license_declaration d LEFT JOIN ids i ON lower(i.raw) = lower(trim(d.raw, E' \\t\\n\\r')) WHERE d.raw IS NOT NULL AND (i.raw = trim(d.raw, E' \\t\\n\\r') OR {_fill(_TOKEN, 'd.raw')})")
def lic_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How declarations resolve that are a list entry as they stand or declare nothing."""
    ids = binding.reference_licenses(spark, sf_dir)
    d = spark.read.parquet(f"{sf_dir}/license_declaration.parquet").where(F.col("raw").isNotNull()).select("decl_id", "raw", licenses.normalise(F.col("raw"), licenses.tables_with(ids)).alias("x"))
    return d.where((F.col("x.method") == "declared-unknown") | ((F.col("x.method") == "spdx-expression") & (F.col("x.normalized") == F.trim("raw")) & F.col("x.normalized").isin(ids))).select("decl_id", "x.method", "x.normalized")


@_query("SELECT * FROM (VALUES ('baseline', CAST(7 AS BIGINT)), ('strict', CAST(9 AS BIGINT))) t(profile, n_rules)")
def ref_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, len(profiles.load(n).rules)) for n in profiles.catalog()], "profile string, n_rules long")
