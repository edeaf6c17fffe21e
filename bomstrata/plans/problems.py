"""Data-processing queries over the SBOM tables; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bomstrata.operators import hierarchy, nested, orphans, profile, timestamps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.find_cases(spark, f"{sf_dir}/spdx_package.parquet", "pkg_row_id", "load_no")


def p1_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).where("case_kind = 'violation'").select("column_name", "case_key")


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(spark, f"{sf_dir}/spdx_package.parquet", "load_no")


def p1_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.footer_profile(spark, f"{sf_dir}/spdx_package.parquet", "load_no", ["version_info", "purl", "supplier"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.normalise_timestamps(table(spark, sf_dir, "sbom_document"), "doc_timestamp", "site_zone", "doc_row_id")


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.find_orphans(table(spark, sf_dir, "cdx_dependency"), table(spark, sf_dir, "cdx_component"), table(spark, sf_dir, "sbom_document"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).withColumnRenamed("row_id", "dep_row_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf_dir), "cdx_dependency")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchies(table(spark, sf_dir, "cdx_dependency"), table(spark, sf_dir, "cdx_component"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(table(spark, sf_dir, "cdx_dependency"), table(spark, sf_dir, "cdx_component"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_items(table(spark, sf_dir, "raw_sbom"))


def p7_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_owners(table(spark, sf_dir, "raw_sbom"))


QUERIES = {f.__name__: f for f in (p1_found, p1_violations, p1_profile, p1_footers, p3_found, p4_found, p4_report, p5_found, p5_descendants, p7_found, p7_owners)}

_TOKENS = "('', 'noassertion', 'none', 'n/a', 'unknown')"

_ORPHANS = r"""
WITH refs AS (
  SELECT dep_row_id, sbom_id, loaded_at, 'ref' AS field_name, dep_ref AS target_ref FROM cdx_dependency
  UNION ALL
  SELECT dep_row_id, sbom_id, loaded_at, 'dependsOn', unnest(list_distinct(depends_on)) FROM cdx_dependency),
split AS (
  SELECT *, regexp_matches(target_ref, '^urn:cdx:[^/#]+/[0-9]+#', 's') AS link,
         regexp_extract(target_ref, '^urn:cdx:([^/#]+)/([0-9]+)#', 1) AS serial, TRY_CAST(regexp_extract(target_ref, '^urn:cdx:([^/#]+)/([0-9]+)#', 2) AS BIGINT) AS version
  FROM refs WHERE target_ref IS NOT NULL),
docs AS (SELECT regexp_replace(serial_number, '^urn:uuid:', '') AS serial, bom_version AS version, min(sbom_id) AS target FROM sbom_document WHERE serial_number IS NOT NULL AND bom_version IS NOT NULL GROUP BY 1, 2),
aimed AS (
  SELECT s.*, CASE WHEN link THEN d.target ELSE s.sbom_id END AS target, CASE WHEN link THEN url_decode(regexp_replace(target_ref, '^urn:cdx:[^/#]+/[0-9]+#', '')) ELSE target_ref END AS ref
  FROM split s LEFT JOIN docs d ON s.link AND s.serial = d.serial AND s.version = d.version),
parents AS (SELECT sbom_id, bom_ref, bool_or(deleted_at IS NOT NULL) AS gone, min(loaded_at) AS at FROM cdx_component WHERE bom_ref IS NOT NULL GROUP BY 1, 2),
judged AS (
  SELECT a.dep_row_id, a.field_name, a.target_ref, CASE WHEN p.bom_ref IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.at > a.loaded_at THEN 'late' ELSE '' END AS outcome, strftime(a.loaded_at, '%Y-%m') AS period
  FROM aimed a LEFT JOIN parents p ON p.sbom_id = a.target AND p.bom_ref = a.ref)
"""

_VERSION = r"(v?\d+\.\d+\.\d+([-+][0-9A-Za-z.-]+)?|\d{4}([.\-]\d{1,2}){1,2}([.\-][0-9A-Za-z]+)?)"
_PLACEHOLDER = r"(?i)\s*(todo|tbd|changeme|change[_-]?me|xxx+|n/?a|unknown|example|placeholder|foo|bar|\$\{.*\}|<.*>|0\.0\.0|1\.0\.0-snapshot)\s*"
_PURL = r"[pP][kK][gG]:/*[A-Za-z][A-Za-z0-9.+\-]*/+([^@?#\s]*/)?[^/@?#\s]+/*(@[^?#\s]*)?(\?([A-Za-z._\-][A-Za-z0-9._\-]*=[^#&\s]*(&[A-Za-z._\-][A-Za-z0-9._\-]*=[^#&\s]*)*)?)?(#\S*)?"
_GOOD = {
    "version_info": f"(regexp_full_match(version_info, '{_VERSION}') AND NOT regexp_full_match(version_info, '{_PLACEHOLDER}'))", "purl": f"regexp_full_match(purl, '{_PURL}')",
    "supplier": r"regexp_full_match(supplier, '(Organization|Person): \s*[^(\s].*', 's')",
}


def _profile_sql(c: str) -> str:
    token = f"(lower(trim({c}, E' \\t\\n\\r')) IN {_TOKENS})"
    text = f"CASE WHEN NOT {token} THEN {c} END"
    return (
        f"SELECT '{c}' AS column_name, CAST(load_no AS BIGINT) AS load_no, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(*) FILTER ({token}) AS n_tokens, count(*) FILTER ({c} IS NOT NULL AND NOT {token} AND NOT {_GOOD[c]}) AS n_violations,"
        f" count(DISTINCT {text}) AS n_distinct, min({text}) AS low, max({text}) AS high FROM spdx_package GROUP BY ALL"
    )


def _list(node: str, name: str) -> str:
    """Elements of a member; a lone object stands for a list of one."""
    return f"json_each(CASE json_type({node}, '$.{name}') WHEN 'ARRAY' THEN {node}->'$.{name}' WHEN 'OBJECT' THEN json_array({node}->'$.{name}') END)"


def _text(node: str, path: str) -> str:
    return f"CASE WHEN json_type({node}, '{path}') = 'VARCHAR' AND trim({node}->>'{path}', E' \\t\\n\\r') <> '' THEN {node}->>'{path}' END"


def _pairs(kind: str, owner: str, name: str, key: str, value: str) -> str:
    return f"SELECT raw_id, node_path, '{kind}' AS item_kind, CAST(e.key AS INT) AS item_pos, {_text('e.value', '$.' + key)} AS item_key, {_text('e.value', '$.' + value)} AS item_value FROM (SELECT * FROM {owner}), {_list('node', name)} e WHERE e.type = 'OBJECT'"


_ITEMS = f"""
WITH RECURSIVE docs AS (SELECT raw_id, payload AS p FROM raw_sbom WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
tops AS (
  SELECT raw_id, 'metadata.component' AS node_path, p->'$.metadata.component' AS node FROM docs WHERE json_type(p, '$.metadata.component') = 'OBJECT'
  UNION ALL SELECT raw_id, 'components[' || e.key || ']', e.value FROM docs, {_list('p', 'components')} e WHERE e.type = 'OBJECT'),
own AS (
  SELECT * FROM tops
  UNION ALL SELECT o.raw_id, o.node_path || '.components[' || e.key || ']', e.value FROM own o, {_list('o.node', 'components')} e WHERE e.type = 'OBJECT'),
spdx AS (
  SELECT raw_id, 'packages[' || e.key || ']' AS node_path, e.value AS node FROM docs, {_list('p', 'packages')} e WHERE e.type = 'OBJECT'
  UNION ALL SELECT raw_id, 'files[' || e.key || ']', e.value FROM docs, {_list('p', 'files')} e WHERE e.type = 'OBJECT'),
lic AS (SELECT raw_id, node_path, CAST(e.key AS INT) AS pos, {_text('e.value', '$.expression')} AS x, {_text('e.value', '$.license.id')} AS i, {_text('e.value', '$.license.name')} AS n FROM (SELECT * FROM own), {_list('node', 'licenses')} e WHERE e.type = 'OBJECT'),
items AS (
  {_pairs('hash', 'own', 'hashes', 'alg', 'content')} UNION ALL {_pairs('external_ref', 'own', 'externalReferences', 'type', 'url')}
  UNION ALL {_pairs('hash', 'spdx', 'checksums', 'algorithm', 'checksumValue')} UNION ALL {_pairs('external_ref', 'spdx', 'externalRefs', 'referenceType', 'referenceLocator')}
  UNION ALL SELECT raw_id, node_path, 'license', pos, CASE WHEN x IS NOT NULL THEN 'expression' WHEN i IS NOT NULL THEN 'id' ELSE 'name' END, coalesce(x, i, n) FROM lic)
SELECT * FROM items WHERE item_key IS NOT NULL AND item_value IS NOT NULL"""

_REACH = """
WITH RECURSIVE refs AS (SELECT DISTINCT sbom_id, bom_ref FROM cdx_component WHERE bom_ref IS NOT NULL),
raw AS (SELECT sbom_id, dep_ref AS src, unnest(depends_on) AS dst FROM cdx_dependency),
ends AS (SELECT DISTINCT sbom_id, node FROM (SELECT sbom_id, dep_ref AS node FROM cdx_dependency UNION ALL SELECT sbom_id, dst FROM raw)),
nodes AS (SELECT e.sbom_id, e.node FROM ends e JOIN refs r ON r.sbom_id = e.sbom_id AND r.bom_ref = e.node),
edges AS (SELECT DISTINCT r.sbom_id, r.src, r.dst FROM raw r JOIN nodes a ON a.sbom_id = r.sbom_id AND a.node = r.src JOIN nodes b ON b.sbom_id = r.sbom_id AND b.node = r.dst),
reach(sbom_id, anc, node) AS (SELECT sbom_id, src, dst FROM edges UNION SELECT r.sbom_id, r.anc, e.dst FROM reach r JOIN edges e ON e.sbom_id = r.sbom_id AND e.src = r.node)"""

#: Owners with their parents; members that are no text are null.
_OWNER_ROWS = """,
named AS (
  SELECT raw_id, node_path, 'component' AS kind, node, 'bom-ref' AS r, 'name' AS n, 'version' AS v FROM own
  UNION ALL SELECT raw_id, node_path, CASE WHEN node_path LIKE 'packages%' THEN 'package' ELSE 'file' END, node, 'SPDXID', CASE WHEN node_path LIKE 'packages%' THEN 'name' ELSE 'fileName' END, CASE WHEN node_path LIKE 'packages%' THEN 'versionInfo' ELSE 'version' END FROM spdx)
SELECT raw_id, node_path, CASE WHEN node_path = 'metadata.component' THEN '' ELSE regexp_replace(node_path, '\\.?[a-z]+\\[[0-9]+\\]$', '') END AS parent_path, CAST(coalesce(nullif(regexp_extract(node_path, '\\[([0-9]+)\\]$', 1), ''), '0') AS INT) AS node_pos, kind AS node_kind,
  CASE json_type(node, '$."' || r || '"') WHEN 'VARCHAR' THEN node->>('$."' || r || '"') END AS node_ref, CASE json_type(node, '$."' || n || '"') WHEN 'VARCHAR' THEN node->>('$."' || n || '"') END AS node_name, CASE json_type(node, '$."' || v || '"') WHEN 'VARCHAR' THEN node->>('$."' || v || '"') END AS node_version
FROM named"""

ORACLE = {
    "p1_profile": " UNION ALL ".join(map(_profile_sql, _GOOD)),
    "p1_violations": " UNION ALL ".join(f"SELECT '{c}' AS column_name, pkg_row_id AS case_key FROM spdx_package WHERE {c} IS NOT NULL AND NOT (lower(trim({c}, E' \\t\\n\\r')) IN {_TOKENS}) AND NOT {_GOOD[c]}" for c in _GOOD),
    "p7_found": _ITEMS,
    "p7_owners": _ITEMS[: _ITEMS.index(",\nlic AS")] + _OWNER_ROWS,
    "p4_found": _ORPHANS + "SELECT * FROM judged WHERE outcome <> ''",
    "p4_report": _ORPHANS + "SELECT 'cdx_dependency' AS table_name, field_name, outcome, period, count(*) AS n_references, count(DISTINCT target_ref) AS n_targets FROM judged WHERE outcome <> '' GROUP BY ALL",
    "p1_footers": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_nulls, min({c}) AS low, max({c}) AS high, count(DISTINCT {c}) AS n_distinct, CAST(0 AS BIGINT) AS n_unsettled FROM spdx_package"
        for c in ("version_info", "purl", "supplier")
    ),
    "p5_descendants": _REACH + " SELECT sbom_id, anc AS ancestor_ref, node AS node_ref FROM reach WHERE anc <> node",
    "p5_found": _REACH + """,
roots AS (SELECT n.* FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.sbom_id = n.sbom_id AND e.dst = n.node)),
walk(sbom_id, node, root_ref, depth, node_path) USING KEY (sbom_id, node) AS (
  SELECT sbom_id, node, node, 0, node FROM roots
  UNION
  (SELECT w.sbom_id, e.dst, arg_min(w.root_ref, w.node_path || ' > ' || e.dst), min(w.depth + 1), min(w.node_path || ' > ' || e.dst)
   FROM walk w JOIN edges e ON e.sbom_id = w.sbom_id AND e.src = w.node LEFT JOIN recurring.walk k ON k.sbom_id = e.sbom_id AND k.node = e.dst
   WHERE k.node IS NULL GROUP BY w.sbom_id, e.dst)),
below AS (SELECT sbom_id, anc AS node, count(*) FILTER (anc <> node) AS n, bool_or(anc = node) AS cyclic FROM reach GROUP BY 1, 2),
kinds AS (SELECT n.sbom_id, n.node, w.root_ref, w.depth, w.node_path, coalesce(b.n, 0) AS n, CASE WHEN coalesce(b.cyclic, false) THEN 'cycle' WHEN w.node IS NOT NULL THEN 'placed' ELSE 'rootless' END AS kind
  FROM nodes n LEFT JOIN walk w ON w.sbom_id = n.sbom_id AND w.node = n.node LEFT JOIN below b ON b.sbom_id = n.sbom_id AND b.node = n.node)
SELECT sbom_id, node AS node_ref, kind, CASE WHEN kind = 'placed' THEN root_ref ELSE '' END AS root_ref, CAST(CASE WHEN kind = 'placed' THEN depth ELSE -1 END AS INTEGER) AS depth, CAST(n AS INTEGER) AS n_descendants, CASE WHEN kind = 'placed' THEN node_path ELSE '' END AS node_path
FROM kinds""",
}
