"""Profiles evaluated over a corpus: findings, verdicts, and reports.

A corpus is a star of DataFrames (``Corpus``). The checks of all rules of all profiles are SQL texts; equal texts are
one check, whichever rules and profiles ask for it. Each table is scanned once: a target's checks become one array of
failures, which is exploded over the literal table of the rules that each check serves. What belongs to a whole
document (versions, signature, the dependency graph) is aggregated first, one row per document, and written once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomstrata.operators import licenses
from bomstrata.operators.profiles import Profile, ProfileError, Rule
from bomstrata.operators.validators import REGISTRY, Value, chain, lit, load_plugins
from bomstrata.session import cut

SCALARS = {
    "document": ("name", "namespace", "timestamp", "sbom_version", "supplier", "data_license", "signed", "sbom_format", "spec_version"),
    "component": ("bom_ref", "name", "version", "type", "purl", "cpe", "supplier", "author", "publisher", "identity"),
    "file": ("spdx_id", "name", "copyright", "identity"),
}
LISTS = {"document": ("creators", "tools", "tool_versions", "lifecycles"), "component": ("licenses", "external_refs"), "file": ("licenses",)}
MAPS = {"document": (), "component": ("hashes",), "file": ("hashes",)}
CONTEXT = ("sbom_format", "spec_version", "version_tuple", "signed", "vex", "n_components", "n_files", "n_refs", "n_orphans")


#: Documents whose ids (8 bytes each) are broadcast to tell targets of known documents; more are joined by shuffle.
BROADCAST_DOCUMENTS = 500_000


@dataclass
class Corpus:
    """``documents``: doc_id and document fields, ``schema_errors``; ``components`` and ``files``: doc_id, pos and their
    fields; ``edges``: doc_id, src, dst (null dst: an entry without targets)."""

    documents: DataFrame
    components: DataFrame
    files: DataFrame
    edges: DataFrame


def identity(*names: str) -> Column:
    """The label of a target: purl, cpe, name@version, reference; empty texts do not count."""
    filled = lambda n: F.nullif(F.col(n), F.lit(""))
    parts = []
    for n in names:
        parts.append(F.when(filled("name").isNotNull(), F.concat(F.col("name"), F.coalesce(F.concat(F.lit("@"), filled("version")), F.lit("")))) if n == "name@version" else filled(n))
    return F.coalesce(*parts, F.lit("<unknown>"))


def context(c: Corpus) -> DataFrame:
    """One row per document with what its targets may need: ``doc_id`` and ``CONTEXT``.

    A component is an orphan if it has a reference or a purl and neither is in the dependency graph; one pass over the
    components finds that, together with their number and their vulnerability references.
    """
    refs = c.edges.select("doc_id", F.explode(F.array("src", "dst")).alias("ref")).where(F.col("ref").isNotNull()).distinct()
    n_refs = refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refs"))
    known = lambda name: refs.select("doc_id", F.col("ref").alias(name), F.lit(True).alias(f"{name}_known"))
    k = c.components.select("doc_id", "bom_ref", "purl", F.exists("external_refs", lambda x: F.lower(x).contains("vex") | F.lower(x).contains("vulnerability")).alias("vex_ref"))
    k = k.join(known("bom_ref"), ["doc_id", "bom_ref"], "left").join(known("purl"), ["doc_id", "purl"], "left")
    named = (F.coalesce("bom_ref", F.lit("")) != "") | (F.coalesce("purl", F.lit("")) != "")
    parts = k.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_components"), F.max("vex_ref").alias("vex_ref"), F.count_if(named & F.col("bom_ref_known").isNull() & F.col("purl_known").isNull()).alias("n_orphans"))
    files = c.files.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_files"))
    d = c.documents
    for x in (parts, files, n_refs):
        d = d.join(x, "doc_id", "left")
    numbers = F.transform(F.filter(F.split("spec_version", r"\."), lambda x: x != ""), lambda x: x.try_cast("int"))
    stop = F.array_position(F.transform(numbers, lambda x: x.isNull()), True)
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    own = F.lower(F.coalesce("raw", F.lit("")))
    return d.select(
        "doc_id", "sbom_format", "spec_version", F.when(stop > 0, F.slice(numbers, F.lit(1), (stop - 1).cast("int"))).otherwise(numbers).alias("version_tuple"), F.coalesce("signed", F.lit(False)).alias("signed"),
        (F.coalesce("vex_ref", F.lit(False)) | own.contains("vex") | own.contains("vulnerability")).alias("vex"), zero("n_components"), zero("n_files"), zero("n_refs"), zero("n_orphans"),
    )


def _value(scope: str, name: str) -> Value:
    for kind, fields in (("scalar", SCALARS), ("list", LISTS), ("map", MAPS)):
        if name in fields.get(scope, ()):
            return Value(kind, f"`{name}`")
    return Value("scalar", f"get_json_object(raw, {lit('$.' + name)})") if name and scope != "dependency" else Value("none")


def _contextual(scope: str) -> dict[str, str]:
    ctx = {n: f"_c.{n}" for n in CONTEXT}
    own = scope == "component"
    ctx["hashes"] = "hashes" if scope in ("component", "file") else "CAST(NULL AS MAP<STRING, STRING>)"
    ctx["license_declarations"] = "license_declarations" if own else "CAST(NULL AS ARRAY<STRUCT<raw: STRING, source: STRING, normalized: STRING, method: STRING>>)"
    ok = f"filter({ctx['license_declarations']}, d_ -> d_.normalized IS NOT NULL)"
    ctx["valid_expressions"] = f"coalesce(concat(transform({ok}, d_ -> d_.normalized), transform({ok}, d_ -> d_.raw)), CAST(array() AS ARRAY<STRING>))"
    return ctx


@dataclass(frozen=True)
class Check:
    """SQL of the reason (null: passed) and of whether data is there."""

    reason: str
    there: str = "true"


def compile_check(rule: Rule, scope: str) -> Check:
    """Of several fields the first with a value counts."""
    values = [_value(scope, f) for f in rule.fields] or [Value("none")]
    ctx = _contextual(scope)
    reason, there = chain(values[-1], ctx, rule.validators), values[-1].has_value()
    for v in reversed(values[:-1]):
        reason, there = f"IF({v.has_value()}, {chain(v, ctx, rule.validators)}, {reason})", f"({v.has_value()} OR {there})"
    return Check(reason, there)


_RULE = ("profile", "ord", "rule_id", "layer", "severity", "category", "citation", "path")


class Plan:
    """Distinct checks of one scope, and the rules that each of them serves."""

    def __init__(self) -> None:
        self.checks: dict[Check, int] = {}
        self.rules: list[list[str]] = []

    def add(self, check: Check, *rule) -> None:
        at = self.checks.setdefault(check, len(self.checks))
        if at == len(self.rules):
            self.rules.append([])
        self.rules[at].append(self.literal(*rule))

    @staticmethod
    def literal(*rule) -> str:
        return "named_struct(" + ", ".join(f"'{n}', {lit(x)}" for n, x in zip(_RULE, rule)) + ")"

    def over(self, df: DataFrame, passing: bool) -> DataFrame:
        """The findings on the targets of ``df`` (doc_id, pos, path); without ``passing`` only what did not pass."""
        each = ", ".join(f"named_struct('k', {k}, 'reason', {c.reason}, 'there', coalesce({c.there}, false))" for c, k in self.checks.items())
        rules = f"array({', '.join(f'array({chr(44).join(r)})' for r in self.rules)})"
        d = df.select("doc_id", "pos", "at", F.expr(f"explode(array({each}))").alias("f"))  # no higher-order function around the checks: it would keep them out of generated code
        d = d if passing else d.where(F.col("f.reason").isNotNull())
        d = d.select("doc_id", "pos", "at", "f", F.expr(f"explode(element_at({rules}, f.k + 1))").alias("r"))
        bad = "CASE r.severity WHEN 'MUST' THEN 'FAIL' WHEN 'MUST_WHERE_AVAILABLE' THEN IF(f.there, 'FAIL', 'WARN') ELSE 'WARN' END"
        return d.select(
            "doc_id", "pos", "r.profile", "r.ord", "r.rule_id", "r.layer", "r.severity", "r.category", F.expr(f"IF(f.reason IS NULL, 'PASS', {bad})").alias("verdict"), "r.citation",
            F.coalesce("r.path", "at").alias("path"), F.coalesce("f.reason", F.lit("ok")).alias("message"),
        )


def _without_targets(docs: DataFrame, rules: list[str], message: str) -> DataFrame:
    d = docs.select("doc_id", F.lit(-1).cast("long").alias("pos"), F.expr(f"explode(array({', '.join(rules)}))").alias("r"))
    return d.select("doc_id", "pos", "r.profile", "r.ord", "r.rule_id", "r.layer", "r.severity", "r.category", F.lit("WARN").alias("verdict"), "r.citation", "r.path", F.lit(message).alias("message"))


def _refuse(profiles: list[Profile], policy: licenses.Policy | None) -> None:
    load_plugins()
    for p in profiles:
        if p.withdrawn:
            raise ProfileError(f"profile {p.id!r} is withdrawn: {p.withdrawn}")
        if p.engine and policy is None and not p.policy_path:
            raise ProfileError(f"profile {p.id!r} asks for a licence policy, and none is given")
        for r in p.rules:
            for name, _ in r.validators:
                if name not in REGISTRY:
                    raise ProfileError(f"profile {p.id!r}, rule {r.id!r}: unknown validator {name!r}")


def _gate(p: Profile) -> list[tuple]:
    """What a profile asks of the document's format: (id, category, check, citation, path)."""
    none, ctx = Value("none"), {n: f"_c.{n}" for n in CONTEXT}
    asked = [
        (True, "schema-valid", "Accuracy", "nullif(array_join(slice(schema_errors, 1, 3), '; '), '')", "structural validation", "document"),
        (p.min_versions, "schema-min-version", "Freshness", REGISTRY["format_version_at_least"](none, ctx, {"min_versions": p.min_versions}), "profile.schema.min_versions", "document.specVersion"),
        (p.deprecated_forbidden, "schema-version-not-deprecated", "Freshness", REGISTRY["format_version_not_deprecated"](none, ctx, {"deprecated_versions": p.retired()}), "profile.schema.deprecated_versions_forbidden", "document.specVersion"),
        (p.require_signature, "schema-require-signature", "Provenance", REGISTRY["signed_with_x509"](none, ctx, {}), "profile.schema.require_signature", "document.signature"),
    ]
    return [(rid, cat, Check(sql), cite, path) for on, rid, cat, sql, cite, path in asked if on]


def findings(c: Corpus, profiles: list[Profile], policy: licenses.Policy | None = None, tables: licenses.LicenseTables | None = None, passing: bool = True) -> DataFrame:
    """All findings of all profiles: ``doc_id, pos, profile, ord, rule_id, layer, severity, category, verdict, citation,
    path, message``; with ``passing`` false, components and files that pass are left out before any row is made of them.

    A withdrawn profile, an unknown validator or engine is refused before any job. Documents without components or
    files get one warning per rule of that scope; targets of no document give nothing. Null fields count as absent.
    Repeated rows are targets each.
    """
    _refuse(profiles, policy)
    plans = {"document": Plan(), "component": Plan(), "file": Plan()}
    missing: dict[str, list[str]] = {"component": [], "file": []}
    for p in profiles:
        for k, (rid, cat, check, cite, path) in enumerate(_gate(p)):
            plans["document"].add(check, p.id, k, rid, "schema", "MUST", cat, cite, path)
        for k, r in enumerate(p.rules, 10):
            info = (p.id, k, r.id, r.layer, r.severity, r.category, r.citation)
            if r.scope in missing:
                plans[r.scope].add(compile_check(r, r.scope), *info, None)
                missing[r.scope].append(Plan.literal(*info, f"{r.scope}s"))
            else:
                plans["document"].add(compile_check(r, r.scope), *info, "dependencies" if r.scope == "dependency" else "document")
    docs = cut(c.documents.join(context(c).select("doc_id", F.struct(*CONTEXT).alias("_c")), "doc_id"))  # a row per document, used by each part
    ids = docs.select("doc_id").distinct()
    if docs.count() <= BROADCAST_DOCUMENTS:
        ids = F.broadcast(ids)
    out = [plans["document"].over(docs.select("*", F.lit(-1).cast("long").alias("pos"), F.lit("document").alias("at")), True)]
    for scope, table, none in (("component", c.components, "no components in SBOM"), ("file", c.files, "no file inventory in SBOM")):
        plan = plans[scope]
        if not plan.checks:
            continue
        label = identity("purl", "cpe", "name@version", "bom_ref") if scope == "component" else identity("name", "spdx_id")
        t = table.withColumns({"pos": F.col("pos").cast("long"), "identity": label})
        t = t.withColumn("at", F.concat(F.lit(f"{scope}s["), F.col("pos").cast("string"), F.lit("]:"), "identity"))
        if any("_c." in x.reason for x in plan.checks):
            out.append(plan.over(t.join(docs.select("doc_id", "_c").dropDuplicates(["doc_id"]), "doc_id"), passing))
        else:
            out.append(plan.over(t, passing).join(ids, "doc_id", "left_semi"))
        out.append(_without_targets(docs.where(F.col(f"_c.n_{scope}s") == 0), missing[scope], none))
    out += [_license_findings(c, p, policy, tables) for p in profiles if p.engine or p.overrides]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def _license_findings(c: Corpus, p: Profile, policy: licenses.Policy | None, tables: licenses.LicenseTables | None) -> DataFrame:
    """Overrides first (the last of an identifier wins), then the policy."""
    lic = c.components.withColumn("identity", identity("purl", "cpe", "name@version", "bom_ref")).select("doc_id", "pos", F.concat(F.lit("components["), F.col("pos").cast("string"), F.lit("]:"), F.col("identity")).alias("path"), F.explode("licenses").alias("lic"))
    if p.engine:
        policy = replace(policy or licenses.Policy.read(p.policy_path), context=p.context)
    own = {i: (a, r) for i, a, r in p.overrides}
    allowed = F.create_map(*[F.lit(x) for i, (a, _) in own.items() for x in (i, a)]) if own else F.create_map().cast("map<string,boolean>")
    reason = F.create_map(*[F.lit(x) for i, (a, r) in own.items() for x in (i, r or f"license {i} {'' if a else 'not '}allowed for {p.use_case}")]) if own else F.create_map().cast("map<string,string>")
    lic = lic.withColumns({"ok": F.try_element_at(allowed, F.col("lic")), "why": F.try_element_at(reason, F.col("lic"))})
    action = licenses.decide(F.col("lic"), policy, p.use_case, tables) if p.engine else F.lit(None).cast("string")
    lic = lic.withColumn("action", action).where(F.col("ok").isNotNull() | F.col("action").isNotNull())
    denied, review = F.col("action").isin("deny", "contaminate"), F.col("action") == "flag_for_review"
    over = F.col("ok").isNotNull()
    return lic.select(
        "doc_id", F.col("pos").cast("long"), F.lit(p.id).alias("profile"), F.lit(1000).alias("ord"),
        F.concat(F.when(over & F.col("ok"), "license-allowed:").when(over, "license-denied:").otherwise("license-policy:"), "lic").alias("rule_id"), F.lit("oslc").alias("layer"),
        F.when(~over & review, "SHOULD").otherwise("MUST").alias("severity"), F.lit("Accuracy").alias("category"),
        F.when(over, F.when(F.col("ok"), "PASS").otherwise("FAIL")).when(denied, "FAIL").when(review, "WARN").otherwise("PASS").alias("verdict"), F.lit(f"license policy ({p.use_case})").alias("citation"), "path",
        F.when(over, F.col("why")).otherwise(F.concat(F.lit("policy says "), F.replace("action", F.lit("_"), F.lit(" ")), F.lit(f" for use case '{p.use_case}'"))).alias("message"),
    )


def verdicts(f: DataFrame) -> DataFrame:
    """``doc_id, profile, verdict, must_violations``: MAY never counts; no findings is no row."""
    on = F.col("severity") != "MAY"
    return f.groupBy("doc_id", "profile").agg(
        F.when(F.max(on & (F.col("verdict") == "FAIL")), "FAIL").when(F.max(on & (F.col("verdict") == "WARN")), "WARN").otherwise("PASS").alias("verdict"),
        F.count_if((F.col("verdict") == "FAIL") & (F.col("severity") == "MUST")).alias("must_violations"),
    )


def top_issues(f: DataFrame, limit: int = 3) -> DataFrame:
    """The most serious findings of each document and profile, in order.

    The order is total (verdict, severity, rule, position), so ties are settled alike on every run. Each document
    keeps ``limit`` rows through a bounded aggregate instead of a window over all its findings.
    """
    rank = F.when(F.col("verdict") == "FAIL", 0).otherwise(1) * 10 + F.when(F.col("severity") == "MUST", 0).when(F.col("severity") == "MUST_WHERE_AVAILABLE", 1).when(F.col("severity") == "SHOULD", 2).otherwise(3)
    bad = f.where(F.col("verdict") != "PASS").withColumn("rank", rank)
    salted = Window.partitionBy("doc_id", "profile", F.pmod(F.xxhash64("pos", "rule_id"), F.lit(64))).orderBy("rank", "ord", "pos", "rule_id")
    few = bad.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= limit)
    w = Window.partitionBy("doc_id", "profile").orderBy("rank", "ord", "pos", "rule_id")
    text = F.concat(F.coalesce("category", "layer"), F.lit(": "), "rule_id", F.lit(": "), "message", F.lit(" ["), "path", F.lit("]"))
    return few.withColumn("issue_no", F.row_number().over(w)).where(F.col("issue_no") <= limit).select("doc_id", "profile", "issue_no", "rule_id", text.alias("issue"))
