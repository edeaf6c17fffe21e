"""Profiles, validators, readers, scores and reports on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from bomstrata.operators import engine, licenses, profiles, scoring
from bomstrata.operators.schema_gate import structural_errors
from bomstrata.operators.validators import REGISTRY, Value
from bomstrata.plans import reports
from bomstrata.sources.detect import detect
from bomstrata.sources.documents import read, tag_value


def _reasons(spark, validator, values, kind="scalar", params=None, ctx=None):
    ddl = {"scalar": "string", "list": "array<string>", "map": "map<string,string>"}[kind]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r["r"] for r in df.select("i", F.expr(REGISTRY[validator](Value(kind, "v"), ctx or {}, params or {})).alias("r")).orderBy("i").collect()]


def test_present_and_declared(spark):
    assert [bool(r) for r in _reasons(spark, "present", [None, "", " NONE ", "x"])] == [True, True, True, False]
    assert [bool(r) for r in _reasons(spark, "present", [None, [], ["none", ""], ["none", "x"]], "list")] == [True, True, True, False]
    assert [bool(r) for r in _reasons(spark, "declared", [None, "", "NOASSERTION", "x"])] == [True, True, False, False]
    assert _reasons(spark, "non_placeholder", ["TODO", " 0.0.0 ", "fine"]) == ["placeholder value: 'TODO'", "placeholder value: ' 0.0.0 '", None]
    assert _reasons(spark, "format_regex", ["ab", "it's"], params={"pattern": "^a"}) == [None, "\"it's\" does not match /^a/"]


@pytest.mark.parametrize(("text", "ok"), [
    ("2026-01-01T00:00:00Z", True), ("2026-01-01t00:00:00.123z", True), ("2026-01-01T23:59:60Z", False), ("2016-12-31T23:59:60Z", True), ("2017-01-01T00:59:60+01:00", True), ("2026-02-29T00:00:00Z", False), ("2024-02-29T00:00:00-23:59", True),
    ("2026-01-01T24:00:00Z", False), ("2026-01-01T00:00:00", False), ("2026-01-01T00:00:00+24:00", False), ("٢٠٢٦-٠١-٠١T٠٠:٠٠:٠٠Z", False), ("9999-12-31T23:59:60Z", False), ("today", False), ("0000-01-01T00:00:00Z", False),
])
def test_rfc3339(spark, text, ok):
    assert (_reasons(spark, "rfc3339_utc", [text])[0] is None) == ok


def test_identifiers(spark):
    good = ["pkg:npm/a@1", "PKG:npm/%40s/a@1?x=y#p", "cpe:2.3:a:v:p:1:*:*:*:*:*:*:*", "CPE:/a:v:p", ""]
    bad = ["pkg:npm", "pkg:npm/", "pkg:1a/b", "npm/a", "cpe:2.3:a:v:p", "pkg:npm/a?x"]
    got = _reasons(spark, "component_identifier", good + bad)
    assert [r is None for r in got] == [True] * len(good) + [False] * len(bad)
    assert "expected 13" in got[len(good) + 4]


def test_digests(spark):
    ok, short, word, blank, new = {"sha-256": "a" * 64}, {"SHA-256": "a" * 40}, {"sha1": "zzz"}, {"md5": " "}, {"k12": "ab"}
    assert [r is None for r in _reasons(spark, "hash_wellformed", [ok, short, word, blank, new, {}], "map")] == [True, False, False, False, True, True]
    assert [r is None for r in _reasons(spark, "hash_algorithm_in_set", [ok, word, {}], "map", {"algs": ["SHA256"]})] == [True, False, False]


def test_profiles(tmp_path):
    p = profiles.load("strict")
    assert [r.id for r in p.rules][-3:] == ["part-license", "part-license-note", "file-hash"] and "graph" not in [r.id for r in p.rules]
    assert next(r for r in p.rules if r.id == "part-supplier").severity == "MUST" and p.min_versions == {"cyclonedx": "1.4", "spdx": "2.2"}
    assert profiles.catalog([str(tmp_path)]) == ["baseline", "strict"]
    (tmp_path / "a.yaml").write_text("id: a\nextends: [b]\n")
    (tmp_path / "b.yaml").write_text("id: b\nextends: [a]\n")
    (tmp_path / "c.yaml").write_text("id: d\n")
    (tmp_path / "e.yaml").write_text("id: e\nrules: [{id: x, severity: LOUD}]\n")
    for name in ("a", "c", "e", "nowhere", "A"):
        with pytest.raises(profiles.ProfileError):
            profiles.load(name, [str(tmp_path)])


def test_licences():
    n = licenses.Normaliser(licenses.LicenseTables(aliases={"our terms": "LicenseRef-ours"}, refuse=("MIT-0",)))
    cases = {
        "MIT": ("MIT", "spdx-expression"), "mit": ("MIT", "case-corrected"), "GPL-2.0+": ("GPL-2.0-or-later", "deprecated-key"), "MIT OR (Apache-2.0 AND BSD-3-Clause)": ("MIT OR (Apache-2.0 AND BSD-3-Clause)", "spdx-expression"), "MIT/Apache-2.0": ("MIT AND Apache-2.0", "separator-rewritten"),
        "The Apache License, Version 2.0": ("Apache-2.0", "descriptive-name"), "GPL": (None, "unresolved"), "GNU General Public License, version 2.0": (None, "ambiguous"), "NOASSERTION": (None, "declared-unknown"), "MIT (http://x": (None, "unresolved"),
        "our terms": ("LicenseRef-ours", "alias"), "MIT-0": (None, "unresolved"), "GPL-2.0-only WITH Classpath-exception-2.0": ("GPL-2.0-only WITH Classpath-exception-2.0", "spdx-expression"), None: (None, "declared-unknown"),
    }
    assert {k: n.resolve(k) for k in cases} == cases
    policy = licenses.Policy({("", "MIT"): "approve", ("", "GPL-3.0-only"): "deny", ("", "EPL-2.0"): "flag_for_review"})
    assert [policy.decide(n, t, "distribution") for t in ("MIT OR GPL-3.0-only", "MIT AND GPL-3.0-only", "EPL-2.0 OR GPL-3.0-only", "Zlib", "what?")] == ["approve", "deny", "flag_for_review", "allow", "allow"]


CDX = {
    "bomFormat": "CycloneDX", "specVersion": "1.6", "metadata": {"timestamp": "2026-01-01T00:00:00Z", "authors": [{"name": "Ann"}], "tools": {"components": [{"name": "t", "version": "1"}]}, "lifecycles": [{"phase": "build"}]},
    "components": [
        {"type": "library", "name": "a", "version": "1.2.3", "bom-ref": "a", "purl": "pkg:npm/a@1.2.3", "licenses": [{"license": {"name": "MIT"}}], "hashes": [{"alg": "SHA-256", "content": "f" * 64}], "supplier": {"name": "Organization: S"}},
        {"type": "library", "name": "b", "components": [{"type": "file", "name": "f.c", "hashes": [{"alg": "SHA-1", "content": "e" * 40}]}]}, 7,
    ],
    "dependencies": [{"ref": "a", "dependsOn": []}],
}
SPDX = {
    "spdxVersion": "SPDX-2.3", "SPDXID": "SPDXRef-DOCUMENT", "dataLicense": "CC0-1.0", "name": "n", "documentNamespace": "urn:x", "creationInfo": {"created": "2026-01-01T00:00:00Z", "creators": ["Tool: gen-1.0"]},
    "packages": [{"SPDXID": "SPDXRef-p", "name": "p", "downloadLocation": "NONE", "versionInfo": "NOASSERTION", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:a/p"}], "checksums": [{"algorithm": "SHA1", "checksumValue": "0" * 40}]}],
    "relationships": [{"spdxElementId": "SPDXRef-DOCUMENT", "relationshipType": "DESCRIBES", "relatedSpdxElement": "SPDXRef-p"}, {"spdxElementId": "a", "relationshipType": "OTHER", "relatedSpdxElement": "b"}],
}
TAGS = "SPDXVersion: SPDX-2.2\nDataLicense: CC0-1.0\nDocumentName: d\nSPDXID: SPDXRef-DOCUMENT\nCreator: Person: X\nCreated: 2026-01-01T00:00:00Z\nPackageName: q\nSPDXID: SPDXRef-q\nPackageVersion: 2.0.0\nPackageChecksum: SHA1: " + "1" * 40 + "\nRelationship: SPDXRef-DOCUMENT DESCRIBES SPDXRef-q\n"
XML = '<bom xmlns="http://cyclonedx.org/schema/bom/1.6"><metadata><timestamp>2026-01-01T00:00:00Z</timestamp></metadata><components><component type="library" bom-ref="z"><name>z</name><version>1.0.0</version></component></components><dependencies><dependency ref="z"/></dependencies></bom>'
LD = {"@context": "https://spdx.org/rdf/3.0.1/spdx-context.jsonld", "@graph": [{"type": "CreationInfo", "created": "2026-01-01T00:00:00Z", "createdBy": ["x"]}, {"type": ["software_Package"], "spdxId": "urn:p", "name": "p3", "software_packageVersion": "3.0.0", "verifiedUsing": {"type": "Hash", "algorithm": "sha256", "hashValue": "a" * 64}}]}


@pytest.fixture(scope="module")
def corpus(spark):
    empty = {"bomFormat": "CycloneDX", "specVersion": "1.6", "metadata": 3, "components": "no"}
    texts = [json.dumps(CDX), json.dumps(SPDX), TAGS, XML, json.dumps(LD), json.dumps(empty), "nothing", None, "{", "<!DOCTYPE x><bom xmlns='http://cyclonedx.org/schema/bom/1.4'/>"]
    return read(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")


def test_detect(spark):
    texts = [json.dumps(CDX), json.dumps(SPDX), TAGS, XML, json.dumps(LD), "spdxVersion: SPDX-2.2\nname: x", "", None, "{", "[1]", "<a/>", "hello"]
    got = [r["k"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", detect(F.col("t")).alias("k")).orderBy("i").collect()]
    assert [(k["sbom_format"], k["spec_version"], k["encoding"]) for k in got[:6]] == [("cyclonedx", "1.6", "json"), ("spdx", "2.3", "json"), ("spdx", "2.2", "tagvalue"), ("cyclonedx", "1.6", "xml"), ("spdx", "3.0.1", "json"), ("spdx", "2.2", "yaml")]
    assert all(k["error"] for k in got[6:])


def test_read(corpus):
    docs = {r["doc_id"]: r for r in corpus.documents.collect()}
    assert sorted(docs) == [0, 1, 2, 3, 4, 5, 9] and docs[9]["schema_errors"] and docs[1]["tool_versions"] == ["1.0"] and docs[0]["creators"] == ["Ann"]
    comps = {(r["doc_id"], r["name"]): r for r in corpus.components.collect()}
    assert {k for k in comps} == {(0, "a"), (0, "b"), (1, "p"), (2, "q"), (3, "z"), (4, "p3")}
    assert comps[(0, "a")]["licenses"] == ["MIT"] and comps[(1, "p")]["purl"] == "pkg:a/p" and comps[(4, "p3")]["hashes"] == {"sha256": "a" * 64}
    assert [(r["doc_id"], r["name"]) for r in corpus.files.collect()] == [(0, "f.c")]
    assert {tuple(r) for r in corpus.edges.collect()} == {(0, "a", None), (1, "SPDXRef-DOCUMENT", "SPDXRef-p"), (2, "SPDXRef-DOCUMENT", "SPDXRef-q"), (3, "z", None)}
    assert tag_value(TAGS)["packages"][0]["versionInfo"] == "2.0.0"
    assert structural_errors({"bomFormat": "CycloneDX", "components": [{"type": "nope"}]}, "cyclonedx", "1.4") and not structural_errors(SPDX, "spdx", "2.3")


def test_findings_and_verdicts(corpus):
    f = engine.findings(corpus, [profiles.load("baseline"), profiles.load("strict")]).cache()
    got = {(r["doc_id"], r["profile"], r["rule_id"], r["pos"]): (r["verdict"], r["message"]) for r in f.collect()}
    assert got[(0, "baseline", "part-version", 0)] == ("PASS", "ok")
    assert got[(0, "baseline", "part-version", 1)][0] == "FAIL" and got[(1, "baseline", "part-version", 0)][1].startswith("semver_or_calver: ")
    assert got[(0, "baseline", "part-identifier", 1)][0] == "WARN"
    assert got[(5, "baseline", "part-name", -1)] == ("WARN", "no components in SBOM")
    assert got[(0, "baseline", "graph", -1)][0] == "PASS" or "absent" in got[(0, "baseline", "graph", -1)][1]
    assert got[(0, "strict", "file-hash", 0)][0] == "WARN" and got[(1, "strict", "file-hash", -1)] == ("WARN", "no file inventory in SBOM")
    assert got[(0, "strict", "schema-require-signature", -1)] == ("FAIL", "SBOM is not signed")
    v = {(r["doc_id"], r["profile"]): (r["verdict"], r["must_violations"]) for r in engine.verdicts(f).collect()}
    assert v[(0, "strict")][0] == "FAIL" and v[(3, "baseline")][0] in ("WARN", "FAIL")
    top = [r["issue"] for r in engine.top_issues(f).where("doc_id = 0 and profile = 'strict'").orderBy("issue_no").collect()]
    assert len(top) == 3 and [t.split(": ")[1] for t in top] == ["schema-valid", "schema-require-signature", "part-version"]
    assert reports.exit_code(f) == 1
    assert {r["level"] for r in reports.sarif_results(f).collect()} == {"error", "warning"}
    s = scoring.scores(scoring.signals(corpus), profiles.load("baseline"))
    text = reports.console(f, s).where("doc_id = 0").collect()[0]["report"]
    assert text.startswith("Profile: baseline\nVerdict: FAIL") and "Top issues:" in text
    f.unpersist()


def test_scores_of_an_empty_document(corpus):
    """No components and empty metadata: 67/85/100/18/75; .3*67 + .25*85 + .15*100 + .2*18 + .1*75 = 67.45."""
    p = profiles.parse({"id": "plain"})
    r = scoring.scores(scoring.signals(corpus), p).where("doc_id = 5").collect()[0]
    assert (r["Completeness"], r["Accuracy"], r["Consistency"], r["Provenance"], r["Freshness"], r["score"]) == (67, 85, 100, 18, 75, 67)


def test_licence_policy_findings(corpus):
    p = profiles.parse({"id": "lic", "license_policy": {"engine": "table", "use_case": "mobile", "rules": [{"spdx_id": "Zlib", "allowed": False}]}})
    with pytest.raises(profiles.ProfileError):
        engine.findings(corpus, [p])
    f = engine.findings(corpus, [p], licenses.Policy({("mobile", "MIT"): "deny"}))
    assert [(r["rule_id"], r["verdict"], r["message"]) for r in f.where("layer = 'oslc'").collect()] == [("license-policy:MIT", "FAIL", "policy says deny for use case 'mobile'")]
    with pytest.raises(profiles.ProfileError):
        engine.findings(corpus, [profiles.parse({"id": "gone", "withdrawn": "wrong clause"})])
    with pytest.raises(profiles.ProfileError):
        engine.findings(corpus, [profiles.parse({"id": "u", "rules": [{"id": "r", "severity": "MUST", "validators": ["no_such"]}]})])


def test_stream(spark, tmp_path):
    from bomstrata.streaming.validate import validate_stream

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.json").write_text(json.dumps(CDX))
    q = validate_stream(spark, str(src), str(out), ["baseline"], str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).where("verdict = 'FAIL'").count() == 1


def test_a_licence_list_above_the_bound_is_refused(spark, tmp_path, monkeypatch):
    from bomstrata.plans import binding, conformance

    spark.createDataFrame([(f"L-{i}",) for i in range(4)], "license_id string").write.parquet(f"{tmp_path}/license_reference.parquet")
    spark.createDataFrame([("L-1",)], "raw string").write.parquet(f"{tmp_path}/license_declaration.parquet")
    monkeypatch.setattr(binding, "MAX_LICENSES", 4, raising=False)
    assert binding.reference_licenses(spark, str(tmp_path)) == ["L-0", "L-1", "L-2", "L-3"]
    monkeypatch.setattr(binding, "MAX_LICENSES", 3, raising=False)
    with pytest.raises(ValueError, match="license_reference"):
        conformance.lic_policy(spark, str(tmp_path))
    with pytest.raises(ValueError, match="license_reference"):
        binding.corpus(spark, str(tmp_path))


def test_a_hostile_document_does_not_stop_the_corpus(spark):
    deep = "spdxVersion: SPDX-2.3\nname: " + "[" * 5000 + "]" * 5000
    xml = '<bom xmlns="http://cyclonedx.org/schema/bom/1.6"><components>' + "<component type='library'><name>x</name><components>" * 4000 + "</components></component>" * 4000 + "</components></bom>"
    c = read(spark.createDataFrame([(1, deep), (2, xml), (3, json.dumps(CDX))], "id long, t string"), "id", "t")
    assert {r["doc_id"]: r["schema_errors"][0].startswith("could not be parsed") for r in c.documents.collect()} == {1: True, 2: True, 3: False}
    assert {r["doc_id"] for r in c.components.collect()} == {3}
