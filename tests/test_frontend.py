"""Command line, library entry, whole-document reports, overlays and policies."""

import io
import json

import pytest

from bomstrata.frontend.cli import main
from bomstrata.frontend.run import UnreadableError, run
from bomstrata.frontend.schema_check import SchemaChecker
from bomstrata.operators import licenses, overlays, validators
from bomstrata.operators.schema_gate import structural_errors

GOOD = {
    "bomFormat": "CycloneDX", "specVersion": "1.6", "metadata": {"timestamp": "2026-01-01T00:00:00Z", "authors": [{"name": "Ann"}]},
    "components": [{"type": "library", "name": "a", "version": "1.2.3", "bom-ref": "a", "purl": "pkg:npm/a@1.2.3", "licenses": [{"license": {"id": "MIT"}}], "supplier": {"name": "Organization: S"}}], "dependencies": [{"ref": "a"}],
}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "good.json").write_text(json.dumps(GOOD))
    bad = GOOD | {"components": [{"type": "library", "name": "TODO"}]}
    (tmp_path / "docs" / "bad.json").write_text(json.dumps(bad))
    (tmp_path / "policy.yaml").write_text("default: allow\ntypes: {MIT: permissive}\nrules:\n  - {when: {license_type: permissive, distribution_type: mobile}, then: flag_for_review}\n  - {when: {license: MIT, linking: static}, then: deny}\n")
    (tmp_path / "license-mobile.yaml").write_text("id: license-mobile\nname: Mobile\nlicense_policy: {engine: table, use_case: mobile, policy_path: policy.yaml}\n")
    (tmp_path / "linked.yaml").write_text("id: linked\nextends: [license-mobile]\nlicense_policy: {context: {linking: static}}\n")
    (tmp_path / "broken.yaml").write_text("id: [\n")
    return tmp_path


def call(spark, *args):
    out = io.StringIO()
    return main(list(args), spark, out), out.getvalue()


def test_validate(spark, folder):
    good, bad = str(folder / "docs" / "good.json"), str(folder / "docs" / "bad.json")
    code, text = call(spark, "validate", "--profile", "baseline", "--file", good)
    assert code == 0 and "Profile: baseline" in text and "Verdict: FAIL" not in text
    code, text = call(spark, "validate", "--profile", "baseline", "--profile", "strict", "--file", bad, "--format", "json")
    data = json.loads(text)
    assert code == 1 and [r["profile"] for r in data["results"]] == ["baseline", "strict"] and data["sbom"].endswith("bad.json")
    first = data["results"][0]
    assert first["verdict"] == "FAIL" and first["schema_valid"] and {f["verdict"] for f in first["findings"]} >= {"PASS", "FAIL"} and set(first["categories"]) == {"Completeness", "Accuracy", "Consistency", "Provenance", "Freshness"}
    code, text = call(spark, "validate", "--profile", "strict", "--file", bad, "--format", "sarif")
    sarif = json.loads(text)
    assert sarif["version"] == "2.1.0" and len(sarif["runs"]) == 1
    rules = [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]]
    assert len(rules) == len(set(rules)) and {r["ruleId"] for r in sarif["runs"][0]["results"]} == set(rules)
    assert {r["level"] for r in sarif["runs"][0]["results"]} <= {"error", "warning"}


def test_errors_are_code_2(spark, folder, capsys):
    (folder / "x.txt").write_text("hello")
    assert call(spark, "validate", "--profile", "baseline", "--file", str(folder / "x.txt"))[0] == 2
    assert call(spark, "validate", "--profile", "nowhere", "--file", str(folder / "docs"))[0] == 2
    assert call(spark, "validate", "--profile", "baseline", "--file", str(folder / "none.json"))[0] == 2
    assert call(spark, "conformance", "--rules", "r.json", "--file", str(folder / "docs"))[0] == 2
    assert "--profile / --profile-path" in capsys.readouterr().err
    with pytest.raises(UnreadableError, match="x.txt"):
        run(spark, str(folder / "x.txt"), ["baseline"])


def test_lists(spark, folder):
    code, text = call(spark, "profiles", "--profile-path", str(folder))
    assert code == 0 and "broken\n" in text and "Mobile" in text
    assert call(spark, "validators")[1].split() == validators.available()


def test_schema_front_end(spark, folder):
    good = str(folder / "docs" / "good.json")
    assert call(spark, "schema", good)[0] == 0 and call(spark, "schema", good, "--format", "spdx-json")[0] == 2
    (folder / "bad.json").write_text(json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.4", "components": [{"type": "nope"}]}))
    code, text = call(spark, "schema", str(folder / "bad.json"), "--json")
    assert code == 1 and not json.loads(text)["valid"]
    c = SchemaChecker(spark)
    assert c.validate_cyclonedx_json(good) == "Valid" and c.validate_spdx_xml(good).startswith("Format mismatch") and "type" in c.validate_cyclonedx_json(str(folder / "bad.json"))


def test_licence_front_end(spark, folder):
    good = str(folder / "docs" / "good.json")
    code, text = call(spark, "licenses", "--use-case", "mobile", "--profile-path", str(folder), "--file", good)
    assert code == 0 and "policy says flag for review for use case 'mobile'" in text
    code, text = call(spark, "validate", "--profile", "linked", "--profile-path", str(folder), "--file", good)
    assert code == 1 and "policy says deny" in text


def test_overlays(tmp_path, monkeypatch):
    (tmp_path / "a.yaml").write_text("aliases: {our terms: MIT, mit license: LicenseRef-own}\nnever_resolve: [Zlib]\nseparators: {' plus ': AND}\n")
    (tmp_path / "b.json").write_text('{"aliases": {"our terms": "ISC"}}')
    (tmp_path / "wrong.yaml").write_text("- 1\n")
    monkeypatch.setenv(overlays.FILES_VARIABLE, str(tmp_path / "a.yaml"))
    n = licenses.Normaliser(overlays.tables(files=[str(tmp_path / "b.json")], names={"the isc licence": "ISC", "mit license": "X11"}))
    got = {t: n.resolve(t) for t in ("our terms", "The MIT License", "Zlib", "MIT plus ISC", "the isc licence")}
    assert got == {"our terms": ("ISC", "alias"), "The MIT License": ("LicenseRef-own", "descriptive-name"), "Zlib": (None, "unresolved"), "MIT plus ISC": ("MIT AND ISC", "separator-rewritten"), "the isc licence": ("ISC", "alias")}
    with pytest.raises(TypeError, match="wrong.yaml"):
        overlays.read_overlay(str(tmp_path / "wrong.yaml"))


def test_registered_validators_and_policy_ranks():
    @validators.register("shout")
    def shout(v, ctx, p):
        return f"IF(upper({v.text}) = {v.text}, NULL, 'too quiet')"

    assert "shout" in validators.available()
    validators.REGISTRY.pop("shout")
    n = licenses.Normaliser(licenses.LicenseTables())
    p = licenses.Policy({("", "MIT"): "approve", ("", "ISC"): "allow", ("", "Zlib"): "contaminate", ("", "EPL-2.0"): "deny", ("", "X11"): "odd"})
    assert [p.decide(n, t, "x") for t in ("MIT OR ISC", "MIT AND ISC", "Zlib AND EPL-2.0", "Zlib OR EPL-2.0", "X11 OR MIT", "X11 AND MIT")] == ["approve", "allow", "deny", "contaminate", "odd", "approve"]


@pytest.mark.parametrize(("change", "said"), [
    ({"components": [{"type": "nope", "name": "a"}]}, "components[0].type"), ({"components": [{"type": "library"}]}, "components[0].name: is required"), ({"components": {}}, "components: is no array"),
    ({"serialNumber": "urn:uuid:1"}, "serialNumber"), ({"extra": 1}, "extra: is unknown"), ({"components": [{"type": "file", "name": "a", "hashes": [{"alg": "SHA256", "content": "a" * 64}]}]}, "hashes[0].alg"),
    ({"components": [{"type": "file", "name": "a", "hashes": [{"alg": "SHA-256", "content": "a" * 63}]}]}, "hashes[0].content"), ({"dependencies": [{}]}, "dependencies[0].ref: is required"), ({"version": 0}, "version"),
    ({"components": [{"type": "library", "name": "a", "bom-ref": "x"}, {"type": "library", "name": "b", "bom-ref": "x"}]}, "not unique"), ({"components": [{"type": "library", "name": "a", "licenses": [{"license": {"id": "MIT", "name": "MIT"}}]}]}, "not both"),
    ({"metadata": {"lifecycles": [{"phase": "never"}]}}, "lifecycles[0].phase"), ({"components": [{"type": "library", "name": "a", "externalReferences": [{"type": "rfc-9116"}]}]}, "url: is required"),
])
def test_cyclonedx_shapes(change, said):
    assert any(said in e for e in structural_errors(GOOD | change, "cyclonedx", "1.6"))


def test_shapes_follow_the_declared_version():
    doc = {"bomFormat": "CycloneDX", "specVersion": "1.3", "version": 1, "components": [{"type": "library", "name": "a", "version": "1"}]}
    assert not structural_errors(doc, "cyclonedx", "1.3") and not structural_errors(GOOD, "cyclonedx", "1.6")
    bare = doc | {"components": [{"type": "library", "name": "a"}]}
    assert structural_errors(bare, "cyclonedx", "1.3") and not structural_errors(bare, "cyclonedx", "1.4")
    crypto = doc | {"components": [{"type": "cryptographic-asset", "name": "a"}]}
    assert structural_errors(crypto, "cyclonedx", "1.5") and not structural_errors(crypto, "cyclonedx", "1.6")
    assert structural_errors({k: v for k, v in doc.items() if k != "version"}, "cyclonedx", "1.4") and structural_errors(doc, "cyclonedx", "9.9") == ["unsupported CycloneDX version '9.9'"]


SPDX_OK = {
    "spdxVersion": "SPDX-2.3", "SPDXID": "SPDXRef-DOCUMENT", "dataLicense": "CC0-1.0", "name": "n", "documentNamespace": "https://x.example/n", "creationInfo": {"created": "2026-01-01T00:00:00Z", "creators": ["Tool: t"]},
    "packages": [{"SPDXID": "SPDXRef-p", "name": "p", "downloadLocation": "NONE", "checksums": [{"algorithm": "SHA1", "checksumValue": "0" * 40}]}],
    "relationships": [{"spdxElementId": "SPDXRef-DOCUMENT", "relationshipType": "DESCRIBES", "relatedSpdxElement": "SPDXRef-p"}],
}


@pytest.mark.parametrize(("change", "said"), [
    ({"dataLicense": "MIT"}, "CC0-1.0"), ({"documentNamespace": "no uri"}, "absolute URI"), ({"creationInfo": {"created": "today", "creators": ["Ann"]}}, "creators[0]"), ({"packages": [{"SPDXID": "p", "name": "p", "downloadLocation": "NONE"}]}, "SPDX identifier"),
    ({"packages": [SPDX_OK["packages"][0] | {"checksums": [{"algorithm": "SHA1", "checksumValue": "0" * 39}]}]}, "malformed"), ({"packages": [SPDX_OK["packages"][0] | {"supplier": "Acme"}]}, "supplier"),
    ({"relationships": [{"spdxElementId": "SPDXRef-x", "relationshipType": "CONTAINS", "relatedSpdxElement": "SPDXRef-p"}]}, "no element"), ({"creationInfo": None}, "creationInfo: is required"),
])
def test_spdx_shapes(change, said):
    assert not structural_errors(SPDX_OK, "spdx", "2.3")
    assert any(said in e for e in structural_errors(SPDX_OK | change, "spdx", "2.3"))
    assert any("copyrightText" in e for e in structural_errors(SPDX_OK, "spdx", "2.2"))
