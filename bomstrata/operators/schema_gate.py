"""Structural checks of documents against the version they declare.

Shapes are tables: member -> how its value looks, and since which version it exists. One walk over a document compares
it with the tables of its format: types, required and unknown members, enumerations and patterns. The tables hold the
published rules for the members that the corpus reads; members of other kinds are only checked to be known.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from bomstrata.operators.licenses import _public_list

#: Versions that are known.
CYCLONEDX = ("1.0", "1.1", "1.2", "1.3", "1.4", "1.5", "1.6")
#: Fixed values of the CycloneDX format, by the version that brought them.
ENUMS = {
    "component type": {
        "1.0": "application framework library operating-system device", "1.1": "file", "1.2": "container firmware", "1.5": "device-driver platform machine-learning-model data", "1.6": "cryptographic-asset",
    },
    "digest algorithm": {"1.0": "MD5 SHA-1 SHA-256 SHA-384 SHA-512 SHA3-256 SHA3-384 SHA3-512", "1.2": "BLAKE2b-256 BLAKE2b-384 BLAKE2b-512 BLAKE3"},
    "reference type": {
        "1.0": "vcs issue-tracker website advisories bom mailing-list social chat documentation support distribution license build-meta build-system other", "1.4": "release-notes",
        "1.5": "distribution-intake security-contact model-card log configuration evidence formulation attestation threat-model adversary-model risk-assessment vulnerability-assertion exploitability-statement pentest-report"
        " static-analysis-report dynamic-analysis-report runtime-analysis-report component-analysis-report maturity-report certification-report codified-infrastructure quality-metrics poam",
        "1.6": "source-distribution electronic-signature digital-signature rfc-9116",
    },
    "scope": {"1.0": "required optional excluded"},
    "phase": {"1.5": "design pre-build build post-build operations discovery decommission"},
}
PATTERNS = {
    "serial number": r"urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "digest": r"[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64}|[a-fA-F0-9]{96}|[a-fA-F0-9]{128}",
    "format": "CycloneDX",
}
#: Shapes: "text", "whole", "any", "=enumeration", "~pattern", ">shape", "[shape" for a list; members since a version follow it.
SHAPES = {
    "bom": {
        "1.0": {
            "$schema": "text", "bomFormat": "~format", "specVersion": "text", "serialNumber": "~serial number", "version": "whole", "metadata": ">metadata", "components": "[>component", "services": "[any", "externalReferences": "[>reference",
            "dependencies": "[>dependency",
        },
        "1.3": {"compositions": "[any"}, "1.4": {"vulnerabilities": "[any", "signature": "any"}, "1.5": {"annotations": "[any", "formulation": "[any", "properties": "[any"}, "1.6": {"declarations": "any", "definitions": "any"},
    },
    "metadata": {
        "1.0": {"timestamp": "text", "tools": "any", "authors": "[>contact", "component": ">component", "manufacture": ">party", "supplier": ">party"}, "1.3": {"licenses": "[>choice", "properties": "[any"}, "1.5": {"lifecycles": "[>lifecycle"},
        "1.6": {"manufacturer": ">party"},
    },
    "component": {
        "1.0": {
            "type": "=component type", "mime-type": "text", "bom-ref": "text", "supplier": ">party", "author": "text", "publisher": "text", "group": "text", "name": "text", "version": "text", "description": "text", "scope": "=scope",
            "hashes": "[>hash", "licenses": "[>choice", "copyright": "text", "cpe": "text", "purl": "text", "swid": "any", "modified": "any", "pedigree": "any", "externalReferences": "[>reference", "components": "[>component",
        },
        "1.3": {"evidence": "any", "properties": "[any"}, "1.4": {"releaseNotes": "any", "signature": "any"}, "1.5": {"modelCard": "any", "data": "any"},
        "1.6": {"manufacturer": ">party", "authors": "[>contact", "omniborId": "[text", "swhid": "[text", "cryptoProperties": "any", "tags": "[text"},
    },
    "party": {"1.0": {"bom-ref": "text", "name": "text", "url": "[text", "contact": "[>contact", "address": "any"}},
    "contact": {"1.0": {"bom-ref": "text", "name": "text", "email": "text", "phone": "text"}},
    "hash": {"1.0": {"alg": "=digest algorithm", "content": "~digest"}},
    "choice": {"1.0": {"license": ">license", "expression": "text", "bom-ref": "text", "acknowledgement": "text"}},
    "license": {"1.0": {"id": "text", "name": "text", "text": "any", "url": "text", "bom-ref": "text", "acknowledgement": "text", "licensing": "any", "properties": "[any"}},
    "reference": {"1.0": {"url": "text", "comment": "text", "type": "=reference type", "hashes": "[>hash"}},
    "dependency": {"1.0": {"ref": "text", "dependsOn": "[text"}, "1.6": {"provides": "[text"}},
    "lifecycle": {"1.0": {"phase": "=phase", "name": "text", "description": "text"}},
}
#: shape -> ((member, required since, required until), ...)
REQUIRED = {
    "bom": (("bomFormat", "1.2", "9"), ("specVersion", "1.2", "9"), ("version", "1.2", "1.4")), "component": (("type", "1.0", "9"), ("name", "1.0", "9"), ("version", "1.0", "1.3")), "hash": (("alg", "1.0", "9"), ("content", "1.0", "9")),
    "reference": (("url", "1.0", "9"), ("type", "1.0", "9")), "dependency": (("ref", "1.0", "9"),),
}
#: From here on unknown members are errors.
CLOSED = "1.4"
#: Fixed values of SPDX 2: digest algorithms and their hex digits; prefixes of creators.
SPDX_DIGESTS = {
    "SHA1": 40, "SHA224": 56, "SHA256": 64, "SHA384": 96, "SHA512": 128, "SHA3-256": 64, "SHA3-384": 96, "SHA3-512": 128, "BLAKE2B-256": 64, "BLAKE2B-384": 96, "BLAKE2B-512": 128, "BLAKE3": None, "MD2": 32, "MD4": 32, "MD5": 32, "MD6": None, "ADLER32": 8,
}
SPDX_VERSIONS = ("2.0", "2.1", "2.2", "2.3")


def _allowed(name: str, version: str) -> set[str]:
    return {x for since, words in ENUMS[name].items() if since <= version for x in words.split()}


def _compare(shape: str, value, version: str, at: str) -> Iterator[str]:
    """What breaks a shape, place by place; members without a value count as absent."""
    todo = [(shape, value, at)]
    while todo:
        kind, v, where = todo.pop()
        if kind == "any" or v is None:
            continue
        if kind[0] == "[":
            if not isinstance(v, list):
                yield f"{where}: is no array"
            else:
                todo += [(kind[1:], x, f"{where}[{i}]") for i, x in reversed(list(enumerate(v)))]
                yield from (f"{where}[{i}]: is null" for i, x in enumerate(v) if x is None)
        elif kind[0] == ">":
            if not isinstance(v, dict):
                yield f"{where}: is no object"
                continue
            name, prefix = kind[1:], f"{where}." if where else ""
            known = {k: s for since, members in SHAPES[name].items() if since <= version for k, s in members.items()}
            yield from (f"{prefix}{k}: is required" for k, a, b in REQUIRED.get(name, ()) if a <= version <= b and v.get(k) is None)
            if version >= CLOSED:
                yield from (f"{prefix}{k}: is unknown in {version}" for k, x in v.items() if k not in known and x is not None)
            if name == "license":
                yield from _license(v, where)
            todo += [(known[k], x, f"{prefix}{k}") for k, x in reversed(v.items()) if k in known]
        elif kind == "whole":
            if not (isinstance(v, int) and not isinstance(v, bool) and v >= 1 or isinstance(v, str) and v.isdigit()):
                yield f"{where}: {v!r} is no whole number above 0"
        elif not isinstance(v, str):
            yield f"{where}: is no text"
        elif kind[0] == "=" and v not in _allowed(kind[1:], version):
            yield f"{where}: {v!r} is no {kind[1:]} of {version}"
        elif kind[0] == "~" and not re.fullmatch(PATTERNS[kind[1:]], v):
            yield f"{where}: is no {kind[1:]}"


def _license(v: dict, where: str) -> Iterator[str]:
    named = [k for k in ("id", "name") if v.get(k) is not None]
    if len(named) != 1:
        yield f"{where}: has to have an id or a name, and not both"
    ids = _public_list()[0] + _public_list()[1]
    if isinstance(v.get("id"), str) and len(ids) > 500 and v["id"] not in ids:
        yield f"{where}.id: {v['id']!r} is no identifier of the public list"


def _duplicates(data: dict) -> Iterator[str]:
    """References that two components have."""
    seen: set[str] = set()
    todo = [x for x in (data.get("components"),) if isinstance(x, list)]
    while todo:
        for c in todo.pop():
            if isinstance(c, dict):
                ref = c.get("bom-ref")
                if isinstance(ref, str) and ref in seen:
                    yield f"bom-ref {ref!r} is not unique"
                seen |= {ref} if isinstance(ref, str) else set()
                todo += [c["components"]] if isinstance(c.get("components"), list) else []


def _cyclonedx(data: dict, version: str) -> list[str]:
    if version not in CYCLONEDX:
        return [f"unsupported CycloneDX version {version!r}"]
    return [*_compare(">bom", data, version, ""), *_duplicates(data)]


def _digests(entries, where: str) -> Iterator[str]:
    for i, c in enumerate(entries if isinstance(entries, list) else []):
        alg, digest = (c.get("algorithm"), c.get("checksumValue")) if isinstance(c, dict) else (None, None)
        size = SPDX_DIGESTS.get(str(alg).upper(), 0)
        if size == 0:
            yield f"{where}.checksums[{i}]: {alg!r} is no checksum algorithm"
        elif not re.fullmatch(r"[0-9a-fA-F]+", str(digest)) or (size and len(str(digest)) != size):
            yield f"{where}.checksums[{i}]: the digest is malformed"


def _spdx2(data: dict, version: str) -> list[str]:
    errors = [f"{k}: is required" for k in ("spdxVersion", "dataLicense", "name", "documentNamespace") if not data.get(k)]
    if version not in SPDX_VERSIONS:
        errors.append(f"spdxVersion: {version!r} is unknown")
    if data.get("dataLicense") not in (None, "", "CC0-1.0"):
        errors.append(f"dataLicense: {data['dataLicense']!r} has to be CC0-1.0")
    if data.get("SPDXID", "SPDXRef-DOCUMENT") != "SPDXRef-DOCUMENT":
        errors.append("SPDXID: of the document has to be SPDXRef-DOCUMENT")
    space = data.get("documentNamespace")
    if space and not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.\-]*:[^\s#]+", str(space)):
        errors.append("documentNamespace: is no absolute URI without a fragment")
    info = data.get("creationInfo")
    if not isinstance(info, dict):
        errors.append("creationInfo: is required")
    else:
        errors += [f"creationInfo.{k}: is required" for k in ("created", "creators") if not info.get(k)]
        if info.get("created") and not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", str(info["created"])):
            errors.append("creationInfo.created: is no UTC time in seconds")
        makers = info.get("creators")
        errors += [f"creationInfo.creators[{i}]: {c!r} is no Person, Organization or Tool" for i, c in enumerate(makers if isinstance(makers, list) else []) if not re.match(r"(?:Person|Organization|Tool): ?\S", str(c))]
    ids = {"SPDXRef-DOCUMENT"}
    stated = ("licenseConcluded", "copyrightText") if version <= "2.2" else ()
    for kind, needed in (("packages", ("name", "downloadLocation", *stated, *(("licenseDeclared",) if stated else ()))), ("files", ("fileName", *stated))):
        items = data.get(kind)
        if items is not None and not isinstance(items, list):
            errors.append(f"{kind}: is no array")
        for i, p in enumerate(items if isinstance(items, list) else []):
            at = f"{kind}[{i}]"
            if not isinstance(p, dict):
                errors.append(f"{at}: is no object")
                continue
            errors += [f"{at}.{k}: is required" for k in needed if not p.get(k)]
            if not re.fullmatch(r"SPDXRef-[A-Za-z0-9.\-]+", str(p.get("SPDXID", ""))):
                errors.append(f"{at}.SPDXID: is no SPDX identifier")
            elif p["SPDXID"] in ids:
                errors.append(f"{at}.SPDXID: {p['SPDXID']!r} is not unique")
            ids.add(str(p.get("SPDXID")))
            errors += _digests(p.get("checksums"), at)
            errors += [f"{at}.{k}: {p[k]!r} is no Person, Organization or NOASSERTION" for k in ("supplier", "originator") if p.get(k) and not re.match(r"(?:Person|Organization): ?\S|NOASSERTION$", str(p[k]))]
    links = data.get("relationships")
    for i, r in enumerate(links if isinstance(links, list) else []):
        for k in ("spdxElementId", "relatedSpdxElement"):
            end = r.get(k) if isinstance(r, dict) else None
            if not isinstance(end, str) or not end:
                errors.append(f"relationships[{i}].{k}: is required")
            elif end.startswith("SPDXRef-") and end not in ids and "snippets" not in data:
                errors.append(f"relationships[{i}].{k}: {end!r} is no element of the document")
    return errors


def _spdx3(data: dict) -> list[str]:
    errors = [] if "@context" in data else ["@context: is required"]
    graph = data.get("@graph")
    if not isinstance(graph, list) or not graph:
        return [*errors, "@graph: is required and not empty"]
    named = [n.get("type", n.get("@type")) for n in graph if isinstance(n, dict)]
    kinds = {re.split(r"[/#:_]", k)[-1] for t in named for k in (t if isinstance(t, list) else [t]) if isinstance(k, str)}
    return errors if kinds & {"SpdxDocument", "CreationInfo"} else [*errors, "@graph: holds no SpdxDocument or CreationInfo"]


def structural_errors(data, fmt: str, version: str) -> list[str]:
    """What breaks the structure of a parsed document; empty if nothing does."""
    if not isinstance(data, dict):
        return ["the document is no object"]
    if fmt == "cyclonedx":
        return _cyclonedx(data, version)
    return _spdx3(data) if version.startswith("3") else _spdx2(data, version)
