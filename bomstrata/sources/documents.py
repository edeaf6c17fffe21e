"""Bills of materials of any encoding read into the corpus tables.

The format is detected by column expressions; each document then passes once through an Arrow map that turns its
tree (recursive, and possibly with any type in any place) into one row with nested lists, which DataFrame
explodes make into the four tables. One document is the unit of work; nothing is shuffled.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomstrata.operators import licenses
from bomstrata.operators.engine import Corpus
from bomstrata.operators.schema_gate import structural_errors
from bomstrata.session import cut
from bomstrata.sources.detect import detect

_HASH = pa.map_(pa.string(), pa.string())
_TEXTS = pa.list_(pa.string())
_DECL = pa.list_(pa.struct([("raw", pa.string()), ("source", pa.string()), ("normalized", pa.string()), ("method", pa.string())]))
_COMPONENT = pa.struct([(n, pa.string()) for n in ("bom_ref", "name", "version", "type", "purl", "cpe", "supplier", "author", "publisher")] + [("licenses", _TEXTS), ("license_declarations", _DECL), ("hashes", _HASH), ("external_refs", _TEXTS), ("raw", pa.string())])
_FILE = pa.struct([("spdx_id", pa.string()), ("name", pa.string()), ("copyright", pa.string()), ("hashes", _HASH), ("licenses", _TEXTS), ("raw", pa.string())])
_EDGE = pa.struct([("src", pa.string()), ("dst", pa.string())])
_ROW = pa.schema([
    ("doc_id", pa.int64()), *[(n, pa.string()) for n in ("sbom_format", "spec_version", "encoding", "name", "namespace", "timestamp", "sbom_version", "supplier", "data_license")],
    *[(n, _TEXTS) for n in ("creators", "tools", "tool_versions", "lifecycles")], ("signed", pa.bool_()), ("raw", pa.string()), ("schema_errors", _TEXTS),
    ("components", pa.list_(_COMPONENT)), ("files", pa.list_(_FILE)), ("edges", pa.list_(_EDGE)),
])
_COMPONENT_DDL = "struct<bom_ref:string,name:string,version:string,type:string,purl:string,cpe:string,supplier:string,author:string,publisher:string,licenses:array<string>,license_declarations:array<struct<raw:string,source:string,normalized:string,method:string>>,hashes:map<string,string>,external_refs:array<string>,raw:string>"
_DDL = (
    "doc_id long, sbom_format string, spec_version string, encoding string, name string, namespace string, timestamp string, sbom_version string, supplier string, data_license string, creators array<string>, "
    "tools array<string>, tool_versions array<string>, lifecycles array<string>, signed boolean, raw string, schema_errors array<string>, "
    f"components array<{_COMPONENT_DDL}>, files array<struct<spdx_id:string,name:string,copyright:string,hashes:map<string,string>,licenses:array<string>,raw:string>>, edges array<struct<src:string,dst:string>>"
)


def nodes(x, path: str) -> list:
    """All values at a path of member names; ``[]`` after a name steps into its list. Members of other types give nothing."""
    level = [x]
    for step in path.split("."):
        name = step.removesuffix("[]")
        level = [n[name] for n in level if isinstance(n, dict) and name in n]
        if step != name:
            level = [y for n in level if isinstance(n, list) for y in n]
    return level


def objects(x, path: str) -> list[dict]:
    return [n for n in nodes(x, path) if isinstance(n, dict)]


def plain(x) -> str | None:
    """A scalar as text; containers are no text."""
    return None if x is None or isinstance(x, (dict, list)) else x if isinstance(x, str) else str(x)


def text(x, *paths: str) -> str | None:
    """The text at a path; of several paths the first that is not empty."""
    found = [plain(n) for p in paths for n in nodes(x, p)[:1]]
    return next((t for t in found if t), found[0] if len(paths) == 1 and found else None)


def texts(x, path: str) -> list[str]:
    return [t for n in nodes(x, path) if (t := plain(n))]


def fields(x, where: dict[str, str]) -> dict[str, str | None]:
    return {name: text(x, path) for name, path in where.items()}


def dump(x, without: tuple[str, ...] = ()) -> str:
    return json.dumps({k: v for k, v in x.items() if k not in without} if without else x, ensure_ascii=False)


#: Where each column of the corpus stands in the formats.
CDX_DOCUMENT = {"name": "metadata.component.name", "namespace": "serialNumber", "timestamp": "metadata.timestamp", "sbom_version": "version", "supplier": "metadata.supplier.name"}
CDX_COMPONENT = {"bom_ref": "bom-ref", "name": "name", "version": "version", "type": "type", "purl": "purl", "cpe": "cpe", "supplier": "supplier.name", "author": "author", "publisher": "publisher"}
CDX_FILE = {"spdx_id": "bom-ref", "name": "name", "copyright": "copyright"}
SPDX_DOCUMENT = {"name": "name", "namespace": "documentNamespace", "timestamp": "creationInfo.created", "data_license": "dataLicense"}
SPDX_PACKAGE = {"bom_ref": "SPDXID", "name": "name", "version": "versionInfo", "supplier": "supplier", "author": "originator"}
SPDX_FILE = {"spdx_id": "SPDXID", "name": "fileName", "copyright": "copyrightText"}
#: Licence slots of a CycloneDX entry, in order, and their names.
CDX_LICENSE = (("expression", "expression"), ("license.id", "license.id"), ("license.name", "name"))
#: Relationships that are edges of the dependency graph, and ends that are none.
EDGES, NO_END = ("DEPENDS_ON", "DESCRIBES", "CONTAINS"), ("NONE", "NOASSERTION")


def digests(entries: list, alg: str, value: str) -> dict[str, str]:
    named = ((e.get(alg), text(e, value)) for e in entries if isinstance(e, dict))
    return {a.lower(): v for a, v in named if isinstance(a, str) and v and v.strip()}


def _file_nodes(tops: list) -> Iterator[dict]:
    """Components of type file on all levels, in order of the text."""
    todo = list(reversed(tops))
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if (text(node, "type") or "").lower() == "file":
                yield node
            todo.extend(reversed(nodes(node, "components[]")))


class Reader:
    """Documents to rows, with licence texts resolved by the given tables."""

    def __init__(self, tables: licenses.LicenseTables):
        self.resolve = licenses.Normaliser(tables).resolve

    def _declared(self, raw: str, source: str) -> dict:
        n, m = self.resolve(raw)
        return {"raw": raw, "source": source, "normalized": n, "method": m}

    def _slots(self, entry: dict) -> list[dict]:
        held = ([(t, slot) for path, slot in CDX_LICENSE if (t := text(x, path))][:1] for x in nodes(entry, "licenses[]"))
        return [self._declared(*h[0]) for h in held if h]

    @staticmethod
    def _target(node: dict, where: dict[str, str], declared: list[dict], **more) -> dict:
        return fields(node, where) | {"licenses": [x for d in declared if (x := d["normalized"] or d["raw"])], "raw": dump(node)} | more

    # CycloneDX
    def cyclonedx(self, data: dict, row: dict) -> None:
        made = [t for t in (text(data, "metadata.manufacturer.name", "metadata.manufacture.name"),) if t]
        tool = next((t for t in ("metadata.tools[]", "metadata.tools.components[]") if nodes(data, t)), "metadata.tools.components[]")
        tools = nodes(data, tool) + (nodes(data, "metadata.tools.services[]") if tool.endswith("components[]") else [])
        row |= fields(data, CDX_DOCUMENT) | {
            "creators": [t for a in nodes(data, "metadata.authors[]") if (t := text(a, "name", "email"))] + made, "tools": [t for x in tools if (t := text(x, "name"))], "tool_versions": [t for x in tools if (t := text(x, "version"))],
            "lifecycles": [t for x in nodes(data, "metadata.lifecycles[]") if (t := text(x, "phase", "name"))], "signed": any(nodes(data, "signature") + nodes(data, "metadata.signature")), "raw": dump(data, ("components", "dependencies")),
        }
        for c in objects(data, "components[]"):
            d = self._slots(c)
            row["components"].append(self._target(c, CDX_COMPONENT, d, license_declarations=d, hashes=digests(nodes(c, "hashes[]"), "alg", "content"), external_refs=[dump(x) for x in nodes(c, "externalReferences[]")]))
        as_file = lambda c: self._target(c, CDX_FILE, self._slots(c), hashes=digests(nodes(c, "hashes[]"), "alg", "content"))
        row["files"] = [as_file(c) for c in _file_nodes(nodes(data, "components[]") + nodes(data, "metadata.component.components[]"))]
        for root in objects(data, "metadata.component"):
            own = as_file(root)
            by = "spdx_id" if own["spdx_id"] else "name"
            if (text(root, "type") or "").lower() == "file" and own[by] not in {f[by] for f in row["files"]}:
                row["files"].insert(0, own)
        for d in objects(data, "dependencies[]"):
            ends = [t for x in nodes(d, "dependsOn[]") if (t := plain(x)) is not None]
            if (src := text(d, "ref")) is not None:
                row["edges"] += [{"src": src, "dst": t} for t in ends or [None]]

    # SPDX 2
    def spdx2(self, data: dict, row: dict) -> None:
        creators = texts(data, "creationInfo.creators[]")
        tools = [c.removeprefix("Tool:").strip() for c in creators if c.startswith("Tool:")]
        row |= fields(data, SPDX_DOCUMENT) | {"creators": creators, "tools": tools, "tool_versions": [t.rpartition("-")[2].strip() for t in tools if "-" in t], "raw": dump(data, ("packages", "files", "relationships"))}
        if row["timestamp"]:
            row["timestamp"] = re.sub(r"[Zz]$", "+00:00", row["timestamp"])
        for p in objects(data, "packages[]"):
            refs = [r if isinstance(r, dict) else {} for r in nodes(p, "externalRefs[]")]
            of_kind = {k: text(r, "referenceLocator") for r in reversed(refs) if isinstance(k := r.get("referenceType"), str)}
            cpe = next((text(r, "referenceLocator") for r in refs if r.get("referenceType") in ("cpe23Type", "cpe22Type")), None)
            slot = "licenseConcluded" if text(p, "licenseDeclared") is None else "licenseDeclared"
            d = [self._declared(raw, slot) for raw in (text(p, slot),) if raw]
            row["components"].append(self._target(
                p, SPDX_PACKAGE, d, license_declarations=d, type=None, publisher=None, purl=of_kind.get("purl"), cpe=cpe, hashes=digests(nodes(p, "checksums[]"), "algorithm", "checksumValue"), external_refs=[dump(r) for r in refs],
            ))
        for f in objects(data, "files[]"):
            found = texts(f, "licenseInfoInFiles[]") or texts(f, "licenseConcluded")
            row["files"].append(self._target(f, SPDX_FILE, [], hashes=digests(nodes(f, "checksums[]"), "algorithm", "checksumValue")) | {"licenses": found})
        for r in objects(data, "relationships[]"):
            src, dst = text(r, "spdxElementId"), text(r, "relatedSpdxElement")
            if r.get("relationshipType") in EDGES and src and dst and dst not in NO_END:
                row["edges"].append({"src": src, "dst": dst})

    # SPDX 3
    def spdx3(self, data: dict, row: dict) -> None:
        row["raw"] = dump(data, ("@graph",))
        for n in objects(data, "@graph[]"):
            named = n.get("type", n.get("@type"))
            kinds = {re.split(r"[/#:_]", k)[-1] for k in (named if isinstance(named, list) else [named]) if isinstance(k, str)}
            own = lambda name, n=n: text(n, f"software_{name}" if f"software_{name}" in n else name)
            ident = text(n, "spdxId", "@id")
            used = [h for h in (nodes(n, "verifiedUsing[]") or nodes(n, "verifiedUsing")) if isinstance(h, dict) and "Hash" in str(h.get("type", h.get("@type", "")))]
            hashes = {re.split(r"[/#:]", a)[-1].removeprefix("hashalgorithm_"): v for a, v in digests(used, "algorithm", "hashValue").items()}
            if kinds & {"Package", "File"}:
                row["components"].append(self._target(
                    n, {"name": "name"}, [], license_declarations=[], **dict.fromkeys(("type", "cpe", "supplier", "author", "publisher")), bom_ref=ident, version=own("packageVersion"), purl=own("packageUrl"), hashes=hashes, external_refs=[],
                ))
            if "File" in kinds:
                row["files"].append(self._target(n, {"name": "name"}, [], spdx_id=ident, copyright=own("copyrightText"), hashes=dict(hashes)))
            if "SpdxDocument" in kinds:
                row |= {"name": text(n, "name"), "namespace": ident}
            if "CreationInfo" in kinds:
                row |= {"timestamp": text(n, "created"), "creators": texts(n, "createdBy[]")}

    def row(self, doc_id: int, whole: str, fmt: str, version: str, encoding: str) -> dict:
        row = {f.name: None for f in _ROW} | {"doc_id": doc_id, "sbom_format": fmt, "spec_version": version, "encoding": encoding, "signed": False, "creators": [], "tools": [], "tool_versions": [], "lifecycles": [], "components": [], "files": [], "edges": []}
        try:
            data = {"json": json.loads, "yaml": _yaml, "tagvalue": tag_value, "xml": _xml if fmt == "cyclonedx" else _spdx_xml}[encoding](whole)
            row["schema_errors"] = structural_errors(data, fmt, version)
            read = self.cyclonedx if fmt == "cyclonedx" else self.spdx3 if version.startswith("3") else self.spdx2
            read(data if isinstance(data, dict) else {}, row)
        except (ValueError, ET.ParseError, RecursionError) as e:  # one hostile document must not stop the corpus
            row |= {"components": [], "files": [], "edges": [], "schema_errors": [f"could not be parsed: {e}"]}
        return row


def _yaml(text: str):
    import yaml

    try:
        return json.loads(json.dumps(yaml.safe_load(text), default=str))
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def tag_value(text: str) -> dict:
    """SPDX 2 tag-value text in the shape of its JSON form."""
    doc: dict = {"creationInfo": {"creators": []}, "packages": [], "files": [], "relationships": []}
    entity: dict = doc
    names = {"SPDXVersion": "spdxVersion", "DataLicense": "dataLicense", "DocumentName": "name", "DocumentNamespace": "documentNamespace"}
    for m in re.finditer(r"(?ms)^([A-Za-z]+):[ \t]*(<text>.*?</text>|[^\n]*)", text):
        tag, value = m[1], re.sub(r"</?text>", "", m[2]).strip()
        if tag in ("PackageName", "FileName"):
            entity = {"name" if tag == "PackageName" else "fileName": value}
            doc["packages" if tag == "PackageName" else "files"].append(entity)
        elif tag == "Creator":
            doc["creationInfo"]["creators"].append(value)
        elif tag == "Created":
            doc["creationInfo"]["created"] = value
        elif tag == "Relationship" and len(p := value.split()) >= 3:
            doc["relationships"].append({"spdxElementId": p[0], "relationshipType": p[1], "relatedSpdxElement": p[2]})
        elif tag == "ExternalRef" and len(p := value.split(None, 2)) == 3:
            entity.setdefault("externalRefs", []).append({"referenceCategory": p[0], "referenceType": p[1], "referenceLocator": p[2]})
        elif tag in ("PackageChecksum", "FileChecksum") and ":" in value:
            alg, digest = value.split(":", 1)
            entity.setdefault("checksums", []).append({"algorithm": alg.strip(), "checksumValue": digest.strip()})
        elif tag == "LicenseInfoInFile":
            entity.setdefault("licenseInfoInFiles", []).append(value)
        elif tag in names:
            doc[names[tag]] = value
        elif tag == "SPDXID":
            entity["SPDXID"] = value
        elif tag.startswith("Package"):
            name = {"PackageDownloadLocation": "downloadLocation", "PackageVersion": "versionInfo", "PackageLicenseConcluded": "licenseConcluded", "PackageLicenseDeclared": "licenseDeclared", "PackageCopyrightText": "copyrightText"}.get(tag, tag[7:8].lower() + tag[8:])
            entity[name] = value
        elif tag.startswith(("File", "License")):
            entity[{"LicenseConcluded": "licenseConcluded", "FileCopyrightText": "copyrightText"}.get(tag, tag)] = value
    return doc


def _tree(text: str) -> ET.Element:
    if re.search(r"(?i)<!(?:DOCTYPE|ENTITY)", text):
        raise ValueError("document type declarations are refused")
    return ET.fromstring(text)


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _xml(text: str) -> dict:
    """CycloneDX XML in the shape of its JSON form."""

    def component(e: ET.Element) -> dict:
        out: dict = {"type": e.get("type"), "bom-ref": e.get("bom-ref")}
        for c in e:
            t = _tag(c)
            if t == "hashes":
                out[t] = [{"alg": h.get("alg"), "content": h.text} for h in c]
            elif t == "licenses":
                out[t] = [{"expression": x.text} if _tag(x) == "expression" else {"license": {_tag(y): y.text for y in x}} for x in c]
            elif t == "components":
                out[t] = [component(x) for x in c]
            elif t in ("supplier", "manufacturer", "manufacture"):
                out[t] = {_tag(x): x.text for x in c}
            elif t == "externalReferences":
                out[t] = [{"type": x.get("type")} | {_tag(y): y.text for y in x} for x in c]
            elif not len(c):
                out[t] = c.text
        return out

    root = _tree(text)
    data: dict = {"bomFormat": "CycloneDX", "specVersion": (re.search(r"bom/([\d.]+)", root.tag) or ["", ""])[1], "serialNumber": root.get("serialNumber"), "version": root.get("version")}
    for part in root:
        t = _tag(part)
        if t == "components":
            data[t] = [component(c) for c in part]
        elif t == "dependencies":
            data[t] = [{"ref": d.get("ref"), "dependsOn": [x.get("ref") for x in d]} for d in part]
        elif t == "Signature":
            data["signature"] = True
        elif t == "metadata":
            meta = data["metadata"] = {}
            for m in part:
                k = _tag(m)
                if k == "component":
                    meta[k] = component(m)
                elif k == "authors":
                    meta[k] = [{_tag(y): y.text for y in a} for a in m]
                elif k == "tools":
                    meta[k] = [component(x) for y in m for x in (y if _tag(y) in ("components", "services") else [y])]
                elif k == "lifecycles":
                    meta[k] = [{_tag(y): y.text for y in a} for a in m]
                elif k in ("supplier", "manufacturer", "manufacture"):
                    meta[k] = {_tag(x): x.text for x in m}
                elif not len(m):
                    meta[k] = m.text
    return data


def _spdx_xml(text: str) -> dict:
    """SPDX 2 XML in the shape of its JSON form: repeated elements of the listed names are lists."""
    lists = {"packages", "files", "relationships", "externalRefs", "checksums", "creators", "licenseInfoInFiles"}

    def value(e: ET.Element):
        if not len(e):
            return (e.text or "").strip()
        out: dict = {}
        for c in e:
            t = _tag(c)
            if t in lists:
                out.setdefault(t, []).append(value(c))
            else:
                out[t] = value(c)
        return out

    root = value(_tree(text))
    return root if isinstance(root, dict) else {}


def read(df: DataFrame, key: str, text: str, tables: licenses.LicenseTables | None = None) -> Corpus:
    """The corpus of the documents in a column of texts.

    Texts that are no bill of materials (see ``detect``) are left out; documents that break off while they are read
    keep a row with ``schema_errors``. Null texts are left out. Repeated keys give repeated documents. Members of a
    wrong type count as absent.
    """
    t = tables or licenses.LicenseTables()
    d = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), detect(F.col(f"`{text}`")).alias("k")).where(F.col("k.error").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(t)
        for b in batches:
            for a in range(0, b.num_rows, 200):
                cols = b.slice(a, 200).to_pydict()
                rows = [reader.row(*x) for x in zip(cols["doc_id"], cols["text"], cols["sbom_format"], cols["spec_version"], cols["encoding"])]
                for r in rows:
                    for x in (*r["components"], *r["files"]):
                        x["hashes"] = list(x["hashes"].items())
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    rows = d.select("doc_id", "text", "k.sbom_format", "k.spec_version", "k.encoding").mapInArrow(run, _DDL)
    rows = cut(rows)  # parsed once for the four tables
    each = lambda c, f=F.posexplode: rows.select("doc_id", f(c).alias("pos", "x")).select("doc_id", F.col("pos").cast("long"), "x.*")
    return Corpus(rows.drop("components", "files", "edges"), each("components"), each("files"), rows.select("doc_id", F.explode("edges").alias("x")).select("doc_id", "x.*"))


def read_files(spark: SparkSession, path: str, tables: licenses.LicenseTables | None = None) -> tuple[Corpus, DataFrame]:
    """The corpus of files below a path, and the table of their names (doc_id, path)."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("doc_id", F.xxhash64("path"))
    return read(files, "doc_id", "text", tables), files.select("doc_id", "path")
