"""Reports on whole documents: console text, JSON, and SARIF 2.1.0."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable

from bomstrata.frontend.run import Run, blocks
from bomstrata.operators.profiles import CATEGORIES, Profile

Block = tuple[str, Profile, dict, list[dict]]
#: The address of the SARIF schema, and levels of verdicts.
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
LEVELS = {"FAIL": "error", "WARN": "warning", "PASS": "note"}
_SEVERITY = ("MUST", "MUST_WHERE_AVAILABLE", "SHOULD", "MAY")
_RULE = "-" * 60


def _worst(found: list[dict], limit: int = 3) -> list[dict]:
    bad = [f for f in found if f["verdict"] != "PASS"]
    return sorted(bad, key=lambda f: (f["verdict"] != "FAIL", _SEVERITY.index(f["severity"])))[:limit]


def _categories(result: dict) -> dict[str, int]:
    return {c: result[c] for c in CATEGORIES}


def console(path: str, found: list[Block]) -> str:
    lines = []
    for _, profile, result, rows in found:
        n = result["must_violations"]
        lines += [_RULE, f"Profile: {profile.id}", f"Verdict: {result['verdict']}" + (f" ({n} MUST violation{'s' * (n != 1)})" if n else ""), f"Quality score: {result['score']} / 100"]
        lines += [f"  {c + ':':<14}{v}" for c, v in _categories(result).items()]
        worst = _worst(rows)
        lines += ["Top issues:"] * bool(worst)
        lines += [f"  {i}. {f['category'] or f['layer']}: {f['rule_id']}: {f['message']} [{f['path']}]" for i, f in enumerate(worst, 1)]
    return "\n".join([*lines, _RULE])


def as_json(path: str, found: list[Block]) -> str:
    shown = ("rule_id", "layer", "severity", "category", "verdict", "citation", "path", "message")
    results = [
        {
            "profile": p.id, "name": p.name, "verdict": r["verdict"], "score": r["score"], "schema_valid": all(f["verdict"] == "PASS" for f in rows if f["rule_id"] == "schema-valid"), "sources": p.sources,
            "categories": _categories(r), "findings": [{k: f[k] for k in shown} for f in rows],
        }
        for _, p, r, rows in found
    ]
    return json.dumps({"sbom": path, "results": results}, indent=2, default=str)


def sarif(path: str, found: list[Block]) -> str:
    runs = []
    for _, p, r, rows in found:
        bad = [f for f in rows if f["verdict"] != "PASS"]
        first = {f["rule_id"]: f for f in reversed(bad)}
        rules = [{"id": i, "properties": {"category": first[i]["category"], "severity": first[i]["severity"]}, "shortDescription": {"text": first[i]["citation"] or i}} for i in dict.fromkeys(f["rule_id"] for f in bad)]
        at = lambda f: {"physicalLocation": {"artifactLocation": {"uri": path}}, "logicalLocations": [{"fullyQualifiedName": f["path"] or ""}]}
        results = [{"ruleId": f["rule_id"], "level": LEVELS[f["verdict"]], "message": {"text": f["message"]}, "locations": [at(f)]} for f in bad]
        driver = {"name": f"bomstrata:{p.id}", "rules": rules, "properties": {"verdict": r["verdict"], "score": r["score"], "categories": _categories(r)}}
        runs.append({"tool": {"driver": driver}, "results": results})
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": runs}, indent=2)


FORMATS: dict[str, Callable[[str, list[Block]], str]] = {"console": console, "json": as_json, "sarif": sarif}


def render(r: Run, fmt: str = "console") -> Iterable[tuple[str, str]]:
    """(path, report) of each document; an unknown format is shown as console text."""
    write = FORMATS.get(fmt, console)
    for path, found in itertools.groupby(blocks(r), key=lambda b: b[0]):
        yield path, write(path, list(found))
