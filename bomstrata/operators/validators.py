"""The validator library as SQL expressions.

Each validator turns a value (``Value``: a scalar, list or map), the context and its parameters into the text of one
SQL expression: null where the value passes, else the reason. Chains become one ``coalesce``, so the first failure
wins and everything stays inside generated code. Text is cheap to build, and equal checks of several profiles are equal
texts, so each is compiled once (``engine``). Names and parameters are checked on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from bomstrata.functions import patterns
from bomstrata.functions.text import NULL_TOKENS, WHITESPACE
from bomstrata.operators.profiles import ProfileError

#: Hex digits of a digest by algorithm.
DIGEST_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha384": 96, "sha512": 128, "sha3256": 64, "sha3384": 96, "sha3512": 128, "blake2b256": 64, "blake2b384": 96, "blake2b512": 128, "blake3": 64}
_ATTRIBUTE = r"(?:(?:\?*|\*?)(?:[a-zA-Z0-9\-._]|\\[\\*?!\"#$%&'()+,/:;<=>@\[\]^`{|}~])+(?:\?*|\*?)|[*\-])"
#: The two bindings of CPE names, after the public grammar.
CPE_23 = rf"\Acpe:2\.3:[aho*\-](?::{_ATTRIBUTE}){{5}}:(?:[a-zA-Z]{{2,3}}(?:-(?:[a-zA-Z]{{2}}|[0-9]{{3}}))?|[*\-])(?::{_ATTRIBUTE}){{4}}\z"
CPE_22 = r"(?i)\Acpe:/[aho]?(?::[a-z0-9._\-~%]*){0,6}\z"
_TEXTS = "ARRAY<STRING>"
_DECLARATIONS = "ARRAY<STRUCT<raw: STRING, source: STRING, normalized: STRING, method: STRING>>"


def lit(text) -> str:
    """A value as a SQL literal."""
    if text is None:
        return "CAST(NULL AS STRING)"
    if isinstance(text, bool):
        return str(text).lower()
    if isinstance(text, int):
        return str(text)
    out = "".join("\\" + c if c in "\\'" else c if 32 <= ord(c) < 127 else f"\\u{ord(c):04X}" if ord(c) < 65536 else f"\\U{ord(c):08X}" for c in str(text))
    return f"'{out}'"


def concat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def strip(x: str) -> str:
    return f"trim(BOTH {lit(WHITESPACE)} FROM {x})"


def is_token(x: str) -> str:
    return f"(lower({strip(x)}) IN ({', '.join(map(lit, NULL_TOKENS))}))"


def matches(x: str, pattern: str) -> str:
    return f"({x} RLIKE {lit(pattern)})"


def case(*branches: tuple[str, str], default: str = "CAST(NULL AS STRING)") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in branches) + f" ELSE {default} END"


@dataclass(frozen=True)
class Value:
    """A field of a target. ``kind``: scalar, list, map or none; ``sql``: its expression."""

    kind: str
    sql: str = "CAST(NULL AS STRING)"

    @property
    def text(self) -> str:
        return f"CAST({self.sql} AS STRING)"

    def items(self) -> str:
        """The value as a list of texts; a map gives its values."""
        empty = f"CAST(array() AS {_TEXTS})"
        if self.kind == "scalar":
            return f"IF({self.sql} IS NULL, {empty}, array({self.text}))"
        if self.kind == "list":
            return f"coalesce({self.sql}, {empty})"
        return f"coalesce(map_values({self.sql}), {empty})" if self.kind == "map" else empty

    def absent(self) -> str:
        if self.kind == "scalar":
            return f"({self.sql} IS NULL)"
        return f"(size({self.items()}) = 0)"

    def has_value(self) -> str:
        """Something to act on: not empty, and not only null tokens."""
        if self.kind == "scalar":
            return f"({self.sql} IS NOT NULL AND NOT {is_token(self.text)})"
        return f"(size({self.items()}) > 0 AND NOT forall({self.items()}, t_ -> coalesce({is_token('t_')}, false)))"


def quoted(x: str) -> str:
    """A text as a quoted literal."""
    t = x
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        t = f"replace({t}, {lit(a)}, {lit(b)})"
    one, two = lit("'"), lit('"')
    shown = case((f"contains(q_, {one}) AND NOT contains(q_, {two})", concat(two, "q_", two)), default=concat(one, f"replace(q_, {one}, {lit(chr(92) + chr(39))})", one))
    return f"get(transform(array({t}), q_ -> {shown}), 0)"


def _first(value: Value, reason: Callable[[str], str]) -> str:
    """The reason of the first item that has one."""
    if value.kind == "scalar":
        return case((f"{value.sql} IS NOT NULL", reason(value.text)))
    return f"get(array_compact(transform({value.items()}, x_ -> {reason('x_')})), 0)"


def _each(value: Value, ok: Callable[[str], str], text: str) -> str:
    return _first(value, lambda x: case((f"NOT coalesce({ok(x)}, false)", concat(quoted(x), lit(text)))))


def present(v: Value, ctx: dict, p: dict) -> str:
    return case((v.absent(), lit("field is absent or empty")), (f"NOT {v.has_value()}", lit("field is present but NOASSERTION/NONE/empty")))


def non_placeholder(v: Value, ctx: dict, p: dict) -> str:
    return _first(v, lambda x: case((matches(x, patterns.PLACEHOLDER), concat(lit("placeholder value: "), quoted(x)))))


def format_regex(v: Value, ctx: dict, p: dict) -> str:
    pattern = p.get("pattern")
    if not pattern:
        return lit("format_regex requires a 'pattern'")
    return _each(v, lambda x: matches(x, pattern), f" does not match /{pattern}/")


_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TIME = r"[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?"
_REAL_DAY = (
    r"(?!0000)(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
    r"|(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29)"
)


def _leap_second(s: str) -> str:
    """Whether a text that ends in second 60 names the last minute of a month in UTC."""
    num = lambda a, n: f"CAST(substr({s}, {a}, {n}) AS INT)"
    zone = f"IF(lower(right({s}, 1)) = 'z', 0, IF(substr({s}, -6, 1) = '-', -1, 1) * (CAST(substr({s}, -5, 2) AS INT) * 60 + CAST(right({s}, 2) AS INT)))"
    at = f"timestampadd(MINUTE, -({zone}), try_make_timestamp_ntz({num(1, 4)}, {num(6, 2)}, {num(9, 2)}, {num(12, 2)}, {num(15, 2)}, 0))"
    ends = "year(u_) BETWEEN 1 AND 9999 AND to_date(u_) < DATE'9999-12-31' AND hour(u_) = 23 AND minute(u_) = 59 AND dayofmonth(date_add(to_date(u_), 1)) = 1"
    return f"coalesce(get(transform(array({at}), u_ -> {ends}), 0), false)"


def rfc3339_reason(x: str) -> str:
    """Why a text is no RFC 3339 date and time with an offset; null if it is one."""
    s = strip(x)
    say = lambda t: concat(quoted(x), lit(t))
    return case(
        (f"NOT {matches(s, rf'\A{_DAY}{_TIME}(?:[Zz]|[+-][0-9]{{2}}:[0-9]{{2}})\z')}", case((matches(s, rf"\A{_DAY}{_TIME}\z"), say(" lacks a UTC/timezone designator")), default=say(" is not an RFC 3339 timestamp"))),
        (f"NOT {matches(s, r'\A.{11}(?:[01][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)')}", say(" is not a real time")),
        (f"NOT {matches(s, rf'\A{_REAL_DAY}')}", say(" is not a real date")),
        (f"NOT {matches(s, r'(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])\z')}", say(" has an out-of-range UTC offset")),
        (f"substr({s}, 18, 2) = '60' AND NOT {_leap_second(s)}", say(" puts a leap second somewhere other than the last minute of a UTC month")),
    )


def rfc3339_utc(v: Value, ctx: dict, p: dict) -> str:
    return _first(v, rfc3339_reason)


def _declarations(ctx: dict) -> str:
    return f"coalesce({ctx['license_declarations']}, CAST(array() AS {_DECLARATIONS}))"


def spdx_license_expression(v: Value, ctx: dict, p: dict) -> str:
    known = ctx["valid_expressions"]  # the target's licence texts that are expressions
    return _first(v, lambda x: case((f"NOT {is_token(x)} AND NOT array_contains({known}, {x})", concat(quoted(x), lit(" is not a valid SPDX license expression")))))


def _some(reasons: str) -> str:
    """The first three of a list of reasons, or null."""
    return f"nullif(array_join(slice({reasons}, 1, 3), '; '), '')"


def license_spdx_normalized(v: Value, ctx: dict, p: dict) -> str:
    from bomstrata.operators.licenses import AMBIGUOUS, prose_key_sql

    where = concat(quoted("d_.raw"), lit(" (declared in the "), quoted("d_.source"), lit(" field)"))
    meant = f"map({', '.join(lit(x) for kv in AMBIGUOUS.items() for x in kv)})"
    unknown = lit(None) if p.get("allow_declared_unknown", True) else concat(quoted("d_.raw"), lit(" is an explicit unknown"))
    reason = case(
        ("d_.normalized IS NOT NULL", lit(None)), ("d_.method = 'declared-unknown'", unknown),
        ("d_.method = 'ambiguous'", concat(where, lit(" names a licence but not an SPDX identifier: it does not say whether later versions are permitted, so it could be "), f"coalesce(try_element_at({meant}, {prose_key_sql('d_.raw')}), '?')")),
        default=concat(where, lit(" does not resolve to an SPDX license")),
    )
    return _some(f"array_compact(transform({_declarations(ctx)}, d_ -> {reason}))")


def license_in_spdx_field(v: Value, ctx: dict, p: dict) -> str:
    bad = f"filter({_declarations(ctx)}, d_ -> d_.source = 'name' AND d_.method IN ('spdx-expression', 'case-corrected'))"
    return _some(f"transform({bad}, d_ -> {concat(quoted('d_.raw'), lit(' is valid SPDX but was declared in the free-text ' + repr('name') + ' field rather than ' + repr('expression')))})")


def _purl_reason(x: str) -> str:
    return case((f"NOT {matches(x, patterns.PURL)}", concat(quoted(x), lit(" is not a well-formed PURL"))))


def purl_wellformed(v: Value, ctx: dict, p: dict) -> str:
    return _first(v, lambda x: case((f"{x} <> ''", _purl_reason(x))))


def _cpe_reason(x: str) -> str:
    s = strip(x)
    parts = f"size(split(regexp_replace({s}, {lit(r'\\.')}, ''), ':'))"
    say = lambda *t: concat(quoted(x), *t)
    new = case((f"{parts} <> 13", say(lit(" is not a well-formed CPE 2.3 name: expected 13 colon-separated components, found "), parts)), default=say(lit(" is not a well-formed CPE 2.3 name (NIST IR 7695 §6.2.2)")))
    return case(
        (f"{x} = ''", lit(None)), (matches(s, CPE_23), lit(None)), (f"startswith({s}, 'cpe:2.3:')", new), (matches(s, CPE_22), lit(None)),
        (f"startswith(lower({s}), 'cpe:/')", say(lit(" is not a well-formed CPE 2.2 URI (NIST IR 7695 §6.1)"))), default=say(lit(" is not a CPE name (expected a 'cpe:2.3:' or 'cpe:/' prefix)")),
    )


def cpe_wellformed(v: Value, ctx: dict, p: dict) -> str:
    return _first(v, _cpe_reason)


def component_identifier(v: Value, ctx: dict, p: dict) -> str:
    def reason(x: str) -> str:
        starts = lambda t: f"startswith(lower({strip(x)}), '{t}')"
        return case((f"{x} = ''", lit(None)), (starts("cpe:"), _cpe_reason(x)), (starts("pkg:"), _purl_reason(x)), default=concat(quoted(x), lit(" is neither a purl (expected a 'pkg:' prefix) nor a CPE name (expected 'cpe:')")))

    return _first(v, reason)


def semver_or_calver(v: Value, ctx: dict, p: dict) -> str:
    return _each(v, lambda x: matches(strip(x), patterns.VERSION), " is neither SemVer nor CalVer")


def _algorithm(x: str) -> str:
    return f"lower(translate({x}, '-_', ''))"


def _hashes(v: Value, ctx: dict) -> str:
    return f"coalesce({v.sql if v.kind == 'map' else ctx['hashes']}, CAST(map() AS MAP<STRING, STRING>))"


def hash_algorithm_in_set(v: Value, ctx: dict, p: dict) -> str:
    algs, keys = [str(a) for a in p.get("algs", [])], f"map_keys({_hashes(v, ctx)})"
    branches = [(f"size({keys}) = 0", lit("no hashes present"))]
    if algs:
        allowed = f"array({', '.join(lit(re.sub('[-_]', '', a).lower()) for a in algs)})"
        have = concat(lit("['"), f"array_join(array_sort({keys}), {lit(chr(39) + ', ' + chr(39))})", lit("']"))
        branches.append((f"NOT arrays_overlap(transform({keys}, a_ -> {_algorithm('a_')}), {allowed})", concat(lit(f"no hash in required set {sorted(algs)} (have "), have, lit(")"))))
    return case(*branches)


def hash_wellformed(v: Value, ctx: dict, p: dict) -> str:
    text, want = strip("coalesce(e_.value, 'None')"), f"try_element_at(map({', '.join(lit(x) for kv in DIGEST_LENGTHS.items() for x in kv)}), {_algorithm('e_.key')})"
    reason = case(
        (f"{text} = ''", concat("e_.key", lit(": empty digest"))), (f"NOT {matches(text, r'\A[a-fA-F0-9]+\z')}", concat("e_.key", lit(": digest is not hexadecimal ("), quoted(f"substr({text}, 1, 16)"), lit(")"))),
        (f"length({text}) <> {want}", concat("e_.key", lit(": digest is "), f"length({text})", lit(" hex chars, expected "), want, lit(" for "), "e_.key")),
    )
    return f"get(array_compact(transform(map_entries({_hashes(v, ctx)}), e_ -> {reason})), 0)"


def format_version_at_least(v: Value, ctx: dict, p: dict) -> str:
    return case(
        *[(f"{ctx['sbom_format']} = {lit(fmt)} AND {ctx['version_tuple']} < array({', '.join(re.findall(r'[0-9]+', str(least)))})", concat(lit(f"{fmt} "), ctx["spec_version"], lit(f" is below required minimum {least}"))) for fmt, least in (p.get("min_versions") or {}).items() if least],
        ("false", lit(None)),
    )


def format_version_not_deprecated(v: Value, ctx: dict, p: dict) -> str:
    old = {fmt: [str(x) for x in retired] for fmt, retired in (p.get("deprecated_versions") or {}).items() if retired}
    return case(
        *[(f"{ctx['sbom_format']} = {lit(fmt)} AND {ctx['spec_version']} IN ({', '.join(map(lit, names))})", concat(lit(f"{fmt} "), ctx["spec_version"], lit(f" is deprecated (retired versions: {', '.join(names)})"))) for fmt, names in old.items()],
        ("false", lit(None)),
    )


def references_vex(v: Value, ctx: dict, p: dict) -> str:
    return case((f"NOT {ctx['vex']}", lit("no VEX / vulnerability reference found")))


def signed_with_x509(v: Value, ctx: dict, p: dict) -> str:
    return case((f"NOT {ctx['signed']}", lit("SBOM is not signed")))


def dependency_completeness(v: Value, ctx: dict, p: dict) -> str:
    return case((f"{ctx['n_components']} = 0", lit(None)), (f"{ctx['n_refs']} = 0", lit("no dependency relationships declared")), (f"{ctx['n_orphans']} > 0", concat(ctx["n_orphans"], lit(" component(s) absent from the dependency graph"))))


def known_unknowns_declared(v: Value, ctx: dict, p: dict) -> str:
    return case((f"{v.sql} IS NULL", lit("silent gap: field missing with no explicit NOASSERTION/NONE")))


def declared(v: Value, ctx: dict, p: dict) -> str:
    silent = f"({v.sql} IS NULL OR {v.text} = '')" if v.kind == "scalar" else v.absent()
    return case((silent, lit("silent gap: no value and no explicit NOASSERTION/NONE")))


REGISTRY: dict[str, Callable[[Value, dict, dict], str]] = {
    f.__name__: f
    for f in (
        present, non_placeholder, format_regex, rfc3339_utc, spdx_license_expression, license_spdx_normalized, license_in_spdx_field, purl_wellformed, cpe_wellformed, component_identifier,
        semver_or_calver, hash_algorithm_in_set, hash_wellformed, format_version_at_least, format_version_not_deprecated, references_vex, signed_with_x509, dependency_completeness, known_unknowns_declared, declared,
    )
}


def register(name: str, validator: Callable[[Value, dict, dict], str] | None = None):
    """Add a validator: a function of value, context and parameters to the SQL of a reason. Also a decorator."""
    if validator is None:
        return lambda f: register(name, f) or f
    REGISTRY[name] = validator


def available() -> list[str]:
    return sorted(REGISTRY)


_LOADED: dict[str, list[str]] = {}


def load_plugins(group: str = "bomstrata.validators") -> list[str]:
    """Load, once, the validators that other packages offer as entry points; one that fails is left out."""
    from importlib.metadata import entry_points

    if group not in _LOADED:
        _LOADED[group] = []
        for e in entry_points(group=group):
            try:
                e.load()(register)
                _LOADED[group].append(e.name)
            except Exception:  # noqa: BLE001, S112 - foreign code must not end the host
                continue
    return _LOADED[group]


def chain(v: Value, ctx: dict, specs: tuple[tuple[str, dict], ...]) -> str:
    """Null if every validator passes, else ``name: reason`` of the first that fails."""
    reasons = []
    for name, params in specs:
        if name not in REGISTRY:
            raise ProfileError(f"unknown validator {name!r} (known: {', '.join(available())})")
        reasons.append(concat(lit(f"{name}: "), REGISTRY[name](v, ctx, params)))
    return f"coalesce({', '.join([*reasons, lit(None)])})"
