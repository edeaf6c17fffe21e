"""Lexical checks as JVM-side predicates. All take a text column and give null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bomstrata.functions.text import WHITESPACE, strip

#: Texts that only hold a place, matched whole and without regard to case.
PLACEHOLDERS = r"todo|tbd|changeme|change[_-]?me|xxx+|n/?a|unknown|example|placeholder|foo|bar|\$\{.*\}|<.*>|0\.0\.0|1\.0\.0-snapshot"
#: What counts as a semantic and as a calendar version.
SEMVER = r"v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?"
CALVER = r"\d{4}(?:[.\-]\d{1,2}){1,2}(?:[.\-][0-9A-Za-z]+)?"

_SPACE = "[" + WHITESPACE + "]"
_SEGMENT, _KEY = r"[^/@?#\s\x0b]+", r"[A-Za-z._\-][A-Za-z0-9._\-]*"

#: Whole-text patterns in the syntax that Java's engine and RE2 (Arrow) share, so that a check gives the same on both.
PLACEHOLDER = rf"(?i)\A{_SPACE}*(?:{PLACEHOLDERS}){_SPACE}*\z"
VERSION = rf"\A(?:{SEMVER}|{CALVER})\z"
PURL = (
    rf"\A[pP][kK][gG]:/*[A-Za-z][A-Za-z0-9.+\-]*/+(?:[^@?#\s\x0b]*/)?{_SEGMENT}/*(?:@[^?#\s\x0b]*)?"
    rf"(?:\?(?:{_KEY}=[^#&\s\x0b]*(?:&{_KEY}=[^#&\s\x0b]*)*)?)?(?:#[^\s\x0b]*)?\z"
)
PARTY = rf"(?s)\A(?:Organization|Person): {_SPACE}*[^(\s\x0b].*\z"


def is_placeholder(c: Column) -> Column:
    return c.rlike(PLACEHOLDER)


def is_semver_or_calver(c: Column) -> Column:
    """White space around a version does not count."""
    return strip(c).rlike(VERSION)


def is_purl(c: Column) -> Column:
    """Well-formed by the public Package URL specification.

    ``pkg:`` (any case; slashes after it are tolerated), a type of letters, digits, ``.``, ``+``, ``-`` that
    starts with a letter, an optional namespace, a name, an optional version, qualifiers ``key=value`` with
    keys of letters, digits, ``.``, ``-``, ``_`` that start with no digit, an optional subpath. No white space.
    """
    return c.rlike(PURL)


def is_party(c: Column) -> Column:
    """``Organization: `` or ``Person: `` (exactly so) and a name, besides a closing address in parentheses."""
    return c.rlike(PARTY)
