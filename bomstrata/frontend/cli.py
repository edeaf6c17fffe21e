"""Command line. Exit codes: 0 nothing failed, 1 something did, 2 the document or the call could not be processed.

``validate`` takes a file or a folder. ``schema``, ``conformance`` and ``licenses`` are the narrower front ends: structure
only; profiles with a preset; one licence profile per use case (``license-<use case>``, found like any profile).
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from bomstrata.frontend.render import FORMATS, render
from bomstrata.frontend.run import run
from bomstrata.frontend.schema_check import SchemaChecker
from bomstrata.operators import profiles, validators
from bomstrata.session import local_session

FAILED, ERROR = 1, 2
KINDS = ("spdx-json", "spdx-xml", "cyclonedx-json", "cyclonedx-xml")
USE_CASES = ("distribution", "internal", "mobile", "saas")
#: Options that are gone, and what stands for them.
REPLACED = {"rules": "--profile / --profile-path", "license_rules": "--use-case, or a profile with license_policy.policy_path"}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bomstrata", description="Bills of materials against profiles.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, file: bool = True, search: bool = True, formats: bool = False) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=about)
        if file:
            c.add_argument("--file", required=True, help="document, or a folder of documents")
        if search:
            c.add_argument("--profile-path", help=f"further profile folders, separated by {os.pathsep!r}")
        if formats:
            c.add_argument("--format", choices=sorted(FORMATS), default="console")
        return c

    command("validate", "verdict and score under profiles", formats=True).add_argument("--profile", action="append", required=True)
    command("profiles", "profiles that can be found", file=False)
    command("validators", "validators that rules can name", file=False, search=False)
    c = command("schema", "structure of one document", file=False, search=False)
    c.add_argument("file")
    c.add_argument("--format", choices=KINDS, help="kind that the document has to be of")
    c.add_argument("--json", action="store_true")
    c = command("conformance", "verdict under the preset profiles or others")
    c.add_argument("--profile", action="append")
    c.add_argument("--json-output", action="store_true")
    c.add_argument("--rules", help=argparse.SUPPRESS)
    c = command("licenses", "declared licences under the policy of a use case")
    c.add_argument("--use-case", choices=USE_CASES, default="distribution")
    c.add_argument("--json-output", action="store_true")
    c.add_argument("--license-rules", help=argparse.SUPPRESS)
    return top


def _report(spark: SparkSession, args: argparse.Namespace, names: list[str], fmt: str, out) -> int:
    extra = args.profile_path.split(os.pathsep) if args.profile_path else None
    if not os.path.exists(args.file):
        raise FileNotFoundError(f"there is no {args.file}")
    r = run(spark, args.file, names, extra)
    for _, text in render(r, fmt):
        print(text, file=out)
    return FAILED if r.failed() else 0


def _profiles(args: argparse.Namespace, out) -> int:
    extra = args.profile_path.split(os.pathsep) if args.profile_path else None
    for name in profiles.catalog(extra):
        try:
            print(f"{name:<28} {profiles.load(name, extra).name}", file=out)
        except Exception:  # noqa: BLE001 - a broken profile is listed by its id
            print(name, file=out)
    return 0


def _schema(spark: SparkSession, args: argparse.Namespace, out) -> int:
    r = SchemaChecker(spark).validate(args.file)
    if args.format and r.kind != args.format:
        raise ValueError(f"Format mismatch: detected {r.kind}, expected {args.format}")
    print(json.dumps(r.as_dict(), indent=2) if args.json else r, file=out)
    return 0 if r.valid else FAILED


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Run one command; every failure becomes a message and code 2, never a traceback."""
    out = out or sys.stdout
    args = _parser().parse_args(argv)
    try:
        validators.load_plugins()
        for option, now in REPLACED.items():
            if getattr(args, option, None) is not None:
                raise ValueError(f"--{option.replace('_', '-')} is no longer supported: rules live in profiles; use {now}")
        if args.command == "profiles":
            return _profiles(args, out)
        if args.command == "validators":
            print("\n".join(validators.available()), file=out)
            return 0
        session = spark or SparkSession.getActiveSession() or local_session()
        if args.command == "schema":
            return _schema(session, args, out)
        if args.command == "validate":
            return _report(session, args, args.profile, args.format, out)
        fmt = "json" if args.json_output else "console"
        names = args.profile or ["baseline", "strict"] if args.command == "conformance" else [f"license-{args.use_case}"]
        return _report(session, args, names, fmt, out)
    except Exception as e:  # noqa: BLE001
        print(f"Error: {e}", file=sys.stderr)
        return ERROR
