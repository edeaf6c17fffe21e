"""Results as console text, JSON and SARIF, one row per document; and the exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomstrata.operators.engine import top_issues, verdicts
from bomstrata.operators.profiles import CATEGORIES


def results(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """``doc_id, profile, verdict, must_violations, score`` and category scores."""
    return verdicts(findings).join(scores, ["doc_id", "profile"])


def console(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """``doc_id, profile, report``: verdict, score, categories and the three most serious issues."""
    issues = top_issues(findings).groupBy("doc_id", "profile").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("issue_no", "issue"))), lambda x: F.concat(F.lit("  "), x["issue_no"].cast("string"), F.lit(". "), x["issue"])), "\n").alias("issues"))
    r = results(findings, scores).join(issues, ["doc_id", "profile"], "left")
    n = F.col("must_violations")
    head = F.concat(F.lit("Profile: "), "profile", F.lit("\nVerdict: "), "verdict", F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.when(n == 1, " MUST violation)").otherwise(" MUST violations)"))).otherwise(""), F.lit("\nQuality score: "), F.col("score").cast("string"), F.lit(" / 100"))
    cats = F.concat(*[F.concat(F.lit("\n" + f"  {c + ':':<14}"), F.col(c).cast("string")) for c in CATEGORIES])
    return r.select("doc_id", "profile", F.concat(head, cats, F.coalesce(F.concat(F.lit("\nTop issues:\n"), "issues"), F.lit(""))).alias("report"))


def as_json(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """One JSON text per finding and one per result: ``doc_id, profile, kind, json``. Written as text, they are JSON lines."""
    f = findings.select("doc_id", "profile", F.lit("finding").alias("kind"), F.to_json(F.struct("rule_id", "layer", "severity", "category", "verdict", "citation", "path", "message")).alias("json"))
    r = results(findings, scores).select("doc_id", "profile", F.lit("result").alias("kind"), F.to_json(F.struct("profile", "verdict", "score", "must_violations", F.struct(*CATEGORIES).alias("category_scores"))).alias("json"))
    return f.unionByName(r)


def sarif_results(findings: DataFrame) -> DataFrame:
    """``doc_id, profile, rule_id, level, sarif``: one SARIF result per finding that did not pass."""
    level = F.when(F.col("verdict") == "FAIL", "error").otherwise("warning")
    body = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.array(F.struct(F.coalesce("path", F.lit("")).alias("fullyQualifiedName"))).alias("logicalLocations"))).alias("locations"))
    return findings.where(F.col("verdict") != "PASS").select("doc_id", "profile", "rule_id", level.alias("level"), F.to_json(body).alias("sarif"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """``profile, rule_id, sarif``: the rules that SARIF results refer to, each once."""
    d = findings.where(F.col("verdict") != "PASS").groupBy("profile", "rule_id").agg(F.min(F.struct("ord", "severity", "category", "citation")).alias("x"))
    body = F.struct(F.col("rule_id").alias("id"), F.struct("x.category", "x.severity").alias("properties"), F.struct(F.coalesce("x.citation", "rule_id").alias("text")).alias("shortDescription"))
    return d.select("profile", "rule_id", F.to_json(body).alias("sarif"))


def exit_code(findings: DataFrame) -> int:
    """1 if any document fails any profile, else 0."""
    return int(not verdicts(findings).where(F.col("verdict") == "FAIL").isEmpty())
