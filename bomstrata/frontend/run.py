"""Documents of files against profiles: findings, scores and verdicts in one call."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomstrata.operators import licenses, overlays, profiles, scoring
from bomstrata.operators.engine import findings
from bomstrata.plans import reports
from bomstrata.sources.detect import detect
from bomstrata.sources.documents import read


class UnreadableError(ValueError):
    """A document that is no bill of materials."""


@dataclass
class Run:
    """``files``: doc_id, path; ``findings`` and ``results`` as in ``engine`` and ``reports``; ``profiles`` in the order asked for."""

    files: DataFrame
    findings: DataFrame
    results: DataFrame
    profiles: list[profiles.Profile]

    def failed(self) -> bool:
        return not self.results.where(F.col("verdict") == "FAIL").isEmpty()


def run(spark: SparkSession, path: str, names: list[str], extra: list[str] | None = None, policy: licenses.Policy | None = None, tables: licenses.LicenseTables | None = None) -> Run:
    """Every document below ``path`` under every profile; each profile gives its own verdict and score.

    Profiles are found and composed first, so an unknown or withdrawn one fails before any document is read. A file
    that is no bill of materials raises ``UnreadableError``, which names it.
    """
    chosen = [profiles.load(n, extra) for n in names]
    t = tables or overlays.tables()
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    files = files.withColumn("doc_id", F.xxhash64("path"))
    wrong = files.select("path", detect(F.col("text"))["error"].alias("error")).where(F.col("error").isNotNull()).first()
    if wrong is not None:
        raise UnreadableError(f"{wrong['path']}: {wrong['error']}")
    corpus = read(files, "doc_id", "text", t)
    f = findings(corpus, chosen, policy, t)
    signals = scoring.signals(corpus)
    scores = scoring.scores(signals, chosen[0])
    for p in chosen[1:]:
        scores = scores.unionByName(scoring.scores(signals, p))
    return Run(files.select("doc_id", "path"), f, reports.results(f, scores), chosen)


def blocks(r: Run) -> Iterator[tuple[str, profiles.Profile, dict, list[dict]]]:
    """(path, profile, result, findings) of each document and profile, a document at a time.

    For rendering whole documents: rows come in order of the document, so that one block is held at a time.
    """
    rank = {p.id: i for i, p in enumerate(r.profiles)}
    known = {(x["doc_id"], x["profile"]): x.asDict() for x in r.results.toLocalIterator()}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("profile")]
    rows = r.findings.join(r.files.withColumnRenamed("path", "file"), "doc_id").withColumn("_rank", order).orderBy("file", "_rank", "ord", "pos")
    key, held = None, []
    for x in rows.toLocalIterator():
        now = (x["file"], x["doc_id"], x["profile"])
        if now != key and held:
            yield key[0], r.profiles[rank[key[2]]], known[key[1:]], held
            held = []
        key = now
        held.append(x.asDict())
    if held:
        yield key[0], r.profiles[rank[key[2]]], known[key[1:]], held
