"""References to records that do not exist, were withdrawn, or arrived later.

Keys are hashed to 64 bits and the key space is cut into ranges of equal width. Parents are aggregated to
one row per key, then parents and references meet in one shuffle by (range, salt): within a partition the
rows are sorted so that a range's parents come first, already in key order. A vectorised pass keeps those
parents as sorted arrays and probes the following batches of references by binary search; equal hashes are
confirmed on the full key, so a collision can never give a wrong answer.

The number of ranges follows the number of parents (``parents_per_range``), so a task never holds more than
one range of them. Every range with more references than ``ROWS_PER_TASK`` (a key that a third of all rows name) is
split over salts, and only its parents are repeated, once per salt. At most ``HOT_RANGES`` ranges can exceed
the threshold, so the table of salts has a fixed bound and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomstrata.session import cut

#: References of a task, and ranges that can have more: their number times that of the references of each is no more than
#: all references, so where there are more than the product, tasks hold more.
ROWS_PER_TASK, HOT_RANGES = 100_000, 1_000_000

_PROBE = "row_id long, field_name string, target_ref string, outcome string, period string"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probe sorted (range, salt, kind, hash) rows; parents (kind 0) of a group precede its references."""
    here: tuple | None = None
    held: list[pa.RecordBatch] = []
    arrays: tuple | None = None

    def parents():
        t = pa.Table.from_batches(held)
        return (t["h"].to_numpy(), t["sbom_id"].to_numpy(), t["ref"].combine_chunks(), t["gone"].to_numpy(), t["at"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy())

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group = batch["range"].to_numpy() * (1 << 20) + batch["salt"].to_numpy()
        kind = batch["kind"].to_numpy()
        cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, n]):
            part = batch.slice(a, b - a)
            if here != group[a]:
                here, held, arrays = group[a], [], None
            if kind[a] == 0:
                held.append(part)
                continue
            m = b - a
            outcome = np.full(m, "missing", dtype=object)
            if held:
                arrays = arrays or parents()
                h, sb, ref, gone, at = arrays
                want_h, want_s, want_r = part["h"].to_numpy(), part["sbom_id"].to_numpy(zero_copy_only=False), part["ref"]
                pos = np.searchsorted(h, want_h)
                open_ = np.flatnonzero(pos < len(h))
                while len(open_):  # once round, but for hash collisions
                    open_ = open_[(pos[open_] < len(h))]
                    open_ = open_[h[pos[open_]] == want_h[open_]]
                    if not len(open_):
                        break
                    p = pos[open_]
                    same = (sb[p] == want_s[open_]) & pc.equal(ref.take(pa.array(p)), want_r.take(pa.array(open_))).to_numpy(zero_copy_only=False)
                    q, p = open_[same], p[same]
                    own = part["at"].cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()[q]
                    outcome[q] = np.where(gone[p], "deleted", np.where(at[p] > own, "late", ""))
                    open_ = open_[~same]
                    pos[open_] += 1
            keep = np.flatnonzero(outcome != "")
            if len(keep):
                rows = part.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([rows["row_id"], rows["field_name"], rows["target_ref"], pa.array(outcome[keep], pa.string()), rows["period"]], names=["row_id", "field_name", "target_ref", "outcome", "period"])


def _percent_decoded(c: Column) -> Column:
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def references(deps: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct references of each dependency row with the document that they point into.

    A BOM-Link points to the document of that serial number and version (of several, the one with the
    smallest id); a link that names no document keeps a null ``sbom_id`` and so meets no parent.
    """
    ref, on = F.col("dep_ref"), F.col("depends_on")
    both = F.concat(
        F.array(F.struct(F.lit("ref").alias("field_name"), ref.alias("target_ref"))),
        F.transform(F.array_distinct(F.coalesce(on, F.array().cast("array<string>"))), lambda x: F.struct(F.lit("dependsOn").alias("field_name"), x.alias("target_ref"))),
    )
    rows = deps.select(F.col("dep_row_id").alias("row_id"), "sbom_id", F.col("loaded_at").alias("at"), F.substring(F.col("loaded_at").cast("string"), 1, 7).alias("period"), F.explode(both).alias("x"))
    rows = rows.select("row_id", "sbom_id", "at", "period", "x.field_name", "x.target_ref").where(F.col("target_ref").isNotNull())
    link = r"(?s)^urn:cdx:([^/#]+)/([0-9]+)#(.*)$"
    is_link = F.col("target_ref").rlike(link)
    plain = rows.where(~is_link).withColumn("ref", F.col("target_ref"))
    links = rows.where(is_link).select(
        "row_id", "at", "period", "field_name", "target_ref", _percent_decoded(F.regexp_extract("target_ref", link, 3)).alias("ref"),
        F.regexp_extract("target_ref", link, 1).alias("_serial"), F.regexp_extract("target_ref", link, 2).try_cast("long").alias("_version"),
    )
    known = (
        docs.where(F.col("serial_number").isNotNull() & F.col("bom_version").isNotNull())
        .groupBy(F.regexp_replace("serial_number", "^urn:uuid:", "").alias("_serial"), F.col("bom_version").cast("long").alias("_version"))
        .agg(F.min("sbom_id").alias("sbom_id"))
    )
    links = links.join(known, ["_serial", "_version"], "left")
    cols = ["row_id", "sbom_id", "at", "period", "field_name", "target_ref", "ref"]
    return plain.select(cols).unionByName(links.select(cols))


def find_orphans(deps: DataFrame, components: DataFrame, docs: DataFrame, parents_per_range: int = 100_000) -> DataFrame:
    """References that meet no component (``missing``), a withdrawn one (``deleted``) or a later one (``late``).

    ``deps``: dep_row_id, sbom_id, dep_ref, depends_on, loaded_at; ``components``: sbom_id, bom_ref, loaded_at,
    deleted_at; ``docs``: sbom_id, serial_number, bom_version. Result: ``row_id, field_name, target_ref,
    outcome, period``, one row per distinct orphan reference of a dependency row.

    Null references are none; the empty text is one. A null ``bom_ref`` is no parent. A reference with a null
    ``sbom_id`` is missing. A null ``loaded_at`` is never late. Repeated rows are judged each for themselves;
    empty tables give an empty result (empty ``components``: all missing). Other columns are not read.
    """
    refs = references(deps, docs)
    parents = (
        components.where(F.col("bom_ref").isNotNull() & F.col("sbom_id").isNotNull())
        .groupBy("sbom_id", F.col("bom_ref").alias("ref"))
        .agg(F.max(F.col("deleted_at").isNotNull()).alias("gone"), F.min("loaded_at").alias("at"))
    )
    spark = deps.sparkSession
    rows = components.count()
    bits = max(4, int(np.ceil(np.log2(max(1, rows / parents_per_range)))) + 4)
    ranged = lambda d: d.withColumn("h", F.xxhash64("sbom_id", "ref")).withColumn("range", F.shiftrightunsigned("h", 64 - bits))
    refs, parents = ranged(refs), ranged(parents)
    # every range with more references than a task should hold is split
    counts = cut(refs.groupBy("range").count())
    most = max(ROWS_PER_TASK, -(-(counts.agg(F.sum("count")).first()[0] or 0) // HOT_RANGES))
    salts = F.broadcast(counts.where(F.col("count") > most).select("range", F.ceil(F.col("count") / most).cast("int").alias("n")))  # HOT_RANGES rows at most
    n = F.coalesce(F.col("n"), F.lit(1))
    refs = refs.join(salts, "range", "left").withColumn("salt", F.pmod(F.xxhash64("row_id", "field_name", "target_ref"), n).cast("int"))
    parents = parents.join(salts, "range", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    null = F.lit(None)
    both = refs.select("range", "salt", F.lit(1).alias("kind"), "h", "sbom_id", "ref", "at", F.lit(False).alias("gone"), "row_id", "field_name", "target_ref", "period").unionByName(
        parents.select("range", "salt", F.lit(0).alias("kind"), "h", "sbom_id", "ref", "at", "gone", null.cast("long").alias("row_id"), null.cast("string").alias("field_name"), null.cast("string").alias("target_ref"), null.cast("string").alias("period"))
    )
    return both.repartition("range", "salt").sortWithinPartitions("range", "salt", "kind", "h").mapInArrow(_probe, _PROBE)


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """Orphans counted per table, field, kind and month."""
    return orphans.groupBy(F.lit(table).alias("table_name"), "field_name", "outcome", "period").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("target_ref").alias("n_targets"))
