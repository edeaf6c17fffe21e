"""Column-level data quality profile: nulls, tokens, distinct values, ranges, pattern violations, drift.

The unit of work is a column chunk: one column of one row group of one file.

1. Footers. One small task per file reads the footer and the dictionary pages of the profiled columns, no data page:
   exact null counts and extrema where the statistics are valid, and a chunk's distinct values (``footers``). Each
   distinct value is judged once: is the chunk clean, does it hold one value only, is it of one load only.
2. Chunks of one load that are all null, or nulls and a single value that breaks no pattern, are settled: their counts
   are known, and nothing of them is read again.
3. Only the other chunks are scanned, each by itself: its own column as a dictionary with indices, the load where the
   row group has several, and the row key where the dictionary has values off their pattern. Patterns are matched
   on dictionary values, not on rows; counts leave the task per (load, feature).

Drift compares the share of each feature (nulls, tokens, violations, kinds of value, frequent single values) in
a load with the median over all loads. A value that holds ``share`` of a load holds half of it in one of its chunks at
least, or its chunks with half of it add up to half: each chunk names such values (at most ``2 / share`` a load), and a
second pass over the open chunks counts those that may reach the share exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomstrata.functions import patterns
from bomstrata.functions.text import NULL_TOKENS, WHITESPACE
from bomstrata.session import cut


@dataclass(frozen=True)
class ColumnRule:
    """What a column's values must look like (``pattern``), must not (``refused``), and kinds of value to tell apart."""

    name: str
    pattern: str
    kinds: Callable[[pa.Array], list[pa.Array]]
    refused: str | None = None

    def breaks(self, values: pa.Array) -> pa.Array:
        bad = pc.invert(pc.match_substring_regex(values, self.pattern))
        return pc.or_(bad, pc.match_substring_regex(values, self.refused)) if self.refused else bad


def is_token(values: pa.Array) -> pa.Array:
    """Whether a text only stands for an absent value."""
    return pc.is_in(pc.utf8_lower(pc.utf8_trim(values, WHITESPACE)), value_set=pa.array(NULL_TOKENS))


def _named(name: str, values: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(name), values, "")


def _choice(mask: pa.Array, yes: str, no: str) -> pa.Array:
    return pc.if_else(mask, pa.scalar(yes), pa.scalar(no))


def _version_kinds(v: pa.Array) -> list[pa.Array]:
    return [_named("shape ", pc.replace_substring_regex(pc.replace_substring_regex(v, "[0-9]+", "9"), "[A-Za-z]+", "a"))]


def _purl_kinds(v: pa.Array) -> list[pa.Array]:
    form = pc.binary_join_element_wise(*[_choice(pc.match_substring(v, mark), name, "") for mark, name in (("@", " version"), ("?", " qualifiers"), ("#", " subpath"))], "")
    return [_named("type ", pc.replace_substring_regex(v, r"(?s)[/@?# ].*\z", "")), _named("form", form)]


def _party_kinds(v: pa.Array) -> list[pa.Array]:
    prefix = pc.if_else(pc.match_substring(v, ":"), pc.replace_substring_regex(v, r"(?s):.*\z", ""), pa.scalar(""))
    return [_named("prefix ", prefix), _choice(pc.ends_with(v, ")"), "with address", "without address")]


#: A version is judged as written: white space around it is off the pattern, though a validator that trims lets it pass.
PACKAGE_RULES = (
    ColumnRule("version_info", patterns.VERSION, _version_kinds, patterns.PLACEHOLDER),
    ColumnRule("purl", patterns.PURL, _purl_kinds),
    ColumnRule("supplier", patterns.PARTY, _party_kinds),
)

#: Least change of a share that is a drift, and least share of a single value that is followed.
MIN_SHIFT = 0.02

_FOOTER = "path string, row_group int, column_name string, n_rows long, n_nulls long, low string, high string, load_low long, load_high long, candidates array<string>, n_values long, only string, clean boolean"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in ddl.split(", "))])


def footers(spark: SparkSession, path: str, load: str, columns: list[str], dictionaries: bool = False, rules: tuple[ColumnRule, ...] = ()) -> DataFrame:
    """One row per file, row group and text column, read from footers and, on request, dictionary pages.

    ``n_nulls``, ``low``, ``high``, ``load_low``, ``load_high`` are null where the file has no valid statistics.
    ``candidates`` are the dictionary's values, which are the chunk's distinct values; it is null where pages
    without a dictionary occur. With ``rules``, in their place: ``n_values``, the number of values; ``only``, the value
    if there is one only; ``clean``, whether none is off its pattern. Data pages are skipped, not read. A column that
    a file lacks counts as all null. Empty files give no rows.
    """
    schema = _arrow(_FOOTER)
    of = {r.name: r for r in rules}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        from bomstrata.sources.parquet_pages import dictionary_values

        def judged(name: str, found: list[str] | None) -> tuple:
            if name not in of or found is None:
                return found, None, None, False
            v = pa.array(found, pa.string())
            clean = not pc.any(pc.and_(pc.invert(is_token(v)), of[name].breaks(v))).as_py()
            return None, len(found), found[0] if len(found) == 1 else None, clean

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, p = fs.FileSystem.from_uri(uri)
                rows = []
                with where.open_input_file(p) as f:
                    meta = pq.ParquetFile(f).metadata
                    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                    for g in range(meta.num_row_groups):
                        rg = meta.row_group(g)

                        def stat(name):
                            s = rg.column(at[name]).statistics if name in at else None
                            return s if s is not None and s.has_null_count else None

                        ls = stat(load)
                        lo, hi = (int(ls.min), int(ls.max)) if ls is not None and ls.has_min_max and ls.null_count == 0 else (None, None)
                        for name in columns:
                            s = stat(name)
                            if name not in at:
                                rows.append((uri, g, name, rg.num_rows, rg.num_rows, None, None, lo, hi, *judged(name, [])))
                                continue
                            found = dictionary_values(f, rg.column(at[name])) if dictionaries else None
                            ok = s is not None and s.has_min_max
                            rows.append((uri, g, name, rg.num_rows, s.null_count if s is not None else None, s.min if ok else None, s.max if ok else None, lo, hi, *judged(name, found)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.repartition(F.col("path")).mapInArrow(read, _FOOTER)


_CHUNKS = ("path", "row_group", "column_name", "n_rows", "n_nulls", "load_low", "load_high", "n_values", "only", "clean")
_SEEN = "what int, column_name string, load_no long, feature string, n long, case_key long"
COUNT, FREQUENT, VIOLATION, VALUE = 0, 1, 2, 3


def settled(c: dict) -> bool:
    """Whether footer and dictionary tell all there is to know of a chunk."""
    one_load = c["load_low"] is not None and c["load_low"] == c["load_high"]
    return one_load and c["n_nulls"] is not None and (c["n_nulls"] == c["n_rows"] or (c["n_values"] == 1 and c["clean"]))


def _batches(c: dict, load: str, key: str | None) -> Iterator[tuple[pa.Array, pa.Array, pa.Array | None]]:
    """(loads, values as a dictionary, keys or None) of a chunk; a settled chunk gives two weighted values instead of rows."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    name = c["column_name"]
    where, p = fs.FileSystem.from_uri(c["path"])
    with where.open_input_file(p) as f:
        file = pq.ParquetFile(f, read_dictionary=[name])
        there = set(file.schema_arrow.names)
        one_load = c["load_low"] is not None and c["load_low"] == c["load_high"]
        need = [n for n in dict.fromkeys((name, None if one_load else load, None if c["clean"] else key)) if n in there]
        for b in file.iter_batches(batch_size=1 << 16, row_groups=[c["row_group"]], columns=need):
            n = b.num_rows
            loads = pa.array(np.full(n, c["load_low"]), pa.int64()) if one_load else b.column(load).cast(pa.int64()) if load in there else pa.nulls(n, pa.int64())
            values = b.column(name) if name in there else pa.nulls(n, pa.string())
            if not pa.types.is_dictionary(values.type):
                values = values.cast(pa.string()).dictionary_encode()
            yield loads, values, b.column(key).cast(pa.int64()) if key in need else None


def _hashes(values: pa.Array) -> pa.Array:
    """64-bit hashes of whole values."""
    from pandas.util import hash_array

    return pa.array(hash_array(np.array(values.to_pylist(), object), categorize=False).view(np.int64)) if len(values) else pa.array([], pa.int64())


def _sums(parts: list[pa.Table], by: str) -> pa.Table:
    return pa.concat_tables(parts).group_by(["load", by]).aggregate([("n", "sum")]).rename_columns(["load", by, "n"])


def _weighted(c: dict, load: str, key: str | None) -> Iterator[tuple[pa.Table, pa.Array, pa.Array, pa.Array, pa.Array | None]]:
    """Per batch of a chunk: how often (load, index of value) occurs; the values; and per row loads, indices and keys."""
    if settled(c):
        i = pa.array([0, None], pa.int32()) if c["only"] is not None else pa.array([None], pa.int32())
        n = [c["n_rows"] - c["n_nulls"], c["n_nulls"]] if c["only"] is not None else [c["n_rows"]]
        t = pa.table({"load": pa.array([c["load_low"]] * len(i), pa.int64()), "i": i, "n": pa.array(n, pa.int64())})
        yield t.filter(pc.greater(t["n"], 0)), pa.array([c["only"]] if c["only"] is not None else [], pa.string()), None, None, None
        return
    for loads, values, keys in _batches(c, load, key):
        i = values.indices.cast(pa.int32())
        t = pa.table({"load": loads, "i": i}).group_by(["load", "i"]).aggregate([([], "count_all")])
        yield t.rename_columns(["load", "i", "n"]), values.dictionary.cast(pa.string()), loads, i, keys


def _features(rule: ColumnRule, v: pa.Array) -> tuple[list[pa.Array], pa.Array]:
    """Texts that name what each value is, null where nothing applies; and which values break their pattern."""
    token = is_token(v)
    bad = pc.and_(pc.invert(token), rule.breaks(v))
    none = pa.scalar(None, pa.string())
    kinds = [pc.if_else(token, none, k) for k in rule.kinds(v)]
    return [pc.if_else(token, pa.scalar("token"), pc.if_else(bad, pa.scalar("violation"), none)), *kinds], bad


def _scan(rules, load: str, key: str | None, share: float | None, values: bool):
    """Map over chunks: counts of features; values that may be frequent; keys of violations; distinct values."""
    of, schema = {r.name: r for r in rules}, _arrow(_SEEN)

    def rows(what: int, name: str, load_no, feature, n, case) -> pa.RecordBatch:
        size = len(next(x for x in (load_no, feature, n, case) if x is not None))
        fill = lambda x, t: pa.nulls(size, t) if x is None else (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, what, np.int32)), pa.array([name] * size, pa.string()), fill(load_no, pa.int64()), fill(feature, pa.string()), fill(n, pa.int64()), fill(case, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                rule, counts, hashed, distinct = of[c["column_name"]], [], [], []
                for t, v, loads, i, keys in _weighted(c, load, key):
                    feats, bad = _features(rule, v)
                    null = pc.if_else(pc.is_null(t["i"]), pa.scalar("null"), pa.scalar(None, pa.string()))
                    for f in ([pa.scalar("rows")] * t.num_rows, null, *[f.take(t["i"]) for f in feats]):
                        f = pa.array(["rows"] * t.num_rows, pa.string()) if isinstance(f, list) else f
                        part = pa.table({"load": t["load"], "feature": f, "n": t["n"]})
                        counts.append(part.filter(pc.is_valid(part["feature"])))
                    if share is not None:
                        part = pa.table({"load": t["load"], "hash": _hashes(v).take(t["i"]), "n": t["n"]})
                        hashed.append(part.filter(pc.is_valid(part["hash"])))
                    if values:
                        part = pa.table({"load": t["load"], "value": pc.if_else(is_token(v), pa.scalar(None, pa.string()), v).take(t["i"]), "n": t["n"]})
                        distinct.append(part.filter(pc.is_valid(part["value"])))
                    if keys is not None:
                        hit = pc.fill_null(bad.take(i), False)
                        if pc.any(hit).as_py():
                            yield rows(VIOLATION, rule.name, loads.filter(hit), None, None, keys.filter(hit))
                if not counts:
                    continue
                total = _sums(counts, "feature")
                yield rows(COUNT, rule.name, total["load"], total["feature"], total["n"], None)
                if share is not None:
                    of_load = {r["load"]: r["n"] for r in total.filter(pc.equal(total["feature"], "rows")).to_pylist()}
                    t = _sums(hashed, "hash")
                    least = pa.array([of_load[x] * share / 2 for x in t["load"].to_pylist()], pa.float64())
                    t = t.filter(pc.greater_equal(t["n"].cast(pa.float64()), least))
                    if t.num_rows:
                        yield rows(FREQUENT, rule.name, t["load"], t["hash"].cast(pa.string()), t["n"], None)
                if values:
                    t = _sums(distinct, "value")
                    if t.num_rows:
                        yield rows(VALUE, rule.name, t["load"], t["value"], t["n"], None)

    return run


def _count_values(wanted, rules, load: str):
    """Map over chunks: exact counts of the values whose hashes are wanted (a broadcast: column -> sorted hashes)."""
    schema = _arrow("column_name string, load_no long, feature string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.to_pylist():
                mine, parts = pa.array(wanted.value.get(c["column_name"], []), pa.int64()), []
                if not len(mine) or (c["n_nulls"] is not None and c["n_nulls"] == c["n_rows"]):
                    continue
                for t, v, *_ in _weighted(c, load, None):
                    h = _hashes(v)
                    part = pa.table({"load": t["load"], "hash": pc.if_else(pc.is_in(h, value_set=mine), h, pa.scalar(None, pa.int64())).take(t["i"]), "n": t["n"]})
                    parts.append(part.filter(pc.is_valid(part["hash"])))
                t = _sums(parts, "hash") if parts else None
                if t is not None and t.num_rows:
                    names = _named("value ", t["hash"].combine_chunks().cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([c["column_name"]] * t.num_rows), t["load"].combine_chunks(), names, t["n"].combine_chunks()], schema=schema)

    return run


def _chunks(spark: SparkSession, path: str, rules, load: str) -> DataFrame:
    """The column chunks with what footers and dictionaries say, spread over the cluster."""
    foot = cut(footers(spark, path, load, [r.name for r in rules], dictionaries=True, rules=tuple(rules)).select(*_CHUNKS))
    return foot.repartition(max(1, foot.count()))


def frequent_values(seen: DataFrame, chunks: DataFrame, load: str, rules, share: float) -> DataFrame:
    """Exact counts, in every load, of the values that may hold ``share`` of some load.

    What the chunks name adds up to half of ``share`` for such a value, so at most ``2 / share`` values a load and
    column are collected, 8 bytes each: the bound is a matter of the number of loads, not of rows.
    """
    spark = chunks.sparkSession
    by = ["column_name", F.coalesce(F.col("load_no").cast("string"), F.lit("")).alias("at")]
    total = seen.where((F.col("what") == COUNT) & (F.col("feature") == "rows")).groupBy(*by).agg(F.sum("n").alias("total"))
    cand = seen.where(F.col("what") == FREQUENT).groupBy(*by, "feature").agg(F.sum("n").alias("n")).join(total, ["column_name", "at"]).where(F.col("n") >= share / 2 * F.col("total"))
    wanted: dict[str, list[int]] = {}
    for r in cand.select("column_name", "feature").distinct().collect():
        wanted.setdefault(r["column_name"], []).append(int(r["feature"]))
    found = chunks.mapInArrow(_count_values(spark.sparkContext.broadcast({k: sorted(v) for k, v in wanted.items()}), rules, load), "column_name string, load_no long, feature string, n long")
    return found.groupBy("load_no", "column_name", "feature").agg(F.sum("n").alias("n"))


def drifts(counts: DataFrame, min_shift: float = MIN_SHIFT, z: float = 3.0, wobble: float = 0.2, chances: float = 5.0) -> DataFrame:
    """(column_name, load_no, feature, share, usual, score) that depart plainly from the bulk of the loads.

    Every feature is judged in every load, also where it does not occur. With ``rate`` the smaller one of the median
    share over all loads and its complement, so that falls and rises, and shares of p and 1 - p, count alike, a share
    departs if it differs from the median by ``z`` times the spread expected from a relative wobble of ``rate``, from
    chance at this load's size, and from the median deviation of the loads; and by ``chances`` times chance alone,
    as many features are tried, and ``min_shift``, as a few rows that are delivered again make no drift. A list per
    feature holds one number per load, nothing that grows with the rows.
    """
    c = counts.withColumn("at", F.coalesce(F.col("load_no").cast("string"), F.lit("")))  # a null load is a load too
    rows = c.where(F.col("feature") == "rows").select("column_name", "at", "load_no", F.col("n").alias("total"))
    seen = c.where(F.col("feature") != "rows").select("column_name", "at", "feature", "n")
    # a feature that is nowhere as large as the least shift shifts nowhere
    kept = seen.join(rows, ["column_name", "at"]).groupBy("column_name", "feature").agg(F.max(F.col("n") / F.col("total")).alias("most")).where(F.col("most") >= min_shift).select("column_name", "feature")
    d = rows.join(kept, "column_name").join(seen, ["column_name", "at", "feature"], "left").withColumn("share", F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)))
    d = d.groupBy("column_name", "feature").agg(F.collect_list(F.struct("share", "load_no", "total")).alias("s"))
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)) / 2
    d = d.withColumn("usual", middle(F.array_sort(F.transform("s", lambda x: x["share"]))))
    d = d.withColumn("spread", 1.4826 * middle(F.array_sort(F.transform("s", lambda x: F.abs(x["share"] - F.col("usual"))))))
    d = d.select("column_name", "feature", "usual", "spread", F.explode("s").alias("x")).select("column_name", "feature", "usual", "spread", "x.*")
    shift, rate = F.abs(F.col("share") - F.col("usual")), F.least(F.col("usual"), 1 - F.col("usual"))
    chance = F.greatest(F.col("usual"), 1 / F.col("total")) * F.greatest(1 - F.col("usual"), 1 / F.col("total")) / F.col("total")
    d = d.withColumn("score", shift / F.sqrt(F.pow(wobble * rate, 2) + chance + F.pow("spread", 2)))
    return d.where((shift >= min_shift) & (shift >= chances * F.sqrt(chance)) & (F.col("score") >= z)).select("column_name", "load_no", "feature", "share", "usual", "score")


def find_cases(spark: SparkSession, path: str, key: str, load: str, rules=PACKAGE_RULES) -> DataFrame:
    """``case_kind, column_name, case_key``: violating rows and drifting loads of the columns of ``rules``.

    ``path`` holds parquet files with ``key``, ``load`` and the rules' columns; others are not read. Null and
    empty values are counted as nulls and tokens and never violate. Rows with a null load form a load of their
    own that is no case. Repeated rows count each. Values are judged whole, however long. Empty tables, and tables with
    a single load, give no drift.
    """
    chunks = _chunks(spark, path, rules, load)
    seen = cut(chunks.mapInArrow(_scan(rules, load, key, MIN_SHIFT, False), _SEEN))
    counts = seen.where(F.col("what") == COUNT).groupBy("load_no", "column_name", "feature").agg(F.sum("n").alias("n"))
    counts = cut(counts.unionByName(frequent_values(seen, chunks, load, rules, MIN_SHIFT)))  # a few rows per load
    drift = drifts(counts).where(F.col("load_no").isNotNull()).select(F.lit("drift").alias("case_kind"), "column_name", F.col("load_no").alias("case_key")).distinct()
    return seen.where(F.col("what") == VIOLATION).select(F.lit("violation").alias("case_kind"), "column_name", "case_key").unionByName(drift)


def profile(spark: SparkSession, path: str, load: str, rules=PACKAGE_RULES) -> DataFrame:
    """Per column and load: rows, nulls, tokens, violations, distinct values, extrema, all exact.

    Cases as in ``find_cases``; extrema and distinct values leave out nulls and null tokens. Settled chunks are not
    read; of the others each task puts out its distinct values once per load.
    """
    seen = _chunks(spark, path, rules, load).mapInArrow(_scan(rules, load, None, None, True), _SEEN)
    d = seen.groupBy("column_name", "load_no", "what", "feature").agg(F.sum("n").alias("n"))
    of = lambda name: F.coalesce(F.sum(F.when((F.col("what") == COUNT) & (F.col("feature") == name), F.col("n"))), F.lit(0))
    text = F.when(F.col("what") == VALUE, F.col("feature"))
    return d.groupBy("column_name", "load_no").agg(
        of("rows").alias("n_rows"), of("null").alias("n_nulls"), of("token").alias("n_tokens"), of("violation").alias("n_violations"),
        F.count(text).alias("n_distinct"), F.min(text).alias("low"), F.max(text).alias("high"),
    )


_CHUNK = "column_name string, n_rows long, n_nulls long, low string, high string, candidates array<string>"


def scan_chunks(chunks: DataFrame) -> DataFrame:
    """Rows, nulls, extrema and distinct values of single column chunks (``chunks``: path, row_group, column_name).

    Nothing but the pages of those chunks is read. A row per batch of a chunk, so that no list grows with the chunk.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            for uri, g, name in zip(*(batch.column(c).to_pylist() for c in ("path", "row_group", "column_name"))):
                where, p = fs.FileSystem.from_uri(uri)
                with where.open_input_file(p) as f:
                    for part in pq.ParquetFile(f).iter_batches(batch_size=1 << 16, row_groups=[g], columns=[name]):
                        v = part.column(0).cast(pa.string())
                        ends = pc.min_max(v).as_py()
                        row = {"column_name": name, "n_rows": len(v), "n_nulls": v.null_count, "low": ends["min"], "high": ends["max"], "candidates": pc.unique(v.drop_null()).to_pylist()}
                        yield pa.RecordBatch.from_pylist([row], schema=_arrow(_CHUNK))

    n = min(chunks.count(), 8 * chunks.sparkSession.sparkContext.defaultParallelism)
    return chunks.select("path", "row_group", "column_name").repartition(max(1, n), "path", "row_group", "column_name").mapInArrow(read, _CHUNK)


def footer_profile(spark: SparkSession, path: str, load: str, columns: list[str]) -> DataFrame:
    """Per text column of the whole table: rows, nulls, extrema and distinct values, scanning only what footers leave open.

    Nulls and extrema come from footers, distinct values from dictionary pages. Chunks whose statistics or dictionary
    do not suffice, and only those, are scanned; ``n_unsettled`` counts chunks that are still open then.
    """
    f = cut(footers(spark, path, load, columns, dictionaries=True))
    stats = F.col("n_nulls").isNotNull() & (F.col("low").isNotNull() | (F.col("n_nulls") == F.col("n_rows")))
    fit = stats & F.col("candidates").isNotNull()
    fields = ("column_name", "n_rows", "n_nulls", "low", "high", "candidates")
    f = cut(f.where(fit).select(*fields).unionByName(scan_chunks(f.where(~fit)))) if not f.where(~fit).isEmpty() else f.select(*fields)
    out = f.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.min("low").alias("low"), F.max("high").alias("high"), F.count_if(~fit).alias("n_unsettled"))
    values = f.select("column_name", F.explode("candidates").alias("v")).distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    return out.join(values, "column_name", "left").select("column_name", "n_rows", "n_nulls", "low", "high", F.coalesce("n", F.lit(0)).alias("n_distinct"), "n_unsettled")
