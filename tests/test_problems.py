"""The data-processing operators against brute force and on edge cases."""

import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bomstrata.operators import hierarchy, nested, orphans, profile, timestamps

# --- timestamps


def _times(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k long, t string, z string").withColumn("outcome", F.lit("clash"))
    return {r["k"]: (r["outcome"], r["utc_text"]) for r in timestamps.normalise_timestamps(df, "t", "z", "k").collect()}


def test_timestamp_forms(spark):
    rows = [
        ("2024-03-19T18:04:42.9779015Z", None), ("2024-01-05T16:25:09+05:30[Asia/Kolkata]", "UTC"), ("01.09.2025 05:21:27", "Europe/Helsinki"), ("03/18/2024 07:35:31 PM", "America/New_York"),
        ("Sat Jun 28 07:06:42 PDT 2025", "Asia/Tokyo"), ("Thu, 04 Jan 2024 05:51:44 +0000", None), ("1724994218.439", None), ("1744705204629", None), ("1728722513485814", None), ("20250805T135131+0000", None),
        ("2024-05-20T20:52:38.778−07:00", None), ("2025-07-02 10:09:25 America/Los_Angeles", "Asia/Kolkata"), ("2200-07-01 12:00:00", "Europe/Berlin"), ("1900-01-01T00:00:00Z", None),
    ]
    got = _times(spark, rows)
    assert [got[i][1] for i in range(len(rows))] == [
        "2024-03-19T18:04:42.977901Z", "2024-01-05T10:55:09.000000Z", "2025-09-01T02:21:27.000000Z", "2024-03-18T23:35:31.000000Z", "2025-06-28T14:06:42.000000Z", "2024-01-04T05:51:44.000000Z",
        "2024-08-30T05:03:38.439000Z", "2025-04-15T08:20:04.629000Z", "2024-10-12T08:41:53.485814Z", "2025-08-05T13:51:31.000000Z", "2024-05-21T03:52:38.778000Z", "2025-07-02T17:09:25.000000Z", "2200-07-01T10:00:00.000000Z",
        "1900-01-01T00:00:00.000000Z",
    ]


def test_timestamp_reasons(spark):
    rows = [
        ("2024-10-27T02:30:00", "Europe/Berlin"), ("2024-03-31T02:30:00", "Europe/Berlin"), ("2024-05-01 10:00:00", None), ("2024-05-01", "UTC"), ("2024-02-30T10:15:00Z", None), ("2024-07-12T25:10:00Z", None), ("yesterday", "UTC"),
        ("13/25/2024 10:00:00 AM", "UTC"), ("2024-05-01 10:00:00", "Mars/Base"), ("x" * 100_000, "UTC"), (None, "UTC"), ("  ", "UTC"), ("N/A", "UTC"), ("2024-05-01T10:00:00+25:00", "UTC"),
    ]
    got = _times(spark, rows)
    assert [got.get(i, ("none", ""))[0] for i in range(len(rows))] == ["fold", "gap", "nozone", "bad", "bad", "bad", "bad", "bad", "nozone", "bad", "none", "none", "none", "bad"]
    assert all(t == "" for o, t in got.values() if o != "utc")
    assert _times(spark, []) == {}


def test_zone_intervals_agree_with_zoneinfo():
    from zoneinfo import ZoneInfo

    table = {(z, y): s for z, y, s in timestamps.zone_intervals()}
    for zone in ("Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kathmandu"):
        for when in (datetime(1987, 6, 1, 12), datetime(2024, 1, 15, 3), datetime(2031, 7, 1), datetime(2060, 12, 31, 23)):
            local = int((when - datetime(1970, 1, 1)).total_seconds())
            hits = [o for a, b, o in table[(zone.lower(), when.year)] if a <= local < b]
            assert hits == [int(when.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds())]


# --- orphans

_DEPS = "dep_row_id long, sbom_id long, dep_ref string, depends_on array<string>, loaded_at timestamp_ntz"
_COMPS = "sbom_id long, bom_ref string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
_DOCS = "sbom_id long, serial_number string, bom_version int"
D1, D2 = datetime(2024, 1, 5), datetime(2024, 2, 5)


def test_orphans(spark):
    deps = spark.createDataFrame([
        (1, 1, "a", ["b", "b", "gone", "late", "", None], D1), (2, 1, None, None, D1), (3, 1, "nowhere", [], D2), (4, 2, "a", ["urn:cdx:s-1/1#b%2Bc", "urn:cdx:s-1/9#b", "urn:cdx:s-1/1#%zz"], D1), (4, 2, "a", ["x"], D1),
    ], _DEPS)
    comps = spark.createDataFrame([(1, "a", D1, None), (1, "b", D1, None), (1, "gone", D1, None), (1, "gone", D2, D2), (1, "late", D2, None), (1, "b+c", D1, None), (None, "x", D1, None), (1, None, D1, None), (2, "a", D1, None)], _COMPS)
    docs = spark.createDataFrame([(1, "urn:uuid:s-1", 1), (1, "urn:uuid:s-1", 1), (2, None, None)], _DOCS)
    got = sorted(map(tuple, orphans.find_orphans(deps, comps, docs).collect()))
    assert got == [
        (1, "dependsOn", "", "missing", "2024-01"), (1, "dependsOn", "gone", "deleted", "2024-01"), (1, "dependsOn", "late", "late", "2024-01"), (3, "ref", "nowhere", "missing", "2024-02"),
        (4, "dependsOn", "urn:cdx:s-1/1#%zz", "missing", "2024-01"), (4, "dependsOn", "urn:cdx:s-1/9#b", "missing", "2024-01"), (4, "dependsOn", "x", "missing", "2024-01"),
    ]
    report = {tuple(r)[1:] for r in orphans.orphan_report(orphans.find_orphans(deps, comps, docs), "t").collect()}
    assert ("dependsOn", "missing", "2024-01", 4, 4) in report
    assert orphans.find_orphans(deps.limit(0), comps, docs).count() == 0
    assert {r["outcome"] for r in orphans.find_orphans(deps, comps.limit(0), docs).collect()} == {"missing"}


def test_orphans_of_a_hot_key(spark):
    n = 120_000  # enough references of one key for its range to be split
    deps = spark.range(n).select(F.col("id").alias("dep_row_id"), F.lit(1).cast("long").alias("sbom_id"), F.lit("hot").alias("dep_ref"), F.array(F.lit("none")).alias("depends_on"), F.lit(D1).cast("timestamp_ntz").alias("loaded_at"))
    comps = spark.createDataFrame([(1, "hot", D1, None)], _COMPS)
    got = orphans.find_orphans(deps, comps, spark.createDataFrame([], _DOCS)).groupBy("field_name", "outcome").count().collect()
    assert [tuple(r) for r in got] == [("dependsOn", "missing", n)]


# --- hierarchies


def _brute(nodes, edges):
    """Kind, root, depth, descendants, path by plain search."""
    out = {}
    below = {}
    for n in nodes:
        seen, stack = set(), [n]
        while stack:
            for a, b in edges:
                if a == stack[-1] and b not in seen:
                    seen.add(b)
                    stack.append(b)
                    break
            else:
                stack.pop()
        below[n] = seen
    roots = [n for n in nodes if all(b != n for _, b in edges)]
    level, best = {r: r for r in roots}, {r: (r, r, 0) for r in roots}
    d = 0
    while level:
        d += 1
        new = {}
        for a, p in level.items():
            for x, b in edges:
                if x == a and b not in best:
                    new[b] = min(new.get(b, (f"{p} > {b}", best[a][1])), (f"{p} > {b}", best[a][1]))
        best |= {b: (p, r, d) for b, (p, r) in new.items()}
        level = {b: p for b, (p, _) in new.items()}
    for n in nodes:
        kind = "cycle" if n in below[n] else "placed" if n in best else "rootless"
        p, r, d = best[n] if kind == "placed" else ("", "", -1)
        out[n] = (kind, r, d, len(below[n] - {n}), p)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), max_size=14))
def test_walk_against_search(edges):
    import numpy as np

    edges = sorted(set(edges))
    nodes = sorted({x for e in edges for x in e})
    if not nodes:
        return
    code = {n: i for i, n in enumerate(nodes)}
    e = np.array([(code[a], code[b]) for a, b in edges], np.int64).reshape(-1, 2)
    kind, top, depth, count, path, _ = hierarchy.walk(np.zeros(len(nodes), np.int64), np.array(nodes, object), e[:, 0], e[:, 1])
    got = {n: (kind[i], top[i], int(depth[i]), int(count[i]), path[i]) for n, i in code.items()}
    assert got == _brute(nodes, edges)


def test_hierarchy_ways_agree(spark):
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s"), ("c", "c2"), ("c2", "c3")]
    refs = sorted({v for e in edges for v in e}) + ["lonely"]
    deps = spark.createDataFrame([(1, a, [b, b]) for a, b in edges] + [(1, "lonely", None), (1, None, ["a", None, "unknown"]), (2, "r", []), (None, "r", ["a"])], "sbom_id long, dep_ref string, depends_on array<string>")
    comps = spark.createDataFrame([(d, r) for d in (1, 2) for r in refs] + [(1, None), (1, "r")], "sbom_id long, bom_ref string")
    near = {tuple(r) for r in hierarchy.hierarchies(deps, comps).collect()}
    far = {tuple(r) for r in hierarchy.hierarchies(deps, comps, local_rows=3).collect()}
    assert near == far
    want = _brute(refs, edges)
    assert {r[1]: (r[2], r[3], r[4], r[5], r[6]) for r in near if r[0] == 1} == want
    assert (2, "r", "placed", "r", 0, 0, "r") in near
    assert hierarchy.hierarchies(deps.limit(0), comps).count() == 0
    below = {tuple(r) for r in hierarchy.descendants(deps, comps).collect()}
    assert below == {tuple(r) for r in hierarchy.descendants(deps, comps, local_rows=3).collect()}
    assert {r[1]: r[5] for r in near if r[0] == 1} == {v: sum(p[:2] == (1, v) for p in below) for v in {r[1] for r in near if r[0] == 1}}


def test_documents_are_walked_together_up_to_a_number_of_pairs(monkeypatch):
    rows = [(d, None, f"n{i}", f"n{i + 1}") for d in range(6) for i in range(30)] + [(d, f"n{i}", None, None) for d in range(6) for i in range(31)]
    t = pa.Table.from_pylist([dict(zip(("sbom_id", "known", "src", "dst"), r)) for r in sorted(rows, key=lambda r: r[0])])
    whole = pa.Table.from_batches(hierarchy._solve(t, False)).to_pylist()
    monkeypatch.setattr(hierarchy, "_PAIRS", 2000)
    parts = list(hierarchy._solve(t, False))
    assert [p.num_rows for p in parts] == [62, 62, 62] and pa.Table.from_batches(parts).to_pylist() == whole
    assert sum(p.num_rows for p in hierarchy._solve(t, True)) == 6 * 31 * 30 // 2


# --- nested records


def _flat(payloads):
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(payloads))), "p": payloads})
    return [tuple(r.values()) for b in nested._mapper(nested._items, nested._ITEMS)([batch]) for r in b.to_pylist()]


def test_nested_items():
    doc = {
        "metadata": {"component": {"name": "m", "licenses": [{"license": {"id": ["x"], "name": "N"}}, {"expression": "  "}, {"expression": "E"}]}},
        "components": [{"hashes": {"alg": "A", "content": "1"}, "components": [{"externalReferences": [7, {"type": "t", "url": "ué\n"}]}]}, "text", {"hashes": [{"alg": "A", "content": ""}, {"alg": "B", "content": "2"}]}],
        "packages": [{"checksums": [{"algorithm": "C", "checksumValue": "3"}], "externalRefs": None}], "files": {"checksums": [{"algorithm": "D", "checksumValue": "4"}]},
    }
    got = _flat([json.dumps(doc), json.dumps(doc, indent=1, ensure_ascii=False), "[]", "null", "", "{", '{"a": 1,}', '{"components": [{"hashes": [{"alg": "A", "content": "1"}]}]', '{"x": tru}', '"{}"', '{"a" 1}', '{"a": "\x01"}', '{"a": "\\q"}'])
    want = {
        ("metadata.component", "license", 0, "name", "N"), ("metadata.component", "license", 2, "expression", "E"), ("components[0]", "hash", 0, "A", "1"), ("components[0].components[0]", "external_ref", 1, "t", "ué\n"),
        ("components[2]", "hash", 1, "B", "2"), ("packages[0]", "hash", 0, "C", "3"), ("files[0]", "hash", 0, "D", "4"),
    }
    assert {r[1:] for r in got if r[0] == 0} == want == {r[1:] for r in got if r[0] == 1}
    assert {r[0] for r in got} == {0, 1}


_JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["hashes", "alg", "content", "components", 'q"\\', "é"]), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(_JSON, st.integers(0, 60), st.booleans()), min_size=1, max_size=5))
def test_structural_index_tells_json(cases):
    texts = []
    for value, cut, broken in cases:
        t = json.dumps(value, ensure_ascii=cut % 2 == 0, indent=cut % 3 or None)
        texts.append(t[:cut] if broken else t)

    def valid(t):
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    assert nested.Index([t.encode("utf-8", "replace") for t in texts]).valid.tolist() == [valid(t.encode("utf-8", "replace").decode()) for t in texts]


def test_nested_tables_link(spark):
    df = spark.createDataFrame([(1, json.dumps({"components": [{"name": "a", "components": [{"name": "b", "hashes": [{"alg": "x", "content": "y"}]}]}]}), "z"), (2, None, "z")], "raw_id long, payload string, item_kind string")
    owners = {tuple(r)[1:5] for r in nested.flatten_owners(df).collect()}
    assert owners == {("components[0]", "", 0, "component"), ("components[0].components[0]", "components[0]", 0, "component")}
    assert [tuple(r)[1:] for r in nested.flatten_items(df).collect()] == [("components[0].components[0]", "hash", 0, "x", "y")]
    assert nested.flatten_items(df.limit(0)).count() == 0


# --- profiles of columns


@pytest.fixture(scope="module")
def loads(tmp_path_factory):
    path = tmp_path_factory.mktemp("p") / "t.parquet"
    n, rows = 0, []
    for load in range(1, 9):
        for i in range(400):
            n += 1
            v = None if i % 20 == 0 else "1.2.3" if i % 7 else f"{load}.{i}.0"
            if load == 5 and i % 2:
                v = None
            if load == 7 and i % 3 == 0:
                v = "9.9.9"
            rows.append((n, load, v, f"pkg:npm/a{i}@1" if i % 50 else "pkg:", "Organization: X" if i % 40 else "n/a"))
    cols = list(zip(*rows))
    pq.write_table(pa.table({"id": cols[0], "load_no": pa.array(cols[1], pa.int32()), "version_info": pa.array(cols[2], pa.string()), "purl": cols[3], "supplier": cols[4]}), path, row_group_size=400)
    return str(path)


def test_profile_cases(spark, loads):
    got = [tuple(r) for r in profile.find_cases(spark, loads, "id", "load_no").collect()]
    assert {r for r in got if r[0] == "drift"} == {("drift", "version_info", 5), ("drift", "version_info", 7)}
    assert {r[2] for r in got if r[0] == "violation"} == {i + 1 for i in range(3200) if i % 400 % 50 == 0}


def test_footers_settle_without_a_scan(spark, loads):
    f = {(r["row_group"], r["column_name"]): r for r in profile.footers(spark, loads, "load_no", ["version_info", "purl", "missing"], dictionaries=True).collect()}
    assert len(f) == 24
    assert f[(4, "version_info")]["n_nulls"] > 150 and f[(4, "version_info")]["load_low"] == f[(4, "version_info")]["load_high"] == 5
    assert sorted(f[(0, "purl")]["candidates"]) == sorted({f"pkg:npm/a{i}@1" for i in range(400) if i % 50} | {"pkg:"})
    assert f[(0, "missing")]["n_nulls"] == 400
    whole = {r["column_name"]: r for r in profile.footer_profile(spark, loads, "load_no", ["purl"]).collect()}["purl"]
    assert (whole["n_rows"], whole["n_nulls"], whole["n_distinct"], whole["n_unsettled"]) == (3200, 0, 393, 0)


def test_settled_chunks_are_not_scanned(spark, tmp_path, monkeypatch):
    for i, v in enumerate(["1.0.1", None, "1.0.2"]):
        pq.write_table(pa.table({"id": [i * 10, i * 10 + 1], "load_no": pa.array([1, 1], pa.int32()), "version_info": pa.array([v, v], pa.string()), "purl": pa.array(["pkg:a/b"] * 2), "supplier": pa.array([None, None], pa.string())}), tmp_path / f"{i}.parquet")
    chunks = [r.asDict() for r in profile._chunks(spark, str(tmp_path), profile.PACKAGE_RULES, "load_no").collect()]
    assert len(chunks) == 9 and all(profile.settled(c) for c in chunks)
    for f in tmp_path.iterdir():
        f.unlink()  # nothing is read again
    batch = pa.RecordBatch.from_pylist(chunks)
    counts = {}
    for b in profile._scan(profile.PACKAGE_RULES, "load_no", "id", 0.02, False)(iter([batch])):
        for r in b.to_pylist():
            if r["what"] == profile.COUNT:
                counts[(r["column_name"], r["feature"])] = counts.get((r["column_name"], r["feature"]), 0) + r["n"]
    assert counts[("version_info", "rows")] == 6 and counts[("version_info", "null")] == 2 and counts[("supplier", "null")] == 6


def test_only_open_chunks_of_a_row_group_are_scanned(spark, tmp_path):
    # one row group: purl is settled by its dictionary, version_info is open, supplier breaks its pattern
    n = 100
    t = pa.table({"id": list(range(n)), "load_no": pa.array([3] * n, pa.int32()), "version_info": [f"1.{i}.0" for i in range(n)], "purl": ["pkg:npm/a@1"] * n, "supplier": ["nobody"] * n})
    pq.write_table(t, tmp_path / "t.parquet")
    by = {r["column_name"]: r.asDict() for r in profile._chunks(spark, str(tmp_path), profile.PACKAGE_RULES, "load_no").collect()}
    assert {k: profile.settled(c) for k, c in by.items()} == {"purl": True, "version_info": False, "supplier": False}
    assert (by["version_info"]["clean"], by["supplier"]["clean"]) == (True, False)
    got = profile.find_cases(spark, str(tmp_path), "id", "load_no").collect()
    assert {tuple(r) for r in got} == {("violation", "supplier", i) for i in range(n)}


def test_values_are_told_apart_beyond_any_prefix(spark, tmp_path):
    # two values that share their first 300 characters; one of them drifts in load 6
    a, b = "Organization: " + "x" * 300 + "a", "Organization: " + "x" * 300 + "b"
    rows = [(load * 1000 + i, load, "1.0.0", "pkg:npm/a@1", a if (i % 2 if load != 6 else i % 10) else b) for load in range(1, 10) for i in range(400)]
    c = list(zip(*rows))
    pq.write_table(pa.table({"id": c[0], "load_no": pa.array(c[1], pa.int32()), "version_info": c[2], "purl": c[3], "supplier": c[4]}), tmp_path / "t.parquet")
    assert [tuple(r) for r in profile.find_cases(spark, str(tmp_path), "id", "load_no").collect()] == [("drift", "supplier", 6)]


def test_drift_sees_falls_and_large_shares(spark):
    # null: 8 % falls to none; token: 40 % falls to none; kind: 70 % rises to all; other: 30 % rises to 55 %; calm: wobbles by a fifth
    usual = {"null": 0.08, "token": 0.4, "kind": 0.7, "other": 0.3, "calm": 0.3}
    odd = {(3, "null"): 0.0, (4, "token"): 0.0, (5, "kind"): 1.0, (6, "other"): 0.55}
    rows = []
    for load in range(1, 11):
        rows.append(("c", load, "rows", 5000))
        for f, u in usual.items():
            share = odd.get((load, f), u * (1 + 0.2 * (-1) ** load) if f == "calm" else u * (1 + 0.02 * (load % 3 - 1)))
            if share:
                rows.append(("c", load, f, round(share * 5000)))
    got = {(r["load_no"], r["feature"]) for r in profile.drifts(spark.createDataFrame(rows, "column_name string, load_no long, feature string, n long")).collect()}
    assert got == set(odd)


def test_chunks_that_footers_leave_open_are_scanned(spark, tmp_path):
    # purl outgrows its dictionary page in the first file; the second has neither dictionary nor statistics
    a = [f"pkg:npm/name-{i:06d}@1.{i}" if i % 9 else None for i in range(5000)]
    b = [f"pkg:npm/name-{i:06d}@1.{i}" if i % 7 else None for i in range(4000, 7000)]
    make = lambda purl: pa.table({"load_no": pa.array([1] * len(purl), pa.int32()), "version_info": ["1.0"] * len(purl), "purl": purl})
    pq.write_table(make(a), tmp_path / "a.parquet", dictionary_pagesize_limit=2000, data_page_size=2000, row_group_size=2500, write_batch_size=100)
    pq.write_table(make(b), tmp_path / "b.parquet", use_dictionary=False, write_statistics=False)
    assert profile.footers(spark, str(tmp_path), "load_no", ["purl"], dictionaries=True).where("candidates is null").count() == 3
    got = {r["column_name"]: tuple(r)[1:] for r in profile.footer_profile(spark, str(tmp_path), "load_no", ["version_info", "purl"]).collect()}
    known = set(a + b) - {None}
    assert got["purl"] == (8000, (a + b).count(None), min(known), max(known), len(known), 0)
    assert got["version_info"] == (8000, 0, "1.0", "1.0", 1, 0)


def test_profile_counts_distinct_values_exactly(spark, tmp_path):
    rows = [(load, f"{i * (load or 3) % 7919}.{i % 3}.0" if i % 11 else None, f"pkg:npm/a{i * (load or 3) % 6007}@1" if i % 13 else "n/a", "Organization: X") for load in (1, 2, None) for i in range(9000)]
    cols = list(zip(*rows))
    pq.write_table(pa.table({"load_no": pa.array(cols[0], pa.int32()), "version_info": cols[1], "purl": cols[2], "supplier": cols[3]}), tmp_path / "t.parquet")
    got = {(r["column_name"], r["load_no"]): r for r in profile.profile(spark, str(tmp_path), "load_no").collect()}
    assert len(got) == 9
    for at, name in ((1, "version_info"), (2, "purl"), (3, "supplier")):
        for load in (1, 2, None):
            values = [r[at] for r in rows if r[0] == load]
            known = set(values) - {None, "n/a"}
            r = got[(name, load)]
            assert (r["n_rows"], r["n_nulls"], r["n_tokens"], r["n_violations"], r["n_distinct"], r["low"], r["high"]) == (9000, values.count(None), values.count("n/a"), 0, len(known), min(known), max(known))


def test_a_settled_chunk_of_one_value_drifts_like_scanned_rows(spark, tmp_path):
    # load 8 has only 'Organization: X' and is settled by its footer; elsewhere each supplier is another
    def table(load, supplier):
        n = len(supplier)
        return pa.table({"id": pa.array(range(load * 1000, load * 1000 + n), pa.int64()), "load_no": pa.array([load] * n, pa.int32()), "version_info": ["1.0.0"] * n, "purl": ["pkg:npm/a@1"] * n, "supplier": supplier})

    loads = [table(i, [f"Organization: X{j}" for j in range(500)]) for i in range(1, 8)] + [table(8, ["Organization: X"] * 500)]
    for i, t in enumerate(loads):
        pq.write_table(t, tmp_path / f"{i}.parquet")
    chunks = [r.asDict() for r in profile._chunks(spark, str(tmp_path), profile.PACKAGE_RULES, "load_no").collect()]
    assert sum(not profile.settled(c) for c in chunks) == 7
    got = [tuple(r) for r in profile.find_cases(spark, str(tmp_path), "id", "load_no").collect()]
    assert got == [("drift", "supplier", 8)]


def test_very_long_timestamps_are_read_whole(spark):
    v = ["2024-01-01T00:00:00." + "1" * 5000 + "Z", " " * 5000 + "2024-01-01T00:00:00Z" + " " * 5000, "2024-01-01" + " " * 500 + "10:00:00Z", "x" * 100_000, "2024 " * 5000]
    df = spark.createDataFrame([(i, x, None) for i, x in enumerate(v)], "k long, t string, z string")
    got = {r["k"]: (r["outcome"], r["utc_text"]) for r in timestamps.normalise_timestamps(df, "t", "z", "k").collect()}
    assert got == {0: ("utc", "2024-01-01T00:00:00.111111Z"), 1: ("utc", "2024-01-01T00:00:00.000000Z"), 2: ("utc", "2024-01-01T10:00:00.000000Z"), 3: ("bad", ""), 4: ("bad", "")}
