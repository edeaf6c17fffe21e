"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles of every node.

Both ways through the operator run the same program level by level: a frontier that starts at the roots is
joined with the edges, extending paths and depths, and a second frontier of (ancestor, node) pairs is joined
with the edges until no new pair appears. A pair (n, n) is a cycle; a node that no root reaches is rootless.

Documents of bounded size (``local_rows`` rows at most) are shuffled once by document, and each task walks
as many of them at the same time, with vectorised joins on integer codes, as have ``_PAIRS`` ancestor pairs at most. A document above the bound is never
brought into one task: its levels are DataFrame joins on (document, node), cut by checkpoints. Which way a
document goes changes nothing in its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomstrata.session import cut

SEPARATOR = " > "
_OUT = "sbom_id long, node_ref string, kind string, root_ref string, depth int, n_descendants int, node_path string"
_NAMES = ["sbom_id", "node_ref", "kind", "root_ref", "depth", "n_descendants", "node_path"]
_PAIR = "sbom_id long, ancestor_ref string, node_ref string"
#: Rows of whole documents that a task holds, and ancestor pairs that documents walked together can have (a document of
#: n nodes has n * n at most; one that could have more is walked by itself).
_TOGETHER, _PAIRS = 60_000, 4_000_000


def _children(start: np.ndarray, dst: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join of a frontier ``at`` with the edges: (index into the frontier, child)."""
    n = start[at + 1] - start[at]
    left = np.repeat(np.arange(len(at)), n)
    inside = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
    return left, dst[np.repeat(start[at], n) + inside]


def walk(doc: np.ndarray, ref: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple:
    """Walk all documents at once. ``doc``/``ref``: per node; ``src``/``dst``: distinct edges as node numbers.

    Returns kind, root, depth, descendants and path per node, and the ancestor pairs as two arrays of node numbers.
    """
    n = len(doc)
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    start = np.searchsorted(src, np.arange(n + 1))
    root = np.ones(n, bool)
    root[dst] = False
    depth = np.full(n, -1)
    path = np.full(n, "", dtype=object)
    top = np.full(n, "", dtype=object)
    level = np.flatnonzero(root)
    depth[level], path[level], top[level] = 0, ref[level], ref[level]
    d = 0
    while len(level):
        d += 1
        left, kid = _children(start, dst, level)
        new = depth[kid] < 0
        left, kid = level[left[new]], kid[new]
        if not len(kid):
            break
        step = pd.DataFrame({"kid": kid, "path": path[left] + SEPARATOR + ref[kid], "by": left}).sort_values(["kid", "path"]).drop_duplicates("kid")
        level = step["kid"].to_numpy()
        depth[level], path[level], top[level] = d, step["path"].to_numpy(), top[step["by"].to_numpy()]
    # ancestor pairs, coded ancestor * n + node
    pairs = np.unique(src * n + dst)
    seen = pairs
    while len(pairs):
        left, kid = _children(start, dst, pairs % n)
        pairs = np.setdiff1d(np.unique(pairs[left] // n * n + kid), seen, assume_unique=True)
        if len(pairs):
            seen = np.sort(np.concatenate([seen, pairs]), kind="stable")
    a, b = seen // n, seen % n
    count = np.bincount(a[a != b], minlength=n)
    cycle = np.zeros(n, bool)
    cycle[a[a == b]] = True
    kind = np.where(cycle, "cycle", np.where(depth >= 0, "placed", "rootless")).astype(object)
    off = kind != "placed"
    depth[off], path[off], top[off] = -1, "", ""
    return kind, top, depth, count, path, (a, b)


def _codes(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (document, ref) in order of documents, and distinct edges as node numbers."""
    texts, names = pd.factorize(pd.concat([t["known"], t["src"], t["dst"]], ignore_index=True))
    doc_of, docs = pd.factorize(t["sbom_id"])
    known, src, dst = ((np.where(x < 0, -1, doc_of * len(names) + x)) for x in np.split(texts, 3))
    there = np.unique(known[known >= 0])
    src, dst = (np.where(np.isin(x, there), x, -1) for x in (src, dst))
    nodes = np.unique(np.r_[src[src >= 0], dst[dst >= 0]])
    both = (src >= 0) & (dst >= 0)
    edges = np.unique(np.searchsorted(nodes, src[both]) * len(nodes) + np.searchsorted(nodes, dst[both])) if len(nodes) else np.zeros(0, np.int64)
    doc, ref = np.divmod(nodes, max(1, len(names)))
    return np.asarray(docs, np.int64)[doc], np.asarray(names, object)[ref], edges // max(1, len(nodes)), edges % max(1, len(nodes))


def _solve(t: pa.Table, pairs: bool) -> Iterator[pa.RecordBatch]:
    doc, ref, src, dst = _codes(t.to_pandas())
    cut_at = np.flatnonzero(np.diff(doc)) + 1
    first, last = np.r_[0, cut_at], np.r_[cut_at, len(doc)]
    groups, size = [0], 0
    for i, n in enumerate((last - first).tolist() if len(doc) else []):
        if size and size + n * n > _PAIRS:
            groups.append(i)
            size = 0
        size += n * n
    for a, b in zip(groups, [*groups[1:], len(first)]) if len(doc) else ():
        x, y = first[a], last[b - 1]
        mine = (src >= x) & (src < y)
        d, r = doc[x:y], ref[x:y]
        kind, top, depth, count, path, (up, down) = walk(d, r, src[mine] - x, dst[mine] - x)
        if pairs:
            own = up != down
            yield pa.RecordBatch.from_arrays([pa.array(d[up[own]]), pa.array(r[up[own]], pa.string()), pa.array(r[down[own]], pa.string())], names=["sbom_id", "ancestor_ref", "node_ref"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(r, pa.string()), pa.array(kind, pa.string()), pa.array(top, pa.string()), pa.array(depth, pa.int32()), pa.array(count, pa.int32()), pa.array(path, pa.string())], names=_NAMES)


def _local(pairs: bool):
    """Map over rows sorted by document; (sbom_id, known) rows have a ref only, dependency rows src and dst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < _TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            ids = t["sbom_id"].to_numpy()
            end = int(np.searchsorted(ids, ids[-1]))  # the last document may go on in the next batch
            if end:
                yield from _solve(t.slice(0, end), pairs)
            rest = t.slice(end).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from _solve(pa.Table.from_batches(held), pairs)

    return run


def _graph(known: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges of documents too large for one task."""
    known = known.distinct()
    ends = links.select("sbom_id", F.col("src").alias("node")).union(links.select("sbom_id", F.col("dst").alias("node"))).distinct()
    nodes = cut(ends.join(known.withColumnRenamed("known", "node"), ["sbom_id", "node"], "left_semi"))
    edges = links.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("sbom_id", "src", "dst").distinct()
    for side in ("src", "dst"):
        edges = edges.join(nodes.withColumnRenamed("node", side), ["sbom_id", side], "left_semi")
    return nodes, cut(edges)


def _ancestors(edges: DataFrame) -> DataFrame:
    """All pairs (anc, node) that a path connects, level by level."""
    pairs = edges.select("sbom_id", F.col("src").alias("anc"), F.col("dst").alias("node"))
    seen, k = pairs, 0
    while not pairs.isEmpty():
        k += 1
        step = pairs.withColumnRenamed("node", "src").join(edges, ["sbom_id", "src"]).select("sbom_id", "anc", F.col("dst").alias("node")).distinct()
        pairs = cut(step.join(seen, ["sbom_id", "anc", "node"], "left_anti"))
        seen = seen.unionByName(pairs)
        if k % 8 == 0:
            seen = cut(seen)
    return seen


def _distributed(known: DataFrame, links: DataFrame) -> DataFrame:
    """The same levels as joins of DataFrames."""
    nodes, edges = _graph(known, links)
    roots = nodes.join(edges.select("sbom_id", F.col("dst").alias("node")), ["sbom_id", "node"], "left_anti")
    level = cut(roots.select("sbom_id", "node", F.col("node").alias("root_ref"), F.lit(0).alias("depth"), F.col("node").alias("node_path")))
    placed, d = level, 0
    while not level.isEmpty():
        d += 1
        step = level.withColumnRenamed("node", "src").join(edges, ["sbom_id", "src"]).select("sbom_id", F.col("dst").alias("node"), F.struct(F.concat_ws(SEPARATOR, "node_path", "dst").alias("p"), F.col("root_ref").alias("r")).alias("x"))
        step = step.join(placed.select("sbom_id", "node"), ["sbom_id", "node"], "left_anti").groupBy("sbom_id", "node").agg(F.min("x").alias("x"))
        level = cut(step.select("sbom_id", "node", F.col("x.r").alias("root_ref"), F.lit(d).alias("depth"), F.col("x.p").alias("node_path")))
        placed = placed.unionByName(level)
        if d % 8 == 0:
            placed = cut(placed)
    seen = _ancestors(edges)
    below = seen.groupBy("sbom_id", F.col("anc").alias("node")).agg(F.count_if(F.col("anc") != F.col("node")).cast("int").alias("n"), F.max(F.col("anc") == F.col("node")).alias("cyclic"))
    out = nodes.join(placed, ["sbom_id", "node"], "left").join(below, ["sbom_id", "node"], "left")
    kind = F.when(F.coalesce("cyclic", F.lit(False)), "cycle").when(F.col("depth").isNotNull(), "placed").otherwise("rootless")
    on = kind == "placed"
    return out.select(
        "sbom_id", F.col("node").alias("node_ref"), kind.alias("kind"), F.when(on, F.col("root_ref")).otherwise("").alias("root_ref"), F.when(on, F.col("depth")).otherwise(-1).cast("int").alias("depth"),
        F.coalesce("n", F.lit(0)).cast("int").alias("n_descendants"), F.when(on, F.col("node_path")).otherwise("").alias("node_path"),
    )


def _split(deps: DataFrame, components: DataFrame, local_rows: int) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(rows of documents for tasks, sorted by document; nodes and links of the documents above the bound, if any)."""
    known = components.where(F.col("bom_ref").isNotNull() & F.col("sbom_id").isNotNull()).select("sbom_id", F.col("bom_ref").alias("known"))
    raw = deps.where(F.col("sbom_id").isNotNull())
    sizes = known.select("sbom_id", F.lit(1).alias("n")).unionByName(raw.select("sbom_id", (F.greatest(F.size("depends_on"), F.lit(0)) + 1).alias("n")))
    big = cut(sizes.groupBy("sbom_id").agg(F.sum("n").alias("n")).where(F.col("n") > local_rows).select("sbom_id"))
    links = raw.select("sbom_id", F.col("dep_ref").alias("src"), F.explode_outer("depends_on").alias("dst"))
    null = F.lit(None).cast("string")
    rows = known.select("sbom_id", "known", null.alias("src"), null.alias("dst")).unionByName(links.select("sbom_id", null.alias("known"), "src", "dst"))
    if big.isEmpty():
        return rows.repartition("sbom_id").sortWithinPartitions("sbom_id"), None
    rows = rows.join(big, "sbom_id", "left_anti").repartition("sbom_id").sortWithinPartitions("sbom_id")
    return rows, (known.join(big, "sbom_id", "left_semi"), links.join(big, "sbom_id", "left_semi"))


def hierarchies(deps: DataFrame, components: DataFrame, local_rows: int = 3000) -> DataFrame:
    """Every node of each document with its kind, root, depth, descendants and path.

    ``deps``: sbom_id, dep_ref, depends_on; ``components``: sbom_id, bom_ref. Nodes are texts in ``dep_ref`` or
    ``depends_on`` that are a ``bom_ref`` of the same document. Kinds: ``cycle``, ``placed`` (reached from a
    root, or a root), ``rootless``. Of equally short paths the smallest text by code points counts.

    Null documents, references and elements are no nodes; the empty text is one where a ``bom_ref`` is empty.
    Repeated rows, elements and edges count once. Documents without nodes, and empty tables, give no rows.
    Only the named columns are read.
    """
    rows, big = _split(deps, components, local_rows)
    out = rows.mapInArrow(_local(False), _OUT)
    return out.unionByName(_distributed(*big)) if big else out


def descendants(deps: DataFrame, components: DataFrame, local_rows: int = 3000) -> DataFrame:
    """``sbom_id, ancestor_ref, node_ref``: each node with every other node that it reaches. Cases as in ``hierarchies``.

    The table is as long as the hierarchies are deep: a chain of n nodes has n * (n - 1) / 2 rows.
    """
    rows, big = _split(deps, components, local_rows)
    out = rows.mapInArrow(_local(True), _PAIR)
    if big:
        out = out.unionByName(_ancestors(_graph(*big)[1]).where("anc <> node").select("sbom_id", F.col("anc").alias("ancestor_ref"), F.col("node").alias("node_ref")))
    return out
