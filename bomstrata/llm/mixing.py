"""Mixing sources to target shares of tokens, with capped repetition.

1. Every text is tokenised once; only its number of tokens is kept.
2. The tokens of a source form one long line, in pseudorandom order of documents, cut into blocks of
   ``block_tokens``. The positions on that line are prefix sums in two levels: within hashed chunks of bounded
   size, and over the chunk totals; so no source is ever brought into one task, even one with a third of the rows.
3. Each output shard draws its number of blocks per source from a multinomial with the target shares. Prefix sums
   over the shards number the slots of a source.
4. Slot k of a source takes block ``permutation(epoch)(k mod blocks)``, epoch ``k div blocks``, where the
   permutation is a keyed Feistel network on the block numbers: computed, not stored. Slots of an epoch beyond
   ``max_repeats`` stay empty, as the source is used up.
5. Slots and blocks are joined by (source, block number).
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomstrata.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a chunk, within which positions are counted in one task.
CHUNK_ROWS = 50_000


@functools.lru_cache(maxsize=4)
def encoding(data: bytes):
    """The tokenizer of a file of ranks, given as its content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of each document with a source; null texts have 0 tokens.

    The file of ranks is read on the driver and broadcast: executors need no copy of it, and a vocabulary is bounded.
    """
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)], pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "source", "text").where(F.col("source").isNotNull()).mapInArrow(run, "doc_id long, source string, n_tokens long")


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 applied to ``x``: four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    y = x.astype(np.uint64)
    todo = np.ones(len(y), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            v = y[todo]
            left, right = v >> shift, v & mask
            for r in range(4):
                z = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0x2545F4914F6CDD1D + r * 0x632BE59BD9B4E019) % (1 << 64))
                z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(32))) & mask
                left, right = right, left ^ z
            y[todo] = (left << shift) | right
            todo[todo] = y[todo] >= np.uint64(n)
    return y.astype(np.int64)


@dataclass
class Mix:
    """``pieces``: source, block, doc_id, start, end (token positions in the document); ``slots``: shard, slot,
    source, k, epoch, block (null block: the source is used up); ``report``: one row per target source."""

    pieces: DataFrame
    slots: DataFrame
    report: DataFrame


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = 1024, shard_blocks: int = 4096, seed: int = 17) -> Mix:
    """Plan a mixture of all tokens of the listed sources.

    ``targets``: source, target_share, max_repeats. The mixture has as many tokens as the listed sources' documents,
    each taken once. Documents of other or null sources are left out; null and empty texts have no tokens; repeated
    rows are documents of their own; a listed source without documents has 0 tokens and falls short of any share
    above 0. Empty targets give empty results. The list of targets is collected: it is one row per source.
    """
    spark = docs.sparkSession
    listed = targets.select("source", F.col("target_share").cast("double"), F.col("max_repeats").cast("long")).where(F.col("source").isNotNull())
    counts = token_counts(docs.join(listed.select("source").distinct(), "source", "left_semi"), tokenizer)
    counts = cut(counts)
    sums = counts.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    plan = [(r["source"], r["target_share"], r["max_repeats"], r["n_tokens"] or 0, r["n_docs"] or 0) for r in listed.join(sums, "source", "left").orderBy("source").collect()]
    total, rows = sum(p[3] for p in plan), sum(p[4] for p in plan)
    chunks = max(1, -(-rows // CHUNK_ROWS))

    # positions on each source's line
    c = counts.where(F.col("n_tokens") > 0).withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(chunks))).withColumn("order", F.xxhash64("doc_id", F.lit(seed + 1)))
    heads = c.groupBy("source", "chunk").agg(F.sum("n_tokens").alias("n"))
    heads = heads.withColumn("head", F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).drop("n")
    inside = Window.partitionBy("source", "chunk").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("at", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(heads, ["source", "chunk"])
    first = F.col("head") + F.col("at")
    c = c.select("source", "doc_id", first.alias("a"), (first + F.col("n_tokens")).alias("b"))
    c = c.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block_tokens), F.floor((F.col("b") - 1) / block_tokens))))
    low, high = F.greatest(F.col("a"), F.col("block") * block_tokens), F.least(F.col("b"), (F.col("block") + 1) * block_tokens)
    pieces = c.select("source", "block", "doc_id", (low - F.col("a")).alias("start"), (high - F.col("a")).alias("end"))

    # slots
    names, share = [p[0] for p in plan], np.array([p[1] or 0.0 for p in plan])
    blocks = {p[0]: -(-p[3] // block_tokens) for p in plan}
    most = {p[0]: p[2] or 0 for p in plan}
    capacity = {p: blocks[p] * most[p] for p in blocks}
    n_slots = -(-total // block_tokens)
    shards = max(1, -(-n_slots // shard_blocks)) if n_slots else 0

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                size = min(shard_blocks, n_slots - s * shard_blocks)
                got = np.random.Generator(np.random.Philox(key=[seed, s])).multinomial(size, share / share.sum()) if share.sum() > 0 else np.zeros(len(share), int)
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(names), pa.int64()), pa.array(names, pa.string()), pa.array(got.astype(np.int64))], names=["shard", "source", "n"])

    drawn = spark.range(shards).select(F.col("id").alias("shard")).mapInArrow(draw, "shard long, source string, n long")
    by = Window.partitionBy("source").orderBy("shard")
    drawn = drawn.withColumn("k0", F.sum("n").over(by) - F.col("n")).where("n > 0")
    slots = drawn.select("shard", "source", F.explode(F.sequence(F.col("k0"), F.col("k0") + F.col("n") - 1)).alias("k"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, k = np.array(b.column(1).to_pylist(), object), b.column(2).to_numpy()
            epoch, block = np.zeros(len(k), np.int64), np.full(len(k), -1, np.int64)
            for i in sorted(set(source.tolist())):
                me, n = source == i, blocks[i]
                if not n:
                    continue
                epoch[me] = k[me] // n
                for e in np.unique(epoch[me]).tolist():
                    if e < most[i]:
                        now = me & (epoch == e)
                        block[now] = permute(k[now] % n, n, seed * 1_000_003 + names.index(i) * 8191 + e)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(epoch), pa.array(block, mask=block < 0)], names=["shard", "source", "k", "epoch", "block"])

    slots = slots.mapInArrow(place, "shard long, source string, k long, epoch long, block long")

    # what is reached: slots joined with the sizes of their blocks
    sizes = pieces.groupBy("source", "block").agg(F.sum(F.col("end") - F.col("start")).alias("size"))
    filled = slots.join(sizes, ["source", "block"], "left").groupBy("source").agg(F.sum("size").alias("mixed_tokens"), F.count(F.lit(1)).alias("n_slots"), F.count_if(F.col("block").isNull()).alias("n_empty"))
    info = spark.createDataFrame([(n, s, m, t, d, total) for n, s, m, t, d in plan], "source string, target_share double, max_repeats long, n_tokens long, n_docs long, all_tokens long")
    report = info.join(filled, "source", "left")
    all_mixed = F.sum(F.coalesce("mixed_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))  # one row per source
    report = report.withColumn("capacity", F.lit(0).cast("long") if not blocks else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in capacity.items() for x in kv]), F.col("source")), F.lit(0)))
    report = report.select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), (F.coalesce("mixed_tokens", F.lit(0)) / F.nullif(all_mixed, F.lit(0))).alias("actual_share"),
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"), "capacity", F.coalesce("n_empty", F.lit(0)).alias("empty_slots"), (F.col("n_tokens") * F.col("max_repeats") < F.col("target_share") * F.col("all_tokens")).alias("falls_short"),
    )
    return Mix(pieces, slots, report)


def short_sources(m: Mix) -> DataFrame:
    """``source``: sources that cannot reach their share.

    The draw shows them: slots stay empty, or, as a draw varies, fill the source's capacity (blocks times repeats) up to
    six standard deviations and one block per repeat. An exact comparison of tokens decides between those.
    """
    n = F.col("n_slots")
    near = (F.col("empty_slots") > 0) | (n + 6 * F.sqrt(n + 9) + F.coalesce("max_repeats", F.lit(0)) >= F.col("capacity"))
    return m.report.where(near & F.col("falls_short")).select("source")


def mixed_blocks(m: Mix) -> DataFrame:
    """``shard, source, k, epoch, block, pieces``: the filled slots with their pieces in order, joined by index."""
    packed = m.pieces.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "start", "end"))).alias("pieces"))  # a block has block_tokens pieces at most
    return m.slots.where(F.col("block").isNotNull()).join(packed, ["source", "block"]).select("shard", "source", "k", "epoch", "block", "pieces")
