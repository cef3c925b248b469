"""Mixing sources to target weights, in blocks of tokens.

Documents are cut into tokens of a public tokenizer. A source's documents stand
in one pseudorandom order that depends on nothing but the documents, and their
tokens are cut at every multiple of the block length: each block is full but a
source's last, however the work was divided. Positions come from prefix sums
over ranges of the order.

The mixture is a sequence of slots in output shards. Where a shard is made, the
number of slots each source gets there is drawn from a multinomial
distribution, conditioned on the planned totals by splitting them over ever
smaller ranges of shards; so the shares are exact instead of merely expected,
and no shard needs to know of another. A source's slots run through
pseudorandom permutations of its block numbers, one for each repetition, and
blocks are joined to slots by number. The driver gathers one row for each target
source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, log2
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.storage import materialise

# Fixed value: the public pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1024
SHARD_SLOTS = 8192
#: Tokens in a range of a source's order whose documents are placed by one task, about.
RANGE_TOKENS = 1 << 20
_FINE = 12  # bits of a range's number that are summed up first
_TASK_SHARDS = 32
#: Longest run of text given to the tokenizer at once, in characters.
_PIECE = 1 << 20


class Tokenizer:
    """Byte-pair tokens of a rank file's bytes, as little-endian unsigned integers of 2 bytes where they suffice, else 4."""

    def __init__(self, ranks: bytes):
        import tiktoken

        lines = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(a): int(b) for a, b in lines}
        self.dtype = np.dtype("<u2" if max(table.values(), default=0) < 1 << 16 else "<u4")
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The text's tokens; the strings of special tokens are ordinary text. Very long texts are encoded in pieces."""
        text = text.encode("utf-8", "replace").decode()
        parts = [
            self.encoding.encode_to_numpy(text[i : i + _PIECE], disallowed_special=()).astype(self.dtype)
            for i in range(0, len(text), _PIECE)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, self.dtype)


def tokenised(docs: DataFrame, *, doc_id: str, text: str, source: str, ranks: bytes) -> DataFrame:
    """``(doc_id, source, h, n, tokens)``: each document's tokens, their number, and its place in the source's order.

    Null sources and null or empty texts give nothing.
    """
    rows = docs.filter(F.col(source).isNotNull() & (F.col(text) != "")).select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("h"),
        F.col(text).alias("text"),
    )
    out = T.StructType([*rows.schema.fields[:3], T.StructField("n", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, under 1 MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(sent.value)
        for batch in batches:
            found = [tokenizer.encode(t) for t in batch.column(3).to_pylist()]
            sizes = pa.array([len(x) for x in found], pa.int32())
            tokens = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sizes, tokens], names=out.names)

    return rows.mapInArrow(encode, out)


def _placed(tokens: DataFrame, total: int) -> DataFrame:
    """``tokens`` with ``offset``, the number of tokens before a document in its source's order.

    The order is by hash, in ranges small enough for one task; sums over ranges
    are taken in two steps, so that no task sees more than a few thousand.
    """
    bits = min(2 * _FINE, max(0, ceil(log2(max(1, total) / RANGE_TOKENS))))
    number = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    ranged = tokens.withColumn("range", number)
    sums = ranged.groupBy("source", "range").agg(F.sum("n").alias("tokens"))
    sums = materialise(sums.withColumn("coarse", F.shiftright("range", _FINE)), "ranges")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = sums.groupBy("source", "coarse").agg(F.sum("tokens").alias("tokens"))
    coarse = coarse.select("source", "coarse", before(Window.partitionBy("source").orderBy("coarse")).alias("first"))
    fine = sums.withColumn("within", before(Window.partitionBy("source", "coarse").orderBy("range")))
    starts = fine.join(coarse, ["source", "coarse"]).select("source", "range", (F.col("first") + F.col("within")).alias("first"))
    order = Window.partitionBy("source", "range").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(starts, ["source", "range"]).withColumn("offset", F.col("first") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    return placed.select("doc_id", "source", "n", "tokens", "offset")


def cut_blocks(tokens: DataFrame, total: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of ``block_tokens`` tokens: ``(source, block, n_tokens, tokens, segments)``.

    Every document of `tokenised` is in them whole and once; a source's last
    block may be shorter. ``segments`` tells which tokens of which documents a
    block holds. The result does not depend on how the rows are divided.
    """
    size, offset = F.lit(block_tokens), F.col("offset")
    last = F.expr(f"(offset + n - 1) div {block_tokens}")
    pieces = _placed(tokens, total).select(
        "doc_id", "source", "n", "tokens", "offset", F.explode(F.sequence(F.expr(f"offset div {block_tokens}"), last)).alias("block")
    )
    lo = F.greatest(offset, F.col("block") * size)
    hi = F.least(offset + F.col("n"), (F.col("block") + 1) * size)
    width = (F.octet_length("tokens") / F.col("n")).cast("int")
    begin = ((lo - offset) * width + 1).cast("int")
    piece = F.struct(
        lo.alias("at"),
        F.col("doc_id"),
        (lo - offset).cast("int").alias("start"),
        (hi - lo).cast("int").alias("n"),
        F.substring("tokens", begin, ((hi - lo) * width).cast("int")).alias("tokens"),
    )
    held = pieces.groupBy("source", "block").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    joined = F.aggregate("pieces", F.lit(b""), lambda done, p: F.concat(done, p["tokens"]))
    return held.select(
        "source",
        "block",
        F.aggregate("pieces", F.lit(0), lambda done, p: done + p["n"]).alias("n_tokens"),
        joined.alias("tokens"),
        F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["n"].alias("n"))).alias(
            "segments"
        ),
    )


@dataclass
class SourcePlan:
    """What a source can give and what the mixture takes of it, in blocks."""

    source: str
    target_share: float
    max_repeats: int
    n_blocks: int
    n_tokens: int
    slots: int = 0
    planned: float = 0.0

    @property
    def capacity(self) -> float:
        return float(self.n_tokens) * self.max_repeats


def _fill(able: Sequence[SourcePlan], level: float) -> list[int]:
    """Slots that give each source ``level`` times its share in tokens, or all it can give."""
    slots = []
    for s in able:
        per_block = s.n_tokens / s.n_blocks
        slots.append(min(s.n_blocks * s.max_repeats, max(1, round(min(s.capacity, s.target_share * level) / per_block))))
    return slots


def _best_level(able: Sequence[SourcePlan]) -> float:
    """The level (see `_fill`) of the mixture with the shares nearest to the targets.

    At each source's capacity / share, the sources that end before are limited
    and the others in proportion. Sizes beyond the first lose share where
    sources are limited, but have more blocks, so that whole blocks distort
    less: half a block of each source counts as error besides the distance of
    the planned shares. Of equal errors the larger mixture wins.
    """
    whole = sum(s.target_share for s in able)
    doubt = sum(s.n_tokens / s.n_blocks for s in able) / 2
    best, best_error = 0.0, float("inf")
    for level in sorted({s.capacity / s.target_share for s in able}):
        exact = [min(s.capacity, s.target_share * level) for s in able]
        total = sum(exact)
        if sum(max(0.0, s.target_share / whole - x / total) for s, x in zip(able, exact, strict=True)) > best_error:
            break  # what limited sources lack only grows with the level
        tokens = [n * s.n_tokens / s.n_blocks for s, n in zip(able, _fill(able, level), strict=True)]
        total = sum(tokens)
        error = sum(abs(s.target_share / whole - x / total) for s, x in zip(able, tokens, strict=True)) / 2 + doubt / total
        if error <= best_error:
            best, best_error = level, error
    return best


def plan_slots(sources: Sequence[SourcePlan], total_tokens: float | None = None) -> None:
    """Sets ``slots``, and ``planned`` tokens before rounding to blocks, so that the shares come as near to the targets as text and repetitions allow.

    Without ``total_tokens`` the mixture is as large as it can be with every
    source that has text at its share; the shares of sources without text go to
    the others in proportion. Where so few blocks would be left that rounding
    to whole blocks distorts the shares more than the lack of the smallest
    sources does, these are limited instead: they are used as often as allowed,
    and the others share the rest in proportion. With a total, sources that
    cannot fill their part of it are treated in the same way, as far as there
    is text.
    """
    able = [s for s in sources if s.capacity > 0 and s.target_share > 0]
    for s in sources:
        s.slots, s.planned = 0, 0.0
    if not able:
        return
    if total_tokens is None:
        level = _best_level(able)
    else:
        level, left, open_ = 0.0, float(total_tokens), list(able)
        while open_:
            level = left / sum(s.target_share for s in open_)
            full = [s for s in open_ if s.target_share * level > s.capacity * (1 + 1e-12)]
            if not full:
                break
            for s in full:
                left -= s.capacity
                open_.remove(s)
        else:
            level = float("inf")
    for s, n in zip(able, _fill(able, level), strict=True):
        s.slots, s.planned = n, min(s.capacity, s.target_share * level)


# Numpy's limit of an exact hypergeometric draw.
_EXACT = 10**9


def _share(rng: np.random.Generator, mine: int, others: int, n: int) -> int:
    """How many of ``n`` places, drawn without repetition from those of all, are mine."""
    whole = mine + others
    if whole < _EXACT:
        return int(rng.hypergeometric(mine, others, n)) if whole else 0
    part = n / whole
    if mine < whole / 1000:  # so rare that the places hardly exclude each other
        drawn = int(rng.binomial(mine, part))
    else:
        deviation = (n * (mine / whole) * (others / whole) * (1 - part)) ** 0.5
        drawn = round(n * (mine / whole) + deviation * rng.standard_normal())
    return min(mine, n, max(0, n - others, drawn))


class Shards:
    """Slots of each source in each output shard: multinomial draws given the totals.

    The totals of a range of shards are split between its halves by a
    multivariate hypergeometric draw, seeded by the range; that is the
    distribution of multinomial draws of all shards whose totals are known
    (above 10^9 slots its normal or binomial limit). One shard needs one split
    for each halving on the way to it.
    """

    def __init__(self, slots: Sequence[int], shard_slots: int, seed: int):
        self.slots, self.shard_slots, self.seed = tuple(map(int, slots)), shard_slots, seed
        self.total = sum(self.slots)
        self.n = -(-self.total // shard_slots)
        self._split = lru_cache(1 << 12)(self._draw)

    def size(self, lo: int, hi: int) -> int:
        return min(hi * self.shard_slots, self.total) - lo * self.shard_slots

    def _draw(self, lo: int, hi: int, have: tuple[int, ...]) -> tuple[int, ...]:
        rng = np.random.default_rng([self.seed, lo, hi])
        open_, others, left = self.size(lo, (lo + hi) // 2), sum(have), []
        for mine in have:
            others -= mine
            left.append(_share(rng, mine, others, open_))
            open_ -= left[-1]
        return tuple(left)

    def __getitem__(self, shard: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Each source's slots in all shards before this one, and in this one."""
        lo, hi, have, before = 0, self.n, self.slots, (0,) * len(self.slots)
        while hi - lo > 1:
            left, middle = self._split(lo, hi, have), (lo + hi) // 2
            if shard < middle:
                have, hi = left, middle
            else:
                before = tuple(b + x for b, x in zip(before, left, strict=True))
                have, lo = tuple(h - x for h, x in zip(have, left, strict=True)), middle
        return before, have


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each ``index`` in a pseudorandom permutation of range(``size``) chosen by ``key``.

    A four-round Feistel network over the next even number of bits, walked
    along its cycle until it is inside the range.
    """
    index, size, key = (np.asarray(x, np.uint64) for x in (index, size, key))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(np.float64)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = right + k + np.uint64(r * 0x9E3779B97F4A7C15 & 2**64 - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out


def slot_table(spark: SparkSession, plans: Sequence[SourcePlan], shard_slots: int, seed: int) -> DataFrame:
    """One row for each slot: ``(shard, slot, source, block, repetition)``, made where its shard is drawn."""
    used = [p for p in plans if p.slots]
    shards = Shards([p.slots for p in used], shard_slots, seed)
    names, blocks = pa.array([p.source for p in used], pa.string()), [p.n_blocks for p in used]
    out = "shard long, slot long, source string, block long, repetition int"
    salt, totals, size = np.uint64(seed), shards.slots, shards.shard_slots

    def make(shards: Shards, shard: int) -> pa.RecordBatch:
        before, here = shards[shard]
        code = np.repeat(np.arange(len(here)), here)
        j = np.concatenate([b + np.arange(n) for b, n in zip(before, here, strict=True)])
        n_blocks = np.array(blocks, np.int64)[code]
        repetition = j // n_blocks
        with np.errstate(over="ignore"):
            key = (salt * np.uint64(1_000_003) + code.astype(np.uint64)) * np.uint64(1_000_003) + repetition.astype(np.uint64)
            place = permuted(np.arange(len(j)), np.full(len(j), len(j)), np.full(len(j), salt + np.uint64(shard + 7)))
        block = permuted(j % n_blocks, n_blocks, key)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(j), shard)),
                pa.array(place.astype(np.int64)),
                names.take(pa.array(code)),
                pa.array(block.astype(np.int64)),
                pa.array(repetition.astype(np.int32)),
            ],
            names=["shard", "slot", "source", "block", "repetition"],
        )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Shards(totals, size, seed)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield make(mine, shard)

    tasks = max(1, ceil(shards.n / _TASK_SHARDS))
    return spark.range(0, shards.n, 1, tasks).mapInArrow(expand, out)


@dataclass
class Mixture:
    """``blocks`` holds the mixture, ``report`` the shares reached; both are lazy."""

    blocks: DataFrame
    report: DataFrame


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: str = "target_share",
    max_repeats: str = "max_repeats",
    tokenizer: str,
    total_tokens: float | None = None,
    block_tokens: int = BLOCK_TOKENS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 17,
) -> Mixture:
    """A mixture of the sources by target shares of its tokens (see `plan_slots` for what is reached).

    ``tokenizer`` names the vocabulary file of a public byte-pair tokenizer.
    ``blocks`` has ``(shard, slot, source, block, repetition, n_tokens, tokens,
    segments)``: within a shard, slots 0.. are a random order of its sources;
    ``tokens`` are little-endian unsigned integers of 2 bytes (4 for a vocabulary
    of more than 65,536). All blocks have ``block_tokens`` but each source's last.
    No block, hence no part of a document, occurs more often than its source's
    ``max_repeats``. ``report`` has one row for each source in either table:
    ``(source, target_share, max_repeats, source_tokens, max_tokens,
    planned_tokens, used_tokens, actual_share, limited)``.

    Targets with a null source, a null or negative share or null or negative
    repetitions count as a share or repetitions of zero; of repeated sources the
    row with the largest share counts. Documents with a null source belong to no
    source and are left out; those of sources without a target are reported with
    a share of zero. Null and empty texts have no tokens; texts of any length
    are used whole. Empty tables give an empty mixture. Copies of a document
    are documents of their own. Targets are a small table: one row for each
    source is read by the driver.
    """
    spark = docs.sparkSession
    ranks = Path(tokenizer).read_bytes()
    wanted = (
        targets.filter(F.col(source).isNotNull())
        .groupBy(F.col(source).alias("source"))
        .agg(
            F.max(
                F.struct(
                    F.greatest(F.coalesce(F.col(share), F.lit(0.0)), F.lit(0.0)).alias("share"),
                    F.greatest(F.coalesce(F.col(max_repeats), F.lit(0)), F.lit(0)).alias("repeats"),
                )
            ).alias("t")
        )
        .select("source", "t.share", "t.repeats")
    )
    tokens = materialise(tokenised(docs, doc_id=doc_id, text=text, source=source, ranks=ranks), "tokens").filter("n > 0")
    sizes = materialise(tokens.groupBy("source").agg(F.sum("n").alias("n_tokens")), "sizes")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    plans = [
        SourcePlan(r["source"], r["share"], r["repeats"], -(-(r["n_tokens"] or 0) // block_tokens), r["n_tokens"] or 0)
        for r in wanted.join(sizes, "source", "left").collect()  # one row for each target source
    ]
    plans.sort(key=lambda p: p.source)
    plan_slots(plans, total_tokens)

    slots = slot_table(spark, plans, shard_slots, seed)
    taken = [p.source for p in plans if p.slots]
    blocks = cut_blocks(tokens.filter(F.col("source").isin(taken)), total, block_tokens)
    # Spark takes expanded slots for as small as the shards they come from, so the join's kind is not left to its
    # estimate. Blocks are gathered by the same key, so their tokens are not shuffled again for it.
    mixed = slots.hint("shuffle_merge").join(blocks, ["source", "block"]).select(
        "shard", "slot", "source", "block", "repetition", "n_tokens", "tokens", "segments"
    )
    known = spark.createDataFrame([(p.source, p.n_tokens, p.planned) for p in plans], "source string, n long, planned double")
    length = F.least(F.lit(block_tokens), F.col("n") - F.col("block") * block_tokens)
    used = slots.join(F.broadcast(known), "source").groupBy("source").agg(F.sum(length).alias("used_tokens"))
    every = sizes.join(wanted, "source", "full").join(used, "source", "left").join(known.drop("n"), "source", "left")
    everything = F.sum(F.coalesce("used_tokens", F.lit(0))).over(Window.partitionBy())  # one row for each source
    report = every.select(
        "source",
        F.coalesce("share", F.lit(0.0)).alias("target_share"),
        F.coalesce("repeats", F.lit(0)).cast("int").alias("max_repeats"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("source_tokens"),
        (F.coalesce("n_tokens", F.lit(0)) * F.coalesce("repeats", F.lit(0))).cast("long").alias("max_tokens"),
        F.coalesce("planned", F.lit(0.0)).alias("planned_tokens"),
        F.coalesce("used_tokens", F.lit(0)).cast("long").alias("used_tokens"),
        F.coalesce(F.try_divide(F.coalesce("used_tokens", F.lit(0)), everything), F.lit(0.0)).alias("actual_share"),
    ).withColumn("limited", F.col("used_tokens") >= F.col("max_tokens"))
    return Mixture(mixed, report)
