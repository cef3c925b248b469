"""Evaluation texts leaking into training text, by a stored positional inverted index.

The index is a written table of postings: for each shard of the corpus and each
term the positions of the term in the shard. Shards are runs of documents of a
few megabytes, so the postings of a frequent term are spread over all of them,
and an index answers any number of item sets without the corpus being read
again.

A run of successive words of an item is looked up by intersecting its terms'
position lists, shifted by the terms' offsets, from the globally rarest term on
(exact matches), or by stepping from an occurrence of the rarest term to the
nearest occurrences of its neighbours in either direction (proximity matches,
with words put in between). Only the postings of the items' terms are read and
moved, each shard's to one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.batches import spans
from corvane.storage import materialise

#: Bytes of passages that are sent to the tasks at once; more are taken in several passes over the index.
QUERY_BYTES = 16 << 20
#: Bytes of text in a shard, unless a single text is longer.
SHARD_BYTES = 8 << 20
_CANDIDATES = 4_000_000  # places checked at once
_WORD = re.compile(rb"[0-9a-z]+")
# Each byte of a word in lower case, 0 for every other.
_LOWER = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _LOWER[_c] = _LOWER[ord(chr(_c).upper())] = _c


def words(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits, in lower case."""
    return _WORD.findall(text.encode("utf-8", "replace").lower())


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and the number of words before each text (and of all)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    low = _LOWER[raw]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at_start = bounds[:-1][bounds[:-1] < len(raw)]
    begins[at_start] = inside[at_start]
    n = int(begins.sum())
    offsets = np.append(np.flatnonzero(begins[inside]), int(inside.sum())).astype(np.int32)
    found = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(low[inside])))
    return found, np.searchsorted(np.flatnonzero(begins), bounds)


def _postings(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Terms, numbers of postings, the postings of each as bytes of increments, and each text's first position."""
    found, first = split_words(texts)
    encoded = found.dictionary_encode()
    codes = np.asarray(encoded.indices)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    counts = np.bincount(codes, minlength=len(encoded.dictionary)).astype(np.int32)
    ends = np.cumsum(counts, dtype=np.int64)
    steps = np.diff(order, prepend=np.int32(0))
    starts = ends - counts
    steps[starts] = order[starts]
    offsets = np.append(0, 4 * ends).astype(np.int32)
    lists = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(steps)])
    return encoded.dictionary, counts, lists, first.astype(np.int32)


@dataclass
class PositionalIndex:
    """``table`` has ``(shard, term, n, positions, doc_ids, first)``.

    A row with a term holds its postings in a shard; the row of a shard
    without a term holds the ids of its texts and where each begins.
    """

    table: DataFrame

    @property
    def id_type(self) -> T.DataType:
        return self.table.schema["doc_ids"].dataType.elementType

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """``(term, n)``: occurrences in the whole corpus of those of ``terms`` that occur."""
        return self.table.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> PositionalIndex:
    """The index of all words of all texts, written into the shared folder; one pass over the corpus, without a shuffle.

    Null ids are left out; null and empty texts have no words. Repeated ids are
    indexed as they stand.
    """
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("term", T.StringType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("positions", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(rows.schema["doc_id"].dataType)),
            T.StructField("first", T.BinaryType()),
        ]
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, size
            ids = pa.concat_arrays([b.column(0) for b in held])
            terms, counts, lists, first = _postings(pa.concat_arrays([b.column(1) for b in held]))
            kind = pa.list_(ids.type)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([None], pa.string()),
                    pa.array([0], pa.int32()),
                    pa.array([None], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([first.tobytes()], pa.binary()),
                ],
                names=out.names,
            )
            for lo in range(0, len(terms), 50_000):
                part = slice(lo, lo + 50_000)
                n = len(counts[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, shard)),
                        terms[part],
                        pa.array(counts[part]),
                        lists[part],
                        pa.nulls(n, kind),
                        pa.nulls(n, pa.binary()),
                    ],
                    names=out.names,
                )
            shard += 1
            held.clear()
            size = 0

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in spans(sizes, shard_bytes):
                part = sum(sizes[lo:hi])
                if held and size + part > shard_bytes:
                    yield from flush()
                held.append(batch.slice(lo, hi - lo))
                size += part
        if held:
            yield from flush()

    return PositionalIndex(materialise(rows.mapInArrow(index, out), "index"))


class Queries:
    """The distinct runs of ``run`` words of a block of items."""

    def __init__(self, passages: Sequence[str | None], run: int):
        self.run = run
        self.terms: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        owner: list[tuple[int, int]] = []
        for i, passage in enumerate(passages):
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(passage or "")]
            for r in {tuple(ids[k : k + run]) for k in range(len(ids) - run + 1)}:
                owner.append((number.setdefault(r, len(number)), i))
        self.runs = np.array(list(number), np.int64).reshape(-1, run)
        owner.sort()
        self.owners = np.array([i for _, i in owner], np.int64)
        self.first = np.searchsorted([r for r, _ in owner], np.arange(len(number) + 1))
        self.n_runs = np.bincount(self.owners, minlength=len(passages))
        self.frequency = np.zeros(len(self.terms), np.int64)

    def items(self, run: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of item and document for pairs of run and document."""
        size = self.first[run + 1] - self.first[run]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.owners[np.repeat(self.first[run], size) + place], np.repeat(doc, size)


class Shard:
    """Positions of the queries' terms in a shard, given as pairs of a term's number and its positions."""

    def __init__(self, first: np.ndarray, n_terms: int, terms: np.ndarray, lists: Sequence[np.ndarray]):
        self.first, n = first, int(first[-1]) if len(first) else 0
        self.df = np.zeros(n_terms, np.int64)
        self.df[terms] = [len(x) for x in lists]
        order = np.argsort(terms)
        self.postings = np.concatenate([lists[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        self.start = np.cumsum(self.df) - self.df
        self.term = np.full(n, -1, np.int64)
        self.term[self.postings] = np.repeat(np.arange(n_terms), self.df)
        self.keys = np.repeat(np.arange(n_terms), self.df) * (n + 1) + self.postings  # postings in order of term and place

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def _anchors(self, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs all of whose terms are here, the order of their words by frequency, and places of their rarest."""
        if not len(q.runs) or not len(self.postings):
            return
        alive = np.flatnonzero(self.df[q.runs].min(axis=1) > 0)
        rarest_first = np.argsort(q.frequency[q.runs[alive]], axis=1, kind="stable")
        rarest = q.runs[alive, rarest_first[:, 0]] if len(alive) else np.zeros(0, np.int64)
        sizes = self.df[rarest]
        for lo, hi in spans(sizes.tolist(), _CANDIDATES):
            size = sizes[lo:hi]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            which = np.repeat(np.arange(lo, hi), size)
            yield alive[which], rarest_first[which], self.postings[self.start[rarest[which]] + place]

    def _pairs(self, run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(np.stack([run, self.doc(at)]), axis=1)
        return pairs[0], pairs[1]

    def exact(self, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of arrays: number of a run, text with it; each pair once."""
        n = len(self.term)
        for run, order, place in self._anchors(q):
            at = place - order[:, 0]
            ok = (at >= 0) & (at + q.run <= n)
            run, order, at = run[ok], order[ok], at[ok]
            for k in range(1, q.run):
                off = order[:, k]
                ok = self.term[at + off] == q.runs[run, off]
                run, order, at = run[ok], order[ok], at[ok]
            ok = self.doc(at) == self.doc(at + q.run - 1)
            yield self._pairs(run[ok], at[ok])

    def near(self, q: Queries, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for runs whose words follow each other with at most ``slack`` words between, exact ones included."""
        n, least = len(self.term), q.run + slack
        for run, order, place in self._anchors(q):
            anchor, lo, hi = order[:, 0], place, place.copy()
            for step in range(1, q.run):
                for sign in (1, -1):  # the nearest next word on either side makes the shortest stretch
                    k = anchor + sign * step
                    has = (k >= 0) & (k < q.run)
                    term = q.runs[run, np.clip(k, 0, q.run - 1)]
                    key = term * (n + 1)
                    if sign > 0:
                        i = np.searchsorted(self.keys, key + hi, side="right")
                        there = i < self.start[term] + self.df[term]
                    else:
                        i = np.searchsorted(self.keys, key + lo, side="left") - 1
                        there = i >= self.start[term]
                    to = self.postings[np.clip(i, 0, len(self.postings) - 1)]
                    hi, lo = (np.where(has, to, hi), lo) if sign > 0 else (hi, np.where(has, to, lo))
                    ok = (~has | there) & (hi - lo < least)
                    run, anchor, lo, hi = run[ok], anchor[ok], lo[ok], hi[ok]
            ok = self.doc(lo) == self.doc(hi)
            yield self._pairs(run[ok], lo[ok])


def _search(q: Queries, shard: Shard, slack: int, min_share: float) -> tuple[np.ndarray, ...]:
    """Item, text, exact runs and further runs met with gaps, of all pairs that hold enough of an item's runs."""

    def counted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of item and text as one number each, and their runs."""
        run = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
        doc = np.concatenate([d for _, d in found]) if found else np.zeros(0, np.int64)
        item, doc = q.items(run, doc)
        return np.unique(item * len(shard.first) + doc, return_counts=True)

    pair, n_exact = counted(list(shard.exact(q)))
    n_near = np.zeros(len(pair), np.int64)
    if slack > 0:
        every, n_every = counted(list(shard.near(q, slack)))  # holds the exact ones
        exact = np.zeros(len(every), np.int64)
        exact[np.searchsorted(every, pair)] = n_exact
        pair, n_exact, n_near = every, exact, n_every - exact
    item, doc = np.divmod(pair, max(1, len(shard.first)))
    ok = n_exact + n_near >= min_share * q.n_runs[item]
    return item[ok], doc[ok], n_exact[ok], n_near[ok]


def search_index(
    index: PositionalIndex,
    items: DataFrame,
    *,
    item_id: str = "item_id",
    passage: str = "passage",
    doc_id: str = "doc_id",
    run: int = 5,
    min_share: float = 0.25,
    slack: int = 3,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """`leaked_passages` in an index that is there already."""
    queries = items.filter(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(
        F.col(item_id).alias("item_id"), F.col(passage).alias("passage")
    )
    total = queries.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    blocks = max(1, ceil(total / query_bytes))
    out = T.StructType(
        [
            T.StructField("item_id", queries.schema["item_id"].dataType),
            T.StructField("doc_id", index.id_type),
            *(T.StructField(c, T.LongType()) for c in ("n_runs", "n_exact", "n_near")),
        ]
    )
    found = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = part.distinct().collect()  # about query_bytes of text
        pairs = _search_block(index, [r["item_id"] for r in rows], [r["passage"] for r in rows], out, run, min_share, slack)
        found = pairs if found is None else found.unionByName(pairs)
    best = F.max(F.struct((F.col("n_exact") / F.col("n_runs")).alias("share"), "n_near", "n_exact", "n_runs"))
    kind = F.when(F.col("b.share") >= min_share, "exact").otherwise("near")
    return (
        found.groupBy("item_id", "doc_id")
        .agg(best.alias("b"))
        .select(
            F.col("item_id").alias(item_id), F.col("doc_id").alias(doc_id),
            "b.n_runs", "b.n_exact", "b.n_near", "b.share", kind.alias("match_kind"),
        )
    )


def _search_block(
    index: PositionalIndex, ids: list, passages: list[str], out: T.StructType, run: int, min_share: float, slack: int
) -> DataFrame:
    spark = index.table.sparkSession
    q = Queries(passages, run)
    names = pa.table({"term": [t.decode() for t in q.terms], "code": np.arange(len(q.terms), dtype=np.int32)})
    terms = spark.createDataFrame(names.to_pandas(), "term string, code int")
    for r in index.frequencies(terms.select("term")).collect():  # at most the block's terms
        q.frequency[q.terms[r["term"].encode()]] = r["n"]
    # Broadcast variables are unpickled by reference, so plain arrays are sent.
    sent = spark.sparkContext.broadcast({k: v for k, v in vars(q).items() if k != "terms"})
    n_terms = len(q.terms)

    def search(rows: pa.Table) -> pa.Table:
        mine = Queries([], run)
        vars(mine).update(sent.value)
        has_term = pc.is_valid(rows.column("code"))
        held, about = rows.filter(has_term), rows.filter(pc.invert(has_term)).slice(0, 1)
        first = np.frombuffer(about.column("first")[0].as_py(), np.int32).astype(np.int64)
        lists = [np.cumsum(np.frombuffer(x, np.int32), dtype=np.int64) for x in held.column("positions").to_pylist()]
        shard = Shard(first, n_terms, np.asarray(held.column("code").combine_chunks()).astype(np.int64), lists)
        item, doc, exact, near = _search(mine, shard, slack, min_share)
        texts = about.column("doc_ids").combine_chunks().flatten()
        kind = out["item_id"].dataType
        return pa.table(
            [
                pa.array([ids[i] for i in item.tolist()], _arrow(kind)),
                pc.take(texts, pa.array(doc)),
                pa.array(mine.n_runs[item]),
                pa.array(exact),
                pa.array(near),
            ],
            names=out.names,
        )

    about = index.table.filter("term is null").select("shard", F.lit(None).cast("int").alias("code"), "positions", "doc_ids", "first")
    held = index.table.join(F.broadcast(terms), "term").select("shard", "code", "positions", "doc_ids", "first")
    return about.unionByName(held).groupBy("shard").applyInArrow(search, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    run: int = 5,
    min_share: float = 0.25,
    slack: int = 3,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Documents that contain at least ``min_share`` of an item's runs of ``run`` words, exactly or with gaps.

    Returns ``(item_id, doc_id, n_runs, n_exact, n_near, share, match_kind)``:
    the item's distinct runs of successive words, how many of them the text holds
    exactly, how many more in their order with at most ``slack`` words put in
    between, n_exact / n_runs, and whether the exact runs alone are enough
    (``exact``) or need the others (``near``). With ``slack`` 0 only exact runs
    are looked for. Words are maximal runs of ASCII letters and digits in any case.

    Null ids are left out; null and empty texts or passages, and passages
    shorter than a run, match nothing; either table may be empty. Whole texts
    are searched, whatever their length. Rows repeated in either table give one
    pair; where an id stands on several rows, a pair is reported with its best
    row. What is shuffled is the postings of the items' terms, by shard. Items
    are read in blocks of at most ``query_bytes``, one pass over their terms'
    postings for each. To search for several sets of items, use `build_index`
    once and `search_index` for each.
    """
    index = build_index(docs, doc_id=doc_id, text=text)
    return search_index(
        index, items, item_id=item_id, passage=passage, doc_id=doc_id, run=run, min_share=min_share, slack=slack, query_bytes=query_bytes
    )


def leaked_items(pairs: DataFrame, item_id: str = "item_id") -> DataFrame:
    """The leaked items, each with the number of documents that hold it and the largest share."""
    return pairs.groupBy(item_id).agg(F.count(F.lit(1)).alias("n_docs"), F.max("share").alias("max_share"))
