"""Ranked lexical search by hashed max-sketches.

The index has one row per document with terms: its length ``n``, its exact
postings (64-bit term hashes in ascending order and their counts), and a sketch.
The sketch is an array of 8-bit cells, a power of two of them and at least
``CELLS`` per distinct term; a term belongs to two cells, and a cell holds the
largest count of its terms.  At a given length a term's impact grows with its
count, so the cell's impact is the largest impact of its terms, whatever N and L
become as documents are added: the coordinatewise maximum of the impacts.

A search takes queries in blocks.  A task looks all terms of a block up in the
sketches of a batch of documents at once: the lesser of a term's two cells gives
an impact that no document can exceed, their weighted sums give an upper bound
for every query and document.  Per query, documents are rescored exactly from the
postings in the order of descending bounds, until the bound is below the k-th
best exact score that the task knows.  Tasks return k rows per query; a ranked
window keeps the k best of all.  Passes are narrow: texts are read once to make
the index, which is written, and nothing but k rows per query and task is
shuffled, so hot sources or groups of copies add no load to any one task.

Bounds: a block of queries holds about ``block_bytes`` of text (a longer query is
a block alone) and is all that the driver and the broadcast hold at a time; any
number of queries goes through in blocks.  A task holds one Arrow batch, and a
matrix of at most ``MATRIX`` numbers.

Terms are known by their 64-bit hash: a false match between one of a million
query terms and one of a billion corpus terms has a probability below 0.0001.

Defined results: a null text, or one without terms, is not in the index and
doesn't count in N; a query without terms has no rows; every row is a document of
its own, also with a repeated id or text; ids are cast to long, null ids come after
all others among equal scores; every query row is ranked by itself.  Very long
texts are read in pieces and indexed whole.  An empty table on either side gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trestle.llm.common import quoted, utf8, written

#: Maximal runs of letters, digits and all beyond ASCII (texts are lower-cased first).
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Cells per distinct term, at least.
CELLS = 4
#: A cell that reads this holds a count of this or more.
FULL = 255
#: Numbers of a block's matrix of bounds (documents times terms of all its queries).
MATRIX = 1 << 20
#: Texts are cut into pieces of about so many bytes while their terms are counted.
PIECE = 1 << 20
#: No impact reaches this: (10**9 * tf) div (1000 * tf + 8 * m) with m above 0.
MOST = 1_000_000
INDEX = "id long, n long, terms binary, counts binary, sketch binary"
_NO_ID = 1 << 63


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs in the whole text."""
    found: Counter = Counter()
    start, text = 0, text or b""
    while start < len(text):
        end = min(len(text), start + PIECE)
        if end < len(text) and (cut := TERM.match(text, end - 1)):
            end = cut.end()  # a term is never cut
        found.update(TERM.findall(text[start:end].lower()))
        start = end
    return found


def hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64)


def cells(h: np.ndarray, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each term in a sketch of ``width`` cells."""
    mask = np.asarray(width).astype(np.uint64) - np.uint64(1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def impacts(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n: int, docs: int, total: int) -> int:
    return 100 - 90 + 90 * n * docs // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _indexed(ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    rows, n, terms, tfs = [], [], [], []
    for i, text in enumerate(texts):
        if found := term_counts(text):
            h = hashes(found)
            order = np.argsort(h)
            tf = np.fromiter(found.values(), np.int64, len(found))
            rows.append(i)
            n.append(int(tf.sum()))
            terms.append(h[order])
            tfs.append(tf[order])
    # all sketches of the batch in one array
    size = np.array([len(h) for h in terms], np.int64)
    width = 1 << np.ceil(np.log2(np.maximum(size * CELLS, 8))).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(width)))
    folded = np.zeros(start[-1], np.uint8)
    if rows:
        level = np.minimum(np.concatenate(tfs), FULL).astype(np.uint8)
        for cell in cells(np.concatenate(terms), np.repeat(width, size)):
            np.maximum.at(folded, cell + np.repeat(start[:-1], size), level)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(rows, pa.int64())),
            pa.array(n, pa.int64()),
            pa.array([h.tobytes() for h in terms], pa.binary()),
            pa.array([t.astype(np.uint32).tobytes() for t in tfs], pa.binary()),
            pa.array([folded[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary()),
        ],
        names=["id", "n", "terms", "counts", "sketch"],
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of ``docs``: (id, n, terms, counts, sketch), a row per document that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _indexed(b.column(0), utf8(b.column(1)))

    source = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return written(source.mapInArrow(run, INDEX))


class Block:
    """Queries as arrays: sorted hashes of all their terms, and the places of each query's terms among them."""

    def __init__(self, queries: list[tuple[int, bytes | None]]) -> None:
        own = [(row, np.unique(hashes(found))) for row, text in queries if (found := term_counts(text))]
        self.rows = [row for row, _ in own]
        self.hashes = np.unique(np.concatenate([h for _, h in own])) if own else np.zeros(0, np.uint64)
        places = [np.searchsorted(self.hashes, h) for _, h in own]
        self.flat = np.concatenate(places) if own else np.zeros(0, np.int64)
        self.starts = np.cumsum([0, *[len(p) for p in places]])
        self.weights = np.zeros(len(self.hashes), np.int64)

    def weigh(self, docs: int, df: dict[int, int]) -> None:
        """Weights from document counts by place; a term of no document matches nothing."""
        self.weights = np.array([weight(docs, df[i]) if i in df else 0 for i in range(len(self.hashes))], np.int64)


def _frequencies(index: DataFrame, shared) -> dict[int, int]:
    """How many documents hold each term of the block, by its place (as many numbers as the block has terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value.hashes
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                h = np.frombuffer(blob, np.uint64)
                at = np.searchsorted(asked, h)
                at[at == len(asked)] = 0
                total[at[asked[at] == h]] += 1  # terms of a document are distinct
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["place", "df"])

    counted = index.select("terms").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
    return {r["place"]: r["df"] for r in counted.collect()}


class Searcher:
    """The best k documents of each query of a block among the documents of one task."""

    def __init__(self, block: Block, docs: int, total: int, k: int) -> None:
        self.block, self.docs, self.total, self.k = block, docs, total, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in block.rows]  # heaps of (score, minus id)
        self.least = np.ones(len(block.rows), np.int64)  # bounds below this can't enter
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.rescored = 0

    def bounds(self, sketches: list[bytes], norms: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores: documents by queries."""
        block, top = self.block, np.empty((len(sketches), len(self.block.hashes)), np.uint8)
        for i, blob in enumerate(sketches):
            sketch = np.frombuffer(blob, np.uint8)
            if len(sketch) not in self.at:
                self.at[len(sketch)] = cells(block.hashes, len(sketch))
            one, two = self.at[len(sketch)]
            np.minimum(sketch[one], sketch[two], out=top[i])
        bound = np.zeros(top.shape, np.int64)
        doc, term = np.nonzero(top)
        tf = top[doc, term].astype(np.int64)
        bound[doc, term] = np.where(tf == FULL, MOST, impacts(tf, norms[doc])) * block.weights[term]
        return np.add.reduceat(bound[:, block.flat], block.starts[:-1], axis=1)

    def exact(self, q: int, terms: np.ndarray, tfs: np.ndarray, norm: int) -> int:
        block = self.block
        own = block.flat[block.starts[q] : block.starts[q + 1]]
        asked = block.hashes[own]
        at = np.searchsorted(terms, asked)
        at[at == len(terms)] = 0
        held = terms[at] == asked
        self.rescored += 1
        return int((block.weights[own[held]] * impacts(tfs[at[held]].astype(np.int64), norm)).sum())

    def add(self, ids: list[int | None], n: list[int], terms: list[bytes], counts: list[bytes], sketches: list[bytes]) -> None:
        if not self.block.rows:
            return
        step = max(1, min(256, MATRIX // max(1, len(self.block.flat))))
        for lo in range(0, len(ids), step):
            self._add(*(x[lo : lo + step] for x in (ids, n, terms, counts, sketches)))

    def _add(self, ids: list, n: list, terms: list, counts: list, sketches: list) -> None:
        norms = np.array([length_norm(x, self.docs, self.total) for x in n], np.int64)
        bound = self.bounds(sketches, norms)
        for q in np.flatnonzero((bound >= self.least).any(axis=0)).tolist():
            heap = self.best[q]
            order = np.argsort(-bound[:, q], kind="stable")
            for d in order.tolist():
                if bound[d, q] < self.least[q]:
                    break  # nor can any document after it
                key = -(_NO_ID if ids[d] is None else ids[d])
                if len(heap) == self.k and (int(bound[d, q]), key) <= heap[0]:
                    continue
                score = self.exact(q, np.frombuffer(terms[d], np.uint64), np.frombuffer(counts[d], np.uint32), int(norms[d]))
                if score > 0 and len(heap) < self.k:
                    heapq.heappush(heap, (score, key))
                elif score > 0:
                    heapq.heappushpop(heap, (score, key))
                if len(heap) == self.k:
                    self.least[q] = heap[0][0]

    def results(self) -> pa.RecordBatch:
        found = [(row, -key, score) for row, heap in zip(self.block.rows, self.best, strict=True) for score, key in heap]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([None if x[1] == _NO_ID else x[1] for x in found], pa.int64()),
                pa.array([x[2] for x in found], pa.int64()),
            ],
            names=["row", "id", "score"],
        )


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_col: str = "text", block_bytes: int = 256 << 10) -> DataFrame:
    """``queries`` without their text, with ``rank``, ``doc_id`` and ``score``: a row for each of the k best documents.

    Columns of ``queries`` named like an output column are replaced.
    """
    spark = index.sparkSession
    kept = [c for c in queries.columns if c not in (query_col, "rank", "doc_id", "score")]
    asked = written(
        queries.select(
            F.monotonically_increasing_id().alias("__row"),
            F.col(quoted(query_col)).cast("string").alias("__text"),
            *[F.col(quoted(c)).alias(f"__q{i}") for i, c in enumerate(kept)],
        )
    )
    size = asked.agg(F.sum(F.octet_length("__text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()

    def one(part: int) -> DataFrame | None:
        mine = asked.where(F.pmod(F.xxhash64("__row"), F.lit(blocks)) == part).select("__row", F.col("__text").cast("binary"))
        block = Block([(r[0], None if r[1] is None else bytes(r[1])) for r in mine.collect()])
        if not block.rows or not docs:
            return None
        block.weigh(docs, _frequencies(index, spark.sparkContext.broadcast(block)))
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = Searcher(shared.value, docs, total, k)
            for b in batches:
                task.add(*[c.to_pylist() for c in b.columns])
            yield task.results()

        return index.mapInArrow(run, "row long, id long, score long")

    parts = [x for i in range(blocks) if (x := one(i)) is not None]
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], "row long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked, best["row"] == asked["__row"]).select(
        *[F.col(f"__q{i}").alias(c) for i, c in enumerate(kept)], "rank", F.col("id").alias("doc_id"), "score"
    )


def brute_force(docs: list[tuple[int, str | None]], queries: list[tuple[int, str | None]], k: int = 10) -> list[tuple[int, int, int, int]]:
    """(item, rank, doc, score) by the definition, for distinct ids; for tests."""
    tf = {i: term_counts((t or "").encode()) for i, t in docs}
    tf = {i: c for i, c in tf.items() if c}
    total = sum(sum(c.values()) for c in tf.values())
    df = Counter(t for c in tf.values() for t in c)
    out = []
    for item, text in queries:
        terms = set(term_counts((text or "").encode()))
        scores = []
        for i, c in tf.items():
            m = length_norm(sum(c.values()), len(tf), total)
            score = sum(weight(len(tf), df[t]) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out
