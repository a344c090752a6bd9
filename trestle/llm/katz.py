"""Katz backoff language model: Good-Turing discounts, exactly normalised, in partitioned tables.

Tokens are the words of a text and one end mark.  The model is
``P(w | h) = d(c) c / T(h)`` for a bigram seen c times after a history seen T(h)
times, ``alpha(h) P(w)`` for an unseen one, and ``P(w)`` after an unseen
history; ``P(w)`` is Good-Turing discounted too, its free mass belongs to all
unknown words together.  ``d`` are Katz's discounts for counts up to 5 and 1
above; ``alpha(h)`` gives the free mass of h to the words not seen after it, so
the probabilities after each history add up to 1.  Where nothing is discounted
after a history, one is added to T(h).

Words are known by a 64-bit hash (``xxh64``); pairs are never hashed together.

On Spark everything is counted over all documents in partitions of the key
space, in packed arrays: one row per block of documents and partition instead
of one per n-gram.

1. Scan: blocks of documents send their distinct words to the words' partitions
   and their distinct bigrams to the bigrams' partitions.  Each partition merges
   its counts.  Unigram and bigram partitions are stored tables; bigram
   partitions also ask the unigram partitions for the words they need.
2. Answer: unigram partitions answer with counts.  Global counts of counts are
   a sum over partitions, and give the discounts.
3. Evaluate: a second scan sends the documents' tokens to the bigram partitions,
   which look up c(h, w), T(h) and c(w), back off where needed, and return the
   documents' partial sums as one packed row per block; a block adds them up.

With an ``order`` above 2 the recursion goes on: ``P(w | h)`` of a longer history
is discounted in the same way and backs off to the history without its first
word.  N-grams of each length are dealt by their whole history, so its total and
weight are found in one partition; partitions ask those of the next shorter
n-grams for the probabilities to back off to, and tokens go to the longest.

A history that is frequent enough to fill a partition by itself (found in a
sample of documents, which decides on balance only) is dealt over all partitions
by its following words; what its backoff weight needs from all of them (counts
of counts, the followers' unigram mass) is added up in between.

Defined results: null and empty texts are one end token; with no training
documents every token is unknown with probability 1 and the base score uses
N = V = 0; repeated rows count and are scored each; null ids are kept.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.llm.common import WORD, quoted, utf8, written

CUTOFF = 5  # counts above are not discounted
BLOCK_TOKENS = 2_000_000  # tokens that a task holds before it sends them
PART_TOKENS = 4_000_000  # tokens per partition of the key space
_START = np.uint64(0x9E3779B97F4A7C15)  # history of a first token
_END = np.uint64(0xC2B2AE3D27D4EB4F)  # the end mark
_ROWS = "kind string, part int, src int, blob binary, heavy int, stats array<long>, value double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, the bytes of equal weight together."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, data in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending hashes: shorter numbers, so they pack better."""
    return np.diff(ascending, prepend=np.uint64(0))


def _hashes(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _spread(h: np.ndarray) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Layout:
    """Where words and bigrams live."""

    parts: int
    heavy: np.ndarray  # ascending hashes of the histories that are dealt by their followers

    def word_part(self, words: np.ndarray) -> np.ndarray:
        return (_spread(words) % np.uint64(self.parts)).astype(np.int64)

    def bigram_part(self, hashes: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Parts of bigrams that are given as places in ``hashes``."""
        part = self.word_part(hashes).astype(np.int32)
        out = part[h]
        dealt = np.isin(hashes, self.heavy)[h]
        out[dealt] = (out[dealt] + part[w[dealt]]) % self.parts
        return out

    def gram_part(self, hashes: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """Parts of n-grams: of bigrams as above, of longer ones by the whole history."""
        if len(columns) == 2:
            return self.bigram_part(hashes, *columns)
        mixed = np.zeros(len(columns[0]), np.uint64)
        for c in columns[:-1]:
            mixed = _spread(mixed * np.uint64(0x94D049BB133111EB) + hashes[c])
        return (mixed % np.uint64(self.parts)).astype(np.int32)


@dataclass(frozen=True)
class Discounts:
    """What the whole corpus says: discounts per count, and the unigram totals."""

    tokens: int  # N
    types: int  # V
    one: np.ndarray  # d(0..CUTOFF + 1) of unigrams; the last one is 1
    two: np.ndarray  # of bigrams
    free: float  # unigram mass of all unknown words together
    total: float  # denominator of the unigrams
    longer: tuple[np.ndarray, ...] = ()  # of trigrams and so on

    @classmethod
    def of(cls, tokens: int, types: int, n1: list[int], n2: list[int], *more: list[int]) -> Discounts:
        one, two = good_turing(n1), good_turing(n2)
        kept = tokens - sum((1 - one[r]) * r * n1[r - 1] for r in range(1, CUTOFF + 1))
        total = tokens + 1.0 if kept >= tokens else float(tokens)
        return cls(tokens, types, one, two, 1.0 - kept / total, total, tuple(good_turing(n) for n in more))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by count; 0 counts get the mass of all unknown words."""
        return np.where(counts > 0, self.one[np.minimum(counts, CUTOFF + 1)] * counts / self.total, self.free)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def good_turing(n: list[int]) -> np.ndarray:
    """Katz's discounts from the counts of counts n[0] (ones) to n[CUTOFF]; 1 where they say nothing sound."""
    d = np.ones(CUTOFF + 2)
    if n[0] <= 0:
        return d
    common = (CUTOFF + 1) * n[CUTOFF] / n[0]
    for r in range(1, CUTOFF + 1):
        if n[r - 1] > 0 and common < 1:
            value = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
            if 0 < value <= 1:
                d[r] = value
    return d


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].astype(np.int64)


class Blocks:
    """Collects documents until a block of tokens is full; a block is tokens, histories and documents."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, text: bytes | None, doc: tuple) -> bool:
        words = WORD.findall(text.lower()) if text else []
        ids = self.ids
        own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
        self.tokens.append(own)
        self.docs.append(doc)
        self.size += len(own) + 1
        return self.size >= BLOCK_TOKENS

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash per word id, history ids, word ids, document numbers); start and end mark are the last two ids."""
        n = len(self.ids)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in self.ids), np.uint64, n)
        hashes = np.concatenate((hashes, np.array([_START, _END], np.uint64)))
        lengths = np.array([len(t) for t in self.tokens])
        start, end = np.array([n], np.int32), np.array([n + 1], np.int32)
        w = np.concatenate([x for t in self.tokens for x in (t, end)])
        h = np.concatenate([x for t in self.tokens for x in (start, t)])
        return hashes, h, w, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)


def _local(hashes: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's own table of word hashes (ascending), and its histories and words as places in it."""
    used = np.unique(np.concatenate((h, w)))
    order = np.argsort(hashes[used])
    place = np.empty(len(used), np.uint32)
    place[order] = np.arange(len(used), dtype=np.uint32)
    at = np.zeros(int(used[-1]) + 1, np.uint32) if len(used) else np.zeros(0, np.uint32)
    at[used] = place
    return hashes[used][order], at[h], at[w]


def _histories(h: np.ndarray, doc: np.ndarray, start: int, order: int) -> list[np.ndarray]:
    """The last ``order - 1`` words before each token, the farthest first; the start mark stands in front of a text."""
    columns = [h]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    for _ in range(order - 2):
        before = np.roll(columns[0], 1)
        before[first] = start
        columns.insert(0, before)
    return columns


def _local_grams(hashes: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """As ``_local``, for any number of columns."""
    words, flat, _ = _local(hashes, np.concatenate(columns), columns[0][:0])
    return words, np.split(flat, len(columns))


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _tuples(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns in ascending order, and the sum of ``n`` of each."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.flatnonzero(_changes(columns))
    return [c[first] for c in columns], np.add.reduceat(n[order].astype(np.int64), first)


def _places(table: list[np.ndarray], asked: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of ``table`` and of ``asked`` (rows of it), in ascending order and equal for equal rows."""
    t, a = table[0].astype(np.int64), asked[0].astype(np.int64)
    for x, y in zip(table[1:], asked[1:], strict=True):
        keys = np.unique(t * size + x)
        t, a = np.searchsorted(keys, t * size + x), np.searchsorted(keys, a * size + y)
    return t, a


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    first = np.flatnonzero(np.concatenate(([True], ascending[1:] != ascending[:-1])))
    return ascending[first], np.diff(first, append=len(ascending))


def _row(kind: str, part: int, src: int = -1, blob: bytes = b"", heavy: int = -1, stats=(), value: float = 0.0) -> tuple:
    return kind, part, src, blob, heavy, list(stats), value


def _sent(kind: str, part: int, blob: bytes) -> pa.RecordBatch:
    arrays = [pa.array([kind]), pa.array([part], pa.int32()), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "part", "blob"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "src", "blob", "heavy", "stats", "value"])


def _groups(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of the parts that occur."""
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(parts + 1))
    for p in range(parts):
        if bounds[p] < bounds[p + 1]:
            yield p, order[bounds[p] : bounds[p + 1]]


# ------------------------------------------------------------ 1. counting


def _send_counts(layout: Layout, longest: int = 2):
    """Map side of the counting scan: rows of kind 'u' (words), 'b' (bigrams) and 'g3' (trigrams) and so on per block and part."""

    def rows_of(block: Blocks) -> Iterator[tuple]:
        hashes, h, w, doc = block.arrays()
        train = np.array([d[0] for d in block.docs], bool)[doc]
        counts = np.bincount(w[train], minlength=len(hashes))
        counts[-2] = int(np.count_nonzero(train & (h == len(hashes) - 2)))  # training documents, as count of the start mark
        seen = np.flatnonzero(counts)
        for p, at in _groups(layout.word_part(hashes[seen]), layout.parts):
            order = np.argsort(hashes[seen[at]])
            yield "u", p, pack(_steps(hashes[seen[at]][order]), counts[seen[at]][order].astype(np.uint32))
        for k in range(3, longest + 1):
            grams, n = _tuples([*_histories(h, doc, len(hashes) - 2, k), w], train)
            for p, at in _groups(layout.gram_part(hashes, grams), layout.parts):
                words, own = _local_grams(hashes, [c[at] for c in grams])
                yield f"g{k}", p, pack(_steps(words), *own, n[at].astype(np.uint32))
            del grams, n
        keys = (h.astype(np.int64) * len(hashes) + w) * 2 + train
        del h, w, doc, train
        keys.sort()
        first = np.flatnonzero(np.diff(keys >> 1, prepend=-1))
        n = np.add.reduceat(keys & 1, first)
        keys = keys[first] >> 1
        h, w = keys // len(hashes), keys % len(hashes)
        del keys
        for p, at in _groups(layout.bigram_part(hashes, h, w), layout.parts):
            words, hs, ws = _local(hashes, h[at], w[at])
            order = np.lexsort((ws, hs))
            steps = np.diff(hs[order].astype(np.int64), prepend=0).astype(np.uint32)
            yield "b", p, pack(_steps(words), steps, ws[order], n[at][order].astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Blocks()
        for b in batches:
            for text, train in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                if block.add(text, (train,)):
                    yield from _batches(rows_of(block))
                    block.clear()
        if block.docs:
            yield from _batches(rows_of(block))

    def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            yield _sent(*row)

    return run


def _merge_words(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [unpack(x) for x in blobs]
    words, back = np.unique(np.concatenate([_hashes(p[0]) for p in pairs]), return_inverse=True)
    counts = np.bincount(back, weights=np.concatenate([p[1] for p in pairs]).astype(float), minlength=len(words))
    return words, counts.astype(np.int64)


def _merge_bigrams(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, history places, word places, counts) of a part, ascending by history and word."""
    tables = [unpack(x) for x in blobs]
    words = np.unique(np.concatenate([_hashes(t[0]) for t in tables]))
    keys, counts = [], []
    for own, steps, ws, n in tables:
        to = np.searchsorted(words, _hashes(own))
        keys.append(to[np.cumsum(steps, dtype=np.int64)] * len(words) + to[ws])
        counts.append(n)
    keys, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate(counts).astype(float), minlength=len(keys)).astype(np.int64)
    return words, keys // len(words), keys % len(words), n


def _merge_grams(blobs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(word hashes, columns of word places, counts) of a part, ascending; n-grams that only held-out rows have count 0."""
    tables = [unpack(x) for x in blobs]
    words = np.unique(np.concatenate([_hashes(t[0]) for t in tables]))
    placed = [[np.searchsorted(words, _hashes(t[0]))[c] for c in t[1:-1]] for t in tables]
    columns = [np.concatenate(c) for c in zip(*placed, strict=True)]
    return words, *_tuples(columns, np.concatenate([t[-1] for t in tables]))


def _merge(layout: Layout):
    """Reduce side of the counting scan: stored partitions, counts of counts, requests, and sums of heavy histories."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, p = key
        if kind == "u":
            words, counts = _merge_words(list(pdf["blob"]))
            real = words != _START
            stats = [int(counts[real].sum()), int(real.sum()), *counts_of_counts(counts[real])]
            return _frame([_row("u", p, blob=pack(_steps(words), counts), stats=stats)])
        if kind != "b":
            words, grams, n = _merge_grams(list(pdf["blob"]))
            table = pack(_steps(words), *[c.astype(np.uint32) for c in grams], n)
            rows = [_row(kind, p, blob=table, stats=[0, 0, *counts_of_counts(n[n > 0])])]
            shorter, _ = _tuples(grams[1:], n)
            for q, at in _groups(layout.gram_part(words, shorter), layout.parts):
                own, columns = _local_grams(words, [c[at] for c in shorter])
                rows.append(_row(f"q{len(shorter)}", q, src=p, blob=pack(_steps(own), *columns)))
            return _frame(rows)
        words, h, w, n = _merge_bigrams(list(pdf["blob"]))
        seen = n > 0
        table = pack(_steps(words), np.diff(h[seen], prepend=0).astype(np.uint32), w[seen].astype(np.uint32), n[seen].astype(np.uint32))
        rows = [_row("b", p, blob=table, stats=[0, 0, *counts_of_counts(n[seen])])]
        of = np.searchsorted(layout.heavy, words[h])
        of = np.where((of < len(layout.heavy)) & np.isin(words[h], layout.heavy), of, -1)
        pairs = np.flatnonzero((of >= 0) & seen)
        for k in np.unique(of[pairs]):
            rows.append(_row("h", p, heavy=int(k), stats=counts_of_counts(n[pairs[of[pairs] == k]])))
        parts = layout.word_part(words)
        for q, at in _groups(parts, layout.parts):
            mine = pairs[parts[w[pairs]] == q]
            place = np.searchsorted(at, w[mine])  # _groups is stable: `at` ascends
            rows.append(_row("r", q, src=p, blob=pack(_steps(words[at]), of[mine].astype(np.uint32), place.astype(np.uint32))))
        return _frame(rows)

    return run


# ------------------------------------------------------------ 2. answers


def _answer(discounts: Discounts):
    """A unigram partition and the requests to it: counts for each request, mass for heavy histories."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for blob in pdf["blob"][pdf["kind"] == "u"]:
            words, counts = unpack(blob)
            words = _hashes(words)
        rows, mass = [], {}
        for r in pdf[pdf["kind"] == "r"].itertuples(index=False):
            asked, heavy, place = unpack(r.blob)
            found = _lookup(words, counts, _hashes(asked))
            rows.append(_row("c", int(r.src), src=int(key[0]), blob=pack(asked, found)))
            if len(heavy):
                p = discounts.unigram(found)[place]
                for k, v in enumerate(np.bincount(heavy, weights=p)):
                    if v:
                        mass[k] = mass.get(k, 0.0) + v
        rows += [_row("s", int(key[0]), heavy=k, value=float(v)) for k, v in mass.items()]
        return _frame(rows)

    return run


def _lookup(words: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    return np.where(words[at] == asked, counts[at], 0)


# ------------------------------------------------------------ 3. evaluation


def _by_document(columns: list[np.ndarray], doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, the number of documents of each, and these documents with counts."""
    order = np.lexsort((doc, *columns[::-1]))
    columns, doc = [c[order] for c in columns], doc[order]
    grams = _changes(columns)
    pairs = np.flatnonzero(grams | _changes([doc]))
    first = np.flatnonzero(grams)
    per = np.diff(np.searchsorted(pairs, first), append=len(pairs))
    return [c[first] for c in columns], per, doc[pairs], np.diff(pairs, append=len(doc))


def _send_tokens(layout: Layout, order: int = 2):
    """Map side of the scoring scan: per block and part, (history, word, document) with counts, and the documents."""

    def rows_of(block: Blocks) -> Iterator[pa.RecordBatch]:
        hashes, h, w, doc = block.arrays()
        rids = np.array([d[0] for d in block.docs], np.int64)
        names = pa.array([d[1] for d in block.docs], pa.int64())
        own = pack(rids, names.fill_null(0).to_numpy(), names.is_null().to_numpy(False), np.array([d[2] for d in block.docs], bool))
        yield _sent("d", int(rids[0]) % layout.parts, own)
        if order > 2:
            grams = [*_histories(h, doc, len(hashes) - 2, order), w]
            for p, at in _groups(layout.gram_part(hashes, grams), layout.parts):
                words, columns = _local_grams(hashes, [c[at] for c in grams])
                columns, per, d, n = _by_document(columns, doc[at])
                yield _sent("t", p, pack(_steps(words), *columns, *[x.astype(np.uint32) for x in (per, d, n)], rids[:1]))
            return
        for p, at in _groups(layout.bigram_part(hashes, h, w), layout.parts):
            words, hs, ws = _local(hashes, h[at], w[at])
            keys = (hs.astype(np.int64) * len(words) + ws) * len(rids) + doc[at]
            keys.sort()
            keys, n = _runs(keys)
            d = (keys % len(rids)).astype(np.uint32)
            bigrams, per = _runs(keys // len(rids))
            hs, ws = bigrams // len(words), (bigrams % len(words)).astype(np.uint32)
            blob = pack(_steps(words), np.diff(hs, prepend=0).astype(np.uint32), ws, per.astype(np.uint32), d, n.astype(np.uint32), rids[:1])
            yield _sent("t", p, blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Blocks()
        for b in batches:
            for text, *doc in zip(utf8(b.column(0)), *[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                if block.add(text, doc):
                    yield from rows_of(block)
                    block.clear()
        if block.docs:
            yield from rows_of(block)

    return run


class Partition:
    """A bigram partition with all it needs: the recursion's three cases per token."""

    def __init__(self, table: bytes | None, answers: list[bytes], layout: Layout, heavy: dict[int, tuple], discounts: Discounts) -> None:
        self.discounts = discounts
        pairs = [unpack(x) for x in answers]
        known = np.concatenate([_hashes(p[0]) for p in pairs]) if pairs else np.zeros(0, np.uint64)
        order = np.argsort(known)
        self.words = known[order]
        self.counts = (np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64))[order]
        size = len(self.words)
        self.p1 = discounts.unigram(self.counts)
        hs = ws = n = np.zeros(0, np.int64)
        if table is not None:
            own, steps, ws, n = unpack(table)
            to = np.searchsorted(self.words, _hashes(own))
            hs, ws, n = to[np.cumsum(steps, dtype=np.int64)], to[ws], n.astype(np.int64)
        self.keys = hs * max(1, size) + ws
        order = np.argsort(self.keys)
        self.keys, self.n = self.keys[order], n[order]
        # per history: discounted counts, and unigram mass of the words seen after it
        kept = np.bincount(hs, weights=discounts.two[np.minimum(n, CUTOFF + 1)] * n, minlength=size)
        mass = np.bincount(hs, weights=self.p1[ws] if size else None, minlength=size)
        total = self.counts.astype(float)
        for k, (sums, seen_mass) in heavy.items():
            at = int(np.searchsorted(self.words, layout.heavy[k]))
            if at < size and self.words[at] == layout.heavy[k]:
                kept[at] = total[at] - sum((1 - discounts.two[r]) * r * sums[r - 1] for r in range(1, CUTOFF + 1))
                mass[at] = seen_mass
        full = kept >= total - 1e-9 * np.maximum(1.0, total)
        self.total = np.where(full, total + 1, total)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = (1 - kept / self.total) / np.maximum(1 - mass, 1e-300)
        self.alpha = np.where(total > 0, alpha, 1.0)

    def log_probs(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w | h) for places of ``words``."""
        return np.log10(self.probs(h, w))

    def probs(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        keys = h * max(1, len(self.words)) + w
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            n = np.where(self.keys[at] == keys, self.n[at], 0)
        else:
            n = np.zeros(len(keys), np.int64)
        seen = self.discounts.two[np.minimum(n, CUTOFF + 1)] * n / self.total[h]
        return np.where(n > 0, seen, self.alpha[h] * self.p1[w])

    def answer(self, words: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(P(w | h), training count of w) of bigrams that are given as places in ``words``."""
        to = np.searchsorted(self.words, words)
        h, w = (to[c] for c in columns)
        return self.probs(h, w), self.counts[w]


class Longer:
    """A partition of n-grams of more than two words, with the probabilities of the shorter ones that they back off to."""

    def __init__(self, table: bytes, answers: list[bytes], discount: np.ndarray) -> None:
        steps, *columns, n = unpack(table)
        self.words, self.columns = _hashes(steps), columns
        size = len(self.words)
        found: list[list[np.ndarray]] = [[] for _ in range(len(columns) + 1)]
        for blob in answers:
            own, *shorter, p, count = unpack(blob)
            to = np.searchsorted(self.words, _hashes(own))
            for out, x in zip(found, (*[to[c] for c in shorter], p, count), strict=True):
                out.append(x)
        *shorter, p, count = (np.concatenate(x) for x in found)
        there, asked = _places(shorter, columns[1:], size)
        order = np.argsort(there)
        at = order[np.searchsorted(there[order], asked)]
        lower, self.counts = p[at], count[at]
        h, _ = _places(columns[:-1], columns[:-1], size)
        total = np.bincount(h, weights=n)
        own = discount[np.minimum(n, CUTOFF + 1)] * n
        kept, mass = np.bincount(h, weights=own), np.bincount(h, weights=np.where(n > 0, lower, 0.0))
        full = kept >= total - 1e-9 * np.maximum(1.0, total)
        divisor = np.where(full, total + 1, total)
        alpha = np.where(total > 0, (1 - kept / divisor) / np.maximum(1 - mass, 1e-300), 1.0)
        self.p = np.where(n > 0, own / divisor[h], alpha[h] * lower)

    def answer(self, words: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(P(w | h), training count of w) of n-grams of the table that are given as places in ``words``."""
        to = np.searchsorted(self.words, words)
        _, at = _places(self.columns, [to[c] for c in columns], len(self.words))
        return self.p[at], self.counts[at]


def _opened(pdf: pd.DataFrame, k: int, layout: Layout, heavy: dict[int, tuple], discounts: Discounts) -> Partition | Longer | None:
    """The part of n-grams of ``k`` words that a group of rows holds."""
    tables = list(pdf["blob"][pdf["kind"] == ("b" if k == 2 else f"g{k}")])
    answers = list(pdf["blob"][pdf["kind"] == ("c" if k == 2 else f"a{k}")])
    if k == 2:
        return Partition(tables[0] if tables else None, answers, layout, heavy, discounts)
    return Longer(tables[0], answers, discounts.longer[k - 3]) if tables else None


def _give(k: int, layout: Layout, heavy: dict[int, tuple], discounts: Discounts):
    """Parts of n-grams of ``k`` words answer those of one word more."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = _opened(pdf, k, layout, heavy, discounts)
        rows = []
        for r in pdf[pdf["kind"] == f"q{k}"].itertuples(index=False):
            steps, *columns = unpack(r.blob)
            rows.append(_row(f"a{k + 1}", int(r.src), src=int(key[0]), blob=pack(steps, *columns, *part.answer(_hashes(steps), columns))))
        return _frame(rows)

    return run


_PARTIAL = "block long, kind string, blob binary"
_SUMS = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _evaluate(layout: Layout, heavy: dict[int, tuple], discounts: Discounts, order: int = 2):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = _opened(pdf, order, layout, heavy, discounts)
        out = []
        for blob in pdf["blob"][pdf["kind"] == "d"]:  # a block's documents go on to its sums
            out.append((int(unpack(blob)[0][0]), "d", blob))
        for blob in pdf["blob"][pdf["kind"] == "t"]:
            own, *columns, per, doc, n, first = unpack(blob)
            if order == 2:
                columns[0] = np.cumsum(columns[0], dtype=np.int64)
            p, known = part.answer(_hashes(own), columns)
            each = np.repeat(np.arange(len(p)), per)
            log_p, known, base = np.log10(p)[each], known[each], discounts.base(known)[each]
            here = np.flatnonzero(np.bincount(doc))
            sums = [np.bincount(doc, weights=x)[here] for x in (n, n * (known > 0), n * base, n * log_p)]
            counts = [x.astype(np.uint32) for x in sums[:2]]
            out.append((int(first[0]), "p", pack(here.astype(np.uint32), *counts, *sums[2:])))
        return pd.DataFrame(out, columns=["block", "kind", "blob"])

    return run


def _add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of a block's documents over all partitions."""
    _, ids, null, train = unpack(next(iter(pdf["blob"][pdf["kind"] == "d"])))
    sums = np.zeros((4, len(ids)))
    for blob in pdf["blob"][pdf["kind"] == "p"]:
        here, *values = unpack(blob)
        for total, x in zip(sums, values, strict=True):
            total[here] += x
    named = pd.Series(ids, dtype="Int64").mask(null)
    n, known = sums[:2].astype(np.int64)
    return pd.DataFrame({"id": named, "train": train, "n_tokens": n, "n_known": known, "base_score": sums[2], "score": sums[3]})


# ------------------------------------------------------------ the operator


def heavy_histories(docs: DataFrame, text_col: str, parts: int, rows: int, sample_docs: int = 2000, most: int = 4096) -> np.ndarray:
    """Hashes of the words (and the start mark) that a sample shows to exceed a quarter of a partition."""
    share = min(1.0, sample_docs / max(1, rows))
    sample = docs.where(F.rand(11) < share).select(
        F.translate(F.coalesce(F.col(quoted(text_col)), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("t")
    )
    words = sample.select(F.explode(F.split("t", r"[\x20\x09-\x0D]+")).alias("w"))
    counts = words.groupBy("w").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    if not total:
        return np.zeros(0, np.uint64)
    top = counts.where(F.col("count") > total / (4 * parts)).orderBy(F.desc("count"), "w").limit(most).collect()
    found = [xxhash.xxh64_intdigest(r["w"].encode()) for r in top if r["w"]]
    return np.unique(np.array([*found, int(_START)], np.uint64))


def score(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART_TOKENS, order: int = 2
) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) per row; learned from the rows where ``train``.

    ``order`` is the length of the longest n-grams, 2 at least.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    rows = docs.select(
        F.col(quoted(id_col)).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(quoted(text_col)).alias("text")
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, math.ceil(((size["bytes"] or 0) / 6 + size["n"]) / part_tokens))
    layout = Layout(parts, heavy_histories(rows, "text", parts, size["n"]) if parts > 1 else np.zeros(0, np.uint64))

    sent = rows.select("text", "train").mapInArrow(_send_counts(layout, order), "kind string, part int, blob binary")
    model = written(sent.groupBy("kind", "part").applyInPandas(_merge(layout), _ROWS))
    sums = {
        r["kind"]: [r[f"s{i}"] or 0 for i in range(CUTOFF + 3)]
        for r in model.where("kind in ('u', 'b') or kind like 'g%'")
        .groupBy("kind")
        .agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(CUTOFF + 3)])
        .collect()
    }
    one, two = sums.get("u", [0] * (CUTOFF + 3)), sums.get("b", [0] * (CUTOFF + 3))
    more = [sums.get(f"g{k}", [0] * (CUTOFF + 3))[2:] for k in range(3, order + 1)]
    discounts = Discounts.of(one[0], one[1], one[2:], two[2:], *more)
    answers = written(model.where("kind in ('u', 'r')").select("kind", "part", "src", "blob").groupBy("part").applyInPandas(_answer(discounts), _ROWS))
    # at most one row per heavy history: a bounded list
    of_counts = model.where("kind = 'h'").groupBy("heavy").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"n{i}") for i in range(CUTOFF + 1)])
    of_mass = answers.where("kind = 's'").groupBy("heavy").agg(F.sum("value").alias("mass"))
    heavy = {r["heavy"]: ([r[f"n{i}"] for i in range(CUTOFF + 1)], r["mass"]) for r in of_counts.join(of_mass, "heavy").collect()}

    # numbers tell the rows of one scan apart; they go no further than its own sums
    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    tokens = numbered.select("text", "rid", F.col("id").cast("long"), "train").mapInArrow(_send_tokens(layout, order), "kind string, part int, blob binary")
    stored = model.where("kind = 'b'").select("kind", "part", "blob").union(answers.where("kind = 'c'").select("kind", "part", "blob"))
    for k in range(2, order):
        asked = model.where(F.col("kind") == f"q{k}").select("kind", "part", "src", "blob")
        there = stored.select("kind", "part", F.lit(-1).alias("src"), "blob")
        given = written(there.union(asked).groupBy("part").applyInPandas(_give(k, layout, heavy, discounts), _ROWS))
        stored = model.where(F.col("kind") == f"g{k + 1}").select("kind", "part", "blob").union(given.select("kind", "part", "blob"))
    partial = tokens.union(stored).groupBy("part").applyInPandas(_evaluate(layout, heavy, discounts, order), _PARTIAL)
    sums = partial.groupBy("block").applyInPandas(_add_up, _SUMS)
    return sums.select("id", "train", "n_tokens", "n_known", F.lit(discounts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
