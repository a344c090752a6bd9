"""SimHash near-dedup by a self-join of the fingerprints' binary trie.

Each document gets a 64-bit SimHash of its word shingles.  Equal fingerprints
are one trie leaf, so a group of copies counts once.  The join walks pairs of
trie nodes together, adds up the bits in which their paths differ, and drops a
pair as soon as more than ``max_bits`` differ.

On Spark the first ``p`` levels of the walk are a join: every fingerprint goes
to the pairs of p-bit prefixes that its own prefix forms within the error
budget, and each pair of prefixes is one task's group, where the walk goes on
over sorted arrays (a node is a range).  p grows with the number of distinct
fingerprints such that a prefix holds about ``leaf_prints`` of them.  Inside a
group the frontier is cut into blocks of at most ``_BLOCK`` node pairs, which
are walked depth first, and of
the links found only a spanning forest leaves the task: all links count, but a
dense cluster doesn't write all its pairs.  Components are found by label
propagation with pointer jumping over the forests.

Why one hot group doesn't land in one task: copies share a fingerprint and are
pre-aggregated; near copies differ from each other in shingles that only move
the few bits close to a tie, so they have few distinct fingerprints.

Defined results: null and empty texts have fingerprint 0 and link like any
other; null ids are ignored as class ids (a class of null ids only has a null
id) but their rows stay; repeated rows are in the same class; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.llm.common import WORD, quoted, utf8, written

_BLOCK = 1 << 16  # node pairs walked at a time: what bounds a task's memory, about 100 MB with their leaves
_EXPAND = 32  # node pairs with at most so many pairs of leaves are compared leaf by leaf
_SHINGLES = 1 << 16  # shingles hashed at a time


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash over the XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _SHINGLES):
        stop = min(n, start + _SHINGLES)
        grams = zip(*[words[start + k : stop + k] for k in range(size)], strict=True)
        h = np.fromiter((digest(b" ".join(g), 42) for g in grams), np.uint64, stop - start)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, *others: Column) -> DataFrame:
    """(id, print): the fingerprint of each row as a signed long; ``others`` are further columns of longs."""
    names = ["id", *[f"key{i}" for i in range(len(others))], "print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([simhash(t, shingle) for t in utf8(b.columns[-1])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints)], names=names)

    rows = docs.select(F.col(quoted(id_col)).cast("long"), *others, F.col(quoted(text_col)))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


class _Labels:
    """Connected components of array places, fed with blocks of links."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.of[a], self.of[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            low = np.minimum(la, lb)
            np.minimum.at(self.of, la, low)
            np.minimum.at(self.of, lb, low)
            while (flat := self.of[self.of]).tobytes() != self.of.tobytes():
                self.of = flat


def _ranges(lo: np.ndarray, size: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges paired with counts: the pair's number and the offset of each of size * other combinations."""
    total = size * other
    which = np.repeat(np.arange(len(lo), dtype=np.int32), total)
    return which, np.arange(total.sum(), dtype=np.int32) - np.repeat(np.cumsum(total, dtype=np.int32) - total, total)


def walk(prints: np.ndarray, left: tuple[int, int], right: tuple[int, int], depth: int, budget: int, max_bits: int, link) -> int:
    """Walk two nodes (ranges of the ascending ``prints`` that share ``depth`` bits each) together.

    Calls ``link(a, b)`` with the places of linked leaves; returns the number of node pairs looked at.
    """
    start = [np.array([x], np.int32) for x in (*left, *right)] + [np.array([budget], np.int8)]
    stack, visited = [(depth, start)], 0
    while stack:
        depth, (alo, ahi, blo, bhi, left_over) = stack.pop()
        visited += len(alo)
        na, nb = (ahi - alo).astype(np.int64), (bhi - blo).astype(np.int64)
        small = (na * nb <= _EXPAND) | (depth >= 64)
        if small.any():
            which, at = _ranges(alo[small], na[small], nb[small])
            a, b = alo[small][which] + at // nb[small][which], blo[small][which] + at % nb[small][which]
            near = (a < b) & (np.bitwise_count(prints[a] ^ prints[b]) <= max_bits)
            link(a[near], b[near])
            alo, ahi, blo, bhi, left_over = (x[~small] for x in (alo, ahi, blo, bhi, left_over))
        if not len(alo):
            continue
        bit = np.uint64(1 << (63 - depth))
        path = ~np.uint64((1 << (64 - depth)) - 1)
        amid = np.searchsorted(prints, (prints[alo] & path) | bit).astype(np.int32)
        bmid = np.searchsorted(prints, (prints[blo] & path) | bit).astype(np.int32)
        own = alo == blo  # a node with itself: (0, 1) and (1, 0) are the same pair
        children = []
        for a0, a1, b0, b1, cost, keep in (
            (alo, amid, blo, bmid, 0, None),
            (amid, ahi, bmid, bhi, 0, None),
            (alo, amid, bmid, bhi, 1, None),
            (amid, ahi, blo, bmid, 1, ~own),
        ):
            ok = (a0 < a1) & (b0 < b1) & (left_over >= cost)
            if keep is not None:
                ok &= keep
            children.append([a0[ok], a1[ok], b0[ok], b1[ok], left_over[ok] - np.int8(cost)])
        parts = [np.concatenate(x) for x in zip(*children, strict=True)]
        for i in range(0, len(parts[0]), _BLOCK):
            stack.append((depth + 1, [x[i : i + _BLOCK] for x in parts]))
    return visited


def forest(prints: np.ndarray, prefix_bits: int, low: int, high: int, max_bits: int) -> np.ndarray:
    """Spanning forest (pairs of prints) of the links between the prefixes ``low`` and ``high``, or inside one."""
    labels = _Labels(len(prints))
    n = len(prints)
    if low == high:
        walk(prints, (0, n), (0, n), prefix_bits, max_bits, max_bits, labels.link)
    else:
        cut = int(np.searchsorted(prints, np.uint64(high << (64 - prefix_bits))))
        budget = max_bits - (low ^ high).bit_count()
        walk(prints, (0, cut), (cut, n), prefix_bits, budget, max_bits, labels.link)
    child = np.flatnonzero(labels.of != np.arange(n))
    return np.stack([prints[child], prints[labels.of[child]]], 1)


def links(prints: DataFrame, count: int, max_bits: int = 3, leaf_prints: int = 1 << 17, min_bits: int = 4) -> DataFrame:
    """(a, b): spanning forests of the links between the distinct ``print`` values of ``prints``."""
    p = max(min_bits, math.ceil(math.log2(max(1, count) / leaf_prints)))
    masks = [sum(1 << i for i in c) for k in range(min(max_bits, p) + 1) for c in combinations(range(p), k)]
    own = F.shiftrightunsigned("print", 64 - p).cast("int")
    dealt = prints.select("print", own.alias("own"), F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    other = F.col("own").bitwiseXOR(F.col("mask"))
    pairs = dealt.select("print", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own_prints = np.sort(pdf["print"].to_numpy().view(np.uint64))
        found = forest(own_prints, p, int(key[0]), int(key[1]), max_bits).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return pairs.groupBy("low", "high").applyInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for the nodes that have an edge.

    Each round takes the least label among the neighbours and then the label's
    label; it is written, so a lost executor costs one round at most.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("least", "label")).alias("label")
        )
        lower = written(lower)
        jump = lower.select(F.col("node").alias("via"), F.col("label").alias("further"))
        told = lower.select(F.col("label").alias("of")).distinct().join(jump, F.col("of") == F.col("via")).drop("via")
        after = _by_label(lower, told).select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        after = written(after)
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels


#: Labels up to which they are broadcast (16 bytes each).
MAX_LABELS = 500_000
#: Parts that the nodes of one label are dealt over beyond that.
PARTS = 16


def _by_label(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with the row of ``labels`` (of, further) for their label; a label may hold most of the nodes."""
    labels = written(labels)
    if labels.count() <= MAX_LABELS:
        return nodes.join(F.broadcast(labels), F.col("label") == F.col("of"), "left")
    copied = labels.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = nodes.withColumn("__part", F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int"))
    return dealt.join(copied, (F.col("label") == F.col("of")) & (F.col("__part") == F.col("part")), "left").drop("__part", "part")


def cluster(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 3,
    leaf_prints: int = 1 << 17,
) -> DataFrame:
    """(id, print, component): one row per row of ``docs``; the component is the least id reachable by links."""
    marked = written(fingerprints(docs, id_col, text_col, shingle))
    rooted = _rooted(marked.groupBy("print").agg(F.min("id").alias("first")), max_bits, leaf_prints)
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    classes = rooted.join(least, "root").select(F.col("print").alias("of"), "component")
    return marked.join(classes, F.col("print") == F.col("of")).select("id", "print", "component")


def _rooted(distinct: DataFrame, max_bits: int, leaf_prints: int = 1 << 17) -> DataFrame:
    """(print, first, root): ``distinct`` with the component of each fingerprint."""
    distinct = written(distinct)
    labels = components(links(distinct, distinct.count(), max_bits, leaf_prints))
    return distinct.join(labels, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("label", "print").alias("root")
    )


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each class: the one with the least ``doc_id``; the columns of ``docs``.

    Rows with the same id and text count as one document; of equal ids the
    least hash of id and text stays, and a row without an id only where its
    class has no other.
    """
    key = F.xxhash64("doc_id", "text")
    marked = written(fingerprints(docs, "doc_id", "text", shingle, key))
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key0"))
    rooted = _rooted(marked.groupBy("print").agg(first.alias("first")), max_bits)
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key0").alias("__stay"))
    repeats = marked.groupBy("key0").agg(F.count(F.lit(1)).alias("__n"))
    stay = written(stay.join(repeats, F.col("__stay") == F.col("key0")).select("__stay", "__n"))

    def kept(which: Column, *hint: str) -> DataFrame:
        chosen = stay.where(which)
        return docs.join(chosen.hint(*hint) if hint else chosen, key == F.col("__stay"), "left_semi")

    # most rows are there once, so their texts move for the join alone; their keys grow with the documents, so
    # the join is the same at every size
    return kept(F.col("__n") == 1, "merge").unionByName(kept(F.col("__n") > 1).dropDuplicates(["doc_id", "text"]))
