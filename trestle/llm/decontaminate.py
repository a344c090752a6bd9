"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Both sides are lower-cased (A-Z) and cut into words (runs of ASCII letters and
digits and of any non-ASCII characters).  A *window* is ``n`` consecutive words
of a benchmark item; an item with fewer words, but not none, is one window.
Training documents are scanned once, word by word: a hit needs a run of words
that all occur in the benchmark, and each candidate window in such a run is
verified in the hash set by its words.  The scan is a narrow map; the text is
never shuffled.

Size of the broadcast: the distinct pairs of window and item are counted first,
with their bytes.  Up to ``max_windows`` and ``max_bytes`` they go out in one
broadcast; beyond that the pairs are dealt into shards of about that size by
hash (so that a window of many items is in many shards), the documents are scanned once per shard,
and the spans of a document are united.  The result is the same.

Defined results: null and empty texts have no words (``n_words`` 0, no hit);
items without words have no window; repeated item ids count once, a null item
id counts as ''; repeated documents each get their own row; empty tables give
empty results or zero hits.  Input columns named like an output column are
replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.llm.common import annotate, key_text, utf8, written

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")  # after lower-casing: the words of the contract, on UTF-8

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
FIELDS = [
    ("n_words", T.LongType()),
    ("hit_spans", SPANS),
    ("items", T.ArrayType(T.StringType())),
]


def words_of(text: bytes | None) -> list[bytes]:
    return WORDS.findall(text.lower()) if text else []


def windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item): the distinct windows of each benchmark item, words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[bytes, str]] = []
            for item, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                w = words_of(text)
                out += {(b" ".join(w[i : i + n]), item) for i in range(max(1, len(w) - n + 1))} if w else ()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())],
                names=["window", "item"],
            )

    items = benchmark.select(key_text(F.col(id_col)).alias("item"), F.col(text_col).alias("text"))
    return items.mapInArrow(run, "window binary, item string").distinct()


class Matcher:
    """Finds the windows of a hash set in documents."""

    def __init__(self, items_of: dict[bytes, list[str]]) -> None:
        self.items_of = items_of
        self.ids: dict[bytes, int] = {}
        for window in items_of:
            for w in window.split(b" "):
                self.ids.setdefault(w, len(self.ids) + 1)
        self.lengths = sorted({w.count(b" ") + 1 for w in items_of})

    def __call__(self, text: bytes | None) -> tuple[int, list[dict[str, int]], list[str]]:
        """Number of words, hit spans (first and last word, merged), ids of the items found."""
        words = words_of(text)
        n = len(words)
        if not self.lengths or n < self.lengths[0]:
            return n, [], []
        known = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, n) != 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        runs = edges.reshape(-1, 2)
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, stop in runs[runs[:, 1] - runs[:, 0] >= self.lengths[0]].tolist():
            for length in self.lengths:
                for i in range(start, stop - length + 1):
                    found = self.items_of.get(b" ".join(words[i : i + length]))
                    if found is not None:
                        items.update(found)
                        hits.append((i, i + length - 1))
        return n, merge_spans(hits), sorted(items)


def merge_spans(hits: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Overlapping or adjacent spans united, in order."""
    merged: list[dict[str, int]] = []
    for first, last in sorted(hits):
        if merged and first <= merged[-1]["last"] + 1:
            merged[-1]["last"] = max(merged[-1]["last"], last)
        else:
            merged.append({"first": first, "last": last})
    return merged


def _scan(docs: DataFrame, text_col: str, table: dict[bytes, list[str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        match = Matcher(shared.value)

        def score(texts: list[bytes | None]) -> list[pa.Array]:
            found = [match(t) for t in texts]
            span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
            return [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.list_(span)),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
            ]

        return score

    return annotate(docs, text_col, FIELDS, make)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    text_col: str = "text",
    max_windows: int = 500_000,
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (first and last word of each) and ``items``."""
    pairs = windows(benchmark, n)
    size = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("window") + F.octet_length("item")).alias("bytes")).first()
    shards = max(1, -(-size["n"] // max_windows), -(-(size["bytes"] or 0) // max_bytes))

    def table(rows: DataFrame) -> dict[bytes, list[str]]:
        return {bytes(r[0]): r[1] for r in rows.groupBy("window").agg(F.collect_set("item")).toLocalIterator()}

    if shards == 1:
        return _scan(docs, text_col, table(pairs))
    shard = F.pmod(F.xxhash64("window", "item"), F.lit(shards))
    span_cols = [name for name, _ in FIELDS]
    out = docs.select(*[c for c in docs.columns if c not in span_cols or c == text_col])
    for k in range(shards):  # each pass holds one shard; a pass adds its hits to those of the passes before
        part = table(pairs.where(shard == k))
        before = [F.col(c).alias(f"__before_{c}") for c in span_cols if k]
        found = _scan(out.select("*", *before).drop(*span_cols) if k else out, text_col, part)
        if k:
            found = found.withColumns(
                {
                    "hit_spans": F.concat("__before_hit_spans", "hit_spans"),
                    "items": F.array_sort(F.array_distinct(F.concat("__before_items", "items"))),
                }
            ).drop(*[f"__before_{c}" for c in span_cols])
        out = written(found)  # so that two shards are never held at once
    return out.withColumn("hit_spans", _united("hit_spans"))


def _united(col: str):
    """Sorted spans with overlapping or adjacent ones merged, in SQL functions."""
    empty = F.expr("cast(array() as array<struct<first:int,last:int>>)")

    def step(acc, x):
        top = F.element_at(acc, -1)
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))),
        )
        return F.when((F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1), joined).otherwise(
            F.concat(acc, F.array(x))
        )

    return F.aggregate(F.array_sort(col), empty, step)


def hit_words(spans: str = "hit_spans"):
    """Number of document words inside any occurrence of a window."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"] + 1))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without those that hold a benchmark window; the columns of ``docs``."""
    original = docs.columns
    keyed = docs.withColumnsRenamed({c: f"__in_{i}" for i, c in enumerate(original)})
    at = f"__in_{original.index('text')}"
    nameless = benchmark.select(F.lit("").alias("item_id"), "text")  # which items were hit doesn't matter
    clean = scan(keyed, nameless, n, text_col=at).where(F.size("hit_spans") == 0)
    return clean.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(original)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` with the hit words cut out of ``text`` (from the first to the last character of each span)."""
    found = scan(docs, benchmark, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, spans_at = b.schema.names.index("text"), b.schema.names.index("hit_spans")
            out = []
            for text, spans in zip(utf8(b.column(at)), b.column(spans_at).to_pylist(), strict=True):
                if spans:
                    where = [m.span() for m in WORDS.finditer(text.lower())]
                    for s in reversed(spans):
                        text = text[: where[s["first"]][0]] + text[where[s["last"]][1] :]
                out.append(text)
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return found.mapInArrow(run, found.schema)
