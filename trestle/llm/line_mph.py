"""Line dedup: sharded minimal perfect hash over the hashes of repeated lines.

A line's key is the line without white space at both ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
documents lose all their lines except in the document with the largest id that
holds the key.

Three steps.  (1) Documents emit the 128-bit hashes of their distinct long
keys; a partial aggregate counts documents and keeps the largest id, so the
most frequent line costs one row per task.  (2) The repeated hashes are dealt
into shards of about ``shard_keys`` keys, and each shard builds a minimal
perfect hash (levels of bit arrays; a key sits at the first level where no
other key falls on its bit, its index is the rank of that bit) with compact
fingerprint, count and keeper arrays at that index.  (3) Documents probe these
arrays: index by the perfect hash, compare the fingerprint, drop the line if
the document isn't the keeper.  Lines are not joined and texts not shuffled.

Size of the broadcast: step 2's keys are counted first.  While the arrays
(``BYTES_PER_KEY`` each) fit in ``max_broadcast_bytes`` they are broadcast.
Beyond that the line hashes go to the arrays: hash, document number and place of
each long line are dealt to the shards' tasks, which probe the same arrays; a shard
with more than ``GROUP_LINES`` lines (a line of many documents) is copied to as many
tasks as it takes.  What is to be dropped then joins the documents, whose texts are
shuffled once.

Defined results: a null text counts as empty, an empty text is one empty line;
every row is a document of its own; a null id is below every other id, and if
all rows that hold a key have a null id, they all keep it; rows with equal ids
are equal keepers.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.llm.common import annotate, quoted, utf8, written

#: Fingerprint 8, keeper 8, count 4, keeper flag 1, about 3.7 bits of the hash, and slack.
BYTES_PER_KEY = 24
#: Lines that one task probes at a time where they are dealt to the shards.
GROUP_LINES = 500_000
FIELDS = [("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_text", T.StringType())]
_NO_ID = np.iinfo(np.int64).min


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None if the key is shorter than ``min_chars`` code points."""
    key = line.strip()
    if len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of a 128-bit key, another one for each level."""
    x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xD1B54A32D192ED03 + 1) & 0xFFFFFFFFFFFFFFFF))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of n distinct 128-bit keys to its own index below n."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.offsets = np.cumsum([0, *sizes])
        words = np.frombuffer(bits.tobytes() + b"\0" * (-len(bits) % 8), np.uint64)
        self.words = words
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        sizes, levels = [], []
        left = np.arange(len(h1))
        while len(left):
            m = max(64, int(gamma * len(left)) + 63 & ~63)
            at = (mix(h1[left], h2[left], len(sizes)) % np.uint64(m)).astype(np.int64)
            once = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(np.packbits(once, bitorder="little"))
            left = left[~once[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The index of each key; some index or -1 for a key that isn't in the set."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = (mix(h1[left], h2[left], level) % np.uint64(m)).astype(np.int64) + self.offsets[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.ranks[word] + np.bitwise_count(below).astype(np.int64)
            out[left[hit]] = rank[hit]
            left = left[~hit]
        return out


class Shard:
    """A perfect hash with the fingerprint, count and keeper of each key at its index."""

    def __init__(self, row: dict) -> None:
        self.hash = PerfectHash(list(row["sizes"]), np.frombuffer(row["bits"], np.uint8))
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32)
        self.keepers = np.frombuffer(row["keepers"], np.int64)

    @staticmethod
    def build(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> dict:
        mph = PerfectHash.build(h1, h2)
        at = mph.index(h1, h2)
        arrays = [np.empty(len(h1), t) for t in (np.uint64, np.uint32, np.int64)]
        for array, values in zip(arrays, (h2, np.minimum(counts, 0xFFFFFFFF), keepers), strict=True):
            array[at] = values
        prints, counts, keepers = (a.tobytes() for a in arrays)
        return {"sizes": mph.sizes, "bits": mph.bits.tobytes(), "prints": prints, "counts": counts, "keepers": keepers}

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, keeper) of each key."""
        if not len(self.prints):
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        at = self.hash.index(h1, h2)
        found = (at >= 0) & (self.prints[at] == h2)
        return found, self.keepers[at]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, n_docs, keeper): the long keys found in at least ``min_docs`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, rows = [], []
            for i, text in enumerate(utf8(b.column(1))):
                own = {line_hash(x, min_chars) for x in text.split(b"\n")} - {None} if text else ()
                digests += own
                rows += [i] * len(own)
            h1, h2 = _halves(digests)
            ids = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids], names=["h1", "h2", "id"])

    lines = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))
    return (
        lines.mapInArrow(run, "h1 long, h2 long, id long")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


def build_shards(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and its arrays."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h1", "h2"])
        keepers = pdf["keeper"].fillna(_NO_ID).astype("int64").to_numpy()
        row = Shard.build(
            pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64), pdf["n_docs"].to_numpy(), keepers
        )
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), **row}])

    schema = "shard int, sizes array<long>, bits binary, prints binary, counts binary, keepers binary"
    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    # null keepers become a number below: Arrow would turn a nullable id column to floats
    return dealt.withColumn("keeper", F.coalesce("keeper", F.lit(_NO_ID))).groupBy("shard").applyInPandas(build, schema)


def _rebuild(text: bytes | None, drop: set[int]) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    if not drop:
        return len(lines), 0, text or b""
    return len(lines), len(drop), b"\n".join(x for i, x in enumerate(lines) if i not in drop)


def _arrays(rebuilt: list[tuple[int, int, bytes]]) -> list[pa.Array]:
    return [
        pa.array([r[0] for r in rebuilt], pa.int64()),
        pa.array([r[1] for r in rebuilt], pa.int64()),
        pa.array([r[2] for r in rebuilt], pa.binary()).cast(pa.string()),
    ]


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_keys: int = 100_000,
    max_broadcast_bytes: int = 96 << 20,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``."""
    keys = written(repeated_keys(docs, min_chars, min_docs, id_col, text_col))
    count = keys.count()
    if count * BYTES_PER_KEY > max_broadcast_bytes:
        return _by_shard(docs, keys, -(-count // shard_keys), min_chars, id_col, text_col)
    shards = max(1, -(-count // shard_keys))
    rows = {r["shard"]: r.asDict() for r in build_shards(keys, shards).toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    id_name = "__line_id"

    def make():
        opened = {k: Shard(r) for k, r in shared.value.items()}

        def score(packed: list[tuple[int | None, bytes | None]]) -> list[pa.Array]:
            digests, where = [], []
            for i, (_, text) in enumerate(packed):
                for k, line in enumerate(text.split(b"\n") if text else ()):
                    h = line_hash(line, min_chars)
                    if h is not None:
                        digests.append(h)
                        where.append((i, k))
            drops: dict[int, set[int]] = {}
            if digests and opened:
                h1, h2 = _halves(digests)
                ids = np.array([_NO_ID if x[0] is None else x[0] for x in packed], np.int64)
                own = ids[[i for i, _ in where]]
                shard = h1.view(np.int64) % shards
                for s, arrays in opened.items():
                    at = np.flatnonzero(shard == s)
                    found, keeper = arrays.probe(h1[at], h2[at])
                    for j in at[found & (keeper != own[at])].tolist():
                        drops.setdefault(where[j][0], set()).add(where[j][1])
            return _arrays([_rebuild(text, drops.get(i, set())) for i, (_, text) in enumerate(packed)])

        return score

    return annotate_with_id(docs, id_col, text_col, id_name, make)


def annotate_with_id(docs: DataFrame, id_col: str, text_col: str, id_name: str, make) -> DataFrame:
    """``annotate`` for a batch function that takes (id, text) pairs."""
    names = [n for n, _ in FIELDS]
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(id_col)).cast("long").alias(id_name))
    schema = T.StructType([*source.schema.fields[: len(kept)], *[T.StructField(n, t, True) for n, t in FIELDS]])
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            packed = list(zip(b.column(len(kept)).to_pylist(), utf8(b.column(at)), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *score(packed)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def _by_shard(docs: DataFrame, keys: DataFrame, shards: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """The same result where the arrays are too large to broadcast: lines are sent to their shard's arrays."""
    id_, text = F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col))
    number = [F.xxhash64(F.lit(seed), id_, text) for seed in (0, 1)]  # 128 bits; equal rows are one document here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, rows, lines = [], [], []
            for i, text in enumerate(utf8(b.column(3))):
                for k, line in enumerate(text.split(b"\n") if text else ()):
                    h = line_hash(line, min_chars)
                    if h is not None:
                        digests.append(h)
                        rows.append(i)
                        lines.append(k)
            h1, h2 = _halves(digests)
            at = pa.array(rows, pa.int64())
            own = [b.column(i).take(at) for i in range(3)]
            made = [*own, pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(lines, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["d1", "d2", "own", "h1", "h2", "line"])

    numbered = docs.select(number[0].alias("d1"), number[1].alias("d2"), F.coalesce(id_, F.lit(_NO_ID)).alias("own"), text.alias("text"))
    lines = numbered.mapInArrow(run, "d1 long, d2 long, own long, h1 long, h2 long, line int")
    lines = written(lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")))
    parts = F.ceil(F.count(F.lit(1)) / GROUP_LINES).cast("int").alias("parts")
    parts = written(lines.groupBy("shard").agg(parts))  # one row per shard
    arrays = build_shards(keys, shards).join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = lines.join(F.broadcast(parts) if shards <= 100_000 else parts, "shard")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("d1", "d2", "line"), F.col("parts")).cast("int")).drop("parts")

    def probe(own: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(own):
            return pd.DataFrame({"d1": [], "d2": [], "line": []}).astype({"d1": "int64", "d2": "int64", "line": "int32"})
        opened = Shard(shard.iloc[0].to_dict())
        found, keeper = opened.probe(own["h1"].to_numpy().view(np.uint64), own["h2"].to_numpy().view(np.uint64))
        return own.loc[found & (keeper != own["own"].to_numpy()), ["d1", "d2", "line"]]

    gone = dealt.groupBy("shard", "part").cogroup(arrays.drop("parts").groupBy("shard", "part"))
    gone = gone.applyInPandas(probe, "d1 long, d2 long, line int")
    gone = gone.groupBy("d1", "d2").agg(F.collect_set("line").alias("__drop"))  # at most the lines of one document
    key = F.struct(number[0].alias("d1"), number[1].alias("d2"))
    gone = gone.select(F.struct("d1", "d2").alias("__doc"), "__drop")
    names = [n for n, _ in FIELDS]
    kept = [c for c in docs.columns if c not in names]
    joined = docs.select(*[F.col(quoted(c)) for c in kept], key.alias("__key"), F.col(quoted(text_col)).alias("__line_text"))
    joined = joined.join(gone, F.col("__key") == F.col("__doc"), "left")
    joined = joined.select(*[F.col(quoted(c)) for c in kept], "__drop", "__line_text")
    schema = T.StructType([*joined.schema.fields[: len(kept)], *[T.StructField(n, t, True) for n, t in FIELDS]])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drops = b.column(len(kept)).to_pylist()
            texts = utf8(b.column(len(kept) + 1))
            made = _arrays([_rebuild(t, set(d or ())) for d, t in zip(drops, texts, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made], names=schema.fieldNames())

    return joined.mapInArrow(rebuild, schema)


def digest(kept_text: str = "kept_text"):
    """Lower-case hex SHA-256 of the kept text."""
    return F.sha2(F.col(kept_text).cast("binary"), 256)


def brute_force(rows: list[tuple[int, str | None]], min_chars: int = 40, min_docs: int = 5) -> dict[int, tuple[int, int, str]]:
    """The result for distinct ids by plain dictionaries; for tests."""
    holders: dict[str, set[int]] = {}
    table = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate(table)

    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
