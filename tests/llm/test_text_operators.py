"""Operators that work on one text at a time: fingerprints, mixing, language, decontamination, quality."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trestle.llm import decontaminate, nbsvm, order_minhash, poisson_mix, zstd_langid

from .conftest import ODD


# ------------------------------------------------------------ order MinHash


def omh(text, slots=64, size=2, k=2):
    """Order MinHash by its definition, with the operator's hash."""
    import re

    import xxhash

    def h64(*parts, seed=42):
        for p in parts:
            if p is not None:
                raw = p.encode() if isinstance(p, str) else (p & (2**64 - 1)).to_bytes(8, "little") if not isinstance(p, tuple) else p[0].to_bytes(4, "little")
                seed = xxhash.xxh64_intdigest(raw, seed % 2**64)
        return seed - 2**64 if seed >= 2**63 else seed

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    hashes = [h64(*[words[i - j] if i >= j else None for j in range(k - 1, 0, -1)], w) for i, w in enumerate(words)]
    bits = len(bin(len(hashes))) - 2
    high = -(1 << bits)
    groups = {}
    for i, h in enumerate(hashes):
        groups.setdefault(h >> bits, []).append(i)
    elements = []
    for places in groups.values():
        for c, i in enumerate(places):
            h = hashes[i] if c == 0 else h64(hashes[i], (c,))
            elements.append((h & high) | i)
    top = int(math.log2(slots))
    ring, out = sorted(elements), []
    for s in range(-slots // 2, slots // 2) if ring else ():
        first = next((i for i, e in enumerate(ring) if e >> (64 - top) >= s), 0)
        own = [ring[(first + t) % len(ring)] for t in range(min(size, len(ring)))]
        tuple_hash = h64(*[hashes[i] for i in sorted(e & ((1 << bits) - 1) for e in own)])
        out.append((s << (64 - top)) | ((tuple_hash % 2**64) >> top))
    return out


def test_order_minhash_by_definition(spark, odd):
    texts = [r[1] for r in ODD] + ["a b a b a b c a b", "x " * 300 + "y " * 5, "the cat the dog the cat the cow the dog the cat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["fp"] for r in order_minhash.fingerprint(df, "t", "fp").collect()}
    for i, t in enumerate(texts):
        assert got[i] == omh(t), (i, t and t[:40])


def test_order_minhash_sees_order_and_edits(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    edited = words[:300] + [f"e{i}" for i in range(100)]
    other = [f"o{i}" for i in range(400)]
    df = spark.createDataFrame([tuple(" ".join(x) for x in (words, words, moved, edited, other))], "a string, b string, c string, d string, e string")
    for c in "abcde":
        df = order_minhash.fingerprint(df, c, f"f{c}")
    r = df.select(*[order_minhash.likeness("fa", f"f{c}").alias(c) for c in "bcde"]).first()
    assert r["b"] == 1.0 and r["e"] == 0.0
    assert 0.2 < r["d"] < 0.8 and 0.3 < r["c"] < 1.0


@pytest.mark.parametrize("size", [1, 3])
def test_order_minhash_of_other_sizes(spark, odd, size):
    texts = ["a", "a b", "a b c a b", " ".join(f"w{i % 90}" for i in range(700))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["fp"] for r in order_minhash.fingerprint(df, "t", "fp", size=size).collect()}
    assert got == {i: omh(t, size=size) for i, t in enumerate(texts)}


def test_order_counts_at_every_length(spark):
    """Halves swapped: the mean likeness is the chance that two of all k-mers are in both texts and in one half."""
    rows = []
    for n, texts in ((20, 100), (40, 100), (400, 20), (4000, 5)):
        for t in range(texts):
            words = [f"w{t}x{i}" for i in range(n)]
            rows.append((n, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2])))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    df = order_minhash.fingerprint(order_minhash.fingerprint(df, "a", "fa"), "b", "fb")
    got = {r["n"]: r["m"] for r in df.groupBy("n").agg(F.avg(order_minhash.likeness("fa", "fb")).alias("m")).collect()}
    for n, mean in got.items():
        exact = 2 * math.comb(n // 2 - 1, 2) / math.comb(n + 2, 2)
        assert abs(mean - exact) < 0.05, (n, mean, exact)


@pytest.mark.parametrize("rows", [0, 1, 7])
def test_neighbours(spark, rows):
    texts = [f"text number {i} with a few words" for i in range(rows)]
    df = spark.createDataFrame([(i * 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in order_minhash.with_neighbours(df, "doc_id", "text", "fp").collect()}
    assert got == {i * 10: texts[(i + 1) % rows] for i in range(rows)}


def test_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "bucket_bounds", lambda *a: [5, 6, 6 + 90, 1000])
    ids = [None, -3, 5, 7, 8, 95, 96, 97, 5000]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in order_minhash.with_neighbours(df, "doc_id", "text", "fp").collect()}
    assert got == {i: f"t{ids[(k + 1) % len(ids)]}" for k, i in enumerate(ids)}


def test_edited(spark):
    df = spark.createDataFrame([("abcdefghi", "XYZ", 9), ("ab", "XYZ", 2), ("ünïcödé!", "é", 8)], "t string, n string, c long")
    assert [r[0] for r in df.select(order_minhash.edited("t", "n", "c")).collect()] == ["abcdefgXY", "ab", "ünïcödé"]


# ------------------------------------------------------------ Poisson mixing


def test_poisson_counts_by_definition(spark, odd):
    rates = spark.createDataFrame([("a", 2.5), ("b", 0.3), (None, 7.0)], "source string, rate double")
    drawn = poisson_mix.copies(odd, rates, "s", "doc_id", "text", "source").select("doc_id", "text", "source", "__copies").collect()
    rate = {"a": 2.5, "b": 0.3, None: 7.0}
    assert len(drawn) == sum(r[3] in rate for r in ODD)
    for r in drawn:
        key = "|".join(["s", "" if r[0] is None else str(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest()])
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        assert r["__copies"] == poisson_mix.poisson_count(u, rate[r[2]])


def test_mixture_meets_its_targets(spark):
    df = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source")
    )
    weights = {"hot": 1.0, "s0": 1.0, "s1": 2.0, "gone": 5.0}
    out = poisson_mix.mix(df, poisson_mix.weighted_rates(df, weights))
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"hot", "s0", "s1"}
    total = sum(n.values())
    assert abs(total - 30_000) < 1500  # Poisson: a standard deviation is under 400 here
    assert abs(n["hot"] / total - 0.25) < 0.02 and abs(n["s1"] / total - 0.5) < 0.02
    keys = [r[0] for r in out.select("shuffle_key").collect()]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)


def test_text_hashed_once_below_the_join(spark, documents):
    mixed = poisson_mix.mix(documents, poisson_mix.tempered_rates(documents))
    plan = mixed._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lower() for line in plan.splitlines()]
    join = next(i for i, line in enumerate(lines) if "join" in line)
    assert "md5(" not in lines[join]
    assert sum(line.count("md5(cast(coalesce(text") for line in lines) == 1
    assert all("md5(" not in line[line.index("lambdafunction") :] for line in lines if "lambdafunction" in line)
    assert not any("rangepartitioning" in line for line in lines)


def test_mixing_without_broadcast(spark, documents, monkeypatch):
    def rows():
        return sorted(map(tuple, poisson_mix.mix(documents, poisson_mix.tempered_rates(documents), partition_bytes=100_000).collect()), key=repr)

    wanted = rows()
    monkeypatch.setattr(poisson_mix, "MAX_STEPS", 0)
    assert rows() == wanted


def test_mixing_odd_and_empty(spark, odd, none):
    assert poisson_mix.mix(none, poisson_mix.tempered_rates(none)).count() == 0
    out = poisson_mix.mix(odd, poisson_mix.tempered_rates(odd, epochs=20.0))
    assert set(odd.columns) <= set(out.columns)
    twice = [r["n"] for r in out.where("doc_id = 1").groupBy("copy").agg(F.count("*").alias("n")).collect()]
    assert twice and all(n == 2 for n in twice)  # repeated rows are repeated alike


# ------------------------------------------------------------ language


def test_languages_of_held_out_documents(documents):
    from trestle.llm.common import fold

    docs = documents.withColumn("f", fold(F.col("doc_id"), 4))
    model = zstd_langid.learn(docs.where("f <> 2"))
    rows = zstd_langid.identify(docs.where("f = 2 and n_chars > 100"), model).select("lang", "lang_pred", "rejected").collect()
    assert len(rows) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    assert np.mean([r["rejected"] for r in rows]) < 0.1


def test_long_training_texts_teach_from_all_their_length(spark):
    long = "boilerplate head " * 2000 + "middle words " * 2000 + "closing part " * 2000
    accents = "déjà été " * 1500 + "où ça " * 1500
    df = spark.createDataFrame([(1, long, "en"), (2, accents, "fr"), (3, "short text", "en")], "doc_id long, text string, lang string")
    content = dict(zstd_langid.learn(df).content)
    assert all(x in content["en"] for x in (b"boilerplate head", b"middle words", b"closing part", b"short text"))
    assert "déjà".encode() in content["fr"] and "où ça".encode() in content["fr"]
    assert len(content["en"]) <= (128 << 10) // 8 + len(b" short text") and len(content["fr"]) <= (128 << 10) // 8


def test_language_odd_and_empty(spark, odd, none, documents):
    model = zstd_langid.learn(documents)
    out = zstd_langid.identify(odd, model)
    rows = out.collect()
    assert len(rows) == len(ODD) and [c for c in out.columns if c == "score"] == ["score"]
    unknown = {r["doc_id"] for r in rows if r["lang_pred"] == zstd_langid.UNKNOWN}
    assert unknown == {2, 3, 4, 5, None}
    assert all((r["lang_pred"] == "und") <= r["rejected"] and 0 <= r["score"] <= 1 for r in rows)
    assert zstd_langid.identify(none, model).count() == 0
    nothing = zstd_langid.learn(none)
    assert {r["lang_pred"] for r in zstd_langid.identify(odd, nothing).collect()} == {"und"}
    kept = zstd_langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {1, 6, 7, 8, None}


# ------------------------------------------------------------ decontamination

ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, ITEM), (2, "Short, sweet ITEM"), (3, None), (4, "..."), (None, "alpha beta gamma delta"), (1, ITEM)]
    return spark.createDataFrame(items, "item_id long, text string")


CASES = [
    (1, "clean text with nothing of it", 0, []),
    (2, f"before {ITEM.upper()} after", 12, ["1"]),
    (3, "two three; four-five six seven EIGHT nine ten eleven", 10, ["1"]),
    (4, "two three four five six seven eight nine ten", 0, []),
    (5, "short sweet item short sweet item", 6, ["2"]),
    (6, f"alpha beta gamma delta {ITEM} x {ITEM}", 28, ["", "1"]),
    (7, None, 0, []),
    (8, "", 0, []),
]


@pytest.mark.parametrize("max_windows", [500_000, 2])
def test_decontamination(spark, bench, max_windows):
    docs = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    found = decontaminate.scan(docs, bench, max_windows=max_windows).withColumn("n_hit", decontaminate.hit_words())
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in found.collect()}
    assert got == {c[0]: (c[2], c[3]) for c in CASES}


def test_a_window_of_many_items_goes_to_shards(spark, monkeypatch):
    tables = []
    real = decontaminate._scan
    monkeypatch.setattr(decontaminate, "_scan", lambda docs, col, table: (tables.append(table), real(docs, col, table))[1])
    items = spark.createDataFrame([(i, ITEM[:48]) for i in range(1000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {ITEM}"), (2, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.scan(docs, items, max_bytes=20_000).collect()}
    assert got == {1: sorted(str(i) for i in range(1000)), 2: []}
    assert len(tables) > 1 and all(sum(len(w) + len(i) for w, of in t.items() for i in of) < 30_000 for t in tables)
    tables.clear()
    assert [r["doc_id"] for r in decontaminate.remove_documents(docs, items).collect()] == [2]
    assert [len(of) for t in tables for of in t.values()] == [1]


def test_decontamination_removes(spark, bench):
    docs = spark.createDataFrame([c[:2] for c in CASES], "doc_id long, text string")
    assert {r[0] for r in decontaminate.remove_documents(docs, bench).collect()} == {1, 4, 7, 8}
    texts = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert texts[2] == "before  after" and texts[5] == "" and texts[1] == CASES[0][1] and texts[7] is None


def test_decontamination_odd_and_empty(odd, none, bench):
    assert decontaminate.scan(odd, bench).count() == len(ODD)
    assert decontaminate.scan(none, bench).count() == 0
    empty = bench.where("item_id = 99")
    assert {r["n"] for r in decontaminate.scan(odd, empty).select(F.size("hit_spans").alias("n")).collect()} == {0}
    kept = decontaminate.remove_documents(odd, empty)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


# ------------------------------------------------------------ quality


def test_quality_of_held_out_documents(spark):
    from trestle.llm.common import fold

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = nbsvm.learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    rows = nbsvm.score(docs.join(labels.where(fold(F.col("doc_id"), 3) == 1), "doc_id"), model).collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert len(y) > 50 and (y == (s >= 0.5)).mean() > 0.9
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.95


def test_descent_solves_the_hinge_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x @ np.array([1.0, -2, 0.5, 0, 1]) + 0.2 * rng.normal(size=60) > 0, 1, -1)
    upper = np.where(y > 0, 30 / (y > 0).sum(), 30 / (y < 0).sum())
    rows = [np.arange(5 * i, 5 * i + 5) for i in range(60)]
    # texts without common places: each row's part of the weights is its dual variable
    w, b = nbsvm.dual_coordinate_descent(rows, x.ravel(), y, epochs=400)
    margins = np.array([x[i] @ w[rows[i]] + b for i in range(60)])
    slack = np.maximum(0, 1 - y * margins)
    alpha = np.array([np.linalg.norm(w[rows[i]]) for i in range(60)])
    assert abs(b - (alpha * y).sum()) < 1e-6  # the bias is the sum of the dual variables
    assert all(abs(a - u) < 1e-3 for a, u, s in zip(alpha, upper, slack, strict=True) if s > 1e-3)  # at the bound where slack
    assert all(a < 1e-6 for a, m in zip(alpha, y * margins, strict=True) if m > 1 + 1e-3)  # zero beyond the margin


def test_quality_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (8, 1), (6, 1), (None, 1), (2, None), (3, 1), (3, 1)], "doc_id long, quality int")
    model = nbsvm.learn(odd, labels)
    out = nbsvm.score(odd, model)
    assert out.count() == len(ODD) and out.columns.count("score") == 1
    blank = nbsvm.learn(none, labels.where("doc_id = 99"))
    assert {r["score"] for r in nbsvm.score(odd, blank).collect()} == {0.5}
    assert nbsvm.score(none, model).count() == 0
