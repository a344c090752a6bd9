"""Order MinHash: document fingerprints that follow the edit distance of texts.

A text is the sequence of its words (runs without white space); its k-mers are
runs of ``k`` neighbours (shorter ones at the start of the text), and the c-th
occurrence of a k-mer is an element of its own.  Elements are hashed, dealt into ``slots`` by
the top bits of the hash, and each slot takes the ``size`` elements with the
smallest hashes, puts them back in text order and hashes the tuple.  A slot with
fewer borrows the smallest ones of the slots after it (the first slot follows
the last), so that short texts have whole tuples too: seen from any slot, the
elements come in a random order.  Two texts
agree in a slot if they share these elements in the same order, so moved or
replaced passages both count.

Everything is DataFrame functions on arrays of one row, in O(n log n) for n
words: sorting an array of longs whose low bits are positions keeps equal
k-mers together and in text order; occurrence numbers come from doubling over
the repeated k-mers only.  No row is ever compared with all others.

Neighbours (``with_neighbours``) are found by range buckets of the order column:
approximate quantiles give the bounds, so that texts are shuffled once, each
bucket's successor is found by a window inside the bucket, and one row per
bucket carries over to the bucket before.

Defined results: null texts count as empty; texts without words have the empty
fingerprint; two empty fingerprints are alike (1.0), an empty and another one
aren't (0.0).  Ties of the order column are broken by the hash of the text;
null ids come first; a sole document is its own successor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS, SIZE, K = 64, 2, 2


def fingerprint(df: DataFrame, text_col: str, out: str, slots: int = SLOTS, k: int = K, size: int = SIZE) -> DataFrame:
    """``df`` with ``out``: an array of longs, one for each slot (none without words), the slot's number in its top bits."""
    if slots & (slots - 1):
        raise ValueError("slots must be a power of two")
    top = int(math.log2(slots))
    names = ("words", "hashes", "bits", "order", "again", "seen", "elements", "picked", "starts", "tuples")
    made = [f"__{out}_{x}" for x in names]
    words, hashes, bits, order, again, seen, elements, picked, starts, tuples = made
    # an intermediate column that a later one uses must be used twice or outside of its
    # lambda functions: else it would be moved into the lambda and computed per element
    df = df.withColumn(words, F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    # k-mers; the first ones are shorter, which marks the start
    before = "".join(f"get(`{words}`, i - {j}), " for j in range(k - 1, 0, -1))
    df = df.withColumn(hashes, F.expr(f"transform(`{words}`, (w, i) -> xxhash64({before}w))"))
    df = df.withColumn(bits, F.expr(f"length(bin(size(`{hashes}`)))"))
    low = f"((1L << `{bits}`) - 1)"
    # hashes with the place in the text as low bits: equal k-mers side by side, in text order
    df = df.withColumn(order, F.expr(f"sort_array(transform(`{hashes}`, (h, i) -> (h & -(1L << `{bits}`)) | i))"))
    # sorted places whose k-mer is that of the place before
    same = f"shiftright(get(`{order}`, j), `{bits}`) = shiftright(get(`{order}`, j - 1), `{bits}`)"
    df = df.withColumn(
        again,
        F.expr(f"if(size(`{order}`) < 2, cast(array() as array<int>), filter(sequence(1, greatest(size(`{order}`), 2) - 1), j -> {same}))"),
    )
    # occurrence numbers of those places: 1 + neighbours before without a gap, by doubling
    linked = f"transform(`{again}`, (a, i) -> if(i > 0 and get(`{again}`, i - 1) = a - 1, 1, 0))"
    df = df.withColumn(
        seen,
        F.expr(
            f"aggregate(sequence(0, length(bin(size(`{again}`)))), {linked}, (run, t) -> "
            "if(exists(run, r -> r >= (1 << t)), "
            "transform(run, (r, i) -> if(r = (1 << t), r + get(run, i - (1 << t)), r)), run))"
        ),
    )
    # later occurrences of a k-mer get a hash of k-mer and number
    place = f"(get(`{order}`, j) & {low})"
    repeated = f"zip_with(`{again}`, `{seen}`, (j, c) -> (xxhash64(get(`{hashes}`, cast({place} as int)), 1 + c) & -(1L << `{bits}`)) | {place})"
    df = df.withColumn(
        elements,
        F.expr(
            f"if(size(`{again}`) = 0, `{order}`, sort_array(concat("
            f"array_except(`{order}`, transform(`{again}`, j -> get(`{order}`, j))), {repeated})))"
        ),
    )
    # the smallest elements of each slot: those with fewer than `size` of the same slot before them
    shift = 64 - top
    df = df.withColumn(
        picked,
        F.expr(
            f"filter(`{elements}`, (x, j) -> j < {size} or shiftright(get(`{elements}`, j - {size}), {shift}) <> shiftright(x, {shift}))"
        ),
    )
    # the first element of each slot that has one
    df = df.withColumn(
        starts,
        F.expr(
            f"filter(sequence(0, greatest(size(`{picked}`), 1) - 1), "
            f"j -> j < size(`{picked}`) and (j = 0 or shiftright(get(`{picked}`, j - 1), {shift}) <> shiftright(get(`{picked}`, j), {shift})))"
        ),
    )
    # from there on, round the end to the beginning, `size` elements: back in text order, as one hash
    mates = f"transform(sequence(0, least({size}, size(`{picked}`)) - 1), t -> get(`{picked}`, (j + t) % size(`{picked}`)) & {low})"
    in_order = f"transform(sort_array({mates}), q -> get(`{hashes}`, cast(q as int)))"
    df = df.withColumn(tuples, F.expr(f"transform(`{starts}`, j -> shiftrightunsigned(xxhash64({in_order}), {top}))"))
    # a slot without elements has the tuple of the next slot with some, the last ones that of the first
    least, most = -(slots // 2), slots - slots // 2 - 1
    slot = f"cast(shiftright(get(`{picked}`, j), {shift}) as int)"
    before = f"if(i = 0, {least - 1}, cast(shiftright(get(`{picked}`, j - 1), {shift}) as int))"
    filled = f"flatten(transform(`{starts}`, (j, i) -> transform(sequence({before} + 1, {slot}), s -> shiftleft(cast(s as bigint), {shift}) | get(`{tuples}`, i))))"
    last = f"cast(shiftright(element_at(`{picked}`, -1), {shift}) as int)"
    wrapped = f"transform(sequence({last} + 1, {most}), s -> shiftleft(cast(s as bigint), {shift}) | get(`{tuples}`, 0))"
    df = df.withColumn(
        out,
        F.expr(
            f"case when size(`{picked}`) = 0 then cast(array() as array<bigint>) "
            f"when {last} = {most} then {filled} else concat({filled}, {wrapped}) end"
        ),
    )
    return df.drop(*made)


def to_text(prints: str) -> Column:
    """A fingerprint as text: 16 hexadecimal digits a filled slot, slots in order."""
    return F.array_join(F.transform(prints, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: str, b: str, slots: int = SLOTS) -> Column:
    """Share of agreeing slots among those that either fingerprint fills; 1 for two empty ones."""
    shift = 64 - int(math.log2(slots))
    filled = F.size(
        F.array_union(F.transform(a, lambda h: F.shiftright(h, shift)), F.transform(b, lambda h: F.shiftright(h, shift)))
    )
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def bucket_bounds(df: DataFrame, order_col: str, rows_per_bucket: int = 2000, max_buckets: int = 65_536) -> list[int]:
    """Approximate quantiles of a long column: bounds of buckets of about equally many rows."""
    n = df.count()
    buckets = min(max_buckets, max(1, n // rows_per_bucket))
    if buckets == 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order_col, shares, max(10_000, 10 * buckets)).alias("b")).first()["b"]
    return sorted(set(bounds or []))


def bucket_of(order_col: str, bounds: list[int]) -> Column:
    """Number of bounds at or below the value, by binary search; nulls are in bucket 0."""
    if not bounds:
        return F.coalesce(F.col(order_col) * 0, F.lit(0)).cast("int")  # a column: one bucket isn't a cross join
    n = len(bounds)
    table = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    steps = ", ".join(str(1 << i) for i in reversed(range(n.bit_length())))
    search = (
        f"aggregate(array({steps}), 0, (lo, w) -> if(lo + w <= {n} and get({table}, lo + w - 1) <= `{order_col}`, lo + w, lo))"
    )
    return F.coalesce(F.expr(search), F.lit(0))


def with_neighbours(df: DataFrame, order_col: str, text_col: str, out: str) -> DataFrame:
    """``df`` with ``out`` (fingerprint), ``next_text`` and ``next_<out>`` of the next row by ``order_col``.

    The last row's next row is the first one.  Texts are shuffled once, by
    bucket; each fingerprint is computed once (and once more for the first row
    of each bucket).
    """
    bounds = bucket_bounds(df, order_col)
    ranked = df.withColumn("__bucket", bucket_of(order_col, bounds)).withColumn("__tie", F.xxhash64(text_col))
    inside = Window.partitionBy("__bucket").orderBy(F.col(order_col).asc_nulls_first(), "__tie")
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = ranked.withColumns({"__lead": F.lead(text).over(inside), "__at": F.row_number().over(inside)})
    # the first row of each bucket follows the last row of the non-empty bucket before it
    order = Window.orderBy("__b")  # one narrow row per bucket
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    buckets = ranked.select(F.col("__bucket").alias("__b")).distinct()
    following = buckets.select("__b", F.coalesce(F.lead("__b").over(order), F.first("__b").over(whole)).alias("__then"))
    first = placed.where("__at = 1").select(F.col("__bucket").alias("__of"), text.alias("__first"))
    heads = first.join(following, F.col("__of") == F.col("__then")).select("__b", "__first")
    heads = fingerprint(heads, "__first", "__first_print")
    marked = fingerprint(placed, text_col, out).withColumn("__lead_print", F.lead(out).over(inside))
    joined = marked.join(heads, F.col("__bucket") == F.col("__b"), "left")
    last = F.col("__lead").isNull()
    return joined.withColumns(
        {
            "next_text": F.when(last, F.col("__first")).otherwise(F.col("__lead")),
            f"next_{out}": F.when(last, F.col("__first_print")).otherwise(F.col("__lead_print")),
        }
    ).drop("__bucket", "__tie", "__lead", "__at", "__lead_print", "__b", "__first", "__first_print")


def edited(text: str, following: str, n_chars: str) -> Column:
    """The text with its last floor(n/4) code points replaced by the first ones of the following text."""
    cut = F.floor(F.col(n_chars) / 4).cast("int")
    return F.concat(
        F.substring(F.col(text), F.lit(1), (F.col(n_chars) - cut).cast("int")),
        F.substring(F.col(following), F.lit(1), cut),
    )
