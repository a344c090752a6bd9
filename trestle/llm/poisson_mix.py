"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the output.  A document of source s is
repeated Poisson(rate_s) times, where rate_s is the target number of documents
of s over the number there are, so the expected mixture is the target one; rates
under 1 thin a source, rates over 1 repeat it.  The count of a document is the
quantile function of that distribution at a uniform number that comes from a
hash of seed, id and text: the same on every run and every cluster.  Documents
are exploded by their count and put into a global random order by another hash.

DataFrame functions only.  One pass counts rows and text bytes per source (a
partial aggregate) into a small written table.  The MD5 of a text is taken once,
in a projection below the join with that table, and both hashes derive from it.
The join is a broadcast where the table's quantile arrays are counted to at most
``MAX_STEPS`` numbers, else a shuffle join, whose skewed sources AQE splits.  The
copies cross the network once: keys are uniform, so the key itself names the range
partition it belongs to, and no sampling pass draws a second time.  The number of
partitions comes from the counted bytes.

Defined results: a null source is a source of its own; a null text is repeated
as it is; repeated rows have the same hash, hence the same count, each of them;
sources without a target get rate 0, targets without documents are left out and
the other shares grow; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trestle.llm.common import key_text, quoted, written

#: Numbers in all quantile arrays together up to which they are broadcast (8 bytes each).
MAX_STEPS = 1_000_000


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and values: 52 bits, the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(seed), *[key_text(c) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _counted(docs: DataFrame, source_col: str, text_col: str | None) -> DataFrame:
    """(source, n, bytes): rows and text bytes of each source."""
    size = F.coalesce(F.octet_length(F.col(quoted(text_col))).cast("long"), F.lit(0)) if text_col in docs.columns else F.lit(0)
    return docs.groupBy(F.col(quoted(source_col)).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(size + 64).alias("bytes"))


def tempered_rates(
    docs: DataFrame, source_col: str = "source", exponent: float = 0.5, epochs: float = 1.0, text_col: str = "text"
) -> DataFrame:
    """(source, rate, bytes) for target shares in proportion to count ** exponent; ``epochs`` times the input in all."""
    return _rates(_counted(docs, source_col, text_col).withColumn("w", F.pow("n", F.lit(exponent))), epochs)


def _rates(weighed: DataFrame, epochs: float) -> DataFrame:
    """(source, rate, expected output bytes) of (source, n, bytes, w): w over all weights, times all documents, over n."""
    weighed = written(weighed)  # one row per source; later reads don't count again
    sums = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()  # two numbers
    rate = F.col("w") / F.lit(float(sums["w"])) * F.lit(sums["n"]) * F.lit(epochs) / F.col("n") if sums["w"] else F.lit(0.0)
    return weighed.select("source", rate.alias("rate"), (rate * F.col("bytes")).alias("bytes"))


def weighted_rates(
    docs: DataFrame, weights: dict[str, float], source_col: str = "source", epochs: float = 1.0, text_col: str = "text"
) -> DataFrame:
    """(source, rate, bytes) for given target shares by source name (any positive scale)."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
    weight = F.coalesce(F.create_map(*pairs)[F.coalesce("source", F.lit(""))], F.lit(0.0)) if pairs else F.lit(0.0)
    return _rates(_counted(docs, source_col, text_col).withColumn("w", weight), epochs)


def poisson_quantiles(rate: str) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where the rest is far below 2**-52.

    Terms are taken by logarithm, so that large rates don't underflow.
    """
    last = f"cast({_last(rate)} as int)"
    # running (log term, sum) pairs; one short array per source
    return F.expr(
        f"aggregate(sequence(0, {last}), "
        "struct(cast(0.0 as double) as logp, cast(0.0 as double) as total, cast(array() as array<double>) as cdf), "
        f"(a, k) -> named_struct("
        f"'logp', if(k = 0, -{rate}, a.logp + ln({rate}) - ln(k)), "
        f"'total', a.total + exp(if(k = 0, -{rate}, a.logp + ln({rate}) - ln(k))), "
        f"'cdf', concat(a.cdf, array(a.total + exp(if(k = 0, -{rate}, a.logp + ln({rate}) - ln(k)))))), "
        "a -> a.cdf)"
    )


def _last(rate: str) -> str:
    """How far ``poisson_quantiles`` goes."""
    return f"ceil({rate} + 12 * sqrt({rate}) + 30)"


def copies(docs: DataFrame, rates: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with ``__copies``, the Poisson count of each document, and ``__md5`` of its text."""
    some = rates.where("rate > 0")
    numbers = some.agg(F.sum(F.expr(_last("rate")))).first()[0]
    steps = some.select(F.col("source").alias("__source"), poisson_quantiles("rate").alias("__cdf"))
    if (numbers or 0) <= MAX_STEPS:
        steps = F.broadcast(steps)
    hashed = docs.withColumn("__md5", F.md5(F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary")))
    hashed = hashed.withColumn("__u", uniform(seed, F.col(quoted(id_col)), F.col("__md5")))
    joined = hashed.join(steps, F.col(quoted(source_col)).eqNullSafe(F.col("__source")))
    count = F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    return joined.withColumn("__copies", count).drop("__source", "__cdf", "__u")


def mix(
    docs: DataFrame,
    rates: DataFrame,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    partition_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` repeated to the target mixture, with ``copy`` (from 1) and ``shuffle_key``, in the order of that key."""
    own = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    drawn = copies(docs.select(*[F.col(quoted(c)) for c in own]), rates, seed, id_col, text_col, source_col).where("__copies > 0")
    exploded = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    key = uniform(seed + "/order", F.col(quoted(id_col)), F.col("copy"), F.col("__md5"))
    keyed = exploded.withColumn("shuffle_key", key).drop("__copies", "__md5")
    parts = max(1, math.ceil((rates.agg(F.sum("bytes")).first()[0] or 0) / partition_bytes))
    return keyed.repartitionById(parts, F.floor(F.col("shuffle_key") * parts).cast("int")).sortWithinPartitions("shuffle_key")


def poisson_count(u: float, rate: float) -> int:
    """The quantile function by its definition; for tests."""
    k, log_term, total = 0, -rate, 0.0
    while True:
        total += math.exp(log_term)
        if u < total or k > rate + 12 * math.sqrt(rate) + 30:
            return k
        k += 1
        log_term += math.log(rate) - math.log(k)
