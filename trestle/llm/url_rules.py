"""URL filter by association rules that FP-growth mines from labelled urls.

Given rules (a host with its subdomains and a path prefix, block or allow) judge
the urls they fit, the longest rule first; these judgements are the labels.  Spark's
FP-growth mines the combinations of url tokens that go with a label, and the rules
among them judge the urls that no given rule fits.

Tokens of a url: its scheme, the words of its host, the words of its path with any
digits read as one 0, and the keys of its query.  A labelled url gives FP-growth the
``max_items`` of its frequent tokens that part the labels best, so no url stands for
more than 2 ** ``max_items`` combinations.  A mined rule (tokens => label) stays if it
has the support and the confidence asked for, and if leaving out any one of its tokens
lowers the confidence.  Rules are ranked by confidence, support, fewest tokens, and
the tokens; the first that a url meets judges it, or ``default`` if it meets none.

Matching: every rule is filed under the rarest of its tokens.  A url's tokens are
looked up in this inverted index, and the rules found there are compared with all of
its tokens; the best match is a minimum per url, taken before anything is shuffled.

DataFrame functions and Spark ML only.  Shuffles carry row numbers and token numbers.
Bounds: there are at most (mean tokens of a url) / ``min_support`` frequent tokens;
they and the rules are broadcast up to ``MAX_BROADCAST`` rows and joined by shuffle
beyond.  FP-growth takes a sample of at most about ``sample_urls`` labelled urls,
chosen by hash (a fit's sample); support and confidence are those of the sample.

Defined results: a null url and one without ``://`` have an empty host and path, fit no
given rule, have no tokens and get ``default``; every row is judged, repeated rows alike;
very long urls are judged by all of their tokens; an empty table gives no rows.  Input
columns named like an output column are replaced.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trestle.llm.common import quoted, written

#: (verdict, host and path prefix) as the contract gives them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rows of tokens or rules up to which they are broadcast.
MAX_BROADCAST = 100_000
OUT = ("host", "path", "rule", "verdict", "confidence")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host_col: Column, path_col: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        own_host, _, own_path = text.partition("/")
        fits = ((host_col == own_host) | host_col.endswith("." + own_host)) & path_col.startswith("/" + own_path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host_col: Column, path_col: Column) -> Column:
    """The distinct tokens of a url, each with the part it comes from; none without ``://``."""

    def named(part: str, text: Column, pattern: str, group: int = 0) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.concat(F.lit(part), x))

    scheme = lower(F.substring_index(url, "://", 1))
    query = lower(F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1))
    words = F.regexp_replace(lower(path_col), "[0-9]+", "0")
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), scheme)),
        named("host:", host_col, "[^.-]+"),
        named("path:", words, "[^/._-]+"),
        named("key:", query, "([^&=]+)=", 1),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def mine(
    labelled: DataFrame,
    max_items: int = 8,
    min_support: float = 0.01,
    min_count: int = 5,
    min_confidence: float = 0.8,
    sample_urls: int = 1_000_000,
) -> DataFrame | None:
    """(place, tokens, key, verdict, confidence) of the rules mined from (__row, __tokens, __given), best first by place.

    None where there are fewer labelled urls than a rule needs.
    """
    n = labelled.count()
    if n > sample_urls:
        labelled = labelled.where(F.pmod(F.xxhash64("__row"), F.lit(1 << 20)) < math.ceil((1 << 20) * sample_urls / n))
        n = labelled.count()
    least = max(math.ceil(min_support * n), min_count)
    if n < least:
        return None
    each = labelled.select("__row", "__given", F.explode("__tokens").alias("token"))
    verdicts = labelled.groupBy("__given").count()
    of_token = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__given") == "block", 1)).alias("n_block")
    )
    blocked = verdicts.where(F.col("__given") == "block").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # how far the token's share of blocked urls is from the share of all, times its count: in whole numbers
    parts = F.abs(F.col("n_block") * F.lit(n) - F.col("n") * F.lit(blocked))
    frequent = written(of_token.where(F.col("n") >= least).select("token", "n", parts.alias("parts")))
    chosen = (
        each.join(_small(frequent), "token")
        .groupBy("__row", "__given")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct(-F.col("parts"), "token"))), 1, max_items)["token"].alias("items"))
    )
    transactions = written(chosen.select(F.concat("items", F.array(F.concat(F.lit("verdict:"), "__given"))).alias("items")))
    sets = transactions.count()  # urls without a frequent token are in no rule
    if sets < least:
        return None
    # half a url less than the count, so that rounding can't ask for one more
    grown = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / sets, minConfidence=min_confidence).fit(transactions)
    said = F.col("consequent")[0]
    found = grown.associationRules.where(said.startswith("verdict:") & ~F.exists("antecedent", lambda x: x.startswith("verdict:")))
    rules = written(
        found.select(
            F.array_sort("antecedent").alias("tokens"), F.substring_index(said, ":", -1).alias("verdict"), "confidence", "support"
        )
    )
    shorter = rules.select(F.col("tokens").alias("left"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    without = rules.where(F.size("tokens") > 1).withColumn("out", F.explode("tokens"))
    without = without.withColumn("left", F.array_remove("tokens", F.col("out")))
    idle = without.join(shorter, (without["left"] == shorter["left"]) & (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")))
    rules = rules.join(idle.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    # one task: min_support bounds the number of rules
    order = Window.orderBy(F.col("confidence").desc(), F.col("support").desc(), F.size("tokens"), F.array_join("tokens", " "))
    placed = rules.withColumn("place", F.row_number().over(order))
    key = placed.withColumn("token", F.explode("tokens")).join(_small(frequent), "token")
    key = key.groupBy("place").agg(F.min(F.struct("n", "token"))["token"].alias("key"))
    return written(placed.join(key, "place").select("place", "tokens", "key", "verdict", "confidence"))


def judge(
    pages: DataFrame,
    rules=RULES,
    url_col: str = "url",
    max_items: int = 8,
    min_support: float = 0.01,
    min_count: int = 5,
    min_confidence: float = 0.8,
    sample_urls: int = 1_000_000,
    default: str = "allow",
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``confidence`` (null but for mined rules)."""
    kept = [c for c in pages.columns if c not in OUT]
    url = F.col(quoted(url_col)).cast("string")
    rows = pages.select(
        F.monotonically_increasing_id().alias("__row"),
        url.alias("__url"),
        host(url).alias("__host"),
        path(url).alias("__path"),
        *[F.col(quoted(c)).alias(f"__u{i}") for i, c in enumerate(kept)],
    )
    rule, verdict = given_rule(F.col("__host"), F.col("__path"), rules)
    rows = written(rows.withColumn("__rule", rule).withColumn("__given", verdict))
    split = rows.select("__row", "__given", tokens(F.col("__url"), F.col("__host"), F.col("__path")).alias("__tokens"))
    mined = mine(split.where("__given is not null"), max_items, min_support, min_count, min_confidence, sample_urls)
    if mined is None:
        judged = rows.withColumn("__mined", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    else:
        index = _small(mined.select("key", "place", F.col("tokens").alias("__wanted")))
        asked = split.where("__given is null").select("__row", "__tokens", F.explode("__tokens").alias("key"))
        met = asked.join(index, "key").where(F.forall("__wanted", lambda t: F.array_contains("__tokens", t)))
        best = met.groupBy("__row").agg(F.min("place").alias("place"))
        best = best.join(_small(mined.select("place", F.col("verdict").alias("__mined"), "confidence")), "place")
        judged = rows.join(best, "__row", "left")
    return judged.select(
        *[F.col(f"__u{i}").alias(c) for i, c in enumerate(kept)],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__given", "__mined", F.lit(default)).alias("verdict"),
        "confidence",
    )
