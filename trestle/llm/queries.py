"""The ``opN_<name>`` queries: each operator on its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trestle.llm import arc_convert, decontaminate, html_diff, katz, line_mph, max_sketch, nbsvm, order_minhash, phrase_trie, poisson_mix, simhash_trie, url_rules, zstd_langid
from trestle.llm.common import fold, table


def op1_html_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_diff.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every text, of its edited text, and of the next document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = order_minhash.with_neighbours(docs, "doc_id", "text", "fp")
    n_chars = marked.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.char_length("text").cast("long"))
    changed = n_chars.withColumn("edited", order_minhash.edited("text", "next_text", "n_chars"))
    both = order_minhash.fingerprint(changed, "edited", "edited_fp")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        order_minhash.to_text("fp").alias("fingerprint"),
        order_minhash.to_text("edited_fp").alias("edited_fingerprint"),
        order_minhash.likeness("fp", "edited_fp").alias("near_edited"),
        order_minhash.likeness("fp", "next_fp").alias("near_next"),
    )


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated to target shares in proportion to the square root of each source's count."""
    docs = table(spark, sf_dir, "documents")
    mixed = poisson_mix.mix(docs, poisson_mix.tempered_rates(docs, exponent=0.5))
    return mixed.select("doc_id", "source", "text", "copy", "shuffle_key")


def op4_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = zstd_langid.learn(docs.where("not held_out"))
    found = zstd_langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against all windows of 10 words of the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose SimHashes over 3-word shingles differ in at most 3 bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash_trie.cluster(docs, shingle=3, max_bits=3)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op7_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a model of the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    model = nbsvm.learn(docs, labels.select("doc_id", "quality"), label_col="quality")
    scored = nbsvm.score(docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents by a bigram model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = katz.score(docs, train=fold(F.col("doc_id"), 10) != 0)
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files, converted to WARC files, and read back."""
    read = arc_convert.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that 5 documents hold stay in one of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_mph.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", line_mph.digest().alias("kept_sha256"))


def op11_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    index = max_sketch.build_index(table(spark, sf_dir, "documents"))
    found = max_sketch.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls by the given rules, and by rules mined from the urls that these judge."""
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op13_phrase_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language."""
    return phrase_trie.mine(table(spark, sf_dir, "documents").select("lang", "text"), min_count=10, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_differencing,
        op2_order_minhash,
        op3_poisson_mixing,
        op4_zstd_language,
        op5_benchmark_decontamination,
        op6_simhash_trie,
        op7_nb_svm_quality,
        op8_katz_backoff,
        op9_arc_to_warc,
        op10_line_dedup,
        op11_max_sketch_search,
        op12_url_rules,
        op13_phrase_trie,
    )
}

#: A-Z to a-z only, as the contracts have it.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("coalesce(text, '')")

ORACLE_SQL: dict[str, str] = {
    "op3_poisson_mixing": """
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (
  SELECT source, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () * 1.0 / n AS rate FROM c
), p(source, rate, k, logp, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, logp + ln(rate) - ln(k + 1), total + exp(logp + ln(rate) - ln(k + 1)) FROM p
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), d AS (
  SELECT *, cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id AS varchar), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS bigint)
            / 4503599627370496.0 AS u FROM documents
), m AS (
  SELECT doc_id, d.source, text, count(*) AS copies FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.total <= d.u
  GROUP BY doc_id, d.source, text
), x AS (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM m)
SELECT doc_id, source, text, cast(copy AS int) AS copy,
       cast('0x' || substr(md5('mix/order|' || coalesce(cast(doc_id AS varchar), '') || '|' || copy || '|' || md5(coalesce(text, ''))), 1, 13)
            AS bigint) / 4503599627370496.0 AS shuffle_key
FROM x
""",
    "op5_benchmark_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(p) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM bw), dw AS (
  SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)
), hit AS (
  SELECT DISTINCT doc_id, p, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, i, line, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), r AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, i, line, r.k IS NULL OR r.keeper = l.doc_id AS kept FROM l LEFT JOIN r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op11_max_sketch_search": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT count(*) AS docs, cast(sum(len(w)) AS bigint) AS total FROM d WHERE len(w) > 0
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), wt AS (
  SELECT term, cast(floor(1000 * ln(cast(2 * docs + 2 AS double) / (2 * df + 1))) AS bigint) AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term), s
), m AS (
  SELECT doc_id, 100 - 90 + (90 * len(w) * docs) // total AS m FROM d, s WHERE len(w) > 0
), scored AS (
  SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS bigint) AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, cast(pos AS int) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS pos FROM scored WHERE score > 0)
WHERE pos <= 10
""",
    "op12_url_rules": f"""
WITH a AS (
  SELECT page_id, url, position('://' IN url) > 0 AS told, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), b AS (
  SELECT page_id, told, url, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, {_LOWER.format("regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1)")} AS query
  FROM a
), c AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
         CASE WHEN coalesce(told, false) THEN list_distinct(list_concat(list_concat(
           ['scheme:' || {_LOWER.format("substr(url, 1, position('://' IN url) - 1)")}],
           list_transform(regexp_extract_all(host, '[^.-]+'), lambda x: 'host:' || x)), list_concat(
           list_transform(regexp_extract_all(regexp_replace({_LOWER.format("path")}, '[0-9]+', '0', 'g'), '[^/._-]+'), lambda x: 'path:' || x),
           list_transform(regexp_extract_all(query, '([^&=]+)=', 1), lambda x: 'key:' || x)))) ELSE [] END AS toks
  FROM b
), lab AS (
  SELECT page_id, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS given, toks FROM c WHERE rule IS NOT NULL
), size AS (
  SELECT count(*) AS n, count(*) FILTER (given = 'block') AS nb, greatest(ceil(0.01 * count(*)), 5) AS least FROM lab
), each AS (SELECT page_id, given, unnest(toks) AS tok FROM lab), freq AS (
  SELECT tok, tn, abs(tb * n - tn * nb) AS parts FROM (SELECT tok, count(*) AS tn, count(*) FILTER (given = 'block') AS tb FROM each GROUP BY tok), size
  WHERE tn >= least
), picked AS (
  SELECT page_id, given, tok, row_number() OVER (PARTITION BY page_id ORDER BY parts DESC, tok) AS k FROM each JOIN freq USING (tok)
), items AS (
  SELECT page_id, given, list(tok ORDER BY tok) AS its FROM picked WHERE k <= 8 GROUP BY page_id, given
), subsets AS (
  SELECT given, list_filter(its, lambda x, i: (mask >> (i - 1)) % 2 = 1) AS s
  FROM (SELECT given, its, unnest(range(1, cast(pow(2, len(its)) AS int))) AS mask FROM items)
), counted AS (
  SELECT s, count(*) AS n, count(*) FILTER (given = 'block') AS nb, count(*) FILTER (given = 'allow') AS na FROM subsets GROUP BY s
), rules AS (
  SELECT s, v, cast(nv AS double) / n AS conf, nv
  FROM (SELECT s, n, 'block' AS v, nb AS nv FROM counted UNION ALL SELECT s, n, 'allow', na FROM counted), (SELECT least FROM size)
  WHERE nv >= least AND cast(nv AS double) / n >= 0.8
), shorter AS (
  SELECT s, v, conf, list_filter(s, lambda x: x <> gone) AS rest FROM (SELECT s, v, conf, unnest(s) AS gone FROM rules WHERE len(s) > 1)
), idle AS (
  SELECT DISTINCT x.s, x.v FROM shorter x JOIN rules r ON r.s = x.rest AND r.v = x.v AND r.conf >= x.conf
), placed AS (
  SELECT s, r.v, conf, row_number() OVER (ORDER BY conf DESC, nv DESC, len(s), array_to_string(s, ' ')) AS place
  FROM rules r WHERE NOT EXISTS (SELECT 1 FROM idle WHERE idle.s = r.s AND idle.v = r.v)
), best AS (
  SELECT page_id, min(place) AS place FROM c JOIN placed ON list_has_all(c.toks, placed.s) WHERE rule IS NULL GROUP BY page_id
)
SELECT c.page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(v, 'allow') END AS verdict,
       conf AS confidence
FROM c LEFT JOIN best USING (page_id) LEFT JOIN placed ON placed.place = best.place
""",
    "op13_phrase_trie": rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_TEXT}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), one AS (
  SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM p) GROUP BY lang, w
), total AS (SELECT lang, cast(sum(f) AS bigint) AS n FROM one GROUP BY lang), two AS (
  SELECT lang, u, v, count(*) AS a
  FROM (SELECT lang, w[i] AS u, w[i + 1] AS v FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM p)) GROUP BY lang, u, v HAVING count(*) >= 10
), three AS (
  SELECT lang, u, v, x, count(*) AS a
  FROM (SELECT lang, w[i] AS u, w[i + 1] AS v, w[i + 2] AS x FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM p))
  GROUP BY lang, u, v, x HAVING count(*) >= 10
), longer AS (
  SELECT lang, u, v, max(a) AS most FROM (SELECT lang, u, v, a FROM three UNION ALL SELECT lang, v, x, a FROM three) GROUP BY lang, u, v
), scored AS (
  SELECT two.lang, two.u || ' ' || two.v AS phrase, two.a, l.f AS l, r.f AS r, (1000000::hugeint * two.a * two.a) // (l.f::hugeint * r.f) AS score
  FROM two JOIN one l ON l.lang = two.lang AND l.w = two.u JOIN one r ON r.lang = two.lang AND r.w = two.v
  LEFT JOIN longer g ON g.lang = two.lang AND g.u = two.u AND g.v = two.v
  WHERE most IS NULL OR 100 * most < 50 * two.a
  UNION ALL
  SELECT lang, u || ' ' || v || ' ' || x, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (SELECT t.lang, t.u, t.v, t.x, t.a, l.f AS l1, q.a AS r1, h.a AS l2, r.f AS r2,
               (1000000::hugeint * t.a * t.a) // (l.f::hugeint * q.a) AS s1, (1000000::hugeint * t.a * t.a) // (h.a::hugeint * r.f) AS s2
        FROM three t JOIN one l ON l.lang = t.lang AND l.w = t.u JOIN one r ON r.lang = t.lang AND r.w = t.x
        JOIN two h ON h.lang = t.lang AND h.u = t.u AND h.v = t.v JOIN two q ON q.lang = t.lang AND q.u = t.v AND q.v = t.x)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored
)
SELECT lang, rank, phrase, a, l, r, n, cast(score AS bigint) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
}
