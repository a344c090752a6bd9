"""Operators that look at the whole corpus: SimHash classes, line dedup, Katz scores, pages, archives, the pipeline."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trestle.llm import arc_convert, html_diff, katz, line_mph, simhash_trie
from trestle.llm.common import fold

from .conftest import ODD, SF

# ------------------------------------------------------------ SimHash


def classes(prints, ids, bits=3):
    """Component of each row by comparing all pairs."""
    p = np.array(prints, np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= bits
    label = np.array(ids)
    while True:
        lower = np.array([label[x].min() for x in near])
        if (lower == label).all():
            return label.tolist()
        label = lower


def simhash(text, k=3):
    import xxhash

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_definition(spark):
    for _, text, *_ in ODD:
        assert simhash_trie.simhash(text.encode() if text is not None else None) == simhash(text)
    df = spark.createDataFrame([("a b c",)], "t string")  # the hash is the engine's own
    assert df.select(F.xxhash64("t")).first()[0] % 2**64 == simhash("a b c")


@pytest.mark.parametrize("bits", [0, 1, 3, 5])
def test_walk_finds_every_link(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    flips = [base]
    for k in range(1, 7):
        y = base[: 40 * k].copy()
        for _ in range(k):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
        flips.append(y)
    cluster = np.uint64(0xABCDEF0123456789) ^ rng.integers(0, 64, 60, dtype=np.uint64)  # dense at the last bits
    p = np.unique(np.concatenate([*flips, cluster, np.array([0, 2**64 - 1], np.uint64)]))
    found = []
    simhash_trie.walk(p, (0, len(p)), (0, len(p)), 0, bits, bits, lambda a, b: found.extend(zip(a.tolist(), b.tolist(), strict=True)))
    i, j = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= bits)
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}


@pytest.mark.parametrize("leaf", [1 << 17, 40])
def test_classes_of_documents(spark, documents, leaf):
    rows = simhash_trie.cluster(documents, leaf_prints=leaf).collect()
    prints = [r["print"] % 2**64 for r in rows]
    assert [r["component"] for r in rows] == classes(prints, [r["id"] for r in rows])
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all(simhash(texts[r["id"]]) == p for r, p in list(zip(rows, prints, strict=True))[:40])


def test_walk_over_many_prints():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    near = base[:100] ^ np.uint64(0b1011 << 20)
    p = np.unique(np.concatenate([base, near]))
    found = []
    simhash_trie.walk(p, (0, len(p)), (0, len(p)), 0, 3, 3, lambda a, b: found.extend(zip(p[a].tolist(), p[b].tolist(), strict=True)))
    assert {frozenset(x) for x in found} >= {frozenset(x) for x in zip(base[:100].tolist(), near.tolist(), strict=True)}


def test_chains_are_one_class(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 99), (99, 98), (200, 201)]
    got = {r["node"]: r["label"] for r in simhash_trie.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 98 for i in (98, 99, 100)}, 200: 200, 201: 200}


def test_one_row_of_a_class_stays_without_ids_and_with_equal_ids(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(None, same), (None, same), (4, same), (3, same + " "), (3, same), (None, "apart " * 9 + "from it"), (7, "a lone text of its own")]
    rows += [(None, "no id here at all, but a text"), (None, "no id here at all, but a  text")]
    kept = simhash_trie.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), max_bits=0).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "7", "None", "None"]
    assert {r["text"].split()[0] for r in kept if r["doc_id"] is None} == {"apart", "no"}


def test_simhash_odd_and_empty(odd, none):
    rows = simhash_trie.cluster(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component"] for r in rows if r["print"] == 0} == {2}  # null and empty texts link
    assert simhash_trie.cluster(none).count() == 0 and simhash_trie.keep_one(none).count() == 0
    kept = simhash_trie.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 2, 5, 6, 7, 8]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_components_of_a_star_and_a_chain(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash_trie, "MAX_LABELS", limit)
    star = [(0, i) for i in range(1, 300)]
    chain = [(1000 + i, 1001 + i) for i in range(40)]
    edges = spark.createDataFrame([*star, *[c[::-1] for c in chain], (-5, -3)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash_trie.components(edges).collect()}
    assert got == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(1000, 1041), 1000), -5: -5, -3: -5}


# ------------------------------------------------------------ lines

LONG = "This line is long enough to count, and here it is again"


def line_docs():
    docs = [(i, f"own line {i} that nobody else has but that is long enough\n{LONG}\nshort") for i in range(6)]
    docs.append((6, f"  {LONG.upper()}\t\n{LONG}\n{LONG}\n"))
    docs += [(7, None), (8, ""), (9, "x" * 39 + "\n" + "é" * 40)]
    docs += [(10 + i, "é" * 40 + "\n" + "x" * 39) for i in range(5)]
    return docs


@pytest.mark.parametrize("limit", [96 << 20, 0])  # 0: by a join
def test_lines_by_definition(spark, limit):
    docs = line_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = line_mph.dedup_lines(df, max_broadcast_bytes=limit, shard_keys=1)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["h"]) for r in out.withColumn("h", line_mph.digest()).collect()}
    assert got == line_mph.brute_force(docs)
    assert got[6][1] == 0 and got[0][1] == 1 and got[9][1] == 1


@pytest.mark.parametrize("limit", [96 << 20, 0])
def test_lines_odd_and_empty(spark, odd, none, limit):
    out = line_mph.dedup_lines(odd, min_docs=2, max_broadcast_bytes=limit)
    assert out.columns.count("kept_text") == 1
    rows = out.collect()
    assert len(rows) == len(ODD)
    first = ODD[0][1]
    assert {(r["doc_id"], r["n_dropped"]) for r in rows if r["text"] == first} == {(1, 0), (None, 1)}
    assert line_mph.dedup_lines(none, max_broadcast_bytes=limit).count() == 0


def test_lines_beyond_the_broadcast_probe_their_shards(spark, documents, monkeypatch):
    """No join of lines; a line of all documents is dealt over many tasks."""
    monkeypatch.setattr(line_mph, "GROUP_LINES", 50)
    common = "A line that all of the documents hold, of more than forty code points."
    docs = documents.select("doc_id", F.concat(F.lit(common + "\n"), "text", F.lit("\n" + common)).alias("text"))
    wanted = line_mph.brute_force([(r[0], r[1]) for r in docs.collect()])
    out = line_mph.dedup_lines(docs, max_broadcast_bytes=0, shard_keys=3)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["d"]) for r in out.withColumn("d", line_mph.digest()).collect()}
    assert got == wanted and all(n[1] >= 2 for i, n in got.items() if i != max(got))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "h1" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 64, 5000):
        h = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
        mph = line_mph.PerfectHash.build(*h)
        assert sorted(mph.index(*h).tolist()) == list(range(n))


# ------------------------------------------------------------ Katz


def katz_by_definition(rows, train):
    one, two, after = collections.Counter(), collections.Counter(), collections.Counter()

    def tokens(t):
        return [*katz.WORD.findall((t or "").encode().lower()), "</s>"]

    for i, t in rows:
        if train(i):
            h = "<s>"
            for w in tokens(t):
                one[w] += 1
                two[h, w] += 1
                after[h] += 1
                h = w
    n, v = sum(one.values()), len(one)
    d1, d2 = (katz.good_turing([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in (one, two))
    kept = sum(d1[min(c, 6)] * c for c in one.values())
    total = n + 1 if kept >= n - 1e-9 else n
    free = 1 - kept / total

    def p1(w):
        return d1[min(one[w], 6)] * one[w] / total if one[w] else free

    followers = collections.defaultdict(list)
    for (h, w), c in two.items():
        followers[h].append((w, c))
    weights = {}
    for h, own in followers.items():
        mass = sum(d2[min(c, 6)] * c for _, c in own)
        t = after[h] + 1 if mass >= after[h] - 1e-9 * after[h] else after[h]
        weights[h] = ((1 - mass / t) / (1 - sum(p1(w) for w, _ in own)), t)
    for h in list(followers)[:20]:  # the probabilities after a history add up to one
        seen = {w for w, _ in followers[h]}
        assert abs(sum(d2[min(c, 6)] * c / weights[h][1] for _, c in followers[h]) + weights[h][0] * (sum(p1(w) for w in one if w not in seen) + free) - 1) < 1e-9
    out = collections.Counter()
    for i, t in rows:
        h, known, base, score = "<s>", 0, 0.0, 0.0
        for w in tokens(t):
            c = two[h, w]
            score += math.log10(d2[min(c, 6)] * c / weights[h][1] if c else (weights[h][0] if h in weights else 1) * p1(w))
            base += math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1)))
            known += one[w] > 0
            h = w
        out[i, len(tokens(t)), known, n, round(base, 6), round(score, 6)] += 1
    return out


def scored(df, **options):
    rows = katz.score(df, fold(F.col("doc_id"), 10) != 0, **options).collect()
    names = ("id", "n_tokens", "n_known", "train_tokens")
    return collections.Counter((*[r[c] for c in names], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)


def trained(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0


@pytest.mark.parametrize("part_tokens", [5_000_000, 3_000])  # one partition; many, with frequent histories dealt
def test_katz_by_definition(spark, documents, monkeypatch, part_tokens):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert scored(df, part_tokens=part_tokens) == katz_by_definition(rows, trained)


def katz_scores(rows, train, order):
    """log10 probabilities by the recursion, one n-gram table per length."""

    def grams(t, k):
        words = ["<s>"] * (k - 1) + [*katz.WORD.findall((t or "").encode().lower()), "</s>"]
        return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]

    seen = [collections.Counter(g for i, t in rows if train(i) for g in grams(t, k)) for k in range(1, order + 1)]
    d = [katz.good_turing([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in seen]
    after = collections.defaultdict(list)
    for c in seen[1:]:
        for g, n in c.items():
            after[g[:-1]].append((g[-1], n))
    n1 = sum(seen[0].values())
    kept1 = sum(d[0][min(c, 6)] * c for c in seen[0].values())
    total1 = n1 + 1 if kept1 >= n1 - 1e-9 else n1
    weights = {}

    def p(h, w):
        c = seen[len(h)][*h, w]
        if not h:
            return d[0][min(c, 6)] * c / total1 if c else 1 - kept1 / total1
        if h not in after:
            return p(h[1:], w)
        if h not in weights:
            t, kept = sum(x for _, x in after[h]), sum(d[len(h)][min(x, 6)] * x for _, x in after[h])
            t += kept >= t - 1e-9 * t
            weights[h] = t, (1 - kept / t) / (1 - sum(p(h[1:], x) for x, _ in after[h]))
        t, alpha = weights[h]
        return d[len(h)][min(c, 6)] * c / t if c else alpha * p(h[1:], w)

    return collections.Counter((i, round(sum(math.log10(p(g[:-1], g[-1])) for g in grams(t, order)), 5)) for i, t in rows)


@pytest.mark.parametrize(("order", "part_tokens"), [(2, 3_000), (3, 5_000_000), (3, 3_000), (4, 6_000)])
def test_katz_of_any_order(spark, documents, order, part_tokens):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").limit(60).collect()] + [r[:2] for r in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = katz.score(df, fold(F.col("doc_id"), 10) != 0, part_tokens=part_tokens, order=order).collect()
    assert collections.Counter((r["id"], round(r["score"], 5)) for r in out) == katz_scores(rows, trained, order)


def test_katz_odd_and_empty(spark, odd, none):
    assert scored(odd) == katz_by_definition([r[:2] for r in ODD], trained)
    assert scored(none) == {}
    rows = katz.score(odd, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows} == {(0, 0, 0.0, 0.0)}


# ------------------------------------------------------------ pages

ARTICLE = "<article class='post'><header><h1>A &amp; B</h1></header><p>First  <b>bold</b>\n text<p>Second<br>line &copy; x<ul><li>one<li>two</ul><aside>side</aside></article>"
PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li>menu</li></ul></nav><!-- <p>comment</p> --><div class="cookie-notice">cookies</div>
<div class="ad">buy</div>{ARTICLE}<form><input value=x><label>mail</label></form>
<section id="comments"><article class="comment"><p>reader</p></article></section><footer>&copy; us</footer></body></html>"""
TEXT = ["A & B", "First bold text", "Second", "line © x", "one", "two"]


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (PAGE, TEXT),
        (PAGE[: PAGE.index("</footer>")], TEXT),  # cut off in the footer
        (PAGE.replace("article", "main", 1).upper().replace("&AMP;", "&amp;").replace("&COPY;", "&copy;"), [x.upper() for x in TEXT]),
        ("", []),
        (None, []),
        ("plain &lt;text&gt; only", ["plain <text> only"]),
        ("<div>a<span>b</span> c</div>tail<p>open <a href='x>y'>link", ["ab c", "tail", "open link"]),
        ("<p>x</p><script>unclosed <p>y</p>", ["x"]),
        ("a < b and c > d <p>1 &amp 2 &#233; &am", ["a < b and c > d", "1 & 2 é &am"]),
        ("<p>kept</p><p>cut <a href=", ["kept", "cut"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ],
)
def test_lines_of_a_page(page, lines):
    assert html_diff.lines_of(page)[0] == lines


def test_marked_parts_are_read_as_a_whole_where_they_hold_the_text():
    main = "<main><h1>Title</h1><p>Lead of the text.</p><article><p>Middle part.</p></article><p>Last section.</p></main>"
    assert html_diff.lines_of(f"<p>menu</p>{main}") == (["Title", "Lead of the text.", "Middle part.", "Last section."], True)
    cards = "".join(f"<article><a href=x>Teaser {i}</a></article>" for i in range(3))
    text = "A long main text in a block that nothing marks as the article of its page."
    teasers = [f"Teaser {i}" for i in range(3)]
    assert html_diff.lines_of(f"<div><p>{text}</p></div>{cards}") == ([text, *teasers], False)


def test_longest_common_subsequence():
    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 15)) for _ in range(2))
        mask = html_diff.shared_lines(a, b)
        rest = iter(b.tolist())
        assert mask.sum() == length(a, b) and all(x in rest for x in a[mask].tolist())


PAGES = "page_id long, url string, html string, text string, gone int"


def bare(i, host, body):
    page = f"<div>Home</div><div>All about {host}</div>{body}<p>Imprint of {host}</p>"
    return (i, f"http://{host}/a/{i:05d}.html?x=1", page, "old", 1)


def test_neighbours_give_the_template_away(spark):
    rows = [bare(i, "a.com", f"<p>Article {i} tells something.</p><p>And {i * 7}.</p>") for i in range(900)]
    rows += [bare(5000, "alone.com", "<p>single</p>"), (5001, None, None, "x", 1), (5002, "odd", "", "x", 1), (None, None, "<p>q</p>", "x", 1)]
    rows += [(6000 + i, f"http://c.com/{i}", "<div><p>One article, carried by all the pages of this host.</p></div>", "x", 1) for i in range(3)]
    rows += [rows[0], (7000, "http://a.com/a/00003.htm", PAGE, "x", 1)]
    out = html_diff.extract(spark.createDataFrame(rows, PAGES).repartition(5))
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r["page_id"]].add(r["text"])
    assert out.columns == ["page_id", "url", "html", "gone", "text"]
    assert all(got[i] == {f"Article {i} tells something.\nAnd {i * 7}."} for i in range(900))
    assert got[5000] == {"Home\nAll about alone.com\nsingle\nImprint of alone.com"}
    assert got[5001] == got[5002] == {""} and got[None] == {"q"}
    assert all(got[6000 + i] == {"One article, carried by all the pages of this host."} for i in range(3))
    assert got[7000] == {"\n".join(TEXT)}
    assert html_diff.extract(spark.createDataFrame([], PAGES)).count() == 0


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in html_diff.extract(pages).collect()}


def test_article_tags_that_mark_nothing_and_notices_in_marked_articles(spark):
    card = "<!-- <article> --><div hidden><article>x</article></div>"
    rows = [(i, f"http://d.com/{i}", f"{card}<p>Menu of d</p><p>Text number {i} of the host</p><p>Imprint</p>") for i in range(6)]
    quote = "<p>A passage that two pages quote.</p>"
    rows += [
        (100 + i, f"http://e.com/{i}", f"<article><p>Story {i} has words.</p>{quote if i in (2, 3) else ''}<p>Buy our things</p></article>")
        for i in range(6)
    ]
    got = texts(spark, rows)
    assert all(got[i] == f"Text number {i} of the host" for i in range(6))
    stories = {100 + i: f"Story {i} has words." + "\nA passage that two pages quote." * (i in (2, 3)) for i in range(6)}
    assert {i: got[i] for i in stories} == stories


def test_copies_and_short_articles_lose_the_template(spark):
    template = "<div>{}</div>".format("</div><div>".join(f"Long line {k} of the template, on every page" for k in range(30)))
    rows = [(i, f"http://f.com/{i:02d}", f"{template}<p>News {i}</p>") for i in range(8)]
    rows += [(100 + k, f"http://f.com/03?crawl={k}", rows[3][2]) for k in range(12)]
    revised = [(200 + i, f"http://g.com/{i}", f"<div>Menu of g</div><p>{'An article, word for word. ' * 9 * (1 + i // 2)}</p><p>at {i}</p>") for i in range(6)]
    got = texts(spark, rows + revised)
    assert {i: got[i] for i in range(8)} == {i: f"News {i}" for i in range(8)}
    assert all(got[100 + k] == "News 3" for k in range(12))
    # two versions each of three articles: what only the other version has stays
    assert all(got[200 + i].startswith("An article") and got[200 + i].endswith(f"at {i}") for i in range(6))


def test_url_parts():
    assert html_diff.url_parts("HTTP://user@Host.com:80/a%20b/?q#f") == ("host.com", "/a b")
    assert html_diff.url_parts(None) == ("", "") and html_diff.url_parts("x/y?z") == ("", "x/y")


# ------------------------------------------------------------ archives


def page_rows():
    own = "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nhttp://x 0.0.0.0 20080430204825 text/html 5\n"
    rows = [(i, f"http://x.com/{i % 3} a\n", ["<p>dup é</p>", None, "", f"{own}{i}"][i % 4], "e") for i in range(40)]
    return rows + [(None, None, "<p>dup é</p>", "e"), (7, "u", f"{own}7", "e"), (50, "v" * 5000, "long " * 40_000, "e")]


@pytest.mark.parametrize(("archive_bytes", "min_bytes"), [(16 << 20, 0), (300, 0), (300, 5)])
def test_archives_round_trip(spark, archive_bytes, min_bytes):
    import base64

    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3)
    got = arc_convert.round_trip(df, min_bytes, archive_bytes).collect()
    payload = [(r[0], (r[2] or "").encode()) for r in rows]
    groups = collections.defaultdict(list)
    for i, p in payload:
        groups[p].append(i)
    wanted = collections.Counter()
    for p, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        best = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            keeper = len(p) < min_bytes or (i == best and first)
            first = first and not (i == best)
            wanted[i, len(p), digest, "response" if keeper else "revisit", None if keeper else best] += 1
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(tuple(r[c] for c in names) for r in got) == wanted
    assert len({r["record_id"] for r in got}) == len(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_header_lines(version):
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npayload\n\n"
    data = arc_convert.version_block(version, b"old.arc", b"19990102030405")
    data += arc_convert.arc_line(version, b"http://a/b", b"1.2.3.4", b"19990102030405", b"text/html", body) + body + b"\n"
    spaced = arc_convert.arc_line(version, b"http://a/XX", b"1.2.3.4", b"1999", b"text/plain", b"").replace(b"XX", b"x y")
    data += spaced + b"\n\n" + arc_convert.arc_line(version, b"dns:a", b"1.2.3.4", b"19990102030405", b"text/dns", b"cut off")[:-1] + b"\ncut"
    first, second, third = arc_convert.read_arc(data)
    assert first.split() == (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"payload\n\n") and first.version == version
    assert second.url == b"http://a/x y" and second.body == b"" and arc_convert._iso(second.date) == "1999-01-01T00:00:00Z"
    assert third.body == b"cut" and third.declared == 7 and third.split() == (b"", b"cut")


def test_archives_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert arc_convert.round_trip(df).count() == 0


# ------------------------------------------------------------ pipeline


def test_pipeline_by_hand(spark):
    """run() against the stages by brute force, on the small tables."""
    from trestle.llm import decontaminate, poisson_mix, zstd_langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = zstd_langid.learn(docs.where(fold(F.col("doc_id"), 4) != 2))
    classify = zstd_langid.Classifier(model, 0.002)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if not classify(r["text"].encode() if r["text"] is not None else None)[3]]
    holders = collections.defaultdict(set)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    for r in rows:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(r["doc_id"])
    for r in rows:
        r["text"] = "\n".join(x for x in r["text"].split("\n") if len(holders[key(x)]) < 5 or max(holders[key(x)]) == r["doc_id"])
    label = classes([simhash(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    rows = [r for r, c in zip(rows, label, strict=True) if c == r["doc_id"]]
    grams = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words_of(item["text"].encode())
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in grams}

    def hit(text):
        w = decontaminate.words_of(text.encode())
        return any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))

    rows = [r for r in rows if not hit(r["text"])]
    count = collections.Counter(r["source"] for r in rows)
    share = sum(n**0.5 for n in count.values())
    wanted = collections.Counter()
    for r in rows:
        name = "|".join(("mix", str(r["doc_id"]), hashlib.md5(r["text"].encode()).hexdigest()))
        u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
        n = count[r["source"]]
        for c in range(poisson_mix.poisson_count(u, n**0.5 / share * len(rows) / n)):
            wanted[r["doc_id"], r["text"], c + 1] += 1
    out = corpus_pipeline.run(spark, SF)
    assert collections.Counter((r["doc_id"], r["text"], r["copy"]) for r in out.collect()) == wanted


def test_stages_take_odd_and_empty_rows(spark, odd, none):
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, SF).columns == df.columns, name
            stage(spark, df, SF).count()
        assert set(df.columns) <= set(corpus_pipeline.STAGES[-1][1](spark, df, SF).columns)
