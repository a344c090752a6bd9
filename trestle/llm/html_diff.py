"""HTML extraction by differencing pages with their nearest neighbours by URL.

Pages of a host that lie next to each other in URL order come from the same
template: what their texts share, line by line and in the same order, is menu,
notice or footer, and what differs is the article.  Each page is cut into text
lines (one per block element), paired with the nearest pages of its host by URL
path, the lines are aligned by longest common subsequence, and shared lines are
deleted.

Markup says more than a neighbour does, so it goes first: scripts, styles,
menus, headers, footers, sidebars, adverts, notices, forms and reader comments
that are marked as such (by element, role, class or id) are dropped, and where a
page marks its article (``article``, ``main``, role or class) and the marked parts
hold most of its text, only they are read, each as a whole.  Differencing decides on the rest.  Neighbours that quote the same passage,
or carry the same article, share it rightly, so a line of a marked article goes
only where all neighbours, and at least three, share it: that is a notice or
advert of the host, or a passage in four pages on end, which can't be told apart.  A
neighbour that holds all lines of a page is a copy of it, not a template mate,
and deletes nothing; what one neighbour shares with almost all the page's text
goes only where a second one shares it.

On Spark: (1) one narrow pass parses pages into line hashes; only these, with
host and path, go on.  Pages of a host with the same lines become one row, so that
copies are no neighbours of each other; the rows are range-partitioned by (host,
path, id), so a host with a third of all pages spreads over many tasks.  (2) ``lag``/``lead`` inside the ranges,
with one row per range carried over, give each page its neighbours; a pandas
function aligns them.  (3) Deletions join all pages of the same lines, and those their pages again; the
text is built in a second parse, so no text is written or shuffled twice.

Very long pages are read in one pass over their tags, in time linear in their length.

Defined results: null html has an empty text; null or odd URLs have an empty
host and are compared among themselves; pages without neighbours keep all lines
that markup doesn't drop; repeated rows and pages with the same lines are copies and get the same text; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.llm.common import quoted, utf8, written

# Element names of the HTML standard, and words that sites use in role, class and id.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_SKIPPED = _RAW | {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "datalist", "dialog", "menu", "svg",
    "math", "canvas", "object", "audio", "video", "map", "fieldset", "input",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br",
}
_CLOSES_P = _BLOCKS - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
_SELF_CLOSING = {  # an open element of the same kind ends where the next one begins
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
_SCOPES = {"ul", "ol", "dl", "table", "select", "article", "body", "nav", "main", "div", "section"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
_NOISE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adsbygoogle", "sponsor",
    "sponsored", "sponsors", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "sidebar", "sidebars", "aside", "footer", "header", "masthead", "topbar", "toolbar", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "newsletter", "subscribe", "subscription",
    "signup", "login", "share", "sharing", "social",
    "related", "recommended", "pagination", "pager", "skip", "widget", "copyright", "legal", "disclaimer", "search", "tags",
}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
_ARTICLE = {"articlebody", "article", "main", "post", "entry", "story"}
_ARTICLE_BODY = {"article-body", "article-content", "post-content", "post-body", "entry-content", "story-body", "main-content"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WHITE = re.compile(r"\s+")
_SPLIT_NAMES = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")


# Elements that hold other blocks and no text of their own kind: words inside their names may speak of layout.
_CONTAINERS = {"div", "ul", "ol", "dl", "table", "span", "center", "details"}


def _marked(name: str, attributes: str, inside: bool = False) -> tuple[bool, bool]:
    """(dropped, article): what an element's name, role, class and id say about it.

    Ids of headings, sections and paragraphs are slugs of what they say, so only a
    class that is a noise word as a whole counts there; words inside class and id
    (``site-footer``) count for containers, and nowhere ``inside`` a marked article.
    """
    if name in _SKIPPED:
        return True, False
    article = name in ("article", "main")
    if not attributes:
        return False, article
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    role = found.get("role", "").lower()
    if role in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, False
    if found.get("itemprop", "").lower() == "articlebody" or role in ("main", "article"):
        return False, True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if names.strip() and name not in ("html", "body"):
        whole = set(names.lower().split())
        classes = set(found.get("class", "").lower().split())
        words = {w.lower() for w in _SPLIT_NAMES.split(names) if w}
        heard = words if name in _CONTAINERS and not inside else whole if name in _CONTAINERS else classes
        if heard & _COMMENTS:
            return True, False
        if whole & _ARTICLE_BODY:
            return False, True
        noise = heard & _NOISE
        if noise == {"header"} and words & _ARTICLE:  # an article's own heading
            noise = set()
        if noise and not article:
            return True, False
        if whole & _ARTICLE and name in ("div", "section"):
            return False, True
    return False, article


def lines_of(page: str | None) -> tuple[list[str], bool]:
    """The text lines of a page that markup doesn't drop, and whether the page marks its article.

    One line per block; white space inside a block is one space.  If the page
    marks an article or main part that holds more than half of the text, all
    lines inside the outermost marks are returned, else all lines of the page.
    """
    lines: list[tuple[str, bool]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, dropped, inside (own or inherited)
    dropped, inside = False, False  # inside an article or the page's main part
    opened: Counter = Counter()  # names in the stack, so that no search runs for what isn't there
    at, text = 0, page or ""

    def flush() -> None:
        if buffer:
            line = _WHITE.sub(" ", entities.unescape("".join(buffer))).strip()
            if line:
                lines.append((line, inside))
            buffer.clear()

    def close(k: int) -> None:
        nonlocal dropped, inside
        if any(e[0] in _BLOCKS for e in stack[k:]):
            flush()
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]
        dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    last = text.rfind(">") + 1  # no tag ends behind it
    for m in iter(lambda: _TAG.search(text, at, last), None):
        if m.start() > at and not dropped:
            buffer.append(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            if not dropped and m[0].startswith("<![CDATA["):
                buffer.append(entities.escape(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:]))
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name in _BLOCKS:
                flush()
            continue
        if opened["p"] and name in _CLOSES_P and name not in ("li", "dd", "dt"):
            _end_of_p(stack, close)
        if name in _SELF_CLOSING and any(opened[x] for x in _SELF_CLOSING[name]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SELF_CLOSING[name]:
                    close(k)
                    break
                if stack[k][0] in _SCOPES:
                    break
        if name in _BLOCKS:
            flush()
        if name in _VOID:
            continue
        drops, marks = _marked(name, m[3], inside)
        if name in _RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if name == "header" and inside:  # the article's own heading; a menu or form in it goes by itself
            drops = False
        if marks and not dropped:
            flush()
        stack.append((name, dropped or drops, inside or marks))
        opened[name] += 1
        dropped, inside = stack[-1][1], stack[-1][2]
    if at < len(text) and not dropped:
        rest = text[at:]
        cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)  # a tag that the page's end cuts off
        buffer.append(rest[: cut.start()] if cut else rest)
    flush()
    own = [x for x, k in lines if k]
    marked = 2 * sum(map(len, own)) > sum(len(x) for x, _ in lines)
    return own if marked else [x for x, _ in lines], marked


def _end_of_p(stack: list, close) -> None:
    """A block element ends an open paragraph."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == "p":
            close(k)
            return
        if stack[k][0] in _BLOCKS:
            return


def shared_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Mask of the lines of ``own`` in a longest common subsequence with ``other`` (arrays of line hashes).

    Lines outside of the common start and end that only one page has can't be
    in it and are left out; the rest goes through Hirschberg's method, in
    memory linear in the number of lines.
    """
    mask = np.zeros(len(own), bool)
    i, j = np.flatnonzero(np.isin(own, other)), np.flatnonzero(np.isin(other, own))
    mask[i[_lcs(own[i], other[j])]] = True
    return mask


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        match = np.concatenate(([0], np.where(b == x, row[:-1] + 1, 0)))
        row = np.maximum.accumulate(np.maximum(row, match)).astype(np.int32)
    return row


def _lcs(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of ``a`` in a longest common subsequence with ``b``."""
    todo, out = [(0, len(a), 0, len(b))], []
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out.append(a1 - 1)
            a1, b1 = a1 - 1, b1 - 1
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            if (b[b0:b1] == a[a0]).any():
                out.append(a0)
            continue
        mid = (a0 + a1) // 2
        ahead = _lengths(a[a0:mid], b[b0:b1])
        behind = _lengths(a[mid:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(np.argmax(ahead + behind))
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def url_parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL, lower-case host, without scheme, port, user, query and fragment."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)", url or "")
    return (m[1].lower(), unquote(m[2]).rstrip("/")) if m else ("", unquote(re.split(r"[?#]", url or "")[0]).rstrip("/"))


def _hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines]


def deletions(hashes: np.ndarray, sizes: np.ndarray, neighbours: list[np.ndarray], copy_share: float = 0.9, marked: bool = False) -> list[int]:
    """Lines of a page that are shared with a neighbour, the nearest ones first; copies of the page don't count.

    A neighbour that holds all lines of the page is a copy.  One that shares
    ``copy_share`` of its text may be an edited copy or a short article in the
    same long template, so what only this one shares stays.  Of a marked article, only lines that all of at least ``MARKED_VOTES``
    neighbours share go: fewer quote the same passage.
    """
    votes, voters = np.zeros(len(hashes), np.int32), 0
    sure = np.zeros(len(hashes), bool)
    for other in neighbours:
        if other is None or not len(other) or not len(hashes):
            continue
        shared = shared_lines(hashes, other)
        if not shared.all():
            votes += shared
            voters += 1
            if sizes[shared].sum() < copy_share * sizes.sum():
                sure |= shared
    return np.flatnonzero(votes >= max(MARKED_VOTES, voters) if marked else sure | (votes > 1)).tolist()


#: Line hashes of a range's pages and their neighbours, about.
RANGE_BYTES = 4 << 20
MARKED_VOTES = 3  # neighbours that must share a line of a marked article before it goes

_PARSED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("page", T.LongType()),
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("marked", T.BooleanType()),
        T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
    ]
)


def _parsed(pages: DataFrame) -> DataFrame:
    """Host, path and line hashes of each page, and whether it marks its article; ``page`` is a hash of URL and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            taken = []
            for i, (url, raw) in enumerate(zip(b.column(2).to_pylist(), utf8(b.column(3)), strict=True)):
                if raw is None:
                    continue
                lines, marked = lines_of(raw.decode("utf-8", "replace"))
                taken.append(i)
                for column, value in zip(rows, (*url_parts(url), marked, _hashes(lines), [len(x) for x in lines]), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            made = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
            at = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *made], names=_PARSED.fieldNames())

    return pages.select("id", "page", "url", "html").mapInArrow(run, _PARSED)


def _distinct(parsed: DataFrame) -> DataFrame:
    """One row for all pages of a host with the same lines, where the first of them lies; ``lines`` is their key."""
    rest = [F.first(c).alias(c) for c in ("marked", "hashes", "sizes")]
    one = parsed.groupBy("host", "lines").agg(F.min(F.struct("path", "id", "page")).alias("at"), *rest)
    return one.select("at.id", "at.page", "host", "at.path", "marked", "hashes", "sizes", "lines")


def _neighbours(parsed: DataFrame, distance: int) -> DataFrame:
    """``parsed`` with the hashes of up to ``distance`` pages before and after it in (host, path, id) order."""
    order = ["host", "path", "id", "page"]
    lines = parsed.agg(F.sum(F.size("hashes").cast("long"))).first()[0] or 0
    parts = max(1, -(-lines * 8 * (1 + 2 * distance) // RANGE_BYTES))  # a row travels with its neighbours' hashes
    dealt = written(parsed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    numbers = dealt.select("part").distinct().withColumn("range", F.row_number().over(Window.orderBy("part")))
    ranged = dealt.join(F.broadcast(numbers), "part").drop("part")  # one row per range: no gaps in the numbers
    # the last and first rows of each range, repeated in the range after and before it
    inside = Window.partitionBy("range")
    place = ranged.select("range", *order).withColumns(
        {
            "first": F.row_number().over(inside.orderBy(*order)),
            "last": F.row_number().over(inside.orderBy(*[F.col(c).desc() for c in order])),
        }
    )
    edge = place.where((F.col("first") <= distance) | (F.col("last") <= distance)).select("range", *order)
    rim = ranged.join(F.broadcast(edge.distinct()), ["range", *order])  # 2 * distance rows per range
    halo = rim.select(*parsed.columns, F.explode(F.array(F.col("range") - 1, F.col("range") + 1)).alias("range"))
    both = ranged.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)))
    line = Window.partitionBy("range").orderBy(*order)
    near = []
    for k in range(1, distance + 1):
        for shift in (F.lag, F.lead):
            there = F.struct("host", "path", "hashes")
            near.append(shift(there, k).over(line).alias(f"n{len(near)}"))
    return both.select("*", *near).where("own").drop("own", "range")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", distance: int = 2) -> DataFrame:
    """``pages`` with ``text``: the main text of each page; input columns of that name are replaced."""
    kept = [c for c in pages.columns if c != "text"]
    keyed = pages.select(
        *[F.col(quoted(c)) for c in kept],
        F.col(quoted(id_col)).cast("long").alias("__id"),
        F.xxhash64(quoted(url_col), quoted(html_col)).alias("__page"),
    )
    parsed = _parsed(
        keyed.select(
            F.col("__id").alias("id"), F.col("__page").alias("page"), F.col(quoted(url_col)).alias("url"), F.col(quoted(html_col)).alias("html")
        )
    )

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                near = []
                for i, n in enumerate(r[len(_PARSED.fields) + 1 :]):
                    if n is not None and n["host"] == r.host and (r.marked or i < 2 * distance):
                        common = _common_prefix(r.path, n["path"])
                        near.append((-common, len(near), np.asarray(n["hashes"], np.int64)))
                near = near[: 2 * max(distance, 2)]  # at the end of a host, a marked page looks further on the other side
                own = np.asarray(r.hashes, np.int64)
                gone = deletions(own, np.asarray(r.sizes, np.int64), [h for _, _, h in sorted(near, key=lambda x: x[:2])], marked=r.marked)
                if gone:
                    rows.append((r.host, r.lines, gone))
            yield pd.DataFrame(rows, columns=["host", "lines", "__gone"])

    compared = written(parsed.withColumn("lines", F.xxhash64("marked", "hashes")))
    if compared.isEmpty():
        joined = keyed.withColumn("__gone", F.lit(None).cast("array<int>"))
    else:
        near = _neighbours(written(_distinct(compared)), max(distance, MARKED_VOTES))
        found = near.mapInPandas(align, "host string, lines long, __gone array<int>")
        each = compared.select(F.col("id").alias("__gone_id"), F.col("page").alias("__gone_page"), "host", "lines")
        found = each.join(found, ["host", "lines"]).drop("host", "lines").dropDuplicates(["__gone_id", "__gone_page"])
        same = F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__page") == F.col("__gone_page"))
        joined = keyed.join(found, same, "left").drop("__gone_id", "__gone_page")
    source = joined.select(*[F.col(quoted(c)) for c in kept], "__gone")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType(), True)])
    at = kept.index(html_col)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, gone in zip(utf8(b.column(at)), b.column(len(kept)).to_pylist(), strict=True):
                lines, _ = lines_of(raw.decode("utf-8", "replace") if raw else None)
                drop = set(gone or ())
                out.append("\n".join(x for i, x in enumerate(lines) if i not in drop))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(build, schema)


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n
