"""Language identification by compression with per-language dictionaries.

For each language a raw-content zstandard dictionary is filled with training
texts.  A text is encoded with every dictionary, piece by piece and whole; the
language whose dictionary gives the fewest bytes wins.  Narrow margins are
rejected (``rejected``).  Texts are folded first: lower case, anything but
letters to single spaces, so that shouting, tables and symbols don't decide.

The dictionaries are a bounded sample of the labelled rows: about
``sample_docs`` texts a language, chosen by a hash of the id, at most an eighth
of the dictionary each, up to ``dict_bytes`` a language.  Of a longer text,
pieces that are spread over its whole length count, the first to the last.  The broadcast model is
at most ``dict_bytes`` times the number of languages.

Defined results: null texts and texts without letters are ``und`` with score 0,
rejected; so is everything if there is no labelled row.  Equal sizes go to the
language with more training rows (then by name), and are rejected.  With one
learned language nothing else is rejected.  Input columns named like an output
column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trestle.llm.common import annotate, key_text

UNKNOWN = "und"
FIELDS = [
    ("lang_pred", T.StringType()),
    ("score", T.DoubleType()),
    ("margin", T.DoubleType()),
    ("rejected", T.BooleanType()),
]
_PIECES = 8  # of a long training text
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters stay (folded), other ASCII becomes a space, bytes of non-ASCII characters stay.
_FOLD = bytes(ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))


@dataclass(frozen=True)
class Model:
    """Dictionary content per language, languages with more training rows first."""

    content: tuple[tuple[str, bytes], ...]
    level: int = 3
    piece: int = 2048  # bytes encoded at a time; the dictionary counts the same all along a long text


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def _pieces(text: Column, size: int) -> Column:
    """The text as one piece, or ``_PIECES`` pieces at even distances where it has more than ``size`` bytes."""
    length = max(1, size // _PIECES - 1)
    room = F.greatest(F.char_length(text) - length, F.lit(0))
    starts = [F.floor(room * k / (_PIECES - 1)).cast("int") + 1 for k in range(_PIECES)]
    spread = F.array(*[F.substr(text, start, F.lit(length)) for start in starts])
    return F.when(F.octet_length(text) > size, spread).otherwise(F.array(text))


def learn(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dict_bytes: int = 128 << 10,
    sample_docs: int = 400,
    max_languages: int = 500,
) -> Model:
    """A model from the rows of ``labelled`` that have a text and a language."""
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_text(F.col(id_col))).alias("h")
    ).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Model(())
    cut = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < cut[F.col("lang")] * (1 << 30)).select(
        "lang", "h", _pieces(F.col("text"), dict_bytes // 8).alias("pieces")
    )
    texts: dict[str, list[bytes]] = {}
    for r in sample.orderBy("h", "pieces").toLocalIterator():
        most = dict_bytes // 8 if len(r["pieces"]) == 1 else max(1, dict_bytes // 8 // _PIECES - 1)
        texts.setdefault(r["lang"], []).append(b" ".join(folded(p)[:most] for p in r["pieces"])[: dict_bytes // 8])
    content = []
    for lang in sorted(texts, key=lambda k: (-counts[k], k)):
        own, room = [], dict_bytes
        for t in dict.fromkeys(texts[lang]):
            if t and len(t) < room:
                own.append(t)
                room -= len(t) + 1
        content.append((lang, b" ".join(own)))
    return Model(tuple((k, c) for k, c in content if len(c) >= 8))


class Classifier:
    def __init__(self, model: Model, min_margin: float) -> None:
        self.piece, self.min_margin = model.piece, min_margin
        self.coders = []
        for lang, content in model.content:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=model.level)
            coder = zstandard.ZstdCompressor(
                level=model.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.coders.append((lang, coder.compress))

    def __call__(self, raw: bytes | None) -> tuple[str, float, float, bool]:
        text = raw.decode("utf-8", "replace") if raw else ""
        if not self.coders or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, True
        data = folded(text)
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        sizes = [sum(len(code(p)) for p in pieces) for _, code in self.coders]
        best = min(sizes)
        at = sizes.index(best)  # the first of equals: more training rows
        if len(sizes) == 1:
            return self.coders[0][0], 1.0, 1.0, False
        margin = min(s for i, s in enumerate(sizes) if i != at) - best
        # the share of 2**(-size/2): 2 bytes less are twice as likely
        score = 1.0 / sum(2.0 ** (-min(1000, s - best) / 2) for s in sizes)
        return self.coders[at][0], score, margin / best, margin < max(1.0, self.min_margin * best)


def identify(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = 0.002) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``rejected``.

    ``margin`` is the second-best size less the best, relative to the best; a
    margin under ``min_margin`` or under one byte is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        classify = Classifier(shared.value, min_margin)

        def score(texts: list[bytes | None]) -> list[pa.Array]:
            found = [classify(t) for t in texts]
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            return [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]

        return score

    return annotate(docs, text_col, FIELDS, make)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the documents that are rejected; the columns of ``docs``."""
    original = docs.columns
    keyed = docs.withColumnsRenamed({c: f"__in_{i}" for i, c in enumerate(original)})
    found = identify(keyed, model, text_col=f"__in_{original.index('text')}").where("not rejected")
    return found.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(original)])
