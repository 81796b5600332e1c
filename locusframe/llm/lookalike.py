"""One form for texts that look the same on the screen.

The form is a skeleton: invisible characters go, the text is decomposed, every character is replaced
by the prototype of its look-alikes, and the result is decomposed again.  Texts with equal skeletons
look the same.  Skeletons are compared by 128-bit hashes, so whole texts never travel.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.session import cut_lineage

# Letters of other scripts and the Latin letters of the same shape, pairwise.
CYRILLIC = "АВЕЅІЈКМНОРСТХҮаеорсухѕіјһԁԛԝґ"
CYRILLIC_AS = "ABESIJKMHOPCTXYaeopcyxsijhdqwr"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ"
GREEK_AS = "ABEZHIKMNOPTYXovj"
ARMENIAN = "օսոհցյ"
ARMENIAN_AS = "ounhgj"
OTHER_LETTERS = "ӀӏԌɑɡıℓⅼⅽⅾⅿⅰⅴⅹⅠⅤⅩⅬⅭⅮⅯ"
OTHER_LETTERS_AS = "IlGagillcdmivxIVXLCDM"

MORE_CYRILLIC, MORE_CYRILLIC_AS = "\u04af\u0475\u0474\u051a\u051c", "yvVQW"
MORE_GREEK, MORE_GREEK_AS = "\u03b1\u03b3\u03b9\u03c1\u03c3\u03c5\u03f2\u03f9\u037f", "ayipoucCJ"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ"
CHEROKEE_AS = "DRTiAJEWMHYGhZbRWSVSLCPKdGB"
LISU = "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPdDTGKJCZFMNLSRVHWXYAEIOU"
COPTIC = "ⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ"
COPTIC_AS = "BHIKMNOoPpCcTYX"

# Characters that show nothing beside those of the category Cf.
BLANKS = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]


STRETCH = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")


@lru_cache(maxsize=1)
def invisible() -> dict[int, None]:
    """Translation that drops characters without a shape."""
    hidden = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" and unicodedata.name(chr(c), "").find("NUMBER SIGN") < 0]
    return dict.fromkeys([*hidden, *BLANKS])


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """Translation of decomposed text to prototypes: widths, ligatures, spaces, letters of other scripts."""
    table: dict[int, str] = {}
    font: dict[int, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        kind, _, rest = unicodedata.decomposition(ch).partition(" ")
        if unicodedata.category(ch) == "Zs":
            table[cp] = " "
        elif kind in ("<wide>", "<narrow>"):
            table[cp] = unicodedata.normalize("NFKD", ch)
        elif kind == "<compat>" and " " in rest and unicodedata.category(ch)[0] == "L" and ("LIGATURE" in (name := unicodedata.name(ch)) or "DIGRAPH" in name or "WITH SMALL LETTER" in name):
            table[cp] = unicodedata.normalize("NFKD", ch)
        elif kind == "<font>" and unicodedata.category(ch)[0] == "L":
            font[cp] = unicodedata.normalize("NFKD", ch)
    pairs = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (OTHER_LETTERS, OTHER_LETTERS_AS), (MORE_CYRILLIC, MORE_CYRILLIC_AS), (MORE_GREEK, MORE_GREEK_AS))
    for own, like in (*pairs, (CHEROKEE, CHEROKEE_AS), (LISU, LISU_AS), (COPTIC, COPTIC_AS)):
        table.update(zip(map(ord, own), like, strict=True))
    # letters of a mathematical alphabet look like what the ordinary letter looks like
    return {cp: ch.translate(table) for cp, ch in font.items()} | table


def _worked(part: str) -> str:
    plain = unicodedata.normalize("NFD", part.translate(invisible()))
    return unicodedata.normalize("NFD", plain.translate(prototypes()))


_remembered = lru_cache(maxsize=1 << 16)(_worked)


def skeleton(text: str) -> str:
    """The one form of all texts that look like ``text``.

    Only stretches of other characters than ASCII, each with the character before it that marks may
    combine with, are worked on: decomposition never reaches across an ASCII character.
    """
    if text.isascii():
        return text
    return STRETCH.sub(lambda m: (_remembered if len(m[0]) < 64 else _worked)(m[0]), text)


def skeletons(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "form") -> DataFrame:
    """``key`` and the one form of ``text``; null stays null, empty stays empty; one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [None if t is None else skeleton(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string())], names=[key, out])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, `{out}` string")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, the 128-bit hash of the skeleton (s1, s2) and the 64-bit hash of the text (t) of texts with a visible character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], ([], [], [])
            for i, t in enumerate(b.column(1).to_pylist()):
                form = "" if t is None else skeleton(t)
                if not form.strip():
                    continue
                h = xxhash.xxh3_128_intdigest(form.encode("utf-8", "surrogatepass"))
                at.append(i)
                cols[0].append(_signed(h >> 64))
                cols[1].append(_signed(h & (1 << 64) - 1))
                cols[2].append(_signed(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=[key, "s1", "s2", "t"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, s1 bigint, s2 bigint, t bigint")


def look_alikes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (key_a < key_b) of different texts that look the same.

    Texts without a visible character and null texts or keys are in no pair; equal texts are none
    either, so repeated rows and exact copies add only their own links to texts that differ.  Pairs
    are formed between classes of equal texts first and then spelled out, so a text with many copies
    costs no more than the links it has.  Further columns aren't read.
    """
    own = cut_lineage(hashed(docs.filter(F.col(key).isNotNull()), key, text).distinct())
    shared = own.groupBy("s1", "s2").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("s1", "s2")
    members = own.join(shared, ["s1", "s2"], "left_semi")
    classes = members.select("s1", "s2", "t").distinct()
    links = classes.alias("a").join(classes.alias("b"), ["s1", "s2"]).filter("a.t < b.t").select("s1", "s2", F.col("a.t").alias("ta"), F.col("b.t").alias("tb"))
    first = members.select("s1", "s2", F.col("t").alias("ta"), F.col(key).alias("_a"))
    second = members.select("s1", "s2", F.col("t").alias("tb"), F.col(key).alias("_b"))
    pairs = links.join(first, ["s1", "s2", "ta"]).join(second, ["s1", "s2", "tb"]).filter("_a <> _b")
    return pairs.select(F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b")).distinct()
