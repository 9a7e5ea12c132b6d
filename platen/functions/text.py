"""Text scalars: decoding, keys, names, normalisation. Spans count code points."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that end a line.
LINE_ENDS = "\n\x0b\x0c\r\x85\u2028\u2029"
#: The faces that a base font may declare after a hyphen.
FACES = ("BoldItalic", "BoldOblique", "Regular", "Bold", "Italic", "Oblique")
#: The weights that words in a style stand for, first match first.
WEIGHTS = (
    ("thin", 100), ("extralight", 200), ("ultralight", 200), ("light", 300), ("medium", 500), ("semibold", 600),
    ("demibold", 600), ("extrabold", 800), ("ultrabold", 800), ("black", 900), ("heavy", 900), ("bold", 700),
)
#: What may end a declared font name after its family, and after that.
STYLE_ENDS = "regular|roman|bold|semibold|demibold|light|italic|oblique|bolditalic|boldoblique"
ENCODING_ENDS = "Identity-[HV]|WinAnsiEncoding"


def big_endian(data: Column) -> Column:
    """The number in the last four bytes."""
    return F.conv(F.hex(F.substring(data, -4, 4)), 16, 10).cast("long")


def glyph_codes(data: Column, width: int) -> Column:
    """Codes of width bytes each; a last incomplete one is left out and counted as trailing."""
    whole = F.floor(F.octet_length(data) / width).cast("int")
    codes = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.conv(F.hex(F.substring(data, i * width + 1, F.lit(width))), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.struct(codes.alias("codes"), F.pmod(F.octet_length(data), F.lit(width)).alias("trailing"))


@F.pandas_udf(T.StringType())
def utf16be(data: pd.Series) -> pd.Series:
    """Null for nothing, an odd number of bytes, or a lone surrogate."""

    def one(x: bytes | None) -> str | None:
        try:
            return bytes(x).decode("utf-16-be") if x else None
        except UnicodeDecodeError:
            return None

    return data.map(one).astype(object)


def scalar_range(first: Column, count: Column) -> Column:
    """Whether count code points from first on are all Unicode scalars."""
    last = first + count - 1
    return (count > 0) & (first >= 0) & (last <= 0x10FFFF) & ((last < 0xD800) | (first > 0xDFFF))


def line_end(text: Column) -> Column:
    """0-based place of the first code point that ends a line; null without one."""
    at = F.regexp_instr(text, F.lit(f"[{LINE_ENDS}]"))
    return F.when(at > 0, at - 1)


def base_font(name: Column, requested: Column | None = None) -> Column:
    """family, key (of the family), face and subset of a base font: ABCDEF+Family-Face-Identity-H; null where it can't be classified.

    That is: a sign beyond ASCII, a second plus, nothing left, an identity or a face that still stands between hyphens in the
    family, or a family without key. requested is a family's key: a name that is that family with an unknown end isn't classified either.
    """
    subset = F.nullif(F.regexp_extract(name, r"^([A-Z]{6})\+", 1), F.lit(""))
    rest = F.regexp_replace(name, r"^[A-Z]{6}\+", "")
    bare = F.regexp_replace(rest, r"-Identity-[HV]\z", "")
    ends = "|".join(FACES)
    face = F.nullif(F.regexp_extract(bare, rf"-({ends})\z", 1), F.lit(""))
    stem = F.regexp_replace(bare, rf"-({ends})\z", "")
    key = family_key(stem)
    valid = name.rlike(r"\A\p{ASCII}+\z") & ~F.contains(rest, F.lit("+")) & ~bare.rlike(r"(?i)(^|-)identity-[hv](-|\z)") & ~stem.rlike(rf"(?i)(^|-)({ends})(-|\z)") & key.isNotNull()
    if requested is not None:
        opaque = face.isNull() & (key != requested) & (family_key(F.regexp_extract(stem, r"^(.*)-[^-]+\z", 1)) == requested)
        valid &= ~F.coalesce(opaque, F.lit(False))
    return F.when(valid, F.struct(stem.alias("family"), key.alias("key"), face.alias("face"), subset.alias("subset")))


def font_hypothesis(name: Column) -> Column:
    """family, style and weight that a declared font name suggests."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^[A-Z]{6}\+", ""), rf"(?i)-({ENCODING_ENDS})\z", "")
    low = F.lower(bare)
    weight = F.when(low.rlike("semibold|demibold"), "semibold").when(low.contains("bold"), "bold").when(low.contains("light"), "light").otherwise("regular")
    return F.struct(F.regexp_replace(bare, rf"(?i)[-,]({STYLE_ENDS})\z", "").alias("family"), style_of(bare).alias("style"), weight.alias("weight"))


def family_key(name: Column) -> Column:
    """Letters and digits in lower case without spaces, hyphens and underscores; null for any other sign."""
    return F.when(name.rlike(r"^[A-Za-z0-9 _-]*[A-Za-z0-9][A-Za-z0-9 _-]*$"), F.lower(F.regexp_replace(name, "[ _-]", "")))


def weight_of(style: Column) -> Column:
    """The weight number that a style's name stands for; 400 for none."""
    low = F.replace(F.lower(style), F.lit(" "), F.lit(""))
    out = F.lit(400)
    for word, weight in reversed(WEIGHTS):
        out = F.when(F.contains(low, F.lit(word)), weight).otherwise(out)
    return out


def style_of(name: Column) -> Column:
    return F.when(F.lower(name).rlike("italic|oblique"), "italic").otherwise("normal")


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first differing code point; null for equal texts."""
    n = F.least(F.length(a), F.length(b))
    other = F.array_position(F.zip_with(F.split(F.left(a, n), ""), F.split(F.left(b, n), ""), lambda x, y: x != y), True)
    return F.when(a == b, F.lit(None)).when((n > 0) & (other > 0), (other - 1).cast("int")).otherwise(n)


#: Letters that folding of case turns into others than lower case does.
FOLDS = (("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ŉ", "ʼn"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def folded(text: Column) -> Column:
    """Without case: lower case, and what FOLDS lists."""
    out = F.lower(text)
    for letter, others in FOLDS:
        out = F.replace(out, F.lit(letter), F.lit(others))
    return out


def word_key(text: Column) -> Column:
    """Without white space and case."""
    return folded(F.regexp_replace(text, r"(?U)\s+", ""))


def normalised(markup: Column) -> Column:
    """The words of a text: without tags, marks that lead a line, other signs and case, one space between them."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?i)<img\b[^>]*>", " "), r"<[^>]+>", " ")
    bare = F.regexp_replace(bare, r"(?md)^[#>*+\-]+\s*", "")
    return F.array_join(F.regexp_extract_all(folded(bare), F.lit(r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)?"), 0), " ")


#: Letters that keep within the x-height, that rise over it, and that go below the line.
LOW, HIGH, DEEP = frozenset("acemnorsuvwxz"), frozenset("bdfhklt"), frozenset("gjpqy")


@F.pandas_udf(T.StructType([T.StructField(n, T.BooleanType()) for n in ("xheight", "ascender", "descender", "marks")]))
def letter_features(text: pd.Series) -> pd.DataFrame:
    """What the letters of a text reach, case folded and without their marks: all within the x-height (no marks, no capitals, a letter at
    least), any above it (a capital too), any below the line (a cedilla too), any marks."""
    rows = []
    for x in text:
        whole = x or ""
        bare = unicodedata.normalize("NFD", whole)
        letters = {c.casefold() for c in bare if c.isalpha()}
        marks = {c for c in bare if unicodedata.combining(c)}
        capital = any(c.isalpha() and c.isupper() for c in whole)
        rows.append((bool(letters) and not marks and not capital and letters <= LOW, capital or bool(letters & HIGH), bool(letters & DEEP) or "\N{COMBINING CEDILLA}" in marks, bool(marks)))
    return pd.DataFrame(rows, columns=["xheight", "ascender", "descender", "marks"])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; 1 where one text holds the other."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if x and y and (x in y or y in x):
            return 1.0
        return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.StructType([T.StructField(n, T.BooleanType()) for n in ("left", "right")]))
def directions(text: pd.Series) -> pd.DataFrame:
    """Whether a text has letters that run from the left, and from the right."""
    kinds = [{unicodedata.bidirectional(c) for c in x or ""} for x in text]
    return pd.DataFrame([("L" in k, bool(k & {"R", "AL"})) for k in kinds], columns=["left", "right"])


def escaped(text: Column) -> Column:
    """For a quoted string of typesetting source."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for sign, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out
