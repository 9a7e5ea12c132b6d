"""Fonts of lines, tokens and words out of noisy observations."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import dealt


def style_consensus(lines: DataFrame, region: str, italic: str, scores: dict[str, str], margin: float = 0.04, share: float = 0.6) -> DataFrame:
    """region, slant, weight, observed: one decision out of a region's lines.

    scores: columns with a line's distance to the regular, light and bold candidate. A weight besides regular needs that
    margin over it on that share of lines, two at least (one of a single line); of two such the larger mean margin (nine decimals) counts. Lines
    without scores aren't observed; a region without observed lines is unknown (null).
    """
    regular = F.col(scores["regular"])
    seen = regular.isNotNull()
    over = {w: regular - F.col(scores[w]) for w in ("light", "bold")}
    made = lines.groupBy(region).agg(
        F.count_if(seen).alias("observed"),
        F.avg(F.when(seen, F.col(italic).cast("double"))).alias("italic"),
        *[F.count_if(seen & (x >= margin)).alias(f"{w}_votes") for w, x in over.items()],
        *[F.round(F.avg(F.when(seen, x)), 9).alias(f"{w}_mean") for w, x in over.items()],
    )
    n = F.col("observed")
    needed = F.when(n == 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(n * share - 1e-9)))
    light, bold = F.col("light_votes") >= needed, F.col("bold_votes") >= needed
    weight = F.when(light & (~bold | (F.col("light_mean") >= F.col("bold_mean"))), "light").when(bold, "bold").otherwise("regular")
    slant = F.when(F.col("italic") >= 0.5, "italic").otherwise("normal")
    return made.select(region, F.when(n > 0, slant).alias("slant"), F.when(n > 0, weight).alias("weight"), "observed")


def token_fonts(tokens: DataFrame, glyphs: DataFrame, page: str) -> DataFrame:
    """page, token, font: of tokens (token, text) the font of the candidate glyphs (glyph_index, text, font) they align with.

    The compact texts of both sides of a page are aligned by matching blocks. A token counts if its signs lie in
    one run of the candidate, in one font, and nowhere else in a run of another font.
    """

    def compact(rows: pd.DataFrame, order: str) -> tuple[str, np.ndarray]:
        text, owner = [], []
        for n, x in enumerate(rows.sort_values(order)["text"]):
            bare = "".join((x or "").split())
            text.append(bare)
            owner += [n] * len(bare)
        return "".join(text), np.array(owner, int)

    def align(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.rename(columns={"glyph_page": page})
        if a.empty or b.empty:
            return pd.DataFrame(columns=[page, "token", "font"])
        a, b = a.sort_values("token"), b.sort_values("glyph_index")
        (left, owners), (right, glyph_of) = compact(a, "token"), compact(b, "glyph_index")
        place = np.full(len(left), -1)
        for i, j, n in difflib.SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks():
            place[i : i + n] = np.arange(j, j + n)
        fonts = b["font"].to_numpy()
        out = []
        for n, name in enumerate(a["token"]):
            at = place[owners == n]
            if not len(at) or (at < 0).any() or (np.diff(at) != 1).any():
                continue
            here = {fonts[g] for g in glyph_of[at]}
            needle, everywhere, found = right[at[0] : at[-1] + 1], set(), right.find(right[at[0] : at[-1] + 1])
            while found >= 0:
                fonts_there = {fonts[g] for g in glyph_of[found : found + len(needle)]}
                everywhere |= fonts_there if len(fonts_there) == 1 else set()
                found = right.find(needle, found + 1)
            if len(here) == 1 and None not in here and len(everywhere) == 1:
                out.append((a[page].iloc[0], name, here.pop()))
        return pd.DataFrame(out, columns=[page, "token", "font"])

    other = glyphs.select(F.col(page).alias("glyph_page"), F.col("glyph_index"), F.col("text").alias("text"), "font")
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    return dealt(tokens.select(page, "token", "text"), page).groupBy(page).cogroup(dealt(other, "glyph_page").groupBy("glyph_page")).applyInPandas(align, f"`{page}` {kinds[page]}, token {kinds['token']}, font string")


def word_starts(predicted: list[float], candidates: list[tuple[float, float]], reach: float = 12.0) -> list[float] | None:
    """Where words begin: for each prediction the nearest candidate (start, gap before it) within reach and after the one
    before, of equal ones that after the widest gap. None if a word has no such candidate."""
    out: list[float] = []
    for p in predicted:
        near = [(abs(s - p), -gap, s) for s, gap in candidates if abs(s - p) <= reach and (not out or s > out[-1])]
        if not near:
            return None
        out.append(min(near)[2])
    return out
