"""Page content: width tables, raster identity, code maps, and the fold over text operators of a page."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.operators.grouping import dealt

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def simple_widths(first: Column, widths: Column) -> Column:
    """array<struct<code, width>> of a width list that begins at a code."""
    return F.transform(widths, lambda w, i: F.struct((first + i).cast("long").alias("code"), w.alias("width")))


def run_widths(start: Column, end: Column, width: Column) -> Column:
    """The same of a run of codes of one width."""
    return F.transform(F.sequence(start, end), lambda c: F.struct(c.cast("long").alias("code"), width.alias("width")))


def media_type(content: Column) -> Column:
    """By the bytes that a raster begins with."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("5035"), "image/x-portable-graymap")


def bind_raster(observations: DataFrame, rasters: DataFrame) -> DataFrame:
    """observations (artifact_id, sha256, media_type) with binding: bound, or the first that fails of missing, digest, media-type."""
    found = rasters.select("artifact_id", F.sha2("content", 256).alias("__digest"), media_type(F.col("content")).alias("__type"))
    rows = observations.join(found, "artifact_id", "left")
    fault = F.when(F.col("__digest").isNull(), "missing").when(F.col("__digest") != F.col("sha256"), "digest").when(~F.col("__type").eqNullSafe(F.col("media_type")), "media-type").otherwise("bound")
    return rows.withColumn("binding", fault).drop("__digest", "__type")


def zipped(columns: list[str]) -> Column:
    """Equal-length arrays as one array of structs; null where lengths differ."""
    first = F.size(columns[0])
    same = F.lit(True)
    for c in columns[1:]:
        same = same & (F.size(c) == first)
    return F.when(same, F.arrays_zip(*columns))


_TOKEN = re.compile(rb"<([0-9A-Fa-f\s]*)>|(\[)|(\])|([^\s<>\[\]]+)")


def _scalars(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-16-be") if raw else None
    except UnicodeDecodeError:
        return None


def code_map(stream: bytes) -> list[tuple[int, int, int, str]]:
    """(entry, first, last, text of the first) of a ToUnicode stream, in its order. Entries that aren't valid are left out:
    odd or empty hex, ranges that leave the Unicode scalars, ranges onto several scalars."""
    out: list[tuple[int, int, int, str]] = []
    section, row, depth = None, [], None

    def add(first: int, last: int, text: str | None) -> None:
        if text is None or last < first:
            return
        if last > first:
            top = ord(text) + last - first if len(text) == 1 else None
            if top is None or top > 0x10FFFF or (ord(text) <= 0xDFFF and top >= 0xD800):
                return
        out.append((len(out), first, last, text))

    for hexed, opened, closed, word in _TOKEN.findall(stream):
        if word in (b"beginbfchar", b"beginbfrange"):
            section, row, depth = word, [], None
        elif word in (b"endbfchar", b"endbfrange"):
            section = None
        elif section is None:
            continue
        elif opened:
            depth = []
        elif closed:
            if depth is not None and len(row) == 2 and None not in row:
                for n, text in enumerate(depth[: row[1][0] - row[0][0] + 1]):
                    add(row[0][0] + n, row[0][0] + n, text)
            row, depth = [], None
        elif not word:
            digits = b"".join(hexed.split())
            raw = bytes.fromhex(digits.decode()) if digits and len(digits) % 2 == 0 else None
            if depth is not None:
                depth.append(_scalars(raw) if raw else None)
                continue
            row.append((int.from_bytes(raw[-4:], "big"), raw) if raw else None)
            if section == b"beginbfchar" and len(row) == 2:
                if None not in row:
                    add(row[0][0], row[0][0], _scalars(row[1][1]))
                row = []
            elif section == b"beginbfrange" and len(row) == 3:
                if None not in row:
                    add(row[0][0], row[1][0], _scalars(row[2][1]))
                row = []
    return out


def code_maps(fonts: DataFrame, font: str, stream: str) -> DataFrame:
    """font, entry, start, stop, text: of each font's ToUnicode stream."""

    def run(batches):
        for batch in batches:
            rows = [(f, *e) for f, s in zip(batch[font], batch[stream], strict=True) if s is not None for e in code_map(bytes(s))]
            yield pd.DataFrame(rows, columns=[font, "entry", "start", "stop", "text"])

    kind = fonts.schema[font].dataType.simpleString()
    return fonts.select(font, stream).mapInPandas(run, f"`{font}` {kind}, entry int, start long, stop long, text string")


def _times(m: tuple, n: tuple) -> tuple:
    """The map that applies m first, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, x = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + x)


class Pen:
    """The state of text operators over one page. Restoring a state brings back the page matrix alone."""

    def __init__(self, widths: dict[tuple[str, int], float], fonts: dict[str, tuple[int, float]], forms: set[str]) -> None:
        self.widths, self.fonts, self.forms = widths, fonts, forms
        self.page, self.saved = IDENTITY, []
        self.text = self.line = IDENTITY
        self.open = False
        self.font, self.size = None, 0.0
        self.space = {"Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}
        self.mode = 0
        self.glyphs: list[tuple] = []
        self.notes: dict[str, None] = {}

    def note(self, code: str) -> None:
        self.notes.setdefault(code)

    def run(self, op: str, numbers: list[float], name: str | None, items: list) -> None:
        anywhere = {"q": self._save, "Q": self._restore, "cm": self._concat, "BT": self._begin, "ET": self._end, "Do": self._draw}
        inside = {"Tf": self._set_font, "Tm": self._matrix, "Td": self._move, "TD": self._move_leading, "T*": self._next, "Tr": self._mode, "Tj": self._show, "TJ": self._show}
        if op in anywhere:
            anywhere[op](numbers, name)
        elif op not in inside and op not in self.space:
            if op.startswith("T") or op in ("'", '"'):
                self.note("unsupported-text-operator")
                if not self.open:
                    self.note("text-outside-text-object")
        elif not self.open:
            self.note("text-outside-text-object")
        elif op in self.space:
            self.space[op] = numbers[0]
        elif op in ("Tj", "TJ"):
            self._show(items)
        else:
            inside[op](numbers, name)

    def _save(self, *_):
        self.saved.append(self.page)

    def _restore(self, *_):
        if self.saved:
            self.page = self.saved.pop()

    def _concat(self, numbers, _):
        self.page = _times(tuple(numbers), self.page)

    def _begin(self, *_):
        self.open, self.text, self.line = True, IDENTITY, IDENTITY

    def _end(self, *_):
        self.open = False

    def _draw(self, _, name):
        if name in self.forms:
            self.note("form-not-traversed")

    def _set_font(self, numbers, name):
        self.font, self.size = name, numbers[0]
        if name not in self.fonts:
            self.note("missing-font")

    def _matrix(self, numbers, _):
        self.text = self.line = tuple(numbers)

    def _move(self, numbers, _):
        self.text = self.line = _times((1, 0, 0, 1, numbers[0], numbers[1]), self.line)

    def _move_leading(self, numbers, name):
        self.space["TL"] = -numbers[1]
        self._move(numbers, name)

    def _next(self, *_):
        self._move([0.0, -self.space["TL"]], None)

    def _mode(self, numbers, _):
        good = 0 <= numbers[0] <= 7
        self.mode = int(numbers[0]) if good else 0
        if not good:
            self.note("unsupported-text-operator")

    def _show(self, items):
        for data, adjust in items:
            if data is None:
                self._advance(-(adjust / 1000) * self.size * self.space["Tz"] / 100)
                continue
            if self.font not in self.fonts:
                continue
            step, default = self.fonts[self.font]
            if len(data) % step:
                self.note("trailing-code-bytes")
            if self.mode == 3:
                self.note("invisible-text")
            for at in range(0, len(data) - step + 1, step):
                code = int.from_bytes(data[at : at + step], "big")
                x, y = _times((1, 0, 0, 1, 0.0, self.space["Ts"]), _times(self.text, self.page))[4:]
                width = self.widths.get((self.font, code), default)
                word = self.space["Tw"] if step == 1 and code == 32 else 0.0
                move = (width / 1000 * self.size + self.space["Tc"] + word) * self.space["Tz"] / 100
                self.glyphs.append((code, x, y, move, self.font, self.size, self.mode))
                self._advance(move)

    def _advance(self, x: float) -> None:
        self.text = _times((1, 0, 0, 1, x, 0.0), self.text)


def glyphs(operations: DataFrame, page: str, widths: DataFrame, fonts: DataFrame, forms: set[str] = frozenset()) -> DataFrame:
    """A row per shown glyph of each page: glyph_index, code, x, y, advance, font, size, mode; and one per diagnostic (code null).

    operations: page, op_index, op, numbers, name, items (array of bytes and adjust); widths: font, code, width; fonts:
    font, code_bytes, default_width. A page is folded by one task in the order of op_index; widths and fonts are a
    document's resources and are sent to all tasks, so the caller passes those of one document.
    """
    table = {(r.font, r.code): float(r.width) for r in widths.select("font", "code", "width").toLocalIterator()}
    known = {r.font: (int(r.code_bytes), float(r.default_width)) for r in fonts.select("font", "code_bytes", "default_width").toLocalIterator()}
    shared = operations.sparkSession.sparkContext.broadcast((table, known, set(forms)))
    columns = [page, "glyph_index", "code", "x", "y", "advance", "font", "size", "mode", "diagnostic"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pen = Pen(*shared.value)
        for row in pdf.sort_values("op_index").itertuples(index=False):
            items = [] if row.items is None else [(x["bytes"], x["adjust"]) for x in row.items]
            pen.run(row.op, [] if row.numbers is None else list(row.numbers), row.name, items)
        key = pdf[page].iloc[0]
        rows = [(key, n, *g, None) for n, g in enumerate(pen.glyphs)] + [(key, None, None, None, None, None, None, None, None, d) for d in pen.notes]
        return pd.DataFrame(rows, columns=columns).astype({"glyph_index": "Int64", "code": "Int64", "mode": "Int64"})

    kind = operations.schema[page].dataType.simpleString()
    schema = f"`{page}` {kind}, glyph_index long, code long, x double, y double, advance double, font string, size double, mode long, diagnostic string"
    return dealt(operations.select(page, "op_index", "op", "numbers", "name", "items"), page).groupBy(page).applyInPandas(fold, schema)


#: What a glyph catalogue holds of a glyph.
GLYPH = "glyph_index long, code long, x double, y double, advance double, font string, base_font string, size double"


def catalogue_glyphs(catalogues: DataFrame, page: str, text: str) -> DataFrame:
    """page and the fields of each glyph of a catalogue's JSON (see sinks.glyph_catalogue); a text that isn't one is an error, an empty catalogue has no rows."""
    read = F.from_json(text, f"glyphs array<struct<{GLYPH.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"})
    return catalogues.select(page, F.explode(read["glyphs"]).alias("g")).select(page, "g.*")
