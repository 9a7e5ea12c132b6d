"""Operators on small rows: unknowns, ties, empty input, order."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platen.functions import claims, geometry, status, text
from platen.operators import aggregate, align, cluster, layout, match, pages, planning, quantile, regions, search, validate


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unique_join_reports_ambiguity_and_collision(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None), (6, "z")], "l int, k string")
    right = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (13, "c"), (14, None)], "r int, k string")
    found = {r.l: (r.r, r.status) for r in match.unique_join(left, right, ["k"], "l", "r").collect()}
    assert found == {1: (10, "matched"), 2: (None, "ambiguous"), 3: (None, "collision"), 4: (None, "collision"), 5: (None, "unmatched"), 6: (None, "unmatched")}


def test_status_algebra(spark):
    df = spark.createDataFrame([(1, "preserved"), (1, "unknown"), (2, "preserved"), (3, "violated"), (3, "unknown")], "g int, s string")
    assert rows(df.groupBy("g").agg(status.rolled_up(F.col("s")).alias("v"))) == [(1, "unknown"), (2, "preserved"), (3, "violated")]
    assert df.where("false").agg(status.rolled_up(F.col("s"))).first()[0] == "unknown"
    made = df.limit(1).select(
        status.from_delta(F.lit(0.5), F.lit(0.5)), status.from_delta(F.lit(None).cast("double"), F.lit(0.5)), status.combine(F.lit("preserved"), F.lit("violated")), status.content(F.lit(2), F.lit(2), F.lit(2), F.lit(0)), status.content(F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    ).first()
    assert tuple(made) == ("preserved", "unknown", "violated", "preserved", "unknown")


def test_claim_gate(spark):
    df = spark.createDataFrame([("known", 0.9, None), ("known", None, None), ("unknown", None, "illegible"), ("known", 0.1, None)], "s string, c double, r string")
    gate = claims.gate(F.col("s"), F.col("c"), F.col("r"), 0.5)
    assert [r[0] for r in df.select(gate).collect()] == ["ok", "below-policy", "unknown:illegible", "below-policy"]
    with pytest.raises(ValueError):
        claims.check_policy({"x": -1.0}, None)


def test_three_homographies_differ(spark):
    # The horizon x + y = 1.5 passes through the box.
    m = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 1, 1, -1.5)])
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    made = spark.range(1).select(geometry.project_box_compare(m, box), geometry.project_box_plan(m, box), geometry.project_box_layout(m, box)).first()
    assert made[0] is not None and made[1] is None and made[2] is not None
    assert spark.range(1).select(geometry.regular(m)).first()[0]


def test_quantise_ties_to_even(spark):
    df = spark.createDataFrame([(0.5 / 1024,), (1.5 / 1024,), (-2.5 / 1024,)], "x double")
    assert [r[0] for r in df.select(geometry.quantise(F.col("x"))).collect()] == [0, 2, 2]
    with pytest.raises(Exception, match="residual"):
        spark.createDataFrame([(math.inf,)], "x double").select(geometry.quantise(F.col("x"))).collect()


def test_anchor_and_chain_differ(spark):
    df = spark.createDataFrame([(1, i, float(y), 0.0, 2.0) for i, y in enumerate([0, 0.8, 1.6, 2.4])], "g int, i int, y double, x double, size double")
    anchored = {r.i: r.cluster for r in cluster.anchor_clusters(df, ["g"], "y", "x", "size", "i").collect()}
    chained = {r.i: r.cluster for r in cluster.chain_clusters(df, ["g"], ["y"], F.col("y"), 0.5 * F.col("size")).collect()}
    assert anchored == {0: 0, 1: 0, 2: 1, 3: 1} and set(chained.values()) == {0}


def test_words_have_code_point_spans(spark):
    df = spark.createDataFrame([(1, " 😀ab  c d")], "k int, t string")
    assert rows(cluster.words_of(df, ["k"], "t").select("word", "start", "end")) == [("c", 6, 7), ("d", 8, 9), ("😀ab", 1, 4)]


def test_guarded_median_and_mode(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 5.0), (2, float("nan")), (2, 1.0)], "g int, x double")
    assert rows(df.groupBy("g").agg(aggregate.guarded_median(F.col("x")))) == [(1, 3.0), (2, None)]
    df = spark.createDataFrame([(1, v) for v in (3, 3, 4, 9, 9, 10)], "g int, v int")
    assert rows(aggregate.supported_mode(df, ["g"], "v")) == [(1, 3, 3)]


def test_argmin_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("c", 5, 2)], "n string, k int, s int")
    assert rows(aggregate.argmin_with_ties(df, ["k"], "n")) == [("a", "tied"), ("b", "tied")]
    assert rows(aggregate.argmin_with_ties(df.where("n <> 'b'"), ["k"], "n")) == [("a", "selected")]
    assert rows(aggregate.argmin_with_ties(df.where("false"), ["k"], "n")) == []


def test_cycles_and_spans(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 3)], "n int, u int")
    assert rows(validate.cyclic(edges, "n", "u")) == [(3,), (4,), (5,)]
    units = spark.createDataFrame([(1, None, "olá mundo", None, None), (2, 1, "mundo", 4, 9), (3, 1, "olá", 1, 4)], "unit_id int, parent_id int, text string, start int, end int")
    assert rows(validate.span_errors(units)) == [(3,)]
    assert validate.topological({"b": {"a"}, "a": set(), "c": {"a"}}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        validate.topological({"a": {"b"}, "b": {"a"}})


def test_range_lookup_takes_first_entry(spark):
    values = spark.createDataFrame([(5,), (50,), (7,)], "v int")
    ranges = spark.createDataFrame([(0, 6, 9, 1), (1, 4, 8, 2)], "entry int, start int, stop int, target int")
    assert rows(match.by_range(values, ranges, "v", 4).select("v", "hit.target")) == [(5, 2), (7, 1), (50, None)]


def test_layout_unknown_without_box(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 1.0, 10.0, 10.0), (1, None, 1.0, 5.0, 2.0, 10.0, 10.0)], "p int, x0 double, y0 double, x1 double, y1 double, w double, h double")
    assert layout.insets(df, ["p"], "w", "h").first().reason == "line-without-box"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=7), st.lists(st.integers(0, 3), max_size=7))
def test_lcs_is_longest(a, b):
    pairs = align.lcs(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)

    def longest(x, y):
        if not x or not y:
            return 0
        return 1 + longest(x[1:], y[1:]) if x[0] == y[0] else max(longest(x[1:], y), longest(x, y[1:]))

    assert len(pairs) == longest(a, b)


def test_cost_alignment_skips_dear_pairs():
    assert align.cost_alignment([1.0, 9.0], [1.0]) == [(0, 0), (1, None)]
    assert align.cost_alignment([], []) == []


def test_search_loops():
    assert search.feedback(0.0, lambda x: (abs(3 - x), 1.0), 10) == (3.0, "converged")
    found = search.coordinate_descent({"a": 0.0}, {"a": 1.0}, lambda grid: [(g["a"] - 2) ** 2 for g in grid], 30)
    assert abs(found["a"] - 2) < 0.2
    with pytest.raises(ValueError):
        search.axis([1.0], 4, 96)


def test_text_scalars(spark):
    df = spark.createDataFrame([("ABCDEF+Foo-BoldItalic", "Straße  X")], "n string, w string")
    font = text.base_font(F.col("n"))
    made = df.select(font["family"], font["face"], font["subset"], text.word_key(F.col("w")), text.family_key(F.lit("Foo Bar-1")), text.family_key(F.lit("Fóo")), text.first_difference(F.lit("abc"), F.lit("abd")), text.first_difference(F.lit("ab"), F.lit("abc"))).first()
    assert tuple(made) == ("Foo", "BoldItalic", "ABCDEF", "strassex", "foobar1", None, 2, 2)
    codes = spark.createDataFrame([(bytearray(b"\x01\x02\x03"),)], "b binary").select(text.glyph_codes(F.col("b"), 2)).first()[0]
    assert (codes.codes, codes.trailing) == ([258], 1)
    raw = spark.createDataFrame([(bytearray("é😀".encode("utf-16-be")),), (bytearray(b"\xd8\x00"),), (bytearray(b"\x00"),), (bytearray(),)], "b binary")
    assert [r[0] for r in raw.select(text.utf16be("b")).collect()] == ["é😀", None, None, None]


def test_rules(spark):
    from platen.functions import rules

    made = spark.range(1).select(
        rules.font_geometry(F.lit(50.0), F.lit(20.0), F.lit(30.0), F.lit(10.0), F.lit("abc"), 100.0), rules.supports(F.lit("abcdefghij"), F.lit("bacdefghij")), rules.supports(F.lit("abc"), F.lit("xyz")), rules.supports(F.lit("abc"), F.lit(None).cast("string")), rules.expected_face(F.lit("heavy"), F.lit("normal"))
    ).first()
    assert tuple(made[0]) == (200.0, -0.025, 0.833333)
    assert tuple(made[1:]) == (True, False, None, None)


def test_fonts(spark):
    from platen.operators import fonts

    tokens = spark.createDataFrame([(1, 0, "the"), (1, 1, "cat"), (1, 2, "the"), (1, 3, "dog"), (1, 4, "xx"), (2, 0, "a")], "page int, token int, text string")
    glyphs = [(1, i, c, "A" if i < 6 else "B") for i, c in enumerate("thecatthedogs")]
    df = spark.createDataFrame(glyphs, "page int, glyph_index int, text string, font string")
    assert rows(fonts.token_fonts(tokens, df, "page")) == [(1, 1, "A"), (1, 3, "B")]
    assert fonts.word_starts([0, 20, 40], [(1, 0), (18, 3), (22, 5), (39, 3)]) == [1, 22, 39]
    assert fonts.word_starts([0, 60], [(1, 0), (39, 3)]) is None
    lines = spark.createDataFrame([(1, 1, 0.5, 0.4, 0.3), (1, 1, 0.5, 0.4, 0.3), (2, 0, None, 0.1, 0.1), (3, 0, 0.5, 0.5, 0.45)], "r int, i int, g double, l double, b double")
    made = fonts.style_consensus(lines, "r", "i", {"regular": "g", "light": "l", "bold": "b"})
    assert rows(made) == [(1, "italic", "bold", 2), (2, None, None, 0), (3, "normal", "bold", 1)]


def test_best_format_of_any_number(spark):
    sizes = [(n, 40.0 + 7 * n, 30.0 + 11 * n % 90) for n in range(60)] + [(90, 0.0, 10.0), (91, None, 10.0)]
    rows = spark.createDataFrame(sizes, "page int, w0 double, h0 double")
    formats = [(f"f{n:03}", 20.0 + 3 * n, 20.0 + 5 * n % 110) for n in range(150)]
    made = {r.page: r.format for r in pages.best_format(rows, spark.createDataFrame(formats, "name string, w double, h double"), "page", F.col("w0"), F.col("h0"), 0.3).collect()}
    for page, w, h in sizes:
        errors = [(max(abs(w / a - 1), abs(h / b - 1)), abs(w / a - 1) + abs(h / b - 1), name) for name, a, b in formats] if w else [(9.0, 9.0, "")]
        assert made[page] == (min(errors)[2] if min(errors)[0] <= 0.3 else None)
    with pytest.raises(ValueError):
        pages.best_format(rows, rows, "page", F.col("w0"), F.col("h0"), 1.0)


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_cost(a, b, skip=0.35, cap=0.7, slope=3.0):
    cost = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [cost[i - 1][j - 1] + min(cap, slope * abs(a[i - 1] - b[j - 1]))] if i and j else []
            ways += [cost[i - 1][j] + skip] if i else []
            ways += [cost[i][j - 1] + skip] if j else []
            cost[i][j] = min(ways, default=0.0)
    return cost[-1][-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 5), max_size=14), st.sampled_from([1, 12, 40, 8_000_000]))
def test_alignments_in_blocks(a, b, cells):
    kept, align.CELLS = align.CELLS, cells
    try:
        assert align.lcs(a, b) == plain_lcs(a, b)
        x, y = [v / 7 for v in a], [v / 7 for v in b]
        steps = align.cost_alignment(x, y)
    finally:
        align.CELLS = kept
    assert [i for i, _ in steps if i is not None] == list(range(len(a))) and [j for _, j in steps if j is not None] == list(range(len(b)))
    assert math.isclose(sum(0.35 if i is None or j is None else min(0.7, 3 * abs(x[i] - y[j])) for i, j in steps), plain_cost(x, y), abs_tol=1e-9)


def test_quantiles_of_large_groups(spark):
    import statistics

    values = [float(v) for v in (5, 5, 5, 5, 1, 2, 9, -1e9, 7, 3, 3)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0), ("c", None), ("d", 1.0), ("d", 2.0)], "g string, v double")
    made = {r.g: (r.m, r.p) for r in quantile.quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.9}).collect()}
    assert made == {"a": (statistics.median(values), 7.0), "b": (4.0, 4.0), "d": (1.5, pytest.approx(1.9))}
    big = spark.range(20000).select((F.col("id") % 2).alias("g"), (F.pow(F.col("id") % 5000, 3) / 7).alias("v"))
    made = {r.g: tuple(r)[1:] for r in quantile.quantiles(big, ["g"], "v", {"m": 0.5, "p": 0.975}).collect()}
    wanted = {r.g: tuple(r)[1:] for r in big.groupBy("g").agg(F.median("v"), F.percentile("v", 0.975)).collect()}
    assert {k: pytest.approx(v) for k, v in wanted.items()} == made


def test_nearest_value(spark):
    left = spark.createDataFrame([(1, 0, 5.0), (2, 0, 250.0), (3, 0, -999.5), (4, 1, 7.0), (5, 0, 100.0), (6, 2, None)], "l int, g int, v double")
    right = spark.createDataFrame([(10, 0, 4.0), (11, 0, 6.0), (12, 0, 240.0), (13, 0, 260.0), (9, 0, 260.0), (20, 0, 9000.0), (21, 2, 1.0)], "r int, g int, v double")
    assert rows(match.nearest_value(left, right, ["g"], "l", "r", "v", 2, 50.0)) == [(1, 10, 1.0), (2, 9, 10.0), (3, 10, 1003.5), (4, None, None), (5, 11, 94.0)]


def test_cycles_keep_the_plan_small(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)] + [(100, 101), (101, 100), (102, 100)], "n int, u int")
    made = validate.cyclic(chain, "n", "u")
    assert {r.n for r in made.collect()} == {100, 101, 102}
    assert len(made._jdf.queryExecution().analyzed().toString().splitlines()) < 8


def test_words_of_long_lines(spark):
    text_ = "  " + " ".join("w" * (n % 5 + 1) + ("😀" if n % 9 == 0 else "") for n in range(1000)) + "\t"
    made = cluster.words_of(spark.createDataFrame([(1, text_), (2, ""), (3, None), (4, "   ")], "k int, t string"), ["k"], "t").collect()
    assert {r.k for r in made} == {1} and len(made) == 1000
    assert all(text_[r.start : r.end] == r.word for r in made) and [r.word_no for r in made] == list(range(1000))


def test_evidence_must_fit_its_status(spark):
    df = spark.createDataFrame([("preserved", None, 0.1, 0.1)], "s string, a double, b double, c double")
    with pytest.raises(Exception, match="contradicts"):
        df.select(regions.horizontal_residual(F.col("s"), F.col("a"), F.col("b"), F.col("c"))).collect()
    with pytest.raises(Exception, match="contradicts"):
        df.select(regions.baseline_residual(F.lit("unknown"), F.col("b"))).collect()
    with pytest.raises(Exception, match="residual"):
        df.select(regions.horizontal_residual(F.lit("unknown"), F.lit(float("inf")), F.col("b"), F.col("c"))).collect()


def test_requested_family_with_an_unknown_end(spark):
    names = spark.createDataFrame([("Foo-Odd",), ("Foo-Bold",), ("Foobar",), ("Bar-Odd",)], "n string")
    assert [r[0] for r in names.select(text.base_font(F.col("n"), F.lit("foo"))["key"]).collect()] == [None, "foo", "foobar", "barodd"]
    made = spark.range(1).select(text.font_hypothesis(F.lit("ABCDEF+Foo-SemiBold")), text.font_hypothesis(F.lit("Foo,Italic-Identity-H"))).first()
    assert [tuple(x) for x in made] == [("Foo", "normal", "semibold"), ("Foo", "italic", "regular")]


def test_plans_without_lines_or_mapping(spark):
    pages_ = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]), (2, None), (3, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "page int, matrix array<double>")
    kind = "page int, unit string, text string, box struct<x0:double,y0:double,x1:double,y1:double>, key array<long>, baseline array<struct<x:double,y:double>>"
    box = (0.0, 0.0, 1.0, 1.0)
    lines = spark.createDataFrame([(1, "b", "two", box, [2], None), (1, "a", "one", box, [10], [(0.0, 0.0)]), (2, "c", "x", box, [0], None)], kind)
    made = {r.page: r for r in planning.line_plans(pages_, lines, "page").collect()}
    assert made[1].status == "materializable" and [x.text for x in made[1].lines] == ["two", "one"]
    assert [made[k].diagnostics[0].code for k in (2, 3)] == ["page-mapping-unknown", "no-lines"] and made[2].lines is None


@pytest.mark.parametrize("step", [500.0, 0.1])
def test_nearest_step_is_that_of_all_pairs(spark, step):
    import random

    draw = random.Random(3)
    at = lambda: round(draw.choice([0.1, 600.1, -399.9, 1100.1]) + draw.choice([0, 0.3, 0.30000000000000004, 7.0, 2.05]) * draw.randrange(4), 2)
    left = [(n, n % 3, at()) for n in range(60)] + [(90, 0, None), (91, 0, 9e9), (92, 1, -0.0), (93, 2, 1e308), (94, 7, 1.0)]
    right = [(n, n % 3, at()) for n in range(40)] + [(90, 0, None), (91, 1, 9e9), (92, 1, 0.0), (93, 2, 1e308), (94, 0, 1e9)]
    left, right = spark.createDataFrame(left, "l int, g int, v double"), spark.createDataFrame(right, "r int, g int, v double")
    made = match.nearest_step(left, right, ["g"], "l", "r", "v", step, 6)
    pairs = left.join(right.withColumnRenamed("v", "w"), "g").withColumn("score", 10 - F.floor(F.abs(F.col("v") - F.col("w")) / step))
    wanted = match.best_or_tied(pairs, "l", "r", "score", 5).select("l", "r", (10 - F.col("best")).alias("level"), "ties")
    key = lambda r: r[0]
    assert sorted(map(tuple, made.collect()), key=key) == sorted(map(tuple, wanted.collect()), key=key)


def test_anchor_clusters_over_batches(spark):
    import random

    draw = random.Random(6)
    data = [(g, n, float(draw.randrange(8 * g)), float(draw.randrange(3)), draw.choice([2.0, 4.0, None])) for g in range(1, 9) for n in range(7 * g)]
    data += [(None, 0, 1.0, 1.0, 2.0), (50, 0, None, 1.0, 2.0), (50, 1, 9.0, 1.0, 2.0), (50, 2, 1.0, None, 2.0), (51, 0, None, 1.0, 2.0)]
    df = spark.createDataFrame(data, "g int, i int, y double, x double, size double")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = cluster.anchor_clusters(df, ["g"], "y", "x", "size", "i")
        assert "InPandas" not in made._jdf.queryExecution().toString()  # a function call for each group costs more than its fold
        found = {(r.g, r.i): r.cluster for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    wanted = {(None, 0): 0, (50, 2): 0, (50, 1): 1, (50, 0): 1, (51, 0): 0}
    for g in range(1, 9):
        number, anchor = 0, None
        for _, i, y, _, size in sorted((r for r in data if r[0] == g), key=lambda r: (r[2], r[3], r[1])):
            if anchor is not None and size is not None and abs(y - anchor) > 0.5 * size:
                number, anchor = number + 1, None
            anchor = y if anchor is None else anchor
            wanted[g, i] = number
    assert found == wanted


def plain_regions(lines, share=0.2, gap=24.0):
    last, out = [], {}
    for line, x0, y0, x1, y1 in lines:
        common = lambda r: (min(r[1], x1) - max(r[0], x0)) / max(1e-9, min(r[1] - r[0], x1 - x0))  # noqa: B023, E731
        fit = [((common(r), r[2] - y0), -n) for n, r in enumerate(last) if common(r) >= share and y0 - r[2] <= gap]
        at = -max(fit)[1] if fit else len(last)
        last[at : at + 1] = [(x0, x1, y1)]
        out[line] = at
    return out


def test_regions_over_batches(spark):
    import random

    draw = random.Random(5)
    pages_ = {p: sorted([(n, float(x := draw.randrange(40)), float(draw.randrange(30 * p + 1)), float(x + draw.randrange(30)), float(draw.randrange(30 * p + 20))) for n in range(9 * p)], key=lambda r: (r[2], r[1], r[0])) for p in range(1, 9)}
    df = spark.createDataFrame([(p, *r) for p, lines in pages_.items() for r in lines] + [(None, 0, 0.0, 0.0, 1.0, 1.0), (99, 0, 0.0, 0.0, 9.0, 1.0), (99, 1, 0.0, None, 9.0, 1.0)], "page int, line int, x0 double, y0 double, x1 double, y1 double")
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = pages.grouped_regions(df, "page")
        assert "InPandas" not in made._jdf.queryExecution().toString()  # a function call for each page costs more than its fold
        found = {(r.page, r.line): r.region for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert found == {(p, n): r for p, lines in pages_.items() for n, r in plain_regions(lines).items()} | {(None, 0): 0, (99, 0): 0, (99, 1): 1}


def pairs_over_batches(spark, made):
    """Both sides of each group, and the alignment that made gives of them, in batches of four rows."""
    import random

    draw = random.Random(7)
    left = {g: [draw.randrange(4) for _ in range(draw.randrange(5 * g))] for g in range(1, 9)} | {None: [1, 2], 20: [3], 21: []}
    right = {g: [draw.randrange(4) for _ in range(draw.randrange(5 * g))] for g in range(1, 9)} | {None: [2, 1], 20: [], 21: [1, 3]}
    rows_of = lambda side: spark.createDataFrame([(g, 10 * n, v / 7) for g, values in side.items() for n, v in enumerate(values)], "g int, n long, v double").orderBy(F.desc("n"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = made(rows_of(left), rows_of(right), "g", "n", "v")
        assert "InPandas" not in df._jdf.queryExecution().toString()  # a function call for each pair costs more than its table
        found = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    return {g: ([v / 7 for v in left[g]], [v / 7 for v in right[g]], [r[1:] for r in found if r[0] == g]) for g in left}


def test_line_alignment_over_batches(spark):
    for a, b, steps in pairs_over_batches(spark, align.line_alignment).values():
        assert steps == [(None if i is None else 10 * i, None if j is None else 10 * j) for i, j in align.cost_alignment(a, b)]
        assert math.isclose(sum(0.35 if i is None or j is None else min(0.7, 3 * abs(a[i // 10] - b[j // 10])) for i, j in steps), plain_cost(a, b), abs_tol=1e-9)


def test_lcs_pairs_over_batches(spark):
    for a, b, steps in pairs_over_batches(spark, align.lcs_pairs).values():
        assert steps == [(10 * i, 10 * j) for i, j in plain_lcs(a, b)]


def test_reflow_over_word_lists(spark):
    import random

    draw = random.Random(8)
    lines = [(n, [f"w{draw.randrange(90)}" for _ in range(3)]) for n in range(24)] + [(90, ["p", "q"]), (91, ["r"]), (92, [])]
    words = [w for _, ws in lines for w in ws]
    once = {w: n for n, ws in lines for w in ws if words.count(w) == 1}
    known = sorted(once)
    parents = [(n, [draw.choice(known) for _ in range(draw.randrange(4))]) for n in range(200)] + [(n, [draw.choice(words) for _ in range(2)]) for n in range(200, 300)]
    parents += [(300, ["p", "q", "r"]), (301, ["r", "q"]), (302, ["p", "q"]), (303, ["p", None, "r"]), (304, None), (305, ["p", "unheard", "r"])]
    wanted = []
    for n, keys in parents:
        at = [once.get(k) for k in keys or []]
        if at and None not in at and len(set(keys)) == len(keys) and at == sorted(at) and len(set(at)) > 1:
            wanted.append((n, len(set(at))))
    other = spark.createDataFrame(lines, "line int, words array<string>").select(F.explode("words").alias("word"), "line")
    made = match.reflow(spark.createDataFrame(parents, "parent int, keys array<string>"), "parent", "keys", other, "word", "line")
    assert (300, 2) in wanted and len(wanted) > 20 and rows(made) == sorted(wanted)


def test_spans_beside_their_text_need_no_shuffle(spark):
    texts = {1: "olá 😀 mundo", 2: None, 3: "", 4: "x" * 50}
    children = [(1, 0, "olá", 0, 3), (1, 1, "😀", 4, 5), (1, 2, "mundo", 6, 11), (1, 3, "mundo", 7, 12), (1, 4, "olá", 0, None), (1, 5, "olá", None, 3), (1, 6, None, 0, 3), (1, 7, "", 3, 3), (1, 8, "o", -11, -10), (2, 0, "a", 0, 1), (3, 0, "a", 0, 1), (4, 0, "xx", 48, 50), (4, 1, "xx", 49, 51)]
    child = "array<struct<word_no int, text string, start int, end int>>"
    nested = [(k, t, [c[1:] for c in children if c[0] == k]) for k, t in texts.items()] + [(n, "ab", [(0, "b", n % 2, 2)]) for n in range(1000, 3500)] + [(9, "ab", None), (10, "ab", [])]
    made = validate.span_errors_within(spark.createDataFrame(nested, f"unit int, line string, words {child}").coalesce(1), ["unit"], "line", "words", "word_no")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    units = spark.createDataFrame([((k, -1), None, t, None, None) for k, t in texts.items()] + [((c[0], c[1]), (c[0], -1), *c[2:]) for c in children], "unit_id struct<a int, b int>, parent_id struct<a int, b int>, text string, start int, end int")
    assert rows(made) == sorted([tuple(r.unit_id) for r in validate.span_errors(units).collect()] + [(n, 0) for n in range(1000, 3500, 2)])


def test_word_lists_are_the_words_of_their_line(spark):
    text_ = "  " + " ".join("w" * (n % 5 + 1) + ("😀" if n % 9 == 0 else "") for n in range(1000)) + "\t"
    df = spark.createDataFrame([(1, text_), (2, ""), (3, None), (4, "   "), (5, "a b"), (6, text_[::-1])], "k int, t string").coalesce(1)
    kept, cluster.WORDS = cluster.WORDS, 1200
    try:
        made = {r.k: r for r in cluster.word_lists(df, ["k"], "t").collect()}
        flat = [tuple(r) for r in cluster.words_of(df, ["k"], "t").collect()]
    finally:
        cluster.WORDS = kept
    assert {k: r.t for k, r in made.items()} == {r.k: r.t for r in df.collect()}
    assert [(k, *w) for k, r in sorted(made.items()) for w in r.words] == sorted(flat) and len(flat) == 2002


def test_plans_read_their_lines_once(spark):
    same = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    # The horizon x = 1.5 passes between the ends of box and baseline of e and f.
    split = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, -1.5]
    pages_ = spark.createDataFrame([(1, same), (2, split), (3, same), (4, None)], "page int, matrix array<double>")
    kind = "page int, unit string, text string, box struct<x0:double,y0:double,x1:double,y1:double>, key array<long>, baseline array<struct<x:double,y:double>>"
    box, near = (0.0, 0.0, 2.0, 1.0), (0.0, 0.0, 1.0, 1.0)
    lines = [(1, u, "t", box, k, None) for u, k in (("b", [2]), ("a", [2]), ("d", [1, None]), ("c", [1, None]), ("z", [1]), ("y", [2]))]
    lines += [(2, "e", "t", box, [1], None), (2, "f", "t", near, [2], [(0.0, 0.0), (2.0, 0.0)]), (2, "g", "t", near, [3], [(1.5, 0.0)]), (2, "h", "t", near, [4], [(0.0, 0.0), (1.0, 0.0)])]
    lines += [(3, "i", None, None, None, None), (3, "j", "a\u2028b", box, [5], [(0.0, None)]), (3, "k", "t", box, [5], []), (3, "l", "t", (1.0, 0.0, 1.0, 1.0), [6], None), (4, "m", None, None, [1], None)]
    df = spark.createDataFrame(lines, kind)
    made = planning.line_plans(pages_, df, "page")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 3  # pages twice, lines once
    found = {r.page: ([tuple(d) for d in r.diagnostics], r.planned, r.total) for r in made.collect()}
    shared = "ambiguous-reading-order"
    assert found[1] == ([(shared, "a,b,y", "reading-order"), (shared, "c,d", "reading-order")], 6, 6)
    assert found[2] == ([("projection-failed", "e", "bbox"), ("projection-failed", "f", "baseline"), ("projection-failed", "g", "baseline")], 1, 4)
    assert found[3] == ([("explicit-line-separator", "j", "text"), ("projection-failed", "l", "bbox"), *[("required-claim-unknown", "i", n) for n in ("bbox", "reading-order", "text")]], 1, 4)
    assert found[4] == ([("page-mapping-unknown", None, None)], 0, 1)
