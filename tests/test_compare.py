"""Comparison operators, letter features, raster shapes and reports on small cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen.functions import text
from platen.operators import compare, raster, regions, scope
from platen.sources import reports


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_words_by_key(spark):
    scans = spark.createDataFrame([(1, "a", 0.0, 10.0, 5.0, 0.9), (2, "a", 9.0, 10.0, 5.0, 0.1), (3, "b", 0.0, 1.0, 0.0, 1.0), (4, "z", 0.0, 1.0, 0.0, 1.0), (5, "a", None, None, 5.0, 0.9), (6, "a", 1.0, 11.0, 9.0, 0.9), (7, "a", 0.0, 10.0, float("nan"), 0.9)], "id int, k string, x0 double, x1 double, baseline double, confidence double")
    words = spark.createDataFrame([("a", 7, 0.0, 10.0, 5.0, 10.0), ("b", 1, 0.0, 1.0, 0.0, 9.0), ("b", 2, 0.0, 1.0, 0.0, 9.0)], "k string, line int, x0 double, x1 double, baseline double, size double")
    made = compare.words_by_key(scans, words, "k").select("id", "candidate_line", "horizontal", "vertical", "status")
    assert rows(made, "id") == [
        (1, 7, "preserved", "preserved", "preserved"),
        (2, 7, "violated", "unknown", "violated"),
        (3, None, "unknown", "unknown", "unknown"),
        (4, None, "unknown", "unknown", "unknown"),
        (5, None, "unknown", "unknown", "unknown"),
        (6, 7, "preserved", "violated", "violated"),
        (7, 7, "preserved", "unknown", "unknown"),
    ]
    assert compare.words_by_key(scans.limit(0), words, "k").isEmpty()


def test_families(spark):
    samples = spark.createDataFrame([("x", 1.0, True), ("y", 3.0, False)], "sample string, weight double, required boolean")
    faces = [("F", "x", 0.5, "Bold", "b"), ("F", "x", 0.5, "Regular", "a"), ("F", "y", 0.9, "Bold", "b"), ("G", "x", 0.8, "Regular", "g"), ("H", "y", 1.0, "Regular", "h")]
    ranked, rejected = compare.ranked_families(spark.createDataFrame(faces, "family string, sample string, score double, style string, path string"), samples, 0.9, 5)
    found = rows(ranked.select("rank", "family", "style", "path", "overall", "status"), "rank")
    assert [x[:4] for x in found] == [(1, "F", "Bold", "b"), (2, "G", "Regular", "g")]
    assert [x[4] for x in found] == pytest.approx([0.8, 0.8]) and {x[5] for x in found} == {"fallback_required"}
    assert rows(rejected, "family") == [("H", "required_evidence_missing", 1)]
    with pytest.raises(ValueError):
        compare.ranked_families(ranked, samples, 1.5, 1)


def test_page_lists(spark):
    pages = spark.createDataFrame([(1, 1, "success"), (1, 2, "partial"), (1, 3, "crashed"), (1, 4, None)], "book int, page int, status string")
    assert rows(compare.page_lists(pages, ["book"], "page", "status"), "page", "outcome") == [(1, "processed", 1), (1, "partial", 2), (1, "processed", 2), (1, "failed", 3), (1, "failed", 4)]


def test_scope(spark):
    lines = spark.createDataFrame([(1, "ab", [(0, 2), (3, 5)]), (2, None, [])], "line int, text string, words array<struct<start:int,stop:int>>")
    assert rows(scope.word_references(lines, ["line"], "words"), "start") == [(1, 0, 2), (1, 3, 5)]
    assert rows(scope.lines_without_text(lines, ["line"], "text"), "line") == [(2, "candidate-unmapped-glyph")]
    assert scope.invalid_field(1, 1, None, 0.5) is None
    assert scope.invalid_field(float("nan"), 1, None, None) == "horizontal_tolerance_pt"
    assert scope.invalid_field(1, -1, None, None) == "baseline_tolerance_pt"
    assert scope.invalid_field(1, 1, None, float("nan")) == "geometry_confidence"
    glyphs = spark.createDataFrame([(0, "a", True), (1, "b", False), (2, None, True), (3, "c", None)], "i int, text string, ok boolean")
    assert [r.i for r in scope.unmapped(glyphs, "text", F.col("ok")).orderBy("i").collect()] == [1, 2, 3]


def test_letter_features(spark):
    words = ["acem", "Ace", "had", "gap", "GAP", "né", "ça", "12", "", None, "ß"]
    made = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, w string").select("n", text.letter_features("w").alias("f")).orderBy("n").collect()
    assert [tuple(r.f) for r in made] == [
        (True, False, False, False),
        (False, True, False, False),
        (False, True, False, False),
        (False, False, True, False),
        (False, True, True, False),
        (False, False, False, True),
        (False, False, True, True),
        (False, False, False, False),
        (False, False, False, False),
        (False, False, False, False),
        (False, False, False, False),
    ]


def test_repaired_region(spark):
    lines = spark.createDataFrame([(1, k, 100.0, 10.0 * k, 300.0, 10.0 * k + 8, None, None) for k in range(3)] + [(1, 9, 40.0, 90.0, 310.0, 98.0, 50, 61)], "region int, line int, x0 double, y0 double, x1 double, y1 double, gap int, start int")
    made = regions.repaired_lines(lines, ["region"], "gap", "start")
    assert [(r.line, r.new_x0) for r in made.where("repaired").collect()] == [(9, 99.0)]
    own = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 2.0, 3.0, 4.0)], "region int, x0 double, y0 double, x1 double, y1 double")
    found = regions.recomputed_boxes(own, made.withColumn("x0", F.col("new_x0")), ["region"])
    assert rows(found, "region") == [(1, 99.0, 0.0, 310.0, 98.0, True), (2, 1.0, 2.0, 3.0, 4.0, False)]


def test_after_widest_gap():
    grey = np.full((4, 20), 255, np.uint8)
    grey[:2, [1, 2, 9, 10, 17]] = 0
    assert raster.after_widest_gap(grey) == (7, 17)
    grey[1:, 17] = 255
    assert raster.after_widest_gap(grey) == (7, 9)
    assert raster.after_widest_gap(grey[:1]) is None


def test_style_of():
    ink = np.zeros((20, 20), bool)
    ink[2:18, 8:12] = True
    thin, thick = np.zeros_like(ink), np.zeros_like(ink)
    thin[2:18, 10] = True
    thick[2:18, 4:16] = True
    made = raster.style_of(ink, {"regular": ink, "light": thin, "bold": thick})
    assert (made["status"], made["style_class"], made["weight"], made["confidence"]) == ("observed", "regular", "regular", 1.0)
    assert raster.style_of(ink, {"regular": ink, "bold": ink})["reason"] == "candidate-margin-insufficient"
    assert raster.style_of(np.zeros_like(ink), {"regular": ink, "bold": thick})["reason"] == "ink-absent"


def test_fitted():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert raster.fitted(grey, 3, 2, "right").tolist() == [[0, 1], [4, 5], [8, 9]]
    assert raster.fitted(grey, 3, 2, "left").tolist() == [[2, 3], [6, 7], [10, 11]]
    assert raster.fitted(grey, 3, 2).tolist() == [[1, 2], [5, 6], [9, 10]]
    assert raster.fitted(grey, 5, 5)[0].tolist() == [255] * 5
    assert raster.fitted(grey, 5, 5)[1].tolist() == [0, 1, 2, 3, 255]
    assert raster.fitted(grey, 5, 5, "left")[1].tolist() == [255, 0, 1, 2, 3]
    assert raster.page_pixels(254, 254, 25.4, 25.4, (50.8, 25.4)) == (508, 254)
    assert raster.page_pixels(254, 254, 25.4, 50.8, (50.8, 25.4)) is None


def test_with_its_dot():
    grey = np.full((12, 16), 255, np.uint8)
    grey[4:12, 4:6] = 10
    grey[0:2, 4:6] = 20
    grey[0:2, 13:15] = 30
    grey[6:9, 12:13] = 40
    made = raster.with_its_dot(grey, "i")
    assert set(np.unique(made)) == {10, 20, 255} and (made == 10).sum() == 16 and (made == 20).sum() == 4
    assert raster.with_its_dot(grey, "l") is grey
    assert raster.with_its_dot(grey[4:], "j") is not None and (raster.with_its_dot(grey[4:], "j") == grey[4:]).all()


def test_numbers(spark):
    values = [0.0, -0.0, 1.0, -2.5, 0.1, 1e-7, 1.25e-5, 1e7, 1.5e7, 123456789.125, 1e21, 1.234e20, 5e-324, None]
    made = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double").select("n", reports.number(F.col("v")).alias("t")).orderBy("n").collect()
    for value, row in zip(values, made, strict=True):
        assert "e" not in row.t.lower()
        assert row.t == "null" if value is None else float(row.t) == value
    assert [r.t for r in made][:9] == ["0", "-0", "1", "-2.5", "0.1", "0.0000001", "0.0000125", "10000000", "15000000"]
    with pytest.raises(Exception, match="not finite"):
        spark.range(1).select(reports.number(F.lit(float("inf")), "x")).collect()


def test_comparison_report(spark):
    heads = spark.createDataFrame([(1, 0, "ab", "unknown", "unknown", "unknown", 1, 2, 1, 3), (2, 1, "cd", "preserved", "preserved", "preserved", 0, 0, 0, 0)], "page int, page_index int, raster_sha256 string, content_status string, geometry_status string, overall_status string, matched_scan long, total_scan long, matched_candidate long, total_candidate long")
    matches = spark.createDataFrame([(1, 0, 'q"\n', 4, 0, 3, 0.5, None, -1.0, None, "preserved", "unknown")], "page int, ord int, scan_unit_id string, line int, start int, stop int, dx_start double, dx_end double, width_delta double, baseline_delta double, horizontal_status string, baseline_status string")
    lost = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "page int, ord int, scan_unit_id string")
    rest = spark.createDataFrame([(1, 0, 2, 0, 9)], "page int, ord int, line int, start int, stop int")
    flows = spark.createDataFrame([(1, 0, "l", [1, 2], ["v", "w"])], "page int, ord int, scan_line_id string, lines array<int>, scan_word_ids array<string>")
    said = spark.createDataFrame([(1, 0, "comparison", '{"code":"x"}'), (1, 0, "pdf", '{"code":"y"}')], "page int, ord int, list string, json string")
    made = reports.comparison(heads, matches, lost, rest, flows, said, "page", "s", {"granularity": "line", "horizontal": 1.0, "baseline": 0.25, "text": None, "geometry": 0.5})
    first, second = [r.json for r in made.orderBy("page").collect()]
    assert first == (
        '{"schema":"s","schema_version":1,"source":{"page_index":0,"raster_sha256":"ab"},"policy":{"granularity":"line","text_normalization":"exact","horizontal_tolerance_pt":1,"baseline_tolerance_pt":0.25,'
        '"min_text_confidence":{"status":"not-required"},"min_geometry_confidence":{"status":"known","value":0.5}},"content_status":"unknown","geometry_status":"unknown","overall_status":"unknown",'
        '"coverage":{"matched_scan":1,"total_scan":2,"matched_candidate":1,"total_candidate":3},"matches":[{"scan_unit_id":"q\\"\\n","candidate_line_index":4,"candidate_scalar_range":[0,3],"dx_start":0.5,"width_delta":-1,'
        '"horizontal_status":"preserved","baseline_status":"unknown"}],"unmatched_scan":["a","b"],"unmatched_candidate":[{"candidate_line_index":2,"candidate_scalar_range":[0,9]}],'
        '"reflow":[{"scan_line_id":"l","candidate_line_indices":[1,2],"scan_word_ids":["v","w"]}],"observation_diagnostics":[],"pdf_diagnostics":[{"code":"y"}],"comparison_diagnostics":[{"code":"x"}]}'
    )
    assert json.loads(second)["matches"] == []


SUBJECT = "page int, page_index int, raster_sha256 string, font_family string, font_size_pt double, font_weight string, font_style string, tracking_pt double, compiler_version string, source_sha256 string, source_size_bytes long, pdf_sha256 string, pdf_size_bytes long, comparison string"
ONE = (1, 0, "ab", "F", 10.5, "bold", "normal", 0.0, "v1", "s", 3, "p", 4, '{"a":1}')


def test_evaluation_and_attestation(spark):
    head = '"source":{"page_index":0,"raster_sha256":"ab"},"hypothesis":{"font_family":"F","font_size_pt":10.5,"font_weight":"bold","font_style":"normal","tracking_pt":0}'
    files = '"compiler_version":"v1","source_sha256":"s","source_size_bytes":3,"pdf_sha256":"p","pdf_size_bytes":4'
    own = spark.createDataFrame([ONE], SUBJECT)
    assert own.select(reports.evaluation("e").alias("j")).first().j == f'{{"schema":"e","schema_version":1,{head},{files},"comparison":{{"a":1}}}}'
    subjects = own.withColumns({"status": F.lit("violated"), "expected_scalar_count": F.lit(5), "candidate_scalar_count": F.lit(None).cast("int"), "published": F.lit(False)})
    said = spark.createDataFrame([(1, "z", None, 2), (1, "a", "R", None)], "page int, code string, resource_name string, scalar_index int")
    used = spark.createDataFrame([(1, "F1", None, "f", 3)], "page int, resource_name string, base_font string, normalized_stem string, glyph_count int")
    made = reports.attestation(subjects, said, used, "page", "t").first().json
    assert made == (
        f'{{"schema":"t","schema_version":1,{head},"fallback_policy":"forbidden",{files},"attestation":{{"status":"violated","expected_scalar_count":5,"candidate_scalar_count":null,'
        '"diagnostics":[{"code":"a","resource_name":"R","scalar_index":null},{"code":"z","resource_name":null,"scalar_index":2}],'
        '"used_resources":[{"resource_name":"F1","base_font":null,"normalized_stem":"f","glyph_count":3}]},"comparison":{"a":1},"artifact_published":false}'
    )
    with pytest.raises(Exception, match="preserved"):
        reports.attestation(subjects.withColumn("published", F.lit(True)), said, used, "page", "t").collect()


def test_search_report(spark):
    chosen = reports.selection(F.col("selected"), F.col("tied"), F.col("why"), F.lit("page"))
    heads = spark.createDataFrame([(1, 0, "ab", "F", "bold", "normal", [10.0, 11.5], [-0.0], "v1", None, [0, 1], None)], "page int, page_index int, raster_sha256 string, font_family string, font_weight string, font_style string, sizes array<double>, trackings array<double>, compiler_version string, selected int, tied array<int>, why string")
    heads = heads.select("*", chosen.alias("selection"), F.lit(None).cast("string").alias("winner"))
    fields = SUBJECT.replace("page_index int, raster_sha256 string, ", "index int, ").replace(", comparison string", "").replace("compiler_version string, ", "")
    more = ", content_status string, geometry_status string, overall_status string, matched_scan long, total_scan long, matched_candidate long, total_candidate long, reason string, horizontal_ids array<string>, baseline_ids array<string>, horizontal_violations int, horizontal_residuals array<long>, baseline_violations int, baseline_residuals array<long>"
    tail = ("preserved", "violated", "violated", 1, 1, 1, 1)
    trials = spark.createDataFrame([(1, 1, "F", 11.5, "bold", "normal", 0.0, "s", 3, "p", 4, *tail, "no-support", None, None, None, None, None, None), (1, 0, "F", 10.0, "bold", "normal", 0.0, "s", 3, "p", 4, *tail, None, ["a"], [], 1, [9, 2], 0, [])], fields + more)
    made = json.loads(reports.search(heads, trials, "page", "u").first().json)
    assert list(made) == ["schema", "schema_version", "source", "search_space", "compiler_version", "trials", "selection", "winner"]
    assert made["search_space"]["trackings_pt"] == [0] and made["search_space"]["hypothesis_count"] == 2 and made["winner"] is None
    assert made["selection"] == {"status": "tied", "indices": [0, 1], "evidence_scope": "page", "artifact_published": False}
    assert [t["index"] for t in made["trials"]] == [0, 1]
    assert made["trials"][0]["support"] == {"horizontal_scan_unit_ids": ["a"], "known_baseline_scan_unit_ids": []} and made["trials"][0]["score"]["horizontal_residuals_desc"] == [9, 2]
    assert made["trials"][1]["eligibility"] == {"status": "ineligible", "reason": "no-support"} and made["trials"][1]["score"] is None


def test_text_lines():
    page = np.full((200, 400), 255, np.uint8)
    page[20:32, 20:200] = 0
    page[34:36, 30:60] = 0
    page[60:72, 20:100] = 0
    page[60:72, 110:180] = 0
    assert raster.text_lines(page, []) == [(20, 20, 200, 36), (20, 60, 180, 72)]
    page[100:150, 300:390] = 0
    page[110:122, 20:280] = 0
    page[130:142, 20:280] = 0
    assert raster.text_lines(page, [(300, 100, 390, 150)])[2:] == [(20, 110, 280, 122), (20, 130, 280, 142)]
    assert raster.text_lines(np.full((50, 50), 255, np.uint8), []) == []
    both = np.full((200, 400), 255, np.uint8)
    both[20:32, 10:150] = 0
    both[24:36, 250:390] = 0
    assert raster.text_lines(both, []) == [(10, 20, 390, 36)]
    assert raster.text_lines(both, [(200, 5, 210, 10)]) == [(10, 20, 150, 32), (250, 24, 390, 36)]


def test_page_columns():
    page = np.full((1000, 600), 255, np.uint8)
    for y in range(300, 900, 24):
        page[y : y + 12, 50:280] = 0
        page[y : y + 12, 320:550] = 0
    page[100:130, 100:500] = 0
    made = raster.page_columns(page)
    assert [c[0] for c in made["columns"]] == [50, 320] and [c[2] for c in made["columns"]] == [280, 550]
    assert made["zones"] == [("heading", (100, 100, 500, 130))]
    assert set(made["heights"]) == {12} and set(made["steps"]) == {24.0}
    assert len(made["heights"]) == 50
    one = np.full((1000, 600), 255, np.uint8)
    one[300:900:20, 50:550] = 0
    assert raster.page_columns(one)["columns"] == [(50, 40, 550, 940)]
    assert raster.page_columns(np.full((100, 60), 255, np.uint8))["columns"] == []


def test_stamps():
    glyph = np.full((10, 8), 255, np.uint8)
    glyph[2:8, 2:5] = 0
    line = raster.stamped((20, 40), [(glyph, 5.0), (glyph, 20.0), (glyph, 38.0)], 12, 10, 10, (2, 8))
    assert (line == 0).sum() == 6 * (3 + 3 + 2) and line[6, 5] == 0 and line[5, 5] == 255
    assert raster.zoomed(glyph, 1.005) is glyph
    assert raster.zoomed(np.array([[0, 100]], np.uint8), 3.0)[0].tolist() == [0, 20, 40, 60, 80, 100]
    canvas, weight = raster.occurrence(line, "l", 20.0, 25.0, 12.0, 10.0, 10.0, (12, 12), (4, 9))
    assert (canvas == 0).sum() == 18 and canvas[3, 4] == 0
    assert weight[:, 4:10].min() == 1 and 0 < weight[5, 1] < weight[5, 3] < 1
    assert raster.occurrence(line, "i", 20.0, 25.0, 12.0, 10.0, 10.0, (12, 12), (4, 9))[1].max() == 1
    empty = raster.occurrence(line, "l", 90.0, 95.0, 12.0, 10.0, 10.0, (12, 12), (4, 9))
    assert (empty[0] == 255).all() and not empty[1].any()
    full = np.ones((10, 8))
    assert raster.atlas_glyph([(glyph, full), (np.full_like(glyph, 255), full), (np.full_like(glyph, 255), full)]).min() == 255
    faint = raster.atlas_glyph([(glyph, full), (glyph, full), (np.full_like(glyph, 255), full), (np.full_like(glyph, 255), full)])
    assert faint.min() == 95
