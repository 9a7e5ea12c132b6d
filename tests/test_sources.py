"""Strict observations, code maps and the fold over text operators."""

from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from platen.sources import content, observations

SHA = "0" * 64


def claim(value):
    return {"status": "known", "value": value, "basis": "observed", "evidence": ["p"], "confidence": {"status": "known", "value": 0.9, "semantics": "score"}}


def unknown(reason="not-observed"):
    return {"status": "unknown", "reason": reason, "evidence": []}


def unit(name, kind, parent, order, text, span=None):
    made = {"id": name, "kind": kind, "reading_order": claim(order), "text": claim(text), "span_in_parent": claim(span) if span else unknown(), "geometry": {k: unknown() for k in ("bbox", "polygon", "baseline")}}
    return made | ({"parent_id": parent} if parent else {})


def document():
    frame = {"id": "r", "unit": "px", "origin": "top-left", "x_direction": "right", "y_direction": "down", "coordinate_basis": "pixel-edges", "extent": [100, 200]}
    return {
        "schema": "scan-observation", "schema_version": 1,
        "source": {"page_index": 0, "raster": {"artifact_id": "a", "sha256": SHA, "media_type": "image/png", "width_px": 100, "height_px": 200}},
        "producer": {"name": "n", "version": "1", "run_id": "x"}, "raster_frame": frame, "page_mapping": unknown(),
        "provenance": [{"id": "p", "stage": "other", "tool_name": "t", "tool_version": "1", "model_identifier": "m", "method": "x", "parameters_sha256": SHA, "input_artifact_ids": ["a"], "parent_provenance_ids": []}],
        "units": [unit("l", "line", None, 0, "olá mundo"), unit("w", "word", "l", 0, "mundo", {"start": 4, "end": 9})], "diagnostics": [],
    }


def broken(change):
    doc = copy.deepcopy(document())
    change(doc)
    return json.dumps(doc).encode()


def geometry(box, polygon=None, evidence=("p",)):
    made = {"bbox": claim({"frame_id": "r", **dict(zip(("x0", "y0", "x1", "y1"), box, strict=True))}), "polygon": unknown(), "baseline": unknown()}
    made["bbox"]["evidence"] = list(evidence)
    if polygon:
        made["polygon"] = claim({"frame_id": "r", "points": polygon})
    return made


def mapped(denominator):
    target = {"id": "t", "unit": "pt", "origin": "top-left", "x_direction": "right", "y_direction": "down", "extent": [10.0, 20.0]}
    return claim({"source_frame_id": "r", "target_frame": target, "kind": "homography3x3", "matrix": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, *denominator], "max_error_pt": 0.0})


CASES = [
    (broken(lambda d: [u.update(geometry=geometry((1, 1, 9, 9))) for u in d["units"]]), "$.units[1].geometry"),
    (broken(lambda d: d["units"][0].update(geometry=geometry((1, 1, 9, 9), [[1, 1], [9, 1], [9, 8]]))), "$.units[0].geometry"),
    (broken(lambda d: [d.update(page_mapping=mapped((1.0, 0.0, -5.0))), d["units"][0].update(geometry=geometry((5, 1, 9, 9)))]), "$.page_mapping.value.matrix"),
    (b"{", "$"),
    (b"\xff", "$"),
    (json.dumps(document()).replace('"schema_version": 1', '"schema_version": 1, "schema_version": 1').encode(), "$"),
    (json.dumps(document()).replace('"page_index": 0', '"page_index": 1e999').encode(), "$"),
    (broken(lambda d: d.update(schema_version=2)), "$.schema_version"),
    (broken(lambda d: d.update(more=1)), "$.more"),
    (broken(lambda d: d["units"][0].update(text=None)), "$.units[0].text"),
    (broken(lambda d: d["units"][0].update(parent_id=None)), "$.units[0].parent_id"),
    (broken(lambda d: d["units"][1].update(parent_id="z")), "$.units[1].parent_id"),
    (broken(lambda d: d["units"][1]["span_in_parent"]["value"].update(start=3)), "$.units[1].span_in_parent"),
    (broken(lambda d: d["raster_frame"].update(origin="bottom-left")), "$.raster_frame.origin"),
    (broken(lambda d: d["units"][0]["text"].update(evidence=[])), "$.units[0].text.evidence"),
    (broken(lambda d: d["provenance"][0].update(parent_provenance_ids=["p"])), "$.provenance"),
    (broken(lambda d: d["units"][0]["text"]["confidence"].update(value=True)), "$.units[0].text.confidence.value"),
]


def test_observations(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(document()))
    for n, (raw, _) in enumerate(CASES):
        (tmp_path / f"bad{n:02}.json").write_bytes(raw)
    accepted, quarantine = observations.read(spark, str(tmp_path))
    found = {r.path[-7:-5]: r.error_path for r in quarantine.collect()}
    assert found == {f"{n:02}": path for n, (_, path) in enumerate(CASES)}
    rows = {r.id: (r.kind, r.text.value, r.bbox.status, r.bbox.value) for r in observations.units(accepted).collect()}
    assert rows == {"l": ("line", "olá mundo", "unknown", None), "w": ("word", "mundo", "unknown", None)}


def test_budgets():
    with pytest.raises(observations.Fault, match="budget"):
        observations.parse(json.dumps(document()).encode(), "scan-observation", limits=observations.Limits(units=1))
    with pytest.raises(observations.Fault, match="large"):
        observations.parse(b" " * 20, "scan-observation", limits=observations.Limits(bytes=10))


def test_code_map():
    stream = b"2 beginbfchar <01> <0041> <02> <D800> endbfchar 3 beginbfrange <10> <12> <0061> <20> <22> [<0078> <>] <30> <31> <00660069> endbfrange"
    assert content.code_map(stream) == [(0, 1, 1, "A"), (1, 16, 18, "a"), (2, 32, 32, "x")]


def test_glyphs(spark):
    ops = [("cm", [2.0, 0, 0, 2.0, 0, 0], None, None), ("q", None, None, None), ("cm", [1.0, 0, 0, 1.0, 5.0, 0], None, None), ("BT", None, None, None), ("Tf", [10.0], "F", None), ("Tw", [1.0], None, None), ("Td", [3.0, 4.0], None, None),
           ("TJ", None, None, [(b"a ", None), (None, 100.0), (b"b", None)]), ("Q", None, None, None), ("Tj", None, None, [(b"c", None)]), ("ET", None, None, None), ("Tj", None, None, [(b"d", None)]), ("TX", None, None, None)]
    rows = [(1, n, op, numbers and [float(x) for x in numbers], name, None if items is None else [(None if a is None else bytearray(a), b) for a, b in items]) for n, (op, numbers, name, items) in enumerate(ops)]
    df = spark.createDataFrame(rows, "page int, op_index int, op string, numbers array<double>, name string, items array<struct<bytes:binary,adjust:double>>").orderBy(F.desc("op_index"))
    widths = spark.createDataFrame([("F", 97, 500.0), ("F", 32, 250.0)], "font string, code long, width double")
    fonts = spark.createDataFrame([("F", 1, 1000.0)], "font string, code_bytes int, default_width double")
    made = content.glyphs(df, "page", widths, fonts).collect()
    glyphs = [(r.code, r.x, r.y, r.advance) for r in sorted((r for r in made if r.code is not None), key=lambda r: r.glyph_index)]
    # A pen at (3, 4) under a doubling page matrix, moved by 5 until the state is restored.
    assert glyphs == [(97, 16.0, 8.0, 5.0), (32, 26.0, 8.0, 3.5), (98, 31.0, 8.0, 10.0), (99, 41.0, 8.0, 10.0)]
    assert {r.diagnostic for r in made} - {None} == {"text-outside-text-object", "unsupported-text-operator"}


def test_raster_binding(spark):
    import hashlib

    png = b"\x89PNG\r\n\x1a\n" + b"x"
    rasters = spark.createDataFrame([("a", bytearray(png)), ("b", bytearray(b"\xff\xd8\xff\xe0"))], "artifact_id string, content binary")
    sha = hashlib.sha256(png).hexdigest()
    rows = spark.createDataFrame([(1, "a", sha, "image/png"), (2, "a", SHA, "image/png"), (3, "a", sha, "image/jpeg"), (4, "z", sha, "image/png")], "n int, artifact_id string, sha256 string, media_type string")
    assert {r.n: r.binding for r in content.bind_raster(rows, rasters).collect()} == {1: "bound", 2: "digest", 3: "media-type", 4: "missing"}
