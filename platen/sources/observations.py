"""Strict JSON observations of scanned pages: one document per file or row, accepted whole or rejected with a path.

A document is checked in this order, and the first fault is reported: size, encoding, duplicate keys and numbers
beyond doubles, schema and version, fields and types, budgets, then the contract between units, claims,
provenance and frames. What is accepted becomes rows of a fixed nested type; what is rejected, a row in
quarantine.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.functions.claims import REASONS


@dataclass(frozen=True)
class Limits:
    """Budgets of one document."""

    bytes: int = 16 << 20
    units: int = 100_000
    provenance: int = 10_000
    points: int = 1_000_000
    text_bytes: int = 8 << 20


class Fault(ValueError):
    def __init__(self, path: str, why: str) -> None:
        super().__init__(f"{path}: {why}")
        self.path, self.why = path, why


# A field's type: a name, {field: type} for an object, [type] for a list, (type, n) for a list of n,
# a set for one of these words, ("claim", type) for a claim; a field's name ending in ? may be absent.
_CONFIDENCE = {"known": {"value": "number", "semantics": "string"}, "unknown": {"reason": set(REASONS)}}
_POINTS = {"frame_id": "string", "points": [("number", 2)]}
_FRAME = {"id": "string", "unit": "string", "origin": "string", "x_direction": "string", "y_direction": "string"}
SHAPE = {
    "schema": "string",
    "schema_version": "count",
    "source": {"page_index": "count", "raster": {"artifact_id": "string", "sha256": "string", "media_type": "string", "width_px": "count", "height_px": "count"}},
    "producer": {"name": "string", "version": "string", "run_id": "string"},
    "raster_frame": _FRAME | {"coordinate_basis": "string", "extent": ("count", 2)},
    "page_mapping": ("claim", {"source_frame_id": "string", "target_frame": _FRAME | {"extent": ("number", 2)}, "kind": {"homography3x3"}, "matrix": ("number", 9), "max_error_pt": "number"}),
    "provenance": [{
        "id": "string", "stage": {"layout-detection", "text-recognition", "segmentation", "coordinate-transform", "manual-annotation", "other"}, "tool_name": "string", "tool_version": "string",
        "model_identifier": "string", "method": "string", "parameters_sha256": "string", "input_artifact_ids": ["string"], "parent_provenance_ids": ["string"],
    }],
    "units": [{
        "id": "string", "kind": {"region", "line", "word", "glyph"}, "parent_id?": "string", "reading_order": ("claim", "count"), "text": ("claim", "string"),
        "span_in_parent": ("claim", {"start": "count", "end": "count"}),
        "geometry": {"bbox": ("claim", {"frame_id": "string", "x0": "number", "y0": "number", "x1": "number", "y1": "number"}), "polygon": ("claim", _POINTS), "baseline": ("claim", _POINTS)},
    }],
    "diagnostics": [{"level": {"information", "warning"}, "code": "string", "detail": "string"}],
}
PARENTS = {"region": {None, "region"}, "line": {None, "region"}, "word": {None, "line"}, "glyph": {None, "word"}}
CLAIM = "struct<status:string, value:{}, basis:string, evidence:array<string>, confidence:double, reason:string, detail:string>"
UNIT = (
    "struct<id:string, kind:string, parent_id:string, reading_order:" + CLAIM.format("bigint") + ", text:" + CLAIM.format("string") + ", span_in_parent:" + CLAIM.format("struct<start:bigint, end:bigint>")
    + ", bbox:" + CLAIM.format("struct<x0:double, y0:double, x1:double, y1:double>") + ", baseline:" + CLAIM.format("array<struct<x:double, y:double>>") + ">"
)
SCHEMA = (
    "path string, error_path string, error string, page_index bigint, artifact_id string, sha256 string, media_type string, width_px bigint, height_px bigint, "
    f"page_mapping {CLAIM.format('array<double>')}, units array<{UNIT}>"
)


def _object(pairs: list[tuple]) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        seen: set = set()
        twice = next(k for k, _ in pairs if k in seen or seen.add(k))
        raise Fault("$", f"duplicate key {twice!r}")
    return made


def _number(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise Fault("$", f"number out of range: {text}")
    return x


def _refuse(text: str) -> float:
    raise Fault("$", f"not a JSON number: {text}")


def check(value: object, shape: object, path: str = "$") -> None:
    """Raises Fault at the first value that doesn't have the shape."""
    if isinstance(shape, str):
        whole = isinstance(value, int) and not isinstance(value, bool)
        good = {"string": isinstance(value, str), "count": whole and 0 <= value < 2**63, "number": whole or isinstance(value, float)}[shape]
        if not good:
            raise Fault(path, f"expected a {shape}")
    elif isinstance(shape, set):
        if value not in shape if isinstance(value, str) else True:
            raise Fault(path, "expected one of " + ", ".join(sorted(shape)))
    elif isinstance(shape, list):
        if not isinstance(value, list):
            raise Fault(path, "expected a list")
        for n, x in enumerate(value):
            check(x, shape[0], f"{path}[{n}]")
    elif isinstance(shape, tuple) and shape[0] == "claim":
        known = {"status": {"known"}, "value": shape[1], "basis": {"observed", "inferred", "derived", "asserted"}, "evidence": ["string"], "confidence": ("tagged", _CONFIDENCE)}
        check(value, ("tagged", {"known": known, "unknown": {"status": {"unknown"}, "reason": set(REASONS), "evidence": ["string"], "detail?": "string"}}), path)
    elif isinstance(shape, tuple) and shape[0] == "tagged":
        if not isinstance(value, dict) or not isinstance(value.get("status"), str) or value["status"] not in shape[1]:
            raise Fault(path, "expected a known or unknown status")
        check(value, {"status": {value["status"]}} | shape[1][value["status"]], path)
    elif isinstance(shape, tuple):
        if not isinstance(value, list) or len(value) != shape[1]:
            raise Fault(path, f"expected {shape[1]} values")
        check(value, [shape[0]], path)
    else:
        if not isinstance(value, dict):
            raise Fault(path, "expected an object")
        names = {k.rstrip("?"): k for k in shape}
        for k in value:
            if k not in names:
                raise Fault(f"{path}.{k}", "unknown field")
        for k, field in names.items():
            if k in value:
                check(value[k], shape[field], f"{path}.{k}")
            elif not field.endswith("?"):
                raise Fault(f"{path}.{k}", "missing field")


def _budgets(doc: dict, limits: Limits) -> None:
    points, text = 0, 0
    for unit in doc["units"]:
        for name in ("polygon", "baseline"):
            points += len(unit["geometry"][name].get("value", {}).get("points", ()))
        text += len(unit["text"].get("value", "").encode("utf-8", "surrogatepass"))
    for name, n, most in (("units", len(doc["units"]), limits.units), ("provenance", len(doc["provenance"]), limits.provenance), ("units", points, limits.points), ("units", text, limits.text_bytes)):
        if n > most:
            raise Fault(f"$.{name}", "budget exceeded")


def _acyclic(parents: dict[str, list[str]], path: str) -> None:
    done: set[str] = set()
    for start in parents:
        open_, stack = set(), [(start, False)]
        while stack:
            node, leave = stack.pop()
            if leave:
                open_.discard(node)
                done.add(node)
            elif node in open_:
                raise Fault(path, f"a cycle through {node!r}")
            elif node not in done:
                open_.add(node)
                stack.append((node, True))
                stack += [(p, False) for p in parents[node] if p not in done]
    return None


#: Fixed value: the spacing of doubles at one.
EPSILON = 2.220446049250313e-16


def _same_known(a: dict, b: dict) -> bool:
    return a["status"] == b["status"] == "known" and a["value"] == b["value"] and a["evidence"] == b["evidence"]


def _contract(doc: dict) -> None:
    """Between the parts of a document: identities, references, hierarchy, spans, claims, frames."""
    raster, frame = doc["source"]["raster"], doc["raster_frame"]
    if frame["extent"] != [raster["width_px"], raster["height_px"]] or 0 in frame["extent"]:
        raise Fault("$.raster_frame.extent", "differs from the raster's size")
    wanted = {"unit": "px", "origin": "top-left", "x_direction": "right", "y_direction": "down", "coordinate_basis": "pixel-edges"}
    for k, v in wanted.items():
        if frame[k] != v:
            raise Fault(f"$.raster_frame.{k}", f"expected {v!r}")
    if len(raster["sha256"]) != 64 or set(raster["sha256"]) - set("0123456789abcdef"):
        raise Fault("$.source.raster.sha256", "expected 64 lower-case hex digits")
    records = {}
    for n, r in enumerate(doc["provenance"]):
        if not r["id"] or r["id"] in records:
            raise Fault(f"$.provenance[{n}].id", "empty or used before")
        records[r["id"]] = r["parent_provenance_ids"]
    for n, r in enumerate(doc["provenance"]):
        if set(r["parent_provenance_ids"]) - set(records):
            raise Fault(f"$.provenance[{n}].parent_provenance_ids", "names no record")
    _acyclic(records, "$.provenance")

    def claim(c: dict, path: str) -> object:
        if set(c["evidence"]) - set(records):
            raise Fault(f"{path}.evidence", "names no record")
        if c["status"] == "unknown":
            return None
        if not c["evidence"]:
            raise Fault(f"{path}.evidence", "a known claim needs evidence")
        sure = c["confidence"]
        if sure["status"] == "known" and not 0 <= sure["value"] <= 1:
            raise Fault(f"{path}.confidence.value", "expected 0 to 1")
        return c["value"]

    mapping = claim(doc["page_mapping"], "$.page_mapping")
    if mapping is not None:
        m = mapping["matrix"]
        det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
        if mapping["source_frame_id"] != frame["id"] or not abs(det) > EPSILON or mapping["max_error_pt"] < 0:
            raise Fault("$.page_mapping.value", "another frame, a singular matrix or a negative error")
    units: dict[str, dict] = {}
    for n, u in enumerate(doc["units"]):
        if not u["id"] or u["id"] in units:
            raise Fault(f"$.units[{n}].id", "empty or used before")
        units[u["id"]] = u
    orders: set[tuple] = set()
    for n, u in enumerate(doc["units"]):
        path, up = f"$.units[{n}]", u.get("parent_id")
        if up is not None and up not in units:
            raise Fault(f"{path}.parent_id", "names no unit")
        if (units[up]["kind"] if up is not None else None) not in PARENTS[u["kind"]]:
            raise Fault(f"{path}.parent_id", "a parent of another kind")
        order = claim(u["reading_order"], f"{path}.reading_order")
        if order is not None and ((up or "", order) in orders or orders.add((up or "", order))):
            raise Fault(f"{path}.reading_order", "siblings share an order")
        text, span = claim(u["text"], f"{path}.text"), claim(u["span_in_parent"], f"{path}.span_in_parent")
        if span is not None:
            above = claim(units[up]["text"], path) if up is not None else None
            if above is None or text is None or not 0 <= span["start"] < span["end"] <= len(above) or above[span["start"] : span["end"]] != text:
                raise Fault(f"{path}.span_in_parent", "doesn't select the unit's text")
        for name in ("bbox", "polygon", "baseline"):
            value = claim(u["geometry"][name], f"{path}.geometry.{name}")
            if value is None:
                continue
            points = [(value["x0"], value["y0"]), (value["x1"], value["y1"])] if name == "bbox" else value["points"]
            inside = all(0 <= x <= raster["width_px"] and 0 <= y <= raster["height_px"] for x, y in points)
            least = {"bbox": 2, "polygon": 3, "baseline": 2}[name]
            if value["frame_id"] != frame["id"] or not inside or len(points) < least:
                raise Fault(f"{path}.geometry.{name}", "another frame, outside of it, or too few points")
            if name == "bbox" and not (value["x0"] < value["x1"] and value["y0"] < value["y1"]):
                raise Fault(f"{path}.geometry.bbox", "without area")
            if mapping is not None:
                corners = [(x, y) for x in (value["x0"], value["x1"]) for y in (value["y0"], value["y1"])] if name == "bbox" else points
                for x, y in corners:
                    d = mapping["matrix"][6] * x + mapping["matrix"][7] * y + mapping["matrix"][8]
                    if not abs(d) > EPSILON or abs(d) == float("inf"):
                        raise Fault("$.page_mapping.value.matrix", "a denominator vanishes at observed geometry")
            if up is not None and _same_known(u["geometry"][name], units[up]["geometry"][name]):
                raise Fault(f"{path}.geometry", "copies the parent's geometry and evidence")
        box, outline = (u["geometry"][x].get("value") if u["geometry"][x]["status"] == "known" else None for x in ("bbox", "polygon"))
        if box is not None and outline is not None:
            xs, ys = zip(*outline["points"], strict=True)
            if any(abs(x - y) > 1e-9 for x, y in zip((box["x0"], box["y0"], box["x1"], box["y1"]), (min(xs), min(ys), max(xs), max(ys)), strict=True)):
                raise Fault(f"{path}.geometry", "a known box is the envelope of a known polygon")
    _acyclic({k: [u["parent_id"]] if u.get("parent_id") is not None else [] for k, u in units.items()}, "$.units")


def parse(content: bytes, schema: str, version: int = 1, limits: Limits | None = None) -> dict:
    """A checked document, or a Fault."""
    limits = limits or Limits()
    if len(content) > limits.bytes:
        raise Fault("$", "too large")
    try:
        doc = json.loads(content.decode("utf-8"), object_pairs_hook=_object, parse_float=_number, parse_constant=_refuse)
    except UnicodeDecodeError:
        raise Fault("$", "not UTF-8") from None
    except (json.JSONDecodeError, RecursionError) as e:
        raise Fault("$", f"not JSON: {e}") from None
    if not isinstance(doc, dict) or doc.get("schema") != schema:
        raise Fault("$.schema", f"expected {schema!r}")
    if doc.get("schema_version") != version or isinstance(doc["schema_version"], bool):
        raise Fault("$.schema_version", f"expected {version}")
    check(doc, SHAPE)
    _budgets(doc, limits)
    _contract(doc)
    return doc


def _claim(c: dict, value=lambda x: x) -> dict:
    known = c["status"] == "known"
    sure = c.get("confidence", {})
    return {"status": c["status"], "value": value(c["value"]) if known else None, "basis": c.get("basis"), "evidence": c["evidence"], "confidence": float(sure["value"]) if sure.get("status") == "known" else None, "reason": c.get("reason"), "detail": c.get("detail")}


def _row(doc: dict) -> dict:
    raster = doc["source"]["raster"]
    box = lambda v: {k: float(v[k]) for k in ("x0", "y0", "x1", "y1")}
    line = lambda v: [{"x": float(x), "y": float(y)} for x, y in v["points"]]
    units = [
        {
            "id": u["id"], "kind": u["kind"], "parent_id": u.get("parent_id"), "reading_order": _claim(u["reading_order"]), "text": _claim(u["text"]),
            "span_in_parent": _claim(u["span_in_parent"]), "bbox": _claim(u["geometry"]["bbox"], box), "baseline": _claim(u["geometry"]["baseline"], line),
        }
        for u in doc["units"]
    ]
    return {"page_index": doc["source"]["page_index"], **raster, "page_mapping": _claim(doc["page_mapping"], lambda v: [float(x) for x in v["matrix"]]), "units": units}


def parsed(files: DataFrame, schema: str, version: int = 1, limits: Limits | None = None) -> DataFrame:
    """files: path, content. A row per file: its fields, or error_path and error; no file stops the job."""
    names = [x.split(" ", 1)[0] for x in SCHEMA.split(", ")[:9]] + ["page_mapping", "units"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append({"path": path, **_row(parse(bytes(content), schema, version, limits))})
                except Fault as e:
                    rows.append({"path": path, "error_path": e.path, "error": e.why})
            yield pd.DataFrame(rows).reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, schema: str = "scan-observation", version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) of the JSON files under path."""
    rows = parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), schema, version)
    return rows.where("error IS NULL").drop("error", "error_path"), rows.where("error IS NOT NULL").select("path", "error_path", "error")


def units(accepted: DataFrame) -> DataFrame:
    """A row per unit."""
    return accepted.select("path", "page_index", F.explode("units").alias("u")).select("path", "page_index", "u.*")
