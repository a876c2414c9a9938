"""JSON in the answers of language models: fences, the first balanced value, wrapped lists."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import nvl, trim

# Fixed value: fields under which a list may be wrapped, in this order.
WRAPPERS = ["items", "findings", "variables", "results", "data", "list"]


def strip_fence(c: Column) -> Column:
    """The trimmed text; of one that starts with ``` what stands between its first line and its last ```."""
    t = trim(nvl(c))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"(?s)^(.*)```.*$", "$1")
    return F.when(F.startswith(t, F.lit("```")), trim(inner)).otherwise(t)


#: Strings (one that never ends goes on to the end) and brackets of one kind.
_TOKENS = {pair[0]: re.compile(rf'"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)|[{re.escape(pair)}]', re.S) for pair in ("{}", "[]")}
_BLANKS = "".join(map(chr, range(33)))


def first_value(text: str | None) -> str | None:
    """The first {...} or [...] whose brackets of its own kind balance outside strings; the rest of the text if none does; the
    whole text, without a fence around it, if it has no bracket."""
    if text is None:
        return None
    said = text.strip(_BLANKS)
    if said.startswith("```"):
        said = said.partition("\n")[2] if "\n" in said else said
        said = (said.rpartition("```")[0] if "```" in said else said).strip(_BLANKS)
    found = re.search(r"[{\[]", said)
    if found is None:
        return said
    tokens = list(_TOKENS[found.group()].finditer(said, found.start()))
    depths = accumulate({found.group(): 1, "}": -1, "]": -1}.get(t.group(), 0) for t in tokens)
    end = next((t.end() for t, depth in zip(tokens, depths) if depth == 0), len(said))
    return said[found.start() : end]


def _unwrapped(node):
    if isinstance(node, dict):
        inner = next((node[w] for w in WRAPPERS if isinstance(node.get(w), (list, dict))), None)
        return None if inner is None else _unwrapped(inner)
    out = []
    for x in node:
        inner = next((x[w] for w in WRAPPERS if isinstance(x.get(w), list)), None) if isinstance(x, dict) else None
        out += [x] if inner is None else inner
    return out


def items(text: str | None) -> list[str] | None:
    """The objects of a list, wrapped or not, each as JSON text; None where the text isn't a list."""
    try:
        node = json.loads(first_value(text) or "null")
    except ValueError:
        return None
    found = _unwrapped(node) if isinstance(node, (list, dict)) else None
    return None if found is None else [json.dumps(x, ensure_ascii=False) for x in found]


def fields(c: Column, names: list[str]) -> Column:
    """Fields of an object as strings; an object, a list or a number among them as its JSON text."""
    return F.from_json(c, ", ".join(f"`{n}` string" for n in names))


def _by_batch(one, kind: str, c: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.astype(object).where(texts.notna(), None).map(one)

    return F.pandas_udf(run, kind)(c)


def extract_json(c: Column) -> Column:
    return _by_batch(first_value, "string", c)


def json_items(c: Column) -> Column:
    return _by_batch(items, "array<string>", c)


# Under which names a recogniser gives a line's text, how sure it is, and where the line stands, by preference.
OCR_FIELDS = {
    "text": ("text", "transcription", "rec_text"),
    "confidence": ("confidence", "score", "rec_score"),
    "bbox": ("text_region", "text_box", "bbox", "points", "poly"),
}
OCR_DEPTH = 8


def _objects(root) -> Iterator[dict]:
    """The objects of a value, each before those inside it; what stands under "text" is not entered."""
    todo = [(root, 0)] if isinstance(root, (dict, list)) else []
    while todo:
        node, depth = todo.pop()
        inner = node
        if isinstance(node, dict):
            yield node
            inner = [v for k, v in node.items() if k != "text"]
        if depth < OCR_DEPTH:
            todo += [(v, depth + 1) for v in reversed(inner) if isinstance(v, (dict, list))]


def _number(x, otherwise: float) -> float:
    """A number, or a string that reads as one."""
    try:
        return float(x) if isinstance(x, (bool, int, float, str)) else otherwise
    except ValueError:
        return otherwise


def _corner(p) -> tuple[float, float] | None:
    if isinstance(p, dict):
        return (_number(p["x"], 0.0), _number(p["y"], 0.0)) if {"x", "y"} <= p.keys() else None
    plain = isinstance(p, list) and len(p) >= 2 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in p[:2])
    return (float(p[0]), float(p[1])) if plain else None


def _box(points) -> dict | None:
    corners = [_corner(p) for p in points] if isinstance(points, list) else []
    if not corners or None in corners:
        return None
    (x, w), (y, h) = ((min(v), max(v) - min(v)) for v in zip(*corners))
    return {"x": x, "y": y, "w": w, "h": h}


def ocr_lines(text: str | None) -> list[dict]:
    """Lines of text in a recogniser's answer: text (a number's digits too), confidence (1 where it is none), box. A value that is no JSON has none."""
    try:
        objects = _objects(json.loads(text or "null"))
    except ValueError:
        return []
    found = []
    for node in objects:
        said, sure, place = (next((node[n] for n in names if node.get(n) is not None), None) for names in OCR_FIELDS.values())
        if isinstance(said, bool):
            said = str(said).lower()
        if isinstance(said, (int, float, str)) and str(said).strip(_BLANKS):
            found.append({"text": str(said), "confidence": _number(sure, 1.0), "bbox": _box(place)})
    return found


OCR_LINES = "array<struct<text:string,confidence:double,bbox:struct<x:double,y:double,w:double,h:double>>>"


def parse_ocr(c: Column) -> Column:
    return _by_batch(ocr_lines, OCR_LINES, c)


def mean_confidence(lines: Column) -> Column:
    """Of recognised lines; null for none."""
    return F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.nullif(F.size(lines), F.lit(0))
