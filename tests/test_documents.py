"""JSON as rows: values, canonical texts and the rules of bundles."""

import json
import random

import pytest
from evigraph.operators import documents
from evigraph.operators.documents import ICONS


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, text string")


def test_values_are_rows(spark):
    text = '{"a":[1,{"b":"x"}],"c.d":{"e[":null},"f":[],"g":true}'
    got = {r["path"]: (r["shape"], r["parent"], r["key"], r["nth"], r["kind"], r["value"]) for r in documents.values(docs(spark, [text, "no json", None])).collect()}
    assert got == {
        "": ("", None, None, None, "object", None), ".a": (".a", "", "a", None, "array", None), ".a[0]": (".a[]", ".a", None, 0, "number", "1"), ".a[1]": (".a[]", ".a", None, 1, "object", None),
        ".a[1].b": (".a[].b", ".a[1]", "b", None, "string", "x"), ".c~1d": (".c~1d", "", "c.d", None, "object", None), ".c~1d.e~2": (".c~1d.e~2", ".c~1d", "e[", None, "null", "null"),
        ".f": (".f", "", "f", None, "array", None), ".g": (".g", "", "g", None, "boolean", "true"),
    }
    assert documents.values(docs(spark, ['{"a":{"b":{"c":1}}}']), depth=1).count() == 2


def plain(v):
    if isinstance(v, dict):
        return {k: plain(v[k]) for k in sorted(v)}
    if isinstance(v, list):
        items = [plain(x) for x in v]
        if all(isinstance(x, dict) and isinstance(x.get("id"), str) for x in items):
            items.sort(key=lambda x: x["id"])
        return items
    return v


def some(rng, depth):
    kind = rng.randrange(7) if depth else rng.randrange(2, 7)
    if kind == 0:
        return [some(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 1:
        return {k: some(rng, depth - 1) for k in rng.sample(["b", "a", 'q"u', "é", "id", "z.z"], rng.randrange(5))}
    return [7, 2.5, 'te"xt\n é', True, None][kind - 2]


def test_canonical_texts(spark):
    rng = random.Random(9)
    made = [some(rng, 5) for _ in range(40)]
    made += [{"nodes": [{"id": x, "n": i} for i, x in enumerate("cabba")], "m": [{"id": 1}, {"id": "a"}], "e": [], "o": {}}, 5, "x", [[]]]
    got = {r["doc"]: r["text"] for r in documents.canonical(documents.values(docs(spark, [json.dumps(x) for x in made]))).collect()}
    assert got == {i: json.dumps(plain(x), ensure_ascii=False, separators=(",", ":")) for i, x in enumerate(made)}
    assert documents.canonical(documents.values(docs(spark, ["{"]))).count() == 0


SOUND = {
    "manifest.json": {"schemaVersion": "1.0.0", "format": "viewer-bundle", "viewSelector": "container:x", "baseRevision": "blake3:" + "0f" * 32, "generatedAt": "now", "elementCount": 1, "edgeCount": 0.0, "evidenceCount": 1},
    "projection.json": {"nodes": [{"id": "n", "type": "container", "name": "N", "confidence": 1, "evidenceRefs": ["e"]}], "edges": [{"id": "x", "source": "n", "target": "n", "predicate": "p"}]},
    "evidence.json": {"evidence": [{"id": "e", "kind": "k", "claim": "c", "path": "p", "startLine": 0, "endLine": 1, "toolName": "t", "toolVersion": "1", "ruleId": "r", "contentHash": "h", "observedAt": "o"}]},
    "styles.json": {"theme": "t", "version": "1", "elementColors": {"context": "c"}, "edgeColors": {}},
}
NODE = SOUND["projection.json"]["nodes"][0]
EDIT = {
    "sound": ({}, set()),
    "no manifest": ({"manifest.json": ...}, {("manifest.json", "", "not found")}),
    "no evidence": ({"evidence.json": ...}, {("evidence.json", "", "not found")}),
    "nodes of another type": ({"projection.json": {"nodes": "not-an-array", "edges": []}}, {("projection.json", ".nodes", "not of type array")}),
    "unknown type of a node": ({"projection.json": {"nodes": [NODE | {"type": "invalid_kind"}], "edges": []}}, {("projection.json", ".nodes[0].type", "invalid_kind is not allowed")}),
    "a type that is no text": ({"projection.json": {"nodes": [NODE | {"type": 3}], "edges": []}}, {("projection.json", ".nodes[0].type", "3 is not allowed")}),
    "dangling": ({"projection.json": {"nodes": [NODE | {"evidenceRefs": ["e", "other"]}], "edges": []}}, {("projection.json", ".nodes[0].evidenceRefs[1]", "no evidence other")}),
    "dangling in what is unsound": ({"projection.json": {"nodes": [NODE | {"evidenceRefs": ["other"], "extra": {"deep": 1}}], "edges": []}}, {("projection.json", ".nodes[0].extra", "not allowed here")}),
    "garbled": ({"styles.json": "{"}, {("styles.json", "", "no JSON")}),
    "bounds": ({"manifest.json": SOUND["manifest.json"] | {"elementCount": -1, "edgeCount": 1.5, "schemaVersion": "1.0", "format": "other"}}, {("manifest.json", ".elementCount", "below the least"), ("manifest.json", ".edgeCount", "not of type integer"), ("manifest.json", ".schemaVersion", "does not match"), ("manifest.json", ".format", "other is not allowed")}),
    "members": ({"projection.json": {"nodes": [{"id": "", "type": "dynamic", "confidence": 1.01}, 7], "edges": []}}, {("projection.json", ".nodes[0].name", "required"), ("projection.json", ".nodes[0].id", "too short"), ("projection.json", ".nodes[0].confidence", "above the most"), ("projection.json", ".nodes[1]", "not of type object")}),
    "a list": ({"styles.json": []}, {("styles.json", "", "not of type object")}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for name, (edit, _) in EDIT.items():
        for file, content in (SOUND | edit).items():
            if content is not ...:
                rows.append((name, file, content if isinstance(content, str) else json.dumps(content)))
        rows += [(name, f"assets/{i}.png", None) for i in ICONS]
    rows += [("icons", f, json.dumps(c)) for f, c in SOUND.items()] + [("bare", f, json.dumps(c)) for f, c in SOUND.items()] + [("icons", f"assets/{i}.png", None) for i in ICONS[:4]]
    return documents.violations(spark.createDataFrame(rows, "bundle string, file string, text string"), documents.load_rules(spark)).collect()


@pytest.mark.parametrize("name", list(EDIT))
def test_rules_of_bundles(found, name):
    assert {(r["file"], r["path"], r["problem"]) for r in found if r["bundle"] == name} == EDIT[name][1]


def test_icons(found):
    assert {(r["file"], r["problem"]) for r in found if r["bundle"] == "icons"} == {(f"assets/{ICONS[4]}.png", "not found")}
    assert {(r["file"], r["problem"]) for r in found if r["bundle"] == "bare"} == {("assets/", "not found")}
