"""Nested records against a recursive brute force; odd records; interval labels."""

import json

from helpers import rows

from folhario.operators import nested


def unwrapped(v):
    while isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return None
    return v


def brute(text):
    """(kind, node_id, parent_id) by plain recursion."""
    v = unwrapped(text)
    fold = lambda d: {k.lower().replace("_", ""): unwrapped(x) for k, x in d.items()}
    while isinstance(v, dict) and fold(v).get("analysis") is not None:
        v = fold(v)["analysis"]
    out = []
    many = lambda x: [unwrapped(y) for y in x] if isinstance(x, list) else [] if x is None else [x]

    def inside(x, key):
        """The entries under `key` of every object of a container."""
        return [z for y in many(x) if isinstance(y, dict) for z in many(fold(y).get(key))]

    def put(kind, items, parent, then=None):
        for i, x in enumerate(items):
            if isinstance(x, dict):
                node = f"{parent}.{i}" if parent else str(i)
                out.append((kind, node, parent))
                if then:
                    then(fold(x), node)

    def page(p, node):
        put("font", inside(p.get("textinfo"), "fonts"), node)
        put("image", inside(p.get("resources"), "images"), node)
        put("form_field", inside(p.get("resources"), "formfields"), node)
        put("annotation", many(p.get("annotations")), node)

    def mark(m, node):
        put("bookmark", many(m.get("children")), node, mark)

    if isinstance(v, dict):
        v = fold(v)
        put("page", many(v.get("pages")), "", page)
        put("signature", many(v.get("signatures")), "")
        put("bookmark", inside(v.get("bookmarks"), "rootitems"), "", mark)
    return sorted(out)


DOC = {
    "Pages": [
        {"TextInfo": {"Fonts": [{"Name": "A"}, None, {"Name": "B"}]}, "Resources": {"Images": {"Name": "I"}, "FormFields": None}, "Annotations": [1, {"Type": "x"}]},
        None,
        {"TextInfo": None, "Resources": [], "Annotations": {"Type": "y", "Pages": [{"no": 1}]}},
    ],
    "Bookmarks": {"RootItems": [{"Title": "a", "Children": [{"Title": "b", "Children": {"Title": "c"}}, None, {"Title": "d"}]}, {"Title": "e"}]},
    "Signatures": {"SignerName": "s"},
}
WRAPPED = {**DOC, "Bookmarks": json.dumps(json.dumps(DOC["Bookmarks"])), "Pages": json.dumps([json.dumps(p) for p in DOC["Pages"]]), "Analysis": None}
TWICE = {"pages": [{"Resources": [{"Images": [{"n": 1}, None]}, 3, {"Images": {"n": 2}, "FormFields": [{}]}], "TextInfo": [{"Fonts": [{}]}, {"Fonts": None}, {"Fonts": [{}, {}]}]}], "bookmarks": [{"rootItems": [{}]}, {"rootItems": [{"children": [{}]}]}]}


def wrapped(times):
    text = json.dumps(DOC)
    for _ in range(times):
        text = json.dumps(text)
    return text


CASES = [
    json.dumps(WRAPPED), json.dumps(TWICE), wrapped(9), json.dumps({"analysis": {"analysis": json.dumps({"analysis": DOC})}}), json.dumps(DOC), json.dumps(json.dumps(DOC)), json.dumps({"version": 1, "analysis": DOC}), json.dumps({"file_path": "x", "pages": {"text_info": {"fonts": [{}]}}}), json.dumps(DOC)[:-20],
    "", "   ", None, "null", "[]", "3", "{}", '{"Pages": "none"}', json.dumps(DOC, indent=2),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(str(i), c, "clash", 1) for i, c in enumerate(CASES)], "process_number string, raw_json string, kind string, pre int")
    got = rows(nested.flatten(df), "key", "kind", "node_id", "parent_id")
    assert got == sorted((str(i), *x) for i, c in enumerate(CASES) for x in brute(c))


def test_real_records(spark):
    import os

    from helpers import SMALL

    if not os.path.isdir(SMALL):
        return
    df = spark.read.parquet(f"{SMALL}/raw_processes.parquet")
    want = sorted((r.process_number, *x) for r in df.collect() for x in brute(r.raw_json))
    assert rows(nested.flatten(df), "key", "kind", "node_id", "parent_id") == want


def test_containers_of_several_objects_and_inner_text():
    kinds = lambda text: sorted((n[0], n[4]) for n in nested.label(text))
    assert [x for x in kinds(json.dumps(TWICE)) if x[0] == "image"] == [("image", "0.0"), ("image", "0.2")]
    assert kinds(json.dumps(WRAPPED)) == kinds(json.dumps(DOC)) == kinds(wrapped(9))


def test_intervals_enclose():
    nodes = {n[4]: n for n in nested.label(json.dumps(DOC)) if n[0] == "bookmark"}
    a, c = nodes["0"], nodes["0.0.0"]
    assert a[2] < c[2] and a[3] > c[3]


def test_nesting_beyond_the_recursion_limit():
    deep = '{"bookmarks": {"rootItems": [' + '{"title": "x", "children": [' * 3000 + "]}" * 3000 + "]}}"
    assert sum(n[0] == "bookmark" for n in nested.label(deep)) == 3000


def test_empty_table(spark):
    df = spark.createDataFrame([], "process_number string, raw_json string")
    assert nested.flatten(df).count() == 0
