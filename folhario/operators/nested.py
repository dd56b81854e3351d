"""Deeply nested JSON records to flat tables, by interval labels.

A depth-first walk gives every JSON value a pre-order and a post-order number. A value
lies inside another exactly when its interval lies inside the other's, so parents are
found from the numbers alone: among the nodes one level up, the parent is the last one
opened before the child. That last-before search is a window, not a join, so it costs
one shuffle however deep the tree is.

Defined cases: a null, empty, blank, cut-off or otherwise unreadable record gives no
nodes; JSON text inside a JSON string is unwrapped wherever the walk meets it, however
often it is wrapped; keys are compared without case and underscores; one object in place
of a list is a list of one, and several objects in place of one are all walked, their
nodes numbered on; a null or scalar entry keeps its position and gives no node; repeated
records give the same nodes again, told apart by `key`; columns of the input other than
the two named are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json import JSONDecodeError

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: kind -> path of normalised keys from the enclosing node of the named kind (None: the root).
LAYOUT = {
    "page": (None, ("pages",)),
    "font": ("page", ("textinfo", "fonts")),
    "image": ("page", ("resources", "images")),
    "form_field": ("page", ("resources", "formfields")),
    "annotation": ("page", ("annotations",)),
    "signature": (None, ("signatures",)),
    "bookmark": (None, ("bookmarks", "rootitems")),
}
#: kinds that may hold nodes of their own kind, and under which key.
RECURSIVE = {"bookmark": ("children",)}
#: keys under which a record may wrap the analysis itself.
ENVELOPES = ("analysis",)
NODE_SCHEMA = "key string, kind string, level int, pre long, post long, node_id string, body string"


def _norm(key: str) -> str:
    return key.replace("_", "").lower()


def _scan(text: str):
    """json.loads without recursion, for nesting beyond the library's limit."""
    decoder, i, n = json.JSONDecoder(), 0, len(text)
    stack: list = []
    keys: list = []
    state, out = "value", None

    def put(value):
        nonlocal out
        if not stack:
            out = value
        elif isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = value
        else:
            stack[-1].append(value)

    while True:
        while i < n and text[i] in " \t\n\r":
            i += 1
        if state == "done":
            if i != n:
                raise JSONDecodeError("Extra data", text, i)
            return out
        if i >= n:
            raise JSONDecodeError("Unexpected end", text, i)
        c = text[i]
        if state in ("value", "first") and not (state == "first" and c in "]}"):
            if stack and isinstance(stack[-1], dict):
                if c != '"':
                    raise JSONDecodeError("Expecting a key", text, i)
                key, i = decoder.raw_decode(text, i)
                while i < n and text[i] in " \t\n\r":
                    i += 1
                if text[i : i + 1] != ":":
                    raise JSONDecodeError("Expecting ':'", text, i)
                i += 1
                while i < n and text[i] in " \t\n\r":
                    i += 1
                keys[-1] = key
                c = text[i : i + 1]
            if c and c in "{[":
                new = {} if c == "{" else []
                put(new)
                stack.append(new)
                keys.append(None)
                i, state = i + 1, "first"
                continue
            value, i = decoder.raw_decode(text, i)
            put(value)
            state = "after" if stack else "done"
        elif c == "," and state == "after":
            i, state = i + 1, "value"
        elif c in "]}" and stack and (c == "}") == isinstance(stack[-1], dict):
            stack.pop()
            keys.pop()
            i, state = i + 1, "after" if stack else "done"
        else:
            raise JSONDecodeError("Unexpected character", text, i)


def parse(text: str | None):
    """The record's JSON value, or None where there is none. Strings that hold JSON are unwrapped."""
    value = text
    while isinstance(value, str):  # every pass takes off a pair of quotes
        body = value.strip().lstrip("﻿")
        if not body:
            return None
        try:
            value = json.loads(body)
        except RecursionError:
            try:
                value = _scan(body)
            except JSONDecodeError:
                return None
        except ValueError:
            return None
    return value


def analysis(text: str | None) -> dict | None:
    """The analysis that a record holds, out of its envelopes; None where there is none."""
    root = parse(text)
    while isinstance(root, dict):  # every pass goes one level down
        inner = next((v for k, v in root.items() if _norm(str(k)) in ENVELOPES and v is not None), None)
        if inner is None:
            break
        root = parse(inner)
    return root if isinstance(root, dict) else None


def label(text: str | None) -> Iterator[tuple[str, int, int, int, str, str]]:
    """(kind, level, pre, post, node_id, body) of every typed node, in post order.

    The walk is iterative: a frame is entered (pre), its children are pushed, and it is
    left (post) once they are done. `level` counts typed ancestors.
    """
    root = analysis(text)
    if root is None:
        return
    clock_pre = clock_post = 0
    # frame: value, kind of this node or None, typed kind above, keys walked since it, position path, level
    stack: list = [(root, None, None, (), "", 0, False)]
    opened: dict[int, int] = {}
    numbered: dict[tuple, int] = {}  # entries met so far, by node and kind
    starts = {(k[0], k[1][: i + 1]) for k in LAYOUT.values() for i in range(len(k[1]))}
    starts |= {(k, v[: i + 1]) for k, v in RECURSIVE.items() for i in range(len(v))}
    ends = {(above, path): kind for kind, (above, path) in LAYOUT.items()}
    ends |= {(kind, path): kind for kind, path in RECURSIVE.items()}
    while stack:
        value, kind, above, walked, path, level, leaving = stack.pop()
        if leaving:
            clock_post += 1
            if kind:
                plain = {k: v for k, v in value.items() if not isinstance(v, (dict, list))}
                yield kind, level, opened.pop(id(value)), clock_post, path, json.dumps(plain, ensure_ascii=False)
            continue
        clock_pre += 1
        stack.append((value, kind, above, walked, path, level, True))
        if kind:
            opened[id(value)] = clock_pre
            above, walked, level = kind, (), level + 1
        if not isinstance(value, dict):
            continue
        todo = []
        for key, child in value.items():
            way = (*walked, _norm(str(key)))
            if (above, way) not in starts:
                continue
            child = parse(child)
            target = ends.get((above, way))
            items = child if isinstance(child, list) else [] if child is None else [child]
            first = numbered.get((above, path, target), 0) if target else 0
            if target:
                numbered[above, path, target] = first + len(items)
            for i, item in enumerate(items, first):
                item = parse(item)
                if isinstance(item, dict):
                    todo.append((item, target, above, (), f"{path}.{i}" if path else str(i), level, False) if target else (item, None, above, way, path, level, False))
        stack.extend(reversed(todo))


def interval_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every typed node of `df[text]` with its interval. One row in gives any number out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *node) for k, t in zip(batch["key"], batch["text"]) for node in label(t)]
            yield pd.DataFrame(rows, columns=["key", "kind", "level", "pre", "post", "node_id", "body"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(run, NODE_SCHEMA)


def link_by_containment(nodes: DataFrame) -> DataFrame:
    """`nodes` with `parent_id`: the node one level up whose interval encloses theirs.

    Every node is seen twice, as a possible parent under its own level and as a child
    under the level above; ordered by pre-order number, the last parent seen is the only
    one that can enclose the child, which the post-order numbers confirm.
    """
    own = nodes.select("*", F.col("level").alias("_at"), F.lit(0).alias("_child"))
    up = nodes.where("level > 0").select("*", (F.col("level") - 1).alias("_at"), F.lit(1).alias("_child"))
    w = Window.partitionBy("key", "_at").orderBy("pre", "_child")
    last = F.last(F.when(F.col("_child") == 0, F.struct("node_id", "post")), ignorenulls=True).over(w)
    linked = own.unionByName(up).withColumn("_parent", last).where("_child = 1 or level = 0")
    inside = F.col("_parent.post") > F.col("post")
    return linked.select(
        "key", "kind", "level", "pre", "post", "node_id", "body",
        F.when((F.col("_child") == 1) & inside, F.col("_parent.node_id")).otherwise(F.lit("")).alias("parent_id"),
    )


def flatten(df: DataFrame, key: str = "process_number", text: str = "raw_json") -> DataFrame:
    """All node tables in one: key, kind, node_id, parent_id, interval and plain fields as JSON."""
    return link_by_containment(interval_nodes(df, key, text))


def sections(df: DataFrame, key: str = "process_number", text: str = "raw_json") -> DataFrame:
    """(key, section, body): a row for each top-level part of a record that isn't null, with its plain fields as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                for name, part in (analysis(t) or {}).items():
                    inner = parse(part) if isinstance(part, str) and part.lstrip()[:1] in "{[" else part
                    if inner is not None:
                        plain = {a: b for a, b in inner.items() if not isinstance(b, (dict, list))} if isinstance(inner, dict) else {}
                        rows.append((k, _norm(str(name)), json.dumps(plain, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["key", "section", "body"])

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(run, "key string, section string, body string")


def node_table(flat: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind."""
    return flat.where(F.col("kind") == kind).drop("kind")


PAGE_SCHEMA = "key string, page int, width double, height double, rotation int, words long, text string, fonts array<string>, images array<struct<width:long,height:long>>, annotations int"


def page_rows(df: DataFrame, key: str = "process_number", text: str = "raw_json") -> DataFrame:
    """One row a page of every record: its place in the list from 1, size, rotation, words, text, fonts, image sizes, annotations."""

    def at(part, *names):
        for name in names:
            part = parse(part)
            part = part[0] if isinstance(part, list) and part else part
            part = next((v for k, v in part.items() if _norm(str(k)) == name), None) if isinstance(part, dict) else None
        return part

    def many(part) -> list:
        part = parse(part)
        return [x for x in (part if isinstance(part, list) else [part]) if isinstance(x, dict)]

    def number(v, kind):
        try:
            return None if isinstance(v, bool) else kind(v)
        except (TypeError, ValueError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"]):
                pages = parse(at(analysis(t), "pages")) if analysis(t) else None
                for i, p in enumerate(pages if isinstance(pages, list) else [pages], 1):
                    if not isinstance(p, dict):
                        continue
                    pics = [{"width": number(at(x, "width"), int), "height": number(at(x, "height"), int)} for x in many(at(p, "resources", "images"))]
                    rows.append((
                        k, i, number(at(p, "size", "width"), float), number(at(p, "size", "height"), float), number(at(p, "rotation"), int), number(at(p, "textinfo", "wordcount"), int), at(p, "textinfo", "pagetext"),
                        [n for x in many(at(p, "textinfo", "fonts")) if isinstance(n := at(x, "name"), str)], pics, len(many(at(p, "annotations"))),
                    ))
            frame = pd.DataFrame(rows, columns=["key", "page", "width", "height", "rotation", "words", "text", "fonts", "images", "annotations"])
            yield frame.astype({"rotation": "Int32", "words": "Int64"})

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).mapInPandas(run, PAGE_SCHEMA)
