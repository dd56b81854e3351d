"""Readers of loose files: configuration in layers, rule files, CSV globs, archives as books, load modes."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folhario.sources.corpus import settings

#: What each way of loading keeps of a page.
MODES = {
    "ultra": None,
    "text": ("doc", "page", "text", "header", "footer", "words", "chars"),
    "images-only": ("doc", "page", "images"),
    "base64-only": ("doc", "page", "text"),
}


def load_mode(pages: DataFrame, mode: str = "ultra", custom: Sequence[str] = ()) -> DataFrame:
    """Pages as a mode loads them: all columns, text, images, base64 runs, or the columns of a custom list."""
    if mode == "custom":
        return pages.select("doc", "page", *[c for c in custom if c in pages.columns])
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    kept = MODES[mode]
    out = pages if kept is None else pages.select(*[c for c in kept if c in pages.columns])
    if mode == "base64-only":
        from folhario.functions.layout import base64_parts

        return base64_parts(out, "text").drop("text")
    return out.where("images > 0") if mode == "images-only" else out


def env_file(text: str) -> dict[str, str]:
    """NAME=value lines; comments and blank lines are skipped, quotes around a value are taken off."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            name, value = line.split("=", 1)
            out[name.strip()] = value.strip().strip("'\"")
    return out


def layered(defaults: dict, path: str | None = None, env_path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "FOLHARIO_") -> dict:
    """Settings from defaults, then a file, then an env file, then the environment; missing files are no error.

    A name of the environment is the prefix and the keys down to a setting, joined by two underscores.
    """

    def nested(values: Mapping[str, str]) -> dict:
        out: dict = {}
        for name, value in values.items():
            if name.startswith(prefix):
                keys = name[len(prefix) :].lower().split("__")
                at = out
                for k in keys[:-1]:
                    at = at.setdefault(k, {})
                try:
                    at[keys[-1]] = json.loads(value)
                except ValueError:
                    at[keys[-1]] = value
        return out

    first = rules(path) if path and os.path.isfile(path) else None
    second = None
    if env_path and os.path.isfile(env_path):
        with open(env_path, encoding="utf-8") as f:
            second = nested(env_file(f.read()))
    return settings(defaults, first, second, nested(env if env is not None else os.environ))


def rules(path: str):
    """A rule file: JSON, or YAML where a reader for it is there, or else the plain part of YAML (maps, lists, scalars by indentation)."""
    with open(path, encoding="utf-8-sig") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        return plain_yaml(text)
    return yaml.safe_load(text)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def plain_yaml(text: str):
    """Maps, lists and scalars by indentation; comments are whole lines or stand behind two blanks and a #."""
    rows = []
    for line in text.splitlines():
        body = line.split("  #")[0].rstrip()
        if body.strip() and not body.lstrip().startswith("#") and body.strip() != "---":
            rows.append((len(body) - len(body.lstrip()), body.strip()))

    def block(i: int, depth: int):
        if rows[i][1].startswith("- ") or rows[i][1] == "-":
            out: list = []
            while i < len(rows) and rows[i][0] == depth and rows[i][1][:1] == "-":
                inner = rows[i][1][1:].strip()
                if not inner:
                    value, i = block(i + 1, rows[i + 1][0])
                elif ":" in inner and (inner.endswith(":") or ": " in inner) and inner[0] not in "'\"":
                    rows[i] = (depth + 2, inner)
                    value, i = block(i, depth + 2)
                else:
                    value, i = _scalar(inner), i + 1
                out.append(value)
            return out, i
        found: dict = {}
        while i < len(rows) and rows[i][0] == depth and rows[i][1][:1] != "-":
            key, _, value = rows[i][1].partition(":")
            key = str(_scalar(key))
            if value.strip():
                found[key], i = _scalar(value), i + 1
            elif i + 1 < len(rows) and (rows[i + 1][0] > depth or rows[i + 1][0] == depth and rows[i + 1][1][:1] == "-"):
                found[key], i = block(i + 1, rows[i + 1][0])
            else:
                found[key], i = None, i + 1
        return found, i

    return block(0, rows[0][0])[0] if rows else None


def csv_glob(spark: SparkSession, path: str, separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows of all readable files, by column name; path and error of the others).

    Headers may differ between files; a mark at a file's start is taken off. Files are
    listed on the driver, which a glob of tables bounds; their rows are read by the executors.
    """
    paths = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    frames, errors = [], []
    for p in paths:
        try:
            df = spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", True).csv(p)
            if not df.columns:
                raise ValueError("no header")
            frames.append(df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns]).withColumn("source_path", F.lit(p)))
        except Exception as e:  # noqa: BLE001 - one unreadable file is reported, the others are read
            errors.append((p, str(e).splitlines()[0][:500]))
    failed = spark.createDataFrame(errors, "path string, error string")
    if not frames:
        return spark.createDataFrame([], "source_path string"), failed
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out, failed


def book_of(entries: DataFrame, pages: str = "pages") -> DataFrame:
    """Archive entries (path, entry, name, pages) as one book an archive: each entry's first page, and its name as bookmark."""
    w = Window.partitionBy("path").orderBy("entry")
    before = F.coalesce(F.sum(pages).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    title = F.regexp_replace(F.regexp_extract("name", r"([^/\\]*)$", 1), r"\.[A-Za-z0-9]+$", "")
    return entries.where(f"{pages} > 0").select("path", "entry", title.alias("title"), (before + 1).cast("int").alias("start_page"), (before + F.col(pages)).cast("int").alias("end_page"))
