"""Duplicate groups against brute force; skyline, layers and filled fields."""

import datetime
import random

from helpers import rows

from folhario.llm import survivor

COLS = list(survivor.FIELDS) + ["extraction_method", "source_file"]
SCHEMA = "rec_id long, " + ", ".join(f"{c} string" for c in COLS) + ", start_page int, extraction_date timestamp, _group string, survivor_id int"


def table(spark, recs):
    out = []
    for r in recs:
        d = dict(r)
        out.append((d["rec_id"], *[d.get(c) for c in COLS], d.get("start_page"), d.get("extraction_date"), "clash", -1))
    return spark.createDataFrame(out, SCHEMA)


def methods(spark):
    return spark.createDataFrame([("AdvancedLayout", 1), ("SimpleText", 4)], "extraction_method string, trust_rank int")


def brute(recs):
    absent = lambda v: v is None or v.strip(" -.?").lower() in ("", "n/a", "null", "s/i")
    key = lambda p: "".join(c for c in p.lower().removeprefix("processo nº ").replace("o", "0").replace("l", "1") if c.isdigit()) if p and any(c.isdigit() for c in p) else None
    fkey = lambda f: next((w.lstrip("0") for w in "".join(c if c.isdigit() else " " for c in f.split("/")[-1]).split() if len(w) >= 6), None) if f else None
    known = {fkey(r.get("source_file")): key(r.get("processo")) for r in recs if key(r.get("processo")) and fkey(r.get("source_file"))}
    groups = {}
    for r in recs:
        p, f = key(r.get("processo")), fkey(r.get("source_file"))
        g = p or (known.get(f) or f"f{f}" if f else None)
        if g and r.get("start_page") is not None:
            groups.setdefault((g, r["start_page"]), []).append(r)
    rank = {"advancedlayout": 1, "simpletext": 4}

    def order(r):
        full = sum(not absent(r.get(c)) for c in survivor.FIELDS)
        m = (r.get("extraction_method") or "").lower().replace("-", "").replace(" ", "")
        d = r.get("extraction_date")
        return (-full, rank.get(m, 10**6), -(d.timestamp() if d else -1e18), r["rec_id"])

    return sorted((r["rec_id"], min(g, key=order)["rec_id"]) for g in groups.values() if len(g) > 1 for r in g)


def random_recs(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        p = r.randrange(12)
        num = f"2020.00.{p:07d}"
        out.append({
            "rec_id": i, "processo": r.choice([num, num.replace(".", ""), f"Processo nº {num}", num.replace("2020", "2O20"), None, "s/i"]),
            "source_file": r.choice([f"/x/{10_000_000 + p * 3}.pdf", f"000{10_000_000 + p * 3}._cache.json", None, "documento.pdf"]),
            "start_page": r.choice([1, 1, 2, None]), "extraction_method": r.choice(["AdvancedLayout", "simple-text", "Simple Text", None, "odd"]),
            "extraction_date": r.choice([None, datetime.datetime(2024, 1, r.randrange(1, 5))]), "juizo": r.choice(["a", None, " ", "N/A"]), "autor": r.choice(["b", "--"]), "comarca": r.choice(["c", None]),
        })
    return out


def test_against_brute_force(spark):
    for seed in range(4):
        recs = random_recs(150, seed)
        got = rows(survivor.survivors(table(spark, recs), methods(spark)), "rec_id", "survivor_id")
        assert got == brute(recs)


def test_golden_takes_fields_layer_by_layer(spark):
    d = datetime.datetime
    recs = [
        {"rec_id": 1, "processo": "2020.00.0000001", "start_page": 1, "juizo": "j", "autor": "a", "extraction_method": "SimpleText", "extraction_date": d(2024, 1, 1)},
        {"rec_id": 2, "processo": "2020000000001", "start_page": 1, "comarca": "c2", "extraction_method": "AdvancedLayout", "extraction_date": d(2024, 1, 2)},
        {"rec_id": 3, "processo": "2020000000001", "start_page": 1, "comarca": "c3", "destino": "n/a", "extraction_method": "SimpleText", "extraction_date": d(2024, 1, 1)},
    ]
    g = survivor.golden(table(spark, recs), methods(spark)).collect()
    assert len(g) == 1 and (g[0].survivor_id, g[0].members, g[0].juizo, g[0].comarca, g[0].destino) == (1, 3, "j", "c2", None)


def test_one_huge_group_and_an_empty_table(spark):
    recs = [{"rec_id": i, "processo": "2020.00.0000001", "start_page": 1, "juizo": "x" if i == 77 else None} for i in range(3000)]
    got = rows(survivor.survivors(table(spark, recs), methods(spark)), "survivor_id")
    assert len(got) == 3000 and set(got) == {(77,)}
    assert survivor.survivors(table(spark, []), methods(spark)).count() == 0
    assert survivor.golden(table(spark, []), methods(spark)).count() == 0
