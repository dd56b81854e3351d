"""Queries over the flat tables of nested records, and the SQL that walks the same records step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from folhario.operators import sift
from folhario.operators.nested import flatten, sections
from folhario.plans.base import Plans
from folhario.runtime import table

plan = Plans()


def _get(j: str, key: str) -> str:
    """The value under a key, keys compared without case and underscores."""
    return f"json_extract({j}, '$.\"' || list_filter(json_keys({j}), lambda k: replace(lower(k), '_', '') = '{key}')[1] || '\"')"


def _open(j: str) -> str:
    """JSON text inside a JSON string, one layer of it."""
    return f"CASE WHEN json_type({j}) = 'VARCHAR' THEN coalesce(TRY_CAST(({j} ->> '$') AS JSON), {j}) ELSE {j} END"


def _many(j: str) -> str:
    return f"CASE json_type({j}) WHEN 'ARRAY' THEN json_extract({j}, '$[*]') WHEN 'OBJECT' THEN [{j}] ELSE [] END"


def _first(j: str) -> str:
    return f"CASE WHEN json_type({j}) = 'ARRAY' THEN json_extract({j}, '$[0]') ELSE {j} END"


#: root(process_number, j) and node(process_number, kind, node_id, parent_id, body, page) of every readable record.
NODES = f"""WITH RECURSIVE r0 AS (SELECT process_number, TRY_CAST(raw_json AS JSON) AS j FROM raw_processes WHERE trim(raw_json) <> ''), r1 AS (SELECT process_number, {_open('j')} AS j FROM r0), r2 AS (SELECT process_number, {_open('j')} AS j FROM r1), r3 AS (SELECT process_number, {_open('j')} AS j FROM r2),
e1 AS (SELECT process_number, j, {_get('j', 'analysis')} AS a FROM r3), e2 AS (SELECT process_number, j, {_open('a')} AS a FROM e1), root AS (SELECT process_number, CASE WHEN a IS NULL OR json_type(a) = 'NULL' THEN j ELSE a END AS j FROM e2),
s1 AS (SELECT process_number, {_get('j', 'pages')} AS p, {_get('j', 'signatures')} AS s, {_get('j', 'bookmarks')} AS b FROM root), s2 AS (SELECT process_number, {_open('p')} AS p, {_open('s')} AS s, {_open('b')} AS b FROM s1), s3 AS (SELECT process_number, p, s, {_open('b')} AS b FROM s2),
pg AS (SELECT process_number, unnest({_many('p')}) AS p, generate_subscripts({_many('p')}, 1) - 1 AS i FROM s3), pq AS (SELECT process_number, i, p FROM pg WHERE json_type(p) = 'OBJECT'),
c1 AS (SELECT process_number, i, {_get('p', 'textinfo')} AS t, {_get('p', 'resources')} AS r, {_get('p', 'annotations')} AS a FROM pq), c2 AS (SELECT process_number, i, {_open('t')} AS t, {_open('r')} AS r, a FROM c1), c3 AS (SELECT process_number, i, {_first('t')} AS t, {_first('r')} AS r, a FROM c2),
c4 AS (SELECT process_number, i, unnest(['font', 'image', 'form_field', 'annotation']) AS kind, unnest([{_get('t', 'fonts')}, {_get('r', 'images')}, {_get('r', 'formfields')}, a]) AS x FROM c3), c5 AS (SELECT process_number, i, kind, {_open('x')} AS x FROM c4),
c6 AS (SELECT process_number, i, kind, unnest({_many('x')}) AS x, generate_subscripts({_many('x')}, 1) - 1 AS k FROM c5),
sg AS (SELECT process_number, unnest({_many('s')}) AS x, generate_subscripts({_many('s')}, 1) - 1 AS k FROM s3),
b0 AS (SELECT process_number, {_get('b', 'rootitems')} AS x FROM s3), b1 AS (SELECT process_number, {_open('x')} AS x FROM b0), b2 AS (SELECT process_number, unnest({_many('x')}) AS x, generate_subscripts({_many('x')}, 1) - 1 AS k FROM b1),
bm AS (SELECT process_number, CAST(k AS VARCHAR) AS node_id, '' AS parent_id, x FROM b2 WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT process_number, parent_id || '.' || k, parent_id, x FROM (SELECT process_number, node_id AS parent_id, unnest({_many('c')}) AS x, generate_subscripts({_many('c')}, 1) - 1 AS k FROM (SELECT process_number, node_id, {_open('c')} AS c FROM (SELECT process_number, node_id, {_get('x', 'children')} AS c FROM bm))) WHERE json_type(x) = 'OBJECT'),
node AS (SELECT process_number, 'page' AS kind, CAST(i AS VARCHAR) AS node_id, '' AS parent_id, p AS body, i + 1 AS page FROM pq
  UNION ALL SELECT process_number, kind, i || '.' || k, CAST(i AS VARCHAR), x, i + 1 FROM c6 WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT process_number, 'signature', CAST(k AS VARCHAR), '', x, NULL FROM sg WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT process_number, 'bookmark', node_id, parent_id, x, NULL FROM bm)
"""


@plan(NODES + "SELECT process_number, kind, node_id, parent_id FROM node")
def p3_found(spark, sf_dir):
    flat = flatten(table(spark, sf_dir, "raw_processes"))
    return flat.selectExpr("key AS process_number", "kind", "node_id", "parent_id")


def _nodes(spark, sf_dir):
    return flatten(table(spark, sf_dir, "raw_processes"))


def _v(key: str, j: str = "body") -> str:
    return f"({_get(j, key)} ->> '$')"


def _ann(where: str, what: str) -> str:
    return NODES + f", a AS (SELECT process_number AS key, node_id, page, {_v('type')} AS type, {_v('author')} AS author, {_v('contents')} AS contents, {_v('modificationdate')} AS modified FROM node WHERE kind = 'annotation'), f AS (SELECT * FROM a WHERE {where}) {what}"


def _plain(c: str) -> str:
    return f"strip_accents(lower({c}))"


@plan(_ann("lower(type) IN ('/highlight', '/text') AND page BETWEEN 1 AND 5 AND modified >= '2020-01-01' AND modified <= '2024-12-31'", "SELECT key, node_id, page, type, author, modified FROM f"))
def nodes_annotations(spark, sf_dir):
    return sift.annotations(_nodes(spark, sf_dir), types=["/Highlight", "/Text"], pages=(1, 5), modified=("2020-01-01", "2024-12-31")).drop("contents")


@plan(_ann(f"(contains({_plain('contents')}, 'rever') OR contains({_plain('contents')}, 'conferi')) AND NOT coalesce(contains({_plain('contents')}, 'rubrica'), false)", "SELECT key, node_id, contents FROM f"))
def nodes_annotations_words(spark, sf_dir):
    return sift.annotations(_nodes(spark, sf_dir), words="rever|conferi", not_words="rubrica").select("key", "node_id", "contents")


@plan(_ann(f"contains({_plain('author')}, 'a') AND regexp_matches(contents, '(?i)[a-z]{{3,}}')", "SELECT key, node_id, author FROM f"))
def nodes_annotations_author(spark, sf_dir):
    return sift.annotations(_nodes(spark, sf_dir), authors="a", regex="[a-z]{3,}").select("key", "node_id", "author")


@plan(_ann("true", "SELECT key, sum(n)::BIGINT AS n, string_agg(t || '=' || n, ' ' ORDER BY t) AS types, min(a) AS first, max(b) AS last FROM (SELECT key, coalesce(type, '') AS t, count(*) AS n, min(modified) AS a, max(modified) AS b FROM f GROUP BY ALL) GROUP BY key"))
def nodes_annotation_types(spark, sf_dir):
    return sift.by_type(sift.annotations(_nodes(spark, sf_dir)))


@plan(_ann("modified IS NOT NULL", "SELECT key, page, count(*) AS changes, count(DISTINCT author) AS hands, max(modified) AS latest FROM f GROUP BY key, page"))
def nodes_changes_by_page(spark, sf_dir):
    return sift.changed(sift.annotations(_nodes(spark, sf_dir)))


MARKS = NODES + f", m AS (SELECT process_number AS key, node_id, parent_id, len(string_split(node_id, '.')) - 1 AS depth, {_v('title')} AS title FROM node WHERE kind = 'bookmark')"


@plan(MARKS + f" SELECT key, node_id, parent_id, CAST(depth AS INT) AS depth, title FROM m WHERE (contains({_plain('title')}, 'autor') OR contains({_plain('title')}, 'fls')) AND depth BETWEEN 1 AND 3")
def nodes_bookmarks(spark, sf_dir):
    return sift.bookmarks(_nodes(spark, sf_dir), words="autor|fls", depth=(1, 3))


@plan(MARKS + r" SELECT key, node_id, title FROM m WHERE regexp_matches(title, '(?i)fls\. \d{2}$') AND NOT EXISTS (SELECT 1 FROM m c WHERE c.key = m.key AND c.parent_id = m.node_id)")
def nodes_bookmark_leaves(spark, sf_dir):
    return sift.bookmarks(_nodes(spark, sf_dir), regex=r"fls\. \d{2}$", leaf=True).select("key", "node_id", "title")


@plan(MARKS + " SELECT key, node_id FROM m WHERE EXISTS (SELECT 1 FROM m c WHERE c.key = m.key AND c.parent_id = m.node_id)")
def nodes_bookmark_branches(spark, sf_dir):
    return sift.bookmarks(_nodes(spark, sf_dir), leaf=False).select("key", "node_id")


def _fonts(where: str, having: str) -> str:
    sizes = "string_agg(DISTINCT CAST(size AS VARCHAR), ',' ORDER BY CAST(size AS VARCHAR))"
    return NODES + f""", f AS (SELECT process_number AS key, page, {_v('name')} AS font, TRY_CAST({_v('size')} AS DOUBLE) AS size, coalesce(TRY_CAST({_v('isbold')} AS BOOLEAN), false) AS bold FROM node WHERE kind = 'font'), g AS (SELECT * FROM f WHERE {where})
SELECT key, font, count(*) AS uses, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, array_to_string(list_sort(list_distinct(list(size) FILTER (size IS NOT NULL))), ',') AS sizes, bool_or(bold) AS bold FROM g GROUP BY key, font HAVING count(*) >= {having}"""


@plan(_fonts("true", "2"))
def nodes_fonts(spark, sf_dir):
    return sift.fonts(_nodes(spark, sf_dir), uses=2)


@plan(_fonts("bold AND size BETWEEN 10 AND 14", "1"))
def nodes_fonts_bold(spark, sf_dir):
    return sift.fonts(_nodes(spark, sf_dir), bold=True, size=(10, 14))


IMAGES = NODES + f", i AS (SELECT process_number AS key, node_id, page, {_v('name')} AS name, TRY_CAST({_v('width')} AS BIGINT) AS width, TRY_CAST({_v('height')} AS BIGINT) AS height, {_v('colorspace')} AS colours FROM node WHERE kind = 'image'), z AS (SELECT *, width * height AS area FROM i)"


@plan(IMAGES + " SELECT key, node_id, page, name, width, height, colours, area FROM z WHERE width BETWEEN 300 AND 1500 AND height BETWEEN 200 AND 2000 AND contains(lower(colours), 'rgb')")
def nodes_images(spark, sf_dir):
    return sift.images(_nodes(spark, sf_dir), width=(300, 1500), height=(200, 2000), colours="RGB")


@plan(IMAGES + " SELECT key, count(*) AS images, count(*) FILTER (area > 250000) AS tracked, count(*) FILTER (area > 1000000) AS large, count(*) FILTER (width > 500 AND height > 700) AS beyond, round(avg(area) FILTER (area > 250000), 4) AS mean_area FROM z GROUP BY key")
def nodes_large_images(spark, sf_dir):
    return sift.large_images(sift.images(_nodes(spark, sf_dir)))


@plan(NODES + f" SELECT process_number AS key, node_id, page, {_v('name')} AS name, {_v('type')} AS type, {_v('value')} AS value FROM node WHERE kind = 'form_field' AND {_v('type')} = '/Tx' AND coalesce(trim({_v('value')}) <> '', false)")
def nodes_form_fields(spark, sf_dir):
    return sift.form_fields(_nodes(spark, sf_dir), kinds=["/Tx"], value=True)


@plan(NODES + f" SELECT process_number AS key, node_id, {_v('signername')} AS signer, TRY_CAST({_v('isvalid')} AS BOOLEAN) AS valid, {_v('signingtime')} AS signed FROM node WHERE kind = 'signature' AND TRY_CAST({_v('isvalid')} AS BOOLEAN) AND {_v('signingtime')} >= '2019'")
def nodes_signatures(spark, sf_dir):
    return sift.signatures(_nodes(spark, sf_dir), valid=True, signed=("2019", None))


@plan(NODES + f", m AS (SELECT process_number AS key, {_get('j', 'metadata')} AS m FROM root), n AS (SELECT key, {_open('m')} AS m FROM m) SELECT key, {_v('title', 'm')} AS title, {_v('producer', 'm')} AS producer, TRY_CAST({_v('istagged', 'm')} AS BOOLEAN) AS tagged FROM n WHERE contains({_plain(_v('producer', 'm'))}, 'impressora') AND contains({_plain(_v('title', 'm'))}, 'fls') AND TRY_CAST({_v('istagged', 'm')} AS BOOLEAN) = false")
def nodes_metadata(spark, sf_dir):
    return sift.metadata(sections(table(spark, sf_dir, "raw_processes")), tagged=False, title="fls", producer="impressora")


@plan(NODES + f", w AS (SELECT process_number AS key, [{', '.join(_get('j', k) for k in ('metadata', 'security', 'pages', 'bookmarks', 'signatures'))}] AS ws FROM root WHERE json_type(j) = 'OBJECT') SELECT key, CAST(len(list_filter(ws, lambda x: x IS NOT NULL AND json_type(x) <> 'NULL')) AS BIGINT) AS sections FROM w")
def nodes_structure(spark, sf_dir):
    return sift.structure(sections(table(spark, sf_dir, "raw_processes")), ["metadata", "security", "pages", "bookmarks", "signatures"])


@plan("SELECT p_partkey AS number, p_type AS type, p_size * 100 AS size FROM part WHERE starts_with(lower(p_type), 'e') AND p_size * 100 BETWEEN 500 AND 3000 AND list_contains(string_split(p_name, ' '), 'KEYWORD')")
def objects_filter(spark, sf_dir):
    dump = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_type").alias("type"), (F.col("p_size") * 100).alias("size"), F.split("p_name", " ").alias("keys"))
    return sift.objects(dump, kind="E*", size=(500, 3000), has_key="KEYWORD", stream=True).drop("keys")


QUERIES, SQL = plan.queries, plan.sql
