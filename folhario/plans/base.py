"""Registration of named queries with the SQL each is checked against."""

from __future__ import annotations

#: The page corpus as DuckDB sees it; the counterpart of `sources.corpus.pages`.
PAGES = """WITH p AS (
  SELECT page_id, cache_id AS doc, page_number AS page, coalesce(text, '') AS text, header, footer, page_type,
    CASE WHEN fonts IS NULL THEN [] ELSE string_split(fonts, '|') END AS fonts, coalesce(image_count, 0) AS images,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \\n\\t]'), lambda x: x <> '')) AS BIGINT) AS words,
    CAST(length(coalesce(text, '')) AS BIGINT) AS chars
  FROM pages)
"""


class Plans:
    """Queries and SQL of one module."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, pages: bool = False):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = (PAGES if pages else "") + sql
            return f

        return put
