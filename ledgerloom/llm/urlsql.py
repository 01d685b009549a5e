"""DuckDB's SQL for the URL filter: rules, links of pages, and decisions that reach over links."""

from __future__ import annotations

from ledgerloom.llm import urlfilter

_TAG = r"""(?is)<{0}\b(?:"[^"]*"|''[^'']*''|[^''">])*>"""
_ATTRIBUTE = r"""regexp_extract(t, '(?is)[\s"''/]{0}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _address(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END END"


def _value(name: str) -> str:
    """An attribute of the tag ``t``: without quotes, its character references read."""
    own = _ATTRIBUTE.format(name)
    out = f"""CASE WHEN {own}[1] IN ('"', '''') THEN {own}[2:-2] ELSE {own} END"""
    for shown, meant in urlfilter.REFERENCES:
        quoted = meant.replace("'", "''")
        out = f"regexp_replace({out}, '(?i){shown}', '{quoted}', 'g')"
    return out


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    """(page_id, host, path, rule, verdict) of the table ``pages`` under ``rules`` (verdict, host, path)."""
    values = ", ".join(f"('{v}', '{h}', '{s}')" for v, h, s in rules)
    return rf"""
        WITH RECURSIVE rules(v, h, s) AS (VALUES {values}),
             pg AS (SELECT page_id, url, {_host("url")} AS host, {_path("url")} AS path, {_address("url")} AS address, html FROM pages),
             hs AS (SELECT url, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g') AS h FROM pg WHERE regexp_matches(html, '(?i)canonical|http-equiv') AND url LIKE '%://%'),
             tg AS (SELECT url, 'link' AS kind, unnest(regexp_extract_all(h, '{_TAG.format("link")}')) AS t FROM hs UNION ALL SELECT url, 'meta', unnest(regexp_extract_all(h, '{_TAG.format("meta")}')) FROM hs),
             v0 AS (SELECT url, kind, {_value("rel")} AS rel, {_value("href")} AS href, {_value("http-equiv")} AS equiv, {_value("content")} AS content FROM tg),
             v1 AS (SELECT url, href AS t FROM v0 WHERE kind = 'link' AND regexp_matches(rel, '(?i)(^|\s)canonical(\s|$)')
                    UNION ALL SELECT url, regexp_replace(regexp_extract(content, '(?is)^[\s\d.]*[;,]?\s*url\s*=\s*(.*)$', 1), '^["'']|["'']$', '', 'g') FROM v0 WHERE kind = 'meta' AND lower(equiv) = 'refresh'),
             v2 AS (SELECT url, t, coalesce(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), ''), 'http') AS scheme, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS host, coalesce(nullif({_path("url")}, ''), '/') AS path,
                    regexp_extract(t, '(?s)^([^?#]*)', 1) AS bare, regexp_extract(t, '(?s)^[^?#]*(\?[^#]*)', 1) AS query FROM v1),
             v3 AS (SELECT *, string_split(CASE WHEN starts_with(t, '/') THEN bare ELSE regexp_replace(path, '[^/]*$', '') || bare END, '/')[2:] AS steps FROM v2),
             v4 AS (SELECT *, list_reduce(list_transform(steps, lambda x: [x]), lambda o, x: CASE WHEN x[1] = '..' THEN o[1:greatest(len(o) - 1, 0)] WHEN x[1] = '.' THEN o ELSE list_concat(o, x) END, []::VARCHAR[]) AS taken FROM v3),
             v5 AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^(#|$)') OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '//') THEN scheme || ':' || t
                        WHEN starts_with(t, '?') THEN scheme || '://' || host || path || query
                        ELSE scheme || '://' || host || '/' || array_to_string(CASE WHEN steps[-1] IN ('.', '..') THEN list_append(taken, '') ELSE taken END, '/') || query END AS target FROM v4),
             ed AS (SELECT DISTINCT {_address("url")} AS a, {_address("target")} AS b FROM v5),
             e2 AS (SELECT a, b FROM ed WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b UNION SELECT b, a FROM ed WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
             reach(a, b) AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM reach r JOIN e2 ON e2.a = r.b),
             ad AS (SELECT a AS address, {_host("'http://' || a")} AS host, {_path("'http://' || a")} AS path FROM (SELECT DISTINCT a FROM e2)),
             bad AS (SELECT address FROM (SELECT address, v, row_number() OVER (PARTITION BY address ORDER BY length(h || s) DESC, v) AS k FROM ad JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) WHERE k = 1 AND v = 'block'),
             hit AS (SELECT DISTINCT r.a AS address FROM reach r JOIN bad ON bad.address = r.b UNION SELECT address FROM bad),
             m AS (SELECT page_id, url, h || s AS rule, v, row_number() OVER (PARTITION BY page_id, url ORDER BY length(h || s) DESC, v) AS k FROM pg JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s))
        SELECT pg.page_id, host, path, rule, coalesce(v, CASE WHEN hit.address IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM pg LEFT JOIN m ON m.page_id = pg.page_id AND m.url = pg.url AND k = 1 LEFT JOIN hit ON hit.address = pg.address"""
