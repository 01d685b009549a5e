"""URL filters: host and path rules, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import connected_components, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Tags, with quoted values that may hold ">"; an attribute's value, quoted or not; where a refresh leads.
_TAG = r"""(?is)<{0}\b(?:"[^"]*"|'[^']*'|[^'">])*>"""
_VALUE = r"""(?is)[\s"'/]{0}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_REFRESH = r"(?is)^[\s\d.]*[;,]?\s*url\s*=\s*(.*)$"
#: Character references that are read in addresses.
REFERENCES = [("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")]


def host_of(url: Column) -> Column:
    """Between the first :// and /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address_of(url: Column) -> Column:
    """Identity of a page: host and what follows it, without scheme and fragment; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _value(tag: Column, name: str) -> Column:
    """An attribute's value without quotes and with its character references read; empty without the attribute."""
    bare = F.regexp_replace(F.regexp_extract(tag, _VALUE.format(name), 1), r"""(?s)^(["'])(.*)\1$""", "$2")
    for shown, meant in REFERENCES:
        bare = F.regexp_replace(bare, f"(?i){shown}", meant)
    return F.regexp_replace(bare, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken."""
    steps = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    start = F.array().cast("array<string>")
    taken = F.aggregate(steps, start, lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.array_append(out, x)))
    closed = F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(taken, F.lit(""))).otherwise(taken)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def resolved(target: Column, base: Column) -> Column:
    """Absolute address of a reference found at ``base``: with a scheme of its own, of the base's (``//host``), a path from the root, a query, or a path from the base's folder. Null for other schemes (``mailto:``), fragments and nothing."""
    scheme, host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    bare, query = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    folder = F.regexp_replace(path, r"[^/]*$", "")
    top = F.concat(F.when(scheme == "", "http").otherwise(scheme), F.lit("://"), host)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^(#|$)") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(F.when(scheme == "", "http").otherwise(scheme), F.lit(":"), target))
        .when(target.startswith("?"), F.concat(top, path, query))
        .when(target.startswith("/"), F.concat(top, _without_dots(bare), query))
        .otherwise(F.concat(top, _without_dots(F.concat(folder, bare)), query))
    )


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Redirect and canonical-link edges (source, target: absolute urls) of pages, one row for each tag.

    Read are all ``<link rel="... canonical ..." href>`` and ``<meta http-equiv="refresh" content="n; url=...">`` tags
    outside comments; targets are resolved against the page's url (a ``<base>`` tag counts for nothing) and a few common
    character references in them are read. Dropped are tags without a target, fragments, other schemes, and pages whose
    url or html is null or empty. Repeated tags repeat their row; other columns are ignored.
    """
    own = pages.select(F.col(url_col).cast("string").alias("source"), F.col(html_col).cast("string").alias("h")).where(F.col("h").rlike("(?i)canonical|http-equiv"))
    own = own.select("source", F.regexp_replace("h", r"(?s)<!--.*?(?:-->|\z)", "").alias("h"))
    links = F.filter(F.regexp_extract_all("h", F.lit(_TAG.format("link")), F.lit(0)), lambda t: _value(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"))
    refreshes = F.filter(F.regexp_extract_all("h", F.lit(_TAG.format("meta")), F.lit(0)), lambda t: F.lower(_value(t, "http-equiv")) == "refresh")
    found = F.concat(F.transform(links, lambda t: _value(t, "href")), F.transform(refreshes, lambda t: F.regexp_replace(F.regexp_extract(_value(t, "content"), _REFRESH, 1), r"""^["']|["']$""", "")))
    each = own.select("source", F.explode(found).alias("target"))
    return each.select("source", resolved(F.col("target"), F.col("source")).alias("target")).where("target IS NOT NULL AND source LIKE '%://%'")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, component) of every page.

    ``rules`` has verdict (allow or block), host and path: a rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest (host and path) wins, of equal ones allow. A page that no rule fits is blocked
    if a page or address that it reaches over ``links`` (source, target urls; either way) is blocked by a rule, and
    allowed otherwise; an allow rule of its own always stands. Null urls have empty hosts and are allowed. Ids may be
    null or repeat; null or damaged links count for nothing. Extra columns are ignored.
    """
    url = F.col(url_col).cast("string")
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    # a host's suffixes meet the rules' hosts by equality
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))

    def ruled(at: DataFrame, keys: list[str]) -> DataFrame:
        asked = at.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(known, "rule_host").where(F.expr("startswith(path, rule_path)"))
        name = F.concat("rule_host", "rule_path")
        best = asked.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("l"), (F.col("rule_verdict") == "allow").alias("a"), name.alias("rule"), "rule_verdict")).alias("m"))
        return at.join(best.select("host", "path", "m.rule", "m.rule_verdict"), ["host", "path"], "left").select(*keys, "host", "path", "rule", "rule_verdict")

    judged = ruled(own, ["id", "address"])
    edges = written(links.select(address_of(F.col("source")).alias("a"), address_of(F.col("target")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    if edges.isEmpty():
        blocked = judged.withColumns({"component": F.lit(None).cast("string"), "blocked": F.lit(False)})
    else:
        component = written(connected_components(edges), "aliases")
        from_address = component.select("component", F.concat(F.lit("http://"), "node").alias("u")).select("component", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
        bad = ruled(from_address, ["component"]).groupBy("component").agg(F.max(F.col("rule_verdict") == "block").alias("blocked"))
        blocked = judged.join(component.join(bad, "component"), F.col("address") == F.col("node"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow"))
    return blocked.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "component")
