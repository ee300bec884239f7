"""URL filter: allow and block rules, and redirect equivalence that carries block decisions to aliases.

Native. Pages, redirects and canonical links form a graph of URLs. Aliases of one resource are its connected components;
a URL that no rule fits is blocked if its component holds a URL that a rule blocks and none that a rule allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions.pages import unescape
from newslake.llm.common import cut, text_of
from newslake.llm.graph import components

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_ATTRIBUTE = r"""(?is)\b{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*>"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*>"""


def host_of(url: Column) -> Column:
    """Lower-cased host; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, allow before block at equal length; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; ``..`` at the root stays at the root."""
    parts = F.split(path, "/")
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == ".", out).when(
        p == "..", F.slice(out, 1, F.greatest(F.lit(1), F.size(out) - 1))).otherwise(F.concat(out, F.array(p))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(stack, "/"), end)).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL as a node: scheme and fragment dropped, host lower-cased, dot segments resolved; null without ``://``."""
    path, query = without_dots(path_of(url)), F.regexp_extract(_rest(url), r"^[^?#]*([^#]*)", 1)
    tail = F.concat(path, query)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(tail == "", F.lit("/")).otherwise(tail)))


def with_absolute(links: DataFrame) -> DataFrame:
    """Rows ``url``, ``link`` plus ``target``, the absolute link; null for an empty link or another scheme such as ``mailto:``.

    Parts of the base come first, as columns of their own, so that no expression repeats them.
    """
    based = links.withColumn("bare", F.trim("link")).withColumns({
        "scheme": F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), "host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    based = based.withColumns({
        "root": F.concat("scheme", F.lit("://"), "host"), "folder": F.concat(F.lit("/"), F.regexp_extract("path", r"^/(.*/)?", 1))})
    bare = F.col("bare")
    return based.withColumn("target", F.when(bare == "", F.lit(None).cast("string"))
                            .when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), bare)
                            .when(F.startswith(bare, F.lit("//")), F.concat("scheme", F.lit(":"), bare))
                            .when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
                            .when(F.startswith(bare, F.lit("/")), F.concat("root", bare))
                            .when(bare.rlike("^[#?]"), F.concat("root", "path", bare))
                            .otherwise(F.concat("root", "folder", bare)))


def page_links(pages: DataFrame) -> DataFrame:
    """Equivalence edges ``a``, ``b`` that the pages state: canonical links and refresh redirects.

    All tags of a page count; character entities of their values are resolved. Null urls and html give no edge.
    """
    def attribute(tag: Column, name: str) -> Column:
        return unescape(F.concat(*[F.regexp_extract(tag, _ATTRIBUTE.format(name), k) for k in (1, 2, 3)]))

    html = text_of("html")
    canonical = F.transform(F.regexp_extract_all(html, F.lit(_CANONICAL), 0), lambda tag: attribute(tag, "href"))
    refresh = F.transform(
        F.regexp_extract_all(html, F.lit(_REFRESH), 0),
        lambda tag: F.regexp_extract(attribute(tag, "content"), r"""(?i)\burl\s*=\s*["']?([^"']*)""", 1))
    found = pages.select("url", F.explode(F.concat(canonical, refresh)).alias("link"))
    found = cut(with_absolute(found).select("url", "target"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and ``component`` (the smallest alias, null for a URL without links).

    ``redirects`` adds edges (``from_url``, ``to_url``). A null url or one without ``://`` has empty host and path, fits no
    rule and is allowed. Repeated rows are judged alike, each with a row of its own; an empty table gives an empty one;
    other columns are not read. A URL held by very many pages is one node, and the last join may split its rows.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).dropna())
    labels = cut(components(edges))
    ruled = rule_of(F.regexp_extract("node", "^[^/?#]*", 0), F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1), rules)
    blocked = labels.withColumn("own", ruled["verdict"]).groupBy("component").agg(
        (F.bool_or(F.col("own").eqNullSafe("block")) & ~F.bool_or(F.col("own").eqNullSafe("allow"))).alias("by_alias"))
    known = cut(labels.join(cut(blocked), "component"))
    urls = pages.select("page_id", "url").withColumns({
        "host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit("")),
        "node": node_of(F.col("url"))})
    own = urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("by_alias"), F.lit("block")).otherwise(F.lit("allow")))
    return own.join(known, "node", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "component")


def sql() -> str:
    """The rules in DuckDB's SQL, for pages without links; tests hold the links against a brute-force version."""
    host = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH u AS (SELECT page_id, row_number() OVER () AS rid,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, rid, coalesce({host}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rule_host, prefix) AS (VALUES {values}),
m AS (SELECT rid, arg_max(rule_host || prefix, (length(rule_host || prefix), verdict = 'allow')) AS rule,
    arg_max(verdict, (length(rule_host || prefix), verdict = 'allow')) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""
