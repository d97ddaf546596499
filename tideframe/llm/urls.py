"""URL filters whose decisions spread over redirect and canonical-link aliases."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import col, components, lower_ascii, query, saved, table, unused

#: (verdict, host and path) of the registered query.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)

_REST = r"(?s)^.*?://(.*)$"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return lower_ascii(F.regexp_extract(F.coalesce(F.regexp_extract(url, _REST, 1), F.lit("")), r"(?s)^([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.regexp_extract(url, _REST, 1), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null.

    A rule ``host/path`` fits the host and its subdomains if the path starts with the rule's.
    Of equally long rules the first in the alphabet counts. The rules are literals of the
    plan, so they are a list that a person keeps, not a table.
    """
    whole = F.concat(F.lit("."), host)
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = whole.endswith(f".{name}") & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """The url without scheme and fragment; the default ports and an empty path are written out."""
    name = F.regexp_replace(host(url), r":(80|443)$", "")
    rest = F.regexp_extract(F.regexp_extract(url, _REST, 1), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(name != "", F.concat(name, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


_ATTRIBUTE = r"""\s*=\s*["']?([^"'\s>]+)"""


def _tag(html: Column, tag: str, marks: str) -> Column:
    """All tags of a kind with an attribute like ``marks``."""
    return F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(rf"(?is)\s{marks}"))


def declared(html: Column) -> Column:
    """What a page names as itself, as written: targets of canonical links and meta refreshes."""
    links = F.transform(_tag(html, "link", r"""rel\s*=\s*["']?canonical\b"""), lambda t: F.regexp_extract(t, r"(?is)\shref" + _ATTRIBUTE, 1))
    moves = F.transform(_tag(html, "meta", r"""http-equiv\s*=\s*["']?refresh\b"""), lambda t: F.regexp_extract(t, r"(?is)url\s*=\s*['\"]?([^\"'\s>]+)", 1))
    return F.filter(F.array_union(links, moves), lambda u: u != "")


def base(html: Column) -> Column:
    """What the first ``<base>`` of a page with an address names, as written; null without."""
    return F.regexp_extract(F.try_element_at(_tag(html, "base", r"href\s*="), F.lit(1)), r"(?is)\shref" + _ATTRIBUTE, 1)


#: A character reference as attributes have them: a name without its semicolon counts only before other signs.
_ENTITY = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=])))")


def plain_attribute(value: str) -> str:
    """An attribute's value with its character references replaced."""
    return _ENTITY.sub(lambda m: unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0]), value)


def _without_dots(path: str) -> str:
    """A path without ``.`` and ``..`` steps."""
    out = []
    steps = path.split("/")
    for n, step in enumerate(steps):
        last = n == len(steps) - 1
        if step == ".." and len(out) > 1:
            out.pop()
        if step not in (".", ".."):
            out.append(step)
        elif last:
            out.append("")
    return "/".join(out)


def resolve(target: str | None, url: str | None) -> str | None:
    """``target``, already unescaped, as an absolute url seen from ``url``; null if it names no page with a host."""
    target, (_, found, rest) = (target or "").strip(), (url or "").partition("://")
    if re.match(r"[^/?#]*://", target):
        return target
    if target.startswith("//"):
        return f"x:{target}"
    name, path, query = re.match(r"(?s)([^/?#]*)([^?#]*)([^#]*)", rest).groups()
    if not target or not found or not name or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        return None
    if target[0] == "#":
        return f"x://{name}{path}{query}"
    if target[0] == "?":
        return f"x://{name}{path}{target}"
    to, more = re.match(r"(?s)([^?#]*)(.*)", target).groups()
    if to[0] != "/":
        to = (path.rpartition("/")[0] or "") + "/" + to
    return f"x://{name}{_without_dots(to)}{more}"


def absolute(target: Column, base: Column, url: Column) -> Column:
    """A target as written in a page, as an absolute url: unescaped, and seen from the page's base or url."""

    @F.arrow_udf("string")
    def whole(targets: pa.Array, bases: pa.Array, urls: pa.Array) -> pa.Array:
        out = []
        for t, b, u in zip(targets.to_pylist(), bases.to_pylist(), urls.to_pylist()):
            at = resolve(plain_attribute(b), u) if b else None
            out.append(resolve(plain_attribute(t).strip("'\" \t\r\n"), at or u))
        return pa.array(out, pa.string())

    return whole(target, base, url)


def spread(edges: DataFrame, judged: DataFrame) -> DataFrame:
    """``(url, verdict)`` of every url in a component of ``edges(a, b)`` that a rule decides.

    ``judged(url, verdict)``: what the rules say of urls. An explicit allow anywhere in the
    component goes before a block; the minimum per component is combined before the shuffle.
    """
    found = components(edges)
    named = found.join(judged.where(F.col("verdict").isNotNull()), found.node == judged.url)
    decided = named.groupBy("component").agg(F.min("verdict").alias("verdict"))
    return found.join(decided, "component").select(F.col("node").alias("url"), "verdict")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``.

    The longest rule that fits a page's url decides it. A page without a rule takes the
    decision of its aliases: pages and urls that canonical links, meta refreshes, or equal
    urls up to scheme and fragment tie together, directly or over others. Targets are unescaped
    and seen from the page's base or url. Among aliases an allow rule goes before a block
    rule; without any, the page is allowed. Rules also judge urls that are only linked to, and
    every url in its canonical form. Null and malformed urls have an empty host and path, no
    rule and no alias, and are allowed. Null html names nothing. Repeated rows stay repeated.
    """
    a, body = col(url), F.coalesce(col(html), F.lit(""))
    seen = pages.select(col(id).alias("id"), host(a).alias("host"), path(a).alias("path"), canonical(a).alias("node"), declared(body).alias("named"), a.alias("_url"), body.alias("_html"))
    names = F.size("named") > 0  # few pages
    seen = saved(seen.select("id", "host", "path", "node", "named", F.when(names, F.col("_url")).alias("url"), F.when(names, base(F.col("_html"))).alias("base")))
    found = matched(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("found", found)
    links = seen.where("node IS NOT NULL").select(F.col("node").alias("a"), "url", "base", F.explode("named").alias("link"))
    links = links.select("a", absolute(F.col("link"), F.col("base"), F.col("url")).alias("link"))
    edges = links.select("a", canonical(F.col("link")).alias("b")).where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = saved(edges)

    def ruled(node: str) -> Column:
        full = F.concat(F.lit("x://"), F.col(node))
        return matched(host(full), path(full), rules)["verdict"]

    # Only a page whose host or path is written otherwise in the canonical form can have another rule than that form.
    other = seen.where((F.col("path") == "") | (F.col("host") != host(F.concat(F.lit("x://"), F.col("node")))))
    own = saved(other.select(F.col("node").alias("url"), F.col("found.verdict").alias("verdict")).where("url IS NOT NULL AND verdict IS NOT NULL").distinct())
    seen = seen.withColumn("self", ruled("node"))
    urls = edges.select(F.col("a").alias("url")).unionByName(edges.select(F.col("b").alias("url"))).distinct()
    if not edges.isEmpty():
        spreading = spread(edges, urls.select("url", ruled("url").alias("verdict")).unionByName(own)).unionByName(own)
    elif not own.isEmpty():
        spreading = own
    else:  # no url has another name than itself
        spreading = None
    if spreading is None:
        alias = seen.withColumn("alias", F.col("self"))
    else:
        spreading = spreading.groupBy(F.col("url").alias("node")).agg(F.min("verdict").alias("spread"))
        alias = seen.join(spreading, "node", "left").withColumn("alias", F.least("spread", "self"))
    verdict = F.coalesce(F.col("found.verdict"), F.col("alias"), F.lit("allow"))
    return alias.select("id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def allowed(pages: DataFrame, rules: Sequence[tuple[str, str]], id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The rows of ``pages`` whose id has no blocked row."""
    key = unused(pages, "_key")[0]
    blocked = judge(pages, rules, id, url, html).where("verdict = 'block'").select(F.col("id").alias(key)).distinct()
    return pages.join(blocked, col(id).eqNullSafe(col(key)), "left_anti")


def _sql(rules: Sequence[tuple[str, str]]) -> str:
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)

    def parts(u: str) -> str:
        return (
            f"CASE WHEN contains({u}, '://') THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"
        )

    az = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    name = az.format("regexp_extract(rest, '^([^/?#]*)', 1, 's')")
    tail = "regexp_extract(rest, '^[^/?#]*([^#]*)', 1, 's')"
    node = f"CASE WHEN {name} <> '' THEN regexp_replace({name}, ':(80|443)$', '') || CASE WHEN starts_with({tail}, '/') THEN '' ELSE '/' END || {tail} END"
    return f"""
WITH RECURSIVE rules(verdict, rule, h, p) AS (VALUES {values}),
a AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html, {parts("coalesce(url, '')")} AS rest FROM pages),
n AS (SELECT rid, page_id, html, {name} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path, {node} AS node FROM a),
tags AS (
  SELECT node, unnest(regexp_extract_all(html, '<link\\b[^>]*>', 0, 'is')) AS t, 'link' AS kind FROM n WHERE node IS NOT NULL
  UNION ALL SELECT node, unnest(regexp_extract_all(html, '<meta\\b[^>]*>', 0, 'is')), 'meta' FROM n WHERE node IS NOT NULL),
named AS (
  SELECT node, CASE kind
    WHEN 'link' THEN CASE WHEN regexp_matches(t, '\\srel\\s*=\\s*["'']?canonical\\b', 'is') THEN regexp_extract(t, '\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'is') END
    ELSE CASE WHEN regexp_matches(t, '\\shttp-equiv\\s*=\\s*["'']?refresh\\b', 'is') THEN regexp_extract(t, 'url\\s*=\\s*[''"]?([^"''\\s>]+)', 1, 'is') END END AS u FROM tags),
target AS (SELECT node, {parts("u")} AS rest FROM named WHERE contains(u, '://')),
e AS (SELECT node AS x, b AS y FROM (SELECT node, {node} AS b FROM target) WHERE b IS NOT NULL),
sym AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, x FROM sym UNION SELECT reach.x, sym.y FROM reach JOIN sym ON reach.y = sym.x),
parts AS (SELECT DISTINCT y, regexp_extract(y, '^([^/?#]*)', 1, 's') AS host, regexp_extract(y, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM reach),
ruled AS (SELECT y, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN rules ON ends_with('.' || host, '.' || h) AND starts_with(path, p) GROUP BY y),
alias AS (SELECT x, min(verdict) AS verdict FROM reach JOIN ruled USING (y) GROUP BY x),
own AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM n JOIN rules ON ends_with('.' || host, '.' || h) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, own.rule, coalesce(own.verdict, alias.verdict, 'allow') AS verdict
FROM n LEFT JOIN own USING (rid) LEFT JOIN alias ON alias.x = n.node
"""


ORACLE = _sql(RULES)


@query("op9_urls", ORACLE)
def op9_urls(spark, sf):
    """Host, path, rule and verdict of every page."""
    out = judge(table(spark, sf, "pages").select("page_id", "url", "html"), RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
