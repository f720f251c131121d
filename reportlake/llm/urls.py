"""URL filters: block decisions travel along redirects and canonical links.

Rules name a host and the beginning of a path. A url that a rule fits is judged by the longest such rule. Other
urls are judged by their equivalence class: the connected component over edges from a url to where it
redirects, to the address its page names as canonical, and to its own tidy form. A component with a blocked
member is blocked, unless a member is explicitly allowed. Everything is column expressions; components
are found by star contraction, and no table of them is gathered or sent along.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text
from reportlake.llm.components import components


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str  # begins with /
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("com", "/", True),
    UrlRule("example.com", "/en/", False),
    UrlRule("www.example.com", "/en/", True),
    UrlRule("net", "/es/", False),
    UrlRule("net", "/fr/", False),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = "([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def _after_scheme(url: Column) -> Column:
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """Name of the longest rule that fits; of equally long ones, the longer host, then an allowing one. Else null.

    Rules are a short list given with the query, so they stand in the expression.
    """
    ordered = sorted(set(rules), key=lambda r: (-len(r.name), -len(r.host), not r.allow, r.name))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def allowed(rule: Column, rules: Sequence[UrlRule]) -> Column:
    return rule.isin([r.name for r in rules if r.allow]) if any(r.allow for r in rules) else F.lit(False) & rule.isNotNull()


def tidy(url: Column) -> Column:
    """The url without scheme differences, fragment, tracking parameters and slashes at the end."""
    tail = F.regexp_extract(_after_scheme(url), "(?s)^[^/?#]*(.*)$", 1)
    tail = F.regexp_replace(F.regexp_replace(tail, "(?s)#.*$", ""), TRACKING, "$1")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, "&+", "&"), r"\?&", "?"), "[?&]+$", "")
    return F.concat(F.lit("https://"), host_of(url), F.regexp_replace(tail, "/+$", ""))


def _resolved(url: Column, target: Column) -> Column:
    """An address on a page as a whole url."""
    site = F.regexp_extract(url, "^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, "^([^:/?#]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("https:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(folder != "", F.concat(folder, target))
    )


CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): a page's url with its tidy form, its canonical address and the target of its refresh."""
    text = whole_text(html)
    found = [
        tidy(F.col("u")),
        _resolved(F.col("u"), F.nullif(F.regexp_extract(F.regexp_extract(text, CANONICAL, 0), HREF, 1), F.lit(""))),
        _resolved(F.col("u"), F.nullif(F.regexp_extract(F.regexp_extract(text, REFRESH, 0), TARGET, 1), F.lit(""))),
    ]
    rows = pages.select(F.col(url).cast("string").alias("u"), F.col(html)).filter("u LIKE '%://%'")
    rows = rows.select("u", F.array(*found).alias("targets"))
    return rows.select("u", F.explode_outer("targets").alias("v")).filter("v IS NOT NULL AND v <> u")


def judged(pages: DataFrame, rules: Sequence[UrlRule] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``redirects`` (u, v) adds edges to those of the pages.

    A url that is null or lacks ``://`` has no host, no rule and no links, and is allowed. Repeated
    rows are each judged, alike. Urls that only links name count as members. Without rules, all is allowed.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("u", "v"))
    found = components(edges)
    rule = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    members = found.withColumn("rule", rule).withColumn("allow", allowed(F.col("rule"), rules))
    told = members.groupBy("component").agg(
        F.bool_or(F.col("rule").isNotNull() & ~F.col("allow")).alias("blocks"), F.bool_or(F.coalesce("allow", F.lit(False))).alias("allows")
    )
    blocked = members.filter("rule IS NULL").join(told.filter("blocks AND NOT allows").select("component"), "component", "left_semi")
    blocked = blocked.select(F.col("node").alias("url"), F.lit(True).alias("alias_blocked"))

    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "url", "left")
    good = F.when(F.col("rule").isNotNull(), allowed(F.col("rule"), rules)).otherwise(F.col("alias_blocked").isNull())
    return rows.select("page_id", "host", "path", "rule", F.when(good, F.lit("allow")).otherwise(F.lit("block")).alias("verdict"))


def oracle(rules: Sequence[UrlRule] = RULES) -> str:
    """DuckDB SQL; components by following all edges both ways."""
    ordered = sorted(set(rules), key=lambda r: (-len(r.name), -len(r.host), not r.allow, r.name))
    after = "(CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END)"

    def host(url: str) -> str:
        return f"translate(regexp_extract({after.format(url)}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"

    def path(url: str) -> str:
        return f"regexp_extract({after.format(url)}, '^[^/?#]*([^?#]*)', 1)"

    def rule(h: str, p: str) -> str:
        cases = " ".join(f"WHEN ({h} = '{r.host}' OR ends_with({h}, '.{r.host}')) AND starts_with({p}, '{r.path}') THEN '{r.name}'" for r in ordered)
        return f"CASE {cases} END"

    allows = ", ".join(f"'{r.name}'" for r in rules if r.allow)
    tail = f"regexp_extract({after.format('u')}, '(?s)^[^/?#]*(.*)$', 1)"
    tail = f"regexp_replace(regexp_replace({tail}, '(?s)#.*$', ''), '{TRACKING}', '\\1', 'g')"
    tail = f"regexp_replace(regexp_replace(regexp_replace({tail}, '&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '')"
    neat = f"'https://' || {host('u')} || regexp_replace({tail}, '/+$', '')"

    def target(tag: str, name: str) -> str:
        t, n = tag.replace("'", "''"), name.replace("'", "''")
        return f"nullif(regexp_extract(regexp_extract(html, '{t}'), '{n}', 1), '')"

    def whole(t: str) -> str:
        site, folder = "regexp_extract(u, '^([^:/?#]*://[^/?#]*)', 1)", "regexp_extract(u, '^([^:/?#]*://[^/?#]*/(?:[^?#]*/)?)', 1)"
        return f"CASE WHEN contains({t}, '://') THEN {t} WHEN starts_with({t}, '//') THEN 'https:' || {t} WHEN starts_with({t}, '/') THEN {site} || {t} WHEN {folder} <> '' THEN {folder} || {t} END"

    return (
        "WITH RECURSIVE p AS (SELECT page_id, url AS u, coalesce(html, '') AS html FROM pages),"
        f" t AS (SELECT u, {neat} AS a, {target(CANONICAL, HREF)} AS b, {target(REFRESH, TARGET)} AS c FROM p WHERE u LIKE '%://%'),"
        f" d AS (SELECT u, a AS v FROM t UNION SELECT u, {whole('b')} FROM t UNION SELECT u, {whole('c')} FROM t),"
        " e AS (SELECT u, v FROM d WHERE v IS NOT NULL AND u <> v UNION SELECT v, u FROM d WHERE v IS NOT NULL AND u <> v),"
        " r AS (SELECT DISTINCT u AS node, u AS seen FROM e UNION SELECT e.v, r.seen FROM r JOIN e ON r.node = e.u),"
        " m AS (SELECT node, min(seen) AS component FROM r GROUP BY node),"
        f" k AS (SELECT *, {rule(host('node'), path('node'))} AS rule FROM m),"
        f" g AS (SELECT component FROM k GROUP BY component HAVING bool_or(rule IS NOT NULL AND rule NOT IN ({allows})) AND NOT bool_or(coalesce(rule IN ({allows}), false))),"
        " x AS (SELECT node FROM k WHERE rule IS NULL AND component IN (SELECT component FROM g)),"
        f" j AS (SELECT page_id, u, {host('q')} AS host, {path('q')} AS path FROM (SELECT *, coalesce(u, '') AS q FROM p)),"
        f" y AS (SELECT *, {rule('host', 'path')} AS rule FROM j)"
        f" SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({allows}) THEN 'allow' ELSE 'block' END"
        " WHEN u IN (SELECT node FROM x) THEN 'block' ELSE 'allow' END AS verdict FROM y"
    )
