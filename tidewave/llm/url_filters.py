"""URL filters: allow and block rules, carried to aliases by redirects and canonical links.

Rules name a host with its subdomains and a path prefix; the longest fitting rule decides. Pages
that redirect to each other or name each other as canonical form classes of aliases (connected
components of the link graph). A block on any alias blocks the pages of its class that no rule
decides; an explicit allow on a page itself comes first.

Everything runs as DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import connected_components
from ._shared import ascii_lower, materialise, table


@dataclass(frozen=True)
class UrlRule:
    action: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.action not in ("allow", "block"):
            raise ValueError("action must be allow or block")

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as a struct (rule, action), or null.

    The length of a rule is that of its text; of rules of equal length the block comes first, then
    the first one listed.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), rules[i].action == "allow", i))
    tests = []
    for i in order:
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        tests.append(F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))))
    return F.coalesce(*tests) if tests else F.lit(None).cast("struct<rule:string,action:string>")


def url_key(url: Column) -> Column:
    """The identity of a url as a node: scheme and host in lower case, without the fragment."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), F.when(rest == "", "/").otherwise(rest)))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (``source``, ``target``) that pages state: canonical links and immediate refreshes.

    Only pages whose text holds one of the words are searched. Relative targets are resolved against
    the page: ``//host/path``, ``/path`` and ``name`` beside the page.
    """
    html, url = F.col("html"), F.col("url")
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    link = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?\s*canonical\b)[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b)[^>]*>""", 0)

    def attribute(tag: Column, name: str) -> Column:
        return F.concat(*[F.regexp_extract(tag, rf"(?is)\b{name}{quoted}", k) for k in (1, 2, 3)])

    refresh = F.regexp_extract(attribute(meta, "content"), r"""(?is)^\s*\d*\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    low = F.lower(html)
    canonical = F.when(low.contains("canonical"), attribute(link, "href"))
    moved = F.when(low.contains("http-equiv"), refresh)
    stated = rows.where(url.contains("://")).select("url", F.explode(F.array_compact(F.array(canonical, moved))).alias("to"))
    stated = stated.select("url", F.trim("to").alias("to")).where("to <> ''")
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")))
    to = F.col("to")
    whole = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(origin, to))
        .otherwise(F.concat(folder, to))
    )
    return stated.select(url.alias("source"), whole.alias("target"))


def url_verdicts(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``alias_block`` for every page.

    ``redirects`` (source, target) adds edges to those that the pages state themselves.

    Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, is
    no node of the graph and is allowed; null html states no links; repeated rows are judged each;
    urls that are linked but not among the pages count as aliases, and a rule that blocks one of them
    blocks its class; very long urls are judged whole; other columns, whatever their names, are not looked at; an empty
    table gives an empty result.
    """
    named = [F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")]
    rows = pages.select(*named).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("key", url_key(F.col("url")))
    parts = [e for e in (link_edges(pages, url_col, html_col) if html_col else None, redirects) if e is not None]
    blocked = None
    if parts:
        stated = reduce(DataFrame.unionByName, [e.select(F.col("source").alias("u"), F.col("target").alias("v")) for e in parts])
        edges = materialise(stated.select(url_key(F.col("u")).alias("u"), url_key(F.col("v")).alias("v")).where("u <> v").distinct(), "links")
        if not edges.isEmpty():
            classes = materialise(connected_components(edges), "aliases")
            rule = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
            roots = classes.where(rule["action"] == "block").select("root").distinct()
            blocked = classes.join(roots, "root", "left_semi").select(F.col("node").alias("key"), F.lit(True).alias("alias_block"))
    # a url without a key matches nothing; a mark of its page's own keeps such rows from meeting in one task
    rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string"))))
    rows = rows.join(blocked, "key", "left") if blocked is not None else rows.withColumn("alias_block", F.lit(False))
    by_alias = F.coalesce("alias_block", F.lit(False))
    return rows.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.action"), F.when(by_alias, "block").otherwise("allow")).alias("verdict"),
        by_alias.alias("alias_block"),
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The same in DuckDB, with the classes of aliases by recursion from the blocked urls."""
    host = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    order = sorted(RULES, key=lambda r: (-len(r.text), r.action == "allow"))

    def case(h: str, p: str, value) -> str:
        return "CASE " + " ".join(f"WHEN ({h} = '{r.host}' OR ends_with({h}, '.{r.host}')) AND starts_with({p}, '{r.path}') THEN '{value(r)}'" for r in order) + " END"

    def key(u: str) -> str:
        rest = f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
        return f"CASE WHEN contains({u}, '://') THEN lower(regexp_extract({u}, '(?s)^(.*?)://', 1)) || '://' || {host.format(u)} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"

    def attribute(tag: str, name: str) -> str:
        pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
        return " || ".join(f"regexp_extract({tag}, '{pattern}', {k})" for k in (1, 2, 3))

    link = r"""list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\brel\s*=\s*["'']?\s*canonical\b'))[1]"""
    meta = r"""list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b'))[1]"""
    moved = rf"""regexp_extract({attribute("m", "content")}, '(?is)^\s*\d*\s*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1)"""
    origin = "regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {host.format("coalesce(url, '')")} AS host, {path.format("coalesce(url, '')")} AS path FROM pages),
tags AS (SELECT url, {link} AS l, {meta} AS m FROM p WHERE contains(url, '://')),
stated AS (SELECT url, trim({attribute("l", "href")}) AS t FROM tags UNION ALL SELECT url, trim({moved}) FROM tags),
ends AS (SELECT url AS a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t WHEN starts_with(t, '/') THEN {origin} || t ELSE {origin} || coalesce(nullif(regexp_extract({path.format("url")}, '(?s)^(.*/)', 1), ''), '/') || t END AS b FROM stated WHERE t <> ''),
edges AS (SELECT {key("a")} AS u, {key("b")} AS v FROM ends UNION SELECT {key("b")}, {key("a")} FROM ends),
hit AS (SELECT u AS node FROM edges WHERE {case(host.format("u"), path.format("u"), lambda r: r.action)} = 'block' UNION SELECT v FROM hit JOIN edges ON u = node)
SELECT page_id, host, path, {case("host", "path", lambda r: r.text)} AS rule,
       coalesce({case("host", "path", lambda r: r.action)}, CASE WHEN {key("url")} IN (SELECT node FROM hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM p
"""


OP1_SQL = _sql()
