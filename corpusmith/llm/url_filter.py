"""URL filters with redirect equivalence, in DataFrame operations only.

A page's own rule decides first: rules name a host (with its subdomains) and a path prefix; the longest one that
fits wins, and allow wins between equals. Pages without a rule take the verdict of their aliases: nodes are addresses
(host, path and query), edges are canonical links, refreshes and redirect parameters, and each connected
component is allowed if any rule allows one of its addresses, else blocked if any blocks one, else allowed.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule, belongs to no component and
is allowed; null html has no links; repeated rows are judged each; an empty table gives no row; a null
``page_id`` stays null; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER
from .components import components

HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*>"""
GOES_TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""
REDIRECT = r"(?is)[?&](?:url|u|to|target|redirect|dest|goto)=(https?(?:://|%3A%2F%2F)[^&#]+)"
#: Above so many rules, they are joined on the host's suffixes instead of being written into the expression.
INLINE_RULES = 64


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address that aliases share: host, path and query, without scheme and fragment; null if it has no host."""
    node = F.concat(host_of(url), path_of(url), F.regexp_extract(url, QUERY, 1))
    return F.when(host_of(url) != "", node)


def absolute(link: Column, url: Column) -> Column:
    """A link as it is meant on the page at ``url``; null for an empty one."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    site = F.concat(scheme, F.regexp_extract(url, HOST, 1))
    return (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(link.rlike(r"(?is)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.regexp_replace(path_of(url), r"[^/]*$", ""), F.when(path_of(url) == "", "/").otherwise(""), link))
    )


def targets_of(url: Column, html: Column) -> Column:
    """Where a page says it lives or goes: canonical link, refresh and redirect parameter."""
    unescaped = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    canonical = absolute(unescaped(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1)), url)
    refresh = absolute(unescaped(F.regexp_extract(F.regexp_extract(html, REFRESH, 0), GOES_TO, 1)), url)
    sent = F.regexp_extract(url, REDIRECT, 1)
    redirect = F.when(sent != "", F.coalesce(F.try_url_decode(sent), sent))
    return F.array_compact(F.array(canonical, refresh, redirect))


def _best(df: DataFrame, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` for columns ``host`` and ``path``; ``key`` identifies a row."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict))
    if len(rules) <= INLINE_RULES:
        fits = lambda r: (F.col("host") == r.host) | F.col("host").endswith("." + r.host)
        tests = [(fits(r) & F.col("path").startswith(r.path), r) for r in order]
        return df.withColumn("rule", F.coalesce(*[F.when(t, r.text) for t, r in tests]) if tests else F.lit(None).cast("string")).withColumn("rule_verdict", F.coalesce(*[F.when(t, r.verdict) for t, r in tests]) if tests else F.lit(None).cast("string"))
    table = df.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict, i) for i, r in enumerate(reversed(order))], "r_host string, r_path string, r_text string, r_verdict string, r_rank int")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = df.filter("host <> ''").select(key, "path", F.explode(ends).alias("r_host"))
    found = pairs.join(table, "r_host").filter(F.col("path").startswith(F.col("r_path")))
    best = found.groupBy(key).agg(F.max_by(F.struct("r_text", "r_verdict"), "r_rank").alias("best"))
    return df.join(best, key, "left").withColumn("rule", F.col("best.r_text")).withColumn("rule_verdict", F.col("best.r_verdict")).drop("best")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page."""
    url = F.col("url")
    seen = pages.select("page_id", "url", targets_of(url, F.col("html")).alias("targets"))
    links = seen.select(node_of(url).alias("a"), url.alias("from_url"), F.explode("targets").alias("to_url")).withColumn("b", node_of(F.col("to_url"))).filter("a is not null and b is not null and a <> b")
    reached = components(links, "a", "b")
    ends = links.select(F.col("a").alias("node"), F.col("from_url").alias("url")).unionByName(links.select(F.col("b").alias("node"), F.col("to_url").alias("url")))
    judged = _best(ends.select("node", host_of(url).alias("host"), path_of(url).alias("path")).dropDuplicates(["node"]), "node", rules)
    by_comp = judged.join(reached, "node").groupBy("comp").agg(F.max(F.col("rule_verdict") == "allow").alias("allowed"), F.max(F.col("rule_verdict") == "block").alias("blocked"))
    passed_on = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    by_node = reached.join(by_comp, "comp").select("node", passed_on.alias("alias_verdict"))
    own = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    own = _best(own, "row", rules)
    return own.join(by_node, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for :func:`judge` on ``pages`` (inline rules)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    host = lambda u: f"coalesce(translate(regexp_extract({u}, {q(HOST)}, 1), '{UPPER}', '{LOWER}'), '')"
    path = lambda u: f"coalesce(regexp_extract({u}, {q(PATH)}, 1), '')"
    node = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || {path(u)} || regexp_extract({u}, {q(QUERY)}, 1) END"
    order = sorted(rules, key=lambda r: (-len(r.text), r.verdict))
    best = lambda what: "CASE " + " ".join(f"WHEN (host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}) THEN {q(what(r))}" for r in order) + " END"
    site = f"regexp_extract(url, '(?s)^(.*?://)', 1) || regexp_extract(url, {q(HOST)}, 1)"
    full = lambda x: f"CASE WHEN coalesce({x}, '') = '' THEN NULL WHEN regexp_matches({x}, '(?is)^[a-z][a-z0-9+.-]*://') THEN {x} WHEN starts_with({x}, '//') THEN 'http:' || {x} WHEN starts_with({x}, '/') THEN {site} || {x} ELSE {site} || regexp_replace({path('url')}, '[^/]*$', '') || CASE WHEN {path('url')} = '' THEN '/' ELSE '' END || {x} END"
    link = lambda a, b: f"replace(regexp_extract(regexp_extract(html, {q(a)}, 0), {q(b)}, 1), '&amp;', '&')"
    sent = f"regexp_extract(url, {q(REDIRECT)}, 1)"
    return f"""
WITH RECURSIVE targets AS (
  SELECT url, {full(link(CANONICAL, HREF))} AS t FROM pages
  UNION ALL SELECT url, {full(link(REFRESH, GOES_TO))} FROM pages
  UNION ALL SELECT url, CASE WHEN {sent} <> '' THEN url_decode({sent}) END FROM pages
), links AS (SELECT {node('url')} AS a, url, {node('t')} AS b, t FROM targets WHERE t IS NOT NULL),
e AS (SELECT * FROM links WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
both_ways AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)),
reach AS (SELECT a AS n, a AS m FROM both_ways UNION SELECT r.n, x.b FROM reach r JOIN both_ways x ON r.m = x.a),
ends AS (SELECT a AS n, url AS u FROM e UNION SELECT b, t FROM e),
judged AS (SELECT n, {best(lambda r: r.verdict)} AS v FROM (SELECT n, {host('u')} AS host, {path('u')} AS path FROM ends)),
passed AS (SELECT r.n, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' ELSE 'allow' END AS v FROM reach r JOIN judged j ON r.m = j.n GROUP BY r.n),
own AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages)
SELECT page_id, host, path, {best(lambda r: r.text)} AS rule, coalesce({best(lambda r: r.verdict)}, p.v, 'allow') AS verdict
FROM own LEFT JOIN passed p ON own.node = p.n
"""
