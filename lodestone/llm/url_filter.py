"""URL filter: rules by host and path, and block decisions that reach a page's other addresses.

A rule is (action, host, path); it fits its host and all subdomains where the url's path
starts with its path, and the longest (host and path together) wins; of equally long ones
the longer host, of repeated ones ``allow``. All suffixes of a url's host are looked up (as
deep as the deepest rule's host), then the prefixes of its path in the lengths that this
host's rules have, each by an equality join against one row a key: no join by
comparison, and a host with a third of the urls meets a side that adaptive execution can
copy.

Redirect equivalence: two urls are aliases if they are joined by a chain of

* canonical links (`<link rel=canonical href=...>`) and refreshes (`<meta
  http-equiv=refresh content="0; url=...">`) in the pages, resolved against the page's url,
* rows of a table of observed redirects (url, target), if one is given,
* their address: the scheme, default ports, user names, fragments and the tracking
  parameters of `TRACKING` do not count, nor does an absent path differ from `/`.

Nodes are 128-bit digests of addresses; distributed connected components join them. A url
with a rule keeps the rule's verdict; rules judge the targets of links too, in the table or not. Another one is allowed if an alias is explicitly
allowed, else blocked if an alias is blocked, else allowed. DataFrame functions only.

Edge cases: a null url, or one without `://`, has an empty host and path, no rule, no
aliases and is allowed; links that do not resolve (other schemes, null or empty targets)
are no edges; a page that links to itself has no edge; repeated rows are judged alike; null
html has no links; an empty table gives an empty result; other columns are ignored, and no
rules or no redirects mean empty tables of them. Tags with `<` or `>` inside an attribute
are not read, dot segments are not folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, table
from lodestone.llm.components import components
from lodestone.llm.line_dedup import LOWER, UPPER

#: The query's rules: action, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Parameters that only track where a visitor came from.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|msclkid|mc_eid)"

HOST, PATH = r"^[^/?#]*", r"^[^/?#]*([^?#]*)"
LINK, META = r"(?i)<link\s[^<>]*>", r"(?i)<meta\s[^<>]*>"
CANONICAL = r"(?i)\srel\s*=\s*[\"']?\s*canonical[\s\"'/>]"
REFRESH = r"(?i)\shttp-equiv\s*=\s*[\"']?\s*refresh[\s\"'/>]"
HREF = r"(?i)\shref\s*=\s*[\"']?\s*([^\s\"'<>]+)"
TARGET = r"(?i)\scontent\s*=\s*[\"']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*[\"']?([^\s\"'<>]+)"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(action, host, path) rows as a table of literals."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("action", "host", "path")))
    row = lambda r: F.struct(*(F.lit(v).alias(c) for c, v in zip(("action", "host", "path"), r, strict=True)))
    return spark.range(1).select(F.inline(F.array(*map(row, rules))))


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """The host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), HOST, 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path: after the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), PATH, 1), F.lit(""))


def with_node(rows: DataFrame, url_col: str, name: str) -> DataFrame:
    """``rows`` with the digest of their url's address; null where the url is no web address.

    In steps of few expressions each, so that the generated code stays small."""
    url = F.col(url_col)
    rest = F.when(F.lower(F.substring(url, 1, 8)).rlike("^https?://"), F.regexp_replace(_after_scheme(url), "#.*$", ""))
    found = rows.withColumn("__rest", rest)
    found = found.withColumns({
        "__host": F.regexp_replace(F.translate(F.regexp_extract("__rest", HOST, 0), UPPER, LOWER), "^.*@|:(?:80|443)?$", ""),
        "__at": F.coalesce(F.nullif(F.regexp_extract("__rest", PATH, 1), F.lit("")), F.lit("/")),
        "__query": F.regexp_extract("__rest", r"\?(.*)$", 1)})
    found = found.withColumn("__query", F.regexp_replace(F.regexp_replace("__query", rf"(?i)(?:^|(?<=&)){TRACKING}=[^&]*(?:&|$)", ""), "&$", ""))
    tail = F.when(F.col("__query") != "", F.concat(F.lit("?"), "__query")).otherwise("")
    return found.withColumn(name, F.when(F.col("__host") != "", F.md5(F.concat("__host", "__at", tail)))).drop("__rest", "__host", "__at", "__query")


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): the canonical links and refreshes of ``pages`` (url, html).

    Links are absolute, `//host/..`, `/path`, `?query`, `#part` or relative to the page's folder."""
    def found(tags: str, kind: str, value: str) -> Column:
        own = F.filter(F.regexp_extract_all("html", F.lit(tags), F.lit(0)), lambda tag: tag.rlike(kind))
        return F.transform(own, lambda tag: F.regexp_extract(tag, value, 1))

    some = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").contains("://"))
    links = some.select("url", F.explode(F.concat(found(LINK, CANONICAL, HREF), found(META, REFRESH, TARGET))).alias("link")).where("link != ''")
    links = cut(links).select("url", F.regexp_replace("link", "&amp;", "&").alias("link"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    link = F.col("link")
    folder = F.coalesce(F.nullif(F.regexp_extract("path", "^.*/", 0), F.lit("")), F.lit("/"))
    before = (F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).when(link.startswith("//"), F.lit("http:"))
        .otherwise(F.concat(F.lit("http://"), "host", F.when(link.startswith("/"), F.lit("")).when(link.startswith("?"), F.col("path")).otherwise(folder))))
    return links.select("url", F.when(link.startswith("#"), F.col("url")).otherwise(F.concat(before, link)).alias("target"))


def link_ends(links: DataFrame) -> DataFrame:
    """(a, b, url, target): ``links`` (url, target) with the digests of their ends, without loops."""
    ends = cut(with_node(with_node(links.select("url", "target"), "url", "a"), "target", "b"))
    return ends.where("a is not null and b is not null and a != b")


def match_rules(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule, action) of the rule that wins for each of ``urls`` (key, host, path) that has one."""
    once = rules.where("action is not null and host is not null and path is not null").groupBy("host", "path").agg(F.min("action").alias("action"))
    deep = once.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"]  # one number
    if deep is None:
        return urls.select(key, F.lit("").alias("rule"), F.lit("").alias("action")).limit(0)
    labels = F.split("host", r"\.")
    least = F.greatest(F.lit(1), F.size(labels) - F.lit(deep - 1))
    suffixes = F.transform(F.sequence(least, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = once.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    tried = (urls.where("host != ''").select(key, "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
        .select(key, "suffix", "path", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
        .select(key, F.col("suffix").alias("host"), F.substring("path", F.lit(1), F.col("n")).alias("path")))
    fit = tried.join(once, ["host", "path"]).select(key, F.concat("host", "path").alias("rule"), "action", F.length("host").alias("h"))
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.col("h"))).alias("best")
    return fit.groupBy(key).agg(best).select(key, "best.*")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, alias_verdict) for each row of ``pages`` (id, url, html).

    ``alias_verdict`` is what the aliases with a rule say: allow, block or null."""
    rows = with_node(pages.select(F.col(id_col).alias("__id"), "url"), "url", "__node")
    place = lambda url: (host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = cut(rows.select("__id", "__node", *place("url")))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    ends = link_ends(links)
    linked = bool(ends.take(1))
    named = rows.select("__node", "host", "path")
    if linked:  # addresses outside the table have rules too
        named = named.union(ends.select("a", *place("url"))).union(ends.select("b", *place("target")))
    key = F.struct("host", "path").alias("__key")
    won = cut(match_rules(named.select("host", "path").distinct().select("host", "path", key), rules, "__key"))
    same = components(ends) if linked else None

    def classed(df: DataFrame) -> DataFrame:
        found = df.withColumn("__key", key).join(won, "__key", "left").drop("__key")
        if not linked:
            return found.withColumn("__class", F.col("__node"))
        found = found.join(same.withColumnRenamed("node", "__node"), "__node", "left")
        return found.withColumn("__class", F.coalesce("component", "__node")).drop("component")

    says = classed(named.distinct()).where("action is not null and __class is not null").groupBy("__class").agg(F.min("action").alias("alias_verdict"))
    out = classed(rows).join(says, "__class", "left")
    verdict = F.coalesce("action", "alias_verdict", F.lit("allow"))
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "alias_verdict")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules_table(spark)).drop("alias_verdict")


_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
OP11_SQL = rf"""
WITH RECURSIVE
rules(action, rhost, rpath) AS (VALUES {_RULE_ROWS}),
cutoff AS (SELECT page_id, url, html,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cutoff),
tags AS (SELECT url, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^<>]*>')) AS tag FROM p WHERE rest IS NOT NULL),
raw AS (SELECT url, host, path, replace(CASE
               WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?\s*canonical[\s"''/>]')
               THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?\s*([^\s"''<>]+)', 1)
               WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?\s*refresh[\s"''/>]')
               THEN regexp_extract(tag, '(?i)\scontent\s*=\s*["'']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*["'']?([^\s"''<>]+)', 1) END, '&amp;', '&') AS link FROM tags),
links AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
                           WHEN starts_with(link, '//') THEN 'http:' || link
                           WHEN starts_with(link, '/') THEN 'http://' || host || link
                           WHEN starts_with(link, '#') THEN url
                           WHEN starts_with(link, '?') THEN 'http://' || host || path || link
                           ELSE 'http://' || host || CASE WHEN strpos(path, '/') > 0 THEN regexp_extract(path, '^.*/') ELSE '/' END || link END AS target
          FROM raw WHERE link <> ''),
target_place AS (SELECT target AS url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
                 FROM (SELECT DISTINCT target, substr(target, strpos(target, '://') + 3) AS rest FROM links WHERE strpos(target, '://') > 0)),
known AS (SELECT DISTINCT url FROM p UNION SELECT target FROM links),
parts AS (SELECT url, substr(url, strpos(url, '://') + 3) AS rest FROM known WHERE regexp_matches(url, '^(?i:https?)://[^/?#]')),
named AS (SELECT url, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^.*@', ''), ':(80|443)?$', '') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                 array_to_string(list_filter(string_split(regexp_extract(regexp_replace(rest, '#.*$', ''), '\?(.*)$', 1), '&'),
                                             lambda x: NOT regexp_matches(x, '(?i)^(utm_[a-z]+|gclid|fbclid|msclkid|mc_eid)=')), '&') AS query FROM parts),
node AS (SELECT url, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN regexp_replace(query, '&$', '') <> '' THEN '?' || regexp_replace(query, '&$', '') ELSE '' END AS n
         FROM named WHERE host <> ''),
edge AS (SELECT DISTINCT a.n AS a, b.n AS b FROM links l JOIN node a ON a.url = l.url JOIN node b ON b.url = l.target WHERE a.n <> b.n),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT e.b, x.m FROM reach x JOIN both_ways e ON e.a = x.n),
component AS (SELECT n, min(m) AS m FROM reach GROUP BY n),
place AS (SELECT host, path FROM p UNION SELECT host, path FROM target_place),
fit AS (SELECT host, path, rhost || rpath AS rule, action,
               row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action) AS k
        FROM place JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
class AS (SELECT node.url, coalesce(c.m, node.n) AS class FROM node LEFT JOIN component c ON c.n = node.n),
says AS (SELECT class, min(action) AS verdict
         FROM (SELECT url, host, path FROM p UNION SELECT url, host, path FROM target_place) u JOIN class USING (url) JOIN fit USING (host, path) WHERE k = 1 GROUP BY class)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, s.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit f ON f.host = p.host AND f.path = p.path AND f.k = 1 LEFT JOIN class ON class.url = p.url LEFT JOIN says s ON s.class = class.class
"""
