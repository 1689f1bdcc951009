"""URL filters with redirect equivalence, in DataFrame functions only.

A rule is a verdict, a host and a path; it fits the host and its subdomains where the URL's path
starts with the rule's, and the longest rule that fits decides (of equally long ones ``allow``, then the first by text).  URLs without a rule get the verdict
of their aliases:

1. Edges.  A page's canonical link and its meta refresh tie its URL to the target, as does every row
   of a table of redirects.  URLs are nodes by host, path and query; scheme and fragment do not count.
2. Components of these edges are the smallest node of each (alternating stars, distributed).
3. All URLs of the edges are judged by the rules, those that no page has too.  A component with an
   allowed URL allows its URLs without a rule, else one with a blocked URL blocks them, else
   ``default`` holds.  A rule that fits the URL itself is never overruled.

Rules are an expression while there are ``INLINE`` of them at most; beyond, distinct hosts and paths
meet them by equality of host suffix and path prefix, so a list of any length is a join.

Null URLs and those without ``://`` have an empty host and path, no rule and no aliases.  Null html has
no links.  Links in comments and scripts do not count; a relative link is resolved against the page's
URL.  Repeated rows and rows that share an id or have none are each judged; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, tidied

#: The rules of the query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
INLINE = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query as one text; an empty path is ``/``.  Null where there is no host."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)))


# --------------------------------------------------------------------- links
_IGNORED = r"(?is)<!--.*?-->|<script\b.*?</script"


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute; of its quoted and its bare form the one that is there."""
    form = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.trim(F.concat(*[F.regexp_extract(tag, form, i) for i in (1, 2, 3)]))


def _first_target(html: Column, tags: str, wanted, target) -> Column:
    return F.get(F.transform(F.filter(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), wanted), target), F.lit(0))


def _resolved(base: Column, target: Column) -> Column:
    """``target`` as a URL seen from the page ``base``; null for other schemes and for places within the page."""
    folder = F.regexp_extract(path_of(base), r"^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    place = F.when(target.startswith("?"), F.concat(path_of(base), target)).when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    path, query = F.regexp_extract(place, r"^[^?#]*", 0), F.regexp_extract(place, r"^[^?#]*(.*)$", 1)

    def walked(steps: Column, step: Column) -> Column:
        return F.when(step == "..", F.when(F.size(steps) > 1, F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1)))).otherwise(steps)).when(step == ".", steps).otherwise(F.concat(steps, F.array(step)))

    ends = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    plain = F.array_join(F.aggregate(F.split(ends, "/"), F.array().cast("array<string>"), walked), "/")
    path = F.when(path.rlike(r"/\.\.?(/|$)"), plain).otherwise(path)
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | target.startswith("#") | (target == ""), None)
        .otherwise(F.concat(F.lit("http://"), host_of(base), path, query))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``source, target``: URLs that canonical links and meta refreshes tie.  Of each kind a page has one, the first."""
    some = pages.select(F.col(url).alias("source"), F.col(html).alias("html")).filter(F.col("html").rlike("(?i)canonical|refresh") & (host_of(F.col("source")) != ""))
    seen = some.select("source", F.regexp_replace("html", _IGNORED, " ").alias("html"))
    canonical = _first_target(F.col("html"), r"(?i)<link\b[^>]*>", lambda t: _attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), lambda t: _attribute(t, "href"))
    refresh = _first_target(
        F.col("html"), r"(?i)<meta\b[^>]*>", lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh",
        lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?(.*?)[\"']?$", 1)),
    )
    both = seen.select("source", F.explode(F.array(canonical, refresh)).alias("target")).withColumn("target", F.replace("target", F.lit("&amp;"), F.lit("&")))
    return both.select("source", _resolved(F.col("source"), F.col("target")).alias("target")).filter(F.col("target").isNotNull())


# --------------------------------------------------------------------- rules
def _inline(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as ``rule, verdict``; null where none does."""
    chosen = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, found) if chosen is None else chosen.when(fits, found)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _looked_up(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, r`` of distinct ``places`` that a rule fits.  Each host's suffixes, no longer in labels than any rule's, meet the rule
    hosts; each then looks up its path's prefixes of the lengths that occur for that host: all joins are equalities."""
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))  # distinct lengths of a path
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    at = places.filter(F.lit(most) > 0).select("host", "path", F.explode(tails).alias("rule_host")).join(lengths, "rule_host")
    at = at.select("host", "path", "rule_host", F.explode("sizes").alias("size")).filter(F.length("path") >= F.col("size"))
    found = at.withColumn("rule_path", F.expr("left(path, size)")).join(rules, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.min(F.struct((-F.length(rule)).alias("long"), F.col("verdict").alias("verdict"), rule.alias("rule")))
    return found.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.struct("b.rule", "b.verdict").alias("r"))


def ruled(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``urls`` (with ``host, path``) and their rule ``r``.  ``rules`` is a list or a table ``verdict, host, path``; of rules with the same
    host and path ``allow`` counts."""
    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
        rules = rules.filter("rule_host <> ''").groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
        few = rules.limit(INLINE + 1).collect()
        if len(few) > INLINE:
            found = _looked_up(urls.select("host", "path").distinct(), rules)
            return urls.join(found, ["host", "path"], "left")
        rules = [(x.verdict, x.rule_host, x.rule_path) for x in few]
    return urls.withColumn("r", _inline(F.col("host"), F.col("path"), [(v, h.translate(str.maketrans(_UPPER, _LOWER)), p) for v, h, p in rules]))


@tidied
def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, *, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url",
    html: str = "html", default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, via`` of every page; ``via`` says whose verdict it is: ``rule``, ``alias`` or ``default``.
    ``redirects`` has URLs ``source, target``."""
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    ends = [F.struct(F.md5(node_of(F.col(c))).alias("node"), host_of(F.col(c)).alias("host"), F.regexp_extract(node_of(F.col(c)), r"^[^/]*([^?]*)", 1).alias("path")) for c in ("source", "target")]
    edges = materialize(edges.select(ends[0].alias("s"), ends[1].alias("t")).filter("s.node <> t.node").distinct(), "url-edges")
    classes = connected_components(edges.select(F.col("s.node").alias("a"), F.col("t.node").alias("b")))
    urls = edges.select(F.explode(F.array("s", "t")).alias("u")).select("u.*").groupBy("node").agg(F.first("host").alias("host"), F.first("path").alias("path"))
    judged = classes.join(ruled(urls, rules).select("node", F.col("r.verdict").alias("says")), "node")
    says = lambda v: F.coalesce(F.max(F.when(F.col("says") == v, 1)), F.lit(0)).alias(v)
    groups = judged.groupBy("comp").agg(says("allow"), says("block")).filter("allow + block > 0")
    aliases = classes.join(groups, "comp").select("node", F.when(F.col("allow") == 1, "allow").otherwise("block").alias("alias"))
    aliases = materialize(aliases, "url-aliases")

    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.md5(node_of(F.col(url))).alias("node"))
    rows = ruled(rows, rules).join(aliases, "node", "left")
    via = F.when(F.col("r").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "alias", F.lit(default)).alias("verdict"), via.alias("via"))
