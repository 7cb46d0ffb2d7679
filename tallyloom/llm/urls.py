"""URL rules whose decisions reach all aliases of a URL, by DataFrame operations alone.

Aliases are the URLs of a connected component over redirects and canonical
links. A URL's own longest rule decides it. One without a rule takes the
decision of its component: allow if some URL there is allowed by a rule, else
block if some is blocked by a rule, else allow.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, scratch


def _lower(c: Column) -> Column:
    """A-Z lower-cased."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #. Both are empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rule_host, rule_path, action) from (action, text) pairs such as ("block", "com/en/")."""
    rows = [F.struct(F.lit(text).alias("rule"), F.lit(text.partition("/")[0]).alias("rule_host"), F.lit("/" + text.partition("/")[2]).alias("rule_path"), F.lit(action).alias("action")) for action, text in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted in either way or not at all, with its ampersands decoded; empty without one."""
    one = lambda pattern: F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{pattern}", 1), F.lit(""))
    value = F.coalesce(one('"([^"]*)"'), one("'([^']*)'"), one(r"""([^\s"'>]+)"""), F.lit(""))
    return F.trim(F.regexp_replace(value, r"(?i)&(amp|#38|#x26);", "&"))


def normal(url: Column) -> Column:
    """A URL with its scheme and host in lower case and without its fragment; unchanged if it has no ://."""
    scheme = F.regexp_extract(url, r"^([^/?#:]*://)", 1)
    rest = F.regexp_replace(F.substr(url, F.length(scheme) + 1), r"(?s)#.*$", "")
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    return F.when(F.length(scheme) == 0, url).otherwise(F.concat(_lower(scheme), _lower(host), F.substr(rest, F.length(host) + 1)))


def resolve(base: Column, link: Column) -> Column:
    """The absolute URL, not yet a normal one, of a link on a page of that (normal) URL; null if the link leads nowhere else."""
    site = F.regexp_extract(base, r"^([^/?#:]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([^/?#:]*:)//", 1)
    path = F.regexp_extract(base, r"^[^/?#:]*://[^/?#]*([^?#]*)", 1)
    clean = F.regexp_replace(link, r"(?s)#.*$", "")
    query = F.regexp_extract(clean, r"(\?.*)$", 1)
    own = F.regexp_extract(clean, r"^([^?]*)", 1)
    joined = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.regexp_extract(path, r"^(.*/)", 1), own))
    # steps of . and .. are taken
    steps = F.split(F.regexp_replace(joined, r"^/", ""), "/")
    back = F.concat(steps, F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    taken = F.aggregate(
        back, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    )
    return (
        F.when(F.length(clean) == 0, None).when(F.length(site) == 0, F.when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), clean))
        .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), clean).when(F.startswith(clean, F.lit("//")), F.concat(scheme, clean))
        .when(clean.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(F.startswith(clean, F.lit("?")), F.concat(site, path, clean))
        .otherwise(F.concat(site, F.lit("/"), F.array_join(taken, "/"), query))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): a page's URL and the URL that its first canonical link, or its first refresh to another URL, names; relative
    ones are resolved. Attributes may come in any order, with either quotes or none. Both URLs are normal ones."""
    tags = lambda name: F.regexp_extract_all(html_col, F.lit(rf"(?is)<{name}\s[^>]*>"), F.lit(0))
    links = F.filter(tags("link"), lambda tag: F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical"))
    metas = F.filter(tags("meta"), lambda tag: F.lower(_attribute(tag, "http-equiv")) == "refresh")
    marked = pages.filter(F.col(html_col).rlike("(?i)canonical|refresh"))  # most pages end here
    tagged = marked.select(normal(F.col(url_col)).alias("u"), F.get(links, F.lit(0)).alias("link_tag"), F.get(metas, F.lit(0)).alias("meta_tag")).filter("u is not null and (link_tag is not null or meta_tag is not null)")
    named = tagged.select("u", _attribute(F.col("link_tag"), "href").alias("href"), _attribute(F.col("meta_tag"), "content").alias("content"))
    target = F.regexp_extract("content", r"""(?is)[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
    found = named.select("u", F.explode(F.array("href", F.trim(target))).alias("link")).filter(F.length("link") > 0)
    return found.select("u", resolve(F.col("u"), F.col("link")).alias("v")).select("u", normal(F.col("v")).alias("v")).filter("v is not null")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each page: page_id, host, path, rule (null without one), verdict (allow or block), component_rule (the action taken from aliases, else null).

    edges are (u, v) of normal URLs. A null URL has an empty host and path, no
    rule and no aliases; one without :// has no rule. Of rules of equal length
    that fit, an allowing one wins, then the smaller. Pages whose normal URLs are
    equal share a verdict. A row is a page of its own, whether its id is null or
    repeats: its URL alone decides. Other columns are left out.
    """
    own_host, own_path = host_and_path(F.col(url_col))
    pages = pages.select(F.col(id_col).alias("page_id"), normal(F.col(url_col)).alias("url"), own_host.alias("host"), own_path.alias("path"))
    linked = scratch.written(edges.select("u", "v").filter("u is not null and v is not null").distinct(), "edges")
    urls = pages.select("url").union(linked.select("u")).union(linked.select("v")).filter("url is not null").distinct()
    host, path = host_and_path(F.col("url"))
    urls = urls.select("url", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fits = urls.select("url", "path", F.explode(suffix).alias("rule_host")).join(rules, "rule_host").filter(F.startswith("path", "rule_path"))
    order = F.struct((-F.length("rule")).alias("shorter"), (F.col("action") != "allow").alias("blocks"), "rule", "action")
    best = fits.groupBy("url").agg(F.min(order).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    ruled = scratch.written(urls.join(best, "url", "left"), "ruled")

    parts = graph.components(linked, "aliases").withColumnRenamed("node", "url")
    inherits = parts.join(ruled.filter("action is not null").select("url", "action"), "url").groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"))
    inherits = inherits.select("component", F.when(F.col("allowed"), "allow").otherwise("block").alias("component_rule"))
    known = ruled.join(parts.join(inherits, "component").select("url", "component_rule"), "url", "left").select("url", "rule", "action", "component_rule")
    out = pages.join(known, "url", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "component_rule", F.lit("allow")).alias("verdict"), "component_rule")
