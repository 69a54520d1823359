"""URL rules with redirect equivalence.

Rules block or allow a host with its subdomains below a path; the longest that fits wins. Pages that redirect to each other or name a
canonical address are aliases: connected components over these links, found by distributed joins, carry decisions to aliases that no
rule fits. In a component an explicit allow takes precedence over blocks; without either, a page is allowed.

An address is told by host, path without dot segments, and query; scheme and fragment don't matter. Relative links are resolved as RFC 3986
says (section 5.2); those of schemes without a host, such as mailto:, lead nowhere. Only page_id, url and html of the table are looked at,
whatever its other columns are called; addresses and pages may be of any length. Nulls: a null url or one without `://` has empty host
and path, fits no rule, links to nothing and is allowed. A null html has no links. Repeated rows come back as often as they came.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import ascii_lower, written
from wanescope.llm.components import connected_components

#: Most rules that the CASE chain takes: they travel with the plan.
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]

#: Tags, what makes a link canonical (one of rel's values) or a meta tag a redirect, and where they lead.
LINK_TAG, META_TAG = r"(?is)(<link\b[^>]*>)", r"(?is)(<meta\b[^>]*>)"
IS_CANONICAL = r"""(?is)\brel\s*=\s*(["']([^"'>]*\s)?canonical["'\s]|canonical[\s/>])"""
IS_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
HREF, REFRESH_URL = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of an address."""
    full = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(full, PARTS, 1)), F.regexp_extract(full, PARTS, 2), F.regexp_extract(full, PARTS, 3)


def ruled(host: Column, path: Column, rules: list[Rule], value: str) -> Column:
    """The name or verdict of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, value))).otherwise(out)
    return out


def targets(html: Column, host: Column, path: Column) -> Column:
    """Addresses that a page redirects to or calls canonical, as node keys."""
    full = F.coalesce(html, F.lit(""))
    of = lambda tag, has, value: F.transform(F.filter(F.regexp_extract_all(full, F.lit(tag), 1), lambda x: x.rlike(has)), lambda x: F.regexp_extract(x, value, 1))
    hrefs = F.concat(of(LINK_TAG, IS_CANONICAL, HREF), of(META_TAG, IS_REFRESH, REFRESH_URL))

    def absolute(h: Column) -> Column:
        h = F.replace(h, F.lit("&amp;"), F.lit("&"))
        own = F.concat(F.lit("x://"), host)
        out = F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), h).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | h.startswith("#"), F.lit(None).cast("string"))
        out = out.when(h.startswith("//"), F.concat(F.lit("x:"), h)).when(h.startswith("/"), F.concat(own, h)).when(h.startswith("?"), F.concat(own, path, h))
        return out.otherwise(F.concat(own, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", "")), h))

    return F.transform(F.filter(hrefs, lambda h: h != ""), lambda h: node(*parts(absolute(h))))


def undotted(path: Column) -> Column:
    """A path without dot segments: `.` goes, `..` goes with the segment before it."""
    ended = F.when(path.rlike("/\\.{1,2}$"), F.concat(path, F.lit("/"))).otherwise(path)

    def step(kept: Column, s: Column) -> Column:
        back = F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
        return F.when(s == ".", kept).when(s == "..", back).otherwise(F.concat(kept, F.array(s)))

    return F.when(path.contains("/."), F.array_join(F.aggregate(F.split(ended, "/"), F.array().cast("array<string>"), step), "/")).otherwise(path)


def node(host: Column, path: Column, query: Column) -> Column:
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(undotted(path)), F.when(query == "?", F.lit("")).otherwise(query)))


def judge(pages: DataFrame, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, via) for every page; via is `rule`, `alias` or `default`."""
    host, path, query = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), query.alias("query"), F.col(html_col).alias("html"))
    read = split.withColumns({"node": node(F.col("host"), F.col("path"), F.col("query")), "to": targets(F.col("html"), F.col("host"), F.col("path"))}).drop("html", "query")
    read = written(read)
    edges = read.select(F.col("node").alias("u"), F.explode("to").alias("v")).where("u is not null and v is not null")
    roots = written(connected_components(edges))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    h, p, _ = parts(F.concat(F.lit("x://"), F.col("node")))
    fits = members.withColumn("fits", ruled(h, p, rules, "verdict"))
    decided = fits.groupBy("root").agg(F.when(F.max(F.col("fits") == "allow"), "allow").when(F.max(F.col("fits") == "block"), "block").alias("shared")).where("shared is not null")
    shared = members.join(decided, "root").select(F.col("node").alias("alias"), "shared")
    own = read.drop("to").withColumns({"rule": ruled(F.col("host"), F.col("path"), rules, "name"), "by_rule": ruled(F.col("host"), F.col("path"), rules, "verdict")})
    out = own.join(shared, own["node"] == shared["alias"], "left")
    via = F.when(F.col("by_rule").isNotNull(), "rule").when(F.col("shared").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "shared", F.lit("allow")).alias("verdict"), via.alias("via"))
