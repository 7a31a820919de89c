"""URL filters: rules on hosts and paths, and redirect equivalence for what no rule names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.sources.cut import cut

Rule = tuple[str, str, str]  # verdict, host, path
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The SQL twin reads these three; `page_links` reads tags and attributes in any case, with white space around the =.
CANONICAL = r"<link[^>]*rel=[\"']?canonical[\"']?[^>]*>"
REFRESH = r"<meta[^>]*http-equiv=[\"']?[Rr]efresh[\"']?[^>]*>"
TARGET = r"(?:href=|content=[\"'][0-9. ]*;? *[Uu][Rr][Ll]=)[\"']?([^\"' >]+)"

TAGS = r"(?i)<link\s[^>]*rel\s*=\s*[\"']?canonical\b[^>]*>|<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>"
TAG_TARGET = r"(?i)(?:\shref\s*=\s*|content\s*=\s*[\"']?[0-9. ]*[;,]?\s*url\s*=\s*)[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """One spelling of an address: no scheme, no www. or m. before the host, no fragment, no tracking parameters, no last slash; null without a host."""
    host, path = F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|\z)") & (p != ""))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def resolved(base: Column, target: Column) -> Column:
    """The address that a link on the page `base` means: itself, or put together from the page's scheme, host and folder."""
    site = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder, rest = F.regexp_extract(path_of(base), r"^(.*/)", 1), F.regexp_extract(target, r"([?#].*)\z", 1)
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    whole = F.when(path.startswith("/"), path).when(path == "", path_of(base)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    flat = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    own_query = F.when((path == "") & ~rest.startswith("?"), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)).otherwise(F.lit(""))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(site == "", F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), target))
        .otherwise(F.concat(site, F.when(whole.contains("/."), flat).otherwise(whole), own_query, rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges `a, b` between address keys, of a page and its canonical link or refresh target, and the target's `host` and `path`."""
    tags = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(TAGS), F.lit(0))
    rows = pages.select("url", F.explode(tags).alias("tag"))
    target = F.regexp_replace(F.regexp_extract("tag", TAG_TARGET, 1), r"(?i)&(amp|#38|#x26);", "&")
    rows = rows.select("url", target.alias("target")).where("target <> ''")
    rows = rows.select(alias_key(F.col("url")).alias("a"), resolved(F.col("url"), F.col("target")).alias("target"))
    return rows.select("a", alias_key(F.col("target")).alias("b"), host_of(F.col("target")).alias("host"), path_of(F.col("target")).alias("path"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, links: DataFrame | None = None) -> DataFrame:
    """Verdict on every page's url: `page_id, host, path, rule, verdict, alias, component`.

    The longest rule that fits decides. For urls without one, addresses that redirect to each other, name each
    other as canonical or are spellings of one address form a component, found by distributed union-find over
    `links` (columns `a, b` of `alias_key`s; by default those in the pages' html). If a rule blocks any page of the
    component, or a link's target that may have no row (where `links` has its `host` and `path`), its pages without a
    rule are blocked too; an explicit allow keeps its own page but does not clear
    others. All else is allowed.

    A null url, or one without `://`, has empty host and path, no rule, and is allowed. Repeated rows are judged
    each, an empty table gives no rows, other columns than page_id, url and html are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), alias_key(F.col("url")).alias("alias"))
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in by_length]
    pick = lambda k: F.coalesce(*[F.when(f, F.lit(k(r))) for f, r in zip(fits, by_length, strict=True)])
    judged = judged.withColumn("rule", pick(lambda r: r[1] + r[2])).withColumn("own", pick(lambda r: r[0]))
    links = cut(page_links(pages)) if links is None else links
    parts = connected_components(links, "a", "b")
    parts = parts.select(F.col("node").alias("alias"), "component")
    blocked = judged.where("own = 'block' and alias is not null").select("alias")
    if {"host", "path"} <= set(links.columns):
        blocked = blocked.union(links.where((pick(lambda r: r[0]) == "block") & F.col("b").isNotNull()).select("b"))
    blocked = blocked.distinct().join(parts, "alias", "left")
    blocked = blocked.select(F.coalesce("component", "alias").alias("component")).distinct().withColumn("blocked", F.lit(True))
    rows = judged.join(parts, "alias", "left").withColumn("component", F.coalesce("component", "alias")).join(blocked, "component", "left")
    verdict = F.coalesce("own", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias", "component")
