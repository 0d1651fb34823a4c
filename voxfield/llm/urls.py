"""URL filter with redirect equivalence.

Every url gets the verdict of its longest fitting rule. Urls that redirect to each other or name each other as canonical are
aliases: connected components over these links carry a block to every alias. An explicit allow of a url itself has
precedence over a block that its aliases bring. Urls that nothing blocks are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.llm.components import components

#: Rules become one expression; a longer list would have to be joined instead.
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUOTED = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for a null url or one without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path(rest: Column) -> Column:
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def key(rest: Column) -> Column:
    """Identity of a url among links: host, path and query, without scheme and fragment; null for an empty host."""
    name = host(rest)
    return F.when(name != "", F.concat(name, F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)))


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Of two equally long ones an allow comes first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    cases = []
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        cases.append(F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(what).alias("verdict"))))
    return F.coalesce(*cases, F.lit(None).cast("struct<rule:string,verdict:string>"))


def _attribute(tag: Column, name: str) -> Column:
    pattern = r"(?is)\s" + name + QUOTED
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): keys of each page's url and of the url that it redirects to or names as canonical."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    rows = pages.where("url IS NOT NULL AND html RLIKE '(?i)canonical|http-equiv'").select("url", F.explode(tags).alias("tag"))
    canonical = F.when(F.lower(_attribute("tag", "rel")) == "canonical", _attribute("tag", "href"))
    content = F.when(F.lower(_attribute("tag", "http-equiv")) == "refresh", _attribute("tag", "content"))
    refresh = F.regexp_extract(content, r"(?is);\s*url\s*=\s*['\"]?([^'\"]+)", 1)
    rows = rows.select("url", F.trim(F.coalesce(canonical, refresh)).alias("to"))
    scheme = F.substring_index("url", "://", 1)

    def resolved(to: Column, rest: Column) -> Column:
        site = F.concat(scheme, F.lit("://"), host(rest))
        folder = F.concat(site, F.regexp_replace(path(rest), "^$|[^/]*$", ""))
        return (
            F.when(to.contains("://"), to)
            .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
            .when(to.startswith("/"), F.concat(site, to))
            .otherwise(F.concat(folder, F.when(folder.endswith("/") & (folder != F.concat(scheme, F.lit("://"))), "").otherwise("/"), to))
        )

    own = after_scheme(F.col("url"))
    other = let(own, lambda rest: let(F.col("to"), lambda to: let(resolved(to, rest), lambda t: let(after_scheme(t), key))))
    return rows.select(let(own, key).alias("a"), F.when(F.col("to") != "", other).alias("b"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], links: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias): verdict of every page's url.

    ``rules`` are (``allow`` or ``block``, ``host/path``) pairs: a rule fits its host and all subdomains if the url's path begins with the rule's. ``links``
    (a, b: urls that redirect to or are canonical for each other) default to those found in ``html``. ``alias`` is the
    smallest key of the url's component, null for a url without links.

    One row per input row; repeated rows repeat. A null url, or one without ``://``, has an empty host and path, fits no
    rule, has no aliases and is allowed. A null html has no links. An empty table gives an empty result. Other columns
    are not read.
    """
    rest = after_scheme(F.col("url"))
    rows = pages.select("page_id", host(rest).alias("host"), path(rest).alias("path"), key(rest).alias("key"))
    rows = rows.withColumn("own", fitting(F.col("host"), F.col("path"), rules))
    if links is None:
        edges = page_links(pages)
    else:
        edges = links.select(key(after_scheme(F.col("a"))).alias("a"), key(after_scheme(F.col("b"))).alias("b"))
    nodes = components(edges)
    parsed = nodes.select("component", host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
    judged = parsed.select("component", fitting(F.col("host"), F.col("path"), rules).alias("own"))
    blocked = judged.groupBy("component").agg(F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"))
    aliases = nodes.join(blocked, "component").select(F.col("node").alias("key"), F.col("component").alias("alias"), "blocked")
    brought = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(aliases, "key", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), brought).alias("verdict"), "alias"
    )
