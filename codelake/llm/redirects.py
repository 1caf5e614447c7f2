"""URL filters that follow redirects and canonical links.

Rules allow or block a host with all its subdomains and the paths that start
with theirs; of the rules that fit a url the longest wins (of equally long ones
an allowing one, then that of the longer host). Pages whose addresses are linked
by a redirect (``<meta http-equiv="refresh">``, or a table of redirects) or by
``<link rel="canonical">`` are aliases: connected components over these links,
seen or unseen pages alike, spread the decision of every blocked address to all
of its aliases. A url that a rule fits keeps that rule's verdict, so an explicit
allow stands whatever its aliases are; all others are blocked if an alias is,
and allowed if none is.

All of it is DataFrame work. Every text is read once and leaves its links in the
shared folder. A rule is found by equality of a host suffix and a path prefix,
for no more suffixes and prefixes than rules have lengths, so a host with many
rules or many pages multiplies nothing; pages, addresses and labels meet tables
of one row per key in joins that salt hot keys.

An address is a url without its fragment, with scheme and host in lower case.
Links are resolved against the url (dot segments are kept as they are) and
``&amp;`` in them is read as ``&``; tags in comments do not count. A null url, or
one without ``://``, has an empty host and path and no rule; such a page follows
the least address that it links to. Null and empty html has no links. Every page
row gives a row, repeated ones too; an empty table gives an empty one. Other
columns than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.functions.skew import lookup_join
from codelake.functions.storage import Stored
from codelake.llm.components import components
from codelake.llm.spread import plain

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPACE = r"\x09-\x0D "
COMMENT = r"(?s)<!--.*?-->"
#: A page without this has no links to follow.
SIGN = "[Cc][Aa][Nn][Oo][Nn][Ii][Cc][Aa][Ll]|[Rr][Ee][Ff][Rr][Ee][Ss][Hh]"
TAG = f"<(?:[Ll][Ii][Nn][Kk]|[Mm][Ee][Tt][Aa])[{SPACE}/][^>]*>"
LINK = f"^<[Ll][Ii][Nn][Kk][{SPACE}/]"
AIM = f"^[{SPACE}]*[0-9.]*[{SPACE}]*[;,][{SPACE}]*[Uu][Rr][Ll][{SPACE}]*=[{SPACE}]*['\"]?([^'\"{SPACE}]+)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def attribute_pattern(name: str) -> str:
    """The value of an attribute, with its quotes, as the first group."""
    letters = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)
    return f"[{SPACE}/\"']{letters}[{SPACE}]*=[{SPACE}]*(\"[^\"]*\"|'[^']*'|[^{SPACE}>\"']+)"


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_replace(F.regexp_extract(tag, attribute_pattern(name), 1), "^[\"']|[\"']$", "")


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _cut(text: Column, *marks: str) -> Column:
    for mark in marks:
        text = F.substring_index(text, mark, 1)
    return text


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(_cut(_rest(url), "/", "?", "#")), F.lit(""))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    return F.coalesce(F.substring(_cut(rest, "?", "#"), F.length(_cut(rest, "/", "?", "#")) + 1, F.length(url)), F.lit(""))


def address(url: Column) -> Column:
    """The url without its fragment, scheme and host in lower case; null where it has no ``://``."""
    rest = _cut(_rest(url), "#")
    host = _cut(rest, "/", "?")
    return F.concat(_lower(F.substring_index(url, "://", 1)), F.lit("://"), _lower(host), F.substring(rest, F.length(host) + 1, F.length(url)))


def resolved(link: Column, base: Column) -> Column:
    """The address that a link in the page at ``base`` means; null if it means none or the page itself."""
    link = F.replace(F.regexp_replace(link, f"^[{SPACE}]+|[{SPACE}]+$", ""), F.lit("&amp;"), F.lit("&"))
    scheme = F.substring_index(base, "://", 1)
    here = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    whole = (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(SCHEME), F.when(link.contains("://"), link))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(here, link))
        .when(link.startswith("?"), F.concat(here, path_of(base), link))
        .otherwise(F.concat(here, F.when(folder == "", "/").otherwise(folder), link))
    )
    return address(whole)


def links(html: Column, base: Column) -> Column:
    """Addresses that a page names as its canonical one or redirects to."""

    def target(tag: Column) -> Column:
        canonical = F.array_contains(F.split(_lower(_attribute(tag, "rel")), f"[{SPACE}]+"), "canonical")
        refresh = F.trim(_lower(_attribute(tag, "http-equiv"))) == "refresh"
        link = F.when(tag.rlike(LINK), F.when(canonical, _attribute(tag, "href"))).otherwise(
            F.when(refresh, F.regexp_extract(_attribute(tag, "content"), AIM, 1))
        )
        return resolved(link, base)

    tags = F.regexp_extract_all(F.regexp_replace(html, COMMENT, ""), F.lit(TAG), F.lit(0))
    found = F.filter(F.transform(tags, target), lambda x: x.isNotNull())
    return F.when(html.rlike(SIGN), found).otherwise(F.array().cast("array<string>"))


def rule_table(rules: DataFrame) -> DataFrame:
    """One row per host and path of ``rules(host, path, verdict)``; where both verdicts are given, the allowing one."""
    host = _lower(F.coalesce(F.col("host"), F.lit("")))
    return (
        rules.select(host.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict"))
        .groupBy("rule_host", "rule_path")
        .agg(F.max(F.col("verdict") == ALLOW).alias("allowed"))
    )


def judged(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule, if any, that fits each address of a table with distinct ``node``: ``node``, ``rule``, ``allowed``."""
    known = rule_table(rules)
    labels = F.length("rule_host") - F.length(F.replace("rule_host", F.lit("."))) + 1
    most = known.agg(F.max(labels)).first()[0] or 0
    hosts = known.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    places = addresses.select("node", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    count = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    suffixes = places.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(count, F.lit(max(most, 1))))))
    suffixes = suffixes.withColumn("rule_host", F.expr("substring_index(host, '.', -k)"))
    prefixes = lookup_join(suffixes, hosts, ["rule_host"], "inner").withColumn("l", F.explode("lengths")).where("l <= length(path)")
    prefixes = prefixes.select("node", "rule_host", F.expr("substring(path, 1, l)").alias("rule_path"))
    fitting = lookup_join(prefixes, known, ["rule_host", "rule_path"], "inner")
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("size"), F.col("allowed"), F.length("rule_host").alias("host_size"), rule.alias("rule")))
    return fitting.groupBy("node").agg(best.alias("best")).select("node", "best.rule", "best.allowed")


def url_verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Per page row: ``page_id``, ``host``, ``path``, the ``rule`` that fits its url, and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block), and
    ``redirects`` urls ``source`` and ``target``.
    """
    store = Stored(pages.sparkSession)
    url = F.col("url").cast("string")
    read = plain(pages, "page_id", "url", "html").select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("own"),
        links(F.col("html").cast("string"), url).alias("targets"),
    )
    rows = store.table(read.withColumn("node", F.coalesce("own", F.array_min("targets"))), "addresses")
    found = rows.where(F.size("targets") > 0).select(F.col("node").alias("a"), F.explode("targets").alias("b"))
    if redirects is not None:
        found = found.unionByName(plain(redirects, "source", "target").select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")))
    edges = store.table(found.where("a is not null and b is not null and a <> b").distinct(), "edges")
    nodes = rows.select("node").unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")))
    fits = store.table(judged(nodes.where("node is not null").distinct(), rules), "judged")
    members = store.table(components(edges, store), "members")
    blocked = fits.where(~F.col("allowed")).select("node")
    # A component with a blocked address: one row per label.
    spread = members.join(blocked, "node").select("label").distinct().withColumn("spread", F.lit(True))
    aliases = lookup_join(members, spread, ["label"], "inner").select("node", "spread")
    verdicts = fits.join(aliases, "node", "full").select("node", "rule", "allowed", (F.coalesce("spread", F.lit(False)) | F.coalesce(~F.col("allowed"), F.lit(False))).alias("blocked"))
    joined = lookup_join(rows, store.table(verdicts, "verdicts"), ["node"], "left")
    ruled = F.col("own").isNotNull() & F.col("rule").isNotNull()
    verdict = F.when(ruled, F.when(F.col("allowed"), ALLOW).otherwise(BLOCK)).when(F.col("blocked"), BLOCK).otherwise(ALLOW)
    return joined.select("page_id", "host", "path", F.when(ruled, F.col("rule")).alias("rule"), verdict.alias("verdict"))
