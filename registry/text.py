"""Text search on the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake import corpora as C
from codelake.functions.skew import first_rows
from codelake.operators import search as S
from registry.common import Registry, big, joined, with_ctes
from registry.files import _LINES, DOCS, docs

R_ = Registry()
add = R_.add

# Matches of a literal per line by cutting the line at it; no regex involved.
_HITS = """select root, path, doc_id, line, text, cast(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + (i - 1) * length('{q}') as bigint) as col,
  substr(text, cast(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))) + (i - 1) * length('{q}') as bigint) + 1, length('{q}')) as match
  from (select *, unnest(range(1, len(p))) as i from (select *, string_split({t}, '{q}') as p from lines))"""


def hits(q: str, fold: bool = True) -> str:
    return _HITS.replace("{q}", q.lower() if fold else q).replace("{t}", "lower(text)" if fold else "text")


def sq(body: str, q: str = "Th", fold: bool = True) -> str:
    return with_ctes(body, d=DOCS, lines=_LINES, m=hits(q, fold))


def shape(df):
    return df.select("path", big("line").alias("line"), big("column").alias("col"), "match")


@add("search_text", sq("select path, cast(line as bigint) as line, col, match from m"))
def _(spark, sf):
    return shape(S.search_text(docs(spark, sf), "Th"))


# Words by cutting each line at non-word characters; columns from running lengths.
_WORDS = """select root, path, doc_id, line, text, w, cast(pos as bigint) as col from (
  select root, path, doc_id, line, text, unnest(ws) as w, unnest(ps) as pos from (
    select *, list_transform(range(1, len(raw) + 1), lambda i: list_sum(list_transform(list_slice(raw, 1, i), lambda x: length(x))) - length(raw[i])) as ps, raw as ws from (
      select *, regexp_extract_all(text, '[\\pL\\pM\\pN_\\x{200c}\\x{200d}\\x{203f}\\x{2040}]+|[^\\pL\\pM\\pN_\\x{200c}\\x{200d}\\x{203f}\\x{2040}]+') as raw from lines)))
  where regexp_matches(w, '^[\\pL\\pM\\pN_]')"""


def wq(body: str) -> str:
    return with_ctes(body, d=DOCS, lines=_LINES, w=_WORDS)


@add("search_regex", wq("select path, cast(line as bigint) as line, col, w as match from w where regexp_matches(w, '^[tT][a-zA-Z]*[eE]$') and regexp_matches(w, '^[a-zA-Z]+$')"))
def _(spark, sf):
    return shape(S.search_regex(docs(spark, sf), r"\bt[a-z]*e\b"))


_NAMES = "select distinct regexp_extract(p_name, '^[a-z]+') as name from part union select 'the' union select 'un' union select 'Et'"


def names(spark, sf):
    p = C.table(spark, sf, "part").select(F.regexp_extract("p_name", "^[a-z]+", 0).alias("name"))
    more = spark.createDataFrame([("the",), ("un",), ("Et",)], "name string")
    return p.unionByName(more).distinct()


@add("find_references_text", wq(f"select name, path, cast(line as bigint) as line, col, w as match from w join ({_NAMES}) n on w.w = n.name"))
def _(spark, sf):
    found = S.find_references_text(docs(spark, sf), names(spark, sf))
    return found.select("name", "path", big("line").alias("line"), big("column").alias("col"), "match")


@add("search_symbol_dotted", """select 'src/' || reg || '/Customer' || ks || '.cs' as path, 2::bigint as line, 6::bigint as col, 'Shop.' || reg as name from
    (select c_custkey as k, cast(c_custkey as varchar) as ks, replace(r_name, ' ', '_') as reg from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey) where k % 3 <> 0
  union all select 'src/' || replace(r_name, ' ', '_') || '/Account.cs', 1, 10, 'Shop.' || replace(r_name, ' ', '_') from {region}""")
def _(spark, sf):
    regions = C.table(spark, sf, "region").select(F.concat(F.lit("Shop."), F.replace("r_name", F.lit(" "), F.lit("_"))).alias("name"))
    found = S.search_symbol(C.corpus(spark, sf, C.SOURCE_CS), regions)
    return found.select("path", big("line").alias("line"), big("column").alias("col"), "name")


@add("search_symbol", """select 'class' as kind, 'src/' || reg || '/Customer' || ks || '.cs' as path, 6::bigint as line, 11::bigint as col, 'Customer' || ks as name from
    (select cast(c_custkey as varchar) as ks, replace(r_name, ' ', '_') as reg from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey)
  union all select 'method', 'src/' || reg || '/Customer' || ks || '.cs', 10, 15, 'Customer' || ks from
    (select cast(c_custkey as varchar) as ks, replace(r_name, ' ', '_') as reg from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey)""")
def _(spark, sf):
    f = C.corpus(spark, sf, C.SOURCE_CS)
    wanted = C.table(spark, sf, "customer").select(
        F.concat(F.lit("Customer"), F.col("c_custkey").cast("string")).alias("name")
    )
    out = None
    for kind in ("class", "method"):
        part = S.search_symbol(f, wanted, kind).select(
            F.lit(kind).alias("kind"), "path", big("line").alias("line"), big("column").alias("col"), "name"
        )
        out = part if out is None else out.unionByName(part)
    return out


@add("context_lines", sq("""select m.path, cast(m.line as bigint) as line, col,
  coalesce((select string_agg(text, '|' order by line) from lines x where x.root = m.root and x.path = m.path and x.line between m.line - 2 and m.line - 1), '') as context_before,
  coalesce((select string_agg(text, '|' order by line) from lines x where x.root = m.root and x.path = m.path and x.line = m.line + 1), '') as context_after
  from m""", "zz"))
def _(spark, sf):
    f = docs(spark, sf)
    found = S.context_lines(S.search_text(f, "zz"), f, 2, 1)
    return found.select(
        "path", big("line").alias("line"), big("column").alias("col"),
        joined("context_before").alias("context_before"), joined("context_after").alias("context_after"),
    )


@add("group_matches", sq("""select path, count(*)::bigint as match_count,
  string_agg(cast(line as varchar) || ':' || cast(col as varchar), '|' order by line, col) as places from m group by root, path""", "ou"))
def _(spark, sf):
    g = S.group_matches(S.search_text(docs(spark, sf), "ou"))
    places = F.transform(
        "matches", lambda m: F.concat_ws(":", m["line"].cast("string"), m["column"].cast("string"))
    )
    return g.select("path", "match_count", joined(places).alias("places"))


@add("search_totals", sq("""select count(*)::bigint as total_matches, count(distinct root || path)::bigint as files_with_matches, count(*) > 200 as truncated from m""", "an", False))
def _(spark, sf):
    return S.search_totals(S.search_text(docs(spark, sf), "an", ignore_case=False))


@add("cap_per_file", sq("""select path, cast(line as bigint) as line, col, match from (select *, row_number() over (partition by root, path order by line, col) as rn from m) where rn <= 3""", "er"))
def _(spark, sf):
    return shape(S.cap_per_file(S.search_text(docs(spark, sf), "er"), 3))


@add("grep", sq("""select root, path, cast(line as bigint) as line, case when col > 0 then col end as column_start from (
    select *, row_number() over (partition by root, path order by line, col) as rn from m
    where starts_with(path, 'en/') and not contains(path, '/bin/') and doc_id % 8 in (0, 1, 2)) where rn <= 2
  order by root, path, line, col limit 50""", "th"))
def _(spark, sf):
    found = S.grep(
        docs(spark, sf), "th", path_prefix="en", include=["*.py", "*.cs", "*.md"], exclude=["*/bin/*"],
        max_results=50, max_per_file=2,
    )
    return found.select(
        "root", "path", big("line").alias("line"), big("column_start").alias("column_start")
    )


@add("search_extension_scope", sq("""select path, count(*)::bigint as n from m where starts_with(path, 'en/bin/') and doc_id % 8 in (1, 5) group by root, path""", "an"))
def _(spark, sf):
    scoped = S.search_extension_scope(docs(spark, sf), "/en/bin", ["cs", ".JS"])
    return S.search_text(scoped, "an").groupBy("root", "path").agg(F.count("*").alias("n")).drop("root")
