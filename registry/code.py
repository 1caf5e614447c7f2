"""Extraction, symbols, references, dependencies and trees on the source corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake import corpora as C
from codelake.operators import deps as D
from codelake.operators import extract_cs as CS
from codelake.operators import extract_py as PY
from codelake.operators import resolve as R
from codelake.operators import symbols as S
from codelake.operators import trees as T
from codelake.operators.inventory import list_files
from codelake.operators.manifests import parse_diagnostics
from codelake.operators.paging import paginate
from codelake.plans import index as I
from registry.common import Registry, big, end, index_of, joined, start
from registry.expected import EXPECT_WIDE_DIAGNOSTICS, EXPECT_WIDE_HINTS, EXPECT_WIDE_NODES, HARD, METHOD, expect

R_ = Registry()
add = R_.add


def py(spark, sf):
    return C.corpus(spark, sf, C.SOURCE_PY)


def cs(spark, sf):
    return C.corpus(spark, sf, C.SOURCE_CS)


# ---- extraction -------------------------------------------------------------

_NODE_SQL = """select path, kind, subkind, name, display_name, qualified_path,
  cast(start_line as bigint) as start_line, cast(end_line as bigint) as end_line,
  cast(depth as bigint) as depth, has_children"""


@add("py_declarations", expect(f"""{_NODE_SQL},
  case when name = 'load' then 'async' else '' end as modifiers,
  case when kind = 'Declaration' then 75 else 80 end::bigint as confidence_pct from py_nodes"""))
def _(spark, sf):
    df = PY.py_declarations(py(spark, sf))
    return df.select(
        "path", "kind", "subkind", "name", "display_name", "qualified_path",
        start(), end(), big("depth").alias("depth"), "has_children",
        joined("modifiers").alias("modifiers"),
        F.round(F.col("confidence") * 100).cast("bigint").alias("confidence_pct"),
    )


@add("py_block_span", expect("""select path, qualified_path, cast(start_line as bigint) as start_line,
  cast(end_line as bigint) as end_line from py_nodes"""))
def _(spark, sf):
    return PY.py_block_span(py(spark, sf)).select(
        "path", "qualified_path", big("start_line").alias("start_line"), big("end_line").alias("end_line")
    )


def _imports(df):
    return df.select("path", "kind", "raw_text", "target", "alias", big("span.start_line").alias("line"))


@add("py_imports", expect("""select path, kind, raw_text, target, alias, cast(line as bigint) as line
  from imports where root = 'py_repo'"""))
def _(spark, sf):
    return _imports(PY.py_imports(py(spark, sf)))


@add("cs_imports", expect("""select path, kind, raw_text, target, alias, cast(line as bigint) as line
  from imports where root = 'cs_repo'"""))
def _(spark, sf):
    return _imports(CS.cs_imports(cs(spark, sf)))


@add("cs_declarations", expect(f"""{_NODE_SQL},
  case when kind = 'Container' then null when name = 'tags' then 'private' else 'public' end as visibility
  from cs_nodes"""))
def _(spark, sf):
    df = CS.cs_declarations(cs(spark, sf))
    return df.select(
        "path", "kind", "subkind", "name", "display_name", "qualified_path",
        start(), end(), big("depth").alias("depth"), "has_children", "visibility",
    )


def _hints(df):
    return df.select(
        "path", "source_path", "kind", "target_name", "evidence", big("span.start_line").alias("line")
    )


_HINT_SQL = """select path, source_path, kind, target_name, evidence, cast(line as bigint) as line"""


@add("py_base_hints", expect(f"{_HINT_SQL} from py_hints"))
def _(spark, sf):
    return _hints(PY.py_base_hints(py(spark, sf)))


for _name, _fn, _kinds in (
    ("cs_base_hints", CS.cs_base_hints, "'Inherits'"),
    ("cs_field_hints", CS.cs_field_hints, "'ContainsFieldOfType'"),
    ("cs_property_hints", CS.cs_property_hints, "'ContainsPropertyOfType'"),
    ("cs_method_hints", CS.cs_method_hints, "'ReturnsType'"),
    ("cs_ctor_hints", CS.cs_ctor_hints, "'AcceptsParameterType'"),
    ("cs_creation_hints", CS.cs_creation_hints, "'CreatesInstanceOf'"),
    ("cs_attribute_hints", CS.cs_attribute_hints, "'UsesAttributeOrAnnotation'"),
):
    add(_name, expect(f"{_HINT_SQL} from cs_hints where kind = {_kinds}"))(
        lambda spark, sf, fn=_fn: _hints(fn(cs(spark, sf)))
    )


def wide(spark, sf):
    return C.corpus(spark, sf, C.SOURCE_CS_WIDE)


@add("cs_declarations_wide", EXPECT_WIDE_NODES)
def _(spark, sf):
    return CS.cs_declarations(wide(spark, sf)).select(
        "path", "kind", "subkind", "name", "display_name", "qualified_path", start(), end(),
        big("depth").alias("depth"), "has_children", F.array_join("modifiers", " ").alias("modifiers"),
    )


@add("cs_hints_wide", EXPECT_WIDE_HINTS)
def _(spark, sf):
    return _hints(CS.cs_hints(wide(spark, sf)))


@add("parse_diagnostics_wide", EXPECT_WIDE_DIAGNOSTICS)
def _(spark, sf):
    files = wide(spark, sf).withColumn("language", F.lit("csharp"))
    return parse_diagnostics(files).select("path", "code", "severity")


# ---- symbols ----------------------------------------------------------------

_SYMBOL_SQL = """select root, symbol_id, name, qualified_path as qualified_name, symbol_kind as kind,
  language, path as primary_path, parent_symbol_id,
  regexp_replace(substr(qualified_path, 1, greatest(length(qualified_path) - length(string_split(qualified_path, '.')[-1]) - 1, 0)), '[.]', '|', 'g') as container_path,
  cast(1 + case when has_children then 32 else 0 end as bigint) as flags"""


def _symbols(df):
    return df.select(
        "root", "symbol_id", "name", "qualified_name", "kind", "language", "primary_path",
        "parent_symbol_id", joined("container_path").alias("container_path"),
        big("flags").alias("flags"),
    )


@add("project_symbols", expect(f"{_SYMBOL_SQL} from symbols"))
def _(spark, sf):
    return _symbols(S.project_symbols(index_of(spark, sf)["nodes"]))


@add("py_project_symbols", expect(f"{_SYMBOL_SQL} from symbols where root = 'py_repo'"))
def _(spark, sf):
    return _symbols(S.py_project_symbols(index_of(spark, sf)["nodes"]))


@add("symbol_id", expect("""select symbol_id,
  case root when 'py_repo' then 'py-repo|python|' else 'cs-repo|csharp|' end || category || '|' || qualified_path
    as symbol_key from symbols"""))
def _(spark, sf):
    return index_of(spark, sf)["symbols"].select("symbol_id", "symbol_key")


@add("repo_scope", """select c_name as root, 'customer-' || lpad(cast(c_custkey as varchar), 9, '0') as scope
  from customer union all select 'C:\\src\\' || c_mktsegment || '/', lower(c_mktsegment) from customer
  union all select '/a/--' || c_mktsegment || '.Net_', lower(c_mktsegment) || '-net' from customer""")
def _(spark, sf):
    c = C.table(spark, sf, "customer")
    roots = c.select(
        F.explode(
            F.array(
                F.col("c_name"),
                F.concat(F.lit("C:\\src\\"), F.col("c_mktsegment"), F.lit("/")),
                F.concat(F.lit("/a/--"), F.col("c_mktsegment"), F.lit(".Net_")),
            )
        ).alias("root")
    )
    return roots.select("root", S.repo_scope("root").alias("scope"))


@add("kind_category", expect("select symbol_kind as kind, category, count(*)::bigint as n from symbols group by 1, 2"))
def _(spark, sf):
    return (
        index_of(spark, sf)["symbols"]
        .groupBy("kind", S.kind_category("kind").alias("category"))
        .agg(F.count("*").alias("n"))
    )


@add("generic_params", """select p_partkey, p_type || '|' || p_brand as params from part
  where p_partkey % 2 = 0 union all select p_partkey, '' from part where p_partkey % 2 = 1""")
def _(spark, sf):
    p = C.table(spark, sf, "part")
    display = F.when(
        F.col("p_partkey") % 2 == 0,
        F.concat(F.lit("Map<"), F.col("p_type"), F.lit(" ,, "), F.col("p_brand"), F.lit("> x")),
    ).otherwise(F.concat(F.lit("Plain>"), F.col("p_type"), F.lit("<")))
    return p.select("p_partkey", joined(S.generic_params(display)).alias("params"))


@add("symbol_occurrences", expect("""select root, prefix || ':' || category || ':' || qualified_path as symbol_id,
  prefix || ':' || category || ':' || qualified_path || '::occ::' || md5(file_key) || '::' ||
  cast(start_line as varchar) || '-' || case root when 'py_repo' then ''
    else cast(case when depth = 0 then 1 when depth = 1 then 5 else 9 end as varchar) end || '::Declaration'
  as occurrence_id, path, 'Declaration' as role, cast(start_line as bigint) as start_line from nodes"""))
def _(spark, sf):
    return S.symbol_occurrences(index_of(spark, sf)["nodes"]).select(
        "root", "symbol_id", "occurrence_id", "path", "role", start()
    )


@add("find_symbols", expect("""select 'exact' as mode, symbol_id from symbols where lower(name) = 'total'
  union all select 'prefix', symbol_id from symbols where starts_with(lower(name), 'customer1')
     or starts_with(lower(qualified_path), 'customer1')
  union all select 'contains', symbol_id from symbols where contains(lower(qualified_path), 'base.d')"""))
def _(spark, sf):
    s = index_of(spark, sf)["symbols"]
    out = None
    for mode, q in (("exact", "TOTAL"), ("prefix", "Customer1"), ("contains", "base.D")):
        part = S.find_symbols(s, q, mode).select(F.lit(mode).alias("mode"), "symbol_id")
        out = part if out is None else out.unionByName(part)
    return out


@add("filter_symbols", expect("""select symbol_id from symbols where language = 'csharp'
  and symbol_kind in ('Class', 'Method') and (starts_with(qualified_path, 'App.') or starts_with(qualified_path, 'Shop.ASIA'))"""))
def _(spark, sf):
    return S.filter_symbols(
        index_of(spark, sf)["symbols"], ["CSharp"], ["Class", "Method"], ["app", "Shop.Asia"]
    ).select("symbol_id")


@add("primary_locations", expect("""select symbol_id, path as file_path, cast(start_line as bigint) as start_line,
  true as is_primary from symbols"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return S.primary_locations(t["symbols"], t["occurrences"]).select(
        "symbol_id", "file_path", start("occurrence_span"), "is_primary"
    )


@add("resolve_locations", expect("""select symbol_id, 'symbolId' as resolved_by, path as file_path,
  cast(start_line as bigint) as start_line, cast(null as varchar) as error from symbols
  union all select 'no:' || symbol_id, 'symbolId', null, null, 'Symbol or occurrence not found.' from symbols"""))
def _(spark, sf):
    t = index_of(spark, sf)
    s = t["symbols"]
    none = F.lit(None).cast("string").alias("occurrence_id")
    requests = s.select("root", "symbol_id", none).unionByName(
        s.select("root", F.concat(F.lit("no:"), "symbol_id").alias("symbol_id"), none)
    )
    return S.resolve_locations(requests, s, t["occurrences"]).select(
        "symbol_id", "resolved_by", "file_path", start(), "error"
    )


@add("symbol_occurrence_list", expect("""select symbol_id, n.path, cast(n.start_line as bigint) as start_line
  from symbols s join nodes n on s.root = n.root and s.qualified_path = n.qualified_path and s.category = n.category
  where s.symbol_kind in ('Namespace', 'Class')"""))
def _(spark, sf):
    t = index_of(spark, sf)
    wanted = t["symbols"].filter(F.col("kind").isin("Namespace", "Class"))
    return S.symbol_occurrence_list(wanted, t["occurrences"], ["Declaration"]).select(
        "symbol_id", "path", start()
    )


@add("symbol_children", expect("""select parent_symbol_id, symbol_id from symbols
  where parent_symbol_id is not null and symbol_kind not in ('Class')"""))
def _(spark, sf):
    return S.symbol_children(index_of(spark, sf)["symbols"], nested_types=False).select(
        "parent_symbol_id", "symbol_id"
    )


@add("type_members", expect("""select parent_symbol_id, symbol_id,
  case symbol_kind when 'Constructor' then 'constructors' when 'Method' then 'methods'
    when 'Property' then 'properties' when 'Field' then 'fields' else 'nested_types' end as section
  from symbols where parent_symbol_id like '%:type:%' and symbol_kind <> 'Namespace'"""))
def _(spark, sf):
    return S.type_members(index_of(spark, sf)["symbols"]).select(
        "parent_symbol_id", "symbol_id", "section"
    )


@add("members_summary", expect("""select s.symbol_id,
  count(*) filter (c.symbol_kind = 'Constructor')::bigint as constructors,
  count(*) filter (c.symbol_kind = 'Method')::bigint as methods,
  count(*) filter (c.symbol_kind = 'Property')::bigint as properties,
  count(*) filter (c.symbol_kind = 'Field')::bigint as fields,
  0::bigint as events,
  count(*) filter (c.symbol_kind = 'Class')::bigint as nested_types
  from symbols s left join symbols c on s.symbol_id = c.parent_symbol_id
  where s.symbol_kind = 'Class' group by 1"""))
def _(spark, sf):
    return S.members_summary(index_of(spark, sf)["symbols"]).drop("root", "qualified_name", "kind")


@add("occurrence_counts", expect("""select prefix || ':' || category || ':' || qualified_path as symbol_id,
  count(*)::bigint as occurrence_count from nodes group by 1"""))
def _(spark, sf):
    return S.occurrence_counts(index_of(spark, sf)["occurrences"]).drop("root")


@add("container_counts", expect("""select root, lower(substr(qualified_path, 1,
    length(qualified_path) - length(string_split(qualified_path, '.')[-1]) - 1)) as container_key,
  count(*)::bigint as symbol_count, count(distinct path)::bigint as file_count
  from symbols where contains(qualified_path, '.') group by 1, 2"""))
def _(spark, sf):
    return S.container_counts(index_of(spark, sf)["symbols"])


@add("name_index", expect("""select root, lower(name) as name_key, count(*)::bigint as candidate_count,
  case when count(*) = 1 then min(symbol_id) end as only_symbol_id from symbols group by 1, 2"""))
def _(spark, sf):
    return S.name_index(index_of(spark, sf)["symbols"])


@add("qualified_index", expect("""select root, lower(qualified_path) as qualified_key,
  max(symbol_id) as symbol_id from symbols group by 1, 2"""))
def _(spark, sf):
    return S.qualified_index(index_of(spark, sf)["symbols"])


# ---- resolution -------------------------------------------------------------

_EDGE_SQL = """select path, cast(hint_no as bigint) as hint_no, source_symbol_id, target_symbol_id, kind,
  resolution, evidence, cast(line as bigint) as line, cast(round(confidence * 100) as bigint) as confidence_pct,
  language"""


def _edges(df):
    return df.select(
        "path", big("hint_no").alias("hint_no"), "source_symbol_id", "target_symbol_id", "kind",
        "resolution", "evidence", big("span.start_line").alias("line"),
        F.round(F.col("confidence") * 100).cast("bigint").alias("confidence_pct"), "language",
    )


@add("resolve_references", expect(f"{_EDGE_SQL} from edges"))
def _(spark, sf):
    t = index_of(spark, sf)
    return _edges(R.resolve_references(t["hints"], t["symbols"], t["imports"]))


@add("resolve_sources", expect("""select path, cast(hint_no as bigint) as hint_no, source_symbol_id,
  85::bigint as base_pct from edges"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return R.resolve_sources(t["hints"], t["symbols"]).select(
        "path", big("hint_no").alias("hint_no"), "source_symbol_id",
        F.round(F.col("base_confidence") * 100).cast("bigint").alias("base_pct"),
    )


@add("resolve_via_imports", expect("""select md5('cs_repo/' || path) as file_id, 'account' as target_key,
  'csharp:cs-repo:type:Shop.' || reg || '.Account' as import_id from cc where k % 3 <> 0"""))
def _(spark, sf):
    t = index_of(spark, sf)
    wanted = t["hints"].select("root", "file_id", F.lower("target_name").alias("target_key")).distinct()
    return R.resolve_via_imports(wanted, t["imports"], t["symbols"]).drop("root")


@add("external_types", expect(f"{_HINT_SQL} from cs_hints where target_name = 'List'"))
def _(spark, sf):
    return _hints(R.external_types(index_of(spark, sf)["hints"]))


@add("file_imports", expect("""select upper(path) as requested_path, kind, target, cast(line as bigint) as line from imports"""))
def _(spark, sf):
    t = index_of(spark, sf)
    wanted = t["files"].select("root", F.upper(F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"))
    return D.file_imports(wanted, t["imports"]).select(
        F.replace("requested_path", F.lit("\\"), F.lit("/")).alias("requested_path"),
        "kind", "target", big("span.start_line").alias("line"),
    )


_REF_METHOD = f"case when target_symbol_id is null then 'ambiguous' else {METHOD} end"


@add("references_out", expect(f"""select source_symbol_id as symbol_id, target_symbol_id, kind, resolution,
  {_REF_METHOD} as method from edges where kind in ('Inherits', 'CreatesInstanceOf', 'ContainsFieldOfType')"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.references_out(
        t["edges"], t["symbols"], ["Inherits", "CreatesInstanceOf", "ContainsFieldOfType"]
    ).select("symbol_id", "target_symbol_id", "kind", "resolution", "method")


@add("references_in", expect(f"""select target_symbol_id as symbol_id, source_symbol_id, kind, resolution,
  {_REF_METHOD} as method from edges where target_symbol_id is not null"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.references_in(t["edges"], t["symbols"]).select(
        "symbol_id", "source_symbol_id", "kind", "resolution", "method"
    )


@add("union_references", expect("""select source_symbol_id as symbol_id, 'out' as direction, kind, path,
  cast(hint_no as bigint) as hint_no from edges
  union all select target_symbol_id, 'in', kind, path, cast(hint_no as bigint) from edges where target_symbol_id is not null"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.union_references(t["edges"], t["symbols"]).select(
        "symbol_id", "direction", "kind", "path", big("hint_no").alias("hint_no")
    )


@add("page_references", expect("""select symbol_id, 'out' as direction, kind, path, hint_no from (
    select source_symbol_id as symbol_id, kind, path, cast(hint_no as bigint) as hint_no,
      row_number() over (partition by source_symbol_id order by path, hint_no) as rn from edges) where rn between 3 and 4
  union all select target_symbol_id, 'in', kind, path, cast(hint_no as bigint) from edges where target_symbol_id is not null"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.page_references(t["edges"], t["symbols"], page=2, size=2).select(
        "symbol_id", "direction", "kind", "path", big("hint_no").alias("hint_no")
    )


@add("file_references", expect("""select s.path as source_path, e.kind, cast(e.hint_no as bigint) as hint_no
  from edges e join symbols s on e.source_symbol_id = s.symbol_id"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.file_references(t["edges"], t["symbols"]).select(
        "source_path", "kind", big("hint_no").alias("hint_no")
    )


@add("dependencies", expect(f"""select e.source_symbol_id as symbol_id, e.target_symbol_id, s.qualified_path as qualified_name,
  s.symbol_kind, e.kind, {METHOD} as method from edges e left join symbols s on e.target_symbol_id = s.symbol_id
  where {HARD}"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.dependencies(t["edges"], t["symbols"]).select(
        "symbol_id", "target_symbol_id", "qualified_name", "symbol_kind", "kind", "method"
    )


@add("dependents", expect(f"""select e.target_symbol_id as symbol_id, e.source_symbol_id, s.qualified_path as qualified_name,
  s.symbol_kind, e.kind, {METHOD} as method from edges e left join symbols s on e.source_symbol_id = s.symbol_id
  where {HARD}"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.dependents(t["edges"], t["symbols"]).select(
        "symbol_id", "source_symbol_id", "qualified_name", "symbol_kind", "kind", "method"
    )


@add("unknown_ids", expect("""select 'x' || symbol_id as symbol_id, 'Symbol not found: x' || symbol_id as error
  from symbols where symbol_kind = 'Method'"""))
def _(spark, sf):
    s = index_of(spark, sf)["symbols"]
    requests = s.select(
        "root",
        F.when(F.col("kind") == "Method", F.concat(F.lit("x"), "symbol_id"))
        .otherwise(F.col("symbol_id")).alias("symbol_id"),
    )
    return S.unknown_ids(requests, s).drop("root")


_FILE_DEPS_SQL = """select e.path as source_path, s.path as target_path, string_agg(distinct e.kind, '|' order by e.kind) as kinds,
  count(*)::bigint as evidence_count,
  array_to_string(list_slice(list(e.kind || '>' || e.evidence order by e.hint_no), 1, 3), '|') as examples
  from edges e join symbols s on e.target_symbol_id = s.symbol_id where e.path <> s.path group by 1, 2"""


def file_deps(spark, sf):
    t = index_of(spark, sf)
    return D.file_dependencies(t["edges"], t["symbols"])


@add("file_dependencies", expect(_FILE_DEPS_SQL))
def _(spark, sf):
    return file_deps(spark, sf).select(
        "source_path", "target_path", joined("kinds").alias("kinds"), "evidence_count",
        joined(F.transform("examples", lambda e: F.concat(e["kind"], F.lit(">"), e["evidence"]))).alias("examples"),
    )


@add("distinct_kinds", expect("select distinct root, kind from edges"))
def _(spark, sf):
    return D.distinct_kinds(index_of(spark, sf)["edges"])


@add("file_graph", expect("""select distinct 'node' as part, path as a, '' as b, 'file' as kind from (
    select e.path from edges e join symbols s on e.target_symbol_id = s.symbol_id where e.path <> s.path
    union all select s.path from edges e join symbols s on e.target_symbol_id = s.symbol_id where e.path <> s.path)
  union all select 'edge', e.path, s.path, string_agg(distinct e.kind, ', ' order by e.kind)
    from edges e join symbols s on e.target_symbol_id = s.symbol_id where e.path <> s.path group by e.path, s.path"""))
def _(spark, sf):
    nodes, edges = D.file_graph(file_deps(spark, sf))
    return nodes.select(
        F.lit("node").alias("part"), F.col("path").alias("a"), F.lit("").alias("b"), "kind"
    ).unionByName(
        edges.select(
            F.lit("edge").alias("part"), F.col("from_path").alias("a"), F.col("to_path").alias("b"), "kind"
        )
    )


_REL_SQL = f"""
  select parent_symbol_id as symbol_id, 'children' as section, symbol_id as other, symbol_kind as rel_kind,
         0 as part, lower(name) as t, 0 as n, symbol_id as tie from symbols where parent_symbol_id is not null
  union all select source_symbol_id, 'references', target_symbol_id, kind, 0, path, hint_no, '' from edges
  union all select target_symbol_id, 'references', source_symbol_id, kind, 1, path, hint_no, '' from edges where target_symbol_id is not null
  union all select source_symbol_id, 'dependencies', target_symbol_id, kind, 0, path, hint_no, '' from edges where {HARD}
  union all select target_symbol_id, 'dependents', source_symbol_id, kind, 0, path, hint_no, '' from edges where {HARD}"""


@add("symbol_relationships", expect(f"select symbol_id, section, other as other_symbol_id, rel_kind from ({_REL_SQL})"))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.symbol_relationships(t["symbols"], t["edges"]).select(
        "symbol_id", "section", "other_symbol_id", "rel_kind"
    )


@add("section_limit", expect(f"""select symbol_id, section, other_symbol_id, rel_kind from (
  select symbol_id, section, other as other_symbol_id, rel_kind,
    row_number() over (partition by symbol_id, section order by part, t, n, tie) as rn from ({_REL_SQL})) where rn <= 5"""))
def _(spark, sf):
    t = index_of(spark, sf)
    return D.symbol_relationships(t["symbols"], t["edges"], limit=5).select(
        "symbol_id", "section", "other_symbol_id", "rel_kind"
    )


@add("call_graph", expect("""select 'node' as part, parent_symbol_id as centre, symbol_id as a, '' as b from symbols
    where parent_symbol_id in (select symbol_id from symbols where symbol_kind = 'Class')
  union all select 'edge', source_symbol_id, source_symbol_id, coalesce(target_symbol_id, '') from edges
    where source_symbol_id in (select symbol_id from symbols where symbol_kind = 'Class')
  union all select 'edge', target_symbol_id, source_symbol_id, target_symbol_id from edges
    where target_symbol_id in (select symbol_id from symbols where symbol_kind = 'Class')"""))
def _(spark, sf):
    t = index_of(spark, sf)
    ids = t["symbols"].filter(F.col("kind") == "Class")
    nodes, edges = D.call_graph(t["symbols"], t["edges"], ids)
    return nodes.select(
        F.lit("node").alias("part"), F.col("symbol_id").alias("centre"),
        F.col("node_symbol_id").alias("a"), F.lit("").alias("b"),
    ).unionByName(
        edges.select(
            F.lit("edge").alias("part"), F.col("symbol_id").alias("centre"),
            F.col("from_symbol_id").alias("a"), F.col("to_symbol_id").alias("b"),
        )
    )


# ---- counts and trees -------------------------------------------------------


@add("language_breakdown", expect("""select root, language, count(distinct path)::bigint as file_count from nodes group by 1, 2"""))
def _(spark, sf):
    return I.language_breakdown(index_of(spark, sf)["files"])


@add("snapshot_metadata", expect("""select root,
  (select count(distinct path) from nodes n where n.root = r.root)::bigint as file_count,
  (select count(*) from nodes n where n.root = r.root)::bigint as node_count,
  (select count(*) from symbols s where s.root = r.root)::bigint as symbol_count,
  (select count(*) from nodes n where n.root = r.root)::bigint as occurrence_count,
  (select count(*) from edges e where e.root = r.root)::bigint as reference_count,
  (select count(*) from imports i where i.root = r.root)::bigint as import_count,
  0::bigint as diagnostic_count,
  case root when 'py_repo' then 'python' else 'csharp' end || '=' ||
    cast((select count(distinct path) from nodes n where n.root = r.root) as varchar) as languages
  from (select distinct root from nodes) r"""))
def _(spark, sf):
    entries = F.transform(
        F.map_entries("language_breakdown"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return I.snapshot_metadata(index_of(spark, sf)).withColumn("languages", joined(entries)).drop(
        "language_breakdown"
    )


@add("list_files", expect("""select path, language, count(*) filter (parent_path is null)::bigint as top_level_node_count,
  0::bigint as diagnostic_count from nodes where starts_with(path, 'src/A') or starts_with(path, 'src/base/') group by 1, 2"""))
def _(spark, sf):
    t = index_of(spark, sf)
    cols = ["path", "language", "top_level_node_count", "diagnostic_count"]
    return (
        list_files(t["files"], t["nodes"], t["diagnostics"], ["Python"], ["Success"], ["Eligible"], "SRC/base/")
        .select(*cols)
        .unionByName(
            list_files(t["files"], t["nodes"], t["diagnostics"], ["csharp"])
            .filter(F.col("path").startswith("src/A"))
            .select(*cols)
        )
    )


@add("list_files_whole", expect("""select root, path, language, 'Success' as parse_status, 'Eligible' as eligibility,
  count(*) filter (parent_path is null)::bigint as top_level_node_count, 0::bigint as diagnostic_count from nodes group by 1, 2, 3"""))
def _(spark, sf):
    """All files of both roots; ``list_files`` is the case with filters."""
    t = index_of(spark, sf)
    return list_files(t["files"], t["nodes"], t["diagnostics"]).select(
        "root", "path", "language", "parse_status", "eligibility", "top_level_node_count", "diagnostic_count"
    )


@add("build_index", expect("""select 'files' as relation, root, path, language as a, 'Success' as b from nodes group by 1, 2, 3, 4
  union all select 'nodes', root, path, qualified_path, subkind from nodes
  union all select 'symbols', root, path, prefix || ':' || category || ':' || qualified_path, symbol_kind from symbols
  union all select 'occurrences', root, path, prefix || ':' || category || ':' || qualified_path, 'Declaration' from nodes
  union all select 'imports', root, path, target, raw_text from imports
  union all select 'hints', root, path, evidence, kind from py_hints union all select 'hints', root, path, evidence, kind from cs_hints
  union all select 'edges', root, path, source_symbol_id || ' ' || coalesce(target_symbol_id, '?'), resolution from edges"""))
def _(spark, sf):
    """A build of its own over both roots, with the rows of every relation."""
    t = I.build_index(C.corpus(spark, sf, C.SOURCE_ALL))
    shown = {
        "files": ("language", "parse_status"), "nodes": ("qualified_path", "subkind"), "symbols": ("symbol_id", "kind"),
        "occurrences": ("symbol_id", "role"), "imports": ("target", "raw_text"), "hints": ("evidence", "kind"),
        "edges": (F.concat_ws(" ", "source_symbol_id", F.coalesce("target_symbol_id", F.lit("?"))), "resolution"),
        "diagnostics": ("code", "severity"),
    }
    out = None
    for name, (a, b) in shown.items():
        a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
        path = F.col("primary_path" if name == "symbols" else "path").alias("path")
        part = t[name].select(F.lit(name).alias("relation"), "root", path, a.alias("a"), b.alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


@add("file_outline", expect("""select path, name, display_name, cast(depth as bigint) as depth, has_children and depth < 1 as expanded
  from nodes where depth <= 1"""))
def _(spark, sf):
    return T.file_outline(index_of(spark, sf)["nodes"], max_depth=1).select(
        "path", "name", "display_name", big("depth").alias("depth"), "expanded"
    )


@add("outline_depth",
  expect("""select path, qualified_path, cast(case when parent_path is null then 0
     when parent_path = 'App' or (starts_with(parent_path, 'Shop.') and parent_path not like 'Shop.%.%') then 1
     when root = 'cs_repo' then 2 when parent_path like '%.Meta' then 2 else 1 end as bigint) as depth from nodes"""))
def _(spark, sf):
    return T.outline_depth(index_of(spark, sf)["nodes"]).select(
        "path", "qualified_path", big("depth").alias("depth")
    )


@add("outline_ancestors", expect("""select path, qualified_path, chain as ancestors, depth::bigint as depth, false as cyclic from (
    with recursive up as (
      select path, qualified_path, start_line, parent_path, 0 as depth, '' as chain from nodes
      union all
      select u.path, u.qualified_path, u.start_line, n.parent_path, u.depth + 1, n.name || case when u.chain = '' then '' else '>' || u.chain end
      from up u join nodes n on n.path = u.path and n.qualified_path = u.parent_path)
    select * from up where parent_path is null) x"""))
def _(spark, sf):
    found = T.outline_depth(index_of(spark, sf)["nodes"])
    names = F.transform("ancestors", lambda a: F.substring_index(a, ":", -1))
    return found.select(
        "path", "qualified_path", F.array_join(names, ">").alias("ancestors"), big("depth").alias("depth"), "cyclic"
    )


@add("namespace_tree", expect("""select name, qualified_path as qualified_name, cast(null as varchar) as parent, 1::bigint as depth,
  (select count(*) from symbols c where c.root = s.root and regexp_matches(c.qualified_path, '^' || s.qualified_path || '[.][^.]+$'))::bigint as symbol_count,
  (select count(distinct c.path) from symbols c where c.root = s.root and regexp_matches(c.qualified_path, '^' || s.qualified_path || '[.][^.]+$'))::bigint as file_count
  from symbols s where symbol_kind = 'Namespace'"""))
def _(spark, sf):
    return T.namespace_tree(index_of(spark, sf)["symbols"]).select(
        "name", "qualified_name", "parent", big("depth").alias("depth"), "symbol_count", "file_count"
    )


@add("paginate", expect("""select symbol_id, qualified_path as qualified_name from symbols
  order by lower(qualified_path), symbol_id limit 20 offset 40"""))
def _(spark, sf):
    s = index_of(spark, sf)["symbols"]
    return paginate(s, [F.lower("qualified_name"), "symbol_id"], page=3, size=20).select(
        "symbol_id", "qualified_name"
    )


@add("build_result", expect("""select root, count(distinct path)::bigint as files_scanned, count(distinct path)::bigint as files_eligible,
  count(distinct path)::bigint as files_indexed, 0::bigint as files_skipped, 0::bigint as files_failed, 'success' as status
  from nodes group by 1"""))
def _(spark, sf):
    return I.build_result(index_of(spark, sf)["files"])
