"""What the generated source corpora must contain, derived from the columns."""

K = "cast(c_custkey as varchar)"
SEG = "c_mktsegment"
REG = "replace(r_name, ' ', '_')"

PC = f"""
select c_custkey as k, {K} as ks, {SEG} as seg, 'src/' || n_name || '/customer_' || {K} || '.py' as path
from customer join nation on c_nationkey = n_nationkey"""
SEGS = f"select distinct {SEG} as seg, 'src/base/' || {SEG} || '.py' as path from customer"
CC = f"""
select c_custkey as k, {K} as ks, {REG} as reg, 'src/' || {REG} || '/Customer' || {K} || '.cs' as path
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""
REGS = f"select {REG} as reg, 'src/' || {REG} || '/Account.cs' as path from region"

# root, path, kind, subkind, name, display_name, qualified_path, parent_path, start, end, depth, children
PY_NODES = """
select 'py_repo' as root, path, 'Declaration' as kind, 'class' as subkind, 'Customer' || ks as name,
       'Customer' || ks as display_name, 'Customer' || ks as qualified_path,
       cast(null as varchar) as parent_path, 4 as start_line,
       case when k % 5 = 0 then 10 else 7 end as end_line, 0 as depth, true as has_children from pc
union all select 'py_repo', path, 'Callable', 'method', 'total', 'total(self, x: int) -> int',
       'Customer' || ks || '.total', 'Customer' || ks, 5, case when k % 5 = 0 then 6 else 7 end, 1, false from pc
union all select 'py_repo', path, 'Declaration', 'class', 'Meta', 'Meta',
       'Customer' || ks || '.Meta', 'Customer' || ks, 7, 10, 1, true from pc where k % 5 = 0
union all select 'py_repo', path, 'Callable', 'method', 'load', 'async load(self)',
       'Customer' || ks || '.Meta.load', 'Customer' || ks || '.Meta', 8, 10, 2, false from pc where k % 5 = 0
union all select 'py_repo', path, 'Declaration', 'class', seg || 'Base', seg || 'Base', seg || 'Base',
       null, 1, 4, 0, true from segs
union all select 'py_repo', path, 'Callable', 'method', 'describe', 'describe(self)', seg || 'Base.describe',
       seg || 'Base', 2, 4, 1, false from segs"""

CS_NODES = """
select 'cs_repo' as root, path, 'Container' as kind, 'namespace' as subkind, 'App' as name,
       'App' as display_name, 'App' as qualified_path, cast(null as varchar) as parent_path,
       3 as start_line, 16 as end_line, 0 as depth, true as has_children from cc
union all select 'cs_repo', path, 'Declaration', 'class', 'Customer' || ks, 'Customer' || ks,
       'App.Customer' || ks, 'App', 6, 15, 1, true from cc
union all select 'cs_repo', path, 'Member', 'field', 'tags', 'List<string> tags',
       'App.Customer' || ks || '.tags', 'App.Customer' || ks, 8, 8, 2, false from cc
union all select 'cs_repo', path, 'Member', 'property', 'Extra',
       'Missing' || cast(k % 2 as varchar) || ' Extra',
       'App.Customer' || ks || '.Extra', 'App.Customer' || ks, 9, 9, 2, false from cc
union all select 'cs_repo', path, 'Callable', 'constructor', 'Customer' || ks, 'Customer' || ks || '(Account)',
       'App.Customer' || ks || '.Customer' || ks, 'App.Customer' || ks, 10, 10, 2, false from cc
union all select 'cs_repo', path, 'Callable', 'method', 'Copy', 'Account Copy(int)',
       'App.Customer' || ks || '.Copy', 'App.Customer' || ks, 11, 14, 2, false from cc
union all select 'cs_repo', path, 'Container', 'namespace', 'Shop.' || reg, 'Shop.' || reg, 'Shop.' || reg,
       null, 1, 7, 0, true from regs
union all select 'cs_repo', path, 'Declaration', 'class', 'Account', 'Account', 'Shop.' || reg || '.Account',
       'Shop.' || reg, 3, 6, 1, true from regs
union all select 'cs_repo', path, 'Member', 'property', 'Id', 'int Id', 'Shop.' || reg || '.Account.Id',
       'Shop.' || reg || '.Account', 5, 5, 2, false from regs"""

# Symbol id parts follow from kind and subkind.
NODES = f"""
select n.*, case kind when 'Container' then 'ns' when 'Declaration' then 'type'
              when 'Callable' then 'callable' else 'member' end as category,
       case subkind when 'namespace' then 'Namespace' when 'class' then 'Class' when 'method' then 'Method'
              when 'constructor' then 'Constructor' when 'field' then 'Field' when 'property' then 'Property'
              end as symbol_kind,
       case root when 'py_repo' then 'python:py-repo' else 'csharp:cs-repo' end as prefix,
       case root when 'py_repo' then 'python' else 'csharp' end as language,
       case root when 'py_repo' then 'py_repo/' else 'cs_repo/' end || path as file_key
from (select * from py_nodes union all select * from cs_nodes) n"""

# One row per symbol: the namespace App is declared in every customer file.
SYMBOLS = """
select * exclude (rn) from (
  select n.*, prefix || ':' || category || ':' || qualified_path as symbol_id,
         case when parent_path is null then null
              else prefix || ':' || case when parent_path = 'App' or starts_with(parent_path, 'Shop.')
                   and parent_path not like 'Shop.%.%' then 'ns' else 'type' end || ':' || parent_path end
           as parent_symbol_id,
         row_number() over (partition by root, prefix, category, qualified_path
                            order by path desc, start_line desc) as rn
  from nodes n) where rn = 1"""

PY_HINTS = """
select 'py_repo' as root, path, 1 as hint_no, 'Customer' || ks as source_path, 'Inherits' as kind,
       seg || 'Base' as target_name, seg || 'Base' as evidence, 4 as line, k from pc
union all select 'py_repo', path, 2, 'Customer' || ks, 'Implements', 'IAudit', 'IAudit[int]', 4, k
from pc where k % 4 = 0"""

CS_HINTS = """
select 'cs_repo' as root, path, 1 as hint_no, 'App.Customer' || ks as source_path, 'Inherits' as kind,
       'Account' as target_name, 'Account' as evidence, 6 as line, k from cc
union all select 'cs_repo', path, 2, 'App.Customer' || ks, 'ContainsFieldOfType', 'List', 'List<string>', 8, k from cc
union all select 'cs_repo', path, 3, 'App.Customer' || ks, 'ContainsPropertyOfType',
       'Missing' || cast(k % 2 as varchar), 'Missing' || cast(k % 2 as varchar), 9, k from cc
union all select 'cs_repo', path, 4, 'App.Customer' || ks || '.Copy', 'ReturnsType', 'Account', 'Account', 11, k from cc
union all select 'cs_repo', path, 5, 'App.Customer' || ks || '.Customer' || ks, 'AcceptsParameterType',
       'Account', 'Account', 10, k from cc
union all select 'cs_repo', path, 6, 'App.Customer' || ks || '.Copy', 'CreatesInstanceOf', 'Account', 'Account', 13, k from cc
union all select 'cs_repo', path, 7, 'App.Customer' || ks, 'UsesAttributeOrAnnotation',
       'SerializableAttribute', 'Serializable', 5, k from cc"""

EDGES = """
select root, path, hint_no, kind, evidence, line,
       'python:py-repo:type:' || source_path as source_symbol_id,
       case when kind = 'Inherits' then 'python:py-repo:type:' || target_name end as target_symbol_id,
       case when kind = 'Inherits' then 'ExactBound' else 'Unknown' end as resolution,
       case when kind = 'Inherits' then 1.0 else 0.85 end as confidence, 'python' as language
from py_hints
union all
select h.root, h.path, hint_no, kind, evidence, line,
       'csharp:cs-repo:' || case when kind in ('ReturnsType', 'AcceptsParameterType', 'CreatesInstanceOf')
          then 'callable' else 'type' end || ':' || source_path,
       case when target_name = 'Account' and h.k % 3 <> 0
            then 'csharp:cs-repo:type:Shop.' || cc.reg || '.Account' end,
       case when target_name = 'Account' then case when h.k % 3 <> 0 then 'ImportBound' else 'Ambiguous' end
            when target_name = 'List' then 'External' else 'Unknown' end,
       case when target_name = 'Account' then case when h.k % 3 <> 0 then 0.95 else 0.7 end
            when target_name = 'List' then 0.8 else 0.85 end, 'csharp'
from cs_hints h join cc on h.k = cc.k"""

IMPORTS = """
select 'py_repo' as root, path, 'import' as kind, 'import os' as raw_text, 'os' as target,
       cast(null as varchar) as alias, 1 as line from pc
union all select 'py_repo', path, 'from-import', 'from base import ' || seg || 'Base', 'base', seg || 'Base', 2 from pc
union all select 'cs_repo', path, 'using', 'using System;', 'System', null, 1 from cc
union all select 'cs_repo', path, 'using', 'using Shop.' || reg || ';', 'Shop.' || reg, null, 2 from cc where k % 3 <> 0"""

_ALL = {
    "pc": PC, "segs": SEGS, "cc": CC, "regs": REGS, "py_nodes": PY_NODES, "cs_nodes": CS_NODES,
    "nodes": NODES, "symbols": SYMBOLS, "py_hints": PY_HINTS, "cs_hints": CS_HINTS,
    "edges": EDGES, "imports": IMPORTS,
}
METHOD = """case resolution when 'ExactBound' then 'exact' when 'ScopedBound' then 'scoped'
  when 'ImportBound' then 'import-qualified' when 'Ambiguous' then 'ambiguous'
  when 'External' then 'external' else 'unresolved' end"""
HARD = "resolution in ('ExactBound', 'ScopedBound', 'ImportBound')"


def expect(body: str) -> str:
    """SQL over the expected relations."""
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in _ALL.items()) + "\n" + body


# The declarations of the wide C# source: kind, subkind, name, display name, path, first and last line, depth,
# children, modifiers. %K% is the key; lines move down by its remainder by three.
WIDE_NODES = [
    ("Container", "namespace", "Shop.N%K%", "Shop.N%K%", "", 4, 78, 0, True, ""),
    ("Declaration", "interface", "IStore", "IStore<TKey, TValue>", "", 7, 16, 1, True, "public"),
    ("Callable", "method", "Find", "TValue Find(TKey, int)", "IStore.", 12, 14, 2, False, ""),
    ("Member", "event", "Changed", "EventHandler Changed", "IStore.", 15, 15, 2, False, ""),
    ("Declaration", "class", "Store%K%", "Store%K%<T>", "", 19, 73, 1, True, "public sealed"),
    ("Member", "field", "Sql", "string Sql", "Store%K%.", 23, 25, 2, False, "private const"),
    ("Member", "field", "_raw", "string _raw", "Store%K%.", 26, 28, 2, False, "private readonly"),
    ("Member", "field", "Names", "string[] Names", "Store%K%.", 29, 32, 2, False, "private static readonly"),
    ("Callable", "constructor", "Store%K%", "Store%K%(string, int)", "Store%K%.", 33, 38, 2, False, "public"),
    ("Callable", "method", "Load", "Task<List<T>> Load<TArg>(TArg, Func<int, string>)", "Store%K%.", 40, 50, 2, False, "public async"),
    ("Callable", "method", "Load", "void Load(int)", "Store%K%.", 51, 51, 2, False, "public"),
    ("Callable", "method", "Load", "void Load(int, string)", "Store%K%.", 52, 52, 2, False, "public"),
    ("Callable", "method", "Reset", "void Reset()", "Store%K%.", 53, 53, 2, False, ""),
    ("Member", "property", "Count", "int Count", "Store%K%.", 54, 54, 2, False, ""),
    ("Member", "indexer", "this[]", "T this[]", "Store%K%.", 55, 58, 2, False, "public"),
    ("Member", "event", "Done", "EventHandler<Args> Done", "Store%K%.", 59, 59, 2, False, "public"),
    ("Member", "event", "Gone", "EventHandler<Args> Gone", "Store%K%.", 59, 59, 2, False, "public"),
    ("Member", "event", "Fired", "EventHandler Fired", "Store%K%.", 60, 60, 2, False, ""),
    ("Declaration", "delegate", "Check", "Check<TItem>", "Store%K%.", 61, 62, 2, False, "public"),
    ("Declaration", "enum", "Color", "Color", "Store%K%.", 63, 68, 2, False, "public"),
    ("Declaration", "struct", "Point", "Point", "Store%K%.", 69, 69, 2, False, "public readonly"),
    ("Member", "field", "q", "char q", "Store%K%.", 70, 70, 2, False, ""),
    ("Member", "field", "u", "string u", "Store%K%.", 71, 72, 2, False, ""),
    ("Declaration", "record class", "Pair", "Pair", "", 74, 76, 1, False, "public"),
    ("Declaration", "record struct", "P2", "P2", "", 77, 77, 1, False, "public"),
]
# Source path below the namespace, kind, target, evidence, line.
WIDE_HINTS = [
    ("IStore", "Implements", "IBase", "IBase<TKey>", 7),
    ("IStore", "Implements", "IDisposable", "IDisposable", 7),
    ("Store%K%", "Inherits", "BaseStore", "BaseStore<Dictionary<string, T>>", 19),
    ("Store%K%", "Implements", "IStore", "IStore<string, T>", 19),
    ("Store%K%.Point", "Implements", "IPoint", "IPoint", 69),
    ("Pair", "Inherits", "Base", "Base", 74),
    ("IStore.Find", "ReturnsType", "TValue", "TValue", 12),
    ("IStore.Find", "AcceptsParameterType", "TKey", "TKey", 12),
    ("Store%K%.Load", "ReturnsType", "Task", "Task<List<T>>", 40),
    ("Store%K%.Load", "AcceptsParameterType", "TArg", "TArg", 40),
    ("Store%K%.Load", "AcceptsParameterType", "Func", "Func<int, string>", 40),
    ("Store%K%.Load", "CreatesInstanceOf", "Order", "Order", 45),
    ("Store%K%.Load", "CreatesInstanceOf", "List", "List<T>", 49),
    ("Store%K%", "UsesAttributeOrAnnotation", "SerializableAttribute", "Serializable", 17),
    ("Store%K%", "UsesAttributeOrAnnotation", "ObsoleteAttribute", "Obsolete", 17),
    ("Store%K%.Load", "UsesAttributeOrAnnotation", "FactAttribute", "Fact", 39),
]


def _values(rows: list[tuple]) -> str:
    def text(v) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()

    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


_WIDE_FILES = f"select {K} as ks, c_custkey % 3 as shift, c_custkey % 7 as odd, 'src/Wide' || {K} || '.cs' as path from customer"
EXPECT_WIDE_NODES = f"""
select path, kind, subkind, replace(name, '%K%', ks) as name, replace(display, '%K%', ks) as display_name,
  case when kind = 'Container' then 'Shop.N' || ks else replace('Shop.N%K%.' || owner || name, '%K%', ks) end as qualified_path,
  (first + shift)::bigint as start_line, (last + shift)::bigint as end_line, depth::bigint as depth, children as has_children, modifiers
from ({_WIDE_FILES}) f, (values {_values(WIDE_NODES)}) v(kind, subkind, name, display, owner, first, last, depth, children, modifiers)
union all
select path, 'Declaration', 'class', 'Open', 'Open', 'Open', 80 + shift, 80 + shift, 0, false, '' from ({_WIDE_FILES}) f where odd = 2
"""
EXPECT_WIDE_HINTS = f"""
select path, replace('Shop.N%K%.' || source, '%K%', ks) as source_path, kind, target as target_name, evidence, (line + shift)::bigint as line
from ({_WIDE_FILES}) f, (values {_values(WIDE_HINTS)}) v(source, kind, target, evidence, line)
"""
EXPECT_WIDE_DIAGNOSTICS = f"""
select path, case odd when 1 then 'CS1022' else 'CS1513' end as code, 'Warning' as severity from ({_WIDE_FILES}) f where odd in (1, 2)
"""
