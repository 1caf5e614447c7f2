"""Extraction, symbols and resolution on small sources with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.functions.storage import stored
from codelake.operators import deps as D
from codelake.operators import extract_cs as CS
from codelake.operators import extract_py as PY
from codelake.operators.resolve import resolve_references
from codelake.operators.trees import file_outline
from codelake.plans.index import build_index, content_pass, inventory
from codelake.plans.refresh import incremental_update

ANIMALS = """import os
import sys as system
from typing import List
from .base import BaseAnimal

class Animal:
    def __init__(self, name: str):
        self.name = name

    # a comment at column 4
# a comment at column 0 closes no scope
    def speak(self) -> str:
        pass

class Dog(Animal, IPet[int]):
\tasync def bark(self) -> str:
\t\tdef inner():
\t\t\treturn 1
\t\treturn "Woof!"

def late(
    x):
    pass
"""

ORDERS = """using System;
using System.Collections.Generic;

namespace TestApp.Orders
{
    public interface IEntity
    {
        int Id { get; }
    }

    public class BaseOrder
    {
        public int Id { get; set; }
    }

    public class Order : BaseOrder, IEntity
    {
        public int Id { get; set; }
        public BaseOrder Parent { get; set; }

        public Order(int id)
        {
            Id = id;
        }

        public BaseOrder GetParent()
        {
            return new BaseOrder();
        }
    }
}
"""

SHAPES = """using Alias = A.B;
using static System.Math;
namespace Geo;

[Serializable, Obsolete("x, [y] {")]
public abstract partial class Shape<T, U> : Base<T, List<U>>, IDrawable where T : class
{
    private readonly List<string> _a = new List<string>(), _b;
    public event EventHandler<int> Changed, Gone;
    [Test]
    public async Task<Shape<T>> Run(int x, [In] Dictionary<string, Order> d = null, params Order[] os) => await Go(new Order { });
    public Item this[int i] { get { return null; } }
    public string Name => "{";
    protected delegate void Handler(object o);
    enum Color { Red, Green }
    struct Point : IPoint
    {
        int? x, y;
        char c = '}';
        public void Move()
        {
            var local = new Vector(1); // new Hidden()
            if (x > 0) { Call(local); }
        }
    }
}
public record struct Pair(double X, double Y);
"""


def test_python_nodes(corpus, spark):
    rows = PY.py_declarations(corpus({"animals.py": ANIMALS})).collect()
    got = {r.qualified_path: r for r in rows}
    assert list(got) == [
        "Animal", "Animal.__init__", "Animal.speak", "Dog", "Dog.bark", "Dog.bark.inner",
    ]
    assert got["Animal"].span.start_line == 6 and got["Animal.speak"].parent_kind == "Declaration"
    # A comment line ends a block, though it closes no scope.
    assert got["Animal"].span.end_line == 10
    assert got["Dog.bark.inner"].subkind == "method" and got["Dog.bark.inner"].depth == 2
    assert got["Dog.bark"].display_name == "async bark(self) -> str"
    assert list(got["Dog.bark"].modifiers) == ["async"]
    assert (got["Dog"].confidence, got["Dog.bark"].confidence) == (0.75, 0.8)


def test_python_imports_and_hints(corpus):
    files = corpus({"animals.py": ANIMALS})
    imports = [(r.kind, r.target, r.alias) for r in PY.py_imports(files).collect()]
    assert imports == [
        ("import", "os", None), ("import", "sys", "system"),
        ("from-import", "typing", "List"), ("relative-import", "base", "BaseAnimal"),
    ]
    hints = [(r.source_path, r.kind, r.target_name, r.evidence) for r in PY.py_base_hints(files).collect()]
    assert hints == [
        ("Dog", "Inherits", "Animal", "Animal"), ("Dog", "Implements", "IPet", "IPet[int]"),
    ]


def brute_force_scopes(text):
    """The same reading with a stack, line by line."""
    import re

    head = re.compile(r"^([ \t]*)(class|def)\s+(\w+)\s*(?:\(\))?\s*:")
    lines, stack, out = text.split("\n"), [], []

    def indent(t):
        lead = re.match(r"[ \t]*", t).group()
        return len(lead) + 3 * lead.count("\t")

    for i, t in enumerate(lines):
        if not t.strip() or t.strip().startswith("#"):
            continue
        while stack and stack[-1][0] >= indent(t):
            stack.pop()
        m = head.match(t)
        if m:
            end = next(
                (j for j in range(i + 1, len(lines)) if lines[j].strip() and indent(lines[j]) <= indent(t)),
                len(lines),
            )
            stack.append((indent(t), m.group(3)))
            out.append((i + 1, end, ".".join(n for _, n in stack)))
    return out


def test_python_scopes_against_brute_force(spark):
    rnd = random.Random(11)
    texts = []
    for size in (1, 10, 64, 65, 130, 400):
        for _ in range(3):
            lines = []
            for n in range(size):
                pad = rnd.choice(["", "  ", "    ", "\t", "      ", "        "])
                lines.append(pad + rnd.choice([f"class C{n}:", f"def f{n}():", "x = 1", "# note", "", "pass"]))
            texts.append("\n".join(lines))
    df = spark.createDataFrame(
        [("r", f"{i}.py", t) for i, t in enumerate(texts)], "root string, path string, content string"
    )
    got = {}
    for r in PY.py_declarations(df).collect():
        got.setdefault(r.path, []).append((r.span.start_line, r.span.end_line, r.qualified_path))
    for i, t in enumerate(texts):
        assert got.get(f"{i}.py", []) == brute_force_scopes(t)


def test_csharp_one_rule_for_every_length(corpus):
    pad = "x" * 3000
    gap = "// note\n" * 40
    text = f"""class A
{gap}{{
    string s = @"C:\\" + "{{"; string t = "{pad}{{\\"{{"; char c = '{{'; char d = '\\u007B';
    void F() {{ }}
}}
"""
    spans = {r.qualified_path: r.span.end_line for r in CS.cs_declarations(corpus({"a.cs": text})).collect()}
    assert spans["A"] == 45 and spans["A.F"] == 44


def test_csharp_very_long_line(corpus):
    text = 'class A\n{\n    string s = "' + 'x{\\"' * 20000 + '"; // {\n    void F() { }\n}\n'
    names = [(r.qualified_path, r.span.end_line) for r in CS.cs_declarations(corpus({"a.cs": text})).collect()]
    assert names == [("A", 5), ("A.s", 3), ("A.F", 4)]


def test_csharp_shapes(corpus):
    parsed = CS.parse_csharp(corpus({"s.cs": SHAPES})).cache()
    nodes = {(r.qualified_path, r.subkind): r for r in PY.inline_nodes(parsed).collect()}
    assert set(nodes) == {
        ("Geo", "namespace"), ("Geo.Shape", "class"), ("Geo.Shape._a", "field"), ("Geo.Shape._b", "field"),
        ("Geo.Shape.Changed", "event"), ("Geo.Shape.Gone", "event"), ("Geo.Shape.Run", "method"),
        ("Geo.Shape.this[]", "indexer"), ("Geo.Shape.Name", "property"), ("Geo.Shape.Handler", "delegate"),
        ("Geo.Shape.Color", "enum"), ("Geo.Shape.Point", "struct"), ("Geo.Shape.Point.x", "field"),
        ("Geo.Shape.Point.y", "field"), ("Geo.Shape.Point.c", "field"), ("Geo.Shape.Point.Move", "method"),
        ("Geo.Pair", "record struct"),
    }
    shape = nodes[("Geo.Shape", "class")]
    assert shape.display_name == "Shape<T, U>" and list(shape.modifiers) == ["public", "abstract", "partial"]
    assert nodes[("Geo.Shape.Run", "method")].display_name == (
        "Task<Shape<T>> Run(int, Dictionary<string, Order>, Order[])"
    )
    hints = {(r.source_path, r.kind, r.target_name) for r in PY.inline_hints(parsed).collect()}
    assert hints == {
        ("Geo.Shape", "Inherits", "Base"), ("Geo.Shape", "Implements", "IDrawable"),
        ("Geo.Shape.Point", "Implements", "IPoint"), ("Geo.Shape", "ContainsFieldOfType", "List"),
        ("Geo.Shape.Run", "ReturnsType", "Task"), ("Geo.Shape.Run", "AcceptsParameterType", "Dictionary"),
        ("Geo.Shape.Run", "AcceptsParameterType", "Order"), ("Geo.Shape", "CreatesInstanceOf", "List"),
        ("Geo.Shape.Run", "CreatesInstanceOf", "Order"), ("Geo.Shape.Point.Move", "CreatesInstanceOf", "Vector"),
        ("Geo.Shape", "UsesAttributeOrAnnotation", "SerializableAttribute"),
        ("Geo.Shape", "UsesAttributeOrAnnotation", "ObsoleteAttribute"),
        ("Geo.Shape.Run", "UsesAttributeOrAnnotation", "TestAttribute"),
    }
    imports = [(r.kind, r.target, r.alias) for r in PY.inline_imports(parsed).collect()]
    assert imports == [("using-alias", "A.B", "Alias"), ("using-static", "System.Math", None)]


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        ("repo", "Orders.cs", ORDERS), ("repo", "animals.py", ANIMALS),
        ("repo", "empty.py", ""), ("repo", "notes.md", "# class X"),
        ("repo", "bin/skip.py", "class Skipped:\n    pass\n"),
        ("repo", "broken.cs", "class Open {\n"),
    ]
    return build_index(spark.createDataFrame(rows, "root string, path string, content string"))


def test_edges_of_orders(orders):
    edges = orders["edges"].filter("path = 'Orders.cs'").cache()
    assert edges.count() == 5
    assert {r.resolution for r in edges.collect()} == {"ScopedBound"}
    order = "csharp:repo:type:TestApp.Orders.Order"
    out = D.references_out(edges, orders["symbols"]).filter(F.col("symbol_id") == order)
    assert sorted(r.kind for r in out.collect()) == ["ContainsPropertyOfType", "Implements", "Inherits"]
    base = "csharp:repo:type:TestApp.Orders.BaseOrder"
    assert D.references_in(edges, orders["symbols"]).filter(F.col("symbol_id") == base).count() == 4


def test_file_records(orders):
    rows = {r.path: (r.language, r.eligibility, r.parse_status) for r in orders["files"].collect()}
    assert rows == {
        "Orders.cs": ("csharp", "Eligible", "Success"), "animals.py": ("python", "Eligible", "Success"),
        "empty.py": ("python", "Eligible", "Success"), "notes.md": ("markdown", "Eligible", "Skipped"),
        "bin/skip.py": ("python", "Ignored", "Skipped"), "broken.cs": ("csharp", "Eligible", "Partial"),
    }
    assert [(r.path, r.code) for r in orders["diagnostics"].collect()] == [("broken.cs", "CS1513")]


def test_salted_resolution_gives_the_same_edges(orders, spark):
    want = sorted(map(repr, orders["edges"].collect()))
    deps = sorted(map(repr, D.file_dependencies(orders["edges"], orders["symbols"]).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = resolve_references(orders["hints"], orders["symbols"], orders["imports"], hot_rows=0)
        assert sorted(map(repr, again.collect())) == want
        salted = D.file_dependencies(orders["edges"], orders["symbols"], hot_rows=0)
        assert sorted(map(repr, salted.collect())) == deps
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_roots_do_not_mix(spark):
    rows = [("a", "x.py", "class X:\n    pass\n"), ("b", "y.py", "class Y(X):\n    pass\n")]
    built = build_index(spark.createDataFrame(rows, "root string, path string, content string"))
    assert [(r.root, r.resolution) for r in built["edges"].collect()] == [("b", "Unknown")]


def test_overloads_share_one_symbol(corpus, spark):
    text = "class A\n{\n    void F(int x) { }\n    void F(string s) { }\n}\n"
    built = build_index(corpus({"a.cs": text}))
    methods = built["symbols"].filter("kind = 'Method'").collect()
    assert [m.display_name for m in methods] == ["void F(string)"]
    assert built["occurrences"].filter(F.col("symbol_id") == methods[0].symbol_id).count() == 2


def test_outline_hides_nested_containers(corpus):
    text = "namespace A\n{\n    namespace B\n    {\n        class C { }\n    }\n    class D { }\n}\n"
    nodes = CS.cs_declarations(corpus({"a.cs": text}))
    assert [r.name for r in file_outline(nodes).collect()] == ["A", "B", "C", "D"]
    assert [r.name for r in file_outline(nodes, include_non_semantic=False).collect()] == ["A", "D"]


def test_ambiguous_name_needs_an_import(corpus):
    built = build_index(corpus({
        "a.cs": "namespace P.A\n{\n    class Item { }\n}\n",
        "b.cs": "namespace P.B\n{\n    class Item { }\n}\n",
        "c.cs": "using P.A;\nclass One : Item { }\n",
        "d.cs": "using P.A;\nusing P.B;\nclass Two : Item { }\n",
        "e.cs": "using static P.A;\nclass Three : Item { }\n",
    }))
    got = {r.path: (r.resolution, r.target_symbol_id, r.confidence) for r in built["edges"].collect()}
    assert got == {
        "c.cs": ("ImportBound", "csharp:repo:type:P.A.Item", 0.95),
        "d.cs": ("Ambiguous", None, 0.7), "e.cs": ("Ambiguous", None, 0.7),
    }


def test_refresh_with_unread_and_changed_files(spark):
    def files(rows):
        return spark.createDataFrame(rows, "root string, path string, content string, size_bytes long")

    old_rows = [("r", "a.py", "class A:\n    pass\n", 1), ("r", "big.py", None, 9 << 20), ("r", "b.py", "class B(A):\n    pass\n", 1)]
    old = build_index(files(old_rows))
    now = [("r", "A.py", "class A2:\n    pass\n", 1), old_rows[1], old_rows[2]]
    tables, changes = incremental_update(old, files(now))
    assert {(r.path, r.change) for r in changes.collect()} == {
        ("A.py", "modified"), ("big.py", "unchanged"), ("b.py", "unchanged"),
    }
    assert {r.name for r in tables["symbols"].collect()} == {"A2", "B"}
    assert [r.resolution for r in tables["edges"].collect()] == ["Unknown"]
    assert tables["files"].count() == 3


def test_csharp_noise_and_unclosed_tokens(corpus):
    cases = {
        "comment.cs": "class A { }\n/* class B { }\n",
        "raw.cs": 'class A\n{\n  string s = """"\n class B { """ }\n  """";\n  int x;\n}\n',
        "verbatim.cs": 'class A\n{\n  string s = @"\\";\n  string t = $@"{ ""q"" }";\n  int x;\n}\n',
        "chars.cs": "class A\n{\n  char a = '\\'', b = '{', c = '\"';\n  int x;\n}\n",
        "crlf.cs": "class A // {\r\n{\r\n  /* \r\n } */ int x;\r\n}\r\n",
        "open.cs": 'class A\n{\n  string s = "open\n  int x;\n}\n',
        "directive.cs": "#if X's {\nclass A\n{\n#endif\n  int x;\n}\n",
        "onlycomment.cs": "// nothing",
        "empty.cs": "",
    }
    got = {}
    for r in CS.cs_declarations(corpus(cases)).collect():
        got.setdefault(r.path, []).append((r.qualified_path, r.span.start_line, r.span.end_line))
    assert got["comment.cs"] == [("A", 1, 1)]
    assert got["raw.cs"] == [("A", 1, 7), ("A.s", 3, 5), ("A.x", 6, 6)]
    assert got["verbatim.cs"] == [("A", 1, 6), ("A.s", 3, 3), ("A.t", 4, 4), ("A.x", 5, 5)]
    assert got["chars.cs"] == [("A", 1, 5), ("A.a", 3, 3), ("A.b", 3, 3), ("A.c", 3, 3), ("A.x", 4, 4)]
    assert got["crlf.cs"] == [("A", 1, 5), ("A.x", 4, 4)]
    assert ("A", 1, 5) in got["open.cs"] and got["directive.cs"] == [("A", 2, 6), ("A.x", 5, 5)]
    assert "onlycomment.cs" not in got and "empty.cs" not in got


def test_deep_and_many_scopes(corpus):
    """Stacks against the plain rule: a scope is around a line if it began above and ends at or below it."""
    rng = random.Random(4)
    lines, depth = [], 0
    for i in range(1500):
        depth = max(0, min(depth + rng.choice([-2, -1, 0, 1, 1]), 12))
        lines.append(" " * depth + rng.choice([f"class C{i}:", f"def f{i}(a):", f"x{i} = 1", "", f"# note {i}"]))
    rows = PY.py_declarations(corpus({"a.py": "\n".join(lines)})).collect()
    indent = {i + 1: len(t) - len(t.lstrip()) for i, t in enumerate(lines)}
    code = {i + 1 for i, t in enumerate(lines) if t.strip() and not t.strip().startswith("#")}

    def scope_end(n):
        return next((m - 1 for m in range(n + 1, len(lines) + 1) if m in code and indent[m] <= indent[n]), len(lines))

    ends = {r.span.start_line: scope_end(r.span.start_line) for r in rows}
    names = {r.span.start_line: r.name for r in rows}
    for r in rows:
        n = r.span.start_line
        outer = [m for m in sorted(ends) if m < n <= ends[m]]
        assert r.qualified_path == ".".join([*(names[m] for m in outer), r.name]) and r.depth == len(outer)
    parents = {r.parent_node_id for r in rows}
    assert all(r.has_children == (r.node_id in parents) for r in rows)


def test_many_declarations_of_one_file(corpus):
    """40 000 declarations of a file take at most five times as long as 10 000."""

    def text(n):
        block = "class C{0}:\n    def a(self):\n        def b(x):\n            return 1\n    def c(self):\n        pass"
        return "\n".join(block.format(i) for i in range(n // 4))

    def seconds(n):
        import time

        start = time.time()
        assert PY.py_declarations(corpus({"a.py": text(n)})).count() == n
        return time.time() - start

    seconds(100)
    assert seconds(40_000) <= 5 * seconds(10_000)


def test_many_members_of_one_csharp_file(corpus):
    block = "  [X]\n  public class C{0}\n  {{\n    [Y]\n    public int A{0}(int x)\n    {{\n      return new Q();\n    }}\n    public P F;\n  }}"
    n = 3_000
    parsed = CS.parse_csharp(corpus({"a.cs": "namespace N\n{\n" + "\n".join(block.format(i) for i in range(n)) + "\n}\n"}))
    row = parsed.select(F.col("nodes"), F.col("hints")).first()
    assert len(row.nodes) == 3 * n + 1 and row.nodes[-1].qualified_path == f"N.C{n - 1}.F"
    assert all(x.has_children for x in row.nodes if x.kind != "Member" and x.kind != "Callable")
    kinds = {}
    for h in row.hints:
        kinds.setdefault(h.kind, []).append((h.source_path, h.target_name))
    assert kinds["CreatesInstanceOf"] == [(f"N.C{i}.A{i}", "Q") for i in range(n)]
    assert kinds["UsesAttributeOrAnnotation"][-2:] == [(f"N.C{n - 1}", "XAttribute"), (f"N.C{n - 1}.A{n - 1}", "YAttribute")]
    assert kinds["ContainsFieldOfType"] == [(f"N.C{i}", "P") for i in range(n)]


def random_sources(rng, n):
    """Small files of both languages that declare, import and use each other's names."""
    names, spaces = ["Item", "Order", "Base", "Thing", "get"], ["P.A", "P.B", "Q"]
    out = {}
    for i in rng.sample(range(n * 2), n):
        a, b, c = rng.choices(names, k=3)
        if i % 2:
            out[f"d{i % 3}/f{i}.cs"] = (
                f"using {rng.choice(spaces)};\nusing {rng.choice(spaces)};\nnamespace {rng.choice(spaces)}\n{{\n    class {a} : {b}\n    {{\n"
                f"        public {c} M{rng.randint(0, 3)}({rng.choice(['P.A.Item', 'Q.Order', a])} x) {{ return new {c}(); }}\n    }}\n}}\n"
            )
        else:
            out[f"d{i % 3}/f{i}.py"] = f"from {rng.choice(['p.a', 'q'])} import {a}\nclass {b}({c}):\n    def {rng.choice(names)}(self):\n        pass\n"
    return out


def same_tables(a, b, names=("symbols", "edges", "occurrences", "uses", "files", "diagnostics", "nodes", "imports", "hints")):
    for name in names:
        columns = sorted(b[name].columns)
        have, want = (sorted(map(repr, t[name].select(*columns).collect())) for t in (a, b))
        assert have == want, name


@pytest.mark.parametrize("seed", [1, 2])
def test_refresh_equals_a_full_build(spark, seed):
    def files(sources):
        return spark.createDataFrame([("r", p, c) for p, c in sources.items()] + [("other", "x.py", "class Item:\n    pass\n")], "root string, path string, content string")

    rng = random.Random(seed)
    sources = random_sources(rng, 24)
    tables = build_index(files(sources))
    for _ in range(2):
        sources = dict(sources)
        for path in rng.sample(sorted(sources), 3):
            del sources[path]
        sources |= random_sources(rng, 4)
        moved = rng.choice(sorted(sources))
        sources[moved] = "// moved down\n" + sources[moved] if moved.endswith(".cs") else "\n" + sources[moved]
        tables, _ = incremental_update(tables, files(sources))
        same_tables(tables, build_index(files(sources)))


def test_one_changed_file_resolves_its_frontier_only(spark):
    def files(sources):
        return spark.createDataFrame([("r", p, c) for p, c in sources.items()], "root string, path string, content string")

    sources = {f"f{i}.py": f"class C{i}(C{(i * 7) % 300}):\n    pass\n" for i in range(300)}
    old = build_index(files(sources))
    # C5 goes and D5 comes: only who used C5, and the file itself, is looked at.
    sources["f5.py"] = "class D5(C0):\n    pass\n"
    tables, _ = incremental_update(old, files(sources))
    users = {f"f{i}.py" for i in range(300) if (i * 7) % 300 == 5}
    assert {r.path for r in tables["resolved"].collect()} == users | {"f5.py"}
    # The same declarations further down concern nobody else.
    sources["f9.py"] = "\n\n" + sources["f9.py"]
    again, _ = incremental_update(tables, files(sources))
    assert {r.path for r in again["resolved"].collect()} == {"f9.py"}
    same_tables(again, build_index(files(sources)), ("symbols", "edges"))


def test_refresh_shuffles_narrow_rows(spark, monkeypatch):
    """Without broadcasts, what meets the names is neither whole symbols nor file ids, and the edges are those of a full build."""
    from codelake.plans import refresh

    written = []

    def noted(df, name, *more):
        written.append((name, df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return stored(df, name, *more)

    def files(sources):
        return spark.createDataFrame([("r", p, c) for p, c in sources.items()], "root string, path string, content string")

    sources = random_sources(random.Random(7), 8)
    old = build_index(files(sources))
    gone, edited = sorted(sources)[:2]
    del sources[gone]
    sources[edited] += "\n\n"
    sources["new.py"] = "class Fresh(Item):\n    pass\n"
    monkeypatch.setattr(refresh, "stored", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables, _ = incremental_update(old, files(sources))
        edges = sorted(map(repr, tables["edges"].select("path", "hint_no", "target_symbol_id", "resolution").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = build_index(files(sources))["edges"]
    assert edges == sorted(map(repr, whole.select("path", "hint_no", "target_symbol_id", "resolution").collect()))
    assert [name for name, columns, _ in written if "symbol_key" in columns] == ["touched_symbols"]
    plans = {name: plan for name, _, plan in written}
    assert not [line for line in plans["met"].splitlines() if "Join" in line and "file_id" in line]
    assert not [line for line in plans["todo"].splitlines() if "Join" in line and "file_id" in line]


def test_content_is_read_once(spark, tmp_path):
    rows = [("r", "a.cs", "class A { }\n"), ("r", "b.py", "class B(A):\n    pass\n"), ("r", "c.md", "{"), ("r", "bad.cs", "class A {\n")]
    spark.createDataFrame(rows, "root string, path string, content string").write.parquet(f"{tmp_path}/corpus")
    files = spark.read.parquet(f"{tmp_path}/corpus")
    plan = content_pass(inventory(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    for name, df in build_index(files).items():
        assert "FileScan" in df._jdf.queryExecution().executedPlan().toString()
        assert not any(f"{tmp_path}/corpus" in f for f in df.inputFiles()), name


def test_ancestors_from_parent_ids(spark):
    from codelake.operators.trees import ancestors

    rng = random.Random(9)
    parent = {f"n{i}": f"n{rng.randrange(i)}" if i and rng.random() < 0.9 else None for i in range(200)}
    parent |= {f"d{i}": f"d{i - 1}" if i else None for i in range(150)}
    parent |= {"x0": "x2", "x1": "x0", "x2": "x1", "y": "x1", "self": "self", "orphan": "gone"}
    rows = [("r", "a", n, p) for n, p in parent.items()] + [("r", "b", "n1", "n0"), ("r", "a", "n5", parent["n5"])]
    got = {(r.path, r.node_id): r for r in ancestors(spark.createDataFrame(rows, "root string, path string, node_id string, parent_node_id string")).collect()}
    assert len(got) == len(parent) + 1
    for n in parent:
        chain, at = [], parent[n]
        while at in parent and len(chain) <= len(parent):
            chain.append(at)
            at = parent[at]
        r = got["a", n]
        if len(chain) > len(parent):
            assert r.cyclic and r.depth is None and r.ancestors is None
        else:
            assert not r.cyclic and r.ancestors == chain[::-1] and r.depth == len(chain)
    assert got["b", "n1"].ancestors == []


def test_only_parents_take_part_in_the_rounds(spark, monkeypatch):
    from codelake.operators import trees

    kept = []
    monkeypatch.setattr(trees, "stored", lambda df, name: kept.append((name, df.count())) or df)
    rows = [("r", "a", "c", None, "C")] + [("r", "a", f"m{i}", "c", f"C.m{i}") for i in range(50)] + [("r", None, "z", "c", "z")]
    nodes = spark.createDataFrame(rows, "root string, path string, node_id string, parent_node_id string, qualified_path string")
    got = {r.node_id: r for r in trees.outline_depth(nodes).collect()}
    assert max(n for _, n in kept) == 1
    assert got["c"].depth == 0 and got["m7"].depth == 1 and got["m7"].ancestors == ["c"] and got["m7"].cyclic is False
    assert got["z"].depth is None and got["z"].ancestors is None and got["z"].cyclic is None


def test_uses_of_a_frequent_name_are_split(spark, corpus, monkeypatch):
    from codelake.plans import index as I

    plans = {}
    real = I.stored
    monkeypatch.setattr(
        I, "stored",
        lambda df, name, *rest: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or real(df, name, *rest),
    )
    tables = I.build_index(corpus({"a.py": "class A:\n    pass\n", "b.py": "class B(A):\n    pass\n"}))
    assert "RebalancePartitions [bucket" in plans["uses"]
    assert {r.name_key for r in tables["uses"].collect()} == {"a", "b"}


def test_short_rows_that_become_files_are_cut_into_small_tasks(spark, tmp_path):
    from codelake import corpora

    keys = spark.range(600_000).select(F.col("id").alias("c_custkey"), F.md5(F.col("id").cast("string")).alias("c_name"))
    keys.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    cut = corpora.table(spark, str(tmp_path), "customer")
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) < 20_000 and sum(sizes) == 600_000


def test_diagnostics_are_worked_out_after_the_files_are_spread(spark):
    from codelake.operators.manifests import parse_diagnostics

    files = spark.range(3).repartition(2).select(
        F.lit("r").alias("root"), F.col("id").cast("string").alias("path"), F.lit("csharp").alias("language"),
        F.when(F.col("id") < 2, F.concat(F.lit("class A "), F.repeat(F.lit("{"), F.col("id").cast("int")))).alias("content"),
    )
    found = parse_diagnostics(files)
    below = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[-1].split("Repartition ")[-1]
    assert "class A" not in below
    assert sorted((r.path, r.code) for r in found.collect()) == [("1", "CS1513"), ("2", "FILE_READ_ERROR")]


def test_content_is_cut_once(corpus):
    """Every cut of a content costs two searches of it, one for the tokens and one for what is between them."""
    lines = corpus({"a.cs": "class A { }\n"}).select(CS.code_lines().alias("lines"))
    assert lines._jdf.queryExecution().optimizedPlan().toString().count('("{3,}+)') == 2


def test_csharp_worker_batches(corpus, spark):
    """Null, empty and undecodable contents keep their rows; steps of a batch are cut by bytes and by number."""
    import pyarrow as pa

    from codelake.functions import parsing

    text = "using A.B;\nclass C : D\n{\n  int x, y;\n  void F(Q q) { new R(); }\n}\n"
    run = parsing._parser({"csharp": CS.Source}, ("nodes", "imports", "hints"), None)
    contents = [None, b"", b"class \xff { }\nclass E { }", *[text.encode()] * 300, b"//" + b"x" * parsing.STEP_BYTES, text.encode()]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(contents))], "file_id": ["f"] * len(contents), "language": ["csharp"] * len(contents), "content": pa.array(contents, pa.binary())})
    made = list(run(iter([batch])))
    assert [len(b) for b in made] == [parsing.STEP_ROWS, 47, 1, 1]
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [str(i) for i in range(len(contents))]
    assert rows[0]["nodes"] is rows[0]["imports"] is rows[0]["hints"] is None
    assert rows[1]["nodes"] == rows[1]["hints"] == rows[303]["nodes"] == []
    assert [n["name"] for n in rows[2]["nodes"]] == ["E"]
    parsed = CS.parse_csharp(corpus({"c.cs": text})).first()
    assert [r.name for r in parsed.nodes] == [n["name"] for n in rows[-1]["nodes"]] == ["C", "x", "y", "F"]
    assert [(r.hint_no, r.kind, r.target_name) for r in parsed.hints] == [
        (1, "Inherits", "D"), (2, "AcceptsParameterType", "Q"), (3, "CreatesInstanceOf", "R"),
    ]
    assert [(r.start_col, r.start_line, r.end_line) for r in (n.span for n in parsed.nodes)] == [(1, 2, 6), (3, 4, 4), (3, 4, 4), (3, 5, 5)]


def test_csharp_file_costs_little():
    """A file of many declarations of every kind: expressions over arrays took some 8 ms of a core for 80 lines."""
    import time

    from codelake.operators.cs_syntax import Source

    text = SHAPES * 2
    start = time.process_time()
    for _ in range(100):
        source = Source(text).structure()
        assert source.nodes("f") and source.hints()
    assert time.process_time() - start <= 0.8 * len(source.lines) / 80


def test_patterns_as_java_reads_them():
    from codelake.operators.cs_syntax import java

    assert not java(r"a.b").search("a b") and java(r"a$").search("a\r\n") and not java(r"a$").search("a\n\n")
    assert java(r"(?m:^)#").search("x\x85#") and not java(r"\w").search("é") and not java(r"\bb").search("éb")
    assert java(r"[.$]\z").search("a.") and not java(r"\s").search("\xa0")


def test_one_worker_pass_reads_all_languages(corpus):
    """The contents of all languages pass through the workers once, and only those that are to be parsed."""
    rows = {"a.py": "class A:\n    pass\n", "b.cs": "class B\n{\n  int x;\n}\n", "c.md": "class C:\n", "bin/d.py": "class D:\n    pass\n"}
    parsed = content_pass(inventory(corpus(rows)))
    assert sum("MapInArrow" in line for line in parsed._jdf.queryExecution().executedPlan().toString().splitlines()) == 1
    got = {r.path: r.nodes and [n.name for n in r.nodes] for r in parsed.collect()}
    assert got == {"a.py": ["A"], "b.cs": ["B", "x"], "c.md": None, "bin/d.py": None}


def test_python_lines_as_java_reads_them(corpus):
    text = "class A(IB, C[int]):\n\tasync def f(self) -> int:\n\n\u3000# not of the block\n\x1c\n        pass\nfrom . import x\nimport a.b as c\r\n"
    files = corpus({"a.py": text})
    nodes = {r.name: r for r in PY.py_declarations(files).collect()}
    assert nodes["f"].display_name == "async f(self) -> int" and list(nodes["f"].modifiers) == ["async"]
    assert (nodes["f"].span.end_line, nodes["A"].span.end_line, nodes["A"].has_children) == (3, 3, True)
    assert [(r.kind, r.target_name) for r in PY.py_base_hints(files).collect()] == [("Implements", "IB"), ("Inherits", "C")]
    assert [(r.kind, r.target, r.alias) for r in PY.py_imports(files).collect()] == [("relative-import", "", "x"), ("import", "a.b", "c")]
