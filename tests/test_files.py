"""Inventory, reading, search, rewriting, history and log edge cases."""

import pytest
from pyspark.sql import functions as F

from codelake.operators import history as H
from codelake.operators import inventory as V
from codelake.operators import logs as L
from codelake.operators import reading as RD
from codelake.operators import rewrite as W
from codelake.operators import search as S
from codelake.operators import trees as T
from codelake.operators.paging import page_info, paginate, paginate_after
from codelake.sources.audit_log import read_audit_log, write_audit_log
from codelake.sources.files import decode_content, scan_files


def test_eligibility_ladder(spark):
    cases = {
        "src/a.cs": "Eligible", "src/.env": "Hidden", "src/a~": "Hidden", "a.TMP": "Hidden",
        "img/x.PNG": "Excluded", "Bin/a.cs": "Ignored", "src/bin": "Eligible", "x/target/y/a.rs": "Ignored",
        "F.Designer.cs": "Generated", "AssemblyInfo.cs": "Generated", "app.min.js": "Generated",
    }
    df = spark.createDataFrame([(p, 10, False) for p in cases], "path string, size_bytes long, is_binary boolean")
    got = {r.path: r.eligibility for r in V.classify_eligibility(df).collect()}
    assert got == cases
    big = spark.createDataFrame([("a.cs", 6 << 20, False), ("b.cs", 1, True)], df.schema)
    assert [r.eligibility for r in V.classify_eligibility(big, 5 << 20).orderBy("path").collect()] == ["TooLarge", "Binary"]
    assert [r.eligibility for r in V.classify_eligibility(big).orderBy("path").collect()] == ["Eligible", "Binary"]


def test_whole_files_decide(spark):
    raw = {"nul": b"a" * 10_000 + b"\0", "control": b"a" * 600 + b"\x01" * 600, "text": b"a" * 10_000, "none": None}
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in raw.items()], "path string, raw binary")
    assert {r.path: r.is_binary for r in V.detect_binary(df).collect()} == {"nul": True, "control": True, "text": False, "none": False}
    assert {r.path: r.is_binary for r in V.detect_binary_by_ext(df).collect()} == {"nul": True, "control": False, "text": False, "none": False}
    assert not any(r.is_binary for r in V.detect_binary(df, 512).collect())
    ends = spark.createDataFrame([("x" * 5000 + "\n" + "y\r\n",)], "content string")
    assert V.detect_line_ending(ends).first().line_ending == "mixed"


def test_scan_and_decode(spark, tmp_path):
    files = {
        "a.txt": "plain é".encode(), "sub/b.txt": b"\xef\xbb\xbfbom", "sub/c.txt": b"\xff\xfeh\x00i\x00",
        "sub/d.txt": b"\xfe\xff\x00h\x00i", "e.txt": b"bad \xff byte", "sub/f.txt": b"\xff\xfeh\x00\x00\xd8x",
        "g.dat": b"a\x00b",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path: r for r in decode_content(scan_files(spark, str(tmp_path), "*.txt")).collect()}
    assert rows["a.txt"].content == "plain é" and rows["a.txt"].encoding == "utf-8"
    assert (rows["sub/b.txt"].content, rows["sub/b.txt"].encoding) == ("bom", "utf-8-bom")
    assert (rows["sub/c.txt"].content, rows["sub/d.txt"].content) == ("hi", "hi")
    assert rows["e.txt"].content == "bad � byte"
    assert rows["sub/f.txt"].content.startswith("h�")
    assert rows["a.txt"].size_bytes == len(files["a.txt"])
    listed = {r.path: r.raw for r in scan_files(spark, str(tmp_path), max_bytes=7).collect()}
    assert len(listed) == len(files) and listed["a.txt"] is None and listed["g.dat"] == b"a\x00b"
    kept = scan_files(spark, str(tmp_path), eligible_only=True)
    assert "g.dat" not in [r.path for r in kept.select("path").collect()]


def test_lines(corpus):
    files = corpus({"a": "x\r\ny\rz\n", "b": "", "c": "one", "d": "\n\n"})
    got = [(r.path, r.line, r.text) for r in S.explode_lines(files).orderBy("path", "line").collect()]
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("c", 1, "one"), ("d", 1, ""), ("d", 2, "")]
    counts = {r.path: r.line_count for r in V.count_lines(files).collect()}
    assert counts == {"a": 3, "b": 0, "c": 1, "d": 2}


def test_search_columns_and_marks(corpus):
    files = corpus({"a": "foo xfoo FOO\u0001foo\n$0 a.b [a.b]\n"})
    def cols(df):
        return [(r.line, r.column, r.match) for r in df.orderBy("line", "column").collect()]

    assert cols(S.search_text(files, "foo")) == [(1, 0, "foo"), (1, 5, "foo"), (1, 9, "FOO"), (1, 13, "foo")]
    assert cols(S.search_text(files, "foo", ignore_case=False, whole_word=True)) == [(1, 0, "foo"), (1, 13, "foo")]
    assert cols(S.search_text(files, "a.b")) == [(2, 3, "a.b"), (2, 8, "a.b")]
    assert cols(S.search_regex(files, r"\$\d")) == [(2, 0, "$0")]
    assert cols(S.search_regex(files, r"z*")) and len(cols(S.search_regex(files, r"x?foo"))) == 4
    with pytest.raises(ValueError):
        S.search_regex(files, "(a+)+$")
    with pytest.raises(ValueError):
        S.search_regex(files, "(")
    with pytest.raises(ValueError):
        S.search_text(files, " ")


def test_long_line_search_matches_brute_force(corpus):
    line = "ab" * 5000 + "a"
    got = S.search_text(corpus({"a": line}), "ba").collect()
    assert [r.column for r in got] == list(range(1, 10000, 2))


def test_read_line_range(corpus, spark):
    files = corpus({"a": "1\n2\n3\n4\n", "b": ""})
    ranges = spark.createDataFrame(
        [("repo", "a", 2, 3), ("repo", "a", 4, -1), ("repo", "a", 9, 9), ("repo", "b", 1, 1)],
        "root string, path string, start_line int, end_line int",
    )
    rows = RD.read_line_range(files, ranges).collect()
    assert sorted((r.start_line, r.line, r.text) for r in rows if r.text) == [(2, 2, "2"), (2, 3, "3"), (4, 4, "4")]
    assert sorted(r.error for r in rows if r.error) == [
        "StartLine 1 exceeds file length (0 lines).", "StartLine 9 exceeds file length (4 lines).",
    ]


def test_replace_text_variants(corpus):
    files = corpus({"a": "aXaxA", "b": "none"})
    def run(**kw):
        return {r.path: (r.content, r.replaced) for r in W.replace_text(files, "a", "<$1>", **kw).collect()}

    assert run()["a"] == ("<$1>X<$1>xA", 2)
    assert run(ignore_case=True)["a"] == ("<$1>X<$1>x<$1>", 3)
    assert run(max_n=1)["a"] == ("<$1>XaxA", 1)
    assert run()["b"] == ("none", 0)
    with pytest.raises(ValueError):
        RD.head_tail(files, head=1, tail=1)


def test_status_lines(spark):
    df = spark.createDataFrame(
        [("M  src/a.cs",), ("?? new.txt",), ('R  "old name.txt" -> "new name.txt"',), (" D gone",), ("x",)], "line string"
    )
    rows = {r.path: r for r in H.parse_git_status(df).collect()}
    assert set(rows) == {"src/a.cs", "new.txt", "new name.txt", "gone"}
    assert rows["src/a.cs"].staged and not rows["src/a.cs"].unstaged
    assert rows["new.txt"].untracked and not rows["new.txt"].staged
    assert rows["new name.txt"].old_path == "old name.txt"
    assert rows["gone"].unstaged and not rows["gone"].staged


def test_git_log_boundaries(spark):
    us = "\u001f"
    head = us.join(["{0}", "s", "Ann", "a@x", "2024-05-01T10:00:00+02:00", "Bob", "2024-05-01T10:00:00Z", "subj", "", "p1 p2"])
    lines = ["stray.txt", head.format("c1"), "", "a.txt", " b.txt ", f"bad{us}header", "lost.txt", head.format("c2")]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    for chunk in (2, 1000):
        commits, files = H.parse_git_log(df, chunk=chunk)
        assert sorted(r.sha for r in commits.collect()) == ["c1", "c2"]
        assert sorted((r.sha, r.file) for r in files.collect()) == [("c1", "a.txt"), ("c1", "b.txt")]
    row = commits.filter("sha = 'c1'").first()
    assert list(row.parents) == ["p1", "p2"] and row.author_date.hour == 8


DIFF = """noise
diff --git a/x b/x
index 1..2 100644
--- a/x
+++ b/x
@@ -1,3 +1,3 @@ def f
 keep
-- dashes
+++ plus
 keep2
@@ -10 +11 @@
-old
\\ No newline at end of file
+new
diff --git a/was b/now
similarity index 90%
rename from was
rename to now
diff --git a/n b/n
new file mode 100644
--- /dev/null
+++ b/n
@@ -0,0 +1 @@
+only
"""


def test_diff(spark):
    df = spark.createDataFrame([(1, DIFF)], "diff_id long, text string")
    files = [(r.path, r.change_type, r.old_path, r.lines_added, r.lines_removed) for r in H.parse_diff_files(df).collect()]
    assert files == [
        ("x", "modified", None, 2, 2), ("now", "renamed", "was", 0, 0), ("n", "added", None, 1, 0),
    ]
    lines = [(r.path, r.hunk, r.type, r.text, r.old_line, r.new_line) for r in H.parse_diff_lines(df).collect()]
    assert lines == [
        ("x", 1, "context", "keep", 1, 1), ("x", 1, "removed", "- dashes", 2, None),
        ("x", 1, "added", "++ plus", None, 2), ("x", 1, "context", "keep2", 3, 3),
        ("x", 2, "removed", "old", 10, None), ("x", 2, "added", "new", None, 11),
        ("n", 1, "added", "only", None, 1),
    ]


def test_audit_round_trip(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame(
        [("r1", "A/x.cs", "Search"), ("r2", "b.cs", "WriteFile")], "requestId string, targetPath string, operationType string"
    )
    write_audit_log(rows, path)
    (tmp_path / "audit" / "part-bad.json").write_text('{"requestId": "cut\n\n')
    back = read_audit_log(spark, path)
    assert back.count() == 2 and back.filter("entryId is null or timestamp is null").count() == 0
    assert [r.requestId for r in L.query_audit(back, target_path="a/X").collect()] == ["r1"]


def test_pages(spark):
    df = spark.range(101)
    assert [r.id for r in paginate(df, ["id"], 3, 50).collect()] == [100]
    info = page_info(df, 2, 50).first()
    assert (info.total_items, info.has_more) == (101, True)
    assert paginate(spark.range(500), ["id"], 1, 10_000).count() == 500
    with pytest.raises(ValueError):
        paginate(spark.range(5), ["id"], 0, 10)
    assert [r.id for r in paginate_after(spark.range(9), ["id"], (3,), 2).collect()] == [4, 5]


def test_tree_depth_and_hidden(corpus):
    files = corpus({"a/b/c.txt": "", "a/.git/x": "", "top": ""}).withColumn("size_bytes", F.lit(1))
    paths = [r.path for r in T.dir_tree(files).orderBy("path").collect()]
    assert paths == ["a", "a/b", "a/b/c.txt", "top"]
    top = {r.path: r.has_children for r in T.dir_tree(files, max_depth=1).collect()}
    assert top == {"a": False, "top": None}


def test_test_log_without_failures(spark):
    df = spark.createDataFrame(
        [(1, "Total tests: 3\n Passed: 3\n"), (2, ""), (3, "passed: 1 FAILED: 2")], "run_id long, text string"
    )
    got = [tuple(r) for r in L.test_log_summary(df).orderBy("run_id").collect()]
    assert got == [(1, 3, 3, None, None, 0), (2, None, None, None, None, 0), (3, None, 1, 2, None, 2)]


def test_names_of_several_words(corpus, spark):
    files = corpus({"a.txt": "x Foo.Bar(foo.bar) Foo.Barn Foo.Bar\nFoo . Bar $id"})
    names = spark.createDataFrame([("Foo.Bar",), ("Foo",), ("$id",), (None,), (".",)], "name string")
    got = S.find_references_text(files, names).select("name", "line", "column").collect()
    assert sorted(map(tuple, got)) == [("$id", 2, 10), ("Foo", 1, 2), ("Foo", 1, 19), ("Foo", 1, 28), ("Foo", 2, 0), ("Foo.Bar", 1, 2), ("Foo.Bar", 1, 28)]


def test_search_folds_case_like_the_engine(corpus, spark):
    files = corpus({"a": "ΟΔΟΣΑ", "b": "claſs", "c": "İx ıx"})
    for word in ("ΟΔΟΣ", "οδος", "class", "ix", "ıX"):
        a, b = S.search_text(files, word), S.search_regex(files, word)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert S.search_text(files, "class").count() == 1


def test_java_judges_patterns(corpus, spark):
    files = corpus({"a": "Ab abcabc", "b.min.js": "needle", "c.js": "needle"})
    assert S.search_regex(files, r"\p{Lu}\w+", False).count() == 1
    assert S.search_regex(files, "(ab+c)+").count() == 1
    for bad in ("(?P<n>a)", "(", "((a+))+$", "(a+)+$", "(?:x*)*"):
        with pytest.raises(ValueError):
            S.search_regex(files, bad)
    assert S.grep(files, "needle", include=["*.min.js"]).count() == 1


def test_paths_that_differ_in_case(spark):
    from codelake.plans.refresh import deleted_paths, file_changes

    files = spark.createDataFrame([("r", "A.cs", "1"), ("r", "a.cs", "2")], "root string, path string, content_hash string")
    assert sorted(r["change"] for r in file_changes(files, files).collect()) == ["unchanged", "unchanged"]
    assert [r["path"] for r in deleted_paths(files, files.where("path = 'a.cs'")).collect()] == ["A.cs"]


def test_grep_is_whole_by_default(corpus):
    files = corpus({f"f{i}.txt": "needle\n" * 30 for i in range(5)})
    rows = S.grep(files, "needle").collect()
    assert len(rows) == 150 and not any(r["truncated"] for r in rows)
    for results, per_file, n, cut in ((None, 29, 145, True), (None, 30, 150, False), (149, None, 149, True), (150, None, 150, False), (10, 30, 10, True), (150, 30, 150, False)):
        rows = S.grep(files, "needle", max_results=results, max_per_file=per_file).collect()
        assert len(rows) == n and {r["truncated"] for r in rows} == {cut}
    mixed = corpus({"a": "needle\n", "b": "needle\n" * 3})
    rows = S.grep(mixed, "needle", max_results=10, max_per_file=2, context=1).collect()
    assert sorted((r["path"], r["truncated"]) for r in rows) == [("a", False), ("b", True), ("b", True)]


def test_list_directory_is_whole_by_default(spark):
    tree = spark.range(600).selectExpr(
        "'r' as root", "'' as parent", "concat('f', id) as name", "concat('f', id) as path", "'file' as kind", "id as size_bytes"
    )
    for cap, n, cut in ((None, 600, False), (600, 600, False), (599, 599, True)):
        rows = V.list_directory(tree, cap=cap).collect()
        assert len(rows) == n and {(r["truncated"], r["total_count"]) for r in rows} == {(cut, 600)}


def test_symbols_of_several_words(corpus, spark):
    text = "using Foo.Bar;\nclass Foo.Bar { }\nvar x = Foo.Barn + foo.bar;\nFoo.Bar (1);\nclass  Foo\nFoo.Bar{ }\nnone here\n"
    files = corpus({"a.cs": text, "b.cs": "", "c.cs": "nothing\n"})
    names = spark.createDataFrame([("Foo.Bar",), ("Foo",), (None,), ("..",), ("@Foo",), ("Foo.Bar",)], "name string")

    def found(kind="any", ignore_case=False):
        return sorted((r["name"], r["line"], r["column"], r["match"]) for r in S.search_symbol(files, names, kind, ignore_case).collect())

    places = [(1, 6), (2, 6), (4, 0), (6, 0)]
    assert [x for x in found() if x[0] == "Foo.Bar"] == [("Foo.Bar", *p, "Foo.Bar") for p in places]
    assert [(x[1], x[2]) for x in found() if x[0] == "Foo"] == [(1, 6), (2, 6), (3, 8), (4, 0), (5, 7), (6, 0)]
    refs = sorted((r["name"], r["line"], r["column"]) for r in S.find_references_text(files, names).collect())
    assert refs == [(x[0], x[1], x[2]) for x in found()]
    assert found("class") == [("Foo", 2, 0, "class Foo"), ("Foo", 5, 0, "class  Foo"), ("Foo.Bar", 2, 0, "class Foo.Bar")]
    assert [x for x in found("method") if x[0] == "Foo.Bar"] == [("Foo.Bar", 4, 0, "Foo.Bar (")]
    assert [x for x in found("property") if x[0] == "Foo.Bar"] == [("Foo.Bar", 2, 6, "Foo.Bar {"), ("Foo.Bar", 6, 0, "Foo.Bar{")]
    assert ("Foo.Bar", 3, 19, "foo.bar") in found("any", True)


def test_only_lines_with_a_requested_word_are_unnested(corpus, spark):
    lines = [f"word{i} other{i}" for i in range(5000)]
    lines[77] = "here is Needle()"
    names = spark.createDataFrame([("Needle",)], "name string")
    rows = S._lines_with_words(corpus({"a.txt": "\n".join(lines)}), names.selectExpr("name as _key"), False)
    hits = rows.count()
    assert 1 <= hits < 1000 and [r["line"] for r in S.find_references_text(corpus({"a.txt": "\n".join(lines)}), names).collect()] == [78]


def test_a_batch_is_one_unit(corpus, spark):
    files = corpus({"a": "one\n", "b": "two\n", "c": "three\n"})
    schema = "batch string, root string, path string, ord int, op string, old string, new string, start int, end int"
    edits = [
        ("x", "repo", "a", 1, "replace_text", "one", "1", None, None), ("x", "repo", "b", 1, "append_file", None, "end", None, None),
        ("y", "repo", "a", 1, "write_file", None, "new", None, None), ("y", "repo", "b", 1, "append_file", None, "more", None, None),
        ("y", "repo", "b", 2, "replace_text", "absent", "z", None, None), (None, "repo", "c", 1, "replace_lines", None, "3", 1, 1),
        ("z", "repo", "gone", 1, "write_file", None, "n", None, None), ("z", "repo", "c", 1, "write_file", None, "n", None, None),
    ]
    rows, counts = W.batches(files, spark.createDataFrame(edits, schema))
    got = {(r["batch"], r["path"]): (r["ok"], r["committed"], r["failed_ord"], r["content"]) for r in rows.collect()}
    assert got == {
        ("x", "a"): (True, True, None, "1\n"), ("x", "b"): (True, True, None, "two\nend"),
        ("y", "a"): (True, False, None, "one\n"), ("y", "b"): (False, False, 2, "two\n"),
        (None, "c"): (True, True, None, "3\n"), ("z", "gone"): (False, False, 1, None), ("z", "c"): (True, False, None, "three\n"),
    }
    assert {tuple(r) for r in counts.collect()} == {("x", 2, 0, 2, True), ("y", 1, 1, 0, False), (None, 1, 0, 1, True), ("z", 1, 1, 0, False)}


def test_common_lines_against_the_full_table():
    import random

    from codelake.functions.alignment import common_lines

    rng = random.Random(1)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 8, 30])
        a, b = ([rng.randrange(k) for _ in range(rng.randint(0, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        assert common_lines(a, b, rng.choice([1, 2, 3, 7, 64])) == row[-1]


def _next(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
    return out


def test_moved_lines_count(corpus):
    big = [f"line {i}" for i in range(30_000)]
    before = {"a": "a\nb\nc\n", "same": "x\n", "gone": "1\n2\n", "big": "\n".join(big), "empty": ""}
    after = {"a": "c\na\nb\n", "same": "x\n", "new": "1\n", "big": "\n".join([*big[100:], *big[:100], "more"]), "empty": "y"}
    got = {r["path"]: (r["lines_added"], r["lines_removed"]) for r in W.preview_changes(corpus(before), corpus(after)).collect()}
    assert got == {"a": (1, 1), "gone": (0, 2), "new": (1, 0), "big": (101, 100), "empty": (1, 0)}
