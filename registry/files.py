"""File inventory, reading, rewriting and trees on the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake import corpora as C
from codelake.operators import inventory as V
from codelake.operators import manifests as M
from codelake.operators import reading as RD
from codelake.operators import rewrite as W
from codelake.operators import search as S
from codelake.operators import trees as T
from codelake.functions.storage import shared_folder
from codelake.sources.files import decode_content, scan_files
from registry.common import Registry, big, joined, with_ctes

R_ = Registry()
add = R_.add

DOCS = C.DOC_FILES


def docs(spark, sf):
    return C.corpus(spark, sf, DOCS)


def raw_docs(spark, sf):
    return docs(spark, sf).withColumn("raw", F.col("content").cast("binary"))


def d(body: str) -> str:
    return with_ctes(body, d=DOCS)


# ---- scans and reads --------------------------------------------------------

# The documents written as one file each, below a folder per run.
_TREES: dict = {}


def tree_on_disk(spark, sf) -> str:
    """Writes the text of every document below the shared folder, one file per document."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TREES:
        import uuid

        base = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
        (
            C.table(spark, sf, "documents")
            .select("lang", (F.col("doc_id") % 16).alias("part"),
                    F.regexp_replace("text", r"[\r\n]", " ").alias("value"))
            .repartition("lang", "part")
            .write.partitionBy("lang", "part").text(base)
        )
        _TREES[key] = base
    return _TREES[key]


@add("scan_files", """select lang, cast(part as bigint) as part, cast(sum(octet_length(encode(regexp_replace(text, '[\\r\\n]', ' ', 'g'))) + 1) as bigint) as size_bytes
  from (select *, doc_id % 16 as part from {documents}) group by lang, part""")
def _(spark, sf):
    files = scan_files(spark, tree_on_disk(spark, sf), "*.txt")
    return (
        files.groupBy(
            F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"),
            F.regexp_extract("path", "part=([^/]*)/", 1).cast("bigint").alias("part"),
        )
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )


@add("decode_content", """select doc_id, text as content, case doc_id % 4 when 0 then 'utf-8' when 1 then 'utf-8-bom'
  when 2 then 'utf-16-le' else 'utf-16-be' end as encoding from {documents}""")
def _(spark, sf):
    t = C.table(spark, sf, "documents")
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.encode("text", "UTF-8"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    )
    return decode_content(t.select("doc_id", raw.alias("raw"))).select("doc_id", "content", "encoding")


@add("detect_encoding", """select doc_id, case doc_id % 5 when 0 then 'utf-8' when 1 then 'utf-8-bom'
  when 2 then 'utf-16-le' when 3 then 'utf-16-be' else 'utf-32' end as encoding from {documents}""")
def _(spark, sf):
    t = C.table(spark, sf, "documents")
    mark = F.element_at(
        F.array(*[F.unhex(F.lit(h)) for h in ("", "EFBBBF", "FFFE", "FEFF", "0000FEFF")]),
        (F.col("doc_id") % 5 + 1).cast("int"),
    )
    raw = F.concat(mark, F.col("text").cast("binary"))
    return V.detect_encoding(t.select("doc_id", raw.alias("raw"))).select("doc_id", "encoding")


@add("content_hash", "select doc_id, sha256(text) as sha, md5(text) as md from {documents}")
def _(spark, sf):
    a = RD.content_hash(raw_docs(spark, sf)).withColumnRenamed("content_hash", "sha")
    return RD.content_hash(a, "md5").select(
        "doc_id", "sha", F.col("content_hash").alias("md")
    )


@add("read_many_files", d("""select path, true as success, content, cast(null as varchar) as error from d
  union all select 'gone/' || path, false, null, 'File not found: gone/' || path from d where doc_id % 3 = 0"""))
def _(spark, sf):
    f = docs(spark, sf)
    wanted = f.select("root", "path").unionByName(
        f.filter("doc_id % 3 = 0").select("root", F.concat(F.lit("gone/"), "path").alias("path"))
    )
    return RD.read_many_files(f, wanted, 1 << 30).select("path", "success", "content", "error")


_LINES = """select root, path, doc_id, unnest(l) as text, generate_subscripts(l, 1) as line, len(l) as total from (
  select root, path, doc_id, case when content = '' then [] when right(content, 1) = chr(10) then
    string_split(left(content, length(content) - 1), chr(10)) else string_split(content, chr(10)) end as l from
    (select root, path, doc_id, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as content from d))"""


def dl(body: str) -> str:
    return with_ctes(body, d=DOCS, lines=_LINES)


@add("explode_lines", dl("select path, cast(line as bigint) as line, text from lines"))
def _(spark, sf):
    return S.explode_lines(docs(spark, sf)).select("path", big("line").alias("line"), "text")


@add("read_line_range", dl("""select path, cast(line as bigint) as line, text, cast(total as bigint) as total_lines,
    cast(null as varchar) as error from lines where line >= 2 and (doc_id % 2 = 0 or line <= 4) and total >= 2
  union all select distinct path, cast(null as bigint), null, cast(total as bigint),
    'StartLine 2 exceeds file length (' || cast(total as varchar) || ' lines).' from lines where total < 2"""))
def _(spark, sf):
    f = docs(spark, sf)
    ranges = f.select(
        "root", "path", F.lit(2).alias("start_line"),
        F.when(F.col("doc_id") % 2 == 0, -1).otherwise(4).alias("end_line"),
    )
    return RD.read_line_range(f, ranges).select(
        "path", big("line").alias("line"), "text", big("total_lines").alias("total_lines"), "error"
    )


@add("head_tail", d("""select path, array_to_string(list_slice(string_split(content, chr(10)), 1, 2), chr(10)) as head,
  array_to_string(list_slice(string_split(content, chr(10)), -3, -1), chr(10)) as tail from d"""))
def _(spark, sf):
    f = docs(spark, sf)
    head = RD.head_tail(f, head=2).select("path", F.col("content").alias("head"))
    tail = RD.head_tail(f, tail=3).select("path", F.col("content").alias("tail"))
    return head.join(tail, "path")


@add("number_lines", d("""select path, case when content = '' then '' else array_to_string(list_transform(string_split(content, chr(10)),
  lambda t, i: cast(i as varchar) || ': ' || t), chr(10)) end as content from d"""))
def _(spark, sf):
    return RD.number_lines(docs(spark, sf)).select("path", "content")


# ---- inventory --------------------------------------------------------------

_EXT_OF = "case doc_id % 8 when 0 then '.py' when 1 then '.cs' when 2 then '.md' when 3 then '.json' when 4 then '.png' when 5 then '.js' when 6 then '.tmp' else '' end"
_NAME_OF = "'doc_' || cast(doc_id as varchar) || case doc_id % 8 when 5 then '.min.js' else " + _EXT_OF + " end"


@add("classify_eligibility", d("""select path,
  case when doc_id % 13 = 0 then 'Binary' when doc_id % 8 = 6 then 'Hidden' when doc_id % 8 = 4 then 'Excluded'
    when doc_id % 11 = 0 then 'Ignored' when size_bytes > 5000 then 'TooLarge' when doc_id % 8 = 5 then 'Generated'
    else 'Eligible' end as eligibility,
  case when doc_id % 13 = 0 then 'Binary file detected' when doc_id % 8 = 6 then 'Hidden or temporary file'
    when doc_id % 8 = 4 then 'Extension ''.png'' is excluded' when doc_id % 11 = 0 then 'File is in an ignored directory'
    when size_bytes > 5000 then 'File size ' || format('{:,}', size_bytes) || ' bytes exceeds limit 5,000 bytes'
    when doc_id % 8 = 5 then 'File appears to be auto-generated' end as reason from d"""))
def _(spark, sf):
    f = docs(spark, sf).withColumn("is_binary", F.col("doc_id") % 13 == 0)
    return V.classify_eligibility(f, 5000).select("path", "eligibility", "reason")


# Every second document gets control bytes in front, every third a NUL byte.
@add("detect_binary", """select doc_id, doc_id % 3 = 0 or (doc_id % 2 = 0 and
  floor(40 * 100 / (40 + octet_length(encode(text)))) > 30) as is_binary
  from (select doc_id, regexp_replace(text, '[\\x00-\\x1f]', '', 'g') as text from {documents})""")
def _(spark, sf):
    t = C.table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"[\x00-\x1f]", ""))
    raw = F.concat(
        F.when(F.col("doc_id") % 2 == 0, F.unhex(F.repeat(F.lit("1B"), 40))).otherwise(F.unhex(F.lit(""))),
        F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))),
        F.col("text").cast("binary"),
    )
    return V.detect_binary(t.select("doc_id", raw.alias("raw"))).select("doc_id", "is_binary")


@add("detect_binary_by_ext", d("select path, doc_id % 8 = 4 or doc_id % 5 = 0 as is_binary from d"))
def _(spark, sf):
    f = docs(spark, sf).withColumn(
        "raw",
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.unhex(F.lit("4100")), F.col("content").cast("binary")))
        .otherwise(F.replace("content", F.lit("\0"), F.lit("")).cast("binary")),
    )
    return V.detect_binary_by_ext(f).select("path", "is_binary")


@add("detect_language", d("""select path, case doc_id % 8 when 0 then 'python' when 1 then 'csharp' when 2 then 'markdown'
    when 3 then 'json' when 5 then 'javascript' when 7 then case doc_id % 3 when 0 then 'python' when 1 then 'shell' else 'unknown' end
    else case doc_id % 3 when 0 then 'python' when 1 then 'shell' else 'unknown' end end as language,
  case when doc_id % 8 in (0, 1, 2, 3, 5) then 'extension' when doc_id % 3 < 2 then 'shebang' else 'default' end as detection_method,
  cast(case when doc_id % 8 in (0, 1, 2, 3, 5) then 100 when doc_id % 3 < 2 then 90 else 0 end as bigint) as confidence_pct from d"""))
def _(spark, sf):
    first = (
        F.when(F.col("doc_id") % 3 == 0, "#!/usr/bin/env Python3 -u\n")
        .when(F.col("doc_id") % 3 == 1, "#! /bin/bash\r\n").otherwise(" \n")
    )
    f = docs(spark, sf).withColumn("content", F.concat(first, "content"))
    return V.detect_language(f).select(
        "path", "language", "detection_method",
        F.round(F.col("confidence") * 100).cast("bigint").alias("confidence_pct"),
    )


_STYLED = """select root, path, doc_id, size_bytes, case doc_id % 4 when 1 then replace(c, chr(10), chr(13) || chr(10))
  when 2 then replace(c, chr(10), chr(13)) when 3 then c || chr(13) else c end as content
  from (select *, replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as c from d)"""


def styled(spark, sf):
    f = docs(spark, sf).withColumn("_c", F.regexp_replace("content", "\r\n|\r", "\n"))
    k = F.col("doc_id") % 4
    return f.withColumn(
        "content",
        F.when(k == 1, F.replace("_c", F.lit("\n"), F.lit("\r\n")))
        .when(k == 2, F.replace("_c", F.lit("\n"), F.lit("\r")))
        .when(k == 3, F.concat("_c", F.lit("\r")))
        .otherwise(F.col("_c")),
    ).drop("_c")


def st(body: str) -> str:
    return with_ctes(body, d=DOCS, s=_STYLED.replace("{text}", "content"))


_LE = f"""case when contains(content, chr(13) || chr(10)) and not contains(replace(content, chr(13) || chr(10), ''), chr(13))
    and not contains(replace(content, chr(13) || chr(10), ''), chr(10)) then 'crlf'
  when contains(content, chr(13)) and not contains(content, chr(10)) then 'cr'
  when not contains(content, chr(13)) then 'lf' else 'mixed' end"""
_LC = """cast(len(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)))
  - case when content = '' or right(content, 1) in (chr(10), chr(13)) then 1 else 0 end as bigint)"""


@add("detect_line_ending", st(f"select path, {_LE} as line_ending from s"))
def _(spark, sf):
    return V.detect_line_ending(styled(spark, sf)).select("path", "line_ending")


@add("count_lines", st(f"select path, {_LC} as line_count from s"))
def _(spark, sf):
    return V.count_lines(styled(spark, sf)).select("path", big("line_count").alias("line_count"))


@add("file_metadata", st(f"""select path, {_NAME_OF} as name, {_EXT_OF} as extension, size_bytes,
  case when size_bytes <= 5000 then 'utf-8' end as encoding, case when size_bytes <= 5000 then {_LE} end as line_ending,
  case when size_bytes <= 5000 then {_LC} end as line_count from s"""))
def _(spark, sf):
    f = styled(spark, sf).withColumn("raw", F.col("content").cast("binary"))
    return V.file_metadata(f, 5000).drop("root").withColumn("line_count", big("line_count"))


@add("mime_type", d("select path, case when doc_id % 8 = 4 then 'image/png' else 'application/octet-stream' end as mime_type from d"))
def _(spark, sf):
    return V.mime_type(docs(spark, sf)).select("path", "mime_type")


@add("blocked_paths", d("select path from d where doc_id % 11 <> 0 and doc_id % 8 in (0, 1, 7)"))
def _(spark, sf):
    return V.blocked_paths(docs(spark, sf), allow=[".py", ".CS"]).select("path")


@add("glob_match", d("select path from d where (lang = 'fr' or lang = 'en' and doc_id % 8 = 3) and doc_id % 11 <> 0".replace("lang", "split_part(path, '/', 1)")))
def _(spark, sf):
    return V.glob_match(docs(spark, sf), ["FR/*", "?N/*.json"], ["*/bin/*"]).select("path")


@add("wildcard_match", d(f"select path from d where {_NAME_OF} like 'doc__.%' or {_NAME_OF} like 'doc_1%.py'".replace("like 'doc__.%'", "similar to 'doc_[0-9][.].*'").replace("like 'doc_1%.py'", "similar to 'doc_1.*[.]py'")))
def _(spark, sf):
    f = docs(spark, sf).withColumn("name", F.substring_index("path", "/", -1))
    return (
        V.wildcard_match(f, "name", "DOC_?.*").select("path")
        .unionByName(V.wildcard_match(f, "name", "doc_1*.py", False).select("path"))
        .distinct()
    )


@add("pattern_kind", """select p_partkey, case p_partkey % 4 when 0 then 'substring' when 1 then 'wildcard' when 2 then 'regex'
  else 'substring' end as pattern_kind from {part}""")
def _(spark, sf):
    p = C.table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    pattern = (
        F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_name", F.lit("*.c?")))
        .when(k == 2, F.concat(F.lit("^"), "p_name", F.lit(r"\d+$"))).otherwise(F.concat("p_name", F.lit("(")))
    )
    return V.pattern_kind(p.select("p_partkey", pattern.alias("pattern"))).select("p_partkey", "pattern_kind")


@add("search_file_names", d(f"""select 'DOC_1' as pattern, path from d where contains({_NAME_OF}, 'doc_1')
  union all select 'doc_?.*', path from d where regexp_matches({_NAME_OF}, '^doc_.[.].*$')
  union all select '_[0-9]*7.py$', path from d where regexp_matches({_NAME_OF}, '_[0-9]*7.py$')"""))
def _(spark, sf):
    return V.search_file_names(docs(spark, sf), ["DOC_1", "doc_?.*", "_[0-9]*7.py$"]).select("pattern", "path")


@add("search_by_extension", d(f"select path, {_NAME_OF} as name, {_EXT_OF} as extension, size_bytes from d where doc_id % 8 in (1, 5)"))
def _(spark, sf):
    return V.search_by_extension(docs(spark, sf), ["CS", ".js"]).drop("root")


_TREE = """select distinct root, path, kind, size_bytes from (
  select root, path, 'file' as kind, size_bytes from d
  union all select root, split_part(path, '/', 1), 'directory', null from d
  union all select root, split_part(path, '/', 1) || '/bin', 'directory', null from d where doc_id % 11 = 0)"""


def tr(body: str) -> str:
    return with_ctes(body, d=DOCS, t=_TREE)


def tree(spark, sf, **kw):
    return T.dir_tree(docs(spark, sf), **kw)


@add("dir_tree", tr("""select root, path, string_split(path, '/')[-1] as name,
  array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') as parent, kind,
  cast(len(string_split(path, '/')) - 1 as bigint) as depth, case when kind = 'directory' then len(string_split(path, '/')) < 2 end as has_children, size_bytes
  from t where len(string_split(path, '/')) <= 2"""))
def _(spark, sf):
    return tree(spark, sf, max_depth=2).withColumn("depth", big("depth"))


@add("tree_totals", tr("""select root, directory, count(*) filter (kind = 'file')::bigint as file_count,
  coalesce(sum(size_bytes), 0)::bigint as total_bytes, count(*) filter (kind = 'directory')::bigint as directory_count from (
    select root, kind, size_bytes, '' as directory from t
    union all select root, kind, size_bytes, split_part(path, '/', 1) from t where contains(path, '/')
    union all select root, kind, size_bytes, split_part(path, '/', 1) || '/bin' from t where path like '%/bin/%')
  group by 1, 2"""))
def _(spark, sf):
    return T.tree_totals(docs(spark, sf))


@add("list_directory", tr("""select root, parent, name, truncated, total_count from (
  select root, parent, name, kind, size_bytes, total_count,
    count(*) over (partition by root, parent) > 10 as truncated,
    row_number() over (partition by root, parent order by coalesce(size_bytes, -1) desc, name) as rn from (
    select root, array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') as parent, string_split(path, '/')[-1] as name, path, kind, size_bytes,
      count(*) over (partition by root, array_to_string(list_slice(string_split(path, '/'), 1, -2), '/'))::bigint as total_count
      from t) where path not like '%/bin' and path not like '%/bin/%' and regexp_matches(name, '^(doc_1.*|en|fr)$')) where rn <= 10"""))
def _(spark, sf):
    t = tree(spark, sf)
    # Top-level folders `en`, `fr` and the files doc_1*.
    cols = ["root", "parent", "name", "truncated", "total_count"]
    return (
        V.list_directory(t, t.filter("parent <> ''").select("root", "parent"), "DOC_1*", "size", 10).select(*cols)
        .unionByName(V.list_directory(t, t.filter("parent = ''").select("root", "parent"), "en", "size", 10).select(*cols))
        .unionByName(V.list_directory(t, t.filter("parent = ''").select("root", "parent"), "fr", "size", 10).select(*cols))
    )


@add("find_path", tr("""select 'name' as mode, path, kind, case kind when 'file' then 'file name match' else 'directory name match' end as match_reason
    from t where contains(string_split(path, '/')[-1], 'n')
  union all select 'path_fragment', path, kind, 'path fragment match' from t where contains(path, 'bin/doc_1')
  union all select 'exact_path', path, kind, 'exact path match' from t where path = 'en/bin'
  union all select 'prefix', path, kind, 'path prefix match' from t where starts_with(path, 'de/')
  union all select 'regex', path, kind, 'regex match' from t where regexp_matches(string_split(path, '/')[-1], '^b.n$')"""))
def _(spark, sf):
    t = tree(spark, sf)
    out = None
    for mode, q, m in (
        ("name", "N", "name"), ("path_fragment", "BIN/doc_1", "path_fragment"),
        ("exact_path", "EN/bin", "exact_path"), ("prefix", "de/", "prefix"), ("regex", "^B.n$", "name"),
    ):
        part = V.find_path(t, q, m).select(F.lit(mode).alias("mode"), "path", "kind", "match_reason")
        out = part if out is None else out.unionByName(part)
    return out


# ---- manifests --------------------------------------------------------------


@add("project_manifests", """select path, name, 'csproj' as type, 'net' || cast(p_size % 4 + 5 as varchar) || '.0' as target_framework,
  case when p_size % 2 = 0 then 'Exe' end as output_type,
  p_type || ' 1.' || cast(p_size as varchar) || '|Common 2.0' || case when p_size % 7 = 0 then '|xUnit 3' else '' end as package_refs,
  '../P' || cast(p_partkey + 1 as varchar) || '.csproj' as project_refs, p_size % 5 = 0 or p_size % 7 = 0 as is_test
  from (select *, 'P' || cast(p_partkey as varchar) || case when p_size % 5 = 0 then '.Tests' else '' end as name,
    'proj/' || replace(p_brand, '#', '') || '/P' || cast(p_partkey as varchar) || case when p_size % 5 = 0 then '.Tests' else '' end || '.csproj' as path from {part})""")
def _(spark, sf):
    m = M.project_manifests(C.corpus(spark, sf, C.MANIFESTS))
    return m.drop("root").withColumn("package_refs", joined("package_refs")).withColumn(
        "project_refs", joined("project_refs")
    )


@add("test_projects", "select 'P' || cast(p_partkey as varchar) || case when p_size % 5 = 0 then '.Tests' else '' end as name from {part} where p_size % 5 = 0 or p_size % 7 = 0")
def _(spark, sf):
    return M.test_projects(M.project_manifests(C.corpus(spark, sf, C.MANIFESTS))).select("name")


@add("solution_projects", """select 'proj/sln/S' || cast(s_suppkey as varchar) || '.sln' as solution, 'P' || cast(p_partkey as varchar) as name,
  'proj/' || replace(p_brand, '#', '') || '/P' || cast(p_partkey as varchar) || case when p_size % 5 = 0 then '.Tests' else '' end || '.csproj' as path
  from {supplier} join {part} on s_suppkey = p_partkey""")
def _(spark, sf):
    f = C.corpus(spark, sf, C.MANIFESTS).unionByName(C.corpus(spark, sf, C.SOLUTIONS))
    return M.solution_projects(f).drop("root")


@add("solution_projects_whole", """select 'proj/sln/Q' || cast(p_partkey as varchar) || '.sln' as solution, 'P' || cast(p_partkey as varchar) as name,
  'proj/' || replace(p_brand, '#', '') || '/P' || cast(p_partkey as varchar) || case when p_size % 5 = 0 then '.Tests' else '' end || '.csproj' as path
  from {part}""")
def _(spark, sf):
    """Solutions for all parts; ``solution_projects`` is the case of the parts with a supplier's key."""
    f = C.corpus(spark, sf, C.MANIFESTS).unionByName(C.corpus(spark, sf, C.SOLUTIONS_ALL))
    return M.solution_projects(f).drop("root")


@add("config_files", """select c_custkey::bigint as c_custkey, case c_custkey % 11 when 0 then case when c_custkey % 22 = 0 then 'connection_strings' else 'app_settings' end
  when 1 then 'app_settings' when 2 then 'connection_strings' when 3 then 'json' when 4 then 'json' when 6 then 'yaml' when 7 then 'yaml'
  when 8 then 'ini' when 9 then 'other' else 'json' end as config_class from {customer} where c_custkey % 11 <> 5""")
def _(spark, sf):
    return M.config_files(C.corpus(spark, sf, C.CONFIGS)).select(
        F.regexp_extract("path", "^c([0-9]+)/", 1).cast("bigint").alias("c_custkey"), "config_class"
    )


@add("parse_diagnostics", """select c_custkey, case c_custkey % 4 when 0 then 'FILE_READ_ERROR' when 1 then 'CS1513' else 'CS1022' end as code,
  case c_custkey % 4 when 0 then 'Error' else 'Warning' end as severity,
  case c_custkey % 4 when 0 then 'Indexing' else 'ParserAdapter' end as source from {customer} where c_custkey % 4 < 3""")
def _(spark, sf):
    k = F.col("c_custkey") % 4
    f = C.table(spark, sf, "customer").select(
        F.lit("r").alias("root"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("path"),
        F.lit("csharp").alias("language"),
        F.when(k == 0, F.lit(None)).when(k == 1, F.lit("class A {\n { } // }\n"))
        .when(k == 2, F.lit("class A { } }\n")).otherwise(F.lit('class A { string s = "{"; }\n')).alias("content"),
    )
    return M.parse_diagnostics(f).select(
        F.substring("path", 2, 20).cast("bigint").alias("c_custkey"), "code", "severity", "source"
    )


@add("code_structure", """select path, cast(line as bigint) as line, kind, name, namespace, type_name, is_public, is_static from (
  select ks, 'src/' || reg || '/Customer' || ks || '.cs' as path, k, reg from
    (select c_custkey as k, cast(c_custkey as varchar) as ks, replace(r_name, ' ', '_') as reg from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey)) c,
  lateral (select 1 as line, 'using' as kind, 'System' as name, null as namespace, null as type_name, null::boolean as is_public, null::boolean as is_static
    union all select 2, 'using', 'Shop.' || c.reg, null, null, null, null where c.k % 3 <> 0
    union all select 3, 'namespace', 'App', null, null, null, null
    union all select 6, 'class', 'Customer' || c.ks, 'App', null, null, null
    union all select 11, 'method', 'Copy', 'App', 'Customer' || c.ks, true, false) x
  union all select 'src/' || reg || '/Account.cs', line, kind, name, namespace, null, null, null from (select replace(r_name, ' ', '_') as reg from {region}) r,
    lateral (select 1::bigint as line, 'namespace' as kind, 'Shop.' || r.reg as name, null as namespace union all select 3, 'class', 'Account', 'Shop.' || r.reg) y""")
def _(spark, sf):
    return M.code_structure(C.corpus(spark, sf, C.SOURCE_CS)).drop("root").withColumn("line", big("line"))


# ---- rewriting --------------------------------------------------------------


@add("replace_text", d("""select path, 'all' as variant, replace(content, 'an', '<A>') as content,
    cast((length(content) - length(replace(content, 'an', ''))) / 2 as bigint) as replaced from d
  union all select path, 'two', case when len(p) <= 3 then array_to_string(p, '<A>')
      else p[1] || '<A>' || p[2] || '<A>' || array_to_string(list_slice(p, 3, len(p)), 'an') end,
    cast(least(len(p) - 1, 2) as bigint) from (select path, string_split(content, 'an') as p from d)"""))
def _(spark, sf):
    f = docs(spark, sf)
    cols = ["path", "variant", "content", big("replaced").alias("replaced")]
    return (
        W.replace_text(f, "an", "<A>").withColumn("variant", F.lit("all")).select(*cols)
        .unionByName(W.replace_text(f, "an", "<A>", max_n=2).withColumn("variant", F.lit("two")).select(*cols))
    )


def seq_edits(f):
    def edit(n, old, new):
        return F.struct(F.lit(n).alias("ord"), old.alias("old"), new.alias("new"))

    key = F.concat(F.lit("#"), F.col("doc_id").cast("string"))
    return f.select(
        "root", "path",
        F.inline(F.array(edit(2, F.lit("e"), F.lit("EE")), edit(1, F.lit("a"), F.lit("e")),
                         edit(3, F.lit("EE"), key))),
    )


@add("edit_sequence", d("""select path, ok, case when ok then replace(replace(replace(content, 'a', 'e'), 'e', 'EE'), 'EE', '#' || cast(doc_id as varchar)) else content end as content,
  case when not ok then 1::bigint end as failed_ord from (select *, contains(content, 'a') as ok from d)"""))
def _(spark, sf):
    f = docs(spark, sf)
    return W.edit_sequence(f, seq_edits(f)).select("path", "ok", "content", big("failed_ord").alias("failed_ord"))


def range_edits(f):
    return f.select(
        "root", "path", F.lit(2).alias("start"), F.lit(3).alias("end"),
        F.concat(F.lit("new\r\n"), F.col("doc_id").cast("string")).alias("new"),
    )


_REPLACED = """array_to_string(list_concat(list_slice(l, 1, 1), ['new', cast(doc_id as varchar)], case when len(l) > 3 then list_slice(l, 4, len(l)) else [] end), chr(10)) || chr(10)"""
_ARR = "select root, path, doc_id, content, coalesce((select list(text order by line) from lines x where x.root = d.root and x.path = d.path), []) as l from d"


def da(body: str) -> str:
    return with_ctes(body, d=DOCS, lines=_LINES, a=_ARR)


@add("replace_line_range", da(f"""select path, len(l) >= 2 as ok, case when len(l) < 2 then content else {_REPLACED} end as content,
  cast(case when len(l) < 2 then 0 else least(3, len(l)) - 1 end as bigint) as affected from a"""))
def _(spark, sf):
    f = docs(spark, sf)
    return W.replace_line_range(f, range_edits(f)).select(
        "path", "ok", "content", big("affected").alias("affected")
    )


@add("append_content", d("""select path, content || case when content = '' or right(content, 1) in (chr(10), chr(13)) then '' else chr(10) end || 'END' as content from d"""))
def _(spark, sf):
    return W.append_content(docs(spark, sf), "END").select("path", "content")


@add("normalize_line_endings", st("""select path, 'crlf' as style, replace(lf, chr(10), chr(13) || chr(10)) as content from (select *, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as lf from s)
  union all select path, 'auto', case when contains(content, chr(13) || chr(10)) then replace(lf, chr(10), chr(13) || chr(10)) when contains(content, chr(13)) then replace(lf, chr(10), chr(13)) else lf end
  from (select *, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as lf from s)"""))
def _(spark, sf):
    f = styled(spark, sf)
    out = None
    for style in ("crlf", "auto"):
        part = W.normalize_line_endings(f, style).select("path", F.lit(style).alias("style"), "content")
        out = part if out is None else out.unionByName(part)
    return out


@add("preview_changes", da("""select path, sum(case when n > o then n - o else 0 end)::bigint as lines_added, sum(case when o > n then o - n else 0 end)::bigint as lines_removed from (
  select path, text, sum(o) as o, sum(n) as n from (
    select path, unnest(l) as text, 1 as o, 0 as n from a where len(l) >= 2
    union all select path, unnest(list_concat(list_slice(l, 1, 1), ['new', cast(doc_id as varchar)], case when len(l) > 3 then list_slice(l, 4, len(l)) else [] end)), 0, 1 from a where len(l) >= 2)
  group by 1, 2) group by 1"""))
def _(spark, sf):
    f = docs(spark, sf)
    after = W.replace_line_range(f, range_edits(f))
    return W.preview_changes(f, after).drop("root")


def mixed_edits(f):
    def edit(n, op, old="", new="", start=0, end=0):
        return F.struct(
            F.lit(n).alias("ord"), F.lit(op).alias("op"), F.lit(old).alias("old"),
            F.lit(new).alias("new"), F.lit(start).alias("start"), F.lit(end).alias("end"),
        )

    edits = F.inline(
        F.array(edit(1, "append_file", new="tail"), edit(2, "replace_text", "tail", "TAIL"),
                edit(3, "replace_lines", new="two", start=2, end=2))
    )
    known = f.select("root", "path", edits)
    gone = f.filter("doc_id % 5 = 0").select("root", F.concat(F.lit("gone/"), "path").alias("path"), edits)
    return known.unionByName(gone)


@add("batch_edits", da("""select path, true as ok, cast(null as bigint) as failed_ord,
    array_to_string(list_concat(list_slice(m, 1, 1), ['two'], case when len(m) > 2 then list_slice(m, 3, len(m)) else [] end), chr(10)) || chr(10) as content
    from (select path, list_transform(list_concat(l, ['tail']), lambda x: replace(x, 'tail', 'TAIL')) as m from a) where len(m) >= 2
  union all select path, false, 3, content from a where len(l) = 0
  union all select 'gone/' || path, false, 1, null from a where doc_id % 5 = 0"""))
def _(spark, sf):
    f = docs(spark, sf)
    return W.batch_edits(f, mixed_edits(f)).select("path", "ok", big("failed_ord").alias("failed_ord"), "content")


# Batches by the remainder of the id: those of every fifth remainder name a file that is not there.
_BATCHES = """r as (select doc_id % 35 as batch, path, len(l) > 0 as ok, content as original,
    case when len(l) > 0 then array_to_string(list_concat(list_slice(m, 1, 1), ['two'], case when len(m) > 2 then list_slice(m, 3, len(m)) else [] end), chr(10)) || chr(10) end as edited
    from (select doc_id, path, l, content, list_transform(list_concat(l, ['tail']), lambda x: replace(x, 'tail', 'TAIL')) as m from a)
  union all select doc_id % 35, 'gone/' || path, false, null, null from a where doc_id % 5 = 0),
f as (select batch, bool_and(ok) as committed, count_if(ok) as good, count_if(not ok) as bad from r group by 1)"""


def batched(spark, sf):
    f = docs(spark, sf)
    number = F.regexp_extract("path", r"doc_(\d+)", 1).cast("bigint")
    return W.batches(f, mixed_edits(f).withColumn("batch", number % 35))


@add("batches", da("select batch, path, ok, committed, case when committed then edited else original end as content from r join f using (batch)").replace("\nselect batch", ",\n" + _BATCHES + "\nselect batch", 1))
def _(spark, sf):
    return batched(spark, sf)[0].select("batch", "path", "ok", "committed", "content")


@add("batch_counts", da("select batch, good::bigint as succeeded_files, bad::bigint as failed_files, (case when committed then 3 * good else 0 end)::bigint as applied_edits, committed from f").replace("\nselect batch", ",\n" + _BATCHES + "\nselect batch", 1))
def _(spark, sf):
    return batched(spark, sf)[1]
