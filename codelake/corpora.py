"""Corpora formed from the test tables.

Each corpus is one SQL text over functions that Spark and DuckDB share, with
``{table}`` for a table. What an operator must answer then follows from the
columns of the tables, without a second parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"


def _lines(*parts: str) -> str:
    return " || ".join(f"{p} || {NL}" for p in parts)


_K = "cast(c_custkey as string)"
_REGION = "replace(r_name, ' ', '_')"

SOURCE_PY = f"""
select 'py_repo' as root,
       'src/' || n_name || '/customer_' || {_K} || '.py' as path,
       {_lines(
           "'import os'",
           "'from base import ' || c_mktsegment || 'Base'",
           "''",
           "'class Customer' || " + _K + " || '(' || c_mktsegment || 'Base' || "
           "case when c_custkey % 4 = 0 then ', IAudit[int]' else '' end || '):'",
           "'    def total(self, x: int) -> int:'",
           "'        return x'",
       )}
       || case when c_custkey % 5 = 0 then {_lines(
           "'    class Meta:'",
           "'        async def load(self):'",
           "'            pass'",
       )} else '' end as content
from {{customer}} join {{nation}} on c_nationkey = n_nationkey
union all
select 'py_repo', 'src/base/' || c_mktsegment || '.py',
       {_lines(
           "'class ' || c_mktsegment || 'Base:'",
           "'    def describe(self):'",
           "'        return None'",
       )}
from (select distinct c_mktsegment from {{customer}}) s
"""

SOURCE_CS = f"""
select 'cs_repo' as root,
       'src/' || {_REGION} || '/Customer' || {_K} || '.cs' as path,
       {_lines(
           "'using System;'",
           "case when c_custkey % 3 <> 0 then 'using Shop.' || " + _REGION + " || ';' else '' end",
           "'namespace App'",
           "chr(123)",
           "'    [Serializable]'",
           "'    public class Customer' || " + _K + " || ' : Account'",
           "'    ' || chr(123)",
           "'        private List<string> tags;'",
           "'        public Missing' || cast(c_custkey % 2 as string) || ' Extra ' || chr(123) "
           "|| ' get; set; ' || chr(125)",
           "'        public Customer' || " + _K + " || '(Account seed) ' || chr(123) || ' ' || chr(125)",
           "'        public Account Copy(int n)'",
           "'        ' || chr(123)",
           "'            return new Account();'",
           "'        ' || chr(125)",
           "'    ' || chr(125)",
           "chr(125)",
       )} as content
from {{customer}} join {{nation}} on c_nationkey = n_nationkey
     join {{region}} on n_regionkey = r_regionkey
union all
select 'cs_repo', 'src/' || {_REGION} || '/Account.cs',
       {_lines(
           "'namespace Shop.' || " + _REGION,
           "chr(123)",
           "'    public class Account'",
           "'    ' || chr(123)",
           "'        public int Id ' || chr(123) || ' get; set; ' || chr(125)",
           "'    ' || chr(125)",
           "chr(125)",
       )}
from {{region}}
"""

# Comments, verbatim and raw strings, heads over several lines, every kind of declaration.
WIDE_CS = '''/* class Ghost {
   } { { */
#region It's "odd
namespace Shop.N%K%
{
    /// <summary>class Doc {</summary>
    public interface IStore<in TKey, out TValue>
        : IBase<TKey>,
          IDisposable
        where TKey : class
    {
        TValue Find(
            TKey key,
            [In] int depth = 3);
        event EventHandler Changed;
    }
    [Serializable,
     Obsolete("x [ {")]
    public sealed class Store%K%<T>
        : BaseStore<Dictionary<string, T>>,
          IStore<string, T>
    {
        private const string Sql = @"select { ""a""
  class Fake {
";
        private readonly string _raw = """
            { class Raw { "quoted" }
            """;
        private static readonly string[] Names = new[]
        {
            "a", "b {"
        };
        public Store%K%(
            string name,
            int size = default(int))
            : base(name)
        {
        }
        [Fact]
        public async Task<List<T>> Load<TArg>(
            TArg arg,
            Func<int, string> map)
            where TArg : struct
        {
            var x = new Order
            {
                A = 1
            };
            return new List<T>();
        }
        public void Load(int a) { }
        public void Load(int a, string b) { }
        void IStore<string, T>.Reset() { }
        int IStore<string, T>.Count => 3;
        public T this[int i]
        {
            get { return default; }
        }
        public event EventHandler<Args> Done, Gone;
        event EventHandler IBase.Fired { add { } remove { } }
        public delegate bool Check<TItem>(
            TItem item);
        public enum Color
        {
            Red,
            Green = 2,
            Blue
        }
        public readonly struct Point : IPoint { }
        char q = '"'; // "unclosed
        string u = $@"a {
 b";
    }
    public record Pair(
        int X,
        int Y) : Base(X);
    public record struct P2(int A);
}
#endregion
'''


def _source(template: str) -> str:
    """A literal source text as SQL; ``%K%`` stands for the key."""
    text = template.replace("'", "''")
    for mark, value in (("{", "chr(123)"), ("}", "chr(125)"), ("\n", NL), ("%K%", _K)):
        text = text.replace(mark, f"' || {value} || '")
    return f"'{text}'"


# Comment lines above move the text down; one file in seven has a brace too many, one too few.
SOURCE_CS_WIDE = f"""
select 'wide' as root, 'src/Wide' || {_K} || '.cs' as path,
       repeat('// class Gone ' || chr(123) || {NL}, cast(c_custkey % 3 as int)) || {_source(WIDE_CS)}
       || case c_custkey % 7 when 1 then chr(125) || {NL} when 2 then 'class Open ' || chr(123) || {NL} else '' end as content
from {{customer}}
"""

SOURCE_ALL = f"select * from ({SOURCE_PY}) p union all select * from ({SOURCE_CS}) c"

_EXT = """case doc_id % 8 when 0 then '.py' when 1 then '.cs' when 2 then '.md' when 3 then '.json'
          when 4 then '.png' when 5 then '.min.js' when 6 then '.tmp' else '' end"""

DOC_FILES = f"""
select source as root,
       lang || '/' || case when doc_id % 11 = 0 then 'bin/' else '' end
         || 'doc_' || cast(doc_id as string) || {_EXT} as path,
       text as content,
       cast(n_chars as bigint) as size_bytes,
       doc_id
from {{documents}}
"""

# Documents without a carriage return, so that LF cuts them in both engines.
SNAP_OLD = """
select source as root, lang || '/doc_' || cast(doc_id as string) || '.txt' as path,
       md5(text) as content_hash
from {documents} where doc_id % 10 <> 0
"""
SNAP_NEW = """
select source as root, lang || '/DOC_' || cast(doc_id as string) || '.txt' as path,
       md5(case when doc_id % 10 = 1 then text || '!' else text end) as content_hash
from {documents} where doc_id % 10 <> 2
"""

# A header per order, then one path per line item; ord leaves room for both.
GIT_DUMP = """
select 'r' || cast(o_custkey % 3 as string) as repo,
       o_orderkey * 16 as ord,
       md5(cast(o_orderkey as string)) || chr(31) || substr(md5(cast(o_orderkey as string)), 1, 7)
         || chr(31) || 'cust' || cast(o_custkey as string)
         || chr(31) || 'cust' || cast(o_custkey as string) || '@example.com'
         || chr(31) || cast(cast(o_orderdate as date) as string) || 'T00:00:00Z'
         || chr(31) || 'bot' || chr(31) || cast(cast(o_orderdate as date) as string) || 'T00:00:00Z'
         || chr(31) || o_orderpriority || chr(31) || 'body' || chr(31)
         || md5(cast(o_orderkey - 1 as string)) as line
from {orders}
union all
select 'r' || cast(o_custkey % 3 as string), o_orderkey * 16 + l_linenumber,
       'parts/' || replace(p_brand, '#', '_') || '/' || cast(p_partkey as string) || '.txt'
from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
"""

GIT_SHOW = """
select o_orderkey as show_id,
       case when o_orderkey % 7 = 0 then 'fatal: bad object'
       else md5(cast(o_orderkey as string)) || chr(31) || substr(md5(cast(o_orderkey as string)), 1, 7)
         || chr(31) || 'cust' || cast(o_custkey as string)
         || chr(31) || 'c' || cast(o_custkey as string) || '@example.com'
         || chr(31) || cast(cast(o_orderdate as date) as string) || 'T00:00:00Z'
         || chr(31) || 'bot' || chr(31) || 'bot@example.com'
         || chr(31) || cast(cast(o_orderdate as date) as string) || 'T12:00:00Z'
         || chr(31) || o_orderpriority || chr(31) || '' || chr(31)
         || md5(cast(o_orderkey - 1 as string)) || ' ' || md5(cast(o_orderkey - 2 as string))
         || chr(10) || chr(10) || 'a/' || o_orderstatus || '.txt' || chr(10) || 'b/x.txt' || chr(10)
       end as text
from {orders}
"""

# Return flag R is a rename, A added, N modified; the line status sets the other side.
STATUS_LINES = """
select 'r' || cast(l_suppkey % 5 as string) as repo,
       case when l_linenumber = 7 then '??' when l_returnflag = 'R' then 'R ' when l_returnflag = 'A'
            then 'A' || case when l_linestatus = 'F' then 'M' else ' ' end
            else ' M' end
       || ' ' || case when l_linenumber <> 7 and l_returnflag = 'R'
                 then '"old/' || cast(l_orderkey as string) || '.txt" -> ' else '' end
       || 'p/' || cast(l_orderkey as string) || '_' || cast(l_linenumber as string) || '.txt' as line,
       l_orderkey, l_linenumber, l_returnflag, l_linestatus
from {lineitem}
"""

# One diff per order with one file and one hunk; a line item is one line of it.
DIFF_TEXT = """
select l_orderkey as diff_id,
       'diff --git a/o/' || cast(l_orderkey as string) || '.txt b/o/' || cast(l_orderkey as string)
       || '.txt' || chr(10)
       || case l_orderkey % 4
            when 0 then 'new file mode 100644' || chr(10)
            when 1 then 'rename from was/' || cast(l_orderkey as string) || '.txt' || chr(10)
                        || 'rename to o/' || cast(l_orderkey as string) || '.txt' || chr(10)
            else 'index 1..2 100644' || chr(10) end
       || '--- a/x' || chr(10) || '+++ b/x' || chr(10)
       || '@@ -10,' || cast(sum(case when l_returnflag <> 'A' then 1 else 0 end) as string)
       || ' +20,' || cast(sum(case when l_returnflag <> 'R' then 1 else 0 end) as string)
       || ' @@ ctx' || chr(10)
       || {join_lines} as text
from {lineitem} group by l_orderkey
"""
_DIFF_LINE = """case l_returnflag when 'A' then '+' when 'R' then '-' else ' ' end
   || cast(l_linenumber as string) || ' part ' || cast(l_partkey as string) || chr(10)"""
JOIN_LINES_SPARK = f"""array_join(transform(array_sort(collect_list(struct(l_linenumber as n,
   l_partkey as p, {_DIFF_LINE} as t))), x -> x.t), '')"""

BUILD_LOGS = """
select user_id as run_id, event_id * 2 as ord,
       case when event_type in ('error', 'purchase')
            then 'src/u' || cast(user_id as string) || '.cs(' || cast(event_id % 97 as string) || ',4): '
                 || case when event_type = 'error' then 'error' else 'warning' end
                 || ' CS' || cast(event_id % 10 as string) || ': ' || event_type || ' seen'
            else 'Compiling ' || event_type || '...' end as line
from {events}
union all
select user_id, event_id * 2 + 1, 'note (' || event_type || ')' from {events}
"""

TEST_LOGS = """
select user_id as run_id,
       'Total tests: ' || cast(count(*) as string) || chr(10)
       || '  Passed: ' || cast(sum(case when event_type = 'view' then 1 else 0 end) as string) || chr(10)
       || case when sum(case when event_type = 'error' then 1 else 0 end) > 0 then
          '  Failed: ' || cast(sum(case when event_type = 'error' then 1 else 0 end) as string)
          || chr(10) else '' end
       || ' Skipped: ' || cast(sum(case when event_type = 'click' then 1 else 0 end) as string) as text
from {events} group by user_id
"""

# Every 50th line is cut short.
AUDIT_JSON = """
select case when event_id % 50 = 0 then substr(j, 1, 40) else j end as value
from (select event_id,
        chr(123) || '"entryId":"e' || cast(event_id as string) || '","requestId":"r'
        || cast(event_id % 100 as string) || '","sessionId":"s' || cast(user_id as string)
        || '","timestamp":"2024-01-' || lpad(cast(1 + event_id % 28 as string), 2, '0') || 'T'
        || lpad(cast(event_id % 24 as string), 2, '0') || ':00:00Z","operationType":"'
        || event_type || '","targetPath":"Src/' || event_type || '/f' || cast(event_id % 7 as string)
        || '.cs","outcome":"' || case when event_id % 9 = 0 then 'Failure' else 'Success' end
        || '","elapsedMs":' || cast(event_id % 1000 as string) || chr(125) as j
      from {events}) t
"""

MANIFESTS = """
select 'parts' as root,
       'proj/' || replace(p_brand, '#', '') || '/P' || cast(p_partkey as string)
       || case when p_size % 5 = 0 then '.Tests' else '' end || '.csproj' as path,
       '<Project Sdk="X"><PropertyGroup><TargetFramework>net' || cast(p_size % 4 + 5 as string)
       || '.0 </TargetFramework>'
       || case when p_size % 2 = 0 then '<OutputType> Exe</OutputType>' else '' end
       || '</PropertyGroup><ItemGroup><PackageReference Include="' || p_type || '" Version="1.'
       || cast(p_size as string) || '" /><PackageReference Include="Common" Version="2.0" />'
       || '<ProjectReference Include="..' || chr(92) || 'P' || cast(p_partkey + 1 as string) || '.csproj" />'
       || case when p_size % 7 = 0 then '<PackageReference Include="xUnit" Version="3" />' else '' end
       || '</ItemGroup></Project>' as content
from {part}
"""

# A solution names a project that exists and one that does not.
_SOLUTION = """
select 'parts' as root, 'proj/sln/' || {solution} || '.sln' as path,
       'Microsoft Visual Studio Solution File' || chr(10)
       || 'Project("' || chr(123) || 'FAE' || chr(125) || '") = "P' || cast(p_partkey as string) || '", "..'
       || chr(92) || replace(p_brand, '#', '') || chr(92) || 'P' || cast(p_partkey as string)
       || case when p_size % 5 = 0 then '.Tests' else '' end || '.csproj", "' || chr(123) || '1' || chr(125)
       || '"' || chr(10) || 'EndProject' || chr(10)
       || 'Project("' || chr(123) || 'FAE' || chr(125) || '") = "Gone", "..' || chr(92) || 'Gone.csproj", "'
       || chr(123) || '2' || chr(125) || '"' || chr(10) as content
"""
# One per supplier whose key is also a part's, and one per part.
SOLUTIONS = _SOLUTION.replace("{solution}", "'S' || cast(s_suppkey as string)") + "from {supplier} join {part} on s_suppkey = p_partkey\n"
SOLUTIONS_ALL = _SOLUTION.replace("{solution}", "'Q' || cast(p_partkey as string)") + "from {part}\n"

CONFIGS = """
select 'conf' as root,
       'c' || cast(c_custkey as string) || '/' || case c_custkey % 11
         when 0 then 'web.config' when 1 then 'app.config' when 2 then 'connection.config'
         when 3 then 'appsettings.dev.json' when 4 then 'tsconfig.json' when 5 then 'data.json'
         when 6 then 'a.yml' when 7 then 'b.YAML' when 8 then 'x.ini' when 9 then '.env.local'
         else 'usersettings.json' end as path,
       case when c_custkey % 22 = 0 then '<connectionStrings>' || c_name || '</connectionStrings>'
            else c_name end as content
from {customer}
"""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


# Tables whose rows become whole files: far more work than their bytes suggest.
SPREAD = {"customer", "documents", "part"}
# Those of them whose rows are short. A task takes this many bytes of them, so that no task runs long at any size.
NARROW, TASK_BYTES, MOST_TASKS = {"customer", "part"}, 1 << 16, 1 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, spread over the cores where its files would be few or long tasks."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in SPREAD:
        return df
    tasks = spark.sparkContext.defaultParallelism
    if name in NARROW:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        tasks = max(tasks, min(size // TASK_BYTES, MOST_TASKS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def corpus(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs a corpus text on the parquet tables."""
    text = text.replace("{join_lines}", JOIN_LINES_SPARK)
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
