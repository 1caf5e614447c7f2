"""History, logs, audit, snapshots and refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelake import corpora as C
from codelake import schemas
from codelake.functions.storage import shared_folder, stored
from codelake.operators import history as H
from codelake.operators import logs as L
from codelake.operators import paging as P
from codelake.plans import index as I
from codelake.plans import refresh as X
from codelake.sources import snapshots as SN
from codelake.sources.audit_log import parse_audit, read_audit_log, write_audit_log
from codelake.streaming.refresh import refresh_stream
from registry.common import Registry, big, index_of, joined, with_ctes
from registry.expected import expect

R_ = Registry()
add = R_.add


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- history ----------------------------------------------------------------

_COMMITS = """select 'r' || cast(o_custkey % 3 as varchar) as repo, o_orderkey, o_custkey, md5(cast(o_orderkey as varchar)) as sha,
  'cust' || cast(o_custkey as varchar) as author, cast(o_orderdate as date) as day, o_orderpriority as subject from {orders}"""
_FILES = """select l_orderkey, 'parts/' || replace(p_brand, '#', '_') || '/' || cast(p_partkey as varchar) || '.txt' as file
  from {lineitem} join {part} on l_partkey = p_partkey"""


def log(spark, sf):
    return H.parse_git_log(C.corpus(spark, sf, C.GIT_DUMP), ["repo"])


@add("parse_git_log", with_ctes("""select repo, sha, substr(sha, 1, 7) as short_sha, author, author || '@example.com' as email, cast(day as varchar) as day, subject,
  md5(cast(o_orderkey - 1 as varchar)) as parents, (select count(*) from f where f.l_orderkey = c.o_orderkey)::bigint as file_count,
  (select max(file) from f where f.l_orderkey = c.o_orderkey) as last_file from c""", c=_COMMITS, f=_FILES))
def _(spark, sf):
    commits, files = log(spark, sf)
    per = files.groupBy("repo", "sha").agg(F.count("*").alias("file_count"), F.max("file").alias("last_file"))
    return commits.join(per, ["repo", "sha"], "left").select(
        "repo", "sha", "short_sha", "author", "email", F.date_format("author_date", "yyyy-MM-dd").alias("day"),
        "subject", joined("parents").alias("parents"), F.coalesce("file_count", F.lit(0)).alias("file_count"), "last_file",
    )


@add("filter_commits", with_ctes("""select repo, sha from c where author like '%cust1%' and day between date '1996-01-01' and date '1999-12-31'
  and exists (select 1 from f where f.l_orderkey = c.o_orderkey and starts_with(file, 'parts/Brand_1/'))""", c=_COMMITS, f=_FILES))
def _(spark, sf):
    commits, files = log(spark, sf)
    return H.filter_commits(
        commits, files, "cust1", F.to_timestamp(F.lit("1996-01-01")), F.to_timestamp(F.lit("1999-12-31")),
        "parts\\Brand_1", ["repo"],
    ).select("repo", "sha")


@add("recent_commits", with_ctes("select repo, sha from c order by day desc, sha limit 5000", c=_COMMITS))
def _(spark, sf):
    return H.recent_commits(log(spark, sf)[0], 5000).select("repo", "sha")


@add("parse_git_show", """select o_orderkey as show_id, o_orderkey % 7 = 0 as not_found,
  case when o_orderkey % 7 <> 0 then md5(cast(o_orderkey as varchar)) end as sha,
  case when o_orderkey % 7 <> 0 then 'bot@example.com' end as committer_email,
  case when o_orderkey % 7 <> 0 then o_orderpriority end as subject,
  case when o_orderkey % 7 <> 0 then cast(cast(o_orderdate as date) as varchar) || ' 12' end as committed,
  case when o_orderkey % 7 <> 0 then md5(cast(o_orderkey - 1 as varchar)) || '|' || md5(cast(o_orderkey - 2 as varchar)) end as parents,
  case when o_orderkey % 7 <> 0 then 'a/' || o_orderstatus || '.txt|b/x.txt' end as files from {orders}""")
def _(spark, sf):
    return H.parse_git_show(C.corpus(spark, sf, C.GIT_SHOW)).select(
        "show_id", "not_found", "sha", "committer_email", "subject",
        F.date_format("committer_date", "yyyy-MM-dd HH").alias("committed"),
        joined("parents").alias("parents"), joined("files").alias("files"),
    )


def status(spark, sf):
    return H.parse_git_status(C.corpus(spark, sf, C.STATUS_LINES))


_STATUS = """select 'r' || cast(l_suppkey % 5 as varchar) as repo, 'p/' || cast(l_orderkey as varchar) || '_' || cast(l_linenumber as varchar) || '.txt' as path,
  case when l_linenumber <> 7 and l_returnflag = 'R' then 'old/' || cast(l_orderkey as varchar) || '.txt' end as old_path,
  case when l_linenumber = 7 then '?' when l_returnflag = 'R' then 'R' when l_returnflag = 'A' then 'A' else ' ' end as index_status,
  case when l_linenumber = 7 then '?' when l_returnflag = 'R' then ' ' when l_returnflag = 'A' then case when l_linestatus = 'F' then 'M' else ' ' end else 'M' end as worktree_status,
  l_linenumber = 7 as untracked from {lineitem}"""


@add("parse_git_status", with_ctes("""select repo, path, old_path, index_status, worktree_status, not untracked and index_status <> ' ' as staged,
  not untracked and worktree_status <> ' ' as unstaged, untracked from s""", s=_STATUS))
def _(spark, sf):
    return status(spark, sf).select(
        "repo", "path", "old_path", "index_status", "worktree_status", "staged", "unstaged", "untracked"
    )


@add("git_status_counts", with_ctes("""select repo, count(*) filter (not untracked and index_status <> ' ')::bigint as staged_count,
  count(*) filter (not untracked and worktree_status <> ' ')::bigint as unstaged_count, count(*) filter (untracked)::bigint as untracked_count,
  true as has_changes from s group by 1""", s=_STATUS))
def _(spark, sf):
    return H.git_status_counts(status(spark, sf), ["repo"])


_DIFF = """select l_orderkey as diff_id, 'o/' || cast(l_orderkey as varchar) || '.txt' as path,
  case l_orderkey % 4 when 0 then 'added' when 1 then 'renamed' else 'modified' end as change_type,
  case when l_orderkey % 4 = 1 then 'was/' || cast(l_orderkey as varchar) || '.txt' end as old_path,
  count(*) filter (l_returnflag = 'A')::bigint as added, count(*) filter (l_returnflag = 'R')::bigint as removed,
  '@@ -10,' || cast(count(*) filter (l_returnflag <> 'A') as varchar) || ' +20,' || cast(count(*) filter (l_returnflag <> 'R') as varchar) || ' @@ ctx' || chr(10) ||
  string_agg(case l_returnflag when 'A' then '+' when 'R' then '-' else ' ' end || cast(l_linenumber as varchar) || ' part ' || cast(l_partkey as varchar), chr(10)
    order by l_linenumber, l_partkey, case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end) as patch
  from {lineitem} group by l_orderkey"""


def diffs(spark, sf):
    return C.corpus(spark, sf, C.DIFF_TEXT)


@add("parse_diff_files", with_ctes("select diff_id, path, change_type, old_path, added, removed, 1::bigint as hunk_count from d", d=_DIFF))
def _(spark, sf):
    return H.parse_diff_files(diffs(spark, sf)).select(
        "diff_id", "path", "change_type", "old_path", big("lines_added").alias("added"),
        big("lines_removed").alias("removed"), big("hunk_count").alias("hunk_count"),
    )


@add("parse_diff_lines", with_ctes("""select diff_id, ord::bigint as ord, type, text, case when type <> 'added' then 9 + count(*) filter (type <> 'added') over w end::bigint as old_line,
  case when type <> 'removed' then 19 + count(*) filter (type <> 'removed') over w end::bigint as new_line from (
    select l_orderkey as diff_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, s) as ord,
      case s when '+' then 'added' when '-' then 'removed' else 'context' end as type, cast(l_linenumber as varchar) || ' part ' || cast(l_partkey as varchar) as text
    from (select *, case l_returnflag when 'A' then '+' when 'R' then '-' else ' ' end as s from {lineitem}))
  window w as (partition by diff_id order by ord rows unbounded preceding)""", one="select 1 as x"))
def _(spark, sf):
    return H.parse_diff_lines(diffs(spark, sf)).select(
        "diff_id", big("ord").alias("ord"), "type", "text", big("old_line").alias("old_line"), big("new_line").alias("new_line")
    )


@add("diff_stats", with_ctes("select diff_id, path, added, removed from d union all select diff_id, null, added, removed from d", d=_DIFF))
def _(spark, sf):
    return H.diff_stats(H.parse_diff_files(diffs(spark, sf)))


@add("changed_files", """select 'P/' || cast(l_orderkey as varchar) as path, case l_orderkey % 5 when 0 then 'modified' when 1 then 'added' when 2 then 'deleted' when 3 then ' ' else 'untracked' end as status,
  count(*) filter (l_returnflag = 'A')::bigint as plus_lines from {lineitem} group by l_orderkey""")
def _(spark, sf):
    orders = C.table(spark, sf, "lineitem").select("l_orderkey").distinct()
    flag = F.element_at(F.array(*[F.lit(x) for x in ("M ", "A ", "D ", " M", "??")]), (F.col("l_orderkey") % 5 + 1).cast("int"))
    lines = orders.select(F.concat(flag, F.lit(" P/"), F.col("l_orderkey").cast("string")).alias("line"))
    patches = H.parse_diff_files(diffs(spark, sf)).withColumn(
        "path", F.concat(F.lit("p/"), F.col("diff_id").cast("string"))
    )
    return H.changed_files(H.parse_git_status(lines), patches).select(
        "path", "status", big(F.regexp_count("patch", F.lit(r"(?m)^\+"))).alias("plus_lines")
    )


# ---- logs -------------------------------------------------------------------


@add("build_log_summary", """select user_id as run_id, count(*) filter (event_type = 'error')::bigint as error_count,
  count(*) filter (event_type = 'purchase')::bigint as warning_count from {events} group by 1""")
def _(spark, sf):
    return L.build_log_summary(C.corpus(spark, sf, C.BUILD_LOGS))


@add("build_diagnostics", """select user_id as run_id, event_id * 2 as ord, 'src/u' || cast(user_id as varchar) || '.cs' as file, event_id % 97 as line_no, 4::bigint as column_no,
  case event_type when 'error' then 'error' else 'warning' end as severity, 'CS' || cast(event_id % 10 as varchar) as code, event_type || ' seen' as message
  from {events} where event_type in ('error', 'purchase')""")
def _(spark, sf):
    d = L.build_diagnostics(C.corpus(spark, sf, C.BUILD_LOGS))
    return d.withColumn("line_no", big("line_no")).withColumn("column_no", big("column_no"))


@add("test_log_summary", """select user_id as run_id, count(*)::bigint as total, count(*) filter (event_type = 'view')::bigint as passed,
  nullif(count(*) filter (event_type = 'error'), 0)::bigint as failed, count(*) filter (event_type = 'click')::bigint as skipped,
  count(*) filter (event_type = 'error')::bigint as error_count from {events} group by 1""")
def _(spark, sf):
    d = L.test_log_summary(C.corpus(spark, sf, C.TEST_LOGS))
    return d.select("run_id", *[big(c).alias(c) for c in ("total", "passed", "failed", "skipped", "error_count")])


_AUDIT = """select event_id, 'e' || cast(event_id as varchar) as entry_id, 's' || cast(user_id as varchar) as session_id, event_type,
  date '2024-01-01' + cast(event_id % 28 as integer) as day, event_id % 24 as hour, 'Src/' || event_type || '/f' || cast(event_id % 7 as varchar) || '.cs' as target_path,
  case when event_id % 9 = 0 then 'Failure' else 'Success' end as outcome, event_id % 1000 as elapsed from {events} where event_id % 50 <> 0"""


def audit_view(df):
    return df.select(
        F.col("entryId").alias("entry_id"), F.col("sessionId").alias("session_id"), F.col("operationType").alias("event_type"),
        F.date_format("timestamp", "yyyy-MM-dd HH").alias("at"), F.col("targetPath").alias("target_path"), "outcome",
        F.col("elapsedMs").alias("elapsed"),
    )


_AUDIT_COLS = "entry_id, session_id, event_type, cast(day as varchar) || ' ' || lpad(cast(hour as varchar), 2, '0') as at, target_path, outcome, elapsed"


@add("read_audit_log", with_ctes(f"select {_AUDIT_COLS} from a", a=_AUDIT))
def _(spark, sf):
    return audit_view(parse_audit(C.corpus(spark, sf, C.AUDIT_JSON)))


@add("write_audit_log", with_ctes("select entry_id, 32::bigint as new_id_length, false as time_missing from a", a=_AUDIT))
def _(spark, sf):
    path = fresh(spark, "audit")
    rows = parse_audit(C.corpus(spark, sf, C.AUDIT_JSON))
    write_audit_log(rows.withColumn("requestId", F.col("entryId")).withColumn("entryId", F.lit("")).drop("timestamp"), path)
    return read_audit_log(spark, path).select(
        F.col("requestId").alias("entry_id"), big(F.length("entryId")).alias("new_id_length"),
        F.col("timestamp").isNull().alias("time_missing"),
    )


@add("query_audit", with_ctes(f"""select {_AUDIT_COLS} from a where day >= date '2024-01-05' and day < date '2024-01-21' and contains(lower(target_path), 'src/click')
  and event_type = 'click' and outcome = 'Success' order by day desc, hour desc, entry_id limit 20 offset 20""", a=_AUDIT))
def _(spark, sf):
    a = parse_audit(C.corpus(spark, sf, C.AUDIT_JSON))
    return audit_view(
        L.query_audit(
            a, F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-20 23:30:00")),
            target_path="SRC/click", operation_type="click", outcome="Success", page_index=1, page_size=20,
        )
    )


# ---- snapshots and refresh --------------------------------------------------


def meta_of_orders(spark, sf):
    return C.table(spark, sf, "orders").select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("snapshot_id"),
        F.concat(F.lit("/repo/"), F.col("o_custkey").cast("string")).alias("root"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.lit("Full").alias("mode"),
        F.col("o_orderkey").alias("file_count"), (F.col("o_orderkey") * 2).alias("symbol_count"),
        (F.col("o_orderkey") * 3).alias("reference_count"),
    )


_META = """select 's' || cast(o_orderkey as varchar) as snapshot_id, '/repo/' || cast(o_custkey as varchar) as root, o_orderdate as created_at,
  o_orderkey as file_count, o_orderkey * 2 as symbol_count, o_orderkey * 3 as reference_count from {orders}"""
_NEWEST = "select * exclude (rn) from (select *, row_number() over (partition by root order by created_at desc, snapshot_id desc) as rn from m) where rn = 1"


@add("list_roots", with_ctes("select root, snapshot_id, file_count, symbol_count from n", m=_META, n=_NEWEST))
def _(spark, sf):
    return SN.list_roots(meta_of_orders(spark, sf)).select("root", "snapshot_id", "file_count", "symbol_count")


@add("index_status", with_ctes("""select root, snapshot_id, 'Ready' as state, symbol_count, case when file_count % 2 = 0 then file_count % 100 end as added_count from n""", m=_META, n=_NEWEST))
def _(spark, sf):
    meta = meta_of_orders(spark, sf)
    deltas = meta.filter("file_count % 2 = 0").select("root", "snapshot_id", (F.col("file_count") % 100).alias("added_count"))
    return X.index_status(meta, deltas).select("root", "snapshot_id", "state", "symbol_count", "added_count")


_PUBLISHED: dict = {}


def published(spark, sf) -> str:
    """Two snapshots of each document source: one without every tenth document, one with all."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PUBLISHED:
        base = fresh(spark, "published")
        docs = C.table(spark, sf, "documents")
        for n, part in ((1, docs.filter("doc_id % 10 <> 0")), (2, docs)):
            rows = part.select(
                F.col("source").alias("root"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"),
                F.md5("text").alias("content_hash"),
            )
            meta = rows.groupBy("root").agg(F.count("*").alias("file_count")).select(
                F.concat(F.lit(f"snap-{n}-"), "root").alias("snapshot_id"), "root",
                F.timestamp_seconds(F.lit(n * 1000)).alias("created_at"), F.lit("Full").alias("mode"), "file_count",
            )
            SN.save_snapshot({"files": rows}, meta, base)
        _PUBLISHED[key] = base
    return _PUBLISHED[key]


@add("save_snapshot", """select 'snap-1-' || source as snapshot_id, count(*)::bigint as n from {documents} where doc_id % 10 <> 0 group by 1
  union all select 'snap-2-' || source, count(*)::bigint from {documents} group by 1""")
def _(spark, sf):
    base = published(spark, sf)
    return spark.read.parquet(f"{base}/files").groupBy("snapshot_id").agg(F.count("*").alias("n"))


@add("read_snapshot", """select 'by id' as how, 'd' || cast(doc_id as varchar) as path, md5(text) as content_hash from {documents} where source = 'src1' and doc_id % 10 <> 0
  union all select 'latest', 'd' || cast(doc_id as varchar), md5(text) from {documents} where source = 'src1'
  union all select 'first root', 'd' || cast(doc_id as varchar), md5(text) from {documents} where source = (select min(source) from {documents})""")
def _(spark, sf):
    base = published(spark, sf)
    out = None
    for how, kw in (("by id", {"snapshot_id": "snap-1-src1"}), ("latest", {"root": "src1"}), ("first root", {})):
        part = SN.read_snapshot(spark, base, "files", **kw).select(F.lit(how).alias("how"), "path", "content_hash")
        out = part if out is None else out.unionByName(part)
    return out


@add("clear_root", """select case source when 'src1' then 'removed' else 'left in ' || source end as what,
  cast(1 + case when count(*) filter (doc_id % 10 <> 0) > 0 then 1 else 0 end as bigint) as n from {documents} group by source""")
def _(spark, sf):
    base = fresh(spark, "cleared")
    SN.read_meta(spark, published(spark, sf)).write.partitionBy("snapshot_id").parquet(f"{base}/{SN.META}")
    removed = SN.clear_root(spark, base, "src1")
    left = SN.read_meta(spark, base).groupBy("root").agg(F.count("*").alias("n"))
    return left.select(F.concat(F.lit("left in "), "root").alias("what"), "n").unionByName(
        spark.range(1).select(F.lit("removed").alias("what"), F.lit(removed).cast("bigint").alias("n"))
    )


def old_new(spark, sf):
    return C.corpus(spark, sf, C.SNAP_OLD), C.corpus(spark, sf, C.SNAP_NEW)


_CHANGE = "case doc_id % 10 when 0 then 'added' when 1 then 'modified' when 2 then 'deleted' else 'unchanged' end"


@add("file_changes", f"""select source as root, lang || case when doc_id % 10 = 2 then '/doc_' else '/DOC_' end || cast(doc_id as varchar) || '.txt' as path, {_CHANGE} as change from {{documents}}""")
def _(spark, sf):
    return X.file_changes(*old_new(spark, sf)).drop("old_path")


@add("deleted_paths", "select source as root, lang || '/doc_' || cast(doc_id as varchar) || '.txt' as path from {documents} where doc_id % 10 = 2")
def _(spark, sf):
    return X.deleted_paths(*old_new(spark, sf))


@add("carry_forward", """select 'old' as version, source as root, lang || '/doc_' || cast(doc_id as varchar) || '.txt' as path from {documents} where doc_id % 10 > 2
  union all select 'new', source, lang || '/DOC_' || cast(doc_id as varchar) || '.txt' from {documents} where doc_id % 10 < 2""")
def _(spark, sf):
    old, new = old_new(spark, sf)
    changes = X.file_changes(old, new)
    parsed = new.join(changes.filter("change in ('added', 'modified')"), ["root", "path"], "left_semi")
    return X.carry_forward(
        old.withColumn("version", F.lit("old")), parsed.withColumn("version", F.lit("new")), changes
    ).select("version", "root", "path")


@add("snapshot_delta", f"""select source as root, count(*) filter (doc_id % 10 = 0)::bigint as added_count, count(*) filter (doc_id % 10 = 1)::bigint as modified_count,
  count(*) filter (doc_id % 10 = 2)::bigint as deleted_count, count(*) filter (doc_id % 10 > 2)::bigint as unchanged_count,
  (count(*) filter (doc_id % 10 <> 2) - count(*) filter (doc_id % 10 <> 0))::bigint as symbol_delta,
  (2 * count(*) filter (doc_id % 10 <> 2) - count(*) filter (doc_id % 10 <> 0))::bigint as reference_delta from {{documents}} group by 1""")
def _(spark, sf):
    old, new = old_new(spark, sf)

    def meta(df, k):
        return df.groupBy("root").agg(F.count("*").alias("symbol_count"), (F.count("*") * k).alias("reference_count"))

    return X.snapshot_delta(X.file_changes(old, new), meta(old, 1), meta(new, 2))


_REFRESHED: dict = {}


def refreshed(spark, sf):
    """The Python corpus after every sixth customer changed, every seventh went and some came."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _REFRESHED:
        old = {k: v.filter("root = 'py_repo'") for k, v in index_of(spark, sf).items()}
        n = F.regexp_extract("path", r"customer_(\d+)\.py", 1).try_cast("bigint")
        now = C.corpus(spark, sf, C.SOURCE_PY).withColumn("n", F.coalesce(n, F.lit(-1)))
        now = now.filter("n < 0 or n % 7 <> 0").withColumn(
            "content",
            F.when(F.col("n") % 6 == 0, F.concat("content", F.lit("class Extra"), F.col("n").cast("string"), F.lit(":\n    pass\n")))
            .otherwise(F.col("content")),
        )
        extra = now.filter("n > 0 and n % 9 = 1").withColumn("path", F.concat(F.lit("new/"), "path")).withColumn(
            "content", F.concat(F.lit("class New"), F.col("n").cast("string"), F.lit("(Extra"), F.col("n").cast("string"), F.lit("):\n    pass\n"))
        )
        _REFRESHED[key] = X.incremental_update(old, now.unionByName(extra).drop("n"))
    return _REFRESHED[key]


@add("incremental_update", expect("""select 'symbol' as what, symbol_id as a, '' as b from symbols where root = 'py_repo' and not exists (
      select 1 from pc where pc.k % 7 = 0 and pc.path = symbols.path)
  union all select 'symbol', 'python:py-repo:type:Extra' || ks, '' from pc where k % 6 = 0 and k % 7 <> 0
  union all select 'symbol', 'python:py-repo:type:New' || ks, '' from pc where k % 9 = 1 and k % 7 <> 0
  union all select 'edge', source_symbol_id, resolution from edges where root = 'py_repo' and not exists (select 1 from pc where pc.k % 7 = 0 and pc.path = edges.path)
  union all select 'edge', 'python:py-repo:type:New' || ks, case when k % 6 = 0 then 'ExactBound' else 'Unknown' end from pc where k % 9 = 1 and k % 7 <> 0
  union all select 'change', path, case when k % 7 = 0 then 'deleted' when k % 6 = 0 then 'modified' else 'unchanged' end from pc
  union all select 'change', path, 'unchanged' from segs
  union all select 'change', 'new/' || path, 'added' from pc where k % 9 = 1 and k % 7 <> 0"""))
def _(spark, sf):
    tables, changes = refreshed(spark, sf)
    return (
        tables["symbols"].select(F.lit("symbol").alias("what"), F.col("symbol_id").alias("a"), F.lit("").alias("b"))
        .unionByName(
            tables["edges"].select(F.lit("edge").alias("what"), F.col("source_symbol_id").alias("a"), F.col("resolution").alias("b"))
        )
        .unionByName(changes.select(F.lit("change").alias("what"), F.col("path").alias("a"), F.col("change").alias("b")))
    )


def now_and_changed(spark, sf):
    """Both source corpora after every sixth customer changed, every seventh went and some came; and the changes alone."""
    n = F.coalesce(F.regexp_extract("path", r"[cC]ustomer_?(\d+)\.(?:py|cs)$", 1).try_cast("bigint"), F.lit(-1))
    whole = C.corpus(spark, sf, C.SOURCE_ALL).withColumn("n", n).withColumn("ks", F.col("n").cast("string"))
    py = F.col("root") == "py_repo"
    extra = F.when(py, F.concat(F.lit("class Extra"), "ks", F.lit(":\n    pass\n"))).otherwise(
        F.concat(F.lit("public class Extra"), "ks", F.lit("\n{\n}\n"))
    )
    new = F.when(py, F.concat(F.lit("class New"), "ks", F.lit("(Extra"), "ks", F.lit("):\n    pass\n"))).otherwise(
        F.concat(F.lit("public class New"), "ks", F.lit(" : Extra"), "ks", F.lit("\n{\n}\n"))
    )
    gone = (F.col("n") >= 0) & (F.col("n") % 7 == 0)
    edit = (F.col("n") >= 0) & (F.col("n") % 6 == 0)
    live = whole.filter(~gone).withColumn("content", F.when(edit, F.concat("content", extra)).otherwise(F.col("content")))
    came = live.filter("n > 0 and n % 9 = 1").withColumn("path", F.concat(F.lit("new/"), "path")).withColumn("content", new)
    columns = ["root", "path", "content"]
    changed = live.filter(edit).select(*columns, F.lit(False).alias("deleted")).unionByName(
        came.select(*columns, F.lit(False).alias("deleted"))
    ).unionByName(whole.filter(gone).select("root", "path", F.lit(None).cast("string").alias("content"), F.lit(True).alias("deleted")))
    return live.unionByName(came).select(*columns), changed


# Files of customers of both roots, and the state after the changes.
_AFTER = """with_k as (select 'py_repo' as root, 'python:py-repo' as prefix, k, ks, path from pc union all select 'cs_repo', 'csharp:cs-repo', k, ks, path from cc),
gone as (select root, path from with_k where k % 7 = 0),
came as (select * from with_k where k % 9 = 1 and k % 7 <> 0)
select 'symbol' as what, prefix || ':' || category || ':' || qualified_path as a, '' as b from nodes anti join gone using (root, path) group by all
  union all select 'symbol', prefix || ':type:Extra' || ks, '' from with_k where k % 6 = 0 and k % 7 <> 0
  union all select 'symbol', prefix || ':type:New' || ks, '' from came
  union all select 'edge', source_symbol_id, resolution from edges anti join gone using (root, path)
  union all select 'edge', prefix || ':type:New' || ks, case when k % 6 = 0 then 'ExactBound' else 'Unknown' end from came"""


def state(tables):
    return (
        tables["symbols"].select(F.lit("symbol").alias("what"), F.col("symbol_id").alias("a"), F.lit("").alias("b"))
        .unionByName(tables["edges"].select(F.lit("edge").alias("what"), F.col("source_symbol_id").alias("a"), F.col("resolution").alias("b")))
    )


def after(more: str) -> str:
    return expect("select").removesuffix("\nselect") + ",\n" + _AFTER + "\n" + more


@add("incremental_update_whole", after("""union all select 'change', root || ' ' || path, case when k % 7 = 0 then 'deleted' when k % 6 = 0 then 'modified' else 'unchanged' end from with_k
  union all select 'change', 'py_repo ' || path, 'unchanged' from segs union all select 'change', 'cs_repo ' || path, 'unchanged' from regs
  union all select 'change', root || ' new/' || path, 'added' from came"""))
def _(spark, sf):
    """The whole index of both roots refreshed; ``incremental_update`` is the case of the Python root alone."""
    tables, changes = X.incremental_update(index_of(spark, sf), now_and_changed(spark, sf)[0])
    return state(tables).unionByName(
        changes.select(F.lit("change").alias("what"), F.concat_ws(" ", "root", "path").alias("a"), F.col("change").alias("b"))
    )


@add("refresh_stream", after("""union all select 'file', root || ' ' || path, '' from nodes anti join gone using (root, path) group by all
  union all select 'file', root || ' new/' || path, '' from came"""))
def _(spark, sf):
    """Two availableNow runs over the files of the customer table: all of them, then the changes."""
    inbox, base, check = (fresh(spark, name) for name in ("inbox", "snapshots", "offsets"))
    whole = C.corpus(spark, sf, C.SOURCE_ALL).withColumn("deleted", F.lit(False))
    for second, rows in enumerate((whole, now_and_changed(spark, sf)[1])):
        rows = rows.withColumn("modified_at", F.timestamp_seconds(F.lit(second)))
        rows.write.mode("append").parquet(inbox)
        refresh_stream(spark.readStream.schema(rows.schema).parquet(inbox), base, check).awaitTermination()
    tables = {name: SN.read_latest(spark, base, name) for name in ("files", "symbols", "edges")}
    return state(tables).unionByName(
        tables["files"].select(F.lit("file").alias("what"), F.concat_ws(" ", "root", "path").alias("a"), F.lit("").alias("b"))
    )
