"""Change history read from text dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.arrays import blocks, running_sum
from codelake.functions.columns import lf_lines, lookup, unnest_values
from codelake.functions.sequences import CHUNK, carry_last

FIELD = "\u001f"
SPACE = " \t\r\n"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _time(c: Column) -> Column:
    return F.try_to_timestamp(_strip(c))


def _words(c: Column) -> Column:
    return F.filter(F.split(_strip(c), " ", -1), lambda w: w != "")


# ---- log --------------------------------------------------------------------


def parse_git_log(
    dump: DataFrame, keys: list[str] | None = None, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """``dump(keys..., ord, line)`` -> (commits, commit_files).

    The dump is a sequence: each file line belongs to the latest header line
    before it. The carry runs in chunks, never over a whole dump in one task.
    The files of a commit stay rows; one import commit may name millions.
    """
    keys = keys or []
    lines = dump.withColumn("_t", _strip(F.col("line"))).filter(F.col("_t") != "")
    is_mark = F.col("_t").contains(FIELD)
    parts = F.split("_t", FIELD, -1)
    complete = is_mark & (F.size(parts) >= 9)

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(i + 1))

    commits = lines.filter(complete).select(
        *keys, "ord",
        _strip(part(0)).alias("sha"),
        _strip(part(1)).alias("short_sha"),
        _strip(part(2)).alias("author"),
        _strip(part(3)).alias("email"),
        _time(part(4)).alias("author_date"),
        _strip(part(5)).alias("committer"),
        _time(part(6)).alias("committer_date"),
        _strip(part(7)).alias("subject"),
        _strip(part(8)).alias("body"),
        F.coalesce(_words(part(9)), F.array().cast("array<string>")).alias("parents"),
    )
    # An incomplete header ends the file list of the commit before it.
    marked = lines.select(
        *keys, "ord", "_t",
        F.when(is_mark, F.when(complete, _strip(part(0))).otherwise(F.lit(""))).alias("_sha"),
    )
    files = (
        carry_last(marked, keys, "ord", "_sha", "sha", chunk)
        .filter(F.col("_sha").isNull() & F.col("sha").isNotNull() & (F.col("sha") != ""))
        .select(*keys, "sha", "ord", F.col("_t").alias("file"))
    )
    return commits, files


def filter_commits(
    commits: DataFrame, files: DataFrame, author: str | None = None, since=None, until=None,
    path: str | None = None, keys: list[str] | None = None,
) -> DataFrame:
    if author:
        commits = commits.filter(F.col("author").contains(author) | F.col("email").contains(author))
    if since is not None:
        commits = commits.filter(F.col("author_date") >= F.lit(since))
    if until is not None:
        commits = commits.filter(F.col("author_date") <= F.lit(until))
    if path:
        p = path.replace("\\", "/").strip("/")
        touched = files.filter((F.col("file") == p) | F.col("file").startswith(p + "/"))
        on = [*(keys or []), "sha"]
        commits = commits.join(touched.select(*on).distinct(), on, "left_semi")
    return commits


def recent_commits(commits: DataFrame, n: int) -> DataFrame:
    """Latest ``n`` commits."""
    if n < 1:
        raise ValueError("n counts from 1")
    return commits.orderBy(F.desc("author_date"), "sha").limit(n)


def parse_git_show(shows: DataFrame) -> DataFrame:
    """``shows(show_id, text)``: one commit each, with eleven header fields."""
    lines = F.transform(lf_lines("text"), _strip)
    rows = shows.withColumn("_l", F.filter(lines, lambda x: x != ""))
    header = F.try_element_at(F.filter("_l", lambda x: x.contains(FIELD)), F.lit(1))
    rows = rows.withColumn("_h", header).withColumn("_p", F.split("_h", FIELD, -1))

    def part(i: int) -> Column:
        return F.try_element_at("_p", F.lit(i + 1))

    found = F.coalesce(F.size("_p") >= 9, F.lit(False))
    files = F.filter(
        F.slice(F.col("_l"), F.array_position("_l", F.col("_h")).cast("int") + 1, F.size("_l")),
        lambda x: ~x.contains(FIELD),
    )
    text = {
        "sha": 0, "short_sha": 1, "author": 2, "email": 3, "committer": 5,
        "committer_email": 6, "subject": 8, "body": 9,
    }
    return rows.select(
        "show_id",
        (~found).alias("not_found"),
        *[F.when(found, F.coalesce(_strip(part(i)), F.lit(""))).alias(n) for n, i in text.items()],
        F.when(found, _time(part(4))).alias("author_date"),
        F.when(found, _time(part(7))).alias("committer_date"),
        F.when(found, F.coalesce(_words(part(10)), F.array().cast("array<string>"))).alias("parents"),
        F.when(found, files).alias("files"),
    )


# ---- status -----------------------------------------------------------------


def parse_git_status(lines: DataFrame) -> DataFrame:
    """Porcelain v1 lines; other columns such as the repository pass through."""
    others = [c for c in lines.columns if c != "line"]
    rest = _strip(F.substring("line", 4, 1 << 30))
    at = F.instr(rest, " -> ")
    old = F.when(at > 0, F.btrim(F.left(rest, at - 1), F.lit('"')))
    path = F.when(at > 0, F.btrim(F.substring(rest, at + 4, F.length(rest)), F.lit('"'))).otherwise(
        F.btrim(rest, F.lit('"'))
    )
    index, work = F.substring("line", 1, 1), F.substring("line", 2, 1)
    untracked = (index == "?") & (work == "?")
    return lines.filter(F.length("line") >= 4).select(
        *others,
        path.alias("path"),
        index.alias("index_status"),
        work.alias("worktree_status"),
        old.alias("old_path"),
        (~untracked & (F.trim(index) != "")).alias("staged"),
        (~untracked & (F.trim(work) != "")).alias("unstaged"),
        untracked.alias("untracked"),
    )


def git_status_counts(status: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return status.groupBy(*(keys or [])).agg(
        F.count_if("staged").alias("staged_count"),
        F.count_if("unstaged").alias("unstaged_count"),
        F.count_if("untracked").alias("untracked_count"),
        (F.count(F.lit(1)) > 0).alias("has_changes"),
    )


STATUS_LABELS = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "?": "untracked"}


def changed_files(
    status: DataFrame, diff_files: DataFrame | None = None, include_untracked: bool = True,
    keys: list[str] | None = None,
) -> DataFrame:
    """Status rows with their label and, where a diff is given, the patch text."""
    keys = keys or []
    rows = status if include_untracked else status.filter(~F.col("untracked"))
    label = F.when(F.col("untracked"), "untracked").otherwise(
        F.coalesce(lookup(F.col("index_status"), STATUS_LABELS), F.col("index_status"))
    )
    rows = rows.withColumn("status", label).withColumn("_key", F.lower("path"))
    if diff_files is None:
        return rows.withColumn("patch", F.lit(None).cast("string")).drop("_key")
    patches = (
        diff_files.groupBy(*keys, F.lower("path").alias("_key"))
        .agg(F.max_by("patch", "file_no").alias("patch"))
    )
    return rows.join(patches, [*keys, "_key"], "left").drop("_key")


# ---- diffs ------------------------------------------------------------------

# Where a hunk begins; the numbers are checked so that content cannot open one.
AT_HUNK = r"(?m)(?=^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"


def _blocks(diffs: DataFrame) -> DataFrame:
    """One row per file block of a diff: header text and hunk texts."""
    pieces = F.filter(
        F.split("text", r"(?m)(?=^diff --git )", -1),
        lambda b: F.substring_index(b, "\n", 1).rlike(r"^diff --git a/.+ b/.+$"),
    )
    return (
        unnest_values(diffs, ["diff_id"], pieces, "_block", "_no")
        .withColumn("file_no", F.col("_no") + 1)
        .withColumn("_parts", F.split("_block", AT_HUNK, -1))
        .withColumn(
            "_meta",
            F.regexp_extract(F.element_at("_parts", 1), r"(?s)\A(.*?)(?=\n--- |\z)", 1),
        )
        .withColumn("_hunks", F.slice("_parts", F.lit(2), F.size("_parts")))
        .drop("_no", "_block", "_parts")
    )


def _file_columns() -> dict[str, Column]:
    head = F.substring_index("_meta", "\n", 1)
    last = F.regexp_extract(
        "_meta", r"(?s).*\n(new file mode|deleted file mode|rename from )", 1
    )
    renamed = _strip(F.regexp_extract("_meta", r"(?s).*\nrename to ([^\n]*)", 1))
    return {
        "path": F.when(renamed != "", renamed).otherwise(
            _strip(F.regexp_extract(head, fv.DIFF_HEADER, 2))
        ),
        "old_path": F.when(
            F.col("_meta").contains("\nrename from "),
            _strip(F.regexp_extract("_meta", r"(?s).*\nrename from ([^\n]*)", 1)),
        ),
        "change_type": F.when(last == "new file mode", "added")
        .when(last == "deleted file mode", "deleted")
        .when(last == "rename from ", "renamed")
        .otherwise("modified"),
    }


def parse_diff_files(diffs: DataFrame) -> DataFrame:
    """``diffs(diff_id, text)`` -> one row per file with its line counts."""
    text = F.array_join("_hunks", "")
    rows = _blocks(diffs).withColumn("_text", text)
    columns = [c.alias(n) for n, c in _file_columns().items()]
    return rows.select(
        "diff_id", "file_no", *columns,
        F.size("_hunks").alias("hunk_count"),
        F.regexp_count("_text", F.lit(r"(?m)^\+")).alias("lines_added"),
        F.regexp_count("_text", F.lit(r"(?m)^-")).alias("lines_removed"),
        F.rtrim("_text", F.lit("\n")).alias("patch"),
    )


def parse_diff_lines(diffs: DataFrame) -> DataFrame:
    """Lines of every hunk with their old and new line numbers."""
    columns = [c.alias(n) for n, c in _file_columns().items()]
    hunks = (
        unnest_values(
            _blocks(diffs), ["diff_id", "file_no", *columns], F.col("_hunks"), "_hunk", "_h"
        )
        .withColumn("_lines", lf_lines("_hunk"))
        .withColumn("header", _strip(F.element_at("_lines", 1)))
    )

    def start(group: int) -> Column:
        return F.regexp_extract("header", fv.HUNK_HEADER, group).try_cast("int")

    kept = F.filter(
        F.slice("_lines", F.lit(2), F.size("_lines")), lambda x: x.rlike(r"^[+\- ]")
    )

    def counts(*signs: str) -> Column:
        return running_sum(
            blocks(
                F.transform("_kept", lambda x: F.left(x, F.lit(1)).isin(*signs).cast("int"))
            )
        )

    numbered = unnest_values(
        hunks.withColumn("_kept", kept)
        .withColumn("_old", counts("-", " "))
        .withColumn("_new", counts("+", " ")),
        [
            "diff_id", "file_no", "path", "old_path", "change_type",
            (F.col("_h") + 1).alias("hunk"), "header",
            start(1).alias("_os"), start(3).alias("_ns"),
        ],
        F.arrays_zip("_kept", "_old", "_new"), "_z", "_pos",
    )
    sign = F.left(F.col("_z._kept"), F.lit(1))
    return numbered.select(
        "diff_id", "file_no", "path", "old_path", "change_type", "hunk", "header",
        (F.col("_pos") + 1).alias("ord"),
        F.when(sign == "+", "added").when(sign == "-", "removed").otherwise("context").alias("type"),
        F.substring(F.col("_z._kept"), 2, 1 << 30).alias("text"),
        F.when(sign != "+", F.col("_os") + F.col("_z._old") - 1).alias("old_line"),
        F.when(sign != "-", F.col("_ns") + F.col("_z._new") - 1).alias("new_line"),
    )


def diff_stats(diff_files: DataFrame) -> DataFrame:
    """Added and removed lines per file, and in total where ``path`` is null."""
    per_file = diff_files.groupBy("diff_id", "path").agg(
        F.sum("lines_added").alias("added"), F.sum("lines_removed").alias("removed")
    )
    # The roll-up works on one row per file, not on the lines.
    total = per_file.groupBy("diff_id").agg(
        F.lit(None).cast("string").alias("path"),
        F.sum("added").alias("added"), F.sum("removed").alias("removed"),
    )
    return per_file.unionByName(total)
