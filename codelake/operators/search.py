"""Text search over the lines of a corpus.

Searches take the file relation, not exploded lines: files that cannot match
are dropped by one test on the whole content before anything is exploded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.arrays import blocks, running_sum
from codelake.functions.columns import (
    escape_regex, extension, file_id, physical_lines, unnest, unnest_values,
)
from codelake.functions.skew import first_rows, request_join
from codelake.operators.inventory import glob_filter, normal_extensions

# Cut marks for the match kernel. A line that holds the first gets the second.
MARK, OTHER_MARK = "\u0001", "﷐"


def explode_lines(files: DataFrame) -> DataFrame:
    """``(root, path, file_id, line, text)``; breaks on CRLF, LF and CR."""
    lines = unnest_values(
        files.filter(F.col("content") != ""),
        ["root", "path", file_id().alias("file_id")], physical_lines(), "text", "_pos",
    )
    return lines.select("root", "path", "file_id", (F.col("_pos") + 1).alias("line"), "text")


def _matches(lines: DataFrame, pattern: str) -> DataFrame:
    """Every match of a Java regex per line, with its 0-based column.

    Each match is put between marks and the line is cut at the marks, so the
    pieces alternate between gaps and matches and columns are running lengths.
    """
    def cut_at(mark: str) -> Column:
        marked = F.regexp_replace("text", pattern, f"{mark}$0{mark}")
        return F.split(marked, mark, -1)

    # Both marks are literals, so Spark compiles each pattern once per task.
    pieces = F.when(F.col("text").contains(MARK), cut_at(OTHER_MARK)).otherwise(cut_at(MARK))
    cut = lines.filter(F.col("text").rlike(pattern)).withColumn("_p", pieces)
    return _positions(cut, lines.columns)


def _positions(cut: DataFrame, keep: list[str]) -> DataFrame:
    """Pieces ``_p`` (gap, match, gap, ...) to one row per match with its column."""
    cut = cut.withColumn(
        "_end", running_sum(blocks(F.transform("_p", lambda x: F.length(x).cast("int"))))
    )
    found = F.transform(
        F.sequence(F.lit(1), F.size("_p") - 1, F.lit(2)),
        lambda i: F.struct(
            F.element_at(F.col("_end"), i).cast("int").alias("column"),
            F.element_at(F.col("_p"), i + 1).alias("match"),
        ),
    )
    return unnest(cut, keep, found, "column")


UNBOUNDED = re.compile(r"[*+]|\{\d+,\}")


def _tokens(pattern: str) -> list[str]:
    """Escapes, classes, group heads and single characters of a pattern."""
    return re.findall(r"\\Q.*?(?:\\E|$)|\\[pP]\{[^}]*\}|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?(?:<[=!]|<\w+>|[^)\w]|[a-zA-Z]*:?)|\{\d+(?:,\d*)?\}|.", pattern, re.S)


def explosive_group(pattern: str) -> str | None:
    """A group that repeats without bound although it is nothing but a repeat of the same kind.

    ``(a+)+``, ``((a+))*`` and ``(?:x*)*`` can match one text in exponentially
    many ways; ``(ab+c)+`` cannot, as every round needs its own ``a``.
    """
    tokens, stack, starts = _tokens(pattern), [], []
    bodies: list[tuple[int, bool]] = []  # start of the group, whether it is a bare repeat
    for i, token in enumerate(tokens):
        follows = tokens[i + 1] if i + 1 < len(tokens) else ""
        if token.startswith("(") :
            stack.append([0, 0])  # items, bare repeats among them
            starts.append(i)
        elif token == ")" and stack:
            items, bare = stack.pop()
            begin = starts.pop()
            ambiguous = items == 1 and bare == 1
            if ambiguous and UNBOUNDED.fullmatch(follows) and tokens[i + 2 : i + 3] != ["+"]:
                return "".join(tokens[begin : i + 2])
            if stack:
                stack[-1][0] += 1
                stack[-1][1] += ambiguous
        elif token == "|" and stack:
            stack[-1][0] += 2
        elif stack and not UNBOUNDED.fullmatch(token) and token != "?" and not token.startswith("{"):
            stack[-1][0] += 1
            stack[-1][1] += bool(UNBOUNDED.fullmatch(follows)) and tokens[i + 2 : i + 3] != ["+"]
    return None


def checked_pattern(pattern: str) -> str:
    """Fails before the job on an empty, invalid or explosive pattern; Java's engine judges it."""
    if not pattern or not pattern.strip():
        raise ValueError("pattern must not be empty")
    problem = java_problem(pattern)
    if problem:
        raise ValueError(f"invalid regex pattern: {problem}")
    if group := explosive_group(pattern):
        raise ValueError(f"the repeat {group} may never finish on a long line")
    return pattern


def java_problem(pattern: str) -> str | None:
    """What the engine that runs the pattern says against it."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as err:
        return str(getattr(err, "java_exception", err)).splitlines()[0]
    return None


def _scan(files: DataFrame, pattern: str, literal: bool) -> DataFrame:
    """Matches per line; for a literal, which has no anchors, files without a match are left out first."""
    if literal:
        files = files.filter(F.col("content").rlike(pattern))
    return _matches(explode_lines(files), pattern)


def search_text(
    files: DataFrame, query: str, ignore_case: bool = True, whole_word: bool = False
) -> DataFrame:
    """Literal search: every match with line, 0-based column, match and line text."""
    if not query or not query.strip():
        raise ValueError("query must not be empty")
    body = escape_regex(query)
    flags = "(?iu)" if ignore_case else ""
    if whole_word:
        flags, body = ("(?iuU)" if ignore_case else "(?U)"), rf"\b{body}\b"
    return _scan(files, flags + body, True)


def search_regex(files: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """Regex search per line; word classes are Unicode-aware."""
    flags = "(?iuU)" if ignore_case else "(?U)"
    return _scan(files, flags + checked_pattern(pattern), False)


def search_extension_scope(
    files: DataFrame, prefix: str = "", exts: list[str] | None = None
) -> DataFrame:
    """Restricts a search to a folder and extensions, before content is read."""
    if prefix.strip("/"):
        files = files.filter(F.col("path").startswith(prefix.strip("/") + "/"))
    if exts:
        files = files.filter(extension().isin(normal_extensions(exts)))
    return files


WORD = r"(?U)\w+"

SYMBOL_SHAPES = {
    "class": (r"\bclass\s+", r"\b"),
    "interface": (r"\binterface\s+", r"\b"),
    "struct": (r"\bstruct\s+", r"\b"),
    "enum": (r"\benum\s+", r"\b"),
    "method": (r"\b", r"\s*\("),
    "property": (r"\b", r"\s*\{"),
    "any": (r"\b", r"\b"),
}


# Slots of the word filter for each requested word, and how many slots it may have.
SLOTS_A_WORD, MOST_SLOTS = 32, 1 << 22


def _lines_with_words(files: DataFrame, words: DataFrame, ignore_case: bool) -> DataFrame:
    """Lines that may hold one of ``words(_key)``, tested inside the file row.

    The words set slots of a table that becomes a literal; a line without a word
    whose slot is set is never unnested. Words beyond the table's bound are too
    many to filter by, so all lines come.
    """
    known = words.select("_key").distinct()
    count = known.limit(MOST_SLOTS // SLOTS_A_WORD + 1).count()
    slots = 1 << (max(count, 1) * SLOTS_A_WORD - 1).bit_length()
    if slots > MOST_SLOTS:
        return explode_lines(files)

    def slot(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(slots)).cast("int")

    table = bytearray(slots)
    for row in known.select(slot(F.col("_key")).alias("s")).distinct().collect():
        table[row["s"]] = 1
    flags = F.lit(bytes(table))

    def wanted(x: Column) -> Column:
        found = F.regexp_extract_all(x["text"], F.lit(WORD), F.lit(0))
        return F.exists(
            found, lambda w: F.substring(flags, slot(F.lower(w) if ignore_case else w) + 1, F.lit(1)) == F.lit(b"\x01")
        )

    lines = F.transform(physical_lines(), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    return unnest(
        files.filter(F.col("content") != ""), ["root", "path", file_id().alias("file_id")], F.filter(lines, wanted), "line"
    )


def _whole_name(met: DataFrame, begin: Column, ignore_case: bool) -> DataFrame:
    """Matches of a first word at ``begin`` that go on to the whole ``name``; adds ``_whole``."""
    def fold(c: Column) -> Column:
        return F.lower(c) if ignore_case else c

    size = F.length("name")
    whole = F.substring(F.col("text"), begin + 1, size)
    after = F.substring(F.col("text"), begin + size + 1, F.lit(1))
    ends_in_word = F.col("name").rlike(r"(?U)\w$")
    fits = (begin >= 0) & (fold(whole) == fold(F.col("name"))) & ~(ends_in_word & after.rlike(r"(?U)\w"))
    return met.where(fits).withColumn("_whole", whole)


def _by_first_word(names: DataFrame, ignore_case: bool) -> DataFrame:
    """Distinct names with their first word ``_key`` and what stands before it; names without a word go."""
    first = F.regexp_extract("name", WORD, 0)
    key = F.lower(first) if ignore_case else first
    return (
        names.select("name").where(first != "").distinct()
        .select("name", key.alias("_key"), (F.regexp_instr("name", F.lit(WORD)) - 1).alias("_lead"))
    )


def search_symbol(
    files: DataFrame, names: DataFrame, kind: str = "any", ignore_case: bool = False
) -> DataFrame:
    """Declaration-like uses of many identifiers ``names(name)`` at once.

    The lines that hold a first word of the names are cut into
    identifier-shaped matches of the kind once and joined to the names on
    equality, instead of one pass per name. A name of several words
    (``Foo.Bar``) is met by its first word and then compared as a whole; one
    that begins with another character than a word's is found for ``any`` only.
    """
    head, tail = SYMBOL_SHAPES[kind]
    flags = rf"(?U){'(?i)' if ignore_case else ''}"
    wanted = _by_first_word(names, ignore_case)
    single = F.col("name").rlike(r"(?U)^\w+$")
    lines = _lines_with_words(files, wanted, ignore_case)
    found = _matches(lines, rf"{flags}{head}(\w+){tail}")
    word = F.regexp_extract(F.col("match"), r"(?U)(\w+)(?:\s*[({])?$", 1)
    plain = _join_names(found.withColumn("_word", word), wanted.where(single).select("name"), ignore_case)
    several = wanted.where(~single)
    if several.isEmpty():
        return plain
    if kind == "any":
        return plain.unionByName(find_references_text(files, several.select("name"), ignore_case).select(*plain.columns))
    begun = _matches(lines, rf"{flags}{head}\w+")
    last = F.regexp_extract("match", r"(?U)\w+$", 0)
    begun = begun.withColumn("_key", F.lower(last) if ignore_case else last)
    met = request_join(begun, several.where("_lead = 0"), ["_key"], spread=F.xxhash64("file_id", "line", "column"))
    begin = F.col("column") + F.length("match") - F.length(last)
    whole = _whole_name(met.withColumn("_begin", begin), F.col("_begin"), ignore_case)
    rest = F.substring(F.col("text"), F.col("_begin") + F.length("name") + 1, F.length("text"))
    ending = F.regexp_extract(rest, rf"(?U)^(?:{tail})", 0)
    if tail != r"\b":
        whole = whole.where(ending != "")
    before = F.substring(F.col("text"), F.col("column") + 1, F.col("_begin") - F.col("column"))
    return plain.unionByName(whole.withColumn("match", F.concat(before, "_whole", ending)).select(*plain.columns))


def find_references_text(
    files: DataFrame, names: DataFrame, ignore_case: bool = False
) -> DataFrame:
    """Whole-word uses of many identifiers ``names(name)``.

    A name is a run of words and the characters between them (``Foo.Bar``). All
    names meet the words of the text by their first word; the rest of a longer
    name is then compared in the line. Only lines that may hold a first word are
    unnested. Null names and names without a word are found nowhere.
    """
    wanted = _by_first_word(names, ignore_case)
    found = _matches(_lines_with_words(files, wanted, ignore_case), WORD)
    found = found.withColumn("_key", F.lower("match") if ignore_case else F.col("match"))
    met = request_join(found, wanted, ["_key"], spread=F.xxhash64("file_id", "line", "column"))
    begin = F.col("column") - F.col("_lead")
    whole = _whole_name(met, begin, ignore_case)
    return whole.withColumn("match", F.col("_whole")).withColumn("column", begin.cast("int")).drop("_key", "_lead", "_whole")


def _join_names(found: DataFrame, names: DataFrame, ignore_case: bool) -> DataFrame:
    def fold(c: str):
        return F.lower(c) if ignore_case else F.col(c)

    keyed = found.withColumn("_key", fold("_word"))
    wanted = names.select("name", fold("name").alias("_key")).distinct()
    return request_join(
        keyed, wanted, ["_key"], spread=F.xxhash64("file_id", "line", "column")
    ).drop("_key", "_word")


def context_lines(
    matches: DataFrame, files: DataFrame, before: int = 2, after: int = 2
) -> DataFrame:
    """Adds the lines around each match, clipped at the ends of the file.

    Joins the file row once per file with matches and cuts the context out of
    its line array; lines without a match are never shuffled.
    """
    content = files.select("root", "path", "content")
    hit_files = matches.select("root", "path").distinct()
    texts = content.join(hit_files, ["root", "path"], "left_semi").select(
        "root", "path", physical_lines().alias("_lines")
    )
    joined = matches.join(texts, ["root", "path"])
    line = F.col("line")
    first = F.greatest(line - before, F.lit(1))
    return joined.withColumn(
        "context_before", F.slice("_lines", first, line - first)
    ).withColumn("context_after", F.slice("_lines", line + 1, F.lit(after))).drop("_lines")


def group_matches(matches: DataFrame) -> DataFrame:
    """Per file: match count and the matches in order (bounded by the file's size)."""
    return matches.groupBy("root", "path").agg(
        F.count(F.lit(1)).alias("match_count"),
        F.sort_array(F.collect_list(F.struct("line", "column", "match"))).alias("matches"),
    )


def search_totals(matches: DataFrame, cap: int = fv.MAX_SEARCH_RESULTS) -> DataFrame:
    """Total matches, files with matches, and whether the cap cuts the result."""
    per_file = matches.groupBy("root", "path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_matches"),
        F.count(F.lit(1)).alias("files_with_matches"),
    ).withColumn("truncated", F.col("total_matches") > cap)


def cap_per_file(matches: DataFrame, k: int) -> DataFrame:
    return first_rows(matches, ["root", "path"], ["line", "column"], k)


def grep(
    files: DataFrame, query: str, mode: str = "literal", path_prefix: str = "",
    include: list[str] | None = None, exclude: list[str] | None = None,
    case_sensitive: bool = False, max_results: int | None = None, max_per_file: int | None = None,
    context: int | None = None,
) -> DataFrame:
    """Flat match list ranked by (path, line, column), whole unless a cap is set.

    ``truncated`` tells of each row whether ``max_per_file`` left out matches of
    its file or ``max_results`` matches of the whole answer. A list of plain ``*.ext`` globs becomes an extension filter. Column 0 is
    shown as null.
    """
    simple = include and all(re.fullmatch(r"\*\.[A-Za-z0-9]+", g) for g in include)
    scoped = search_extension_scope(
        files, path_prefix, [g[1:] for g in include] if simple else None
    ).filter(glob_filter(None if simple else include, exclude))
    if mode == "regex":
        found = search_regex(scoped, query, not case_sensitive)
    elif mode in ("literal", "word", "symbol_hint"):
        found = search_text(scoped, query, not case_sensitive, mode != "literal")
    else:
        raise ValueError(f"unknown mode: {mode}")
    top = found.withColumn("truncated", F.lit(False))
    if max_per_file is not None:
        # One row more than asked for shows that a file has more.
        most = F.max("rank").over(Window.partitionBy("root", "path"))
        top = cap_per_file(found, max_per_file + 1).withColumn("truncated", most > max_per_file)
        top = top.filter(F.col("rank") <= max_per_file).drop("rank")
    order = ["root", "path", "line", "column"]
    top = top.orderBy(*order)
    if max_results is not None:
        top = (
            top.limit(max_results + 1)
            .withColumn("_n", F.row_number().over(Window.orderBy(*order)))
            .withColumn("truncated", F.col("truncated") | (F.max("_n").over(Window.partitionBy()) > max_results))
            .filter(F.col("_n") <= max_results)
            .drop("_n")
        )
    top = top.withColumn("column_start", F.when(F.col("column") > 0, F.col("column")))
    return context_lines(top, files, context, context) if context else top
