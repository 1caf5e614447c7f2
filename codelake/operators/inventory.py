"""File inventory: eligibility, language, format and path predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.columns import (
    any_of, base_name, col, extension, glob_regex, lookup, unnest_values, wildcard_regex,
)
from codelake.functions.skew import first_rows, lookup_join


def _folders(path: Column) -> Column:
    """Folder names above the file, lower case."""
    parts = F.filter(
        F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/", -1), lambda p: p != ""
    )
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def _ends_with_any(text: Column, suffixes: list[str]) -> Column:
    return any_of(text.endswith(s) for s in suffixes)


def eligibility(
    path="path", size_bytes="size_bytes", is_binary="is_binary",
    max_bytes: int | None = None,
) -> Column:
    """First matching status of the eligibility ladder; no file is too large without a limit."""
    p = col(path)
    name = F.lower(base_name(p))
    ignored = F.array(*[F.lit(f) for f in fv.IGNORED_FOLDERS])
    return (
        F.when(col(is_binary), "Binary")
        .when(name.startswith(".") | _ends_with_any(name, fv.TEMP_SUFFIXES), "Hidden")
        .when(extension(p).isin(fv.EXCLUDED_EXTENSIONS), "Excluded")
        .when(F.arrays_overlap(_folders(p), ignored), "Ignored")
        .when(F.lit(max_bytes is not None) & (col(size_bytes) > (max_bytes or 0)), "TooLarge")
        .when(
            _ends_with_any(name, fv.GENERATED_SUFFIXES)
            | name.isin(fv.GENERATED_NAMES)
            | any_of(name.contains(x) for x in fv.GENERATED_FRAGMENTS),
            "Generated",
        )
        .otherwise("Eligible")
    )


def classify_eligibility(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``files(path, size_bytes, is_binary)`` with status and reason."""
    size = F.format_number("size_bytes", 0)
    ext = F.concat(F.lit("."), F.substring_index(base_name("path"), ".", -1))
    reason = (
        F.when(F.col("eligibility") == "Binary", F.lit("Binary file detected"))
        .when(F.col("eligibility") == "Hidden", F.lit("Hidden or temporary file"))
        .when(
            F.col("eligibility") == "Excluded",
            F.concat(F.lit("Extension '"), ext, F.lit("' is excluded")),
        )
        .when(F.col("eligibility") == "Ignored", F.lit("File is in an ignored directory"))
        .when(
            F.col("eligibility") == "TooLarge",
            F.concat(
                F.lit("File size "), size,
                F.lit(f" bytes exceeds limit {max_bytes or 0:,} bytes"),
            ),
        )
        .when(F.col("eligibility") == "Generated", F.lit("File appears to be auto-generated"))
    )
    return files.withColumn("eligibility", eligibility(max_bytes=max_bytes)).withColumn(
        "reason", reason
    )


# ---- binary and text format -------------------------------------------------


#: Control bytes that texts do not hold; NUL is looked for by itself.
CONTROL_BYTES = "".join(map(chr, [*range(1, 8), *range(14, 32)]))


def _first_bytes(raw, sample_bytes: int | None) -> Column:
    return col(raw) if sample_bytes is None else F.substring(col(raw), 1, sample_bytes)


def _has_nul(raw, sample_bytes: int | None) -> Column:
    return F.contains(_first_bytes(raw, sample_bytes), F.lit(b"\x00"))


def looks_binary(raw="raw", sample_bytes: int | None = None) -> Column:
    """NUL byte, or over 30 % control bytes, in a file or in its first ``sample_bytes``."""
    text = F.decode(_first_bytes(raw, sample_bytes), "ISO-8859-1")  # a character per byte
    total = F.length(text)
    control = total - F.length(F.translate(text, CONTROL_BYTES, ""))
    has_nul = _has_nul(raw, sample_bytes)
    return F.coalesce(
        has_nul | ((total > 0) & (F.floor(control * 100 / total) > fv.BINARY_CONTROL_PERCENT)),
        F.lit(False),
    )


def detect_binary(files_raw: DataFrame, sample_bytes: int | None = None) -> DataFrame:
    return files_raw.withColumn("is_binary", looks_binary(sample_bytes=sample_bytes))


def detect_binary_by_ext(files_raw: DataFrame, sample_bytes: int | None = None) -> DataFrame:
    """Known binary extension, or a NUL byte in the file or in its first ``sample_bytes``."""
    return files_raw.withColumn(
        "is_binary",
        extension().isin(fv.BINARY_EXTENSIONS)
        | F.coalesce(_has_nul("raw", sample_bytes), F.lit(False)),
    )


def encoding_label(raw="raw") -> Column:
    head = F.hex(F.substring(col(raw), 1, 4))
    return (
        F.when(head.startswith("EFBBBF"), "utf-8-bom")
        .when(head.startswith("FFFE"), "utf-16-le")
        .when(head.startswith("FEFF"), "utf-16-be")
        .when(head == "0000FEFF", "utf-32")
        .otherwise("utf-8")
    )


def detect_encoding(files_raw: DataFrame) -> DataFrame:
    return files_raw.withColumn("encoding", encoding_label())


def line_ending(content="content", sample_chars: int | None = None) -> Column:
    """Kind of line ends in a text, or in its first ``sample_chars`` characters."""
    sample = col(content) if sample_chars is None else F.left(col(content), F.lit(sample_chars))
    single = F.replace(sample, F.lit("\r\n"), F.lit(""))
    crlf, cr, lf = sample.contains("\r\n"), single.contains("\r"), single.contains("\n")
    return (
        F.when(crlf & ~cr & ~lf, "crlf")
        .when(~crlf & cr & ~lf, "cr")
        .when(~crlf & ~cr, "lf")
        .otherwise("mixed")
    )


def detect_line_ending(files: DataFrame, sample_chars: int | None = None) -> DataFrame:
    return files.withColumn("line_ending", line_ending(sample_chars=sample_chars))


def line_count(content="content") -> Column:
    """Physical lines; an unterminated last line counts."""
    c = col(content)
    breaks = (
        F.length(c)
        - F.length(F.translate(c, "\r\n", ""))
        - (F.length(c) - F.length(F.replace(c, F.lit("\r\n"), F.lit("\n"))))
    )
    open_end = (F.length(c) > 0) & ~c.endswith("\n") & ~c.endswith("\r")
    return (breaks + F.when(open_end, 1).otherwise(0)).cast("int")


def count_lines(files: DataFrame) -> DataFrame:
    return files.withColumn("line_count", line_count())


def language(path="path") -> Column:
    return lookup(extension(path), fv.LANGUAGE_BY_EXTENSION)


def detect_language(files: DataFrame) -> DataFrame:
    """Extension, then shebang of the first line, then unknown."""
    by_ext = language()
    first = F.regexp_extract("content", r"\A#!([^\r\n]*)", 1)
    bang = F.lower(F.trim(first))
    by_bang = None
    for word, lang in fv.LANGUAGE_BY_SHEBANG:
        test = bang.contains(word)
        by_bang = F.when(test, lang) if by_bang is None else by_bang.when(test, lang)
    return (
        files.withColumn("_ext", by_ext)
        .withColumn("_bang", F.when(F.col("_ext").isNull(), by_bang))
        .withColumn("language", F.coalesce("_ext", "_bang", F.lit("unknown")))
        .withColumn(
            "detection_method",
            F.when(F.col("_ext").isNotNull(), "extension")
            .when(F.col("_bang").isNotNull(), "shebang")
            .otherwise("default"),
        )
        .withColumn(
            "confidence",
            F.when(F.col("_ext").isNotNull(), 1.0)
            .when(F.col("_bang").isNotNull(), 0.9)
            .otherwise(0.0),
        )
        .drop("_ext", "_bang")
    )


def file_metadata(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Name, extension, size, times and text format; the format only up to ``max_bytes``, where given.

    The encoding is read from ``raw`` where that column is present.
    """
    small = F.lit(True) if max_bytes is None else F.col("size_bytes") <= max_bytes
    encoding = encoding_label() if "raw" in files.columns else F.col("encoding")
    times = [c for c in ("modified_at",) if c in files.columns]
    return files.select(
        "root", "path",
        base_name("path").alias("name"),
        extension("path").alias("extension"),
        "size_bytes",
        *times,
        F.when(small, encoding).alias("encoding"),
        F.when(small, line_ending()).alias("line_ending"),
        F.when(small, line_count()).alias("line_count"),
    )


def mime_type(files: DataFrame) -> DataFrame:
    return files.withColumn(
        "mime_type", lookup(extension(), fv.MIME_BY_EXTENSION, fv.MIME_DEFAULT)
    )


# ---- path predicates --------------------------------------------------------


def is_blocked(
    path="path", folders: list[str] = fv.BLOCKED_FOLDERS,
    extensions: list[str] = fv.BLOCKED_EXTENSIONS, allow: list[str] | None = None,
) -> Column:
    p = col(path)
    names = F.array(*[F.lit(f.lower()) for f in folders])
    segments = F.split(F.lower(F.replace(p, F.lit("\\"), F.lit("/"))), "/", -1)
    ext = extension(p)
    blocked = F.arrays_overlap(segments, names) | ext.isin([e.lower() for e in extensions])
    if allow:
        blocked = blocked | ((ext != "") & ~ext.isin([e.lower() for e in allow]))
    return blocked


def blocked_paths(files: DataFrame, **lists) -> DataFrame:
    """Files that pass the block lists; a list given as ``allow`` must hold the extension."""
    return files.filter(~is_blocked(**lists))


def glob_match(
    df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
    path: str = "path",
) -> DataFrame:
    return df.filter(glob_filter(include, exclude, path))


def glob_filter(
    include: list[str] | None = None, exclude: list[str] | None = None, path: str = "path"
) -> Column:
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    keep = any_of(p.rlike(glob_regex(g)) for g in include) if include else F.lit(True)
    if exclude:
        keep = keep & ~any_of(p.rlike(glob_regex(g)) for g in exclude)
    return keep


def wildcard_match(
    df: DataFrame, column: str, pattern: str, ignore_case: bool = True
) -> DataFrame:
    return df.filter(F.col(column).rlike(wildcard_regex(pattern, ignore_case)))


REGEX_SIGNALS = r"[\\^$()\[\]{}|+]"


def pattern_kind(patterns: DataFrame) -> DataFrame:
    """``patterns(pattern)`` -> regex, wildcard or substring.

    A pattern with a signal character is a regex only when it compiles. The
    check runs on distinct patterns in Arrow batches.
    """

    @F.pandas_udf("boolean")
    def compiles(p):
        def ok(text):
            try:
                re.compile(text)
                return True
            except (re.error, RecursionError, OverflowError):
                return False

        return p.map(ok)

    signal = F.col("pattern").rlike(REGEX_SIGNALS)
    checked = (
        patterns.filter(signal).select("pattern").distinct()
        .withColumn("_ok", compiles("pattern"))
    )
    return (
        lookup_join(patterns, checked, ["pattern"])
        .withColumn(
            "pattern_kind",
            F.when(F.col("_ok"), "regex")
            .when(F.col("pattern").contains("*") | F.col("pattern").contains("?"), "wildcard")
            .otherwise("substring"),
        )
        .drop("_ok")
    )


def one_pattern_kind(pattern: str) -> str:
    if re.search(REGEX_SIGNALS, pattern):
        try:
            re.compile(pattern)
            return "regex"
        except re.error:
            pass
    return "wildcard" if "*" in pattern or "?" in pattern else "substring"


def search_file_names(
    files: DataFrame, patterns: list[str], full_path: bool = False, ignore_case: bool = True
) -> DataFrame:
    """Files with each pattern (substring, wildcard or regex) their name matches.

    The patterns are a short list of the caller, so they become column tests
    and the files are read once, without a join.
    """
    target = F.col("path") if full_path else base_name("path")
    flags = "(?iu)" if ignore_case else ""

    def test(p: str) -> Column:
        kind = one_pattern_kind(p)
        if kind == "regex":
            return target.rlike(flags + p)
        if kind == "wildcard":
            return target.rlike(wildcard_regex(p, ignore_case))
        return F.lower(target).contains(p.lower()) if ignore_case else target.contains(p)

    hits = F.filter(
        F.array(*[F.when(test(p), F.lit(p)) for p in patterns]), lambda x: x.isNotNull()
    )
    keep = [
        "root", "path", base_name("path").alias("name"), extension("path").alias("extension"),
        "size_bytes",
    ]
    return unnest_values(files, keep, hits, "pattern")


def normal_extensions(exts: list[str]) -> list[str]:
    return sorted({(e if e.startswith(".") else "." + e).lower() for e in exts})


def search_by_extension(files: DataFrame, exts: list[str]) -> DataFrame:
    """Files with any of the extensions; the dot is optional, no list means all."""
    found = files.filter(extension().isin(normal_extensions(exts))) if exts else files
    return found.select(
        "root", "path", base_name("path").alias("name"), extension("path").alias("extension"),
        "size_bytes",
    )


def find_path(
    tree: DataFrame, query: str, mode: str = "name", kind: str = "any",
    case_sensitive: bool = False, include: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Files and directories of ``tree`` that fit the query, with the reason.

    A query that reads as a regex is one, whatever the mode.
    """

    def fold(c: Column) -> Column:
        return c if case_sensitive else F.lower(c)

    q = query.replace("\\", "/")
    q = q if case_sensitive else q.lower()
    path, name = F.col("path"), F.col("name")
    if one_pattern_kind(query) == "regex":
        target = name if mode == "name" else path
        hit = target.rlike(("" if case_sensitive else "(?iu)") + query)
        reason = F.when(hit, F.lit("regex match"))
    elif mode == "name":
        raw = query if case_sensitive else query.lower()
        wild = one_pattern_kind(query) == "wildcard"
        in_file = (
            name.rlike(wildcard_regex(query, not case_sensitive))
            if wild else fold(name).contains(raw)
        )
        reason = F.when(
            (F.col("kind") == "file") & in_file, F.lit("file name match")
        ).when(
            (F.col("kind") == "directory") & fold(name).contains(raw),
            F.lit("directory name match"),
        )
    elif mode == "path_fragment":
        reason = F.when(fold(path).contains(q), F.lit("path fragment match"))
    elif mode == "exact_path":
        reason = F.when(fold(path) == q, F.lit("exact path match"))
    elif mode == "prefix":
        reason = F.when(fold(path).startswith(q), F.lit("path prefix match"))
    else:
        raise ValueError(f"unknown mode: {mode}")
    found = tree.withColumn("match_reason", reason).filter(
        F.col("match_reason").isNotNull() & glob_filter(include, exclude)
    )
    if kind != "any":
        found = found.filter(F.col("kind") == kind)
    return found.select("root", "path", "name", "kind", "match_reason")


def list_files(
    files: DataFrame, nodes: DataFrame, diagnostics: DataFrame,
    languages: list[str] | None = None, parse_statuses: list[str] | None = None,
    eligibilities: list[str] | None = None, path_prefix: str | None = None,
) -> DataFrame:
    """Inventory rows with their top-level node and diagnostic counts."""
    if languages:
        files = files.filter(F.lower("language").isin([x.lower() for x in languages]))
    if parse_statuses:
        files = files.filter(F.col("parse_status").isin(parse_statuses))
    if eligibilities:
        files = files.filter(F.col("eligibility").isin(eligibilities))
    if path_prefix:
        folder = path_prefix.replace("\\", "/").rstrip("/") + "/"
        files = files.filter(
            F.lower("path").startswith(folder.lower())
            | (F.lower("path") == path_prefix.lower())
        )
    top_nodes = (
        nodes.filter(F.col("parent_node_id").isNull())
        .groupBy("root", "path")
        .agg(F.count(F.lit(1)).alias("top_level_node_count"))
    )
    diags = diagnostics.groupBy("root", "path").agg(
        F.count(F.lit(1)).alias("diagnostic_count")
    )
    return (
        files.join(top_nodes, ["root", "path"], "left")
        .join(diags, ["root", "path"], "left")
        .na.fill(0, ["top_level_node_count", "diagnostic_count"])
    )


def list_directory(
    tree: DataFrame, directories: DataFrame | None = None, pattern: str | None = None,
    sort_by: str = "name", cap: int | None = None, include_blocked: bool = False,
) -> DataFrame:
    """Children of directories, ordered, and capped per directory where ``cap`` is set.

    ``directories(root, parent)`` names the wanted ones; without it every
    directory is listed. ``total_count`` counts all children before filters.
    """
    rows = tree
    if directories is not None:
        wanted = directories.select("root", "parent").distinct()
        rows = lookup_join(rows, wanted, ["root", "parent"], "inner")
    totals = rows.groupBy("root", "parent").agg(F.count(F.lit(1)).alias("total_count"))
    blocked = F.arrays_overlap(
        F.split(F.lower("path"), "/", -1),
        F.array(*[F.lit(f.lower()) for f in fv.BLOCKED_FOLDERS]),
    )
    shown = rows if include_blocked else rows.filter(~blocked)
    if pattern:
        shown = shown.filter(F.col("name").rlike(wildcard_regex(pattern)))
    order = (
        [F.desc(F.coalesce("size_bytes", F.lit(-1))), F.col("name")]
        if sort_by == "size" else [F.col("kind"), F.col("name")]
    )
    kept = shown.groupBy("root", "parent").agg(F.count(F.lit(1)).alias("_shown"))
    capped = first_rows(shown, ["root", "parent"], order, cap)
    return (
        capped.join(kept, ["root", "parent"])
        .join(totals, ["root", "parent"])
        .withColumn("truncated", F.lit(False) if cap is None else F.col("_shown") > cap)
        .drop("_shown")
    )
