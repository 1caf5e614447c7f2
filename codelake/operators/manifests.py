"""Code structure, project manifests, configuration inventory, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv
from codelake.functions.arrays import fold, let
from codelake.functions.columns import (
    any_of, base_name, extension, file_id, parent_path, path_key, physical_line_array,
    unnest, unnest_values,
)
from codelake.functions.skew import lookup_join
from codelake.operators.extract_cs import code_text
from codelake.operators.inventory import is_blocked


def code_structure(files: DataFrame) -> DataFrame:
    """Usings, namespaces, types and methods of C#-like files, line by line.

    A method counts only below a type; a namespace line ends the current type.
    One pass carries the current namespace and the last scope from line to line.
    """

    def group(t: Column, pattern: str, n: int) -> Column:
        return F.regexp_extract(t, pattern, n)

    def describe(t: Column, i: Column) -> Column:
        kind = (
            F.when(t.rlike(fv.STRUCTURE_USING), "using")
            .when(t.rlike(fv.STRUCTURE_NAMESPACE), "namespace")
            .when(t.rlike(fv.STRUCTURE_TYPE), group(t, fv.STRUCTURE_TYPE, 2))
            .when(t.rlike(fv.STRUCTURE_METHOD), "method")
        )
        name = (
            F.when(kind == "using", group(t, fv.STRUCTURE_USING, 1))
            .when(kind == "namespace", group(t, fv.STRUCTURE_NAMESPACE, 1))
            .when(kind == "method", group(t, fv.STRUCTURE_METHOD, 2))
            .otherwise(group(t, fv.STRUCTURE_TYPE, 3))
        )
        return F.struct(
            (i + 1).alias("line"), kind.alias("kind"), name.alias("name"),
            t.contains("public").alias("is_public"), t.contains("static").alias("is_static"),
        )

    found = F.filter(
        F.transform(physical_line_array(), describe), lambda x: x["kind"].isNotNull()
    )
    above = "struct<namespace:string,kind:string,name:string>"

    def step(above: Column, x: Column) -> Column:
        scope = ~x["kind"].isin("using", "method")
        here = F.struct(
            F.when(x["kind"] == "namespace", x["name"]).otherwise(above["namespace"]).alias("namespace"),
            x["kind"].alias("kind"), x["name"].alias("name"),
        )
        return F.struct(F.when(scope, here).otherwise(above).alias("state"), above.alias("value"))

    def placed(z: Column) -> Column:
        x, last = z["x"], z["above"]
        member = x["kind"] == "method"
        return F.struct(
            x["line"].alias("line"), x["kind"].alias("kind"), x["name"].alias("name"),
            F.when(~x["kind"].isin("using", "namespace"), last["namespace"]).alias("namespace"),
            F.when(member & (last["kind"] != "namespace"), last["name"]).alias("type_name"),
            F.when(member, x["is_public"]).alias("is_public"),
            F.when(member, x["is_static"]).alias("is_static"),
        )

    rows = files.select("root", "path", found.alias("_found")).withColumn(
        "_above", fold(F.col("_found"), F.struct(*[F.lit(None).cast("string").alias(n) for n in ("namespace", "kind", "name")]), step, above)
    ).withColumn("_s", F.arrays_zip(F.col("_found").alias("x"), F.col("_above").alias("above")))
    return unnest(rows, ["root", "path"], F.transform("_s", placed), "line").filter(
        (F.col("kind") != "method") | F.col("type_name").isNotNull()
    )


def _resolved(folder: Column, relative: Column) -> Column:
    """Joins a relative path to a folder and takes out '.' and '..'."""
    parts = F.split(
        F.concat_ws("/", F.when(folder != "", folder), F.replace(relative, F.lit("\\"), F.lit("/"))),
        "/", -1,
    )
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(p.isin("", "."), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "/")


def solution_projects(files: DataFrame) -> DataFrame:
    """Projects named in solution files that exist in the same corpus."""
    named = F.arrays_zip(
        F.regexp_extract_all("content", F.lit(fv.SOLUTION_PROJECT), F.lit(1)).alias("name"),
        F.regexp_extract_all("content", F.lit(fv.SOLUTION_PROJECT), F.lit(2)).alias("rel"),
    )
    wanted = (
        unnest_values(
            files.filter(extension() == ".sln"),
            ["root", F.col("path").alias("solution")], named, "_p",
        )
        .select(
            "root", "solution", F.col("_p.name").alias("name"),
            _resolved(parent_path("solution"), F.col("_p.rel")).alias("project_path"),
        )
        .filter(extension("project_path").isin(fv.PROJECT_EXTENSIONS))
        .withColumn("_key", path_key("project_path"))
    )
    existing = files.select("root", path_key().alias("_key"), F.col("path"))
    return lookup_join(wanted, existing, ["root", "_key"], "inner").select(
        "root", "solution", "name", "path"
    )


def project_manifests(files: DataFrame) -> DataFrame:
    """Framework, output type, references and test flag of project files."""
    name = F.regexp_replace(base_name("path"), r"\.[^.]*$", "")
    low_name, low = F.lower(name), F.lower("content")

    def first(pattern: str) -> Column:
        value = F.regexp_extract("content", pattern, 1)
        return F.when(value != "", F.trim(F.regexp_replace(value, r"\s+\z", "")))

    packages = F.transform(
        F.arrays_zip(
            F.regexp_extract_all("content", F.lit(fv.PACKAGE_REFERENCE), F.lit(1)).alias("n"),
            F.regexp_extract_all("content", F.lit(fv.PACKAGE_REFERENCE), F.lit(2)).alias("v"),
        ),
        lambda z: F.concat_ws(" ", z["n"], z["v"]),
    )
    projects = F.transform(
        F.regexp_extract_all("content", F.lit(fv.PROJECT_REFERENCE), F.lit(1)),
        lambda p: F.replace(p, F.lit("\\"), F.lit("/")),
    )
    return files.filter(extension().isin(fv.PROJECT_EXTENSIONS)).select(
        "root", "path", name.alias("name"),
        F.ltrim(extension(), F.lit(".")).alias("type"),
        first(fv.TARGET_FRAMEWORK).alias("target_framework"),
        first(fv.OUTPUT_TYPE).alias("output_type"),
        packages.alias("package_refs"),
        projects.alias("project_refs"),
        (
            any_of(low_name.contains(w) for w in fv.TEST_NAME_WORDS)
            | any_of(low.contains(w) for w in fv.TEST_CONTENT_WORDS)
        ).alias("is_test"),
    )


def test_projects(manifests: DataFrame) -> DataFrame:
    return manifests.filter("is_test")


def config_files(files: DataFrame) -> DataFrame:
    """Configuration files with their class; a file may fall into two classes."""
    name = F.lower(base_name("path"))
    dot_config = name.endswith(".config")
    connections = name.contains("connection") | F.lower("content").contains("<connectionstrings")
    json = name.endswith(".json")
    classes = F.filter(
        F.array(
            F.when(dot_config & connections, F.lit("connection_strings")),
            F.when(dot_config & ~connections, F.lit("app_settings")),
            F.when(
                json
                & (
                    name.startswith("appsettings")
                    | name.isin("tsconfig.json", "package.json", "launchsettings.json")
                    | name.contains("settings")
                ),
                F.lit("json"),
            ),
            F.when(name.endswith(".yml") | name.endswith(".yaml"), F.lit("yaml")),
            F.when(name.endswith(".ini"), F.lit("ini")),
            F.when(name.startswith(".env"), F.lit("other")),
        ),
        lambda c: c.isNotNull(),
    )
    return unnest_values(
        files.filter(~is_blocked(extensions=[])), ["root", "path"], classes, "config_class"
    )


def brace_surplus(content="content") -> Column:
    """Opening braces without a closing one in C#-like code; negative if some are missing."""
    return let(
        code_text(content),
        lambda code: F.length(F.replace(code, F.lit("}"), F.lit(""))) - F.length(F.replace(code, F.lit("{"), F.lit(""))),
    )


def parse_diagnostics(files: DataFrame) -> DataFrame:
    """``files(root, path, language, content)``: failures to read or parse, as rows.

    Missing content is a read error. Braces of a C#-like file that do not pair
    up make it partial; the code tells which side is missing.
    """
    told = F.struct(
        file_id().alias("file_id"), F.col("content").isNull().alias("unread"),
        F.when(F.col("language") == "csharp", brace_surplus()).alias("surplus"),
    )
    # Through a generator, or the filter on the surplus would be worked out below a
    # shuffle that spreads the files, and the surplus once more for each of its uses.
    return diagnostics_of(unnest(files, ["root", "path"], F.array(told), "unread"))


def diagnostics_of(files: DataFrame) -> DataFrame:
    """The diagnostics of ``files(root, path, file_id, unread, surplus)``, which need no content any more."""
    rows = files.filter(F.col("unread") | (F.coalesce("surplus", F.lit(0)) != 0))
    unread = F.col("unread")
    return rows.select(
        "root", "path",
        F.concat_ws(
            "-", F.lit("diag"), "file_id", F.when(unread, F.lit("read")).otherwise(F.lit("parse"))
        ).alias("diagnostic_id"),
        F.when(unread, "Error").otherwise("Warning").alias("severity"),
        F.when(unread, "Indexing").otherwise("ParserAdapter").alias("source"),
        F.when(unread, "FILE_READ_ERROR")
        .when(F.col("surplus") > 0, "CS1513")
        .otherwise("CS1022")
        .alias("code"),
        F.when(unread, "Could not read file: no content")
        .when(F.col("surplus") > 0, "} expected")
        .otherwise("Type or namespace definition, or end-of-file expected")
        .alias("message"),
    )
