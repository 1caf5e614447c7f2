"""Plumbing shared by the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import corpora
from codelake.plans.index import build_index

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with the SQL that must give the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = duck(sql)
            return fn

        return wrap


def duck(sql: str) -> str:
    """Corpus placeholders become the view names of the SQL engine."""
    for t in corpora.TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.strip()


def with_ctes(body: str, **ctes: str) -> str:
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in ctes.items()) + "\n" + body


_BUILT: dict[tuple[str, str], dict[str, DataFrame]] = {}


def index_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The relations of the Python and C# corpora, built once per application.

    As in use: a corpus is indexed once and queried many times.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = build_index(corpora.corpus(spark, sf_dir, corpora.SOURCE_ALL))
        _BUILT[key]["edges"] = stored_edges(_BUILT[key]["edges"])
    return _BUILT[key]


def stored_edges(edges: DataFrame) -> DataFrame:
    from codelake.functions.storage import stored

    return stored(edges, "edges")


def joined(c, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def start(c: str = "span") -> Column:
    return F.col(f"{c}.start_line").cast("bigint").alias("start_line")


def end(c: str = "span") -> Column:
    return F.col(f"{c}.end_line").cast("bigint").alias("end_line")
