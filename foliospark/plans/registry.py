"""Registration of queries with their SQL, and literal tables given alike to both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _counts(sql: str) -> str:
    """``count_if(c)`` of the SQL as ``count(CASE WHEN c THEN 1 END)``, which is a BIGINT and 0 where c is null."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end, quoted = 1, at + 9, False
        while depth:
            quoted ^= sql[end] == "'"
            depth += 0 if quoted else {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(sql: str | None = None, name: str | None = None):
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = _counts(sql)
        return function

    return add


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Literal:
    """A small table written out: a DataFrame for Spark and a common table expression for SQL.

    ``also`` adds rows from the tables at hand by a SELECT that both engines read alike, with ``{documents}`` and so on for
    the tables and ``{list}(...)`` for an array: the input is the same for both, the answer isn't."""

    KINDS = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<long>": "BIGINT[]"}

    def __init__(self, name: str, schema: str, *rows: tuple):
        self.name, self.schema, self.rows = name, schema, [tuple(r) for r in rows]
        self.fields = [f.strip().split(" ", 1) for f in schema.split(",")]
        self.derived: str | None = None

    def also(self, select: str) -> Literal:
        self.derived = select
        return self

    def frame(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        own = spark.createDataFrame(self.rows, self.schema)
        if self.derived is None or sf_dir is None:
            return own
        used = {t: read(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in self.derived}
        more = spark.sql(self.derived.replace("{list}", "array"), **used).toDF(*[n for n, _ in self.fields])
        return own.unionByName(more.select(*[F.col(f.name).cast(f.dataType) for f in own.schema.fields]))

    def sql(self) -> str:
        def one(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).upper()
            if isinstance(v, list):
                return "[" + ", ".join(map(one, v)) + "]"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            return repr(v)

        names = ", ".join(n for n, _ in self.fields)
        casts = ", ".join(f"CAST({n} AS {self.KINDS[k]}) AS {n}" for n, k in self.fields)
        rows = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in self.rows)
        more = ""
        if self.derived is not None:
            select = self.derived.replace("{list}", "list_value")
            for t in TABLES:
                select = select.replace(f"{{{t}}}", t)
            more = f" UNION ALL SELECT {casts} FROM ({select}) AS w({names})"
            if not self.rows:
                return f"{self.name} AS (SELECT {casts} FROM ({select}) AS w({names}))"
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {rows}) AS v({names}){more})"


def with_tables(*tables: Literal) -> str:
    return "WITH " + ",\n".join(t.sql() for t in tables)
