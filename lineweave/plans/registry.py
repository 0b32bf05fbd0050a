"""Where queries register under their names, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lineweave.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


# Whether lines a and b are alike, for DuckDB: the bytes common at both ends, in hex digits, against half of all.
_SPACED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_HEX = "string_split(hex({0}), '')"
_COMMON = "coalesce(list_position(list_transform(list_zip({0}, {1}), lambda z: z[1] = z[2]), false) - 1, least(strlen(a), strlen(b)) * 2)"
_HEAD, _TAIL = _COMMON.format(_HEX.format("a"), _HEX.format("b")), _COMMON.format(f"list_reverse({_HEX.format('a')})", f"list_reverse({_HEX.format('b')})")
ALIKE = f"""case when {_SPACED.format("a")} = {_SPACED.format("b")} then true when trim(a) = '' or trim(b) = '' then false
  else 4 * least(({_HEAD}) // 2 + ({_TAIL}) // 2, least(strlen(a), strlen(b))) >= strlen(a) + strlen(b) end"""


class Tables:
    """Views and tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            return views.view(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return views.spark(self.spark, self.sf_dir, text)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables as a query. sql: DuckDB text over base tables and views."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = views.duck(sql)
        return f

    return register
