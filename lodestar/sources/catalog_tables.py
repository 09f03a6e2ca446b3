"""Relational sources: catalogue tables over JDBC or Parquet, candidates, and catalogue introspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_null

TABLES = ("requests", "profiles", "designations", "companies", "departments", "locations", "candidates", "config")


def read_query(spark: SparkSession, jdbc: dict, sql: str) -> DataFrame:
    """What the database answers to a query, such as one of its system views."""
    return spark.read.format("jdbc").options(**jdbc, query=sql).load()


def key_ranges(spark: SparkSession, jdbc: dict, name: str, key: str, partitions: int) -> dict[str, str]:
    """Reader options for ranges of a numeric key, whose bounds the database tells; none for a table without rows."""
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(jdbc["url"]).quoteIdentifier(key)
    low, high = read_query(spark, jdbc, f"SELECT MIN({quoted}) AS low_key, MAX({quoted}) AS high_key FROM {name}").first()
    return {} if low is None else {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(partitions)}


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None, key: str | None = None, partitions: int = 8) -> DataFrame | None:
    """A catalogue table from Parquet under ``path`` or from JDBC options; None without a source.

    Filters and column choices of later steps reach either source. With a numeric ``key``, a database is read by
    that many ranges of it at a time; rows with a null key come with the first.
    """
    if jdbc and jdbc.get("url"):
        ranges = key_ranges(spark, jdbc, name, key, partitions) if key else {}
        return spark.read.format("jdbc").options(**jdbc, **ranges, dbtable=name).load()
    return spark.read.parquet(f"{path}/{name}.parquet") if path else None


def create_config_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key STRING, value STRING, updated_at TIMESTAMP) USING parquet")


def has_cv(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("active") & F.col("cv_file_name").isNotNull())


def active_candidates(candidates: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` active candidates with a CV file, by id: the size of one batch request."""
    known = lambda c: F.nullif(F.col(c).cast("double"), F.lit(0.0))
    chosen = has_cv(candidates).orderBy("id").limit(limit)
    return chosen.select("id", "cv_file_name", F.concat_ws(" ", or_null(F.col("first_name")), or_null(F.col("last_name"))).alias("name"), known("total_experience").alias("candidate_experience"), known("expected_ctc").alias("candidate_ctc"))


def find_tables(spark: SparkSession, keyword: str, database: str | None = None) -> list[str]:
    """Names of catalogued tables that contain the keyword, without regard to case."""
    return sorted(t.name for t in spark.catalog.listTables(database) if keyword.lower() in t.name.lower())


def columns_of(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]


def foreign_keys(keys: DataFrame, key_columns: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign keys by name from the system views: inner joins of keys, their columns, and both ends' names."""
    end = lambda side: (
        tables.select(F.col("table_id").alias(f"{side}_table_id"), F.col("name").alias(f"{side}_table")),
        columns.select(F.col("table_id").alias(f"{side}_table_id"), F.col("column_id").alias(f"{side}_column_id"), F.col("name").alias(f"{side}_column")),
    )
    out = keys.select(F.col("key_id"), F.col("name").alias("foreign_key")).join(key_columns, "key_id")
    for side in ("parent", "referenced"):
        t, c = end(side)
        out = out.join(t, f"{side}_table_id").join(c, [f"{side}_table_id", f"{side}_column_id"])
    return out.select("foreign_key", "parent_table", "parent_column", "referenced_table", "referenced_column")


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS one").first()["one"] == 1
