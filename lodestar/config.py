"""Matching configuration: defaults, overlay from a key-value table, and upserts to it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Default weights of the eight score components, in the order in which they are added.
COMPONENTS = ("role", "skills", "experience", "education", "domain", "technology", "certification", "responsibilities")
DEFAULT_WEIGHTS = dict(zip(COMPONENTS, (0.15, 0.25, 0.15, 0.10, 0.15, 0.10, 0.05, 0.05)))


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds and weights. A partial weight map raises a KeyError when it is used."""

    high_threshold: float = 70.0
    medium_threshold: float = 40.0
    failure_penalty: float = 20.0
    failure_cap: float = 65.0
    llm_weight: float = 0.10
    llm_max_boost: float = 10.0
    prefilter_k: int = 5
    skip_margin: float = 15.0
    skip_coverage: float = 0.50
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))

    def updated(self, **changes) -> MatchConfig:
        """A changed copy; the weight map is replaced whole."""
        return replace(self, **changes)

    @classmethod
    def from_df(cls, table: DataFrame, defaults: MatchConfig | None = None) -> MatchConfig:
        """Overlay of a (key, value as JSON, updated_at) table: the latest value of each key wins.

        The table has one row for each of this class's few keys, however often it was updated.
        """
        known = [f.name for f in fields(cls)]
        rows = latest_config(alive(table) if "expires_at" in table.columns else table).where(F.col("key").isin(known)).collect()
        return replace(defaults or cls(), **{r["key"]: json.loads(r["value"]) for r in rows if r["value"] is not None})

    @classmethod
    def from_sources(cls, table: DataFrame | None = None, settings: dict | None = None) -> MatchConfig:
        """The table's value where it has one that hasn't expired, else that of ``settings``, else the default."""
        known = {f.name for f in fields(cls)}
        base = replace(cls(), **{k.lower(): v for k, v in (settings or {}).items() if k.lower() in known and v is not None})
        return base if table is None else cls.from_df(table, base)


def latest_config(table: DataFrame) -> DataFrame:
    """The newest row of each key."""
    newest = Window.partitionBy("key").orderBy(F.desc("updated_at"))
    return table.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


def upsert_config(table: DataFrame, changes: DataFrame) -> DataFrame:
    """``table`` with ``changes`` (key, value, updated_at) merged in; a change beats an equal time."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    newest = Window.partitionBy("key").orderBy(F.desc("_new"), F.desc("updated_at"))
    return both.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k", "_new")


def alive(table: DataFrame, now=None) -> DataFrame:
    """Rows whose ``expires_at`` is null or yet to come."""
    return table.where(F.col("expires_at").isNull() | (F.col("expires_at") > (F.current_timestamp() if now is None else now)))


#: Lifetimes in seconds of stored results, enrichment answers and configuration.
LIFETIMES = {"results": 7 * 86400, "llm": 30 * 86400, "config": 3600}


def with_expiry(table: DataFrame, kind: str, written_at: str = "updated_at") -> DataFrame:
    """Adds ``expires_at`` by the lifetime of a kind of table."""
    return table.withColumn("expires_at", F.col(written_at) + F.make_dt_interval(secs=F.lit(LIFETIMES[kind])))
