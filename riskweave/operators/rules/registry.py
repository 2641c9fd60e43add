"""Rule metadata as a table, rule definitions as expressions, and checks on both."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...config import N_RULES
from .catalogue import ENVIRONMENT_BLOCKS, RULE_TABLE

ENVIRONMENTS = ["traditional", "blockchain", "hybrid", "ai_enabled"]
SCHEMA = (
    "id int, name string, environment string, lens_tags array<string>, description string, "
    "data_requirements array<string>, offchain_requirements array<string>"
)


@dataclass
class RuleInfo:
    id: int
    name: str
    environment: str
    lens_tags: list[str]
    data_requirements: list[str] = field(default_factory=list)
    offchain_requirements: list[str] = field(default_factory=list)

    @property
    def description(self) -> str:
        """The name in words."""
        return " ".join(re.findall(r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[0-9]+|[a-z]+", self.name)).lower()


@dataclass
class Rule:
    """Logic of one rule: fires when ``when`` holds, with ``confidence``; ``applicable`` may rule it out."""

    when: Column
    confidence: Column
    applicable: Column | None = None


def _split(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


class RuleBook:
    """Rules by id. Custom rules are added with ``register``; an id can only be used once."""

    def __init__(self) -> None:
        self.info: dict[int, RuleInfo] = {}
        self.logic: dict[int, Rule] = {}

    @classmethod
    def standard(cls) -> RuleBook:
        """The built-in 185 rules, 48 of them with logic."""
        from .expressions import standard_rules

        book = cls()
        for number, name, tags, needs, offchain in RULE_TABLE:
            env = next(e for last, e in ENVIRONMENT_BLOCKS if number <= last)
            book._add(RuleInfo(number, name, env, _split(tags), _split(needs), _split(offchain)))
        book.logic.update(standard_rules())
        return book

    def _add(self, info: RuleInfo) -> None:
        if info.id in self.info:
            raise ValueError(f"rule id {info.id} is already used by {self.info[info.id].name}")
        if info.environment not in ENVIRONMENTS:
            raise ValueError(f"unknown environment {info.environment}")
        self.info[info.id] = info

    def register(
        self, rule_id: int, name: str, environment: str, lens_tags: Iterable[str], requirements: Iterable[str],
        when: Column, confidence: Column, applicable: Column | None = None,
    ) -> None:
        """UDF1: add a rule over the wallet context columns; ``when``/``confidence`` are any columns."""
        self._add(RuleInfo(rule_id, name, environment, list(lens_tags), list(requirements)))
        self.logic[rule_id] = Rule(when, confidence, applicable)

    def size(self) -> int:
        return max([N_RULES, *self.info])

    def names(self) -> Column:
        """Rule names as an array literal indexed by id."""
        return F.array(*[F.lit(self.info[i].name if i in self.info else f"Heuristic {i}") for i in range(1, self.size() + 1)])

    def table(self, spark: SparkSession) -> DataFrame:
        """SRC5: the registry as a table."""
        rows = [
            (r.id, r.name, r.environment, r.lens_tags, r.description, r.data_requirements, r.offchain_requirements)
            for _, r in sorted(self.info.items())
        ]
        return spark.createDataFrame(rows, SCHEMA)


def by_environment(registry: DataFrame, environment: str) -> DataFrame:
    return registry.where(F.col("environment") == environment)


def by_lens(registry: DataFrame, tag: str) -> DataFrame:
    return registry.where(F.array_contains("lens_tags", tag))


def completeness(registry: DataFrame) -> DataFrame:
    """JOI9: ids missing from or outside 1..185, and ids claimed by two environments; empty when all is well."""
    spark = registry.sparkSession
    expected = spark.range(1, N_RULES + 1).select(F.col("id").cast("int").alias("id"))
    missing = expected.join(registry, "id", "left_anti").select("id", F.lit("missing").alias("problem"))
    extra = registry.select("id").join(expected, "id", "left_anti").select("id", F.lit("extra").alias("problem"))
    conflict = registry.groupBy("id").agg(F.countDistinct("environment").alias("n")).where("n > 1")
    return missing.unionByName(extra).unionByName(conflict.select("id", F.lit("conflict").alias("problem")))
