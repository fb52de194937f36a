"""A query as SQL over named inputs: run by Spark over DataFrames, and given as text for another engine to check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures


class Dialect:
    """The few spellings that differ. ``d.name`` is the name of the input ``name`` in the statement."""

    def __init__(self, spark: bool):
        self.spark = spark

    def __getattr__(self, name: str) -> str:
        return f"kymo_{name}" if self.spark else name

    def join(self, value: str, sep: str, order: str, where: str = "") -> str:
        where = f" FILTER (WHERE {where})" if where else ""
        return f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {order}){where}" if self.spark else f"string_agg({value}, '{sep}' ORDER BY {order}){where}"

    def replace(self, value: str, pattern: str, by: str) -> str:
        """Every match of a pattern replaced; ``by`` may hold $1."""
        if self.spark:
            return f"regexp_replace({value}, r'{pattern}', '{by}')"
        return f"regexp_replace({value}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"

    def matches(self, value: str, pattern: str) -> str:
        return f"({value} rlike r'{pattern}')" if self.spark else f"regexp_matches({value}, '{pattern}')"

    def found(self, value: str, pattern: str) -> str:
        """All whole matches as an array."""
        return f"regexp_extract_all({value}, r'{pattern}', 0)" if self.spark else f"regexp_extract_all({value}, '{pattern}')"

    def size(self, value: str) -> str:
        return f"size({value})" if self.spark else f"len({value})"

    def split(self, value: str, sep: str = " ") -> str:
        return f"split({value}, '{sep}')" if self.spark else f"string_split({value}, '{sep}')"

    def unnest(self, source: str, array: str, name: str, index: str) -> str:
        """FROM item: ``source`` with each element of an array as ``name`` and its place from 1 as ``index``."""
        if self.spark:
            return f"(SELECT *, {index}0 + 1 AS {index} FROM {source} LATERAL VIEW posexplode({array}) AS {index}0, {name})"
        return f"(SELECT *, unnest({array}) AS {name}, generate_subscripts({array}, 1) AS {index} FROM {source})"

    def each(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})" if self.spark else f"list_transform({array}, lambda {var} : {body})"

    def keep(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})" if self.spark else f"list_filter({array}, lambda {var} : {body})"

    def at(self, array: str, index: str) -> str:
        return f"try_element_at({array}, CAST({index} AS INT))" if self.spark else f"({array})[{index}]"

    def series(self, low: str, high: str) -> str:
        """Integers from low to high, both included; none if high is less."""
        return f"CASE WHEN {high} >= {low} THEN sequence({low}, {high}) ELSE array() END" if self.spark else f"range({low}, {high} + 1)"

    def sha1(self, value: str) -> str:
        return f"sha1({value})"

    def seconds(self, value: str) -> str:
        """Seconds since 1970 of a timestamp."""
        return f"unix_timestamp({value})" if self.spark else f"CAST(floor(epoch({value})) AS BIGINT)"

    def text(self, value: str) -> str:
        return f"CAST({value} AS STRING)" if self.spark else f"CAST({value} AS VARCHAR)"

    def cast(self, value: str, kind: str) -> str:
        """A cast that gives null for what can't be read."""
        return f"try_cast({value} AS {kind})"

    def months(self, value: str, n: str) -> str:
        return f"add_months({value}, {n})" if self.spark else f"CAST({value} + to_months(CAST({n} AS INTEGER)) AS DATE)"

    def days(self, later: str, earlier: str) -> str:
        return f"datediff({later}, {earlier})" if self.spark else f"date_diff('day', {earlier}, {later})"

    def values(self, name: str, columns: str, rows: str) -> str:
        """A FROM item of literal rows."""
        return f"(VALUES {rows}) AS {name}({columns})"


@dataclass
class Query:
    """One operator as SQL. ``rows`` names the survey rows; ``inputs`` the views it reads (see ``fixtures``).

    ``sql`` is the rule written a second time, for the engine that checks it; without it, that engine gets ``text``.
    """

    name: str
    rows: str
    inputs: list[str]
    text: Callable[[Dialect], str]
    checked: bool = True
    sql: str | None = None
    options: dict = field(default_factory=dict)

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The operator over the caller's own tables, one for each input."""
        for name in self.inputs:
            frames[name].createOrReplaceTempView(f"kymo_{name}")
        return spark.sql(self.text(Dialect(True)))

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.on(spark, **{name: fixtures.view(spark, sf_dir, name) for name in self.inputs})

    def oracle(self) -> str:
        return with_views(self.inputs, self.sql or self.text(Dialect(False)))


@dataclass
class Built:
    """One operator as a function of DataFrames, named as its inputs are; ``sql`` is its rule written for the engine that checks it."""

    name: str
    rows: str
    inputs: list[str]
    build: Callable[..., DataFrame]
    sql: str | None = None

    @property
    def checked(self) -> bool:
        return self.sql is not None

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The operator over the caller's own tables, one for each input."""
        return self.build(**frames)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.on(spark, **{name: fixtures.view(spark, sf_dir, name) for name in self.inputs})

    def oracle(self) -> str:
        return with_views(self.inputs, self.sql or "")


def with_views(inputs: list[str], sql: str) -> str:
    """A statement for the engine that checks, behind the views that it reads."""
    ctes = [f"{name} AS ({fixtures.DUCK[name]})" for name in fixtures.needed(inputs)]
    body = sql.strip()
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ",\n".join(ctes) + ",\n" + body[len(head) :]
    return "WITH " + ",\n".join(ctes) + "\n" + body
