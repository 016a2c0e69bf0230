"""Search of records for target values, as joins and expressions over typed tables.

A target is (name, field, values, case_sensitive). Values of a target are a bag: a row matches once per equal
value. Target lists are configuration, not data, and are checked against MAX_VALUES before being broadcast.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltsieve.session import BROADCAST_ROWS

MAX_VALUES = 1_000_000
#: Characters of all values up to which a list of them is broadcast; longer lists are joined by shuffle.
BROADCAST_CHARS = 16_000_000


@dataclass(frozen=True)
class Target:
    name: str
    path: str
    values: list[str] = field(default_factory=list)
    case_sensitive: bool = False
    kind: str = "direct"

    def __post_init__(self) -> None:
        if not self.name or not self.path:
            raise ValueError("a search target needs a name and a path")
        if self.kind not in ("direct", "nested_array", "nested_object", "jsonpath", "path"):
            raise ValueError(f"unknown search type {self.kind!r}")
        if len(self.values) > MAX_VALUES:
            raise ValueError("value list too long for a target; join a table instead")

    def fold(self, text: str) -> str:
        return text if self.case_sensitive else text.lower()

    @cached_property
    def by_text(self) -> dict[str, list[str]]:
        """The target's values, a bag, by the text they are compared as."""
        out: dict[str, list[str]] = {}
        for v in self.values:
            out.setdefault(self.fold(v), []).append(v)
        return out


def direct_match(df: DataFrame, target: Target, column: Column | None = None) -> DataFrame:
    """Rows times equal target values, with ``target`` and ``matched_value``."""
    fold = (lambda c: c) if target.case_sensitive else F.lower
    values = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(target.values)] or [("", -1)], "matched_value string, __i int").filter("__i >= 0").drop("__i")
    c = F.col(target.path) if column is None else column
    listed = values.withColumn("__t", fold(F.col("matched_value")))
    listed = F.broadcast(listed) if len(target.values) <= BROADCAST_ROWS and sum(map(len, target.values)) <= BROADCAST_CHARS else listed
    return df.withColumn("__v", fold(c.cast("string"))).join(listed, F.col("__v") == F.col("__t")).drop("__v", "__t").withColumn("target", F.lit(target.name))


def array_match(df: DataFrame, array: str, key: str, target: Target) -> DataFrame:
    """Matches inside an array of structs, with the position of the element."""
    items = df.select("*", F.posexplode(array).alias("position", "__item")).filter(F.col("__item").isNotNull())
    return direct_match(items, target, F.col("__item").getField(key)).drop("__item")


def nested_match(df: DataFrame, data: Column, path: str, target: Target) -> DataFrame:
    """Matches at a dotted path of a JSON text or variant column."""
    from siltsieve.functions.paths import column_at

    return direct_match(df, target, column_at(data, path))


def summary(df: DataFrame, targets: list[Target]) -> DataFrame:
    """Matches per target, targets without match included."""
    # one scan: each row meets the values of all targets by (target, folded text)
    each = F.array(*[F.struct(F.lit(t.name).alias("target"), (F.col(t.path).cast("string") if t.case_sensitive else F.lower(F.col(t.path).cast("string"))).alias("text")) for t in targets])
    bag = [(t.name, k, len(v)) for t in targets for k, v in t.by_text.items()]
    listed = df.sparkSession.createDataFrame(bag or [("", "", 0)], "target string, text string, times int")
    listed = F.broadcast(listed) if len(bag) <= BROADCAST_ROWS and sum(len(k) for _, k, _ in bag) <= BROADCAST_CHARS else listed
    hits = df.select(F.explode(each).alias("x")).select("x.*").join(listed, ["target", "text"]).groupBy("target").agg(F.sum("times").alias("matches"))
    names = df.sparkSession.createDataFrame([(t.name,) for t in targets], "target string")
    return names.join(hits, "target", "left").fillna(0, ["matches"])


def contains(c: Column, needle: str, case_sensitive: bool = False) -> Column:
    return c.contains(needle) if case_sensitive else F.lower(c).contains(needle.lower())


def has_type(v: Column, name: str) -> Column:
    """Whether a variant value is of a JSON type: null, string, boolean, number, array or object."""
    kind = F.schema_of_variant(v)
    of = F.when(F.is_variant_null(v), "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    return F.coalesce(v.isNotNull() & (of == name), F.lit(False))


def wildcard_match(df: DataFrame, data: Column, path: str, target: Target) -> DataFrame:
    """Matches at a dotted path of keys as they are written, ``*`` being any key of an object; arrays are not entered."""
    d = df.select("*", data.alias("__at"), F.lit("").alias("path"))
    kept = ", ".join(f"l.`{c}`" for c in df.columns)
    for key in path.split("."):
        view = f"__level_{uuid.uuid4().hex}"
        d.createOrReplaceTempView(view)
        # elements of arrays have no key
        d = df.sparkSession.sql(f"SELECT {kept}, e.value AS __at, concat(CASE WHEN l.path = '' THEN '' ELSE concat(l.path, '.') END, e.key) AS path FROM {view} l, LATERAL variant_explode(l.__at) e WHERE e.key IS NOT NULL" + ("" if key == "*" else " AND e.key = :key"), args={} if key == "*" else {"key": key})
        df.sparkSession.catalog.dropTempView(view)
    return direct_match(d, target, F.try_variant_get("__at", "$", "string")).drop("__at")


def regex(c: Column, pattern: str, case_sensitive: bool = False) -> Column:
    return c.rlike(pattern if case_sensitive else f"(?i){pattern}")
