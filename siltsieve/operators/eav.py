"""Entity-attribute-value rows to one wide, typed row per entity.

Method: values are reduced to one typed cell per (entity, attribute) before anything is moved (map-side
combine makes a hot entity harmless) and written once to the shared folder, partitioned by attribute and
bucketed by entity: each attribute's part is one narrow typed table, read by itself. The narrow tables are combined by outer joins in a balanced tree whose
nodes all carry the spine of entities, so every join runs on the same partitioning without a further shuffle.

Defined edge cases: keys are compared by letters and digits only, any other key is ignored; a value that
is null, blank, ``null`` or ``n/a`` holds nothing; rows with a null entity are ignored; repeated rows mean
the same thing once; an entity with no declared attribute has no wide row; where readable values differ the
latest loaded one (then the one of the largest tie-break) is kept and the cell is marked ``conflict``;
a value read and compared that its column type cannot hold is null there and marked ``out_of_range``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltsieve.session import holds, shared_folder, strip

SQL_TYPES = {"string": "string", "integer": "bigint", "decimal": "decimal(38,10)", "boolean": "boolean", "date": "date"}
#: Attributes one wide table may declare; they are the columns of the result.
MAX_ATTRIBUTES = 10_000
FANIN = 4


def canonical_key(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def _number(v: Column, integral: bool) -> Column:
    """Canonical text of a number (sign, digits without outer zeros), null if it cannot be read."""
    money = "" if integral else r"\$? ?"
    ok = v.rlike(rf"^[+-]?{money}(?:[0-9]+|[0-9]{{1,3}}(?:,[0-9]{{3}})+)(?:\.{'0+' if integral else '[0-9]+'})?$")
    bare = F.regexp_replace(v, r"[+$, ]", "")
    bare = F.regexp_replace(bare, r"^(-?[0-9]+)(?:\.0*|(\.[0-9]*[1-9])0*)$", "$1$2")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
    return F.when(ok, bare)


def _date(v: Column) -> Column:
    """Canonical YYYY-MM-DD, null if it is no calendar date."""
    shapes = [
        (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T00:00:00(?:\.0+)?Z?)?$", "yyyy-MM-dd"), (r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$", "yyyy/MM/dd"), (r"^[0-9]{8}$", "yyyyMMdd"),
        (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
    ]
    return F.coalesce(*[F.try_to_date(F.when(v.rlike(p), F.initcap(v) if "MMM" in f else F.substring(v, 1, 10)), f) for p, f in shapes]).cast("string")


def canonical_value(value: Column, value_type: Column) -> Column:
    """Text that is equal exactly for values of equal meaning; null where the type cannot be read."""
    v = strip(value)
    low = F.lower(v)
    boolean = F.when(low.isin("true", "t", "yes", "y", "1", "on"), "true").when(low.isin("false", "f", "no", "n", "0", "off"), "false")
    return F.when(value_type == "integer", _number(v, True)).when(value_type == "decimal", _number(v, False)).when(value_type == "boolean", boolean).when(value_type == "date", _date(v)).otherwise(low)


def declared_attributes(types: DataFrame) -> list[dict]:
    """The declared attributes as rows of the driver; they are the schema of the result, hence few."""
    rows = types.select("attr_name", "value_type", "aliases").orderBy("attr_name").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} declared attributes")
    return [r.asDict() for r in rows]


def typed_cells(df: DataFrame, types: DataFrame, entity: str, key: str, value: str, order: list[str]) -> DataFrame:
    """One row per (entity, attr_name): text of the cell, whether a value was unreadable, whether values conflict."""
    norm = lambda s: re.sub(r"[\W_]", "", s.lower())
    names: dict[str, tuple[str, str]] = {}
    for r in declared_attributes(types):
        for a in [*(r["aliases"] or []), r["attr_name"]]:
            names[norm(a)] = (r["attr_name"], r["value_type"])
    lookup = df.sparkSession.createDataFrame([(k, *v) for k, v in names.items()] or [("", "", "")], "__key string, attr_name string, __type string")
    d = df.select(F.col(entity).alias("entity"), canonical_key(key).alias("__key"), F.col(value).alias("__value"), F.struct(*order).alias("__order"))
    d = d.filter(F.col("entity").isNotNull() & holds("__value")).join(F.broadcast(lookup), "__key")  # at most MAX_ATTRIBUTES names and aliases
    d = d.withColumn("__canon", canonical_value(F.col("__value"), F.col("__type")))
    shown = F.when(F.col("__type") == "string", strip("__value")).otherwise(F.col("__canon"))
    d = d.withColumn("__shown", F.when(F.col("__canon").isNotNull(), F.struct("__order", shown.alias("v"))))
    cells = d.groupBy("entity", "attr_name").agg(
        F.max("__shown").alias("__best"), F.min("__canon").alias("__lo"), F.max("__canon").alias("__hi"), F.max(F.col("__canon").isNull()).alias("unreadable")
    )
    return cells.select("entity", "attr_name", F.col("__best.v").alias("cell"), "unreadable", F.coalesce(F.col("__lo") != F.col("__hi"), F.lit(False)).alias("conflict"))


def stored(df: DataFrame, buckets: int, part: str | None = None) -> DataFrame:
    """A table written once below the shared folder, bucketed by entity: readers of a part read its own rows only and are co-partitioned."""
    spark = df.sparkSession
    name = f"siltsieve_{uuid.uuid4().hex}"
    w = df.repartition(buckets, "entity").write.format("parquet").bucketBy(buckets, "entity").sortBy("entity").option("path", shared_folder(spark, "cells"))
    (w.partitionBy(part) if part else w).saveAsTable(name)
    return spark.table(name)


def eav_to_wide(df: DataFrame, types: DataFrame, entity: str, key: str, value: str, order: list[str]) -> DataFrame:
    """One row per entity: ``entity``, per declared attribute a typed column, and ``issues``: array<struct<attr_name, issue>>."""
    spark, declared = df.sparkSession, declared_attributes(types)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = stored(typed_cells(df, types, entity, key, value, order), buckets, "attr_name")
    spine = stored(cells.select("entity").distinct(), buckets)

    def narrow(i: int) -> DataFrame:
        a = declared[i]
        typed = F.col("cell").try_cast(SQL_TYPES[a["value_type"]])
        said = lambda c, issue: F.when(c, F.struct(F.lit(a["attr_name"]).alias("attr_name"), F.lit(issue).alias("issue")))
        issues = F.array_compact(F.array(said(F.col("unreadable"), "unreadable"), said(F.col("conflict"), "conflict"), said(F.col("cell").isNotNull() & typed.isNull(), "out_of_range")))
        return cells.filter(F.col("attr_name") == a["attr_name"]).select("entity", typed.alias(f"__a{i}"), issues.alias(f"__i{i}"))

    def combine(ids: list[int]) -> DataFrame:
        if len(ids) <= FANIN:
            node = spine
            for i in ids:
                node = node.join(narrow(i).hint("merge"), "entity", "left")
            return node
        half = len(ids) // 2
        return combine(ids[:half]).join(combine(ids[half:]).hint("merge"), "entity", "inner")

    wide = combine(list(range(len(declared))))
    none = F.array().cast("array<struct<attr_name:string,issue:string>>")
    issues = F.concat(*[F.coalesce(F.col(f"__i{i}"), none) for i in range(len(declared))]) if declared else none
    return wide.select("entity", *[F.col(f"__a{i}").alias(a["attr_name"]) for i, a in enumerate(declared)], issues.alias("issues"))


def cell_issues(wide: DataFrame) -> DataFrame:
    """The cells of a wide table that could not be filled cleanly."""
    return wide.filter(F.size("issues") > 0).select(F.col("entity").alias("row_id"), F.explode("issues").alias("i")).select("row_id", "i.attr_name", "i.issue")
