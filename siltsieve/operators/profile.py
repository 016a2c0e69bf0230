"""Field profiles: occurrences, type lattice, distinct values, lengths, examples and nested fields."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltsieve.functions import jsontext as J

#: Distinct values are counted exactly up to here; reports cap there.
UNIQUE_CAP = 10_000
EXAMPLES = 5

_NAMES = [(T.StringType, "string"), (T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.NumericType, "number"), (T.ArrayType, "array"), ((T.StructType, T.MapType, T.VariantType), "object")]


def type_of(dtype: T.DataType) -> str:
    return next((n for k, n in _NAMES if isinstance(dtype, k)), "string")


def _same(by: list[str], prefix: str) -> F.Column:
    return functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by])


def _statistics(long: DataFrame, by: list[str], totals: DataFrame) -> DataFrame:
    """Profiles of the cells ``long``; totals has the columns ``by`` and __total, the rows of each group.

    Spark takes cells for smaller than the file they come from and would broadcast all of them. So totals are joined to the
    finished profiles, never to the cells, and both joins are sorted ones, whatever sizes Spark expects.
    """
    # one shuffle on (group, path, value) makes distinct counts exact and mergeable
    v = long.groupBy(*by, "path", "value", "json_type", "element_type").agg(F.count("*").alias("n"))
    lattice = lambda c: F.when(F.count_distinct(c) <= 1, F.min(c)).otherwise("mixed")
    g = v.groupBy(*by, "path").agg(
        F.sum("n").alias("occurrences"), F.count_if(F.col("json_type") == "null").alias("__nulls"), F.least(F.count_distinct("value"), F.lit(UNIQUE_CAP)).alias("unique_values"),
        lattice("json_type").alias("type"), lattice("element_type").alias("element_type"), F.min(F.octet_length("value")).alias("min_length"), F.max(F.octet_length("value")).alias("max_length"),
    )
    # the smallest values: ranks are cut before the shuffle, so a path of any number of values sends EXAMPLES a task
    rank = F.row_number().over(Window.partitionBy(*by, "path").orderBy("value"))
    values = v.filter("value is not null").select(*by, "path", "value").distinct().withColumn("__r", rank).filter(F.col("__r") <= EXAMPLES)
    shown = values.groupBy(*by, "path").agg(F.array_sort(F.collect_list("value")).alias("examples")).select(*[F.col(c).alias(f"__{c}") for c in [*by, "path"]], "examples")
    g = g.join(shown.hint("merge"), _same([*by, "path"], "__"), "left").drop(*[f"__{c}" for c in [*by, "path"]])
    if by:
        t = totals.select(*[F.col(c).alias(f"__t_{c}") for c in by], "__total")
        g = g.join(t.hint("merge"), _same(by, "__t_")).drop(*[f"__t_{c}" for c in by])
    else:
        g = g.join(F.broadcast(totals))  # one row
    out = g.withColumn("examples", F.coalesce("examples", F.array().cast("array<string>"))).withColumn("example", F.try_element_at("examples", F.lit(1)))
    return out.withColumn("nullable", F.col("__nulls") > 0).withColumn("percentage", F.col("occurrences") * 100.0 / F.col("__total")).drop("__nulls", "__total")


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column of a typed table."""
    cols = columns or df.columns
    kinds = {f.name: type_of(f.dataType) for f in df.schema.fields}
    elements = {f.name: type_of(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else None for f in df.schema.fields}
    each = F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value"), F.when(F.col(c).isNull(), "null").otherwise(kinds[c]).alias("json_type"), F.lit(elements[c]).alias("element_type")) for c in cols])
    long = df.select(F.explode(each).alias("x")).select("x.*")
    return _statistics(long, [], df.agg(F.count("*").alias("__total")))


def json_cells(df: DataFrame, text: str, keep: list[str] | None = None, max_depth: int = 10) -> DataFrame:
    """(kept columns, path, value, json_type, element_type) of every field of a JSON text column in one pass over the texts.

    Elements of an array share the path of the array with ``[]``; ``element_type`` is the type of the first element of a
    non-empty array; levels end at ``max_depth``. A text that is no JSON object has no fields.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            cols: list[list] = [[], [], [], []]
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                try:
                    o = J.parse(t or "")
                except ValueError:
                    continue
                for cell in _cells(o, "", max_depth):
                    at.append(i)
                    for c, x in zip(cols, cell, strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))], *[pa.array(c, pa.string()) for c in cols]], names=[*keep, "path", "value", "json_type", "element_type"])

    d = df.select(*keep, F.col(text).cast("string").alias("__text"))
    return d.mapInArrow(run, T.StructType([*d.schema.fields[:-1], *[T.StructField(n, T.StringType()) for n in ("path", "value", "json_type", "element_type")]]))


def _cells(o: object, prefix: str, depth: int) -> Iterator[tuple[str, str | None, str, str | None]]:
    if not isinstance(o, dict) or depth <= 0:
        return
    for k, v in o.items():
        path = f"{prefix}.{k}" if prefix else k
        text = None if v is None else J.scalar_text(v)
        yield path.encode("utf-8", "replace").decode(), text if text is None else text.encode("utf-8", "replace").decode(), J.type_name(v), J.type_name(v[0]) if isinstance(v, list) and v else None
        if isinstance(v, dict):
            yield from _cells(v, path, depth - 1)
        elif isinstance(v, list):
            for x in v:
                yield from _cells(x, path + "[]", depth - 1)


def profile_json(df: DataFrame, text: str, by: list[str] | None = None, max_depth: int = 10, overall: bool = False) -> DataFrame:
    """Field profiles of a JSON text column by the columns ``by``; with ``overall`` also those of all rows, whose ``by`` are null.

    ``percentage`` is of the rows of the group and may exceed 100 inside arrays.
    """
    by = by or []
    cells = json_cells(df, text, by, max_depth)
    total = df.groupBy(*by).agg(F.count("*").alias("__total"))
    if by and overall:
        # both groupings from one pass: each cell counts in its group and in the whole
        total = df.rollup(*by).agg(F.count("*").alias("__total"), F.grouping_id().alias("__g")).filter(F.col("__g").isin(0, 2 ** len(by) - 1))
        whole = F.struct(F.lit(2 ** len(by) - 1).cast("bigint").alias("__g"), *[F.lit(None).cast(cells.schema[c].dataType).alias(c) for c in by])
        own = F.struct(F.lit(0).cast("bigint").alias("__g"), *by)
        cells = cells.select(F.explode(F.array(own, whole)).alias("x"), "path", "value", "json_type", "element_type").select("x.*", "path", "value", "json_type", "element_type")
        by = ["__g", *by]
    return _statistics(cells, by, total).drop("__g")


def sample_rate(sampled: DataFrame, every: DataFrame) -> DataFrame:
    """sampled_rows, total_rows and their ratio."""
    n = sampled.agg(F.count("*").alias("sampled_rows")).join(F.broadcast(every.agg(F.count("*").alias("total_rows"))))
    return n.withColumn("sample_rate", F.when(F.col("total_rows") > 0, F.col("sampled_rows") / F.col("total_rows")).otherwise(0.0))


def profile_groups(df: DataFrame, column: str, folder: str) -> DataFrame:
    """Global and per-folder value counts in one pass (grouping sets)."""
    df.select(column, folder).createOrReplaceTempView("__profile")
    return df.sparkSession.sql(f"SELECT `{folder}` AS folder, `{column}` AS value, count(*) AS occurrences FROM __profile GROUP BY GROUPING SETS ((`{column}`), (`{folder}`, `{column}`))")


def sampled(df: DataFrame, fraction: float, seed: int, max_samples: int | None = None) -> DataFrame:
    """The sampling operator of schema discovery: seeded, with an optional cap."""
    d = df if fraction >= 1 else df.sample(fraction=fraction, seed=seed)
    return d.limit(max_samples) if max_samples else d
