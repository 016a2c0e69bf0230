"""Duplicate keys and rows, their counts by folder, survivors and hash statistics of tables.

Everything is long form: a duplicate group is its rows, never an array, so that a group may hold any share
of the table. Counts are reduced before they are joined back, and unique keys are dropped before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_form(c: str, dtype: T.DataType | None = None) -> Column:
    return F.col(c).cast("string") if not isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(F.col(c))


def canonical_row(df: DataFrame, mode: str = "full_row", include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """JSON text of the chosen columns in name order, nulls kept: rows are equal exactly if it is."""
    if mode not in ("full_row", "selective", "exclude_keys"):
        raise ValueError(f"unknown hashing mode {mode!r}")
    names = sorted(df.columns)
    if mode == "selective":
        names = [n for n in names if n in set(include or [])]
    elif mode == "exclude_keys":
        names = [n for n in names if n not in set(exclude or [])]
    return F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")


def row_hash(text: Column, algorithm: str = "sha256") -> Column:
    if algorithm in ("sha256", "md5"):
        return F.sha2(text, 256) if algorithm == "sha256" else F.md5(text)
    if algorithm == "fnv":
        from siltsieve.functions.jsontext import fnv1a64

        @F.pandas_udf(T.StringType())
        def label(s):
            return s.map(lambda x: None if x is None else str(fnv1a64(x.encode())))

        return label(text)
    raise ValueError(f"unknown hash algorithm {algorithm!r}")


def composite_hash(primary: Column, secondary: Column) -> Column:
    return F.sha2(F.concat(primary, F.lit(":"), secondary), 256)


def duplicate_groups(df: DataFrame, keys: list[str | Column], count: str = "occurrences") -> DataFrame:
    """Key groups of more than one row; null keys are no keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    d = df.filter(cols[0].isNotNull()) if len(cols) == 1 else df
    return d.groupBy(*cols).agg(F.count("*").alias(count)).filter(F.col(count) > 1)


def duplicate_members(df: DataFrame, key: str) -> DataFrame:
    """The rows of duplicate groups, each with its group's size: locations without collecting any."""
    return df.join(duplicate_groups(df, [key]), key)


def duplicate_summary(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """total_occurrences, keys_duplicated and duplicate_instances in one pass over key counts."""
    n = df.groupBy(*[F.col(k) if isinstance(k, str) else k for k in keys]).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("total_occurrences"), F.count_if(F.col("n") > 1).alias("keys_duplicated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("duplicate_instances"))


def folder_rollup(df: DataFrame, folder: str, key: str, row_text: str) -> DataFrame:
    """Rows, keys found, rows with a duplicated key and duplicated rows per folder."""
    by = lambda k, name: df.groupBy(folder, k).agg(F.count("*").alias("n")), lambda k: df.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("all"))
    out = df.groupBy(folder).agg(F.count("*").alias("rows_processed"), F.count(key).alias("keys_found"))
    for k, name in ((key, "duplicate_ids"), (row_text, "duplicate_rows")):
        per, whole = by[0](k, name), by[1](k).filter("all > 1")
        hit = per.join(whole, k).groupBy(folder).agg(F.sum("n").alias(name))
        out = out.join(hit, folder, "left")
    return out.fillna(0, ["duplicate_ids", "duplicate_rows"])


def folder_files(df: DataFrame, folder: str, file: str) -> DataFrame:
    """Rows, files with rows, and rows per such file of each folder."""
    n = df.groupBy(folder, file).agg(F.count("*").alias("n"))
    return n.groupBy(folder).agg(F.sum("n").alias("rows_processed"), F.count(file).alias("files_processed")).withColumn("rows_per_file", F.col("rows_processed") / F.col("files_processed"))


def survivors(df: DataFrame, key: str, strategy: str, order: list[str], newest: str | None = None, score: Column | None = None) -> DataFrame:
    """One row per key: first or last in ``order``, newest or oldest by a time column, or most_complete by score."""
    asc, desc = [F.col(c).asc() for c in order], [F.col(c).desc() for c in order]
    by = {
        "first": asc, "interactive": asc, "last": desc,
        "newest": [F.col(newest).desc_nulls_last(), *asc] if newest else None,
        "oldest": [F.col(newest).asc_nulls_last(), *asc] if newest else None,
        "most_complete": [score.desc(), *asc] if score is not None else None,
    }.get(strategy)
    if by is None:
        raise ValueError(f"strategy {strategy!r} is unknown or lacks its column")
    # a group limit by rank is pushed below the shuffle, so a hot key sends one row per task
    w = Window.partitionBy(key).orderBy(*by)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def completeness(df: DataFrame, columns: list[str] | None = None) -> Column:
    """How many columns hold neither null nor empty text."""
    return sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns or df.columns), F.lit(0))


def semantic_text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r]+", " "))


def dedup_summary(df: DataFrame, key: str, strategy: str) -> DataFrame:
    """Keys, keys with duplicates, rows, and rows kept and purged when each key keeps one row, in one pass over key counts."""
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    out = n.agg(F.count("*").alias("total_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"))
    return out.select("*", F.col("total_keys").alias("kept_rows"), (F.col("total_rows") - F.col("total_keys")).alias("purged_rows"), F.lit(strategy).alias("strategy"))


def hash_metrics(df: DataFrame, hashed: Column) -> DataFrame:
    n = df.groupBy(hashed.alias("h")).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("total_rows"), F.count("*").alias("unique_hashes"), F.count_if(F.col("n") > 1).alias("collided")).select("*", (1 - F.col("unique_hashes") / F.col("total_rows")).alias("collision_rate"))


def key_variance(df: DataFrame, columns: list[str], exclude_above: float = 0.8) -> DataFrame:
    """Distinct over occurrences per column; a column above the bound is suggested for exclusion."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    n = df.select(each.alias("x")).select("x.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    out = n.groupBy("column").agg(F.sum("n").alias("occurrences"), F.count("*").alias("unique_values"))
    return out.withColumn("variance", F.col("unique_values") / F.col("occurrences")).withColumn("suggest_exclude", F.col("variance") > exclude_above)


def unprocessed(every: DataFrame, done: DataFrame) -> DataFrame:
    """Sources not yet processed, as a multiset difference."""
    return every.exceptAll(done)


TIME_FIELDS = ["updated_at", "modified_at", "timestamp", "created_at", "date"]
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy"]


def row_time(df: DataFrame, fields: list[str] | None = None) -> Column:
    """The first candidate field that reads as a time under one of the known layouts."""
    present = [f for f in fields or TIME_FIELDS if f in df.columns]
    return F.coalesce(F.lit(None).cast("timestamp"), *[F.try_to_timestamp(F.col(f).cast("string"), F.lit(x)) for f in present for x in TIME_FORMATS])
