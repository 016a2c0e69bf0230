"""Mixing sources to target shares of tokens with capped repetition.

Method: capped water-filling. Each source wants share x budget tokens; a source that would have to repeat
more than its cap is clamped there and its excess is spread over the others in proportion to their shares,
until nothing changes. A source's repetitions r give every document floor(r) copies and, for the fraction,
one more copy to the documents first in a seeded hash order until the fraction of tokens is reached.

Defined edge cases: the budget, unless given, is the largest with which every source that has documents
reaches its target exactly; with a larger budget sources are clamped; a source without target has share 0; a
target without documents is clamped at 0; null and empty texts have 0 tokens and follow their hash order;
a null source is a source of its own without target; shares need not sum to 1, they are scaled.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sources one mixture may have; their sizes are kept on the driver.
MAX_SOURCES = 10_000
#: Buckets of each hash and how many hashes are nested: one task orders at most about a source / BUCKETS ** LEVELS.
BUCKETS, LEVELS = 4096, 2


def water_fill(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens per source: shares of the budget, clamped at cap x size, the excess spread in proportion."""
    out = {s: 0.0 for s in shares}
    free = {s for s in shares if shares[s] > 0 and sizes.get(s, 0) > 0}
    left = float(budget)
    while free:
        weight = sum(shares[s] for s in free)
        over = [s for s in free if shares[s] / weight * left > caps[s] * sizes[s] * (1 + 1e-12)]
        if not over:
            for s in free:
                out[s] = shares[s] / weight * left
            break
        for s in over:
            out[s] = float(caps[s] * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def largest_exact_budget(sizes: dict[str, int], shares: dict[str, float], caps: dict[str, float]) -> float:
    """Tokens of the largest mixture in which no non-empty source is clamped."""
    usable = [s for s in shares if shares[s] > 0 and sizes.get(s, 0) > 0]
    weight = sum(shares[s] for s in usable)
    return min((caps[s] * sizes[s] * weight / shares[s] for s in usable), default=0.0)


def plan_mixture(sized: DataFrame, targets: DataFrame, budget: float | None = None) -> list[dict]:
    """Per source its size, repetitions and tokens; sized has source, n_tokens."""
    sizes = {r[0]: int(r[1] or 0) for r in sized.groupBy("source").agg(F.sum("n_tokens")).limit(MAX_SOURCES + 1).collect()}
    rows = targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if max(len(sizes), len(rows)) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = {r[0]: float(r[1] or 0) for r in rows}
    caps = {r[0]: float(r[2] or 0) for r in rows}
    want = water_fill(sizes, shares, caps, largest_exact_budget(sizes, shares, caps) if budget is None else budget)
    return [{"source": s, "corpus_tokens": n, "target_share": shares.get(s, 0.0), "max_repeats": int(caps.get(s, 0)), "repeats": (want.get(s, 0.0) / n if n else 0.0), "planned_tokens": want.get(s, 0.0)} for s, n in ({s: 0 for s in shares} | sizes).items()]


def mix(sized: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens and ``copies`` of each document in the mixture, documents with no copy left out.

    The fraction of a source is cut exactly: nested hash buckets with their tokens find the bucket in which the
    fraction ends, and only that bucket's documents are ordered.
    """
    spark = sized.sparkSession
    plan = plan_mixture(sized, targets, budget)
    rows = [(p["source"], int(p["repeats"]), (p["repeats"] - int(p["repeats"])) * p["corpus_tokens"]) for p in plan]
    dim = spark.createDataFrame(rows or [(None, 0, 0.0)], "source string, whole int, extra double")
    place = [F.pmod(F.xxhash64(F.lit(seed + k), "source", "doc_id"), F.lit(BUCKETS)).cast("int").alias(f"b{k}") for k in range(LEVELS)]
    dim = dim.select(F.col("source").alias("ds"), "whole", "extra")
    d = sized.select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed + LEVELS), "doc_id").alias("order"), *place).join(F.broadcast(dim), F.col("source").eqNullSafe(F.col("ds"))).drop("ds")
    # the fraction ends in one bucket of the first hash, in that in one of the second, and only its documents are ordered
    d = d.withColumns({"left": F.col("extra"), "plus": F.lit(None).cast("int")})
    parts = []
    for k in range(LEVELS):
        sums = d.groupBy("source", f"b{k}", "left").agg(F.sum("n_tokens").alias("t"))  # at most MAX_SOURCES x BUCKETS rows
        before = Window.partitionBy("source").orderBy(f"b{k}").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
        edge = sums.filter((F.col("before") < F.col("left")) & (F.col("before") + F.col("t") > F.col("left"))).select(F.col("source").alias("es"), F.col(f"b{k}").alias("eb"), (F.col("left") - F.col("before")).alias("rest"))  # one a source
        d = d.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("es")), "left")
        on_edge = F.coalesce(F.col(f"b{k}") == F.col("eb"), F.lit(False))
        inside = F.when(F.col("eb").isNull(), F.col("left") > 0).otherwise(F.col(f"b{k}") < F.col("eb"))
        parts.append(d.filter(~on_edge).withColumn("plus", inside.cast("int")).drop("es", "eb", "rest"))
        d = d.filter(on_edge).withColumn("left", F.col("rest")).drop("es", "eb", "rest")
    run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    parts.append(d.withColumn("plus", (run - F.col("n_tokens") / 2 <= F.col("left")).cast("int")))
    both = functools.reduce(DataFrame.unionByName, parts).withColumn("copies", F.col("whole") + F.col("plus"))
    return both.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """The report: per source corpus size, target, repetitions and the share reached."""
    plan = plan_mixture(sized, targets, budget)
    dim = mixed.sparkSession.createDataFrame([(p["source"], p["corpus_tokens"], p["target_share"], p["max_repeats"], p["repeats"]) for p in plan], "source string, corpus_tokens bigint, target_share double, max_repeats int, planned_repeats double")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    d = dim.join(got.withColumnRenamed("source", "gs"), F.col("source").eqNullSafe(F.col("gs")), "left").join(F.broadcast(total))
    return d.select("source", "corpus_tokens", "target_share", "max_repeats", "planned_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"))
