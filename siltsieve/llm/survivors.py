"""One surviving record per duplicate group, chosen field by field, and the row that is best in every respect.

Method: a latent two-sided quality model. A fact is an (id, field, value); a source covers it if it states
any value for that id and field. Each source has per field a sensitivity and a false-claim rate, inferred by
expectation-maximisation over counts of (covering sources, claiming sources) patterns, into which all facts
are aggregated before anything is collected. Fields with several values keep each value judged true; the
surviving record takes the value of highest posterior, then latest, then most trusted. Facts also carry the merits
of the rows that state them, so the row that is best in every respect comes from the same judged facts.

Defined edge cases: rows whose id holds nothing belong to no group; ids compare trimmed in lower case; a
group of one row survives as it is and has no best row; repeated rows count as rows but as one claim of
their source; a missing source is a source of its own and least trusted; ties go to the smallest row_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltsieve.operators.instants import normalise_timestamps
from siltsieve.session import BROADCAST_ROWS, NOTHING, cut, dim_join, holds, strip

FIELDS = ["firstname", "lastname", "email", "mobile", "postcode"]
MULTI = ["email", "mobile"]
#: The field by which a row claims itself, and the instant of a row without one.
ROW, NEVER = "", -(1 << 62)
ROUNDS = 12
#: Rows of one (id, field) beyond which its coverage is joined by broadcast instead of by shuffle.
HOT_ROWS = 5_000
MAX_PARAMETERS = 100_000
#: Beta priors (hits, misses) of sensitivity and of false claims, and the prior share of true facts.
SENSITIVE, FALSE, TRUE_SHARE = (8.0, 4.0), (2.0, 10.0), 0.5


def prepared(records: DataFrame, source_profiles: DataFrame) -> DataFrame:
    """Rows with a usable id: gid, source, instant in ms, trust rank, completeness. The dates are parsed once."""
    d = records.select("row_id", F.lower(strip("id")).alias("gid"), "datasource", "sourcemodifieddate", *[F.when(holds(f), strip(f)).alias(f) for f in FIELDS])
    d = normalise_timestamps(d.filter(~F.col("gid").isin(*NOTHING)), "sourcemodifieddate", "datasource", source_profiles)
    src = F.coalesce(F.when(holds("datasource"), F.lower(strip("datasource"))), F.lit(""))
    rank = source_profiles.select(F.lower(strip("datasource")).alias("source"), F.col("trust_rank").cast("bigint").alias("trust_rank")).dropDuplicates(["source"])
    d = dim_join(d.withColumn("source", src).withColumn("ms", F.floor(F.col("instant_us") / 1000)), rank, ["source"])
    full = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    return d.select("gid", "row_id", "source", "ms", "trust_rank", full.alias("filled"), *FIELDS)


def claims(rows: DataFrame, country: str = "") -> DataFrame:
    """(gid, source, field, value, shown, row): what each row says, values made comparable, and the row's own merits.

    Each row also claims itself (the field ROW), so that rows which say nothing count in their group. ``country`` is
    the calling code that mobiles may be written with or without.
    """
    digits = F.regexp_replace("mobile", "[^0-9]", "")
    phone = F.regexp_replace(digits, f"^(?:0*{country}(?=[0-9]{{9}}$)|0+)", "") if country else F.ltrim(digits, F.lit("0"))
    same = {"mobile": phone, "email": F.lower(F.regexp_replace("email", r"\s", ""))}
    each = [F.struct(F.lit(f).alias("field"), same.get(f, F.lower(f)).alias("value"), F.col(f).alias("shown")) for f in FIELDS]
    itself = F.struct(F.lit(ROW).alias("field"), F.lit("").alias("value"), F.lit(None).cast("string").alias("shown"))
    row = F.struct(F.col("filled").alias("filled"), F.coalesce("ms", F.lit(NEVER)).alias("ms"), (-F.coalesce("trust_rank", F.lit(1 << 40))).alias("trust"), (-F.col("row_id")).alias("neg_id"))
    said = rows.select("gid", "source", row.alias("row"), F.explode(F.array(*each, itself)).alias("c"))
    return said.select("gid", "source", "row", "c.*").filter(F.col("value").isNotNull())


def facts(said: DataFrame) -> DataFrame:
    """(gid, field, value) with the sources that claim it, those that cover the field, and the merits of its rows.

    All aggregates are mergeable before the shuffle: a hot id costs a task its distinct values, never its rows.
    """
    itself = lambda c: F.max(F.when(F.col("field") == ROW, F.col(c)))
    f = said.groupBy("gid", "field", "value").agg(
        F.array_sort(F.collect_set("source")).alias("claiming"), F.max(F.struct("row.ms", "row.trust", "shown")).alias("latest"), F.count("*").alias("n_rows"),
        F.struct(*[itself(f"row.{x}").alias(x) for x in ("filled", "ms", "trust")], itself("row").alias("top")).alias("merits"),
    )
    f = cut(f)
    cover = f.select("gid", "field", F.posexplode("claiming").alias("i", "s")).groupBy("gid", "field").agg(F.array_sort(F.collect_set("s")).alias("covering"), F.count_if(F.col("i") == 0).alias("n"))
    cover = cut(cover)
    hot = cover.filter(F.col("n") > HOT_ROWS).select("gid", "field")
    cover = cover.drop("n")
    if hot.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return dim_join(f, cover, ["gid", "field"], "inner", bound=0)
    if hot.limit(1).count() == 0:
        return f.join(cover, ["gid", "field"])
    few = F.broadcast(hot)
    return f.join(few, ["gid", "field"], "left_anti").join(cover.join(few, ["gid", "field"], "left_anti"), ["gid", "field"]).unionByName(f.join(few, ["gid", "field"]).join(F.broadcast(cover.join(few, ["gid", "field"])), ["gid", "field"]))


def _posterior(field: str, covering: list[str], claiming: list[str], theta: dict) -> float:
    z = np.log(TRUE_SHARE / (1 - TRUE_SHARE))
    said = set(claiming)
    for s in covering:
        sens, false = theta.get((field, s), (0.75, 0.15))
        z += np.log(sens / false) if s in said else np.log((1 - sens) / (1 - false))
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit_quality(patterns: DataFrame, rounds: int = ROUNDS) -> dict[tuple[str, str], tuple[float, float]]:
    """(field, source) -> (sensitivity, false-claim rate). patterns: field, covering, claiming, n, materialised."""
    theta: dict[tuple[str, str], tuple[float, float]] = {}
    schema = "field string, source string, ct double, t double, cf double, f double"
    for _ in range(rounds):

        def expect(frames, theta=theta):
            acc: dict[tuple[str, str], np.ndarray] = {}
            for pdf in frames:
                for field, covering, claiming, n in zip(pdf["field"], pdf["covering"], pdf["claiming"], pdf["n"], strict=True):
                    p, said = _posterior(field, covering, claiming, theta), set(claiming)
                    for s in covering:
                        hit = s in said
                        a = acc.setdefault((field, s), np.zeros(4))
                        a += n * np.array([p * hit, p, (1 - p) * hit, 1 - p])
            yield pd.DataFrame([(*k, *v) for k, v in acc.items()], columns=["field", "source", "ct", "t", "cf", "f"])

        sums = patterns.mapInPandas(expect, schema).groupBy("field", "source").agg(*[F.sum(c).alias(c) for c in ("ct", "t", "cf", "f")]).limit(MAX_PARAMETERS + 1).collect()
        if len(sums) > MAX_PARAMETERS:
            raise ValueError("too many sources")
        new = {(r["field"], r["source"]): ((r["ct"] + SENSITIVE[0]) / (r["t"] + sum(SENSITIVE)), (r["cf"] + FALSE[0]) / (r["f"] + sum(FALSE))) for r in sums}
        moved = max((abs(a - b) for k, v in new.items() for a, b in zip(v, theta.get(k, (9, 9)), strict=True)), default=0)
        theta = new
        if moved < 1e-4:
            break
    return theta


def judged(rows: DataFrame, country: str = "") -> DataFrame:
    """Every fact with its posterior probability of being true; the facts of the field ROW are what they are."""
    f = cut(facts(claims(rows, country)))
    patterns = cut(f.filter(F.col("field") != ROW).groupBy("field", "covering", "claiming").agg(F.count("*").alias("n")))
    theta = fit_quality(patterns)

    @F.pandas_udf(T.DoubleType())
    def posterior(field: pd.Series, covering: pd.Series, claiming: pd.Series) -> pd.Series:
        return pd.Series([_posterior(a, b, c, theta) for a, b, c in zip(field, covering, claiming, strict=True)], dtype=float)

    p = patterns.select("field", "covering", "claiming", posterior("field", "covering", "claiming").alias("posterior"))
    if p.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return f.join(F.broadcast(p), ["field", "covering", "claiming"], "left")
    return f.withColumn("posterior", posterior("field", "covering", "claiming"))


def true_values(records: DataFrame, source_profiles: DataFrame, country: str = "", least: float = 0.5) -> DataFrame:
    """(id, field, value, posterior) of every value judged true in the fields that may have several."""
    f = judged(prepared(records, source_profiles), country)
    return f.filter(F.col("field").isin(MULTI) & (F.col("posterior") >= least)).select(F.col("gid").alias("id"), "field", "value", "posterior")


def survivors(records: DataFrame, source_profiles: DataFrame, country: str = "") -> DataFrame:
    """One row per id: surviving values with posteriors, number of true e-mails and mobiles, n_rows, best_row_id.

    All of it is one aggregation of the judged facts. ``best_row_id`` is the row no other row beats on completeness,
    instant or trust: it has the maximum of all three, so it is the lexicographic maximum of the group if there is one.
    """
    f = judged(prepared(records, source_profiles), country)
    best = lambda x: F.max(F.when(F.col("field") == x, F.struct("posterior", "latest.ms", "latest.trust", F.col("latest.shown").alias("shown"))))
    many = lambda x: F.sum(F.when((F.col("field") == x) & (F.col("posterior") >= 0.5), 1).otherwise(0))
    merits = [F.max(f"merits.{x}").alias(f"__{x}") for x in ("filled", "ms", "trust", "top")]
    g = f.groupBy("gid").agg(*[best(x).alias(x) for x in FIELDS], *[many(x).alias(f"n_{x}") for x in MULTI], F.max(F.when(F.col("field") == ROW, F.col("n_rows"))).alias("n_rows"), *merits)
    whole = (F.col("n_rows") >= 2) & (F.col("__top.filled") == F.col("__filled")) & (F.col("__top.ms") == F.col("__ms")) & (F.col("__top.trust") == F.col("__trust"))
    return g.select(F.col("gid").alias("id"), *[F.col(f"{x}.shown").alias(x) for x in FIELDS], *[F.round(f"{x}.posterior", 6).alias(f"p_{x}") for x in FIELDS], *[f"n_{x}" for x in MULTI], "n_rows", F.when(whole, -F.col("__top.neg_id")).alias("best_row_id"))
