"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a dimension may have to be broadcast; above it dim_join salts a shuffle join instead.
BROADCAST_ROWS = 50_000
#: Characters of text such a dimension may have.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Copies of each dimension row when a shuffle join is salted against hot keys.
SALTS = 16


def get_session(app: str = "siltsieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; existing settings win over none of them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; make a folder only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"siltsieve-{uuid.uuid4().hex[:8]}"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, below the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: later reads survive lost executors and do not recompute."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Texts that hold nothing, in lower case and without outer blanks.
NOTHING = ["", "null", "n/a"]


def holds(c: Column | str) -> Column:
    """True where a text holds something: not null, blank, ``null`` or ``n/a`` in any case."""
    return F.coalesce(~F.lower(strip(c)).isin(*NOTHING), F.lit(False))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, tabs and line breaks included."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\n\x0b\f\r\u00a0"))


def is_small(dim: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``bound`` rows and BROADCAST_BYTES of text; the count stops early."""
    texts = [f.name for f in dim.schema.fields if f.dataType.simpleString() not in ("bigint", "int", "double", "boolean", "date", "timestamp")]
    size = sum((F.coalesce(F.length(F.to_json(F.struct(f"`{c}`"))), F.lit(0)) for c in texts), F.lit(0))
    rows, chars = dim.limit(bound + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= bound and chars <= BROADCAST_BYTES


def dim_join(big: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large table to a dimension on equal key names without trusting the key distribution.

    A dimension of at most ``bound`` rows and BROADCAST_BYTES of text (counted, with an early stop) is broadcast. A
    larger one is joined by shuffle with every key salted, so that a key holding a third of all rows is spread over
    SALTS tasks, besides the splitting of skewed partitions by the adaptive execution.
    """
    if is_small(dim, bound):
        return big.join(F.broadcast(dim), keys, how)
    salted = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = big.withColumn("__salt", F.pmod(F.spark_partition_id() * 31 + F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*keys, "__salt"], how).drop("__salt")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of whatever cluster the session runs on, once per application."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_siltsieve_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    work = Path(tempfile.mkdtemp(prefix="siltsieve-"))
    shutil.copytree(root, work / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(work / f"{root.name}-{sc.applicationId}"), "zip", work / "src"))
    shutil.rmtree(work / "src")
    sc._siltsieve_shipped = True
    return spark
