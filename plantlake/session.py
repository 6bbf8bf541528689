"""Session settings and the shared scratch folder."""

from __future__ import annotations

from pathlib import Path
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T


def get_session(app: str = "plantlake", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """UTC session with adaptive execution; everything else stays with the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; Spark's file server hands it out."""
    context = spark.sparkContext
    if getattr(context, "_plantlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="plantlake-code-")) / "plantlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(str(target))
    context._plantlake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster must name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="plantlake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Give a table read in fewer pieces than there are cores to all of them; larger tables stay as they are.

    For plain scans ahead of work that is heavy per row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage so that an operator with several passes over an intermediate reads the same
    rows in each of them, also after an executor was lost. Columnar, so later passes stay pruned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_sized(df: DataFrame, label: str = "settled") -> tuple[DataFrame, int]:
    """``settle``, and the size of the rows as measured while they were written."""
    seen = Observation()
    kept = settle(df.observe(seen, F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")), label)
    # an empty input may be planned away together with its measurement
    return kept, (seen.get or {}).get("bytes") or 0


def row_bytes(df: DataFrame) -> Column:
    """Size of a row: eight bytes per plain value, the real length of everything else."""
    total = F.lit(16)
    for field in df.schema.fields:
        name, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            width = F.octet_length(name)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            width = F.size(name) * 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            width = F.octet_length(F.to_json(F.struct(name)))
        else:
            width = F.lit(8)
        total = total + F.coalesce(width, F.lit(0))
    return total.cast("long")
