"""Session helpers: the shared folder, lineage cuts and skew-safe joins.

Executors can be lost at any time, so lineage is cut only by reliable
checkpoints in the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of the rows of one task is salted.
ROWS_PER_TASK = 200_000
#: Bits of Spark's estimate of a frame's bytes; a longer one says nothing of its size.
ESTIMATE_BITS = 100


def local_session(cores: int = 8, shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("celltrail")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="celltrail-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` reliably to the shared folder and go on from there.

    A checkpoint keeps Spark's estimate of its bytes, and a join multiplies those
    of its sides: in a loop that joins a frame to itself the number's length
    doubles each time, until it fills the driver. So long ones are forgotten.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes().bit_length() <= ESTIMATE_BITS:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``left`` to ``right`` (few rows a ``key``, often one) when ``left`` may be skewed.

    Keys of ``left`` are counted with partial aggregation; only those beyond
    ``rows_per_task`` get salts, as many as their count asks for, and only
    their rows of ``right`` are repeated that often. All other rows join
    as usual. ``how`` is ``left`` or ``inner``. Null keys never match.
    The number of hot keys is at most rows / ``rows_per_task``.
    """
    hot = (
        left.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select(key, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_salts"))
    )
    hot = cut_lineage(hot)
    if hot.isEmpty():
        return left.join(right, key, how)
    wide = right.join(hot, key, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    wide = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    spread = left.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*[c for c in left.columns if not _is_map(left, c)]), F.col("_salts")).cast("int")
        ),
    )
    return spread.drop("_salts").join(wide, [key, "_salt"], how).drop("_salt")


def _is_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once an application; its driver serves the archive."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="celltrail-")) / "celltrail.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the named tables under ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, whatever signs the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")
