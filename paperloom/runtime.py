"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its bytes stay below the limit; left rows of one key in a task before the key is spread.
BROADCAST_LIMIT_BYTES = 8 << 20
ROWS_A_TASK = 2_000_000


def session(app: str = "paperloom", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Where neither is set (tests on one machine) a temporary folder is made, and removed at the
    end; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="paperloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so a lost executor loses nothing and plans stay short."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free(*frames: DataFrame) -> None:
    """Delete the files of ``cut`` frames that nothing reads any more: all that comes of them is cut itself.

    Frames that aren't cut, or whose files are gone, are passed by.
    """
    for df in frames:
        file = _cut_file(df)
        if file is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _cut_file(df: DataFrame) -> str | None:
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return None
    file = plan.rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


def bytes_of(df: DataFrame, row_bytes: int) -> int:
    """Bytes of a frame's values, measured over all rows, ``row_bytes`` a row at least."""
    def size(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0))
        if kind.startswith(("array", "struct", "map")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
        return F.lit(8)

    each = sum((size(n, k) for n, k in df.dtypes), F.lit(16))
    return df.agg(F.coalesce(F.sum(F.greatest(each, F.lit(row_bytes))), F.lit(0)).cast("long")).first()[0]


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int = 200) -> DataFrame:
    """Join with a right side whose size is measured first.

    The right side is broadcast only if its bytes are below the limit. Else both sides are shuffled,
    and keys with more than ROWS_A_TASK left rows (nulls too) are counted and spread: each of their left rows
    draws one of as many salts as the key needs tasks, and the right rows of these keys only are
    repeated for them. There are at most rows / ROWS_A_TASK such keys, so their table is broadcast.
    The salt is a hash of the row, so a task that is run again after a loss gives each row the same one.
    """
    if bytes_of(right, row_bytes) <= BROADCAST_LIMIT_BYTES:
        return left.join(F.broadcast(right), on, how)
    hot = left.groupBy(*(F.col(c).alias(f"_h_{c}") for c in on)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS_A_TASK)
    hot = cut(hot.select(*(f"_h_{c}" for c in on), F.ceil(F.col("_n") / ROWS_A_TASK).cast("int").alias("_salts")))
    if hot.isEmpty():
        return left.join(right, on, how)

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        same = F.lit(True)
        for c in on:
            same &= F.col(c).eqNullSafe(F.col(f"_h_{c}"))
        return df.join(F.broadcast(hot), same, "left").withColumn("_salt", salt).drop("_salts", *(f"_h_{c}" for c in on))

    hashed = [c for c, kind in left.dtypes if "map<" not in kind]  # maps have no hash
    one = F.coalesce("_salts", F.lit(1))
    spread = salted(left, F.pmod(F.xxhash64(*hashed), one).cast("int"))
    many = salted(right, F.explode(F.sequence(F.lit(0), one - 1)))
    return spread.join(many, [*on, "_salt"], how).drop("_salt")
