"""Session factory and null-safe expression helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName("weftlink").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def div(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def same(a: Column, b: Column) -> Column:
    """Equality that counts null as different from everything."""
    return F.coalesce(a == b, F.lit(False))


def portable_bucket(n: int, *cols: Column) -> Column:
    """A bucket from 0 to n - 1 that any engine with md5 can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long") % n


_KEPT: dict[tuple[str, str], tuple[str, str]] = {}
_OWN: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    folder of its own, removed at exit; on a cluster that is an error, since executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="weftlink-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage hangs on executors."""
    path = f"{work_dir(df.sparkSession)}/weftlink-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, key: str) -> DataFrame:
    """``df`` written once per application and reused: by ``key`` and by the plan, which names the files that are read with
    their sizes and times. So changed files, or another ``df`` under the key, give a new table."""
    spark = df.sparkSession
    name = (spark.sparkContext.applicationId, key)
    plan = _plan_of(df)
    held = _KEPT.get(name)
    if held is None or held[0] != plan:
        path = f"{work_dir(spark)}/weftlink-{uuid.uuid4().hex}"
        df.write.parquet(path)
        tasks = spark.sparkContext.defaultParallelism
        few = spark.read.schema(df.schema).parquet(path)
        if few.rdd.getNumPartitions() < tasks:  # a small table in a file or two would keep one core busy
            path += "-dealt"
            few.repartition(tasks).write.parquet(path)
        _KEPT[name] = held = plan, path
    return spark.read.schema(df.schema).parquet(held[1])


def _plan_of(df: DataFrame) -> str:
    """What a DataFrame computes: its canonical plan and the state of its input files."""
    jvm, hadoop = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = sorted(df.inputFiles())
    files = [f"{len(found)} {found[-1:]}"]
    for f in found[:1000]:  # of more, names and number tell
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(hadoop).getFileStatus(path)
        files.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return f"{df._jdf.queryExecution().analyzed().canonicalized().hashCode()} " + "\n".join(files)
