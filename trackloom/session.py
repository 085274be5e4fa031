"""Session helpers: shared storage, materialisation and shipping of this package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trackloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_trackloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="trackloom-"), "trackloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._trackloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). In local mode a temporary one is set where none is; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is removed when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/trackloom-{sc.applicationId}"
    if getattr(sc, "_trackloom_scratch", None) != path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._trackloom_scratch, sc._trackloom_made = path, []
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder; release() removes those made since a point."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.sparkContext._trackloom_made.append(path)
    return path


def made(spark: SparkSession) -> int:
    """A point for release()."""
    scratch_dir(spark)
    return len(spark.sparkContext._trackloom_made)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove the intermediate tables made since a point of made(), save those of `keep`; what read them must be written by now."""
    paths, kept = spark.sparkContext._trackloom_made, {getattr(df, "_trackloom_path", None) for df in keep}
    for path in paths[since:]:
        if path not in kept:
            remove(spark, path)
    paths[since:] = [p for p in paths[since:] if p in kept]


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, tidy: bool = False, **metrics: Column) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back, so that a lost executor costs no recomputation.

    metrics are aggregates taken while writing; their values are in the `measured` dict of the result. tidy: what the write
    shuffled is removed when it ends, instead of when the driver next collects its garbage; nothing reads it any more. The
    table is written with zstd, for less disk at more CPU time.
    """
    spark = df.sparkSession
    path, schema, seen = fresh_path(spark, name), df.schema, None
    if metrics:
        seen = Observation()
        df = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
    before = spark.conf.get(_TIDY, "false")
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path) if tidy else df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema(schema).parquet(path)
    out._trackloom_path = path
    out.measured = seen.get if seen else {}
    return out


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_trackloom_path", None)
    if path:
        remove(df.sparkSession, path)
        paths = df.sparkSession.sparkContext._trackloom_made
        if path in paths:
            paths.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
