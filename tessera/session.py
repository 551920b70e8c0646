"""SparkSession construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces shuffle
# partitions at runtime; skew-join splits hot partitions; UTC keeps
# timestamp-without-zone parquet columns stable across machines.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # joins on (key, x) may reuse a child already hash-partitioned by key alone
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


SPREAD = "spark.tessera.spread"


def get_spark(master: str | None = None, app: str = "tessera",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor; a 1 GB default heap thrashes
        conf["spark.driver.memory"] = "16g"
        conf[SPREAD] = str(os.cpu_count() or 1)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in Python workers (as ``--py-files`` would).

    Pandas UDFs and ``mapInPandas`` functions are pickled by reference to
    their module, so executors need the package. It is zipped once per
    application and added with ``addPyFile``; Spark distributes it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-pyfiles-"), "tessera.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Only when it is unset and the master is local (tests) a
    private scratch folder is created and registered; on a cluster that
    would be a different folder on every machine, so it raises.
    """
    sc = spark.sparkContext
    ship_package(spark)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written in the shared checkpoint folder (survives executor loss).

    A parquet write computes the plan once; ``Dataset.checkpoint`` on an
    unpersisted plan computes it twice (the job, then the checkpoint write)
    and stores rows serialised, so the written table is the cheaper reliable cut.
    """
    return materialize(df, "cut")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used for intermediates that several branches read: columnar files let
    each branch read only its columns, and the written table survives
    executor loss like a checkpoint does.
    """
    import uuid

    path = f"{checkpoint_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute before CPU-heavy per-row work when the session asks for it.

    ``spark.tessera.spread`` is the number of partitions (unset: nothing moves). It suits inputs whose files hold a single
    row group, which Spark cannot split; it is a setting and does not look at the input.
    """
    n = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(n) if n > 0 else df
