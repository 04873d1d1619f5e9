"""Session settings and the one way this library cuts lineage.

Nothing here caches on an executor's local disk: a frame that several branches
of a job read again is written once as parquet under the shared folder that
``spark.checkpoint.dir`` names, and read back.  Reading it back also gives
Spark the true size of the frame, so the choice between broadcast and shuffle
join is made from a measured size and never from a hint.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Describing a plan in which this rule emptied a reused stage recurses without
    # end in Spark 4.1, so a job over empty input would fail instead of return.
    "spark.sql.adaptive.optimizer.excludedRules":
        "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


_configured: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings that results and skew handling rely on.

    Once per application: what its user sets afterwards stays.
    """
    if spark.sparkContext.applicationId in _configured:
        return spark
    _configured.add(spark.sparkContext.applicationId)
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    context = spark.sparkContext
    if context.master.startswith("local"):
        # Streaming state keeps one store per shuffle partition; the cluster
        # default of 200 would be 200 stores on a handful of threads.
        slots = context.defaultParallelism
        if int(spark.conf.get("spark.sql.shuffle.partitions")) > 2 * slots:
            spark.conf.set("spark.sql.shuffle.partitions", str(slots))
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, wherever the driver was started from.

    Functions that run in Python workers are pickled by name.  The driver serves
    the archive to the executors itself, once per application.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="scorelattice-code-"), "scorelattice_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("scorelattice", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def local_session(cpus: int | str = "*", **extra: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scorelattice")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a shared folder on a cluster"
        )
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="scorelattice-")
    return _own_dirs[app]


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored copy.

    Used where a frame feeds several branches, or where a loop would otherwise
    grow its plan without end.  A lost executor costs a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scorelattice-stage/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Share out a scan with fewer parts than the cluster has slots.

    For expression- or Python-heavy work over few, large row groups.  An input
    that already has a part per slot is left alone, so large tables are never
    shuffled for this.  Only for plain scans: counting parts plans the frame.
    """
    slots = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(slots) if scan.rdd.getNumPartitions() < slots else scan


DIMENSION_ROWS = 100_000


def dimension_join(facts: DataFrame, dimension: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a registry-like table: broadcast if it is counted as small, else shuffled.

    The count looks at no more than the limit, so it is cheap either way.
    Without it, a side that Spark cannot size (one made from local rows) makes
    it shuffle, or even broadcast, the facts.
    """
    small = dimension.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS
    return facts.join(F.broadcast(dimension) if small else dimension, on, how)
