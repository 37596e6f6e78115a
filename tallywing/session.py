"""Session settings the operators expect."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def spark_session(app: str = "tallywing", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for ``.``.

    On a cluster leave ``master`` unset and let spark-submit choose. Adaptive
    execution coalesces small shuffle partitions and splits skewed join
    partitions, so ``spark.sql.shuffle.partitions`` may be set generously.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def require_utc(spark: SparkSession) -> None:
    """Refuses a session in another zone, in which stored times would shift without a sign."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, it is {zone}")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the package to the Python workers, which load functions by module name."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = os.path.dirname(os.path.abspath(__file__))
        root = os.path.dirname(package)
        archive = os.path.join(tempfile.mkdtemp(prefix="tallywing-code-"), "tallywing-code.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
        context.addPyFile(archive)
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate output.

    It lies under the shared folder the cluster names in ``spark.checkpoint.dir``. Where
    that is unset, a machine-local folder serves a local master (tests); any other
    master is refused, because executors would not see each other's files.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return tempfile.mkdtemp(prefix=f"tallywing-{name}-")
    return f"{shared.rstrip('/')}/tallywing-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    For results that several later steps read, or that an iterative fit reads many
    times: the table outlives lost executors and has no lineage to recompute.
    """
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
