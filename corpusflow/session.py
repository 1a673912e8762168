"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "corpusflow") -> SparkSession:
    """Create (or reuse) a session. On a cluster pass ``master=None`` and let spark-submit decide."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):  # on a cluster spark-submit sizes the driver
        builder = builder.config("spark.driver.memory", os.environ.get("CORPUSFLOW_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


BATCH_BYTES = 8 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, unless the session sets a limit of its own: a task that gets whole texts
    holds a batch several times over (in the JVM, on the way, as Python objects)."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT).rstrip("b") == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusflow`` importable in every Python worker (what ``--py-files`` does).

    Arrow UDFs and ``mapInPandas`` functions refer to this package's modules, which
    the executors' Python workers must import. The package is zipped once per
    application into the shared checkpoint folder and added with ``addPyFile``.
    """
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # pragma: no cover - Connect sessions ship code with addArtifacts
        return
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = ensure_checkpoint_dir(spark)
    if "://" in root and not root.startswith("file:"):
        # A remote checkpoint store: build the archive on the driver; addPyFile
        # serves it to the executors itself (code, not job data).
        out_dir = tempfile.mkdtemp(prefix="corpusflow-pyfiles-")
    else:
        out_dir = os.path.join(root.replace("file://", "").replace("file:", ""), "corpusflow-pyfiles", uuid.uuid4().hex)
        os.makedirs(out_dir, exist_ok=True)
    target = os.path.join(out_dir, "corpusflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (None if unset)."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - no SparkContext (Connect)
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; only when unset (tests, local runs) make one."""
    existing = checkpoint_dir(spark)
    if existing:
        try:
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(existing)
        except Exception:  # pragma: no cover - no SparkContext (Connect)
            pass
        return existing
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    try:
        spark.sparkContext.setCheckpointDir(local)
    except Exception:  # pragma: no cover
        pass
    return local
