"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_local_base: dict[str, str] = {}


def local_session(app: str = "loglens", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the submitter configures the session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(STATE_PROVIDER, ROCKSDB_PROVIDER)
        .getOrCreate()
    )


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for stream checkpoints and intermediate tables.

    It lies in the shared folder the cluster names in ``spark.checkpoint.dir``. Only a local session without
    that setting falls back to a temporary folder; on a cluster such a folder would be lost with its machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _local_base.setdefault(app, "") or tempfile.mkdtemp(prefix="loglens-")
        _local_base[app] = base
    return f"{base.rstrip('/')}/loglens/{name}-{uuid.uuid4().hex}"
