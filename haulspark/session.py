"""Spark session settings and shared-storage helpers.

The engine never chooses a machine-local scratch folder on a cluster: lineage
is cut with ``DataFrame.checkpoint()`` into ``spark.checkpoint.dir`` (read from
the session), and only when that setting is unset -- local tests -- does
:func:`ensure_checkpoint_dir` point it at a fresh folder under ``/tmp``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of the engine runs with.  Session zone UTC makes
# naive timestamps compare equal to DuckDB's; ANSI stays on (guarded casts and
# try_divide are used throughout).
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Whole-stage codegen fuses a route's ~30 metric expressions into one Java
# method; HotSpot does not JIT methods above 8000 bytecodes unless told to, and
# an interpreted fused method is slower than no fusion at all.  JVMs started
# by the engine get the flag; sessions created elsewhere fall back to Spark's
# own limit (fused stages above HotSpot's size run unfused, still compiled).
# Python workers import the package from here (a cluster has it installed or shipped).
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JIT_FLAG = "-XX:-DontCompileHugeMethods"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "haulspark") -> SparkSession:
    """Create (or reuse) a session with the engine defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.driver.extraJavaOptions", JIT_FLAG).config("spark.executor.extraJavaOptions", JIT_FLAG)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("HAULSPARK_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Runtime-settable part of ENGINE_CONF (for sessions made elsewhere)."""
    for k, v in ENGINE_CONF.items():
        if k == "spark.ui.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass
    sc = spark.sparkContext
    sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(
        [PACKAGE_ROOT, *filter(None, sc.environment.get("PYTHONPATH", "").split(os.pathsep))]))
    opts = sc.getConf().get("spark.driver.extraJavaOptions", "") or ""
    if JIT_FLAG not in opts:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests): it gets a fresh
    folder under the system's temporary one.  On a cluster that would be a
    machine-local folder, so a missing setting is an error there."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="haulspark-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.replace("file:", ""), f"{name}-{uuid.uuid4().hex[:12]}")
