"""Tables that cut a lineage, in the folder that the cluster names in spark.checkpoint.dir.

A lost executor then costs a re-read and no recomputation. Only a local session, as in tests, may do
without that setting.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions that name none, removed when the driver ends.
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local sessions that name none."""
    named = dict(spark.sparkContext.getConf().getAll()).get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    try:
        named = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the key is unset: Spark raises for it
        named = None
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        own = tempfile.mkdtemp(prefix="kinloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _MADE[app] = "file://" + own
    return _MADE[app]


def python_ready(spark: SparkSession) -> None:
    """Give Python workers this package's folder, where the session's start didn't."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def trimmed(spark: SparkSession) -> bool:
    """Have the driver's JVM give free native memory back to the system; whether it can: Java 17.0.9 and later, on glibc.

    Plans and their compiled code take and free much of it in many threads' pools, which otherwise only grow.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        kind = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the server's own class isn't open to reflection
        invoke = next(m for m in kind.getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 1), array(jvm.java.lang.String, 1)
        args[2][0], args[3][0] = array(jvm.java.lang.String, 0), "[Ljava.lang.String;"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


class Workspace:
    """Tables of one operator's run in the shared folder; drop() frees those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write df and return the table read back; its path is in the attribute stored_at."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        trimmed(self.spark)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.stored_at = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that store() returned; others are passed over."""
        jvm = self.spark._jvm
        for table in tables:
            if path := getattr(table, "stored_at", None):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
