"""What the operators need of a Spark session."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: How many bytes of rows go to a Python worker at once; 10,000 rows of long texts, the usual batch, have no bound.
BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() work: in the folder that the cluster names in spark.checkpoint.dir.

    Where it names none, a session on one machine gets a folder of its own, removed as it ends; on a cluster that is an error, as executors would not
    see each other's files. Batches for Python workers are bounded too, unless the session says otherwise.
    """
    context = spark.sparkContext
    if spark.conf.get(BYTES, "1b") == "1b":  # not set
        spark.conf.set(BYTES, str(BATCH))
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import atexit
        import shutil
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, named, True)
    context.setCheckpointDir(named)
