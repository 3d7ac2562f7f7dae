"""Shared storage of intermediate results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, which only a local master may, a new one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master: {master})")
    import tempfile

    return tempfile.mkdtemp(prefix="tidemark-checkpoint-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder that the cluster names; set one only where none is set."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there whole."""
    files, at = _path(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _path(spark, path)
    files.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that its lineage ends there.

    What the plan has shuffled is removed at once, not when the driver happens to collect its garbage; should ``df``
    itself be run again, Spark shuffles again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    made = df.checkpoint(eager=True)
    plan, components = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        for shuffle in list(plan.context().shuffleIds().keySet()):
            components.removeShuffle(shuffle, False)
    return made


def dropped(made: DataFrame) -> None:
    """Remove what ``cut`` has written for ``made``, which nothing reads any more."""
    at = made._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        remove(made.sparkSession, at.get())


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever their working folder.

    It serves workers that see the driver's files; elsewhere install the package or give it in --py-files.
    """
    import os

    import tidemark

    root = os.path.dirname(os.path.dirname(os.path.abspath(tidemark.__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
