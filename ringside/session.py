"""Session helpers: sensible defaults for local runs, and the shared checkpoint folder."""
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus="*", memory="8g", name="ringside") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cores = 8 if cpus == "*" else int(cpus)
    return (SparkSession.builder.master(f"local[{cpus}]").appName(name)
            .config("spark.driver.memory", memory)
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.bindAddress", "127.0.0.1")
            .config("spark.driver.host", "127.0.0.1")
            .getOrCreate())


def use_checkpoints(spark: SparkSession) -> None:
    """Point the session at the folder named in spark.checkpoint.dir; none at all is an error on any master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared checkpoint folder, deleted when the session's JVM ends."""
    use_checkpoints(spark)
    place = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and go on from there.

    A written table is computed once (an eager checkpoint computes it twice) and tells Spark its size, so that
    small sides are broadcast.
    """
    place = new_folder(df.sparkSession, "table")
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: its join is sorted on both sides, never broadcast.

    Spark takes a written table to be as large as its compressed file and an explode to add nothing, so a side of some
    hundred MB can pass for a small one; it would be gathered and hashed on the driver.
    """
    return df.hint("merge")
