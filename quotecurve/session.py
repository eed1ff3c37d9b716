"""Session settings for tests and the bench, and lineage cuts for iterative jobs."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Without it, the shuffle files of a finished job stay until the driver collects its frames.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Tables written inside the `steps` that are open, one list for each.
_open_steps: ContextVar[tuple[list[str], ...]] = ContextVar("open_steps", default=())


def build_session(app: str = "quotecurve", cores: str | int = "*", **conf) -> SparkSession:
    """Local session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only for local masters."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="quotecurve-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and continue from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, path: str) -> None:
    """Write the frame as Parquet; the shuffle files of this one job are deleted with it."""
    conf = df.sparkSession.conf
    before = conf.get(_DROP_SHUFFLES, None)
    conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(_DROP_SHUFFLES)
        else:
            conf.set(_DROP_SHUFFLES, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as a table under the checkpoint folder and read it back.

    For a frame that several later steps read: it is computed once, survives lost
    executors, and keeps column pruning and filter pushdown.
    """
    return _kept(df, name, _open_steps.get())


def _kept(df: DataFrame, name: str, steps: tuple[list[str], ...]) -> DataFrame:
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    if steps:
        steps[-1].append(path)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are materialised inside the block are deleted at its end.

    The block gets a function that materialises its result, which stays (until the end of the next
    block outside, if there is one). So the disk holds one step's input, shuffles and output at a time.
    """
    outer, spent = _open_steps.get(), []
    token = _open_steps.set((*outer, spent))
    try:
        yield lambda df, name: _kept(df, name, outer)
    finally:
        _open_steps.reset(token)
        for path in spent:
            discard(spark, path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
