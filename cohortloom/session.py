"""Session helpers: settings, the shared work folder, lineage cuts and size-checked small sides."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.errors import StageError

# Rows a table may have before it stops counting as a small side of a join.
SMALL_SIDE_ROWS = 20_000

# Record batches in, record batches out.
ArrowStep = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_own_folder: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_steps: WeakKeyDictionary[DataFrame, tuple[DataFrame, list[ArrowStep]]] = WeakKeyDictionary()


def local_session(app: str = "cohortloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without it; it then gets a scratch folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise StageError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="cohortloom-")
    return _own_folder[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the work folder that nothing has written to yet."""
    return f"{work_folder(spark)}/cohortloom/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result must be the same for two readers (range bounds are sampled anew on every
    run) or is too dear to compute twice. The files outlive any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut_lineage`` wrote.

    Only once all that reads them is written itself, since a lost executor makes Spark read them again.
    Other DataFrames, and tables that are gone already, stay as they are.
    """
    for table in tables:
        path = _written.pop(table, None)
        if path is not None:
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def made_by(df: DataFrame, source: DataFrame, step: ArrowStep) -> DataFrame:
    """Note that ``step`` over ``source`` gives the rows and columns of ``df``, for ``map_arrow`` to go on from."""
    _steps[df] = source, [step]
    return df


def has_step(df: DataFrame) -> bool:
    """Whether ``map_arrow`` would go on from the steps behind ``df``."""
    return df in _steps


def map_arrow(df: DataFrame, step: ArrowStep, schema: str) -> DataFrame:
    """``mapInArrow`` that runs right behind the steps of ``df``, in the same Python worker.

    What one step hands to the next then neither moves through Spark nor needs a worker for each step.
    """
    source, before = _steps.get(df, (df, []))
    steps = [*before, step]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for each in steps:
            batches = each(batches)
        yield from batches

    mapped = source.mapInArrow(run, schema)
    _steps[mapped] = source, steps
    return mapped


def small_side(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Turn a table into a broadcastable local one if it really is small.

    At most ``max_rows + 1`` rows are fetched. A larger table comes back unchanged, so that the
    join falls back to whatever Spark picks for two large inputs.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a table that arrives in fewer partitions than there are cores.

    For plain scans. A table of one Parquet row group is one task however dear the work on each row
    is. Inputs that already fill the cores pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
