"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, name: str = "docsluice", progress: bool = False
) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(STATE_STORE, ROCKSDB)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", str(progress).lower())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``; where it is unset, a local session gets a temporary
    folder and a cluster a folder beside its tables."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and context.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="docsluice-checkpoint-")
    context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder for written tables, where driver and executors both reach it."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_to_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder, read again by column: for rows that are dear to make and used more than once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give work that is heavy per row enough partitions when its table came in fewer files than there are cores.

    For columns of a table as scanned: the files are known from its plan, so nothing runs.  Tables of many files are
    left alone.
    """
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan if len(scan.inputFiles()) >= wanted else scan.repartition(wanted)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB, which typed state and timers need; the session's own setting
    comes back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)
