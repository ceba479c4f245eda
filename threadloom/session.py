"""Sessions, the shared scratch folder, and written intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import weakref

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_roots: dict[str, str] = {}
_written: dict[int, tuple[weakref.ref, str]] = {}


def local_session(cpus: int | str = "*", app: str = "threadloom", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    go without, and then gets one temporary folder for its whole life.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="threadloom-")
    return _local_roots[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so never overwritten.

    Paths of one application share a folder, which may go when it has ended.
    """
    root = shared_root(spark).rstrip("/")
    return f"{root}/threadloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage so that a lost executor costs one re-read, and gives the
    planner the true size, so that a join is broadcast only when it is small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _written[id(written)] = (weakref.ref(written), path)
    return written


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, order: tuple[str, ...] = ()) -> None:
    """Write ``df`` dealt by the hash of ``key``, one sorted file a bucket; nothing is moved that is dealt so already."""
    spark, name = df.sparkSession, _table_name()
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order)
    try:
        writer.option("path", path).format("parquet").saveAsTable(name)
    finally:
        spark.sql(f"drop table if exists {name}")


def read_buckets(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """The table of :func:`write_buckets`; the planner knows how it is dealt."""
    name, quoted = _table_name(), path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"create table {name} ({schema.toDDL()}) using parquet"
        f" clustered by (`{key}`) into {buckets} buckets location '{quoted}'"
    )
    try:
        return spark.table(name)
    finally:  # the files stay, and the rows read know them
        spark.sql(f"drop table if exists {name}")


def _table_name() -> str:
    return f"threadloom_{uuid.uuid4().hex}"


def materialise_buckets(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """:func:`materialise`, dealt by ``key``, so that grouping and joining on it moves no rows."""
    path = scratch_path(df.sparkSession, label)
    write_buckets(df, path, key, buckets)
    return read_buckets(df.sparkSession, path, df.schema, key, buckets)


def discard(written: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing reads any more; others are left alone."""
    reference, path = _written.pop(id(written), (None, None))
    if reference is None or reference() is not written:
        return
    sc = written.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def rename_new(spark: SparkSession, staged: str, path: str) -> bool:
    """Make a written folder visible under a new name at once; false if that name is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(conf)
    system.mkdirs(target.getParent())
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(source).toUri(), conf)
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(source, target, never)
    except Py4JJavaError as error:
        if system.exists(target):
            return False
        raise error
    return True


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def artefact_path(spark: SparkSession, label: str, inputs: list[DataFrame], *settings: object) -> str:
    """Where one application keeps what is derived from the files of ``inputs`` under ``settings``.

    Another path as soon as a file's name, length or time of writing differs. The application is part of
    it, so that nothing made by other code is taken up; models to be kept are saved under a name of choice.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    digest = hashlib.sha256(repr(settings).encode())
    for name in sorted(name for rows in inputs for name in rows.inputFiles()):
        file = jvm.org.apache.hadoop.fs.Path(name)
        status = file.getFileSystem(conf).getFileStatus(file)
        digest.update(f"{name}:{status.getLen()}:{status.getModificationTime()}\n".encode())
    own = f"{shared_root(spark).rstrip('/')}/threadloom/{spark.sparkContext.applicationId}"
    return f"{own}/artefacts/{label}-{digest.hexdigest()[:32]}"


def materialise_counting(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict]:
    """:func:`materialise`, with aggregates over the written rows."""
    written = materialise(df, label)
    measures = [value.alias(name) for name, value in counts.items()]
    return written, written.agg(*measures).first().asDict()
