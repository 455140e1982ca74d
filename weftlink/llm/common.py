"""What the operators of this subpackage share: working storage, columns and chunks.

Every intermediate table goes to the folder that the cluster names in ``spark.checkpoint.dir``;
it is written and reread, so a lost executor costs only the tasks that it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these ASCII white-space bytes.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where it names none, as in tests, a local session gets one of its own;
    a cluster must name one, because its machines share no temporary folder."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="weftlink-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


class Workspace:
    """Parquet tables of one operator call below the shared folder.

    ``put`` writes a table and reads it back, which cuts its lineage. ``drop`` deletes one that
    no later plan reads, ``clear`` all but the named ones. What a returned DataFrame reads stays. As a context, a
    workspace whose body fails is cleared, its tables in the catalog too.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self.tables: dict[str, str] = {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.clear()

    def put(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        # rows may hold large binaries: small row groups bound what a writer and a reader's batch hold
        df.write.mode("overwrite").option("compression", codec).option("parquet.block.size", 8 << 20).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_bucketed(self, df: DataFrame, name: str, column: str, buckets: int, order: str, codec: str = "zstd") -> DataFrame:
        """As ``put``, bucketed by a column: grouping by it reads the files of a bucket together, without a shuffle. Files are
        sorted by ``order``. A table whose writing fails leaves nothing in the catalog."""
        table = f"weft_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        self.names.add(name)
        self.tables[name] = table
        try:
            df.write.format("parquet").option("path", path).option("compression", codec).bucketBy(buckets, column).sortBy(order).saveAsTable(table)
        except BaseException:
            self.drop(name)
            raise
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            self.names.discard(name)

    def clear(self, *keep: str) -> None:
        self.drop(*(self.names - set(keep)))


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Columns of ``df`` under new names: ``picked(docs, id="doc_id")``. They are taken by position, so dots, quotes and clashes in names don't matter."""
    named = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return named.select(*[named[f"c{df.columns.index(name)}"].alias(new) for new, name in columns.items()])


def carried(df: DataFrame, **columns: str) -> DataFrame:
    """All columns of ``df`` as one struct ``row``, and some under new names as in ``picked``; ``unpacked`` gives the columns back."""
    named = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    row = F.struct(F.lit(0).alias("none"), *[named[c] for c in named.columns])
    return named.select(row.alias("row"), *[named[f"c{df.columns.index(name)}"].alias(new) for new, name in columns.items()])


def unpacked(names: list[str]) -> list[Column]:
    """The columns of a ``row`` under their own names, which may be any."""
    return [F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(names)]


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unsigned_crc(column: Column) -> Column:
    return F.crc32(column).cast("long")
