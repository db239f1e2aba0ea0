"""Ingest as a stream: new book files are checked, mended and catalogued, or quarantined with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quire.sources.archives import integrity, kept, packages, titles, zip_entries
from quire.sources.keyed_table import KeyedTable
from quire.sources.repair import repaired

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """The *.epub files under root as a stream; each comes once."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.epub").option("recursiveFileLookup", True)
    return files.option("maxFilesPerTrigger", files_per_batch).load(root)


def own_session(spark: SparkSession) -> SparkSession:
    """A session for a stream of small batches, with spark's settings but for these.

    A batch is small, so what counts is how many tasks, jobs and broadcasts it makes, and how long plans take to be
    made. Rows that lie together by path aren't dealt anew by path and name, a checkpoint keeps how its rows are dealt
    (that of an adaptive plan doesn't), files are listed and read by as many tasks as there are cores, unless they are
    large, and no code is made for whole stages.
    """
    own, cores = spark.newSession(), str(spark.sparkContext.defaultParallelism)
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    settings = {
        "autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.enabled": "false", "requireAllClusterKeysForCoPartition": "false", "codegen.wholeStage": "false",
        "shuffle.partitions": cores, "sources.parallelPartitionDiscovery.parallelism": cores, "files.openCostInBytes": "65536",
    }
    for key, value in settings.items():
        own.conf.set(f"spark.sql.{key}", value)
    return own


def judged(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, quarantine) of files (path, content): title, author and series of those that are sound, if need be after mending, and of the rest why not.

    Entries are dealt out by book once; in own_session() no step after that deals them again.
    """
    by_book = lambda entries: kept(entries.sortWithinPartitions("path", "name"))
    entries = by_book(zip_entries(files).repartition(files.sparkSession.sparkContext.defaultParallelism, "path"))
    mended = by_book(repaired(entries, kept(packages(entries))))
    packed = kept(packages(mended))
    told = kept(titles(mended, packed).join(integrity(mended, packed), "path"))
    return told.where("status = 'ok'").drop("status"), told.where("status <> 'ok'").select("path", F.concat(F.lit("Error in integrity: "), "path", F.lit(": "), "status").alias("reason"))


def ingest(spark: SparkSession, root: str, catalogue: KeyedTable, quarantine: KeyedTable, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Takes in all files that are there now, batch by batch, and ends.

    A batch is written to both tables under its number, and a table passes over a number that it has. So a run that was
    stopped anywhere, also between the tables, is started again with the same checkpoint: no book is lost or comes twice.
    """

    def take(files: DataFrame, number: int) -> None:
        good, bad = judged(files.select("path", "content"))
        for table, rows in ((catalogue, good), (quarantine, bad)):
            KeyedTable(files.sparkSession, table.root, table.keys, table.n).upsert(rows, source="ingest", number=number)

    writer = arriving(own_session(spark), root, files_per_batch).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
