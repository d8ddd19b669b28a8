"""An append-only audit log fed by a stream: every batch is in it once or not at all, and rows that cannot be taken are set aside.

A batch writes its rows into a folder named by its number, then a marker. Readers see
batches with a marker only; a batch that comes again after its marker adds nothing, one
that comes again before it replaces what the broken attempt left. So the log is right
whatever the point at which a run was lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "event_id long, event_type string, actor long, target long, success boolean, metadata string, ip string, agent string, ts timestamp_ntz"
FAULTS = f"{LOG}, fault string"
#: Longest agent that is kept.
AGENT = 255


def client_address(forwarded: str, remote: str) -> Column:
    """The first of the addresses that a request was forwarded for, else the address that it came from."""
    first = F.trim(F.split(F.col(forwarded), ",")[0])
    return F.coalesce(F.when(first != "", first), F.col(remote))


def fault() -> Column:
    """Why a row cannot be taken, null if it can: no type, no outcome, or metadata that are no object."""
    return (
        F.when(F.col("event_type").isNull() | (F.trim("event_type") == ""), "no event type")
        .when(F.col("success").isNull(), "no outcome")
        .when(F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull(), "metadata are not JSON")
        .when(F.col("metadata").isNotNull() & ~F.trim("metadata").startswith("{"), "metadata are no object")
    )


def prepared(rows: DataFrame, users: DataFrame) -> DataFrame:
    """``rows`` as they are kept: agents cut, actors and targets that ``users`` (user_id) lacks as null, empty metadata as {}."""
    known = users.select("user_id").distinct()
    for name in ("actor", "target"):
        found = known.select(F.col("user_id").alias("_user"), F.lit(True).alias("_known"))
        rows = rows.join(found, F.col(name) == F.col("_user"), "left").withColumn(name, F.when(F.col("_known"), F.col(name))).drop("_user", "_known")
    return rows.withColumns({"agent": F.substring("agent", 1, AGENT), "metadata": F.coalesce("metadata", F.lit("{}"))})


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the batches in the log."""
    files, place = _files(spark, f"{folder.rstrip('/')}/commits")
    return sorted(int(s.getPath().getName()) for s in files.listStatus(place)) if files.exists(place) else []


def write_batch(rows: DataFrame, batch: int, folder: str, users: DataFrame | None = None) -> bool:
    """Append one batch; False if it is in the log already."""
    spark = rows.sparkSession
    folder = folder.rstrip("/")
    files, marker = _files(spark, f"{folder}/commits/{batch}")
    if files.exists(marker):
        return False
    judged = rows.withColumn("fault", fault())
    good = judged.filter("fault is null").drop("fault")
    if users is not None:
        good = prepared(good, users)
    else:
        good = good.withColumns({"agent": F.substring("agent", 1, AGENT), "metadata": F.coalesce("metadata", F.lit("{}"))})
    names = [c.split()[0] for c in LOG.split(", ")]
    good.select(names).write.mode("overwrite").parquet(f"{folder}/log/batch={batch}")
    judged.filter("fault is not null").select(*names, "fault").write.mode("overwrite").parquet(f"{folder}/faults/batch={batch}")
    files.create(marker, True).close()
    return True


def read_log(spark: SparkSession, folder: str, faults: bool = False) -> DataFrame:
    """The rows of committed batches with their batch, or those set aside with their fault."""
    folder, schema = folder.rstrip("/"), FAULTS if faults else LOG
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{folder}/{'faults' if faults else 'log'}")
    done = committed(spark, folder)
    if not done:
        return spark.createDataFrame([], f"{schema}, batch long")
    # the markers are as many as batches; they prune the folders that are read
    return rows.parquet(f"{folder}/{'faults' if faults else 'log'}").filter(F.col("batch").isin(done))


def audit_sink(stream: DataFrame, folder: str, state: str, users: DataFrame | None = None) -> None:
    """Append a stream of :data:`LOG` rows to the log in ``folder``, all that is there now; ``state`` keeps how far it came."""
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, folder, users) and None)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
