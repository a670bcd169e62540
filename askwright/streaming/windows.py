"""Sources that are polled, windows in event time, and answers that age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEXED = ["pdf", "docx", "pptx", "xlsx", "html", "htm", "txt", "md"]


def polled(spark: SparkSession, folder: str, schema: str, groups: list[str], most_files: int = 1) -> DataFrame:
    """Tickets as files arrive: active ones of the groups."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).json(folder).where(F.col("active") & F.col("assignment_group").isin(groups))


def poll_into(stream: DataFrame, put, checkpoint: str, once: bool = True):
    """Run put(rows, batch id) for each arrival; one query is the one writer.  once: what is there now, then stop."""
    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def pulled(spark: SparkSession, folder: str, include: list[str] = INDEXED, exclude: list[str] = ()) -> DataFrame:
    """Files of an indexer's pull, by their extensions; run it with availableNow."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(kinds).option("recursiveFileLookup", True).load(folder)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return rows.select("path", "length", extension.alias("extension")).where(extension.isin(include) & ~extension.isin([*exclude, ""]))


def accepted_call(sent: Column, received: Column, seconds: int = 300) -> Column:
    """A signed call counts within five minutes on either side of its time stamp."""
    return F.abs(F.unix_timestamp(received) - F.unix_timestamp(sent)) <= seconds


def session_id(ticket: Column) -> Column:
    """The same ticket leads to the same session."""
    return F.concat(F.lit("sn-"), F.lower(F.trim(ticket)))


def sliding_counts(events: DataFrame, time: str, key: str, late: str = "1 hour", width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """Events of each key in sliding windows; in a stream, later ones than `late` are dropped by the watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width, step), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def session_windows(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with less than `gap` between them."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def cached_answers(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """requests: key, ts.  Whether a request is answered from the cache: the last fresh answer is younger than the time to live.

    A hit does not renew an answer, so a key's requests are folded in order: aggregate over its own sorted times."""
    second = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("bigint")  # the nearest one
    times = requests.groupBy("key").agg(F.sort_array(F.collect_list(second)).alias("at"))
    start = F.struct(F.lit(None).cast("bigint").alias("made"), F.lit(0).cast("bigint").alias("hits"))
    fold = F.aggregate(
        "at", start,
        lambda acc, t: F.when(acc["made"].isNotNull() & (t - acc["made"] < ttl_seconds), F.struct(acc["made"].alias("made"), (acc["hits"] + 1).alias("hits"))).otherwise(F.struct(t.alias("made"), acc["hits"].alias("hits"))),
    )
    return times.select("key", F.size("at").cast("long").alias("requests"), fold["hits"].alias("hits"))


def bounded_memory(turns: DataFrame, key: str, order: str, text: str, messages: int = 14, chars: int = 4000) -> DataFrame:
    """What a session remembers: its last messages, and the end of all its text."""
    last = turns.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(text))))
    kept = last.where(F.col("__k") <= messages).groupBy(key).agg(F.count("*").alias("messages"))
    said = turns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("t"))
    return kept.join(said.select(key, F.expr(f"right(t, {chars})").alias("memory")), key)
