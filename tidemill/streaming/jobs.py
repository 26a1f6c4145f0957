"""Continuous forms of the log, scoring and transform operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions.columns import name
from tidemill.operators.features import Fitted, apply_all
from tidemill.operators.modeling import TrainedModel, score
from tidemill.operators.redact import sanitize_log


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; new files are new rows."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def with_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone; the session zone (UTC) is taken."""
    return df.withColumn(ts, name(ts).cast("timestamp"))


def sanitized(df: DataFrame, json_columns: Sequence[str] = (), limits: Mapping[str, int] | None = None, blank: Sequence[str] = ()) -> DataFrame:
    return sanitize_log(df, json_columns, limits, blank)


def start_ingest(
    df: DataFrame, path: str, checkpoint: str, interval: str | None = "5 seconds", partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Append a stream to Parquet exactly once; a failed batch is tried again after a restart.

    ``interval=None`` takes everything that is there and stops.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return writer.trigger(**trigger).start(path)


def hourly_stream(df: DataFrame, error: Column, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Rows and errors per hour (UTC), for update mode; rows later than ``delay`` behind the newest are left out."""
    windows = with_event_time(df, ts).withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"))
    counts = windows.agg(F.count("*").alias("total"), F.count_if(error).alias("errors"))
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("window.start").cast("timestamp_ntz"))
    return counts.select(F.date_format(start, "yyyy-MM-dd'T'HH").alias("hour"), "total", "errors")


def login_stream(df: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Last login and number of logins per user, for update mode."""
    return df.groupBy(name(user)).agg(F.max(ts).alias("last_login"), F.count("*").alias("login_count"))


def score_stream(df: DataFrame, trained: TrainedModel, keep: Sequence[str] | None = None) -> DataFrame:
    return score(trained, df, keep)


def transform_stream(df: DataFrame, steps: Sequence[Fitted]) -> DataFrame:
    """Replay fitted transforms; nothing is fitted on the stream."""
    return apply_all(df, steps)


def login_periods(df: DataFrame, user: str = "user_id", ts: str = "ts", period: str = "30 days", delay: str = "1 day") -> DataFrame:
    """Last login and number of logins per user and period (UTC), for update mode; ``login_totals`` adds periods up.

    The state of a user and period is dropped once the newest row is ``delay`` past the period's end, so state
    grows with the users of one period, not with all users ever seen. Rows later than that are left out.
    """
    periods = with_event_time(df, ts).withWatermark(ts, delay).groupBy(name(user), F.window(ts, period))
    return periods.agg(F.max(ts).alias("last_login"), F.count("*").alias("login_count")).select(
        name(user), F.col("window.start").alias("since"), "last_login", "login_count"
    )


def login_totals(periods: DataFrame, user: str = "user_id") -> DataFrame:
    """Last login and number of logins per user over all periods."""
    return periods.groupBy(name(user)).agg(F.max("last_login").alias("last_login"), F.sum("login_count").alias("login_count"))


def start_keyed(
    df: DataFrame, path: str, checkpoint: str, interval: str | None = "5 seconds", keys: Sequence[str] = (), every: int = 16
) -> StreamingQuery:
    """Write the changed rows of an aggregate, batch by batch; ``latest`` reads them as one table.

    A batch that is tried again replaces its own folder, so each change counts once. Nothing is kept
    on the driver. ``interval=None`` takes everything that is there and stops. With ``keys``, each
    ``every`` batches are merged with those before, so that a reader meets fewer than twice as many batches.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if keys and (batch + 1) % every == 0:
            merge_batches(rows.sparkSession, path, rows.schema, keys, batch)

    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(put).trigger(**trigger).start()


def _numbered(spark: SparkSession, folder: str, label: str, complete: bool = False) -> dict[int, str]:
    """The folders ``label=<number>`` of a folder by number; only those of finished writes if ``complete``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(where)]
    found = {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{label}=")}
    done = lambda place: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS"))
    return {k: v for k, v in found.items() if not complete or done(v)}


def _changes(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None, upto: int | None = None) -> DataFrame:
    """The newest merged table (below number ``before``) and the batches after it, with the number of each row's batch."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    merged = _numbered(spark, f"{path}/_merged", "upto", complete=True)
    base = max((n for n in merged if before is None or n < before), default=-1)
    single = [p for n, p in _numbered(spark, path, "batch").items() if n > base and (upto is None or n <= upto)]
    parts = [spark.read.schema(full).parquet(merged[base])] if base >= 0 else []
    if single:
        parts.append(spark.read.schema(full).option("basePath", path).parquet(*single))
    if not parts:
        return spark.createDataFrame([], full)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _newest(rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    rest = [c for c in columns if c not in keys]
    newest = F.max_by(F.struct(*[name(c) for c in rest]), "batch").alias("r")
    return rows.groupBy(*[name(k) for k in keys]).agg(newest).select(*[name(k) for k in keys], "r.*")


def merge_batches(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], upto: int) -> None:
    """Write one table of the newest rows of batches up to ``upto``, from the merged table before and the batches since.

    It counts from the moment it is complete, and trying again gives the same. Folders that already the merged table
    before had made superfluous are deleted then, so readers that began a merge ago still find theirs.
    """
    rows = _changes(spark, path, schema, before=upto, upto=upto)
    _newest(rows, [*schema.names, "batch"], keys).write.mode("overwrite").parquet(f"{path}/_merged/upto={upto}")
    merged = _numbered(spark, f"{path}/_merged", "upto", complete=True)
    previous = max((n for n in merged if n < upto), default=-1)
    old = [p for n, p in merged.items() if n < previous] + [p for n, p in _numbered(spark, path, "batch").items() if n <= previous]
    for place in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(place)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def latest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key that ``start_keyed`` has written; merged batches are read as one table."""
    return _newest(_changes(spark, path, schema), schema.names, keys).select(*[name(c) for c in schema.names])
