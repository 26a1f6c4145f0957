"""CSV and Parquet in and out."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemill.functions.columns import name
from tidemill.session import checkpointed

# Cell texts that mean "missing".
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


#: Splits of a file whose quote counts are sent to every task.
FEW_SPLITS = 100_000


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """A CSV with a header line. Give ``schema`` to skip type inference.

    Cells may hold line breaks, and large files are still read in splits. ``multi_line=True`` reads each file in one task
    instead, ``False`` says that no cell holds a line break.
    """
    if isinstance(path, str) and not path.rstrip("/*").endswith(".csv") and "." in path.rsplit("/", 1)[-1]:
        raise ValueError("only .csv files are read")
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", bool(multi_line))
    reader = reader.schema(schema) if schema is not None else reader
    if multi_line is None:
        lines = _csv_lines(spark, path)
        splits = checkpointed(lines.groupBy("file", "start").agg(F.sum("odd").alias("odd")))
        # Where all quotes of a line close in it, lines are records.
        if splits.where("odd > 0").limit(1).count():
            rows = _joined_records(spark, lines, splits, schema)
            return rows if schema is not None else infer_types(rows)
    return reader.csv(path) if schema is not None else infer_types(reader.csv(path))


def _csv_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Every line with its file, the start of its split, its order there, and whether its quotes are odd in number."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"')))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), (quotes % 2).alias("odd"))


def _joined_records(spark: SparkSession, lines: DataFrame, splits: DataFrame, schema: T.StructType | str | None) -> DataFrame:
    """Records from lines: the quotes of all splits before tell whether a split begins inside a cell.

    A doubled quote counts twice, so quotes are odd exactly where a cell is open. Splits are numbered through by their
    records, and only records of several lines are brought together.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = splits.select("file", "start", F.coalesce(F.sum("odd").over(before), F.lit(0)).alias("opened"))
    opened = F.broadcast(opened) if splits.count() <= FEW_SPLITS else opened
    here = Window.partitionBy("file", "start").orderBy("at")
    inside = (F.col("opened") + F.coalesce(F.sum("odd").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2
    placed = lines.join(opened, ["file", "start"]).withColumn("inside", inside)
    placed = placed.withColumn("record", F.sum(1 - F.col("inside")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    placed = checkpointed(placed.select("file", "start", "at", "value", "odd", "inside", "record"))
    firsts = placed.groupBy("file", "start").agg(F.sum(1 - F.col("inside")).alias("n"))
    firsts = checkpointed(firsts.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    numbered = placed.join(F.broadcast(firsts) if firsts.count() <= FEW_SPLITS else firsts, ["file", "start"])
    numbered = numbered.withColumn("record", F.col("record") + F.col("earlier"))
    single = (F.col("inside") == 0) & (F.col("odd") == 0)
    whole = numbered.where(~single).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("ls"))
    whole = whole.select("file", "record", F.array_join(F.transform("ls", lambda x: x["value"]), "\n").alias("value"))
    records = numbered.where(single).select("file", "record", "value").unionByName(whole)
    records = records.withColumn("value", F.regexp_replace("value", "\r$", ""))
    top = records.where("record = 1").orderBy("file").select("value").first()
    header = next(csv.reader([top[0]] if "\n" not in top[0] else io.StringIO(top[0], newline="")))
    if schema is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    kept = records.where((F.col("record") > 1) & (F.col("value") != ""))
    return kept.select(F.from_csv("value", schema.toDDL(), {"escape": '"'}).alias("r")).select("r.*")


def infer_types(df: DataFrame, missing: Sequence[str] = MISSING_TEXTS) -> DataFrame:
    """Turn text columns into bigint, double or boolean where every present value allows it.

    One aggregate over the whole table decides all columns.
    """
    cells = {c: F.when(~name(c).isin(*missing), name(c)) for c in df.columns}
    counted = df.agg(
        *[
            F.struct(
                F.count(x).alias("n"),
                F.count(_whole(x)).alias("whole"),
                F.count(x.try_cast("double")).alias("number"),
                F.count_if(F.lower(x).isin("true", "false")).alias("flag"),
            ).alias(f"c{i}")
            for i, x in enumerate(cells.values())
        ]
    ).first()
    out = []
    for (c, x), row in zip(cells.items(), counted):
        kind = "string"
        if row["n"] == 0:
            kind = "double"
        else:
            for label, hits in (("bigint", row["whole"]), ("double", row["number"]), ("boolean", row["flag"])):
                if hits == row["n"]:
                    kind = label
                    break
        out.append((x if kind == "string" else F.trim(x).try_cast(kind)).alias(c))
    return df.select(*out)


def _whole(x: Column) -> Column:
    return F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x).try_cast("bigint"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[name(c) for c in columns]) if columns else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The table as CSV parts with a header each, in one folder."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
