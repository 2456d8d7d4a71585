"""File sources and sinks: measurement scans, partitioned monthly maps, statistics reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.sources.tables import settled


def scan_points(spark: SparkSession, glob: str, schema: str, year: int | None = None, ts: str = "ts", point: str = "Samplingpoint") -> DataFrame:
    """Parquet files of one sampling point each; ``site`` is the second part of the point's path."""
    df = spark.read.schema(schema).parquet(glob).withColumn("site", F.element_at(F.split(point, "/"), 2))
    return df if year is None else df.where(F.col(ts).between(F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year}-12-31 23:59:59.999999").cast("timestamp")))


#: Line ends of encodings whose characters have more than one byte each.
WIDE = {"UTF-16LE": "\n\0", "UTF-16BE": "\0\n", "UTF-32LE": "\n\0\0\0", "UTF-32BE": "\0\0\0\n"}
#: Most blocks of files whose places are broadcast (some 200 bytes each); more are joined by a shuffle.
BLOCKS = 100_000
_PLACE = ["_file", "_block"]


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(_file, _block: where its split begins, _id: rising in a split, line): a text scan that splits large files."""
    wide = WIDE.get(encoding.upper())
    raw = (spark.read.option("lineSep", wide) if wide else spark.read).text(path)
    line = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    return raw.select(*at, F.monotonically_increasing_id().alias("_id"), F.regexp_replace(line, "^\ufeff|\r$", "").alias("line"))


def _before(blocks: DataFrame, *sums: str) -> DataFrame:
    """Sums over the earlier blocks of each file under the same names: one row per block, whatever the files hold."""
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums})


def _placed(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    return lines.join(F.broadcast(blocks) if blocks.limit(BLOCKS + 1).count() <= BLOCKS else blocks, _PLACE)


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(_file, _block, _id, line, _at): lines of all files with their number in their file, from 0.

    A scan knows where a split begins and in which order it gives its lines, but not how many lines stand before it. So the
    lines of every split are counted first, and the counts of a file's earlier splits are added: no file is read whole by
    one task, and no line is moved.
    """
    lines = _lines(spark, path, encoding)
    counted = lines.groupBy(*_PLACE).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    return _placed(lines, settled(_before(counted, "_n"), "line-counts")).withColumn("_at", F.col("_n") + F.col("_id") - F.col("_first")).drop("_n", "_first")


def whole_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(_file, _at, line): lines joined to the one before wherever a quoted field holds a line break.

    A line goes on the record before it if an odd number of quotes stands before it in its file; the quotes of earlier
    splits come from their sums. Only lines of records with breaks are gathered. A quote that is never closed takes the rest
    of its file.
    """
    lines = lines.withColumn("_q", F.length("line") - F.length(F.replace("line", F.lit(quote))))
    quotes = settled(_before(lines.groupBy(*_PLACE).agg(F.sum("_q").alias("_odd")), "_odd"), "line-quotes")
    w = Window.partitionBy(*_PLACE).orderBy("_at")
    run = F.coalesce(F.sum("_q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = _placed(lines, quotes).withColumn("_inside", (F.col("_odd") + run) % 2 == 1).withColumn("_goes_on", (F.col("_inside").cast("int") + F.col("_q")) % 2 == 1)
    marked = settled(marked.drop("_odd", "_q"), "line-records")
    starts = marked.groupBy(*_PLACE).agg(F.sum((~F.col("_inside")).cast("long")).alias("_record"))
    parts = marked.where("_inside or _goes_on")
    numbered = _placed(marked.withColumn("_k", F.sum((~F.col("_inside")).cast("long")).over(w)), settled(_before(starts, "_record"), "line-starts"))
    numbered = numbered.where("_inside or _goes_on").withColumn("_record", F.col("_record") + F.col("_k"))
    joined = numbered.groupBy("_file", "_record").agg(F.sort_array(F.collect_list(F.struct("_at", "line"))).alias("_l"))
    joined = joined.select("_file", F.get("_l", F.lit(0))["_at"].alias("_at"), F.array_join("_l.line", "\n").alias("line"))
    whole = marked.where("not _inside and not _goes_on").select("_file", "_at", "line")
    return whole.unionByName(joined) if parts.take(1) else whole


def scan_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8", preamble: int = 0, breaks: bool = False) -> DataFrame:
    """CSV with an own separator, encoding and preamble. Lines that do not fit the schema are left out; so are the
    ``preamble`` lines and the header after them, which are known by their number in the file. ``breaks``: quoted fields may
    hold line breaks."""
    names = T.StructType.fromDDL(schema)
    if not preamble and not breaks and encoding.upper() not in WIDE:
        return spark.read.csv(path, schema=names, sep=sep, encoding=encoding, header=True, mode="DROPMALFORMED")
    lines = numbered_lines(spark, path, encoding).where(F.col("_at") > preamble)
    lines = (whole_records(lines) if breaks else lines).where(F.trim("line") != "")
    parsed = lines.select(F.from_csv("line", f"{schema}, _bad string", {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r._bad is null").select(*[F.col("r")[n].alias(n) for n in names.fieldNames()])


def scan_csv_any(spark: SparkSession, path: str, schema: str, encodings: list[str], sep: str = ",") -> DataFrame:
    """CSV in the first of the encodings that decodes every text without a replacement character; lines that do not fit
    the schema are left out. Only a yes or no per encoding reaches the driver."""
    for encoding in encodings:
        df = scan_csv(spark, path, schema, sep, encoding)
        text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        broken = F.lit(False)
        for c in text:
            broken = broken | F.coalesce(F.contains(F.col(c), F.lit("\ufffd")), F.lit(False))
        if encoding == encodings[-1] or not df.where(broken).limit(1).count():
            return df
    raise ValueError("no encoding")


def write_monthly(df: DataFrame, path: str, slim: list[str] | None = None, about: dict[str, dict] | None = None) -> None:
    """Maps partitioned by year and month; only the months in ``df`` are overwritten. ``about``: metadata by column."""
    keep = df if slim is None else df.select(*dict.fromkeys([*slim, "year", "mon"]))
    for c, meta in (about or {}).items():
        keep = keep.withMetadata(c, meta) if c in keep.columns else keep
    keep.repartition("year", "mon", "ilat").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "mon").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Statistics rows (area, period, metric, value) as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)
