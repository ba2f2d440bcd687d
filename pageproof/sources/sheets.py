"""Sheets as cell tables: CSV files, decoded workbook cells, merged ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageproof.functions import text as t
from pageproof.operators.ordered import ordered_scan
from pageproof.session import materialized

# A record ends at a line break outside quotes.
# Possessive loops keep long cells off the matcher's stack.
_RECORD = r'[^"\r\n]*+(?:"[^"]*+"[^"\r\n]*+)*+'


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """sheet_cells from CSV files: byte-order mark dropped, ragged rows kept,
    empty lines skipped, cells trimmed. One file is one row while its records
    are cut, so record order needs no shuffle; files spread over tasks."""
    files = spark.read.text(path, wholetext=True)
    body = F.regexp_replace("value", r"^\uFEFF", "")
    rows = files.select(F.input_file_name().alias("sheet_id"), F.posexplode(_records(body)).alias("row_no", "record"))
    return _cells(rows.withColumn("row_no", (F.col("row_no") + 1).cast("bigint")))


def _records(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)), lambda r: F.trim(r) != "")


def _cells(rows: DataFrame) -> DataFrame:
    """Cells of records (sheet_id, row_no, record)."""
    quoted = lambda f: f.rlike(r'^,?\s*"')
    unquote = lambda f: F.replace(F.regexp_replace(f, r'^,?\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))
    # A leading comma marks every field alike, the first included.
    fields = F.regexp_extract_all(
        F.concat(F.lit(","), "record"), F.lit(r',\s*(?:"[^"]*+(?:""[^"]*+)*+"\s*(?=,|$)|[^,]*)'), F.lit(0)
    )
    cells = rows.select("sheet_id", "row_no", F.posexplode(fields).alias("col_no", "raw"))
    value = F.when(quoted(F.col("raw")), unquote(F.col("raw"))).otherwise(F.substring("raw", 2, 1_000_000_000))
    return cells.select(
        "sheet_id", "row_no", "col_no", F.trim(value).alias("value"), F.lit(None).cast("string").alias("hyperlink")
    )


def read_split_csv_cells(spark: SparkSession, path: str, segment_bytes: int = 1 << 20) -> DataFrame:
    """The cells of ``read_csv_cells`` from CSV files of any size, each read in many
    splits. A line begins a record if the quotes before it in its file are even:
    every segment of a file counts its own, and a running sum over segments, which
    are few, tells what each starts with. Record numbers come from running sums
    alike, so no task ever holds more of a file than a segment or a record. A last
    quote that is never closed counts as text, else the rest of the file would be
    one record. Lines are stored once, as three passes read them."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("sheet_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    lines = materialized(lines)
    first = lines.groupBy("sheet_id", "block").agg(F.min("id").alias("first_id"))
    # A line has a byte at least, so its number in the split keeps the order of places.
    at = F.col("block") + F.col("id") - F.col("first_id")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.join(first, ["sheet_id", "block"]).select("sheet_id", at.alias("at"), quotes.alias("q"), "value")
    marks = lines.select("sheet_id", "at", "q")
    held = F.max(F.when(F.col("q") > 0, F.col("at")))
    odd = marks.groupBy("sheet_id").agg((F.sum("q") % 2).alias("odd"), held.alias("held")).where("odd = 1")
    open_quote = F.when(F.col("at") == F.col("held"), 1).otherwise(0)
    marks = marks.join(odd, "sheet_id", "left").select("sheet_id", "at", (F.col("q") - open_quote).alias("q"))
    counted = ordered_scan(marks, ["sheet_id"], "at", sums={"upto": F.col("q")}, segment_rows=segment_bytes)
    starts = ((F.col("upto") - F.col("q")) % 2 == 0).cast("bigint")
    counted = materialized(counted.select("sheet_id", "at", starts.alias("starts")))
    numbered = ordered_scan(counted, ["sheet_id"], "at", sums={"part": F.col("starts")}, segment_rows=segment_bytes)
    parts = lines.join(numbered.select("sheet_id", "at", "part"), ["sheet_id", "at"]).groupBy("sheet_id", "part")
    parts = parts.agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "value"))).alias("own"))
    text = F.array_join(F.transform("own", lambda o: o["value"]), "\n")
    text = F.when(F.col("at") == 0, F.regexp_replace(text, r"^\uFEFF", "")).otherwise(text)
    cut = materialized(parts.select("sheet_id", "at", _records(text).alias("records")))
    rows = ordered_scan(cut, ["sheet_id"], "at", sums={"upto": F.size("records").cast("bigint")}, segment_rows=segment_bytes)
    rows = rows.select("sheet_id", "upto", F.size("records").alias("n"), F.posexplode("records").alias("i", "record"))
    return _cells(rows.select("sheet_id", (F.col("upto") - F.col("n") + F.col("i") + 1).alias("row_no"), "record"))


def csv_hyperlinks(cells: DataFrame) -> DataFrame:
    """CSV cells have no links: an absolute URL as text acts as one."""
    return cells.withColumn("hyperlink", F.when(t.is_url("value"), F.col("value")))


def expand_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Give every cell of a merged range its anchor's value and link.

    ``merges(sheet_id, top, left, bottom, right)``. Ranges become cell keys
    first, so both joins are equi-joins and no range is compared with rows.
    """
    covered = (
        merges.withColumn("row_no", F.explode(F.sequence("top", "bottom")))
        .withColumn("col_no", F.explode(F.sequence("left", "right")))
        .select("sheet_id", "row_no", F.col("col_no").cast("int").alias("col_no"), "top", "left")
    )
    anchors = cells.select(
        "sheet_id",
        F.col("row_no").alias("top"),
        F.col("col_no").alias("left"),
        F.col("value").alias("_v"),
        F.col("hyperlink").alias("_h"),
    )
    filled = covered.join(anchors, ["sheet_id", "top", "left"], "left").select("sheet_id", "row_no", "col_no", "_v", "_h")
    both = cells.join(filled.withColumn("_m", F.lit(True)), ["sheet_id", "row_no", "col_no"], "full_outer")
    pick = lambda merged, own: F.when(F.col("_m"), F.col(merged)).otherwise(F.col(own))
    return both.select(
        "sheet_id",
        "row_no",
        "col_no",
        F.coalesce(pick("_v", "value"), F.lit("")).alias("value"),
        pick("_h", "hyperlink").alias("hyperlink"),
    )


def source_format(path) -> F.Column:
    """csv / xlsx by extension; NULL is an unsupported file."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    return F.when(ext == ".csv", "csv").when(ext == ".xlsx", "xlsx")


def unsupported_files(paths: DataFrame, column: str = "path") -> DataFrame:
    """Reject rows for files no reader handles."""
    ext = F.lower(F.regexp_extract(column, r"(\.[^./\\]*)$", 1))
    return paths.where(source_format(column).isNull()).select(
        F.col(column).alias("path"),
        F.concat(
            F.lit("Unsupported audit sheet format: "), F.when(ext == "", F.lit("unknown")).otherwise(ext)
        ).alias("reason"),
    )
