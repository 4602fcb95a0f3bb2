"""Delimited numbers in text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import NDFrame
from ..storage import numbered


def loadtxt(spark: SparkSession, path: str, delimiter: str | None = None, comments: str = "#", usecols: list[int] | None = None, missing: tuple[str, ...] | None = None, filling: float = float("nan")) -> NDFrame:
    """A matrix of the numbers of a text file; comments and blank lines don't count.

    With ``missing``, those fields and empty ones become ``filling``, as
    genfromtxt has it; otherwise a field that is no number is an error.  The
    rows keep the order of the file's lines (of several files, by their paths).
    """
    lines = spark.read.text(path).select(F.trim(F.substring_index("value", comments, 1)).alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    rows = numbered(lines.filter("line != ''"), ["f", "b", "k"], "i0")
    fields = F.split("line", r"\s+" if delimiter is None else rf"\s*\Q{delimiter}\E\s*")
    first = rows.filter("i0 = 0").select(F.size(fields).alias("n")).first()
    if first is None:
        return NDFrame(rows.select("i0", F.lit(0).cast("long").alias("i1"), F.lit(0.0).alias("v")), [0, 0])
    n = first["n"]
    columns = list(range(n)) if usecols is None else usecols
    kept = F.array(*(F.element_at(fields, c + 1 if c >= 0 else c) for c in columns))
    cells = rows.select("i0", F.size(fields).alias("n"), F.posexplode(kept).alias("i1", "field"))
    number = F.col("field").try_cast("double")
    if missing is not None:
        number = F.when(F.col("field").isin("", *missing), F.lit(filling)).otherwise(F.coalesce(number, F.lit(filling)))
    wrong = F.col("n") != n
    value = F.when(wrong, F.raise_error(F.lit("lines have different numbers of fields")).cast("double")).otherwise(F.coalesce(number, F.raise_error(F.concat(F.lit("not a number: "), "field")).cast("double")))
    return NDFrame(cells.select("i0", F.col("i1").cast("long").alias("i1"), value.alias("v")), [rows.count(), len(columns)])


def genfromtxt(
    spark: SparkSession, path: str, delimiter: str | list[int] | None = None, comments: str = "#", skip_header: int = 0, skip_footer: int = 0, usecols: list[int] | None = None, missing_values: tuple[str, ...] = (), filling_values: float | dict[int, float] = float("nan"), invalid_raise: bool = True
) -> NDFrame:
    """A matrix of the fields of text lines; what is empty, in ``missing_values`` or no number becomes a filling value.

    ``delimiter`` is a string, white space (None), or a list of field widths.
    Lines of another number of fields than the first fail the job, or are left
    out without ``invalid_raise``.  Header and footer lines are skipped before
    comments and blank lines are.  Filling values may differ by column.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    every = numbered(text, ["f", "b", "k"], "line")
    last = every.count() - skip_footer
    body = every.filter((F.col("line") >= skip_header) & (F.col("line") < last)).select("line", F.substring_index("value", comments, 1).alias("text")).filter(F.trim("text") != "")
    if isinstance(delimiter, list):
        starts = [sum(delimiter[:k]) for k in range(len(delimiter))]
        fields = F.filter(F.array(*(F.when(F.length("text") > a, F.trim(F.substring("text", a + 1, n))) for a, n in zip(starts, delimiter))), lambda x: x.isNotNull())
    elif delimiter is None:
        fields = F.split(F.trim("text"), r"\s+")
    else:
        fields = F.transform(F.split("text", rf"\Q{delimiter}\E"), lambda x: F.trim(x))
    split = body.select("line", fields.alias("fields"))
    first = split.orderBy("line").select(F.size("fields").alias("n")).first()
    n = first["n"] if first else 0
    if invalid_raise:
        split = split.withColumn("fields", F.when(F.size("fields") == n, F.col("fields")).otherwise(F.raise_error(F.lit("lines have different numbers of fields")).cast("array<string>")))
    rows = numbered(split.filter(F.size("fields") == n), ["line"], "i0")
    columns = list(range(n)) if usecols is None else [c % n for c in usecols]
    filling = filling_values if isinstance(filling_values, dict) else dict.fromkeys(range(n), filling_values)

    def value(c: int) -> Column:
        field, other = F.get("fields", F.lit(c)), F.lit(float(filling.get(c, float("nan"))))
        return F.when(field.isin("", *missing_values), other).otherwise(F.coalesce(field.try_cast("double"), other))

    cells = rows.select("i0", F.posexplode(F.array(*map(value, columns)) if columns else F.array().cast("array<double>")).alias("i1", "v"))
    return NDFrame(cells.select("i0", F.col("i1").cast("long").alias("i1"), "v"), [rows.count(), len(columns)])


def lines(x: NDFrame, fmt: str = "%.18e", delimiter: str = " ") -> DataFrame:
    """i0 and the line of each row of a vector or matrix."""
    wide = x if x.ndim == 2 else x.expand_dims(1)
    cells: Column = F.array_sort(F.collect_list(F.struct("i1", F.format_string(fmt, F.col("v").cast("double")).alias("s"))))
    return wide.df.groupBy("i0").agg(F.array_join(F.transform(cells, lambda c: c["s"]), delimiter).alias("line"))


def savetxt(x: NDFrame, path: str, fmt: str = "%.18e", delimiter: str = " ", header: str = "", comments: str = "# ") -> None:
    """Text files in the order of rows, one part a range of rows; a header is a first part of its own."""
    rows = lines(x, fmt, delimiter)
    if header:
        rows = rows.union(x.spark.createDataFrame([(-1, comments + header.replace("\n", "\n" + comments))], "i0 long, line string"))
    rows.repartitionByRange("i0").sortWithinPartitions("i0").select("line").write.text(path)


def fromstring(c: Column, separator: str = " ") -> Column:
    """An array of the numbers in a string column."""
    return F.transform(F.split(F.trim(c), rf"\s*\Q{separator.strip()}\E\s*" if separator.strip() else r"\s+"), lambda x: x.try_cast("double"))
