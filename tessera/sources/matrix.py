"""Matrix and label readers, and tab-separated sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, fields): the whitespace-separated fields of each line that has some, and how many the file has before them.

    Files are split; a split's fields are counted first, so no task sees more
    than a split.
    """
    text = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("fields"))
    lines = text.where(F.size("fields") > 0).withColumn("n", F.size("fields").cast("long"))
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("file", "part").agg(F.sum("n").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    inside = Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counted.join(parts.select("file", "part", "before"), ["file", "part"]).select("file", (F.col("before") + F.col("inside")).alias("place"), "fields")


def _with_header(lines: DataFrame) -> DataFrame:
    """lines with N and D, a file's first two fields, and how many fields it has; raises where those are fewer than N D."""
    size = F.size("fields").cast("long")
    first = F.when(F.col("place") == 0, F.element_at("fields", 1))
    second = F.when((F.col("place") == 0) & (size > 1), F.get("fields", F.lit(1))).when(F.col("place") == 1, F.element_at("fields", 1))
    head = lines.groupBy("file").agg(F.max(first).cast("long").alias("n"), F.max(second).cast("long").alias("d"), F.sum(size).alias("total"))
    short = F.raise_error(F.lit("the matrix is shorter than its header says")).cast("long")
    head = head.withColumn("n", F.when(F.col("total") - 2 >= F.col("n") * F.col("d"), F.col("n")).otherwise(short))
    return lines.join(head, "file")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of a dense matrix file: N D, then N rows of D numbers. Fewer numbers raise; what follows them is left to read_labels().

    Numbers may be laid out over lines in any way. A line that is one row goes
    straight through; the pieces of other rows are brought together by row.
    """
    rows = _with_header(_lines(spark, path)).where("n * d > 0").withColumn("at", F.col("place") - 2).withColumn("size", F.size("fields").cast("long"))
    # the numbers of a line that belong to the matrix
    rows = rows.withColumn("skip", F.greatest(-F.col("at"), F.lit(0))).withColumn("last", F.least(F.col("at") + F.col("size"), F.col("n") * F.col("d")))
    rows = rows.withColumn("first", F.col("at") + F.col("skip")).where("first < last")
    pieces = rows.select("file", "d", "fields", "at", "first", "last", F.explode(F.expr("sequence(first div d, (last - 1) div d)")).alias("id"))
    begin, end = F.greatest(F.col("first"), F.col("id") * F.col("d")), F.least(F.col("last"), (F.col("id") + 1) * F.col("d"))
    values = F.transform(F.slice("fields", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")), lambda x: x.cast("double"))
    pieces = pieces.select("file", "id", "d", begin.alias("begin"), values.alias("v"))
    whole = pieces.where(F.size("v") == F.col("d")).select("id", "v")
    parts = pieces.where(F.size("v") < F.col("d")).groupBy("file", "id").agg(F.sort_array(F.collect_list(F.struct("begin", "v"))).alias("p"))
    return whole.union(parts.select("id", F.flatten(F.transform("p", lambda x: x["v"])).alias("v")))


def read_labels(spark: SparkSession, path: str, max_k: int = 50) -> DataFrame:
    """(k, id, label) of initial labels: after the matrix, a block of N labels for each k = 1..max_k; 0 <= label < k. A block that isn't whole is left out."""
    rows = _with_header(_lines(spark, path)).where("n > 0").withColumn("after", F.col("place") - 2 - F.col("n") * F.col("d"))
    rows = rows.where(F.col("after") + F.size("fields") > 0).select("n", "after", (F.col("total") - 2 - F.col("n") * F.col("d")).alias("labels"), F.posexplode("fields").alias("at", "x"))
    rows = rows.withColumn("at", F.col("after") + F.col("at")).where("at >= 0").withColumn("k", F.expr("cast(at div n as int)") + 1).where((F.col("k") <= max_k) & (F.col("k") * F.col("n") <= F.col("labels")))
    label = F.col("x").cast("int")
    good = F.when((label >= 0) & (label < F.col("k")), label).otherwise(F.raise_error(F.lit("label out of range")).cast("int"))
    return rows.select("k", F.expr("at % n").alias("id"), good.alias("label"))


def write_tsv(df: DataFrame, path: str) -> None:
    """Columns in order, tab-separated, without a header; the writer commits whole or not at all."""
    df.write.mode("overwrite").option("sep", "\t").option("header", False).option("emptyValue", "").csv(path)


def embedding_text(df: DataFrame, y: str = "y") -> DataFrame:
    """A line for each point: every value with six significant digits and a tab after it."""
    return df.select(F.concat_ws("", F.transform(F.col(y), lambda v: F.concat(F.format_string("%.6g", v), F.lit("\t")))).alias("value"))
