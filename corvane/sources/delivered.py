"""CSV files to typed rows and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.types import parsed


def read_csv(spark: SparkSession, path: str, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the files at ``path`` that fit the columns, and the raw lines that do not.

    Columns are positional: the header line is skipped, whatever it says. Blank
    lines are no rows; spaces around values and quotes around them are dropped.
    Good rows keep their place in ``__at``, which orders them as delivered.
    """
    raw = ", ".join(f"`{i}` string" for i in range(len(kinds)))
    lines = (
        spark.read.schema(f"{raw}, __line string")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "__line")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "\u0001")
        .option("emptyValue", "")
        .csv(path)
        .withColumn(
            "__at",
            F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")),
        )
    )
    values = {c: F.when(F.col("__line").isNull(), parsed(F.col(f"`{i}`"), k)) for i, (c, k) in enumerate(kinds.items())}
    read = lines.select(
        *(v.alias(c) for c, v in values.items()),
        F.coalesce("__line", F.concat_ws(",", *(F.col(f"`{i}`") for i in range(len(kinds))))).alias("__line"),
        "__at",
    )
    bad = F.lit(False)
    for c in kinds:
        bad = bad | F.col(f"`{c}`").isNull()
    return read.filter(~bad).drop("__line"), read.filter(bad).select(F.col("__line").alias("line"))
