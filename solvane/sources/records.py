"""Multi-line molecule records with conformers.

A record is: SMILES / InChI / 5 strings and 8 numbers, comma-separated / pruned
SMILES / number of conformers / per conformer a ``Conformer`` line, an atom
count n, n atom lines and 4 further lines.  Its length depends on counts inside
it, but its second line always starts with ``InChI=``.  Reading with that as the
record separator lets Spark split large files; each piece then ends with the
first line of the record that follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of the eighteen columns, by position.
RECORD_COLUMNS = [
    "smiles", "inchi",
    "doi", "inchikey", "construction", "architecture", "complement", "homo", "lumo",
    "electrochemicalgap", "opticalgap", "pce", "voc", "jsc", "fillfactor",
    "prunedsmiles",
    "numberconformers", "conformers",
]
_TEXTS, _NUMBERS = RECORD_COLUMNS[2:7], RECORD_COLUMNS[7:15]
_MARK = "InChI="


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Table of the eighteen columns; ``conformers`` is not filled."""
    pieces = spark.read.option("lineSep", "\n" + _MARK).text(path)
    lines = pieces.select(
        F.split(F.rtrim(F.regexp_replace("value", "\r", ""), F.lit("\n")), "\n").alias("l"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    line = lambda i: F.trim(F.get("l", F.lit(i)))
    fields = F.split(line(1), ",")
    # Everything is taken from the lines here, so that conformers are never shuffled.
    parsed = lines.select(
        "_file", "_start", "_at",
        F.trim(F.element_at("l", -1)).alias("_next"),
        F.concat(F.lit(_MARK), line(0)).alias("inchi"),
        *[F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(_TEXTS)],
        *[F.get(fields, F.lit(5 + i)).alias(name) for i, name in enumerate(_NUMBERS)],
        line(2).alias("prunedsmiles"),
        line(3).alias("numberconformers"),
        F.size(F.filter("l", lambda s: s.startswith("Conformer"))).alias("_marks"),
    )

    # The SMILES of a piece is the end of the piece before it, within the file
    # split or, for the first piece of a split, in the nearest split before.
    within = Window.partitionBy("_file", "_start").orderBy("_at")
    splits = parsed.groupBy("_file", "_start").agg(F.max_by("_next", "_at").alias("_tail"))
    in_file = Window.partitionBy("_file").orderBy("_start")
    tails = splits.select("_file", "_start", F.lag("_tail").over(in_file).alias("_carry"))
    linked = parsed.withColumn("_previous", F.lag("_next").over(within)).join(tails, ["_file", "_start"])
    # The first piece of a file holds only the first SMILES.
    head = F.col("_previous").isNull() & F.col("_carry").isNull()
    records = linked.filter(~head).withColumn("smiles", F.coalesce("_previous", "_carry"))

    count = F.col("numberconformers").cast("int")
    wrong = F.raise_error(F.concat(F.lit("wrong number of conformers in record "), F.col("smiles"))).cast("int")
    return records.select(
        "smiles", "inchi", *_TEXTS,
        *[F.col(name).cast("double").alias(name) for name in _NUMBERS],
        "prunedsmiles",
        F.when(F.col("_marks") == count, count).otherwise(wrong).alias("numberconformers"),
        F.lit(None).cast("array<struct<atoms:array<string>,properties:array<string>>>").alias("conformers"),
    )
