"""Tabular molecule files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvane.operators.scaling import Scaler, fit_scaler
from solvane.operators.split import split_by_column, split_by_size

# The sixteen columns of a polymer table, by position.
POLYMER_COLUMNS = [
    "id", "nickname", "refno", "pcemax", "pceave", "voc", "jsc", "ff",
    "mw", "mn", "pdi", "monomer", "neghomo", "neglumo", "bandgap", "smiles",
]
_POLYMER_STRINGS = {"nickname", "refno", "monomer", "smiles"}

MOLECULE_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("SMILES_str", T.StringType()), T.StructField("pce", T.DoubleType())]
)


def polymer_schema() -> T.StructType:
    def kind(name: str) -> T.DataType:
        if name == "id":
            return T.LongType()
        return T.StringType() if name in _POLYMER_STRINGS else T.DoubleType()

    return T.StructType([T.StructField(name, kind(name)) for name in POLYMER_COLUMNS])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Comma-separated file with a header; without a schema the types are inferred by a first pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_indexed_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As :func:`read_csv`; the first column, whatever its name, is the row number."""
    df = read_csv(spark, path, schema)
    return df.withColumnRenamed(df.columns[0], "row_id")


def read_polymers(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, ISO-8859-1; the header line is replaced by sixteen names."""
    reader = spark.read.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").option("enforceSchema", True)
    return reader.schema(polymer_schema()).csv(path)


def read_all(spark: SparkSession, path: str, optional: str | None, schema: T.StructType | str) -> DataFrame:
    """A table, and a second one appended if it exists."""
    df = read_indexed_csv(spark, path, schema)
    if optional is None or not path_exists(spark, optional):
        return df
    return append(df, read_indexed_csv(spark, optional, schema))


def append(first: DataFrame, second: DataFrame | None) -> DataFrame:
    return first if second is None else first.unionByName(second)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system its path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


@dataclass
class Dataset:
    """A labelled table with the scaler fitted on its training rows."""

    table: DataFrame
    x_column: str
    y_column: str
    scaler: Scaler
    phase: str

    def phases(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return split_by_column(self.table, self.phase)


def load_dataset(spark: SparkSession, spec: dict, id_col: str, seed: int = 200, table: DataFrame | None = None) -> Dataset:
    """Read, split and scale by a specification with ``src``, ``x_column``, ``y_column`` and ``split``.

    ``split`` names a column holding train, val and test, or gives three sizes.
    """
    if table is None:
        src = spec["src"]
        table = read_csv(spark, src, spec.get("schema")) if src.endswith(".csv") else spark.read.parquet(src)
    x_column, y_column, split = spec["x_column"][0], spec["y_column"][0], spec["split"]
    if isinstance(split, str):
        phase = split
    else:
        phase = "ml_phase"
        table = split_by_size(table, id_col, split, seed, phase)
    scaler = fit_scaler(table.filter(F.col(phase) == "train"), y_column)
    return Dataset(table, x_column, y_column, scaler, phase)
