"""Dataset catalogue, readers, published versions and result sinks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.vectors import pack


@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset lies and which column is what. ``path`` is the raw data, ``prepared``
    the cleaned version; both CSV or parquet, told by the ending."""

    name: str
    path: str | None = None
    prepared: str | None = None
    label: str | None = None  # default: the last column
    features: Sequence[str] | None = None  # default: all but id and label
    id: str | None = None
    positive: Sequence | None = None  # label values that become 1; None keeps 0/1 labels
    schema: T.StructType | None = None


# fixed values: the datasets of the test bench
NAMES = [
    "Adult",
    "Forest coverage",
    "Haberman",
    "Ionosphere",
    "Mammography",
    "Oil",
    "Phoneme",
    "Pima diabetes",
    "Satimage",
    "Abalone",
    "Ecoli",
    "us_crime",
    "yeast_ml8",
]

CATALOG: dict[str, DatasetSpec] = {name: DatasetSpec(name) for name in NAMES}


def locate(name: str, path: str | None = None, prepared: str | None = None, **columns) -> DatasetSpec:
    """Set or add a catalogue entry: the catalogue knows names, the user knows paths."""
    spec = replace(CATALOG.get(name, DatasetSpec(name)), name=name, path=path, prepared=prepared, **columns)
    CATALOG[name] = spec
    return spec


def dataset(name: str, preprocessed: bool = False) -> DatasetSpec:
    """Catalogue lookup: KeyError for an unknown name, ValueError for a version without a path."""
    spec = CATALOG[name]
    if (spec.prepared if preprocessed else spec.path) is None:
        raise ValueError(f"dataset {name!r} has no {'prepared' if preprocessed else 'raw'} version")
    return spec


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header (types inferred unless a schema is given) or parquet."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def load(spark: SparkSession, spec: DatasetSpec, prepared: bool = False) -> DataFrame:
    path = spec.prepared if prepared else spec.path
    if path is None:
        raise ValueError(f"dataset {spec.name!r} has no {'prepared' if prepared else 'raw'} version")
    return read(spark, path, spec.schema)


def split_target(df: DataFrame, id: str, label: str | None = None, features: Sequence[str] | None = None,
                 positive: Sequence | None = None) -> DataFrame:
    """(row_id, label, features): the last column is the label unless named, the rest are features."""
    label = label or [c for c in df.columns if c != id][-1]
    features = features or [c for c in df.columns if c not in (id, label)]
    y = F.col(label).cast("int") if positive is None else F.col(label).isin(list(positive)).cast("int")
    return df.select(F.col(id).cast("bigint").alias("row_id"), y.alias("label"), pack(features).alias("features"))


def profile(df: DataFrame, label: str, features: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., total_samples, features, classes, class_counts, imbalance_ratio).

    Classes are 0..max(label); a class without rows makes the ratio infinite.
    """
    by = list(by)
    width = len([c for c in df.columns if c not in (label, *by)]) if features is None else features
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(label).cast("int").alias("label"), "n")))  # one entry per class
    stats = counts.groupBy(*by).agg(
        F.sum("n").alias("total_samples"), F.count(F.lit(1)).alias("classes"), pairs.alias("class_counts"),
        F.max("n").alias("_max"), F.min("n").alias("_min"), F.max(F.col(label)).alias("_top"))
    ratio = F.when(F.col("classes") < F.col("_top") + 1, F.lit(float("inf"))).otherwise(F.col("_max") / F.col("_min"))
    return stats.select(*by, "total_samples", F.lit(width).alias("features"), "classes", "class_counts", ratio.alias("imbalance_ratio"))


# ---- published versions --------------------------------------------------

VERSIONS = "version int, parent int, total_samples bigint, features int, classes bigint, train_samples bigint, test_samples bigint"


def _versions(spark: SparkSession, path: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # every version has a folder of its own, so writers at the same time share no committer
    return spark.read.schema(VERSIONS).option("recursiveFileLookup", True).parquet(f"{path}/versions") if files.exists(folder) else spark.createDataFrame([], VERSIONS)


def _claim(spark: SparkSession, path: str, version: int) -> bool:
    """Create the version's marker if nobody has: the store lets one writer do that."""
    jvm = spark._jvm.org.apache.hadoop.fs
    marker = jvm.Path(f"{path}/claims/{version}")
    files = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(marker.getParent())
    try:
        if files.getUri().getScheme() == "file":  # Hadoop's local create looks first and then opens
            none = spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)
            spark._jvm.java.nio.file.Files.createFile(files.pathToFile(marker).toPath(), none)
        else:
            files.create(marker, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def publish(df: DataFrame, path: str, label: str, parent: int | None = None, test_size: float = 0.2) -> int:
    """Write a new version of a dataset under ``path`` with its metadata row; gives the version number.

    Of writers at the same time, one gets a number and the others take the next: a number is claimed by creating its marker, which
    only the first can. Data is never overwritten. The metadata row is written last, so a version that failed half-way is not listed and its number not used again.
    """
    spark = df.sparkSession
    known = _versions(spark, path)
    if parent is not None and known.filter(F.col("version") == parent).isEmpty():
        raise ValueError(f"no version {parent} under {path}")
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    while not _claim(spark, path, version):
        version += 1
    df.write.mode("errorifexists").parquet(f"{path}/data/version={version}")
    written = spark.read.schema(df.schema).parquet(f"{path}/data/version={version}")
    stats = profile(written, label)
    test = F.ceil(F.col("total_samples") * F.lit(test_size))
    row = stats.select(
        F.lit(version).alias("version"), F.lit(parent).cast("int").alias("parent"), "total_samples", "features", "classes",
        (F.col("total_samples") - test).alias("train_samples"), test.alias("test_samples"))
    row.write.mode("errorifexists").parquet(f"{path}/versions/of={version}")
    return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    return _versions(spark, path)


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A published version, the latest by default."""
    known = _versions(spark, path)
    if version is None:
        version = known.agg(F.max("version")).first()[0]
    if version is None or known.filter(F.col("version") == version).isEmpty():
        raise ValueError(f"no version {version} under {path}")
    return spark.read.parquet(f"{path}/data/version={version}")


# ---- result sinks --------------------------------------------------------


def write_results_csv(flat: DataFrame, path: str) -> None:
    """One row per classifier and metric, unrounded, with a header."""
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_results_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, nested; timestamps and other non-JSON types as text."""
    plain = (T.NumericType, T.StringType, T.BooleanType, T.ArrayType, T.StructType, T.MapType)
    cols = [F.col(f.name) if isinstance(f.dataType, plain) else F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").json(path)
