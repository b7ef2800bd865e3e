"""Tables written once and read back, and this package for Python workers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each application, so they need no installed copy."""
    import pathlib
    import tempfile
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = pathlib.Path(__file__).resolve().parents[1]
    if not root.is_dir():  # itself in an archive that Spark has shipped
        return
    to = pathlib.Path(tempfile.mkdtemp(prefix="assaykit-")) / "assaykit-src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        import tempfile

        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='assaykit-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to several tasks for each core. For rows that weigh little and cost much: files are split by bytes, so
    a million cases may come in three splits, and the evaluators would run in three tasks."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def stored(df: DataFrame) -> DataFrame:
    """df as a stored table. Scored results are read several times, and filters on their derived columns should not be
    rewritten into the expressions that made them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what this application has stored in the shared folder. For its end: results that aren't written yet read from there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_position(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """df with its position, 0 to n - 1, in the given total order, without one task for all rows.

    Rows are range-partitioned and stored with the number of their part, so that every later read sees the same parts,
    whatever the optimizer makes of the exchange; they are numbered inside and shifted by the sizes of the parts before.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return own.join(F.broadcast(before), "_part").withColumn(name, (F.col("_in") - 1 + F.col("_before")).cast("long")).drop("_part", "_in", "_before")
