"""Reading and writing tables."""

import os
import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F


def run_query(spark, query: str, views: dict | None = None):
    """Run SQL over the given tables; a failed query raises ``RuntimeError``."""
    try:
        for name, df in (views or {}).items():
            df.createOrReplaceTempView(name)
        return spark.sql(query)
    except Exception as error:
        raise RuntimeError(f"SQL query failed: {error}") from error


def read_database(spark, url: str, query: str, partition_column: str | None = None,
                  bounds: tuple | None = None, partitions: int = 64, **options):
    """Rows of a query run by an external database.

    With a numeric ``partition_column`` and its bounds the extract is read by many tasks at
    once; without, by a single one.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition_column is None:
        return reader.option("query", query).load()
    return (reader.option("dbtable", f"({query}) extract")
            .option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0]).option("upperBound", bounds[1])
            .option("numPartitions", partitions).load())


def read_table(spark, path: str, schema=None, fmt: str = "parquet", **options):
    """One table.  Text formats need a schema; it is checked against the header line."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def read_folder(spark, path: str, pattern: str, schema=None, fmt: str = "parquet", **options):
    """Every matching file of a folder as one table, columns matched by name.

    Parquet files may differ in columns; missing ones read as null.
    """
    if fmt == "parquet" and schema is None:
        options.setdefault("mergeSchema", "true")
    return read_table(spark, path, schema, fmt, pathGlobFilter=pattern, **options)


def folder_files(spark, path: str, pattern: str):
    """The paths of a folder's matching files, from their listing; no file is opened."""
    listed = spark._jvm.org.apache.hadoop.fs.Path(path, pattern)
    found = listed.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(listed)
    return sorted(f.getPath().toString() for f in found or [])


def read_drifting(spark, path: str, pattern: str, schema):
    """Every matching Parquet file of a folder under one schema, also where a column's type or
    presence differs by file.

    Files are grouped by the schema in their footer; each group is one scan, cast to ``schema``
    (what can't be cast is null, as are absent columns), and the groups are stacked."""
    groups = {}
    for file in folder_files(spark, path, pattern):
        own = spark.read.parquet(file).schema
        groups.setdefault(own.json(), (own, []))[1].append(file)
    if not groups:
        return spark.createDataFrame([], schema)
    return union_by_name(*(conform(spark.read.schema(own).parquet(*files), schema) for own, files in groups.values()))


def union_by_name(first, *others):
    """Stack tables, columns matched by name, missing ones null."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def trim_column_names(df):
    return df.toDF(*[c.strip() for c in df.columns])


def conform(df, schema):
    """Columns of ``schema`` in its order and types; absent ones null, NaN as null."""
    kinds = dict(df.dtypes)
    columns = []
    for field in schema.fields:
        if field.name not in kinds:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        c = F.col(f"`{field.name}`")
        if kinds[field.name] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        columns.append(c.try_cast(field.dataType).alias(field.name))
    return df.select(*columns)


def write_panel(df, path: str, years=None):
    """Write the panel, one folder per year; with ``years`` only those years' folders are replaced,
    and rows of other years are left out."""
    if years is not None:
        df = df.filter(F.col("ANO").isin(list(years)))
    # Rebalancing keeps the files of a year few, and splits a year that is far larger.
    writer = df.hint("rebalance", "ANO").write.mode("overwrite").partitionBy("ANO")
    writer.option("partitionOverwriteMode", "static" if years is None else "dynamic").parquet(path)


def read_panel(spark, path: str):
    """Read a written panel; a filter on ``ANO`` prunes folders."""
    df = spark.read.parquet(path)
    return df.withColumn("ANO", F.col("ANO").cast("int"))


def save_model(model: PipelineModel, path: str):
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def work_path(spark, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; only a local session may go
    without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if shared:
        return f"{shared.rstrip('/')}/turmalina/{name}-{uuid.uuid4().hex}"
    return os.path.join(tempfile.mkdtemp(prefix="turmalina-"), name)


def written(df, name: str):
    """``df`` written to a new path and read back; later steps start from the files."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
