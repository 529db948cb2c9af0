"""Written copies shared by queries of one application over the same table files."""

from pyspark.sql import functions as F

from turmalina.sources.tables import work_path

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_paths = {}


def fingerprint(spark, sf_dir):
    """Changes when any table file changes; file contents are not read."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{n}.parquet" for n in SOURCES])
    mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))
    return tuple(files.agg(mark, F.count("*")).first())


def written(spark, sf_dir, name, write):
    """Path of the copy; ``write(path)`` makes it the first time."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir, name, fingerprint(spark, sf_dir))
    if key not in _paths:
        path = work_path(spark, name)
        write(path)
        _paths[key] = path
    return _paths[key]
