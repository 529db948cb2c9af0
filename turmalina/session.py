"""Session settings the jobs are written for."""

# Joins choose their strategy from sizes Spark knows: a side is broadcast only below the
# threshold, and hot keys of the larger joins are split at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark, **overrides):
    """Apply the settings to a running session."""
    for key, value in {**SETTINGS, **overrides}.items():
        spark.conf.set(key, value)
    return spark
