"""Every pairing of two key tables, as an equi-join.

Scoring a unit x course grid needs each pair once by definition.  The right keys are spread
over hash slots and every left row visits each slot, so Spark sees an ordinary equi-join:
it broadcasts the right side when its size allows and otherwise shuffles both sides into
equal slots.  Neither side is gathered in one task.
"""

from pyspark.sql import functions as F


def pair_keys(left, right, right_key: str):
    """Each left key with each right key, keys only: how much is moved per pair does not depend on
    what is known of either side.  Measures are looked up afterwards, a side at a time."""
    return pair_grid(left, right, right_key)


def pair_grid(left, right, right_key, slots: int | None = None):
    """Each left row with each right row; ``right_key`` must be unique on the right.

    By default there are as many slots as shuffle partitions, at least 64.
    """
    if slots is None:
        slots = max(64, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    right = right.withColumn("_slot", F.pmod(F.xxhash64(right_key), F.lit(slots)).cast("int"))
    left = left.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return left.join(right, "_slot").drop("_slot")
