"""Session settings the operators are written for."""

from __future__ import annotations

# Adaptive execution decides broadcasts from measured sizes, splits skewed join partitions and sizes shuffle
# partitions; shuffled hash joins replace sorts where the build side of every partition is small.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder):
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder
