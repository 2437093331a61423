"""Rules on streams: those that look at one row run as they are; repeated line keys within a watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Contract
from ..operators import rules

STATELESS = [r for r in rules.RULES if r.rule_id not in ("country_rare", "duplicate_line_key")]


def flag(stream: DataFrame, contract: Contract | None = None) -> DataFrame:
    """stream with a boolean column for each rule that needs no other row."""
    return rules.flag(stream, contract, STATELESS)


def drop_repeats(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def drift(stream: DataFrame, time: str, measure: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Count, mean and deviation of a measure in tumbling windows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("std"))
