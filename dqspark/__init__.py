"""A PySpark-native data-quality engine: profiling, cleaning, validation, scoring and pipelines over DataFrames."""
