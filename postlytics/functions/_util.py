from pyspark.sql import Column, functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
