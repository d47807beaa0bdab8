"""How grouped work is dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks per core for groups whose work is far larger than their rows.
TASKS_PER_CORE = 4


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with the groups of keys dealt to as many tasks as keep all cores busy.

    Small groups that take long to work on would otherwise be put into few tasks by their size in bytes.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
