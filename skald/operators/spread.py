"""How many partitions a table's rows ask for, so that what a task holds does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a partition, about.
ROWS_PER_TASK = 500_000


def partitions_for(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Partitions of about ``rows_per_task`` rows; the rows are counted for it."""
    return max(1, -(-rows.count() // rows_per_task))
