"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.communities import components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the smallest node of its component, for each end of an edge; ends are long and not null."""
    return components(edges.select(F.col(a).alias("source"), F.col(b).alias("target"))).withColumnRenamed("component", "root")
