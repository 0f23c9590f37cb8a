"""The data model: a property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = ("id", "type", "name", "file", "package")
EDGE_COLUMNS = ("type", "src", "dst")

#: What a dependency is made of, for the walk presets.
DEPENDENCY = ("DEPENDS_ON", "IMPORTS", "USES", "CALLS", "CREATES", "INJECTS", "REFERENCES", "CONFIGURES", "REGISTERED_IN", "PROVIDES", "CONSUMES")
#: What a semantic expansion walks along, in both directions.
EXPANSION = ("CALLS", "HANDLES", "READS", "WRITES", "IMPORTS", "EXPORTS", "CONFIGURES", "INJECTS", "CONTAINS", "DEPENDS_ON", "USES", "REFERENCES", "AUTHORIZES", "REGISTERED_IN", "PROVIDES", "MOUNTS", "EXPOSES")
USAGE = ("CALLS", "HANDLES", "USES", "REFERENCES", "INJECTS", "AUTHORIZES")
OWNERSHIP = ("CONTAINS", "PROVIDES", "REGISTERED_IN", "HANDLES", "DECLARES", "BELONGS_TO")


@dataclass(frozen=True)
class Graph:
    """``nodes``: id, type, name, file, package (and more); ``edges``: type, src, dst, unique as a triple.

    ``links``, where it is given, has the same edges before they were made unique, for what doesn't count them.
    """

    nodes: DataFrame
    edges: DataFrame
    links: DataFrame | None = None

    def of_types(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*types))

    def by_relation(self, relations: tuple[str, ...] | list[str] | None = None) -> DataFrame:
        """Edges of some relations: none given means all, an empty list means no edge."""
        return _of_relation(self.edges, relations)

    def links_of(self, relations: tuple[str, ...] | list[str] | None = None) -> DataFrame:
        """Edges of some relations, each at least once."""
        return _of_relation(self.edges if self.links is None else self.links, relations)


def _of_relation(edges: DataFrame, relations: tuple[str, ...] | list[str] | None) -> DataFrame:
    if relations is None:
        return edges
    return edges.where(F.col("type").isin(*relations)) if relations else edges.where(F.lit(False))


def merge_nodes(rows: DataFrame, order: str) -> DataFrame:
    """One row per id: the first non-null of each column in the order of ingestion."""
    rest = [c for c in rows.columns if c not in ("id", order)]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return rows.groupBy("id").agg(*firsts)


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the latest."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r_")).select(*keys, "r_.*")
