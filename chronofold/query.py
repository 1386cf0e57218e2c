"""Tables as users see them: a thin wrapper over DataFrames, collections of them, and checked SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from chronofold.errors import QueryError
from chronofold.operators import history as H


class Table:
    """A DataFrame with its entity. Every DataFrame method works; what returns a DataFrame returns a Table."""

    def __init__(self, df: DataFrame, entity: str | None = None, full: DataFrame | None = None, text: str | None = None):
        self.df, self.entity, self._full, self._text = df, entity, full if full is not None else df, text

    def _wrap(self, found: Any) -> Any:
        if isinstance(found, DataFrame):
            return Table(found, self.entity, self._full, self._text)
        return Grouped(found, self) if isinstance(found, GroupedData) else found

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        found = getattr(self.df, name)
        if not callable(found) or name in ("write", "writeStream", "schema"):
            return found

        def call(*args: Any, **named: Any) -> Any:
            bare = lambda x: x.df if isinstance(x, Table) else x
            return self._wrap(found(*map(bare, args), **{k: bare(v) for k, v in named.items()}))

        return call

    def __getitem__(self, item: Any) -> Any:
        return self._wrap(self.df[item])

    def as_of(self, at: str) -> Table:
        """Rows that were valid at a moment."""
        if "valid_from" not in self.df.columns:
            raise QueryError("as_of needs a history")
        return self._wrap(H.as_of(self.df, at))

    def resolve_merges(self) -> Table:
        """These rows and those of the entities merged into them."""
        if self.entity is None:
            raise QueryError("resolve_merges needs an entity's table")
        return self._wrap(H.resolve_merges(self.df, self._full, f"{self.entity}_id"))

    def execute(self) -> Any:
        return self.df.toPandas()

    to_pandas = execute

    def to_pyarrow(self) -> Any:
        return self.df.toArrow()

    def to_parquet(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    def to_csv(self, path: str) -> None:
        self.df.write.mode("overwrite").option("header", True).csv(path)

    def sql(self) -> str:
        """The SQL of a query, or else the plan."""
        return self._text or self.df._jdf.queryExecution().simpleString()


class Grouped:
    """Grouped rows of a table, whose aggregates are tables again."""

    def __init__(self, groups: GroupedData, table: Table):
        self._groups, self._table = groups, table

    def __getattr__(self, name: str) -> Any:
        found = getattr(self._groups, name)
        return (lambda *args, **named: self._table._wrap(found(*args, **named))) if callable(found) else found


class Collection:
    """Several tables at once, and the relationships between their entities."""

    def __init__(self, tables: dict[str, Table], relationships: DataFrame | None = None):
        self.entities, self.relationships = tables, relationships

    def __getitem__(self, name: str) -> Table:
        return self.entities[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.entities)

    def __len__(self) -> int:
        return len(self.entities)

    def _edges(self) -> DataFrame | None:
        return None if self.relationships is None else self.relationships.filter("valid_to is null").select("source_id", "target_id", "relationship_type")

    def _each(self) -> Iterator[tuple[str, DataFrame]]:
        yield from ((name, t.df) for name, t in self.entities.items())
        if self.relationships is not None:
            for row in self.relationships.select("relationship_type").distinct().collect():
                yield f"rel_{row[0]}", self.relationships.filter(F.col("relationship_type") == row[0])

    def to_parquet(self, folder: str) -> None:
        for name, df in self._each():
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    def to_csv(self, folder: str) -> None:
        for name, df in self._each():
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")

    def to_pandas(self) -> dict[str, Any]:
        return {name: df.toPandas() for name, df in self._each()}

    def to_duckdb(self, path: str) -> None:
        """Each table into a DuckDB file, by way of the driver."""
        import duckdb

        with duckdb.connect(path) as out:
            for name, df in self._each():
                arrow = df.toArrow()  # noqa: F841  named in the statement
                out.execute(f'CREATE OR REPLACE TABLE "{name}" AS SELECT * FROM arrow')

    def vertices(self) -> DataFrame:
        """(id, entity_type, properties as JSON without nulls) of all entities."""
        found: DataFrame | None = None
        for name, t in self.entities.items():
            own = t.df.select(F.col(f"{name}_id").alias("id"), F.lit(name).alias("entity_type"), F.to_json(F.struct(*[c for c in t.df.columns if c != f"{name}_id"])).alias("properties"))
            found = own if found is None else found.unionByName(own)
        if found is None:
            raise QueryError("no tables")
        return found

    def to_graph_json(self) -> dict[str, list[dict[str, Any]]]:
        import json

        nodes = [{"id": r["id"], "entity_type": r["entity_type"], **json.loads(r["properties"])} for r in self.vertices().collect()]
        edges = self._edges()
        return {"nodes": nodes, "edges": [{"source": r[0], "target": r[1], "type": r[2]} for r in edges.collect()] if edges is not None else []}

    def to_networkx(self) -> Any:
        """A MultiDiGraph, if networkx is there: parallel relationships keep an edge each."""
        import networkx as nx

        told, graph = self.to_graph_json(), nx.MultiDiGraph()
        for node in told["nodes"]:
            graph.add_node(node.pop("id"), **node)
        for e in told["edges"]:
            graph.add_edge(e["source"], e["target"], relationship_type=e["type"])
        return graph

    def to_cypher(self) -> list[str]:
        from chronofold.operators.graph import cypher

        edges = self._edges()
        return cypher([tuple(r) for r in edges.collect()]) if edges is not None else []

    def snapshot(self, target: str) -> None:
        """The tables without their validity columns, as Parquet."""
        for name, t in self.entities.items():
            t.df.drop("valid_from", "valid_to", "merged_into").write.mode("overwrite").parquet(f"{target}/{name}.parquet")


class Views:
    """Named frames for SQL, in a session of their own so that names never clash with the user's."""

    def __init__(self, spark: SparkSession, frames: Callable[[], dict[str, DataFrame]]):
        self.spark, self.frames = spark, frames

    def query(self, text: str) -> Table:
        frames = self.frames()
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        try:
            return Table(self.spark.sql(text), text=text)
        except AnalysisException as error:
            raise self._explained(error, frames) from error
        finally:
            for name in frames:
                self.spark.catalog.dropTempView(name)

    @staticmethod
    def _explained(error: AnalysisException, frames: dict[str, DataFrame]) -> QueryError:
        condition = error.getCondition() or ""
        if condition == "TABLE_OR_VIEW_NOT_FOUND":
            m = re.search(r"`([^`]+)`", str(error))
            return QueryError(f"unknown table '{m[1] if m else '?'}'; there are {sorted(frames)}", {"tables": sorted(frames)})
        if condition.startswith("UNRESOLVED_COLUMN"):
            m = re.search(r"name `([^ ]+)` cannot", str(error))
            columns = sorted({c for df in frames.values() for c in df.columns})
            return QueryError(f"unknown column '{m[1].replace('`', '') if m else '?'}'; there are {columns}", {"columns": columns})
        return QueryError(str(error).split("\n")[0])
