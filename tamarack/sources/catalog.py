"""A catalog of named indexes, each a vector table with records."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.lineage import cut, maybe_broadcast
from tamarack.operators import knn as nn
from tamarack.sources.files import read_jsonl, read_vectors


@dataclass
class Index:
    """vectors: (ordinal, embedding); records: (ordinal, key, rec)."""

    vectors: DataFrame
    records: DataFrame


@dataclass
class Catalog:
    """Indexes by name. A search in all of them scans each once, for all queries."""

    indexes: dict[str, Index] = field(default_factory=dict)
    metric: str = "l2"

    @classmethod
    def load(cls, spark: SparkSession, config: dict[str, dict], metric: str = "l2") -> Catalog:
        """config: name to index_path (Parquet), jsonl_path and, if wanted, id_key."""
        return cls({n: Index(read_vectors(spark, c["index_path"]), read_jsonl(spark, c["jsonl_path"], c.get("id_key"))) for n, c in config.items()}, metric)

    def index(self, name: str) -> Index:
        if name not in self.indexes:
            raise ValueError(f"unknown index {name!r}; known: {', '.join(self.indexes)}")
        return self.indexes[name]

    def search(self, name: str, queries: DataFrame | nn.Asked, k: int = nn.DEFAULT_K) -> DataFrame:
        """(query_id, rank, ordinal, score, key, rec) of the k nearest in one index; queries: query_id, query.

        The search runs once, here, however often its hits are used. Only records that were hit meet them.
        """
        own = self.index(name)
        hits = cut(nn.knn(queries, own.vectors, k, self.metric))
        hit = maybe_broadcast(hits.select("ordinal").distinct(), 32)
        return cut(nn.lookup(hits, own.records.join(hit, "ordinal", "left_semi")))

    def search_all(self, queries: DataFrame | nn.Asked, k: int = nn.DEFAULT_K) -> DataFrame:
        """search in every index, with the column kb."""
        tagged = lambda part: reduce(DataFrame.unionByName, [getattr(i, part).withColumn("kb", F.lit(n)) for n, i in self.indexes.items()])
        return nn.lookup(nn.knn(queries, tagged("vectors"), k, self.metric, ["kb"]), tagged("records"))
