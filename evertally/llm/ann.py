"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search answers queries.

1. Equal vectors are one node. Nodes are dealt by a hash to shards of about SHARD nodes, each a sample of the whole table
   that one task holds. The first neighbours of a node come from blocks: codes of random hyperplanes, at several lengths,
   with large codes cut into blocks of bounded size, so that similar or hot vectors never meet all at once.
2. NN-descent in each shard: every node brings together a sample of its neighbours and of the nodes that have it as
   neighbour, those that have not met yet first; each pair that improves one's list is proposed, and lists keep the best.
   Repeated until at most CHANGED of all list entries are new.
   In the end a node also leads to some of those that have it in their lists.
3. A query is searched in the graph of every shard: it starts from its own list where it is a node, and from the best of the
   shard's entries, of which every node is one or has one in its list, expands the best nodes not yet expanded, and keeps the best nodes, until all of these are expanded. It
   remembers every node that it has met, so none is scored twice. How many nodes it keeps follows the table: from BEAM on,
   over all shards, doubled until TRIED queries find TARGET of what a comparison with all vectors finds; the answers of
   these queries are used as they are. Queries go in batches whose vectors take QUERY_BYTES, which are broadcast. Queries
   that find fewer than wanted, which a graph of scattered parts can cause, are compared with all vectors.
4. Nodes become the ids of their equal vectors, nearest first, ties to the smaller id.

What a task does with a shard is numpy (`shard_graph`). Samples and beams bound the work only: every vector is indexed, and
tests hold recall against brute force.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of
another length than most; null ids take no part; rows that repeat an id count once, with the first vector in order; a
query is never its own neighbour; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evertally.llm import shard_graph
from evertally.llm.tables import written

WANTED = 20
#: Neighbours per node; of these, how many (and of reverse ones) meet in a round.
DEGREE, MEETING = 32, 14
#: Rounds end when at most this share of the list entries is new.
CHANGED = 0.05
TABLES, BLOCK = 9, 512
#: The smallest beam, and the recall at which TRIED queries find it large enough.
BEAM, TARGET, TRIED = 224, 0.95, 200
#: Bytes of the query vectors that are sent to every executor at a time.
QUERY_BYTES = 16 << 20
#: Nodes of a shard, and bytes of its vectors, on average.
SHARD, SHARD_BYTES = 1 << 14, 64 << 20


def usable(vector: str) -> Column:
    """Whether a vector can take part."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~broken & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def best(entry: Column, count: int) -> Column:
    """The best distinct (distance, node) of a group, in order."""
    return F.slice(F.array_sort(F.collect_set(entry)), 1, count)


def _graph(shard: pa.Table, settings: dict) -> pa.Table:
    """The nodes of a shard by id, their vectors, and the nodes that they lead to by place, as one row."""
    shard = shard.sort_by("node")
    vectors = matrix(shard.column("vector").combine_chunks())
    lists = shard_graph.linked(shard_graph.neighbour_lists(vectors, **settings), settings["degree"] // 2)
    packed = [shard.column("shard")[:1], *([x.tobytes()] for x in (shard.column("node").to_numpy(), vectors, lists))]
    return pa.table(packed, names=["shard", "nodes", "vectors", "lists"])


def _unpacked(batches: Iterator[pa.RecordBatch], element: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, vectors, lists) of each shard."""
    for batch in batches:
        for row in range(batch.num_rows):
            nodes = np.frombuffer(batch.column("nodes")[row].as_py(), dtype=np.int64)
            vectors = np.frombuffer(batch.column("vectors")[row].as_py(), dtype=element).reshape(len(nodes), -1)
            yield nodes, vectors, np.frombuffer(batch.column("lists")[row].as_py(), dtype=np.int32).reshape(len(nodes), -1)


def _places(nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where ids are among nodes in order, or -1."""
    at = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
    return np.where(nodes[at] == ids, at, -1)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


FOUND = "query bigint, beam array<struct<distance:double,other:bigint>>, asks array<bigint>"


def _answers(queries: np.ndarray, distance: np.ndarray, other: np.ndarray, asks: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """One row per query; distances are infinite where nothing was found."""
    real = distance < np.inf
    entries = pa.StructArray.from_arrays([pa.array(distance[real]), pa.array(other[real])], names=["distance", "other"])
    asked, met = asks if asks else (np.zeros(len(queries), dtype=np.int64), np.empty(0, dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array(queries), _lists(real.sum(axis=1), entries), _lists(asked, pa.array(met))], names=["query", "beam", "asks"])


def _searches(batches: Iterator[pa.RecordBatch], asked: Broadcast, element: str, wanted: int, beam: int, part: int, parts: int, traced: bool) -> Iterator[pa.RecordBatch]:
    """What one part of the queries finds in each shard, by exact distances, and what it was compared with if traced."""
    ids, vectors = (x[part::parts] for x in asked.value)
    for nodes, own, lists in _unpacked(batches, element):
        scaled, entries = shard_graph.scaled(own), shard_graph.entries(lists)
        for first in range(0, len(ids), shard_graph.QUERIES):
            queries, asking = ids[first : first + shard_graph.QUERIES], vectors[first : first + shard_graph.QUERIES]
            itself = _places(nodes, queries)
            places, met = shard_graph.greedy(scaled, lists, entries, shard_graph.scaled(asking, each=True), itself, beam)
            distance = shard_graph.exact_distances(own, asking, places)
            order = np.lexsort((places, distance), axis=1)[:, :wanted]
            places, distance = np.take_along_axis(places, order, axis=1), np.take_along_axis(distance, order, axis=1)
            asks = None
            if traced:
                met[np.flatnonzero(itself >= 0), itself[itself >= 0]] = False
                asks = met.sum(axis=1), nodes[np.nonzero(met)[1]]
            yield _answers(queries, distance, nodes[places], asks)


def _comparisons(batches: Iterator[pa.RecordBatch], asked: Broadcast, element: str, wanted: int) -> Iterator[pa.RecordBatch]:
    """The best of each shard for all queries."""
    ids, vectors = asked.value
    for nodes, own, _ in _unpacked(batches, element):
        own = own.astype(np.float64)
        step = max(1, shard_graph.PIECE // len(nodes))
        for first in range(0, len(ids), step):
            queries = ids[first : first + step]
            distance = -(vectors[first : first + step].astype(np.float64) @ own.T)
            itself = _places(nodes, queries)
            distance[np.flatnonzero(itself >= 0), itself[itself >= 0]] = np.inf
            count = min(wanted, len(nodes))
            last = np.partition(distance, count - 1, axis=1)[:, count - 1 : count]
            tied, missing = distance == last, count - (distance < last).sum(axis=1, keepdims=True)
            distance[(distance > last) | tied & (np.cumsum(tied, axis=1) > missing)] = np.inf  # of those as near, the smaller ids stay
            yield _answers(queries, distance, np.broadcast_to(nodes, distance.shape), None)


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact distance of each node to itself."""
    for batch in batches:
        if batch.num_rows:
            own = matrix(batch.column("vector")).astype(np.float64)
            distance = pa.array(-np.einsum("nd,nd->n", own, own))
            yield pa.RecordBatch.from_arrays([batch.column("query"), distance, batch.column("query")], names=["query", "distance", "other"])


class Graph:
    """Nodes (one per distinct vector, named by its smallest id) and their neighbour lists; making one runs the jobs."""

    def __init__(self, embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding"):
        element = embeddings.select(F.col(vector).alias("vector")).schema["vector"].dataType.elementType
        kind = "array<float>" if element.simpleString() == "float" else "array<double>"
        rows = embeddings.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast(kind).alias("vector"))
        rows = rows.filter(F.col("id").isNotNull() & usable("vector"))
        sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        rows = rows.filter(F.size("vector") == (sizes["n"] if sizes else 0))
        rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
        self.rows = written(rows.withColumn("key", F.md5(F.to_json(F.struct("vector")))), "vectors")
        # as many of the smallest ids of a vector as a result and the query itself can need
        of_vector = Window.partitionBy("key").orderBy("id")
        members = self.rows.select("key", "id").withColumn("place", F.row_number().over(of_vector))
        members = members.filter(F.col("place") <= WANTED + 1)
        first = members.filter("place = 1").select("key", F.col("id").alias("node"))
        self.members = written(members.join(first, "key").select("key", "node", "id"), "members")
        first = self.members.filter("node = id").select("node", "key")
        self.nodes = written(self.rows.join(first, F.col("id") == F.col("node"), "inner").select("node", "vector"), "nodes")
        self.size, self.element = self.nodes.count(), "f4" if kind == "array<float>" else "f8"
        length = max(1, sizes["n"] if sizes else 0)
        self.shard_count = max(1, -(-self.size // min(SHARD, max(1, SHARD_BYTES // (8 * length)))))
        self.shards = written(self._graphs(), "lists")

    def _graphs(self) -> DataFrame:
        """The shards and their neighbour lists, a row for each."""
        settings = {"degree": DEGREE, "meeting": MEETING, "changed": CHANGED, "tables": TABLES, "block": BLOCK}
        dealt = self.nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(self.shard_count)).cast("int"))
        if self.shard_count > 1:  # each shard in a task of its own
            dealt = dealt.repartitionByRange(3 * self.shard_count, "shard")
        return dealt.groupBy("shard").applyInArrow(lambda shard: _graph(shard, settings), "shard int, nodes binary, vectors binary, lists binary")

    def _shipped(self, queries: DataFrame) -> Iterator[Broadcast]:
        """The ids and vectors of the query nodes, in batches of QUERY_BYTES."""
        asked = self.nodes.join(queries.select("query"), F.col("node") == F.col("query")).select("query", "vector")
        asked = written(asked, "queries")
        count, length = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        batches = max(1, -(-count * length * 4 // QUERY_BYTES))
        for batch in range(batches):
            rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(batches)) == batch).orderBy("query").toArrow().combine_chunks()
            vectors = matrix(rows.column("vector").combine_chunks()) if rows.num_rows else np.empty((0, length), dtype=self.element)
            shipped = asked.sparkSession.sparkContext.broadcast((rows.column("query").to_numpy(), vectors))
            yield shipped
            shipped.unpersist()

    def fitted(self, queries: DataFrame, wanted: int = WANTED) -> tuple[int, DataFrame, DataFrame]:
        """(beam, queries, found): the beam with which TRIED of the query nodes reach the target, these, and what they find."""
        tried = written(queries.orderBy(F.xxhash64("query"), "query").limit(TRIED), "tried")
        true = written(self.exact(tried, wanted).select("query", "other"), "true")
        expected, beam = true.count(), BEAM
        found = self.search(tried, wanted, beam, traced=False)
        while beam < self.size and found.join(true, ["query", "other"]).count() < TARGET * expected:
            beam *= 2
            found = self.search(tried, wanted, beam, traced=False)
        return beam, tried, found

    def search(self, queries: DataFrame, wanted: int = WANTED, size: int = BEAM, traced: bool = True) -> DataFrame:
        """(query, distance, other): the best nodes found for each query node, itself excluded, with beams of a size.

        Traced, the written tables "asks" and "beam" tell of each query with which nodes it was compared.
        """
        found = reduce(DataFrame.unionByName, [self._searched(shipped, wanted, size, traced) for shipped in self._shipped(queries)])
        short = written(found.filter(F.size("beam") < min(wanted, self.size - 1)).select("query"), "short")
        found = found.select("query", F.explode("beam").alias("entry")).select("query", "entry.distance", "entry.other")
        if short.isEmpty():
            return found
        return found.join(short, "query", "left_anti").unionByName(self.exact(short, wanted))

    def _searched(self, shipped: Broadcast, wanted: int, size: int, traced: bool) -> DataFrame:
        """(query, beam, met) of a batch of queries: what they find in all shards, of whose beams each has its share."""
        parts = max(1, 2 * self.shards.sparkSession.sparkContext.defaultParallelism // self.shard_count)
        beam = -(-size // self.shard_count)
        search = partial(_searches, asked=shipped, element=self.element, wanted=wanted, beam=beam, parts=parts, traced=traced)
        # a shard is read once for each part of the queries, so that few shards keep many tasks busy
        found = reduce(DataFrame.unionByName, [self.shards.mapInArrow(partial(search, part=part), FOUND) for part in range(parts)])
        if traced:
            found = written(found, "asks")
        best = F.slice(F.array_sort(F.flatten(F.collect_list("beam"))), 1, wanted)
        met = F.concat(F.array("query"), F.flatten(F.collect_list("asks")))
        return written(found.groupBy("query").agg(best.alias("beam"), met.alias("met")), "beam")

    def exact(self, queries: DataFrame, wanted: int = WANTED) -> DataFrame:
        """The true best nodes for each query node: the queries against all nodes, shard by shard."""
        merged = []
        for shipped in self._shipped(queries):
            found = self.shards.mapInArrow(partial(_comparisons, asked=shipped, element=self.element, wanted=wanted), FOUND)
            best = F.slice(F.array_sort(F.flatten(F.collect_list("beam"))), 1, wanted)
            merged.append(written(found.groupBy("query").agg(best.alias("beam")), "exact"))
        merged = reduce(DataFrame.unionByName, merged)
        return merged.select("query", F.explode("beam").alias("entry")).select("query", "entry.distance", "entry.other")

    def neighbours(self, queries: DataFrame, wanted: int = WANTED) -> DataFrame:
        """query_id, rank, vec_id, score of each query id."""
        own = queries.select(F.col("query_id").cast("bigint").alias("query_id")).distinct()
        nodes = self.members.filter("node = id").select("key", "node")
        own = own.join(self.rows.select("id", "key"), F.col("query_id") == F.col("id")).join(nodes, "key").select("query_id", "node")
        own = written(own, "own")
        asked = own.select(F.col("node").alias("query")).distinct()
        self.beam, tried, found = self.fitted(asked, wanted)
        found = found.unionByName(self.search(asked.join(tried, "query", "left_anti"), wanted, self.beam, traced=False))
        itself = self.nodes.join(asked, F.col("node") == F.col("query")).select("query", "vector")
        found = found.unionByName(itself.mapInArrow(_norms, "query bigint, distance double, other bigint"))
        members = self.members.select(F.col("node").alias("of"), "id")
        found = found.join(members, F.col("other") == F.col("of")).select("query", "distance", "id")
        # of a query's node, as many ids as any of its queries can need
        listed = found.groupBy("query").agg(best(F.struct("distance", "id"), wanted + 1).alias("list"))
        rows = own.join(listed, F.col("node") == F.col("query"))
        kept = F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, wanted)
        rows = rows.select("query_id", F.posexplode(kept).alias("place", "entry"))
        return rows.select(
            "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("entry.id").alias("vec_id"), (-F.col("entry.distance")).alias("score")
        )


def nearest(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20) -> DataFrame:
    """The nearest neighbours of every vector whose id is divisible by `every`, among all others."""
    graph = Graph(embeddings, vec_id, vector)
    return graph.neighbours(graph.rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id")))
