"""Approximate nearest neighbours by cosine: a pruned graph in each shard, beam search by every query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from expirylens.llm.common import materialise
from expirylens.llm.vamana import Graph

SHARD_VECTORS = 8192
QUERY_BEAM = 192
QUERY_BLOCK = 512


def _usable(c: Column) -> Column:
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_vectors: int = SHARD_VECTORS, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest vectors found for each query, all if there are fewer.

    The score is the cosine in double precision on the vectors as given. Nearest first, ties to the smaller
    id; a query's own id is no candidate. ``is_query`` is a condition on the columns of ``vectors``.

    Null vectors, those of zero length in either sense, and those with null or non-finite components take no part,
    nor do null ids. Vectors are compared with those of as many components. Rows that repeat an id and a vector
    count once; an id with two vectors is a candidate by each, and the better one counts.

    Points of equal score are passed on together and told apart by their ids; at most ``beam`` points of a shard are looked at for
    a query, so of more points of one direction in a shard than that, some may be missed.

    Equal vectors are one point of the graph: its ``k`` + 1 smallest ids are kept, which is all that a result
    can hold. So neither a hot vector nor its ties weigh on a shard. Points are dealt to shards of about
    ``shard_vectors`` by a hash of the id; a task holds one shard's vectors and graph, and queries stream by.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    group = Window.partitionBy("v").orderBy("id")
    members = materialise(rows.withColumns({"place": F.row_number().over(group), "point": F.first("id").over(group)})
                          .filter(F.col("place") <= k + 1).select("point", "place", "id", "v"))
    points = members.filter("place = 1").select("point", "v")
    asked = materialise(rows.filter("asks").select("id", "v"))
    shards = max(1, -(-points.count() // shard_vectors))
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    table = (points.select(F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("point").alias("id"), "v")
             .unionByName(everywhere).withColumn("size", F.size("v"))
             .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "size", "kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, ids, parts, graph = None, [], [], None

        def answer(at: pa.Array, q: np.ndarray) -> pa.RecordBatch:
            names, exact, unit, id_rank = graph[1:]
            length = np.linalg.norm(q, axis=1)
            found, _ = graph[0].search((q / length[:, None]).astype(np.float32), beam)
            # over exact scores, the ids that the graph ranks first; one more for the query itself
            of, place = np.nonzero(found >= 0)
            to = found[of, place]
            score = np.einsum("ij,ij->i", q[of], exact[to]) / (length[of] * unit[to])
            order = np.lexsort((id_rank[to], -score, of))
            of, to, score = of[order], to[order], score[order]
            # all points as near as the last one needed: ids decide only among the points of all shards
            last = np.minimum(np.searchsorted(of, of) + k, np.searchsorted(of, of, "right") - 1)
            keep = score >= score[last]
            return pa.RecordBatch.from_arrays([at.take(pa.array(of[keep])), names.take(pa.array(to[keep])), pa.array(score[keep])], ["query_id", "point", "score"])

        for batch in batches:
            key = list(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(1).to_pylist(), strict=True))
            begin = 0
            for end in range(1, len(key) + 1):
                if end < len(key) and key[end] == key[begin] and end - begin < QUERY_BLOCK:
                    continue
                shard, size, kind = key[begin]
                if where != (shard, size):
                    where, ids, parts, graph = (shard, size), [], [], None
                part = batch.slice(begin, end - begin)
                matrix = part.column(3).flatten().to_numpy().reshape(-1, size)
                if kind == 0:
                    ids.append(part.column(2))
                    parts.append(matrix)
                elif ids:
                    if graph is None:
                        exact = np.concatenate(parts)
                        length = np.linalg.norm(exact, axis=1)
                        names = pa.concat_arrays(ids)
                        id_rank = np.empty(len(names), np.int64)
                        id_rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                        graph = (Graph(exact / length[:, None]), names, exact, length, id_rank)
                    yield answer(part.column(2), matrix)
                begin = end

    found = table.mapInArrow(run, f"query_id {id_type}, point {id_type}, score double")
    named = found.join(members.select("point", "id"), "point").filter("id <> query_id")
    named = named.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
