"""Exact top-k search: tiles of queries and shards, partial selection per tile, tree merge of the lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import cut

K = 20
QUERY_STEP = 20
SCALE = 64.0
#: Rows of a tile: so many queries against so many candidates.
QUERY_BLOCK = 512
SHARD = 4096
#: Lists that meet in one merge.
FAN_IN = 16
#: Integer sums below this are exact in a double.
EXACT = float(1 << 53)

PACKED = "block long, rows binary, ids binary, vectors binary, dims int"
LISTS = "query long, query_id long, shard long, found array<struct<s:long,v:long>>"


def packed(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per block: row numbers, ids and floored components, zero-padded to the longest vector of the block."""
    dims = max(1, int(frame["embedding"].map(len).max()))
    matrix = np.zeros((len(frame), dims))
    for i, v in enumerate(frame["embedding"]):
        matrix[i, :len(v)] = np.floor(SCALE * np.asarray(v, dtype=np.float64))
    return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "rows": [frame["place"].to_numpy(np.int64).tobytes()],
                         "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [matrix.tobytes()], "dims": [dims]})


def best(queries: np.ndarray, query_rows: np.ndarray, shard: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """Per query of a tile its k best (score, id), higher scores first and smaller ids at ties, its own row left out."""
    if queries.size and shard.size and np.abs(queries).sum(1).max() * np.abs(shard).max() < EXACT:
        scores = (queries @ shard.T).astype(np.int64)
    else:  # components so large that doubles would round
        whole = np.frompyfunc(int, 1, 1)
        scores = (whole(queries) @ whole(shard).T).astype(np.int64)  # OverflowError beyond a long
    out = []
    for row, own in zip(scores, query_rows):
        place = np.flatnonzero(rows != own)
        kept = row[place]
        if len(kept) > k:
            least = np.partition(kept, len(kept) - k)[len(kept) - k]
            above, ties = np.flatnonzero(kept > least), np.flatnonzero(kept == least)
            ties = ties[np.argsort(ids[place[ties]], kind="stable")][:k - len(above)]
            pick = np.concatenate([above, ties])
        else:
            pick = np.arange(len(kept))
        found = place[pick]
        order = np.lexsort((ids[found], -row[found]))
        out.append([(int(row[j]), int(ids[j])) for j in found[order]])
    return out


def tile_lists(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples():
                dims = max(t.q_dims, t.c_dims)
                q, c = _matrix(t.q_vectors, t.q_dims, dims, len(t.q_ids) // 8), _matrix(t.c_vectors, t.c_dims, dims, len(t.c_ids) // 8)
                query_rows, query_ids, rows, ids = (np.frombuffer(x, np.int64) for x in (t.q_rows, t.q_ids, t.c_rows, t.c_ids))
                lists = best(q, query_rows, c, rows, ids, k)
                yield pd.DataFrame({"query": query_rows, "query_id": query_ids, "shard": t.c_block,
                                    "found": [[{"s": s, "v": v} for s, v in one] for one in lists]})
    return run


def _matrix(raw: bytes, own: int, dims: int, rows: int) -> np.ndarray:
    out = np.zeros((rows, dims))
    out[:, :own] = np.frombuffer(raw, np.float64).reshape(rows, own)
    return out


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """Per query its k highest integer inner products over all other vectors: query_id, rank, vec_id, score.

    Components count as floor(64 * x). Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part. A shorter vector counts as padded with zeros, an empty one as all zeros. Ties go to the
    smaller id. Every row is a vector of its own: rows that repeat an id, equal or not, are each a query with a list
    of its own and a candidate for all rows but itself. Fewer candidates than k are all returned; no queries give no
    rows. A score beyond a long is an error (OverflowError). Other columns are not read.

    Both sides are packed into blocks; a tile joins one query block with one shard, so tasks hold a bounded product and
    nothing is broadcast. The lists of a query merge in rounds of ``FAN_IN``.
    """
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = cut(whole.withColumn("place", F.monotonically_increasing_id()))
    shards = cut(_blocks(whole, SHARD))
    queries = cut(_blocks(whole.where(is_query), QUERY_BLOCK))
    counts = [df.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0] for df in (queries, shards)]
    left, right = (
        df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "rows", "ids", "vectors", "dims")],
                  F.explode(F.sequence(F.lit(1), F.lit(max(1, n)).cast("bigint"))).alias(f"{other}_block"))
        .withColumn(f"{other}_block", F.col(f"{other}_block") - 1)
        for df, side, other, n in ((queries, "q", "c", counts[1]), (shards, "c", "q", counts[0])))
    lists = left.join(right, ["q_block", "c_block"]).mapInPandas(tile_lists(k), LISTS)
    lists = cut(lists)
    top = lists.agg(F.max("shard")).first()[0]
    while top:
        top //= FAN_IN
        lists = lists.groupBy("query", "query_id", F.expr(f"shard div {FAN_IN}").alias("shard")).agg(F.flatten(F.collect_list("found")).alias("found"))
        lists = lists.withColumn("found", F.slice(F.array_sort("found", _better), 1, k))
    ranked = lists.select("query_id", F.posexplode("found").alias("at", "f"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.v").alias("vec_id"), F.col("f.s").alias("score"))


def _better(a, b):
    return (F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of about ``size``; a hash of the row's place deals them, so no key of the data does."""
    blocks = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks))).groupBy("block").applyInPandas(packed, PACKED)


def report(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % QUERY_STEP == 0)


def sql() -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 OR len(c.e) = 0 THEN 0 ELSE CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
