"""Many questions at once: blocks of queries against parts of their project's vectors, exact, with filters inside.

A project's vectors are dealt to parts, its queries to blocks, both of bounded size; a part and a block meet in one task, as two
matrices and one product. Each part gives k rows for a query at most, of which the best k stay. Vectors of projects without a query don't
move. Scores are compared to nine decimals (products of matrices round differently from one to the next), ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, PART, DECIMALS = 1024, 16_384, 9


def _unit(rows: list, width: int) -> np.ndarray:
    """Vectors of one width, of length one; others, null, empty or of length zero, are zeros: their cosine is 0."""
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        if v is not None and len(v) == width and None not in v:
            out[i] = v
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = -1.0, project: str = "project_id", key: str = "vec_id", document: str = "document_id", vector: str = "embedding", block: int = BLOCK, part: int = PART) -> DataFrame:
    """vectors (project, key, document, vector), queries (project, query_id, query, documents: an array of documents to search, null for all):
    project, query_id, rank, key, score of each query's k nearest vectors by cosine, at least the threshold."""
    v = vectors.where(F.col(project).isNotNull()).select(F.col(project).alias("_p"), F.col(key).cast("long").alias("id"), F.col(document).cast("string").alias("of"), F.col(vector).cast("array<double>").alias("v"))
    q = queries.where(F.col(project).isNotNull()).select(F.col(project).alias("_p"), F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("v"), F.col("documents").cast("array<string>").alias("documents"))
    blocks = q.groupBy("_p").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    parts = v.join(blocks.select("_p"), "_p", "left_semi").groupBy("_p").agg(F.ceil(F.count("*") / part).cast("int").alias("_parts"))
    sizes = blocks.join(parts, "_p")
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = v.join(sizes, "_p").select("_p", spread("id", "_parts").alias("_part"), every("_blocks").alias("_block"), "id", "of", "v")
    right = q.join(sizes, "_p").select("_p", spread("query_id", "_blocks").alias("_block"), every("_parts").alias("_part"), "query_id", "v", "documents")
    kind = vectors.schema[project].dataType

    def cell(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if candidates.num_rows and asked.num_rows:
            ids, of = candidates["id"].to_numpy(), np.array(candidates["of"].to_pylist(), object)
            rows, said = candidates["v"].to_pylist(), asked["v"].to_pylist()
            for width in sorted({len(x or []) for x in said}):  # vectors of other widths have a cosine of 0
                mine = [i for i, x in enumerate(said) if len(x or []) == width]
                scores = np.round(_unit([said[i] for i in mine], width) @ _unit(rows, width).T, DECIMALS) + 0.0
                for i, line in zip(mine, scores):
                    ok = line >= threshold
                    wanted = asked["documents"][i].as_py()
                    if wanted is not None:
                        ok &= np.isin(of, wanted)
                    at = np.flatnonzero(ok)
                    top = at[np.lexsort((ids[at], -line[at]))][:k]
                    found += [(asked["query_id"][i].as_py(), int(ids[j]), float(line[j])) for j in top]
        name = (candidates if candidates.num_rows else asked)["_p"][0].as_py()
        return pa.table({"_p": pa.array([name] * len(found), candidates.schema.field("_p").type), "query_id": pa.array([f[0] for f in found], pa.int64()), "id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    keys = ["_p", "_part", "_block"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, f"_p {kind.simpleString()}, query_id long, id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("_p", "query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("_p").alias(project), "query_id", "rank", F.col("id").alias(key), "score")
