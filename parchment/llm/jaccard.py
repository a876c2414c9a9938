"""Near copies by SimHash, decided by the Jaccard similarity of word shingles.

Wide fingerprints of each text's distinct shingles give candidates (`simhash.wide_links`: buckets of equal keys, compared by bit
slices); nothing else does. Two texts of similarity 0.8 are missed with probability 3e-5, of 0.85 with less than 1e-6. Candidates that
hang together are a group, so that each text goes to its group once, not once for each bucket. A group of more than `wide` texts
falls apart into its buckets again, and each text goes to each of its buckets, 128 at most: beyond that, its tiles would be more. A
group above `tile` texts is cut into tiles, and each tile, then each pair of tiles, is a task's work: only texts whose fingerprints are
near and whose sizes allow it are compared, similarities are exact, pairs that are joined already are skipped, those that the tiles
joined too, and no more links than join the texts come out.

Texts of equal words are one text. A text with fewer words than a shingle is one shingle. Null and empty texts are equal.
Rows of one id with different texts share a group. Texts are read whole, whatever their length; an empty table gives none.
Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm import simhash
from parchment.llm.common import among, parts_for, release, scratch, small_batches, stored
from parchment.llm.components import components

SEED, SHINGLE, TILE, WIDE = 42, 5, 512, 1 << 16
#: Least similarity in tenths.
TENTHS = 8
#: Shingles whose fingerprints are made together.
TOGETHER = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> tuple[bytes, list[int]]:
    """The words in a row, and the hashes of their shingles."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    line = b" ".join(words)
    if not words:
        return line, []
    if len(words) <= shingle:
        return line, [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    return line, [xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]


def _distinct(hashes: list[int]) -> np.ndarray:
    return np.unique(np.fromiter(hashes, np.uint64, len(hashes)))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def done(ids: list[int], whole: list[bytes], hashes: list[np.ndarray]) -> pa.RecordBatch:
        some = [i for i, x in enumerate(hashes) if len(x)]
        keys: list = [None] * len(ids)
        words = np.zeros((len(ids), simhash.COMPARED), np.uint64)
        if some:
            found, words[some] = simhash.wide_prints([hashes[i] for i in some])
            for i, row in zip(some, found):
                keys[i] = row.tobytes()
        compared = [pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(simhash.COMPARED)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(whole, pa.binary()), pa.array(keys, pa.binary()), *compared], ["doc_id", "words", "keys", *simhash.WIDE])

    for batch in batches:
        ids, whole, hashes, n = [], [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            line, found = shingle_hashes(text)
            ids.append(i)
            whole.append(xxhash.xxh3_128_digest(line))
            hashes.append(_distinct(found))
            n += len(found)
            if n >= TOGETHER:
                yield done(ids, whole, hashes)
                ids, whole, hashes, n = [], [], [], 0
        if ids:
            yield done(ids, whole, hashes)
        release()


def joined(sets: list[set[int]], tile: list[int], words: np.ndarray, ids: list[int]) -> list[tuple[int, int]]:
    """Links (i, j) that join all similar sets of one tile, or those of two tiles across. words: of each set's fingerprint; sets
    whose fingerprints are not near are not compared. Sets of one id are joined already."""
    size, label, of = np.array([len(s) for s in sets]), np.unique(ids, return_inverse=True)[1], np.array(tile)
    one, found = len({*tile}) == 1, []
    for i in range(1, len(sets)):
        n = size[i]
        able = (label[:i] != label[i]) & (size[:i] * 10 >= n * TENTHS) & (size[:i] * TENTHS <= n * 10)
        if not one:
            able &= of[:i] != of[i]
        near = np.flatnonzero(able)
        near = near[np.bitwise_count(words[near] ^ words[i]).sum(axis=1) <= simhash.WIDE_RADIUS]
        for j in near.tolist():
            if label[j] == label[i]:
                continue
            both = len(sets[i] & sets[j])
            if both * (10 + TENTHS) >= TENTHS * (len(sets[i]) + len(sets[j])):
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, cell, tile, id, text) in order of group and cell: links (a, b) of ids."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        some = [i for i, r in enumerate(rows) if r[2]]
        words = np.zeros((len(rows), simhash.COMPARED), np.uint64)
        for at in range(0, len(some), 64):
            few = some[at : at + 64]
            words[few] = simhash.wide_prints([_distinct([*rows[i][2]]) for i in few], simhash.COMPARED)[1]
        found = joined([r[2] for r in rows], [r[0] for r in rows], words, [r[1] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array([rows[p[k]][1] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    now, rows = None, []
    for batch in batches:
        for group, cell, tile, i, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (group, cell) != now and rows:
                yield links(rows)
                rows = []
            now = group, cell
            rows.append((tile, i, set(shingle_hashes(text)[1])))
    if rows:
        yield links(rows)
    rows = []
    release()


def near_links(prints: DataFrame, texts: DataFrame, tile: int = TILE, wide: int = WIDE) -> DataFrame:
    """prints (id, keys, words), one row for each distinct text; texts (id, text). Returns links (a, b) that join all near ones."""
    roots = stored(components(simhash.wide_links(prints)), "candidates")
    members = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    texts = among(texts, "id", members.select("node"))
    sizes = stored(members.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    in_groups = members.join(sizes.where(F.col("n") <= wide), "root").select(F.col("root").alias("group"), "node", "n")
    # of groups that are too wide: each text in each of its buckets
    apart_ = members.join(sizes.where(F.col("n") > wide), "root").select("node")
    by_bucket = simhash.wide_buckets(prints.join(apart_, F.col("id") == F.col("node"), "left_semi")).select(F.col("bucket").alias("group"), F.col("id").alias("node")).distinct()
    in_buckets = by_bucket.join(by_bucket.groupBy("group").agg(F.count("*").alias("n")), "group").select("group", "node", "n")
    tiles = F.ceil((F.col("n") + 1) / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    placed = stored(in_groups.unionByName(in_buckets).where("n > 1").withColumn("tiles", tiles).withColumn("tile", own), "placed")
    cell = lambda t: F.least(F.col("tile"), t).cast("long") * F.col("tiles") + F.greatest(F.col("tile"), t)

    def links(rows: DataFrame, cells: Column) -> DataFrame:
        """rows: placed, and an id that what is joined already has in common."""
        dealt = rows.join(texts.withColumnRenamed("id", "of"), F.col("node") == F.col("of")).select("group", F.explode(cells).alias("cell"), "tile", "id", "text")
        return dealt.repartition(parts_for(prints.sparkSession), "group", "cell").sortWithinPartitions("group", "cell").mapInArrow(_link, "a long, b long")

    inside = components(links(placed.withColumn("id", F.col("node")), F.array(cell(F.col("tile"))))).toDF("a", "b")
    across = placed.where("tiles > 1").join(inside, F.col("node") == F.col("a"), "left").withColumn("id", F.coalesce("b", "node"))
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("tile"))
    return inside.unionByName(links(across, F.transform(others, cell)))


def copies(docs: DataFrame, tile: int = TILE, wide: int = WIDE) -> DataFrame:
    """node, root: each doc_id that has a near copy of lesser id, and the least id that near copies reach. Null ids take no part."""
    with scratch():
        return stored(_roots(docs, tile, wide), "roots", keep=True)


def _roots(docs: DataFrame, tile: int, wide: int) -> DataFrame:
    small_batches(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    columns = ", ".join(f"{w} long" for w in simhash.WIDE)
    prints = stored(texts.mapInArrow(_prints, f"doc_id long, words binary, keys binary, {columns}"), "prints")
    least = F.min(F.struct("doc_id", "keys", *simhash.WIDE)).alias("least")
    distinct = stored(prints.groupBy("words").agg(least).select("words", F.col("least.doc_id").alias("id"), *[F.col(f"least.{c}").alias(c) for c in ("keys", *simhash.WIDE)]), "distinct")
    same = prints.select("doc_id", "words").join(distinct.select("words", "id"), "words").where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    return components(near_links(distinct.where("keys IS NOT NULL").drop("words"), texts, tile, wide).unionByName(same))
