"""SimHash near-copies: 64-bit fingerprints of word shingles, linked at a few differing bits, grouped by reachability.

The bits are cut into `blocks` blocks. At most `radius` of them hold a difference between two near fingerprints, so at
least blocks - radius blocks agree. Each choice of that many blocks is a table; fingerprints with the same bits there form a bucket and are compared by bit slices:
bit planes lie vertically, 64 fingerprints to a word; carry-save counters add up a query's differing planes for 64
fingerprints at once; a block of lanes is given up once all its counters are above the radius.

Only distinct fingerprints are compared, each standing for the least id that has it. Buckets that are compared together give as many
links as join their groups, not all pairs. A bucket above `tile` fingerprints is cut into tiles, and each pair of tiles is a task's work.

A null or empty text has no words: fingerprint zero, linked like any other. A text with fewer words than a shingle is one
shingle. Repeated rows share a fingerprint, an empty table gives an empty one. Texts are read whole, whatever their length.
Rows of one id with different texts each keep their own fingerprint and share the id's group. Extra columns are dropped.

Three bits of 64 are far less than what parts texts of similarity 0.8. For those (`wide_links`, the pipeline's near copies) a
fingerprint has WORDS words of 64 bits, in blocks of 32. A bit whose count is far from half the shingles is the same in a near
copy, so a block's key is its bit of greatest margin, and the block with two others is a table. The buckets' texts are compared by
bit slices of the first COMPARED words. The first FIRST tables go before the others: texts that they join are one id in the others, which
link only what is apart yet, so that a text of a large group is not linked anew in each table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import parts, parts_for, scratch, small_batches, stored
from parchment.llm.components import components

SEED, SHINGLE, RADIUS, BLOCKS, TILE = 42, 3, 3, 5, 4096
#: Buckets up to this size are compared together, pair by pair in lanes.
SMALL = 12
#: Of wide fingerprints: words, bits in a block, the blocks that a table takes (counted on from each block in turn), words that are
#: compared, how many of their bits may differ, and buckets compared pair by pair. At similarity 0.8 a bit differs with probability
#: 0.15, a block's key is the same with 0.47, and no table has both texts with 3e-5; of 5 shingles against 4 of them 0.19 of the bits.
WORDS, BLOCK, CHOICE, COMPARED, WIDE_RADIUS, WIDE_SMALL = 64, 32, (0, 1, 3), 2, 42, 256
#: Tables whose links are grouped before the other tables are compared.
FIRST = 8
#: Columns of the words that are compared.
WIDE = [f"w{i}" for i in range(COMPARED)]
#: One of so many texts is counted to find buckets above `tile`; a wrong guess only deals the work in another way.
GUESS = 64
#: Rows and pairs that are compared together.
ROWS, PAIRS = 1 << 14, 1 << 16
#: Planes that are added between two looks at which blocks are left.
STRIDE = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A bit is 1 if over half the shingles' hashes have it."""
    import xxhash

    digest, found, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = (text or "").encode().lower().split()  # of bytes: A-Z only, ASCII white space only
        if not words:
            sizes.append(0)
            continue
        line = b" ".join(words)
        n = max(1, len(words) - shingle + 1)
        if n == 1:
            hashes = np.array([digest(line, seed)], np.uint64)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[: n - 1]]).tolist()
            hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, n)
        found.append(hashes)
        sizes.append(n)
    out, sizes = np.zeros(len(texts), np.uint64), np.array(sizes, np.int64)
    if not found:
        return out
    some, hashes = np.flatnonzero(sizes), np.concatenate(found)
    out[some] = _bits(counters(hashes, *_runs(sizes[some])) * 2 > sizes[some][:, None])
    return out


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of up to 255 of a text's hashes start, and each text's first run. No text is without hashes."""
    firsts = np.cumsum(sizes) - sizes
    cuts = np.concatenate([np.arange(a, a + n, 255) for a, n in zip(firsts, sizes)])
    return cuts, np.searchsorted(cuts, firsts)


def counters(hashes: np.ndarray, cuts: np.ndarray, of_doc: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each of the 64 bits."""
    out = np.empty((len(of_doc), 8, 8), np.int64)
    # bytes of a word count up to 255 hashes, for eight bits at a time
    for j in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(j) & np.uint64(0x0101010101010101), cuts)
        out[:, :, j] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of_doc, axis=0)
    return out.reshape(-1, 64)


def _bits(on: np.ndarray) -> np.ndarray:
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]


def planes_of(values: np.ndarray) -> np.ndarray:
    """Row b: bit b of each value, a word or a row of words, 64 values to a word; the last word is filled with zeros."""
    rows = values[:, None] if values.ndim == 1 else values
    padded = np.zeros((-(-len(rows) // 64) * 64, rows.shape[1]), np.uint64)
    padded[: len(rows)] = rows
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)


def within(plane: Callable[[int, np.ndarray], np.ndarray], n: int, radius: int, planes: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of at most `radius` set planes. plane(b, blocks): plane b's words of these blocks, of n in all.

    Returns the blocks that were not given up, and a word of lanes for each. Counters start so that they run over when
    they pass the radius.
    """
    blocks, bits = np.arange(n), max(1, radius.bit_length())
    start = (1 << bits) - 1 - radius
    counters = [np.full(n, ALL if start >> i & 1 else np.uint64(0)) for i in range(bits)]
    over = np.zeros(n, np.uint64)
    for b in range(planes):
        carry = plane(b, blocks)
        for c in counters:
            c ^= carry
            carry = carry & ~c  # a sum bit of 0 where one was added: it ran over
        over |= carry
        if b % STRIDE == STRIDE - 1:
            left = over != ALL
            if not left.all():
                blocks, over, counters = blocks[left], over[left], [c[left] for c in counters]
                if not len(blocks):
                    break
    return blocks, ~over


def _lanes(blocks: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The numbers of the lanes that are set."""
    at, lane = np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return blocks[at] * 64 + lane


def small_links(fps: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of linked fingerprints in the same of many small buckets, each a run of fps."""
    last = np.repeat(first + size, size)
    place = np.concatenate([np.arange(a, a + n) for a, n in zip(first, size)]) if len(first) else np.zeros(0, np.int64)
    a, b, held, found, most = [], [], 0, [(place[:0], place[:0])], int(size.max(initial=0))
    for o in range(1, most):
        ok = place + o < last
        place, last = place[ok], last[ok]
        a.append(place)
        b.append(place + o)
        held += len(place)
        if held >= PAIRS or o == most - 1:
            x, y = np.concatenate(a), np.concatenate(b)
            planes = planes_of(fps[x] ^ fps[y])
            hit = _lanes(*within(lambda k, blocks, planes=planes: planes[k][blocks], planes.shape[1], radius, len(planes)))
            hit = hit[hit < len(x)]
            found.append((x[hit], y[hit]))
            a, b, held = [], [], 0
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def large_links(fps: np.ndarray, radius: int, queries: int = 64, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join each group of one bucket: fewer than its fingerprints. Those of equal label are joined already."""
    label = np.arange(len(fps)) if label is None else label.copy()
    if (label == label[0]).all():
        return []
    planes, m, found = planes_of(fps), len(fps), []
    width = planes.shape[1]
    for at in range(0, m, queries):
        asked = fps[at : at + queries]
        bits = np.unpackbits(asked.reshape(len(asked), -1).view(np.uint8), axis=1, bitorder="little")
        masks = np.where(bits.T, ALL, np.uint64(0))
        start = at // 64  # words before hold only earlier fingerprints, which have asked already
        w = width - start
        blocks, words = within(lambda k, x: planes[k][start + x % w] ^ masks[k][x // w], len(asked) * w, radius, len(planes))
        lanes = _lanes(blocks, words)
        q, v = at + lanes // (w * 64), start * 64 + lanes % (w * 64)
        ok = (v > q) & (v < m)
        q, v = q[ok], v[ok]
        for i in np.unique(q).tolist():
            near = v[np.searchsorted(q, i) : np.searchsorted(q, i, "right")]
            other = near[label[near] != label[i]]
            labels, one = np.unique(label[other], return_index=True)
            if len(labels):
                found += [(i, int(other[k])) for k in one]
                label[np.isin(label, labels)] = label[i]
    return found


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of ids as links of each id to the least one that it reaches: fewer than ids."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != (up := label[label])).any():
            label = up
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _link(radius: int, small: int = SMALL, together: int = 1):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, cell, words of the fingerprint, id) in order of bucket and cell: links (a, b) of ids, each to the least one
        that it reaches in the buckets compared together."""
        rest: list[np.ndarray] = []

        def links(cols: list[np.ndarray]) -> pa.RecordBatch:
            bucket, cell, *words, ids = cols
            fps = np.stack(words, axis=1).view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])]))
            size = np.diff(np.concatenate([first, [len(bucket)]]))
            few = (size > 1) & (size <= small)
            a, b = small_links(fps, first[few], size[few], radius)
            pairs = [(ids[a], ids[b])]
            for at, n in zip(first[size > small].tolist(), size[size > small].tolist()):
                if found := large_links(fps[at : at + n], radius, label=ids[at : at + n]):
                    x, y = np.array(found).T
                    pairs.append((ids[at + x], ids[at + y]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(*[np.concatenate([p[k] for p in pairs]) for k in (0, 1)])], ["a", "b"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = [np.concatenate(c) for c in zip(rest, cols)] if rest else cols
            if len(rest[0]) < together:
                continue
            cols = rest
            # the last bucket may go on in the next batch
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(same))
            rest = [c[cut:] for c in cols]
            if cut:
                yield links([c[:cut] for c in cols])
        if rest and len(rest[0]):
            yield links(rest)

    return over


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """prints (fp, id), one row for each distinct fingerprint. Returns links (a, b) of ids that join all near ones."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for nth, choice in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in choice)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(nth), F.col("fp").bitwiseAND(F.lit(mask))))
    # a hash collision of two buckets only adds comparisons
    keyed = prints.select(F.explode(F.array(*keys)).alias("bucket"), "fp", "id")
    hot = keyed.groupBy("bucket").count().where(F.col("count") > tile).select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    return _compared(keyed, hot, radius)


def _compared(keyed: DataFrame, hot: DataFrame, radius: int, small: int = SMALL, together: int = 1) -> DataFrame:
    """keyed (bucket, words of the fingerprint, id); hot (bucket, tiles): buckets that are cut. Links (a, b) of ids."""
    words = [c for c in keyed.columns if c not in ("bucket", "id")]
    cold = keyed.join(hot, "bucket", "left_anti").select("bucket", F.lit(0).cast("long").alias("cell"), *words, "id")
    own = F.pmod(F.xxhash64(*words), F.col("tiles")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(own, t).cast("long") * F.col("tiles") + F.greatest(own, t))
    warm = keyed.join(hot, "bucket").select("bucket", F.explode(cells).alias("cell"), *words, "id")
    n = parts_for(keyed.sparkSession)
    link = _link(radius, small, together)
    found = [d.repartition(n, "bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(link, "a long, b long") for d in (cold, warm)]
    return found[0].unionByName(found[1]).distinct()


def wide_prints(hashes: list[np.ndarray], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each text's hashes of distinct shingles, none without: the key of each block (2 x the place of its bit of greatest margin,
    plus that bit), and the first COMPARED words."""
    flat, sizes = np.concatenate(hashes), np.array([len(x) for x in hashes])
    runs, odd = _runs(sizes), np.random.default_rng(SEED).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys, compared = np.empty((len(sizes), words, 64 // BLOCK), np.uint8), np.empty((len(sizes), COMPARED), np.uint64)
    for w in range(words):
        turned = flat * odd[w]
        turned ^= turned >> np.uint64(32)
        margins = counters(turned, *runs) * 2 - sizes[:, None]
        if w < COMPARED:
            compared[:, w] = _bits(margins > 0)
        blocks = margins.reshape(len(sizes), -1, BLOCK)
        at = np.abs(blocks).argmax(axis=2)
        keys[:, w] = 2 * at + (np.take_along_axis(blocks, at[:, :, None], 2)[:, :, 0] > 0)
    return keys.reshape(len(sizes), -1), compared


def _dealt(tables: slice):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, keys, words): a row (bucket, words, id) for each of the tables."""
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, keys, *words = batch.slice(at, 128).columns
                of = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int64)
                bucket = np.broadcast_to(np.arange(of.shape[1]), of.shape)
                for c in CHOICE:
                    bucket = bucket * (2 * BLOCK) + np.roll(of, -c, axis=1)
                bucket = bucket[:, tables]
                rows = [np.repeat(c.to_numpy(zero_copy_only=False), bucket.shape[1]) for c in (*words, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (bucket.ravel(), *rows)], ["bucket", *WIDE, "id"])

    return over


def wide_buckets(prints: DataFrame, tables: slice = slice(None)) -> DataFrame:
    """prints (id, keys, words), as wide_prints gives them: bucket, words, id for each of the tables."""
    small_batches(prints.sparkSession)
    return prints.select("id", "keys", *WIDE).mapInArrow(_dealt(tables), f"bucket long, {', '.join(f'{w} long' for w in WIDE)}, id long")


def wide_links(prints: DataFrame, tile: int = TILE, first: int = FIRST) -> DataFrame:
    """Links (a, b) of ids that join all texts of prints, one row for each distinct text, that share a bucket and are near."""
    some = wide_buckets(prints.where(F.pmod(F.xxhash64("id"), F.lit(GUESS)) == 0))
    n = F.col("count") * GUESS
    hot = stored(some.groupBy("bucket").count().where(n > tile).select("bucket", F.ceil(n / tile).cast("int").alias("tiles")), "hot")
    link = lambda rows, tables: _compared(wide_buckets(rows, tables), hot, WIDE_RADIUS, WIDE_SMALL, ROWS)
    roots = components(link(prints, slice(first)))
    known = prints.join(roots, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("id"), "keys", *WIDE)
    return roots.toDF("a", "b").unionByName(link(known, slice(first, None)))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number) of each whole text."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in parts(batch.column(1), 2048):
                part = batch.slice(at, n)
                fps = fingerprints(part.column(1).to_pylist(), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(over, "doc_id long, fp long")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable) of each row. A null id takes no part in links."""
    with scratch():
        return stored(_grouped(docs, key, text, radius, blocks, tile), "fingerprints", keep=True)


def _grouped(docs: DataFrame, key: str, text: str, radius: int, blocks: int, tile: int) -> DataFrame:
    prints = stored(fingerprint(docs, key, text), "prints")
    distinct = stored(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    links = near_links(distinct, radius, blocks, tile)
    links = links.unionByName(_ids_of_several(prints, distinct))
    roots = components(links)
    of_print = distinct.join(roots, distinct["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    out = prints.join(of_print, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _ids_of_several(prints: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links between the prints of an id that has rows with different texts."""
    several = prints.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y").select("doc_id")
    return prints.join(several, "doc_id").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
