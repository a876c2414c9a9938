"""Exact repeated passages: fixed blocks of each document are indexed, every rolling window of a block's length probes
them, and hits are extended to all windows around them, whose repeats merge to maximal passages.

A window is `window` consecutive words of one document. A word goes if it lies in a window whose words also start earlier:
in a document of smaller id, or earlier in the same document. A window of 20 words holds a whole block of 10 that starts
at a multiple of 10; so does its earlier twin, and the block's words occur in both. The hashes of blocks and probes meet
by value; a value that a block has and that occurs twice is a hit. Only windows that hold a hit are hashed, to 128 bits
from two hashes of each word, and meet by value too; the least id and start that a window has is its first place. Words
themselves are not compared across chunks: 10^13 windows hold a pair of equal hashes and different words with probability
10^-13.

Documents are dealt to chunks by a hash of their id and text; a chunk is some megabytes of text. It sends each distinct value
once, however often it holds it, sorted and packed, to one of the value ranges ("buckets"), and gets back one bit for each
value. So a passage that a third of all documents share is one value for each chunk, no pair of documents is ever made,
and what moves is about five bytes for each word. The same exchange of texts serves all three passes.

Null texts have no words, texts shorter than a window keep all, an empty table gives an empty one. A null id stands after
all others. Rows of one id are one document, wherever they are dealt: windows that start at the same word in both don't
remove each other, so repeated rows come out alike. Extra columns are kept, those with an output's name replaced. A text is
taken whole, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import apart, release, small_batches

WINDOW = 20
#: Text in a chunk, and text whose words' values make up a bucket.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
#: Bits of a block's value beside those that name its bucket; two more are flags.
BLOCK_BITS = 38
CACHE_WORDS = 100_000
NO_ID = np.iinfo(np.int64).max


class _WordHashes(dict):
    """64-bit hashes of words; full, it takes no more."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) < CACHE_WORDS:  # frequent words come early
            self[word] = value
        return value


_HASHES, _OTHER = _WordHashes(0), _WordHashes(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def rolling(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """The hash of each run of `size` values: their sum by powers of an odd base, doubled up from runs of powers of two."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, width = None, 0, values, 1
    power = lambda k: np.uint64(pow(base, k, 1 << 64))
    while done < size:
        if size & width:
            part = run[done : done + n] * power(done)
            out = part if out is None else out + part
            done += width
        if done < size:
            run = run[:-width] + run[width:] * power(width)
            width *= 2
    return _mixed(out)


class Chunk:
    """The words of a chunk's documents and the places of its windows."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, window: int):
        release(trim=False)  # of the chunk before; what is given back to the system has to be asked for again for each chunk
        self.window, self.block = window, window // 2
        self.words = [(t or "").encode().split() for t in texts.to_pylist()]
        self.ids = np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64)
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        total = int(self.ends[-1]) if len(self.ends) else 0
        look = _HASHES.__getitem__
        parts = [np.fromiter(map(look, w), np.uint64, len(w)) for w in self.words]
        self.values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(total) - self.starts[self.doc] if total else np.zeros(0, np.int64)

    def _fits(self, size: int, longest: int) -> np.ndarray:
        """Places where a run of `size` words starts, in documents of `longest` words at least."""
        m = max(0, len(self.values) - size + 1)
        left = self.n[self.doc[:m]] - self.place[:m]
        return np.flatnonzero((left >= size) & (self.n[self.doc[:m]] >= longest))

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all probes, their values (the leading bits of a hash), and which of them are index blocks."""
        at = self._fits(self.block, self.window)
        values = rolling(self.values, self.block, 0x9E3779B97F4A7C15)[at] >> np.uint64(64 - bits)
        return at, values, self.place[at] % self.block == 0

    def _others(self, docs: np.ndarray) -> np.ndarray:
        """Second hashes of the words of these documents."""
        out, look = np.zeros(len(self.values), np.uint64), _OTHER.__getitem__
        for d in np.unique(docs).tolist():
            out[self.starts[d] : self.ends[d]] = np.fromiter(map(look, self.words[d]), np.uint64, len(self.words[d]))
        return out

    def windows(self, hit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows that hold a probe of those places, ordered by value and first place: place, both hashes, id, group's number."""
        at = self._fits(self.window, self.window)
        mark = np.zeros(len(self.values) + 1, np.int64)
        mark[hit + 1] = 1
        upto = np.cumsum(mark)
        at = at[upto[at + self.window - self.block + 1] > upto[at]]
        a = rolling(self.values, self.window, 0x9E3779B97F4A7C15)[at]
        b = rolling(self._others(self.doc[at]), self.window, 0xD6E8FEB86659FD93)[at]
        ids, place = self.ids[self.doc[at]], self.place[at]
        order = np.lexsort((place, ids, b, a))
        at, a, b, ids = at[order], a[order], b[order], ids[order]
        new = np.ones(len(at), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return at, a, b, ids, new


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned or signed 64-bit numbers, each byte of all numbers together: sorted numbers share the high ones."""
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def _bucket_edges(values: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return np.searchsorted(values >> np.uint64(shift), np.arange((1 << bits) + 1, dtype=np.uint64))


_SENT = "bucket int, chunk int, kind int, data binary"
_FORM = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
PROBES, HITS, WINDOWS, LATER = range(4)


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FORM)], schema=_FORM)


def _distinct_probes(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, which distinct value each has, the distinct values sorted, how many there are of each, which are blocks."""
    at, values, indexed = chunk.probes(bits + BLOCK_BITS)
    distinct, which, counts = np.unique(values, return_inverse=True, return_counts=True)
    block = np.zeros(len(distinct), bool)
    block[which[indexed]] = True
    return at, which, distinct, counts, block


def _bits_of(got: pa.Table, kind: int, n: int, edges: np.ndarray | None) -> np.ndarray:
    """The bits that came back for n values, put together by bucket."""
    out = np.zeros(n, bool)
    rows = [(b, d) for b, k, d in zip(got["bucket"].to_pylist(), got["kind"].to_pylist(), got["data"].to_pylist()) if k == kind]
    for bucket, data in rows:
        a, z = (0, n) if edges is None else edges[bucket : bucket + 2]
        out[a:z] = np.unpackbits(np.frombuffer(data, np.uint8), count=z - a)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds n_words, n_removed, removed (spans of words: start from 0, length) and kept_text (kept words, joined by one space)."""
    if window < 2 or window % 2:
        raise ValueError("a window is an even number of words")
    outputs = {"n_words": T.LongType(), "n_removed": T.LongType(), "removed": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])), "kept_text": T.StringType()}
    keep = apart(docs, outputs)[0]
    kept_names = [c for c in docs.columns if c.lower() not in outputs]
    small_batches(docs.sparkSession)
    # Arrow stages take no names with dots or backticks
    rows = docs.select(*keep).toDF(*[f"c{i}" for i in range(len(keep))])
    key, text = (f"c{kept_names.index(c)}" for c in (key, text))
    dealt = "chunk"
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, bits = max(1, math.ceil(size / chunk_bytes)), math.ceil(math.log2(max(2, size / bucket_bytes)))
    held = rows.withColumn(dealt, F.pmod(F.xxhash64(key, text), F.lit(chunks)).cast("int"))
    fields, names = rows.schema.fields, rows.columns

    def send_probes(table: pa.Table) -> pa.Table:
        chunk = Chunk(table[key], table[text], window)
        _, _, values, counts, block = _distinct_probes(chunk, bits)
        edges = _bucket_edges(values, BLOCK_BITS, bits)
        sent = (values & np.uint64((1 << BLOCK_BITS) - 1)) << np.uint64(2) | (counts > 1).astype(np.uint64) << np.uint64(1) | block.astype(np.uint64)
        nth = table[dealt][0].as_py()
        return _table([(i, nth, PROBES, _packed(sent[a:z], 5)) for i, (a, z) in enumerate(zip(edges, edges[1:])) if z > a])

    def find_hits(table: pa.Table) -> pa.Table:
        parts = [_unpacked(d, 5) for d in table["data"].to_pylist()]
        sent = np.concatenate(parts)
        values, which, counts = np.unique(sent >> np.uint64(2), return_inverse=True, return_counts=True)
        twice, block = counts > 1, np.zeros(len(values), bool)
        twice[which[(sent & np.uint64(2)) > 0]] = True
        block[which[(sent & np.uint64(1)) > 0]] = True
        hit = (twice & block)[which]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        bucket = table["bucket"][0].as_py()
        return _table([(bucket, c, HITS, np.packbits(h).tobytes()) for c, h in zip(table["chunk"].to_pylist(), np.split(hit, cuts))])

    def hit_places(chunk: Chunk, got: pa.Table, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        at, which, values, _, _ = _distinct_probes(chunk, bits)
        hit = _bits_of(got, HITS, len(values), None if whole else _bucket_edges(values, BLOCK_BITS, bits))
        return at[hit[which]] if len(at) else at, hit

    def send_windows(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        chunk, nth = Chunk(table[key], table[text], window), table[dealt][0].as_py()
        places, hit = hit_places(chunk, got, False)
        at, a, b, ids, new = chunk.windows(places)
        a, b, ids, place = a[new], b[new], ids[new], chunk.place[at[new]]  # the first of each group has its least id and start
        edges = _bucket_edges(a, 64 - bits, bits)
        rows = [(i, nth, WINDOWS, b"".join(_packed(v[x:z], 8) for v in (a, b, ids, place))) for i, (x, z) in enumerate(zip(edges, edges[1:])) if z > x]
        return _table([*rows, (nth % (1 << bits), nth, HITS, np.packbits(hit).tobytes())])  # the chunk's own, for the last pass

    def find_first(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        rows = list(zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist()))
        own = [(bucket, c, HITS, d) for c, k, d in rows if k == HITS]
        asked = [(c, d, len(d) // 32) for c, k, d in rows if k == WINDOWS]
        if not asked:
            return _table(own)
        a, b, ids, place = (np.concatenate([_unpacked(d[8 * i * n : 8 * (i + 1) * n], 8) for _, d, n in asked]) for i in range(4))
        ids = ids.view(np.int64)
        order = np.lexsort((place, ids, b, a))
        a, b, ids, place = a[order], b[order], ids[order], place[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.zeros(len(a), bool)
        later[order] = (ids != ids[first]) | (place != place[first])
        cuts = np.cumsum([n for _, _, n in asked])[:-1]
        return _table([*own, *[(bucket, c, LATER, np.packbits(x).tobytes()) for (c, _, _), x in zip(asked, np.split(later, cuts))]])

    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in outputs.items()]])

    def remove(table: pa.Table, got: pa.Table) -> Iterator[pa.Table] | pa.Table:
        chunk = Chunk(table[key], table[text], window)
        places, _ = hit_places(chunk, got, True)
        at, a, _, _, new = chunk.windows(places)
        first = np.flatnonzero(new)
        later = _bits_of(got, LATER, len(first), _bucket_edges(a[first], 64 - bits, bits))
        group = np.cumsum(new) - 1
        # its group's first here, or the same start in a row of the same id
        home = at[first][group] if len(at) else at
        same = (chunk.ids[chunk.doc[at]] == chunk.ids[chunk.doc[home]]) & (chunk.place[at] == chunk.place[home])
        gone = at[later[group] | ~same] if len(at) else at
        mark = np.zeros(len(chunk.values) + 1, np.int64)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + window, -1)
        covered = np.cumsum(mark)[:-1] > 0
        removed, spans, kept = [], [], []
        for words, x, z in zip(chunk.words, chunk.starts.tolist(), chunk.ends.tolist()):
            c = covered[x:z]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
            spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(turns[::2], turns[1::2])])
            removed.append(int(c.sum()))
            kept.append(b" ".join(words if not len(turns) else [w for w, k in zip(words, c.tolist()) if not k]).decode())
        arrays = [pa.array(chunk.n), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.string())]
        out = table.select(names)
        for (name, _), array in zip(outputs.items(), arrays):
            out = out.append_column(name, array)
        return out

    by_chunk = held.groupBy(dealt)
    hits = by_chunk.applyInArrow(send_probes, _SENT).groupBy("bucket").applyInArrow(find_hits, _SENT)
    asked = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, _SENT)
    answers = asked.groupBy("bucket").applyInArrow(find_first, _SENT)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(remove, schema).toDF(*kept_names, *outputs)
