"""Evaluation passages inside training texts, by suffix arrays.

The training texts are cut into shards; each shard gets a word-level suffix array (ranks doubled until suffixes are ordered by
their first ``words`` words), and every suffix of the evaluation items is binary-searched in it. Hits are joined along their
diagonal to the longest verbatim runs of words, with their places in both texts (:func:`leak_places`), a bounded number at a time, so passages that
stand everywhere in a shard cost no memory. The evaluation set is sent to the executors in blocks of bounded size, one after the other. If there are several,
the shards' arrays are written to the shared folder first and every block is searched in them; they are sorted once. The training texts are never shuffled.

Words are maximal runs of letters and digits, without regard to case; a word is a 64-bit hash of its letters.

Defined results:
* null, empty and too short texts and items have no matches; equal rows give equal matches;
* a text of any length is searched whole: long ones in stretches that overlap by ``words - 1`` words;
* repeated passages count at every place; :func:`leaks` gives one row for each pair of a row and an item, with the longest run;
* a run over the border of two stretches of a very long text comes out as two runs that overlap;
* an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import staged

SHARD_WORDS = 600_000
CHUNK_CHARS = 3_000_000
HITS = 4_000_000  # hits that are joined at a time
BLOCK_BYTES = 32 << 20  # of evaluation text that goes to the executors at once
MULT = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _letters() -> np.ndarray:
    """A 64-bit value for each code point, equal for both cases; 0 for what is no letter or digit."""
    fold = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            fold[i] = ord(c.lower()[0]) + 1
    return np.where(fold > 0, _mix(fold * np.uint64(MULT)) | np.uint64(1), np.uint64(0))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = 0x5851F42D4C957F2D
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, r, np.uint64))
        down = np.cumprod(np.full(n, pow(r, -1, 1 << 64), np.uint64))
    return up, down


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of a text of at most about CHUNK_CHARS characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    f = _letters()[codes]
    is_word = np.concatenate([[False], f != 0, [False]])
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _powers(1 << (len(f) - 1).bit_length())
    f *= up[: len(f)]
    np.cumsum(f, out=f)
    total = f[ends - 1]
    total[1:] -= f[starts[1:] - 1]
    if starts[0]:
        total[0] -= f[starts[0] - 1]
    h = _mix(total * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(MULT))
    return np.maximum(h, np.uint64(1)), starts  # 0 is the mark between texts


def _chunks(text: str) -> Iterator[str]:
    """Pieces of a long text, cut where no word is cut."""
    at = 0
    while at < len(text):
        to = min(at + CHUNK_CHARS, len(text))
        while to < len(text) and text[to].isalnum() and text[to - 1].isalnum():
            to += 1
        yield text[at:to]
        at = to


def words_of_all(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its word hashes) for each text."""
    batch, held = [], 0

    def flush():
        h, starts = words_of("\n".join(texts[i] for i in batch))
        ends = np.cumsum([len(texts[i]) + 1 for i in batch])
        for i, part in zip(batch, np.split(h, np.searchsorted(starts, ends[:-1])), strict=True):
            yield i, part

    for i, t in enumerate(texts):
        if len(t) > CHUNK_CHARS:
            yield i, np.concatenate([words_of(c)[0] for c in _chunks(t)])
            continue
        if held + len(t) > CHUNK_CHARS and batch:
            yield from flush()
            batch, held = [], 0
        batch.append(i)
        held += len(t) + 1
    if batch:
        yield from flush()


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by the first ``depth`` symbols from them; symbols are dense ranks, below the array's length."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    bits = max(1, int(rank.max()).bit_length() if n else 1)
    width = max(1, min(depth, 62 // bits))
    shift = lambda r, k: np.concatenate([r[k:], np.zeros(min(k, n), np.int64)])[:n]
    key = rank.copy()
    for k in range(1, width):
        key = key << bits | shift(rank, k)
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) + 1
        step = min(width, depth - width)
        key = new * (n + 2) + shift(new, step)
        width += step


def search(symbols: np.ndarray, order: np.ndarray, query: np.ndarray, right: bool) -> np.ndarray:
    """Where each query row (of ``depth`` symbols) belongs among the ordered suffixes: first place, or the place after the last."""
    n, depth = len(symbols), query.shape[1]
    lo, hi = np.zeros(len(query), int), np.full(len(query), n)
    padded = np.concatenate([symbols, np.zeros(depth, symbols.dtype)])
    while (open_ := lo < hi).any():
        q = np.flatnonzero(open_)
        mid = (lo[q] + hi[q]) >> 1
        sign = np.zeros(len(q), int)
        for k in range(depth):
            left = np.flatnonzero(sign == 0)
            if not len(left):
                break
            a, b = padded[order[mid[left]] + k], query[q[left], k]
            sign[left] = (a > b).astype(int) - (a < b)
        below = sign < 0 if not right else sign <= 0
        lo[q[below]] = mid[below] + 1
        hi[q[~below]] = mid[~below]
    return lo


class Shard:
    """The words of some texts, 0 after each, as symbols of their vocabulary, and their suffix array."""

    def __init__(self, vocabulary: np.ndarray, symbols: np.ndarray, order: np.ndarray):
        self.vocabulary, self.symbols, self.order = vocabulary, symbols, order

    @classmethod
    def of(cls, words: np.ndarray, depth: int) -> Shard:
        vocabulary, symbols = np.unique(words, return_inverse=True)
        return cls(vocabulary, symbols.astype(np.int32), suffix_array(symbols, depth).astype(np.int32))

    def runs(self, item_words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the shard, place in ``item_words``, length) of the longest runs of ``depth`` words or more; items have a 0 after each."""
        none = (np.zeros(0, np.int64),) * 3
        at = np.searchsorted(self.vocabulary, item_words)
        known = np.minimum(at, len(self.vocabulary) - 1)
        query = np.where((self.vocabulary[known] == item_words) & (item_words != 0), known, -1)
        if len(query) < depth:
            return none
        grid = np.lib.stride_tricks.sliding_window_view(query, depth)
        suffix = np.flatnonzero((grid >= 0).all(1))
        if not len(suffix):
            return none
        lo, hi = search(self.symbols, self.order, grid[suffix], False), search(self.symbols, self.order, grid[suffix], True)
        some = hi > lo
        suffix, lo, n = suffix[some], lo[some], (hi - lo)[some]
        if not len(suffix):
            return none
        part, out = (np.cumsum(n) - n) // HITS, [none]
        for k in np.split(np.arange(len(suffix)), np.flatnonzero(np.diff(part)) + 1):
            t = np.repeat(suffix[k], n[k])
            p = self.order[np.repeat(lo[k] - np.r_[0, np.cumsum(n[k])[:-1]], n[k]) + np.arange(len(t))].astype(np.int64)
            out.append(_joined(p, t, np.ones(len(p), np.int64)))
        p, t, length = _joined(*(np.concatenate(x) for x in zip(*out, strict=True))) if len(out) > 2 else out[-1]
        return p, t, length + depth - 1


def _joined(p: np.ndarray, t: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that follow each other on a diagonal, as one."""
    o = np.lexsort((p, p - t))
    p, t, length = p[o], t[o], length[o]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] - t[1:] != p[:-1] - t[:-1]) | (p[1:] != p[:-1] + length[:-1])
    start = np.flatnonzero(new)
    return p[start], t[start], np.add.reduceat(length, start) if len(start) else length


def _shards(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(words, length of each stretch, its first word's place in its text, its key) of about SHARD_WORDS words at a time."""
    held, lengths, firsts, names, count = [], [], [], [], 0
    for batch in batches:
        for i, h in words_of_all(batch.column(1).to_pylist()):
            for s in range(0, len(h) - words + 1, SHARD_WORDS):
                part = h[s : s + SHARD_WORDS + words - 1]
                held += [part, np.zeros(1, np.uint64)]
                lengths.append(len(part) + 1)
                firsts.append(s)
                names.append(batch.column(0).slice(i, 1))
                count += len(part) + 1
                if count >= SHARD_WORDS:
                    yield np.concatenate(held), np.array(lengths), np.array(firsts), pa.concat_arrays(names)
                    held, lengths, firsts, names, count = [], [], [], [], 0
    if count:
        yield np.concatenate(held), np.array(lengths), np.array(firsts), pa.concat_arrays(names)


def leak_places(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, words: int = 12) -> DataFrame:
    """(doc_key, item_key, at, item_at, run): every longest run of ``words`` words or more that a text and an item share; places count words from 0."""
    if len({doc_key, item_key, "run", "at", "item_at"}) < 5:
        raise ValueError("the keys need different names, and not run, at or item_at")
    spark = docs.sparkSession
    items = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("key"), F.col(item_text).alias("text"))
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))
    numbers = [T.StructField(c, T.LongType()) for c in ("at", "item_at")]
    schema = T.StructType([T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField(item_key, items.schema["key"].dataType), *numbers, T.StructField("run", T.IntegerType())])
    source = docs.where(F.length(doc_text) > 2 * (words - 1)).select(F.col(doc_key).alias("key"), F.col(doc_text).alias("text"))

    def block_of(number: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(words, first word of each item, keys) of one block."""
        rows = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == number).collect()
        keys, stream, size = [], [], []
        for i, h in words_of_all([r["text"] for r in rows]):
            keys.append(rows[i]["key"])
            size.append(len(h) + 1)
            stream += [h, np.zeros(1, np.uint64)]
        return np.concatenate(stream) if stream else np.zeros(0, np.uint64), np.cumsum(size) - size, pa.array(keys)

    def found(shard: Shard, block, lengths: np.ndarray, firsts: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        item_words, item_first, item_keys = block
        p, t, run = shard.runs(item_words, words)
        starts = np.cumsum(lengths) - lengths
        text, item = np.searchsorted(starts, p, "right") - 1, np.searchsorted(item_first, t, "right") - 1
        for s in range(0, len(p), 65_536):
            c = slice(s, s + 65_536)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(text[c])), item_keys.take(pa.array(item[c])), pa.array((p - starts[text] + firsts[text])[c] if len(p) else p, pa.int64()), pa.array((t - item_first[item])[c] if len(p) else t, pa.int64()), pa.array(run[c], pa.int32())], names=schema.names)

    if blocks == 1:
        block = block_of(0)
        if len(block[0]) < words:
            return spark.createDataFrame([], schema)
        sent = spark.sparkContext.broadcast(block)

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, lengths, firsts, names in _shards(batches, words):
                yield from found(Shard.of(h, words), sent.value, lengths, firsts, names)

        return source.mapInArrow(once, schema)

    array = T.BinaryType()
    kept = T.StructType([*[T.StructField(c, array) for c in ("vocabulary", "symbols", "suffixes", "lengths", "firsts")], T.StructField("names", T.ArrayType(docs.schema[doc_key].dataType))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, lengths, firsts, names in _shards(batches, words):
            shard = Shard.of(h, words)
            data = [pa.array([x.tobytes()], pa.binary()) for x in (shard.vocabulary, shard.symbols, shard.order, lengths.astype(np.int64), firsts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*data, pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)], names=kept.names)

    index = staged(source.mapInArrow(build, kept), "shards")
    parts = []
    for number in range(blocks):
        block = block_of(number)
        if len(block[0]) < words:
            continue
        sent = spark.sparkContext.broadcast(block)

        def again(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda c, kind, batch=batch, i=i: np.frombuffer(batch.column(c)[i].as_py(), kind)
                    shard = Shard(get("vocabulary", np.uint64), get("symbols", np.int32), get("suffixes", np.int32))
                    yield from found(shard, sent.value, get("lengths", np.int64), get("firsts", np.int64), batch.column("names")[i].values)

        parts.append(staged(index.mapInArrow(again, schema), "leaks"))
        sent.destroy()  # the block's results are written
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, words: int = 12) -> DataFrame:
    """(doc_key, item_key, run): every text and item that share ``words`` consecutive words or more, with the longest run."""
    return leak_places(docs, items, doc_key, doc_text, item_key, item_text, words).groupBy(doc_key, item_key).agg(F.max("run").alias("run"))


def without_leaks(docs: DataFrame, found: DataFrame, doc_key: str) -> DataFrame:
    """The texts that hold no passage of an item."""
    return docs.join(found.select(doc_key).distinct(), doc_key, "left_anti")
