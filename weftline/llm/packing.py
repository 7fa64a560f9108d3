"""Filling fixed-capacity containers with whole texts.

Texts are projected, as hashed vectors of their byte 4-grams, to three dimensions, range-sorted by the Hilbert key of
that place, and packed along the curve: each container starts with the first text that has no place yet and takes, of its next neighbours on the
curve, those that fill it best (:func:`fill_one`); it looks no farther than it must to be filled to ``1 - SLACK``, and no farther than ``window`` texts. A
container is closed when the next one starts. Only the id, the size and the key are shuffled, never the text.

Defined results:
* sizes are in tokens of the byte-level tokenizer (one for each UTF-8 byte) or those of a given size column;
* a text larger than the capacity is cut into full containers and a rest that is packed like any item; nothing else is split;
* null and empty texts have size 0 and get a place in a container; equal rows each get a place;
* places never overlap and never exceed the capacity; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import staged

CAPACITY = 4096
WINDOW = 256  # texts without a place that a container is chosen from, at most
NEAR = 16
PART_TEXTS, MOST_PARTS = 10_000, 4096  # texts of a task, until there are so many tasks; each leaves one container that isn't full
SLACK = 1 / 256  # a container filled so far looks no farther
BITS = 10
PIECE = 1 << 20  # bytes that one packed sum takes without overflow


def _sign_table(seed: int = 11) -> np.ndarray:
    """For each 16-bit hash three signs, as bits in fields of 21 bits."""
    r = np.random.default_rng(seed).integers(0, 2, (3, 1 << 16)).astype(np.int64)
    return r[0] | r[1] << 21 | r[2] << 42


def project(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean sign vector (n, 3) of the byte 4-grams of each text; texts are data[start:end]."""
    out = np.zeros((len(starts), 3))
    size = ends - starts
    some = np.flatnonzero(size >= 4)
    if not len(some):
        return out
    b = np.concatenate([data, np.zeros(4, np.uint8)])
    w = b[:-4].astype(np.uint32)
    for k in (1, 2, 3):
        w |= b[k : len(b) - 4 + k].astype(np.uint32) << np.uint32(8 * k)
    w *= np.uint32(2_654_435_761)
    packed = table[w >> np.uint32(16)]
    for i in some:
        s, e = int(starts[i]), int(ends[i]) - 3
        for at in range(s, e, PIECE):
            p = int(packed[at : min(at + PIECE, e)].sum())
            out[i] += (p & 0x1FFFFF, p >> 21 & 0x1FFFFF, p >> 42 & 0x1FFFFF)
        out[i] = 2 * out[i] / (e - s) - 1
    return out


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, d), by turning the coordinates into the transposed index bit by bit."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap) if i else x[0]
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def fill_one(sizes: list[int], capacity: int, enough: int) -> list[int]:
    """Which of ``sizes``, given in curve order, fill one container: the first always, and what leaves least room with it.

    It is the best subset of the next ``NEAR`` neighbours, or of four times as many while they don't give ``enough``. Two texts of more than half a
    container never share one: where there are so many of them that they need nine tenths of the containers, the nearest that fits goes in first, or
    they would be left over alone. Bit r of ``sums`` is set if a subset sums to r with what is in; of equal fillings the one whose last text lies nearest is taken.
    """
    mask, look, taken, used = (1 << (capacity + 1)) - 1, NEAR, [0], sizes[0]
    if 2 * used <= capacity:
        many = [k for k, s in enumerate(sizes) if 2 * s > capacity]
        large = next((k for k in many if sizes[k] + used <= capacity), None)
        if large is not None and 10 * len(many) * capacity >= 9 * sum(sizes):
            taken.append(large)
            used += sizes[large]
    sums, before, k = 1 << used, [], 1
    while True:
        for k in range(k, min(look, len(sizes))):
            before.append(sums)
            if k not in taken:
                sums |= (sums << sizes[k]) & mask
        k += 1
        if sums >> enough or look >= len(sizes):
            break
        look *= 4
    left = sums.bit_length() - 1
    for k in range(len(before), 0, -1):
        if k in taken:
            continue
        if sizes[k] == 0:
            taken.append(k)
        elif not before[k - 1] >> left & 1:
            taken.append(k)
            left -= sizes[k]
    return sorted(taken)


def curve_keys(df: DataFrame, key: str, text: str, size: str | None = None) -> DataFrame:
    """(key, size, curve): the size in tokens and the Hilbert key of each text's place."""
    tokens = F.col(size).cast("long") if size else F.octet_length(F.col(text)).cast("long")
    rows = df.select(F.col(key).alias("key"), F.coalesce(tokens, F.lit(0)).cast("long").alias("size"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("size", T.LongType()), T.StructField("curve", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _sign_table()
        for batch in batches:
            col = batch.column(2)
            wide = pa.types.is_large_string(col.type)
            offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            raw = col.buffers()[2]
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            cells = np.zeros((len(col), 3), np.int64)
            at = 0
            while at < len(col):  # about 4 MB at a time
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), "right")) - 1)
                lo = offsets[at]
                v = project(data[lo : offsets[to]], offsets[at:to] - lo, offsets[at + 1 : to + 1] - lo, table)
                cells[at:to] = np.clip((v + 0.25) * 2 * (1 << BITS), 0, (1 << BITS) - 1)
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(cells))], names=schema.names)

    return rows.mapInArrow(run, schema)


def pack(df: DataFrame, key: str, text: str, size: str | None = None, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """(key, piece, container, offset, tokens): where each text, or each piece of one larger than a container, lies.

    The keys are written down first: the range partitioning looks at its input twice, and the texts should be read once.
    """
    if key in ("piece", "container", "offset", "tokens"):
        raise ValueError(f"the key can't be named {key}")
    keyed = staged(curve_keys(df, key, text, size), "curve")
    # a number of its own, or adaptive execution would pack few bytes of keys in one task
    parts = max(1, min(-(-keyed.count() // PART_TEXTS), MOST_PARTS))
    keyed = keyed.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key")
    schema = T.StructType([T.StructField(key, keyed.schema["key"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("container", T.LongType()), T.StructField("offset", T.IntegerType()), T.StructField("tokens", T.IntegerType())])

    enough = capacity - int(capacity * SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = count(TaskContext.get().partitionId() << 33)
        keys, sizes, pieces = [], [], []  # texts of the curve that have no place yet, and how many full containers came before
        held: tuple[list, ...] = ([], [], [], [], [])

        def put(key, piece: int, container: int, offset: int, tokens: int) -> None:
            for column, x in zip(held, (key, piece, container, offset, tokens), strict=True):
                column.append(x)

        def close(at: int, upto: int) -> int:
            """Fills containers from the texts from ``at`` on while at least ``upto`` have no place; gives where the rest starts."""
            while len(sizes) - at >= max(upto, 1):
                view = sizes[at : at + window]
                taken, container, offset = fill_one(view, capacity, enough), next(fresh), 0
                for k in taken:
                    put(keys[at + k], pieces[at + k], container, offset, view[k])
                    offset += view[k]
                # the texts passed over move up to the front, in their order
                out, last = set(taken), taken[-1]
                for column in (keys, sizes, pieces):
                    stay = [column[at + k] for k in range(last + 1) if k not in out]
                    column[at + last + 1 - len(stay) : at + last + 1] = stay
                at += len(taken)
            return at

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(held, (key_type, pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            at = 0
            for k, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                full = size // capacity if size > capacity else 0
                for piece in range(full):
                    put(k, piece, next(fresh), 0, capacity)
                    if len(held[0]) >= 65_536:
                        yield flush()
                if size - full * capacity or not full:
                    keys.append(k)
                    sizes.append(size - full * capacity)
                    pieces.append(full)
            at = close(at, 2 * window)
            for column in (keys, sizes, pieces):
                del column[:at]
            if len(held[0]) >= 65_536:
                yield flush()
        close(0, 1)
        if held[0]:
            yield flush()

    return keyed.select("key", "size").mapInArrow(run, schema)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and the share of all room that is used."""
    one = packed.agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return one.withColumn("used", F.col("tokens") / (F.col("containers") * capacity))
