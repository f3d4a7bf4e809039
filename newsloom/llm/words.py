"""Words of many texts at once: byte spans and 64-bit hashes in numpy.

All separators used here are ASCII bytes, which never occur inside a longer
UTF-8 character, so texts are cut on their bytes. A batch of texts is handled
as one byte array; no word ever spans two texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

SLICE_BYTES = 8 << 20
LONG_WORD = 256

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SPACES = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~SPACES
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing)
LETTERS = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def small_batches(spark: SparkSession, most: int = 32 << 20) -> SparkSession:
    """Rows per Arrow batch small enough that very long texts fit a worker; ``most`` bytes, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return spark


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        total = np.concatenate(([0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(total, total[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, with 8 zero bytes behind, and each text's bounds. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    size = int(bounds[-1] - bounds[0]) if len(bounds) else 0
    out = np.zeros(size + 8, np.uint8)
    if size:
        out[:size] = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
    return out, (bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64))


class Words:
    """Words of a column of texts.

    ``start`` and ``end`` are byte bounds in ``data``; ``first[i]:first[i + 1]``
    are the words of text ``i``.
    """

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool):
        data, bounds = utf8(column)
        self.data = LOWER[data] if lower else data
        self.bounds, n = bounds, len(data) - 8
        inside = kind[self.data[:n]]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = np.unique(bounds[(bounds > 0) & (bounds < n)])
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.start, self.end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``k`` words, and the windows of each text."""
        per_text = np.maximum(self.counts - (k - 1), 0)
        at = np.arange(per_text.sum()) + np.repeat(self.first[:-1] - (np.cumsum(per_text) - per_text), per_text)
        return at, per_text


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``data`` (which has 8 spare bytes at its end)."""
    length = end - start
    out = mix(length.astype(np.uint64) * _C1)
    eight = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
    short = np.flatnonzero(length <= LONG_WORD)
    at, left = start[short], length[short]
    while len(short):
        chunk = eight[at] & _MASKS[np.minimum(left, 8)]
        out[short] = mix((out[short] ^ chunk) + _C1)
        more = left > 8
        short, at, left = short[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].tobytes())
    return out


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` hashes from each place on; of no use where fewer follow in a text.

    Built by doubling: two overlapping runs fix the run they cover.
    """
    out, size = hashes.copy(), 1
    while size < k:
        step = min(size, k - size)
        joined = out.copy()
        joined[:len(out) - step] = mix(out[:len(out) - step] * _C1 + np.roll(out, -step)[:len(out) - step] + np.uint64(step))
        out, size = joined, size + step
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Marks of the ``n`` places that some run of ``width`` from ``starts`` covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0
