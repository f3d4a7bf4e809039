"""Which keywords occur in which texts, for keyword tables of any size.

A keyword that stands in a text brings all its grams (byte strings of ``GRAM``
bytes) along, so it is enough to look for its rarest one, its anchor. One pass
counts the grams of all texts in a table of fixed size, which tells each
keyword its anchor; a second one looks the grams of each text up among the
anchors, and what meets is verified on the text at once: neither texts nor
their grams go through a shuffle. The keyword list is never in the plan or in a
broadcast: in order of its anchors it is a few files, which pass through the
driver in pieces, which each machine holds once and its tasks map into memory.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut, release

GRAM = 7                              # at most 7: a gram and its length fit into one long
CELL_BITS, BLOCK_BITS = 22, 14        # gram counts, and how many make one row
SLICE_BYTES = 2 << 20
PLACES_AT_ONCE, WORDS_AT_ONCE = 500_000, 100_000      # of a slice of text, to be verified and to be told
FILTER_BITS = 16, 28                  # bits of the anchors' filter: a keyword's, and the most of all as a power of two


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a few MB of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = 0
        for last in np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES)) + 1:
            yield batch.slice(first, last - first)
            first = last
        yield batch.slice(first)


def grams(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of all places where ``size`` bytes of a text follow; the number of a gram holds its bytes and size."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or bounds[0] == bounds[-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
    per_text = np.maximum(np.diff(bounds) - size + 1, 0)
    starts = bounds[:-1] - bounds[0]
    at = np.arange(per_text.sum()) + np.repeat(starts - (np.cumsum(per_text) - per_text), per_text)
    number = np.full(len(at), size, np.int64)
    for k in range(size):
        number = (number << 8) | raw[at + k]
    return np.repeat(np.arange(len(column)), per_text), number


def _cell(number: np.ndarray) -> np.ndarray:
    mixed = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, np.uint32)
    for batch in _slices(batches, "text"):
        _, number = grams(batch.column("text"), GRAM)
        total += np.bincount(_cell(number), minlength=len(total)).astype(np.uint32)
    parts = total.reshape(-1, 1 << BLOCK_BITS)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array([_planes(parts[b]) for b in used], pa.binary())], ["block", "counts"])


def _planes(values: np.ndarray) -> bytes:
    """Byte planes: the high bytes of small numbers become zeros for Spark's compression."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    planes = (np.frombuffer(c, np.uint8).reshape(4, -1) for batch in batches for c in batch.column("counts").to_pylist())
    total = sum((p.T.copy().view(np.uint32).ravel() for p in planes), np.zeros(1 << BLOCK_BITS, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences per cell of grams in the column ``text``; a table of fixed size that only ranks grams."""
    rows = texts.select("text").mapInArrow(_count, "block int, counts binary").groupBy("block").applyInArrow(
        _add, "block int, counts binary")
    total = np.zeros((1 << (CELL_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int64)
    for row in rows.collect():             # at most one row per block of the table
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(total.ravel(), np.iinfo(np.int32).max).astype(np.int32)


def _anchor(counts: np.ndarray):
    """The rarest gram of each keyword; one shorter than a gram is its own anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("keyword")
            size = pc.binary_length(words).to_numpy(zero_copy_only=False)
            anchor = np.zeros(len(words), np.int64)
            for k in range(1, GRAM + 1):
                owner, number = grams(words, k)
                mine = (size[owner] == k) if k < GRAM else (size[owner] >= k)
                owner, number = owner[mine], number[mine]
                order = np.lexsort((number, counts[_cell(number)], owner))
                owner, number = owner[order], number[order]
                first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
                anchor[owner[first]] = number[first]
            yield pa.RecordBatch.from_arrays([words, pa.array(anchor)], ["keyword", "gram"])
    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition as rows of bytes: its number, the place in it; of its keywords the anchors, where they stand, sizes and bytes."""
    for i, batch in enumerate(batches):
        if batch.num_rows:
            raw, bounds = _bytes(batch.column("keyword"))
            anchor = batch.column("gram").to_numpy()
            owner, number = grams(batch.column("keyword"), GRAM)
            first = np.searchsorted(owner, np.arange(len(anchor)))
            found, at = np.unique(owner[number == anchor[owner]], return_index=True)
            place = np.zeros(len(anchor), np.int32)
            place[found] = np.flatnonzero(number == anchor[owner])[at] - first[found]
            columns = anchor.tobytes(), place.tobytes(), np.diff(bounds).tobytes(), raw.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_part").slice(0, 1), pa.array([i]), *[pa.array([c], pa.binary()) for c in columns]],
                ["part", "place", "grams", "places", "sizes", "data"])


def _bit(number: np.ndarray, power: int) -> np.ndarray:
    """A second hash of grams, for the filter."""
    mixed = (number.astype(np.uint64) ^ (number.astype(np.uint64) >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - power)).astype(np.int64)


KINDS = {"grams": np.int64, "places": np.int32, "bounds": np.int64, "data": np.uint8, "filter": np.uint8}


def _files(anchored: DataFrame) -> tuple[dict[str, str], list[int], int]:
    """Files on every machine with the anchors, where they stand, byte bounds and bytes of all keywords by anchor, and the filter's bits;
    the sizes of grams in use and the filter's power of two. The driver holds one partition of keywords at a time."""
    spark, order = anchored.sparkSession, ("gram", "keyword")
    n = anchored.count()
    power = min(max((n * FILTER_BITS[0]).bit_length(), 10), FILTER_BITS[1])
    pieces = cut(anchored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).mapInArrow(
        _pieces, "part int, place long, grams binary, places binary, sizes binary, data binary"))
    names = {c: f"newsloom-{c}-{uuid.uuid4()}" for c in KINDS}
    folder = tempfile.mkdtemp(dir=SparkFiles.getRootDirectory())
    paths = {c: os.path.join(folder, name) for c, name in names.items()}
    bits, sizes, end = np.zeros(1 << power >> 3, np.uint8), set(), 0
    with (open(paths["grams"], "wb") as grams_, open(paths["places"], "wb") as places,
          open(paths["bounds"], "wb") as bounds, open(paths["data"], "wb") as data):
        bounds.write(np.zeros(1, np.int64).tobytes())
        for row in pieces.orderBy("part", "place").toLocalIterator():
            number = np.frombuffer(row["grams"], np.int64)
            at = _bit(number, power)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            sizes.update(k for k in range(1, GRAM + 1) if (number >> (8 * k) == k).any())
            grams_.write(row["grams"])
            places.write(row["places"])
            bounds.write((end + np.cumsum(np.frombuffer(row["sizes"], np.int64))).tobytes())
            data.write(row["data"])
            end += len(row["data"])
    release(pieces)
    bits.tofile(paths["filter"])
    for path in paths.values():
        spark.sparkContext.addFile(path)
    return names, sorted(sizes), power


def _found(names: dict[str, str], sizes: list[int], power: int):
    """The keywords that stand in each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, places, bounds, data, bits = (np.memmap(SparkFiles.get(names[c]), kind, "r") for c, kind in KINDS.items())

        def words(at: np.ndarray) -> pa.Array:
            size = bounds[at + 1] - bounds[at]
            ends = np.append(0, np.cumsum(size))
            raw = data[np.repeat(bounds[at] - ends[:-1], size) + np.arange(ends[-1])]
            return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])

        for batch in _slices((b for b in batches if b.num_rows), "text"):
            raw, starts = _bytes(batch.column("text"))
            held = [np.zeros(0, np.int64)]
            for k in sizes:
                owner, number = grams(batch.column("text"), k)
                at = _bit(number, power)
                use = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                use = use[np.argsort(number[use], kind="stable")]
                per_text = np.maximum(np.diff(starts) - k + 1, 0)
                owner, number, place = owner[use], number[use], use + (starts[:-1] - (np.cumsum(per_text) - per_text))[owner[use]]
                first = np.searchsorted(anchors, number, "left")
                n = np.searchsorted(anchors, number, "right") - first
                for low, high in _spans(n, PLACES_AT_ONCE):
                    some = n[low:high]
                    word = np.arange(some.sum()) + np.repeat(first[low:high] - (np.cumsum(some) - some), some)
                    of, begin = np.repeat(owner[low:high], some), np.repeat(place[low:high], some) - places[word]
                    size = bounds[word + 1] - bounds[word]
                    fit = np.flatnonzero((begin >= starts[of]) & (begin + size <= starts[of + 1]))
                    same = fit[_equal(raw, begin[fit], data, bounds[word[fit]], size[fit])]
                    held.append(np.unique(of[same] * len(anchors) + word[same]))
            held = np.unique(np.concatenate(held))
            for i in range(0, len(held), WORDS_AT_ONCE):
                of, word = np.divmod(held[i:i + WORDS_AT_ONCE], len(anchors))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of)), words(word)], ["id", "keyword"])
    return run


def keyword_matches(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str, keyword_col: str = "keyword") -> DataFrame:
    """``id, keyword`` for every row of ``texts`` and every keyword that it holds as a substring.

    Both sides count in lower case. Empty keywords and null texts match nothing;
    repeated keywords count once. Rows that share an id are matched each for itself.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    words = keywords.select(F.lower(keyword_col).alias("keyword")).filter("keyword <> ''").distinct()
    anchored = cut(words.mapInArrow(_anchor(gram_counts(rows)), "keyword string, gram long"))
    if anchored.head() is None:
        return rows.select("id", F.lit("").alias("keyword")).limit(0)
    found = _found(*_files(anchored))
    release(anchored)
    return rows.filter("id is not null").mapInArrow(found, f"id {rows.schema['id'].dataType.simpleString()}, keyword string")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (and the last ends)."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if bounds[0] < bounds[-1] else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _mixed(owner: np.ndarray, number: np.ndarray) -> np.ndarray:
    return number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _stands(texts: pa.Array, owner: np.ndarray, words: pa.Array, gram: int = GRAM) -> np.ndarray:
    """Whether each word, of ``gram`` bytes at least, stands in the text ``owner``: its bytes are compared
    where the text has the word's first gram, so long texts are not searched for each word anew."""
    raw, bounds = _bytes(texts)
    word_raw, word_bounds = _bytes(words)
    number = np.full(len(words), gram, np.int64)
    for k in range(gram):
        number = (number << 8) | word_raw[word_bounds[:-1] + k]
    of, grammed = grams(texts, gram)
    per_text = np.maximum(np.diff(bounds) - gram + 1, 0)
    place = np.arange(len(of)) + np.repeat(bounds[:-1] - (np.cumsum(per_text) - per_text), per_text)
    keys = _mixed(of, grammed)
    order = np.argsort(keys, kind="stable")
    keys, asked = keys[order], _mixed(owner, number)
    first = np.searchsorted(keys, asked, "left")
    n = np.searchsorted(keys, asked, "right") - first
    out, size = np.zeros(len(words), bool), np.diff(word_bounds)
    for low, high in _spans(n):
        some = n[low:high]
        word = np.repeat(np.arange(low, high), some)
        at = order[np.arange(some.sum()) + np.repeat(first[low:high] - (np.cumsum(some) - some), some)]
        begin = place[at]
        fit = np.flatnonzero((of[at] == owner[word]) & (begin + size[word] <= bounds[owner[word] + 1]))
        word, begin = word[fit], begin[fit]
        out[word[_equal(raw, begin, word_raw, word_bounds[word], size[word])]] = True
    return out


def _equal(raw: np.ndarray, begin: np.ndarray, other: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of ``raw`` from ``begin`` on are those of ``other`` from ``to`` on."""
    out, left, k = np.zeros(len(begin), bool), np.arange(len(begin)), 0
    while len(left):
        done = size[left] == k
        out[left[done]] = True
        left = left[~done]
        left, k = left[raw[begin[left] + k] == other[to[left] + k]], k + 1
    return out


def _spans(n: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of words with some million places (``most``) together, or one word."""
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // most)) + 1
    yield from zip(np.append(0, cuts).tolist(), np.append(cuts, len(n)).tolist())


def keyword_counts(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str, keyword_col: str = "keyword") -> DataFrame:
    """``keyword, n``: rows of ``texts`` that hold each keyword, for those that some row holds."""
    return keyword_matches(texts, keywords, id_col, text_col, keyword_col).groupBy("keyword").agg(F.count("*").alias("n"))
