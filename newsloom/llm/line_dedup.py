"""Lines that many documents share, dropped from all but one of them.

Hashes of all long enough lines are range-partitioned by hash and document and
sorted by hash, document and position; one pass streams the first occurrences
(see ``runs``), and a hot line is spread over as many partitions as its rows
need. Results are compressed bitmaps of the lines that stay, one per document
that loses any; texts are not shuffled for that.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import words as wd
from newsloom.llm.runs import others

MIN_CHARS = 40
MIN_DOCUMENTS = 5
SPACES = " \t\n\x0b\x0c\r"
LOWEST = -(1 << 63)
_LOWER = bytes(wd.LOWER)

LINES = "h1 long, h2 long, doc long, pos int, n_lines int, mark long"


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.slices(batches):
            digests, docs, places, counts, marks = [], [], [], [], []
            for doc, text, mark in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "mark"))):
                lines = (text or "").split("\n")
                for pos, line in enumerate(lines):
                    if len(line) >= min_chars:
                        line = line.strip(SPACES)
                        if len(line) >= min_chars:
                            digests.append(xxhash.xxh3_128_digest(line.encode().translate(_LOWER)))
                            docs.append(doc)
                            places.append(pos)
                            counts.append(len(lines))
                            marks.append(mark)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(docs, pa.int64()),
                 pa.array(places, pa.int32()), pa.array(counts, pa.int32()), pa.array(marks, pa.int64())],
                ["h1", "h2", "doc", "pos", "n_lines", "mark"])
    return run


BITMAP = "doc long, mark long, n_lines int, bitmap binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, drops in zip(batch.column("n_lines").to_pylist(), batch.column("drops").to_pylist()):
            keep = np.ones(n, np.uint8)
            keep[drops] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc", "mark", "n_lines")), pa.array(maps, pa.binary())],
            ["doc", "mark", "n_lines", "bitmap"])


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Which lines stay."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _doc(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOWEST))


def bitmaps(documents: DataFrame, key: str = "doc_id", text: str = "text",
            min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc, mark, n_lines, bitmap`` for documents that lose lines; all others keep everything.

    A line's key is the line without spaces at its ends, A-Z in lower case.
    Keys of at least ``min_chars`` code points in at least ``min_documents``
    documents lose their lines but for those in the largest document. Null
    text is one empty line. Rows with one key are one document, ``mark`` (a hash
    of the text) tells them apart; a null key is a document below all others.
    An empty table gives no rows; other columns are ignored.
    """
    wd.small_batches(documents.sparkSession)
    rows = documents.select(_doc(key).alias("doc"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("mark"))
    lines = rows.mapInArrow(_lines(min_chars), LINES)
    drops = others(lines, min_documents, keep="largest").select("doc", "mark", "pos", "n_lines")
    grouped = drops.groupBy("doc", "mark").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("drops"))
    return grouped.mapInArrow(_pack, BITMAP)


def _with_bitmaps(documents: DataFrame, key: str, text: str, **limits) -> DataFrame:
    maps = bitmaps(documents, key, text, **limits).select(
        F.col("doc").alias("__llm_doc"), F.col("mark").alias("__llm_mark"), F.col("bitmap").alias("__llm_bitmap"))
    keyed = documents.withColumns({"__llm_doc": _doc(key), "__llm_mark": F.xxhash64(F.col(f"`{text}`"))})
    return keyed.join(maps, ["__llm_doc", "__llm_mark"], "left").drop("__llm_doc", "__llm_mark")


def _kept(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, 0
    keep = unpack(bitmap, len(lines))
    return [line for line, k in zip(lines, keep) if k], len(lines) - int(keep.sum())


def apply(documents: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``documents`` with the dropped lines taken out of the text; a null text without drops stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = [t if b is None else "\n".join(_kept(t, b)[0])
                     for t, b in zip(batch.column(at).to_pylist(), batch.column("__llm_bitmap").to_pylist())]
            yield batch.set_column(at, text, pa.array(texts, pa.string())).drop_columns(["__llm_bitmap"])

    return _with_bitmaps(documents, key, text, **limits).mapInArrow(run, documents.schema)


DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Line counts and the hash of what stays, for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, sha = [], [], []
            for t, b in zip(batch.column("text").to_pylist(), batch.column("__llm_bitmap").to_pylist()):
                kept, lost = _kept(t, b)
                n.append(len(kept) + lost)
                dropped.append(lost)
                sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha)],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = documents.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _with_bitmaps(rows, "doc_id", "text", **limits).mapInArrow(run, DIGEST)
