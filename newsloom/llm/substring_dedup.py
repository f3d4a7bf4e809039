"""Repeated word runs removed wherever a smaller document holds them.

Fixed-block anchors: every document's non-overlapping blocks of ``BLOCK`` words
are indexed, and every rolling window of as many words of every document probes
the index. A window of ``2 * BLOCK`` words that two documents share holds a
whole block of each, so nothing is missed. Hits are then extended: around each,
all windows of the full width are compared exactly, on both sides, and runs of
common windows give the maximal exact repeats.

Anchors and probes travel as packed arrays, one row per bucket of hashes and
slice of texts. A bucket is read as a stream, first its anchors (one per slice
and hash), then the probes, then the anchors' places, so memory holds distinct
anchors only, however often one occurs. Common windows are found by runs in
sorted rows (see ``runs``), so a hot one is spread over many partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import words as wd
from newsloom.llm.runs import others
from newsloom.session import cut

WINDOW = 50
LOWEST = -(1 << 63)
BUCKET_BYTES = 12 << 20      # text whose windows make one bucket
BATCH_BYTES, SLICE_BYTES = 8 << 20, 4 << 20
ANCHORS, PROBES, PLACES = range(3)

PACKED = "bucket int, kind int, keys binary, docs binary, at binary"


def _planes(values: np.ndarray) -> bytes:
    """Byte planes: the high bytes of small numbers become runs of zeros for Spark's compression."""
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(planes, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


def _steps(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=values.dtype.type(0)))


def _sums(planes: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_values(planes, kind), dtype=kind)


def _pack(block: int, buckets: int):
    """Anchors and probes of a slice of texts, per bucket."""
    def row(bucket: int, kind: int, keys, docs, at=b""):
        return bucket, kind, keys.tobytes(), docs, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.slices(batches, limit=SLICE_BYTES):
            text = wd.Words(batch.column("text"), wd.NOT_SPACE, lower=False)
            at, per_text = text.windows(block)
            if not len(at):
                continue
            hashes = wd.chain(text.hashes(), block)[at]
            doc = batch.column("doc").to_numpy()
            owner = np.repeat(np.arange(len(per_text)), per_text)
            place = at - text.first[owner]
            bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            keys = hashes.astype(np.uint32)
            rows = []
            for b in range(buckets):
                mine = order[cuts[b]:cuts[b + 1]]
                if not len(mine):
                    continue
                # Owners as numbers in the slice, with a table of their documents.
                own, number = np.unique(owner[mine], return_inverse=True)
                table = _steps(doc[own])
                probes = np.stack((number, place[mine])).astype(np.uint32)
                rows.append(row(b, PROBES, keys[mine], table,
                                len(mine).to_bytes(8, "little") + _steps(probes[0]) + _planes(probes[1])))
                anchors = np.flatnonzero(place[mine] % block == 0)
                if len(anchors):
                    k, d = keys[mine][anchors], doc[owner[mine[anchors]]]
                    rows.append(row(b, PLACES, k, _planes(d), _planes(place[mine[anchors]].astype(np.uint32))))
                    by = np.lexsort((d, k))
                    k, d = k[by], d[by]
                    first = np.append(True, k[1:] != k[:-1])
                    rows.append(row(b, ANCHORS, k[first], _planes(d[first])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                ["bucket", "kind", "keys", "docs", "at"])
    return run


HITS = "doc long, pos int"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of probes that meet an anchor of a smaller document, and of the anchors they may have met."""
    bucket, parts, keys, least, most = None, [], None, None, None

    def found(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(place.astype(np.int32))], ["doc", "pos"])

    def index():
        k, d = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        first = np.append(True, k[1:] != k[:-1])
        return k[first], d[first], np.full(int(first.sum()), LOWEST, np.int64)

    def lookup(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == k)
        return hit, at[hit]

    for batch in batches:
        for b, kind, k, docs, at in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "docs", "at"))):
            if b != bucket:
                bucket, parts, keys = b, [], None
            k = np.frombuffer(k, np.uint32)
            if kind == ANCHORS:
                parts.append((k, _values(docs, np.int64)))
                if len(parts) > 64:               # keep distinct anchors only
                    merged = index()
                    parts = [merged[:2]]
                continue
            if keys is None:
                if not parts:
                    continue
                keys, least, most = index()
            hit, slot = lookup(k)
            if not len(hit):
                continue
            if kind == PROBES:
                n = int.from_bytes(at[:8], "little")
                number, place = _sums(at[8:8 + 4 * n], np.uint32), _values(at[8 + 4 * n:], np.uint32)
                doc = _sums(docs, np.int64)[number[hit]]
                np.maximum.at(most, slot, doc)
                later = doc > least[slot]
                if later.any():
                    yield found(doc[later], place[hit][later])
            else:
                doc, place = _values(docs, np.int64), _values(at, np.uint32)
                used = most[slot] > doc[hit]
                if used.any():
                    yield found(doc[hit][used], place[hit][used])


def _doc(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LOWEST))


def anchors(rows: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc, pos`` of blocks that another document holds too, on either side."""
    block = window // 2
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // bucket_bytes) + 1
    packed = rows.mapInArrow(_pack(block, buckets), PACKED)
    return packed.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_probe, HITS)


PREPARED = "doc_id long, doc long, n_words long, kept_sha256 string, text string, hits array<int>"


def _sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def _cut_words(text: str | None, spaces: str = " \t\n\x0b\x0c\r") -> list[str]:
    for s in spaces[1:]:
        if text and s in text:
            text = text.replace(s, " ")
    return [w for w in (text or "").split(" ") if w]


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without hits are done; the others keep their text."""
    for batch in batches:
        n, sha, texts = [], [], []
        for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
            words = _cut_words(text)
            n.append(len(words))
            open_ = bool(hits and words)
            sha.append(None if open_ else _sha(words))
            texts.append(text if open_ else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("doc"), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
             pa.array(texts, pa.string()), batch.column("hits")],
            ["doc_id", "doc", "n_words", "kept_sha256", "text", "hits"])


WINDOWS = "h1 long, h2 long, doc long, pos int"


def _windows(window: int):
    """Hashes of all full windows around the hits."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wd.slices(batches, limit=SLICE_BYTES):
            text = wd.Words(batch.column("text"), wd.NOT_SPACE, lower=False)
            hits = batch.column("hits").to_pylist()
            owner = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
            pos = np.concatenate([np.array(h, np.int64) for h in hits] or [np.zeros(0, np.int64)])
            inside = pos + block <= text.counts[owner]
            pos, owner = pos[inside], owner[inside]
            # A window that holds the block begins between `reach` words before it and the block itself.
            reach = window - block
            low = np.maximum(pos - reach, 0)
            high = np.minimum(pos, text.counts[owner] - window)
            good = high >= low
            base = text.first[owner[good]]
            marks = np.zeros(len(text) + 1, np.int64)
            np.add.at(marks, base + low[good], 1)
            np.add.at(marks, base + high[good] + 1, -1)
            at = np.flatnonzero(np.cumsum(marks)[:len(text)] > 0)
            owner = np.searchsorted(text.first, at, side="right") - 1
            hashes = text.hashes()
            h1 = wd.chain(hashes, window)[at]
            h2 = wd.chain(wd.mix(hashes + np.uint64(1)), window)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 pa.array(batch.column("doc").to_numpy()[owner]), pa.array((at - text.first[owner]).astype(np.int32))],
                ["h1", "h2", "doc", "pos"])
    return run


def repeats(hit: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, starts``: the windows of documents with hits that a smaller document holds as well."""
    windows = hit.mapInArrow(_windows(window), WINDOWS)
    return others(windows, 2, keep="smallest").groupBy("doc").agg(F.collect_set("pos").alias("starts"))


def _kept(text: str, starts: list[int] | None, window: int) -> tuple[list[str], int]:
    words = _cut_words(text)
    gone = wd.covered(np.array([s for s in starts or () if s + window <= len(words)], np.int64), window, len(words))
    return [w for w, g in zip(words, gone) if not g], int(gone.sum())


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def dedupe(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept``; ``kept`` only where words were removed.

    A word goes if a window of ``window`` (even) words over it starts in a
    document with a smaller key too. Null and short texts lose nothing. Rows
    with one key are one document and must have one text; a null key is below
    all others; an empty table gives no rows; other columns are ignored.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    wd.small_batches(documents.sparkSession, BATCH_BYTES)
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("doc_id"), _doc(key).alias("doc"),
                            F.col(f"`{text}`").alias("text"))
    hits = anchors(rows.select("doc", "text"), window, bucket_bytes).groupBy("doc").agg(F.collect_set("pos").alias("hits"))
    ready = cut(rows.join(hits, "doc", "left").select("doc_id", "doc", "text", "hits").mapInArrow(_prepare, PREPARED))
    hit = ready.filter("text is not null")
    done = ready.filter("text is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
        F.lit(None).cast("string").alias("kept"))
    starts = repeats(hit.select("doc", "text", "hits"), window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(t, s, window) for t, s in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array([n for _, n in out], pa.int64()),
                 pa.array([_sha(w) for w, _ in out], pa.string()),
                 pa.array([" ".join(w) if n else None for w, n in out], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    late = hit.select("doc_id", "doc", "n_words", "text").join(starts, "doc", "left").select(
        "doc_id", "n_words", "text", "starts").mapInArrow(finish, DIGEST)
    return done.unionByName(late)
