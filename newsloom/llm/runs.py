"""Runs of equal keys in range-partitioned, sorted rows, decided in one pass.

Rows are partitioned by ranges of key and document and sorted by key, document
and position. A pass over each partition decides all runs of equal keys but
its first and last, which may go on in the neighbours; rows of those come back
undecided and are settled by totals over these few keys. A hot key is spread
over as many partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import cut

KEYS = ["h1", "h2"]


def _marked(rows: pa.RecordBatch, first: np.ndarray, decided: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array(first), pa.array(np.full(rows.num_rows, decided))],
        [*rows.schema.names, "first", "decided"])


def _settle(run: list[tuple[pa.RecordBatch, np.ndarray]], min_documents: int) -> Iterator[pa.RecordBatch]:
    """The rows to drop of one complete run, which may come in pieces."""
    if sum(int(first.sum()) for _, first in run) >= min_documents:
        head = run[0][0].column("doc")[0].as_py()
        for rows, first in run:
            drop = rows.column("doc").to_numpy() != head
            yield _marked(rows.filter(pa.array(drop)), first[drop], True)


def _stream(min_documents: int):
    """Decide runs of equal hashes: rows to drop, and all rows of the two outer runs, undecided.

    A run that goes on over batches is held until it ends; it is never longer
    than the partition, whose size the range partitioning keeps even.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, last, held = True, None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last is None or (h1[0], h2[0]) != last[:2]
            first = new.copy()
            first[1:] |= doc[1:] != doc[:-1]
            first[0] = new[0] or doc[0] != last[2]
            last = (h1[-1], h2[-1], doc[-1])
            starts = np.flatnonzero(new)
            lead = int(starts[0]) if len(starts) else n
            if lead:
                held.append((batch.slice(0, lead), first[:lead]))
            if not len(starts):
                continue
            if held:
                yield from [_marked(*x, False) for x in held] if outer else _settle(held, min_documents)
                outer = False
            begin, end = int(starts[0]), int(starts[-1])
            if outer and len(starts) > 1:
                yield _marked(batch.slice(0, int(starts[1])), first[:starts[1]], False)
                begin, outer = int(starts[1]), False
            if begin < end:
                mine = slice(begin, end)
                number = np.cumsum(new[mine]) - 1
                n_docs = np.bincount(number, weights=first[mine])
                heads = doc[mine][new[mine]]
                drop = (n_docs[number] >= min_documents) & (doc[mine] != heads[number])
                yield _marked(batch.slice(begin, end - begin).filter(pa.array(drop)), first[mine][drop], True)
            held = [(batch.slice(end, n - end), first[end:])]
        yield from [_marked(*x, False) for x in held]
    return run


def others(rows: DataFrame, min_documents: int, keep: str) -> DataFrame:
    """Rows whose key stands in at least ``min_documents`` documents, without those of the one to keep.

    ``rows`` has the keys ``h1, h2``, ``doc``, ``pos`` and maybe more columns;
    ``keep`` is "largest" or "smallest" and means ``doc``.
    """
    largest = keep == "largest"
    order = F.col("doc").desc() if largest else F.col("doc").asc()
    ordered = rows.repartitionByRange(*KEYS, "doc").sortWithinPartitions(*KEYS, order, "pos")
    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    done = cut(ordered.mapInArrow(_stream(min_documents), fields + ", first boolean, decided boolean"))
    open_ = done.filter("not decided")
    totals = open_.groupBy(*KEYS).agg(
        F.sum(F.col("first").cast("int")).alias("n_docs"),
        (F.max("doc") if largest else F.min("doc")).alias("head"))
    # At most two keys per partition, so this side stays small whatever the rows are.
    settled = done.join(F.broadcast(totals), KEYS, "left")
    gone = F.col("decided") | ((F.col("n_docs") >= min_documents) & (F.col("doc") != F.col("head")))
    return settled.filter(gone).select(rows.columns)
