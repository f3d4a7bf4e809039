"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

An interpolated modified Kneser-Ney bigram model over all words that occur
``MIN_COUNT`` times in trusted documents (rarer ones are one unknown word). Its
counts cover all trusted text, and it grows with it. Bigrams are dealt out to
shards by hash: a shard merges the counts of the trusted text and is joined by
the packed bigrams of all documents, of which it returns log probabilities
summed per document. What is known per word (its hash, and its totals) is a file
in word order that each machine holds once and its tasks map into memory; the
driver passes it on in pieces.

A trusted document is scored as if it had not been trained on: its own counts
are taken off first. Thresholds are quantiles of the trusted documents' scores,
per language, on both sides, as repeated words are too easy to predict.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm import words as wd
from newsloom.session import cut

BEGIN, UNKNOWN, FIRST = 0, 1, 2          # word numbers
WORDS = 65_536                           # a word never seen has a share of one in this many, or in all words if they are more
SHARD_BIGRAMS = 4_000_000                # distinct bigrams of one shard of the model, about
MIN_SHARDS = 8
STREAM_BYTES = 256 << 20                 # text whose bigrams one task looks up in a shard
QUANTILES = (0.002, 0.998)
MIN_COUNT = 3                            # of a word of the vocabulary in trusted text
PRIOR_WORDS = 20                         # words at the language's mean that every score starts with
MIN_TRUSTED = 50                         # trusted documents whose own mean and quantiles weigh as much as those of all
BROADCAST_ROWS = 2_000_000               # labels up to here go to the tasks whole
_END_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_SHARD = np.uint64(0x9E3779B97F4A7C15)


def _tokens(column: pa.Array) -> tuple[wd.Words, np.ndarray]:
    """Lower-case words without one closing mark, and their hashes."""
    text = wd.Words(column, wd.NOT_SPACE, lower=True)
    end = text.end - (_END_MARKS[text.data[text.end - 1]] & (text.end - text.start > 1))
    return text, wd.hash_spans(text.data, text.start, end)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in wd.slices(batches, limit=4 * wd.SLICE_BYTES):
        _, hashes = _tokens(batch.column("text"))
        word, n = np.unique(hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


def _in_order(columns: list[str]):
    """A sorted partition as rows of bytes: its number, the place in it, the columns side by side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(batches):
            if batch.num_rows:
                rows = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("__llm_part").slice(0, 1), pa.array([i]), pa.array([rows.tobytes()], pa.binary())],
                                                 ["part", "place", "data"])
    return run


def _file(table: DataFrame, order: str, columns: list[str]) -> str:
    """A file of ``columns`` (longs) in order, on every machine; the driver holds one partition at a time."""
    spark = table.sparkSession
    pieces = cut(table.repartitionByRange(order).sortWithinPartitions(order).withColumn("__llm_part", F.spark_partition_id()).mapInArrow(
        _in_order(columns), "part int, place long, data binary"))
    name = f"newsloom-{uuid.uuid4()}"
    path = os.path.join(tempfile.mkdtemp(dir=SparkFiles.getRootDirectory()), name)
    with open(path, "wb") as out:
        for row in pieces.orderBy("part", "place").toLocalIterator():
            out.write(row["data"])
    spark.sparkContext.addFile(path)
    return name


def _mapped(name: str, columns: int = 1) -> np.ndarray:
    path = SparkFiles.get(name)
    if not os.path.getsize(path):
        return np.zeros((0, columns), np.int64)
    return np.memmap(path, np.int64, "r").reshape(-1, columns)


def vocabulary(trusted: DataFrame, size: int | None = None, min_count: int = MIN_COUNT) -> tuple[str, int, int]:
    """File of the hashes of all words (or the ``size`` most frequent), sorted (a word's number is its
    place plus ``FIRST``), how many they are, and how many other words there are."""
    counts = cut(trusted.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    common = counts.filter(F.col("n") >= min_count)
    if size is not None:
        common = common.orderBy(F.col("n").desc(), "word").limit(size)
    common = cut(common.select("word"))
    n = common.count()
    return _file(common, "word", ["word"]), n, counts.count() - n


def _bigrams(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bigram) of all words; the first word of a text follows ``BEGIN``."""
    text, hashes = _tokens(column)
    distinct, place = np.unique(hashes.view(np.int64), return_inverse=True)
    word = np.full(len(distinct), UNKNOWN, np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        word = np.where(known[at] == distinct, at + FIRST, UNKNOWN).astype(np.uint64)
    word = word[place]
    before = np.concatenate(([BEGIN], word[:-1])).astype(np.uint64)[:len(word)]
    before[text.first[:-1][text.counts > 0]] = BEGIN
    return text.texts(), (before << np.uint64(32)) | word


def _shard_of(bigram: np.ndarray, shards: int) -> np.ndarray:
    return ((wd.mix(bigram * _SHARD) >> np.uint64(32)) % np.uint64(shards)).astype(np.uint32)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes."""
    planes = [a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unzip(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(raw[at:at + n * width].reshape(width, n).T.copy().view(kind).ravel())
        at += n * width
    return out


PACKED = "shard int, trains boolean, n int, data binary, docs binary"


def _pack(words: str, shards: int):
    """Bigram counts per document, packed by shard; of trusted text also as counts to train on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _mapped(words)[:, 0]
        for batch in wd.slices(batches, limit=2 * wd.SLICE_BYTES):
            owner, bigram = _bigrams(batch.column("text"), known)
            if not len(owner):
                continue
            key, trusted = batch.column("key").to_numpy(), batch.column("trusted").to_numpy(zero_copy_only=False)
            distinct, place = np.unique(bigram, return_inverse=True)
            code, n = np.unique((place.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64), return_counts=True)
            bigram, owner = distinct[code >> np.uint64(32)], (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            shard = _shard_of(bigram, shards)
            order = np.argsort(shard, kind="stable")           # bigrams stay sorted inside a shard
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[s]:cuts[s + 1]]
                b, o, c = bigram[mine], owner[mine], n[mine].astype(np.uint32)
                own, number = np.unique(o, return_inverse=True)
                steps = np.diff(b, prepend=np.uint64(0))
                table = np.where(trusted[own], 1, 0).astype(np.uint8)
                rows.append((int(s), False, len(b), _zip(steps, number.astype(np.uint32), c),
                             len(own).to_bytes(4, "little") + _zip(key[own], table)))
                mark = trusted[o]
                if mark.any():
                    b, c = b[mark], c[mark]
                    new = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                    sums = np.add.reduceat(c, new).astype(np.uint32)
                    rows.append((int(s), True, len(new), _zip(np.diff(b[new], prepend=np.uint64(0)), sums), b""))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()))],
                ["shard", "trains", "n", "data", "docs"])
    return run


# --- the model --------------------------------------------------------------------

MODEL = "shard int, n long, data binary"
TOTALS = ["total", "before", "n1", "n2", "n3"]         # of a word: as context, as follower, kinds of followers by count
FACTS = "word long, " + ", ".join(f"{c} long" for c in TOTALS)
TALLY = "kind string, word long, value long"


def _merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All counts of a shard: distinct bigrams only, merged as they come."""
    bigrams, counts, parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def fold():
        nonlocal bigrams, counts
        b = np.concatenate([bigrams, *(p[0] for p in parts)])
        c = np.concatenate([counts, *(p[1] for p in parts)])
        bigrams, at = np.unique(b, return_inverse=True)
        counts = np.bincount(at, weights=c, minlength=len(bigrams)).astype(np.int64)
        parts.clear()

    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
            steps, c = _unzip(data, n, np.uint64, np.uint32)
            parts.append((np.cumsum(steps, dtype=np.uint64), c))
            if len(parts) >= 32:
                fold()
    fold()
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([len(bigrams)]), pa.array([_zip(bigrams, counts)], pa.binary())],
        ["shard", "n", "data"])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a shard adds to the totals of each word."""
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
            bigram, c = _unzip(data, n, np.uint64, np.int64)
            if not n:
                continue
            context, word = _halves(bigram)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))       # bigrams are sorted
            sums = [np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c >= 3)]
            zero = np.zeros(len(first), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (context[first].astype(np.int64), sums[0], zero, *sums[1:])], ["word", *TOTALS])
            word, before = np.unique(word.astype(np.int64), return_counts=True)
            zero = np.zeros(len(word), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word, zero, before, zero, zero, zero)], ["word", *TOTALS])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many bigrams of a shard have each count."""
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
            table = np.bincount(np.minimum(_unzip(data, n, np.uint64, np.int64)[1], 5), minlength=6)
            yield pa.RecordBatch.from_arrays([pa.array(["counts"] * 6), pa.array(np.arange(6)), pa.array(table)], ["kind", "word", "value"])


def _halves(bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and word of packed bigrams, of any width."""
    bits = bigram.dtype.type(4 * bigram.itemsize)
    return bigram >> bits, bigram & bigram.dtype.type((1 << int(bits)) - 1)


def _discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the counts of counts n[1..4]; of use for any counts, none above its count."""
    n1, n2, n3, n4 = (float(x) for x in n[1:5])
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


class Model:
    """Discounts, and totals per word from which back-off weights and the lower order follow.

    ``facts`` lists the totals; with ``totals``, the file that has them in word
    order, ``facts`` has only how many bigrams (``counts``) and followers
    (``lower``) have each count, and how many bigrams there are (``kinds``).
    """

    def __init__(self, facts: pa.Table, others: int, words: int = WORDS, totals: str | None = None):
        self.others, self.file = max(others, 1), totals
        self.words = words - 1                              # all but BEGIN
        tables = {}
        for name in (*TOTALS, "counts", "lower", "kinds"):
            mine = facts.filter(pc.equal(facts.column("kind"), name))
            tables[name] = np.zeros(6 if totals else max(words, 6), np.int64)
            tables[name][mine.column("word").to_numpy()] = mine.column("value").to_numpy()
        self.discount = _discounts(tables["counts"])
        if totals is None:
            before = tables["before"]
            self.table = np.stack([tables[c] for c in TOTALS], axis=1)
            tables["lower"] = np.bincount(np.minimum(before[before > 0], 5), minlength=6)
            tables["kinds"][0] = before.sum()
        self.low, self.kinds = _discounts(tables["lower"]), int(tables["kinds"][0])
        tally = tables["lower"]
        cut_off = self.low[1] * tally[1] + self.low[2] * tally[2] + self.low[3] * tally[3:].sum()
        self.rest = cut_off / self.kinds if self.kinds else 1.0

    def opened(self) -> Model:
        """The model with its file at hand."""
        self.table = _mapped(self.file, len(TOTALS))
        return self

    def log_p(self, bigram: np.ndarray, count: np.ndarray) -> np.ndarray:
        context, word = _halves(bigram)
        of_context = self.table[context]
        total, before = of_context[:, 0], self.table[word, 1]
        left = of_context[:, 2:] @ self.discount[1:]
        back_off = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        lower = np.maximum(before - self.low[np.minimum(before, 3)], 0) / max(self.kinds, 1) + self.rest / self.words
        seen = np.maximum(count - self.discount[np.minimum(count, 3)], 0) / np.maximum(total, 1)
        # The unknown word stands for many; each has an even share of its probability.
        share = np.where(word == UNKNOWN, 1 / self.others, 1.0)
        return np.log((seen + back_off * lower) * share)


SCORES = "key long, log_p double, n long"


def _score(model: Model):
    """A model shard meets the packed bigrams of documents: log probabilities per document."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.opened()
        shard, known, counts = None, None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "model", "n", "data", "docs")]
            for s, is_model, n, data, docs in zip(*columns):
                if is_model:
                    shard, (known, counts) = s, _unzip(data, n, np.uint64, np.int64)
                    continue
                if s != shard:                              # nothing was trained in this shard
                    shard, known, counts = s, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                steps, number, own = _unzip(data, n, np.uint64, np.uint32, np.uint32)
                bigram = np.cumsum(steps, dtype=np.uint64)
                size = int.from_bytes(docs[:4], "little")
                keys, trusted = _unzip(docs[4:], size, np.int64, np.uint8)
                count = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, bigram), len(known) - 1)
                    count = np.where(known[at] == bigram, counts[at], 0)
                count = np.maximum(count - own * trusted[number], 0)
                total = np.bincount(number, weights=own * model.log_p(bigram, count), minlength=size)
                words = np.bincount(number, weights=own, minlength=size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total), pa.array(words)], ["key", "log_p", "n"])
    return stream


def _key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))


def scores(documents: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
           vocabulary_size: int | None = None, shard_bigrams: int = SHARD_BIGRAMS,
           stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """``key, doc_id, lang, trusted, log_p, n``: one row per document; without words ``n`` is 0.

    A caller may ask for a smaller vocabulary; by default all words are in it.
    """
    if vocabulary_size is not None and vocabulary_size < 1:
        raise ValueError("vocabulary_size must be at least 1")
    wd.small_batches(documents.sparkSession)
    ids = cut(trusted.select(F.col(trusted.columns[0]).cast("long").alias("__llm_id")).filter("__llm_id is not null").distinct())
    # A measured size decides how the labels meet the texts; the result is the same.
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rows = documents.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{text}`").alias("text"), _key(key, text).alias("key"))
    rows = rows.join(side, F.col("doc_id") == F.col("__llm_id"), "left").withColumn("trusted", F.col("__llm_id").isNotNull()).drop("__llm_id")
    length = F.octet_length("text")
    size, learnt = (x or 0 for x in rows.agg(F.sum(length), F.sum(F.when(F.col("trusted"), length))).first())
    # As many shards as the model needs; a shard's look-ups are spread
    # over as many tasks as the input needs, each with a copy of the shard.
    shards = max(MIN_SHARDS, int(min(learnt // 6, vocabulary_size**2 if vocabulary_size else learnt) // shard_bigrams) + 1)
    tasks = int(size // (shards * stream_bytes)) + 1
    known, n_known, others = vocabulary(rows.filter("trusted"), vocabulary_size)
    packed = lambda part: part.select("key", "trusted", "text").mapInArrow(_pack(known, shards), PACKED)
    model = cut(packed(rows.filter("trusted")).filter("trains").select("shard", "n", "data").groupBy("shard").applyInArrow(_merge, MODEL))
    stored = model.select("n", "data")
    spark = documents.sparkSession
    # Every word number has a row, so its place in the file is its number.
    empty = spark.range(n_known + FIRST).select(F.col("id").alias("word"), *[F.lit(0).cast("long").alias(c) for c in TOTALS])
    totals = cut(stored.mapInArrow(_facts, FACTS).unionByName(empty).groupBy("word").agg(*[F.sum(c).alias(c) for c in TOTALS]))
    count = F.least("before", F.lit(5)).cast("long")
    tally = stored.mapInArrow(_tally, TALLY).unionByName(
        totals.filter("before > 0").select(F.lit("lower").alias("kind"), count.alias("word"), F.lit(1).cast("long").alias("value"))).unionByName(
        totals.select(F.lit("kinds").alias("kind"), F.lit(0).cast("long").alias("word"), F.col("before").alias("value")))
    facts = tally.groupBy("kind", "word").agg(F.sum("value").alias("value")).toArrow()      # a dozen rows
    tables = Model(facts, others, max(WORDS, n_known + FIRST), _file(totals, "word", TOTALS))
    probes = packed(rows).filter("not trains").select(
        "shard", F.pmod(F.xxhash64("data"), F.lit(tasks)).alias("task"), F.lit(False).alias("model"), "n", "data", "docs")
    copies = model.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task"),
                          F.lit(True).alias("model"), F.col("n").cast("int").alias("n"), "data", F.lit(b"").alias("docs"))
    met = copies.unionByName(probes).repartition("shard", "task").sortWithinPartitions(
        "shard", "task", F.col("model").desc()).mapInArrow(_score(tables), SCORES)
    sums = met.groupBy("key").agg(F.sum("log_p").alias("log_p"), F.sum("n").alias("n"))
    return rows.drop("text").join(sums, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def classify(documents: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             quantiles: tuple[float, float] = QUANTILES, prior: int = PRIOR_WORDS, min_trusted: int = MIN_TRUSTED,
             **options) -> DataFrame:
    """``key, doc_id, lang, perplexity, score, low, high, kept`` for each row.

    ``trusted`` has the ids of trusted documents in its first column. ``score``
    is the mean negative log probability with ``prior`` words at the language's
    mean mixed in, so a few words say little. A document is kept if its score
    lies between its language's quantiles. With ``n`` trusted documents a
    language's own mean and quantiles have the weight ``n / (n + min_trusted)``
    and those of all the rest, at every size; only a language without any
    trusted document is judged by those of all alone. Texts
    without words are not kept. A null language is a language of its own;
    repeated rows get equal results; without trusted documents nothing can be
    judged and all documents with words are kept; other columns are ignored.
    """
    rows = cut(scores(documents, trusted, key, text, lang, **options))
    sample = rows.filter("trusted and n > 0").withColumn("mean", -F.col("log_p") / F.col("n"))
    named = lambda df: df.withColumn("__llm_lang", F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("null")))
    # Written tables have known sizes, so those of a few languages are broadcast and long ones are not.
    means = cut(named(sample).groupBy("__llm_lang").agg(F.avg("mean").alias("own_mean"), F.count("*").alias("own_n")))
    overall = sample.agg(F.avg("mean").alias("all_mean"))
    weight = F.col("own_n") / (F.col("own_n") + min_trusted)
    blend = lambda own, whole: F.col(whole) + F.coalesce((F.col(own) - F.col(whole)) * weight, F.lit(0.0))
    centred = named(rows).join(means, "__llm_lang", "left").join(F.broadcast(overall)).withColumn("centre", blend("own_mean", "all_mean"))
    centre = F.coalesce("centre", F.lit(0.0))
    scored = cut(centred.withColumn("score", F.when(
        F.col("n") > 0, (centre * prior - F.col("log_p")) / (F.col("n") + prior))))
    judged = scored.filter("trusted and n > 0")
    bounds = lambda names: [F.percentile_approx("score", float(q), 10_000).alias(c) for q, c in zip(quantiles, names)]
    own = cut(judged.groupBy("__llm_lang").agg(*bounds(("own_low", "own_high"))))
    whole = judged.agg(*bounds(("all_low", "all_high")))
    done = scored.join(own, "__llm_lang", "left").join(F.broadcast(whole)).withColumns({
        "low": blend("own_low", "all_low"), "high": blend("own_high", "all_high")})
    inside = F.coalesce((F.col("score") >= F.col("low")) & (F.col("score") <= F.col("high")), F.lit(True))
    return done.select(
        "key", "doc_id", "lang", F.col("n").alias("n_words"),
        F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n"))).alias("perplexity"), "score", "low", "high",
        ((F.col("n") > 0) & inside).alias("kept"))


def keep(documents: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
         **options) -> DataFrame:
    """The kept documents with all their columns."""
    good = classify(documents, trusted, key, text, lang, **options).filter("kept").select(F.col("key").alias("__llm_good")).distinct()
    return documents.join(good, _key(key, text) == F.col("__llm_good"), "left_semi")
