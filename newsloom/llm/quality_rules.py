"""Quality rules: figures of a text, and lines that many documents of a host share.

Cross-document line frequency: normalised lines are hashed, each line counts
the documents of its host that hold it, lines above the host's limit are
taken out, and a document that loses more than half of its words to that is
rejected. Only DataFrame functions; all per-text work is done on arrays inside
the row, and only hashes and counts are shuffled. Equal texts of a host are
combined before the lines are counted, each with the number of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.once import compute_once
from newsloom.session import cut

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCUMENTS = 10       # a line in no more documents of a host than this is never taken out
HOST_PER_MILLE = 1       # nor one in no more than this share of the host's documents
MAX_REMOVED_PERCENT = 50


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def figures(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    Null counts as empty. Runs of three words are compared by 64-bit hashes of
    their words; their places are sorted within the row only where a run repeats.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = compute_once(rows, __llm_words=split_words(body))
    w = F.col("__llm_words")
    runs = F.when(F.size(w) >= 3, F.transform(
        F.arrays_zip(F.slice(w, 1, F.size(w) - 2).alias("a"), F.slice(w, 2, F.size(w) - 2).alias("b"),
                     F.slice(w, 3, F.size(w) - 2).alias("c")), lambda x: F.xxhash64(x))
    ).otherwise(F.array().cast("array<bigint>"))
    with_word = F.filter(F.split(body, "\n"), lambda x: _without(x, SPACES) != "")
    rows = compute_once(
        rows.withColumn("n_words", F.size(w).cast("long")),
        __llm_runs=runs, __llm_lines=F.transform(with_word, lambda x: F.xxhash64(x)),
        word_chars=F.length(_without(body, SPACES)).cast("long"),
        n_symbols=(F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
    ).drop("__llm_words")
    # Runs in order of hash and place, only where some run repeats.
    repeats = F.size(F.array_distinct("__llm_runs")) < F.size("__llm_runs")
    placed = F.sort_array(F.transform("__llm_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = compute_once(rows, __llm_placed=F.when(repeats, placed),
                        n_dup_lines=(F.size("__llm_lines") - F.size(F.array_distinct("__llm_lines"))).cast("long")).drop("__llm_runs", "__llm_lines")
    s = F.col("__llm_placed")
    again = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    rows = compute_once(rows, __llm_at=F.sort_array(F.transform(again, lambda x: x["i"]))).drop("__llm_placed")
    p = F.col("__llm_at")
    gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__llm_at")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACE, " "))


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("null"))


def shared_lines(rows: DataFrame, host: str = "source", text: str = "text",
                 min_documents: int = MIN_DOCUMENTS, per_mille: int = HOST_PER_MILLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of each distinct text (``_host, _text, _line, _words``), those above their
    host's limit (``_host, _line, n_docs``), and the documents of each text (``_copies``).

    ``__llm_words`` sums over all rows with that host and text; a line without a
    word is no line. Every row is a document, copies too, so the lines of a page
    that was crawled often are common lines.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = rows.select(_host(host).alias("__llm_host"), F.xxhash64(body).alias("__llm_text"),
                        F.explode(F.split(body, "\n")).alias("__llm_raw"))
    lines = compute_once(named, __llm_norm=normalised(F.col("__llm_raw"))).filter("__llm_norm != ''").select(
        "__llm_host", "__llm_text", F.xxhash64("__llm_norm").alias("__llm_line"),
        (F.length("__llm_norm") - F.length(F.translate("__llm_norm", " ", "")) + 1).cast("long").alias("__llm_n"))
    table = cut(lines.groupBy("__llm_host", "__llm_text", "__llm_line").agg(F.sum("__llm_n").alias("__llm_words")))
    copies = cut(rows.select(_host(host).alias("__llm_host"), F.xxhash64(body).alias("__llm_text")).groupBy(
        "__llm_host", "__llm_text").agg(F.count("*").alias("__llm_copies")))
    hosts = copies.groupBy("__llm_host").agg(F.sum("__llm_copies").alias("__llm_docs"))
    limit = F.greatest(F.lit(min_documents), F.floor(F.col("__llm_docs") * per_mille / F.lit(1000)))
    common = table.join(copies, ["__llm_host", "__llm_text"]).groupBy("__llm_host", "__llm_line").agg(
        F.sum("__llm_copies").alias("n_docs")).filter(
        F.col("n_docs") > min_documents).join(hosts, "__llm_host").filter(F.col("n_docs") > limit)
    return table, common.select("__llm_host", "__llm_line", "n_docs"), copies


def judge(rows: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """``rows`` without their text, with the figures, ``removed_words`` and ``kept``.

    A row is kept if the base rules pass and the shared lines take at most
    half of its words. Null texts are empty and fail; a null host is a host of
    its own; repeated rows get equal verdicts; an empty table gives no rows.
    Input columns named like a result are replaced.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               "base_failed", "removed_words", "kept"]
    plain = rows.drop(*results)
    table, common, copies = shared_lines(plain, host, text, **limits)
    lost = table.join(common, ["__llm_host", "__llm_line"]).groupBy("__llm_host", "__llm_text").agg(F.sum("__llm_words").alias("__llm_lost"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lost = lost.join(copies, ["__llm_host", "__llm_text"]).select(
        "__llm_host", "__llm_text", F.expr("__llm_lost div __llm_copies").alias("removed_words"))
    keyed = figures(plain.withColumns({"__llm_host": _host(host), "__llm_text": F.xxhash64(body)}), text).drop(text)
    share = F.col("removed_words") * 100 <= F.col("n_words") * MAX_REMOVED_PERCENT
    return (
        keyed.join(lost, ["__llm_host", "__llm_text"], "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & share)
        .drop("__llm_host", "__llm_text")
    )


def apply(rows: DataFrame, host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The kept rows with all their columns, their texts without the lines above their host's limit.

    The words taken out of a text are the ``removed_words`` of ``judge``. Only
    places of lines are shuffled; texts without such lines stay as they are.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.split(body, "\n")
    _, common, _ = shared_lines(rows, host, text, **limits)
    named = rows.select(_host(host).alias("__llm_host"), F.xxhash64(body).alias("__llm_text"), F.posexplode(lines).alias("__llm_pos", "__llm_raw"))
    placed = compute_once(named, __llm_line=F.xxhash64(normalised(F.col("__llm_raw")))).drop("__llm_raw")
    out = placed.join(common, ["__llm_host", "__llm_line"]).groupBy("__llm_host", "__llm_text").agg(
        F.sort_array(F.collect_set("__llm_pos")).alias("__llm_out"))
    # The verdict drops the text, so the lines go along under another name.
    carried = rows.withColumns({"__llm_body": F.col(f"`{text}`"), "__llm_row": F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != text])})
    good = judge(carried, host, text, **limits).filter("kept").select("__llm_row", "__llm_body").withColumns({
        "__llm_host": F.coalesce(F.concat(F.lit("h"), F.col("__llm_row")[host].cast("string")), F.lit("null")),
        "__llm_text": F.xxhash64("__llm_body")})
    split, cuts = F.split("__llm_body", "\n"), F.col("__llm_out")
    pieces = F.transform(F.concat(F.array(F.lit(-1)), cuts), lambda at, i: F.slice(
        split, at + 2, F.coalesce(F.get(cuts, i), F.size(split)) - at - 1))
    cleaned = F.when(cuts.isNull(), F.col("__llm_body")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return good.join(out, ["__llm_host", "__llm_text"], "left").select(
        *[cleaned.alias(c) if c == text else F.col("__llm_row")[c].alias(c) for c in rows.columns])
