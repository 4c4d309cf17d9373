"""Benchmark decontamination by winnowing.

Of every window of consecutive k-grams the one with the smallest hash is kept as a fingerprint, for documents and for
benchmark items alike. Which one that is depends on the window's words alone, so two texts that share a span of
``k + window - 1`` words keep the same fingerprint inside it: no such span is missed. Fingerprints are joined, and each
hit is extended to both sides over the words themselves, which also proves it.

An item of fewer words than the guaranteed span is one window by itself; its k-gram is all its words, and documents then
keep every k-gram of that length (a window of one k-gram).

Plan: documents are read once. Each row keeps its fingerprints that show in a bitmap of the benchmark's fingerprints
(fixed size, see _bitmap), with the words around them. These few are joined to the benchmark's by hash; Spark broadcasts
that side if it is small and else shuffles both. Results are gathered by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlework.llm import _bitmap
from candlework.llm._bytes import ALPHANUMERIC, Words, buffers, chunks, grams, mix

#: A shared span of SPAN words is always found: K + (SPAN - K + 1) - 1.
SPAN, K = 10, 5
LEAD = SPAN - K
_CONTEXT = "array<string>"


def _winnowed(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the fingerprints for spans of length words."""
    k = K if length == SPAN else length
    window = length - k + 1
    g = grams(hashes, k, seed=length)
    windows = len(hashes) - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row_end = np.repeat(words.bounds[1:], words.counts)
    inside = np.flatnonzero(np.arange(windows) + length <= row_end[:windows])  # windows that don't leave their row
    best, arg = g[inside], inside.copy()
    for j in range(1, window):
        other = g[inside + j]
        less = other <= best  # of equal ones the last
        best, arg = np.where(less, other, best), np.where(less, inside + j, arg)
    arg = np.unique(arg)
    return arg, g[arg]


def _around(words: Words, row: int, first: int, length: int, pad: str) -> list[str]:
    """The words of a fingerprint and, for long spans, LEAD more to each side; pad stands for what isn't there."""
    low, high = (first - LEAD, first + K + LEAD) if length == SPAN else (first, first + length)
    a, b = words.bounds[row], words.bounds[row + 1]
    return [words.word(i) if a <= i < b else pad for i in range(low, high)]


def _item_fingerprints(batches):
    for batch in batches:
        out = []
        data, offsets = buffers(batch.column(1))
        for low, high in chunks(offsets):
            words = Words(data, offsets, low, high, ALPHANUMERIC)
            hashes = words.hashes()
            ids = batch.column(0).slice(low, high - low).to_pylist()
            for row, n in enumerate(words.counts.tolist()):
                if 0 < n < SPAN:
                    first = int(words.bounds[row])
                    h = grams(hashes[first : first + n], n, seed=n)[0]
                    out.append((h, n, ids[row], _around(words, row, first, n, "")))
            firsts, found = _winnowed(words, hashes, SPAN)
            rows = np.searchsorted(words.bounds, firsts, "right") - 1
            out += [(h, SPAN, ids[row], _around(words, row, first, SPAN, "\x01")) for first, h, row in zip(firsts.tolist(), found, rows.tolist())]
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(columns[0], np.uint64).view(np.int64)), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.string()))],
            ["fp", "span", "item", "fp_words"],
        )


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", row_key: tuple[Column, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (ids as sorted strings), spans (hit word ranges), contaminated.

    Words are runs of ASCII letters and digits and of all characters above U+007F, A-Z lower-cased. A span of SPAN words
    of an item, or a whole shorter item, that occurs in a document hits its words there; spans are half-open word ranges,
    which may overlap. A null or empty text has no words. Rows that repeat both id and text give one result row; with a
    row_key, columns that together tell all rows apart, every row has its result and those columns, as key_0, key_1 and
    so on. Items without words never occur; items with a null id hit words but are not listed. An empty benchmark hits
    nothing. Other columns of the inputs are not looked at.
    """
    spark = docs.sparkSession
    extra = [f"key_{i}" for i in range(len(row_key))]
    found = items.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).mapInArrow(_item_fingerprints, f"fp long, span int, item string, fp_words {_CONTEXT}")
    prints = found.groupBy("fp", "span", "fp_words").agg(F.collect_set("item").alias("fp_items"))
    shown = spark.sparkContext.broadcast(_bitmap.build(found.select("fp"), "fp"))
    spans = sorted(r[0] for r in found.select("span").distinct().collect())  # at most SPAN numbers

    def fingerprints(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for low, high in chunks(offsets):
                words = Words(data, offsets, low, high, ALPHANUMERIC)
                hashes = words.hashes()
                kept = [[] for _ in range(high - low)]
                for length in spans:
                    firsts, prints = _winnowed(words, hashes, length)
                    here = _bitmap.shows(shown.value, prints)
                    firsts, prints = firsts[here], prints[here]
                    rows = np.searchsorted(words.bounds, firsts, "right") - 1
                    for first, h, row in zip(firsts.tolist(), prints.view(np.int64).tolist(), rows.tolist()):
                        kept[row].append({"h": h, "at": first - int(words.bounds[row]), "words": _around(words, row, first, length, "\x02")})
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.arange(len(hashes), dtype=np.uint64)))))
                key = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
                same = [batch.column(i).slice(low, high - low) for i in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(key.view(np.int64)), pa.array(words.counts.astype(np.int64)), pa.array(kept, pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("words", pa.list_(pa.string()))])))],
                    ["id", *extra, "text_key", "n_words", "kept"],
                )

    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"), *[c.cast("long").alias(x) for c, x in zip(row_key, extra)])
    kinds = ", ".join([f"id {plain.schema['id'].dataType.simpleString()}", *[f"{x} long" for x in extra]])
    rows = plain.mapInArrow(fingerprints, f"{kinds}, text_key long, n_words long, kept array<struct<h: long, at: long, words: {_CONTEXT}>>")
    one = rows.select("id", *extra, "text_key", "n_words", F.explode_outer("kept").alias("kept"))
    # A row without fingerprints keeps a key of its own: many nulls would meet in one task.
    one = one.select("id", *extra, "text_key", "n_words", F.coalesce("kept.h", F.xxhash64("id", *extra, "text_key")).alias("h"), F.col("kept.at").alias("at"), F.col("kept.words").alias("words"))
    joined = one.join(prints, one.h == prints.fp, "left")

    same = F.zip_with("words", "fp_words", lambda a, b: F.coalesce(a == b, F.lit(False)))
    lead = F.when(F.col("span") == SPAN, LEAD).otherwise(0)
    core = F.when(F.col("span") == SPAN, K).otherwise(F.col("span"))

    def run(flags):
        """How many are true before the first that is false."""
        return F.aggregate(
            flags,
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
            lambda s, x: F.struct((s["n"] + F.when(s["open"] & x, 1).otherwise(0)).alias("n"), (s["open"] & x).alias("open")),
            lambda s: s["n"],
        )

    joined = joined.withColumns({"same": same, "lead": lead, "core": core})
    joined = joined.withColumns({"left": run(F.reverse(F.slice("same", 1, F.col("lead")))), "right": run(F.slice("same", F.col("lead") + F.col("core") + 1, F.col("lead")))})
    hit = F.forall(F.slice("same", F.col("lead") + 1, F.col("core")), lambda x: x) & (F.col("left") + F.col("core") + F.col("right") >= F.col("span"))
    hit = hit & F.col("fp").isNotNull() & (F.size("words") == F.size("fp_words"))
    span = F.struct((F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("core") + F.col("right")).alias("end"))
    whole = joined.groupBy("id", *extra, "text_key", "n_words").agg(F.array_sort(F.collect_set(F.when(hit, span))).alias("spans"), F.collect_set(F.when(hit, F.col("fp_items"))).alias("sets"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n")),
        lambda s: s["n"],
    )
    listed = F.array_sort(F.array_distinct(F.flatten("sets")))
    out = whole.select(F.col("id").alias(doc_id), *extra, "n_words", covered.alias("n_hit"), listed.alias("items"), "spans")
    return out.select(doc_id, *extra, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))
