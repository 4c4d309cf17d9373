"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (one to three letters of a word that is padded with a blank at
either end) from the most frequent on. A document's own list is compared to each profile by out-of-place distance: the
sum over its n-grams of how far the ranks lie apart, with a fixed largest distance for n-grams that a profile lacks. The
nearest profile names the language.

Plan: profiles come from one pass over all labelled training texts, counted inside tasks and summed by (language,
n-gram); of each language the first TOP are taken by one window whose limit is pushed below the shuffle. They are a bounded table, sent to the pass that
predicts, which has no shuffle. N-grams are counted on arrays for many documents at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlework.llm._bytes import buffers, chunks
from candlework.llm._store import Scratch

#: N-grams in a profile and in a document's list.
TOP = 300
UNDETERMINED = "und"
_END = 0x20000
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Lower-case code point of each letter, 0 for what isn't one; letters beyond the table stand for themselves."""
    if not _letters:
        out = np.zeros(_END + 1, np.int64)
        for c in range(_END):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def fold(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    out = letter_table()[np.minimum(points, _END)]
    for c in np.unique(points[points >= _END]):
        if unicodedata.category(chr(c))[0] == "L":
            out[points == c] = c
    return out


def counted(letters: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, n-gram and count of each n-gram that occurs in a group, in ascending order of group and n-gram.

    letters: as from fold, with a 0 at either end and between texts; group: of each of them. An n-gram is a number: its
    length, then three fields of 20 bits with its letters at the end.
    """
    known = np.unique(letters[letters > 0])
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = len(known) + 1
    dense = np.searchsorted(known, letters) + 1
    dense[letters == 0] = 0
    a, b, c = dense[:-2], dense[1:-1], dense[2:]
    mid = b > 0
    size = 3 * base**3
    g = group[1:-1][mid] * size
    a, b, c = a[mid], b[mid], c[mid]
    pairs = np.flatnonzero(a == 0)  # of a word's first letter, the pair with the blank before it too
    keys = np.concatenate((g + b, g + base**3 + b * base + c, (g + base**3 + b)[pairs], g + 2 * base**3 + (a * base + b) * base + c))
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(first, len(keys)))
    row, code = np.divmod(keys[first], size)
    length, code = np.divmod(code, base**3)
    real = np.append(0, known) & 0xFFFFF
    x, rest = np.divmod(code, base * base)
    y, z = np.divmod(rest, base)
    return row, (length + 1) << 60 | real[x] << 40 | real[y] << 20 | real[z], n


def _chunk(column: pa.Array):
    data, offsets = buffers(column)
    for low, high in chunks(offsets):
        at = offsets[low : high + 1].tolist()
        texts = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        sizes = np.array([len(t) + 1 for t in texts])
        letters = fold("\n" + "\n".join(texts) + "\n")
        group = np.append(0, np.repeat(np.arange(len(texts)), sizes))
        yield low, high, letters, group


def profiles(docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """Rows (lang, gram, rank): the most frequent n-grams of all texts of each language; ties go by n-gram.

    Rows whose text or language is null teach nothing; a language whose texts have no letters has no rows.
    """

    def count(batches):
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1).dictionary_encode()
            names = langs.dictionary
            which = langs.indices.to_numpy(zero_copy_only=False)
            for low, high, letters, group in _chunk(texts):
                row, gram, n = counted(letters, which[low:high].astype(np.int64)[group])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Of each language the first n-grams; rows of a language are its distinct n-grams, and a window with a limit on its
    # rank keeps top rows a task before it shuffles.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = sums.withColumn("rank", place).where(F.col("rank") <= top).select("lang", "gram", (F.col("rank") - 1).alias("rank"))
    return Scratch(docs.sparkSession, "profiles").keep(best, "profiles")


class Matcher:
    """Compares texts to profiles, which are TOP rows a language at most."""

    def __init__(self, known: DataFrame, top: int):
        rows = known.collect()
        self.top = top
        self.names = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for name, gram, rank in rows:
            self.ranks[self.names.index(name), np.searchsorted(self.grams, gram)] = rank

    def __call__(self, texts: pa.Array):
        """Low and high row, language number (as many as there are: undetermined) and score, for all ranges of rows."""
        names, grams, top = self.names, self.grams, self.top
        for low, high, letters, group in _chunk(texts):
            n = high - low
            row, gram, times = counted(letters, group)
            order = np.argsort(row * (1 << 32) - times, kind="stable")
            row, gram = row[order], gram[order]
            first = np.searchsorted(row, np.arange(n))
            rank = np.arange(len(row)) - first[row]
            kept = rank < top
            row, gram, rank = row[kept], gram[kept], rank[kept]
            length = np.bincount(row, minlength=n)
            at = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
            if len(grams):
                at = np.where(grams[at] == gram, at, len(grams))
            distance = np.full((len(names) + 1, n), np.inf)
            for k in range(len(names)):
                there = self.ranks[k][at]
                distance[k] = np.bincount(row, weights=np.where(there >= 0, np.abs(there - rank), top), minlength=n)
            best = distance[:-1].argmin(0) if names else np.zeros(n, np.int64)
            none = (length == 0) | (not names)
            score = np.where(none, 0.0, 1 - np.where(none, 0.0, distance[best, np.arange(n)]) / np.maximum(length * top, 1))
            yield low, high, np.where(none, len(names), best), score


def identify(docs: DataFrame, known: DataFrame, *, doc_id: str = "doc_id", text: str = "text", top: int = TOP) -> DataFrame:
    """Per row: doc_id, lang_pred, score.

    score is 1 less the out-of-place distance as a share of the largest possible: 1 where both lists agree. A null text,
    one without letters, and every text if no profile is known, is ``und`` with score 0. Of equally near languages the
    first by name is taken. Ids may be null or repeat: every row has its result.
    """
    match = Matcher(known, top)
    values = pa.array([*match.names, UNDETERMINED])

    def predict(batches):
        for batch in batches:
            for low, high, best, score in match(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), values.take(pa.array(best)), pa.array(score)], [doc_id, "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(predict, f"`{doc_id}` {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, known: DataFrame, *, text: str = "text", least: float = 0.2, top: int = TOP) -> DataFrame:
    """The rows, with all their columns, whose text is in a known language: not ``und``, and with a score of least or more."""
    match = Matcher(known, top)

    def choose(batches):
        for batch in batches:
            for low, high, best, score in match(batch.column(batch.schema.get_field_index(text))):
                yield batch.slice(low, high - low).filter(pa.array((best < len(match.names)) & (score >= least)))

    return docs.mapInArrow(choose, docs.schema)


def is_held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
