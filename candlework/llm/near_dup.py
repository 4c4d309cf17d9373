"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch. In round i every shingle is thrown into one of T bins by the round's hash and leaves the value (i, hash) there;
a bin keeps the smallest. After T rounds, round T + j throws every shingle into bin j, so each bin fills whatever the
size of the set; a set stops at the first round that leaves no bin empty, which takes about (T ln T) / size rounds.
Coordinates agree with probability equal to the Jaccard similarity, and their sum is concentrated as if they were
independent.

Bands. The T coordinates make BANDS bands of ROWS; documents that share a band are candidates. At the least similarity
that counts, 0.8, a pair shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, about 4e-6.

Verification is on full sets. Equal sets are one class from the start. In each band's bucket every class is compared to
one pivot only, the class that meets most others in its buckets (of copies, that is their original); the links found make
components. A bucket that still holds several components gets a reference p, the most central pivot that any of its classes
has met, and its classes are compared by their differences from p: with Dx the shingles that only one of x and p has, x and
y are linked if and only if Dx and Dy share ``(9 |Dx| - |x| + 9 |Dy| - |y|) / 18`` shingles or more. If x isn't linked to p
that is above 0, and it is about half of Dx, whatever y is: so the two must share one of a prefix of their differences,
about half of each, which is taken in order of rarity. Classes of different components that do are verified. So no link
between classes that share a bucket is lost, and copies that differ from their original in unlike places meet nowhere,
however many they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.llm import _bitmap
from candlework.llm._bytes import BLANK_SEPARATED, Words, buffers, chunks, grams, mix
from candlework.llm._components import components
from candlework.llm._store import Scratch

BANDS, ROWS = 42, 6
T = BANDS * ROWS


def _sets(words: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, one row after another; and the bounds of the rows."""
    hashes = words.hashes()
    rows = len(words.counts)
    row = np.repeat(np.arange(rows), words.counts)
    parts, owners = [], []
    for n in range(1, shingle + 1):
        g = grams(hashes, n, seed=n)
        at = np.arange(len(g))
        if n == shingle:
            at = at[at + n <= words.bounds[1:][row[: len(g)]]] if len(g) else at
        else:  # texts of so many words: the whole sequence
            at = words.bounds[:-1][words.counts == n]
        parts.append(g[at])
        owners.append(row[at])
    h, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(rows + 1))


def sketches(h: np.ndarray, bounds: np.ndarray, t: int = T) -> np.ndarray:
    """Rows of t coordinates; those of an empty set are all ones."""
    rows = len(bounds) - 1
    sizes = np.diff(bounds)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * t, none, np.uint64)
    owner = np.repeat(np.arange(rows), sizes)
    open_rows = sizes > 0
    for i in range(2 * t):
        if i:
            keep = open_rows[owner]
            if not keep.all():
                h, owner = h[keep], owner[keep]
        if not len(h):
            break
        x = mix(h ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = (((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t)
        value = np.uint64(i << 50) | (mix(x) >> np.uint64(14))
        np.minimum.at(out, owner * t + bins, value)
        if i >= t - 1 or i % 4 == 0 or i < 4:
            open_rows = (out.reshape(rows, t) == none).any(1) & open_rows
    return out.reshape(rows, t)


def _bands(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each sketch."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), 1))
    part = sketch.reshape(len(sketch), bands, rows)
    for j in range(rows):
        key = mix(key ^ part[:, :, j])
    return key.view(np.int64)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, bands: int = BANDS, rows: int = ROWS, row_key: tuple[Column, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept; with a row_key, those columns as key_0, key_1 and so on.

    A document's set is its distinct shingles of so many words (runs of other characters than ASCII white space, A-Z
    lower-cased), of a shorter text all its words as one. Two documents are linked if intersection over union is 0.8 or
    more. component_id is the smallest id that links lead to, kept is whether that is the document's own. A null text or
    one without words has an empty set and is linked to nothing. Rows are linked by their texts only, also if they share
    an id. A null id is never the smallest; if a component has no other, its component_id is null and kept is false.

    With a row_key, longs that together tell all rows apart, kept is true for one row of each component: the one with the
    smallest id, nulls last, then the smallest key. Rows with empty sets are all kept then.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    t = bands * rows
    extra = [f"key_{i}" for i in range(len(row_key))]

    def sketch(batches):
        made = TaskContext.get().partitionId() << 33  # the table that this writes numbers its rows
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for low, high in chunks(offsets):
                h, bounds = _sets(Words(data, offsets, low, high, BLANK_SEPARATED), shingle)
                sums = []
                for seed in (1, 2):  # 128 bits that tell a set
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(seed)))))
                    sums.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
                keys = _bands(sketches(h, bounds, t), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
                same = [batch.column(i).slice(low, high - low) for i in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(made, made + high - low)), pa.array(np.diff(bounds)), *sums, lists], ["id", *extra, "num", "n", "s1", "s2", "bands"])
                made += high - low

    plain = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"), *[c.cast("long").alias(x) for c, x in zip(row_key, extra)])
    every = scratch.keep(plain.mapInArrow(sketch, ", ".join(["id long", *[f"{x} long" for x in extra], "num long, n long, s1 long, s2 long, bands array<long>"])), "sketches")

    # Classes of equal sets. A class is known by the smallest number of its rows; own is its smallest id.
    classes = every.where("n > 0").groupBy("s1", "s2").agg(F.min("num").alias("cls"), F.min("id").alias("own"))
    classes = scratch.keep(classes, "classes")
    first = F.when(F.col("num") == F.col("cls"), F.col("bands")).alias("bands")
    member = scratch.keep(every.where("n > 0").join(classes, ["s1", "s2"]).select("id", *extra, "n", "cls", "own", first), "members")
    empty = every.where("n = 0").select("id", *extra, "n")

    # Buckets with several classes, and the classes in them.
    keys = member.where("bands is not null").select("cls", "bands")
    band = keys.select("cls", F.explode("bands").alias("key"))
    buckets = band.groupBy("key").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count(F.lit(1)).alias("size")).where("least < most").select("key", "size")
    buckets = scratch.keep(buckets, "buckets")
    shown = spark.sparkContext.broadcast(_bitmap.build(buckets, "key"))

    def in_buckets(batches):
        for batch in batches:
            keys = batch.column(1)
            cut = keys.offsets.to_numpy()
            values = keys.values.to_numpy(zero_copy_only=False)
            at = np.flatnonzero(_bitmap.shows(shown.value, values[cut[0] : cut[-1]])) + cut[0]
            row = pa.array(np.searchsorted(cut, at, "right") - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(values[at])], ["cls", "key"])

    few = keys.mapInArrow(in_buckets, "cls long, key long")
    bucketed = scratch.keep(few.join(buckets, "key").select("key", "size", "cls").distinct(), "bucketed")
    central = scratch.keep(bucketed.groupBy("cls").agg(F.sum("size").alias("central")), "central")
    pivots = bucketed.join(central, "cls").groupBy("key").agg(F.max(F.struct("central", "cls"))["cls"].alias("pivot"))
    pivots = scratch.keep(pivots, "pivots")
    bucketed = scratch.keep(bucketed.join(pivots, "key").select("key", "pivot", "cls"), "pivoted")

    # Full sets of the classes in buckets, by bitmaps again so that few other texts are shuffled: of a class, the rows with
    # its smallest id are read, and one of these is taken.
    involved = scratch.keep(classes.join(central.select("cls"), "cls", "left_semi"), "involved")
    needed = spark.sparkContext.broadcast((_bitmap.build(involved, "own"), _bitmap.build(involved, "s1")))

    def full_sets(batches):
        for batch in batches:
            ids, none = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(_bitmap.shows(needed.value[0], ids) | none)))
            data, offsets = buffers(batch.column(1))
            for low, high in chunks(offsets):
                h, bounds = _sets(Words(data, offsets, low, high, BLANK_SEPARATED), shingle)
                sums = []
                for seed in (1, 2):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(seed)))))
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                out = pa.RecordBatch.from_arrays([*map(pa.array, sums), lists], ["s1", "s2", "shingles"])
                yield out.filter(pa.array(_bitmap.shows(needed.value[1], sums[0]) & (np.diff(bounds) > 0)))

    sets = plain.select("id", "t").mapInArrow(full_sets, "s1 long, s2 long, shingles array<long>")
    sets = sets.join(involved.select("s1", "s2", "cls"), ["s1", "s2"]).groupBy("cls").agg(F.first("shingles").alias("shingles"))
    sets = scratch.keep(sets, "sets")

    def paired(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with their sets."""
        a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
        return pairs.join(a, "a").join(b, "b")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        both = paired(pairs).select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
        return scratch.keep(both.select("a", "b", "na", "common", (F.col("na") + F.col("nb") - F.col("common")).alias("whole")), name)

    star = scratch.keep(bucketed.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct(), "star")
    first = verified(star, "star-common")
    link = F.col("common") * 100 >= F.col("whole") * 80
    joined = components(scratch, first.where(link).select("a", "b"), "star")

    # Buckets that hold several components. Their references are the most central pivots that any of their classes has met,
    # so that a class gets few of them; classes that are linked to a reference count as of its component.
    placed = bucketed.join(joined.withColumnRenamed("v", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    placed = scratch.keep(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    still = placed.join(scratch.keep(open_keys, "open"), "key", "left_semi").join(central.withColumnRenamed("cls", "pivot"), "pivot")
    still = scratch.keep(still.select("key", "cls", "root", F.struct("central", "pivot").alias("met")), "still")
    best = scratch.keep(still.groupBy("cls").agg(F.max("met").alias("met")), "best")
    hubs = scratch.keep(still.select("key", "cls").join(best, "cls").groupBy("key").agg(F.max("met")["pivot"].alias("pivot")), "hubs")
    rest = scratch.keep(still.join(hubs, "key").where("cls <> pivot").select("cls", "pivot", "root").distinct(), "rest")
    again = verified(rest.select(F.col("cls").alias("a"), F.col("pivot").alias("b")), "rest-common")
    far = again.select(F.col("a").alias("cls"), F.col("b").alias("pivot"), F.col("na").cast("long").alias("n"), (F.col("whole") - F.col("common")).alias("d"), link.alias("linked"))
    rest = rest.join(far, ["cls", "pivot"]).join(joined.select(F.col("v").alias("pivot"), F.col("root").alias("of")), "pivot", "left")
    rest = rest.withColumns({"root": F.when(F.col("linked"), F.coalesce("of", "pivot")).otherwise(F.col("root")), "excess": F.col("d") * 9 - F.col("n")}).drop("of")
    rest = scratch.keep(rest, "measured")
    least = rest.groupBy("pivot").agg(F.min(F.when(F.col("linked"), F.col("excess"))).alias("least_in"), F.min(F.when(~F.col("linked"), F.col("excess"))).alias("least_out"))
    least = scratch.keep(least, "least")  # a row for each reference, so that its size is known to the next join
    # How many of its differences, in order, hold one that any partner shares: of those linked to the pivot, and the others.
    prefix = lambda other: F.coalesce(F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col(other)) / 18)), F.lit(0))
    rest = rest.join(least, "pivot").withColumns({"p_in": F.when(F.col("linked"), F.lit(0)).otherwise(prefix("least_in")), "p_out": prefix("least_out")})
    rest = scratch.keep(rest.where("p_in > 0 or p_out > 0").drop("least_in", "least_out"), "prefixes")
    both = paired(rest.withColumnsRenamed({"cls": "a", "pivot": "b"}))
    differ = both.select(F.col("a").alias("cls"), F.col("b").alias("pivot"), "p_in", "p_out", F.explode(F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))).alias("shingle"))
    differ = scratch.keep(differ, "differ")
    shared = scratch.keep(differ.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "shared")
    # Differences that no other class has come first and meet nothing, so only the shared ones are put in order.
    known = differ.join(shared, ["pivot", "shingle"])
    own = Window.partitionBy("pivot", "cls").orderBy("times", "shingle")  # of one class: as many as its shingles at most
    ranks = known.withColumn("place", F.row_number().over(own)).join(known.groupBy("pivot", "cls").agg(F.count(F.lit(1)).alias("n_shared")), ["pivot", "cls"])
    ranks = ranks.join(rest.select("pivot", "cls", "root", "n", "d", "linked"), ["pivot", "cls"]).withColumn("place", F.col("place") + F.col("d") - F.col("n_shared"))
    ranks = scratch.keep(ranks.where("place <= p_in or place <= p_out"), "ranks")
    other = ranks.where("place <= p_out").select("pivot", "shingle", *[F.col(c).alias(c + "2") for c in ("cls", "root", "n", "d", "linked")])
    near = (F.col("root") != F.col("root2")) & F.when(F.col("linked2"), F.col("place") <= F.col("p_in")).otherwise((F.col("place") <= F.col("p_out")) & (F.col("cls") < F.col("cls2")))
    near = near & (F.abs(F.col("d") - F.col("d2")) * 9 <= F.col("n") + F.col("n2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * 80)
    more = ranks.where("not linked").join(other, ["pivot", "shingle"]).where(near).select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()
    second = verified(scratch.keep(more, "more"), "more-common")
    edges = joined.select(F.col("v").alias("a"), F.col("root").alias("b")).unionAll(again.unionAll(second).where(link).select("a", "b"))
    final = components(scratch, edges, "all")

    # The smallest id of each component, whose root is one of its v; null ids don't count.
    least = final.join(classes.select(F.col("cls").alias("v"), "own"), "v").groupBy("root").agg(F.min("own").alias("component_id"))
    named = scratch.keep(final.join(least, "root").select(F.col("v").alias("cls"), "root", "component_id"), "named")
    whole = member.select("id", *extra, "n", "cls", "own").join(named, "cls", "left").withColumns({"root": F.coalesce("root", "cls"), "component_id": F.coalesce("component_id", "own")}).drop("cls", "own")
    if extra:
        whole = scratch.keep(whole, "whole")
        order = F.struct(F.col("id").isNull().alias("last"), "id", *extra)
        chosen = scratch.keep(whole.groupBy("root").agg(F.min(order).alias("one")).select(*[F.col("one")[x].alias(x) for x in extra], F.lit(True).alias("kept")), "chosen")
        whole = whole.join(chosen, extra, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    else:
        whole = whole.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    alone = empty.withColumns({"component_id": F.col("id"), "kept": F.lit(True) if extra else F.col("id").isNotNull()})
    columns = ["id", *extra, "n", "component_id", "kept"]
    out = whole.select(*columns).unionAll(alone.select(*columns))
    scratch.drop("buckets", "bucketed", "pivots", "pivoted", "central", "involved", "sets", "star", "placed", "open", "still", "best", "hubs", "rest", "measured", "least", "prefixes", "differ", "shared", "ranks", "more")
    return out.withColumnsRenamed({"id": doc_id, "n": "n_shingles"})
