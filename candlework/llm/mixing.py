"""Mixing sources to target weights by repetition.

Words are summed for each source; targets follow from weights; a source's repetition rate is target over size. Each
document is emitted floor(rate) times, and once more if a hash of its id, seeded and uniform on [0, 1), is below the
rest. So the result doesn't depend on partitions or reruns, and no row needs to see another.

Plan: one aggregation by source (partial sums inside tasks, so a hot source is one row a task) makes a written table of
sources, however many there are. Their places in code point order come from a range partition and the partitions' counts;
the level of the targets from sums over the table, round by round as the excess is reshared. The driver sees a row for
each partition and two sums a round. Texts are read a second time to join their source's rate; Spark broadcasts the
sources where they are few and splits hot ones where it has to shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlework.llm._store import Scratch

#: Weights of sources in code point order, repeating; a source is repeated REPEAT times at most.
WEIGHTS = (5, 2, 1)
REPEAT = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, text: str = "text", source: str = "source", weights=WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(of, n, target): of each source its words and its target.

    Targets share all words by weight, each at most repeat times the source's words. What is over a limit goes to the
    others by weight, round by round until none is above; so there is one level such that each target is the smaller of
    its limit and weight times level.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sums = docs.select(F.col(source).cast("string").alias("of"), size(text).alias("n")).groupBy("of").agg(F.sum("n").alias("n"))
    sums = scratch.keep(sums, "sums")
    # Places in order: the partition's number stands above bit 33, the place inside it below.
    ordered = sums.repartitionByRange(F.col("of").asc_nulls_last()).sortWithinPartitions(F.col("of").asc_nulls_last())
    ordered = scratch.keep(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33).cast("int")
    counts = sorted(ordered.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before, base = 0, []
    for number, n in counts:
        base.append((number, before))
        before += n
    bases = docs.sparkSession.createDataFrame(base or [(0, 0)], "part int, before long")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.array(*[F.lit(w) for w in weights])[(place % len(weights)).cast("int")]
    weighed = scratch.keep(ordered.withColumn("part", part).join(F.broadcast(bases), "part").select("of", "n", weight.cast("long").alias("w")), "weighed")
    words, open_weight = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    exact = lambda c, k: c.cast("decimal(38,0)") * F.lit(k).cast("decimal(19,0)")
    rest, free = words, open_weight
    while free:
        over = exact(F.col("n") * repeat, free) <= exact(F.col("w"), rest)
        stopped, by = weighed.where(over).agg(F.coalesce(F.sum(F.col("n") * repeat), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if (words - stopped, open_weight - by) == (rest, free):
            break
        rest, free = words - stopped, open_weight - by
    limit = (F.col("n") * repeat).cast("double")
    share = (F.col("w") * F.lit(rest)).cast("double") / F.lit(float(free)) if free else limit
    over = exact(F.col("n") * repeat, free) <= exact(F.col("w"), rest)
    return weighed.select("of", "n", F.when(over, limit).otherwise(share).alias("target"))


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A uniform number on [0, 1) from 52 bits of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, repeat: int = REPEAT, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, copies, taken (size times copies).

    Size is the number of words, 0 for a null text. A null source is a source of its own, the last. Rows that repeat an
    id get the same draw. A source without words has target 0 and copies 0.
    """
    one = docs.select(F.col(doc_id), F.col(source).cast("string").alias("mix_source"), size(text).alias("size"))
    table = targets(docs, text, source, weights, repeat).withColumnRenamed("n", "source_size")
    both = one.join(table, one.mix_source.eqNullSafe(table.of))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(draw(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)
    both = both.withColumn("copies", copies.cast("int"))
    return both.select(doc_id, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns; a document with no words may be left out.

    Nulls and repeated rows are drawn as in mix.
    """
    weights, repeat, seed = how.get("weights", WEIGHTS), how.get("repeat", REPEAT), how.get("seed", SEED)
    rate = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0)
    table = targets(docs, text, source, weights, repeat).select("of", rate.alias("rate"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source).cast("string").alias("source"), draw(doc_id, seed).alias("draw"))
    both = row.join(table, F.col("source").eqNullSafe(F.col("of")))
    copies = (F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return both.select("doc", F.explode(F.array_repeat(F.lit(0), copies))).select("doc.*")
