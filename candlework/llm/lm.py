"""Language-model scoring by a weighted backoff automaton.

Model. n-gram counts of the training texts, smoothed by hierarchical Dirichlet priors:
``P(w | h) = (c(hw) + mu P(w | h')) / (c(h) + mu)``, h' being h without its first word, with a mu for each order, down to
``P(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))``. As an automaton, a state is a history of up to order - 1 tokens that training
texts hold. A seen n-gram is an arc that weighs its log probability; a state's failure arc leads to the shorter history
and weighs ``log mu / (c(h) + mu)``, so all that can follow a state sums to 1. A text is read once from left to right,
carrying the state: an arc is taken if there is one, else the failure arc, and the weights add up. Many texts are read
side by side. A long text is cut, and each piece begins order - 1 tokens early, which is all that its state depends on.

Plan. The automaton grows with the corpus, so no task holds it. Texts are packed into blocks of a few megabytes, a
written table. A block asks for the n-grams that it holds: one row for each shard of the n-gram space that it has any in,
with sorted keys and the block's own training counts. A shard adds up counts and answers each block in the block's order.
Blocks and answers meet by block, and the block is read through the part of the automaton that its texts can reach. Hot
n-grams are one key a block, so no task depends on how often a word occurs, and all that is shuffled is in proportion to
the blocks' distinct n-grams. Keys of single tokens have 64 bits; those of longer n-grams as many as make two of them
alike with a probability of 2 ** -MARGIN_BITS at most in a corpus of this size, 64 at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlework.llm._bytes import BLANK_SEPARATED, Words, buffers, mix
from candlework.llm._store import Scratch

#: Weights of the priors, for n-grams of two tokens, of three and so on; one more than they are is the order.
MUS = (3000.0, 30.0)
ADD = 0.1
BLOCK_BYTES = 4 << 20
#: Bytes of text for each shard of the n-gram space.
SHARD_BYTES = 4 << 20
MARGIN_BITS = 18
#: Tokens of a piece of text that is read by itself.
PIECE = 256
_END = np.uint64(0x5851F42D4C957F2D)


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed; of ascending keys, their differences."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _stretch(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


class Grams:
    """Keys of the n-grams that end at each token of a block's texts, keys[k] of those of k + 1 tokens."""

    def __init__(self, text: bytes, lengths: np.ndarray, order: int, bits: int):
        offsets = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
        words = Words(memoryview(text), offsets, 0, len(lengths), BLANK_SEPARATED)
        self.n_tokens = words.counts + 1
        ends = np.cumsum(self.n_tokens) - 1
        token = np.full(int(self.n_tokens.sum()), _END, np.uint64)
        at = np.ones(len(token), bool)
        at[ends] = False
        token[at] = words.hashes()
        self.row = np.repeat(np.arange(len(lengths)), self.n_tokens)
        self.first = ends - self.n_tokens + 1  # each text's first token
        self.place = np.arange(len(token)) - np.repeat(self.first, self.n_tokens)  # of a token in its text
        self.keys = [token]
        # Before a text's first token stands the end of another: the end token is the start of histories too.
        history = np.concatenate(([_END], token[:-1]))
        running = token
        for k in range(2, order + 1):
            running = mix(running * np.uint64(0x9E3779B97F4A7C15) + np.concatenate((np.full(k - 2, _END, np.uint64), history[: len(token) - k + 2])))
            self.keys.append(running >> np.uint64(64 - bits) << np.uint64(64 - bits))

    def real(self, k: int) -> np.ndarray:
        """Where keys[k] are of n-grams that begin at the start of their text at the earliest."""
        return self.place >= k - 1

    def asked(self, training: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of single tokens and of longer n-grams, all keys, ascending, how often each occurs in training texts, and which
        of them ends where: a row for each size, a column for each token, -1 where none does."""
        learn = training[self.row]
        out = []
        for sizes in ([0], list(range(1, len(self.keys)))):
            real = [self.real(k) for k in sizes]
            keys = np.concatenate([self.keys[k][r] for k, r in zip(sizes, real)])
            order = np.argsort(keys)
            keys = keys[order]
            first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            which = np.empty(len(keys), np.int32)
            which[order] = np.cumsum(first) - 1
            ends = np.full((len(sizes), len(self.row)), -1, np.int32)
            ends[np.array(real)] = which  # row by row
            learned = np.concatenate([learn[r] for r in real])
            out.append((keys[first], np.bincount(which, weights=learned, minlength=int(first.sum())).astype(np.uint32), ends))
        return out


class Automaton:
    """The states and arcs that a block's texts can reach.

    State i of level m is history i of m tokens; level 0 has the empty one only. Arc j of level m is a seen n-gram of m + 1
    tokens, which is known by its place in the block's texts; it leads to state j of level m + 1, or, of the longest
    n-grams, to that of their last order - 1 tokens.
    """

    def __init__(self, grams: Grams, ends: list[np.ndarray], totals: list[np.ndarray], tokens: int, kinds: int, mus: tuple[float, ...]):
        """ends as from Grams.asked; totals: training counts of all blocks for the keys that asked() gives."""
        self.grams, self.top = grams, len(mus)
        self.unknown = ADD / (tokens + ADD * (kinds + 1))
        self.arc: list[np.ndarray] = []  # by level, of each place the arc whose n-gram ends there, or -1
        self.weight, self.fails, self.to = [], [], []  # of arcs, and of the states that they lead to
        for k in range(len(grams.keys)):
            which, total = (ends[0][0], totals[0]) if k == 0 else (ends[1][k - 1], totals[1])
            places = np.flatnonzero(which >= 0)
            places = places[total[which[places]] > 0]
            place_of = np.full(len(total), -1, np.int64)  # one place of each seen n-gram of this size
            place_of[which[places]] = places
            seen = np.flatnonzero(place_of >= 0)
            number = np.full(len(total), -1, np.int64)
            number[seen] = np.arange(len(seen))
            place, count = place_of[seen], total[seen].astype(np.float64)
            here = np.full(len(which), -1)
            here[places] = number[which[places]]
            if k == 0:
                p, suffix = (count + ADD) / (tokens + ADD * (kinds + 1)), np.zeros(len(seen), np.int64)
                self.start = int(here[grams.first[0] + grams.n_tokens[0] - 1]) if len(grams.first) else -1  # the end token's
            else:
                suffix = self.arc[k - 1][place]
                history = np.where(grams.place[place] == 0, self.start, self.arc[k - 1][place - 1])
                p = (count + mus[k - 1] * p[suffix]) / (before[history] + mus[k - 1])
            before = count
            self.arc.append(here)
            self.weight.append(np.log10(p))
            if k < self.top:
                self.fails.append(np.log10(mus[k] / (count + mus[k])))
            self.to.append(suffix)

    def read(self) -> np.ndarray:
        """The log10 probability of each text."""
        grams, top = self.grams, self.top
        pieces = -(-grams.n_tokens // PIECE)
        row = np.repeat(np.arange(len(pieces)), pieces)
        skip = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        early = np.minimum(skip, top)
        begin, size = grams.first[row] + skip - early, np.minimum(grams.n_tokens[row] - skip, PIECE) + early
        order = np.argsort(-size, kind="stable")
        row, begin, size, early, skip = row[order], begin[order], size[order], early[order], skip[order]
        at_start = (skip == early) & (self.start >= 0)
        level, state = at_start.astype(np.int64), np.where(at_start, self.start, 0)
        total = np.zeros(len(row))
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))  # pieces that are longer
            place, weight = begin[:n] + t, np.zeros(n)
            lv, st = level[:n], state[:n]
            open_ = np.ones(n, bool)
            for m in range(top, -1, -1):
                here = np.flatnonzero(open_ & (lv == m))
                if not len(here):
                    continue
                arc = self.arc[m][place[here]]
                hit = arc >= 0
                found, arc = here[hit], arc[hit]
                weight[found] += self.weight[m][arc]
                open_[found] = False
                lv[found] = min(m + 1, top)
                st[found] = arc if m < top else self.to[m][arc]
                lost = here[~hit]
                if m:
                    weight[lost] += self.fails[m - 1][st[lost]]
                    st[lost] = self.to[m - 1][st[lost]]
                    lv[lost] = m - 1
                else:
                    weight[lost] += math.log10(self.unknown)
                    st[lost] = 0
            total[:n] += np.where(t >= early[:n], weight, 0.0)
        return np.bincount(row, weights=total, minlength=len(grams.n_tokens))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Known tokens and base score of each text."""
        arc, n = self.arc[0], len(self.grams.n_tokens)
        base = np.append(self.weight[0], math.log10(self.unknown))[arc]
        return np.bincount(self.grams.row[arc >= 0], minlength=n), np.bincount(self.grams.row, weights=base, minlength=n)


def score(docs: DataFrame, *, held_out: Column, doc_id: str = "doc_id", text: str = "text", mus: tuple[float, ...] = MUS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are runs of other characters than ASCII white space, A-Z lower-cased, then one end. A null text is an empty
    one: its end alone. Texts that are not held out are learned from, repeated rows as often as they occur; a null
    held_out counts as false. Without training texts every token is unknown. Ids may be null or repeat: every row has its
    result.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    kind = docs.schema[doc_id].dataType.simpleString()
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def pack(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids, held, lengths, size, whole = [], [], [], 0, []

        def block():
            nonlocal k, size
            row = [pa.array([part << 32 | k], pa.int64()), pa.array([ids[:]], pa.list_(id_type)), pa.array([held[:]]), pa.array([lengths[:]], pa.list_(pa.int64())), pa.array([zstandard.ZstdCompressor(level=6).compress(b"".join(whole))])]
            k, size = k + 1, 0
            for x in (ids, held, lengths, whole):
                x.clear()
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "held", "lengths", "body"])

        for batch in batches:
            id_type = batch.column(0).type
            data, offsets = buffers(batch.column(1))
            at = offsets.tolist()
            for i, h, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), at, at[1:]):
                ids.append(i)
                held.append(h)
                lengths.append(b - a)
                whole.append(bytes(data[a:b]))
                size += b - a + 64
                if size >= BLOCK_BYTES:
                    yield block()
        if ids:
            yield block()

    blocks = scratch.keep(plain.mapInArrow(pack, f"block long, ids array<{kind}>, held array<boolean>, lengths array<long>, body binary"), "blocks")
    size = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    shards, bits = max(8, math.ceil(size / SHARD_BYTES)), min(64, max(32, size.bit_length()) + MARGIN_BITS)
    low = np.uint64(64 - bits)

    def opened(lengths, held, body) -> tuple[Grams, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        grams = Grams(zstandard.ZstdDecompressor().decompress(body), np.array(lengths, np.int64), 1 + len(mus), bits)
        return grams, grams.asked(~np.array(held, bool))

    parts = ["keys_1", "counts_1", "keys_2", "counts_2"]  # of single tokens, and of longer n-grams

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, kinds = opened(row["lengths"], row["held"], row["body"])
                cuts = []
                for keys, _, _ in kinds:
                    of = _shard_of(keys, shards)  # ascending
                    used = np.unique(of)
                    cuts.append({int(x): (int(a), int(b)) for x, a, b in zip(used, np.searchsorted(of, used), np.searchsorted(of, used, "right"))})
                out = []
                for x in sorted(set(cuts[0]) | set(cuts[1])):
                    blobs = []
                    for (keys, counts, _), cut, shift in zip(kinds, cuts, (np.uint64(0), low)):
                        a, b = cut.get(x, (0, 0))
                        blobs += [_squeeze(np.diff(keys[a:b] >> shift, prepend=np.uint64(0))), _squeeze(counts[a:b])]
                    out.append((x, row["block"], *blobs))
                for some in range(0, len(out), 64):
                    columns = list(zip(*out[some : some + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]], ["shard", "block", *parts])

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[bytes], np.ndarray]:
        """For each block's keys the counts of all blocks; and all counts that aren't 0."""
        cut = np.cumsum([len(k) for k in keys])[:-1]
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        ordered = np.argsort(keys)
        first = np.append(True, keys[ordered][1:] != keys[ordered][:-1])[: len(keys)]
        sums = np.add.reduceat(counts[ordered].astype(np.uint64), np.flatnonzero(first)) if len(keys) else np.zeros(0, np.uint64)
        answers = np.empty(len(keys), np.uint64)
        answers[ordered] = sums[np.cumsum(first) - 1]
        return [_squeeze(x) for x in np.split(answers, cut)], sums[sums > 0]

    def add_up(table: pa.Table) -> pa.Table:
        opened_ = lambda c, kind: [_stretch(x.as_py(), kind) for x in table.column(c)]
        one, sums = summed([np.cumsum(x) for x in opened_("keys_1", np.uint64)], opened_("counts_1", np.uint32))
        two, _ = summed([np.cumsum(x) for x in opened_("keys_2", np.uint64)], opened_("counts_2", np.uint32))
        tell = lambda x: [int(x), *[0] * (table.num_rows - 1)]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "one": pa.array(one, pa.binary()), "two": pa.array(two, pa.binary()), "tokens": pa.array(tell(sums.sum()), pa.int64()), "kinds": pa.array(tell(len(sums)), pa.int64())})

    # Spark sends a shard's rows to one task; there are as many shards as make each a bounded share of the n-grams.
    asked = blocks.select("block", "lengths", "held", "body").mapInArrow(ask, "shard int, block long, " + ", ".join(f"{x} binary" for x in parts))
    answers = asked.groupBy("shard").applyInArrow(add_up, "block long, shard int, one binary, two binary, tokens long, kinds long")
    answers = scratch.keep(answers, "answers")
    del asked
    scratch.release()  # the questions are as large as all else together
    tokens, kinds = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def read_through(left: pa.Table, right: pa.Table) -> pa.Table:
        scored = []
        for row in left.to_pylist():
            grams, known = opened(row["lengths"], row["held"], row["body"])
            order = np.argsort(right.column("shard").to_numpy())
            totals = []
            for (keys, _, _), name in zip(known, ("one", "two")):
                blobs = right.column(name).to_pylist()
                totals.append(np.concatenate([_stretch(blobs[i], np.uint64) for i in order]))
                if len(totals[-1]) != len(keys):
                    raise ValueError("a block's answers don't fit its question")
            automaton = Automaton(grams, [x[2] for x in known], totals, tokens, kinds, mus)
            n_known, base = automaton.tokens()
            scored.append(pa.table({doc_id: pa.array(row["ids"], left.schema.field("ids").type.value_type), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(grams.n_tokens.astype(np.int64)), "n_known": pa.array(n_known), "train_tokens": pa.array(np.full(len(base), tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(automaton.read())}))
        return pa.concat_tables(scored)

    both = blocks.groupBy("block").cogroup(answers.select("block", "shard", "one", "two").groupBy("block"))
    return both.applyInArrow(read_through, f"`{doc_id}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
