"""Packing documents into training sequences with a grouping genetic algorithm.

A solution is a list of bins. Crossover injects whole well-filled bins of one parent into the
other, drops the bins that would hold a document twice and best-fits the displaced documents,
largest first. The pieces are dealt into shards of bounded size. Each shard is worked on by
several islands, tasks with a population of their own; after every epoch an island's elite
migrates to the next one. A shard whose best solution meets the lower bound (total length over
capacity) is proven optimal and stops. The worst bins of all shards are then dissolved and
packed again together, round after round, so shard borders cost almost nothing.
"""

from __future__ import annotations

import bisect
import random
import struct
import zlib
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.texts import as_bytes, only, portions
from riskloom.llm.tokens import encoder, named_path
from riskloom.session import settle

CAPACITY = 4096
END_ID = 1
SHARD = 4000  # pieces that one island holds
ISLANDS = 4
POPULATION = 6
EPOCHS = 3
GENERATIONS = 12


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)] if n else []


def _tokenise(tokenizer: str, capacity: int, end_id: int, keep_ids: bool):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(named_path(tokenizer)).ids
        for batch in portions(batches, keep_words=True):
            doc_id = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for d, raw in zip(doc_id, as_bytes(batch.column("text"))):
                ids = encode(raw) + end
                for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((d, number, start, length, zlib.crc32(part), part if keep_ids else None))
            column = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(column, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Token pieces of whole documents; only documents longer than ``capacity`` are cut.

    A null or empty text is the end id alone. With ``keep_ids`` the ids come along as
    little-endian 32-bit numbers.
    """
    texts = only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(_tokenise(tokenizer, capacity, end_id, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


Bins = list[list[int]]  # numbers of the pieces in each bin


class Packer:
    """The genetic operators over one shard's lengths."""

    def __init__(self, lengths: Sequence[int], capacity: int, seed: int):
        # plain numbers: those of an array cost several times as much in every sum and comparison
        self.lengths, self.capacity, self.draw = [int(n) for n in lengths], capacity, random.Random(seed)
        self.bound = -(-sum(self.lengths) // capacity)

    def fill(self, bin_: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, bin_))

    def fitness(self, bins: Bins) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean square of the fill)."""
        return len(bins), -sum((self.fill(b) / self.capacity) ** 2 for b in bins) / max(1, len(bins))

    def best_fit(self, bins: Bins, order: Sequence[int]) -> Bins:
        """Puts each piece into the bin that it leaves with the least room."""
        room = sorted((self.capacity - self.fill(b), k) for k, b in enumerate(bins))
        for i in order:
            size = self.lengths[i]
            at = bisect.bisect_left(room, (size, -1))
            if at < len(room):
                left, k = room.pop(at)
                bins[k].append(i)
            else:
                left, k = self.capacity, len(bins)
                bins.append([i])
            if left > size:
                bisect.insort(room, (left - size, k))
        return bins

    def largest_first(self, items: Sequence[int]) -> list[int]:
        return sorted(items, key=lambda i: (-self.lengths[i], i))

    def seed(self, shuffled: bool) -> Bins:
        order = list(range(len(self.lengths)))
        if shuffled:
            self.draw.shuffle(order)
        return self.best_fit([], order if shuffled else self.largest_first(order))

    def cross(self, mother: Bins, father: Bins) -> Bins:
        """The father's well-filled bins, the mother's bins without duplicates, the rest best-fitted."""
        full = sorted(father, key=self.fill, reverse=True)[: max(1, len(father) // 2)]
        given = [list(b) for b in full if self.draw.random() < 0.5] or [list(full[0])]
        taken = {i for b in given for i in b}
        kept, displaced = [], []
        for b in mother:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        return self.best_fit(given + kept, self.largest_first(displaced))

    def mutate(self, bins: Bins) -> Bins:
        """Dissolves some bins, emptier ones more often, and best-fits what they held."""
        ranked = sorted(bins, key=self.fill)
        gone = {int(len(ranked) * self.draw.random() ** 2) for _ in range(max(2, len(ranked) // 50))}
        kept = [list(b) for k, b in enumerate(ranked) if k not in gone]
        displaced = [i for k in gone for i in ranked[k]]
        self.draw.shuffle(displaced)
        return self.best_fit(kept, displaced)

    def evolve(self, population: list[Bins], generations: int, size: int) -> list[Bins]:
        ranked = sorted(((self.fitness(bins), bins) for bins in population), key=itemgetter(0))
        for _ in range(generations):
            if len(ranked[0][1]) <= self.bound:
                break
            for _ in range(size // 2):
                a, b = (min(self.draw.sample(range(len(ranked)), min(2, len(ranked)))) for _ in range(2))
                child = self.cross(ranked[a][1], ranked[b][1])
                if self.draw.random() < 0.5:
                    child = self.mutate(child)
                ranked.append((self.fitness(child), child))
            ranked = sorted(ranked, key=itemgetter(0))[:size]
        return [bins for _, bins in ranked]


def _assigned(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(assigned: Sequence[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, k in enumerate(assigned):
        bins[k].append(i)
    return bins


_STATE = "shard long, island int, bins long, bound long, keys array<long>, lengths array<long>, population array<array<int>>"


def _start(capacity: int, islands: int, size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        shard, keys, lengths = int(pdf["shard"].iloc[0]), pdf["key"].tolist(), pdf["length"].tolist()
        rows = []
        for island in range(islands):
            packer = Packer(lengths, capacity, hash((shard, island)))
            population = [packer.seed(False)]
            solved = len(population[0]) <= packer.bound
            population += [packer.seed(True) for _ in range(0 if solved else size - 1)]
            population.sort(key=packer.fitness)
            rows.append((shard, island, len(population[0]), packer.bound, keys, lengths, [_assigned(b, len(keys)) for b in population]))
            if solved:
                break
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _STATE.split(", ")])

    return run


def _evolve(capacity: int, epoch: int, generations: int, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                packer = Packer(r.lengths, capacity, hash((r.shard, r.island, epoch)))
                guests = [] if r.guest is None else [_bins(r.guest)]
                population = packer.evolve([_bins(a) for a in r.population] + guests, generations, size)
                rows.append((r.shard, r.island, len(population[0]), r.bound, r.keys, r.lengths, [_assigned(b, len(r.keys)) for b in population]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _STATE.split(", ")])

    return run


def _place(capacity: int, round_: int, dissolve: bool):
    """Sequence and offset per piece; pieces of dissolved bins get no sequence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                bins = _bins(r.best)
                fills = [sum(r.lengths[i] for i in b) for b in bins]
                worst = int(np.argmin(fills)) if bins else -1
                for k, b in enumerate(bins):
                    again = dissolve and (fills[k] < 0.9 * capacity or k == worst and fills[k] < capacity)
                    offset = 0
                    for i in b:
                        rows.append((int(r.keys[i]), int(r.lengths[i]), None if again else (round_ << 54) + (int(r.shard) << 16) + k, offset))
                        offset += int(r.lengths[i])
            out = pd.DataFrame(rows, columns=["key", "length", "sequence_id", "offset"])
            yield out.astype({"sequence_id": "Int64"})

    return run


def pack(
    table: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, size: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS,
) -> DataFrame:
    """``table`` (a column ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Sequences hold at most ``capacity`` tokens, pieces lie in them without gaps. Repeated rows
    are packed one by one; an empty table stays empty.
    """
    keyed = settle(table.withColumn("_key", F.monotonically_increasing_id()), "packing-pieces")
    todo, placed, round_ = keyed.select(F.col("_key").alias("key"), F.col("length").cast("long").alias("length")), [], 0
    n = todo.count()
    while n:
        shards = -(-n // shard)
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(shards)))
        state = settle(dealt.groupBy("shard").applyInPandas(_start(capacity, islands, size), _STATE), "packing-state")
        for epoch in range(epochs):
            best = state.groupBy("shard").agg(F.min(F.col("bins") - F.col("bound")).alias("over"))
            open_ = best.filter("over > 0").select("shard")
            if open_.isEmpty():
                break
            moving = state.join(open_, "shard", "left_semi")
            # the elite of each island goes to the next one on the ring
            elite = moving.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("guest"))
            evolved = moving.join(elite, ["shard", "island"], "left").mapInPandas(_evolve(capacity, epoch, generations, size), _STATE)
            state = settle(evolved.unionByName(state.join(open_, "shard", "left_anti")), "packing-state")
        best = state.groupBy("shard").agg(F.min_by(F.struct("keys", "lengths", F.col("population")[0].alias("best")), F.struct("bins", "island")).alias("s")).select("shard", "s.*")
        done = settle(best.mapInPandas(_place(capacity, round_, shards > 1), "key long, length long, sequence_id long, offset long"), "packing-places")
        placed.append(done.filter("sequence_id is not null"))
        todo = done.filter("sequence_id is null").select("key", "length")
        left = todo.count()
        if 2 * left > n:  # dissolving would not end; keep these bins as they are
            placed[-1] = best.mapInPandas(_place(capacity, round_, False), "key long, length long, sequence_id long, offset long")
            break
        n, round_ = left, round_ + 1
    if not placed:
        return keyed.drop("_key").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    every = placed[0]
    for part in placed[1:]:
        every = every.unionByName(part)
    return keyed.join(every.select(F.col("key").alias("_key"), "sequence_id", "offset"), "_key").drop("_key")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, **settings) -> DataFrame:
    """Pieces of whole documents (see ``pieces``) with the sequence and the place of each."""
    cut_ = pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids)
    return pack(cut_ if keep_ids else cut_.drop("ids"), capacity, **settings)
