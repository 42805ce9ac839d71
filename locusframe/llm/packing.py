"""Packing documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import slices
from locusframe.session import materialize

#: Items of one packing problem; problems are dealt by hash, so each has about as many.
PROBLEM = 4096


def cut_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's tokens with ``end_id`` after them.

    A document of at most ``size`` tokens is one piece. Longer ones are cut in
    pieces of ``size``; what is left over is the first piece. A null text is
    empty and gives the end id alone; repeated rows are packed one by one; an
    empty table gives no pieces; other columns are not read.
    """

    def cut(batches):
        from locusframe.llm.tokens import encoder as encoder_of

        encoder = encoder_of(tokenizer, keep=1_200_000)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 128):
                rows: list[list] = [[] for _ in range(6)]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        length = (n - at) % size or size
                        own = ids[4 * at : 4 * (at + length)]
                        for column, value in zip(rows, (doc_id, piece, at, length, zlib.crc32(own), np.frombuffer(own, "<u4").astype("i4") if with_ids else None), strict=True):
                            column.append(value)
                        at, piece = at + length, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                made = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays(made[:n], names=names[:n])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Put items, in ``order``, each into the fullest bin that holds it; new bins as needed.

    Bins stand in stacks by free space; the lowest set bit of a mask of
    non-empty stacks at or above an item's size finds its bin.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for number, items in enumerate(bins):
        room = capacity - int(sizes[items].sum())
        stacks[room].append(number)
        mask |= 1 << room
    for i in order:
        need = int(sizes[i])
        fit = mask >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            number = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
            bins[number].append(int(i))
        else:
            room, number = capacity, len(bins)
            bins.append([int(i)])
        room -= need
        stacks[room].append(number)
        mask |= 1 << room
    return bins


def _groups(assigned: np.ndarray) -> list[list[int]]:
    order = np.argsort(assigned, kind="stable")
    return [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(assigned[order])) + 1)]


def _assigned(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for number, items in enumerate(bins):
        out[items] = number
    return out


def _fitness(assigned: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean squared fill, which favours full bins beside an empty one."""
    fill = np.bincount(assigned, weights=sizes)
    return (-len(fill), float(np.mean((fill / capacity) ** 2)))


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child that takes whole well-filled bins of ``b`` into ``a``.

    Bins of ``a`` that hold an injected item go; their other items are displaced
    and come back by best fit in falling size.
    """
    n = len(sizes)
    fill_b = np.bincount(b, weights=sizes)
    good = fill_b >= 0.995 * capacity
    chosen = good & (rng.random(len(fill_b)) < 0.5)
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, dtype=bool)
    hit[a[injected]] = True
    stay = ~hit[a] & ~injected
    # The emptiest remaining bins are opened as well, so that their items can move.
    fill_a = np.bincount(a, weights=sizes)
    fill_a[hit] = np.inf
    open_up = np.zeros(len(fill_a), dtype=bool)
    open_up[np.argsort(fill_a)[: max(2, len(fill_a) // 50)]] = True
    stay &= ~open_up[a]
    bins = []
    for keep, of in ((injected, b), (stay, a)):
        at = np.flatnonzero(keep)
        if len(at):
            bins += [at[g].tolist() for g in _groups(of[at])]
    loose = np.flatnonzero(~injected & ~stay)
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    return _assigned(best_fit(sizes, loose, bins, capacity), n)


def evolve(sizes: np.ndarray, capacity: int, seed: list[np.ndarray], rng: np.random.Generator, generations: int, population: int) -> list[np.ndarray]:
    """Best assignments first. It ends early at the least possible number of bins."""
    n = len(sizes)
    least = -(-int(sizes.sum()) // capacity)
    people = list(seed)
    if not people:
        people.append(_assigned(best_fit(sizes, np.argsort(-sizes, kind="stable"), [], capacity), n))
    while len(people) < population and _fitness(people[0], sizes, capacity)[0] < -least:
        noisy = np.argsort(-sizes * rng.uniform(0.8, 1.0, n), kind="stable")
        people.append(_assigned(best_fit(sizes, noisy, [], capacity), n))
    people.sort(key=lambda p: _fitness(p, sizes, capacity), reverse=True)
    for _ in range(generations):
        if -_fitness(people[0], sizes, capacity)[0] <= least or len(people) < 2:
            break
        children = []
        for _ in range(population // 2):
            i, j = sorted(rng.choice(len(people), 2, replace=False))
            children += [crossover(people[i], people[j], sizes, capacity, rng), crossover(people[j], people[i], sizes, capacity, rng)]
        people = sorted(people + children, key=lambda p: _fitness(p, sizes, capacity), reverse=True)[:population]
    return people


def _problem_rows(items: DataFrame) -> DataFrame:
    """One row a problem with its items and sizes; about PROBLEM items each."""
    count = items.count()
    problems = max(1, -(-count // PROBLEM))
    dealt = items.select(F.pmod(F.xxhash64("item", F.lit(5)), F.lit(problems)).alias("problem"), "item", "length")
    rows = dealt.groupBy("problem").agg(F.sort_array(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length")))).alias("x"))
    return rows.select("problem", F.col("x.item").alias("items"), F.col("x.length").alias("lengths"))


def pack_items(items: DataFrame, capacity: int = 2048, islands: int = 2, epochs: int = 2, generations: int = 3, population: int = 4, rounds: int = 3) -> DataFrame:
    """(item, sequence_id, offset) for ``items`` (item unique, 1 <= length < capacity).

    Items are dealt by hash to problems of some thousands. Every problem has
    ``islands`` populations in tasks of their own; after an epoch the elite of an
    island migrates to the next one, and the last epoch's best packing stands.
    Bins that are not well filled then give their items back, which are dealt to
    new problems, up to ``rounds`` times, so that the loose ends of all problems
    meet. No problem grows with the input.
    """
    schema = "problem bigint, island int, items array<bigint>, lengths array<int>, elite array<int>"
    done = []

    def run(epoch: int):
        def rows(frames):
            import pandas as pd

            for pdf in frames:
                out = []
                for problem, island, own, lengths, elite in zip(*(pdf[c] for c in ("problem", "island", "items", "lengths", "elites")), strict=True):
                    sizes = np.asarray(lengths, dtype=np.int64)
                    rng = np.random.default_rng([int(problem), int(island), epoch])
                    seed = [np.asarray(e, dtype=np.int32) for e in elite] if elite is not None else []
                    best = evolve(sizes, capacity, seed, rng, generations, population)
                    out.append((problem, island, own, lengths, best[0]))
                yield pd.DataFrame(out, columns=["problem", "island", "items", "lengths", "elite"])

        return rows

    left = items.select("item", "length")
    for turn in range(rounds):
        problems = materialize(_problem_rows(left), "problems")
        state = problems.select("problem", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "items", "lengths", F.lit(None).cast("array<array<int>>").alias("elites"))
        for epoch in range(epochs):
            work = state.repartition("problem", "island")
            state = materialize(work.mapInPandas(run(epoch), schema), "islands")
            if epoch < epochs - 1:
                came = state.select("problem", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
                state = state.join(came, ["problem", "island"]).withColumn("elites", F.array("elite", "guest")).drop("elite", "guest")
        bins_used = F.array_max("elite") + 1
        best = state.groupBy("problem").agg(F.min_by(F.struct("items", "lengths", "elite"), F.struct(bins_used, "island")).alias("b"))
        placed = best.select("problem", F.explode(F.arrays_zip("b.items", "b.lengths", "b.elite")).alias("x"))
        placed = placed.select("problem", F.col("x.items").alias("item"), F.col("x.lengths").alias("length"), F.col("x.elite").alias("bin"))
        bins = placed.groupBy("problem", "bin").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("own"), F.sum("length").alias("fill"))
        bins = materialize(bins, "bins")
        final = turn == rounds - 1 or problems.count() <= 1
        number = F.lit(turn) * F.lit(1 << 56) + F.col("problem") * F.lit(1 << 24) + F.col("bin")
        done.append((bins if final else bins.where(F.col("fill") >= int(0.995 * capacity))).select(number.alias("sequence_id"), "own"))
        if final:
            break
        left = bins.where(F.col("fill") < int(0.995 * capacity)).select(F.explode("own").alias("x")).select("x.item", "x.length")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    before = F.aggregate(F.slice("own", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return whole.select("sequence_id", "own", F.posexplode("own").alias("at", "x")).select(F.col("x.item").alias("item"), "sequence_id", before.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, **how) -> DataFrame:
    """The pieces of ``cut_pieces`` with sequence_id and offset, packed by ``pack_items``.

    A full piece is a sequence of its own; the others share sequences of at most
    ``size`` tokens without gaps.
    """
    pieces = materialize(cut_pieces(docs, tokenizer, size, end_id, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    packed = pack_items(pieces.where(F.col("length") < size), size, **how)
    full = pieces.where(F.col("length") == size).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < size).join(packed, "item").select(full.columns).unionByName(full).drop("item")
