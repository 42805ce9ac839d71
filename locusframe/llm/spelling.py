"""Spelling variants: words one edit apart, found in a trie of letter-group counts that is walked across the cluster.

A word's vector holds, for each letter group, how many of its letters fall in
it. One inserted letter is a surplus of one in one group, one deleted letter a
deficit, one replaced letter both or neither. The trie's levels are the counts
of successive groups. Walking it from a word with a budget of one surplus and
one deficit reaches every word one edit away, and few others; leaves are
verified letter by letter.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import slices
from locusframe.session import materialize

#: Latin-1 bytes to small letters, all but A-Z, a-z and U+00C0 to U+00FF to blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Letter groups, and so levels of the trie.
GROUPS = 16
#: Words of a subtree that need no further branching: they are verified at once.
LEAF = 24
#: Levels that are walked before any subtree is measured.
FIRST = 3
#: Words at home in one subtree, and words that probe it, in one task; larger subtrees are walked a level further.
SUBTREE = 100_000


# Words


def word_counts(docs: DataFrame, slip: int = 199) -> DataFrame:
    """(word, n): maximal letter runs, A-Z lower-cased, with a letter lost where the crc32 of ``doc_id:run`` divides by ``slip``.

    Null texts have no words; a null id counts as the empty text.
    """

    def count(batches):
        held: Counter[bytes] = Counter()

        def rows():
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, 512):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    # Characters beyond U+00FF become signs, which are no letters.
                    runs = text.encode("latin-1", "replace").translate(LETTERS).split()
                    held.update(runs)
                    seed = zlib.crc32(b"%s:" % str("" if doc_id is None else doc_id).encode())
                    for run in set(runs):
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                        if h % slip == 0:
                            at, n = h % len(run), runs.count(run)
                            held[run[:at] + run[at + 1 :]] += n
                            held[run] -= n
                    if len(held) > HELD:
                        yield rows()
                        held = Counter()
        if held:
            yield rows()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0 AND word <> ''")


# The trie


def group_counts(word: str, groups: int = GROUPS) -> bytes:
    """The vector of a word: its letters in each group, modulo 256; neighbours in the alphabet are in different groups."""
    counts = [0] * groups
    for c in word:
        counts[ord(c) % groups] += 1
    return bytes([n & 255 for n in counts])


def walks(vector: bytes, path: bytes, surplus: int, deficit: int, depth: int):
    """Depth-first: the nodes at ``depth`` that the budget reaches from the node ``path``, with what is left of it.

    The first difference from the word's own vector is a surplus, so of two
    words with different vectors one alone walks to the other.
    """
    if len(path) == depth:
        yield path, surplus, deficit
        return
    own = vector[len(path)]
    yield from walks(vector, path + bytes([own]), surplus, deficit, depth)
    if surplus:
        yield from walks(vector, path + bytes([(own + 1) & 255]), 0, deficit, depth)
    elif deficit:
        yield from walks(vector, path + bytes([(own - 1) & 255]), 0, 0, depth)


_STATE = "word string, vector binary, path binary, probe boolean, surplus int, deficit int"


def _walked(states: DataFrame, depth: int) -> DataFrame:
    """All states walked down to ``depth``: words at home along their own vector, probes wherever their budget leads."""

    def run(batches):
        names = [c.split()[0] for c in _STATE.split(", ")]
        for batch in batches:
            for part in slices(batch, 4096):
                out = []
                for word, vector, path, probe, surplus, deficit in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                    if probe:
                        out.extend((word, vector, p, True, s, d) for p, s, d in walks(vector, path, surplus, deficit, depth))
                    else:
                        out.append((word, vector, vector[:depth], False, surplus, deficit))
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.bool_(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return states.select("word", "vector", "path", "probe", "surplus", "deficit").mapInArrow(run, _STATE)


def _roots(words: DataFrame, groups: int) -> DataFrame:
    """Each word at the root, once at home and once as a probe with its whole budget."""

    def run(batches):
        for batch in batches:
            names = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([group_counts(w, groups) for w in names], pa.binary())], names=["word", "vector"])

    rooted = words.select("word").mapInArrow(run, "word string, vector binary")
    both = rooted.withColumn("probe", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.select("word", "vector", F.lit(b"").alias("path"), "probe", F.lit(1).alias("surplus"), F.lit(1).alias("deficit"))


def subtrees(words: DataFrame, groups: int = GROUPS, first: int = FIRST, subtree: int = SUBTREE) -> DataFrame:
    """Every word at home in its subtree, and as a probe in each subtree that its budget reaches.

    All walk the first levels together; subtrees with more than ``subtree`` words
    or probes are then walked level by level until none is left or the vectors
    end. Beyond that number, words of one whole vector and their probes are dealt
    to blocks, and each block of words meets each block of probes.
    """
    states, done = materialize(_walked(_roots(words, groups), first), "trie"), None
    for level in range(first, groups + 1):
        sizes = states.groupBy("path").agg(F.count_if(~F.col("probe")).alias("words"), F.count_if("probe").alias("probes"))
        heavy = materialize(sizes.where((F.col("words") > 0) & (F.greatest("words", "probes") > subtree)), "heavy")
        if heavy.isEmpty():
            break
        if level == groups:
            # Block w * (blocks of probes) + p holds the words of block w and the probes of block p.
            w_blocks, p_blocks = (F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(1)) / subtree).cast("int")) for c in ("words", "probes"))
            w, p = (F.pmod(F.xxhash64("word"), n).cast("int") for n in (w_blocks, p_blocks))
            each = F.when(F.col("probe"), F.transform(F.sequence(F.lit(0), w_blocks - 1), lambda x: x * p_blocks + p)).otherwise(
                F.transform(F.sequence(F.lit(0), p_blocks - 1), lambda x: w * p_blocks + x)
            )
            states = states.join(heavy, "path", "left").withColumn("block", F.explode(each)).drop("words", "probes")
            break
        light = states.join(heavy, "path", "left_anti")
        done = light if done is None else done.unionByName(light)
        states = materialize(_walked(states.join(heavy.select("path"), "path", "left_semi"), level + 1), "trie")
    if "block" not in states.columns:
        states = states.withColumn("block", F.lit(0))
    return states if done is None else states.unionByName(done.withColumn("block", F.lit(0)))


class Trie:
    """The vectors of a subtree's words below its root.

    A node is a dictionary from the next group's count to a child; a subtree of
    few words is one leaf, which lists the words by their places.
    """

    def __init__(self, vectors: list[bytes], depth: int):
        order = sorted(range(len(vectors)), key=vectors.__getitem__)
        self.root = self._node([(vectors[i], i) for i in order], depth)

    def _node(self, found: list[tuple[bytes, int]], level: int):
        if len(found) <= LEAF or found[0][0][level:] == found[-1][0][level:]:
            return [i for _, i in found]
        node, at = {}, 0
        for end in range(1, len(found) + 1):
            if end == len(found) or found[end][0][level] != found[at][0][level]:
                node[found[at][0][level]] = self._node(found[at:end], level + 1)
                at = end
        return node

    def near(self, vector: bytes, depth: int, surplus: int, deficit: int) -> list[int]:
        """Depth-first: the words of all leaves that the budget reaches."""
        out, stack = [], [(self.root, depth, surplus, deficit)]
        while stack:
            node, level, more, less = stack.pop()
            if type(node) is list:
                out += node
                continue
            own, level = vector[level], level + 1
            child = node.get(own)
            if child is not None:
                stack.append((child, level, more, less))
            if more:
                child = node.get((own + 1) & 255)
                if child is not None:
                    stack.append((child, level, 0, less))
            elif less:
                child = node.get((own - 1) & 255)
                if child is not None:
                    stack.append((child, level, 0, 0))
        return out


def walks_to(a: str, a_vector: bytes, b: str, b_vector: bytes) -> bool:
    """Whether the link of two near words is ``a``'s to report: the first difference of the vectors is a surplus."""
    first = next(((y - x) & 255 for x, y in zip(a_vector, b_vector, strict=True) if x != y), None)
    return a < b if first is None else first == 1


def one_edit(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` with one letter replaced or one letter more."""
    if len(a) == len(b):
        return sum(map(str.__ne__, a, b)) == 1
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


def verified(words: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``one_edit`` of the words at places ``a`` and ``b``: many at once, those of over 64 letters one by one."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    table = np.array([w[:65].encode("latin-1") for w in words], dtype="S66").view(np.uint8).reshape(len(words), 66)
    good = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 100_000):
        i, j = a[at : at + 100_000], b[at : at + 100_000]
        x, y = table[i], table[j]
        replaced = (sizes[i] == sizes[j]) & ((x != y).sum(axis=1) == 1)
        # With one letter more, the heads that agree and the tails that agree cover the shorter word.
        head = np.argmax(x[:, :-1] != y[:, :-1], axis=1)
        behind = np.arange(65) >= head[:, None]
        more = (sizes[i] + 1 == sizes[j]) & ~((x[:, :-1] != y[:, 1:]) & behind).any(axis=1)
        good[at : at + 100_000] = replaced | more
    for k in np.flatnonzero(np.maximum(sizes[a], sizes[b]) > 64).tolist():
        good[k] = one_edit(words[a[k]], words[b[k]])
    return good


def near_words(words: DataFrame, groups: int = GROUPS, first: int = FIRST, subtree: int = SUBTREE) -> DataFrame:
    """(a, b): every two of the distinct ``words`` that differ by exactly one inserted, deleted or replaced letter, once."""

    def search(table: pa.Table) -> pa.Table:
        depth = len(table.column("path")[0].as_py())
        names, vectors, probes, surplus, deficit = (table.column(c).to_pylist() for c in ("word", "vector", "probe", "surplus", "deficit"))
        home = [i for i, probe in enumerate(probes) if not probe]
        trie = Trie([vectors[i] for i in home], depth)
        places = np.array(home, dtype=np.int64)
        found_a, found_b = [], []

        def verify(who: list[int], reached: list[list[int]]) -> None:
            i = np.repeat(np.array(who, dtype=np.int64), [len(x) for x in reached])
            j = places[np.fromiter(itertools.chain.from_iterable(reached), np.int64, len(i))]
            hits = np.flatnonzero(verified(names, i, j))
            for x, y in zip(i[hits].tolist(), j[hits].tolist(), strict=True):
                if walks_to(names[x], vectors[x], names[y], vectors[y]):
                    found_a.append(names[x])
                    found_b.append(names[y])

        who, reached, held = [], [], 0
        for i in itertools.compress(range(len(probes)), probes if home else ()):
            who.append(i)
            reached.append(trie.near(vectors[i], depth, surplus[i], deficit[i]))
            held += len(reached[-1])
            if held > 500_000:
                verify(who, reached)
                who, reached, held = [], [], 0
        if who:
            verify(who, reached)
        return pa.table({"a": pa.array(found_a, pa.string()), "b": pa.array(found_b, pa.string())})

    return subtrees(words, groups, first, subtree).groupBy("path", "block").applyInArrow(search, "a string, b string")


# Forms


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: follows forms to the last by doubling jumps; forms must have no loop."""
    jumps = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        jumps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return jumps


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, slip: int = 199) -> DataFrame:
    """Words of ``docs`` with their spelling form: word, n, n_near, form, form_n, root.

    Words have ``shortest`` letters and ``least`` occurrences at the least. A
    word's form is its commonest near word (ties: the smallest), if that is
    ``times`` as common or more; ``root`` is the last of the chain of forms.

    Null and empty texts have no words; repeated rows count again; null ids
    count as the empty text; an empty table gives no rows; other columns are
    ignored. Counts rise along a chain of forms, so chains are short. A word with
    very many near words is no hot key: counts and maxima combine first.
    """
    words = materialize(word_counts(docs, slip).where((F.length("word") >= shortest) & (F.col("n") >= least)), "words")
    links = materialize(near_words(words), "near")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = counted.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), "b")).alias("best"))
    common = -F.col("best.minus")
    found = materialize(
        words.join(best.withColumnRenamed("a", "word"), "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(common >= times * F.col("n"), F.col("best.b")).alias("form"),
            F.when(common >= times * F.col("n"), common).alias("form_n"),
        ),
        "forms",
    )
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
