"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import LOWER, WORDS, slices
from locusframe.llm.graph import components
from locusframe.session import materialize

#: 32 bands of 5: a pair at similarity 0.8 shares no band with probability 3e-6, at 0.85 with 7e-9.
BANDS, ROWS = 32, 5
#: Signature positions compared between two looks at the posterior.
BATCH = 32
#: Nodes in one verification block.
BLOCK = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct word shingles of texts as sorted 64-bit hashes; equal shingles have equal hashes."""

    def __init__(self, words: int, keep: int = 50_000):
        self.k, self.keep, self.known = words, keep, {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORDS.findall((text or "").translate(LOWER)) if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(self.known) > self.keep:
            self.known = {}
        h = self._hashes(words)
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.full(n, np.uint64(k))
        for i in range(k):
            out = _mixed(out + _GOLD + h[i : i + n])
        return np.unique(out)


def _parameters(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)


def _set_key(shingles: np.ndarray) -> bytes | None:
    return np.array([shingles.sum(), _mixed(shingles).sum()], dtype=np.uint64).tobytes() if len(shingles) else None


def _signatures(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """One row of BANDS*ROWS minima of 32 bits for each non-empty set."""
    a, b = _parameters(BANDS * ROWS, seed)
    out = np.empty((len(sets), BANDS * ROWS), dtype=np.uint32)
    at = 0
    while at < len(sets):  # about 8,192 shingles at a time stay in the cache
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 8192):
            size += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.cumsum([0] + [len(s) for s in sets[at : to - 1]])
        for i in range(BANDS * ROWS):
            out[at:to, i] = np.minimum.reduceat(flat * a[i] + b[i], starts) >> np.uint64(32)
        at = to
    return out


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = _mixed(key + _GOLD + rows[:, :, i])
    return key


def sign(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, bands) of each row of ``docs``.

    ``set_key`` holds 128 bits of the shingle set; it is null for an empty one.
    """

    def rows(batches):
        shingles = Shingler(words)
        for batch in batches:
            for part in slices(batch, 256):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                full = [s for s in sets if len(s)]
                sig = _signatures(full, seed)
                bands = _band_keys(sig).view(np.int64)
                place = iter(range(len(full)))
                at = [next(place) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_set_key(s) for s in sets], pa.binary()),
                        pa.array([None if i is None else sig[i].tobytes() for i in at], pa.binary()),
                        pa.array([None if i is None else bands[i] for i in at], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "signature", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, n_shingles bigint, set_key binary, signature binary, bands array<bigint>")


def prune_bounds(threshold: float, miss: float, n: int = BANDS * ROWS, step: int = BATCH) -> list[tuple[int, int]]:
    """(compared, least matches) after each batch: below it P(similarity >= threshold) < ``miss``.

    The posterior of the match rate under a uniform prior is Beta(m+1, n-m+1);
    its upper tail at the threshold is the binomial tail P(X <= m) of n+1 trials.
    """
    from math import comb

    bounds = []
    for seen in [*range(step, n, step), n]:
        tail, least = 0.0, 0
        for m in range(seen + 1):
            tail += comb(seen + 1, m) * threshold**m * (1 - threshold) ** (seen + 1 - m)
            if tail >= miss:
                least = m
                break
        bounds.append((seen, least))
    return bounds


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def roots(self) -> np.ndarray:
        up = self.up
        while not np.array_equal(up[up], up):
            up = up[up]
        self.up = up
        return up


def _linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


def link_block(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, label: np.ndarray, per_cent: int, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Confirmed links of ``left`` x ``right`` that join different components.

    A pair is a candidate if it shares a band. Signatures are compared batch by
    batch and pairs below the posterior bound go; survivors are confirmed on the
    full sets, most similar first, and a pair that is joined already is skipped.
    """
    sizes = np.array([len(s) for s in sets])
    joined = _Union(len(sets))
    first: dict[int, int] = {}
    for i, x in enumerate(label):  # what is joined already
        joined.up[i] = first.setdefault(x, i)
    leads = np.zeros(len(sets), dtype=bool)
    leads[left] = True
    links = []
    spans = np.add.reduceat
    queue = []
    for i in left:
        others = right[((right > i) | ~leads[right]) & (label[right] != label[i])]
        big, small = np.maximum(sizes[others], sizes[i]), np.minimum(sizes[others], sizes[i])
        others = others[100 * small >= per_cent * big]
        if not len(others):
            continue
        same = sig[others] == sig[i]
        banded = (spans(same, np.arange(0, BANDS * ROWS, ROWS), axis=1, dtype=np.int64) == ROWS).any(axis=1)
        others, same = others[banded], same[banded]
        matches, seen = np.zeros(len(others), dtype=np.int64), 0
        for upto, least in bounds:
            matches = matches + same[:, seen:upto].sum(axis=1)
            stay = matches >= least
            others, same, matches, seen = others[stay], same[stay], matches[stay], upto
        queue += [(-int(m), int(i), int(j)) for m, j in zip(matches, others, strict=True)]
    for _, i, j in sorted(queue):
        x, y = joined.find(i), joined.find(j)
        if x != y and _linked(sets[i], sets[j], per_cent):
            joined.up[max(x, y)] = min(x, y)
            links.append((i, j))
    return links


def _verify(work: DataFrame, per_cent: int, bounds: list[tuple[int, int]]) -> DataFrame:
    """Links (a, b) of each task of ``work``: (task, node, label, side, signature, shingles); side 0 is left, 1 right, 2 both."""

    def links(pdf):
        import pandas as pd

        sig = np.stack([np.frombuffer(s, dtype=np.uint32) for s in pdf["signature"]])
        sets = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
        side, node = pdf["side"].to_numpy(), pdf["node"].to_numpy()
        label = pd.factorize(pdf["label"])[0]
        found = link_block(sig, sets, np.flatnonzero(side != 1), np.flatnonzero(side != 0), label, per_cent, bounds)
        return pd.DataFrame({"a": [node[i] for i, _ in found], "b": [node[j] for _, j in found]}, dtype="object")

    return work.groupBy("task").applyInPandas(links, "a binary, b binary")


def _members(docs: DataFrame, placed: DataFrame, words: int) -> DataFrame:
    """``placed`` with the full shingle set of each node, from one of its documents."""
    names = ["node", "component", "blocks", "block", "signature"]
    texts = docs.select("doc_id", "text").join(placed, F.col("doc_id").eqNullSafe(F.col("low_id"))).select(*names, "text")

    def rows(batches):
        shingles = Shingler(words)
        for batch in batches:
            for part in slices(batch, 256):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                own = pa.array([_set_key(s) == n for s, n in zip(sets, part.column("node").to_pylist(), strict=True)], pa.bool_())
                made = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])
                yield made.filter(own)

    schema = "node binary, component binary, blocks bigint, block bigint, signature binary, shingles binary"
    return texts.mapInArrow(rows, schema)


def near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = 80, miss: float = 1e-4, seed: int = 11) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``, which has doc_id and text.

    Documents are linked when 100 * intersection >= ``per_cent`` * union of
    their word shingles (hashed to 64 bits), and components follow all links.
    Candidates share one of 32 bands of five minima; of those, pairs whose
    similarity is at least the threshold with posterior probability under
    ``miss`` are dropped; every other pair that could join two components is
    confirmed on the full sets.

    Scale: rows of equal sets become one node before anything is paired. Nodes
    that share bands form candidate clusters; a cluster is verified in blocks of
    256 nodes. Every block also meets the pivots of its cluster, so most of a
    large cluster is one component after the first pass, and the second pass
    pairs only blocks of nodes outside the largest component with the others.
    Pairs never become rows, and no task holds more than a few hundred nodes.

    Null or blank texts have no shingles and stand alone; shorter texts than
    ``words`` have one shingle. Repeated rows are linked like other equal texts.
    A null doc_id never names a group that has another id. An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    signed = materialize(sign(docs, words, seed), "signed")
    nodes = (
        signed.where("set_key IS NOT NULL")
        .groupBy(F.col("set_key").alias("node"))
        .agg(F.min("doc_id").alias("low_id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    )
    nodes = materialize(nodes, "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "first")
    # A node links to the least of the first nodes of its buckets, and the others to that one: about one link a node.
    firsts = buckets.join(shared, "band").groupBy("node").agg(F.min("first").alias("least"), F.collect_set("first").alias("firsts"))
    star = firsts.select(F.col("least").alias("a"), F.explode(F.array_union(F.array("node"), "firsts")).alias("b")).where("a <> b").distinct()
    clusters = components(star)

    # A node's block is a hash of it, so no task numbers a whole cluster.
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("long"))
    placed = clusters.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.join(nodes.select("node", "low_id", "signature"), "node").select("node", "component", "blocks", "block", "low_id", "signature")
    members = materialize(_members(docs, placed, words), "members").dropDuplicates(["node"])

    bounds = prune_bounds(per_cent / 100, miss)
    task = F.concat_ws(":", F.hex("component"), "block").alias("task")
    columns = ("node", "label", "side", "signature", "shingles")
    own = members.withColumn("label", F.col("node")).withColumn("side", F.lit(2))
    pivots = own.where("blocks > 1 AND block = 0").where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(8)) == 0)
    pivots = pivots.withColumn("block", F.explode(F.expr("sequence(1, blocks - 1)")))
    found = materialize(_verify(own.unionByName(pivots).select(task, *columns), per_cent, bounds), "found")
    joined = components(found).select("node", F.col("component").alias("joined"))

    # Second pass, for clusters of several blocks: nodes outside the largest component meet all blocks.
    large = members.where("blocks > 1").join(joined, "node", "left").withColumn("label", F.coalesce("joined", "node")).drop("joined")
    large = materialize(large, "large")
    weight = large.groupBy("component", "label").count()
    top = weight.groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("top"), F.sum("count").alias("n"), F.max("count").alias("most"))
    top = top.select("component", "top", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("long").alias("out_blocks")).where("out_blocks > 0")
    loose = large.join(top, "component")
    pair = F.concat_ws(":", F.hex("component"), "out_block", "block").alias("task")
    left = loose.where("label <> top").withColumn("out_block", F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.col("out_blocks")))
    left = left.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("side", F.lit(0))
    right = loose.withColumn("out_block", F.explode(F.expr("sequence(0, out_blocks - 1)"))).withColumn("side", F.lit(1))
    more = _verify(left.select(pair, *columns).unionByName(right.select(pair, *columns)), per_cent, bounds)
    known = joined.select(F.col("joined").alias("a"), F.col("node").alias("b"))
    final = components(known.unionByName(more))

    of_node = materialize(nodes.select("node", "low_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    lowest = of_node.groupBy("component").agg(F.min("low_id").alias("component_id"))
    by_set = of_node.join(lowest, "component").select(F.col("node").alias("set_key"), "component_id")
    return (
        signed.select("doc_id", "n_shingles", "set_key")
        .join(by_set, "set_key", "left")
        .withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, words: int = 5, per_cent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    A document without words stands alone and stays. Where several rows carry
    the kept doc_id, exact repeats of it (equal text) leave one row.
    """
    judged = near_duplicates(docs, words, per_cent)
    stay = judged.where("kept").select("doc_id").distinct()
    return docs.join(stay.withColumnRenamed("doc_id", "_kept_id"), F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi").dropDuplicates(["doc_id", "text"])
