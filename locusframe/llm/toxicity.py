"""Toxicity by class-conditional Kneser-Ney models over words and word pairs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from locusframe.llm.common import fold, slices
from locusframe.llm.minhash import _mixed
from locusframe.session import materialize

#: Words for the models: runs of letters and digits, in lower case.
TOKEN = re.compile(r"[^\W_]+")
#: Words of a window whose mean log ratio is looked at beside that of the text.
WINDOW = 16
#: Standard errors in an absolute discount.
DISCOUNT = 3.0
#: Counts of the classes within this factor count as alike.
ALIKE = 3.0
#: The most that one pair can say, so that a copied passage does not outweigh a text.
MOST = 3.0
#: Occurrences in a class below which a pair is all discount: n > DISCOUNT * sqrt(n) + 1 needs 11.
LEAST = 11
#: Expressions (frequent pairs; words and pairs with evidence) that are broadcast; more of them are joined to the texts.
BROADCAST_ROWS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Word hashes of a text, remembered up to a fixed number of words."""

    def __init__(self, keep: int = 50_000):
        self.keep, self.known = keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = TOKEN.findall((text or "").lower())
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _before(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(h)
    out[k:] = h[:-k]
    return out


def _pairs(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with the one before it."""
    return _mixed(h + _mixed(before + _GOLD))


def gather(documents) -> np.ndarray:
    """Distinct rows (class, word two before, word before, word) of some documents."""
    rows = [np.stack([np.full(len(h), label, dtype=np.uint64), _before(h, 2), _before(h, 1), h], axis=1) for label, h in documents]
    rows = np.concatenate([np.zeros((0, 4), dtype=np.uint64), *rows])
    return _grouped(rows)[0]


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the places of their first ones among the sorted rows."""
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64)
    rows = rows[np.lexsort(rows.T)]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], first


def tally(documents) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (class, word before, word) of some documents, and how often each occurs."""
    rows = [np.stack([np.full(len(h), label, dtype=np.uint64), _before(h, 1), h], axis=1) for label, h in documents]
    rows = np.concatenate([np.zeros((0, 3), dtype=np.uint64), *rows])
    found, first = _grouped(rows)
    return found, np.diff(np.append(first, len(rows)))


class Pairs:
    """A set of pairs of word hashes, looked up by whole pairs."""

    def __init__(self, before: np.ndarray, word: np.ndarray):
        key = _pairs(word, before)
        order = np.argsort(key)
        self.key, self.before, self.word = key[order], before[order], word[order]

    def has(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(word), dtype=bool)
        at = np.minimum(np.searchsorted(self.key, _pairs(word, before)), len(self.key) - 1)
        return (self.before[at] == before) & (self.word[at] == word)


def _documents(part):
    """(class, text) of the rows of an Arrow batch."""
    return zip(part.column("toxic").to_pylist(), part.column("text").to_pylist(), strict=True)


def count_expressions(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """(before, word, n0, n1) of the pairs in ``rows`` (toxic, text), per class.

    ``n0`` and ``n1`` count the distinct words before a pair that occurs LEAST
    times or more in a class. A rarer pair can have no more of them than it has
    occurrences, which its discount covers whole, so it stands with those. Only
    the frequent pairs are counted with the words before them: up to ``most`` of
    them are broadcast to a second scan of the texts, more are joined to it.
    Distinct words are grouped before they are counted, so a hot pair is no hot key.
    """

    def occurrences(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, 2048):
                found, n = tally((y, hasher(t)) for y, t in _documents(part))
                toxic = found[:, 0] == 1
                before, word = found[:, 1:].T.copy().view(np.int64)
                n0, n1 = (pa.array(np.where(own, n, 0).astype(np.int32)) for own in (~toxic, toxic))
                yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(word), n0, n1], names=["before", "word", "n0", "n1"])

    seen = rows.select("toxic", "text").mapInArrow(occurrences, "before bigint, word bigint, n0 int, n1 int")
    seen = materialize(seen.groupBy("before", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "pairs")
    often = F.greatest("n0", "n1") >= LEAST
    frequent = materialize(seen.where(often).select("before", "word"), "frequent-pairs")
    known = None
    if frequent.count() <= most:
        columns = (np.asarray(c, dtype=np.int64).view(np.uint64) for c in frequent.toArrow().columns)
        known = rows.sparkSession.sparkContext.broadcast(Pairs(*columns))

    def expressions(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, 512):
                found = gather((y, hasher(t)) for y, t in _documents(part))
                if known is not None:
                    found = found[known.value.has(found[:, 2], found[:, 3])]
                found = found.T.copy().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["toxic", "far", "before", "word"])

    found = rows.select("toxic", "text").mapInArrow(expressions, "toxic bigint, far bigint, before bigint, word bigint")
    if known is None:
        found = found.join(frequent, ["before", "word"], "left_semi")
    kinds = found.groupBy("far", "before", "word").agg(F.max(1 - F.col("toxic")).alias("c0"), F.max("toxic").alias("c1"))
    counted = kinds.groupBy("before", "word").agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))
    return seen.where(~often).unionByName(materialize(counted, "counted-pairs"))


def _split(table: DataFrame, scale: list[float]) -> DataFrame:
    """``table`` with counts scaled (s0, s1) and divided into given (g0, g1) and kept (k0, k1) parts.

    The absolute discount of an expression is ALIKE times what both classes have
    of it and DISCOUNT standard errors. So a rare expression, or one that both
    use within that factor, gives its whole count in both classes.
    """
    table = table.withColumns({f"s{c}": F.col(f"n{c}") * scale[c] for c in (0, 1)})
    shared = ALIKE * F.least("s0", "s1") + DISCOUNT * F.sqrt(F.col("s0") + F.col("s1")) + 1.0
    table = table.withColumns({f"g{c}": F.least(F.col(f"s{c}"), shared) for c in (0, 1)})
    return table.withColumns({f"k{c}": F.col(f"s{c}") - F.col(f"g{c}") for c in (0, 1)})


def learn_evidence(pairs: DataFrame) -> DataFrame:
    """(word, before, ratio) of each word (null ``before``) and pair whose log ratio between the classes is not 0.

    A word counts by the number of distinct words before it: the Kneser-Ney
    continuation count, which copies of a passage do not raise. Pairs count in
    the same way. The larger class is scaled to the size of the smaller. Each
    class backs off from pairs to words, and from words to one distribution, the
    pooled discounts of both. Counts stay tables keyed by the words' hashes; only
    sums come to the driver. Pairs are scaled like words, by the distinct pairs
    of the classes, as rare pairs have no counts of the words before them.
    """
    words = pairs.groupBy("word").agg(*(F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"n{c}") for c in (0, 1)))
    words = materialize(words, "words")
    *sums, kinds = words.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0)), F.count(F.lit(1))).first()
    schema = "word bigint, before bigint, ratio double"
    if min(sums) == 0:  # a class without words: nothing to compare
        return pairs.sparkSession.createDataFrame([], schema)
    size = float(min(sums))
    words = _split(words, [size / x for x in sums])
    mass = words.agg(F.sum("k0"), F.sum("k1")).first()
    # Divided by the class's backoff weight: an expression that backs off in both classes has ratio 1.
    shared = (F.col("g0") + F.col("g1") + 0.5) / (2 * size - sum(mass) + 0.5 * kinds)
    words = words.withColumns({f"p{c}": F.col(f"k{c}") / size / max(1.0 - mass[c] / size, 1e-9) + shared for c in (0, 1)})
    alone = words.where("k0 > 0 OR k1 > 0").select("word", F.lit(None).cast("long").alias("before"), (F.log("p1") - F.log("p0")).alias("ratio"))

    known = _split(pairs, [size / x for x in sums]).where("k0 > 0 OR k1 > 0").select("before", "word", "k0", "k1")
    known = known.join(words.select("word", "p0", "p1"), "word")
    known = known.join(words.select(F.col("word").alias("before"), (F.col("s0") + F.col("s1")).alias("context")), "before", "left")
    share = [F.col(f"k{c}") / (F.coalesce("context", F.lit(0.0)) + F.col("k0") + F.col("k1") + 1.0) for c in (0, 1)]
    p = [share[c] + (1.0 - share[c]) * F.col(f"p{c}") for c in (0, 1)]
    ratio = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.log(p[1]) - F.log(p[0])))
    return materialize(alone.unionByName(known.select("word", "before", ratio.alias("ratio"))), "evidence")


class Evidence:
    """Log ratios of some words and pairs, looked up by full hashes."""

    def __init__(self, word: np.ndarray, before: np.ndarray, paired: np.ndarray, ratio: np.ndarray):
        """``paired`` tells which rows are pairs; ``before`` of the others is not read."""
        keys = (word[~paired], _pairs(word[paired], before[paired]))
        order = [np.argsort(k) for k in keys]
        self.keys = [k[o] for k, o in zip(keys, order, strict=True)]
        self.ratios = [r[o] for r, o in zip((ratio[~paired], ratio[paired]), order, strict=True)]

    def log_ratios(self, h: np.ndarray) -> np.ndarray:
        """log P(word | before, toxic) - log P(word | before, ordinary); 0 where a word comes again."""
        out = np.zeros(len(h))
        for keys, ratios, x in zip(self.keys, self.ratios, (h, _pairs(h, _before(h, 1))), strict=True):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                hit = keys[at] == x
                out[hit] = ratios[at[hit]]
        again = np.ones(len(h), dtype=bool)
        again[np.unique(h, return_index=True)[1]] = False
        out[again] = 0.0
        return out

    def features(self, h: np.ndarray) -> tuple[float, float, float]:
        """Log ratio of a text over its length, over the root of its length, and the highest mean of a window.

        Each is cut at plus and minus 3, and a text without words has zeros.
        """
        n = len(h)
        if n == 0:
            return 0.0, 0.0, 0.0
        ratios = self.log_ratios(h)
        sums = np.cumsum(np.concatenate([[0.0], ratios]))
        best = sums[-1] if n <= WINDOW else (sums[WINDOW:] - sums[:-WINDOW]).max()
        return tuple(float(np.clip(x, -3.0, 3.0)) for x in (sums[-1] / n, sums[-1] / np.sqrt(n), best / WINDOW))


def _evidence_of(rows) -> Evidence:
    """From columns word, before and ratio of an Arrow table or struct array."""
    word, before, ratio = (rows.column(c) if hasattr(rows, "column") else rows.field(c) for c in ("word", "before", "ratio"))
    paired = before.is_valid().to_numpy(zero_copy_only=False)
    unsigned = lambda x: x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return Evidence(unsigned(word), unsigned(before), paired, ratio.to_numpy(zero_copy_only=False).astype(np.float64))


def add_features(docs: DataFrame, evidence: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the three features of ``text`` as _a, _b and _c.

    Evidence of up to ``most`` rows is broadcast. More of it is joined to the
    distinct words and pairs of each text, and what is found comes back to the
    text by its digest.
    """
    names = docs.columns
    schema = StructType(docs.schema.fields + StructType.fromDDL("_a double, _b double, _c double").fields)
    small = evidence.count() <= most
    if small:
        shared = docs.sparkSession.sparkContext.broadcast(_evidence_of(evidence.toArrow().combine_chunks()))
    else:

        def expressions(batches):
            hasher = Hasher()
            for batch in batches:
                for part in slices(batch, 512):
                    for key, text in zip(part.column("_text").to_pylist(), part.column("text").to_pylist(), strict=True):
                        h = hasher(text)
                        found = np.unique(np.stack([h, _before(h, 1)], axis=1), axis=0).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["_text", "word", "before"])

        docs = docs.withColumn("_text", F.sha2("text", 256))
        own = docs.select("_text", "text").mapInArrow(expressions, "_text string, word bigint, before bigint")
        hits = own.join(evidence.where("before IS NOT NULL"), ["word", "before"]).select("_text", "word", "before", "ratio")
        alone = own.select("_text", "word").distinct().join(evidence.where("before IS NULL"), "word").select("_text", "word", "before", "ratio")
        found = hits.unionByName(alone).groupBy("_text").agg(F.collect_set(F.struct("word", "before", "ratio")).alias("_hits"))
        docs = docs.join(found, "_text", "left").select(*names, "_hits")

    def features(batches):
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, 512):
                texts = part.column("text").to_pylist()
                known = [shared.value] * len(texts) if small else [_evidence_of(part.column("_hits")[i].values) if part.column("_hits")[i].is_valid else None for i in range(len(texts))]
                x = np.array([(0.0, 0.0, 0.0) if k is None else k.features(hasher(t)) for k, t in zip(known, texts, strict=True)]).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(x[:, i]) for i in range(3))], names=[*names, "_a", "_b", "_c"])

    return docs.mapInArrow(features, schema)


class Model:
    """Evidence as a table that grows with the labelled texts, and the weights of the features."""

    def __init__(self, evidence: DataFrame):
        self.evidence = evidence
        self.weights = np.zeros(4)

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 0.1) -> None:
        """Logistic weights of the features and a constant, by Newton steps on standardised features."""
        if not len(y):
            return
        centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        design = np.column_stack([(x - centre) / scale, np.ones(len(x))])
        penalty = ridge * np.array([1.0] * x.shape[1] + [0.1])
        w = np.zeros(x.shape[1] + 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient = design.T @ (y - p) - penalty * w
            hessian = (design * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ design + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            w += np.clip(step, -2.0, 2.0)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = np.concatenate([w[:-1] / scale, [w[-1] - float((w[:-1] * centre / scale).sum())]])


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Training rows (doc_id, fold, toxic, text): labels are a table of at most about ``most`` rows, so they are broadcast."""
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    share = min(1.0, most / max(1, own.count()))
    if share < 1.0:
        own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("fold", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, most: int = 1_000_000) -> Model:
    """A model from ``labels`` (doc_id, toxic 0/1), whose crc32 fold of the id is not 0.

    Folds 1 to 3 are counted, fold 4 calibrates. At most about ``most`` labelled
    rows are used, taken evenly by a hash of the id; all of them below that.
    Words and pairs are counted exactly in tables that grow with the labelled
    texts; three features a calibration row reach the driver.
    """
    rows = _labelled(docs, labels, most)
    model = Model(learn_evidence(count_expressions(rows.where("fold < 4"))))
    tuned = add_features(rows.where("fold = 4").select("toxic", "text"), model.evidence).select("toxic", "_a", "_b", "_c").toPandas()
    model.calibrate(tuned[["_a", "_b", "_c"]].to_numpy(), tuned["toxic"].to_numpy().astype(float))
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5).

    Evidence that is measured small is broadcast, so scoring is one pass without
    a shuffle; otherwise it is joined (see ``add_features``). Null and empty
    texts get the score of a text without evidence. Repeated rows score alike;
    an empty table gives no rows; columns named score and predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    z = F.lit(float(model.weights[3]))
    for w, c in zip(model.weights, ("_a", "_b", "_c"), strict=False):
        z = z + float(w) * F.col(c)
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    scored = add_features(docs, model.evidence).withColumn("score", score)
    return scored.select(*docs.columns, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``, by a model trained on the labels not held out."""
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels, most))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
