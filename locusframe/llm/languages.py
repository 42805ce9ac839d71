"""Language identification: each document's language proportions by expectation-maximisation over n-gram likelihoods.

A language is a model of bytes within words: trigrams, interpolated with bigrams
and unigrams (Witten-Bell). A document is a mixture of languages that deals out
words; the proportions are fitted by expectation-maximisation, and a language
joins the set only while that lowers the penalised likelihood (BIC).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import fold, slices
from locusframe.session import materialize

#: A word is a run of letters of any script.
LETTERS = re.compile(r"[^\W\d_]+")
#: Ends of a word, a byte that UTF-8 never uses.
END = b"\xff"
#: Bytes of a trigram, and so the most trigrams that any corpus can have: 256 ** 3.
ORDER = 3
#: Words whose likelihoods a worker remembers.
KEEP = 400_000
#: Distinct (language, word) that a task counts before it hands on their trigrams.
HELD = 200_000
#: Proportions have settled when none moves by more.
SETTLED = 1e-4


# Training


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): byte trigrams of all words of the labelled texts, the word's ends included.

    ``gram`` is the trigram as a number of 24 bits. A null text has no words.
    """

    def count(batches):
        words: dict[str, Counter[str]] = {}

        def rows():
            grams: Counter[tuple[str, int]] = Counter()
            for lang, found in words.items():
                for word, n in found.items():
                    for gram in word_grams(word):
                        grams[lang, gram] += n
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in grams], pa.string()), pa.array([x for _, x in grams], pa.int32()), pa.array(list(grams.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )

        for batch in batches:
            for part in slices(batch, 512):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text:
                        words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
                if sum(map(len, words.values())) > HELD:
                    yield rows()
                    words = {}
        if words:
            yield rows()

    return labelled.select("lang", "text").mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def word_grams(word: str) -> list[int]:
    """The byte trigrams of a word between two ends before it and one after it, as numbers."""
    raw = END + END + word.encode() + END
    return [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]


class Model:
    """Log-likelihoods of words under each language, from trigram counts; held by each Python worker once.

    A trigram's probability is interpolated with that of its last two bytes and
    its last byte, by the number of different bytes seen in each context, down
    to an even spread; so no word has probability zero.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        many = len(langs)
        n = n.astype(np.float64)

        def table(key: np.ndarray, of: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(key, return_inverse=True)
            sums = np.zeros((len(keys), many))
            np.add.at(sums, (at, of), weight)
            return keys, sums

        # Each order has the counts of its grams and, for its contexts, the totals and the number of kinds.
        self.orders = []
        for bits in (8, 16, 24):
            keys, counts = table(gram & ((1 << bits) - 1), lang, n)
            contexts, totals = table(np.repeat(keys >> 8, many), np.tile(np.arange(many), len(keys)), counts.ravel())
            _, kinds = table(np.repeat(keys >> 8, many), np.tile(np.arange(many), len(keys)), (counts > 0).ravel().astype(np.float64))
            self.orders.append((bits, keys, counts, contexts, totals, kinds))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.empty((1024, len(self.langs)))

    @staticmethod
    def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], values[at], 0.0)

    def gram_logs(self, gram: np.ndarray) -> np.ndarray:
        """log P(last byte | the two before it) of each gram under each language."""
        p = np.full((len(gram), len(self.langs)), 1 / 256)
        for bits, keys, counts, contexts, totals, kinds in self.orders:
            part = gram & ((1 << bits) - 1)
            total, kind = self._rows(contexts, totals, part >> 8), self._rows(contexts, kinds, part >> 8)
            seen = total + kind > 0
            p = np.where(seen, (self._rows(keys, counts, part) + kind * p) / np.where(seen, total + kind, 1), p)
        return np.log(p)

    def learn(self, words: list[str]) -> None:
        """Likelihoods of words that are not known yet."""
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            grams = [word_grams(w) for w in part]
            lens = np.array([len(g) for g in grams])
            flat = np.concatenate([np.array(g, dtype=np.int64) for g in grams])
            kinds, place = np.unique(flat, return_inverse=True)
            sums = np.add.reduceat(self.gram_logs(kinds)[place], np.cumsum(lens) - lens, axis=0)
            first = len(self.known)
            while first + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[first : first + len(part)] = sums
            self.known.update(zip(part, range(first, first + len(part)), strict=True))

    def logs(self, words: list[str]) -> np.ndarray:
        """Rows of log-likelihoods, one a word."""
        if len(self.known) > KEEP:
            self.forget()
        new = list(set(words).difference(self.known))
        if new:
            self.learn(new)
        return self.rows[list(map(self.known.__getitem__, words))]


# Documents


def fitted(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation from ``share`` on, and the log-likelihood they give.

    ``p`` has a word a row and a language a column, ``n`` how often the word occurs.
    """
    total = n.sum()
    while True:
        mixed = p @ share
        moved = share * (n / mixed @ p) / total
        if np.abs(moved - share).max() < SETTLED:
            return moved, float(n @ np.log(p @ moved))
        share = moved


def mixture(logs: np.ndarray, n: np.ndarray, penalty: float = 1.0) -> dict[int, float]:
    """The languages of a document and their proportions, from the log-likelihoods of its words and their counts.

    Starts from the likeliest single language. The language whose share would
    raise the likelihood fastest is tried next and stays if the gain is above
    ``penalty * log(words)``, the cost of its proportion and of its place in the
    set; since the likelihood is concave, its slope bounds the gain, and most
    documents need no fit. Ties go to the first language.
    """
    if logs.shape[1] == 1:
        return {0: 1.0}
    top = logs.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(logs - top, -60.0))
    total = float(n.sum())
    cost = penalty * math.log(total + 1) + math.log(logs.shape[1])
    sums = n @ (logs - top)
    chosen = [int(np.argmax(sums))]
    share, best = np.ones(1), float(n @ np.log(p[:, chosen[0]]))
    while len(chosen) < logs.shape[1]:
        slope = (n / (p[:, chosen] @ share)) @ p
        slope[chosen] = -np.inf
        entrant = int(np.argmax(slope))
        if slope[entrant] - total <= cost:
            break
        tried = [*chosen, entrant]
        start = np.append(share * (1 - 1 / (len(tried) + 1)), 1 / (len(tried) + 1))
        moved, gained = fitted(p[:, tried], n, start)
        if gained - best <= cost:
            break
        chosen, share, best = tried, moved, gained
    return dict(zip(chosen, share.tolist(), strict=True))


def detect_languages(docs: DataFrame, labelled: DataFrame, penalty: float = 1.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``proportions`` (language to share of the words, 0 to 1).

    ``lang_pred`` is the language with the largest proportion and ``score`` that
    proportion times the confidence that it leads: its likelihood against the
    next single language, a word. ``labelled`` (text, lang) is what the models
    learn from, all of it; rows without lang are left out.

    A text that is null or has no letter is ``und`` with score 0 and no
    proportions, and so is every text if nothing is labelled. Texts are taken
    whole; repeated rows are judged one by one; ties go to the first language in
    code-point order; an empty table gives no rows; columns of ``docs`` with the
    new names are replaced. The models are trigram counts, at most 256 ** 3 for
    each language in any corpus, and go to the tasks as one broadcast.
    """
    spark = docs.sparkSession
    counts = materialize(trigram_counts(labelled.where("lang IS NOT NULL").select("lang", "text")), "trigrams")
    rows = counts.toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(names)}
    sent = spark.sparkContext.broadcast(
        (
            names,
            np.array([place[x] for x in rows.column("lang").to_pylist()], dtype=np.int16),
            rows.column("gram").to_numpy().astype(np.int32),
            rows.column("n").to_numpy(),
        )
    )
    new = ["lang_pred", "score", "proportions"]
    docs = docs.drop(*new)
    schema = docs.select("*", F.lit("").alias(new[0]), F.lit(0.0).alias(new[1]), F.create_map(F.lit(""), F.lit(0.0)).alias(new[2])).schema

    def run(batches):
        langs, lang, gram, n = sent.value
        model = Model(langs, lang.astype(np.int64), gram.astype(np.int64), n) if langs else None
        for batch in batches:
            for part in slices(batch, 512):
                best, score, shares = [], [], []
                for text in part.column("text").to_pylist():
                    words = Counter(LETTERS.findall(text.lower())) if text and model else None
                    if not words:
                        best.append("und")
                        score.append(0.0)
                        shares.append([])
                        continue
                    times = np.array(list(words.values()), dtype=np.float64)
                    logs = model.logs(list(words))
                    found = mixture(logs, times, penalty)
                    first = min(found, key=lambda k: (-found[k], k))
                    sums = times @ logs / times.sum()
                    others = np.delete(sums, first)
                    lead = 1 / (1 + math.exp(-max(-60.0, min(60.0, sums[first] - others.max())))) if len(others) else 1.0
                    best.append(langs[first])
                    score.append(min(1.0, max(0.0, found[first] * lead)))
                    shares.append([(langs[k], v) for k, v in found.items()])
                columns = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *new])

    return docs.mapInArrow(run, schema)


def held_out_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; the models learn from those outside the held-out fold."""
    held = fold(F.col("doc_id"), folds) == 0
    texts = docs.select("doc_id", "text", held.alias("held_out"))
    return detect_languages(texts, docs.where(~held).select("text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
