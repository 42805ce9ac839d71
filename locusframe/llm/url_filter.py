"""URL filtering: rules first, then segmented host names and a naive Bayes over host and path tokens."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import slices
from locusframe.session import materialize

#: Words of page texts that may be parts of a host: ASCII letters, 2 to 20 of them.
PAGE_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]{2,20}(?![A-Za-z])")
MARKUP = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.S | re.I)
LONGEST = 20
#: Kinds of tokens that smoothing expects at least, seen or unseen; where more are seen, their number counts.
LEAST_KINDS = 1 << 16

# Tokens that name unwanted sites; they give the training labels.
BLOCK_SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "cheap", "escort", "farm", "gambling", "lottery", "pill", "pills",
    "poker", "porn", "sex", "spam", "track", "tracker", "viagra", "xxx",
)
#: Words that segmentation knows beside those of the pages.
KNOWN_WORDS = BLOCK_SEEDS + ("free", "win", "blog", "mail", "news", "shop", "example")


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased; empty without one."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict), both null where none fits.

    A rule is (allow or block, host/path). It fits its host and all subdomains
    where the path starts with the rule's; the longest fitting rule wins, and of
    equal ones the first given. Rules are a list of the caller's, so they become
    one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, (said, text) in sorted(enumerate(rules), key=lambda x: (len(x[1][1]), -x[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def page_words(pages: DataFrame) -> DataFrame:
    """(word, n) over the texts of all pages: counted in tasks, then summed."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, 256):
                found: Counter = Counter()
                for html in part.column("html").to_pylist():
                    if html:
                        found.update(PAGE_WORD.findall(MARKUP.sub(" ", html).lower()))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return pages.select("html").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of ``label`` whose words have the highest product of unigram probabilities.

    An unknown word of n letters has probability 10 / (total * 10^n), so words
    that the pages know are preferred and rare ones do not shatter.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    total = max(total, 1)
    for end in range(1, len(label) + 1):
        found = (-math.inf, end - 1)
        for start in range(max(0, end - LONGEST), end):
            word = label[start:end]
            n = counts.get(word)
            p = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            found = max(found, (best[start][0] + p, start))
        best.append(found)
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


def segment_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(label, parts) for each distinct run of letters in the ``host`` column.

    Every label meets the counts of its own substrings by a join, so neither all
    labels nor all words come to one place; a label has at most 20 substrings a
    letter.
    """
    labels = hosts.select(F.explode(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))).alias("label")).distinct()
    start = F.sequence(F.lit(1), F.length("label"))
    subs = labels.select("label", F.explode(start).alias("i")).select("label", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label") - F.col("i") + 1))).alias("k"))
    subs = subs.select("label", F.col("label").substr(F.col("i"), F.col("k")).alias("word")).distinct()
    known = words.sparkSession.createDataFrame([(w, 50) for w in KNOWN_WORDS], "word string, n bigint")
    # A stored word with fewer than three uses is more often a slip than a word.
    all_words = words.where("n >= 3").unionByName(known).groupBy("word").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 1
    joined = subs.join(all_words, "word", "left").groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n")))).alias("counts")
    )

    def split(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"label": pdf["label"], "parts": [viterbi(x, dict(c), int(total)) for x, c in zip(pdf["label"], pdf["counts"], strict=True)]})

    return joined.mapInPandas(split, "label string, parts array<string>")


def _tokens(parts, path: str | None) -> list[str]:
    words = [w.lower() for w in re.findall(r"[^\W\d_]+|\d+", path or "")]
    return [*(f"h:{p}" for p in parts if len(p) > 1), *("p:<number>" if w.isdigit() else f"p:{w}" for w in words)]


def token_ratios(judged: DataFrame, smoothing: float) -> DataFrame:
    """(token, ratio) of every token of ``judged`` (parts, path, seeded): log P(token | blocked) - log P(token | other).

    Tokens are counted by themselves in a table that grows with the urls; only
    sums come to the driver. Without blocked tokens there is nothing to compare
    and every ratio is 0.
    """

    def count(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for parts, path, seeded in zip(batch.column("parts").to_pylist(), batch.column("path").to_pylist(), batch.column("seeded").to_pylist(), strict=True):
                for t in _tokens(parts, path):
                    found.setdefault(t, [0, 0])[seeded] += 1
            n = np.array(list(found.values()), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["token", "n0", "n1"])

    counts = judged.select("parts", "path", "seeded").mapInArrow(count, "token string, n0 bigint, n1 bigint")
    counts = materialize(counts.groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "tokens")
    sums = counts.agg(F.sum("n0"), F.sum("n1"), F.count(F.lit(1))).first()
    if not sums[1]:
        return counts.select("token", F.lit(0.0).alias("ratio"))
    kinds = max(sums[2], LEAST_KINDS)
    p = [(F.col(f"n{c}") + smoothing) / (sums[c] + smoothing * kinds) for c in (0, 1)]
    return counts.select("token", (F.log(p[1]) - F.log(p[0])).alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], smoothing: float = 0.5, odds: float = 0.0) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages`` (page_id, url, html).

    The longest fitting rule decides. Where none fits, the host is split into
    words by unigram Viterbi over the words of all pages, and a multinomial
    naive Bayes over the tokens of host and path compares the classes. Its
    training labels are weak: a url whose split host holds a word of BLOCK_SEEDS
    is of the blocked class. Class priors are equal, so evidence decides; a log
    ratio above ``odds`` blocks.

    Tokens are counted by themselves, in a table that grows with the urls. The
    tokens of each distinct host and each distinct path are joined to it, and
    the two sums to the urls. Splits are made once a distinct name.

    A null url or one without ``://`` has empty host and path, no rule and no
    evidence, and is allowed. Null html adds no words. Repeated rows are judged
    one by one; an empty table gives no rows; other columns are not read.
    """
    url = F.col("url")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    names = F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0))
    hosts = base.select("host").distinct()
    parts = segment_hosts(hosts, materialize(page_words(pages), "words"))
    # Labels repeat across hosts (com, www), so they are put together a host at a time, of which there are few.
    split = hosts.select("host", F.posexplode(names).alias("at", "label")).join(parts, "label")
    split = materialize(split.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "parts"))), lambda x: x["parts"])).alias("parts")), "splits")
    seeds = F.array(*map(F.lit, BLOCK_SEEDS))
    judged = base.join(split, "host", "left").select(
        "page_id", "host", "path", F.coalesce("parts", F.array().cast("array<string>")).alias("parts")
    )
    judged = materialize(judged.withColumn("seeded", F.arrays_overlap("parts", seeds).cast("int")), "urls")

    def path_tokens(batches):
        for batch in batches:
            found = [(path, t) for path in batch.column("path").to_pylist() for t in _tokens((), path)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["path", "token"])

    ratios = token_ratios(judged, smoothing)
    of_host = split.select("host", F.explode(F.filter("parts", lambda p: F.length(p) > 1)).alias("part")).select("host", F.concat(F.lit("h:"), "part").alias("token"))
    of_path = judged.select("path").distinct().mapInArrow(path_tokens, "path string, token string")
    of_host = of_host.join(ratios, "token").groupBy("host").agg(F.sum("ratio").alias("host_ratio"))
    of_path = of_path.join(ratios, "token").groupBy("path").agg(F.sum("ratio").alias("path_ratio"))
    scored = judged.join(of_host, "host", "left").join(of_path, "path", "left")
    scored = scored.withColumn("log_ratio", F.coalesce("host_ratio", F.lit(0.0)) + F.coalesce("path_ratio", F.lit(0.0)))
    rule, said = match_rules(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("log_ratio") > odds, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("parts").alias("segments"), "log_ratio")
