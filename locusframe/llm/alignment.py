"""Cross-tokenizer alignment: token groups of two tokenizers, and pair counts from inverted pair bitmaps.

Every pair of ids whose tokens overlap somewhere is a key of an inverted index.
Its postings are bitmaps of documents, one per bit of the number of links that a
document has of the pair (multiplicity planes), kept per block of up to 65,536
documents as a compressed container. The planes OR-merged and popcounted give the
pair's documents; popcounts weighed by their bit give its links; the same
postings, read back with the counts, give each document its scores.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm.common import slices
from locusframe.llm.tokens import OTHER_SPACE, PIECES, encoder
from locusframe.session import materialize

#: Documents in one block; their places in it fit 16 bits.
BLOCK_ROWS = 1 << 16
#: Postings held by a task before its block is closed.
BLOCK_LINKS = 3_000_000
#: A container of so many documents or more is a plain bit field of 8,192 bytes, one of fewer a sorted list of places.
DENSE = 4096
#: Pieces that a worker remembers with their alignment, and that it remembers with their first ids, before it starts anew.
KEEP, ENCODED = 300_000, 150_000
#: Blanks and letters before a sign, else text up to a blank, else blanks at the end.
PARTS = re.compile(r"[ \n]*+[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,;:!?|()\"'])|[ \n]*+[^ \n]++|[ \n]++")
#: A vocabulary entry that spans a letter and the sign after it.
SPANS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?|()\"']")
#: Stands before a sign that is encoded alone.
LETTER = "a"


# Containers


def container(places: np.ndarray) -> bytes:
    """A compressed bitmap of sorted distinct places below 65,536."""
    if len(places) >= DENSE:
        bits = np.zeros(BLOCK_ROWS, dtype=np.uint8)
        bits[places] = 1
        return np.packbits(bits).tobytes()
    return places.astype("<u2").tobytes()


def members(data: bytes) -> np.ndarray:
    """The places of a container, ascending."""
    if len(data) == 2 * DENSE:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))
    return np.frombuffer(data, "<u2").astype(np.int64)


def or_merged(planes: list[bytes]) -> np.ndarray:
    """The places in any of the containers."""
    found = [members(p) for p in planes]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def planes_of(places: np.ndarray, links: np.ndarray) -> list[bytes]:
    """One container per bit of ``links``, the number of links at each of the sorted places."""
    top = int(links.max())
    if top == 1:
        return [container(places)]
    return [container(places[(links >> bit) & 1 == 1]) for bit in range(top.bit_length())]


# Alignment of pieces of text


class Aligner:
    """Aligns texts piece by piece and remembers pieces; one for each Python worker.

    Both tokenizers cut before a blank that follows another character and
    between a letter and the sign after it, so a piece (blanks with letters, or
    text up to the next blank) is aligned alone. A text with white space other
    than blanks and line ends is one piece.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = encoder(a_path, ENCODED)
        # The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on in ascending order.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spelled = {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(sorted(set(range(256)) - set(printable)))}
        vocabulary = self.a.plain.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(spelled[c] for c in entry) if all(c in spelled for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelt = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelt)]
        #: Letters and signs are parted only if no entry of the second vocabulary spans such a place.
        self.cut = PIECES if any(SPANS.search(p) for p in spelt) else PARTS
        self.blank, self.letter = self.b.piece_to_id("▁"), self.b.encode(LETTER)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        #: An id as text with the mark after it: a comma within a side, a bar between sides, a semicolon between groups.
        self.most = max(len(self.a_bytes), len(self.b_bytes))
        self.names = [f"{i}{mark}" for mark in ",|;" for i in range(self.most)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        #: Per piece: tokens of each side, groups, links, and whether both sides spell it.
        self.counts = np.zeros((1024, 5), dtype=np.int64)
        self.starts = np.zeros(1024, dtype=np.int64)
        self.links = np.zeros(4096, dtype=np.uint32)
        self.n_links = 0

    def _a_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of the first tokenizer; plain pieces go to its model as they are."""
        found = [self.a.plain_ids(p) for p in pieces]
        others = iter(self.a.encode([p for p, ids in zip(pieces, found, strict=True) if ids is None]))
        return [next(others) if ids is None else ids for ids in found]

    def _b_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of the second tokenizer, without the blank that it adds to a piece that starts with none."""
        # A blank is left to the tokenizer; a sign follows a letter, as it does in the text.
        found = self.b.encode([p[1:] if p[0] == " " else p if p[0] == "\n" else LETTER + p for p in pieces], num_threads=1)
        for k, piece in enumerate(pieces):
            if piece == " ":
                found[k] = [self.blank]
            elif piece[0] != " ":
                added = [self.blank] if piece[0] == "\n" else self.letter
                if found[k][: len(added)] != added:
                    raise ValueError(f"the second tokenizer does not cut before {piece[:40]!r}")
                found[k] = found[k][len(added) :]
        return found

    def learn(self, pieces: list[str]) -> None:
        """Align pieces that are not known yet, all in one pass over their joined bytes."""
        a_all = [np.frombuffer(x, "<u4") for x in self._a_ids(pieces)]
        b_all = self._b_ids(pieces)
        raw = [p.encode() for p in pieces]
        counts = np.zeros((len(pieces), 5), dtype=np.int64)
        counts[:, 0], counts[:, 1] = [len(x) for x in a_all], [len(x) for x in b_all]
        a, b = np.concatenate(a_all).astype(np.int64), np.fromiter(itertools.chain.from_iterable(b_all), np.int64)
        counts[:, 4] = 1
        sides = ((a, self.a_bytes, 0), (b, self.b_bytes, 1))
        if any(b"".join(map(table.__getitem__, ids.tolist())) != b"".join(raw) for ids, table, _ in sides):
            for ids, table, c in sides:
                ends = np.cumsum(counts[:, c]).tolist()
                for k, (end, n, want) in enumerate(zip(ends, counts[:, c].tolist(), raw, strict=True)):
                    counts[k, 4] &= b"".join(map(table.__getitem__, ids[end - n : end].tolist())) == want
            good = counts[:, 4] == 1
            a, b = a[np.repeat(good, counts[:, 0])], b[np.repeat(good, counts[:, 1])]
        good = np.flatnonzero(counts[:, 4])
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        piece_ends = np.cumsum([len(raw[k]) for k in good.tolist()], dtype=np.int64)
        # Between two ends of either side lies one overlap of one token with one token.
        ends, common = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends)
        links = a[np.searchsorted(a_ends, ends)] << 16 | b[np.searchsorted(b_ends, ends)]
        counts[good, 2] = np.bincount(np.searchsorted(piece_ends, common), minlength=len(good))
        counts[good, 3] = np.bincount(np.searchsorted(piece_ends, ends), minlength=len(good))
        self._keep(pieces, counts, links)
        place = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        order = np.argsort(place, kind="stable")
        place = np.append(place[order], -1)
        mark = np.where(place[1:] == place[:-1], 0, np.where(place[:-1] % 2 == 0, 1, 2))
        parts = list(map(self.names.__getitem__, (mark * self.most + np.concatenate([a, b])[order]).tolist()))
        at = 0
        for n in ((counts[:, 0] + counts[:, 1]) * counts[:, 4]).tolist():
            self.texts.append("".join(parts[at : at + n])[:-1])
            at += n

    def _keep(self, pieces: list[str], counts: np.ndarray, links: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(pieces)
        while last > len(self.counts):
            self.counts, self.starts = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.n_links + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.counts[first:last] = counts
        self.starts[first:last] = self.n_links + np.cumsum(counts[:, 3]) - counts[:, 3]
        self.links[self.n_links : self.n_links + len(links)] = links
        self.n_links += len(links)
        self.known.update(zip(pieces, range(first, last), strict=True))

    def pieces(self, texts: list[str | None]) -> list[list[int]]:
        """Numbers of the known pieces of each text; none for an empty one."""
        cuts = [[] if not t else [" " + t] if OTHER_SPACE.search(t) else self.cut.findall(" " + t) for t in texts]
        new = list(set().union(*cuts).difference(self.known))
        for at in range(0, len(new), 16_384):
            self.learn(new[at : at + 16_384])
        return [list(map(self.known.__getitem__, cut)) for cut in cuts]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this Python worker, which later tasks use again."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


# Documents and postings

_ALIGNED = "kind string, block bigint, place int, doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, a_id int, b_id int, n_docs bigint, planes array<binary>"


def _expand(who: np.ndarray, pieces: np.ndarray, al: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) for documents and their pieces, each (document, pair) once."""
    if not len(who):
        return who, who, who
    at, n = np.unique(who.astype(np.int64) << 32 | pieces, return_counts=True)
    docs, of = at >> 32, at & 0xFFFFFFFF
    size = al.counts[of, 3]
    first = np.repeat(al.starts[of] - (np.cumsum(size) - size), size)
    pairs = al.links[first + np.arange(int(size.sum()))].astype(np.int64)
    docs, links = np.repeat(docs, size), np.repeat(n, size)
    order = np.lexsort((pairs, docs))
    docs, pairs, links = docs[order], pairs[order], links[order]
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])]))
    return docs[new], pairs[new], np.add.reduceat(links, new)


def _posting_rows(pairs: np.ndarray, places: np.ndarray, links: np.ndarray) -> Iterator[tuple[int, int, list[bytes]]]:
    """(pair, documents, planes) of a block's postings."""
    order = np.argsort(pairs << 16 | places)
    pairs, places, links = pairs[order], places[order], links[order]
    cuts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])).tolist() + [len(pairs)] if len(pairs) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        planes = planes_of(places[a:b], links[a:b])
        yield int(pairs[a]), len(or_merged(planes)), planes


def align_blocks(docs: DataFrame, a_path: str, b_path: str, texts: bool = False) -> DataFrame:
    """One pass over ``docs``: rows of documents (kind ``doc``) and of postings (kind ``pair``), stored.

    ``groups`` is the sha256 of a document's groups, or the groups themselves with ``texts``.
    """
    docs = docs.select("doc_id", "text")
    schema = _ALIGNED.format(id=docs.schema["doc_id"].dataType.simpleString())

    def run(batches):
        al = aligner(a_path, b_path)
        names = [x.strip().split()[0] for x in schema.split(", ")]
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pairs, places, links
        rows = entries = 0
        out = None

        def record(**columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out
            )

        def close():
            pairs, places, links = (np.concatenate(x) for x in zip(*held, strict=True))
            found = list(_posting_rows(pairs, places, links))
            for at in range(0, len(found), 20_000):
                part = found[at : at + 20_000]
                yield record(
                    kind=["pair"] * len(part),
                    block=[task << 32 | made] * len(part),
                    a_id=[p >> 16 for p, _, _ in part],
                    b_id=[p & 0xFFFF for p, _, _ in part],
                    n_docs=[n for _, n, _ in part],
                    n_links=[sum(len(members(x)) << bit for bit, x in enumerate(planes)) for _, _, planes in part],
                    planes=[planes for _, _, planes in part],
                )

        for batch in batches:
            if out is None:
                kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary())}
                types = [x.strip().split(" ", 1)[1] for x in schema.split(", ")]
                out = pa.schema([(n, batch.schema.field("doc_id").type if n == "doc_id" else kinds[t]) for n, t in zip(names, types, strict=True)])
            for part in slices(batch, 256):
                if rows + part.num_rows > BLOCK_ROWS or entries > BLOCK_LINKS:
                    yield from close()
                    held, rows, entries, made = [], 0, 0, made + 1
                if len(al.known) > KEEP:
                    al.forget()
                cuts = al.pieces(part.column("text").to_pylist())
                n = part.num_rows
                who = np.repeat(np.arange(n), [len(x) for x in cuts])
                used = np.fromiter(itertools.chain.from_iterable(cuts), np.int64, len(who))
                # A document with a piece that its tokens do not spell has no tokens at all.
                good = np.bincount(who, 1 - al.counts[used, 4], n) == 0
                who, used = who[good[who]], used[good[who]]
                cols = {c: np.bincount(who, al.counts[used, k], n).astype(np.int64) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                groups = [";".join(map(al.texts.__getitem__, x)) if ok else "" for x, ok in zip(cuts, good.tolist(), strict=True)]
                cols["groups"] = groups if texts else [g and hashlib.sha256(g.encode()).hexdigest() for g in groups]
                places, pairs, links = _expand(who, used, al)
                held.append((pairs, places + rows, links))
                entries += len(pairs)
                yield record(kind=["doc"] * n, block=[task << 32 | made] * n, place=range(rows, rows + n), doc_id=part.column("doc_id"), **cols)
                rows += n
        if held:
            yield from close()

    return materialize(docs.mapInArrow(run, schema), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, n_links, best) from postings; ``best`` marks the highest n_links of a b_id, ties included."""
    counts = blocks.where("kind = 'pair'").groupBy("a_id", "b_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    # A window holds the pairs of one b_id: at most as many as the other vocabulary has entries.
    return counts.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b_id")))


def returned_scores(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, place, n_best, count_sum): the counts of pairs, handed by their postings to the documents of each block."""
    postings = blocks.where("kind = 'pair'").select("block", "a_id", "b_id", "planes")
    scored = postings.join(counts.select("a_id", "b_id", F.col("n_links").alias("count"), "best"), ["a_id", "b_id"]).select("block", "planes", "count", "best")

    def score(table: pa.Table) -> pa.Table:
        sums, best = np.zeros(BLOCK_ROWS, np.int64), np.zeros(BLOCK_ROWS, np.int64)
        for batch in table.to_batches(max_chunksize=8192):
            places, weights, firsts = [], [], []
            for planes, count, top in zip(*(batch.column(c).to_pylist() for c in ("planes", "count", "best")), strict=True):
                for bit, plane in enumerate(planes):
                    if plane:
                        at = members(plane)
                        places.append(at)
                        weights.append((len(at), count << bit, top << bit))
            if places:
                lens, weight, first = np.array(weights, dtype=np.int64).T
                at = np.concatenate(places)
                np.add.at(sums, at, np.repeat(weight, lens))
                np.add.at(best, at, np.repeat(first, lens))
        hit = np.flatnonzero(sums)
        block = table.column("block")[0].as_py()
        return pa.table(
            {"block": pa.array([block] * len(hit), pa.int64()), "place": pa.array(hit, pa.int32()), "n_best": best[hit], "count_sum": sums[hit]}
        )

    return scored.groupBy("block").applyInArrow(score, "block bigint, place int, n_best bigint, count_sum bigint")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, texts: bool = False) -> DataFrame:
    """Per document its tokens by both tokenizers, groups, links and the corpus-wide standing of the links.

    ``a_path`` names a byte-level BPE of the tokenizers library, which gets a
    blank before the text; ``b_path`` a sentencepiece model, which adds one.
    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``:
    their sha256, or with ``texts`` the groups themselves (``a1,a2|b1;a3|b2``).

    A null or empty text, or one whose tokens do not spell it, has no tokens:
    zeros and an empty ``groups``. Repeated rows and null ids are counted row by
    row; equal counts of a b_id are all its best; an empty table gives no rows;
    other columns of ``docs`` are ignored. The work is linear in the links: a
    block's postings are bounded, and a pair has one row a block.
    """
    blocks = align_blocks(docs, a_path, b_path, texts)
    counts = materialize(pair_counts(blocks), "pairs")
    scores = returned_scores(blocks, counts)
    rows = blocks.where("kind = 'doc'").select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")
    zero = F.lit(0).cast("long")
    return rows.join(scores, ["block", "place"], "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups",
    )
