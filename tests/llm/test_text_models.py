"""Spelling variants, language identification and tokenizer alignment against brute force, with awkward rows in every table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusframe.llm import alignment, languages, spelling
from locusframe.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def awkward():
    rng = random.Random(3)
    stems = ["garden", "gardens", "Garten1", "façade", "facade", "colour", "color", "colours", "straße", "ÀÀÀÀÀÀ", "lettering", "letterings", "x" * 300, "x" * 301]
    texts = [" ".join(rng.choices(stems, k=60)) for _ in range(60)]
    texts += [None, "", "   ", "\n\n", "don't I'll 12,345.67 ### x  y", "tab\there", "a \n\n b\n", "▁odd", "<|endoftext|> <s>", "日本語 é 😀", "nul\x00l", "a.b,c;d!e?f|g(h)i\"j'k", " ".join(stems * 500)]
    return [(None if i == 5 else i % 70, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "x", 1, "mine", 0.5) for i, t in awkward()]
    names = "doc_id long, text string, lang string, word string, block long, lang_pred string, score double"
    return spark.createDataFrame(rows, names).repartition(3)


# Spelling


def words_of(rows, slip):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    return n


def variants(n, shortest, least, times):
    kept = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    holes = defaultdict(set)
    for w in kept:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in kept:
        for i in range(len(w)):
            near[w] |= holes[w[:i], w[i + 1 :]] - {w}
            short = w[:i] + w[i + 1 :]
            if short in kept:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w in kept:
        best = min(near[w], key=lambda x: (-kept[x], x), default=None)
        if best and kept[best] >= times * kept[w]:
            form[w] = best
    out = {}
    for w in kept:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, kept[w], len(near[w]), kept.get(form.get(w)))
    return out


@pytest.mark.parametrize("slip,least,times", [(199, 5, 5), (7, 1, 2)])
def test_spelling_variants_match_brute_force(docs, slip, least, times):
    want = variants(words_of(awkward(), slip), 6, least, times)
    got = {r[0]: tuple(r) for r in spelling.spelling_variants(docs, 6, least, times, slip).collect()}
    assert got == want
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_subtrees_are_walked_and_dealt_whatever_their_size(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdqr", k=rng.choice([6, 7]))) for _ in range(1500)} | {"bcdefg", "cbdefg"})
    pairs = {tuple(sorted((v, w))) for v in words for w in words if v != w and (spelling.one_edit(v, w) or spelling.one_edit(w, v))}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for first, subtree in ((2, 10**6), (1, 60), (4, 7)):
        found = [tuple(sorted(r)) for r in spelling.near_words(table, 4, first, subtree).collect()]
        assert len(found) == len(set(found)) and set(found) == pairs
    a = np.zeros(3, dtype=np.int64)
    assert spelling.verified(["abcdef", "abcdeff", "abcdex", "badcef"], a, np.array([1, 2, 3])).tolist() == [True, True, False]


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w37"}


# Languages


def test_languages_of_awkward_rows(spark, docs):
    labelled = spark.createDataFrame(
        [("the garden and the letters", "en"), ("der Garten und die Straße", "de"), ("text without a label", None), (None, "fr"), ("日本語", "ja")],
        "text string, lang string",
    )
    got = languages.detect_languages(docs, labelled).select("text", "lang_pred", "score", "proportions", "word").collect()
    assert len(got) == docs.count() and {r.word for r in got} == {"x"}
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert abs(sum(r.proportions.values()) - letters) < 1e-6
    assert {r.lang_pred for r in languages.detect_languages(docs, labelled.limit(0)).collect()} == {"und"}
    assert languages.detect_languages(docs.limit(0), labelled).count() == 0


def test_mixed_documents_get_their_languages_and_shares(spark):
    en = "the quick brown fox jumps over the lazy dog while the weather keeps changing through the morning".split()
    de = "der schnelle braune fuchs springt über den faulen hund während sich das wetter am morgen ändert".split()
    labelled = spark.createDataFrame([(" ".join(en * 5), "en"), (" ".join(de * 5), "de")], "text string, lang string")
    texts = [(1, " ".join(en)), (2, " ".join(de)), (3, " ".join(en * 3 + de)), (4, " ".join(en + de * 3)), (5, "the"), (6, " ".join(en * 3 + de))]
    got = {r.doc_id: r for r in languages.detect_languages(spark.createDataFrame(texts, "doc_id long, text string"), labelled).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "en", "de", "en", "en"]
    assert set(got[1].proportions) == {"en"} and set(got[2].proportions) == {"de"}
    assert abs(got[3].proportions["en"] - 48 / 64) < 0.03 and abs(got[4].proportions["de"] - 48 / 64) < 0.04
    assert got[3].proportions == got[6].proportions


def test_model_is_a_distribution_and_counts_are_exact(spark):
    rows = [("abc abd", "en"), ("abc", "en"), ("ébc", "fr")]
    counts = languages.trigram_counts(spark.createDataFrame(rows, "text string, lang string")).collect()
    want = Counter((lang, g) for text, lang in rows for w in text.split() for g in languages.word_grams(w))
    assert {(r.lang, r.gram): r.n for r in counts} == want
    langs = ["en", "fr"]
    model = languages.Model(langs, *(np.array(x) for x in zip(*[(langs.index(x), g, n) for (x, g), n in want.items()], strict=True)))
    for context in (0x6162, 0x7A7A, 0xFF61):
        assert np.allclose(np.exp(model.gram_logs((context << 8) + np.arange(256))).sum(axis=0), 1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = languages.held_out_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


# Alignment


def spans(parts):
    ends = np.cumsum([len(x) for x in parts]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def aligned_alone(a_tok, b_tok, letters, text):
    """Ids, groups and links of a text encoded whole."""
    a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
    a_parts = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
    b_parts = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
        return None
    sa, sb = spans(a_parts), spans(b_parts)
    links, start = [], 0
    for i, (lo, hi) in enumerate(sa):
        while sb[start][1] <= lo:
            start += 1
        j = start
        while j < len(sb) and sb[j][0] < hi:
            links.append((a[i], b[j]))
            j += 1
    groups, i, j = [], 0, 0
    for cut in sorted({x[1] for x in sa} & {x[1] for x in sb}):
        i2, j2 = (next((k for k in range(at, len(s)) if s[k][1] == cut)) + 1 for at, s in ((i, sa), (j, sb)))
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    return a, b, groups, links


def test_alignment_matches_whole_texts(spark, docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    every = docs.select("doc_id", "text").unionByName(more)
    alone = [(r.doc_id, aligned_alone(a_tok, b_tok, letters, r.text) if r.text else None) for r in every.collect()]
    count, top = Counter(), {}
    for _, found in alone:
        count.update(found[3] if found else ())
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    want = []
    for i, found in alone:
        a, b, groups, links = found or ([], [], [], [])
        text = ";".join(groups)
        best = sum(count[p] == top[p[1]] for p in links)
        want.append((i, len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), text and hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in alignment.align_tokenizers(every, A, B).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(1 for _, found in alone if found) > 200
    assert alignment.align_tokenizers(docs.limit(0), A, B).count() == 0
    assert alignment.align_tokenizers(docs.where("doc_id = 3"), A, B, texts=True).first().groups.count("|") > 10


def test_containers_and_planes_give_back_documents_and_links():
    rng = np.random.default_rng(1)
    for size in (1, 4095, 4096, 60_000):
        places = np.sort(rng.choice(1 << 16, size, replace=False))
        links = rng.integers(1, 9, size)
        planes = alignment.planes_of(places, links)
        assert (alignment.or_merged(planes) == places).all()
        back = np.zeros(1 << 16, dtype=np.int64)
        for bit, plane in enumerate(planes):
            back[alignment.members(plane)] += 1 << bit
        assert (back[places] == links).all() and back.sum() == links.sum()


def test_many_small_blocks_give_the_same_scores(docs):
    want = sorted(map(repr, alignment.align_tokenizers(docs, A, B).collect()))
    whole = alignment.pair_counts(alignment.align_blocks(docs, A, B))
    parts = alignment.pair_counts(alignment.align_blocks(docs.repartition(9), A, B))
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()
    assert want == sorted(map(repr, alignment.align_tokenizers(docs.repartition(9), A, B).collect()))
