"""The training-data operators' plain functions against brute force and public libraries."""

import base64
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm import bpe, common, embeddings, jaccard, langid, packing, pii, urlfilter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", " ", "aaaa" * 300, "ab" * 700 + "c", "the" * 900, "日本語テキスト ²³½ ⅷ", "İstanbul ΣΑΣ Σ ﬁ", "😀👨‍👩‍👧", "\x1c\x1d\x85 x᠎y\xa0z  \n\n a", "SSß ÿŸ µ 's 'LL don't", "<|endoftext|> x", "é Å"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, dtype="<u4").tolist()


def test_byte_bpe_matches_the_library(library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdeth '\n1é") for _ in range(rng.randrange(600))) for _ in range(60)]
    texts += ["".join(rng.choice("abcdeth") for _ in range(3000)), *(f"x {chr(c)} {chr(c)}a 1{chr(c)}" for c in range(0x2100))]
    encoder = bpe.byte_encoder(RANKS, public_tokenizers.PATTERN)
    got = encoder.encode(texts)
    for text, found in zip(texts, got, strict=True):
        assert ids(found) == library.encode_ordinary(text), text[:40]
        assert encoder.decode(found) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_byte_bpe_round_trip(text):
    encoder = bpe.byte_encoder(RANKS, public_tokenizers.PATTERN)
    assert encoder.decode(encoder.encode([text])[0]) == text.encode()


def test_forgetting_changes_nothing(monkeypatch, library):
    encoder = bpe.ByteEncoder(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    for _ in range(3):
        assert [ids(x) for x in encoder.encode(["some words here and there", "others"])] == [library.encode_ordinary(x) for x in ("some words here and there", "others")]


def test_word_bpe_matches_the_library():
    tokenizer = Tokenizer.from_file(WORDS)
    rng = random.Random(6)
    texts = ODD + ["hello <|endoftext|> world", "<|startoftext|>x<|endoftext|><|endoftext|>É", "a<|ENDOFTEXT|>b <|endoftext| >", "<<|endoftext|>>'s <|endoftext|>'s", "é\u0301<|endoftext|>\u0301"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x800), rng.randrange(0x800, 0xD800)])) for _ in range(200)) for _ in range(100)]
    got = bpe.word_encoder(WORDS).encode(texts)
    for text, found, expected in zip(texts, got, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids(found) == expected.ids, text[:40]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IPS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARDS = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONES = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IPS.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARDS.finditer(text) if 12 <= len(digits(m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(m)))) % 10 == 0]
    found += [("phone", m.start(), m.end()) for m in PHONES.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123459()é%\n", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans():
    text = "mail a.b@c.d.org, 4111 1111 1111 1111 or +1 (555) 555-1234 from 10.0.0.255; not 1.2.3.256, 4111 1111 1111 1112"
    assert [k for k, _, _ in pii.base_spans(text)] == ["email", "card", "phone", "ip"] == [k for k, _, _ in plain_spans(text)]
    assert pii.sanitise("x a@b.cd y", pii.base_spans("x a@b.cd y"), {}) == "x [EMAIL] y"


def plain_contexts(text, spans, near):
    words = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    free = [w for w in words if not any(a < w[1] and w[0] < b for _, a, b in spans)]
    out = []
    for _, a, b in spans:
        before, after = [w for w in free if w[1] <= a], [w for w in free if w[0] >= b]
        out.append([text[x:y].lower() for x, y in before[-near:] + after[:near]])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.cd", "1.2.3.4", "Word", "x", "é", ", ", " ", "  ", "+1 555 555 1234", "_", "a" * 300]), max_size=30), st.integers(1, 4))
def test_contexts_and_term_spans(parts, near):
    text = "".join(parts)
    spans = pii.base_spans(text)
    assert [words for _, words in pii.contexts(text, spans, near)] == plain_contexts(text, spans, near)
    terms = {"word": "remove", "x": "generalise"}
    plain = [("term", m.start(), m.end()) for m in re.finditer(r"\w+", text) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in spans)]
    assert pii.term_spans(text, terms, spans) == plain


def test_contexts_are_linear():
    text = " ".join(f"user{i}@mail.example some words" for i in range(20_000))
    spans = pii.base_spans(text)
    began = time.process_time()
    assert len([*pii.contexts(text, spans, 8)]) == 20_000 and pii.term_spans(text, {"some": "remove"}, spans)
    assert time.process_time() - began < 3


def test_shingles():
    words = "a b c d e f g a b c d e".split()
    text = "  A b\nc\td e   f g a b c d e "
    sets = jaccard.shingles([text, "", "one two", "\n", "one  TWO", " ".join(words), "x y z w v"], 5)
    assert [len(x) for x in sets] == [7, 0, 1, 0, 1, 7, 1]
    assert (sets[0] == sets[5]).all() and sets[2] == sets[4] and sets[2] != sets[6]
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "c", "dé", "a", "bc"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    got = jaccard.shingles(texts, 5)
    of = {}
    for text, found in zip(texts, got, strict=True):
        w = text.split()
        plain = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(found) == len(plain)
        for other, also in of.values():
            assert len(np.intersect1d(found, also)) == len(plain & other)
        of[len(of) % 20] = (plain, found)


def test_forest_recall():
    forest = jaccard.Forest()
    rng = np.random.default_rng(0)
    shared = np.zeros(2)
    agree = []
    for _ in range(300):  # pairs of similarity 0.8
        both = rng.integers(0, 2**63, 100).astype(np.uint64)
        a, b = np.unique(both[:90]), np.unique(both[10:])
        values = jaccard.minhash([a, b], forest.trees, forest.depth)
        agree.append((values[0] == values[1]).mean())
        assert (values[0, :, : jaccard.SKETCHED] == values[1, :, : jaccard.SKETCHED]).mean() >= forest.plausible
        for i, depth in enumerate((forest.shortest, 8)):
            keys = jaccard.prefix_keys(values, depth)
            shared[i] += (keys[0] == keys[1]).any()
    assert shared[0] == 300 and shared[1] >= 295
    assert 0.79 < np.mean(agree) < 0.81


def test_prefixes_are_shortened_until_the_recall():
    forest = jaccard.Forest()

    def prefix(**links):
        seen = np.zeros(129)
        for similarity, n in links.items():
            s = float(similarity[1:]) / 100
            seen[round(128 * (s + (1 - s) / 256))] += n * jaccard.PROBED * s**forest.depth
        depth = forest.prefix(seen)
        s, n = np.array([float(k[1:]) / 100 for k in links] + [0.8]), np.array([*links.values(), 3])
        assert n @ forest.found(s, depth) >= 0.9999 * n.sum()
        return depth

    depths = [prefix(), prefix(s80=5000), prefix(s85=5000), prefix(s90=5000, s81=50), prefix(s97=5000), prefix(s99=500_000)]
    assert depths == sorted(depths) and depths[0] == forest.shortest and depths[-1] == forest.depth and len({*depths}) >= 4
    assert 1 - (1 - 0.8**forest.shortest) ** forest.trees >= forest.recall


@pytest.mark.parametrize("n", [3, 40])
def test_exact_similarity(n):
    rng = random.Random(n)
    sets = [sorted({rng.randrange(60) for _ in range(rng.randrange(1, 70))}) for _ in range(n)]
    data = [np.array(x, dtype=np.uint64) for x in sets]
    expected = [[len({*a} & {*b}) / len({*a} | {*b}) >= 0.5 for b in sets] for a in sets]
    assert jaccard.similar_sets(data, data, 0.5).tolist() == expected
    assert jaccard.similar_sets(data[: n // 2], data[n // 2 :], 0.5).tolist() == [x[n // 2 :] for x in expected[: n // 2]]


def test_packer_places_by_the_sum_of_squares():
    rng = random.Random(2)
    packer, size = packing.Packer(32), 32
    tokens, given_, got = 0, {}, {}

    def take(window):
        assert sum(len(x) for _, _, x, _ in window) <= size
        for doc, start, x, _ in window:
            for k, v in enumerate(x.tolist()):
                assert got.setdefault((doc, start + k), v) == v
        return sum(len(x) for _, _, x, _ in window)

    short = 0
    for doc in range(300):
        n = rng.randrange(1, 80)
        rest = n % size
        if rest:
            best = []
            for h in range(size - rest + 1):
                if h and not packer.counts[h]:
                    continue
                after = packer.counts.copy()
                after[h] -= h > 0
                after[h + rest] += h + rest < size
                best.append(((after[1:size] ** 2).sum(), -h))
            assert packer.place(rest) == -min(best)[1]
        x = np.array([rng.randrange(1000) for _ in range(n)], dtype=np.uint32)
        given_[doc] = x
        tokens += n
        for window in packer.add(doc, x):
            assert take(window) == size
    for window in packer.close():
        short += take(window) < size
    assert short <= 1 and len(got) == tokens
    assert all(got[d, i] == v for d, x in given_.items() for i, v in enumerate(x.tolist()))


def test_url_model():
    rng = random.Random(3)
    good = [f"http://{rng.choice('abc')}nice{i}.org/page" for i in range(300)]
    bad = [f"http://{rng.choice('abc')}spam{i}.org/pill" for i in range(300)]
    model = urlfilter.train([(u, True) for u in good] + [(u, False) for u in bad])
    assert model.score("http://xnice9999.org/page") > model.threshold > model.score("http://xspam9999.org/pill")
    one = urlfilter.CharModel(["ab", "ab", "ac"], 2)
    p = lambda s: math.exp(one.log_likelihood(s))
    assert p("ab") > p("ac") > p("zz") > 0
    total = sum(math.exp(one.log_likelihood(chr(c)) - 0) for c in range(256) if c not in (2, 3))
    assert total < 1.0001
    assert urlfilter.train([], 3).threshold == 0


def test_language_model():
    words = {"x": ["the", "house", "with", "window"], "y": ["das", "haus", "mit", "fenster"]}
    rng = random.Random(4)
    model = langid.LanguageModel({k: langid.letters_only(" ".join(rng.choice(v) for _ in range(500))) for k, v in words.items()})
    found = langid.compressors(model)
    assert langid.judge("THE WINDOW, with the house! " * 5, found, model)[0] == "x"
    assert langid.judge("Fenster mit das Haus " * 5000, found, model)[0] == "y"
    assert langid.judge("", found, model) == ("und", 0.0, True) == langid.judge("12 34 !?", found, model)
    assert langid.judge("abc", {}, model)[0] == "und"


def linked_pairs(x):
    near = x @ x.T >= 0.9
    return {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if i < j}


@pytest.mark.parametrize("rank", [3, 16])
def test_cells_of_two_levels_hold_each_close_pair_once(rank):
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(700, rank)) @ rng.normal(size=(rank, 24))
    x[350:] = x[:350] + rng.normal(size=(350, 24)) * rng.uniform(0.02, 0.4, (350, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    parents = embeddings.spherical_kmeans(x, 6)
    own = (x @ parents.T).argmax(axis=1)
    leaves = {p: embeddings.spherical_kmeans(x[own == p], 5 + p) for p in (0, 2, 3, 5) if (own == p).any()}
    for cells in (embeddings.Cells(parents, {}), embeddings.Cells(parents, leaves)):
        row, cell, home = cells.deal(x, math.sqrt(1 - 0.9**2))
        assert sorted(row[home.astype(bool)].tolist()) == [*range(700)]
        members = {}
        for r, c, h in zip(row.tolist(), cell.tolist(), home.tolist(), strict=True):
            members.setdefault(c, []).append((r, h))
        pairs = [(min(a, b), max(a, b)) for c in members.values() for i, (a, g) in enumerate(c) for b, h in c[:i] if (g or h) and x[a] @ x[b] >= 0.9]
        assert len(pairs) == len({*pairs})
        assert {*pairs} == linked_pairs(x)


def test_slices():
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "", "x", "é" * 7, "y" * rng.randrange(60)])) for i in range(300)]
    batches, at = [], 0
    while at < len(rows):
        to = at + rng.randrange(0, 40)
        batches.append(pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows[at:to]], pa.int64()), "text": pa.array([t for _, t in rows[at:to]], pa.string())}))
        at = to
    for chars in (1, 30, 1000, 10**6):
        got = [*common.slices(batches, "text", chars)]
        assert [(r["id"], r["text"]) for b in got for r in b.to_pylist()] == rows
        sizes = [sum(len((t or "").encode()) for t in b.column("text").to_pylist()) for b in got]
        assert all(n <= chars or b.num_rows == 1 for n, b in zip(sizes, got, strict=True))
        assert all(a + b > chars for a, b in zip(sizes, sizes[1:], strict=False)) or chars == 1
    assert not [*common.slices([], "text")]


def test_hashes():
    x = common.mix64(np.arange(10_000, dtype=np.uint64))
    assert len(np.unique(x)) == 10_000
    assert common.ragged(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0" and zlib.crc32(b"") == 0
