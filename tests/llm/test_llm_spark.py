"""The training-data operators and the pipeline on Spark: brute force at small scale, and every odd input."""

import base64
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewright.llm import bpe, chat, embeddings, graph, jaccard, langid, licenses, packing, pii, quality, queries, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, "x", "en", "a", 1),
        (5, "word " * 30_000, "en", "a", 150_000),
        (6, "a" * 40_000, "de", "a", 40_000),
        (7, "the same text of some words that is here two times and more", "en", "a", 5),
        (7, "the same text of some words that is here two times and more", "en", "a", 5),
        (8, "the same text of some words that is here two times and more", "en", "a", 5),
        (9, "1234 !? ...", "en", "a", 11),
        (None, "no id at all but a text of more than a few words a@b.cd", "en", "a", 5),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' AS spans", "1 AS n_words", "2 AS lang_pred", "3 AS id", "4 AS row", "5 AS digest", "6 AS kept", "7 AS ids", "8 AS words", "9 AS rep", "10 AS terms")


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def edges_hold(run, odd, result_rows):
    assert run(odd).count() == result_rows
    assert run(odd.limit(0)).count() == 0


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF, "documents").collect()}
    found = by_id(queries.op1_pii(spark, SF))
    assert len(found) == len(texts)
    for i, text in texts.items():
        spans = pii.base_spans(text)
        own = found[i]
        assert own["base_sha256"] == hashlib.sha256(pii.written(spans).encode()).hexdigest()
        assert [own[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(k == s[0] for s in spans) for k in pii.KINDS[:4]]


def pii_corpus(spark):
    rng = random.Random(1)
    plain = lambda: " ".join(rng.choice(["tree", "stone", "river", "hill", "cloud", "rain"]) for _ in range(12))
    texts = [f"{plain()} zorblat {plain()} joe@mail.example {plain()} the" for _ in range(6)]
    texts = [t.replace(" zorblat ", " ").replace("joe@mail.example", "zorblat joe@mail.example captain 4711") for t in texts]
    return docs_of(spark, texts + [f"{plain()} captain the" for _ in range(60)] + ["zorblat 4711 alone", None])


def test_revealing_terms(spark):
    docs = pii_corpus(spark)
    terms = {r["term"]: (r["action"], r["ratio"]) for r in pii.revealing_terms(docs).collect()}
    assert set(terms) == {"zorblat", "4711"}
    n, n_text, total = 6, 7, 67
    assert terms["zorblat"][1] == pytest.approx(math.log2(n / n_text * total / 6) / math.log2(total / 6))
    found = by_id(pii.find_pii(docs))
    assert found[66]["sanitised"] == "[WORD] [NUMBER] alone" and found[66]["spans"] == "term:0:7,term:8:12"
    assert found[67]["sanitised"] is None and "[EMAIL]" in found[0]["sanitised"] and "captain" in found[0]["sanitised"]
    joined = by_id(pii.find_pii(docs, rule=pii.Disclosure(broadcast_bytes=0)))
    assert joined == found


def plain_terms(texts, near=8, least=4, share=0.9):
    """The ratio of every revealing term, straight from the definition."""
    texts = {t for t in texts if t is not None}
    words_of = lambda t: {w.lower() for w in re.findall(r"\w+", t)}
    places, docs = defaultdict(set), defaultdict(set)
    for t in texts:
        spans = pii.base_spans(t)
        words = [m.span() for m in re.finditer(r"\w+", t)]
        free = [w for w in words if not any(a < w[1] and w[0] < b for _, a, b in spans)]
        for kind, a, b in spans:
            value = re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower()
            context = tuple(t[x:y].lower() for x, y in [w for w in free if w[1] <= a][-near:] + [w for w in free if w[0] >= b][:near])
            for term in {*context, ""}:
                places[kind, value, term].add(context), docs[kind, value, term].add(t)
    total, found = len(texts), {}
    own = {t: words_of(t) for t in texts}
    for (kind, value, term), where in places.items():
        n_entity = len(docs[kind, value, ""])
        if term and len(where) >= least and n_entity < total:
            n_text = sum(term in w for w in own.values())
            ratio = math.log2(min(1, len(docs[kind, value, term]) / n_text) * total / n_entity) / math.log2(total / n_entity)
            if ratio >= share:
                found[term] = max(ratio, found.get(term, 0))
    return found


def test_terms_against_the_definition(spark):
    rng = random.Random(12)
    names = [f"name{i}" for i in range(30)]
    texts = [r["text"] for r in queries.table(spark, SF, "documents").collect()]
    for i in range(150):
        k = rng.randrange(6)
        words = [rng.choice(names) for _ in range(6)] + [f"owner{k}", f"Desk{k % 3}"]
        rng.shuffle(words)
        words += [(f"p{k}@mail.example", f"10.0.0.{k}", f"+1 555 555 000{k}")[k % 3] if rng.random() < 0.9 else "none"] + [rng.choice(names) for _ in range(rng.randrange(12))]
        texts += [" ".join(words)] * rng.choice([1, 1, 3])
    expected = plain_terms(texts)
    assert len(expected) >= 3
    got = {r["term"]: (r["ratio"], r["action"]) for r in pii.revealing_terms(docs_of(spark, texts)).collect()}
    assert {k: v for k, (v, _) in got.items()} == pytest.approx(expected)
    assert all(a == ("remove" if v >= 0.98 else "generalise") for v, a in got.values())
    found = by_id(pii.find_pii(docs_of(spark, texts)))
    for i, t in enumerate(texts):
        spans = pii.base_spans(t or "")
        terms = [("term", *m.span()) for m in re.finditer(r"\w+", t or "") if m[0].lower() in expected and not any(a < m.end() and m.start() < b for _, a, b in spans)]
        assert found[i]["spans"] == pii.written(pii.in_order(spans + terms)) and found[i]["n_term"] == len(terms)


def test_copies_leave_terms(spark):
    docs = pii_corpus(spark)
    ratios = lambda d: {r["term"]: r["ratio"] for r in pii.revealing_terms(d).collect()}
    assert ratios(docs.union(docs).union(docs)) == pytest.approx(ratios(docs))
    ends = spark.range(200).select(F.col("id").cast("string").alias("end"))  # one passage in many different texts
    near = docs.where("doc_id < 6").crossJoin(ends).withColumn("text", F.concat("text", F.lit(" cloud "), "end")).drop("end")
    assert {"zorblat", "4711"} <= set(ratios(docs.union(near)))


def test_terms_with_marks_on_both_paths(spark):
    """Words as Python cuts them, in lower case one by one, however many candidates there are."""
    rng = random.Random(2)
    plain = lambda: " ".join(rng.choice(["tree", "stone", "river", "hill", "cloud", "rain"]) for _ in range(12))
    texts = [f"{plain()} \u0939\u093f\u0928\u094d\u0926\u0940 cafe\u0301 x\u00b2 \u0130zmir joe@mail.example \u00bd \u0e17\u0e35\u0e48 {plain()}" for _ in range(6)]
    docs = docs_of(spark, texts + [plain() for _ in range(60)])
    small, large = (pii.Disclosure(broadcast_bytes=b) for b in (32 << 20, 0))
    terms = {r["term"]: r["ratio"] for r in pii.revealing_terms(docs, rule=small).collect()}
    assert {"\u0939", "\u0928", "\u0926", "cafe", "x\u00b2", "\u0130zmir".lower(), "\u00bd", "\u0e17"} <= set(terms)
    assert {r["term"]: r["ratio"] for r in pii.revealing_terms(docs, rule=large).collect()} == pytest.approx(terms)
    found = by_id(pii.find_pii(docs, rule=small))
    assert found[0]["n_term"] >= 8 and by_id(pii.find_pii(docs, rule=large)) == found


def test_pii_odd(odd):
    edges_hold(pii.find_pii, odd, 11)
    found = by_id(pii.find_pii(odd))
    assert (found[1]["spans"], found[1]["sanitised"], found[2]["sanitised"], found[5]["sanitised"]) == ("", None, "", "word " * 30_000)
    assert found[None]["spans"] == "email:49:55" and found[None]["sanitised"].endswith("words [EMAIL]") and found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_bpe(spark, odd):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    edges_hold(lambda d: bpe.encode_texts(d, path, pattern), odd, 11)
    found = by_id(bpe.encode_texts(odd, path, pattern, with_ids=True))
    assert all(r["round_trip"] for r in found.values())
    empty = hashlib.sha256(b"").hexdigest()
    assert (found[1]["n_tokens"], found[1]["ids_sha256"], found[2]["decoded_sha256"]) == (0, empty, empty)
    back = by_id(bpe.decode_ids(bpe.encode_texts(odd, path, pattern, with_ids=True), path, pattern))
    assert bytes(back[6]["bytes"]) == b"a" * 40_000


def test_bpe_query(spark):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = by_id(queries.table(spark, SF, "documents"))
    for i, r in by_id(queries.op2_byte_bpe(spark, SF)).items():
        text = texts[i]["text"] or ""
        ids = np.array(library.encode_ordinary(text), dtype="<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_languages_against_a_plain_version(spark):
    import xxhash
    import zstandard

    held_out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    letters = lambda t: " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in t.lower()).split()).encode()
    docs = queries.table(spark, SF, "documents").collect()
    drawn = defaultdict(set)
    for r in docs:
        if not held_out(r["doc_id"]) and r["text"] is not None and r["lang"] is not None:
            name = str(r["doc_id"]).encode()
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            begin = signed(xxhash.xxh64(name, seed=xxhash.xxh64(b"begin", seed=42).intdigest()).intdigest()) % max(1, len(r["text"]) - 511)
            drawn[r["lang"]].add((signed(xxhash.xxh64(name, seed=42).intdigest()) % (1 << 30), r["text"][begin : begin + 512]))
    books = {g: b" ".join(x for _, t in sorted(rows)[:256] if (x := letters(t)))[-65536:] for g, rows in drawn.items()}

    def size(data, book, level, **more):
        parameters = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False, **more)
        press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
        return sum(len(press.compress(data[i : i + 16384])) for i in range(0, len(data), 16384))

    found = by_id(queries.op3_language_id(spark, SF))
    assert len(found) == len(docs)
    for r in docs:
        own, data = found[r["doc_id"]], letters(r["text"] or "")
        assert own["held_out"] == held_out(r["doc_id"])
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (own["lang_pred"], own["score"], own["rejected"]) == ("und", 0, True)
            continue
        sizes = sorted((size(data, b, 5), g) for g, b in books.items())
        if 1 - sizes[0][0] / sizes[1][0] < 0.005:
            sizes = sorted((n + size(data, books[g], 13, min_match=3), g) for n, g in sizes)
        margin = 1 - sizes[0][0] / sizes[1][0]
        assert (own["lang_pred"], own["rejected"]) == (sizes[0][1], margin < 0.005) and own["score"] == pytest.approx(margin)


def test_language_id(spark, odd):
    found = by_id(queries.op3_language_id(spark, "/root/testdata/sf0.01"))
    truth = by_id(queries.table(spark, "/root/testdata/sf0.01", "documents"))
    held = [i for i in found if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in found.items() if r["held_out"]} == {*held}
    long = [i for i in held if len(truth[i]["text"]) > 100]
    assert sum(found[i]["lang_pred"] == truth[i]["lang"] for i in long) / len(long) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())
    model = langid.fit_languages(odd)
    edges_hold(lambda d: langid.identify_languages(d, model), odd, 11)
    found = by_id(langid.identify_languages(odd, model))
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 9)] == ["und"] * 4
    assert langid.fit_languages(odd.limit(0)).dictionaries == {}


def test_many_languages(spark):
    """Seventy languages of letters of their own: none is left out."""
    letters = [chr(0x4E00 + i) for i in range(70 * 8)]
    rng = random.Random(3)
    say = lambda k: " ".join("".join(rng.choice(letters[8 * k : 8 * k + 8]) for _ in range(4)) for _ in range(60))
    docs = spark.createDataFrame([(100 * k + i, say(k), f"l{k:02}", "s", 300) for k in range(70) for i in range(21)], DOCS)
    model = langid.fit_languages(docs)
    assert len(model.dictionaries) == 70
    rare = docs.where("lang >= 'l60'")
    assert all(r["lang_pred"] == r["lang"] for r in langid.identify_languages(rare, model).join(rare, "doc_id").collect())
    assert quality.language_references(docs).count() == 70


def test_url_query(spark):
    found = by_id(queries.op4_url_filter(spark, SF), "page_id")
    pages = by_id(queries.table(spark, SF, "pages"), "page_id")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for i, page in pages.items():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", page["url"])
        host, path = m[1].lower(), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        own = found[i]
        assert (own["host"], own["path"]) == (host, path)
        assert (own["rule"], own["verdict"] if fits else None) == ((max(fits)[1], max(fits)[2]) if fits else (None, None))
    again = by_id(queries.op4_url_filter(spark, SF), "page_id")
    assert again == found


def plain_likelihood(urls, order=5):
    """The smoothed model as a recursion over contexts, counted anew for each question."""
    texts = [f"\x02{u}\x03" for u in urls]
    follows = defaultdict(Counter)
    for t in texts:
        for i in range(1, len(t)):
            for k in range(min(order, i) + 1):
                follows[t[i - k : i]][t[i]] += 1

    def p(x, context):
        shorter = p(x, context[1:]) if context else 1 / 256
        c = follows.get(context)
        return (c[x] + len(c) * shorter) / (sum(c.values()) + len(c)) if c else shorter

    return lambda url: sum(math.log(p(t[i], t[max(0, i - order) : i])) for t in [f"\x02{url}\x03"] for i in range(1, len(t)))


def test_verdicts_against_a_plain_version(spark):
    found = by_id(queries.op4_url_filter(spark, SF), "page_id")
    pages = {r["page_id"]: r["url"] for r in queries.table(spark, SF, "pages").collect()}
    allow = {r.text: r.allow for r in queries.RULES}
    labelled = {pages[i]: allow[r["rule"]] for i, r in found.items() if r["rule"]}
    learn = {u: ok for u, ok in labelled.items() if zlib.crc32(u.encode()) % 5}
    good, bad = (plain_likelihood([u for u, ok in learn.items() if ok is x]) for x in (True, False))
    score = {u: (good(u) - bad(u)) / (len(u) + 1) for u in pages.values()}
    tried = sorted((score[u], ok) for u, ok in labelled.items() if u not in learn)
    cuts = [tried[0][0] - 1e-6, *((a[0] + b[0]) / 2 for a, b in zip(tried, tried[1:], strict=False)), tried[-1][0] + 1e-6] if {ok for _, ok in tried} == {True, False} else [0.0]
    rate = lambda cut, kind: sum((s >= cut) is kind for s, ok in tried if ok is kind) / max(1, sum(ok is kind for _, ok in tried))
    cut = max(cuts, key=lambda c: (round(rate(c, True) + rate(c, False), 9), -abs(c)))
    undecided = [i for i, r in found.items() if not r["rule"]]
    assert undecided
    for i in undecided:
        assert found[i]["score"] == pytest.approx(score[pages[i]]) and found[i]["verdict"] == ("allow" if found[i]["score"] >= cut - 1e-12 else "block")


def test_url_odd(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/x?y#z"), (6, "http://a.net/es/"), (6, "http://a.net/es/"), (None, "x://b.com?q"), (8, "http://ÄB.com/" + "x" * 50_000), (9, "http://a.com\n/p")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    model = urlfilter.fit_urls(pages, queries.RULES)
    edges_hold(lambda d: urlfilter.judge_urls(d, queries.RULES, model), pages, 10)
    found = by_id(urlfilter.judge_urls(pages, queries.RULES, model), "page_id")
    assert [(found[i]["host"], found[i]["path"], found[i]["rule"]) for i in (1, 3, 4)] == [("", "", None)] * 3
    assert (found[5]["host"], found[5]["path"], found[5]["rule"], found[5]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (found[6]["rule"], found[6]["verdict"], found[None]["path"], found[8]["host"]) == ("net/es/", "block", "", "Äb.com")


def test_url_model_of_repeats(spark):
    pages = spark.range(80).selectExpr("id AS page_id", "concat('http://', sha2(string(id), 256), if(id % 2 = 0, '.com/', '.net/es/')) AS url")
    plain = urlfilter.fit_urls(pages, queries.RULES, per_class=50)
    often = urlfilter.fit_urls(pages.crossJoin(spark.range(500).select("id")), queries.RULES, per_class=50)
    assert plain.rejected.total and (often.accepted.seen, often.rejected.seen, often.threshold) == (plain.accepted.seen, plain.rejected.seen, plain.threshold)


def test_licenses(spark, odd):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(".", " ;"), mit + " and more", licenses.KNOWN["notice-MIT"].replace("License", "LICENCE"), "", None, "..."]
    found = by_id(licenses.scan_licenses(docs_of(spark, texts)))
    assert [found[i]["license_id"] for i in range(7)] == ["MIT", "MIT", None, "notice-MIT", None, None, None]
    own = spark.createDataFrame([(found[2]["digest"], "own")], "digest string, license_id string")
    assert by_id(licenses.scan_licenses(docs_of(spark, texts), own))[2]["license_id"] == "own"
    edges_hold(licenses.scan_licenses, odd, 11)
    found = by_id(licenses.scan_licenses(odd))
    assert [(found[i]["canonical_chars"], found[i]["license_id"]) for i in (1, 2, 3, 4, 6)] == [(0, None), (0, None), (0, None), (1, None), (40_000, None)]
    assert found[1]["digest"] == hashlib.sha256(b"").hexdigest() and found[7]["digest"] == found[8]["digest"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    expected = con.execute(queries.ORACLE_SQL["op5_license_scan"]).fetchall()
    assert sorted(map(tuple, queries.op5_license_scan(spark, SF).collect())) == sorted(expected)


def test_license_files(spark):
    """Licences as their files have them: wrapped, with a title, a copyright line and comment marks."""
    wrapped = lambda k, width=72: "\n\n".join(textwrap.fill(x, width) for x in licenses.KNOWN[k].split("\n\n"))
    commented = lambda t, mark: "\n".join(f"{mark} {x}" for x in t.split("\n"))
    notice = "Copyright 2020 The Authors\n\n"
    isc = wrapped("ISC").replace("that the above copyright", "that the above\ncopyright")
    apache, gpl = licenses.TEXTS["Apache-2.0"], licenses.TEXTS["GPL-3.0"]
    cases = [
        ("MIT License\n\nCopyright (c) 2020 Somebody\n\n" + wrapped("MIT"), "MIT"),
        ("The MIT License (MIT)\n" + notice + wrapped("MIT", 60), "MIT"),
        ("ISC License\n\n" + notice + isc, "ISC"),
        ("/*\n" + commented("Copyright (c) 2020, Somebody\n\n" + isc, " *") + "\n */", "ISC"),
        (commented("zlib License\n\n(C) 2020 Somebody\n" + wrapped("Zlib"), "#"), "Zlib"),
        (apache, "Apache-2.0"),
        (commented(apache, "//"), "Apache-2.0"),
        (gpl, "GPL-3.0"),
        ("BSD 3-Clause License\n\n" + notice + licenses.TEXTS["BSD-3-Clause"], "BSD-3-Clause"),
        (licenses.TEXTS["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* "), "BSD-2-Clause"),
        (licenses.TEXTS["Unlicense"], "Unlicense"),
        ("MIT License", None),
        ("MIT License\n\n" + wrapped("MIT") + "\nand more", None),
        (wrapped("ISC").replace("copyright notice and", "notice and"), None),
    ]
    found = by_id(licenses.scan_licenses(docs_of(spark, [t for t, _ in cases])))
    assert [found[i]["license_id"] for i in range(len(cases))] == [k for _, k in cases]


def pieces_hold(rows, encoded, tasks, size=2048):
    """Each id in one piece, sequences without gaps, at most one short sequence for each task."""
    cover, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(encoded[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(own) == r["length"] > 0 and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(encoded[r["doc_id"]])
        cover[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, parts in cover.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(encoded[doc])
    assert set(cover) == set(encoded)
    short = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        short += at < size
    assert short <= tasks


def test_packing(spark, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = queries.table(spark, SF, "documents")
    texts = by_id(docs)
    encoded = {i: [*e.ids, 1] for i, e in zip(texts, tokenizer.encode_batch([r["text"] or "" for r in texts.values()], add_special_tokens=False), strict=True)}
    pieces_hold(queries.op6_packing(spark, SF).collect(), encoded, docs.rdd.getNumPartitions())
    path = public_tokenizers.path("word_bpe_49k.json")
    own = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = by_id(own)
    encoded = {i: [*e.ids, 1] for i, e in zip(texts, tokenizer.encode_batch([r["text"] or "" for r in texts.values()], add_special_tokens=False), strict=True)}
    pieces_hold(packing.pack_words(own.coalesce(1), path).collect(), encoded, 1)
    assert packing.pack_words(odd, path).where("doc_id IS NULL").count() >= 1
    assert packing.pack_words(odd.limit(0), path).count() == 0


def test_workers_drop_what_others_kept(spark):
    docs = docs_of(spark, ["some words to be remembered"] * 8).coalesce(1)

    def words(batches):
        """How many words this worker's encoder remembers; -1 without one."""
        for batch in batches:
            found = bpe.KEPT and bpe.word_encoder(public_tokenizers.path("word_bpe_49k.json"))
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(found.memory) if found else -1] * batch.num_rows, pa.int64())})

    kept = lambda keeper: {r["n"] for r in bpe.arrow_map(docs, ["text"], "n long", words, keeper).collect()}
    for _ in range(3):  # whichever of the idle workers takes the task
        packing.pack_words(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
        assert all(n == -1 for n in kept("another"))
    packing.pack_words(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert all(n == -1 or n >= 2 for n in kept("encoders"))  # the added tokens alone, if another worker packed


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len({*lines}), len(covered)


def plain_js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    k = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0, (k(p) + k(q)) / 2))


def plain_classes(text):
    import regex

    n = [len(regex.findall(f"[{x}]", text)) for x in (" \n\t", *quality.CLASSES)]
    return [*n, len(text) - sum(n)]


def test_quality(spark, odd):
    docs = by_id(queries.table(spark, SF, "documents"))
    found = by_id(queries.op7_quality(spark, SF))
    words = lambda t: [w for w in re.split(r"[^a-zà-ɏßµºª]+", t.lower()) if w]
    chars, seen, number = defaultdict(Counter), defaultdict(Counter), Counter(r["lang"] for r in docs.values())
    for r in docs.values():
        chars[r["lang"]].update(dict(enumerate(plain_classes(r["text"]))))
        seen[r["lang"]].update(words(r["text"]))
    share = lambda c: [c[i] / max(1, sum(c.values())) for i in range(6)]
    top = {g: sorted((w for w in c if len(w) <= 6), key=lambda w: (-c[w], w))[:20] for g, c in seen.items()}
    rejected = 0
    for i, r in docs.items():
        text, own, lang = r["text"], found[i], r["lang"]
        n, wc, sy, dl, rw = plain_measures(text)
        assert (own["n_words"], own["word_chars"], own["n_symbols"], own["n_dup_lines"], own["n_repeat_words"]) == (n, wc, sy, dl, rw), i
        assert own["base_failed"] == (n < 20 or 100 * rw > 30 * n)
        if number[lang] < 20 or len(text) < 200:
            assert own["class_distance"] is None
        else:
            c = plain_classes(text)
            assert own["class_distance"] == pytest.approx(plain_js([x / len(text) for x in c], share(chars[lang])), abs=1e-6)
            w = words(text)
            if len(w) >= 50:
                hits, total = Counter(w), sum(seen[lang].values())
                p, q = [hits[x] / len(w) for x in top[lang]], [seen[lang][x] / total for x in top[lang]]
                assert own["word_distance"] == pytest.approx(plain_js([*p, 1 - sum(p)], [*q, 1 - sum(q)]), abs=1e-6)
        far = (own["class_distance"] or 0) > 0.33 or (own["word_distance"] or 0) > 0.42
        assert own["kept"] == (not own["base_failed"] and not far)
        rejected += far
    edges_hold(quality.quality_rules, odd, 11)
    found = by_id(quality.quality_rules(odd))
    assert found[5]["n_repeat_words"] == 30_000 and found[1]["n_words"] == 0 and not found[2]["kept"]


def near_texts(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            own = base[:]
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out += [" ".join(own)] * rng.choice([1, 1, 1, 3])
    rng.shuffle(out)
    return out


def plain_join(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8} for i in sets}
    return links, components(links)


def components(links):
    out = {}
    for i in sorted(links):
        if i in out:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_join_against_all_pairs(spark, monkeypatch, block):
    real = graph.link_blocks
    monkeypatch.setattr(jaccard, "link_blocks", lambda rows, size, prepare, links: real(rows, size, prepare, links, block, block, 2))
    monkeypatch.setattr(jaccard, "NODE", block)
    texts = dict(enumerate(near_texts(block) + ["", None, "  "]))
    found = by_id(jaccard.join_similar(docs_of(spark, texts.values())))
    links, classes = plain_join(texts)
    assert {i: (r["n_links"], r["class_id"]) for i, r in found.items()} == {i: (len(links[i]), classes[i]) for i in texts}
    assert all(r["is_representative"] == (r["class_id"] == i) for i, r in found.items())


def test_join_query(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    links, classes = plain_join(texts)
    found = by_id(queries.op8_ngram_join(spark, SF))
    assert {i: (r["n_links"], r["class_id"]) for i, r in found.items()} == {i: (len(links[i]), classes[i]) for i in texts}


def test_join_odd(odd):
    found = by_id(jaccard.join_similar(odd))
    assert set(found) == set(range(1, 10))
    assert [(found[i]["class_id"], found[i]["n_links"]) for i in (1, 2, 3, 7, 8)] == [(1, 0), (2, 0), (3, 0), (7, 1), (7, 1)]
    assert jaccard.join_similar(odd.limit(0)).count() == 0


def test_prefixes_follow_the_data(spark):
    """Copies that differ little are matched on long prefixes, copies near the threshold on short ones; all links are found."""
    rng = random.Random(11)
    depths = {}
    for swaps in (1, 12):  # similarities of about 0.98 and 0.81
        docs = []
        for i in range(700):
            words = [f"v{rng.randrange(50_000)}" for _ in range(120)]
            other = words[:]
            other[:swaps] = [f"u{rng.randrange(50_000)}" for _ in range(swaps)]
            docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        reps = jaccard._signatures(df, jaccard.Forest(), "doc_id", "text").select(F.col("id").alias("rep"), "forest")
        depths[swaps] = jaccard.candidate_edges(reps, jaccard.Forest())._depth
        assert {r["n_links"] for r in jaccard.join_similar(df).collect()} == {1}
    assert depths[12] < depths[1]


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 200)] + [(300, 300), (401, 400)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    links = defaultdict(set)
    for a, b in edges:
        if a != b:
            links[a].add(b), links[b].add(a)
    found = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == components(links)


def plain_links(vectors):
    unit = {}
    for i, v in vectors.items():
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            unit[i] = x / np.linalg.norm(x)
    links = {i: set() for i in vectors}
    for i, a in unit.items():
        for j, b in unit.items():
            if i < j and len(a) == len(b) and a @ b >= 0.9:
                links[i].add(j), links[j].add(i)
    return links


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    real = graph.link_blocks
    monkeypatch.setattr(embeddings, "link_blocks", lambda rows, size, prepare, links, _: real(rows, size, prepare, links, block, block, 2))
    rng = np.random.default_rng(block)
    x = rng.normal(size=(240, 24))
    x[120:] = x[rng.integers(0, 120, 120)] + rng.normal(size=(120, 24)) * rng.uniform(0, 0.5, (120, 1))
    x[200:230] = x[3]
    rows = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
    rows |= {1000: None, 1001: [], 1002: [0.0] * 24, 1003: [float("nan")] * 24, 1004: [None] * 24, 1005: [1.0, 2.0], 1006: [2.0, 4.0], 1007: [float("inf")] * 24}
    df = spark.createDataFrame([(i, v, 1) for i, v in rows.items()], "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    links = plain_links(rows)
    classes = components(links)
    found = by_id(embeddings.link_vectors(df, cell_rows=20), "vec_id")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in found.items()} == {i: (len(links[i]), classes[i], classes[i] == i) for i in rows}
    assert embeddings.link_vectors(df.limit(0)).count() == 0


def test_vectors_of_odd_ids(spark):
    """Rows without an id are left out; of rows that repeat one the vector of least digest counts."""
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    least = min(near, far, key=lambda v: hashlib.blake2b(np.array(v, dtype=np.float32).tobytes(), digest_size=16).digest())
    rows = [(1, [1.0, 0.0, 0.0]), (2, near), (2, far), (2, None), (None, near), (3, None), (3, None)]
    found = by_id(embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "vec_id")
    linked = int(least == near)
    assert {i: (r["n_links"], r["component_id"]) for i, r in found.items()} == {1: (linked, 1), 2: (linked, 1 if linked else 2), 3: (0, 3)}


@pytest.mark.parametrize("rank", [2, 3, 4, 8, 16, 64])
def test_vectors_of_any_rank(spark, rank):
    """Variance in few directions or many, and over 64 cells on two levels: every link is found."""
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(700, rank)) @ rng.normal(size=(rank, 64))
    x[600:] = x[:100] + rng.normal(size=(100, 64)) * np.linalg.norm(x[:100], axis=1)[:, None] * rng.uniform(0.01, 0.07, (100, 1))
    rows = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
    links = plain_links(rows)
    classes = components(links)
    assert sum(map(len, links.values())) > 100
    found = by_id(embeddings.link_vectors(spark.createDataFrame([*rows.items()], "vec_id long, embedding array<float>"), cell_rows=10), "vec_id")
    assert {i: (r["n_links"], r["component_id"]) for i, r in found.items()} == {i: (len(links[i]), classes[i]) for i in rows}


def test_vector_query_recall(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in queries.table(spark, SF, "embeddings").collect()}
    links = plain_links(vectors)
    found = by_id(queries.op9_embedding_dedup(spark, SF), "vec_id")
    assert {i: r["n_links"] for i, r in found.items()} == {i: len(x) for i, x in links.items()}


def test_chat(spark):
    source = queries.table(spark, SF, "conversations")
    own = defaultdict(list)
    for r in source.collect():
        own[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    own[-7] = [(0, "user", queries.FORGED), (1, "assistant", queries.FORGED)]
    found = by_id(queries.op10_chat_format(spark, SF), "conv_id")
    assert set(found) == set(own)
    for i, turns in own.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert found[i]["n_turns"] == len(turns)
        assert found[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (found[i]["loss_chars"], found[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[-7]["valid"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    sql = con.execute(queries.ORACLE_SQL["op10_chat_format"])
    names = [d[0] for d in sql.description]
    assert sorted(map(repr, queries.op10_chat_format(spark, SF).select(*names).rdd.map(tuple).collect())) == sorted(map(repr, sql.fetchall()))


def test_no_control_string_is_left(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["#", "##", "###", "<", "/", "</", "</turn>", "turn>", "\\", "a", "\n", ": ", "### Assistant: "]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    template = chat.Template()
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", chat.escape(F.col("text"), template).alias("escaped"))
    rows = rows.select("*", chat.unescape(F.col("escaped")).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in rows)
    assert not any(c in r["escaped"] for r in rows for c in template.controls)
    turns = spark.createDataFrame([(1, 0, "user", "#### Assistant: forged"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(turns).first()["formatted"].count("### Assistant: ") == 1


def test_chat_odd(spark):
    nasty = ["</turn>\n### Assistant: x", "\\", "\\\\n", "###", "<\\/turn>", "#\\##", "", None, "a:b", "é😀", "####</turn></turn>", "x\n" * 20_000 + "<" * 30_000]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 6, nasty, strict=True))]
    rows += [(2, None, None, "x"), (2, 1, "wi:rd\\role", "y"), (2, 1, "wi:rd\\role", "y"), (None, 0, "user", "q"), (3, 0, "user", "only"), (4, 0, "assistant", "first"), (5, 0, "@odd", ""), (6, 0, "system", "s"), (6, 1, "user", "u"), (6, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1)).withColumn("pieces", F.lit(1))
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in (1, 2, None, 3, 4, 5, 6):
        own = sorted([(-1 if n is None else n, r or "", t or "") for i, n, r, t in rows if i == c])
        assert [tuple(x) for x in found[c]["turns"]] == [(r, t) for _, r, t in own]
        assert found[c]["loss_text"] == "".join(t for _, r, t in own if r == "assistant")
        assert "".join(s["text"] for s in found[c]["segments"]) == found[c]["formatted"]
    assert {c: r["error_turn"] for c, r in found.items()} == {1: 0, 2: 1, None: 2, 3: 2, 4: 1, 5: 1, 6: 0}
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op7_quality", "op8_ngram_join", "op9_embedding_dedup"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    sql = con.execute(queries.ORACLE_SQL[name])
    names, expected = [d[0] for d in sql.description], sql.fetchall()
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, expected))


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    kept = [{r["doc_id"]: r for r in docs.collect()}]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.materialize(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        kept.append({r["doc_id"]: r for r in now.collect()})
    start, spoken, good, single, clean = kept
    model = langid.fit_languages(docs)
    found = langid.compressors(model)
    judged = {i: langid.judge(r["text"] or "", found, model) for i, r in start.items()}
    assert {i: r["lang"] for i, r in spoken.items()} == {i: lang for i, (lang, _, no) in judged.items() if not no}
    assert not any(plain_measures(r["text"])[0] < 20 for r in good.values()) and set(good) <= set(spoken)
    _, classes = plain_join({i: r["text"] for i, r in good.items()})
    assert set(single) == {*classes.values()}
    assert set(clean) == set(single) and all(r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"]) for r in clean.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in packed} == set(clean)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard_join", "pii", "packing"]


def test_pipeline_odd(spark, odd):
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))
    spoken = ids(corpus_pipeline.language_id(spark, odd, SF))
    assert not {1, 2, 3, 9} & {*spoken} and spoken.count(7) in (0, 2) and 5 in spoken
    assert ids(corpus_pipeline.quality_rules(spark, odd, SF)) == []  # too few words, or the same ones again and again
    single = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert single.columns == odd.columns and ids(single) == [1, 2, 3, 4, 5, 6, 7, 9, None]
    clean = corpus_pipeline.personal_data(spark, odd, SF)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in clean.collect()}
    assert clean.columns == odd.columns and clean.count() == 11
    assert texts[1] == (None, None) and texts[2] == ("", 0) and texts[None][0].endswith("words [EMAIL]") and texts[None][1] == len(texts[None][0])
    packed = corpus_pipeline.pack(spark, odd, SF).collect()
    assert sum(r["doc_id"] == 7 and r["start"] == 0 for r in packed) == 2 and [r["doc_tokens"] for r in packed if r["doc_id"] == 1] == [1]
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_one_row_of_a_repeated_id_stays(spark):
    """Of rows with one id the join judges one text, and that very row stays, however the rows are partitioned."""
    same, other = "one two three four five six seven eight nine ten", "quite another text of a few words that nobody else has"
    rows = [(1, same, "en", "s", 1), (2, same, "en", "s", 1), (2, other, "en", "s", 1), (2, other, "en", "r", 1), (2, other, "en", "s", 1)]
    chosen = spark.createDataFrame([(same,), (other,)], "text string").orderBy(F.xxhash64("text")).first()["text"]
    expected = {(1, same, "s")} | ({(2, other, "r")} if chosen == other else set())
    for parts in (1, 3):
        kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(parts), SF)
        assert {(r["doc_id"], r["text"], r["source"]) for r in kept.collect()} == expected and kept.count() == len(expected)
