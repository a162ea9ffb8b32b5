"""Licence scan next to plain searches."""

import random
import re

from firstprint.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_places(words, phrases):
    out = []
    for phrase, label in phrases.items():
        own = phrase.split()
        out += [(label, i) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        letters = "abcd"[: rng.randint(2, 4)]
        sequences = [[rng.choice(letters).encode() for _ in range(rng.randint(2, 14))] for _ in range(rng.randint(1, 5))]
        sequences += [sequences[0], sequences[0][:3]]  # repeated, and a prefix
        automaton = licenses.SuffixAutomaton(sequences)
        text = [rng.choice(letters + "z").encode() for _ in range(60)] + sequences[0]
        got = {e: (n, sorted(automaton.ends[s])) for e, n, s in automaton.stream(automaton.codes(text))}
        for end in range(1, len(text) + 1):
            want = 0
            for start in range(end):
                own = text[start:end]
                ends = [(k, i + len(own)) for k, s in enumerate(sequences) for i in range(len(s) - len(own) + 1) if s[i : i + len(own)] == own]
                if ends:
                    want = end - start
                    break
            if want > 1:
                assert got[end] == (want, sorted(ends))
            else:
                assert end not in got


def test_phrases_that_overlap_and_nest():
    phrases = {"a b": "x", "b a": "y", "a b a": "z", "b a b a": "w"}
    scanner, rng = licenses.Scanner([("t", "q r s t")], phrases), random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choice("abqrst") for _ in range(50))
        places, _ = scanner.scan(licenses.words_of(text))
        assert sorted(places, key=lambda x: (x[1], x[0])) == brute_places(text.split(), phrases)


def test_chains():
    assert licenses.chained([(10, 0, 5), (16, 6, 4), (60, 0, 5)], 20) == [(10, 20, 9), (60, 65, 5)]
    assert licenses.chained([(10, 0, 5), (13, 3, 6)], 20) == [(10, 19, 9)]  # shared words count once
    assert licenses.chained([(10, 6, 4), (16, 0, 5)], 20) == [(10, 14, 4), (16, 21, 5)]  # never backwards in the template
    assert licenses.chained([(0, 0, 4), (10, 6, 4), (20, 0, 4), (30, 6, 4)], 20) == [(0, 14, 8), (20, 34, 8)]
    assert licenses.chained([], 20) == []


def test_scan_on_odd_tables(spark):
    mit, gpl = licenses.TEMPLATES[0][1], licenses.TEMPLATES[4][1]
    changed = mit.replace("sublicense", "relicense").replace("permit persons", "let people")
    texts = ["", "  ...  ", "MIT-License! mit  license MIT (License)", "The É MIT License; Apache\nLICENSE", "general public general public license",
             "x " * 30_000 + changed + " y" * 500, mit + " " + gpl, "permission is hereby refused", "mit licenses", "Released under the MIT License.", "mit license " * 3000]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "mit license", "k"), (90, None, None), (3, texts[3], "k"), (3, texts[3], "k")]
    got = licenses.digests(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string"))).collect()
    assert len(got) == len(rows)
    for r, (doc, text, _) in zip(got, rows, strict=True):
        words = brute_words(text)
        places = brute_places(words, licenses.PHRASES)
        starts = [s for _, s in places]
        assert (r.doc_id, r.n_words, r.n_base) == (doc, len(words), len(places))
        assert (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[5].labels == "mit" and by[5].base_labels == "" and 0.9 < by[5].score < 1 and by[5].spans.startswith("mit:30000:")
    assert by[6].labels == "gpl,mit" and by[7].labels == "" and by[0].score == 0 and by[9].labels == "mit"
    assert licenses.digests(licenses.scan(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_base_columns_on_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in licenses.digests(licenses.scan(docs)).collect():
        places = brute_places(brute_words(text[r.doc_id]), licenses.PHRASES)
        assert r.n_base == len(places) and r.base_labels == ",".join(sorted({x for x, _ in places}))
