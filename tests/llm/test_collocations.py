"""Collocations next to a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np

from firstprint.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, first=2000, longest=4, percent=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, words), a in cand.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if 100 * a >= percent * f[lang, words[i : i + size]]:
                    dropped.add((lang, words[i : i + size]))
    out = []
    for lang in {k[0] for k in cand}:
        own = []
        for (at, words), a in cand.items():
            if at == lang and (at, words) not in dropped:
                score, _, l, r = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
                own.append((-score, -a, " ".join(words).encode(), l, r))
        own.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(own[:first])]
    return sorted(out)


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = [w for w in "a b c The the of and é ß\x1c 漢字 x-y Zz".split(" ")] + [f"w{i}" for i in range(30)]
    copies = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(5)]
    rows = []
    for _ in range(n):
        body = [rng.choice(vocabulary[: rng.choice((4, 12, 40))]) + rng.choice(["", "", "", ".", ",", "\n", "\t", " !?", "\r\n", ":"]) for _ in range(rng.randint(0, 80))]
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["", "", rng.choice(copies) + " "]) + " ".join(body)))
    return rows + [("en", None), (None, ""), ("fr", " .,\n"), ("fr", "Alone"), ("en", "q " * 4000), ("en", "The Of " * 500)]


def test_mining_equals_brute_force(spark):
    rows = made(400, 2)
    docs = spark.createDataFrame([(a, b, 1.0, i) for i, (a, b) in enumerate(rows)], "lang string, text string, score double, n int").repartition(7)
    for least, trigger, bits, first in ((5, 3, 20, 2000), (30, 24, 28, 2000), (12, 1, 8, 7), (30, 10_000, 12, 50)):
        got = collocations.mine(docs, least=least, trigger=trigger, filter_bits=bits, first=first).collect()
        assert sorted(map(tuple, got)) == brute(rows, least, first), (least, trigger, bits)
    assert collocations.mine(docs.limit(0)).collect() == []
    short = collocations.mine(docs, least=5, longest=2).collect()
    assert sorted(map(tuple, short)) == brute(rows, 5, longest=2)


def test_chunks_cover_each_start_once(spark):
    rows = made(60, 9)
    parsed = collocations.parse(spark.createDataFrame(rows, "lang string, text string").coalesce(1), 3, 4).collect()
    whole = [t for _, text in rows for t in collocations.pieces_of(text).split()]
    own = [t for r in parsed for t in (bytes(r.chunk).split() if r.ends else bytes(r.chunk).split()[:-3])]
    assert own == whole


def test_sums_are_whole_numbers():
    hashes = np.array([7, 3, 7, 3, 7], np.uint64)
    distinct, sums, first = collocations.summed(hashes, np.array([1, 1 << 60, 2, 1, 3]))
    assert distinct.tolist() == [3, 7] and sums.tolist() == [(1 << 60) + 1, 6] and hashes[first].tolist() == [3, 7]
    hashes, weights = np.array([5, 5, 9, 5, 9, 1], np.uint64), np.array([1, 1, 4, 7, 1, 1])
    distinct, sums = collocations.partly_summed(hashes, weights)
    assert sorted(zip(distinct.tolist(), sums.tolist())) == [(1, 1), (5, 2), (5, 7), (9, 1), (9, 4)]
