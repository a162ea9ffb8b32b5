"""Periodic runs next to a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np

from firstprint.llm import periodic


def brute_runs(words, shortest=6):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            if words[s] != words[s + q]:
                s += 1
                continue
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - s
            if length >= max(shortest, 4 * q) and not any(all(words[i] == words[i + d] for i in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            s = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_sequences(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        kind, own = rng.randint(0, 4), []
        while len(own) < rng.choice((5, 30, 120, 400)):
            if kind == 0:
                own.append(rng.choice("ab"))
            elif kind == 1:  # powers of powers, cut anywhere
                part = [rng.choice("abc") for _ in range(rng.randint(1, 9))] * rng.randint(1, 6)
                own += (part + [rng.choice("abx")]) * rng.randint(1, 6)
            elif kind == 2:
                part = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
                own += (part * rng.randint(2, 6))[: rng.randint(1, 200)]
            elif kind == 3:
                own += ["a"] * rng.randint(1, 40) + [rng.choice("bc")]
            else:
                a, b = ["a"], ["a", "b"]  # Fibonacci words have many overlapping runs
                for _ in range(rng.randint(1, 9)):
                    a, b = b, b + a
                own += b * rng.randint(1, 4)
        yield own


def test_runs_equal_brute_force():
    batch = [[w.encode() for w in own] for own in odd_sequences(250, 1)] + [[], [b"a"], [b"a"] * 6, [b"a"] * 5]
    got = periodic.runs_in(batch, 6)  # all laid end to end
    for own, found in zip(batch, got, strict=True):
        assert found == brute_runs(own), own


def test_every_period_of_long_powers():
    for q in range(1, 70):
        own = [b"%d" % (i * i % 97 if i else 1000 + q) for i in range(q)]
        seq = ([b"x"] + own * 4 + own[: q // 2] + [b"y"] * 3)
        assert (1, 4 * q + q // 2, q) in periodic.runs_in([seq], 6)[0] or 4 * q + q // 2 < 6
        assert periodic.runs_in([seq], 6)[0] == brute_runs(seq)


def test_set_is_consistent_and_dense():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, 4000).astype(np.uint64)
    x[1000:1400] = x[:400]
    prints, scale = periodic.mixed(x), 1
    while scale < 16:
        prints, scale = periodic.mixed(prints[:-scale] * np.uint64(3) + prints[scale:] * np.uint64(5)), 2 * scale
    members = set(periodic.synchronising_set(prints, 16, np.zeros(len(prints), bool)).tolist())
    assert {m + 1000 for m in members if m < 400 - 32} == {m for m in members if 1000 <= m < 1400 - 32}
    assert all(any(j in members for j in range(i, i + 16)) for i in range(0, 3900, 7))


def test_operator_on_odd_tables(spark):
    texts = ["", " \t\n", "a b a b a b a b", "x " * 9, "é\x1cß " * 6 + "end", "one two three", "a " * 30_000 + "b", " ".join(f"w{i % 50}" for i in range(5000))]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "a a a a a a", None), (7, None, "k"), (3, texts[3], "k"), (3, texts[3], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.find_runs(docs).collect()
    assert len(got) == len(rows)
    for r, (doc, text, _) in zip(got, rows, strict=True):
        own = (text or "").encode().split()
        want = brute_runs(own) if len(own) < 1000 else ([(0, 30_000, 1)] if doc == 6 else [(0, 5000, 50)])
        assert r.doc_id == doc and [tuple(x) for x in r.runs] == want and r.n_words == len(own)
        keep = [w for i, w in enumerate(own) if not any(s + q <= i < s + n for s, n, q in want)]
        assert r.collapsed_text.encode() == b" ".join(keep)
    assert periodic.digests(periodic.find_runs(docs.limit(0))).collect() == []


def test_query_rows_equal_brute_force(spark):
    docs = [(i, " ".join(own) or None) for i, own in enumerate(odd_sequences(120, 5))] + [(None, "a a a a a a a"), (500, ""), (501, None)]
    got = periodic.digests(periodic.find_runs(periodic.planted(spark.createDataFrame(docs, "doc_id long, text string")))).collect()
    hit = 0
    for r, (doc, text) in zip(got, docs, strict=True):
        own = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and own:
            hit += 1
            n, g = len(own), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [w if i < a else own[a + (i - a) % p] for i, w in enumerate(own)]
        runs = brute_runs(own)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.doc_id, r.n_runs, r.start, r.length, r.period) == (doc, len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        keep = b" ".join(w for i, w in enumerate(own) if not any(s + q <= i < s + n for s, n, q in runs))
        assert r.collapsed_sha256 == hashlib.sha256(keep).hexdigest()
    assert hit > 5
