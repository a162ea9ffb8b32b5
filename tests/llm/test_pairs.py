"""Operators that compare texts with one another, against brute force on small fixtures."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from firstprint.llm import ann, chat, common, decontamination
from firstprint.llm.line_dedup import dedup_lines, probes, within
from firstprint.llm.near_dedup import near_duplicates
from firstprint.llm.substring_dedup import remove_repeats


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, a):
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def prose(rng, n, words=300):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def near_fixture():
    rng = random.Random(8)
    rows, base = [], prose(rng, 150, 5000)
    for i in range(90):  # a chain of edits: neighbours are linked, ends are not
        own = list(base)
        for _ in range(i % 30):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000 + i, " ".join(prose(rng, rng.randint(1, 60)))) for i in range(60)]
    rows += [(3000 + i, "Same  TEXT here\tagain and again") for i in range(25)] + [(2999, "same text here again and again")]
    return rows + [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "É é"), (8, "é É"), (9, "a b c " * 5000), (10, "a b c " * 5001)]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_near(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    own = Sets(sets)
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            own.join(a, b)
    return {i: (len(sets[i]), own.find(i)) for i in sets}


def test_near_duplicates(spark):
    rows = near_fixture()
    extra = rows + [rows[0], rows[0], (None, rows[0][1])]
    docs = frame(spark, [(a, b, "x", 1) for a, b in extra], "doc_id long, text string, key string, comp int")
    for width, percent in ((3, 85), (5, 80)):
        got, want = near_duplicates(docs, shingle_words=width, percent=percent).collect(), brute_near(rows, width, percent)
        assert len(got) == len(rows) + 2
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(frame(spark, [])).collect() == []


def test_bucket_rounds_are_exact_with_few_leaders(spark, monkeypatch):
    """Forty ids in one bucket, links by a rule that no leader alone sees."""
    live = common.materialise(frame(spark, [(k, i, 1) for i in range(40) for k in (7, 8 + i % 3)], "key long, id long, n long"))
    def confirm(pairs):
        return pairs.where((F.col("b") - F.col("a") == 5) | ((F.col("a") % 7 == 0) & (F.col("b") % 7 == 0)))
    own = Sets(range(40))
    for a, b in combinations(range(40), 2):
        if b - a == 5 or a % 7 == b % 7 == 0:
            own.join(a, b)
    for meetings, leaders in ((0, 1), (1, 3), (3, 32)):
        monkeypatch.setattr(common, "LEADERS", leaders)
        monkeypatch.setattr(common, "MEETINGS", meetings)
        got = {r.id: r.comp for r in common.bucket_components(live, lambda x, y: x == y, confirm).collect()}
        assert {i: got.get(i, i) for i in range(40)} == {i: own.find(i) for i in range(40)}


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.id: r.comp for r in common.components(frame(spark, edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, **{i: 200 for i in (200, 201, 202)}}
    assert common.components(frame(spark, [], "u long, v long")).collect() == []


def test_small_tasks_change_nothing(spark, monkeypatch):
    edges = frame(spark, [(i, i + 7) for i in range(100)], "u long, v long")
    want = sorted(common.components(edges).collect())
    monkeypatch.setattr(common, "TASK_ROWS", 10)
    assert sorted(common.components(edges).collect()) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, n):
    own = list(line)
    for _ in range(n):
        k, r = rng.randrange(len(own) + 1), rng.random()
        if r < 0.4:
            own.insert(k, rng.choice("abé"))
        elif k < len(own):
            if r < 0.7:
                own.pop(k)
            else:
                own[k] = rng.choice("abé")
    return "".join(own)


def test_banded_distance_and_probes():
    rng = random.Random(3)
    for edits in (0, 1, 2, 3):
        left = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) for _ in range(600)]
        right = [edited(rng, x, rng.randint(0, 4)) for x in left]
        want = [distance(a, b) <= edits for a, b in zip(left, right)]
        assert within(left, right, edits).tolist() == want
        for a, b, near in zip(left, right, want):
            if near and min(len(a), len(b)) > edits:
                keys = [{(s, i, x[at : at + w]) for s, i, at, w in probes(len(x), edits)} for x in (a, b)]
                assert keys[0] & keys[1]


def test_line_dedup(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(40, 70))) for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(bases), rng.randint(0, 3)) if rng.random() < 0.6 else rng.choice(["short", "", "  ", "same line"]) for _ in range(rng.randint(1, 8))))
            for i in range(60)]
    rows += [(100, None), (101, ""), (102, "z" * 30_000), (103, "z" * 30_001 + "\nend"), (104, "short\n\nshort\n")]
    lines = {}
    for _, text in sorted(rows):
        for line in (text or "").split("\n"):
            if line.strip():
                lines.setdefault(line, len(lines))
    own = Sets(range(len(lines)))
    long = [x for x in lines if 40 <= len(x) < 1000]
    for a, b in combinations(long, 2):
        if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
            own.join(lines[a], lines[b])
    own.join(lines["z" * 30_000], lines["z" * 30_001])
    want, seen = {}, set()
    for i, text in sorted(rows):
        keep = []
        for line in (text or "").split("\n"):
            if line.strip():
                c = own.find(lines[line])
                if c in seen:
                    continue
                seen.add(c)
            keep.append(line)
        want[i] = None if text is None else "\n".join(keep)
    docs = frame(spark, [(a, b, len(b or ""), "k") for a, b in rows + [(None, "short"), rows[0]]], "doc_id long, text string, n_chars long, id string")
    got = dedup_lines(docs).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == want
    assert [r.text for r in got if r.doc_id is None] == ["short"]
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)
    assert dedup_lines(frame(spark, [])).collect() == []


def brute_repeats(rows, window):
    first, out = {}, {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first.setdefault(tuple(words[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def test_remove_repeats(spark):
    rng = random.Random(2)
    passages = [" ".join(prose(rng, n)) for n in (50, 51, 80, 200)]
    rows = []
    for i in range(80):
        own = [" ".join(prose(rng, rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            own += [rng.choice(passages), " ".join(prose(rng, rng.randint(0, 5)))]
        rows.append((i, " ".join(own)))
    rows += [(200, None), (201, ""), (202, "again " * 5000), (203, "again " * 49), (204, "again\n" * 50), (205, rows[3][1]), (206, "é x " * 60)]
    docs = frame(spark, [(a, b, 1) for a, b in rows + [rows[5], rows[5], (None, passages[3])]], "doc_id long, text string, start int")
    for window in (50, 8):
        got = remove_repeats(docs, window=window).collect()
        assert len(got) == len(rows) + 3
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got if r.doc_id is not None} == brute_repeats(rows, window)
    assert remove_repeats(frame(spark, [])).collect() == []


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")


def brute_hits(docs, items, window):
    wins = defaultdict(set)
    for i, text in items:
        w = [x for x in words_of(text) if x]
        if w and i is not None:
            for k in range(max(1, len(w) - window + 1)):
                wins[tuple(w[k : k + window])].add(str(i))
    sizes = {len(x) for x in wins}
    out = {}
    for i, text in docs:
        w = [x for x in words_of(text) if x]
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    found |= own
                    hit |= set(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, " ".join(prose(rng, rng.randint(13, 40), 40))) for i in range(12)]
    items += [(20, "Émile. Zola"), (21, "solo"), (22, ""), (23, None), (24, items[0][1]), (None, "w1 w2 w3"), (25, "a b a b a b a b a b a b a b a")]
    docs = []
    for i in range(60):
        own = prose(rng, rng.randint(0, 200), 40)
        if i % 3 == 0:
            w = items[i % 12][1].split()
            at = rng.randrange(max(1, len(w) - 13))
            own[len(own) // 2 : len(own) // 2] = w[at : at + rng.randint(12, 20)]
        docs.append((i, "! ".join(own)))
    docs += [(100, None), (101, ""), (102, "x " * 20_000 + "Émile zola"), (103, "émile-ZOLA SOLO"), (104, "a b " * 40), (105, "w1 w2 w3"), (106, items[0][1].upper())]
    table = frame(spark, [(a, b, "z", 1) for a, b in docs + [docs[0], docs[0]]], "doc_id long, text string, win string, pos int")
    bench = frame(spark, items + [items[1]], "item_id long, text string")
    want = brute_hits(docs, items, 13)
    for rows in (1_000_000, 0):  # broadcast and shuffled
        got = decontamination.contaminated(table, bench, broadcast_rows=rows).collect()
        assert len(got) == len(docs) + 2
        assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got} == want
    assert [r.n_hit for r in decontamination.contaminated(table, frame(spark, [], "item_id long, text string")).collect()] == [0] * len(got)
    assert decontamination.contaminated(frame(spark, []), bench).collect() == []


def test_chat_keeps_maximal_conversations(spark):
    talks = {1: "ab", 2: "abc", 3: "abd", 4: "abc", 5: "a", 6: "x", 7: "", 8: "abcde"}
    rows = [(c, k, "user" if k % 2 == 0 else None, t) for c, text in talks.items() for k, t in enumerate(text)]
    rows += [(9, 0, "user", None), (10, 0, "user", ""), (10, 1, None, "y"), (None, 0, "user", "a"), (11, None, "user", "a"), (2, 0, "user", "a")]
    got = chat.maximal_conversations(frame(spark, [(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")).collect()
    assert {r.conv_id: r.n_turns for r in got} == {3: 3, 6: 1, 8: 5, 10: 2}
    assert {r.conv_id: r.rendered for r in got}[6] == "<|im_start|>user\nx<|im_end|>\n"
    assert chat.maximal_conversations(frame(spark, [], "conv_id long, turn long, role string, text string")).collect() == []


def brute_nearest(rows, asks, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for q in asks:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_nearest_exact_parts(spark):
    """One partition: exact; ties, equal vectors, unusable rows."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 6) for i in range(40)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None] * 3), (2100, [float("nan")] * 6), (2200, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (2300, [1.0] * 5)]
    vectors = frame(spark, [(a, b, 0) for a, b in rows + bad + [rows[0]]], "vec_id long, embedding array<double>, part int")
    got = defaultdict(list)
    for r in sorted(ann.nearest(vectors, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows, [0, 100, 200, 1000], 10)
    assert {q: [v for v, _ in own] for q, own in got.items()} == {q: [v for v, _ in own] for q, own in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(got[q], want[q]))
    assert ann.nearest(frame(spark, [], "vec_id long, embedding array<double>"), F.lit(True)).collect() == []
    few = ann.nearest(frame(spark, rows[:3], "vec_id long, embedding array<double>"), F.lit(True))
    assert few.groupBy("query_id").count().where("count = 2").count() == 3


def test_nearest_by_learned_partitions(spark, monkeypatch):
    monkeypatch.setattr(ann, "PARTITION_ROWS", 200)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 12)) * 3
    rows = [(i, (centres[i % 10] + rng.normal(size=12)).tolist()) for i in range(2000)]
    vectors = frame(spark, rows, "vec_id long, embedding array<double>")
    probed = []
    learn = ann.learn
    monkeypatch.setattr(ann, "learn", lambda *a: probed.append(learn(*a)) or probed[-1])
    got = defaultdict(set)
    for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = brute_nearest(rows, range(0, 2000, 20), 10)
    recall = sum(len(got[q] & {v for v, _ in own}) for q, own in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9 and probed[0][1] <= 5


def test_fm_index_counts_and_wavelet_rank():
    from firstprint.llm.substring_dedup import FmIndex, WaveletTree
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 11, 500)
    tree, at, of = WaveletTree(symbols, 4), rng.integers(0, 501, 200), rng.integers(0, 11, 200)
    assert tree.rank(of, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(of, at)]
    text = np.r_[rng.integers(2, 5, 300), 0]
    index = FmIndex(text, 4)
    for _ in range(50):
        pattern = rng.integers(2, 5, rng.integers(1, 5))
        low, high = np.array([0]), np.array([len(text)])
        for s in pattern[::-1]:
            low, high = index.extend(np.array([s]), low, high)
        assert high[0] - low[0] == sum(text[i : i + len(pattern)].tolist() == pattern.tolist() for i in range(len(text) - len(pattern) + 1))




def test_nearest_rows_keeps_ties_and_far_offsets():
    def brute(a, b, k):
        far = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        at = np.argsort(far, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(far, at, axis=1)

    rng = np.random.default_rng(0)
    hot, bits, far = np.eye(200), rng.integers(0, 2, (300, 8)).astype(float), rng.normal(size=(2000, 16)) + 1e8
    for x in (hot, bits, far, rng.normal(size=(500, 16)), rng.normal(size=(50, 4)) * 1e-170, rng.normal(size=(50, 4)) * 1e200, hot[:5]):
        got, want = ann.nearest_rows(x[:60], x, 11), (brute(x[:60], x, 11) if np.abs(x).max() < 1e150 else None)
        if want is not None:
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        else:
            assert got[0].shape == (50, 11)
    names = np.arange(200)[::-1]
    assert ann.nearest_rows(hot[:1], hot, 5, names)[0].tolist() == [[0, 199, 198, 197, 196]]


def test_nearest_one_hot_ties_go_to_the_smaller_id(spark):
    rows = [(i, [float(i == j) for j in range(60)]) for i in range(60)]
    got = defaultdict(list)
    for r in sorted(ann.nearest(frame(spark, rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 7 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert got == {q: [i for i in range(60) if i != q][:10] for q in range(0, 60, 7)}


def test_probes_are_set_on_vectors_the_router_has_not_seen(spark, monkeypatch):
    """Without structure a router that has seen the sample needs fewer probes on it than on new vectors."""
    x = np.random.default_rng(5).normal(size=(1200, 24))
    vectors = frame(spark, [(i, v) for i, v in enumerate(x[:800].tolist())], "vec_id long, vec array<double>")
    seen = []
    fit = ann.Router.fit.__func__
    monkeypatch.setattr(ann.Router, "fit", classmethod(lambda cls, z, soft, rng: seen.append(len(z)) or fit(cls, z, soft, rng)))
    router, probes = ann.learn(vectors, 8)
    assert seen == [600]
    odds, base = router.odds(x[800:]), router.odds(x).argmax(axis=1)
    near, _ = ann.nearest_rows(x[800:], x[800:], 11)
    top = np.argsort(-odds, axis=1)[:, :probes]
    held = [(base[800 + j] == top[i]).any() for i, row in enumerate(near) for j in row if j != i]
    assert np.mean(held) >= 0.94
