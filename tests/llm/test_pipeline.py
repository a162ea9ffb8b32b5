"""The pipeline on the smallest tables, each stage against brute force on what the one before kept."""

import hashlib
from itertools import combinations

import public_tokenizers
import tiktoken

import corpus_pipeline
from firstprint.llm import byte_bpe, quality
from firstprint.llm.common import table
from tests.llm.test_pairs import Sets, brute_hits, brute_near, distance


def kept_lines(rows, edits=2, shortest=40):
    """By doc_id: texts without the lines that (over others) are within ``edits`` of an earlier one."""
    lines = {}
    for _, text in rows:
        for line in text.split("\n"):
            if line.strip():
                lines.setdefault(line, len(lines))
    own = Sets(range(len(lines)))
    by_part = {}
    for line in lines:
        if len(line) >= shortest:  # lines within 2 edits share one of their thirds up to a shift of 2: look at all 10-grams
            for k in range(len(line) - 9):
                by_part.setdefault(line[k : k + 10], set()).add(line)
    pairs = {p for group in by_part.values() for p in combinations(sorted(group), 2) if abs(len(p[0]) - len(p[1])) <= edits}
    for a, b in pairs:
        if distance(a, b) <= edits:
            own.join(lines[a], lines[b])
    out, seen = {}, set()
    for i, text in rows:
        keep = []
        for line in text.split("\n"):
            if line.strip():
                c = own.find(lines[line])
                if c in seen:
                    continue
                seen.add(c)
            keep.append(line)
        out[i] = "\n".join(keep)
    return out


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got, stages = [docs], dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    for stage in stages.values():
        got.append(corpus_pipeline.materialise(stage(spark, got[-1], sf), "test"))
    assert all(df.columns == docs.columns for df in got[:-1])
    text = [{r.doc_id: r.text for r in df.select("doc_id", "text").collect()} for df in got[:-1]]

    scores, _ = quality.resample(docs, table(spark, sf, "labels"))
    assert set(text[1]) == {r.doc_id for r in scores.collect() if r.selected} and len(text[1]) > 0.6 * len(text[0])
    assert text[2] == kept_lines(sorted(text[1].items()))
    near = brute_near(sorted(text[2].items()), 5, 80)
    assert set(text[3]) == {i for i, (n, comp) in near.items() if n == 0 or comp == i}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    hits = brute_hits(sorted(text[3].items()), items, 13)
    assert set(text[4]) == {i for i, h in hits.items() if not h[3]}
    ranks = byte_bpe.load_ranks(spark, corpus_pipeline.RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r.doc_id: r for r in got[-1].collect()}
    assert set(last) == set(text[4])
    for i, t in text[4].items():
        ids = own.encode_ordinary(t)
        assert last[i].ids == ids and last[i].n_tokens == len(ids) and last[i].intact
        assert last[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert last[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
