"""Phrase collocations by prefix-free parsing."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firstprint.llm.common import grams, hash_filter, mixed, passes, signed
from firstprint.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: One window of words in so many ends a chunk.
TRIGGER = 24
#: The filter of frequent phrases that is sent to the tasks has 32 bits or more for each of them, and 2 ** FILTER_BITS bits (32 MB)
#: at most, whatever the size of the input. A fuller filter lets more infrequent phrases through to the shuffle; it never loses
#: a frequent one.
FILTER_BITS = 28
#: Phrase occurrences that a task sums up before it hands them to the shuffle.
SUMMED_AT_ONCE = 1 << 21

_LOWER_AND_BREAKS = bytes(0xFF if chr(i) in ".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))
_BREAK, _APART = b"\xff", b"\xfe"  # tokens of their own, in no UTF-8 text: the end of a piece, the end of a text or chunk
#: Bytes of text worked on together; a longer text is worked on alone.
BYTES_AT_ONCE = 4 << 20


class Tokens:
    """Words of many byte strings, laid end to end with an _APART token between them, as arrays."""

    def __init__(self, parts: list[bytes]):
        self.raw = b" \xfe ".join(parts)
        data = np.frombuffer(self.raw, np.uint8)
        letter = (data != 32) & (data != 9)
        edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        offsets = np.r_[0, np.cumsum(self.ends - self.starts)].astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])])
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy()
        self.distinct = coded.dictionary.to_pylist()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))
        self.hash = hashes[self.code] if len(self.code) else np.empty(0, np.uint64)
        number = {w: k for k, w in enumerate(self.distinct)}
        self.apart = self.code == number.get(_APART, -1)
        self.word = ~self.apart & (self.code != number.get(_BREAK, -1))
        #: first token of each part, and behind the last
        self.begins = np.r_[0, np.flatnonzero(self.apart) + 1]
        self.stops = np.r_[np.flatnonzero(self.apart), len(self.code)]

    def text(self, first: int, last: int) -> bytes:
        """The tokens from ``first`` to before ``last``, with whatever blanks stand between them."""
        return self.raw[self.starts[first] : self.ends[last - 1]]


def pieces_of(text: str | None) -> bytes:
    """A text in UTF-8, A-Z lower-cased, with a break token for each mark that ends a piece."""
    return (text or "").encode().translate(_LOWER_AND_BREAKS).replace(_BREAK, b" \xff ")


def parse(docs: DataFrame, overlap: int, trigger: int = TRIGGER) -> DataFrame:
    """lang, chunk, ends: the texts cut at content-triggered places, neighbouring chunks overlapping by ``overlap`` words.

    A cut is made before each window of ``overlap`` words whose hash is divisible by ``trigger``, wherever it stands, so
    equal passages are cut alike; the chunk before the cut goes on to the end of the window. ``ends`` says that a chunk ends with its text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch["lang"].to_pylist()
            for low, parts in in_slices(map(pieces_of, batch["text"].to_pylist())):
                tokens, langs, chunks, ends = Tokens(parts), [], [], []
                fits = grams(tokens.hash, overlap) % np.uint64(trigger) == 0 if len(tokens.hash) >= overlap else np.zeros(0, bool)
                for i in range(overlap):
                    fits &= ~tokens.apart[i : i + len(fits)]  # a window lies in one text
                cuts = np.flatnonzero(fits)
                spans = np.searchsorted(cuts, np.c_[tokens.begins + 1, np.maximum(tokens.begins + 1, tokens.stops)])
                for row, (first, stop, (a, b)) in enumerate(zip(tokens.begins.tolist(), tokens.stops.tolist(), spans.tolist(), strict=True)):
                    if first == stop:
                        continue
                    at = first
                    for cut in cuts[a:b].tolist():
                        chunks.append(tokens.text(at, cut + overlap))
                        at = cut
                    chunks.append(tokens.text(at, stop))
                    ends += [False] * (b - a) + [True]
                    langs += [known[low + row]] * (b - a + 1)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chunks, pa.binary()), pa.array(ends, pa.bool_())],
                                                 ["lang", "chunk", "ends"])

    return docs.mapInArrow(run, "lang string, chunk binary, ends boolean")


def in_slices(parts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, parts) of parts that together have up to BYTES_AT_ONCE bytes."""
    held, size, low = [], 0, 0
    for k, part in enumerate(parts):
        if held and size + len(part) > BYTES_AT_ONCE:
            yield low, held
            held, size, low = [], 0, k
        held.append(part)
        size += len(part)
    if held:
        yield low, held


class Chunks(Tokens):
    """Distinct chunks laid end to end by language, as arrays over their tokens."""

    def __init__(self, rows: list[tuple[str, bytes, bool, int]], overlap: int):
        rows.sort(key=lambda r: r[0])
        super().__init__([r[1] for r in rows])
        lengths = self.stops - self.begins
        row = np.cumsum(self.apart)
        self.freq = np.array([r[3] for r in rows], np.int64)[row]
        # a phrase belongs to the chunk in which it starts before the overlap: there it is whole, and counted once
        own = lengths - np.array([0 if r[2] else overlap for r in rows])
        self.own = self.word & (np.arange(len(row)) - self.begins[row] < own[row])
        #: language, first and last token of the tokens of each
        first = [k for k, r in enumerate(rows) if not k or rows[k - 1][0] != r[0]]
        at = [*self.begins[first].tolist(), len(row)]
        self.langs = [(rows[k][0], a, b) for k, a, b in zip(first, at, at[1:])]  # noqa: B905 - one more end
        for lang, a, b in self.langs:
            self.hash[a:b] ^= np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 5))

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash (with the language) of the n words from each token on, and which of these places count as a phrase."""
        last = len(self.hash) - n + 1
        if last <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        fits = self.own[:last].copy()
        for i in range(1, n):
            fits &= self.word[i : last + i]
        return (mixed(self.hash) if n == 1 else grams(self.hash, n)), fits

    def lang_at(self, places: np.ndarray) -> list[str]:
        return [self.langs[k][0] for k in (np.searchsorted([a for _, a, _ in self.langs], places, "right") - 1).tolist()]


def summed(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the sum of the weights of each (whole numbers), and a place where each stands."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.empty(0, np.int64)
    return ordered[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0], order[starts]


def partly_summed(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sums; those of weight 1, nearly all, are sorted on their own (no order to carry), so a hash may come twice."""
    once = weights == 1
    ordered = np.sort(hashes[once])
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    distinct, sums, _ = summed(hashes[~once], weights[~once])
    return np.r_[ordered[starts], distinct], np.r_[np.diff(np.r_[starts, len(ordered)]), sums].astype(np.int64)


def batches_of_chunks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[Chunks]:
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("lang", "chunk", "ends", "freq")), strict=True):
            rows.append(row)
            size += len(row[1])
            if size > BYTES_AT_ONCE:
                yield Chunks(rows, overlap)
                rows, size = [], 0
    if rows:
        yield Chunks(rows, overlap)


def word_counts(parsed: DataFrame, overlap: int) -> DataFrame:
    """lang, phrase, hash, a: all words and how often they occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches_of_chunks(batches, overlap):
            hashes, _ = own.phrases(1)
            for lang, a, b in own.langs:
                places = a + np.flatnonzero(own.own[a:b])
                sums, first = np.zeros(len(own.distinct), np.int64), np.zeros(len(own.distinct), np.int64)
                np.add.at(sums, own.code[places], own.freq[places])
                first[own.code[places]] = places
                used = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array([own.distinct[k] for k in used.tolist()], pa.binary()),
                                                  signed(hashes[first[used]]), pa.array(sums[used])], ["lang", "phrase", "hash", "a"])

    rows = parsed.mapInArrow(run, "lang string, phrase binary, hash long, a long")
    return rows.groupBy("lang", "phrase", "hash").agg(F.sum("a").alias("a"))


def hashed_counts(parsed: DataFrame, n: int, sent, overlap: int) -> DataFrame:
    """hash, a: how often phrases of n words occur (by hash), of those whose parts of n - 1 words pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            distinct, sums = partly_summed(np.concatenate(hashes), np.concatenate(weights))
            return pa.RecordBatch.from_arrays([signed(distinct), pa.array(sums, pa.int64())], ["hash", "a"])

        hashes, weights, held = [], [], 0
        for own in batches_of_chunks(batches, overlap):
            found, places = whole_parts(own, n, sent.value)
            hashes.append(found[places])
            weights.append(own.freq[places])
            held += len(places)
            if held > SUMMED_AT_ONCE:
                yield out()
                hashes, weights, held = [], [], 0
        if held:
            yield out()

    return parsed.mapInArrow(run, "hash long, a long").groupBy("hash").agg(F.sum("a").alias("a"))


def whole_parts(own: Chunks, n: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases of n words, and the places of those whose first and last n - 1 words both pass the filter."""
    hashes, fits = own.phrases(n)
    shorter, _ = own.phrases(n - 1)
    if len(hashes):
        known = passes(bits, shorter)
        fits &= known[:-1] & known[1:]
    return hashes, np.flatnonzero(fits)


def phrase_counts(parsed: DataFrame, filters: list, longest: int, overlap: int) -> DataFrame:
    """lang, phrase, a: exact counts, by the phrase itself, of what passes the filters; ``filters[n - 1]`` is that of n words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches_of_chunks(batches, overlap):
            langs, texts_, sums_ = [], [], []
            for n in range(2, longest + 1):
                hashes, places = whole_parts(own, n, filters[n - 2].value)
                if n < longest:
                    places = places[passes(filters[n - 1].value, hashes[places])]
                _, sums, first = summed(hashes[places], own.freq[places])
                codes = own.code[places[first][:, None] + np.arange(n)].tolist()
                langs += own.lang_at(places[first])
                texts_ += [b" ".join([own.distinct[c] for c in row]) for row in codes]
                sums_.append(sums)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts_, pa.binary()), pa.array(np.concatenate(sums_), pa.int64())],
                                             ["lang", "phrase", "a"])

    return parsed.mapInArrow(run, "lang string, phrase binary, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4,
           trigger: int = TRIGGER, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, phrase, a; all words, and all phrases of 2 to ``longest`` words that occur ``least`` times or more.

    The parse turns the corpus into a dictionary of distinct chunks with frequencies, so what is copied is looked at once.
    Phrases of n words are counted by hash where both their parts of n - 1 words are frequent; what is frequent by hash is then
    counted by its text. Words are told apart by 64-bit hashes inside a task's sums.
    """
    spark, overlap = docs.sparkSession, longest - 1
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    parsed = materialise(parse(own.where("text <> ''"), overlap, trigger).groupBy("lang", "chunk", "ends").agg(F.count("*").alias("freq")), "chunks")
    words = materialise(word_counts(parsed, overlap), "words")
    frequent = F.col("a") >= least
    filters = [spark.sparkContext.broadcast(hash_filter(words.where(frequent), filter_bits))]  # 2 ** filter_bits bits at most, each
    for n in range(2, longest):
        level = materialise(hashed_counts(parsed, n, filters[-1], overlap).where(frequent).select("hash"), "level")
        filters.append(spark.sparkContext.broadcast(hash_filter(level, filter_bits)))
    phrases = materialise(phrase_counts(parsed, filters, longest, overlap).where(frequent), "phrases")
    return words.select("lang", "phrase", "a"), phrases


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, first: int = 2000,
         inside_percent: int = 80, trigger: int = TRIGGER, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` collocations of each language.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and pieces into words at blanks and tabs.
    A phrase of 2 to ``longest`` words with a >= ``least`` occurrences is scored by the cut of its words into two parts, of l
    and r occurrences, that makes floor(2000000 * a / (l + r)) least (ties: the shortest first part). Phrases found inside a longer one
    with at least ``inside_percent`` of their occurrences are dropped. n: word occurrences of the language.

    Order: score, then a, both falling, then the phrase by its bytes. Null languages count as ``und``; null and empty texts
    have no words; repeated rows count each; an empty table gives no rows. Other columns play no part.
    """
    words, phrases = counts(docs, lang_col, text_col, least, longest, trigger, filter_bits)
    parts = F.split(F.col("phrase").cast("string"), " ", -1)
    phrases = phrases.withColumn("parts", parts).withColumn("size", F.size("parts"))
    text = lambda start, length: F.array_join(F.slice("parts", start, length), " ").cast("binary")
    # all parts of a frequent phrase are frequent, so their counts are at hand
    known = words.where(F.col("a") >= least).unionByName(phrases.select("lang", "phrase", "a"))
    cuts = (phrases.select("lang", "phrase", "a", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", text(F.lit(1), F.col("k")).alias("head"), text(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail")))
    scored = (cuts.join(known.toDF("lang", "head", "l"), ["lang", "head"]).join(known.toDF("lang", "tail", "r"), ["lang", "tail"])
              .withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spots = F.expr("""flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), s -> struct(s as s, w as w))))""")
    inner = (phrases.where("size > 2").select("lang", "a", "parts", F.explode(spots).alias("spot"))
             .groupBy("lang", text(F.col("spot.s"), F.col("spot.w")).alias("phrase")).agg(F.max("a").alias("longer")))
    whole = F.coalesce(F.expr(f"100 * cast(longer as decimal(19,0)) >= {inside_percent} * cast(a as decimal(19,0))"), F.lit(False))
    kept = best.join(inner, ["lang", "phrase"], "left").where(~whole)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)  # at most `first` rows a task and language move
    sizes = words.groupBy("lang").agg(F.sum("a").alias("n"))
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a",
                                          F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))


SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, words FROM (
    SELECT doc_id, lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda w: w <> '') AS words FROM (
      SELECT doc_id, lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents))
  WHERE len(words) > 0),
tokens AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
spans AS (SELECT lang, words, i, unnest(range(1, 5)) AS size FROM tokens),
f AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS a
      FROM spans WHERE i + size - 1 <= len(words) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30),
cuts AS (SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS tail
         FROM (SELECT *, unnest(range(1, size)) AS k FROM cand)),
scored AS (SELECT c.*, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head AND x.size = c.k
                       JOIN f y ON y.lang = c.lang AND y.phrase = c.tail AND y.size = c.size - c.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[s:s + v - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT *, unnest(range(1, size - v + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS v FROM cand WHERE size > 2)) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
           FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
           WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
