"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstprint.session import materialise

#: Words of a shingle; shorter windows are one shingle of all their words.
SHINGLE = 3
#: Shingles of the benchmark (a long each) that are broadcast at most; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ASCII letters and digits and all characters beyond ASCII; only A-Z are lower-cased. Null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, SEPARATORS), "")


def shingles(own: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words of an array column."""
    steps = F.sequence(F.lit(1), F.size(own) - (size - 1))
    hashed = F.transform(steps, lambda i: F.xxhash64(F.lit(size), *(F.element_at(own, i + k) for k in range(size))))
    return F.when(F.size(own) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(win, item_id) of all windows, and (win, len, size, off, key): the shingles of each distinct window."""
    own = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w"))
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1))))
    cut = own.where(F.size("w") > 0).select("item_id", "w", start.alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("w"))
    cut = cut.withColumn("win", F.sha2(F.array_join("w", " ").cast("binary"), 256))
    parts = cut.dropDuplicates(["win"]).select("win", "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"))
    key = F.coalesce(*(F.when(F.col("size") == n, shingles("w", n)) for n in range(1, SHINGLE + 1)))
    parts = parts.select("win", "len", "size", F.posexplode(key).alias("off", "key"))
    return cut.select("win", "item_id").distinct(), parts


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", window: int = 13, per: int = 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated: a row for each row of ``docs``.

    A window is ``window`` consecutive words of an item, or a whole item of fewer; a document word inside any
    occurrence of a window is hit. Contaminated: some word is hit and ``per`` * n_hit >= n_words.

    Windows are sets of shingles (runs of SHINGLE words). Shingles are ordered by how often they occur in the documents,
    counted over all of them. Containment is required in full, so the prefix of a window is its rarest shingle alone: where
    that occurs, the window's place follows from its offset (positional bound) and has to lie inside the document
    (length bound); then every other shingle of the window is looked up at its own place.

    Null text: no words. Items without words or id: no windows. Rows of ``docs`` with a null id come back unhit.
    Repeated rows of either table change nothing, and come back each; an id is taken to name one text.
    Other columns play no part.
    """
    if not 1 <= window <= 62:
        raise ValueError("windows of 1 to 62 words")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))
    of_item, parts = item_windows(items, item_id_col, item_text_col, window)
    parts = materialise(parts, "windows")
    of_item = materialise(of_item, "items")
    keys = materialise(parts.select("size", "key").distinct(), "shingles")
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())  # at most SHINGLE rows
    few = keys.count() <= broadcast_rows

    def found(size: int) -> DataFrame:
        wanted = keys.where(F.col("size") == size).select("key")
        places = (own.where("doc_id is not null").select("doc_id", F.size("w").alias("n"), F.posexplode(shingles("w", size)).alias("pos", "key")))
        return places.join(F.broadcast(wanted) if few else wanted, "key").select("doc_id", "n", "pos", "key", F.lit(size).alias("size"))

    if sizes:
        places = found(sizes[0])
        for size in sizes[1:]:
            places = places.unionByName(found(size))
    else:
        places = own.select("doc_id", F.lit(0).alias("n"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("size")).limit(0)
    places = materialise(places, "places")
    often = places.groupBy("key").agg(F.count("*").alias("often"))
    prefix = (parts.join(often, "key", "left").groupBy("win", "len", "size")
              .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "off", "key")).alias("p"))
              .select("win", "len", "size", "p.off", "p.key"))
    start = F.col("pos") - F.col("off")
    candidates = (places.join(prefix, ["key", "size"]).withColumn("start", start)
                  .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
                  .select("doc_id", "win", "start", "len", "size").distinct())
    looked_up = (candidates.join(parts.select("win", "off", "key"), "win")
                 .select("doc_id", "win", "start", "len", "size", "off", "key", (F.col("start") + F.col("off")).alias("pos"))
                 .join(places.select("doc_id", "size", "pos", "key"), ["doc_id", "size", "pos", "key"], "left_semi"))
    seen = F.bit_or(F.expr("shiftleft(1L, off)"))
    hits = (looked_up.groupBy("doc_id", "win", "start", "len", "size").agg(seen.alias("seen"))
            .where(F.col("seen") == F.expr("shiftleft(1L, len - size + 1) - 1")).select("doc_id", "win", "start", "len"))
    hits = materialise(hits, "hits")
    before = Window.partitionBy("doc_id").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    covered = (hits.select("doc_id", "start", "len").distinct().withColumn("until", F.max(end).over(before))
               .groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", F.coalesce("until", "start")))).alias("n_hit")))
    named = (hits.select("doc_id", "win").distinct().join(of_item, "win").select("doc_id", "item_id").distinct()
             .groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids")))
    out = own.select("doc_id", F.size("w").cast("long").alias("n_words")).join(covered, "doc_id", "left").join(named, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                      ((n_hit > 0) & (per * n_hit >= F.col("n_words"))).alias("contaminated"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
with d as (select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id::varchar item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where item_id is not null),
bw as (select distinct item_id, least(len(w), 13) n, array_to_string(w[s:s + 12], ' ') t
       from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') t
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d, sizes where len(w) >= n)),
hit as (select doc_id, s, dw.n, item_id from dw join bw using (n, t)),
cov as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from hit) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from hit) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cov using (doc_id) left join its using (doc_id)
"""
