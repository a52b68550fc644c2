"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's fingerprints are the smallest k-gram hashes of its sliding windows.  With k words a gram and w grams a window,
two texts that share k + w - 1 words share a fingerprint, whatever stands around; here k + w - 1 is the length of the
spans asked for (ten words, or all of an item that has fewer), so no span is missed.  Fingerprints of documents and of
items are joined by hash; every span around a hit is then compared word by word with the items' spans.

Documents are cut into blocks of words that overlap by a span, so a very long text is many rows, and what is built from
a row stays small.  Only documents' fingerprints are joined (some two of seven words), first with the distinct hashes
and then, where one is hit, with the distinct spans: a span that a third of all documents or items hold costs one row
per place.  Documents with the same set of spans are one class; a class meets its items once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

SPAN = 10
BLOCK = 4_096  # words a block starts spans at
# Everything of ASCII but digits and letters; what lies above ASCII belongs to words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str) -> Column:
    """Expression: the words of a text in lower case, one space between them; empty without words."""
    t = F.coalesce(F.col(text), F.lit(""))
    # lower() would also change letters beyond ASCII; where there are none it is the faster way to the same text.
    small = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.trim(F.regexp_replace(small, _BETWEEN, " "))


def words_of(norm: str) -> Column:
    return F.when(F.col(norm) == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def gram(n: int) -> int:
    """Words of a k-gram for spans of ``n`` words; the window then holds n - k + 1 grams."""
    return (n + 1) // 2


def grams(words: str, k: int) -> Column:
    """Expression: hash of every run of ``k`` entries of ``words`` (hashes of words)."""
    w = F.col(words)
    each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<bigint>"))


def _runs(m: str) -> Column:
    """Expression: (first, last, h) of every run of windows whose smallest hash is the same; ``m``: the smallest hashes."""
    least = F.col(m)
    starts = F.filter(F.sequence(F.lit(0), F.size(least) - 1), lambda i: (i == 0) | (F.get(least, i) != F.get(least, i - 1)))
    # A lambda over one element binds the starts, so that they are found once.
    runs = F.transform(F.array(starts), lambda c: F.transform(c, lambda s, i: F.struct(
        s.alias("first"), F.coalesce(F.get(c, i + 1), F.size(least)).cast("int").alias("to"), F.get(least, s).alias("h"),
    )))
    return F.when(F.size(least) > 0, F.get(runs, F.lit(0))).otherwise(F.array().cast("array<struct<first:int,to:int,h:bigint>>"))


def fingerprints(blocks: DataFrame, n: int) -> DataFrame:
    """row, block, n, h, and the windows (from ``first``, before ``to``, counted in the block) of which h is the smallest hash.

    ``blocks`` have a column ``norm``.  A gram that is the smallest of several windows in a row gives one fingerprint.
    """
    k = gram(n)
    w = n - k + 1
    hashed = blocks.select("row", "block", F.transform(words_of("norm"), lambda x: F.xxhash64(x)).alias("w"))
    hashed = hashed.select("row", "block", grams("w", k).alias("g"))
    smallest = (lambda i: F.least(*[F.get("g", i + j) for j in range(w)])) if w > 1 else (lambda i: F.get("g", i))
    least = F.transform(F.sequence(F.lit(0), F.size("g") - w), smallest)
    least = F.when(F.size("g") >= w, least).otherwise(F.array().cast("array<bigint>"))
    return hashed.select("row", "block", least.alias("m")).select("row", "block", F.lit(n).alias("n"), F.inline(_runs("m")))


def in_blocks(norms: DataFrame, keep: list[str], span: int) -> DataFrame:
    """``keep``, n_words, block, norm: texts in blocks of BLOCK words, each with the span - 1 words that follow."""
    cut = norms.select(*keep, words_of("norm").alias("words"))
    every = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(BLOCK))
    cut = cut.select(*keep, F.size("words").cast("long").alias("n_words"), F.explode(F.transform(every, lambda b: F.struct(
        (b / BLOCK).cast("int").alias("block"), F.array_join(F.slice("words", b + 1, BLOCK + span - 1), " ").alias("norm"),
    ))).alias("b"))
    return cut.select(*keep, "n_words", "b.*")


def item_spans(items: DataFrame, span: int = SPAN) -> DataFrame:
    """n, span (its words), item_id: every run of ``span`` words of an item, or all of an item that has fewer.

    ``item_id`` is text, null where the item has none; rows alike are reported once.
    """
    own = items.select(F.col("item_id").cast("string").alias("item_id"), normal("text").alias("norm")).filter("norm != ''")
    own = in_blocks(own, ["item_id"], span).withColumn("words", words_of("norm"))
    n = F.least(F.col("n_words").cast("int"), F.lit(span))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("words") - (span - 1), F.lit(BLOCK))))
    # The last block of a long item may hold less than a span: its words stand in the block before.
    own = own.filter((F.size("words") >= span) | (F.col("block") == 0))
    spans = own.select(n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))).alias("span"), "item_id")
    return spans.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters and everything above ASCII, with A-Z in lower case.  A word is hit if it lies in a
    run of ``span`` words that an item holds too (of fewer, if that is the whole item).  ``n_items`` counts the items
    with such runs, ``items_sha256`` is taken of their ids as text, sorted and joined by commas (the empty text, if none).
    Null and empty texts have no words and hit nothing.  Items without words never hit; items without id mark words but
    are not counted; items that share an id count as one.  Documents that repeat an id, or have none, are judged row by
    row.  No items leave every document clean; no documents give no rows; other columns are ignored.
    """
    # Rows get their number once, where they are written; both readers below see the same.
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normal("text").alias("norm"))
    blocks = stored(in_blocks(own, ["row", "doc_id"], span), "winnow-blocks")
    of_items = stored(item_spans(items, span), "winnow-items")
    spans = stored(of_items.select("n", "span").distinct().withColumn("id", F.monotonically_increasing_id()), "winnow-spans")
    lengths = sorted(r[0] for r in spans.select("n").distinct().collect())  # span at most

    numbered = spans.select(F.col("id").alias("row"), F.lit(0).alias("block"), F.col("n").alias("own"), F.col("span").alias("norm"))
    looked = hashes = None
    for n in lengths:
        a, b = fingerprints(blocks, n), fingerprints(numbered.filter(F.col("own") == n), n).select("n", "h")
        looked, hashes = (a, b) if looked is None else (looked.unionAll(a), hashes.unionAll(b))
    clean = blocks.filter("block = 0").select("row", "doc_id", "n_words")
    none = F.sha2(F.lit(""), 256)
    if looked is None:
        return clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))

    hits = looked.join(hashes.distinct(), ["n", "h"], "left_semi")
    # A block's hits at most; the texts come back by row and block.
    hits = hits.groupBy("row", "block").agg(F.collect_list(F.struct("n", "first", "to")).alias("hits"))
    around = hits.join(blocks.select("row", "block", "norm"), ["row", "block"])
    around = around.select("row", "block", words_of("norm").alias("words"), F.flatten(F.transform("hits", _windows)).alias("s"))
    around = around.select("row", "block", "words", F.explode("s").alias("s")).select(
        "row", (F.col("block").cast("long") * BLOCK + F.col("s.at")).alias("at"), F.col("s.n").alias("n"),
        F.array_join(F.slice("words", F.col("s.at") + 1, F.col("s.n")), " ").alias("span"),
    )
    found = around.join(spans, ["n", "span"]).select("row", "at", "n", "id")
    per_doc = stored(found.groupBy("row").agg(_covered(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("to"))))).alias("n_hit"), F.array_sort(F.collect_set("id")).alias("ids")), "winnow-hits")
    per_doc = per_doc.withColumn("class", F.sha2(F.array_join("ids", ","), 256))
    members = per_doc.groupBy("class").agg(F.first("ids").alias("ids")).select("class", F.explode("ids").alias("id"))
    named = spans.join(of_items.filter("item_id is not null"), ["n", "span"]).select("id", "item_id")
    of_class = members.join(named, "id").groupBy("class").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    of_class = of_class.select("class", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    judged = per_doc.select("row", "n_hit", "class").join(of_class, "class", "left").drop("class")
    zero = F.lit(0).cast("long")
    return clean.join(judged, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def _windows(hit: Column) -> Column:
    """Expression: (n, at) of the spans that share a fingerprint."""
    return F.transform(F.sequence(hit["first"], hit["to"] - 1), lambda s: F.struct(hit["n"].alias("n"), s.alias("at")))


def _covered(spans: Column) -> Column:
    """Expression: number of words that sorted (at, to) ranges cover together."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["to"]).alias("end"), (acc["n"] + F.greatest(s["to"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("n"),
    ), lambda acc: acc["n"])


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), s AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s))
), hits AS (
  SELECT r, i, p.n AS n, item FROM places p JOIN s ON p.n = s.n AND p.g = s.g
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r
"""
