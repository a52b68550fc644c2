"""Row documents and batch retrieval: a query table against a document table.

Retrieval is exact and never makes a row per pair of query and document.  Documents lie in blocks; of each block the
largest weight of every term is known, so what a query can reach in a block is bounded by a sum over the query's terms
(one row per term and block, however many documents of the block hold it).  Each query first scores the block with the
highest bound; its k-th score there rules out all blocks with a lower bound, and the others are scored.  Scoring takes a
block of documents and a batch of queries as sparse arrays and gives back at most k rows per query and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import Keys
from ..session import kept

BLOCK_DOCS, BATCH_QUERIES = 1024, 128
_STEP = 1 << 19  # words counted at once
# Scores are compared to this many digits; ties go to the smaller document key.
_DIGITS, _SLACK = 9, 1e-8


# ---------------------------------------------------------------- documents
def row_documents(df: DataFrame, row_id: str, cols: list[str] | None = None, id_name: str = "row_id") -> DataFrame:
    """``row_id=.. | col=val | ..`` for every row; NULL cells are skipped."""
    cols = cols or [c for c in df.columns if c != row_id]
    cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in cols]
    text = F.concat_ws(" | ", F.concat(F.lit(id_name + "="), F.col(row_id).cast("string")), *cells)
    return df.select(F.col(row_id).alias("doc_id"), text.alias("text"))


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def brief_documents(ranked: DataFrame, predictions: DataFrame, inspect: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Ranking, prediction and inspection rows as text."""
    a = ranked.select(
        F.concat(
            F.lit("ASSET_RANK rank="), _shown("rank"), F.lit(" machine_id="), _shown(keys.id),
            F.lit(" risk_level="), _shown("risk_level"), F.lit(" predicted_rul_days="), _shown("predicted_rul_days"),
            F.lit(" mean_anomaly_score="), _shown("mean_anomaly_score"), F.lit(" anomaly_count="),
            _shown("anomaly_count"), F.lit(" why="), F.array_join("why", "; "),
        ).alias("text")
    )
    b = predictions.select(
        F.concat(
            F.lit("RUL_PRED machine_id="), _shown(keys.id), F.lit(" predicted_rul_days="), _shown("predicted_rul_days"),
            F.lit(" risk_level="), _shown("risk_level"), F.lit(" is_proxy="), _shown("is_proxy"),
            F.lit(" label_source="), _shown("label_source"), F.lit(" message="), _shown("message"),
        ).alias("text")
    )
    c = inspect.select(F.concat(F.lit("INSPECT machine_id="), _shown(keys.id), F.lit(" "), _shown("message")).alias("text"))
    return a.unionByName(b).unionByName(c)


# ---------------------------------------------------------------- tf-idf
def words(text: Column) -> Column:
    """Words of two or more letters or digits, lower-cased; empty for NULL."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), F.array().cast("array<string>"))


def _steps(lists: pa.ListArray) -> list[tuple[int, int]]:
    """Rows (from, to) of at most ``_STEP`` words together; a longer text stands alone."""
    ends, out, start = np.cumsum(np.diff(lists.offsets.to_numpy())), [], 0
    while start < len(lists):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _STEP, side="right"))
        out.append((start, max(stop, start + 1)))
        start = out[-1][1]
    return out


def _grams(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of every word and every neighbouring pair, and the words that the codes stand for.

    With n different words, word i has code i and the pair of i and j has n + n * i + j.
    """
    coded = lists.flatten().dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    beside = row[1:] == row[:-1]
    pairs = (n + n * code[:-1] + code[1:])[beside]
    return np.concatenate([row, row[1:][beside]]), np.concatenate([code, pairs]), coded.dictionary


def _spelt(code: np.ndarray, dictionary: pa.Array) -> pa.Array:
    """The terms of sorted codes."""
    n = len(dictionary)
    at = int(np.searchsorted(code, n))
    first, second = (dictionary.take(pa.array(i)) for i in np.divmod(code[at:] - n, max(n, 1)))
    return pa.concat_arrays([dictionary.take(pa.array(code[:at])), pa.compute.binary_join_element_wise(first, second, " ")])


def _vocabulary(docs: DataFrame, text: str, max_terms: int) -> DataFrame:
    """The ``max_terms`` most frequent terms with their inverse document frequency.

    Terms are counted in tasks, some hundred thousand words at a time; only term totals are exchanged.
    """
    def count(batches):
        for batch in batches:
            for a, b in _steps(batch.column("words")):
                row, code, dictionary = _grams(batch.column("words").slice(a, b - a))
                if not len(code):
                    continue
                # Sorted by term and row: each entry is one text's use of a term.
                both, uses = np.unique(code * (b - a) + row, return_counts=True)
                term = both // (b - a)
                starts = np.flatnonzero(np.diff(term, prepend=-1))
                total, df = np.add.reduceat(uses, starts), np.diff(starts, append=len(term))
                yield pa.RecordBatch.from_arrays([_spelt(term[starts], dictionary), pa.array(total, pa.int64()), pa.array(df, pa.int64())], ["term", "total", "df"])

    counted = docs.select(words(F.col(text)).alias("words")).mapInArrow(count, "term string, total long, df long")
    totals = counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    top = totals.orderBy(F.col("total").desc(), "term").limit(max_terms).crossJoin(F.broadcast(n))
    return top.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _vectors(df: DataFrame, key: str, text: str, vocab: list) -> DataFrame:
    """One row per key: its terms, by their place in the vocabulary, with weights of length one together.

    Words outside the vocabulary leave before anything is exchanged; texts with equal keys are one.
    """
    idf = np.array([r["idf"] for r in vocab])
    split = [r["term"].split(" ") for r in vocab]
    single = np.array([len(s) == 1 for s in split], bool)
    firsts, seconds = [s[0] for s in split], [s[-1] for s in split]
    place = T.StructField(key, df.schema[key].dataType)

    def count(batches):
        for batch in batches:
            for a, b in _steps(batch.column("words")):
                row, code, dictionary = _grams(batch.column("words").slice(a, b - a))
                if not len(code) or not len(idf):
                    continue
                n = len(dictionary)
                x, y = (pa.compute.index_in(pa.array(w, dictionary.type), dictionary).fill_null(-1).to_numpy().astype(np.int64) for w in (firsts, seconds))
                known = np.where((x < 0) | (y < 0), -1, np.where(single, x, n + n * x + y))
                order = np.argsort(known)
                at = np.minimum(np.searchsorted(known[order], code), len(known) - 1)
                hit = known[order][at] == code
                both, uses = np.unique(row[hit] * len(known) + order[at[hit]], return_counts=True)
                rows, starts = np.unique(both // len(known), return_index=True)
                ends = pa.array(np.append(starts, len(both)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (both % len(known), uses)]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a).take(pa.array(rows)), *lists], [key, "term", "uses"])

    def weigh(batches):
        for batch in batches:
            sizes = np.diff(batch.column("term").offsets.to_numpy())
            both, back = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(idf) + batch.column("term").flatten().to_numpy(), return_inverse=True)
            row, term = np.divmod(both, max(len(idf), 1))
            w = np.bincount(back, batch.column("uses").flatten().to_numpy(), len(both)) * idf[term]
            w = w / np.sqrt(np.bincount(row, w * w, len(sizes)))[row]
            pairs = pa.StructArray.from_arrays([pa.array(term, pa.int32()), pa.array(w)], ["term", "w"])
            ends = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, pairs)], [key, "terms"])

    ints, weights = T.ArrayType(T.IntegerType()), T.StructType([T.StructField("term", T.IntegerType()), T.StructField("w", T.DoubleType())])
    counted = df.select(key, words(F.col(text)).alias("words")).mapInArrow(count, T.StructType([place, T.StructField("term", ints), T.StructField("uses", ints)]))
    whole = counted.groupBy(key).agg(*[F.flatten(F.collect_list(F.struct("term", "uses"))[c]).alias(c) for c in ("term", "uses")])
    return whole.mapInArrow(weigh, T.StructType([place, T.StructField("terms", T.ArrayType(weights))]))


def tfidf_top_k(
    docs: DataFrame, queries: DataFrame, k: int = 6, max_terms: int = 4096,
    doc_key: str = "doc_id", query_key: str = "query_id", text: str = "text",
) -> DataFrame:
    """Best ``k`` documents per query by cosine of TF-IDF weights; only positive scores.

    Weights are ``tf * (ln((1 + n) / (1 + df)) + 1)``, length-normalised.
    """
    vocab = _vocabulary(docs, text, max_terms).collect()  # at most ``max_terms`` rows, taken along by both sides
    best = top_k(_vectors(docs, doc_key, text, vocab), _vectors(queries, query_key, text, vocab), k, doc_key, query_key)
    return best.select(query_key, doc_key, "score", "rank")


# ---------------------------------------------------------------- exact top-k over blocks
def _bounds(d: DataFrame, q: DataFrame, query_key: str) -> DataFrame:
    """(query, batch, block, bound): what a query can score at most in each block that holds one of its terms."""
    peaks = d.select("block", F.explode("terms").alias("t")).groupBy("block", "t.term").agg(F.max("t.w").alias("peak"))
    asked = q.select(query_key, "batch", F.explode("terms").alias("t")).select(query_key, "batch", "t.term", "t.w")
    return asked.join(peaks, "term").groupBy(query_key, "batch", "block").agg(F.sum(F.col("w") * F.col("peak")).alias("bound"))


def _flat(terms: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each posting, its term, its weight) of a column of term lists."""
    lists = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    sizes = np.diff(lists.offsets.to_numpy())
    inner = lists.flatten()
    return np.repeat(np.arange(len(lists)), sizes), inner.field("term"), inner.field("w").to_numpy(zero_copy_only=False)


def _scorer(k: int, doc_key: str, query_key: str, schema: pa.Schema, chunk: int = 32):
    """Of one block and one batch of queries: each query's k best documents."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by(doc_key)
        q_row, q_term, q_w = _flat(right["terms"])
        coded = q_term.dictionary_encode() if not isinstance(q_term, pa.ChunkedArray) else q_term.combine_chunks().dictionary_encode()
        weights = np.zeros((len(coded.dictionary), right.num_rows))
        np.add.at(weights, (coded.indices.to_numpy(), q_row), q_w)
        d_row, d_term, d_w = _flat(left["terms"])
        code = pa.compute.index_in(d_term, coded.dictionary)
        met = code.is_valid().to_numpy(zero_copy_only=False)
        d_row, d_w, code = d_row[met], d_w[met], code.drop_null().to_numpy()
        scores = np.zeros((left.num_rows, right.num_rows))
        # A few documents at a time, so that what is multiplied stays small.
        for a in range(0, left.num_rows, chunk):
            i, j = np.searchsorted(d_row, [a, a + chunk])
            if j > i:
                starts = np.flatnonzero(np.append(True, np.diff(d_row[i:j]) > 0))
                scores[d_row[i:j][starts]] = np.add.reduceat(weights[code[i:j]] * d_w[i:j, None], starts, axis=0)
        rounded = np.round(scores, _DIGITS)
        order = np.argsort(-rounded, axis=0, kind="stable")[:k]
        doc, query = order.ravel(), np.tile(np.arange(right.num_rows), len(order))
        good = scores[doc, query] > 0
        doc, query = doc[good], query[good]
        return pa.table({query_key: right[query_key].take(query), doc_key: left[doc_key].take(doc), "score": scores[doc, query]}, schema=schema)

    return score


def _scored(pairs: DataFrame, d: DataFrame, q: DataFrame, k: int, doc_key: str, query_key: str) -> DataFrame:
    """Best ``k`` of each stated (query, block), as (query, document, score)."""
    blocks = d.join(pairs.select("block", "batch").distinct(), "block").select("block", "batch", doc_key, "terms")
    asked = pairs.select(query_key, "block").join(q, query_key).select("block", "batch", query_key, "terms")
    out = T.StructType([q.schema[query_key], d.schema[doc_key], T.StructField("score", T.DoubleType())])
    return blocks.groupBy("block", "batch").cogroup(asked.groupBy("block", "batch")).applyInArrow(_scorer(k, doc_key, query_key, to_arrow_schema(out)), out)


def top_k(docs: DataFrame, queries: DataFrame, k: int, doc_key: str, query_key: str) -> DataFrame:
    """(query, document, score, rank) of the ``k`` documents with the highest positive sum of products of weights.

    Both tables hold a key and ``terms`` (array of term and positive weight), one row per key.  Equal scores go to the
    smaller document key.  Exact; queries without any shared term give no rows.
    """
    d, q = kept(docs.select(doc_key, "terms"), "top-docs"), kept(queries.select(query_key, "terms"), "top-queries")
    blocks, batches = (max(1, -(-df.count() // size)) for df, size in ((d, BLOCK_DOCS), (q, BATCH_QUERIES)))
    d = d.withColumn("block", F.pmod(F.xxhash64(doc_key), F.lit(blocks)))
    q = q.withColumn("batch", F.pmod(F.xxhash64(query_key), F.lit(batches)))
    bounds = kept(_bounds(d, q, query_key), "top-bounds")
    first = bounds.groupBy(query_key, "batch").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    found = kept(_scored(first, d, q, k, doc_key, query_key), "top-first")
    floor = found.groupBy(query_key).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    rest = bounds.join(first.select(query_key, "block"), [query_key, "block"], "left_anti").join(floor, query_key, "left")
    rest = rest.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - _SLACK))
    every = found.unionByName(_scored(rest, d, q, k, doc_key, query_key))
    w = Window.partitionBy(query_key).orderBy(F.round("score", _DIGITS).desc(), doc_key)
    return every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- keyword overlap
def keyword_top_k(
    docs: DataFrame, queries: DataFrame, k: int = 6, doc_key: str = "doc_id", query_key: str = "query_id", text: str = "text"
) -> DataFrame:
    """Documents by number of shared distinct tokens; a query without hits gets the first three documents."""
    def tokens(df, key):
        found = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([a-z0-9_.]+)"), F.lit(1)))
        return df.select(key, F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w"))).alias("terms"))

    best = kept(top_k(tokens(docs, doc_key), tokens(queries, query_key), k, doc_key, query_key), "keyword")
    best = best.select(query_key, doc_key, "score", "rank", F.lit("keyword").alias("source"))
    first = docs.select(doc_key).orderBy(doc_key).limit(3)
    numbered = first.agg(F.sort_array(F.collect_list(doc_key)).alias("ids"))
    silent = queries.select(query_key).join(best.select(query_key).distinct(), query_key, "left_anti")
    fallback = silent.crossJoin(F.broadcast(numbered)).select(
        query_key, F.posexplode("ids").alias("p", doc_key)
    ).select(query_key, doc_key, F.lit(0.0).alias("score"), (F.col("p") + 1).alias("rank"), F.lit("fallback").alias("source"))
    return best.unionByName(fallback)
