"""Toxicity scores: boosted trees over a few dense features of the whole text, calibrated by isotonic regression.

Learning uses a bounded sample of labelled rows.  Each half of it gives a lexicon (words and word beginnings that
toxic rows hold far more often, by log-likelihood ratio) for the features of the other half, so the trees never see a
lexicon made from their own rows; documents are scored with the lexicon of both halves.  Calibration is fitted to
scores that trees without the row's own part gave.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACES, by_bytes, fold, release, stored

SAMPLE_ROWS = 12_000  # labelled rows learned from, at most
LEXICON = 4_000  # entries kept, strongest first
MIN_RATIO, MIN_G2, MIN_ROWS = 3.0, 12.0, 3
PREFIXES = (4, 5, 6)
FOLDS, TEST_FOLD = 5, 0
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.15, 64, 5
NEAR, SPAN = 5, 50  # words around a second person; words of the densest stretch

# Second-person words of common European languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deiner deinem deinen ihr euch euer tu te toi ton ta tes "
    "vous votre vos tú ti tuyo tuya contigo usted ustedes vosotros vuestro os voi tuo tua você seu sua jij je jou jouw".split())
# Signs used in place of letters.
_SIGNS = str.maketrans("01345@$!|", "oieasasil")

_WORDS = re.compile(r"[^\W\d_]+")
# Tried at the first letter of a run only and without going back, so the time grows with the length of the text.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*]++[^\W\d_]++)++|[@$][^\W\d_]++")
_CAPS = re.compile(rb"(?<![A-Za-z])[A-Z]{2,}(?![A-Za-z])")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))

FEATURES = ("hits", "density", "densest", "strength", "near_second", "second", "capitals", "caps_words", "exclaims",
            "questions", "symbols", "repeats", "masked", "unmasked_hits", "digits", "words")


def terms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


class _Flags(dict):
    """word -> (strength in the lexicon, second person), remembered up to a bound."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        strength = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
        value = strength + (1000.0 if word in SECOND_PERSON else 0.0)
        if len(self) > 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def features(text: str, flags: _Flags) -> list[float]:
    """The values of FEATURES for one whole text; zeros if it is empty."""
    raw = text.encode()
    words = _WORDS.findall(text.lower())
    n, size = max(1, len(words)), max(1, len(raw) - sum(map(raw.count, (bytes([c]) for c in SPACES))))
    value = np.fromiter(map(flags.__getitem__, words), np.float64, len(words))
    second = value >= 1000
    strength = np.where(second, value - 1000, value)
    hit = strength > 0
    hits = int(hit.sum())
    densest = near = 0
    if hits:
        at = np.flatnonzero(hit)
        densest = int((np.searchsorted(at, at + SPAN) - np.arange(hits)).max())
        yous = np.flatnonzero(second)
        near = int((np.searchsorted(yous, at + NEAR, "right") > np.searchsorted(yous, at - NEAR)).sum())
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = upper + len(raw) - len(raw.translate(None, _LOWER))
    masked = _MASKED.findall(text) if any(c in text for c in "0123456789@$!|*") else []
    unmasked = sum(flags.lexicon.get(t, 0) > 0 for m in masked for t in terms(m.lower().translate(_SIGNS)))
    exclaims, questions = raw.count(b"!"), raw.count(b"?")
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>@"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    return [np.log1p(hits), hits / n, densest, float(strength.sum()) / n, near, int(second.sum()) / n, upper / max(1, letters),
            len(_CAPS.findall(raw)) / n, exclaims / size, questions / size, symbols / size, (raw.count(b"!!") + raw.count(b"??")) / n,
            len(masked) / n, unmasked, digits / size, np.log1p(len(words))]


# --- trees -----------------------------------------------------------------------------------------------------

class Trees(NamedTuple):
    base: float
    feature: np.ndarray  # trees x inner nodes, in heap order
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while True:
                inner = node < len(feature)
                if not inner.any():
                    break
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient-boosted trees of fixed depth for the log-loss, on quantile bins; same rows, same trees."""
    rate = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    base, inner = float(np.log(rate / (1 - rate))), 2**DEPTH - 1
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(x) else [np.empty(0)] * len(FEATURES)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1) if len(x) else np.zeros((0, len(FEATURES)), int)
    raw, all_f, all_c, all_l = np.full(len(y), base), [], [], []
    for _ in range(TREES if len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = (1e-6, 0, np.inf, None)
            if len(own) >= 2 * LEAF:
                g, h = gradient[own], weight[own]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    b = binned[own, f]
                    m = len(edges[f]) + 1
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g, h, None))
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                    gain[(ns < LEAF) | (len(own) - ns < LEAF)] = 0
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], f, edges[f][j], b > j)
            _, feature[k], cut[k], right = best
            node[own] = 2 * k + 1 + (right if right is not None else 0)
        leaf = np.array([gradient[node == inner + j].sum() / (weight[node == inner + j].sum() + 1) for j in range(inner + 1)]) * RATE
        raw += leaf[node - inner]
        all_f.append(feature)
        all_c.append(cut)
        all_l.append(leaf)
    return Trees(base, np.array(all_f, np.int64).reshape(-1, inner), np.array(all_c, float).reshape(-1, inner), np.array(all_l, float).reshape(-1, inner + 1))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centres of the blocks, their rates), to be read by linear interpolation."""
    blocks: list[list[float]] = []  # sum of y, rows, sum of raw
    for i in np.argsort(raw, kind="stable"):
        blocks.append([float(y[i]), 1.0, float(raw[i])])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model(NamedTuple):
    lexicon: dict[str, float]
    trees: Trees
    centres: np.ndarray
    rates: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        if len(self.centres) < 2:
            return np.full(len(x), self.rates[0] if len(self.rates) else 0.0)
        return np.clip(np.interp(raw, self.centres, self.rates), 0.0, 1.0)


# --- learning --------------------------------------------------------------------------------------------------

def labelled(docs: DataFrame, labels: DataFrame, folds: int, test_fold: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, half, toxic, text): at most ``rows`` labelled documents outside the test fold, the first by a hash.

    The labels chosen are bounded by ``rows``, so they are broadcast; a doc_id with several labels counts as toxic if
    one says so.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & (fold("doc_id", folds) != test_fold))
    order = F.xxhash64(F.col("doc_id").cast("long"), F.lit(9))
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(rows)
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return text.join(F.broadcast(chosen), "doc_id").select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)).cast("int").alias("half"), "toxic", "text")


def term_counts(sample: DataFrame) -> DataFrame:
    """(term, half, toxic, n): documents of the sample that hold each word or word beginning."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, int, int], int] = {}
            for half, toxic, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                for term in {t for w in set(_WORDS.findall(text.lower())) for t in terms(w)}:
                    seen[term, half, toxic] = seen.get((term, half, toxic), 0) + 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["term", "half", "toxic", "n"])

    return sample.mapInArrow(run, "term string, half int, toxic int, n long")


def _lexicon(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Terms with enough evidence and their log-odds, from (term, clean rows, toxic rows) and the numbers of rows."""
    counts = [c for c in counts if c[2]]
    if not counts or not clean or not toxic:
        return {}
    a = np.array([c[2] for c in counts], float)
    b = np.array([c[1] for c in counts], float)
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))
    expected = (a + b) * toxic / (toxic + clean)
    g2 = 2 * (a * np.log(np.maximum(a, 1e-9) / expected) + b * np.log(np.maximum(b, 1e-9) / (a + b - expected)))
    good = np.flatnonzero((odds > np.log(MIN_RATIO)) & (g2 > MIN_G2) & (a >= MIN_ROWS))
    good = sorted(good.tolist(), key=lambda i: (-g2[i], counts[i][0]))[:LEXICON]
    return {counts[i][0]: float(odds[i]) for i in good}


def _lexicons(sample: DataFrame) -> dict[str, dict[str, float]]:
    """Lexicons from half 0, half 1 and both; what is fetched is bounded by the sample and by the evidence asked for."""
    size = {(r.half, r.toxic): r.n for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [F.sum(F.when((F.col("half") == h) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"c{h}{t}") for h in (0, 1) for t in (0, 1)]
    toxic, clean = F.col("c01") + F.col("c11"), F.col("c00") + F.col("c10")
    share = max(1, size.get((0, 1), 0) + size.get((1, 1), 0)) / max(1, sum(size.values()))
    rows = term_counts(sample).groupBy("term").agg(*parts).filter((toxic >= MIN_ROWS) & (toxic > MIN_RATIO * share / 2 * (toxic + clean))).collect()
    n = {k: size.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    return {"0": _lexicon([(r.term, r.c00, r.c01) for r in rows], n[0, 0], n[0, 1]),
            "1": _lexicon([(r.term, r.c10, r.c11) for r in rows], n[1, 0], n[1, 1]),
            "both": _lexicon([(r.term, r.c00 + r.c10, r.c01 + r.c11) for r in rows], n[0, 0] + n[1, 0], n[0, 1] + n[1, 1])}


def learn(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, test_fold: int = TEST_FOLD) -> Model:
    sample = stored(labelled(docs, labels, folds, test_fold), "toxic-sample")
    lexicons = _lexicons(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)  # at most LEXICON entries each

    def run(batches):
        flags = {h: _Flags(shared.value[str(1 - h)]) for h in (0, 1)}
        for batch in batches:
            rows = [features(t, flags[h]) for h, t in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rows = sample.mapInArrow(run, "doc_id long, toxic int, x array<double>").collect()  # SAMPLE_ROWS rows of numbers
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r.toxic for r in rows], float)
    part = np.arange(len(y)) % 4
    raw = np.zeros(len(y))
    for k in range(4):
        raw[part == k] = boost(x[part != k], y[part != k]).raw(x[part == k])
    return Model(lexicons["both"], boost(x, y), *isotonic(raw, y))


def score(docs: DataFrame, model: Model, folds: int = FOLDS, test_fold: int = TEST_FOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  Null texts are empty; rows without doc_id aren't held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        flags = _Flags(shared.value.lexicon)
        for batch in by_bytes(batches):
            x = np.array([features(t.as_py(), flags) for t in batch.column(2)], float).reshape(-1, len(FEATURES))
            s = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        release()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(fold("doc_id", folds) == test_fold, F.lit(False)).alias("held_out"),
                      F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, less those whose score reaches ``threshold``; each is judged where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        flags = _Flags(shared.value.lexicon)
        for batch in by_bytes(batches):
            x = np.array([features(t.as_py() or "", flags) for t in batch.column(at)], float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(shared.value.scores(x) < threshold))
        release()

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, test_fold: int = TEST_FOLD) -> DataFrame:
    """Scores of every document by a model learned from ``labels`` outside the test fold.

    Without labels, or with labels of one kind only, every document gets the learning rows' rate (0 without any).
    Repeated rows stay repeated; columns other than doc_id and text play no part.
    """
    return score(docs, learn(docs, labels, folds, test_fold), folds, test_fold)
