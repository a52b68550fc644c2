"""Language identification by cross-parsing: how few pieces of a language's reference text make up a document.

For each language a suffix automaton of a bounded sample of labelled text recognises every substring of that sample.
A document is parsed greedily into the longest phrases the automaton accepts; phrases times the bits that name a place
in the reference, per character, estimate the cross entropy.  The language with the fewest wins.

The automata are dense transition tables over the most frequent letters, so a batch of documents is parsed in step: one
table look-up per character and language.  Transitions by all other letters of the samples are sorted keys, searched
where such a letter stands.  Documents are parsed in stretches of ``STRETCH`` characters, which adds at most one phrase to each.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytebpe import classes, code_points
from .common import fold

# Bounds of what is learned from, per language: documents, characters of one document, characters in all.
SAMPLE_DOCS, DOC_CHARS, SAMPLE_CHARS = 48, 2_000, 32_000
LETTERS = 94  # most frequent letters, which have a column of the dense table; letters of no sample are one symbol
STRETCH = 256
FOLDS, TEST_FOLD = 4, 2
UNKNOWN = "und"
_FAILS = np.uint32(1 << 31)
_BLANK, _ODD, _BREAK, _PAD = 0, 1, 2, 3  # symbols; letters follow


class Model(NamedTuple):
    languages: list[str]
    symbol: np.ndarray  # code point -> symbol
    n_symbols: int  # symbols with a column of the table
    table: np.ndarray  # state * n_symbols + symbol -> state, with the top bit set where a new phrase begins
    starts: np.ndarray  # per language: the state before any phrase
    bits: np.ndarray  # per language: bits that name a place in the reference
    roots: np.ndarray  # per language: the state of the empty phrase
    keys: np.ndarray  # state << 32 | symbol of the transitions by symbols without a column, in order
    targets: np.ndarray  # their states


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton whose paths from state 0 are the substrings of ``symbols``."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        current = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = current
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[current] = copy
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
        last = current
    return nexts


def _lower(c: int) -> int:
    low = chr(c).lower()
    return ord(low) if len(low) == 1 else c


def learn(samples: dict[str, list[str]]) -> Model:
    """Model of each language's sample texts (cut to the bounds above)."""
    letters = classes() == 0
    cut = {lang: [t[:DOC_CHARS] for t in texts] for lang, texts in sorted(samples.items())}
    seen = Counter(_lower(ord(c)) for texts in cut.values() for t in texts for c in t if letters[ord(c)])
    known = {c: i + _PAD + 1 for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))}
    symbol = np.where(letters, _ODD, _BLANK).astype(np.min_scalar_type(_PAD + len(known)))
    for c in range(0x110000):
        if letters[c] and (s := known.get(_lower(c))):
            symbol[c] = s
    n = _PAD + 1 + min(LETTERS, len(known))
    tables, starts, bits, states = [], [], [], 0
    roots: list[int] = []
    other: dict[int, int] = {}
    for lang, texts in cut.items():
        flow: list[int] = []
        for t in texts:
            if len(flow) >= SAMPLE_CHARS:
                break
            flow += symbols_of(t, symbol).tolist()[: SAMPLE_CHARS - len(flow)] + [_BREAK]
        nexts = suffix_automaton(flow)
        table = np.full((len(nexts) + 1, n), -1, np.int64)
        for state, to in enumerate(nexts):
            for c, target in to.items():
                if c < n:
                    table[state, c] = target
                else:
                    other[(states + state) << 32 | c] = states + target
        dead = len(nexts)  # no phrase is open: any symbol begins one
        table[:, _ODD] = -1
        again = np.where(table[0] >= 0, table[0], dead)
        open_phrase = table >= 0
        out = np.where(open_phrase, table, again[None, :]).astype(np.uint32) + np.uint32(states)
        out |= np.where(open_phrase, np.uint32(0), _FAILS)
        out[:, _PAD] = np.arange(len(table), dtype=np.uint32) + np.uint32(states)
        tables.append(out)
        starts.append(states + dead)
        roots.append(states)
        bits.append(np.log2(max(2, len(flow))))
        states += len(table)
    table = np.concatenate(tables).ravel() if tables else np.empty(0, np.uint32)
    keys = np.array(sorted(other), np.int64)
    targets = np.array([other[k] for k in keys.tolist()], np.uint32)
    return Model(list(cut), symbol, n, table, np.array(starts, np.uint32), np.array(bits), np.array(roots, np.int64), keys, targets)


def symbols_of(text: str, symbol: np.ndarray) -> np.ndarray:
    """Symbols of a text; runs of anything but letters are one blank."""
    s = symbol[code_points(text)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != _BLANK) | (s[:-1] != _BLANK)
    return s[keep]


def _by_key(model: Model, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """States (languages x places) after symbols that have no column, with the top bit as in the table."""
    def to(before: np.ndarray, none: np.ndarray) -> np.ndarray:
        key = before.astype(np.int64) << 32 | symbols
        at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
        return np.where(model.keys[at] == key, model.targets[at], none)

    return to(state, to(model.roots[:, None], model.starts[:, None]) | _FAILS)


def phrases(model: Model, flows: list[np.ndarray]) -> np.ndarray:
    """Number of phrases of each flow of symbols (rows) in each language's reference (columns)."""
    counts = np.array([max(1, -(-len(f) // STRETCH)) for f in flows])
    padded = np.full(int(counts.sum()) * STRETCH, _PAD, model.symbol.dtype)
    at = np.cumsum(counts) - counts
    for f, a in zip(flows, at.tolist()):
        padded[a * STRETCH : a * STRETCH + len(f)] = f
    steps = np.ascontiguousarray(padded.reshape(-1, STRETCH).T)
    width = np.uint32(model.n_symbols)
    total = np.zeros((len(model.starts), steps.shape[1]), np.uint32)
    for a in range(0, steps.shape[1], 4096):
        part = steps[:, a : a + 4096]
        state = np.repeat(model.starts[:, None], part.shape[1], axis=1)
        number = total[:, a : a + 4096]
        for column in part:
            apart = np.flatnonzero(column >= width) if len(model.keys) else ()
            if len(apart):
                after = _by_key(model, state[:, apart], column[apart].astype(np.int64))
                column = np.where(column < width, column, _ODD).astype(column.dtype)
            state *= width
            state += column
            state = model.table.take(state)
            if len(apart):
                state[:, apart] = after
            number += state >> np.uint32(31)
            state &= ~_FAILS
    return np.add.reduceat(total, at, axis=1).T


def sample(docs: DataFrame, folds: int = FOLDS, test_fold: int = TEST_FOLD) -> dict[str, list[str]]:
    """At most SAMPLE_DOCS texts per language out of the learning folds, chosen by a hash of doc_id.

    The choice needs doc_id and lang only (a minimum per language and slice of the hash, combined before the shuffle);
    then the chosen texts are fetched.
    """
    usable = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & (fold("doc_id", folds) != test_fold))
    h = F.xxhash64("doc_id")
    chosen = usable.groupBy("lang", F.pmod(h, F.lit(SAMPLE_DOCS)).alias("slice")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("m"))
    ids = sorted({r.m.doc_id for r in chosen.collect()})
    out: dict[str, set] = {}
    rows = docs.select("doc_id", "lang", F.substring("text", 1, DOC_CHARS).alias("text")).filter(F.col("doc_id").isin(ids))
    for r in rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).collect() if ids else []:
        out.setdefault(r.lang, set()).add((r.doc_id, r.text))
    # More rows than ids only where a doc_id repeats; a fixed number per language is kept.
    return {lang: [t for _, t in sorted(texts)[: 2 * SAMPLE_DOCS]] for lang, texts in out.items()}


def identify(docs: DataFrame, folds: int = FOLDS, test_fold: int = TEST_FOLD) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    ``und`` (score 0) where the text is null or has no letter, or where nothing could be learned.  The score is the
    runner-up's share of the cross entropies of the two best languages (0.5: a tie, which goes to the first name);
    1 if one language is known.  Rows without doc_id count as not held out and are never learned from.
    """
    model = learn(sample(docs, folds, test_fold))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's bounds, per language

    def run(batches):
        m = shared.value
        letters = classes() == 0
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and size < 1 << 22:
                    size += len(texts[end])
                    end += 1
                known = [bool(letters[code_points(t)].any()) for t in texts[at:end]]
                flows = [symbols_of(t, m.symbol) for t, k in zip(texts[at:end], known) if k] if m.languages else []
                cost = phrases(m, flows) * m.bits if flows else np.empty((0, len(m.languages)))
                order = np.argsort(cost, axis=1, kind="stable")
                row = 0
                for k in known:
                    if not (k and m.languages):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = order[row]
                    names.append(m.languages[best[0]])
                    scores.append(1.0 if len(best) < 2 else float(cost[row, best[1]] / (cost[row, best[0]] + cost[row, best[1]])))
                    row += 1
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(fold("doc_id", folds) == test_fold, F.lit(False)).alias("held_out"),
                      F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
