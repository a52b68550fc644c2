"""BPE encoding as a transducer with bounded look-ahead, and decoding as a byte-to-text state machine.

A merge list in training order has a *sufficient look-ahead*: a number of bytes after which nothing that follows can
change a token.  ``sufficient_lookahead`` computes it for the list at hand.  The encoder therefore needs to hold only
a window of that size plus a block: it emits the tokens that end before the look-ahead zone, drops their bytes and
goes on.  The text between two pretoken boundaries is independent of the rest, so short pretokens are final at once.

Bound.  Take two strings that agree on their first n bytes and apply the rules in order.  The place up to which both
have the same tokens moves left only where a rule x+y meets it: y starts at that place in one string and the rule
applies there but not in the other.  The next rule that moves it further has a right side that starts with what stood
there, so the moves form a chain of rules of growing rank in which the left side of one is a prefix of the right side
of the next.  The longest such chain, weighted by the length of the left sides, bounds the distance.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import PieceCache, Vocabulary, encode_texts
from .common import by_bytes, doc_text, release

_NONE = 1 << 30


def sufficient_lookahead(vocab: Vocabulary) -> int:
    """Bytes after which a token is final; raises if the merge list isn't in an order that has such a bound."""
    made = set(vocab.byte_ids.tolist())
    ids = {b: i for i, b in enumerate(vocab.token_bytes)}
    reach: dict[int, int] = {}
    longest = 1
    for left, right, merged in vocab.merges:
        if left not in made or right not in made or merged in made:
            raise ValueError("each merge must use tokens of earlier merges and make a new one")
        made.add(merged)
        y, best = vocab.token_bytes[right], 0
        for k in range(1, len(y) + 1):
            best = max(best, reach.get(ids.get(y[:k], -1), 0))
        best += len(vocab.token_bytes[left])
        reach[left] = max(reach.get(left, 0), best)
        longest = max(longest, best)
    return longest


class Ranks:
    """(left, right) -> rank and merged token, for arrays of pairs: two open tables and no searching."""

    def __init__(self, vocab: Vocabulary):
        left, right, merged = (np.array(x, np.int64) for x in zip(*vocab.merges))
        keys = left << 20 | right
        self.merged = np.append(merged, 0)
        self.tables = []
        rank = np.arange(len(keys))
        while len(keys):
            bits, factor = max(16, 4 + len(keys).bit_length()), 0x9E3779B97F4A7C15 + 2 * len(self.tables)
            slot = self._slot(keys, bits, factor)
            _, kept = np.unique(slot, return_index=True)
            table_key, table_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
            table_key[slot[kept]], table_rank[slot[kept]] = keys[kept], rank[kept]
            self.tables.append((bits, factor, table_key, table_rank))
            rest = np.ones(len(keys), bool)
            rest[kept] = False
            keys, rank = keys[rest], rank[rest]

    @staticmethod
    def _slot(keys: np.ndarray, bits: int, factor: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(factor & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right  # -1 in a place makes a key that no table holds
        out = np.full(keys.shape, _NONE, np.int32)
        for bits, factor, table_key, table_rank in self.tables:
            slot = self._slot(keys, bits, factor)
            hit = table_key[slot] == keys
            out[hit] = table_rank[slot[hit]]
        return out


class Transducer:
    """Encoder for pretokens; ``feed``/``end`` stream one pretoken's bytes, ``pieces`` takes many short ones at once."""

    SHORT = 24  # bytes up to which pretokens are merged side by side

    def __init__(self, vocab: Vocabulary, block: int = 512):
        self.vocab, self.ranks = vocab, Ranks(vocab)
        self.lookahead = sufficient_lookahead(vocab)
        self.window = self.lookahead + block
        self.pending = b""

    def _merge(self, data: bytes) -> np.ndarray:
        """Tokens of ``data``: again and again, the first rule that applies, at all its places from the left."""
        tokens = self.vocab.byte_ids[np.frombuffer(data, np.uint8)]
        while len(tokens) > 1:
            ranks = self.ranks.of(tokens[:-1], tokens[1:])
            best = int(ranks.min())
            if best == _NONE:
                break
            places, last = [], -2
            for p in np.flatnonzero(ranks == best).tolist():
                if p > last + 1:
                    places.append(p)
                    last = p
            places = np.array(places)
            tokens[places] = self.ranks.merged[best]
            tokens = np.delete(tokens, places + 1)
        return tokens

    def feed(self, data: bytes) -> Iterator[np.ndarray]:
        """Take more bytes of the pretoken; yield the tokens that have become final."""
        for at in range(0, len(data), self.window):
            self.pending += data[at : at + self.window]
            while len(self.pending) > self.window:
                tokens = self._merge(self.pending[: self.window])
                ends = np.cumsum(self.vocab.lengths[tokens])
                final = int(np.searchsorted(ends, self.window - self.lookahead, "right"))
                if not final:  # a first token longer than the block
                    self.window *= 2
                    continue
                yield tokens[:final]
                self.pending = self.pending[int(ends[final - 1]) :]

    def end(self) -> np.ndarray:
        tokens = self._merge(self.pending)
        self.pending = b""
        return tokens

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        sizes = np.array([len(d) for d in data], np.int64)
        out: list[np.ndarray | None] = [None] * len(data)
        short = np.flatnonzero(sizes <= self.SHORT)
        order = short[np.argsort(sizes[short], kind="stable")]
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096].tolist()
            for row, tokens in zip(rows, self._side_by_side([data[r] for r in rows])):
                out[row] = tokens
        for row in np.flatnonzero(sizes > self.SHORT).tolist():
            out[row] = np.concatenate([*self.feed(data[row]), self.end()])
        lengths = np.array([len(o) for o in out], np.int64)
        return (np.concatenate(out) if out else np.empty(0)).astype(np.uint32), lengths

    def _side_by_side(self, data: list[bytes]) -> list[np.ndarray]:
        """Merge many short byte strings, one row each: every round applies each row's first rule at its first place."""
        sizes = np.array([len(d) for d in data])
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(len(data), width)
        tokens = np.where(np.arange(width) < sizes[:, None], self.vocab.byte_ids[raw], -1)
        live, ranks = np.arange(len(data)), None
        columns = np.arange(width)
        ranks = self.ranks.of(tokens[:, :-1], tokens[:, 1:]) if width > 1 else np.full((len(data), 1), _NONE, np.int32)
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            going = best < _NONE
            live, ranks, at, best = live[going], ranks[going], at[going], best[going]
            if not len(live):
                break
            rows = np.arange(len(live))
            own = tokens[live]
            own[rows, at] = self.ranks.merged[best]
            shift = columns[None, :] > at[:, None]
            moved = np.full_like(own, -1)
            moved[:, :-1] = own[:, 1:]
            own = np.where(shift, moved, own)
            tokens[live] = own
            shifted = np.full_like(ranks, _NONE)
            shifted[:, :-1] = ranks[:, 1:]
            ranks = np.where(columns[None, :-1] >= at[:, None], shifted, ranks)
            ranks[rows, at] = np.where(at < width - 1, self.ranks.of(own[rows, at], own[rows, np.minimum(at + 1, width - 1)]), _NONE)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks.of(own[left, at[left] - 1], own[left, at[left]])
        counts = (tokens >= 0).sum(axis=1)
        return [row[:n] for row, n in zip(tokens, counts.tolist())]


class Decoder:
    """Ids to text, part by part: the state is the unfinished UTF-8 sequence (at most three bytes)."""

    def __init__(self, vocab: Vocabulary):
        self.token = vocab.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, block: int = 8192) -> Iterator[str]:
        for at in range(0, len(ids), block):
            yield self.state.decode(b"".join(map(self.token.__getitem__, ids[at : at + block].tolist())))

    def end(self) -> str:
        text = self.state.decode(b"", final=True)
        self.state.reset()
        return text


@lru_cache(maxsize=2)
def _machines(source: str) -> tuple[Vocabulary, PieceCache]:
    vocab = Vocabulary(source)
    return vocab, PieceCache(Transducer(vocab).pieces)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per document: number of ids, digest of the ids, digest of the text decoded from them.

    Null and empty texts have no ids and the digests of nothing; repeated rows stay repeated; other columns are
    ignored.  Each row is handled where it is read: no shuffle, memory bounded by a block of characters.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # one tokenizer file: a few MB whatever the data

    def run(batches):
        vocab, cache = _machines(source.value)
        for batch in by_bytes(batches):
            keys, rows = batch.column(0).to_pylist(), []
            texts = batch.column(1).to_pylist()
            n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(vocab)
            for i, ids, last in encode_texts(texts, cache, vocab):
                n += len(ids)
                ids_hash.update(ids.astype("<u4").tobytes())
                for text in decoder.feed(ids):
                    text_hash.update(text.encode())
                if last:
                    text_hash.update(decoder.end().encode())
                    rows.append((keys[i], n, ids_hash.hexdigest(), text_hash.hexdigest()))
                    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        release()

    return doc_text(docs).mapInArrow(run, SCHEMA)


def encoded(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids, round_trip (whether decoding the ids gives the text back).

    Same ids, same treatment of null and empty texts and of repeated rows as ``encode_decode``.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        vocab, cache = _machines(source.value)
        for batch in by_bytes(batches):
            texts, runs, same = batch.column(1).to_pylist(), [], []
            parts, decoder, at, good = [], Decoder(vocab), 0, True
            for i, ids, last in encode_texts(texts, cache, vocab):
                parts.append(ids)
                for text in [*decoder.feed(ids), *([decoder.end()] if last else [])]:
                    good &= texts[i][at : at + len(text)] == text
                    at += len(text)
                if last:
                    runs.append(np.concatenate(parts).astype(np.int32))
                    same.append(good and at == len(texts[i]))
                    parts, at, good = [], 0, True
            offsets = np.cumsum([0, *map(len, runs)])
            flat = np.concatenate(runs) if runs else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "round_trip"])
        release()

    return doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
