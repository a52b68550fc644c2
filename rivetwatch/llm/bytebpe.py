"""Byte-level BPE over batches of texts: vectorised pretoken boundaries and one encoding per distinct pretoken.

The boundaries follow the pattern of byte-level tokenizers (contractions, an optional space before a run of letters,
of numbers or of other characters, white space); tests hold them against the tokenizers library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from .common import mix, powers

_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE = range(5)
# Unicode's White_Space characters; the plain space is a class of its own.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"L": _LETTER, "N": _NUMBER}
        k = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
        k[_WHITE] = _BLANK
        k[0x20] = _SPACE
        _CLASSES = k
    return _CLASSES


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pretoken_starts(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Start positions of pretokens in ``cps``; ``first`` marks the first code point of each text in it."""
    n = len(cps)
    kind = classes()[cps]
    blank = kind >= _BLANK
    run = np.minimum(kind, _BLANK)
    change = first.copy()
    change[1:] |= run[1:] != run[:-1]
    start = change.copy()
    # A run after white space in its text: the last white character stands alone, or joins the run if it is a space.
    begins = np.flatnonzero(change & ~blank & ~first)
    begins = begins[blank[begins - 1]]
    start[begins - 1] = True
    start[begins[kind[begins - 1] == _SPACE]] = False
    for i in np.flatnonzero(start[:-1] & (cps[:-1] == 39) & (kind[1:] == _LETTER) & ~first[1:]).tolist():
        tail = [int(c) for c in cps[i + 1 : i + 3]]
        if len(tail) == 2 and first[i + 2]:
            tail.pop()
        if chr(tail[0]) in "stmd":
            end = i + 2
        elif len(tail) == 2 and chr(tail[0]) + chr(tail[1]) in ("re", "ve", "ll"):
            end = i + 3
        else:
            continue
        start[i + 1 : min(end, n)] = first[i + 1 : min(end, n)]
        if end < n:
            start[end] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Tables of a byte-level BPE tokenizer file: tokens as bytes, merges by rank, special tokens."""

    def __init__(self, source: str | bytes):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer file without a normalizer is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.token_bytes[i] = bytes(as_byte[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        by_bytes = {b: i for i, b in enumerate(self.token_bytes) if i not in set(self.special.values())}
        self.byte_ids = np.array([by_bytes[bytes([b])] for b in range(256)], np.int64)
        self.merges: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = model["vocab"][left], model["vocab"][right]
            self.merges.append((a, b, model["vocab"][left + right]))
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.opens = np.array([b[:1] == b" " for b in self.token_bytes])


class PieceCache:
    """Ids of distinct pretokens, filled by ``encode_new(pieces) -> (flat ids, lengths)``; forgets all beyond ``most``.

    Pieces are found by a hash in a table that is probed for all of them at once, and each is then compared with the
    characters of the piece it was taken for.  Those that differ, and pieces of more than LONG characters, are encoded
    by themselves and not kept, so the cache is bounded in bytes as well.
    """

    LONG = 64

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 200_000):
        self.encode_new, self.most = encode_new, most
        self.bits = max(10, (3 * most - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.held = self.used = self.letters = 0
        self.ids, self.pool = np.empty(1 << 16, np.uint32), np.empty(1 << 18, np.uint32)
        self.offset, self.length, self.place, self.size = (np.empty(1 << 15, np.int64) for _ in range(4))
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where there is none."""
        out = np.full(len(key), -1, np.int64)
        todo, at = np.arange(len(key)), (key >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            slot = self.slots[at]
            found = (slot >= 0) & (self.keys[at] == key[todo])
            out[todo[found]] = slot[found]
            on = (slot >= 0) & ~found
            todo, at = todo[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, lengths = self.encode_new(pieces)
        letters = code_points("".join(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n, m = self.held, len(pieces)
        self.ids, self.pool = _room(self.ids, self.used + len(ids)), _room(self.pool, self.letters + len(letters))
        self.offset, self.length, self.place, self.size = (_room(x, n + m) for x in (self.offset, self.length, self.place, self.size))
        self.ids[self.used : self.used + len(ids)] = ids
        self.pool[self.letters : self.letters + len(letters)] = letters
        self.offset[n : n + m], self.length[n : n + m] = self.used + np.cumsum(lengths) - lengths, lengths
        self.place[n : n + m], self.size[n : n + m] = self.letters + np.cumsum(sizes) - sizes, sizes
        self.held, self.used, self.letters = n + m, self.used + len(ids), self.letters + len(letters)
        mask = len(self.slots) - 1
        for slot, (key, at) in enumerate(zip(keys.tolist(), (keys >> np.uint64(64 - self.bits)).tolist()), n):
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.keys[at], self.slots[at] = key, slot

    def _differ(self, slot: np.ndarray, cps: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each piece isn't, letter by letter, the one of its slot."""
        other = self.size[slot] != size
        same = np.flatnonzero(~other)
        sizes = size[same]
        if len(same):
            first = np.cumsum(sizes) - sizes
            within = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
            unequal = cps[np.repeat(start[same], sizes) + within] != self.pool[np.repeat(self.place[slot[same]], sizes) + within]
            other[same] = np.logical_or.reduceat(unequal, first)
        return other

    def encode(self, text: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined in ``text`` and the number of ids of each; ``at``: where each text starts."""
        cps = code_points(text)
        n = len(cps)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        first = np.zeros(n, bool)
        first[0] = True
        first[at[at < n]] = True
        start = pretoken_starts(cps, first)
        end = np.append(start[1:], n)
        size = end - start
        up, down = powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((cps + np.uint32(1)) * up, out=total[1:])
        key = mix((total[end] - total[start]) * down[start] + size.astype(np.uint64))
        if self.held > self.most:
            self.clear()
        short = size <= self.LONG
        slot = np.full(len(start), -1, np.int64)
        slot[short] = self._find(key[short])
        new = np.flatnonzero(short & (slot < 0))
        if len(new):
            fresh, where = np.unique(key[new], return_index=True)
            where = new[where]
            # More than fit the table are left to the way of long pieces.
            fits = max(0, len(self.slots) // 2 - self.held)
            fresh, where = fresh[:fits], where[:fits]
            if len(fresh):
                self._add(fresh, [text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())])
                slot[new] = self._find(key[new])
        held = np.flatnonzero(slot >= 0)
        slot[held[self._differ(slot[held], cps, start[held], size[held])]] = -1
        offset, length, ids = self.offset, self.length, self.ids
        alone = np.flatnonzero(slot < 0)
        if len(alone):
            pieces = [text[a:b] for a, b in zip(start[alone].tolist(), end[alone].tolist())]
            place = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
            own, lengths = self.encode_new(list(place))
            offset = np.append(offset[: self.held], self.used + np.cumsum(lengths) - lengths)
            length = np.append(length[: self.held], lengths)
            ids = np.append(ids[: self.used], own)
            slot[alone] = self.held + np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        length = length[slot]
        ends = np.cumsum(length)
        out = ids[np.repeat(offset[slot] - (ends - length), length) + np.arange(ends[-1])]
        before = np.append(0, ends)
        marks = before[np.searchsorted(start, at)]
        return out, np.append(marks[1:], ends[-1]) - marks


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """``values`` with place for ``n`` entries."""
    while len(values) < n:
        values = np.concatenate([values, np.empty_like(values)])
    return values


def _last_boundary(cps: np.ndarray) -> int:
    """The last position inside ``cps`` where a pretoken starts whatever stands on both sides; 0 if there is none.

    That is white space after something else, or another class of characters with no apostrophe in the three before it.
    """
    kind = np.minimum(classes()[cps], _BLANK)
    change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)) + 1
    quote = np.append(0, np.cumsum(cps == 39))
    good = (kind[change] == _BLANK) | (quote[change] == quote[np.maximum(change - 3, 0)])
    change = change[good]
    return int(change[-1]) if len(change) else 0


def _cuts(text: str, most: int) -> Iterator[str]:
    """``text`` in blocks of about ``most`` characters, cut where a pretoken surely starts."""
    at = 0
    while len(text) - at > most:
        cut, reach, seen = 0, most, 0
        while not cut and at + seen < len(text):
            # Each look starts where the last one ended, four characters of context included.
            back = max(0, seen - 4)
            cut = _last_boundary(code_points(text[at + back : at + reach]))
            cut += back if cut else 0
            seen, reach = reach, reach * 2
        if not cut:
            break
        yield text[at : at + cut]
        at += cut
    yield text[at:]


def encode_texts(texts: list[str], cache: PieceCache, vocab: Vocabulary, block: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(index of the text, ids, whether the text ends here) in order; a text comes in several parts if it is long.

    Special tokens that occur in a text become their id, as the library does.  Work is on blocks of at most about
    ``block`` characters whatever the length of the texts.
    """
    held: list[tuple[int, str, int | None, bool]] = []
    size = 0

    def flush():
        nonlocal size
        joined = "".join(h[1] for h in held)
        at = np.cumsum([0] + [len(h[1]) for h in held])[:-1].astype(np.int64)
        ids, counts = cache.encode(joined, at)
        done = 0
        for (i, _, special, last), count in zip(held, counts.tolist()):
            part = ids[done : done + count]
            done += count
            yield i, part if special is None else np.append(part, np.uint32(special)), last
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for segment, special, last in _segments(text, vocab.special):
            done = 0
            for part in _cuts(segment, block):
                done += len(part)
                end = done == len(segment)
                held.append((i, part, special if end else None, last and end))
                size += len(part)
                if size >= block:
                    yield from flush()
    if held:
        yield from flush()


def _segments(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None, bool]]:
    """Parts of ``text`` between special tokens, each with the token that follows it."""
    at = 0
    if special:
        for found in re.finditer("|".join(map(re.escape, sorted(special, key=len, reverse=True))), text):
            yield text[at : found.start()], special[found.group()], False
            at = found.end()
    yield text[at:] if at else text, None, True
