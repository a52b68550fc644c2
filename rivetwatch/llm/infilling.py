"""Fill-in-middle transformation; cut points are found by rank and select over words of eight bytes.

A batch's texts lie one after the other in Arrow's buffer, which is viewed as 64-bit words.  The bytes that end a unit
(line feeds) are marked in all eight bytes of a word at once by arithmetic, counted with ``bitwise_count`` and summed
up.  "The end of a text's k-th line" is then: the rank at the text's start plus k, a search of the cumulative counts for
the word, and the select inside that word by clearing lower marks.  Code points are counted the same way, by the bytes
that begin one.  No text is scanned byte by byte and none is split into lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 100, 50  # per cent of documents that are transformed, and of these in suffix-prefix-middle order
SEED = "7"
SLICE_BYTES = 1 << 23  # text of about this size is marked at a time

_EACH = np.uint64(0x0101010101010101)
_HIGH, _LOW7 = np.uint64(0x8080808080808080), np.uint64(0x7F7F7F7F7F7F7F7F)
_ONE = np.uint64(1)


def marks_of(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte of ``words`` that equals ``byte``; exact, no carry leaves a byte."""
    x = words ^ (_EACH * np.uint64(byte))
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def begins_of(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point (all but 10xxxxxx)."""
    return (~words | (words << _ONE)) & _HIGH


class Marked:
    """Rank and select over the marks of a buffer."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte position."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        here = self.marks[np.minimum(word, len(self.marks) - 1)] if len(self.marks) else np.zeros(len(at), np.uint64)
        low = here & ((_ONE << (inside << np.uint64(3))) - _ONE)
        return self.before[word] + np.where(inside > 0, np.bitwise_count(low), 0)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the k-th mark, counted from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[word]
        x = self.marks[word]
        for step in range(7):  # at most seven marks lie below one in its word
            x = np.where(left > step, x & (x - _ONE), x)
        lowest = x & (~x + _ONE)
        return word * 8 + (np.bitwise_count(lowest - _ONE) >> 3)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of the text bytes, positions where texts start and end in them) of a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    data = np.zeros(-(-size // 8) * 8, np.uint8)
    if size:
        data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view("<u8"), offsets - offsets[0]


def plan(ids: list[int | None], texts: pa.Array, seed: str = SEED, rate: int = RATE, spm: int = SPM, unit_end: int = 10) -> dict[str, np.ndarray | list]:
    """Per text: n (units), form, and the byte positions ``cut`` of its two cuts with their distances in code points."""
    words, edge = _buffer(texts)
    ends = Marked(marks_of(words, unit_end))
    begins = Marked(begins_of(words))
    start, stop = edge[:-1], edge[1:]
    data = words.view(np.uint8)
    first = ends.rank(start)
    closed = ends.rank(stop) - first
    open_end = (stop > start) & (data[np.maximum(stop - 1, 0)] != unit_end) if len(data) else np.zeros(len(start), bool)
    n = closed + open_end
    h = np.array([np.frombuffer(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).digest()[:16], ">u4") for d in ids], np.int64).reshape(-1, 4)
    cut = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)

    def position(k: np.ndarray) -> np.ndarray:
        at = np.where(k == 0, start, stop)
        inner = np.flatnonzero((k > 0) & (k <= closed))
        at[inner] = ends.select(first[inner] + k[inner] - 1) + 1
        return at

    a, b = position(cut[:, 0]), position(cut[:, 1])
    zero = begins.rank(start)
    to_a, to_b = begins.rank(a), begins.rank(b)
    form = np.where((stop == start) | (h[:, 2] % 100 >= rate), "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    return {"n": n, "form": form, "a": a - start, "b": b - start, "prefix_chars": to_a - zero, "middle_chars": to_b - to_a}


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` was given, from its output and form."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    one, rest = output.split(s if form == "psm" else p, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one[len(p) :], two) if form == "psm" else (two, one[len(s) :])
    return prefix + middle + suffix


def _outputs(ids: list[int | None], texts: pa.Array, **settings) -> Iterator[tuple]:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each text."""
    planned = plan(ids, texts, **settings)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    columns = [planned[k].tolist() for k in ("n", "form", "a", "b", "prefix_chars", "middle_chars")]
    for i, (d, n, form, a, b, n_prefix, n_middle) in enumerate(zip(ids, *columns)):
        text = texts[i].as_buffer().to_pybytes()
        if form == "plain" or p in text or s in text or m in text:
            yield d, n, "plain", None, None, text
            continue
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        out = p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle
        yield d, n, form, n_prefix, n_middle, out


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text."""
    edge = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + SLICE_BYTES, "right")) - 1)
        yield at, to
        at = to


def _mapped(docs: DataFrame, row, schema: str, **settings) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for a, b in _slices(texts):
                rows = [row(*r) for r in _outputs(batch.column(0).slice(a, b - a).to_pylist(), texts.slice(a, b - a), **settings)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return doc_text(docs).mapInArrow(run, schema)


def transform(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SPM, unit_end: str = "\n") -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut into ``n`` units that end with ``unit_end`` (one byte) or with the text.  Two unit boundaries, drawn by
    a hash of ``seed`` and doc_id, part prefix, middle and suffix.  ``form`` says in which order they are written:
    ``psm``, ``spm``, or ``plain`` for the text as it was (empty texts, texts that hold one of the marks, and what
    ``rate`` leaves out; both numbers of code points are null then).  Null texts are empty.  Rows that repeat a doc_id
    draw alike; rows without doc_id draw as if it were the empty text.  No rows give no rows; other columns are ignored.
    """
    return _mapped(docs, lambda *r: (*r[:5], r[5].decode()), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string",
                   seed=seed, rate=rate, spm=spm, unit_end=ord(unit_end))


def digests(docs: DataFrame) -> DataFrame:
    """As ``transform``, with the sha256 of the output and of the text rebuilt from it in place of the output."""

    def row(d, n, form, a, b, out):
        return d, n, form, a, b, hashlib.sha256(out).hexdigest(), hashlib.sha256(restore(out, form)).hexdigest()

    return _mapped(docs, row, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS h4 FROM d
), p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS x, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS y, array_to_string(u[greatest(a, b) + 1:], '') AS z,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
