from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rivetwatch.llm.bytebpe import PieceCache, Vocabulary, encode_texts
from rivetwatch.llm.transducer import Decoder, Transducer, encode_decode, sufficient_lookahead

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a" * 5000, "ab" * 3000, " " * 3000, "=-" * 2000 + "x", "é" * 1000, "it's we'll 's't ''s I'VE<|endoftext|>'re",
       " \n\n x\t\ty \x1c\x85z  ", "中文 ½Ⅷ٣ 😀😀 ß́", "<|endoftext|><|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocab():
    with open(PATH, encoding="utf-8") as f:
        return Vocabulary(f.read())


def texts():
    rng = random.Random(5)
    parts = [*"abc   '''stmdrevl\n\t 12.,!?é  中文\x1c\x85Ⅷ٣😀ß́", "<|endoftext|>", "ing", " the"]
    return ODD + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]


@pytest.mark.parametrize("block", [1 << 19, 150])
def test_same_ids_as_library_whatever_the_block(vocab, library, block):
    got: list[list[int]] = [[] for _ in texts()]
    for i, ids, _ in encode_texts(texts(), PieceCache(Transducer(vocab).pieces), vocab, block):
        got[i] += ids.tolist()
    want = library.encode_batch(texts(), add_special_tokens=False)
    assert got == [w.ids for w in want]
    assert ["".join([*d.feed(np.array(g, np.uint32)), d.end()]) for g, d in ((g, Decoder(vocab)) for g in got)] == \
        [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_stream_holds_a_bounded_window(vocab, library):
    rng = random.Random(2)
    machine = Transducer(vocab, block=64)
    word = "".join(rng.choices("etaoinshrd", k=20_000))
    out, most = [], 0
    for at in range(0, len(word), 7):
        out += [t for part in machine.feed(word[at : at + 7].encode()) for t in part.tolist()]
        most = max(most, len(machine.pending))
    out += machine.end().tolist()
    assert out == library.encode(word, add_special_tokens=False).ids
    assert most <= sufficient_lookahead(vocab) + 64 + 7


def test_lookahead_rejects_an_unordered_list(vocab):
    class Swapped:
        byte_ids, token_bytes, merges = vocab.byte_ids, vocab.token_bytes, vocab.merges[::-1]

    with pytest.raises(ValueError):
        sufficient_lookahead(Swapped)


def test_broken_bytes_decode_as_in_library(vocab, library):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 9))]
        d = Decoder(vocab)
        parts = [p for i in ids for p in d.feed(np.array([i], np.uint32))]
        assert "".join([*parts, d.end()]) == library.decode(ids, skip_special_tokens=False)


def test_frame(spark, library):
    rows = [(1, "hello  world"), (2, None), (3, ""), (1, "hello  world"), (None, "x" * 90_000), (4, "a <|endoftext|>\n")]
    df = spark.createDataFrame([(d, t, 7, "z") for d, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = sorted(map(tuple, encode_decode(df, PATH).collect()), key=str)

    def want(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    assert got == sorted((want(*r) for r in rows), key=str)
    assert encode_decode(df.limit(0), PATH).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [32, 64, 256, 1024, 2048, 4096])
def test_words_whose_hashes_collide(vocab, library, n):
    # These two have the same polynomial hash modulo 2^64 from 1,024 letters on, whatever the (odd) multiplier.
    own = [thue_morse(n), thue_morse(n, "b", "a"), f"x {thue_morse(n)} {thue_morse(n, 'b', 'a')}"]
    got: list[list[int]] = [[] for _ in own]
    for i, ids, _ in encode_texts(own, PieceCache(Transducer(vocab).pieces), vocab):
        got[i] += ids.tolist()
    assert got == [w.ids for w in library.encode_batch(own, add_special_tokens=False)]


def test_a_key_held_by_another_piece(vocab, library, monkeypatch):
    # All keys of equal length collide: only the comparison of letters tells pieces apart.
    from rivetwatch.llm import bytebpe

    monkeypatch.setattr(bytebpe, "mix", lambda x: np.full(len(x), 7, np.uint64))
    got: list[list[int]] = [[] for _ in texts()[:200]]
    for i, ids, _ in encode_texts(texts()[:200], PieceCache(Transducer(vocab).pieces), vocab, 500):
        got[i] += ids.tolist()
    assert got == [w.ids for w in library.encode_batch(texts()[:200], add_special_tokens=False)]


@pytest.mark.parametrize("text", ["ab\n" * 60_000, "中文。" * 60_000, "a1" * 60_000, "it's\t'll''re" * 9_000, "ab<|endoftext|>" * 20_000, "x" * 100_000])
def test_long_texts_are_cut_at_sure_boundaries(vocab, library, text):
    seen = []

    class Watched(PieceCache):
        def encode(self, text, at):
            seen.append(len(text))
            return super().encode(text, at)

    got = []
    for _, ids, _ in encode_texts([text], Watched(Transducer(vocab).pieces), vocab, 1 << 12):
        got += ids.tolist()
    assert got == library.encode(text, add_special_tokens=False).ids
    assert max(seen) <= 1 << 13 or "x" * 9 in text


def test_cache_forgets_and_goes_on(vocab, library):
    cache = PieceCache(Transducer(vocab).pieces, most=50)
    got: list[list[int]] = [[] for _ in texts()]
    for i, ids, _ in encode_texts(texts(), cache, vocab, 300):
        got[i] += ids.tolist()
    assert got == [w.ids for w in library.encode_batch(texts(), add_special_tokens=False)]
    assert cache.held <= 600
