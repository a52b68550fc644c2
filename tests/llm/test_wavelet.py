from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rivetwatch.llm import wavelet
from rivetwatch.llm.wavelet import WaveletMatrix, build, read_shards, token_shards, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,top", [(0, 9), (1, 1), (1, 50257), (1500, 2), (3000, 40), (2000, 50257), (700, 200_000)])
def test_access_rank_select_against_arrays(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n).astype(np.uint32)
    w = WaveletMatrix(build(ids, np.array([3, 9]), np.array([n // 2, n - n // 2])))
    assert (w.all_ids() == ids).all()
    assert [x.tolist() for x in w.documents()] == [[3, 9], [n // 2, n - n // 2]]
    for i in rng.integers(0, n, 40).tolist() if n else []:
        t = int(ids[i])
        places = np.flatnonzero(ids == t)
        k = int(np.searchsorted(places, i))
        assert w.access(i) == t and w.rank(t, i) == k and w.select(t, k) == i and w.count(t) == len(places)
    assert w.count(top + 70_000) == 0
    with pytest.raises(IndexError):
        w.access(n)
    with pytest.raises(IndexError):
        w.select(0, int((ids == 0).sum()))


def expected(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_frame_with_odd_rows(spark):
    rows = [(5, "one two"), (-3, None), (7, ""), (7, ""), (900, "word " * 9000), (None, "no id"), (6, "it's <|endoftext|> ½ \n\n x")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, start int, shard int")
    got = [tuple(r) for r in token_shards(df, PATH).collect()]
    assert sorted(got, key=lambda r: (r[1], r[2])) == expected(rows)
    assert token_shards(df.limit(0), PATH).collect() == []


def test_segments_split_and_reread(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = str(tmp_path / "shards")
    write_shards(docs, PATH, path, shards=3)
    got = sorted((tuple(r) for r in read_shards(spark, path).collect()), key=lambda r: r[0])
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    files = spark.read.parquet(path).orderBy("shard", "before").collect()
    ids = np.concatenate([WaveletMatrix(r.blob).all_ids() for r in files])
    assert len(ids) == sum(r[2] for r in got) and max(r.n_ids for r in files) <= wavelet.SEGMENT
