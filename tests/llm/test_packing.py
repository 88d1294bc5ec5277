import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glossgraph.llm import packing
from glossgraph.llm.queries import op6_best_fit_packing

TEXTS = [None, "", "  \n", "Don't I'LL 12,5 <|endoftext|>a<|startoftext|> b", "İstanbul ΑΣ ΑΣ. é́ Å x y\tz\x1cq ﬁ", "The---end... {x}_y~!! 'tis o'clock", "ÀÉÞß ÿ÷×", "a\u0085b c d", "日本語テキスト 😀😀", "aé" * 3000]


def test_ids_are_the_tokenizers():
    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    got = packing.token_ids(pa.array(TEXTS, pa.string()), path)
    for text, ids in zip(TEXTS, got, strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_of_the_table(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    path = packing.tokenizer_path()
    want = Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)
    assert all(g.tolist() == w.ids + [1] for g, w in zip(packing.token_ids(pa.array(rows), path), want, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once_and_fit(seed):
    rng = random.Random(seed)
    histogram = Counter(min(4096, max(1, int(rng.lognormvariate(6.5, 1.2)))) for _ in range(rng.choice([1, 5, 300, 20000])))
    planned = packing.plan(histogram)
    used = Counter()
    for way, times in planned:
        assert sum(way) <= packing.SEQUENCE and times > 0
        for n in way:
            used[n] += times
    assert used == histogram
    total, sequences = sum(n * c for n, c in histogram.items()), sum(c for _, c in planned)
    if len(histogram) > 1000:
        assert sequences <= 1.002 * -(-total // packing.SEQUENCE) + 1
    assert packing.plan({}) == [] and packing.plan({4096: 3}) == [((4096,), 3)]


def test_nnls_finds_the_only_answer_and_stays_positive():
    a = np.array([[1.0, 0, 2], [0, 1, 1], [0, 0, 3]])
    assert np.allclose(packing.nnls(a, np.array([7.0, 3, 3])), [5, 2, 1])
    assert (packing.nnls(a, np.array([-1.0, 5, -2])) >= 0).all()


def check(rows, texts):
    """Pieces cover their documents, sequences have no gaps and no overlaps."""
    tokens = {d: ids for d, ids in zip(texts, packing.token_ids(pa.array(list(texts.values()), pa.string()), packing.tokenizer_path()), strict=True)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        part = tokens[r.doc_id][r.start : r.start + r.length].astype("<u4")
        assert len(part) == r.length <= 4096 and zlib.crc32(part.tobytes()) == r.ids_crc32
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(tokens[d])
        assert [r.start for r in pieces] == [4096 * k for k in range(len(pieces))]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist() and sum(r.length for r in pieces) <= 4096
    assert by_doc.keys() == texts.keys()
    return len(by_sequence)


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op6_best_fit_packing(spark, folder).collect()
    total = sum(r.length for r in rows)
    assert check(rows, texts) <= -(-total // 4096) + 2


def test_nulls_long_texts_and_empty_tables(spark):
    texts = dict(enumerate(TEXTS))
    df = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, length string")
    check(packing.pack(packing.cut(packing.pieces(df, packing.tokenizer_path()))).collect(), texts)
    assert packing.pack(packing.pieces(df.limit(0), packing.tokenizer_path())).count() == 0
