import hashlib
import io
import wave
import zlib

import numpy as np

from glossgraph.llm import media
from glossgraph.llm.queries import op7_media_columns


def test_round_trip_is_lossless():
    for text in [None, "", "a", "é" * 1000, "x" * 64, "y" * 65, "z" * 300000]:
        raw = media.payload(text)
        assert len(raw) % 64 == 0 and raw and raw.startswith((text or "").encode())
        assert media.from_wav(media.to_wav(raw)) == raw


def test_query_reads_back_what_it_stored(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op7_media_columns(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = media.payload(texts[r.doc_id])
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setparams((1, 1, media.RATE, 0, "NONE", None))
            f.writeframes(raw)
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(raw))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-64:])
        times, hashes = media.features(out.getvalue())[3:]
        assert (r.times, r.hashes) == (times.tolist(), hashes.tolist())
        assert r.media_bytes == len(out.getvalue()) and r.media_sha256 == hashlib.sha256(out.getvalue()).hexdigest()
    same = {}
    for r in rows:
        same.setdefault(texts[r.doc_id], set()).add(r.feature)
    assert all(len(x) == 1 for x in same.values())


def test_peaks_of_tones_and_silence():
    t = np.arange(4000)
    tone = lambda k: 50 * np.sin(2 * np.pi * k * t / media.FRAME)
    at, bins = media.spectrum_peaks((tone(10) + tone(30)).astype(np.float32))
    assert {10, 30} <= set(bins.tolist())
    times, hashes = media.peak_pairs(at, bins)
    assert len(times) == len(hashes) > 0 and (np.diff(times) >= 0).all() and (hashes & 15 <= media.REACH).all()
    at, bins = media.spectrum_peaks(np.zeros(500, dtype=np.float32))
    assert len(at) == 0 and len(media.peak_pairs(at, bins)[0]) == 0


def test_pairs_match_a_plain_loop():
    at, bins = media.spectrum_peaks(np.random.default_rng(2).normal(0, 40, 5000).astype(np.float32))
    want = []
    for i in range(len(at)):
        later = [j for j in range(i + 1, len(at)) if 0 < at[j] - at[i] <= media.REACH and j - i < media.FAN * media.PEAKS + media.PEAKS]
        codes = sorted(int(bins[i]) << 13 | int(bins[j]) << 4 | int(at[j] - at[i]) for j in later)[: media.FAN]
        want += [(int(at[i]), c) for c in codes]
    times, hashes = media.peak_pairs(at, bins)
    assert list(zip(times.tolist(), hashes.tolist(), strict=True)) == want


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "")], "doc_id long, text string").withColumn("media", media.F.lit(3))
    rows = media.with_media(df).withColumn("f", media.media_features(media.F.col("media"))).collect()
    assert len(rows) == 3 and len({r.f.payload_sha256 for r in rows}) == 1
    assert media.with_media(df.limit(0)).withColumn("f", media.media_features(media.F.col("media"))).count() == 0
