import hashlib
import tracemalloc
import zlib

import numpy as np
from docs import ROWS, empty, frame

from quern.llm import telephony as t


def test_g711_tables():
    mu, a = t.expansion("mulaw"), t.expansion("alaw")
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    for law in ("mulaw", "alaw"):
        table = t.expansion(law)
        assert (table[t.compression(law)[table.view(np.uint16)]] == table).all()


def scalar_ima(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEP[index])
            change = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                change += part if code & bit else 0
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(t.INDEX_STEP[code & 7])))
            out.append(value)
    return out


def test_ima_against_scalar_decoder_and_round_trip():
    blocks = np.random.default_rng(1).integers(0, 256, (7, 40)).astype(np.uint8)
    assert t.decode_ima(blocks).tolist() == [scalar_ima(bytes(b)) for b in blocks]
    wave = (8000 * np.sin(np.arange(3000) / 20)).astype(np.int16)
    rate, back = t.decode(t.write_wav(t.encode_ima(wave).tobytes(), t.IMA, align=256))
    assert rate == 8000 and np.abs(back[:3000].astype(int) - wave).max() < 1500


def test_wav_forms_and_resampling():
    wave = np.arange(-500, 500, dtype=np.int16)
    assert (t.decode(t.write_wav(wave.astype("<i2").tobytes(), t.PCM, bits=16, align=2))[1] == wave).all()
    for bad in (b"", b"RIFF....WAVE"):
        try:
            t.read_wav(bad)
            raise AssertionError
        except ValueError:
            pass
    up = t.resample(wave, 8000, 16000)
    assert len(up) == 2000 and (up[::2] == wave).all()
    assert len(t.resample(wave, 16000, 8000)) == 500


def test_rows(spark):
    got = t.store_texts(frame(spark), keep_media=True, budget=2000).collect()
    assert len(got) == len(ROWS)
    want = {}
    for doc, text, *_ in ROWS:
        raw = (text or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.setdefault(doc, (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    by = {}
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
        assert t.read_wav(bytes(r.media))[3][: r.n_bytes] == {d: (x or "") for d, x, *_ in ROWS}[r.doc_id].encode()
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
        assert len(r.pcm) == 4 * r.payload_bytes
        by[r.doc_id] = r
    assert by[1].feature == by[5].feature and by[2].feature == by[3].feature
    alone = t.store_texts(frame(spark), budget=1 << 30).collect()
    assert sorted((str(r.doc_id), r.feature) for r in alone) == sorted((str(r.doc_id), r.feature) for r in got)
    assert t.store_texts(empty(spark)).count() == 0


def test_slices_give_what_whole_arrays_give():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        data = rnd.integers(0, 256, n * t.UNIT, dtype=np.uint8).tobytes()
        for to in (4000, 8000, 11025, 16000):
            whole, sliced = t.features([data, data], to), t.features([data, data], to, step=2 * t.UNIT)
            assert whole == sliced and whole[0] == whole[1]
    wave = rnd.integers(-9000, 9000, 5000).astype(np.int16)
    parts = list(t.resampled(lambda lo, hi: wave[lo:hi], 5000, 8000, 11025, step=97))
    assert np.array_equal(np.concatenate(parts), t.resample(wave, 8000, 11025))


def test_memory_of_a_long_text():
    tracemalloc.start()
    n, data = t.payload("x" * 20_000_000)
    (text, pcm), *_ = t.features([data], 4000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000_000 and len(pcm) == len(data) // 2 * 2 and peak < 8 * len(data)


def test_query_stores_the_sound(spark, sf_dir):
    for r in t.op1_telephony(spark, sf_dir).limit(20).collect():
        assert len(r.pcm) == r.payload_bytes and r.feature.endswith(f"pcm4000={zlib.crc32(bytes(r.pcm)):08x}")


def plain_double(data):
    """Payload bytes -> 16 kHz samples: each mu-law sample, then the middle of it and the next one (at the end itself)."""
    law = t.expansion("mulaw").tolist()
    wave = [law[b] for b in data]
    return [x for i, at in enumerate(wave) for x in (at, (at + wave[min(i + 1, len(wave) - 1)]) * 4000 // 8000)]


def test_query_resamples_upwards_too(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in t.op1_telephony(spark, sf_dir).limit(20).collect():
        data = t.payload(texts[r.doc_id])[1]
        up = np.frombuffer(bytes(r.pcm16000), dtype="<i2")
        assert up.tolist() == plain_double(data) and (up[::4] == np.frombuffer(bytes(r.pcm), dtype="<i2")).all()
        assert f";pcm16000={zlib.crc32(bytes(r.pcm16000)):08x};" in r.feature
