import hashlib
import struct
import zlib

import numpy as np
from techtrail.llm import telephony as t


def test_g711_tables():
    assert len(set(t.mulaw_table().tolist())) == 255  # two zeros
    assert t.MULAW_PCM[0xFF] == 0 and t.MULAW_PCM[0x00] == -32124 and t.MULAW_PCM[0x80] == 32124
    assert t.ALAW_PCM[0xD5] == 8 and t.ALAW_PCM[0x55] == -8 and t.ALAW_PCM[0xAA] == 32256 and t.ALAW_PCM[0x2A] == -32256


def plain_adpcm(block):
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = t.STEPS[index]
            change = step >> 3
            change += step if nibble & 4 else 0
            change += step >> 1 if nibble & 2 else 0
            change += step >> 2 if nibble & 1 else 0
            value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
            index = max(0, min(88, index + t.INDEX_CHANGE[nibble & 7]))
            out.append(value)
    return out


def test_adpcm_matches_a_plain_decoder():
    blocks = np.random.default_rng(1).integers(0, 256, (7, 40), dtype=np.uint8)
    assert t.decode_adpcm(blocks).tolist() == [plain_adpcm(bytes(x)) for x in blocks]


def test_wav_round_trip():
    for data in (b"", b"a", b"abcd"):
        assert t.read_wav(t.write_wav(t.MULAW, 8000, 8, 1, data)) == (t.MULAW, 8000, 1, data)
    assert t.read_wav(b"RIFFxxxx") is None and t.read_wav(b"") is None


def test_resampling_keeps_samples():
    pcm = np.array([0, 100, -100, 30000], np.int16)
    double = t.resample_double(pcm)
    assert double[::2].tolist() == pcm.tolist() and len(double) == 8
    assert len(t.resample_double(pcm[:0])) == 0 and t.resample_double(pcm[:1]).tolist() == [0, 0]
    assert t.resample_double(np.full(5, 700, np.int16)).tolist() == [700] * 10


def test_stored_and_read_back(spark, tmp_path):
    texts = ["", None, "a", "x" * 576, "x" * 577, "é" * 400, "x" * 576]
    frame = spark.createDataFrame([(i, x, "clash", 5) for i, x in enumerate(texts)], "doc_id long, text string, media string, feature int")
    frame.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in t.op1_telephony_media(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(t.write_wav(t.MULAW, 8000, 8, 1, payload)).hexdigest()
        assert r["pcm_bytes"] == 46 + 4 * len(payload)
    assert rows[3]["feature"] == rows[6]["feature"] and rows[0]["feature"] == rows[1]["feature"]


def test_chained_steps_and_bad_files(spark):
    frame = spark.createDataFrame([(1, b"\x00\xff" * 300), (2, None)], "doc_id long, payload binary")
    rows = t.read_telephony(t.store_mulaw(frame)).orderBy("doc_id").collect()
    assert bytes(rows[0]["payload"]) == b"\x00\xff" * 300 and bytes(rows[1]["payload"]) == b""
    bad = t.read_telephony(spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")).collect()
    assert all(r["payload"] is None and r["feature"] is None for r in bad)
    assert t.store_and_read(frame.where("false")).count() == 0
