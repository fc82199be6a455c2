import hashlib
import zlib

import numpy as np

from siftlode.llm import audio


def test_payload_round_trip():
    for text in (None, "", "a", "x" * 192, "ß" * 97, "long " * 5000):
        payload, n = audio.payload_of(text)
        raw = (text or "").encode()
        assert n == len(raw) and len(payload) % 192 == 0 and payload and payload == raw.ljust(len(payload), b" ") and len(payload) - n < 192 + (not n)
        assert audio.from_wav(audio.to_wav(payload)) == (payload, audio.STORED_HZ)


def test_resampling_keeps_a_tone_and_blocks_do_not_matter(monkeypatch):
    t = np.arange(24_000) / 24_000
    x = np.sin(2 * np.pi * 1000 * t).astype(np.float32)
    y = audio.resample(x, 24_000, 16_000)
    assert len(y) == 16_000 and np.argmax(np.abs(np.fft.rfft(y))) == 1000 and abs(np.abs(y[2000:-2000]).max() - 1) < 0.02
    monkeypatch.setattr(audio, "BLOCK", 64)
    assert np.allclose(audio.resample(x, 24_000, 16_000), y, atol=1e-6)


def test_hysteresis_bridges_small_dips():
    db = np.array([0, 0, 10, 6, 10, 0, 0, 10, 0], float)
    assert audio.segments(db) == [(2, 5), (7, 8)]
    assert audio.segments(np.zeros(4)) == [(0, 4)]


def test_columns(spark):
    rows = [(1, "some text " * 300, "x"), (2, None, "y"), (3, "", "y"), (4, "some text " * 300, None)]
    got = {r.doc_id: r for r in audio.media_columns(spark.createDataFrame(rows, "doc_id long, text string, media string")).collect()}
    for i, text, _ in rows:
        payload, n = audio.payload_of(text)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        table = audio.from_ipc(bytes(r.features))
        assert table.num_rows == r.n_tensors > 0 and table.schema.field("log_mel").type.shape == list(audio.SHAPE)
        assert all(a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
    assert got[1].features == got[4].features and got[2].media == got[3].media


def test_a_quiet_run_does_not_silence_the_rest():
    db = np.r_[np.zeros(60), -100.0, np.zeros(39)]
    assert audio.segments(db) == [(0, 60), (61, 100)]
    rng = np.random.default_rng(4)
    prose = lambda: " ".join("".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000))
    for c in "xz~":
        payload, _ = audio.payload_of(prose() + c * 1500 + prose())
        starts = audio.tensors(payload, audio.STORED_HZ).column("start_s").to_numpy()
        assert (starts < 0.6).any() and (starts > 0.9).any()


def plain_log_mel(x, hz):
    """By the definition of the transform, one frame at a time."""
    n, bins = np.arange(audio.FRAME), np.arange(audio.FFT // 2 + 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * (n + 1) / (audio.FRAME + 1))
    wave = np.exp(-2j * np.pi * np.outer(bins, n) / audio.FFT)
    top = 2595 * np.log10(1 + hz / 2 / 700)
    edge = [700 * (10 ** (top * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    out = []
    for at in range(0, max(1, -(-(len(x) - audio.FRAME) // audio.HOP) + 1) * audio.HOP, audio.HOP):
        f = np.zeros(audio.FRAME)
        f[: len(x[at : at + audio.FRAME])] = x[at : at + audio.FRAME]
        power = np.abs(wave @ (f * window)) ** 2
        row = []
        for lo, mid, hi in zip(edge, edge[1:], edge[2:]):
            row.append(sum(p * max(0, min((b * hz / audio.FFT - lo) / (mid - lo), (hi - b * hz / audio.FFT) / (hi - mid))) for b, p in zip(bins, power)))
        out.append(np.log(np.array(row) + 1e-6))
    return np.array(out)


def test_log_mel_against_the_definition():
    rng = np.random.default_rng(2)
    for n in (1, 128, 399, 400, 401, 560, 561, 1000):
        x = rng.normal(0, 0.3, n).astype(np.float32)
        mel, db = audio.log_mel(x, 16_000)
        want = plain_log_mel(x, 16_000)
        assert mel.shape == want.shape and np.allclose(mel, want, atol=2e-3) and len(db) == len(want)


def test_every_byte_of_a_text_is_in_a_frame():
    rng = np.random.default_rng(7)
    for n in (192, 768, 960, 1920, 3840):
        base = rng.integers(33, 127, n).astype(np.uint8)
        whole = audio.log_mel(audio.resample((base.astype(np.float32) - 128) / 128, 24_000, 16_000), 16_000)[0]
        for at in (*range(0, n, 37), *range(n - 20, n)):
            other = base.copy()
            other[at] ^= 0x60
            mel = audio.log_mel(audio.resample((other.astype(np.float32) - 128) / 128, 24_000, 16_000), 16_000)[0]
            assert not np.array_equal(mel, whole), (n, at)


def plain_resample(x, up, down, taps=12):
    """Output m is the sum over the input of the prototype filter at m * down - n * up from its centre."""
    n = taps * up
    at = (np.arange(n) - (n - 1) / 2) / max(up, down)
    proto = np.sinc(at) * np.kaiser(n, 7.0)
    proto *= up / proto.sum()
    out = []
    for m in range(-(-len(x) * up // down)):
        places = ((k, m * down + taps // 2 * up - k * up) for k in range(len(x)))
        out.append(sum(x[k] * proto[i] for k, i in places if 0 <= i < n))
    return np.array(out)


def plain_segments(db, spread=0.5):
    """A walk with two levels."""
    if db.std() < 1e-3:
        return [(0, len(db))]
    level = min(db.mean() + spread * db.std(), max(db.mean(), np.percentile(db, 90)), db.max())
    found, since = [], None
    for i, v in enumerate(db):
        if since is None and v >= level:
            since = i
        elif since is not None and v < db.mean() - spread * db.std():
            found.append((since, i))
            since = None
    return [*found, (since, len(db))] if since is not None else found


def test_resampling_segments_and_tensors_against_plain_forms():
    rng = np.random.default_rng(9)
    for n in (192, 384, 1920):
        x = rng.normal(0, 0.3, n).astype(np.float32)
        assert np.allclose(audio.resample(x, 24_000, 16_000), plain_resample(x, 2, 3), atol=1e-5)
    text = "".join(rng.choice(list("etaoin shrdlu,.ÄÖ\n~|"), 9000))
    payload, _ = audio.payload_of(text)
    t = audio.tensors(payload, audio.STORED_HZ)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel, db = audio.log_mel(audio.resample(x, 24_000, 16_000), 16_000)
    marked = np.zeros(len(db), bool)
    for lo, hi in plain_segments(db.astype(float)):
        marked[lo:hi] = True
    cells, at = t.column("log_mel").storage.flatten().to_numpy().reshape(-1, *audio.SHAPE), 0
    for i, row in enumerate(t.drop_columns(["log_mel"]).to_pylist()):
        lo = round(row["start_s"] * 100)
        hi = round((row["end_s"] * 16_000 - audio.FRAME) / audio.HOP) + 1
        assert lo == at and 0 < hi - lo <= audio.SHAPE[0] and set(marked[lo:hi].tolist()) == {row["active"]}
        assert np.array_equal(cells[i][: hi - lo], mel[lo:hi]) and np.allclose(cells[i][hi - lo :], np.log(1e-6))
        at = hi
    assert at == len(db) and 0 < marked.mean() < 1
    for _ in range(50):
        db = rng.normal(0, 5, rng.integers(1, 60))
        assert audio.segments(db) == plain_segments(db)


def test_quiet_parts_are_kept_and_marked():
    loud = bytes(np.random.default_rng(1).integers(0, 256, 4800).astype(np.uint8))
    t = audio.tensors(loud + b"\x80" * 4800, 24_000)
    active = np.array(t["active"].to_pylist())
    assert active[0] and not active[-1] and max(t["end_s"].to_pylist()) >= 0.4 and min(t["start_s"].to_pylist()) == 0


def test_any_changed_byte_of_a_document_changes_its_features(spark):
    rng = np.random.default_rng(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 200").collect()
    same = looked = 0
    for r in docs:
        payload, n = audio.payload_of(r.text)
        base = audio.to_ipc(audio.tensors(payload, audio.STORED_HZ))
        for at in rng.integers(0, max(n, 1), 4):
            other = bytearray(payload)
            other[at] ^= 1  # the least change that there is
            same += audio.to_ipc(audio.tensors(bytes(other), audio.STORED_HZ)) == base
            looked += 1
    assert looked >= 800 and same == 0
