import hashlib
import math
import zipfile
import zlib
from io import BytesIO

import pyarrow.fs as pafs
import pytest

from aerolith.llm import media, queries
from tests.conftest import SF


def texts_of(rows):
    return sorted((-1 if i is None else i, (t or "").encode()) for i, t in rows)


def test_round_trip(make_docs, odd_rows):
    got = media.media_digest(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    want = sorted((i, len(b), len(media.padded(b)), hashlib.sha256(media.padded(b)).hexdigest(), zlib.crc32(media.padded(b)[-64:])) for i, b in texts_of(odd_rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    stored = {hashlib.sha256(m).hexdigest(): len(m) for m in (media.png(media.padded(b)) for _, b in texts_of(odd_rows))}
    assert all(stored[r.media_sha256] == r.media_bytes for r in got)


def test_empty(make_docs):
    assert media.media_digest(make_docs([])).count() == 0


def test_every_member_is_read_once_whatever_the_split(spark, make_docs):
    manifest = media.store(make_docs([(i, f"text {i} " * i) for i in range(300)]))
    for split in (64, 1000, 1 << 30):
        rows = media.read_media(spark, manifest, split).collect()
        assert sorted(r.doc_id for r in rows) == list(range(300))
        assert all(media.samples(bytes(r.media)).rstrip(b"\0") == f"text {r.doc_id} ".encode() * r.doc_id for r in rows)


def test_damaged_member_is_retried_alone(tmp_path):
    buffer = BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("0_1_3.png", media.png(media.padded(b"abc")))
        z.writestr("1_2_3.png", media.png(media.padded(b"xyz")))
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())

    def handle(fs):
        h = media.Handle(f"file://{tmp_path}/a.zip")
        h.fs = fs
        return h

    class Flaky:
        """The first file can't be opened, the second one's first read stops after ``short`` bytes."""

        def __init__(self, short):
            self.fs, self.opened, self.short = pafs.LocalFileSystem(), 0, short

        def open_input_file(self, path):
            self.opened += 1
            if self.opened == 1:
                raise OSError("gone")
            f = self.fs.open_input_file(path)
            return Short(f, self.short) if self.opened == 2 else f

    class Short:
        def __init__(self, file, n):
            self.file, self.n, self.seek, self.close = file, n, file.seek, file.close

        def read(self, n):
            return self.file.read(min(n, self.n))

    infos = zipfile.ZipFile(tmp_path / "a.zip").infolist()
    for short in (0, 3, 20, 29, 35):
        fs = Flaky(short)
        assert media.samples(media.ArchiveReader._member(handle(fs), infos[1]))[:3] == b"xyz"
        assert fs.opened == 3
    data = bytearray(buffer.getvalue())
    data[infos[0].header_offset + 60] ^= 1
    (tmp_path / "a.zip").write_bytes(data)
    with pytest.raises(OSError, match="offset 0"):
        media.ArchiveReader._member(handle(pafs.LocalFileSystem()), infos[0])


def test_partitions_are_bounded(spark, make_docs, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE_BYTES", 2000)
    manifest = media.store(make_docs([(i, f"text {i} " * (i % 40)) for i in range(400)]))
    for most in (1, 3, 10, 50_000):
        monkeypatch.setattr(media, "PARTITIONS", most)
        parts = media.ArchiveReader({"manifest": manifest, "splitbytes": "500"}).partitions()
        files = {p.manifest for p in parts}
        assert len(parts) <= most + len(files)
        reader = media.ArchiveReader({"manifest": manifest})
        assert sorted(i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()) == list(range(400))


def test_features_of_known_payloads():
    """Constant, two values in turn, and all bytes once: mean, deviation, entropy and changes by hand."""
    assert media.feature(b"\x05" * 128) == "mean=5.0000;sd=0.0000;entropy=0.0000;changes=0.0000"
    assert media.feature(b"\x00\x02" * 64) == "mean=1.0000;sd=1.0000;entropy=1.0000;changes=1.0000"
    assert media.feature(bytes(range(256))) == f"mean=127.5000;sd={math.sqrt((256**2 - 1) / 12):.4f};entropy=8.0000;changes=1.0000"


def test_query_on_documents(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op10_media_columns(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        payload = media.padded(texts[r.doc_id])
        counts = [payload.count(v) for v in set(payload)]
        mean = sum(payload) / len(payload)
        sd = math.sqrt(sum((v - mean) ** 2 for v in payload) / len(payload))
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in counts)
        changes = sum(a != b for a, b in zip(payload, payload[1:], strict=False)) / (len(payload) - 1)
        want = [mean, sd, entropy, changes]
        assert all(abs(float(part.split("=")[1]) - w) <= 1.01e-4 for part, w in zip(r.feature.split(";"), want, strict=True))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.n_bytes == len(texts[r.doc_id])


def test_damaged_media_is_noticed():
    good = media.png(media.padded(b"abc"))
    for at in (0, 20, len(good) - 20):
        with pytest.raises(ValueError):
            media.samples(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
