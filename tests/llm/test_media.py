from __future__ import annotations

import hashlib
import io
import tarfile
import zlib

from pyarrow import fs

from stratalist.llm import media

TEXTS = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "é" * 32, "\x00", "\U0001f642 text\n", "word " * 60_000, "a"]


def test_payloads_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string").repartition(3)
    rows, folder = media.media_columns(docs)
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(TEXTS)
    files, path = fs.FileSystem.from_uri(folder)
    stored = {}
    for info in files.get_file_info(fs.FileSelector(path)):
        raw = files.open_input_file(info.path).read()
        with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
            for m in tar.getmembers():
                stored[info.base_name, m.offset_data] = (m.name, tar.extractfile(m).read())
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        name, kept = stored[r.shard, r.offset]
        assert name == hashlib.sha256(payload).hexdigest() + ".png" and len(kept) == r.length
        assert media.read_png(kept) == payload
        assert (r.n_bytes, r.width * r.height, r.bits) == (len(raw), len(payload), 8)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() == r.digest.hex()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(kept).hexdigest()
    assert got[2].feature == got[10].feature and got[0].feature == got[1].feature
    assert media.manifest(rows).count() == len({r.payload_sha256 for r in got.values()})


def test_empty_table(spark):
    rows, _ = media.media_columns(spark.createDataFrame([], "doc_id long, text string"))
    assert rows.count() == 0
