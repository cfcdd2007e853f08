"""Round trips through tar shards, and headers without payloads."""

import hashlib
import tarfile
import zlib

import pytest

from trellisway.llm import media as M

from .helpers import ODD, frame

P = M.MediaParams()


def plain(text):
    data = (text or "").encode()
    size = max(P.width, -(-len(data) // P.width) * P.width)
    return data, data + b"\xff" * (size - len(data))


def check(found, texts):
    by_text = {}
    for r in found:
        data, payload = plain(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.width, r.height, r.depth) == (P.width, len(payload) // P.width, 8)
        own = (r.media_bytes, r.media_sha256, r.feature, r.shard, r.offset)
        assert by_text.setdefault(texts[r.doc_id] or "", own) == own


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = M.op10_media(spark, sf_dir).collect()
    assert len(found) == len(texts)
    check(found, texts)
    assert sorted(map(tuple, M.op10_media(spark, sf_dir).collect())) == sorted(map(tuple, found))


def test_odd_rows_and_shards(spark, tmp_path):
    rows = [r for r in ODD if r[0] is not None]
    params = M.MediaParams(shard_bytes=4096)
    index = M.store(frame(spark, rows).repartition(2), params, f"file://{tmp_path}/media")
    check(M.read_features(M.with_headers(index)).collect(), dict(rows))
    for shard in {r.shard for r in index.collect()}:  # they are tar files whose members are named by their digest
        with tarfile.open(shard.removeprefix("file://")) as tar:
            for member in tar:
                assert hashlib.sha256(tar.extractfile(member).read()).hexdigest() == member.name.removesuffix(".png")
    assert index.select("digest", "shard", "offset").distinct().count() == index.select("digest").distinct().count()
    (tmp_path / "media/lost.tar").write_bytes(b"")
    assert M.remove_orphans(index, f"file://{tmp_path}/media") == 1
    check(M.read_features(M.with_headers(index)).collect(), dict(rows))


def test_damage_is_seen(spark, tmp_path):
    index = M.store(frame(spark, [(1, "some text")]), P, f"file://{tmp_path}/media")
    place = index.collect()[0]
    path = place.shard.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[place.offset + 60] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged|incorrect|doesn't hold|Error"):
        M.read_features(M.with_headers(index)).collect()


def test_null_id_and_empty_table(spark):
    assert M.read_features(M.store(frame(spark, [(None, "x")]))).collect()[0].doc_id is None
    assert M.read_features(M.with_headers(M.store(frame(spark, [])))).count() == 0
