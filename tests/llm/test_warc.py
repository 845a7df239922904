import hashlib
import io
import random
import struct
import uuid

import pytest
import zstandard

from secspark.llm import warc
from secspark.llm.common import scratch

BIG = "<p>" + "x" * 1200 + "</p>"


@pytest.fixture()
def pages(spark):
    rows = [(1, "http://a/é b", "<b>é</b>"), (2, "http://b", BIG), (3, "http://c", BIG), (9, "u\r\nX: 1", BIG), (4, None, None),
            (5, "http://d", ""), (6, "http://e", "short"), (7, "http://f", "short"), (None, "http://g", BIG), (8, "h", "é" * 600),
            (8, "h", "é" * 600)]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(3)


def test_round_trip(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    out = scratch(spark, "warc-test")
    warc.write_archives(pages, out)
    rows = pages.collect()
    got = warc.read_archives(spark, out).collect()
    assert len(got) == len(rows)
    sizes = {r["page_id"]: (r["html"] or "").encode() for r in rows}
    for r in got:
        data = sizes[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        if r["page_id"] in (2, 3, None):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 9, None)
        else:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, data)
    some = warc.read_archives(spark, out, [9, 6, None]).collect()
    assert sorted((r["page_id"] is None, r["page_id"]) for r in some) == [(False, 6), (False, 9), (True, None)]


def test_uncommitted_bundles_are_ignored_and_frames_are_independent(spark, pages):
    out = scratch(spark, "warc-test")
    warc.write_archives(pages, out)
    folder = out.removeprefix("file:")
    import os
    name = next(n for n in os.listdir(f"{folder}/bundles") if n.endswith(".zst"))
    data = open(f"{folder}/bundles/{name}", "rb").read()
    with open(f"{folder}/bundles/{uuid.uuid4().hex}.warc.zst", "wb") as f:
        f.write(data)
    assert warc.read_archives(spark, out).count() == 11
    bundle = warc.Bundle(io.BytesIO(data))
    assert struct.unpack("<I", data[-4:])[0] == warc.FOOTER_MAGIC
    start, stop = bundle.frames[0]
    assert zstandard.ZstdDecompressor().decompress(data[start:stop]).startswith(b"WARC/1.1\r\n")


class Counting(io.BytesIO):
    """A file that counts the bytes read from it."""
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_only_wanted_frames_are_read(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 20_000)
    rng, out = random.Random(3), io.BytesIO()
    kept, out.close = out, lambda: None
    writer, want = warc.BundleWriter(out), {}
    for i in range(300):
        want[i] = rng.randbytes(rng.randrange(4000))
        writer.add(warc.record_id(i), warc.record_bytes(i, None, want[i], hashlib.sha1(want[i]).hexdigest(), None))
    writer.close()
    data = kept.getvalue()
    for ids in ([], [7], [7, 8, 290], list(want)):
        stream = Counting(data)
        bundle = warc.Bundle(stream)
        tail = stream.taken
        got = [warc.read_record(r) for r in bundle.records({warc.record_id(i) for i in ids})]
        assert {r["page_id"]: r["payload"] for r in got} == {i: want[i] for i in ids}
        frames = {k for name, k, _, _ in bundle.places if warc.page_of(name) in ids}
        assert tail < 0.02 * len(data)
        assert stream.taken - tail == sum(bundle.frames[k][1] - bundle.frames[k][0] for k in frames)


def test_empty_table(spark, pages):
    out = scratch(spark, "warc-test")
    warc.write_archives(pages.filter("false"), out)
    assert warc.read_archives(spark, out).count() == 0


def test_damage_is_found():
    good = warc.record_bytes(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.read_record(good)["payload"] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC/1.1", b"XARC/1.1")):
        with pytest.raises(ValueError):
            warc.read_record(bad)
