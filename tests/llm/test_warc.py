import hashlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.common import Scratch
from tidemark.session import fresh_path

from . import frames


def pages(spark):
    rows = [(i, f"http://h{i}.net/é", f"<p>page {i}</p>" * (i % 40)) for i in range(60)]
    rows += [(100 + i, None, "<b>same</b>" * 30) for i in range(50)] + [(200, "", None), (201, "x\r\ny", ""), (202, "u", "ü" * 400_000)]
    rows += [(7, "http://again/", "<b>same</b>" * 30), (None, "n", "<b>same</b>" * 30), (None, "n", "own " * 50)]
    return rows, frames.clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))


def test_round_trip(spark):
    rows, df = pages(spark)
    got = [tuple(r) for r in warc.archive(df, Scratch(spark, "t")).drop("bundle", "frame", "offset").collect()]
    first, want = {}, []
    for i, (page, _, html) in enumerate(rows):
        key = (page is None, page or 0, i)
        if len((html or "").encode()) >= 100 and (html not in first or key < first[html]):
            first[html] = key
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        again = html in first and first[html][2] != i
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", rows[first[html][2]][0] if again else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_index_points_at_records(spark):
    rows, df = pages(spark)
    folder = fresh_path(spark, "warc")
    numbered, index = warc.write_archives(df, Scratch(spark, "t"), folder)
    store, _ = warc.open_store(folder)
    sample = index.join(numbered, "rid").where(F.col("id").isin(5, 39, 202)).collect()
    assert len(sample) == 3
    for r in sample:
        with store.open_input_file(r.bundle) as source:
            headers, payload = warc.BundleReader(source).record(r.frame, r.offset)
        assert payload == (rows[[x[0] for x in rows].index(r.id)][2]).encode()
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.rid}>"


def test_reading_is_spread_over_tasks(spark):
    """As many tasks have rows as there are slices, up to the number wanted by the bytes."""
    rng = random.Random(2)
    rows = [(i, f"http://h{i}.net/", "".join(rng.choice("abcdefgh<>") for _ in range(120_000))) for i in range(160)]
    folder, scratch = fresh_path(spark, "warc"), Scratch(spark, "t")
    _, index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), scratch, folder)
    for task_bytes, tasks in ((1 << 40, 8), (1_000_000, 20)):
        back = warc.read_archives(spark, index, folder, task_bytes)
        by_task = [r["n"] for r in back.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        slices = index.select("bundle", F.floor(F.col("frame") / 8)).distinct().count()
        assert back.rdd.getNumPartitions() == tasks and sum(by_task) == 160
        assert len(by_task) >= 0.4 * min(tasks, slices) and len(by_task) > 3


def test_a_bundle_rolls_over(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 5000)
    rng = random.Random(3)
    rows = [(i, "u", "".join(rng.choice("abcdefgh<>") for _ in range(30_000))) for i in range(60)]
    batch = pa.RecordBatch.from_pylist([
        {"rid": i, "url": u, "html": h, "digest": hashlib.sha256(h.encode()).hexdigest(), "first": None} for i, u, h in rows])
    folder = fresh_path(spark, "warc").removeprefix("file:")
    index = [r for b in warc._writer(folder)([batch]) for r in b.to_pylist()]
    assert len({r["bundle"] for r in index}) > 3
    store, _ = warc.open_store(folder)
    for r in index:
        with store.open_input_file(r["bundle"]) as source:
            assert warc.BundleReader(source).record(r["frame"], r["offset"])[1].decode() == rows[r["rid"]][2]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(df, Scratch(spark, "t")).count() == 0


class Kept(io.BytesIO):
    def close(self):
        pass

    def size(self):
        return len(self.getvalue())


def test_bundle_is_plain_zstandard_with_a_seek_table():
    import zstandard

    out = Kept()
    bundle = warc.BundleWriter(out)
    data = [bytes([i]) * (1 << 17) for i in range(5)] + [b"", b"z" * (1 << 20)]
    places = [bundle.add(x) for x in data]
    bundle.close()
    reader = warc.BundleReader(out)
    for x, (frame, offset, size) in zip(data, places, strict=True):
        assert reader.frame(frame)[offset:offset + size] == x
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(data)
    with pytest.raises(ValueError):
        warc.BundleReader(Kept(b"x" * 50))
