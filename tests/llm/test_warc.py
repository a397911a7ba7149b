import hashlib
import io

import pytest
from marginalia.llm import queries, warc


def plain(rows):
    """(page_id, html) -> expected rows, for distinct ids."""
    first = {}
    for page, html in sorted(rows):
        first.setdefault(html or "", page)
    out = set()
    for page, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and first[html or ""] != page
        out.add((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return out


def test_query(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    found = queries.QUERIES["op4_warc"](spark, sf)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert {tuple(r) for r in found.collect()} == plain(rows)


def test_round_trip_rolls_and_is_deterministic(spark, tmp_path):
    rows = [(k, f"http://x/{k}", ("é" if k % 3 else "same ") * (60 + k % 7)) for k in range(500)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    manifests = []
    for name in ("a", "b"):
        manifests.append({tuple(r) for r in warc.write(frame, f"file://{tmp_path}/{name}", file_bytes=2000, shards=3).collect()})
    assert manifests[0] == manifests[1] and len(manifests[0]) > 6
    assert {r[1] for r in manifests[0]} <= {0, 1, 2} and sum(r[2] for r in manifests[0]) == 500
    for file, _, _, size, digest, _, _ in manifests[0]:
        raw = (tmp_path / "a" / file).read_bytes()
        assert len(raw) == size and hashlib.sha256(raw).hexdigest() == digest
    got = warc.read(spark, f"file://{tmp_path}/a", with_payload=True).collect()
    assert {tuple(r)[:1] + tuple(r)[2:6] for r in got} == plain([(k, h) for k, _, h in rows])
    html = {k: h for k, _, h in rows}
    assert all(r.payload.decode() == html[r.page_id] for r in got if r.record_type == "response")
    assert all(r.url == f"http://x/{r.page_id}" for r in got)


@pytest.mark.parametrize("ids", [list(range(1000)), [k * k * k for k in range(500)], [5] * 300 + [-(1 << 63), (1 << 63) - 1], [7]])
def test_shards_hold_even_parts(spark, ids):
    frame = spark.createDataFrame([(i, 1) for i in ids], "pid long, size long")
    starts = warc.edges(frame, 4, width=16)
    counts = [r["count"] for r in frame.groupBy(warc.place(spark, starts)("pid").alias("s")).count().collect()]
    assert sum(counts) == len(ids) and starts.tolist() == sorted(set(starts.tolist()))
    if len(set(ids)) == len(ids) > 100:
        assert len(counts) == 4 and max(counts) < len(ids) * 0.3


def test_shards_hold_even_bytes(spark):
    frame = spark.createDataFrame([(i, 1000 if i < 50 else 1) for i in range(1000)], "pid long, size long")
    starts = warc.edges(frame, 5, width=512).tolist()
    assert len(starts) == 4 and all(abs(a - b) <= 2 for a, b in zip(starts, (10, 20, 30, 40)))


def test_query_sees_several_files_a_shard(spark, monkeypatch):
    """Files roll by compressed size within a shard, and the query's rows are the same."""
    sf, whole = "/root/testdata/sf0.01", warc.write
    listed = []

    def small(pages, folder, **options):
        listed.append(whole(pages, folder, file_bytes=40_000, shards=2, **options))
        return listed[0]

    plain_rows = sorted(map(tuple, queries.QUERIES["op4_warc"](spark, sf).collect()))
    monkeypatch.setattr(warc, "write", small)
    assert sorted(map(tuple, queries.QUERIES["op4_warc"](spark, sf).collect())) == plain_rows
    files = [r.shard for r in listed[0].collect()]
    assert files.count(0) > 2 and files.count(1) > 2


def test_unlisted_files_are_not_read(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string")
    warc.write(frame, f"file://{tmp_path}/w")
    (tmp_path / "w" / "part-000099-00000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 1


def test_frame_edges(spark):
    big, long = "b" * 100, "c" * 300_000
    rows = [(3, "u", big, 1), (3, "u", big, 1), (2, None, None, 2), (4, "u", "", 3), (None, "u", long, 4), (9, "u", long, 5), (8, "u", "b" * 99, 6), (7, "u", "b" * 99, 7)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    out = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(frame).collect()), key=str)
    assert out == sorted([(3, 100, "response", None), (3, 100, "revisit", 3), (2, 0, "response", None), (4, 0, "response", None), (None, 300_000, "response", None), (9, 300_000, "revisit", None), (8, 99, "response", None), (7, 99, "response", None)], key=str)
    assert warc.archive(frame.limit(0)).count() == 0


def test_broken_file():
    data = warc._member(warc.record("response", 1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "2000-01-01T00:00:00Z"), 6)
    assert [p for _, p in warc.records(io.BytesIO(data * 2))] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9])))


def test_records_of_null_and_repeated_ids(spark, tmp_path):
    """Every record has an id of its own, every revisit refers to a record that is there, no header holds what
    stands for a null, and another session's settings write the same bytes."""
    long = "<p>" + "payload " * 40
    rows = [(None, "u", long), (None, "v", long), (3, "w", long), (3, "w", long), (4, "x", "short"), (4, "x", "short"), (None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = []
    for k, partitions in enumerate(("8", "3")):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        folder = f"file://{tmp_path}/{k}"
        warc.write(frame, folder)
        spark.conf.set("spark.sql.shuffle.partitions", was)
        files.append({p.name: p.read_bytes() for p in (tmp_path / str(k)).glob("*.warc.gz")})
    assert files[0] == files[1] and files[0]
    heads = [h for data in files[0].values() for h, _ in warc.records(io.BytesIO(data))]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(ids) == len(rows)
    assert all(h["warc-refers-to"] in ids for h in heads if h["warc-type"] == "revisit")
    assert sum(h["warc-type"] == "revisit" for h in heads) == 3 and not any("-9223372036854775808" in v for h in heads for v in h.values())
