import gzip
import hashlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F
from techtrail.llm import warc_archive as w

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, id string, payload string, digest int, path string"
LONG = "x" * 999 + "é"
ROWS = [
    (1, "http://a/ b\r\nX: 1", LONG), (2, "http://a/é", LONG), (5, None, LONG), (5, None, LONG), (None, "u", LONG),
    (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "x" * 1000), (9, "u", "x" * 1000), (10, "u", None), (11, "u", ""),
    (None, None, "only" * 400), (None, None, "only" * 400), (12, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 100), (13, "u", "long " * 400_000), (3, "u", "long " * 400_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x", 1, "y") for r in rows], SCHEMA)


def brute(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    made = []
    for p, x in data:
        last = max((q for q, y in data if y == x and q is not None), default=None)
        again = len(x) >= 1000 and last is not None and last != p
        made.append((p, len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(made, key=repr)


def through(spark, tmp_path, rows, limit=w.ARCHIVE):
    whole, members = f"file://{tmp_path}/whole", f"file://{tmp_path}/members"
    archives = w.write_archives(frame(spark, rows).repartition(3), whole, limit=limit)
    done = w.normalise(archives, members)
    return archives, done, w.read_index(done, members)


def test_records_come_back(spark, tmp_path):
    counts = []
    for limit in (5000, w.ARCHIVE):
        archives, done, index = through(spark, tmp_path / str(limit), ROWS, limit)
        read = w.read_records(index, payloads=True).collect()
        assert sorted(((int(r["id"]) if r["id"] else None, r["payload_bytes"], r["payload_digest"], r["record_type"], int(r["refers_to"]) if r["refers_to"] else None) for r in read), key=repr) == brute(ROWS)
        assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in read if r["record_type"] == "response")
        assert all(r["payload"] is None for r in read if r["record_type"] == "revisit")
        assert archives.count() == done.count()
        counts.append(done.count())
        assert {r["url"] for r in read} == {None, "u", "http://a/%20b%0D%0AX:%201", "http://a/%C3%A9"}
    assert counts[0] > counts[1] > 0


def test_members_stand_at_their_offsets(spark, tmp_path):
    archives, done, index = through(spark, tmp_path, ROWS)
    for before in archives.collect():
        data = open(before["path"].removeprefix("file://"), "rb").read()
        assert data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == 1  # one stream
    rows = index.collect()
    for after in done.collect():
        data, own = open(after["path"].removeprefix("file://"), "rb").read(), sorted((r["offset"], r["length"]) for r in rows if r["path"] == after["path"])
        assert len(own) == after["records"] and own[0][0] == 0 and sum(own[-1]) == len(data) == after["bytes"]
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        texts = [gzip.decompress(data[a : a + n]) for a, n in own]
        assert all(t.startswith(b"WARC/1.1\r\n") for t in texts) and b"".join(texts) == gzip.decompress(data)


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    _, done, index = through(spark, tmp_path, ROWS)
    n = index.count()
    stray = tmp_path / "members" / ("0" * 32 + ".warc.gz.idx")
    stray.write_text("0\t10\tresponse\t<urn:page:1>\n")
    assert w.read_index(done, f"file://{tmp_path}/members").count() == n


def test_streams_of_other_writers():
    records = [w.record("request", {"WARC-Record-ID": "<urn:x:1>"}, b"GET / HTTP/1.1\r\n\r\n"), w.page_record("4", None, b"abc", hashlib.sha1(b"abc").hexdigest(), None)]
    several = gzip.compress(records[0]) + gzip.compress(records[1])  # members already
    for data in (gzip.compress(b"".join(records)), several):
        out = io.BytesIO()
        found = list(w.split_members(io.BytesIO(data), out))
        assert [f["warc-type"] for _, _, f in found] == ["request", "response"]
        assert w.parse_member(out.getvalue()[found[1][0] :])[:6] == ("response", "4", None, None, 3, hashlib.sha1(b"abc").hexdigest())
    cut = gzip.compress(b"".join(records)[:-9])
    with pytest.raises(ValueError, match="ends in"):
        list(w.split_members(io.BytesIO(cut), io.BytesIO()))
    with pytest.raises(EOFError):
        list(w.split_members(io.BytesIO(gzip.compress(b"".join(records))[:-20]), io.BytesIO()))
    wrong = w.page_record("4", None, b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    with pytest.raises(ValueError, match="not what"):
        w.parse_member(gzip.compress(wrong))
    with pytest.raises(ValueError, match="one gzip member"):
        w.parse_member(gzip.compress(records[1]) * 2)


def test_no_pages(spark, tmp_path):
    _, done, index = through(spark, tmp_path, [])
    assert done.count() == 0 and w.read_records(index).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    more = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100_000)
    pages.unionByName(more).unionByName(more.withColumn("html", F.lit(None).cast("string"))).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = duck.execute(w.ORACLE_SQL)
    columns = [x[0] for x in wanted.description]
    rows = w.op13_warc_members(spark, str(tmp_path))
    assert set(rows.columns) == set(columns)
    assert sorted(tuple(r) for r in rows.select(*columns).collect()) == sorted(wanted.fetchall())
