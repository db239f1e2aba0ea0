"""Archives: round trips, revisits, and files that don't depend on the cluster."""

import collections
import hashlib

import pytest

from quire.llm.warc import archive_folder, key_of, read_warc, record_id, write_warc

BIG = "x" * 1500 + "é"
ROWS = [
    (1, "http://a", "<p>short</p>"), (9001, "u", BIG), (9005, None, BIG), (9003, "a\r\nb", BIG), (9010, "z", None), (9011, "z", "short"),
    (9012, "z", "short"), (None, "n", BIG), (-5, "minus", "y" * 3000), *[(k, f"u{k}", f"{k} " * 300) for k in range(20, 60)],
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")


def test_round_trip(spark, pages):
    to = archive_folder(spark)
    write_warc(pages.repartition(4), to, file_bytes=2000, shard_bytes=20_000)
    last = collections.defaultdict(lambda: -(10**9))
    for i, _, h in ROWS:
        last[h] = max(last[h], i if i is not None else -(10**9))
    got = {r["page_id"]: r for r in read_warc(spark, to, payloads=True).collect()}
    assert len(got) == len(ROWS)
    for i, u, h in ROWS:
        data, r = (h or "").encode(), got[i]
        revisit = len(data) >= 1000 and last[h] != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"], r["html"]) == (("revisit", last[h], None) if revisit else ("response", None, h or ""))
        assert r["url"] == (u.replace("\r\n", " ") if u else None)


def test_same_files_from_any_partitioning(spark, pages):
    first = [sorted(map(tuple, write_warc(pages.repartition(n), archive_folder(spark), file_bytes=2000, shard_bytes=20_000).collect())) for n in (1, 7)]
    assert first[0] == first[1] and len(first[0]) > 3


def test_empty(spark, pages):
    to = archive_folder(spark)
    assert write_warc(pages.limit(0), to).count() == 0
    assert read_warc(spark, to).count() == 0


def test_damage_is_found(spark, pages):
    to = archive_folder(spark)
    name = write_warc(pages, to).first()["file"]
    path = f"{to.removeprefix('file://')}/{name}"
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="(?i)error|differs"):
        read_warc(spark, to).collect()


@pytest.mark.parametrize("key", [0, 1, -1, 2**63 - 1, -(2**63), None])
def test_record_ids(key):
    assert key_of(record_id(key)) == key


def test_rows_that_share_an_id(spark):
    """Of equal rows with the greatest id all are responses; rows of one id with other payloads are told apart."""
    a, b = "a" * 2000, "b" * 2000
    rows = [(5, "u", BIG), (5, "u", BIG), (5, "v", BIG), (3, "w", BIG), (3, "w", BIG), (7, "x", a), (7, "x", b), (8, "y", a), (None, "n", b), (None, "n", b)]
    to = archive_folder(spark)
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), to, file_bytes=2000, shard_bytes=4000)
    got = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in read_warc(spark, to).collect()), key=str)
    want = [(5, "u", 1502, "response", None)] * 2 + [(5, "v", 1502, "response", None)] + [(3, "w", 1502, "revisit", 5)] * 2 + [(7, "x", 2000, "revisit", 8), (7, "x", 2000, "response", None), (8, "y", 2000, "response", None)] + [(None, "n", 2000, "revisit", 7)] * 2
    assert got == sorted(want, key=str)


def test_a_very_long_page(spark):
    long = "".join(hashlib.sha256(b"%d" % k).hexdigest() for k in range(200_000))
    to = archive_folder(spark)
    write_warc(spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", "short")], "page_id long, url string, html string"), to)
    got = {r["page_id"]: r for r in read_warc(spark, to, payloads=True).collect()}
    assert got[2]["html"] == long and (got[1]["record_type"], got[1]["refers_to"], got[1]["payload_bytes"]) == ("revisit", 2, 12_800_000)
