import hashlib
import re
from collections import Counter, defaultdict

import pytest

from logarc.llm.warc import read_archive, read_payloads, record_bytes, record_fields, write_archive

LONG = "<p>é</p>" * 20
PAGES = [
    (5, "http://a/", LONG),
    (3, "http://b/", LONG),
    (3, "http://b/again", LONG),
    (9, "http://c/\r\nWARC-Type: evil", LONG),
    (4, None, None),
    (6, "http://d/", ""),
    (7, "http://e/", "x" * 99),
    (8, "http://f/", "x" * 99),
    (1, "http://g/", "x" * 100),
    (2, "http://h/", "x" * 100),
    (None, "http://i/", "x" * 100),
    (None, "http://j/", "y" * 200),
    (10, "http://k/", "z" * 200_000),
]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "archive")
    rows = [(*p, "clash", "clash") for p in PAGES]
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string").repartition(3), path)
    return path


def test_fields_are_those_of_the_pages(spark, archive):
    same = defaultdict(list)
    for page_id, _, html in PAGES:
        same[html or ""].append(page_id)
    wanted = Counter()
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        ids = [i for i in same[html or ""] if i is not None]
        first = min(ids, default=None)
        revisit = len(data) >= 100 and first is not None and page_id != first
        wanted[(page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert Counter(tuple(r) for r in record_fields(read_archive(spark, archive)).collect()) == wanted


def test_records_come_back_byte_for_byte(spark, archive):
    whole = read_archive(spark, archive).select("header", record_bytes()).collect()
    bodies = Counter()
    for r in whole:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        bodies[rest[:-4].decode()] += 1
    assert bodies == Counter(html or "" for _, _, html in PAGES)


def test_each_payload_is_kept_once(spark, archive):
    kept = [r.digest for r in read_payloads(spark, archive).collect()]
    assert len(kept) == len(set(kept)) == len({html or "" for _, _, html in PAGES})


def test_damage_is_noticed(spark, archive, tmp_path):
    other = str(tmp_path / "other")
    spark.read.parquet(f"{archive}/headers").write.parquet(f"{other}/headers")
    payloads = spark.read.parquet(f"{archive}/payloads")
    payloads.filter("octet_length(payload) != 99").write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="no payload for"):
        read_archive(spark, other).collect()
    changed = str(tmp_path / "changed")
    payloads.selectExpr("digest", "CAST('other' AS BINARY) AS payload").write.parquet(changed + "/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        read_payloads(spark, changed).collect()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert record_fields(read_archive(spark, path)).collect() == []
