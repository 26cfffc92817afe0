import random

import pytest
from pyspark.sql import functions as F

from logarc.functions import numbers, tokens
from logarc.functions.layout import render_layout, strip_layout_timestamp
from logarc.operators.decode import decode_encoded
from logarc.operators.encode import encode, filter_level, with_error_policy

from .scanner import encode as scan
from .scanner import kind_of

EDGE_KINDS = {
    17: ["0", "-7", "9223372036854775807", "-9223372036854775808"],
    19: ["1.5", "-1.5", ".5", "-.5", "0.0", "00.10", "123456789012345.6", "-.1234567890123456", "9999999999999999.0"[1:]],
    18: [
        "-0", "007", "0123", "+1.5", "5.", "9223372036854775808", "-9223372036854775809", "99999999999999999999",
        "1234567890123456.7", "0.3333333333333333", "10.1.0.7", "baker10", "TID-47x", "Added", "be", "deadBEEF", "1e5",
    ],
}
EDGE_MESSAGES = [
    "", " ", " ,;: ", "42", "1 2", "a=b", "user=alice x", "=x", "= x", "a==b=1", "é1é", "tag=é", "日本42語", "x\x10\x11\x12\x13y 7",
    "\x10\x14", "\x1017 \x12", "\\x41=\\", "acls a - . _", "-=- =- =-a", "end=abc", "7\n8\r\n9\t", "a" * 70_000 + " 12 " + "b=" * 40_000,
    "😀=a😀b1", "1.5.2 -1.5 +1 ab cd ef", "cafe Babe ff", "FF=ff", "\x12", "0x10 1_000 1e5",
]
ALPHABET = "a1f0=. -+,_/\\xé\x10\x11\x12\x13\x14\x15Zg\n:😀"


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(7)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    return EDGE_MESSAGES + made + [t for kind in EDGE_KINDS.values() for t in kind]


@pytest.mark.parametrize("mode", ["int_only", "standard", "compact"])
def test_encode_agrees_with_scanner_and_round_trips(spark, samples, mode):
    df = spark.createDataFrame(list(enumerate(samples)), "seq bigint, msg string")
    coded = encode(df, mode=mode, keep_message=True).collect()
    for row in coded:
        template, found = scan(row.msg, mode)
        assert row.logtype == template, row.msg
        assert [(v.kind, v.text) for v in row.vars] == found, row.msg
        assert all((v.enc is None) == (v.kind == 18) for v in row.vars)
    decoded = decode_encoded(encode(df, mode=mode), compact=mode == "compact", out="back")
    assert {r.seq: r.back for r in decoded.collect()} == dict(enumerate(samples))


def test_edge_tokens(spark):
    rows = [(token, kind) for kind, listed in EDGE_KINDS.items() for token in listed]
    df = spark.createDataFrame(rows, "token string, kind int")
    for row in df.withColumn("found", tokens.classify_variable(F.col("token"))).collect():
        assert row.found == row.kind == kind_of(row.token), row.token


def test_packed_bits(spark):
    df = spark.createDataFrame([("-12.5",), ("1.5",), (".5",)], "t string")
    wide = [r[0] for r in df.select(numbers.encode_decimal64(F.col("t"))).collect()]
    assert wide == [-(1 << 63) + ((125 << 8) | (2 << 4) | 0), (15 << 8) | (1 << 4), 5 << 8]
    narrow = [r[0] for r in df.select(numbers.encode_decimal32(F.col("t"))).collect()]
    assert narrow == [-(1 << 31) + ((125 << 6) | (2 << 3)), (15 << 6) | (1 << 3), 5 << 6]


def test_null_message(spark):
    row = encode(spark.createDataFrame([(1, None)], "seq bigint, msg string")).first()
    assert row.logtype is None and row.vars is None


def test_computed_array_is_not_in_a_lambda(spark):
    df = spark.createDataFrame([("a 1",)], "msg string")
    plan = decode_encoded(encode(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_layout(spark):
    assert strip_layout_timestamp("%d{HH:mm:ss.SSS} %-5level - %msg%n") == ("HH:mm:ss.SSS", " %-5level - %msg%n")
    with pytest.raises(ValueError):
        strip_layout_timestamp("%msg%n")
    with pytest.raises(ValueError):
        render_layout("%unknown")
    df = spark.createDataFrame([("INFO", "hi", "app.main"), ("CRITICAL", "yo", "b")], "level string, msg string, logger string")
    got = [r[0] for r in df.select(render_layout("[%-5level] %.4c %% %m%n")).collect()]
    assert got == ["[INFO ] main % hi\n", "[CRITICAL] b % yo\n"]


def test_levels_and_error_policy(spark):
    df = spark.createDataFrame([("INFO", 1), ("warn", 2), ("ERROR", 3)], "level string, seq bigint")
    assert [r.seq for r in filter_level(df, "WARN").collect()] == [2, 3]
    with pytest.raises(ValueError):
        filter_level(df, "LOUD")
    bad = spark.sql("select cast(null as timestamp) ts, 'x' msg union all select now(), cast(unhex('C328') as string)")
    good, aside = with_error_policy(bad, on_error="quarantine")
    assert good.count() == 0
    assert sorted(r.reason for r in aside.collect()) == ["bad timestamp", "invalid UTF-8"]
    assert with_error_policy(bad, on_error="drop").count() == 0
    with pytest.raises(Exception, match="bad timestamp|invalid UTF-8"):
        with_error_policy(bad).collect()
