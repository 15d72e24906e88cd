"""Hex words, bitmaps, guarded ratios, compounding (Hard 1, Hard 2, T1, T3)."""

import math

from pyspark.sql import functions as F

from carrylens.functions import units as u


def _word(n: int) -> str:
    return format(n, "064x")


def test_word_decode_edges(spark):
    vals = [0, 2**64 - 1, 2**64, 10**38 - 1, 10**38, 2**128 - 1, 2**256 - 1]
    df = spark.createDataFrame([(_word(v),) for v in vals], "w string")
    rows = df.select(u.word_to_decimal("w").cast("string").alias("d"), u.word_to_double("w").alias("x")).collect()
    for v, r in zip(vals, rows):
        if v <= 10**38 - 1:
            assert r.d == str(v)
        else:
            assert r.d is None  # does not fit DECIMAL(38,0)
        assert math.isclose(r.x, float(v), rel_tol=1e-15)


def test_account_blob_words(spark):
    blob = "0x" + "".join(_word(v) for v in (5, 7, 0, 9400, 9200, 2**70))
    df = spark.createDataFrame([(blob,), ("0x" + _word(1),)], "data string")
    r = df.select(u.n_words("data").alias("n"), u.word_to_double(u.word_at("data", 5)).alias("hf")).collect()
    assert [x.n for x in r] == [6, 1]
    assert r[0].hf == float(2**70)


def test_topic_address_roundtrip(spark):
    a = "0x00000000000000000000000000000000000000ab"
    df = spark.createDataFrame([(a,)], "a string")
    w = df.select(u.word_from_address("a").alias("t")).first().t
    assert len(w) == 66 and w.endswith("ab")
    back = spark.createDataFrame([(w,)], "t string").select(u.address_from_topic("t").alias("a")).first().a
    assert back == a


def test_bit_above_64(spark):
    bitmap = (1 << 100) | (1 << 3) | 1
    df = spark.createDataFrame([(str(bitmap),)], "b string").select(F.col("b").cast("decimal(38,0)").alias("b"))
    r = df.select(u.set_bits("b").alias("bits"), u.bit_is_set("b", 100).alias("b100"), u.bit_is_set("b", 99).alias("b99")).first()
    assert r.bits == [0, 3, 100]
    assert r.b100 is True and r.b99 is False


def test_safe_div_no_ansi_error(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r.x for r in df.select(u.safe_div("a", "b").alias("x")).collect()] == [None, 0.5, None]


def test_apr_to_apy_keeps_digits(spark):
    # T3: naive (1 + apr/n)^n - 1 in doubles loses digits; expm1/log1p does not
    apr, n = 0.032, 31_536_000.0
    exact = math.expm1(n * math.log1p(apr / n))
    x = spark.range(1).select(u.apr_to_apy(F.lit(apr)).alias("x")).first().x
    assert abs(x - exact) < 1e-15
    assert abs(x - 0.0325175053) < 1e-9


def test_dense_bitmaps(spark):
    """Runs of set bits, where rounding division went wrong, and all 128 bits in hex."""
    from carrylens.functions.units import hex_bit_is_set, set_bits

    values = [2**22 - 1, 2**30 - 1, 2**64 - 1, 2**126 - 1, (1 << 30) | (1 << 32), 0, 1 << 125]
    rows = spark.createDataFrame([(str(v),) for v in values], "v string").selectExpr("cast(v as decimal(38,0)) as b")
    got = sorted(tuple(r[0]) for r in rows.select(set_bits("b")).collect())
    assert got == sorted(tuple(i for i in range(128) if v >> i & 1) for v in values)
    full = spark.createDataFrame([(f"{2**128 - 1:032x}",), (f"{(1 << 127) | 5:032x}",)], "h string")
    from pyspark.sql import functions as F

    bits = full.select(F.filter(F.sequence(F.lit(0), F.lit(127)), lambda i: hex_bit_is_set("h", i))).collect()
    assert [list(r[0]) for r in bits] == [list(range(128)), [0, 2, 127]]


def test_log_filter_ignores_hex_case(spark):
    from carrylens.sources.decode import filter_logs

    logs = spark.createDataFrame([("0xAB", ["0xCD"]), ("0xab", ["0xcd"])], "address string, topics array<string>")
    assert filter_logs(logs, "0xcd", address="0xAb").count() == 2


def test_windows_reach_the_last_block(spark):
    from carrylens.sources.decode import window_counts

    logs = spark.createDataFrame([(5,), (1_200_000,)], "block_number bigint")
    assert window_counts(spark, logs, 0, 1_200_000, 9_999).agg({"n_logs": "sum"}).first()[0] == 2
