import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import binary, text
from tidemark.operators import segments


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_durations(spark):
    assert column(spark, ["10ms", "10s", "2m", "1h", "1.5s", "-1s", "1d", "", None], text.duration_ms) == [10, 10_000, 120_000, 3_600_000, None, None, None, None, None]


def test_times(spark):
    given_ = ["1970-01-01T00:00:01Z", "2021-01-09T15:51:47.966123+02:00", "2021-01-09", "x", None]
    assert column(spark, given_, text.rfc3339_ms) == [1000, 1_610_200_307_966, None, None, None]
    assert column(spark, [1_610_200_307_966, 0, -1], text.rfc3339, "long") == ["2021-01-09T13:51:47.966Z", "1970-01-01T00:00:00.000Z", "1969-12-31T23:59:59.999Z"]


def test_deadlines(spark):
    got = column(spark, [None, "+5s", "99", "1970-01-01T00:00:01Z", "+x", "x", "-7"], lambda c: text.deadline(c, F.lit(1000).cast("long")))
    assert got == [1000, 6000, 99, 1000, None, None, -7]


def test_integers(spark):
    assert column(spark, ["12", "-12", "+1", "", "9223372036854775808", "1x"], text.unsigned) == [12, None, None, None, None, None]
    assert column(spark, ["12", "-12", "--1", "9223372036854775807"], text.signed) == [12, -12, None, 9223372036854775807]
    powers = [s * (10**k + d) for k in range(18) for d in (-1, 0, 1) for s in (1, -1)]
    assert column(spark, powers, text.integer_bytes, "long") == [len(f":{p}\r\n") for p in powers]


def test_sizes(spark):
    texts = ["5", "5KB", "5kB", "5KiB", "2 GiB", "2GiB", "3B", "7T", "1PiB", "+4M", "G", "1G", "x", "-1", "99999999PB"]
    assert column(spark, texts, text.size_bytes) == [5, 5000, None, 5120, None, 2 << 30, 3 * 10**9, 7 * 10**12, 1 << 50, 4 * 10**6, None, None, None, None, None]
    assert column(spark, ["", "abc", "é"], text.bulk_bytes) == [len(f"${len(v.encode())}\r\n".encode() + v.encode() + b"\r\n") for v in ("", "abc", "é")]


def test_even_parts(spark):
    got = column(spark, list(range(10)), lambda c: text.even_part(c, F.lit(10), 3), "long")
    assert got == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert column(spark, [0, 1], lambda c: text.even_part(c, F.lit(2), 5), "long") == [0, 1]


@pytest.mark.parametrize(("data", "want"), [(b"", 0), (b"hello", 0x248BFA47), (b"hello, world", 0x149BBB7F), (b"The quick brown fox jumps over the lazy dog", 0x2E4FF723)])
def test_murmur3(data, want):
    assert binary.murmur3_32(data) == want


def test_checksum_columns(spark):
    r = random.Random(1)
    data = [r.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 100)] + [None]
    assert column(spark, data, binary.murmur3, "binary") == [None if d is None else binary.murmur3_32(d) for d in data]
    assert column(spark, data, binary.adler32, "binary") == [None if d is None else zlib.adler32(d) for d in data]


@given(st.lists(st.binary(max_size=40), max_size=12))
def test_murmur3_of_many(values):
    assert binary.murmur3_all(values).tolist() == [binary.murmur3_32(v) for v in values]


def test_times_as_seconds_and_nanos(spark):
    times = [0, 1, -1, 999, -1_000, 1_234_567, -1_234_567, None]
    got = column(spark, times, text.seconds_and_nanos, "long")
    assert [None if x is None else tuple(x) for x in got] == [(0, 0), (0, 10**6), (0, -(10**6)), (0, 999 * 10**6), (-1, 0), (1_234, 567 * 10**6), (-1_234, -567 * 10**6), None]
    assert column(spark, times, lambda c: text.millis_of(text.seconds_and_nanos(c)), "long") == times


def test_elapsed(spark):
    assert column(spark, [5, 7, None], lambda c: text.elapsed_ms(c, F.lit(5)), "long") == [0, 2, None]
    with pytest.raises(Exception, match="negative duration"):
        column(spark, [4], lambda c: text.elapsed_ms(c, F.lit(5)), "long")


@given(st.integers(-(1 << 47), (1 << 47) - 1), st.integers(0, (1 << 64) - 1), st.booleans())
def test_keys_pack_and_unpack(deadline, id_, gone):
    assert binary.unpack_key(binary.pack_key(deadline, id_, gone)) == (deadline, id_, gone)


def test_keys_out_of_range():
    for bad in ((1 << 47, 0), (0, -1), (0, 1 << 64)):
        with pytest.raises(ValueError):
            binary.pack_key(*bad, False)
    with pytest.raises(ValueError):
        binary.unpack_key(b"\0" * 15 + b"\1")


def test_key_columns(spark):
    r = random.Random(2)
    keys = [(d, i, g) for d in (0, 1, -1, (1 << 47) - 1, -(1 << 47), r.randrange(1 << 47)) for i in (0, 1, (1 << 63) - 1, r.randrange(1 << 63)) for g in (True, False)]
    table = spark.createDataFrame(keys, "d long, i long, g boolean").withColumn("key", binary.packed_key(F.col("d"), F.col("i"), F.col("g"))).withColumn("k", binary.unpacked_key(F.col("key")))
    for row in table.collect():
        assert bytes(row.key) == binary.pack_key(row.d, row.i, row.g) and tuple(row.k) == (row.d, row.i, row.g)
    for bad in ((1 << 47, 0), (0, -1)):
        with pytest.raises(Exception, match="can't hold"):
            spark.createDataFrame([bad], "d long, i long").select(binary.packed_key(F.col("d"), F.col("i"), F.lit(True))).collect()


def test_compaction_picks_the_best_run(spark):
    r = random.Random(5)
    for _ in range(6):
        rows = [(k * 10, k * 10 + 9, r.randint(1, 4), p := r.randint(50, 100), r.randint(0, p)) for k in range(8)]
        of = spark.createDataFrame(rows, "start long, end long, files long, pending_count long, tombstone_count long")
        files, pending, gone = (sum(x[i] for x in rows) for i in (2, 3, 4))
        best = None
        for i in range(8):
            for j in range(i, 8):
                f, p, t = (sum(x[c] for x in rows[i : j + 1]) for c in (2, 3, 4))
                left, net = files - f + 1, pending - t
                if left <= 12 and (net - (gone - t)) / net >= 0.6:
                    norm = ((left / files) ** 2 + (net / pending) ** 2 + ((p - t) / pending) ** 2) ** 0.5
                    best = min(best or (9, 0, 0), (norm, i, j))
        got = segments.compaction(of, 12, 0.6).collect()
        due = files > 12 or (pending - gone) / pending < 0.6
        assert [(x.first, x.last) for x in got] == ([(rows[best[1]][0], rows[best[2]][1])] if best and due else [])
