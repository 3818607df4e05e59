import datetime as dt

import pytest

from webwarden.operators import instants as m


def us(*a, frac=0):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + frac


CASES = [
    ("Jan  1 04:13:59 2025 GMT", None, us(2025, 1, 1, 4, 13, 59)),
    ("Sat, 04 Jan 2025 08:34:02 +1100", "UTC", us(2025, 1, 3, 21, 34, 2)),
    ("04/Jan/2025:09:45:59 -0600", None, us(2025, 1, 4, 15, 45, 59)),
    ("2025-01-01 18:38:03,349 UTC", "Asia/Tokyo", us(2025, 1, 1, 18, 38, 3, frac=349000)),
    ("2025-01-01t06:46:06z", None, us(2025, 1, 1, 6, 46, 6)),
    ("20250102T032543Z", None, us(2025, 1, 2, 3, 25, 43)),
    ("20250101212838Z", None, us(2025, 1, 1, 21, 28, 38)),
    ("250102233528Z", None, us(2025, 1, 2, 23, 35, 28)),
    ("1735768723.85", None, 1735768723_850000),
    ("1735712447991", None, 1735712447_991000),
    ("1735731345328246", None, 1735731345328246),
    ("1735731345328246789", None, 1735731345328246),
    ("1735733095", "Asia/Tokyo", 1735733095_000000),
    ("2025-01-02T23:54:19.822997545Z", None, us(2025, 1, 2, 23, 54, 19, frac=822997)),
    ("05.01.2025 04:55:42", "Asia/Kolkata", us(2025, 1, 4, 23, 25, 42)),
    ("2025-01-04T08:57+01:00", None, us(2025, 1, 4, 7, 57)),
    ("2025-01-02T23:55:16+05", None, us(2025, 1, 2, 18, 55, 16)),
    ("2025-01-04 23:02:43 EST", "UTC", us(2025, 1, 5, 4, 2, 43)),
    ("Jan 11, 2025 1:27:46 PM", "UTC", us(2025, 1, 11, 13, 27, 46)),
    ("Jan 11, 2025 12:27:46 AM", None, us(2025, 1, 11, 0, 27, 46)),
    ("2025-10-26 02:30:00", "Europe/Berlin", us(2025, 10, 26, 0, 30)),  # occurs twice: the first
    ("2025-03-30 02:30:00", "Europe/Berlin", us(2025, 3, 30, 1, 30)),  # skipped: the offset before
    ("2025-03-09T02:15:00", "America/New_York", us(2025, 3, 9, 7, 15)),
    ("2025-06-01 00:00:00", "No/Where", us(2025, 6, 1)),
    ("99991231235959Z", None, 253402300799_000000),
    (" 2025-01-01T00:00:00Z ", None, us(2025, 1, 1)),
    ("2025-07-01 12:00:00 Europe/Berlin", None, us(2025, 7, 1, 10)), ("2025-01-01T12:00:00[America/Argentina/Ushuaia]", "Asia/Tokyo", us(2025, 1, 1, 15)), ("2025-07-01T12:00:00+02:00[Europe/Berlin]", None, us(2025, 7, 1, 10)), ("1 Jul 2025 12:00:00 Europe/Berlin", None, us(2025, 7, 1, 10)),
    ("2016-12-31T23:59:60Z", None, us(2017, 1, 1)), ("2025-01-31T24:00:00Z", None, us(2025, 2, 1)), ("2025-01-31T24:00:01Z", None, None), ("2025-07-01 12:00:00 Mars/Olympus", None, None), ("2025-07-01", None, None),
    ("0000-00-00 00:00:00", None, None), ("2025-02-30 10:00:00", None, None), ("2025-01-01 25:00:00", None, None), ("pending", None, None),
    ("", None, None), ("-", None, None), ("12", None, None), ("Jan 11, 2025 13:27:46 PM", None, None), ("x" * 50000, None, None), ("2025-01-01 10:00:00 QQQ", None, None),
]
SCHEMA = "field_name string, row_id bigint, raw string, zone string"


def test_notations(spark):
    df = spark.createDataFrame([("f", i, r, z) for i, (r, z, _) in enumerate(CASES)], SCHEMA)
    got = {r["row_id"]: r["utc_micros"] for r in m.normalise_instants(df).collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(CASES) if v is not None}


def test_canonical_are_no_cases_and_repeats_stay(spark):
    rows = [("f", 1, "2025-01-01T00:00:00Z", None), ("f", 2, "1735733095", None), ("f", 2, "1735733095", None), ("f", 3, "1735733095", "UTC")]
    got = sorted((r["row_id"], r["utc_micros"]) for r in m.found_instants(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(2, 1735733095_000000)] * 2 + [(3, 1735733095_000000)]
    assert m.found_instants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_values_skip_nulls(spark):
    df = spark.createDataFrame([(1, None, "a", None, "extra")], "id bigint, z string, x string, y string, raw string")
    rows = m.time_values(df, "id", "z", {"x": "t.x", "y": "t.y"}).collect()
    assert [tuple(r) for r in rows] == [("t.x", 1, "a", None)]


def test_dictionary_grows_by_new_strings_only(spark, tmp_path, monkeypatch):
    d = m.InstantDictionary(spark, f"file://{tmp_path}/dict")
    first = spark.createDataFrame([("f", 1, "1735733095", None), ("f", 2, "Jan  1 04:13:59 2025 GMT", "UTC"), ("f", 9, "pending", None)], SCHEMA)
    second = spark.createDataFrame([("f", 3, "1735733095", None), ("f", 4, "1735733096", None), ("f", 9, "pending", None)], SCHEMA)
    assert m.normalise_instants(first, d).count() == 2 and d.read().count() == 3
    assert m.normalise_instants(second, d).count() == 2 and d.read().count() == 4
    batches = len(list((tmp_path / "dict").iterdir()))
    # What is known is not parsed: with a parser that answers -1, only a new string gets its answer.
    monkeypatch.setattr(m, "instant_micros", lambda raw, zone: m.F.lit(-1).cast("bigint"))
    third = spark.createDataFrame([("f", 3, "1735733095", None), ("f", 4, "1735733097", None), ("f", 9, "pending", None)], SCHEMA)
    assert sorted(r["utc_micros"] for r in m.normalise_instants(third, d).collect()) == [-1, 1735733095_000000]
    assert m.normalise_instants(first, d).count() == 2 and len(list((tmp_path / "dict").iterdir())) == batches + 1  # nothing new, no batch


def test_repeated_batches_of_the_dictionary_duplicate_no_rows(spark, tmp_path):
    d = m.InstantDictionary(spark, f"file://{tmp_path}/dict")
    df = spark.createDataFrame([("f", 1, "1735733095", None), ("f", 2, "1735733095", None), ("f", 3, "-", None)], SCHEMA)
    want = sorted(map(tuple, m.normalise_instants(df, d).collect()))
    d.append(d.read())  # a second writer, or a call that is repeated
    d.append(d.read())
    assert sorted(map(tuple, m.normalise_instants(df, d).collect())) == want and d.read().count() == 2


def test_zone_names_of_the_notations_are_known():
    with pytest.raises(KeyError):
        m.ZONE_MINUTES["QQQ"]
    assert m.ZONE_MINUTES["CET"] == 60 and m.ZONE_MINUTES["EDT"] == -240
