import base64
import datetime as dt
import hashlib

from webwarden.operators import deliveries as d

SCHEMA = "delivery_id bigint, received_at timestamp_ntz, fingerprint_sha256 string, serial_number string, issuer string, domain string, key string, digest string, at int"


def t(minute):
    return dt.datetime(2025, 1, 1, 0, minute)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", 1) for r in rows], SCHEMA)


H = hashlib.sha256(b"x").hexdigest()
COLON = ":".join(H[i : i + 2] for i in range(0, 64, 2)).upper()
B64 = "sha256/" + base64.b64encode(bytes.fromhex(H)).decode()


def found(df, **kw):
    return sorted(r[0] for r in d.repeated_deliveries(df, **kw).collect())


def test_notations_of_one_fingerprint_are_one_message(spark):
    rows = [(i, t(i), f, "1", "I", "a.test") for i, f in enumerate([H, COLON, B64, "SHA256:" + H.upper(), f"  {H} ", "sha256_" + H, "sha256-" + B64[7:-1]])]
    assert found(frame(spark, rows)) == [1, 2, 3, 4, 5, 6]


def test_missing_fingerprint_joins_by_issuer_serial_and_domain(spark):
    rows = [
        (1, t(1), H, "0x0A:0b", "I", "A.test"),
        (2, t(0), None, "a0b", "I", "a.TEST"),  # earlier than 1, same message: 1 is found
        (3, t(3), None, "00:0A:0B", "J", "a.test"),  # other issuer
        (4, t(4), "", "A0B", "J", "a.test"),  # as 3, with an unreadable fingerprint
        (5, t(5), None, None, "J", "a.test"),  # nothing to agree in
        (6, t(6), None, None, "J", "a.test"),
    ]
    assert found(frame(spark, rows)) == [1, 4]


def test_ties_repeats_and_null_times(spark):
    rows = [(2, t(1), H, None, None, None), (1, t(1), H, None, None, None), (3, None, H, None, None, None), (3, None, H, None, None, None)]
    assert found(frame(spark, rows)) == [2, 3, 3]


def test_stored_messages_count(spark):
    old, new = frame(spark, [(1, t(0), H, "1", "I", "a")]), frame(spark, [(2, t(1), COLON, "1", "I", "a")])
    assert found(new, stored=old) == [2]


def test_empty_and_kept(spark):
    assert found(frame(spark, [])) == []
    rows = [(i, t(i % 50), hashlib.sha256(str(i % 7).encode()).hexdigest(), "1", "I", "a") for i in range(500)]
    df = frame(spark, rows)
    kept = {r[0] for r in d.kept_deliveries(df).collect()}
    first = {}
    for i, at, f, *_ in rows:
        first[f] = min(first.get(f, (at, i)), (at, i))
    assert kept == {i for _, i in first.values()}
    assert kept.isdisjoint(found(df)) and len(kept) + len(found(df)) == 500


def test_store_accepts_each_message_once(spark, tmp_path):
    store = d.MessageStore(spark, f"file://{tmp_path}/messages")
    other = hashlib.sha256(b"y").hexdigest()
    take = lambda *rows: sorted(r[0] for r in store.accept(frame(spark, list(rows))).collect())
    assert take((1, t(1), H, "1", "I", "a"), (2, t(0), COLON, "1", "I", "a"), (3, t(2), None, "7", "I", "b")) == [2, 3]
    # A stored digest, a row without one that agrees with it, a row that agrees with a stored row without digest.
    assert take((4, t(3), B64, "9", "J", "c"), (5, t(3), None, "0x1", "I", "A"), (6, t(3), None, "07", "I", "B"), (7, t(3), None, None, "I", "b")) == [7]
    # The first digest for a stored row without one is a repeat; another digest is a message of its own.
    assert take((8, t(4), other, "7", "I", "b")) == []
    third = hashlib.sha256(b"z").hexdigest()
    assert take((9, t(5), third, "7", "I", "b"), (10, t(6), third, "7", "I", "b")) == [9]
    assert take() == [] and take((11, t(7), third, None, None, None)) == []


def test_store_in_batches_keeps_as_many_messages_as_all_at_once(spark, tmp_path):
    rows = [(i, t(i % 50), None if i % 5 == 0 else hashlib.sha256(str(i % 23).encode()).hexdigest(), str(i % 23), "I", "a") for i in range(200)]
    store = d.MessageStore(spark, f"file://{tmp_path}/messages")
    kept = [r[0] for k in range(0, 200, 50) for r in store.accept(frame(spark, rows[k : k + 50])).collect()]
    assert len(kept) == d.kept_deliveries(frame(spark, rows)).count() == 23
