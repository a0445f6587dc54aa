"""The store between runs: equal appends, conflicts, backfills, a lost race, spoilt parts."""

import json

import pytest

from barlattice.sources.store import Store, StoreError

SIGNAL = "signal_id string, code string, signal_date string, episode_id string, payload string"
OUTCOME = "signal_id string, horizon int, observed_date string, payload string"
PROTOCOL = {"name": "observation", "version": 1}


def listing(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def signal(n, date, episode, payload="{}"):
    return (f"s{n}", f"60{n:04d}", date, episode, payload)


def refused(call, code):
    with pytest.raises(StoreError) as error:
        call()
    assert error.value.code == code


def test_appends(spark, tmp_path):
    root = tmp_path / "store"
    store = Store(spark, str(root), PROTOCOL)

    def signals(*rows):
        return spark.createDataFrame(list(rows), SIGNAL)

    one = signals(signal(1, "2026-09-03", "e1"), signal(2, "2026-09-03", "e1"), signal(3, "2026-09-04", "e2"))
    assert store.record_sessions(one) == {"status": "RECORDED", "version": 1, "sessions": 2, "signals": 3}
    before = listing(root)
    assert store.record_sessions(one.repartition(3))["status"] == "ALREADY_RECORDED" and listing(root) == before
    refused(lambda: store.record_sessions(signals(signal(1, "2026-09-03", "e1"))), "SESSION_CONFLICT")
    refused(lambda: store.record_sessions(signals(signal(9, "2026-09-02", "e1"))), "BACKFILL_FORBIDDEN")
    refused(lambda: store.record_sessions(signals(signal(1, "2026-09-07", "e1"))), "SIGNAL_CONFLICT")
    refused(lambda: store.record_sessions(signals(signal(8, "2026-09-07", "e1"), signal(8, "2026-09-08", "e1"))), "SIGNAL_CONFLICT")
    refused(lambda: store.record_sessions(signals(signal(8, "2026-09-07", None))), "SOURCE_INVALID")
    refused(lambda: Store(spark, str(root), {**PROTOCOL, "version": 2}), "PROTOCOL_CONFLICT")
    assert listing(root) == before

    # A later run: one session is known, one is new; its episodes go on.
    later = Store(spark, str(root), PROTOCOL)
    two = signals(signal(3, "2026-09-04", "e2"), signal(4, "2026-09-07", "e2"), signal(6, "2026-09-07", "e3"), signal(5, "2026-09-07", "e3"))
    assert later.record_sessions(two) == {"status": "RECORDED", "version": 2, "sessions": 1, "signals": 3}
    assert {r.signal_id: r.first_in_episode for r in later.read("signals").collect()} == {"s1": True, "s2": False, "s3": True, "s4": False, "s5": True, "s6": False}
    assert {k: v for k, v in listing(root).items() if k in before} == before

    def outcomes(*rows):
        return spark.createDataFrame(list(rows), OUTCOME)

    got = outcomes(("s1", 1, "2026-09-04", "a"), ("s1", 3, "2026-09-08", "b"), ("s1", 1, "2026-09-04", "a"))
    assert later.append_outcomes(got) == {"status": "RECORDED", "version": 3, "outcomes": 2}
    before = listing(root)
    assert later.append_outcomes(got)["status"] == "ALREADY_RECORDED"
    refused(lambda: later.append_outcomes(outcomes(("s1", 1, "2026-09-04", "other"))), "OUTCOME_CONFLICT")
    refused(lambda: later.append_outcomes(outcomes(("s1", 5, "2026-09-08", "x"), ("s1", 5, "2026-09-08", "y"))), "OUTCOME_CONFLICT")
    refused(lambda: later.append_outcomes(outcomes(("s7", 1, "2026-09-08", "x"))), "SIGNAL_NOT_FOUND")
    refused(lambda: later.append_outcomes(outcomes(("s4", 1, "2026-09-04", "x"))), "OUTCOME_INVALID")
    assert listing(root) == before
    assert later.append_outcomes(outcomes(("s1", 1, "2026-09-04", "a"), ("s2", 1, "2026-09-04", "c"))) == {"status": "RECORDED", "version": 4, "outcomes": 1}
    assert sorted((r.signal_id, r.horizon, r.payload) for r in later.read("outcomes").collect()) == [("s1", 1, "a"), ("s1", 3, "b"), ("s2", 1, "c")]
    assert {r.status for r in later.verify().collect()} == {"OK"} and later.verify().count() == 4

    # Another append was published between reading the head and publishing: nothing of this one stays.
    before, old = listing(root), later.head()
    old["version"] -= 1
    later.head = lambda: old
    refused(lambda: later.append_outcomes(outcomes(("s2", 3, "2026-09-09", "late"))), "STORE_CHANGED")
    assert listing(root) == before

    # A part whose rows were changed, and one whose rows were lost, are found by their names.
    fresh = Store(spark, str(root), PROTOCOL)
    parts = {p["rows"]: p["name"] for p in fresh.head()["parts"] if p["kind"] == "outcomes"}
    spark.createDataFrame([("s2", 1, "2026-09-04", "forged")], OUTCOME).selectExpr("signal_id", "horizon", "CAST(observed_date AS DATE) AS observed_date", "payload").write.mode("overwrite").parquet(str(root / "parts" / parts[1]))
    spark.createDataFrame([("s1", 1, "2026-09-04", "a")], OUTCOME).selectExpr("signal_id", "horizon", "CAST(observed_date AS DATE) AS observed_date", "payload").write.mode("overwrite").parquet(str(root / "parts" / parts[2]))
    assert {r.part: r.status for r in fresh.verify().collect() if r.status != "OK"} == {parts[1]: "CONTENT_DIFFERS", parts[2]: "ROWS_DIFFER"}
    assert json.loads((root / "protocol.json").read_text()) == PROTOCOL
