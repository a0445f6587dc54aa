"""Files written by hand and read by glob: what is accepted, what is rejected and why; evidence pairs and their faults."""

import hashlib
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from barlattice.sources import documents as dc
from barlattice.sources import evidence as ev


def item(day, close=1.5):
    at = int(datetime.fromisoformat(f"{day}T00:00:00+08:00").timestamp() * 1000)
    return {"date_ms": at, **{f"{p}_price": close for p in ("open", "high", "low", "close")}, "volume": 2.0}


def test_index_files(spark, tmp_path):
    def put(name, document):
        (tmp_path / name).write_text(document if isinstance(document, str) else json.dumps(document, indent=1))

    put("index_2024.json", {"code": 0, "data": {"item": [item("2024-01-02"), item("2024-12-31")]}})
    put("index_2025.json", {"code": 0, "data": {"item": [item("2024-12-31", 9.0), item("2025-01-02"), {"open_price": 1}]}})
    put("index_2026.json", {"code": 7, "data": {"item": [item("2026-01-02")]}})
    put("index_2027.json", '{"code": 0, "data": {"item": [')
    put("index_2028.json", {"code": 0, "data": {"item": []}})
    put("index_2029.json", {"code": 0})
    put("index_2030.json", {"data": {"item": [item("2030-01-02")]}})
    put("index_2031.json", {"code": 0, "data": {"item": [item("2031-01-02"), item("2031-01-02")]}})
    put("other_2032.json", {"code": 0, "data": {"item": [item("2032-01-02")]}})
    bars, rejected = dc.index_files(spark, str(tmp_path / "index_*.json"))
    assert {(str(r.date), r.close, r.file[6:10]) for r in bars.collect()} == {("2024-01-02", 1.5, "2024"), ("2025-01-02", 1.5, "2025")}
    got = sorted((r.file[6:10], str(r.date), r.reason) for r in rejected.collect())
    assert got == [("2024", "2024-12-31", "DATE_TWICE"), ("2025", "2024-12-31", "DATE_TWICE"), ("2025", "None", "NO_DATE"), ("2026", "None", "ERROR_CODE"), ("2027", "None", "BROKEN_JSON"), ("2028", "None", "NO_ITEMS"), ("2029", "None", "NO_ITEMS"), ("2030", "None", "ERROR_CODE"), ("2031", "2031-01-02", "DATE_TWICE")]


def quote(code="600519", symbol=None, n=60, **fields):
    x = ["0"] * n
    for at, v in {1: "Name", 2: code, 3: "10.5", 4: "10", 5: "10.1", 6: "100", 30: "20260903150003", 32: "5", 33: "11", 34: "10", 38: "1", 49: "1.2"}.items():
        if at < n:
            x[at] = v
    for at, v in fields.items():
        x[int(at[1:])] = v
    return f'v_{symbol or "sh" + code}="{"~".join(x)}"'


def test_quote_files(spark, tmp_path):
    idle = quote("000001", "sz000001", _3="10", _5="0", _6="0", _32="0", _33="0", _34="0", _38="0", _49="0")
    bad = {
        "BAD_SYMBOL": quote("600001", "xx600001"), "BAD_BODY": quote("600002")[:-1], "TOO_FEW_FIELDS": quote("600003", n=49), "CODE_MISMATCH": quote("600004", "sh600005"), "NO_NAME": quote("600006", _1=" "),
        "BAD_TIMESTAMP": quote("600007", _30="20261303150003"), "BAD_VOL_RATIO": quote("600008", _49="NaN"), "NOT_POSITIVE": quote("600009", _5="0"), "BAD_BOUNDS": quote("600010", _33="9", _34="10"), "NEGATIVE_RATIO": quote("600011", _38="-1"), "BAD_PRICE": quote("600012", _3=""),
    }
    (tmp_path / "one.txt").write_text(f"{quote()};\r\n{idle};no quote here;;a=b;\n" + "\n".join(bad.values()) + ";")
    (tmp_path / "two.txt").write_text(f"{quote('688001')}\n{quote('830001', 'bj830001')}")
    (tmp_path / "empty.txt").write_text("")
    quotes, rejected = dc.quote_files(spark, str(tmp_path / "*.txt"))
    assert {(r.code, r.symbol, r.price, str(r.quote_date), r.file) for r in quotes.collect()} == {("600519", "sh600519", 10.5, "2026-09-03", "one.txt"), ("000001", "sz000001", 10.0, "2026-09-03", "one.txt"), ("688001", "sh688001", 10.5, "2026-09-03", "two.txt"), ("830001", "bj830001", 10.5, "2026-09-03", "two.txt")}
    assert {r.reason: r.line for r in rejected.collect()} == {k: v[: dc.SHOWN] for k, v in bad.items()}


def test_watchlist_files(spark, tmp_path):
    one = {"code": "600001", "trigger": 2.0, "stop": 1.0, "target": 3.0}
    for name, document in {
        "watchlist_20260903.json": {"date": "2026-09-03", "candidates": [one, {**one, "code": "600002"}]}, "watchlist_20260904.json": {"date": "2026-09-04", "candidates": []}, "watchlist_20260907.json": {"date": "2026-09-08", "candidates": [one]},
        "watchlist_2026090.json": {"date": "2026-09-03", "candidates": [one]}, "watchlist_20261399.json": {"date": "2026-09-03", "candidates": [one]}, "watchlist_20260909.json": {"date": "2026-09-09"}, "watchlist_20260910.json": {"candidates": [one]}, "watchlist_20260911.json": "{'no'",
    }.items():
        (tmp_path / name).write_text(document if isinstance(document, str) else json.dumps(document))
    rows, rejected = dc.watchlist_files(spark, str(tmp_path / "*.json"))
    assert sorted((r.file[10:18], str(r.date), r.code) for r in rows.collect()) == [("20260903", "2026-09-03", "600001"), ("20260903", "2026-09-03", "600002")]
    assert {r.file[10:-5]: r.reason for r in rejected.collect()} == {"20260907": "DATE_MISMATCH", "2026090": "BAD_FILE_NAME", "20261399": "BAD_FILE_DATE", "20260909": "NO_CANDIDATES", "20260910": "BAD_DATE", "20260911": "BROKEN_JSON"}


def test_documents_have_their_names(spark, tmp_path):
    rows = [("a/one.json", "{}"), ("b/two words.txt", "x\ny"), ("b/ü=1.txt", "z")]
    dc.write_documents(spark.createDataFrame(rows, "n string, c string"), str(tmp_path / "out"), "n", "c")
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.*") if not p.name.endswith(".crc")} == {n: c + "\n" for n, c in rows}
    with pytest.raises(ValueError, match="of one name"):
        dc.write_documents(spark.createDataFrame([("a", "1"), ("a", "2")], "n string, c string").repartition(2), str(tmp_path / "twice"), "n", "c")


DAY = "2026-09-03"


def test_evidence(spark, tmp_path):
    """Each fault in a pair of its own; what cannot be read is judged no further, and only clean captures give prices."""
    good = b"600001~10.5\n600002~3\n"

    def put(name, raw=good, component="quote", text=None, sidecar=True, **changed):
        folder = tmp_path / component
        folder.mkdir(exist_ok=True)
        if raw is not None:
            (folder / f"{name}.raw").write_bytes(raw)
        said = {"schema_version": ev.CAPTURE_SCHEMA, "target_date": DAY, "code_version": "v", "completeness_status": "COMPLETE", "provider": "quotes", "source_identity": "quote-service", "file_sha256": hashlib.sha256(raw or b"").hexdigest(), "byte_length": len(raw or b""), "retrieved_at": f"{DAY}T15:10:00+08:00", "record_count": 2}
        if sidecar:
            (folder / f"{name}.json").write_bytes(text if text is not None else json.dumps({k: v for k, v in {**said, **changed}.items() if v is not None}).encode())

    put("clean")
    put("bytes", file_sha256=hashlib.sha256(b"other").hexdigest())
    put("length", byte_length=3)
    put("noraw", raw=None)
    put("noside", sidecar=False)
    put("strange", component="rumour")
    put("early", retrieved_at=f"{DAY}T14:59:59+08:00")
    put("utc", retrieved_at=f"{DAY}T07:10:00Z")
    put("late", retrieved_at="2026-09-04T01:00:00+08:00")
    put("zoneless", retrieved_at=f"{DAY}T15:10:00")
    put("never", retrieved_at=None)
    put("cut", text=b'{"schema_version": ')
    put("latin", text=b'{"provider": "\xff\xfe"}')
    put("list", text=b'["a"]')
    put("version", code_version="w")
    put("schema", schema_version=None)
    put("day", target_date="2026-09-04", effective_trading_date="2026-09-04")
    put("part", completeness_status="PARTIAL")
    put("nobody", provider="")
    put("elsewhere", source_identity="x")
    put("count", record_count=3)
    put("twice", raw=b"600001~1\n600001~2\n")
    put("broken", raw=b"\xff\xfe")
    found = ev.captures(spark, str(tmp_path)).withColumn("day", F.lit(DAY)).withColumn("closes", F.lit(datetime(2026, 9, 3, 7, tzinfo=timezone.utc)))
    audited = ev.audit(found, "day", "closes", "v")
    got = {r["capture"]: r["errors"] for r in audited.collect()}
    want = {k: [] for k in ("clean", "utc", "count", "twice", "broken")} | {
        "bytes": ["file_sha256"], "length": ["byte_length"], "noraw": ["raw_missing"], "noside": ["sidecar_missing"], "strange": ["unknown_component"], "early": ["retrieved_before_session_close"], "late": ["retrieved_date"],
        "zoneless": ["retrieved_timezone"], "never": ["retrieved_at"], "cut": ["sidecar_unreadable"], "latin": ["sidecar_unreadable"], "list": ["sidecar_unreadable"], "version": ["code_version"], "schema": ["schema_version"],
        "day": ["target_date", "effective_trading_date"], "part": ["completeness_status"], "nobody": ["provider_source_identity", "formal_provider_source"], "elsewhere": ["formal_provider_source"],
    }
    assert got == want
    assert sorted((r.capture, r.symbol, r.price) for r in ev.quotes(audited).collect()) == [("clean", "600001", 10.5), ("clean", "600002", 3.0), ("utc", "600001", 10.5), ("utc", "600002", 3.0)]


def test_quote_lines_are_cut_once(spark, tmp_path):
    """The filter on the reason takes none of the cutting along, so that a line is cut once and not for every use of a field."""
    (tmp_path / "one.txt").write_text(f"{quote()};")
    for side in dc.quote_files(spark, str(tmp_path / "*.txt")):
        plan = side.groupBy("file").count()._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("~, -1") == 1
