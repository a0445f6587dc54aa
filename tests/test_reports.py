"""Reports written by hand: what holds is read back whole, what does not has a reason and no numbers."""

import hashlib
import json

import pytest

from barlattice.sources import reports as rp


def rule(name, verdict=rp.MATCHED, trend="OK", flags=("True", "False", "—"), support="True"):
    return (f"<p><strong>{name}</strong> · 事件身份 x</p><p>判定 {verdict}；</p><p>趋势：{trend}；均线顺序 {flags[0]}；收盘高于快线 {flags[1]}；趋势合格 {flags[2]}。</p>"
            f"<p>回踩：深 &amp; 浅；深度 0.1。</p><p>反弹确认：True；\n支撑判定 {support}。</p>")


def card(symbol="600001", *rules):
    return f'<article class="c-stock-card"><span class="c-stock-symbol">{symbol}</span>{"".join(rules or map(rule, rp.RULES))}<p>来源：x</p></article>'


def add(root, day, html, total, a, b, status="C_SUCCESS_WITH_MATCHES", alias=None, text=None, **changed):
    page = html.encode()
    version = changed.get("version_sha256", "a" * 64)
    said = {"schema_version": rp.SCHEMA_VERSION, "signal_date": f"{day[:4]}-{day[4:6]}-{day[6:]}", "version_sha256": "a" * 64, "html_sha256": hashlib.sha256(page).hexdigest(), "matched_stock_count": total, "matched_by_rule": {"BALANCED_A": a, "CONSERVATIVE_B": b}, "c_status": status, "coverage_status": "FULL", **changed}
    manifest = text if text is not None else json.dumps({k: v for k, v in said.items() if v is not None}).encode()
    for folder, own in ((root / day, page), (root / day / version, alias if alias is not None else page)):
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "manifest.json").write_bytes(manifest)
        (folder / "index.html").write_bytes(own)


LEGACY = ("<article class='card'><h3>600009 old</h3>" + "".join(f'<section class="rule"><h4>{r} <span>{rp.LEGACY_MATCH}</span></h4><p>趋势：OK；均线顺序 True；收盘高于快线 True；趋势合格 True。</p><p>回踩：OK；深度。</p><p>反弹确认：True；支撑判定 False。</p></section>' for r in rp.RULES) + "</article>")
PENDING = "；".join(f"{r} {rp.NOTHING_PENDING}" for r in rp.RULES)


def test_reports(spark, tmp_path):
    one = card()
    two = card() + card("600002", rule("BALANCED_A"), rule("CONSERVATIVE_B", "RULE_NOT_MATCHED"))
    add(tmp_path, "20261008", two, 2, 2, 1)
    add(tmp_path, "20261009", "<p>none</p>", 0, 0, 0, "C_SUCCESS_NO_MATCH")
    add(tmp_path, "20261010", "<p>wait</p>", 0, 0, 0, "C_DATA_PENDING")
    add(tmp_path, "20260924", LEGACY + PENDING, 1, 1, 1, None)
    bad = {
        "20261101": ("HASH_MISMATCH", dict(html=one, total=1, a=1, b=1, html_sha256="0" * 64)), "20261102": ("VERSION_MISMATCH", dict(html=one, total=1, a=1, b=1, alias=b"other")),
        "20261103": ("BAD_UNION", dict(html=one, total=3, a=1, b=1)), "20261104": ("CARD_COUNT_MISMATCH", dict(html=one, total=2, a=1, b=1)), "20261105": ("STATUS_MISMATCH", dict(html=one, total=1, a=1, b=1, status="C_SUCCESS_NO_MATCH")),
        "20261106": ("RULE_COUNT_MISMATCH", dict(html=two, total=2, a=1, b=1)), "20261107": ("UNRECOGNISED_CARD", dict(html=card("60001"), total=1, a=1, b=1)), "20261108": ("MISSING_RULE", dict(html=card("600001", rule("BALANCED_A")), total=1, a=1, b=0)),
        "20261109": ("INCOMPLETE_RULE", dict(html=card("600001", rule("BALANCED_A"), rule("CONSERVATIVE_B", support="maybe")), total=1, a=1, b=1)), "20261110": ("SYMBOL_TWICE", dict(html=one + one, total=2, a=2, b=2)),
        "20261111": ("DATE_MISMATCH", dict(html=one, total=1, a=1, b=1, signal_date="2026-11-12")), "20261112": ("BROKEN_MANIFEST", dict(html=one, total=1, a=1, b=1, text=b'{"schema')), "20261113": ("BAD_COUNTS", dict(html=one, total=None, a=1, b=1)),
        "20261114": ("BAD_COUNTS", dict(html=one, total=1, a=-1, b=1)), "20261115": ("NO_STATUS", dict(html=one, total=1, a=1, b=1, status=None)), "20261116": ("BAD_VERSION", dict(html=one, total=1, a=1, b=1, version_sha256="A" * 64)), "20261117": ("BAD_SCHEMA", dict(html=one, total=1, a=1, b=1, schema_version="V0")),
    }
    for day, (_, settings) in bad.items():
        add(tmp_path, day, **settings)
    (tmp_path / "20261118").mkdir()
    (tmp_path / "20261118" / "index.html").write_text(one)
    days, details = rp.read_reports(spark, str(tmp_path))
    got = {r.day: r for r in days.collect()}
    assert {d: r.reason for d, r in got.items() if r.reason} == {d: reason for d, (reason, _) in bad.items()} | {"20261118": "NO_MANIFEST"}
    assert all(r.total is None and r.balanced_a is None and r.status is None for r in got.values() if r.reason)
    assert [(got[d].status, got[d].status_source, got[d].total, got[d].balanced_a, got[d].conservative_b) for d in ("20261008", "20261009", "20261010", "20260924")] == [
        ("C_SUCCESS_WITH_MATCHES", "MANIFEST", 2, 2, 1), ("C_SUCCESS_NO_MATCH", "MANIFEST", 0, 0, 0), ("C_DATA_PENDING", "MANIFEST", None, None, None), ("C_SUCCESS_WITH_MATCHES", "PAGE", 1, 1, 1)]
    rows = {(r.day, r.symbol, r["rule"]): r for r in details.collect()}
    assert set(rows) == {(d, s, r) for d, s in (("20261008", "600001"), ("20261008", "600002"), ("20260924", "600009")) for r in rp.RULES}
    first = rows["20261008", "600001", "BALANCED_A"]
    assert (first.trend_status, first.ma_order_ok, first.close_above_fast_average, first.trend_qualified, first.structure_status, first.confirmation_qualified, first.entry_support_ok) == ("OK", True, False, None, "深 & 浅", True, True)
    assert rows["20261008", "600002", "CONSERVATIVE_B"].research_match_status == "RULE_NOT_MATCHED" and rows["20260924", "600009", "BALANCED_A"].entry_support_ok is False


def test_no_reports(spark, tmp_path):
    (tmp_path / "readme.txt").write_text("nothing dated")
    days, details = rp.read_reports(spark, str(tmp_path))
    assert days.collect() == [] and details.collect() == []
    with pytest.raises(Exception):
        rp.read_reports(spark, str(tmp_path / "absent"))
