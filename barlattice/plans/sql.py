"""Pieces of SQL that several oracles share."""

W = "OVER (PARTITION BY symbol ORDER BY date)"


def f(a: int, b: int = 0) -> str:
    """A frame from row a to row b, negative is earlier."""

    def side(x: int) -> str:
        return "CURRENT ROW" if x == 0 else f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"

    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {side(a)} AND {side(b)})"


def g(a: int, b: int = 0) -> str:
    """The same over the benchmark, which has no symbol."""
    return f(a, b).replace("PARTITION BY symbol ", "")


STEP = f"""st AS (SELECT *, row_number() {W} AS rn, lag(close) {W} AS prev_close FROM bars),
st2 AS (SELECT *, CASE WHEN close > prev_close THEN volume END AS up_v, CASE WHEN close < prev_close THEN volume END AS down_v FROM st)"""

FEATURES = f"""{STEP},
fe0 AS (SELECT symbol, date, open, high, low, close, volume, turnover, rn, prev_close,
  avg(close) {f(-4)} AS ma5, avg(close) {f(-5, -1)} AS ma5_prev, avg(close) {f(-19)} AS ma20, avg(volume) {f(-20, -1)} AS vma20_prev,
  {', '.join(f'(close / lag(close, {n}) {W} - 1) * 100 AS chg{n}' for n in (1, 5, 10, 20))},
  min(low) {f(-249)} AS llv250, max(high) {f(-249)} AS hhv250, max(close) {f(-60, -1)} AS prev60_hi_c, min(low) {f(-60, -1)} AS prev60_lo, max(high) {f(-60, -1)} AS hi60_prev,
  avg(up_v) {f(-19)} AS up_avg, avg(down_v) {f(-19)} AS down_avg, min(low) {f(-19)} AS min_low20, max(high) {f(-59)} AS max_high60, max(high) {f(-119)} AS max_high120,
  arg_min(low, (-volume, date)) {f(-9)} AS vol_bar_lo FROM st2),
fe1 AS (SELECT *, CASE WHEN vma20_prev > 0 THEN volume / vma20_prev ELSE 0 END AS vol_ratio_k,
  CASE WHEN hhv250 > llv250 THEN (close - llv250) / (hhv250 - llv250) ELSE 0.5 END AS pos250, (hi60_prev - prev60_lo) / prev60_lo AS plat_range,
  coalesce(up_avg / nullif(down_avg, 0), 1.0) AS ud_ratio, (close / ma20 - 1) * 100 AS bias20 FROM fe0),
ic AS (SELECT date, close, (close / nullif(lag(close, 5) OVER (ORDER BY date), 0) - 1) * 100 AS index_chg5 FROM idx),
fe AS (SELECT fe1.*, index_chg5, chg5 - index_chg5 AS rs FROM fe1 LEFT JOIN (SELECT date, index_chg5 FROM ic) USING (date))"""


def rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())
