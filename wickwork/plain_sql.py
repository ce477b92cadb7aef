"""DuckDB SQL for features, written from their formulas and not from the operators' levels, for any parameters."""

from __future__ import annotations


def _tr(bars: str) -> str:
    return f"""bars AS ({bars}),
t AS (SELECT symbol, seq, "Low", "High", "Close", "Close" - lag("Close") OVER w AS d, greatest("High" - "Low", abs("High" - lag("Close") OVER w), abs("Low" - lag("Close") OVER w)) AS tr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq))"""


def _frame(w: int) -> str:
    return f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _full(fn: str, x: str, w: int) -> str:
    return f"CASE WHEN count({x}) OVER {_frame(w)} = {w} THEN {fn}({x}) OVER {_frame(w)} END"


def adaptive_rsi(bars: str, period: int, atr: int) -> str:
    return f"""WITH {_tr(bars)},
a0 AS (SELECT symbol, seq, {_full("avg", "tr", atr)} AS a FROM t),
a1 AS (SELECT symbol, seq, CASE WHEN a = 0 THEN 1e-10 ELSE a END AS a FROM a0),
b0 AS (SELECT symbol, seq, a, {_full("avg", "a", atr)} AS b FROM a1),
n AS (SELECT symbol, max(CASE WHEN b IS NULL THEN {period} ELSE floor(least(greatest({period} / (a / CASE WHEN b = 0 THEN 1e-10 ELSE b END), 5), 30)) END)::INT AS n FROM b0 GROUP BY symbol),
y AS (SELECT x.symbol, x.seq, count(z.d) AS c, any_value(n.n) AS n, avg(z.d) FILTER (WHERE z.d > 0) AS up, -avg(z.d) FILTER (WHERE z.d < 0) AS dn
  FROM t AS x JOIN n USING (symbol) JOIN t AS z ON z.symbol = x.symbol AND z.seq > x.seq - n.n AND z.seq <= x.seq GROUP BY x.symbol, x.seq),
v AS (SELECT symbol, seq, CASE WHEN c = n THEN 100 - 100 / (1 + up / (dn + 1e-10)) END AS v FROM y),
m AS (SELECT symbol, min(v) AS lo, max(v) AS hi FROM v GROUP BY symbol)
SELECT symbol, seq, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) WHEN v IS NOT NULL THEN 0 END, 6) + 0.0 AS adaptive_rsi FROM v JOIN m USING (symbol)"""


def stochastic_rsi(bars: str, period: int, window: int, k: int, d: int) -> str:
    return f"""WITH {_tr(bars)},
m AS (SELECT symbol, seq, {_full("avg", "greatest(d, d - d)", period)} AS g, {_full("avg", "greatest(-d, d - d)", period)} AS l FROM t),
r AS (SELECT symbol, seq, 100 - 100 / (1 + g / (l + 1e-10)) AS r FROM m),
s AS (SELECT symbol, seq, (r - {_full("min", "r", window)}) / ({_full("max", "r", window)} - {_full("min", "r", window)} + 1e-10) AS s FROM r),
k AS (SELECT symbol, seq, {_full("avg", "s", k)} AS k FROM s),
kd AS (SELECT symbol, seq, k, {_full("avg", "k", d)} AS d FROM k),
c AS (SELECT *, coalesce((lag(k) OVER w < lag(d) OVER w AND k >= d)::INT, 0) AS c FROM kd WINDOW w AS (PARTITION BY symbol ORDER BY seq))
SELECT symbol, seq, round(k, 6) + 0.0 AS stoch_rsi_k, round(d, 6) + 0.0 AS stoch_rsi_d, max(c) OVER {_frame(4)} + 0.0::DOUBLE AS stoch_cross_bull FROM c"""


def wave_phase(bars: str, lookback: int, smooth: int) -> str:
    """Weights of the running means are powers, so they are sums over all rows before."""
    slow = min(smooth, lookback // 10)
    mean = lambda span: f"sum(z.c * pow(1 - 2.0::DOUBLE / ({span} + 1), x.seq - z.seq)) / sum(pow(1 - 2.0::DOUBLE / ({span} + 1), x.seq - z.seq))"
    return f"""WITH bars AS ({bars}),
w AS (SELECT symbol, seq, "Close" AS p, list("Close") OVER {_frame(lookback)} AS l FROM bars),
m AS (SELECT symbol, seq, p, l, list_aggregate(l, 'median') AS med FROM w WHERE len(l) = {lookback}),
z AS (SELECT symbol, seq, (p - med) / (1.4826 * list_aggregate(list_transform(l, lambda v: abs(v - med)), 'median') + 1e-8) AS z FROM m),
c AS (SELECT symbol, seq, least(greatest(z, -4), 4) / 4 AS c FROM z),
s AS (SELECT x.symbol, x.seq, {mean(slow)} AS a, {mean(slow // 3)} AS b FROM c AS x JOIN c AS z ON z.symbol = x.symbol AND z.seq <= x.seq AND z.seq > x.seq - 400 GROUP BY x.symbol, x.seq)
SELECT symbol, seq, round(a, 6) + 0.0 AS wave_phase, round(b - a, 6) + 0.0 AS phase_divergence FROM bars LEFT JOIN s USING (symbol, seq)"""


def super_trend(bars: str, period: int, multiplier: float) -> str:
    return f"""WITH RECURSIVE {_tr(bars)},
a AS (SELECT symbol, seq, {_full("avg", "tr", period)} AS m FROM t),
b AS (SELECT bars.symbol, bars.seq, "Close" AS c, ("High" + "Low") / 2 AS mid, lag(m) OVER (PARTITION BY bars.symbol ORDER BY bars.seq) AS atr FROM bars JOIN a USING (symbol, seq)),
k AS MATERIALIZED (SELECT symbol, seq, c, atr, lag(mid + {multiplier} * atr) OVER w AS up, lag(mid - {multiplier} * atr) OVER w AS dn FROM b WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
s AS (
  SELECT symbol, seq, CASE WHEN c < up THEN up ELSE dn END AS st, CASE WHEN c < up THEN -1 ELSE 1 END AS way FROM k WHERE seq = {period} + 1
  UNION ALL
  SELECT k.symbol, k.seq,
    CASE WHEN s.way > 0 THEN CASE WHEN k.c < h.lo THEN k.up ELSE h.lo END ELSE CASE WHEN k.c > h.hi THEN k.dn ELSE h.hi END END,
    CASE WHEN s.way > 0 THEN CASE WHEN k.c < h.lo THEN -1 ELSE 1 END ELSE CASE WHEN k.c > h.hi THEN 1 ELSE -1 END END
  FROM s JOIN k ON k.symbol = s.symbol AND k.seq = s.seq + 1, LATERAL (SELECT CASE WHEN s.st > k.dn THEN s.st ELSE k.dn END AS lo, CASE WHEN s.st < k.up THEN s.st ELSE k.up END AS hi) AS h
)
SELECT k.symbol, k.seq, round(least(greatest(coalesce(way * (1 - least(greatest(CASE WHEN st IS NOT NULL THEN atr / (abs(c - st) + 1e-8) END, 0), 1) - CASE WHEN st IS NULL OR atr IS NULL THEN NULL ELSE 0 END), 0), -1), 1), 6) + 0.0 AS "super_trend_{period}_{multiplier}"
FROM k LEFT JOIN s USING (symbol, seq)"""


def adaptive_zscore(bars: str, lookback: int, span: int) -> str:
    w = f"pow(1 - 2.0::DOUBLE / ({span} + 1), x.seq - z.seq)"
    return f"""WITH bars AS ({bars}),
m AS (SELECT symbol, seq, "Close" AS p, CASE WHEN count("Close") OVER {_frame(lookback)} = {lookback} THEN quantile_cont("Close", 0.5) OVER {_frame(lookback)} END AS med, "Close" - avg("Close") OVER (PARTITION BY symbol) AS c FROM bars),
s AS (SELECT x.symbol, x.seq, sum({w}) AS w, sum({w} * {w}) AS w2, sum({w} * z.c) AS a, sum({w} * z.c * z.c) AS b FROM m AS x JOIN m AS z ON z.symbol = x.symbol AND z.seq <= x.seq GROUP BY x.symbol, x.seq),
v AS (SELECT symbol, seq, CASE WHEN w * w - w2 > 1e-12 THEN (b / w - (a / w) * (a / w)) * w * w / (w * w - w2) END AS v FROM s)
SELECT symbol, seq, round((p - med) / (sqrt(greatest(v, 0)) + 1e-8), 6) + 0.0 AS adaptive_zscore FROM m JOIN v USING (symbol, seq)"""


# Formulas of the feature set -----------------------------------------------------------------------------------------

W = "(PARTITION BY symbol ORDER BY seq)"


def _ema(name: str, src: str, x: str, span: int, seeded: bool = False) -> str:
    """(symbol, seq, y): the average as the sum of all values up to the row with its weights, started by the first value or the mean of the first ``span``."""
    s, keep = (span if seeded else 1), f"(1 - 2.0::DOUBLE / ({span} + 1))"
    return f"""{name}_x AS MATERIALIZED (SELECT symbol, seq, ({x})::DOUBLE AS x, row_number() OVER {W} AS i FROM {src} WHERE ({x}) IS NOT NULL),
{name} AS MATERIALIZED (SELECT b.symbol, b.seq, sum(CASE WHEN a.i <= {s} THEN pow({keep}, b.i - {s}) * a.x / {s} ELSE (1 - {keep}) * pow({keep}, b.i - a.i) * a.x END) AS y
  FROM {name}_x AS b JOIN {name}_x AS a ON a.symbol = b.symbol AND a.i <= b.i WHERE b.i >= {s} GROUP BY b.symbol, b.seq)"""


def _wilder_rsi(name: str, src: str, n: int) -> str:
    """(symbol, seq, y): gains over gains and losses, both with the same falling weights, which cancel."""
    w = f"pow(1 - 1.0::DOUBLE / {n}, b.seq - a.seq)"
    return f"""{name}_d AS MATERIALIZED (SELECT symbol, seq, "Close" - lag("Close") OVER {W} AS d FROM {src}),
{name} AS MATERIALIZED (SELECT b.symbol, b.seq, 100 * sum(CASE WHEN a.d > 0 THEN {w} * a.d ELSE 0 END) / nullif(sum({w} * abs(a.d)), 0) AS y
  FROM {name}_d AS b JOIN {name}_d AS a ON a.symbol = b.symbol AND a.seq <= b.seq AND a.seq > 1 WHERE b.seq > {n} GROUP BY b.symbol, b.seq)"""


def _rounded(**columns: str) -> str:
    return "symbol, seq, " + ", ".join(f'round(({x})::DOUBLE, {3 if c in COARSE else 6}) + 0.0 AS "{c}"' for c, x in columns.items())


#: Results as large as prices or larger, which two orders of summation give alike to three decimals.
COARSE = ("ema50_ema200_diff", "nar_res", "candle_atr_ratio", "candle_atr_ratio_ma", "atr_24_norm_pct_change", "atr_24_norm_pct_change_rolling_mean_10", *[f"atr_{w}_norm_rsi_weight" for w in (14, 24, 48)])


def _join(first: str, names: list[str]) -> str:
    return first + "".join(f" LEFT JOIN (SELECT symbol, seq, y AS {n} FROM {n}) USING (symbol, seq)" for n in names)


def breakout(bars: str, w: int, back: int, down: bool = False) -> str:
    side, fn, cmp, name = ("Low", "min", "<", "breakdown") if down else ("High", "max", ">", "breakout")
    return f"""WITH bars AS ({bars}),
b AS (SELECT *, {fn}("{side}") OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS edge FROM bars),
n AS (SELECT symbol, seq, CASE WHEN "{side}" {cmp} edge THEN 1 ELSE 0 END AS now FROM b)
SELECT {_rounded(**{f"{name}_now": "now", f"{name}_in_5": f"max(now) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {back} PRECEDING AND CURRENT ROW)"})} FROM n"""


def rsi_set(bars: str, length: int) -> str:
    return f"""WITH bars AS ({bars}), {", ".join(_wilder_rsi(f"r{n}", "bars", n) for n in (7, 21, 100))}
SELECT {_rounded(RSI7="r7", RSI21="r21", RSI100="r100", RSI21_diff=f"r21 - lag(r21, {length // 2}) OVER {W}")} FROM {_join("bars", ["r7", "r21", "r100"])}"""


def different_ma(bars: str) -> str:
    t = _join("bars", ["e50", "e200"])
    return f"""WITH bars AS ({bars}), {_ema("e50", "bars", '"Close"', 50, True)}, {_ema("e200", "bars", '"Close"', 200, True)},
t AS (SELECT *, {_full("avg", '"Close"', 100)} AS s100, {_full("avg", '"Close"', 200)} AS s200, lag(e50) OVER {W} AS l50, lag(e200) OVER {W} AS l200 FROM {t})
SELECT {_rounded(ema200_diff='CASE WHEN e200 IS NOT NULL THEN greatest(-1, least(1, (e200 - "Close") / ("Close" + 1e-8))) END', ema50_ema200_diff="e50 - e200", sma100_sma200_diff="s100 - s200", ema50_above_ema200="coalesce((e50 > e200)::INT, 0)", ema50_cross_up="coalesce((e50 > e200 AND l50 <= l200)::INT, 0)", ema50_cross_down="coalesce((e50 < e200 AND l50 >= l200)::INT, 0)", ema50_slope="atan(e50 - l50) / pi()", ema200_slope="atan(e200 - l200) / pi()", ema50_slope_vs_ema200="atan(e50 - l50) / pi() - atan(e200 - l200) / pi()")} FROM t"""


def _raw_averages() -> str:
    return ", ".join(_ema(f"r{n}", "bars", '"Close"', n, True) for n in (9, 20, 50, 100, 200))


def _crossings(src: str) -> str:
    pairs = ((9, 20), (20, 50), (50, 100), (100, 200))
    now = ", ".join(f"coalesce(r{a} > r{b}, false) AS u{a}" for a, b in pairs)
    turned = ", ".join(f"(u{a} <> coalesce(lag(u{a}) OVER {W}, false))::INT AS c{a}" for a, _ in pairs)
    last = ", ".join(f"CASE WHEN seq >= 5 THEN max(c{a}) OVER {_frame(5)} ELSE 0 END AS ema{a}_crossed_ema{b}_last5" for a, b in pairs)
    return f"x0 AS (SELECT symbol, seq, {now} FROM {src}), x1 AS (SELECT *, {turned} FROM x0), x AS (SELECT symbol, seq, {last} FROM x1)"


_CROSS = ("ema9_crossed_ema20_last5", "ema20_crossed_ema50_last5", "ema50_crossed_ema100_last5", "ema100_crossed_ema200_last5")


def _different_ema_columns() -> dict[str, str]:
    spans = (20, 50, 100, 200)
    back = {20: 10, 50: 25, 100: 50, 200: 100}
    out = {f"ema{n}_norm": f"e{n}" for n in spans} | {f"ema{n}_slope": f"atan(e{n} - lag(e{n}, 5) OVER {W}) / pi()" for n in spans}
    out |= {"ema20_ema50_diff": "e20 - e50", "ema50_ema100_diff": "e50 - e100", "ema100_ema200_diff": "e100 - e200"} | {f"ema{n}_diff": f"e{n} - lag(e{n}, {back[n]}) OVER {W}" for n in spans}
    return out | {f"price_above_ema{n}": f'coalesce(("Close" > r{n})::INT, 0)' for n in spans} | {c: c for c in _CROSS}


def _different_ema_tables(bars: str) -> str:
    averages = ", ".join(_ema(f"e{n}", "n", "x", n, True) for n in (20, 50, 100, 200))
    every = _join("bars", [f"e{n}" for n in (20, 50, 100, 200)] + [f"r{n}" for n in (9, 20, 50, 100, 200)])
    return f"""bars AS ({bars}), n AS (SELECT symbol, seq, "Close" / nullif({_full("avg", '"Close"', 60)}, 0) AS x FROM bars),
{averages}, {_raw_averages()}, t AS MATERIALIZED (SELECT * FROM {every}), {_crossings("t")}"""


def different_ema(bars: str) -> str:
    return f"WITH {_different_ema_tables(bars)} SELECT {_rounded(**_different_ema_columns())} FROM t JOIN x USING (symbol, seq)"


def different_ema_binary(bars: str) -> str:
    spans = (20, 50, 100, 200)
    every = _join("bars", [f"r{n}" for n in (9, *spans)])
    slopes = ", ".join(f"r{n} - lag(r{n}, 5) OVER {W} AS d{n}" for n in spans)
    columns = {f"price_above_ema{n}": f'coalesce(("Close" > r{n})::INT, 0)' for n in (9, *spans)} | {c: c for c in _CROSS}
    columns |= {f"ema{n}_slope_increased": f"coalesce((d{n} > lag(d{n}, 5) OVER {W})::INT, 0)" for n in spans}
    columns["ema20_and_50_rising_diverging"] = f"coalesce((d20 > 0 AND d50 > 0 AND (r20 - r50) - (lag(r20, 5) OVER {W} - lag(r50, 5) OVER {W}) > 0)::INT, 0)"
    return f"WITH bars AS ({bars}), {_raw_averages()}, t AS MATERIALIZED (SELECT *, {slopes} FROM {every}), {_crossings('t')} SELECT {_rounded(**columns)} FROM t JOIN x USING (symbol, seq)"


def main_indicators(bars: str, rounded: bool = True) -> str:
    """RSI, the averages and the place in the range of the 50 rows before; not rounded, they can be averaged."""
    box = """CASE WHEN lo IS NOT NULL AND seq > 50 AND (hi - lo) / nullif(lo, 0) >= 0.03 THEN greatest(-1, least(1, ("Close" - (hi + lo) / 2) / (hi - lo))) ELSE -1 END"""
    before = "(PARTITION BY symbol ORDER BY seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
    columns = {"RSI21": "q21 / 100", "RSI21_diff": f"(q21 - lag(q21, 5) OVER {W}) / 100", "RSI_50_21_diff": "(q50 - q21) / 100"} | _different_ema_columns() | {"fib_dist_050_last50": box}
    return f"""WITH {_different_ema_tables(bars)}, {_wilder_rsi("q21", "bars", 21)}, {_wilder_rsi("q50", "bars", 50)},
m AS (SELECT *, max("High") OVER {before} AS hi, min("Low") OVER {before} AS lo FROM {_join("t", ["q21", "q50"])} JOIN x USING (symbol, seq))
SELECT {_rounded(**columns) if rounded else "symbol, seq, " + ", ".join(f'{x} AS "{c}"' for c, x in columns.items())} FROM m"""


def vwap_features(bars: str, span: int, slow: int, z: int, rsi: int) -> str:
    day = '(PARTITION BY symbol, "Data"::DATE ORDER BY seq)'
    gain, loss = _full("avg", "greatest(d, d - d)", rsi), _full("avg", "greatest(-d, d - d)", rsi)
    return f"""WITH bars AS ({bars}), {_ema("e", "bars", '"Close"', span)},
v AS (SELECT symbol, seq, sum(e * "Volume") OVER {day} / CASE WHEN sum("Volume") OVER {day} = 0 THEN 1e-8 ELSE sum("Volume") OVER {day} END AS v FROM {_join("bars", ["e"])}),
{_ema("s", "v", "v", slow)}, {_ema("f", "v", "v", 5)},
t AS (SELECT *, (s - f) / (s + 1e-8) AS norm, e - s AS dist, e - lag(e) OVER {W} AS d FROM {_join("bars", ["e", "s", "f"])}),
u AS (SELECT *, {_full("avg", "norm", z)} AS nm, {_full("stddev_samp", "norm", z)} AS ns, {_full("stddev_samp", '"Close"', 100)} AS cs, {_full("avg", "dist", 100)} AS dm, {_full("stddev_samp", "dist", 100)} AS ds, {gain} AS g, {loss} AS l FROM t)
SELECT {_rounded(vwap_ema6h_norm="norm", vwap_ema6h_zscore="(norm - nm) / CASE WHEN ns = 0 THEN 1e-8 ELSE ns END", vwap_price_distance_direct="CASE WHEN cs IS NOT NULL THEN dist / greatest(cs, 1e-8) END", vwap_price_distance="(dist - dm) / (ds + 1e-8)", RSI_vwap_divergence="(100 - 100 / (1 + g / (l + 1e-8)) - 50) / 50 - sign(norm)")} FROM u"""


def combined(bars: str, fast: int, slow: int, cycle: int, fisher: int, atr: int, mult: float) -> str:
    tail = lambda c: f"(least(greatest({c}, quantile_cont({c}, 0.01) OVER (PARTITION BY symbol)), quantile_cont({c}, 0.99) OVER (PARTITION BY symbol)))"
    return f"""WITH {_tr(bars)}, {_ema("a", "bars", '"Close"', fast)}, {_ema("b", "bars", '"Close"', slow)},
m AS MATERIALIZED (SELECT symbol, seq, a - b AS m FROM {_join("bars", ["a", "b"])}), {_ema("g", "m", "m", cycle)},
raw AS MATERIALIZED (SELECT symbol, seq, CASE WHEN abs(g) < 1e-10 THEN 0 ELSE greatest(-1, least(1, (m - g) / g)) END AS x FROM {_join("m", ["g"])}), {_ema("stc", "raw", "x", cycle)},
h AS (SELECT symbol, seq, ("High" + "Low") / 2 AS h FROM bars), r AS (SELECT *, min(h) OVER {_frame(fisher)} AS lo, max(h) OVER {_frame(fisher)} AS hi FROM h),
p AS (SELECT symbol, seq, CASE WHEN hi - lo < 1e-10 THEN 0 ELSE greatest(-0.999, least(0.999, 2 * (h - lo) / (hi - lo) - 1)) END AS p FROM r), q AS MATERIALIZED (SELECT symbol, seq, ln((1 + p) / (1 - p)) / 2 AS q FROM p), {_ema("fis", "q", "q", fisher)},
{_ema("atr", "t", "tr", atr)}, {_ema("mid", "bars", '("High" + "Low" + "Close") / 3', atr)},
k AS (SELECT symbol, seq, stc AS "STC", fis AS "Fisher", 2 * {mult} * atr / mid AS "KeltnerWidth" FROM {_join("bars", ["stc", "fis", "atr", "mid"])}),
c AS (SELECT symbol, seq, {", ".join(f'{tail(f'"{c}"')} AS "{c}"' for c in ("STC", "Fisher", "KeltnerWidth"))} FROM k)
SELECT {_rounded(**{c: f'("{c}" - avg("{c}") OVER (PARTITION BY symbol)) / (stddev_samp("{c}") OVER (PARTITION BY symbol) + 1e-10)' for c in ("STC", "Fisher", "KeltnerWidth")})} FROM c"""


def _fisher(period: int) -> str:
    before = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {period} PRECEDING AND 1 PRECEDING)"
    return f"""f0 AS (SELECT symbol, seq, ("High" + "Low") / 2 AS h FROM bars), f1 AS (SELECT symbol, seq, CASE WHEN seq > {period} THEN (h - min(h) OVER {before}) / (max(h) OVER {before} - min(h) OVER {before} + 1e-8) END AS x FROM f0),
f2 AS (SELECT symbol, seq, (1 + x) / nullif(1 - x + 1e-8, 0) AS q FROM f1), f AS (SELECT symbol, seq, CASE WHEN q > 0 THEN greatest(-1, least(1, ln(q) / 2)) END AS fisher FROM f2)"""


def fisher(bars: str, period: int) -> str:
    return f"WITH bars AS ({bars}), {_fisher(period)} SELECT {_rounded(fisher='fisher')} FROM f"


def all_features(bars: str) -> str:
    before = lambda n: f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    weight = "pow(1 - 1.0::DOUBLE / 14, b.seq - a.seq)"
    return f"""WITH {_tr(bars)}, {_fisher(10)}, {_wilder_rsi("r", "bars", 14)},
k AS MATERIALIZED (SELECT b.symbol, b.seq, sum({weight} * a.tr) / sum({weight}) AS y FROM t AS b JOIN t AS a ON a.symbol = b.symbol AND a.seq <= b.seq AND a.seq > 1 WHERE b.seq > 14 GROUP BY b.symbol, b.seq),
u AS (SELECT *, CASE WHEN seq > 9 THEN (max("High") OVER {before(9)} + min("Low") OVER {before(9)}) / 2 END AS ten, lag("Close") OVER {W} AS c1, CASE WHEN count(r) OVER {before(5)} = 5 THEN min(r) OVER {before(5)} END AS rl,
  CASE WHEN seq > 5 THEN min("Low") OVER {before(5)} END AS pl, CASE WHEN seq > 10 THEN min("Low") OVER {before(10)} END AS l10, CASE WHEN seq > 12 THEN avg("Close") OVER {before(12)} END AS m12, CASE WHEN count(k) OVER {before(12)} = 12 THEN avg(k) OVER {before(12)} END AS km
  FROM {_join("bars", ["r", "k"])} JOIN f USING (symbol, seq))
SELECT {_rounded(tenkan_breakout=f'coalesce(("Close" > ten AND c1 <= lag(ten) OVER {W})::INT, 0)', bullish_div=f"coalesce((rl > lag(rl) OVER {W} AND pl < lag(pl) OVER {W})::INT, 0)", fisher="fisher", fake_bull='coalesce(("Low" < l10 AND "Close" > l10)::INT, 0)', h1_trend='CASE WHEN m12 IS NOT NULL THEN greatest(-1, least(1, ("Close" - m12) / (m12 + 1e-8))) END', atr_ratio="CASE WHEN km IS NOT NULL THEN greatest(0, least(2, k / (km + 1e-8))) / 2 END")} FROM u"""


def volume_profile(bars: str, window: int, lag: int, change: int, sma: int) -> str:
    z = lambda c: f"({c} - {_full('avg', c, sma)}) / nullif({_full('stddev_samp', c, sma)}, 0)"
    last = {"VP_Norm_Lag": f"lag(z1, {lag}) OVER {W}"} if lag else {}
    return f"""WITH bars AS ({bars}), v AS (SELECT symbol, seq, ("High" + "Low" + "Close") / 3 * "Volume" AS pv, "Volume" AS v FROM bars),
p AS (SELECT symbol, seq, {_full("sum", "pv", window)} / nullif({_full("sum", "v", window)}, 0) AS p FROM v),
s AS (SELECT *, {_full("avg", "p", sma)} AS s, p / nullif(lag(p, {change}) OVER {W}, 0) - 1 AS c FROM p),
z AS (SELECT symbol, seq, {z("p")} AS z1, {z("s")} AS z2, {z("c")} AS z3 FROM s)
SELECT {_rounded(VP_Norm="z1", VP_SMA_Norm="z2", VP_Change_Norm="z3", **last)} FROM z"""


def close_windows(bars: str, window: int) -> str:
    before = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return f"""WITH bars AS ({bars}), w AS (SELECT symbol, seq, list("Close") OVER {before} AS l FROM bars), c AS (SELECT *, list_min(l) AS lo, list_max(l) AS hi FROM w)
SELECT {_rounded(**{f"close_win_{k}": f"CASE WHEN len(l) = {window} THEN 2 * ((l[{k + 1}] - lo) / (hi - lo + 1e-8)) - 1 END" for k in range(window)})} FROM c"""


def atr_rsi_weight(bars: str, windows: tuple[int, ...], ema: bool, normalize: bool, velocity: bool, acceleration: bool, rsi: int, slope: int) -> str:
    def mean(w: int) -> str:
        if not ema:
            return f"a{w} AS MATERIALIZED (SELECT symbol, seq, avg(tr) OVER {_frame(w)} AS y FROM t)"
        weight = f"pow(1 - 2.0::DOUBLE / ({w} + 1), b.seq - a.seq)"
        return f"a{w} AS MATERIALIZED (SELECT b.symbol, b.seq, sum({weight} * coalesce(a.tr, 0)) / sum({weight}) AS y FROM t AS b JOIN t AS a ON a.symbol = b.symbol AND a.seq <= b.seq GROUP BY b.symbol, b.seq)"

    name = {w: f"atr_{w}_norm" if normalize else f"atr_{w}" for w in windows}
    columns = {name[w]: f"n{w}" for w in windows}
    if normalize:
        columns |= {f"{name[w]}_rsi_weight": f"n{w} * weight" for w in windows}
    if velocity:
        columns |= {f"{name[w]}_velocity": f"v{w}" for w in windows}
    if velocity and acceleration:
        columns |= {f"{name[w]}_acceleration": f"v{w} - lag(v{w}) OVER {W}" for w in windows}
    shown = ", ".join(f'100 * a{w} / "Close" AS n{w}' if normalize else f"a{w} AS n{w}" for w in windows)
    return f"""WITH {_tr(bars)}, {", ".join(map(mean, windows))},
g AS (SELECT symbol, seq, avg(coalesce(greatest(d, d - d), 0)) OVER {_frame(rsi)} AS g, avg(coalesce(greatest(-d, d - d), 0)) OVER {_frame(rsi)} AS l FROM t),
r AS (SELECT symbol, seq, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END AS r FROM g),
s AS (SELECT symbol, seq, r / nullif((r - lag(r, {slope}) OVER {W}) / {slope} + 1e-8, 0) AS weight FROM r),
n AS (SELECT symbol, seq, weight, {shown} FROM {_join("bars", [f"a{w}" for w in windows])} JOIN s USING (symbol, seq)),
v AS (SELECT *, {", ".join(f"(n{w} - lag(n{w}) OVER {W}) / nullif(lag(n{w}) OVER {W}, 0) AS v{w}" for w in windows)} FROM n)
SELECT {_rounded(**columns)} FROM v"""


def atr_position(bars: str, lookback: int, atr: int, price: str) -> str:
    return f"""WITH bars AS ({bars}), b AS (SELECT symbol, seq, "{price}" AS p, greatest("High" - "Low", abs("High" - lag("{price}") OVER {W}), abs("Low" - lag("{price}") OVER {W})) AS tr FROM bars),
m AS (SELECT symbol, seq, p, {_full("avg", "p", lookback)} AS m, {_full("avg", "tr", atr)} AS a FROM b)
SELECT {_rounded(atr_position="CASE WHEN m IS NOT NULL AND a IS NOT NULL THEN greatest(-1, least(1, (p - m) / (2 * a + 1e-8))) END")} FROM m"""


def price_acceleration(bars: str, window: int) -> str:
    return f"""WITH bars AS ({bars}), d AS (SELECT symbol, seq, "Close" - lag("Close") OVER {W} AS d, "Close" / nullif(lag("Close") OVER {W}, 0) - 1 AS p FROM bars),
a AS (SELECT *, d - lag(d) OVER {W} AS a FROM d), m AS (SELECT symbol, seq, {_full("avg", "a", window)} AS m, stddev_samp(p) OVER (PARTITION BY symbol) AS s FROM a)
SELECT {_rounded(Acceleration="CASE WHEN s > 0 THEN tanh(m / s) ELSE m * 0 END")} FROM m"""


# Means, ranges and bands ---------------------------------------------------------------------------------------------


def _shifted(fn: str, x: str, w: int) -> str:
    """``fn`` over the w rows before."""
    frame = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {frame} = {w} THEN {fn}({x}) OVER {frame} END"


def rsi_of_means(bars: str, period: int) -> str:
    return f"""WITH bars AS ({bars}), d AS (SELECT symbol, seq, coalesce("Close" - lag("Close") OVER {W}, 0) AS d FROM bars),
m AS (SELECT symbol, seq, {_full("avg", "greatest(d, 0)", period)} AS g, {_full("avg", "greatest(-d, 0)", period)} AS l FROM d)
SELECT {_rounded(rsi_manual="100 - 100 / (1 + g / (l + 1e-8))")} FROM m"""


def money_flow(bars: str, length: int) -> str:
    return f"""WITH bars AS ({bars}), x AS (SELECT symbol, seq, "Volume" AS v, (2 * "Close" - "High" - "Low") / ("High" - "Low" + 1e-8) * "Volume" AS f FROM bars),
m AS (SELECT symbol, seq, {_full("sum", "f", length)} AS f, {_full("sum", "v", length)} AS v FROM x)
SELECT {_rounded(cmf_manual="f / (v + 1e-8)")} FROM m"""


def liquidity_imbalance(bars: str, period: int) -> str:
    return f"""WITH bars AS ({bars}), x AS (SELECT symbol, seq, ("Close" - "High" + ("Close" - "Low")) / ("High" - "Low" + 1e-10) * ln(1 + "Volume") AS x FROM bars)
SELECT {_rounded(liq_imb="x / (m + 1e-10)")} FROM (SELECT *, {_full("max", "abs(x)", period)} AS m FROM x)"""


def tenkan_breakout(bars: str, period: int) -> str:
    return f"""WITH bars AS ({bars}), t AS (SELECT symbol, seq, "Close" AS c, ({_shifted("max", '"High"', period)} + {_shifted("min", '"Low"', period)}) / 2 AS t FROM bars),
l AS (SELECT *, lag(c) OVER {W} AS c1, lag(t) OVER {W} AS t1 FROM t)
SELECT {_rounded(tenkan_sen="t", tenkan_breakout="coalesce((c > t AND c1 <= t1)::INT, 0)")} FROM l"""


def false_breakout(bars: str, window: int) -> str:
    return f"""WITH bars AS ({bars}), r AS (SELECT symbol, seq, "Low", "Close", {_shifted("max", '"High"', window)} AS hi, {_shifted("min", '"Low"', window)} AS lo FROM bars)
SELECT {_rounded(high_prev="hi", low_prev="lo", fake_bull='coalesce(("Low" < lo AND "Close" > lo)::INT, 0)')} FROM r"""


def trend_of_mean(bars: str, period: int) -> str:
    return f"""WITH bars AS ({bars}), m AS (SELECT symbol, seq, "Close" AS c, {_shifted("avg", '"Close"', period)} AS m FROM bars)
SELECT {_rounded(h1_trend="CASE WHEN m IS NOT NULL THEN greatest(-1, least(1, (c - m) / (m + 1e-8))) END")} FROM m"""


def macd(bars: str, fast: int, slow: int, signal: int, window: int) -> str:
    return f"""WITH bars AS ({bars}), {_ema("a", "bars", '"Close"', fast)}, {_ema("b", "bars", '"Close"', slow)},
m AS MATERIALIZED (SELECT symbol, seq, a - b AS m FROM {_join("bars", ["a", "b"])}), {_ema("s", "m", "m", signal)},
h AS (SELECT symbol, seq, m - s AS h FROM {_join("m", ["s"])}), r AS (SELECT *, {_full("min", "h", window)} AS lo, {_full("max", "h", window)} AS hi FROM h)
SELECT {_rounded(macd_norm="2 * (h - lo) / (hi - lo + 1e-8) - 1")} FROM r"""


def volume_macd(bars: str, fast: int, slow: int, signal: int, normalize: bool) -> str:
    """Before the averages exist, the first value counts; the scale is the largest value of a symbol."""
    mean = lambda n: f"""{_full("sum", '"Close" * "Volume"', n)} / CASE WHEN {_full("sum", '"Volume"', n)} = 0 THEN 1e-8 ELSE {_full("sum", '"Volume"', n)} END"""
    first = {c: f"coalesce({c}, first_value({c} IGNORE NULLS) OVER {W[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)" for c in "msh"}
    top = {c: f" / (max(abs({c})) OVER (PARTITION BY symbol) + 1e-8)" if normalize else "" for c in "msh"}
    return f"""WITH bars AS ({bars}), v AS MATERIALIZED (SELECT symbol, seq, {mean(fast)} - {mean(slow)} AS m FROM bars), {_ema("s", "v", "m", signal)},
h AS (SELECT symbol, seq, m, s, m - s AS h FROM {_join("v", ["s"])}), f AS (SELECT symbol, seq, {", ".join(f"{x} AS {c}" for c, x in first.items())} FROM h)
SELECT {_rounded(vw_macd="m" + top["m"], vw_signal="s" + top["s"], vw_hist="h" + top["h"])} FROM f"""


def oscillator_of_means(bars: str, short: int, long: int, percent: bool) -> str:
    mean = lambda n: f'avg("Close") OVER {_frame(n)}'
    return f"""WITH bars AS ({bars}), m AS (SELECT symbol, seq, ({mean(short)} - {mean(long)}) {'/ nullif("Close", 0) * 100' if percent else ""} AS y FROM bars) SELECT {_rounded(EWO="y")} FROM m"""


def volume_features(bars: str, w: int) -> str:
    """The skewness is the bias-corrected one of the list of values."""
    at = "list_sum(list_transform(l, lambda v: pow(v - m, {k})))"
    skew = f"CASE WHEN {at.format(k=2)} / {w} > 1e-9 THEN {w} * sqrt({w} - 1.0::DOUBLE) / ({w} - 2) * {at.format(k=3)} / pow({at.format(k=2)}, 1.5) ELSE 0 END"
    return f"""WITH bars AS ({bars}), l AS (SELECT symbol, seq, "Volume" AS v, list("Volume"::DOUBLE) OVER {_frame(w)} AS l FROM bars),
m AS (SELECT symbol, seq, v, l, list_avg(l) AS m, list_median(l) AS md, list_stddev_samp(l) AS s FROM l WHERE len(l) = {w}),
y AS (SELECT symbol, seq, greatest(-5, least(5, {skew})) / 5 AS k, greatest(0, least(5, s / (m + 1e-9))) / 5 AS c, greatest(0, least(3, (v - md) / (md + 1e-9))) / 3 AS p FROM m)
SELECT {_rounded(**{f"volume_skew_{w}": "k", f"volume_volatility_{w}": "c", f"volume_spike_{w}": "p"})} FROM bars LEFT JOIN y USING (symbol, seq)"""


def candle_volume(bars: str, w: int) -> str:
    columns = {}
    for name, x in (("prod", "p"), ("hmean", "h")):
        y = f"({x} / ({x}m + 1e-8) / (v / (vm + vd + 1e-8) + 1e-8))"
        columns |= {f"candle_vol_size_{name}": y, f"candle_vol_size_{name}_tanh": f"tanh({y})", f"candle_vol_size_{name}_log": f"sign({y}) * ln(1 + abs({y}))"}
    return f"""WITH bars AS ({bars}), b AS (SELECT symbol, seq, "Volume" AS v, abs("Close" - "Open") AS body, "High" - "Low" AS full_size FROM bars),
s AS (SELECT symbol, seq, v, body * full_size AS p, body * full_size / (body + full_size + 1e-8) AS h FROM b),
m AS (SELECT *, {_full("avg", "p", w)} AS pm, {_full("avg", "h", w)} AS hm, {_full("avg", "v", w)} AS vm, {_full("median", "v", w)} AS vd FROM s)
SELECT {_rounded(**columns)} FROM m"""


def choppiness(bars: str, period: int) -> str:
    y = f"(100 * log10((s + 1e-8) / (hi - lo + 1e-8)) / log10({period} + 1e-8) - 20) / (61.8 - 20)"
    return f"""WITH {_tr(bars)}, m AS (SELECT symbol, seq, {_full("sum", "tr", period)} AS s, {_full("max", '"High"', period)} AS hi, {_full("min", '"Low"', period)} AS lo FROM t)
SELECT {_rounded(**{f"choppiness_index_{period}": f"CASE WHEN s IS NOT NULL THEN greatest(0, least(1, {y})) END"})} FROM m"""


def bollinger(bars: str, period: int, width: float) -> str:
    return f"""WITH bars AS ({bars}), m AS (SELECT symbol, seq, "Close" AS c, {_full("avg", '"Close"', period)} AS m, {_full("stddev_samp", '"Close"', period)} AS s FROM bars)
SELECT {_rounded(**{f"bb_z_{period}": "(c - m) / (s + 1e-8)", f"bb_width_{period}": f"(m + {width} * s - (m - {width} * s)) / (m + 1e-8)"})} FROM m"""


def rsi_slope(bars: str, length: int, lookback: int, strength: float) -> str:
    frame = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    return f"""WITH bars AS ({bars}), {_wilder_rsi("r", "bars", length)}, x AS (SELECT symbol, seq, r FROM {_join("bars", ["r"])})
SELECT {_rounded(rsi_slope=f"CASE WHEN count(r) OVER {frame} = {lookback} THEN tanh(regr_slope(r, seq) OVER {frame} * {strength}) END")} FROM x"""


def middle_of_range(bars: str, window: int, threshold: float) -> str:
    return f"""WITH bars AS ({bars}), r AS (SELECT symbol, seq, "Close" AS c, {_shifted("max", '"High"', window)} AS hi, {_shifted("min", '"Low"', window)} AS lo FROM bars)
SELECT {_rounded(fib_dist_050_last50=f"CASE WHEN lo <> 0 AND (hi - lo) / lo >= {threshold} THEN greatest(-1, least(1, (c - (lo + 0.5 * (hi - lo))) / (hi - lo))) ELSE -1 END")} FROM r"""


def fibo(bars: str, period: int) -> str:
    return f"""WITH bars AS ({bars}), r AS (SELECT symbol, seq, "Close" AS c, {_full("max", '"High"', period)} AS hi, {_full("min", '"Low"', period)} AS lo FROM bars)
SELECT {_rounded(**{f"fibo_dinamic_{period}": "CASE WHEN hi IS NOT NULL THEN greatest(-1, least(1, (c - (lo + 0.5 * (hi - lo))) / (hi - lo + 1e-8))) END"})} FROM r"""


def trix_elder(bars: str, trix: int, span: int) -> str:
    return f"""WITH bars AS ({bars}), {_ema("a", "bars", '"Close"', trix)}, {_ema("b", "a", "y", trix)}, {_ema("c", "b", "y", trix)}, {_ema("e", "bars", '"Close"', span)},
x AS (SELECT symbol, seq, (c / lag(c) OVER {W} - 1) * 100 AS t, "High" - e AS u, "Low" - e AS d FROM {_join("bars", ["c", "e"])}),
f AS (SELECT symbol, seq, coalesce(t, lead(t) OVER {W}, 0) AS t, u, d FROM x)
SELECT {_rounded(**{n: f"{x} / (max(abs({x})) OVER (PARTITION BY symbol) + 1e-8)" for n, x in (("TRIX", "t"), ("BullPower", "u"), ("BearPower", "d"))})} FROM f"""


def atr_trailing(bars: str, period: int, multiplier: float) -> str:
    return f"""WITH {_tr(bars)}, a AS (SELECT symbol, seq, "Close" AS c, avg(CASE WHEN seq > 1 THEN tr END) OVER {_frame(period)} AS a FROM t),
s AS (SELECT *, c - {multiplier} * a AS stop FROM a), g AS (SELECT *, CASE WHEN c > lag(stop) OVER {W} THEN 1 ELSE -1 END AS g FROM s)
SELECT {_rounded(TrailingStop="stop", ATR_Signal="g", ATR_Signal_Norm="(g + 1) / 2", ATR_x10="a * 10")} FROM g"""


def hidden_divergence(bars: str, period: int) -> str:
    return f"""WITH bars AS ({bars}), d AS (SELECT symbol, seq, "Close" AS c, coalesce("Close" - lag("Close") OVER {W}, 0) AS d FROM bars),
m AS (SELECT symbol, seq, c, {_full("avg", "greatest(d, 0)", period)} AS g, {_full("avg", "greatest(-d, 0)", period)} AS l FROM d),
r AS (SELECT symbol, seq, c - lag(c) OVER {W} AS dc, 100 - 100 / (1 + g / (l + 1e-10)) AS r FROM m), x AS (SELECT *, r - lag(r) OVER {W} AS dr FROM r)
SELECT {_rounded(hidden_div="coalesce((dc > 0 AND dr < 0)::INT, 0) - coalesce((dc < 0 AND dr > 0)::INT, 0)")} FROM x"""


def divergence_of_lows(bars: str, window: int, back: int) -> str:
    return f"""WITH bars AS ({bars}), {_wilder_rsi("r", "bars", window)}, j AS (SELECT symbol, seq, "Low" AS low, r FROM {_join("bars", ["r"])}),
m AS (SELECT symbol, seq, {_shifted("min", "r", back)} AS a, {_shifted("min", "low", back)} AS b FROM j)
SELECT {_rounded(rsi_low="a", price_low="b", bullish_div=f"coalesce((a > lag(a) OVER {W} AND b < lag(b) OVER {W})::INT, 0)")} FROM m"""


def keltner(bars: str, base: int, base_mult: float, alt: int, alt_mult: float, shift: int) -> str:
    return f"""WITH {_tr(bars)}, p AS MATERIALIZED (SELECT symbol, seq, tr, ("High" + "Low" + "Close") / 3 AS p FROM t), q AS MATERIALIZED (SELECT symbol, seq, lag(p, {shift}) OVER {W} AS p FROM p),
{_ema("t5", "p", "tr", 5)}, {_ema("p5", "p", "p", 5)}, {_ema("tb", "p", "tr", base)}, {_ema("pb", "p", "p", base)}, {_ema("ta", "p", "tr", 2 * alt)}, {_ema("pa", "q", "p", alt)},
k AS (SELECT symbol, seq, 2.0::DOUBLE * t5 / (p5 + 1e-8) AS k, 2.0::DOUBLE * {base_mult} * tb / (pb + 1e-8) AS a, {alt_mult}::DOUBLE * ta / (pa + 1e-8) AS b FROM {_join("p", ["t5", "p5", "tb", "pb", "ta", "pa"])})
SELECT {_rounded(KeltnerWidth_v2_norm="(a - k) / (a + 1e-8)", KeltnerWidth_v3_norm="(b - k) / (b + 1e-8)")} FROM k"""


def volume_dominance(bars: str, window: int) -> str:
    return f"""WITH bars AS ({bars}), s AS (SELECT symbol, seq, {_full("sum", """(CASE WHEN "Close" > "Open" THEN "Volume" WHEN "Close" < "Open" THEN -"Volume" ELSE 0 END)""", window)} AS s FROM bars)
SELECT {_rounded(**{f"bullish_volume_dominance_{window}": "coalesce((s > 0)::INT, 0)"})} FROM s"""


def _day_price() -> str:
    """(symbol, seq, c, w): the close and the day's volume-weighted close so far."""
    day = '(PARTITION BY symbol, "Data"::DATE ORDER BY seq)'
    return f"""w AS MATERIALIZED (SELECT symbol, seq, "Close" AS c, sum("Close" * "Volume") OVER {day} / CASE WHEN sum("Volume") OVER {day} = 0 THEN 1e-8 ELSE sum("Volume") OVER {day} END AS w FROM bars)"""


def day_prices(bars: str, slope: int, name: str) -> str:
    return f"""WITH bars AS ({bars}), {_day_price()}, {_ema("slow", "w", "w", 360)}, {_ema("quick", "w", "w", 5)}
SELECT {_rounded(**{"vwap_intraday_norm": "(w - quick) / (w + 1e-8)", "vwap_ema6h_norm": "(slow - quick) / (slow + 1e-8)", name: f"coalesce(w / nullif(lag(w, {slope}) OVER {W}, 0) - 1, 0) * 100"})} FROM {_join("w", ["slow", "quick"])}"""


def above_day_prices(bars: str) -> str:
    return f"""WITH bars AS ({bars}), {_day_price()}, {_ema("slow", "w", "w", 360)}
SELECT {_rounded(price_above_vwap_intraday="(c > w)::INT", price_above_vwap_ema6h="(c > slow)::INT")} FROM {_join("w", ["slow"])}"""


def wilder_rsi(bars: str, n: int) -> str:
    return f"""WITH bars AS ({bars}), {_wilder_rsi("r", "bars", n)} SELECT {_rounded(**{f"RSI_{n}": "r"})} FROM {_join("bars", ["r"])}"""


def rsi_and_range(bars: str, window: int, stoch: int, smooth: int) -> str:
    return f"""WITH {_tr(bars)}, m AS (SELECT symbol, seq, {_full("avg", "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0 END", window)} AS g, {_full("avg", "CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0 END", window)} AS l,
  100 * ("Close" - {_full("min", '"Low"', stoch)}) / ({_full("max", '"High"', stoch)} - {_full("min", '"Low"', stoch)} + 1e-8) AS k FROM t),
y AS (SELECT symbol, seq, 0.5 * ((100 - 100 / (1 + g / (l + 1e-8))) / 50 - 1) + 0.5 * ({_full("avg", "k", smooth)} / 50 - 1) AS y FROM m)
SELECT {_rounded(rsi_stoch_hybrid="CASE WHEN y IS NOT NULL THEN greatest(-1, least(1, y)) END")} FROM y"""


def atr_normalized(bars: str, windows: tuple[int, ...], ema: bool, norm: int, step: int) -> str:
    """The average weighs all true ranges so far by powers, which are divided by their sum."""
    keep = lambda n: f"pow(1 - 2.0::DOUBLE / ({n} + 1), b.seq - a.seq)"
    weighed = ", ".join(f"sum({keep(n)} * a.tr) / sum({keep(n)}) AS a{n}" for n in windows)
    plain = ", ".join(f"avg(tr) OVER {_frame(n)} AS a{n}" for n in windows)
    averages = f"SELECT b.symbol, b.seq, {weighed} FROM t AS b JOIN t AS a ON a.symbol = b.symbol AND a.seq <= b.seq GROUP BY b.symbol, b.seq" if ema else f"SELECT symbol, seq, {plain} FROM t"
    scaled = ", ".join(f"2 * (a{n} - min(a{n}) OVER {_frame(norm)}) / (max(a{n}) OVER {_frame(norm)} - min(a{n}) OVER {_frame(norm)} + 1e-8) - 1 AS n{n}" for n in windows)
    speeds = ", ".join(f"(n{n} - lag(n{n}, {step}) OVER {W}) / {step} AS v{n}" for n in windows)
    columns = {}
    for n in windows:
        columns |= {f"atr_{n}_norm": f"n{n}", f"atr_{n}_norm_velocity": f"v{n}", f"atr_{n}_norm_acceleration": f"v{n} - lag(v{n}, {step}) OVER {W}"}
    return f"""WITH {_tr(bars)}, a AS MATERIALIZED ({averages}), n AS (SELECT symbol, seq, {scaled} FROM a), v AS (SELECT *, {speeds} FROM n) SELECT {_rounded(**columns)} FROM v"""


def volume_flags(bars: str, obv: int, ad: int, force: int, vol: int, kind: str) -> str:
    mean = _ema("m", "x", "v", vol) if kind == "ema" else f"m AS (SELECT symbol, seq, {_full('avg', 'v', vol)} AS y FROM x)"
    names = {f"obv_gt_ema{obv}": "o > e1", f"ad_gt_ema{ad}": "a > e2", f"force_gt_ema{force}": "f > e3", f"volume_gt_{kind}{vol}": "v > m"}
    return f"""WITH bars AS ({bars}), d AS (SELECT *, "Close" - lag("Close") OVER {W} AS d FROM bars),
x AS MATERIALIZED (SELECT symbol, seq, "Volume" AS v, d * "Volume" AS f, sum(CASE WHEN d > 0 THEN "Volume" WHEN d < 0 THEN -"Volume" ELSE 0 END) OVER {W} AS o,
  sum((("Close" - "Low") - ("High" - "Close")) / CASE WHEN "High" = "Low" THEN 1e-8 ELSE "High" - "Low" END * "Volume") OVER {W} AS a FROM d),
{_ema("e1", "x", "o", obv)}, {_ema("e2", "x", "a", ad)}, {_ema("e3", "x", "f", force)}, {mean}
SELECT {_rounded(**{n: f"coalesce(({c})::INT, 0)" for n, c in names.items()})} FROM {_join("x", ["e1", "e2", "e3", "m"])}"""


def ichimoku(bars: str, tenkan: int, kijun: int, senkou: int, suffix: str = "") -> str:
    middle = lambda n: f'(max("High") OVER {_frame(n)} + min("Low") OVER {_frame(n)}) / 2'
    lines = {"tenkan_sen": "t", "kijun_sen": "k", "senkou_span_a": f"lag((t + k) / 2) OVER {W}", "senkou_span_b": f"lag(s) OVER {W}"}
    return f"""WITH bars AS ({bars}), m AS (SELECT symbol, seq, "Close" AS c, {middle(tenkan)} AS t, {middle(kijun)} AS k, {middle(senkou)} AS s FROM bars)
SELECT {_rounded(**{f"{n}_norm{suffix}": f"({x}) / c" for n, x in lines.items()})} FROM m"""


def lagged(bars: str, column: str, ratios: tuple[int, ...], logs: tuple[int, ...]) -> str:
    """Every row is taken with the rows before it; a mean counts if all of its rows are there."""
    at = lambda k: f"max(a.x) FILTER (WHERE a.seq = b.seq - {k})"
    mean = lambda k, w: f"CASE WHEN b.seq > {k + w - 1} THEN avg(a.x) FILTER (WHERE a.seq <= b.seq - {k} AND a.seq > b.seq - {k + w}) END"
    columns = {f"{column}_lag{k}_diff_ratio": f"({at(k)} - {at(k + 1)}) / ({mean(k + 1, 20)} + 1e-8)" for k in ratios}
    columns |= {f"{column}_log_lag{k}": f"ln(nullif(abs({at(k)}), 0) / ({mean(k, 100)} + 1e-8))" for k in logs}
    each = ", ".join(f'{x} AS "{c}"' for c, x in columns.items())
    return f"""WITH bars AS ({bars}), x AS MATERIALIZED (SELECT symbol, seq, "{column}" AS x FROM bars),
y AS (SELECT b.symbol, b.seq, {each} FROM x AS b JOIN x AS a ON a.symbol = b.symbol AND a.seq <= b.seq AND a.seq > b.seq - 120 GROUP BY b.symbol, b.seq)
SELECT {_rounded(**{c: f'"{c}"' for c in columns})} FROM y"""


def line_end(bars: str, n: int) -> str:
    """The end of a least-squares line is three times the linearly weighted mean less twice the plain one."""
    return f"""WITH bars AS ({bars}), l AS (SELECT symbol, seq, "Close" AS c, list("Close"::DOUBLE) OVER {_frame(n)} AS l FROM bars),
y AS (SELECT symbol, seq, CASE WHEN len(l) = {n} THEN (3 * 2 * list_sum(list_transform(range(1, {n} + 1), lambda i: i * l[i])) / ({n} * ({n} + 1)) - 2 * list_avg(l)) / (c + 1e-8) - 1 END AS y FROM l)
SELECT {_rounded(linreg="y", linreg_lag=f"lag(y, {n}) OVER {W}")} FROM y"""


def _atr_sums(n: int) -> str:
    """(symbol, seq, y): true ranges so far, weighed by powers, over the sum of the weights."""
    keep = f"pow(1 - 2.0::DOUBLE / ({n} + 1), b.seq - a.seq)"
    return f"atr AS MATERIALIZED (SELECT b.symbol, b.seq, sum({keep} * a.tr) / sum({keep}) AS y FROM t AS b JOIN t AS a ON a.symbol = b.symbol AND a.seq <= b.seq GROUP BY b.symbol, b.seq)"


def atr_slope(bars: str, length: int, lookback: int, strength: float) -> str:
    frame = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    return f"""WITH {_tr(bars)}, {_atr_sums(length)}
SELECT {_rounded(atr_slope=f"CASE WHEN count(y) OVER {frame} = {lookback} THEN tanh(regr_slope(y, seq) OVER {frame} * {strength}) END")} FROM atr"""


def atr_from_mean(bars: str, length: int, span: int) -> str:
    return f"""WITH {_tr(bars)}, {_atr_sums(length)}, {_ema("e", "atr", "y", span, True)}, j AS (SELECT symbol, seq, atr.y AS a, e FROM {_join("atr", ["e"])})
SELECT {_rounded(atr_ema_norm="CASE WHEN e IS NOT NULL THEN greatest(-1, least(1, (e - a) / (a + 1e-5))) END")} FROM j"""


def volume_acceleration(bars: str) -> str:
    change = lambda k: f"(v - lag(v, {k}) OVER {W}) - (lag(v) OVER {W} - lag(v, {k + 1}) OVER {W})"
    return f"""WITH bars AS ({bars}), m AS (SELECT symbol, seq, "Volume" AS v, {_full("avg", '"Volume"', 20)} AS m FROM bars)
SELECT {_rounded(accel_volume=f"({change(5)}) / (m + 1e-8)", accel_volume_fast=f"({change(1)}) / (m + 1e-8)")} FROM m"""


def _atr_24(bars: str) -> str:
    """The ATR of 24 rows as x, from -1 to 1 over the last 100 rows."""
    f = _frame(100)
    return f"WITH {_tr(bars)}, {_atr_sums(24)}, n AS MATERIALIZED (SELECT symbol, seq, 2 * (y - min(y) OVER {f}) / (max(y) OVER {f} - min(y) OVER {f} + 1e-8) - 1 AS x FROM atr)"


def atr_changes(bars: str) -> str:
    name = "atr_24_norm"
    columns = {name: "x", f"{name}_rolling_std_10": _full("stddev_samp", "x", 10), f"{name}_rolling_std_30": _full("stddev_samp", "x", 30), f"{name}_diff_1": "d", f"{name}_pct_change": "p"}
    columns |= {f"{name}_rolling_diff_mean_10": _full("avg", "d", 10), f"{name}_pct_change_rolling_mean_10": _full("avg", "p", 10), f"{name}_diff2": f"d - lag(d) OVER {W}"}
    return f"{_atr_24(bars)}, c AS (SELECT *, x - lag(x) OVER {W} AS d, x / nullif(lag(x) OVER {W}, 0) - 1 AS p FROM n) SELECT {_rounded(**columns)} FROM c"


def atr_extremes(bars: str, window: int) -> str:
    return f"""{_atr_24(bars)} SELECT {_rounded(atr_24_norm="x", atr_24_norm_low=f"coalesce(x = {_full('min', 'x', window)}, false)::INT", atr_24_norm_high=f"coalesce(x = {_full('max', 'x', window)}, false)::INT")} FROM n"""


def atr_squeeze(bars: str, window: int, back: int) -> str:
    return f"""{_atr_24(bars)}, c AS (SELECT *, coalesce(x < {_full("avg", "x", window)}, false) AS c FROM n)
SELECT {_rounded(atr_24_norm="x", atr_24_norm_compress="c::INT", atr_24_norm_expansion=f"coalesce(x > lag(x, {back}) OVER {W} AND lag(c) OVER {W}, false)::INT")} FROM c"""


def atr_regimes(bars: str, window: int, low: float, high: float) -> str:
    return f"""{_atr_24(bars)}, m AS (SELECT *, {_full("avg", "x", window)} AS m FROM n)
SELECT {_rounded(atr_24_norm="x", atr_24_norm_regime=f"CASE WHEN x < m * {low} THEN -1 WHEN x > m * {high} THEN 1 ELSE 0 END")} FROM m"""


# Windows, lines and state machines -----------------------------------------------------------------------------------


def _pairs(window: int, src: str = "bars", column: str = '"Close"') -> str:
    """(symbol, seq, j, x): the ``window`` values up to each row by their place, for rows with a full window."""
    return f"SELECT b.symbol, b.seq, a.seq - b.seq + {window} - 1 AS j, a.{column} AS x FROM {src} AS b JOIN {src} AS a ON a.symbol = b.symbol AND a.seq > b.seq - {window} AND a.seq <= b.seq WHERE b.seq >= {window}"


def rolling_statistics(bars: str) -> str:
    """Hurst exponent, sample entropy, strongest frequency and last residual of a ridge regression, from sums over pairs of values.

    The residual's five coefficients solve (A + 1) w = b, written down by elimination.
    """
    n, lag = 20, 5
    steps, last = [], "e0"
    cols = [f"a{i}{j}" for i in range(lag) for j in range(i, lag)] + [f"b{i}" for i in range(lag)]
    at = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    for k in range(lag):
        new = {c: c for c in cols}
        for i in range(k + 1, lag):
            for j in range(i, lag):
                new[at(i, j)] = f"{at(i, j)} - {at(k, i)} * {at(k, j)} / {at(k, k)}"
            new[f"b{i}"] = f"b{i} - {at(k, i)} * b{k} / {at(k, k)}"
        steps.append(f"e{k + 1} AS (SELECT * EXCLUDE ({', '.join(cols)}), {', '.join(f'{x} AS {c}' for c, x in new.items())} FROM {last})")
        last = f"e{k + 1}"
    for k in reversed(range(lag)):
        rest = "".join(f" - {at(k, j)} * w{j}" for j in range(k + 1, lag))
        steps.append(f"w_{k} AS (SELECT *, (b{k}{rest}) / {at(k, k)} AS w{k} FROM {last})")
        last = f"w_{k}"
    means = ", ".join([f"avg(v[{i + 1}]) AS m{i}" for i in range(lag)] + ["avg(y) AS ym"])
    moments = ", ".join([f"sum((v[{i + 1}] - m{i}) * (v[{j + 1}] - m{j}))" + (" + 1" if i == j else "") + f" AS a{i}{j}" for i in range(lag) for j in range(i, lag)] + [f"sum((v[{i + 1}] - m{i}) * (y - ym)) AS b{i}" for i in range(lag)])
    lasts = ", ".join([f"max(CASE WHEN j = {n - 1} THEN v[{i + 1}] - m{i} END) AS d{i}" for i in range(lag)] + [f"max(CASE WHEN j = {n - 1} THEN y - ym END) AS dy"])
    return f"""WITH bars AS ({bars}),
p100 AS MATERIALIZED ({_pairs(100)}), tau AS (SELECT a.symbol, a.seq, k, stddev_pop(b.x - a.x) AS t FROM p100 AS a, range(2, 99) AS r(k), p100 AS b WHERE b.symbol = a.symbol AND b.seq = a.seq AND b.j = a.j + k GROUP BY ALL),
h AS (SELECT symbol, seq, regr_slope(ln(t), ln(k)) AS hurst FROM tau WHERE t > 0 GROUP BY ALL),
p50 AS MATERIALIZED (SELECT *, lead(x) OVER (PARTITION BY symbol, seq ORDER BY j) AS x1, stddev_pop(x) OVER (PARTITION BY symbol, seq) AS s FROM ({_pairs(50)})),
c AS (SELECT a.symbol, a.seq, any_value(a.s) AS s, count(*) FILTER (WHERE greatest(abs(a.x - b.x), abs(a.x1 - b.x1)) <= 0.2 * a.s) AS n FROM p50 AS a JOIN p50 AS b ON a.symbol = b.symbol AND a.seq = b.seq AND a.j < b.j WHERE b.x1 IS NOT NULL GROUP BY ALL),
e AS (SELECT symbol, seq, CASE WHEN s = 0 OR n = 0 THEN 0 ELSE -ln(n / 48.0) END AS entropy FROM c),
p64 AS MATERIALIZED (SELECT *, x - avg(x) OVER (PARTITION BY symbol, seq) AS d FROM ({_pairs(64)})),
f0 AS (SELECT symbol, seq, k, pow(sum(d * cos(2 * pi() * j * k / 64)), 2) + pow(sum(d * sin(2 * pi() * j * k / 64)), 2) AS power FROM p64, range(0, 33) AS r(k) GROUP BY ALL),
f AS (SELECT symbol, seq, arg_max(k, power) / 64.0 AS fft_freq FROM f0 GROUP BY ALL),
p20 AS MATERIALIZED ({_pairs(n)}), v AS (SELECT symbol, seq, j, x AS y, list(x) OVER (PARTITION BY symbol, seq ORDER BY j ROWS BETWEEN {lag} PRECEDING AND 1 PRECEDING) AS v FROM p20),
q AS MATERIALIZED (SELECT * FROM v WHERE j >= {lag}), m AS (SELECT symbol, seq, {means} FROM q GROUP BY ALL), e0 AS (SELECT symbol, seq, {moments}, {lasts} FROM q JOIN m USING (symbol, seq) GROUP BY ALL), {", ".join(steps)},
r AS (SELECT symbol, seq, dy{"".join(f" - d{i} * w{i}" for i in range(lag))} AS nar_res FROM {last})
SELECT symbol, seq, round(hurst, 6) + 0.0 AS hurst, round(entropy, 6) + 0.0 AS entropy, round(fft_freq, 6)::DOUBLE + 0.0 AS fft_freq, round(nar_res, 3) + 0.0 AS nar_res FROM bars LEFT JOIN h USING (symbol, seq) LEFT JOIN e USING (symbol, seq) LEFT JOIN f USING (symbol, seq) LEFT JOIN r USING (symbol, seq)"""


def structural(bars: str, w: int) -> str:
    """Entropy of the spectrum under a Hann window, sign changes, and the slope of curve lengths; the last also over short windows."""
    e = "1e-10"
    half = w // 2 + 1
    return f"""WITH bars AS ({bars}), p AS MATERIALIZED (SELECT *, x - avg(x) OVER (PARTITION BY symbol, seq) AS d FROM ({_pairs(w)})),
s0 AS (SELECT symbol, seq, k, (pow(sum(d * g * cos(2 * pi() * j * k / {w})), 2) + pow(sum(d * g * sin(2 * pi() * j * k / {w})), 2)) * CASE WHEN k = 0 OR 2 * k = {w} THEN 1 ELSE 2 END AS p
  FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / {w}) AS g FROM p), range(0, {half}) AS r(k) GROUP BY symbol, seq, k),
s1 AS (SELECT symbol, seq, p / (sum(p) OVER (PARTITION BY symbol, seq) + {e}) AS p FROM s0), s AS (SELECT symbol, seq, -sum(p * log2(p + {e})) / log2({half}) AS se FROM s1 GROUP BY ALL),
t0 AS (SELECT symbol, seq, j, sign(x - lag(x) OVER (PARTITION BY symbol, seq ORDER BY j)) AS g FROM p), t1 AS (SELECT symbol, seq, g <> lag(g) OVER (PARTITION BY symbol, seq ORDER BY j) AS c FROM t0),
t AS (SELECT symbol, seq, 1 - count(*) FILTER (WHERE c) / ({w} - 2 + {e}) AS ts FROM t1 GROUP BY ALL),
q AS MATERIALIZED (SELECT b.symbol, b.seq, least(b.seq, {w}) AS n, a.seq - greatest(b.seq - {w}, 0) - 1 AS j, a."Close" AS x FROM bars AS b JOIN bars AS a ON a.symbol = b.symbol AND a.seq > b.seq - {w} AND a.seq <= b.seq WHERE b.seq > 5),
l0 AS (SELECT a.symbol, a.seq, k, a.j % k AS m, any_value(a.n) AS n, sum(abs(b.x - a.x)) AS s FROM q AS a, range(1, 6) AS r(k), q AS b WHERE b.symbol = a.symbol AND b.seq = a.seq AND b.j = a.j + k GROUP BY ALL),
l1 AS (SELECT symbol, seq, k, sum(s * (n - 1) / ((n - m) // k * k + {e})) / k AS l FROM l0 GROUP BY symbol, seq, k),
l AS (SELECT symbol, seq, CASE WHEN min(l) > 0 THEN regr_slope(ln(nullif(l, 0)), ln(k)) END AS fd FROM l1 GROUP BY ALL)
SELECT {_rounded(**{f"spectral_entropy_{w}": "se", f"trend_stability_{w}": "ts", f"fractal_dim_{w}": "fd", f"signal_complexity_{w}": "se * ts * (fd - 1)"})} FROM bars LEFT JOIN s USING (symbol, seq) LEFT JOIN t USING (symbol, seq) LEFT JOIN l USING (symbol, seq)"""


def liquidity_distance(bars: str, window: int) -> str:
    return f"""WITH bars AS ({bars}), c AS (SELECT b.symbol, b.seq, round(a."Close", 2) AS v, count(*) AS n, min(a.seq) AS first FROM bars AS b JOIN bars AS a ON a.symbol = b.symbol AND a.seq < b.seq AND a.seq >= b.seq - {window} WHERE b.seq > {window} GROUP BY ALL),
m AS (SELECT symbol, seq, v AS m FROM c QUALIFY row_number() OVER (PARTITION BY symbol, seq ORDER BY n DESC, first) = 1)
SELECT {_rounded(liq_distance='CASE WHEN m IS NOT NULL THEN greatest(-1, least(1, ("Close" - m) / (m + 1e-8))) END')} FROM bars LEFT JOIN m USING (symbol, seq)"""


def line_distance(bars: str, long: int, short: int, seg: int, span: int, support: bool = False) -> str:
    """A line by least squares through the extreme of the rows before and the extremes of the whole segments after it."""
    x, fn, arg, default, name = ('"Low"', "min", "ASC", -1, "support_slope_dist") if support else ('"High"', "max", "DESC", 1, "resistance_slope_dist")
    worse = ">=" if support else "<="
    return f"""WITH bars AS ({bars}), {_ema("e", "bars", '"Close"', span)},
w AS MATERIALIZED (SELECT b.symbol, b.seq, a.seq - b.seq + {long} AS j, a.{x} AS x FROM bars AS b JOIN bars AS a ON a.symbol = b.symbol AND a.seq < b.seq AND a.seq >= b.seq - {long} WHERE b.seq > {long}),
k AS (SELECT symbol, seq, first(j ORDER BY x {arg}, j) AS peak, {fn}(x) AS far, {fn}(x) FILTER (WHERE j >= {long - short}) AS near FROM w GROUP BY ALL),
ok AS (SELECT *, ({long} - peak - 1) // {seg} AS segments FROM k WHERE NOT far {worse} near AND peak < {long - seg} AND ({long} - peak - 1) // {seg} >= 2),
s AS (SELECT w.symbol, w.seq, (j - peak - 1) // {seg} + 1 AS t, {fn}(x) AS y, any_value(segments) AS n FROM w JOIN ok USING (symbol, seq) WHERE j > peak AND j <= peak + segments * {seg} GROUP BY ALL UNION ALL SELECT symbol, seq, 0, far, segments FROM ok),
r AS (SELECT symbol, seq, regr_slope(y, t) * any_value(n) + regr_intercept(y, t) AS level FROM s GROUP BY symbol, seq)
SELECT {_rounded(**{name: f"CASE WHEN level IS NULL THEN {default} ELSE greatest(-1, least(1, (e - level) / (abs(level) + 1e-8))) END"})} FROM {_join("bars", ["e"])} LEFT JOIN r USING (symbol, seq)"""


def support_resistance(bars: str, window: int, look: int, vol: int, tolerance: float) -> str:
    before, after = look // 2, (look - 1) // 2
    frame = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    weight = "pow(1 - 1.0::DOUBLE / 200, b.seq - a.seq)"
    flag = lambda c: f"coalesce(max(({c})::INT), 0)"
    return f"""WITH {_tr(bars)},
k AS (SELECT b.symbol, b.seq, sum({weight} * a.tr) / sum({weight}) AS atr FROM t AS b JOIN t AS a ON a.symbol = b.symbol AND a.seq <= b.seq AND a.seq > 1 WHERE b.seq > 200 GROUP BY b.symbol, b.seq),
d AS (SELECT *, CASE WHEN "Close" > "Open" THEN "Volume" WHEN "Close" < "Open" THEN -"Volume" ELSE 0 END AS delta, "Low" = min("Low") OVER {frame} AND count(*) OVER {frame} = {look} AS lo, "High" = max("High") OVER {frame} AND count(*) OVER {frame} = {look} AS hi FROM bars),
v AS (SELECT symbol, seq, "Close" AS c, atr, max(delta) OVER l AS vh, min(delta) OVER l AS vl FROM d LEFT JOIN k USING (symbol, seq) WINDOW l AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {vol} PRECEDING AND 1 PRECEDING)),
s AS (SELECT v.symbol, v.seq, {flag(f"lo AND delta > vh AND abs(c - p.\"Low\") / (p.\"Low\" + 1e-8) <= {tolerance}")} AS ns, {flag(f"hi AND delta < vl AND abs(c - p.\"High\") / (p.\"High\" + 1e-8) <= {tolerance}")} AS nr,
  {flag('lo AND delta > vh AND p."Low" <= c AND c <= p."Low" + atr')} AS bs, {flag('hi AND delta < vl AND p."High" - atr <= c AND c <= p."High"')} AS br
  FROM v JOIN d AS p ON p.symbol = v.symbol AND p.seq >= v.seq - {window - before} AND p.seq < v.seq - {after} AND (lo OR hi) WHERE v.seq > {window} GROUP BY ALL)
SELECT symbol, seq, {", ".join(f"coalesce({a}, 0) + 0.0::DOUBLE AS {n}" for a, n in (("ns", "near_support_level"), ("nr", "near_resistance_level"), ("bs", "in_support_box"), ("br", "in_resistance_box")))} FROM bars LEFT JOIN s USING (symbol, seq)"""


def parabolic_sar(bars: str, step: float, most: float) -> str:
    """The trend, the stop, the extreme point and the step, row by row; a turn starts from the extreme point."""
    return f"""WITH RECURSIVE bars AS ({bars}),
b AS MATERIALIZED (SELECT symbol, seq, "High" AS h, "Low" AS l, lag("High") OVER w AS h1, lag("Low") OVER w AS l1, coalesce(lag("High", 2) OVER w, lag("High") OVER w) AS h2, coalesce(lag("Low", 2) OVER w, lag("Low") OVER w) AS l2, lead("High") OVER w AS hn, lead("Low") OVER w AS ln FROM bars WINDOW w AS {W}),
s AS (
  SELECT symbol, seq, NOT (l - ln > greatest(0, hn - h)) AS up, CASE WHEN NOT (l - ln > greatest(0, hn - h)) THEN l ELSE h END AS sar, CASE WHEN NOT (l - ln > greatest(0, hn - h)) THEN h ELSE l END AS ep, {step}::DOUBLE AS af, false AS shown FROM b WHERE seq = 1
  UNION ALL
  SELECT b.symbol, b.seq, s.up <> turn, CASE WHEN turn THEN e2 ELSE c2 END, CASE WHEN turn THEN CASE WHEN s.up THEN b.l ELSE b.h END ELSE e2 END, CASE WHEN turn THEN {step}::DOUBLE ELSE a2 END, true
  FROM s JOIN b ON b.symbol = s.symbol AND b.seq = s.seq + 1,
    LATERAL (SELECT s.sar + s.af * (s.ep - s.sar) AS c) AS x,
    LATERAL (SELECT CASE WHEN s.up THEN b.l < c ELSE b.h > c END AS turn, CASE WHEN s.up THEN greatest(s.ep, b.h) ELSE least(s.ep, b.l) END AS e2,
      CASE WHEN (s.up AND b.h > s.ep) OR (NOT s.up AND b.l < s.ep) THEN least({most}::DOUBLE, s.af + {step}::DOUBLE) ELSE s.af END AS a2, CASE WHEN s.up THEN least(c, b.l1, b.l2) ELSE greatest(c, b.h1, b.h2) END AS c2) AS y
)
SELECT symbol, seq, CASE WHEN abs(y) >= 1e9 THEN round(y, -6) ELSE round(y, 6) END + 0.0 AS parabolic_sar_norm FROM (SELECT bars.symbol, bars.seq, CASE WHEN up AND shown THEN (sar - "Low") / ("High" - "Low" + 1e-8) END AS y FROM bars LEFT JOIN s USING (symbol, seq))"""


def kagi(bars: str, taps: int, base: int, vortex: int) -> str:
    """The reversal line and the drifting baseline row by row; the smoothing is the quadratic's value by its fixed weights."""
    import numpy as np

    m = taps // 2
    at = np.arange(-m, m + 1)
    fit = np.linalg.pinv(np.vander(at, 3))
    weights = lambda p: (np.vander([p], 3) @ fit)[0].tolist()
    sums = lambda p: " + ".join(f"{w!r}::DOUBLE * v[{k + 1}]" for k, w in enumerate(weights(p)))
    smooth = "CASE " + " ".join(f"WHEN g = {p} THEN {sums(p)}" for p in range(-m, m + 1)) + " END"
    scale = lambda c: f"({c} - {_full('min', c, 100)}) / ({_full('max', c, 100)} - {_full('min', c, 100)} + 1e-10)"
    fill = lambda c: f"first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""WITH RECURSIVE bars AS ({bars}),
t AS (SELECT symbol, seq, "High" - "Low" AS r, ("High" + "Low") / 2 AS hl, CASE WHEN seq > 1 THEN greatest("High" - "Low", abs("High" - lag("Close") OVER w), abs("Low" - lag("Close") OVER w)) END AS tr, abs("High" - lag("Low") OVER w) AS vp, abs("Low" - lag("High") OVER w) AS vn, "Close" AS c FROM bars WINDOW w AS {W}),
b AS MATERIALIZED (SELECT *, 1.5 * {_full("avg", "r", taps)} AS th, avg(hl) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {base} PRECEDING AND 1 PRECEDING) AS bm, lag(hl, {base}) OVER {W} AS bl, {_full("avg", "hl", base)} AS b0,
  {_full("sum", "vp", vortex)} / {_full("sum", "tr", vortex)} - {_full("sum", "vn", vortex)} / {_full("sum", "tr", vortex)} AS vx FROM t),
k AS (SELECT symbol, seq, c AS line, true AS up FROM b WHERE seq = 1 UNION ALL
  SELECT b.symbol, b.seq, CASE WHEN CASE WHEN k.up THEN b.c > k.line ELSE b.c < k.line END OR coalesce(abs(b.c - k.line) >= b.th, false) THEN k.line + (b.c - k.line) ELSE k.line END,
    CASE WHEN NOT CASE WHEN k.up THEN b.c > k.line ELSE b.c < k.line END AND coalesce(abs(b.c - k.line) >= b.th, false) THEN NOT k.up ELSE k.up END FROM k JOIN b ON b.symbol = k.symbol AND b.seq = k.seq + 1),
h AS (SELECT symbol, seq, b0 AS y FROM b WHERE seq = {base} UNION ALL SELECT b.symbol, b.seq, h.y + (b.bm - h.y) / {base} + 0.5 * (b.hl - b.bl) FROM h JOIN b ON b.symbol = h.symbol AND b.seq = h.seq + 1),
n AS (SELECT *, max(seq) OVER (PARTITION BY symbol) AS n FROM k), g AS (SELECT symbol, seq, CASE WHEN seq <= {m} THEN seq - {m + 1} WHEN seq > n - {m} THEN seq - n + {m} ELSE 0 END AS g, least(greatest(seq, {m + 1}), n - {m}) AS mid FROM n),
v AS (SELECT g.symbol, g.seq, any_value(g.g) AS g, list(k.line ORDER BY k.seq) AS v FROM g JOIN k ON k.symbol = g.symbol AND k.seq >= g.mid - {m} AND k.seq <= g.mid + {m} GROUP BY g.symbol, g.seq),
a AS (SELECT b.symbol, b.seq, {smooth} AS ka, h.y AS th, vx FROM b JOIN v USING (symbol, seq) LEFT JOIN h USING (symbol, seq)),
z AS (SELECT symbol, seq, 2 * {scale("ka")} - 1 AS z1, {scale("th")} AS z2, 2 * {scale("vx")} - 1 AS z3, 2 * {scale("(ka - th)")} - 1 AS z4 FROM a)
SELECT {_rounded(kagi_conversion=fill("z1"), phase_baseline=fill("z2"), vortex_cloud=fill("z3"), kagi_phase_diff=fill("z4"))} FROM z"""


def fft_phase(bars: str, window: int) -> str:
    """The angle of the strongest positive frequency of the rows before, by the definition of the transform."""
    return f"""WITH bars AS ({bars}), p AS MATERIALIZED (SELECT symbol, seq + 1 AS seq, j, x - avg(x) OVER (PARTITION BY symbol, seq) AS x FROM ({_pairs(window)})),
f AS (SELECT symbol, seq, k, sum(x * cos(2 * pi() * j * k / {window})) AS re, -sum(x * sin(2 * pi() * j * k / {window})) AS im FROM p, range(1, {window // 2}) AS r(k) GROUP BY ALL),
m AS (SELECT symbol, seq, arg_max(atan2(im, re), re * re + im * im) / pi() AS y FROM f GROUP BY ALL)
SELECT {_rounded(fft_phase_position="y")} FROM bars LEFT JOIN m USING (symbol, seq)"""


# What labels, evaluation and trees are computed from, not rounded ------------------------------------------------------


def inputs(bars: str) -> str:
    """Bars with the bands' place and width, choppiness and RSI at their default settings."""
    return f"""SELECT bars.*, (c - m) / (s + 1e-8) AS bb_z_20, 4 * s / (m + 1e-8) AS bb_width_20, CASE WHEN total IS NOT NULL THEN greatest(0, least(1, (100 * log10((total + 1e-8) / (hi - lo + 1e-8)) / log10(14 + 1e-8) - 20) / 41.8)) END AS choppiness_index_14, r AS "RSI_14"
FROM (WITH {_tr(bars)}, {_wilder_rsi("r", "bars", 14)}, m AS (SELECT symbol, seq, "Close" AS c, {_full("avg", '"Close"', 20)} AS m, {_full("stddev_samp", '"Close"', 20)} AS s, {_full("sum", "tr", 14)} AS total, {_full("max", '"High"', 14)} AS hi, {_full("min", '"Low"', 14)} AS lo FROM t)
SELECT * FROM {_join("m", ["r"])}) AS m JOIN ({bars}) AS bars USING (symbol, seq)"""


def open_gates(bars: str) -> str:
    """(symbol, seq): the rows where the close is above its mean of 100, the stochastic RSI below 40 and volume rising."""
    return f"""WITH bars AS ({bars}), {_wilder_rsi("r", "bars", 14)}, s AS (SELECT symbol, seq, "Close" AS c, "Volume" AS v, 100 * (r - {_full("min", "r", 14)}) / nullif({_full("max", "r", 14)} - {_full("min", "r", 14)}, 0) AS s FROM {_join("bars", ["r"])}),
g AS (SELECT symbol, seq, c > {_full("avg", "c", 100)} AND {_full("avg", "s", 3)} < 40 AND {_full("avg", "v", 5)} > {_full("avg", "v", 20)} AS g FROM s) SELECT symbol, seq FROM g WHERE g"""


def hourly_rsi(bars: str) -> str:
    """RSI of 7 and 14 hours from the last close of each hour, given to the hour's first bar and kept until the next."""
    fill = lambda c: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.seq)"
    return f"""WITH b AS ({bars}), bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "Data") AS seq FROM (SELECT symbol, date_trunc('hour', "Data") AS "Data", arg_max("Close", "Data") AS "Close" FROM b GROUP BY ALL)),
{_wilder_rsi("r", "bars", 7)}, {_wilder_rsi("q", "bars", 14)}, h AS (SELECT symbol, "Data", r / 100 AS r, q / 100 AS q FROM {_join("bars", ["r", "q"])})
SELECT b.symbol, b.seq, round({fill("h.r")}, 6) + 0.0 AS "RSI7_1H_norm", round({fill("h.q")}, 6) + 0.0 AS "RSI14_1H_norm" FROM b LEFT JOIN h ON h.symbol = b.symbol AND h."Data" = b."Data" """


def session_distances(bars: str, flags: dict[str, str]) -> str:
    """A session's first candle is the one that last opened it; beyond its low or high counts in shares of its range."""
    columns, started, ranges = {}, [], []
    for s, cond in flags.items():
        started.append(f"""({cond})::INT AS "{s}" """)
        ranges.append(f"""max(CASE WHEN "{s}" = 1 AND coalesce(before_{s}, 0) <> 1 THEN seq END) OVER {W} AS at_{s}""")
        low, high = f"{s}_bar.\"Low\"", f"{s}_bar.\"High\""
        part = f"""(CASE WHEN m."Low" < {low} THEN m."Low" - {low} ELSE m."High" - {high} END) / nullif({high} - {low}, 0)"""
        columns |= {s: f'm."{s}"', f"{s}_Distance": f"""CASE WHEN m."{s}" = 1 AND (m."Low" < {low} OR m."High" > {high}) THEN CASE WHEN {part} IS NOT NULL THEN greatest(-1, least(1, {part})) END ELSE 0 END"""}
    joins = " ".join(f"LEFT JOIN bars AS {s}_bar ON {s}_bar.symbol = m.symbol AND {s}_bar.seq = m.at_{s}" for s in flags)
    lags = ", ".join(f'lag("{s}") OVER {W} AS before_{s}' for s in flags)
    return f"""WITH bars AS ({bars}), f AS (SELECT *, {", ".join(started)} FROM bars), l AS (SELECT *, {lags} FROM f), m AS (SELECT *, {", ".join(ranges)} FROM l)
SELECT {_rounded(**columns).replace("symbol, seq,", "m.symbol, m.seq,")} FROM m {joins}"""


# Patterns, divergences and volume --------------------------------------------------------------------------------------


def smoothed_averages(bars: str, lines: tuple[int, ...] = (21, 50, 100, 200)) -> str:
    mean = lambda n: f'avg("Close") OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)'
    against = lambda x: f'({x} - "Close") / (abs("Close") + 1e-10)'
    columns = {f"smma_{n}_norm": against(f'({mean(n)} * {n - 1} + "Close") / {n}') for n in lines} | {"ema_2_norm": against("e"), "trend_fill": 'sign(e - "Close")'}
    columns["bull_3_line"] = f"""(count(*) FILTER (WHERE "Close" < "Open") OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AND "Close" > lag("Open") OVER {W})::INT"""
    columns["bull_engulfing"] = f"""coalesce(("Open" <= lag("Close") OVER {W} AND "Open" < lag("Open") OVER {W} AND "Close" > lag("Open") OVER {W})::INT, 0)"""
    return f"""WITH bars AS ({bars}), {_ema("e", "bars", '"Close"', 2)} SELECT {_rounded(**columns)} FROM {_join("bars", ["e"])}"""


def ichimoku_on_rsi(bars: str, n: int, tenkan: int, kijun: int, senkou: int, prefix: str) -> str:
    half = lambda w: f"(max(r) OVER {_frame(w)} + min(r) OVER {_frame(w)}) / 2"
    filled = lambda x: f"last_value({x} / nullif(r, 0) IGNORE NULLS) OVER {W}"
    columns = {f"RSI_{n}": "r", f"{prefix}_tenkan_norm": filled("t"), f"{prefix}_kijun_norm": filled("k"), f"{prefix}_senkou_a_norm": filled("a"), f"{prefix}_senkou_b_norm": filled("b")}
    return f"""WITH bars AS ({bars}), {_wilder_rsi("r", "bars", n)}, x AS (SELECT symbol, seq, r FROM {_join("bars", ["r"])}),
h AS (SELECT *, {half(tenkan)} AS t, {half(kijun)} AS k, {half(senkou)} AS s FROM x), l AS (SELECT *, (lag(t) OVER {W} + lag(k) OVER {W}) / 2 AS a, lag(s) OVER {W} AS b FROM h)
SELECT {_rounded(**columns)} FROM l"""


def retracements(bars: str, window: int, threshold: float) -> str:
    """Whether the high came after the low is read from where each stands in the list of the rows before."""
    before = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    level = lambda x: f"CASE WHEN up THEN hi - {x} * (hi - lo) ELSE lo + {x} * (hi - lo) END"
    columns = {f"fib_dist_{int(x * 1000)}": f"CASE WHEN seq > {window} AND (hi - lo) / (lo + 1e-10) >= {threshold} THEN (c - {level(x)}) / (c + 1e-10) END" for x in (0.236, 0.382, 0.5, 0.618, 0.786)}
    return f"""WITH bars AS ({bars}), l AS (SELECT symbol, seq, "Close" AS c, max("High") OVER {_frame(window)} AS hi, min("Low") OVER {_frame(window)} AS lo, list("High") OVER {before} AS hs, list("Low") OVER {before} AS ls FROM bars),
u AS (SELECT symbol, seq, c, hi, lo, list_position(hs, list_max(hs)) > list_position(ls, list_min(ls)) AS up FROM l) SELECT {_rounded(**columns)} FROM u"""


def three_lines(bars: str, length: int, source: str, mult: float, up: float, down: float) -> str:
    inside = lambda x: f"greatest(-1, least(1, {x}))"
    columns = {
        "fibo_upper": f"CASE WHEN c >= m + {up} * d THEN -1 WHEN c > m AND d > 0 THEN {inside(f'(c - m) / ({up} * d + 1e-10)')} ELSE 0 END", "fibo_basis": "(c - m) / (d + 1e-10)",
        "fibo_lower": f"CASE WHEN c <= m - {down} * d THEN -1 WHEN c < m AND d > 0 THEN {inside(f'(m - {down} * d - c) / (1e-10 - {down} * d)')} ELSE 0 END",
    }
    return f"""WITH bars AS ({bars}), s AS (SELECT symbol, seq, "Close" AS c, {source} AS p, ({source}) * "Volume" AS pv FROM bars),
b AS (SELECT symbol, seq, c, {_full("sum", "pv", length)} / ({_full("sum", "p", length)} + 1e-10) AS m, {mult} * {_full("stddev_samp", "p", length)} AS d FROM s) SELECT {_rounded(**columns)} FROM b"""


def rsi_levels(bars: str, n: int, back: int, tolerance: float, touches: int) -> str:
    """Density clusters of the turning points: points with enough others within reach, all such points that reach each other, and who is within reach of one of them."""
    return f"""WITH RECURSIVE bars AS ({bars}), {_wilder_rsi("r", "bars", n)}, x AS MATERIALIZED (SELECT symbol, seq, r, lag(r) OVER {W} AS a, lead(r) OVER {W} AS b, max(seq) OVER (PARTITION BY symbol) AS n FROM {_join("bars", ["r"])}),
e AS MATERIALIZED (SELECT symbol, seq, r AS v, avg(r) OVER (PARTITION BY symbol) * {tolerance} AS eps FROM x WHERE seq > n - {back} + 1 AND seq < n AND ((r > a AND r > b) OR (r < a AND r < b))),
near AS MATERIALIZED (SELECT p.symbol, p.seq AS i, q.seq AS j FROM e AS p JOIN e AS q ON p.symbol = q.symbol AND abs(p.v - q.v) <= p.eps),
core AS MATERIALIZED (SELECT symbol, i FROM near GROUP BY symbol, i HAVING count(*) >= {touches}),
reach AS (SELECT symbol, i AS root, i FROM core UNION SELECT reach.symbol, reach.root, near.j FROM reach JOIN near ON near.symbol = reach.symbol AND near.i = reach.i JOIN core ON core.symbol = near.symbol AND core.i = near.j),
cluster AS MATERIALIZED (SELECT symbol, i, min(root) AS c FROM reach GROUP BY symbol, i),
member AS (SELECT near.symbol, near.i, coalesce(any_value(own.c), min(cluster.c)) AS c FROM near JOIN cluster ON cluster.symbol = near.symbol AND cluster.i = near.j LEFT JOIN cluster AS own ON own.symbol = near.symbol AND own.i = near.i GROUP BY near.symbol, near.i),
level AS (SELECT member.symbol, c, avg(v) AS l FROM member JOIN e ON e.symbol = member.symbol AND e.seq = member.i GROUP BY ALL)
SELECT {_rounded(rsi="r", rsi_near_level=f"(seq = n AND EXISTS (SELECT 1 FROM level WHERE level.symbol = x.symbol AND abs(x.r - l) / l <= {tolerance}))::INT")} FROM x"""


def lows_against_rsi(bars: str, n: int, back: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {back // 2} PRECEDING AND {(back - 1) // 2} FOLLOWING)"
    lowest = lambda x: f"coalesce(count({x}) OVER {frame} = {back} AND min({x}) OVER {frame} = {x}, false)"
    return f"""WITH bars AS ({bars}), {_wilder_rsi("r", "bars", n)}, p AS MATERIALIZED (SELECT symbol, seq, "Low" AS x, r, {lowest('"Low"')} AS pl, {lowest("r")} AS rl FROM {_join("bars", ["r"])}),
j AS (SELECT i.symbol, i.seq, max(j.seq) AS j FROM p AS i JOIN p AS j ON j.symbol = i.symbol AND j.pl AND j.seq BETWEEN i.seq - {2 * back - 1} AND i.seq - 1 WHERE i.pl AND i.rl AND i.seq > {2 * back} GROUP BY ALL),
d AS (SELECT j.symbol, j.seq, i.x, i.r, k.x AS x0, k.r AS r0, (SELECT max(z.r) - min(z.r) FROM p AS z WHERE z.symbol = j.symbol AND z.seq BETWEEN j.j AND j.seq) AS w
  FROM j JOIN p AS i ON i.symbol = j.symbol AND i.seq = j.seq JOIN p AS k ON k.symbol = j.symbol AND k.seq = j.j),
f AS (SELECT symbol, seq, CASE WHEN w > 0 THEN round((r - r0) / w, 3) ELSE 0 END AS w FROM d WHERE (x < x0 AND r > r0) OR (x > x0 AND r < r0) OR (abs(x - x0) < 0.01 * x0 AND r > r0))
SELECT {_rounded(**{f"price_low_{back}": "pl::INT", f"rsi_low_{back}": "rl::INT", f"has_divergence_{back}": "(w IS NOT NULL)::INT", f"divergence_power_{back}": "coalesce(w, 0)"})} FROM p LEFT JOIN f USING (symbol, seq)"""


def pivots_against_rsi(bars: str, n: int, left: int, right: int, rows: int) -> str:
    frame = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING)"
    shown = lambda c: f"EXISTS (SELECT 1 FROM d WHERE d.symbol = x.symbol AND d.{c} AND x.seq BETWEEN d.seq + {right} AND d.seq + {right + rows - 1})::INT"
    return f"""WITH bars AS ({bars}), {_wilder_rsi("r", "bars", n)}, x AS MATERIALIZED (SELECT symbol, seq, "Low" AS l, r, count(r) OVER {frame} = {left + right + 1} AND "Low" = min("Low") OVER {frame} AND r = min(r) OVER {frame} AS p FROM {_join("bars", ["r"])}),
j AS (SELECT i.symbol, i.seq, max(j.seq) AS j FROM x AS i JOIN x AS j ON j.symbol = i.symbol AND j.seq < i.seq - {right} WHERE i.p AND j.p GROUP BY ALL),
d AS MATERIALIZED (SELECT j.symbol, j.seq, i.l < k.l AND i.r > k.r AS b, i.l > k.l AND i.r < k.r AS h FROM j JOIN x AS i ON i.symbol = j.symbol AND i.seq = j.seq JOIN x AS k ON k.symbol = j.symbol AND k.seq = j.j)
SELECT {_rounded(rsi="r", bull_signal=shown("b"), hidden_bull_signal=shown("h"))} FROM x"""


def smooth_divergence(bars: str, window: int) -> str:
    before = f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    flow = "CASE WHEN d < 0 THEN -v WHEN d = 0 THEN 0 ELSE v END"
    return f"""WITH bars AS ({bars}), {_wilder_rsi("r", "bars", 14)}, {_ema("f", "bars", '"Close"', 12, True)}, {_ema("s", "bars", '"Close"', 26, True)},
x AS (SELECT symbol, seq, r, f - s AS m, "Volume" AS v, "Close" - lag("Close") OVER {W} AS d, 100 * ("Close" - {_full("min", '"Low"', 3)}) / nullif({_full("max", '"High"', 3)} - {_full("min", '"Low"', 3)}, 0) AS k FROM {_join("bars", ["r", "f", "s"])}),
o AS (SELECT *, sum({flow}) OVER {W} AS o, min(m) OVER {before} AS lo, max(m) OVER {before} AS hi FROM x),
n AS (SELECT symbol, seq, [(r - 30) / 40, ({_full("avg", "k", 3)} - 20) / 60, CASE WHEN m IS NULL OR hi IS NULL THEN NULL WHEN hi > lo THEN 2 * (m - lo) / (hi - lo) - 1 ELSE -1 END, tanh((o - {_full("avg", "o", window)}) / ({_full("stddev_samp", "o", window)} + 1e-10))] AS l FROM o),
d AS (SELECT symbol, seq, CASE WHEN seq <= {window} THEN 0 WHEN len(list_filter(l, lambda q: q IS NOT NULL)) = 4 THEN (0.35 * (l[2] - l[1]) + 0.25 * (l[4] - l[2])) / 0.85 * (list_max(l) - list_min(l)) / (list_avg(list_transform(l, lambda q: abs(q))) + 1e-10) END AS y FROM n)
SELECT {_rounded(divergence="CASE WHEN max(abs(y)) OVER (PARTITION BY symbol) > 0 THEN y / max(abs(y)) OVER (PARTITION BY symbol) ELSE y END")} FROM d"""


def price_oscillator(bars: str, column: str, back: int, fast: int, slow: int, smooth: int, rows: int, long_term: bool = True) -> str:
    """A trough of price: the run of equal lows before a rise lies below the low before that run, of at most four rows."""
    held = lambda c, x: f"last_value(CASE WHEN {c} THEN {x} END IGNORE NULLS) OVER {W}"
    fell = " OR ".join(f"({' AND '.join(f'l1 = l{i}' for i in range(2, k + 1))}{' AND ' if k > 1 else ''}l1 < l{k + 1})" for k in range(1, 5))
    before = lambda x, w: f"min({x}) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    last = " OR (t AND up AND cp < lf) OR (up AND late < lf)" if long_term else ""
    lags = ", ".join(f'lag("Low", {k}) OVER {W} AS l{k}' for k in range(1, 6))
    return f"""WITH bars AS ({bars}), {_ema("f", "bars", f'"{column}"', fast)}, {_ema("s", "bars", f'"{column}"', slow)},
o AS (SELECT symbol, seq, "Low" AS l, {lags}, 100 * (f / nullif(s, 0) - 1) AS o FROM {_join("bars", ["f", "s"])}), p AS (SELECT *, {_full("avg", "o", smooth)} AS p FROM o),
t AS (SELECT *, lag(p) OVER {W} AS p1, coalesce(p > lag(p) OVER {W} AND lag(p) OVER {W} < lag(p, 2) OVER {W}, false) AS t, coalesce(l > l1 AND ({fell}), false) AS pt, {before("l", back)} AS least, {before("p", back)} AS pleast, {before("l", 5)} AS five FROM p),
h AS (SELECT *, {held("t", "p1")} AS hp, {held("pt", "l1")} AS hl, {held("pt", "least")} AS hm, lag(pt) OVER {W} AS pt1 FROM t), y AS (SELECT *, {held("t", "CASE WHEN pt1 THEN five ELSE 0 END")} AS hy FROM h),
w AS (SELECT *, lag(hp) OVER {W} AS c0, lag(hp, 2) OVER {W} AS c1, lag(hl) OVER {W} AS cp, lag(hm, 2) OVER {W} AS lf, lag(hy, 2) OVER {W} AS y6, coalesce(sum(t::INT) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) > 0, false) AS recent FROM y), z AS (SELECT *, CASE WHEN pt AND recent THEN l1 ELSE 0 END AS late, c0 > pleast AS up FROM w),
g AS (SELECT symbol, seq, p, coalesce((t AND cp < y6 AND c0 > c1) OR (late < y6 AND c0 > c1){last}, false) AS g FROM z)
SELECT {_rounded(PPO="p", bullish_signal=f"max(g::INT) OVER {_frame(rows + 1)}")} FROM g"""


def bands_and_awesome(bars: str, length: int, mult: float, fast: int, slow_hl: int, fast_hl: int, squeeze: int, ema: bool = False, band: bool = False, threshold: float | None = None) -> str:
    basis = _ema("b", "bars", '"Close"', length) if ema else f"""b AS (SELECT symbol, seq, {_full("avg", '"Close"', length)} AS y FROM bars)"""
    allowed = lambda side: (f" AND {side}" if band else "") + (f" AND q > {threshold}" if threshold is not None else "")
    signal = f"CASE WHEN f > b AND f1 <= b1 AND c > b AND abs(ao) = 1{allowed('c < b + dev')} THEN 1 WHEN f < b AND f1 >= b1 AND c < b AND abs(ao) = 2{allowed('c > b - dev')} THEN -1 ELSE 0 END"
    return f"""WITH {_tr(bars)}, {basis}, {_ema("f", "bars", '"Close"', fast)},
h AS (SELECT symbol, seq, "Close" AS c, ("High" + "Low") / 2 AS h, b, f FROM {_join("bars", ["b", "f"])}), k AS (SELECT symbol, seq, {_full("avg", "tr", 14)} AS atr FROM t),
a AS (SELECT *, {_full("avg", "h", fast_hl)} - {_full("avg", "h", slow_hl)} AS x, {mult} * {_full("stddev_samp", "c", length)} AS dev, lag(f) OVER {W} AS f1, lag(b) OVER {W} AS b1 FROM h),
g AS (SELECT *, coalesce(x >= 0, false) AS pos, coalesce(x > lag(x) OVER {W}, false) AS up, 100 * dev / nullif({_full("avg", "dev", squeeze)}, 0) AS q FROM a), o AS (SELECT *, CASE WHEN pos THEN 1 ELSE -1 END * CASE WHEN up THEN 1 ELSE 2 END AS ao FROM g)
SELECT {_rounded(fast_ma="f", bb_basis="b", xSMA1_SMA2="x", AO="ao", bb_squeeze="q", atr="atr", BA_Signal=signal)} FROM o JOIN k USING (symbol, seq)"""


def fisher_of(bars: str, column: str, eps: float) -> str:
    return f"""WITH bars AS ({bars}) SELECT {_rounded(**{f"{column}_fisher": f'atanh(greatest({eps} - 1, least(1 - {eps}, "{column}")))'})} FROM bars"""


def range_against_atr(bars: str, window: int, ratio: float, debug: bool = False) -> str:
    conds = ['"Close" > "Open"', f"q > {ratio}", f"x < lag(x) OVER {W}"]
    columns = {"atr_24_norm": "x", "candle_atr_ratio": "q", "candle_atr_ratio_ma": _full("avg", "q", window), "atr_breakout_signal": f"coalesce(({' AND '.join(conds)})::INT, 0)"}
    columns |= {f"breakout_cond_{i}": f"coalesce(({c})::INT, 0)" for i, c in enumerate(conds)} if debug else {}
    return f"""{_atr_24(bars)}, q AS (SELECT symbol, seq, x, "Open", "Close", 100 * ("High" - "Low") / nullif(x * "Close", 0) AS q FROM n JOIN bars USING (symbol, seq)) SELECT {_rounded(**columns)} FROM q"""


def atr_ratio(bars: str, short: int, long: int) -> str:
    weight = f"pow(1 - 1.0::DOUBLE / {short}, b.seq - a.seq)"
    return f"""WITH {_tr(bars)}, k AS (SELECT b.symbol, b.seq, sum({weight} * a.tr) / sum({weight}) AS k FROM t AS b JOIN t AS a ON a.symbol = b.symbol AND a.seq <= b.seq AND a.seq > 1 WHERE b.seq > {short} GROUP BY b.symbol, b.seq),
m AS (SELECT symbol, seq, k, {_shifted("avg", "k", long)} AS m FROM bars LEFT JOIN k USING (symbol, seq)) SELECT {_rounded(atr_ratio="CASE WHEN m IS NOT NULL THEN greatest(0, least(2, k / (m + 1e-8))) / 2 END")} FROM m"""


def broken_lows(bars: str, back: int, recent: int) -> str:
    """Every pair of a row and a three-bar low before it, with the extremes since."""
    return f"""WITH bars AS ({bars}), n AS (SELECT symbol, seq, "Low" AS l, lag("Low") OVER {W} AS a, lead("Low") OVER {W} AS b FROM bars), f AS (SELECT symbol, seq, l FROM n WHERE l < a AND l < b),
p AS (SELECT b.symbol, b.seq, f.l, b."Close" AS c, min(z."Low") AS lo, max(z."High") AS hi, any_value(m.last) AS now
  FROM bars AS b JOIN f ON f.symbol = b.symbol AND f.seq BETWEEN b.seq - {back} AND b.seq - 1 JOIN bars AS z ON z.symbol = b.symbol AND z.seq > f.seq AND z.seq <= b.seq
  JOIN (SELECT symbol, seq, min("Low") OVER {_frame(recent + 1)} AS last FROM bars) AS m ON m.symbol = b.symbol AND m.seq = b.seq GROUP BY b.symbol, b.seq, f.seq, f.l, c),
q AS (SELECT *, l = min(l) OVER (PARTITION BY symbol, seq) AS lowest, CASE WHEN c > l THEN CASE WHEN hi > l THEN (c - l) / (hi - l) ELSE 0 END WHEN lo < l THEN (c - l) / (l - lo) ELSE 0 END AS x FROM p),
g AS (SELECT symbol, seq, count(*) FILTER (WHERE now < l) AS k, avg(x) FILTER (WHERE now < l AND lowest) AS x FROM q GROUP BY symbol, seq)
SELECT {_rounded(fractals_broken_count="coalesce(k, 0)", fractals_broken_ratio="CASE WHEN coalesce(k, 0) = 0 THEN -1 ELSE greatest(-1, least(1, coalesce(x, 0))) END")} FROM bars LEFT JOIN g USING (symbol, seq)"""


def quarters(bars: str, levels: int) -> str:
    columns = {f"Q_L{n}_{q}": f"(s * {4**n} // 86400 = {q - 1})::INT" for n in range(1, levels + 1) for q in range(1, 4**n + 1)}
    return f"""WITH bars AS ({bars}), s AS (SELECT symbol, seq, floor(epoch("Data"))::BIGINT % 86400 AS s FROM bars) SELECT {_rounded(**columns)} FROM s"""


def halves(bars: str, window: int) -> str:
    """The mean gap between values of the same rank in the older and the newer half."""
    half = window // 2
    return f"""WITH bars AS ({bars}), p AS (SELECT b.symbol, b.seq, a.seq > b.seq - {half} AS newer, a."Close" AS x FROM bars AS b JOIN bars AS a ON a.symbol = b.symbol AND a.seq > b.seq - {window} AND a.seq <= b.seq WHERE b.seq >= {window}),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, seq, newer ORDER BY x) AS i FROM p), w AS (SELECT a.symbol, a.seq, avg(abs(a.x - b.x)) AS w FROM r AS a JOIN r AS b ON b.symbol = a.symbol AND b.seq = a.seq AND b.i = a.i AND b.newer AND NOT a.newer GROUP BY ALL)
SELECT {_rounded(**{f"wasserstein_{window}": "w"})} FROM bars LEFT JOIN w USING (symbol, seq)"""


def volume_filter(bars: str, ema: bool, short: int, long: int) -> str:
    keep = lambda n: f"pow(1 - 2.0::DOUBLE / ({n} + 1), b.seq - a.seq)"
    weighed = ", ".join(f'sum({keep(n)} * a."Volume") / sum({keep(n)}) AS {c}' for c, n in (("s", short), ("l", long)))
    means = f"SELECT b.symbol, b.seq, {weighed} FROM bars AS b JOIN bars AS a ON a.symbol = b.symbol AND a.seq <= b.seq GROUP BY b.symbol, b.seq" if ema else f'SELECT symbol, seq, avg("Volume") OVER {_frame(short)} AS s, avg("Volume") OVER {_frame(long)} AS l FROM bars'
    return f"""WITH bars AS ({bars}), m AS ({means}) SELECT {_rounded(volume_filter="coalesce(100 * (s / nullif(l, 0) - 1), 0)")} FROM m"""


def volume_base(bars: str, length: int, short: int) -> str:
    z = lambda c: f"({c} - {_full('avg', c, length)}) / nullif({_full('stddev_samp', c, length)}, 0)"
    return f"""WITH bars AS ({bars}), d AS (SELECT symbol, seq, "Volume" AS v, "Close" - lag("Close") OVER {W} AS d, "Volume" * (2 * "Close" - "Low" - "High") / nullif("High" - CASE WHEN "Low" = 0 THEN 0.0001 ELSE "Low" END, 0) AS ad FROM bars),
o AS (SELECT *, sum(sign(d) * v) OVER {W} AS o, d * v AS f, {_full("sum", "ad", length)} AS s FROM d)
SELECT {_rounded(obv_zscore=z("o"), volume_ma_ratio=f"v / nullif({_full('avg', 'v', length)}, 0)", ad_cum_pct_change=f"s / nullif(lag(s, {short}) OVER {W}, 0) - 1", force_index_z=z("f"))} FROM o"""


def added_indicators(bars: str) -> str:
    return f"SELECT * FROM ({atr_normalized(bars, (24,), True, 200, 5)}) JOIN ({volume_base(bars, 28, 5)}) USING (symbol, seq)"


def liquidity_score(bars: str, window: int) -> str:
    """Profile, ATR and trend cycle as in their own queries, but not rounded."""
    tail = lambda q: f"quantile_cont(stc, {q}) OVER (PARTITION BY symbol)"
    f = _frame(100)
    return f"""WITH {_tr(bars)}, {_atr_sums(14)}, n AS MATERIALIZED (SELECT symbol, seq, 2 * (y - min(y) OVER {f}) / (max(y) OVER {f} - min(y) OVER {f} + 1e-8) - 1 AS n FROM atr),
{_ema("a", "bars", '"Close"', 23)}, {_ema("b", "bars", '"Close"', 50)}, m AS MATERIALIZED (SELECT symbol, seq, a - b AS m FROM {_join("bars", ["a", "b"])}), {_ema("g", "m", "m", 10)},
raw AS MATERIALIZED (SELECT symbol, seq, CASE WHEN abs(g) < 1e-10 THEN 0 ELSE greatest(-1, least(1, m / g - 1)) END AS x FROM {_join("m", ["g"])}), {_ema("stc", "raw", "x", 10)},
c AS (SELECT symbol, seq, least(greatest(stc, {tail(0.01)}), {tail(0.99)}) AS c FROM {_join("bars", ["stc"])}),
z AS (SELECT symbol, seq, (c - avg(c) OVER (PARTITION BY symbol)) / (stddev_samp(c) OVER (PARTITION BY symbol) + 1e-10) AS z FROM c),
v AS (SELECT symbol, seq, ("High" + "Low" + "Close") / 3 * "Volume" AS pv, "Volume" AS v FROM bars), p AS (SELECT symbol, seq, v, {_full("max", "v", 20)} AS top, {_full("sum", "pv", window)} / nullif({_full("sum", "v", window)}, 0) AS p FROM v),
q AS (SELECT symbol, seq, (p - {_full("avg", "p", 10)}) / nullif({_full("stddev_samp", "p", 10)}, 0) AS vp, atanh(least(1 - 1e-7, v / CASE WHEN top = 0 THEN 1 ELSE top END)) AS w FROM p),
l AS (SELECT symbol, seq, CASE WHEN w IS NOT NULL THEN 2 * vp / (1 + 1 / (1 + exp(n))) - z * w END AS l FROM q JOIN n USING (symbol, seq) JOIN z USING (symbol, seq))
SELECT {_rounded(LISS="(l - min(l) OVER (PARTITION BY symbol)) / (max(l) OVER (PARTITION BY symbol) - min(l) OVER (PARTITION BY symbol) + 1e-10)")} FROM l"""


def volume_dynamics(bars: str, column: str, sigma: float) -> str:
    raw = {
        "rolling_std_10": _full("stddev_samp", "v", 10), "rolling_std_30": _full("stddev_samp", "v", 30), "diff_1": "d", "rolling_diff_mean_10": _full("avg", "d", 10), "pct_change": "p",
        "pct_change_rolling_mean_10": _full("avg", "p", 10), "diff2": f"d - lag(d) OVER {W}", "spike": _full("sum", "s", 10), "up_cluster": _full("sum", "u", 10), "down_cluster": _full("sum", "w", 10), "volume_cluster_diff": _full("sum", "u - w", 10),
    }
    scaled = lambda c: f"2 * ({c} - {_full('min', c, 100)}) / ({_full('max', c, 100)} - {_full('min', c, 100)} + 1e-8) - 1"
    return f"""WITH bars AS ({bars}), v AS (SELECT symbol, seq, "{column}" AS v, CASE WHEN "Close" > "Open" THEN "{column}" ELSE 0 END AS u, CASE WHEN "Close" < "Open" THEN "{column}" ELSE 0 END AS w FROM bars),
d AS (SELECT *, v - lag(v) OVER {W} AS d, v / nullif(lag(v) OVER {W}, 0) - 1 AS p, coalesce(v > {_full("avg", "v", 20)} + {sigma} * {_full("stddev_samp", "v", 20)}, false)::INT AS s FROM v),
r AS (SELECT symbol, seq, {", ".join(f"{x} AS {c}" for c, x in raw.items())} FROM d) SELECT {_rounded(**{f"{column}_{c}": scaled(c) for c in raw})} FROM r"""


def money_flows(bars: str, length: int) -> str:
    """The force index starts at the 13th row with the mean of the changes so far."""
    return f"""WITH bars AS ({bars}), d AS MATERIALIZED (SELECT symbol, seq, "Volume" AS v, ("High" + "Low" + "Close") / 3 AS t, ("Close" - lag("Close") OVER {W}) AS d, coalesce((2 * "Close" - "High" - "Low") / nullif("High" - "Low", 0), 0) * "Volume" AS a FROM bars),
s AS MATERIALIZED (SELECT symbol, seq, CASE WHEN seq = 13 THEN avg(d * v) OVER {W} WHEN seq > 13 THEN d * v END AS x FROM d), {_ema("e", "s", "x", 13)},
t AS (SELECT *, t - lag(t) OVER {W} AS dt FROM d), f AS (SELECT *, CASE WHEN dt > 0 THEN t * v ELSE 0 END AS up, CASE WHEN dt <> 0 THEN t * v ELSE 0 END AS moved FROM t)
SELECT {_rounded(OBV="CASE WHEN seq > 1 THEN sign(d) * v / (v + 1e-8) END", AD="CASE WHEN seq > 1 THEN a / (v + 1e-8) END", EFI=f"e / ({_full('avg', 'v', 10)} + 1e-8)", CMF=f"{_full('sum', 'a', length)} / nullif({_full('sum', 'v', length)}, 0)", MFI=f"100 * {_full('sum', 'up', length)} / nullif({_full('sum', 'moved', length)}, 0)")}
FROM f LEFT JOIN (SELECT symbol, seq, y AS e FROM e) USING (symbol, seq)"""


def rsi_and_flow(bars: str, period: int, length: int) -> str:
    return f"""WITH bars AS ({bars}), d AS (SELECT symbol, seq, "Close" AS c, coalesce("Close" - lag("Close") OVER {W}, 0) AS d, (2 * "Close" - "Low" - "High") / ("High" - "Low" + 1e-8) * "Volume" AS f, "Volume" AS v FROM bars),
m AS (SELECT *, 100 - 100 / (1 + {_full("avg", "greatest(d, 0)", period)} / ({_full("avg", "greatest(-d, 0)", period)} + 1e-8)) AS r, {_full("sum", "f", length)} / ({_full("sum", "v", length)} + 1e-8) AS cmf FROM d),
n AS (SELECT *, {_full("avg", "r", 20)} AS ma, r - lag(r) OVER {W} AS dr, round(cmf - lag(cmf) OVER {W}, 12) AS df, c - lag(c) OVER {W} AS dc FROM m)
SELECT {_rounded(RSI_14_manual="r", RSI_14_zscore="coalesce((r - avg(r) OVER (PARTITION BY symbol)) / (stddev_pop(r) OVER (PARTITION BY symbol) + 1e-8), 0)", RSI_14_ma="ma", RSI_dist_from_mean="r - ma", cmf_manual="cmf", cmf_price_div="coalesce((df > 0 AND dc < 0)::INT, 0)", rsi_price_div="coalesce((dr > 0 AND dc < 0)::INT, 0)")} FROM n"""
