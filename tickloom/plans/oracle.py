"""DuckDB SQL for the registered market queries, written apart from the Spark operators."""

from __future__ import annotations

_DAY = 86_400_000_000_000
_STEPS = {1: 1103515245, 2: 22695477, 3: 1664525, 4: 1103527590, 5: 134775813}
_MIX = ", ".join(f"((g * g * {69069 + 15838 * i} + g * {m} + {12345 * i}) % 2147483648) // 65536 AS r{i}" for i, m in _STEPS.items())
_BASE = f"""
e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS us, event_id // 3 AS g FROM events),
m AS (SELECT *, {_MIX} FROM e),
tape AS (SELECT CAST(user_id % 5 AS INT) AS symbol, us // 86400000000 AS day, event_id AS seq, us * 1000 AS time_ns,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'click' THEN 5 END AS kind, event_id % 13 AS order_id,
         1 + CAST(floor(value) AS BIGINT) AS size, 1000000 + 100 * CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS price, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS direction FROM e),
book AS (SELECT 0 AS symbol, us // 86400000000 AS day, event_id AS seq, (us % 86400000000) * 1000 AS time_ns, event_id % 97 = 0 AS gone,
         1000000 + 100 * (r1 % 11) AS b, 1000000 + 100 * (r1 % 11) + 100 * (1 + r2 % 5) AS a, 100 * (1 + r3 % 6) + r3 % 7 AS bs, 100 * (1 + r4 % 6) + r4 % 7 AS az, least(10, 3 + r3 % 8) AS n, 100 * (1 + r2 % 3) AS step FROM m)"""


def _top(size: str, k: int) -> str:
    return f"(least({k}, n) * {size} + 5 * least({k}, n) * (least({k}, n) - 1))"


def _states(close: int = _DAY) -> str:
    return f"""{_BASE},
st AS (SELECT *, time_ns AS t0, greatest(time_ns, coalesce(lead(time_ns) OVER (PARTITION BY symbol, day ORDER BY seq), {close})) AS t1 FROM book)"""


def _sums(ns: str) -> str:
    h = lambda x: f"coalesce(sum(CAST({x} AS HUGEINT) * {ns}), 0)"
    one = "CASE WHEN NOT gone THEN 1 ELSE 0 END"
    parts = {"hold_ns": h("1"), "two_sided_ns": h(one), "one_sided_ns": h("CASE WHEN gone THEN 1 ELSE 0 END"), "empty_ns": h("0"), "spread_x_ns": h(f"({one}) * (a - b)"), "mid2_x_ns": h(f"({one}) * (a + b)"), "one_cent_ns": h(f"({one}) * CASE WHEN a - b = 100 THEN 1 ELSE 0 END"),
             "touch_x_ns": h(f"({one}) * (bs + az)"), "depth5_x_ns": h(f"({one}) * ({_top('bs', 5)} + {_top('az', 5)})"), "depth10_x_ns": h(f"({one}) * ({_top('bs', 10)} + {_top('az', 10)})")}
    return ", ".join(f"{v} AS {k}" for k, v in parts.items())


def _r(top: str, bottom: str, scale: str = "1.0", places: int = 6) -> str:
    return f"round(CAST({top} AS DOUBLE) * {scale} / nullif(CAST({bottom} AS DOUBLE), 0), {places})"


def _exact(top: str, bottom: str, times: int = 1, over: int = 1) -> str:
    """A ratio rounded half up to six places by whole-number division."""
    return f"CAST((CAST({top} AS HUGEINT) * {2_000_000 * times} + CAST({bottom} AS HUGEINT) * {over}) // nullif(CAST({bottom} AS HUGEINT) * {2 * over}, 0) AS DOUBLE) / 1e6"


_RATIOS = {
    "tw_spread_ticks": _exact("spread_x_ns", "two_sided_ns"), "tw_spread_cents": _exact("spread_x_ns", "two_sided_ns", 1, 100),
    "tw_spread_bps": _exact("spread_x_ns", "mid2_x_ns", 20_000), "tw_mid": _exact("mid2_x_ns", "two_sided_ns", 1, 2),
    "one_cent_share": _exact("one_cent_ns", "two_sided_ns"), "touch": _exact("touch_x_ns", "two_sided_ns"),
    "depth5": _exact("depth5_x_ns", "two_sided_ns"), "depth10": _exact("depth10_x_ns", "two_sided_ns"),
    "one_sided_share": _exact("(one_sided_ns + empty_ns)", "hold_ns"),
}
_WIDE = ("hold_ns", "two_sided_ns", "one_sided_ns", "empty_ns", "spread_x_ns", "mid2_x_ns", "one_cent_ns", "touch_x_ns", "depth5_x_ns", "depth10_x_ns")
_text = lambda names: ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)
_ratios = lambda names: ", ".join(f"{_RATIOS[n]} AS {n}" for n in names)


def _bins(width: int, open_ns: int = 0, close_ns: int = _DAY) -> str:
    """Range join of states to a table of bins."""
    return f"""{_states(close_ns)},
grid AS (SELECT symbol, day, bin, {open_ns} + bin * {width} AS lo, least({open_ns} + (bin + 1) * {width}, {close_ns}) AS hi FROM (SELECT DISTINCT symbol, day FROM book), (SELECT unnest(range({-(-(close_ns - open_ns) // width)})) AS bin)),
cut AS (SELECT g.symbol, g.day, g.bin, s.* EXCLUDE (symbol, day), CASE WHEN t0 IS NULL THEN 0 ELSE least(t1, hi) - greatest(t0, lo) END AS ns FROM grid g LEFT JOIN st s ON s.symbol = g.symbol AND s.day = g.day AND t0 < hi AND t1 > lo),
bins AS (SELECT symbol, day, bin, {_sums("ns")} FROM cut GROUP BY ALL)"""


_SESSION = f"""WITH {_bins(300_000_000_000, 34_200_000_000_000, 57_600_000_000_000)}
SELECT symbol, day, bin, 34200 + bin * 300 AS start_s, printf('%02d:%02d:00', (34200 + bin * 300) // 3600, (34200 + bin * 300) % 3600 // 60) AS start_hms, {_text(("hold_ns", "spread_x_ns"))}, {_ratios(("tw_spread_bps",))} FROM bins"""
_WINDOWS = f"""WITH {_states()},
w AS (SELECT * FROM (VALUES ('day', 0, {_DAY}), ('open5', 0, 300000000000), ('midday', 39600000000000, 50400000000000), ('close5', {_DAY} - 300000000000, {_DAY})) AS t(name, lo, hi)),
days AS (SELECT DISTINCT symbol, day FROM book),
cut AS (SELECT d.symbol, d.day, w.name, s.* EXCLUDE (symbol, day), CASE WHEN t0 IS NULL THEN 0 ELSE least(t1, hi) - greatest(t0, lo) END AS ns FROM days d CROSS JOIN w LEFT JOIN st s ON s.symbol = d.symbol AND s.day = d.day AND t0 < hi AND t1 > lo),
g AS (SELECT symbol, day, name, {_sums("ns")} FROM cut GROUP BY ALL)
SELECT symbol, day, name AS "window", {_text(("spread_x_ns", "mid2_x_ns", "touch_x_ns"))}, {_ratios(("tw_spread_cents", "tw_spread_bps", "depth10", "one_sided_share"))} FROM g"""
_COUNTS = f"""WITH {_BASE} SELECT symbol, day, time_ns // 300000000000 AS bin, count(*) AS messages, count(*) FILTER (kind = 1) AS adds, CAST(coalesce(sum(size) FILTER (kind = 1), 0) AS BIGINT) AS add_shares,
 count(*) FILTER (kind IN (2, 3)) AS cancels, CAST(coalesce(sum(size) FILTER (kind IN (2, 3)), 0) AS BIGINT) AS cancel_shares, count(*) FILTER (kind = 4) AS trades, CAST(coalesce(sum(size) FILTER (kind = 4), 0) AS BIGINT) AS trade_shares,
 count(*) FILTER (kind = 5) AS hidden, CAST(coalesce(sum(size) FILTER (kind = 5), 0) AS BIGINT) AS hidden_shares, count(*) FILTER (kind IN (4, 5) AND size < 100) AS odd_lot_trades FROM tape GROUP BY ALL"""
_LONG = f"""{_states()},
two AS (SELECT *, t1 - t0 AS hold FROM st WHERE NOT gone AND t1 > t0),
whole AS (SELECT symbol, day, sum(CAST(hold AS HUGEINT)) AS two_ns FROM two GROUP BY ALL),
lv AS (SELECT symbol, day, hold, side, j, step, n, CASE side WHEN 'ask' THEN az ELSE bs END + 10 * (j - 1) AS size FROM two, (SELECT unnest(['ask', 'bid']) AS side), (SELECT unnest(range(1, 11)) AS j) WHERE j <= n)"""
_LEVELS = f"""WITH {_LONG}, g AS (SELECT symbol, day, side, j, sum(CAST(hold AS HUGEINT)) AS ex, sum(CAST(size AS HUGEINT) * hold) AS sx, sum(CAST((j - 1) * step AS HUGEINT) * hold) AS gx, sum(CAST(step AS HUGEINT) * hold) AS ax, coalesce(sum(CAST(hold AS HUGEINT)) FILTER (step = 100), 0) AS cx FROM lv GROUP BY ALL)
SELECT symbol, day, side, j AS level, CAST(ex AS VARCHAR) AS exists_ns, CAST(sx AS VARCHAR) AS size_x_ns, {_r("sx", "ex")} AS tw_size, {_r("gx", "ex", "CAST(0.01 AS DOUBLE)")} AS tw_gap_cents, {_r("ex", "two_ns")} AS exists_share,
 CASE WHEN j > 1 THEN {_r("ax", "ex", "CAST(0.01 AS DOUBLE)")} END AS adjacent_gap_cents, CASE WHEN j > 1 THEN {_r("cx", "ex")} END AS one_cent_gap_share,
 {_r("sum(ax) FILTER (j > 1) OVER side", "(sum(ex) FILTER (j > 1) OVER side)", "CAST(0.01 AS DOUBLE)")} AS side_gap_cents,
 {_r("sum(cx) FILTER (j > 1) OVER side", "(sum(ex) FILTER (j > 1) OVER side)")} AS side_one_cent_share
 FROM g JOIN whole USING (symbol, day) WINDOW side AS (PARTITION BY symbol, day, side)"""
_CENTS = f"""WITH {_LONG}, grid AS (SELECT symbol, day, side, cent FROM whole, (SELECT unnest(['ask', 'bid']) AS side), (SELECT unnest(range(0, 21)) AS cent)),
sx AS (SELECT symbol, day, side, (j - 1) * step // 100 AS cent, sum(CAST(size AS HUGEINT) * hold) AS x FROM lv GROUP BY ALL),
cov AS (SELECT g.symbol, g.day, g.cent, sum(CAST(hold AS HUGEINT)) AS c FROM (SELECT DISTINCT symbol, day, cent FROM grid) g JOIN two t ON t.symbol = g.symbol AND t.day = g.day AND (n - 1) * step // 100 >= cent GROUP BY ALL)
SELECT g.symbol, g.day, side, g.cent, CAST(coalesce(x, 0) AS VARCHAR) AS size_x_ns, CAST(coalesce(c, 0) AS VARCHAR) AS covered_ns, {_r("coalesce(x, 0)", "coalesce(c, 0)")} AS tw_size, {_r("coalesce(c, 0)", "two_ns")} AS coverage
FROM grid g JOIN whole USING (symbol, day) LEFT JOIN sx USING (symbol, day, side, cent) LEFT JOIN cov ON cov.symbol = g.symbol AND cov.day = g.day AND cov.cent = g.cent"""

_EV = f"""{_BASE},
num AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY seq) AS k FROM book WHERE NOT gone),
ev AS (SELECT c.symbol, c.day, c.seq, p.time_ns AS time_prev, c.time_ns, CAST((c.b >= p.b)::INT * c.bs - (c.b <= p.b)::INT * p.bs - (c.a <= p.a)::INT * c.az + (c.a >= p.a)::INT * p.az AS BIGINT) AS e, p.b + p.a AS mid2_prev, c.b + c.a AS mid2
       FROM num c JOIN num p ON p.symbol = c.symbol AND p.day = c.day AND p.k = c.k - 1)"""


def _calendar(name: str, width: int) -> str:
    """Buckets with mids by as-of joins of their edges to the events."""
    return f"""
{name}_g AS (SELECT symbol, day, bucket, bucket * {width} AS start_ns, least((bucket + 1) * {width}, {_DAY}) AS end_ns FROM (SELECT DISTINCT symbol, day FROM ev), (SELECT unnest(range({-(-_DAY // width)})) AS bucket)),
{name}_s AS (SELECT symbol, day, time_ns // {width} AS bucket, count(*) AS n_events, count(*) FILTER (e <> 0) AS n_updates, CAST(sum(e) AS BIGINT) AS ofi, CAST(sum(abs(e)) AS BIGINT) AS abs_flow FROM ev GROUP BY ALL),
{name}_f AS (SELECT symbol, day, arg_min(mid2_prev, seq) AS m FROM ev GROUP BY ALL),
{name}_l AS (SELECT symbol, day, time_ns, arg_max(mid2, seq) AS mid2 FROM ev GROUP BY ALL),
{name}_o AS (SELECT g.*, l.mid2 AS mo FROM {name}_g g ASOF LEFT JOIN {name}_l l ON l.symbol = g.symbol AND l.day = g.day AND g.start_ns > l.time_ns),
{name}_c AS (SELECT g.*, l.mid2 AS mc FROM {name}_o g ASOF LEFT JOIN {name}_l l ON l.symbol = g.symbol AND l.day = g.day AND g.end_ns > l.time_ns),
{name} AS (SELECT c.symbol, c.day, c.bucket, start_ns, end_ns, coalesce(n_events, 0) AS n_events, coalesce(n_updates, 0) AS n_updates, coalesce(ofi, 0) AS ofi, coalesce(abs_flow, 0) AS abs_flow, coalesce(mo, m) AS mid2_open, coalesce(mc, m) AS mid2_close,
   end_ns - start_ns AS duration_ns, (coalesce(mc, m) - coalesce(mo, m)) / 200.0::DOUBLE AS dmid_cents, (coalesce(mc, m) - coalesce(mo, m)) * 10000::DOUBLE / coalesce(mo, m) AS dmid_bps
   FROM {name}_c c LEFT JOIN {name}_s s USING (symbol, day, bucket) JOIN {name}_f f ON f.symbol = c.symbol AND f.day = c.day)"""


_HMS = "printf('%02d:%02d:%02d', start_ns // 3600000000000, start_ns // 60000000000 % 60, start_ns // 1000000000 % 60) AS start_hms"
_CAL = f"WITH {_EV}, {_calendar('cal', 600_000_000_000)} SELECT * EXCLUDE (dmid_cents, dmid_bps), round(dmid_cents, 6) AS dmid_cents, round(dmid_bps, 6) AS dmid_bps, {_HMS} FROM cal"
_OFI_DAY = f"""WITH {_EV},
g AS (SELECT symbol, day, count(*) AS n_events, count(*) FILTER (e = 0) AS zero, count(*) FILTER (e > 0) AS positive, count(*) FILTER (e < 0) AS negative,
 CAST(sum(e) AS BIGINT) AS net, CAST(sum(abs(e)) AS BIGINT) AS gross, CAST(coalesce(sum(e) FILTER (e > 0), 0) AS BIGINT) AS buy_shares,
 CAST(coalesce(-sum(e) FILTER (e < 0), 0) AS BIGINT) AS sell_shares, first(mid2_prev ORDER BY seq) AS mid2_open, last(mid2 ORDER BY seq) AS mid2_close,
 first(e ORDER BY abs(e) DESC, seq) AS largest, first(time_ns ORDER BY abs(e) DESC, seq) AS largest_ns FROM ev GROUP BY ALL)
SELECT *, {_r("zero", "n_events")} AS zero_share, {_r("abs(net)", "gross")} AS net_share, round((mid2_close - mid2_open) / 200.0::DOUBLE, 6) AS dmid_cents,
 {_r("mid2_close - mid2_open", "mid2_open", "CAST(10000 AS DOUBLE)")} AS dmid_bps FROM g"""


def _clock(name: str, n: int) -> str:
    """Updates are numbered; zero events go to the bucket of the next update, so to the open one."""
    return f"""
{name}_u AS (SELECT symbol, day, seq, (row_number() OVER (PARTITION BY symbol, day ORDER BY seq) - 1) // {n} AS bucket FROM ev WHERE e <> 0),
{name}_x AS (SELECT ev.*, u.bucket FROM ev ASOF JOIN {name}_u u ON u.symbol = ev.symbol AND u.day = ev.day AND ev.seq <= u.seq),
{name} AS (SELECT symbol, day, bucket, min(time_prev) AS start_ns, max(time_ns) AS end_ns, count(*) AS n_events, count(*) FILTER (e <> 0) AS n_updates, CAST(sum(e) AS BIGINT) AS ofi, CAST(sum(abs(e)) AS BIGINT) AS abs_flow, first(mid2_prev ORDER BY seq) AS mid2_open, last(mid2 ORDER BY seq) AS mid2_close
  FROM {name}_x GROUP BY ALL HAVING count(*) FILTER (e <> 0) = {n})"""


_EVENT_CLOCK = f"""WITH {_EV}, {_clock("ec", 10)} SELECT *, end_ns - start_ns AS duration_ns, round((mid2_close - mid2_open) / 200.0::DOUBLE, 6) AS dmid_cents, {_r("mid2_close - mid2_open", "mid2_open", "CAST(10000 AS DOUBLE)")} AS dmid_bps, {_HMS} FROM ec"""


def _ols(rows: str, key: str, x: str, y: str) -> str:
    """Two passes: the slopes, then the residuals' squares of each row."""
    both = f"({x} <> 0 AND {y} <> 0)"
    return f"""SELECT {key}, n, round(b0, 6) AS beta0, CASE WHEN yv THEN round(1 - sum(({y} - b0 * {x}) ** 2) / sum(({y} - my) ** 2), 6) END AS r2_origin,
 round(b1, 6) AS beta, round(my - b1 * mx, 6) AS alpha, CASE WHEN yv THEN round(1 - sum(({y} - (my - b1 * mx) - b1 * {x}) ** 2) / sum(({y} - my) ** 2), 6) END AS r2,
 round(count(*) FILTER ({both} AND sign({x}) = sign({y})) / nullif(CAST(count(*) FILTER {both} AS DOUBLE), 0), 6) AS hit_rate, count(*) - count(*) FILTER {both} AS excluded
 FROM {rows} JOIN (SELECT {key}, count(*) AS n, avg({x}) AS mx, avg({y}) AS my, sum({x} * {y}) / nullif(sum({x} * {x}), 0) AS b0, CASE WHEN min({x}) < max({x}) THEN regr_slope({y}, {x}) END AS b1,
  min({y}) < max({y}) AS yv FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {key}) USING ({key}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {key}, n, mx, my, b0, b1, yv"""


_XY = "(SELECT *, CAST(ofi AS DOUBLE) AS x, CAST(dmid_cents AS DOUBLE) AS y FROM {})"
_FIRST_LOOK = f"""WITH {_EV}, {_calendar("c1", 600_000_000_000)}, {_calendar("c2", 3_600_000_000_000)}, {_clock("k1", 5)}, {_clock("k2", 20)},
allrows AS (SELECT '600 s' AS clock, ofi, dmid_cents FROM c1 UNION ALL SELECT '3600 s', ofi, dmid_cents FROM c2 UNION ALL SELECT '5 updates', ofi, (mid2_close - mid2_open) / 200.0::DOUBLE FROM k1 UNION ALL SELECT '20 updates', ofi, (mid2_close - mid2_open) / 200.0::DOUBLE FROM k2)
{_ols(_XY.format("allrows"), "clock", "x", "y")}"""
_SCALING = f"""WITH {_bins(7_200_000_000_000)}, {_EV.removeprefix(_BASE + ",")}, {_calendar("cal", 600_000_000_000)},
w AS (SELECT symbol, day, start_ns // 7200000000000 AS bin, sum(x * y) / nullif(sum(x * x), 0) AS beta0 FROM {_XY.format("cal")} GROUP BY ALL),
d AS (SELECT w.*, CAST(touch_x_ns AS DOUBLE) / nullif(CAST(two_sided_ns AS DOUBLE), 0) / 2 AS depth FROM w JOIN bins USING (symbol, day, bin)),
l AS (SELECT symbol, day, coalesce(beta0 > 0 AND depth > 0, false) AS good, CASE WHEN beta0 > 0 AND depth > 0 THEN ln(depth) END AS lx, CASE WHEN beta0 > 0 AND depth > 0 THEN ln(beta0) END AS ly FROM d),
f AS (SELECT symbol, day, count(*) FILTER (good) AS used, count(*) FILTER (NOT good) AS skipped, regr_slope(ly, lx) AS sl, regr_intercept(ly, lx) AS ic, regr_r2(ly, lx) AS r, min(lx) < max(lx) AS ok, min(ly) < max(ly) AS yok FROM l GROUP BY ALL)
SELECT symbol, day, used, skipped, CASE WHEN used >= 3 AND ok THEN round(sl, 6) END AS slope, CASE WHEN used >= 3 AND ok THEN round(ic, 6) END AS intercept, CASE WHEN used >= 3 AND ok AND yok THEN round(r, 6) END AS r2 FROM f"""

_OPS = f"""{_BASE},
o1 AS (SELECT t.*, (SELECT count(*) FROM tape u WHERE u.symbol = t.symbol AND u.day = t.day AND u.order_id = t.order_id AND u.kind = 1 AND u.seq <= t.seq) AS life_no FROM tape t WHERE kind BETWEEN 1 AND 4),
born AS (SELECT symbol, day, order_id, life_no, seq AS add_seq, time_ns AS added_ns, size AS added, price AS add_price, direction AS add_direction FROM o1 WHERE kind = 1),
o2 AS (SELECT o.*, coalesce(sum(CASE WHEN kind <> 1 THEN size END) OVER w, 0) AS cum, coalesce(bool_or(kind = 3) OVER w, false) AS deleted FROM o1 o WINDOW w AS (PARTITION BY symbol, day, order_id, life_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ops AS (SELECT o.*, add_seq, added_ns, added, add_price, add_direction, kind <> 1 AND (o.life_no = 0 OR deleted OR (cum > 0 AND cum >= added)) AS dark, CASE WHEN o.life_no > 0 THEN greatest(added - cum, 0) END AS rest FROM o2 o LEFT JOIN born b ON b.symbol = o.symbol AND b.day = o.day AND b.order_id = o.order_id AND b.life_no = o.life_no),
act AS (SELECT *, CASE WHEN kind = 1 THEN NULL WHEN kind = 3 THEN rest ELSE least(size, rest) END AS take, kind <> 1 AND (kind = 3 OR size >= rest) AS ends, kind <> 1 AND (size > rest OR (kind = 3 AND size <> rest)) AS disagrees FROM ops WHERE life_no > 0 AND NOT dark),
life AS (SELECT symbol, day, order_id, life_no, any_value(added_ns) AS added_ns, any_value(add_direction) AS direction, any_value(add_price) AS price, any_value(add_seq) AS add_seq, any_value(added) AS added, CAST(coalesce(sum(take) FILTER (kind = 4), 0) AS BIGINT) AS executed, CAST(coalesce(sum(take) FILTER (kind IN (2, 3)), 0) AS BIGINT) AS cancelled,
 count(*) FILTER (kind = 4) AS fills, min(time_ns) FILTER (kind = 4) AS first_fill_ns, max(time_ns) AS last_seen_ns, max(time_ns) FILTER (ends) AS end_ns, max(kind) FILTER (ends) AS end_kind, count(*) FILTER (disagrees) AS disagreements FROM act GROUP BY symbol, day, order_id, life_no),
lives AS (SELECT *, CASE WHEN end_ns IS NULL THEN 'censored' WHEN end_kind = 4 THEN 'executed' ELSE 'cancelled' END AS outcome, CAST(added - executed - cancelled AS BIGINT) AS remaining, end_ns - added_ns AS lifetime_ns, CASE WHEN end_ns IS NULL THEN last_seen_ns - added_ns END AS censor_ns FROM life)"""
_BUCKET = """CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'improve' WHEN d = 0 THEN 'at_best' WHEN d = 1 THEN '1' WHEN d <= 5 THEN '2_to_5' WHEN d <= 10 THEN '6_to_10' ELSE 'over_10' END"""
_DIST = f"""WITH {_OPS}, bk AS (SELECT t.symbol, t.day, t.seq, CASE WHEN NOT gone THEN b END AS b, a FROM tape t JOIN book USING (seq)), prior AS (SELECT symbol, seq, lag(b) OVER (PARTITION BY symbol, day ORDER BY seq) AS pb, lag(a) OVER (PARTITION BY symbol, day ORDER BY seq) AS pa FROM bk),
x AS (SELECT l.*, trunc(CASE WHEN direction = 1 THEN pb - price ELSE price - pa END / 100.0::DOUBLE) AS d FROM lives l JOIN prior p ON p.symbol = l.symbol AND p.seq = l.add_seq),
g AS (SELECT symbol, day, {_BUCKET} AS bucket, count(*) AS orders, count(*) FILTER (executed > 0) AS filled, CAST(sum(added) AS BIGINT) AS shares, CAST(sum(executed) AS BIGINT) AS filled_shares FROM x GROUP BY ALL)
SELECT *, {_r("filled", "orders")} AS fill_rate, {_r("filled_shares", "shares")} AS share_fill_rate FROM g"""
_KM = f"""{_OPS}, dur AS (SELECT symbol, day, CASE WHEN outcome = 'censored' THEN censor_ns ELSE lifetime_ns END AS t, outcome <> 'censored' AS died FROM lives),
dt AS (SELECT symbol, day, t, count(*) AS deaths FROM dur WHERE died GROUP BY ALL),
risk AS (SELECT d.*, (SELECT count(*) FROM dur u WHERE u.symbol = d.symbol AND u.day = d.day AND u.t >= d.t) AS at_risk FROM dt d),
km AS (SELECT symbol, day, t, at_risk, deaths, product(1 - deaths / CAST(at_risk AS DOUBLE)) OVER (PARTITION BY symbol, day ORDER BY t) AS survival FROM risk)"""
_GRID = ", ".join(f"({t})" for t in (*filter(lambda t: t <= _DAY, (int(10 ** (9 + k / 5)) for k in range(36))), _DAY))
_SURVIVAL = f"""WITH {_KM}, grid AS (SELECT symbol, day, CAST(t AS BIGINT) AS t FROM (SELECT DISTINCT symbol, day FROM dur), (VALUES {_GRID}) AS v(t))
SELECT g.symbol, g.day, g.t,
 round(coalesce((SELECT survival FROM km k WHERE k.symbol = g.symbol AND k.day = g.day AND k.t <= g.t ORDER BY k.t DESC LIMIT 1), 1), 6) AS s_km,
 round(1 - (SELECT count(*) FROM dur u WHERE u.symbol = g.symbol AND u.day = g.day AND died AND u.t <= g.t) / nullif(CAST(n_observed AS DOUBLE), 0), 6) AS s_naive,
 n_observed, n_censored
FROM grid g JOIN (SELECT symbol, day, count(*) FILTER (died) AS n_observed, count(*) FILTER (NOT died) AS n_censored FROM dur GROUP BY ALL) USING (symbol, day)"""
_LOT = lambda c: f"CASE WHEN {c} < 100 THEN 'odd' WHEN {c} % 100 = 0 THEN 'round' ELSE 'mixed' END"
_KIND_NAMES = ("adds", "reduces", "deletes", "executes", "hiddens")


def _c2t(start: int, end: int) -> str:
    inside = f"time_ns >= {start} AND time_ns < {end}"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS {c}, count(*) FILTER (kind = {k} AND {inside}) AS {c}_inside" for k, c in enumerate(_KIND_NAMES, 1))
    lots = ", ".join(f"count(*) FILTER (kind IN (4, 5) AND {_LOT('size')} = '{k}') AS {k}_lots" for k in ("round", "odd", "mixed"))
    return f"""raw AS (SELECT symbol, day, {counts}, {lots} FROM tape GROUP BY ALL),
dk AS (SELECT symbol, day, count(*) FILTER (dark) AS dark_ops, CAST(coalesce(sum(size) FILTER (dark), 0) AS BIGINT) AS dark_shares FROM ops GROUP BY ALL),
lf AS (SELECT symbol, day, count(*) FILTER (outcome = 'cancelled') AS cancelled_orders, count(*) FILTER (outcome = 'executed') AS executed_orders, CAST(sum(cancelled) AS BIGINT) AS cancelled_shares, CAST(sum(executed) AS BIGINT) AS executed_shares FROM lives GROUP BY ALL),
c2t AS (SELECT *, {_r("reduces + deletes", "(executes + hiddens)")} AS by_messages, {_r("reduces_inside + deletes_inside", "(executes_inside + hiddens_inside)")} AS by_messages_inside, {_r("cancelled_orders", "executed_orders")} AS by_orders,
 {_r("cancelled_shares", "executed_shares")} AS by_shares, {_r("hiddens", "(executes + hiddens)")} AS hidden_share, {_r("odd_lots", "(executes + hiddens)")} AS odd_lot_share FROM raw LEFT JOIN dk USING (symbol, day) LEFT JOIN lf USING (symbol, day))"""


_C2T = f"WITH {_OPS}, {_c2t(1_704_153_600 * 10**9, 1_706_572_800 * 10**9)} SELECT * FROM c2t"
_pick = lambda v, q: f"list_sort(list({v}))[1 + least(count({v}) - 1, CAST(floor({q}::DOUBLE * count({v})) AS BIGINT))]"


def _cells(section: str, names: dict[str, str], rows: str) -> str:
    """Some columns of a table of (symbol, day) as long rows."""
    return f"SELECT symbol, day, '{section}' AS section, unnest([{', '.join(repr(k) for k in names)}]) AS statistic, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in names.values())}]) AS value FROM {rows}"


def _life_summary() -> str:
    share = lambda a, b="n": f"{a} / nullif(CAST({b} AS DOUBLE), 0)"
    kinds = ("executed", "cancelled", "censored")
    ends = {"orders_added": "n"} | {f"orders_{k}": f"n_{k}" for k in kinds} | {f"share_{k}": share(f"n_{k}") for k in kinds}
    ends |= {f"shares_{k}": f"sh_{k}" for k in ("added", "executed", "cancelled")} | {"shares_unresolved": "sh_added - sh_executed - sh_cancelled"}
    naive = {f"share_{k}": share(k, "observed") for k in ("under_100ms", "under_1s", "over_1min")}
    naive |= {"observed_p50_ms": f"{_pick('CASE WHEN seen THEN lifetime_ns END', 0.5)} / 1e6"}
    picks = {f"{k}_p{round(q * 100)}_ms": f"(SELECT {_pick('lifetime_ns', q)} / 1e6 FROM lv v WHERE v.symbol = g.symbol AND v.day = g.day AND outcome = '{k}')" for k in kinds[:2] for q in (0.1, 0.5, 0.9)}
    picks |= {"observed_p50_ms": f"(SELECT {_pick('lifetime_ns', 0.5)} / 1e6 FROM lv v WHERE v.symbol = g.symbol AND v.day = g.day AND outcome <> 'censored')"}
    naive = {k: v for k, v in naive.items() if k != "observed_p50_ms"} | picks
    times = {"1ms": 10**6, "10ms": 10**7, "100ms": 10**8, "1s": 10**9, "10s": 10**10, "1min": 6 * 10**10, "10min": 6 * 10**11, "1h": 36 * 10**11}
    seen = "FROM lv v WHERE v.symbol = g.symbol AND v.day = g.day AND outcome <> 'censored'"
    naive |= {f"S_at_{k}": f"(SELECT count(*) FILTER (lifetime_ns > {t}) / nullif(CAST(count(*) AS DOUBLE), 0) {seen})" for k, t in times.items()}
    at = "FROM km k WHERE k.symbol = g.symbol AND k.day = g.day"
    curve = {f"S_at_{k}": f"coalesce((SELECT arg_max(survival, t) {at} AND t <= {t}), 1)" for k, t in times.items()}
    curve |= {"median_ms": f"(SELECT min(t) FILTER (survival <= 0.5) / 1e6 {at})"}
    shown = {"orders": "count(*)", "share_of_adds": "count(*) / CAST(any_value(n) AS DOUBLE)", "fill_rate_shares": "sum(executed) / nullif(CAST(sum(added) AS DOUBLE), 0)", "fill_rate_orders": "count(*) FILTER (executed > 0) / nullif(CAST(count(*) AS DOUBLE), 0)"}
    buckets = ("improve", "at_best", "1", "2_to_5", "6_to_10", "over_10", "unknown")
    near = {f"{b}_{k}": f"(SELECT {v.replace('any_value(n)', 'g.n')} FROM bucketed v WHERE v.symbol = g.symbol AND v.day = g.day AND v.bucket = '{b}')" for b in buckets for k, v in shown.items()}
    sizes = {f"adds_{k}_lot_share": share(f"lot_{k}") for k in ("round", "odd", "mixed")} | {"add_size_mean": share("sh_added")}
    sizes |= {"add_size_p50": f"(SELECT {_pick('added', 0.5)} FROM lv v WHERE v.symbol = g.symbol AND v.day = g.day)"}
    c2t = {"by_messages_full_day": "(reduces + deletes) / nullif(CAST(executes + hiddens AS DOUBLE), 0)", "by_messages_midas_window": "(reduces_inside + deletes_inside) / nullif(CAST(executes_inside + hiddens_inside AS DOUBLE), 0)",
           "by_orders": "cancelled_orders / nullif(CAST(executed_orders AS DOUBLE), 0)", "by_shares": "cancelled_shares / nullif(CAST(executed_shares AS DOUBLE), 0)",
           "hidden_share_of_executions": "hiddens / nullif(CAST(executes + hiddens AS DOUBLE), 0)", "odd_lot_share_of_executions": "odd_lots / nullif(CAST(executes + hiddens AS DOUBLE), 0)"}
    parts = [
        _cells("ends", ends, "g"), _cells("lifetime_naive", naive, "g"), _cells("lifetime_km", {"censored_share": share("n_censored")}, "g"), _cells("sizes", sizes, "g"),
        _cells("cancel_to_trade", c2t, "c2t"), _cells("accounting", {"dark_ops": "dark_ops", "dark_shares": "dark_shares", "hidden_execs": "hiddens"}, "c2t"),
        _cells("accounting", {"size_disagreements": "disagreements", "readded_ids": "readded"}, "g"),
        _cells("lifetime_km", curve, "g"), _cells("fill_by_distance", near, "g"),
    ]
    counted = ", ".join(f"count(*) FILTER (outcome = '{k}') AS n_{k}" for k in kinds) + ", " + ", ".join(f"count(*) FILTER ({_LOT('added')} = '{k}') AS lot_{k}" for k in ("round", "odd", "mixed"))
    return f"""WITH {_KM}, {_DIST.removeprefix(f'WITH {_OPS}, ').split('g AS (SELECT')[0]}
bucketed AS (SELECT *, {_BUCKET} AS bucket FROM x), {_c2t(34_500 * 10**9, 57_600 * 10**9)},
lv AS (SELECT *, coalesce(lag(outcome) OVER (PARTITION BY symbol, day, order_id ORDER BY life_no) = 'censored', false) AS readds FROM lives),
g AS (SELECT symbol, day, count(*) AS n, {counted}, sum(added) AS sh_added, sum(executed) AS sh_executed, sum(cancelled) AS sh_cancelled, count(*) FILTER (outcome <> 'censored') AS observed,
 count(*) FILTER (lifetime_ns < 100000000) AS under_100ms, count(*) FILTER (lifetime_ns < 1000000000) AS under_1s, count(*) FILTER (lifetime_ns >= 60000000000) AS over_1min, count(*) FILTER (readds) AS readded, sum(disagreements) AS disagreements FROM lv GROUP BY ALL),
stats AS ({' UNION ALL '.join(parts)}) SELECT symbol, day, section, statistic, round(value, 6) AS value FROM stats"""


_q = lambda q: f"list_sort(list(lifetime_ns))[1 + least(count(*) - 1, CAST(floor({q}::DOUBLE * count(*)) AS BIGINT))]"
_DELTAS = f"{_OPS}, deltas AS (SELECT symbol, day, seq, order_id, life_no, add_direction AS direction, add_price AS price, add_seq, CAST(CASE WHEN kind = 1 THEN size ELSE -take END AS BIGINT) AS delta FROM act)"
_ITCH = f"""WITH {_DELTAS}, msg AS (SELECT d.symbol, t.time_ns // {_DAY} AS day, t.time_ns % {_DAY} AS ns, d.add_seq, d.direction, delta, 100 * (1 + (d.price // 100) % 20) AS away,
         CASE WHEN delta > 0 THEN 'A' WHEN sum(delta) OVER (PARTITION BY d.symbol, d.day, d.order_id, d.life_no ORDER BY d.seq) = 0 THEN 'D' ELSE 'X' END AS kind FROM deltas d JOIN tape t ON t.seq = d.seq WHERE delta <> 0)
SELECT CAST(symbol + 1 AS INT) AS stock_locate, day, kind, CASE WHEN kind = 'A' THEN 'SYM' || symbol END AS stock, min(ns) AS first_ns, max(ns) AS last_ns, count(*) AS messages, count(*) * CASE kind WHEN 'A' THEN 38 WHEN 'D' THEN 21 ELSE 25 END AS bytes, CAST(0 AS BIGINT) AS not_decoded,
       count(*) FILTER (kind = 'A' AND direction = 1) AS bids, CAST(sum(add_seq) AS BIGINT) AS order_ref, CAST(sum(CASE WHEN kind <> 'D' THEN abs(delta) END) AS BIGINT) AS shares, CAST(sum(CASE WHEN kind = 'A' THEN 1000000 - direction * away END) AS BIGINT) AS price FROM msg GROUP BY symbol, day, kind"""
_CLEAN = f"""WITH {_DELTAS}, live AS (SELECT d.symbol, d.day, d.seq, CASE WHEN delta > 0 THEN 1 WHEN sum(delta) OVER (PARTITION BY d.symbol, d.day, d.order_id, d.life_no ORDER BY d.seq) = 0 THEN -1 ELSE 0 END AS step FROM deltas d WHERE delta <> 0),
run AS (SELECT *, sum(step) OVER (PARTITION BY symbol, day ORDER BY seq) AS alive FROM live)
SELECT symbol, day, count(*) AS messages, count(*) AS applied, CAST(0 AS BIGINT) AS anomaly, CAST(0 AS BIGINT) AS crossing, CAST(0 AS BIGINT) AS unknown_ref, CAST(max(alive) AS BIGINT) AS max_live, true AS clean FROM run GROUP BY symbol, day"""
_REFUSED = f"""WITH {_DELTAS},
base AS (SELECT d.symbol, d.day, d.seq AS n, d.add_seq, d.direction AS side, 1000000 - d.direction * 100 * (1 + (d.price // 100) % 20) AS price, abs(delta) AS shares,
         CASE WHEN delta > 0 THEN 'A' WHEN sum(delta) OVER (PARTITION BY d.symbol, d.day, d.order_id, d.life_no ORDER BY d.seq) = 0 THEN 'D' ELSE 'X' END AS was FROM deltas d WHERE delta <> 0),
msg AS (SELECT *, CASE WHEN was = 'X' AND n % 3 = 0 THEN 'E' WHEN was = 'X' AND n % 3 = 1 THEN 'C' WHEN was = 'D' AND n % 4 = 0 THEN 'E' WHEN was = 'D' AND n % 4 = 1 THEN 'U' ELSE was END AS kind FROM base),
orders AS (SELECT symbol, day, any_value(side) AS side, any_value(price) AS price, add_seq AS place, max(n) FILTER (was = 'D') AS died FROM msg GROUP BY symbol, day, add_seq
           UNION ALL SELECT symbol, day, side, price, n, NULL FROM msg WHERE kind = 'U'),
front AS (SELECT e.symbol, e.day, e.n, count(o.place) > 0 AS behind FROM msg e LEFT JOIN orders o ON o.symbol = e.symbol AND o.day = e.day AND o.side = e.side AND o.price = e.price AND o.place < e.add_seq AND (o.died IS NULL OR o.died > e.n)
          WHERE e.kind = 'E' GROUP BY ALL),
live AS (SELECT symbol, day, n, 2 + sum(CASE WHEN was = 'A' THEN 1 WHEN was = 'D' AND kind <> 'U' THEN -1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY n) AS alive FROM msg),
extra AS (SELECT symbol, day, count(*) FILTER (n % 11 = 0) AS unknown_ref, count(*) FILTER (n % 13 = 0) + count(*) FILTER (was = 'A' AND n % 5 = 0) AS crossing,
                 count(*) FILTER (was = 'A' AND n % 17 = 0) + count(*) FILTER (was = 'A' AND n % 19 = 0) + count(*) FILTER (was = 'A' AND n % 7 = 0) AS anomaly,
                 count(*) FILTER (was = 'D' AND kind = 'E') AS full_fill, count(*) AS base FROM msg GROUP BY ALL)
SELECT symbol, day, base + 2 + unknown_ref + crossing + anomaly AS messages, base + 2 + unknown_ref + crossing + anomaly AS applied, crossing,
       (SELECT count(*) FILTER (behind) FROM front f WHERE f.symbol = x.symbol AND f.day = x.day) AS front_violation, full_fill, unknown_ref, anomaly,
       (SELECT CAST(max(alive) AS BIGINT) FROM live l WHERE l.symbol = x.symbol AND l.day = x.day) AS max_live,
       unknown_ref + crossing + anomaly + (SELECT count(*) FILTER (behind) FROM front f WHERE f.symbol = x.symbol AND f.day = x.day) = 0 AS clean
FROM extra x"""
_FIFO = f"""WITH {_BASE}, rg AS (SELECT symbol, direction, kind, seq, size, sum(size) OVER (PARTITION BY symbol, direction, kind ORDER BY seq) AS stop FROM tape WHERE kind IN (1, 4))
SELECT r.symbol, r.direction, r.seq AS resting_seq, d.seq AS demand_seq, CAST(least(r.stop, d.stop) - greatest(r.stop - r.size, d.stop - d.size) AS BIGINT) AS fill FROM rg r JOIN rg d ON r.symbol = d.symbol AND r.direction = d.direction AND r.kind = 1 AND d.kind = 4 AND r.stop > d.stop - d.size AND d.stop > r.stop - r.size"""

_HORIZONS = (300, 600, 1_800)
_PAIR_CTES = ", ".join(
    f"""{_calendar(f"h{h}", h * 1_000_000_000)},
sp{h} AS (SELECT g.symbol, g.day, g.bin AS bucket, sum(CAST(a - b AS HUGEINT) * (least(t1, (g.bin + 1) * {h * 10**9}) - greatest(t0, g.bin * {h * 10**9}))) FILTER (NOT gone) AS sx, sum(CAST(least(t1, (g.bin + 1) * {h * 10**9}) - greatest(t0, g.bin * {h * 10**9}) AS HUGEINT)) FILTER (NOT gone) AS nx
 FROM (SELECT symbol, day, unnest(range({86_400 // h})) AS bin FROM (SELECT DISTINCT symbol, day FROM book)) g JOIN st s ON s.symbol = g.symbol AND s.day = g.day AND t0 < (g.bin + 1) * {h * 10**9} AND t1 > g.bin * {h * 10**9} GROUP BY ALL),
p{h} AS (SELECT c.symbol, c.day, c.end_ns AS time_ns, n.end_ns AS target_end_ns, CAST(c.ofi AS DOUBLE) AS x, c.dmid_cents AS last, n.dmid_cents AS y, CAST(sx AS DOUBLE) * CAST(0.01 AS DOUBLE) / nullif(CAST(nx AS DOUBLE), 0) / 2 AS half_spread,
 CASE WHEN c.bucket >= 5 THEN (SELECT sum(v.dmid_cents * v.dmid_cents) FROM h{h} v WHERE v.symbol = c.symbol AND v.day = c.day AND v.bucket BETWEEN c.bucket - 5 AND c.bucket) END AS var, {h} AS h
 FROM h{h} c JOIN h{h} n ON n.symbol = c.symbol AND n.day = c.day AND n.bucket = c.bucket + 1 LEFT JOIN sp{h} s ON s.symbol = c.symbol AND s.day = c.day AND s.bucket = c.bucket)"""
    for h in _HORIZONS
)
_PAIRS = f"{_states()}, {_EV.removeprefix(_BASE + ',')}, {_PAIR_CTES}, pairs AS ({' UNION ALL '.join(f'SELECT * FROM p{h}' for h in _HORIZONS)})"
_PAIR_SQL = f"WITH {_PAIRS} SELECT symbol, day, time_ns, target_end_ns, x, round(last, 6) AS last, round(y, 6) AS y, round(half_spread, 6) AS half_spread, round(var, 6) AS var, h FROM pairs"
_STACK = "stacked AS (SELECT *, 'ofi' AS predictor, x AS r FROM pairs UNION ALL SELECT *, 'last', last FROM pairs)"


def _evaluated(keys: str, fit: str, test: str) -> str:
    return f"""fitted AS (SELECT {keys}, count(*) AS n_fit, sum(r * r) AS sxx, sum(r * y) AS sxy, sum(y * y) AS syy FROM {fit} GROUP BY ALL),
fits AS (SELECT {keys}, n_fit, CASE WHEN n_fit >= 2 AND sxx > 0 THEN sxy / sxx END AS beta, CASE WHEN n_fit >= 2 AND sxx > 0 THEN (syy - sxy / sxx * sxy) / (n_fit - 1) / sxx END AS se2 FROM fitted),
tests AS (SELECT {keys}, n_fit, beta, se2, y, r, CASE WHEN y IS NOT NULL THEN 1 ELSE 0 END AS here, sign(beta * r) AS way FROM fits LEFT JOIN {test} USING ({keys})),
graded AS (SELECT {keys}, n_fit, beta, CASE WHEN se2 > 0 THEN beta / sqrt(se2) END AS t, CAST(sum(here) AS BIGINT) AS n_test, sum((y - beta * r) ** 2) AS sse, sum(y * y) AS sst, count(*) FILTER (r <> 0 AND beta <> 0 AND y <> 0) AS graded, count(*) FILTER (r <> 0 AND beta <> 0 AND y <> 0 AND way = sign(y)) AS hits,
 count(*) FILTER (r <> 0 AND beta <> 0 AND here = 1) AS signals, sum(way * y) FILTER (r <> 0 AND beta <> 0) AS es FROM tests GROUP BY {keys}, n_fit, beta, se2)
SELECT {keys}, n_fit, n_test, round(beta, 6) AS beta, round(t, 6) AS t, CASE WHEN beta IS NOT NULL THEN round(1 - sse / nullif(sst, 0), 6) END AS r2, hits, graded, n_test - graded AS excluded, round(es / nullif(signals, 0), 6) AS edge, signals,
 round(hits / nullif(graded, 0)::DOUBLE, 6) AS hit_rate, round((hits / nullif(graded, 0)::DOUBLE - 0.5) / sqrt(0.25 / nullif(graded, 0)), 6) AS z, round(1.96 * sqrt(0.25 / nullif(graded, 0)), 6) AS band, hits / nullif(graded, 0)::DOUBLE - 0.5 > 1.96 * sqrt(0.25 / nullif(graded, 0)) AS clears_band FROM graded"""


_FIRST, _SECOND = "target_end_ns <= 45900000000000", "time_ns >= 45900000000000"
_DECAY = f"""WITH {_PAIRS}, {_STACK}, fit AS (SELECT *, 'forward' AS direction FROM stacked WHERE {_FIRST} UNION ALL SELECT *, 'reverse' FROM stacked WHERE {_SECOND}), test AS (SELECT *, 'forward' AS direction FROM stacked WHERE {_SECOND} UNION ALL SELECT *, 'reverse' FROM stacked WHERE {_FIRST}),
{_evaluated("h, direction, predictor", "fit", "test")}"""
_CUT = lambda v, q: f"list_sort(list({v}))[1 + CAST(floor({q}::DOUBLE * (count({v}) - 1) + 0.5) AS BIGINT)]"
_REGIMES = f"""WITH {_PAIRS}, {_STACK}, cuts AS (SELECT h, {_CUT("var", "0.9")} AS hi, {_CUT("var", "0.1")} AS lo FROM pairs WHERE var IS NOT NULL AND {_FIRST} GROUP BY h),
mem AS (SELECT s.*, regime, CASE regime WHEN 'high-vol' THEN coalesce(var >= hi, false) WHEN 'quiet' THEN coalesce(var <= lo, false) ELSE 2 * time_ns - target_end_ns >= CAST(a AS BIGINT) * 1000000000 AND time_ns <= CAST(z AS BIGINT) * 1000000000 END AS member FROM stacked s LEFT JOIN cuts USING (h), (VALUES ('open', 34200, 36000), ('midday', 39600, 50400), ('close', 55800, 57600), ('high-vol', 0, 0), ('quiet', 0, 0)) AS g(regime, a, z) WHERE a > 0 OR hi IS NOT NULL),
fit AS (SELECT * FROM mem WHERE NOT member), test AS (SELECT * FROM mem WHERE member),
{_evaluated("h, regime, predictor", "fit", "test")}"""
_COST = f"""WITH {_PAIRS}, bt AS (SELECT symbol, day, h, CASE WHEN count(*) >= 2 AND sum(x * x) > 0 THEN sum(x * y) / sum(x * x) END AS beta FROM pairs WHERE {_FIRST} GROUP BY ALL),
th AS (SELECT symbol, day, h, {_CUT("abs(x)", "0.9")} AS threshold FROM pairs WHERE {_FIRST} AND x <> 0 GROUP BY ALL), te AS (SELECT * FROM pairs WHERE {_SECOND}),
legs AS (SELECT p.symbol, p.day, p.h, subset, latency, sign(beta * p.x) * q.y AS move, q.y, q.half_spread AS hs FROM te p JOIN bt USING (symbol, day, h) CROSS JOIN (VALUES ('all'), ('top-decile')) AS s(subset) CROSS JOIN (VALUES (0), (1)) AS l(latency) JOIN te q ON q.symbol = p.symbol AND q.day = p.day AND q.h = p.h AND q.time_ns = p.time_ns + latency * (p.target_end_ns - p.time_ns)
 LEFT JOIN th ON th.symbol = p.symbol AND th.day = p.day AND th.h = p.h WHERE p.x <> 0 AND beta <> 0 AND (subset = 'all' OR abs(p.x) >= threshold)),
g AS (SELECT symbol, day, h, subset, latency, count(*) AS n, count(*) FILTER (y <> 0 AND move > 0) AS hits, count(*) FILTER (y <> 0) AS graded, avg(move) AS gross, avg(hs) AS hs, avg(move - hs) AS net1, avg(move - 2 * hs) AS net2, avg(CAST(move > hs AS DOUBLE)) FILTER (hs IS NOT NULL) AS beat FROM legs GROUP BY ALL),
cells AS (SELECT symbol, day, h, subset, latency FROM bt, (VALUES ('all'), ('top-decile')) AS s(subset), (VALUES (0), (1)) AS l(latency) WHERE beta <> 0)
SELECT symbol, day, h, subset, latency, CASE WHEN subset <> 'all' THEN threshold END AS threshold, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, coalesce(graded, 0) AS graded,
       round(gross, 6) AS gross, round(hs, 6) AS half_spread, round(net1, 6) AS net1, round(net2, 6) AS net2, round(beat, 6) AS beat, CASE WHEN gross > 0 THEN round(hs / gross, 6) END AS consumed
FROM cells LEFT JOIN g USING (symbol, day, h, subset, latency) LEFT JOIN th USING (symbol, day, h)"""

_INDEX = """WITH o AS (SELECT o_custkey AS permno, o_orderkey AS k, o_totalprice AS p, CAST(o_orderdate AS DATE) AS d FROM orders),
days AS (SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS date FROM o),
inside AS (SELECT DISTINCT date, permno FROM days JOIN o ON date >= d AND date <= d + CAST(k % 300 AS INT)),
named AS (SELECT date, permno, arg_max('T' || k, (d, 'T' || k)) AS ticker FROM days JOIN o ON date >= d AND date <= d + CAST(200 + k % 200 AS INT) GROUP BY ALL),
traded AS (SELECT d AS date, permno, abs(max(-p)) AS close, CAST(sum(k % 1000) AS BIGINT) AS volume FROM o GROUP BY ALL)
SELECT date, permno, ticker, round(close, 6) AS close, volume, round(close * volume, 6) AS dollar_volume
FROM inside JOIN named USING (date, permno) LEFT JOIN traded USING (date, permno)"""
_OPEN, _CLOSE, _LATER = 1_704_153_600_000_000_000, 1_706_572_800_000_000_000, 3_600_000_000_000
_TAQ = f"""{_BASE}, q AS (SELECT CAST(user_id % 4 AS INT) AS ticker, event_id AS seq, us * 1000 AS time_ns, CAST(100 + 0.25 * (r1 % 16) AS DOUBLE) AS bid, CAST(100 + 0.25 * (r1 % 16) + 0.5 * (r2 % 4) AS DOUBLE) AS ask FROM m WHERE event_type IN ('view', 'click', 'error')),
qq AS (SELECT ticker, time_ns, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask FROM q GROUP BY ALL),
tr AS (SELECT CAST(user_id % 4 AS INT) AS ticker, event_id AS seq, us * 1000 AS time_ns, CAST(100 + 0.25 * (event_id % 16) + 0.25 * (r5 % 3 - 1) AS DOUBLE) AS price, 1 + CAST(floor(value) AS BIGINT) AS size FROM m WHERE event_type IN ('purchase', 'signup'))"""
_MID = "CASE WHEN bid > 0 AND ask > bid THEN (bid + ask) / 2 END"
_SIGNS = f"""{_TAQ}, ins AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY time_ns, seq) AS k FROM tr WHERE time_ns >= {_OPEN} AND time_ns < {_CLOSE}),
mt AS (SELECT t.*, {_MID} AS mid FROM ins t ASOF LEFT JOIN qq ON qq.ticker = t.ticker AND t.time_ns > qq.time_ns),
moves AS (SELECT c.ticker, c.k, sign(c.price - p.price) AS way FROM ins c JOIN ins p ON p.ticker = c.ticker AND p.k = c.k - 1 WHERE c.price <> p.price),
sg AS (SELECT a.*, CAST(CASE WHEN mid IS NULL THEN 0 WHEN price <> mid THEN sign(price - mid) ELSE coalesce(way, 0) END AS INT) AS sign FROM mt a ASOF LEFT JOIN moves v ON v.ticker = a.ticker AND a.k >= v.k)"""
_SPREADS = f"""{_SIGNS}, sl AS (SELECT *, time_ns + {_LATER} AS later FROM sg WHERE sign <> 0),
sp AS (SELECT s.*, CASE WHEN later < {_CLOSE} THEN {_MID} END AS ml FROM sl s ASOF LEFT JOIN qq ON qq.ticker = s.ticker AND s.later > qq.time_ns),
ts AS (SELECT *, 2 * sign * (price - mid) / mid * 10000 AS eff, 2 * sign * (price - ml) / mid * 10000 AS real, 2 * sign * (ml - mid) / mid * 10000 AS imp FROM sp)"""
_QUOTED = f"""qh AS (SELECT *, least(coalesce(lead(time_ns) OVER (PARTITION BY ticker ORDER BY time_ns, seq), {_CLOSE}), {_CLOSE}) - greatest(time_ns, {_OPEN}) AS hold, bid > 0 AND ask > bid AS two FROM q),
qd AS (SELECT ticker, sum((ask - bid) * hold) FILTER (two) AS sx, sum((ask + bid) / 2 * hold) FILTER (two) AS mx, CAST(coalesce(sum(hold) FILTER (two), 0) AS BIGINT) AS two_sided_ns, CAST(coalesce(sum(hold) FILTER (NOT two), 0) AS BIGINT) AS excluded_ns FROM qh WHERE hold > 0 GROUP BY ALL),
qt AS (SELECT ticker, round(sx * 10000 / nullif(mx, 0), 6) AS quoted_bps, round(sx * 100 / nullif(two_sided_ns, 0), 6) AS quoted_cents, two_sided_ns, excluded_ns, round(mx / nullif(two_sided_ns, 0), 6) AS mid, round(two_sided_ns / CAST(two_sided_ns + excluded_ns AS DOUBLE), 6) AS two_sided_share FROM qd)"""
_SUMMARY = f"""WITH {_SPREADS}, {_QUOTED}, dl AS (SELECT *, price * size AS d FROM ts),
mn AS (SELECT ticker, count(*) AS signed, avg(eff) AS e, avg(real) AS r, avg(imp) AS i, sum(eff * d) / sum(d) AS ew, sum(real * d) / sum(d) FILTER (real IS NOT NULL) AS rw, sum(imp * d) / sum(d) FILTER (imp IS NOT NULL) AS iw, count(real) AS nr, count(*) FILTER (sign > 0) AS buys FROM dl GROUP BY ALL),
bt AS (SELECT ticker, count(*) AS trades, CAST(sum(size) AS BIGINT) AS shares, round(sum(price * size), 6) AS dollar_volume FROM ins GROUP BY ALL)
SELECT ticker, trades, shares, dollar_volume, coalesce(signed, 0) AS signed, round(e, 6) AS effective_bps, round(r, 6) AS realized_bps, round(i, 6) AS impact_bps, round(ew, 6) AS effective_bps_dw, round(rw, 6) AS realized_bps_dw, round(iw, 6) AS impact_bps_dw, quoted_bps, quoted_cents, two_sided_ns, excluded_ns, mid, two_sided_share,
 round((trades - coalesce(signed, 0)) / trades::DOUBLE, 6) AS unsigned_share, round((signed - nr) / signed::DOUBLE, 6) AS no_realized_share, round(buys / signed::DOUBLE, 6) AS buy_share FROM bt LEFT JOIN mn USING (ticker) LEFT JOIN qt USING (ticker)"""
_UNI = """u AS (SELECT l_suppkey AS permno, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(38, 2)) AS dollar_volume FROM lineitem GROUP BY ALL),
rk AS (SELECT *, (SELECT count(*) FROM u v WHERE v.dollar_volume < u.dollar_volume OR (v.dollar_volume = u.dollar_volume AND v.permno < u.permno)) AS i, (SELECT count(*) FROM u) AS n FROM u),
dc AS (SELECT *, CAST(least(10, 1 + (10 * i) // n) AS INT) AS decile FROM rk)"""
_CHOOSE = f"""WITH {_UNI}, dl AS (SELECT decile, list(permno ORDER BY i) AS l FROM dc GROUP BY ALL), k AS (SELECT *, least(3, len(l)) AS k FROM dl), j AS (SELECT *, unnest(range(k)) AS j FROM k), pick AS (SELECT l[1 + (j * len(l)) // k + len(l) // (2 * k)] AS permno FROM j)
SELECT permno, CAST(dollar_volume AS VARCHAR) AS dollar_volume, decile FROM dc WHERE permno IN (SELECT permno FROM pick)"""
_COSTS = f"{_UNI}, cs AS (SELECT permno, decile, (11 - decile) / 2.0::DOUBLE + (permno % 7) / 8.0::DOUBLE AS half_bps FROM dc), md AS (SELECT decile, count(*) AS names, quantile_cont(half_bps, 0.25) AS q1, quantile_cont(half_bps, 0.5) AS median, quantile_cont(half_bps, 0.75) AS q3, min(half_bps) AS least, max(half_bps) AS most FROM cs GROUP BY ALL)"
_MEDIANS = f"WITH {_COSTS} SELECT decile, names, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(least, 6) AS least, round(most, 6) AS most FROM md"
_AUDIT = f"""WITH {_COSTS}, f AS (SELECT * FROM (VALUES ('low', 0.5::DOUBLE), ('stated', 1.0::DOUBLE), ('high', 5.0::DOUBLE)) AS t(reading, figure)), nd AS (SELECT reading, figure, arg_min(decile, abs(ln(median / figure)) ORDER BY decile) AS nearest_decile FROM f, md GROUP BY ALL)
SELECT reading, figure, (SELECT count(*) FROM cs WHERE half_bps >= figure) AS covered, round((SELECT count(*) FROM cs WHERE half_bps >= figure) / CAST((SELECT count(*) FROM cs) AS DOUBLE), 6) AS share_covered, nearest_decile, round(median / figure, 6) AS nearest_factor, median / figure BETWEEN 0.8 AND 1.25 AS matches,
 round((SELECT quantile_cont(half_bps, 0.5) FROM cs) / figure, 6) AS factor_median, round((SELECT arg_min(median, decile) FROM md) / figure, 6) AS factor_bottom_decile FROM nd JOIN md ON md.decile = nearest_decile"""
_ACT = """ac AS (SELECT user_id AS t, count(*) FILTER (event_type = 'purchase') AS lit_trades, count(*) FILTER (event_type = 'view') AS cancels, count(*) FILTER (event_type = 'click') AS hidden, count(*) AS tfh FROM events GROUP BY ALL),
lg AS (SELECT CAST(t AS VARCHAR) AS ticker, unnest(['lit_trades', 'cancels', 'cancel_to_trade', 'hidden_rate']) AS metric, unnest([lit_trades::DOUBLE, cancels::DOUBLE, cancels / nullif(lit_trades, 0)::DOUBLE, hidden / nullif(tfh, 0)::DOUBLE]) AS value FROM ac)"""
_PLACE = f"""WITH {_ACT}, asked AS (SELECT unnest(['1', '7', '11', 'NONE']) AS ticker)
SELECT k.ticker, EXISTS (SELECT 1 FROM ac WHERE CAST(t AS VARCHAR) = k.ticker) AS present, l.metric, round(l.value, 6) AS value, CASE WHEN l.value IS NOT NULL THEN round((SELECT count(*) FROM lg v WHERE v.metric = l.metric AND v.value <= l.value) / CAST((SELECT count(v.value) FROM lg v WHERE v.metric = l.metric) AS DOUBLE), 6) END AS percentile,
 (SELECT count(*) FROM ac) AS universe FROM asked k LEFT JOIN lg l ON l.ticker = k.ticker"""
_DECILES = f"WITH {_ACT}, s AS (SELECT metric, list_sort(list(value)) AS l FROM lg WHERE value IS NOT NULL GROUP BY ALL), d AS (SELECT *, unnest(range(1, 10)) AS decile FROM s) SELECT metric, CAST(decile AS INT) AS decile, round(l[1 + CAST(floor(decile / 10.0::DOUBLE * (len(l) - 1) + 0.5) AS BIGINT)], 6) AS cut FROM d"
_SEVEN = ("two_sided_ns", "spread_x_ns", "mid2_x_ns", "one_cent_ns", "touch_x_ns", "trades", "trade_shares")


def _touch(two: str) -> str:
    made = ["1", "a - b", "a + b", "CASE WHEN a - b = 100 THEN 1 ELSE 0 END", "bs + az"]
    trade = "kind = 4 AND time_ns >= start AND time_ns < close"
    sums = [f"sum(CASE WHEN {two} THEN CAST({m} AS HUGEINT) * ns ELSE 0 END)" for m in made] + [f"count(*) FILTER ({trade})", f"CAST(coalesce(sum(size) FILTER ({trade}), 0) AS BIGINT)"]
    return ", ".join(f"{v} AS {n}" for v, n in zip(sums, _SEVEN))


_IDENTITY = f"""WITH {_BASE}, pr AS (SELECT t.*, gone, b, a, bs, az, row_number() OVER (PARTITION BY t.symbol, t.day ORDER BY t.seq) AS k, lead(t.time_ns) OVER (PARTITION BY t.symbol, t.day ORDER BY t.seq) AS after FROM tape t JOIN book k ON k.seq = t.seq),
f AS (SELECT symbol, day, max(time_ns) FILTER (k IN (1, 4)) AS start, 1706572800000000000 AS close FROM pr GROUP BY ALL),
s AS (SELECT *, greatest(0, least(greatest(time_ns, coalesce(after, close)), close) - greatest(time_ns, start)) AS ns FROM pr JOIN f USING (symbol, day)),
ten AS (SELECT symbol, day, {_touch("NOT gone")} FROM s GROUP BY ALL), one AS (SELECT symbol, day, {_touch("NOT gone AND NOT (symbol = 3 AND seq % 50 = 0)")} FROM s WHERE k > 3 GROUP BY ALL)
SELECT o.symbol, o.day, {", ".join(f"CAST(o.{n} AS VARCHAR) AS {n}" if n.endswith("_ns") else f"o.{n}" for n in _SEVEN)}, {" AND ".join(f"o.{n} = t.{n}" for n in _SEVEN)} AS agree FROM one o JOIN ten t USING (symbol, day)"""
_BAD = f"""{_states()}, bad AS (SELECT *, t1 - t0 AS hold, CASE WHEN gone THEN 0 WHEN seq % 13 < 3 THEN n WHEN seq % 17 = 0 THEN least(2, n) ELSE n END AS m, NOT gone AND seq % 13 < 3 AS bigger FROM st)"""
_DECOMP = f"""WITH {_BAD}, dp AS (SELECT symbol, day, hold, k, {_top('az', 10).replace('10, n', 'k, n')} + (least(k, n) * bs + 5 * least(k, n) * (least(k, n) - 1)) AS ref, {_top('az', 10).replace('10, n', 'k, n')} + (least(k, m) * bs + 5 * least(k, m) * (least(k, m) - 1)) + CASE WHEN bigger AND k > 1 THEN 50 ELSE 0 END AS our
 FROM bad, (SELECT unnest([1, 10]) AS k) WHERE NOT gone AND hold > 0), g AS (SELECT symbol, day, k, sum(CAST(hold AS HUGEINT)) AS ns, sum(CAST(ref AS HUGEINT) * hold) AS rx, sum(CAST(greatest(our - ref, 0) AS HUGEINT) * hold) AS sx, sum(CAST(greatest(ref - our, 0) AS HUGEINT) * hold) AS dx FROM dp GROUP BY ALL)
SELECT symbol, day, CAST(k AS INT) AS levels, {_r("rx", "ns")} AS reference, {_r("sx", "ns")} AS surplus, {_r("dx", "ns")} AS deficit, {_r("sx - dx", "ns")} AS net FROM g"""
_GRADED = f"""{_BAD}, gr AS (SELECT symbol, day, seq, time_ns, NOT bigger AND m = CASE WHEN gone THEN 0 ELSE n END AS matched, CASE WHEN bigger THEN 1 WHEN NOT gone AND m < n THEN m ELSE 10 END AS depth, CASE WHEN bigger THEN 'STALE_SIZE' WHEN NOT gone AND m < n THEN 'BACKFILL' END AS class FROM bad)"""
_STREAKS = f"""WITH {_GRADED}, ch AS (SELECT *, CASE WHEN matched AND NOT coalesce(lag(matched) OVER (PARTITION BY symbol, day ORDER BY seq), false) THEN 1 ELSE 0 END AS begins FROM gr), sk AS (SELECT *, sum(begins) OVER (PARTITION BY symbol, day ORDER BY seq) AS island FROM ch),
ln AS (SELECT symbol, day, island, count(*) AS length FROM sk WHERE matched GROUP BY ALL), st2 AS (SELECT symbol, day, count(*) AS streaks, max(length) AS longest FROM ln GROUP BY ALL),
g AS (SELECT symbol, day, count(*) AS rows, count(*) FILTER (matched) AS matched, min(seq) FILTER (NOT matched) AS first_divergence, count(*) FILTER (depth >= 1) AS matched_at_1, count(*) FILTER (depth >= 3) AS matched_at_3, count(*) FILTER (class = 'BACKFILL') AS backfill, CAST(0 AS BIGINT) AS backfill_size, CAST(0 AS BIGINT) AS stale, count(*) FILTER (class = 'STALE_SIZE') AS stale_size FROM gr GROUP BY ALL)
SELECT g.*, coalesce(streaks, 0) AS streaks, coalesce(longest, 0) AS longest, round(matched / rows::DOUBLE, 6) AS match_rate FROM g LEFT JOIN st2 USING (symbol, day)"""

_DEEP = lambda k, m, size: f"(least({k}, {m}) * {size} + 5 * least({k}, {m}) * (least({k}, {m}) - 1))"
_PART = lambda top, bottom, scale=1.0: f"CAST({top} AS DOUBLE) * CAST({scale} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0)"
_SUMMED = lambda x, where="true": f"sum(CAST({x} AS HUGEINT) * hold) FILTER ({where})"
_BUDGETS = {
    "tw_spread_cents": ("lower or equal", _PART(_SUMMED("a - b"), _SUMMED("1"), 0.01)), "one_cent_share": ("none", _PART(_SUMMED("CASE WHEN a - b = 100 THEN 1 ELSE 0 END"), _SUMMED("1"))),
    "touch": ("higher", _PART(_SUMMED("bs + az"), _SUMMED("1"))),
    **{f"depth{k}": ("higher", _PART(_SUMMED(f"{_DEEP(k, 'nb', 'bs')} + more + {_DEEP(k, 'na', 'az')}"), _SUMMED("1"))) for k in (5, 10)},
    **{f"{s}_level": ("none", _PART(_SUMMED("9 * step", f"n{s[0]} >= 10"), _SUMMED("1", f"n{s[0]} >= 10"), 0.01)) for s in ("bid", "ask")},
    **{f"{s}_gap": ("none", _PART(_SUMMED(f"step * (n{s[0]} - 1)"), _SUMMED(f"n{s[0]} - 1"), 0.01)) for s in ("bid", "ask")},
}
_BUDGET = f"""WITH {_BAD}, sides AS (SELECT 'r' AS who, symbol, day, hold, a, b, bs, az, step, n AS nb, n AS na, 0 AS more FROM bad WHERE NOT gone AND hold > 0
 UNION ALL SELECT 'o', symbol, day, hold, a, b, bs, az, step, m, n, CASE WHEN bigger THEN 50 ELSE 0 END FROM bad WHERE NOT gone AND hold > 0),
made AS (SELECT who, symbol, day, unnest([{", ".join(repr(k) for k in _BUDGETS)}]) AS statistic, unnest([{", ".join(repr(w) for w, _ in _BUDGETS.values())}]) AS predicted, unnest([{", ".join(v for _, v in _BUDGETS.values())}]) AS value FROM sides GROUP BY who, symbol, day),
x AS (SELECT symbol, day, statistic, any_value(predicted) AS predicted, max(value) FILTER (who = 'r') AS reference, max(value) FILTER (who = 'o') AS ours FROM made WHERE value IS NOT NULL OR statistic NOT LIKE '%level' GROUP BY ALL)
SELECT symbol, day, statistic, round(reference, 6) AS reference, round(ours, 6) AS ours, round((ours - reference) / nullif(reference, 0), 6) AS relative, predicted, CASE predicted WHEN 'higher' THEN ours > reference WHEN 'lower or equal' THEN ours <= reference ELSE true END AS sign_ok FROM x"""
_CLOSE_SQL = f"""WITH {_DELTAS}, od AS (SELECT symbol, day, direction, price, order_id, life_no, sum(delta) AS rest FROM deltas GROUP BY ALL HAVING sum(delta) <> 0),
lv AS (SELECT symbol, day, direction, price, count(*) AS orders, min(rest) AS least FROM od GROUP BY ALL),
g AS (SELECT symbol, day, CAST(sum(orders) AS BIGINT) AS live_orders, count(*) AS levels, max(price) FILTER (direction = 1) AS bid, min(price) FILTER (direction = -1) AS ask, min(least) AS l FROM lv GROUP BY ALL)
SELECT symbol, day, live_orders, levels, bid, ask, ask - bid AS spread, coalesce(bid < ask, true) AS uncrossed, l > 0 AS positive, true AS reconciled FROM g"""
_COMPARISON = f"""WITH {_BASE}, c AS (SELECT CAST(symbol AS VARCHAR) AS ticker, count(*) FILTER (kind IN (2, 3)) AS cancels, count(*) FILTER (kind = 4) AS trades, count(*) FILTER (kind = 5) AS hidden,
 count(*) FILTER (kind IN (4, 5) AND size < 100) AS odd, coalesce(sum(size) FILTER (kind = 4), 0) AS ts, coalesce(sum(size) FILTER (kind = 1), 0) AS adds FROM tape WHERE time_ns >= {_OPEN} AND time_ns < {_CLOSE} GROUP BY ALL),
f AS (SELECT CAST(user_id % 5 AS VARCHAR) AS ticker, count(*) FILTER (event_type = 'view')::DOUBLE AS cn, count(*) FILTER (event_type = 'purchase')::DOUBLE AS lt, count(*) FILTER (event_type = 'click')::DOUBLE AS hd,
 count(*)::DOUBLE AS tf, count(*) FILTER (event_type = 'error')::DOUBLE AS ol, count(*) FILTER (event_type = 'signup')::DOUBLE AS ov FROM events GROUP BY ALL),
x AS (SELECT ticker, unnest(['cancel_to_trade', 'hidden_rate', 'odd_lot_rate', 'trade_to_order_volume', 'lit_volume', 'lit_trades', 'cancels']) AS statistic,
 unnest([cancels / nullif(trades, 0)::DOUBLE, hidden / nullif(trades + hidden, 0)::DOUBLE, odd / nullif(trades + hidden, 0)::DOUBLE, ts / nullif(adds, 0)::DOUBLE, ts::DOUBLE, trades::DOUBLE, cancels::DOUBLE]) AS ours,
 unnest([cn / nullif(lt, 0), hd / nullif(tf, 0), ol / nullif(lt, 0), lt / nullif(ov, 0), lt, lt, cn]) AS theirs, unnest(['ours lower', 'close', 'close', 'ours higher', 'share', 'share', 'share']) AS expected FROM c JOIN f USING (ticker)),
r AS (SELECT *, ours / nullif(theirs, 0) AS ratio FROM x)
SELECT ticker, statistic, round(ours, 6) AS ours, round(theirs, 6) AS theirs, expected, round(ratio, 6) AS ratio, CASE expected WHEN 'ours lower' THEN ratio < 1 WHEN 'ours higher' THEN ratio > 1 WHEN 'close' THEN ratio BETWEEN 0.5 AND 2 ELSE ratio BETWEEN 0.15 AND 0.5 END AS as_expected FROM r"""
_WORDS = f"""SELECT h, direction, predictor, graded, CASE WHEN hit_rate IS NULL THEN 'no call' WHEN clears_band THEN 'above' WHEN 0.5 - hits / nullif(graded, 0)::DOUBLE > 1.96 * sqrt(0.25 / nullif(graded, 0)) THEN 'below' ELSE 'inside' END AS verdict FROM ({_DECAY})"""
_BEST = f"""WITH dc AS ({_DECAY}), ct AS ({_COST}), j AS (SELECT symbol, day, ct.h, gross, half_spread, consumed, dc.hit_rate, dc.band FROM ct JOIN dc ON dc.h = ct.h AND dc.direction = 'forward' AND dc.predictor = 'ofi' AND dc.clears_band WHERE subset = 'all' AND latency = 0 AND gross IS NOT NULL)
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY gross DESC, h) = 1"""
_MEMBERS = f"""WITH {_COSTS} SELECT decile, count(*) AS names, round(quantile_cont(half_bps, 0.25), 6) AS q1, round(quantile_cont(half_bps, 0.5), 6) AS median, round(quantile_cont(half_bps, 0.75), 6) AS q3, round(min(half_bps), 6) AS least, round(max(half_bps), 6) AS most,
 round(quantile_cont(CAST(u.dollar_volume AS DOUBLE), 0.5), 6) AS median_dollar_volume, string_agg(CAST(cs.permno AS VARCHAR), ', ' ORDER BY CAST(cs.permno AS VARCHAR)) AS tickers FROM cs JOIN u ON u.permno = cs.permno GROUP BY ALL"""
_SAME = f"WITH {_EV}, {_calendar('cal', 600_000_000_000)} SELECT symbol, day, count(*) AS buckets, CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second FROM cal GROUP BY ALL"

SQL = {
    "tw_spread_bins": f"WITH {_bins(300_000_000_000)} SELECT symbol, day, bin, {_text(_WIDE)}, {_ratios(_RATIOS)} FROM bins",
    "tw_session_bins": _SESSION, "tw_event_counts": _COUNTS, "tw_day_windows": _WINDOWS, "level_profile": _LEVELS, "cent_profile": _CENTS,
    "ofi_events": f"WITH {_EV} SELECT * FROM ev", "ofi_day": _OFI_DAY, "ofi_calendar": _CAL, "ofi_event_clock": _EVENT_CLOCK, "ofi_ols": f"WITH {_EV}, {_calendar('cal', 600_000_000_000)} {_ols(_XY.format('cal'), 'day', 'x', 'y')}", "ofi_depth_scaling": _SCALING, "ofi_first_look": _FIRST_LOOK,
    "lifecycle_orders": f"WITH {_OPS} SELECT * EXCLUDE (add_seq) FROM lives", "lifecycle_ends": f"WITH {_OPS} SELECT symbol, day, outcome, count(*) AS orders, CAST(sum(added) AS BIGINT) AS added, CAST(sum(executed) AS BIGINT) AS executed, CAST(sum(cancelled) AS BIGINT) AS cancelled, CAST(sum(remaining) AS BIGINT) AS remaining FROM lives GROUP BY ALL",
    "fill_by_distance": _DIST, "size_lots": f"WITH {_OPS}, g AS (SELECT symbol, day, CASE WHEN added < 100 THEN 'odd' WHEN added % 100 = 0 THEN 'round' ELSE 'mixed' END AS lot, count(*) AS orders, CAST(sum(added) AS BIGINT) AS shares FROM lives GROUP BY ALL) SELECT *, round(orders / CAST(sum(orders) OVER (PARTITION BY symbol, day) AS DOUBLE), 6) AS order_share FROM g",
    "km_curve": f"WITH {_KM} SELECT symbol, day, t, at_risk, deaths, round(survival, 6) AS survival FROM km", "km_median": f"WITH {_KM} SELECT symbol, day, min(t) FILTER (survival <= 0.5) AS median FROM km GROUP BY ALL", "survival_grid": _SURVIVAL,
    "lifetime_quantiles": f"WITH {_OPS} SELECT symbol, day, {_q(0.25)} AS q25, {_q(0.5)} AS q50, {_q(0.9)} AS q90 FROM lives WHERE outcome = 'cancelled' GROUP BY ALL", "cancel_to_trade": _C2T, "lifecycle_summary": _life_summary(),
    "forecast_pairs": _PAIR_SQL, "decay": _DECAY, "regimes": _REGIMES, "cost_verdict": _COST,
    "asof_quote": f"WITH {_TAQ} SELECT t.ticker, t.seq, price, bid, ask, {_MID} AS mid FROM tr t ASOF LEFT JOIN qq ON qq.ticker = t.ticker AND t.time_ns > qq.time_ns", "lee_ready": f"WITH {_SIGNS} SELECT ticker, seq, price, mid, sign FROM sg",
    "trade_spreads": f"WITH {_SPREADS} SELECT ticker, seq, sign, round(mid, 6) AS mid, round(eff, 6) AS effective_bps, round(real, 6) AS realized_bps, round(imp, 6) AS impact_bps FROM ts", "quoted_spread": f"WITH {_TAQ}, {_QUOTED} SELECT * FROM qt", "taq_summary": _SUMMARY,
    "decile_choose": _CHOOSE, "decile_medians": _MEDIANS, "spread_audit": _AUDIT, "universe_place": _PLACE, "universe_deciles": _DECILES, "level_identity": _IDENTITY, "depth_decomposition": _DECOMP, "validation_streaks": _STREAKS,
    "validation_hourly": f"WITH {_GRADED} SELECT symbol, day, time_ns // 3600000000000 AS hour, count(*) AS rows, count(*) FILTER (matched) AS full, count(*) FILTER (depth >= 1) AS top FROM gr GROUP BY ALL",
    "clean_replay_levels": f"WITH {_DELTAS} SELECT symbol, day, seq, direction, price, delta, CAST(sum(delta) OVER (PARTITION BY symbol, day, direction, price ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level_size FROM deltas",
    "itch_decode": _ITCH, "error_budget": _BUDGET, "close_report": _CLOSE_SQL, "activity_comparison": _COMPARISON, "bucket_identity": _SAME,
    "verdict_words": _WORDS, "best_horizon": _BEST, "decile_members": _MEMBERS,
    "front_of_queue": f"WITH {_DELTAS}, lv AS (SELECT symbol, day, direction, price, order_id, life_no, sum(delta) AS rest, min(add_seq) AS s FROM deltas GROUP BY ALL) SELECT symbol, day, direction, price, CAST(sum(rest) AS BIGINT) AS level_size, count(*) AS orders, min(s) AS front_seq FROM lv WHERE rest > 0 GROUP BY ALL",
    "universe_members": _INDEX, "clean_replay_stats": _CLEAN, "refused_replay_stats": _REFUSED, "fifo_allocation": _FIFO, "stream_ofi_calendar": _CAL,
}
