"""The catalog's queries in SQL, for comparison on small tables."""

from __future__ import annotations

from tidegrid.operators.runs import LABEL_LINE, METRIC_ALIASES, PRIMARY_FILES, SECONDARY_FILES
from tidegrid.params import EVENT_TYPES
from tidegrid.plans.catalog import CLIP, DIGITS, FLAWED, GAPS_MS, PAIR, WIDE_P

ORACLE: dict[str, str] = {}


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {DIGITS.get(name or expr, digits)}) + 0.0 as {name or expr}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names.split())


_SUMS = "volume_base volume_quote taker_buy_base taker_buy_quote"

# ---- common tables ----------------------------------------------------------------------------

TICK = """tick as (select event_type as symbol, event_id, epoch_us(ts) // 1000 as ts_ms, 1000.0 + value as px, value,
  cast(json_extract(props, '$.k') as int) as k from events)"""

MINUTE = f"""{TICK}, m as (select 'sim' as exchange, symbol, '1m' as timeframe, ts_ms // 60000 * 60000 as ts_open_ms, event_id, k, value
  from tick)"""

TF = {"1h": 3_600_000, "5m": 300_000}
PER_DAY = {"1h": 24, "5m": 288}


def bars(*tfs: str) -> str:
    frames = ", ".join(f"('{t}', {TF[t]})" for t in tfs)
    return f"""{TICK}, b as (select 'sim' as exchange, symbol, timeframe, ts_ms // w * w as ts_open_ms,
    arg_min(px, (ts_ms, event_id)) as open, max(px) as high, min(px) as low, arg_max(px, (ts_ms, event_id)) as close,
    sum(value) as volume_base, sum(value * px) as volume_quote, count(*) as trades,
    coalesce(sum(value) filter (k % 2 = 0), 0) as taker_buy_base,
    coalesce(sum(value * px) filter (k % 2 = 0), 0) as taker_buy_quote, avg(px) as mean_px,
    any_value(ts_ms // w * w + w - 1) as ts_close_ms, any_value(w) as w
    from tick, (values {frames}) t(timeframe, w) group by symbol, timeframe, ts_ms // w * w)"""


FUNDING = """f as (select 'sim' as exchange, symbol, ts_ms // 28800000 * 28800000 as ts_settle_ms, (avg(value) - 50) / 20000 as funding_rate,
  cast(28800000 as bigint) as funding_interval_ms from tick group by symbol, ts_ms // 28800000)"""

OI = """oi as (select 'sim' as exchange, symbol, ts_ms // 300000 * 300000 as ts_ms, 1000.0 + avg(k) as oi_base, 1000.0 * avg(px) as oi_value_quote,
  avg(case when k % 2 = 0 then 1.0 else 0.0 end) as long_short_account_ratio,
  avg(case when k % 3 = 0 then 1.0 else 0.0 end) as top_trader_position_ratio,
  avg(case when value > 50 then 1.0 else 0.0 end) as taker_long_short_vol_ratio from tick group by symbol, ts_ms // 300000)"""


def joined(*tfs: str) -> str:
    fresh = lambda c: f"case when b.ts_open_ms - oi.ts_ms <= 3600000 then oi.{c} end as {c}"
    return f"""{bars(*tfs)}, {FUNDING}, {OI}, j as (select b.*, b.close as mark_close, b.mean_px as index_close,
    case when b.ts_open_ms - f.ts_settle_ms <= f.funding_interval_ms then f.funding_rate end as funding_rate_ffill,
    (f.ts_settle_ms + f.funding_interval_ms - b.ts_open_ms) / 60000.0 as funding_minutes_to_next,
    {fresh('oi_base')}, {fresh('oi_value_quote')}, {fresh('long_short_account_ratio')}, {fresh('top_trader_position_ratio')},
    {fresh('taker_long_short_vol_ratio')}
    from b asof left join f on b.symbol = f.symbol and b.ts_open_ms >= f.ts_settle_ms
    asof left join oi on b.symbol = oi.symbol and b.ts_open_ms >= oi.ts_ms)"""


def flags() -> str:
    valid = "funding_minutes_to_next between -1 and 481"
    one = lambda c: f"cast(coalesce({c} and {valid}, false) as bigint)"
    left = "funding_minutes_to_next"
    return f"""{one(f'({left} > 0 and {left} <= 30)')} as pre_funding_30m,
    {one(f'(480 - {left} between 0 and 30 and {left} > 0)')} as post_funding_30m,
    {one(f'abs({left}) <= w / 120000.0')} as funding_settle_bar"""


def feats(tf: str) -> str:
    """Bars with all features.  Recursive means are computed row by row."""
    day = PER_DAY[tf]
    hour = day // 24

    def z(x: str, n: int, need: int) -> str:
        w = f"over (partition by f0.symbol order by ts_open_ms rows between {n - 1} preceding and current row)"
        return f"case when count({x}) {w} >= {need} then ({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0) end"

    def full(stat: str, x: str, n: int) -> str:
        w = f"over (partition by f0.symbol order by ts_open_ms rows between {n - 1} preceding and current row)"
        return f"case when count({x}) {w} >= {n} then {stat} {w} end"

    lag = lambda x, n: f"lag({x}, {n}) over (partition by symbol order by ts_open_ms)"
    return f"""{joined(tf)}, f0 as materialized (select j.*, row_number() over (partition by symbol order by ts_open_ms) - 1 as bar_idx,
    close / {lag('close', 1)} - 1 as ret_1, close / {lag('close', 3)} - 1 as ret_3, close / {lag('close', 12)} - 1 as ret_12,
    close / {lag('close', 72)} - 1 as ret_72, greatest(high - low, abs(high - {lag('close', 1)}), abs(low - {lag('close', 1)})) as tr,
    (high - low) / close as range_pct, (2 * taker_buy_base - volume_base) / nullif(volume_base, 0) as taker_imbalance,
    (mark_close - index_close) / nullif(index_close, 0) * 1e4 as basis_bp, ln(close) as lc, {flags()},
    oi_base / {lag('oi_base', hour)} - 1 as oi_pct_change_1h, oi_base / {lag('oi_base', day)} - 1 as oi_pct_change_24h from j),
  rec as (select symbol, bar_idx, close as e12, close as e48, tr as atr from f0 where bar_idx = 0
    union all select f0.symbol, f0.bar_idx, f0.close * (2.0 / 13) + rec.e12 * (1 - 2.0 / 13), f0.close * (2.0 / 49) + rec.e48 * (1 - 2.0 / 49),
    f0.tr * (1.0 / 14) + rec.atr * (1 - 1.0 / 14) from rec join f0 on f0.symbol = rec.symbol and f0.bar_idx = rec.bar_idx + 1),
  f1 as materialized (select f0.*, case when f0.bar_idx >= 13 then atr end as atr_14,
    case when f0.bar_idx >= 47 then (e12 - e48) / close end as ema_fast_minus_slow_pct,
    {full('stddev_samp(ret_1)', 'ret_1', 24)} as vol_close_to_close_24,
    {full('regr_slope(lc, f0.bar_idx)', 'lc', 24)} as slope_ret_24,
    {z('ret_1', 24, 24)} as vol_zscore_24, {z('taker_buy_quote', 24, 24)} as taker_quote_zscore_24, {z('basis_bp', 24, 24)} as basis_zscore_24,
    {z('funding_rate_ffill', 30 * day, 7 * day)} as funding_rate_zscore_30d, {z('oi_base', 30 * day, 7 * day)} as oi_zscore_30d
    from f0 join rec on f0.symbol = rec.symbol and f0.bar_idx = rec.bar_idx)"""


def _label(value: str, low: str, high: str, names: tuple[str, str, str]) -> str:
    return f"case when {value} is null then 'insufficient_data' when {value} < {low} then '{names[0]}' when {value} > {high} then '{names[2]}' else '{names[1]}' end"


def regs(tf: str) -> str:
    win = 7 * PER_DAY[tf]
    tag = lambda c, t: f"'{t}=' || case when {c} = 'insufficient_data' then 'ID' else {c} end"
    names = {"trend_regime": "T", "vol_regime": "V", "funding_regime": "F", "basis_regime": "B", "crowding_regime": "C", "liquidity_regime": "L"}
    label = " || '|' || ".join(tag(c, t) for c, t in names.items())
    good = " + ".join(f"cast({c} <> 'insufficient_data' as int)" for c in names)
    return f"""{feats(tf)},
  rk as materialized (select a.symbol, a.bar_idx, case when a.vol_close_to_close_24 is not null and count(p.vol_close_to_close_24) >= {max(win // 2, 24)}
      then count(*) filter (p.bar_idx < a.bar_idx and p.vol_close_to_close_24 <= a.vol_close_to_close_24) / greatest(count(*) - 1, 1)::double end as vol_rank
    from f1 a join f1 p on a.symbol = p.symbol and p.bar_idx between a.bar_idx - {win - 1} and a.bar_idx
    group by a.symbol, a.bar_idx, a.vol_close_to_close_24),
  g0 as (select f1.*, vol_rank,
    case when ema_fast_minus_slow_pct is null or slope_ret_24 is null then 'insufficient_data'
      when ema_fast_minus_slow_pct > 0.005 and slope_ret_24 > 0 then 'up_trend'
      when ema_fast_minus_slow_pct < -0.005 and slope_ret_24 < 0 then 'down_trend' else 'chop' end as trend_regime,
    {_label('vol_rank', '0.33', '0.66', ('low', 'mid', 'high'))} as vol_regime,
    case when funding_rate_ffill is null then 'insufficient_data' when funding_rate_ffill = 0 then 'flat'
      when abs(funding_rate_ffill) >= 0.0005 or coalesce(abs(funding_rate_zscore_30d) >= 2, false)
        then case when funding_rate_ffill > 0 then 'pos_extreme' else 'neg_extreme' end
      when abs(funding_rate_ffill) < 0.0001 then 'flat'
      when funding_rate_ffill > 0 then 'pos_normal' else 'neg_normal' end as funding_regime,
    {_label('basis_bp', '-5', '5', ('discount_rich', 'neutral', 'premium_rich'))} as basis_regime,
    case when top_trader_position_ratio is null then 'insufficient_data' else 'balanced' end as crowding_regime,
    {_label('taker_quote_zscore_24', '-1', '1', ('thin', 'normal', 'thick'))} as liquidity_regime
    from f1 join rk on f1.symbol = rk.symbol and f1.bar_idx = rk.bar_idx),
  g as materialized (select *, {label} as composite_label, round(({good}) / 6.0, 3) as confidence from g0)"""


def evs(tf: str) -> str:
    day = PER_DAY[tf]
    w = "over (partition by symbol order by ts_open_ms)"
    strength = {
        "EV_FUND_EXTREME": "coalesce(abs(funding_rate_zscore_30d), abs(funding_rate_ffill) / 0.0005 * 2)",
        "EV_OI_SPIKE_UP": "coalesce(oi_zscore_30d, oi_pct_change_1h / 0.03)",
        "EV_OI_FLUSH": "abs(oi_pct_change_1h) / 0.03",
        "EV_VOL_BREAKOUT": "taker_quote_zscore_24",
        "EV_FUNDING_WINDOW_PRE": "(30 - least(greatest(funding_minutes_to_next, 0), 30)) / 30",
        "EV_PREMIUM_SPIKE": "basis_zscore_24",
        "EV_PREMIUM_COMPRESSION": "abs(basis_zscore_24)",
    }
    cond = {
        "EV_FUND_EXTREME": "abs(funding_rate_zscore_30d) >= 2 or (funding_rate_zscore_30d is null and abs(funding_rate_ffill) >= 0.0005)",
        "EV_OI_SPIKE_UP": "oi_pct_change_1h > 0.03 and (oi_zscore_30d is null or oi_zscore_30d > 1)",
        "EV_OI_FLUSH": "oi_pct_change_1h < -0.03",
        "EV_VOL_BREAKOUT": "range_pct >= lvl and taker_quote_zscore_24 > 2",
        "EV_FUNDING_WINDOW_PRE": "pre_funding_30m = 1",
        "EV_PREMIUM_SPIKE": "basis_zscore_24 >= 2",
        "EV_PREMIUM_COMPRESSION": "basis_zscore_24 <= -2",
    }
    level = f"over (partition by symbol order by ts_open_ms rows between {30 * day - 1} preceding and current row)"
    on = ", ".join(f"coalesce({c}, false) as c_{n}" for n, c in cond.items())
    prev = ", ".join(f"coalesce(lag(c_{n}) {w}, false) as p_{n}" for n in cond)
    parts = " union all ".join(
        f"select symbol, timeframe, ts_open_ms, bar_idx, composite_label, '{n}' as event_type, {strength[n]} as event_strength from q2 where c_{n} and not p_{n}"
        for n in cond
    )
    return f"""{regs(tf)},
  q0 as (select *, case when count(range_pct) {level} >= {max(3 * day, 24)} then quantile_cont(range_pct, 0.99) {level} end as lvl,
    lag(funding_rate_ffill) {w} as prev_rate from g),
  q1 as (select *, {on} from q0), q2 as materialized (select *, {prev} from q1),
  e0 as ({parts} union all select symbol, timeframe, ts_open_ms, bar_idx, composite_label, 'EV_FUND_FLIP', abs(funding_rate_ffill - prev_rate) * 1e4 from q2
    where funding_rate_ffill * prev_rate < 0 and abs(funding_rate_ffill - prev_rate) * 1e4 >= 0.5),
  e as materialized (select substr(sha1(symbol || '|' || timeframe || '|' || event_type || '|' || ts_open_ms), 1, 16) as event_id, ts_open_ms, event_type,
    event_strength, composite_label as context_regime, 'sim' as exchange, symbol, timeframe, bar_idx from e0)"""


def outs(tf: str, prefix: str, src: str = "f0") -> str:
    hs = ", ".join(f"({h})" for h in {"1h": (1, 3, 12, 24, 72), "5m": (1, 3, 12, 72)}[tf])
    return f"""{prefix},
  hz as (select * from (values {hs}) t(h)),
  win as materialized (select e.event_id, h, max(w.high) as hi, min(w.low) as lo, min(w.bar_idx) filter (w.high = mx) - e.bar_idx - 1 as t_hi,
      min(w.bar_idx) filter (w.low = mn) - e.bar_idx - 1 as t_lo, count(*) as used from (
      select e.event_id, e.bar_idx as eb, hz.h, w.bar_idx, w.high, w.low, max(w.high) over (partition by e.event_id, hz.h) as mx,
        min(w.low) over (partition by e.event_id, hz.h) as mn
      from e, hz, {src} w where w.symbol = e.symbol and w.bar_idx between e.bar_idx + 2 and e.bar_idx + 1 + hz.h) w
    join e on e.event_id = w.event_id group by e.event_id, h, e.bar_idx),
  o as materialized (select e.event_id, e.ts_open_ms, e.event_type, 'h+' || hz.h as horizon, (x.close - a.close) / a.close * 100 as forward_return_pct,
    (hi - a.close) / a.close * 100 as mfe_pct, (lo - a.close) / a.close * 100 as mae_pct, t_hi as time_to_mfe_bars, t_lo as time_to_mae_bars,
    coalesce(used, 0) as max_holding_bars_used, 'sim' as exchange, e.symbol, e.timeframe, e.event_strength
    from e cross join hz left join {src} a on a.symbol = e.symbol and a.bar_idx = e.bar_idx + 1
    left join {src} x on x.symbol = e.symbol and x.bar_idx = e.bar_idx + 1 + hz.h
    left join win on win.event_id = e.event_id and win.h = hz.h)"""


LB = """lb as materialized (select *, mean_forward_return / nullif(sd, 0) as sharpe_like, median_mfe / nullif(abs(median_mae), 0) as mfe_mae_ratio,
  mean_forward_return - 0.18 as net_after_fee, greatest(1, cast(substr(horizon, 3) as int)) as hb from (
  select exchange, symbol, timeframe, event_type, horizon, count(forward_return_pct) as count, count(*) - count(forward_return_pct) as count_incomplete,
  avg(forward_return_pct) as mean_forward_return, median(forward_return_pct) as median_forward_return,
  avg(case when forward_return_pct > 0 then 1.0 when forward_return_pct is not null then 0.0 end) as hit_rate_at_zero, median(mfe_pct) as median_mfe,
  median(mae_pct) as median_mae, stddev_samp(forward_return_pct) as sd, avg(event_strength) as mean_event_strength from o group by all))"""

LB_OUT = "event_type, horizon, count, count_incomplete, " + rs(
    "mean_forward_return median_forward_return hit_rate_at_zero median_mfe median_mae mfe_mae_ratio sharpe_like mean_event_strength"
) + ", exchange, symbol, timeframe"

WF = """wf0 as (select *, row_number() over c - 1 as rk, count(*) over (partition by symbol, timeframe, event_type, horizon) as n from o
    where forward_return_pct is not null window c as (partition by symbol, timeframe, event_type, horizon order by ts_open_ms)),
  wf1 as (select *, case when rk >= 2 * n // 3 then 2 when rk >= n // 3 then 1 else 0 end as fold from wf0),
  wf2 as (select exchange, symbol, timeframe, event_type, horizon, count(*) as n_complete, avg(forward_return_pct) as full_mean,
    count(*) filter (fold = 0) as n0, count(*) filter (fold = 1) as n1, count(*) filter (fold = 2) as n2,
    avg(forward_return_pct) filter (fold = 0) as m0, avg(forward_return_pct) filter (fold = 1) as m1, avg(forward_return_pct) filter (fold = 2) as m2
    from wf1 group by all),
  wf3 as (select c.*, coalesce(n_complete, 0) as nc, coalesce(n_complete, 0) >= 80 as ok, full_mean, n0, n1, n2, m0, m1, m2
    from (select distinct exchange, symbol, timeframe, event_type, horizon from o) c left join wf2 using (exchange, symbol, timeframe, event_type, horizon)),
  wf4 as (select *, case when ok then cast(sign(m0 - 0.18) = sign(full_mean - 0.18) as bigint) + cast(sign(m1 - 0.18) = sign(full_mean - 0.18) as bigint)
      + cast(sign(m2 - 0.18) = sign(full_mean - 0.18) as bigint) else 0 end as st,
    case when ok then cast(sign(m0 - 0.1) = sign(full_mean - 0.1) as bigint) + cast(sign(m1 - 0.1) = sign(full_mean - 0.1) as bigint)
      + cast(sign(m2 - 0.1) = sign(full_mean - 0.1) as bigint) else 0 end as sm from wf3),
  wf as materialized (select exchange, symbol, timeframe, event_type, horizon, nc as n_complete, full_mean, full_mean - 0.18 as full_net,
    full_mean - 0.1 as full_net_maker, st as folds_same_sign, sm as folds_same_sign_maker, st = 3 as sign_stable, sm = 3 as sign_stable_maker,
    case when ok then n0 else 0 end as fold1_n, case when ok then n1 else 0 end as fold2_n, case when ok then n2 else 0 end as fold3_n,
    case when ok then m0 - 0.18 end as fold1_net, case when ok then m1 - 0.18 end as fold2_net, case when ok then m2 - 0.18 end as fold3_net,
    case when ok then m0 - 0.1 end as fold1_net_maker, case when ok then m1 - 0.1 end as fold2_net_maker, case when ok then m2 - 0.1 end as fold3_net_maker,
    case when not ok then 'INSUFFICIENT_N' when st = 3 then 'STABLE' else 'UNSTABLE' end as verdict,
    greatest(1, cast(substr(horizon, 3) as int)) as hb from wf4)"""



def _mix(x: str, out: str) -> str:
    """The 32-bit mixing of the draws, step by step, as columns that build on each other."""
    return (
        f"xor({x}, ({x}) >> 16) as {out}1, ({out}1 * {0x7FEB352D}) & 4294967295 as {out}2, xor({out}2, {out}2 >> 15) as {out}3, "
        f"({out}3 * {0x31848BAB}) & 4294967295 as {out}4, xor({out}4, {out}4 >> 14) as {out}"
    )


def _feistel(rows: str, x: str) -> str:
    """Four rounds over a rectangle of ``wd`` times ``ht`` places for ``x`` of ``rows``, a select around a select per step; the result is ``y``."""
    q = f"select *, {x} % wd as q0, {x} // wd as q1 from {rows}"
    for k in range(1, 5):
        q = f"select *, {_mix(f'(q{k} * 4 + {k})', f'g{k}')} from ({q})"
        q = f"select *, {_mix(f'xor(key, g{k})', f'h{k}')} from ({q})"
        q = f"select *, (q{k - 1} + h{k}) % {'wd' if k % 2 else 'ht'} as q{k + 1} from ({q})"
    return f"select strategy_id, n, sim, wd, ht, key, place, wd * q5 + q4 as y from ({q})"


# Every draw of every permutation of every cell that is large enough, looked up among the returns of its series.
_TO_CELL = "exchange, symbol, timeframe, event_type, horizon"
PERM = f"""un as materialized (select a.symbol, 'h+' || h as horizon, row_number() over (partition by a.symbol, h order by a.bar_idx) - 1 as rk,
    cast(floor((x.close / nullif(a.close, 0) - 1) * 100 / 1e-9 + 0.5) as bigint) as v from f0 a, hz, f0 x where x.symbol = a.symbol and x.bar_idx = a.bar_idx + h),
  us as materialized (select symbol, horizon, count(*) as nu from un group by all),
  pc as materialized (select {_TO_CELL}, n_complete as n, nu, full_mean, cast('0x' || substr(md5(concat_ws('|', 17, {_TO_CELL})), 1, 8) as bigint) as ck
    from wf join us using (symbol, horizon) where n_complete >= 80 and nu >= n_complete and full_mean is not null),
  w32 as materialized (select i, m from (select i, {_mix('i', 'm')} from (select range as i from range((select greatest(1000, coalesce(max(n), 0)) from pc))))),
  ps as (select pc.*, w32.i as perm, {_mix('xor(ck, m)', 's')} from pc, w32 where w32.i < 1000),
  pd as (select ps.* exclude (ck), {_mix('xor(s, m)', 'd')}, (d * nu) >> 32 as rk from ps join w32 on w32.i < ps.n),
  pt as (select {_TO_CELL}, perm, any_value(n) as n, any_value(full_mean) as full_mean, sum(v) as total from pd join un using (symbol, horizon, rk) group by {_TO_CELL}, perm),
  pv as materialized (select {_TO_CELL}, (count(*) filter (abs(cast(total as double) * 1e-9 / n) >= abs(full_mean)) + 1) / 1001.0::double as p_value from pt group by {_TO_CELL}),
  wp as materialized (select wf.*, p_value from wf left join pv using ({_TO_CELL}))"""

CAND = """cand as materialized (select w.exchange, symbol, timeframe, event_type, horizon, n_complete, p_value, tier, direction, net from (
    select *, 'T' as tier, 'long' as direction, full_mean - 0.18 as net, sign_stable as st, 0.05 as pm from wp union all
    select *, 'T', 'fade', -full_mean - 0.18, sign_stable, 0.05 from wp union all
    select *, 'M', 'long', full_mean - 0.1, sign_stable_maker, 0.1 from wp union all
    select *, 'M', 'fade', -full_mean - 0.1, sign_stable_maker, 0.1 from wp) w where n_complete >= 80 and st and p_value <= pm and net > 0)"""

E1H = evs("1h")
O1H = outs("1h", E1H)


def add(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = f"with recursive {ctes} {select}"


# ---- scans ------------------------------------------------------------------------------------------

add("bars", bars("1h", "5m"), "select exchange, symbol, timeframe, ts_open_ms, ts_close_ms, trades, "
    + rs("open high low close") + ", " + rs(_SUMS, 4) + " from b")
add("funding_settlements", f"{TICK}, {FUNDING}", f"select exchange, symbol, ts_settle_ms, {r('funding_rate', digits=12)}, funding_interval_ms from f")
add("open_interest_metrics", f"{TICK}, {OI}", "select exchange, symbol, ts_ms, "
    + rs("oi_base oi_value_quote long_short_account_ratio top_trader_position_ratio taker_long_short_vol_ratio", 8) + " from oi")
add("mark_index_closes", bars("1h"), f"select exchange, symbol, timeframe, ts_open_ms, {r('close', 'mark_close')}, {r('mean_px', 'index_close')} from b")
add("series_inventory", f"{bars('1h', '5m')}, {OI}", """select 'bars' as kind, exchange, symbol, timeframe, count(*) as rows, min(ts_open_ms) as first_ts_ms,
  max(ts_open_ms) as last_ts_ms from b group by all union all select 'oi', exchange, symbol, '5m', count(*), min(ts_ms), max(ts_ms) from oi group by all""")
add("funding_csv_rows", f"{TICK}, {FUNDING}", f"""select strftime(make_timestamp(ts_settle_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp_utc, symbol,
  {r('funding_rate', digits=12)} from f""")
add("funding_csv_file", f"{TICK}, {FUNDING}", f"""select strftime(make_timestamp(ts_settle_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp_utc, symbol,
  {r('funding_rate', digits=12)} from f""")
_LEAF = [
    ("no", "cast(l_linenumber as varchar)"), ("cell.part", "cast(l_partkey as varchar)"), ("cell.flag", "case when l_partkey % 3 > 0 then l_returnflag else 'None' end"),
    ("cell.even", "case when l_suppkey % 2 = 0 then 'True' else 'False' end"), ("pairs[0][0]", "cast(l_partkey as varchar)"),
    ("pairs[0][1]", "cast(l_suppkey as varchar)"), ("pairs[1][0]", "cast(l_suppkey as varchar)"),
]
_EACH = ", ".join(f"({i}, '{p}', {v})" for i, (p, v) in enumerate(_LEAF))
add("nested_json_leaves", """o as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, case when l_partkey % 3 > 0 then l_returnflag end, l_suppkey % 2 = 0, l_suppkey) - 1 as i, count(*) over (partition by l_orderkey) as c
  from lineitem where l_orderkey % 50 <> 0)""", f"""select l_orderkey, 'order.lines[' || i || '].' || u.p as path, u.v as value, cast(1 + {len(_LEAF)} * i + u.k as bigint) as pos
  from o, lateral (values {_EACH}) u(k, p, v) union all select distinct l_orderkey, 'order.key', cast(l_orderkey as varchar), cast(0 as bigint) from o
  union all select distinct l_orderkey, 'last.name', 'x', cast(1 + {len(_LEAF)} * c as bigint) from o""")
add("json_leaves", "x as (select 1)", "select event_id, 'k' as path, json_extract_string(props, '$.k') as value from events")
add("label_lines", f"""l as (select doc_id, u.line, u.pos - 1 as pos from (select doc_id, string_split(regexp_replace(replace(text, '. ', ': '), '\\r\\n|\\r', chr(10), 'g'), chr(10)) as a
  from documents) d, unnest(d.a) with ordinality as u(line, pos)), t as (select doc_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line from l)""",
  f"""select doc_id, lower(trim(regexp_extract(line, '{LABEL_LINE}', 1))) as path, trim(regexp_extract(line, '{LABEL_LINE}', 2)) as value, pos
  from t where regexp_matches(line, '{LABEL_LINE}')""")

# ---- raw archives ------------------------------------------------------------------------------------

add("archive_klines", bars("1h"), "select exchange, symbol, timeframe, ts_open_ms, ts_close_ms, trades, " + rs(_SUMS, 4) + ", " + rs("open high low close") + " from b")
add("archive_funding", f"{TICK}, {FUNDING}", f"select exchange, symbol, ts_settle_ms, {r('funding_rate', digits=12)}, funding_interval_ms from f")
add("archive_metrics", f"{TICK}, {OI}", f"""select exchange, symbol, ts_ms, {r('case when fmod(oi_base, 5) <> 0 then oi_base end', 'oi_base', 8)},
  {rs('oi_value_quote long_short_account_ratio top_trader_position_ratio taker_long_short_vol_ratio', 8)}, 1.5::double as top_trader_account_ratio from oi""")
add("archive_mark_klines", bars("1h"), f"select exchange, symbol, timeframe, ts_open_ms, ts_close_ms, {r('close', 'mark_close')} from b")
_ISO = lambda x: f"strftime(make_timestamp(({x}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
add("normalized_archive", bars("1h"), f"""select {_ISO('ts_open_ms')} as timestamp_open_utc, {_ISO('ts_close_ms')} as timestamp_close_utc, symbol, {rs('open high low close')},
  {rs(_SUMS, 4)}, trades as trade_count, 'now' as ingested_at_utc from b""")
add("normalized_payloads", bars("1h"), f"""select {_ISO('ts_open_ms')} as timestamp_open_utc, {_ISO('ts_close_ms')} as timestamp_close_utc, symbol, {rs('open high low close')},
  cast(ts_open_ms // 86400000 as varchar) as source, 'now' as ingested_at_utc from b where trades <= 4""")
add("quarantined_payload_rows", bars("1h"), """select symbol, cast(ts_open_ms // 86400000 as varchar) as source, count(*) as rows from b where trades > 4
  group by symbol, ts_open_ms // 86400000""")
add("tier1_audit", f"""{MINUTE}, g as (select *, lag(ts_open_ms) over (partition by symbol order by event_id) as prev from m where k not in (4, 5)),
  d as (select symbol, count(*) - count(distinct ts_open_ms) as n, count(*) filter (ts_open_ms <= prev) as o from g group by symbol)""", """select 'mark_price_klines' as dataset_id, * from (
  select symbol, 'PIT_SYMBOL' as check_id, 'SYMBOL_MISMATCH' as error_type, count(*) as errors from m where k = 2 group by symbol union all
  select symbol, 'PIT_COMPLETED_1M_BAR', 'CLOSE_TIME_FAIL', count(*) from m where k = 3 group by symbol union all
  select symbol, 'PIT_SOURCE_TIMESTAMP', 'TIMESTAMP_PARSE_FAIL', count(*) from m where k in (4, 5) group by symbol union all
  select symbol, 'PIT_SCHEMA_BAR', 'SCHEMA_FAIL', 1 from m group by symbol union all
  select symbol, 'PIT_DUPLICATE', 'DUPLICATE_TIMESTAMP', n from d where n > 0 union all
  select symbol, 'PIT_MONOTONIC', 'NON_MONOTONIC', o from d where o > 0)""")
add("schema_check", "x as (select 1)", """select false as schema_ok, 'timestamp_utc,symbol_name,funding_rate,mark_price_at_funding,source,ingested_at_utc' as observed_schema_fields, true as found""")
add("custom_feed", TICK, f"""select symbol as feed, count(*) as rows, {r('sum(value / 1000)', 'rate')}, {r('sum(case when k % 2 = 0 then k else 0 end)', 'mark')} from tick
  where k > 1 group by symbol union all select 'bad:column_count', count(*), null, null from tick where k = 0 having count(*) > 0
  union all select 'bad:parse_error', count(*), null, null from tick where k = 1 having count(*) > 0""")
add("checksummed_files", f"{bars('1h')}, c as (select symbol, string_agg(ts_open_ms || ',' || trades || chr(10), '' order by ts_open_ms) as t from b group by symbol)",
    "select symbol, cast(length(t) as bigint) as bytes, sha256(t) as sha256 from c")
add("stored_series", bars("1h"), f"""select exchange, symbol, timeframe, ts_open_ms, {r(f"case when symbol = '{PAIR[0]}' then close * 2 else close end", 'close')} from b
  where ts_open_ms between {CLIP[0]} and {CLIP[1]}""")

# ---- dedup, projections ----------------------------------------------------------------------------------

add("dedupe_first", MINUTE, f"""select exchange, symbol, timeframe, ts_open_ms, event_id, cast(k as bigint) as k, {r('value')} from m
  qualify row_number() over (partition by symbol, ts_open_ms order by event_id) = 1""")
add("bar_expressions", joined("1h"), f"""select exchange, symbol, timeframe, ts_open_ms, {r('(high - low) / close', 'range_pct')},
  {r('(2 * taker_buy_base - volume_base) / nullif(volume_base, 0)', 'taker_imbalance')}, {r('(mark_close - index_close) / index_close * 1e4', 'basis_bp')} from j""")
add("funding_window_flags", joined("5m", "1h"),
    f"select exchange, symbol, timeframe, ts_open_ms, {r('funding_minutes_to_next')}, {flags()} from j")
_MONTH = "epoch_ms(date_trunc('month', make_timestamp(ts_open_ms * 1000)))"
_NEXT = "epoch_ms(date_trunc('month', make_timestamp(ts_open_ms * 1000)) + interval 1 month)"
add("window_clip", MINUTE, f"""select symbol, {_MONTH} as month_ms, count(*) as rows, any_value(greatest({_MONTH}, {CLIP[0]})) as first_ms,
  any_value(least({_NEXT}, {CLIP[1]}) - 1) as last_ms, any_value(strftime(make_timestamp({_MONTH} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')) as month_utc
  from m where ts_open_ms between {CLIP[0]} and {CLIP[1]} group by symbol, {_MONTH}""")
_PRICE = "l_extendedprice / nullif(l_quantity, 0)"
add("trade_fees", "x as (select 1)", f"""select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, {r(f'0.0004 * abs(l_quantity) * ({_PRICE})', 'taker_fee', 12)},
  {r(f'0.0002 * abs(l_quantity) * ({_PRICE})', 'maker_fee', 12)}, {r(f'0.0005 * ({_PRICE})', 'slippage', 12)} from lineitem""")
add("scalar_functions", TICK, """select event_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as iso, ts_ms as back_ms,
  cast(case when k % 5 = 0 then 1 else greatest(1, k) end as bigint) as horizon_bars, upper(symbol) as short_name,
  substr(sha1(symbol || '|1h|EV_' || upper(symbol) || '|' || ts_ms), 1, 16) as hash_id from tick""")

# ---- joins --------------------------------------------------------------------------------------------------

add("asof_funding", f"{bars('1h', '5m')}, {FUNDING}, f3 as (select * from f where (ts_settle_ms // 28800000) % 3 <> 0)", f"""select b.exchange, b.symbol,
  b.timeframe, b.ts_open_ms, {r('case when b.ts_open_ms - ts_settle_ms <= funding_interval_ms then funding_rate end', 'funding_rate_ffill', 12)},
  {r('(ts_settle_ms + funding_interval_ms - b.ts_open_ms) / 60000.0', 'funding_minutes_to_next', 12)}
  from b asof left join f3 on b.symbol = f3.symbol and b.ts_open_ms >= f3.ts_settle_ms""")


def _fresh(c: str, ttl: int) -> str:
    return r(f"case when b.ts_open_ms - oi.ts_ms <= {ttl} then oi.{c} end", c)


_ASOF_OI = "from b asof left join oi on b.symbol = oi.symbol and b.ts_open_ms >= oi.ts_ms"
add("asof_open_interest", f"{bars('1h', '5m')}, {OI}",
    f"select b.exchange, b.symbol, b.timeframe, b.ts_open_ms, {_fresh('oi_base', 900000)}, {_fresh('oi_value_quote', 900000)} {_ASOF_OI}")
add("asof_crowding", f"{bars('1h')}, {OI}", f"""select b.exchange, b.symbol, b.timeframe, b.ts_open_ms, {_fresh('long_short_account_ratio', 3600000)},
  {_fresh('top_trader_position_ratio', 3600000)}, {_fresh('taker_long_short_vol_ratio', 3600000)} {_ASOF_OI}""")
add("bars_joined", joined("1h"), "select exchange, symbol, timeframe, ts_open_ms, ts_close_ms, trades, "
    + rs(_SUMS, 4) + ", " + rs("open high low close mark_close index_close funding_rate_ffill funding_minutes_to_next "
         "oi_base oi_value_quote long_short_account_ratio top_trader_position_ratio taker_long_short_vol_ratio", 8) + " from j")
add("known_gap_mask", bars("1h"), """select exchange, symbol, timeframe, ts_open_ms, exists (select 1 from tick t where t.k = 7 and t.symbol = b.symbol
  and t.ts_ms >= b.ts_open_ms and t.ts_ms < b.ts_open_ms + 3600000) as known_gap from b""")

# ---- features to outcomes ----------------------------------------------------------------------------------------

_FEATURES = ("close ret_1 ret_3 ret_12 ret_72 vol_close_to_close_24 atr_14 range_pct ema_fast_minus_slow_pct slope_ret_24 vol_zscore_24 taker_imbalance "
             "taker_quote_zscore_24 funding_rate_ffill funding_rate_zscore_30d funding_minutes_to_next basis_bp basis_zscore_24 oi_base oi_pct_change_1h "
             "oi_pct_change_24h oi_zscore_30d long_short_account_ratio top_trader_position_ratio taker_long_short_vol_ratio")
_FLAGS = "pre_funding_30m post_funding_30m funding_settle_bar"
_FEATURES_OUT = f"ts_open_ms, ts_close_ms, exchange, symbol, timeframe, {rs(_FEATURES)}, {_FLAGS.replace(' ', ', ')}, bar_idx from f1"
add("features", feats("1h"), f"select {_FEATURES_OUT}")
add("feature_counts", feats("1h"), "select exchange, symbol, timeframe, "
    + ", ".join(f"count({c}) as {c}" for c in f"{_FEATURES} {_FLAGS}".split()) + " from f1 group by all")
_REGIMES = "trend_regime, vol_regime, funding_regime, basis_regime, crowding_regime, liquidity_regime, composite_label"
_REGIME_OUT = f"select ts_open_ms, ts_close_ms, exchange, symbol, timeframe, {_REGIMES}, {r('confidence')} from g"
add("regime_labels", regs("1h"), _REGIME_OUT)
add("latest_regime", regs("1h"), f"""select exchange, symbol, timeframe, ts_open_ms, composite_label, {r('confidence')} from g
  qualify row_number() over (partition by symbol order by ts_open_ms desc) = 1""")
_EVENT_OUT = f"select event_id, ts_open_ms, event_type, {r('event_strength', digits=8)}, context_regime, exchange, symbol, timeframe from e"
add("detected_events", E1H, _EVENT_OUT)
# One long series of five-minute bars, in which frames of a month fill up.
DENSE = """tick as (select 'all' as symbol, l_partkey * 1000000 + l_suppkey as event_id, 1704067200000 + l_orderkey * 300000 + l_linenumber * 1000 as ts_ms,
  999.0 + 2.0 * l_quantity as px, 2.0 * l_quantity - 1.0 as value, cast(l_partkey % 100 as int) as k from lineitem)"""
add("event_counts", E1H, "select exchange, symbol, timeframe, " + ", ".join(f"count(*) filter (event_type = '{t}') as {t}" for t in EVENT_TYPES)
    + " from e group by all")
_OUTCOME_OUT = f"""select event_id, ts_open_ms, event_type, horizon, {rs('forward_return_pct mfe_pct mae_pct')}, time_to_mfe_bars, time_to_mae_bars,
  max_holding_bars_used, exchange, symbol, timeframe from o"""
add("event_outcomes", O1H, _OUTCOME_OUT)
add("event_leaderboard", f"{O1H}, {LB}", f"select {LB_OUT} from lb")
_O5M = outs("5m", evs("5m")).replace(TICK, DENSE)
add("features_5m", feats("5m").replace(TICK, DENSE), f"select {_FEATURES_OUT}")
add("regime_labels_5m", regs("5m").replace(TICK, DENSE), _REGIME_OUT)
add("detected_events_5m", evs("5m").replace(TICK, DENSE), _EVENT_OUT)
add("event_outcomes_5m", _O5M, _OUTCOME_OUT)
add("event_leaderboard_5m", f"{_O5M}, {LB}", f"select {LB_OUT} from lb")
_W = "over (partition by symbol order by ts_open_ms)"
_W24 = "over (partition by symbol order by ts_open_ms rows between 23 preceding and current row)"
_SHOCK = f"""{bars('1h')}, s0 as (select *, row_number() {_W} - 1 as bar_idx, close / lag(close) {_W} - 1 as ret from b),
  s1 as (select *, case when count(ret) {_W24} >= 24 then (ret - avg(ret) {_W24}) / nullif(stddev_samp(ret) {_W24}, 0) end as z from s0),
  s2 as materialized (select *, coalesce(abs(z) >= 2, false) as c from s1), s3 as (select *, lag(c) {_W} as p from s2),
  e as materialized (select symbol || ts_open_ms as event_id, 'EV_RETURN_SHOCK' as event_type, abs(z) as event_strength, symbol, timeframe, ts_open_ms, bar_idx
    from s3 where c and not coalesce(p, false))"""
add("shock_leaderboard", f"{outs('1h', _SHOCK, 's2')}, {LB}", f"select {LB_OUT} from lb")
add("forward_returns", f"{bars('1h')}, hz as (select * from (values (1), (3), (12), (24), (72)) t(h)), s as (select *, row_number() {_W} as i from b)",
    f"""select a.exchange, a.symbol, a.timeframe, a.ts_open_ms, 'h+' || h as horizon, {r('(x.close / a.close - 1) * 100', 'forward_return_pct')}
  from s a, hz, s x where x.symbol = a.symbol and x.i = a.i + h""")

# ---- stability and selection ------------------------------------------------------------------------------------------

add("walk_forward", f"{O1H}, {WF}", """select exchange, symbol, timeframe, event_type, horizon, n_complete, folds_same_sign, folds_same_sign_maker, sign_stable,
  sign_stable_maker, fold1_n, fold2_n, fold3_n, verdict, """ + rs("full_mean full_net full_net_maker fold1_net fold2_net fold3_net fold1_net_maker fold2_net_maker fold3_net_maker") + " from wf")
_PERM_OUT = f"""{_TO_CELL}, n_complete, cast(1000 as bigint) as n_perms, coalesce(nu, 0) as n_universe, {r('full_mean', 'obs_mean')}, {r('full_net', 'obs_net')},
  {r('full_net_maker', 'obs_net_maker')}, {r('p_value')}"""
_PERM_VERDICT = "case when p_value is null then 'INSUFFICIENT_N' when p_value <= 0.05 then 'PASS' else 'FAIL' end as verdict"
add("permutation_test", f"{O1H}, {WF}, {PERM}", f"select {_PERM_OUT}, {_PERM_VERDICT} from wp left join us using (symbol, horizon)")
add("permutation_setup", f"{O1H}, {WF}, {PERM}", f"""select {_TO_CELL}, n_complete, cast(1000 as bigint) as n_perms, coalesce(nu, 0) as n_universe,
  {r('full_mean', 'obs_mean')}, {r('full_net', 'obs_net')}, {r('full_net_maker', 'obs_net_maker')}, n_complete < 80 or coalesce(nu, 0) < n_complete as insufficient,
  cast(round(p_value * 1001) as bigint) - 1 as n_extreme from wp left join us using (symbol, horizon)""")
add("verdict_counts", f"{O1H}, {WF}, {PERM}", """select exchange, symbol, timeframe, count(*) filter (verdict = 'STABLE') as stable, count(*) as walk_forward_cells,
  count(*) filter (p_value <= 0.05) as passed, count(*) as permutation_cells from wp group by all""")
add("research_candidates", f"{O1H}, {WF}, {PERM}, {CAND}", f"""select exchange, symbol, timeframe, event_type, horizon, n_complete, {r('p_value')}, tier, direction, {r('net')},
  row_number() over (partition by tier, direction order by net desc, n_complete desc, symbol, timeframe, event_type, horizon) as rank from cand""")


def _sides(picks: dict[str, str], digits: int = 6, ints: tuple[str, ...] = ()) -> str:
    out = []
    for tag, s in zip("ab", PAIR, strict=True):
        for name, src in picks.items():
            expr = f"max({src}) filter (symbol = '{s}')"
            out.append(f"{expr} as {tag}_{name}" if name in ints else r(expr, f"{tag}_{name}", digits))
    return ", ".join(out)


_PAIRED = "symbol in ('%s', '%s')" % PAIR
add("cross_symbol_candidates", f"{O1H}, {WF}, {PERM}, {CAND.replace(', 0.05 as pm', f', {WIDE_P} as pm').replace(', 0.05 from', f', {WIDE_P} from').replace(', 0.1 from', f', {WIDE_P} from')}", f"""select exchange, tier, direction, event_type, timeframe, horizon,
  {_sides({'n': 'n_complete', 'net': 'net', 'p': 'p_value'}, ints=('n',))} from cand where {_PAIRED} group by all having count(distinct symbol) = 2""")
_CLEAR = lambda t: f"coalesce({t}_count >= 80 and {t}_net > 0 and {t}_hit > 0.55 and {t}_ratio >= 1, false)"
_PICKS = {"count": "count", "mean": "mean_forward_return", "hit": "hit_rate_at_zero", "ratio": "mfe_mae_ratio", "net": "net_after_fee"}
_PARETO = f"""{O1H}, {LB}, p0 as (select exchange, event_type, timeframe, horizon, {', '.join(f"max({src}) filter (symbol = '{s}') as {t}_{n}"
  for t, s in zip('ab', PAIR, strict=True) for n, src in _PICKS.items())} from lb where {_PAIRED} group by exchange, event_type, timeframe, horizon
  having count(distinct symbol) = 2), p1 as (select *, (a_net + b_net) / 2 as avg_net, least(a_net, b_net) as min_net, {_CLEAR('a')} as ca, {_CLEAR('b')} as cb from p0)"""
add("pareto_pairs", _PARETO, f"""select exchange, event_type, timeframe, horizon, a_count, b_count,
  {rs('a_mean a_hit a_ratio a_net b_mean b_hit b_ratio b_net avg_net min_net')}, ca and cb as both_pass, ca <> cb as one_symbol_only from p1""")
add("pareto_decision", _PARETO, """select count(*) as pairs, case when bool_or(ca and cb) then 'RESEARCH CANDIDATE' when bool_or(ca <> cb) or
  coalesce(arg_max(a_net, (coalesce(avg_net, -1e300), coalesce(min_net, -1e300))) > 0 or arg_max(b_net, (coalesce(avg_net, -1e300), coalesce(min_net, -1e300))) > 0, false)
  then 'WATCHLIST ONLY' else 'NO CANDIDATE' end as decision from p1""")
add("top_cells_by_net", f"{O1H}, {LB}", f"""select {LB_OUT}, {r('net_after_fee')} from (select * from lb where count >= 80
  order by abs(net_after_fee) desc, symbol, timeframe, hb, event_type limit 30)""")
add("top_cells_by_sharpe", f"{O1H}, {LB}", f"""select {LB_OUT}, {r('net_after_fee')} from (select * from lb where count >= 30 and sharpe_like is not null
  order by abs(sharpe_like) desc, symbol, timeframe, hb, event_type limit 12)""")
add("top_cells_by_maker_net", f"{O1H}, {WF}", f"""select exchange, symbol, timeframe, event_type, horizon, n_complete, {rs('full_net full_net_maker')}, verdict from
  (select * from wf where n_complete >= 80 order by full_net_maker desc nulls last, n_complete desc, symbol, timeframe, hb, event_type limit 20)""")
add("top_cells_by_p_value", f"{O1H}, {WF}, {PERM}", f"""select exchange, symbol, timeframe, event_type, horizon, n_complete, {r('p_value')},
  case when p_value <= 0.05 then 'PASS' else 'FAIL' end as verdict from
  (select * from wp where n_complete >= 80 order by p_value nulls last, n_complete desc, symbol, timeframe, hb, event_type limit 20)""")

# ---- quality and audits -----------------------------------------------------------------------------------------------------

add("series_quality", f"""{MINUTE}, a as (select symbol, ts_open_ms, row_number() over (partition by symbol order by event_id) as i from m),
  s as (select symbol, ts_open_ms, row_number() over (partition by symbol order by ts_open_ms) as i from m),
  x as (select a.symbol, count(*) filter (a.ts_open_ms <> s.ts_open_ms) as ooo from a join s using (symbol, i) group by a.symbol),
  c as (select exchange, symbol, timeframe, count(*) as received_bars, count(distinct ts_open_ms) as deduped_bars, min(ts_open_ms) as first_ts_ms,
    max(ts_open_ms) as last_ts_ms, cast(1440 * 30 as bigint) as expected_bars from m group by all)""",
    """select c.*, ooo as out_of_order_rows, greatest(expected_bars - deduped_bars, 0) as missing_bars, received_bars - deduped_bars as duplicate_bars,
  case when deduped_bars / expected_bars >= 0.99 and received_bars = deduped_bars and ooo = 0 then 'green' when deduped_bars / expected_bars >= 0.95 then 'yellow'
  else 'red' end as status from c join x using (symbol)""")
add("funding_quality", f"{TICK}, {FUNDING}", """select exchange, symbol, count(*) as funding_rows_received, cast(90 as bigint) as funding_rows_expected_in_window,
  min(ts_settle_ms) as first_settle_ms, max(ts_settle_ms) as last_settle_ms from f group by all""")
add("open_interest_quality", f"{TICK}, {OI}, d as (select *, ts_ms - lag(ts_ms) over (partition by symbol order by ts_ms) as gap from oi)",
    f"""select exchange, symbol, count(*) as oi_rows_received, {r('max(gap) / 60000.0', 'oi_gap_max_minutes')}, min(ts_ms) as oi_first_ts_ms,
  max(ts_ms) as oi_last_ts_ms from d group by exchange, symbol""")
add("gap_statistics", f"""{MINUTE}, d as (select distinct exchange, symbol, ts_open_ms from m), g as (select *, ts_open_ms - lag(ts_open_ms) over
  (partition by symbol order by ts_open_ms) as gap from d), c as (select symbol, count(*) as n from m group by symbol)""",
    """select exchange, symbol, (max(ts_open_ms) - min(ts_open_ms)) // 60000 + 1 as expected, cast(coalesce(sum(gap // 60000 - 1) filter (gap > 60000), 0) as bigint) as missing,
  any_value(n) - count(*) as duplicates from g join c using (symbol) group by exchange, symbol""")
_FILES = f"""{MINUTE}, fl as (select *, 'um_klines_1m' as dataset_id, symbol || '/' || (ts_open_ms // 86400000 * 86400000) as local_path from m),
  fo as (select *, ts_open_ms <= lag(ts_open_ms) over (partition by local_path order by event_id) as bad from fl),
  fi as (select dataset_id, symbol, local_path, count(*) as row_count, min(ts_open_ms) as start_ms, max(ts_open_ms) as end_ms,
    not coalesce(bool_or(bad), false) as timestamp_monotonic, (max(ts_open_ms) - min(ts_open_ms)) // 60000 + 1 as expected_rows,
    count(distinct ts_open_ms) as dn from fo group by all),
  fs as (select * exclude (dn), greatest(expected_rows - dn, 0) as missing_rows, row_count - dn as duplicate_rows, case when row_count = dn
    and timestamp_monotonic and expected_rows = dn then 'OK' else 'INTEGRITY_FAIL' end as status from fi)"""
add("file_integrity", _FILES, "select * from fs")
add("manifest_rollup", _FILES, """select manifest_rows, non_ok_manifest_rows, error_rows, case when non_ok_manifest_rows = 0 and error_rows = 0 then 'PASS' else
  'PARTIAL_OR_FAILED' end as status from (select count(*) as manifest_rows, count(*) filter (status <> 'OK') as non_ok_manifest_rows,
  (select count(*) from m where k = 99) as error_rows from fs)""")
_ISO = lambda x: f"strftime(make_timestamp({x} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
add("refreshed_manifest", _FILES, f"""select dataset_id, symbol, local_path, case when ev then {_ISO('lo')} else '' end as start_timestamp_utc,
  case when ev then {_ISO('hi')} else '' end as end_timestamp_utc, case when ev then n else 0 end as row_count,
  case when ev and ins > 0 then 'archive_rest_gap_resolved' else 'archive' end as source_type, case when ev and ins > 0 then 'b' else 'a' end as source_url,
  case when ev then 'OK' else 'PENDING' end as status, case when not ev then 'x' when ins > 0 then 'x | gap_resolution=inserted_exact_rest_rows'
  else 'x | gap_resolution=no_insert' end as notes from (select dataset_id, symbol, local_path, bool_or((ts_open_ms // 86400000) % 2 = 0) as ev, min(ts_open_ms) as lo,
  max(ts_open_ms) as hi, count(*) as n, count(*) filter (k = 0) as ins from fl group by all)""")
_GAP = f"""{MINUTE}, st as (select * from m where k % 10 <> 0), sr as (select symbol, ts_open_ms, value from (select * from st where symbol <> '{FLAWED}'
    qualify row_number() over (partition by symbol, ts_open_ms order by event_id) = 1) union all select symbol, ts_open_ms, value from st where symbol = '{FLAWED}'
    union all select symbol, ts_open_ms, value from st where symbol = '{FLAWED}' and k = 1),
  rc as (select symbol, ts_open_ms, arg_max(value, event_id) as value, arg_max(k, event_id) % 40 <> 0 as usable from m where k % 20 = 0 group by all),
  tw as (select distinct symbol, date_trunc('month', make_timestamp(ts_open_ms * 1000)) as mo from (select symbol, ts_open_ms from sr group by all having count(*) > 1)),
  tg as (select distinct symbol, ts_open_ms from m where k % 5 = 0), rp as materialized (select symbol, ts_open_ms, case when (symbol, ts_open_ms) in (select (symbol, ts_open_ms) from sr)
  then 'ALREADY_PRESENT' when rc.usable is null then 'NOT_RETURNED' when not rc.usable or (symbol, date_trunc('month', make_timestamp(ts_open_ms * 1000))) in (select (symbol, mo) from tw)
  then 'VALIDATION_FAIL' else 'RECOVERED' end as target_status from tg left join rc using (symbol, ts_open_ms))"""
add("gap_fill_report", _GAP, """select symbol, ts_open_ms, target_status, target_status in ('RECOVERED', 'ALREADY_PRESENT') as recovered, target_status = 'RECOVERED' as inserted from rp""")
add("gap_filled_series", _GAP, f"""select symbol, ts_open_ms, {r('value')} from (select * from sr union all select symbol, ts_open_ms, value from rc
  where (symbol, ts_open_ms) in (select (symbol, ts_open_ms) from rp where target_status = 'RECOVERED'))""")
_SRC = f"""{MINUTE}, {FUNDING}, pr as (select symbol, ts_open_ms as ts_ms, bool_or(k % 10 <> 0) as u, bool_or(k % 7 <> 0) as p, bool_or(k % 11 <> 0) as q,
  bool_or(k % 13 <> 0) as i, ts_open_ms in {GAPS_MS} as gap from m group by symbol, ts_open_ms),
  ft as (select symbol, min(ts_settle_ms) + 28800000 as first_f from f group by symbol),
  av as materialized (select ts_ms, {_ISO('ts_ms')} as timestamp_utc, symbol, u as has_um_klines, p as has_premium_index, q as has_mark_price, i as has_index_price,
    p and q and i as has_all_price_state, coalesce(ts_ms >= first_f, false) as funding_available_after_timestamp, gap as known_gap_timestamp,
    not (p and q and i) or gap as no_signal_required, case when gap then 'known_gap_no_fill_no_signal' else '' end as notes from pr left join ft using (symbol) where u),
  fm as materialized (select ts_ms - ts_ms % 300000 as bar_5m_ms, symbol, count(*) filter (has_um_klines) as a, count(*) filter (has_premium_index) as b,
    count(*) filter (has_mark_price) as c, count(*) filter (has_index_price) as d from av group by all)"""
add("availability_flags", _SRC, "select * from av")
add("report_csv", _SRC, """select timestamp_utc, symbol, upper(cast(has_all_price_state as varchar)) as has_all_price_state,
  upper(cast(no_signal_required as varchar)) as no_signal_required, notes from av""")
add("five_minute_dependency", _SRC, f"""select bar_5m_ms, {_ISO('bar_5m_ms')} as bar_5m_timestamp_utc, symbol, cast(5 as bigint) as required_1m_rows,
  a as available_1m_rows_um_klines, b as available_1m_rows_premium, c as available_1m_rows_mark, d as available_1m_rows_index,
  least(a, b, c, d) = 5 as complete_for_price_state_features, least(a, b, c, d) <> 5 as no_signal_required,
  case when least(a, b, c, d) = 5 then 'complete' else 'no_signal_required_due_incomplete_1m_source' end as notes from fm""")
_ALIGN = f"""{_SRC}, al as (select symbol, ts_ms, u, gap, 'premium_index_klines' as dataset_id, p as h from pr union all select symbol, ts_ms, u, gap, 'mark_price_klines', q from pr
  union all select symbol, ts_ms, u, gap, 'index_price_klines', i from pr), ax as (select dataset_id, symbol, count(*) filter (u) as rows_checked,
  count(*) filter (u and not h) as missing_vs_grid, count(*) filter (u and not h and gap) as expected_missing, count(*) filter (not u and h) as unexpected_extra,
  count(*) filter (u and not h and not gap) + count(*) filter (not u and h) as failures from al group by all)"""
add("price_alignment", _ALIGN, "select * from ax")
add("alignment_errors", _ALIGN, f"""select 'PIT_PRICE_ALIGNMENT' as check_id, dataset_id, symbol, {_ISO('ts_ms')} as timestamp_utc, case when u then
  'UNEXPECTED_MISSING_PRICE_STATE' else 'PRICE_STATE_EXTRA_TIMESTAMP' end as error_type from al where (u and not h and not gap) or (not u and h)""")


def _rows(src: str) -> str:
    checks = {
        ("PIT_SYMBOL", "SYMBOL_MISMATCH"): "k = 2",
        ("PIT_COMPLETED_1M_BAR", "CLOSE_TIME_FAIL"): "k = 3",
        ("PIT_SOURCE_TIMESTAMP", "OPEN_ALIGNMENT_FAIL"): "k = 1",
        ("PIT_DUPLICATE", "DUPLICATE_TIMESTAMP"): "dup > 1",
        ("PIT_MONOTONIC", "NON_MONOTONIC"): "om <= prev",
    }
    parts = " union all ".join(f"select symbol, om, '{c}' as check_id, '{e}' as error_type from rg where {cond}" for (c, e), cond in checks.items())
    return f"""{src}, rr as (select *, ts_open_ms + case when k = 1 then 17 else 0 end as om from m),
  rg as materialized (select *, row_number() over (partition by symbol, om order by event_id) as dup, lag(om) over (partition by symbol order by event_id) as prev
    from rr where k not in (4, 6)), re as materialized ({parts} union all select symbol, null, 'PIT_SOURCE_TIMESTAMP', 'TIMESTAMP_PARSE_FAIL' from rr where k = 4
    union all select symbol, null, 'PIT_SCHEMA_BAR', 'SCHEMA_FAIL' from rr where k = 6),
  ss as materialized (select 'um_klines_1m' as dataset_id, symbol, (select count(*) from rr r2 where r2.symbol = s.symbol and k <> 6) as rows_checked,
    (select count(*) from re where re.symbol = s.symbol) as failures, (select min(om) from rg where rg.symbol = s.symbol) as min_ms,
    (select max(om) from rg where rg.symbol = s.symbol) as max_ms from (select distinct symbol from rr) s)"""


add("row_check_errors", _rows(MINUTE), f"""select 'um_klines_1m' as dataset_id, symbol, {_ISO('om')} as timestamp_utc, check_id, error_type, count(*) as errors
  from re group by all""")
add("source_check_summary", _rows(MINUTE), "select * from ss")
add("check_summary", _rows(_ALIGN), """select check_id, dataset_id, symbol, case when failures = 0 then 'PASS' else 'FAIL' end as status, rows_checked, failures from (
  select 'PIT_SOURCE_TIMESTAMP' as check_id, dataset_id, symbol, rows_checked, failures from ss union all
  select 'PIT_COMPLETED_1M_BAR', dataset_id, symbol, rows_checked, failures from ss union all
  select 'PIT_PRICE_ALIGNMENT', dataset_id, symbol, rows_checked, failures from ax union all
  select 'PIT_KNOWN_GAP_FLAGS', 'price_state', symbol, 0, 0 from (select distinct symbol from av) union all
  select 'PIT_AVAILABILITY_TABLE', 'price_state', symbol, count(*), 0 from av group by symbol union all
  select 'PIT_5M_DEPENDENCY', 'price_state', symbol, count(*), 0 from fm group by symbol)""")
add("dataset_tiers", """pb as (select source, lang, bool_or(doc_id % 3 = 0) as a21, bool_or(doc_id % 5 = 0) as a24, bool_or(doc_id % 7 = 0) as al,
  bool_or(n_chars % 11 = 0) as r21, bool_or(n_chars % 13 = 0) as r24, bool_or(n_chars % 17 = 0) as rl, bool_and(n_chars > 0) as ok from documents group by all)""",
    """select source as dataset_id, case when count(distinct lang) filter (lang in ('en', 'de') and ok and ((a24 and (al or rl) and (a21 or source = 'funding_rate_history'))
  or (r21 and r24 and rl))) = 2 then 'TIER 1' else 'UNKNOWN' end as tier from pb group by source""")
_NAMES = "['open_interest_statistics', 'taker_buy_sell_volume', 'basis', 'um_agg_trades', 'um_trades', 'um_klines_1m']"
add("history_classes", f"""h as (select user_id, {_NAMES}[user_id % 6 + 1] as dataset_id, count(*) filter (epoch_us(ts) // 1000 >= 1706000000000) as rn,
  count(*) filter (epoch_us(ts) // 1000 < 1704500000000) as od, bool_or(epoch_us(ts) // 1000 < 1704300000000) as ar from events group by user_id),
  c as (select *, case when user_id % 6 < 3 then case when od > 0 then 1 when rn > 0 then 2 else 0 end when user_id % 6 < 5 then 0
    when (od > 0 or ar) and rn > 0 then 1 else 0 end as v from h)""",
    """select dataset_id, user_id, case v when 1 then 'YES' when 2 then 'NO' else 'UNKNOWN' end as approved, case v when 1 then 'TIER 1' when 2 then 'TIER 2' else 'UNKNOWN' end as tier from c""")

# ---- signals and trades --------------------------------------------------------------------------------------------------------

add("lead_lag_signal", bars("1h"), f"""select x.exchange, x.timeframe, x.ts_open_ms, x.symbol, {r('(x.close / x.open - 1) * 100', 'follower_move_pct')},
  {r('(y.close / y.open - 1) * 100', 'leader_move_pct')}, cast(case when (y.close / y.open - 1) * 100 >= 0.35 and (x.close / x.open - 1) * 100 <= 0.12 then 1
  when (y.close / y.open - 1) * 100 <= -0.35 and (x.close / x.open - 1) * 100 >= -0.12 then -1 else 0 end as bigint) as direction
  from b x join b y on x.ts_open_ms = y.ts_open_ms where x.symbol = '{PAIR[1]}' and y.symbol = '{PAIR[0]}'""")
_P12 = "over (partition by symbol order by ts_open_ms rows between 12 preceding and 1 preceding)"
_BRK = f"""{bars('1h')}, k0 as (select *, row_number() {_W} - 1 as bar_idx, max(high) {_P12} as compression_high, min(low) {_P12} as compression_low,
    count(*) {_P12} >= 12 as checked from b),
  k1 as (select *, case when checked then (compression_high - compression_low) / ((compression_high + compression_low) / 2) * 100 end as compression_range_pct from k0),
  k2 as (select *, checked and compression_range_pct <= 9.85 as condition_met from k1),
  k3 as materialized (select *, case when condition_met and close > compression_high then 1 when condition_met and close < compression_low then -1 else 0 end as direction from k2)"""
add("compression_breakout_signal", _BRK, f"""select exchange, symbol, timeframe, ts_open_ms, {rs('high low close compression_high compression_low compression_range_pct')},
  checked, coalesce(condition_met, false) as condition_met, cast(direction as bigint) as direction, case when not checked then 'warm_up' when not condition_met then 'no_compression'
  when direction = 0 then 'no_breakout' end as skip_reason from k3""")
add("settlement_displacement_signal", f"""{bars('5m')}, en as (select *, ts_open_ms + 300000 as te from b), sg as (select e0.exchange, e0.symbol, e0.timeframe,
  e0.te as signal_ts, e0.te - 300000 as settle_ms from en e0 where (e0.te - 300000) % 28800000 = 0), sx as (select sg.*, x.close as start_close, y.close as last_close,
  case when x.close > 0 then 100 * (y.close / x.close - 1) end as displacement_pct from sg left join en x on x.symbol = sg.symbol and x.te = settle_ms - 1800000
  left join en y on y.symbol = sg.symbol and y.te = settle_ms - 300000), sd as (select *, case when displacement_pct >= 0.35 then -1 when displacement_pct <= -0.35 then 1
  else 0 end as d from sx)""", f"""select exchange, symbol, timeframe, settle_ms, {rs('start_close last_close')}, signal_ts, {r('displacement_pct')}, cast(d as bigint) as direction,
  case when start_close is null then 'missing_pre_window_start' when last_close is null then 'missing_last_pre_settlement' when d = 0 then 'no_displacement' end as skip_reason from sd""")


def _four(value: str) -> str:
    return f"""ob as (select exchange, symbol, ts_open_ms + 3600000 as te, {value} as v from b), cb as (select exchange, symbol,
    (te + 14399999) // 14400000 * 14400000 as bar_end_ms, arg_min(v, te) as open, max(v) as high, min(v) as low, arg_max(v, te) as close, count(*) as observations,
    count(*) = 4 as complete from ob group by exchange, symbol, (te + 14399999) // 14400000)"""


add("close_bars", f"{bars('1h')}, {_four('close')}", f"select exchange, symbol, bar_end_ms, {rs('open high low close')}, observations, complete from cb")
_PREM = f"""{bars('1h')}, {FUNDING}, {_four('close / mean_px - 1')}, ps as (select cb.exchange, cb.symbol, bar_end_ms, close - open as premium_delta, complete,
    {' or '.join(f'(bar_end_ms - 14400000 <= {g} and {g} < bar_end_ms)' for g in GAPS_MS)} as known_gap, f.funding_rate from cb
    asof left join f on cb.symbol = f.symbol and cb.bar_end_ms >= f.ts_settle_ms),
  pq as (select *, case when known_gap then 'known_gap' when not complete then 'incomplete_premium' when funding_rate is null then 'missing_funding' end as rs from ps),
  pd as materialized (select *, case when rs is not null then 0 when funding_rate >= 1e-4 and premium_delta <= -5e-3 then -1
    when funding_rate <= -1e-4 and premium_delta >= 5e-3 then 1 else 0 end as d from pq)"""
add("funding_premium_signal", _PREM, f"""select exchange, symbol, bar_end_ms, {rs('premium_delta funding_rate', 12)}, known_gap, cast(d as bigint) as direction,
  case when rs is not null then rs when d = 0 then 'no_condition' end as skip_reason from pd""")
add("signal_funnel", _PREM, """select exchange, symbol, cast(make_timestamp(bar_end_ms * 1000) as date) as date, count(*) as rows_checked, count(*) filter (d > 0) as long_signals,
  count(*) filter (d < 0) as short_signals, cast(0 as bigint) as missing_premium, count(*) filter (rs = 'known_gap') as known_gap, count(*) filter (rs = 'incomplete_premium') as incomplete_premium,
  count(*) filter (rs = 'missing_funding') as missing_funding, count(*) filter (rs is null and d = 0) as no_condition from pd group by all""")
_W20 = "over (partition by symbol order by ts_settle_ms rows between 20 preceding and 1 preceding)"
add("funding_zscore_signal", f"""{TICK}, {FUNDING}, z as (select *, case when count(*) {_W20} >= 20 then (funding_rate - avg(funding_rate) {_W20}) /
  nullif(stddev_pop(funding_rate) {_W20}, 0) end as funding_zscore from f)""", f"""select exchange, symbol, ts_settle_ms, {r('funding_rate')}, funding_interval_ms,
  {r('funding_zscore')}, cast(case when abs(funding_zscore) >= 1.5 then 1 else 0 end as bigint) as direction from z""")
add("maker_fills", f"""{bars('1h')}, mk as (select *, case when trades % 2 = 0 then 1 else -1 end as side, case when trades % 2 = 0 then close - 10 else close + 10 end as lim,
  lead(low) {_W} as nl, lead(high) {_W} as nh, lead(close) {_W} as nc from b)""", f"""select exchange, symbol, timeframe, ts_open_ms, cast(side as bigint) as side, {r('lim', 'limit_price')},
  case when nc is null then 'pending' when side > 0 then case when nl > lim then 'drop' when nc <= lim * (1 - 0.0005) then 'fill' else 'expire' end
  else case when nh < lim then 'drop' when nc >= lim * (1 + 0.0005) then 'fill' else 'expire' end end as action from mk""")
_LEDGER = f"""{_BRK}, sgn as materialized (select *, row_number() over (partition by symbol order by bar_idx) as i from k3 where direction <> 0),
  ca as materialized (select s.symbol, s.exchange, s.timeframe, s.i, s.ts_open_ms as signal_ts, s.bar_idx as si, s.direction, en.ts_open_ms as entry_ts, en.close as entry_price,
    min(x.bar_idx) filter (s.direction * (x.close / en.close - 1) <= -0.02) as stop_idx, max(x.bar_idx) as last_idx, count(x.bar_idx) as held
    from sgn s left join k3 en on en.symbol = s.symbol and en.bar_idx = s.bar_idx + 1 left join k3 x on x.symbol = s.symbol and x.bar_idx between s.bar_idx + 2 and s.bar_idx + 7
    group by all),
  cb as materialized (select ca.*, coalesce(stop_idx, last_idx) as xi, q.ts_open_ms as exit_ts, q.close as exit_price, case when entry_ts is null then 'no_entry_bar'
    when last_idx is null then 'no_exit_bar' end as sr from ca left join k3 q on q.symbol = ca.symbol and q.bar_idx = coalesce(stop_idx, last_idx)),
  op as materialized (select symbol, si, xi, row_number() over (partition by symbol order by si) as n from cb where sr is null),
  wk as (select symbol, n, si, xi as busy, true as taken from op where n = 1 union all select op.symbol, op.n, op.si, case when op.si >= wk.busy then op.xi else wk.busy end,
    op.si >= wk.busy from wk join op on op.symbol = wk.symbol and op.n = wk.n + 1),
  ld as materialized (select cb.*, coalesce(wk.taken, false) as taken from cb left join wk on wk.symbol = cb.symbol and wk.si = cb.si)"""
add("trade_ledger", _LEDGER, f"""select 'breakout' as strategy_id, exchange, symbol, timeframe, signal_ts, cast(direction as bigint) as direction, entry_ts, {r('entry_price')}, exit_ts,
  {r('exit_price')}, case when taken then null else coalesce(sr, 'already_in_position') end as skip_reason, case when stop_idx is not null then 'stop' when held >= 6 then 'time_exit'
  when last_idx is not null then 'end_of_data' end as exit_reason, taken from ld""")
add("momentum_ledger", f"""{bars('1h')}, k0 as materialized (select *, row_number() {_W} - 1 as i, close / lag(close) {_W} - 1 as mv from b),
  sg as materialized (select strategy_id, exchange, symbol, timeframe, ts_open_ms as signal_ts, i, sign * (case when mv >= 0.01 then 1 when mv <= -0.01 then -1 else 0 end) as direction
    from k0, (values ('follow', 1), ('fade', -1)) t(strategy_id, sign) where abs(mv) >= 0.01),
  ca as materialized (select s.*, en.ts_open_ms as entry_ts, en.close as entry_price, min(x.i) filter (s.direction * (x.close / en.close - 1) <= -0.06) as stop_i,
    max(x.i) as last_i from sg s left join k0 en on en.symbol = s.symbol and en.i = s.i + 1 left join k0 x on x.symbol = s.symbol and x.i between s.i + 2 and s.i + 13 group by all),
  cb as materialized (select ca.*, coalesce(stop_i, last_i) as xi, q.ts_open_ms as exit_ts, q.close as exit_price,
    case when entry_ts is null then 'no_entry_bar' when last_i is null then 'no_exit_bar' end as sr from ca left join k0 q on q.symbol = ca.symbol and q.i = coalesce(stop_i, last_i)),
  op as materialized (select strategy_id, symbol, i, xi, row_number() over (partition by strategy_id, symbol order by i) as n from cb where sr is null),
  wk as (select strategy_id, symbol, n, i, xi as busy, true as taken from op where n = 1 union all select op.strategy_id, op.symbol, op.n, op.i,
    case when op.i >= wk.busy then op.xi else wk.busy end, op.i >= wk.busy from wk join op on op.strategy_id = wk.strategy_id and op.symbol = wk.symbol and op.n = wk.n + 1),
  ld as (select cb.*, coalesce(wk.taken, false) as taken from cb left join wk on wk.strategy_id = cb.strategy_id and wk.symbol = cb.symbol and wk.i = cb.i)""",
    f"""select strategy_id, exchange, symbol, timeframe, signal_ts, cast(direction as bigint) as direction, entry_ts, {r('entry_price')}, exit_ts, {r('exit_price')},
  case when taken then null else coalesce(sr, 'already_in_position') end as skip_reason, case when stop_i is not null then 'stop' when last_i = i + 13 then 'time_exit'
  when last_i is not null then 'end_of_data' end as exit_reason, taken from ld""")
_G = "direction * (exit_price / entry_price - 1) * 100"
add("ledger_returns", _LEDGER, f"""select symbol, signal_ts, {r(_G, 'pre_fee_pct')}, {r(f'{_G} - 100 * (0.0002 * 2 * entry_price + 0.0004 * 2 * exit_price) / (2 * entry_price)', 'post_fee_pct')},
  {r(f'{_G} - 0.08', 'post_fee_estimate_pct')}, {r(f'{_G} - 0.18', 'full_friction_pct')} from ld where taken""")
add("leakage_audit", _LEDGER, "select 'breakout' as strategy_id, symbol, count(*) as trades, count(*) filter (entry_ts <= signal_ts) as violations from ld where taken group by symbol")
_TT = f"""{TICK}, tt as materialized (select symbol as strategy_id, event_id as trade_seq, cast(make_timestamp(ts_ms * 1000) as date) as date, (value - 45) / 50 as pre,
  (value - 45) / 50 - 0.08 as post, value, k, ts_ms >= 1705276800000 as oos from tick)"""
_DAYW = "over (partition by strategy_id, date order by trade_seq)"
add("daily_trade_summary", f"""{_TT}, dd as (select *, ({'max(value + 100) ' + _DAYW}) as pk from tt)""", f"""select strategy_id, date, count(*) as trades,
  {r('avg(case when post > 0 then 1.0 else 0.0 end)', 'win_rate', 9)}, {r('avg(pre)', 'avg_pre_fee', 9)}, {r('avg(post)', 'avg_post_fee', 9)},
  {r('max((pk - (value + 100)) / pk)', 'intraday_max_dd', 9)} from dd group by strategy_id, date""")
add("running_drawdown", f"""{bars('1h')}, pk as (select exchange, symbol, ts_open_ms, close as equity, max(close) {_W} as peak from b),
  pd as (select *, (peak - equity) / peak as drawdown from pk)""", f"""select exchange, symbol, ts_open_ms, {rs('equity peak drawdown')}, max(case when drawdown >= 0.08 then 1 else 0 end)
  over (partition by symbol order by ts_open_ms) = 1 as tripped from pd""")
_PATH = f"""{_TT}, lg as (select strategy_id, trade_seq, exp(sum(ln(1 + post / 10000)) over (partition by strategy_id order by trade_seq)) * 100 as eq from tt),
  pk as (select *, greatest(100, max(eq) over (partition by strategy_id order by trade_seq)) as peak from lg),
  ps as (select strategy_id, max((peak - eq) / peak) * 100 as max_drawdown_pct, arg_max(eq, trade_seq) as fe, count(*) as trades from pk group by strategy_id)"""
add("run_totals", _PATH, f"select strategy_id, trades, {r('fe - 100', 'net_return_pct')}, {r('max_drawdown_pct')}, trades < 300 as too_few_trades from ps")
add("falsification_criteria", f"""{_PATH}, st as (select strategy_id, count(*) as trades, avg(pre) / 100 as avg_pre_fee, avg(post) filter (oos) / 100 as oos_avg_net,
  avg(post) filter (oos) / nullif(stddev_samp(post) filter (oos), 0) * sqrt(count(*) filter (oos)) as oos_sharpe, avg(case when post > 0 then 1.0 else 0.0 end) filter (not oos) as is_win_rate,
  avg(case when post > 0 then 1.0 else 0.0 end) filter (oos) as oos_win_rate, sum(post) filter (post > 0) / nullif(-sum(post) filter (post < 0), 0) as profit_factor from tt group by strategy_id),
  c as (select st.*, max_drawdown_pct, st.trades >= 300 as c1_trades, coalesce(oos_sharpe > 1, false) as c2_sharpe, coalesce(oos_avg_net > 0, false) as c3_net, max_drawdown_pct < 25 as c4_drawdown,
  coalesce(avg_pre_fee >= 0.001, false) as c5_pre_fee, coalesce(is_win_rate >= 0.5 and oos_win_rate >= 0.5, false) or coalesce(profit_factor >= 1.25, false) as c6_wins from st join ps using (strategy_id))""",
    f"""select strategy_id, trades, {rs('avg_pre_fee oos_avg_net oos_sharpe is_win_rate oos_win_rate profit_factor max_drawdown_pct')}, c1_trades, c2_sharpe, c3_net, c4_drawdown, c5_pre_fee,
  c6_wins, case when not c1_trades or oos_avg_net is null or is_win_rate is null then 'INCONCLUSIVE' when c2_sharpe and c3_net and c4_drawdown and c5_pre_fee and c6_wins then 'PRELIMINARY_PASS'
  else 'FAIL' end as verdict from c""")
_DRAWS = f"""{_TT}, dy as (select strategy_id, date, avg(post) as pnl from tt group by strategy_id, date),
  tr as (select strategy_id, 1 + pnl / 100 as f, row_number() over (partition by strategy_id order by date) - 1 as idx, count(*) over (partition by strategy_id) as n from dy),
  pl as (select strategy_id, idx as place, n, f, sim, cast('0x' || substr(md5(concat_ws('|', 17, strategy_id, sim, idx)), 1, 15) as bigint) as h from tr, range(1000) as s(sim)),
  sk as (select distinct strategy_id, n, sim, cast(ceil(sqrt(n)) as bigint) as wd, cast('0x' || substr(md5('17|' || strategy_id), 1, 8) as bigint) as ck from pl),
  s32 as (select sk.*, {_mix('sim', 'a')}, {_mix('xor(ck, a)', 'key')} from sk),
  w0 as (select strategy_id, n, sim, wd, (n + wd - 1) // wd as ht, key, tr.idx as place from s32 join tr using (strategy_id, n)),
  wk as ({_feistel('w0', 'place')} union all {_feistel('(select * from wk where y >= n)', 'y')}),
  dr as (select 'bootstrap' as mode, pl.strategy_id, sim, place as ord, 0 as tie, tr.f from pl join tr on pl.strategy_id = tr.strategy_id and tr.idx = pl.h % pl.n
    union all select 'shuffle', wk.strategy_id, sim, place, 0, tr.f from wk join tr on wk.strategy_id = tr.strategy_id and tr.idx = wk.y where y < wk.n),
  eq as (select mode, strategy_id, sim, ord, tie, 200 * product(f) over (partition by mode, strategy_id, sim order by ord, tie) as e from dr),
  pk as (select *, greatest(200, max(e) over (partition by mode, strategy_id, sim order by ord, tie)) as peak from eq),
  mc as (select mode, strategy_id, sim, case when min(e) <= 0 then 0 else arg_max(e, struct_pack(a := ord, b := tie)) end as final_equity,
    case when min(e) <= 0 then 100 else max((peak - e) / peak) * 100 end as max_drawdown_pct from pk group by mode, strategy_id, sim)"""
add("monte_carlo_paths", _DRAWS, f"select mode, strategy_id, sim, {rs('final_equity max_drawdown_pct')} from mc")
add("monte_carlo_verdict", f"""{_DRAWS}, ag as (select strategy_id, count(*) as simulations, quantile_cont(final_equity, 0.05) as p5_final_equity,
  quantile_cont(final_equity, 0.5) as median_final_equity, quantile_cont(final_equity, 0.95) as p95_final_equity, quantile_cont(max_drawdown_pct, 0.5) as median_max_drawdown_pct,
  quantile_cont(max_drawdown_pct, 0.95) as p95_max_drawdown_pct, avg(case when final_equity < 200 then 1.0 else 0.0 end) * 100 as prob_final_below_start from mc where mode = 'bootstrap' group by strategy_id),
  co as (select ag.*, trades, p5_final_equity > 200 as c1, p95_max_drawdown_pct < 25 as c2, prob_final_below_start < 5 as c3, trades >= 20 as c4
    from ag join (select strategy_id, max(n) as trades from tr group by strategy_id) using (strategy_id))""",
    f"""select strategy_id, simulations, {rs('p5_final_equity median_final_equity p95_final_equity median_max_drawdown_pct p95_max_drawdown_pct prob_final_below_start')}, trades,
  c1 as cond_final_p5_gt_start, c2 as cond_dd_p95_lt_max, c3 as cond_prob_loss_lt_max, c4 as cond_trade_count_ok,
  case when not c4 then 'INCONCLUSIVE' when c1 and c2 and c3 then 'PASS' else 'FAIL' end as verdict from co""")
add("path_statistics", f"""{_TT}, pa as (select strategy_id, date, 200 + sum(post) as fe, max(value) as dd, count(*) as n from tt group by strategy_id, date),
  ag as (select strategy_id, count(*) as simulations, quantile_cont(fe, 0.05) as p5_final_equity, quantile_cont(fe, 0.5) as median_final_equity, quantile_cont(fe, 0.95) as p95_final_equity,
  quantile_cont(dd, 0.5) as median_max_drawdown_pct, quantile_cont(dd, 0.95) as p95_max_drawdown_pct, avg(case when fe < 200 then 1.0 else 0.0 end) * 100 as prob_final_below_start,
  cast(sum(n) as bigint) as trades from pa group by strategy_id), co as (select *, p5_final_equity > 200 as c1, p95_max_drawdown_pct < 25 as c2, prob_final_below_start < 5 as c3, trades >= 300 as c4 from ag)""",
    f"""select strategy_id, simulations, {rs('p5_final_equity median_final_equity p95_final_equity median_max_drawdown_pct p95_max_drawdown_pct prob_final_below_start')}, trades,
  c1 as cond_final_p5_gt_start, c2 as cond_dd_p95_lt_max, c3 as cond_prob_loss_lt_max, c4 as cond_trade_count_ok, case when not c4 then 'INCONCLUSIVE' when c1 and c2 and c3 then 'PASS' else 'FAIL' end as verdict from co""")

# ---- run exports ---------------------------------------------------------------------------------------------------------------


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_ALL = [*PRIMARY_FILES, *SECONDARY_FILES]
add("run_evidence", f"""fn as (select cast(conv_id as varchar) as run_id, {_list([*_ALL, 'notes.md'])}[(conv_id + turn * 5) % 9 + 1] as f from conversations),
  fa as (select run_id, list_sort(list(distinct f) filter (f <> 'notes.md')) as p, bool_or(list_contains({_list(PRIMARY_FILES)}, f)) as a,
  bool_or(list_contains({_list(SECONDARY_FILES)}, f)) as b from fn group by run_id)""", f"""select run_id, coalesce(array_to_string(p, ','), '') as present_files,
  array_to_string(list_sort(list_filter({_list(_ALL)}, lambda x: not list_contains(coalesce(p, []), x))), ',') as missing_files,
  case when a then 'OK' when b then 'LOW_CONFIDENCE' else 'NO_EVIDENCE' end as evidence_confidence from fa""")
_ALIAS = ", ".join(f"('{m}', '{a}', {i})" for m, names in METRIC_ALIASES.items() for i, a in enumerate(names))
_LEAVES = f"""lv as (select cast(l_orderkey as varchar) as run_id, l_suppkey % 2 as sr, ['statistics.sharpe ratio', 'total trades', 'drawdown', 'stats.win rate', 'netprofit', 'other'][l_partkey % 6 + 1] as path,
  '$' || cast(floor(l_quantity * 10) as bigint) as value,
  l_linenumber * 1000000000000 + l_partkey * 100000 + cast(floor(l_quantity * 10) as bigint) as pos from lineitem), al as (select * from (values {_ALIAS}) t(metric, alias, ar)),
  me as materialized (select run_id, metric, arg_min(value, (sr, ar, pos)) as value from lv join al on contains(path, alias) group by run_id, metric)"""
add("run_metrics", _LEAVES, "select * from me")
add("run_reports", f"""{_LEAVES}, fa as (select cast(l_orderkey as varchar) as run_id, list_sort(list(distinct {_list(_ALL)}[l_partkey % 8 + 1])) as p,
  bool_or(l_partkey % 8 < 5) as a, count(*) filter (l_linenumber > 4) * 40 as tr from lineitem group by l_orderkey),
  w as (select run_id, max(value) filter (metric = 'total_trades') as tt, max(value) filter (metric = 'sharpe') as sharpe, max(value) filter (metric = 'max_drawdown') as max_drawdown,
  max(value) filter (metric = 'win_rate') as win_rate, max(value) filter (metric = 'net_return') as net_return from me group by run_id),
  x as (select fa.*, w.* exclude (run_id), case when a then 'OK' else 'LOW_CONFIDENCE' end as cf, coalesce(nullif(tr, 0), cast(substr(tt, 2) as bigint)) as n from fa left join w using (run_id))""",
    """select run_id, array_to_string(p, ',') as present_files, cf as evidence_confidence, coalesce(tt, cast(nullif(tr, 0) as varchar)) as total_trades, sharpe, max_drawdown, win_rate, net_return,
  case when cf <> 'OK' then 'INCONCLUSIVE_DRAFT' when n < 30 then 'FAIL_DRAFT' when n < 300 then 'INCONCLUSIVE_DRAFT' else 'READY_FOR_REVIEW' end as verdict,
  case when cf <> 'OK' then 'screenshots only; no machine-readable artifacts' when n < 30 then 'trade count ' || n || ' below swing minimum 30'
  when n < 300 then 'trade count ' || n || ' below intraday minimum 300' else 'primary artifacts present; criteria 1-6 to be evaluated in review' end as reason from x""")
add("trade_file_counts", "c as (select 'BT' || lpad(cast(o_custkey % 25 as varchar), 4, '0') as run_id, count(*) as trades from orders group by o_custkey % 25)",
    """select run_id, trades, case when trades < 30 then 'FAIL_DRAFT' when trades < 300 then 'INCONCLUSIVE_DRAFT' else 'READY_FOR_REVIEW' end as verdict from c""")
add("run_trade_counts", "c as (select o_custkey, count(*) as trades from orders group by o_custkey)", """select o_custkey, trades, case when trades * 10 < 30 then 'FAIL_DRAFT'
  when trades * 10 < 300 then 'INCONCLUSIVE_DRAFT' else 'READY_FOR_REVIEW' end as verdict, case when trades * 10 < 30 then 'trade count ' || trades * 10 || ' below swing minimum 30'
  when trades * 10 < 300 then 'trade count ' || trades * 10 || ' below intraday minimum 300' else 'primary artifacts present; criteria 1-6 to be evaluated in review' end as reason from c""")
add("experiments_upsert", "n as (select distinct cast(l_orderkey + 7 as varchar) as backtest_id from lineitem where l_quantity > 45)", """select cast(o_orderkey as varchar) as backtest_id,
  o_orderstatus as verdict from orders where cast(o_orderkey as varchar) not in (select backtest_id from n) union all select backtest_id, 'NEW' from n""")

_METRIC_PATHS = _list(f"stats.{names[0]}" for names in METRIC_ALIASES.values())
_WIDE = ", ".join(f"max(value) filter (metric = '{m}') as {m}" for m in METRIC_ALIASES)
_FIELDS = ", ".join(f"coalesce({m}, '') as {m}" for m in METRIC_ALIASES if m != "total_trades")
_EMPTY = ", ".join(f"'' as {c}" for c in ("avg_trade_prefee", "mc_p5_final_equity", "mc_p95_max_drawdown", "mc_prob_loss"))
_DAY = "strftime(date '2024-01-01' + s_nationkey, '%Y-%m-%d')"
_REGISTRY = f"""wh as (select *, lpad(cast(s_suppkey as varchar), cast(greatest(4, length(cast(s_suppkey as varchar))) as integer), '0') as four from supplier join nation on s_nationkey = n_nationkey),
  lv as (select s_suppkey, l_linenumber % 2 as sr, {_METRIC_PATHS}[l_partkey % {len(METRIC_ALIASES)} + 1] as path, cast(cast(floor(l_quantity * 100) as bigint) as varchar) as value,
    l_orderkey * 10000000 + l_linenumber * 1000000 + cast(floor(l_quantity * 100) as bigint) as pos, l_quantity from lineitem join wh on l_suppkey = s_suppkey),
  al as (select * from (values {_ALIAS}) t(metric, alias, ar)), me as materialized (select s_suppkey, metric, arg_min(value, (sr, ar, pos)) as value
    from lv join al on contains(path, alias) group by s_suppkey, metric), wi as (select s_suppkey, {_WIDE} from me group by s_suppkey),
  ct as (select s_suppkey, count(*) filter (l_quantity > 25) as tr from lv where s_suppkey % 4 <> 1 group by s_suppkey),
  rp as (select wh.*, wi.* exclude (s_suppkey), tr, case when (s_suppkey + s_nationkey) % 8 < 5 then 'OK' else 'LOW_CONFIDENCE' end as cf, coalesce(tr, cast(total_trades as bigint)) as nt
    from wh left join wi using (s_suppkey) left join ct using (s_suppkey)),
  rg as materialized (select s_suppkey, 'H' || four as hypothesis_id, 'S' || s_nationkey as strategy_id, 'BT' || four as backtest_id, {_DAY} as date, n_name as symbols,
    case when s_suppkey % 2 = 0 then '5m' else '' end as timeframe, {_DAY} as is_start, {_DAY} || ':x' as is_end, case when s_acctbal > 0 then {_DAY} else '' end as oos_start, '' as oos_end,
    coalesce(total_trades, cast(tr as varchar), '') as total_trades, {_FIELDS}, {_EMPTY}, cf as evidence_confidence,
    case when cf <> 'OK' then 'INCONCLUSIVE_DRAFT' when nt < 30 then 'FAIL_DRAFT' when nt < 300 then 'INCONCLUSIVE_DRAFT' else 'READY_FOR_REVIEW' end as verdict,
    case when cf <> 'OK' then 'screenshots only; no machine-readable artifacts' when nt < 30 then 'trade count ' || nt || ' below swing minimum 30'
    when nt < 300 then 'trade count ' || nt || ' below intraday minimum 300' else 'primary artifacts present; criteria 1-6 to be evaluated in review' end as reason,
    'runs/' || case when length(four) = 4 and s_suppkey % 10 <> 7 then 'BT' || four || '_export' else 'raw' || four end as artifacts_path from rp)"""
add("registry_rows", _REGISTRY, "select * exclude (s_suppkey) from rg")
add("experiments_registry", _REGISTRY, """select * exclude (s_suppkey) replace (case when s_suppkey % 6 = 2 then 'REVIEWED' when s_suppkey % 2 = 0 then verdict else 'OLD' end as verdict,
  case when s_suppkey % 2 = 0 then reason else '' end as reason) from rg where s_suppkey % 2 = 0 or s_suppkey % 3 <> 0""")

# ---- streams ----------------------------------------------------------------------------------------------------------------------

add("stream_close_bars", f"""{TICK}, cb as (select 'sim' as exchange, symbol, (ts_ms + 3599999) // 3600000 * 3600000 as bar_end_ms, arg_min(value, (ts_ms, value)) as open, max(value) as high, min(value) as low,
  arg_max(value, (ts_ms, value)) as close, count(*) as observations, count(*) = 3 as complete from tick group by symbol, (ts_ms + 3599999) // 3600000)""",
    f"select exchange, symbol, bar_end_ms, {rs('open high low close')}, observations, complete from cb")
add("stream_daily_summary", _TT, f"""select strategy_id, epoch_ms(cast(date as timestamp)) as day_ms, count(*) as trades, {r('avg(case when post > 0 then 1.0 else 0.0 end)', 'win_rate', 9)},
  {r('avg(pre)', 'avg_pre_fee', 9)}, {r('avg(post)', 'avg_post_fee', 9)} from tt group by strategy_id, date""")
add("stream_latest_funding", f"{TICK}, fs as (select symbol, ts_ms as funding_ms, (value - 50) / 20000 as funding_rate from tick where k < 5)",
    f"""select 'sim' as exchange, b.symbol, b.ts_ms as bar_end_ms, funding_ms, {r('funding_rate', digits=9)} from (select symbol, ts_ms from tick where k >= 5) b
  asof join fs on b.symbol = fs.symbol and b.ts_ms >= fs.funding_ms""")
_W90 = "over (partition by symbol order by ts_ms rows between 90 preceding and 1 preceding)"
add("stream_funding_signal", f"""{TICK}, z as (select symbol, ts_ms, value, case when count(*) {_W90} >= 90 then (value - avg(value) {_W90}) / nullif(stddev_pop(value) {_W90}, 0) end as z from
  (select * from tick qualify row_number() over (partition by symbol, ts_ms order by event_id) = 1))""", f"""select 'sim' as exchange, symbol, ts_ms as ts_settle_ms, {r('value', 'funding_rate')}, {r('z', 'funding_zscore')},
  cast(case when abs(z) >= 1.5 then 1 else 0 end as bigint) as direction from z""")
add("stream_first_cross", f"{TICK}, c as (select symbol, ts_ms, value > 60 as c, lag(value > 60) over (partition by symbol order by ts_ms) as p from tick)",
    "select 'sim' as exchange, symbol, ts_ms from c where c and not coalesce(p, false)")
add("stream_stop_latch", f"""{TICK}, pk as (select symbol as strategy_id, event_id as seq, value + 1000 as equity, max(value + 1000) over (partition by symbol order by event_id) as peak from tick)""",
    f"""select strategy_id, seq, {r('equity')}, {r('(peak - equity) / peak', 'drawdown')}, max(case when (peak - equity) / peak >= 0.08 then 1 else 0 end)
  over (partition by strategy_id order by seq) = 1 as tripped from pk""")
add("stream_match_bars", f"{TICK}, a as (select symbol, ts_ms // 60000 as mi from tick where event_id % 2 = 0), p as (select symbol, ts_ms // 60000 as mi, value, k > 3 as complete from tick where k < 50)",
    f"select 'sim' as exchange, a.symbol, a.mi * 60000 as bar_end_ms, {r('value', 'premium_delta')}, complete from a join p using (symbol, mi)")
add("stream_drop_repeats", TICK, "select distinct 'sim' as exchange, symbol, ts_ms // 3600000 * 3600000 as ts_settle_ms from tick")
