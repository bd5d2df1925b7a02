from pulsegrid.operators import normalize as N
from pulsegrid.operators import platforms as P
from pulsegrid.operators import trades as T

SCHEMA = "timestamp string, wallet_address string, type string, amount_usd double, leverage double, size double, price double, is_close boolean, asset string, side string, source string, to_token string"


def tr(frame, *data):
    return N.normalize_trades(frame(SCHEMA, list(data)))


def sample(frame):
    return tr(frame,
              ("2024-01-01T15:00:00", "a", "swap", 10.0, None, None, None, None, None, None, "s1", "T1"),
              ("2024-01-01T16:00:00", "a", "perps", 10.0, 5.0, 1.0, 1.0, False, "BTC", "long", None, None),
              ("2024-01-02T16:00:00", "b", "perps", 10.0, 2.0, 3.0, 4.0, True, "ETH", "Long", None, None),
              ("2024-01-02T17:00:00", "c", "deposit", 100.0, None, None, None, None, None, None, "s2", None),
              ("2024-01-03T17:00:00", "d", None, 7.0, None, None, None, None, None, None, None, None))


def no_identity(frame):
    return frame("wallet string, label string, contact string, login_type string", [])


def test_kpis_agree_with_breakdown(frame, rows):
    t = sample(frame)
    k = rows(T.trade_kpis(t))[0]
    assert k == {"volume": 84.0, "trades": 3, "traders": 2, "avg_trade": 28.0}
    parts = {r["type"]: r for r in rows(T.trade_type_breakdown(t))}
    assert parts["swap"]["volume"] + parts["perps"]["volume"] == k["volume"]
    assert parts["swap"]["trades"] + parts["perps"]["trades"] == k["trades"]
    assert rows(T.perps_kpis(t))[0]["volume"] == 74.0 and rows(T.deposit_kpis(t))[0]["avg_deposit"] == 100.0


def test_no_rows_give_zeros(frame, rows):
    t = sample(frame).where("false")
    assert rows(T.trade_kpis(t)) == [{"volume": 0.0, "trades": 0, "traders": 0, "avg_trade": 0.0}]
    assert [r["trades"] for r in rows(T.trade_type_breakdown(t))] == [0, 0, 0]
    assert T.leverage_histogram(t).count() == 0


def test_only_closes_count_twice(frame, rows):
    for r in rows(sample(frame)):
        assert r["_volume_usd"] == r["amount_usd"] * (2 if r["is_close"] and r["type"] == "perps" else 1)
    assert rows(T.perps_open_close(sample(frame))) == [{"type": "Close", "volume": 24.0, "count": 1}, {"type": "Open", "volume": 50.0, "count": 1}]


def test_unknown_types_count_for_traders_only(frame, rows):
    got = rows(T.top_traders_by_volume(sample(frame), no_identity(frame)))
    assert [(g["wallet_address"], g["volume"], g["trades"]) for g in got] == [("a", 60.0, 2), ("b", 24.0, 1), ("d", 7.0, 1)]
    assert [g["trades"] for g in rows(T.top_traders_by_count(sample(frame), no_identity(frame)))] == [2, 1, 1]


def test_rounding_comes_after_ranking(frame, rows):
    t = tr(frame, *[("2024-01-01T15:00:00", w, "swap", v, None, None, None, None, None, None, None, w) for w, v in (("a", 2.5), ("b", 2.51), ("c", 3.5))])
    assert [(g["wallet_address"], g["volume"]) for g in rows(T.top_traders_by_volume(t, no_identity(frame), k=2))] == [("c", 4.0), ("b", 3.0)]
    assert [(g["token"], g["volume"]) for g in rows(T.swap_volume_by_token(t))] == [("c", 4.0), ("b", 3.0), ("a", 2.0)]


def test_hours_and_weekdays_are_filled(frame, rows):
    hours = {r["hour"]: r["trades"] for r in rows(T.swaps_by_hour(sample(frame)))}
    assert len(hours) == 24 and hours[10] == 1 and sum(hours.values()) == 1
    days = rows(T.swaps_by_dow(sample(frame)))
    assert [d["day"] for d in days][0] == "Mon" and days[0]["trades"] == 1 and len(days) == 7


def test_histogram_edges(frame, rows):
    def bins(values):
        t = tr(frame, *[("2024-01-01T15:00:00", "a", "perps", 1.0, v, None, None, False, None, None, None, None) for v in values])
        return [(g["bin"], g["count"]) for g in rows(T.leverage_histogram(t))]
    assert bins([1.0, 21.0, 21.0, 11.0]) == [(1, 1), (11, 1), (20, 2)]
    assert bins([5.0, 5.0]) == [(1, 2)]


def test_recent_rows_keep_duplicates_and_local_time(frame, rows):
    row = ("2024-01-02T03:30:00", "0xAAAAAAAA", "deposit", 1.0, None, None, None, None, None, None, "s", None)
    got = rows(T.recent_deposits(tr(frame, row, row, row), no_identity(frame), k=2))
    assert got == [{"time": "Jan 01, 10:30 PM", "user_label": "0xAA...AAAA", "login_type": "—", "wallet": "0xAA...AAAA", "amount_usd": 1.0, "source": "s"}] * 2


def test_wallet_on_both_platforms_counts_in_both(frame, make_events, rows):
    e = N.normalize_events(make_events(("2024-01-01T12:00:00", "a", "x", "ios"), ("2024-01-01T12:00:00", "a", "x", "Android"), ("2024-01-01T12:00:00", "b", "x", "ios"), ("2024-01-01T12:00:00", "z", "x", "web")))
    t = sample(frame)
    assert P.platform_trades(t, e).count() == 5
    got = {r["platform"]: r for r in rows(P.platform_trade_kpis(t, e))}
    assert (got["ios"]["volume"], got["ios"]["trades"], got["android"]["volume"]) == (84.0, 3, 60.0)
    perps = {r["platform"]: r for r in rows(P.platform_perps_kpis(t, e))}
    assert perps["ios"] == {"platform": "ios", "volume": 74.0, "orders": 2, "traders": 2, "avg_order": 37.0, "avg_leverage": 3.5}
    none = rows(P.platform_perps_kpis(t, e.where("false")))
    assert [(r["orders"], r["avg_leverage"]) for r in none] == [(0, None), (0, None)]
    sides = [(r["platform"], r["side"]) for r in rows(P.platform_perps_sides(t, e))]
    assert sides == [("android", "long"), ("ios", "Long"), ("ios", "long")]


def test_traders_per_users(frame, make_events, rows):
    e = N.normalize_events(make_events(("2024-01-01T12:00:00", "a", "x"), ("2024-01-01T12:00:00", "q", "x")))
    assert rows(T.trading_snapshot(sample(frame), e))[0] == {"trade_volume": 84.0, "deposit_volume": 100.0, "active_traders": 2, "trader_pct": 100.0}
    assert rows(T.trading_snapshot(sample(frame), e.where("false")))[0]["trader_pct"] == 0.0
