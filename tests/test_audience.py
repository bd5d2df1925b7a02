import datetime as dt

from pulsegrid.operators import audience as A
from pulsegrid.operators import funnels as U
from pulsegrid.operators import normalize as N
from pulsegrid.operators import retention as R


def ev(make_events, *data):
    return N.real_users(N.normalize_events(make_events(*data)))


def no_identity(frame):
    return frame("wallet string, label string, contact string, login_type string", [])


def test_server_rows_count_only_in_totals(make_events, rows):
    evall = N.normalize_events(make_events(("2024-01-01T12:00:00", "a", "x", "ios"), ("2024-01-01T12:00:00", "server", "x", "ios"),
                                           ("2024-01-01T12:00:00", "b", "x", "server")))
    assert rows(A.event_totals(evall)) == [{"total_events": 3, "unique_users": 1}]


def test_overview_kpis(make_events, rows):
    e = ev(make_events, ("2024-01-01T12:00:00", "a", "session_start"), ("2024-01-01T13:00:00", "b", "session_end", None, '{"duration_ms": 100}'),
           ("2024-01-02T12:00:00", "a", "session_end", None, '{"duration_ms": "999"}'), ("2024-01-02T12:00:00", "a", "session_end", None, '{"duration_ms": 300}'),
           ("2024-01-02T12:00:00", "a", "session_end", None, '{"duration_ms": -5}'), ("bad", "c", "session_start"), ("2024-01-03T12:00:00", None, "x"))
    assert rows(A.overview_kpis(e)) == [{"avg_dau": 1.0, "unique_users": 3, "sessions": 2, "avg_session_ms": 200.0}]
    assert [r["duration_ms"] for r in rows(A.session_durations(e))] == [100.0, 300.0]


def test_empty_input_gives_zeros(make_events, rows, frame):
    e = ev(make_events, ("2024-01-01T12:00:00", "server", "x"))
    assert rows(A.overview_kpis(e)) == [{"avg_dau": 0.0, "unique_users": 0, "sessions": 0, "avg_session_ms": 0.0}]
    assert rows(A.wau_mau(e, "2024-01-30")) == [{"wau": 0, "mau": 0}]
    assert rows(A.events_per_user(e))[0]["events_per_user"] == 0.0
    assert rows(A.new_vs_returning(e, "2024-01-01")) == [{"new_users": 0, "returning_users": 0, "new_pct": 0.0}]
    assert sum(r["events"] for r in rows(A.events_by_hour(e))) == 0 and A.events_by_hour(e).count() == 24
    assert A.dau(e).count() == 0 and R.cohort_retention(e).count() == 0
    assert [r["users"] for r in rows(U.funnel_trade(e))] == [0] * 5
    assert [r["users"] for r in rows(A.platform_kpis(e))] == [0, 0]
    assert A.activity_heatmap(e).count() == 7


def test_wau_mau_bounds_are_inclusive(make_events, rows):
    e = ev(make_events, ("2024-01-23T12:00:00", "a", "x"), ("2024-01-22T12:00:00", "b", "x"), ("2023-12-31T12:00:00", "c", "x"), ("2023-12-30T12:00:00", "d", "x"))
    assert rows(A.wau_mau(e, "2024-01-30")) == [{"wau": 1, "mau": 3}]


def test_leaked_earlier_days_make_returning_users(make_events, rows):
    # Evening of the day before the range, stored in the first UTC partition.
    e = ev(make_events, ("2024-01-08T02:00:00", "a", "x"), ("2024-01-09T12:00:00", "a", "x"), ("2024-01-08T12:00:00", "b", "x"))
    assert rows(A.new_vs_returning(e, dt.date(2024, 1, 8))) == [{"new_users": 1, "returning_users": 1, "new_pct": 50.0}]


def test_concurrent_buckets_in_the_repeated_hour(make_events, rows):
    e = ev(make_events, ("2024-11-03T05:31:00", "a", "x"), ("2024-11-03T06:31:00", "a", "x"), ("2024-11-03T06:32:00", "b", "x"), ("2024-11-03T09:00:00", None, "x"))
    got = rows(A.concurrent_users(e))
    assert [g["viewers"] for g in got] == [1, 2, 0]
    assert [g["time"].hour for g in got] == [1, 1, 4] and got[0]["time"] == got[1]["time"]
    assert [g["viewers_smooth"] for g in got] == [1.5, 1.0, 1.0]


def test_platform_results_ignore_case_and_other_platforms(make_events, rows):
    e = ev(make_events, ("2024-01-01T12:00:00", "a", "x", "iOS"), ("2024-01-02T12:00:00", "a", "y", "ANDROID"), ("2024-01-02T12:00:00", "b", "y", "web"),
           ("2024-01-02T13:00:00", "c", "session_end", "ios", '{"duration_ms": 4000}'))
    assert rows(A.dau_by_platform(e)) == [{"date": dt.date(2024, 1, 1), "ios": 1, "android": 0}, {"date": dt.date(2024, 1, 2), "ios": 1, "android": 1}]
    got = {r["platform"]: r for r in rows(A.platform_kpis(e))}
    assert got["ios"] == {"platform": "ios", "users": 2, "avg_session_s": 4.0, "events_per_user": 1.0, "timed_sessions": 1}
    assert got["android"]["avg_session_s"] == 0.0


def test_ties_are_settled_by_name(make_events, rows):
    e = ev(make_events, *[("2024-01-01T12:00:00", "a", name) for name in "cabdc"])
    assert [r["event"] for r in rows(A.top_events(e, k=3))] == ["c", "a", "b"]


def test_null_keys_are_left_out(make_events, rows, frame):
    e = ev(make_events, ("2024-01-01T12:00:00", None, "x"), ("bad", "a", None))
    assert A.events_by_day(e).count() == 1 and A.top_events(e).count() == 1
    got = rows(A.user_activity(e, no_identity(frame)))
    assert [(g["wallet_address"], g["events"], g["days_active"]) for g in got] == [("a", 0, 0)]


def test_leaderboard_rounds_half_even_and_ranks_rounded(make_events, rows, frame):
    # 0.25 and 0.15 minutes: half-even gives 0.2 for both, so the wallet decides.
    e = ev(make_events, ("2024-01-01T12:00:00", "z", "session_end", None, '{"duration_ms": 15000}'), ("2024-01-01T12:00:00", "a", "session_end", None, '{"duration_ms": 12000}'),
           ("2024-01-01T12:00:00", "m", "session_end", None, '{"duration_ms": 21000}'))
    got = rows(A.time_spent_leaderboard(e, no_identity(frame)))
    assert [(g["wallet_address"], g["total_time_min"]) for g in got] == [("m", 0.4), ("a", 0.2), ("z", 0.2)]


def test_hours_sum_to_rows_with_an_hour(make_events, rows):
    e = ev(make_events, *[(f"2024-01-0{d}T{h:02d}:00:00", "a", "x") for d in (1, 2, 3) for h in (0, 7, 23)], ("bad", "a", "x"))
    assert sum(r["events"] for r in rows(A.events_by_hour(e))) == 9
    assert sum(r["events"] for r in rows(A.events_by_dow(e))) == 9
    assert sum(v for r in rows(A.activity_heatmap(e)) for k, v in r.items() if k.startswith("h")) == 9


def test_user_profile(make_events, rows, frame):
    e = ev(make_events, ("2024-01-01T12:00:00", "a", "session_end", None, '{"duration_ms": 90000}'), ("2024-01-02T12:00:00", "a", "x"), ("2024-01-02T12:00:00", "b", "x"))
    got = rows(A.user_profile(e, no_identity(frame), "a"))[0]
    assert (got["events"], got["days_active"], got["total_min"], got["user_label"]) == (2, 2, 1.5, "a")


def test_retention(make_events, rows):
    days = {"a": [1, 2, 4], "b": [1], "c": [2, 5], "d": [3]}
    e = ev(make_events, *[(f"2024-01-{d:02d}T12:00:00", w, "x") for w, ds in days.items() for d in ds * 2])
    got = rows(R.cohort_retention(e))
    assert [(str(g["cohort"]), g["users"], g["D0"], g["D1"], g["D3"], g["D7"]) for g in got] == [
        ("2024-01-01", 2, 100.0, 50.0, 50.0, 0.0), ("2024-01-02", 1, 100.0, 0.0, 100.0, 0.0), ("2024-01-03", 1, 100.0, 0.0, 0.0, 0.0)]
    curve = {r["day"]: r["retention_pct"] for r in rows(R.retention_curve(e))}
    assert curve[0] == 100.0 and curve[3] == 50.0 and curve[30] == 0.0
    mature = {r["day"]: r["retention_pct"] for r in rows(R.retention_curve(e, mature_only=True))}
    assert mature[3] == 75.0 and mature[30] == 0.0
    assert R.retention_matrix(e).count() == 3
    assert R.retention_matrix(e.where("wallet_address = 'a'")).count() == 0


def test_funnel_needs_no_order(make_events, rows):
    e = ev(make_events, ("2024-01-01T12:00:00", "a", "trade_success"), ("2024-01-02T12:00:00", "a", "buy_button_tap"), ("2024-01-02T12:00:00", "b", "buy_button_tap"),
           ("2024-01-02T12:00:00", "b", "buy_button_tap"), ("2024-01-02T12:00:00", None, "buy_button_tap"))
    got = rows(U.funnel_trade(e))
    assert [g["users"] for g in got] == [2, 0, 0, 1, 0]
    assert [g["pct_of_previous"] for g in got] == [None, 0.0, None, None, 0.0]


def test_providers_and_engagement(make_events, rows):
    e = ev(make_events, ("2024-01-01T12:00:00", "a", "deposit_success", None, '{"provider": "P"}'), ("2024-01-01T12:00:00", "a", "deposit_success", None, '{"provider": ""}'),
           ("2024-01-01T12:00:00", "a", "deposit_error", None, '{"provider": null}'), ("2024-01-01T12:00:00", "a", "search_query"), ("2024-01-01T12:00:00", "b", "search_query"))
    assert rows(U.deposits_by_provider(e)) == [{"provider": "P", "event": "deposit_success", "count": 1}]
    assert rows(U.feature_engagement(e)) == [{"event": "search_query", "total": 2, "users": 2}]
