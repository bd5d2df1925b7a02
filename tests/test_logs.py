from datetime import datetime, timedelta

import pytest

from pulsegrid.operators import logs as L
from pulsegrid.operators import trades as T
from pulsegrid.plans.base import present

T0 = datetime(2024, 1, 1, 10)
HTTP = '<4>1 2024-01-01T10:00:00Z swap-server-1 http-request 1 http-request - {"statusCode":%s,"path":"%s","method":"GET","responseTimeMS":12,"time":"t1"}'
ORDER = "/order?inputMint=So11111111111111&outputMint=Us222222222222"


def logs(frame, *messages):
    return frame("ts timestamp_ntz, message string", [(T0 + timedelta(minutes=25 * i), m) for i, m in enumerate(messages)])


def test_parse(frame, rows):
    got = rows(L.parse_syslog(logs(frame, HTTP % (502, ORDER), "<3>1 T svc app 1 m - ", "<3>1 T svc short", "free text", None)))
    assert (got[0]["priority"], got[0]["service"], got[0]["status"], got[0]["endpoint"], got[0]["in_mint"], got[0]["out_mint"], got[0]["latency_ms"], got[0]["time"]) == (
        4, "swap-server-1", 502, "order", "So11111111111111", "Us222222222222", 12, "t1")
    assert (got[1]["body"], got[1]["status"], got[1]["service"]) == ("", None, "svc")
    assert (got[2]["body"], got[2]["service"], got[2]["priority"]) == (None, "svc", 3)
    assert set(got[3][k] for k in ("priority", "service", "body", "status")) == {None}
    assert got[4]["body"] is None


def test_errors_keep_lines_without_a_service(frame, rows):
    df = logs(frame, "<3>broken", "<3>1 T svc app 1 m - boom", "<4>1 T svc app 1 m - boom", "<5>1 T svc app 1 m - fine", "no priority")
    assert rows(L.errors_by_service(df)) == [{"service": "svc", "errors": 2}, {"service": None, "errors": 1}]
    assert rows(L.error_banner(df)) == [{"total_errors": 3, "top_service": "svc", "top_errors": 2}]
    assert rows(L.app_error_details(df)) == [{"service": "svc", "detail": "boom", "count": 2}, {"service": None, "detail": None, "count": 1}]
    assert [r["errors"] for r in rows(L.errors_per_hour(df))] == [3]
    assert rows(L.error_banner(df.where("false"))) == [{"total_errors": 0, "top_service": None, "top_errors": None}]


def test_details_merge_and_cleanup(frame, rows):
    long = "x" * 121
    df = logs(frame, HTTP % (400, "/order?a=1"), HTTP % (400, "/order?a=2"), HTTP % (200, "/ok"), HTTP % (404, "?odd"), "<3>1 T svc app 1 m - " + long, "<3>broken")
    got = [(r["detail"], r["count"]) for r in rows(L.top_error_messages(df))]
    assert got[0] == ("HTTP 400 /order", 2)
    assert sorted(got[1:]) == [("(unstructured)", 1), ("(unstructured)", 1), ("x" * 120 + "...", 1)]
    assert len(rows(L.top_error_messages(df, k=2))) == 2


def test_swap_failures(frame, rows):
    df = logs(frame, HTTP % (499, ORDER), HTTP % (499, ORDER), HTTP % (400, "/quote"), HTTP % (399, ORDER), (HTTP % (500, ORDER)).replace("swap-server-1", "other"))
    got = rows(L.swap_http_errors(df))
    assert [(g["status"], g["endpoint"], g["count"], g["label"]) for g in got] == [
        (499, "order", 2, "HTTP 499 /order → Us2222...2222"), (400, "quote", 1, "HTTP 400 /quote")]
    recent = rows(L.swap_recent_failures(df))
    assert [r["status"] for r in recent] == [400, 499, 499]
    assert (recent[1]["in_mint"], recent[1]["out_mint"], recent[0]["out_mint"]) == ("So1111...1111", "Us2222...2222", None)
    assert sum(r["errors"] for r in rows(L.swap_errors_per_hour(df))) == 3


def test_recent_errors_are_the_newest(frame, rows):
    df = logs(frame, *[f"<3>1 T{i} svc app 1 m - e{i}" for i in range(5)], "<6>1 T svc app 1 m - no")
    assert [r["body"] for r in rows(L.recent_errors(df, k=2))] == ["e4", "e3"]


def test_keywords_in_any_case(frame, rows):
    df = logs(frame, "an Exception", "FATAL", "econnrefused", "fine", "crashed")
    assert rows(L.keyword_errors_total(df)) == [{"errors": 4}]
    hours = [r["hour"] for r in rows(L.keyword_errors_per_hour(df))]
    assert hours == sorted(hours, reverse=True)


def test_scraper(frame, rows):
    line = "<6>1 T twitter-scraper app 1 m - >>> "
    df = logs(frame, line + "SIGNAL: ABC BUY", line + "SIGNAL: ABC BUY", line + "SIGNAL: oops", line + "Not tradable", line + "Written to sheet", line + "Else", "other >>> SIGNAL: X BUY")
    assert rows(L.scraper_outcomes(df)) == [
        {"outcome": "SIGNAL:", "label": "Signals Generated", "count": 3}, {"outcome": "Not", "label": "Rejected (Not Tradable)", "count": 1},
        {"outcome": "Written", "label": "Written to DB/Sheet", "count": 1}]
    assert [(r["label"], r["count"]) for r in rows(L.scraper_signals(df))] == [("ABC BUY", 2), ("? ", 1)]


def test_search_combines_filters(frame, rows):
    df = logs(frame, "<3>1 T payments a 1 m - Timeout 500", "<3>1 T payments a 1 m - panic 500", "<3>1 T other a 1 m - panic 500", "<3>1 T payments a 1 m - fine 500")
    pick = lambda **kw: [r["message"].split(" - ")[1] for r in rows(L.log_search(df, **kw))]
    assert pick() == ["fine 500", "panic 500", "panic 500", "Timeout 500"]
    assert pick(service="payments", level="errors only") == ["panic 500"]
    assert pick(service="payments", level="warnings+", text="5.0") == ["panic 500", "Timeout 500"]
    assert pick(k=1) == ["fine 500"]


def test_totals_and_lists_cover_everything(frame, rows):
    line = "<3>1 2024-01-01T00:00:00 svc{i:02} proc 1 id - app failure {i}"
    df = frame("ts timestamp_ntz, message string", [(datetime(2024, 1, 1), line.format(i=i)) for i in range(40)] * 1 + [(datetime(2024, 1, 1), line.format(i=39))])
    assert rows(L.error_banner(df)) == [{"total_errors": 41, "top_service": "svc39", "top_errors": 2}]
    assert len(rows(L.top_error_messages(df))) == 25 and len(rows(L.top_error_messages(df, k=100))) == 40


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_hours_do_not_depend_on_the_session_zone(spark, frame, rows, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [datetime(2024, 3, 10, h, 30) for h in (1, 2, 3)] + [datetime(2024, 11, 3, h, 30) for h in (0, 1, 2, 5, 6)]
        df = frame("ts timestamp_ntz, message string", [(t, "<3>1 t swap-server-1 p 1 i - error") for t in times])
        assert [(r["hour"], r["errors"]) for r in rows(L.errors_per_hour(df))] == [(t.replace(minute=0), 1) for t in times]
        shown = [r["t"] for r in rows(df.select(T.local_time_text("ts").alias("t")))]
        assert shown == [t.strftime("%b %d, %I:%M %p") for t in times]
        assert [r["ts"] for r in rows(present(df.select("ts"), {}))] == [t.strftime("%Y-%m-%d %H:%M:%S.000000") for t in times]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
