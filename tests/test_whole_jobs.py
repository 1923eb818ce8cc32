"""Queries that meet all rows with all rows, against DuckDB on the tables themselves: no key may make the job smaller."""

import duckdb

from spanforge.queries.catalogue import QUERIES
from spanforge.queries.views import SESSIONS, TL, with_sql

SF = "/root/testdata/sf0.01"


def duck(sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_crash_reports_of_any_session_are_met(spark):
    want = duck(with_sql(SESSIONS, """SELECT DISTINCT s.session_key FROM sess s JOIN tl r ON r.kind='MetalCbCompleted' AND r.error_code IS NOT NULL AND r.pid=s.kind_pid
      AND r.wall BETWEEN s.a//1000*1000 AND CASE WHEN u%4<>0 THEN s.z//1000*1000+120000000000 WHEN s.session_key LIKE 'post-mortem-%' THEN 9e18::BIGINT ELSE s.z+240000000000 END
      WHERE s.kind='Scoped' AND coalesce(s.exit_code, 1)<>0"""))
    got = QUERIES["d6_crash_report_join"](spark, SF).select("session_key").collect()
    assert sorted(tuple(r) for r in got) == want and len(want) == 80  # 59 with reports of a third of the sessions


def test_slices_hold_events_of_any_session(spark):
    want = duck(with_sql(TL, """SELECT i.session_key || '-' || i.event_ord, e.event_ord FROM tl i JOIN tl e ON e.wall//1000 BETWEEN i.wall//1000-3600000000 AND i.wall//1000
      WHERE i.kind='MetalCbCompleted' AND i.error_code IS NOT NULL"""))
    assert sorted(tuple(r) for r in QUERIES["m12_incident_slices"](spark, SF).select("incident_key", "event_ord").collect()) == want
