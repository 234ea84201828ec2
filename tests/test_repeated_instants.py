"""Events that share a type and an instant, or lie within half a millisecond of the next minute, against the queries' SQL."""

import duckdb

import __spark_entry__ as entry

ROWS = """SELECT * FROM (VALUES
  (0, TIMESTAMP '2024-01-01 00:00:10.5', 7, 'click', 12.5, '{"k": 3}'), (1, TIMESTAMP '2024-01-01 00:00:10.5', 8, 'click', 70.25, '{"k": 4}'), (2, TIMESTAMP '2024-01-01 00:00:10.5', 9, 'click', 50.0, '{"k": 0}'),
  (3, TIMESTAMP '2024-01-01 00:00:10.5', 7, 'view', 99.75, '{"k": 9}'), (4, TIMESTAMP '2024-01-01 00:00:11', 7, 'view', 1.0, '{"k": 9}'),
  (4, TIMESTAMP '2024-01-01 00:00:11', 7, 'view', 1.0, '{"k": 9}')) t(event_id, ts, user_id, event_type, value, props)"""


def same(spark, folder, name, rows):
    con = duckdb.connect()
    con.execute("create table events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.execute(f"insert into events {rows}")
    con.execute(f"copy events to '{folder}/events.parquet' (format parquet)")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    return len(want)


def test_losses_are_paired_by_event_where_instants_repeat(spark, tmp_path):
    assert same(spark, tmp_path, "paired_losses", ROWS) == 6


def test_losses_of_events_without_a_type_an_instant_or_a_value_are_kept(spark, tmp_path):
    assert same(spark, tmp_path, "paired_losses", ROWS + " UNION ALL VALUES (5, NULL, 7, 'view', 1.0, '{}'), (6, TIMESTAMP '2024-01-01', 7, NULL, 60.0, '{}'), (7, TIMESTAMP '2024-01-01', 7, 'view', NULL, '{}')") == 9


def test_fills_within_half_a_millisecond_of_the_next_minute_or_hour_are_in_it(spark, tmp_path):
    # instants around a half millisecond, on both sides of 1970, and an event that is there twice
    at = ", ".join(f"({8 + k}, make_timestamp({us}), 7, 'click', {k} + 0.25, '{{\"k\": {k}}}')" for k, us in enumerate(b + e for b in (1704067260000000, 1704070800000000, 60000000, 0, -60000000) for e in (-501, -500, -499, -1, 0, 499, 500)))
    assert same(spark, tmp_path, "fill_bars", f"{ROWS} UNION ALL VALUES {at}") == 9
