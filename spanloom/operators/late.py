"""Late and out-of-order events, in SQL only.

A record is a key with an event time and a value, as its latest copy so far tells. Every copy that arrives changes the totals by what it adds and
takes back: the first adds its value to the period of its event; a later one takes the old value from the old period and adds the new
one to its own, in the period in which it arrived. No revision so shows what had not arrived by then.

These changes fall into the cells of a triangle: period of the event by period of the arrival. Summing the cells of an event period along the arrivals
gives every corrected revision of its total. What arrives more than the cut-off after the end of an event period changes no revision of it. As what is
taken back was added earlier, a change that is in time never takes back what was too late to be added.

Of the copies of a key that arrive in one arrival period only the last shows in any revision, so copies are first reduced to that one (before the
shuffle, too: a key that a third of all rows repeat leaves each task once per period). Arrivals exactly at a period's start are kept apart, since the
cut-off is such an instant and belongs to what is in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanloom.functions.event_time import CUTOFF_US, PERIOD_US, event_us_sql
from spanloom.functions.ids import SPAN_DIGITS, TRACE_DIGITS, bits_sql, hex_sql, text_sql

_FIRST = "-9223372036854775808"


def _run(q: str, **tables: DataFrame) -> DataFrame:
    return next(iter(tables.values())).sparkSession.sql(q, **tables)


def span_copies(spans: DataFrame) -> DataFrame:
    """Usable rows of ``spans``: ``src, k1, k2, k3, event_us, arrival_us, value`` (the duration). Rows without ids are left out."""
    return _run(
        f"""
        SELECT 'spans' AS src, {bits_sql('substring(t, 1, 16)')} AS k1, {bits_sql('substring(t, 17, 16)')} AS k2, {bits_sql('s')} AS k3, event_us, arrival_us, value
        FROM (SELECT {text_sql('trace_id', TRACE_DIGITS)} AS t, {text_sql('span_id', SPAN_DIGITS)} AS s, {event_us_sql('start_time')} AS event_us,
                     CAST(arrival AS BIGINT) AS arrival_us, CAST(duration AS BIGINT) AS value, monotonically_increasing_id() AS once
              FROM {{spans}})
        WHERE t IS NOT NULL AND s IS NOT NULL AND once >= 0  -- stays above the mending of ids, which would be done twice below
        """,
        spans=spans,
    )


def span_records(copies: DataFrame) -> DataFrame:
    """One record per span: event time of the valid copy, arrival of the earliest one. A null arrival counts as the earliest for validity."""
    return _run(
        f"""
        SELECT src, k1, k2, k3, max_by(event_us, coalesce(arrival_us, {_FIRST})) AS event_us, min(arrival_us) AS arrival_us
        FROM {{copies}} GROUP BY src, k1, k2, k3
        """,
        copies=copies,
    )


def pending_records(pending: DataFrame) -> DataFrame:
    """One record per pending trace: from its earliest to its latest instant (columns may be exchanged or null); the value is the time between."""
    return _run(
        f"""
        SELECT 'pending_traces' AS src, k1, k2, 0L AS k3, event_us, arrival_us, arrival_us - event_us AS value
        FROM (SELECT {bits_sql('substring(t, 1, 16)')} AS k1, {bits_sql('substring(t, 17, 16)')} AS k2,
                     min(unix_micros(CAST(least(first_seen, last_seen) AS TIMESTAMP))) AS event_us,
                     max(unix_micros(CAST(greatest(first_seen, last_seen) AS TIMESTAMP))) AS arrival_us
              FROM (SELECT {text_sql('trace_id', TRACE_DIGITS)} AS t, first_seen, last_seen FROM {{pending}})
              WHERE t IS NOT NULL GROUP BY 1, 2)
        """,
        pending=pending,
    )


def late_records(records: DataFrame, period_us: int = PERIOD_US, cutoff_us: int = CUTOFF_US) -> DataFrame:
    """``src, trace_id, span_id`` of the records that arrived beyond the cut-off of their period, ids in canonical form.

    Records without event time or arrival are never late; an arrival exactly at the cut-off is in time."""
    return _run(
        f"""
        SELECT src, {hex_sql('k1', 'k2')} AS trace_id, CASE WHEN src = 'spans' THEN {hex_sql('k3')} ELSE '' END AS span_id
        FROM {{records}} WHERE arrival_us > event_us - pmod(event_us, {period_us}) + {period_us + cutoff_us}
        """,
        records=records,
    )


def changes(copies: DataFrame, period_us: int = PERIOD_US, cutoff_us: int = CUTOFF_US) -> DataFrame:
    """What each arrival changes: ``src, period, arrival_period, n, total``, with a sign, those beyond the cut-off left out.

    Copies without an arrival belong to no cell; a copy without event time takes back what its key had added and adds nothing. Null values count as
    zero in ``total``. Of copies that arrive at one instant the one with the latest event time, then the greatest value, counts as the last. Arrivals before
    the event (wrong clocks) are in time and keep their own arrival period. The cut-off is a whole number of periods."""
    return _run(
        f"""
        WITH last AS (
            SELECT src, k1, k2, k3, arrival_us - pmod(arrival_us, {period_us}) AS arrival_period, pmod(arrival_us, {period_us}) > 0 AS inside,
                   max(struct(arrival_us, event_us, value)) AS r
            FROM {{copies}} WHERE arrival_us IS NOT NULL GROUP BY src, k1, k2, k3, arrival_us - pmod(arrival_us, {period_us}), pmod(arrival_us, {period_us}) > 0),
        now AS (
            SELECT src, k1, k2, k3, arrival_period, r.arrival_us AS at, r.event_us - pmod(r.event_us, {period_us}) AS period, coalesce(r.value, 0L) AS value FROM last),
        both AS (
            SELECT *, lag(period) OVER w AS old_period, lag(value) OVER w AS old_value FROM now
            WINDOW w AS (PARTITION BY src, k1, k2, k3 ORDER BY at)),
        signed AS (
            SELECT src, arrival_period, at, explode(filter(
                CASE WHEN period = old_period THEN array(named_struct('period', period, 'n', 0L, 'total', value - old_value))
                     ELSE array(named_struct('period', period, 'n', 1L, 'total', value), named_struct('period', old_period, 'n', -1L, 'total', -old_value)) END,
                x -> x.period IS NOT NULL AND (x.n <> 0 OR x.total <> 0))) AS x
            FROM both)
        SELECT src, x.period AS period, arrival_period, x.n AS n, x.total AS total FROM signed WHERE at <= x.period + {period_us + cutoff_us}
        """,
        copies=copies,
    )


def triangle(changed: DataFrame) -> DataFrame:
    """Cells: ``src, period, arrival_period, n, total`` (map-side combined); a cell whose changes cancel out is none."""
    return _run(
        "SELECT src, period, arrival_period, sum(n) AS n, sum(total) AS total FROM {changed} GROUP BY src, period, arrival_period HAVING sum(n) <> 0 OR sum(total) <> 0", changed=changed
    )


def revisions(cells: DataFrame) -> DataFrame:
    """Each corrected total: ``src, period, arrival_period, revision, n_added, n_so_far, total_so_far, is_final``."""
    return _run(
        """
        SELECT src, period, arrival_period,
               row_number() OVER w AS revision,
               n AS n_added,
               sum(n) OVER w AS n_so_far,
               sum(total) OVER w AS total_so_far,
               lead(arrival_period) OVER (PARTITION BY src, period ORDER BY arrival_period) IS NULL AS is_final
        FROM {cells}
        WINDOW w AS (PARTITION BY src, period ORDER BY arrival_period ROWS UNBOUNDED PRECEDING)
        """,
        cells=cells,
    )
