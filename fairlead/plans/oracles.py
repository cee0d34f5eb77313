"""DuckDB SQL for the registered queries, written on its own from the same definitions."""

from __future__ import annotations

from fairlead.functions.categories import LABELS

_TYPES = "[80, 70, 60, 70, 30, 84, 36, 52, 79, 90, 0, 31]"
_KINDS = "['CloseEncounterEvent', 'CourseOverGroundEvent', 'DriftEvent', 'ShipSizeOrTypeEvent', 'SpeedOverGroundEvent', 'SuddenSpeedChangeEvent']"
_RES = "1.7966313162819712e-3"
_M = "1.1131949e5"
_T, _C, _S = "ShipTypeAndSizeStatistic", "CourseOverGroundStatistic", "SpeedOverGroundStatistic"


def _reports(lat: str, lon: str) -> str:
    return f"""
raw AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, user_id % 7 AS p FROM events),
reports AS (
  SELECT CAST(219000000 + user_id AS INTEGER) AS mmsi, 1704067200000 + 10000 * n + CASE WHEN p = 2 AND n > 30 THEN 3600000 ELSE 0 END AS ts_ms, n AS seq,
         'VESSEL ' || user_id || '@@' AS name, 'CS' || user_id AS callsign, CAST(9000000 + user_id AS INTEGER) AS imo,
         CAST({_TYPES}[user_id % 12 + 1] AS INTEGER) AS ship_type, CAST(5 + user_id * 37 % 150 AS INTEGER) AS to_bow, CAST(5 + user_id * 53 % 120 AS INTEGER) AS to_stern,
         CAST(2 + user_id * 7 % 15 AS INTEGER) AS to_port, CAST(2 + user_id * 11 % 15 AS INTEGER) AS to_starboard,
         CAST({lat} AS DOUBLE) / 1e6 AS lat, CAST({lon} AS DOUBLE) / 1e6 AS lon,
         CAST(CAST(CASE WHEN p = 4 THEN 30 WHEN p = 5 AND n >= 20 THEN 2 WHEN p = 5 THEN 120 WHEN p = 6 AND n % 13 < 8 THEN 350 ELSE 100 + event_id % 30 END AS DOUBLE) / 1e1 AS FLOAT) AS sog,
         CAST(CAST(CASE WHEN p = 4 THEN 900 WHEN p = 3 AND n % 17 < 7 THEN 1800 ELSE event_id % 250 END AS DOUBLE) / 1e1 AS FLOAT) AS cog,
         CAST(CASE WHEN p = 4 THEN 0 ELSE 5 END AS FLOAT) AS hdg
  FROM raw
)"""


_R = _reports(
    "CASE WHEN p = 4 THEN 55000000 + 2000 * (user_id % 10) WHEN p = 5 THEN 55000000 + 2000 * (user_id % 10) + 500 * least(n, 20) ELSE 55000000 + 2000 * (user_id % 10) + 500 * n END",
    "CASE WHEN p = 4 THEN 11000000 + 150 * n ELSE 11000000 + 2000 * (user_id % 4) END",
)
_FLEET = _reports("55000000 + 25000 * (user_id % 12) + 900 * (user_id % 5) + 150 * n", "10700000 + 40000 * (user_id * 7 % 9) + 700 * (user_id % 3)")

_TB = """CASE WHEN {0} IS NULL THEN NULL WHEN {0} BETWEEN 80 AND 89 THEN 1 WHEN {0} BETWEEN 70 AND 79 THEN 2 WHEN {0} BETWEEN 40 AND 49 OR {0} BETWEEN 60 AND 69 THEN 3
  WHEN {0} BETWEEN 31 AND 35 OR {0} BETWEEN 50 AND 55 THEN 4 WHEN {0} = 30 THEN 5 WHEN {0} BETWEEN 36 AND 37 THEN 6 WHEN {0} BETWEEN 1 AND 29 OR {0} BETWEEN 90 AND 99 THEN 7 ELSE 8 END"""
_LB = "CASE WHEN {0} < 0 THEN NULL WHEN {0} < 1 THEN 1 WHEN {0} < 50 THEN 2 WHEN {0} < 100 THEN 3 WHEN {0} < 200 THEN 4 WHEN {0} < 999 THEN 5 END"
_CB = "CAST(floor(CAST({0} % CAST(360 AS FLOAT) AS FLOAT) / CAST(30 AS FLOAT)) AS INTEGER) + 1"
_SB = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} < 0 OR isnan({0}) THEN 8 WHEN {0} < 1 THEN 1 WHEN {0} < 5 THEN 2 WHEN {0} < 10 THEN 3 WHEN {0} < 15 THEN 4 WHEN {0} < 20 THEN 5 WHEN {0} < 30 THEN 6 WHEN {0} < 50 THEN 7 ELSE 8 END"


def _label(kind: str, bucket: str) -> str:
    names = "[" + ", ".join(f"'{x}'" for x in LABELS[kind]) + "]"
    return f"CASE WHEN {bucket} BETWEEN 1 AND {len(LABELS[kind])} THEN {names}[{bucket}] ELSE CAST({bucket} AS VARCHAR) END"


_TRACKS = (
    _R
    + f""",
gaps AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY mmsi ORDER BY ts_ms, seq) > 1800000 THEN 1 ELSE 0 END AS fresh FROM reports),
tracks AS (
  SELECT * EXCLUDE (fresh), CAST(sum(fresh) OVER (PARTITION BY mmsi ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS epoch,
         CAST(floor(lat / {_RES}) AS BIGINT) * 200375 + CAST(floor(lon / {_RES}) AS BIGINT) AS cell_id
  FROM gaps
),
lagged AS (SELECT *, lag(cell_id) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq) AS old_cell_id FROM tracks),
changes AS (SELECT * FROM lagged WHERE old_cell_id IS NULL OR old_cell_id <> cell_id)"""
)

_BUCKETS = f"{_TB.format('ship_type')} AS type_bucket, {_LB.format('(to_bow + to_stern)')} AS size_bucket, {_CB.format('cog')} AS course_bucket, {_SB.format('sog')} AS speed_bucket"


def _stats(source: str = "changes") -> str:
    return f""",
bucketed AS (SELECT *, {_BUCKETS} FROM {source}),
stats AS (
  SELECT '{_T}' AS statistic, cell_id, type_bucket - 1 AS k1, size_bucket - 1 AS k2, CAST(NULL AS INTEGER) AS k3, count(*) AS ship_count FROM bucketed
  WHERE (sog IS NULL OR sog >= 2) AND type_bucket IS NOT NULL AND size_bucket IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT '{_C}', cell_id, type_bucket - 1, size_bucket - 1, course_bucket - 1, count(*) FROM bucketed
  WHERE sog >= 2 AND type_bucket IS NOT NULL AND size_bucket IS NOT NULL AND course_bucket IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT '{_S}', cell_id, type_bucket - 1, size_bucket - 1, speed_bucket - 1, count(*) FROM bucketed
  WHERE sog IS NOT NULL AND type_bucket IS NOT NULL AND size_bucket IS NOT NULL GROUP BY ALL
)"""


_STATS = _TRACKS + _stats()

_STORE = f"""
stored AS (
  SELECT event_id, {_KINDS}[event_id % 6 + 1] AS event_type, CASE WHEN event_id % 5 = 0 THEN 'ONGOING' ELSE 'PAST' END AS state, ts AS start_time,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + to_minutes(CAST(event_id % 120 AS INTEGER)) END AS end_time, event_id % 17 = 0 AS suppressed,
         'Event ' || event_id AS title, 'Event of user ' || user_id AS description
  FROM events
),
parts AS (
  SELECT event_id, ts, user_id AS v, true AS is_primary FROM events UNION ALL SELECT event_id, ts, user_id + 1, false FROM events WHERE event_id % 6 = 0
),
behaviours AS (
  SELECT event_id, CAST(219000000 + v AS INTEGER) AS mmsi, is_primary, CAST(9000000 + v AS INTEGER) AS imo, 'VESSEL ' || v AS name, 'CS' || v AS callsign,
         {_TYPES}[v % 12 + 1] AS ship_type, CAST(10 + v * 37 % 250 AS INTEGER) AS length
  FROM parts
),
points AS (
  SELECT event_id, CAST(219000000 + v AS INTEGER) AS mmsi, ts + to_minutes(CAST(k AS INTEGER)) AS ts, CAST(55000000 + 1000 * (event_id % 500) + 100 * k AS DOUBLE) / 1e6 AS lat,
         CAST(11000000 + 1000 * (v % 300) + 100 * k AS DOUBLE) / 1e6 AS lon, CAST(CAST(100 + event_id % 30 AS DOUBLE) / 1e1 AS FLOAT) AS sog, CAST(event_id % 360 AS FLOAT) AS cog, CAST(event_id % 360 AS FLOAT) AS hdg,
         CAST((event_id + k) % 4 AS INTEGER) AS certainty
  FROM (SELECT *, unnest(generate_series(0, event_id % 3)) AS k FROM parts)
),
lasts AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY event_id, mmsi ORDER BY ts DESC) = 1)"""

ORACLES: dict[str, str] = {}


def _add(name: str, prelude: str, body: str) -> None:
    ORACLES[name] = f"WITH {prelude.lstrip().lstrip(',')}\n{body}"


for _name, _kind, _expr in (
    ("categorize_ship_type", "type", _TB.format("ship_type")),
    ("categorize_length", "size", _LB.format("(to_bow + to_stern)")),
    ("categorize_course", "course", _CB.format("cog")),
    ("categorize_speed", "speed", _SB.format("sog")),
):
    _add(_name, _R, f"SELECT mmsi, ts_ms, bucket, {_label(_kind, 'bucket')} AS label FROM (SELECT mmsi, ts_ms, {_expr} AS bucket FROM reports)")

_add("category_labels", _R + f", bucketed AS (SELECT {_BUCKETS} FROM reports)", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, {k}_bucket AS bucket, {_label(k, k + '_bucket')} AS label, count(*) AS n FROM bucketed WHERE {k}_bucket BETWEEN 1 AND {len(names)} GROUP BY ALL" for k, names in LABELS.items()))

_add("vessel_names", _R, """
SELECT mmsi, ts_ms, t AS trimmed, CASE WHEN t = '' THEN 'MMSI ' || mmsi ELSE t END AS shown, CASE WHEN t = '' THEN 'MMSI ' || mmsi ELSE t || ' (' || mmsi || ')' END AS "full"
FROM (SELECT mmsi, ts_ms, trim(replace(CASE WHEN mmsi % 3 = 0 THEN '@@@' ELSE name END, '@', ' ')) AS t FROM reports)""")  # fmt: skip
_add("composite_keys", _STATS, "SELECT statistic, cell_id, k1 * 60 + k2 * 12 + k3 AS key, k1, k2, k3 FROM stats WHERE k3 IS NOT NULL")

_add("flt_bbox", _R, "SELECT mmsi, ts_ms, lat, lon FROM reports WHERE lat BETWEEN 5.5002e1 AND 5.501e1 AND lon BETWEEN 1.1001e1 AND 1.1005e1")
_add("flt_geomask", _R, """SELECT mmsi, ts_ms, lat, lon FROM reports WHERE NOT (lat BETWEEN 5.5001e1 AND 5.5004e1 AND lon BETWEEN 1.1e1 AND 1.1003e1)
  AND NOT (lat BETWEEN 5.501e1 AND 5.502e1 AND lon BETWEEN 1.1005e1 AND 1.1007e1)""")  # fmt: skip
_add("flt_expression", _R, "SELECT mmsi, ts_ms, sog, ship_type FROM reports WHERE sog > 12 AND ship_type BETWEEN 70 AND 89")
_add("flt_name_skip", _R, "SELECT mmsi, ts_ms, name FROM reports WHERE NOT (trim(replace(name, '@', ' ')) LIKE 'VESSEL 1%' OR trim(replace(name, '@', ' ')) LIKE '%7' OR trim(replace(name, '@', ' ')) LIKE 'VESSEL 2_')")
_add("flt_blacklist", _R, "SELECT mmsi, ts_ms FROM reports WHERE mmsi NOT IN (219000003, 219000008)")
_add("flt_predicates", _R, f"""
SELECT mmsi, ts_ms, coalesce(b = 1, false) AS tanker, coalesce(b = 2, false) AS cargo, coalesce(b = 3, false) AS passenger, coalesce(b = 4, false) AS support, coalesce(b = 5, false) AS fishing,
  coalesce(b = 6, false) AS class_b, coalesce(b = 8, false) AS undefined, coalesce(t BETWEEN 50 AND 55, false) AS special, coalesce(t IN (31, 32), false) AS towing, coalesce(t = 30, false) AS engaged_in_fishing,
  t IS NULL AS unknown, coalesce(s < 3, false) AS slow, coalesce(s > 102, false) AS bad_speed, l >= 30 AS is_long, l >= 75 AS very_long, l < 30 AS small
FROM (SELECT *, {_TB.format('t')} AS b FROM (SELECT mmsi, ts_ms, CASE WHEN ship_type = 90 THEN NULL ELSE ship_type END AS t, CASE WHEN seq % 10 = 0 THEN NULL ELSE sog END AS s, to_bow + to_stern AS l FROM reports))""")
_add("flt_prediction_age", _R, "SELECT mmsi, ts_ms, seq % 11 = 0 OR seq * 20000 > 600000 AS too_old, false AS off FROM reports")
_add("flt_availability", _R, """SELECT mmsi, ts_ms, CASE WHEN seq % 9 = 0 THEN false ELSE sog < 102 END AS sog_ok, seq % 9 <> 0 AS cog_ok, seq % 8 <> 0 AND seq % 7 <> 0 AS hdg_ok FROM reports""")
ORACLES["flt_downsample"] = f"""WITH RECURSIVE {_R},
kept AS (
  SELECT mmsi, min(ts_ms) AS ts_ms FROM reports GROUP BY mmsi
  UNION ALL
  SELECT k.mmsi, (SELECT min(r.ts_ms) FROM reports r WHERE r.mmsi = k.mmsi AND r.ts_ms >= k.ts_ms + 25000) FROM kept k
  WHERE EXISTS (SELECT 1 FROM reports r WHERE r.mmsi = k.mmsi AND r.ts_ms >= k.ts_ms + 25000)
)
SELECT mmsi, ts_ms FROM kept"""
_add("flt_downsample_buckets", _R, "SELECT mmsi, min(ts_ms) AS ts_ms FROM reports GROUP BY mmsi, ts_ms // 60000")

_add("cell_of_position", _TRACKS, f"""
SELECT mmsi, ts_ms, cell_id, round(r * {_RES}, 6) AS south, round((r + 1) * {_RES}, 6) AS north, round(c * {_RES}, 6) AS west, round((c + 1) * {_RES}, 6) AS east
FROM (SELECT *, CAST(floor(lat / {_RES}) AS BIGINT) AS r, CAST(floor(lon / {_RES}) AS BIGINT) AS c FROM tracks)""")
_add("cell_changes", _TRACKS, "SELECT mmsi, epoch, ts_ms, cell_id, old_cell_id FROM changes")
_add("track_epochs", _TRACKS, "SELECT mmsi, epoch, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS n FROM tracks GROUP BY mmsi, epoch")
_add("asof_static", _R + """,
statics AS (SELECT mmsi, ts_ms - 3000 AS at, 'C' || seq AS callsign, CAST(seq AS INTEGER) AS to_bow, ship_type FROM reports WHERE seq % 6 = 2)""",
     "SELECT r.mmsi, r.ts_ms, s.callsign, s.to_bow, s.ship_type FROM reports r ASOF LEFT JOIN statics s ON r.mmsi = s.mmsi AND r.ts_ms >= s.at")
_add("interpolated_reports", _R + """,
marked AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w > 1800000 THEN 1 ELSE 0 END AS fresh FROM reports WINDOW w AS (PARTITION BY mmsi ORDER BY ts_ms)),
epochs AS (SELECT *, sum(fresh) OVER (PARTITION BY mmsi ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS epoch FROM marked),
nexts AS (SELECT *, least(lead(ts_ms) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms) - 1, ts_ms + 1800000) AS stop, lead(ts_ms) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms) AS nxt FROM epochs),
steps AS (SELECT *, unnest(generate_series(ts_ms + 4000, stop, 4000)) AS at_ms FROM nexts WHERE nxt IS NOT NULL AND stop >= ts_ms + 4000),
guessed AS (SELECT *, CAST(sog AS DOUBLE) / 1.9438444924406046e0 * (at_ms - ts_ms) / 1e3 AS way, radians(CAST(cog AS DOUBLE)) AS c FROM steps)""", f"""
SELECT mmsi, ts_ms, false AS interpolated, ts_ms AS last_ais_ms, round(lat, 6) AS lat, round(lon, 6) AS lon FROM nexts
UNION ALL SELECT mmsi, at_ms, true, ts_ms, round(lat + way * cos(c) / {_M}, 6), round(lon + way * sin(c) / ({_M} * cos(radians(lat))), 6) FROM guessed""")  # fmt: skip

for _name, _which in (("stat_type_size", _T), ("stat_course", _C), ("stat_speed", _S)):
    _add(_name, _STATS, f"SELECT * FROM stats WHERE statistic = '{_which}'")
_add("stat_all", _STATS, "SELECT * FROM stats")
_add("stat_merged", _STATS, "SELECT * FROM stats")
_add("stat_totals", _STATS, "SELECT statistic, cell_id, CAST(sum(ship_count) AS BIGINT) AS total FROM stats GROUP BY statistic, cell_id")
_add("stat_sum_over_type", _STATS, "SELECT statistic, cell_id, k2, k3, CAST(sum(CASE WHEN k1 < 7 THEN ship_count ELSE 0 END) AS BIGINT) AS ship_count FROM stats WHERE k3 IS NOT NULL GROUP BY ALL")
_add("stat_probability_table", _STATS, f"""
SELECT t.cell_id, CAST(a AS INTEGER) AS k1, CAST(b AS INTEGER) AS k2, CAST(c AS INTEGER) AS k3, s.ship_count, floor(s.ship_count * 1e2 / t.total * 1e2 + 5e-1) / 1e2 AS percent
FROM (SELECT cell_id, sum(ship_count) AS total FROM stats WHERE statistic = '{_S}' GROUP BY cell_id) t, range(8) x(a), range(5) y(b), range(8) z(c)
LEFT JOIN stats s ON s.statistic = '{_S}' AND s.cell_id = t.cell_id AND s.k1 = a AND s.k2 = b AND s.k3 = c""")
_add("stat_cell_display", _STATS, f"""
SELECT cell_id, type_size, course, speed, round(mean, 6) AS mean, CASE WHEN most >= 30 THEN 2 ELSE 1 END AS stroke, round(5e-2 + least(mean / 5e2, 1e0) * 5e-1, 6) AS opacity
FROM (SELECT *, (type_size + course + speed) / 3e0 AS mean, greatest(type_size, course, speed) AS most FROM (
  SELECT cell_id, CAST(coalesce(sum(ship_count) FILTER (statistic = '{_T}'), 0) AS BIGINT) AS type_size, CAST(coalesce(sum(ship_count) FILTER (statistic = '{_C}'), 0) AS BIGINT) AS course,
         CAST(coalesce(sum(ship_count) FILTER (statistic = '{_S}'), 0) AS BIGINT) AS speed FROM stats GROUP BY cell_id))
WHERE most >= 10""")
_add("stat_reason_counters", _TRACKS + f""",
odd AS (SELECT * REPLACE (CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 5 = 0 THEN CAST(1 AS FLOAT) ELSE sog END AS sog, CASE WHEN seq % 11 = 0 THEN NULL ELSE ship_type END AS ship_type) FROM changes),
b AS (SELECT *, {_BUCKETS} FROM odd)""", f"""
SELECT statistic, reason, count(*) AS n FROM (
  SELECT '{_T}' AS statistic, CASE WHEN sog < 2 THEN 'slow' WHEN type_bucket IS NULL THEN 'unknown type' WHEN size_bucket IS NULL THEN 'unknown length' ELSE 'counted' END AS reason FROM b
  UNION ALL SELECT '{_C}', CASE WHEN sog < 2 THEN 'slow' WHEN sog IS NULL THEN 'unknown speed' WHEN type_bucket IS NULL THEN 'unknown type' WHEN size_bucket IS NULL THEN 'unknown length' ELSE 'counted' END FROM b
  UNION ALL SELECT '{_S}', CASE WHEN sog IS NULL THEN 'unknown speed' WHEN type_bucket IS NULL THEN 'unknown type' WHEN size_bucket IS NULL THEN 'unknown length' ELSE 'counted' END FROM b
) GROUP BY ALL""")  # fmt: skip
_add("stat_nested", _STATS, "SELECT statistic, cell_id, k1 + 1 AS k1, k2 + 1 AS k2, coalesce(k3 + 1, 0) AS k3, ship_count FROM stats")
_add("feed_counters", _TRACKS, "SELECT count(*) AS messages, count(DISTINCT mmsi) AS vessels, count(DISTINCT cell_id) AS cells, round(count(*) * 1e3 / (max(ts_ms) - min(ts_ms)), 6) AS rate FROM tracks")


def _verdicts(statistic: str, over_types: bool = False) -> str:
    third = {_T: None, _C: "course_bucket", _S: "speed_bucket"}[statistic]
    slow = " AND NOT coalesce(sog < 3, false)" if statistic == _C else ""
    match = "s.k2 = b.size_bucket - 1" + ("" if over_types else " AND s.k1 = b.type_bucket - 1") + (f" AND s.k3 = b.{third} - 1" if third else "") + (" AND s.k1 < 7" if over_types else "")
    return f""",
analysed AS (
  SELECT * FROM bucketed
  WHERE NOT (coalesce(type_bucket = 6, false) OR ship_type IS NULL OR coalesce(ship_type BETWEEN 50 AND 55, false) OR coalesce(ship_type IN (31, 32), false) OR coalesce(type_bucket = 5, false))
    AND to_bow + to_stern >= 50 AND size_bucket IS NOT NULL{slow}
),
totals AS (SELECT cell_id, CAST(sum(ship_count) AS BIGINT) AS total FROM stats WHERE statistic = '{statistic}' GROUP BY cell_id),
counted AS (
  SELECT b.*, t.total, CASE WHEN t.total IS NULL THEN NULL ELSE (SELECT CAST(coalesce(sum(s.ship_count), 0) AS BIGINT) FROM stats s WHERE s.statistic = '{statistic}' AND s.cell_id = b.cell_id AND {match}) END AS own
  FROM analysed b LEFT JOIN totals t ON b.cell_id = t.cell_id
),
verdicts AS (SELECT *, coalesce(total > 4 AND CAST(own AS FLOAT) / CAST(total AS FLOAT) < CAST(0.25 AS FLOAT), false) AS abnormal FROM counted)"""


for _name, _which, _over in (("ana_type_size", _T, False), ("ana_course", _C, False), ("ana_course_aggregated", _C, True), ("ana_speed", _S, False), ("ana_speed_aggregated", _S, True)):
    _add(_name, _STATS + _verdicts(_which, _over), "SELECT mmsi, ts_ms, cell_id, total, own, abnormal FROM verdicts")

_STATE_STEPS = """,
turns AS (SELECT *, CASE WHEN abnormal <> lag(abnormal) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq) THEN 1 ELSE 0 END AS turn FROM verdicts),
islands AS (SELECT *, sum(turn) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS island FROM turns),
runs AS (SELECT *, CAST(row_number() OVER (PARTITION BY mmsi, epoch, island ORDER BY ts_ms, seq) AS INTEGER) AS run FROM islands),
fired AS (SELECT *, CASE WHEN abnormal AND run >= 3 THEN true WHEN NOT abnormal AND run >= 5 THEN false END AS fire FROM runs),
held AS (SELECT *, coalesce(last_value(fire IGNORE NULLS) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING), false) AS raised FROM fired),
before AS (SELECT *, coalesce(lag(raised) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq), false) AS was FROM held),
states AS (
  SELECT *, CASE WHEN raised AND NOT was THEN 'RAISE' WHEN raised THEN 'MAINTAIN' WHEN was THEN 'LOWER' END AS transition,
         CASE WHEN raised AND abnormal THEN 3 WHEN raised OR abnormal THEN 2 ELSE 1 END AS certainty FROM before
),
numbered AS (SELECT *, CAST(sum(CASE WHEN transition = 'RAISE' THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS interval FROM states),
spans AS (
  SELECT mmsi, epoch, interval, min(ts_ms) FILTER (transition = 'RAISE') AS start_ms, min(ts_ms) FILTER (transition = 'LOWER') AS lowered, max(ts_ms) AS last_ms, count(*) FILTER (raised) AS n_points
  FROM numbered WHERE interval > 0 AND (raised OR transition = 'LOWER') GROUP BY ALL
),
intervals AS (
  SELECT *, coalesce(lowered, CASE WHEN epoch < max(epoch) OVER (PARTITION BY mmsi) THEN last_ms END) AS end_ms FROM spans
)"""  # fmt: skip
_STATES = _STATS + _verdicts(_S) + _STATE_STEPS


def _id(event_type: str) -> str:
    """SQL for an event's number, by its digest."""
    return f"CAST(CAST('0x' || substr(md5({event_type} || ':' || mmsi || ':' || start_ms), 1, 16) AS UBIGINT) % 9223372036854775808 AS BIGINT)"


_add("hysteresis_state", _STATES, "SELECT mmsi, epoch, ts_ms, abnormal, run, raised FROM states")
_add("hysteresis_transitions", _STATES, "SELECT mmsi, epoch, ts_ms, transition FROM states WHERE transition IS NOT NULL")
_add("event_certainty", _STATES, "SELECT mmsi, epoch, ts_ms, certainty, ['UNDEFINED', 'LOWERED', 'UNCERTAIN', 'RAISED'][certainty + 1] AS label FROM states")
_add("event_intervals", _STATES, f"""
SELECT {_id("'SpeedOverGroundEvent'")} AS event_id, 'SpeedOverGroundEvent' AS event_type, mmsi, epoch, start_ms, end_ms,
  CASE WHEN end_ms IS NULL THEN 'ONGOING' ELSE 'PAST' END AS state, n_points FROM intervals""")  # fmt: skip
_add("event_points", _STATES, "SELECT 'SpeedOverGroundEvent' AS event_type, mmsi, epoch, interval, ts_ms, lat, lon, certainty FROM numbered WHERE interval > 0 AND raised")
_add("event_previous_points", _STATES, """
SELECT 'SpeedOverGroundEvent' AS event_type, i.mmsi, i.epoch, i.interval, s.ts_ms, s.lat, s.lon FROM intervals i JOIN states s ON s.mmsi = i.mmsi AND s.epoch = i.epoch
WHERE s.ts_ms < i.start_ms AND s.ts_ms >= i.start_ms - 300000 AND s.certainty > 0""")  # fmt: skip
_add("event_vessels", _STATES, """
SELECT 'SpeedOverGroundEvent' AS event_type, i.mmsi, i.interval, i.epoch, true AS is_primary, trim(replace(s.name, '@', ' ')) AS name, s.callsign, s.imo, s.ship_type, s.to_bow + s.to_stern AS length
FROM intervals i JOIN states s ON s.mmsi = i.mmsi AND s.ts_ms = i.start_ms""")  # fmt: skip


def _place(x: str, plus: str, minus: str, width: int) -> str:
    t = f"CAST(floor(abs({x}) * 60000 + 5e-1) AS BIGINT)"
    return f"printf('%0{width}d %02d.%03d', {t} // 60000, ({t} % 60000) // 1000, {t} % 1000) || CASE WHEN {x} < 0 THEN '{minus}' ELSE '{plus}' END"


_WHEN = "strftime(make_timestamp({0} * 1000), '%d/%m/%Y %H:%M')"
_add("event_descriptions", _STATES, f"""
SELECT i.mmsi, i.start_ms, 'Abnormal speed over ground' AS title,
  'Abnormal speed over ground of ' || trim(replace(s.name, '@', ' ')) || ' (' || {_label('type', 'type_bucket')} || ') on position (' || {_place('s.lat', 'N', 'S', 2)} || ', ' || {_place('s.lon', 'E', 'W', 3)} || ') at '
  || {_WHEN.format('i.start_ms')} || ': cog:' || CAST(CAST(round_even(CAST(s.cog AS DOUBLE) + 1e-9, 0) AS INTEGER) AS VARCHAR) || '(' || {_label('course', 'course_bucket')} || ') sog:' || printf('%.1f', CAST(s.sog AS DOUBLE)) || '('
  || {_label('speed', 'speed_bucket')} || ') type:' || s.ship_type || '(' || {_label('type', 'type_bucket')} || ') size:' || (s.to_bow + s.to_stern) || '(' || {_label('size', 'size_bucket')} || ').' AS description
FROM intervals i JOIN states s ON s.mmsi = i.mmsi AND s.ts_ms = i.start_ms""")
_add("event_suppress", _STORE, "SELECT suppressed OR event_id IN (3, 5, 8) AS suppressed, count(*) AS n FROM stored GROUP BY 1")
_add("event_upsert", _STORE, """
SELECT event_id, event_type, CASE WHEN event_id % 8 = 0 THEN 'PAST' ELSE state END AS state FROM stored
UNION ALL SELECT event_id + 1000000000, event_type, 'PAST' FROM stored WHERE event_id % 4 = 0 AND event_id % 8 <> 0""")  # fmt: skip
_add("event_involved", _STORE, "SELECT event_id, string_agg(DISTINCT mmsi, ',' ORDER BY mmsi) AS mmsis FROM (SELECT event_id, CAST(mmsi AS VARCHAR) AS mmsi FROM behaviours) GROUP BY event_id")
_add("event_secondary", _STORE, "SELECT event_id, mmsi, name FROM behaviours WHERE NOT is_primary QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY mmsi) = 1")
_add("event_last_point", _STORE, "SELECT event_id, mmsi, ts, lat, lon, certainty FROM lasts")
_D = "7.071067811865476e2"
_EXTENT = f""",
boxes AS (
  SELECT event_id, min(lat) - {_D} / {_M} AS south, max(lat) + {_D} / {_M} AS north, min(lon) - {_D} / ({_M} * cos(radians(max(lat)))) AS west, max(lon) + {_D} / ({_M} * cos(radians(min(lat)))) AS east
  FROM points WHERE certainty IN (2, 3) GROUP BY event_id
)"""
_add("event_extent", _STORE + _EXTENT, "SELECT event_id, round(south, 6) AS south, round(north, 6) AS north, round(west, 6) AS west, round(east, 6) AS east FROM boxes")
_add("kml_window", _STORE + _EXTENT, f"""
SELECT event_id, start_time - to_minutes(15) AS from_time, coalesce(end_time + to_minutes(10), start_time + to_minutes(20)) AS to_time, p AS "primary",
  CASE WHEN event_type = 'CloseEncounterEvent' THEN coalesce(q, '') ELSE '' END AS secondary,
  epoch_us(coalesce(end_time + to_minutes(10), start_time + to_minutes(20))) - epoch_us(start_time - to_minutes(15)) > 21600000000 AS too_long,
  coalesce((north - south) * {_M} * (east - west) * {_M} * cos(radians(south)) / 1e6 > 2500, false) AS too_large
FROM stored JOIN (SELECT event_id, string_agg(DISTINCT CAST(mmsi AS VARCHAR), ',') FILTER (is_primary) AS p, string_agg(DISTINCT CAST(mmsi AS VARCHAR), ',') FILTER (NOT is_primary) AS q FROM behaviours GROUP BY event_id) USING (event_id)
LEFT JOIN boxes USING (event_id)""")


def _turn(a: str, b: str) -> str:
    d = f"((CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)) % 360 + 360) % 360"
    return f"least({d}, 360 - {d})"


_DRIFTING = f"coalesce(sog BETWEEN 1 AND 5 AND {_turn('cog', 'hdg')} > 45 AND {_turn('(cog + 180)', 'hdg')} > 45, false)"


def _rhumb(a: str, b: str, c: str, d: str) -> str:
    chart = lambda x: f"ln(tan(radians({x}) / 2 + 7.853981633974483e-1))"
    psi = f"({chart(c)} - {chart(a)})"
    q = f"(CASE WHEN abs({psi}) > 1e-12 THEN (radians({c}) - radians({a})) / {psi} ELSE cos(radians({a})) END)"
    return f"sqrt(power(radians({c}) - radians({a}), 2) + power({q} * radians({d} - {b}), 2)) * 6.371228e6"


def _drift(period: int, metres: str) -> str:
    return _TRACKS + f""",
flagged AS (SELECT *, {_DRIFTING} AS drifting FROM tracks),
windows AS (
  SELECT *, bool_and(drifting) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms RANGE BETWEEN {period} PRECEDING AND CURRENT ROW) AS drift_period,
         ts_ms - min(ts_ms) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms RANGE BETWEEN 1800000 PRECEDING AND CURRENT ROW) > {period} AS tracked_long,
         sum(CASE WHEN drifting THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS island
  FROM flagged
),
starts AS (SELECT *, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0 FROM windows WINDOW w AS (PARTITION BY mmsi, epoch, island, drifting ORDER BY ts_ms, seq)),
drifts AS (SELECT *, CASE WHEN drifting THEN {_rhumb('lat0', 'lon0', 'lat', 'lon')} END AS drift_metres FROM starts),
sustained AS (SELECT *, coalesce(drift_metres > {metres}, false) AS drift_far, drift_period AND tracked_long AND coalesce(drift_metres > {metres}, false) AS sustained_drift FROM drifts)"""


_add("drift_predicate", _TRACKS, f"SELECT mmsi, ts_ms, {_DRIFTING} AS drifting FROM tracks")
_add("drift_period", _drift(300000, "300"), "SELECT mmsi, ts_ms, drift_period, tracked_long FROM sustained")
_add("drift_distance", _drift(300000, "300"), "SELECT mmsi, ts_ms, round(drift_metres, 3) AS drift_metres, drift_far FROM sustained")
_ORDINARY = f"NOT (coalesce({_TB.format('ship_type')} = 6, false) OR ship_type IS NULL OR coalesce(ship_type BETWEEN 50 AND 55, false) OR coalesce(ship_type IN (31, 32), false))"
_add("ana_drift", _drift(300000, "30") + f""",
kept AS (
  SELECT * FROM sustained WHERE to_bow + to_stern >= 50 AND sog < 102.3 AND cog < 360 AND hdg < 360 AND {_ORDINARY} AND (to_bow + to_stern >= 75 OR {_TB.format('ship_type')} IN (1, 2, 3))
),
runs AS (SELECT *, sum(CASE WHEN drifting THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS run FROM kept),
up AS (SELECT *, drifting AND bool_or(sustained_drift) OVER (PARTITION BY mmsi, epoch, run ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS raised FROM runs),
was AS (SELECT *, coalesce(lag(raised) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq), false) AS before FROM up)""", """
SELECT mmsi, epoch, ts_ms, sustained_drift, raised, CASE WHEN raised AND NOT before THEN 'RAISE' WHEN raised AND sustained_drift THEN 'MAINTAIN' WHEN NOT raised AND before THEN 'LOWER' END AS transition FROM was""")  # fmt: skip

_DROPS = _TRACKS + f""",
low AS (SELECT *, sog <= 1 AS is_low, max(CASE WHEN sog BETWEEN 7 AND CAST(102.2 AS FLOAT) THEN ts_ms END) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS last_high_ms,
        lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(ts_ms) OVER w AS ts1 FROM tracks WINDOW w AS (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq)),
speeds AS (SELECT *, coalesce(is_low AND ts_ms - last_high_ms <= 30000, false) AS sudden, {_rhumb('lat', 'lon', 'lat1', 'lon1')} / ((ts1 - ts_ms) / 1e3) * 1.9438444924406046e0 AS knots FROM low),
drops AS (
  SELECT *, max(sog) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) <= 1 AS low_reported,
         max(knots) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms RANGE BETWEEN 60000 PRECEDING AND 1 PRECEDING) AS calculated_knots
  FROM speeds
)"""
_add("ssc_sudden", _DROPS, "SELECT mmsi, ts_ms, is_low, last_high_ms, sudden FROM drops")
_add("ssc_sustained_reported", _DROPS, "SELECT mmsi, ts_ms, low_reported FROM drops")
_add("ssc_sustained_calculated", _DROPS, "SELECT mmsi, ts_ms, round(calculated_knots, 3) AS calculated_knots, coalesce(calculated_knots <= 1, true) AS low_calculated FROM drops")
_add("ana_sudden_speed_change", _DROPS + f""",
kept AS (SELECT *, sum(CASE WHEN is_low THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS island FROM drops
         WHERE to_bow + to_stern >= 50 AND {_ORDINARY} AND coalesce({_TB.format('ship_type')} <> 5, true)),
seen AS (SELECT *, min(CASE WHEN sudden THEN ts_ms END) OVER (PARTITION BY mmsi, epoch, island, is_low ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS observed FROM kept),
ends AS (
  SELECT mmsi, epoch, island, min(ts_ms) FILTER (observed < ts_ms AND low_reported AND coalesce(calculated_knots <= 1, true)) AS fired_ms, min(ts_ms) AS end_ms, max(last_high_ms) AS start_ms
  FROM seen WHERE is_low GROUP BY ALL
)""", f"""
SELECT e.mmsi, e.start_ms, e.end_ms, e.fired_ms, a.sog AS sog1, b.sog AS sog2, 'Sudden speed change' AS title,
  'Sudden speed change of ' || trim(replace(a.name, '@', ' ')) || ' (' || upper(substr(t, 1, 1)) || substr(t, 2) || ') on position (' || {_place('a.lat', 'N', 'S', 2)} || ', ' || {_place('a.lon', 'E', 'W', 3)} || ') at '
  || {_WHEN.format('e.start_ms')} || ': From ' || printf('%.1f', CAST(a.sog AS DOUBLE)) || ' kts to ' || printf('%.1f', CAST(b.sog AS DOUBLE)) || ' kts in ' || printf('%.1f', (e.end_ms - e.start_ms) / 1e3) || ' secs.' AS description
FROM ends e JOIN (SELECT *, {_label('type', '(' + _TB.format('ship_type') + ')')} AS t FROM tracks) a ON a.mmsi = e.mmsi AND a.ts_ms = e.start_ms JOIN tracks b ON b.mmsi = e.mmsi AND b.ts_ms = e.end_ms
WHERE fired_ms IS NOT NULL""")  # fmt: skip


def _ellipse(l1: str, b1: str, xc: str) -> str:
    return f"""
SELECT mmsi, ts_ms, round(u * cos(r) - v * sin(r), 6) AS x, round(u * sin(r) + v * cos(r), 6) AS y, round(loa * {l1} / 2, 6) AS alpha, round(beam * {b1} / 2, 6) AS beta, round(theta, 6) AS theta
FROM (SELECT *, loa * {xc} - to_stern AS u, to_starboard - beam / 2e0 AS v, radians(theta) AS r FROM (
  SELECT *, CAST(to_bow + to_stern AS DOUBLE) AS loa, CAST(to_port + to_starboard AS DOUBLE) AS beam, (450 - CAST(cog AS DOUBLE)) % 360 AS theta FROM reports))"""


_add("safety_zone", _R, _ellipse("2e0", "3e0", "7.5e-1"))
_add("vessel_extent", _R, _ellipse("1e0", "1e0", "5e-1"))
_add("vessel_center", _R, f"""
SELECT mmsi, ts_ms, round(lat + (u * sin(r) + v * cos(r)) / {_M}, 6) AS lat, round(lon + (u * cos(r) - v * sin(r)) / ({_M} * cos(radians(lat))), 6) AS lon
FROM (SELECT *, (to_bow + to_stern) // 2 - to_stern AS u, (to_port + to_starboard) // 2 - to_starboard AS v, radians((450 - CAST(cog AS DOUBLE)) % 360) AS r FROM reports)""")
_add("geo_measures", _TRACKS + ",\nsteps AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM tracks WINDOW w AS (PARTITION BY mmsi, epoch ORDER BY ts_ms, seq))", f"""
SELECT mmsi, ts_ms, round({_rhumb('a', 'b', 'lat', 'lon')}, 3) AS rhumb,
  round((degrees(atan2(radians(lon - b), ln(tan(radians(lat) / 2 + 7.853981633974483e-1)) - ln(tan(radians(a) / 2 + 7.853981633974483e-1)))) + 360) % 360, 3) AS bearing,
  round(sqrt(power((lon - b) * {_M} * cos(radians(a)), 2) + power((lat - a) * {_M}, 2)), 3) AS plane, round((450 - CAST(cog AS DOUBLE)) % 360, 3) AS from_east, round({_turn('cog', 'hdg')}, 3) AS turn,
  round(1.1113292e5 - 5.5982e2 * cos(2 * radians(lat)) + 1.175e0 * cos(4 * radians(lat)) - 2.3e-3 * cos(6 * radians(lat)), 3) AS degree_north,
  round(1.1141284e5 * cos(radians(lat)) - 9.35e1 * cos(3 * radians(lat)) + 1.18e-1 * cos(5 * radians(lat)), 3) AS degree_east FROM steps""")
_add("ellipse_outline", _R, """
SELECT mmsi, CAST(k AS INTEGER) AS k, round(lat + r * cos(t), 6) AS lat, round(lon + r * sin(t), 6) AS lon FROM (SELECT *, a * b / sqrt(power(b * cos(t), 2) + power(a * sin(t), 2)) AS r FROM (
  SELECT mmsi, lat, lon, k, k * 1e-1 AS t, 1e2 / (1.1113292e5 - 5.5982e2 * cos(2 * radians(lat)) + 1.175e0 * cos(4 * radians(lat)) - 2.3e-3 * cos(6 * radians(lat))) AS a,
    4e1 / (1.1141284e5 * cos(radians(lat)) - 9.35e1 * cos(3 * radians(lat)) + 1.18e-1 * cos(5 * radians(lat))) AS b
  FROM (SELECT mmsi, min(lat) AS lat, min(lon) AS lon FROM reports GROUP BY mmsi), range(63) s(k)))""")  # fmt: skip


def _near(run: int, source: str = "reports") -> str:
    return f""",
later AS (SELECT *, lead(ts_ms) OVER (PARTITION BY mmsi ORDER BY ts_ms, seq) AS nxt FROM {source}),
spread AS (SELECT *, CAST(ceil(ts_ms / {run}e0) AS BIGINT) * {run} AS f, least(coalesce(nxt - 1, ts_ms + 59999), ts_ms + 59999) AS t FROM later),
snaps AS (SELECT *, unnest(generate_series(f, t, {run})) AS run_ms FROM spread WHERE f <= t),
near AS (
  SELECT a.run_ms, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in ('mmsi', 'ts_ms', 'name', 'ship_type', 'to_bow', 'to_stern', 'to_port', 'to_starboard', 'lat', 'lon', 'sog', 'cog', 'hdg'))},
    sqrt(power((b.lon - a.lon) * {_M} * cos(radians(a.lat)), 2) + power((b.lat - a.lat) * {_M}, 2)) AS near_metres
  FROM snaps a JOIN snaps b ON a.run_ms = b.run_ms AND a.mmsi <> b.mmsi AND abs(a.ts_ms - b.ts_ms) < 60000
    AND b.lat BETWEEN a.lat - 2e-2 AND a.lat + 2e-2 AND b.lon BETWEEN a.lon - 5e-2 AND a.lon + 5e-2
  WHERE near_metres < 1852
)"""


_add("nearby_tracks", _FLEET + _near(30000), "SELECT run_ms, a_mmsi, b_mmsi, a_ts_ms, b_ts_ms, round(near_metres, 3) AS near_metres FROM near")
_POLAR = _reports("80000000 + 2500 * (user_id % 12) + 900 * (user_id % 5) + 150 * n", "(179900000 + 40000 * (user_id * 7 % 9) + 7000 * (user_id % 3) + 180000000) % 360000000 - 180000000")
_AROUND = "CASE WHEN b.lon - a.lon > 180 THEN b.lon - a.lon - 360 WHEN b.lon - a.lon < -180 THEN b.lon - a.lon + 360 ELSE b.lon - a.lon END"
_add("nearby_polar", _POLAR + _near(30000).partition("near AS (")[0].rstrip().rstrip(","), f"""
SELECT a.run_ms, a.mmsi AS a_mmsi, b.mmsi AS b_mmsi, round(sqrt(power(({_AROUND}) * {_M} * cos(radians(a.lat)), 2) + power((b.lat - a.lat) * {_M}, 2)), 2) AS near_metres
FROM snaps a JOIN snaps b ON a.run_ms = b.run_ms AND a.mmsi <> b.mmsi AND abs(a.ts_ms - b.ts_ms) < 60000
WHERE sqrt(power(({_AROUND}) * {_M} * cos(radians(a.lat)), 2) + power((b.lat - a.lat) * {_M}, 2)) < 1852""")
_A, _B = _TB.format("a_ship_type"), _TB.format("b_ship_type")
_CANDIDATES = _FLEET + _near(30000) + f""",
candidates AS (
  SELECT * FROM near WHERE ({_A}) <> 4 AND a_ship_type NOT IN (31, 32) AND a_sog <= 102 AND a_sog > 5 AND ({_B}) <> 4 AND b_ship_type NOT IN (31, 32) AND b_sog >= 3 AND b_sog >= 5
    AND NOT (a_to_bow + a_to_stern < 30 AND b_to_bow + b_to_stern < 30) AND NOT (({_A}) = 5 AND ({_B}) = 5) AND NOT (({_A}) = 8 AND ({_B}) = 8)
)"""
_add("encounter_candidates", _CANDIDATES, "SELECT run_ms, a_mmsi, b_mmsi FROM candidates")


def _level(e: str, x: str, y: str) -> str:
    dx, dy = f"({x} - {e}_x)", f"({y} - {e}_y)"
    return f"power(({dx} * cos({e}_r) + {dy} * sin({e}_r)) / {e}_a, 2) + power(({dy} * cos({e}_r) - {dx} * sin({e}_r)) / {e}_b, 2)"


def _inside(e: str, x: str, y: str) -> str:
    return _level(e, x, y) + " <= 1"


def _rim(t: str) -> str:
    """How deep inside the zone a point on the extent's rim lies: the rim is searched in three steps, each 64 times finer."""
    return _level("z", f"(e_x + e_a * cos({t}) * cos(e_r) - e_b * sin({t}) * sin(e_r))", f"(e_y + e_a * cos({t}) * sin(e_r) + e_b * sin({t}) * cos(e_r))")


_WAY = "CAST({0}_sog AS DOUBLE) / 1.9438444924406046e0 * (greatest(a_ts_ms, b_ts_ms) - {0}_ts_ms) / 1e3"
_add("ana_close_encounter", _CANDIDATES + f""",
moved AS (
  SELECT *, a_lat + {_WAY.format('a')} * cos(radians(CAST(a_cog AS DOUBLE))) / {_M} AS pa_lat, a_lon + {_WAY.format('a')} * sin(radians(CAST(a_cog AS DOUBLE))) / ({_M} * cos(radians(a_lat))) AS pa_lon,
    b_lat + {_WAY.format('b')} * cos(radians(CAST(b_cog AS DOUBLE))) / {_M} AS pb_lat, b_lon + {_WAY.format('b')} * sin(radians(CAST(b_cog AS DOUBLE))) / ({_M} * cos(radians(b_lat))) AS pb_lon
  FROM candidates
),
plane AS (
  SELECT *, (pb_lon - pa_lon) * {_M} * cos(radians(pa_lat)) AS off_x, (pb_lat - pa_lat) * {_M} AS off_y, radians((450 - CAST(a_cog AS DOUBLE)) % 360) AS z_r, radians((450 - CAST(b_hdg AS DOUBLE)) % 360) AS e_r,
    CAST(a_to_bow + a_to_stern AS DOUBLE) AS al, CAST(a_to_port + a_to_starboard AS DOUBLE) AS ab, CAST(b_to_bow + b_to_stern AS DOUBLE) AS bl, CAST(b_to_port + b_to_starboard AS DOUBLE) AS bb FROM moved
),
shapes AS (
  SELECT *, (al * 7.5e-1 - a_to_stern) * cos(z_r) - (a_to_starboard - ab / 2) * sin(z_r) AS z_x, (al * 7.5e-1 - a_to_stern) * sin(z_r) + (a_to_starboard - ab / 2) * cos(z_r) AS z_y, al AS z_a, ab * 1.5e0 AS z_b,
    off_x + (bl * 5e-1 - b_to_stern) * cos(e_r) - (b_to_starboard - bb / 2) * sin(e_r) AS e_x, off_y + (bl * 5e-1 - b_to_stern) * sin(e_r) + (b_to_starboard - bb / 2) * cos(e_r) AS e_y, bl / 2 AS e_a, bb / 2 AS e_b FROM plane
),
rim1 AS (SELECT *, list_transform(generate_series(0, 255), lambda k: {_rim('k * 2.454369260617026e-2')}) AS f FROM shapes),
rim2 AS (
  SELECT * EXCLUDE (f), t, list_transform(generate_series(-64, 64), lambda k: {_rim('(t + k * 3.834951969714103e-4)')}) AS f
  FROM (SELECT *, (list_position(f, list_min(f)) - 1) * 2.454369260617026e-2 AS t FROM rim1)
),
rim3 AS (
  SELECT * EXCLUDE (f, t), list_min(list_transform(generate_series(-64, 64), lambda k: {_rim('(t + k * 5.992112452678286e-6)')})) AS least
  FROM (SELECT * EXCLUDE (t), t + (list_position(f, list_min(f)) - 65) * 3.834951969714103e-4 AS t FROM rim2)
),
met AS (SELECT * EXCLUDE (least), ({_inside('e', 'z_x', 'z_y')}) OR ({_inside('z', 'e_x', 'e_y')}) OR least <= 1 AS meets FROM rim3
)""", "SELECT run_ms, a_mmsi, bool_or(meets) AS meets, count(*) AS near FROM met GROUP BY run_ms, a_mmsi")

_MET = ORACLES["ana_close_encounter"].removeprefix("WITH ").rpartition("\nSELECT")[0]
_add("encounter_events", _MET + """,
runs AS (
  SELECT run_ms, a_mmsi AS mmsi, bool_or(meets) AS abnormal, min((near_metres, b_mmsi)) FILTER (meets) AS w FROM met GROUP BY run_ms, a_mmsi
),
was AS (SELECT *, coalesce(lag(abnormal) OVER (PARTITION BY mmsi ORDER BY run_ms), false) AS before FROM runs),
numbered AS (SELECT *, sum(CASE WHEN abnormal AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY run_ms ROWS UNBOUNDED PRECEDING) AS k FROM was),
found AS (
  SELECT mmsi, k, min(run_ms) FILTER (abnormal) AS start_ms, min(run_ms) FILTER (before AND NOT abnormal) AS end_ms, count(*) FILTER (abnormal) AS n_points, arg_min(w, run_ms) FILTER (abnormal) AS w
  FROM numbered WHERE k > 0 AND (abnormal OR before) GROUP BY mmsi, k
)""", f"""
SELECT f.mmsi, m.b_mmsi AS other, f.start_ms, f.end_ms, CASE WHEN f.end_ms IS NULL THEN 'ONGOING' ELSE 'PAST' END AS state, f.n_points,
  round(m.pa_lat + m.z_y / {_M}, 6) AS zone_lat, round(m.pa_lon + m.z_x / ({_M} * cos(radians(m.pa_lat))), 6) AS zone_lon, round(CAST(m.a_cog AS DOUBLE) % 360, 3) AS heading,
  'Close encounter between ' || trim(replace(m.a_name, '@', ' ')) || ' (' || {_label('type', '(' + _A + ')')} || ') and ' || trim(replace(m.b_name, '@', ' ')) || ' (' || {_label('type', '(' + _B + ')')} || ') on '
  || {_WHEN.format('m.a_ts_ms')} || '.' AS description
FROM found f JOIN met m ON m.run_ms = f.start_ms AND m.a_mmsi = f.mmsi AND m.b_mmsi = f.w[2]""")  # fmt: skip
_add("ana_reason_counters", _STATS, " UNION ALL ".join(f"""
SELECT '{s}' AS statistic, CASE WHEN type_bucket = 6 THEN 'class b' WHEN type_bucket = 5 THEN 'fishing'{" WHEN sog < 3 THEN 'slow'" if s == _C else ''} WHEN to_bow + to_stern < 30 THEN 'small' WHEN ship_type BETWEEN 50 AND 55 THEN 'special craft'
  WHEN ship_type IN (31, 32) THEN 'towing' WHEN to_bow + to_stern >= 50 AND size_bucket IS NOT NULL THEN 'analysed' ELSE 'other' END AS reason, count(*) AS n FROM bucketed GROUP BY ALL""" for s in (_C, _S)))

_U = "(({0}_to_bow + {0}_to_stern) // 2 - {0}_to_stern)"
_V = "(({0}_to_port + {0}_to_starboard) // 2 - {0}_to_starboard)"
_H = "radians((450 - CAST({0}_hdg AS DOUBLE)) % 360)"


def _centre(s: str) -> str:
    u, v, h = _U.format(s), _V.format(s), _H.format(s)
    return f"{s}_lat + ({u} * sin({h}) + {v} * cos({h})) / {_M} AS c{s}_lat, {s}_lon + ({u} * cos({h}) - {v} * sin({h})) / ({_M} * cos(radians({s}_lat))) AS c{s}_lon"


_FLOW = _FLEET + f""",
large AS (SELECT * FROM reports WHERE to_bow + to_stern >= 75 AND ({_TB.format('ship_type')}) IN (1, 2) AND lat BETWEEN 54 AND 58 AND lon BETWEEN 7 AND 16 AND sog >= 1)""" + _near(60000, "large") + f""",
centred AS (SELECT *, {_centre('a')}, {_centre('b')} FROM near WHERE {_turn('a_cog', 'b_cog')} < 15),
planes AS (
  SELECT *, (cb_lon - ca_lon) * {_M} * cos(radians(ca_lat)) AS px, (cb_lat - ca_lat) * {_M} AS py, radians((450 - CAST(a_cog AS DOUBLE)) % 360) AS z_r,
    CAST(a_to_bow + a_to_stern AS DOUBLE) AS al, CAST(a_to_port + a_to_starboard AS DOUBLE) AS ab FROM centred
),
ovals AS (
  SELECT *, (al - a_to_stern) * cos(z_r) - (a_to_starboard - ab / 2) * sin(z_r) AS z_x, (al - a_to_stern) * sin(z_r) + (a_to_starboard - ab / 2) * cos(z_r) AS z_y, al * 1e1 AS z_a, ab * 3e1 AS z_b FROM planes
),
flow AS (SELECT * FROM ovals WHERE {_inside('z', 'px', 'py')})"""
_add("free_flow_candidates", _FLOW, f"""
SELECT run_ms, a_mmsi, b_mmsi, round(sqrt(px * px + py * py), 3) AS distance,
  round((degrees(atan2(radians(cb_lon - ca_lon), ln(tan(radians(cb_lat) / 2 + 7.853981633974483e-1)) - ln(tan(radians(ca_lat) / 2 + 7.853981633974483e-1)))) + 360) % 360, 3) AS bearing FROM flow""")
ORACLES["ana_free_flow"] = f"""WITH RECURSIVE {_FLOW.lstrip()},
kept AS (
  SELECT a_mmsi, b_mmsi, min((a_ts_ms, run_ms)) AS k FROM flow GROUP BY a_mmsi, b_mmsi
  UNION ALL
  SELECT a_mmsi, b_mmsi, nk FROM (SELECT k.a_mmsi, k.b_mmsi, (SELECT min((f.a_ts_ms, f.run_ms)) FROM flow f WHERE f.a_mmsi = k.a_mmsi AND f.b_mmsi = k.b_mmsi AND f.a_ts_ms >= k.k[1] + 300000) AS nk FROM kept k) WHERE nk IS NOT NULL
)
SELECT k[2] AS run_ms, a_mmsi, b_mmsi FROM kept"""
_add("free_flow_rows", _FLOW, """
SELECT strftime(make_timestamp(a_ts_ms * 1000), '%Y-%m-%d %H:%M:%S') AS stamp, CAST(a_mmsi AS VARCHAR) AS "MMSI1", trim(replace(a_name, '@', ' ')) AS "NAME1", CAST(a_ship_type AS VARCHAR) AS "TP1",
  CAST(a_to_bow + a_to_stern AS VARCHAR) AS "LOA1", CAST(a_to_port + a_to_starboard AS VARCHAR) AS "BM1", printf('%.4f', ca_lat) AS "LAT1", printf('%.4f', ca_lon) AS "LON1",
  CAST(b_mmsi AS VARCHAR) AS "MMSI2", trim(replace(b_name, '@', ' ')) AS "NAME2", printf('%.4f', cb_lat) AS "LAT2", printf('%.4f', cb_lon) AS "LON2" FROM flow""")  # fmt: skip

_LIVE = "SELECT event_id, event_type, start_time, end_time FROM stored WHERE NOT suppressed"
_FROM, _TO = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-12 00:00:00'"
_WITHIN = f"(start_time >= {_FROM} OR coalesce(end_time >= {_FROM}, false)) AND (start_time <= {_TO} OR coalesce(end_time <= {_TO}, false))"
_BETWEEN = f"(start_time BETWEEN {_FROM} AND {_TO} OR coalesce(end_time BETWEEN {_FROM} AND {_TO}, false))"
_add("qry_event_types", _STORE, "SELECT DISTINCT event_type FROM stored WHERE NOT suppressed")
_add("qry_event_by_id", _STORE, "SELECT event_id, event_type, state, title FROM stored WHERE event_id = 42")
_add("qry_search_time", _STORE, f"{_LIVE} AND {_WITHIN}")
_add("qry_search_type", _STORE, f"{_LIVE} AND event_type = 'DriftEvent'")
_add("qry_search_vessel", _STORE, f"{_LIVE} AND event_id IN (SELECT event_id FROM behaviours WHERE callsign LIKE '%CS1%4%' OR name LIKE '%CS1%4%')")
_add("qry_search_number", _STORE, f"{_LIVE} AND event_id IN (SELECT event_id FROM behaviours WHERE mmsi = 219000007 OR imo = 219000007)")
_add("qry_search_area", _STORE, f"{_LIVE} AND event_id IN (SELECT event_id FROM points WHERE lat > 5.51e1 AND lat < 5.52e1 AND lon > 1.102e1 AND lon < 1.11e1)")
_add("qry_search_all", _STORE, f"""{_LIVE} AND {_WITHIN} AND event_type = 'CloseEncounterEvent' AND event_id IN (SELECT event_id FROM behaviours WHERE name LIKE '%VESSEL%')
  AND event_id IN (SELECT event_id FROM points WHERE lat > 5.5e1 AND lat < 5.54e1 AND lon > 1.1e1 AND lon < 1.12e1)""")
_add("qry_between", _STORE, f"SELECT event_id, start_time, end_time FROM stored WHERE {_BETWEEN}")
_add("qry_recent", _STORE, "SELECT event_id, start_time FROM stored WHERE NOT suppressed ORDER BY start_time DESC, event_id DESC LIMIT 5")
_add("qry_ongoing", _STORE, """SELECT event_id, start_time FROM stored WHERE state = 'ONGOING' AND event_type = 'CloseEncounterEvent'
  AND event_id IN (SELECT event_id FROM behaviours WHERE mmsi = 219000008) ORDER BY start_time, event_id LIMIT 1""")  # fmt: skip
_add("qry_store_search", _STORE, f"{_LIVE} AND {_WITHIN} AND event_id IN (SELECT event_id FROM points WHERE lat > 5.51e1 AND lat < 5.52e1 AND lon > 1.102e1 AND lon < 1.11e1)")
ORACLES["qry_store_ongoing"] = ORACLES["qry_ongoing"]
_add("qry_store_points", _STORE, "SELECT event_id, state, mmsi, points.ts, lat, lon, certainty FROM points JOIN stored USING (event_id) WHERE NOT suppressed")
_ROW, _COL = "(cell_id // 200375)", "(cell_id % 200375)"
_add("qry_cells_in_area", _STATS, f"""SELECT * FROM stats WHERE {_ROW} BETWEEN floor(5.5002e1 / {_RES}) AND floor(5.501e1 / {_RES}) AND {_COL} BETWEEN floor(1.1e1 / {_RES}) AND floor(1.1004e1 / {_RES})""")
_add("qry_cell_ids", _STATS, f"SELECT DISTINCT cell_id FROM stats WHERE statistic = '{_C}'")
_add("qry_cell_statistic", _STATS, f"SELECT * FROM stats WHERE statistic = '{_S}' AND cell_id = 6134162149")
_add("qry_statistic_counts", _STATS, "SELECT statistic, count(DISTINCT cell_id) AS cells FROM stats GROUP BY statistic")
_add("qry_first_cell", _STATS, f"SELECT min(cell_id) AS cell_id FROM stats WHERE statistic = '{_T}'")
ORACLES["qry_missing_statistics"] = "SELECT 'HeadingStatistic' AS statistic"
_add("qry_metadata", _STATS, f"SELECT CAST({_RES} AS DOUBLE) AS grid_resolution, CAST(10 AS INTEGER) AS downsampling, CAST(1 AS SMALLINT) AS format_version, string_agg(DISTINCT statistic, ',' ORDER BY statistic) AS statistics FROM stats")
_add("qry_types_with_counts", _STORE, f"SELECT event_type, count(*) AS n FROM stored WHERE {_BETWEEN} GROUP BY event_type")
_add("qry_report", _STORE, f"""
SELECT s.event_type, s.event_id, printf('%8d %16s %16s %9d %-20s %3d %-9s %7.4f %7.4f %4.1f %5.1f %3.0f', s.event_id, strftime(start_time, '%d/%m/%Y %H:%M'),
  CASE WHEN end_time IS NULL THEN ' ' ELSE strftime(end_time, '%d/%m/%Y %H:%M') END, b.mmsi, b.name, b.length, {_label('type', '(' + _TB.format('b.ship_type') + ')')}, l.lat, l.lon,
  CAST(l.sog AS DOUBLE), CAST(l.cog AS DOUBLE), CAST(l.cog AS DOUBLE)) AS line
FROM stored s JOIN behaviours b ON b.event_id = s.event_id AND b.is_primary JOIN lasts l ON l.event_id = s.event_id AND l.mmsi = b.mmsi WHERE {_BETWEEN}""")
_SUGGEST = """'-start "' || strftime(start_time - to_minutes(10), '%Y-%m-%d-%H:%M') || '" -end "' || strftime(coalesce(end_time + to_minutes(10), start_time + to_minutes(20)), '%Y-%m-%d-%H:%M')
  || '" -exp "m.pos within circle(' || printf('%.4f', l.lat) || ',' || printf('%.4f', l.lon) || ',1000)"'"""
_ISO = "regexp_replace(regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '000$', ''), '\\.(000)?$', '')"


def _side(p: str, b: str, l: str) -> str:
    """A vessel's columns of the event file; all null where there is none."""
    number = lambda c, digits: f"CASE WHEN {c} IS NOT NULL THEN printf('%.{digits}f', CAST({c} AS DOUBLE)) END"
    text = {"Mmsi": f"CAST({b}.mmsi AS VARCHAR)", "Name": f"{b}.name", "Callsign": f"{b}.callsign", "Type": f"CAST({b}.ship_type AS VARCHAR)", "Length": f"CAST({b}.length AS VARCHAR)",
            "Lat": number(f"{l}.lat", 4), "Lon": number(f"{l}.lon", 4), "Sog": number(f"{l}.sog", 1), "Cog": number(f"{l}.cog", 0), "Hdg": number(f"{l}.hdg", 0)}
    return ", ".join(f'{value} AS "{p}{name}"' for name, value in text.items())


_add("csv_event_rows", _STORE, f"""
SELECT CAST(s.event_id AS VARCHAR) AS "eventId", s.event_type AS "eventType", {_ISO.format('start_time')} AS "startTime", {_ISO.format('end_time')} AS "endTime",
  title, description, '[' || p.mmsi || CASE WHEN q.mmsi IS NULL THEN '' ELSE ', ' || q.mmsi END || ']' AS mmsis, {_side('p', 'p', 'l')}, {_side('s', 'q', 'm')}, {_SUGGEST} AS "filterSuggest"
FROM stored s JOIN behaviours p ON p.event_id = s.event_id AND p.is_primary JOIN lasts l ON l.event_id = s.event_id AND l.mmsi = p.mmsi
LEFT JOIN behaviours q ON q.event_id = s.event_id AND NOT q.is_primary LEFT JOIN lasts m ON m.event_id = s.event_id AND m.mmsi = q.mmsi WHERE s.state = 'PAST'""")
_add("filter_suggestion", _STORE, f"SELECT s.event_id, {_SUGGEST} AS suggestion FROM stored s JOIN behaviours p ON p.event_id = s.event_id AND p.is_primary JOIN lasts l ON l.event_id = s.event_id AND l.mmsi = p.mmsi")
ORACLES["date_parameters"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) WHEN event_id % 3 = 1 THEN date_trunc('minute', ts) END AS parsed FROM events"
_add("sentences", _STORE, """SELECT count(*) AS n, event_type, CASE event_type WHEN 'CloseEncounterEvent' THEN 'Close encounter event' WHEN 'CourseOverGroundEvent' THEN 'Course over ground event' WHEN 'DriftEvent' THEN 'Drift event'
  WHEN 'ShipSizeOrTypeEvent' THEN 'Ship size or type event' WHEN 'SpeedOverGroundEvent' THEN 'Speed over ground event' ELSE 'Sudden speed change event' END AS words FROM stored GROUP BY event_type""")

_SPAN = """min(ts_ms) FILTER (transition = 'RAISE') AS start_ms, min(ts_ms) FILTER (transition = 'LOWER') AS lowered, max(ts_ms) AS last_ms"""


def _statistical(which: str, event_type: str, name: str) -> str:
    """Rows of a statistical analysis with their state, and its events."""
    query = f"WITH {(_STATS + _verdicts(which) + _STATE_STEPS).lstrip().lstrip(',')}\nSELECT mmsi, epoch, interval, ts_ms, raised, transition, certainty FROM numbered"
    return f"""
{name}_rows AS MATERIALIZED ({query}),
{name}_spans AS (SELECT mmsi, epoch, interval, {_SPAN} FROM {name}_rows WHERE interval > 0 AND (raised OR transition = 'LOWER') GROUP BY ALL),
{name}_events AS (SELECT *, '{event_type}' AS event_type, coalesce(lowered, CASE WHEN epoch < max(epoch) OVER (PARTITION BY mmsi) THEN last_ms END) AS end_ms FROM {name}_spans),
{name}_points AS (
  SELECT e.event_type, e.mmsi AS "primary", e.start_ms, r.mmsi, r.ts_ms, r.certainty FROM {name}_rows r JOIN {name}_events e USING (mmsi, epoch, interval) WHERE r.raised
  UNION ALL SELECT e.event_type, e.mmsi, e.start_ms, r.mmsi, r.ts_ms, r.certainty FROM {name}_events e JOIN {name}_rows r ON r.mmsi = e.mmsi AND r.epoch = e.epoch AND r.ts_ms < e.start_ms AND r.ts_ms >= e.start_ms - 1800000
)"""


_LEARNED_KINDS = {"speed": (_S, "SpeedOverGroundEvent"), "course": (_C, "CourseOverGroundEvent"), "size": (_T, "ShipSizeOrTypeEvent")}
_VESSEL = f"CAST({_TYPES}[(mmsi - 219000000) % 12 + 1] AS INTEGER) AS ship_type, CAST(10 + (mmsi - 219000000) * 37 % 150 + (mmsi - 219000000) * 53 % 120 AS INTEGER) AS length"
_MEETINGS = f"""
met AS MATERIALIZED (WITH {_MET.lstrip().lstrip(',')} SELECT run_ms, a_mmsi, b_mmsi, meets, near_metres, a_ts_ms, b_ts_ms, a_ship_type, a_to_bow + a_to_stern AS a_length FROM met),
met_runs AS (SELECT run_ms, a_mmsi AS mmsi, bool_or(meets) AS abnormal, min((near_metres, b_mmsi)) FILTER (meets) AS w, max(a_ts_ms) AS a_ts_ms FROM met GROUP BY run_ms, a_mmsi),
met_was AS (SELECT *, coalesce(lag(abnormal) OVER (PARTITION BY mmsi ORDER BY run_ms), false) AS before FROM met_runs),
met_rows AS (SELECT *, sum(CASE WHEN abnormal AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY run_ms ROWS UNBOUNDED PRECEDING) AS k FROM met_was),
met_spans AS (
  SELECT mmsi, k, min(run_ms) FILTER (abnormal) AS start_ms, min(run_ms) FILTER (before AND NOT abnormal) AS end_ms, arg_min(w, run_ms) FILTER (abnormal) AS w FROM met_rows WHERE k > 0 AND (abnormal OR before) GROUP BY mmsi, k
),
met_events AS (
  SELECT 'CloseEncounterEvent' AS event_type, f.mmsi, f.k, f.start_ms, f.end_ms, m.b_mmsi, m.a_ts_ms, m.b_ts_ms, m.a_ship_type AS ship_type, m.a_length AS length
  FROM met_spans f JOIN met m ON m.run_ms = f.start_ms AND m.a_mmsi = f.mmsi AND m.b_mmsi = f.w[2]
),
met_sides AS (SELECT event_type, mmsi AS "primary", start_ms, mmsi, a_ts_ms AS ts_ms FROM met_events UNION ALL SELECT event_type, mmsi, start_ms, b_mmsi, b_ts_ms FROM met_events),
fleet AS (WITH {_FLEET.lstrip().lstrip(',')} SELECT mmsi, ts_ms FROM reports),
met_points AS (
  SELECT event_type, "primary", start_ms, mmsi, ts_ms, max(certainty) AS certainty FROM (
    SELECT *, 3 AS certainty FROM met_sides
    UNION ALL SELECT e.event_type, e.mmsi, e.start_ms, r.mmsi, r.a_ts_ms, 0 FROM met_rows r JOIN met_events e USING (mmsi, k) WHERE r.abnormal AND r.before
    UNION ALL SELECT s.event_type, s."primary", s.start_ms, f.mmsi, f.ts_ms, 0 FROM met_sides s JOIN fleet f ON f.mmsi = s.mmsi AND f.ts_ms < s.ts_ms AND f.ts_ms >= s.ts_ms - 1800000
  ) GROUP BY ALL
)"""
_DETECTED = ",".join(_statistical(which, kind, name) for name, (which, kind) in _LEARNED_KINDS.items()) + f""",
drift AS MATERIALIZED (SELECT *, sum(CASE WHEN transition = 'RAISE' THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi, epoch ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS k FROM ({ORACLES['ana_drift']})),
drift_spans AS (SELECT mmsi, epoch, k, {_SPAN} FROM drift WHERE k > 0 AND (raised OR transition = 'LOWER') GROUP BY mmsi, epoch, k),
drift_events AS (SELECT *, 'DriftEvent' AS event_type, coalesce(lowered, CASE WHEN epoch < max(epoch) OVER (PARTITION BY mmsi) THEN last_ms END) AS end_ms FROM drift_spans),
drift_points AS (SELECT e.event_type, e.mmsi AS "primary", e.start_ms, d.mmsi, d.ts_ms, CASE WHEN d.transition = 'RAISE' THEN 3 ELSE 0 END AS certainty FROM drift d JOIN drift_events e USING (mmsi, epoch, k) WHERE d.transition IN ('RAISE', 'MAINTAIN')),
sudden_events AS (SELECT 'SuddenSpeedChangeEvent' AS event_type, * FROM ({ORACLES['ana_sudden_speed_change']}) QUALIFY row_number() OVER (PARTITION BY mmsi, start_ms ORDER BY fired_ms, end_ms) = 1),
sudden_points AS (SELECT event_type, mmsi AS "primary", start_ms, mmsi, unnest([start_ms, end_ms]) AS ts_ms, 3 AS certainty FROM sudden_events),""" + _MEETINGS
ORACLES["detect_events"] = f"""WITH {_DETECTED}
SELECT {_id('event_type')} AS event_id, event_type, CASE WHEN end_ms IS NULL THEN 'ONGOING' ELSE 'PAST' END AS state, start_ms, end_ms, mmsi, ship_type, length FROM (
""" + " UNION ALL ".join(f"SELECT event_type, mmsi, start_ms, end_ms, {_VESSEL} FROM {name}_events" for name in (*_LEARNED_KINDS, "drift", "sudden")) + """
UNION ALL SELECT event_type, mmsi, start_ms, end_ms, CAST(ship_type AS INTEGER), CAST(length AS INTEGER) FROM met_events)"""
ORACLES["detect_points"] = f"""WITH {_DETECTED}
SELECT {_id('event_type').replace('mmsi', '"primary"')} AS event_id, mmsi, ts_ms, CAST(certainty AS INTEGER) AS certainty FROM (
""" + " UNION ALL ".join(f"SELECT * FROM {name}_points" for name in (*_LEARNED_KINDS, "drift", "sudden", "met")) + ")"
