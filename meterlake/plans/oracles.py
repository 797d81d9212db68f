"""The same queries as SQL for another engine, on the same tables.

The estate's derivations are common table expressions in front of every query;
only those that a query uses are evaluated.
"""

from __future__ import annotations

from ..config import OPERATING_MODES, RANGES

_AMBIENT = ("temperature", "humidity", "pressure", "vibration")

_PARTS = {
    "site": "SELECT 'SITE-' || r_regionkey AS site_id, r_name AS site_name, r_name || ' City' AS city, r_name AS country FROM region",
    "building": "SELECT 'BLD-' || n_nationkey AS building_id, n_name AS building_name, 'SITE-' || n_regionkey AS site_id, CAST(2500 + 900 * n_nationkey AS DOUBLE) AS floor_area_sqm, CASE n_nationkey % 3 WHEN 0 THEN 'Office' WHEN 1 THEN 'Hospital' ELSE 'Plant' END AS building_type FROM nation",
    "register": """
      SELECT c_custkey AS asset_no, 'AST-' || c_custkey AS asset_id, c_name AS asset_name, c_mktsegment AS asset_type, 'MFR-' || c_custkey % 7 AS manufacturer, 'M' || c_custkey % 5 AS model,
             DATE '2015-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS installation_date, 1 + abs(c_acctbal) / 100 AS rated_power_kw, 'BLD-' || c_nationkey AS building_id,
             CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN 'AST-GHOST' ELSE 'AST-' || CAST(floor((c_custkey - 1) / 4) AS BIGINT) END AS parent_asset_id, site_id
      FROM customer LEFT JOIN building ON building_id = 'BLD-' || c_nationkey""",
    "asset": """
      SELECT r.asset_id, upper(r.asset_name) AS upper_name, r.asset_name, r.asset_type, r.manufacturer, r.model, r.installation_date, r.rated_power_kw, r.site_id, r.building_id, p.asset_id AS parent_asset_id,
             r.parent_asset_id IS NOT NULL AND p.asset_id IS NULL AS is_orphan, r.parent_asset_id IS NULL AS is_root
      FROM register r LEFT JOIN register p ON p.asset_id = r.parent_asset_id""",
    "telemetry": """
      SELECT 'AST-' || user_id AS asset_id, 'SEN-' || user_id || '-' || event_id % 2 AS sensor_id, ts, 15 + value / 23 AS temperature, 30 + (event_id % 40) / 1.3::DOUBLE AS humidity, 200 + (event_id % 100) / 0.7::DOUBLE AS pressure,
             (event_id % 50) / 7.0::DOUBLE AS vibration, value / 0.7::DOUBLE AS power_consumption,
             CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'BOOST' WHEN 'click' THEN 'IDLE' WHEN 'signup' THEN 'STANDBY' WHEN 'error' THEN 'FAULT' END AS operating_mode,
             CAST(ts AS DATE) + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS ingest_date, r.site_id, r.building_id
      FROM events JOIN register r ON r.asset_no = user_id""",
    "event": """
      SELECT CAST(event_id AS VARCHAR) AS event_id, 'AST-' || user_id AS asset_id, ts, CASE event_type WHEN 'error' THEN 'Fault' WHEN 'click' THEN 'Alarm' WHEN 'view' THEN 'Warning' ELSE 'Info' END AS event_type,
             CASE WHEN value < 20 THEN 'Low' WHEN value < 80 THEN 'Medium' ELSE 'High' END AS severity, json_extract_string(props, '$.k') AS message, r.site_id, r.building_id
      FROM events JOIN register r ON r.asset_no = user_id""",
    "raw0": """
      SELECT CASE WHEN event_id % 101 = 0 THEN 'not-a-timestamp' WHEN event_id % 103 = 0 THEN '1970-01-01T00:00:00Z' WHEN event_id % 107 = 0 THEN '' WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS raw_ts,
             CASE WHEN event_id % 101 = 0 OR (event_id % 107 = 0 AND event_id % 103 <> 0) THEN NULL WHEN event_id % 103 = 0 THEN TIMESTAMP '1970-01-01' ELSE CAST(date_trunc('second', ts) AS TIMESTAMP) END AS ts,
             CASE WHEN event_id % 73 = 0 THEN 'SITE-X' ELSE r.site_id END AS site_id, CASE WHEN event_id % 79 = 0 THEN NULL ELSE r.building_id END AS building_id,
             CASE WHEN event_id % 109 = 0 THEN NULL WHEN event_id % 113 = 0 THEN 'UNREGISTERED-' || event_id ELSE 'AST-' || user_id END AS asset_id, 'SEN-' || user_id || '-' || event_id % 2 AS sensor_id,
             CASE WHEN event_id % 53 = 0 THEN 9999.99::DOUBLE WHEN event_id % 59 = 0 OR event_id % 61 = 0 THEN NULL ELSE 15.5::DOUBLE + event_id % 25 END AS temperature,
             CASE WHEN event_id % 67 = 0 THEN -50::DOUBLE ELSE 30::DOUBLE + event_id % 40 END AS humidity, 200::DOUBLE + event_id % 100 AS pressure, (event_id % 50)::DOUBLE AS vibration, (event_id % 500)::DOUBLE AS power_consumption,
             CASE WHEN event_id % 71 = 0 THEN 'WEIRD' ELSE CASE event_type WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'BOOST' WHEN 'click' THEN 'IDLE' WHEN 'signup' THEN 'STANDBY' WHEN 'error' THEN 'FAULT' END END AS operating_mode,
             CAST(events.ts AS DATE) + CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS ingest_date, event_id AS landing_no, r.site_id AS register_site
      FROM events JOIN register r ON r.asset_no = user_id""",
    "raw": "SELECT * FROM raw0 UNION ALL SELECT * REPLACE (landing_no + 1000000000 AS landing_no) FROM raw0 WHERE landing_no % 83 = 0",
    "prepared": """
      SELECT *, asset_id IS NOT NULL AND NOT starts_with(asset_id, 'UNREGISTERED') AS known, date_diff('day', CAST(ts AS DATE), ingest_date) * 86400 AS lateness,
             CASE WHEN asset_id IS NULL OR sensor_id IS NULL OR ts IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY asset_id, sensor_id, ts ORDER BY landing_no) END AS dup_rank,
             CASE WHEN asset_id IS NOT NULL AND NOT starts_with(asset_id, 'UNREGISTERED') THEN register_site END AS known_site
      FROM raw""",
    "merged": "SELECT site_id, building_id, asset_id, ts, avg(temperature) AS temperature, avg(humidity) AS humidity, avg(pressure) AS pressure, avg(vibration) AS vibration, avg(power_consumption) AS power_kw, min(operating_mode) AS operating_mode, count(*) AS sensor_readings FROM telemetry GROUP BY ALL",
    "reading": """
      SELECT *, power_kw * duration_hours AS energy_kwh, CAST(ts AS DATE) AS event_date, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS event_hour FROM (
        SELECT *, least(coalesce((epoch_us(lead(ts) OVER (PARTITION BY asset_id ORDER BY ts)) - epoch_us(ts)) / 1e6, 43200.0), 86400.0) / 3600 AS duration_hours FROM merged)""",
    "hourly": "SELECT site_id, building_id, asset_id, event_date, event_hour, sum(energy_kwh) AS energy_kwh, avg(power_kw) AS avg_power_kw, max(power_kw) AS peak_power_kw, min(power_kw) AS min_power_kw, round(sum(duration_hours), 4) AS coverage_hours, count(*) AS readings FROM reading GROUP BY ALL",
    "utilization": """
      SELECT *, 100 * productive_hours / nullif(observed_hours, 0) AS utilization_pct, (1 - downtime_hours / nullif(observed_hours, 0)) * 100 AS availability_pct, least(observed_hours / 24, 1.0::DOUBLE) * 100 AS data_coverage_pct FROM (
        SELECT site_id, building_id, asset_id, event_date, sum(duration_hours) AS observed_hours, sum(CASE WHEN operating_mode IN ('RUNNING', 'BOOST') THEN duration_hours ELSE 0 END) AS productive_hours,
               sum(CASE WHEN operating_mode IN ('OFF', 'FAULT', 'MAINTENANCE') THEN duration_hours ELSE 0 END) AS downtime_hours, sum(energy_kwh) AS energy_kwh, avg(power_kw) AS avg_power_kw, max(power_kw) AS peak_power_kw, count(DISTINCT operating_mode) AS modes_seen, count(*) AS readings
        FROM reading GROUP BY ALL)""",
    "environment": "SELECT *, coalesce(avg_temperature BETWEEN 18 AND 27 AND avg_humidity BETWEEN 30 AND 65, FALSE) AS thermal_comfort_ok FROM (SELECT asset_id, event_date, " + ", ".join(f"avg({m}) AS avg_{m}, min({m}) AS min_{m}, max({m}) AS max_{m}, stddev_samp({m}) AS stddev_{m}, quantile_disc({m}, 0.95) AS p95_{m}" for m in _AMBIENT) + " FROM reading GROUP BY ALL)",
    "event_count": "SELECT asset_id, CAST(ts AS DATE) AS event_date, count(*) AS events, count(*) FILTER (event_type = 'Fault') AS faults, count(*) FILTER (event_type = 'Alarm') AS alarms, count(*) FILTER (event_type = 'Warning') AS warnings, count(*) FILTER (severity = 'High') AS high_severity_events FROM event GROUP BY ALL",
    "asset_daily": "SELECT u.*, e.avg_temperature, e.avg_humidity, e.thermal_comfort_ok, coalesce(c.events, 0) AS events, coalesce(c.faults, 0) AS faults, coalesce(c.alarms, 0) AS alarms, coalesce(c.warnings, 0) AS warnings, coalesce(c.high_severity_events, 0) AS high_severity_events FROM utilization u LEFT JOIN environment e USING (asset_id, event_date) LEFT JOIN event_count c USING (asset_id, event_date)",
    "building_daily": """
      SELECT d.*, b.building_name, b.building_type, CASE WHEN b.floor_area_sqm > 0 THEN d.energy_kwh / b.floor_area_sqm END AS energy_per_sqm FROM (
        SELECT site_id, building_id, event_date, count(DISTINCT asset_id) AS reporting_assets, sum(energy_kwh) AS energy_kwh, avg(utilization_pct) AS utilization_pct, avg(availability_pct) AS availability_pct,
               avg(data_coverage_pct) AS data_coverage_pct, avg(avg_temperature) AS avg_temperature, max(peak_power_kw) AS peak_power_kw,
               sum(events)::BIGINT AS events, sum(faults)::BIGINT AS faults, sum(alarms)::BIGINT AS alarms, sum(warnings)::BIGINT AS warnings, sum(high_severity_events)::BIGINT AS high_severity_events
        FROM asset_daily GROUP BY ALL) d LEFT JOIN building b USING (building_id)""",
    "site_sum": "SELECT site_id, event_date, count(DISTINCT building_id) AS buildings, avg(avg_temperature) AS avg_temperature, sum(reporting_assets)::BIGINT AS reporting_assets, sum(energy_kwh) AS energy_kwh, max(peak_power_kw) AS peak_power_kw, avg(data_coverage_pct) AS data_coverage_pct, sum(events)::BIGINT AS events, sum(faults)::BIGINT AS faults, sum(alarms)::BIGINT AS alarms, sum(warnings)::BIGINT AS warnings, sum(high_severity_events)::BIGINT AS high_severity_events FROM building_daily GROUP BY ALL",
    "site_daily": """
      SELECT s.*, site_name, city, country, CASE WHEN baseline_stddev > 0 THEN (energy_kwh - baseline_kwh) / baseline_stddev END AS energy_zscore, CASE WHEN baseline_kwh > 0 THEN (energy_kwh - baseline_kwh) / baseline_kwh * 100 END AS pct_vs_baseline FROM (
        SELECT *, avg(energy_kwh) OVER w AS baseline_kwh, stddev_samp(energy_kwh) OVER w AS baseline_stddev FROM site_sum
        WINDOW w AS (PARTITION BY site_id ORDER BY event_date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) s LEFT JOIN site USING (site_id)""",
    "fault": """
      SELECT *, round(faults / observed_days, 3) AS faults_per_day, CASE WHEN faults > 1 THEN round((epoch_us(last_fault_at) - epoch_us(first_fault_at)) / 1e6 / 3600 / (faults - 1), 2) END AS mtbf_hours, CASE WHEN health_score >= 80 THEN 'Low' WHEN health_score >= 50 THEN 'Medium' ELSE 'High' END AS risk_band FROM (
        SELECT *, greatest(0.0::DOUBLE, round(100 - (5.0::DOUBLE * faults + alarms + 0.25::DOUBLE * warnings), 2)) AS health_score FROM (
          SELECT asset_id, count(*) AS total_events, count(*) FILTER (event_type = 'Fault') AS faults, count(*) FILTER (event_type = 'Alarm') AS alarms, count(*) FILTER (event_type = 'Warning') AS warnings, count(*) FILTER (event_type = 'Info') AS infos,
                 count(*) FILTER (severity = 'High') AS high_severity_events, min(ts) FILTER (event_type = 'Fault') AS first_fault_at, max(ts) FILTER (event_type = 'Fault') AS last_fault_at, count(DISTINCT CAST(ts AS DATE)) AS days_with_events, CAST(greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)), 1) AS INTEGER) AS observed_days
          FROM event GROUP BY asset_id))""",
    "walk": """
      SELECT asset_id AS ancestor_id, asset_id AS descendant_id, 0 AS depth, asset_id AS path FROM asset
      UNION ALL
      SELECT w.ancestor_id, a.asset_id, w.depth + 1, w.path || ' > ' || a.asset_id FROM walk w JOIN asset a ON a.parent_asset_id = w.descendant_id WHERE w.depth < 12 AND a.asset_id <> w.ancestor_id""",
    "closure": "SELECT DISTINCT * FROM walk",
    "hier": """
      SELECT a.asset_id, asset_name, asset_type, site_id, building_id, parent_asset_id, is_orphan, is_root, u.depth AS level, u.ancestor_id AS root_asset_id, u.path AS hierarchy_path, d.descendant_count, d.child_count, d.child_count = 0 AS is_leaf,
             d.child_count = 0 AND parent_asset_id IS NULL AS is_disconnected,
             CASE WHEN is_orphan THEN 'ORPHANED' WHEN building_id IS NULL THEN 'UNASSIGNED' WHEN d.child_count = 0 AND parent_asset_id IS NULL THEN 'STANDALONE' ELSE 'CONNECTED' END AS connectivity_status
      FROM asset a
      JOIN (SELECT *, row_number() OVER (PARTITION BY descendant_id ORDER BY depth DESC, ancestor_id DESC) AS rn FROM closure) u ON u.descendant_id = a.asset_id AND u.rn = 1
      JOIN (SELECT ancestor_id, count(DISTINCT CASE WHEN depth > 0 THEN descendant_id END) AS descendant_count, count(*) FILTER (depth = 1) AS child_count FROM closure GROUP BY ancestor_id) d ON d.ancestor_id = a.asset_id""",
    "edge": """
      SELECT site_id AS source_id, building_id AS target_id, 'CONTAINS' AS edge_type FROM building
      UNION ALL SELECT building_id, asset_id, 'CONTAINS' FROM asset WHERE parent_asset_id IS NULL AND building_id IS NOT NULL
      UNION ALL SELECT parent_asset_id, asset_id, 'FEEDS' FROM asset WHERE parent_asset_id IS NOT NULL""",
    # every node has one parent here, so its component is that of its root
    "node": "SELECT site_id AS node_id FROM site UNION ALL SELECT building_id FROM building UNION ALL SELECT asset_id FROM asset",
    "climb": "SELECT node_id, node_id AS top FROM node UNION ALL SELECT c.node_id, e.source_id FROM climb c JOIN edge e ON e.target_id = c.top",
    "component": "SELECT r.node_id, min(m.node_id) AS component_id FROM (SELECT node_id, top FROM climb WHERE top NOT IN (SELECT target_id FROM edge)) r JOIN (SELECT node_id, top FROM climb WHERE top NOT IN (SELECT target_id FROM edge)) m USING (top) GROUP BY r.node_id",
}
_WITH = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in _PARTS.items())


def _rules() -> list[tuple[str, str, str, float, str]]:
    """Id, dimension, severity, threshold and failing condition of the telemetry rules."""
    rows = [("tel.completeness.timestamp_not_null", "completeness", "BLOCKING", 0.05, "ts IS NULL")]
    rows += [(f"tel.completeness.{k}_not_null", "completeness", "BLOCKING", 0.05, f"{k} IS NULL") for k in ("asset_id", "site_id", "building_id")]
    rows += [(f"tel.completeness.{m}_present", "completeness", "WARN", 0.05, f"{m} IS NULL") for m in (*RANGES, "operating_mode")]
    rows += [("tel.uniqueness.business_key", "uniqueness", "BLOCKING", 0.05, "dup_rank > 1")]
    rows += [("tel.validity.timestamp_parseable", "validity", "BLOCKING", 0.02, "ts IS NULL")]
    rows += [("tel.validity.timestamp_plausible", "validity", "BLOCKING", 0.02, "ts < TIMESTAMP '2000-01-01' OR ts > TIMESTAMP '2024-02-01'")]
    rows += [("tel.validity.operating_mode_enum", "validity", "WARN", 0.01, f"operating_mode NOT IN {OPERATING_MODES}")]
    rows += [(f"tel.accuracy.{m}_in_range", "accuracy", "BLOCKING", 0.02, f"{m} < {a} OR {m} > {b}") for m, (a, b) in RANGES.items()]
    rows += [("tel.consistency.asset_registered", "consistency", "BLOCKING", 0.02, "NOT known")]
    rows += [("tel.consistency.site_matches_register", "consistency", "WARN", 0.005, "site_id <> known_site")]
    rows += [("tel.timeliness.late_arrival", "timeliness", "WARN", 0.05, "lateness >= 86400")]
    return rows


_RESULTS = " UNION ALL ".join(
    f"SELECT '{i}' AS rule_id, '{d}' AS dimension, '{s}' AS severity, count(*) AS evaluated, count(*) FILTER (coalesce({c}, FALSE)) AS failed, round(count(*) FILTER (coalesce({c}, FALSE)) / count(*), 6) AS failure_rate, {t}::DOUBLE AS threshold, round(count(*) FILTER (coalesce({c}, FALSE)) / count(*), 6) <= {t} AS passed FROM prepared"
    for i, d, s, t, c in _rules()
)


def _failed(severity: str, without: tuple[str, ...] = ()) -> str:
    """A list of the ids of a row's failed rules, in order."""
    cases = ", ".join(f"CASE WHEN coalesce({c}, FALSE) THEN '{i}' END" for i, _, s, _, c in _rules() if s == severity and i not in without)
    return f"array_to_string(list_sort(list_filter([{cases}], lambda x: x IS NOT NULL)), ',')"


_STREAM = ("tel.uniqueness.business_key", "tel.timeliness.late_arrival")
_EVENT_RULES = [
    *(("completeness", k, s, 0.05) for k, s in (("timestamp_not_null", "BLOCKING"), ("event_id_not_null", "BLOCKING"), ("asset_id_not_null", "BLOCKING"), ("event_type_not_null", "BLOCKING"), ("severity_not_null", "BLOCKING"), ("message_present", "WARN"))),
    ("uniqueness", "event_id", "BLOCKING", 0.05),
    *(("validity", k, "BLOCKING", t) for k, t in (("event_type_enum", 0.01), ("severity_enum", 0.01), ("timestamp_parseable", 0.02), ("timestamp_plausible", 0.02))),
    ("consistency", "asset_registered", "BLOCKING", 0.02),
    ("timeliness", "late_arrival", "WARN", 0.05),
]
#: The event log has no defects but perhaps a null message, a double id, or a type outside the contract.
_EVENT_FAILS = {"message_present": "message IS NULL OR trim(message) = ''", "event_id": "rn > 1"}
_EVENT_RESULTS = " UNION ALL ".join(
    f"SELECT 'evt.{d}.{k}' AS rule_id, '{d}' AS dimension, '{s}' AS severity, count(*) AS evaluated, count(*) FILTER (coalesce({_EVENT_FAILS.get(k, 'FALSE')}, FALSE)) AS failed, round(count(*) FILTER (coalesce({_EVENT_FAILS.get(k, 'FALSE')}, FALSE)) / count(*), 6) AS failure_rate, {t}::DOUBLE AS threshold, round(count(*) FILTER (coalesce({_EVENT_FAILS.get(k, 'FALSE')}, FALSE)) / count(*), 6) <= {t} AS passed FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn FROM event)"
    for d, k, s, t in _EVENT_RULES
)
_PLAIN = "landing_no % 89 <> 0"
_STREAM_CLEAN = f"SELECT DISTINCT site_id, building_id, asset_id, sensor_id, ts, temperature, operating_mode, power_consumption FROM prepared WHERE {_PLAIN} AND {_failed('BLOCKING', _STREAM)} = ''"
_HOURS = "(epoch_us(anchor) - epoch_us(last_at)) / 3.6e9"
_ROUND5 = lambda *names: ", ".join(f"round({n}, 5) AS {n}" for n in names)
_ROUND4 = lambda *names: ", ".join(f"round({n}, 4) AS {n}" for n in names)
_COUNTS = "events, faults, alarms, warnings, high_severity_events"

_SELECTS = {
    "cast_telemetry": "SELECT landing_no, ts AS timestamp, site_id, building_id, asset_id, sensor_id, temperature, humidity, pressure, vibration, power_consumption, operating_mode, known AS _asset_known, lateness AS _lateness_seconds, coalesce(lateness >= 86400, FALSE) AS _is_late, CAST(dup_rank AS INTEGER) AS _dup_rank FROM prepared",
    "parse_timestamps": "SELECT CASE WHEN raw_ts = '' THEN 'empty' WHEN ts IS NULL THEN 'unparseable' WHEN contains(raw_ts, 'T') THEN 'iso' ELSE 'spaced' END AS kind, count(*) AS n, min(ts) AS first, max(ts) AS last FROM prepared GROUP BY 1",
    "clean_strings": "SELECT operating_mode, asset_id IS NULL AS no_asset, building_id IS NULL AS no_building, count(*) AS n FROM prepared GROUP BY ALL",
    "conform_assets": "SELECT asset_id, asset_name, asset_type, manufacturer, model, installation_date, site_id, building_id, parent_asset_id, is_orphan, is_root, round(rated_power_kw, 5) AS rated_power_kw FROM asset",
    "dq_rule_results": _RESULTS,
    "dq_event_rule_results": _EVENT_RESULTS,
    "dq_quarantine": f"SELECT landing_no, {_failed('BLOCKING')} AS reasons FROM prepared WHERE {_failed('BLOCKING')} <> ''",
    "dq_warnings": f"SELECT landing_no, {_failed('WARN')} AS warnings FROM prepared WHERE {_failed('BLOCKING')} = '' AND {_failed('WARN')} <> ''",
    "dq_by_dimension": f"SELECT dimension, count(*) AS rules, sum(failed)::BIGINT AS failed, count(*) FILTER (NOT passed) AS breached FROM ({_RESULTS}) GROUP BY dimension",
    "quarantine_reasons": f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({_failed('BLOCKING')}, ',')) AS reason FROM prepared WHERE {_failed('BLOCKING')} <> '') GROUP BY reason",
    "dedupe_first_wins": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1",
    "late_arrivals": "SELECT coalesce(lateness >= 86400, FALSE) AS _is_late, lateness AS _lateness_seconds, count(*) AS n FROM prepared GROUP BY ALL",
    "robust_outliers": """
      SELECT asset_id, sensor_id, ts AS timestamp, power_consumption, round(z, 5) AS robust_z FROM (
        SELECT *, CASE WHEN mad > 0 THEN 0.6745 * (power_consumption - m) / mad ELSE 0 END AS z FROM (
          SELECT *, median(abs(power_consumption - m)) OVER (PARTITION BY asset_id, sensor_id) AS mad FROM (SELECT *, median(power_consumption) OVER (PARTITION BY asset_id, sensor_id) AS m FROM telemetry)))
      WHERE abs(z) > 6""",
    "freshness": "SELECT asset_id, max(ts) AS last_reading_at, count(*) AS readings, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 60e6, 5) AS lag_minutes, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 60e6 > 1440 AS is_stale FROM telemetry GROUP BY asset_id",
    "completeness": "SELECT asset_id, sensor_id, CAST(ts AS DATE) AS event_date, count(*) AS received, 2::BIGINT AS expected, greatest(2 - count(*), 0) AS missing, least(count(*) / 2, 1.0) * 100 AS completeness_pct FROM telemetry GROUP BY 1, 2, 3",
    "readings_weighted": f"SELECT site_id, building_id, asset_id, ts AS timestamp, operating_mode, sensor_readings, {_ROUND5('temperature', 'power_kw', 'duration_hours', 'energy_kwh')}, event_date FROM reading",
    "fact_energy_hourly": f"SELECT site_id, building_id, asset_id, event_date, event_hour, {_ROUND5('energy_kwh', 'avg_power_kw', 'peak_power_kw', 'min_power_kw')}, coverage_hours, readings FROM hourly",
    "dim_date": """
      SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS full_date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, CAST(weekofyear(d) AS INTEGER) AS iso_week,
             CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name, dayofweek(d) IN (0, 6) AS is_weekend,
             CAST(CASE WHEN month(d) >= 4 THEN year(d) + 1 ELSE year(d) END AS INTEGER) AS fiscal_year, CAST(floor(((month(d) + 8) % 12) / 3) + 1 AS INTEGER) AS fiscal_quarter
      FROM (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE))::TIMESTAMP, max(CAST(ts AS DATE))::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM telemetry)""",
    "dim_time": "SELECT CAST(i AS INTEGER) AS time_key, CAST(i // 60 AS INTEGER) AS hour, CAST(i % 60 AS INTEGER) AS minute, lpad(CAST(i // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(i % 60 AS VARCHAR), 2, '0') AS hh_mm, CASE WHEN i < 360 THEN 'Night' WHEN i < 720 THEN 'Morning' WHEN i < 1080 THEN 'Afternoon' ELSE 'Evening' END AS day_part, i // 60 BETWEEN 8 AND 19 AS is_business_hours FROM range(1440) t(i)",
    "dim_site": "SELECT * FROM site",
    "dim_building": "SELECT b.*, s.site_name, s.city, s.country, CASE WHEN floor_area_sqm < 5000 THEN 'Small' WHEN floor_area_sqm < 15000 THEN 'Medium' ELSE 'Large' END AS size_band FROM building b LEFT JOIN site s USING (site_id)",
    "scd2_dim_asset": """
      SELECT asset_id, building_id, round(date_diff('day', installation_date, CAST(valid_from AS DATE)) / 365.25, 2) AS age_years, TRUE AS keyed, 1::BIGINT AS same_content, valid_from, valid_to, valid_to IS NULL AS is_current FROM (
        SELECT asset_id, installation_date, building_id, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN no % 10 = 0 THEN TIMESTAMP '2024-02-01' END AS valid_to FROM (SELECT *, CAST(substr(asset_id, 5) AS BIGINT) AS no FROM asset) WHERE no % 20 <> 7
        UNION ALL SELECT asset_id, installation_date, CASE WHEN no % 10 = 0 THEN building_id || '-B' ELSE building_id END, TIMESTAMP '2024-02-01', NULL FROM (SELECT *, CAST(substr(asset_id, 5) AS BIGINT) AS no FROM asset) WHERE no % 20 = 7 OR no % 10 = 0)""",
    "fact_telemetry": "SELECT site_id, building_id, asset_id, sensor_id, ts AS timestamp, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS time_key, temperature, humidity, pressure, vibration, power_consumption, operating_mode, ingest_date > CAST(ts AS DATE) AS is_late, CAST(ts AS DATE) AS event_date, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS event_hour FROM telemetry",
    "fact_event": "SELECT event_id, asset_id, site_id, building_id, ts AS timestamp, event_type, severity, message, event_type = 'Fault' AS is_fault, CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS severity_rank, CAST(ts AS DATE) AS event_date FROM event",
    "hourly_energy_mart": """
      SELECT * EXCLUDE (kwh, day), round(kwh, 5) AS energy_kwh, round(day, 5) AS prev_day_kwh, CASE WHEN day > 0 THEN round((kwh - day) / day * 100, 2) END AS dod_change_pct FROM (
      SELECT asset_id, event_hour, energy_kwh AS kwh, lag(energy_kwh, 24) OVER (PARTITION BY asset_id ORDER BY event_hour) AS day,
             round(avg(energy_kwh) OVER (PARTITION BY asset_id ORDER BY event_hour RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING), 5) AS rolling_24h_avg_kwh FROM hourly)""",
    "daily_utilization": f"SELECT site_id, building_id, asset_id, event_date, {_ROUND5('observed_hours', 'productive_hours', 'downtime_hours', 'energy_kwh', 'avg_power_kw', 'peak_power_kw', 'utilization_pct', 'availability_pct', 'data_coverage_pct')}, modes_seen, readings FROM utilization",
    "daily_environment": f"SELECT asset_id, event_date, {_ROUND5(*(f'{k}_{m}' for m in _AMBIENT for k in ('avg', 'min', 'max', 'stddev', 'p95')))}, thermal_comfort_ok FROM environment",
    "fault_statistics": "SELECT * FROM fault",
    "agg_asset_daily": f"SELECT asset_id, event_date, {_ROUND5('energy_kwh', 'peak_power_kw', 'utilization_pct')}, thermal_comfort_ok, {_COUNTS} FROM asset_daily",
    "agg_building_daily": f"SELECT site_id, building_id, building_name, building_type, event_date, reporting_assets, {_ROUND5('energy_kwh', 'utilization_pct', 'availability_pct', 'avg_temperature', 'peak_power_kw', 'energy_per_sqm')}, {_COUNTS} FROM building_daily",
    "agg_site_daily": f"SELECT site_id, site_name, event_date, buildings, reporting_assets, {_ROUND4('energy_kwh', 'avg_temperature', 'peak_power_kw', 'baseline_kwh', 'energy_zscore', 'pct_vs_baseline')}, coalesce(energy_zscore > 2, FALSE) AS is_energy_anomaly, {_COUNTS} FROM site_daily",
    "machine_health": """
      SELECT s.asset_id, s.asset_type, s.site_id, s.readings, round(s.t, 5) AS avg_temperature, round(s.v, 5) AS avg_vibration, round(s.v / nullif(n.v, 0), 5) AS vibration_vs_normal, round(s.t - n.t, 5) AS temperature_above_normal,
             CASE WHEN s.v > 2 * n.v THEN 'UNHEALTHY' WHEN s.v > 1.4 * n.v THEN 'WATCH' ELSE 'OK' END AS health
      FROM (SELECT r.asset_id, asset_type, a.site_id, count(*) AS readings, avg(temperature) AS t, avg(vibration) AS v FROM reading r JOIN asset a USING (asset_id) GROUP BY ALL) s
      JOIN (SELECT asset_type, avg(v) AS v, avg(t) AS t FROM (SELECT asset_id, asset_type, avg(temperature) AS t, avg(vibration) AS v FROM reading JOIN asset USING (asset_id) GROUP BY ALL) GROUP BY asset_type) n USING (asset_type)""",
    "asset_closure": "SELECT * FROM closure",
    "asset_closure_recursive": "SELECT ancestor_id, descendant_id, depth FROM closure",
    "asset_hierarchy": "SELECT * FROM hier",
    "site_assets": "SELECT site_id, building_id, asset_id, asset_name, asset_type, level, hierarchy_path, child_count, descendant_count, connectivity_status FROM hier WHERE site_id = 'SITE-1'",
    "parent_children": """
      SELECT relationship, n.asset_id, asset_name, asset_type, level FROM (
        SELECT 'parent' AS relationship, ancestor_id AS asset_id FROM closure WHERE depth = 1 AND descendant_id = 'AST-3'
        UNION ALL SELECT 'child', descendant_id FROM closure WHERE depth = 1 AND ancestor_id = 'AST-3') n JOIN hier USING (asset_id)""",
    "downstream_impact": "SELECT c.depth AS hops, descendant_id AS impacted_asset_id, asset_name, asset_type, building_id, path AS impact_path, faults, health_score, risk_band FROM closure c JOIN hier h ON h.asset_id = c.descendant_id LEFT JOIN fault f ON f.asset_id = c.descendant_id WHERE ancestor_id = 'AST-3' AND c.depth > 0",
    "critical_assets": """
      SELECT asset_id, asset_name, asset_type, site_id, blast_radius, max_depth, downstream_faults FROM (
        SELECT ancestor_id AS asset_id, count(*) AS blast_radius, max(depth) AS max_depth, sum(coalesce(faults, 0))::BIGINT AS downstream_faults FROM closure LEFT JOIN fault ON fault.asset_id = descendant_id WHERE depth > 0 GROUP BY 1) JOIN hier USING (asset_id)
      ORDER BY blast_radius DESC, downstream_faults DESC, asset_id LIMIT 10""",
    "orphans": "SELECT asset_id, asset_name, asset_type, site_id, building_id, connectivity_status FROM hier WHERE is_orphan",
    "disconnected": "SELECT connectivity_status, count(*) AS assets, string_agg(asset_id, ', ' ORDER BY asset_id) AS asset_ids FROM hier WHERE is_disconnected OR is_orphan OR building_id IS NULL GROUP BY connectivity_status",
    "subtree_energy": """
      SELECT asset_id, asset_name, asset_type, round(kwh, 5) AS subtree_energy_kwh, n AS assets_in_subtree FROM (
        SELECT ancestor_id AS asset_id, sum(kwh) AS kwh, count(*) AS n FROM closure JOIN (SELECT asset_id, sum(energy_kwh) AS kwh FROM hourly GROUP BY 1) e ON e.asset_id = descendant_id GROUP BY 1) JOIN hier USING (asset_id)
      ORDER BY round(kwh, 5) DESC, asset_id LIMIT 15""",
    "graph_edges": "SELECT * FROM edge",
    "components": "SELECT * FROM component",
    "topology_report": """
      SELECT count(*) AS nodes, sum(o)::BIGINT AS edges, count(*) FILTER (i = 0 AND o > 0) AS roots, count(*) FILTER (o = 0 AND i > 0) AS leaves, count(*) FILTER (i = 0 AND o = 0) AS isolated, count(*) FILTER (i > 1) AS multi_parent,
             (SELECT count(DISTINCT component_id) FROM component) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM component GROUP BY component_id)) AS largest_component, (SELECT max(depth) FROM closure) AS max_depth, 0::BIGINT AS cycle_edges, count(*) FILTER (i > 1) = 0 AS is_forest
      FROM (SELECT node_id, (SELECT count(*) FROM edge WHERE target_id = node_id) AS i, (SELECT count(*) FROM edge WHERE source_id = node_id) AS o FROM node)""",
    "q1_top_energy_assets": """
      SELECT CAST(row_number() OVER (ORDER BY kwh DESC, asset_id) AS INTEGER) AS rank, asset_id, asset_name, asset_type, manufacturer, site_id, building_id, rated_power_kw, round(kwh, 4) AS total_energy_kwh, round(kwh / days, 4) AS avg_daily_kwh, round(peak, 4) AS peak_power_kw,
             round(100 * mean / nullif(rated_power_kw, 0), 4) AS load_factor_pct, round(100 * kwh / (SELECT sum(energy_kwh) FROM hourly), 4) AS energy_share_pct
      FROM (SELECT asset_id, sum(energy_kwh) AS kwh, avg(avg_power_kw) AS mean, max(peak_power_kw) AS peak, count(DISTINCT event_date) AS days FROM hourly GROUP BY 1) LEFT JOIN asset USING (asset_id) ORDER BY kwh DESC, asset_id LIMIT 10""",
    "q2_daily_energy_by_site": """
      SELECT site_id, site_name, city, country, count(*) AS active_days, any_value(n)::INTEGER AS calendar_days, round(sum(energy_kwh), 4) AS total_energy_kwh, round(avg(energy_kwh), 4) AS avg_kwh_per_active_day, round(sum(energy_kwh) / any_value(n), 4) AS avg_kwh_per_calendar_day,
             round(avg(energy_kwh) FILTER (dayofweek(event_date) IN (0, 6)), 4) AS avg_weekend_kwh, round(avg(energy_kwh) FILTER (dayofweek(event_date) NOT IN (0, 6)), 4) AS avg_weekday_kwh, round(min(energy_kwh), 4) AS min_daily_kwh, round(max(energy_kwh), 4) AS max_daily_kwh,
             round(stddev_samp(energy_kwh) / nullif(avg(energy_kwh), 0), 4) AS daily_cv
      FROM site_daily, (SELECT date_diff('day', min(event_date), max(event_date)) + 1 AS n FROM site_daily) GROUP BY site_id, site_name, city, country""",
    "q3_frequent_faults": """
      SELECT asset_id, asset_name, asset_type, site_id, building_id, fault_count, high_severity_faults, alarm_count, warning_count, days_with_faults, first_fault_at, last_fault_at, round((epoch_us(last_fault_at) - epoch_us(first_fault_at)) / 3.6e9 / (fault_count - 1), 4) AS mtbf_hours, connectivity_status, descendant_count AS assets_downstream
      FROM (SELECT asset_id, count(*) FILTER (event_type = 'Fault') AS fault_count, count(*) FILTER (event_type = 'Fault' AND severity = 'High') AS high_severity_faults, count(*) FILTER (event_type = 'Alarm') AS alarm_count, count(*) FILTER (event_type = 'Warning') AS warning_count,
                   count(DISTINCT CAST(ts AS DATE)) FILTER (event_type = 'Fault') AS days_with_faults, min(ts) FILTER (event_type = 'Fault') AS first_fault_at, max(ts) FILTER (event_type = 'Fault') AS last_fault_at
            FROM event WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) - 30 FROM event) GROUP BY 1) LEFT JOIN hier USING (asset_id) WHERE fault_count > 10""",
    "q4_silent_assets": f"""
      SELECT asset_id, asset_name, asset_type, site_id, building_id, connectivity_status, last_at AS last_reading_at, lifetime_readings, sensors_seen, round({_HOURS}, 4) AS hours_since_last_reading, CASE WHEN last_at IS NULL THEN 'NEVER_REPORTED' ELSE 'SILENT' END AS status
      FROM (SELECT h.*, s.* EXCLUDE (asset_id), (SELECT max(ts) FROM telemetry) AS anchor FROM hier h LEFT JOIN (SELECT asset_id, max(ts) AS last_at, count(*) AS lifetime_readings, count(DISTINCT sensor_id) AS sensors_seen FROM telemetry GROUP BY 1) s USING (asset_id))
      WHERE (last_at IS NOT NULL OR is_leaf) AND (last_at IS NULL OR {_HOURS} > 24)""",
    "q5_building_utilization": """
      SELECT h.site_id, building_id, building_name, building_type, event_hour, CAST(event_hour AS DATE) AS event_date, CAST(hour(event_hour) AS INTEGER) AS hour_of_day, reporting_assets, round(o, 5) AS observed_asset_hours, round(p, 5) AS productive_asset_hours, round(100 * p / o, 4) AS utilization_pct,
             round(100 * (1 - d / o), 4) AS availability_pct, round(kwh, 4) AS energy_kwh, round(mean, 4) AS avg_power_kw, round(peak, 4) AS peak_power_kw, round(100 * o / reporting_assets, 4) AS data_coverage_pct
      FROM (SELECT site_id, building_id, event_hour, count(DISTINCT asset_id) AS reporting_assets, sum(duration_hours) AS o, sum(CASE WHEN operating_mode IN ('RUNNING', 'BOOST') THEN duration_hours ELSE 0 END) AS p,
                   sum(CASE WHEN operating_mode IN ('OFF', 'FAULT', 'MAINTENANCE') THEN duration_hours ELSE 0 END) AS d, sum(energy_kwh) AS kwh, avg(power_kw) AS mean, max(power_kw) AS peak FROM reading GROUP BY ALL) h LEFT JOIN building USING (building_id)""",
    "q6_site_power_anomalies": """
      SELECT site_id, site_name, city, event_date, round(energy_kwh, 4) AS energy_kwh, round(b, 4) AS baseline_kwh, n AS baseline_days, round(z, 4) AS energy_zscore, round(p, 4) AS pct_vs_baseline, round(w, 4) AS pct_vs_same_weekday, round(peak_power_kw, 4) AS peak_power_kw,
             CASE WHEN z >= 3 THEN 'CRITICAL' WHEN z >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS anomaly_severity, CASE WHEN z >= 2 AND w >= 20 THEN 'both_detectors' WHEN z >= 2 THEN 'zscore_vs_baseline' ELSE 'week_over_week' END AS detected_by
      FROM (SELECT *, CASE WHEN sd > 0 THEN (energy_kwh - b) / sd END AS z, CASE WHEN b > 0 THEN 100 * (energy_kwh - b) / b END AS p, CASE WHEN wk > 0 THEN 100 * (energy_kwh - wk) / wk END AS w
            FROM (SELECT *, avg(energy_kwh) OVER r AS b, stddev_samp(energy_kwh) OVER r AS sd, count(*) OVER r AS n, lag(energy_kwh, 7) OVER (PARTITION BY site_id ORDER BY event_date) AS wk
                  FROM site_daily WHERE data_coverage_pct >= 80 WINDOW r AS (PARTITION BY site_id ORDER BY event_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)))
      WHERE n >= 3 AND ((z >= 2 AND p >= 10) OR w >= 20)""",
    "v_site_energy_daily": f"SELECT site_id, site_name, city, event_date, {_ROUND4('energy_kwh', 'baseline_kwh', 'energy_zscore', 'data_coverage_pct')}, coalesce(energy_zscore > 2, FALSE) AS is_energy_anomaly FROM site_daily",
    "v_asset_health": "SELECT asset_id, faults, alarms, high_severity_events, mtbf_hours, health_score, risk_band, asset_name, asset_type, site_id, building_id, descendant_count AS assets_downstream, connectivity_status FROM fault LEFT JOIN hier USING (asset_id)",
    "v_silent_assets": """
      SELECT asset_id, asset_name, site_id, building_id, last_at AS last_reading_at, n AS lifetime_readings, CASE WHEN last_at IS NULL THEN 'NEVER_REPORTED' ELSE 'SILENT' END AS status
      FROM hier LEFT JOIN (SELECT asset_id, max(ts) AS last_at, count(*) AS n FROM telemetry GROUP BY 1) USING (asset_id) WHERE is_leaf AND (last_at IS NULL OR last_at < (SELECT max(ts) FROM telemetry) - INTERVAL 24 HOUR)""",
    "silent_machines": """
      SELECT asset_id, asset_name, asset_type, site_id, last_at AS last_reading, n AS total_readings, CASE WHEN last_at IS NULL THEN 'NEVER SENT ANYTHING' ELSE 'WENT QUIET' END AS status
      FROM asset LEFT JOIN (SELECT asset_id, max(ts) AS last_at, count(*) AS n FROM telemetry GROUP BY 1) USING (asset_id) WHERE last_at IS NULL OR last_at < (SELECT max(ts) FROM telemetry) - INTERVAL 3 MINUTE""",
    "upsert_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice, CAST(year(o_orderdate) AS INTEGER) FROM orders WHERE o_orderkey % 100 = 1",
    "partition_overwrite": "SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, round(sum(power_consumption) * CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN 2 ELSE 1 END, 4) AS power FROM telemetry GROUP BY CAST(ts AS DATE)",
    "restate_late": "SELECT event_date, round(sum(energy_kwh), 4) AS energy_kwh, count(*) AS assets FROM utilization WHERE event_date IN (SELECT CAST(ts AS DATE) FROM telemetry WHERE ingest_date > CAST(ts AS DATE)) GROUP BY event_date",
    "compaction": "SELECT asset_id, count(*) AS n, count(DISTINCT event_id) AS ids, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (severity = 'High') AS high FROM event GROUP BY asset_id",
    "snapshot_time_travel": "SELECT *, 2 AS newest FROM site",
    "stream_clean": f"SELECT asset_id, sensor_id, ts AS timestamp, temperature, operating_mode FROM ({_STREAM_CLEAN})",
    "stream_quarantine": f"SELECT landing_no, {_failed('BLOCKING', _STREAM)} AS reasons FROM prepared WHERE {_PLAIN} AND {_failed('BLOCKING', _STREAM)} <> ''",
    "stream_dlq": """SELECT substr('{"timestamp":"' || raw_ts || '","site_id":"' || site_id, 1, 20) AS raw FROM prepared WHERE landing_no % 89 = 0""",
    "stream_rollup_5min": f"""
      SELECT site_id, asset_id, to_timestamp(w * 300) AT TIME ZONE 'UTC' AS window_start, to_timestamp(w * 300 + 300) AT TIME ZONE 'UTC' AS window_end, count(*) AS readings, round(avg(power_consumption), 5) AS avg_power_kw, round(max(power_consumption), 5) AS max_power_kw, round(avg(power_consumption) / 12, 5) AS approx_kwh
      FROM (SELECT *, epoch_us(ts) // 300000000 AS w FROM ({_STREAM_CLEAN})) GROUP BY site_id, building_id, asset_id, w
      HAVING w * 300 + 300 <= (SELECT max(epoch_us(ts)) / 1000000 - 900 FROM ({_STREAM_CLEAN}))""",
}

ORACLES = {name: f"{_WITH}\n{text}" for name, text in _SELECTS.items()}
