"""DuckDB SQL for the catalogue, written from the definitions and independent of the Spark plans."""

from __future__ import annotations

#: Archive, member and sensor names that touch every rule.
MEMBERS = [
    ("Experiment_A1.zip", "01_Experiment_A1/Test/Converted/UNIT_0001_RUN_001/temperature.csv", "temperature"),
    ("shaker.zip", "8-3-26 run/Converted/proc_vibration.csv", "vibration"),
    ("thermal_runs.zip", "02_Experiment_A2/Converted/pressure.CSV", "pressure"),
    ("EMI.zip", "03_Experiment_A3/converted/.hidden/microphone.csv", "microphone"),
    ("faulty_hardware.zip", "04_Experiment_B/Loose connector/current/Converted/current.csv", "current"),
    ("faulty_hardware.zip", "04_Experiment_B/IMU bias injection/IMU/Converted/gyroscope.csv", "gyroscope"),
    ("faulty_hardware.zip", "04_Experiment_B/Partial-occlusion/photodiode/Converted/photodiode.csv", "photodiode"),
    ("faulty_hardware.zip", "04_Experiment_B/Accelerated aging/ Pressure /Converted/pressure.csv", "pressure"),
    ("experiment_b.zip", "04_Experiment_B/Supply-voltage-droop/Converted/unknown.csv", "unknown"),
    ("run_b_2.zip", "__MACOSX/Converted/temperature.csv", "temperature"),
    ("other.zip", "misc/raw/temperature.bin", "temperature"),
    ("other.zip", "__..__", "none"),
]

_T = "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in m) + ")" for m in MEMBERS) + ") AS m(archive, member, sensor)"

_S = """s AS (
  SELECT event_type AS recording_id, event_id, epoch_us(ts) // 1000 AS ts_ms, value AS x,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq
  FROM events)"""


def _windows(value: str = "x", source: str = "s", name: str = "w", size: int = 64, stride: int = 16, extra: str = "") -> str:
    return f"""{name} AS (
  SELECT recording_id, (seq - {size}) // {stride} + 1 AS win_no, ts_ms AS end_ts, x AS end_value, v{extra and ", " + ", ".join(e.split(" AS ")[1] for e in extra.split("; "))}
  FROM (SELECT *, list({value}) OVER f AS v{"".join(", list(" + e.split(" AS ")[0] + ") OVER f AS " + e.split(" AS ")[1] for e in extra.split("; ")) if extra else ""}
        FROM {source} WINDOW f AS (PARTITION BY recording_id ORDER BY seq ROWS {size - 1} PRECEDING))
  WHERE seq >= {size} AND (seq - {size}) % {stride} = 0)"""





def _steps(f: str, v: str = "v") -> str:
    """List of f over neighbours, written with a and b."""
    return f"list_transform(range(1, len({v})), lambda i: {f.replace('#a', f'{v}[i]').replace('#b', f'{v}[i + 1]')})"


_M3 = "list_avg(list_transform(v, lambda x: (x - list_avg(v)) ** 3))"
_SKEW = f"(CASE WHEN list_var_pop(v) > 0 THEN {_M3} / list_var_pop(v) ** 1.5 ELSE 0 END)"
_KURT = "(CASE WHEN list_var_pop(v) > 0 THEN list_aggregate(v, 'kurtosis_pop') ELSE 0 END)"
_RMS = "sqrt(list_avg(list_transform(v, lambda x: x * x)))"
_MSD = f"list_avg({_steps('(#b - #a) ** 2')})"


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def _features(of: str, keep: str, v: str = "v") -> str:
    parts = [f"list_avg({v}) AS mean", f"list_var_pop({v}) AS variance", f"{_RMS} AS rms", f"{_SKEW} AS skewness", f"{_KURT} AS kurtosis", f"{_MSD} AS msd"]
    return f"SELECT {keep}, {', '.join(parts)} FROM {of}"


_EDGE = """e AS (
  SELECT s.recording_id, ts_ms AS calibration_end FROM s JOIN (SELECT recording_id, max(seq) AS n FROM s GROUP BY 1) USING (recording_id)
  WHERE seq = greatest(n // 2, 1))"""
_FIT = f"""{_S}, {_windows()}, {_EDGE}, g AS ({_features("w", "recording_id, win_no, end_ts")}),
c AS (SELECT g.*, end_ts <= calibration_end AS calibration FROM g JOIN e USING (recording_id)),
u AS (UNPIVOT c ON mean, variance, rms, skewness, kurtosis, msd INTO NAME feature VALUE value)"""
_SCALE = """k AS (
  SELECT recording_id, feature, count(*) AS n, avg(value) AS mean,
         greatest(coalesce(stddev_samp(value), 0), 0.1 * avg(abs(value)), 2.220446049250313e-14) AS scale
  FROM u WHERE calibration GROUP BY ALL)"""
_DIST = f"""{_FIT}, {_SCALE}, d AS (
  SELECT recording_id, win_no, end_ts, calibration, sqrt(avg(least(abs(value - mean) / scale, 10) ** 2)) AS distance
  FROM u JOIN k USING (recording_id, feature) GROUP BY ALL)"""

_PAIR = f"""{_S}, p AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN x + 5 ELSE x END AS observed, (event_id % 7 = 0)::DOUBLE AS changed FROM s)"""
_PAIRW = f"""{_PAIR}, {_windows("x", "p", extra="observed AS vo; changed AS vc")}"""
_SIMPLE = f"""{_PAIRW}, a AS ({_features("w", "recording_id, win_no, end_ts")}), b0 AS (SELECT recording_id, win_no, end_ts, vo AS v FROM w),
b AS ({_features("b0", "recording_id, win_no, end_ts")}),
ua AS (UNPIVOT a ON mean, variance, rms, skewness, kurtosis, msd INTO NAME feature VALUE clean),
ub AS (UNPIVOT b ON mean, variance, rms, skewness, kurtosis, msd INTO NAME feature VALUE observed),
k AS (SELECT recording_id, feature, greatest(stddev_samp(clean), 0.1 * avg(abs(clean)), 2.220446049250313e-14) AS scale FROM ua GROUP BY ALL),
d AS (SELECT recording_id, win_no, end_ts, sqrt(avg(least(abs(observed - clean) / scale, 10) ** 2)) AS distance
      FROM ua JOIN ub USING (recording_id, win_no, end_ts, feature) JOIN k USING (recording_id, feature) GROUP BY ALL),
q AS (SELECT d.*, list_avg(vc) AS fraction, CASE WHEN list_avg(vc) = 0 THEN 100.0 ELSE 100 * exp(-distance) END AS shi FROM d JOIN w USING (recording_id, win_no, end_ts))"""

_PROTOCOL = """CASE
  WHEN lower(member) LIKE '%experiment_a1%' OR lower(member) LIKE '8-3-26 run/%' THEN {a: 300.0::DOUBLE, b: 'pre_fault', c: 300.0::DOUBLE, d: 'protocol'}
  WHEN lower(member) LIKE '%experiment_a3%' THEN {a: 300.0::DOUBLE, b: 'pre_fault', c: 300.0::DOUBLE, d: 'protocol'}
  WHEN lower(member) LIKE '%experiment_a2%' THEN {a: 0.0::DOUBLE, b: 'tail_recovery', c: 300.0::DOUBLE, d: 'protocol'}
  WHEN lower(member) LIKE '%loose connector%' OR lower(member) LIKE '%partial-occlusion%' THEN {a: 300.0::DOUBLE, b: 'pre_fault', c: 300.0::DOUBLE, d: 'protocol_family'}
  WHEN lower(member) LIKE '%supply-voltage-droop%' OR lower(member) LIKE '%imu bias injection%' OR lower(member) LIKE '%accelerated aging%'
    THEN {a: 0.0::DOUBLE, b: 'initial_proxy', c: 60.0::DOUBLE, d: 'limited'}
  ELSE {a: 300.0::DOUBLE, b: 'pre_fault', c: 300.0::DOUBLE, d: 'assumed'} END"""
_UNPACK = "p.a AS fault_offset_s, p.b AS baseline, p.c AS baseline_seconds, p.d AS confidence"
_SPAN = f"""{_S}, sp AS (SELECT recording_id, arg_min(ts_ms, seq) AS first_ts, arg_max(ts_ms, seq) AS last_ts, count(*) AS n FROM s GROUP BY 1),
pr AS (SELECT member, {_PROTOCOL} AS p FROM {_T}), bo AS (SELECT * FROM sp, pr)"""
_FAMILY = """CASE WHEN lower(archive) LIKE '%a1%' OR lower(archive) LIKE '%shaker%' THEN 'A1_orbital_shaker'
  WHEN lower(archive) LIKE '%a2%' OR lower(archive) LIKE '%thermal%' OR lower(archive) LIKE '%fridge%' THEN '{0}'
  WHEN lower(archive) LIKE '%a3%' OR lower(archive) LIKE '%emi%' THEN '{1}'
  WHEN lower(archive) LIKE '%faulty\\_hardware%' ESCAPE '\\' OR lower(archive) LIKE '%{2}%' ESCAPE '\\' THEN 'B_faulty_hardware' ELSE '{3}' END"""
_FAM = _FAMILY.format("A2_thermal_fridge", "A3_smartphone_emi", "experiment\\_b", "unclassified")
_FAM_OLD = _FAMILY.format("A2_thermal", "A3_emi", "\\_b\\_", "other")
_CONTEXT = f"""x AS (SELECT *, {_FAM} AS family, list_transform(string_split(replace(member, chr(92), '/'), '/'), lambda z: trim(z)) AS parts FROM {_T}),
y AS (SELECT *, CASE WHEN lower(member) LIKE '%loose connector%' THEN 'loose_connector' WHEN lower(member) LIKE '%imu bias injection%' THEN 'imu_bias_injection'
  WHEN lower(member) LIKE '%partial_occlusion%' THEN 'partial_occlusion' WHEN lower(member) LIKE '%accelerated aging%' THEN 'accelerated_aging'
  WHEN lower(member) LIKE '%supply_voltage_droop%' THEN 'supply_voltage_droop' WHEN family = 'A1_orbital_shaker' THEN 'orbital_shaker'
  WHEN family = 'A2_thermal_fridge' THEN 'thermal_fridge' WHEN family = 'A3_smartphone_emi' THEN 'smartphone_emi' ELSE 'unclassified' END AS subtype,
  CASE WHEN family = 'B_faulty_hardware' THEN coalesce(list_filter(list_transform(range(1, len(parts)), lambda i:
    CASE WHEN lower(parts[i]) IN ('loose connector', 'imu bias injection', 'partial-occlusion', 'partial occlusion', 'accelerated aging', 'supply-voltage-droop', 'supply voltage droop') THEN parts[i + 1] END),
    lambda z: z IS NOT NULL)[1], '') ELSE '' END AS target FROM x)"""
_SENSORS = "('vibration', 'microphone', 'magnetometer', 'gyroscope', 'accelerometer', 'current', 'photodiode', 'pressure', 'temperature')"

_IV = """i AS (
  SELECT s.recording_id, min(ts_ms) AS start, max(ts_ms) FILTER (seq = floor(n * 0.5)) + 1 AS "end", max(ts_ms) FILTER (seq = floor(n * 0.6)) AS fault_start
  FROM s JOIN (SELECT recording_id, max(seq) AS n FROM s GROUP BY 1) USING (recording_id) GROUP BY 1)"""
_PARTS = f"""{_S}, {_windows()}, {_IV}, z AS (SELECT recording_id, win_no, end_ts, start, "end", fault_start FROM w JOIN i USING (recording_id))"""
_PART = """CASE WHEN ts_ms >= start AND ts_ms < "end" THEN 'calibration' WHEN ts_ms >= "end" AND ts_ms < fault_start THEN 'pre' WHEN ts_ms >= fault_start THEN 'post' END"""
_SCORED = f"""{_DIST}, {_IV}, d1 AS (SELECT recording_id, win_no, end_ts AS ts_ms, calibration, (round(100 * exp(-distance), 6) + 0.0) / 100 AS shi FROM d),
lo AS (SELECT recording_id, quantile_cont(shi, 0.05) AS low FROM d1 WHERE calibration GROUP BY 1),
d2 AS (SELECT d1.*, start, "end", fault_start, shi < low AS breach, win_no % 9 = 0 AS event FROM d1 JOIN lo USING (recording_id) JOIN i USING (recording_id)),
d3 AS (SELECT *, breach AND coalesce(lag(breach) OVER (PARTITION BY recording_id ORDER BY ts_ms, win_no), false) AS persistent, {_PART} AS part FROM d2)"""


def _metrics(of: str, digits: int | None = None) -> str:
    rnd = (lambda x: f"round({x}, {digits}) + 0.0") if digits else (lambda x: x)
    out = ["count(*) AS n_windows"]
    for name, p in (("calibration", "calibration"), ("pre_fault", "pre"), ("post_fault", "post")):
        out += [f"count(*) FILTER (part = '{p}') AS n_{name}", f"{rnd(f'''avg(shi) FILTER (part = '{p}')''')} AS {name}_shi_mean"]
        for k in ("breach", "persistent", "event"):
            out += [f"count(*) FILTER (part = '{p}' AND {k}) AS {name}_{k}_count", f"{rnd(f'''avg({k}::INT) FILTER (part = '{p}')''')} AS {name}_{k}_rate"]
    for k in ("breach", "persistent", "event"):
        out += [f"count(*) FILTER ({k}) AS whole_{k}_count", f"{rnd(f'avg({k}::INT)')} AS whole_{k}_rate"]
    for n, k in (("detection", "persistent"), ("event", "event")):
        out.append(f"{rnd(f'''(min(ts_ms) FILTER (part = 'post' AND {k}) - max(fault_start)) / 1000''')} AS {n}_latency_s")
    out += ["coalesce(bool_or(part = 'post' AND persistent), false) AS detected", "coalesce(bool_or(part = 'post' AND event), false) AS event_detected"]
    return f"SELECT recording_id, {', '.join(out)} FROM {of} GROUP BY recording_id"


_JOBS = """j AS (
  SELECT ['protocol', 'protocol_family', 'limited', 'assumed'][o_orderkey % 4 + 1] AS confidence,
    CASE WHEN o_custkey % 3 = 0 THEN 'onset_at_recording_start' ELSE 'delayed_onset' END AS onset,
    ['accelerated_aging', 'imu_bias_injection', 'loose_connector', 'partial_occlusion', 'supply_voltage_droop'][o_orderkey % 5 + 1] AS subtype,
    CASE WHEN o_orderkey % 2 = 0 THEN 'A1_orbital_shaker' ELSE 'B_faulty_hardware' END AS family,
    CASE WHEN o_orderkey % 2 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN 'imu' ELSE 'current' END AS target,
    o_orderkey % 6 AS n_post_fault, o_orderkey % 3 AS n_pre_fault, o_orderkey % 3 % 2 AS pre_fault_breach_count,
    o_custkey % 4 <> 1 AS detected, (o_custkey % 97)::DOUBLE AS detection_latency_s
  FROM orders)"""


def _group(keys: str, where: str = "true") -> str:
    names = [k.strip() for k in keys.split(",")]
    columns = ", ".join(k if k in names else f"NULL::VARCHAR AS {k}" for k in ("confidence", "onset", "subtype", "family", "target"))
    q = lambda p, n: f"round(quantile_cont(CASE WHEN n_post_fault > 0 AND detected THEN detection_latency_s END, {p}), 9) + 0.0 AS {n}"
    return f"""SELECT {columns}, count(*) AS jobs, count(*) FILTER (n_post_fault > 0) AS evaluated, count(*) FILTER (n_post_fault > 0 AND detected) AS detected,
      {q(0.5, "latency_median")}, {q(0.25, "latency_q1")}, {q(0.75, "latency_q3")}, count(*) FILTER (n_pre_fault > 0) AS jobs_with_pre_fault,
      sum(n_pre_fault)::BIGINT AS pre_trials, sum(pre_fault_breach_count)::BIGINT AS pre_breaches FROM j WHERE {where} GROUP BY {keys}"""


_REL = """ra AS (
  SELECT recording_id, feature, count(*) OVER h AS n, (value * (rn - 1) - coalesce(pre, 0) + (tot - coalesce(pre, 0) - value) - value * (count(*) OVER h - rn)) / count(*) OVER h AS dist
  FROM (SELECT *, row_number() OVER o AS rn, sum(value) OVER (PARTITION BY recording_id, feature ORDER BY value, win_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre,
               sum(value) OVER (PARTITION BY recording_id, feature) AS tot FROM u WHERE calibration WINDOW o AS (PARTITION BY recording_id, feature ORDER BY value, win_no))
  WINDOW h AS (PARTITION BY recording_id, feature)),
rel AS (SELECT recording_id, feature, CASE WHEN max(n) < 2 OR max(dist) <= 1e-12 THEN 1.0 ELSE greatest(least(1 - avg(dist) / max(dist), 1), 0) END AS reliability FROM ra GROUP BY ALL)"""
_CAT = """sg AS (SELECT *, ntile(4) OVER (PARTITION BY recording_id, feature ORDER BY win_no) AS part FROM u WHERE calibration),
cv AS (SELECT recording_id, feature, stddev_samp(m) / (abs(avg(m)) + 1e-12) AS cv FROM (SELECT recording_id, feature, part, avg(value) AS m FROM sg GROUP BY ALL) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY cv, list_position(['mean', 'variance', 'rms', 'skewness', 'kurtosis', 'msd'], feature)) AS rank FROM cv),
ct AS (SELECT recording_id, feature, cv, CASE WHEN feature LIKE '%variance' THEN 'mandatory' WHEN rank <= 2 THEN 'stable' WHEN rank > 5 THEN 'sensitive' END AS category FROM rk),
cx AS (SELECT *, CASE category WHEN 'mandatory' THEN 1.0 WHEN 'stable' THEN 0.8 ELSE 0.5 END::DOUBLE AS expert FROM ct WHERE category IS NOT NULL)"""
_BIN = f"""{_S}, sb AS (SELECT recording_id, seq, ts_ms, CASE WHEN x > 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM s), {_windows("x", "sb")}"""
_BINC = f"""{_BIN}, {_EDGE}, wc AS (SELECT w.*, end_ts <= calibration_end AS calibration FROM w JOIN e USING (recording_id))"""


def _logistic(x: str, m: str, t: str, rising: bool = False) -> str:
    """With the degenerate case: a gap under the floor."""
    floor = f"greatest(abs({m}) * 1e-9, 1e-12)"
    at = f"(CASE WHEN abs({t} - {m}) < {floor} THEN {m} {'-' if rising else '+'} {floor} ELSE {t} END)"
    scale = f"(CASE WHEN abs({t} - {m}) < {floor} THEN {floor} ELSE abs({t} - {m}) END)"
    return f"1 / (1 + exp(greatest(least({'-' if rising else ''}(ln(9.0) * ({x} - {at}) / {scale}), 60), -60)))"


_BRANCH = f"""{_FIT}, hq AS (SELECT recording_id, feature, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.95) AS t FROM u WHERE calibration AND feature IN ('mean', 'rms', 'msd') GROUP BY ALL),
hb AS (SELECT recording_id, win_no, feature AS branch, {_logistic("value", "m", "t")} AS health FROM u JOIN hq USING (recording_id, feature) WHERE calibration)"""
_WEIGHTS = """w0 AS (SELECT recording_id, branch, 1 / greatest(stddev_pop(health), 0.05) AS w FROM hb GROUP BY ALL),
w1 AS (SELECT recording_id, branch, greatest(least(w, 3 * m), m / 3) AS w FROM w0 JOIN (SELECT recording_id, quantile_cont(w, 0.5) AS m FROM w0 GROUP BY 1) USING (recording_id)),
wt AS (SELECT recording_id, branch, w / sum(w) OVER (PARTITION BY recording_id) AS weight FROM w1)"""
_NORM = f"""{_S}, {_windows()}, nz AS (SELECT recording_id, win_no, {_RMS} AS z FROM w)"""


def _recursive(step: str, out: str, name: str) -> str:
    return f"""WITH RECURSIVE {_NORM}, rec AS (
      SELECT recording_id, win_no, z, 0.0::DOUBLE AS before, {step.replace("#s", "0.0::DOUBLE").replace("#x", "z")} AS state FROM nz WHERE win_no = 1
      UNION ALL SELECT n.recording_id, n.win_no, n.z, r.state, {step.replace("#s", "r.state").replace("#x", "n.z")} FROM rec r JOIN nz n ON n.recording_id = r.recording_id AND n.win_no = r.win_no + 1)
    SELECT recording_id, win_no, {_r(out, name)} FROM rec"""


_ACTIVE = f"""{_S}, a0 AS (SELECT *, x > 120 AS active FROM s), a AS (SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY recording_id ORDER BY seq), false) AS onset FROM a0)"""
_LABEL = f"""{_ACTIVE}, h AS (SELECT *, min(CASE WHEN onset THEN ts_ms END) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - ts_ms AS soon FROM a),
hl AS (SELECT recording_id, seq, CASE WHEN active THEN 2 WHEN soon <= 14400000 THEN 1 ELSE 0 END AS label FROM h)"""
_W64 = "w AS (SELECT vec_id AS win_no, embedding::DOUBLE[] AS v FROM embeddings)"
_ON = f"""{_S}, o AS (SELECT *, count(*) OVER p AS n, floor(count(*) OVER p * 0.6)::BIGINT AS onset FROM s WINDOW p AS (PARTITION BY recording_id))"""


def _inject(y: str) -> str:
    return f"""WITH {_ON}, st AS (SELECT recording_id, max(x) FILTER (seq = onset) AS stuck, quantile_cont(abs(x), 0.95) FILTER (seq <= onset) AS p95 FROM o GROUP BY 1)
    SELECT recording_id, seq, {_r(f"CASE WHEN seq > onset THEN {y} ELSE x END", "faulty")}, CASE WHEN seq > onset THEN 2 WHEN seq > onset - 20 THEN 1 ELSE 0 END AS label
    FROM (SELECT o.*, stuck, p95, seq - onset - 1 AS i, lag(x, 12) OVER (PARTITION BY recording_id ORDER BY seq) AS late FROM o JOIN st USING (recording_id))"""


_NOISE = f"(list_median(list_transform({_steps('#b - #a')}, lambda z: abs(z - list_median({_steps('#b - #a')})))) * 1.4826 / sqrt(2.0))"


def _segments(n: int, size: str) -> str:
    return "[" + ", ".join(f"list_avg(v[{size} * {i} + 1:{size} * {i + 1}])" for i in range(n)) + "]"


_DFT = """pw AS (
  SELECT win_no, k, (list_sum(list_transform(range(1, 65), lambda j: v[j] * cos(2 * pi() * (k * (j - 1) % 64) / 64))) ** 2
                   + list_sum(list_transform(range(1, 65), lambda j: v[j] * sin(2 * pi() * (k * (j - 1) % 64) / 64))) ** 2) AS p
  FROM w, range(0, 33) t(k))"""


def _gain(i: int) -> str:
    angle = f"(k * 2 * pi() / 64 * {2**i} / 2)"
    s = f"(sin({angle}) ** 2)"
    return f"(2 * cos({angle}) ** 8 * (1 + 4 * {s} + 10 * {s} ** 2 + 20 * {s} ** 3))"


def _wavelet(levels: int, norm: bool) -> str:
    both = "(p * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / 64)"
    out = []
    for j in range(1, levels + 1):
        gains = " * ".join([both, *[_gain(i) for i in range(j - 1)], f"(2 - {_gain(j - 1)})"])
        out.append(_r(f"sum({gains}) / {2**j if norm else 1}", f"d{j}", 5))
    out.append(_r(f"sum({' * '.join([both, *[_gain(i) for i in range(levels)]])}) / {2**levels if norm else 1}", "approximation", 5))
    return f"WITH {_W64}, {_DFT} SELECT win_no, {', '.join(out)} FROM pw GROUP BY win_no"


_QUART = lambda of: f"""SELECT recording_id, quantile_cont(raw, 0.95) AS t, quantile_cont(raw, 0.5) AS m, quantile_cont(raw, 0.75) AS b, quantile_cont(raw, 0.25) AS a FROM {of} WHERE calibration GROUP BY 1"""
_XYZ = """s AS (SELECT l_suppkey::VARCHAR AS recording_id, epoch_us(l_shipdate) // 1000 AS ts_ms, l_quantity AS x, l_extendedprice AS y, l_discount AS z,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS seq FROM lineitem)"""
_USER = "s AS (SELECT user_id::VARCHAR AS recording_id, epoch_us(ts) // 1000 AS ts_ms, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"

ORACLE = {
    "sliding_windows": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, end_ts, end_value, len(v)::INT AS n, v[1] AS first_value, {_r('list_avg(v)', 'mean', 9)} FROM w",
    "sliding_windows_short": f"WITH {_USER}, {_windows(size=16, stride=4)} SELECT recording_id, win_no, end_ts, end_value, {_r('list_avg(v)', 'mean', 9)} FROM w",
    "sliding_windows_xyz": f"WITH {_XYZ}, {_windows(size=128, stride=64, extra='y AS vy; z AS vz')} SELECT recording_id, win_no, end_ts, {_r('list_avg(v)', 'mean_x', 9)}, {_r('sqrt(list_avg(list_transform(vy, lambda q: q * q)))', 'rms_y', 4)}, {_r('list_var_pop(vz)', 'variance_z')} FROM w",
    "first_window_fs": f"WITH {_S}, d AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY recording_id ORDER BY seq) AS step FROM s WHERE seq <= 64) SELECT recording_id, {_r('coalesce(1000 / quantile_cont(step, 0.5) FILTER (step > 0), 1.0)', 'fs', 12)} FROM d GROUP BY 1 HAVING count(*) = 64",
    "feat_time": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, {_r('list_avg(v)', 'mean', 9)}, {_r('list_var_pop(v)', 'variance')}, {_r(_RMS, 'rms')} FROM w",
    "feat_mean_abs": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, {_r('list_avg(list_transform(v, lambda x: abs(x)))', 'mean_abs', 9)} FROM w",
    "feat_moments": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, {_r(_SKEW, 'skewness')}, {_r(_KURT, 'kurtosis')} FROM w",
    "feat_zcr": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, {_r('list_avg(' + _steps('(sign(#a - 50) <> sign(#b - 50))::INT') + ')', 'zcr', 9)} FROM w",
    "feat_stability": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, {_r(_MSD, 'msd')} FROM w",
    "calibration_scale": f"WITH {_FIT}, {_SCALE} SELECT recording_id, feature, n, {_r('mean', 'mean')}, {_r('scale', 'scale')} FROM k",
    "baseline_score": f"WITH {_DIST} SELECT recording_id, win_no, end_ts, {_r('distance', 'distance')}, {_r('100 * exp(-distance)', 'shi')} FROM d",
    "aligned_join": f"WITH {_PAIR} SELECT recording_id, seq, ts_ms, x AS clean, observed FROM p",
    "alignment_check": f"WITH {_S} SELECT recording_id, count(*) FILTER (event_id % 1000 = 3) AS missing, 0::BIGINT AS extra, count(*) AS n FROM s GROUP BY 1",
    "injected_fraction": f"WITH {_PAIRW} SELECT recording_id, win_no, {_r('list_avg(vc)', 'fraction', 9)} FROM w",
    "simple_score": f"WITH {_SIMPLE} SELECT recording_id, win_no, {_r('distance', 'distance')}, {_r('shi', 'shi')} FROM q",
    "result_summary": f"""WITH {_SIMPLE} SELECT recording_id, count(*) AS windows, count(*) FILTER (fraction > 0) AS injected, {_r('avg(shi)', 'mean_shi')}, {_r('avg(shi) FILTER (fraction > 0)', 'mean_injected')},
      {_r('avg(shi) FILTER (fraction <= 0)', 'mean_clean')}, {_r('min(shi)', 'min_shi')}, {_r('max(shi)', 'max_shi')}, min(end_ts) AS first_ts, max(end_ts) AS last_ts FROM q GROUP BY 1""",
    "ts_bounds": f"WITH {_SPAN} SELECT recording_id, first_ts, last_ts, n FROM sp",
    "monotone_check": f"WITH {_S}, m AS (SELECT recording_id, seq, CASE WHEN event_id % 500 = 7 THEN ts_ms - 90000000 ELSE ts_ms END AS t FROM s), l AS (SELECT *, t < lag(t) OVER (PARTITION BY recording_id ORDER BY seq) AS back FROM m) SELECT recording_id, count(*) AS n, count(*) FILTER (back) AS decreasing FROM l GROUP BY 1",
    "sampling_rate": f"WITH {_SPAN}, d AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY recording_id ORDER BY seq) AS step FROM s) SELECT recording_id, first_ts, last_ts, n, {_r('fs', 'fs', 12)} FROM sp JOIN (SELECT recording_id, 1000 / quantile_cont(step, 0.5) AS fs FROM d WHERE step > 0 GROUP BY 1) USING (recording_id)",
    "member_filter": f"""WITH f AS (SELECT member, regexp_replace(regexp_extract(lower(member), '([^/]*)[.]csv$', 1), '^proc_', '') AS stem, string_split(lower(member), '/') AS parts FROM {_T}),
      g AS (SELECT *, CASE WHEN stem IN {_SENSORS} THEN stem END AS found FROM f)
      SELECT member, found, coalesce(found IS NOT NULL AND list_contains(parts, 'converted') AND len(list_filter(parts, lambda z: z LIKE '.%' OR z = '__macosx')) = 0, false) AS valid FROM g""",
    "protocol_rules": f"SELECT member, {_UNPACK} FROM (SELECT member, {_PROTOCOL} AS p FROM {_T})",
    "protocol_override": f"""SELECT member, {_UNPACK} FROM (SELECT member, CASE WHEN contains(member, 'Experiment') THEN {{a: 5.0::DOUBLE, b: 'pre_fault', c: 5.0::DOUBLE, d: 'manual'}}
      WHEN contains(member, 'IMU') THEN {{a: 0.0::DOUBLE, b: 'initial_proxy', c: 60.0::DOUBLE, d: 'manual'}} ELSE {_PROTOCOL} END AS p FROM {_T})""",
    "calibration_bounds": f"""WITH {_SPAN} SELECT recording_id, member, CASE WHEN p.b = 'tail_recovery' THEN greatest(first_ts, last_ts - (p.c * 1000)::BIGINT) ELSE first_ts END AS start,
      CASE p.b WHEN 'tail_recovery' THEN last_ts + 1 WHEN 'pre_fault' THEN least(last_ts + 1, first_ts + (p.a * 1000)::BIGINT) ELSE least(last_ts + 1, first_ts + (p.c * 1000)::BIGINT) END AS "end",
      first_ts + (p.a * 1000)::BIGINT AS fault_start FROM bo""",
    "calibration_bounds_brb": f"""WITH {_SPAN}, {_windows()} SELECT recording_id, member, count(*) FILTER (CASE WHEN p.b = 'tail_recovery' THEN end_ts >= last_ts - trunc(p.c * 1000) ELSE end_ts <= first_ts + trunc(p.c * 1000) END) AS inside,
      count(*) AS windows FROM w JOIN bo USING (recording_id) GROUP BY ALL""",
    "calibration_range_join": f'WITH {_PARTS} SELECT recording_id, win_no, end_ts FROM z WHERE end_ts >= start AND end_ts < "end"',
    "min_calibration": f"WITH {_FIT} SELECT recording_id, count(*) FILTER (calibration) AS n, CASE WHEN count(*) FILTER (calibration) >= 60 THEN 'ok' ELSE 'too few calibration windows' END AS status FROM c GROUP BY 1",
    "family_label": f"""SELECT archive, member, {_FAM} AS family, {_FAM_OLD} AS legacy_family, CASE WHEN lower(member) LIKE '%loose connector%' THEN 'loose_connector' WHEN lower(member) LIKE '%imu bias injection%' THEN 'imu_bias'
      WHEN lower(member) LIKE '%partial-occlusion%' THEN 'partial_occlusion' WHEN lower(member) LIKE '%accelerated aging%' THEN 'accelerated_aging' WHEN lower(member) LIKE '%supply-voltage-droop%' THEN 'supply_voltage_droop' ELSE '' END AS legacy_subtype FROM {_T}""",
    "fault_context": f"WITH {_CONTEXT} SELECT archive, member, subtype, target FROM y",
    "target_sensor_match": f"WITH {_CONTEXT} SELECT member, sensor, CASE WHEN trim(target) = '' THEN false WHEN lower(trim(target)) = 'imu' THEN sensor IN ('accelerometer', 'gyroscope', 'magnetometer') ELSE lower(trim(target)) = lower(trim(sensor)) END AS is_target FROM y",
    "safe_component": f"SELECT member, coalesce(nullif(trim(regexp_replace(member, '[^A-Za-z0-9._-]', '_', 'g'), '._'), ''), 'item') AS safe FROM {_T}",
    "job_ids": f"SELECT archive, member, sha256(archive || chr(0) || member || chr(0) || sensor)[:16] AS job_id FROM {_T}",
    "missing_subtypes": f"WITH {_CONTEXT} SELECT unnest(['accelerated_aging', 'imu_bias_injection', 'loose_connector', 'partial_occlusion', 'supply_voltage_droop']) AS subtype EXCEPT SELECT subtype FROM y WHERE sensor <> 'pressure'",
    "resume_anti_join": "SELECT o_orderkey AS job, o_custkey AS source FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "flag_pack": "SELECT event_id, ((value > 50)::INT + 2 * (value > 100)::INT + 4 * (event_id % 7 = 0)::INT + 8 * (event_id % 11 = 0)::INT)::INT AS flags FROM events",
    "flag_unpack": "SELECT event_id, event_id % 2 = 1 AS breach, event_id % 4 >= 2 AS persistent, event_id % 8 >= 4 AS event FROM events",
    "persistent_breach": f"WITH {_SCORED} SELECT recording_id, win_no, breach, persistent FROM d3",
    "partition_new": f"WITH {_PARTS} SELECT recording_id, win_no, {_PART.replace('ts_ms', 'end_ts')} AS part FROM z",
    "partition_legacy": f"WITH {_PARTS} SELECT recording_id, win_no, CASE WHEN end_ts >= fault_start THEN 'post' WHEN end_ts >= start + 86400000 AND end_ts < fault_start + 86400000 THEN 'calibration' ELSE 'pre' END AS part FROM z",
    "partition_invariant": f"""WITH {_PARTS} SELECT recording_id, count(*) AS windows, count(*) FILTER (NOT ((end_ts >= start + 86400000 AND end_ts < "end") OR end_ts >= least("end", fault_start))) AS unassigned FROM z GROUP BY 1""",
    "timeline_metrics": f"""WITH t AS (SELECT 'job' AS recording_id, * FROM (VALUES (1000, 0.9::DOUBLE, false, false, false, 'calibration'), (2000, 0.8, false, false, false, 'calibration'), (3000, 0.7, true, false, false, 'pre'),
      (4000, 0.6, false, false, false, 'pre'), (5000, 0.4, true, false, false, 'post'), (6000, 0.3, true, true, true, 'post')) v(ts_ms, shi, breach, persistent, event, part)), t2 AS (SELECT *, 5000 AS fault_start FROM t) {_metrics('t2', 6)}""",
    "detection_latency": f"WITH {_SCORED}, m AS ({_metrics('d3')}) SELECT recording_id, detected, detection_latency_s, event_detected, event_latency_s FROM m",
    "alarm_counts": f"WITH {_SCORED}, m AS ({_metrics('d3')}) SELECT recording_id, n_windows, " + ", ".join(f"whole_{k}_count, round(whole_{k}_rate, 9) + 0.0 AS whole_{k}_rate" for k in ("breach", "persistent", "event")) + " FROM m",
    "job_metrics": f"WITH {_SCORED} {_metrics('d3', 6)}",
    "event_branch": f"WITH {_SCORED}, m AS ({_metrics('d3')}) SELECT recording_id, n_windows, whole_event_count, calibration_event_count, pre_fault_event_count, post_fault_event_count, event_detected FROM m",
    "calibration_health": f"WITH {_SCORED} SELECT recording_id, count(*) FILTER (part = 'calibration') AS n_calibration, {_r('''avg(shi) FILTER (part = 'calibration')''', 'calibration_shi_mean')}, avg(shi) FILTER (part = 'calibration') < 0.7 AS unhealthy FROM d3 GROUP BY 1",
    "grouping_sets_summary": f"WITH {_JOBS} {_group('confidence, onset')} UNION ALL {_group('subtype')} UNION ALL {_group('family')} UNION ALL {_group('subtype, target', '''target <> '' ''')}",
    "latency_quantiles": f"WITH {_JOBS} SELECT subtype, " + ", ".join(_r(f"quantile_cont(detection_latency_s, {q}) FILTER (detected AND n_post_fault > 0)", n, 9) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))) + " FROM j GROUP BY 1",
    "report_rate_check": f"WITH {_SCORED} SELECT DISTINCT recording_id, recording_id <> 'click' AS matches FROM d3",
    "window_count_check": f"WITH {_S}, {_windows()}, n AS (SELECT recording_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT recording_id, count(*) AS found FROM w GROUP BY 1) SELECT recording_id, (n - 64) // 16 + 1 AS expected, found, (n - 64) // 16 + 1 IS NOT DISTINCT FROM found AS matches FROM n LEFT JOIN f USING (recording_id)",
    "quantile_calibration": f"WITH {_FIT} SELECT recording_id, feature, " + ", ".join(_r(f"quantile_cont(value, {q})", f"p{int(q * 100)}") for q in (0.05, 0.5, 0.75, 0.95, 0.99)) + " FROM u WHERE calibration GROUP BY ALL",
    "zscore_select": f"WITH {_FIT}, k AS (SELECT recording_id, feature, avg(value) AS m, stddev_pop(value) AS s FROM u WHERE calibration GROUP BY ALL HAVING stddev_pop(value) > 1e-6) SELECT recording_id, win_no, feature, {_r('(value - m) / (s + 1e-9)', 'z', 5)} FROM u JOIN k USING (recording_id, feature)",
    "robust_envelope": f"""WITH {_S}, {_windows()}, x AS (SELECT recording_id, unnest(v) AS x FROM w), m AS (SELECT recording_id, quantile_cont(x, 0.5) AS m, stddev_pop(x) AS s FROM x GROUP BY 1),
      d AS (SELECT recording_id, any_value(m) AS m, any_value(s) AS s, quantile_cont(abs(x - m), 0.5) AS mad FROM x JOIN m USING (recording_id) GROUP BY 1) SELECT recording_id, {_r('m', 'median')}, {_r('mad', 'mad')}, {_r('greatest(1.4826 * mad, 0.1 * s, 1e-9)', 'scale')} FROM d""",
    "sparse_channel": "SELECT l_suppkey::VARCHAR AS recording_id, count(DISTINCT (l_quantity, l_extendedprice, l_discount)) AS xyz, count(DISTINCT l_discount) AS z, count(DISTINCT l_discount) <= 16 AS sparse FROM lineitem GROUP BY l_suppkey",
    "reliability_weights": f"WITH {_BRANCH}, {_WEIGHTS} SELECT recording_id, branch, {_r('weight', 'weight')} FROM wt",
    "pairwise_reliability": f"WITH {_FIT}, {_REL} SELECT recording_id, feature, {_r('reliability', 'reliability')} FROM rel",
    "feature_categories": f"WITH {_FIT}, {_CAT} SELECT recording_id, feature, {_r('cv', 'cv')}, category, expert FROM cx",
    "brb_score": f"""WITH {_FIT}, {_REL}, {_CAT}, k AS (SELECT recording_id, feature, avg(value) AS m, greatest(stddev_samp(value), 1e-12) AS s FROM u WHERE calibration GROUP BY ALL),
      mo AS (SELECT recording_id, feature, category, m, s, ex / greatest(1 + ex - reliability, 1e-12) AS w FROM (SELECT *, expert / max(expert) OVER (PARTITION BY recording_id) AS ex FROM cx) JOIN rel USING (recording_id, feature) JOIN k USING (recording_id, feature)),
      zz AS (SELECT recording_id, win_no, calibration, sum(abs((value - m) / s) * w) / sum(w) AS raw, sum(abs((value - m) / s) * w) FILTER (category = 'sensitive') / sum(w) FILTER (category = 'sensitive') AS deg FROM u JOIN mo USING (recording_id, feature) GROUP BY ALL),
      qq AS ({_QUART('zz')}) SELECT recording_id, win_no, {_r('raw', 'raw', 5)}, {_r('coalesce(deg, raw)', 'degradation', 5)}, {_r('1 / (1 + greatest(raw - t, 0) / greatest(t - m, b - a, 1e-6))', 'health', 5)} FROM zz JOIN qq USING (recording_id)""",
    "event_rates": f"WITH {_BIN} SELECT recording_id, win_no, {_r('list_avg(' + _steps('(#a <> #b)::INT') + ')', 'rate', 9)} FROM w",
    "flat_fraction": f"WITH {_BIN} SELECT recording_id, win_no, {_r('list_avg(' + _steps('(#a = #b)::INT') + ')', 'flat', 9)} FROM w",
    "max_jump": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, {_r('list_max(' + _steps('abs(#b - #a)') + ')', 'jump', 9)} FROM w",
    "binary_baseline": f"WITH {_BINC}, f AS (SELECT recording_id, unnest(v) AS x FROM wc WHERE calibration) SELECT recording_id, CASE WHEN count(*) FILTER (x = 1) > count(*) FILTER (x = 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS baseline FROM f GROUP BY 1",
    "binary_event_score": f"""WITH {_BINC}, f AS (SELECT recording_id, unnest(v) AS x FROM wc WHERE calibration), bb AS (SELECT recording_id, CASE WHEN count(*) FILTER (x = 1) > count(*) FILTER (x = 0) THEN 1.0 ELSE 0.0 END AS base FROM f GROUP BY 1),
      zz AS (SELECT recording_id, win_no, calibration, list_avg(list_transform(v, lambda q: (q <> base)::INT)) AS raw FROM wc JOIN bb USING (recording_id)), qq AS ({_QUART('zz')})
      SELECT recording_id, win_no, {_r('raw', 'raw', 9)}, {_r('1 / (1 + greatest(raw - t, 0) / greatest(t - m, b - a, 1.0 / 64))', 'health')} FROM zz JOIN qq USING (recording_id)""",
    "event_rate_health": f"""WITH {_BINC}, zz AS (SELECT recording_id, win_no, calibration, list_avg({_steps('(#a <> #b)::INT')}) AS rate FROM wc), mm AS (SELECT recording_id, quantile_cont(rate, 0.5) AS m FROM zz WHERE calibration GROUP BY 1),
      oo AS (SELECT zz.*, abs(rate - m) AS off FROM zz JOIN mm USING (recording_id)), qq AS (SELECT recording_id, quantile_cont(off, 0.5) AS lo, quantile_cont(off, 0.95) AS hi FROM oo WHERE calibration GROUP BY 1),
      hh AS (SELECT recording_id, win_no, 1 - greatest(least((off - lo) / greatest(hi - lo, 1e-12), 1), 0) AS health FROM oo JOIN qq USING (recording_id)) SELECT recording_id, win_no, {_r('health', 'health')}, health <= 0 AS alarm FROM hh""",
    "ewma_norm": _recursive("#s * 0.9 + #x * 0.1", "state", "ewma"),
    "ewma_residual": _recursive("#x * 0.15 + #s * 0.85", "abs(z - before)", "residual"),
    "logistic_health": f"WITH {_BRANCH} SELECT recording_id, win_no, branch, {_r('health', 'health')} FROM hb",
    "geometric_fusion": f"""WITH {_BRANCH}, {_WEIGHTS}, rw AS (SELECT recording_id, win_no, exp(sum(weight * ln(greatest(least(health, 1), 1e-6)))) AS raw FROM hb JOIN wt USING (recording_id, branch) GROUP BY ALL),
      qq AS (SELECT recording_id, quantile_cont(raw, 0.05) AS t, quantile_cont(raw, 0.5) AS m FROM rw GROUP BY 1) SELECT recording_id, win_no, {_r('raw', 'raw')}, {_r(_logistic('raw', 'm', 't', True), 'health')} FROM rw JOIN qq USING (recording_id)""",
    "fused_score": f"""WITH {_FIT}, qq AS (SELECT recording_id, feature, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.99) AS t FROM u WHERE calibration AND feature IN ('mean', 'rms', 'msd') GROUP BY ALL),
      sh AS (SELECT recording_id, win_no, calibration, 1 - avg(greatest(least((value - m) / greatest(t - m, 1e-12), 1), 0)) AS shi FROM u JOIN qq USING (recording_id, feature) GROUP BY ALL),
      lw AS (SELECT recording_id, quantile_cont(shi, 0.05) AS low FROM sh WHERE calibration GROUP BY 1) SELECT recording_id, win_no, {_r('shi', 'shi')}, round(shi, 9) < round(low, 9) AS breach FROM sh JOIN lw USING (recording_id)""",
    "reference_flags": f"""WITH {_S}, {_windows()}, x AS (SELECT recording_id, unnest(v) AS x FROM w), m AS (SELECT recording_id, quantile_cont(x, 0.5) AS m, stddev_pop(x) AS s FROM x GROUP BY 1),
      d AS (SELECT recording_id, any_value(m) AS m, any_value(s) AS s, quantile_cont(abs(x - m), 0.5) AS mad FROM x JOIN m USING (recording_id) GROUP BY 1)
      SELECT recording_id, win_no, ((list_avg(v) < 20)::INT + 4 * (list_avg({_steps('(#a = #b)::INT')}) >= 0.98)::INT + 8 * (abs(end_value - m) / greatest(1.4826 * mad, 0.1 * s, 1e-9) > 3)::INT)::INT AS flags FROM w JOIN d USING (recording_id)""",
    "mahalanobis_2d": f"""WITH {_FIT}, k AS (SELECT recording_id, avg(mean) AS ma, avg(rms) AS mb, var_pop(mean) AS vaa, var_pop(rms) AS vbb, covar_pop(mean, rms) AS vab FROM c WHERE calibration GROUP BY 1)
      SELECT recording_id, win_no, {_r('((mean - ma) ** 2 * vbb - 2 * (mean - ma) * (rms - mb) * vab + (rms - mb) ** 2 * vaa) / (vaa * vbb - vab * vab)', 'd2', 4)} FROM c JOIN k USING (recording_id)""",
    "horizon_labels": f"WITH {_LABEL} SELECT recording_id, seq, label FROM hl",
    "active_onsets": f"WITH {_ACTIVE} SELECT recording_id, seq, ts_ms FROM a WHERE onset",
    "largest_remainder": f"""WITH {_S}, g AS (SELECT recording_id, count(*) AS n FROM s GROUP BY 1), h AS (SELECT *, n * 1234.0::DOUBLE / sum(n) OVER () AS share FROM g),
      k AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, recording_id) AS rk, 1234 - sum(floor(share)) OVER () AS rest FROM h) SELECT recording_id, (base + (rk <= rest)::INT)::BIGINT AS allocated FROM k""",
    "downsample": f"WITH {_S} SELECT recording_id, seq, x FROM (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM s) WHERE (seq - 1) % ceil(n / 300) = 0",
    "fault_slice": f"WITH {_S}, {_IV} SELECT recording_id, seq, {_r('(ts_ms - start) / 1000', 'elapsed_s', 3)}, x FROM s JOIN i USING (recording_id) WHERE abs(ts_ms - fault_start) <= 86400000",
    "signal_norm": f"WITH {_XYZ} SELECT recording_id, (CASE WHEN bool_or(y <> 0 OR z <> 0) THEN 3 ELSE 1 END)::INT AS axes, {_r('max(sqrt(x * x + y * y + z * z))', 'largest', 4)}, {_r('min(sqrt(x * x + y * y + z * z))', 'smallest', 4)} FROM s GROUP BY 1",
    "inject_bias_offset": _inject("x + 2.5"),
    "inject_drift": _inject("x + 10.0 * i / (n - onset - 1)"),
    "inject_dropout": _inject("(CASE WHEN i % 9 < 2 THEN 0 ELSE x END)"),
    "inject_stuck_at": _inject("stuck"),
    "inject_latency": _inject("(CASE WHEN onset + 12 >= n THEN x WHEN i < 12 THEN stuck ELSE late END)"),
    "inject_saturation": _inject("greatest(least(x, 0.5 * p95), -0.5 * p95)"),
    "inject_calibration_shift": _inject("x * 1.25"),
    "t2_time": f"WITH {_W64} SELECT win_no, {_r('list_avg(v)', 'mean')}, {_r('list_stddev_pop(v)', 'std')}, {_r(_RMS, 'rms')}, {_r(_SKEW, 'skewness')}, {_r(_KURT, 'kurtosis')} FROM w",
    "t2_quantiles": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, " + ", ".join(_r(f"list_aggregate(v, 'quantile_cont', {q}::DOUBLE)", f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)) + " FROM w",
    "t2_zcr": f"WITH {_W64} SELECT win_no, {_r('list_avg(' + _steps('(#a * #b < 0)::INT') + ')', 'zcr', 9)} FROM w",
    "t2_quality": f"WITH {_S}, {_windows()} SELECT recording_id, win_no, {_r(_NOISE, 'noise_floor')}, {_r('list_stddev_pop(' + _segments(5, '12') + ')', 'stability')}, {_r(f'log10(list_var_pop(v) / greatest({_NOISE} ** 2, 1e-12) + 1e-12)', 'log_snr')} FROM w",
    "brb_time": f"WITH {_W64} SELECT win_no, {_r('list_avg(v)', 'mean')}, {_r('list_var_pop(v)', 'variance')}, " + ", ".join(_r(f"list_aggregate(v, 'quantile_cont', {q}::DOUBLE)", f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)) + f", {_r('list_avg(' + _steps('(sign(#a) <> sign(#b))::INT') + ')', 'zcr', 9)} FROM w",
    "brb_moments": f"WITH {_W64} SELECT win_no, {_r('''CASE WHEN list_var_pop(v) <= 1e-12 THEN 0 ELSE list_aggregate(v, 'skewness') END''', 'skewness')}, {_r('''CASE WHEN list_var_pop(v) <= 1e-12 THEN 0 ELSE list_aggregate(v, 'kurtosis') END''', 'kurtosis')} FROM w",
    "brb_allan": f"WITH {_W64} SELECT win_no, " + ", ".join(_r(f"sqrt(list_sum(list_transform(range(1, {64 - 2 * m + 2}), lambda i: ((list_sum(v[i + {m}:i + {2 * m - 1}]) - list_sum(v[i:i + {m - 1}])) / {m}) ** 2)) / (2 * {64 - 2 * m + 1}))", f"adev_{m}") for m in (1, 2, 4, 8)) + " FROM w",
    "brb_quality": f"WITH {_W64} SELECT win_no, {_r(_NOISE, 'noise_floor')}, {_r('list_stddev_pop(' + _segments(4, '16') + ')', 'stability')}, {_r('greatest(least(10 * log10(list_var_pop(v) / (list_var_pop(' + _steps('#b - #a') + ') / 2)), 60), -60)', 'snr')} FROM w",
    "brb_runs": f"""WITH {_BIN}, x AS (SELECT recording_id, win_no, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM w), y AS (SELECT *, (x IS DISTINCT FROM lag(x) OVER (PARTITION BY recording_id, win_no ORDER BY i))::INT AS new FROM x),
      g AS (SELECT *, sum(new) OVER (PARTITION BY recording_id, win_no ORDER BY i) AS run FROM y), n AS (SELECT recording_id, win_no, run, count(*) AS n FROM g GROUP BY ALL)
      SELECT recording_id, win_no, {_r('coalesce(sum(n) FILTER (n >= 3), 0) / 64', 'dropout', 9)}, {_r('sum(n - 1) / 63', 'identical', 9)}, {_r('CASE WHEN max(n) >= 2 THEN max(n) / 64 ELSE 0 END', 'longest', 9)} FROM n GROUP BY ALL""",
    "brb_linearity": f"WITH {_W64}, x AS (SELECT win_no, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM w) SELECT win_no, {_r('coalesce(regr_r2(y, i), 1)', 'linearity')} FROM x GROUP BY 1",
    "brb_peaks": f"WITH {_W64}, x AS (SELECT win_no, a, list_max(v[a + 1:a + 8]) - list_min(v[a + 1:a + 8]) AS p FROM w, range(0, 57, 4) t(a)) SELECT win_no, {_r('stddev_pop(p) / (avg(p) + 1e-12)', 'peak_consistency')} FROM x GROUP BY 1",
    "interp_nonfinite": f"""WITH {_S}, g AS (SELECT recording_id, seq, CASE WHEN event_id % 9 <> 4 THEN x END AS g FROM s), k AS (SELECT *, max(CASE WHEN g IS NOT NULL THEN seq END) OVER (PARTITION BY recording_id ORDER BY seq) AS a,
      min(CASE WHEN g IS NOT NULL THEN seq END) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
      SELECT k.recording_id, k.seq, {_r('''CASE WHEN k.g IS NOT NULL THEN k.g WHEN k.a IS NULL THEN y.g WHEN k.b IS NULL THEN x.g ELSE x.g + (y.g - x.g) * ((k.seq - k.a) / (k.b - k.a)) END''', 'filled')}
      FROM k LEFT JOIN g x ON x.recording_id = k.recording_id AND x.seq = k.a LEFT JOIN g y ON y.recording_id = k.recording_id AND y.seq = k.b""",
    "feat_bands": f"WITH {_W64}, {_DFT} SELECT win_no, {_r('sum(p) FILTER (k < 10) / (sum(p) + 1e-12)', 'low')}, {_r('sum(p) FILTER (k >= 10) / (sum(p) + 1e-12)', 'middle')} FROM pw GROUP BY 1",
    "feat_spectral": f"WITH {_W64}, {_DFT} SELECT win_no, {_r('sum(p * k) / (sum(p) + 1e-12)', 'centroid')}, {_r('exp(avg(ln(p + 1e-12))) / (avg(p) + 1e-12)', 'flatness')} FROM pw GROUP BY 1",
    "feat_wavelet_energy": _wavelet(4, False),
    "t2_wavelet": _wavelet(5, True),
    "confusion_matrix": f"WITH {_LABEL}, {_windows(source='s')}, q AS (SELECT (label > 0)::INT AS label, (round({_RMS}, 6) > 60)::INT AS predicted FROM w JOIN hl ON hl.recording_id = w.recording_id AND hl.seq = 64 + (w.win_no - 1) * 16) SELECT label, predicted, count(*) AS n FROM q GROUP BY ALL",
    "class_report": f"""WITH {_LABEL}, {_windows(source='s')}, q AS (SELECT (label > 0)::INT AS label, (round({_RMS}, 6) > 60)::INT AS predicted FROM w JOIN hl ON hl.recording_id = w.recording_id AND hl.seq = 64 + (w.win_no - 1) * 16),
      t AS (SELECT c AS class, count(*) FILTER (label = c AND predicted = c) AS tp, count(*) FILTER (label = c) AS a, count(*) FILTER (predicted = c) AS g FROM q, (VALUES (0), (1)) v(c) GROUP BY c),
      pr AS (SELECT class, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS p, CASE WHEN a > 0 THEN tp / a ELSE 0 END AS rc, a FROM t)
      SELECT class, {_r('p', 'precision', 9)}, {_r('rc', 'recall', 9)}, {_r('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END', 'f1', 9)}, a AS support FROM pr""",
    "lpt_plan": """WITH RECURSIVE j AS (SELECT job, w, row_number() OVER (ORDER BY w DESC, job) AS rn FROM (VALUES ('j0', 100), ('j1', 80), ('j2', 40), ('j3', 20), ('j4', 60), ('j5', 60), ('j6', 10)) v(job, w)),
      p AS (SELECT 0::BIGINT AS rn, ''::VARCHAR AS job, -1::INT AS batch, [0, 0, 0] AS loads
      UNION ALL SELECT j.rn, j.job, (list_position(loads, list_min(loads)) - 1)::INT, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + j.w ELSE x END)
      FROM p JOIN j ON j.rn = p.rn + 1) SELECT job, batch FROM p WHERE rn > 0""",
}
ORACLE["stratified_even_sample"] = """WITH r AS (SELECT (o_custkey % 5 * o_custkey % 3)::INT AS label, o_orderkey AS seq FROM orders),
  c AS (SELECT label, count(*) AS n, greatest(1, 500 * count(*) // (SELECT count(*) FROM r)) AS base FROM r GROUP BY 1),
  a AS (SELECT *, base + CASE WHEN n - base = max(n - base) OVER () THEN 500 - sum(base) OVER () ELSE 0 END AS amount FROM c),
  p AS (SELECT r.*, row_number() OVER (PARTITION BY label ORDER BY seq) - 1 AS place FROM r),
  t AS (SELECT label, unnest(list_transform(range(0, amount::BIGINT), lambda k: floor(k * ((n - 1)::DOUBLE / (amount - 1)))::BIGINT)) AS place FROM a)
  SELECT label, seq FROM p JOIN t USING (label, place)"""
ORACLE["label_accuracy"] = f"""WITH {_LABEL}, {_windows(source='s')}, q AS (SELECT w.recording_id, label = 0 AS fine, round({_RMS}, 6) <= 60 AS guess FROM w JOIN hl ON hl.recording_id = w.recording_id AND hl.seq = 64 + (w.win_no - 1) * 16)
  SELECT recording_id, count(*) AS n, {_r('avg((fine = guess)::INT)', 'accuracy', 9)} FROM q GROUP BY 1"""
ORACLE["complete_jobs"] = """SELECT c_custkey AS job FROM customer
  WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)"""
ORACLE["common_keys"] = "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)"
ORACLE["dataset_fingerprint"] = """WITH h AS (SELECT sha256(o_orderkey::VARCHAR || chr(9) || o_custkey::VARCHAR) AS h FROM orders),
  p AS (SELECT h[1:3] AS part, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
  SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY part)) AS fingerprint FROM p"""
