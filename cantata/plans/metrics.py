"""Measures of latency, drift, pitch and stems, whole; ORACLE holds a second reading of each in another form."""

Q, ORACLE = {}, {}


def _q(name, needs, tables, sql, oracle):
    Q[name], ORACLE[name] = (needs, tables, sql), oracle


# Latency: at least 30 values; floor of the midpoint, nearest-rank percentiles of values and of their distances from the median
_ROUND_TRIPS = "trips AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) * 37 - 900 + l_partkey % 11 AS q FROM lineitem)"
_LATENCY = f"""
    {_ROUND_TRIPS}, ranked AS (SELECT l_suppkey, q, row_number() OVER (PARTITION BY l_suppkey ORDER BY q) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM trips),
    mids AS (SELECT l_suppkey, n, CAST(floor(sum(CASE WHEN r = floor((n + 1) / 2) OR r = floor((n + 2) / 2) THEN q END) / max(CASE WHEN n % 2 = 1 THEN 1 ELSE 2 END)) AS BIGINT) AS median_samples,
                    max(CASE WHEN r = floor((n * 95 + 99) / 100) THEN q END) AS p95_samples, stddev_samp(q) AS sd FROM ranked GROUP BY l_suppkey, n HAVING n >= 30),
    away AS (SELECT t.l_suppkey, abs(q - median_samples) AS d, row_number() OVER (PARTITION BY t.l_suppkey ORDER BY abs(q - median_samples)) AS r, n FROM trips t JOIN mids m ON t.l_suppkey = m.l_suppkey),
    latency AS (SELECT m.l_suppkey, m.n, median_samples, p95_samples, sd, d AS p95_abs_deviation_samples FROM mids m JOIN away a ON m.l_suppkey = a.l_suppkey WHERE a.r = floor((a.n * 95 + 99) / 100))"""
_LATENCY_LISTS = f"""
    {_ROUND_TRIPS}, l AS (SELECT l_suppkey, list_sort(list(q)) AS q, stddev_samp(q) AS sd FROM trips GROUP BY l_suppkey HAVING count(*) >= 30),
    m AS (SELECT *, len(q) AS n, CAST(floor((q[(len(q) + 1) // 2] + q[len(q) // 2 + 1]) / 2) AS BIGINT) AS median_samples FROM l),
    latency AS (SELECT l_suppkey, n, median_samples, q[CAST(ceil(n * 0.95) AS BIGINT)] AS p95_samples, sd, list_sort(list_transform(q, lambda v: abs(v - median_samples)))[CAST(ceil(n * 0.95) AS BIGINT)] AS p95_abs_deviation_samples FROM m)"""
_IN_MS = "SELECT l_suppkey, n, median_samples, p95_samples, round(sd, 6) AS sd, p95_abs_deviation_samples, round(median_samples / 48.0E0, 6) AS median_ms, round(p95_samples / 48.0E0, 6) AS p95_ms FROM latency"
_q("latency_summary", [], ["lineitem"], f"WITH {_LATENCY} {_IN_MS}", f"WITH {_LATENCY_LISTS} {_IN_MS}")
_CALIBRATION = "SELECT l_suppkey, -median_samples AS compensation_samples, p95_abs_deviation_samples AS uncertainty_samples FROM latency"
_q("latency_calibration", [], ["lineitem"], f"WITH {_LATENCY} {_CALIBRATION}", f"WITH {_LATENCY_LISTS} {_CALIBRATION}")

# Drift: eight observations that run forwards, over a span, within bounds; the first failing rule names the outcome
_SEEN = "seen AS (SELECT song_id, idx, idx * 480 AS x, idx * 480 + CAST(floor(idx * (song_id % 9 - 4) / 20.0E0) AS BIGINT) + CASE WHEN event_id % 97 = 0 THEN -700 ELSE event_id % 5 END AS y FROM pitch_frame)"
#: Least observations, least span in samples, and the most parts in a million of a drift.
_LEAST, _SPAN, _PPM = 8, 480 * 40, 300
_OUTCOME = f"CASE WHEN n < {_LEAST} THEN 'too_few' WHEN back > 0 THEN 'non_monotonic' WHEN span < {_SPAN} THEN 'span_too_short' WHEN abs(ppm) > {_PPM} THEN 'out_of_range' ELSE 'ok' END"
_SHOWN = f"SELECT song_id, n, span, o AS outcome, CASE WHEN o = 'ok' THEN round(ppm, 3) END AS ppm, CASE WHEN o = 'ok' THEN round(residual, 3) END AS max_residual FROM (SELECT *, {_OUTCOME} AS o FROM drift) d"
_q("drift_slope", ["pitch_frame"], [], f"""
    WITH {_SEEN}, step AS (SELECT song_id, x, y, CASE WHEN y <= lag(y) OVER (PARTITION BY song_id ORDER BY x) THEN 1 ELSE 0 END AS back, CAST(x - min(x) OVER (PARTITION BY song_id) AS DOUBLE) AS u, CAST(y - first_value(y) OVER (PARTITION BY song_id ORDER BY x) AS DOUBLE) AS v FROM seen),
    mean AS (SELECT *, u - avg(u) OVER (PARTITION BY song_id) AS du, v - avg(v) OVER (PARTITION BY song_id) AS dv FROM step),
    line AS (SELECT *, sum(du * dv) OVER (PARTITION BY song_id) / sum(du * du) OVER (PARTITION BY song_id) AS slope FROM mean),
    drift AS (SELECT song_id, count(*) AS n, max(x) - min(x) AS span, sum(back) AS back, (max(slope) - 1) * 1000000 AS ppm, max(abs(dv - slope * du)) AS residual FROM line GROUP BY song_id)
    {_SHOWN}""".replace("sum(du * dv) OVER (PARTITION BY song_id) / sum(du * du) OVER (PARTITION BY song_id)", "sum(du * dv) OVER (PARTITION BY song_id) / nullif(sum(du * du) OVER (PARTITION BY song_id), 0)"),
   f"""
    WITH {_SEEN}, fit AS (SELECT song_id, count(*) AS n, max(x) - min(x) AS span, regr_slope(y - x, x) AS extra, avg(x) AS mx, avg(y - x) AS mz FROM seen GROUP BY song_id),
    late AS (SELECT a.song_id, count(*) AS back FROM seen a JOIN seen b ON a.song_id = b.song_id AND b.idx = a.idx + 1 AND b.y <= a.y GROUP BY a.song_id),
    res AS (SELECT s.song_id, max(abs((y - x) - (mz + extra * (x - mx)))) AS residual FROM seen s JOIN fit f ON s.song_id = f.song_id GROUP BY s.song_id),
    drift AS (SELECT f.song_id, n, span, coalesce(back, 0) AS back, CASE WHEN span > 0 THEN extra * 1000000 END AS ppm, residual FROM fit f LEFT JOIN late USING (song_id) JOIN res USING (song_id))
    {_SHOWN}""")

# Pitch: detected against reference, with misses, false voices and octaves
_PITCH = """
    pairs AS (SELECT song_id, f0_hz AS ref, CASE WHEN f0_hz IS NULL THEN CASE WHEN event_id % 11 = 0 THEN 120.0E0 END WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN f0_hz * 2 WHEN event_id % 17 = 0 THEN f0_hz / 4.1E0 ELSE f0_hz * pow(2.0E0, (event_id % 83 - 40) / 1200.0E0) END AS hz FROM pitch_frame),
    errs AS (SELECT song_id, ref, hz, CASE WHEN ref IS NOT NULL AND hz IS NOT NULL THEN abs(1200 * log2(hz / ref)) END AS e FROM pairs)"""
_q("pitch_metrics", ["pitch_frame"], [], f"""
    WITH {_PITCH}, one AS (SELECT *, rint(e / 1200) AS k FROM errs)
    SELECT song_id, count(*) AS frames, count(ref) AS voiced, count(*) - count(ref) AS unvoiced, round(count(e) / nullif(count(ref), 0), 6) AS voiced_recall,
           round(count(CASE WHEN ref IS NULL THEN hz END) / nullif(count(*) - count(ref), 0), 6) AS false_positive_rate, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY e), 4) AS median_cents, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY e), 4) AS p95_cents,
           round(count_if(ref IS NOT NULL AND (hz IS NULL OR e > 50)) / nullif(count(ref), 0), 6) AS gross_rate, round(count_if(k >= 1 AND abs(e - k * 1200) <= 100) / nullif(count(ref), 0), 6) AS octave_rate
    FROM one GROUP BY song_id""",
   f"""
    WITH {_PITCH}, l AS (SELECT song_id, count(*) AS frames, count(ref) AS voiced, list_sort(list(e) FILTER (e IS NOT NULL)) AS e, count(*) FILTER (ref IS NULL AND hz IS NOT NULL) AS wrong FROM errs GROUP BY song_id),
    p AS (SELECT *, len(e) AS n, list_filter(e, lambda x: x > 50) AS far, list_filter(e, lambda x: x >= 600 AND least(x % 1200, 1200 - x % 1200) <= 100) AS octaves FROM l)
    SELECT song_id, frames, voiced, frames - voiced AS unvoiced, round(coalesce(n, 0) / nullif(voiced, 0), 6) AS voiced_recall, round(wrong / nullif(frames - voiced, 0), 6) AS false_positive_rate,
           round((e[(n + 1) // 2] + e[n // 2 + 1]) / 2, 4) AS median_cents, round(e[1 + CAST(floor((n - 1) * 0.95) AS BIGINT)] + ((n - 1) * 0.95 - floor((n - 1) * 0.95)) * (e[least(n, 2 + CAST(floor((n - 1) * 0.95) AS BIGINT))] - e[1 + CAST(floor((n - 1) * 0.95) AS BIGINT)]), 4) AS p95_cents,
           round((voiced - coalesce(n, 0) + coalesce(len(far), 0)) / nullif(voiced, 0), 6) AS gross_rate, round(coalesce(len(octaves), 0) / nullif(voiced, 0), 6) AS octave_rate FROM p""")

# Stems: zero-mean scale-invariant ratio with its floor, its gain over the mix, the plain ratio, the error and the peak of the sum
_STEMS = """
    stems AS (SELECT song_id, value - 50 AS rv, (event_id % 31 - 15) * 1.0E0 AS rb, CASE WHEN song_id % 7 = 0 THEN 0.0E0 ELSE (value - 50) * 0.9E0 + (event_id % 3 - 1) END AS v, CASE WHEN song_id % 11 = 0 THEN value - 50 ELSE (event_id % 31 - 15) + (event_id % 5) * 0.1E0 END AS b FROM pitch_frame WHERE value IS NOT NULL)"""


def _ratio(e, r="rv"):
    """The ratio from centred sums: silent reference undefined, silent estimate -120, a floor of a millionth of a millionth of the reference."""
    xx, yy, xy = f"{r}_{r}", f"{e}_{e}", f"{r}_{e}"
    return f"CASE WHEN {xx} <= 1E-20 THEN NULL WHEN {yy} <= 1E-20 THEN -120.0E0 ELSE 10 * log10(greatest({xy} * {xy} / {xx}, {xx} * 1E-12) / greatest({yy} - {xy} * {xy} / {xx}, {xx} * 1E-12)) END"


_PAIRS = [("rv", "rv"), ("rb", "rb"), ("v", "v"), ("b", "b"), ("m", "m"), ("rv", "v"), ("rb", "b"), ("rv", "m"), ("rb", "m")]
_MEASURES = f"""
    SELECT song_id, round({_ratio("v")}, 3) AS vocals_si_sdr, round(({_ratio("v")}) - ({_ratio("m")}), 3) AS vocals_si_sdri, round({_ratio("b", "rb")}, 3) AS backing_si_sdr,
           round(CASE WHEN ref_v > 1E-20 THEN 10 * log10(ref_v / greatest(err_v, ref_v * 1E-12)) END, 3) AS vocals_sdr, round(sqrt(err_v / n), 6) AS vocals_rms, round(sqrt(err_b / n), 6) AS backing_rms, round(peak, 6) AS peak_error FROM sums"""
_q("si_sdr", ["pitch_frame"], [], f"""
    WITH {_STEMS}, mix AS (SELECT *, rv + rb AS m FROM stems),
    centred AS (SELECT song_id, power(rv - v, 2) AS ev, power(rb - b, 2) AS eb, rv * rv AS pv, abs(v + b - m) AS gap, {", ".join(f"{c} - avg({c}) OVER (PARTITION BY song_id) AS {c}" for c in ("rv", "rb", "v", "b", "m"))} FROM mix),
    sums AS (SELECT song_id, count(*) AS n, sum(ev) AS err_v, sum(eb) AS err_b, sum(pv) AS ref_v, max(gap) AS peak, {", ".join(f"sum({a} * {b}) AS {a}_{b}" for a, b in _PAIRS)} FROM centred GROUP BY song_id)
    {_MEASURES}""",
   f"""
    WITH {_STEMS}, mix AS (SELECT *, rv + rb AS m FROM stems),
    sums AS (SELECT song_id, count(*) AS n, sum((rv - v) ** 2) AS err_v, sum((rb - b) ** 2) AS err_b, sum(rv ** 2) AS ref_v, max(abs(v + b - m)) AS peak, {", ".join(f"count(*) * covar_pop({a}, {b}) AS {a}_{b}" for a, b in _PAIRS)} FROM mix GROUP BY song_id)
    {_MEASURES}""")
