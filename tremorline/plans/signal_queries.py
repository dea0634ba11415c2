"""Registered queries: detection, cropping, filters and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorline.operators import crop, detect, preprocess, spectrum
from tremorline.plans import bindings as b
from tremorline.plans.registry import query

# Parameters scaled to the test series: 20-sample frames, low threshold.
PARAMS = crop.CropParams(threshold=1.0, indent=8, cooling=20, max_time=100, frame_len=b.FRAME)

DETECT = f"""{b.FRAMES}, fs AS (
  SELECT zone, frame_no, count(*) AS n, min(sample_idx) AS first_sample, stddev_pop(value) AS std, min(value) AS lo,
         max(value) AS hi, median(value) AS median,
         min({{'v': value, 'i': sample_idx}}).i AS argmin, -max({{'v': value, 'i': -sample_idx}}).i AS argmax
  FROM frames GROUP BY zone, frame_no),
det AS (
  SELECT f.*, z.std AS noise_std, f.std / nullif(z.std, 0) AS ratio,
         CASE WHEN z.std = 0 THEN f.std > 0 ELSE f.std / z.std > 1.0 END AS detected,
         CASE WHEN f.hi - f.median < f.median - f.lo THEN f.argmin ELSE f.argmax END - f.first_sample AS peak
  FROM fs f JOIN fs z ON z.zone = f.zone AND z.frame_no = 0)"""

MACHINE = f"""WITH RECURSIVE {DETECT}, machine AS (
  SELECT zone, frame_no, false AS rec, 0::BIGINT AS cooling, 0::BIGINT AS cached, frame_no AS last_no, n AS last_n,
         'idle' AS status, 0::BIGINT AS n_samples, 0::BIGINT AS start_frame, 0::BIGINT AS start_skip,
         0::BIGINT AS first_frame, 0::BIGINT AS first_skip
  FROM det WHERE frame_no = 0
  UNION ALL
  SELECT zone, d_no,
    CASE WHEN fin THEN false ELSE rec OR detected END,
    CASE WHEN fin OR detected OR NOT rec THEN 0 ELSE cooling + n END,
    CASE WHEN fin THEN 0
         WHEN detected AND NOT rec AND peak > 8 THEN n - (peak - 8)
         WHEN detected AND NOT rec AND peak = 8 THEN n + last_n
         WHEN detected AND NOT rec THEN n + least(8 - peak, last_n)
         WHEN rec THEN cached + n ELSE 0 END,
    CASE WHEN fin THEN last_no ELSE d_no END,
    CASE WHEN fin THEN last_n ELSE n END,
    CASE WHEN fin THEN 'emitted' WHEN rec OR detected THEN 'recording' ELSE 'idle' END,
    CASE WHEN fin THEN cached ELSE 0 END,
    CASE WHEN NOT fin AND detected AND NOT rec THEN d_no ELSE start_frame END,
    CASE WHEN NOT fin AND detected AND NOT rec THEN greatest(peak - 8, 0) ELSE start_skip END,
    CASE WHEN NOT fin AND detected AND NOT rec THEN CASE WHEN peak > 8 THEN d_no ELSE last_no END ELSE first_frame END,
    CASE WHEN NOT fin AND detected AND NOT rec
         THEN CASE WHEN peak > 8 THEN peak - 8 WHEN peak = 8 THEN 0 ELSE greatest(last_n - (8 - peak), 0) END
         ELSE first_skip END
  FROM (SELECT m.*, d.frame_no AS d_no, d.n, d.detected, d.peak,
               m.cached > 100 OR (m.rec AND NOT d.detected AND m.cooling > 20) AS fin
        FROM machine m JOIN det d ON d.zone = m.zone AND d.frame_no = m.frame_no + 1)),
closed AS (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY frame_no) - 1 AS alarm_no
  FROM machine WHERE status = 'emitted')"""


@query("noise_fit", f"""WITH {b.FRAMES}
SELECT zone, round(stddev_pop(value), 6) AS noise_std, round(avg(value), 6) AS noise_mean
FROM frames WHERE frame_no = 0 GROUP BY zone""")
def noise_fit(spark, sf):
    return b.rounded(detect.noise_fit(b.frame_samples(spark, sf)), "noise_std", "noise_mean")


@query("detect_frames", f"""WITH {DETECT}
SELECT zone, frame_no, n, round(std, 6) AS std, round(ratio, 6) AS ratio, detected FROM det""")
def detect_frames(spark, sf):
    out = crop.detected_frames(b.frame_samples(spark, sf), PARAMS)
    return b.rounded(out.select("zone", "frame_no", "n", "std", "ratio", "detected"), "std", "ratio")


@query("onset_indent", f"""WITH {DETECT}
SELECT d.zone, d.frame_no, CAST(d.peak AS BIGINT) AS peak, CAST(greatest(d.peak - 8, 0) AS BIGINT) AS skip,
       CAST(CASE WHEN d.peak > 8 THEN 0 WHEN d.peak = 8 THEN p.n ELSE least(8 - d.peak, p.n) END AS BIGINT)
         AS from_previous
FROM det d JOIN det p ON p.zone = d.zone AND p.frame_no = d.frame_no - 1 WHERE d.detected""")
def onset_indent(spark, sf):
    return crop.onset_indent(b.frame_samples(spark, sf), PARAMS)


CROP_SQL = f"""{MACHINE}
SELECT zone, alarm_no, first_frame, first_skip, frame_no AS close_frame, n_samples FROM closed"""


@query("crop_alarms", CROP_SQL)
def crop_alarms(spark, sf):
    return crop.crop_alarms(b.frame_samples(spark, sf), PARAMS)


@query("crop_alarms_uneven", f"""{MACHINE.replace(b.FRAMES, b.UNEVEN_FRAMES)},
numbers AS (SELECT DISTINCT zone, frame_no, raw_no FROM frames)
SELECT c.zone, c.alarm_no, f.raw_no AS first_frame, c.first_skip, l.raw_no AS close_frame, c.n_samples
FROM closed c JOIN numbers f ON f.zone = c.zone AND f.frame_no = c.first_frame
JOIN numbers l ON l.zone = c.zone AND l.frame_no = c.frame_no""")
def crop_alarms_uneven(spark, sf):
    """Frames far shorter than the nominal length, of changing lengths and with gaps in their numbers."""
    return crop.crop_alarms(b.uneven_frames(spark, sf), PARAMS)


@query("pending_alarm_status", f"""{MACHINE}
SELECT zone, frame_no, status, rec AS alarm_flag, cached FROM machine""")
def pending_alarm_status(spark, sf):
    out = crop.frame_status(b.frame_samples(spark, sf), PARAMS)
    return out.select("zone", "frame_no", "status", "alarm_flag", "cached")


@query("replay_trace_log", f"""{MACHINE}
SELECT m.zone, m.frame_no, d.first_sample AS from_idx, d.first_sample + 20 AS to_idx, round(d.ratio, 6) AS ratio,
       m.rec AS alarm_flag, m.cached
FROM machine m JOIN det d ON d.zone = m.zone AND d.frame_no = m.frame_no""")
def replay_trace_log(spark, sf):
    out = crop.frame_status(b.frame_samples(spark, sf), PARAMS)
    return b.rounded(out.drop("status"), "ratio")


@query("alarm_samples", f"""{MACHINE}, pieces AS (
  SELECT zone, alarm_no, first_frame AS frame_no, first_skip AS skip, 0 AS ord FROM closed WHERE first_frame < start_frame
  UNION ALL
  SELECT zone, alarm_no, unnest(range(start_frame, frame_no)) AS frame_no, NULL, 1 FROM closed)
SELECT p.zone, p.alarm_no, row_number() OVER (PARTITION BY p.zone, p.alarm_no ORDER BY p.ord, s.sample_idx) - 1 AS time,
       s.sample_idx, s.value
FROM pieces p JOIN closed c ON c.zone = p.zone AND c.alarm_no = p.alarm_no
JOIN frames s ON s.zone = p.zone AND s.frame_no = p.frame_no
JOIN fs ON fs.zone = s.zone AND fs.frame_no = s.frame_no
WHERE s.sample_idx - fs.first_sample >= coalesce(p.skip, CASE WHEN p.frame_no = c.start_frame THEN c.start_skip ELSE 0 END)""")
def alarm_samples(spark, sf):
    return crop.alarm_samples(b.frame_samples(spark, sf), PARAMS)


# --- filters -------------------------------------------------------------------------------------------------------


@query("minmax_normalize", f"""WITH {b.SIG}, {b.NORM}
SELECT id, time, round(signal_raw, 6) AS signal_raw FROM norm""")
def minmax_normalize(spark, sf):
    return b.rounded(preprocess.minmax_normalize(b.signal(spark, sf)), "signal_raw")


@query("rolling_std", f"""WITH {b.SIG}
SELECT id, time, signal_raw, round(stddev_samp(signal_raw)
  OVER (PARTITION BY id ORDER BY time ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING), 6) AS signal_std FROM sig""")
def rolling_std(spark, sf):
    return b.rounded(preprocess.rolling_std(b.signal(spark, sf)), "signal_std")


@query("rolling_mean", f"""WITH {b.SIG}
SELECT id, time, signal_raw, round(avg(signal_raw)
  OVER (PARTITION BY id ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS mean_5, round(avg(signal_raw)
  OVER (PARTITION BY id ORDER BY time ROWS BETWEEN 64 PRECEDING AND 63 FOLLOWING), 9) AS signal_mean FROM sig""")
def rolling_mean(spark, sf):
    short = preprocess.rolling_mean(b.signal(spark, sf), 5).withColumnRenamed("signal_mean", "mean_5")
    return b.rounded(preprocess.rolling_mean(short), "signal_mean", "mean_5", digits=9)


@query("time_channels", f"""WITH {b.channels_sql()}
SELECT id, time, round(signal_raw, 6) AS signal_raw, round(signal_std, 6) AS signal_std,
       round(signal_mean, 6) AS signal_mean FROM chan""")
def time_channels(spark, sf):
    out = preprocess.TimePreprocessing().transform(b.signal(spark, sf))
    return b.rounded(out, "signal_raw", "signal_std", "signal_mean")


SYMMETRIC = """{sig}, sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM sig),
reach AS (SELECT *, time < {w} // 2 OR time >= n - {w} // 2 AS edge, least(time, n - 1 - time) AS r FROM sized),
full_ AS (
  SELECT id, time, signal_raw, n, CASE WHEN edge THEN time - r ELSE time - {w} // 2 END AS lo,
         CASE WHEN edge THEN time + r ELSE time + ({w} - 1) // 2 END AS hi
  FROM reach),
span AS (
  SELECT id, time, signal_raw, lo, CASE WHEN n > 1 AND lo = 0 AND hi = n - 1 THEN hi - 1 ELSE hi END AS hi FROM full_),
smean AS (
  SELECT s.id, s.time, any_value(s.signal_raw) AS signal_raw, any_value(s.lo) AS lo, any_value(s.hi) AS hi,
         avg(o.signal_raw) AS m
  FROM span s JOIN sig o ON o.id = s.id AND o.time BETWEEN s.lo AND s.hi GROUP BY s.id, s.time)"""


@query("sliding_mean_sym", f"""WITH {SYMMETRIC.format(sig=b.SIG, w=5)}
SELECT id, time, round(m, 6) AS sliding_mean FROM smean""")
def sliding_mean_sym(spark, sf):
    return b.rounded(preprocess.sliding_mean_sym(b.signal(spark, sf), 5), "sliding_mean")


@query("sliding_std_sym", f"""WITH {SYMMETRIC.format(sig=b.SIG, w=4)}
SELECT s.id, s.time, round(sqrt(avg((o.signal_raw - o.m) * (o.signal_raw - o.m))), 6) AS sliding_std
FROM smean s JOIN smean o ON o.id = s.id AND o.time BETWEEN s.lo AND s.hi GROUP BY s.id, s.time""")
def sliding_std_sym(spark, sf):
    return b.rounded(preprocess.sliding_std_sym(b.signal(spark, sf), 4), "sliding_std")


@query("adaptive_avg_pool", f"""WITH {b.SIG}, sizes AS (SELECT id, count(*) AS n FROM sig GROUP BY id),
outs AS (SELECT id, n, unnest(range(0, 30)) AS pos FROM sizes)
SELECT o.id, CAST(o.pos AS INTEGER) AS pos, round(avg(s.signal_raw), 6) AS pooled
FROM outs o JOIN sig s ON s.id = o.id AND s.time >= (o.pos * o.n) // 30 AND s.time < ((o.pos + 1) * o.n + 29) // 30
GROUP BY o.id, o.pos""")
def adaptive_avg_pool(spark, sf):
    return b.rounded(preprocess.adaptive_avg_pool(b.signal(spark, sf), 30), "pooled")


@query("cwt_scalogram", f"""WITH {b.SIG}, kernel AS (
  SELECT a AS scale, lag, exp(-(lag / a::DOUBLE) * (lag / a::DOUBLE) / 2) * cos(5 * lag / a::DOUBLE) / sqrt(a) AS w
  FROM (SELECT a, unnest(range(-8 * a, 8 * a + 1)) AS lag FROM (SELECT unnest(range(1, 9)) AS a)))
SELECT s.id, CAST(k.scale AS INTEGER) AS scale, s.time, round(abs(sum(o.signal_raw * k.w)), 6) AS magnitude,
       round(0.8125 / (k.scale * 0.001), 6) AS frequency
FROM sig s JOIN sig o ON o.id = s.id JOIN kernel k ON k.lag = o.time - s.time
GROUP BY s.id, k.scale, s.time""")
def cwt_scalogram(spark, sf):
    out = preprocess.cwt_scalogram(b.signal(spark, sf), list(range(1, 9)))
    return b.rounded(out, "magnitude", "frequency")


# --- spectra -------------------------------------------------------------------------------------------------------

DFT = """dft AS (
  SELECT s.id, k.k, n, sqrt(power(sum(x * cos(2 * pi() * ((k.k * s.time) % n) / n)), 2)
                          + power(sum(x * sin(2 * pi() * ((k.k * s.time) % n) / n)), 2)) AS a
  FROM (SELECT id, time, {x} AS x, count(*) OVER (PARTITION BY id) AS n FROM {src}) s,
       LATERAL (SELECT unnest(range(0, s.n // 2 + 1)) AS k) k
  GROUP BY s.id, k.k, n)"""

SPEC = f"""{b.SIG}, {DFT.format(x='signal_raw', src='sig')}, amp AS (
  SELECT id, k, n, k * 1000.0 / n AS freq, 2.0 / n * a AS amplitude FROM dft WHERE k > 0),
binned AS (
  SELECT id, CAST(floor(round(10 * ln(k) / ln(n // 2), 9)) AS BIGINT) AS bin, amplitude FROM amp WHERE k < n // 2),
spec AS (
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY bin) - 1 AS INTEGER) AS freq_num,
         avg(amplitude) AS signal_binned_fft
  FROM binned GROUP BY id, bin)"""


@query("amplitude_spectrum", f"""WITH {SPEC}
SELECT id, k, round(freq, 9) AS freq, round(amplitude, 9) AS amplitude FROM amp""")
def amplitude_spectrum(spark, sf):
    out = spectrum.amplitude_spectrum(b.signal(spark, sf), fs=1000)
    return b.rounded(out, "freq", "amplitude", digits=9)


@query("logbin_spectrum", f"""WITH {SPEC}
SELECT id, freq_num, round(signal_binned_fft, 6) AS signal_binned_fft FROM spec""")
def logbin_spectrum(spark, sf):
    return b.rounded(spectrum.FreqPreprocessing(n_bins=10, fs=1000).transform(b.signal(spark, sf)), "signal_binned_fft")
