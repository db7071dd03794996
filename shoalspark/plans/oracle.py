"""SQL twins of the registered queries, written from the plain row-wise definitions."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def twin(name: str, ctes: str, body: str, doubles: str = "") -> None:
    """Register ``WITH ctes body``; the ``doubles`` columns are rounded like the Spark side."""
    inner = f"WITH {ctes} {body}" if ctes else body
    if doubles:
        cols = ", ".join(f"round({c} * (1e0 + 1e-11), 6) + 0e0 AS {c}" for c in doubles.split())
        inner = f"SELECT * REPLACE ({cols}) FROM ({inner}) AS q"
    ORACLE[name] = inner


FRAMES = """
clock AS (
  SELECT *, (epoch_us(ts) - 1704067200000000) // 21600000 AS cs FROM events
), raw AS (
  SELECT CAST(user_id AS VARCHAR) AS fish, user_id,
    CASE user_id % 3 WHEN 0 THEN 'C8AHL' WHEN 1 THEN 'C8DMS0' ELSE 'menthe' END AS treatment,
    CASE WHEN (user_id // 3) % 2 = 0 THEN 'Right' ELSE 'Left' END AS cue_side,
    cs // 50 AS frame,
    lpad(CAST(cs // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((cs // 100) % 60 AS VARCHAR), 2, '0')
      || '.' || lpad(CAST(cs % 100 AS VARCHAR), 2, '0') AS time,
    CASE WHEN event_type <> 'error' THEN (value + 1) / (value + 40) END AS olf_x,
    (CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) + 1) / 102 AS olf_y,
    CASE WHEN event_type <> 'error' THEN value END AS speed,
    CASE WHEN event_type <> 'error' THEN value / 10 END AS distance
  FROM clock
), timed AS (
  SELECT *, CAST(substr(time, 4, 2) AS INTEGER) AS second,
    60 * CAST(substr(time, 1, 2) AS INTEGER) + CAST(substr(time, 4, 2) AS INTEGER)
      + CAST(substr(time, 7, 2) AS INTEGER) * 1e-2 AS secs,
    CAST(substr(time, 1, 2) AS INTEGER) + 1 AS minute,
    CASE WHEN cue_side = 'Right' THEN olf_x WHEN cue_side <> 'Right' THEN 1 - olf_x END AS cue_x
  FROM raw
), frames AS (
  SELECT *,
    CASE WHEN olf_x < 0.5 THEN 'Left' WHEN olf_x >= 0.5 THEN 'Right' END AS zone_side,
    CASE WHEN cue_x < 0.5 THEN 'control' WHEN cue_x >= 0.5 THEN 'cue' END AS zone_cue,
    CASE WHEN secs >= 600 THEN 'After' ELSE 'Before' END AS part,
    CAST(CASE WHEN secs >= 600 THEN 1 ELSE 0 END AS INTEGER) AS part_ord,
    CAST(floor(secs) AS BIGINT) + 1 AS bucket,
    max(frame) OVER (PARTITION BY fish, treatment) AS max_frame
  FROM timed
), lagged AS (
  SELECT *, CASE WHEN frame <> 0 THEN 1200e0 / nullif(max_frame, 0) END AS timelag FROM frames
)"""

PARTS = "(VALUES ('Before'), ('After')) AS p(part)"
CUES = "(VALUES ('control'), ('cue')) AS z(zone_cue)"
SIDES = "(VALUES ('Left'), ('Right')) AS z(zone_side)"
MINUTES = "(SELECT CAST(range AS INTEGER) AS minute FROM range(1, 21)) AS m"
FISH = "(SELECT DISTINCT fish, treatment FROM lagged) AS e"
# every frame of a fish stands for the same time, so equal counts give exactly equal sums
SUM = "count(timelag) * 1200e0 / nullif(max(max_frame), 0)"
SHARE = "CASE WHEN sum = 0 THEN 0e0 ELSE 100 * (sum / total_sum) END AS ratioside"
AVG4 = ("avg({0}) AS avg, stddev_samp({0}) AS sd, count({0}) AS n, "
        "stddev_samp({0}) / sqrt(nullif(count({0}), 0)) AS se")

CUE_PART = FRAMES + f""", part_cells AS (
  SELECT e.fish, e.treatment, e.cue_side, p.part, z.zone_cue, coalesce(s.sum, 0) AS sum
  FROM (SELECT DISTINCT fish, treatment, cue_side FROM lagged) AS e CROSS JOIN {PARTS} CROSS JOIN {CUES}
  LEFT JOIN (SELECT fish, treatment, part, zone_cue, {SUM} AS sum FROM lagged
             GROUP BY ALL) AS s USING (fish, treatment, part, zone_cue)
), cue_part AS (
  SELECT * FROM (SELECT *, {SHARE} FROM (
    SELECT *, sum(sum) OVER (PARTITION BY fish, treatment, part) AS total_sum FROM part_cells) AS t) AS u
  WHERE zone_cue = 'cue'
), cue_pairs AS (
  SELECT fish, treatment, max(CASE WHEN part = 'Before' THEN ratioside END) AS "Before",
    max(CASE WHEN part = 'After' THEN ratioside END) AS "After"
  FROM cue_part GROUP BY fish, treatment
), cue_diff AS (SELECT *, "Before" - "After" AS diff FROM cue_pairs)"""


def minute_cells(zone: str, zones: str) -> str:
    return FRAMES + f""", minute_cells AS (
  SELECT e.fish, e.treatment, m.minute, z.{zone}, coalesce(s.sum, 0) AS sum,
    CASE WHEN m.minute <= 10 THEN 'Before' ELSE 'After' END AS part
  FROM {FISH} CROSS JOIN {MINUTES} CROSS JOIN {zones}
  LEFT JOIN (SELECT fish, treatment, minute, {zone}, {SUM} AS sum FROM lagged
             GROUP BY ALL) AS s USING (fish, treatment, minute, {zone})
), minute_share AS (
  SELECT *, {SHARE} FROM (
    SELECT *, sum(sum) OVER (PARTITION BY fish, treatment, minute) AS total_sum FROM minute_cells) AS t
)"""


CUE_MINUTE = minute_cells("zone_cue", CUES) + ", cue_minute AS (SELECT * FROM minute_share WHERE zone_cue = 'cue')"

SPEED = FRAMES + """, speed_sec AS (
  SELECT fish, treatment, part, minute, second, median(speed) AS speedsec FROM lagged GROUP BY ALL
), speed_min AS (
  SELECT fish, treatment, part, minute, avg(speedsec) AS m1, stddev_samp(speedsec) AS sd,
    count(speedsec) AS n, stddev_samp(speedsec) / sqrt(nullif(count(speedsec), 0)) AS se
  FROM speed_sec GROUP BY ALL
), speed_part AS (
  SELECT fish, treatment, part, avg(m1) AS mean_speed FROM speed_min GROUP BY ALL
), speed_pairs AS (
  SELECT fish, treatment, max(CASE WHEN part = 'Before' THEN mean_speed END) AS "Before",
    max(CASE WHEN part = 'After' THEN mean_speed END) AS "After"
  FROM speed_part GROUP BY fish, treatment
), speed_diff AS (SELECT *, "After" - "Before" AS diff FROM speed_pairs)"""

DISTANCE = FRAMES + """, dist AS (
  SELECT fish, treatment, part, minute, coalesce(sum(distance), 0) AS sumdist FROM lagged GROUP BY ALL
)"""

# --- enrichment and quality
twin("cue_share_by_part", CUE_PART,
     f"SELECT part, treatment, {AVG4.format('ratioside')} FROM cue_part GROUP BY part, treatment",
     "avg sd se")
twin("frames_enriched", FRAMES,
     """SELECT fish, treatment, fish || '_' || treatment AS fish_id, frame, secs, second, minute, bucket, cue_x,
     olf_y, zone_side, zone_cue, part, part_ord, max_frame, timelag FROM lagged""",
     "secs cue_x olf_y timelag")
twin("time_lag_summary", FRAMES,
     """SELECT fish, treatment, max(max_frame) AS max_frame, count(timelag) AS lagged, sum(timelag) AS seconds
     FROM lagged GROUP BY fish, treatment""", "seconds")
twin("file_metadata", FRAMES,
     """SELECT CASE WHEN ok THEN 'zebra' END AS species, CASE WHEN ok THEN 'e1' END AS experiment,
       CASE WHEN ok THEN treatment END AS treatment, CASE WHEN ok THEN cue_side END AS cue_side,
       CASE WHEN ok THEN fish END AS fish_replicate, count(*) AS rows
     FROM (SELECT *, user_id % 7 <> 0 AS ok FROM raw) AS r GROUP BY ALL""")
twin("untracked_rows", FRAMES,
     "SELECT fish, treatment, part, count(*) AS rows FROM lagged WHERE zone_side IS NULL GROUP BY ALL")
twin("untracked_frames", FRAMES,
     "SELECT fish, treatment, frame, secs, minute, part FROM lagged WHERE zone_side IS NULL", "secs")
twin("duplicate_frames", FRAMES,
     "SELECT fish, treatment, frame, count(*) AS rows FROM lagged GROUP BY ALL HAVING count(*) > 1")
twin("duplicate_frame_rows", FRAMES,
     """SELECT fish, treatment, frame, secs, cue_x FROM (
       SELECT *, count(*) OVER (PARTITION BY fish, treatment, frame) AS c FROM lagged) AS t WHERE c > 1""",
     "secs cue_x")
twin("cohort_rows", FRAMES,
     """SELECT fish, treatment, count(*) AS rows, min(frame) AS first_frame, max(frame) AS last_frame FROM lagged
     WHERE fish <> '13' AND ((treatment = 'C8DMS0' AND user_id < 21) OR treatment = 'C8AHL') GROUP BY fish, treatment""")
twin("complete_rows", FRAMES,
     """SELECT treatment, CASE WHEN minute <= 10 THEN 'first' ELSE 'second' END AS segment, count(*) AS rows,
       avg(speed) AS speed FROM lagged
     WHERE cue_x IS NOT NULL AND olf_y IS NOT NULL AND speed IS NOT NULL GROUP BY ALL""", "speed")
twin("treatment_levels", FRAMES,
     """SELECT treatment, part, CAST(CASE treatment WHEN 'C8DMS0' THEN 0 WHEN 'C8AHL' THEN 1 ELSE 2 END AS INTEGER)
       AS treatment_ord, CAST(treatment = 'C8AHL' AS INTEGER) AS "treatment_C8AHL",
       CAST(treatment = 'menthe' AS INTEGER) AS treatment_menthe,
       CASE part WHEN 'Before' THEN 'Avant' ELSE 'Après' END AS partie,
       CASE treatment WHEN 'menthe' THEN 'mint' ELSE treatment END AS display,
       part || '.' || treatment AS interaction
     FROM (SELECT DISTINCT treatment, part FROM lagged) AS d""")
twin("part_position_summary", FRAMES,
     f"""SELECT part, treatment, bucket, {AVG4.format('cue_x')} FROM lagged WHERE fish <> '13'
     GROUP BY part, treatment, bucket""", "avg sd se")
twin("position_series", FRAMES, "SELECT fish, treatment, secs, cue_x, part FROM lagged", "secs cue_x")

# --- occupancy
SHARE_COLS = "sum total_sum ratioside"
twin("side_share_minute", minute_cells("zone_side", SIDES),
     """SELECT fish, treatment, minute, zone_side, sum, part, total_sum, ratioside FROM minute_share
     WHERE zone_side = 'Right'""", SHARE_COLS)
twin("cue_share_minute", CUE_MINUTE,
     "SELECT fish, treatment, minute, zone_cue, sum, part, total_sum, ratioside FROM cue_minute", SHARE_COLS)
twin("cue_share_minute_summary", CUE_MINUTE,
     f"""SELECT *, avg - sd AS sd_low, avg + sd AS sd_high, avg - se AS se_low, avg + se AS se_high FROM (
       SELECT part, treatment, minute, {AVG4.format('ratioside')} FROM cue_minute
       GROUP BY part, treatment, minute) AS t""", "avg sd se sd_low sd_high se_low se_high")
twin("cue_share_crossed", FRAMES + f""", cells AS (
  SELECT fish, treatment, minute, zone_cue, {SUM} AS sum FROM lagged WHERE zone_cue IS NOT NULL GROUP BY ALL
), crossed AS (
  SELECT e.fish, t.treatment, m.minute, z.zone_cue, coalesce(c.sum, 0) AS sum,
    CASE WHEN m.minute <= 10 THEN 'Before' ELSE 'After' END AS part
  FROM (SELECT DISTINCT fish FROM cells) AS e CROSS JOIN (SELECT DISTINCT treatment FROM cells) AS t
  CROSS JOIN (SELECT DISTINCT minute FROM cells) AS m CROSS JOIN (SELECT DISTINCT zone_cue FROM cells) AS z
  LEFT JOIN cells AS c USING (fish, treatment, minute, zone_cue)
  WHERE (t.treatment = 'C8DMS0' AND CAST(e.fish AS DOUBLE) < 21) OR t.treatment = 'C8AHL'
), shares AS (
  SELECT *, {SHARE} FROM (
    SELECT *, sum(sum) OVER (PARTITION BY fish, treatment, minute) AS total_sum FROM crossed) AS t
)""", f"""SELECT part, minute, treatment, {AVG4.format('ratioside')} FROM shares WHERE zone_cue = 'cue'
GROUP BY part, minute, treatment""", "avg sd se")
twin("cue_share_untracked", FRAMES + f""", cells AS (
  SELECT fish, treatment, part, zone_cue, {SUM} AS sum FROM lagged GROUP BY ALL
), filled AS (
  SELECT e.fish, e.treatment, z.zone_cue, p.part, coalesce(c.sum, 0) AS sum
  FROM {FISH} CROSS JOIN {PARTS} CROSS JOIN (VALUES ('control'), ('cue'), (NULL)) AS z(zone_cue)
  LEFT JOIN cells AS c ON c.fish = e.fish AND c.treatment = e.treatment AND c.part = p.part
    AND c.zone_cue IS NOT DISTINCT FROM z.zone_cue
)""", f"""SELECT *, {SHARE} FROM (
  SELECT *, sum(sum) OVER (PARTITION BY fish, treatment, part) AS total_sum FROM filled) AS t""", SHARE_COLS)
twin("side_share_part", FRAMES + f""", cells AS (
  SELECT fish, treatment, part, zone_side, coalesce({SUM}, 0) AS sum FROM lagged
  WHERE zone_side IS NOT NULL GROUP BY ALL
)""", f"""SELECT * FROM (SELECT *, {SHARE} FROM (
  SELECT *, sum(sum) OVER (PARTITION BY fish, treatment, part) AS total_sum FROM cells) AS t) AS u
WHERE zone_side = 'Right'""", SHARE_COLS)
twin("cue_share_part", CUE_PART,
     "SELECT fish, treatment, cue_side, part, zone_cue, sum, total_sum, ratioside FROM cue_part", SHARE_COLS)
twin("attraction_share", CUE_PART,
     """SELECT treatment, part, 100e0 * sum(CASE WHEN ratioside > 50 THEN 1 ELSE 0 END) / count(*) AS attracted_pct,
       100e0 * sum(CASE WHEN ratioside > 50 THEN 0 ELSE 1 END) / count(*) AS repulsed_pct
     FROM cue_part GROUP BY treatment, part""", "attracted_pct repulsed_pct")
twin("attraction_flags", CUE_PART,
     """SELECT fish, treatment, part, CAST(ratioside > 50 AS INTEGER) AS attracted,
       1 - CAST(ratioside > 50 AS INTEGER) AS repulsed FROM cue_part""")
twin("before_after_ratio", CUE_PART,
     """SELECT b.fish, b.treatment, b.cue_side, b.ratioside / nullif(a.ratioside, 0) AS slope
     FROM cue_part AS b JOIN cue_part AS a USING (fish, treatment)
     WHERE b.part = 'Before' AND a.part = 'After' AND b.fish <> '13'""", "slope")

# --- kinematics
twin("speed_per_second", SPEED, "SELECT * FROM speed_sec", "speedsec")
twin("speed_fish_minute", SPEED, "SELECT *, fish || '_' || treatment AS fish_id FROM speed_min", "m1 sd se")
twin("speed_minute", SPEED,
     f"""SELECT *, avg - sd AS sd_low, avg + sd AS sd_high, avg - se AS se_low, avg + se AS se_high FROM (
       SELECT part, treatment, minute, {AVG4.format('m1')} FROM speed_min GROUP BY ALL) AS t""",
     "avg sd se sd_low sd_high se_low se_high")
twin("distance_fish_minute", DISTANCE, "SELECT * FROM dist", "sumdist")
twin("distance_minute", DISTANCE,
     f"SELECT minute, part, {AVG4.format('sumdist')} FROM dist GROUP BY minute, part", "avg sd se")
twin("speed_change", SPEED,
     """SELECT treatment, avg(diff) AS mean_diff,
       CASE WHEN avg(diff) > 0 THEN 'augmentation' ELSE 'baisse' END AS direction
     FROM speed_diff GROUP BY treatment""", "mean_diff")

# --- reshaping
LONG = CUE_MINUTE + """, long AS (
  SELECT fish, treatment, minute, part, total_sum, 'cue' AS compartment, sum AS time FROM cue_minute
  UNION ALL
  SELECT fish, treatment, minute, part, total_sum, 'nocue', total_sum - sum FROM cue_minute
)"""
twin("compartment_long", LONG,
     "SELECT *, CASE WHEN time = 0 THEN 0e0 ELSE 100 * (time / total_sum) END AS ratioside FROM long",
     "time total_sum ratioside")
twin("percent_of_minute", LONG,
     f"""SELECT treatment, CASE compartment WHEN 'cue' THEN 'C8AHL' ELSE 'DMSO' END AS label, part,
       {AVG4.format('(100 * time / 60)')} FROM long GROUP BY ALL""", "avg sd se")
twin("paired_cue_share", CUE_PART, "SELECT * FROM cue_diff", '"Before" "After" diff')
twin("paired_summary_text", CUE_PART,
     """SELECT printf('Before : %.1f %% ± %.1f %%', avg("Before"), stddev_samp("Before")) AS before_text,
       printf('After : %.1f %% ± %.1f %%', avg("After"), stddev_samp("After")) AS after_text,
       printf('Baisse : %.1f %% ± %.1f %%', avg(diff), stddev_samp(diff)) AS diff_text FROM cue_diff""")
CENTERED = SPEED + """, centered AS (
  SELECT fish, treatment, part, minute, m1, minute - avg(minute) OVER (PARTITION BY part) AS minute_centered
  FROM speed_min
)"""
twin("centered_minute", CENTERED, "SELECT * FROM centered", "m1 minute_centered")
twin("real_minute_lookup", CENTERED,
     """SELECT part, treatment, CAST(minute AS BIGINT) AS minute, count(*) AS rows, avg(minute_centered) AS minute_centered FROM centered GROUP BY ALL""", "minute_centered")
twin("minute_relative", CUE_MINUTE,
     f"""SELECT CAST(minute > 10 AS INTEGER) AS part_ord,
       CASE WHEN minute > 10 THEN minute - 10 ELSE minute END AS minute_relative, {AVG4.format('ratioside')}
     FROM cue_minute GROUP BY ALL""", "avg sd se")
twin("covariate_grid", FRAMES,
     f"""SELECT e.fish, e.treatment, p.part, CAST(CASE p.part WHEN 'Before' THEN 1 ELSE 2 END AS INTEGER) AS cov_id
     FROM {FISH} CROSS JOIN {PARTS}""")

twin("speed_table_handoff", SPEED, "SELECT *, fish || '_' || treatment AS fish_id FROM speed_min", "m1 sd se")
twin("marginal_share_interval", CUE_MINUTE + """, per_draw AS (
  SELECT part, treatment, CASE WHEN minute > 10 THEN minute - 10 ELSE minute END AS draw, avg(ratioside) AS prob
  FROM cue_minute GROUP BY ALL
)""", """SELECT part, treatment, quantile_cont(prob, 0.5) AS median, quantile_cont(prob, 0.025) AS lower,
  quantile_cont(prob, 0.975) AS upper FROM per_draw GROUP BY part, treatment""", "median lower upper")

# --- tests. Tail areas by Simpson's rule on the density, 4000 panels.


def t_tail(t: str, df: str) -> str:
    """Two-sided p of Student's t."""
    dens = (f"exp(lgamma(({df} + 1) / 2e0) - lgamma({df} / 2e0)) / sqrt({df} * pi()) "
            f"* pow(1 + pow(abs({t}) * i / 4000e0, 2) / {df}, -({df} + 1) / 2e0)")
    return (f"1 - 2 * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {dens}) "
            f"FROM range(0, 4001) AS r(i)) * abs({t}) / 4000e0 / 3")


def z_tail(z: str) -> str:
    dens = f"exp(-0.5 * pow(abs({z}) * i / 4000e0, 2)) / sqrt(2 * pi())"
    return (f"1 - 2 * (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {dens}) "
            f"FROM range(0, 4001) AS r(i)) * abs({z}) / 4000e0 / 3")


def paired(source: str, keys: str) -> str:
    head, tail = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {head}n, mean_diff, t, n - 1 AS df, {t_tail('t', '(n - 1)')} AS p FROM (
      SELECT {head}count(diff) AS n, avg(diff) AS mean_diff, avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) AS t
      FROM {source} {tail}) AS a"""


def ranks(source: str, keys: str) -> str:
    """V, ties and z of the signed-rank test in the large-sample form."""
    head, part, tail = (f"{keys}, ", f"PARTITION BY {keys}", f"GROUP BY {keys}") if keys else ("", "", "")
    over = f"PARTITION BY {keys}, abs(diff)" if keys else "PARTITION BY abs(diff)"
    return f""", ranked AS (
  SELECT {head}diff, rank() OVER ({part} ORDER BY abs(diff)) + (count(*) OVER ({over}) - 1) / 2e0 AS r,
    count(*) OVER ({over}) AS c FROM {source} WHERE diff <> 0
), rank_sums AS (
  SELECT {head}count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0e0 END) AS v,
    sum(CAST(c * c - 1 AS DOUBLE)) AS ties FROM ranked {tail}
), rank_z AS (
  SELECT *, (v - n * (n + 1) / 4e0 - 0.5 * sign(v - n * (n + 1) / 4e0))
    / sqrt(n * (n + 1) * (2e0 * n + 1) / 24e0 - ties / 48e0) AS z FROM rank_sums
)"""


# exact two-sided p by counting the subsets of 1..n with each sum, for every n in use
EXACT = """, ways AS (
  WITH RECURSIVE w(k, s, c) AS (
    SELECT 0, 0, CAST(1 AS DOUBLE)
    UNION ALL
    SELECT k, s, sum(c) FROM (
      SELECT k + 1 AS k, s, c / 2 AS c FROM w WHERE k < 50
      UNION ALL SELECT k + 1, s + k + 1, c / 2 FROM w WHERE k < 50) AS u GROUP BY k, s
  ) SELECT * FROM w
)"""


def rank_result(source: str, keys: str) -> str:
    head = f"{keys}, " if keys else ""
    same = " AND ".join(f"d.{k} = r.{k}" for k in keys.split(", ")) if keys else "true"
    exact = (f"r.n < 50 AND r.ties = 0 AND NOT EXISTS (SELECT 1 FROM {source} AS d WHERE d.diff = 0 AND {same})")
    p_exact = """least(1e0, 2 * (SELECT sum(c) FROM ways AS w WHERE w.k = r.n
      AND ((r.v > r.n * (r.n + 1) / 4e0 AND w.s >= r.v) OR (r.v <= r.n * (r.n + 1) / 4e0 AND w.s <= r.v))))"""
    return f"""SELECT {head}n, v, z, exact, CASE WHEN exact THEN p_exact ELSE {z_tail('z')} END AS p FROM (
      SELECT {head}n, v, z, {exact} AS exact, {p_exact} AS p_exact FROM rank_z AS r) AS s"""


twin("paired_t", CUE_PART, paired("cue_diff", "treatment"), "mean_diff t p")
twin("paired_t_speed", SPEED, paired("speed_diff", ""), "mean_diff t p")
twin("welch_t", CUE_PART + """, sides AS (
  SELECT count(diff) FILTER (treatment = 'C8AHL') AS n1, count(diff) FILTER (treatment = 'C8DMS0') AS n2,
    avg(diff) FILTER (treatment = 'C8AHL') AS mean1, avg(diff) FILTER (treatment = 'C8DMS0') AS mean2,
    var_samp(diff) FILTER (treatment = 'C8AHL') AS v1, var_samp(diff) FILTER (treatment = 'C8DMS0') AS v2
  FROM cue_diff
), welch AS (
  SELECT n1, n2, mean1, mean2, (mean1 - mean2) / sqrt(v1 / n1 + v2 / n2) AS t,
    pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM sides
)""", f"SELECT *, {t_tail('t', 'df')} AS p FROM welch", "mean1 mean2 t df p")
twin("signed_rank", CUE_PART + ranks("cue_diff", "treatment") + EXACT, rank_result("cue_diff", "treatment"), "v z p")
twin("signed_rank_speed", SPEED + ranks("speed_diff", "") + EXACT, rank_result("speed_diff", ""), "v z p")



def quantile_ctes(name: str, source: str, p: str) -> str:
    """Normal quantile of ``p`` as column z of CTE ``name``: a rational start and three Newton steps,
    the CDF by Simpson's rule with 400 panels."""
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    start = (f"sign({p} - 0.5) * ({tail} - (2.515517e0 + 0.802853e0 * {tail} + 0.010328e0 * pow({tail}, 2)) / "
             f"(1 + 1.432788e0 * {tail} + 0.189269e0 * pow({tail}, 2) + 0.001308e0 * pow({tail}, 3)))")
    out = f", {name}_0 AS (SELECT *, {start} AS z FROM {source})"
    cdf = ("(0.5e0 + (SELECT sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
           "* exp(-0.5e0 * pow(z * i / 400e0, 2))) FROM range(0, 401) AS r(i)) * z / 1200e0 / sqrt(2 * pi()))")
    for k in (1, 2, 3):
        last = name if k == 3 else f"{name}_{k}"
        out += (f", {last} AS (SELECT * REPLACE (z - ({cdf} - {p}) * sqrt(2 * pi()) * exp(z * z / 2) AS z) "
                f"FROM {name}_{k - 1})")
    return out


def poly(coef, x: str) -> str:
    return "(" + " + ".join(f"({c}e0) * pow({x}, {i})" for i, c in enumerate(coef)) + ")"


# Royston's approximation for more than three values; fixed values: the published coefficients
SHAPIRO = SPEED + """, sw_rows AS (
  SELECT treatment, diff - avg(diff) OVER (PARTITION BY treatment) AS x,
    CAST(row_number() OVER (PARTITION BY treatment ORDER BY diff) AS DOUBLE) AS i,
    count(*) OVER (PARTITION BY treatment) AS n FROM speed_diff WHERE diff IS NOT NULL
)""" + quantile_ctes("sw_z", "sw_rows", "((i - 0.375e0) / (n + 0.25e0))") + f""", sw_sums AS (
  SELECT treatment, n, sum(z * z) AS mm, sum(z * x) AS mx, sum(x * x) AS xx, max(z) AS m1,
    max(z) FILTER (i = n - 1) AS m2, max(x) - min(x) AS e1,
    max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS e2 FROM sw_z GROUP BY treatment, n
), sw_ends AS (
  SELECT *, {poly((0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), '(1 / sqrt(n))')} + m1 / sqrt(mm) AS a1,
    {poly((0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), '(1 / sqrt(n))')} + m2 / sqrt(mm) AS a2 FROM sw_sums
), sw_w AS (
  SELECT treatment, n, pow(CASE WHEN n <= 5 THEN a1 * e1 + (mx - m1 * e1) / sqrt(abs((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)))
    ELSE a1 * e1 + a2 * e2 + (mx - m1 * e1 - m2 * e2)
    / sqrt(abs((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))) END, 2) / xx AS w FROM sw_ends
), sw_p AS (
  SELECT *, CASE WHEN n <= 11 THEN (-ln({poly((-2.273, 0.459), 'n')} - ln(1 - w)) - {poly((0.544, -0.39978, 0.025054, -0.0006714), 'n')})
    / exp({poly((1.3822, -0.77857, 0.062767, -0.0020322), 'n')})
    ELSE (ln(1 - w) - {poly((-1.5861, -0.31082, -0.083751, 0.0038915), 'ln(n)')})
    / exp({poly((-0.4803, -0.082676, 0.0030302), 'ln(n)')}) END AS u FROM sw_w
), sw AS (
  SELECT treatment, n, w, 0.5e0 - sign(u) * (1 - ({z_tail('u')})) / 2 AS p FROM sw_p
)"""
twin("shapiro", SHAPIRO, "SELECT *, n > 5000 AS extrapolated FROM sw", "w p")
twin("shapiro_minute_share", CUE_MINUTE + SHAPIRO[len(SPEED):].replace(
    "FROM speed_diff", "FROM (SELECT 'all' AS treatment, ratioside AS diff FROM cue_minute) AS c"),
     "SELECT n, w, p, n > 5000 AS extrapolated FROM sw", "w p")
twin("kept_fish", FRAMES, """SELECT fish, treatment, count(*) AS rows, count(cue_x) AS tracked FROM lagged
  WHERE treatment IN ('C8AHL', 'menthe') AND fish IN ('1', '3', '4', '13') GROUP BY fish, treatment""")
twin("columnar_table", SPEED, "SELECT * FROM speed_min", "m1 sd se")
twin("cohort_folders", FRAMES, """SELECT treatment, part, count(*) AS rows, count(cue_x) AS tracked,
  CASE WHEN treatment = 'menthe' THEN 0 ELSE count(speed) END AS with_speed, avg(cue_x) AS cue_x FROM lagged GROUP BY treatment, part""", "cue_x")
twin("gated_test", SHAPIRO + ranks("speed_diff", "treatment") + EXACT + f""", t_test AS (
  {paired('speed_diff', 'treatment')}
), r_test AS (
  {rank_result('speed_diff', 'treatment')}
)""", """SELECT t.treatment, t.n, sw.p AS shapiro_p, CASE WHEN sw.p > 0.05 THEN 'paired t' ELSE 'signed rank' END AS test,
  CASE WHEN sw.p > 0.05 THEN t.p ELSE r.p END AS test_p
FROM t_test AS t JOIN r_test AS r USING (treatment) JOIN sw USING (treatment)""", "shapiro_p test_p")
twin("qq_points", SPEED + """, qq_rows AS (
  SELECT treatment, diff AS sample, row_number() OVER (PARTITION BY treatment ORDER BY diff) AS rank,
    count(*) OVER (PARTITION BY treatment) AS n FROM speed_diff WHERE diff IS NOT NULL
)""" + quantile_ctes("qq_z", "qq_rows", "((rank - CASE WHEN n <= 10 THEN 0.375e0 ELSE 0.5e0 END)"
                     " / (n + 1 - CASE WHEN n <= 10 THEN 0.75e0 ELSE 1e0 END))"),
     "SELECT treatment, rank, z AS theoretical, sample FROM qq_z", "theoretical sample")

# --- distributions
twin("median_interval", FRAMES,
     """SELECT part, treatment, quantile_cont(cue_x, 0.5) AS median, quantile_cont(cue_x, 0.025) AS lower,
       quantile_cont(cue_x, 0.975) AS upper FROM lagged GROUP BY part, treatment""", "median lower upper")
twin("shape_moments", CUE_MINUTE,
     """SELECT treatment, min(sum) AS min, max(sum) AS max, count(sum) AS n, avg(sum) AS mean,
       stddev_samp(sum) AS sd, skewness(sum) AS skewness, kurtosis(sum) + 3 AS kurtosis, median(sum) AS median
     FROM cue_minute GROUP BY treatment""", "min max mean sd skewness kurtosis median")
twin("histogram", CUE_MINUTE,
     """SELECT part, bin, (bin - 1) * 5e0 AS low, bin * 5e0 AS high, count(*) AS count FROM (
       SELECT part, CAST(greatest(ceil(ratioside / 5 - 1e-7), 1) AS INTEGER) AS bin FROM cue_minute) AS b
     GROUP BY part, bin""", "low high")
