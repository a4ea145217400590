"""SQL twins of the core queries for DuckDB, over common table expressions that mirror the views."""

from __future__ import annotations

CTES = r"""
WITH RECURSIVE ev AS (SELECT *, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
t0 AS (SELECT 'C' || (user_id % 4) AS circuit, 'car_' || user_id AS car_id, user_id, k, value, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
    (us - min(us) OVER (PARTITION BY user_id)) / 3.6e9::DOUBLE AS t FROM ev),
t1 AS (SELECT *, CAST(floor(t / 24) AS BIGINT) AS lap_number, event_type <> 'error' AS active, value < 60 AS in_corridor, greatest(value - 60, 0.0) / 10 AS depth,
    CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS pit, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS side, k * 10.0::DOUBLE AS arc FROM t0),
t2 AS (SELECT *, t - 24 * lap_number AS clock, coalesce(lag(t) OVER w IS NULL OR t - lag(t) OVER w > 24 OR active <> lag(active) OVER w, TRUE) AS hb,
    coalesce(lap_number <> lag(lap_number) OVER w, FALSE) AS lapb FROM t1 WINDOW w AS (PARTITION BY car_id ORDER BY frame_index)),
tele AS (SELECT *, hb OR lapb AS seed, sum(hb::INT) OVER (PARTITION BY car_id ORDER BY frame_index) - 1 AS seg FROM t2),
dts AS (SELECT car_id, t - lag(t) OVER (PARTITION BY car_id ORDER BY frame_index) AS dt FROM tele),
cad AS (SELECT car_id, median(dt) FILTER (WHERE dt > 0) AS cadence FROM dts GROUP BY car_id),
pr0 AS (SELECT tele.*, cadence, NOT in_corridor AND active AS outside, active AND pit = 0 AND in_corridor AS clean,
    max(CASE WHEN seed THEN t END) OVER (PARTITION BY car_id ORDER BY frame_index) AS seed_before,
    min(CASE WHEN seed THEN t END) OVER (PARTITION BY car_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS seed_after,
    min(frame_index) OVER (PARTITION BY car_id, seg) AS seg_first, max(frame_index) OVER (PARTITION BY car_id, seg) AS seg_last,
    sum(CASE WHEN active AND coalesce(prev_active, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY car_id ORDER BY frame_index) AS arun
    FROM (SELECT *, lag(active) OVER (PARTITION BY car_id ORDER BY frame_index) AS prev_active FROM tele) tele JOIN cad USING (car_id)),
pr AS (SELECT *, coalesce(t - seed_before <= 2 + 1e-12 OR seed_after - t <= 2 + 1e-12, FALSE) AS near_art,
    min(t) OVER (PARTITION BY car_id, arun) AS a_start, max(t) OVER (PARTITION BY car_id, arun) AS a_end,
    greatest(seg_first, coalesce(max(CASE WHEN NOT clean THEN frame_index END) OVER (PARTITION BY car_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0)) AS clean_from FROM pr0),
ou0 AS (SELECT *, lag(frame_index) OVER w AS pf, lag(t) OVER w AS pt, lag(seg) OVER w AS ps FROM pr WHERE outside WINDOW w AS (PARTITION BY car_id ORDER BY frame_index)),
ou AS (SELECT *, sum(CASE WHEN ps = seg AND (frame_index = pf + 1 OR greatest(0.0, t - pt - cadence) <= 12 + 1e-12) THEN 0 ELSE 1 END) OVER (PARTITION BY car_id ORDER BY frame_index) AS run FROM ou0),
rn AS (SELECT circuit, car_id, seg, run, min(frame_index) AS sf, max(frame_index) AS ef, arg_min(t, frame_index) AS st, arg_max(t, frame_index) AS et, any_value(cadence) AS cadence,
    max(depth) AS md, count(*) AS n_out, arg_min(side, frame_index) AS side, arg_min(arc, frame_index) AS arc, any_value(seg_first) AS seg_first, any_value(seg_last) AS seg_last,
    any_value(a_start) AS a_start, any_value(a_end) AS a_end, arg_min(clean_from, frame_index) AS clean_from, arg_min(pit, frame_index) AS spit FROM ou GROUP BY ALL),
mdf AS (SELECT car_id, run, min(frame_index) AS mf FROM ou JOIN rn USING (car_id, run) WHERE depth = md GROUP BY ALL),
mk AS (SELECT rn.car_id, rn.run, bool_or(x.pit <> 0 AND x.frame_index BETWEEN sf AND ef) AS po, bool_or(x.seed AND x.t >= st - 2 - 1e-12 AND x.t <= et + 2 + 1e-12) AS an FROM rn JOIN tele x ON x.car_id = rn.car_id GROUP BY ALL),
cd0 AS (SELECT rn.*, mf, po, an, et - st + rn.cadence AS duration, CASE WHEN spit <> 0 THEN 0.0 ELSE greatest(0.0, st - c.t) END AS lead_in
    FROM rn JOIN mdf USING (car_id, run) JOIN mk USING (car_id, run) JOIN tele c ON c.car_id = rn.car_id AND c.frame_index = rn.clean_from),
cd AS (SELECT *, CASE WHEN md < 1.0 THEN 'max_depth_below_threshold' WHEN duration < 6 THEN 'duration_below_threshold'
    WHEN st - a_start + 1e-12 < 12 OR a_end - et + 1e-12 < 12 THEN 'segment_edge_proximity' WHEN po THEN 'pit_overlap' WHEN an THEN 'artifact_proximity' ELSE '' END AS reason,
    circuit || ':' || car_id || ':excursion_candidate_' || lpad(run::VARCHAR, greatest(4, length(run::VARCHAR))::INT, '0') AS id, CAST(floor(arc / 25) AS BIGINT) AS bin FROM cd0),
q AS (SELECT * FROM cd WHERE reason = ''),
nx AS (SELECT f.circuit, f.car_id, f.seg, f.frame_index, q.id AS next_id, q.st - f.t AS ttn, q.side AS nside, q.bin AS nbin FROM tele f ASOF LEFT JOIN q ON f.car_id = q.car_id AND f.seg = q.seg AND f.t <= q.st),
sg AS (SELECT circuit, car_id, seg, min(t) AS start, max(t) AS stop FROM tele GROUP BY ALL),
gr AS (SELECT circuit, car_id, seg, i::INT AS grid_index, start + i * 6.0::DOUBLE AS target FROM sg, unnest(generate_series(0, CAST(floor((stop - start) / 6.0::DOUBLE + 1e-9) AS BIGINT))) AS g(i)),
iv0 AS (SELECT circuit, car_id, frame_index, t AS t0, lead(t) OVER w AS t1, active AND lead(active) OVER w AS pair, lead(hb) OVER w AS brk, pit <> 0 OR lead(pit) OVER w <> 0 AS inpit,
    max(CASE WHEN seed THEN t END) OVER w AS sb, min(CASE WHEN seed THEN t END) OVER (PARTITION BY car_id ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS sa
    FROM tele WINDOW w AS (PARTITION BY car_id ORDER BY frame_index)),
iv1 AS (SELECT *, lag(pair) OVER (PARTITION BY car_id ORDER BY frame_index) AS pp FROM iv0 WHERE t1 IS NOT NULL),
iv2 AS (SELECT *, sum(CASE WHEN pair AND coalesce(pp, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY car_id ORDER BY frame_index) AS prun FROM iv1),
iv AS (SELECT *, pair AND NOT brk AND t1 > t0 AND NOT inpit AS ok, t0 >= min(t0) OVER r + 12 - 1e-12 AND t1 <= max(t1) OVER r - 12 + 1e-12 AS safe,
    coalesce(t0 < sb + 2, FALSE) OR coalesce(t1 > sa - 2, FALSE) AS hit FROM iv2 WINDOW r AS (PARTITION BY car_id, prun)),
ex AS (SELECT circuit, car_id, round(coalesce(sum(t1 - t0) FILTER (WHERE ok), 0.0), 6) AS prebuffer_seconds, count(*) FILTER (WHERE ok) AS prebuffer_intervals,
    round(coalesce(sum(t1 - t0) FILTER (WHERE ok AND safe AND NOT hit), 0.0), 6) AS buffered_seconds, count(*) FILTER (WHERE ok AND safe AND NOT hit) AS buffered_intervals FROM iv GROUP BY ALL),
units AS (SELECT DISTINCT circuit, car_id FROM tele),
lo0 AS (SELECT f.c AS fold_test_circuit, circuit, car_id, sha256('["surrogate-v1",20270927,"' || f.c || '","' || circuit || '","' || car_id || '"]') AS split_score FROM units, (SELECT DISTINCT circuit AS c FROM units) f),
lo1 AS (SELECT *, circuit = fold_test_circuit AS own, count(*) OVER (PARTITION BY fold_test_circuit, circuit = fold_test_circuit) AS n,
    row_number() OVER (PARTITION BY fold_test_circuit, circuit = fold_test_circuit ORDER BY split_score) AS rk FROM lo0),
lo AS (SELECT fold_test_circuit, circuit, car_id, split_score, CASE WHEN own THEN 'test' WHEN rk <= greatest(1, least(n - 1, floor(n * 0.2::DOUBLE + 0.5))) THEN 'calibration' ELSE 'fit' END AS part FROM lo1),
sc AS (SELECT circuit, car_id, frame_index, t, in_corridor AS inside, hb, least(value / 100, 1.0) AS score, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, k % 3 AS bin, active AND pit = 0 AS valid FROM tele),
th(th) AS (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.4)),
sm AS (
  SELECT circuit, car_id, th, -1::BIGINT AS fi, 0 AS mode, NULL::DOUBLE AS since, NULL::DOUBLE AS ot, NULL::VARCHAR AS os, NULL::BIGINT AS ob, 0::BIGINT AS num,
    NULL::DOUBLE AS c_t, NULL::VARCHAR AS c_s, NULL::BIGINT AS c_b, NULL::BIGINT AS c_n, NULL::DOUBLE AS c_rt, NULL::VARCHAR AS c_k FROM units, th
  UNION ALL
  SELECT circuit, car_id, th, nfi,
    CASE k WHEN 'B' THEN CASE WHEN mode <> 0 OR NOT inside THEN 2 ELSE 0 END WHEN 'O' THEN 2 WHEN 'X' THEN 2 WHEN 'N' THEN 1 WHEN 'R0' THEN 2 WHEN 'R1' THEN 2 WHEN 'R2' THEN 2 WHEN 'AO' THEN 2 WHEN 'A' THEN 1 ELSE 0 END,
    CASE k WHEN 'B' THEN CASE WHEN (mode <> 0 OR NOT inside) AND valid AND inside THEN t END WHEN 'X' THEN ot + 30 WHEN 'R1' THEN t WHEN 'R2' THEN since END,
    CASE k WHEN 'N' THEN ot WHEN 'A' THEN t END, CASE k WHEN 'N' THEN os WHEN 'A' THEN side END, CASE k WHEN 'N' THEN ob WHEN 'A' THEN bin END, CASE k WHEN 'A' THEN num + 1 ELSE num END,
    CASE WHEN mode = 1 AND k IN ('B', 'O', 'X') THEN ot END, CASE WHEN mode = 1 AND k IN ('B', 'O', 'X') THEN os END, CASE WHEN mode = 1 AND k IN ('B', 'O', 'X') THEN ob END,
    CASE WHEN mode = 1 AND k IN ('B', 'O', 'X') THEN num END, CASE WHEN mode = 1 THEN CASE k WHEN 'B' THEN t WHEN 'O' THEN t WHEN 'X' THEN ot + 30 END END,
    CASE WHEN mode = 1 THEN CASE k WHEN 'B' THEN 'hard_break' WHEN 'O' THEN 'outside_observed' WHEN 'X' THEN 'horizon_elapsed' END END
  FROM (SELECT sm.circuit, sm.car_id, sm.th, sm.mode, sm.since, sm.ot, sm.os, sm.ob, sm.num, r.frame_index AS nfi, r.t, r.side, r.bin, r.valid, r.inside,
      CASE WHEN r.hb THEN 'B' WHEN sm.mode = 1 AND NOT r.inside THEN 'O' WHEN sm.mode = 1 AND r.t + 1e-12 >= sm.ot + 30 THEN 'X' WHEN sm.mode = 1 THEN 'N'
        WHEN sm.mode = 2 AND NOT (r.valid AND r.inside) THEN 'R0' WHEN sm.mode = 2 AND sm.since IS NULL THEN 'R1' WHEN sm.mode = 2 AND r.t - sm.since + 1e-12 < 10 THEN 'R2'
        WHEN NOT r.inside THEN 'AO' WHEN NOT r.valid THEN 'AV' WHEN r.score + 1e-15 < sm.th THEN 'AS' ELSE 'A' END AS k
    FROM sm JOIN sc r ON r.car_id = sm.car_id AND r.frame_index = sm.fi + 1) z),
lastf AS (SELECT car_id, max(frame_index) AS fi, max(t) AS t FROM tele GROUP BY car_id),
pp AS (SELECT circuit, car_id, th, c_n AS n, c_t AS pt, c_s AS side, c_b AS bin, c_rt AS rt, c_k AS kind, c_k = 'hard_break' AS unres FROM sm WHERE c_n IS NOT NULL
  UNION ALL SELECT sm.circuit, sm.car_id, th, num, ot, os, ob, l.t, 'stream_end', TRUE FROM sm JOIN lastf l ON l.car_id = sm.car_id AND l.fi = sm.fi WHERE mode = 1),
lb0 AS (SELECT pp.*, q.st, q.id, q.side AS eside, q.bin % 3 AS ebin, row_number() OVER (PARTITION BY pp.car_id, th, n ORDER BY q.st NULLS LAST, q.id) AS nth
  FROM pp LEFT JOIN q ON q.car_id = pp.car_id AND q.st >= pt - 1e-12 AND q.st <= least(pt + 30, rt) + 1e-12),
lb1 AS (SELECT *, coalesce(side = eside, FALSE) AS cs, coalesce(least(abs(bin - ebin), 3 - abs(bin - ebin)), 9) AS dist FROM lb0 WHERE nth = 1),
lb AS (SELECT circuit, car_id, th AS threshold, n AS proposal_number, pt AS proposal_time, kind AS resolution_type, id AS matched_event_id, st - pt AS lead, cs AS correct_side,
  cs AND dist = 0 AS exact_segment, dist <= 1 AS within_tolerance, cs AND dist <= 1 AS localized_hit, id IS NULL AND unres AS unresolved_censored,
  CASE WHEN id IS NOT NULL THEN NOT (cs AND dist <= 1) ELSE NOT unres END AS false_proposal FROM lb1),
ld(lead) AS (VALUES (1.0::DOUBLE), (6.0), (12.0), (24.0)),
lg AS (SELECT ex.circuit, ex.car_id, ld.lead, coalesce(e.n, 0) AS events, coalesce(h.hits, 0) AS hits, coalesce(h.f, 0) AS false_proposals, coalesce(h.u, 0) AS unresolved, ex.prebuffer_seconds AS exposure
  FROM ex CROSS JOIN ld LEFT JOIN (SELECT car_id, count(*) FILTER (WHERE reason = '') AS n FROM cd GROUP BY car_id) e ON e.car_id = ex.car_id
  LEFT JOIN (SELECT car_id, ld.lead, count(DISTINCT matched_event_id) FILTER (WHERE localized_hit AND lb.lead >= ld.lead - 1e-12) AS hits, count(*) FILTER (WHERE false_proposal) AS f, count(*) FILTER (WHERE unresolved_censored) AS u
    FROM lb, ld WHERE threshold = 0.1 GROUP BY ALL) h ON h.car_id = ex.car_id AND h.lead = ld.lead),
su AS (SELECT threshold, ld.lead AS required_lead, (SELECT count(*) FROM q) AS events, count(DISTINCT matched_event_id) FILTER (WHERE localized_hit AND lb.lead >= ld.lead - 1e-12) AS hits,
  count(*) FILTER (WHERE false_proposal) AS false_proposals, count(*) FILTER (WHERE unresolved_censored) AS unresolved FROM lb, ld GROUP BY ALL),
ds AS (SELECT threshold, required_lead, events, hits, false_proposals, unresolved, hits / nullif(events, 0)::DOUBLE AS recall,
  false_proposals / (SELECT round(sum(prebuffer_seconds), 4) FROM ex) AS false_per_hour FROM su),
pb AS (SELECT l.doc_id, d.lang, d.source, l.quality::DOUBLE AS y, d.n_chars, d.n_chars / (d.n_chars + 1500.0::DOUBLE) AS p FROM labels l JOIN documents d USING (doc_id)),
pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 30 AS x, embedding[2]::DOUBLE * 30 AS y, embedding[3]::DOUBLE * 30 AS z, embedding[4]::DOUBLE * 30 AS w, label::BIGINT AS label, embedding[4]::DOUBLE AS e4, embedding[5]::DOUBLE AS e5, embedding[6]::DOUBLE AS e6, embedding[7]::DOUBLE AS e7, embedding[8]::DOUBLE AS e8, embedding[9]::DOUBLE AS e9, embedding[10]::DOUBLE AS e10, embedding[11]::DOUBLE AS e11, embedding[12]::DOUBLE AS e12, embedding[13]::DOUBLE AS e13, embedding[14]::DOUBLE AS e14 FROM embeddings),
sqr(role, h) AS (VALUES ('outer', 10.0::DOUBLE), ('inner', 5.0), ('center', 7.5)),
rg0 AS (SELECT role, i::INT AS idx, h, CASE WHEN i IN (0, 3) THEN -h ELSE h END AS ax, CASE WHEN i IN (0, 1) THEN -h ELSE h END AS ay, CASE WHEN i IN (2, 3) THEN -h ELSE h END AS bx, CASE WHEN i IN (0, 3) THEN -h ELSE h END AS by2 FROM sqr, unnest(generate_series(0, 3)) AS g(i)),
rg AS (SELECT role, idx, ax, ay, bx, by2, 2 * h AS len, 2 * h * idx AS start FROM rg0),
rp0 AS (SELECT *, lead(depth) OVER w AS nxt, lead(t) OVER w - t AS dt, active AND pit = 0 AND in_corridor AS okk, lead(active AND pit = 0 AND in_corridor) OVER w AS okn FROM tele WINDOW w AS (PARTITION BY car_id, seg ORDER BY frame_index)),
rp AS (SELECT circuit, car_id, seg, frame_index, depth AS x, nxt AS x_next, dt, nxt - depth AS residual FROM rp0 WHERE okk AND okn AND dt > 0)
"""


def draws(cte: str, units: str, n: int, seed: str) -> str:
    """Weights of hash draws inside circuits."""
    return f""", {cte}z AS (SELECT circuit, list(car_id ORDER BY car_id) AS cars FROM {units} GROUP BY circuit),
{cte} AS (SELECT draw, circuit, cars[1 + (('0x' || substr(sha256('{seed}|' || draw || '|' || circuit || '|' || place), 1, 8))::BIGINT % len(cars))] AS car_id, count(*) AS weight
  FROM {cte}z, unnest(generate_series(0, {n - 1})) AS d(draw), unnest(generate_series(0, len(cars) - 1)) AS p(place) GROUP BY ALL)"""


LSTAR = """SELECT {keys}coalesce(max(lead) FILTER (WHERE h >= (0.1 - 1e-12) * e AND e > 0 AND f <= ({budget} + 1e-12) * x), 0.0) AS l_star FROM
  (SELECT {keys}lead, sum(hits {w}) AS h, sum(events {w}) AS e, sum(({false}) {w}) AS f, sum(exposure {w}) AS x FROM {src} GROUP BY {keys}lead) {group}"""


def lstar(keys: str = "", budget: str = "0.1", false: str = "false_proposals", src: str = "lg", w: str = "") -> str:
    return LSTAR.format(keys=f"{keys}, " if keys else "", budget=budget, false=false, src=src, w=w, group=f"GROUP BY {keys}" if keys else "")


BOOT = "SELECT count(*) AS draws, round(avg(l_star), 6) AS mean, round(quantile_cont(l_star, 0.025), 6) AS low, round(quantile_cont(l_star, 0.975), 6) AS high FROM ({})"
TWO_STAGE = """, tsz AS (SELECT circuit, list(car_id ORDER BY car_id) AS cars FROM units GROUP BY circuit), tsa AS (SELECT list(circuit ORDER BY circuit) AS alls FROM tsz),
ts1 AS (SELECT draw, slot, alls[1 + (('0x' || substr(sha256('t|c|' || draw || '|' || slot), 1, 8))::BIGINT % len(alls))] AS circuit FROM tsa, unnest(generate_series(0, 199)) AS d(draw), unnest(generate_series(0, len(alls) - 1)) AS p(slot)),
ts AS (SELECT draw, circuit, cars[1 + (('0x' || substr(sha256('t|' || draw || '|' || slot || '|' || circuit || '|' || place), 1, 8))::BIGINT % len(cars))] AS car_id, count(*) AS weight
  FROM ts1 JOIN tsz USING (circuit), unnest(generate_series(0, len(cars) - 1)) AS p(place) GROUP BY ALL)"""
PROJECT = "greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by2 - ay)) / (len * len)))"
GAP = "sqrt((x - ax - u * (bx - ax)) ** 2 + (y - ay - u * (by2 - ay)) ** 2)"


def covered(px: str, py: str) -> str:
    """Whether a point lies in the corridor of the lists ``o`` and ``h`` (sides of outer ring and hole)."""
    odd = lambda ring: f"len(list_filter({ring}, lambda s: (s.ay > {py}) <> (s.by2 > {py}) AND {px} < s.ax + ({py} - s.ay) * (s.bx - s.ax) / nullif(s.by2 - s.ay, 0))) % 2"
    u = f"greatest(0.0, least(1.0, (({px} - s.ax) * (s.bx - s.ax) + ({py} - s.ay) * (s.by2 - s.ay)) / (s.len * s.len)))"
    near = f"len(list_filter(list_concat(o, h), lambda s: sqrt(({px} - s.ax - {u} * (s.bx - s.ax)) ** 2 + ({py} - s.ay - {u} * (s.by2 - s.ay)) ** 2) <= 1e-7)) > 0"
    return f"(({odd('o')} = 1 AND {odd('h')} = 0) OR {near})"


#: From moves mv(id, x, y, x2, y2) to first exits fx(id, x, y, x2, y2, t).
EXITS = f""", rl AS (SELECT list({{'ax': ax, 'ay': ay, 'bx': bx, 'by2': by2, 'len': len}} ORDER BY idx) FILTER (WHERE role = 'outer') AS o, list({{'ax': ax, 'ay': ay, 'bx': bx, 'by2': by2, 'len': len}} ORDER BY idx) FILTER (WHERE role = 'inner') AS h FROM rg),
ms0 AS (SELECT mv.* FROM mv, rl WHERE (x <> x2 OR y <> y2) AND {covered("x", "y")}),
mh0 AS (SELECT ms0.*, ax, ay, bx, by2, (x2 - x) * (by2 - ay) - (y2 - y) * (bx - ax) AS c, (ax - x) * (y2 - y) - (ay - y) * (x2 - x) AS off FROM ms0, rg WHERE role <> 'center'),
mh1 AS (SELECT *, ((ax - x) * (by2 - ay) - (ay - y) * (bx - ax)) / nullif(c, 0) AS tt, off / nullif(c, 0) AS uu, ((ax - x) * (x2 - x) + (ay - y) * (y2 - y)) / ((x2 - x) ** 2 + (y2 - y) ** 2) AS ta, ((bx - x) * (x2 - x) + (by2 - y) * (y2 - y)) / ((x2 - x) ** 2 + (y2 - y) ** 2) AS tb FROM mh0),
mh2 AS (SELECT id, tt FROM mh1 WHERE tt BETWEEN -1e-12 AND 1 + 1e-12 AND uu BETWEEN -1e-12 AND 1 + 1e-12
  UNION ALL SELECT id, unnest([greatest(0.0, least(ta, tb)), least(1.0, greatest(ta, tb))]) FROM mh1 WHERE c = 0 AND off = 0 AND greatest(0.0, least(ta, tb)) <= least(1.0, greatest(ta, tb))),
mh AS (SELECT id, list_sort(list_distinct(list(greatest(0.0, least(1.0, tt))))) AS hits FROM mh2 GROUP BY id),
mp0 AS (SELECT ms0.*, hits, list_sort(list_distinct(list_concat(hits, [0.0::DOUBLE, 1.0::DOUBLE]))) AS cuts FROM ms0 JOIN mh USING (id)),
mp1 AS (SELECT *, unnest(generate_series(1, len(cuts) - 1)) AS piece FROM mp0),
mp AS (SELECT *, x + (cuts[piece] + cuts[piece + 1]) / 2 * (x2 - x) AS px, y + (cuts[piece] + cuts[piece + 1]) / 2 * (y2 - y) AS py FROM mp1),
fx AS (SELECT id, x, y, x2, y2, hits[1] AS t FROM mp, rl WHERE NOT {covered("px", "py")} GROUP BY ALL)"""


def path_exits(rate: str) -> str:
    """Exits of constant body velocity with a yaw rate, over 30 steps of 0.05."""
    return f""", st AS (SELECT id AS sid, x AS x0, y AS y0, abs(z) AS v, w AS yaw, {rate} AS rate, i AS step FROM pts, unnest(generate_series(1, 30)) AS g(i)),
sv AS (SELECT *, v * cos(yaw + rate * ((step - 0.5::DOUBLE) * 0.05::DOUBLE)) * 0.05::DOUBLE AS mx, v * sin(yaw + rate * ((step - 0.5::DOUBLE) * 0.05::DOUBLE)) * 0.05::DOUBLE AS my FROM st),
sp AS (SELECT *, x0 + sum(mx) OVER w AS ex, y0 + sum(my) OVER w AS ey FROM sv WINDOW w AS (PARTITION BY sid ORDER BY step ROWS UNBOUNDED PRECEDING)),
mv AS (SELECT {{'i': sid, 's': step}} AS id, ex - mx AS x, ey - my AS y, ex AS x2, ey AS y2 FROM sp){EXITS},
fe0 AS (SELECT id.i AS sid, (id.s - 1 + t) * 0.05::DOUBLE AS et, x + t * (x2 - x) AS x, y + t * (y2 - y) AS y FROM fx),
fe1 AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY et) AS nth FROM fe0),
fa AS (SELECT *, {PROJECT} AS u FROM fe1, rg WHERE role = 'center' AND nth = 1), fb AS (SELECT *, {GAP} AS gap, ((bx - ax) * (y - ay) - (by2 - ay) * (x - ax)) / len AS cr FROM fa),
fd AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY round(gap, 9), idx) AS pick FROM fb),
fo AS (SELECT sid, et, CASE WHEN cr > 1e-7 THEN 'left' WHEN cr < -1e-7 THEN 'right' ELSE 'unknown' END AS side, floor(CASE WHEN start + u * len >= 60 THEN start + u * len - 60 ELSE start + u * len END / 2.5)::BIGINT AS bin FROM fd WHERE pick = 1)
SELECT p.id, hz AS horizon, CASE WHEN et <= hz + 1e-12 THEN side ELSE 'none' END AS side, CASE WHEN et <= hz + 1e-12 THEN bin END AS bin, round(CASE WHEN et <= hz + 1e-12 THEN et END, 6) AS exit_time
FROM pts p LEFT JOIN fo ON fo.sid = p.id, (VALUES (0.25::DOUBLE), (0.5), (1.0), (1.5)) q(hz)"""


def _rotation_sql(x: str, y: str, z: str, w: str) -> list[list[str]]:
    return [
        [f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {z} * {w}))", f"(2 * ({x} * {z} + {y} * {w}))"],
        [f"(2 * ({x} * {y} + {z} * {w}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {x} * {w}))"],
        [f"(2 * ({x} * {z} - {y} * {w}))", f"(2 * ({y} * {z} + {x} * {w}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))"],
    ]


def kinematics() -> str:
    m, v = _rotation_sql("0.0::DOUBLE", "0.0::DOUBLE", "0.6::DOUBLE", "0.8::DOUBLE"), _rotation_sql("qx", "qy", "qz", "qw")
    dot = lambda a, b: " + ".join(f"({i}) * {j}" for i, j in zip(a, b, strict=True))
    to_map = lambda a: [dot(a, [m[i][j] for i in range(3)]) for j in range(3)]
    cols = dict(zip(("map_x", "map_y", "map_z"), to_map(["x - 1", "y - 2", "z - 3"]), strict=True)) | dict(zip(("map_vx", "map_vy", "map_vz"), to_map(["e4", "e5", "e6"]), strict=True))
    cols |= dict(zip(("map_ax", "map_ay", "map_az"), to_map([dot(v[i], ["e7", "e8", "e9"]) for i in range(3)]), strict=True)) | dict(zip(("forward_x", "forward_y", "forward_z"), to_map([v[i][0] for i in range(3)]), strict=True))
    return f""", kn AS (SELECT *, sqrt(e10 * e10 + e11 * e11 + e12 * e12 + e13 * e13) AS nq FROM pts), kq AS (SELECT *, e10 / nq AS qx, e11 / nq AS qy, e12 / nq AS qz, e13 / nq AS qw FROM kn),
km AS (SELECT label, id, {", ".join(f"{e} AS {n}" for n, e in cols.items())} FROM kq), ky AS (SELECT *, atan2(forward_y, forward_x) AS a FROM km),
ks AS (SELECT *, coalesce(a - lag(a) OVER (PARTITION BY label ORDER BY id), 0.0) AS d FROM ky)
SELECT label, id, {", ".join(f"round({n}, 6) AS {n}" for n in cols)}, round(a + 2 * pi() * sum(CASE WHEN d > pi() THEN -1.0 WHEN d < -pi() THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY label ORDER BY id), 6) AS yaw FROM ks"""


KINEMATICS = kinematics()

_SELECTS = {
    "tele_frames": "SELECT circuit, car_id, frame_index, round(t, 6) AS time_seconds, lap_number, in_corridor, round(depth, 6) AS outside_depth_m, active, pit AS pit_status, side AS local_side, hb AS hard_break, seed AS artifact_seed, seg AS continuous_segment_id FROM tele",
    "timebase_axis": """, ax0 AS (SELECT *, row_number() OVER w = 1 AS fr, lap_number - lag(lap_number) OVER w AS dl, clock - lag(clock) OVER w AS dc, arc - lag(arc) OVER w AS dd, abs(depth - lag(depth) OVER w) AS stp, lag(clock) OVER w AS wc,
  (pit = 2) <> (lag(pit) OVER w = 2) AS dst FROM tele WINDOW w AS (PARTITION BY car_id ORDER BY frame_index)),
axc AS (SELECT car_id, median(CASE WHEN dl = 0 AND dc > 0 AND dc < 24 THEN dc END) AS cadence FROM ax0 GROUP BY car_id),
ax1 AS (SELECT ax0.*, cadence, coalesce(dl = 1, FALSE) AS lb, coalesce((dl = 0 AND dc < -0.05) OR dl < 0 OR dl > 1, FALSE) AS cr, CASE WHEN dl = 0 THEN dc WHEN dl = 1 THEN 24.0 - wc + clock ELSE cadence END AS sdt FROM ax0 JOIN axc USING (car_id)),
ax2 AS (SELECT *, coalesce(NOT fr AND sdt > greatest(24.0, 5 * cadence), FALSE) AS dg, coalesce(stp > 20, FALSE) AS pj, coalesce(dd < -900, FALSE) AS dr, coalesce(dst, FALSE) AS stt FROM ax1),
ax3 AS (SELECT *, fr OR cr OR dg OR pj OR dr OR stt AS brk FROM ax2)
SELECT circuit, car_id, frame_index, round(cadence, 6) AS cadence, lb AS lap_boundary, cr AS clock_reset, dg AS data_gap, pj AS position_jump, dr AS distance_reset, stt AS status_transition, brk AS hard_break, brk OR lb AS artifact_seed,
  round(sum(CASE WHEN fr THEN 0.0 WHEN brk THEN cadence ELSE greatest(sdt, 0.0) END) OVER w, 5) AS time_seconds, sum(brk::INT) OVER w - 1 AS continuous_segment_id FROM ax3 WINDOW w AS (PARTITION BY car_id ORDER BY frame_index)""",
    "timing_diagnostics": "SELECT circuit, car_id, count(*) AS n_frames, count(*) FILTER (WHERE hb) - 1 AS n_hard_breaks, count(*) FILTER (WHERE seed) AS n_artifact_seeds, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE pit <> 0) AS n_pit, round(max(t) - min(t), 6) AS span_seconds FROM tele GROUP BY ALL",
    "causal_resample": "SELECT g.circuit, g.car_id, g.seg AS continuous_segment_id, grid_index, round(target, 6) AS target_time, f.frame_index AS source_index, round(target - f.t, 6) AS source_age FROM gr g ASOF JOIN tele f ON f.car_id = g.car_id AND f.seg = g.seg AND f.t <= g.target",
    "source_flags_forward": "SELECT f.circuit, f.car_id, f.seg AS continuous_segment_id, g.grid_index, count(*) AS n_flags FROM (SELECT * FROM tele WHERE seed) f ASOF JOIN gr g ON f.car_id = g.car_id AND f.seg = g.seg AND f.t <= g.target GROUP BY ALL",
    "signed_area": """, ra AS (SELECT label, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM pts WINDOW w AS (PARTITION BY label ORDER BY id))
SELECT label, round(sum(x * ny - nx * y) / 2, 6) AS area FROM ra GROUP BY label""",
    "corridor_locate": f""", a AS (SELECT *, {PROJECT} AS u FROM pts, rg),
b AS (SELECT *, {GAP} AS gap, CASE WHEN (ay > y) <> (by2 > y) AND x < ax + (y - ay) * (bx - ax) / nullif(by2 - ay, 0) THEN 1 ELSE 0 END AS c FROM a),
g AS (SELECT id, sum(c) FILTER (WHERE role = 'outer') % 2 = 1 AS io, sum(c) FILTER (WHERE role = 'inner') % 2 = 1 AS ih, min(gap) FILTER (WHERE role = 'outer') AS go, min(gap) FILTER (WHERE role = 'inner') AS gi FROM b GROUP BY id),
n AS (SELECT *, ((bx - ax) * (y - ay) - (by2 - ay) * (x - ax)) / len AS cr, row_number() OVER (PARTITION BY id ORDER BY round(gap, 9), idx) AS nth FROM b WHERE role = 'center'),
h AS (SELECT *, (io AND NOT ih) OR least(go, gi) <= 1e-7 AS inside, least(go, gi) AS near FROM g)
SELECT id, inside AS in_corridor, ih AS in_hole, CASE WHEN go <= gi THEN 'outer' ELSE 'inner' END AS nearest_boundary, round(CASE WHEN inside THEN near ELSE -near END, 6) AS clearance, round(CASE WHEN inside THEN 0.0 ELSE near END, 6) AS outside_depth,
  CASE WHEN cr > 1e-7 THEN 'left' WHEN cr < -1e-7 THEN 'right' ELSE 'center' END AS local_side, idx AS centerline_segment, round(start + u * len, 6) AS arclength, round(CASE WHEN start + u * len >= 60 THEN start + u * len - 60 ELSE start + u * len END, 6) AS arclength_wrapped
FROM h JOIN n USING (id) WHERE nth = 1""",
    "segment_exit": ", mv AS (SELECT id, x * 1.2 AS x, y * 1.2 AS y, x + z AS x2, y + w AS y2 FROM pts)" + EXITS + " SELECT id, round(t, 6) AS fraction, round(x + t * (x2 - x), 6) AS hit_x, round(y + t * (y2 - y), 6) AS hit_y FROM fx",
    "track_features": f""", a AS (SELECT *, {PROJECT} AS u FROM pts, rg WHERE role = 'center'), b AS (SELECT *, {GAP} AS gap FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(gap, 9), idx) AS nth FROM b)
SELECT id, idx AS segment, round(((bx - ax) * (y - ay) - (by2 - ay) * (x - ax)) / len, 6) AS "offset", round(atan2(by2 - ay, bx - ax), 6) AS heading, round(pi() / 2 / 15, 6) AS curvature, round(start + u * len, 6) AS arclength FROM c WHERE nth = 1""",
    "track_reference": """SELECT id, idx AS segment, round(((bx - ax) * (y - ay) - (by2 - ay) * (x - ax)) / len, 6) AS "offset", round(atan2(by2 - ay, bx - ax), 6) AS heading, round(pi() / 2 / 15, 6) AS curvature FROM pts JOIN rg ON role = 'center' AND idx = id % 4""",
    "quaternion_yaw": "SELECT id, round(atan2(2 * (e13 * e12 + e10 * e11) / n, 1 - 2 * (e11 * e11 + e12 * e12) / n), 6) AS yaw FROM (SELECT *, e10 * e10 + e11 * e11 + e12 * e12 + e13 * e13 AS n FROM pts)",
    "row_identities": """, ri AS (SELECT circuit, car_id, frame_index, 'row-seed-v1:{"base_seed":20270927,"car":"' || car_id || '","circuit":"' || circuit || '","frame_index":' || frame_index || ',"method":"bayesian","outer_fold":"C0"}' AS identity FROM tele),
rh AS (SELECT *, sha256(identity) AS h FROM ri)
SELECT circuit, car_id, frame_index, identity, (('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT)::VARCHAR AS seed FROM rh""",
    "grid_acceleration": """, ga AS (SELECT g.circuit, g.car_id, g.seg, grid_index, target, f.value AS v, f.depth AS d FROM gr g ASOF JOIN tele f ON f.car_id = g.car_id AND f.seg = g.seg AND f.t <= g.target)
SELECT circuit, car_id, seg AS continuous_segment_id, grid_index, round((v - lag(v) OVER w) / (target - lag(target) OVER w), 6) AS value_rate, round((d - lag(d) OVER w) / (target - lag(target) OVER w), 6) AS outside_depth_m_rate FROM ga WINDOW w AS (PARTITION BY car_id, seg ORDER BY grid_index)""",
    "map_kinematics": KINEMATICS,
    "constant_velocity_exits": path_exits("0.0"),
    "constant_turn_exits": path_exits("z / 20"),
    "excursion_candidates": "SELECT circuit, car_id, id AS candidate_event_id, seg AS continuous_segment_id, sf AS start_frame, ef AS end_frame, st AS start_time, et AS end_time, round(duration, 6) AS duration, round(md, 6) AS max_depth, mf AS max_depth_frame, n_out AS n_outside, ef - sf + 1 - n_out AS n_gap, side AS side_at_onset, bin AS segment_bin_at_onset, sf = seg_first AS start_truncated, ef = seg_last AS end_truncated, po AS pit_overlap, an AS artifact_near, round(lead_in, 6) AS lead_in, reason AS rejection_reason, reason = '' AS qualified FROM cd",
    "excursion_frames": "SELECT f.circuit, f.car_id, f.frame_index, cd.id AS candidate_event_id, CASE WHEN reason = '' THEN cd.id END AS qualifying_event_id, coalesce(reason = '' AND f.frame_index = sf, FALSE) AS onset, f.active AND f.pit = 0 AND NOT f.near_art AS eligible_exposure FROM pr f LEFT JOIN cd ON cd.car_id = f.car_id AND f.frame_index BETWEEN sf AND ef",
    "interval_exposure": "SELECT * FROM ex",
    "frame_target_join": "SELECT f.circuit, f.car_id, f.frame_index, f.hb AS hard_break, next_id AS next_event_id, round(ttn, 6) AS time_to_next FROM tele f JOIN nx USING (car_id, frame_index)",
    "partition_attach": "SELECT part AS partition, count(*) AS rows, count(next_id) AS with_event, round(sum(round(ttn, 6)), 3) AS total_time_to_next FROM nx LEFT JOIN (SELECT * FROM lo WHERE fold_test_circuit = 'C0') l USING (car_id) GROUP BY part",
    "exposure_join": "SELECT fold_test_circuit, part AS partition, count(*) AS cars, round(sum(prebuffer_seconds), 4) AS seconds FROM ex JOIN lo USING (car_id) GROUP BY ALL",
    "events_semi_join": "SELECT circuit, car_id, id AS candidate_event_id, reason = '' AS qualified FROM cd WHERE car_id IN (SELECT car_id FROM lo WHERE fold_test_circuit = 'C1' AND part = 'calibration')",
    "key_set_check": """, kr AS (SELECT car_id, frame_index FROM nx WHERE next_id IS NOT NULL UNION ALL SELECT car_id, frame_index FROM nx WHERE next_id IS NOT NULL AND frame_index % 7 = 0 UNION ALL SELECT car_id, frame_index + 1000000 FROM tele WHERE frame_index % 11 = 0),
ka AS (SELECT car_id, frame_index, count(*) AS a FROM tele GROUP BY ALL), kb AS (SELECT car_id, frame_index, count(*) AS b FROM kr GROUP BY ALL)
SELECT count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (WHERE a > 1 OR b > 1) AS repeated FROM ka FULL JOIN kb USING (car_id, frame_index)""",
    "next_event_targets": "SELECT circuit, car_id, seg AS continuous_segment_id, frame_index, next_id AS next_event_id, round(ttn, 6) AS time_to_next, nside AS next_side, nbin AS next_bin FROM nx",
    "event_projection": "SELECT q.id AS candidate_event_id, g.grid_index, round(g.target - q.st, 6) AS projection_delay FROM q ASOF LEFT JOIN gr g ON q.car_id = g.car_id AND q.seg = g.seg AND q.st <= g.target",
    "causal_features": """, a AS (SELECT *, ((arc / 100 + pi()) - 2 * pi() * floor((arc / 100 + pi()) / (2 * pi()))) - pi() AS yaw, value / 10 AS vx, depth AS vy FROM tele),
b AS (SELECT *, yaw - lag(yaw) OVER w AS dy, t - lag(t) OVER w AS dt, yaw - k / 20.0::DOUBLE AS he FROM a WINDOW w AS (PARTITION BY car_id, seg ORDER BY frame_index))
SELECT circuit, car_id, seg AS continuous_segment_id, frame_index, round(yaw, 6) AS yaw, round(CASE WHEN dt IS NULL OR hb THEN 0.0 ELSE (((dy + pi()) - 2 * pi() * floor((dy + pi()) / (2 * pi()))) - pi()) / dt END, 6) AS yaw_rate,
  round(vx * cos(yaw) + vy * sin(yaw), 6) AS v_long, round(vy * cos(yaw) - vx * sin(yaw), 6) AS v_lat, round(((he + pi()) - 2 * pi() * floor((he + pi()) / (2 * pi()))) - pi(), 6) AS heading_error FROM b""",
    "robust_scaler": """, a AS (SELECT value, depth, clock FROM tele WHERE active), b AS (SELECT 'value' AS feature, value AS v FROM a UNION ALL SELECT 'outside_depth_m', depth FROM a UNION ALL SELECT 'current_lap_time', clock FROM a),
c AS (SELECT feature, median(v) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS r FROM b GROUP BY feature) SELECT feature, round(m, 6) AS center, round(CASE WHEN r > 1e-12 THEN r ELSE 1.0 END, 6) AS scale FROM c""",
    "support_flags": "SELECT circuit, car_id, seg AS continuous_segment_id, frame_index, active AND pit = 0 AND NOT hb AS input_valid_causal, max(t) OVER s - t + 1e-12 >= 6 AS outcome_evaluable_6p00s, max(t) OVER s - t + 1e-12 >= 24 AS outcome_evaluable_24p00s FROM tele WINDOW s AS (PARTITION BY car_id, seg)",
    "residual_pairs": "SELECT circuit, car_id, seg AS continuous_segment_id, frame_index, x, x_next, round(dt, 6) AS dt, round(residual, 6) AS residual FROM rp",
    "hazard_rows": """, a AS (SELECT tele.*, q.id IS NOT NULL AS onset FROM tele LEFT JOIN q ON q.car_id = tele.car_id AND q.sf = tele.frame_index), b AS (SELECT *, lead(active AND pit = 0) OVER w AS okn, lead(onset) OVER w AS on_next FROM a WINDOW w AS (PARTITION BY car_id, seg ORDER BY frame_index))
SELECT circuit, car_id, frame_index, CASE WHEN on_next THEN side ELSE 'no_exit' END AS label FROM b WHERE active AND pit = 0 AND in_corridor AND okn""",
    "circular_bins": """, a AS (SELECT *, arc + greatest(value, 0.0) * 0.75 AS s FROM tele), b AS (SELECT *, CAST(floor((s - 1000 * floor(s / 1000)) / 25) AS BIGINT) % 40 AS hb2 FROM a)
SELECT circuit, car_id, frame_index, hb2 AS hazard_bin, least(abs(hb2 - 3), 40 - abs(hb2 - 3)) AS distance FROM b""",
    "loco_splits": "SELECT fold_test_circuit, circuit, car_id, part AS partition, split_score FROM lo",
    "cluster_sufficient_stats": "SELECT circuit, car_id, count(*) AS n, 1.0 AS g_one_one, round(avg(x), 4) AS g_one_x, round(avg(dt), 4) AS g_one_dt, round(avg(x * x), 4) AS g_x_x, round(avg(x * dt), 4) AS g_x_dt, round(avg(dt * dt), 4) AS g_dt_dt, round(avg(residual), 4) AS m_one, round(avg(x * residual), 4) AS m_x, round(avg(dt * residual), 4) AS m_dt FROM rp GROUP BY circuit, car_id",
    "constant_turn_forecast": "SELECT id, round(x + list_sum([abs(z) / 10 * cos(w / 10 + z / 100 * (i + 0.5) * 0.25) * 0.25 FOR i IN range(6)]), 6) AS x, round(y + list_sum([abs(z) / 10 * sin(w / 10 + z / 100 * (i + 0.5) * 0.25) * 0.25 FOR i IN range(6)]), 6) AS y, round(w / 10 + z / 100 * 1.5, 6) AS heading FROM pts",
    "neighborhood_candidates": """, ms AS (SELECT l_orderkey AS row, CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'R' THEN 'right' ELSE 'unknown' END AS side, (l_linenumber % 5)::BIGINT AS bin, round(sum(l_quantity::DOUBLE / 100), 6) AS mass FROM lineitem GROUP BY ALL),
a AS (SELECT row, side, ((bin + o) % 5 + 5) % 5 AS bin, round(sum(mass), 9) AS score FROM ms, unnest([-1, 0, 1]) AS z(o) WHERE side <> 'unknown' GROUP BY ALL)
SELECT row, side, bin, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, side, bin) AS nth FROM a) WHERE nth = 1""",
    "apply_calibrator": ", a AS (SELECT doc_id, p, least(greatest(p, 1e-9), 1 - 1e-9) AS c FROM pb) SELECT doc_id, round(CASE WHEN p > 0 THEN least(greatest(1 / (1 + exp(-(1.25 * ln(c / (1 - c)) - 0.5))), 1e-9), 1 - 1e-9) ELSE 0.0 END, 6) AS p_calibrated FROM a",
    "probability_metrics": """, a AS (SELECT lang, grouping(lang)::INT AS pooled, count(*) AS n, avg((p - y) ** 2) AS b, avg((0.8 - y) ** 2) AS r, avg(-(y * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))) AS g FROM pb GROUP BY ROLLUP (lang))
SELECT lang, pooled, n, round(b, 6) AS brier, round(r, 6) AS reference_brier, round(CASE WHEN r > 0 THEN 1 - b / r END, 6) AS skill, round(g, 6) AS log_score FROM a""",
    "ece_bins": ", a AS (SELECT lang, least(CAST(floor(p * 10) AS INT), 9) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM pb GROUP BY ALL) SELECT lang, sum(n)::BIGINT AS n, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM a GROUP BY lang",
    "average_precision": """, a AS (SELECT lang, p, sum(y) AS h, count(*) AS n FROM pb GROUP BY ALL), b AS (SELECT *, sum(h) OVER w / sum(n) OVER w AS pr FROM a WINDOW w AS (PARTITION BY lang ORDER BY p DESC))
SELECT lang, sum(h)::BIGINT AS positives, round(sum(h * pr) / nullif(sum(h), 0), 6) AS average_precision FROM b GROUP BY lang""",
    "monotonicity": """, a AS (SELECT lang, n_chars / (n_chars + 3000.0::DOUBLE) * CASE WHEN doc_id % 7 = 0 THEN 1.0 ELSE 1.0 END AS a, n_chars / (n_chars + 1500.0::DOUBLE) * CASE WHEN doc_id % 7 = 0 THEN 0.5::DOUBLE ELSE 1.0 END AS b, n_chars / (n_chars + 500.0::DOUBLE) * CASE WHEN doc_id % 7 = 0 THEN 500 / 3000.0::DOUBLE ELSE 1.0 END AS c FROM pb),
d AS (SELECT lang, (b < a - 1e-12)::BIGINT + (c < b - 1e-12)::BIGINT AS f FROM a) SELECT lang, grouping(lang)::INT AS pooled, count(*) AS n, count(*) FILTER (WHERE f > 0) AS bad_rows, sum(f)::BIGINT AS bad_pairs FROM d GROUP BY ROLLUP (lang)""",
    "reference_prevalence": "SELECT lang, count(*) AS n, sum(y)::BIGINT AS events, round(avg(y), 9) AS prevalence FROM pb GROUP BY lang",
    "reliability_bins": ", a AS (SELECT lang, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM pb GROUP BY ALL), g AS (SELECT DISTINCT lang, b::INT AS bin FROM pb, unnest(generate_series(0, 9)) AS z(b)) SELECT lang, bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_probability, round(my, 6) AS event_frequency FROM g LEFT JOIN a USING (lang, bin)",
    "reliability_clusters": ", a AS (SELECT source, least(CAST(floor(p * 5) AS INT), 4) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM pb GROUP BY ALL), g AS (SELECT DISTINCT source, b::INT AS bin FROM pb, unnest(generate_series(0, 4)) AS z(b)) SELECT source, bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_probability, round(my, 6) AS event_frequency FROM g LEFT JOIN a USING (source, bin)",
    "alert_state_machine": "SELECT circuit, car_id, n AS proposal_number, round(pt, 6) AS proposal_time, side AS predicted_side, bin AS predicted_bin, round(rt, 6) AS resolution_time, kind AS resolution_type, unres AS unresolved FROM pp WHERE th = 0.1",
    "proposal_labels": "SELECT * REPLACE (round(proposal_time, 6) AS proposal_time, round(lead, 6) AS lead) FROM lb",
    "detection_summary": "SELECT * REPLACE (round(recall, 6) AS recall, round(false_per_hour, 6) AS false_per_hour) FROM ds",
    "operating_points": """, a AS (SELECT ds.*, b AS budget, row_number() OVER (PARTITION BY required_lead, b ORDER BY recall DESC NULLS LAST, threshold DESC) AS nth FROM ds, (VALUES (0.002::DOUBLE), (0.005), (0.02), (0.1)) v(b) WHERE false_per_hour <= b + 1e-12)
SELECT required_lead, budget, threshold, round(recall, 6) AS recall, round(false_per_hour, 6) AS false_per_hour FROM a WHERE nth = 1""",
    "synthetic_delay": "SELECT circuit, car_id, threshold, proposal_number, d AS delay, round(lead - d, 6) AS effective_lead, coalesce(localized_hit AND lead - d >= -1e-12, FALSE) AS localized_hit, unresolved_censored, CASE WHEN matched_event_id IS NOT NULL THEN NOT coalesce(localized_hit AND lead - d >= -1e-12, FALSE) ELSE false_proposal END AS false_proposal FROM lb, (VALUES (0.0::DOUBLE), (2.0), (6.0)) v(d) WHERE threshold = 0.1",
    "car_contributions": "SELECT * FROM lg",
    "pooled_metrics": "SELECT lead, sum(events)::BIGINT AS events, sum(hits)::BIGINT AS hits, sum(false_proposals)::BIGINT AS false_proposals, sum(unresolved)::BIGINT AS unresolved, round(sum(exposure), 6) AS exposure, count(DISTINCT circuit) AS circuits, count(DISTINCT car_id) AS cars, round(sum(hits) / nullif(sum(events), 0)::DOUBLE, 6) AS recall, round(sum(false_proposals) / sum(exposure), 6) AS false_per_hour FROM lg GROUP BY lead",
    "l_star": lstar("circuit"),
    "l_star_least_favorable": lstar("circuit", false="false_proposals + unresolved"),
    "warning_frontier": ", lgb AS (SELECT lg.*, b AS budget FROM lg, (VALUES (0.002::DOUBLE), (0.005), (0.02), (0.1)) v(b)) " + lstar("budget", budget="budget", src="lgb"),
    "cohort_summary": """SELECT circuit, cars, frames, candidates, qualified, prebuffer_seconds, buffered_seconds FROM (SELECT circuit, count(DISTINCT car_id) AS cars, count(*) AS frames FROM tele GROUP BY circuit) LEFT JOIN (SELECT circuit, count(*) AS candidates, count(*) FILTER (WHERE reason = '') AS qualified FROM cd GROUP BY circuit) USING (circuit)
LEFT JOIN (SELECT circuit, round(sum(prebuffer_seconds), 4) AS prebuffer_seconds, round(sum(buffered_seconds), 4) AS buffered_seconds FROM ex GROUP BY circuit) USING (circuit)""",
    "bootstrap_l_star": draws("bw", "units", 200, "w") + " " + BOOT.format(lstar("draw", src="lg JOIN bw USING (circuit, car_id)", w="* weight")),
    "bootstrap_two_stage": TWO_STAGE + " " + BOOT.format(lstar("draw", src="lg JOIN ts USING (circuit, car_id)", w="* weight")),
    "reliability_bootstrap": ", per AS (SELECT lang AS circuit, source AS car_id, least(CAST(floor(p * 5) AS INT), 4) AS bin, count(*) AS n, sum(y) AS e FROM pb GROUP BY ALL), pu AS (SELECT DISTINCT circuit, car_id FROM per)" + draws("rw", "pu", 50, "r")
    + ", ech AS (SELECT draw, bin, sum(e * weight) / sum(n * weight) AS f FROM per JOIN rw USING (circuit, car_id) GROUP BY ALL) SELECT bin, count(*) AS draws, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.975), 6) AS high FROM ech GROUP BY bin",
    "content_hashes": """, ch AS (SELECT user_id, sha256(length(event_id::VARCHAR) || ':' || event_id || strlen(event_type) || ':' || event_type || strlen(props) || ':' || props) AS h FROM events)
SELECT user_id, count(*) AS n_rows, sha256(concat_ws('|', count(*), sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 33, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 49, 16))::UBIGINT::HUGEINT))) AS digest FROM ch GROUP BY user_id""",
}

HAZARDS = {"hazard": ((-2.0, 1.0, 0.25), (-2.5, 0.5, -0.5)), "twin": ((-1.5, 0.5, 0.0), (-1.5, 0.5, 0.0))}


def hazard_mass(name: str) -> str:
    """Steps, horizons and mass of a hazard with fixed coefficients."""
    a, b = (f"{w[0]} + {w[1]} * value / 100 + {w[2]} * (k / 100.0::DOUBLE)" for w in HAZARDS[name])
    return f""", {name}0 AS (SELECT circuit, car_id, frame_index, arc, value, exp({a}) AS l, exp({b}) AS r FROM tele),
{name}1 AS (SELECT *, horizon, pow(1 / (1 + l + r), n) AS stay FROM {name}0, (VALUES (6.0::DOUBLE, 1), (12.0, 2), (24.0, 4)) v(horizon, n)),
{name}2 AS (SELECT *, arc + greatest(value, 0.0) * horizon * 0.25 / 2 AS s FROM {name}1),
{name} AS (SELECT circuit, car_id, frame_index, horizon, side, CAST(floor((s - 1000 * floor(s / 1000)) / 25) AS BIGINT) % 40 AS bin, (1 - stay) * CASE side WHEN 'left' THEN l ELSE r END / (l + r) AS mass
  FROM {name}2, (VALUES ('left'), ('right')) z(side))"""


def compact(name: str) -> tuple[str, str]:
    """Tables and the select of a hazard's compact scores."""
    tables = f"""{hazard_mass(name)}, {name}t AS (SELECT car_id, frame_index, sum(mass) FILTER (WHERE horizon = 6) AS a, sum(mass) FILTER (WHERE horizon = 12) AS b, sum(mass) FILTER (WHERE horizon = 24) AS c FROM {name} GROUP BY ALL),
{name}n AS (SELECT car_id, frame_index, side, (bin + o + 40) % 40 AS bin, round(mass, 9) AS score FROM {name}, unnest([-1, 0, 1]) AS y(o) WHERE horizon = 24),
{name}b AS (SELECT *, row_number() OVER (PARTITION BY car_id, frame_index ORDER BY score DESC, side, bin) AS nth FROM {name}n)"""
    return tables, f"""SELECT sc.circuit, car_id, frame_index, valid AS input_valid_causal, inside AS in_corridor, hb AS hard_break, round(a, 6) AS raw_exit_probability_6p00s, round(b, 6) AS raw_exit_probability_12p00s, round(c, 6) AS raw_exit_probability_24p00s,
  round({name}b.score, 6) AS raw_primary_neighborhood_probability, {name}b.side AS predicted_side, {name}b.bin AS predicted_bin, '{name}' AS method, 40::BIGINT AS n_bins FROM sc JOIN {name}t USING (car_id, frame_index) JOIN {name}b USING (car_id, frame_index) WHERE nth = 1"""


CELLS = """, cx AS (SELECT circuit, round(sum(prebuffer_seconds), 4) AS exposure FROM ex GROUP BY circuit),
ce AS (SELECT circuit, exposure, lead, b AS budget, b * exposure + 1e-12 >= 10 AS estimable FROM cx, ld, (VALUES (0.002::DOUBLE), (0.005), (0.02), (0.1)) v(b))"""
DELAYED = """, dv(delay) AS (VALUES (0.0::DOUBLE), (2.0), (6.0)),
dh AS (SELECT car_id, delay, ld.lead, count(DISTINCT matched_event_id) FILTER (WHERE localized_hit AND round(lb.lead - delay, 6) >= ld.lead - 1e-12) AS hits,
  count(*) FILTER (WHERE CASE WHEN matched_event_id IS NOT NULL THEN NOT coalesce(localized_hit AND round(lb.lead - delay, 6) >= -1e-12, FALSE) ELSE false_proposal END) AS f FROM lb, ld, dv WHERE threshold = 0.1 GROUP BY ALL),
dg AS (SELECT lg.circuit, lg.car_id, lg.lead, dv.delay, lg.events, coalesce(dh.hits, 0) AS hits, coalesce(dh.f, 0) AS false_proposals, lg.unresolved, lg.exposure
  FROM lg CROSS JOIN dv LEFT JOIN dh ON dh.car_id = lg.car_id AND dh.delay = dv.delay AND dh.lead = lg.lead)"""
_SELECTS |= {
    "npz_round_trip": "SELECT car_id, frame_index, round(clock, 6) AS clock, lap_number, round(value, 6) AS value FROM tele",
    "pcd_round_trip": "SELECT car_id, frame_index, round(value, 4) AS x, round(depth, 4) AS y, k::DOUBLE AS z FROM tele",
    "metadata_parse": "SELECT car_id AS path, car_id AS trackname, user_id % 2 = 0 AS clockwise, 20.0::DOUBLE AS frequency_hz, 0.05::DOUBLE AS timestep_seconds, round(value, 3) AS origin_0, k::DOUBLE AS origin_1, -1.5::DOUBLE AS origin_2, 1.0::DOUBLE AS w FROM tele WHERE frame_index = 0",
    "natural_order": "SELECT circuit, car_id, row_number() OVER (PARTITION BY circuit ORDER BY split_part(car_id, '_', 2)::BIGINT) AS place FROM units",
    "travel_direction": """, a AS (SELECT circuit, CASE WHEN value > 10 THEN (cos(k / 50.0::DOUBLE) + 0.5 * sin(k / 50.0::DOUBLE)) / sqrt(1.25) END AS dot FROM tele)
SELECT circuit, count(dot) AS n, round(median(dot), 6) AS median, round(quantile_cont(dot, 0.01), 6) AS p01, round(avg((dot > 0)::INT), 6) AS positive, median(dot) > 0 AND avg((dot > 0)::INT) >= 0.95 AS same_direction FROM a GROUP BY circuit""",
    "compare_derived": DELAYED + """ SELECT lg.circuit, lg.car_id, lg.lead, concat_ws(',', CASE WHEN lg.hits <> dg.hits THEN 'hits' END, CASE WHEN lg.false_proposals <> dg.false_proposals THEN 'false_proposals' END) AS differs
FROM lg JOIN dg ON dg.car_id = lg.car_id AND dg.lead = lg.lead AND dg.delay = 6 WHERE lg.hits <> dg.hits OR lg.false_proposals <> dg.false_proposals""",
    "hazard_mass": hazard_mass("hazard") + " SELECT circuit, car_id, frame_index, horizon, side, bin, round(mass, 6) AS mass FROM hazard",
    "compact_forecast": " ".join(compact("hazard")),
    "mass_defects": """, ms AS (SELECT l_orderkey AS row, l_returnflag, l_linenumber % 5 AS b, round(sum(l_quantity::DOUBLE / 100), 6) AS mass FROM lineitem GROUP BY ALL), mt AS (SELECT row, sum(mass) + 0.5 AS total FROM ms GROUP BY row)
SELECT row, 1.5::DOUBLE AS horizon, round(total, 6) AS total FROM mt WHERE abs(total - 1) > 1e-8""",
    "method_scores": compact("hazard")[0] + compact("twin")[0] + f" {compact('hazard')[1]} UNION ALL {compact('twin')[1]}",
    "estimability": CELLS + " SELECT * FROM ce",
    "abstention_reasons": "SELECT circuit, car_id, count(*) AS rows, count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE valid AND hb) AS hard_break, count(*) FILTER (WHERE valid AND NOT hb AND NOT inside) AS outside, count(*) FILTER (WHERE NOT valid OR hb OR NOT inside) AS abstentions FROM sc GROUP BY ALL",
    "closest_active_threshold": ", ca AS (SELECT car_id, threshold, count(*) AS n FROM lb GROUP BY ALL), cb AS (SELECT car_id, max(threshold) AS closest_threshold, arg_max(n, threshold) AS proposals FROM ca GROUP BY car_id) SELECT circuit, car_id, closest_threshold, proposals FROM units LEFT JOIN cb USING (car_id)",
    "delay_l_star": DELAYED + " " + lstar("circuit, delay", src="dg"),
    "complete_cells": CELLS + ", cg AS (SELECT lead, budget FROM ce GROUP BY ALL HAVING bool_and(estimable) AND count(*) = 4) SELECT ce.* FROM ce SEMI JOIN cg USING (lead, budget)",
    "ledger_defects": """, fl0 AS (SELECT *, split_part(car_id, '_', 2)::BIGINT % 13 AS n FROM lg),
fl1 AS (SELECT car_id, n, lead, events, CASE WHEN n = 1 AND lead = 1 THEN -1 WHEN n = 2 THEN events + 1 ELSE hits END AS hits, false_proposals AS f, CASE WHEN n = 3 AND lead = 1 THEN NULL ELSE unresolved END AS u,
  CASE WHEN n = 4 THEN 0.0 WHEN n = 5 AND lead = 1 THEN exposure + 1 ELSE exposure END AS x FROM fl0 WHERE NOT (n = 6 AND lead = 1)),
fl AS (SELECT * FROM fl1 UNION ALL SELECT * FROM fl1 WHERE n = 7),
fk AS (SELECT car_id, lead, count(*) AS c, count(*) FILTER (WHERE events < 0 OR hits < 0 OR f < 0 OR u IS NULL OR u < 0) AS bad, count(*) FILTER (WHERE NOT x > 0) AS dark, count(*) FILTER (WHERE hits > events) AS over, min(events) AS e0, max(events) AS e1, min(x) AS x0, max(x) AS x1 FROM fl GROUP BY ALL),
fc AS (SELECT car_id, sum(bad) AS bad, sum(dark) AS dark, sum(over) AS over, count(*) FILTER (WHERE c > 1) AS rep, count(*) AS cells, min(e0) <> max(e1) OR min(x0) <> max(x1) AS uneven FROM fk GROUP BY car_id)
SELECT count(*) AS cars, sum(bad)::BIGINT AS bad_counts, sum(dark)::BIGINT AS bad_exposure, sum(over)::BIGINT AS hits_above_events, sum(rep)::BIGINT AS repeated_keys, count(*) FILTER (WHERE uneven) AS uneven_denominators, count(*) FILTER (WHERE cells < (SELECT max(cells) FROM fc)) AS incomplete_cars FROM fc""",
    "runtime_summary": "SELECT event_type, count(*) AS entries, sum(k)::BIGINT AS rows, round(sum(round(value, 4)), 4) AS seconds, round(sum(k) / sum(round(value, 4)), 6) AS rows_per_second FROM ev GROUP BY event_type",
    "grid_completeness": CELLS + """, gf AS (SELECT circuit, lead, budget FROM ce WHERE estimable UNION ALL SELECT circuit, lead, budget FROM ce WHERE estimable AND lead = 6 UNION ALL SELECT circuit, 99, budget FROM ce WHERE estimable AND lead = 12),
gk AS (SELECT circuit, lead, budget, count(*) AS n FROM gf GROUP BY ALL)
SELECT circuit, 16 - count(*) FILTER (WHERE lead <> 99) AS missing, count(*) FILTER (WHERE lead = 99) AS unknown, count(*) FILTER (WHERE n > 1) AS repeated FROM gk GROUP BY circuit""",
}

QS = [0.99 * i / 99 for i in range(100)] + [1 - 10 ** -(2.0 + 4.0 * i / 400) for i in range(401)]
_SELECTS["threshold_grid"] = f"SELECT DISTINCT threshold FROM (SELECT unnest(list_concat([round(v, 9) FOR v IN quantile_cont(score, {QS})], [0.0, 1.0])) AS threshold FROM sc)"

HORIZON_P = "n_chars / (n_chars + {0}::DOUBLE) * CASE WHEN doc_id % 7 = 0 THEN {0} / 3000.0::DOUBLE ELSE 1.0 END"
_SELECTS["performance_evaluation"] = f""", ev_rt AS (SELECT lang, avg(y) AS reference FROM pb GROUP BY lang),
ev_hz AS ({" UNION ALL ".join(f"SELECT {h} AS horizon, lang, doc_id, y, {HORIZON_P.format(f'{h}.0')} AS p FROM pb" for h in (500, 1500, 3000))}),
ev_sc2 AS (SELECT ev_hz.*, reference, doc_id % 11 <> 0 AS ok, s.scope, CASE WHEN s.scope = 'unit' THEN lang END AS u FROM ev_hz JOIN ev_rt USING (lang), (VALUES ('unit'), ('pooled')) s(scope)),
ev_ag AS (SELECT horizon, scope, u, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE NOT ok) AS unresolved, sum(y) FILTER (WHERE ok)::BIGINT AS events, avg((p - y) ** 2) FILTER (WHERE ok) AS b, avg((reference - y) ** 2) FILTER (WHERE ok) AS r,
  avg(-(y * ln(p) + (1 - y) * ln(1 - p))) FILTER (WHERE ok) AS g FROM ev_sc2 GROUP BY ALL),
ev_eb AS (SELECT horizon, scope, u, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM ev_sc2 WHERE ok GROUP BY ALL),
ev_ec AS (SELECT horizon, scope, u, sum(n * abs(mp - my)) / sum(n) AS ece FROM ev_eb GROUP BY ALL),
ev_ps AS (SELECT horizon, scope, u, p, sum(y) AS h, count(*) AS n FROM ev_sc2 WHERE ok GROUP BY ALL),
ev_pr AS (SELECT *, sum(h) OVER w / sum(n) OVER w AS pr FROM ev_ps WINDOW w AS (PARTITION BY horizon, scope, u ORDER BY p DESC)),
ev_ap AS (SELECT horizon, scope, u, sum(h * pr) / nullif(sum(h), 0) AS ap FROM ev_pr GROUP BY ALL)
SELECT ev_ag.horizon, ev_ag.scope, ev_ag.u AS lang, n, unresolved, events, round(b, 6) AS brier, round(r, 6) AS reference_brier, round(CASE WHEN r > 0 THEN 1 - b / r END, 6) AS skill, round(g, 6) AS log_score, round(ece, 6) AS ece, round(ap, 6) AS average_precision
FROM ev_ag JOIN ev_ec ON ev_ec.horizon = ev_ag.horizon AND ev_ec.scope = ev_ag.scope AND ev_ec.u IS NOT DISTINCT FROM ev_ag.u JOIN ev_ap ON ev_ap.horizon = ev_ag.horizon AND ev_ap.scope = ev_ag.scope AND ev_ap.u IS NOT DISTINCT FROM ev_ag.u WHERE n > 0"""
_SELECTS["paired_bootstrap"] = DELAYED + draws("pw", "units", 200, "p") + f""", pb_l AS ({lstar("draw, delay", src="dg JOIN pw USING (circuit, car_id)", w="* weight")}),
pb_d AS (SELECT draw, coalesce(max(l_star) FILTER (WHERE delay = 0), 0.0) AS a, coalesce(max(l_star) FILTER (WHERE delay = 6), 0.0) AS b FROM pb_l WHERE delay IN (0, 6) GROUP BY draw)
SELECT count(*) AS draws, round(avg(a - b), 6) AS delta_mean, round(avg((a > b)::INT), 6) AS first_longer, {", ".join(f"round(quantile_cont({x}, {q}), 6) AS {n}_{e}" for x, n in (("a", "first"), ("b", "second"), ("a - b", "delta")) for q, e in ((0.025, "low"), (0.975, "high")))} FROM pb_d"""
_AXIS = _SELECTS["timebase_axis"].rpartition("\nSELECT ")[0]
_KINDS = {"lap_boundary": "lb", "clock_reset": "cr", "data_gap": "dg", "position_jump": "pj", "distance_reset": "dr", "status_transition": "stt"}
_SELECTS["axis_diagnostics"] = f"""{_AXIS} SELECT circuit, car_id, count(*) AS sample_count, round(max(cadence), 6) AS median_source_dt, {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}_count" for n, c in _KINDS.items())},
  count(*) FILTER (WHERE brk) - 1 AS hard_break_count, round(1 / max(cadence), 6) AS estimated_source_hz FROM ax3 GROUP BY circuit, car_id"""


def newton(name: str, points: str, keys: list[str], least_slope: float, steps: int = 150) -> str:
    """``name`` (keys, n, events, slope, intercept): the logistic fit of each group of ``points`` (keys, x, n, k), by steps of length one at most; one class: null."""
    on = " AND ".join(f"w.{k} IS NOT DISTINCT FROM x.{k}" for k in keys)
    k, wk = ", ".join(keys), ", ".join(f"w.{k}" for k in keys)
    return f""", {name}g AS (SELECT {k}, sum(n) AS n, sum(k) AS e FROM {points} GROUP BY {k}),
{name}w AS (
  SELECT {k}, 0 AS i, 1.0::DOUBLE AS a, ln((e + 0.5) / (n - e + 0.5)) AS b FROM {name}g WHERE e > 0 AND e < n
  UNION ALL
  SELECT {k}, i + 1, greatest({least_slope}, least(50.0, a - da * least(1.0, 1 / greatest(abs(da), abs(db), 1e-12)))), greatest(-50.0, least(50.0, b - db * least(1.0, 1 / greatest(abs(da), abs(db), 1e-12)))) FROM (
    SELECT *, CASE WHEN held THEN 0.0 ELSE (hbb * ga - hab * gb) / (haa * hbb - hab * hab) END AS da, CASE WHEN held THEN gb / hbb ELSE (haa * gb - hab * ga) / (haa * hbb - hab * hab) END AS db FROM (
      SELECT *, a <= {least_slope} AND ga > 0 OR a >= 50 AND ga < 0 AS held FROM (
        SELECT {k}, i, a, b, sum((n * q - k) * x) AS ga, sum(n * q - k) AS gb, sum(n * q * (1 - q) * x * x) AS haa, sum(n * q * (1 - q) * x) AS hab, sum(n * q * (1 - q)) AS hbb FROM (
          SELECT {wk}, i, a, b, x.x, x.n, x.k, 1 / (1 + exp(-(a * x.x + b))) AS q FROM {name}w w JOIN {points} x ON {on} WHERE i < {steps}) GROUP BY {k}, i, a, b)))),
{name} AS (SELECT g.*, a AS slope, b AS intercept FROM {name}g g LEFT JOIN {name}w w ON {on.replace("x.", "g.")} AND i = {steps})"""


_ODDS = "ln(greatest(least(p, 1 - 1e-9), 1e-9) / (1 - greatest(least(p, 1 - 1e-9), 1e-9)))"
#: Scores of two hazards with truth at each horizon, and the fits of the calibration cars of fold C0.
CALIBRATORS = _SELECTS["method_scores"].replace("SELECT sc.circuit", ", ms AS (SELECT sc.circuit", 1) + f"""),
ho(horizon) AS (VALUES (6.0::DOUBLE), (12.0), (24.0)),
hr AS (SELECT method, horizon, CASE horizon WHEN 6 THEN raw_exit_probability_6p00s WHEN 12 THEN raw_exit_probability_12p00s ELSE raw_exit_probability_24p00s END AS p,
    coalesce(round(ttn, 6) <= horizon + 1e-12 AND round(ttn, 6) >= -1e-12, FALSE)::INT AS y
  FROM ms JOIN (SELECT car_id FROM lo WHERE fold_test_circuit = 'C0' AND part = 'calibration') USING (car_id) JOIN nx USING (car_id, frame_index)
    JOIN (SELECT car_id, frame_index, max(t) OVER (PARTITION BY car_id, seg) - t AS left_time FROM tele) USING (car_id, frame_index), ho
  WHERE input_valid_causal AND in_corridor AND left_time + 1e-12 >= horizon),
hp AS (SELECT method, horizon, {_ODDS} AS x, count(*) AS n, sum(y) AS k FROM hr GROUP BY ALL){newton("hf", "hp", ["method", "horizon"], 0.0)},
hc AS (SELECT method, horizon, n, e, coalesce(slope, 0.0) AS slope, coalesce(intercept, ln((e + 0.5) / (n - e + 0.5))) AS intercept FROM hf)"""


def _after(p: str, slope: str = "slope", intercept: str = "intercept") -> str:
    return f"CASE WHEN {p} > 0 THEN greatest(1e-9, least(1 - 1e-9, 1 / (1 + exp(-({slope} * {_ODDS.replace('(p,', f'({p},')} + {intercept}))))) ELSE 0.0 END"


_AFTER = {h: _after(f"raw_exit_probability_{h}p00s", f"s{h}", f"i{h}") for h in (6, 12, 24)}
_SELECTS |= {
    "horizon_calibrators": CALIBRATORS + " SELECT method, horizon, n::BIGINT AS n, e::BIGINT AS events, round(slope, 5) AS slope, round(intercept, 5) AS intercept FROM hc",
    "calibrated_scores": CALIBRATORS + f""", hw AS (SELECT method, {", ".join(f"max(slope) FILTER (WHERE horizon = {h}) AS s{h}, max(intercept) FILTER (WHERE horizon = {h}) AS i{h}" for h in (6, 12, 24))} FROM hc GROUP BY method)
SELECT circuit, car_id, frame_index, method, {", ".join(f"round({_AFTER[h]}, 6) AS exit_probability_{h}p00s" for h in (6, 12, 24))},
  round(CASE WHEN raw_exit_probability_24p00s > 0 THEN greatest(0.0, least(1.0, raw_primary_neighborhood_probability * ({_AFTER[24]}) / raw_exit_probability_24p00s)) ELSE 0.0 END, 6) AS proposal_score FROM ms JOIN hw USING (method)""",
    "calibrated_mass": CALIBRATORS + f""", ht AS (SELECT car_id, frame_index, horizon, sum(mass) AS p FROM hazard GROUP BY ALL),
hq AS (SELECT car_id, frame_index, ht.horizon, p, {_after("p")} AS q FROM ht JOIN hc ON hc.horizon = ht.horizon AND hc.method = 'hazard')
SELECT circuit, car_id, frame_index, horizon, side, bin, round(CASE WHEN p > 0 THEN mass * q / p ELSE 0.0 END, 6) AS mass, round(1 - q, 6) AS h_no_exit FROM hazard JOIN hq USING (car_id, frame_index, horizon)""",
}
_SELECTS["car_reliability"] = CALIBRATORS + f""", rh AS (SELECT ms.circuit, car_id, ms.method, ho.horizon, {_after("q", "slope", "intercept")} AS p, coalesce(round(ttn, 6) <= ho.horizon + 1e-12 AND round(ttn, 6) >= -1e-12, FALSE)::INT AS y,
    input_valid_causal AND in_corridor AND left_time + 1e-12 >= ho.horizon AS ok
  FROM (SELECT *, unnest([6.0::DOUBLE, 12.0, 24.0]) AS horizon, unnest([raw_exit_probability_6p00s, raw_exit_probability_12p00s, raw_exit_probability_24p00s]) AS q FROM ms WHERE circuit = 'C0') ms
    JOIN ho ON ho.horizon = ms.horizon JOIN hc ON hc.method = ms.method AND hc.horizon = ms.horizon JOIN nx USING (car_id, frame_index)
    JOIN (SELECT car_id, frame_index, max(t) OVER (PARTITION BY car_id, seg) - t AS left_time FROM tele) USING (car_id, frame_index)),
rg_ AS (SELECT DISTINCT circuit, car_id, method, horizon, b::INT AS bin FROM rh, unnest(range(0, 10)) AS g(b)),
ra AS (SELECT car_id, method, horizon, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, sum(p) AS s, sum(y) AS e FROM rh WHERE ok GROUP BY ALL)
SELECT circuit, car_id, method, horizon, bin, coalesce(n, 0) AS n, round(coalesce(s, 0.0), 6) AS probability_sum, coalesce(e, 0)::BIGINT AS events FROM rg_ LEFT JOIN ra USING (car_id, method, horizon, bin)"""
_LINES = _SELECTS["performance_evaluation"].rpartition("\nSELECT ev_ag.horizon")
_SELECTS["evaluation_lines"] = f"""{_LINES[0]}, el_p AS (SELECT horizon, scope, u, {_ODDS} AS x, sum(n) AS n, sum(h) AS k FROM ev_ps GROUP BY ALL){newton("el", "el_p", ["horizon", "scope", "u"], -50.0)}
SELECT horizon, scope, u AS lang, n::BIGINT AS n, e::BIGINT AS events, round(intercept, 5) AS calibration_intercept, round(slope, 5) AS calibration_slope FROM el"""
_SELECTS["robust_scaled"] = _SELECTS["robust_scaler"].rpartition(" SELECT feature")[0] + f""" SELECT circuit, car_id, frame_index, {", ".join(f"round(({v} - (SELECT m FROM c WHERE feature = '{n}')) / (SELECT CASE WHEN r > 1e-12 THEN r ELSE 1.0 END FROM c WHERE feature = '{n}'), 6) AS {n}" for n, v in (("value", "value"), ("outside_depth_m", "depth"), ("current_lap_time", "clock")))} FROM tele"""
#: The automaton at threshold 0.1, an open proposal closing at its horizon before the row is looked at; ``silent`` is the time up to which timers have fired.
TIMELY = """, tm AS (
  SELECT circuit, car_id, -1::BIGINT AS fi, 0 AS mode, NULL::DOUBLE AS since, NULL::DOUBLE AS ot, NULL::VARCHAR AS os, NULL::BIGINT AS ob, 0::BIGINT AS num,
    NULL::DOUBLE AS c_t, NULL::VARCHAR AS c_s, NULL::BIGINT AS c_b, NULL::BIGINT AS c_n, NULL::DOUBLE AS c_rt, NULL::VARCHAR AS c_k FROM units
  UNION ALL
  SELECT circuit, car_id, nfi,
    CASE k WHEN 'B' THEN CASE WHEN mode <> 0 OR NOT inside THEN 2 ELSE 0 END WHEN 'O' THEN 2 WHEN 'N' THEN 1 WHEN 'R0' THEN 2 WHEN 'R1' THEN 2 WHEN 'R2' THEN 2 WHEN 'AO' THEN 2 WHEN 'A' THEN 1 ELSE 0 END,
    CASE k WHEN 'B' THEN CASE WHEN (mode <> 0 OR NOT inside) AND valid AND inside THEN t END WHEN 'R1' THEN t WHEN 'R2' THEN since END,
    CASE k WHEN 'N' THEN ot WHEN 'A' THEN t END, CASE k WHEN 'N' THEN os WHEN 'A' THEN side END, CASE k WHEN 'N' THEN ob WHEN 'A' THEN bin END, CASE k WHEN 'A' THEN num + 1 ELSE num END,
    CASE WHEN ended THEN ot END, CASE WHEN ended THEN os END, CASE WHEN ended THEN ob END, CASE WHEN ended THEN num END,
    CASE WHEN late THEN ot + 30 WHEN ended THEN t END, CASE WHEN late THEN 'horizon_elapsed' WHEN ended AND k = 'B' THEN 'hard_break' WHEN ended THEN 'outside_observed' END
  FROM (SELECT *, late OR mode = 1 AND k IN ('B', 'O') AS ended FROM (
    SELECT *, CASE WHEN hb THEN 'B' WHEN mode = 1 AND NOT inside THEN 'O' WHEN mode = 1 THEN 'N' WHEN mode = 2 AND NOT (valid AND inside) THEN 'R0' WHEN mode = 2 AND since IS NULL THEN 'R1' WHEN mode = 2 AND t - since + 1e-12 < 10 THEN 'R2'
        WHEN NOT inside THEN 'AO' WHEN NOT valid THEN 'AV' WHEN score + 1e-15 < 0.1 THEN 'AS' ELSE 'A' END AS k
    FROM (SELECT * REPLACE (CASE WHEN late THEN 2 ELSE mode END AS mode, CASE WHEN late THEN ot + 30 ELSE since END AS since) FROM (
      SELECT tm.circuit, tm.car_id, tm.mode, tm.since, tm.ot, tm.os, tm.ob, tm.num, r.frame_index AS nfi, r.t, r.side, r.bin, r.valid, r.inside, r.hb, r.score, tm.mode = 1 AND r.t + 1e-12 >= tm.ot + 30 AS late
      FROM tm JOIN sc r ON r.car_id = tm.car_id AND r.frame_index = tm.fi + 1))))),
ty AS (SELECT circuit, car_id, c_n AS n, c_t AS pt, c_s AS side, c_b AS bin, c_rt AS rt, c_k AS kind FROM tm WHERE c_n IS NOT NULL
  UNION ALL SELECT tm.circuit, tm.car_id, num, ot, os, ob, CASE WHEN ot + 30 <= {silent} THEN ot + 30 ELSE l.t END, CASE WHEN ot + 30 <= {silent} THEN 'horizon_elapsed' ELSE 'stream_end' END
  FROM tm JOIN lastf l ON l.car_id = tm.car_id AND l.fi = tm.fi WHERE mode = 1)
SELECT circuit, car_id, n AS proposal_number, round(pt, 6) AS proposal_time, side AS predicted_side, bin AS predicted_bin, round(rt, 6) AS resolution_time, kind AS resolution_type, kind IN ('hard_break', 'stream_end') AS unresolved FROM ty"""
_SELECTS["timely_alerts"] = TIMELY.format(silent="-1e9")
_SELECTS["streamed_alerts"] = TIMELY.format(silent="(SELECT max(t) FROM tele) - 30")
#: Labels of two methods, cells chosen on calibration cars of fold C0, and the ledger of its test cars.
HELDOUT = """, l2 AS (SELECT circuit, car_id, 'plain' AS method, threshold, matched_event_id, lead, localized_hit, false_proposal, unresolved_censored FROM lb
  UNION ALL SELECT circuit, car_id, 'late', threshold, matched_event_id, round(lead - 6, 6), coalesce(localized_hit AND lead - 6 >= -1e-12, FALSE),
    CASE WHEN matched_event_id IS NOT NULL THEN NOT coalesce(localized_hit AND lead - 6 >= -1e-12, FALSE) ELSE false_proposal END, unresolved_censored FROM lb),
ca AS (SELECT lo.part, ex.circuit, ex.car_id, ex.prebuffer_seconds AS exposure, coalesce(e.n, 0) AS events FROM lo JOIN ex USING (car_id) LEFT JOIN (SELECT car_id, count(*) FILTER (WHERE reason = '') AS n FROM cd GROUP BY car_id) e USING (car_id) WHERE fold_test_circuit = 'C0'),
cw AS (SELECT sum(events) AS events, sum(exposure) AS exposure FROM ca WHERE part = 'calibration'),
cs AS (SELECT m.method, th AS threshold, ld.lead AS required_lead,
    (SELECT count(DISTINCT matched_event_id) FILTER (WHERE localized_hit AND x.lead >= ld.lead - 1e-12) FROM l2 x SEMI JOIN (SELECT car_id FROM ca WHERE part = 'calibration') c ON c.car_id = x.car_id WHERE x.method = m.method AND x.threshold = th) AS hits,
    (SELECT count(*) FILTER (WHERE false_proposal) FROM l2 x SEMI JOIN (SELECT car_id FROM ca WHERE part = 'calibration') c ON c.car_id = x.car_id WHERE x.method = m.method AND x.threshold = th) AS f
  FROM (SELECT DISTINCT method FROM l2) m, th, ld),
co AS (SELECT method, required_lead, b AS budget, threshold, hits / nullif(events, 0)::DOUBLE AS recall, f / nullif(exposure, 0) AS rate, exposure FROM cs, cw, (VALUES (0.002::DOUBLE), (0.005), (0.02), (0.1)) v(b)),
cb AS (SELECT method, required_lead, budget, threshold FROM co WHERE rate <= budget + 1e-12 QUALIFY row_number() OVER (PARTITION BY method, required_lead, budget ORDER BY recall DESC NULLS LAST, threshold DESC) = 1),
oc AS (SELECT DISTINCT co.method, co.required_lead, co.budget, CASE WHEN co.budget * exposure + 1e-12 >= 4 THEN cb.threshold END AS threshold,
    CASE WHEN NOT co.budget * exposure + 1e-12 >= 4 THEN 'not_estimable' WHEN cb.threshold IS NULL THEN 'no_threshold' ELSE 'active' END AS state
  FROM co LEFT JOIN cb USING (method, required_lead, budget)),
hl AS (SELECT ca.circuit, ca.car_id, oc.method, oc.required_lead, oc.budget, oc.threshold, oc.state, ca.events, coalesce(x.hits, 0) AS hits, coalesce(x.f, 0) AS false_proposals, coalesce(x.u, 0) AS unresolved, ca.exposure, oc.state <> 'active' AS abstained
  FROM (SELECT * FROM ca WHERE part = 'test') ca CROSS JOIN oc LEFT JOIN (
    SELECT l2.car_id, oc.method, oc.required_lead, oc.budget, count(DISTINCT matched_event_id) FILTER (WHERE localized_hit AND l2.lead >= oc.required_lead - 1e-12) AS hits, count(*) FILTER (WHERE false_proposal) AS f, count(*) FILTER (WHERE unresolved_censored) AS u
    FROM l2 JOIN oc ON oc.method = l2.method AND oc.threshold = l2.threshold GROUP BY ALL) x ON x.car_id = ca.car_id AND x.method = oc.method AND x.required_lead = oc.required_lead AND x.budget = oc.budget)"""
_SELECTS |= {
    "operating_cells": HELDOUT + " SELECT method, required_lead, budget, threshold, state FROM oc",
    "heldout_ledger": HELDOUT + " SELECT * FROM hl",
    "heldout_frontier": HELDOUT + """ SELECT method, budget, coalesce(max(required_lead) FILTER (WHERE h >= (0.1 - 1e-12) * e AND e > 0 AND f <= (budget + 1e-12) * x), 0.0) AS l_star
FROM (SELECT method, budget, required_lead, sum(hits) AS h, sum(events) AS e, sum(false_proposals) AS f, sum(exposure) AS x FROM hl GROUP BY ALL) GROUP BY ALL""",
}
#: Squares of each region: the larger boundary is the outer one.
MAPS = """, mh AS (SELECT r_name AS circuit, r_regionkey AS key, role, a * (r_regionkey + 1.0::DOUBLE) + b AS h FROM region, (VALUES ('outer', 1.0::DOUBLE, 8.0::DOUBLE), ('inner', 0.5, 4.0), ('center', 0.75, 6.0)) v(role, a, b)),
mg AS (SELECT circuit, key, role, i::INT AS idx, h, CASE WHEN i IN (0, 3) THEN -h ELSE h END AS ax, CASE WHEN i IN (0, 1) THEN -h ELSE h END AS ay, CASE WHEN i IN (0, 1) THEN h ELSE -h END AS bx, CASE WHEN i IN (1, 2) THEN h ELSE -h END AS by2, 2 * h AS len, 2 * h * i AS start
  FROM mh, unnest(generate_series(0, 3)) AS g(i))"""
_LOCATE = _SELECTS["corridor_locate"]
_SELECTS["circuit_maps"] = MAPS + " SELECT circuit, role, idx, ax, ay, bx, by2 AS by, round(len, 6) AS length, round(start, 6) AS start FROM mg"
_SELECTS["maps_locate"] = MAPS + _LOCATE.replace("FROM pts, rg)", "FROM pts JOIN mg ON mg.key = pts.id % 5)").replace("SELECT id, inside", "SELECT (SELECT r_name FROM region WHERE r_regionkey = id % 5) AS circuit, id, inside").replace(">= 60", ">= 8 * h.hc").replace("- 60", "- 8 * h.hc").replace("FROM h JOIN n", "FROM (SELECT h.*, 0.75 * (id % 5 + 1) + 6 AS hc FROM h) h JOIN n")
_SELECTS["sealed_changes"] = """, su_ AS (SELECT user_id, user_id % 17 AS n, bool_or(event_id % 2 = 0) AS even FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS name, CASE WHEN n = 5 THEN 'changed' ELSE 'removed' END AS state FROM su_ WHERE n IN (3, 7) OR n = 5 AND even
UNION ALL SELECT (user_id + 1000000)::VARCHAR, 'added' FROM su_ WHERE n = 7"""
_PLATT = f", pt_x AS (SELECT 1 AS g, {_ODDS} AS x, count(*) AS n, sum(y) AS k FROM pb GROUP BY ALL)"
_HALF = "vl + (al + r * vt) * 0.05 * 0.5", "vt + (at_ - r * vl) * 0.05 * 0.5"
_SELECTS |= {
    "platt_fit": _PLATT + newton("pt_f", "pt_x", ["g"], 0.0) + f" SELECT lang, round(avg({_after('p')}), 6) AS mean_calibrated, round(avg(y), 6) AS rate FROM pb, pt_f GROUP BY lang",
    "calibration_line": _PLATT + newton("pt_f", "pt_x", ["g"], -50.0) + " SELECT n::BIGINT AS n, round(intercept, 5) AS intercept, round(slope, 5) AS slope FROM pt_f",
    "transition_residuals": f""", tb AS (SELECT circuit, car_id, seg, frame_index, value / 10 AS vl, depth / 10 AS vt, (k - 50) / 500.0::DOUBLE AS r, depth / 5 AS al, (k - 50) / 50.0::DOUBLE AS at_ FROM tele),
tn AS (SELECT *, lead(vl) OVER w AS n1, lead(vt) OVER w AS n2, lead(r) OVER w AS n3, lead(al) OVER w AS n4, lead(at_) OVER w AS n5 FROM tb WINDOW w AS (PARTITION BY car_id, seg ORDER BY frame_index))
SELECT circuit, car_id, frame_index, 0.05::DOUBLE AS dt, vl AS v_long, vt AS v_lat, r AS yaw_rate, al AS a_long, at_ AS a_lat, round(1e-9 + n1 - (vl + (al + r * ({_HALF[1]})) * 0.05), 6) AS d_v_long, round(1e-9 + n2 - (vt + (at_ - r * ({_HALF[0]})) * 0.05), 6) AS d_v_lat,
  round(1e-9 + (n3 - r), 6) AS d_yaw_rate, round(1e-9 + (n4 - al), 6) AS d_a_long, round(1e-9 + (n5 - at_), 6) AS d_a_lat FROM tn WHERE n1 IS NOT NULL""",
    "ridge_fit": """, rc AS (SELECT car_id, avg(x) AS x, avg(dt) AS d, avg(x * x) AS xx, avg(x * dt) AS xd, avg(dt * dt) AS dd, avg(residual) AS y, avg(x * residual) AS xy, avg(dt * residual) AS dy FROM rp GROUP BY car_id),
rs AS (SELECT count(*)::DOUBLE AS n, sum(x) AS x, sum(d) AS d, sum(xx) + 1 AS xx, sum(xd) AS xd, sum(dd) + 1 AS dd, sum(y) AS y, sum(xy) AS xy, sum(dy) AS dy FROM rc),
rd AS (SELECT n * (xx * dd - xd * xd) - x * (x * dd - xd * d) + d * (x * xd - xx * d) AS det, y * (xx * dd - xd * xd) - x * (xy * dd - xd * dy) + d * (xy * xd - xx * dy) AS b0,
  n * (xy * dd - xd * dy) - y * (x * dd - xd * d) + d * (x * dy - xy * d) AS b1, n * (xx * dy - xy * xd) - x * (x * dy - xy * d) + y * (x * xd - xx * d) AS b2 FROM rs)
SELECT circuit, car_id, frame_index, round((b0 + b1 * x + b2 * dt) / det, 4) AS prediction FROM rp, rd""",
    "rate_upper": """, ru AS (SELECT circuit, lead, sum(false_proposals)::BIGINT AS n, sum(exposure) AS x FROM lg GROUP BY ALL),
rb AS (SELECT circuit, lead, n, x, 0 AS i, n::DOUBLE AS lo, n + 20 * sqrt(n + 1) + 20 AS hi FROM ru
  UNION ALL SELECT circuit, lead, n, x, i + 1, CASE WHEN above THEN mid ELSE lo END, CASE WHEN above THEN hi ELSE mid END FROM (
    SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, n + 1), lambda j: exp(-(lo + hi) / 2 + j * ln((lo + hi) / 2) - lgamma(j + 1)))) > 0.05 AS above FROM rb WHERE i < 80))
SELECT circuit, lead, n AS false_proposals, round(x, 6) AS exposure, round(CASE WHEN x > 0 THEN (lo + hi) / 2 / x END, 6) AS rate_upper FROM rb WHERE i = 80""",
    "manifest_states": """, ml AS (SELECT DISTINCT car_id, split_part(car_id, '_', 2)::BIGINT % 7 AS n FROM units)
SELECT car_id AS path, CASE n WHEN 1 THEN 'missing' WHEN 2 THEN 'size' WHEN 3 THEN 'digest' WHEN 4 THEN 'duplicate' ELSE 'ok' END AS state FROM ml, unnest(CASE WHEN n = 4 THEN [0, 1] ELSE [0] END) AS t(again)""",
    "published_tables": "SELECT c_custkey::BIGINT AS c_custkey, c_acctbal::DOUBLE AS c_acctbal, kind FROM customer, (VALUES ('parquet'), ('csv'), ('jsonl')) v(kind) WHERE c_mktsegment = 'BUILDING'",
}
_SELECTS["residual_training_pairs"] = f""", tb AS (SELECT circuit, car_id, seg, frame_index, t, value, k, arc, active AND pit = 0 AND in_corridor AS ok, value / 10 AS vl, depth / 10 AS vt, (k - 50) / 500.0::DOUBLE AS r, depth / 5 AS al, (k - 50) / 50.0::DOUBLE AS at_ FROM tele),
tn AS (SELECT *, lead(t) OVER w - t AS dt, lead(ok) OVER w AS okn, lead(vl) OVER w AS n1, lead(vt) OVER w AS n2, lead(r) OVER w AS n3, lead(al) OVER w AS n4, lead(at_) OVER w AS n5 FROM tb WINDOW w AS (PARTITION BY car_id, seg ORDER BY frame_index))
SELECT circuit, car_id, frame_index, {", ".join(f"round({v}, 6) AS x{i}" for i, v in enumerate(["vl", "vt", "r", "al", "at_", "k / 20.0::DOUBLE", "arc / 100", "value / 1000", "dt"]))},
  round(1e-9 + (n1 - (vl + (al + r * ({_HALF[1].replace("0.05", "dt")})) * dt)), 6) AS d_v_long, round(1e-9 + (n2 - (vt + (at_ - r * ({_HALF[0].replace("0.05", "dt")})) * dt)), 6) AS d_v_lat,
  round(1e-9 + (n3 - r), 6) AS d_yaw_rate, round(1e-9 + (n4 - al), 6) AS d_a_long, round(1e-9 + (n5 - at_), 6) AS d_a_lat FROM tn WHERE ok AND okn AND dt > 0"""
_ROLLOUT = [[0.01, -0.02, 0.005, 0.1, -0.1], [-0.01, 0.002, 0.001, -0.05, 0.02], [0.005, -0.01, 0.0, 0.02, -0.03], [0.02, 0.01, -0.02, -0.1, 0.05]]
_MORE = [" + ".join(f"{_ROLLOUT[i][k]}::DOUBLE * {z}" for i, z in enumerate(("1", "vl", "vt", "r"))) for k in range(5)]
_SELECTS["residual_rollout"] = f""", ro AS (SELECT id, 0 AS step, x, y, abs(z) AS vl, 0.0::DOUBLE AS vt, w AS yaw, z / 20 AS r, e5 * 10 AS al, e6 * 10 AS at_ FROM pts
  UNION ALL SELECT id, step + 1, x + (({_HALF[0]}) * cos(yaw + r * 0.025::DOUBLE) - ({_HALF[1]}) * sin(yaw + r * 0.025::DOUBLE)) * 0.05::DOUBLE, y + (({_HALF[0]}) * sin(yaw + r * 0.025::DOUBLE) + ({_HALF[1]}) * cos(yaw + r * 0.025::DOUBLE)) * 0.05::DOUBLE,
    vl + (al + r * ({_HALF[1]})) * 0.05::DOUBLE + {_MORE[0]}, vt + (at_ - r * ({_HALF[0]})) * 0.05::DOUBLE + {_MORE[1]}, yaw + r * 0.05::DOUBLE, r + {_MORE[2]}, al + {_MORE[3]}, at_ + {_MORE[4]} FROM ro WHERE step < 10)
SELECT id, step, round(x, 6) AS x2, round(y, 6) AS y2 FROM ro WHERE step > 0"""
_SELECTS["kinematic_diagnostics"] = """, kd AS (SELECT circuit, value AS v, k / 50.0::DOUBLE AS k, lead(value) OVER (PARTITION BY car_id ORDER BY frame_index) AS n FROM tele),
ke AS (SELECT circuit, CASE WHEN sqrt(v * v + v / 2 * v / 2) > 10 THEN (v * cos(k) + v / 2 * sin(k)) / sqrt(v * v + v / 2 * v / 2) END AS a, sqrt((v / 50 - n / 50) ** 2 + (k - 1) ** 2 + 0.01) AS e,
  CASE WHEN sqrt((v / 50) ** 2 + k ** 2 + 0.01) > 0.5 AND sqrt((n / 50) ** 2 + 1) > 0.5 THEN (v / 50 * n / 50 + k) / (sqrt((v / 50) ** 2 + k ** 2 + 0.01) * sqrt((n / 50) ** 2 + 1)) END AS c FROM kd)
SELECT circuit, count(a) AS alignment_count, count(e) AS error_count, count(c) AS cosine_count, round(median(a), 6) AS alignment_median, round(quantile_cont(a, 0.01), 6) AS alignment_p01,
  round(median(e), 6) AS error_median, round(quantile_cont(e, 0.95), 6) AS error_p95, round(median(c), 6) AS cosine_median FROM ke GROUP BY circuit"""
_SELECTS["map_bins"] = MAPS + """, ml_ AS (SELECT circuit, sum(len) AS lap, count(*) AS sides FROM mg WHERE role = 'center' GROUP BY circuit), mb AS (SELECT *, ceil(lap / 25)::INT AS n FROM ml_)
SELECT circuit, round(lap, 6) AS track_length, sides, n AS n_bins, b::INT AS bin, b * 25.0::DOUBLE AS low, round(least(lap, (b + 1) * 25.0::DOUBLE), 6) AS high FROM mb, unnest(generate_series(0, n - 1)) AS g(b)"""
_SELECTS["source_provenance"] = r""", pv AS (SELECT o_custkey::BIGINT AS unit, string_agg('["gr\u00f6\u00dfe/' || o_orderkey || '","' || o_orderkey || '\"x\"",' || o_orderkey || ',"' || sha256(o_orderkey::VARCHAR) || '"]', ',' ORDER BY 'größe/' || o_orderkey) AS t FROM orders GROUP BY 1)
SELECT unit, 'set@r1:dir_' || (unit % 5) AS source_session_id, 'r1' AS revision, sha256('[' || t || ']') AS source_unit_sha256 FROM pv"""
_SELECTS["significant_digits"] = "SELECT event_id, printf('%.9g', value * pow(10.0::DOUBLE, event_id % 21 - 8) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS value FROM events"
_SELECTS["exact_bins"] = """, eb AS (SELECT lb.circuit, lb.car_id, threshold, proposal_number, matched_event_id, q.side AS es, q.bin % 3 AS ebin, pp.bin AS pb FROM lb JOIN pp ON pp.car_id = lb.car_id AND pp.th = lb.threshold AND pp.n = lb.proposal_number LEFT JOIN q ON q.id = lb.matched_event_id)
SELECT circuit, car_id, threshold, proposal_number, matched_event_id, es AS matched_side_at_onset, ebin AS matched_segment_bin, coalesce(pb = ebin, FALSE) AS exact_bin FROM eb"""
_SELECTS["split_alerts"] = _SELECTS["alert_state_machine"]

#: A select that begins with a comma goes on with the common table expressions.
ORACLES = {name: CTES + ("" if sql.startswith(",") else " ") + sql for name, sql in _SELECTS.items()}
