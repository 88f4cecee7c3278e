"""DuckDB SQL for the queries of queries.py."""

FRAMES = "f AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS phn, value FROM events)"
NB = "nb AS (SELECT *, lag(value) OVER (PARTITION BY utt ORDER BY frame) AS a, lead(value) OVER (PARTITION BY utt ORDER BY frame) AS b FROM f)"
PK = "pk AS (SELECT utt, frame, value FROM nb WHERE value >= a AND value >= b AND value >= 60.0)"
PK0 = "pk AS (SELECT utt, frame, value FROM nb WHERE value >= a AND value >= b AND value >= 0.0)"
CL = """cg AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY utt ORDER BY frame) >= 4 THEN 1 ELSE 0 END AS nw FROM pk),
ci AS (SELECT *, sum(nw) OVER (PARTITION BY utt ORDER BY frame)::BIGINT AS cid FROM cg),
d AS (SELECT utt, cid, min(frame) AS c_start, max(frame) + 1 AS c_end, count(*) AS n FROM ci GROUP BY utt, cid)"""
TR = "t AS (SELECT utt, frame - 1 AS t_start, frame + 2 AS t_end FROM f WHERE phn = 'purchase')"
OV = "t.utt = d.utt AND t.t_end > d.c_start AND t.t_start < d.c_end"
V = "v AS (SELECT vec_id, label, unnest(range(0, len(embedding)))::INTEGER AS feat, unnest(embedding)::DOUBLE AS x FROM embeddings)"
BITS = V + ", b AS (SELECT vec_id, label, feat, (x > 0)::INTEGER::DOUBLE AS x FROM v)"
TPL = "ct AS (SELECT label, feat, greatest(0.01, least(0.99, avg(x))) AS p, count(*) AS n FROM b GROUP BY label, feat)"
BGM = "bg AS (SELECT feat, greatest(0.01, least(0.99, avg(x))) AS p FROM b GROUP BY feat)"
FIL = "fl AS (SELECT label, feat, ct.p, ln((ct.p / bg.p) / ((1 - ct.p) / (1 - bg.p))) AS w, ln((1 - ct.p) / (1 - bg.p)) AS c0 FROM ct JOIN bg USING (feat))"
SC = "sc AS (SELECT b.vec_id, fl.label, round(sum(c0 + w * x), 6) AS score FROM b JOIN fl USING (feat) GROUP BY b.vec_id, fl.label)"
BEST = "bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rn FROM sc) WHERE rn = 1)"
PAIRS = "pr AS (SELECT bs.vec_id, bs.label AS pred, e.label AS truth FROM bs JOIN embeddings e USING (vec_id))"
ALL = ", ".join([BITS, TPL, BGM, FIL])
PEAKS, CLUSTERS = ", ".join([FRAMES, NB, PK]), ", ".join([FRAMES, NB, PK, CL])
RUNS = """rg AS (SELECT *, CASE WHEN phn IS NOT DISTINCT FROM lag(phn) OVER (PARTITION BY utt ORDER BY frame) AND frame > 0 THEN 0 ELSE 1 END AS nw FROM f),
ri AS (SELECT *, sum(nw) OVER (PARTITION BY utt ORDER BY frame)::BIGINT - 1 AS seg_idx FROM rg),
sg AS (SELECT utt, seg_idx, phn, min(frame) AS start_frame, max(frame) + 1 AS end_frame FROM ri GROUP BY utt, seg_idx, phn)"""
DET = """fb AS (SELECT utt, frame, floor(value / 100)::INTEGER AS f FROM f UNION ALL SELECT utt, frame, 5 FROM f WHERE phn = 'purchase'),
bank AS (SELECT (i // 24)::INTEGER AS comp, (i % 24) // 6 AS dt, (i % 6)::INTEGER AS f, (((i // 24) * 3 + ((i % 24) // 6) * 7 + (i % 6) * 5) % 9 - 4) / 4.0::DOUBLE AS w FROM range(72) r(i)),
vt AS (SELECT utt, comp, frame - dt AS frame, sum(w) AS s FROM fb JOIN bank USING (f) GROUP BY ALL),
sp AS (SELECT utt, frame, count(*) OVER (PARTITION BY utt) AS n FROM f),
dt AS (SELECT sp.utt, sp.frame, k.i::INTEGER AS comp, k.i / -8.0::DOUBLE + coalesce(vt.s, 0) AS score FROM sp JOIN range(3) k(i) ON sp.frame <= sp.n - 4 LEFT JOIN vt ON vt.utt = sp.utt AND vt.frame = sp.frame AND vt.comp = k.i),
db AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt, frame ORDER BY score DESC, comp) AS rn FROM dt) WHERE rn = 1)"""
JUDGED = "j AS (SELECT n_chars::DOUBLE AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id))"
ROC = JUDGED + """, h AS (SELECT score, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS q FROM j GROUP BY score),
roc AS (SELECT score, p, sum(q) OVER (ORDER BY score DESC)::DOUBLE / (SELECT sum(q) FROM h)::DOUBLE AS fpr, sum(p) OVER (ORDER BY score DESC)::DOUBLE / (SELECT sum(p) FROM h)::DOUBLE AS tpr FROM h),
rc AS (SELECT score, fpr, tpr FROM roc WHERE p > 0)"""
TWO = ", ".join([BITS, TPL]) + """, gb AS (SELECT feat % 8 AS feat, greatest(0.01, least(0.99, avg(x))) AS p FROM b GROUP BY feat % 8),
zt AS (SELECT feat // 8 AS dt, feat % 8 AS feat, p FROM ct WHERE label = 0),
ly AS (SELECT k.i AS comp, dt, feat, p FROM zt CROSS JOIN range(5) k(i) WHERE dt < 5 UNION ALL SELECT k.i, dt - 3 + k.i, feat, p FROM zt CROSS JOIN range(5) k(i) WHERE dt >= 3),
la AS (SELECT comp, dt, feat, avg(p) AS p FROM ly GROUP BY comp, dt, feat),
df AS (SELECT k.i::INTEGER AS comp, j.i::INTEGER AS dt, gb.feat::INTEGER AS feat, coalesce(la.p, gb.p) AS p FROM gb CROSS JOIN range(5) k(i) CROSS JOIN range(10) j(i) LEFT JOIN la ON la.comp = k.i AND la.dt = j.i AND la.feat = gb.feat)"""
PER_TRUTH =", ".join([FRAMES, NB, PK0, TR]) + ", mp AS (SELECT t.utt, t.t_start, max(pk.value) AS best FROM t LEFT JOIN pk ON t.utt = pk.utt AND pk.frame >= t.t_start AND pk.frame < t.t_start + 3 GROUP BY t.utt, t.t_start)"


def _edges() -> str:
    parts = []
    lines = ((0, "freq", "frame"), (1, "frame", "freq"), (2, "frame - freq", "frame"), (3, "frame + freq", "frame"))
    for o, line, along in lines:
        parts.append(
            f"SELECT utt, {o} AS o, dd, lag(dd) OVER (PARTITION BY utt, ln ORDER BY al) AS a, lead(dd) OVER (PARTITION BY utt, ln ORDER BY al) AS b FROM "
            f"(SELECT utt, {line} AS ln, {along} AS al, lead(x) OVER (PARTITION BY utt, {line} ORDER BY {along}) - x AS dd FROM c) WHERE dd IS NOT NULL"
        )
    return f"""WITH {V}, c AS (SELECT label AS utt, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, feat AS freq, x FROM v),
e AS ({' UNION ALL '.join(parts)}),
s AS (SELECT utt, o AS orient, dd, a, b FROM e UNION ALL SELECT utt, o + 4, -dd, -a, -b FROM e)
SELECT utt, orient, count(*) AS n, round(sum(dd), 6) AS total FROM s WHERE dd > 0 AND (a IS NULL OR dd > a) AND (b IS NULL OR dd >= b) GROUP BY utt, orient"""


RG = """rgs AS (SELECT d.utt, d.c_start AS start, k.i AS dt, f.value FROM d CROSS JOIN range(5) k(i)
JOIN f ON f.utt = d.utt AND f.frame = d.c_start + least(d.c_end - d.c_start - 1, floor(k.i / 5.0::DOUBLE * (d.c_end - d.c_start) + 0.5)::BIGINT))"""


def LQ(x: str) -> str:
    """The logarithm by a table of hundredths."""
    return f"CASE WHEN floor(100.0::DOUBLE * {x} + 0.5) <= 0 THEN -13.8155::DOUBLE ELSE ln(floor(100.0::DOUBLE * {x} + 0.5) / 100) END"


SQL = {
    "frame_spine": f"WITH {FRAMES} SELECT utt, frame, phn, round(value, 6) AS value FROM f",
    "preemphasis": f"WITH {FRAMES} SELECT utt, frame, round(coalesce(value - 0.97::DOUBLE * lag(value) OVER (PARTITION BY utt ORDER BY frame), value), 6) AS y FROM f",
    "delta_slope": f"WITH {FRAMES} SELECT utt, frame, round(regr_slope(value, frame::DOUBLE) OVER (PARTITION BY utt ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS slope FROM f",
    "adaptive_background": f"WITH {FRAMES} SELECT utt, frame, round(CASE WHEN frame <= 10 THEN 100.0 ELSE greatest(50.0, least(300.0, avg(value) OVER (PARTITION BY utt ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))) END::DOUBLE, 6) AS background FROM f",
    "centered_max": f"WITH {FRAMES}, m AS (SELECT *, max(value) OVER (PARTITION BY utt ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mx, count(*) OVER (PARTITION BY utt) AS n FROM f) SELECT utt, frame, value FROM m WHERE value = mx AND frame >= 3 AND frame < n - 3",
    "block_quantile_edges": f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY utt) AS n FROM f),
g AS (SELECT *, CASE WHEN frame // 20 < n // 20 THEN frame // 20 ELSE -1 END AS own FROM n),
e AS (SELECT utt, value, own AS g FROM g WHERE own >= 0 UNION ALL SELECT utt, value, -1 FROM g WHERE frame >= n - 20 AND n % 20 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY utt, g ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY utt, g) AS c FROM e WHERE value > 0),
t AS (SELECT utt, g, greatest(value, 0.0::DOUBLE) AS threshold FROM r WHERE r = floor(0.7::DOUBLE * c))
SELECT g.utt, frame, threshold, CASE WHEN value >= threshold THEN 1 ELSE 0 END AS bit FROM g LEFT JOIN t ON g.utt = t.utt AND g.own = t.g""",
    "edge_nms": _edges(),
    "dilate": f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY utt) AS n FROM f), x AS (SELECT utt, frame + k.i AS frame, n FROM n, range(-2, 3) k(i) WHERE value >= 400) SELECT DISTINCT utt, frame FROM x WHERE frame >= 0 AND frame < n",
    "coarse_maxpool": f"WITH {FRAMES} SELECT utt, frame // 4 AS cell, max(value) AS value FROM f GROUP BY utt, frame // 4 HAVING count(*) = 4",
    "zero_cross": f"""WITH {FRAMES}, n AS (SELECT utt, frame, value - 245 AS s, count(*) OVER (PARTITION BY utt) AS n FROM f),
w AS (SELECT utt, k.i AS win, frame, s FROM n JOIN range(0, 1000) k(i) ON frame >= k.i * 10 AND frame < k.i * 10 + 20 AND k.i * 10 + 20 <= n),
p AS (SELECT *, CASE WHEN s * lag(s) OVER (PARTITION BY utt, win ORDER BY frame) > 0 THEN 1 ELSE 0 END AS q FROM w)
SELECT utt, win, round(sum(q)::DOUBLE / 20, 6) AS rate FROM p GROUP BY utt, win""",
    "wiener_entropy": f"WITH {V}, p AS (SELECT vec_id, x * x + 1e-6::DOUBLE AS p FROM v) SELECT vec_id, round(exp(avg(ln(p))) / avg(p), 6) AS entropy FROM p GROUP BY vec_id",
    "label_runs": f"WITH {FRAMES}, {RUNS} SELECT * FROM sg",
    "pattern_match": f"WITH {FRAMES}, n AS (SELECT *, lead(phn) OVER (PARTITION BY utt ORDER BY frame) AS b FROM f) SELECT utt, frame AS start_frame, frame + 2 AS end_frame FROM n WHERE phn = 'view' AND b = 'click'",
    "kgram_counts": f"WITH {FRAMES}, n AS (SELECT phn, lead(phn) OVER w AS b, lead(phn, 2) OVER w AS c FROM f WINDOW w AS (PARTITION BY utt ORDER BY frame)) SELECT phn || ' ' || b || ' ' || c AS gram, count(*) AS n FROM n WHERE phn IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1",
    "diphone_dense": f"WITH {FRAMES}, k AS (SELECT DISTINCT phn FROM f), n AS (SELECT phn AS a, lead(phn) OVER (PARTITION BY utt ORDER BY frame) AS b FROM f) SELECT x.phn AS a, y.phn AS b, count(n.a) AS n FROM k x CROSS JOIN k y LEFT JOIN n ON n.a = x.phn AND n.b = y.phn GROUP BY x.phn, y.phn",
    "label_map_hist": "SELECT r_name AS cls, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "peaks": f"WITH {PEAKS} SELECT * FROM pk",
    "max_peak_per_truth": f"WITH {PER_TRUTH} SELECT * FROM mp",
    "detection_clusters_c0": f"WITH {CLUSTERS} SELECT * FROM d",
    "overlap_hits": f"WITH {CLUSTERS}, {TR} SELECT d.*, (SELECT count(*) FROM t WHERE {OV}) AS hits FROM d",
    "false_alarms": f"WITH {CLUSTERS}, {TR} SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM t WHERE {OV})",
    "missed_truths": f"WITH {CLUSTERS}, {TR} SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE {OV})",
    "detection_records": f"""WITH {CLUSTERS}, {TR}, m AS (SELECT d.utt AS du, d.cid, t.utt AS tu, t.t_start FROM d JOIN t ON t.utt = d.utt AND t.t_start - 2 < d.c_end AND t.t_start + 2 >= d.c_start)
SELECT CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.du = d.utt AND m.cid = d.cid) THEN 'tp' ELSE 'fp' END AS kind, utt, c_start AS start, c_end AS "end" FROM d
UNION ALL SELECT 'fn', utt, t_start, t_end FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tu = t.utt AND m.t_start = t.t_start)""",
    "negative_windows": f"""WITH {FRAMES}, {TR}, w AS (SELECT utt, frame // 6 * 6 AS start, frame // 6 * 6 + 6 AS e FROM f GROUP BY utt, frame // 6 HAVING count(*) = 6)
SELECT utt, start, e AS "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.utt = w.utt AND t.t_end + 1 > w.start AND t.t_start - 1 < w.e)""",
    "label_context_asof": f"WITH {PEAKS}, {RUNS}, s AS (SELECT *, lead(phn) OVER (PARTITION BY utt ORDER BY start_frame) AS next_phn FROM sg) SELECT pk.utt, pk.frame, s.phn, s.next_phn FROM pk JOIN s ON pk.utt = s.utt AND pk.frame >= s.start_frame AND pk.frame < s.end_frame",
    "bg_mean": f"WITH {BITS}, {BGM} SELECT feat, round(p, 6) AS p FROM bg",
    "class_templates": f"WITH {BITS}, {TPL} SELECT label, feat, round(p, 6) AS p, n FROM ct",
    "llr_filter": f"WITH {ALL} SELECT label, feat, round(w, 6) AS w, round(c0, 6) AS c0 FROM fl",
    "llr_cumulative_bias": f"WITH {ALL} SELECT label, feat, round(sum(c0) OVER (PARTITION BY label ORDER BY feat), 6) AS c FROM fl",
    "sparse_detect": f"WITH {FRAMES}, {DET} SELECT utt, frame, comp, round(score, 6) AS score FROM dt",
    "detect_argmax": f"WITH {FRAMES}, {DET} SELECT utt, frame, comp, round(score, 6) AS score FROM db",
    "segment_classify": f"""WITH {FRAMES}, {DET}, {RUNS}, z AS (SELECT *, (end_frame - start_frame) // 3 AS th, max(end_frame) OVER (PARTITION BY utt) AS e FROM sg),
q AS (SELECT z.utt, z.seg_idx, db.frame, db.comp, db.score, row_number() OVER (PARTITION BY z.utt, z.seg_idx ORDER BY db.score DESC, db.frame) AS r2 FROM z JOIN db ON z.utt = db.utt AND db.frame >= greatest(0, start_frame - th) AND db.frame < least(e, start_frame + greatest(th, 1)))
SELECT utt, seg_idx, frame AS loc, comp, round(score, 6) AS score FROM q WHERE r2 = 1""",
    "classify_embeddings": f"WITH {ALL}, {SC}, {BEST} SELECT vec_id, label AS pred, score FROM bs",
    "confusion_matrix": f"WITH {ALL}, {SC}, {BEST}, {PAIRS} SELECT pred, truth, count(*) AS n FROM pr GROUP BY pred, truth",
    "confusion_rollup": f"WITH {ALL}, {SC}, {BEST}, {PAIRS} SELECT coalesce(pred, -1) AS pred, coalesce(truth, -1) AS truth, count(*) AS n FROM pr GROUP BY CUBE (pred, truth)",
    "class_error_rate": f"WITH {ALL}, {SC}, {BEST}, {PAIRS} SELECT round(avg((pred <> truth)::INTEGER), 6) AS error FROM pr",
    "roc_classify": f"WITH {ROC} SELECT score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rc",
    "fom": f"WITH {ROC} SELECT round(avg(tpr) FILTER (WHERE fpr >= 1::DOUBLE / 360 AND fpr <= 10::DOUBLE / 360), 6) AS fom FROM rc",
    "mean_tpr": f"WITH {ROC}, m AS (SELECT k.i, arg_min(tpr, (fpr, tpr)) AS tpr FROM rc JOIN range(1, 11) k(i) ON fpr >= k.i::DOUBLE / 60 GROUP BY k.i) SELECT round(avg(tpr), 6) AS mean_tpr FROM m",
    "roc_detect": f"""WITH {FRAMES}, {NB}, {PK0}, {TR}, th AS (SELECT i * 50.0::DOUBLE AS threshold FROM range(1, 10) k(i)),
p AS (SELECT th.threshold, pk.utt, pk.frame FROM pk JOIN th ON pk.value >= th.threshold),
g AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY threshold, utt ORDER BY frame) >= 4 THEN 1 ELSE 0 END AS nw FROM p),
i AS (SELECT *, sum(nw) OVER (PARTITION BY threshold, utt ORDER BY frame) AS cid FROM g),
d AS (SELECT threshold, utt, cid, min(frame) AS c_start, max(frame) + 1 AS c_end FROM i GROUP BY threshold, utt, cid),
m AS (SELECT d.threshold, d.utt, d.cid, t.t_start FROM d JOIN t ON {OV})
SELECT th.threshold, (SELECT count(*) FROM d WHERE d.threshold = th.threshold) AS clusters, (SELECT count(DISTINCT (utt, cid)) FROM m WHERE m.threshold = th.threshold) AS hits,
(SELECT count(DISTINCT (utt, t_start)) FROM m WHERE m.threshold = th.threshold) AS found FROM th""",
    "threshold_pct": f"WITH {PER_TRUTH}, r AS (SELECT best, row_number() OVER (ORDER BY best NULLS FIRST) - 1 AS r, count(*) OVER () AS n, count(*) FILTER (WHERE best IS NULL) OVER () AS z FROM mp) SELECT best AS threshold FROM r WHERE r = greatest(floor((n - 1) * 30 / 100.0::DOUBLE), z)",
    "topn_hardest_fp": f"WITH {ALL}, {SC}, w AS (SELECT sc.label, sc.vec_id, sc.score, row_number() OVER (PARTITION BY sc.label ORDER BY sc.score DESC, sc.vec_id) AS rank FROM sc JOIN embeddings e USING (vec_id) WHERE sc.label <> e.label) SELECT label, rank::INTEGER AS rank, vec_id, score FROM w WHERE rank <= 5",
    "quantize_template": f"WITH {BITS}, {TPL} SELECT label, feat, round(CASE WHEN p < 1 THEN (floor(p * 24) + 0.5) / 24 ELSE p END, 6) AS p FROM ct",
    "log_quantizer": f"WITH {BITS}, {TPL}, q AS (SELECT label, feat, floor(100.0::DOUBLE * round(p, 6) + 0.5) AS i FROM ct) SELECT label, feat, round(CASE WHEN i <= 0 THEN -13.8155 ELSE ln(i / 100) END::DOUBLE, 6) AS logp FROM q",
    "structured_alternative": f"""WITH {BITS}, {TPL}, o AS (SELECT * FROM ct WHERE label = 0 AND feat < 50), w AS (SELECT * FROM ct WHERE label = 1 AND feat >= 10),
z AS (SELECT coalesce(o.feat, w.feat) AS feat, coalesce(o.p, 0.5) AS a, coalesce(w.p, 0.5) AS b FROM o FULL JOIN w ON o.feat = w.feat)
SELECT feat, round(ln((a / b) / ((1 - a) / (1 - b))), 6) AS w, round(ln((1 - a) / (1 - b)), 6) AS c0 FROM z""",
    "gaussian_llr": f"""WITH {V}, m AS (SELECT label, feat, avg(x) AS mu, var_pop(x) AS v FROM v GROUP BY label, feat), g AS (SELECT feat, avg(x) AS bm, var_pop(x) AS bv FROM v GROUP BY feat)
SELECT label, feat, round(0.5 / bv - 0.5 / v, 6) AS q, round(mu / v - bm / bv, 6) AS l, round(0.5 * bm * bm / bv - 0.5 * mu * mu / v + 0.5 * ln(bv / v), 6) AS c FROM m JOIN g USING (feat)""",
    "part_code": f"""WITH {BITS}, on_ AS (SELECT vec_id AS key, feat AS pos FROM b WHERE x = 1),
pt AS (SELECT (i // 8 + 1)::INTEGER AS part, (i % 8)::INTEGER AS off, (((i // 8 + 1) * 5 + (i % 8) * 3) % 7 + 1) / 9.0::DOUBLE AS p FROM range(32) k(i)),
ce AS (SELECT vec_id AS key, unnest(range(0, 57, 8))::INTEGER AS cell FROM embeddings),
pa AS (SELECT ce.key, ce.cell, o.pos - ce.cell AS off FROM ce JOIN on_ o ON o.key = ce.key AND o.pos >= ce.cell AND o.pos < ce.cell + 8),
ed AS (SELECT key, cell, count(*) AS n FROM pa GROUP BY key, cell),
co AS (SELECT part, sum(ln(1 - p)) AS c FROM pt GROUP BY part),
sm AS (SELECT key, cell, pa2.part, round(sum(ln(p / (1 - p))) + min(c), 9) AS s FROM pa JOIN pt pa2 ON pa2.off = pa.off JOIN co ON co.part = pa2.part GROUP BY key, cell, pa2.part),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, cell ORDER BY s DESC, part) AS rn FROM sm) WHERE rn = 1)
SELECT ce.key, ce.cell, CASE WHEN coalesce(ed.n, 0) >= 3 THEN bp.part ELSE 0 END AS part FROM ce LEFT JOIN ed USING (key, cell) LEFT JOIN bp USING (key, cell)""",
    "second_stage_llr": f"""WITH {ALL}, {SC}, {BEST}, {PAIRS}, q AS (SELECT label AS pred, feat, CASE WHEN p < 1 THEN (floor(p * 12) + 0.5) / 12 ELSE p END AS p FROM fl)
SELECT b.vec_id, pr.pred, pr.pred = pr.truth AS positive, round(sum(ln(1 - q.p) + ln(q.p / (1 - q.p)) * b.x), 6) AS score FROM b JOIN pr USING (vec_id) JOIN q ON q.pred = pr.pred AND q.feat = b.feat GROUP BY b.vec_id, pr.pred, pr.truth""",
    "streaming_quantile": f"WITH {FRAMES} SELECT utt, frame, round(quantile_cont(value, 0.5) OVER (PARTITION BY utt ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS quantile FROM f",
    "strict_peaks": f"WITH {PEAKS} SELECT pk.* FROM pk JOIN nb USING (utt, frame) WHERE nb.value > a OR nb.value > b",
    "clusters_own_length": f"""WITH {PEAKS}, g AS (SELECT *, CASE WHEN frame - lag(frame) OVER w >= lag(frame % 3 + 3) OVER w THEN 1 ELSE 0 END AS nw FROM pk WINDOW w AS (PARTITION BY utt ORDER BY frame)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY utt ORDER BY frame)::BIGINT AS cid FROM g)
SELECT utt, cid, min(frame) AS c_start, max(frame) + 1 AS c_end, count(*) AS n FROM i GROUP BY utt, cid""",
    "example_slices": f"WITH {FRAMES}, {TR} SELECT t.utt, t.t_start AS start, k.i AS dt, coalesce(f.value, 100.0::DOUBLE) AS value FROM t CROSS JOIN range(3) k(i) LEFT JOIN f ON f.utt = t.utt AND f.frame = t.t_start + k.i",
    "score_cutoffs": f"WITH {ALL}, {SC}, h AS (SELECT label, score, sum(count(*)) OVER (PARTITION BY label ORDER BY score DESC) AS run FROM sc GROUP BY label, score) SELECT label, min(score) AS cutoff FROM h WHERE run <= 20 GROUP BY label",
    "second_stage_roc": f"""WITH {ALL}, {SC}, {BEST}, {PAIRS}, q AS (SELECT label AS pred, feat, CASE WHEN p < 1 THEN (floor(p * 12) + 0.5) / 12 ELSE p END AS p FROM fl),
z AS (SELECT b.vec_id, pr.pred, pr.pred = pr.truth AS positive, round(sum(ln(1 - q.p) + ln(q.p / (1 - q.p)) * b.x), 6) AS score FROM b JOIN pr USING (vec_id) JOIN q ON q.pred = pr.pred AND q.feat = b.feat GROUP BY b.vec_id, pr.pred, pr.truth),
h AS (SELECT pred, score, count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS n FROM z GROUP BY pred, score),
r AS (SELECT pred, score, p, sum(n) OVER w AS fp, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY pred) AS al FROM h WINDOW w AS (PARTITION BY pred ORDER BY score DESC)),
m AS (SELECT truth AS pred, count(*) AS missed FROM pr WHERE pred <> truth GROUP BY truth)
SELECT pred, score, round(fp / 100.0::DOUBLE, 6) AS fps, round(tp::DOUBLE / (al + coalesce(missed, 0))::DOUBLE, 6) AS tpr FROM r LEFT JOIN m USING (pred) WHERE p > 0""",
    "response_density": f"WITH {FRAMES} SELECT phn, k.i * 25.0::DOUBLE AS at, round(avg(exp(-0.5::DOUBLE * ((k.i * 25.0::DOUBLE - value) / 20) ** 2)) / 20 / sqrt(2 * pi()), 9) AS density FROM f CROSS JOIN range(21) k(i) GROUP BY phn, k.i",
    "two_part_templates": f"WITH {TWO} SELECT comp, dt, feat, round(p, 6) AS p FROM df",
    "deform_fit": f"""WITH {TWO}, w AS (SELECT comp, dt * 8 + df.feat AS feat, ln((df.p / gb.p) / ((1 - df.p) / (1 - gb.p))) AS w, ln((1 - df.p) / (1 - gb.p)) AS c0 FROM df JOIN gb USING (feat) WHERE dt < 8),
z AS (SELECT vec_id, comp, round(sum(c0 + w * x), 6) AS score FROM b JOIN w USING (feat) GROUP BY vec_id, comp)
SELECT vec_id, comp, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, comp) AS rn FROM z) WHERE rn = 1""",
    "retrain_filters": f"""WITH {ALL}, {SC}, {BEST}, {PAIRS}, sd AS (SELECT vec_id, truth AS label, 1 AS side FROM pr UNION ALL SELECT vec_id, pred, 0 FROM pr WHERE pred <> truth),
m AS (SELECT sd.label, feat, coalesce(greatest(0.01, least(0.99, avg(x) FILTER (WHERE side = 1))), 0.5) AS a0, count(*) FILTER (WHERE side = 1) AS n1, coalesce(greatest(0.01, least(0.99, avg(x) FILTER (WHERE side = 0))), 0.5) AS b0, count(*) FILTER (WHERE side = 0) AS n0 FROM b JOIN sd USING (vec_id) GROUP BY sd.label, feat),
g AS (SELECT label, feat, CASE WHEN n1 > 0 THEN a0 ELSE 0.5 END::DOUBLE AS a, CASE WHEN n0 > 0 THEN b0 ELSE 0.5 END::DOUBLE AS b FROM m)
SELECT label, feat, round(ln((a / b) / ((1 - a) / (1 - b))), 6) AS w, round(ln((1 - a) / (1 - b)), 6) AS c0 FROM g""",
    "negative_templates": f"WITH {ALL} SELECT label, feat, round(1 / (1 + (1 / p - 1) * exp(w)), 6) AS q FROM fl",
    "weighted_templates": f"""WITH {BITS}, a AS (SELECT vec_id, k.i::INTEGER AS comp, CASE WHEN k.i = 0 THEN (vec_id % 5 + 1) / 6.0::DOUBLE ELSE 1 - (vec_id % 5 + 1) / 6.0::DOUBLE END AS a FROM embeddings CROSS JOIN range(2) k(i))
SELECT comp, feat, round(greatest(0.01, least(0.99, sum(a * x) / sum(a))), 6) AS p FROM b JOIN a USING (vec_id) GROUP BY comp, feat""",
    "spread_parts": f"WITH {FRAMES}, {DET} SELECT DISTINCT utt, frame + x.i AS frame, (f + y.i)::INTEGER AS freq, frame % 3 AS part FROM fb CROSS JOIN range(-1, 2) x(i) CROSS JOIN range(-1, 2) y(i)",
    "neighbour_parts": f"WITH {FRAMES}, {DET} SELECT utt, frame, f AS part FROM fb UNION SELECT utt, frame, (f + 1) % 6 FROM fb",
    "cascade_bank": f"""WITH {ALL}, {SC}, {BEST}, {PAIRS}, q AS (SELECT label AS pred, feat, k.i AS scorer, CASE WHEN k.i = 0 THEN p ELSE (floor(p * k.i) + 0.5) / k.i END AS p FROM fl CROSS JOIN (VALUES (0), (3), (12)) k(i))
SELECT b.vec_id, pr.pred, q.scorer, round(sum(ln(1 - q.p) + ln(q.p / (1 - q.p)) * b.x), 6) AS score FROM b JOIN pr USING (vec_id) JOIN q ON q.pred = pr.pred AND q.feat = b.feat GROUP BY b.vec_id, pr.pred, q.scorer""",
    "ordered_split": f"WITH {FRAMES}, u AS (SELECT DISTINCT utt FROM f), r AS (SELECT utt, percent_rank() OVER (ORDER BY utt) AS r FROM u) SELECT utt, r < 0.7::DOUBLE AS train, utt % 5 AS fold FROM r",
    "gaussian_smooth": f"""WITH {FRAMES} SELECT utt, frame, round(0.0625::DOUBLE * coalesce(lag(value, 2) OVER w, 0) + 0.25::DOUBLE * coalesce(lag(value) OVER w, 0) + 0.375::DOUBLE * value
+ 0.25::DOUBLE * coalesce(lead(value) OVER w, 0) + 0.0625::DOUBLE * coalesce(lead(value, 2) OVER w, 0), 6) AS smoothed FROM f WINDOW w AS (PARTITION BY utt ORDER BY frame)""",
    "overlap_quantile_edges": f"""WITH {FRAMES}, k AS (SELECT DISTINCT utt, frame // 12 AS k FROM f),
e AS (SELECT k.utt, k.k, value, row_number() OVER (PARTITION BY k.utt, k.k ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY k.utt, k.k) AS c FROM k JOIN f ON f.utt = k.utt AND frame >= k.k * 12 - 6 AND frame < k.k * 12 + 18)
SELECT f.utt, frame, e.value AS threshold, (f.value >= e.value)::INTEGER AS bit FROM f JOIN e ON e.utt = f.utt AND e.k = frame // 12 AND r = floor(0.8::DOUBLE * c)""",
    "directed_dilation": f"""WITH {FRAMES}, {DET}, n AS (SELECT utt, count(*) AS n FROM f GROUP BY utt), o AS (SELECT utt, frame, f, n, (frame % 8)::INTEGER AS orient FROM fb JOIN n USING (utt)),
x AS (SELECT utt, n, orient, frame + k.i * CASE WHEN orient % 4 = 1 THEN 0 ELSE 1 END AS frame, (f + k.i * CASE orient % 4 WHEN 0 THEN 0 WHEN 3 THEN -1 ELSE 1 END)::INTEGER AS freq FROM o CROSS JOIN range(-2, 3) k(i))
SELECT DISTINCT utt, frame, freq, orient FROM x WHERE frame >= 0 AND frame < n AND freq >= 0 AND freq < 6""",
    "channel_pyramid": f"WITH {V} SELECT vec_id, k.i::INTEGER AS level, (feat >> k.i::INTEGER)::BIGINT AS band, round(sum(x), 6) AS x FROM v CROSS JOIN range(4) k(i) GROUP BY ALL",
    "register_time": f"WITH {CLUSTERS}, {RG} SELECT utt, start, dt, value FROM rgs",
    "registered_template": f"WITH {CLUSTERS}, {RG} SELECT dt, round(avg(value), 6) AS mean, count(*) AS n FROM rgs GROUP BY dt",
    "pattern_part_times": f"""WITH {FRAMES}, n AS (SELECT *, lead(phn) OVER (PARTITION BY utt ORDER BY frame) AS b FROM f)
SELECT utt, frame AS start_frame, k.i::INTEGER AS part, frame + k.i AS p_start, frame + k.i + 1 AS p_end FROM n CROSS JOIN range(2) k(i) WHERE phn = 'view' AND b = 'click'""",
    "pattern_utterances": f"""WITH {FRAMES}, n AS (SELECT *, lead(phn) OVER w AS b, lead(phn, 2) OVER w AS c FROM f WINDOW w AS (PARTITION BY utt ORDER BY frame))
SELECT utt, coalesce(bool_or(coalesce(phn = 'view' AND b = 'click' AND c = 'purchase', false)), false) AS has FROM n GROUP BY utt""",
    "label_set": f"WITH {FRAMES} SELECT phn, count(DISTINCT utt) AS utterances FROM f GROUP BY phn",
    "largest_peak": f"""WITH {FRAMES}, {NB}, p AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY value DESC, frame) AS rn FROM nb WHERE value >= a AND value >= b)
SELECT u.utt, coalesce(p.frame, -1) AS frame, p.value FROM (SELECT DISTINCT utt FROM f) u LEFT JOIN p ON p.utt = u.utt AND rn = 1""",
    "seeded_sample": f"WITH {FRAMES} SELECT utt FROM (SELECT DISTINCT utt FROM f) ORDER BY md5('7:' || utt), utt LIMIT 10",
    "grid_cells": f"WITH {V}, g AS (SELECT vec_id, feat % 8 AS h, (feat // 8)::BIGINT AS z, x FROM v) SELECT vec_id, h, z, floor((h + 2) / 4.0::DOUBLE)::BIGINT AS coarse, round(x, 6) AS x FROM g WHERE h % 2 = 0 AND z % 4 = 0",
    "label_pairs_by_half": f"""WITH {FRAMES}, p AS (SELECT utt, phn AS a, lead(phn) OVER w AS b, lead(value) OVER w AS v FROM f WINDOW w AS (PARTITION BY utt ORDER BY frame)),
g AS (SELECT a, b, floor(v / 20)::BIGINT AS level, bool_or(utt % 2 = 0) AS e, bool_or(utt % 2 = 1) AS o FROM p WHERE b IS NOT NULL AND v > 350 GROUP BY ALL)
SELECT a, b, level, CASE WHEN e AND o THEN 'both' WHEN e THEN 'even' ELSE 'odd' END AS side FROM g""",
    "length_histogram": f"WITH {CLUSTERS} SELECT c_end - c_start AS len, count(*) AS n FROM d GROUP BY 1",
    "detect_values": f"""WITH {FRAMES}, {DET}, vx AS (SELECT fb.utt, comp, fb.frame - bank.dt AS frame, sum(w * (value % 100)) AS s FROM fb JOIN bank USING (f) JOIN f fr ON fr.utt = fb.utt AND fr.frame = fb.frame GROUP BY ALL)
SELECT sp.utt, sp.frame, k.i::INTEGER AS comp, round(k.i / -8.0::DOUBLE + coalesce(vx.s, 0), 6) AS score FROM sp JOIN range(3) k(i) ON sp.frame <= sp.n - 4 LEFT JOIN vx ON vx.utt = sp.utt AND vx.frame = sp.frame AND vx.comp = k.i""",
    "best_per_example": f"WITH {FRAMES}, {DET} SELECT utt, comp, score, frame FROM (SELECT *, row_number() OVER (PARTITION BY utt, comp ORDER BY score DESC, frame) AS rn FROM dt) WHERE rn = 1",
    "component_threshold": f"WITH {FRAMES}, {DET} SELECT utt, frame, comp, round(score, 6) AS score FROM db WHERE score >= comp * 0.5::DOUBLE",
    "salient_counts": f"WITH {ALL} SELECT b.vec_id, fl.label, sum(b.x)::BIGINT AS n FROM b JOIN fl USING (feat) WHERE fl.p > 0.6::DOUBLE GROUP BY ALL",
    "hard_assignments": f"""WITH {ALL}, {SC}, e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM sc), h AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS a FROM e)
SELECT vec_id, label, round(a, 6) AS a FROM h WHERE a > 0.95::DOUBLE""",
    "direct_scores": f"""WITH {ALL}, c AS (SELECT ct.label, feat, ct.p, bg.p AS g FROM ct JOIN bg USING (feat)),
q AS (SELECT *, {LQ('p')} - {LQ('g')} AS w1, {LQ('(1 - p)')} - {LQ('(1 - g)')} AS w0 FROM c)
SELECT b.vec_id, q.label, round(sum(x * (ln(p) - ln(g)) + (1 - x) * (ln(1 - p) - ln(1 - g))), 6) AS exact, round(sum(x * w1 + (1 - x) * w0), 6) AS by_table FROM b JOIN q USING (feat) GROUP BY b.vec_id, q.label""",
    "background_spread": f"WITH {V} SELECT feat, round(var_pop(x) * count(x) / (count(x) + 1), 9) AS spread FROM v GROUP BY feat",
    "edge_patches": f"""WITH {FRAMES}, {DET}, p AS (SELECT fb.utt, fb.frame - k.i AS start, k.i AS dt, fb.f FROM fb JOIN sp USING (utt, frame) CROSS JOIN range(3) k(i) WHERE fb.frame - k.i >= 0 AND fb.frame - k.i + 3 <= sp.n)
SELECT utt, start, count(*) AS n, string_agg(dt || ':' || f, ',' ORDER BY dt, f) AS cells FROM p GROUP BY utt, start HAVING count(*) >= 4 AND count(*) < 6""",
    "coarse_to_fine": f"""WITH {ALL}, {SC}, po AS (SELECT vec_id, feat // 4 AS feat, max(x) AS x FROM b GROUP BY ALL), ro AS (SELECT label, feat // 4 AS feat, avg(w) AS w, avg(c0) AS c0 FROM fl GROUP BY ALL),
co AS (SELECT po.vec_id, ro.label, round(sum(c0 + w * x), 6) AS coarse FROM po JOIN ro USING (feat) GROUP BY ALL)
SELECT co.vec_id, co.label, co.coarse, sc.score FROM co JOIN sc USING (vec_id, label) WHERE coarse >= 0""",
    "three_part_templates": f"""WITH {TWO}, mv AS (SELECT x.i AS f, y.i AS b FROM range(-2, 3) x(i) CROSS JOIN range(-2, 3) y(i)),
pl AS (SELECT f, b, dt, feat, p FROM zt CROSS JOIN mv WHERE dt < 4 UNION ALL SELECT f, b, dt - f, feat, p FROM zt CROSS JOIN mv WHERE dt >= 2 AND dt < 6 UNION ALL SELECT f, b, dt + b - f, feat, p FROM zt CROSS JOIN mv WHERE dt >= 4),
pa AS (SELECT f, b, dt, feat, avg(p) AS p FROM pl GROUP BY ALL)
SELECT mv.f::INTEGER AS f, mv.b::INTEGER AS b, j.i::INTEGER AS dt, gb.feat::INTEGER AS feat, round(coalesce(pa.p, gb.p), 6) AS p
FROM gb CROSS JOIN mv CROSS JOIN range(12) j(i) LEFT JOIN pa ON pa.f = mv.f AND pa.b = mv.b AND pa.dt = j.i AND pa.feat = gb.feat""",
    "window_means": """WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - k.i * INTERVAL '30 minutes' AS start, event_type, value FROM events CROSS JOIN range(2) k(i))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM w GROUP BY ALL""",
    "detection_sessions": """WITH h AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL '12 hours' THEN 1 ELSE 0 END AS nw FROM events WHERE value >= 60),
i AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM h)
SELECT min(ts) AS start, user_id, count(*) AS n, max(value) AS best FROM i GROUP BY user_id, sid""",
}
