"""DuckDB SQL for the queries of model_queries.py, and for earlier ones that need a recursion."""

from larkspan.operators.models import mel_matrix
from larkspan.plans.feature_oracles import HAMMING, C, power
from larkspan.plans.model_queries import COARSE, FINE, LONGEST, SEED
from larkspan.plans.oracles import ALL, BEST, BGM, BITS, CLUSTERS, FRAMES, NB, OV, PAIRS, PEAKS, PK, RUNS, SC, TR

FIRST = ", ".join([FRAMES, NB, PK])


def _split(detections: str) -> str:
    """Clusters of det (utt, frame, gap, most) one cut at a time."""
    return f"""{detections},
dn AS (SELECT *, CASE WHEN frame - lag(frame) OVER w >= lag(gap) OVER w THEN 1 ELSE 0 END AS nw FROM det WINDOW w AS (PARTITION BY utt ORDER BY frame)),
dc AS (SELECT *, sum(nw) OVER (PARTITION BY utt ORDER BY frame) AS cid FROM dn),
rc AS (SELECT utt, list(frame ORDER BY frame) AS t, list(most ORDER BY frame) AS m FROM dc GROUP BY utt, cid
UNION ALL SELECT utt, CASE WHEN s.i = 0 THEN t[:k] ELSE t[k + 1:] END, CASE WHEN s.i = 0 THEN m[:k] ELSE m[k + 1:] END FROM (
SELECT utt, t, m, list_position(gaps, list_max(gaps)) AS k FROM (SELECT utt, t, m, list_transform(range(1, len(t)), lambda i: t[i + 1] - t[i]) AS gaps FROM rc WHERE len(t) > 1 AND t[-1] - t[1] > m[1])) CROSS JOIN range(2) s(i)),
cl AS (SELECT utt, t[1] AS c_start, t[-1] + 1 AS c_end, len(t) AS n FROM rc WHERE len(t) = 1 OR t[-1] - t[1] <= m[1])"""


C1 = _split("det AS (SELECT utt, frame, 4 AS gap, 5 AS most FROM pk)")
#: The hash of seed and place as a number from 0 to below 1.
NOISE = f"('0x' || substr(md5('{SEED}:' || ex || ':' || dt || ':' || feat), 1, 13))::BIGINT / (2 ** 52)::DOUBLE"
POOLED = """cb AS (SELECT vec_id, feat // 4 AS feat, max(x) AS x FROM b GROUP BY vec_id, feat // 4),
cf AS (SELECT label, feat // 4 AS feat, avg(w) AS w, avg(c0) AS c0 FROM fl GROUP BY label, feat // 4),
cs AS (SELECT vec_id, cf.label, round(sum(c0 + w * x), 6) AS coarse FROM cb JOIN cf USING (feat) GROUP BY vec_id, cf.label)"""
JUDGED = "jd AS (SELECT vec_id, pred, pred = truth AS positive FROM pr WHERE vec_id % 2 = 0)"
SECOND = f"""{JUDGED}, sm AS (SELECT pred, feat, greatest(0.01, least(0.99, avg(x) FILTER (WHERE positive))) AS p, greatest(0.01, least(0.99, avg(x) FILTER (WHERE NOT positive))) AS q,
count(*) FILTER (WHERE positive) AS n_pos, count(*) FILTER (WHERE NOT positive) AS n_neg FROM b JOIN jd USING (vec_id) GROUP BY pred, feat),
sf AS (SELECT pred, feat, ln(p / q * (1 - q) / (1 - p)) AS w, ln((1 - p) / (1 - q)) AS c0, n_pos, n_neg FROM sm WHERE n_pos > 0 AND n_neg > 0)"""
CLASSED = ", ".join([ALL, SC, BEST, PAIRS])


def _bars(bars: tuple[float, ...]) -> str:
    return "(VALUES " + ", ".join(f"({b}::DOUBLE)" for b in bars) + ")"


COMPONENTS = f"""{BITS}, hb AS (SELECT vec_id, label * 2 + vec_id % 2 AS part, feat, x FROM b), ct AS (SELECT part, feat, greatest(0.01, least(0.99, avg(x))) AS p FROM hb GROUP BY part, feat), {BGM},
fl AS (SELECT part, feat, ln((ct.p / bg.p) / ((1 - ct.p) / (1 - bg.p))) AS w, ln((1 - ct.p) / (1 - bg.p)) AS c0 FROM ct JOIN bg USING (feat)),
sc AS (SELECT b.vec_id, b.label AS truth, part // 2 AS label, part % 2 AS comp, round(sum(c0 + w * x), 6) AS score FROM b JOIN fl USING (feat) GROUP BY b.vec_id, b.label, part),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label, comp) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY (label = truth) DESC, score DESC, comp) AS o FROM sc),
cc AS (SELECT p.label::BIGINT AS pred, p.comp::BIGINT AS pred_comp, t.label::BIGINT AS truth, t.comp::BIGINT AS truth_comp, count(*) AS n FROM rk p JOIN rk t USING (vec_id) WHERE p.a = 1 AND t.o = 1 AND t.label = t.truth GROUP BY ALL)"""
MEL = "me AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, {i}, {w!r}::DOUBLE)" for b, row in enumerate(mel_matrix(8, 17, 32.0)[:, :-1].tolist()) for i, w in enumerate(row)) + ") t(b, i, w))"


def _slopes(rows: str, half: int, name: str) -> str:
    """The slopes of rows (utt, frame, channel, x), the ends repeated."""
    return f"""{name}e AS (SELECT utt, max(frame) AS last FROM {rows} GROUP BY utt),
{name} AS (SELECT a.utt, a.frame, a.channel, sum(k.i * b.x) / {sum(k * k for k in range(-half, half + 1))}.0::DOUBLE AS x FROM {rows} a JOIN {name}e USING (utt) CROSS JOIN range(-{half}, {half + 1}) k(i)
JOIN {rows} b ON b.utt = a.utt AND b.channel = a.channel AND b.frame = greatest(0, least(last, a.frame + k.i)) GROUP BY a.utt, a.frame, a.channel)"""


SQL = {
    "detection_rates": f"""WITH {CLUSTERS}, {TR} SELECT round((SELECT count(*) FROM d WHERE NOT EXISTS (SELECT 1 FROM t WHERE {OV}))::DOUBLE / 1000.0::DOUBLE / 0.005::DOUBLE, 6) AS fpr,
round((SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM d WHERE {OV}))::DOUBLE / (SELECT count(*) FROM t), 6) AS tpr""",
    "utterance_rates": f"""WITH {CLUSTERS}, {TR}, a AS (SELECT utt, 1 AS c, EXISTS (SELECT 1 FROM t WHERE {OV})::INTEGER AS h, 0 AS t, 0 AS g FROM d UNION ALL SELECT utt, 0, 0, 1, EXISTS (SELECT 1 FROM d WHERE {OV})::INTEGER FROM t)
SELECT utt, sum(c)::BIGINT AS clusters, sum(c - h)::BIGINT AS "false", sum(t)::BIGINT AS truths, sum(g)::BIGINT AS found FROM a GROUP BY utt""",
    "cluster_neighbourhoods": f"""WITH {CLUSTERS}, s AS (SELECT utt, frame AS t_start FROM f WHERE phn = 'purchase'),
p AS (SELECT d.utt, d.cid, c_start, c_end, t_start AS truth FROM d LEFT JOIN s ON s.utt = d.utt AND t_start - 2 <= c_end AND t_start + 1 >= c_start),
q AS (SELECT utt, cid, truth, k.i AS dt, floor((c_start + c_end) / 2.0::DOUBLE - 3.5 + 0.5)::BIGINT + k.i AS frame FROM p CROSS JOIN range(7) k(i))
SELECT q.utt, cid, coalesce(truth, -1) AS truth, dt, coalesce(value, 0) AS value FROM q LEFT JOIN f ON f.utt = q.utt AND f.frame = q.frame""",
    "component_confusion": f"WITH {COMPONENTS} SELECT * FROM cc",
    "component_errors": f"""WITH {COMPONENTS} SELECT 'made' AS side, pred AS label, pred_comp AS comp, sum(n)::BIGINT AS n FROM cc WHERE pred <> truth GROUP BY pred, pred_comp
UNION ALL SELECT 'lost', truth, truth_comp, sum(n)::BIGINT FROM cc WHERE pred <> truth GROUP BY truth, truth_comp""",
    "template_windows": f"""WITH {FRAMES}, {RUNS}, m AS (SELECT phn, max(end_frame - start_frame) AS n FROM sg GROUP BY phn)
SELECT phn, -ceil(n / 3.0)::BIGINT AS w0, ceil(n / 3.0)::BIGINT AS w1, n::BIGINT AS c0, ceil(n * 1.5)::BIGINT AS c1 FROM m""",
    "frame_deltas": f"WITH {C}, r AS (SELECT utt, frame, f::INTEGER AS channel, x FROM c), {_slopes('r', 4, 's')} SELECT utt, frame, channel, round(x, 6) + 0.0::DOUBLE AS x FROM s",
    "mfcc_deltas": f"""WITH {power(HAMMING)}, {MEL}, en AS (SELECT utt, frame, sum(p) AS e FROM pw GROUP BY utt, frame),
ml AS (SELECT utt, frame, b, ln(sum(p * me.w)) AS x FROM pw JOIN me ON me.i = pw.channel GROUP BY utt, frame, b),
r AS (SELECT utt, frame, k.i::INTEGER AS channel, sum(x * sqrt(2.0 / 8) * cos(pi() * k.i * (2 * b + 1) / 16)) * pow(k.i, 0.6) AS x FROM ml CROSS JOIN range(1, 5) k(i) GROUP BY utt, frame, k.i UNION ALL SELECT utt, frame, 0, e FROM en),
{_slopes('r', 2, 's')}, {_slopes('s', 2, 'z')} SELECT utt, frame, channel, round(x, 6) + 0.0::DOUBLE AS x, 0 AS kind FROM r UNION ALL SELECT utt, frame, channel, round(x, 6) + 0.0::DOUBLE, 1 FROM s UNION ALL SELECT utt, frame, channel, round(x, 6) + 0.0::DOUBLE, 2 FROM z""",
    "clusters_c1": f"WITH RECURSIVE {FIRST}, {C1} SELECT utt, row_number() OVER (PARTITION BY utt ORDER BY c_start) - 1 AS cid, c_start, c_end FROM cl",
    "clusters_split": f"WITH RECURSIVE {FIRST}, {C1} SELECT * FROM cl",
    "clusters_template_lengths": f"WITH RECURSIVE {FIRST}, {_split('det AS (SELECT utt, frame, (floor(value) % 4 + 3)::INTEGER AS gap, (floor(value) % 4 + 3) * 1.5 AS most FROM pk)')} SELECT * FROM cl",
    "nms": f"""WITH RECURSIVE {PEAKS}, rk AS (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY value DESC, frame) AS k FROM pk),
gr AS (SELECT DISTINCT utt, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS new FROM pk
UNION ALL SELECT gr.utt, rk.k, CASE WHEN ok THEN list_append(taken, rk.frame) ELSE taken END, CASE WHEN ok THEN rk.frame END
FROM gr JOIN rk ON rk.utt = gr.utt AND rk.k = gr.k + 1, LATERAL (SELECT len(list_filter(gr.taken, lambda x: abs(x - rk.frame) < 5)) = 0 AS ok))
SELECT pk.utt, pk.frame, pk.value FROM gr JOIN pk ON pk.utt = gr.utt AND pk.frame = gr.new""",
    "cascade_roc": f"""WITH {ALL}, {SC}, {POOLED}, rw AS (SELECT coarse, score, sc.label = e.label AS positive FROM cs JOIN sc USING (vec_id, label) JOIN embeddings e USING (vec_id)),
al AS (SELECT count(*) FILTER (WHERE positive) + 7 AS n FROM rw)
SELECT c.b AS coarse, t.b AS threshold, round(count(*) FILTER (WHERE rw.positive AND rw.coarse >= c.b AND score >= t.b)::DOUBLE / (SELECT n FROM al), 6) AS tpr,
round(count(*) FILTER (WHERE NOT rw.positive AND rw.coarse >= c.b AND score >= t.b) / 100.0::DOUBLE, 6) AS fps FROM {_bars(COARSE)} c(b) CROSS JOIN {_bars(FINE)} t(b) CROSS JOIN rw GROUP BY c.b, t.b""",
    "window_energy": f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY utt) AS n FROM f)
SELECT utt, k.i AS win, round(sum(value * value), 6) AS energy FROM n JOIN range(0, 100000) k(i) ON k.i * 5 + 12 <= n AND frame >= k.i * 5 AND frame < k.i * 5 + 12 GROUP BY utt, k.i""",
    "vector_patches": """WITH p AS (SELECT vec_id, k.i AS start, list_transform(embedding[k.i + 1:k.i + 16], lambda x: x::DOUBLE) AS s FROM embeddings JOIN range(0, 1000, 12) k(i) ON k.i + 16 <= len(embedding))
SELECT vec_id, start::INTEGER AS start, round(list_max(s), 6) AS largest, round(list_sum(s), 6) AS total FROM p""",
    "padded_examples": f"""WITH {FRAMES}, {RUNS}, fb AS (SELECT utt, frame, floor(value / 100)::INTEGER AS feat FROM f UNION ALL SELECT utt, frame, 5 FROM f WHERE phn = 'purchase'),
ex AS (SELECT utt * 1000 + seg_idx AS ex, * FROM sg), ms AS (SELECT ex, d.i AS dt, k.i::INTEGER AS feat FROM ex JOIN range({LONGEST}) d(i) ON d.i >= end_frame - start_frame CROSS JOIN range(6) k(i))
SELECT ex, frame - start_frame AS dt, feat FROM ex JOIN fb ON fb.utt = ex.utt AND frame >= start_frame AND frame < end_frame
UNION ALL SELECT ex, dt, feat FROM ms WHERE {NOISE} <= (feat + 1) / 16.0::DOUBLE""",
    "false_positive_filters": f"WITH {CLASSED}, {SECOND} SELECT pred, feat, round(w, 6) AS w, round(c0, 6) AS c0, n_pos, n_neg FROM sf",
    "false_positive_scores": f"WITH {CLASSED}, {SECOND} SELECT pr.vec_id, pr.pred, pr.truth, round(sum(c0 + w * x), 6) AS score FROM pr JOIN b USING (vec_id) JOIN sf ON sf.pred = pr.pred AND sf.feat = b.feat WHERE pr.vec_id % 2 = 1 GROUP BY pr.vec_id, pr.pred, pr.truth",
    "uniform_negatives": f"WITH {ALL} SELECT label, (feat % 8)::INTEGER AS freq, round(greatest(0.0001, least(0.9999, avg(1 / (1 + (1 / p - 1) * exp(w))))), 6) AS q FROM fl GROUP BY label, feat % 8",
}
