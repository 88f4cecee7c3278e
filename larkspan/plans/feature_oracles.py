"""DuckDB SQL for the queries of feature_queries.py."""

from larkspan.operators.models import tapers
from larkspan.plans.feature_queries import BLOCK, GRID, LEAST, LENGTH, MAG_BLOCK, MAG_Q, PARTS, REACH, SHAPE, SPREAD, Q
from larkspan.plans.oracles import FRAMES

C = f"""c AS (SELECT vec_id // {LENGTH} AS utt, vec_id % {LENGTH} AS frame, unnest(range(0, len(embedding))) AS f, unnest(embedding)::DOUBLE AS x FROM embeddings),
nn AS (SELECT utt, max(frame) + 1 AS n, max(f) + 1 AS h FROM c GROUP BY utt)"""
NORMAL = "g AS (SELECT i, exp(-(i - 3) * (i - 3) / 2.0::DOUBLE) / sum(exp(-(i - 3) * (i - 3) / 2.0::DOUBLE)) OVER () AS w FROM range(7) r(i))"
SQUARE = "k2 AS (SELECT a.i - 2 AS di, b.i - 2 AS dj, exp(-4 * ln(2) * ((a.i - 2) ** 2 + (b.i - 2) ** 2) / 9.0::DOUBLE) AS u FROM range(5) a(i) CROSS JOIN range(5) b(i)), k AS (SELECT di, dj, u / sum(u) OVER () AS w FROM k2)"
#: Orientations as steps in time and frequency, in the order of their numbers.
STEPS = "st AS (SELECT * FROM (VALUES (0, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, 1), (4, 1, 1), (5, 1, 1), (6, 1, -1), (7, 1, -1)) t(o, dt, df))"


def _edge_map() -> str:
    out = []
    for o, line, order, f in ((0, "f", "frame", "f"), (2, "frame", "f", "f"), (4, "f - frame", "frame", "f"), (6, "f + frame", "frame", "f - 1")):
        steps = f"SELECT utt, frame, {f} AS f, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b, lead(x, 2) OVER w - lead(x) OVER w AS z FROM c WINDOW w AS (PARTITION BY utt, {line} ORDER BY {order})"
        out.append(f"SELECT utt, frame, f, {o} AS o, b AS v FROM ({steps}) WHERE b >= a AND b >= z AND b > 0")
        out.append(f"SELECT utt, frame, f, {o + 1} AS o, -b AS v FROM ({steps}) WHERE b <= a AND b <= z AND b < 0")
    return "em AS (" + " UNION ALL ".join(out) + ")"


def _bits(em: str = "em", name: str = "bt") -> str:
    """Bits of an edge map's positive values by blocks, the last of which takes the last frames."""
    return f"""{name}g AS (SELECT {em}.*, n, h, frame // {BLOCK} AS g FROM {em} JOIN nn USING (utt) WHERE frame // {BLOCK} < n // {BLOCK}
UNION ALL SELECT {em}.*, n, h, -1 FROM {em} JOIN nn USING (utt) WHERE n % {BLOCK} <> 0 AND frame >= n - {BLOCK}),
{name}r AS (SELECT *, row_number() OVER (PARTITION BY utt, g, o ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY utt, g, o) AS k FROM {name}g),
{name}b AS (SELECT utt, g, o, max(v) AS bar FROM {name}r WHERE r = floor({Q}::DOUBLE * k) GROUP BY utt, g, o),
{STEPS},
{name} AS (SELECT DISTINCT b.utt, frame + s.i * dt AS frame, f + s.i * df AS f, b.o
FROM {name}g b JOIN {name}b USING (utt, g, o) JOIN st ON st.o = b.o CROSS JOIN range(-{SPREAD}, {SPREAD} + 1) s(i)
WHERE v >= bar AND f + s.i * df >= 0 AND f + s.i * df < h AND frame + s.i * dt >= CASE WHEN g >= 0 THEN g * {BLOCK} ELSE n - n % {BLOCK} END AND frame + s.i * dt < CASE WHEN g >= 0 THEN g * {BLOCK} + {BLOCK} ELSE n END)"""


QUARTER = MAG_BLOCK // 4


def _magnitudes(by_channel: bool, name: str) -> str:
    cells, whole = ("utt, k, f", str(3 * QUARTER)) if by_channel else ("utt, k", f"{3 * QUARTER} * max(h)")
    box = f"x.i AS dx, {'0' if by_channel else 'y.i'} AS dy FROM range(-1, 2) x(i)" + ("" if by_channel else " CROSS JOIN range(-1, 2) y(i)")
    on = " AND b.f = c.f" if by_channel else ""
    return f"""{name}w AS (SELECT utt, k.i AS k, f, x, h FROM c JOIN nn USING (utt) JOIN range(0, 1000) k(i) ON k.i * {2 * QUARTER} < n AND frame >= k.i * {2 * QUARTER} - {QUARTER} AND frame < k.i * {2 * QUARTER} + {3 * QUARTER}),
{name}l AS (SELECT {cells}, list_sort(list(x)) AS v, {whole} AS whole FROM {name}w GROUP BY {cells}),
{name}b AS (SELECT {cells}, v[1 + least(len(v) - 1, CASE WHEN k = 0 THEN floor({MAG_Q}::DOUBLE * whole + 0.5) ELSE floor({MAG_Q}::DOUBLE * len(v)) END)::BIGINT] AS bar FROM {name}l),
{name}o AS (SELECT c.utt, c.frame, c.f FROM c JOIN {name}b b ON b.utt = c.utt AND b.k = c.frame // {2 * QUARTER}{on} WHERE c.x >= bar),
{name} AS (SELECT DISTINCT utt, frame + dx AS frame, f + dy AS f FROM {name}o JOIN nn USING (utt) CROSS JOIN (SELECT {box}) WHERE frame + dx >= 0 AND frame + dx < n AND f + dy >= 0 AND f + dy < h)"""


EDGES = f"{C}, {_edge_map()}"
OUT = "SELECT utt, frame, f AS freq, o::INTEGER AS orient FROM"
BANK = f"""bk AS (SELECT p.i AS part, a.i AS dt, b.i AS df, o.i AS o, ((p.i * 7 + a.i * 5 + b.i * 3 + o.i * 11) % 13 + 1) / 16.0::DOUBLE AS p FROM range(1, {PARTS} + 1) p(i) CROSS JOIN range({SHAPE[0]}) a(i) CROSS JOIN range({SHAPE[1]}) b(i) CROSS JOIN range(8) o(i)),
kc AS (SELECT part, sum(ln(1 - p)) AS const FROM bk GROUP BY part)"""


def _coded(more: str = "", having: str = "") -> str:
    return f"""lk AS (SELECT utt, frame - bk.dt AS t, f - bk.df AS f, part, count(*) AS n, round(sum(ln(p / (1 - p))) + max(const), 9) AS lk{more} FROM bt JOIN bk USING (o) JOIN kc USING (part)
GROUP BY utt, frame - bk.dt, bt.f - bk.df, part HAVING count(*) >= {LEAST}{having}),
cd AS (SELECT utt, t, f, part FROM (SELECT *, row_number() OVER (PARTITION BY utt, t, f ORDER BY lk DESC, part) AS rn FROM lk WHERE t >= 0 AND f >= 0) WHERE rn = 1)"""


HAMMING = "SELECT 0 AS k, i, 0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 15) AS w FROM range(16) r(i)"


def power(tap: str) -> str:
    """pw: the power of windows of 16 events in steps of 4 in the lower half of a transform of 32; tap (k, i, w) weighs the samples."""
    return f"""{FRAMES}, y AS (SELECT utt, frame, value - 0.95::DOUBLE * coalesce(lag(value) OVER (PARTITION BY utt ORDER BY frame), 0) AS y, floor((count(*) OVER (PARTITION BY utt) - 16) / 4.0::DOUBLE + 0.5)::BIGINT AS w FROM f),
tp AS ({tap}), wn AS (SELECT utt, v.i AS frame, y.frame - v.i * 4 AS i, y FROM y JOIN range(0, 100000) v(i) ON v.i < w AND y.frame >= v.i * 4 AND y.frame < v.i * 4 + 16),
ft AS (SELECT utt, frame, b.i AS channel, tp.k, sum(y * tp.w * cos(2 * pi() * b.i * wn.i / 32)) AS re, sum(y * tp.w * sin(2 * pi() * b.i * wn.i / 32)) AS im FROM wn JOIN tp ON tp.i = wn.i CROSS JOIN range(16) b(i) GROUP BY ALL),
pw AS (SELECT utt, frame, channel, avg(re * re + im * im) AS p FROM ft GROUP BY utt, frame, channel)"""


def _spectra(tap: str) -> str:
    """The logarithms of the lowest six channels."""
    return f"""WITH {power(tap)}
SELECT utt, frame, channel::INTEGER AS channel, round(ln(CASE WHEN p > 0 THEN p ELSE (SELECT min(q.p) FROM pw q WHERE q.utt = pw.utt AND q.p > 0 AND q.channel < 6) END), 6) + 0.0::DOUBLE AS x FROM pw WHERE channel < 6"""


TAPERS = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {i}, {w!r}::DOUBLE)" for k, row in enumerate(tapers(16, 3.0, 5).tolist()) for i, w in enumerate(row)) + ") t(k, i, w)"

SQL = {
    "smoothed_channels": f"""WITH {C}, {NORMAL}, a AS (SELECT utt, frame, f - i AS f, sum(w * x) AS x FROM c CROSS JOIN g JOIN nn USING (utt) WHERE f - i >= 0 AND f - i <= h - 7 GROUP BY utt, frame, f - i)
SELECT utt, frame + i - 3 AS frame, (f // 2)::INTEGER AS channel, round(sum(w * x), 6) + 0.0::DOUBLE AS x FROM a CROSS JOIN g JOIN nn USING (utt) WHERE f % 2 = 0 AND frame + i - 3 >= 0 AND frame + i - 3 < n GROUP BY utt, frame + i - 3, f // 2""",
    "kernel_smooth": f"""WITH {C}, {SQUARE} SELECT utt, frame + di AS frame, (f + dj)::INTEGER AS channel, round(sum(w * x), 6) + 0.0::DOUBLE AS x FROM c CROSS JOIN k JOIN nn USING (utt)
WHERE frame + di >= 0 AND frame + di < n AND f + dj >= 0 AND f + dj < h GROUP BY utt, frame + di, f + dj""",
    "edge_map": f"""WITH {EDGES}, fr AS (SELECT DISTINCT utt, frame FROM c), s AS (SELECT utt, frame, o, sum(v) AS v, count(*) AS n FROM em GROUP BY utt, frame, o)
SELECT fr.utt, fr.frame, k.i::INTEGER AS orient, round(coalesce(s.v, 0), 6) AS total, coalesce(s.n, 0)::INTEGER AS n FROM fr CROSS JOIN range(8) k(i) LEFT JOIN s ON s.utt = fr.utt AND s.frame = fr.frame AND s.o = k.i""",
    "edge_features_edges": f"WITH {EDGES}, {_bits()} {OUT} bt",
    "edge_features_magnitude": f"WITH {C}, {_magnitudes(True, 'mg')} SELECT utt, frame, f AS freq, 8 AS orient FROM mg",
    "edge_features_both": f"WITH {EDGES}, {_bits()}, {_magnitudes(False, 'mg')} {OUT} bt UNION ALL SELECT utt, frame, f, 8 FROM mg",
    "edge_features_gated": f"WITH {EDGES}, {_magnitudes(False, 'mg')}, ge AS (SELECT em.* FROM em JOIN mg USING (utt, frame, f)), {_bits('ge')} {OUT} bt",
    "part_features": f"""WITH {EDGES}, {_bits()}, {BANK}, {_coded()},
nr AS (SELECT DISTINCT utt, t + x.i AS t, f + y.i AS f, part FROM cd JOIN nn USING (utt) CROSS JOIN range(-{REACH[0]}, {REACH[0] + 1}) x(i) CROSS JOIN range(-{REACH[1]}, {REACH[1] + 1}) y(i)
WHERE t < n - {SHAPE[0] - 1} AND f < h - {SHAPE[1] - 1} AND t + x.i BETWEEN 0 AND n - {SHAPE[0]} AND f + y.i BETWEEN 0 AND h - {SHAPE[1]})
SELECT DISTINCT utt, t // {GRID[0]} AS frame, f // {GRID[1]} AS freq, k.i::INTEGER AS part FROM nr JOIN range(1, {PARTS + 1}) k(i) ON k.i = part OR k.i = part + 1 WHERE t % {GRID[0]} = 0 AND f % {GRID[1]} = 0""",
    "masked_part_code": f"""WITH {EDGES}, {_bits(name='bu')}, {_magnitudes(True, 'mg')}, bt AS (SELECT bu.*, mg.utt IS NOT NULL AS masked FROM bu LEFT JOIN mg USING (utt, frame, f)), {BANK}, {_coded(having=' AND count(*) FILTER (WHERE masked) > 3')}
SELECT utt, t AS frame, f AS freq, part::INTEGER AS part FROM cd""",
    "log_spectra": _spectra(HAMMING),
    "log_spectra_tapered": _spectra(TAPERS),
}
