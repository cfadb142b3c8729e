"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import math

from meshgrain.functions.draws import IV, half_steps

_RAW = """raw AS (SELECT * FROM (SELECT user_id AS pre, lead(user_id) OVER (ORDER BY ts, event_id) AS post,
  CASE WHEN value > 150 THEN 255 WHEN event_type = 'error' THEN 0 WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 2 WHEN event_type = 'signup' THEN 3 ELSE 4 END AS nt,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE value / 600 END AS conf, event_id FROM events) WHERE post IS NOT NULL)"""
_CLEAN = _RAW + ", clean AS (SELECT * FROM raw WHERE pre <> 0 AND post <> 0 AND pre <> post AND (conf IS NULL OR conf >= 0.05::DOUBLE))"
_GRAPH = _RAW + ", g AS (SELECT DISTINCT pre AS src, post AS tgt FROM raw WHERE pre <> post), u AS (SELECT DISTINCT user_id AS id FROM events)"
_N = ", n AS (SELECT max(id) + 1 AS n FROM u)"
_DEG = ", d AS (SELECT id, (SELECT count(*) FROM g WHERE src = id) AS out_deg, (SELECT count(*) FROM g WHERE tgt = id) AS in_deg FROM u)"
_SPIKES = "s AS (SELECT user_id AS nid, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::INT AS tick, event_type AS kind, event_id FROM events), u AS (SELECT DISTINCT user_id AS id FROM events)"
_HOURS = 720

_CODES = "[0,1,1,3,1,5,6,7,1,6,10,11,3,7,11,15,1,6,5,7,10,21,21,23,6,25,21,27,11,27,30,31,1,10,6,11,6,21,25,27,5,21,21,30,7,23,27,31,3,11,7,15,11,30,27,31,7,27,23,31,15,31,31,63]"
_PROPS = "(VALUES (0,0,0,false),(1,1,0,false),(3,2,1,false),(5,2,0,false),(6,2,0,false),(7,3,1,false),(10,2,0,false),(11,3,1,false),(15,4,2,false),(21,3,0,false),(23,4,1,false),(25,3,0,true),(27,4,1,true),(30,4,1,false),(31,5,2,true),(63,6,3,true)) AS p(code, n_edges, n_mutual, cyclic)"


def _census(edges: str, nodes: str) -> str:
    """CTEs ending in `census` (code, count, concentration, n_edges, n_mutual, cyclic): connected triads by their centre, the rest by counting."""
    return f"""
un AS ({nodes}), ed AS (SELECT DISTINCT src, tgt FROM ({edges}) WHERE src <> tgt AND src IN (SELECT id FROM un) AND tgt IN (SELECT id FROM un)),
dy AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, sum(CASE WHEN src < tgt THEN 1 ELSE 2 END)::INT AS t FROM ed GROUP BY 1, 2),
sp AS (SELECT a AS u, b AS v FROM dy UNION ALL SELECT b, a FROM dy),
tr AS (SELECT DISTINCT list_sort([x.u, x.v, y.v]) AS s FROM sp x JOIN sp y ON x.u = y.u AND x.v < y.v),
co AS (SELECT ({_CODES})[1 + coalesce(p.t, 0) + 4 * coalesce(q.t, 0) + 16 * coalesce(r.t, 0)] AS code, count(*) AS count FROM tr
  LEFT JOIN dy p ON p.a = s[1] AND p.b = s[2] LEFT JOIN dy q ON q.a = s[1] AND q.b = s[3] LEFT JOIN dy r ON r.a = s[2] AND r.b = s[3] GROUP BY 1),
nb AS (SELECT u, list(v) AS vs, count(*) AS deg FROM sp GROUP BY u),
sg AS (SELECT t = 3 AS mutual, sum((SELECT count(*) FROM un) - len(list_distinct(list_concat(p.vs, q.vs)))) AS count FROM dy JOIN nb p ON p.u = a JOIN nb q ON q.u = b GROUP BY 1),
al AS (SELECT code, count::BIGINT AS count FROM co UNION ALL SELECT 1, coalesce((SELECT count FROM sg WHERE NOT mutual), 0)::BIGINT UNION ALL SELECT 3, coalesce((SELECT count FROM sg WHERE mutual), 0)::BIGINT),
tt AS (SELECT (count(*)::HUGEINT * (count(*) - 1) * (count(*) - 2) // 6)::BIGINT AS total FROM un),
az AS (SELECT * FROM al UNION ALL SELECT 0, (SELECT total FROM tt) - (SELECT sum(count) FROM al)::BIGINT),
census AS (SELECT az.code::INT AS code, count::BIGINT AS count, CASE WHEN total > 0 THEN count::DOUBLE / total ELSE 0 END AS concentration, n_edges, n_mutual, cyclic FROM az JOIN {_PROPS} ON p.code = az.code, tt)"""


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT"


def _u(*parts: str) -> str:
    return f"({_draw(*parts)} / 4503599627370496.0::DOUBLE)"


def _below(n: str, *parts: str) -> str:
    return f"({_draw(*parts)} % ({n}))"


def _partners(nodes: str, among: str, p: float | str, *key: str) -> str:
    """(all columns of nodes, pick): numbers in [0, among) by skips of geometric length, in stretches of 16 / p numbers."""
    width, slope = (f"greatest(1, ceil(16 / ({p})))", f"ln(1 - ({p}))") if isinstance(p, str) else (str(max(1, math.ceil(16 / p))), f"{math.log1p(-p)!r}::DOUBLE" if p < 1 else "")
    skip = f"floor(ln(1 - {_u(*key, 'id', 'stretch', 'k_')}) / {slope})::BIGINT" if slope else "0"
    return f"""(WITH RECURSIVE c_ AS (SELECT *, ({among})::BIGINT AS among_, ({width})::BIGINT AS width_ FROM {nodes}),
  t_ AS (SELECT *, unnest(range(0, (among_ + width_ - 1) // width_)) AS stretch, 0 AS k_ FROM c_ WHERE among_ > 0),
  s_ AS (SELECT *, {skip} AS hit_ FROM t_ UNION ALL SELECT * REPLACE (hit_ + 1 + {skip.replace('k_', '(k_ + 1)')} AS hit_, k_ + 1 AS k_) FROM s_ WHERE hit_ < least(width_, among_ - stretch * width_))
  SELECT * EXCLUDE (among_, width_, stretch, k_, hit_), stretch * width_ + hit_ AS pick FROM s_ WHERE hit_ < least(width_, among_ - stretch * width_))"""


_SIZE = "(n // 4 + CASE WHEN m < n % 4 THEN 1 ELSE 0 END)"
_W = "((1 + (src + tgt) % 4) / 4.0::DOUBLE)"
_MEAN = f"(SELECT avg({_W}) FROM g)"
_MODULAR = f"""(SELECT (m * (n // 4) + least(m, n % 4)) * 2 + c * {_SIZE} + src // 4 AS src, (m * (n // 4) + least(m, n % 4)) * 2 + c * {_SIZE} + tgt // 4 AS tgt, w
  FROM (SELECT {_W} AS w, src, tgt, src % 4 AS m, unnest([0, 1]) AS c FROM g WHERE src % 4 = tgt % 4), n)"""


def _duplicated(edges: str, n: str, drop: float, rewire: float, seed: int) -> str:
    return f"""SELECT src, CASE WHEN r < {drop}::DOUBLE + {rewire}::DOUBLE THEN {_below(f"2 * ({n})", "'rewire'", str(seed), "src", "tgt")} ELSE tgt END AS tgt, w AS weight
  FROM (SELECT src, tgt, n, w, {_u("'duplicate'", str(seed), "src", "tgt")} AS r FROM (SELECT n, w, src + c * ({n}) AS src, tgt + c * ({n}) AS tgt FROM {edges}, (VALUES (0), (1)) AS v(c))) WHERE r >= {drop}::DOUBLE"""


def _shuffled(value: str, key: str) -> str:
    return f"""SELECT src, value FROM (SELECT src, row_number() OVER (ORDER BY src, tgt) AS p FROM g)
  JOIN (SELECT value, row_number() OVER (ORDER BY o, src, tgt) AS p FROM (SELECT src, tgt, {value} AS value, {_draw(f"'{key}'", "4", "src", "tgt")} AS o FROM g)) USING (p)"""


_DRAWN = f"""(0.2::DOUBLE + {_u("'edge weight'", "1", "src", "tgt")} * (0.8::DOUBLE - 0.2::DOUBLE))"""

_ASCII = [("—", "--"), ("–", "-"), ("→", "->"), ("µ", "u"), ("·", "-"), ("≈", "~"), ("✓", "OK"), ("✗", "X"), ("█", "#"), ("▄", "#"), ("▀", "#"), ("░", "."), ("▒", "+"), ("▓", "*")]


def _nested(text: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', '{b}')"
    return text


_FID = """WITH {spikes}, ref AS (SELECT nid, tick FROM s WHERE tick BETWEEN 0 AND 719), cand AS ({cand}),
c AS (SELECT id, (SELECT count(*) FROM ref WHERE nid = id) AS r, (SELECT count(*) FROM cand WHERE nid = id) AS c FROM u),
a AS (SELECT count(*) AS n, sum(r) AS sr, sum(c) AS sc, sum(r * r) AS srr, sum(c * c) AS scc, sum(r * c) AS src, max(abs(r - c)) AS m FROM c),
x AS (SELECT nid, tick // 10 AS b, count(*) AS x FROM ref GROUP BY ALL), y AS (SELECT nid, tick // 10 AS b, count(*) AS y FROM cand GROUP BY ALL),
z AS (SELECT coalesce(sum(x * x), 0) AS xx, coalesce(sum(y * y), 0) AS yy, coalesce(sum(x * y), 0) AS xy FROM x FULL JOIN y USING (nid, b)),
f AS (SELECT CASE WHEN sr > 0 THEN sc::DOUBLE / sr WHEN sc = 0 THEN 1 ELSE 'infinity'::DOUBLE END AS rate_ratio,
  round(CASE WHEN n * srr = sr * sr AND n * scc = sc * sc THEN 1 WHEN n * srr = sr * sr OR n * scc = sc * sc THEN 0 ELSE (n * src - sr * sc)::DOUBLE / (sqrt((n * srr - sr * sr)::DOUBLE) * sqrt((n * scc - sc * sc)::DOUBLE)) END, 12) AS count_r,
  round(CASE WHEN xx = 0 AND yy = 0 THEN 1 WHEN xx = 0 OR yy = 0 THEN 0 ELSE xy::DOUBLE / (sqrt(xx::DOUBLE) * sqrt(yy::DOUBLE)) END, 12) AS binned_cosine, m AS max_count_diff FROM a, z)
SELECT *, rate_ratio BETWEEN 0.95 AND 1.05 AS rate_ok, count_r >= 0.99 AS count_r_ok, binned_cosine >= 0.99 AS cosine_ok, max_count_diff <= 0 AS diff_ok,
  rate_ratio BETWEEN 0.95 AND 1.05 AND count_r >= 0.99 AND binned_cosine >= 0.99 AND max_count_diff <= 0 AS all_ok FROM f"""

_FRONTIER = f"""WITH {_SPIKES},
a AS (SELECT *, tick - lag(tick) OVER w AS gap, lead(tick) OVER w AS next FROM s WINDOW w AS (PARTITION BY nid ORDER BY tick, event_id)),
b AS (SELECT *, last_value(CASE WHEN gap IS NULL THEN 0 WHEN gap >= 62 THEN 0 WHEN gap <= 15 THEN 1 END IGNORE NULLS) OVER (PARTITION BY nid ORDER BY tick, event_id ROWS UNBOUNDED PRECEDING) AS active,
  coalesce(next, {_HOURS}) - tick - 1 AS idle FROM a),
c AS (SELECT *, lag(active) OVER (PARTITION BY nid ORDER BY tick, event_id) AS was FROM b),
f AS (SELECT nid, count(*) FILTER (active = 1 AND was = 0 AND gap <= 15) AS activations, count(*) FILTER (was = 1 AND gap > 15 AND gap <= 61) AS reactivations,
  count(*) FILTER (active = 0 AND idle >= 15) AS abandoned, count(*) FILTER (active = 1 AND idle >= 15) AS quieted, count(*) FILTER (active = 1 AND idle >= 61) AS evictions,
  max(CASE WHEN next IS NULL THEN CASE WHEN active = 0 THEN CASE WHEN idle >= 15 THEN 'dormant' ELSE 'candidate' END WHEN idle >= 61 THEN 'evicted' WHEN idle >= 60 THEN 'evicting' WHEN idle >= 15 THEN 'quiescent' ELSE 'active' END END) AS state FROM c GROUP BY nid)"""

def _hashed(rows: str, words: list[str]) -> str:
    """(all columns of rows, h): the 64-bit BLAKE2b of five 64-bit words (UBIGINT expressions). Its 16 words are columns; a subquery for each half step of four mixings side by side."""
    wrap = "& 18446744073709551615::UHUGEINT)::UBIGINT"
    turned = lambda x, by: f"(({x} >> {by}) | (({x}::UHUGEINT << {64 - by}) {wrap})"
    start = [IV[0] ^ 0x01010008, *IV[1:], *IV[:4], IV[4] ^ 40, IV[5], IV[6] ^ ((1 << 64) - 1), IV[7]]
    made = f"(SELECT *, {', '.join(f'({w})::UBIGINT AS m{i}_' for i, w in enumerate(words))}, {', '.join(f'{x}::UBIGINT AS v{i}_' for i, x in enumerate(start))} FROM {rows})"
    steps = half_steps()
    order = [steps[8 * k + 2 * g + half] for k in range(len(steps) // 8) for half in (0, 1) for g in range(4)]  # both halves of four mixings
    for at in range(0, len(order), 4):
        new = []
        for p, q, r, t, w, x, y in order[at : at + 4]:
            a = f"((v{p}_::UHUGEINT + v{q}_{f' + m{w}_' if w < len(words) else ''}) {wrap}"
            d = turned(f"xor(v{t}_, {a})", x)
            c = f"((v{r}_::UHUGEINT + {d}) {wrap}"
            new += [f"{a} AS v{p}_", f"{d} AS v{t}_", f"{c} AS v{r}_", f"{turned(f'xor(v{q}_, {c})', y)} AS v{q}_"]
        made = f"(SELECT * REPLACE ({', '.join(new)}) FROM {made})"
    return f"(SELECT *, xor(xor({start[0]}::UBIGINT, v0_), v8_) AS h FROM {made})"


# every tick of every node in turn: states 0 dormant, 1 candidate, 2 active, 3 quiescent, 4 evicting, 5 evicted; t has what changed
_SEEN = "CASE WHEN x.n = 0 THEN a.st WHEN a.st IN (0, 5) THEN CASE WHEN x.n > 1 THEN 2 ELSE 1 END ELSE 2 END"
_FIRST, _LAST = "CASE WHEN x.n > 0 AND a.st IN (0, 5) THEN x.t ELSE a.f END", "CASE WHEN x.n > 0 THEN x.t ELSE a.l END"
_SWEPT = f"CASE WHEN ({_SEEN}) = 1 AND x.t - ({_FIRST}) >= 15 THEN 0 WHEN ({_SEEN}) = 2 AND x.t - ({_LAST}) >= 15 THEN 3 WHEN ({_SEEN}) = 3 AND x.t - ({_LAST}) >= 60 THEN 4 WHEN ({_SEEN}) = 4 THEN 5 ELSE ({_SEEN}) END"
_STEP = "[struct_pack(t := x.t, k := {k}, a := {a}, b := {b}, c := '{c}')]"
_NONE = "[]::STRUCT(t BIGINT, k INT, a INT, b INT, c VARCHAR)[]"
_LIVES = f"""WITH {_SPIKES}, c AS (SELECT nid, tick, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT id, t, coalesce(n, 0) AS n FROM (SELECT id, unnest(range(0, {_HOURS})) AS t FROM u) LEFT JOIN c ON nid = id AND tick = t),
l AS (SELECT id, list(struct_pack(st := 0, f := 0::BIGINT, l := 0::BIGINT, t := t::BIGINT, n := n, held := 0::BIGINT, asked := 0::BIGINT, tr := {_NONE}) ORDER BY t) AS l FROM g GROUP BY id),
r AS (SELECT id, list_reduce(list_concat([struct_pack(st := 0, f := 0::BIGINT, l := 0::BIGINT, t := (-1)::BIGINT, n := 0::BIGINT, held := 0::BIGINT, asked := 0::BIGINT, tr := {_NONE})], l), lambda a, x: struct_pack(
  st := ({_SWEPT}), f := ({_FIRST}), l := ({_LAST}), t := x.t, n := x.n, held := a.held + CASE WHEN ({_SEEN}) IN (2, 3, 4) THEN 1 ELSE 0 END, asked := a.asked + CASE WHEN ({_SEEN}) = 3 AND ({_SWEPT}) = 4 THEN 1 ELSE 0 END,
  tr := list_concat(a.tr, CASE WHEN x.n > 0 AND a.st IN (0, 5) THEN {_STEP.format(k=0, a="a.st", b=1, c="observed")} ELSE {_NONE} END,
    CASE WHEN x.n > 1 AND a.st IN (0, 5) THEN {_STEP.format(k=1, a=1, b=2, c="observed")} WHEN x.n > 0 AND a.st IN (1, 3, 4) THEN {_STEP.format(k=0, a="a.st", b=2, c="observed")} ELSE {_NONE} END,
    CASE WHEN ({_SEEN}) <> ({_SWEPT}) THEN {_STEP.format(k=0, a=f"({_SEEN})", b=f"({_SWEPT})", c="swept")} ELSE {_NONE} END))) AS r FROM l)"""
_STATES = "(['dormant', 'candidate', 'active', 'quiescent', 'evicting', 'evicted'])"

_DECAY = "0.9950124791926823::DOUBLE"

ORACLES: dict[str, str] = {
    "triad_census": f"WITH {_GRAPH}, {_census('SELECT * FROM g', 'SELECT id FROM u')} SELECT * FROM census",
    "census_sources_only": f"WITH {_GRAPH}, h AS (SELECT DISTINCT pre AS src, post AS tgt FROM raw WHERE nt = 255 AND pre <> 0 AND post <> 0 AND pre <> post AND (conf IS NULL OR conf >= 0.05::DOUBLE)), {_census('SELECT * FROM h', 'SELECT DISTINCT src AS id FROM h')} SELECT * FROM census",
    "motif_query_top": f"WITH {_GRAPH}, {_census('SELECT * FROM g', 'SELECT id FROM u')} SELECT code, count, n_edges, n_mutual, cyclic FROM census WHERE n_edges >= 3 AND n_mutual >= 1 ORDER BY count DESC, code LIMIT 5",
    "census_part_supplier": f"WITH h AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000000 AS tgt FROM lineitem), {_census('SELECT * FROM h', 'SELECT src AS id FROM h UNION SELECT tgt FROM h')} SELECT code, count FROM census",
    "edge_scan_filter": f"WITH {_CLEAN} SELECT pre, post, nt, event_id FROM clean",
    "edge_dedupe_weighted": f"WITH {_CLEAN} SELECT DISTINCT pre, post, nt, CASE WHEN nt = 0 THEN -0.5 ELSE 0.5 END::DOUBLE AS weight FROM clean WHERE nt <> 255",
    "edge_normalize_counts": """WITH r AS (SELECT CASE WHEN k % 97 = 0 THEN '-1' WHEN k % 89 = 0 THEN 'x' ELSE l_partkey::VARCHAR END AS a, l_suppkey AS b, CASE WHEN k % 83 = 0 THEN 0 ELSE l_quantity::INT END AS c,
  CASE WHEN k % 79 = 0 THEN 'XYZ' WHEN l_returnflag = 'A' THEN 'ACH' WHEN l_returnflag = 'N' THEN 'GABA' ELSE 'UNKNOWN' END AS nt FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem)),
p AS (SELECT *, CASE WHEN a = 'x' THEN 'not a number' WHEN a::VARCHAR = '-1' THEN 'negative id' WHEN c <= 0 THEN 'no synapses' WHEN nt = 'XYZ' THEN 'unknown transmitter' ELSE '' END AS problem FROM r)
SELECT nt AS neurotransmitter, problem, count(*) AS n, sum(CASE WHEN problem = '' THEN c END)::BIGINT AS synapses FROM p GROUP BY ALL""",
    "nt_distribution": f"WITH {_RAW} SELECT CASE WHEN nt < 6 THEN (['GABA', 'ACH', 'GLUT', 'OCT', 'SER', 'DA'])[nt + 1] ELSE 'UNKNOWN' END AS nt, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM raw) AS share FROM raw GROUP BY 1",
    "nt_argmax": """WITH p AS (SELECT event_id, [CASE WHEN event_id * (k + 3) % 19 = 0 THEN 0 ELSE (event_id * (k + 3) % 17) / 16.0::DOUBLE END FOR k IN [0, 1, 2, 3, 4, 5]] AS p FROM events)
SELECT event_id, CASE WHEN event_id % 29 <> 0 THEN list_position(p, list_max(p)) - 1 ELSE 255 END AS nt, list_max(p)::DOUBLE AS conf FROM p""",
    "confidence_stats": f"WITH {_RAW} SELECT count(*) AS n, count(conf) AS known, min(pre) AS lo, max(pre) AS hi, round(avg(conf), 9) AS mean_conf, round(min(conf), 12) AS least_conf FROM raw",
    "compact_ids": f"WITH {_CLEAN} SELECT id, row_number() OVER (ORDER BY id) - 1 AS compact FROM (SELECT pre AS id FROM clean UNION SELECT post FROM clean)",
    "compact_part_ids": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS compact FROM (SELECT DISTINCT l_partkey * 1000003 + l_suppkey AS id FROM lineitem)",
    "connectome_stats": f"WITH {_CLEAN} SELECT count(*) AS n_rows, count(DISTINCT pre) AS sources, count(DISTINCT (pre, post)) AS edges, (SELECT count(*) FROM (SELECT pre FROM clean UNION SELECT post FROM clean)) AS nodes, count(*) - count(DISTINCT (pre, post)) AS collapsed FROM clean",
    "degree_stats": f"WITH {_GRAPH}{_DEG} SELECT count(*) AS n, sum(out_deg)::DOUBLE / count(*) AS mean_deg, max(out_deg) AS max_deg, sum(out_deg * out_deg)::BIGINT AS sum_sq, list_sort(list(out_deg))[count(*) // 2 + 1] AS median_deg FROM d",
    "degrees": f"WITH {_GRAPH}{_DEG} SELECT * FROM d",
    "structure_report": f"""WITH {_GRAPH}{_DEG}, m AS (SELECT count(*) AS r FROM g a JOIN g b ON a.src = b.tgt AND a.tgt = b.src), e AS (SELECT count(*) AS e FROM g)
SELECT count(*) AS neurons, any_value(e) AS edges, max(out_deg) AS max_out_degree, count(*) FILTER (out_deg = 0 AND in_deg = 0) AS isolated, any_value(r) AS reciprocal_edges,
  any_value(e)::DOUBLE / (count(*) * (count(*) - 1)) AS density, any_value(e)::DOUBLE / count(*) AS mean_out_degree, any_value(r)::DOUBLE / any_value(e) AS reciprocity FROM d, m, e""",
    "locality_ratio": f"""WITH {_GRAPH}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY tgt) AS k FROM g) WHERE k <= 3),
p AS (SELECT src, count(*) AS n, sum(abs(tgt - src)) AS r FROM f GROUP BY src), q AS (SELECT *, coalesce(sum(n) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)
SELECT sum(n)::BIGINT AS n, sum(r)::DOUBLE / sum(n)::DOUBLE / (SELECT greatest(greatest(max(src), max(tgt)) - least(min(src), min(tgt)), 1) FROM g) AS locality FROM q WHERE b < 2000""",
    "node_subset": f"WITH {_GRAPH}{_DEG}, k AS (SELECT id FROM d ORDER BY out_deg DESC, id LIMIT 40) SELECT src, tgt FROM g WHERE src IN (SELECT id FROM k) AND tgt IN (SELECT id FROM k)",
    "assign_roles": """WITH g AS (SELECT l_orderkey AS src, l_partkey + 1000000000000 AS tgt FROM lineitem UNION SELECT l_partkey + 1000000000000, l_suppkey + 2000000000000 FROM lineitem),
d AS (SELECT id, sum(o)::BIGINT AS out_deg, sum(i)::BIGINT AS in_deg FROM (SELECT src AS id, 1 AS o, 0 AS i FROM g UNION ALL SELECT tgt, 0, 1 FROM g) GROUP BY id),
h AS (SELECT list_sort(list(out_deg + in_deg))[1 + least(count(*) - 1, count(*) * 90 // 100)] AS hub FROM d)
SELECT id, CASE WHEN in_deg = 0 AND out_deg > 0 THEN 'sensory' WHEN out_deg = 0 AND in_deg > 0 THEN 'goal' WHEN hub > 0 AND out_deg + in_deg >= hub THEN 'association' ELSE 'unassigned' END AS role FROM d, h""",
    "control_hub_removed": f"WITH {_GRAPH}{_DEG}, r AS (SELECT id, row_number() OVER (ORDER BY out_deg DESC, id) AS k, count(*) OVER () AS n FROM d), k AS (SELECT id FROM r WHERE k <= greatest(1, n // 100)) SELECT src, tgt FROM g WHERE src NOT IN (SELECT id FROM k) AND tgt NOT IN (SELECT id FROM k)",
    "control_short_span": f"WITH {_GRAPH}, m AS (SELECT list_sort(list(abs(tgt - src)))[count(*) // 2 + 1] AS m FROM g) SELECT src, tgt FROM g, m WHERE abs(tgt - src) <= m",
    "id_gap_stats": """WITH i AS (SELECT DISTINCT l_orderkey * 7 + l_partkey AS id FROM lineitem), p AS (SELECT id - lag(id) OVER (ORDER BY id) AS gap FROM i)
SELECT (SELECT count(*) FROM i) AS n, list_sort(list(gap))[count(*) // 2 + 1] AS median_gap, (SELECT (max(id) - min(id))::DOUBLE / (count(*) - 1) FROM i) AS mean_gap, (SELECT count(*)::DOUBLE / (max(id) - min(id) + 1) FROM i) AS density FROM p WHERE gap IS NOT NULL""",
    "resume_anti_join": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "gen_replication": f"WITH {_GRAPH}{_N} SELECT src + c * n AS src, tgt + c * n AS tgt, {_W} AS weight FROM g, n, (VALUES (0), (1), (2)) AS v(c)",
    "gen_replication_cross": f"""WITH {_GRAPH}{_N}, r AS (SELECT unnest(range(0, 3 * n)) AS id, n FROM n), x AS (SELECT id AS src, (id // n + 1) * n + pick AS tgt FROM {_partners("r", "n * 3 - (id // n + 1) * n", 0.01, "'replicate'", "7")})
SELECT src + c * n AS src, tgt + c * n AS tgt, {_W} AS weight FROM g, n, (VALUES (0), (1), (2)) AS v(c) UNION ALL SELECT src, tgt, {_MEAN} FROM (SELECT src, tgt FROM x UNION ALL SELECT tgt, src FROM x)""",
    "gen_duplication": f"WITH {_GRAPH}{_N} " + _duplicated(f"(SELECT *, {_W} AS w FROM g), n", "n", 0.1, 0.05, 3),
    "gen_modular": f"WITH {_GRAPH}{_N} SELECT src, tgt, w AS weight FROM {_MODULAR}",
    "gen_modular_inter": f"""WITH {_GRAPH}{_N}, r AS (SELECT unnest(range(0, 2 * n)) AS id, n FROM n)
SELECT src, tgt, w AS weight FROM {_MODULAR} UNION ALL SELECT id, id + 1 + pick, {_MEAN} FROM {_partners("r", "n * 2 - 1 - id", 0.02, "'modules'", "5")}""",
    "gen_population": f"""WITH {_GRAPH}{_N}, r AS (SELECT unnest(range(0, 3 * n)) AS id FROM n), e AS (SELECT src || ':' || tgt AS id, src, tgt, {_W} AS w FROM g)
SELECT id AS src, id - id % 3 + pick + CASE WHEN pick >= id % 3 THEN 1 ELSE 0 END AS tgt, {_MEAN} AS weight FROM {_partners("r", "2", 0.5, "'intra'", "6")}
UNION ALL SELECT src * 3 + pick // 3, tgt * 3 + pick % 3, w FROM {_partners("e", "9", 0.3, "'inter'", "6")}""",
    "gen_hybrid": f"""WITH {_GRAPH}{_N}, r AS (SELECT unnest(range(0, 2 * n)) AS id, n FROM n),
w AS (SELECT * FROM {_MODULAR} UNION ALL SELECT id, id + 1 + pick, {_MEAN} FROM {_partners("r", "n * 2 - 1 - id", 0.01, "'modules'", "2")}) """
    + _duplicated("w, n", "2 * n", 0.05, 0.05, 3),
    "gen_gnp": f"""WITH {_GRAPH}{_N}, r AS (SELECT id, n FROM u, n) SELECT *, {_DRAWN} AS weight FROM (SELECT id AS src, (id + 1 + pick) % n AS tgt FROM {_partners("r", "n - 1", 0.05, "'gnp'", "1")})""",
    "gen_gnp_certain": f"WITH {_GRAPH}{_N} SELECT a.id AS src, count(*) AS n, sum(b.id)::BIGINT AS total FROM u a JOIN u b ON a.id <> b.id GROUP BY a.id",
    "gen_planted": f"""WITH {_GRAPH}{_N}, r AS (SELECT id, n, id % 4 AS m, n // 4 + CASE WHEN id % 4 < n % 4 THEN 1 ELSE 0 END AS size FROM u, n)
SELECT *, {_DRAWN} AS weight FROM (SELECT id AS src, (pick + CASE WHEN pick >= id // 4 THEN 1 ELSE 0 END) * 4 + m AS tgt FROM {_partners("r", "size - 1", 0.08, "'in'", "1")}
UNION ALL SELECT id, pick // 3 * 4 + pick % 3 + CASE WHEN pick % 3 >= m THEN 1 ELSE 0 END FROM {_partners("r", "n - size", 0.005, "'out'", "1")})""",
    "gen_spatial": f"""WITH {_GRAPH}, p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT count(*) AS n FROM p),
q AS MATERIALIZED (SELECT a.id AS src, b.id AS tgt, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d FROM p a JOIN p b ON a.id <> b.id),
b AS MATERIALIZED (SELECT least(1.0::DOUBLE, 8 * n / (SELECT sum(exp(-d / 0.05::DOUBLE)) FROM q)) AS base, n FROM n),
r AS (SELECT id, n, base FROM p, b), f AS (SELECT id AS src, (id + 1 + pick) % n AS tgt FROM {_partners("r", "n - 1", "base * exp(-4.0::DOUBLE)", "'far'", "6")})
SELECT src, tgt, {_MEAN} AS weight FROM q, b WHERE d <= 0.2::DOUBLE AND {_u("'spatial'", "6", "src", "tgt")} < base * exp(-d / 0.05::DOUBLE)
UNION ALL SELECT src, tgt, {_MEAN} FROM f JOIN q USING (src, tgt) WHERE d > 0.2::DOUBLE AND {_u("'keep'", "6", "src", "tgt")} < exp((0.2::DOUBLE - d) / 0.05::DOUBLE)""",
    "gen_motif_fill": f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events), n AS (SELECT max(id) + 1 AS n FROM u), r AS (SELECT unnest(range(0, 3 * n)) AS id, n FROM n)
SELECT id * 3 + a AS src, id * 3 + b AS tgt, 0.5::DOUBLE AS weight FROM u, (VALUES (0, 1), (1, 0), (2, 0), (1, 2)) AS e(a, b)
UNION ALL SELECT id, id + 1 + pick, 0.5::DOUBLE FROM {_partners("r", "3 * n - 1 - id", 0.01, "'motif'", "8")}""",
    "motif_instantiate": "SELECT id * 3 + a AS src, id * 3 + b AS tgt FROM (SELECT DISTINCT user_id AS id FROM events), (VALUES (0, 1), (1, 0), (2, 0), (1, 2)) AS e(a, b)",
    "gen_random_control": f"WITH {_GRAPH} SELECT src, value AS tgt, {_MEAN} AS weight FROM ({_shuffled('tgt', 'stubs')})",
    "control_uniform": f"WITH {_GRAPH}{_N} SELECT src, {_below('n', chr(39) + 'uniform' + chr(39), '4', 'src', 'tgt')} AS tgt FROM g, n",
    "control_motif_destroyed": f"WITH {_GRAPH}{_N} SELECT src, least(greatest(src + value, 0), n - 1) AS tgt FROM ({_shuffled('tgt - src', 'spans')}), n",
    "control_gapped_spans": f"""WITH g AS (SELECT DISTINCT l_partkey * 3 AS src, l_suppkey * 50 AS tgt FROM lineitem), i AS (SELECT src AS id FROM g UNION SELECT tgt FROM g),
m AS (SELECT src, src + value AS x FROM ({_shuffled("tgt - src", "spans")}))
SELECT src, CASE WHEN h.id IS NULL OR x - l.id <= h.id - x THEN l.id ELSE h.id END AS tgt FROM m ASOF LEFT JOIN i l ON x >= l.id ASOF LEFT JOIN i h ON x <= h.id""",
    "spike_counts": f"WITH {_SPIKES} SELECT id AS nid, (SELECT count(*) FROM s WHERE nid = id AND tick BETWEEN 0 AND 719) AS n FROM u",
    "rate_histogram": f"WITH {_SPIKES} SELECT tick, count(*) AS n FROM s WHERE tick BETWEEN 0 AND 719 GROUP BY tick",
    "graph_health": f"""WITH {_SPIKES}, c AS (SELECT id, (SELECT count(*) FROM s WHERE nid = id AND tick BETWEEN 0 AND 719) AS n FROM u),
r AS (SELECT n, row_number() OVER (ORDER BY n, id) AS i FROM c),
a AS (SELECT count(*) AS k, sum(n) AS t, count(*) FILTER (n > 0) AS act, 2::DOUBLE * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0::DOUBLE) / count(*) AS gini, (SELECT max(m) FROM (SELECT count(*) AS m FROM s GROUP BY tick)) AS busy FROM r),
v AS (SELECT 'exploding' AS "check", t::DOUBLE / k / 0.072::DOUBLE AS value, 100.0::DOUBLE AS threshold FROM a UNION ALL SELECT 'dead', t::DOUBLE, 1.0 FROM a UNION ALL SELECT 'synchrony', busy::DOUBLE / t::DOUBLE, 0.5 FROM a
  UNION ALL SELECT 'hub_dominated', gini, 0.9 FROM a UNION ALL SELECT 'isolation', 1.0::DOUBLE - act::DOUBLE / k, 0.9 FROM a)
SELECT "check", round(value, 9) AS value, threshold, CASE WHEN "check" = 'dead' THEN value > 0 ELSE value <= threshold END AS passed FROM v""",
    "fidelity": _FID.format(spikes=_SPIKES, cand="SELECT nid, tick FROM s WHERE kind <> 'error'"),
    "fidelity_shifted": _FID.format(spikes=_SPIKES, cand="SELECT nid, tick + 5 AS tick FROM s WHERE tick + 5 < 720"),
    "graph_health_sparse": """WITH s AS (SELECT o_custkey AS nid, o_orderdate::DATE - DATE '1995-01-01' AS tick FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT c_custkey AS id, (SELECT count(*) FROM s WHERE nid = c_custkey AND tick BETWEEN 0 AND 2499) AS n FROM customer),
r AS (SELECT n, row_number() OVER (ORDER BY n, id) AS i FROM c),
a AS (SELECT count(*) AS k, sum(n) AS t, count(*) FILTER (n > 0) AS act, 2::DOUBLE * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0::DOUBLE) / count(*) AS gini, (SELECT max(m) FROM (SELECT count(*) AS m FROM s WHERE tick BETWEEN 0 AND 2499 GROUP BY tick)) AS busy FROM r),
v AS (SELECT 'exploding' AS "check", t::DOUBLE / k / 0.25::DOUBLE AS value, 100.0::DOUBLE AS threshold FROM a UNION ALL SELECT 'dead', t::DOUBLE, 1.0 FROM a UNION ALL SELECT 'synchrony', busy::DOUBLE / t::DOUBLE, 0.5 FROM a
  UNION ALL SELECT 'hub_dominated', gini, 0.9 FROM a UNION ALL SELECT 'isolation', 1.0::DOUBLE - act::DOUBLE / k, 0.9 FROM a UNION ALL SELECT 'sparse_activity', act::DOUBLE / k, 0.999 FROM a WHERE act::DOUBLE / k < 0.999 AND t > 0)
SELECT "check", round(value, 9) AS value, threshold, CASE WHEN "check" = 'dead' THEN value > 0 ELSE value <= threshold END AS passed FROM v""",
    "sweep_knee": """WITH e AS (SELECT event_type AS condition, user_id AS nid FROM events UNION ALL SELECT 'real', user_id FROM events),
c AS (SELECT condition, nid, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n DESC, nid) AS k, sum(n) OVER (PARTITION BY condition) AS total, count(*) OVER (PARTITION BY condition) AS size FROM c),
p AS (SELECT condition, 1.0::DOUBLE / f AS budget_fraction, greatest(1, max(size) // f)::DOUBLE / max(size) AS resident_fraction, sum(n) >= max(total) * 0.6::DOUBLE AS ok FROM r, (VALUES (1), (2), (4), (8), (16)) AS v(f) WHERE k <= greatest(1, size // f) GROUP BY condition, f),
l AS (SELECT condition, min(resident_fraction) FILTER (ok) AS low, bool_or(NOT ok) AS failed FROM p GROUP BY condition),
m AS (SELECT l.*, (SELECT max(budget_fraction) FROM p WHERE p.condition = l.condition AND ok AND resident_fraction = low) AS budget, (SELECT low FROM l WHERE condition = 'real') AS best, (SELECT bool_or(failed) FROM l) AS knee_found FROM l)
SELECT condition, low AS least_resident, budget AS budget_fraction, CASE WHEN condition <> 'real' THEN low / best END AS ratio,
  CASE WHEN condition <> 'real' AND low > best THEN 'real_wins' WHEN condition <> 'real' AND low IS NOT NULL AND best IS NOT NULL THEN 'control_ties_or_wins' END AS verdict, failed, knee_found FROM m""",
    "train_key_gaps": "WITH a AS (SELECT DISTINCT o_custkey AS nid FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS nid FROM orders WHERE o_orderstatus = 'P') SELECT nid, 'candidate' AS missing_in FROM a WHERE nid NOT IN (FROM b) UNION ALL SELECT nid, 'reference' FROM b WHERE nid NOT IN (FROM a)",
    "queue_drain": f"WITH {_SPIKES} SELECT tick, row_number() OVER (PARTITION BY tick ORDER BY event_id) AS seq, event_id FROM s WHERE tick <= 100",
    "queue_next": f"WITH {_SPIKES} SELECT count(*) AS waiting, min(tick) AS next_tick, arg_min(event_id, (tick, event_id)) AS event_id, arg_min(nid, (tick, event_id)) AS nid FROM s WHERE tick > 100",
    "peak_resident": f"WITH {_SPIKES}, t AS (SELECT DISTINCT tick FROM s), c AS (SELECT t.tick, count(DISTINCT nid) AS resident FROM t JOIN s ON s.tick BETWEEN t.tick - 15 AND t.tick GROUP BY t.tick) SELECT tick, resident FROM c ORDER BY resident DESC, tick LIMIT 1",
    "drive_slots": f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events), n AS (SELECT 2 * (max(id) + 1) AS n FROM u), k AS (SELECT tick, unnest(range(0, 40)) AS slot, n FROM (SELECT unnest(range(0, {_HOURS})) AS tick), n),
x AS (SELECT tick, {_below("n", "'slot'", "5", "tick", "slot")} AS nid FROM k) SELECT tick, nid, count(*) * 0.5::DOUBLE AS i FROM x WHERE nid IN (SELECT id FROM u) GROUP BY tick, nid""",
    "closed_form": f"""SELECT event_id, round(user_id % 7 + (value / 100 - user_id % 7) * pow({_DECAY}, event_id % 50), 9) AS v, round_even(round(value, 1) / 0.1::DOUBLE, 0)::BIGINT AS tick, event_id % 10 = 2 IS FALSE AND event_id % 10 > 1 AS finite FROM events""",
    "readable_numbers": """WITH o AS (SELECT o_orderkey, floor(o_totalprice * 100)::BIGINT AS c, ([1, 1024, 1048576, 1073741824, 1099511627776])[o_orderkey % 5 + 1] * (o_custkey % 3000) AS z, (o_orderkey % 997) * ([1e-7::DOUBLE, 1e-4::DOUBLE, 0.03::DOUBLE, 4.0::DOUBLE])[o_custkey % 4 + 1] AS s, o_orderdate FROM orders)
SELECT o_orderkey, format('{:,}', c) AS amount, CASE WHEN z < 1024 THEN z::VARCHAR || ' B' WHEN z < 1048576 THEN format('{:.1f} KiB', z / 1024.0::DOUBLE) WHEN z < 1073741824 THEN format('{:.1f} MiB', z / 1048576.0::DOUBLE) WHEN z < 1099511627776 THEN format('{:.1f} GiB', z / 1073741824.0::DOUBLE) ELSE format('{:.1f} TiB', z / 1099511627776.0::DOUBLE) END AS size,
  CASE WHEN s < 1e-3::DOUBLE THEN format('{:.0f} us', s * 1e6::DOUBLE) WHEN s < 1 THEN format('{:.1f} ms', s * 1e3::DOUBLE) WHEN s < 60 THEN format('{:.2f} s', s) ELSE format('{}m {:04.1f}s', floor(s / 60.0::DOUBLE)::BIGINT, s - floor(s / 60.0::DOUBLE) * 60.0::DOUBLE) END AS took, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM o""",
    "plain_texts": "SELECT doc_id, md5(regexp_replace(" + _nested("coalesce(text, '')", _ASCII) + ", '[^\\x00-\\x7F]', '?', 'g')) AS ascii, md5(" + _nested("coalesce(text, '')", [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")]) + ") AS html FROM documents",
    "retry_hints": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN user_id::DOUBLE END AS seconds FROM events",
    "learned_updates": f"""WITH {_SPIKES}, c AS (SELECT nid, kind, count(*) FILTER (tick < 360) AS old, count(*) FILTER (tick >= 360) AS new FROM s GROUP BY ALL), m AS (SELECT nid, kind, CASE WHEN new > 0 THEN new ELSE old END AS n FROM c)
SELECT nid, coalesce(max(n) FILTER (kind = 'click'), 0) AS click, coalesce(max(n) FILTER (kind = 'error'), 0) AS error, coalesce(max(n) FILTER (kind = 'purchase'), 0) AS purchase, coalesce(max(n) FILTER (kind = 'signup'), 0) AS signup, coalesce(max(n) FILTER (kind = 'view'), 0) AS view, count(*) AS kinds FROM m GROUP BY nid""",
    "drive_blocks": f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events), b AS (SELECT id, unnest(range(0, 15)) AS block FROM u)
SELECT block, id AS nid FROM b WHERE {_u("'drive'", "1", "CASE WHEN least(2, block * 100 * 3 // 1500) = 1 THEN 'B' ELSE 'A' END", "id", "block")} < 0.4::DOUBLE""",
    "drive_hot_carry": f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events), f AS (SELECT * FROM (SELECT id, unnest(range(0, 8)) AS block FROM u) WHERE {_u("'fresh'", "1", "id", "block")} < 0.2::DOUBLE)
SELECT block, id AS nid FROM f UNION SELECT block + 1, id FROM f WHERE {_u("'carry'", "1", "id", "block")} < 0.5 AND block + 1 < 8""",
    "fan_out": f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events), n AS (SELECT max(id) + 1 AS n FROM u), k AS (SELECT id, unnest(range(0, 8)) AS k, n FROM u, n)
SELECT id AS src, k, {_below("n", "'target'", "9", "id", "k")} AS tgt, 0.4::DOUBLE + 0.2::DOUBLE * (2 * {_u("'weight'", "9", "id", "k")} - 1) AS weight, 1 + {_below("4", "'delay'", "9", "id", "k")} AS delay FROM k""",
    "weight_quantize": f"""WITH u AS (SELECT DISTINCT user_id AS id FROM events), k AS (SELECT id, unnest(range(0, 8)) AS k FROM u),
w AS (SELECT id, k, 0.4::DOUBLE + 0.2::DOUBLE * (2 * {_u("'weight'", "9", "id", "k")} - 1) AS w FROM k)
SELECT id AS src, k, round(0.2::DOUBLE + round_even((w - 0.2::DOUBLE) / 0.4::DOUBLE * 3, 0) / 3 * 0.4::DOUBLE, 9) AS weight FROM w""",
    "lif_fold": f"""WITH {_SPIKES}, c AS (SELECT nid, tick, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT id, t, coalesce(24.0::DOUBLE * n, 0) AS i FROM (SELECT id, unnest(range(0, {_HOURS})) AS t FROM u) LEFT JOIN c ON nid = id AND tick = t),
l AS (SELECT id, list(struct_pack(v := 0::DOUBLE, until := 0::BIGINT, n := 0::BIGINT, t := t::BIGINT, i := i) ORDER BY t) AS l FROM g GROUP BY id),
f AS (SELECT id, list_reduce(list_concat([struct_pack(v := 0::DOUBLE, until := 0::BIGINT, n := 0::BIGINT, t := (-1)::BIGINT, i := 0::DOUBLE)], l), lambda a, x: struct_pack(
  v := CASE WHEN x.t < a.until OR x.i + (a.v - x.i) * {_DECAY} >= 1 THEN 0::DOUBLE ELSE x.i + (a.v - x.i) * {_DECAY} END,
  until := CASE WHEN x.t >= a.until AND x.i + (a.v - x.i) * {_DECAY} >= 1 THEN x.t + 21 ELSE a.until END,
  n := a.n + CASE WHEN x.t >= a.until AND x.i + (a.v - x.i) * {_DECAY} >= 1 THEN 1 ELSE 0 END, t := x.t, i := x.i)) AS r FROM l)
SELECT id AS nid, r.n AS n_spikes, round(r.v, 9) AS v FROM f""",
    "event_order": f"WITH {_SPIKES} SELECT tick, nid, event_id, row_number() OVER (PARTITION BY tick ORDER BY event_id) AS seq FROM s",
    "event_delivery": f"WITH {_GRAPH}, s AS (SELECT user_id AS nid, floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600)::INT + 2 AS tick FROM events) SELECT tick, tgt AS nid, count(*) AS n FROM s JOIN g ON src = nid WHERE tick < {_HOURS} GROUP BY ALL",
    "frontier_fold": _FRONTIER + " SELECT * FROM f",
    "frontier_states": _FRONTIER + " SELECT state, count(*) AS n, sum(evictions)::BIGINT AS evictions FROM f GROUP BY state",
    "budget_evict": f"WITH {_SPIKES}, b AS (SELECT nid, tick // 24 AS day, max(tick) AS last FROM s GROUP BY ALL) SELECT day, nid, last FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY last DESC, nid DESC) AS k FROM b) WHERE k > 20",
    "stream_window_counts": """WITH w AS (SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 3 HOUR * o AS start FROM events, (VALUES (0), (1)) AS v(o))
SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL""",
    "frontier_transitions": _LIVES + f" SELECT id AS nid, x.t::INT AS tick, x.k::INT AS step, {_STATES}[x.a + 1] AS from_state, {_STATES}[x.b + 1] AS to_state, x.c AS cause FROM (SELECT id, unnest(r.tr) AS x FROM r)",
    "frontier_residency": _LIVES + " SELECT id AS nid, r.held AS resident_ticks, r.asked AS eviction_requests FROM r",
    "virtual_ids": f"SELECT o_orderkey, h::DECIMAL(20,0) AS id FROM {_hashed('orders', ['42', '3', 'o_custkey', '0', 'o_orderkey'])}",
    "keyed_draws": f"""WITH k AS (SELECT id, unnest(range(0, 8)) AS k FROM (SELECT DISTINCT user_id AS id FROM events)), t AS {_hashed("k", ["9", "id", str(0xD21E), "0", "k"])}, w AS {_hashed("k", ["9", "id", str(0xD21E), "0", "k + 4294967296"])}
SELECT id, t.k, (t.h % 256)::BIGINT AS tgt, w.h::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM t JOIN w USING (id, k)""",
    "sql_fan_out": f"""WITH k AS (SELECT id, unnest(range(0, 8)) AS k FROM (SELECT DISTINCT user_id AS id FROM events)), t AS {_hashed("k", ["9", "id", str(0xD21E), "0", "k"])}, w AS {_hashed("k", ["9", "id", str(0xD21E), "0", "k + 4294967296"])}
SELECT id AS src, t.k::INT AS k, (t.h % 256)::BIGINT AS tgt, 0.4::DOUBLE + 0.2::DOUBLE * (2 * (w.h::DOUBLE / 18446744073709551616.0::DOUBLE) - 1) AS weight FROM t JOIN w USING (id, k)""",
    "sql_virtual_ids": f"""WITH o AS (SELECT o_orderkey, o_custkey FROM orders), a AS {_hashed("o", ["7", "o_custkey", "1", "0", "o_orderkey"])}, t AS {_hashed("o", ["7", "o_custkey", "5", "1", "o_orderkey"])}, w AS {_hashed("o", ["7", "o_custkey", "5", "1", "o_orderkey + 4294967296"])}
SELECT o_orderkey, a.h::DECIMAL(20,0) AS id, (t.h % 1000)::BIGINT AS tgt, w.h::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM a JOIN t USING (o_orderkey) JOIN w USING (o_orderkey)""",
    "corpus_chunks": f"""WITH {_RAW}, kept AS (SELECT * FROM raw WHERE pre <> 0 AND post <> 0 AND pre <> post AND (conf IS NULL OR conf::FLOAT >= 0.05::DOUBLE))
SELECT count(*) AS manifest_rows, count(*) FILTER (nt = 255) AS unknown, count(*) AS rows_seen, (SELECT count(*) FROM (SELECT DISTINCT pre, post, nt FROM kept)) AS "distinct",
  (SELECT count(*) FROM (SELECT pre FROM kept UNION SELECT post FROM kept)) AS neurons, count(*) AS described, true AS all_digested FROM raw""",
    "graph_file": f"WITH {_GRAPH}{_N} SELECT src + c * n AS src, tgt + c * n AS tgt, {_W} AS weight FROM g, n, (VALUES (0), (1)) AS v(c)",
    "stream_frontier": _FRONTIER + " SELECT * FROM f",
    "stream_queue": f"WITH {_SPIKES} SELECT tick, nid, event_id, row_number() OVER (PARTITION BY tick ORDER BY event_id)::INT AS seq FROM s",
}
ORACLES["byte_range_edges"] = ORACLES["edge_normalize_counts"]
