"""DuckDB SQL of the queries. Chain decoders are recursive queries in fixed point."""

from __future__ import annotations

import numpy as np

from ..functions.design import state_frequencies
from ..functions.emissions import NANO, fixed
from ..functions.specs import CountEmission, GenotypeEmission, GeometricDuration, RigidDuration, transition
from .queries import DESIGN
from .views import BIN_GENO, CALLS, OBS_SQL, PANEL, POOLED, SPACING, duck

COUNT, GT = CountEmission(), GenotypeEmission()
PRIORS = state_frequencies(DESIGN)
_OBS = f"obs AS ({OBS_SQL})"
_CALLS = f"{_OBS}, calls AS (SELECT *, CAST({CALLS} AS INT) AS g FROM obs)"
_KNOWN = f"{_CALLS}, st AS (SELECT name, chr, pos, g AS state FROM calls WHERE g <> 3)"


def _ints(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return fixed(np.log(p))


def _count_logs() -> list[str]:
    c = COUNT.conc
    lbeta = lambda x, y: f"(lgamma({x}) + lgamma({y}) - lgamma({x} + {y}))"
    choose = "(lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1))"
    return [f"CASE WHEN n = 0 THEN 0 ELSE CAST(round({NANO} * ({choose} + {lbeta(f'(a + {t * c!r})', f'(n - a + {(1 - t) * c!r})')} - {lbeta(repr(t * c), repr((1 - t) * c))})) AS BIGINT) END" for t in COUNT.theta]


def _call_logs(emission: GenotypeEmission = GT) -> list[str]:
    return ["CASE g " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(row)) + " END" for row in _ints(emission.matrix()).tolist()]


def _pick(values: list[str], last: bool) -> tuple[str, str]:
    """(best, number of the best) of expressions; the first or last on equal."""
    best = f"greatest({', '.join(values)})"
    order = list(enumerate(values))
    order = order[::-1] if last else order
    return best, "CASE " + " ".join(f"WHEN {v} = {best} THEN {k}" for k, v in order) + " END"


def viterbi_sql(rows: str, logs: list[str], start: list[int], moves: dict[tuple[int, int], str], last: bool = False, states: int = 3, extra: str = "") -> str:
    """CTEs ending in path(name, chr, pos, st). ``rows`` has name, chr, pos and what the
    logs read; moves maps (from, to) to an integer expression; absent ones are
    impossible. Substate k of a macro state has the macro's log."""
    per = states // 3
    x = ", ".join(f"{e} AS e{k}" for k, e in enumerate(logs))
    low = -(10**15)
    first = ", ".join(f"{start[k]} + e{k // per} AS s{k}" for k in range(states))
    step, back = [], []
    for k in range(states):
        froms = [j for j in range(states) if (j, k) in moves]
        best, arg = _pick([f"(f.s{j} + {moves[j, k]})" for j in froms], last)
        for i, j in reversed(list(enumerate(froms))):
            arg = arg.replace(f" THEN {i} ", f" THEN #{j} ").replace(f" THEN {i} END", f" THEN #{j} END")
        step.append(f"greatest({best}, {low * 1000}) + x.e{k // per} AS s{k}")
        back.append(f"{arg.replace('#', '')} AS b{k}")
    final = _pick([f"s{k}" for k in range(states)], False)[1]
    return f"""
c AS (SELECT *, row_number() OVER (PARTITION BY name, chr ORDER BY pos) AS rn, lag(pos) OVER (PARTITION BY name, chr ORDER BY pos) AS before{extra} FROM ({rows})),
x AS MATERIALIZED (SELECT name, chr, pos, rn, pos - before AS gap, {x} FROM c),
f AS (SELECT name, chr, pos, rn, {first}, {', '.join(f'0 AS b{k}' for k in range(states))} FROM x WHERE rn = 1
  UNION ALL SELECT x.name, x.chr, x.pos, x.rn, {', '.join(step)}, {', '.join(back)} FROM f JOIN x ON x.name = f.name AND x.chr = f.chr AND x.rn = f.rn + 1),
n AS (SELECT name, chr, max(rn) AS rn FROM x GROUP BY name, chr),
p AS (SELECT f.name, f.chr, f.pos, f.rn, {final} AS s, {', '.join(f'f.b{k}' for k in range(states))} FROM f JOIN n ON f.name = n.name AND f.chr = n.chr AND f.rn = n.rn
  UNION ALL SELECT f.name, f.chr, f.pos, f.rn, CASE p.s {' '.join(f'WHEN {k} THEN p.b{k}' for k in range(states))} END, {', '.join(f'f.b{k}' for k in range(states))}
  FROM p JOIN f ON f.name = p.name AND f.chr = p.chr AND f.rn = p.rn - 1),
path AS (SELECT name, chr, pos, CAST(s // {per} AS INT) AS st FROM p)"""


def _plain(t) -> tuple[list[int], dict]:
    step = _ints(t.step)
    return _ints(t.start).tolist(), {(j, k): str(int(step[j, k])) for j in range(3) for k in range(3)}


def _rigid(t) -> tuple[list[int], dict]:
    r, step, start = t.rigid, _ints(t.step), _ints(t.start)
    low = -(10**15)
    first = [int(start[m]) if k == 0 else low for m in range(3) for k in range(r)]
    moves = {}
    for m in range(3):
        for k in range(1, r):
            moves[m * r + k - 1, m * r + k] = "0"
        moves[m * r + r - 1, m * r + r - 1] = str(int(step[m, m]))
        for o in range(3):
            if o != m:
                moves[m * r + r - 1, o * r] = str(int(step[m, o]))
    return first, moves


def _geometric(r: float = 0.01):
    return _plain(transition(GeometricDuration(r), *PRIORS))


_COUNT_ROWS = "SELECT name, chr, pos, n_ref + n_alt AS n, n_alt AS a FROM obs WHERE n_ref + n_alt >= 1"
_CALL_ROWS = "SELECT name, chr, pos, g FROM calls WHERE g <> 3"
_HARD = """CASE WHEN n_ref + n_alt < 2 THEN 3 WHEN CAST(n_alt AS DOUBLE) / (n_ref + n_alt) BETWEEN 0.25 AND 0.75 THEN 1
  WHEN CAST(n_alt AS DOUBLE) / (n_ref + n_alt) >= 0.95 THEN 2 WHEN CAST(n_alt AS DOUBLE) / (n_ref + n_alt) <= CAST(1 AS DOUBLE) - CAST(0.95 AS DOUBLE) THEN 0 ELSE 3 END"""
_HARD_ROWS = f"SELECT name, chr, pos, CAST({_HARD} AS INT) AS g FROM obs"


def _lb_logs(err: float = 0.01, g: float = 0.05) -> list[str]:
    ok, bad, half = np.log(1 - err), np.log(err), np.log(0.5)
    raw = [f"(r * {ok!r} + a * {bad!r})", f"((r + a) * {half!r})", f"(a * {ok!r} + r * {bad!r})"]
    raw = [x.replace("np.float64(", "(") for x in raw]
    top = f"greatest({', '.join(raw)})"
    return [f"CAST(round({NANO} * ln(exp({x} - {top}) * {1 - 2 * g!r} + {g!r})) AS BIGINT)" for x in raw]


def _lb_moves(distance: float) -> dict:
    e = f"exp(-x.gap / CAST({distance!r} AS DOUBLE))"
    stay, move = (f"CAST(round({NANO} * ln(0.5 * (1 {s} {e}))) AS BIGINT)" for s in "+-")
    kinds = [[stay, move, f"2 * {move}"], [move, stay, move], [f"2 * {move}", move, stay]]
    return {(j, k): kinds[j][k] for j in range(3) for k in range(3)}


def _lb(distance: float) -> str:
    rows = "SELECT name, chr, pos, n_ref AS r, n_alt AS a FROM obs"
    third = int(_ints(np.array([1 / 3]))[0])
    return viterbi_sql(rows, _lb_logs(), [third] * 3, _lb_moves(distance))


_STATES = "SELECT name, chr, pos, st AS state FROM path"


def _segments(source: str, extra: str = "") -> str:
    """Runs of ``source`` (name, chr, pos, state), by numbering changes."""
    return f"""SELECT name, chr, min(pos) AS start_bp, max(pos) AS end_bp, state{extra} FROM (
  SELECT *, sum(new) OVER (PARTITION BY name, chr ORDER BY pos) AS run FROM (
    SELECT *, CASE WHEN lag(state) OVER (PARTITION BY name, chr ORDER BY pos) = state THEN 0 ELSE 1 END AS new FROM ({source})))
GROUP BY name, chr, run, state"""


def _decoded(base: str, rows: str, logs: list[str], start, moves, last=False, states=3) -> str:
    return f"WITH RECURSIVE {base}, {viterbi_sql(rows, logs, start, moves, last, states)}"


def _sweep(parts: list[tuple[str, float]], column: str) -> str:
    return " UNION ALL ".join(f"SELECT *, CAST({v!r} AS DOUBLE) AS {column} FROM ({cte} {_segments(_STATES)})" for cte, v in parts)


def _genotype(prior: str, cast: str = "INT") -> str:
    """prior: expression list l0, l1, l2 over p."""
    return f"""WITH {_OBS}, site AS (SELECT chr, pos, CASE WHEN sum(n_ref + n_alt) > 0 THEN CAST(sum(n_alt) AS DOUBLE) / sum(n_ref + n_alt) ELSE 0.5 END AS p0 FROM obs GROUP BY chr, pos),
q AS (SELECT o.*, least(greatest(p0, 1e-12), 1 - 1e-12) AS p FROM obs o JOIN site s ON o.chr = s.chr AND o.pos = s.pos),
s AS (SELECT *, n_ref * ln(0.99) + n_alt * ln(0.01) + l0 AS s0, (n_ref + n_alt) * ln(0.5) + l1 AS s1, n_ref * ln(0.01) + n_alt * ln(0.99) + l2 AS s2 FROM (SELECT *, {prior} FROM q))
SELECT name, chr, pos, n_ref, n_alt, CAST(CASE WHEN n_ref + n_alt = 0 THEN NULL WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS {cast}) AS g FROM s"""


_FLAT = "ln(1.0 / 3) AS l0, ln(1.0 / 3) AS l1, ln(1.0 / 3) AS l2"
_HWE = "2 * ln(1 - p) AS l0, ln(2.0) + ln(p) + ln(1 - p) AS l1, 2 * ln(p) AS l2"
_FIXED = "ln(0.85) AS l0, ln(0.05) AS l1, ln(0.1) AS l2"

_BLOCKS = f"""{_KNOWN},
e AS (SELECT name, chr, pos, CAST(state > 0 AS INT) AS d, (coalesce(lag(pos) OVER w, pos) + pos) / 2 AS lo, (coalesce(lead(pos) OVER w, pos) + pos) / 2 AS hi,
  CASE WHEN lag(CAST(state > 0 AS INT)) OVER w = CAST(state > 0 AS INT) THEN 0 ELSE 1 END AS new FROM st WINDOW w AS (PARTITION BY name, chr ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY name, chr ORDER BY pos) AS run FROM e),
blocks AS (SELECT name, chr, min(lo) AS start_bp, max(hi) AS end_bp, (max(hi) - min(lo)) / 1000000.0 AS mb FROM r WHERE d = 1 GROUP BY name, chr, run)"""

_BIN = f"{_OBS}, geno AS ({duck(BIN_GENO, obs='obs')})"
_PAIRS = f"""{_BIN}, m AS (SELECT DISTINCT chr, marker FROM geno), fr AS (SELECT a.chr, a.marker AS i, b.marker AS j FROM m a JOIN m b ON a.chr = b.chr AND a.marker < b.marker),
z AS (SELECT a.chr, a.marker AS i, b.marker AS j, a.dosage AS x, b.dosage AS y FROM geno a JOIN geno b ON a.chr = b.chr AND a.sample = b.sample AND a.marker < b.marker)"""


def _entropy(name: str, cells: str) -> str:
    return f"{name} AS (SELECT chr, i, j, ln(sum(c)) - sum(c * ln(c)) / sum(c) + (count(*) - 1) / (2.0 * sum(c)) AS h FROM ({cells}) GROUP BY chr, i, j)"


def _information(value: str) -> str:
    return f"""WITH {_PAIRS}, {_entropy('hx', 'SELECT chr, i, j, x, count(*) AS c FROM z GROUP BY ALL')}, {_entropy('hy', 'SELECT chr, i, j, y, count(*) AS c FROM z GROUP BY ALL')}, {_entropy('hxy', 'SELECT chr, i, j, x, y, count(*) AS c FROM z GROUP BY ALL')}
SELECT fr.chr, fr.i, fr.j, round(coalesce({value}, 0.0) + 0.0, 8) AS value FROM fr LEFT JOIN hx USING (chr, i, j) LEFT JOIN hy USING (chr, i, j) LEFT JOIN hxy USING (chr, i, j)"""


def _interp(value: str) -> str:
    return f"""WITH panel AS ({duck(PANEL)}), o AS (SELECT DISTINCT chr, cm AS x FROM panel),
t AS (SELECT DISTINCT chr, x + d AS cm FROM o, (VALUES (-0.5), (0.0), (0.25), (0.5)) v(d)),
b AS (SELECT t.chr, t.cm, max(CASE WHEN o.x <= t.cm THEN o.x END) AS l0, min(CASE WHEN o.x >= t.cm THEN o.x END) AS r0 FROM t JOIN o ON o.chr = t.chr GROUP BY t.chr, t.cm),
k AS (SELECT *, l0 IS NOT NULL AND r0 IS NOT NULL AS inside, coalesce(l0, r0) AS l, coalesce(r0, l0) AS r FROM b),
v AS (SELECT k.*, a.sample, a.dosage AS vl, c.dosage AS vr, CASE WHEN r = l THEN 0.0 ELSE (k.cm - l) / (r - l) END AS w FROM k JOIN panel a ON a.chr = k.chr AND a.cm = k.l JOIN panel c ON c.chr = k.chr AND c.cm = k.r AND c.sample = a.sample)
SELECT chr, CAST(cm AS DOUBLE) AS cm, sample, CAST({value} AS DOUBLE) AS dosage FROM v"""


_MM = "CAST(least(2 * n0 + n1, 2 * n2 + n1) AS DOUBLE)"
_SITE = f"""WITH {_CALLS}, s AS (SELECT chr, pos, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, count(*) AS n FROM calls GROUP BY chr, pos)"""


def _binomial(p: float) -> str:
    return f"(k * ln({p}) + (m - k) * ln({1 - p}))"


_POOL = f"pool AS ({duck(POOLED)}), gt AS (SELECT *, CAST({CALLS} AS INT) AS g FROM pool)"
#: Every site of every sample, as files of a line a site have it.
_GRID = f"{_POOL}, site AS (SELECT DISTINCT chr, pos FROM pool), nm AS (SELECT DISTINCT name FROM pool), grid AS (SELECT name, chr, pos FROM site CROSS JOIN nm)"
_KEPT = """SELECT * FROM (SELECT name, chr, pos, 'A' AS ref, 'C' AS alt, CAST(CAST(floor(pos / 10000.0 % 50) AS INT) AS DOUBLE) AS qual, CASE coalesce(g, 3) WHEN 0 THEN '0/0' WHEN 1 THEN '0|1' WHEN 2 THEN '1/1' ELSE './.' END AS cell,
  avg(CASE WHEN coalesce(g, 3) = 3 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY chr, pos) AS gone FROM grid LEFT JOIN gt USING (name, chr, pos) WHERE pos % 7 <> 0 AND chr IN (1, 2, 3, 5))"""


def _file_sql(bbnil: str) -> dict[str, str]:
    reads = f"WITH {_GRID} SELECT name, chr, pos, coalesce(n_ref, 0) AS n_ref, coalesce(n_alt, 0) AS n_alt FROM grid LEFT JOIN pool USING (name, chr, pos)"
    calls = f"WITH {_GRID} SELECT name, chr, pos, coalesce(g, 3) AS g FROM grid LEFT JOIN gt USING (name, chr, pos)"
    known = f"{_POOL}, st AS (SELECT name, chr, pos, g AS state FROM gt WHERE g <> 3)"
    fam = "'F' || s_nationkey AS family, 'S' || s_suppkey AS taxon"
    none = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("contribution1", "contribution2", '"F"'))
    return {
        "file_counts_tsv": duck(POOLED), "file_vcf_ad": reads, "file_vcf_ad_biallelic": f"{reads} WHERE pos % 7 <> 0", "file_vcf_gt": calls, "file_hapmap": calls, "file_plink": calls,
        "file_vcf_gt_samples": f"{calls} WHERE name IN ('NO', 'RF')",
        "file_vcf_filtered": f"WITH {_GRID} SELECT name, chr, pos, ref, alt, qual, cell FROM ({_KEPT}) WHERE qual >= 20 AND gone <= 0.5 AND name IN ('NO', 'RF')",
        "file_pedigree_table": f"""SELECT {fam}, 'G' || s_nationkey AS parent1, CASE WHEN s_suppkey % 3 = 0 THEN 'B73' END AS parent2, CAST(0.75 AS DOUBLE) AS contribution1, CAST(0.25 AS DOUBLE) AS contribution2,
  CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 4 AS DOUBLE) / 4 END AS "F" FROM supplier""",
        "file_pedigree_fam": f"SELECT {fam}, 'G1' AS parent1, 'G2' AS parent2, {none} FROM supplier",
        "file_segments_file": f"SELECT 'mosaic_spark' AS source, 'teo' AS donor, * FROM ({bbnil} {_segments(_STATES)})",
        "file_imputed_vcf_file": f"WITH {known}, site AS (SELECT DISTINCT chr, pos FROM st), nm AS (SELECT DISTINCT name FROM st) SELECT name, chr, pos, coalesce(state, 3) AS g FROM site CROSS JOIN nm LEFT JOIN st USING (name, chr, pos)",
        "file_results_files": f"""WITH {known} SELECT 'calls' AS file, count(*) AS n, CAST(sum(state) AS BIGINT) AS total FROM st UNION ALL SELECT 'summary', count(DISTINCT name), CAST(sum(state) AS BIGINT) FROM st
UNION ALL SELECT 'markers', count(*), CAST(sum(pos) AS BIGINT) FROM (SELECT DISTINCT chr, pos FROM st) UNION ALL SELECT 'parameters', 2, 0""",
    }


def _grid_sql() -> str:
    """Every combination's decoding and its metrics."""
    parts = []
    for k, (nir, times) in enumerate(((0.01, 1.0), (0.01, 2.0), (0.1, 1.0), (0.1, 2.0))):
        chain = _plain(transition(GeometricDuration(0.01 * times), 0.25, 0.05))
        path = _decoded(_CALLS, "SELECT name, chr, pos, g FROM calls", _call_logs(GenotypeEmission(0.01, 0.05, 0.5, 0.15, nir)), *chain, last=True)
        parts.append(f"SELECT {k} AS combo, CAST({nir} AS DOUBLE) AS nir, CAST({times} AS DOUBLE) AS r_multiplier, name, count(*) FILTER (st = 0) AS n0, count(*) FILTER (st = 1) AS n1, count(*) FILTER (st = 2) AS n2, count(*) AS n FROM ({path} SELECT * FROM path) GROUP BY name")
    share = ", ".join(f"round(CAST(100 * sum(n{k}) AS DOUBLE) / sum(n), 8) AS pct_{s}" for k, s in enumerate(("ref", "het", "alt")))
    return f"""SELECT combo, nir, CAST(0.01 AS DOUBLE) AS germ, CAST(0.05 AS DOUBLE) AS gert, CAST(0.5 AS DOUBLE) AS p, r_multiplier, {share}, round(avg(n1 / n), 8) AS mean_het_rate, round(avg(n2 / n), 8) AS mean_donor_rate,
  round(stddev_pop(n1 / n), 8) AS sd_het_rate, round(stddev_pop(n2 / n), 8) AS sd_donor_rate, round(100.0 * count(*) FILTER (n1 = 0 AND n2 = 0) / count(*), 8) AS pct_samples_without_donor
FROM ({' UNION ALL '.join(parts)}) GROUP BY combo, nir, r_multiplier"""


def _rate_sql() -> str:
    """Blocks of every rate's decoding against those of the middle one."""
    cut = _BLOCKS[_BLOCKS.index("e AS (") :]
    sizes = []
    for r in (0.001, 0.005, 0.02):
        path = _decoded(_OBS, _COUNT_ROWS, _count_logs(), *_geometric(r))
        sizes.append(f"SELECT CAST({r} AS DOUBLE) AS value, mb FROM ({path}, st AS ({_STATES}), {cut} SELECT mb FROM blocks)")
    return f"""WITH s AS MATERIALIZED ({' UNION ALL '.join(sizes)}), sim AS (SELECT mb FROM s WHERE value = 0.005),
v AS (SELECT value, mb, sum(a) AS a, sum(b) AS b FROM (SELECT value, mb, 1 AS a, 0 AS b FROM s UNION ALL SELECT value, mb, 0, 1 FROM sim CROSS JOIN (SELECT DISTINCT value FROM s)) GROUP BY value, mb),
g AS (SELECT value, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY value) - sum(b) OVER w / sum(b) OVER (PARTITION BY value)) AS g FROM v WINDOW w AS (PARTITION BY value ORDER BY mb)),
k AS (SELECT value, max(g) AS d FROM g GROUP BY value), n AS (SELECT value, count(*) AS n_blocks, quantile_cont(mb, 0.5) AS median_mb FROM s GROUP BY value)
SELECT value, round(d, 9) AS d, n_blocks, round(median_mb, 9) AS median_mb, value IN (0.001, 0.02) AS at_grid_edge FROM k JOIN n USING (value) ORDER BY d, value LIMIT 1"""


#: Nodes in the order of their choice: most markers apart first, then by number. A chosen
#: one strikes out those near it.
_INDEPENDENT = f"""WITH RECURSIVE {_BIN}, m AS (SELECT DISTINCT chr, marker, bin FROM geno),
w AS (SELECT a.chr, a.marker, a.bin, count(*) FILTER (abs(a.bin - b.bin) > 3) AS apart FROM m a JOIN m b ON a.chr = b.chr GROUP BY ALL),
q AS (SELECT chr, list(bin ORDER BY apart DESC, marker) AS rest FROM w GROUP BY chr),
r AS (SELECT chr, rest[1] AS bin, list_filter(rest, lambda x: abs(x - rest[1]) > 3) AS rest FROM q
  UNION ALL SELECT chr, rest[1], list_filter(rest, lambda x: abs(x - rest[1]) > 3) FROM r WHERE len(rest) > 0)
SELECT chr, CAST(chr * 1000000 + bin AS BIGINT) AS marker FROM r"""

_DESIGNS = """WITH s AS (SELECT s_suppkey, s_nationkey % 30 % 5 AS b, s_nationkey % 30 // 5 AS m FROM supplier),
t AS (SELECT *, pow(0.5, b + m) AS h, pow(0.5, b) * (1 - pow(0.5, m)) / 2 AS a FROM s)
SELECT s_suppkey, 'BC' || b || 'S' || m AS design, 1 - h - a AS p_ref, h AS p_het, a AS p_alt, 1 - 2 * (a + h / 2) AS founder_ref, 2 * (a + h / 2) AS founder_het, pow(0.5, m) / 2 AS het, CAST(b AS INT) AS n_bc FROM t"""


def oracle_sql() -> dict[str, str]:
    count, call, hard = _geometric(), _geometric(), _geometric()
    rigid = _rigid(transition(RigidDuration(2, 0.01), *PRIORS))
    bbnil = _decoded(_OBS, _COUNT_ROWS, _count_logs(), *count)
    out = {
        "obs_view": OBS_SQL,
        "min_reads_filter": f"WITH {_OBS} SELECT * FROM obs WHERE n_ref + n_alt >= 3",
        "site_statistics": f"""{_SITE} SELECT chr, pos, n0, n1, n2, n, 2 * n0 + n1 AS ref_count, 2 * n2 + n1 AS alt_count, 1 - CAST(n0 + n1 + n2 AS DOUBLE) / n AS p_missing,
  CASE WHEN n0 + n1 + n2 = 0 THEN 0.0 ELSE {_MM} / (2 * (n0 + n1 + n2)) END AS maf, CASE WHEN n0 + n1 + n2 = 0 THEN 0.0 ELSE CAST(n1 AS DOUBLE) / (n0 + n1 + n2) END AS p_het FROM s""",
        "segregating_sites": f"""{_SITE}, q AS (SELECT chr, pos, {_MM} AS k, 2 * (n0 + n1 + n2) AS m FROM s)
SELECT chr, pos, k > 0 AND {_binomial(0.25)} > {_binomial(0.5)} AND {_binomial(0.25)} > {_binomial(0.002)} AS seg FROM q""",
        "genotype_flat": _genotype(_FLAT, "DOUBLE"),
        "genotype_hwe": _genotype(_HWE, "DOUBLE"),
        "genotype_prior": _genotype(_FIXED, "DOUBLE"),
        "genotype_posterior": f"""WITH {_OBS}, s AS (SELECT *, n_ref * ln(0.99) + n_alt * ln(0.01) AS s0, (n_ref + n_alt) * ln(0.5) AS s1, n_ref * ln(0.01) + n_alt * ln(0.99) AS s2 FROM obs),
e AS (SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM s)
SELECT name, chr, pos, {', '.join(f'CASE WHEN n_ref + n_alt > 0 THEN round(e{k} / (e0 + e1 + e2), 6) END AS p{k}' for k in range(3))} FROM e""",
        "googa_hard_call": f"WITH {_OBS} SELECT *, CAST({_HARD} AS INT) AS g FROM obs",
        "bin_alt_freq": f"""WITH {_OBS}, b AS (SELECT name, chr, CAST(pos // 500000 AS INT) AS bin, min(pos) AS start_bp, max(pos) AS end_bp, CAST(sum(n_alt) AS BIGINT) AS alt, CAST(sum(n_ref + n_alt) AS BIGINT) AS tot, count(*) FILTER (n_ref + n_alt > 0) AS ninf FROM obs GROUP BY 1, 2, 3)
SELECT *, CASE WHEN tot > 0 THEN CAST(alt AS DOUBLE) / tot ELSE 0.0 END AS alt_freq FROM b WHERE ninf >= 1""",
        "viterbi_bbnil": f"{bbnil} {_STATES}",
        "viterbi_nnil": f"{_decoded(_CALLS, _CALL_ROWS, _call_logs(), *call, last=True)} {_STATES}",
        "viterbi_googa": f"{_decoded(_OBS, _HARD_ROWS, _call_logs(), *hard, last=True)} {_STATES}",
        "viterbi_lbimpute": f"WITH RECURSIVE {_OBS}, {_lb(1e6)} {_STATES}",
        "rigid_catiger": f"{_decoded(_CALLS, _CALL_ROWS, _call_logs(), *rigid, last=True, states=6)} {_STATES}",
        "rigid_atlas": f"{_decoded(_OBS, _HARD_ROWS, _call_logs(), *rigid, last=True, states=6)} {_STATES}",
        "segments_bbnil": f"{bbnil} {_segments(_STATES)}",
        "segments_calls": f"WITH {_CALLS} {_segments('SELECT name, chr, pos, g AS state FROM calls')}",
        "sweep_bbnil": _sweep([(_decoded(_OBS, _COUNT_ROWS, _count_logs(), *_geometric(r)), r) for r in (0.001, 0.01)], "rrate"),
        "sweep_lbimpute": _sweep([(f"WITH RECURSIVE {_OBS}, {_lb(v)}", v) for v in (2e5, 1e6)], "recombdist"),
        "gap_fill": f"""WITH {_CALLS}, k AS (SELECT *, last_value(nullif(g, 3) IGNORE NULLS) OVER (PARTITION BY name, chr ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
  first_value(nullif(g, 3) IGNORE NULLS) OVER (PARTITION BY name, chr ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM calls)
SELECT name, chr, pos, CASE WHEN g = 3 AND l = r THEN l ELSE g END AS state FROM k""",
        "despeckle": f"""WITH {_KNOWN}, e AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY name, chr ORDER BY pos) = state THEN 0 ELSE 1 END AS new FROM st),
r AS (SELECT *, sum(new) OVER (PARTITION BY name, chr ORDER BY pos) AS run FROM e)
SELECT name, chr, pos, CASE WHEN state > 0 AND count(*) OVER (PARTITION BY name, chr, run) < 2 THEN 0 ELSE state END AS state FROM r""",
        "donor_blocks": f"WITH {_BLOCKS} SELECT name, chr, CAST(start_bp AS DOUBLE) AS start_bp, CAST(end_bp AS DOUBLE) AS end_bp, CAST(mb AS DOUBLE) AS mb FROM blocks",
        "ks_distance": f"""WITH {_BLOCKS}, v AS (SELECT mb, count(*) FILTER (chr <= 3) AS a, count(*) FILTER (chr > 3) AS b FROM blocks GROUP BY mb)
SELECT round(max(g), 9) AS d FROM (SELECT abs(CAST(sum(a) OVER w AS DOUBLE) / sum(a) OVER () - CAST(sum(b) OVER w AS DOUBLE) / sum(b) OVER ()) AS g FROM v WINDOW w AS (ORDER BY mb))""",
        "donor_fraction": f"WITH {_KNOWN} SELECT name, CAST(sum(state) AS DOUBLE) / (2 * count(*)) AS donor FROM st GROUP BY name",
        "sample_summary": f"""WITH {_KNOWN} SELECT name, count(*) AS markers, {', '.join(f'count(*) FILTER (state = {k}) AS n_{s}, CAST(100 * count(*) FILTER (state = {k}) AS DOUBLE) / count(*) AS pct_{s}' for k, s in enumerate(('ref', 'het', 'alt')))} FROM st GROUP BY name""",
        "quality_metrics": f"""WITH {_KNOWN}, p AS (SELECT chr, name, count(*) FILTER (state = 0) AS n0, count(*) FILTER (state = 1) AS n1, count(*) FILTER (state = 2) AS n2, count(*) AS n FROM st GROUP BY chr, name)
SELECT chr, {', '.join(f'round(CAST(100 * sum(n{k}) AS DOUBLE) / sum(n), 8) AS pct_{s}' for k, s in enumerate(('ref', 'het', 'alt')))}, round(avg(n1 / n), 8) AS mean_het_rate, round(avg(n2 / n), 8) AS mean_donor_rate,
  round(stddev_pop(n1 / n), 8) AS sd_het_rate, round(stddev_pop(n2 / n), 8) AS sd_donor_rate, round(100.0 * count(*) FILTER (n1 = 0 AND n2 = 0) / count(*), 8) AS pct_samples_without_donor FROM p GROUP BY chr""",
        "data_parameters": f"""WITH {_CALLS}, s AS (SELECT avg(CASE WHEN g <> 3 THEN g END) * 0.5 AS maf, count(*) AS n, count(*) FILTER (g = 3) AS m FROM calls GROUP BY chr, pos)
SELECT round(CAST(sum(m) AS DOUBLE) / sum(n), 8) AS missing_rate, round(avg(maf), 8) AS observed_maf, round(greatest((0.5 - avg(maf)) / 0.5, 0.001), 8) AS estimated_nir FROM s""",
        "pair_r2": f"""WITH {_PAIRS}, s AS (SELECT chr, i, j, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * x) AS DOUBLE) AS xx, CAST(sum(y * y) AS DOUBLE) AS yy, CAST(sum(x * y) AS DOUBLE) AS xy FROM z GROUP BY chr, i, j)
SELECT fr.chr, fr.i, fr.j, coalesce(CASE WHEN n < 2 OR n * xx - sx * sx <= 0 OR n * yy - sy * sy <= 0 THEN 0.0 ELSE (n * xy - sx * sy) * (n * xy - sx * sy) / ((n * xx - sx * sx) * (n * yy - sy * sy)) END, 0.0) AS value FROM fr LEFT JOIN s USING (chr, i, j)""",
        "pair_mi": _information("hx.h + hy.h - hxy.h"),
        "pair_vi": _information("(2 * hxy.h - hx.h - hy.h) / ln(2.0)"),
        "position_distance_within": f"""WITH {_BIN}, m AS (SELECT DISTINCT chr, marker, CAST(bin AS DOUBLE) AS pos FROM geno)
SELECT a.marker AS i, b.marker AS j, abs(a.pos - b.pos) AS value FROM m a JOIN m b ON a.chr = b.chr AND a.marker < b.marker WHERE abs(a.pos - b.pos) <= 3""",
        "interp_continuous": _interp("vl + w * (vr - vl)"),
        "interp_step": _interp("CASE WHEN w < 0.5 THEN vl ELSE vr END"),
        "interp_round": _interp("round(vl + w * (vr - vl))"),
        "interp_chen2019": _interp("CASE WHEN inside AND (cm = l OR vl = vr) THEN vl END"),
        "vcf_impute": f"""WITH {_KNOWN}, s AS (SELECT DISTINCT name FROM st), mk AS (SELECT DISTINCT chr, pos FROM st), pt AS (SELECT CAST((p_partkey + 1) * {SPACING} AS INT) AS pos, min(p_brand) AS ref, min(p_type) AS alt FROM part GROUP BY 1)
SELECT mk.chr, mk.pos, concat_ws(chr(9), CAST(mk.chr AS VARCHAR), CAST(mk.pos AS VARCHAR), '.', coalesce(min(pt.ref), 'N'), coalesce(min(pt.alt), 'N'), '.', '.', '.', 'GT',
  string_agg(CASE st.state WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END, chr(9) ORDER BY s.name)) AS value
FROM mk CROSS JOIN s LEFT JOIN st ON st.name = s.name AND st.chr = mk.chr AND st.pos = mk.pos LEFT JOIN pt ON pt.pos = mk.pos GROUP BY mk.chr, mk.pos""",
        "painted_calls": f"""WITH {_KNOWN}, g AS ({_segments('SELECT * FROM st')})
SELECT name, chr, CASE WHEN chr <= 3 THEN 'a' ELSE 'b' END AS track, start_bp / 1000000.0::DOUBLE AS x0, end_bp / 1000000.0::DOUBLE AS x1, CASE WHEN chr <= 3 THEN 1.0::DOUBLE / 2 + 0.015::DOUBLE ELSE 0.015::DOUBLE END AS y0,
  CASE WHEN chr <= 3 THEN 1.0::DOUBLE - 0.015::DOUBLE ELSE 1.0::DOUBLE / 2 - 0.015::DOUBLE END AS y1, state, CASE state WHEN 0 THEN 'REF' WHEN 1 THEN 'HET' ELSE 'ALT' END AS label FROM g""",
        "family_of_line": f"""WITH {_OBS}, n AS (SELECT name, count(*) AS markers FROM obs GROUP BY name)
SELECT n.name, n.markers, 'F' || s_nationkey AS family FROM n LEFT JOIN supplier ON 'S' || s_suppkey = n.name""",
    }
    low = GenotypeEmission(0.08, 0.15, 0.5, 0.20, 0.02)
    preset = _decoded(_CALLS, _CALL_ROWS, _call_logs(low), *_plain(transition(GeometricDuration(0.01), 0.25, 0.05)), last=True)
    out |= _file_sql(bbnil)
    out |= {
        "sweep_nnil": _sweep([(_decoded(_CALLS, "SELECT name, chr, pos, g FROM calls", _call_logs(), *_geometric(r), last=True), r) for r in (0.001, 0.05)], "rrate"),
        "position_distance_all": f"""WITH {_OBS}, m AS (SELECT DISTINCT chr, chr * 1000000 + pos // 50000000 AS marker, CAST(pos // 50000000 AS DOUBLE) AS pos FROM obs)
SELECT a.marker AS i, b.marker AS j, CASE WHEN a.chr = b.chr THEN abs(a.pos - b.pos) ELSE CAST('Infinity' AS DOUBLE) END AS value FROM m a JOIN m b ON a.marker < b.marker""",
        "independent_markers": _INDEPENDENT, "design_priors": _DESIGNS, "parameter_grid": _grid_sql(), "calibrated_rate": _rate_sql(),
        "introgressions": f"SELECT 'mosaic_spark' AS source, CAST(NULL AS VARCHAR) AS donor, * FROM ({preset} {_segments(_STATES)})",
    }
    return out
