"""The table of queries and the SQL fragments they share."""
from __future__ import annotations

from ...functions.multinomial import FACTORS, LEAF, SHIFTS, START
from ..views import HALF_MONTH, READOUTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def u(*keys) -> str:
    """A keyed uniform in SQL."""
    return ("((('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
            + ")), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0)")


def erfc(x: str) -> str:
    """Complementary error function by Simpson's rule over [x, x + 8]."""
    h = 0.002
    return (f"(SELECT 2 / sqrt(pi()) * {h} / 3 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-1 * power(({x}) + i * {h}, 2))) FROM range(4001) q(i))")


PLAIN = """plain AS (SELECT user_id AS scene_index, ts, event_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS cls FROM events)"""
FRAMES = PLAIN + """,
frames AS (SELECT *, row_number() OVER (PARTITION BY scene_index ORDER BY ts, event_id) - 1 AS frame_index FROM plain)"""
SCORED = PLAIN + """,
scored AS (SELECT *, 0.8 * value + 0.3 * k AS y_pred, floor(k / 10) + 2 * cls - 5 AS score,
  CASE WHEN floor(k / 10) + 2 * cls - 5 > 0 THEN 1 ELSE 0 END AS guess, CAST(scene_index % 5 AS INT) AS cell FROM plain)"""


def split(source: str, seed, name: str = "split", scene: str = "scene_index") -> str:
    """CTE (scene, seed, pos, n, is_train) of one or more seeds."""
    seeds = ", ".join(f"({s})" for s in (seed if isinstance(seed, (tuple, list)) else [seed]))
    return f"""{name}_all AS (SELECT {scene}, seed, {u('seed', scene)} AS u FROM (SELECT DISTINCT {scene} FROM {source}) t, (VALUES {seeds}) v(seed)),
{name}_pos AS (SELECT {scene}, seed, row_number() OVER (PARTITION BY seed ORDER BY u, {scene}) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS n FROM {name}_all),
{name} AS (SELECT *, CASE WHEN n = 1 THEN true ELSE pos < greatest(1, least(CAST(round(0.8 * n) AS BIGINT), n - 1)) END AS is_train FROM {name}_pos)"""


def _readout_rows(task: str, condition: str) -> str:
    parts = []
    for encoder, layer, w, noise, lift in READOUTS:
        score = f"(floor(k / 10) + {lift} * cls - 5)"
        head = f"'{encoder}' AS encoder, 'base' AS train_condition, {layer} AS layer, 'mean' AS view, '{task}' AS task, '{condition}' AS eval_condition"
        parts.append(f"SELECT *, {head}, 'value' AS target, value AS y_true, {w} * value + {noise} * k + {1 - w} * 50 AS y_pred, CAST(NULL AS DOUBLE) AS y_score FROM src")
        parts.append(f"SELECT *, {head}, 'alert' AS target, CAST(cls AS DOUBLE) AS y_true, CASE WHEN {score} > 0 THEN 1.0 ELSE 0.0 END AS y_pred, CAST({score} AS DOUBLE) AS y_score FROM src")
    return " UNION ALL ".join(parts)


PREDICTIONS = FRAMES + ",\n" + split("plain", (0, 1)) + f""",
src AS (SELECT 'D' AS exp, s.seed, f.* FROM frames f JOIN split s ON f.scene_index = s.scene_index WHERE NOT s.is_train),
predictions AS ({_readout_rows('real', 'base')})"""

HALVES = PLAIN + f""",
h AS (SELECT *, ts < TIMESTAMP '{HALF_MONTH}' AS early, row_number() OVER (PARTITION BY scene_index, ts < TIMESTAMP '{HALF_MONTH}' ORDER BY ts, event_id) - 1 AS frame_index FROM plain),
base_half AS (SELECT a.* FROM h a JOIN h b ON a.scene_index = b.scene_index AND a.frame_index = b.frame_index WHERE a.early AND NOT b.early),
other_half AS (SELECT b.* FROM h a JOIN h b ON a.scene_index = b.scene_index AND a.frame_index = b.frame_index WHERE a.early AND NOT b.early)"""

FEATURES = """features AS (SELECT vec_id // 10 AS scene_index, vec_id % 10 AS frame_index, embedding AS x, label,
  CASE WHEN label >= 5 THEN 1 ELSE 0 END AS cls FROM embeddings)"""


def cells(dims: int = 64, source: str = "features", keep: str = "scene_index, frame_index, label, cls") -> str:
    """CTE ``cells``: one row per vector entry, i from 0."""
    return f"cells AS (SELECT {keep}, CAST(i AS INT) AS i, CAST(x[i + 1] AS DOUBLE) AS v FROM {source}, range({dims}) r(i))"


def mix(x: str) -> str:
    """The 64-bit finaliser of ``functions.multinomial`` in SQL."""
    low = "18446744073709551615::UHUGEINT"
    step = lambda z, n, c: f"list_transform({z}, lambda z: ((xor(z, z >> {n})::UHUGEINT * {c}::UHUGEINT) & {low})::UBIGINT)"
    first = step(f"[{x}]", SHIFTS[0], FACTORS[0])
    return f"list_transform({step(first, SHIFTS[1], FACTORS[1])}, lambda z: xor(z, z >> {SHIFTS[2]}))[1]"


def _at(h: str, low: str, high: str) -> str:
    inner = mix(f"xor({h}, ({low})::UBIGINT)")
    return mix(f"xor({inner}, ({high})::UBIGINT)")


def _unit(h: str) -> str:
    return f"(({h} >> 11)::DOUBLE / 9007199254740992.0)"


def draws(scenes: str, n_boot: int, by: str = "", seed: str = "0") -> str:
    """CTEs ``numbered`` (by, scene_index, drawn, n_scenes, rseed) and ``drawn`` (by, b, scene_index, times).

    ``scenes`` is a relation of distinct (by, scene_index). The tree of ``functions.multinomial``:
    shapes of its nodes, binomial distributions of their left parts for every number of
    draws, its nodes per replicate, and the picks of its leaves.
    """
    part = f"PARTITION BY {by}" if by else ""
    c = f"{by}, " if by else ""
    uu = u("'scene'", "scene_index")
    half = "CAST(power(2, floor(log2(high - low - 1))) AS BIGINT)"
    return f"""numbered AS (SELECT {c}scene_index, {seed} AS rseed, row_number() OVER ({part} ORDER BY {uu}, scene_index) - 1 AS drawn, count(*) OVER ({part}) AS n_scenes FROM {scenes}),
scene_sets AS (SELECT DISTINCT rseed, n_scenes FROM numbered),
shapes AS (SELECT * FROM (WITH RECURSIVE t AS (SELECT DISTINCT n_scenes, CAST(0 AS BIGINT) AS low, CAST(ceil(n_scenes / {LEAF}.0) AS BIGINT) AS high FROM scene_sets
 UNION ALL SELECT n_scenes, CASE WHEN side = 0 THEN low ELSE low + {half} END, CASE WHEN side = 0 THEN low + {half} ELSE high END FROM t, range(2) s(side) WHERE high - low > 1) SELECT * FROM t)),
parts AS (SELECT n_scenes, low, high, low + {half} AS middle, {half} * {LEAF}.0 / (least(high * {LEAF}, n_scenes) - low * {LEAF}) AS share FROM shapes WHERE high - low > 1),
pmf AS (SELECT p.*, n, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(share) + (n - k) * ln(1 - share)) AS w FROM (SELECT *, unnest(range(n_scenes + 1)) AS n FROM parts) p, LATERAL (SELECT unnest(range(p.n + 1)) AS k)),
cdfs AS (SELECT n_scenes, low, high, middle, n, list(c ORDER BY k) AS cdf FROM (SELECT *, sum(w) OVER (PARTITION BY n_scenes, low, high, n ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM pmf) GROUP BY ALL),
states AS (SELECT rseed, n_scenes, b, {mix(f"xor({mix(f'xor(rseed::UBIGINT, {START}::UBIGINT)')}, b::UBIGINT)")} AS h FROM scene_sets, range({n_boot}) r(b)),
tree AS (SELECT * FROM (WITH RECURSIVE t AS (SELECT rseed, n_scenes, b, h, CAST(0 AS BIGINT) AS low, CAST(ceil(n_scenes / {LEAF}.0) AS BIGINT) AS high, CAST(n_scenes AS BIGINT) AS n FROM states
 UNION ALL SELECT rseed, n_scenes, b, h, CASE WHEN side = 0 THEN low ELSE middle END, CASE WHEN side = 0 THEN middle ELSE high END, CASE WHEN side = 0 THEN k ELSE n - k END FROM
 (SELECT t.*, middle, least(CAST(len(list_filter(cdf, lambda x: x <= {_unit(_at('h', 't.low', 't.high'))})) AS BIGINT), t.n) AS k FROM t JOIN cdfs q ON q.n_scenes = t.n_scenes AND q.low = t.low AND q.high = t.high AND q.n = t.n WHERE t.high - t.low > 1) x, range(2) s(side))
 SELECT * FROM t WHERE high - low = 1)),
picks AS (SELECT rseed, n_scenes, b, low * {LEAF} + CAST(floor({_unit(mix('xor(g, j::UBIGINT)'))} * least({LEAF}, n_scenes - low * {LEAF})) AS BIGINT) AS drawn
 FROM (SELECT *, {_at('h', 'low', 'high')} AS g, unnest(range(n)) AS j FROM tree) t),
counted AS (SELECT rseed, n_scenes, b, drawn, count(*) AS times FROM picks GROUP BY ALL),
drawn AS (SELECT {c}b, scene_index, times FROM counted JOIN numbered USING (rseed, n_scenes, drawn))"""
