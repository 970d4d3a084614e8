"""ANSI/DuckDB SQL text for the oracle side of each registered query.

These strings restate each query relationally (long form, ``row_number``
for arg-min) so the check is independent of the Spark plan.  Literal
doubles are printed with 17 significant digits so both engines use the
same constants.
"""

from __future__ import annotations

from shapecode.config import SignalSpec
from shapecode.functions.arrays import taper_values
from shapecode.operators.kmeans import GRID, ITERATIONS


def dlit(x: float) -> str:
    return format(float(x), ".17E")


def dlist(values: list[float]) -> str:
    return "[" + ", ".join(dlit(v) for v in values) + "]::DOUBLE[]"


def lsum(arr: str) -> str:
    return f"list_reduce({arr}, lambda a, b: a + b)"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def samples_cte(spec: SignalSpec) -> str:
    order = ", ".join(spec.order_cols)
    return (
        f"SELECT CAST({spec.source_col} AS BIGINT) AS source_id, "
        f"CAST(row_number() OVER (PARTITION BY {spec.source_col} ORDER BY {order}) - 1 AS BIGINT) AS i, "
        f"CAST({spec.value_col} AS DOUBLE) AS raw, "
        f"CAST({spec.value_col} AS DOUBLE) * {dlit(spec.scale)} AS value "
        f"FROM {spec.table} WHERE {spec.source_col} IS NOT NULL AND {spec.value_col} IS NOT NULL"
    )


def frames_cte(spec: SignalSpec, samples: str = "samples") -> str:
    L = spec.frame_len
    return (
        f"SELECT source_id, CAST(i // {L} AS BIGINT) AS frame_no, CAST((i // {L}) * {L} AS BIGINT) AS frame_ref, "
        f"list(value ORDER BY i) AS frame FROM {samples} GROUP BY source_id, i // {L} HAVING count(*) = {L}"
    )


def windows_cte(spec: SignalSpec, frames: str = "frames") -> str:
    w, h = spec.w, spec.h
    return (
        f"SELECT source_id, frame_no, frame_ref, CAST(k AS INTEGER) AS k, frame[k * {h} + 1 : k * {h} + {w}] AS x "
        f"FROM (SELECT *, unnest(range(0, {spec.n_windows})) AS k FROM {frames})"
    )


def stats_cte(spec: SignalSpec, wins: str = "wins") -> str:
    return (
        f"SELECT *, {lsum('x')} / {spec.w} AS avg, "
        f"sqrt({lsum('list_transform(x, lambda v: v * v)')}) AS nrm FROM {wins}"
    )


def centered_feats_cte(spec: SignalSpec, stats: str = "wstats") -> str:
    t = dlist(taper_values(spec.w))
    return (
        f"SELECT *, CASE WHEN nrm = 0 THEN NULL ELSE "
        f"list_transform(range({spec.w}), lambda p: (x[p + 1] - avg) / nrm * ({t})[p + 1]) END AS feat "
        f"FROM {stats}"
    )


def tapered_feats_cte(spec: SignalSpec, stats: str = "wstats") -> str:
    t = dlist(taper_values(spec.w))
    tw = f"list_transform(range({spec.w}), lambda p: x[p + 1] * ({t})[p + 1])"
    return (
        f"SELECT *, CASE WHEN tnrm = 0 THEN NULL ELSE list_transform(tw, lambda v: v / tnrm) END AS feat FROM ("
        f"SELECT *, sqrt({lsum('list_transform(tw, lambda v: v * v)')}) AS tnrm FROM ("
        f"SELECT *, {tw} AS tw FROM {stats}))"
    )


def sqdist(a: str, b: str, w: int) -> str:
    return lsum(f"list_transform(range({w}), lambda p: ({a}[p + 1] - {b}[p + 1]) * ({a}[p + 1] - {b}[p + 1]))")


def nearest_cte(spec: SignalSpec, feats: str = "feats", book: str = "book") -> str:
    """Arg-min code per window, ties to the lowest code."""
    d = sqdist("f.feat", "b.center", spec.w)
    return (
        f"SELECT * EXCLUDE (rn) FROM (SELECT f.source_id, f.frame_no, f.k, b.code, b.center, {d} AS d, "
        f"row_number() OVER (PARTITION BY f.source_id, f.frame_no, f.k ORDER BY {d}, b.code) AS rn "
        f"FROM {feats} f JOIN {book} b ON f.source_id = b.source_id WHERE f.feat IS NOT NULL) WHERE rn = 1"
    )


def coded_ctes(spec: SignalSpec, mode: str = "centered") -> str:
    """CTE list (after samples/frames/wins/wstats/feats/book) ending in ``coded``."""
    w, h = spec.w, spec.h
    zeros = f"list_transform(range({w}), lambda p: CAST(0 AS DOUBLE))"
    if mode == "centered":
        seg = f"list_transform(range({h}), lambda p: (pr.cent[{h} + p + 1] + c.cent[p + 1]) * c.nrm + c.avg)"
    else:
        seg = f"list_transform(range({h}), lambda p: pr.cent[{h} + p + 1] * pr.tnrm + c.cent[p + 1] * c.tnrm)"
    return (
        f"nearest AS ({nearest_cte(spec)}), "
        f"cw AS (SELECT f.*, n.code, coalesce(n.center, {zeros}) AS cent FROM feats f "
        f"LEFT JOIN nearest n ON f.source_id = n.source_id AND f.frame_no = n.frame_no AND f.k = n.k), "
        f"seg AS (SELECT c.source_id, c.frame_no, c.k AS j, {seg} AS s FROM cw c JOIN cw pr "
        f"ON pr.source_id = c.source_id AND pr.frame_no = c.frame_no AND pr.k = c.k - 1), "
        f"coded AS (SELECT source_id, frame_no, flatten(list(s ORDER BY j)) AS coded FROM seg GROUP BY 1, 2), "
        f"codes AS (SELECT source_id, frame_no, string_agg(coalesce(CAST(code AS VARCHAR), '-'), ',' ORDER BY k) AS codes "
        f"FROM cw GROUP BY 1, 2)"
    )


def pipeline_prefix(spec: SignalSpec, mode: str = "centered", book_sql: str | None = None,
                    include_samples: bool = True) -> str:
    """``WITH samples, frames, wins, wstats, feats, book, nearest, cw, seg, coded, codes``."""
    feats = centered_feats_cte(spec) if mode == "centered" else tapered_feats_cte(spec)
    book_sql = book_sql or ("SELECT source_id, CAST(k AS INTEGER) AS code, feat AS center "
                            "FROM feats WHERE frame_no = 0 AND feat IS NOT NULL")
    head = f"WITH samples AS ({samples_cte(spec)}), " if include_samples else ""
    return (
        f"{head}frames AS ({frames_cte(spec)}), "
        f"wins AS ({windows_cte(spec)}), wstats AS ({stats_cte(spec)}), feats AS ({feats}), "
        f"book AS ({book_sql}), {coded_ctes(spec, mode)}"
    )


def trained_prefix(spec: SignalSpec, mode: str = "centered") -> str:
    """``pipeline_prefix`` with the dictionary trained on the first 20 % of each source (A13-A15), all iterations."""
    return ("WITH " + lloyd_ctes(spec, ITERATIONS) + ", " + pipeline_prefix(
        spec, mode, f"SELECT source_id, code, center FROM c{ITERATIONS}", include_samples=False))


def scores_select(spec: SignalSpec) -> str:
    """Scored frames from the ``pipeline_prefix`` CTEs (frames with a dictionary)."""
    m = spec.frame_len - spec.w
    return (
        f"SELECT f.source_id, f.frame_no, f.frame_ref, cs.codes, 'ok' AS status, "
        f"list_max(list_transform(range({m}), lambda p: abs(f.frame[{spec.h} + p + 1] - c.coded[p + 1]))) AS score, "
        f"{lsum('c.coded')} + 0.0 AS coded_sum "
        f"FROM frames f JOIN coded c USING (source_id, frame_no) JOIN codes cs USING (source_id, frame_no) "
        f"WHERE f.source_id IN (SELECT source_id FROM book)"
    )


def coded_arrays_select(spec: SignalSpec) -> str:
    """Per frame ``src``, ``coded``, ``loss`` arrays and ``score``."""
    m = spec.frame_len - spec.w
    return (
        f"SELECT source_id, frame_no, frame_ref, src, coded, loss, list_max(list_transform(loss, lambda v: abs(v))) AS score FROM ("
        f"SELECT *, list_transform(range({m}), lambda p: src[p + 1] - coded[p + 1]) AS loss FROM ("
        f"SELECT f.source_id, f.frame_no, f.frame_ref, f.frame[{spec.h + 1} : {spec.frame_len - spec.h}] AS src, c.coded "
        f"FROM frames f JOIN coded c USING (source_id, frame_no) WHERE f.source_id IN (SELECT source_id FROM book)))"
    )


def annotations_cte(spec: SignalSpec, code_expr: str) -> str:
    order = ", ".join(spec.order_cols)
    return (
        f"SELECT CAST({spec.source_col} AS BIGINT) AS record_id, "
        f"CAST(row_number() OVER (PARTITION BY {spec.source_col} ORDER BY {order}) - 1 AS BIGINT) AS line_no, "
        f"CAST(row_number() OVER (PARTITION BY {spec.source_col} ORDER BY {order}) - 1 AS BIGINT) AS sample, "
        f"{code_expr} AS code FROM {spec.table} WHERE {spec.source_col} IS NOT NULL AND {spec.value_col} IS NOT NULL"
    )


def labels_ctes(spec: SignalSpec, code_expr: str) -> str:
    """``ann, ext, fr, fcodes, labels`` CTEs."""
    L = spec.frame_len
    return (
        f"ann AS (SELECT * FROM ({annotations_cte(spec, code_expr)}) WHERE code IS NOT NULL), "
        f"ext AS (SELECT record_id, arg_max(sample, line_no) AS last_sample FROM ann GROUP BY 1), "
        f"fr AS (SELECT record_id, unnest(range(0, CAST(ceil(last_sample / {L}) AS BIGINT))) AS frame_no FROM ext), "
        f"fcodes AS (SELECT record_id, sample // {L} AS frame_no, string_agg(code, '' ORDER BY line_no) AS extra "
        f"FROM ann WHERE code <> 'N' GROUP BY 1, 2), "
        f"labels AS (SELECT fr.record_id, CAST(fr.frame_no * {L} AS BIGINT) AS frame_ref, 'N' || coalesce(fcodes.extra, '') AS label "
        f"FROM fr LEFT JOIN fcodes ON fr.record_id = fcodes.record_id AND fr.frame_no = fcodes.frame_no)"
    )


def budget_cte(spec: SignalSpec, samples: str = "samples") -> str:
    S = spec.step
    return (
        f"SELECT source_id, n_samples, max_w, tr, k, CAST(CASE WHEN tr > 0 THEN {spec.w} + (tr - 1) * {S} ELSE 0 END AS BIGINT) AS samples_used FROM ("
        f"SELECT *, CAST(floor({dlit(0.1)} * tr) AS BIGINT) AS k FROM ("
        f"SELECT *, CAST(floor({dlit(0.2)} * max_w) AS BIGINT) AS tr FROM ("
        f"SELECT source_id, CAST(count(*) AS BIGINT) AS n_samples, CAST(count(*) // {S} AS BIGINT) AS max_w FROM {samples} GROUP BY 1)))"
    )


def on_grid(arr: str) -> str:
    """Feature vector rounded to multiples of 1 / GRID."""
    return f"list_transform({arr}, lambda v: floor(v * CAST({GRID} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({GRID} AS DOUBLE))"


def lloyd_train_ctes(spec: SignalSpec) -> list[str]:
    """``samples, bud, sw, tw, ts, train``: the training windows of A15 with P7 + W5 features."""
    w, S = spec.w, spec.step
    t = dlist(taper_values(w))
    return [
        f"samples AS MATERIALIZED ({samples_cte(spec)})",
        f"bud AS MATERIALIZED ({budget_cte(spec)})",
        f"sw AS (SELECT source_id, i, list(value) OVER (PARTITION BY source_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS w FROM samples)",
        f"tw AS (SELECT sw.source_id, CAST(i // {S} AS BIGINT) AS j, w FROM sw JOIN bud USING (source_id) "
        f"WHERE i % {S} = 0 AND i // {S} < bud.tr AND len(w) = {w})",
        f"ts AS (SELECT *, {lsum('w')} / {w} AS a, sqrt({lsum('list_transform(w, lambda v: v * v)')}) AS n FROM tw)",
        f"train AS MATERIALIZED (SELECT source_id, j, CASE WHEN n = 0 THEN NULL ELSE "
        f"{on_grid(f'list_transform(range({w}), lambda p: (w[p + 1] - a) / n * ({t})[p + 1])')} END AS feat FROM ts)",
    ]


def lloyd_iter_ctes(w: int, iterations: int) -> list[str]:
    """``c0, a1, u1, c1, ...``: evenly spaced init and Lloyd iterations over ``train`` / ``bud``."""
    zeros = f"list_transform(range({w}), lambda p: CAST(0 AS DOUBLE))"
    parts = [
        f"c0 AS MATERIALIZED (SELECT source_id, CAST(c AS INTEGER) AS code, coalesce(feat, {zeros}) AS center FROM (SELECT t.*, b.tr, b.k, "
        "(t.j * b.k + b.tr - 1) // b.tr AS c FROM train t JOIN bud b USING (source_id) WHERE b.k > 0) WHERE c < k AND (c * tr) // k = j)",
    ]
    d = sqdist("t.feat", "c.center", w)
    for it in range(1, iterations + 1):
        prev = f"c{it - 1}"
        parts.append(
            f"a{it} AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT t.source_id, t.j, t.feat, c.code, {d} AS d, "
            f"row_number() OVER (PARTITION BY t.source_id, t.j ORDER BY {d}, c.code) AS rn "
            f"FROM train t JOIN {prev} c ON t.source_id = c.source_id WHERE t.feat IS NOT NULL) WHERE rn = 1)")
        parts.append(
            f"u{it} AS (SELECT source_id, code, list(v ORDER BY pos) AS center FROM ("
            f"SELECT source_id, code, pos, CAST(sum(CAST(feat[pos + 1] * {GRID} AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / CAST({GRID} AS DOUBLE) AS v FROM (SELECT *, unnest(range(0, {w})) AS pos FROM a{it}) "
            f"GROUP BY 1, 2, 3) GROUP BY 1, 2)")
        parts.append(
            f"c{it} AS MATERIALIZED (SELECT p.source_id, p.code, coalesce(u.center, p.center) AS center FROM {prev} p "
            f"LEFT JOIN u{it} u ON p.source_id = u.source_id AND p.code = u.code)")
    return parts


def lloyd_ctes(spec: SignalSpec, iterations: int) -> str:
    """``samples, bud, sw, tw, ts, train, c0, a1, c1, ... a{n}, c{n}`` CTEs (A13 oracle)."""
    return ", ".join(lloyd_train_ctes(spec) + lloyd_iter_ctes(spec.w, iterations))


def embedding_train_ctes() -> list[str]:
    """``train`` = embedding vectors per label ranked by ``vec_id``; ``bud`` with ``tr = n``, ``k = int(0.1 n)``."""
    return [
        "train AS (SELECT CAST(label AS BIGINT) AS source_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS j, "
        f"{on_grid('CAST(embedding AS DOUBLE[])')} AS feat FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)",
        f"bud AS (SELECT source_id, CAST(count(*) AS BIGINT) AS tr, CAST(floor({dlit(0.1)} * count(*)) AS BIGINT) AS k FROM train GROUP BY 1)",
    ]


def seeds_ctes(w: int, rounds: int, seed: str) -> str:
    """``s0, q1, n1, s1, ... , seeds``: the k-means|| draws over ``train`` / ``bud``."""
    def draw(r):
        return (f"((CAST('0x' || substr(md5('{seed}:{r}:' || CAST(t.source_id AS VARCHAR) || ':' || CAST(t.j AS VARCHAR)), 1, 13) AS BIGINT) + "
                f"CAST(0.5 AS DOUBLE)) / CAST({1 << 52} AS DOUBLE))")
    parts = [
        "ws AS MATERIALIZED (SELECT t.* FROM train t JOIN bud b USING (source_id) WHERE b.k > 0)",
        f"s0 AS MATERIALIZED (SELECT source_id, 0 AS code, j FROM (SELECT source_id, j, row_number() OVER (PARTITION BY source_id ORDER BY u, j) AS rn "
        f"FROM (SELECT t.source_id, t.j, {draw(0)} AS u FROM ws t WHERE feat IS NOT NULL)) WHERE rn = 1)"]
    d = sqdist("t.feat", "c.feat", w)
    for r in range(1, rounds + 1):
        parts += [
            f"q{r} AS MATERIALIZED (SELECT t.source_id, t.j, min(CAST(floor({d} * CAST({GRID} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS q "
            f"FROM ws t JOIN s{r - 1} s ON s.source_id = t.source_id JOIN ws c ON c.source_id = s.source_id AND c.j = s.j WHERE t.feat IS NOT NULL GROUP BY 1, 2)",
            f"n{r} AS (SELECT b.source_id, h.have, CAST(ceil(CAST(b.k - h.have AS DOUBLE) / {rounds - r + 1}) AS BIGINT) AS n, p.total FROM bud b "
            f"JOIN (SELECT source_id, count(*) AS have FROM s{r - 1} GROUP BY 1) h USING (source_id) "
            f"JOIN (SELECT source_id, sum(q) AS total FROM q{r} GROUP BY 1) p USING (source_id))",
            f"s{r} AS MATERIALIZED (SELECT * FROM s{r - 1} UNION ALL SELECT source_id, CAST(have + rank - 1 AS INTEGER), j FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY x, j) AS rank FROM ("
            f"SELECT t.source_id, t.j, n.have, n.n, {draw(r)} * CAST(n.total AS DOUBLE) / CAST(t.q AS DOUBLE) AS x FROM q{r} t JOIN n{r} n USING (source_id) "
            f"WHERE t.q > 0) WHERE x < 2 * n + 16) WHERE rank <= n)"]
    parts.append(
        f"seeds AS (SELECT * FROM s{rounds} UNION ALL SELECT source_id, CAST(have + rank - 1 AS INTEGER) AS code, j FROM ("
        f"SELECT t.source_id, t.j, l.k, l.have, row_number() OVER (PARTITION BY t.source_id ORDER BY {draw(rounds + 1)}, t.j) AS rank FROM ws t "
        f"JOIN (SELECT b.source_id, b.k, coalesce(h.have, 0) AS have FROM bud b LEFT JOIN (SELECT source_id, count(*) AS have FROM s{rounds} GROUP BY 1) h "
        f"USING (source_id) WHERE coalesce(h.have, 0) < b.k) l USING (source_id) LEFT JOIN s{rounds} s ON s.source_id = t.source_id AND s.j = t.j "
        f"WHERE s.j IS NULL) WHERE rank <= k - have)")
    return ", ".join(parts)


def event_times_ctes(spec: SignalSpec) -> str:
    """``t, t0``: the time of every frame's first sample, in microseconds."""
    return (f"t AS (SELECT CAST({spec.source_col} AS BIGINT) AS source_id, CAST(row_number() OVER (PARTITION BY {spec.source_col} "
            f"ORDER BY {', '.join(spec.order_cols)}) - 1 AS BIGINT) // {spec.frame_len} AS frame_no, epoch_us(ts) AS t_us FROM {spec.table} "
            f"WHERE {spec.source_col} IS NOT NULL AND {spec.value_col} IS NOT NULL), "
            "t0 AS (SELECT source_id, frame_no, min(t_us) AS t0 FROM t GROUP BY 1, 2) ")


def utc_path(us: str) -> str:
    """``yyyy/MM/dd/H/`` of microseconds."""
    ts = f"make_timestamp(CAST({us} AS BIGINT))"
    return f"strftime({ts}, '%Y/%m/%d/') || CAST(hour({ts}) AS VARCHAR) || '/'"


def number_text(x: str) -> str:
    """A double as Spark prints it: plain from 0.001 to below 10**7, else one digit, a fraction and ``E``."""
    short = f"CAST({x} AS VARCHAR)"
    sign, bare = f"CASE WHEN starts_with({short}, '-') THEN '-' ELSE '' END", f"ltrim({short}, '-')"
    zeros = f"(length(regexp_extract({bare}, '^0[.](0*)', 1)) + 1)"
    digits = f"regexp_replace({bare}, '^0[.]0*', '')"
    fraction = lambda d: f"coalesce(nullif(substr({d}, 2), ''), '0')"
    small = f"{sign} || substr({digits}, 1, 1) || '.' || {fraction(digits)} || 'E-' || {zeros}"
    mantissa, power = f"split_part({bare}, 'e', 1)", f"split_part({bare}, 'e', 2)"
    scientific = (f"{sign} || {mantissa} || CASE WHEN contains({mantissa}, '.') THEN '' ELSE '.0' END || 'E' || "
                  f"CAST(CAST(ltrim({power}, '+') AS INTEGER) AS VARCHAR)")
    return f"CASE WHEN contains({short}, 'e') THEN {scientific} WHEN {x} <> 0 AND abs({x}) < 0.001 THEN {small} ELSE {short} END"


def data_slice(src: str, coded: str, loss: str) -> str:
    """The first 60 characters of ``;src;coded;loss;``."""
    part = lambda a: f"array_to_string(list_transform({a}, lambda v: {number_text('v')}), ',')"
    return f"substr(';' || {part(src)} || ';' || {part(coded)} || ';' || {part(loss)} || ';', 1, 60)"
