"""DuckDB SQL for the named queries that SQL can express, written independently of them."""

from __future__ import annotations

SQL: dict[str, str] = {}

_V2 = "SELECT vec_id AS id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings"
_ALL = "SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _r(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


SQL["nn_centroid_assign"] = f"""
WITH e AS ({_ALL}), c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, v AS cv FROM e ORDER BY id LIMIT 10),
d AS (SELECT id, k, {_D2.format("v", "cv")} AS d2 FROM e, c)
SELECT id, arg_min(k, (d2, k)) AS label, {_r("min(d2)")} AS distance FROM d GROUP BY id"""

SQL["kmeans_update_step"] = f"""
WITH e AS ({_ALL}), c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, v AS cv FROM e ORDER BY id LIMIT 10),
d AS (SELECT id, any_value(v) AS v, arg_min(k, ({_D2.format("v", "cv")}, k)) AS label FROM e, c GROUP BY id),
x AS (SELECT label, (i - 1)::INT AS dim, v[i] AS x FROM d, range(1, 65) t(i))
SELECT label, count(*) AS n, dim, {_r("avg(x)")} AS x FROM x GROUP BY label, dim"""


def _assign(points: str, centres: str) -> str:
    return f"SELECT id, any_value(v) AS v, arg_min(k, ({_D2.format('v', 'cv')}, k)) AS label FROM {points}, {centres} GROUP BY id"


_MEAN = "[" + ", ".join(f"avg(v[{i}])" for i in range(1, 65)) + "]"


def _means(labelled: str, before: str) -> str:
    return f"SELECT b.k, coalesce(m.cv, b.cv) AS cv FROM {before} b LEFT JOIN (SELECT label, {_MEAN} AS cv FROM ({labelled}) GROUP BY label) m ON m.label = b.k"


def _kmeans(k: int, rounds: int) -> str:
    """CTEs c0..c<rounds> of centroids."""
    parts = [f"e AS ({_ALL})", f"c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS k, v AS cv FROM e ORDER BY id LIMIT {k})"]
    parts += [f"c{i + 1} AS ({_means(_assign('e', f'c{i}'), f'c{i}')})" for i in range(rounds)]
    return "WITH " + ", ".join(parts)


SQL["kmeans_changed"] = f"""
{_kmeans(5, 1)}
SELECT bool_or(a.label <> b.label) AS changed FROM ({_assign("e", "c0")}) a JOIN ({_assign("e", "c1")}) b USING (id)"""

SQL["kmeans_fit_3iter"] = f"""
{_kmeans(3, 3)}
SELECT k, (i - 1)::INT AS dim, {_r("cv[i]")} AS x FROM c3, range(1, 65) t(i)"""

SQL["sq_dist_pairs"] = f"WITH e AS ({_ALL}) SELECT a.id AS i, b.id AS j, {_r(_D2.format('a.v', 'b.v'))} AS d2 FROM e a, e b WHERE a.id < b.id"

SQL["vector_parts"] = f"""
SELECT id, {_r("sqrt(list_sum(list_transform(v, lambda x: x * x)))")} AS norm,
{_r("sqrt(list_sum(list_transform(v, lambda x: greatest(x, 0) ** 2)))")} AS positive,
{_r("sqrt(list_sum(list_transform(v, lambda x: greatest(-x, 0) ** 2)))")} AS negative,
{_r("list_sum(list_transform(v, lambda x: CASE WHEN x < 1e-10 THEN 0.0::DOUBLE ELSE x END))")} AS clamped FROM ({_ALL})"""

SQL["log_sum_exp"] = f"SELECT id, {_r('ln(list_sum(list_transform(range(1, 65), lambda i: i / 2080 * exp(v[i]))))')} AS lse FROM ({_ALL})"


SQL["adaptive_rates"] = f"""
WITH RECURSIVE r AS (SELECT id, v, 1 AS i, 100.0::DOUBLE AS rate, 0.0::DOUBLE AS bar FROM ({_ALL}) UNION ALL
SELECT id, v, i + 1, CASE WHEN v[i] * bar > 0 THEN rate + 100 WHEN v[i] * bar < 0 THEN rate * 0.5::DOUBLE ELSE rate END, 0.5::DOUBLE * v[i] + 0.5::DOUBLE * bar FROM r WHERE i <= len(v))
SELECT id, {_r("rate")} AS rate, {_r("bar")} AS bar FROM r WHERE i = len(v) + 1"""

_CODES = "translate(regexp_replace({0}, '[^ACGTacgt]', 'N', 'g'), 'ACGTacgtN', '012301234')"
_DNA = "regexp_replace(upper({0}), '[^ACGT]', '', 'g')"
SQL["seq_encode"] = f"SELECT item_id, {_CODES.format('text')} AS codes FROM benchmark"
SQL["seq_revcomp"] = f"""
WITH s AS (SELECT item_id, {_DNA.format("text")} AS s FROM benchmark)
SELECT item_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, reverse(translate(s, 'ACGT', '3210')) AS rc_codes, reverse(s[1:10]) || s[11:] AS prefix FROM s"""
SQL["match_scores"] = """
WITH s AS (SELECT doc_id, string_split(text, '') AS c FROM documents),
p AS (SELECT doc_id, list_transform(list_zip(c[1:len(c) - 1], c[2:]), lambda z: [CASE WHEN z[1] = z[2] THEN 1 ELSE -3 END,
CASE WHEN NOT regexp_matches(z[1], '^[ACGTacgt]$') OR NOT regexp_matches(z[2], '^[ACGTacgt]$') THEN 0 WHEN upper(z[1]) = upper(z[2]) THEN 1 ELSE -3 END]) AS x FROM s)
SELECT doc_id, coalesce(list_sum(list_transform(x, lambda y: y[1])), 0)::BIGINT AS score, coalesce(list_sum(list_transform(x, lambda y: y[2])), 0)::BIGINT AS coded FROM p"""


def _hash() -> str:
    m = "18446744073709551615::HUGEINT"
    x = "(o_orderkey::HUGEINT & " + m + ")"
    sql = f"SELECT o_orderkey, {x} AS x FROM orders"
    for kind, n in (("+~", 32), ("^", 22), ("+~", 13), ("^", 8), ("+", 3), ("^", 15), ("+~", 27), ("^", 31)):
        left = f"((x & ({m} // {2**n}::HUGEINT)) * {2**n}::HUGEINT)"
        step = f"xor(x, x // {2**n}::HUGEINT)" if kind == "^" else f"((x + ({m} - {left})) & {m})" if kind == "+~" else f"((x + {left}) & {m})"
        sql = f"SELECT o_orderkey, {step} AS x FROM ({sql})"
    return f"SELECT o_orderkey, (CASE WHEN x > 9223372036854775807 THEN x - 18446744073709551616::HUGEINT ELSE x END)::BIGINT AS hash FROM ({sql})"


SQL["hash64_keys"] = _hash()
SQL["sort_pairs"] = "SELECT o_orderkey - 1000 AS x, o_custkey AS y, row_number() OVER (ORDER BY (o_orderkey - 1000)::HUGEINT + CASE WHEN o_orderkey < 1000 THEN 18446744073709551616::HUGEINT ELSE 0 END, o_custkey) - 1 AS rank FROM orders"
SQL["kth_smallest"] = "SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET 1000"
SQL["top_k"] = "SELECT l_extendedprice, l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2, 3 LIMIT 25"
SQL["median_exact"] = f"SELECT l_returnflag, {_r('median(l_extendedprice)')} AS median FROM lineitem GROUP BY 1"

_NEXT = f"""n AS (SELECT a.item_id, {_DNA.format("a.text")} AS t, {_DNA.format("b.text")} AS q
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 WHERE length({_DNA.format("a.text")}) > 0 AND length({_DNA.format("b.text")}) > 0)"""


def _linear_score() -> str:
    """Rows of the matrix one after another; left gaps within a row by a running maximum (in closed form)."""
    top = "greatest(0, CASE WHEN q[j:j] = t[i + 1:i + 1] THEN 1 ELSE -3 END + h[j], h[j + 1] - 5)"
    row = f"list_transform(range(1, n + 1), lambda j: {top})"
    # H[j] = max over k <= j of top[k] - 5 (j - k)
    full = "list_transform(range(1, n + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: top[k] - 5 * (j - k))))"
    return f"""
WITH RECURSIVE {_NEXT}, walk AS (
  SELECT item_id, t, q, length(t) AS m, length(q) AS n, 0 AS i, list_transform(range(0, length(q) + 1), lambda j: 0::BIGINT) AS h, 0::BIGINT AS best FROM n
  UNION ALL
  SELECT item_id, t, q, m, n, i + 1, list_prepend(0::BIGINT, r), greatest(best, list_max(r))
  FROM (SELECT item_id, t, q, m, n, i, best, {full} AS r FROM (SELECT *, {row} AS top FROM walk WHERE i < m))
) SELECT item_id, max(best)::INT AS score FROM walk GROUP BY item_id"""


SQL["sw_linear_fold"] = _linear_score()


def _affine_score() -> str:
    base = "regexp_matches(q[j:j], '[ACGT]')"
    s = f"CASE WHEN NOT {base} THEN 0 WHEN q[j:j] = t[i + 1:i + 1] THEN 1 ELSE -3 END"
    top = f"list_transform(range(1, n + 1), lambda j: greatest(0, {s} + h[j], e[j]))"
    full = "list_transform(range(1, n + 1), lambda j: greatest(top[j], coalesce(list_max(list_transform(range(1, j), lambda k: top[k] - 5 - 2 * (j - k))), 0)))"
    return f"""
WITH RECURSIVE {_NEXT}, walk AS (
  SELECT item_id, t, q, length(t) AS m, length(q) AS n, 0 AS i, list_transform(range(0, length(q) + 1), lambda j: 0::BIGINT) AS h, list_transform(range(0, length(q)), lambda j: 0::BIGINT) AS e, 0::BIGINT AS best FROM n
  UNION ALL
  SELECT item_id, t, q, m, n, i + 1, list_prepend(0::BIGINT, r), list_transform(range(1, n + 1), lambda j: greatest(0, e[j] - 2, r[j] - 7)), greatest(best, list_max(r))
  FROM (SELECT item_id, t, q, m, n, i, e, best, {full} AS r FROM (SELECT *, {top} AS top FROM walk WHERE i < m))
) SELECT item_id, max(best)::INT AS score FROM walk GROUP BY item_id"""


SQL["sw_affine_score"] = _affine_score()


def _global_score() -> str:
    s = "CASE WHEN q[j:j] = t[i + 1:i + 1] THEN 1 ELSE -3 END"
    low = "-100000000::BIGINT"
    diag = f"list_transform(range(1, n + 1), lambda j: h[j] + {s})"
    full = f"list_transform(range(1, n + 1), lambda j: greatest(d[j], e[j], coalesce(list_max(list_transform(range(1, j), lambda k: d[k] - 5 - 2 * (j - k))), {low})))"
    return f"""
WITH RECURSIVE {_NEXT}, walk AS (
  SELECT item_id, t, q, length(t) AS m, length(q) AS n, 0 AS i, list_transform(range(0, length(q) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE -(5 + 2 * j) END::BIGINT) AS h, list_transform(range(0, length(q)), lambda j: {low}) AS e FROM n
  UNION ALL
  SELECT item_id, t, q, m, n, i + 1, list_prepend(-(5 + 2 * (i + 1))::BIGINT, r), list_transform(range(1, n + 1), lambda j: greatest(e[j] - 2, d[j] - 7))
  FROM (SELECT item_id, t, q, m, n, i, e, d, {full} AS r FROM (SELECT *, {diag} AS d FROM walk WHERE i < m))
) SELECT item_id, h[n + 1]::INT AS score FROM walk WHERE i = m"""


SQL["align_global_score"] = _global_score()

_M = f"""e AS ({_V2}), m AS (SELECT label AS k, count(*)::DOUBLE / (SELECT count(*) FROM e) AS pi, avg(a) AS m0, avg(b) AS m1,
covar_pop(a, a) AS c00, covar_pop(a, b) AS c01, covar_pop(b, b) AS c11 FROM e GROUP BY label)"""
_SIX = ", ".join(f"{_r(c)} AS {c}" for c in ("pi", "m0", "m1", "c00", "c01", "c11"))
SQL["gmm_mstep_labels"] = f"WITH {_M} SELECT k, {_SIX} FROM m"
_G = f"""{_M}, f AS (SELECT id, a, b, k, ln(pi) - 0.5 * (ln(c00 * c11 - c01 * c01) + 2 * ln(2 * pi()) +
(c11 * (a - m0) ** 2 - 2 * c01 * (a - m0) * (b - m1) + c00 * (b - m1) ** 2) / (c00 * c11 - c01 * c01)) AS l FROM e, m),
z AS (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM f), g AS (SELECT id, a, b, k, exp(l - top) / sum(exp(l - top)) OVER (PARTITION BY id) AS g, top, l FROM z)"""
SQL["gmm_estep_2d"] = f"WITH {_G} SELECT id, k, {_r('g')} AS g FROM g"
_LL = "ll AS (SELECT sum(x) AS ll FROM (SELECT max(top) + ln(sum(exp(l - top))) AS x FROM g GROUP BY id))"
SQL["gmm_loglik"] = f"WITH {_G}, {_LL} SELECT {_r('ll', 4)} AS loglik FROM ll"
SQL["gmm_ic"] = f"""WITH {_G}, {_LL}, n AS (SELECT count(*) AS n FROM e)
SELECT 'aic' AS criterion, {_r("59 * 2 - 2 * ll", 4)} AS ic FROM ll UNION ALL SELECT 'bic', {_r("59 * ln(n) - 2 * ll", 4)} FROM ll, n"""
SQL["gmm_em_1iter"] = f"""WITH {_G}, w AS (SELECT k, sum(g) AS n, sum(g * a) / sum(g) AS m0, sum(g * b) / sum(g) AS m1 FROM g GROUP BY k),
c AS (SELECT k, any_value(n) / (SELECT count(*) FROM e) AS pi, any_value(m0) AS m0, any_value(m1) AS m1, sum(g * (a - m0) ** 2) / any_value(n) AS c00,
sum(g * (a - m0) * (b - m1)) / any_value(n) AS c01, sum(g * (b - m1) ** 2) / any_value(n) AS c11 FROM g JOIN w USING (k) GROUP BY k)
SELECT k, {_SIX} FROM c"""
SQL["gmm_dump"] = f"""WITH {_G}, l AS (SELECT 'pi' AS part, k, NULL::BIGINT AS i, NULL::BIGINT AS j, pi AS x FROM m UNION ALL SELECT 'log_det', k, NULL, NULL, ln(c00 * c11 - c01 * c01) FROM m
UNION ALL SELECT 'mean', k, 0, NULL, m0 FROM m UNION ALL SELECT 'mean', k, 1, NULL, m1 FROM m UNION ALL SELECT 'cov', k, 0, 0, c00 FROM m UNION ALL SELECT 'cov', k, 0, 1, c01 FROM m
UNION ALL SELECT 'cov', k, 1, 0, c01 FROM m UNION ALL SELECT 'cov', k, 1, 1, c11 FROM m UNION ALL SELECT 'gamma', k, id, NULL, g FROM g WHERE g > 1e-5)
SELECT part, k::INT AS k, i, j, {_r("x")} AS x FROM l"""
# a component of up to 64 rows has no inverse; given tables have those, or some 200 rows each
SQL["gmm_mstep_all"] = f"""WITH e AS ({_ALL}), n AS (SELECT label AS k, count(*) AS n FROM e GROUP BY label),
m AS (SELECT label AS k, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) GROUP BY ALL),
c AS (SELECT label AS k, i, j, covar_pop(v[i], v[j]) AS c FROM e, range(1, 65) t(i), range(1, 65) u(j) GROUP BY ALL),
l AS (SELECT 'pi' AS part, k, NULL::BIGINT AS i, NULL::BIGINT AS j, n / (SELECT count(*) FROM e) AS x FROM n UNION ALL SELECT 'mean', k, i - 1, NULL, m FROM m
UNION ALL SELECT 'cov', k, i - 1, j - 1, CASE WHEN n > 64 THEN c WHEN i = j THEN 1 ELSE 0 END FROM c JOIN n USING (k))
SELECT part, k::INT AS k, i, j, {_r("x")} AS x FROM l"""
SQL["argmin_criterion"] = "SELECT k::INT AS k FROM (SELECT o_custkey % 50 AS k, count(*) AS ic FROM orders GROUP BY 1) ORDER BY ic, k LIMIT 1"

_P = f"""e AS ({_ALL}), h AS MATERIALIZED (SELECT a.id AS i, b.id AS j, exp(-{_D2.format("a.v", "b.v")} / (2 * 0.17::DOUBLE * 0.17::DOUBLE)) AS a FROM e a, e b WHERE a.id < b.id),
d AS (SELECT i, j, a FROM h UNION ALL SELECT j, i, a FROM h), t AS MATERIALIZED (SELECT i, sum(a) AS total FROM d GROUP BY i), c AS (SELECT i, j, a / total AS p FROM d JOIN t USING (i)),
o AS MATERIALIZED (SELECT h.i, h.j, (a / x.total + a / y.total) / (2 * (SELECT count(*) FROM e)) AS p FROM h JOIN t x ON x.i = h.i JOIN t y ON y.i = h.j), p AS (SELECT i, j, p FROM o UNION ALL SELECT j, i, p FROM o)"""
_Q = """y AS (SELECT id, v[1] AS a, v[2] AS b FROM e), s AS (SELECT x.id AS i, z.id AS j, (x.a - z.a) ** 2 + (x.b - z.b) ** 2 AS d2, x.a - z.a AS da, x.b - z.b AS db FROM y x, y z WHERE x.id <> z.id),
q AS (SELECT i, j, d2, da, db, (1 / (1 + d2)) / sum(1 / (1 + d2)) OVER () AS q FROM s)"""
SQL["tsne_affinity"] = f"WITH {_P} SELECT i, j, {_r('p * 1000')} AS p FROM p"
SQL["tsne_perplexity"] = f"WITH {_P} SELECT {_r('avg(x)')} AS perplexity FROM (SELECT pow(2, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)) AS x FROM c GROUP BY i)"
SQL["tsne_q"] = f"WITH e AS ({_ALL}), {_Q} SELECT i, j, {_r('q * 1000')} AS q FROM q"
SQL["tsne_kl"] = f"WITH {_P}, {_Q} SELECT {_r('sum(CASE WHEN p > 0 THEN p * (ln(p) - ln(q)) ELSE 0 END)')} AS kl FROM p JOIN q USING (i, j)"
SQL["tsne_gradient"] = f"WITH {_P}, {_Q} SELECT i, {_r('sum((p - q) * da / (1 + d2)) * 1000')} AS g0, {_r('sum((p - q) * db / (1 + d2)) * 1000')} AS g1 FROM p JOIN q USING (i, j) GROUP BY i"
SQL["tsne_sigma"] = f"""
WITH RECURSIVE e AS ({_ALL}), d AS (SELECT a.id AS i, {_D2.format("a.v", "b.v")} AS d2 FROM e a, e b WHERE a.id <> b.id),
l AS (SELECT i, list(d2) AS ds FROM d GROUP BY i), rows AS (SELECT list(ds) AS r FROM l),
b AS (
  SELECT 0 AS n, 1e-5::DOUBLE AS lo, 100.0::DOUBLE AS hi, 0.0::DOUBLE AS mid
  UNION ALL
  SELECT n + 1, CASE WHEN ppl > 10 THEN lo ELSE m END, CASE WHEN ppl > 10 THEN m ELSE hi END, m
  FROM (SELECT n, lo, hi, m, list_avg(list_transform(w, lambda x: pow(2, CASE WHEN list_sum(x) > 0 THEN log2(list_sum(x)) - list_sum(list_transform(x, lambda a: CASE WHEN a > 0 THEN a * log2(a) ELSE 0 END)) / list_sum(x) ELSE 0 END))) AS ppl
    FROM (SELECT n, lo, hi, (lo + hi) / 2 AS m, list_transform(r, lambda ds: list_transform(ds, lambda y: exp(-y / (2 * ((lo + hi) / 2) * ((lo + hi) / 2))))) AS w FROM b, rows WHERE hi - lo > 1e-7))
) SELECT round(mid, 5) AS sigma FROM b ORDER BY n DESC LIMIT 1"""

SQL["r1pca_residual"] = f"SELECT id, {_r('sqrt(list_sum(list_transform(v[3:], lambda x: x * x)))')} AS residual FROM ({_ALL})"
SQL["r1pca_weights"] = f"SELECT id, {_r('least(1, 0.9 / sqrt(list_sum(list_transform(v[3:], lambda x: x * x))))')} AS weight FROM ({_ALL})"
SQL["r1pca_gram"] = f"""
WITH e AS (SELECT v, least(1, 0.9::DOUBLE / sqrt(list_sum(list_transform(v[3:], lambda x: x * x)))) AS w FROM ({_ALL}))
SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, {_r("sum(w * v[i] * v[j])")} AS x FROM e, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL"""

_SOLD = """s AS (SELECT p_brand, c_mktsegment, sum(l_quantity) AS x FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
a AS (SELECT dense_rank() OVER (ORDER BY p_brand) - 1 AS i, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS j, x FROM s)"""
SQL["nmf_matrix"] = f"WITH {_SOLD} SELECT i, j, {_r('x')} AS x FROM a"
SQL["svd_rebuild"] = f"WITH {_SOLD} SELECT i, j, {_r('x', 3)} AS x FROM a"
SQL["matrix_product"] = f"WITH {_SOLD} SELECT l.i AS i, r.i AS j, {_r('sum(l.x * r.x)', 2)} AS x FROM a l JOIN a r ON l.j = r.j GROUP BY ALL"
SQL["matrix_elementwise"] = f"WITH {_SOLD} SELECT i, j, {_r('x * x / (x + 1)')} AS x FROM a"
_WH = f"""{_SOLD}, w AS (SELECT DISTINCT i, r, (1 + (i + r) % 3)::DOUBLE AS w FROM a, range(2) t(r)), h AS (SELECT DISTINCT j, r, (1 + (j + 2 * r) % 4)::DOUBLE AS h FROM a, range(2) t(r)),
atw AS (SELECT j, r, sum(x * w) AS p FROM a JOIN w USING (i) GROUP BY ALL), ah AS (SELECT i, r, sum(x * h) AS p FROM a JOIN h USING (j) GROUP BY ALL)"""
SQL["nmf_products"] = f"WITH {_WH} SELECT 'atw' AS side, j AS at, r::INT AS r, {_r('p', 4)} AS x FROM atw UNION ALL SELECT 'ah', i, r::INT, {_r('p', 4)} FROM ah"
SQL["nmf_update_step"] = f"""WITH {_WH}, ww AS (SELECT l.r AS r, k.r AS s, sum(l.w * k.w) AS g FROM w l JOIN w k USING (i) GROUP BY ALL),
hb AS (SELECT j, s AS r, sum(h * g) AS b FROM h JOIN ww USING (r) GROUP BY ALL), hn AS (SELECT j, r, h * p / b AS h FROM h JOIN atw USING (j, r) JOIN hb USING (j, r)),
hh AS (SELECT l.r AS r, k.r AS s, sum(l.h * k.h) AS g FROM hn l JOIN h k USING (j) GROUP BY ALL), wb AS (SELECT i, s AS r, sum(w * g) AS b FROM w JOIN hh USING (r) GROUP BY ALL)
SELECT 'w' AS side, i AS at, r::INT AS r, {_r("w * p / b", 4)} AS x FROM w JOIN ah USING (i, r) JOIN wb USING (i, r) UNION ALL SELECT 'h', j, r::INT, {_r("h", 4)} FROM hn"""
SQL["nmf_loss"] = f"WITH {_WH} SELECT round(sum((x - wh) ** 2), 0) AS loss FROM (SELECT i, j, sum(w * h) AS wh FROM w JOIN h USING (r) GROUP BY i, j) JOIN a USING (i, j)"
SQL["nmf_folds"] = f"WITH {_SOLD}, c AS (SELECT DISTINCT i FROM a), d AS (SELECT DISTINCT j FROM a) SELECT i, j, ((i * 31 + j * 17) % 10)::INT AS fold FROM c, d"
SQL["fasta_roundtrip"] = f"SELECT item_id::VARCHAR AS name, {_DNA.format('text')} AS seq FROM benchmark"
