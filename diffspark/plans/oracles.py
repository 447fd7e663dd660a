"""Plain SQL statements of the registered queries, for checking them on another engine.

They are written from the definitions (windows over whole groups, explicit series), not
from the distributed plans, and serve small data only.
"""

from __future__ import annotations

import math

# name -> (names it needs, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: str, text: str) -> None:
    VIEWS[name] = (tuple(needs.split()), text)


def sql(needs: str, body: str) -> str:
    """``body`` behind the views it needs, each listed once and after its own needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in VIEWS[name][0]:
                visit(other)
            order.append(name)

    for name in needs.split():
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _measurements(value: str) -> str:
    return f"""
    SELECT CAST(l_partkey AS VARCHAR) || ':' || p_brand AS identifier,
           l_returnflag AS condition,
           row_number() OVER (PARTITION BY l_partkey, l_returnflag
             ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS replicate,
           {value} AS y, regexp_matches(p_brand, '^Brand#[123]$') AS truth
    FROM lineitem JOIN part ON l_partkey = p_partkey"""


LIFTED = """CASE WHEN regexp_matches(p_brand, '^Brand#[123]$') AND l_returnflag = 'A'
            THEN 2 * l_extendedprice ELSE l_extendedprice END"""

_view("lin", "", _measurements(LIFTED))
_view("m", "", _measurements(f"log2({LIFTED})"))
_view("mv", "", _measurements(f"CASE WHEN l_discount <> 0 THEN log2({LIFTED}) END"))
_view("mvh", "", _measurements(f"CASE WHEN l_discount > 0.05 THEN log2({LIFTED}) END"))
_view(
    "s",
    "",
    """
    SELECT method, CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus AS identifier,
           o_orderpriority AS comparison, floor(o_totalprice / (5000 + 1000 * k)) / 100 AS score,
           500 - o_totalprice / 1000 + (o_custkey % 100) * k AS lfc, o_orderstatus = 'F' AS truth
    FROM orders, (VALUES (0, 'shrunk'), (1, 'ttest'), (2, 'posterior')) v(k, method)""",
)
_view(
    "contrasts",
    "",
    """SELECT * FROM (VALUES ('A', 'N', 'A vs N', 1), ('A', 'R', 'A vs R', 2),
       ('N', 'R', 'N vs R', 3)) c(ca, cb, comparison, ord)""",
)


def _cells(source: str) -> str:
    return f"""
    SELECT identifier, condition, count(y) AS n, avg(y) AS mean, var_pop(y) * count(y) AS ss
    FROM {source} GROUP BY identifier, condition"""


def _stats(cells: str) -> str:
    return f"""
    SELECT identifier, sum(n) AS n, sum(greatest(n - 1, 0)) AS df, sum(n * mean) / sum(n) AS mean,
           CASE WHEN sum(n) > 1 THEN sqrt((sum(ss) + sum(n * (mean - centre) ** 2)) / (sum(n) - 1)) END AS sd,
           CASE WHEN sum(greatest(n - 1, 0)) > 0
                THEN sqrt(sum(ss) / sum(greatest(n - 1, 0))) END AS sd_p
    FROM (SELECT *, sum(n * mean) OVER (PARTITION BY identifier)
                    / sum(n) OVER (PARTITION BY identifier) AS centre
          FROM {cells} WHERE n > 0)
    GROUP BY identifier"""


for _source in ("m", "mv", "mvh"):
    _view(f"cells_{_source}", _source, _cells(_source))
    _view(f"stats_{_source}", f"cells_{_source}", _stats(f"cells_{_source}"))


def _tstat(cells: str) -> str:
    return f"""
    SELECT a.identifier, c.comparison, c.ord, a.mean - b.mean AS lfc, a.n + b.n - 2 AS df,
           (a.mean - b.mean) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t
    FROM {cells} a JOIN contrasts c ON a.condition = c.ca
    JOIN {cells} b ON b.identifier = a.identifier AND b.condition = c.cb
    WHERE a.n > 1 AND b.n > 1"""


_view("tstat", "cells_m contrasts", _tstat("cells_m"))


def lgamma_step(z: str, h: str) -> str:
    """lgamma(z + h) - lgamma(z). Two large values of lgamma cancel (at z = 17,000 ten digits are
    left), so beyond 20 it is a difference of Stirling series, with ln(1 + h / z) from atanh."""
    tail = " ".join(
        f"{sign} (power({z} + {h}, -{k}) - power({z}, -{k})) / {d}.0"
        for sign, k, d in (("+", 1, 12), ("-", 3, 360), ("+", 5, 1260), ("-", 7, 1680))
    )
    series = f"({z} - 0.5) * 2 * atanh({h} / (2 * {z} + {h})) + {h} * ln({z} + {h}) - {h} {tail}"
    return f"(CASE WHEN {z} > 20 THEN {series} ELSE lgamma({z} + {h}) - lgamma({z}) END)"


def incomplete_beta(a: str, b: str, x: str, big: str, small: str, terms: int = 400) -> str:
    """Power series of I_x(a, b); callers keep x at or below 1/2 and tell which parameter may be large."""
    ratio = f"exp({lgamma_step(f'({a} + {b})', 'j')} - {lgamma_step(f'({a} + 1)', 'j')} + j * ln({x}))"
    ln_y = f"(-2 * atanh({x} / (2 - {x})))"
    front = f"exp({a} * ln({x}) + {b} * {ln_y} + {lgamma_step(big, small)} - lgamma({small})) / ({a})"
    return f"{front} * list_sum(list_transform(range({terms}), lambda j: {ratio}))"


def two_sided_t(t: str, df: str) -> str:
    """Two-sided tail of Student's t, from whichever side of the beta series converges."""
    x, y = f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))"
    a, b = f"({df} / 2.0)", "0.5"
    return f"""CASE WHEN {t} IS NULL THEN NULL WHEN {t} = 0 THEN 1.0
        WHEN {x} <= 0.5 THEN {incomplete_beta(a, b, x, a, b)}
        ELSE 1 - {incomplete_beta(b, a, y, a, b)} END"""


def two_sided_normal(z: str) -> str:
    """2 Phi(-|z|) by the all-positive series; below 1e-15 beyond 8."""
    w = f"least(abs({z}), 8.0)"
    term = (
        f"exp((2 * j + 1) * ln(greatest({w}, 1e-300)) - {w} * {w} / 2"
        f" - (j + 1) * ln(2.0) - lgamma(j + 1.5) + lgamma(0.5) - 0.5 * ln(2 * pi()))"
    )
    return f"(1 - 2 * list_sum(list_transform(range(160), lambda j: {term})))"


def bh(source: str, groups: str, p: str, keep: str) -> str:
    return f"""
    SELECT {keep}, least(1.0, min(raw) OVER (PARTITION BY {groups} ORDER BY {p} DESC)) AS q_val
    FROM (SELECT *, count(*) OVER (PARTITION BY {groups})
                 / count(*) OVER (PARTITION BY {groups} ORDER BY {p}) * {p} AS raw
          FROM {source} WHERE {p} IS NOT NULL)"""


ORACLES: dict[str, str] = {}


def _oracle(key: str, needs: str, body: str) -> None:
    ORACLES[key] = sql(needs, body)


# --- filters, scalar functions, reshape ----------------------------------------------

_oracle(
    "q_truth_count", "m", "SELECT truth, count(*) AS n FROM m GROUP BY truth"
)
_oracle(
    "q_all_null_filter",
    "mvh",
    """SELECT identifier, condition, replicate, round(y, 6) AS y FROM mvh
    WHERE (identifier, condition) IN (
        SELECT (identifier, condition) FROM mvh GROUP BY identifier, condition HAVING count(y) > 0)""",
)
_oracle(
    "q_complete_cases",
    "mv",
    """SELECT identifier, condition, replicate, round(y, 6) AS y FROM mv
    WHERE identifier IN (SELECT identifier FROM mv GROUP BY identifier HAVING count(y) = count(*))""",
)
_oracle(
    "q_membership",
    "",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[123]$'))""",
)
_oracle(
    "q_zero_to_null",
    "",
    """SELECT l_orderkey, l_linenumber, nullif(l_extendedprice, 0) AS l_extendedprice,
    nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem""",
)
_oracle(
    "q_unlog",
    "",
    "SELECT p_partkey, pow(2.0, p_size) AS p_size, p_retailprice FROM part",
)
WIDE = "SELECT identifier, comparison, {} FROM s GROUP BY identifier, comparison"
PIVOTED = WIDE.format(
    ", ".join(f"max(CASE WHEN method = '{m}' THEN score END) AS {m}" for m in ("shrunk", "ttest", "posterior"))
)
_oracle("q_pivot", "s", PIVOTED)
_oracle("q_unpivot", "s", "SELECT identifier, comparison, method, score FROM s")
_oracle(
    "q_join_methods",
    "s",
    """SELECT a.identifier, a.comparison, CASE WHEN a.lfc > 0 THEN a.score END AS shrunk,
    CASE WHEN t.lfc > 100 THEN t.score END AS ttest, CASE WHEN p.lfc > 200 THEN p.score END AS posterior
    FROM (SELECT * FROM s WHERE method = 'shrunk') a
    LEFT JOIN (SELECT * FROM s WHERE method = 'ttest') t USING (identifier, comparison)
    LEFT JOIN (SELECT * FROM s WHERE method = 'posterior') p USING (identifier, comparison)""",
)
_oracle(
    "q_clean_headers",
    "",
    """SELECT header, CASE p WHEN 'price' THEN price WHEN 'size' THEN size ELSE key END AS total
    FROM (SELECT round(sum(p_retailprice), 2) AS price, round(sum(p_size), 2) AS size,
      round(CAST(sum(p_partkey) AS DOUBLE), 2) AS key FROM part),
      (VALUES ('retail_price_usd', 'price'), ('retail_price_usd_2', 'price'), ('size_percent', 'size'),
        ('x2nd_size', 'size'), ('um_a', 'size'), ('part_number_key', 'key')) v(header, p)""",
)
_oracle(
    "q_renamed_samples",
    "lin",
    """SELECT i.identifier, cond AS condition, CAST(v.r AS BIGINT) AS replicate, round(avg(y), 6) AS y
    FROM (SELECT DISTINCT identifier FROM lin) i
    CROSS JOIN (VALUES ('A', 'first'), ('R', 'third')) c(flag, cond) CROSS JOIN (VALUES (1), (2)) v(r)
    LEFT JOIN (SELECT *, (replicate - 1) % 3 + 1 AS r FROM lin) l
      ON l.identifier = i.identifier AND l.condition = flag AND l.r = v.r
    GROUP BY i.identifier, cond, v.r""",
)
_oracle(
    "q_text_scan",
    "",
    """SELECT format, l_returnflag, count(*) AS n, count(nullif(l_tax, 0)) AS taxed,
    round(sum(l_extendedprice), 2) AS total FROM lineitem, (VALUES ('tab'), ('comma')) f(format)
    GROUP BY format, l_returnflag""",
)
_oracle(
    "q_text_rejects",
    "",
    """SELECT l_returnflag AS what, count(*) AS n, count(nullif(l_tax, 0)) AS taxed,
    round(sum(CASE WHEN l_linenumber <> 7 THEN l_extendedprice END), 2) AS total
    FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'l_extendedprice', count(*), NULL, NULL FROM lineitem WHERE l_linenumber = 7
    HAVING count(*) > 0""",
)
_oracle(
    "q_interrupted_write",
    "s",
    """SELECT read, method, count(*) AS n, count(*) FILTER (truth) AS n_true, max(score) AS top
    FROM s, (VALUES ('first'), ('again'), ('saved')) r(read) GROUP BY read, method""",
)
_oracle(
    "q_stage_reload",
    "s",
    "SELECT method AS dataset, count(*) AS n, max(score) AS top FROM s GROUP BY method",
)
_oracle(
    "q_wide_ingest",
    "lin",
    """SELECT i.identifier, 'condi' || k AS condition, CAST(r AS BIGINT) AS replicate,
    round(CASE r WHEN 1 THEN max(y) ELSE min(y) END, 6) AS y
    FROM (SELECT DISTINCT identifier FROM lin) i
    CROSS JOIN (VALUES (1, 'A'), (2, 'N'), (3, 'R')) c(k, cond) CROSS JOIN (VALUES (1), (2)) v(r)
    LEFT JOIN lin ON lin.identifier = i.identifier AND lin.condition = cond
    GROUP BY i.identifier, k, r""",
)
_oracle(
    "q_group_value",
    "m",
    """SELECT identifier, condition, replicate, n FROM m
    JOIN (SELECT identifier, count(*) AS n FROM m GROUP BY identifier) USING (identifier)""",
)
_oracle(
    "q_first_comparison",
    "tstat",
    "SELECT identifier, comparison, round(t, 6) AS t FROM tstat WHERE ord = 1",
)
_oracle(
    "q_separate_unite",
    "",
    """SELECT o_orderkey, 'Single-Imputation' AS imputation, split_part(o_orderpriority, '-', 2) AS method,
    o_orderstatus || '-' || split_part(o_orderpriority, '-', 1) AS cls_prd FROM orders""",
)
_oracle(
    "q_regex_labels",
    "",
    """SELECT p_partkey, regexp_replace(regexp_replace(p_name, 'red', 'RED', 'g'), 'blue', 'BLUE', 'g') AS every,
    regexp_replace(p_brand, '[0-9]', 'n') AS first_only, regexp_replace(p_brand, 'Brand#', '', 'g') AS removed,
    p_brand || '_' || p_size AS joined, round(sqrt(abs(p_retailprice)), 1) AS root FROM part""",
)
_oracle(
    "q_pair_canonical",
    "",
    """SELECT o_orderkey, CASE WHEN turned THEN n[r + 1] || ' vs ' || n[l + 1] ELSE n[l + 1] || ' vs ' || n[r + 1] END
      AS comparison, CASE WHEN turned THEN -o_totalprice ELSE o_totalprice END AS lfc
    FROM (SELECT *, r < l AND l < 3 AS turned FROM (
      SELECT *, o_orderkey % 4 AS l, (o_orderkey % 4 + 1 + o_custkey % 3) % 4 AS r,
        ['ng50', 'ng100', 'fmol25', 'fmol100'] AS n FROM orders))""",
)
_oracle(
    "q_order_dimension",
    "",
    """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
    WHEN '3-MEDIUM' THEN CAST(3 AS BIGINT) END AS level FROM orders""",
)
_oracle(
    "q_infreq",
    "",
    """SELECT o_orderpriority, n, row_number() OVER (ORDER BY n DESC, o_orderpriority) AS level
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority)""",
)
_oracle(
    "q_left_join_fill",
    "",
    """SELECT doc_id, cls, dense_rank() OVER (ORDER BY n DESC, cls) AS level FROM (
      SELECT *, count(*) OVER (PARTITION BY cls) AS n FROM (
        SELECT d.doc_id, coalesce('q' || l.quality, 'Discarded') AS cls
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))""",
)
_oracle(
    "q_crosstab",
    "",
    """SELECT quality, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1"
    FROM labels GROUP BY quality""",
)
_oracle("q_nest_unnest", "s", "SELECT identifier, comparison, method, score, lfc FROM s")
_oracle(
    "q_contrasts",
    "m",
    """SELECT x.condition || ' vs ' || y.condition AS comparison, x.condition AS cond_a, y.condition AS cond_b,
    x.r AS n_a, y.r AS n_b
    FROM (SELECT condition, count(DISTINCT replicate) AS r FROM m GROUP BY condition) x,
         (SELECT condition, count(DISTINCT replicate) AS r FROM m GROUP BY condition) y
    WHERE strpos('RAN', x.condition) < strpos('RAN', y.condition)""",
)
_oracle(
    "q_design_matrix",
    "m",
    "SELECT "
    + ", ".join(f"count(DISTINCT replicate) FILTER (condition = '{c}') AS \"n_{c}\"" for c in "ANR")
    + " FROM m",
)
_oracle(
    "q_contrast_matrix",
    "m contrasts",
    "SELECT condition, "
    + ", ".join(
        f"CAST(max(CASE WHEN comparison = '{v}' THEN CASE condition WHEN ca THEN 1 WHEN cb THEN -1 ELSE 0 END END) AS INTEGER) AS \"{v}\""
        for v in ("A vs N", "A vs R", "N vs R")
    )
    + " FROM (SELECT DISTINCT condition FROM m), contrasts GROUP BY condition",
)
_oracle(
    "q_pairwise_complete",
    "cells_mvh",
    """SELECT a.identifier, round(a.mean, 6) AS a, round(b.mean, 6) AS b FROM cells_mvh a
    JOIN cells_mvh b ON a.identifier = b.identifier AND a.condition = 'A' AND b.condition = 'N'
    WHERE a.mean IS NOT NULL AND b.mean IS NOT NULL""",
)

# --- moments, normalisation, tests -----------------------------------------------------

_oracle(
    "q_condition_moments",
    "cells_mv",
    """SELECT identifier, condition, n, round(mean, 6) AS mean, round(sqrt(ss / nullif(n, 0)), 6) AS sd
    FROM cells_mv""",
)
_oracle(
    "q_row_stats",
    "stats_mv",
    """SELECT identifier, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd_p, 6) AS sd_p FROM stats_mv""",
)
_oracle(
    "q_lfc",
    "cells_mvh contrasts",
    """SELECT i.identifier, c.comparison, round(a.mean - b.mean, 6) AS lfc
    FROM (SELECT DISTINCT identifier FROM cells_mvh) i CROSS JOIN contrasts c
    LEFT JOIN cells_mvh a ON a.identifier = i.identifier AND a.condition = c.ca
    LEFT JOIN cells_mvh b ON b.identifier = i.identifier AND b.condition = c.cb""",
)
_view("mb", "lin", "SELECT identifier, condition AS sample, avg(y) AS y FROM lin GROUP BY ALL")
_oracle(
    "q_psrn",
    "mb",
    """SELECT identifier, sample, round(log2(y / size), 6) AS y FROM mb JOIN (
      SELECT sample, median(exp(ln(y) - level)) AS size FROM mb JOIN (
        SELECT identifier, avg(ln(y)) AS level FROM mb GROUP BY identifier HAVING count(*) = 3)
      USING (identifier) GROUP BY sample) USING (sample)""",
)
_view(
    "matrix",
    "lin",
    """SELECT i.identifier, cond AS condition, r.r AS replicate, avg(y) AS y
    FROM (SELECT DISTINCT identifier FROM lin) i CROSS JOIN (VALUES ('A'), ('N'), ('R')) c(cond)
    CROSS JOIN (VALUES (1), (2), (3)) r(r)
    LEFT JOIN (SELECT *, (replicate - 1) % 3 + 1 AS k FROM lin) l
      ON l.identifier = i.identifier AND l.condition = cond AND l.k = r.r
    GROUP BY i.identifier, cond, r.r""",
)
_oracle(
    "q_psrn_wide",
    "matrix",
    """SELECT identifier, condition, CAST(replicate AS BIGINT) AS replicate, round(log2(y / size), 6) AS y
    FROM matrix JOIN (
      SELECT condition, replicate, median(exp(ln(y) - level)) AS size FROM matrix JOIN (
        SELECT identifier, avg(ln(y)) AS level FROM matrix GROUP BY identifier HAVING count(y) = 9)
      USING (identifier) GROUP BY condition, replicate) USING (condition, replicate)""",
)
_oracle(
    "q_psrn_human",
    "",
    """WITH seen AS (
      SELECT CAST(l_suppkey AS VARCHAR) AS identifier, l_returnflag AS condition,
        l_orderkey % 23 + 1 AS replicate, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL
    ), sizes AS (
      SELECT condition, replicate, median(exp(ln(y) - level)) AS size FROM seen JOIN (
        SELECT identifier, avg(ln(y)) AS level FROM seen GROUP BY identifier HAVING count(y) = 69)
      USING (identifier) GROUP BY condition, replicate)
    SELECT i.identifier, f.condition, CAST(r.replicate AS BIGINT) AS replicate, round(log2(y / size), 6) AS y
    FROM (SELECT DISTINCT identifier FROM seen) i
    CROSS JOIN (VALUES ('A'), ('N'), ('R')) f(condition) CROSS JOIN range(1, 24) r(replicate)
    LEFT JOIN seen USING (identifier, condition, replicate) LEFT JOIN sizes USING (condition, replicate)""",
)
_view(
    "nine",
    "",
    """SELECT CAST(l_suppkey AS VARCHAR) AS identifier, 'condi' || (l_orderkey % 9 + 1) AS condition,
      log2(l_extendedprice) AS y FROM lineitem""",
)
_view("cells_nine", "nine", _cells("nine"))
_view(
    "contrasts_nine",
    "",
    """SELECT 'condi' || a AS ca, 'condi' || b AS cb, 'condi' || a || ' vs condi' || b AS comparison
    FROM range(1, 10) x(a), range(1, 10) y(b) WHERE a < b""",
)
_view(
    "t_nine",
    "cells_nine contrasts_nine",
    """SELECT a.identifier, c.comparison, a.mean - b.mean AS lfc, a.n + b.n - 2 AS df,
       (a.mean - b.mean) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t
    FROM cells_nine a JOIN contrasts_nine c ON a.condition = c.ca
    JOIN cells_nine b ON b.identifier = a.identifier AND b.condition = c.cb
    WHERE a.n > 1 AND b.n > 1""",
)
_oracle(
    "q_ttest_ramus",
    "t_nine",
    f"SELECT identifier, comparison, round({two_sided_t('t', 'df')}, 6) AS p_val, round(lfc, 6) AS lfc FROM t_nine",
)
_oracle(
    "q_tstat",
    "tstat",
    """SELECT identifier, comparison, round(t, 6) AS t, CAST(df AS DOUBLE) AS df, round(lfc, 6) AS lfc FROM tstat""",
)
_view("tp", "tstat", f"SELECT *, {two_sided_t('t', 'df')} AS p FROM tstat")
_oracle(
    "q_ttest_p",
    "tp",
    "SELECT identifier, comparison, round(p, 6) AS p_val, round(lfc, 6) AS lfc FROM tp",
)
_oracle(
    "q_ttest_fdr",
    "tp",
    f"""SELECT identifier, comparison, round(q_val, 6) AS p_val, round(lfc, 6) AS lfc
    FROM ({bh('tp', 'comparison', 'p', 'identifier, comparison, lfc')})""",
)
_oracle(
    "q_bh",
    "s",
    f"""SELECT method, identifier, comparison, round(q_val, 9) AS q_val
    FROM ({bh('s', 'method, comparison', 'score', 'method, identifier, comparison')})""",
)
_oracle(
    "q_binom_tail",
    "m",
    f"""SELECT identifier, k, n, round(CASE WHEN k = 0 THEN 1.0
      ELSE {incomplete_beta('k', '(n - k + 1)', '0.5', 'k', '(n - k + 1)')} END, 9) AS binom_p_value
    FROM (SELECT identifier, count(*) AS n, count(*) FILTER (condition = 'A') AS k FROM m GROUP BY identifier)""",
)


# --- confusion, rates, areas ---------------------------------------------------------------

# Thresholds added to the observed scores.
STRICT_EXTRA = "(1.1)"
WITHIN_EXTRA = "(-0.1)"
BETWEEN_EXTRA = "(-0.1), (0.0)"


def confusion(source: str, groups: str, mode: str, extra: str, score: str = "score") -> str:
    """Cells by direct comparison of every threshold with every distinct score."""
    lt, gt = ("<", ">") if mode == "strict" else ("<=", ">=")
    on = " AND ".join(f"h.{g} = g.{g}" for g in groups.split(", "))
    cols = ", ".join(f"g.{g}" for g in groups.split(", "))
    return f"""
    SELECT {cols}, g.alpha,
      CAST(coalesce(sum(h.pos) FILTER (h.v {lt} g.alpha), 0) AS BIGINT) AS "TP",
      CAST(coalesce(sum(h.neg) FILTER (h.v {gt} g.alpha), 0) AS BIGINT) AS "TN",
      CAST(coalesce(sum(h.neg) FILTER (h.v {lt} g.alpha), 0) AS BIGINT) AS "FP",
      CAST(coalesce(sum(h.pos) FILTER (h.v {gt} g.alpha), 0) AS BIGINT) AS "FN",
      CAST(sum(h.pos) AS DOUBLE) AS p_all, CAST(sum(h.neg) AS DOUBLE) AS n_all
    FROM (SELECT DISTINCT {groups}, {score} AS alpha FROM {source} WHERE {score} IS NOT NULL
          UNION SELECT DISTINCT {groups}, CAST(x AS DOUBLE) FROM {source}, (VALUES {extra}) e(x)) g
    JOIN (SELECT {groups}, {score} AS v, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg
          FROM {source} GROUP BY {groups}, {score}) h ON {on}
    GROUP BY {cols}, g.alpha"""


def rates(source: str, groups: str) -> str:
    """Rates of a confusion table with totals p_all and n_all."""
    return f"""
    SELECT *, CASE WHEN "TPR" IS NOT NULL THEN
        sqrt("precision") * sqrt("TPR") * sqrt(1 - "FPR") * sqrt("NPV")
        - sqrt(1 - "precision") * sqrt(1 - "TPR") * sqrt("FPR") * sqrt(1 - "NPV") END AS "MCC",
      (CAST("TP" AS DOUBLE) * "TN" - CAST("FP" AS DOUBLE) * "FN") / nullif(sqrt(
        CAST("TP" + "FP" AS DOUBLE) * ("TP" + "FN") * ("TN" + "FP") * ("TN" + "FN")), 0) AS "MCC2"
    FROM (SELECT {groups}, alpha, "TP", "TN", "FP", "FN",
        "TP" / nullif(p_all, 0) AS "TPR", "FP" / nullif(n_all, 0) AS "FPR",
        CAST("TN" AS DOUBLE) / nullif("TN" + "FN", 0) AS "NPV",
        CAST("TP" AS DOUBLE) / nullif("TP" + "FP", 0) AS "precision",
        ("TP" + "TN") / nullif(p_all + n_all, 0) AS accuracy FROM {source})"""


def area(source: str, groups: str) -> str:
    return f"""
    SELECT {groups}, coalesce(sum((x - px) * (y + py) / 2), 0.0) AS "auROC" FROM (
      SELECT {groups}, "FPR" AS x, "TPR" AS y,
        lag("FPR") OVER w AS px, lag("TPR") OVER w AS py
      FROM {source} WHERE "FPR" IS NOT NULL AND "TPR" IS NOT NULL
      WINDOW w AS (PARTITION BY {groups} ORDER BY "FPR", "TPR"))
    GROUP BY {groups}"""


def show(columns: str, digits: int = 9) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns.split())


RATES = "TPR FPR NPV precision accuracy MCC MCC2"
MC = "method, comparison"

_view("c_strict", "s", confusion("s", MC, "strict", STRICT_EXTRA))
_view("c_within", "s", confusion("s", MC, "inclusive", WITHIN_EXTRA))
_view(
    "c_between",
    "s",
    f"""SELECT c.* EXCLUDE (p_all, n_all), t.p_all, t.n_all
    FROM ({confusion('s', MC, 'inclusive', BETWEEN_EXTRA)}) c JOIN (
      SELECT method, CAST(count(DISTINCT identifier) FILTER (truth) AS DOUBLE) AS p_all,
             CAST(count(DISTINCT identifier) FILTER (NOT truth) AS DOUBLE) AS n_all
      FROM s GROUP BY method) t USING (method)""",
)
for _name in ("strict", "within", "between"):
    _view(f"r_{_name}", f"c_{_name}", rates(f"c_{_name}", MC))

_oracle(
    "q_confusion_strict", "c_strict", f'SELECT {MC}, alpha, "TP", "TN", "FP", "FN" FROM c_strict'
)
_oracle(
    "q_confusion_inclusive", "c_within", f'SELECT {MC}, alpha, "TP", "TN", "FP", "FN" FROM c_within'
)
_oracle(
    "q_rates_mcc", "r_strict", f'SELECT {MC}, alpha, "TP", "TN", "FP", "FN", {show(RATES)} FROM r_strict'
)
_oracle(
    "q_pn_global", "r_between", f'SELECT {MC}, alpha, "TP", "TN", "FP", "FN", {show(RATES)} FROM r_between'
)
_view("a_strict", "r_strict", area("r_strict", MC))
_oracle("q_auroc_scores", "a_strict", f"SELECT {MC}, {show('auROC')} FROM a_strict")
_view("tscore", "tstat", "SELECT identifier, comparison, round(-abs(t), 6) AS score, regexp_matches(identifier, ':Brand#[123]$') AS truth FROM tstat")
_view("c_t", "tscore", confusion("tscore", "comparison", "strict", STRICT_EXTRA))
_view("r_t", "c_t", rates("c_t", "comparison"))
_oracle("q_auroc", "r_t", f"SELECT comparison, {show('auROC')} FROM ({area('r_t', 'comparison')})")
_oracle(
    "q_auroc_label_pos",
    "a_strict",
    f"""SELECT {MC}, {show('auROC')}, round(0.1 + CASE WHEN n > 1 THEN (i - 1) * 0.88 / (n - 1) ELSE 0 END, 9) AS "FPR",
      CAST(0 AS DOUBLE) AS "TPR"
    FROM (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY round("auROC", 9) DESC, method) AS i,
      count(*) OVER (PARTITION BY comparison) AS n FROM a_strict)""",
)
_oracle(
    "q_decomposed",
    "r_strict",
    f"""SELECT comparison, method, alpha, CASE name WHEN 'precision' THEN 'Precision'
        WHEN 'FPR' THEN 'False Positive Rate' ELSE 'True Positive Rate' END AS name,
      round(CASE name WHEN 'TPR' THEN "TPR" WHEN 'FPR' THEN "FPR" ELSE "precision" END, 9) AS value,
      round(CASE WHEN name = 'precision' THEN share ELSE 0 END, 9) AS intercept,
      CAST(CASE WHEN name = 'precision' THEN 0 ELSE 1 END AS DOUBLE) AS slope
    FROM r_strict, (VALUES ('TPR'), ('FPR'), ('precision')) v(name),
      (SELECT avg(CASE WHEN truth THEN 1.0 ELSE 0.0 END) AS share FROM s)""",
)
_oracle(
    "q_alpha_between",
    "r_strict",
    f"""SELECT comparison, method, alpha, name, CAST(CASE name WHEN 'TP' THEN "TP" WHEN 'FP' THEN "FP" ELSE round("precision", 9) END AS DOUBLE) AS value
    FROM r_strict, (VALUES ('TP'), ('FP'), ('precision')) v(name) WHERE alpha BETWEEN 0 AND 0.2""",
)
_view(
    "r_all",
    "r_strict r_within",
    """SELECT 'first' AS dataset, comparison, method, alpha, "TPR", "FPR", "NPV", "precision", accuracy, "MCC", "MCC2" FROM r_strict
    UNION ALL SELECT 'second', comparison, method, alpha, "TPR", "FPR", "NPV", "precision", NULL, "MCC", NULL FROM r_within""",
)
_oracle("q_union_fill", "r_all", f"SELECT dataset, comparison, method, alpha, {show(RATES)} FROM r_all")
_view(
    "top_all",
    "r_all",
    """SELECT dataset, comparison, method, alpha, name,
      CASE name WHEN 'TPR' THEN "TPR" WHEN 'FPR' THEN "FPR" WHEN 'precision' THEN "precision"
           WHEN 'accuracy' THEN accuracy ELSE "MCC" END AS value
    FROM (SELECT *, rank() OVER (PARTITION BY dataset, comparison, method ORDER BY alpha DESC) AS rk
          FROM r_all WHERE alpha <= 0.05),
      (VALUES ('TPR'), ('FPR'), ('precision'), ('accuracy'), ('MCC')) v(name) WHERE rk = 1""",
)
_oracle(
    "q_slice_max",
    "s",
    """SELECT method, identifier, comparison, score FROM (
      SELECT *, rank() OVER (PARTITION BY method, comparison ORDER BY score DESC) AS rk FROM s) WHERE rk = 1""",
)
_oracle(
    "q_method_summary",
    "top_all",
    """SELECT name, dataset, CASE method WHEN 'shrunk' THEN 'Shrunk' ELSE method END AS method,
    round(avg(value), 9) AS mean FROM top_all GROUP BY ALL""",
)
_oracle(
    "q_thin",
    "",
    """SELECT round(alpha, 9) AS alpha FROM (
      SELECT alpha, row_number() OVER (ORDER BY alpha) AS i, count(*) OVER () AS n
      FROM (SELECT DISTINCT (o_totalprice + 1) / 500001 AS alpha FROM orders))
    WHERE n <= 1000 OR i IN (SELECT 1 + (k * ((SELECT count(DISTINCT (o_totalprice + 1) / 500001) FROM orders) - 1)) // 999
                            FROM range(1000) r(k))""",
)

# --- weights and ensemble --------------------------------------------------------------------


def average_rank(expr: str, groups: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {groups} ORDER BY {expr}) "
        f"+ (count(*) OVER (PARTITION BY {groups}, {expr}) - 1) / 2)"
    )


_view(
    "weights",
    "s",
    f"""SELECT method, comparison, rho, CASE WHEN sum(u) OVER w > 0 THEN u / sum(u) OVER w
      ELSE 1.0 / count(*) OVER w END AS weight
    FROM (SELECT *, greatest(-coalesce(rho, 0), 0) AS u FROM (
      SELECT method, comparison, corr(rs, rf) AS rho FROM (
        SELECT method, comparison, {average_rank('abs(score)', MC)} AS rs, {average_rank('abs(lfc)', MC)} AS rf FROM s)
      GROUP BY method, comparison))
    WINDOW w AS (PARTITION BY comparison)""",
)
_view(
    "ds",
    "s",
    """SELECT * EXCLUDE (score), CASE WHEN method = 'shrunk' AND comparison = '1-URGENT' THEN 1.0
      WHEN method = 'ttest' AND comparison = '2-HIGH' THEN 0.0 ELSE score END AS score FROM s""",
)
_oracle(
    "q_weights_degenerate",
    "ds",
    f"""SELECT method, comparison, round(rho, 9) AS rho, round(CASE WHEN sum(u) OVER w > 0 THEN u / sum(u) OVER w
      ELSE 1.0 / count(*) OVER w END, 9) AS weight
    FROM (SELECT *, greatest(-coalesce(rho, 0), 0) AS u FROM (
      SELECT method, comparison, CASE WHEN min(rs) < max(rs) AND min(rf) < max(rf) THEN corr(rs, rf) END AS rho FROM (
        SELECT method, comparison, {average_rank('abs(score)', MC)} AS rs, {average_rank('abs(lfc)', MC)} AS rf FROM ds)
      GROUP BY method, comparison))
    WINDOW w AS (PARTITION BY comparison)""",
)
_oracle(
    "q_zero_floor_degenerate",
    "ds",
    """SELECT method, identifier, comparison, CASE WHEN score = 0 THEN coalesce(low, 0) ELSE score END AS score
    FROM ds JOIN (SELECT method, comparison, min(score) FILTER (score <> 0) AS low FROM ds
      GROUP BY method, comparison) USING (method, comparison)""",
)
_oracle("q_spearman_weights", "weights", f"SELECT {MC}, {show('rho weight')} FROM weights")
_view(
    "floored",
    "s",
    """SELECT s.* EXCLUDE (score), CASE WHEN score = 0 THEN low ELSE score END AS score FROM s JOIN (
      SELECT method, comparison, min(score) FILTER (score <> 0) AS low FROM s GROUP BY method, comparison)
    USING (method, comparison)""",
)
_oracle("q_zero_floor", "floored", "SELECT method, identifier, comparison, score FROM floored")
_view(
    "partial",
    "floored",
    """SELECT * EXCLUDE (score), CASE WHEN NOT (method = 'ttest' AND lfc > 300)
      AND NOT (method = 'shrunk' AND lfc < -100) THEN score END AS score FROM floored""",
)
_oracle(
    "q_ensemble",
    "partial weights",
    """SELECT identifier, comparison, round(1 / (1 + exp(-l)), 9) AS score,
      round(1 - 1 / (1 + exp(-l)), 9) AS support FROM (
      SELECT identifier, comparison, sum(weight * ln(p / (1 - p))) / nullif(sum(weight) FILTER (score IS NOT NULL), 0) AS l,
        bool_or(method = 'shrunk') AS anchored
      FROM (SELECT *, CASE WHEN score IS NOT NULL THEN least(greatest(score, 1e-12), 1 - 1e-12) END AS p FROM partial)
      JOIN weights USING (method, comparison) GROUP BY identifier, comparison) WHERE anchored""",
)


# --- trends and imputation --------------------------------------------------------------------

# Series coefficients of digamma and trigamma in 1/x^2.
DIGAMMA = "-1/12.0 + r*(1/120.0 + r*(-1/252.0 + r*(1/240.0 + r*(-1/132.0 + r*691/32760.0))))"
TRIGAMMA = "1/6.0 + r*(-1/30.0 + r*(1/42.0 + r*(-1/30.0 + r*(5/66.0 + r*(-691/2730.0 + r*7/6.0)))))"


def digamma(x: str) -> str:
    z = f"({x} + 8)"
    r = f"(1.0 / ({z} * {z}))"
    head = " + ".join(f"1.0 / ({x} + {i})" for i in range(8))
    return f"(ln({z}) - 0.5 / {z} + {r} * ({DIGAMMA.replace('r*', r + '*')}) - ({head}))"


def trigamma(x: str) -> str:
    z = f"({x} + 8)"
    r = f"(1.0 / ({z} * {z}))"
    head = " + ".join(f"1.0 / (({x} + {i}) * ({x} + {i}))" for i in range(8))
    return f"(1.0 / {z} + {r} / 2 + {r} / {z} * ({TRIGAMMA.replace('r*', r + '*')}) + {head})"


STEPS = 40


def gamma_steps(terms: str, rows: str = "glmrows") -> str:
    """Reweighted least squares; with a log link all weights are 1.

    State b0, b1 and the shifts d0, d1 of rows with c; one row per step.
    """
    eta = "(b0 + b1 * x + CASE WHEN c THEN d0 + d1 * x ELSE 0 END)"
    z = f"({eta} + (s - exp({eta})) / exp({eta}))"
    if terms == "mean":
        new = "regr_intercept(z, x), regr_slope(z, x), 0.0, 0.0"
    elif terms == "mean+c":
        slope = "((regr_sxy(z, x) FILTER (c) + regr_sxy(z, x) FILTER (NOT c)) / (regr_sxx(z, x) FILTER (c) + regr_sxx(z, x) FILTER (NOT c)))"
        low = f"(avg(z) FILTER (NOT c) - {slope} * avg(x) FILTER (NOT c))"
        new = f"{low}, {slope}, avg(z) FILTER (c) - {slope} * avg(x) FILTER (c) - {low}, 0.0"
    else:
        a, b = "regr_intercept(z, x)", "regr_slope(z, x)"
        new = f"{a} FILTER (NOT c), {b} FILTER (NOT c), {a} FILTER (c) - {a} FILTER (NOT c), {b} FILTER (c) - {b} FILTER (NOT c)"
    k = {"mean": 2, "mean+c": 3, "mean*c": 4}[terms]
    return f"""
    WITH RECURSIVE it(step, b0, b1, d0, d1) AS (
      SELECT 0, ln(avg(s)), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM {rows}
      UNION ALL
      SELECT step + 1, {new} FROM (SELECT step, x, c, {z} AS z FROM it, {rows} WHERE step < {STEPS})
      GROUP BY step)
    SELECT '{terms}' AS terms, b0, b1, d0, d1,
      sum(power((s - exp({eta})) / exp({eta}), 2)) / (count(*) - {k}) AS dispersion
    FROM it, {rows} WHERE step = {STEPS} GROUP BY b0, b1, d0, d1"""


_view("spreadrows", "stats_mv", "SELECT mean AS x, sd_p AS s, false AS c FROM stats_mv WHERE sd_p > 0")
_view("spreadtrend", "spreadrows", gamma_steps("mean", "spreadrows"))
_view("low", "cells_mv", "SELECT quantile_cont(mean, 0.01) AS low FROM cells_mv WHERE mean IS NOT NULL")


def uniform(key: str, stream: str) -> str:
    return f"((('0x' || substr(md5({key} || '|{stream}'), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


def draws(m: int) -> str:
    key = "'1|' || identifier || '|' || condition || '|' || replicate || '|' || imputation"
    normal = f"sqrt(-2 * ln({uniform(key, 'a')})) * cos(2 * pi() * {uniform(key, 'b')})"
    return f"""
    SELECT imputation, identifier, condition, replicate,
      centre + exp(b0 + b1 * centre) * {normal} AS y
    FROM (SELECT i.imputation, v.identifier, v.condition, v.replicate, coalesce(c.mean, low) AS centre
          FROM mv v LEFT JOIN cells_mv c ON c.identifier = v.identifier AND c.condition = v.condition,
               low, range({m}) i(imputation)
          WHERE v.y IS NULL), spreadtrend"""


IMPUTATIONS = 20
_view("draws1", "mv cells_mv spreadtrend low", draws(1))
_view("draws", "mv cells_mv spreadtrend low", draws(IMPUTATIONS))
_oracle(
    "q_impute_single",
    "draws1",
    """SELECT identifier, condition, replicate, round(y, 6) AS y FROM mv WHERE y IS NOT NULL
    UNION ALL SELECT identifier, condition, replicate, round(y, 6) FROM draws1""",
)
_oracle(
    "q_impute_multi",
    "draws",
    "SELECT CAST(imputation AS INTEGER) AS imputation, identifier, condition, replicate, round(y, 6) AS y FROM draws",
)
WEIGHT = "exp(-2 * (b0 + b1 * y))"
_view(
    "icells",
    "draws spreadtrend",
    f"""SELECT imputation, identifier, condition, count(*) AS n, avg(y) AS mean, var_pop(y) * count(*) AS ss,
      sum({WEIGHT}) AS w, sum({WEIGHT} * y) / sum({WEIGHT}) AS wmean,
      CASE WHEN count(*) > 1 THEN greatest(0.0, sum({WEIGHT} * y * y) - sum({WEIGHT} * y) ** 2 / sum({WEIGHT})) ELSE 0 END AS wss
    FROM (SELECT imputation, identifier, condition, y FROM draws
          UNION ALL SELECT imputation, identifier, condition, y FROM mv, range({IMPUTATIONS}) r(imputation)
          WHERE y IS NOT NULL), spreadtrend
    GROUP BY imputation, identifier, condition""",
)
_oracle(
    "q_imputed_cells",
    "icells",
    """SELECT CAST(imputation AS INTEGER) AS imputation, identifier, condition, n, round(mean, 6) AS mean,
      round(sqrt(ss / n), 6) AS sd, round(w, 6) AS w, round(wmean, 6) AS wmean, round(wss, 6) AS wss FROM icells""",
)

# --- moderated test ------------------------------------------------------------------------------


def prior_d0(tag: str, columns: list[str]) -> None:
    """Prior degrees of freedom by bisection on ln x for trigamma(x) = excess."""
    kept = ", ".join(f"f.{c}" for c in columns)
    _view(
        f"prior_{tag}",
        f"fit_{tag}",
        f"""SELECT f.imputation, {kept},
          CASE WHEN excess > 0 THEN 2 * exp((lo + hi) / 2) ELSE CAST('inf' AS DOUBLE) END AS d0
        FROM fit_{tag} f JOIN (
          WITH RECURSIVE b(imputation, lo, hi, step) AS (
            SELECT imputation, -12.0::DOUBLE, 25.0::DOUBLE, 0 FROM fit_{tag}
            UNION ALL
            SELECT imputation, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, step + 1
            FROM (SELECT b.*, (lo + hi) / 2 AS mid, {trigamma('exp((lo + hi) / 2)')} > f.excess AS up
                  FROM b JOIN fit_{tag} f USING (imputation) WHERE step < 70))
          SELECT imputation, lo, hi FROM b WHERE step = 70) USING (imputation)""",
    )


def prior_views(tag: str, ss: str, trend: bool, robust: bool) -> str:
    """Views up to prior_<tag> (imputation, d0, b0, b1, b2, centre); returns their names."""
    _view(
        f"resid_{tag}",
        "icells",
        f"""SELECT *, CASE WHEN s2 > 0 THEN ln(s2) - {digamma('(df / 2)')} + ln(df / 2) END AS e,
          {trigamma('(df / 2)')} AS tri
        FROM (SELECT imputation, identifier, CAST(sum(n - 1) AS DOUBLE) AS df, sum(n * mean) / sum(n) AS level,
                sum({ss}) / nullif(sum(n - 1), 0) AS s2
              FROM icells GROUP BY imputation, identifier) WHERE df > 0""",
    )
    e = "e"
    if robust:
        _view(
            f"wins_{tag}",
            f"resid_{tag}",
            f"""SELECT r.* EXCLUDE (e), least(greatest(e, lo), hi) AS e FROM resid_{tag} r JOIN (
              SELECT imputation, quantile_cont(e, 0.05) AS lo, quantile_cont(e, 0.9) AS hi
              FROM resid_{tag} WHERE e IS NOT NULL GROUP BY imputation) USING (imputation) WHERE e IS NOT NULL""",
        )
    base = f"wins_{tag}" if robust else f"resid_{tag}"
    if trend:
        sums = ", ".join(
            [f"sum(power(u, {k})) AS u{k}" for k in (1, 2, 3, 4)]
            + [f"sum(e * power(u, {k})) AS e{k}" for k in (0, 1, 2)]
        )

        def det(c):
            (a, b, d), (f, g, h), (i, j, k) = c
            return f"({a}*({g}*{k} - {h}*{j}) - {b}*({f}*{k} - {h}*{i}) + {d}*({f}*{j} - {g}*{i}))"

        left = [["n", "u1", "u2"], ["u1", "u2", "u3"], ["u2", "u3", "u4"]]
        right = ["e0", "e1", "e2"]
        coefs = ", ".join(
            f"{det([[right[r] if q == c else left[r][q] for q in range(3)] for r in range(3)])}"
            f" / {det(left)} AS b{c}"
            for c in range(3)
        )
        fit = f"""
        SELECT *, (ee - b0 * e0 - b1 * e1 - b2 * e2) / (n - 3) - tri AS excess FROM (
          SELECT *, {coefs} FROM (
            SELECT imputation, centre, count(*) AS n, {sums}, sum(e * e) AS ee, avg(tri) AS tri
            FROM (SELECT *, level - centre AS u FROM {base},
                    (SELECT avg(level) AS centre FROM {base} WHERE e IS NOT NULL) WHERE e IS NOT NULL)
            GROUP BY imputation, centre))"""
    else:
        fit = f"""
        SELECT imputation, avg({e}) AS b0, 0.0 AS b1, 0.0 AS b2, 0.0 AS centre,
          var_samp({e}) - avg(tri) AS excess FROM {base} WHERE {e} IS NOT NULL GROUP BY imputation"""
    _view(f"fit_{tag}", base, fit)
    prior_d0(tag, ["b0", "b1", "b2", "centre"])
    return f"prior_{tag}"


def moderated_views(tag: str, weighted: bool, trend: bool, robust: bool) -> str:
    n, mean, ss = ("w", "wmean", "wss") if weighted else ("n", "mean", "ss")
    prior_views(tag, ss, trend, robust)
    u = "(level - centre)"
    return moderated_view(tag, f"resid_{tag}", n, mean, f"b0 + b1 * {u} + b2 * {u} * {u}")


def moderated_view(tag: str, resid: str, n: str, mean: str, log_prior: str) -> str:
    _view(
        f"mod_{tag}",
        f"prior_{tag} {resid} icells contrasts",
        f"""SELECT *, CASE WHEN isinf(df_total) THEN {two_sided_normal('t')}
          ELSE {two_sided_t('t', 'df_total')} END AS p FROM (
          SELECT a.imputation, a.identifier, c.comparison, c.ord, s.d0 + s.df AS df_total,
            a.{mean} - b.{mean} AS lfc,
            (a.{mean} - b.{mean}) / sqrt(s2_post * (1.0 / a.{n} + 1.0 / b.{n})) AS t
          FROM icells a JOIN contrasts c ON a.condition = c.ca
          JOIN icells b ON b.imputation = a.imputation AND b.identifier = a.identifier AND b.condition = c.cb
          JOIN (SELECT imputation, identifier, d0, df,
                  CASE WHEN isinf(d0) THEN exp({log_prior}) ELSE
                  (d0 * exp({log_prior} + {digamma('(d0 / 2)')} - ln(d0 / 2)) + df * s2) / (d0 + df) END AS s2_post
                FROM {resid} JOIN prior_{tag} USING (imputation)) s
            ON s.imputation = a.imputation AND s.identifier = a.identifier)""",
    )
    return f"mod_{tag}"


def spline_views() -> None:
    """The trended test with a natural cubic spline: knots at quantiles of the first imputation's
    levels, normal equations by elimination."""
    _view(
        "knots",
        "resid_trend",
        """SELECT min(level) AS k0, quantile_cont(level, 1.0 / 3) AS k1, quantile_cont(level, 2.0 / 3) AS k2,
          max(level) AS k3 FROM resid_trend WHERE imputation = 0 AND e IS NOT NULL""",
    )
    z = "((level - k0) / (k3 - k0))"

    def bend(k: int) -> str:
        q = f"((k{k} - k0) / (k3 - k0))"
        return f"((power(greatest({z} - {q}, 0), 3) - power(greatest({z} - 1, 0), 3)) / (1 - {q}))"

    basis = ["1.0", z, f"({bend(0)} - {bend(2)})", f"({bend(1)} - {bend(2)})"]
    size = len(basis)
    x = ", ".join(f"{f} AS x{i}" for i, f in enumerate(basis))
    sums = ", ".join(
        [f"sum(x{i} * x{j}) AS a{i}{j}" for i in range(size) for j in range(size)]
        + [f"sum(x{i} * e) AS r{i}" for i in range(size)]
    )
    first = f"""SELECT imputation, count(*) AS n, sum(e * e) AS ee, avg(tri) AS tri, {sums}
      FROM (SELECT imputation, e, tri, {x} FROM resid_trend, knots WHERE e IS NOT NULL) GROUP BY imputation"""
    again = ", ".join(f"r{i} AS s{i}" for i in range(size))
    step = f"SELECT *, {again} FROM ({first})"
    for k in range(size):  # rows below the pivot lose its column
        changed = [f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j} AS a{i}{j}" for i in range(k + 1, size) for j in range(k, size)]
        changed += [f"s{i} - a{i}{k} / a{k}{k} * s{k} AS s{i}" for i in range(k + 1, size)]
        if changed:
            step = f"SELECT * REPLACE ({', '.join(changed)}) FROM ({step})"
    for k in reversed(range(size)):
        known = "".join(f" - a{k}{j} * c{j}" for j in range(k + 1, size))
        step = f"SELECT *, (s{k}{known}) / a{k}{k} AS c{k} FROM ({step})"
    explained = " - ".join(f"c{k} * r{k}" for k in range(size))
    names = [f"c{k}" for k in range(size)]
    _view("fit_spline", "resid_trend knots", f"SELECT *, (ee - {explained}) / (n - {size}) - tri AS excess FROM ({step})")
    prior_d0("spline", names)
    line = " + ".join(f"c{k} * {f}" for k, f in enumerate(basis))
    _view("resid_knots", "resid_trend knots", "SELECT * FROM resid_trend, knots")
    moderated_view("spline", "resid_knots", "n", "mean", line)


moderated_views("plain", False, False, False)
moderated_views("trend", False, True, False)
moderated_views("weighted", True, False, False)
moderated_views("robust", False, True, True)
moderated_views("full", True, True, True)

spline_views()

for _tag in ("plain", "trend", "weighted", "robust", "full"):
    _oracle(
        f"q_moderated_{_tag}",
        f"mod_{_tag}",
        f"""SELECT CAST(imputation AS INTEGER) AS imputation, identifier, comparison, round(t, 6) AS t,
          round(df_total, 4) AS df_total, round(p, 6) AS p_val, round(lfc, 6) AS lfc FROM mod_{_tag}""",
    )
_oracle(
    "q_variance_prior",
    "prior_robust",
    """SELECT CAST(imputation AS INTEGER) AS imputation, round(d0, 4) AS d0, round(b0, 6) AS b0,
      round(b1, 6) AS b1, round(b2, 6) AS b2 FROM prior_robust""",
)

# --- consensus ---------------------------------------------------------------------------------------

_view("adj", "mod_trend", bh("mod_trend", "imputation, comparison", "p", "imputation, identifier, comparison, p, lfc, ord"))


def smallest_k(n: int, level: float = 0.05) -> int:
    upper = 0
    for k in range(n, -1, -1):
        upper += math.comb(n, k)
        if upper / 2**n >= level:
            return k + 1
    return 0


NEED = smallest_k(IMPUTATIONS)
_view(
    "tail",
    "",
    f"""SELECT k AS hits, sum(exp(lgamma({IMPUTATIONS} + 1) - lgamma(k + 1) - lgamma({IMPUTATIONS} - k + 1)
      - {IMPUTATIONS} * ln(2.0))) OVER (ORDER BY k DESC) AS p FROM range({IMPUTATIONS + 1}) r(k)""",
)
_oracle(
    "q_consensus",
    "adj tail",
    """SELECT identifier, comparison, hits, round(tail.p, 9) AS binom_p_value, round(mp, 6) AS median_p_val,
      round(ml, 6) AS median_lfc FROM (
        SELECT identifier, comparison, count(*) FILTER (q_val < 0.05) AS hits, median(q_val) AS mp, median(lfc) AS ml
        FROM adj GROUP BY identifier, comparison) JOIN tail USING (hits)""",
)
_view(
    "mod_both",
    "mod_trend mod_full",
    """SELECT 'trend' AS method, imputation, identifier, comparison, p, lfc, ord FROM mod_trend
    UNION ALL SELECT 'full', imputation, identifier, comparison, p, lfc, ord FROM mod_full""",
)
_view(
    "adj_both",
    "mod_both",
    bh("mod_both", "method, imputation, comparison", "p", "method, imputation, identifier, comparison, p, lfc, ord"),
)
_oracle(
    "q_consensus_methods",
    "adj_both tail",
    f"""SELECT method, identifier, comparison, hits, round(tail.p, 9) AS binom_p_value, round(mp, 6) AS median_p_val,
      round(ml, 6) AS median_lfc, round(critical, 6) AS critical FROM (
        SELECT method, identifier, comparison, count(*) FILTER (q_val < 0.05) AS hits, median(q_val) AS mp,
          median(lfc) AS ml, max(CASE WHEN k = {NEED} THEN q_val END) AS critical
        FROM (SELECT *, row_number() OVER (PARTITION BY method, identifier, comparison ORDER BY q_val) AS k FROM adj_both)
        GROUP BY method, identifier, comparison) JOIN tail USING (hits)""",
)
ORACLES["q_consensus_vectors"] = ORACLES["q_consensus_methods"]
_view(
    "adj_spline",
    "mod_spline",
    bh("mod_spline", "imputation, comparison", "p", "imputation, identifier, comparison, p, lfc, ord"),
)
_oracle(
    "q_consensus_spline",
    "adj_spline tail",
    f"""SELECT identifier, comparison, hits, round(tail.p, 9) AS binom_p_value, round(mp, 6) AS median_p_val,
      round(ml, 6) AS median_lfc, round(critical, 6) AS critical FROM (
        SELECT identifier, comparison, count(*) FILTER (q_val < 0.05) AS hits, median(q_val) AS mp,
          median(lfc) AS ml, max(CASE WHEN k = {NEED} THEN q_val END) AS critical
        FROM (SELECT *, row_number() OVER (PARTITION BY identifier, comparison ORDER BY q_val) AS k FROM adj_spline)
        GROUP BY identifier, comparison) JOIN tail USING (hits)""",
)
_view(
    "crit",
    "adj",
    f"""SELECT identifier, comparison, q_val AS critical, regexp_matches(identifier, ':Brand#[123]$') AS truth FROM (
      SELECT *, row_number() OVER (PARTITION BY identifier, comparison ORDER BY q_val) AS k FROM adj) WHERE k = {NEED}""",
)
_view(
    "thresholds",
    "mod_trend",
    "SELECT DISTINCT p AS alpha FROM mod_trend WHERE imputation = 0 AND ord = 1 UNION SELECT 1.0",
)
_view(
    "minalpha",
    "crit thresholds",
    """SELECT identifier, comparison, min(alpha) AS min_alpha, any_value(truth) AS truth
    FROM crit JOIN thresholds ON alpha > critical GROUP BY identifier, comparison""",
)
_oracle(
    "q_min_alpha", "minalpha", "SELECT identifier, comparison, round(min_alpha, 6) AS min_alpha FROM minalpha"
)
_oracle(
    "q_consensus_roc",
    "crit thresholds",
    """SELECT c.comparison, round(alpha, 6) AS alpha,
      count(*) FILTER (truth AND critical < alpha) AS "TP", count(*) FILTER (NOT truth AND critical >= alpha) AS "TN",
      count(*) FILTER (NOT truth AND critical < alpha) AS "FP", count(*) FILTER (truth AND critical >= alpha) AS "FN"
    FROM crit c, thresholds GROUP BY c.comparison, alpha""",
)
_view("ms", "minalpha", "SELECT identifier, comparison, round(min_alpha, 6) AS score, truth FROM minalpha")
_view("c_ms", "ms", confusion("ms", "comparison", "strict", STRICT_EXTRA))
_oracle(
    "q_survivor_roc",
    "c_ms",
    f"""SELECT comparison, alpha, "TP", "TN", "FP", "FN", {show(RATES)} FROM ({rates('c_ms', 'comparison')})""",
)

# --- gamma regression, partition, posterior, forest features ---------------------------------------

_view(
    "glmrows",
    "stats_m",
    """SELECT identifier, mean AS x, sd AS s, regexp_matches(identifier, ':Brand#[123]$') AS c
    FROM stats_m WHERE sd > 0""",
)
for _tag, _terms in (("one", "mean"), ("two", "mean+c"), ("four", "mean*c")):
    _view(f"gamma_{_tag}", "glmrows", gamma_steps(_terms))
_oracle(
    "q_gamma_glm",
    "gamma_one gamma_two gamma_four",
    """SELECT terms, round(b0, 5) AS intercept, round(b1, 5) AS slope, round(d0, 5) AS upper_intercept,
      round(d1, 5) AS upper_slope, round(dispersion, 5) AS dispersion
    FROM (FROM gamma_one UNION ALL FROM gamma_two UNION ALL FROM gamma_four)""",
)

PART_GRID, PART_ROUNDS = 10, 5
PART_LOW, PART_HIGH = 0.05, 0.4


def partition_sql() -> None:
    _view(
        "prows",
        "stats_m",
        """SELECT identifier, mean AS x, sd AS s, ln(sd) AS y,
          ln(sd) - (SELECT regr_intercept(ln(sd), mean) FROM stats_m WHERE sd > 0)
          - (SELECT regr_slope(ln(sd), mean) FROM stats_m WHERE sd > 0) * mean AS r
        FROM stats_m WHERE sd > 0""",
    )
    grid = [(PART_LOW + (PART_HIGH - PART_LOW) * i / (PART_GRID - 1)) for i in range(PART_GRID)]
    values = ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a in grid for b in grid)

    def cuts(name: str, out: str, turn: bool) -> str:
        return " UNION ALL ".join(
            f"SELECT {h!r}::DOUBLE AS {name}, quantile_cont(r, {(1 - h if turn else h)!r}) AS {out} FROM prows"
            for h in grid
        )

    _view(
        "pgrid",
        "prows",
        f"""SELECT h1, h2, lo, hi FROM (VALUES {values}) g(h1, h2)
        JOIN ({cuts('h1', 'lo', False)}) USING (h1) JOIN ({cuts('h2', 'hi', True)}) USING (h2)""",
    )
    fit = """SELECT h1, h2, regr_intercept(y, x) FILTER (lab = 'L') AS la, regr_slope(y, x) FILTER (lab = 'L') AS lb,
      regr_intercept(y, x) FILTER (lab = 'U') AS ua, regr_slope(y, x) FILTER (lab = 'U') AS ub FROM ({}) GROUP BY h1, h2"""
    _view(
        "pfit0",
        "pgrid prows",
        fit.format(
            "SELECT h1, h2, x, y, CASE WHEN r <= lo THEN 'L' WHEN r >= hi THEN 'U' END AS lab FROM prows, pgrid"
        ),
    )
    label = "CASE WHEN abs(y - ua - ub * x) < abs(y - la - lb * x) THEN 'U' ELSE 'L' END"
    for i in range(1, PART_ROUNDS):
        _view(
            f"pfit{i}",
            f"pfit{i - 1} prows",
            fit.format(f"SELECT h1, h2, x, y, {label} AS lab FROM prows, pfit{i - 1}"),
        )
    last = f"pfit{PART_ROUNDS - 1}"
    _view(
        "pscore",
        f"{last} prows",
        f"""SELECT h1, h2, la, lb, ua, ub, sum(-(lm + s / exp(lm))) AS score FROM (
          SELECT *, CASE WHEN {label} = 'U' THEN ua + ub * x ELSE la + lb * x END AS lm FROM prows, {last})
        GROUP BY h1, h2, la, lb, ua, ub""",
    )
    _oracle(
        "q_partition_grid",
        "pscore",
        """SELECT round(h1, 6) AS h1, round(h2, 6) AS h2, round(score, 5) AS score FROM pscore""",
    )
    _oracle(
        "q_partition",
        "pscore prows",
        f"""SELECT identifier, {label} AS c FROM prows,
          (SELECT * FROM pscore ORDER BY score DESC, h1, h2 LIMIT 1)""",
    )


partition_sql()

NODES, SPAN = 64, 20.0


def posterior_sql(tag: str, gamma: str) -> None:
    shift = "CASE WHEN truth THEN d0 + d1 * {0} ELSE 0 END"
    at_y = f"(b0 + b1 * y + {shift.format('y')})"
    at_level = f"(b0 + b1 * level + {shift.format('level')})"
    step = 2 * math.log(SPAN) / (NODES - 1)
    ln_v = f"({-math.log(SPAN)!r} + j * {step!r})"
    ln_w = f"((a - (n - k)) * {ln_v} - a * exp({ln_v}) - wss / (2 * exp(2 * {ln_v})))"
    _view(
        f"pcells_{tag}",
        f"m {gamma}",
        f"""SELECT identifier, condition, truth, count(*) AS n, avg(y) AS mean, sum(w) AS w, sum(w * y) / sum(w) AS wmean,
          CASE WHEN count(*) > 1 THEN greatest(0.0, sum(w * y * y) - sum(w * y) ** 2 / sum(w)) ELSE 0 END AS wss
        FROM (SELECT *, exp(-2 * {at_y}) AS w FROM m, {gamma}) GROUP BY identifier, condition, truth""",
    )
    _view(
        f"pnodes_{tag}",
        f"pcells_{tag} {gamma}",
        f"""SELECT identifier, exp({at_level}) AS s_hat,
          list_transform(range({NODES}), lambda j: {ln_w}) AS lw
        FROM (SELECT identifier, truth, sum(n) AS n, count(*) AS k, sum(n * mean) / sum(n) AS level, sum(wss) AS wss
              FROM pcells_{tag} GROUP BY identifier, truth), (SELECT *, 1 / dispersion AS a FROM {gamma})""",
    )
    _oracle(
        f"q_posterior_{tag}",
        f"pnodes_{tag} pcells_{tag} contrasts",
        f"""SELECT identifier, comparison, round(z, 6) AS z, round({two_sided_normal('z')}, 6) AS err, round(lfc, 6) AS lfc FROM (
          SELECT a.identifier, c.comparison, a.wmean - b.wmean AS lfc,
            (a.wmean - b.wmean) / sqrt(ratio * (1 / a.w + 1 / b.w)) AS z
          FROM pcells_{tag} a JOIN contrasts c ON a.condition = c.ca
          JOIN pcells_{tag} b ON b.identifier = a.identifier AND b.condition = c.cb
          JOIN (SELECT identifier,
                  list_sum(list_transform(range({NODES}), lambda j: exp(2 * {ln_v}) * exp(lw[j + 1] - list_max(lw))))
                  / list_sum(list_transform(lw, lambda v: exp(v - list_max(lw)))) AS ratio
                FROM pnodes_{tag}) e ON e.identifier = a.identifier)""",
    )


posterior_sql("err", "gamma_one")
posterior_sql("labelled", "gamma_two")

_view(
    "features",
    "stats_mvh cells_mvh",
    """SELECT s.identifier, s.n, round(s.mean, 6) AS mean, round(sd, 6) AS sd, round(a.mean - n.mean, 6) AS "A_vs_N",
      round(a.mean - r.mean, 6) AS "A_vs_R", round(n.mean - r.mean, 6) AS "N_vs_R",
      CASE WHEN regexp_matches(s.identifier, ':Brand#[123]$') THEN 'TP' ELSE 'TN' END AS class
    FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n) FROM stats_mvh) s
    LEFT JOIN cells_mvh a ON a.identifier = s.identifier AND a.condition = 'A'
    LEFT JOIN cells_mvh n ON n.identifier = s.identifier AND n.condition = 'N'
    LEFT JOIN cells_mvh r ON r.identifier = s.identifier AND r.condition = 'R'""",
)
_view(
    "features_mv",
    "stats_mv cells_mv",
    """SELECT s.identifier, s.n, round(s.mean, 6) AS mean, round(sd, 6) AS sd, round(a.mean - n.mean, 6) AS "A_vs_N",
      round(a.mean - r.mean, 6) AS "A_vs_R", round(n.mean - r.mean, 6) AS "N_vs_R",
      CASE WHEN regexp_matches(s.identifier, ':Brand#[123]$') THEN 'TP' ELSE 'TN' END AS class
    FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n) FROM stats_mv) s
    LEFT JOIN cells_mv a ON a.identifier = s.identifier AND a.condition = 'A'
    LEFT JOIN cells_mv n ON n.identifier = s.identifier AND n.condition = 'N'
    LEFT JOIN cells_mv r ON r.identifier = s.identifier AND r.condition = 'R'""",
)
_oracle("q_filter_features", "features", "SELECT * FROM features")
_view(
    "ruled",
    "features",
    """SELECT identifier, class, CASE WHEN "A_vs_N" + "A_vs_R" > 0.8 THEN 'TP' ELSE 'TN' END AS pred FROM features
    WHERE mean IS NOT NULL AND sd IS NOT NULL AND "A_vs_N" IS NOT NULL AND "A_vs_R" IS NOT NULL AND "N_vs_R" IS NOT NULL""",
)
_oracle("q_keep_rule", "ruled", "SELECT identifier FROM ruled WHERE NOT (class = 'TP' AND pred = 'TN')")
_oracle(
    "q_labels_rule",
    "features ruled",
    """SELECT identifier, cls_prd, level FROM (
      SELECT f.identifier, coalesce(r.class || '-' || r.pred, 'Discarded') AS cls_prd
      FROM features f LEFT JOIN ruled r USING (identifier)) JOIN (
      SELECT cls_prd, row_number() OVER (ORDER BY count(*) DESC, cls_prd) AS level FROM (
        SELECT coalesce(r.class || '-' || r.pred, 'Discarded') AS cls_prd
        FROM features f LEFT JOIN ruled r USING (identifier)) GROUP BY cls_prd) USING (cls_prd)""",
)
_oracle(
    "q_forest_compiled",
    "features",
    """SELECT class, count(*) AS judged, count(*) AS agreed FROM features
    WHERE mean IS NOT NULL AND sd IS NOT NULL AND "A_vs_N" IS NOT NULL AND "A_vs_R" IS NOT NULL AND "N_vs_R" IS NOT NULL
    GROUP BY class""",
)
_oracle(
    "q_forest_classes",
    "features_mv",
    """SELECT class, count(*) AS judged FROM features_mv
    WHERE mean IS NOT NULL AND sd IS NOT NULL AND "A_vs_N" IS NOT NULL AND "A_vs_R" IS NOT NULL AND "N_vs_R" IS NOT NULL
    GROUP BY class""",
)
