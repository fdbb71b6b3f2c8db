"""Oracle SQL (DuckDB dialect): the same answers, written relationally from scratch."""

from __future__ import annotations

from .inputs import CSV_FILE_LINES, CSV_LINES, CURRENCY_TEXT, planted_sql
from ..functions.words import IDENTIFIER_TOKENS
from .recipes import RECIPES

_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_ISO = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?$"
_DMY = r"^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}$"
LINES = ["quantity", "price", "discount", "tax"]
ACCOUNTS = ["balance", "region_index", "visits", "score"]
PARTS = ["size", "price", "weight"]
IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
EMB = [f"e{i:02d}" for i in range(64)]


def num(x: str) -> str:
    """Currency-tolerant number."""
    bare = rf"regexp_replace({x}, '[$€£¥,\s]', '', 'g')"
    return (
        rf"CASE WHEN regexp_matches({bare}, '^(\({_NUM}\)|{_NUM})$') THEN "
        rf"TRY_CAST(replace(replace({bare}, '(', ''), ')', '') AS DOUBLE) * "
        rf"CASE WHEN regexp_matches(trim({x}), '^\(.*\)$') THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END END"
    )


def title(x: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\pL+|[^\pL]+)', 1), "
        rf"lambda w: upper(w[1]) || w[2:]), '')"
    )


def rnd(cols: list[str], digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def zero_safe(x: str, digits: int) -> str:
    """Rounded value without a negative zero."""
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0::DOUBLE ELSE round({x}, {digits}) END"


def h52(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT"


def u01(*parts: str) -> str:
    return f"({h52(*parts)}::DOUBLE / 4503599627370496)"


def with_(name: str, planted: str) -> str:
    return f"WITH {name} AS ({planted_sql(planted)})"


# ---- profile ---------------------------------------------------------------

def facts(source: str, columns: list[tuple[str, str]], tag: str = "") -> str:
    """CTEs long, base, rep over (name, kind) columns; kind: text, whole, real, moment."""
    parts = []
    for pos, (c, kind) in enumerate(columns):
        v = num(c) if kind == "text" else f"CAST({c} AS DOUBLE)" if kind in ("whole", "real") else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {pos} AS pos, '{c}' AS column_name, '{kind}' AS kind, CAST({c} AS VARCHAR) AS t, {v} AS v FROM {source}"
        )
    hint = "(^|_)(" + "|".join(IDENTIFIER_TOKENS) + ")($|_)"
    return f"""long{tag} AS ({' UNION ALL '.join(parts)}),
base{tag} AS (SELECT pos, column_name, kind, count(*) AS n, count(t) AS present, count(DISTINCT t) AS k, count(v) AS parsed,
  count(*) FILTER (kind = 'text' AND regexp_matches(t, '^0[0-9]+$')) AS padded,
  count(*) FILTER (kind = 'text' AND regexp_matches(t, '{_ISO}')) AS iso,
  count(*) FILTER (kind = 'text' AND regexp_matches(t, '{_DMY}')) AS dmy,
  avg(v) AS mean, median(v) AS med, stddev_samp(v) AS sd, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.99) AS p99,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
  CASE WHEN count(v) < 3 THEN NULL WHEN stddev_samp(v) = 0 THEN 0 ELSE skewness(v) END AS sk
  FROM long{tag} GROUP BY pos, column_name, kind),
mads{tag} AS (SELECT l.pos, median(abs(l.v - b.med)) AS mad FROM long{tag} l JOIN base{tag} b ON l.pos = b.pos GROUP BY l.pos),
ext{tag} AS (SELECT l.pos, count(*) FILTER (CASE WHEN m.mad > 0 THEN abs(0.6745 * (l.v - b.med) / m.mad) > 3.5
  WHEN b.q3 > b.q1 THEN l.v < b.q1 - 3 * (b.q3 - b.q1) OR l.v > b.q3 + 3 * (b.q3 - b.q1) ELSE false END) AS n_ext
  FROM long{tag} l JOIN base{tag} b ON l.pos = b.pos JOIN mads{tag} m ON l.pos = m.pos GROUP BY l.pos),
roles{tag} AS (SELECT *, CASE WHEN present = 0 THEN 'empty' WHEN k = 1 THEN 'constant' WHEN padded > 0 THEN 'identifier'
  WHEN regexp_matches(lower(column_name), '{hint}') AND k / present > 0.5 THEN 'identifier'
  WHEN kind = 'whole' AND n = present AND k / present > 0.98 THEN 'identifier'
  WHEN kind IN ('whole', 'real') THEN 'numeric' WHEN kind = 'moment' THEN 'datetime'
  WHEN parsed / present >= 0.95 THEN 'numeric' WHEN greatest(iso, dmy) / present >= 0.95 THEN 'datetime'
  WHEN k <= 50 OR (k <= 200 AND k / present < 0.05) THEN 'categorical'
  WHEN k / present > 0.98 THEN 'identifier' ELSE 'text' END AS role FROM base{tag}),
rep{tag} AS (SELECT r.pos, column_name, role, n, n - present AS n_missing, round(100.0 * (n - present) / n, 3) AS pct_missing,
  k AS n_unique, round(100.0 * k / n, 3) AS pct_unique,
  CASE WHEN role = 'numeric' THEN round(mean, 6) END AS mean, CASE WHEN role = 'numeric' THEN round(med, 6) END AS median,
  CASE WHEN role = 'numeric' THEN round(sd, 6) END AS std, CASE WHEN role = 'numeric' THEN round(p01, 6) END AS p01,
  CASE WHEN role = 'numeric' THEN round(p99, 6) END AS p99, CASE WHEN role = 'numeric' THEN round(sk, 6) END AS skew,
  CASE WHEN role = 'numeric' THEN n_ext ELSE 0 END AS n_extreme,
  CASE WHEN role = 'numeric' THEN round(100.0 * n_ext / n, 3) ELSE 0 END AS pct_extreme,
  CASE WHEN role = 'numeric' THEN present - parsed ELSE 0 END AS n_uncastable
  FROM roles{tag} r JOIN ext{tag} e ON r.pos = e.pos)"""


_REPORT = f"""SELECT column_name, role, n, n_missing, round(pct_missing, 4) AS pct_missing, n_unique,
  round(pct_unique, 4) AS pct_unique, {zero_safe('mean', 4)} AS mean, round(median, 4) AS median, round(std, 4) AS std,
  round(p01, 4) AS p01, round(p99, 4) AS p99, {zero_safe('skew', 4)} AS skew, n_extreme, round(pct_extreme, 4) AS pct_extreme, n_uncastable,
  concat_ws('; ', CASE WHEN role = 'empty' THEN 'holds no value' END,
    CASE WHEN role = 'constant' THEN 'holds one value only' END,
    CASE WHEN pct_missing >= 60 THEN printf('gaps in %.1f%% of the rows, more than a fill can stand for', CAST(pct_missing AS DOUBLE))
         WHEN pct_missing >= 20 THEN printf('gaps in %.1f%% of the rows, so a flag for them is worth having', CAST(pct_missing AS DOUBLE)) END,
    CASE WHEN n_uncastable > 0 THEN n_uncastable || ' cells do not read as numbers' END,
    CASE WHEN abs(skew) > 2 THEN printf('skewness %.2f, so the middle value fits gaps better than the average', skew) END,
    CASE WHEN role = 'identifier' THEN 'names rows, so it stays text' END) AS notes
FROM rep"""

_DIRTY = [("o_orderkey", "whole"), ("o_custkey", "whole"), ("status", "text"), ("total", "real"), ("paid", "text"),
          ("placed", "text"), ("zip", "text"), ("notes", "text"), ("channel", "text"), ("priority", "text")]
_EVENTS = [("event_id", "whole"), ("ts", "moment"), ("user_id", "whole"), ("event_type", "text"), ("value", "real"), ("props", "text")]
_ROLE_TABLES = {
    "customer": [("c_custkey", "whole"), ("c_name", "text"), ("c_nationkey", "whole"), ("c_acctbal", "real"), ("c_mktsegment", "text")],
    "part": [("p_partkey", "whole"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "whole"), ("p_retailprice", "real")],
    "nation": [("n_nationkey", "whole"), ("n_name", "text"), ("n_regionkey", "whole")],
    "documents": [("doc_id", "whole"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "whole")],
    "dirty": _DIRTY,
}
_DATASET = """(SELECT count(*) AS n_rows, 10 AS n_cols,
  round(100 * (1 - (SELECT sum(n - present) FROM base) / (count(*) * 10)), 3) AS completeness_pct,
  round(100 * (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) / count(*), 3) AS uniqueness_pct,
  round(100 * (1 - (SELECT sum(n_uncastable) FROM rep) / (count(*) * 10)), 3) AS validity_pct,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS n_duplicate_rows FROM dirty)"""

# ---- repair ----------------------------------------------------------------

_TRIMMED = """trimmed AS (SELECT o_orderkey, o_custkey, CASE WHEN trim(status) <> 'N/A' THEN trim(status) END AS status, total,
  CASE WHEN paid <> '-' THEN paid END AS paid, placed, zip, notes, channel, priority FROM dirty)"""
_REPAIRED = f"""repaired AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_custkey, status, total,
  {num('paid')} AS paid, strptime(placed, '%d-%m-%Y') AS placed, zip, channel, priority FROM trimmed)"""
_REPAIR = f"{with_('dirty', 'dirty_orders')}, {_TRIMMED}, {_REPAIRED}"

# ---- contacts --------------------------------------------------------------

_CONTACT_TIDY = f"""tidy AS (SELECT contact_id, {title('full_name')} AS full_name,
  CASE WHEN contact_id % 9 <> 0 THEN lower(trim(email)) END AS email,
  CASE contact_id % 6 WHEN 0 THEN 'United States' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'United States'
    WHEN 3 THEN 'United Kingdom' WHEN 4 THEN 'New Zealand' ELSE 'France' END AS country,
  CASE WHEN TRY_CAST(age AS DOUBLE) BETWEEN 0 AND 120 THEN TRY_CAST(age AS DOUBLE) END AS age,
  {title('product_category')} AS product_category, CASE WHEN unit_price >= 0 THEN CAST(unit_price AS DOUBLE) END AS unit_price,
  printf('2024-%02d-%02d', 1 + contact_id % 12, 1 + contact_id % 28) AS signup_date FROM contacts)"""
_CONTACT_STEPS = [
    ("standardized_full_name", "true"), ("validated_email", "contact_id % 9 = 0"), ("standardized_country", "true"),
    ("bounded_age_0_120", "TRY_CAST(age AS DOUBLE) IS NULL OR TRY_CAST(age AS DOUBLE) > 120"),
    ("standardized_product_category", "true"), ("removed_negative_unit_price", "unit_price < 0"),
    ("standardized_signup_date", "true"),
]


def _steps_sql() -> str:
    parts = [
        f"SELECT {i} AS o, '{s}' AS step WHERE EXISTS (SELECT 1 FROM contacts WHERE {c})" for i, (s, c) in enumerate(_CONTACT_STEPS)
    ]
    return " UNION ALL ".join(parts)


# ---- stages ----------------------------------------------------------------

def filled(source: str, features: list[str], agg: str, others: list[str], name: str = "imp") -> str:
    """CTE with every feature filled by an aggregate of its column."""
    cols = ", ".join(f"coalesce({f}, (SELECT {agg.format(f)} FROM {source})) AS {f}" for f in features)
    return f"{name} AS MATERIALIZED (SELECT {', '.join([*others, ''])}{cols} FROM {source})"


def mode_of(f: str, source: str) -> str:
    return f"(SELECT {f} FROM {source} WHERE {f} IS NOT NULL GROUP BY {f} ORDER BY count(*) DESC, {f} LIMIT 1)"


def iqr_keep(source: str, features: list[str]) -> str:
    ends = ", ".join(f"quantile_cont({f}, 0.25) AS {f}_1, quantile_cont({f}, 0.75) AS {f}_3" for f in features)
    inside = " AND ".join(
        f"{f} BETWEEN {f}_1 - 1.5 * ({f}_3 - {f}_1) AND {f}_3 + 1.5 * ({f}_3 - {f}_1)" for f in features
    )
    return f"marked AS MATERIALIZED (SELECT s.*, {inside} AS inside FROM {source} s, (SELECT {ends} FROM {source}))"


def z_keep(source: str, features: list[str]) -> str:
    ends = ", ".join(f"avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s" for f in features)
    inside = " AND ".join(f"abs(({f} - {f}_m) / {f}_s) < 3" for f in features)
    return f"marked AS MATERIALIZED (SELECT s.*, {inside} AS inside FROM {source} s, (SELECT {ends} FROM {source}))"


_GUARD = """guard AS (SELECT sum(k) < greatest(10, floor(0.5 * sum(c))) OR min(k) = 0 AS whole
  FROM (SELECT label, count(*) AS c, count(*) FILTER (inside) AS k FROM marked GROUP BY label)),
kept AS (SELECT * FROM marked WHERE inside OR (SELECT whole FROM guard))"""


def scaled(source: str, features: list[str], kind: str, others: list[str], digits: int = 4) -> str:
    centre, width = {
        "standard": ("avg({0})", "stddev_pop({0})"), "minmax": ("min({0})", "max({0}) - min({0})"),
        "robust": ("median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"),
    }[kind]
    ends = ", ".join(f"{centre.format(f)} AS {f}_c, {width.format(f)} AS {f}_w" for f in features)
    cols = ", ".join(
        f"{zero_safe(f'({f} - {f}_c) / CASE WHEN {f}_w = 0 THEN 1 ELSE {f}_w END', digits)} AS {f}" for f in features
    )
    return f"SELECT {', '.join([*others, ''])}{cols} FROM {source}, (SELECT {ends} FROM {source})"


_LINES = with_("lines", "lines")
_LINE_MEDIAN = f"{_LINES}, {filled('lines', LINES, 'median({0})', [*IDS, 'label'])}"


def _knn_parts() -> str:
    """Brute force: every incomplete cell against every donor."""
    def gap(f: str) -> str:
        return f"CASE WHEN a.{f} IS NULL OR b.{f} IS NULL THEN 0::DOUBLE ELSE (a.{f} - b.{f}) * (a.{f} - b.{f}) END"

    seen = " + ".join(f"CASE WHEN a.{f} IS NULL OR b.{f} IS NULL THEN 0 ELSE 1 END" for f in PARTS)
    ctes = []
    for f in PARTS:
        ctes.append(f"""near_{f} AS (SELECT p_partkey, avg(value) AS value FROM (
  SELECT a.p_partkey, b.{f} AS value, row_number() OVER (PARTITION BY a.p_partkey ORDER BY
    sqrt(3::DOUBLE / ({seen}) * ({' + '.join(gap(g) for g in PARTS)})), b.{f}) AS r
  FROM parts a JOIN parts b ON a.{f} IS NULL AND b.{f} IS NOT NULL AND ({seen}) > 0) WHERE r <= 5 GROUP BY p_partkey)""")
    cols = ", ".join(f"coalesce(p.{f}, near_{f}.value, (SELECT avg({f}) FROM parts)) AS {f}" for f in PARTS)
    joins = " ".join(f"LEFT JOIN near_{f} ON p.p_partkey = near_{f}.p_partkey" for f in PARTS)
    return f"{with_('parts', 'parts')}, {', '.join(ctes)}, imp AS (SELECT p.p_partkey, p.label, {cols} FROM parts p {joins})"


_SMOTE = f"""{with_('accounts', 'accounts')},
{filled('accounts', ACCOUNTS, 'median({0})', ['c_custkey', 'label'], 'full_rows')},
sizes AS (SELECT label, count(*) AS size FROM full_rows GROUP BY label),
ends AS (SELECT max(size) AS largest, greatest(1, least(5, min(size) - 1)) AS k FROM sizes),
seeds AS (SELECT f.*, s.size, e.largest, e.k, row_number() OVER (PARTITION BY f.label ORDER BY {h52("'42'", 'f.c_custkey')}, f.c_custkey) AS r
  FROM full_rows f JOIN sizes s ON f.label = s.label, ends e WHERE s.size < e.largest),
copies AS (SELECT *, unnest(range(1, 1 + CAST(floor((largest - size) / size) AS BIGINT) + CASE WHEN r <= (largest - size) % size THEN 1 ELSE 0 END)) AS copy FROM seeds),
near AS (SELECT a.c_custkey, {', '.join('b.' + f for f in ACCOUNTS)}, row_number() OVER (PARTITION BY a.c_custkey ORDER BY
  sqrt({' + '.join(f'(a.{f} - b.{f}) * (a.{f} - b.{f})' for f in ACCOUNTS)}), {', '.join('b.' + f for f in ACCOUNTS)}) - 1 AS place
  FROM seeds a JOIN full_rows b ON a.label = b.label AND a.c_custkey <> b.c_custkey)
SELECT {', '.join(f'round(c.{f} + u * (n.{f} - c.{f}), 3) AS {f}' for f in ACCOUNTS)}, c.label
FROM (SELECT *, {u01("'42'", "'along'", 'c_custkey', 'copy')} AS u,
  floor({u01("'42'", "'neighbour'", 'c_custkey', 'copy')} * k) AS pick FROM copies) c
JOIN near n ON c.c_custkey = n.c_custkey AND n.place = c.pick"""

_PSI = "(-0.5772156649015329 + coalesce(list_sum(list_transform(range(1, ({0})::BIGINT), lambda i: 1::DOUBLE / i)), 0))"
_MI = f"""{with_('vectors', 'vectors')},
long AS MATERIALIZED (UNPIVOT vectors ON {', '.join(EMB)} INTO NAME feature VALUE v),
sizes AS (SELECT label, count(*) AS size, least(3, count(*) - 1) AS k FROM vectors GROUP BY label HAVING count(*) > 1),
radius AS MATERIALIZED (SELECT a.feature, a.vec_id, a.v, s.size, s.k, list_sort(list(abs(a.v - b.v)))[s.k] AS r
  FROM long a JOIN sizes s ON a.label = s.label JOIN long b ON a.feature = b.feature AND a.label = b.label AND a.vec_id <> b.vec_id
  GROUP BY a.feature, a.vec_id, a.v, s.size, s.k),
inside AS MATERIALIZED (SELECT a.feature, a.vec_id, a.size, a.k, count(*) AS m FROM radius a JOIN long b ON a.feature = b.feature
  AND (abs(a.v - b.v) < a.r OR (a.r = 0 AND a.v = b.v)) GROUP BY ALL)
SELECT feature, round(greatest(0, (SELECT {_PSI.format('sum(size)')} FROM sizes) + avg({_PSI.format('k')}) - avg({_PSI.format('size')})
  - avg({_PSI.format('m')})), 5) AS score FROM inside GROUP BY feature"""


def _terrain(name: str, planted: str, features: list[str]) -> str:
    d = len(features)
    means = ", ".join(f"avg({f}) AS {f}_m" for f in features)
    fill = ", ".join(f"coalesce({f}, {f}_m) AS {f}" for f in features)
    pairs = [f"abs(corr({a}, {b}))" for i, a in enumerate(features) for b in features[i + 1 :]]
    sums = [" + ".join(pairs[i : i + 50]) for i in range(0, len(pairs), 50)]
    gaps = " + ".join(f"count(*) - count({f})" for f in features)
    return f"""(WITH t AS ({planted_sql(planted)}),
g AS (SELECT count(*) AS n, ({gaps}) / (count(*) * {d}) AS miss FROM t),
b AS (SELECT min(c) AS least, min(c) / max(c) AS bal FROM (SELECT count(*) AS c FROM t GROUP BY label)),
c AS (SELECT ({' + '.join(f'({s})' for s in sums)}) / {len(pairs)} AS corr FROM (SELECT {fill} FROM t, (SELECT {means} FROM t)))
SELECT '{name}' AS table_name, n AS n_samples, {d} AS n_features, round(miss, 6) AS missing_ratio, round(bal, 6) AS class_balance,
  round({d} / n, 6) AS dim_ratio, round(corr, 6) AS mean_abs_correlation, least AS minority_count,
  concat('dim:', CASE WHEN {d} / n > 0.1 THEN 'hi' ELSE 'lo' END, '|miss:', CASE WHEN miss > 0.05 THEN 'hi' ELSE 'lo' END,
    '|bal:', CASE WHEN bal < 0.5 THEN 'hi' ELSE 'lo' END, '|corr:', CASE WHEN corr > 0.7 THEN 'hi' ELSE 'lo' END) AS signature,
  coalesce(nullif(concat_ws('; ', CASE WHEN {d} / n > 0.1 THEN 'high_dimensional' END,
    CASE WHEN miss > 0.05 THEN 'severe_missing' WHEN miss > 0 THEN 'some_missing' END,
    CASE WHEN bal < 0.5 THEN 'imbalanced' END, CASE WHEN corr > 0.7 THEN 'high_correlation' END), ''), 'well_behaved') AS tags,
  CASE WHEN {d} / n > 0.1 THEN 'skirmisher' WHEN miss > 0.05 THEN 'phalanx' WHEN bal < 0.5 THEN 'guerrilla'
    WHEN corr > 0.7 THEN 'heavy_cavalry' ELSE 'phalanx' END AS default_recipe FROM g, b, c)"""


def _enhance_metric(recipe: str, keep: str | None, steps: str, columns: int, synthetic: str = "0") -> str:
    if keep is None:
        return f"""(WITH accounts AS ({planted_sql('accounts')}) SELECT '{recipe}' AS recipe, count(*) AS input_rows, 5 AS input_columns,
  count(*) + {synthetic} AS output_rows, {columns} AS output_columns, {synthetic} AS synthetic_rows, 0 AS removed_rows, '{steps}' AS steps FROM accounts)"""
    return f"""({with_('accounts', 'accounts')}, {filled('accounts', ACCOUNTS, 'median({0})', ['label'])}, {keep}, {_GUARD}
SELECT '{recipe}' AS recipe, (SELECT count(*) FROM accounts) AS input_rows, 5 AS input_columns, count(*) AS output_rows,
  {columns} AS output_columns, 0 AS synthetic_rows, (SELECT count(*) FROM accounts) - count(*) AS removed_rows, '{steps}' AS steps FROM kept)"""


# Two steps of evidence updates for one slope: it is below the tolerance of 0.001, so the second step is the last.
_ITERATIVE = f"""{_LINES},
s AS (SELECT count(*) AS n, avg(price) AS mx, avg(quantity) AS my, regr_sxx(quantity, price) AS xx, regr_sxy(quantity, price) AS xy,
  regr_syy(quantity, price) AS yy FROM lines WHERE quantity IS NOT NULL),
first_step AS (SELECT *, n / yy AS noise, xy / (xx + yy / n) AS b FROM s),
updated AS (SELECT *, noise * xx / (1 + noise * xx) AS gamma, yy - 2 * b * xy + b * b * xx AS rss FROM first_step),
weights AS (SELECT *, (gamma + 2e-6::DOUBLE) / (b * b + 2e-6::DOUBLE) AS weight, (n - gamma + 2e-6::DOUBLE) / (rss + 2e-6::DOUBLE) AS noise_2 FROM updated),
slope AS (SELECT xy / (xx + weight / noise_2) AS c, mx, my FROM weights)
SELECT {', '.join(IDS)}, round(coalesce(quantity, my + c * (price - mx)), 4) AS quantity, round(price, 4) AS price FROM lines, slope"""
_RETAIN = f"""{_LINE_MEDIAN}, i AS (WITH {iqr_keep('imp', LINES)}, {_GUARD} SELECT count(*) AS k FROM kept),
z AS (WITH {z_keep('imp', LINES)}, {_GUARD} SELECT count(*) AS k FROM kept), t AS (SELECT count(*) AS n FROM lines)
SELECT recipe, round(k / n, 4) AS retention, k AS n_after, n FROM (
  SELECT unnest(['phalanx', 'scorched_earth']) AS recipe, k FROM i UNION ALL SELECT 'heavy_cavalry', k FROM z
  UNION ALL SELECT unnest(['skirmisher', 'guerrilla', 'reconnaissance', 'siege', 'diplomat']), n FROM t), t"""

_NAMES = "['phalanx', 'skirmisher', 'heavy_cavalry', 'guerrilla', 'scorched_earth', 'reconnaissance', 'siege', 'diplomat']"
_REWARDS = f"""rewards AS (SELECT concat('sig:', l_linenumber % 2) AS signature, ({_NAMES})[CAST(l_suppkey % 8 AS INT) + 1] AS recipe, reward
  FROM (SELECT l_linenumber, l_suppkey % 8 AS l_suppkey, avg(l_discount) AS reward FROM lineitem GROUP BY 1, 2))"""


_RECIPE_LIST = "[" + ", ".join(f"'{n}'" for n in RECIPES) + "]"


def _checks(variant: str, source: str, target: str, columns: int, features: int, bad: str = "0") -> str:
    texts = {
        "target_complete": "target column cannot contain missing values",
        "target_discrete": "target must contain discrete classes, not continuous values",
        "numeric_features": "needs at least one numeric feature column",
        "finite_features": "feature columns cannot contain infinite values",
        "row_count": "needs at least 10 rows", "class_count": "target must contain at least two classes",
        "class_rows": "each target class must contain at least 3 rows",
    }
    rows = [
        (1, "columns", f"{columns} >= 2", f"{columns}", ""), (2, "target_exists", "true", "1", ""),
        (3, "target_complete", "gaps = 0", "gaps", ""), (4, "target_discrete", "bad = 0", "bad", ""),
        (5, "numeric_features", f"{features} > 0", f"{features}", ""), (6, "finite_features", "true", "0", ""),
        (7, "row_count", "n >= 10", "n", ""), (8, "class_count", "classes >= 2", "classes", ""),
        (9, "class_rows", "least >= 3", "least", ""),
    ]
    stats = f"""(SELECT sum(c) AS n, coalesce(sum(c) FILTER (t IS NULL), 0) AS gaps, count(t) AS classes, min(c) FILTER (t IS NOT NULL) AS least,
  sum(bad) AS bad FROM (SELECT {target} AS t, count(*) AS c, count(*) FILTER ({bad if bad != '0' else 'false'}) AS bad FROM {source} GROUP BY {target}))"""
    return " UNION ALL ".join(
        f"SELECT '{variant}' AS variant, {p} AS position, '{c}' AS check_name, {ok} AS passed, CAST({seen} AS DOUBLE) AS observed, "
        f"CASE WHEN {ok} THEN '' ELSE '{texts.get(c, '')}' END AS message FROM {stats}"
        for p, c, ok, seen, _ in rows
    )


_PLAN_FILL = """fills AS (SELECT avg(quantity) AS qf, median(price) AS pf, avg(discount) AS df FROM lines)"""
_CASTS = "o_orderkey->string (identifier); status->category; paid->numeric; placed->datetime; priority->category"

ORACLES: dict[str, str] = {
    "profile_dirty_orders": f"{with_('dirty', 'dirty_orders')}, {facts('dirty', _DIRTY)} {_REPORT}",
    "profile_events": f"WITH {facts('events', _EVENTS)} {_REPORT}",
    "profile_dataset": f"{with_('dirty', 'dirty_orders')}, {facts('dirty', _DIRTY)} SELECT * FROM {_DATASET}",
    "fingerprint_check": "SELECT count(*) AS n_rows, true AS same_content, true AS change_seen FROM orders",
    "column_roles": with_("dirty", "dirty_orders")
    + "".join(f", {facts(t, cols, '_' + t)}" for t, cols in _ROLE_TABLES.items())
    + " UNION ALL ".join(
        f" SELECT '{'dirty_orders' if t == 'dirty' else t}' AS table_name, column_name, role FROM roles_{t}" for t in _ROLE_TABLES
    ),
    "quantiles_lineitem": f"{_LINES} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(quantile_cont({f}, 0.01), 4) AS p01, round(quantile_cont({f}, 0.25), 4) AS q1, "
        f"round(quantile_cont({f}, 0.5), 4) AS median, round(quantile_cont({f}, 0.75), 4) AS q3, round(quantile_cont({f}, 0.99), 4) AS p99 FROM lines"
        for f in LINES
    ),
    "value_frequencies": f"{with_('dirty', 'dirty_orders')} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS freq FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("status", "priority", "channel")
    ),
    "quality_before_after": f"""{_REPAIR}, {facts('dirty', _DIRTY)}
SELECT 'before' AS stage, * FROM {_DATASET} UNION ALL
SELECT 'after', count(*), 9, round(100 * (1 - sum((o_custkey IS NULL)::INT + (status IS NULL)::INT + (total IS NULL)::INT + (paid IS NULL)::INT
  + (placed IS NULL)::INT) / (count(*) * 9)), 3), 100.0, 100.0, 0 FROM repaired""",
    "parse_currency": f"WITH t AS ({CURRENCY_TEXT}) SELECT o_orderkey, {num('amount')} AS amount FROM t",
    "parse_dates": f"{with_('contacts', 'contacts')} SELECT contact_id, printf('2024-%02d-%02d', 1 + contact_id % 12, 1 + contact_id % 28) AS signup FROM contacts",
    "title_names": f"{with_('contacts', 'contacts')} SELECT contact_id, {title('full_name')} AS full_name FROM contacts",
    "digamma_sizes": f"SELECT l_orderkey, round({_PSI.format('n')}, 6) AS digamma FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)",
    "repair_trim_sentinels": f"{with_('dirty', 'dirty_orders')}, {_TRIMMED} SELECT * FROM trimmed",
    "repair_rows": f"{_REPAIR} SELECT * FROM repaired",
    "repair_again": f"{_REPAIR} SELECT * FROM repaired",
    "repair_drop_constants": f"{_REPAIR} SELECT * EXCLUDE (channel) FROM repaired",
    "repair_log": f"""{_REPAIR}, c AS (SELECT count(*) AS n, count(*) FILTER (status <> trim(status)) AS cut,
  count(*) FILTER (status = 'N/A') + count(*) FILTER (paid = '-') AS words, (SELECT count(*) FROM repaired) AS left_ FROM dirty)
SELECT 'trim_whitespace' AS step, cut || ' string cells trimmed' AS detail, n AS rows_before, n AS rows_after, 10 AS cols_before, 10 AS cols_after FROM c
UNION ALL SELECT 'normalise_missing_sentinels', words || ' sentinel strings to NULL', n, n, 10, 10 FROM c
UNION ALL SELECT 'drop_empty_columns', 'dropped notes', n, n, 10, 9 FROM c
UNION ALL SELECT 'drop_constant_columns', 'dropped channel', n, n, 9, 8 FROM c
UNION ALL SELECT 'drop_duplicate_rows', 'removed ' || (n - left_) || ' exact duplicate rows', n, left_, 8, 8 FROM c
UNION ALL SELECT 'cast_types', '{_CASTS}', left_, left_, 8, 8 FROM c""",
    "standard_fields": f"""{with_('contacts', 'contacts')}, {_CONTACT_TIDY} SELECT * REPLACE (round(age, 4) AS age, round(unit_price, 4) AS unit_price) FROM tidy""",
    "standard_steps": f"""{with_('contacts', 'contacts')} SELECT row_number() OVER (ORDER BY o) AS position, step FROM ({_steps_sql()})""",
    "fill_gaps": f"""{_LINES} SELECT {', '.join(IDS)}, label, round(coalesce(quantity, (SELECT median(quantity) FROM lines)), 4) AS quantity,
  round(price, 4) AS price, round(coalesce(discount, (SELECT median(discount) FROM lines)), 4) AS discount, round(tax, 4) AS tax,
  (quantity IS NULL)::INT AS quantity__was_missing, (discount IS NULL)::INT AS discount__was_missing FROM lines""",
    "fill_modes": f"{with_('dirty', 'dirty_orders')}, {_TRIMMED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {mode_of(c, 'trimmed')} AS mode" for c in ("status", "placed", "paid", "priority")
    ),
    "clean_contacts": f"""{with_('contacts', 'contacts')}, {_CONTACT_TIDY} SELECT CAST(contact_id AS VARCHAR) AS contact_id, full_name,
  coalesce(email, {mode_of('email', 'tidy')}) AS email, country, round(coalesce(age, (SELECT median(age) FROM tidy)), 4) AS age, product_category,
  round(coalesce(unit_price, (SELECT median(unit_price) FROM tidy)), 4) AS unit_price, signup_date, (email IS NULL)::INT AS email__was_missing,
  (age IS NULL)::INT AS age__was_missing, (unit_price IS NULL)::INT AS unit_price__was_missing FROM tidy""",
    "clean_metrics": f"""{with_('contacts', 'contacts')}, {_CONTACT_TIDY} SELECT count(*) AS input_rows, 8 AS input_columns, count(*) AS output_rows,
  11 AS output_columns, 0 AS duplicate_rows_in_input, 0 AS duplicate_rows_removed,
  3 * count(*) - count(email) - count(age) - count(unit_price) AS missing_filled, 100::DOUBLE AS completeness_before, 100::DOUBLE AS completeness_after,
  'trim_whitespace; cast_types; ' || (SELECT string_agg(step, '; ' ORDER BY o) FROM ({_steps_sql()})) AS steps FROM tidy""",
    "plan_decisions": f"""{with_('dirty', 'dirty_orders')}, {facts('dirty', _DIRTY)}
SELECT column_name, CASE WHEN role IN ('numeric', 'categorical') AND pct_missing < 60 THEN role ELSE 'drop' END AS action,
  CASE role WHEN 'empty' THEN 'without a value' WHEN 'constant' THEN 'the same value everywhere' WHEN 'identifier' THEN 'names rows instead of describing them'
    WHEN 'text' THEN n_unique || ' different texts, which no step here turns into numbers' WHEN 'datetime' THEN 'a point in time: make features of it first'
    WHEN 'numeric' THEN 'numbers, ' || CASE WHEN skew IS NULL OR abs(skew) > 0.5 THEN 'lopsided' ELSE 'even on both sides' END
      || CASE WHEN pct_missing >= 5 THEN printf('; %.0f%% gaps', CAST(pct_missing AS DOUBLE)) ELSE '' END
    ELSE n_unique || ' levels' END AS reason,
  CASE WHEN role = 'numeric' THEN CASE WHEN skew IS NULL OR abs(skew) > 0.5 THEN 'median' ELSE 'mean' END
    WHEN role = 'categorical' THEN 'most_frequent' ELSE 'none' END AS impute, role = 'numeric' AND pct_missing >= 5 AS add_indicator
FROM rep WHERE column_name <> 'priority'""",
    "plan_notes": f"""{with_('dirty', 'dirty_orders')}, {facts('dirty', _DIRTY)}, notes AS (
  SELECT pos, printf('%s: %d far values (%.1f%%) stay, robust scaling bears them', column_name, n_extreme, CAST(pct_extreme AS DOUBLE)) AS note
  FROM rep WHERE role = 'numeric' AND pct_extreme > 0 AND column_name <> 'priority'
  UNION ALL SELECT 99, n_duplicate_rows || ' copies of rows go in the structural repair' FROM {_DATASET} WHERE n_duplicate_rows > 0)
SELECT row_number() OVER (ORDER BY pos) AS position, note FROM notes""",
    "plan_transform": f"""{_LINES}, {_PLAN_FILL}, imp AS (SELECT label, coalesce(quantity, qf) AS quantity, price, coalesce(discount, df) AS discount,
  (quantity IS NULL)::DOUBLE AS mq, (discount IS NULL)::DOUBLE AS md FROM lines, fills),
s AS ({scaled('imp', ['quantity', 'price', 'discount', 'mq', 'md'], 'robust', ['label'])})
SELECT quantity, price, discount, mq AS missingindicator_quantity, md AS missingindicator_discount, (label = 'A')::DOUBLE AS "label_A",
  (label = 'N')::DOUBLE AS "label_N", (label = 'R')::DOUBLE AS "label_R" FROM s""",
    "plan_rare_levels": """WITH raw AS (SELECT p_partkey, CASE WHEN p_partkey % 150 = 0 THEN concat('odd', CAST(p_partkey // 150 % 4 AS VARCHAR)) ELSE p_type END AS kind FROM part),
levels AS (SELECT kind, count(*) < 0.01 * (SELECT count(*) FROM raw WHERE kind <> 'odd2') AS rare FROM raw WHERE kind <> 'odd2' GROUP BY kind)
SELECT p_partkey, """ + ", ".join(
        f"(kind = '{t}')::DOUBLE AS kind_{t.lower()}" for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    ) + """, (kind IN (SELECT kind FROM levels WHERE rare))::DOUBLE AS kind_infrequent FROM raw""",
    "plan_export": f"""{_LINES}, {_PLAN_FILL} SELECT label, round(coalesce(quantity, qf), 4) AS quantity, round(price, 4) AS price,
  round(coalesce(discount, df), 4) AS discount, round(tax, 4) AS tax, (discount IS NULL)::INT AS discount__was_missing FROM lines, fills""",
    "terrain": " UNION ALL ".join(
        [_terrain("lines", "lines", LINES), _terrain("accounts", "accounts", ACCOUNTS), _terrain("vectors", "vectors", EMB)]
    ),
    "impute_mean": f"{_LINES}, {filled('lines', LINES, 'avg({0})', [*IDS, 'label'])} SELECT {', '.join(IDS)}, label, {rnd(LINES)} FROM imp",
    "impute_median": f"{_LINE_MEDIAN} SELECT {', '.join(IDS)}, label, {rnd(LINES)} FROM imp",
    "impute_most_frequent": f"{_LINES} SELECT {', '.join(IDS)}, label, "
    + ", ".join(f"round(coalesce({f}, {mode_of(f, 'lines')}), 4) AS {f}" for f in LINES) + " FROM lines",
    "impute_nearest": f"{_knn_parts()} SELECT p_partkey, label, {rnd(PARTS)} FROM imp",
    "variance_features": f"{_LINE_MEDIAN} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature FROM imp HAVING var_pop({f}) > 0" for f in LINES
    ) + " UNION ALL SELECT 'flat' FROM imp HAVING var_pop(3.0) > 0",
    "rows_iqr": f"{_LINE_MEDIAN}, {iqr_keep('imp', LINES)}, {_GUARD} SELECT {', '.join(IDS)}, label, {rnd(LINES)} FROM kept",
    "rows_zscore": f"{_LINE_MEDIAN}, {z_keep('imp', LINES)}, {_GUARD} SELECT {', '.join(IDS)}, label, {rnd(LINES)} FROM kept",
    "rows_guard": f"""{with_('parts', 'parts')}, t AS (SELECT label, CASE WHEN label = 'small' THEN 1000000.0 ELSE weight END::DOUBLE AS spread FROM parts),
  {iqr_keep('t', ['spread'])}, {_GUARD} SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM kept) AS kept, whole AS guarded FROM guard""",
    "scale_standard": f"{_LINE_MEDIAN} {scaled('imp', LINES, 'standard', [*IDS, 'label'])}",
    "scale_minmax": f"{_LINE_MEDIAN} {scaled('imp', LINES, 'minmax', [*IDS, 'label'])}",
    "scale_robust": f"{_LINE_MEDIAN} {scaled('imp', LINES, 'robust', [*IDS, 'label'])}",
    "oversample_accounts": _SMOTE,
    "impute_iterative_lines": _ITERATIVE,
    "mutual_info_scores": _MI,
    "enhance_phalanx": f"{_LINE_MEDIAN}, {iqr_keep('imp', LINES)}, {_GUARD}, s AS ({scaled('kept', LINES, 'standard', ['label'])}) SELECT *, 'original' AS _row_origin FROM s",
    "enhance_reconnaissance": f"{_LINES}, {filled('lines', LINES, 'avg({0})', ['label'])} SELECT {rnd(LINES)}, label, 'original' AS _row_origin FROM imp",
    "enhance_siege": f"{_knn_parts()}, s AS ({scaled('imp', PARTS, 'minmax', ['label'])}) SELECT *, 'original' AS _row_origin FROM s",
    "enhance_metrics": " UNION ALL ".join([
        _enhance_metric("phalanx", iqr_keep("imp", ACCOUNTS), "impute; outliers; scale", 6),
        _enhance_metric("guerrilla", None, "impute; smote; scale", 6,
                        "(SELECT CAST(max(c) * count(*) - sum(c) AS BIGINT) FROM (SELECT count(*) AS c FROM accounts GROUP BY label))"),
        _enhance_metric("reconnaissance", None, "impute", 6),
        _enhance_metric("heavy_cavalry", z_keep("imp", ACCOUNTS), "impute; outliers; scale; pca", 6),
    ]),
    "folds_lineitem": f"""{_LINES} SELECT {', '.join(IDS)}, label, CAST((row_number() OVER (PARTITION BY label ORDER BY
  {h52("'42'", *IDS)}, {', '.join(IDS)}) - 1) % 3 AS INT) AS fold FROM lines""",
    "sample_accounts": f"""{with_('accounts', 'accounts')}, e AS (SELECT label, count(*) * 300 / sum(count(*)) OVER () AS exact, sum(count(*)) OVER () AS n FROM accounts GROUP BY label),
f AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, label) AS place, 300 - sum(floor(exact)) OVER () AS spare FROM e),
r AS (SELECT c_custkey, label, row_number() OVER (PARTITION BY label ORDER BY {h52("'42'", 'c_custkey')}, c_custkey) AS r FROM accounts)
SELECT c_custkey, label FROM r JOIN f USING (label) WHERE n <= 300 OR r <= floor(exact) + CASE WHEN place <= spare THEN 1 ELSE 0 END""",
    "retention_lines": _RETAIN,
    "index_components": """SELECT l_suppkey, round(simple, 6) AS simplicity, round(0.40 * a + 0.25 * s + 0.20 * r + 0.15 * simple, 6) AS sei FROM (
  SELECT l_suppkey, avg((l_returnflag = 'R')::DOUBLE) AS a, avg((l_linestatus = 'O')::DOUBLE) AS r, 1 - stddev_pop(l_discount) AS s,
  1::DOUBLE / (1 + 0.05::DOUBLE * abs(max(l_linenumber) - 11)) AS simple FROM lineitem GROUP BY l_suppkey)""",
    "noise_cells": f"{with_('accounts', 'accounts')} SELECT c_custkey, " + ", ".join(
        f"""round({f} + 0.01::DOUBLE * sqrt(-2 * ln(1 - {u01("'r'", "'42'", "'1'", f"'{f}'", 'c_custkey')})) * cos(2 * pi() * {u01("'a'", "'42'", "'1'", f"'{f}'", 'c_custkey')}), 6) AS {f}"""
        for f in ("visits", "score")
    ) + " FROM accounts",
    "history_update": f"""WITH {_REWARDS} SELECT signature, recipe, count(*) * CASE WHEN recipe = 'siege' THEN 2 ELSE 3 END AS n,
  round(avg(reward), 8) AS mean FROM rewards GROUP BY signature, recipe""",
    "history_recommend": f"""WITH {_REWARDS} SELECT recipe, round(avg(reward), 4) AS mean_reward, count(*) AS n_runs,
  round(1 - 1 / (1 + count(*)), 3) AS confidence FROM rewards WHERE signature = 'sig:1' GROUP BY recipe""",
    "history_select": f"""WITH {_REWARDS} SELECT 'sig:0' AS signature, recipe, 'exploit prior knowledge (' || count(*) || ' runs)' AS reason FROM rewards
  WHERE signature = 'sig:0' GROUP BY recipe ORDER BY avg(reward) DESC LIMIT 1""",
    "ragged_csv": """SELECT o_orderkey, CASE kind WHEN 40 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS order_key,
  CASE kind WHEN 40 THEN NULL WHEN 41 THEN 'Mar-1-2024' ELSE '2024-01-02' END AS order_date,
  CASE kind WHEN 40 THEN NULL WHEN 53 THEN o_orderstatus || ', "x"' ELSE o_orderstatus END AS status,
  CASE WHEN kind NOT IN (40, 43) THEN o_orderpriority END AS priority,
  CASE WHEN kind NOT IN (40, 43) THEN CAST(o_custkey AS VARCHAR) END AS customer, kind IN (40, 41, 43) AS repaired
FROM (SELECT *, CASE WHEN o_orderkey % 40 = 0 THEN 40 WHEN o_orderkey % 41 = 0 THEN 41 WHEN o_orderkey % 43 = 0 THEN 43
  WHEN o_orderkey % 47 = 0 THEN 47 WHEN o_orderkey % 53 = 0 THEN 53 ELSE 0 END AS kind FROM orders) WHERE kind <> 47""",
    "ragged_csv_rejects": f"""WITH t AS ({CSV_LINES}) SELECT o_orderkey, CAST(len(string_split(line, ',')) AS INT) AS fields_found FROM t WHERE line LIKE '%,a,b,c,d,e'""",
    "csv_files": """SELECT o_orderkey AS order_id, concat(o_orderstatus, chr(10), '"', o_custkey, '", so') AS note,
  CASE WHEN o_orderkey % 41 = 0 THEN 'Mar-7-2024' ELSE '2024-01-02' END AS order_date,
  CASE WHEN o_orderkey % 43 <> 0 OR o_orderkey % 41 = 0 THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 47 <> 0""",
    "csv_file_rejects": f"""SELECT line, CAST(CASE WHEN o_orderkey % 41 = 0 THEN 8 ELSE 7 END AS INT) AS fields_found, CAST(4 AS INT) AS fields_expected
FROM ({CSV_FILE_LINES}) WHERE o_orderkey % 47 = 0""",
    "sink_round_trip": """SELECT sink, c_custkey, concat(c_name, chr(10), '"said"') AS c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal
FROM customer, (VALUES ('csv'), ('json'), ('parquet')) AS s(sink)""",
    "history_store": f"""WITH {_REWARDS} SELECT signature, recipe, count(*) AS n, round(avg(reward), 8) AS mean FROM rewards GROUP BY signature, recipe""",
    "typed_columns": f"""{with_('dirty', 'dirty_orders')} SELECT CASE WHEN bool_and(regexp_matches(paid, '^[0-9]+$')) THEN 'bigint' ELSE 'string' END AS paid_type,
  CASE WHEN bool_or(regexp_matches(zip, '^0[0-9]+$')) THEN 'string' ELSE 'bigint' END AS zip_type, 'bigint' AS code_type, 'double' AS amount_type,
  CAST(sum(o_orderkey) AS BIGINT) AS code_sum, sum(o_custkey + 0.5::DOUBLE) AS amount_sum FROM dirty""",
    "preview_rows": """SELECT o_orderkey, o_orderstatus, o_totalprice, (SELECT count(*) > 6 FROM orders) AS truncated FROM orders ORDER BY o_orderkey LIMIT 6""",
    "scoreboard_counts": f"""WITH c AS (SELECT CAST(l_suppkey % 8 AS INT) AS idx, l_linenumber % 3 AS fold, count(*) AS n, count(*) FILTER (l_discount >= 0.05) AS ok
  FROM lineitem GROUP BY ALL),
a AS (SELECT idx, avg(ok / n) AS accuracy, 1 - stddev_pop(ok / n) AS stability, 1 - idx / 16 AS retention, 1 / (1 + 0.05 * idx) AS simplicity, idx = 6 AS failed
  FROM c GROUP BY idx),
s AS (SELECT *, CASE WHEN failed THEN 0 ELSE 0.4 * accuracy + 0.25 * stability + 0.2 * retention + 0.15 * simplicity END AS sei FROM a)
SELECT CAST(row_number() OVER (ORDER BY sei DESC, idx) AS INT) AS rank, {_RECIPE_LIST}[idx + 1] AS recipe, round(sei::DOUBLE, 4) AS sei,
  round(CASE WHEN failed THEN 0 ELSE accuracy END::DOUBLE, 4) AS accuracy, round(CASE WHEN failed THEN 0 ELSE stability END::DOUBLE, 4) AS stability,
  round(retention::DOUBLE, 3) AS retention, round(simplicity::DOUBLE, 3) AS simplicity, CASE WHEN failed THEN 'failed' ELSE '' END AS error FROM s""",
    "validation_checks": f"{_LINES} " + " UNION ALL ".join([
        _checks("fine", "lines", "label", 5, 4),
        _checks("continuous", "lineitem", "l_extendedprice", 2, 1, "l_extendedprice <> floor(l_extendedprice)"),
        _checks("gaps", "lines", "quantity", 2, 1), _checks("no_numbers", "lineitem", "l_returnflag", 2, 0),
        "SELECT 'absent', 1, 'columns', true, 2.0::DOUBLE, '' UNION ALL SELECT 'absent', 2, 'target_exists', false, 0.0::DOUBLE, 'target column not found: nothing'",
    ]),
    "chosen_features": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "encoded_labels": """SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label, count(*) AS n FROM orders GROUP BY o_orderpriority""",
    "routes": f"""{_LINES}, contacts AS ({planted_sql('contacts')}), parts AS ({planted_sql('parts')})
SELECT 'lines' AS table_name, CASE WHEN min(c) >= 3 AND count(*) >= 2 THEN 'ranked' ELSE 'cleaned' END AS route FROM (SELECT count(*) AS c FROM lines GROUP BY label)
UNION ALL SELECT 'contacts', CASE WHEN min(c) >= 3 AND count(*) >= 2 THEN 'ranked' ELSE 'cleaned' END FROM (SELECT count(*) AS c FROM contacts GROUP BY email)
UNION ALL SELECT 'parts', CASE WHEN min(c) >= 3 AND count(*) >= 2 THEN 'ranked' ELSE 'cleaned' END FROM (SELECT count(*) AS c FROM parts GROUP BY label)""",
}
