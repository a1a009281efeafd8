"""Query registry and the shared SQL building blocks of the oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query; `sql` may use the common table expressions named in `ctes`."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return fn

    return add


def seed32(*parts: str) -> str:
    """SQL for the 32-bit stable seed of the given SQL expressions."""
    return f"cast(concat('0x', substr(sha1(concat_ws('|', {', '.join(parts)})), 1, 8)) as bigint)"


def uniform(*parts: str) -> str:
    return f"(({seed32(*parts)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def normal(*parts: str) -> str:
    u, v = uniform(*parts, "'u'"), uniform(*parts, "'v'")
    return f"(sqrt(-2.0::DOUBLE * ln({u})) * cos(6.283185307179586::DOUBLE * {v}))"


def double(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


def score_points(name: str, source: str, keys: str, score: str, pos: str = "sum(label)", neg: str = "sum(1 - label)") -> str:
    """CTEs `<name>0` and `<name>`: distinct scores with running totals, in ascending order."""
    return f"""{name}0 AS (SELECT {keys}, {score} AS score, cast({pos} AS bigint) AS pos, cast({neg} AS bigint) AS neg
      FROM {source} GROUP BY {keys}, {score}),
    {name} AS (SELECT *,
      cast(coalesce(sum(pos) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS pos_before,
      cast(coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS neg_before,
      cast(sum(pos) OVER (PARTITION BY {keys}) AS bigint) AS pos_total,
      cast(sum(neg) OVER (PARTITION BY {keys}) AS bigint) AS neg_total,
      lag(pos) OVER (PARTITION BY {keys} ORDER BY score) AS pos_prev,
      lag(neg) OVER (PARTITION BY {keys} ORDER BY score) AS neg_prev
      FROM {name}0)"""


AUC = "sum(pos * (neg_before + neg / 2.0::DOUBLE)) / nullif(max(pos_total)::DOUBLE * max(neg_total)::DOUBLE, 0)"


def eer_ctes(name: str, points: str, keys: str) -> str:
    """CTE `<name>` (keys, eer, threshold) from score points: walk the ROC curve from the highest score,
    straight stretches removed, and interpolate at the first point with FNR <= FPR."""
    return f"""{name}_roc AS (
      SELECT {keys}, score AS thr, (neg_total - neg_before)::DOUBLE / neg_total AS fpr,
             1.0::DOUBLE - (pos_total - pos_before)::DOUBLE / pos_total AS fnr
      FROM {points} WHERE pos_total > 0 AND neg_total > 0
        AND (pos_prev IS NULL OR pos <> pos_prev OR neg <> neg_prev
             OR (pos_before + pos = pos_total AND neg_before + neg = neg_total))
      UNION ALL
      SELECT DISTINCT {keys}, 'inf'::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM {points} WHERE pos_total > 0 AND neg_total > 0),
    {name}_lag AS (
      SELECT *, lag(fpr) OVER w AS p_fpr, lag(fnr) OVER w AS p_fnr, lag(thr) OVER w AS p_thr FROM {name}_roc
      WINDOW w AS (PARTITION BY {keys} ORDER BY thr DESC)),
    {name}_first AS (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY thr DESC) AS rn FROM {name}_lag WHERE fnr - fpr <= 0),
    {name}_w AS (SELECT *, (p_fnr - p_fpr) / ((p_fnr - p_fpr) - (fnr - fpr)) AS w FROM {name}_first WHERE rn = 1),
    {name} AS (
      SELECT {keys}, p_fpr + w * (fpr - p_fpr) AS eer,
             CASE WHEN isinf(p_thr) THEN thr ELSE p_thr + w * (thr - p_thr) END AS threshold
      FROM {name}_w)"""


CTES: dict[str, str] = {}

CTES["fx_windows"] = """fx_windows AS (
  SELECT l_orderkey AS item, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
    o_custkey AS speaker_id, r_name AS dataset_id, strftime(o_orderdate, '%Y-%m-%d') AS text_group,
    CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END AS label,
    floor((l_extendedprice / 10000 - l_quantity * l_discount) * 1024) / 1024 AS logit,
    floor((l_extendedprice / 10000 + l_quantity * l_tax) * 1024) / 1024 AS logit_b,
    l_discount AS pad_fraction,
    CASE WHEN r_name = 'ASIA' THEN 'external_A' WHEN r_name = 'EUROPE' THEN 'external_B'
         WHEN h % 10 < 6 THEN 'train' WHEN h % 10 < 8 THEN 'validation' ELSE 'internal_test' END AS split
  FROM (SELECT *, cast(concat('0x', substr(md5(cast(o_custkey AS varchar)), 1, 8)) AS bigint) AS h FROM orders) o
  JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CTES["fx_scores"] = """fx_scores AS (
  SELECT item, min(label) AS label, min(dataset_id) AS dataset_id, min(speaker_id) AS speaker_id,
    min(text_group) AS text_group, min(split) AS split, avg(logit) AS score, avg(logit_b) AS score_b,
    count(*) AS n_windows, max(pad_fraction) AS max_pad_fraction,
    CASE WHEN min(dataset_id) = 'ASIA' THEN concat('SPK:', min(speaker_id)) ELSE concat('SEN:', min(text_group)) END AS cluster
  FROM fx_windows GROUP BY item)"""

CTES["pts"] = score_points("pts", "fx_scores", "split", "score")
CTES["eers"] = eer_ctes("eers", "pts", "split")
CTES["thr"] = "thr AS (SELECT threshold AS thr FROM eers WHERE split = 'validation')"

CTES["fx_signal"] = """fx_signal AS (
  SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value + 0.0 AS v,
    user_id % 2 AS label, user_id % 3 AS dataset_id FROM events)"""

CTES["fx_docs"] = """fx_docs AS (
  SELECT d.doc_id AS item, l.toxic AS label, l.quality AS quality, lang, source, n_chars, text, sha256(text) AS h
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# every line item of every brand is one scored item of one run
CTES["fx_runs"] = f"""fx_runs AS (
  SELECT replace(p_brand, 'Brand#', 'model') AS model, CASE l_linestatus WHEN 'O' THEN 'P1' ELSE 'P2' END AS protocol,
    CASE {seed32("cast(l_suppkey AS varchar)")} % 3 WHEN 0 THEN 42 WHEN 1 THEN 123 ELSE 2026 END AS seed,
    CASE l_returnflag WHEN 'A' THEN 'internal_test' WHEN 'N' THEN 'external_A' ELSE 'external_B' END AS split,
    CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS label,
    floor((l_extendedprice / 10000 - l_quantity * l_discount) * 1024) / 1024 AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

DEPENDS = {
    "fx_scores": ("fx_windows",),
    "pts": ("fx_scores",),
    "eers": ("pts",),
    "thr": ("eers",),
}


def with_ctes(sql: str, *names: str) -> str:
    done: list[str] = []

    def need(n):
        for d in DEPENDS.get(n, ()):
            need(d)
        if n not in done:
            done.append(n)

    for n in names:
        need(n)
    if not done:
        return sql.strip()
    head = "WITH " + ",\n".join(CTES[n] for n in done)
    body = sql.strip()
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head}\n{body}"
