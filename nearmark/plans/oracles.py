"""SQL twins of the registered queries, over the same tables."""

from __future__ import annotations

from nearmark.functions.scalars import REPORT_PERCENTILES, percentile_column

R = """r AS (
  SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5)) AS v, label,
    label % 2 AS namespace,
    CASE WHEN vec_id % 17 <> 0 THEN [label::VARCHAR, 'm' || (vec_id % 3)] END AS tags,
    CASE WHEN vec_id % 3 = 0 THEN NULL
         WHEN vec_id % 3 = 1 THEN [CASE WHEN vec_id % 23 = 0 THEN '99' ELSE label::VARCHAR END]
         ELSE [CASE WHEN vec_id % 23 = 0 THEN '99' ELSE label::VARCHAR END, 'm1'] END AS required,
    ntile(4) OVER (ORDER BY vec_id) AS step
  FROM embeddings)"""
DISTANCE = {
    "cosine": "list_cosine_distance(q.v, r.v)",
    "euclidean": "list_distance(q.v, r.v)",
    "dotproduct": "-list_inner_product(q.v, r.v)",
}
ALLOWED = "(q.required IS NULL OR len(list_filter(q.required, lambda x: NOT list_contains(coalesce(r.tags, []), x))) = 0)"
SHOWN = "query_id, rank::INTEGER AS rank, id, {d} AS distance"


def rounded(expr: str, places: int = 6) -> str:
    return f"CASE WHEN abs({expr}) < {0.5 * 10**-places!r} THEN 0.0::DOUBLE ELSE round(({expr})::DOUBLE, {places}) END"


def _knn(name: str, metric: str, k: str = "10", on: str = "true") -> str:
    """CTE ``name``: query_id, rank, id, dist."""
    return f"""{name} AS (SELECT * FROM (
  SELECT q.id AS query_id, r.id AS id, {DISTANCE[metric]} AS dist, {k} AS k,
    row_number() OVER (PARTITION BY q.id ORDER BY {DISTANCE[metric]}, r.id) AS rank
  FROM r q JOIN r ON {on}) WHERE rank <= k)"""


def _shown_knn(metric: str, k: str = "10", on: str = "true") -> str:
    shown = SHOWN.format(d=rounded("dist"))
    return f"WITH {R}, {_knn('n', metric, k, on)} SELECT {shown} FROM n"


EUCLIDEAN = _shown_knn("euclidean")
FILTERED = _shown_knn("euclidean", on=ALLOWED)

CENTROIDS = """c AS (
  SELECT label AS list_id, list(m ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM r) GROUP BY label, pos)
  GROUP BY label)"""
ASSIGNED = """a AS (SELECT id, v, list_id FROM (
  SELECT r.id, r.v, c.list_id, row_number() OVER (PARTITION BY r.id ORDER BY list_distance(r.v, c.v), c.list_id) AS n
  FROM r, c) WHERE n = 1)"""
PROBED = """p AS (SELECT r.id AS query_id, r.v, c.list_id,
  row_number() OVER (PARTITION BY r.id ORDER BY list_distance(r.v, c.v), c.list_id) AS probe FROM r, c)"""
IVF = f"WITH {R}, {CENTROIDS}, {ASSIGNED}, {PROBED}"

# Results by dot product (10), truth by Euclidean distance (13, cut to 10).
LISTS = f"""WITH {R}, {_knn('an', 'dotproduct')}, {_knn('en', 'euclidean', '13')},
l AS (SELECT query_id, a, e, e[1:10] AS e10 FROM
  (SELECT query_id, list(id ORDER BY rank) AS a FROM an GROUP BY 1)
  JOIN (SELECT query_id, list(id ORDER BY rank) AS e FROM en GROUP BY 1) USING (query_id)),
s AS (SELECT query_id,
  len(list_intersect(a, e10)) / len(e10) AS recall,
  list_sum(list_transform(range(1, len(a) + 1), lambda i: len(list_intersect(a[1:i], e10[1:i])) / i)) / len(a) AS average_precision,
  coalesce(1.0 / list_min(list_transform(list_intersect(a, e10), lambda x: list_position(a, x))), 0.0) AS reciprocal_rank
  FROM l)"""
METRICS = ("recall", "average_precision", "reciprocal_rank")
SCORES = f"{LISTS} SELECT query_id, {', '.join(f'{rounded(m)} AS {m}' for m in METRICS)} FROM s"
SCORE_LONG_CTE = ", sl AS (" + " UNION ALL ".join(
    f"SELECT query_id, '{m}' AS metric, {m} AS value FROM s" for m in METRICS
) + ")"


def _summary(source: str, keys: str, value: str) -> str:
    """Summary of a (keys, value) relation at a resolution of one thousandth."""
    ranks = ", ".join(
        f"max(CASE WHEN rk = greatest(1, (n * {bp} + 9999) // 10000) THEN b END) / 1000.0::DOUBLE AS {percentile_column(bp)}"
        for bp in REPORT_PERCENTILES
    )
    return f"""(SELECT {keys}, count(*) AS count, min(b) / 1000.0::DOUBLE AS min, {ranks},
  max(b) / 1000.0::DOUBLE AS max, avg(b) / 1000.0::DOUBLE AS mean FROM (
  SELECT {keys}, b, row_number() OVER (PARTITION BY {keys} ORDER BY b) AS rk, count(*) OVER (PARTITION BY {keys}) AS n
  FROM (SELECT {keys}, floor({value} * 1000)::BIGINT AS b FROM {source})) GROUP BY {keys})"""


SUMMARY = ["min", *[percentile_column(bp) for bp in REPORT_PERCENTILES], "max", "mean"]
SHOWN_SUMMARY = ", ".join(f"{rounded(c)} AS {c}" for c in SUMMARY)

LOG = """log AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'Search' WHEN 'signup' THEN 'Insert'
  WHEN 'click' THEN 'Update' WHEN 'purchase' THEN 'Fetch' ELSE 'Delete' END AS request_type, ts, user_id,
  value AS response_time, value > 200 AS failed, json_extract(props, '$.k')::BIGINT AS k FROM events)"""
LONG = """lm AS (SELECT request_type, 'recall' AS metric, k / 100.0::DOUBLE AS value FROM log WHERE request_type = 'Search'
  UNION ALL SELECT request_type, 'reciprocal rank', 1.0::DOUBLE / (1 + k % 10) FROM log WHERE request_type = 'Search')"""
OPS = """ops AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'search' WHEN 'signup' THEN 'insert'
  WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'fetch' ELSE 'delete' END AS op, user_id AS id, value FROM events)"""
BASE = "base AS (SELECT id, arg_max(value, seq) AS value FROM ops WHERE op = 'insert' GROUP BY id)"
NEW = "fresh AS (SELECT id, arg_max(value, seq) AS value FROM ops WHERE op = 'update' GROUP BY id)"
LATENCY = f"""(SELECT request_type, min(response_time) AS min,
  {', '.join(f'any_value({percentile_column(bp)}) AS {percentile_column(bp)}' for bp in REPORT_PERCENTILES)},
  max(response_time) AS max, avg(response_time) AS mean FROM log
  JOIN (SELECT request_type, {', '.join(percentile_column(bp) for bp in REPORT_PERCENTILES)}
        FROM {_summary('log', 'request_type', 'response_time')}) USING (request_type) GROUP BY request_type)"""


def _replay(life: str, seen: str = "true") -> str:
    return f"""WITH {OPS}, w AS (SELECT * FROM ops WHERE op IN ('insert', 'update', 'delete') AND {seen}),
l AS (SELECT id, arg_max(op, seq) AS life FROM w WHERE op IN ({life}) GROUP BY id),
v AS (SELECT id, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value FROM w WHERE op <> 'delete' GROUP BY id)
SELECT id, seq, value FROM v JOIN l USING (id) WHERE life <> 'delete'"""


REPLAY = _replay("'insert', 'delete'")
VALIDITY = f"""{OPS}, st AS (SELECT * FROM (SELECT id, op, seq AS valid_from,
  lead(seq) OVER (PARTITION BY id ORDER BY seq) AS valid_to FROM ops WHERE op IN ('insert', 'update', 'delete'))
  WHERE op <> 'delete')"""


def _trailing(seconds: int) -> str:
    w = f"OVER (PARTITION BY request_type ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)"
    return f"""WITH {LOG} SELECT seq, request_type, count(*) {w} AS requests,
  {rounded(f'count(*) {w} / {seconds}.0::DOUBLE')} AS requests_per_s,
  quantile_disc(response_time, 0.5) {w} AS latency_p50, quantile_disc(response_time, 0.95) {w} AS latency_p95 FROM log"""


WINDOWS = f"""WITH {LOG}, wd AS (SELECT epoch_us(ts) // 1000000 - i AS window_start, request_type, response_time
  FROM log, range(10) t(i))
SELECT window_start::BIGINT AS window_start, request_type, count(*) AS requests,
  quantile_disc(response_time, 0.5) AS latency_p50, quantile_disc(response_time, 0.95) AS latency_p95
FROM wd GROUP BY window_start, request_type"""

WINDOW_RATE = f"""SELECT window_start::BIGINT AS window_start, count(*) AS requests, {rounded('count(*) / 10.0::DOUBLE')} AS requests_per_s
FROM (SELECT epoch_us(ts) // 1000000 - i AS window_start FROM events, range(10) t(i)) GROUP BY window_start"""

SESSIONS = """WITH g AS (SELECT user_id, epoch_us(ts) AS us,
    epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
h AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 21600000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY us) AS run FROM g),
s AS (SELECT user_id, run, count(*) AS requests, min(us) AS first_us, max(us) AS last_us FROM h GROUP BY 1, 2)
SELECT user_id, requests, first_us, last_us FROM s"""


# Sound records come first; then the damaged ones of least id.
DAMAGED = f"""WITH {R}, sound AS (SELECT * FROM r WHERE id % 3 = 0),
lost AS (SELECT max(id) AS last_lost FROM (SELECT id FROM r WHERE id % 3 <> 0 ORDER BY id LIMIT 5)),
d AS (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, q.id AS query_id, r.id AS id, {DISTANCE[m]} AS dist FROM r q, sound r" for m in DISTANCE
) + f""")
SELECT metric, query_id, count(*) + 5 AS found, 5::BIGINT AS damaged, count(*) + 1 AS first_damaged, any_value(last_lost) AS last_damaged,
  sum(id)::BIGINT AS sound_ids, {rounded('sum(dist)')} AS sound_distance FROM d, lost GROUP BY metric, query_id"""


def _batches(size: int, balanced: bool) -> str:
    batch = f"((i - 1) // {size} + 1)::INTEGER"
    if balanced:
        # Balanced: b batches; the first n % b of them have one row more.
        batch = """(CASE WHEN i <= (n % b) * (n // b + 1) THEN (i - 1) // (n // b + 1)
          ELSE (n % b) + (i - 1 - (n % b) * (n // b + 1)) // (n // b) END + 1)::INTEGER"""
    return f"""WITH c AS (SELECT o_orderkey, ntile(3) OVER (ORDER BY o_orderkey) AS chunk FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY chunk) AS n FROM c),
b AS (SELECT *, (n + {size} - 1) // {size} AS b FROM i)
SELECT o_orderkey, chunk::INTEGER AS chunk, {batch} AS batch FROM b"""


RELEVANT = f"WITH {R}, {_knn('n', 'dotproduct')}, rel AS (SELECT DISTINCT id FROM n)"

AS_OF = f"""WITH {VALIDITY}, e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
qs AS (SELECT seq, e.v FROM ops JOIN e USING (id) WHERE op = 'search'),
sv AS (SELECT st.id, valid_from, valid_to, list_transform(e.v, lambda x: x * (1 + valid_from % 5)) AS v FROM st JOIN e USING (id)),
n AS (SELECT qs.seq AS query_id, sv.id, sv.valid_from, -list_inner_product(qs.v, sv.v) AS dist,
  row_number() OVER (PARTITION BY qs.seq ORDER BY -list_inner_product(qs.v, sv.v), sv.id, sv.valid_from) AS rank
  FROM qs JOIN sv ON sv.valid_from <= qs.seq AND (sv.valid_to IS NULL OR qs.seq < sv.valid_to))
SELECT query_id, rank::INTEGER AS rank, id, valid_from, {rounded('dist')} AS distance FROM n WHERE rank <= 5"""

ORACLES: dict[str, str] = {
    "knn_cosine": _shown_knn("cosine"),
    "knn_euclidean": EUCLIDEAN,
    "knn_dotproduct": _shown_knn("dotproduct"),
    "knn_variable_k": _shown_knn("euclidean", "5 + q.id % 7"),
    "knn_bounded": EUCLIDEAN,
    "knn_grid": _shown_knn("cosine"),
    "knn_filtered": FILTERED,
    "knn_filtered_postings": FILTERED,
    "knn_filtered_bitmaps": FILTERED,
    "tag_bitmaps": f"""WITH {R}, s AS (SELECT DISTINCT list_sort(required) AS need FROM r WHERE required IS NOT NULL)
SELECT array_to_string(need, ',') AS tags, count(*)::BIGINT AS records FROM s
JOIN r ON len(list_filter(s.need, lambda x: NOT list_contains(coalesce(r.tags, []), x))) = 0 GROUP BY need""",
    "knn_pq_rerank": EUCLIDEAN,
    "knn_pq_recall": "SELECT t::INTEGER AS times, true AS recall_reached FROM (VALUES (4), (40)) v(t)",
    "knn_filtered_deep": f"""WITH {R} SELECT q.id AS query_id, least(100, count(r.id))::BIGINT AS found
FROM r q LEFT JOIN r ON {ALLOWED} GROUP BY q.id""",
    "knn_stepped": _shown_knn("cosine", on="r.step <= q.step"),
    "knn_namespaced": _shown_knn("euclidean", on="r.namespace = q.namespace"),
    "knn_overfetch": f"""WITH {R}, {_knn('n', 'euclidean', '20')},
m AS (SELECT n.query_id, n.id, list_cosine_distance(q.v, r.v) AS dist,
  row_number() OVER (PARTITION BY n.query_id ORDER BY list_cosine_distance(q.v, r.v), n.id) AS rank
  FROM n JOIN r ON r.id = n.id JOIN r q ON q.id = n.query_id)
SELECT {SHOWN.format(d=rounded('dist'))} FROM m WHERE rank <= 10""",
    "ivf_assignment": f"WITH {R}, {CENTROIDS}, {ASSIGNED} SELECT id, list_id FROM a",
    "knn_ivf_fixed_centroids": f"""{IVF}, n AS (SELECT p.query_id, a.id, list_distance(p.v, a.v) AS dist,
  row_number() OVER (PARTITION BY p.query_id ORDER BY list_distance(p.v, a.v), a.id) AS rank
  FROM p JOIN a USING (list_id) WHERE p.probe <= 3)
SELECT {SHOWN.format(d=rounded('dist'))} FROM n WHERE rank <= 10""",
    "ivf_probe_sweep": f"""{IVF}, {_knn('t', 'euclidean')},
n AS (SELECT probes, p.query_id, a.id,
  row_number() OVER (PARTITION BY probes, p.query_id ORDER BY list_distance(p.v, a.v), a.id) AS rank
  FROM p JOIN a USING (list_id) JOIN (SELECT unnest([1, 3, 10]) AS probes) ON p.probe <= probes)
SELECT probes::INTEGER AS probes, count(*) AS hits, {rounded('count(*) / (SELECT count(*) FROM t)')} AS recall
FROM n JOIN t USING (query_id, id) WHERE n.rank <= 10 GROUP BY probes""",
    "knn_as_of": AS_OF,
    "knn_as_of_tiles": AS_OF,
    "log_alive_at": f"""WITH {VALIDITY}, qs AS (SELECT seq FROM ops WHERE op = 'search')
SELECT qs.seq AS query_id, count(st.id)::BIGINT AS alive FROM qs
LEFT JOIN st ON st.valid_from <= qs.seq AND (st.valid_to IS NULL OR qs.seq < st.valid_to) GROUP BY 1""",
    "dataset_catalogue": """SELECT 'documents' AS name, count(*) AS records, 'cosine' AS metric FROM documents
UNION ALL SELECT 'pages', count(*), 'cosine' FROM pages UNION ALL SELECT 'embeddings', count(*), 'cosine' FROM embeddings""",
    "overwrite_guard": """SELECT (label % 2)::INTEGER AS namespace, count(*) AS kept, count(*) FILTER (vec_id % 2 = 0) AS replaced, true AS refused
FROM embeddings GROUP BY 1""",
    "score_registered": f"""{LISTS} SELECT query_id, {rounded('recall')} AS recall,
  coalesce(list_position(l.a, l.e10[1]), 0)::DOUBLE AS first_hit FROM s JOIN l USING (query_id)""",
    "stream_late_half": """WITH l AS (SELECT *, event_id < (SELECT (min(event_id) + max(event_id)) // 2 FROM events) AS early FROM events)
SELECT count(*) FILTER (NOT late) AS counted, count(*) FILTER (late)::BIGINT AS late_rows FROM (
  SELECT early AND date_trunc('second', ts) + INTERVAL 1 SECOND <= (SELECT max(date_trunc('millisecond', ts)) FROM l WHERE NOT early) - INTERVAL 60 SECOND AS late FROM l)""",
    "score_wide": SCORES,
    "score_long": f"{LISTS}{SCORE_LONG_CTE} SELECT query_id, metric, {rounded('value')} AS value FROM sl",
    "score_flat": SCORES,
    "recall_at_min": f"""{LISTS} SELECT query_id,
  {rounded('len(list_intersect(a, e[1:least(len(a), len(e))])) / least(len(a), len(e))')} AS recall FROM l""",
    "evaluation_summary": f"""{LISTS}{SCORE_LONG_CTE} SELECT 'Search' AS request_type, metric, count, {SHOWN_SUMMARY}
FROM {_summary('sl', 'metric', 'value')}""",
    "recall_gate": f"""{LISTS} SELECT 'Search' AS request_type, {rounded('p5')} AS reached, p5 >= 0.1 AS passed
FROM {_summary("(SELECT 'recall' AS metric, recall FROM s)", 'metric', 'recall')}""",
    "corpus_holes": f"{RELEVANT} SELECT id, label FROM r SEMI JOIN rel USING (id)",
    "corpus_cheese": f"{RELEVANT} SELECT id, label FROM r ANTI JOIN rel USING (id)",
    "drift_sequence": f"""{RELEVANT}, st AS (SELECT r.id, (rel.id IS NOT NULL)::INTEGER AS step FROM r LEFT JOIN rel USING (id)),
{_knn('f', 'cosine')}
SELECT step, count(DISTINCT st.id) AS records, count(f.query_id) AS answers FROM st LEFT JOIN f USING (id) GROUP BY step""",
    "id_suffix": """SELECT vec_id::VARCHAR AS id, label FROM embeddings
UNION ALL SELECT vec_id::VARCHAR || '_2', label FROM embeddings""",
    "chunk_split": "SELECT o_orderkey, o_custkey, (ntile(7) OVER (ORDER BY o_orderkey))::INTEGER AS chunk FROM orders",
    "batch_fixed": _batches(100, False),
    "batch_balanced": _batches(128, True),
    "batch_per_file": """SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 256 + 1)::INTEGER AS batch
FROM orders""",
    "cumulative_counts": """WITH s AS (SELECT ntile(7) OVER (ORDER BY o_orderkey) AS step FROM orders),
c AS (SELECT step, count(*) AS n FROM s GROUP BY step)
SELECT step::INTEGER AS step, n AS rows, (sum(n) OVER (ORDER BY step))::BIGINT AS rows_upto,
  (sum(n) OVER (ORDER BY step) - n)::BIGINT AS rows_before FROM c""",
    "filter_tags": f"WITH {R} SELECT id AS query_id, unnest(required) AS tag FROM r",
    "filter_predicate": f"WITH {R} SELECT id FROM r WHERE list_contains(tags, '3') AND list_contains(tags, 'm1')",
    "filter_errors": """SELECT vec_id AS query_id, label % 4 IN (1, 2) AS rejected,
  CASE WHEN label % 4 IN (0, 3) THEN 1::BIGINT END AS tags FROM embeddings""",
    "metadata_decode": f"WITH {R} SELECT id, CASE WHEN tags IS NOT NULL THEN label END AS label, tags[2] AS second_tag FROM r",
    "metadata_clean": """SELECT event_id, json_extract(props, '$.k')::BIGINT = 0 AS empty,
  nullif(json_extract(props, '$.k')::BIGINT, 0) AS k FROM events""",
    "dataset_profile": """SELECT 'embeddings' AS name, count(*) AS records, max(len(embedding))::INTEGER AS dims,
  'cosine' AS metric, count(*) AS requests FROM embeddings""",
    "contract_check": """SELECT 64 AS dims, 'cosine' AS metric, count(*) FILTER (len(embedding) <> 64) AS wrong_dims,
  count(*) FILTER (len(embedding) <> 64) = 0 AS valid FROM embeddings""",
    "completeness": "SELECT 1500::BIGINT AS expected, count(*) AS actual, count(*) >= 1500 AS complete FROM orders",
    "drop_null_columns": f"WITH {R} SELECT id, label, tags[1] AS first_tag FROM r",
    "head_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100",
    "records_gate": f"""WITH {R} SELECT id, len(v) AS dims,
  CASE WHEN tags IS NOT NULL THEN '{{"tags":["' || tags[1] || '","' || tags[2] || '"],"label":' || label || '}}' END AS metadata FROM r""",
    "queries_gate": f"""WITH {R} SELECT id, len(v) AS dims, 11 AS top_k,
  CASE len(required) WHEN 1 THEN '{{"tags": "' || required[1] || '"}}'
    WHEN 2 THEN '{{"$and": [{{"tags": "' || required[1] || '"}}, {{"tags": "m1"}}]}}' END AS filter, id AS best FROM r""",
    "namespaces": f"WITH {R} SELECT id, label FROM r WHERE namespace = 1",
    "layout_rewrite": "SELECT o_custkey % 10 AS slot, count(*) AS orders FROM orders GROUP BY 1",
    "log_insert_conflicts": f"""WITH {OPS}, {BASE}, b AS (SELECT id FROM ops WHERE op = 'update')
SELECT id FROM b GROUP BY id HAVING count(*) > 1 UNION SELECT id FROM b SEMI JOIN base USING (id)""",
    "log_upsert": f"WITH {OPS}, {BASE}, {NEW} SELECT * FROM base ANTI JOIN fresh USING (id) UNION ALL SELECT * FROM fresh",
    "log_update": f"""WITH {OPS}, {BASE}, {NEW} SELECT id, coalesce(fresh.value, base.value) AS value
FROM base LEFT JOIN fresh USING (id)""",
    "log_delete": f"""WITH {OPS}, {BASE} SELECT * FROM base ANTI JOIN
(SELECT id FROM ops WHERE op = 'delete' AND value > 100) USING (id)""",
    "log_fetch": f"""WITH {OPS}, {BASE} SELECT id, value, '{{}}' AS metadata FROM base SEMI JOIN
(SELECT id FROM ops WHERE op = 'search' AND value > 50) USING (id)""",
    **{f"log_fetch_{name}": f"""WITH {OPS}, {BASE} SELECT id, value FROM base SEMI JOIN
(SELECT id FROM ops WHERE op = 'search' AND value > {least}) USING (id)""" for name, least in (("keyed", 50), ("named", 200))},
    "log_replay": REPLAY,
    "log_replay_upsert": _replay("'insert', 'update', 'delete'"),
    "log_as_of": _replay("'insert', 'delete'", "seq <= (SELECT max(seq) // 2 FROM ops)"),
    "log_live_count": f"SELECT count(*) AS records FROM ({REPLAY})",
    "log_versions": f"""WITH {OPS}, w AS (SELECT * FROM ops WHERE op IN ('insert', 'update', 'delete')),
e AS (SELECT *, sum((op = 'insert')::INTEGER) OVER (PARTITION BY id ORDER BY seq) AS epoch FROM w)
SELECT seq, id, op, (sum((op = 'update')::INTEGER) OVER (PARTITION BY id, epoch ORDER BY seq))::BIGINT AS version FROM e""",
    "log_validity": f"WITH {VALIDITY} SELECT id, valid_from, valid_to FROM st",
    "op_summary": f"""WITH {LOG}, s AS (SELECT request_type, count(*) AS requests, count(*) FILTER (failed) AS failures,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM log GROUP BY 1)
SELECT request_type, requests, failures, {rounded('100.0 * failures / requests')} AS fail_pct,
  {rounded('requests / seconds')} AS requests_per_s, {rounded('failures / seconds')} AS failures_per_s FROM s""",
    "counter_totals": f"""WITH {LOG} SELECT request_type, 'requests' AS counter, sum(k)::BIGINT AS total
FROM log WHERE request_type <> 'Search' GROUP BY 1""",
    "latency_summary": f"WITH {LOG} SELECT request_type, {SHOWN_SUMMARY} FROM {LATENCY}",
    "metric_histogram": f"""WITH {LOG}, {LONG} SELECT request_type, metric, floor(value * 1000)::BIGINT AS bucket, count(*) AS n
FROM lm GROUP BY 1, 2, 3""",
    "metric_percentiles": f"""WITH {LOG}, {LONG} SELECT request_type, metric, count, {SHOWN_SUMMARY}
FROM {_summary('lm', 'request_type, metric', 'value')}""",
    "metric_sketches": f"WITH {LOG} SELECT request_type, count(*) AS requests, TRUE AS within FROM log GROUP BY 1",
    "head_large": """SELECT l_orderkey, count(*) AS lines FROM
(SELECT l_orderkey FROM lineitem ORDER BY 1 LIMIT (SELECT count(*) * 3 // 4 FROM lineitem)) GROUP BY 1""",
    "metrics_summary": f"""WITH {LOG}, {LONG} SELECT request_type AS operation, 0 AS section, 'Latency (ms)' AS metric, {SHOWN_SUMMARY} FROM {LATENCY}
UNION ALL SELECT request_type, 1, CASE metric WHEN 'recall' THEN 'Recall' ELSE 'Reciprocal rank' END, {SHOWN_SUMMARY}
FROM {_summary('lm', 'request_type, metric', 'value')}""",
    "report_nested": f"""WITH {LOG}, {LONG}, m AS (SELECT * FROM {_summary('lm', 'request_type, metric', 'value')} WHERE metric = 'recall')
SELECT log.request_type, count(*) AS requests, {rounded('any_value(m.mean)')} AS recall_mean, {rounded('any_value(m.p99_9)')} AS recall_p99_9,
  (sum(k) FILTER (log.request_type <> 'Search'))::BIGINT AS counted FROM log LEFT JOIN m USING (request_type) GROUP BY 1""",
    "report_rollup": f"""WITH {LOG}, d AS (SELECT *, day(ts)::INTEGER AS step FROM log)
SELECT request_type, step, grouping(step)::INTEGER AS all_steps, count(*) AS requests, count(*) FILTER (failed) AS failures,
  {rounded('avg(response_time)', 9)} AS mean_response_time
FROM d GROUP BY GROUPING SETS ((request_type, step), (request_type))""",
    "request_labels": f"WITH {LOG} SELECT 'day' || day(ts) || '.' || request_type AS label, count(*) AS requests FROM log GROUP BY 1",
    "phase_durations": f"""SELECT day(ts)::INTEGER AS phase, {rounded('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6')} AS seconds,
  false AS never_started FROM events GROUP BY 1""",
    "gap_stats": f"""WITH g AS (SELECT user_id, epoch_us(ts) AS us,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events),
h AS (SELECT *, abs(gap - lag(gap) OVER (PARTITION BY user_id ORDER BY us)) AS change FROM g),
s AS (SELECT user_id, count(*) AS requests, count(gap) / nullif((max(us) - min(us)) / 1e6, 0) AS rate, avg(gap) AS gap_mean,
  stddev_samp(gap) AS gap_stddev, avg(change) AS gap_change_mean FROM h GROUP BY 1)
SELECT user_id, requests, {rounded('rate', 8)} AS rate, {rounded('gap_mean', 3)} AS gap_mean,
  {rounded('gap_stddev', 3)} AS gap_stddev, {rounded('gap_change_mean', 3)} AS gap_change_mean FROM s""",
    "knn_damaged": DAMAGED,
    "knn_balls_euclidean": EUCLIDEAN,
    "knn_balls_dotproduct": _shown_knn("dotproduct"),
    "knn_balls_filtered": FILTERED,
    "knn_ivf_every_list": _shown_knn("euclidean"),
    "neighbours_attached": f"""WITH {R}, n AS (SELECT q.id AS query_id, r.id AS id,
  row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, r.v), r.id) AS rank FROM r q JOIN r ON {ALLOWED})
SELECT q.id AS query_id, least(10, count(n.id))::BIGINT AS found, max(n.id) FILTER (n.rank = 1) AS best
FROM r q LEFT JOIN n ON n.query_id = q.id GROUP BY q.id""",
    "dataset_round_trip": """SELECT name, records, dims, metric, requests, documents, true AS refused FROM
  (SELECT count(*) AS records, max(len(embedding))::INTEGER AS dims, count(*) AS requests, count(*) AS documents FROM embeddings),
  (VALUES ('one', 'cosine'), ('two', 'euclidean')) t(name, metric)""",
    "synth_record_shapes": "SELECT doc_id AS id, 32::BIGINT AS dims, true AS inside, 0::BIGINT AS version FROM documents",
    "synth_metadata_shapes": "SELECT doc_id AS id, 11::BIGINT AS city, true AS shard, '4,4' AS labels, true AS flag FROM documents",
    "synth_query_shapes": "SELECT c_custkey AS query_id, 10::BIGINT AS found, true AS itself FROM customer",
    "synth_runbook_shapes": """SELECT c_custkey AS query_id, ntile(4) OVER (ORDER BY c_custkey) AS step,
  10::BIGINT AS found, 0::BIGINT AS later FROM customer""",
    "synth_sample_shape": "SELECT least(50, count(*))::BIGINT AS rows, least(50, count(*))::BIGINT AS ids FROM documents",
    "synth_pick_counts": "SELECT count(*) AS rows, 0::BIGINT AS outside, 0::BIGINT AS likeliest, 0::BIGINT AS least FROM orders",
    "trailing_10s": _trailing(10),
    "trailing_hour": _trailing(3600),
    "stream_window_metrics": WINDOWS,
    "stream_window_rate": WINDOW_RATE,
    "stream_late_rows": "SELECT count(*) AS counted, 0::BIGINT AS late_rows FROM events",
    "stream_totals": f"""WITH {LOG} SELECT request_type, count(*) AS requests, count(*) FILTER (failed) AS failures,
  min(response_time) AS min, max(response_time) AS max FROM log GROUP BY 1""",
    "stream_score": SCORES,
    "stream_upsert": _replay("'insert', 'update', 'delete'"),
    "stream_sessions": SESSIONS,
    "default_lists": """SELECT l_returnflag, count(*) AS records,
  CASE WHEN count(*) <= 1000000 THEN greatest(1, count(*) // 1000) ELSE floor(sqrt(count(*))) END::BIGINT AS lists
FROM lineitem GROUP BY 1""",
    "search_one": f"""WITH {R}, f AS (SELECT v FROM r ORDER BY id LIMIT 1)
SELECT r.id, {rounded('list_distance(f.v, r.v)')} AS distance FROM r, f WHERE list_contains(tags, 'm1')
ORDER BY list_distance(f.v, r.v), r.id LIMIT 20""",
    "score_unavailable": f"""{LISTS} SELECT query_id, {', '.join(f'CASE WHEN r.namespace = 0 THEN {rounded(m)} END AS {m}' for m in METRICS)}
FROM s JOIN r ON r.id = s.query_id""",
    "report_sink": f"WITH {LOG} SELECT request_type, count(*) AS requests, count(*) FILTER (failed) AS failures FROM log GROUP BY 1",
    "distance_columns": f"""WITH {R}, {CENTROIDS} SELECT id, {rounded('sqrt(list_inner_product(r.v, r.v))')} AS length,
  {rounded('list_cosine_distance(r.v, c.v)')} AS cosine, {rounded('list_distance(r.v, c.v)')} AS euclidean,
  {rounded('-list_inner_product(r.v, c.v)')} AS dotproduct FROM r JOIN c ON c.list_id = r.label""",
    "log_namespaced": f"""WITH {OPS}, w AS (SELECT *, seq % 3 AS namespace FROM ops WHERE op IN ('insert', 'update', 'delete')),
l AS (SELECT namespace, id, arg_max(op, seq) AS life FROM w WHERE op <> 'update' GROUP BY ALL),
v AS (SELECT namespace, id, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value FROM w WHERE op <> 'delete' GROUP BY namespace, id)
SELECT namespace, id, seq, value FROM v JOIN l USING (namespace, id) WHERE life <> 'delete'""",
    "tag_matches": f"""WITH {R} SELECT id, coalesce(list_contains(tags, 'm1'), false) AS has_m1,
  (required IS NULL OR len(list_filter(required, lambda x: NOT list_contains(coalesce(tags, []), x))) = 0) AS satisfied,
  len(list_distinct(list_concat(coalesce(tags, []), coalesce(required, [])))) AS united FROM r""",
    "stream_metric_totals": f"""WITH {LOG}, {LONG} SELECT request_type, metric, count(*) AS count, min(value) AS min, max(value) AS max,
  {rounded('avg(value)')} AS mean, quantile_disc(value, 0.05) AS p5, quantile_disc(value, 0.5) AS p50 FROM lm GROUP BY 1, 2""",
    "trailing_all": f"""SELECT event_id AS seq, count(*) OVER w AS requests, {rounded('count(*) OVER w / 10.0::DOUBLE')} AS requests_per_s
FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 10 SECONDS PRECEDING AND CURRENT ROW)""",
}
