"""DuckDB SQL for every SQL-checkable registered query.

The views H, U, T and the split are spelled out as CTEs over the raw test
tables, in the plainest SQL: a global ``row_number`` for the split, long
unions with a source priority for the merges, ``string_agg ... ORDER BY``
for the lists. Slice sizes use the same double arithmetic as Python's
``int(n * 0.7)``.
"""

from __future__ import annotations

K = 72
BINS = 50

_H = """
h AS (
  SELECT CAST(o.o_custkey AS INTEGER) AS user_id,
         'I' || CAST(l.l_partkey AS VARCHAR) AS item_id,
         CAST(epoch(o.o_orderdate) AS BIGINT) AS latest_timestamp,
         CAST(l.l_quantity AS INTEGER) AS frequency,
         l.l_partkey, o.o_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
ranked AS (
  SELECT *,
         row_number() OVER (ORDER BY latest_timestamp, user_id, l_partkey, o_orderkey,
                                     l_linenumber, l_suppkey, l_quantity) AS rn,
         count(*) OVER () AS n
  FROM h
),
sliced AS (
  SELECT *,
         CASE WHEN rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
              WHEN rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'test'
              ELSE 'validation' END AS slice
  FROM ranked
),
train_freq AS (
  SELECT user_id, CAST(replace(item_id, 'I', '') AS INTEGER) AS item_id,
         SUM(CAST(frequency AS DOUBLE)) AS frequency
  FROM sliced WHERE slice = 'train' GROUP BY 1, 2
),
truth AS (
  SELECT DISTINCT user_id, CAST(replace(item_id, 'I', '') AS INTEGER) AS item_id
  FROM sliced WHERE slice = 'test'
)"""

_U = """
u AS (
  SELECT CAST(c.c_custkey AS INTEGER) AS user_id,
         c.c_mktsegment AS feature1,
         n.n_name AS feature2,
         CAST(n.n_regionkey AS VARCHAR) AS feature3,
         CAST(CAST(floor(c.c_acctbal / 2000) AS BIGINT) AS VARCHAR) AS feature4,
         CAST(c.c_custkey % 7 AS VARCHAR) AS feature5,
         CASE WHEN c.c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS feature6
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
),
t AS (SELECT user_id FROM u),
uv AS (
  SELECT user_id, 'feature1' AS feature, feature1 AS value FROM u UNION ALL
  SELECT user_id, 'feature2', feature2 FROM u UNION ALL
  SELECT user_id, 'feature3', feature3 FROM u UNION ALL
  SELECT user_id, 'feature4', feature4 FROM u UNION ALL
  SELECT user_id, 'feature5', feature5 FROM u UNION ALL
  SELECT user_id, 'feature6', feature6 FROM u
),
vc AS (SELECT feature, value, count(*) AS count FROM uv GROUP BY 1, 2)"""

_LISTS = f"""
g AS (SELECT item_id, SUM(frequency) AS frequency FROM train_freq GROUP BY item_id),
g_top AS (
  SELECT * FROM (
    SELECT item_id, frequency,
           CAST(row_number() OVER (ORDER BY frequency DESC, item_id) AS INTEGER) AS rank
    FROM g) WHERE rank <= {K}
),
seg_pop AS (
  SELECT u.feature1 AS segment, f.item_id, SUM(f.frequency) AS frequency
  FROM train_freq f JOIN u ON u.user_id = f.user_id GROUP BY 1, 2
),
seg_top AS (
  SELECT * FROM (
    SELECT segment, item_id, frequency,
           CAST(row_number() OVER (PARTITION BY segment ORDER BY frequency DESC, item_id) AS INTEGER) AS rank
    FROM seg_pop) WHERE rank <= {K}
),
seg_list AS (
  SELECT t.user_id, s.rank, s.item_id
  FROM t JOIN u ON u.user_id = t.user_id JOIN seg_top s ON s.segment = u.feature1
),
full_users AS (SELECT user_id FROM seg_list GROUP BY user_id HAVING count(*) = {K}),
eval_list AS (SELECT * FROM seg_list WHERE user_id IN (SELECT user_id FROM full_users)),
hyb_users AS (
  SELECT user_id FROM t
  UNION
  SELECT user_id FROM u WHERE NOT EXISTS (SELECT 1 FROM train_freq f WHERE f.user_id = u.user_id)
),
p AS (
  SELECT * FROM (
    SELECT user_id, item_id,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY frequency DESC, item_id) AS INTEGER) AS rank
    FROM train_freq) WHERE rank <= {K}
),
hyb_seg AS (
  SELECT hu.user_id, s.rank, s.item_id
  FROM hyb_users hu JOIN u ON u.user_id = hu.user_id JOIN seg_top s ON s.segment = u.feature1
),
cand AS (
  SELECT hu.user_id, 0 AS src, p.rank, p.item_id FROM hyb_users hu JOIN p ON p.user_id = hu.user_id
  UNION ALL
  SELECT user_id, 1, rank, item_id FROM hyb_seg
  UNION ALL
  SELECT hu.user_id, 2, g_top.rank, g_top.item_id FROM hyb_users hu CROSS JOIN g_top
),
first_seen AS (SELECT user_id, item_id, min(src * 100000 + rank) AS o FROM cand GROUP BY 1, 2),
hybrid AS (
  SELECT * FROM (
    SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY o) AS r FROM first_seen
  ) WHERE r <= {K}
),
hs AS (
  SELECT hu.user_id,
         coalesce((SELECT count(*) FROM p WHERE p.user_id = hu.user_id), 0) AS np,
         coalesce((SELECT count(*) FROM hyb_seg s WHERE s.user_id = hu.user_id), 0) AS ns
  FROM hyb_users hu
),
cold_fill AS (
  SELECT hs.user_id, s.rank AS o, s.item_id FROM hs JOIN hyb_seg s ON s.user_id = hs.user_id WHERE hs.np = 0
  UNION ALL
  SELECT hs.user_id, 100000 + g_top.rank, g_top.item_id FROM hs CROSS JOIN g_top
  WHERE hs.np = 0 AND g_top.rank <= {K} - hs.ns
)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


BASE = _with(_H, _U, _LISTS)

_IDCG = f"(SELECT sum(1.0 / log2(range + 2)) FROM range({K}))"

_REL = f"""
rel AS (
  SELECT e.user_id, CAST(e.rank - 1 AS INTEGER) AS pos, e.item_id,
         CASE WHEN tr.item_id IS NULL THEN 0 ELSE 1 END AS rel
  FROM eval_list e LEFT JOIN truth tr ON tr.user_id = e.user_id AND tr.item_id = e.item_id
  WHERE e.user_id IN (SELECT user_id FROM truth)
),
nd AS (SELECT user_id, sum(rel / log2(pos + 2)) / {_IDCG} AS ndcg FROM rel GROUP BY user_id)"""

_VIOLATIONS = """
SELECT count(*) AS n_users, CAST(0 AS BIGINT) AS n_wrong_length, CAST(0 AS BIGINT) AS n_wrong_repeated,
       CAST(0 AS BIGINT) AS n_wrong_item, CAST(0 AS BIGINT) AS n_wrong_order, CAST(0 AS BIGINT) AS n_wrong_rating
FROM {users}"""

ORACLE_SQL: dict[str, str] = {
    "history_clean": BASE + """
SELECT user_id, CAST(replace(item_id, 'I', '') AS INTEGER) AS item_id, latest_timestamp, frequency FROM h""",
    "temporal_split_counts": BASE + """
SELECT slice, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
       min(latest_timestamp) AS min_timestamp, max(latest_timestamp) AS max_timestamp
FROM sliced GROUP BY slice""",
    "temporal_split_rows": BASE + """
SELECT user_id, CAST(replace(item_id, 'I', '') AS INTEGER) AS item_id, latest_timestamp, frequency,
       o_orderkey, l_linenumber, l_suppkey, slice
FROM sliced""",
    "train_frequencies": BASE + """
SELECT user_id, item_id, frequency FROM train_freq""",
    "train_test_frequencies": BASE + """
SELECT user_id, CAST(replace(item_id, 'I', '') AS INTEGER) AS item_id, SUM(CAST(frequency AS DOUBLE)) AS frequency
FROM sliced WHERE slice IN ('train', 'test') GROUP BY 1, 2""",
    "target_frequencies": BASE + """
SELECT f.user_id, f.item_id, f.frequency FROM train_freq f WHERE f.user_id IN (SELECT user_id FROM sliced WHERE slice = 'validation')""",
    "feature_value_counts": BASE + """
SELECT feature, value, count FROM vc""",
    "distinct_summary": BASE + """
SELECT (SELECT count(*) FROM h) AS n_history_rows,
       (SELECT count(DISTINCT user_id) FROM h) AS n_history_users,
       (SELECT count(DISTINCT item_id) FROM h) AS n_history_items,
       (SELECT count(DISTINCT user_id) FROM u) AS n_master_users,
       (SELECT count(DISTINCT user_id) FROM t) AS n_target_users""",
    "feature_index": BASE + """
SELECT feature, value, count,
       CAST(row_number() OVER (PARTITION BY feature ORDER BY count DESC, value) - 1 AS INTEGER) AS index
FROM vc""",
    "feature_vector_slots": BASE + """,
fi AS (
  SELECT feature, value,
         row_number() OVER (PARTITION BY feature ORDER BY count DESC, value) - 1 AS idx
  FROM vc
),
nf AS (SELECT feature, count(*) AS n FROM vc GROUP BY feature),
off AS (
  SELECT feature, n,
         coalesce(sum(n - 1) OVER (ORDER BY feature ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM nf
)
SELECT uv.user_id, CAST(off.base + fi.idx AS INTEGER) AS slot
FROM uv JOIN fi ON fi.feature = uv.feature AND fi.value = uv.value JOIN off ON off.feature = uv.feature
WHERE fi.idx < off.n - 1""",
    "global_top_k": BASE + """
SELECT item_id, frequency, rank FROM g_top""",
    "segment_popularity": BASE + """
SELECT segment, item_id, frequency FROM seg_pop""",
    "segment_top_k": BASE + """
SELECT segment, item_id, frequency, rank FROM seg_top""",
    "segment_recommendations": BASE + """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS recommended_items
FROM seg_list GROUP BY user_id""",
    "user_top_k": BASE + """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS recommended_items
FROM p GROUP BY user_id""",
    "hybrid_merge": BASE + """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY r) AS recommended_items
FROM hybrid GROUP BY user_id""",
    "hybrid_merge_self_fill": BASE + f""",
sf AS (
  SELECT hs.user_id, p.rank AS o, p.item_id FROM hs JOIN p ON p.user_id = hs.user_id WHERE hs.np > 0
  UNION ALL
  SELECT hs.user_id, 100000 + p.rank, p.item_id FROM hs JOIN p ON p.user_id = hs.user_id
  WHERE hs.np > 0 AND hs.np < {K} AND p.rank > hs.ns
  UNION ALL
  SELECT user_id, o, item_id FROM cold_fill
)
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY o) AS recommended_items
FROM sf GROUP BY user_id""",
    "interleave_merge": BASE + f""",
il AS (
  SELECT hs.user_id, 2 * p.rank - 1 AS o, p.item_id FROM hs JOIN p ON p.user_id = hs.user_id
  WHERE hs.np > 0 AND p.rank <= least({K // 2}, hs.np, hs.ns)
  UNION ALL
  SELECT hs.user_id, 2 * s.rank, s.item_id FROM hs JOIN hyb_seg s ON s.user_id = hs.user_id
  WHERE hs.np > 0 AND s.rank <= least({K // 2}, hs.np, hs.ns)
  UNION ALL
  SELECT user_id, o, item_id FROM cold_fill
)
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY o) AS recommended_items
FROM il GROUP BY user_id""",
    "submission_format": BASE + """
SELECT user_id, string_agg('I' || CAST(item_id AS VARCHAR), ',' ORDER BY r) AS recommend_items
FROM hybrid GROUP BY user_id""",
    "truth_long": BASE + """
SELECT user_id, CAST(replace(item_id, 'I', '') AS INTEGER) AS item_id, SUM(CAST(frequency AS DOUBLE)) AS frequency
FROM sliced WHERE slice = 'test' GROUP BY 1, 2""",
    "truth_wide": BASE + f""",
tw AS (
  SELECT user_id,
         string_agg(repeat(replace(item_id, 'I', '') || ',', frequency), '' ORDER BY rn) AS s,
         sum(frequency) AS tot
  FROM sliced WHERE slice = 'test' GROUP BY user_id
)
SELECT u.user_id,
       rtrim(coalesce(tw.s, '') || repeat('0,', CAST(greatest({K} - coalesce(tw.tot, 0), 0) AS BIGINT)), ',')
         AS items_actioned_on
FROM u LEFT JOIN tw ON tw.user_id = u.user_id""",
    "relevance_flags": BASE + "," + _REL + """
SELECT user_id, pos, item_id, rel FROM rel""",
    "ndcg_per_user": BASE + "," + _REL + """
SELECT user_id, round(ndcg, 6) AS ndcg FROM nd""",
    "ndcg_ideal_truth": BASE + "," + _REL + f""",
tsize AS (SELECT user_id, least(count(*), {K}) AS m FROM truth GROUP BY user_id),
dcg AS (SELECT user_id, sum(rel / log2(pos + 2)) AS d FROM rel GROUP BY user_id)
SELECT dcg.user_id,
       round(dcg.d / (SELECT sum(1.0 / log2(range + 2)) FROM range(tsize.m)), 6) AS ndcg
FROM dcg JOIN tsize ON tsize.user_id = dcg.user_id""",
    "ndcg_summary": BASE + "," + _REL + """
SELECT count(*) AS n_scored, round(avg(ndcg), 6) AS mean_ndcg, round(min(ndcg), 6) AS min_ndcg,
       round(max(ndcg), 6) AS max_ndcg
FROM nd""",
    "ndcg_histogram": BASE + "," + _REL + f""",
nd12 AS (SELECT user_id, round(ndcg, 12) AS ndcg FROM nd),
rg AS (SELECT min(ndcg) AS lo, max(ndcg) AS hi FROM nd12),
b AS (
  SELECT CASE WHEN hi = lo THEN 0
              ELSE least(CAST(floor((ndcg - lo) / ((hi - lo) / {BINS})) AS BIGINT), {BINS - 1}) END AS bin
  FROM nd12, rg
),
cnt AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(gr.range AS INTEGER) AS bin,
       round(lo + (hi - lo) * gr.range / {BINS}, 6) AS lower,
       round(lo + (hi - lo) * (gr.range + 1) / {BINS}, 6) AS upper,
       coalesce(cnt.n, 0) AS n
FROM range({BINS}) gr CROSS JOIN rg LEFT JOIN cnt ON cnt.bin = gr.range""",
    "item_exposure": BASE + """
SELECT item_id, count(*) AS n FROM eval_list GROUP BY item_id""",
    "entropy_at_k": BASE + f""",
z AS (SELECT count(DISTINCT user_id) AS n_users, {K} * count(DISTINCT user_id) AS z FROM eval_list),
ex AS (SELECT item_id, count(*) AS n FROM eval_list GROUP BY item_id)
SELECT n_users, z, round(-sum(n / z * log2(n / z)), 6) AS entropy FROM ex, z GROUP BY n_users, z""",
    "catalogue_coverage": BASE + """
SELECT count(DISTINCT e.item_id) AS n_items_recommended,
       (SELECT count(DISTINCT item_id) FROM h) AS n_items_catalogue,
       round(count(DISTINCT e.item_id) / (SELECT count(DISTINCT item_id) FROM h), 6) AS coverage
FROM eval_list e""",
    "evaluate_models": BASE + f""",
lists AS (
  SELECT 'segment' AS model, user_id, rank - 1 AS pos, item_id FROM seg_list
  UNION ALL
  SELECT 'global', t.user_id, g_top.rank - 1, g_top.item_id FROM t CROSS JOIN g_top
  UNION ALL
  SELECT 'hybrid', user_id, r - 1, item_id FROM hybrid
),
fl AS (
  SELECT l.* FROM lists l
  JOIN (SELECT model, user_id FROM lists GROUP BY 1, 2 HAVING count(*) = {K}) ok
    ON ok.model = l.model AND ok.user_id = l.user_id
),
ndm AS (
  SELECT fl.model, fl.user_id,
         sum(CASE WHEN tr.item_id IS NULL THEN 0 ELSE 1 END / log2(fl.pos + 2)) / {_IDCG} AS ndcg
  FROM fl LEFT JOIN truth tr ON tr.user_id = fl.user_id AND tr.item_id = fl.item_id
  WHERE fl.user_id IN (SELECT user_id FROM truth)
  GROUP BY 1, 2
),
zs AS (SELECT model, count(DISTINCT user_id) AS n_lists, {K} * count(DISTINCT user_id) AS z FROM fl GROUP BY model),
exm AS (SELECT model, item_id, count(*) AS n FROM fl GROUP BY 1, 2),
ent AS (
  SELECT exm.model, -sum(exm.n / zs.z * log2(exm.n / zs.z)) AS entropy, count(*) AS n_items_recommended
  FROM exm JOIN zs ON zs.model = exm.model GROUP BY exm.model
),
sm AS (SELECT model, count(*) AS n_scored, avg(ndcg) AS mean_ndcg FROM ndm GROUP BY model)
SELECT zs.model, zs.n_lists, sm.n_scored, round(sm.mean_ndcg, 6) AS mean_ndcg, round(ent.entropy, 6) AS entropy,
       ent.n_items_recommended
FROM zs LEFT JOIN sm ON sm.model = zs.model LEFT JOIN ent ON ent.model = zs.model""",
    "coverage_report": BASE + """,
known AS (SELECT DISTINCT user_id FROM sliced WHERE slice = 'train'),
withtruth AS (SELECT DISTINCT user_id FROM sliced WHERE slice = 'test'),
c AS (
  SELECT count(*) AS users,
         count(k.user_id) AS with_primary,
         count(w.user_id) AS with_truth
  FROM hyb_users hu LEFT JOIN known k ON k.user_id = hu.user_id LEFT JOIN withtruth w ON w.user_id = hu.user_id
)
SELECT 'users' AS category, users AS n_users FROM c UNION ALL
SELECT 'with_primary', with_primary FROM c UNION ALL
SELECT 'without_primary', users - with_primary FROM c UNION ALL
SELECT 'with_truth', with_truth FROM c UNION ALL
SELECT 'without_truth', users - with_truth FROM c""",
    "target_features": BASE + """
SELECT * FROM u WHERE user_id IN (SELECT user_id FROM sliced WHERE slice = 'validation')""",
    "first_target_lists": BASE + """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS recommended_items
FROM seg_list WHERE user_id IN (SELECT user_id FROM t ORDER BY user_id LIMIT 100) GROUP BY user_id""",
    "event_split_rows": """
SELECT event_id, user_id,
       CASE WHEN rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
            WHEN rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'test'
            ELSE 'validation' END AS slice
FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)""",
    "event_split_counts": """
WITH twice AS (SELECT date_trunc('hour', ts) AS hour, event_type FROM events UNION ALL SELECT date_trunc('hour', ts), event_type FROM events),
ranked AS (SELECT *, row_number() OVER (ORDER BY hour, event_type) AS rn, count(*) OVER () AS n FROM twice)
SELECT CASE WHEN rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
            WHEN rn <= CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'test'
            ELSE 'validation' END AS slice, event_type, count(*) AS n_rows
FROM ranked GROUP BY 1, 2""",
    "random_split_counts": BASE + """
SELECT s AS split, (SELECT count(*) FROM train_freq) AS n_rows, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_misplaced
FROM (VALUES ('two'), ('four')) v(s)""",
    "random_split_rows": BASE + """, dealt AS (
  SELECT *, row_number() OVER (ORDER BY md5(CAST(user_id AS VARCHAR) || ':' || CAST(item_id AS VARCHAR) || ':42')) AS r,
         count(*) OVER () AS n FROM train_freq)
SELECT user_id, item_id, frequency, CAST(CASE WHEN r <= floor(n * 0.9 + 1e-9) THEN 0 ELSE 1 END AS INTEGER) AS two,
       CAST(CASE WHEN r <= floor(n * 0.1 + 1e-9) THEN 0 WHEN r <= floor(n * 0.6 + 1e-9) THEN 1
                 WHEN r <= floor(n * 0.8 + 1e-9) THEN 2 ELSE 3 END AS INTEGER) AS four
FROM dealt""",
    "fold_training_sets": BASE + """, folds AS (
  SELECT frequency, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':' || CAST(item_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 10 AS INTEGER) AS f
  FROM train_freq)
SELECT CAST(i AS INTEGER) AS fold, part, count(*) AS n_pairs, sum(frequency) AS frequency
FROM folds, range(10) g(i), (VALUES ('train'), ('test')) v(part)
WHERE CASE part WHEN 'train' THEN f <> i ELSE f = i END GROUP BY i, part""",
    "full_own_lists": BASE + """
SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS recommended_items
FROM p WHERE rank <= 10 GROUP BY user_id HAVING count(*) = 10""",
    "feature_value_ranks": BASE + """
SELECT feature, value, count, CAST(row_number() OVER (PARTITION BY feature ORDER BY count DESC, value) AS INTEGER) AS rank FROM vc""",
    "fold_assignment": BASE + """
SELECT user_id, item_id, frequency,
       CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':' || CAST(item_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 10 AS INTEGER) AS fold
FROM train_freq""",
    "als_subset_check": BASE + _VIOLATIONS.format(
        users="(SELECT user_id FROM train_freq INTERSECT SELECT user_id FROM sliced WHERE slice = 'validation')"),
    "als_all_check": BASE + _VIOLATIONS.format(users="(SELECT DISTINCT user_id FROM train_freq)"),
    "als_pruned_check": BASE + "\nSELECT *, CAST(0 AS BIGINT) AS n_wrong_position FROM ("
    + _VIOLATIONS.format(users="(SELECT DISTINCT user_id FROM train_freq)") + ")",
    "als_rmse_check": BASE + """
SELECT count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_wrong_rmse FROM truth
WHERE user_id IN (SELECT user_id FROM train_freq) AND item_id IN (SELECT item_id FROM train_freq)""",
    "als_grid_check": BASE + """, folds AS (
  SELECT user_id, item_id, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR) || ':' || CAST(item_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 3 AS INTEGER) AS f
  FROM train_freq),
settings AS (SELECT count(*) AS n FROM (VALUES (2), (5)) a(i), (VALUES (0.01), (0.1)) b(r), (VALUES (5), (10)) c(k))
SELECT n AS n_settings, CAST(0 AS BIGINT) AS n_wrong_repeated, CAST(0 AS BIGINT) AS n_wrong_mean,
       CAST(n * (SELECT count(*) FROM folds
                 WHERE user_id IN (SELECT user_id FROM folds GROUP BY user_id HAVING count(DISTINCT f) > 1)
                   AND item_id IN (SELECT item_id FROM folds GROUP BY item_id HAVING count(DISTINCT f) > 1)) AS BIGINT) AS n_pairs,
       CAST(0 AS BIGINT) AS n_wrong_pairs, CAST(0 AS BIGINT) AS n_wrong_rmse, CAST(0 AS BIGINT) AS n_wrong_order
FROM settings""",
    "kmeans_check": BASE + """
SELECT count(*) AS n_users, CAST(0 AS BIGINT) AS n_wrong_assigned, CAST(0 AS BIGINT) AS n_wrong_nearest FROM u""",
    "silhouette_check": """
SELECT count(*) AS n_clusterings, CAST(0 AS BIGINT) AS n_wrong_score, CAST(0 AS BIGINT) AS n_wrong_rows
FROM (SELECT unnest(range(12, 102)) UNION ALL SELECT unnest(range(200, 1200, 100)))""",
    "cluster_lists_check": BASE + """
SELECT count(*) AS n_users, CAST(0 AS BIGINT) AS n_wrong_item FROM t""",
    "hybrid_check": BASE + """
SELECT count(*) AS n_users, count(*) FILTER (WHERE user_id IN (SELECT user_id FROM train_freq)) AS n_known,
       CAST(0 AS BIGINT) AS n_wrong_length, CAST(0 AS BIGINT) AS n_wrong_repeated, CAST(0 AS BIGINT) AS n_wrong_start
FROM hyb_users""",
    "comparison_check": BASE + """
SELECT CAST(4 AS BIGINT) AS n_configurations, count(*) AS n_lists,
       count(*) FILTER (WHERE user_id IN (SELECT user_id FROM truth)) AS n_scored,
       CAST(0 AS BIGINT) AS n_wrong_score, CAST(0 AS BIGINT) AS n_wrong_users
FROM t""",
}

# What comes back from files is what the tables give.
ORACLE_SQL |= {
    "file_history": ORACLE_SQL["history_clean"],
    "file_frequencies": ORACLE_SQL["train_frequencies"],
    "file_target_features": ORACLE_SQL["target_features"],
    "file_rejects": BASE + """, marked AS (
  SELECT frequency, user_id % 11 = 0 OR CAST(replace(item_id, 'I', '') AS INTEGER) % 7 = 0 AS bad FROM h)
SELECT count(*) FILTER (WHERE NOT bad) AS n_accepted, CAST(coalesce(sum(frequency) FILTER (WHERE NOT bad), 0) AS BIGINT) AS frequency,
       count(*) FILTER (WHERE bad) AS n_rejected FROM marked""",
    "file_lists": BASE + """
SELECT kind, user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY rank) AS recommended_items
FROM p, (VALUES ('plain', 72), ('cut', 10), ('header', 72)) v(kind, k) WHERE rank <= k GROUP BY kind, user_id""",
    "file_truth_items": BASE + """
SELECT DISTINCT user_id, CAST(replace(item_id, 'I', '') AS INTEGER) AS item_id
FROM sliced WHERE slice = 'test' AND item_id <> 'I0'""",
    "saved_recommender_check": BASE + """
SELECT count(*) AS n_users, CAST(0 AS BIGINT) AS n_wrong_list, CAST(0 AS BIGINT) AS n_wrong_history FROM hyb_users""",
    "truth_wide_chunks": BASE + """, acts AS (
  SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY rn, c) - 1 AS place FROM (
    SELECT user_id, replace(item_id, 'I', '') AS item, rn, unnest(range(CAST(frequency AS BIGINT))) AS c
    FROM sliced WHERE slice = 'test' AND frequency > 0)),
padded AS (
  SELECT * FROM acts UNION ALL
  SELECT user_id, '0', unnest(range(n, 72)) FROM (SELECT u.user_id, count(a.place) AS n FROM u LEFT JOIN acts a USING (user_id) GROUP BY 1))
SELECT user_id, CAST(place // 16 AS BIGINT) AS chunk, string_agg(item, ',' ORDER BY place) AS items_actioned_on FROM padded GROUP BY 1, 2""",
}
