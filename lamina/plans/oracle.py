"""The derived tables of ``sources.derived`` in the oracle's SQL, as a WITH clause that queries begin with."""

TABLES = """WITH bulletins AS (
 SELECT CAST(10000000 + o_orderkey AS VARCHAR) AS bulletin_id,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
   WHEN o_orderkey % 7 = 0 THEN 'N' || (242480000 + o_custkey) || '-0' || (o_orderkey % 3)
   WHEN o_orderkey % 5 = 0 THEN ' pit' || o_custkey || ' '
   ELSE 'PIT' || o_custkey || substr('ABCDE', CAST(o_orderkey % 5 AS INT) + 1, 1) END AS number,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS published,
  CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'TSB' WHEN '2-HIGH' THEN 'RC' WHEN '3-MEDIUM' THEN 'PIT' WHEN '5-LOW' THEN NULL ELSE 'MC' END AS kind,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'serious' WHEN '2-HIGH' THEN 'serious' WHEN '3-MEDIUM' THEN 'medium' ELSE 'small' END AS severity,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS processed_at,
  CASE WHEN o_orderstatus = 'P' THEN CASE o_orderkey % 3 WHEN 0 THEN 'timeout: upstream' WHEN 1 THEN 'rate limit (429)' ELSE 'invalid json' END END AS reason,
  CAST(o_orderkey % 4 AS INT) AS attempts,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CASE o_orderkey % 6
   WHEN 0 THEN 'This service bulletin provides steps' WHEN 1 THEN 'A Customer Satisfaction program'
   WHEN 2 THEN 'Preliminary information on brakes' WHEN 3 THEN 'Safety recall notice'
   WHEN 4 THEN 'Radio screen goes blank' ELSE 'Warranty administration note' END END AS summary
 FROM orders),
lines AS (
 SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, min(l_linestatus) AS line_status, max(l_partkey) AS part, max(l_suppkey) AS supp, CAST(sum(l_quantity) AS BIGINT) AS quantity
 FROM lineitem GROUP BY ALL),
papers AS (
 SELECT l_orderkey * 10 + l_linenumber AS paper_id, CAST(10000000 + l_orderkey AS VARCHAR) AS bulletin_id,
  [CASE flag WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Brakes' ELSE 'brakes' END WHEN 'N' THEN 'Infotainment' ELSE 'Air Conditioning' END] AS systems,
  [CASE WHEN line_status = 'F' THEN 'no start' ELSE 'Blank Screen' END] || CASE WHEN l_linenumber > 5 THEN ['leak'] ELSE CAST([] AS VARCHAR[]) END AS symptoms,
  ['part ' || (part % 7)] AS components,
  CASE WHEN l_linenumber > 1 THEN 'Summary ' || part END AS paper_summary,
  CASE WHEN l_linenumber % 2 = 1 THEN 'Replace part' END AS remedy,
  CASE l_linenumber % 4 WHEN 0 THEN 'recall' WHEN 1 THEN 'customer_letter' WHEN 2 THEN 'service_procedure' ELSE 'informational' END AS doc_kind,
  CASE supp % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'dealer' ELSE 'both' END AS audience,
  quantity * 100 AS tokens_in, quantity * 10 AS tokens_out
 FROM lines),
links AS (
 SELECT CAST(10000000 + k AS VARCHAR) AS bulletin_id, car_id, min(seen) AS first_seen_at, k % 3 = 0 AS alert_pending
 FROM (SELECT o_orderkey AS k, o_custkey AS car_id, o_orderdate AS seen FROM orders UNION ALL SELECT l_orderkey, l_suppkey, l_shipdate FROM lineitem) GROUP BY k, car_id),
cars AS (
 SELECT c_custkey AS car_id, CAST(2000 + c_custkey % 25 AS INT) AS year, c_mktsegment AS make, 'M ' || c_nationkey AS model,
  CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1998-01-01 00:00:00' END AS ready_at FROM customer),
ledger AS (
 SELECT event_id, ts AS occurred_at, user_id, event_type AS kind, value AS cost, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CASE user_id % 3 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' ELSE 'm-x' END AS model, event_id % 1000 AS tokens_in, event_id % 90 AS tokens_out FROM events),
filed AS (
 SELECT CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE ' ' || (20000000 + p_partkey % 997) END AS raw_id, 'Make ' || (p_partkey % 3) AS raw_make,
  CASE WHEN p_partkey % 31 = 0 THEN 'MAKE ' || (p_partkey % 3) ELSE CASE p_partkey % 6
   WHEN 0 THEN 'f-' || p_size WHEN 1 THEN 'F  ' || p_size WHEN 2 THEN 'F' || p_size || ' SD'
   WHEN 3 THEN 'REDUNDANT F ' || p_size WHEN 4 THEN p_name ELSE 'Duplicate ' || p_name END END AS raw_model,
  CASE WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 13 = 0 THEN '9999' WHEN p_partkey % 5 = 0 THEN '2020, 2021' ELSE CAST(2020 + p_partkey % 2 AS VARCHAR) END AS raw_years,
  p_type AS summary, CASE WHEN p_partkey % 4 < 2 THEN '2015-2019' ELSE '2020-2024' END AS source_window FROM part),
clean0 AS (
 SELECT trim(raw_id) AS bulletin_id, upper(trim(raw_make)) AS make, trim(regexp_replace(replace(upper(raw_model), '-', ' '), '\\s+', ' ', 'g')) AS model,
  trim(unnest(string_split(raw_years, ','))) AS y, trim(summary) AS summary, source_window FROM filed
 WHERE trim(raw_id) <> '' AND trim(raw_make) <> '' AND trim(raw_model) <> '' AND upper(trim(raw_make)) <> upper(trim(raw_model))),
clean AS (SELECT bulletin_id, make, model, CAST(y AS INT) AS model_year, summary, source_window FROM clean0 WHERE regexp_full_match(y, '[0-9]+') AND model <> ''),
vocabulary AS (SELECT model_year, make, model, source_window, count(DISTINCT bulletin_id) AS bulletins FROM clean GROUP BY ALL),
accounts AS (
 SELECT user_id, user_id % 37 = 0 AS is_admin, TIMESTAMP '1998-01-01 00:00:00' + to_hours(CAST(user_id AS INT)) AS created_at,
  CASE WHEN user_id % 3 <> 0 THEN TIMESTAMP '1999-01-01 00:00:00' END AS last_watermark, user_id % 11 = 0 AS unsubscribed FROM (SELECT DISTINCT user_id FROM events)),
garage AS (
 SELECT user_id, (user_id * 7 + i * 13) % 100 AS car_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(i AS INT)) AS created_at, (user_id + i) % 4 <> 0 AS alerts_enabled
 FROM (SELECT user_id, unnest(range(0, user_id % 5 + 1)) AS i FROM accounts)),
entitlements AS (
 SELECT user_id * 10 AS entitlement_id, user_id, CASE WHEN user_id % 4 = 1 THEN 'unlock' ELSE 'subscription' END AS kind,
  CASE WHEN user_id % 4 = 1 THEN (user_id * 7) % 100 END AS car_id, CASE WHEN user_id % 4 = 2 THEN 'canceled' ELSE 'active' END AS status,
  CASE WHEN user_id % 8 = 4 THEN 'all_access' WHEN user_id % 16 = 0 THEN 'monthly' END AS plan, TIMESTAMP '1999-06-01 00:00:00' + to_hours(CAST(user_id AS INT)) AS created_at
 FROM accounts WHERE user_id % 4 < 3),
reads AS (
 SELECT DISTINCT g.user_id, l.bulletin_id FROM garage g JOIN links l USING (car_id) WHERE (CAST(l.bulletin_id AS BIGINT) + g.user_id) % 5 = 0),
numbered AS (SELECT *, regexp_replace(upper(number), '^\\s+|\\s+$', '', 'g') AS n FROM bulletins),
stemmed AS (
 SELECT * EXCLUDE (n), CASE WHEN n IS NULL OR n = '' THEN 'id:' || bulletin_id
  WHEN regexp_full_match(n, '[A-Z]?[0-9]{6,}-[0-9]{1,2}') THEN regexp_replace(n, '-[0-9]{1,2}$', '')
  WHEN regexp_full_match(n, '.*[0-9][A-Z]') THEN regexp_replace(n, '[A-Z]$', '') ELSE n END AS stem FROM numbered),
listed_cars AS (SELECT l.car_id, s.* FROM links l JOIN stemmed s USING (bulletin_id)),
car_families AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY car_id, stem ORDER BY published DESC NULLS LAST, bulletin_id DESC) AS rn,
  count(*) OVER (PARTITION BY car_id, stem) - 1 AS superseded FROM listed_cars) WHERE rn = 1),
plan_of AS (
 SELECT user_id, max(CASE WHEN plan = 'all_access' THEN 20 ELSE 2 END) AS places, min(created_at) AS subscribed_since
 FROM entitlements WHERE kind = 'subscription' AND status = 'active' GROUP BY user_id),
unlocked AS (SELECT DISTINCT user_id, car_id FROM entitlements WHERE kind = 'unlock' AND status = 'active'),
seats AS (
 SELECT g.*, u.car_id IS NOT NULL AS is_unlocked, sum(CASE WHEN u.car_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY g.created_at, g.car_id) AS place
 FROM garage g LEFT JOIN unlocked u ON u.user_id = g.user_id AND u.car_id = g.car_id),
access AS (
 SELECT s.user_id, s.car_id, s.created_at, s.alerts_enabled, s.is_unlocked, CASE WHEN a.is_admin OR s.is_unlocked OR (p.places IS NOT NULL AND s.place <= p.places) THEN 'full' ELSE 'sample' END AS access
 FROM seats s JOIN accounts a USING (user_id) LEFT JOIN plan_of p USING (user_id))
"""
