"""The registered queries again, as SQL over the same tables, for checking."""

from __future__ import annotations

H, D = 3_600_000, 86_400_000

# Views of FIXTURES.md; each may use the ones before it.
VIEWS = {
    "ev": """
SELECT event_id AS n, CAST(event_id AS VARCHAR) AS event_id, user_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS t
FROM events""",
    "fx_logins": """
SELECT event_id, n, 'cust_' || user_id AS customer_id, 'dev_' || (n % 7) AS device_id,
       ['US','CA','KE','RU','CN'][k % 5 + 1] AS country, '10.0.0.' || k AS ip_address,
       event_type <> 'error' AS success, t
FROM ev WHERE event_type IN ('click', 'view', 'error')""",
    "fx_beneficiaries": """
SELECT event_id AS beneficiary_id, 'cust_' || user_id AS customer_id, t FROM ev WHERE event_type = 'signup'""",
    "fx_transfers": """
SELECT event_id AS transaction_id, n, 'ACC-' || user_id AS from_account,
       'ACC-' || ((user_id * 7 + n * 3) % 200) AS to_account, value AS amount, t
FROM ev WHERE event_type = 'purchase'""",
    "fx_api": """
SELECT event_id AS request_id, n, '10.0.0.' || k AS ip_address,
       CASE event_type WHEN 'click' THEN '/api/accounts/ACC-' || user_id
                       WHEN 'view' THEN '/api/accounts/ACC-' || user_id || '/balance'
                       WHEN 'error' THEN '/api/login' WHEN 'purchase' THEN '/api/transfers'
                       ELSE '/api/beneficiaries' END AS endpoint,
       CASE WHEN event_type IN ('click', 'view') THEN 'GET' ELSE 'POST' END AS method,
       CASE WHEN event_type = 'error' THEN 401 ELSE 200 END AS status_code, t
FROM ev""",
    "fx_changes": f"""
SELECT 'ACC-' || c_custkey AS account_id, 'c' AS op, 'cust_' || c_custkey AS customer_id,
       epoch_ms(TIMESTAMP '2024-01-01') AS t FROM customer WHERE c_custkey % 13 <> 0
UNION ALL
SELECT 'ACC-' || c_custkey, 'u', 'cust_' || (c_custkey + 1), epoch_ms(TIMESTAMP '2024-01-15')
FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 10 = 3
UNION ALL
SELECT 'ACC-' || c_custkey, 'd', NULL, epoch_ms(TIMESTAMP '2024-01-20')
FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 = 5""",
    "snapshot": """
SELECT account_id, arg_max(customer_id, t) AS customer_id, max(t) AS as_of FROM fx_changes
GROUP BY account_id HAVING arg_max(op, t) <> 'd'""",
    "fx_tx_graph": """
SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, 'ACC-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS src,
       'ACC-' || lpad(CAST(o_custkey - o_custkey % 6 + (o_orderkey * 7 + o_custkey * 3) % 6 AS VARCHAR), 6, '0') AS dst,
       o_totalprice AS amount, epoch_us(o_orderdate) // 1000 AS t
FROM orders""",
    "fx_incidents": """
SELECT o_orderkey AS incident_id, 'cust_' || o_custkey AS identity_key,
       CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED_FRAUD'
            WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'OPEN' ELSE 'INVESTIGATING' END
            ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'RESOLVED_OTHER' ELSE 'FALSE_POSITIVE' END END AS status,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       epoch_us(o_orderdate) // 1000 AS created_at, updated_at
FROM orders JOIN (SELECT l_orderkey, max(epoch_us(l_shipdate) // 1000) AS updated_at FROM lineitem GROUP BY l_orderkey)
  ON l_orderkey = o_orderkey""",
    "fx_alerts": """
SELECT 'alt_' || event_id AS alert_id, 'cust_' || user_id AS identity_key, value * 2 AS risk_score,
       CASE WHEN n % 3 = 0 THEN 'python-secondary' ELSE 'flink-primary' END AS engine_source,
       CASE WHEN n % 3 = 0 THEN 'fraud_alerts' ELSE 'fraud_alerts_v2' END AS source_topic, t AS event_time
FROM ev WHERE event_type = 'error'""",
    "fx_risk": """
SELECT event_id, n, customer_id AS identity_key, customer_id, NULL AS account_id, t, 'login_events' AS source_table,
       device_id, country, success, NULL::DOUBLE AS amount, NULL::VARCHAR AS endpoint FROM fx_logins
UNION ALL
SELECT transaction_id, n, 'cust_' || substr(from_account, 5), 'cust_' || substr(from_account, 5), from_account, t, 'transactions',
       NULL, NULL, NULL, amount, NULL FROM fx_transfers
UNION ALL
SELECT request_id, n, 'ip:' || ip_address, NULL, NULL, t, 'api_requests', NULL, NULL, NULL, NULL, endpoint FROM fx_api""",
    "seg": f"""
SELECT *, max(CASE WHEN prev IS NULL OR t - prev >= {48 * H} THEN t END)
            OVER (PARTITION BY identity_key ORDER BY t, event_id) AS segment
FROM (SELECT *, lag(t) OVER (PARTITION BY identity_key ORDER BY t, event_id) AS prev FROM fx_risk)""",
    "grp": """
SELECT *, count(*) FILTER (WHERE success) OVER (PARTITION BY identity_key, segment ORDER BY t, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM seg""",
    "facts": f"""
SELECT *,
  last_value(device_id IGNORE NULLS) OVER past AS prev_device,
  last_value(country IGNORE NULLS) OVER past AS prev_country,
  last_value(CASE WHEN source_table = 'login_events' THEN t END IGNORE NULLS) OVER past AS prev_login,
  count(*) FILTER (WHERE NOT success) OVER (PARTITION BY identity_key, segment, g ORDER BY t
     RANGE BETWEEN {2 * D} PRECEDING AND CURRENT ROW) AS failures,
  count(*) OVER (PARTITION BY identity_key, segment, source_table ORDER BY t
     RANGE BETWEEN {48 * H} PRECEDING AND CURRENT ROW) AS in_48h,
  lag(t, 4) OVER (PARTITION BY identity_key, segment, source_table ORDER BY t, event_id) AS fourth_before
FROM grp
WINDOW past AS (PARTITION BY identity_key, segment ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "ind": f"""
SELECT identity_key, event_id, n, t, source_table, segment, customer_id, account_id, list_filter([
  CASE WHEN prev_device <> device_id THEN 'NEW_DEVICE' END,
  CASE WHEN prev_country <> country THEN 'NEW_COUNTRY' END,
  CASE WHEN prev_country <> country AND t - prev_login <= {2 * H} THEN 'IMPOSSIBLE_TRAVEL' END,
  CASE WHEN NOT success AND failures >= 2 THEN 'MULTIPLE_FAILED_LOGINS' END,
  CASE WHEN amount > 100 THEN 'LARGE_TRANSFER_AMOUNT' END,
  CASE WHEN source_table = 'transactions' AND in_48h >= 3 THEN 'VELOCITY_VIOLATION' END,
  CASE WHEN source_table = 'api_requests' AND t - fourth_before <= {24 * H} THEN 'SUSPICIOUS_API_PATTERN' END
  ], lambda x: x IS NOT NULL) AS inds
FROM facts""",
    "weights": """
SELECT * FROM (VALUES ('NEW_DEVICE', 30, 30), ('NEW_COUNTRY', 35, 40), ('MULTIPLE_FAILED_LOGINS', 25, 35),
  ('IMPOSSIBLE_TRAVEL', 50, 60), ('LARGE_TRANSFER_AMOUNT', 35, 25), ('VELOCITY_VIOLATION', 30, 30),
  ('SUSPICIOUS_API_PATTERN', 20, 20)) AS w(name, primary_w, secondary_w)""",
    "exploded": """
SELECT identity_key, event_id, customer_id, t, unnest(inds) AS name, generate_subscripts(inds, 1) - 1 AS pos FROM ind""",
    "weighed": f"""
SELECT ind.*, coalesce(s.w, 0) AS w, (ind.t - segment) // {12 * H} AS k,
       row_number() OVER (PARTITION BY identity_key, segment ORDER BY ind.t, event_id) AS rn
FROM ind LEFT JOIN (SELECT identity_key AS i, event_id AS e, CAST(sum(primary_w) AS BIGINT) AS w
                    FROM exploded JOIN weights USING (name) GROUP BY ALL) s ON s.i = identity_key AND s.e = event_id""",
    "walk": f"""
SELECT identity_key, segment, rn, event_id, t, w, k, inds, customer_id, account_id, CAST(w AS BIGINT) AS score, inds AS listed,
       w > 80 AS fired, CASE WHEN w > 80 THEN t END AS alerted
FROM weighed WHERE rn = 1
UNION ALL
SELECT x.identity_key, x.segment, x.rn, x.event_id, x.t, x.w, x.k, x.inds, x.customer_id, x.account_id, x.score, x.listed, x.fired,
       CASE WHEN x.fired THEN x.t ELSE x.was END
FROM (SELECT n.*, (p.score >> CAST(least(n.k - p.k, 40) AS INTEGER)) + n.w AS score,
             list_slice(list_concat(p.listed, n.inds), -8, -1) AS listed, p.alerted AS was,
             (p.score >> CAST(least(n.k - p.k, 40) AS INTEGER)) + n.w > 80
               AND (p.alerted IS NULL OR n.t - p.alerted >= {6 * H}) AS fired
      FROM walk p JOIN weighed n ON n.identity_key = p.identity_key AND n.segment = p.segment AND n.rn = p.rn + 1) x""",
    "alerts_out": f"""
SELECT regexp_replace(identity_key, '[^a-zA-Z0-9]', '', 'g') || '-' || (CASE WHEN score >= 100 THEN 'critical' ELSE 'fraud' END)
         || '-' || ((t // {6 * H}) * {6 * H}) AS alert_id,
       identity_key, customer_id, account_id, t AS event_time, CASE WHEN score >= 100 THEN 'CRITICAL' ELSE 'FRAUD' END AS severity,
       CAST(score AS BIGINT) AS cumulative_score, CAST(80 AS BIGINT) AS threshold, listed AS contributing_indicators,
       inds[-1] AS trigger_reason, t AS first_seen_ts, t AS latest_seen_ts, [event_id] AS source_event_ids,
       CASE WHEN score >= 100 THEN 'LOCK_ACCOUNT' ELSE 'REQUIRE_MFA' END AS action_required
FROM walk WHERE fired""",
    "sec_facts": f"""
SELECT *,
  last_value(device_id IGNORE NULLS) OVER past AS prev_device,
  last_value(country IGNORE NULLS) OVER past AS prev_country,
  last_value(CASE WHEN source_table = 'login_events' THEN t END IGNORE NULLS) OVER past AS prev_login,
  lag(t, 1) OVER (PARTITION BY identity_key, source_table, success ORDER BY t, event_id) AS first_before,
  lag(t, 2) OVER (PARTITION BY identity_key, source_table ORDER BY t, event_id) AS second_before,
  lag(t, 4) OVER (PARTITION BY identity_key, source_table ORDER BY t, event_id) AS fourth_before
FROM fx_risk WHERE source_table <> 'api_requests' OR regexp_matches(endpoint, '/transfers|/login|/beneficiaries')
WINDOW past AS (PARTITION BY identity_key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "sec_ind": f"""
SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY t, event_id) AS rn, list_filter([
  CASE WHEN prev_device <> device_id THEN 'NEW_DEVICE' END,
  CASE WHEN prev_country <> country THEN 'NEW_COUNTRY' END,
  CASE WHEN prev_country <> country AND t - prev_login < {2 * H} THEN 'IMPOSSIBLE_TRAVEL' END,
  CASE WHEN NOT success AND t - first_before <= {2 * D} THEN 'MULTIPLE_FAILED_LOGINS' END,
  CASE WHEN amount > 100 THEN 'LARGE_TRANSFER_AMOUNT' END,
  CASE WHEN source_table = 'transactions' AND t - second_before <= {48 * H} THEN 'VELOCITY_VIOLATION' END,
  CASE WHEN source_table = 'api_requests' AND t - fourth_before <= {24 * H} THEN 'SUSPICIOUS_API_PATTERN' END
  ], lambda x: x IS NOT NULL) AS inds
FROM sec_facts""",
    "sec_weighed": """
SELECT i.*, CAST(coalesce(s.w, 0) AS DOUBLE) AS w
FROM sec_ind i LEFT JOIN (SELECT identity_key AS k, event_id AS e, sum(secondary_w) AS w
   FROM (SELECT identity_key, event_id, unnest(inds) AS name FROM sec_ind) JOIN weights USING (name) GROUP BY ALL) s
  ON s.k = identity_key AND s.e = event_id""",
    "sec_walk": f"""
SELECT identity_key, rn, event_id, account_id, t, w AS score, inds AS listed, w >= 80 AS fired,
       CASE WHEN w >= 80 THEN 0.0 ELSE w END AS kept, CASE WHEN w >= 80 THEN [] ELSE inds END AS list_kept,
       CASE WHEN w >= 80 THEN t END AS alerted, t AS clock
FROM sec_weighed WHERE rn = 1
UNION ALL
SELECT identity_key, rn, event_id, account_id, t, score, listed, fired, CASE WHEN fired THEN 0.0 ELSE score END,
       CASE WHEN fired THEN [] ELSE listed END, CASE WHEN fired THEN t ELSE was END, clock
FROM (SELECT *, score >= 80 AND (was IS NULL OR t - was >= {6 * H}) AS fired
      FROM (SELECT n.identity_key, n.rn, n.event_id, n.account_id, n.t,
                   p.kept / pow(2, least((n.t - p.clock) // {12 * H}, 10)) + n.w AS score,
                   list_slice(list_concat(p.list_kept, n.inds), -8, -1) AS listed, p.alerted AS was,
                   CASE WHEN (n.t - p.clock) // {12 * H} > 0 THEN n.t ELSE p.clock END AS clock
            FROM sec_walk p JOIN sec_weighed n ON n.identity_key = p.identity_key AND n.rn = p.rn + 1))""",
    "timeline": """
SELECT customer_id, 'LOGIN_FAILED' AS event_type, t AS event_time, event_id AS row_id, 0.0::DOUBLE AS amount
FROM fx_logins WHERE NOT success
UNION ALL SELECT customer_id, 'BENEFICIARY_ADD', t, beneficiary_id, 0.0 FROM fx_beneficiaries
UNION ALL SELECT c.customer_id, 'TRANSFER', x.t, x.transaction_id, x.amount
FROM fx_transfers x JOIN fx_changes c ON c.account_id = x.from_account AND c.op IN ('c', 'r')""",
    "assigned": f"""
SELECT *, md5(identity_key || '|' || opened_at) AS incident_id
FROM (SELECT *, max(CASE WHEN prev IS NULL OR event_time - prev > {12 * H} THEN event_time END)
                  OVER (PARTITION BY identity_key ORDER BY event_time, alert_id) AS opened_at
      FROM (SELECT *, lag(event_time) OVER (PARTITION BY identity_key ORDER BY event_time, alert_id) AS prev FROM fx_alerts))""",
    "rolled": """
SELECT incident_id, identity_key, 'Fraud Alert: ANOMALY_DETECTED' AS title, 'OPEN' AS status,
       CASE WHEN max(risk_score) >= 90 THEN 'CRITICAL' WHEN max(risk_score) >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       count(*) AS alert_count, max(risk_score) AS max_risk_score, min(event_time) AS first_alert_at,
       max(event_time) AS last_alert_at, max(event_time) AS updated_at,
       array_to_string(list_sort(list(DISTINCT engine_source)), ',') AS engine_sources,
       count(DISTINCT engine_source) > 1 AS corroborated
FROM assigned GROUP BY incident_id, identity_key""",
    "case_rows": f"""
SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY "at", rank, row_id) AS rn
FROM (SELECT identity_key, event_time AS "at", 0 AS rank, alert_id AS row_id, 'alert' AS kind, risk_score, engine_source,
             NULL::VARCHAR AS new_status, NULL::VARCHAR AS given FROM fx_alerts
      UNION ALL
      SELECT identity_key, event_time + {H} * (1 + day % 3), 1, 'chg_' || alert_id, CASE WHEN said IS NULL THEN 'assign' ELSE 'status' END,
             NULL, NULL, said, CASE WHEN said IS NULL THEN 'analyst_' || (day % 5) END
      FROM (SELECT *, CASE WHEN day % 4 = 0 THEN 'CONFIRMED_FRAUD' WHEN day % 4 = 1 THEN 'FALSE_POSITIVE' WHEN day % 8 = 2 THEN 'OPEN' END AS said
            FROM (SELECT *, event_time // {D} AS day FROM fx_alerts)) WHERE day % 8 <> 7)""",
    "case_walk": f"""
SELECT DISTINCT identity_key, 0::BIGINT AS rn, NULL::BIGINT AS opened, NULL::VARCHAR AS status, NULL::BIGINT AS touched FROM case_rows
UNION ALL
SELECT identity_key, rn, CASE WHEN fresh THEN "at" ELSE opened END,
       CASE WHEN fresh THEN 'OPEN' WHEN opened IS NULL OR kind = 'alert' THEN status WHEN kind = 'status' THEN new_status
            WHEN status = 'OPEN' THEN 'INVESTIGATING' ELSE status END,
       CASE WHEN fresh OR opened IS NOT NULL THEN "at" END
FROM (SELECT n.identity_key, n.rn, n."at", n.kind, n.new_status, p.opened, p.status,
             n.kind = 'alert' AND (p.opened IS NULL OR p.status NOT IN ('OPEN', 'INVESTIGATING') OR n."at" - p.touched > {12 * H}) AS fresh
      FROM case_walk p JOIN case_rows n ON n.identity_key = p.identity_key AND n.rn = p.rn + 1)""",
    "changes": f"""
SELECT incident_id, 'a' AS change_id, created_at + {H} AS "at", 'assign' AS kind, NULL::VARCHAR AS new_status,
       'analyst_' || (incident_id % 5) AS assigned_to, 'lead' AS changed_by, NULL::VARCHAR AS notes FROM fx_incidents WHERE incident_id % 3 = 0
UNION ALL
SELECT incident_id, 'b', updated_at, 'status', status, NULL, 'analyst_' || (incident_id % 5), 'reviewed'
FROM fx_incidents WHERE status <> 'OPEN'""",
    "log": """
SELECT incident_id, '' AS change_id, created_at AS "at", 'open' AS kind, 'OPEN' AS new_status, NULL::VARCHAR AS assigned_to,
       NULL::VARCHAR AS changed_by, NULL::VARCHAR AS notes, 1 AS rn FROM fx_incidents
UNION ALL
SELECT *, 1 + row_number() OVER (PARTITION BY incident_id ORDER BY "at", change_id) FROM changes""",
    "applied": """
SELECT *, NULL::VARCHAR AS previous_status, new_status AS status FROM log WHERE rn = 1
UNION ALL
SELECT n.*, p.status, CASE WHEN n.kind = 'status' THEN n.new_status WHEN p.status = 'OPEN' THEN 'INVESTIGATING' ELSE p.status END
FROM applied p JOIN log n ON n.incident_id = p.incident_id AND n.rn = p.rn + 1""",
    "audits": """
SELECT incident_id, change_id, previous_status, status AS new_status, changed_by,
       CASE WHEN kind = 'status' THEN notes
            ELSE 'Under investigation since it was given to ' || assigned_to END AS notes, "at"
FROM applied WHERE kind = 'status' OR (kind = 'assign' AND previous_status = 'OPEN')""",
    "ring_edges": f"""
SELECT src, dst, sum(CAST(amount AS DECIMAL(18,2))) AS total_amount, count(*) AS transfers
FROM fx_tx_graph WHERE t >= (SELECT max(t) FROM fx_tx_graph) - {365 * D} GROUP BY src, dst""",
    "paths": """
SELECT src AS start, dst AS tail, [src, dst] AS members, CAST(total_amount AS DECIMAL(28,2)) AS volume
FROM ring_edges WHERE dst > src
UNION ALL
SELECT p.start, e.dst, list_append(p.members, e.dst), CAST(p.volume + e.total_amount AS DECIMAL(28,2))
FROM paths p JOIN ring_edges e ON e.src = p.tail
WHERE e.dst > p.start AND NOT list_contains(p.members, e.dst) AND len(p.members) < 6""",
    "rings": """
SELECT p.members, len(p.members) AS hop_count, CAST(p.volume + e.total_amount AS DECIMAL(28,2)) AS volume
FROM paths p JOIN ring_edges e ON e.src = p.tail AND e.dst = p.start WHERE len(p.members) >= 3""",
    "edges": f"""
SELECT 'CUST-' || customer_id AS src, account_id AS dst, 'OWNS' AS relationship, NULL::DOUBLE AS amount, NULL::BIGINT AS t,
       NULL::VARCHAR AS detail, NULL::VARCHAR AS status FROM snapshot
UNION ALL
SELECT from_account, to_account, 'TRANSFERRED_TO', amount, t, transaction_id, NULL FROM fx_transfers
WHERE t >= (SELECT max(t) FROM ev WHERE event_type <> 'signup') - {7 * D}
UNION ALL
SELECT DISTINCT 'CUST-' || customer_id, 'DEV-' || device_id, 'USED_DEVICE', NULL::DOUBLE, NULL::BIGINT, NULL, NULL FROM fx_logins
UNION ALL
SELECT 'CUST-' || customer_id, 'IP-' || ip_address, 'LOGGED_IN_FROM', NULL, t, NULL,
       CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END FROM fx_logins
WHERE t >= (SELECT max(t) FROM ev WHERE event_type <> 'signup') - {7 * D}""",
    "nodes": """
SELECT id, min(label) AS label FROM (
  SELECT src AS id, CASE relationship WHEN 'TRANSFERRED_TO' THEN 'ACCOUNT' ELSE 'CUSTOMER' END AS label FROM edges
  UNION ALL
  SELECT dst, CASE relationship WHEN 'USED_DEVICE' THEN 'DEVICE' WHEN 'LOGGED_IN_FROM' THEN 'IP' ELSE 'ACCOUNT' END FROM edges)
GROUP BY id""",
    "shared": """
SELECT 'RING-INFRA-' || left(md5(dst), 8) AS ring_id, dst, count(DISTINCT src) AS customers,
       any_value(relationship) AS relationship
FROM edges WHERE relationship IN ('USED_DEVICE', 'LOGGED_IN_FROM') GROUP BY dst HAVING count(DISTINCT src) >= 3""",
    "links2": "SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges",
    "reach": """
SELECT DISTINCT a AS id, 0::BIGINT AS distance FROM links2 WHERE a = 'ACC-7'
UNION
SELECT b, distance + 1 FROM reach JOIN links2 ON a = id WHERE distance < 2""",
    "ego": "SELECT id, min(distance) AS distance FROM reach GROUP BY id",
    "missing": """
SELECT account_id, arg_min(customer_id, side) AS customer_id FROM (
  SELECT from_account AS account_id, 0 AS side, 'cust_' || substr(from_account, 5) AS customer_id FROM fx_transfers
  UNION ALL SELECT to_account, 1, 'cust_external_mule' FROM fx_transfers)
WHERE account_id NOT IN (SELECT account_id FROM snapshot) GROUP BY account_id""",
    "labelled": """
SELECT customer_id, event_id, t, pos, name,
       CASE name WHEN 'NEW_DEVICE' THEN 30 WHEN 'VELOCITY_VIOLATION' THEN 30 END AS acc_w,
       CASE name WHEN 'VELOCITY_VIOLATION' THEN 30 WHEN 'IMPOSSIBLE_TRAVEL' THEN 50 ELSE 10 END AS clr_w
FROM exploded""",
    "acc_rows": """
SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t, event_id, pos) AS rn
FROM labelled WHERE customer_id IS NOT NULL AND acc_w IS NOT NULL""",
    "acc_walk": f"""
SELECT customer_id, rn, event_id, t, acc_w AS score, [name] AS listed, acc_w AS kept, [name] AS list_kept FROM acc_rows WHERE rn = 1
UNION ALL
SELECT customer_id, rn, event_id, t, score, listed, CASE WHEN score >= 80 THEN 0 ELSE score END,
       CASE WHEN score >= 80 THEN [] ELSE listed END
FROM (SELECT n.customer_id, n.rn, n.event_id, n.t,
             CASE WHEN n.t - p.t > {D} THEN 0 ELSE p.kept END + n.acc_w AS score,
             list_append(CASE WHEN n.t - p.t > {D} THEN [] ELSE p.list_kept END, n.name) AS listed
      FROM acc_walk p JOIN acc_rows n ON n.customer_id = p.customer_id AND n.rn = p.rn + 1)""",
    "clr_rows": """
SELECT * REPLACE (coalesce(customer_id, 'unknown_ip') AS customer_id),
       row_number() OVER (PARTITION BY coalesce(customer_id, 'unknown_ip') ORDER BY t, event_id, pos) AS rn FROM labelled""",
    "clr_walk": """
SELECT customer_id, rn, event_id, t, pos, clr_w AS score, [name] AS listed, clr_w AS kept, [name] AS list_kept FROM clr_rows WHERE rn = 1
UNION ALL
SELECT customer_id, rn, event_id, t, pos, score, listed, CASE WHEN score >= 80 THEN 0 ELSE score END,
       CASE WHEN score >= 80 THEN [] ELSE listed END
FROM (SELECT n.customer_id, n.rn, n.event_id, n.t, n.pos, p.kept + n.clr_w AS score, list_append(p.list_kept, n.name) AS listed
      FROM clr_walk p JOIN clr_rows n ON n.customer_id = p.customer_id AND n.rn = p.rn + 1)""",
    "calls": """
SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY t, request_id) AS rn
FROM fx_api WHERE regexp_matches(endpoint, '/transfers|/login|/beneficiaries')""",
    "box": f"""
SELECT ip_address, rn, endpoint, t, [t] AS hits, false AS fired, NULL::BIGINT AS alerted FROM calls WHERE rn = 1
UNION ALL
SELECT ip_address, rn, endpoint, t, CASE WHEN len(seen) >= 3 THEN [] ELSE seen END, len(seen) >= 3,
       CASE WHEN len(seen) >= 3 THEN t ELSE alerted END
FROM (SELECT n.ip_address, n.rn, n.endpoint, n.t, p.alerted,
             CASE WHEN p.alerted IS NOT NULL AND n.t - p.alerted < {2 * D} THEN []
                  ELSE list_append(list_filter(p.hits, lambda h: n.t - h <= {D}), n.t) END AS seen
      FROM box p JOIN calls n ON n.ip_address = p.ip_address AND n.rn = p.rn + 1)""",
    "repeats": f"""
SELECT transaction_id || '-' || h AS event_id, from_account AS identity_key,
       CASE WHEN n % 7 <> 0 THEN 'transactions:' || transaction_id END AS dedup_key, t + h * {H} AS event_time
FROM fx_transfers, (VALUES (0), (12), (23), (30)) AS x(h)""",
    "repeats_no": """
SELECT *, row_number() OVER (PARTITION BY identity_key, dedup_key ORDER BY event_time, event_id) AS rn
FROM repeats WHERE dedup_key IS NOT NULL""",
    "dedup_walk": f"""
SELECT *, true AS kept, event_time AS last FROM repeats_no WHERE rn = 1
UNION ALL
SELECT n.*, n.event_time - p.last > {D}, CASE WHEN n.event_time - p.last > {D} THEN n.event_time ELSE p.last END
FROM dedup_walk p JOIN repeats_no n ON n.identity_key = p.identity_key AND n.dedup_key = p.dedup_key AND n.rn = p.rn + 1""",
    "ato_rows": "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY event_time, row_id) AS pos FROM timeline",
    "ato_b": """
SELECT customer_id, pos, event_time, min(CASE WHEN event_type = 'TRANSFER' THEN pos END)
         OVER (PARTITION BY customer_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t_pos, event_type FROM ato_rows""",
    "ato_f": """
SELECT customer_id, pos, event_time, event_type, min(CASE WHEN event_type = 'BENEFICIARY_ADD' THEN pos END)
         OVER (PARTITION BY customer_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b_pos FROM ato_rows""",
    "ato_cand": f"""
SELECT f.customer_id, f.pos AS f_pos, b.t_pos, f.event_time AS f_t, b.event_time AS b_t, t.event_time AS t_t, t.amount,
       row_number() OVER (PARTITION BY f.customer_id ORDER BY f.pos) AS rn
FROM ato_f f JOIN ato_b b ON b.customer_id = f.customer_id AND b.pos = f.b_pos
     JOIN ato_rows t ON t.customer_id = f.customer_id AND t.pos = b.t_pos
WHERE f.event_type = 'LOGIN_FAILED' AND t.event_time - f.event_time < {48 * H}""",
    "ato_walk": """
SELECT *, true AS kept, t_pos AS last FROM ato_cand WHERE rn = 1
UNION ALL
SELECT n.*, n.f_pos > p.last, CASE WHEN n.f_pos > p.last THEN n.t_pos ELSE p.last END
FROM ato_walk p JOIN ato_cand n ON n.customer_id = p.customer_id AND n.rn = p.rn + 1""",
    "located": """
SELECT l.*, CASE WHEN n % 10 <> 0 THEN lat END AS latitude, CASE WHEN n % 10 <> 0 THEN lon END AS longitude
FROM fx_logins l JOIN (VALUES ('US', 39.8, -98.6), ('CA', 56.1, -106.3), ('KE', 0.0, 37.9), ('RU', 61.5, 105.3), ('CN', 35.9, 104.2))
  AS c(country, lat, lon) USING (country)""",
}

# The secondary engine once more, on events as it identifies them itself.
VIEWS["fx_sec"] = """
SELECT event_id, n, customer_id AS identity_key, customer_id, NULL AS account_id, t, 'login_events' AS source_table,
       device_id, country, success OR n % 35 = 0 AS success, NULL::DOUBLE AS amount, NULL::VARCHAR AS endpoint
FROM fx_logins WHERE n % 11 <> 0
UNION ALL
SELECT 'tx-' || transaction_id, n, coalesce(s.customer_id, 'acct:' || from_account), NULL, from_account, t, 'transactions',
       NULL, NULL, NULL, amount, NULL FROM fx_transfers LEFT JOIN snapshot s ON s.account_id = from_account
UNION ALL
SELECT request_id, n, 'ip:' || ip_address, NULL, NULL, t, 'api_requests', NULL, NULL, NULL, NULL, endpoint
FROM fx_api WHERE n % 13 <> 0"""
for _name in ("sec_facts", "sec_ind", "sec_weighed", "sec_walk"):
    VIEWS[_name.replace("sec_", "own_")] = VIEWS[_name].replace("fx_risk", "fx_sec").replace("sec_", "own_")

BODIES = {
    "normalize_events": """
SELECT event_id, customer_id, NULL::VARCHAR AS account_id, NULL::VARCHAR AS indicator, t AS event_time, 'login_events' AS source_table,
       'lsn-' || event_id AS dedup_key, country, device_id, success AS login_success, NULL::DOUBLE AS amount,
       NULL::VARCHAR AS beneficiary_id, ip_address, NULL::VARCHAR AS from_account_id, NULL::VARCHAR AS to_account_id,
       customer_id AS identity_key, NULL::VARCHAR AS endpoint FROM fx_logins WHERE n % 11 <> 0
UNION ALL
SELECT NULL, NULL, from_account, NULL, t, 'transactions', 'tx-' || transaction_id, NULL, NULL, NULL, amount, to_account, NULL,
       from_account, to_account, 'acct:' || from_account, NULL FROM fx_transfers
UNION ALL
SELECT request_id, NULL, NULL, NULL, t, 'api_requests', 'api_requests:' || request_id, NULL, NULL, NULL, NULL, NULL, ip_address,
       NULL, NULL, 'ip:' || ip_address, endpoint FROM fx_api WHERE n % 13 <> 0""",
    "telemetry_dead_letter": """
SELECT request_id, CASE WHEN n % 17 <> 0 AND n % 19 = 0 THEN t + 1000 ELSE t END AS timestamp,
       CASE WHEN n % 17 = 0 THEN 'field status_code: expected int, found STRING' END AS error_message FROM fx_api""",
    "dedup_events": """
SELECT event_id, identity_key, dedup_key, event_time FROM dedup_walk WHERE kept
UNION ALL SELECT event_id, identity_key, dedup_key, event_time FROM repeats WHERE dedup_key IS NULL""",
    "account_snapshot": "SELECT account_id, customer_id, as_of FROM snapshot",
    "account_enrichment": """
SELECT x.transaction_id AS event_id, c.customer_id, x.from_account AS from_account_id,
       coalesce(c.customer_id, 'acct:' || x.from_account) AS identity_key, x.t AS event_time
FROM fx_transfers x ASOF LEFT JOIN fx_changes c ON c.account_id = x.from_account AND x.t >= c.t""",
    "historical_context": f"""
SELECT event_id, customer_id AS identity_key, t AS event_time,
       min(t) OVER (PARTITION BY customer_id) < t - {D} AS seen_beyond_state_window FROM fx_logins""",
    "risk_indicators": """
SELECT identity_key, event_id, t AS event_time, source_table, segment, array_to_string(inds, ',') AS indicators FROM ind""",
    "risk_scores": "SELECT identity_key, event_id, t AS event_time, CAST(w AS BIGINT) AS weight, CAST(score AS BIGINT) AS score FROM walk",
    "risk_alerts": """
SELECT * REPLACE (array_to_string(contributing_indicators, ',') AS contributing_indicators,
                  array_to_string(source_event_ids, ',') AS source_event_ids) FROM alerts_out""",
    "alerts_by_severity": """
SELECT CASE severity WHEN 'CRITICAL' THEN 'critical_alerts_v2' ELSE 'fraud_alerts_v2' END AS topic, severity, count(*) AS alerts,
       CAST(sum(cumulative_score) AS BIGINT) AS total_score FROM alerts_out GROUP BY ALL""",
    "alerts_json": """
SELECT CASE severity WHEN 'CRITICAL' THEN 'critical_alerts_v2' ELSE 'fraud_alerts_v2' END AS topic, identity_key AS key,
       CAST(json_object('alert_id', alert_id, 'customer_id', customer_id, 'account_id', account_id, 'event_time', event_time,
         'severity', severity, 'cumulative_score', cumulative_score, 'threshold', threshold,
         'contributing_indicators', contributing_indicators, 'trigger_reason', trigger_reason, 'first_seen_ts', first_seen_ts,
         'latest_seen_ts', latest_seen_ts, 'source_event_ids', source_event_ids, 'action_required', action_required) AS VARCHAR) AS value
FROM alerts_out""",
    "secondary_risk_alerts": f"""
SELECT 'SEC-' || identity_key || '-' || (t // {6 * H}) AS alert_id, identity_key, identity_key AS customer_id, account_id,
       t AS event_time, CASE WHEN score >= 100 THEN 'CRITICAL' ELSE 'FRAUD' END AS severity, round_even(score, 2) AS cumulative_score,
       CAST(80 AS BIGINT) AS threshold, array_to_string(listed, ',') AS contributing_indicators,
       coalesce(listed[-1], 'ANOMALY_DETECTED') AS trigger_reason, t AS first_seen_ts, t AS latest_seen_ts,
       CASE WHEN score >= 100 THEN 'FREEZE_ACCOUNT' ELSE 'REQUIRE_MFA' END AS action_required, 'python-secondary' AS engine_source
FROM sec_walk WHERE fired""",
    "inactivity_reset_alerts": """
SELECT 'ALT-' || (t // 1000) AS alert_id, customer_id, event_id, t AS event_time, CAST(score AS BIGINT) AS cumulative_score,
       array_to_string(listed, ',') AS contributing_indicators,
       CASE WHEN score >= 100 THEN 'FREEZE_ACCOUNT' ELSE 'REQUIRE_MFA' END AS action_required FROM acc_walk WHERE score >= 80""",
    "threshold_clear_alerts": """
SELECT 'ALT-' || upper(left(md5(customer_id || '|' || t || '|' || event_id || '|' || pos), 10)) AS alert_id, customer_id, event_id,
       t AS event_time, CAST(score AS BIGINT) AS cumulative_score, array_to_string(listed, ',') AS contributing_indicators,
       CASE WHEN score < 100 THEN 'REQUIRE_MFA' ELSE 'LOCK_ACCOUNT' END AS action_required FROM clr_walk WHERE score >= 80""",
    "ip_velocity_alerts": f"""
SELECT ip_address AS customer_id, 'VELOCITY_VIOLATION' AS risk_indicator_type, endpoint, CAST(3 AS BIGINT) AS hits,
       CAST({D // 1000} AS BIGINT) AS window_sec, t AS timestamp FROM box WHERE fired""",
    "indicator_counts": "SELECT identity_key, name AS indicator, count(*) AS n FROM exploded GROUP BY ALL",
    "identities_tracked": """
SELECT count(DISTINCT identity_key) AS identities,
       count(DISTINCT identity_key) FILTER (WHERE starts_with(identity_key, 'cust_')) AS with_prefix FROM fx_risk""",
    "unified_timeline": "SELECT * FROM timeline",
    "ato_sequence": """
SELECT customer_id, 'CEP_ATO_MATCH' AS risk_indicator_type, f_t AS initial_failed_login, b_t AS beneficiary_added_time,
       t_t AS exfiltration_transfer_time, amount AS stolen_funds FROM ato_walk WHERE kept""",
    "decode_alerts": """
SELECT source_topic, alert_id, identity_key, event_time, risk_score, 'ANOMALY_DETECTED' AS indicator, engine_source FROM fx_alerts""",
    "alert_decoding": f"""
SELECT source_topic, CASE (event_time // {D}) % 5 WHEN 0 THEN 'binary wire format' WHEN 1 THEN 'not a JSON record' ELSE 'decoded' END AS outcome,
       count(*) AS messages FROM fx_alerts GROUP BY ALL""",
    "incidents": "SELECT * FROM rolled",
    "incident_detail": """
SELECT incident_id, r.identity_key, title, status, severity, alert_count, corroborated, 'alert' AS child, alert_id AS child_id,
       'ANOMALY_DETECTED' AS label, risk_score, event_time AS "at" FROM rolled r JOIN assigned USING (incident_id)""",
    "incident_lifecycle": """
SELECT md5(w.identity_key || '|' || opened) AS incident_id, w.identity_key, 'Fraud Alert: ANOMALY_DETECTED' AS title,
       arg_max(status, w.rn) AS status,
       CASE WHEN max(risk_score) >= 90 THEN 'CRITICAL' WHEN max(risk_score) >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       count(*) FILTER (kind = 'alert') AS alert_count, max(risk_score) AS max_risk_score,
       min("at") FILTER (kind = 'alert') AS first_alert_at, max("at") FILTER (kind = 'alert') AS last_alert_at, max("at") AS updated_at,
       array_to_string(list_sort(list(DISTINCT engine_source) FILTER (kind = 'alert')), ',') AS engine_sources,
       count(DISTINCT engine_source) > 1 AS corroborated, arg_max(given, w.rn) AS assigned_to
FROM case_walk w JOIN case_rows r ON r.identity_key = w.identity_key AND r.rn = w.rn WHERE opened IS NOT NULL GROUP BY w.identity_key, opened""",
    "incident_transitions": "SELECT * FROM audits",
    "incident_states": """
SELECT a.incident_id, arg_max(a.status, a.rn) AS status, max(a.assigned_to) AS assigned_to,
       max(CASE WHEN a.kind = 'open' OR u.change_id IS NOT NULL THEN a."at" END) AS updated_at, count(u.change_id) AS audit_rows
FROM applied a LEFT JOIN audits u ON u.incident_id = a.incident_id AND u.change_id = a.change_id GROUP BY a.incident_id""",
    "case_metrics": """
SELECT count(*) AS total_incidents, count(*) FILTER (WHERE status = 'OPEN') AS open_count,
       count(*) FILTER (WHERE status = 'INVESTIGATING') AS investigating_count,
       count(*) FILTER (WHERE status = 'CONFIRMED_FRAUD') AS confirmed_fraud_count,
       count(*) FILTER (WHERE status = 'FALSE_POSITIVE') AS false_positive_count,
       round(avg((updated_at - created_at) / 1000) FILTER (WHERE status IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE')), 2) AS avg_resolution_time_seconds,
       round(count(*) FILTER (WHERE status = 'CONFIRMED_FRAUD') / count(*) FILTER (WHERE status IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE')), 4) AS precision,
       round(count(*) FILTER (WHERE status = 'FALSE_POSITIVE') / count(*) FILTER (WHERE status IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE')), 4) AS false_positive_rate
FROM fx_incidents""",
    "severity_counts": "SELECT severity, count(*) AS n FROM fx_incidents GROUP BY severity",
    "incident_queue": """
SELECT * FROM fx_incidents WHERE status = 'INVESTIGATING' ORDER BY updated_at DESC, incident_id LIMIT 50 OFFSET 10""",
    "transfer_edges": "SELECT src, dst, CAST(total_amount AS DOUBLE) AS total_amount, transfers FROM ring_edges",
    "circular_rings": """
SELECT 'RING-CIRCULAR-' || left(md5(array_to_string(members, ' -> ')), 8) AS ring_id, 'CIRCULAR_TRANSFER_RING' AS ring_type,
       array_to_string(members, ',') AS members, hop_count, CAST(volume AS DOUBLE) AS total_volume,
       CASE WHEN volume > 10000 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       'Money moves in a circle of ' || hop_count || ' accounts (' || array_to_string(members, ' -> ') || ' -> ' || members[1]
         || '), in all ' || format('{:,.2f}', CAST(volume AS DOUBLE)) AS description FROM rings""",
    "entity_graph_edges": "SELECT * FROM edges",
    "entity_graph_nodes": "SELECT * FROM nodes",
    "graph_scan_counts": "SELECT 'nodes' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges",
    "shared_infrastructure": """
SELECT ring_id, 'SHARED_INFRASTRUCTURE_CLUSTER' AS ring_type, dst AS shared_entity_id, CAST(2 AS BIGINT) AS hop_count, customers,
       CASE WHEN customers >= 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       'Shared by several customers: ' || CASE relationship WHEN 'USED_DEVICE' THEN 'Device Fingerprint' ELSE 'IP Address' END
         || ' ''' || dst || ''' belongs to ' || customers || ' customers' AS description FROM shared""",
    "shared_infrastructure_members": """
SELECT DISTINCT ring_id, src AS member FROM shared JOIN edges USING (dst)
WHERE edges.relationship IN ('USED_DEVICE', 'LOGGED_IN_FROM')
UNION ALL SELECT ring_id, dst FROM shared""",
    "ego_network": """
SELECT * FROM edges WHERE src IN (SELECT id FROM ego) AND dst IN (SELECT id FROM ego)""",
    "ego_network_nodes": "SELECT id, label, distance FROM nodes JOIN ego USING (id)",
    "provisional_accounts": """
SELECT account_id, customer_id, 15000.0::DOUBLE AS balance, 'USD' AS currency, 'ACTIVE' AS status FROM missing""",
    "provisional_customers": """
SELECT DISTINCT customer_id, 'Auto' AS first_name, 'Provisioned' AS last_name, customer_id || '@auto-generated.io' AS email,
       'UNKNOWN' AS country, 'HIGH' AS risk_level FROM missing
WHERE customer_id NOT IN (SELECT 'cust_' || c_custkey FROM customer)""",
    "account_balances": """
SELECT 'ACC-' || c_custkey AS account_id, CAST(CAST(c_acctbal AS DECIMAL(18,2)) + coalesce(net, 0) AS DOUBLE) AS balance,
       coalesce(movements, 0) AS movements
FROM customer LEFT JOIN (
  SELECT account_id, sum(delta) AS net, count(*) AS movements FROM (
    SELECT from_account AS account_id, -CAST(amount AS DECIMAL(18,2)) AS delta FROM fx_transfers
    UNION ALL SELECT to_account, CAST(amount AS DECIMAL(18,2)) FROM fx_transfers) GROUP BY account_id) m
  ON m.account_id = 'ACC-' || c_custkey""",
    "account_statement": """
SELECT transaction_id, from_account, to_account, amount, t FROM fx_transfers WHERE from_account = 'ACC-7' OR to_account = 'ACC-7'
ORDER BY t DESC, transaction_id LIMIT 100""",
    "employee_mass_access": """
SELECT 'emp_' || (o_orderkey % 20) AS employee_id, count(DISTINCT o_custkey) AS distinct_customers, count(*) AS actions
FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 590""",
    "failed_login_geo": """
SELECT CAST(floor(latitude) AS DOUBLE) AS lat_cell, CAST(floor(longitude) AS DOUBLE) AS lon_cell, country, count(*) AS failures,
       count(DISTINCT customer_id) AS customers
FROM located WHERE NOT success AND latitude IS NOT NULL GROUP BY ALL""",
    "api_request_rollup": """
SELECT method, CASE WHEN starts_with(endpoint, '/api/accounts/') AND contains(endpoint, '/balance') THEN '/api/accounts/{id}/balance'
            WHEN starts_with(endpoint, '/api/accounts/') THEN '/api/accounts/{id}' ELSE endpoint END AS endpoint,
       CAST(status_code AS BIGINT) AS status_code, count(*) AS requests FROM fx_api GROUP BY ALL""",
    "event_rate_5m": """
SELECT (t // 60000) * 60000 - back * 60000 AS window_start, method, count(*) AS n, round(count(*) / 300.0::DOUBLE, 6) AS per_second
FROM fx_api, (VALUES (0), (1), (2), (3), (4)) AS b(back) GROUP BY ALL""",
    "index_documents": """
SELECT event_id, customer_id, success, ip_address, country, device_id, t AS timestamp,
       CASE WHEN latitude IS NULL THEN '' ELSE CAST(latitude AS DECIMAL(9,1)) || ';' || CAST(longitude AS DECIMAL(9,1)) END AS geo_location
FROM located WHERE n % 11 <> 0""",
}

BODIES["secondary_end_to_end"] = BODIES["secondary_risk_alerts"].replace("sec_walk", "own_walk")
# The streams give the rows of their batch twins.
BODIES["stream_risk_alerts"] = BODIES["risk_alerts"]
BODIES["stream_account_enrichment"] = BODIES["account_enrichment"]
BODIES["stream_ato_sequence"] = BODIES["ato_sequence"]
BODIES["stream_incidents"] = BODIES["incidents"]
BODIES["incident_lifecycle_split"] = BODIES["stream_incident_lifecycle"] = BODIES["incident_lifecycle"]
BODIES["stream_risk_revisions"] = BODIES["risk_alerts"]
BODIES["stream_historical_context"] = BODIES["historical_context"]
# Nothing is late there.
BODIES["stream_takeover_sinks"] = """
SELECT 'timeline' AS sink, customer_id, event_type, event_time, row_id, amount, NULL::BIGINT AS begins_at FROM timeline
UNION ALL
SELECT 'takeovers', customer_id, 'CEP_ATO_MATCH', t_t, NULL, amount, f_t FROM ato_walk WHERE kept"""
# How a key is cut into chunks changes no row.
BODIES["risk_alerts_split"] = BODIES["risk_alerts"]
BODIES["threshold_clear_split"] = BODIES["threshold_clear_alerts"]
BODIES["secondary_split"] = BODIES["secondary_risk_alerts"]
BODIES["inactivity_split"] = BODIES["inactivity_reset_alerts"]
BODIES["ip_velocity_split"] = BODIES["ip_velocity_alerts"]
BODIES["ato_split"] = BODIES["ato_sequence"]
BODIES["dedup_split"] = BODIES["dedup_events"]
BODIES["stream_event_rate"] = BODIES["event_rate_5m"]


def _needs(text: str) -> list[str]:
    import re

    words = set(re.findall(r"\w+", text))
    return [name for name in VIEWS if name in words]


def compose(body: str) -> str:
    """The body with exactly the views it needs, in order of definition."""
    wanted, queue = set(), _needs(body)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += [n for n in _needs(VIEWS[name]) if n != name]
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in wanted)
    return f"WITH RECURSIVE {views}\n{body.strip()}" if views else body.strip()


def oracle_sql() -> dict[str, str]:
    return {name: compose(body) for name, body in BODIES.items()}
