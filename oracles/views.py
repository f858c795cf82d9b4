"""Named subqueries that the oracle SQL is put together from.

Each states a step on its own terms: keys are built directly rather than parsed
out of address text, and medians and curves use one window per group.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    # ---- the listing model over the order tables
    "pulls": """
        SELECT DISTINCT 'pull-' || (c_custkey // 100) AS pull_ref,
               DATE '2001-08-01' + CAST((c_custkey // 100) % 5 AS INTEGER) AS as_of,
               CASE (c_custkey // 100) % 3 WHEN 0 THEN 101 WHEN 1 THEN 315 ELSE 1115 END AS season_start,
               CASE (c_custkey // 100) % 3 WHEN 0 THEN 1231 WHEN 1 THEN 930 ELSE 215 END AS season_end
        FROM customer""",
    "base_orders": """
        SELECT o_orderkey AS k, o_custkey AS u, 'pull-' || (o_custkey // 100) AS pull_ref,
               CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS id,
               CAST(o_orderdate AS DATE) AS listed,
               CASE WHEN o_orderkey % 23 <> 0
                    THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey * 37 % 200 + 1 AS INTEGER) END AS removed,
               o_totalprice AS price,
               o_custkey || CASE o_orderkey % 3 WHEN 0 THEN ' West Oak Street' WHEN 1 THEN ' W. Oak St' ELSE '  w oak street,' END AS street,
               o_custkey || ' West Oak Street Rear' AS rear_street,
               CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 5 AS VARCHAR) END AS unit,
               o_custkey || ' w oak st|' || CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 5 AS VARCHAR) ELSE '' END AS front_key,
               o_custkey || ' w oak st rear|' || CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 5 AS VARCHAR) ELSE '' END AS rear_key,
               CASE WHEN o_orderkey % 13 <> 0 THEN 41.8::DOUBLE + (o_custkey % 1000) / 10000.0::DOUBLE ELSE 0.0::DOUBLE END AS lat,
               CASE WHEN o_orderkey % 13 <> 0 THEN -87.7::DOUBLE + (o_custkey % 777) / 10000.0::DOUBLE ELSE 0.0::DOUBLE END AS lng,
               CAST(o_custkey % 4 AS DOUBLE) AS beds,
               CASE WHEN o_orderkey % 5 <> 0 THEN 1 + (o_custkey % 3) * 0.5::DOUBLE END AS baths,
               CASE WHEN o_orderkey % 29 = 0 THEN 0.0::DOUBLE
                    WHEN o_orderkey % 7 <> 0 THEN 500.0::DOUBLE + o_orderkey * 13 % 1500 END AS sqft
        FROM orders""",
    "named_orders": "SELECT * FROM base_orders WHERE k % 251 <> 0",
    "observed": """
        SELECT pull_ref, id, front_key AS own_key, CASE WHEN k % 499 <> 0 THEN listed END AS listed,
               removed, price, unit, lat, lng, beds, baths, sqft, street AS address
        FROM named_orders
        UNION ALL
        SELECT pull_ref, id, front_key, listed, removed, price, unit, lat, lng, beds, baths, sqft, street
        FROM named_orders WHERE k % 5 = 0
        UNION ALL
        SELECT pull_ref, id, front_key, listed - 400, listed - 350, price - 50.0::DOUBLE, unit, lat, lng, beds, baths, sqft, street
        FROM named_orders WHERE k % 5 = 0
        UNION ALL
        SELECT pull_ref, id, rear_key, listed, NULL, price + 100.0::DOUBLE, unit, 0.0::DOUBLE, 0.0::DOUBLE, beds, NULL, NULL, rear_street
        FROM base_orders WHERE k % 11 = 0""",
    "grouped": """
        SELECT *, CASE WHEN id IS NULL THEN own_key ELSE min(own_key) OVER (PARTITION BY pull_ref, id) END AS group_key
        FROM observed""",
    "spells": """
        SELECT * FROM (
          SELECT *, row_number() OVER (
                   PARTITION BY pull_ref, group_key, listed
                   ORDER BY removed IS NOT NULL DESC, removed DESC NULLS LAST,
                            (unit IS NOT NULL)::INT + (baths IS NOT NULL)::INT + (sqft IS NOT NULL)::INT DESC,
                            price DESC) AS place
          FROM grouped WHERE listed IS NOT NULL) WHERE place = 1""",
    "stretches": """
        SELECT *, coalesce(sum((removed IS NULL)::INT) OVER (
                    PARTITION BY pull_ref, group_key ORDER BY listed
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch
        FROM spells""",
    "gaps_off": """
        SELECT *, greatest(0, listed - max(removed) OVER (
                    PARTITION BY pull_ref, group_key, stretch ORDER BY listed
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS off_market_raw,
                  max(removed) OVER (
                    PARTITION BY pull_ref, group_key, stretch ORDER BY listed
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_end
        FROM stretches""",
    "stitched": """
        SELECT *, CAST(sum(starts_chain::INT) OVER (PARTITION BY pull_ref, group_key ORDER BY listed) AS BIGINT) AS chain,
               lag(price) OVER (PARTITION BY pull_ref, group_key ORDER BY listed) AS previous_price
        FROM (SELECT *, CASE WHEN before_end IS NOT NULL THEN CAST(off_market_raw AS INTEGER) END AS off_market,
                     before_end IS NULL OR off_market_raw >= 42 AS starts_chain
              FROM gaps_off)""",
    "folded": """
        SELECT pull_ref, group_key, chain, min(listed) AS first_listed,
               CASE WHEN count(*) = count(removed) THEN max(removed) END AS chain_end,
               arg_min(price, listed) AS initial_ask,
               CAST(count(*) - 1 AS INTEGER) AS relist_count,
               CAST(coalesce(sum(off_market) FILTER (NOT starts_chain), 0) AS INTEGER) AS gap_days,
               CAST(count(*) FILTER (NOT starts_chain AND price < previous_price) AS INTEGER) AS cut_count,
               arg_max(own_key, listed) AS base_key, arg_max(address, listed) AS address,
               coalesce(arg_max(lat, listed) FILTER (lat <> 0 AND lng <> 0), arg_max(lat, listed)) AS lat,
               coalesce(arg_max(lng, listed) FILTER (lat <> 0 AND lng <> 0), arg_max(lng, listed)) AS lng,
               arg_max(beds, listed) AS beds,
               arg_max(baths, listed) FILTER (baths IS NOT NULL) AS baths,
               arg_max(sqft, listed) FILTER (sqft > 0) AS sqft
        FROM stitched GROUP BY ALL""",
    "chains": """
        SELECT *, CASE WHEN sqft > 0 THEN initial_ask / sqft END AS psf,
               CAST(year(first_listed) AS INTEGER) AS cohort_year,
               chain_end IS NULL AS censored,
               CAST(coalesce(chain_end, as_of) - first_listed AS INTEGER) AS effective_dom,
               CASE WHEN chain_end IS NULL THEN NULL
                    WHEN as_of - chain_end < 7 THEN 'pending'
                    WHEN as_of - chain_end < 42 THEN 'provisional'
                    ELSE 'confirmed' END AS removal_class,
               coalesce(next_start - chain_end >= 42 AND next_start - chain_end < 180, false) AS withdrawal_suspect,
               CASE WHEN season_start <= season_end
                    THEN month(first_listed) * 100 + day(first_listed) BETWEEN season_start AND season_end
                    ELSE month(first_listed) * 100 + day(first_listed) >= season_start
                      OR month(first_listed) * 100 + day(first_listed) <= season_end END AS in_window
        FROM (SELECT *, lead(first_listed) OVER (PARTITION BY pull_ref, group_key ORDER BY first_listed) AS next_start
              FROM folded) JOIN pulls USING (pull_ref)""",
    "comps": """
        SELECT *, CASE WHEN n_base > 1 THEN base_key || '|' || strftime(first_listed, '%Y-%m-%d') ELSE base_key END
                  || CASE WHEN twin > 1 THEN '|' || twin ELSE '' END AS comp_key
        FROM (SELECT *, count(*) OVER (PARTITION BY pull_ref, base_key) AS n_base,
                     row_number() OVER (PARTITION BY pull_ref, base_key, first_listed ORDER BY group_key) AS twin,
                     row_number() OVER (PARTITION BY pull_ref ORDER BY group_key, first_listed) AS comp_seq
              FROM chains WHERE in_window AND effective_dom >= 0)""",
    # ---- requests and curation
    "requests": """
        SELECT s_suppkey AS s, 'req-' || s_suppkey AS request_id, 'pull-' || (s_suppkey * 3 // 20) AS pull_ref,
               41.8::DOUBLE + ((s_suppkey * 3 // 20) * 100 + 50) % 1000 / 10000.0::DOUBLE AS subject_lat,
               -87.7::DOUBLE + ((s_suppkey * 3 // 20) * 100 + 50) % 777 / 10000.0::DOUBLE AS subject_lng,
               800.0::DOUBLE + s_suppkey % 25 * 20 AS subject_sqft,
               CAST(s_suppkey % 5 + 3 AS DOUBLE) AS drift_pct,
               CASE WHEN s_suppkey % 2 = 1 THEN (800.0::DOUBLE + s_suppkey % 25 * 20) * 200
                    WHEN s_suppkey % 4 = 0 THEN (800.0::DOUBLE + s_suppkey % 25 * 20) * 450 END AS candidate_rent,
               CASE WHEN s_suppkey % 3 = 0 THEN 0.35::DOUBLE END AS max_distance_mi,
               s_suppkey % 4 = 1 AS hide_censored, s_suppkey % 7 = 2 AS leased_only
        FROM supplier""",
    "weighed": """
        SELECT r.*, c.* EXCLUDE (pull_ref), mark % 10 = 0 AS overridden,
               CASE WHEN mark % 3 = 0 THEN CAST(mark // 3 % 4 AS DOUBLE)
                    WHEN psf IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight,
               2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
                 pow(sin((radians(lat) - radians(subject_lat)) / 2), 2)
                 + cos(radians(subject_lat)) * cos(radians(lat)) * pow(sin(radians(lng - subject_lng) / 2), 2)))) AS distance_mi
        FROM requests r JOIN comps c USING (pull_ref),
             LATERAL (SELECT CAST(split_part(comp_key, ' ', 1) AS BIGINT) + s AS mark)""",
    "curated": """
        SELECT *, state = 'included' AS included FROM (
          SELECT *, CASE WHEN NOT overridden AND (coalesce(distance_mi > max_distance_mi, false)
                              OR (hide_censored AND censored)
                              OR (leased_only AND coalesce(removal_class NOT IN ('provisional', 'confirmed'), true)))
                         THEN 'filtered' WHEN weight > 0 THEN 'included' ELSE 'excluded' END AS state
          FROM weighed)""",
    "psf_evidence": "SELECT * FROM curated WHERE included AND weight > 0 AND psf IS NOT NULL",
    "selected_medians": """
        SELECT request_id, cohort_year, min(psf) AS selected_median FROM (
          SELECT *, sum(weight) OVER (PARTITION BY request_id, cohort_year ORDER BY psf) AS upto,
                 sum(weight) OVER (PARTITION BY request_id, cohort_year) AS total
          FROM psf_evidence) WHERE upto / total >= 0.5 GROUP BY ALL""",
    "pulled_medians": """
        SELECT pull_ref, cohort_year, quantile_disc(psf, 0.5) AS pulled_median
        FROM comps WHERE psf IS NOT NULL GROUP BY ALL""",
    "cohort_stats": """
        SELECT request_id, cohort_year, selected_count, pulled_count, selected_count < 4 AS thin,
               CASE WHEN selected_count < 4 THEN pulled_median ELSE selected_median END AS median_psf,
               CASE WHEN selected_count >= 4 THEN 'selected' WHEN pulled_median IS NOT NULL THEN 'pulled' END AS basis
        FROM (SELECT request_id, pull_ref, cohort_year, count(psf) AS pulled_count,
                     count(psf) FILTER (included AND weight > 0) AS selected_count
              FROM curated GROUP BY ALL)
        LEFT JOIN selected_medians USING (request_id, cohort_year)
        LEFT JOIN pulled_medians USING (pull_ref, cohort_year)""",
    "scored": """
        SELECT *, CASE WHEN premium IS NOT NULL THEN basis END AS premium_basis,
               coalesce(abs(premium) > 0.3, false) AS sqft_suspect,
               CASE WHEN premium < -0.04 THEN 'below' WHEN premium > 0.04 THEN 'above'
                    WHEN premium IS NOT NULL THEN 'at' END AS bucket
        FROM (SELECT c.*, median_psf, basis, CASE WHEN median_psf > 0 THEN psf / median_psf - 1.0 END AS premium
              FROM curated c LEFT JOIN cohort_stats USING (request_id, cohort_year))""",
    # ---- anchor
    "edges": """
        SELECT request_id, subject_sqft, candidate_rent, edge, drift_pct + step AS edge_drift
        FROM requests, (VALUES ('low', -2.0::DOUBLE), ('mid', 0.0::DOUBLE), ('high', 2.0::DOUBLE)) AS e(edge, step)""",
    "adjusted": """
        SELECT request_id, edge, weight, psf * pow(1.0 + edge_drift / 100.0, year(as_of) - cohort_year) AS adjusted
        FROM psf_evidence JOIN (SELECT request_id, edge, edge_drift FROM edges) USING (request_id)""",
    "anchor_edges": """
        SELECT request_id, edge, edge_drift, anchor_psf, anchor_psf * subject_sqft AS anchor_rent, n_comps, candidate_rent
        FROM (SELECT request_id, edge, min(adjusted) AS anchor_psf FROM (
                SELECT *, sum(weight) OVER (PARTITION BY request_id, edge ORDER BY adjusted) AS upto,
                       sum(weight) OVER (PARTITION BY request_id, edge) AS total FROM adjusted)
              WHERE upto / total >= 0.5 GROUP BY ALL)
        JOIN edges USING (request_id, edge)
        JOIN (SELECT request_id, count(*) AS n_comps FROM psf_evidence GROUP BY ALL) USING (request_id)""",
    # ---- price test
    "candidates": """
        SELECT request_id, edge, candidate_rent, candidate_rent / anchor_rent - 1.0 AS candidate_premium
        FROM anchor_edges WHERE candidate_rent IS NOT NULL""",
    "neighbors": """
        SELECT * FROM (
          SELECT c.*, s.comp_key, s.comp_seq, s.premium, s.effective_dom, s.censored, s.removal_class, s.weight,
                 s.cohort_year, s.cut_count,
                 CAST(row_number() OVER (PARTITION BY request_id, edge
                                    ORDER BY abs(s.premium - candidate_premium), comp_seq) AS INTEGER) AS neighbor_rank
          FROM candidates c JOIN (SELECT * EXCLUDE (candidate_rent) FROM scored WHERE included AND premium IS NOT NULL) s USING (request_id))
        WHERE neighbor_rank <= 7""",
    "edge_reasons": """
        SELECT request_id, edge, candidate_rent, candidate_premium, count(comp_key) AS n_neighbors,
               count(comp_key) FILTER (abs(candidate_premium - premium) <= 0.03) AS n_in_range,
               CASE WHEN coalesce(bool_and(censored), false) THEN 'all_censored'
                    WHEN count(comp_key) FILTER (abs(candidate_premium - premium) <= 0.03) < 3 THEN 'too_few_in_range' END AS reason
        FROM candidates LEFT JOIN (SELECT request_id, edge, comp_key, censored, premium FROM neighbors) USING (request_id, edge)
        GROUP BY ALL""",
    "verdicts": """
        SELECT request_id, max(candidate_rent) AS candidate_rent,
               CASE WHEN count(*) FILTER (reason = 'all_censored') > 0 THEN 'all_censored'
                    WHEN count(*) FILTER (reason = 'too_few_in_range') > 0 THEN 'too_few_in_range' END AS reason,
               max(candidate_premium) FILTER (edge = 'low') AS candidate_premium_low,
               max(candidate_premium) FILTER (edge = 'mid') AS candidate_premium_mid,
               max(candidate_premium) FILTER (edge = 'high') AS candidate_premium_high
        FROM edge_reasons GROUP BY ALL""",
    "shown": "SELECT * FROM neighbors SEMI JOIN (SELECT request_id FROM verdicts WHERE reason IS NULL) USING (request_id)",
    "curve_days": """
        SELECT request_id, edge, effective_dom AS day, sum(weight) AS at_day,
               coalesce(sum(weight) FILTER (NOT censored), 0) AS events, count(*) FILTER (censored) AS open_n
        FROM shown GROUP BY ALL""",
    "curve_risk": """
        SELECT *, sum(at_day) OVER (PARTITION BY request_id, edge ORDER BY day DESC) AS at_risk,
               sum(open_n) OVER (PARTITION BY request_id, edge ORDER BY day) AS open_upto,
               max(day) OVER (PARTITION BY request_id, edge) AS truncated_at
        FROM curve_days""",
    "curves": """
        SELECT request_id, edge, day, at_risk, events, truncated_at,
               product(1.0::DOUBLE - events / at_risk) OVER (PARTITION BY request_id, edge ORDER BY day) AS survival,
               CAST(open_upto - lag(open_upto, 1, 0) OVER (PARTITION BY request_id, edge ORDER BY day) AS BIGINT) AS censored_count
        FROM curve_risk WHERE events > 0""",
    "limits": "SELECT request_id, min(truncated_at) AS limit_day FROM curves GROUP BY ALL",
    "stairs": """
        SELECT request_id, edge, 0 AS day, 1.0::DOUBLE AS survival, -1 AS step FROM candidates
          SEMI JOIN (SELECT request_id FROM verdicts WHERE reason IS NULL) USING (request_id)
        UNION ALL SELECT request_id, edge, day, survival, day FROM curves""",
    "areas": """
        SELECT request_id, edge, sum(survival * greatest(0, least(next_day, limit_day) - day)) AS days
        FROM (SELECT *, lead(day, 1, 1000000) OVER (PARTITION BY request_id, edge ORDER BY step) AS next_day FROM stairs)
        JOIN limits USING (request_id) WHERE day < limit_day OR limit_day <= 0 GROUP BY ALL""",
    # ---- events as responses, manifests and calls
    "ev": """
        SELECT event_id, user_id, ts, event_type, 'u' || user_id || '-' || day(ts) AS pull_ref, CAST(day(ts) AS INTEGER) AS day_no,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "resp": """
        SELECT *, sig || '-off' || CASE WHEN event_id < 1000 THEN lpad(CAST(event_id AS VARCHAR), 3, '0') ELSE CAST(event_id AS VARCHAR) END || '.json' AS file_name,
               event_id % 9 NOT IN (0, 1) AS usable, CASE WHEN event_id % 9 <= 2 THEN 0 ELSE 1 END AS n_records,
               CASE WHEN event_id % 3 <> 0 THEN k % 3 END AS total_count,
               CASE event_id % 9 WHEN 0 THEN '{"listings": [' WHEN 1 THEN '{"data": []}' WHEN 2 THEN '[]'
                    WHEN 3 THEN '{"listings": [{"id":"e' || event_id || '"}, 7]}'
                    ELSE '[{"id":"e' || event_id || '"}]' END AS body
        FROM (SELECT *, CASE event_type WHEN 'click' THEN 'y2024-active' WHEN 'view' THEN 'y2024-inactive'
                        WHEN 'purchase' THEN 'y2023-active' WHEN 'signup' THEN 'y2023-inactive' END AS sig FROM ev)
        WHERE sig IS NOT NULL""",
    "event_pulls": "SELECT DISTINCT pull_ref, user_id, day_no, make_date(2024, 1, least(20, day_no)) AS today FROM ev",
    "event_windows": """
        SELECT pull_ref, user_id, day_no, place, sig, label, (user_id + day_no + place) % 3 AS mark
        FROM event_pulls, (VALUES (0, 'y2024-active', '2024 Active'), (1, 'y2024-inactive', '2024 Inactive'),
                                  (2, 'y2023-active', '2023 Active'), (3, 'y2023-inactive', '2023 Inactive')) AS w(place, sig, label)""",
    "event_manifests": """
        SELECT pull_ref, make_date(2024, 1, day_no) AS as_of FROM event_pulls WHERE user_id % 4 <> 0""",
    "stores": "SELECT pull_ref, sig, true AS filed, bool_or(usable) AS held FROM resp GROUP BY ALL",
    "judged": """
        SELECT pull_ref, sig, label, mark,
               coalesce(held, false) AND mark <> 1 AS satisfied,
               CASE WHEN mark = 0 AND NOT coalesce(held, false) THEN NOT coalesce(filed, false)
                    WHEN mark = 0 THEN false WHEN mark = 1 THEN true ELSE NOT coalesce(held, false) END AS owed,
               CASE WHEN mark = 1 THEN 'HTTP 500' WHEN coalesce(held, false) THEN NULL
                    WHEN mark = 2 THEN 'not fetched'
                    WHEN filed THEN 'the stored response cannot be read as listings; fetching it again returns the same bytes'
                    ELSE 'the response that answered this window is no longer stored' END AS error
        FROM event_windows LEFT JOIN stores USING (pull_ref, sig)""",
    "gaps": """
        SELECT pull_ref, coalesce(string_agg(label, ',' ORDER BY label) FILTER (NOT satisfied), '') AS missing,
               count(*) FILTER (owed) AS calls_to_complete, bool_and(satisfied) AS complete
        FROM judged GROUP BY ALL""",
    "saves": """
        SELECT * EXCLUDE (place) FROM (
          SELECT 'u' || user_id AS key, ts AS saved_at, event_id,
                 CASE WHEN event_id % 7 >= 2 THEN pull_ref END AS pull_ref,
                 CASE event_id % 7 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'negative weight' END AS error,
                 CASE WHEN event_id % 7 = 0 THEN '{broken' WHEN event_id % 7 = 1 THEN '{"drift_pct": 7.0}'
                      ELSE '{"pull_ref":"' || pull_ref || '","subject":{"sqft":900},"weights":{"a|":'
                           || CASE WHEN event_id % 7 = 2 THEN '-1' ELSE '2' END || '}}' END AS document,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS place
          FROM ev) WHERE place = 1""",
    # ---- searches
    "typed": """
        SELECT s_suppkey AS s, DATE '2001-08-01' AS today,
               CASE WHEN s_suppkey % 23 <> 0 THEN s_suppkey || '  West OAK Street' END AS address,
               41.8::DOUBLE + s_suppkey * 37 % 1000 / 10000.0::DOUBLE AS center_lat,
               -87.7::DOUBLE + s_suppkey * 53 % 777 / 10000.0::DOUBLE AS center_lng,
               CASE WHEN s_suppkey % 17 = 0 THEN 0.0::DOUBLE WHEN s_suppkey % 19 = 0 THEN 150.0::DOUBLE
                    WHEN s_suppkey % 97 = 0 THEN 40.0::DOUBLE
                    WHEN s_suppkey % 5 <> 4 THEN (s_suppkey % 4 + 1) / 10.0::DOUBLE ELSE 1.0::DOUBLE END AS radius,
               ['2', '1-3', '0-1', '3-1', '1.5', '2:3'][s_suppkey % 6 + 1] AS bedrooms,
               [NULL, NULL, '1-1.5', '1.5', '1:*'][s_suppkey % 5 + 1] AS bathrooms,
               CASE WHEN s_suppkey % 7 = 0 THEN ''
                    ELSE ['Apartment|Condo', 'Apartment|Multi-Family|Townhouse|Single Family', 'Multi-Family|Apartment|Townhouse'][s_suppkey % 3 + 1] END AS property_types,
               CAST(CASE WHEN s_suppkey % 11 = 0 THEN 6 WHEN s_suppkey % 4 <> 0 THEN 1 + s_suppkey % 5 ELSE 2 END AS INTEGER) AS years_back,
               ['07-17', '06-01', '11-15', '02-29', '02-30', '01-01', '04-15', '13-01'][s_suppkey % 8 + 1] AS window_start,
               ['08-16', '06-16', '02-15', '03-10', '03-10', '12-31', '05-20', '02-01'][s_suppkey % 8 + 1] AS window_end
        FROM supplier""",
    "judged_searches": """
        SELECT *, concat_ws('; ', CASE WHEN s % 23 = 0 THEN 'address: required' END,
                 CASE WHEN s % 29 = 0 THEN 'sqft: required' END,
                 CASE s % 6 WHEN 3 THEN 'bedrooms: range is backwards' WHEN 4 THEN 'bedrooms: must be whole' END,
                 CASE WHEN radius <= 0 THEN 'radius: must be positive' WHEN radius > 100 THEN 'radius: at most 100' END,
                 CASE WHEN s % 8 IN (4, 7) THEN 'window_start: not a month and day' END,
                 CASE WHEN s % 11 = 0 THEN 'years_back: 1 to 5' END,
                 CASE WHEN s % 7 = 0 THEN 'property_types: at least one' END) AS errors,
               CASE WHEN radius > 25 THEN 'radius: very wide' ELSE '' END AS warnings
        FROM typed""",
    "sound_searches": "SELECT * FROM judged_searches WHERE errors = ''",
    "season_windows": """
        SELECT *, greatest(1, CAST(today - closes AS INTEGER) - 90) AS days_old_min, CAST(today - opens AS INTEGER) + 90 AS days_old_max
        FROM (SELECT *, make_date(y, sm, least(sd, day(last_day(make_date(y, sm, 1))))) AS opens,
                     make_date(y2, em, least(ed, day(last_day(make_date(y2, em, 1))))) AS closes
              FROM (SELECT *, y + (em * 100 + ed < sm * 100 + sd)::INT AS y2
                    FROM (SELECT *, CAST(year(today) - back AS INTEGER) AS y,
                                 CAST(split_part(window_start, '-', 1) AS INTEGER) AS sm, CAST(split_part(window_start, '-', 2) AS INTEGER) AS sd,
                                 CAST(split_part(window_end, '-', 1) AS INTEGER) AS em, CAST(split_part(window_end, '-', 2) AS INTEGER) AS ed
                          FROM (SELECT *, unnest(range(years_back)) AS back FROM sound_searches))))""",
    "planned_searches": """
        SELECT *, y AS year, days_old_max >= days_old_min AS fetchable
        FROM season_windows, (VALUES ('Active'), ('Inactive')) AS t(status)""",
    "pull_windows": """
        SELECT pull_ref, y AS year, make_date(y, sm, least(sd, day(last_day(make_date(y, sm, 1))))) AS opens,
               make_date(y2, em, least(ed, day(last_day(make_date(y2, em, 1))))) AS closes
        FROM (SELECT *, y + (season_end < season_start)::INT AS y2, season_start // 100 AS sm, season_start % 100 AS sd,
                     season_end // 100 AS em, season_end % 100 AS ed
              FROM (SELECT *, CAST(year(as_of) - back AS INTEGER) AS y FROM pulls, (VALUES (0), (1), (2)) AS b(back)))""",
    "all_records": """
        SELECT pull_ref, k, u, id, listed, price, 'Inactive' AS status, k % 5 = 0 AS has_history, coalesce(id, '') AS listing_name,
               CASE WHEN k % 251 = 0 THEN '|' ELSE front_key END AS own_key, baths, sqft,
               CASE WHEN k % 499 = 0 THEN 'unknown' ELSE CAST(removed AS VARCHAR) END AS removed_text,
               ['Apartment', 'Single Family', 'Condo', 'Townhouse', 'Multi-Family'][u % 5 + 1] AS property_type
        FROM base_orders
        UNION ALL
        SELECT pull_ref, k, u, id, listed, price + 100.0::DOUBLE, 'Active', false, rear_street, rear_key, NULL, NULL, NULL, 'Apartment'
        FROM base_orders WHERE k % 11 = 0""",
    "padded": """
        SELECT r.pull_ref, w.year, listing_name, listed BETWEEN opens - 90 AND closes + 90 AS in_window
        FROM all_records r JOIN pull_windows w USING (pull_ref)""",
}


SHAPING = "base_orders named_orders observed grouped spells stretches gaps_off stitched folded pulls chains comps".split()


def version(name: str, orders: str, changes: dict[str, str]) -> dict[str, str]:
    """The shaping views over other orders, with ``name`` behind each view's name."""
    own = re.compile(rf"\b({'|'.join(SHAPING)})\b")
    out = {}
    for view in SHAPING:
        text = VIEWS[view]
        for old, new in changes.items():
            text = text.replace(old, new)
        text = own.sub(rf"\1_{name}", text)
        out[f"{view}_{name}"] = text.replace("FROM orders", f"FROM ({orders})") if view == "base_orders" else text
    return out


VIEWS |= version(
    "before",
    "SELECT * FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '2001-02-01'",
    {
        "CASE WHEN o_orderkey % 23 <> 0\n": """CASE WHEN o_orderkey % 23 <> 0
                         AND CAST(o_orderdate AS DATE) + CAST(o_orderkey * 37 % 200 + 1 AS INTEGER) <= DATE '2001-02-01'\n""",
        "DATE '2001-08-01'": "DATE '2001-02-01'",
    },
)
VIEWS |= version("after", "SELECT * FROM orders WHERE o_orderkey % 31 <> 5", {})
for side in ("before", "after"):
    VIEWS[f"units_{side}"] = f"""
        SELECT *, row_number() OVER (PARTITION BY pull_ref, base_key, first_listed ORDER BY group_key) AS nth FROM comps_{side}
        LEFT JOIN (SELECT pull_ref, group_key, chain, string_agg(listed || ':' || previous_price || ':' || price, ',' ORDER BY listed) AS cuts
                   FROM stitched_{side} WHERE NOT starts_chain AND price < previous_price GROUP BY ALL)
        USING (pull_ref, group_key, chain)"""
VIEWS |= {
    "met": """
        SELECT coalesce(o.pull_ref, n.pull_ref) AS pull_ref, coalesce(o.base_key, n.base_key) AS base_key,
               o.comp_key AS key_before, n.comp_key AS key_after, o.first_listed AS old_start, n.first_listed AS new_start,
               n.chain_end AS new_end, o.censored AS was_open, n.censored AS is_open, o.relist_count AS old_relists, n.relist_count AS new_relists,
               (o.initial_ask, o.chain_end, o.removal_class, o.withdrawal_suspect, o.gap_days, o.relist_count, o.cuts, o.beds, o.baths, o.sqft, o.lat, o.lng)
               IS NOT DISTINCT FROM
               (n.initial_ask, n.chain_end, n.removal_class, n.withdrawal_suspect, n.gap_days, n.relist_count, n.cuts, n.beds, n.baths, n.sqft, n.lat, n.lng) AS alike
        FROM units_before o FULL JOIN units_after n
          ON o.pull_ref = n.pull_ref AND o.base_key = n.base_key AND o.first_listed = n.first_listed AND o.nth = n.nth""",
    "left_over": """
        SELECT pull_ref, base_key FROM met GROUP BY ALL
        HAVING count(*) FILTER (key_after IS NULL) = 1 AND count(*) FILTER (key_before IS NULL) = 1""",
    "moved_starts": """
        SELECT pull_ref, base_key, max(key_before) FILTER (key_after IS NULL) AS key_before, max(key_after) FILTER (key_before IS NULL) AS key_after,
               bool_or(was_open) FILTER (key_after IS NULL) AND NOT bool_or(is_open) FILTER (key_before IS NULL) AS newly_leased,
               greatest(0, max(new_relists) FILTER (key_before IS NULL) - max(old_relists) FILTER (key_after IS NULL)) AS relists_stitched
        FROM met SEMI JOIN left_over USING (pull_ref, base_key) GROUP BY ALL""",
    "single_ends": """
        SELECT * FROM met WHERE (key_before IS NULL OR key_after IS NULL)
          AND (pull_ref, base_key) NOT IN (SELECT (pull_ref, base_key) FROM left_over)""",
    "covers": """
        SELECT s.pull_ref, s.base_key, s.key_before, arg_max(m.key_after, m.new_start) AS key_after, arg_max(coalesce(m.new_end, DATE '9999-01-01'), m.new_start) AS new_end
        FROM single_ends s JOIN met m ON s.pull_ref = m.pull_ref AND s.base_key = m.base_key AND m.new_start <= s.old_start
        WHERE s.key_after IS NULL GROUP BY ALL""",
    "comp_changes": """
        SELECT pull_ref, base_key, key_before, key_after, CASE WHEN alike THEN 'kept' ELSE 'changed' END AS state,
               was_open AND NOT is_open AS newly_leased, greatest(0, new_relists - old_relists) AS relists_stitched
        FROM met WHERE key_before IS NOT NULL AND key_after IS NOT NULL
        UNION ALL SELECT pull_ref, base_key, key_before, key_after, 'changed', newly_leased, relists_stitched FROM moved_starts
        UNION ALL SELECT pull_ref, base_key, NULL, key_after, 'new', false, 0 FROM single_ends WHERE key_before IS NULL
        UNION ALL
        SELECT pull_ref, base_key, key_before, CASE WHEN c.new_end >= old_start THEN c.key_after END,
               CASE WHEN c.new_end >= old_start THEN 'merged' ELSE 'vanished' END, false, 0
        FROM (SELECT * FROM single_ends WHERE key_after IS NULL) LEFT JOIN covers c USING (pull_ref, base_key, key_before)""",
    "asked_before": """
        SELECT request_id, pull_ref, comp_key, CAST(mark // 3 % 4 AS DOUBLE) AS weight
        FROM requests JOIN comps_before USING (pull_ref), LATERAL (SELECT CAST(split_part(comp_key, ' ', 1) AS BIGINT) + s AS mark)
        WHERE mark % 3 = 0""",
    "asked_weights": """
        SELECT * FROM asked_before
        UNION ALL
        SELECT request_id, pull_ref, comp_key, CAST(mark // 3 % 4 + 5 AS DOUBLE)
        FROM requests JOIN comps_after USING (pull_ref), LATERAL (SELECT CAST(split_part(comp_key, ' ', 1) AS BIGINT) + s AS mark)
        WHERE mark % 3 = 0 AND (request_id, comp_key) NOT IN (SELECT (request_id, comp_key) FROM asked_before)
        UNION ALL SELECT request_id, pull_ref, 'no such street|', 2.0::DOUBLE FROM requests""",
    "carried": """
        SELECT request_id, comp_key, arg_max(weight, (place, weight)) AS weight, arg_max(mark, (place, weight, mark)) AS mark,
               coalesce(min(weight) FILTER (mark <> 'new') < max(weight) FILTER (mark <> 'new'), false) AS conflict
        FROM (SELECT *, CASE mark WHEN 'new' THEN 0 WHEN 'merged' THEN 1 WHEN 'returned' THEN 2 ELSE 3 END AS place FROM (
                SELECT request_id, coalesce(c.key_after, w.comp_key) AS comp_key, weight,
                       CASE WHEN c.state IS NOT NULL THEN c.state WHEN n.key_after IS NOT NULL THEN 'returned' ELSE 'absent' END AS mark
                FROM asked_weights w
                LEFT JOIN (SELECT * FROM comp_changes WHERE key_before IS NOT NULL) c ON w.pull_ref = c.pull_ref AND w.comp_key = c.key_before
                LEFT JOIN (SELECT * FROM comp_changes WHERE state <> 'merged') n ON w.pull_ref = n.pull_ref AND w.comp_key = n.key_after
                UNION ALL
                SELECT request_id, key_after, 1.0::DOUBLE, 'new' FROM requests JOIN comp_changes USING (pull_ref) WHERE state = 'new'))
        GROUP BY ALL""",
}


def with_views(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` behind a WITH clause of the views it needs, in order."""
    views = {**VIEWS, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b(?!\s*\()", text):
                needed.add(name)
                visit(views[name])

    visit(select)
    clauses = [f"{name} AS ({views[name].strip()})" for name in views if name in needed]
    return f"WITH {', '.join(clauses)}\n{select.strip()}" if clauses else select.strip()
