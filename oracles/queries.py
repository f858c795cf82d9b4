"""The oracle SQL of every query, by name."""

from __future__ import annotations

import json

from leasegrain.config import Knobs
from leasegrain.plans.derive import PIPELINE_VERSION
from oracles.views import with_views

SELECTS: dict[str, str] = {
    "listing_copies": """
        SELECT pull_ref, id, 1 + (k % 11 = 0)::BIGINT AS copies, (k % 11 = 0)::BIGINT AS active_copies
        FROM base_orders WHERE id IS NOT NULL""",
    "address_keys": """
        SELECT pull_ref, own_key, count(*) AS records FROM (
          SELECT pull_ref, CASE WHEN k % 251 = 0 THEN '|' ELSE front_key END AS own_key FROM base_orders
          UNION ALL SELECT pull_ref, rear_key FROM base_orders WHERE k % 11 = 0) GROUP BY ALL""",
    "listing_group_keys": """
        SELECT pull_ref, id, CASE WHEN k % 11 = 0 THEN rear_key ELSE front_key END AS group_key
        FROM base_orders WHERE id IS NOT NULL AND (k % 251 <> 0 OR k % 11 = 0)""",
    "spell_observations": """
        SELECT pull_ref, id, own_key, listed, removed, price, sqft FROM observed WHERE listed IS NOT NULL""",
    "collapsed_spells": """
        SELECT pull_ref, group_key, listed, removed, price, round(lat, 6) AS lat, round(lng, 6) AS lng, beds, baths, sqft
        FROM spells""",
    "stitched_spells": "SELECT pull_ref, group_key, listed, removed, chain, off_market, starts_chain FROM stitched",
    "chain_ends": "SELECT pull_ref, group_key, chain, first_listed, chain_end FROM folded",
    "folded_chains": "SELECT pull_ref, group_key, chain, initial_ask, relist_count, gap_days FROM folded",
    "price_cuts": """
        SELECT pull_ref, group_key, chain, listed AS cut_on, previous_price AS from_price, price AS to_price
        FROM stitched WHERE NOT starts_chain AND price < previous_price""",
    "chain_identity": "SELECT pull_ref, group_key, chain, base_key, beds, baths, sqft FROM folded",
    "chain_coordinates": "SELECT pull_ref, group_key, chain, round(lat, 6) AS lat, round(lng, 6) AS lng FROM folded",
    "vacancy_lengths": "SELECT pull_ref, group_key, chain, effective_dom, censored FROM chains WHERE effective_dom >= 0",
    "removal_ladder": "SELECT pull_ref, group_key, chain, removal_class FROM chains WHERE effective_dom >= 0",
    "withdrawal_suspects": "SELECT pull_ref, group_key, chain, withdrawal_suspect FROM chains WHERE effective_dom >= 0",
    "season_window": "SELECT pull_ref, group_key, chain, first_listed, in_window FROM chains WHERE effective_dom >= 0",
    "chain_cohorts": """
        SELECT pull_ref, cohort_year, count(*) AS chains FROM chains WHERE effective_dom >= 0 GROUP BY ALL""",
    "shaping_summaries": """
        SELECT pull_ref, count(*) FILTER (in_window) AS kept, count(*) FILTER (NOT in_window) AS dropped_outside_window
        FROM chains WHERE effective_dom >= 0 GROUP BY ALL""",
    "shaping_quarantine": """
        SELECT pull_ref, count(*) AS n, 'no address' AS reason FROM base_orders WHERE k % 251 = 0 GROUP BY ALL
        UNION ALL
        SELECT pull_ref, count(*), 'unreadable date' FROM base_orders WHERE k % 251 <> 0 AND k % 499 = 0 GROUP BY ALL
        UNION ALL
        SELECT pull_ref, count(*), 'removed before listed' FROM chains WHERE effective_dom < 0 GROUP BY ALL""",
    "shaping_rejects": """
        SELECT pull_ref, id, NULL AS unit_key, listed AS started, 'no address' AS reason FROM base_orders WHERE k % 251 = 0
        UNION ALL SELECT pull_ref, id, own_key, NULL, 'unreadable date' FROM observed WHERE listed IS NULL
        UNION ALL SELECT pull_ref, NULL, group_key, first_listed, 'removed before listed' FROM chains WHERE effective_dom < 0""",
    "price_per_sqft": "SELECT pull_ref, comp_key, initial_ask, sqft, round(psf, 6) AS psf FROM comps",
    "row_dates": """
        SELECT c.pull_ref, comp_key, chain_end AS removed_on, CAST(as_of - chain_end AS INTEGER) AS days_since_removal,
               coalesce(cut_days, '') AS cut_days
        FROM comps c LEFT JOIN (
          SELECT pull_ref, group_key, chain, string_agg(listed - start_day, ',' ORDER BY listed) AS cut_days
          FROM (SELECT *, min(listed) OVER (PARTITION BY pull_ref, group_key, chain) AS start_day FROM stitched)
          WHERE NOT starts_chain AND price < previous_price GROUP BY ALL) USING (pull_ref, group_key, chain)""",
    "comp_keys": "SELECT pull_ref, group_key, first_listed, comp_key FROM comps",
    "comp_order": "SELECT pull_ref, comp_key, comp_seq FROM comps",
    "shaped_comps": """
        SELECT pull_ref, comp_key, initial_ask, effective_dom, censored, removal_class, cohort_year, first_listed,
               withdrawal_suspect, cut_count, relist_count, gap_days FROM comps""",
    "weighted_quantiles": """
        SELECT l_returnflag, min(v) FILTER (share >= 0.25) AS q25, min(v) FILTER (share >= 0.5) AS q50,
               min(v) FILTER (share >= 0.9) AS q90
        FROM (SELECT l_returnflag, l_extendedprice AS v,
                     sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)
                     / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS share FROM lineitem)
        GROUP BY ALL""",
    "weighted_medians": """
        SELECT l_partkey, min(v) AS median_price
        FROM (SELECT l_partkey, l_extendedprice AS v,
                     sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_extendedprice)
                     / sum(l_quantity) OVER (PARTITION BY l_partkey) AS share FROM lineitem)
        WHERE share >= 0.5 GROUP BY ALL""",
    "survival_curves": """
        SELECT beds, day, round(survival, 6) AS survival, round(at_risk, 6) AS at_risk, round(events, 6) AS events,
               censored_count, truncated_at
        FROM (SELECT *, product(1.0::DOUBLE - events / at_risk) OVER (PARTITION BY beds ORDER BY day) AS survival,
                     CAST(open_upto - lag(open_upto, 1, 0) OVER (PARTITION BY beds ORDER BY day) AS BIGINT) AS censored_count
              FROM (SELECT *, sum(at_day) OVER (PARTITION BY beds ORDER BY day DESC) AS at_risk,
                           sum(open_n) OVER (PARTITION BY beds ORDER BY day) AS open_upto,
                           max(day) OVER (PARTITION BY beds) AS truncated_at
                    FROM (SELECT beds, effective_dom AS day, sum(beds + 1.0::DOUBLE) AS at_day,
                                 coalesce(sum(beds + 1.0::DOUBLE) FILTER (NOT censored), 0) AS events,
                                 count(*) FILTER (censored) AS open_n FROM comps GROUP BY ALL))
              WHERE events > 0)""",
    "survival_horizons": """
        SELECT pull_ref, h AS day, round(coalesce(arg_max(survival, s.day) FILTER (s.day <= h), 1.0), 6) AS survival
        FROM (SELECT DISTINCT pull_ref FROM comps) CROSS JOIN (VALUES (14), (30), (45), (60)) AS t(h)
        LEFT JOIN pull_curves s USING (pull_ref) GROUP BY ALL""",
    "restricted_means": """
        SELECT pull_ref, limit_day, round(sum(survival * (least(next_day, limit_day) - day)), 6) AS days
        FROM (SELECT *, lead(day, 1, 1000000) OVER (PARTITION BY pull_ref ORDER BY step) AS next_day FROM (
                SELECT DISTINCT pull_ref, 0 AS day, 1.0::DOUBLE AS survival, -1 AS step FROM pull_curves
                UNION ALL SELECT pull_ref, day, survival, day FROM pull_curves))
        JOIN (SELECT DISTINCT pull_ref, truncated_at AS limit_day FROM pull_curves) USING (pull_ref)
        WHERE day < limit_day GROUP BY ALL""",
    "effective_weights": "SELECT request_id, comp_key, weight FROM weighed",
    "subject_distances": "SELECT request_id, comp_key, round(distance_mi, 6) AS distance_mi FROM weighed",
    "membership_states": "SELECT request_id, comp_key, overridden, state FROM curated",
    "cohort_medians": """
        SELECT request_id, cohort_year, selected_count, pulled_count, round(median_psf, 6) AS median_psf, basis, thin
        FROM cohort_stats""",
    "cohort_lookup": """
        SELECT request_id, cohort_year, comp_key, round(median_psf, 6) AS median_psf, basis
        FROM scored WHERE median_psf IS NOT NULL""",
    "premiums": "SELECT request_id, comp_key, round(premium, 6) AS premium FROM scored",
    "sqft_suspects": "SELECT request_id, comp_key, sqft_suspect FROM scored",
    "premium_bases": "SELECT request_id, comp_key, premium_basis FROM scored",
    "premium_buckets": "SELECT request_id, comp_key, bucket FROM scored",
    "drift_bands": "SELECT request_id, edge, edge_drift FROM edges",
    "anchor_edges": """
        SELECT request_id, edge, edge_drift, round(anchor_psf, 6) AS anchor_psf, round(anchor_rent, 6) AS anchor_rent, n_comps
        FROM anchor_edges""",
    "anchor_bands": """
        SELECT request_id, round(max(anchor_rent) FILTER (edge = 'low'), 6) AS rent_low,
               round(max(anchor_rent) FILTER (edge = 'mid'), 6) AS rent_mid,
               round(max(anchor_rent) FILTER (edge = 'high'), 6) AS rent_high,
               drift_pct, 2.0::DOUBLE AS drift_sensitivity_pts, subject_sqft, n_comps
        FROM anchor_edges JOIN (SELECT request_id, drift_pct, subject_sqft FROM requests) USING (request_id) GROUP BY ALL""",
    "anchor_evidence": "SELECT request_id, comp_key FROM psf_evidence",
    "bucket_stats": """
        SELECT f.request_id, f.bucket, bucket_order, premium_min, premium_max, count(comp_key) AS count,
               count(comp_key) FILTER (leased) AS leased_count,
               median(effective_dom) FILTER (leased) AS leased_dom_median,
               min(effective_dom) FILTER (leased) AS leased_dom_min, max(effective_dom) FILTER (leased) AS leased_dom_max,
               round(avg((cut_count > 0)::INT) FILTER (leased), 6) AS cut_before_lease_rate,
               count(comp_key) FILTER (removal_class = 'provisional') AS provisional_count,
               count(comp_key) FILTER (withdrawal_suspect) AS withdrawal_suspect_count,
               count(comp_key) FILTER (leased) BETWEEN 1 AND 3 AS thin
        FROM (SELECT request_id, bucket, bucket_order, premium_min, premium_max FROM requests,
              (VALUES ('below', 0, NULL, -0.04::DOUBLE), ('at', 1, -0.04::DOUBLE, 0.04::DOUBLE), ('above', 2, 0.04::DOUBLE, NULL))
              AS b(bucket, bucket_order, premium_min, premium_max)) f
        LEFT JOIN (SELECT *, coalesce(removal_class IN ('provisional', 'confirmed'), false) AS leased
                   FROM scored WHERE included) s ON s.request_id = f.request_id AND s.bucket = f.bucket
        GROUP BY ALL""",
    "bucket_dollars": """
        SELECT request_id, bucket,
               round(max(anchor_rent * (1.0 + lo)) FILTER (edge = 'low'), 6) AS min_low,
               round(max(anchor_rent * (1.0 + lo)) FILTER (edge = 'mid'), 6) AS min_mid,
               round(max(anchor_rent * (1.0 + lo)) FILTER (edge = 'high'), 6) AS min_high,
               round(max(anchor_rent * (1.0 + hi)) FILTER (edge = 'low'), 6) AS max_low,
               round(max(anchor_rent * (1.0 + hi)) FILTER (edge = 'mid'), 6) AS max_mid,
               round(max(anchor_rent * (1.0 + hi)) FILTER (edge = 'high'), 6) AS max_high
        FROM (SELECT request_id, bucket, lo, hi FROM requests,
              (VALUES ('below', NULL, -0.04::DOUBLE), ('at', -0.04::DOUBLE, 0.04::DOUBLE), ('above', 0.04::DOUBLE, NULL)) AS b(bucket, lo, hi))
        LEFT JOIN anchor_edges USING (request_id) GROUP BY ALL""",
    "bucket_evidence": "SELECT request_id, bucket, comp_key FROM scored WHERE included AND bucket IS NOT NULL",
    "censored_floors": """
        SELECT request_id, bucket, effective_dom, count(*) AS n FROM scored
        WHERE included AND censored AND bucket IS NOT NULL GROUP BY ALL""",
    "nearest_neighbors": "SELECT request_id, edge, comp_key, neighbor_rank FROM neighbors",
    "candidate_premiums": "SELECT request_id, edge, round(candidate_premium, 6) AS candidate_premium FROM candidates",
    "neighbor_union": """
        SELECT DISTINCT request_id, comp_key, round(premium, 6) AS premium, effective_dom, censored, removal_class, weight,
               cohort_year, cut_count, round(abs(candidate_premium_mid - premium), 6) AS distance
        FROM neighbors JOIN (SELECT request_id, candidate_premium_mid FROM verdicts) USING (request_id)""",
    "evidence_guards": "SELECT request_id, edge, n_neighbors, n_in_range, reason FROM edge_reasons",
    "price_test_curves": """
        SELECT request_id, edge, day, round(survival, 6) AS survival, round(at_risk, 6) AS at_risk,
               round(events, 6) AS events, censored_count, truncated_at FROM curves""",
    "price_test_horizons": """
        SELECT request_id, edge, h AS day, round(coalesce(arg_max(survival, c.day) FILTER (c.day <= h), 1.0), 6) AS survival
        FROM (SELECT request_id, edge, h FROM stairs, (VALUES (14), (30), (45), (60)) AS t(h) WHERE step = -1)
        LEFT JOIN curves c USING (request_id, edge) GROUP BY ALL""",
    "expected_vacancy": """
        SELECT request_id, limit_day AS truncated_at,
               round(max(days) FILTER (edge = 'low'), 4) AS days_low, round(max(days) FILTER (edge = 'mid'), 4) AS days_mid,
               round(max(days) FILTER (edge = 'high'), 4) AS days_high,
               round(max(days * candidate_rent / 30.0) FILTER (edge = 'low'), 4) AS cost_low,
               round(max(days * candidate_rent / 30.0) FILTER (edge = 'mid'), 4) AS cost_mid,
               round(max(days * candidate_rent / 30.0) FILTER (edge = 'high'), 4) AS cost_high
        FROM areas JOIN limits USING (request_id) JOIN (SELECT request_id, candidate_rent FROM requests) USING (request_id)
        GROUP BY ALL""",
    "price_tests": """
        SELECT request_id, candidate_rent, CASE WHEN reason IS NULL THEN 'curve' ELSE 'guard' END AS state, reason,
               CASE WHEN candidate_premium_mid < -0.04 THEN 'below' WHEN candidate_premium_mid > 0.04 THEN 'above' ELSE 'at' END AS bucket,
               limit_day AS truncated_at,
               round(candidate_premium_low, 6) AS candidate_premium_low, round(candidate_premium_mid, 6) AS candidate_premium_mid,
               round(candidate_premium_high, 6) AS candidate_premium_high
        FROM verdicts LEFT JOIN limits USING (request_id)""",
    "contribution_shares": """
        SELECT request_id, comp_key,
               round(CASE WHEN included AND total > 0 THEN weight / total END, 6) AS contribution_share
        FROM (SELECT *, sum(weight) FILTER (included) OVER (PARTITION BY request_id) AS total FROM curated)""",
    "breakdowns": """
        SELECT request_id, count(comp_key) AS pulled, count(comp_key) FILTER (state = 'included') AS included,
               count(comp_key) FILTER (state = 'excluded') AS excluded, count(comp_key) FILTER (state = 'filtered') AS filtered,
               count(comp_key) FILTER (censored) AS censored, count(comp_key) FILTER (removal_class = 'pending') AS pending,
               count(comp_key) FILTER (removal_class = 'provisional') AS provisional,
               count(comp_key) FILTER (removal_class = 'confirmed') AS confirmed,
               count(comp_key) FILTER (withdrawal_suspect) AS withdrawal_suspect,
               count(comp_key) FILTER (psf IS NULL) AS missing_sqft, dropped_outside_window
        FROM (SELECT request_id, pull_ref FROM requests)
        LEFT JOIN (SELECT * EXCLUDE (pull_ref) FROM curated) USING (request_id)
        LEFT JOIN (SELECT pull_ref, count(*) FILTER (NOT in_window) AS dropped_outside_window
                   FROM chains WHERE effective_dom >= 0 GROUP BY ALL) USING (pull_ref)
        GROUP BY request_id, dropped_outside_window""",
    "breakdown_evidence": """
        SELECT request_id, 'pulled' AS label, comp_key FROM curated
        UNION ALL SELECT request_id, state, comp_key FROM curated
        UNION ALL SELECT request_id, 'censored', comp_key FROM curated WHERE censored
        UNION ALL SELECT request_id, removal_class, comp_key FROM curated WHERE removal_class IS NOT NULL
        UNION ALL SELECT request_id, 'withdrawal_suspect', comp_key FROM curated WHERE withdrawal_suspect
        UNION ALL SELECT request_id, 'missing_sqft', comp_key FROM curated WHERE psf IS NULL""",
    "cohort_counts": "SELECT request_id, cohort_year, count(*) AS count FROM curated GROUP BY ALL",
    "derive_warnings": """
        SELECT request_id, 'missing_sqft' AS code, count(*) AS n FROM curated WHERE psf IS NULL GROUP BY ALL
        UNION ALL
        SELECT request_id, 'no_anchor', NULL FROM requests WHERE candidate_rent IS NOT NULL
          AND request_id NOT IN (SELECT request_id FROM psf_evidence)""",
    "derived_comps": """
        SELECT request_id, comp_key, beds, baths, sqft, initial_ask, round(psf, 6) AS psf, round(premium, 6) AS premium,
               premium_basis, effective_dom, CAST(as_of - chain_end AS INTEGER) AS days_since_removal, relist_count,
               gap_days, cut_count, round(distance_mi, 6) AS distance_mi, weight,
               round(CASE WHEN included AND total > 0 THEN weight / total END, 6) AS contribution_share, state, bucket
        FROM (SELECT *, sum(weight) FILTER (included) OVER (PARTITION BY request_id) AS total FROM scored)""",
    "derive_meta": """
        SELECT request_id, pull_ref, as_of, count(*) AS n_comps, 'leasegrain-1' AS pipeline_version
        FROM curated GROUP BY ALL""",
    "rejected_requests": """
        SELECT * FROM (
          SELECT request_id, concat_ws('; ',
                   CASE WHEN s % 6 = 0 THEN 'subject sqft must be positive' END,
                   CASE WHEN s % 10 = 1 THEN 'candidate rent must be positive' END,
                   CASE WHEN s % 9 = 0 THEN 'maximum distance must not be negative' END,
                   CASE WHEN s % 8 = 0 THEN 'weights must be non-negative' END) AS errors
          FROM requests) WHERE errors <> ''""",
    # ---- responses and bookkeeping
    "response_records": """
        SELECT pull_ref, CASE WHEN contains(sig, 'inactive') THEN 'Inactive' ELSE 'Active' END AS response_status,
               'e' || event_id AS id FROM resp WHERE n_records = 1""",
    "unusable_responses": "SELECT pull_ref, event_id, body FROM resp WHERE NOT usable",
    "response_names": """
        SELECT event_id, sig, CASE WHEN contains(sig, 'inactive') THEN 'Inactive' ELSE 'Active' END AS status,
               CAST(sig[2:5] AS INTEGER) AS year, CAST(event_id AS INTEGER) AS page_offset FROM resp""",
    "stored_windows": "SELECT pull_ref, sig, filed, held FROM stores",
    "listing_pages": """
        SELECT pull_ref, property_type AS "propertyType", count(*) AS records, round(sum(price), 2) AS price_sum,
               count(*) FILTER (has_history) AS with_history, count(sqft) AS with_sqft FROM all_records GROUP BY ALL""",
    "window_reconciliation": "SELECT pull_ref, sig, label, satisfied, owed, error FROM judged",
    "window_corroboration": "SELECT pull_ref, sig, label, satisfied, owed, error FROM judged WHERE mark < 2",
    "pull_gaps": "SELECT pull_ref, missing, calls_to_complete, complete FROM gaps",
    "observation_dates": """
        SELECT pull_ref, least(today, coalesce(m.as_of, filed, today)) AS as_of
        FROM event_pulls LEFT JOIN event_manifests m USING (pull_ref)
        LEFT JOIN (SELECT pull_ref, max(CAST(ts AS DATE)) AS filed FROM resp GROUP BY ALL) USING (pull_ref)""",
    "truncated_windows": """
        SELECT pull_ref, sig, sum(n_records)::BIGINT AS fetched, max(total_count) AS total_count,
               coalesce(sum(n_records) >= max(total_count), true) AS complete,
               coalesce(greatest(0, max(total_count) - sum(n_records)), 0)::BIGINT AS missing_records
        FROM resp GROUP BY ALL""",
    "cache_states": """
        SELECT pull_ref, CASE WHEN m.as_of IS NULL THEN 'miss' WHEN complete THEN 'hit' ELSE 'stale' END AS cache_status
        FROM event_pulls LEFT JOIN event_manifests m USING (pull_ref) LEFT JOIN gaps USING (pull_ref)""",
    "monthly_calls": """
        SELECT user_id AS account, strftime(ts, '%Y-%m') AS month, count(*) AS calls, greatest(0, 50 - count(*)) AS remaining
        FROM events GROUP BY ALL""",
    "affordable_pulls": """
        SELECT pull_ref, user_id AS account, calls_to_complete, remaining, calls_to_complete > remaining AS refused
        FROM gaps JOIN event_pulls USING (pull_ref)
        JOIN (SELECT user_id, greatest(0, 50 - count(*)) AS remaining FROM events GROUP BY ALL) USING (user_id)""",
    "evidence_digests": """
        SELECT pull_ref, sha256(concat_ws('|', coalesce(noted, '-'), coalesce(files, '-'))) AS digest
        FROM (SELECT pull_ref, CAST(as_of AS VARCHAR) || ':06-01:06-16' AS noted FROM event_manifests)
        FULL JOIN (SELECT pull_ref, concat_ws(':', CAST(count(*) AS VARCHAR),
                     CAST(sum(CAST('0x' || h[1:15] AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[16:30] AS BIGINT)) AS VARCHAR),
                     CAST(sum(CAST('0x' || h[31:45] AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[46:60] AS BIGINT)) AS VARCHAR)) AS files
                   FROM (SELECT pull_ref, sha256(file_name || ':' || sha256(body)) AS h FROM resp) GROUP BY ALL) USING (pull_ref)""",
    "changed_pulls": "SELECT DISTINCT pull_ref FROM resp WHERE total_count IS NULL",
    "latest_workspaces": "SELECT key, saved_at, document FROM saves",
    "workspace_list": "SELECT key, saved_at, pull_ref, error FROM saves",
    "recent_searches": """
        SELECT key, pull_ref, coalesce(error, lost) AS error, coalesce(error, lost) IS NOT NULL AS offer_refresh
        FROM (SELECT key, pull_ref, error,
                     CASE WHEN pull_ref IS NULL OR pull_ref NOT IN (SELECT pull_ref FROM event_manifests)
                            OR pull_ref NOT IN (SELECT pull_ref FROM resp) THEN 'evidence missing' END AS lost FROM saves)""",
    # ---- searches
    "search_validation": """
        SELECT s AS search_id, address, round(radius, 6) AS radius, years_back, window_start, window_end, property_types,
               errors, warnings FROM judged_searches""",
    "bed_bath_ranges": """
        SELECT s AS search_id, [2.0::DOUBLE, 1, 0, NULL, NULL, 2][s % 6 + 1] AS bed_lo, [2.0::DOUBLE, 3, 1, NULL, NULL, 3][s % 6 + 1] AS bed_hi,
               CASE s % 6 WHEN 3 THEN 'bedrooms: range is backwards' WHEN 4 THEN 'bedrooms: must be whole' END AS bed_error,
               [NULL, NULL, 1.0::DOUBLE, 1.5, 1][s % 5 + 1] AS bath_lo, [NULL, NULL, 1.5::DOUBLE, 1.5, NULL][s % 5 + 1] AS bath_hi,
               CAST(NULL AS VARCHAR) AS bath_error FROM supplier, LATERAL (SELECT s_suppkey AS s)""",
    "season_plan": """
        SELECT s AS search_id, year, status, opens, closes, days_old_min, days_old_max, fetchable FROM planned_searches""",
    "fetchable_windows": """
        SELECT s AS search_id, 'y' || year || '-' || lower(status) AS sig, year || ' ' || status AS label
        FROM planned_searches WHERE fetchable""",
    "plan_costs": """
        SELECT s AS search_id, count(*) FILTER (fetchable) AS estimated_calls,
               coalesce(string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR) DESC), '') AS cohorts,
               coalesce(string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR) DESC) FILTER (fetchable), '') AS fetchable_cohorts
        FROM planned_searches GROUP BY ALL""",
    "search_keys": """
        SELECT s AS search_id, sha256(concat_ws(';', lower(regexp_replace(address, '\\s+', ' ', 'g')),
                 CAST(CAST(round(radius * 1000000) AS BIGINT) AS VARCHAR), bedrooms, coalesce(bathrooms, '-'), property_types,
                 CAST(years_back AS VARCHAR), window_start, window_end)) AS pull_ref
        FROM sound_searches""",
    "selected_listings": """
        SELECT s AS search_id, year, 'Inactive' AS status, id AS listing_id, round(d, 6) AS distance_mi
        FROM (SELECT p.*, o.id, 2 * 3958.7613::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
                       pow(sin((radians(lat) - radians(center_lat)) / 2), 2)
                       + cos(radians(center_lat)) * cos(radians(lat)) * pow(sin(radians(lng - center_lng) / 2), 2)))) AS d
              FROM planned_searches p JOIN base_orders o
                ON status = 'Inactive' AND fetchable AND o.k % 13 <> 0
               AND p.today - o.listed BETWEEN days_old_min AND days_old_max
               AND beds BETWEEN [2.0::DOUBLE, 1, 0, NULL, NULL, 2][s % 6 + 1] AND [2.0::DOUBLE, 3, 1, NULL, NULL, 3][s % 6 + 1]
               AND CASE s % 5 WHEN 2 THEN coalesce(baths BETWEEN 1 AND 1.5, false) WHEN 3 THEN coalesce(baths = 1.5, false)
                              WHEN 4 THEN coalesce(baths >= 1, false) ELSE true END
               AND contains('|' || property_types || '|', '|' || ['Apartment', 'Single Family', 'Condo', 'Townhouse', 'Multi-Family'][o.u % 5 + 1] || '|'))
        WHERE d <= radius""",
    "padded_window_checks": """
        SELECT pull_ref, year, count(*) FILTER (in_window) AS in_window, count(*) FILTER (NOT in_window) AS out_of_window,
               bool_and(in_window) AS ok FROM padded GROUP BY ALL""",
    "window_yields": """
        SELECT pull_ref, year, count(DISTINCT listing_name) AS listings FROM padded WHERE in_window GROUP BY ALL""",
    "coverage_verdicts": """
        SELECT pull_ref, count(DISTINCT listing_name) FILTER (in_window) AS in_window_listings,
               CASE WHEN count(DISTINCT listing_name) FILTER (in_window) >= 15 THEN 'GO' ELSE 'NO-GO' END AS verdict
        FROM padded GROUP BY ALL""",
    "empty_results": """
        SELECT pull_ref, kept, dropped_outside_window,
               CASE WHEN kept > 0 THEN NULL WHEN dropped_outside_window > 0 THEN 'date window' ELSE 'radius, beds or types' END AS "constraint",
               n % 3 = 0 AS has_gap, least(100.0::DOUBLE, n % 7 * 25.0::DOUBLE) AS wider_radius,
               CAST(least(5, n % 5 + 2) AS INTEGER) AS more_years
        FROM (SELECT pull_ref, CAST(split_part(pull_ref, '-', 2) AS INTEGER) AS n,
                     count(*) FILTER (hit) AS kept, count(*) FILTER (NOT hit) AS dropped_outside_window
              FROM (SELECT pull_ref, month(first_listed) * 100 + day(first_listed)
                           = CASE WHEN CAST(split_part(pull_ref, '-', 2) AS INTEGER) % 2 = 0 THEN 229 ELSE 615 END AS hit
                    FROM pulls LEFT JOIN chains USING (pull_ref)) GROUP BY ALL)""",
    "pull_profile": """
        SELECT 'history events' AS report, CASE WHEN has_history THEN '2' ELSE '0' END AS item, count(*)::DOUBLE AS value FROM all_records GROUP BY ALL
        UNION ALL SELECT 'gap days', 'over 180', count(*)::DOUBLE FROM all_records WHERE has_history
        UNION ALL SELECT 'property type', property_type || ' / ' || status, count(*)::DOUBLE FROM all_records GROUP BY ALL
        UNION ALL SELECT 'missing share', item, round(value, 6) FROM (
          UNPIVOT (SELECT 0.0::DOUBLE AS price, 0.0::DOUBLE AS "listedDate", 0.0::DOUBLE AS bedrooms, avg((baths IS NULL)::INT) AS bathrooms,
                          avg((removed_text IS NULL)::INT) AS "removedDate", avg((NOT has_history)::INT) AS history,
                          avg((sqft IS NULL)::INT) AS "squareFootage", 1.0::DOUBLE AS "yearBuilt" FROM all_records)
          ON COLUMNS(*) INTO NAME item VALUE value)
        UNION ALL SELECT 'duplicate addresses', 'units', count(*)::DOUBLE
          FROM (SELECT 1 FROM all_records GROUP BY pull_ref, own_key HAVING count(*) > 1)
        UNION ALL SELECT 'extremes', item, round(value, 6) FROM (
          UNPIVOT (SELECT min(price) AS "price min", max(price) AS "price max",
                          min(price / sqft) FILTER (sqft > 0) AS "price per sqft min",
                          max(price / sqft) FILTER (sqft > 0) AS "price per sqft max" FROM all_records)
          ON COLUMNS(*) INTO NAME item VALUE value)""",
    # ---- view rules
    "visible_comps": "SELECT request_id, comp_key, state FROM curated WHERE state <> 'filtered'",
    "filtered_comps": "SELECT request_id, comp_key, state FROM curated WHERE state = 'filtered'",
    "weights_after_all": """
        SELECT request_id, comp_key, CASE WHEN state <> 'filtered' AND psf IS NOT NULL THEN 1.0::DOUBLE ELSE weight END AS weight
        FROM curated JOIN asked USING (request_id, comp_key)
        WHERE asked_for OR (state <> 'filtered' AND psf IS NOT NULL)""",
    "weights_after_none": """
        SELECT request_id, comp_key, CASE WHEN state <> 'filtered' THEN 0.0::DOUBLE ELSE weight END AS weight
        FROM curated JOIN asked USING (request_id, comp_key) WHERE asked_for OR state <> 'filtered'""",
    "included_by_hand": """
        SELECT request_id, comp_key,
               CASE WHEN overridden OR state = 'filtered' THEN true END AS override,
               CASE WHEN state = 'filtered' AND weight <= 0 THEN 1.0::DOUBLE WHEN asked_for THEN weight END AS weight
        FROM curated JOIN asked USING (request_id, comp_key)
        WHERE overridden OR state = 'filtered' OR asked_for""",
    "outcome_texts": """
        SELECT pull_ref, comp_key,
               CASE WHEN censored THEN 'active ' || effective_dom || '+ days'
                    WHEN removal_class = 'confirmed' THEN 'leased ' || effective_dom || ' days'
                    WHEN removal_class = 'provisional' THEN 'leased ' || effective_dom || ' days · provisional'
                    ELSE 'removed ' || (as_of - chain_end) || ' days ago — classifying' END AS outcome FROM comps""",
    "dominant_comps": """
        SELECT request_id, comp_key, coalesce(included AND total > 0 AND weight / total > 0.4, false) AS dominant
        FROM (SELECT *, sum(weight) FILTER (included) OVER (PARTITION BY request_id) AS total FROM curated)""",
    "map_frames": """
        SELECT request_id, round(s - (n - s) * 0.08, 6) AS south, round(n + (n - s) * 0.08, 6) AS north,
               round(w - (e - w) * 0.08, 6) AS west, round(e + (e - w) * 0.08, 6) AS east
        FROM (SELECT request_id, least(subject_lat, min(lat)) AS s, greatest(subject_lat, max(lat)) AS n,
                     least(subject_lng, min(lng)) AS w, greatest(subject_lng, max(lng)) AS e
              FROM curated WHERE NOT (lat = 0 AND lng = 0) GROUP BY request_id, subject_lat, subject_lng)""",
    "comp_links": """
        SELECT pull_ref, comp_key,
               'https://www.zillow.com/homes/' || replace(replace(replace(regexp_replace(trim(address || ' & Söhne'), '\\s+', '-', 'g'),
                 '&', '%26'), ',', '%2C'), 'ö', '%C3%B6') || '_rb/' AS listing_link,
               'https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=' || printf('%.4f,%.4f', lat, lng) AS street_link
        FROM comps""",
    "incremental_comps": """
        SELECT pull_ref, comp_key, initial_ask, effective_dom, censored, removal_class, first_listed, withdrawal_suspect, relist_count, gap_days
        FROM comps""",
    "stored_bodies": """
        SELECT pull_ref, status AS response_status, count(*) AS records, count(id) AS with_id, round(sum(price), 2) AS price_sum
        FROM all_records GROUP BY ALL""",
    "stored_manifests": """
        SELECT pull_ref, as_of, printf('%02d-%02d', season_start // 100, season_start % 100) AS window_start,
               printf('%02d-%02d', season_end // 100, season_end % 100) AS window_end FROM pulls""",
    "cohort_ratios": """
        SELECT pull_ref, level, zip, beds, cohort_year, round(median_psf, 6) AS median_psf, n, enough, prior_year, round(growth, 6) AS growth
        FROM cohort_ratios""",
    "group_drifts": "SELECT pull_ref, level, zip, beds, round(drift_pct, 6) AS drift_pct, years, evidence FROM group_drifts",
    "subject_drifts": """
        SELECT request_id, coalesce(['zip and beds', 'zip', 'beds', 'pull'][min(level) FILTER (usable) + 1], 'manual') AS drift_source,
               round(coalesce(arg_min(found, level) FILTER (usable), max(own)), 6) AS drift_pct,
               round(max(found) FILTER (level = 3), 6) AS cohort_drift_pct,
               arg_min(years, level) FILTER (usable) AS years, arg_min(evidence, level) FILTER (usable) AS evidence
        FROM (SELECT a.*, d.drift_pct AS found, years, evidence,
                     d.drift_pct IS NOT NULL AND (source = 'zip' OR (source = 'cohort' AND a.level = 3)) AS usable
              FROM (SELECT request_id, pull_ref, drift_pct AS own, ['zip', 'cohort', 'zip', 'manual'][s % 4 + 1] AS source, unnest(range(0, 4))::INTEGER AS level,
                           CASE WHEN s % 12 <> 9 THEN '6061' || (s % 12 % 10) || CASE WHEN s % 12 > 9 THEN '0' ELSE '' END END AS zip, CAST(s % 6 AS DOUBLE) AS beds FROM requests) a
              LEFT JOIN group_drifts d ON a.pull_ref = d.pull_ref AND a.level = d.level
                AND d.zip = CASE WHEN a.level < 2 THEN a.zip ELSE '*' END
                AND d.beds = CASE WHEN a.level IN (0, 2) THEN printf('%.1f', a.beds) ELSE '*' END)
        GROUP BY ALL""",
    "decision_outcomes": """
        SELECT decision_id, pull_ref, decided_on, candidate_rent, round(predicted_days, 4) AS predicted_days, outcome, actual_days, final_ask,
               ask_held, round(error_days, 4) AS error_days FROM decided""",
    "decision_records": """
        SELECT pull_ref, count(*) AS decisions, count(*) FILTER (outcome = 'leased') AS leased, count(*) FILTER (outcome = 'open') AS open,
               count(*) FILTER (outcome = 'late') AS late, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (ask_held) AS held,
               round(avg(error_days), 3) AS mean_error_days, round(avg(abs(error_days)), 3) AS mean_abs_error_days
        FROM decided GROUP BY ALL""",
    "request_problems": """
        SELECT s_suppkey AS request_id, path, problem FROM supplier JOIN (VALUES
          (1, 'pull_ref', 'is required'), (2, 'pull_ref', 'must be a text'), (3, 'subject.sqft', 'must be greater than 0'),
          (4, 'subject.beds', 'must be at least 0'), (5, 'subject.baths', 'is required'), (6, 'subject.lat', 'must be a number'),
          (7, 'subject.zip', 'unknown field'), (8, 'weights.a|', 'must be at least 0'), (8, 'weights.b|', 'must be a number'),
          (9, 'include_overrides[1]', 'must be a text'), (9, 'include_overrides[2]', 'must be a text'),
          (10, 'filters.max_distance_mi', 'must be at least 0'), (12, 'filters.leased_only', 'must be true or false'),
          (13, 'candidate_rent', 'must be greater than 0'), (15, 'drift_pct', 'must be a number'),
          (16, 'Drift_pct', 'unknown field'), (16, 'drift', 'unknown field'), (17, 'subject', 'must be an object'), (18, '$', 'is not JSON')
        ) AS p(fault, path, problem) ON s_suppkey % 19 = fault""",
    "derive_provenance": f"""
        SELECT request_id, r.pull_ref, max(as_of) AS as_of, count(comp_key) AS n_comps, 64 AS digest_length, true AS same_when_dealt_anew,
               CAST(split_part(r.pull_ref, '-', 2) AS INTEGER) % 2 = 0 AS other_when_changed,
               '{Knobs().digest()}' AS config_digest, '{json.dumps(Knobs().to_mapping(), sort_keys=True)}' AS knobs, '{PIPELINE_VERSION}' AS pipeline_version,
               CASE WHEN CAST(split_part(r.pull_ref, '-', 2) AS INTEGER) % 3 = 1 THEN '2001 Active' END AS missing,
               CASE WHEN CAST(split_part(r.pull_ref, '-', 2) AS INTEGER) % 3 = 1 THEN 2 END AS calls_to_complete
        FROM (SELECT request_id, pull_ref FROM requests) r JOIN comps c USING (pull_ref) GROUP BY ALL""",
    "dominant_in_small_requests": """
        SELECT request_id, comp_key, weight / sum(weight) OVER (PARTITION BY request_id) > 0.4 AS dominant FROM curated
        WHERE included AND CAST(split_part(comp_key, ' ', 1) AS BIGINT) % 50 = s % 50""",
    "cohort_lookup_all": """
        SELECT request_id, cohort_year, comp_key, round(median_psf, 6) AS median_psf, basis FROM scored""",
    "listing_groups": """
        SELECT pull_ref, id, CASE WHEN id IS NULL THEN own_key END AS anonymous_key, count(*) AS copies,
               count(*) FILTER (status = 'Active') AS active_copies, min(own_key) FILTER (own_key <> '|') AS group_key
        FROM all_records GROUP BY ALL""",
    "refresh_changes": "SELECT * FROM comp_changes",
    "refresh_weights": "SELECT request_id, comp_key, weight, mark, mark NOT IN ('vanished', 'absent') AS in_source, conflict FROM carried",
    "refresh_summaries": """
        SELECT * FROM (
          SELECT pull_ref, count(*) FILTER (state = 'kept') AS kept_comps, count(*) FILTER (state = 'changed') AS changed_comps,
                 count(*) FILTER (state = 'new') AS new_comps, count(*) FILTER (state = 'merged') AS merged_comps,
                 count(*) FILTER (state = 'vanished') AS vanished_comps, count(*) FILTER (newly_leased) AS newly_leased,
                 CAST(sum(relists_stitched) AS BIGINT) AS relists_stitched
          FROM comp_changes GROUP BY ALL)
        LEFT JOIN (
          SELECT pull_ref, count(*) FILTER (mark NOT IN ('new', 'vanished', 'absent')) AS weights_moved,
                 count(*) FILTER (mark IN ('vanished', 'absent')) AS weights_stayed, count(*) FILTER (conflict) AS weights_conflicts
          FROM carried JOIN requests USING (request_id) GROUP BY ALL) USING (pull_ref)""",
}

EXTRA: dict[str, str] = {
    "placed_comps": """
        SELECT pull_ref, cohort_year, psf, level, CASE WHEN level < 2 THEN zip ELSE '*' END AS zip,
               CASE WHEN level IN (0, 2) THEN printf('%.1f', beds) ELSE '*' END AS beds
        FROM (SELECT *, CASE WHEN house % 10 <> 9 THEN '6061' || (house % 10) END AS zip, unnest(range(0, 4))::INTEGER AS level
              FROM (SELECT *, CAST(split_part(comp_key, ' ', 1) AS BIGINT) AS house FROM comps WHERE psf IS NOT NULL))
        WHERE level > 1 OR zip IS NOT NULL""",
    "cohort_ratios": """
        SELECT * EXCLUDE (last_year, last_median), CASE WHEN enough THEN last_year END AS prior_year,
               CASE WHEN enough THEN pow(median_psf / last_median, 1.0::DOUBLE / (cohort_year - last_year)) - 1 END AS growth
        FROM (SELECT *, last_value(CASE WHEN enough THEN cohort_year END IGNORE NULLS) OVER w AS last_year,
                     last_value(CASE WHEN enough THEN median_psf END IGNORE NULLS) OVER w AS last_median
              FROM (SELECT pull_ref, level, zip, beds, cohort_year, min(psf) FILTER (share >= 0.5) AS median_psf, count(*) AS n, count(*) >= 4 AS enough
                    FROM (SELECT *, cume_dist() OVER (PARTITION BY pull_ref, level, zip, beds, cohort_year ORDER BY psf) AS share FROM placed_comps)
                    GROUP BY ALL)
              WINDOW w AS (PARTITION BY pull_ref, level, zip, beds ORDER BY cohort_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "group_drifts": """
        SELECT pull_ref, level, zip, beds, (pow(arg_max(median_psf, cohort_year) / arg_min(median_psf, cohort_year),
               1.0::DOUBLE / (max(cohort_year) - min(cohort_year))) - 1) * 100 AS drift_pct,
               CAST(max(cohort_year) - min(cohort_year) AS INTEGER) AS years, min(n) AS evidence
        FROM cohort_ratios WHERE enough GROUP BY ALL HAVING count(*) > 1""",
    "made": """
        SELECT request_id AS decision_id, pull_ref, DATE '1996-01-01' + CAST(s * 37 % 2100 AS INTEGER) AS decided_on, candidate_rent,
               u || ' w oak st|' || CASE WHEN u % 5 <> 0 THEN CAST(u % 5 AS VARCHAR) ELSE '' END AS unit_key, predicted_days
        FROM (SELECT *, s * 3 // 20 * 100 + s * 7 % 130 AS u FROM requests)
        LEFT JOIN (SELECT request_id, max(days) FILTER (edge = 'mid') AS predicted_days FROM areas GROUP BY ALL) USING (request_id)""",
    "spans": """
        SELECT pull_ref, base_key AS unit_key, first_listed, chain_end, initial_ask, group_key, chain,
               coalesce(chain_end, lead(first_listed) OVER (PARTITION BY pull_ref, base_key ORDER BY first_listed), DATE '9999-12-31') AS upto
        FROM chains WHERE effective_dom >= 0""",
    "decided": """
        SELECT decision_id, pull_ref, decided_on, candidate_rent, predicted_days, outcome, CASE WHEN outcome = 'leased' THEN days END AS actual_days,
               CASE WHEN outcome IN ('leased', 'open') THEN coalesce(last_price, initial_ask) END AS final_ask,
               CASE WHEN outcome = 'leased' THEN NOT coalesce(last_cut > decided_on, false) AND coalesce(last_price, initial_ask) >= candidate_rent END AS ask_held,
               CASE WHEN outcome = 'leased' THEN days - predicted_days END AS error_days
        FROM (SELECT m.*, v.*  EXCLUDE (pull_ref, unit_key), CAST(chain_end - greatest(decided_on, first_listed) AS INTEGER) AS days,
                     CASE WHEN v.first_listed IS NULL THEN 'missing' WHEN v.first_listed - decided_on > 180 THEN 'late'
                          WHEN chain_end IS NULL THEN 'open' ELSE 'leased' END AS outcome
              FROM made m LEFT JOIN LATERAL (
                SELECT * FROM spans v WHERE v.pull_ref = m.pull_ref AND v.unit_key = m.unit_key AND v.upto >= m.decided_on
                ORDER BY upto LIMIT 1) v ON true)
        LEFT JOIN (SELECT pull_ref, group_key, chain, max(listed) AS last_cut, arg_max(price, listed) AS last_price
                   FROM stitched WHERE NOT starts_chain AND price < previous_price GROUP BY ALL) USING (pull_ref, group_key, chain)""",
    "asked": "SELECT request_id, comp_key, (s + CAST(split_part(comp_key, ' ', 1) AS BIGINT)) % 3 = 0 AS asked_for FROM curated",
    "pull_curves": """
        SELECT pull_ref, day, truncated_at,
               product(1.0::DOUBLE - events / at_risk) OVER (PARTITION BY pull_ref ORDER BY day) AS survival
        FROM (SELECT *, sum(at_day) OVER (PARTITION BY pull_ref ORDER BY day DESC) AS at_risk,
                     max(day) OVER (PARTITION BY pull_ref) AS truncated_at
              FROM (SELECT pull_ref, effective_dom AS day, count(*) AS at_day, count(*) FILTER (NOT censored) AS events
                    FROM comps GROUP BY ALL)) WHERE events > 0""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(select, EXTRA) for name, select in SELECTS.items()}
