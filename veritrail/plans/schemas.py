"""The columns of every query. Whole numbers are 64-bit, fractions are doubles rounded to six places on both sides of the comparison."""

from __future__ import annotations

SCHEMAS = {
    "q_ladder": "subject bigint, object string, verdict string, p bigint",
    "q_faithfulness": "object string, n bigint, checked bigint, faithful bigint, made_up bigint, faithfulness double, faithfulness_lo double, faithfulness_hi double, relevance double, relevance_lo double, relevance_hi double",
    "q_refute_recall": "object string, n bigint, with_refutation bigint, refutations bigint, by_skeptic bigint, skeptic_share double",
    "q_false_negatives": "lang string, n bigint, n_valid bigint, rate double, rate_lo double, rate_hi double",
    "q_time_to_refute": "run string, refuting double, total double, candidates bigint, per_candidate double",
    "q_zero_ratio": "object string, zero bigint, total bigint, ratio double",
    "q_universe_baseline": "label string, n bigint, expected double",
    "q_use_signal": "n_evaluable bigint, n_unlinked bigint, n_hit bigint, n_tp bigint, tp_hit bigint, n_tn bigint, tn_hit bigint, most bigint, rate double, rate_lo double, rate_hi double, fisher_p double, decision string",
    "q_fresh_ids": "subject bigint, id bigint, place bigint",
    "q_top_sections": "conv_id bigint, turn bigint, place bigint",
    "q_nearest_deadline": "o_custkey bigint, o_orderkey bigint, days bigint, place bigint",
    "q_skeleton": "skeleton string, n bigint",
    "q_structure_rank": "brand string, part bigint, place bigint",
    "q_dock_verdict": "verdict string, n bigint",
    "q_organism": "organism string, n bigint",
    "q_accessibility": "eml boolean, oral_ok boolean, small boolean, n bigint",
    "q_alerts": "herg string, dili string, n bigint",
    "q_localized": "target string, kind string, chain string",
    "q_in_outcome": "inside boolean, n bigint",
    "q_source_tag": "tag string, n bigint",
    "q_adjunct": "name string, adjunct boolean",
    "q_mcnemar_power": "n bigint, psi double, power double",
    "q_weight": "study_type string, size string, decisive boolean, confidence string, review string, weight double, n bigint",
    "q_dedupe_trials": "subject bigint, object string, kept bigint, total double",
    "q_attenuate": "subject bigint, object string, direction string, n bigint, total double, attenuated double",
    "q_contested": "subject bigint, object string, ratio double, contested boolean",
    "q_veto": "subject bigint, object string, hard_refute bigint",
    "q_adjudicate": "subject bigint, object string, n_support bigint, n_refute bigint, w_support double, w_refute double, firm_support bigint, firm_refute bigint, p bigint, verdict string",
    "q_adjudicate_emergency": "subject bigint, object string, n_support bigint, n_refute bigint, w_support double, w_refute double, firm_support bigint, firm_refute bigint, p bigint, verdict string",
    "q_verdict_counts": "verdict string, n bigint, sum_p bigint",
    "q_cutoff": "subject bigint, object string, n bigint, n_unknown_year bigint",
    "q_leak_exclude": "direction string, status string, n bigint",
    "q_fragility": "subject bigint, object string, base string, n bigint, fragility bigint",
    "q_tier_dependence": "with_tier string, without_tier string, n bigint, changed boolean",
    "q_existence_gate": "subject bigint, object string, pair_count bigint, outcome string",
    "q_comparative_survey": "object string, n bigint, n_confirmatory bigint, n_decisive bigint, n_large bigint, usable_share double",
    "q_repeat_stability": "v0 string, v1 string, n bigint, mean_gap double",
    "q_quote_verify": "item_id bigint, kind string, doc_id bigint, ok boolean, how string, confirmed bigint, unconfirmed bigint",
    "q_quote_prefix": "item_id bigint, doc_id bigint, confirmed string",
    "q_cross_contamination": "item_id bigint, n_docs bigint, first_doc bigint, contaminated boolean",
    "q_mention_guard": "needle string, hay string, named boolean",
    "q_result_statement": "doc_id bigint, prose boolean, structured boolean",
    "q_grade": "doc_id bigint, certainty string",
    "q_reason_class": "reason string, n bigint, first_doc bigint",
    "q_failure_mode": "mode string, n bigint, first_doc bigint",
    "q_stop_reason": "doc_id bigint, stop_reason string",
    "q_structured_verify": "doc_id bigint, kind string, how string",
    "q_trial_ids": "conv_id bigint, turn bigint, ids string",
    "q_indication_tokens": "name string, tokens string, alnum string",
    "q_tokens_subset_join": "a string, b string",
    "q_rare_token_join": "a string, b string, n_rare bigint, relation string",
    "q_hash_split": "p_partkey bigint, bucket bigint, development boolean",
    "q_html_sections": "page_id bigint, title string, n_paragraphs bigint, text string, n_items bigint",
    "q_limit_cues": "doc_id bigint, n_paragraphs bigint, digest string, truncated boolean",
    "q_study_types": "study_type string, comparative boolean, n bigint",
    "q_usable_trials": "reason string, n bigint",
    "q_best_evidence": "drug bigint, disease bigint, ord bigint, phase string, kind string",
    "q_first_occurrence": "drug bigint, ord bigint, done string",
    "q_cascade_match": "name string, rule string, key string, status string",
    "q_stratified_sample": "kind string, ord bigint, place bigint",
    "q_interleaved": "drug bigint, id bigint, prio bigint, place bigint",
    "q_negative_pairs": "drug bigint, disease bigint",
    "q_ceiling": "drug bigint, disease bigint, n bigint, n_randomised bigint, n_usable bigint",
    "q_safety_screen": "term string, n bigint",
    "q_gate_trail": "gate string, outcome string, n bigint",
    "q_router": "mechanism string, route string, advised boolean, n bigint",
    "q_binding": "l_partkey bigint, best double, target bigint, n bigint, middle double, verdict string",
    "q_interval_cover": "s_nationkey bigint, n_covered bigint",
    "q_site_quality": "vec_id bigint, n bigint, total double, low double, out_of_range bigint",
    "q_leak_flags": "y bigint, leak boolean, n bigint",
    "q_multihop": "d bigint, c bigint, shared bigint",
    "q_known_excluded": "d bigint, n_candidates bigint, n_known bigint",
    "q_degree_z": "d bigint, c bigint, shared bigint, n bigint, expected double, z double",
    "q_hypergeom": "d bigint, c bigint, shared bigint, marked bigint, n bigint, p double",
    "q_recall_at_k": "n_hidden bigint, n_reachable bigint, recall_at_20 double, recall_at_100 double, mrr double, ceiling double, method string",
    "q_top_candidates": "d bigint, c bigint, shared bigint, rank bigint, via string",
    "q_shared_genes_status": "c bigint, d bigint, status string, shared bigint",
    "q_coclaim": "compound bigint, entity bigint, n_patents bigint",
    "q_field_counts_capped": "compound bigint, field bigint, n bigint, kept bigint",
    "q_recent_patents": "patent bigint, entity bigint, year bigint, place bigint",
    "q_year_signal": "entity bigint, n bigint, n_claimed bigint, claimed_share double, all_share double",
    "q_prr": "drug bigint, event bigint, a bigint, n_drug bigint, prr double, signal boolean",
    "q_reverse_merge": "drug bigint, n_events bigint, prr double, top_event bigint, n_max bigint",
    "q_label_sizes": "drug bigint, n_events bigint, n_reports bigint, density double",
    "q_kb_fold": "subject bigint, object bigint, act string, seq bigint, n_acts bigint",
    "q_kb_block": "answer string, n bigint",
    "q_tanimoto_pairs": "a bigint, b bigint, similarity double",
    "q_stream_kb": "subject bigint, object bigint, act string, seq bigint",
    "q_stream_prr": "drug bigint, event bigint, a bigint",
    "q_match_bucket": "c_custkey bigint, bucket bigint",
    "q_greedy_match": "id bigint, n bigint, other bigint, other_n bigint, shift bigint",
    "q_auroc": "lang string, auc double, n_pos bigint, n_neg bigint, lo double, hi double",
    "q_ece5": "ece double, n bigint",
    "q_ece10": "ece double, n bigint",
    "q_brier": "source string, brier_a double, brier_b double, specificity double, sensitivity double",
    "q_confusion_ci": "source string, k bigint, n bigint, lo double, hi double",
    "q_selective": "mode string, n bigint, n_answered bigint, coverage double, accuracy double",
    "q_risk_coverage": "id bigint, k bigint, coverage double, risk double, grisk double",
    "q_aurc": "n bigint, errors bigint, aurc double, augrc double, optimal_aurc double",
    "q_risk_at_coverage": "coverage double, k bigint, risk double",
    "q_tie_repeats": "mean double, sd double, repeats bigint",
    "q_reject_precision": "k bigint, n bigint, precision double",
    "q_kappa": "n_all bigint, observed double, expected double, kappa double, lo double, hi double",
    "q_mcnemar_counts": "both bigint, only_a bigint, only_b bigint, neither bigint, p double",
    "q_fisher": "source string, a bigint, b bigint, c bigint, d bigint, p double",
    "q_binomial": "source string, k bigint, n bigint, p double",
    "q_power": "a string, b string, n1 bigint, n2 bigint, power double",
    "q_wilcoxon_ranks": "n bigint, w_plus double, w_minus double, z double",
    "q_holm": "source string, p double, adjusted double",
    "q_bootstrap_ci": "mean double, lo double, hi double",
    "q_platt": "a double, b double, brier double",
    "q_perf_card": "subset string, n bigint, n_tp bigint, n_reject bigint, reject_precision double, reject_recall double, false_reject double, hold_share double",
    "q_verdict_cube": "verdict_b string, lang string, n bigint, n_pos bigint, level bigint",
    "q_reject_split": "y bigint, promising bigint, conditional bigint, hold bigint, reject bigint",
    "q_ci_overlap": "max_lo double, min_hi double, overlap boolean",
    "q_quantiles": "lang string, median double, upper_median bigint, q90 bigint",
    "q_trail_last_gate": "conv_id bigint, first_gate string, last_gate string, n bigint",
    "q_flips": "conv_id bigint, flips bigint",
    "q_killed": "conv_id bigint, killed boolean, n_skipped bigint",
    "q_cost_report": "purpose string, calls bigint, unmetered bigint, spent double, users bigint",
    "q_top_spelling": "key string, spelling string, n bigint",
    "q_search_difference": "lang string, both bigint, only_long bigint, only_source bigint, jaccard double",
}
