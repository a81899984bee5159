"""Schemas of the documents and logs the library reads, as DDL strings."""

from __future__ import annotations

TURN = ("struct<turn_id:string,turn_index:int,user_message:string,assistant_message:string,"
        "gold_parents:array<string>,stale:boolean,superseded_by:string>")
ITEM = "struct<id:string,criterion:string,required:boolean>"
VERDICT_ITEM = "struct<id:string,satisfied:boolean,reason:string>"


SCENARIO = (
    f"scenario_id string, family string, label string, premise string, notes string, evidence_note string, "
    f"benchmark_version string, length_class string, turns array<{TURN}>, evidence_turn_ids array<string>, "
    f"distractor_turn_ids array<string>, answer_checklist array<{ITEM}>, evidence_spans map<string,string>")

ANSWER = (
    "key string, scenario_id string, family string, method string, budget int, model_key string, model string, "
    "selected_turn_ids array<string>, context_tokens int, context_precision double, context_recall double, "
    "context_f1 double, context_sufficiency int, irrelevant_context_ratio double, n_selected int, n_evidence int, "
    "n_distractors_selected int, selected_turn_tokens int, prompt string, response string, input_tokens int, "
    "output_tokens int, usd double, ts double, recall_fallback int, copied_from string")

VERDICT = (
    f"key string, judge_model string, judge_route string, judge_prompt_variant string, checklist_score double, "
    f"n_required int, n_satisfied int, all_required_satisfied int, distractor_leakage int, "
    f"checklist_items array<{VERDICT_ITEM}>, usd double, ts double")

POOL = (
    "scenario_id string, family string, variant string, n_history int, gold_closure array<string>, ranked array<string>, "
    "pool array<struct<turn_id:string,turn_index:int,sources:array<string>,cosine:double,shared_items:array<string>>>")

LEDGER = ("ts double, model string, purpose string, ref string, input_tokens bigint, output_tokens bigint, usd double")

LONG_SIDECAR = (
    "scenario_id string, family string, n_history int, full_history_tokens int, closure_ratio double, "
    "entity_registry array<string>, distractor_branch_entity_hits map<string,array<string>>, near_miss_turn_id string, "
    "checklist_evidence map<string,array<string>>, cosine struct<gold_median:double,distractor_median:double,ratio:double,pass:boolean>, "
    "cosine_per_turn map<string,double>, attempt_accepted int")

SPLICE_SIDECAR = (
    "target string, family string, base_history int, gold_closure array<string>, gold_entities array<string>, "
    "query_entities array<string>, chosen array<struct<donor:string,turns:int,cosine:double>>, "
    "used map<string,array<string>>, actual_lengths map<string,int>")
