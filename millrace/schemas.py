"""Schemas of the engine's tables, as DDL."""

ARTICLE = (
    "article_id string, title string, publish_time timestamp_ntz, source string, content string, trading_code string, entity string, industry_code string, industry string, "
    "event_label string, polarity_label string, impact_analysis string, duplicate_flag string, duplication_id string, task_scope string, sheet_name string, source_row int, extra map<string,string>"
)
SUBJECT_CANDIDATE = "struct<subject_code:string,subject_name:string,score:double>"
EVENT_CANDIDATE = "struct<event_name:string,score:double,subject_code:string,subject_name:string,description:string>"
EDGE = "left_article_id string, right_article_id string, scope string, shared_subject_codes array<string>, subject_score double, day_gap double"
ROUTE = f"article_id string, scope string, accepted_subject_code string, accepted_subject_name string, method string, reason string, top1_score double, top1_margin double, candidates array<{SUBJECT_CANDIDATE}>"
RECALL = f"article_id string, scope string, subject_codes array<string>, candidate_count int, candidates array<{EVENT_CANDIDATE}>"
PAIR = "pair_id string, label int, scope string, left_article_id string, right_article_id string, left_text string, right_text string, day_gap double"
FEEDBACK = "feedback_id string, article_id string, kind string, expected_event_type string, observed_event_type string, reviewer string, note string, metadata map<string,string>"
REVIEW_ITEM = "review_id string, article_id string, scope string, baseline_event string, candidate_events array<string>, svc_margin double, route_status string, priority double, reason string, provenance_hash string"
HUMAN_REVIEW = "review_id string, provenance_hash string, expected_event_type string, reviewer string, approved boolean, note string"
SKILL = "skill_id string, name string, target_event_type string, observed_event_type string, trigger_terms array<string>, status string, source_feedback_ids array<string>, provenance_hash string, reason string, seq long"
EVIDENCE = "evidence_id string, article_id string, source string, source_type string, source_key string, stance string, authority double, ts timestamp_ntz, summary string"
EVENT_DEFINITION = "scope string, subject_code string, subject_name string, event_name string, description string"
