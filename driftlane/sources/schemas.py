"""Explicit schemas of every input; nothing is inferred from data."""

CARD = """struct<
    position: int, video_id: string, title: string, channel: string, url: string,
    metadata_text: string, duration_text: string, subscription_state: string,
    description: string, tags: array<string>, youtube_category_id: string,
    youtube_topics: array<string>, published_at: string,
    statistics: struct<view_count: string, like_count: string, comment_count: string>,
    view_count: string, like_count: string, comment_count: string>"""

SNAPSHOT = f"""
    source string, captured_at string, collection_session_id string,
    collector_profile struct<profile_id: string, profile_label: string,
                             participant_id: string, device_id: string>,
    parent_video_id string, parent_title string, parent_home_position int,
    replay_context struct<replay_index: int, replay_count: int>,
    subscription_channels array<struct<channel_id: string, name: string, url: string,
                                       subscriber_text: string, video_count_text: string>>,
    items array<{CARD}>
"""

VIDEO_METADATA = """
    video_id string, description string, tags array<string>, youtube_category_id string,
    youtube_topics array<string>, published_at string,
    statistics struct<view_count: string, like_count: string, comment_count: string>
"""

EVENT = """
    schema_version string, event_id string, participant_id string, device_id string,
    profile_id string, profile_slot string, platform string, captured_at string,
    event_type string, engagement_score string, score_model string, source string,
    video_id string, video_title string, channel string, channel_subscription_state string,
    surface string, confidence string,
    context struct<page_url: string, tree_signature: string, event_class: string, detection: string>
"""

_WEIGHTS = """today_weight: double, weight_7d: double, weight_30d: double, long_term_weight: double"""

_INTERESTS = f"""array<struct<id: string, name_vi: string, predicted_weight: double, {_WEIGHTS},
    trend_state: string, home_weight: double, up_next_weight: double, subscription_weight: double>>"""

_INTENTS = "array<struct<id: string, label: string, weight: double>>"

_TERMS = f"array<struct<value: string, weight: double, {_WEIGHTS}, trend_state: string>>"

SUBMISSION = f"""
    schema_version string, participant_id string, device_id string, profile_id string,
    profile_key string, behavior_profile_name string, analysis_version string, updated_at string,
    certainty_score double, daily_observation_count int,
    collector struct<platform: string, agent_version: string, submission_mode: string>,
    interest_weights {_INTERESTS}, intent_weights {_INTENTS},
    keyword_trends {_TERMS}, tag_trends {_TERMS}
"""

NODE = """struct<depth: int, text: string, content_description: string, view_id: string,
    class_name: string, clickable: boolean, selected: boolean, scrollable: boolean, child_count: int,
    bounds: struct<left: int, top: int, right: int, bottom: int>>"""

DEVICE_SNAPSHOT = f"""
    schema_version string, platform string, source_package string, captured_at string,
    extraction_mode string, event_type string,
    surface_guess struct<surface: string, confidence: double, evidence: array<string>>,
    tree_signature string, node_count int, nodes array<{NODE}>
"""

DEVICE_ENVELOPE = f"""
    schema_version string, participant_id string, device_id string, profile_slot string, sent_at string,
    snapshot struct<schema_version: string, platform: string, source_package: string,
        captured_at: string, extraction_mode: string,
        surface_guess: struct<surface: string, confidence: double, evidence: array<string>>,
        tree_signature: string, node_count: int, nodes: array<{NODE}>>
"""

DAILY_OBSERVATION = """
    profile_id string, day date, recorded_at string, candidate_name string, field string,
    key string, value string, weight double, surfaces map<string, double>
"""

RULES = """
    scoring struct<entity: double, anchor: double, support: double, youtube_category: double,
                   source_multipliers: map<string, double>>,
    categories array<struct<id: string, name_vi: string, youtube_video_category_ids: array<int>,
        entities: array<string>, anchors: array<string>, support: array<string>, keywords: array<string>>>,
    intents map<string, struct<name_vi: string, anchors: array<string>>>,
    suppressions array<array<string>>
"""

RELATIONS = """
    edges array<struct<source: string, target: string, type: string, weight: double,
                       bidirectional: boolean, source_type: string>>
"""
