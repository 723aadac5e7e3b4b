"""Explicit schemas of files and tables; nothing is inferred."""

from __future__ import annotations

ACTION = "struct<action_type:string,action_text:string,original_text:string,target:string,date:string,timestamp:string>"
RAW_USER = f"community_id bigint, user_id bigint, actions array<{ACTION}>"
WINDOWED_USER = (
    f"community_id bigint, user_id bigint, windows map<string,array<{ACTION}>>, total_actions int, used_actions int, split_mode string, "
    "split_meta struct<month_block_start:string,month_keys_used:array<string>,num_months:int,windows_per_month:int,actions_per_window:int,month_sampling:string>, window_size_effective int"
)
PREDICTIONS = "user_id bigint, community_id bigint, method string, persona_id bigint, window_idx int, wpos int, pred_type string, pred_content string, semantic_similarity double"
SCORES = "user_id bigint, community_id bigint, method string, persona_id bigint, window_idx int, f double, l double, q double"
PERSONA_CACHE = "community_id int not null, user_id bigint not null, profile_text string not null, sample_size int not null, profile_tokens int not null, profile_chars int not null, updated_at timestamp not null"
PERSONA_STORE = "user_id bigint, community_id bigint, window_keys_used array<string>, p0_text string"
SAMPLE = "Instruction string, input string, output string, user_id bigint"
ROW_ACTIONS = "user_id bigint, action_type string, post_id string, target_post_id string, action_text string, original_text string, date string"
