"""Schemas (DDL) of the tables that the engine reads and writes. ``ordinal`` is the order of arrival, which several operators need."""

OBSERVATION = "struct<tty_chars: array<array<int>>, message: array<int>, blstats: array<int>, inventory: array<int>, tty_colors: array<array<int>>, tty_cursor: array<int>, scores: int, timestamps: bigint, done: boolean>"
MESSAGES = "array<struct<role: string, content: string>>"
METADATA = (
    "struct<raw_key_code: int, raw_key_label: string, valid_action_ids: array<int>, target_action_id: int, conditioning_action_id: int, role: string, race: string, "
    "alignment: string, death: string, points: int, turns: int, target_frame_kind: string, next_frame_response_format: string, label_source: string, label_confidence: double, "
    "label_reason: string, pseudo_direction: string, pseudo_action_name: string, pseudo_key_label: string, true_keypress_label_available: boolean>"
)

ROOTS = "dataset_name string, root string, ttyrec_version int"
GAMES = "gameid bigint, role string, race string, align string, death string, points int, turns int"
RECORDINGS = "path string, part int, size bigint, mtime double, gameid bigint"
ARCHIVE = "shard_tar string, shard_db string, shard_index int"
DECODED_FLAT = "gameids array<bigint>, steps array<int>, keypresses array<int>, tty_chars array<array<array<int>>>, message array<array<int>>, blstats array<array<int>>"
TRANSITION = f"ordinal bigint, gameid bigint, step int, raw_key_code int, observation {OBSERVATION}, next_observation {OBSERVATION}, sequence_id string, sequence_step int"
ACTIONS = "env_id string, ordinal int, action_id int, nle_action_name string, raw_key_code int, key_label string"
SUPERVISED_ROW = (
    f"schema_version string, dataset_name string, split string, task string, mode string, gameid bigint, episode_id string, step int, sequence_id string, sequence_step int, messages {MESSAGES}, metadata {METADATA}"
)
SPLIT_MANIFEST = "split string, gameid bigint"
REJECTIONS = "reason string, count bigint"
WATCH_EVENT = (
    "run_id string, seed bigint, character string, step int, side string, action_id int, reward double, cumulative_reward double, done boolean, death string, score int, hp int, depth int, "
    "prompt_score int, prompt_hp int, prompt_depth int, message string, hunger string, menu_open boolean, game_time_advanced boolean, terminal_frame string, prompt_terminal_frame string, "
    "policy_observation_text string, policy_user_prompt string"
)
PLANES = "gameid int, sequence_id int, sequence_step int, split_code smallint, action_id int, raw_key_code smallint, current_chars binary, current_colors binary, next_chars binary, next_colors binary"
BUILD_PROGRESS = "processed_transitions bigint, accepted_policy_rows bigint, accepted_next_frame_rows bigint, rejected_rows bigint, reason string, last_gameid bigint, last_step int"
UPLOADS = "name string, source_path string, remote_parent string, status string, returncode int, elapsed_seconds double, stdout_tail string, stderr_tail string"
EVAL_PROGRESS = "phase string, evaluated_rows bigint, generated_frames bigint, parse_valid bigint"
BENCHMARK = "struct<benchmark_id: string, lane: string, protocol_id: string, comparison: string, candidate_metric: string, source: string, required_for_competitive: boolean, target: struct<estimate: double, lower: double, unit: string>>"
