"""Schemas of the memory tables and the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Names and types of tables and fields, and the domain's values.
LISTS = ("facts", "concepts", "files_read", "files_modified")

TABLES = {
    "embedding_models": "id long, model_name string, dimensions int, provider string, is_default boolean, created_at timestamp",
    "projects": "id long, name string, full_path string, created_at timestamp",
    "sessions": "id long, session_id string, project_id long, agent_type string, status string, started_at timestamp, completed_at timestamp, summary string, prompt_count int",
    "observations": "id long, session_id long, project_id long, title string, subtitle string, type string, narrative string, facts array<string>, concepts array<string>, files_read array<string>, files_modified array<string>, raw_text string, embedding array<float>, embedding_model_id long, prompt_number int, tool_name string, created_at timestamp",
    "queue": "id long, session_id string, tool_name string, tool_input string, tool_response_preview string, cwd string, last_user_message string, status string, retry_count int, created_at timestamp, processed_at timestamp",
    "user_prompts": "id long, session_id string, prompt_number int, prompt_text string, created_at timestamp",
    "lessons": "id long, project_id long, title string, rule string, severity string, trigger_tool string, trigger_pattern string, source_observation_id long, embedding array<float>, raw_text string, trigger_count long, last_triggered_at timestamp, active boolean, created_at timestamp",
}


def schema(ddl: str) -> T.StructType:
    """A declared schema as a type; needs a session."""
    return T.StructType.fromDDL(ddl)


TOOL_CALL = "session_id string, tool_name string, tool_input string, tool_response_preview string, cwd string, last_user_message string"
EXTRACTION = "skip boolean, title string, subtitle string, type string, narrative string, facts array<string>, concepts array<string>, files_read array<string>, files_modified array<string>"

OBSERVATION_TYPES = ("decision", "bugfix", "feature", "refactor", "discovery", "change", "pattern", "gotcha")
LEGACY_TYPES = ("decision", "bugfix", "feature", "refactor", "discovery", "change")
SEVERITIES = ("critical", "warning", "info")
SESSION_STATUS = ("active", "completed", "failed")
SKIPPED_TOOLS = (
    "ListMcpResourcesTool", "SlashCommand", "Skill", "TodoWrite", "AskUserQuestion", "TaskCreate", "TaskUpdate",
    "TaskGet", "TaskList", "TaskOutput", "TaskStop", "EnterPlanMode", "ExitPlanMode",
)
CAPTURED_TOOLS = ("Read", "Edit", "Write", "Bash", "Grep", "Glob", "NotebookEdit", "WebFetch", "WebSearch")
CHECKED_TOOLS = ("Edit", "Write", "Bash", "NotebookEdit")
MAX_PATTERN = 500
MAX_RETRIES = 3
FIELD_WEIGHTS = {"title": 1.0, "subtitle": 0.4, "narrative": 0.2, "raw_text": 0.1}
LESSON_WEIGHTS = {"title": 1.0, "rule": 0.4}
RRF_K = 60
RECENCY_DAYS = 10.0
