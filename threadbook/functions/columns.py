"""Column functions of the ingest path. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EXTRACTION, LEGACY_TYPES, MAX_PATTERN, OBSERVATION_TYPES, SEVERITIES


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: str | Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(_c(x), F.lit(""))


def derive_project(cwd: str | Column) -> Column:
    """Last path segment of a working directory; "unknown" if there is none to look at."""
    c = _c(cwd)
    base = F.regexp_extract(F.rtrim(c, F.lit("/")), r"([^/]*)$", 1)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown")).otherwise(base)


def truncate_preview(text: str | Column, size: int = 2000, other: Column | None = None) -> Column:
    """The first ``size`` characters; ``other`` (a struct, array or map) goes in as JSON where the text is null."""
    whole = _c(text) if other is None else F.coalesce(_c(text), F.to_json(other))
    return F.substring(whole, 1, size)


def tool_input_preview(tool: str | Column, given: str | Column, part: int = 500, size: int = 1000) -> Column:
    """What a rule's pattern is matched with: the command of a shell call, path and new text of an edit, else the JSON."""
    tool, given = _c(tool), _c(given)
    get = lambda k: filled(F.get_json_object(given, f"$.{k}"))
    joined = lambda *parts: F.concat_ws(" ", *parts)
    cut = lambda c: F.substring(c, 1, part)
    text = (
        F.when(tool == "Bash", F.coalesce(get("command"), get("cmd"), F.lit("")))
        .when(tool.isin("Edit", "Write"), joined(get("file_path"), cut(get("new_string")), cut(get("content"))))
        .when(tool == "NotebookEdit", joined(get("notebook_path"), cut(get("new_source"))))
        .otherwise(cut(given))
    )
    return F.coalesce(F.substring(text, 1, size), F.lit(""))


SYSTEM_PROMPT = "You keep notes for a coding assistant. Given one tool call and its result, write down what was learned, built, fixed or decided as one JSON object, or {\"skip\": true} if there is nothing to keep."


def extraction_prompt(tool="tool_name", given="tool_input", response="tool_response_preview", cwd="cwd", message="last_user_message") -> Column:
    """Parts that are there, a blank line between them. The tool's line is always there."""
    part = lambda label, c, n: F.concat(F.lit(label), F.substring(filled(c), 1, n) if n else filled(c))
    tool_line = F.concat(F.lit("Tool: "), F.coalesce(_c(tool), F.lit("")))
    return F.concat_ws("\n\n", part("Working directory: ", cwd, 0), part("User request: ", message, 500), tool_line, part("Input: ", given, 1500), part("Response: ", response, 2000))


def chat_prompt(prompt: str | Column, system: str = SYSTEM_PROMPT) -> Column:
    """The prompt in the chat template that local models take."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), _c(prompt), F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def without_fences(text: str | Column) -> Column:
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    inner = F.regexp_extract(t, r"(?s)\A`{3}(?:json)?\s*+(.*?)\s*(?:`{3})?\z", 1)
    return F.when(t.startswith("```"), inner).otherwise(t)


def parse_extraction(text: str | Column) -> Column:
    """struct(outcome, data): ok with the fields, skip, or error for what is not a JSON object."""
    bare = without_fences(text)
    data = F.from_json(bare, EXTRACTION)
    good = F.try_parse_json(bare).isNotNull() & bare.startswith("{")
    outcome = F.when(~F.coalesce(good, F.lit(False)), "error").when(F.coalesce(data["skip"], F.lit(False)), "skip").otherwise("ok")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ok", data).alias("data"))


def build_raw_text(title="title", subtitle="subtitle", narrative="narrative", facts="facts") -> Column:
    """Title, subtitle and narrative where filled, then a line "- fact" for each fact."""
    lines = F.transform(F.coalesce(_c(facts), F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x))
    return F.concat_ws("\n", _c(title), filled(subtitle), filled(narrative), lines)


def normalize_type(kind: str | Column) -> Column:
    """Legacy types map to themselves, all others to discovery."""
    return F.when(_c(kind).isin(*LEGACY_TYPES), _c(kind)).otherwise("discovery")


def parse_legacy_ts(text: str | Column) -> Column:
    """ISO text in UTC unless it has an offset; null if it is no time."""
    return F.try_to_timestamp(_c(text))


def known_type(kind: str | Column = "type") -> Column:
    return _c(kind).isin(*OBSERVATION_TYPES)


def severity_order(severity: str | Column = "severity") -> Column:
    out = F.when(_c(severity) == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        out = out.when(_c(severity) == s, i)
    return out.otherwise(len(SEVERITIES))


def known_severity(severity: str | Column) -> Column:
    return F.when(_c(severity).isin(*SEVERITIES), _c(severity)).otherwise("warning")


def short_pattern(pattern: str | Column) -> Column:
    return F.coalesce(F.length(_c(pattern)) <= MAX_PATTERN, F.lit(True))


def unit_vector(v: str | Column) -> Column:
    """The vector as doubles, divided by its length; null for null and zero vectors."""
    wide = F.transform(_c(v), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
