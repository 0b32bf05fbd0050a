"""Column rules on tools, models, modes and edits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.functions.text import strip_space

# Names that the logs use.
TOOLS = ("claude", "cursor", "codex", "copilot", "gemini", "human", "copypaste")
NOT_AI = ("", "human", "copypaste")
GEN_TYPES = ("chat", "cli", "completion", "human", "unknown")
WHOLE_FILE_WRITES = ("write", "create_file", "createfile", "create_new_file")
SOURCE_NAMES = r"\.(go|py|js|jsx|ts|tsx|java|kt|rs|c|h|cc|cpp|hpp|cs|rb|php|swift|scala|sql|sh|md|json|ya?ml|toml|html|css)$"
SHELL_TOOLS = ("bash", "shell", "powershell", "run_shell_command", "shell_command", "exec_command", "local_shell_call", "local_shell", "container.exec", "run_in_terminal", "run_command")


def author_type(tool: Column) -> Column:
    """``Human`` for no tool, a person or copy and paste; ``AI`` else."""
    return F.when(F.coalesce(tool, F.lit("")).isin(*NOT_AI), "Human").otherwise("AI")


def default_confidence(confidence: Column, tool: Column) -> Column:
    return F.coalesce(F.nullif(confidence, F.lit("")), F.when(tool == "copilot", "low").otherwise("high"))


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1).otherwise(0)


def gen_type_of_entrypoint(entrypoint: Column) -> Column:
    """How a session was started: from a terminal or SDK, else in a chat."""
    return F.when(entrypoint.isin("cli", "sdk-ts"), "cli").otherwise("chat")


def gen_type_of_originator(originator: Column) -> Column:
    return F.when(F.lower(originator).rlike("vscode|jetbrains|ide|extension"), "chat").otherwise("cli")


def gen_type_or_completion(explicit: Column, session_id: Column) -> Column:
    """The stated type, else a completion where there is no session, else a chat."""
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(F.coalesce(session_id, F.lit("")) == "", "completion").otherwise("chat"))


def gen_type_of_log_line(line: Column) -> Column:
    return F.when(F.lower(line).contains("chat"), "chat").otherwise("completion")


def tool_of_model(model: Column) -> Column:
    """The tool that runs a model, by names inside it; empty if none is known."""
    m = F.lower(model)
    return (
        F.when(m.rlike("claude|opus|sonnet|haiku"), "claude")
        .when(m.rlike("composer|cursor"), "cursor")
        .when(m.contains("gemini"), "gemini")
        .when(m.contains("copilot"), "copilot")
        .when(m.rlike("gpt|codex|^o[134]"), "codex")
        .otherwise("")
    )


def meta(raw: Column, key: str) -> Column:
    """A field of an edit's meta JSON; null for other text."""
    return F.get_json_object(raw, f"$.{key}")


def is_whole_file_write(raw_meta: Column) -> Column:
    return F.coalesce(F.lower(meta(raw_meta, "tool")).isin(*WHOLE_FILE_WRITES), F.lit(False))


def is_tab_log(tool: Column, raw_meta: Column) -> Column:
    return (tool == "cursor") & F.coalesce(meta(raw_meta, "source") == "cursor_tab_log", F.lit(False))


def ai_eligible(tool: Column, raw_meta: Column) -> Column:
    """An AI edit that says which lines are new: no whole-file write, but for the tool that is always trusted."""
    return (author_type(tool) == "AI") & ((tool == "cursor") | ~is_whole_file_write(raw_meta))


def paste_eligible(tool: Column) -> Column:
    return F.coalesce(tool == "copypaste", F.lit(False))


def passes() -> dict[str, Column]:
    """The three matchers in their order: tab log, copy and paste, AI; each with the edits it may use."""
    tool, raw_meta = F.col("tool"), F.col("raw_meta")
    return {"tab": is_tab_log(tool, raw_meta), "paste": paste_eligible(tool), "ai": ai_eligible(tool, raw_meta)}


def accepted_lines(lines: Column) -> Column:
    """Lines in an array of ranges, those with end before start left out."""
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, r: n + F.when(r["end"] >= r["start"], r["end"] - r["start"] + 1).otherwise(0))


def replay_of_message(message: Column) -> Column:
    """struct<kind, shas>: cherry-pick trailers win over a squash template; null for other messages."""
    picked = F.regexp_extract_all(message, F.lit(r"\(cherry picked from commit ([0-9a-f]{40})\)"), 1)
    squashed = F.regexp_extract_all(message, F.lit(r"(?m)^commit ([0-9a-f]{40})\b"), 1)
    return F.when(F.size(picked) > 0, F.struct(F.lit("cherry_pick").alias("kind"), picked.alias("shas"))).when(
        message.contains("Squashed commit of the following:") & (F.size(squashed) > 0), F.struct(F.lit("squash_merge").alias("kind"), squashed.alias("shas"))
    )


def tool_kind(name: Column) -> Column:
    """What a tool call does, by its name: shell, patch, create, replace, insert, write or other."""
    n = F.lower(strip_space(name))
    return (
        F.when(n.isin(*SHELL_TOOLS), "shell")
        .when(n.rlike("patch"), "patch")
        .when(n.rlike("create_?(new_?)?file"), "create")
        .when(n.rlike("replace_?string|str_?replace"), "replace")
        .when(n.rlike("insert_?edit"), "insert")
        .when(n.rlike("^write(_to_file|_file)?$"), "write")
        .otherwise("other")
    )


def is_source_name(path: Column) -> Column:
    return F.lower(path).rlike(SOURCE_NAMES)
