"""Agent session logs (JSON lines) as turn atoms: gaps and islands over the lines of each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_CHARS = 20
MOST_TOOL_LINES = 24
# What the harness, not the user, says; a tool call's telling fields, first present one first.
AUTOMATED = ["<local-command", "<command-", "Caveat:", "<task-notification", "<system-reminder", "[SYSTEM NOTIFICATION", "<bash-", "<user-memory"]
TOOL_FIELDS = ["description", "file_path", "pattern", "query", "url", "command", "prompt"]
SUMMARY = "Session summary (context compaction)"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_user(text: Column, tags: tuple[str, ...] = ("system-reminder",)) -> Column:
    """text without injected blocks of these tags; null if nothing is left or the harness wrote it."""
    for tag in tags:
        text = F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", "")
    text = _strip(text)
    said = text != ""
    for prefix in AUTOMATED:
        said = said & ~text.startswith(prefix)
    return F.when(said, text)


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def tool_line(block: Column) -> Column:
    """[name] and the first present field on one line of 200 characters."""
    said = F.coalesce(*(F.nullif(_get(block, f"$.input.{f}"), F.lit("")) for f in TOOL_FIELDS), F.lit(""))
    line = _strip(F.regexp_replace(said, r"\s+", " "))
    line = F.when(F.length(line) <= 200, line).otherwise(F.concat(F.left(line, F.lit(200)), F.lit("…")))
    return F.concat(F.lit("["), F.coalesce(_get(block, "$.name"), F.lit("?")), F.lit("] "), line)


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (ordered within a file, also over splits), value, modified of JSON-lines files; files stay splittable."""
    line = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line"), "value", (F.unix_micros("_metadata.file_modification_time") / 1e6).alias("modified"))


def turn_atoms(lines: DataFrame, tags: tuple[str, ...] = ("system-reminder",)) -> DataFrame:
    """file, ordinal, question, answer, text, at of each turn of each session.

    lines: file, line (any orderable type), value (JSON), modified (seconds, used where a turn has no time).
    A turn starts at each text of the user that clean_user leaves; side chains, meta records, tool results and
    broken lines are passed over; a compaction summary is an atom of its own. Texts under 20 characters give
    none, and the ordinal counts kept atoms only. Lines of a null file form one session.
    """
    v = F.try_parse_json("value")
    one = lines.select("file", "line", "modified", v.alias("v")).withColumn("kind", _get(F.col("v"), "$.type"))
    hidden = F.coalesce(_get(F.col("v"), "$.isSidechain", "boolean"), F.lit(False)) | F.coalesce(_get(F.col("v"), "$.isMeta", "boolean"), F.lit(False))
    one = one.where(F.col("kind").isin("user", "assistant") & ~hidden).withColumn("blocks", _get(F.col("v"), "$.message.content", "array<variant>"))
    is_text = lambda b: _get(b, "$.type") == "text"
    texts = F.transform(F.filter("blocks", is_text), lambda b: F.coalesce(_get(b, "$.text"), F.lit("")))
    written = F.when(F.col("blocks").isNull(), _get(F.col("v"), "$.message.content")).otherwise(F.array_join(texts, "\n\n"))
    compact = (F.col("kind") == "user") & F.coalesce(_get(F.col("v"), "$.isCompactSummary", "boolean"), F.lit(False))
    said = F.when(F.col("kind") == "assistant", F.filter(F.transform(texts, _strip), lambda x: x != ""))
    tools = F.when(F.col("kind") == "assistant", F.transform(F.filter("blocks", lambda b: _get(b, "$.type") == "tool_use"), tool_line))
    none = F.array().cast("array<string>")
    one = one.select(
        "file", "line", "modified", compact.alias("compact"),
        F.when(compact, F.lit(SUMMARY)).when(F.col("kind") == "user", clean_user(written, tags)).alias("question"),
        F.coalesce(F.when(compact, F.array(_strip(F.coalesce(written, F.lit(""))))), said, none).alias("parts"),
        F.coalesce(tools, none).alias("tools"),
        (F.unix_micros(F.try_to_timestamp(_get(F.col("v"), "$.timestamp"))) / 1e6).alias("at"),
    )
    return _assembled(one)


def _assembled(one: DataFrame) -> DataFrame:
    """Turn atoms of rows (file, line, modified, compact, question, parts, tools, at): a question opens a turn."""
    turn = F.sum(F.col("question").isNotNull().cast("long")).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    own = F.when(F.col("question").isNotNull(), F.col("at"))
    in_order = F.array_sort(F.collect_list(F.struct("line", "parts", "tools")))
    turns = one.withColumn("turn", turn).groupBy("file", "turn", "compact").agg(F.max("question").alias("question"), F.coalesce(F.max(own), F.max("modified")).alias("at"), in_order.alias("r"))
    turns = turns.withColumn("parts", F.filter(F.flatten("r.parts"), lambda x: x != "")).withColumn("tools", F.flatten("r.tools"))
    half, n = MOST_TOOL_LINES // 2, F.size("tools")
    gap = F.concat(F.lit("… "), (n - 2 * half).cast("string"), F.lit(" more tool calls …"))
    shown = F.when(n <= MOST_TOOL_LINES, F.col("tools")).otherwise(F.concat(F.slice("tools", 1, half), F.array(gap), F.slice("tools", -half, half)))
    called = F.when(n > 0, F.concat(F.lit("Tools: "), F.array_join(shown, "\n")))
    turns = turns.where("question IS NOT NULL OR size(parts) > 0")
    turns = turns.withColumn("question", F.coalesce("question", F.lit(""))).withColumn("answer", F.concat_ws("\n\n", F.when(F.size("parts") > 0, F.array_join("parts", "\n\n")), called))
    turns = turns.withColumn("text", _strip(F.concat("question", F.lit("\n\n"), "answer"))).where(F.length("text") >= LEAST_CHARS)
    ordinal = F.row_number().over(Window.partitionBy("file").orderBy("turn", F.desc("compact"))) - 1
    return turns.select("file", ordinal.alias("ordinal"), "question", "answer", "text", "at")


# ---------------------------------------------------------------- the second agent's logs


def session_meta(lines: DataFrame) -> DataFrame:
    """file, id, cwd, subagent of each log whose first line describes a session."""
    first = lines.groupBy("file").agg(F.min_by("value", "line").alias("value")).select("file", F.try_parse_json("value").alias("v"))
    meta = first.where(_get(F.col("v"), "$.type") == "session_meta")
    sub = F.try_variant_get("v", "$.payload.source.subagent", "variant").isNotNull()
    return meta.select("file", _get(F.col("v"), "$.payload.id").alias("id"), _get(F.col("v"), "$.payload.cwd").alias("cwd"), sub.alias("subagent"))


def sessions_below(lines: DataFrame, root: str) -> DataFrame:
    """file of the logs whose recorded folder is root or below it; an agent's talk with itself is left out."""
    at = F.regexp_replace("cwd", "/+$", "")
    base = root.rstrip("/")
    return session_meta(lines).where(~F.col("subagent") & ((at == base) | F.startswith(at, F.lit(base + "/")))).select("file")


def recorded_folder(lines: DataFrame, most: int = 201) -> DataFrame:
    """file, cwd: the first folder recorded among a log's first lines."""
    near = lines.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("line"))).where(F.col("_n") <= most)
    said = near.select("file", "_n", F.nullif(_get(F.try_parse_json("value"), "$.cwd"), F.lit("")).alias("cwd")).where("cwd IS NOT NULL")
    return said.groupBy("file").agg(F.min_by("cwd", "_n").alias("cwd"))


def last_compaction(lines: DataFrame) -> DataFrame:
    """file, at: the last time that a log says its session was compacted."""
    v = F.try_parse_json("value")
    marked = lines.where(F.instr("value", "compact_boundary") > 0).select("file", v.alias("v")).where(_get(F.col("v"), "$.subtype") == "compact_boundary")
    at = F.unix_micros(F.try_to_timestamp(_get(F.col("v"), "$.timestamp"))) / 1e6
    return marked.groupBy("file").agg(F.max(at).alias("at")).where("at IS NOT NULL")


def rollout_atoms(lines: DataFrame, tags: tuple[str, ...] = ("system-reminder",)) -> DataFrame:
    """file, ordinal, question, answer, text, at of each turn of the second agent's logs; lines as for turn_atoms.

    User and agent messages are events, tool calls response items; a call's line names its
    command, path or query, else all its arguments.
    """
    one = lines.select("file", "line", "modified", F.try_parse_json("value").alias("v"))
    one = one.withColumns({"kind": _get(F.col("v"), "$.type"), "what": _get(F.col("v"), "$.payload.type"), "said": _get(F.col("v"), "$.payload.message")})
    asked = (F.col("kind") == "event_msg") & (F.col("what") == "user_message")
    told = (F.col("kind") == "event_msg") & (F.col("what") == "agent_message")
    called = (F.col("kind") == "response_item") & F.col("what").isin("function_call", "custom_tool_call")
    args = F.coalesce(F.nullif(_get(F.col("v"), "$.payload.arguments"), F.lit("")), _get(F.col("v"), "$.payload.input"), F.lit(""))
    given = F.try_parse_json(args)
    field = lambda name: F.coalesce(F.array_join(F.try_variant_get(given, f"$.{name}", "array<string>"), " "), F.nullif(_get(given, f"$.{name}"), F.lit("")))
    said = _strip(F.regexp_replace(F.coalesce(field("command"), field("path"), field("query"), args), r"\s+", " "))
    line = F.concat(F.lit("["), F.coalesce(_get(F.col("v"), "$.payload.name"), F.lit("?")), F.lit("] "), F.when(F.length(said) <= 200, said).otherwise(F.concat(F.left(said, F.lit(200)), F.lit("…"))))
    none = F.array().cast("array<string>")
    rows = one.where(asked | told | called).select(
        "file", "line", "modified", F.lit(False).alias("compact"),
        F.when(asked, clean_user(F.col("said"), tags)).alias("question"),
        F.coalesce(F.when(told & (_strip(F.col("said")) != ""), F.array(_strip(F.col("said")))), none).alias("parts"),
        F.coalesce(F.when(called, F.array(line)), none).alias("tools"),
        (F.unix_micros(F.try_to_timestamp(_get(F.col("v"), "$.timestamp"))) / 1e6).alias("at"),
    )
    return _assembled(rows)
