"""Column functions over what texts say of files, tools and turns; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tools whose calls name a file, the opening of a mark in a text, and the harness's own openings.
TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit", "Read")
EDITS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
MARK = "[инструмент "
AUTOMATED = ("<local-command", "<command-", "Caveat:", "<task-notification", "<system-reminder", "[SYSTEM NOTIFICATION", "<bash-", "<user-memory")
_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def mark_line(line: Column) -> Column:
    """'[Edit] path', also behind 'Tools: ', as a mark; any other line as it is."""
    return F.regexp_replace(line, rf"^(Tools: )?\[({'|'.join(TOOLS)})\]\s*(\S|\S.*\S)\s*$", f"$1{MARK.replace('[', chr(92) + '[')}$2: $3]")


def mark_text(text: Column) -> Column:
    """Every line through mark_line; the number of lines stays."""
    return F.array_join(F.transform(F.split(text, "\n"), mark_line), "\n")


def tool_paths(text: Column, kinds: tuple[str, ...]) -> Column:
    """Paths of the marks of these kinds, in the text's order, trimmed, empty ones left out."""
    bodies = F.regexp_extract_all(text, F.lit(r"\[инструмент ([^\]]*)\]"), F.lit(1))
    wanted = F.filter(bodies, lambda b: F.substring_index(b, ":", 1).isin(*kinds) & b.contains(":"))
    return F.filter(F.transform(wanted, lambda b: F.regexp_replace(F.regexp_replace(b, r"(?s)^[^:]*:", ""), _ENDS, "")), lambda p: p != "")


def word_paths(text: Column) -> Column:
    """Words of letters, digits and _ . / - ~ backslash that end in a dot and an extension, in the text's order."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_./~\\-]+"), F.lit(0))
    return F.filter(F.transform(runs, lambda w: F.regexp_replace(w, r"\.+$", "")), lambda w: w.rlike(r"\.[\p{L}\p{N}]+$"))


def path_suffixes(path: Column) -> Column:
    """Every end of a path from a separator on, longest first; backslashes are separators."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def is_noise(head: Column, automated: tuple[str, ...] = AUTOMATED) -> Column:
    """Does the harness speak: behind one turn prefix the text opens with one of its markers."""
    bare = F.regexp_replace(head, r"^(User: )?(\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}\] )?\s*", "")
    out = F.lit(False)
    for marker in automated:
        out = out | F.startswith(bare, F.lit(marker))
    return out


def turn_time(text: Column, fallback: Column) -> Column:
    """Seconds of 'User: [YYYY-MM-DD HH:MM]' at the start of a text, else the fallback."""
    said = F.regexp_extract(text, r"^User: \[(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\]", 1)
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(F.nullif(said, F.lit("")), F.lit("yyyy-MM-dd HH:mm"))).cast("double"), fallback)


def in_session(file: Column, session_id: Column, transcript: Column) -> Column:
    """Is a file the live session's: the given one, or one whose name has the first 8 characters of its id."""
    name = F.regexp_extract(file, r"[^/]*$", 0)
    return ((transcript != "") & (file == transcript)) | ((session_id != "") & name.contains(F.left(session_id, F.lit(8))))


def session_ok(of_session: Column, turn_at: Column, cut: Column) -> Column:
    """A turn may be shown if it is another session's, or left the window when it was compacted."""
    return ~of_session | ((cut > 0) & (turn_at < cut))


def eligible(question: Column, text: Column, file: Column, at: Column, session_id: Column, transcript: Column, cut: Column) -> Column:
    """No harness noise (by the first 200 characters of the question, else the text) and session_ok."""
    head = F.left(F.coalesce(F.nullif(question, F.lit("")), text), F.lit(200))
    return ~is_noise(head) & session_ok(in_session(file, session_id, transcript), at, cut)
