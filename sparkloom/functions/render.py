"""Column functions that write lines for a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import squash


def cut(text: Column, limit: int | Column) -> Column:
    return F.left(text, F.lit(limit) if isinstance(limit, int) else limit)


def clipped(text: Column, limit: Column) -> Column:
    """clip with a limit that is a column."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, limit)), F.lit(" …")))


def note_line(note: Column, limit: int = 200) -> Column:
    return F.concat(F.lit("   ↳ "), cut(squash(note), limit))


def two_places(score: Column) -> Column:
    """A score with two decimals, halves by the binary value, as in C's printf."""
    return F.replace(F.format_number(score, 2), F.lit(","))


def recall_item(index: Column, day: Column, file: Column, score: Column, text: Column, notes: Column, limit: Column, note_limit: int = 200) -> Column:
    """'i. [day · file · 0.00] text', the text squashed and clipped, with a line for each note below."""
    head = F.concat(index.cast("string"), F.lit(". ["), day, F.lit(" · "), file, F.lit(" · "), two_places(score), F.lit("] "))
    return F.array_join(F.concat(F.array(F.concat(head, clipped(squash(text), limit))), F.transform(notes, lambda n: note_line(n, note_limit))), "\n")


def recent_line(day: Column, file: Column, text: Column, limit: int = 160) -> Column:
    return F.concat(F.lit("- ["), day, F.lit(" · "), file, F.lit("] "), cut(squash(text), limit))


def shown(block: Column) -> Column:
    """The largest N such that a block has the lines '1. [' to 'N. [' in a row, in any order of lines."""
    numbers = F.transform(F.regexp_extract_all(block, F.lit(r"\n(\d+)\. \["), F.lit(1)), lambda x: x.try_cast("int"))
    return F.aggregate(F.array_sort(F.array_distinct(numbers)), F.lit(0), lambda n, x: F.when(x == n + 1, x).otherwise(n))


def version_note(later_day: Column, later_text: Column, earlier_day: Column, earlier_text: Column) -> Column:
    """What replaced a card later, else what it replaces; empty if neither is known (null)."""
    say = lambda head, day, text: F.concat(F.lit(head), day, F.lit("): "), cut(text, 160))
    return F.coalesce(say("replaced later (", later_day, later_text), say("replaces an earlier version (", earlier_day, earlier_text), F.lit(""))


def conflict_note(direction: Column, day: Column, text: Column) -> Column:
    """The first contradiction of a card, out or in; empty if there is none (null)."""
    head = F.when(direction == "out", F.lit("contradicts (")).otherwise(F.lit("contradicted by ("))
    return F.coalesce(F.when(direction.isNotNull(), F.concat(head, day, F.lit("): "), cut(text, 200))), F.lit(""))


def notes_of(version: Column, conflict: Column, code: Column) -> Column:
    """Non-empty version and conflict notes, then a line for each code link."""
    return F.concat(F.filter(F.array(version, conflict), lambda n: n != ""), F.transform(code, lambda c: F.concat(F.lit("code: "), c)))
