"""Cutting texts and chats into atoms: gaps and islands over positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paragraphs(texts: DataFrame, separator: str = r"\n(?:[ \t]*\n)+") -> DataFrame:
    """id, position, text: non-empty trimmed pieces between separators."""
    pieces = F.split(F.regexp_replace("text", r"\r\n?", "\n"), separator)
    trimmed = F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return texts.select("id", F.posexplode(trimmed).alias("position", "text"))


def merge_short(blocks: DataFrame, least: int = 10, joined: str = "\n\n") -> DataFrame:
    """Runs of short blocks become one block, placed before the next long one."""
    w = Window.partitionBy("id").orderBy("position")
    long_ = F.length("text") >= least
    turn = F.when(long_ | F.coalesce(F.lag(long_).over(w), F.lit(True)), 1).otherwise(0)
    runs = blocks.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(w))
    whole = runs.groupBy("id", "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda p: p["text"]), joined).alias("text"))
    return whole.select("id", (F.col("_run") - 1).alias("position"), "text")


# How a speaker's label opens a block.
ASKS = r"(?iu)^[#>*\s]{0,6}(you said|user|human|question|q|ты|вы сказали|пользователь|вопрос)\s*:"
ANSWERS = r"(?iu)^[#>*\s]{0,6}(chatgpt said|claude said|assistant|ai|bot|chatgpt|gpt|claude|answer|a|ассистент|клод|ответ)\s*:"


def _sides(paired: DataFrame, keys: list[str], order: str) -> DataFrame:
    side = lambda r: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct(order, "text")))), lambda p: p["text"]), "\n\n")
    return paired.groupBy(*keys, "pair").agg(side("user").alias("question"), side("assistant").alias("answer"))


def _paired(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """turns plus pair: a user turn opens a pair once the open one has both sides."""
    w = Window.partitionBy(*keys).orderBy(order)
    is_user = F.col("role") == "user"
    last, first = F.lag("role").over(w), F.first("role").over(w)
    users = F.coalesce(F.sum(F.when(is_user, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a pair that starts with an assistant turn has both sides from its first user turn on
    opens = F.when(is_user & (((last == "assistant") & (users > 0)) | ((first == "assistant") & (users == 1))), 1).otherwise(0)
    return turns.withColumn("_open", opens).withColumn("pair", F.sum("_open").over(w)).drop("_open")


def question_answers(turns: DataFrame) -> DataFrame:
    """conv_id, pair, question, answer: a user turn opens a pair once the open one has both sides.

    Roles other than user and assistant are skipped; several turns of one side are joined
    by an empty line.
    """
    kept = turns.where(F.col("role").isin("user", "assistant"))
    return _sides(_paired(kept, ["conv_id"], "turn"), ["conv_id"], "turn")


def labelled(blocks: DataFrame) -> DataFrame:
    """blocks (id, position, text) plus label: q, a or null by the speaker's label that opens them."""
    return blocks.withColumn("label", F.when(F.col("text").rlike(ASKS), "q").when(F.col("text").rlike(ANSWERS), "a"))


def grouped_by_labels(blocks: DataFrame) -> DataFrame:
    """id, pair, question, answer of labelled blocks: one without a label goes on with the side before it, the question's at first.

    Only a block with the question's label closes a pair.
    """
    w = Window.partitionBy("id").orderBy("position")
    side = F.coalesce(F.last("label", ignorenulls=True).over(w), F.lit("q"))
    sided = blocks.withColumn("_side", side)
    answers = F.sum(F.when(F.col("_side") == "a", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    asked = F.sum(F.when(F.col("_side") == "q", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last = F.lag("_side").over(w)
    # a pair that opens with answers has both sides only once a question follows, as in _paired
    first = F.first("_side").over(w)
    opens = F.when((F.col("label") == "q") & (F.coalesce(answers, F.lit(0)) > 0) & (((last == "a") & (F.coalesce(asked, F.lit(0)) > 0)) | ((first == "a") & (asked == 1))), 1).otherwise(0)
    paired = sided.withColumn("_open", opens).withColumn("pair", F.sum("_open").over(w)).withColumn("role", F.when(F.col("_side") == "q", "user").otherwise("assistant"))
    return _sides(paired, ["id"], "position")


def paired_in_order(blocks: DataFrame) -> DataFrame:
    """id, pair, question, answer: blocks two by two."""
    w = Window.partitionBy("id").orderBy("position")
    i = F.row_number().over(w) - 1
    placed = blocks.withColumn("_i", i).withColumns({"pair": F.expr("_i div 2"), "role": F.when(F.col("_i") % 2 == 0, "user").otherwise("assistant")})
    return _sides(placed, ["id"], "position")


def chat_atoms(blocks: DataFrame, least: int = 10) -> DataFrame:
    """id, pair, question, answer, how: by labels where 30 % of a text's blocks have one and both sides occur, else two by two.

    Pairs of fewer than `least` characters are left out.
    """
    marked = labelled(blocks)
    share = marked.groupBy("id").agg(((F.count("label") / F.count("*") >= 0.3) & (F.count_if(F.col("label") == "q") > 0) & (F.count_if(F.col("label") == "a") > 0)).alias("by_label"))
    known = marked.join(share, "id")
    out = grouped_by_labels(known.where("by_label")).withColumn("how", F.lit("label")).unionByName(paired_in_order(known.where("NOT by_label")).withColumn("how", F.lit("sequential")))
    return out.where(F.length(F.trim(F.concat_ws("\n\n", F.nullif("question", F.lit("")), F.nullif("answer", F.lit(""))))) >= least)


def chain(rows: DataFrame, file: str, order: str, node: str) -> DataFrame:
    """src, dst: each row to the next of its file."""
    nxt = F.lead(node).over(Window.partitionBy(file).orderBy(order, node))
    return rows.select(F.col(node).alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")


def lineage(rows: DataFrame, file: str, order: str, node: str, reach: int = 4) -> DataFrame:
    """node, before, after: up to `reach` neighbours on each side, in order."""
    w = Window.partitionBy(file).orderBy(order, node)
    return rows.select(node, F.collect_list(node).over(w.rowsBetween(-reach, -1)).alias("before"), F.collect_list(node).over(w.rowsBetween(1, reach)).alias("after"))


def project_outline(texts: DataFrame) -> DataFrame:
    """One row, modules, concepts: the first 50 headings (levels 1 and 2) and 100 names in backticks or camel case, sorted.

    Distinct values are found before anything is gathered, so only those lists reach one task.
    """
    lines = F.transform(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    heads = texts.select(F.explode(F.filter(lines, lambda x: x.rlike(r"^#{1,2}\s+.+"))).alias("x")).select(F.regexp_replace("x", r"^#{1,2}\s+", "").alias("x"), F.lit("modules").alias("what"))
    quoted = F.regexp_extract_all("text", F.lit(r"`([a-zA-Z0-9_./-]{3,40})`"), F.lit(1))
    camel = F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-zA-Z0-9]{2,}(?:[A-Z][a-zA-Z0-9]*)+)\b"), F.lit(1))
    words = texts.select(F.explode(F.concat(quoted, camel)).alias("x"), F.lit("concepts").alias("what"))
    top = lambda d, n: d.distinct().orderBy("x").limit(n)
    both = top(heads, 50).unionByName(top(words, 100))
    pick = lambda name: F.array_sort(F.collect_list(F.when(F.col("what") == name, F.col("x")))).alias(name)
    return both.agg(pick("modules"), pick("concepts"))


def structure_texts(files: DataFrame, project: str, most: int = 200) -> DataFrame:
    """top, text: a listing of files (path below the root, length, mtime, kind), one for all up to `most`, else one a top folder."""
    top = F.when(F.instr("path", "/") == 0, F.lit(".")).otherwise(F.substring_index("path", "/", 1))
    entry = F.concat("path", F.lit("  ["), "kind", F.lit(", "), F.replace(F.format_number(F.col("length") / 1024, 1), F.lit(",")), F.lit("KB, "), F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd"), F.lit("]"))
    rows = files.select(F.when(F.lit(files.count() <= most), F.lit("root")).otherwise(top).alias("top"), top.alias("folder"), "path", entry.alias("entry"))
    gathered = rows.groupBy("top").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("folder", "path", "entry"))).alias("e"))
    head = F.concat(F.lit(f"Structure of {project}"), F.when(F.col("top") == "root", F.lit("")).otherwise(F.concat(F.lit(", "), "top")), F.lit(" ("), F.col("n").cast("string"), F.lit(" files):\n"))
    return gathered.select("top", F.concat(head, F.array_join(F.transform("e", lambda x: x["entry"]), "\n")).alias("text"))
