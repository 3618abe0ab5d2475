"""Versioned cards of code symbols: a table of intervals that one merge a batch of files closes and opens.

A card row has qn, version (from 1), file, signature, body (hashes), facts (JSON of all else),
since, until (null while it is the active one) and ended (supersedes, continues or removed).
A reference has file, ref (unique within the file), name, kind and target, the name it was
last resolved to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.lineage import cut_lineage
from sparkloom.operators.selection import first_per
from sparkloom.sources.store import Store

CARD = "qn string, version long, file string, signature string, body string, facts string, since double, until double, ended string"
REFERENCE = "file string, ref long, name string, kind string, target string"


def short_name(qn: Column) -> Column:
    """The last part of a name with dots or colons."""
    return F.element_at(F.split(qn, r"[.:]+"), -1)


def merge_cards(store: Store, files: DataFrame, fresh: DataFrame, at: float) -> DataFrame:
    """Bring the cards of a batch of files (file) up to date with what they have now; qn, change, version, before.

    fresh: qn, file, signature, body, facts of every symbol of those files. A symbol that is
    new opens version 1; another signature supersedes the active card and another body, or
    another file, continues it, each closing the old interval and opening a new one; a
    symbol that none of the files has any more is removed, which closes its interval, and
    opens the next version if it ever comes back. Unchanged symbols (change 'none') aren't
    written. Of rows that repeat a qn the last by file counts. Files that couldn't be read
    must not be in `files`, so that their cards stay. The same batch merged again changes
    nothing. Only the buckets of the batch's names and files are read and rewritten.
    """
    files = files.select("file").where("file IS NOT NULL").distinct()
    fresh = first_per(fresh.where("qn IS NOT NULL"), ["qn"], [F.desc("file"), F.col("body")])
    fresh = cut_lineage(fresh.select("qn", "file", "signature", "body", "facts"))
    listed = store.rows("card_files", keys=files, empty="file string, qn string").join(files, "file", "left_semi")
    names = cut_lineage(listed.select("qn").union(fresh.select("qn")).distinct())
    old = cut_lineage(store.rows("cards", keys=names, empty=CARD).join(names, "qn", "left_semi"))
    last = old.groupBy("qn").agg(F.max("version").alias("last"))
    active = old.where("until IS NULL").join(files.withColumn("_read", F.lit(True)), "file", "left")
    a, f = active.alias("a"), fresh.alias("f")
    both = a.join(f, F.col("a.qn") == F.col("f.qn"), "full_outer").select(
        F.coalesce("f.qn", "a.qn").alias("qn"), F.col("a.version").alias("before"), F.col("a._read").alias("read"),
        *(F.col(f"f.{c}").alias(c) for c in ("file", "signature", "body", "facts")), F.col("f.qn").isNotNull().alias("there"),
        (~F.col("a.signature").eqNullSafe(F.col("f.signature"))).alias("_signature"), (~F.col("a.body").eqNullSafe(F.col("f.body")) | ~F.col("a.file").eqNullSafe(F.col("f.file"))).alias("_body"),
    )
    change = F.when(~F.col("there"), F.when(F.col("read"), "removed")).when(F.col("before").isNull(), "new").when(F.col("_signature"), "supersedes").when(F.col("_body"), "continues").otherwise("none")
    decided = both.withColumn("change", change).where("change IS NOT NULL").join(last, "qn", "left")
    opens = F.col("change").isin("new", "supersedes", "continues")
    decided = cut_lineage(decided.withColumn("version", F.when(opens, F.coalesce("last", F.lit(0)) + 1)))
    touched = decided.where("change <> 'none'").select("qn", F.col("change").alias("_change"), F.col("before").alias("_before"))
    ended = F.when(F.col("version") == F.col("_before"), F.when(F.col("_change") != "new", F.col("_change")))
    kept = old.join(touched, "qn").withColumns({"until": F.when(ended.isNotNull(), F.lit(at)).otherwise(F.col("until")), "ended": F.coalesce(ended, "ended")}).drop("_change", "_before")
    opened = decided.where(opens).select("qn", "version", "file", "signature", "body", "facts", F.lit(at).alias("since"), F.lit(None).cast("double").alias("until"), F.lit(None).cast("string").alias("ended"))
    store.put("cards", ["qn"], kept.select(opened.columns).unionByName(opened), whole=True)
    store.put("card_files", ["file"], files.join(fresh.select("file", "qn"), "file", "left"), whole=True)
    return decided.select("qn", "change", "version", "before")


def active_cards(store: Store) -> DataFrame:
    """The card that each symbol has now."""
    return store.rows("cards", where="until IS NULL", empty=CARD)


def cards_at(store: Store, at: float) -> DataFrame:
    """The cards as they were at a time."""
    return store.rows("cards", empty=CARD).where((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at)))


def version_edges(store: Store) -> DataFrame:
    """src, src_version, dst_version, kind, at: each version that supersedes or continues the one before it."""
    order = Window.partitionBy("qn").orderBy("version")
    rows = store.rows("cards", empty=CARD).withColumns({"_ended": F.lag("ended").over(order), "_before": F.lag("version").over(order)})
    return rows.where(F.col("_ended").isin("supersedes", "continues")).select(F.col("qn").alias("src"), F.col("version").alias("src_version"), F.col("_before").alias("dst_version"), F.col("_ended").alias("kind"), F.col("since").alias("at"))


def merge_references(store: Store, files: DataFrame, fresh: DataFrame, changes: DataFrame) -> int:
    """Put the references (file, ref, name, kind) of a batch of files and resolve again what the batch may have changed; how many were looked up.

    That are the batch's own references and all stored ones whose last part is the last part
    of a symbol that came or went (changes, as merge_cards gives them). A name means the one
    active card of that full name, else the card of the same file with its last part, else
    the only card with it; else nothing. Ties within a file go to the smaller name.
    """
    files = files.select("file").where("file IS NOT NULL").distinct()
    came = changes.where(F.col("change").isin("new", "removed")).select(short_name(F.col("qn")).alias("short")).distinct()
    stored = store.rows("card_references", empty=REFERENCE).join(files, "file", "left_anti")
    again = stored.withColumn("short", short_name(F.col("name"))).join(came, "short", "left_semi").drop("short", "target")
    asked = cut_lineage(fresh.join(files, "file", "left_semi").select("file", "ref", "name", "kind").unionByName(again.select("file", "ref", "name", "kind")))
    shorts = asked.select("file", "ref", "name", short_name(F.col("name")).alias("short"))
    known = active_cards(store).select("qn", F.col("file").alias("at_file"), short_name(F.col("qn")).alias("short"))
    # a short name that very many symbols bear is counted, not listed, for each reference
    full = shorts.join(known.select(F.col("qn").alias("name"), F.lit(True).alias("full")).distinct(), "name").select("file", "ref", F.col("name").alias("full"))
    near = shorts.join(known.groupBy("short", F.col("at_file").alias("file")).agg(F.min("qn").alias("near")), ["short", "file"]).select("file", "ref", "near")
    only = shorts.join(known.groupBy("short").agg(F.min("qn").alias("only"), F.count("*").alias("n")).where("n = 1"), "short").select("file", "ref", "only")
    found = asked.join(full, ["file", "ref"], "left").join(near, ["file", "ref"], "left").join(only, ["file", "ref"], "left")
    resolved = found.select("file", "ref", "name", "kind", F.coalesce("full", "near", "only").alias("target"))
    others = stored.join(asked.select("file").distinct(), "file", "left_semi").join(asked.select("file", "ref"), ["file", "ref"], "left_anti")
    gone = files.join(fresh.select("file").distinct(), "file", "left_anti")
    if store.exists("card_references"):
        store.delete_matching("card_references", gone)
    store.put("card_references", ["file"], resolved.unionByName(others.select(resolved.columns)), whole=True)
    return asked.count()


# ---------------------------------------------------------------- slim cards

#: Values that say nothing.
EMPTY = ("null", '""', "[]", "{}", '"Unknown"')
NOT_FILLED = "not filled in"


def _filled(fragment: Column) -> Column:
    return F.when(~F.coalesce(fragment, F.lit("null")).isin(*EMPTY), fragment)


def slim_cards(cards: DataFrame, keep: list[str], facts: str = "facts", layers: tuple[str, str] = ("layer_1", "layer_2"), provenance: bool = False) -> DataFrame:
    """cards with `slim`, a Variant of what their Variant column says: the fields of keep that aren't empty, and two layers.

    Fields can be anything and differ from card to card, so nothing of their types is
    assumed; keep names paths below the card. Of the first layer (what analysis found) all
    but empty fields and false stay; of the second (what was interpreted; fields are values
    or objects with `value`) the values that aren't empty, or one remark if there are none.
    With provenance the second layer and <first layer>_provenance stay whole below
    `provenance`. A null card is null; repeated and null fields need no care.
    """
    v = F.col(facts)
    fragment = lambda path: F.to_json(F.try_variant_get(v, path, "variant"))
    name = lambda n: F.to_json(F.array(F.lit(n)))
    quoted = lambda n: F.regexp_replace(name(n), r"^\[|\]$", "")
    pair = lambda n, x: F.when(x.isNotNull(), F.concat(quoted(n), F.lit(":"), x))
    join = lambda xs: F.concat(F.lit("{"), F.array_join(xs, ","), F.lit("}"))
    fields = F.array_compact(F.array(*(pair(k, _filled(fragment(f"$.{k}"))) for k in keep)))
    members = lambda layer: F.map_entries(F.from_json(fragment(f"$.{layer}"), "map<string,variant>"))
    key = lambda e: F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", "")

    def layer(which: str, value, drop_false: bool) -> Column:
        kept = F.transform(members(which), lambda e: F.struct(key(e).alias("k"), value(e["value"]).alias("x")))
        fine = lambda e: ~F.coalesce(e["x"], F.lit("null")).isin(*EMPTY, *(("false",) if drop_false else ()))
        return F.transform(F.filter(kept, fine), lambda e: F.concat(e["k"], F.lit(":"), e["x"]))

    first = layer(layers[0], lambda x: F.to_json(x), True)
    # a field of the second layer is an object with `value`, or the value itself
    inner = lambda x: F.when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.to_json(F.try_variant_get(x, "$.value", "variant"))).otherwise(F.to_json(x))
    second = layer(layers[1], inner, False)
    parts = [fields, F.when(F.size(first) > 0, F.array(F.concat(quoted(layers[0]), F.lit(":"), join(first))))]
    parts += [F.array(F.concat(quoted(layers[1]), F.lit(":"), F.when(F.size(second) > 0, join(second)).otherwise(F.lit(f'"{NOT_FILLED}"'))))]
    if provenance:
        whole = F.array_compact(F.array(*(pair(n, fragment(f"$.{n}")) for n in (f"{layers[0]}_provenance", layers[1]))))
        parts.append(F.when(F.size(whole) > 0, F.array(F.concat(F.lit('"provenance":'), join(whole)))))
    text = join(F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))))
    return cards.withColumn("slim", F.when(v.isNotNull(), F.parse_json(text)))
