"""Benchmark decontamination (operator 6) by template canonicalisation, in DataFrame functions alone.

Numbers (with the unit after them) and names become typed placeholders, and a run of
placeholders is one, so a question with other parameters, of other lengths too, has the
same template. A name is a word that no item has in lower case: neither the case nor the
place of a word in the document matters, so copies in capitals, in small letters or with
other line breaks have the template of their item. No two placeholders are neighbours, so
half of each window are fixed words and rows of numbers meet nothing.

Windows of template words are joined by hash; the words in the places of placeholders
are then compared: one value of the item must always stand for one value of the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import body, checkpointed, fresh, hinted, table

#: Words of a window, and words of an item that a document must hold (all of a shorter item).
WINDOW, LEAST_WORDS = 8, 13
#: A match of fewer fixed words than asked counts only if its slots are consistent, and of fewer than this never.
LEAST_FIXED = 6
#: Items with fewer fixed words than this are searched for word by word, and of so few words only as whole documents.
LITERAL_BELOW, WHOLE_BELOW = 4, 4
#: Words by which a passage may shift inside an item (inserted and dropped words) and still count as one.
DRIFT = 8
#: Windows that stand in items more often than this are joined last where they cannot find an item alone; no result depends on it.
COMMON = 256
#: Items' windows are broadcast, and their words written into the plan, up to these numbers (about 25 MB and 1 MB); beyond, both are joined by shuffles.
BROADCAST_WINDOWS, PLAN_WORDS = 100_000, 50_000
#: Units that belong to the number before them.
UNITS = "km|cm|mm|m|kg|mg|g|lb|lbs|oz|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|ft|inches|dollars?|euros?|usd|eur|percent|degrees?|mph|kph"
#: Marks before a word that is a placeholder, and what is above all of them.
NAME, NUMBER, UNIT, FIXED = "\x01", "\x02", "\x03", "\x04"
#: Kinds of windows: template words, plain words, and whole documents.
TEMPLATE, LITERAL, WHOLE = 0, 1, 2


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; numbers and units carry their mark."""
    text = F.regexp_replace(text, "[\x01-\x03]", " ")
    # Patterns without repeated groups: those recurse, and a long row of numbers would exhaust the stack.
    numbers = F.regexp_replace(text, r"(?<=\p{N})[.,](?=\p{N})", "")
    numbers = F.regexp_replace(numbers, r"(?<![\p{L}\p{N}])(?=\p{N})", NUMBER)
    numbers = F.regexp_replace(numbers, rf"(?i)(?<=\p{{N}}\s?)(?<![\p{{L}}])(?=(?:{UNITS})\b)", " " + UNIT)
    text = F.lower(F.when(text.rlike(r"\p{N}"), numbers).otherwise(text))
    return F.filter(F.split(text, "[^\\p{L}\\p{N}\x01-\x03]+"), lambda w: w != "")


def _is_fixed(word: Column) -> Column:
    return word >= FIXED


def _folded(marked: str) -> Column:
    """One word for each run of placeholders: its first, with the mark twice if the run is longer than three (no name is)."""

    def slot(at: Column) -> Column:
        return F.coalesce(F.get(marked, at) < FIXED, F.lit(False))

    kept = F.transform(
        marked,
        lambda w, i: F.when(_is_fixed(w), w).when(~slot(i - 1), F.when(slot(i + 1) & slot(i + 2) & slot(i + 3), F.concat(F.substring(w, 1, 1), w)).otherwise(w)),
    )
    return F.array_compact(kept)


def _template(word: Column) -> Column:
    """The word, or the marks of a placeholder."""
    return F.when(_is_fixed(word), word).when(F.substring(word, 2, 1) < FIXED, F.substring(word, 1, 2)).otherwise(F.substring(word, 1, 1))


def vocabulary(benchmark: DataFrame) -> DataFrame:
    """(word): words of items that begin with no capital somewhere; all others are names."""
    plain = F.filter(F.split(body(), r"[^\p{L}\p{N}]+"), lambda w: w.rlike(r"^\p{L}") & ~w.rlike(r"^[\p{Lu}\p{Lt}]"))
    return benchmark.select(F.explode(F.array_distinct(F.transform(plain, F.lower))).alias("word")).distinct()


def _marked(rows: DataFrame, keys: list[str], known: DataFrame, in_plan: list[str] | None) -> DataFrame:
    """keys and marked: the words of each row's text, names marked, too. ``keys`` name a text: rows that share them have the same."""
    rows = rows.select(*keys, words_of(F.col("text")).alias("words"))
    if in_plan is not None:
        name = lambda w: F.when((w < FIXED) | w.isin(in_plan), w).otherwise(F.concat(F.lit(NAME), w))
        return rows.select(*keys, F.transform("words", name).alias("marked"))
    each = rows.select(*keys, F.posexplode_outer("words").alias("at", "word")).join(known.select("word", F.lit(True).alias("known")), "word", "left")
    word = F.when((F.col("word") < FIXED) | F.col("known"), F.col("word")).otherwise(F.concat(F.lit(NAME), "word"))
    # A set: rows that repeat a key say each of their words again.
    gathered = each.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", word.alias("w"))))).alias("m"))
    return gathered.select(*keys, F.col("m.w").alias("marked"))


def _pairs(h: str, by: int) -> Column:
    """Hash of each element with the one ``by`` places on."""
    n = F.greatest(F.size(h) - by, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, by + 1, n), lambda a, b: F.xxhash64(a, b))


def _hashed(rows: DataFrame, keys: list[str], kind: int) -> DataFrame:
    """keys, words and h1, h2, h4, h8: hashes of that many words at each place.

    Each is built from halves, so each word is hashed once, and each step is a column of its
    own: an expression that the next one names twice must not be written into it twice.
    """
    shown = _folded("marked") if kind == TEMPLATE else F.transform("marked", lambda w: F.when(_is_fixed(w), w).otherwise(F.substring(w, 2, 1 << 30)))
    rows = rows.select(*keys, shown.alias("words"))
    rows = rows.select(*keys, "words", F.transform("words", lambda w: F.xxhash64(_template(w) if kind == TEMPLATE else w, F.lit(kind))).alias("h1"))
    rows = rows.select(*keys, "words", "h1", _pairs("h1", 1).alias("h2"))
    rows = rows.select(*keys, "words", "h1", "h2", _pairs("h2", 2).alias("h4"))
    return rows.select(*keys, "words", "h1", "h2", "h4", _pairs("h4", 4).alias("h8"))


def _window(length: int) -> Column:
    """Hashes of ``length`` words at each place, of the columns of _hashed()."""
    if length == WINDOW:
        return F.col("h8")
    found, done = None, 0
    count = F.greatest(F.size("h1") - length + 1, F.lit(0))
    for n in (4, 2, 1):
        if length & n:
            part = F.slice(f"h{n}", F.lit(done + 1), count)
            found = F.transform(part, lambda h: F.xxhash64(h, F.lit(length))) if found is None else F.zip_with(found, part, lambda a, b: F.xxhash64(a, b))
            done += n
    return found


def _windows(rows: DataFrame, keys: list[str], kind: int, lengths: list[int]) -> DataFrame:
    """keys, words, at and window of the windows of ``lengths`` words (as _marked)."""
    rows = _hashed(rows, keys, kind)
    if lengths == [WINDOW]:
        # Not posexplode(): from it Spark infers a filter size(h) > 0, pushes that to the scan and evaluates all of the above in it, many times.
        return rows.select(*keys, "words", F.posexplode_outer("h8").alias("at", "window")).filter(F.col("window").isNotNull())
    named = F.flatten(F.array(*(F.transform(_window(n), lambda h, i: F.struct(i.alias("at"), h.alias("h"))) for n in lengths)))
    return rows.select(*keys, "words", F.explode_outer(named).alias("w")).select(*keys, "words", F.col("w.at").alias("at"), F.col("w.h").alias("window")).filter(F.col("window").isNotNull())


def _whole(words: str) -> Column:
    return F.xxhash64(F.lit("whole"), words)


def _items(benchmark: DataFrame, known: DataFrame, in_plan: list[str] | None) -> DataFrame:
    """(item_id, class, kind, words) of each item with words; items that ask for the same are one class.

    Of a template the values of placeholders do not matter, only which of them are equal.
    """
    marked = _marked(benchmark.select("item_id", F.xxhash64(body()).alias("ih"), body().alias("text")), ["item_id", "ih"], known, in_plan)
    plain = F.transform("marked", lambda w: F.when(_is_fixed(w), w).otherwise(F.substring(w, 2, 1 << 30)))
    rows = marked.select("item_id", _folded("marked").alias("folded"), plain.alias("plain"))
    kind = F.when(F.size(F.filter("folded", _is_fixed)) >= LITERAL_BELOW, TEMPLATE).when(F.size("plain") >= WHOLE_BELOW, LITERAL).when(F.size("plain") > 0, WHOLE)
    rows = rows.select("item_id", kind.alias("kind"), "folded", "plain").filter("kind is not null")
    # A placeholder's value becomes the place of its first like.
    asked = F.when(F.col("kind") == TEMPLATE, F.transform("folded", lambda w: F.when(_is_fixed(w), w).otherwise(F.concat(_template(w), F.array_position("folded", w).cast("string"))))).otherwise(F.col("plain"))
    return rows.select("item_id", "kind", asked.alias("words")).withColumn("class", F.xxhash64("kind", "words")).distinct()


def _asked_windows(items: DataFrame, kind: int, lengths: list[int]) -> DataFrame:
    """(class, window, item_at, length, asked, whole, whole_fixed, late) of the classes of ``kind``.

    whole and whole_fixed are the words, and fixed ones, of the class. late marks windows that
    stand in more than COMMON places, of a class whose windows of that sort cover too few words
    to find it: they count only where a document holds a rarer window of the class.
    """
    classes = items.filter(F.col("kind") == kind).dropDuplicates(["class"]).select("class", F.col("words").alias("marked"))
    rows = _hashed(classes, ["class"], kind)
    length = F.least(F.size("words"), F.lit(WINDOW))
    window = F.lit(None).cast("array<bigint>")
    for n in lengths:
        window = F.when(length == n, _window(n)).otherwise(window)
    each = rows.select("class", "words", length.alias("length"), window.alias("windows")).select("class", "words", "length", F.posexplode("windows").alias("item_at", "window"))
    spread = each.groupBy("window").agg(F.count(F.lit(1)).alias("spread"))
    each = each.join(spread, "window")
    each = each.withColumn("common", F.collect_set(F.when(F.col("spread") > COMMON, F.col("item_at"))).over(Window.partitionBy("class")))
    covered = F.filter("words", lambda w, i: F.exists("common", lambda at: (at <= i) & (i < at + F.col("length"))))
    late = (F.col("spread") > COMMON) & (F.size(covered) < F.least(F.lit(LEAST_WORDS), F.size("words")))
    asked = F.slice("words", F.col("item_at") + 1, F.col("length"))
    return each.select("class", "window", "item_at", "length", asked.alias("asked"), F.size("words").alias("whole"), F.size(F.filter("words", _is_fixed)).alias("whole_fixed"), late.alias("late"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, n_words, n_fixed, consistent): items of ``benchmark`` (item_id, text) that stand in ``docs`` (doc_id, text).

    th is a hash of the document's text, for rows that repeat a doc_id. A document holds an
    item if windows of one passage (words may be inserted or dropped) cover LEAST_WORDS words
    of its template or the whole of a shorter one. Items of fewer than WINDOW words are
    searched for by their own length, those with hardly a fixed word as plain words, and those
    of fewer than WHOLE_BELOW words only as whole documents. All windows count, however many
    items share them. Null texts are empty and hold
    nothing, and an empty benchmark finds nothing. Rows may repeat; other columns are not read.
    """
    known = vocabulary(benchmark)
    some = [r["word"] for r in known.limit(PLAN_WORDS + 1).collect()]
    in_plan = sorted(some) if len(some) <= PLAN_WORDS else None
    items = checkpointed(_items(benchmark, known, in_plan))
    sizes = items.select("kind", F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct().collect()  # two dozen at most
    lengths = {k: sorted({r["n"] for r in sizes if r["kind"] == k}, reverse=True) for k in (TEMPLATE, LITERAL, WHOLE)}
    doc_id = F.col("doc_id").cast("long")
    keys = ["doc_id", "th"]
    marked = _marked(docs.select(doc_id.alias("doc_id"), F.xxhash64(body()).alias("th"), body().alias("text")), keys, known, in_plan)
    found = [_found(marked, items, kind, lengths[kind]) for kind in (TEMPLATE, LITERAL) if lengths[kind]]
    if lengths[WHOLE]:
        plain = F.transform("marked", lambda w: F.when(_is_fixed(w), w).otherwise(F.substring(w, 2, 1 << 30)))
        asked = items.filter(F.col("kind") == WHOLE).select("class", _whole("words").alias("window")).distinct()
        short = marked.filter(F.size("marked") < WHOLE_BELOW).select(*keys, plain.alias("words")).select(*keys, _whole("words").alias("window"), F.size("words").cast("long").alias("n_words"))
        found.append(short.join(asked, "window").select(*keys, "class", "n_words", F.col("n_words").alias("n_fixed"), F.lit(True).alias("consistent")).distinct())
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, th long, item_id long, n_words long, n_fixed long, consistent boolean")
    members = items.select("class", "item_id")
    return reduce(DataFrame.unionByName, found).join(members, "class").select("doc_id", "th", "item_id", "n_words", "n_fixed", "consistent")


def _found(marked: DataFrame, items: DataFrame, kind: int, lengths: list[int]) -> DataFrame:
    """(doc_id, th, class, n_words, n_fixed, consistent) of the classes of one kind that documents hold."""
    asked = checkpointed(_asked_windows(items, kind, lengths))

    keys = ["doc_id", "th"]
    texts = _windows(marked, keys, kind, lengths)
    said = lambda length: F.slice("words", F.col("at") + 1, length)
    met_columns = [*keys, "class", "whole", "whole_fixed", "item_at", "at", "asked", "said"]

    def joined(asked: DataFrame) -> DataFrame:
        if asked.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
            return texts.join(F.broadcast(asked), "window").withColumn("said", said(F.col("length"))).select(met_columns)
        met = texts.select(*keys, "window", "at", said(WINDOW).alias("said")).join(asked, "window")
        return met.withColumn("said", F.slice("said", F.lit(1), F.col("length"))).select(met_columns)

    met = joined(asked.filter(~F.col("late")))
    late = asked.filter("late")
    if not late.isEmpty():
        # A class that is found holds a word that no late window covers, so a window that is not late.
        met = checkpointed(met)
        where = met.select(*keys, "class").distinct().join(late, "class").withColumnsRenamed({"doc_id": "id", "th": "hash", "window": "wanted"})
        own = texts.select(*keys, "window", "at", said(WINDOW).alias("said")).join(late.select("window").distinct(), "window", "left_semi")
        same = (F.col("window") == F.col("wanted")) & (F.col("th") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))
        met = met.unionByName(own.join(where, same).withColumn("said", F.slice("said", F.lit(1), F.col("length"))).select(met_columns))
    # A passage's windows have neighbouring shifts: each is counted in two bands of shifts, one of which holds it whole.
    shift = F.col("at") - F.col("item_at")
    bands = F.array(*(F.floor((shift + o * DRIFT) / (2 * DRIFT)) * 2 + o for o in (0, 1)))
    place = [*keys, "class", "whole", "whole_fixed", "band"]
    each = met.select(*keys, "class", "whole", "whole_fixed", F.explode(bands).alias("band"), "item_at", "asked", "said")
    each = each.select(*place, "item_at", F.posexplode(F.arrays_zip("asked", "said")).alias("n", "w"))
    each = each.groupBy(*place, (F.col("item_at") + F.col("n")).alias("word"), F.col("w.asked").alias("asked")).agg(F.min("w.said").alias("low"), F.max("w.said").alias("high"))
    # Values of one placeholder: all words of the document that stand for one word of the item.
    values = each.withColumn("slot", ~_is_fixed(F.col("asked"))).groupBy(*place, "asked", "slot").agg(F.count(F.lit(1)).alias("n"), (F.min("low") == F.max("high")).alias("one"))
    runs = values.groupBy(*place).agg(
        F.sum("n").alias("n_words"), F.coalesce(F.sum(F.when(~F.col("slot"), F.col("n"))), F.lit(0)).alias("n_fixed"), F.bool_and(F.col("one") | ~F.col("slot")).alias("consistent")
    )
    enough = F.least(F.lit(LEAST_WORDS), "whole")
    sure = (F.col("n_words") >= enough) & ((F.col("n_fixed") >= enough) | F.col("consistent") & (F.col("n_fixed") >= F.least(F.lit(LEAST_FIXED), "whole_fixed")))
    return runs.filter(sure).groupBy(*keys, "class").agg(F.max("n_words").alias("n_words"), F.max("n_fixed").alias("n_fixed"), F.bool_or("consistent").alias("consistent"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns (a pipeline stage); rules as in leaks()."""
    id_, hash_ = fresh(docs, "id"), fresh(docs, "th")
    bad = checkpointed(leaks(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("th").alias(hash_)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(body()) == F.col(hash_))
    return docs.join(hinted(bad), same, "left_anti")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_fixed", "consistent")
