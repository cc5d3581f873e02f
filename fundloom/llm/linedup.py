"""Removal of repeated line runs, with a suffix array built by distributed prefix doubling.

Every document is a sequence of line ids. Suffixes are ranked by their first
1, 2, 4, ... lines: the rank for twice the length comes from the pair of ranks
at a position and half the length further on. Pairs are aggregated before they
are sorted, and they are sorted over ranges of both ranks, so a line that very
many documents share is neither sorted nor ranked in one task. Suffixes whose
prefix occurs once are dropped at each step: they have no common prefix of that
length with any other.

Suffixes of one rank are an interval of the suffix array whose longest common
prefix has at least that many lines. The interval of a prefix of any length is
named by the ranks of two intervals that cover it, from both ends; those that
are just long enough (in words) are taken from each first line and to each last
line. In an interval every suffix but the first has an earlier copy, the
interval's source. Where neighbouring lines have their prefix from neighbouring
lines of the same source, the prefixes join to one, so a maximal repeated run is
found with the length of its longest common prefix with that source. Later
copies are deleted.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundloom.llm.shared import Scratch, free_name, materialise

#: Words of a repeated run, at least, for its later copies to be deleted.
LEAST_WORDS = 50
LINE = ["doc", "key", "seq"]


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, key, seq, no, words, h1, h2): the lines that aren't blank; seq counts them, no is the number in the text."""
    plain = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("no"), F.trim(line).alias("line")))
    kept = F.filter(numbered, lambda x: x["line"] != "")
    rows = plain.select("doc", _text_key(F.col("text")).alias("key"), F.posexplode(kept).alias("seq", "x"))
    line = F.col("x.line")
    # 128 bits tell lines apart; the second hash starts from another seed.
    return rows.select("doc", "key", "seq", F.col("x.no").alias("no"), F.regexp_count(line, F.lit(r"\S+")).alias("words"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def _ranked(pairs: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """Distinct rows with their place in the order of (a, b), as a number that grows along the order."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = pairs.repartitionByRange(parts, a, b).sortWithinPartitions(a, b)
    return scratch.table(sorted_.withColumn("rank", F.monotonically_increasing_id()), "order")


def suffix_ranks(docs: DataFrame, least_words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(suffixes, ranks): the repeated lines with their words, and (doc, key, seq, level, rank).

    ``rank`` orders the suffixes that begin at a line by their first 2**level
    lines; equal ranks are equal lines. Suffixes whose prefix occurs once are
    left out. Levels end where a run of ``least_words`` words can't be longer.
    """
    lines = scratch.table(_lines(docs), "lines")
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    order = _ranked(repeated, "h1", "h2", scratch)
    # Rows with the same id and text are one document.
    suffixes = scratch.table(lines.join(order, ["h1", "h2"]).select(*LINE, "no", "words", "rank").distinct(), "suffixes")
    # A line has a word, but for those of white space other than spaces.
    longest = least_words
    if suffixes.where("words = 0").take(1):
        longest = max(longest, _windows(suffixes, least_words).agg(F.max("n")).first()[0] or 0)
    now = suffixes.select(*LINE, "rank")
    ranks = now.withColumn("level", F.lit(0))
    level = 0
    while 2 ** (level + 1) <= longest:
        step = 2**level
        ahead = Window.partitionBy("doc", "key").orderBy("seq").rangeBetween(step, step)
        paired = now.withColumnRenamed("rank", "before").withColumn("next", F.first("before").over(ahead))
        pairs = scratch.table(paired.where("next IS NOT NULL"), "pairs")
        again = pairs.groupBy("before", "next").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        order = _ranked(again, "before", "next", scratch)
        now = scratch.table(pairs.join(order, ["before", "next"]).select(*LINE, "rank"), "ranks")
        if not now.take(1):
            break
        level += 1
        ranks = ranks.unionByName(now.withColumn("level", F.lit(level)))
    return suffixes, ranks


def _windows(suffixes: DataFrame, least_words: int) -> DataFrame:
    """(doc, key, first, n): for each line the shortest run from it and to it with ``least_words`` words.

    Runs lie within stretches of repeated lines. ``done`` counts the words of a
    stretch up to a line. Starts and ends are put on one scale of words, where
    the nearest one is a window aggregate.
    """
    doc = Window.partitionBy("doc", "key").orderBy("seq")
    stretch = suffixes.withColumn("stretch", F.col("seq") - F.row_number().over(doc))
    done = F.sum("words").over(Window.partitionBy("doc", "key", "stretch").orderBy("seq"))
    counted = stretch.withColumn("done", done).withColumn("before", F.col("done") - F.col("words"))
    marks = F.array(
        F.struct(F.lit(1).alias("kind"), (F.col("before") + least_words).alias("at")),  # asks for the end of the run from here
        F.struct(F.lit(2).alias("kind"), F.col("done").alias("at")),
        F.struct(F.lit(3).alias("kind"), F.col("before").alias("at")),
        F.struct(F.lit(4).alias("kind"), (F.col("done") - least_words).alias("at")),  # asks for the start of the run to here
    )
    scale = counted.select("doc", "key", "stretch", "seq", F.explode(marks).alias("m")).select("doc", "key", "stretch", "seq", "m.*")
    along = Window.partitionBy("doc", "key", "stretch").orderBy("at", "kind")
    end = F.min(F.when(F.col("kind") == 2, F.col("seq"))).over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    start = F.max(F.when(F.col("kind") == 3, F.col("seq"))).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = scale.withColumn("end", end).withColumn("start", start).where("kind IN (1, 4)")
    first = F.when(F.col("kind") == 1, F.col("seq")).otherwise(F.col("start"))
    last = F.when(F.col("kind") == 1, F.col("end")).otherwise(F.col("seq"))
    return both.select("doc", "key", first.alias("first"), (last - first + 1).alias("n")).where("first IS NOT NULL AND n IS NOT NULL").distinct()


def _later_runs(suffixes: DataFrame, ranks: DataFrame, least_words: int, scratch: Scratch) -> DataFrame:
    """(doc, key, first, last, source, source_key, source_first): the maximal runs that have an earlier copy.

    ``first`` and ``last`` count the lines that aren't blank; ``source_first``
    is the line of the source where the common prefix begins.
    """
    windows = _windows(suffixes, least_words).withColumn("level", F.floor(F.log2("n")).cast("int"))
    windows = windows.withColumn("other", F.col("first") + F.col("n") - F.pow(F.lit(2), F.col("level")).cast("int"))

    def at(column: str, name: str) -> DataFrame:
        return ranks.select("doc", "key", F.col("seq").alias(column), "level", F.col("rank").alias(name)).withColumnRenamed("doc", "d")

    def same(left: DataFrame, right: DataFrame, column: str):
        return left["doc"].eqNullSafe(right["d"]) & (left["key"] == right["key"]) & (left[column] == right[column]) & (left["level"] == right["level"])

    head, tail = at("first", "head"), at("other", "tail")
    named = windows.join(head, same(windows, head, "first")).select(windows["doc"], windows["key"], windows["first"], "n", windows["level"], "other", "head")
    named = named.join(tail, same(named, tail, "other")).select(named["doc"], named["key"], "first", "n", "head", "tail")
    named = scratch.table(named, "prefixes")
    interval = ["n", "head", "tail"]
    place = F.struct(F.col("doc").isNotNull().alias("some"), "doc", "key", "first")
    # Written as a table of its own, so that its join may be broadcast if small and else split at frequent intervals.
    earliest = scratch.table(named.groupBy(*interval).agg(F.min(place).alias("place"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "intervals")
    later = named.join(earliest, interval).where(place != F.col("place"))
    later = later.select("doc", "key", "first", (F.col("first") + F.col("n") - 1).alias("last"), F.col("place.doc").alias("source"), F.col("place.key").alias("source_key"), (F.col("first") - F.col("place.first")).alias("shift"))
    pair = ["doc", "key", "source", "source_key", "shift"]
    order = Window.partitionBy(*pair).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0)
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy(*pair, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.select("doc", "key", "first", "last", "source", "source_key", (F.col("first") - F.col("shift")).alias("source_first"))


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, first_line, last_line, source_id, source_line, n_lines): each maximal run with an earlier copy, and that copy.

    A run of at least ``least_words`` words may have several sources, as far as
    none of them holds all of it; a row tells its longest common prefix with one.
    Line numbers count from 0 with blank lines, n_lines without. Nulls and
    repeated rows are treated as ``without_repeats`` says; an empty table
    gives no rows.
    """
    with Scratch(docs.sparkSession, "linedup") as scratch:
        suffixes, ranks = suffix_ranks(docs, least_words, scratch)
        runs = _later_runs(suffixes, ranks, least_words, scratch)

        def numbered(left: DataFrame, doc: str, key: str, seq: str, name: str) -> DataFrame:
            line = suffixes.select(F.col("doc").alias("d"), F.col("key").alias("k"), F.col("seq").alias("s"), F.col("no").alias(name))
            return left.join(line, left[doc].eqNullSafe(line["d"]) & (left[key] == line["k"]) & (left[seq] == line["s"])).drop("d", "k", "s")

        found = numbered(runs, "doc", "key", "first", "first_line")
        found = numbered(found, "doc", "key", "last", "last_line")
        found = numbered(found, "source", "source_key", "source_first", "source_line")
        found = found.select(F.col("doc").alias("doc_id"), "first_line", "last_line", F.col("source").alias("source_id"), "source_line", (F.col("last") - F.col("first") + 1).alias("n_lines"))
        return materialise(found, "linedup-runs")


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, key, gone, words): for each document with later copies the line numbers to delete and their words."""
    with Scratch(docs.sparkSession, "linedup") as scratch:
        suffixes, ranks = suffix_ranks(docs, least_words, scratch)
        runs = _later_runs(suffixes, ranks, least_words, scratch)
        gone = runs.select("doc", "key", F.explode(F.sequence("first", "last")).alias("seq")).distinct()
        numbers = suffixes.select(F.col("doc").alias("d"), F.col("key").alias("k"), F.col("seq").alias("s"), "no", "words")
        found = gone.join(numbers, gone["doc"].eqNullSafe(numbers["d"]) & (gone["key"] == numbers["k"]) & (gone["seq"] == numbers["s"]))
        return materialise(found.groupBy("doc", "key").agg(F.collect_list("no").alias("gone"), F.sum("words").alias("words")), "linedup-gone")


ADDED = ("n_lines", "n_deleted", "words_deleted")


def _cut(docs: DataFrame, least_words: int, added: tuple[str, ...]) -> DataFrame:
    """``docs`` with new ``text`` and ``n_chars``, and the three counts under the names ``added``."""
    doc, key, gone, words, new, count = (free_name(docs, n) for n in ("linedup_doc", "linedup_key", "linedup_gone", "linedup_words", "linedup_text", "linedup_count"))
    found = repeated_lines(docs, least_words).toDF(doc, key, gone, words)
    # Lines to delete grow with the documents, so their table is never sent to all tasks.
    joined = docs.join(found.hint("merge"), docs["doc_id"].eqNullSafe(found[doc]) & (_text_key(docs["text"].cast("string")) == found[key]), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    # The new text has a name of its own first: in one projection, names in lambdas would mean the new column.
    filled = F.filter(lines, lambda line: F.trim(line) != "")
    joined = joined.withColumn(count, F.coalesce(F.size(filled), F.lit(0)).cast("long"))
    joined = joined.withColumn(new, F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    length = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    columns = [F.col(new).alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    counts = (F.col(count), F.coalesce(F.size(gone), F.lit(0)).cast("long"), F.coalesce(F.col(words), F.lit(0)).cast("long"))
    return joined.select(*columns, *(c.alias(n) for c, n in zip(counts, added, strict=True)))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut out of ``text``, and the columns n_lines, n_deleted, words_deleted.

    Lines are compared without spaces at their ends; blank lines are never
    deleted and don't interrupt a run. A run is repeated when the same lines
    occur at two places with at least ``least_words`` words in all; the first
    place, in order of doc_id (null first), then of a hash of the text, then
    of the line, keeps them. Documents that lose all lines stay, with what
    blank lines they have. Rows with the same id and text are one document and
    get the same text. A null text stays null, with no lines. ``n_chars``,
    where there is such a column, is set to the new length. Other columns
    stay; columns named like the three added ones are replaced. An empty table
    gives no rows, and a text of any length is a sequence of lines like others.
    """
    return _cut(docs.drop(*ADDED), least_words, ADDED)


def cut_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with their own columns only, as ``without_repeats`` cuts them; all other columns keep their values."""
    return _cut(docs, least_words, tuple(free_name(docs, n) for n in ADDED)).select(*(f"`{c}`" for c in docs.columns))
