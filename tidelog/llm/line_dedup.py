"""Removal of repeated line runs, by a suffix array over the corpus' line ids.

A document is the sequence of its non-blank lines, each line an id (a 128-bit
hash of the trimmed line).  Lines that occur once can't be part of a repeated
run, so they part the corpus into stretches of lines that occur elsewhere too;
stretches of too few words are left out.  What is left gets positions in order
of the documents, one after the other inside a stretch.

The suffix array is built by prefix doubling over all stretches at once: the
rank of the first 2^(k+1) lines from a position is the place, in a range-sorted
table of distinct pairs, of (rank of 2^k lines here, rank of 2^k lines from 2^k
lines on).  Rounds go on until no group of equal ranks splits, which is when
all suffixes are told apart or equal to their ends.

Longest common prefixes of neighbours in the array are found by going down the
ranks of the rounds, for those neighbours only whose preceding lines differ; one
position on, a prefix that isn't one of these is a line shorter.

A run counts when it has ``min_words`` words or more.  Any repeated run is the
union of shortest runs with so many words, read forwards or backwards from one
of its lines.  The copies of a run of n lines are an interval of the array in
which neighbours share n lines or more; the interval's first position stays and
the lines of all later copies that don't overlap it are deleted.

DataFrame functions only; no row holds more than a line but the documents' own.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.store import discard, materialize, n_partitions

MIN_WORDS = 50
#: Joins of so many levels go into one plan.
LEVELS_A_PLAN = 4


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _squeezed(text: Column) -> Column:
    """Runs of white space inside lines as one space; the pattern runs only over texts that hold one to change."""
    odd = [text.contains(c) for c in ("  ", "\t", "\x0b", "\x0c", "\r")]
    return F.when(reduce(or_, odd), F.regexp_replace(text, r"[^\S\n]+", " ")).otherwise(text)


def _words(squeezed: Column) -> Column:
    return F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` range-sorted; numbers given to its rows in turn rise with the keys."""
    return df.repartitionByRange(n_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tx (hash of the text), i (from 0, among non-blank lines), o (line number), w (words), a, b (line id)."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tx"), _lines(_squeezed(text)).alias("ls")).filter("doc_id is not null")
    numbered = F.transform("ls", lambda x, i: F.struct(F.trim(x).alias("t"), i.alias("o")))
    rows = rows.select("doc_id", "tx", F.posexplode(F.filter(numbered, lambda x: x["t"] != "")).alias("i", "l"))
    t = F.col("l.t")
    return rows.select("doc_id", "tx", "i", F.col("l.o").alias("o"), _words(t).alias("w"), F.xxhash64(t).alias("a"), F.xxhash64(F.lit("b"), t).alias("b"))


def repeated_stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """p, s, e, doc_id, tx, o, w, r: lines that occur more than once, in stretches of ``min_words`` words or more.

    ``p`` is the position, rising with (doc_id, tx, i) and by one inside a
    stretch, ``s`` and ``e`` the stretch's first position and the one behind its
    last, ``r`` the line's rank.  Rows of one id and text are one document.
    """
    shared = lines.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")
    ranks = materialize(_sorted_by(shared.select("a", "b"), "a", "b").withColumn("r", F.monotonically_increasing_id()), "line-ids")
    own = Window.partitionBy("doc_id", "tx").orderBy("i")
    whole = Window.partitionBy("doc_id", "tx", "st")
    rows = lines.join(ranks, ["a", "b"]).drop("a", "b").repartitionByRange(n_partitions(lines.sparkSession), "doc_id", "tx")
    rows = rows.withColumn("before", F.lag("i").over(own)).filter("before is null or before != i")
    rows = rows.withColumn("st", F.col("i") - F.row_number().over(own)).withColumn("words", F.sum("w").over(whole)).filter(F.col("words") >= min_words)
    rows = rows.sortWithinPartitions("doc_id", "tx", "i").withColumn("p", F.monotonically_increasing_id())
    rows = rows.withColumn("s", F.min("p").over(whole)).withColumn("e", F.max("p").over(whole) + 1)
    return materialize(rows.select("p", "s", "e", "doc_id", "tx", "o", "w", "r"), "stretches")


def prefix_doubling(lines: DataFrame) -> list[DataFrame]:
    """Tables (s, p, r), one a level: level k ranks suffixes by their first 2^k lines, the last one by all.

    Ranks rise with the order of the lines' ranks, the end of a stretch before any line.
    """
    levels = [lines.select("s", "p", "r")]
    groups = levels[0].select("r").distinct().count()
    while True:
        ahead = F.lead("r", 1 << (len(levels) - 1)).over(Window.partitionBy("s").orderBy("p"))
        pairs = levels[-1].withColumn("next", F.coalesce(ahead, F.lit(-1).cast("long")))
        ranks = materialize(_sorted_by(pairs.select("r", "next").distinct(), "r", "next").withColumn("rank", F.monotonically_increasing_id()), "suffix-ranks")
        found = ranks.count()
        if found == groups:
            discard(ranks)
            return levels
        levels.append(materialize(pairs.join(ranks, ["r", "next"]).select("s", "p", F.col("rank").alias("r")), "suffixes"))
        discard(ranks)
        groups = found


def _carried(df: DataFrame, last: Column, name: str) -> DataFrame:
    """part, ``name``: the aggregate ``last`` over the parts before it; a row for each range partition."""
    ends = df.groupBy("part").agg(last.alias("_end"))
    return ends.select("part", F.last("_end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def _in_parts(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Range-sorted and written, with ``part`` and ``place`` (rises with the keys)."""
    return materialize(_sorted_by(df, *keys).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), name)


def common_prefixes(lines: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """p, r, lcp: the suffix array (ordered by r and p) and the lines that each suffix shares with the one before it."""
    array = _in_parts(levels[-1].select("p", "r"), "suffix-array", "r", "p")
    inside = Window.partitionBy("part").orderBy("place")
    before = F.coalesce(F.lag(F.struct("p", "r")).over(inside), F.col("carry"))
    carry = _carried(array, F.max_by(F.struct("p", "r"), F.col("place")), "carry")
    array = array.join(F.broadcast(carry), "part", "left").withColumn("q", before).select("p", "r", F.col("q.p").alias("q"), F.col("r").eqNullSafe(F.col("q.r")).alias("same"))
    text = lines.select("p", "s", "e", F.lag("r").over(Window.partitionBy("s").orderBy("p")).alias("line_before"))
    other = text.select(F.col("p").alias("q"), F.col("e").alias("q_end"), F.col("line_before").alias("q_before"))
    rows = materialize(array.join(text, "p").join(other, "q", "left").withColumn("starts", F.coalesce(F.col("line_before") != F.col("q_before"), F.lit(True))).drop("line_before", "q_before"), "neighbours")
    # suffixes of one last rank are equal to their ends; others go down the levels
    n = F.col("n")
    pairs = rows.filter("starts and not same and q is not null").select("p", "q", "e", "q_end", F.lit(0).cast("long").alias("n"))
    for done, k in enumerate(reversed(range(len(levels) - 1)), 1):
        within = (F.col("p") + n < F.col("e")) & (F.col("q") + n < F.col("q_end"))
        pairs = pairs.withColumn("_x", F.when(within, F.col("p") + n).otherwise(-1 - F.col("p"))).withColumn("_y", F.when(within, F.col("q") + n).otherwise(-1 - F.col("q")))
        pairs = pairs.join(levels[k].select(F.col("p").alias("_x"), F.col("r").alias("_rx")), "_x", "left").join(levels[k].select(F.col("p").alias("_y"), F.col("r").alias("_ry")), "_y", "left")
        more = F.least(F.lit(1 << k).cast("long"), F.col("e") - F.col("p") - n)
        pairs = pairs.select("p", "q", "e", "q_end", F.when(F.col("_rx") == F.col("_ry"), n + more).otherwise(n).alias("n"))
        if done % LEVELS_A_PLAN == 0:
            pairs = materialize(pairs, "prefixes")
    rows = rows.join(pairs.select("p", "n"), "p", "left").withColumn("n", F.when(F.col("starts"), F.when(F.col("same"), F.col("e") - F.col("p")).otherwise(F.coalesce(n, F.lit(0).cast("long")))))
    so_far = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seed", F.last(F.when(F.col("n").isNotNull(), F.struct("p", "n")), ignorenulls=True).over(so_far))
    return rows.select("p", "r", (F.col("seed.n") - (F.col("p") - F.col("seed.p"))).alias("lcp"))


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """p, len, doc_id, tx, first_line, last_line: the shortest runs of ``min_words`` words from each line on and up to each line."""
    text = Window.partitionBy("s").orderBy("p")
    whole = Window.partitionBy("s")
    rows = lines.withColumn("upto", F.sum("w").over(text.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("upto") - F.col("w"))
    rows = rows.withColumn("total", F.sum("w").over(whole)).withColumn("first_o", F.min("o").over(whole)).withColumn("last_o", F.max("o").over(whole))
    rows = rows.withColumn("o_before", F.lag("o").over(text)).withColumn("o_after", F.lead("o").over(text))
    # frames that only grow, so that a stretch takes one pass each way
    up = Window.partitionBy("s").orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    down = Window.partitionBy("s").orderBy(F.desc("from")).rangeBetween(Window.unboundedPreceding, -min_words)
    rows = rows.withColumn("up", F.max(F.struct("p", "o_after")).over(up)).withColumn("down", F.min(F.struct("p", "o_before")).over(down))
    forward = F.struct(F.col("p").alias("p"), (F.coalesce("down.p", "e") - F.col("p")).alias("len"), F.col("o").alias("first_line"), F.coalesce("down.o_before", "last_o").alias("last_line"))
    start = F.coalesce(F.col("up.p") + 1, F.col("s"))
    backward = F.struct(start.alias("p"), (F.col("p") + 1 - start).alias("len"), F.coalesce("up.o_after", "first_o").alias("first_line"), F.col("o").alias("last_line"))
    runs = F.array_compact(F.array(F.when(F.col("total") - F.col("from") >= min_words, forward), F.when(F.col("upto") >= min_words, backward)))
    return rows.select("doc_id", "tx", F.explode(runs).alias("run")).select("run.p", "run.len", "doc_id", "tx", "run.first_line", "run.last_line")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tx, first_line, last_line (int): later copies of line runs, as line numbers of the text from 0.

    Later: after the first occurrence by (doc_id, place), not overlapping it.
    Blank lines neither count nor break a run.  Null and empty texts have no
    lines.  Rows without an id are left out.  Rows that share an id are one
    document if their texts are equal, else documents that follow each other by
    ``tx``, the text's hash.
    """
    found = materialize(line_table(docs, id_col, text_col), "lines")
    lines = repeated_stretches(found, min_words)
    discard(found)
    levels = prefix_doubling(lines)
    runs = materialize(shortest_runs(lines, min_words), "line-runs")
    asked = runs.select("p", "len").join(common_prefixes(lines, levels), "p")
    # copies of one run stand together; where fewer than its lines are shared with the suffix before, an interval begins
    asked = _in_parts(asked.select("p", "len", "r", (F.col("lcp") < F.col("len")).alias("begins")), "run-order", "len", "r", "p")
    discard(lines, *levels[1:])
    start = F.when(F.col("begins"), F.col("place"))
    carry = _carried(asked, F.max(start), "carry")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.join(F.broadcast(carry), "part", "left").select("p", "len", F.coalesce(F.last(start, ignorenulls=True).over(inside), F.col("carry")).alias("interval"))
    # one row for each interval and task before the shuffle, however often a run is repeated; written, so that a hot interval can be split in the join
    first = asked.groupBy("len", "interval").agg(F.min("p").alias("first"), F.max("p").alias("last")).filter("last >= first + len").select("len", "interval", "first")
    later = asked.join(materialize(first, "first-copies"), ["len", "interval"]).filter("p >= first + len").select("p", "len").distinct()
    return runs.join(later, ["p", "len"]).select("doc_id", "tx", "first_line", "last_line")


def merged_spans(spans: DataFrame) -> DataFrame:
    """doc_id, tx, spans: each document's spans as an ordered array of disjoint ones."""
    own = Window.partitionBy("doc_id", "tx").orderBy("first_line")
    ahead, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    one = spans.groupBy("doc_id", "tx", "first_line").agg(F.max("last_line").alias("last_line"))
    marked = one.withColumn("reach", F.max("last_line").over(ahead)).withColumn("new", (F.col("reach").isNull() | (F.col("first_line") > F.col("reach"))).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(so_far)).groupBy("doc_id", "tx", "island").agg(F.min("first_line").alias("s"), F.max("last_line").alias("e"))
    return islands.groupBy("doc_id", "tx").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with later copies of line runs taken out of the text.

    The lines left are joined by line feeds as they were, blank ones outside
    the runs included; a text without deleted lines is unchanged; ``n_chars``,
    where there is one, follows a changed text.  A document that loses all its
    lines stays with an empty text.  Null texts stay null, rows without an id
    are unchanged, rows of one id and text change alike, an empty table gives none.
    """
    spans = merged_spans(repeated_runs(docs, min_words, id_col, text_col)).select(F.struct("doc_id", "tx").alias("k"), "spans")
    # the row goes along as one value, so no column of its can clash
    key = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tx"))
    rows = docs.select(key.alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(spans, F.col("id") == F.col("k"), "left")

    def kept(x: Column) -> Column:
        """The lines before, between and behind the spans."""
        begin = F.concat(F.array(F.lit(0)), F.transform(x["spans"], lambda y: y["e"] + 1))
        end = F.concat(F.transform(x["spans"], lambda y: y["s"]), F.array(F.size(x["lines"])))
        return F.array_join(F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(x["lines"], b + 1, F.greatest(e - b, F.lit(0))))), "\n")

    # bound to a variable, so that a text is split once and not once a span
    held = F.array(F.struct(_lines(F.col("row")[text_col].cast("string")).alias("lines"), "spans"))
    rows = rows.withColumn("new", F.when(F.col("spans").isNotNull(), F.get(F.transform(held, kept), F.lit(0))))
    changed = {text_col: F.coalesce("new", F.col("row")[text_col])}
    if "n_chars" in docs.columns and text_col != "n_chars":
        changed["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
