"""Mixing sources to target weights along a curriculum.

Each source has a weight that may change with training progress.  Its share of
the demand at any moment is its weight over the sum of all weights; integrating
the shares gives each source's cumulative demand.  The documents of a source
form a stream (a hash orders them; when the stream ends it starts again), and a
document's place in the stream is turned into a training position by inverting
the cumulative demand.  Range-sorting by position gives the training order.

DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.store import materialize, n_partitions

#: Factors on the sources' weights in each third of training, for the sources in turn.
CURRICULUM = ((4, 2, 1), (2, 2, 2), (1, 2, 4))
#: A word: a run of characters other than space and the controls from tab to carriage return.
NO_WORD = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    # what stands between words is made one space, so words are one more than spaces left; the pattern runs only where two stand together
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.coalesce(text, F.lit("")))
    squeezed = F.trim(F.when(spaced.contains("  "), F.regexp_replace(spaced, " +", " ")).otherwise(spaced))
    spaces = F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(F.octet_length(squeezed) == 0, F.lit(0)).otherwise(spaces + 1).cast("long")


def cyclic_weights(sources: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """Give the sources, by code point and null last, the weights in turn.  ``sources`` has one row for each."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))


def capped_targets(sources: DataFrame, total: Column | None = None, most: float = 3.0) -> DataFrame:
    """``target``: the total shared by weight, none above ``most`` times its source's size.

    ``sources``: source, source_size, weight.  What a cap cuts off is shared
    again by weight among the others until none is above, so a source gets
    min(weight * level, cap) for the one level at which all is shared.  With
    sources in order of cap / weight that level is found in one pass: the k
    first are at their caps when the level that this implies reaches the next
    one.  There is a row for each source, not for each document.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.encode("source", "UTF-8"), F.col("source").isNull())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    total = total if total is not None else F.sum("source_size").over(everyone)
    s = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_total", total)
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", F.when(F.col("weight") > 0, F.greatest(F.col("_left"), F.lit(0.0)) / F.col("_weights")))
        # the first source whose cap the level doesn't reach settles it; from there on the level falls, so it is the highest
        .withColumn("_fits", F.col("_level") * F.col("weight") <= F.col("cap"))
        .withColumn("_level", F.max(F.when(F.col("_fits"), F.col("_level"))).over(everyone))
    )
    target = F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("_level"), F.col("cap")))
    return s.withColumn("target", target).drop("cap", "_total", "_left", "_weights", "_level", "_fits")


def demand_curve(targets: DataFrame, schedule: Sequence[Sequence[float]] | None) -> DataFrame:
    """``curve``: for each source an array of (t, d), training progress and the words demanded until then.

    ``schedule`` gives factors on the sources' weights for equal spans of
    training, one sequence for each weight rank (in turn); None keeps the
    weights constant.  Within a span the shares are constant, so cumulative
    demand is linear between the knots and can be inverted exactly.  Each
    source's demand is scaled to its target.
    """
    if not schedule:
        return targets.withColumn("curve", F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("d")), F.struct(F.lit(1.0).alias("t"), F.col("target").alias("d"))))
    spans = len(schedule[0])
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    factors = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in schedule])
    s = targets.withColumn("_f", F.element_at(factors, (F.pmod(place - 1, F.lit(len(schedule))) + 1).cast("int")))
    # added up in one order, so that reruns agree to the last bit
    everyone = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for k in range(spans):
        w = F.col("target") * F.col("_f")[k]
        s = s.withColumn(f"_s{k}", w / F.greatest(F.sum(w).over(everyone), F.lit(1e-300)))
    drawn = [sum((F.col(f"_s{k}") for k in range(n)), F.lit(0.0)) for n in range(spans + 1)]
    knots = [F.struct(F.lit(n / spans).alias("t"), (F.col("target") * drawn[n] / F.greatest(drawn[spans], F.lit(1e-300))).alias("d")) for n in range(spans + 1)]
    return s.withColumn("curve", F.array(*knots)).drop("_f", *[f"_s{k}" for k in range(spans)])


def position_at(curve: Column, offset: Column) -> Column:
    """Training progress (0 to 1) at which the demand reaches ``offset``."""
    pairs = F.zip_with(F.slice(curve, F.lit(1), F.size(curve) - 1), F.slice(curve, F.lit(2), F.size(curve) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = F.get(F.filter(pairs, lambda p: p["b"]["d"] > offset), F.lit(0))
    return F.coalesce(hit["a"]["t"] + (hit["b"]["t"] - hit["a"]["t"]) * F.greatest(offset - hit["a"]["d"], F.lit(0.0)) / (hit["b"]["d"] - hit["a"]["d"]), F.lit(1.0))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, schedule: Sequence[Sequence[float]] | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, offset, taken, curve.

    ``size`` is the number of words, ``offset`` the words of its source's
    stream before it, ``taken`` the words that the mix takes of it, repeats
    counted: a source takes whole rounds of its stream and then its beginning,
    up to the floor of its target, so the last document may be taken in part.
    Null text counts as empty; a null source is a source; empty documents are
    kept with nothing taken; repeated rows are documents of their own (of equal
    rows it makes no difference which is first).  Reruns agree: ties of the hash
    go by id and size.  Other columns are not read.

    No source goes to one task: its stream is cut into groups by hash, as many
    as the root of the number of rows, groups are added up first, and rows are
    ordered within groups.
    """
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")),
        "mix-sizes",
    )
    groups = max(1, math.isqrt(sized.count()))
    sized = sized.withColumn("grp", F.pmod(F.shiftright("h", 20), F.lit(groups)).cast("int"))
    by_group = materialize(sized.groupBy("source", "grp").agg(F.sum("size").alias("n")), "mix-groups")
    sources = by_group.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = demand_curve(capped_targets(cyclic_weights(sources, weights), most=most), schedule)
    before = Window.partitionBy("source").orderBy("grp")  # a row for each group
    group_start = by_group.select("source", "grp", (F.sum("n").over(before) - F.col("n")).alias("start"))
    # null sources join too
    lookup = group_start.alias("g").join(targets.alias("t"), F.expr("g.source <=> t.source")).select(F.col("g.source").alias("s_source"), F.col("g.grp").alias("s_grp"), "start", "source_size", "target", "curve")
    inside = Window.partitionBy("source", "grp").orderBy("h", F.col("doc_id"), "size")
    placed = sized.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    out = placed.join(lookup, F.expr("source <=> s_source and grp = s_grp"))
    offset = F.col("start") + F.col("inside")
    want = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0).cast("long"))
    rest = want - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - offset))
    return out.select("doc_id", "source", "size", "source_size", "target", offset.alias("offset"), taken.alias("taken"), "curve")


def copies_of(plan: DataFrame) -> DataFrame:
    """Add ``copies``: an array of (copy, words, position), one for each copy whose position lies in the run.

    A copy's place in its source's stream is put through the inverse of the
    demand; what lies behind the end of the run isn't taken.
    """
    place = lambda c: c.cast("long") * F.col("source_size") + F.col("offset")
    words = lambda c: F.least(F.col("size"), F.floor("target").cast("long") - place(c))
    numbers = F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int"))
    copies = F.transform(numbers, lambda c: F.struct(c.alias("copy"), words(c).alias("words"), position_at(F.col("curve"), place(c).cast("double")).alias("position")))
    kind = "array<struct<copy: int, words: bigint, position: double>>"
    copies = F.when(F.col("size") > 0, F.filter(copies, lambda x: (x["words"] > 0) & (x["position"] < 1))).otherwise(F.array().cast(kind))
    return plan.withColumn("copies", copies.cast(kind))


def training_order(plan: DataFrame) -> DataFrame:
    """One row for each copy that is taken, range-sorted by training position.

    doc_id, source, copy (int, from 0), words (long, taken of this copy),
    position (double, 0 to 1), offset (as in the plan).
    """
    rows = copies_of(plan).withColumn("c", F.explode("copies")).select("doc_id", "source", "c.copy", "c.words", "c.position", "offset")
    n = n_partitions(plan.sparkSession)
    return rows.repartitionByRange(n, "position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, taken, position.

    The training order is written, range-sorted; ``taken`` adds up the words of
    a row's copies in it, ``position`` is that of the first, null where nothing
    is taken.
    """
    plan = materialize(plan_mix(docs, **options).drop("taken"), "mix-plan")
    order = materialize(training_order(plan), "mix-order")
    # places of what is taken are a source's own, so they name rows even where ids are repeated
    found = order.groupBy(F.struct("source", "offset").alias("k")).agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    rows = plan.withColumn("key", F.when(F.col("size") > 0, F.struct("source", "offset"))).join(found, F.col("key") == F.col("k"), "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "position")


def mix(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """The training stream: rows of ``docs``, all columns as they are, once for each copy taken, range-sorted by position.

    The one copy of each source that its target cuts is shortened to the words
    taken; ``n_chars``, where there is one, follows a shortened text.  With
    ``whole`` it is taken whole or not at all, whichever is nearer to the target.
    Rows with a null id are documents of their own and are mixed like any other.
    """
    text_col, id_col, source_col = (options.get(f"{c}_col", d) for c, d in (("text", "text"), ("id", "doc_id"), ("source", "source")))
    plan = copies_of(plan_mix(docs, **options))
    # rows that share id, source and size are dealt their places in turn; structs with nulls in the same fields are equal
    plan = plan.groupBy(F.struct("doc_id", "source", "size").alias("k")).agg(F.sort_array(F.collect_list(F.struct("offset", "copies"))).alias("places")).filter(F.exists("places", lambda x: F.size(x["copies"]) > 0))
    # the row goes along as one value, so no column of its can clash
    key = F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(plan, F.col("key") == F.col("k"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.col("row")[text_col].cast("string")))))
    rows = rows.withColumn("c", F.explode(F.col("places")[F.col("nth") - 1]["copies"]))
    words, size = F.col("c.words"), F.col("key.size")
    if whole:
        rows = rows.filter(words * 2 >= size)
        words = size
    own = F.col("row")[text_col]
    head = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(own, NO_WORD, " ")), " "), F.lit(1), words.cast("int")), " ")
    rows = rows.withColumn("new", F.when(words < size, head).otherwise(own))
    changed = {text_col: F.col("new")}
    if "n_chars" in docs.columns and text_col != "n_chars":
        changed["n_chars"] = F.when(words < size, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    out = rows.select("c.position", F.col("key.doc_id").alias("id"), "c.copy", F.struct(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns]).alias("row"))
    out = out.repartitionByRange(n_partitions(docs.sparkSession), "position", "id").sortWithinPartitions("position", "id", "copy")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
