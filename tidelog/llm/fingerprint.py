"""Canonical exact document digests.

Canonical form: Unicode NFKC, case folding, NFKC again (folding can undo it),
runs of white space as one space, trimmed.  The fingerprint is the 128-bit
xxh3 digest of its UTF-8 bytes.  Two texts count as alike when the digests are
equal and, compared byte by byte, so are the canonical forms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.store import materialize, n_partitions


#: Compression of texts and forms that are shuffled.
LEVEL = 1
#: Hex digits of a fingerprint that name a bit of the filter; it has two bits for each.
PLACE = 6


def canonical(text: str | None) -> bytes:
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: bytes, b: bytes) -> float:
    """1.0 if the digests and then the bytes agree, else 0.0: an exact digest knows no degrees."""
    return 1.0 if len(a) == len(b) and digest(a) == digest(b) and a == b else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``id_col``, fingerprint (string, 32 hex digits), canonical_bytes (long), and the text if it is to be kept.

    One row for each input row; null text counts as empty; other columns are not read.
    """
    schema = pa.schema([("fingerprint", pa.string()), ("canonical_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(x.as_py()) for x in batch.column(1)]
            new = pa.RecordBatch.from_arrays([pa.array([digest(f) for f in forms], pa.string()), pa.array([len(f) for f in forms], pa.int64())], schema=schema)
            own = [batch.column(1)] if keep_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *new.columns, *own], names=["id", *new.schema.names, *["text"][: len(own)]])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fingerprint string, canonical_bytes long{', text string' if keep_text else ''}")
    return out.withColumnRenamed("id", id_col)


def _met_twice(digests: DataFrame) -> np.ndarray:
    """A Bloom filter of the fingerprints that occur more than once, as 64-bit words; its size is fixed (2 MB)."""
    often = digests.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
    place = lambda at: F.conv(F.substring("fingerprint", at, PLACE), 16, 10).cast("long")
    bits = often.select(F.explode(F.array(place(1), place(1 + PLACE))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    out = np.zeros(1 << (4 * PLACE - 6), np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def buckets(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint, z (a canonical form, compressed), group_id (the smallest id with it), forms (how many share the fingerprint).

    ``digests`` has the documents' fingerprints.  Only forms whose fingerprint is
    met twice (or passes for it in the filter) are sent, and each task sends one
    row for each form it has seen (partial aggregation), so a group of any size
    is merged without a hot task.  Equal bytes compress to equal bytes, so forms
    are compared by their bytes.  Fingerprints met once may be missing.
    """
    schema, filled = f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string, z binary", _met_twice(digests)

    def often(fingerprint: str) -> bool:
        places = int(fingerprint[:PLACE], 16), int(fingerprint[PLACE : 2 * PLACE], 16)
        return all(int(filled[p >> 6]) >> (p & 63) & 1 for p in places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                forms = [canonical(x.as_py()) for x in part.column(1)]
                marks = [digest(f) for f in forms]
                at = [k for k, m in enumerate(marks) if often(m)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([marks[k] for k in at], pa.string()), pa.array([press(forms[k]) for k in at], pa.binary())], names=["id", "fingerprint", "z"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    forms = rows.mapInArrow(run, schema).groupBy("fingerprint", "z").agg(F.min("id").alias("group_id"))
    many = forms.groupBy("fingerprint").agg(F.count("*").alias("forms"), F.min("group_id").alias("group_id"))
    # forms that share a fingerprint are told apart by their bytes; elsewhere the fingerprint says it all
    apart = forms.join(many.filter("forms > 1").select("fingerprint", "forms"), "fingerprint").select("fingerprint", "z", "group_id", "forms")
    alone = many.filter("forms = 1").select("fingerprint", F.lit(None).cast("binary").alias("z"), "group_id", "forms")
    return materialize(alone.unionByName(apart), "buckets")


def with_groups(rows: DataFrame, found: DataFrame, id_col: str = "doc_id", text: str | None = None) -> DataFrame:
    """``rows`` (with ``fingerprint``) and ``group_id``, a row's own id where nothing else has its form.

    Where a fingerprint stands for several forms, ``text`` tells which; without it such rows are left out.
    """
    one = found.filter("forms = 1").select(F.col("fingerprint").alias("_f"), F.col("group_id").alias("_g"))
    several = found.filter("forms > 1")
    some = not several.isEmpty()
    kept = rows.join(several.select("fingerprint").distinct(), "fingerprint", "left_anti") if some else rows
    alone = kept.join(one, F.col("fingerprint") == F.col("_f"), "left").withColumn("group_id", F.coalesce("_g", id_col)).drop("_f", "_g")
    if text is None or not some:
        return alone

    @F.pandas_udf("binary")
    def form(texts: pd.Series) -> pd.Series:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        return texts.map(lambda t: press(canonical(t)))

    shared = rows.join(several.select("fingerprint").distinct(), "fingerprint", "left_semi").withColumn("z", form(F.col(text)))
    return alone.unionByName(shared.join(several.select("fingerprint", "z", "group_id"), ["fingerprint", "z"]).drop("z"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """``id_col``, fingerprint, group_id: the smallest id with the same canonical form.

    One row for each input row, other columns are not read.  Null text counts as
    empty.  Rows with a null id are in the group of their form; a group without
    any id has a null one.
    """
    if found is None:
        found = buckets(docs, fingerprints(docs, id_col, text_col), id_col, text_col)
    collide = not found.filter("forms > 1").isEmpty()
    rows = fingerprints(docs, id_col, text_col, keep_text=collide)
    return with_groups(rows, found, id_col, "text" if collide else None).select(id_col, "fingerprint", "group_id")


def with_next(docs: DataFrame, run_pair, out_schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply ``run_pair(doc_id, text, next_text) -> tuple`` to each document and its successor by ascending id.

    Rows are range-partitioned and sorted once, their texts compressed (rows of
    one id in the order of these bytes).  The last row of each range
    waits for the first of the next one: these two rows a range are kept aside
    (there are as many as partitions, whatever the input), paired and finished.
    The last document's successor is the first one.
    """
    names = [c.strip().split(" ")[0] for c in out_schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, rows = TaskContext.get().partitionId(), None, []
        unpress = zstandard.ZstdDecompressor().decompress
        empty = (None,) * len(names)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("part", "edge", "edge_id", "edge_text", *names), r, strict=True)) for r in rows], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = key, unpress(text.as_py()).decode("utf-8", "surrogatepass")
                if before is None:
                    rows.append((part, "first", *now, *empty))
                else:
                    rows.append((part, None, None, None, *run_pair(*before, now[1])))
                before = now
                if len(rows) >= 1024:
                    yield batch_of(rows)
                    rows = []
        if before is not None:
            rows.append((part, "last", *before, *empty))
        if rows:
            yield batch_of(rows)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"part int, edge string, edge_id long, edge_text string, {out_schema}"
    schema = to_arrow_schema(StructType.fromDDL(full))
    narrow = to_arrow_schema(StructType.fromDDL(out_schema))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                b = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)], pa.binary())], names=["doc_id", "z"])

    packed = rows.mapInArrow(pack, "doc_id long, z binary")
    ordered = packed.repartitionByRange(n_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "z")
    done = materialize(ordered.mapInArrow(run, full), "with-next")
    edges = done.filter("edge is not null").select("part", "edge", "edge_id", "edge_text")
    by_part = Window.orderBy("part")  # a row for each range partition
    pairs = (
        edges.filter("edge = 'last'").select("part", "edge_id", F.col("edge_text").alias("text"))
        .join(edges.filter("edge = 'first'").select("part", F.col("edge_text").alias("first_text")), "part")
        .select("edge_id", "text", F.coalesce(F.lead("first_text").over(by_part), F.first("first_text").over(by_part)).alias("next_text"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [run_pair(*(x.as_py() for x in row)) for row in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in got], schema=narrow)

    return done.filter("edge is null").select(*names).unionByName(pairs.mapInArrow(finish, out_schema))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints of the text and of its edited text, and their likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document.  Null text counts as empty; of
    an empty text nothing is replaced.
    """
    import hashlib

    def pair(doc_id: int, text: str, after: str) -> tuple:
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        own, new = canonical(text), canonical(edited)
        edited_sha = hashlib.sha256(edited.encode()).hexdigest()
        return doc_id, n, edited_sha, digest(own), digest(new), likeness(own, new), likeness(own, canonical(after))

    return with_next(docs, pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", id_col, text_col)


def grouped_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`edit_report` with ``group_id``, the smallest id of the documents with the same canonical form."""
    report = edit_report(docs, id_col, text_col)
    found = buckets(docs, report.select("fingerprint"), id_col, text_col)
    rows = with_groups(report, found)
    several = found.filter("forms > 1")
    if several.isEmpty():
        return rows
    # fingerprints that collide: their documents' groups go by id
    groups = exact_groups(docs, id_col, text_col, found).join(several.select("fingerprint").distinct(), "fingerprint", "left_semi")
    groups = groups.select(F.col(id_col).cast("long").alias("doc_id"), "fingerprint", "group_id").dropDuplicates(["doc_id", "fingerprint"])
    return rows.unionByName(report.join(groups, ["doc_id", "fingerprint"]))
