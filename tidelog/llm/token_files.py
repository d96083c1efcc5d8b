"""Token-id files: whole texts encoded by a tokenizer, packed by Simple-8b.

A file set is a folder of Parquet files with one row for each document, in
ascending document order within and across the range partitions ``part``:
``part, doc_id, local_start, n_tokens, payload``.  ``payload`` is

    "S8B1" | n_ids u32 | n_blocks u32 | word offset of each block u32[n_blocks] | words u64[...]

little-endian.  Each block holds ``BLOCK`` ids (the last one fewer) and begins
on a word of its own, so blocks can be decoded apart.  The top four bits of a
word select how many values of which width its lower 60 bits hold; selector 15
is the escape, one value in a whole 60-bit field, and selectors 0 and 1 hold
runs of zeros.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.store import n_partitions, new_path

MAGIC = b"S8B1"
HEADER = struct.Struct("<II").unpack_from
BLOCK = 4096
#: Values a word and bits a value, by selector, of the published Simple-8b scheme.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Ids that are packed together, about.
GROUP_IDS = 500_000


#: Bits of small numbers.
WIDTH_OF = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.int8)


def _widths(ids: np.ndarray) -> np.ndarray:
    if len(ids) and int(ids.max()) >> 60:
        raise ValueError("a value does not fit in 60 bits")
    if not len(ids) or int(ids.max()) < len(WIDTH_OF):
        return WIDTH_OF[ids]
    if int(ids.max()) < 1 << 52:  # exact as doubles, whose exponent is the width
        return np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    return np.array([int(x).bit_length() for x in ids.tolist()], np.int8)


def pack_all(ids: np.ndarray, lengths: list[int]) -> list[bytes]:
    """Payloads of consecutive documents whose ids are laid end to end; each word takes as many ids as fit."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    bounds = np.cumsum([0, *lengths])
    starts = np.concatenate([np.zeros(0, np.int64), *[np.arange(lo, hi, BLOCK) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]])
    ends = np.append(starts, n)[1:]
    left = np.repeat(ends, ends - starts) - np.arange(n)  # ids up to the end of the block
    width = _widths(ids)
    best = np.full(n, 15, np.int8)
    widest, at = int(width.max(initial=0)), None
    for sel in range(14, -1, -1):  # from few values to many: where one doesn't fit, none of those with more does
        count = int(COUNTS[sel])
        if count > n:
            break
        run = None
        if widest > WIDTHS[sel]:
            run = np.zeros(n + 1, np.int32)
            np.cumsum(width <= WIDTHS[sel], dtype=np.int32, out=run[1:])
        if at is None:  # most places still fit: whole slices are faster than indexes
            fits = left[: n - count + 1] >= count
            if run is not None:
                fits &= run[count:] - run[:-count] == count
            best[: n - count + 1][fits] = sel
            if sel <= 12:
                at = np.flatnonzero(fits)
        else:
            at = at[left[at] >= count]
            if run is not None:
                at = at[run[at + count] - run[at] == count]
            best[at] = sel
            if not len(at):
                break
    jump = COUNTS[best].tolist()
    at, first = 0, []
    add = first.append
    while at < n:
        add(at)
        at += jump[at]
    first = np.array(first, np.int64)
    sel = best[first]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel).tolist():
        if s > 1:
            mine = np.flatnonzero(sel == s)
            here, part = first[mine], np.zeros(len(mine), np.uint64)
            for k in range(int(COUNTS[s])):
                part |= ids[here + k] << np.uint64(k * int(WIDTHS[s]))
            words[mine] |= part
    block_word = np.searchsorted(first, starts)  # a word begins at each block's start
    doc_block = np.searchsorted(starts, bounds)
    doc_word = np.searchsorted(first, bounds)
    data = words.astype("<u8").tobytes()
    out = []
    for k, length in enumerate(lengths):
        offsets = block_word[doc_block[k] : doc_block[k + 1]] - doc_word[k] if length else block_word[:0]
        out.append(MAGIC + np.array([length, len(offsets)], "<u4").tobytes() + offsets.astype("<u4").tobytes() + data[8 * doc_word[k] : 8 * doc_word[k + 1]])
    return out


def pack(ids: np.ndarray) -> bytes:
    return pack_all(np.asarray(ids), [len(ids)])[0]


def unpack_words(words: np.ndarray) -> np.ndarray:
    """All values of the words, whatever block they belong to."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts, widths = COUNTS[sel], WIDTHS[sel]
    end = np.cumsum(counts)
    place = np.arange(end[-1] if len(end) else 0) - np.repeat(end - counts, counts)
    shift = (place * np.repeat(widths, counts)).astype(np.uint64)
    mask = (np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)
    return (np.repeat(words, counts) >> shift) & np.repeat(mask, counts)


def unpack_all(payloads: list[bytes]) -> list[bytes]:
    """Ids of each payload as little-endian unsigned 32-bit integers, decoded together; ids that need more bits are refused."""
    lengths, words = [], []
    for payload in payloads:
        if payload[:4] != MAGIC:
            raise ValueError("not a token file")
        n, n_blocks = HEADER(payload, 4)
        lengths.append(n)
        words.append(payload[12 + 4 * n_blocks :])
    ids = unpack_words(np.frombuffer(b"".join(words), "<u8"))
    if len(ids) and int(ids.max()) >> 32:
        raise ValueError("an id does not fit in 32 bits")
    data = ids.astype("<u4").tobytes()
    ends = [4 * e for e in accumulate(lengths, initial=0)]
    return [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def unpack(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a token file")
    n, n_blocks = HEADER(payload, 4)
    return unpack_words(np.frombuffer(payload, "<u8", offset=12 + 4 * n_blocks))[:n]


def unpack_part(payload: bytes, block: int) -> np.ndarray:
    """One block alone, found by its offset."""
    n, n_blocks = np.frombuffer(payload, "<u4", 2, 4).tolist()
    offsets = np.frombuffer(payload, "<u4", n_blocks, 12).tolist()
    words = np.frombuffer(payload, "<u8", offset=12 + 4 * n_blocks)
    return unpack_words(words[offsets[block] : offsets[block + 1] if block + 1 < n_blocks else None])


#: Fixed value: parts chunks of a text; a text that holds it goes to the library whole.
PART = "\x1f"
#: Bytes of text that are encoded together, and chunks that are handed to the library at once.
SLICE_BYTES, CHUNKS = 20 << 20, 4_000


class TextEncoder:
    """The library's ids of many texts at once.

    The byte-level pre-tokenizer begins a new piece at a single space, and at
    either side of a single line feed, between two other characters, so texts
    are cut there, each distinct chunk is encoded once and the ids are laid out
    by gathering.  A text with any other white space goes to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.whole_only = any(t.lstrip or t.rstrip or t.normalized for t in self.library.get_added_tokens_decoder().values())
        vocab = self.library.get_vocab()
        #: By id: whether a token begins with a space or a line feed, in the byte-level alphabet.
        self.begins_spaced, self.begins_feed = np.zeros(max(vocab.values()) + 1, bool), np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.begins_spaced[i], self.begins_feed[i] = token[0] == "Ġ", token[0] == "Ċ"

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): the ids of distinct chunks, each of which would begin a piece.

        Chunks are joined to texts: those with a space in front as they are,
        the others behind a line feed, whose own id belongs to no chunk.  In
        the ids a chunk begins at the token that begins with the space (or is
        the line feed), of which it has no other.
        """
        n = len(chunks)
        first, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        parts, base = [np.zeros(0, np.uint32)], 0
        spaced = pc.starts_with(chunks, " ").to_numpy(zero_copy_only=False)
        feed = pc.equal(chunks, "\n").to_numpy(zero_copy_only=False)
        for mask, lead, begins in ((spaced, "", self.begins_spaced), (~spaced & ~feed, "\n", self.begins_feed)):
            places = np.flatnonzero(mask)
            if not len(places):
                continue
            mine = chunks.take(pa.array(places)).cast(pa.large_string())
            if lead:
                mine = pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), mine, pa.scalar("", pa.large_string()))
            cuts = np.frombuffer(mine.buffers()[1], np.int64)[mine.offset :]
            data = mine.buffers()[2]
            for lo in range(0, len(places), CHUNKS):
                hi = min(lo + CHUNKS, len(places))
                text = data.slice(cuts[lo], cuts[hi] - cuts[lo]).to_pybytes().decode()
                got = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                at = np.flatnonzero(begins[got])
                if len(at) != hi - lo:
                    raise ValueError("the tokenizer joined chunks")
                first[places[lo:hi]] = base + at + len(lead)
                count[places[lo:hi]] = np.diff(np.append(at, len(got))) - len(lead)
                parts.append(got)
                base += len(got)
        for i in np.flatnonzero(feed).tolist():
            parts.append(self.whole("\n"))
            first[i], count[i] = base, len(parts[-1])
            base += len(parts[-1])
        return np.concatenate(parts), first, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids of each text); null counts as empty."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        alone = np.full(n, self.whole_only) | pc.match_substring(texts, PART).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", PART + " "), "\n", PART + "\n" + PART), PART)
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = cut.flatten().dictionary_encode()
        which, chunks = coded.indices.to_numpy(), coded.dictionary
        plain = ~pc.is_in(chunks, pa.array(["", " "])).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~pc.utf8_is_printable(chunks).to_numpy(zero_copy_only=False)).tolist():
            c = chunks[i].as_py()
            if c != "\n" and c.split() != [c.removeprefix(" ")]:  # white space of another kind
                plain[i] = False
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        strange = np.concatenate([[0], np.cumsum(~plain[which])])
        alone |= (strange[bounds[1:]] - strange[bounds[:-1]] > 0) & ~empty
        skip = np.repeat(alone | empty, np.diff(bounds))
        used = np.zeros(len(chunks), bool)
        used[which[~skip]] = True
        places = np.flatnonzero(used)
        ids, own_first, own_count = self._chunk_ids(chunks.take(pa.array(places)))
        first, count = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        first[places], count[places] = own_first, own_count
        many = np.where(skip, 0, count[which])
        ends = np.concatenate([[0], np.cumsum(many)])
        gather = np.repeat((first[which] - ends[:-1]).astype(np.int32), many)
        gather += np.arange(len(gather), dtype=np.int32)
        out = ids[gather]
        lengths = ends[bounds[1:]] - ends[bounds[:-1]]
        odd = np.flatnonzero(alone & ~empty).tolist()
        if odd:
            whole = [self.whole(texts[i].as_py()) for i in odd]
            out = np.insert(out, np.repeat(ends[bounds[odd]], [len(w) for w in whole]), np.concatenate(whole))
            lengths[odd] = [len(w) for w in whole]
        return out, lengths


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the file set to ``path``.

    Rows are range-partitioned and sorted by ``id_col`` (nulls first; rows with
    one id in order of their texts).  Null text counts as empty.  Other columns
    are not read.  An empty table gives a file set without rows.
    """
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
                ids, lengths = enc.encode(batch.column(1).slice(lo, hi - lo))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                lengths = (lengths + 1).tolist()
                keys = batch.column(0).slice(lo, hi - lo)
                ends = np.cumsum([0, *lengths])
                k = 0
                while k < len(lengths):
                    m = max(k + 1, int(np.searchsorted(ends, ends[k] + GROUP_IDS, "right")) - 1)
                    payloads = pack_all(ids[ends[k] : ends[m]], lengths[k:m])
                    columns = [part] * (m - k), keys.slice(k, m - k), at + ends[k:m], lengths[k:m], payloads
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                    k = m
                at += int(ends[-1])
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(n_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "part int, doc_id long, local_start long, n_tokens long, payload binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens (long), token_ids (binary, little-endian unsigned 32-bit), from the files alone.

    ``start`` counts the ids of all documents before this one: the sums of the
    range partitions (one row for each) are added up and joined back.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                ids = unpack_all(b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], schema=schema)

    files = spark.read.schema("part int, doc_id long, local_start long, n_tokens long, payload binary").parquet(path)
    from pyspark.sql import Window

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each range partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, token_ids binary")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the file set, to the shared folder if no path is given, and read it back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, id_col, text_col)
    return read_token_files(spark, path)
