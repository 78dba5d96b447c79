"""Removal of byte strings that repeat from an earlier document.

A byte goes if a string of `SPAN` bytes that covers it also starts in a document with a
smaller doc_id. Comparing all suffixes of all documents would move every byte many times,
so the work is cut along the content first, in a way that loses no repeat:

1. The anchor of a string of SPAN bytes is its GRAM-byte substring of lowest hash, and the
   strings of a document that share an anchor form one segment of up to 2 * SPAN bytes. Equal
   strings have equal anchors at equal offsets. Rows (anchor, hash of the segment, document)
   meet by anchor; a segment that an earlier document has in full goes at once.
2. Segments whose anchor also occurs in different segments, such as those at the edges of a
   repeated passage, are compared string by string: the bytes of all segments of an anchor
   meet in a task, and their suffixes are sorted. Suffixes are compared by hash: prefix sums
   of a polynomial give the hash of any substring, a binary search over its length finds the
   common extension of two suffixes, and so a merge sort needs a logarithmic number of steps
   a comparison, not one a byte. Neighbours with a common extension of SPAN are compared byte
   by byte before they count as equal.

Anchors with very many segments do not go to one task: their strings are grouped by Spark,
which combines equal ones before the shuffle. Segments that one batch of documents holds
several times are settled in the batch, so a passage that is everywhere sends a row a batch.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas.llm.common import as_bytes, mixed, sub_batches, written

SPAN = 50
GRAM = 20
CHUNK = 20_000  # segments whose suffixes are sorted together
HOT_SEGMENTS = 5_000  # of one anchor

_BASE = 0x5851F42D4C957F2D
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Polynomial:
    """Hashes of all substrings of a byte array: sums of byte values times powers of a base."""

    def __init__(self, data):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, start, length):
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def _powers(base, n):
    steps = np.full(max(n, 1), base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)[:n]


def segments(texts):
    """(document, first string, strings, anchor, segment hash) of all segments of byte strings."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    none = (np.zeros(0, dtype=np.int64),) * 5
    if len(data) < SPAN:
        return none
    hashed = Polynomial(data)
    grams = mixed(hashed(np.arange(len(data) - GRAM + 1), GRAM))
    # the position goes into the low bits, so the minimum of a window is its leftmost lowest gram
    bits = np.uint64(len(grams).bit_length())
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width, reach = 1, SPAN - GRAM + 1
    while width < reach:
        step = min(width, reach - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # strings that reach over the end of a document belong to none
    counts = np.maximum(sizes - SPAN + 1, 0)
    starts = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    if not len(starts):
        return none
    doc = np.repeat(np.arange(len(texts)), counts)
    place = place[starts]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    strings = np.diff(np.append(first, len(starts)))
    whole = mixed(hashed(starts[first], strings + SPAN - 1) + strings.astype(np.uint64))
    doc = doc[first]
    return doc, starts[first] - offsets[doc], strings, grams[place[first]].view(np.int64), whole.view(np.int64)


def _settled(doc_ids, place, strings, anchor, whole):
    """Which segments of a batch an earlier document of the batch has, and those of others left.

    Of the rest, all rows stay; the mask is true for rows with a smaller doc_id before them.
    """
    order = np.lexsort((doc_ids, whole, anchor))
    a, w = anchor[order], whole[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(a) else np.zeros(0, dtype=bool)
    owner = doc_ids[order][new][np.cumsum(new) - 1] if len(a) else doc_ids
    known = np.zeros(len(a), dtype=bool)
    known[order] = doc_ids[order] > owner
    return known


_ROWS = "known boolean, anchor long, whole long, doc_id long, place long, strings int"


def _segment_rows(batches):
    """Arrow function: a row for every segment of (doc_id, tag, text); settled ones are spread by place."""
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        ids, tags = (batch.column(c).to_numpy() for c in ("doc_id", "tag"))
        for begin, end in sub_batches(texts):
            doc, first, strings, anchor, whole = segments(texts[begin:end])
            own = ids[begin:end][doc]
            place = tags[begin:end][doc] << 40 | first
            known = _settled(own, place, strings, anchor, whole)
            spread = mixed((own * 31 + place).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(known),
                    pa.array(np.where(known, spread, anchor)),
                    pa.array(np.where(known, 0, whole)),
                    pa.array(own),
                    pa.array(place),
                    pa.array(strings.astype(np.int32)),
                ],
                names=["known", "anchor", "whole", "doc_id", "place", "strings"],
            )


_FOUND = "open boolean, anchor long, doc_id long, place long, strings int"


def _judge_segments(batches):
    """Arrow function over rows sorted by (known, anchor, whole, doc_id).

    Gives the segments that an earlier document has (open = false), and those without one whose
    anchor has several segments (open = true). The first segment of an anchor is held back until
    it is known whether another one follows; of it, only the rows of its first document matter.
    """

    def out(open_, rows):
        a, d, p, s = rows
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), open_)), pa.array(a), pa.array(d), pa.array(p), pa.array(s)],
            names=["open", "anchor", "doc_id", "place", "strings"],
        )

    last = None  # (anchor, whole, owner, whether the anchor has several segments) of the last row
    held = []  # rows of the first document of the first segment of that anchor
    for batch in batches:
        if not batch.num_rows:
            continue
        known, anchor, whole, doc, place, strings = (
            batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "anchor", "whole", "doc_id", "place", "strings")
        )
        rows = lambda at: (anchor[at], doc[at], place[at], strings[at])
        if known.any():
            yield out(False, rows(np.flatnonzero(known)))
        at = np.flatnonzero(~known)
        if not len(at):
            continue
        anchor, whole, doc, place, strings = (x[at] for x in (anchor, whole, doc, place, strings))
        same_a = np.concatenate([[last is not None and last[0] == anchor[0]], anchor[1:] == anchor[:-1]])
        same_w = same_a & np.concatenate([[last is not None and last[1] == whole[0]], whole[1:] == whole[:-1]])
        starts = np.flatnonzero(~same_w)
        run = np.cumsum(~same_w)  # 0: still the run of the last row
        owner = np.concatenate([[last[2] if last is not None else 0], doc[starts]])[run]
        group = np.cumsum(~same_a)
        several = np.zeros(group[-1] + 1, dtype=bool)
        several[0] = last is not None and last[3]
        several[group[same_a & ~same_w]] = True
        yield out(False, rows(np.flatnonzero(doc > owner)))
        if held:
            if several[0]:
                yield from (out(True, h) for h in held)
                held = []
            elif group[-1]:
                held = []
        mine = doc == owner
        wait = mine & (group == group[-1]) & ~several[group]
        yield out(True, rows(np.flatnonzero(mine & several[group])))
        if wait.any():
            held.append(rows(np.flatnonzero(wait)))
        last = (anchor[-1], whole[-1], owner[-1], bool(several[-1]))


def common_extension(hashed, a, b, limit=SPAN):
    """Length of the common start of the suffixes at `a` and `b`, `limit` at most, by binary search."""
    length = np.zeros(len(a), dtype=np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        try_ = np.flatnonzero(length + step <= limit)
        x, y = a[try_] + length[try_], b[try_] + length[try_]
        equal = hashed(x, step) == hashed(y, step)
        length[try_[equal]] += step
        step >>= 1
    return length


def suffix_order(data, hashed, starts):
    """The suffixes at `starts`, cut to SPAN bytes, in order: a merge sort on hash comparisons.

    Eight bytes as a number bring suffixes into runs; only inside a run of equal numbers are
    they merged. Every element finds its place in the sibling run by binary search, all elements
    at the same time.
    """
    head = np.zeros(len(starts), dtype=np.uint64)
    for k in range(8):
        head = head << np.uint64(8) | data[starts + k]
    order = np.argsort(head, kind="stable")
    sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], np.diff(head[order]) != 0])), len(order)))
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    end = begin + np.repeat(sizes, sizes)
    tied = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    width, largest = 1, sizes.max(initial=0)
    while width < largest:
        tied = tied[end[tied] - begin[tied] > width]
        inside = tied - begin[tied]
        right = inside // width % 2 == 1
        low = begin[tied] + np.where(right, inside // width - 1, inside // width + 1) * width
        low = np.minimum(low, end[tied])
        high = np.minimum(low + width, end[tied])
        sibling, mine = low.copy(), starts[order[tied]]
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            other = starts[order[middle]]
            common = common_extension(hashed, mine[open_], other)
            at = np.minimum(common, SPAN - 1)
            x, y = data[mine[open_] + at], data[other + at]
            less = (common < SPAN) & (y < x)
            before = less | ((common == SPAN) & right[open_])  # the left run goes first among equals
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        pair = begin[tied] + inside // (2 * width) * (2 * width)
        moved = order[tied]
        order[pair + inside % width + (low - sibling)] = moved
        width *= 2
    return order


def repeated_strings(pieces, doc_ids, strings):
    """For all strings of all pieces in turn: whether a piece of a smaller doc_id has the string.

    A piece holds `strings` strings of SPAN bytes, one at each of its first bytes.
    """
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])[:-1]
    total = int(strings.sum())
    starts = np.repeat(offsets - (np.cumsum(strings) - strings), strings) + np.arange(total)
    doc = np.repeat(doc_ids, strings)
    hashed = Polynomial(data)
    order = suffix_order(data, hashed, starts)
    a, b = starts[order[:-1]], starts[order[1:]]
    equal = common_extension(hashed, a, b) == SPAN
    reach = np.arange(SPAN)
    for k in range(0, len(a), 1 << 16):  # equal hashes must be equal bytes
        at = np.flatnonzero(equal[k : k + (1 << 16)]) + k
        equal[at] = (data[a[at, None] + reach] == data[b[at, None] + reach]).all(axis=1)
    first = np.flatnonzero(np.concatenate([[True], ~equal])) if total else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(first, total))
    least = np.repeat(np.minimum.reduceat(doc[order], first), sizes) if total else doc
    repeated = np.zeros(total, dtype=bool)
    repeated[order] = doc[order] > least
    return repeated


def _resolve(batches):
    """Arrow function over pieces sorted by anchor: the spans of strings that repeat."""

    def spans(held):
        doc, place, strings, pieces = (np.concatenate(x) for x in zip(*held))
        repeated = repeated_strings(pieces.tolist(), doc, strings)
        of = np.repeat(np.arange(len(doc)), strings)
        edge = np.concatenate([[False], repeated, [False]])
        inner = np.concatenate([[True], of[1:] != of[:-1], [True]])  # a span stays in its piece
        begin = np.flatnonzero(edge[1:-1] & (~edge[:-2] | inner[:-1]))
        end = np.flatnonzero(edge[1:-1] & (~edge[2:] | inner[1:]))
        piece = of[begin]
        ahead = np.cumsum(strings) - strings
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[piece]), pa.array(place[piece] + begin - ahead[piece]), pa.array((end - begin + SPAN).astype(np.int32))],
            names=["doc_id", "place", "length"],
        )

    held, rows, last = [], 0, None
    for batch in batches:
        anchor = batch.column("anchor").to_numpy()
        doc, place, strings = (batch.column(c).to_numpy() for c in ("doc_id", "place", "strings"))
        pieces = np.array([None, *batch.column("piece").to_pylist()], dtype=object)[1:]
        begin = 0
        if not len(anchor):
            continue
        # anchors are taken whole; those of more than HOT_SEGMENTS rows have gone another way
        ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
        if last is not None and anchor[0] != last and rows >= CHUNK:
            yield spans(held)
            held, rows = [], 0
        for end in ends:
            if rows + end - begin >= CHUNK and end < len(anchor):
                held.append((doc[begin:end], place[begin:end], strings[begin:end].astype(np.int64), pieces[begin:end]))
                yield spans(held)
                held, rows, begin = [], 0, end
        if begin < len(anchor):
            held.append((doc[begin:], place[begin:], strings[begin:].astype(np.int64), pieces[begin:]))
            rows += len(anchor) - begin
        last = anchor[-1]
    if held:
        yield spans(held)


def _tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): the tag tells rows of one doc_id with different texts apart."""
    tag = F.shiftrightunsigned(F.xxhash64("text"), 44)
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", tag.alias("tag"), "text")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, begin, length) of spans of bytes to remove; spans may overlap or touch."""
    rows = _tagged(docs)
    segmented = (
        rows.mapInArrow(_segment_rows, _ROWS).repartition("anchor").sortWithinPartitions("known", "anchor", "whole", "doc_id")
    )
    found = written(segmented.mapInArrow(_judge_segments, _FOUND))
    again = found.where("NOT open").select("doc_id", "place", (F.col("strings") + SPAN - 1).alias("length"))
    open_ = found.where("open").select("anchor", "doc_id", "place", "strings")
    tag, begin = F.shiftright("place", 40), F.col("place").bitwiseAND((1 << 40) - 1)
    piece = F.substring(F.col("text").cast("binary"), (begin + 1).cast("int"), F.col("strings") + SPAN - 1)
    texts = rows.withColumnRenamed("doc_id", "of").withColumnRenamed("tag", "own")
    pieces = written(
        open_.join(texts, (F.col("doc_id") == F.col("of")) & (tag == F.col("own"))).select(
            "anchor", "doc_id", "place", "strings", piece.alias("piece")
        )
    )
    hot = written(
        pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT_SEGMENTS).select("anchor")
    )
    resolved = (
        pieces.join(hot, "anchor", "left_anti")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_resolve, "doc_id long, place long, length int")
    )
    spans = again.unionByName(written(resolved))
    if not hot.isEmpty():
        each = pieces.join(hot, "anchor", "left_semi").select(
            "doc_id", "place", "piece", F.explode(F.sequence(F.lit(0), F.col("strings") - 1)).alias("at")
        )
        each = each.select("doc_id", (F.col("place") + F.col("at")).alias("place"), F.expr(f"substring(piece, at + 1, {SPAN})").alias("s"))
        first = each.groupBy("s").agg(F.min("doc_id").alias("first"))
        late = each.join(first, "s").where(F.col("doc_id") > F.col("first"))
        spans = spans.unionByName(late.select("doc_id", "place", F.lit(SPAN).alias("length")))
    return spans.select("doc_id", tag.alias("tag"), begin.alias("begin"), "length")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept, n_bytes, spans) for every row of `docs` (doc_id, text).

    `kept` are the bytes of the text that stay, `spans` the removed runs as (begin, end), merged
    and in order. A null text is empty. Rows that repeat a doc_id have no order among each other,
    so neither takes bytes from the other; a row without a doc_id keeps everything and takes
    nothing. An empty table gives no rows.
    """
    merged = (
        repeated_spans(docs)
        .groupBy("doc_id", "tag")
        .agg(F.sort_array(F.collect_list(F.struct("begin", "length"))).alias("spans"))  # of one document
        .select(F.col("doc_id").alias("of"), F.col("tag").alias("own"), F.col("spans.begin").alias("begins"), F.col("spans.length").alias("lengths"))
    )
    rows = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 44).alias("tag"), "text")

    def cut(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            kept, runs = [], []
            for text, begins, lengths in zip(texts, batch.column("begins"), batch.column("lengths"), strict=True):
                if not begins.is_valid:
                    kept.append(text)
                    runs.append([])
                    continue
                steps = np.zeros(len(text) + 1, dtype=np.int64)
                begin = begins.values.to_numpy()
                np.add.at(steps, begin, 1)
                np.subtract.at(steps, begin + lengths.values.to_numpy(), 1)
                gone = np.concatenate([[False], np.cumsum(steps[:-1]) > 0, [False]])
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone[1:-1]].tobytes())
                edges = np.flatnonzero(gone[1:] != gone[:-1])
                runs.append([{"begin": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(kept, pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "kept", "n_bytes", "spans"],
            )

    joined = rows.join(written(merged), (F.col("doc_id") == F.col("of")) & (F.col("tag") == F.col("own")), "left")
    return joined.select("doc_id", "text", "begins", "lengths").mapInArrow(
        cut, "doc_id long, kept binary, n_bytes long, spans array<struct<begin: long, end: long>>"
    )
