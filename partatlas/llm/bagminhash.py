"""Near-duplicate documents by weighted MinHash of their word-shingle multisets.

BagMinHash: every shingle that occurs w times owns Poisson processes over the count levels
1, 2, 3-4, 5-8, …, each seeded by shingle and level range; the range that w cuts is thinned
to the levels up to w. A signature component is the earliest point that falls on it, and a
process stops as soon as its next point comes later than every component held so far. Two
documents agree in a component with the probability of their weighted Jaccard similarity,
sum of the smaller counts over sum of the larger ones.

Half of a signature is cut into bands. In each bucket of a band every document meets one
leader, the pair is verified by the exact multisets of both, and the pairs found are
connected. The leader is the member whose buckets hold most documents altogether: of copies
that were edited apart, that is the text between them. Buckets that still hold documents of
several components are compared member by member, in cells of bounded size, by their whole
signatures, and pairs that agree enough are verified in their cell until links connect them; so
the leaders lose no link of components, and within one component nothing is left to compare. Documents with equal word sequences are one
document in all of this.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas.llm.common import SHINGLE, WordHashes, as_bytes, hashed_words, mixed, sub_batches, written
from partatlas.operators.graph import connected_components

BANDS, BAND_ROWS = 25, 5  # finds a pair at 0.8 with probability 1 - 5e-5
COMPONENTS = 250
SIMILARITY = 0.8
SLACK = 4.0  # standard deviations that the agreement of a similar pair may fall short
LEADER_PAIRS = 500  # verified per piece of a leader
CELL_ROWS = 4096
TEXT_ROWS = 256  # documents of a chunk that are held with their texts

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(flat, ends):
    """(hashes, offsets) of all word shingles of texts given by `hashed_words`.

    A text of one to four words has one shingle, all of its words.
    """
    counts = np.diff(ends)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(ends[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(counts, SHINGLE), n)
    out = np.zeros(len(first), dtype=np.uint64)
    padded = np.concatenate([flat, np.zeros(SHINGLE, dtype=np.uint64)])
    for k in range(SHINGLE):
        out = np.where(k < length, mixed(out * np.uint64(31) + padded[first + k] + np.uint64(k + 1)), out)
    return out, offsets


def _uniform(bits):
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(hashes, offsets):
    """Signatures (texts, COMPONENTS) of the shingle multisets of texts; empty texts get zeros."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    keys, weight = np.unique(of << np.uint64(44) | hashes >> np.uint64(20), return_counts=True)
    of = (keys >> np.uint64(44)).astype(np.int64)
    ranges = np.ceil(np.log2(weight)).astype(np.int64) + 1
    row = np.repeat(np.arange(len(keys)), ranges)
    level = np.arange(len(row)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    below = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))  # counts under the range
    width = np.maximum(below, 1)
    of, weight = of[row], weight[row]
    seed = mixed(keys[row] & np.uint64((1 << 44) - 1)) + mixed(level.astype(np.uint64) + np.uint64(1))
    least = np.full(n * COMPONENTS, np.inf)
    holder = np.zeros(n * COMPONENTS, dtype=np.uint64)
    time = np.zeros(len(row))
    k = 0
    while len(of):
        k += 1
        bits = mixed(seed + np.uint64(k * int(_STEP) & (1 << 64) - 1))
        time = time - np.log(_uniform(bits)) / width
        where = mixed(bits ^ _STEP)
        slot = of * COMPONENTS + (((where >> np.uint64(32)) * np.uint64(COMPONENTS)) >> np.uint64(32)).astype(np.int64)
        at = below + (((where & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        counts = np.flatnonzero((at < weight) & (time < least[slot]))
        slot, when = slot[counts], time[counts]
        np.minimum.at(least, slot, when)
        won = least[slot] == when
        holder[slot[won]] = bits[counts][won]
        latest = least.reshape(n, COMPONENTS).max(axis=1)
        going = time < latest[of]
        of, weight, below, width, seed, time = (x[going] for x in (of, weight, below, width, seed, time))
    return holder.reshape(n, COMPONENTS)


def _band_keys(signatures):
    rows = signatures[:, : BANDS * BAND_ROWS].reshape(len(signatures), BANDS, BAND_ROWS)
    keys = np.zeros((len(signatures), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = mixed(keys * np.uint64(33) + rows[:, :, k])
    return keys.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, bands, sketch): word-sequence hash, shingles, band keys, low bytes."""

    def sign(batches):
        import xxhash

        known = WordHashes()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for begin, end in sub_batches(texts):
                flat, ends = hashed_words(texts[begin:end], known)
                hashes, offsets = shingle_hashes(flat, ends)
                signatures = bag_signatures(hashes, offsets)
                keys = _band_keys(signatures).ravel()
                digests = [xxhash.xxh3_128_digest(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
                n = np.diff(offsets)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(end - begin + 1, dtype=np.int32) * BANDS), pa.array(keys))
                sketch = [row.tobytes() for row in signatures.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, end - begin),
                        pa.array(digests, pa.binary()),
                        pa.array(n),
                        bands,
                        pa.array(sketch, pa.binary()),
                    ],
                    names=["doc_id", "digest", "n", "bands", "sketch"],
                )

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return rows.mapInArrow(sign, "doc_id long, digest binary, n long, bands array<long>, sketch binary")


def _counted(text, known):
    flat, ends = hashed_words([text], known)
    return np.unique(shingle_hashes(flat, ends)[0], return_counts=True)


def similarity(a, b):
    """Weighted Jaccard similarity of two (distinct hashes, counts)."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][at_a], b[1][at_b]).sum()
    whole = a[1].sum() + b[1].sum() - common
    return common / whole if whole else 1.0


def verified(pairs: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(src, dst) of the pairs (a, b) whose documents reach the similarity.

    All pairs of one `a` meet in a task that holds the text of `a` and reads the others as a
    stream; an `a` with many pairs is cut into pieces that each get its text.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    pieces = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEADER_PAIRS).cast("int").alias("pieces"))
    leaders = pieces.select("a", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("a").alias("b"))
    members = pairs.join(pieces, "a").select("a", F.pmod(F.xxhash64("b"), "pieces").cast("int").alias("piece"), "b")
    rows = (
        leaders.unionByName(members)
        .join(texts.hint("merge"), F.col("b") == F.col("doc_id"))  # one plan at every size
        .select("a", "piece", (F.col("a") != F.col("b")).alias("member"), "b", "text")
        .repartition("a", "piece")
        .sortWithinPartitions("a", "piece", "member", "b")
    )

    def verify(batches):
        known, key, held = WordHashes(), None, []
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            src, dst = [], []
            columns = (batch.column(c).to_pylist() for c in ("a", "piece", "member", "b"))
            for a, piece, member, b, text in zip(*columns, texts, strict=True):
                if (a, piece) != key:
                    key, held = (a, piece), []
                bag = _counted(text, known)
                if not member:
                    held.append(bag)
                elif any(similarity(x, bag) >= least for x in held):
                    src.append(a)
                    dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return rows.mapInArrow(verify, "src long, dst long")


def _buckets(groups: DataFrame) -> DataFrame:
    """(key, rep, rows) of all buckets with several documents."""
    members = groups.where(F.col("n") > 0).select("rep", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return members.join(shared, "key")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with the leader of the bucket, each pair once."""
    central = members.groupBy("rep").agg(F.sum("rows").alias("around"))
    order = F.struct("around", F.xxhash64("rep").alias("o"), "rep")
    leaders = members.join(central, "rep").groupBy("key").agg(F.max(order).alias("lead")).select("key", F.col("lead.rep").alias("a"))
    return members.join(leaders, "key").where(F.col("a") != F.col("rep")).select("a", F.col("rep").alias("b")).distinct()


def _cells(members: DataFrame, size: int) -> DataFrame:
    """`members` (key, rows, rep, …) with their chunk, once for every cell (key, i, j) of two chunks of about `size`."""
    chunks = F.ceil(F.col("rows") / size).cast("int")
    return (
        members.withColumn("chunk", F.pmod(F.xxhash64("rep", "key"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
        .drop("other", "rows")
    )


def _agreeing(key, table, least):
    """(x, all y of another component that agree enough with x) of the rows of a cell.

    Two documents are compared in the first bucket that they share only.
    """
    agreeing = int(COMPONENTS * least - SLACK * (COMPONENTS * least * (1 - least)) ** 0.5)
    comp, chunk = (table.column(c).to_numpy() for c in ("comp", "chunk"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, COMPONENTS)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    bucket, i, j = (k.as_py() for k in key)
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    for x in left:
        y = right[comp[right] > comp[x]] if i == j else right[comp[right] != comp[x]]
        y = y[(sketch[y] == sketch[x]).sum(axis=1) >= agreeing]
        if len(y):
            y = y[bands[x][(bands[y] == bands[x]).argmax(axis=1)] == bucket]
        if len(y):
            yield x, y


def _open_links(members: DataFrame, sketches: DataFrame, docs: DataFrame, least: float) -> DataFrame | None:
    """(src, dst): links between different components of a bucket, no more in a cell than connect its components.

    `members` has key, rep, rows and comp. Cells compare the signatures as matrices and name the documents
    that agree with one of another component; these meet once more, in smaller cells and with their
    texts, where a pair is verified unless links found before connect it. None if no document agrees.
    """
    mixed_ = (
        members.groupBy("key")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where(F.col("low") < F.col("high"))
        .select("key")
    )

    def named(key, table):
        at = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(np.append(y, x) for x, y in _agreeing(key, table, least))]))
        return table.select(["key", "rep", "comp"]).take(pa.array(at))

    def linked(key, table):
        rep, comp = (table.column(c).to_pylist() for c in ("rep", "comp"))
        texts, known, bags, parent = as_bytes(table.column("text")), WordHashes(), {}, {}
        src, dst = [], []

        def root(c):
            while (up := parent.get(c, c)) != c:
                parent[c] = parent.get(up, up)
                c = up
            return c

        for x, others in _agreeing(key, table, least):
            for y in others:
                a, b = root(comp[x]), root(comp[y])
                if a == b:
                    continue
                for k in (x, y):
                    if k not in bags:
                        bags[k] = _counted(texts[k], known)
                if similarity(bags[x], bags[y]) >= least:
                    parent[max(a, b)] = min(a, b)
                    src.append(rep[x])
                    dst.append(rep[y])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    cells = _cells(members.join(mixed_, "key").join(sketches, "rep"), CELL_ROWS)
    near = written(cells.groupBy("key", "i", "j").applyInArrow(named, "key long, rep long, comp long").distinct())
    if near.isEmpty():
        return None
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    wanted = near.select(F.col("rep").alias("doc_id")).distinct()
    found = written(texts.hint("merge").join(wanted, "doc_id", "left_semi").distinct())
    sized = near.join(near.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), "key")
    with_text = (
        _cells(sized, min(TEXT_ROWS, CELL_ROWS))
        .join(sketches, "rep")
        .join(found.hint("merge"), F.col("rep") == F.col("doc_id"))
        .drop("doc_id")
    )
    return with_text.groupBy("key", "i", "j").applyInArrow(linked, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id, kept) for every row of `docs` (doc_id, text).

    Documents with a weighted Jaccard similarity of at least `least` are linked, and
    `component_id` is the smallest doc_id of everything linked; `kept` marks that document.
    Texts without words are equal to each other; texts of one to four words have one shingle.
    A null text has no words. Rows that repeat a doc_id are one document, which shares the
    smallest class of its texts. Rows without a doc_id are compared with
    nothing and kept.
    """
    sig = written(signed(docs))
    groups = written(
        sig.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")
        )
    )
    buckets = written(_buckets(groups))
    edges = written(verified(written(_leader_pairs(buckets)), docs, least))
    comps = written(connected_components(edges))
    with_comp = buckets.join(comps, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "rows", F.coalesce("component", "rep").alias("comp")
    )
    more = _open_links(with_comp, groups.select("rep", "sketch", "bands"), docs, least)
    if more is not None:
        edges = edges.unionByName(written(more))
        comps = written(connected_components(edges))
    members = sig.select("doc_id", "digest").join(groups.select("digest", "rep"), "digest").select("doc_id", "rep")
    found = (
        members.join(comps, F.col("rep") == F.col("node"), "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
