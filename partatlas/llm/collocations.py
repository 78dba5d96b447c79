"""Phrases whose words keep together, mined level by level over ranked ids.

Level 1 are words, level k the phrases of k words. What occurs often enough at a level gets
an id by falling frequency (bucket by bucket, interleaved). Two neighbouring ids of level k that overlap in all but one word
form a phrase of level k + 1, so every level does the same: put ids in the place of
what a text holds there, count neighbouring pairs, keep the frequent ones, rank them anew.

Texts are laid out in splits of some million words that later levels read as arrays. A
split counts its pairs in tiles of ids: a tile that many pairs fall into is an array that a
pair addresses directly (ids are ranked by frequency, so these are the first tiles), the pairs
of all others are sorted. Counts of all splits meet in buckets of hashed pairs, so a bucket
has its share of pairs however frequent any of them is. It ranks its frequent pairs and tells
every split which of its pairs these are, so no table of ids has to fit into a task.
"""

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partatlas.llm.common import as_bytes, freed_shuffles, mixed, new_folder, written

LEAST = 30
LONGEST = 4
FIRST = 2_000
SCALE = 2_000_000
UNKNOWN = "und"

CUT = b"\xff"  # no byte of UTF-8; stands for the end of a piece
WORD_BYTES = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
LONG = 1 << 22  # bytes of a text that are split at a time
SPLIT_WORDS = 1 << 21
BUCKET_WORDS = 1 << 20
WORD_BUCKETS = 4  # buckets of words for each of pairs
TILE_BITS = 11
DENSE_TILES = 8  # tiles on either side that may be dense
DENSE_SHARE = 32  # a tile is dense if it has a pair for every so many of its fields

_SEQ = "split long, kind string, lang string, word string, local int, n long, ids binary"
_BLOCK = "split long, kind string, bucket int, first int, codes binary, counts binary, ids binary"
_FOUND = "kind string, lang string, word string, a long, b long, f long, id long, split long, locals binary, ids binary"


def _segments(text: bytes):
    """The words of a text with `CUT` for the ends of its pieces, some megabytes at a time."""
    begin = 0
    while begin < len(text):
        end = begin + LONG
        if end < len(text):
            cut = max(text.rfind(mark, begin, end) for mark in (b" ", b"\t", b"\n", b"."))
            later = [x for x in (text.find(mark, end) for mark in (b" ", b"\t", b"\n", b".")) if x >= 0]
            end = cut if cut > begin else min(later, default=len(text))
        yield text[begin:end].translate(WORD_BYTES).replace(CUT, b" \xff ").split()
        begin = end


def word_splits(docs: DataFrame, split_words: int | None = None) -> DataFrame:
    """Rows of kind `seq` (split, ids) and `item` (split, lang, word, local, n), written once.

    `ids` are the words of a split as numbers of that split, 0 between pieces and documents.
    A split ends at the end of a piece.
    """
    split_words = split_words or SPLIT_WORDS

    def number(index, batches):
        split = index << 24
        ids, held, words, next_id = [], 0, {}, count(1)

        def vocabulary(lang):
            if lang not in words:
                words[lang] = defaultdict(next_id.__next__)
                words[lang][CUT] = 0
            return words[lang]

        def flush():
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            found = np.bincount(flat, minlength=1)
            for lang, known in words.items():
                del known[CUT]
                locals_ = np.fromiter(known.values(), np.int32, len(known))
                yield _batch(
                    _SEQ, len(known), split=split, kind="item", lang=lang, local=locals_, n=found[locals_].astype(np.int64),
                    word=pa.array(list(known), pa.binary()).cast(pa.string()),
                )
            yield _batch(_SEQ, 1, split=split, kind="seq", ids=[flat.tobytes()])

        for batch in batches:
            for text, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
                known = vocabulary(lang)
                for tokens in _segments(text):
                    ids.append(np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens)))
                    held += len(tokens)
                    if held >= split_words and tokens and tokens[-1] == CUT:
                        yield from flush()
                        split, ids, held, words, next_id = split + 1, [], 0, {}, count(1)
                        known = vocabulary(lang)
                ids.append(np.zeros(1, np.int32))
                if held >= split_words:
                    yield from flush()
                    split, ids, held, words, next_id = split + 1, [], 0, {}, count(1)
        if held:
            yield from flush()

    def run(batches):
        from pyspark import TaskContext

        yield from number(TaskContext.get().partitionId(), batches)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    return _levelled(rows.mapInArrow(run, _SEQ), "words")


def _batch(schema: str, rows: int, **columns):
    """A record batch of the schema; single values are repeated, what is not given is null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, arrays = [], []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        value = columns.get(name)
        if value is None or isinstance(value, (int, str)):
            value = [value] * rows
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value, kinds[kind]))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _levelled(rows: DataFrame, name: str) -> DataFrame:
    """`rows` written and read back; arrays of some megabytes make the writer look at its memory by row."""
    spark = rows.sparkSession
    path = new_folder(spark, name)
    with freed_shuffles(spark):
        rows.write.option("parquet.block.size.row.check.min", "1").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def count_pairs(a, b):
    """(codes, counts, place of every pair) of id pairs; codes are a * 2^32 + b, in no order.

    Tiles of ids that many pairs fall into are counted by address, the others by sorting.
    """
    size, place = 1 << TILE_BITS, np.full(len(a), -1, dtype=np.int64)
    codes, counts, n = [], [], 0
    low = np.flatnonzero((a < DENSE_TILES * size) & (b < DENSE_TILES * size))
    tile = (a[low] >> TILE_BITS) * DENSE_TILES + (b[low] >> TILE_BITS)
    for t in np.flatnonzero(np.bincount(tile, minlength=1) * DENSE_SHARE >= size * size):
        own = low[tile == t]
        field = (a[own] & (size - 1)) << TILE_BITS | (b[own] & (size - 1))
        table = np.bincount(field, minlength=size * size)
        used = np.flatnonzero(table)
        number = np.zeros(size * size, dtype=np.int64)
        number[used] = np.arange(n, n + len(used))
        place[own] = number[field]
        first, second = (t // DENSE_TILES) << TILE_BITS, (t % DENSE_TILES) << TILE_BITS
        codes.append(((used >> TILE_BITS) + first) << 32 | (used & (size - 1)) + second)
        counts.append(table[used])
        n += len(used)
    rest = np.flatnonzero(place < 0)
    found, number, times = np.unique(a[rest] << 32 | b[rest], return_inverse=True, return_counts=True)
    place[rest] = number + n
    return np.concatenate([*codes, found]), np.concatenate([*counts, times]), place


def _bucket_of(codes, buckets):
    return (mixed(codes.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def next_level(sequences: DataFrame, maps: DataFrame, buckets: int) -> DataFrame:
    """Rows of kind `seq` and `block` (split, bucket, first, codes, counts) of the next level.

    `maps` (split, locals, ids) are the frequent items of every split. The pairs of a split are
    numbered bucket by bucket from 1; `first` is the number of a block's first pair.
    """

    def pair(key, own, known):
        split = key[0].as_py()
        local = np.frombuffer(b"".join(known.column("locals").to_pylist()), np.int32)
        ident = np.frombuffer(b"".join(known.column("ids").to_pylist()), np.int64)
        for sequence in own.column("ids").to_pylist():
            items = np.frombuffer(sequence, np.int32)
            table = np.full(max(int(items.max(initial=0)), int(local.max(initial=0))) + 1, -1, np.int64)
            table[local] = ident
            held = table[items]
            at = np.flatnonzero((held[:-1] >= 0) & (held[1:] >= 0))
            codes, counts, place = count_pairs(held[at], held[at + 1])
            bucket = _bucket_of(codes, buckets)
            order = np.lexsort((codes, bucket))
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(1, len(order) + 1)
            following = np.zeros(max(len(items) - 1, 0), np.int32)
            following[at] = number[place]
            codes, counts, bucket = codes[order], counts[order].astype(np.int32), bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = list(zip(starts, [*starts[1:], len(codes)]))
            if cuts:
                yield _batch(
                    _BLOCK, len(cuts), split=split, kind="block", bucket=bucket[starts].astype(np.int32),
                    first=(starts + 1).astype(np.int32),
                    codes=[codes[x:y].tobytes() for x, y in cuts], counts=[counts[x:y].tobytes() for x, y in cuts],
                )
                yield _batch(_BLOCK, 1, split=split, kind="seq", ids=[following.tobytes()])

    def whole(key, own, known):
        parts = list(pair(key, own, known))
        schema = _batch(_BLOCK, 0).schema
        return pa.Table.from_batches(parts, schema)

    left = sequences.select("split", "ids").groupBy("split")
    right = maps.select(F.col("split").alias("of"), "locals", "ids").groupBy("of")
    return _levelled(left.cogroup(right).applyInArrow(whole, _BLOCK), "level")


def _found(columns, f, code, split, local, least, bucket, buckets):
    """Table of a bucket: the frequent keys with their ids, and for every split its frequent items.

    `code` numbers the keys of the rows from 0, `f` counts each key, `columns` are the keys'
    fields. The k-th most frequent key of a bucket has the id k * buckets + bucket: keys are dealt
    into buckets by hash, so that follows the frequency over all buckets as well.
    """
    often = np.flatnonzero(f >= least)
    often = often[np.argsort(-f[often], kind="stable")]
    ident = np.full(len(f), -1, np.int64)
    ident[often] = np.arange(len(often)) * buckets + bucket
    keep = np.flatnonzero(ident[code] >= 0)
    keep = keep[np.argsort(split[keep], kind="stable")]
    split, local, ids = split[keep], local[keep].astype(np.int32), ident[code[keep]]
    starts = np.flatnonzero(np.diff(split, prepend=-1))
    cuts = list(zip(starts, [*starts[1:], len(split)]))
    fields = {name: values.take(pa.array(often)) for name, values in columns.items()}
    schema = _batch(_FOUND, 0).schema
    keys = _batch(_FOUND, len(often), kind="key", f=f[often], id=ident[often], **fields)
    maps = _batch(
        _FOUND, len(cuts), kind="map", split=split[starts],
        locals=[local[x:y].tobytes() for x, y in cuts], ids=[ids[x:y].tobytes() for x, y in cuts],
    )
    return pa.Table.from_batches([keys, maps], schema)


def frequent_words(items: DataFrame, least: int, buckets: int) -> DataFrame:
    """Rows of kind `key` (lang, word, f, id) and `map` (split, locals, ids) of the frequent words."""

    def add(key, rows):
        names = [rows.column(c).combine_chunks().cast(pa.binary()) for c in ("lang", "word")]
        known = pc.binary_join_element_wise(*names, CUT).dictionary_encode()
        code = known.indices.to_numpy()
        _, first = np.unique(code, return_index=True)
        columns = {c: rows.column(c).combine_chunks().take(pa.array(first)) for c in ("lang", "word")}
        f = np.zeros(len(first), np.int64)
        np.add.at(f, code, rows.column("n").to_numpy())
        split, local = rows.column("split").to_numpy(), rows.column("local").to_numpy()
        return _found(columns, f, code, split, local, least, key[0].as_py(), buckets)

    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = items.select(bucket, "split", "lang", "word", "local", "n")
    return _levelled(dealt.groupBy("bucket").applyInArrow(add, _FOUND), "frequent")


def frequent_pairs(blocks: DataFrame, least: int, buckets: int) -> DataFrame:
    """Rows of kind `key` (a, b, f, id) and `map` (split, locals, ids) of the frequent pairs."""

    def add(key, rows):
        lengths = [len(x) // 8 for x in rows.column("codes").to_pylist()]
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.int64)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.int32)
        split = np.repeat(rows.column("split").to_numpy(), lengths)
        starts = np.cumsum([0, *lengths[:-1]])
        local = np.arange(len(codes)) + np.repeat(rows.column("first").to_numpy() - starts, lengths)
        found, code = np.unique(codes, return_inverse=True)
        f = np.zeros(len(found), np.int64)
        np.add.at(f, code, counts)
        columns = {"a": pa.array(found >> 32), "b": pa.array(found & 0xFFFFFFFF)}
        return _found(columns, f, code, split, local, least, key[0].as_py(), buckets)

    dealt = blocks.select("bucket", "split", "first", "codes", "counts")
    return _levelled(dealt.groupBy("bucket").applyInArrow(add, _FOUND), "frequent")


def _keys(found: DataFrame, *columns: str) -> DataFrame:
    keys = found.where("kind = 'key'").select(*columns, "f", "id")
    if (keys.agg(F.max("id").alias("m")).first()["m"] or 0) >= 1 << 31:
        raise ValueError("more frequent phrases of one length than ids")
    return keys


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases by length, and (lang, n) with the words of every language.

    The first table is (lang, word, f, id), the others are (a, b, f, id): the phrase begins with
    the phrase `a` of the level before and ends with its phrase `b`.
    """
    table = word_splits(docs)
    items = table.where("kind = 'item'").select("split", "lang", "word", "local", "n")
    sizes = written(items.groupBy("lang").agg(F.sum("n").alias("n")))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // BUCKET_WORDS))
    found = frequent_words(items, least, WORD_BUCKETS * buckets)
    levels = [_keys(found, "lang", "word")]
    for _ in range(2, longest + 1):
        maps = found.where("kind = 'map'").select("split", "locals", "ids")
        table = next_level(table.where("kind = 'seq'"), maps, buckets)
        found = frequent_pairs(table.where("kind = 'block'"), least, buckets)
        levels.append(_keys(found, "a", "b"))
    return levels, sizes


def _lower(found: Column, left: Column, right: Column) -> Column:
    """Score of a cut: floor(SCALE * a / (l + r)), over decimals."""
    top = found.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", top, (left + right).cast("decimal(20,0)"))


def _cut(number: int, a: Column, left: Column, right: Column) -> Column:
    """A cut as a struct: the least one has the lowest score, then the fewest words before it."""
    return F.struct(_lower(a, left, right).alias("score"), F.lit(number).alias("k"), left.alias("l"), right.alias("r"))


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of two to four words of every language.

    Words are what stands between blanks and tabs in the pieces that full stops, commas,
    semicolons, colons, exclamation and question marks and line ends cut from a text; A to Z are
    lower-cased. A phrase that occurs `a` times, `least` at least, is cut where 2,000,000 * a / (l + r)
    is lowest, l and r being the occurrences of the two parts. A phrase inside a longer one that
    occurs `share` percent as often is left out.

    Null texts are empty, a null language is `und`, repeated rows count repeatedly, an empty
    table gives no rows, texts and pieces of any length are taken whole, other columns are not
    looked at. Equal scores are ranked by falling `a`, then by phrase in byte order.
    """
    (words, pairs, triples, quads), sizes = frequent_phrases(docs, least)

    def ends(found: DataFrame, below: DataFrame) -> DataFrame:
        """Every phrase (f: occurrences) with what is known of its beginning x and its end y."""
        x, y = below.alias("x"), below.alias("y")
        return found.alias("p").join(x, F.col("p.a") == F.col("x.id")).join(y, F.col("p.b") == F.col("y.id"))

    def known(joined: DataFrame, cuts: list, extra: dict) -> DataFrame:
        phrase = F.concat_ws(" ", "x.phrase", "y.last")
        kept = {"id": F.col("p.id"), "lang": F.col("x.lang"), "phrase": phrase, "last": F.col("y.last"), "f": F.col("p.f")}
        best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        columns = [c.alias(name) for name, c in {**kept, **extra}.items()]
        return written(joined.select(*columns, F.col("p.a").alias("a_id"), F.col("p.b").alias("b_id"), best.alias("cut")))

    a, fx, fy = F.col("p.f"), F.col("x.f"), F.col("y.f")
    singles = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    two = known(ends(pairs, singles), [_cut(1, a, fx, fy)], {"f_first": fx, "f_last": fy})
    three = known(
        ends(triples, two),
        [_cut(1, a, F.col("x.f_first"), fy), _cut(2, a, fx, F.col("y.f_last"))],
        {"f_first": F.col("x.f_first"), "f_last": F.col("y.f_last"), "f_first_two": fx, "f_last_two": fy},
    )
    four = known(
        ends(quads, three),
        [
            _cut(1, a, F.col("x.f_first"), fy),
            _cut(2, a, F.col("x.f_first_two"), F.col("y.f_last_two")),
            _cut(3, a, fx, F.col("y.f_last")),
        ],
        {},
    )

    def outside(phrases: DataFrame, longer: DataFrame) -> DataFrame:
        """Phrases without a longer one around them; one two words longer implies the one between."""
        around = longer.select(F.explode(F.array("a_id", "b_id")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("around"))
        covered = F.col("around").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * share
        return phrases.join(around, "id", "left").where(~F.coalesce(covered, F.lit(False)))

    columns = ["lang", "phrase", "f", "cut"]
    kept = outside(two, three).select(*columns).unionByName(outside(three, four).select(*columns)).unionByName(four.select(*columns))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (
        kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= first)
    )
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
