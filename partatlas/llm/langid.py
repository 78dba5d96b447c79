"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a gap, and every run of one to three characters
of the result is hashed to one of 2^BITS features. A language is a row of log
probabilities; their matrix goes to every task. Batches of texts become sparse counts of
(document, feature) by sorting, and scores are sums over them. Log probabilities are rounded
to whole numbers of 2^-16, so a score does not depend on how rows are batched.

The model is counted on a sample of at most `sample` documents per language, chosen by the
hash of their ids; prediction covers every document and whole texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partatlas.llm.common import as_bytes, mixed, sub_batches

BITS = 16
ORDERS = (1, 2, 3)
SAMPLE = 4_000
SMOOTH = 0.5
UNIT = 1 << 16
MAX_LANGS = 1_000  # the matrix has 2^BITS numbers of four bytes a language: 262 MB at most
SLICE = 1 << 20  # characters whose n-grams are sorted at a time
UNKNOWN = "und"

_folds = []


def _fold_table():
    """Of every 16-bit code point: its lower case, or 0 if it is no letter."""
    if not _folds:
        table = np.zeros(1 << 16, dtype=np.uint32)
        for point in range(1 << 16):
            char = chr(point)
            if char.isalpha():
                table[point] = ord(char.lower()[0])
        _folds.append(table)
    return _folds[0]


def folded(texts):
    """(characters, offsets by text): lower-case letters with one gap (0) before, between and after words."""
    table = _fold_table()
    parts = ["\0" + t.decode("utf-8", "replace") + "\0" for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    chars = table[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        known = {int(p): ord(chr(p).lower()[0]) if chr(p).isalpha() else 0 for p in np.unique(points[high])}
        chars[high] = [known[int(p)] for p in points[high]]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    first = np.zeros(len(chars), dtype=bool)
    first[starts[:-1]] = True
    keep = (chars != 0) | first | np.concatenate([[True], chars[:-1] != 0])
    offsets = np.concatenate([[0], np.cumsum(keep)])[starts]
    return chars[keep], offsets


def ngrams(chars, offsets):
    """Yields (document, feature, count) of slices of the text: every n-gram that starts there and has a letter."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:][of]
    for begin in range(0, len(chars), SLICE):
        end = min(begin + SLICE, len(chars))
        docs, keys = of[begin:end].astype(np.uint64), []
        gram = np.zeros(end - begin, dtype=np.uint64)
        at = np.arange(begin, end)
        lettered = np.zeros(end - begin, dtype=bool)
        for order in range(1, max(ORDERS) + 1):
            inside = at + order <= ends[begin:end]
            char = chars[np.minimum(at + order - 1, len(chars) - 1)]
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + char + np.uint64(1)
            lettered |= inside & (char != 0)
            if order in ORDERS:
                use = inside & lettered
                feature = mixed(gram[use] + np.uint64(order)) >> np.uint64(64 - BITS)
                keys.append(docs[use] << np.uint64(BITS) | feature)
        found, counts = np.unique(np.concatenate(keys), return_counts=True)
        yield (found >> np.uint64(BITS)).astype(np.int64), (found & np.uint64((1 << BITS) - 1)).astype(np.int64), counts


class Model:
    """Languages in code point order and their log probabilities, [language, feature], in units of 1/UNIT."""

    def __init__(self, langs, matrix, prior):
        self.langs, self.matrix, self.prior = langs, matrix, prior


def feature_counts(docs: DataFrame) -> DataFrame:
    """(lang, feature, n) over documents (lang, text): n-grams by language."""

    def count(batches):
        totals = {}
        for batch in batches:
            texts, langs = as_bytes(batch.column("text")), batch.column("lang").to_pylist()
            for begin, end in sub_batches(texts):
                for of, feature, n in ngrams(*folded(texts[begin:end])):
                    names, which = np.unique(np.array(langs[begin:end], dtype=object), return_inverse=True)
                    for k, lang in enumerate(names):
                        own = which[of] == k
                        totals.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                        totals[lang] += np.bincount(feature[own], n[own], 1 << BITS).astype(np.int64)
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                names=["lang", "feature", "n"],
            )

    parts = docs.select("lang", "text").mapInArrow(count, "lang string, feature int, n long")
    return parts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of the languages of `docs` (doc_id, text, lang); rows without text or language teach nothing.

    Of each language the `sample` documents whose ids hash lowest are counted. How common a
    language is comes from all rows. A language whose sample has no letters is not learned.
    """
    rated = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), "text"
    )
    sizes = {r["lang"]: r["n"] for r in rated.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: is this column the language?")
    order = Window.partitionBy("lang").orderBy("hash", "id")
    chosen = (
        rated.select("lang", "id", F.xxhash64("id").alias("hash"))
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= sample)
        .select(F.col("lang").alias("of_lang"), F.col("id").alias("of_id"))
        .distinct()
    )
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("lang") == F.col("of_lang"))
    found = feature_counts(rated.join(F.broadcast(chosen), same, "left_semi")).collect()  # 2^BITS a language at most
    langs = sorted({r["lang"] for r in found})
    counts = np.zeros((1 << BITS, len(langs)))
    for r in found:
        counts[r["feature"], langs.index(r["lang"])] = r["n"]
    shares = np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * (1 << BITS)))
    prior = np.log(np.array([sizes[x] for x in langs], dtype=np.float64) / max(1, sum(sizes[x] for x in langs)))
    return Model(langs, np.rint(shares.T * UNIT).astype(np.int32), np.rint(prior * UNIT).astype(np.int64))


def scores(texts, model: Model):
    """Scores [document, language] of byte strings, in units of 1/UNIT, and whether each has a letter."""
    total = np.tile(model.prior, (len(texts), 1))
    lettered = np.zeros(len(texts), dtype=bool)
    for begin, end in sub_batches(texts):
        chars, offsets = folded(texts[begin:end])
        for of, feature, n in ngrams(chars, offsets):
            if not len(of):
                continue
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            lettered[begin + of[first]] = True
            for lang in range(len(model.langs)):
                total[begin + of[first], lang] += np.add.reduceat(model.matrix[lang][feature] * n, first)
    return total, lettered


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` with lang_pred and score, the probability of that language.

    A null text, one without a letter, or a model without languages gives `und` with score 0;
    ties go to the language that comes first. Very long texts are scored whole, slice by
    slice; repeated rows get equal results, an empty table none. Only `text` is looked at.
    Columns named lang_pred or score are replaced, all others are handed on.
    """
    own = ["lang_pred", "score"]
    rows = docs.drop(*own)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.matrix, model.prior))  # bounded by MAX_LANGS

    def predict(batches):
        known = Model(*shared.value)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            if known.langs:
                total, lettered = scores(texts, known)
                best = total.argmax(axis=1)
                away = (total - total[np.arange(len(texts)), best][:, None]) / UNIT
                share = 1 / np.exp(np.maximum(away, -700.0)).sum(axis=1)
            else:
                best, share, lettered = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [known.langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(np.where(lettered, share, 0.0))],
                names=[*batch.schema.names, *own],
            )

    return rows.mapInArrow(predict, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id modulo 3 is 1, or it has no id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))
