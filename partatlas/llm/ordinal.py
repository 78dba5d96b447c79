"""Quality grades by ordinal regression with cumulative links.

P(grade <= k) = 1 / (1 + exp(score - threshold_k)): one score from weights of hashed words
and of shape features, shared by all grades, and thresholds in rising order. The model
gives every document an expected grade and the probability of reaching the top grade,
which decides whether it is kept.

The fit takes a sample of at most `sample` rated documents, chosen by the hash of their
ids, so it fits the driver at any size; scoring covers every document and whole texts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partatlas.llm.common import as_bytes, sub_batches, written

BITS = 18
SHAPES = ("capitals", "symbols", "bars", "marks", "digits", "long", "short", "repeated", "size", "length")
LEVELS = 32
DIMENSIONS = (1 << BITS) + len(SHAPES) * LEVELS
SAMPLE = 12_000
GRADES = 3
KEEP = 0.5
LEAST = 4  # rated documents that a feature has to be in
SCREENED = 4096  # features that enter the fit


def grade_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for bad quality, 1 for good but toxic, 2 for good documents.

    Rows without an id or a quality rate nothing; a document rated repeatedly has its lowest grade.
    """
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(grade).cast("int").alias("grade"))
    )


class WordFeatures(dict):
    """Of every word seen: the features of the word, its first four and five letters, and shape bits."""

    LIMIT = 300_000

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip(".,;:!?\"'()[]*$%&#|…").lower()
        value = 0
        for k, piece in enumerate((core, "4" + core[:4], "5" + core[:5])):
            value |= (xxhash.xxh3_64_intdigest(piece.encode()) & ((1 << BITS) - 1)) << (k * BITS)
        alone = sum(not c.isalnum() for c in text)
        shapes = (
            len(core) > 1 and text.strip(".,;:!?").isupper(),
            alone >= 3,
            text == "|",
            text.endswith("!!"),
            bool(core) and core.isdigit(),
            len(text) > 24,
            len(core) < 2,
        )
        self[word] = value = value | sum(1 << (3 * BITS + k) for k, s in enumerate(shapes) if s)
        return value


def features(texts, known, wanted=None):
    """(documents, features): the distinct features of byte strings, sorted by document.

    `wanted` (a mask of all features) leaves out words that no weight asks for.
    """
    parts = [t.split() for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.fromiter((known[w] for p in parts for w in p), dtype=np.int64, count=int(counts.sum()))
    docs = np.repeat(np.arange(len(parts)), counts)
    low = (1 << BITS) - 1
    keys = []
    for k in range(3):
        word = flat >> (k * BITS) & low
        at = slice(None) if wanted is None or not k else wanted[word]
        keys.append(np.unique(docs[at] << BITS | word[at]))
    n = np.maximum(counts, 1)
    distinct = np.bincount(keys[0] >> BITS, minlength=len(parts))
    keys = np.unique(np.concatenate(keys))
    shares = [np.bincount(docs, flat >> (3 * BITS + k) & 1, len(parts)) / n for k in range(7)]
    shares.append(1 - distinct / n)
    levels = [np.minimum(np.ceil(s * 20), LEVELS - 1).astype(np.int64) for s in shares]
    levels.append(np.ceil(np.log2(n)).astype(np.int64))
    levels.append(np.minimum(np.array([len(t) for t in texts]) // n, LEVELS - 1).astype(np.int64))
    shaped = [(1 << BITS) + k * LEVELS + np.minimum(v, LEVELS - 1) for k, v in enumerate(levels)]
    all_docs = np.concatenate([keys >> BITS, *[np.arange(len(parts))] * len(shaped)])
    all_features = np.concatenate([keys & low, *shaped])
    order = np.argsort(all_docs, kind="stable")
    return all_docs[order].astype(np.int32), all_features[order].astype(np.int32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _start(by_grade):
    """Thresholds of the model without weights, from the number of documents of each grade."""
    share = np.cumsum(by_grade)[:-1] / max(by_grade.sum(), 1)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def _residuals(by_grade):
    """What the model without weights leaves unexplained of a document of each grade."""
    below = np.concatenate([[0.0], _sigmoid(_start(by_grade)), [1.0]])
    return 1 - below[1:] - below[:-1]


def fit(docs, feats, grades, n_features, rounds=400, rate=0.3, sparsity=3e-4):
    """(weights of the features 0 to n_features - 1, thresholds) by adaptive gradient steps with an L1 pull.

    `docs` and `feats` are pairs of a document and a feature that it has, sorted by document.
    """
    n = len(grades)
    w, seen, seen_t = np.zeros(n_features), np.full(n_features, 1e-8), np.full(GRADES - 1, 1e-8)
    thresholds = _start(np.bincount(grades, minlength=GRADES))
    if not n:
        return w, thresholds
    for _ in range(rounds):
        score = np.bincount(docs, w[feats], n)
        upto = _sigmoid(np.concatenate([np.full((1, n), -50.0), thresholds[:, None] - score, np.full((1, n), 50.0)]))
        low, high = upto[grades, np.arange(n)], upto[grades + 1, np.arange(n)]
        mass = np.maximum(high - low, 1e-9)
        slope = np.bincount(feats, (1 - high - low)[docs], n_features) / n
        seen += slope**2
        step = rate / np.sqrt(seen)
        w -= step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparsity, 0)
        pull = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            pull[k] -= (high * (1 - high) / mass)[grades == k].sum() / n
            pull[k] += (low * (1 - low) / mass)[grades == k + 1].sum() / n
        seen_t += pull**2
        thresholds = np.maximum.accumulate(thresholds - rate * pull / np.sqrt(seen_t))
    return w, thresholds


def rated_features(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, grade, features binary) of at most `sample` rated documents."""
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by `sample`

    def extract(batches):
        known = WordFeatures()
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for begin, end in sub_batches(texts):
                of, feats = features(texts[begin:end], known)
                cuts = np.searchsorted(of, np.arange(end - begin + 1))
                lists = [feats[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("grade"), pa.array(lists, pa.binary())],
                    names=["doc_id", "grade", "features"],
                )

    return rated.mapInArrow(extract, "doc_id long, grade int, features binary")


def screened_features(rated: DataFrame, by_grade, least: int = LEAST, most: int = SCREENED):
    """Sorted numbers of the features that best tell the residuals of the model without weights.

    Documents are counted by feature and grade on the executors; features in fewer than `least`
    are left out, and at most `most` come to the driver.
    """

    def count(batches):
        found = np.zeros((GRADES, DIMENSIONS), dtype=np.int64)
        for batch in batches:
            for grade, data in zip(batch.column("grade").to_pylist(), batch.column("features").to_pylist()):
                found[grade, np.frombuffer(data, "<i4")] += 1  # a document has a feature once
        at = np.flatnonzero(found.any(axis=0))
        names = [f"n{g}" for g in range(GRADES)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(c[at]) for c in found]], names=["feature", *names])

    names = [f"n{g}" for g in range(GRADES)]
    parts = rated.select("grade", "features").mapInArrow(count, "feature int, " + ", ".join(f"{c} long" for c in names))
    n, residual = int(by_grade.sum()), _residuals(by_grade)
    mean = float((residual * by_grade).sum() / n)
    told = F.abs(sum((F.col(c) * F.lit(float(r)) for c, r in zip(names, residual)), F.lit(0.0)) - F.col("n") * F.lit(mean))
    spread = F.sqrt(F.col("n") * F.greatest(1 - F.col("n") / F.lit(float(n)), F.lit(1.0 / n)))
    best = (
        parts.groupBy("feature")
        .agg(*[F.sum(c).alias(c) for c in names])
        .withColumn("n", sum((F.col(c) for c in names), F.lit(0)))
        .where(F.col("n") >= least)
        .select("feature", (told / spread).alias("told"))
        .where(F.col("told") > 0)
        .orderBy(F.desc("told"), "feature")
        .limit(most)
    )
    return np.sort(np.array([r["feature"] for r in best.collect()], dtype=np.int64))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE):
    """(weights, thresholds) from rated documents; nothing rated gives a model that keeps all.

    The driver gets the screened features of the sample only, some megabytes.
    """
    weights = np.zeros(DIMENSIONS)
    rated = written(rated_features(docs, grades, sample))
    sizes = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    if not sizes:
        return weights, np.array([-30.0, -20.0])
    by_grade = np.array([sizes.get(g, 0) for g in range(GRADES)], dtype=np.int64)
    active = screened_features(rated, by_grade)

    def keep(batches):
        for batch in batches:
            lists = []
            for data in batch.column("features").to_pylist():
                own = np.frombuffer(data, "<i4")
                lists.append(np.flatnonzero(np.isin(active, own)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lists, pa.binary())], names=batch.schema.names)

    rows = rated.mapInArrow(keep, "doc_id long, grade int, features binary").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "grade", "features")])
    parts = [np.frombuffer(x, "<u2") for x in rows.column("features").to_pylist()]
    of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    weights[active], thresholds = fit(of, np.concatenate(parts), rows.column("grade").to_numpy(), len(active))
    return weights, thresholds


def score(docs: DataFrame, model, keep: float = KEEP) -> DataFrame:
    """All columns of `docs` with expected_grade, tail_probability and kept.

    A null or empty text has shape features only and is scored by them. Repeated rows get
    equal results, an empty table none. Columns of these three names are replaced.
    """
    weights, thresholds = model
    at = np.flatnonzero(weights)
    values = weights[at]
    own = ["expected_grade", "tail_probability", "kept"]
    rows = docs.drop(*own)
    types = zip(own, (T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, kind) for name, kind in types]])

    def judge(batches):
        table, known = np.zeros(DIMENSIONS), WordFeatures()
        table[at] = values
        wanted = table != 0
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for begin, end in sub_batches(texts):
                of, feats = features(texts[begin:end], known, wanted)
                above = _sigmoid(np.bincount(of, table[feats], end - begin) - thresholds[:, None])
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(above.sum(axis=0)), pa.array(above[-1]), pa.array(above[-1] >= keep)],
                    names=[*batch.schema.names, *own],
                )

    return rows.mapInArrow(judge, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """`docs` (doc_id, text, …) scored by a model fitted on its rated documents."""
    return score(docs, train(docs, grade_labels(labels), sample), keep)
