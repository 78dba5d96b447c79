"""Token ids of documents in files of the entropy coder (`coder`), and back.

Documents are dealt by ranges of their ids and sorted, so the files follow the order of
doc_id. A shard file holds whole documents up to about `SHARD_IDS` ids. Spark's writer
carries the files as binary rows (part, seq, data), which makes a write atomic and leaves
nothing behind by lost or repeated tasks; `data` is complete on its own.
"""

import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partatlas.llm.coder import read_shard, write_shard

END_ID = 2
SHARD_IDS = 1 << 20
SLICE_ROWS = 256  # rows whose texts are strings at a time
VOCABULARY = "byte_bpe_50k.json"

# A token of the byte-level vocabulary never reaches over a space from one word to the next.
_CUT = re.compile(r" (?=[\w!-~])")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbers(dict):
    """Number of every word seen; new words are listed in `fresh`."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, word):
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class ByteLevelEncoder:
    """Ids of texts by the tokenizers library, which encodes every distinct word once.

    A word goes with the space before it. Strings of special tokens are their ids, as the
    library has it, or ordinary text with `special_as_text`.
    """

    LIMIT = 250_000
    BATCH, GROUP = 512, 4  # inputs that are encoded at a time, words of an input

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = {} if special_as_text else self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: number for number, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        # a token that parts the words of an input as if each were alone
        marks = [(t.content, n) for n, t in added.items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark, self.mark_id = marks[0] if marks else ("", -1)
        self._forget()

    def _words(self, text):
        """What is encoded on its own: words, and in tuples what has no space before it."""
        if self.special is None or not self.special.search(text):
            words = _CUT.split(text)
            words[0] = (words[0],)
            return words
        out = []
        for k, piece in enumerate(self.special.split(text)):
            words = [piece] if k % 2 else _CUT.split(piece)
            out += [(words[0],), *words[1:]]
        return out

    def _forget(self):
        self.number, self.ids, self.size = _Numbers(), array("I", self.added.values()), array("I", [1] * len(self.added))
        self.number.update(((content,), k) for k, content in enumerate(self.added))

    def _encode_fresh(self):
        fresh, self.number.fresh = self.number.fresh, []
        group = self.GROUP if self.mark else 1
        for at in range(0, len(fresh), self.BATCH * group):  # the library holds far more than the ids of a word
            plain = [w[0] if isinstance(w, tuple) else " " + w for w in fresh[at : at + self.BATCH * group]]
            inputs = [self.mark.join(plain[k : k + group]) for k in range(0, len(plain), group)]
            ids = []
            for one in self.tokenizer.encode_batch_fast(inputs, add_special_tokens=False):
                ids += one.ids
                ids.append(self.mark_id)
            ids = np.array(ids, dtype=np.int64)
            ends = np.flatnonzero(ids == self.mark_id)
            self.size.extend((np.diff(ends, prepend=-1) - 1).tolist())
            self.ids.extend(ids[ids != self.mark_id].tolist())

    def encode(self, texts):
        """(ids of all texts, number of ids by text)."""
        if len(self.number) > self.LIMIT:
            self._forget()
        parts = [self._words(text) for text in texts]
        counts = [len(p) for p in parts]
        number = self.number.__getitem__
        words = np.fromiter(map(number, chain.from_iterable(parts)), dtype=np.int32, count=sum(counts))
        self._encode_fresh()
        size, table = np.array(self.size, dtype=np.int32), np.array(self.ids, dtype=np.uint32)
        begin = np.cumsum(size, dtype=np.int32) - size
        sizes = size[words]
        out = table[np.repeat(begin[words] - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes) + np.arange(sizes.sum(), dtype=np.int32)]
        of_text = np.repeat(np.arange(len(texts)), counts)
        return out, np.bincount(of_text, sizes, len(texts)).astype(np.int64)


def _with_end(ids, counts, end_id):
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id), counts + 1


def _batches_of(texts, budget=2_000_000):
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= budget or k + 1 == len(texts):
            yield begin, k + 1
            begin, held = k + 1, 0


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int | None = END_ID,
    special_as_text: bool = False,
):
    """Write the ids of all texts of `docs` (doc_id, text) to token files under `path`.

    A string of a special token in a text becomes that token, as the tokenizers library does by
    default; with `special_as_text` it is encoded like any other text. Other columns are not
    looked at. A text of any length is encoded whole and lies in one file.

    A null text counts as empty; every document ends with `end_id`. Rows without a doc_id come
    first; rows that repeat a doc_id follow each other in the order of their texts. An empty
    table writes no files. `path` must not exist.
    """
    vocabulary = vocabulary or vocabulary_path()

    def encode(batches):
        encoder = ByteLevelEncoder(vocabulary, special_as_text)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, counts, ids, held = [], [], [], 0

        def shard():
            data = write_shard(doc_ids, np.concatenate(counts), np.concatenate(ids))
            return pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [held], "data": [data]},
                schema=pa.schema(
                    [("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]
                ),
            )

        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            numbers = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for begin, end in _batches_of(texts):
                found, n = encoder.encode(texts[begin:end])
                if end_id is not None:
                    found, n = _with_end(found, n, end_id)
                doc_ids += numbers[begin:end]
                counts.append(n)
                ids.append(found.astype(np.uint32))
                held += len(found)
                if held >= SHARD_IDS:
                    yield shard()
                    seq += 1
                    doc_ids, counts, ids, held = [], [], [], 0
        if doc_ids:
            yield shard()

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, "part int, seq int, n_docs long, n_ids long, data binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the token files under `path`.

    `start` counts the ids of all documents before it, `ids_crc32` is the CRC-32 of its ids as
    little-endian 32-bit numbers. Damaged files raise an error.
    """
    files = spark.read.parquet(path)

    def decode(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "data"))):
                doc_ids, counts, ids = read_shard(data)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                for a in range(0, len(doc_ids), 1000):
                    z = min(a + 1000, len(doc_ids))
                    columns = {
                        "part": pa.array([part] * (z - a), pa.int32()),
                        "seq": pa.array([seq] * (z - a), pa.int32()),
                        "doc_id": pa.array(doc_ids[a:z], pa.int64()),
                        "inside": pa.array(ends[a:z] - counts[a:z]),
                        "n_tokens": pa.array(counts[a:z]),
                        "ids_crc32": pa.array(sums[a:z], pa.int64()),
                    }
                    if with_ids:
                        first = ends[a] - counts[a]
                        offsets = np.concatenate([[0], ends[a:z] - first]).astype(np.int32)
                        values = pa.array(ids[first : ends[z - 1]].astype(np.int32))
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), values)
                    yield pa.RecordBatch.from_pydict(columns)

    names = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    found = files.select("part", "seq", "data").mapInArrow(decode, names + (", ids array<int>" if with_ids else ""))
    # one row a part here, and the files of one part there
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part",
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("ahead"))
        .join(parts, "part")
        .select("part", "seq", (F.col("before") + F.col("ahead")).alias("offset"))
    )
    columns = ["doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"]
    return found.join(offsets, ["part", "seq"]).select(*columns, *(["ids"] if with_ids else []))
