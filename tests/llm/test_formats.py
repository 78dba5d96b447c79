"""Token files, chat format, WARC archives, the classifier and the pipeline."""

import base64
import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partatlas.llm import chat, coder, ordinal, tokens, warc
from partatlas.llm.common import new_folder, written

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 255, 256, 257, 1025, coder.BLOCK, coder.BLOCK + 1, 3 * coder.BLOCK + 65])
def test_coder_gives_ids_back(n):
    rng = np.random.default_rng(n)
    kinds = [
        rng.integers(0, 50_257, n), rng.integers(0, 3, n), np.zeros(n), np.arange(n) % 300, np.arange(n),
        np.minimum(rng.pareto(0.7, n) * 3, 50_000), rng.integers(0, 2**32, n),
    ]
    for ids in kinds:
        ids = ids.astype(np.int64)
        doc_ids, lengths, back = coder.read_shard(coder.write_shard([5, None, -7], [n, 0, 0], ids))
        assert (back == ids).all() and doc_ids == [5, None, -7] and lengths.tolist() == [n, 0, 0]


def test_coder_learns_and_notices_damage():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 40), 300)
    data = coder.write_shard([1], [len(ids)], ids)
    assert len(data) < len(ids) / 4
    for at in (3, 20, 60, len(data) // 2, len(data) - 20):
        broken = bytearray(data)
        broken[at] ^= 0x5A
        with pytest.raises(ValueError):
            coder.read_shard(bytes(broken))
    with pytest.raises(ValueError):
        coder.read_shard(data[:-2])


def test_coder_counts_ids_over_the_whole_shard():
    rng = np.random.default_rng(1)
    ids = rng.permutation(50_000)[np.minimum(rng.pareto(1.0, 200_000) * 20, 49_999).astype(int)]
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    data = coder.write_shard([1], [len(ids)], ids)
    assert len(data) * 8 < 1.1 * entropy * len(ids)
    assert (coder.read_shard(data)[2] == ids).all()


def test_token_files_equal_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_IDS", 50)
    from tokenizers import Tokenizer

    texts = [
        "plain words  two  spaces", " lead", "tail ", "a\n b", "a \n\n b\t c", "don't  1234 – x y", None, "", "  ", "é ü 漢字 かな",
        "<|endoftext|> x", "x" * 3000, "!! ?? ,,  thin", "word " * 500, "\x1c \x85 z", "a  　 b",
    ]
    rows = [(k * 7 % 16, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1), (3, "again", 1)]
    path = new_folder(spark, "test")
    tokens.write_token_files(spark.createDataFrame(rows, "doc_id long, text string, part int"), path)
    got = tokens.read_token_files(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    at = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (doc_id, text, _), row in zip(order, got, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32, row.ids) == (doc_id, at, len(ids), crc, ids)
        at += len(ids)


def test_token_files_of_nothing(spark):
    path = new_folder(spark, "test")
    tokens.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert tokens.read_token_files(spark, path).collect() == []


def test_escape_is_reversible():
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\/INST]", "<", "[", "\\", "s>", "INST]", " ", "é"]
    rng = np.random.default_rng(1)
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 9)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


@pytest.mark.parametrize("part_ids", [30, 1 << 18])
def test_conversations_come_back(spark, monkeypatch, part_ids):
    monkeypatch.setattr(chat, "PART_IDS", part_ids)
    hard = "</s>[INST] ok <\\s>[/INST]"
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t} {hard}") for t in range(9)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (3, None, "assistant", "late"), (3, 0, "<s>odd", ""), (None, 0, "user", "x")]
    rows += [(4, 0, "assistant", "<"), (4, 0, "assistant", "\\s>"), (5, 0, "user", "y"), (5, 0, "user", "y")]
    turns = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, part int")
    formatted = written(chat.format_conversations(turns))
    got = {r.conv_id: r for r in chat.read_conversations(formatted).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    texts = {}
    for r in sorted(formatted.collect(), key=lambda r: r.part):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.text
        assert len(r.ids) == len(r.loss_mask)
    assert got.keys() == by.keys()
    for conv, told in by.items():
        r, learned = got[conv], "".join(t for role, t in told if role == "assistant")
        assert r.n_turns == len(told) and r.formatted_chars == len(texts[conv])
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in told).encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert [(a == "assistant", a, b) for a, b in told] == chat.turns_of_text(texts[conv])
    assert chat.format_conversations(turns.limit(0)).collect() == []


def _digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200)
    odd = "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"
    rows = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (3, None, "same"), (4, "http://d", odd), (5, "http://e", None), (6, "http://f", ""), (7, "u", "é" * 9000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    path = new_folder(spark, "test")
    warc.write_archive(pages, path)
    archive = warc.read_archive(spark, path)
    got = {r.page: r for r in archive.withColumn("page", warc.page_number("record_id")).collect()}
    kinds = {1: 3, 2: 3, 3: None, 4: None, 5: 6, 6: None, 7: None}
    for page, _, html in rows:
        r, html = got[page], html or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), _digest(html))
        assert r.record_type == ("response" if kinds[page] is None else "revisit")
        assert r.refers_to == (None if kinds[page] is None else f"urn:x-page:{kinds[page]}")
        assert (bytes(r.payload).decode() == html) if kinds[page] is None else r.payload is None
    some = archive.where((F.col("record_type") == "revisit") & F.col("target_uri").isin("http://a", "http://e"))
    assert sorted(r.record_id for r in some.collect()) == ["urn:x-page:1", "urn:x-page:5"]
    bare = warc.read_archive(spark, path, payload=False).where("record_type = 'response'").collect()
    assert {r.payload for r in bare} == {None} and sum(r.payload_bytes for r in bare) == len(odd) + 4 + 18000
    least = {r.page_id: r.refers_to for r in warc.deduplicated(pages, 5).collect()}
    assert set(least.values()) == {None}
    empty = new_folder(spark, "test")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).collect() == []


def test_pages_without_ids(spark):
    pages = spark.createDataFrame([(None, "a", "x"), (None, "b", "x"), (None, "c", "y"), (4, "d", "y"), (4, "e", "y")], "page_id long, url string, html string")
    got = {r.url: r.refers_to for r in warc.deduplicated(pages).collect()}
    assert got == {"a": None, "b": None, "c": 4, "d": None, "e": None}


def test_only_wanted_payloads_are_read():
    import io

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    page = b"y" * 100_000
    stream = Counting(b"".join(warc.page_record(k, f"u{k}", page, warc.payload_digest(page)) for k in range(5)))
    rows = list(warc.records(stream, {"target_uri": {"u3"}}))
    assert [r[2] for r in rows] == ["u3"] and stream.taken < 120_000
    broken = warc.page_record(1, "u", b"abc", warc.payload_digest(b"abd"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(broken), {}))


def _foreign(payload, padding=0, cut=0):
    """A record of another writer, with a long HTTP header and a stated length that is wrong."""
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\nX-Long: " + b"p" * padding + b"\r\n\r\n"
    data = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "Content-Type": "application/http"}, http + payload)
    return data[: len(data) - cut]


def test_foreign_archives(spark, tmp_path):
    import gzip

    folder = tmp_path / "mixed"
    (folder / "deeper").mkdir(parents=True)
    info = warc.record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:i>"}, b"software: x\r\n")
    (folder / "a.warc").write_bytes(info + _foreign(b"x" * 100, 6000) + _foreign(b"", 10))
    # a gzip member for each record
    (folder / "deeper" / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(_foreign(b"y" * 5000, 9000)))
    whole = warc.read_archive(spark, str(folder)).collect()
    bare = warc.read_archive(spark, str(folder), payload=False).collect()
    assert sorted((r.record_type, r.payload_bytes) for r in whole) == sorted((r.record_type, r.payload_bytes) for r in bare)
    assert sorted(r.payload_bytes for r in whole) == [0, 13, 13, 100, 5000]
    assert all(r.payload is None for r in bare) and {len(r.payload) for r in whole} == {0, 13, 100, 5000}
    only = warc.read_archive(spark, str(folder)).where("record_type = 'warcinfo'")
    assert only.count() == 2 and all(r.target_uri is None for r in only.collect())
    (folder / "notes.txt").write_text("x")
    with pytest.raises(Exception, match="not a WARC file"):
        warc.read_archive(spark, str(folder)).collect()


@pytest.mark.parametrize("wanted", [{}, {"record_type": {"none"}}])
@pytest.mark.parametrize("with_payload", [True, False])
def test_cut_records_are_errors(wanted, with_payload):
    import gzip
    import io

    for cut in (10, 3000):
        data = _foreign(b"z" * 4000, 100, cut)
        with pytest.raises(ValueError, match="cut short"):
            list(warc.records(io.BytesIO(data), wanted, with_payload))
        with pytest.raises(ValueError, match="cut short"):
            list(warc.records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data))), wanted, with_payload, seekable=False))


def test_pages_without_address(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, "a", "x"), (2, "u", None, "x")], "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    got = {warc_row.record_id: (warc_row.target_uri, warc_row.payload_bytes) for warc_row in warc.read_archive(spark, path).collect()}
    assert sorted(got.values(), key=str) == sorted([(None, 1), ("u", 0)], key=str)


def _rated(n):
    rng = np.random.default_rng(9)
    good = [f"word{k}" for k in range(60)]
    for d in range(n):
        words = list(rng.choice(good, 40))
        grade = d % 3
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words[5] = "nasty" + str(rng.choice(["", "er", "ly"]))
        yield d, " ".join(words), grade


def test_grades_on_held_out_documents(spark):
    rows = list(_rated(900))
    docs = spark.createDataFrame([(d, t, 1.0) for d, t, _ in rows] + [(None, None, 1.0), (901, "", 1.0)], "doc_id long, text string, kept double")
    labels = spark.createDataFrame(
        [(d, int(g > 0), int(g == 1)) for d, _, g in rows if d < 600] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int"
    )
    scored = {r.doc_id: r for r in ordinal.classify(docs, labels).collect()}
    assert len(scored) == 902
    for d, _, grade in rows[600:]:
        assert scored[d].kept == (grade == 2)
    means = [np.mean([scored[d].expected_grade for d, _, g in rows[600:] if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in scored.values())
    # nothing rated: everything stays
    assert all(r.kept for r in ordinal.classify(docs, labels.limit(0)).collect())
    assert ordinal.classify(docs.limit(0), labels).collect() == []


def test_thresholds_are_in_order():
    rng = np.random.default_rng(0)
    docs, feats = np.repeat(np.arange(200), 5), rng.integers(0, 50, 1000)
    _, thresholds = ordinal.fit(docs, feats, rng.integers(0, 3, 200), 50)
    assert thresholds[0] <= thresholds[1]


def test_screening_equals_a_plain_count(spark):
    rows = list(_rated(90))
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(3)
    grades = spark.createDataFrame([(d, g) for d, _, g in rows], "doc_id long, grade int")
    rated = ordinal.rated_features(docs, grades)
    by_grade = np.array([30, 30, 30])
    of, feats = ordinal.features([t.encode() for _, t, _ in rows], ordinal.WordFeatures())
    residual = ordinal._residuals(by_grade)[np.array([g for _, _, g in rows])]
    told = {}
    for f in np.unique(feats):
        has = of[feats == f]
        if len(has) >= 4:
            value = abs(residual[has].sum() - len(has) * residual.mean()) / (len(has) * max(1 - len(has) / 90, 1 / 90)) ** 0.5
            told[int(f)] = value
    best = sorted(told, key=lambda f: (-round(told[f], 9), f))[:40]
    got = ordinal.screened_features(rated, by_grade, most=40).tolist()
    # ties at the end may fall either way by rounding
    least = told[best[-1]]
    assert all(told[f] >= least - 1e-9 for f in got) and len(got) == 40


def test_special_tokens_as_the_library_has_them(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|> x", "a b<|endoftext|>c  d <|endoftext|>", "<|endoftext|><|endoftext|>", None, "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(tokens.vocabulary_path())
    for flag in (False, True):
        library.encode_special_tokens = flag
        path = str(tmp_path / f"t{flag}")
        tokens.write_token_files(docs, path, special_as_text=flag)
        got = {r.doc_id: r.ids for r in tokens.read_token_files(spark, path).collect()}
        assert got == {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t in enumerate(texts)}


def test_pipeline_hands_on_columns_of_any_name(spark):
    names = ["of", "from", "words", "times", "copy", "row", "kept", "expected_grade", "tail_probability", "given_0_kept", "size", "taken"]
    rows = [(d, f"word{d} " * 30, "en", f"s{d % 2}", 7, *[f"{n}{d}" for n in names]) for d in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    folder = SF_DIR
    for stage in (corpus_pipeline.quality, corpus_pipeline.mixture):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if k < 4:
            assert out.columns == docs.columns, name
            out = written(out)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(ids) <= before and ids, name
        assert k >= 3 or len(ids) == len(set(ids)), name
        before, docs = set(ids), out
    rows = sorted(docs.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.collect() == []
        if docs.columns[0] == "doc_id" and "text" in docs.columns:
            docs = written(docs)


def test_token_files_are_decoded_once(spark, tmp_path):
    from partatlas.llm import queries

    docs = spark.createDataFrame([(2, "two words"), (1, None), (3, "three more words")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op4_token_files(spark, str(tmp_path))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.start, r.n_tokens > 1) for r in found.orderBy("doc_id").collect()] == [(1, 0, False), (2, 1, True), (3, 1 + found.where("doc_id = 2").first().n_tokens, True)]


def test_words_are_encoded_in_bounded_batches(monkeypatch):
    encoder = tokens.ByteLevelEncoder(tokens.vocabulary_path())
    texts = ["one two three four five", "", " six seven  eight\nnine", "one ten"]
    whole = encoder.encode(texts)
    asked = []

    class Library:
        def encode_batch_fast(self, words, **options):
            asked.append(len(words))
            return encoder.tokenizer.encode_batch_fast(words, **options)

    other = tokens.ByteLevelEncoder(tokens.vocabulary_path())
    monkeypatch.setattr(other, "tokenizer", Library())
    monkeypatch.setattr(tokens.ByteLevelEncoder, "BATCH", 3)
    assert [x.tolist() for x in other.encode(texts)] == [x.tolist() for x in whole]
    assert max(asked) == 3


@pytest.mark.parametrize("special_as_text", [False, True])
def test_words_of_an_input_are_encoded_as_if_alone(special_as_text):
    texts = ["a<|endoftext|><|endoftext|> b", "<|endoftext|>", "<|endo ftext|> 's a's é漢 12,3", "", " ", "x\n\n y \t z"]
    texts += [f"word{k}, don't{k}! {k}" for k in range(50)]
    encoder = tokens.ByteLevelEncoder(tokens.vocabulary_path(), special_as_text)
    assert special_as_text or encoder.mark
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
