"""Conversations as token sequences with a loss mask.

A turn is written as

    <s> role [INST] text </s>        turns to read
    <s> role [/INST] text </s>       turns to learn, those of the role "assistant"

without the blanks. In token form the four control strings are reserved ids above the
vocabulary, spliced between the separately encoded role and text, so no text can produce
them. In text form a control string inside a role or text is escaped by a backslash after
its first character (`<\\s>`), and one that already has backslashes there gets one more, so
the escape can always be undone. Texts are escaped before they are encoded; both forms
therefore say the same.

The mask marks the ids of learned texts. Segment lengths are known after encoding, so where
a segment begins, and with it the mask, are prefix sums over the segments.

Turns are encoded row by row. A conversation is put together while its sorted turns stream
by, and is handed on in parts of bounded size, so one conversation may be of any length.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partatlas.llm.tokens import vocabulary_path

LEARNED = "assistant"
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
PART_IDS = 1 << 18

_CONTROL = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")
_PIECE = re.compile(r"(<s>|</s>|\[INST\]|\[/INST\])")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _tokenizer(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def _segments(batches, path):
    """Ids and lengths of role and text of every turn."""
    tokenizer = _tokenizer(path)
    for batch in batches:
        roles, texts = ([escape(x or "") for x in batch.column(c).to_pylist()] for c in ("role", "text"))
        known = {r: tokenizer.encode(r, add_special_tokens=False).ids for r in set(roles)}
        encoded = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                pa.array([x or "" for x in batch.column("role").to_pylist()], pa.string()),
                pa.array(roles, pa.string()),
                pa.array(texts, pa.string()),
                pa.array([known[r] for r in roles], pa.list_(pa.int32())),
                pa.array(encoded, pa.list_(pa.int32())),
            ],
            names=["conv_id", "turn", "role", "role_text", "text", "role_ids", "text_ids"],
        )


def _assembled(turns, reserved):
    """(ids, mask, text) of turns (learned, role text, text, role ids, text ids) in order."""
    start, to_read, to_learn, end = reserved
    parts, learned, texts = [], [], []
    for learn, role, text, role_ids, text_ids in turns:
        parts += [[start], role_ids, [to_learn if learn else to_read], text_ids, [end]]
        learned += [0, 0, 0, int(learn), 0]
        texts += [CONTROLS[0], role, CONTROLS[2] if learn else CONTROLS[1], text, CONTROLS[3]]
    ends = np.cumsum([len(p) for p in parts])
    steps = np.zeros(ends[-1] + 1, dtype=np.int8)
    np.add.at(steps, ends - [len(p) for p in parts], learned)
    np.subtract.at(steps, ends, learned)
    return np.concatenate([np.asarray(p, dtype=np.int32) for p in parts]), np.cumsum(steps[:-1]).astype(bool), "".join(texts)


_OUT = "conv_id long, part int, n_turns long, ids array<int>, loss_mask array<boolean>, text string"


def format_conversations(turns: DataFrame, vocabulary: str | None = None, learned_role: str = LEARNED) -> DataFrame:
    """(conv_id, part, n_turns, ids, loss_mask, text) of the conversations in `turns`.

    `turns` has conv_id, turn, role and text; null roles and texts count as empty. The turns of
    a conversation are taken in the order of turn, role and text, null turns first; repeated
    rows are turns of their own, and turns without a conv_id form one conversation. A part ends
    after about `PART_IDS` ids and always with a whole turn; parts count from 0. Reserved ids
    follow the vocabulary in the order of `CONTROLS`. An empty table gives no rows.
    """
    path = vocabulary or vocabulary_path()
    encoded = turns.select("conv_id", "turn", "role", "text").mapInArrow(
        lambda batches: _segments(batches, path),
        "conv_id long, turn long, role string, role_text string, text string, role_ids array<int>, text_ids array<int>",
    )
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def assemble(batches):
        size = _tokenizer(path).get_vocab_size()
        reserved = tuple(range(size, size + len(CONTROLS)))
        conv, part, held, ids_held, out = None, 0, [], 0, []

        def flush():
            ids, mask, text = _assembled(held, reserved)
            out.append((conv[0], part, len(held), ids, mask, text))

        def rows():
            columns = list(zip(*out))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())]
            arrays += [pa.array(columns[3], pa.list_(pa.int32())), pa.array(columns[4], pa.list_(pa.bool_()))]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array(columns[5], pa.string())], names=["conv_id", "part", "n_turns", "ids", "loss_mask", "text"]
            )

        for batch in batches:
            names = ("conv_id", "role", "role_text", "text", "role_ids", "text_ids")
            for conv_id, role, *segments in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if conv is not None and (conv != (conv_id,) or ids_held >= PART_IDS):
                    flush()
                    part = part + 1 if conv == (conv_id,) else 0
                    held, ids_held = [], 0
                    if len(out) >= 500 or sum(len(x[3]) for x in out[-8:]) > PART_IDS:
                        yield rows()
                conv = (conv_id,)
                held.append((role == learned_role, *segments))
                ids_held += len(segments[2]) + len(segments[3]) + 3
        if held:
            flush()
        if out:
            yield rows()

    return ordered.mapInArrow(assemble, _OUT)


def turns_of_text(text: str):
    """[(learned, role, text)] of a formatted text."""
    pieces = _PIECE.split(text)
    return [
        (middle == CONTROLS[2], unescape(role), unescape(content))
        for start, role, middle, content in zip(pieces[1::6], pieces[2::6], pieces[3::6], pieces[4::6])
    ]


def read_conversations(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digest of every formatted conversation, from its ids and mask.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): the ids between
    reserved ids are decoded and unescaped again. turns_sha256 is over role, line feed, text,
    line feed of all turns, loss_sha256 over the texts under the mask.
    """
    path = vocabulary or vocabulary_path()
    ordered = formatted.select("conv_id", "part", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def digest(batches):
        tokenizer = _tokenizer(path)
        size = tokenizer.get_vocab_size()
        conv, state = None, None

        def row():
            return pa.RecordBatch.from_pydict(
                {
                    "conv_id": pa.array([conv[0]], pa.int64()),
                    "n_turns": [state["turns"]],
                    "turns_sha256": [state["all"].hexdigest()],
                    "loss_chars": [state["chars"]],
                    "loss_sha256": [state["loss"].hexdigest()],
                    "formatted_chars": [state["formatted"]],
                }
            )

        for batch in batches:
            ids_of = batch.column("ids")
            mask_of = batch.column("loss_mask")
            for k, conv_id in enumerate(batch.column("conv_id").to_pylist()):
                if conv != (conv_id,):
                    if conv is not None:
                        yield row()
                    conv = (conv_id,)
                    state = {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "formatted": 0}
                ids = ids_of[k].values.to_numpy()
                mask = mask_of[k].values.to_numpy(zero_copy_only=False)
                control = np.flatnonzero(ids >= size)
                state["formatted"] += sum(len(CONTROLS[c]) for c in (ids[control] - size).tolist())
                # between the controls of a turn stand its role and its text
                bounds = [(a + 1, b) for a, b in zip(control[:-1], control[1:])]
                spans = [s for n, s in enumerate(bounds) if n % 3 != 2]
                texts = tokenizer.decode_batch([ids[a:b].tolist() for a, b in spans], skip_special_tokens=False)
                state["turns"] += len(spans) // 2
                for (a, b), escaped, last in zip(spans, texts, np.arange(len(spans)) % 2):
                    text = unescape(escaped)
                    state["formatted"] += len(escaped)
                    state["all"].update(text.encode() + b"\n")
                    if last and b > a and mask[a:b].all():
                        state["loss"].update(text.encode())
                        state["chars"] += len(text)
        if conv is not None:
            yield row()

    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(digest, names)
