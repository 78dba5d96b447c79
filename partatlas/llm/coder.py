"""Adaptive context-mixing entropy coder for token ids.

Ids are cut into blocks, each with its CRC-32, which are coded side by side: every numpy
operation of the coder advances one position of all blocks of a shard. The model is
estimated again from all ids of all blocks coded so far at positions 4, 16, 64 and 256.
Until the next of these points an id is predicted by three orders:

* order 2: the id that followed the last two ids most often,
* order 1: the id that followed the last id most often,
* order 0: the frequencies of the ids, with an escape for ids that are new or too rare.

The mixture gives the order-2 guess the share in which guesses of its kind (how often and
how reliably seen) were right so far in this shard, the order-1 guess its share of the
rest, and what remains to order 0. All shares are whole numbers of 1/2**20, so that every
machine decodes the same. Shares become bits by interleaved range asymmetric numeral systems
with 64-bit states and 32-bit words; escaped ids follow as plain numbers.
"""

import struct
import zlib

import numpy as np

BLOCK = 512
EPOCHS = (4, 16, 64, 256)
MAGIC = b"IDRC2\0"
_HEAD = "<6sHIIQIQQ"  # magic, id bits, block, documents, ids, blocks, escaped ids, words

_TOTAL, _SLOTS, _KINDS = 20, 16, 16
_SYMBOLS = 1 << 14  # the most frequent ids, which order 0 holds; others are escaped
_MOST2, _MOST1 = 960_000, 973_000  # what is left of _TOTAL has a value for every slot
_TABLE_BITS = 20  # ids up to here are looked up in a table
_SLICE = 64  # positions prepared at a time
_LOWEST = np.uint64(1 << 32)
_MASK32, _U32, _U20, _U44 = np.uint64((1 << 32) - 1), np.uint64(32), np.uint64(_TOTAL), np.uint64(64 - _TOTAL)


def _best(keys, base):
    """Of keys context * base + follower: (contexts, most frequent follower, kind), seen twice at least."""
    keys, count = np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, keys, keys
    context, follower = np.divmod(keys, base)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    most = np.maximum.reduceat(count * (base + 1) + (base - follower), first)
    times, left = np.divmod(most, base + 1)
    whole = np.add.reduceat(count, first)
    kind = np.minimum(times * 8 // whole, 7) * 2 + (times >= 4)
    often = times > 1
    return context[first][often], (base - left)[often], kind[often]


class _Model:
    """What a shard knows at the start of an epoch.

    `known` has the ids so far, (blocks, positions). Symbols are ranks of ids in `ids`; the
    number after the last symbol stands for all other ids.
    """

    def __init__(self, known, right, tried, bits):
        self.ids, count = np.unique(known, return_counts=True)
        n, single = known.size, int((count == 1).sum())
        if len(self.ids) > _SYMBOLS:
            kept = np.sort(np.argsort(-count, kind="stable")[:_SYMBOLS])
            self.ids, count = self.ids[kept], count[kept]
        self.n = n = len(self.ids)
        self.table = None
        if bits <= _TABLE_BITS:
            self.table = np.full(1 << bits, n, dtype=np.int32)
            self.table[self.ids] = np.arange(n)
        # order 0: every symbol a slot and its part of the others; the rest is the escape
        share = 1 + count * ((1 << _SLOTS) - 1 - n) // (known.size + single)
        self.edges = np.concatenate([[0], np.cumsum(share), [1 << _SLOTS]])
        self.slots = np.repeat(np.arange(n + 1, dtype=np.int32), np.diff(self.edges))
        # order 1 and order 2
        symbol, base = self.symbols(known), n + 1
        self.last = symbol[:, -2:]
        odds1, odds2 = (((2 * r + 1) << 14) // (t + 1) for r, t in zip(right, tried))
        keys = symbol[:, :-1] * base + symbol[:, 1:]
        context, follower, kind = _best(keys[(symbol[:, :-1] < n) & (symbol[:, 1:] < n)], base)
        self.guess1, self.kind1, self.part1 = np.full(base, -1), np.zeros(base, dtype=np.int64), np.zeros(base, dtype=np.int64)
        self.guess1[context], self.kind1[context], self.part1[context] = follower, kind, odds1[kind]
        within = (symbol[:, :-2] < n) & (symbol[:, 1:-1] < n) & (symbol[:, 2:] < n)
        context, follower, kind = _best((keys[:, :-1] * base + symbol[:, 2:])[within], base)
        self.cells = 1 << (2 * len(context) + 1).bit_length()
        cell = self._cell(context)
        self.pair2 = np.full(self.cells, -1)
        self.guess2, self.kind2, self.part2 = np.full(self.cells, -1), np.zeros(self.cells, dtype=np.int64), np.zeros(self.cells, dtype=np.int64)
        self.pair2[cell], self.guess2[cell] = context, follower
        self.kind2[cell], self.part2[cell] = kind, 1 + (odds2[kind] * _MOST2 >> 15)

    def symbols(self, ids):
        if self.table is not None:
            return self.table[ids].astype(np.int64)
        place = np.minimum(np.searchsorted(self.ids, ids), self.n - 1)
        return np.where(self.ids[place] == ids, place, self.n)

    def _cell(self, pair):
        return (pair * 2654435761 >> 7) & (self.cells - 1)

    def guesses(self, last2, last1):
        """(guess, end of its share) of order 2 and of order 1, -1 for none, and the cell of the order-2 context."""
        pair = last2 * (self.n + 1) + last1
        cell = self._cell(pair)
        has2 = self.pair2[cell] == pair
        guess2, end2 = np.where(has2, self.guess2[cell], -1), np.where(has2, self.part2[cell], 0)
        guess1 = self.guess1[last1]
        has1 = (guess1 >= 0) & (guess1 != guess2)
        end1 = end2 + has1 * (1 + (self.part1[last1] * (_MOST1 - end2) >> 15))
        return guess2, end2, np.where(has1, guess1, -1), end1, cell

    def learn(self, symbol, last1, guess2, guess1, cell, right, tried):
        for k, (guess, kind, asked) in enumerate(
            ((guess1, self.kind1[last1], (guess1 >= 0) & (symbol != guess2)), (guess2, self.kind2[cell], guess2 >= 0))
        ):
            tried[k] += np.bincount(kind[asked], minlength=_KINDS)
            right[k] += np.bincount(kind[asked & (symbol == guess)], minlength=_KINDS)


def _spread(slot, end1):
    """Where an order-0 slot begins among the values."""
    return end1 + (slot * ((1 << _TOTAL) - end1) >> _SLOTS)


def _epochs(length):
    ends = [e for e in EPOCHS if e < length]
    return list(zip([0, *ends], [*ends, length]))


def _records():
    return tuple([np.zeros(_KINDS, dtype=np.int64) for _ in range(2)] for _ in range(2))


def _grid(n):
    """(blocks, ids of a block, ids of the last one)."""
    lanes = -(-n // BLOCK)
    return lanes, min(BLOCK, n), n - (lanes - 1) * BLOCK


def _pushed(start, share, tail):
    """(states of the lanes, words) of shares by position and lane; the last lane has `tail` positions."""
    lanes = start.shape[1]
    state = np.full(lanes, _LOWEST)
    words = []
    for t in range(len(start) - 1, -1, -1):
        now = lanes if t < tail else lanes - 1
        x, part = state[:now], share[t, :now].astype(np.uint64)
        out = np.flatnonzero(x >= part << _U44)
        words.append((x[out] & _MASK32).astype(np.uint32))
        x[out] >>= _U32
        whole = x // part
        state[:now] = (whole << _U20) + (x - whole * part) + start[t, :now]
    return state, np.concatenate([np.zeros(0, dtype=np.uint32), *words[::-1]])


def encode_blocks(ids, bits):
    """(escaped ids, states of the blocks, words) of `ids` (int64, below 2**bits)."""
    lanes, width, tail = _grid(len(ids))
    grid = np.zeros((lanes, width), dtype=np.int64)
    grid.ravel()[: len(ids)] = ids
    escaped, begins = [], EPOCHS[0] if width > EPOCHS[0] else width
    start, share = (np.zeros((width - begins, lanes), dtype=np.uint32) for _ in range(2))
    right, tried = _records()
    for begin, end in _epochs(width):
        active = lanes if tail > begin else lanes - 1
        if not begin:
            escaped += [grid[: lanes if t < tail else lanes - 1, t] for t in range(end)]
            continue
        model = _Model(grid[:active, :begin], right, tried, bits)
        last = model.last
        for t in range(begin, end, _SLICE):
            part = grid[:active, t : min(t + _SLICE, end)]
            symbol = model.symbols(part)
            seen = np.concatenate([last, symbol], axis=1)
            last1 = seen[:, 1:-1]
            guess2, end2, guess1, end1, cell = model.guesses(seen[:, :-2], last1)
            by2, by1 = symbol == guess2, symbol == guess1
            low = np.where(by2, 0, np.where(by1, end2, _spread(model.edges[symbol], end1)))
            high = np.where(by2, end2, np.where(by1, end1, _spread(model.edges[symbol + 1], end1)))
            rows = slice(t - begins, t - begins + part.shape[1])
            start[rows, :active], share[rows, :active] = low.T, (high - low).T
            real = np.ones(part.shape, dtype=bool)
            if active == lanes:
                real[-1, max(tail - t, 0) :] = False
            escaped.append(part.T[((symbol == model.n) & real).T])  # by position, then block
            model.learn(*(x[real] for x in (symbol, last1, guess2, guess1, cell)), right, tried)
            last = seen[:, -2:]
    state, words = _pushed(start, share, tail - begins)
    return np.concatenate([np.zeros(0, dtype=np.int64), *escaped]), state, words


def decode_blocks(escaped, state, words, n_ids, bits):
    """The `n_ids` ids that `encode_blocks` was given; raises ValueError if something is missing."""
    lanes, width, tail = _grid(n_ids)
    grid = np.zeros((width, lanes), dtype=np.int64)  # by position
    state, words = state.astype(np.uint64), words.astype(np.uint64)
    at, read = 0, 0
    right, tried = _records()
    for begin, end in _epochs(width):
        active = lanes if tail > begin else lanes - 1
        if not begin:
            for t in range(end):
                now = lanes if t < tail else lanes - 1
                grid[t, :now] = escaped[at : at + now]
                at += now
            continue
        model = _Model(grid[:begin, :active].T, right, tried, bits)
        ids = np.append(model.ids, 0)
        seen = np.zeros((end - begin + 2, active), dtype=np.int64)
        seen[:2] = model.last.T
        for t in range(begin, end):
            now = active if t < tail else lanes - 1
            guess2, end2, guess1, end1, _ = model.guesses(seen[t - begin, :now], seen[t - begin + 1, :now])
            value = (state[:now] & np.uint64((1 << _TOTAL) - 1)).astype(np.int64)
            slot = (((np.maximum(value - end1, 0) + 1) << _SLOTS) - 1) // ((1 << _TOTAL) - end1)
            symbol = model.slots[slot].astype(np.int64)
            low, high = _spread(model.edges[symbol], end1), _spread(model.edges[symbol + 1], end1)
            guessed = np.flatnonzero(value < end1)
            if len(guessed):
                second = value[guessed] < end2[guessed]
                symbol[guessed] = np.where(second, guess2[guessed], guess1[guessed])
                low[guessed] = np.where(second, 0, end2[guessed])
                high[guessed] = np.where(second, end2[guessed], end1[guessed])
            x = (high - low).astype(np.uint64) * (state[:now] >> _U20) + (value - low).astype(np.uint64)
            due = np.flatnonzero(x < _LOWEST)
            x[due] = x[due] << _U32 | words[read : read + len(due)]
            read += len(due)
            state[:now] = x
            seen[t - begin + 2, :now] = symbol
            grid[t, :now] = ids[symbol]
            new = np.flatnonzero(symbol == model.n)
            grid[t, new] = escaped[at : at + len(new)]
            at += len(new)
        for t in range(0, end - begin, _SLICE):
            some = seen[t : t + _SLICE + 2]
            guess2, _, guess1, _, cell = model.guesses(some[:-2], some[1:-1])
            real = np.ones(guess2.shape, dtype=bool)
            if active == lanes:
                real[max(tail - begin - t, 0) :, -1] = False
            model.learn(*(x[real] for x in (some[2:], some[1:-1], guess2, guess1, cell)), right, tried)
    if at != len(escaped) or read != len(words) or (state != _LOWEST).any():
        raise ValueError("a token file is damaged")
    return np.ascontiguousarray(grid.T).ravel()[:n_ids]


def write_shard(doc_ids, lengths, ids):
    """A self-contained token file: header, document index, block index, escaped ids, states, words.

    `doc_ids` may hold None. The header and both indexes share a CRC-32; every block has its own.
    """
    ids = np.asarray(ids, dtype=np.int64)
    bits = max(int(ids.max()).bit_length(), 1) if len(ids) else 1
    escaped, state, words = encode_blocks(ids, bits) if len(ids) else [np.zeros(0, dtype=np.int64)] * 3
    raw = memoryview(ids.astype("<u4").tobytes())
    sums = [zlib.crc32(raw[k * BLOCK * 4 : (k + 1) * BLOCK * 4]) for k in range(len(state))]
    null = np.packbits([d is None for d in doc_ids]).tobytes()
    head = b"".join(
        [
            struct.pack(_HEAD, MAGIC, bits, BLOCK, len(doc_ids), len(ids), len(state), len(escaped), len(words)),
            np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
            null,
            np.array(lengths, dtype="<u4").tobytes(),
            np.array(sums, dtype="<u4").tobytes(),
        ]
    )
    body = [escaped.astype("<u2" if bits <= 16 else "<u4"), state.astype("<u8"), words.astype("<u4")]
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *[x.tobytes() for x in body]])


def read_shard(data):
    """(doc_ids, lengths, ids) of a token file; raises ValueError if it is damaged."""
    magic, bits, block, n_docs, n_ids, n_blocks, n_escaped, n_words = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token file of this version")
    at = struct.calcsize(_HEAD)

    def taken(*kinds):
        nonlocal at
        for kind, n in kinds:
            part = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += part.nbytes
            yield part

    numbers, null, lengths, sums = taken(("<i8", n_docs), ("u1", -(-n_docs // 8)), ("<u4", n_docs), ("<u4", n_blocks))
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the index of a token file is damaged")
    at += 4
    escaped, state, words = taken(("<u2" if bits <= 16 else "<u4", n_escaped), ("<u8", n_blocks), ("<u4", n_words))
    if at != len(data):
        raise ValueError("a token file is cut short")
    try:
        ids = decode_blocks(escaped, state, words, n_ids, bits) if n_ids else np.zeros(0, dtype=np.int64)
    except IndexError:  # damaged words may lead to ids that are not there
        raise ValueError("a block of a token file is damaged") from None
    raw = memoryview(ids.astype("<u4").tobytes())
    for k, want in enumerate(sums):
        if zlib.crc32(raw[k * BLOCK * 4 : (k + 1) * BLOCK * 4]) != want:
            raise ValueError(f"block {k} of a token file is damaged")
    missing = np.unpackbits(null, count=n_docs).astype(bool)
    return [None if m else int(d) for d, m in zip(numbers, missing)], lengths.astype(np.int64), ids
