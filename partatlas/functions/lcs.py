"""Longest common subsequences of many string pairs at once.

The bit-parallel recurrence keeps one bit per character of the first string and
takes one step per character of the second one (Hyyrö 2004). Here every step is
a numpy operation over a whole array of pairs.
"""

import numpy as np
import pyarrow as pa

TILE = 256  # strings of the left side handled together, so that the state stays in cache
COLUMNS = 2048  # strings of the right side handled together where lengths are apart
MASK_BYTES = 1 << 25  # of these, for all their words and characters


def _points(values):
    """Length of every string, and the code points of all in a row."""
    if isinstance(values, pa.Array) and len(values) and pa.types.is_string(values.type) and not values.null_count:
        offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
        flat = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        if flat.max(initial=0) < 128:
            return np.diff(offsets).astype(np.int64), flat  # a byte is a character
    if isinstance(values, pa.Array):
        values = values.to_pylist()
    lengths = np.fromiter((len(v) for v in values), dtype=np.int64, count=len(values))
    return lengths, np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _alphabet(flat):
    """The different characters, ascending, and the position of every character among them."""
    if flat.dtype == np.uint8:
        seen = np.bincount(flat, minlength=128) > 0
        return np.flatnonzero(seen), (np.cumsum(seen) - 1)[flat]
    return np.unique(flat, return_inverse=True)


class Strings:
    """Strings as a table of character codes plus the bit masks of every character."""

    def __init__(self, values):
        """`values` are a list of strings or an Arrow array of them."""
        self.lengths, flat = _points(values)
        width = max(1, int(self.lengths.max(initial=0)))
        inside = np.arange(width) < self.lengths[:, None]
        alphabet, codes = _alphabet(flat)
        self.codes = np.zeros(inside.shape, dtype=np.int32)
        self.codes[inside] = codes + 1
        # the narrowest machine word that holds the longest string
        self.bits = next((b for b in (16, 32) if width <= b), 64)
        kind = np.dtype(f"uint{self.bits}").type
        # masks[word, character, string]; character 0 pads and never matches
        self.masks = np.zeros((self.words(width), len(alphabet) + 1, len(values)), dtype=kind)
        rows = np.arange(len(values))
        for at in range(width):
            word, bit = divmod(at, self.bits)
            self.masks[word, self.codes[:, at], rows] |= kind(1 << bit)
        self.masks[:, 0, :] = 0

    def words(self, length):
        return -(-max(1, int(length)) // self.bits)


def _step(state, hits):
    """The next state (a word each) where `hits` are the masks of the character read; `hits` is used up."""
    carry = None
    for v, hit in zip(state, hits):
        hit &= v
        total = v + hit
        if len(state) > 1:
            over = total < v
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(v.dtype)
        v -= hit
        v |= total


def _length(state, kind):
    return sum(np.bitwise_count(~v).astype(kind) for v in state)


def _fresh(shape, masks, words):
    return [np.full(shape, np.iinfo(masks.dtype).max, dtype=masks.dtype) for _ in range(words)]


def lcs_table(strings: Strings, left, right, kind=np.int32):
    """LCS of every string in `left` (rows) with every string in `right` (columns), as numbers of type `kind`.

    The state after a beginning is that of every left string which begins so, so strings are sorted
    and each beginning that several of a tile share is run once.
    """
    words = strings.words(strings.lengths[right].max(initial=0))
    masks = [np.ascontiguousarray(strings.masks[w][:, right]) for w in range(words)]
    out = np.empty((len(left), len(right)), dtype=kind)
    order = np.lexsort(strings.codes[left].T[::-1])
    for begin in range(0, len(left), TILE):
        at = order[begin : begin + TILE]
        codes = strings.codes[left[at], : int(strings.lengths[left[at]].max(initial=0))]
        new = np.ones(codes.shape, dtype=bool)
        new[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
        node = np.zeros(len(at), dtype=np.int64)
        state = _fresh((1, len(right)), masks[0], words)
        for step in range(codes.shape[1]):
            first = np.flatnonzero(new[:, step])
            if len(first) > len(state[0]):
                state = [v[node[first]] for v in state]
            node = np.cumsum(new[:, step]) - 1
            _step(state, [m[codes[first, step]] for m in masks])
        out[at] = _length(state, kind)[node]
    return out


class _Sorted:
    """Strings by length and then by their characters, in runs of one length."""

    def __init__(self, lengths, codes):
        self.lengths, self.codes = lengths, codes
        self.order = np.lexsort([*codes.T[::-1], lengths])

    def runs(self, size):
        """Positions of at most `size` strings of one length each."""
        lengths = self.lengths[self.order]
        edges = np.flatnonzero(np.diff(lengths)) + 1
        for begin, end in zip(np.append(0, edges), np.append(edges, len(lengths))):
            for at in range(begin, end, size):
                yield self.order[at : min(at + size, end)]


def _beginnings(codes):
    """Of sorted strings of one length: for every step the state each different beginning goes on from (None: its own) and its character, and the state of every string."""
    new = np.ones(codes.shape, dtype=bool)
    new[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
    node, held, steps = np.zeros(len(codes), dtype=np.int64), 1, []
    for step in range(codes.shape[1]):
        first = np.flatnonzero(new[:, step])
        steps.append((node[first] if len(first) > held else None, codes[first, step]))
        node, held = np.cumsum(new[:, step]) - 1, len(first)
    return steps, node


def _carried(state, hits, last):
    """Where the sum of a state (a word each) and its hits carries out; unless this is the `last` step, the state goes on."""
    carry = None
    for v, hit in zip(state, hits):
        hit &= v
        total = v + hit
        over = total < v
        if carry is not None:
            total += carry
            over |= total < carry
        carry = over.view(np.uint8).astype(v.dtype) if len(state) > 1 else None
        if not last:
            v -= hit
            v |= total
    return over


def _counted(steps, node, shared, masks, kind):
    """LCS after the steps: it grows by one wherever the sum carries out of the last word.

    `shared` are the masks of the beginning that all columns have in common. What it carries goes into the
    lowest bit of the others, which is no character: the second half of `masks[0]` has it set.
    """
    width, letters = masks[0].shape[1], len(masks[0]) // 2
    common, state = _fresh((1, 1), shared[0], len(shared)) if shared else [], _fresh((1, width), masks[0], len(masks))
    length = np.zeros((1, width), dtype=kind)
    for step, (parents, letter) in enumerate(steps):
        last = step + 1 == len(steps)  # nothing reads the state after it
        if parents is not None:
            common, state = [v[parents] for v in common], [v[parents] for v in state]
            length = length[parents]
        first = letter
        if common:
            first = letter + letters * _carried(common, [m[letter] for m in shared], last)[:, 0]
        length += _carried(state, [masks[0][first], *[m[letter] for m in masks[1:]]], last).view(np.uint8)
        if not last:
            state[0] |= state[0].dtype.type(1)
    return length if len(length) == len(node) else length[node]


def _masks(codes, letters, bits, skip):
    """Per word, the bits of every character (a row each) in every string; the lowest `skip` bits are free."""
    word = np.dtype(f"uint{bits}").type
    masks = [np.zeros((letters, len(codes)), dtype=word) for _ in range(max(1, -(-(codes.shape[1] + skip) // bits)))]
    for at in range(codes.shape[1]):
        masks[(at + skip) // bits][codes[:, at], np.arange(len(codes))] |= word(1 << (at + skip) % bits)
    return masks


def tables_of_lengths(a, b, upper=False):
    """(rows, columns, table, wanted)s: the LCS of all strings of `a` with all of `b`, Arrow arrays.

    All strings at `rows`, positions in `a`, are of one length, and so are those at `columns`. Rows are
    sorted, and a beginning that several of them share is run once. With `upper`, for `a` with itself, every
    two strings are in one table: `wanted` says in which cells if not in all.
    """
    lengths, flat = _points(pa.concat_arrays([a, b]))
    width = max(1, int(lengths.max(initial=0)))
    inside = np.arange(width) < lengths[:, None]
    alphabet, coded = _alphabet(flat)
    codes = np.zeros(inside.shape, dtype=np.int32)
    codes[inside] = coded + 1
    left, right = (_Sorted(lengths[at], codes[at]) for at in (slice(None, len(a)), slice(len(a), None)))
    kind = np.uint8 if width < 255 else np.int64
    strips = [(rows, *_beginnings(left.codes[rows, : left.lengths[rows[0]]])) for rows in left.runs(TILE)]
    rank = np.empty(len(a), dtype=np.int32)
    rank[left.order] = np.arange(len(a))
    letters = len(alphabet) + 1
    fitting = MASK_BYTES // (letters * (width // 4 + 8))
    for columns in right.runs(min(max(fitting, 64), COLUMNS)):
        own = right.codes[columns, : right.lengths[columns[0]]]
        # sorted strings have a beginning in common; only what follows differs by column
        begin = int(np.logical_and.accumulate((own == own[0]).all(axis=0)).sum())
        bits = next((n for n in (8, 16, 32) if own.shape[1] - begin < n), 64)
        shared = _masks(own[:1, :begin], letters, 64, 0) if begin else []
        masks = _masks(own[:, begin:], letters, bits, 1)
        masks[0] = np.concatenate([masks[0], masks[0] | masks[0].dtype.type(1)])
        for rows, steps, node in strips:
            wanted = None
            if upper:
                place = rank[rows], rank[columns]
                if place[0][0] >= place[1][-1]:
                    continue
                wanted = place[0][:, None] < place[1] if place[0][-1] >= place[1][0] else None
            yield rows, columns, _counted(steps, node, shared, masks, kind), wanted


def lcs_pairs(strings: Strings, left, right):
    """LCS of string `left[k]` with string `right[k]` for every k."""
    words = strings.words(strings.lengths[right].max(initial=0))
    steps = int(strings.lengths[left].max(initial=0))
    codes, masks = strings.codes, strings.masks
    state = _fresh(len(left), masks, words)
    for step in range(steps):
        _step(state, [masks[w][codes[left, step], right] for w in range(words)])
    return _length(state, np.int32)


def ratio(lcs, total_length):
    """Normalised indel similarity 2·LCS / (len a + len b); two empty strings are equal."""
    total = np.asarray(total_length, dtype=np.float64)
    return np.where(total > 0, 2.0 * lcs / np.maximum(total, 1.0), 1.0)
