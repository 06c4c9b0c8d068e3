"""LM scoring (operator 7): online logistic context mixing over hashed contexts.

*Model.* A text is a sequence of segments: a word with the white space before it.
Every byte of a segment is predicted bit by bit. Four predictors look at hashed
contexts inside the segment (one, two, three bytes, the whole segment so far); a fifth
looks, for the first ``LEAD`` bytes of a segment, at the last ``TAIL`` bytes of the segment
before and all of this one so far. Each hashed slot counts zeros and
ones over all training documents. A slot's log odds are weighted by a gate (its
predictor and how much it has seen), the weighted log odds are summed, and the sum is
refined by a probability map over (bits so far, quantised sum). Gate weights and map
are learnt from all training documents, each example without its own count. A byte's
example is fixed by the bytes before it that predictors look at, so Spark counts the
distinct ones (units). They are dealt by hash into groups of about ``GROUP``; each group
learns weights by small steps in the order of the hash, every unit by how often it
occurs, and the weights of the groups are averaged. The map then counts all units under
these weights. The score of a text is the sum of the log10 probabilities of its bits; it
does not depend on how the documents are spread over tasks, and it does depend on the
order of the words.

The bytes past a segment's first are predicted once for each distinct segment of a
block, its first ones once for each distinct pair of them and the end before, in slices
that stay in the cache; both are gathered to all places.

*Tables.* Slot counts have a fixed size (``SLOTS`` per predictor, 2 to ``PAIR_BITS`` for
the fifth), are counted from a task's distinct units and summed task by task; a task of few texts hands on only what is not 0.
Word counts grow with the corpus and stay in
Spark; the ``FREQUENT`` most frequent words (a bounded number, most of all tokens) travel
to the tasks, all others are joined, so no word is left out and no frequent word makes a
hot key.

Defined results: null or empty texts have one token, the end, and a score of 0; a null
id counts as the text '' (held out); without training documents every count is 0, V and
N are 0 and predictors know nothing; repeated rows are scored each on their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.tables import write_once
from quire.session import ship_package

PREDICTORS, SLOT_BITS, CHUNK = 4, 18, 1 << 8
SLOTS = 1 << SLOT_BITS
FINE, SPAN = 1024, 24                  # classes of the sum in the final table, their range around 0
LEAD, TAIL = 4, 2                      # bytes of a segment that are predicted across its start, and from how many
PAIR_BITS = 20                         # log2 of the fifth predictor's slots
SLICE = 1 << 16                        # bytes of pairs mixed at once
GATES, STEPS, MAP = 14, 4096, 64       # confidence classes, decisions a step, classes of the map
GROUP, ROUNDS = 1 << 20, 256           # units of a group; pieces of STEPS units it learns from, at least
LATE = -3 - LEAD                       # table of units past a segment's first bytes; before it, those of place 0, 1, ...
HELD = 1 << 20                         # a task's units of a table that are held before they are made distinct
MET = 1 << 19                          # segments whose bytes past the first are scored once a task
FREQUENT = 1 << 17
BLOCK_BYTES = 2_000_000
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_SO_FAR = np.uint32(0x9E3779B1)         # spreads the bits before a bit over the slots


# --- bits of distinct segments -------------------------------------------------


def coded(x: np.ndarray):
    """Distinct values of ``x`` by first occurrence, and each value's place among them; by hash, unsorted."""
    codes = pa.array(x).dictionary_encode()
    return codes.dictionary.to_numpy(), codes.indices.to_numpy()


def _first(which: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` codes occurs first."""
    at = np.empty(n, np.int64)
    at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return at


def segments(data: np.ndarray, offsets: np.ndarray):
    """Distinct segments of a block: their bytes end to end, their bounds, which
    distinct segment each segment of the block is, the texts' segment bounds, and
    the distinct segments' hashes."""
    space = W.SPACE_BREAKS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = edge[:-1].copy()
    start[1:] |= space[1:] & ~space[:-1]
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    hashes, which = coded(W.rolling(W._BYTE_VALUES[data], starts, ends))
    first = _first(which, len(hashes))
    size = ends[first] - starts[first]
    stops = np.cumsum(size)
    at = np.repeat(starts[first] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)
    return data[at], np.append(0, stops), which, np.searchsorted(starts, offsets), hashes


@dataclass
class Pairs:
    """Distinct segments of a block, and its distinct pairs of a segment's first ``LEAD``
    bytes and the last ``TAIL`` bytes of the segment before."""

    text: np.ndarray       # bytes of the distinct segments
    bounds: np.ndarray     # their bounds
    times: np.ndarray      # how often each occurs
    start: np.ndarray      # a segment of each pair's first bytes
    before: np.ndarray     # hash of the end of the segment before it (uint32; 0 at the start of a text)
    pair_times: np.ndarray
    which: np.ndarray      # pair of each segment of the block
    segment: np.ndarray    # distinct segment of each segment of the block
    ends: np.ndarray       # the texts' segment bounds
    hashes: np.ndarray     # of the distinct segments (uint64)

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Pairs:
        text, bounds, which, ends, own = segments(data, offsets)
        n, first = len(bounds) - 1, bounds[:-1]
        lead = W.rolling(W._BYTE_VALUES[text], first, np.minimum(first + LEAD, bounds[1:]))
        leads, inverse = coded(lead)
        same = _first(inverse, len(leads))[inverse]      # the first segment of the same first bytes
        tails, tail = coded(W.rolling(W._BYTE_VALUES[text], np.maximum(first, bounds[1:] - TAIL), bounds[1:]))
        number = np.zeros(len(which), np.int64)          # 1 + the end of the segment before
        number[1:] = tail[which[:-1]] + 1
        number[ends[:-1][ends[:-1] < len(which)]] = 0
        pair, at = coded(number * np.int64(n + 1) + same[which])
        times = np.bincount(at, minlength=len(pair))
        before, start = np.divmod(pair, n + 1)
        hashes = np.append(np.uint64(0), tails >> np.uint64(32)).astype(np.uint32)
        return cls(text, bounds, np.bincount(which, minlength=n), start, hashes[before], times, at, which, ends, own)

    def places(self):
        """Places of the first ``LEAD`` bytes of the pairs' segments, and of all bytes past
        the first ``LEAD`` of their segment."""
        size = np.diff(self.bounds)
        late = np.arange(len(self.text)) - np.repeat(self.bounds[:-1], size) >= LEAD
        used = np.zeros(len(size), bool)
        used[self.start] = True
        return np.flatnonzero(~late & np.repeat(used, size)), np.flatnonzero(late)

    def slices(self):
        """First and last pair of a run of pairs; for the first ``LEAD`` bytes of each, places
        in ``text``, hash before and times; the pairs' bounds in those."""
        size = np.minimum(np.diff(self.bounds), LEAD)[self.start]
        stops = np.cumsum(size)
        lo = 0
        while lo < len(size):
            done = stops[lo] - size[lo]
            hi = max(lo + 1, int(np.searchsorted(stops, done + SLICE, "right")))
            n = size[lo:hi]
            shift = self.bounds[self.start[lo:hi]] - (stops[lo:hi] - n - done)
            yield lo, hi, np.repeat(shift, n) + np.arange(stops[hi - 1] - done), np.repeat(self.before[lo:hi], n), \
                np.repeat(self.pair_times[lo:hi], n), np.append(0, stops[lo:hi] - done)
            lo = hi


def contexts(text: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Hash of each predictor's context before every byte (uint32)."""
    size = np.diff(bounds)
    place = np.arange(len(text)) - np.repeat(bounds[:-1], size)
    before = []
    for k in (1, 2, 3):
        b = np.zeros(len(text), np.uint32)
        b[k:] = text[:-k]
        b[place < k] = 0
        before.append(b + (place >= k).astype(np.uint32) * np.uint32(256))
    one = before[0]
    two = one * np.uint32(0x1003F) + before[1]
    three = two * np.uint32(0x1003F) + before[2]
    return [one * _MULT[0], two * _MULT[1], three * _MULT[2], so_far_hash(text, bounds)]


def so_far_hash(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of the segment before every byte (uint32): the fourth predictor's context."""
    whole = W.rolling(W._BYTE_VALUES[text], np.repeat(bounds[:-1], np.diff(bounds)), np.arange(len(text)))
    return (whole >> np.uint64(32)).astype(np.uint32)


def _slot(ctx: np.ndarray, so_far: np.ndarray, bits: int) -> np.ndarray:
    return _slot_of(ctx, so_far * _SO_FAR, bits)


def _slot_of(ctx: np.ndarray, spread: np.ndarray, bits: int) -> np.ndarray:
    h = (ctx + spread) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x297A2D39)) >> np.uint32(32 - bits)


def _count(table: np.ndarray, slots: np.ndarray, bit: np.ndarray, times: np.ndarray) -> None:
    """Add ``times`` to the counts of the slots' zeros and ones."""
    np.add.at(table, ((slots << np.uint32(1)) | bit).astype(np.int64), times)


def _bits(text: np.ndarray):
    """For each of the 8 bits: the bit, and the bits before it with a leading one."""
    t = text.astype(np.uint32) | np.uint32(256)
    for i in range(7, -1, -1):
        yield (t >> np.uint32(i)) & np.uint32(1), t >> np.uint32(i + 1)


def _after(ctx: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Context of the fifth predictor: the segment before, and this one so far."""
    h = ctx ^ (before * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15))
    return (h ^ (h >> np.uint32(13))) * np.uint32(0x85EBCA6B)


def decisions(text: np.ndarray, ctx: list[np.ndarray]):
    """For each of the 8 bits: the bit, the bits before it with a leading one, and
    the slot of every predictor."""
    for bit, so_far in _bits(text):
        spread = so_far * _SO_FAR
        yield bit, so_far, [_slot_of(c, spread, SLOT_BITS) for c in ctx]


# --- training ----------------------------------------------------------------


def gather_counts(bits: int):
    """Kernel over training documents: word counts (table -1), their number and that
    of texts (table -2), units (tables -3 to ``LATE``), and chunks of slot counts (the last
    table: pairs), each as one row of bytes or numbers. A chunk of mostly zeros is its
    places and their counts, whose number is ``c``."""
    return lambda batches: packed(_gather_counts(batches, bits))


def packed(batches):
    for batch in batches:
        if not len(batch) or batch.column(3).null_count:
            yield batch
            continue
        sizes, blobs = [], []
        for t, blob in zip(batch.column(0).to_pylist(), batch.column(3)):
            x = np.frombuffer(blob.as_buffer(), _kind(t))
            at = np.flatnonzero(x)
            few = len(at) < CHUNK
            sizes.append(len(at) if few else 0)
            blobs.append(at.astype("<u2").tobytes() + x[at].tobytes() if few else blob.as_py())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                                         batch.schema.names)


def unit_keys(p: Pairs, so_far: np.ndarray):
    """Table, keys and times of the block's examples. The low byte of a key is the byte, the
    next ones the bytes before it in its segment; its upper half is the hash of the
    segment before, or past the first ``LEAD`` bytes that of the whole segment so far."""
    text, late = p.text.astype(np.uint64), p.places()[1]
    def joined(upper, at, n):
        key = upper.astype(np.uint64) << np.uint64(32)
        for b in range(n):
            key |= text[at - b] << np.uint64(8 * b)
        return key

    yield LATE, joined(so_far[late], late, 4), np.repeat(p.times, np.diff(p.bounds))[late]
    for _, _, at, before, times, edges in p.slices():
        place = np.arange(len(at)) - np.repeat(edges[:-1], np.diff(edges))
        for j in range(LEAD):
            some = np.flatnonzero(place == j)
            yield -3 - j, joined(before[some], at[some], j + 1), times[some]


def unit_contexts(table: int, keys: np.ndarray):
    """The bytes of units of one table, and their predictors' contexts."""
    n = min(-2 - table, LEAD)
    upper = (keys >> np.uint64(32)).astype(np.uint32)
    text = np.stack([(keys >> np.uint64(8 * b)).astype(np.uint8) for b in range(n - 1, -1, -1)], 1).ravel()
    ctx = [c[n - 1::n] for c in contexts(text, np.arange(len(keys) + 1) * n)]
    if table == LATE:
        return text[n - 1::n], [*ctx[:3], upper]
    return text[n - 1::n], [*ctx, _after(ctx[3], upper)]


def _gather_counts(batches, bits: int):
    slots = [*np.zeros((PREDICTORS, 2 * SLOTS), np.int64), np.zeros(2 << bits, np.int64)]
    words: list[tuple[np.ndarray, np.ndarray]] = []
    units: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = n_texts = n_words = 0

    def merged():
        h = np.concatenate([x[0] for x in words])
        c = np.concatenate([x[1] for x in words])
        distinct, which = coded(h)
        return distinct, np.bincount(which, c, len(distinct)).astype(np.int64)

    def rows(table, keys, values, blobs=None):
        n = len(keys)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, table, np.int32)), pa.array(keys), pa.array(values),
             pa.array(blobs if blobs is not None else [None] * n, pa.binary())], ["t", "k", "c", "blob"])

    def tables(k, counts):
        chunks = counts.reshape(-1, 2 * CHUNK)
        used = np.flatnonzero(chunks.any(1))
        for lo in range(0, len(used), 1024):
            some = used[lo:lo + 1024]
            yield rows(k, some, np.zeros(len(some), np.int64), [chunks[i].tobytes() for i in some])

    def distinct(held_units):
        key, which = coded(np.concatenate([x[0] for x in held_units]))
        return key, np.bincount(which, np.concatenate([x[1] for x in held_units]), len(key)).astype(np.int64)

    def emitted(table, keys, times):
        """Units as rows; their bits are counted here, once for each distinct unit held, not in every block."""
        for lo in range(0, len(keys), SLICE):
            text, ctx = unit_contexts(table, keys[lo:lo + SLICE])
            for bit, so_far in _bits(text):
                spread = so_far * _SO_FAR
                for k, c in enumerate(ctx):
                    _count(slots[k], _slot_of(c, spread, bits if k == PREDICTORS else SLOT_BITS), bit, times[lo:lo + SLICE])
        yield rows(table, keys.view(np.int64), times)

    def add_unit(table, keys, times):
        held_units = units.setdefault(table, [])
        held_units.append((keys, times))
        if sum(len(x[0]) for x in held_units) > HELD:
            held_units[:] = [distinct(held_units)]
            if len(held_units[0][0]) > HELD // 2:
                yield from emitted(table, *held_units[0])
                held_units.clear()

    for batch in batches:
        for block in W.word_blocks(batch.column(0), block_bytes=BLOCK_BYTES):
            n_texts += block.n_texts
            n_words += len(block.starts)
            h, which = coded(block.word_hashes())
            words.append((h, np.bincount(which, minlength=len(h))))
            held += len(h)
            if held > 1_000_000:
                words = [merged()]
                held = len(words[0][0])
                if held > 500_000:
                    yield rows(-1, words[0][0].view(np.int64), words[0][1])
                    words, held = [], 0
            if not len(block.data):
                continue
            p = Pairs.of(block.data, block.offsets)
            for table, keys, times in unit_keys(p, so_far_hash(p.text, p.bounds)):
                yield from add_unit(table, keys, times)
    if held:
        h, c = merged()
        yield rows(-1, h.view(np.int64), c)
    for table, held_units in units.items():
        if held_units:
            yield from emitted(table, *distinct(held_units))
    yield rows(-2, np.array([0, 1]), np.array([n_texts, n_words]))
    for k, table in enumerate(slots):
        yield from tables(k, table)


def _kind(table: int) -> str:
    """The counts of every table are 64-bit."""
    return "<i8"


def sum_blobs(batches):
    """Kernel over rows dealt by (t, k): running sums of each chunk."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for t, k, n, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            at = np.frombuffer(blob.as_buffer(), "<u2", n) if n else slice(None)
            x = np.frombuffer(blob.as_buffer(), _kind(t), offset=2 * n)
            if (t, k) not in sums:
                sums[t, k] = np.zeros(2 * CHUNK, np.int64)
            sums[t, k][at] += x
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in sums], pa.int32()), pa.array([k for _, k in sums], pa.int64()),
             pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["t", "k", "blob"])


@dataclass
class Mixer:
    """Weighted log odds per slot, and the final tables: of the bytes that a neighbour
    helps to predict (0) and of the others (1)."""

    odds: np.ndarray       # (2, PREDICTORS, SLOTS) float32
    pairs: np.ndarray      # (2 ** bits,) float32: the fifth predictor's
    logs: np.ndarray       # (2, 256 * FINE * 2) float32: log10 P(bit) by bits so far, class of the sum, bit

    def bits(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each segment of ``text`` as the first of a text."""
        n = len(bounds) - 1
        once = np.ones(n, np.int64)
        all_ = np.arange(n)
        hashes = W.rolling(W._BYTE_VALUES[text], bounds[:-1], bounds[1:])
        return self.score(Pairs(text, bounds, once, all_, np.zeros(n, np.uint32), once, all_, all_, np.array([0, n]), hashes))

    def score(self, p: Pairs, met: Met | None = None) -> np.ndarray:
        """log10 probability of each segment of the block. ``met``: what earlier blocks found of
        the bytes past the segments' first ones, which depend on nothing else."""
        ctx = contexts(p.text, p.bounds)
        early, late = p.places()
        known, value = met.find(p.hashes) if met else (np.zeros(len(p.hashes), bool), 0.0)
        late = late[~np.repeat(known, np.diff(p.bounds))[late]]
        inside = np.empty((8, len(p.text)), np.float32)
        rest = np.zeros(len(p.text))
        for stage, places in enumerate((early, late)):
            for lo in range(0, len(places), SLICE):
                at = places[lo:lo + SLICE]
                for i, (bit, so_far, slots) in enumerate(decisions(p.text[at], [c[at] for c in ctx])):
                    z = self.odds[stage, 0][slots[0]]
                    for k in range(1, PREDICTORS):
                        z = z + self.odds[stage, k][slots[k]]
                    if stage:
                        rest[at] += self.logs[1][_cell(so_far, z, bit)]
                    else:
                        inside[i, at] = z
        rest = np.where(known, value, _sums(rest, p.bounds))
        if met:
            new = ~known & (np.diff(p.bounds) > LEAD)
            met.add(p.hashes[new], rest[new])
        out = np.zeros(len(p.start))
        size = int(len(self.pairs) - 1).bit_length()
        for lo, hi, at, before, _, edges in p.slices():
            after = _after(ctx[3][at], before)
            sums = np.zeros(len(at))
            for i, (bit, so_far) in enumerate(_bits(p.text[at])):
                sums += self.logs[0][_cell(so_far, inside[i][at] + self.pairs[_slot(after, so_far, size)], bit)]
            out[lo:hi] = _sums(sums, edges)
        return out[p.which] + rest[p.segment]


class Met:
    """A value for each hash met so far, of a bounded number of hashes."""

    def __init__(self):
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def find(self, hashes: np.ndarray):
        """Which of ``hashes`` have a value, and the values (others: any)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.values[at]

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Keep values of hashes that have none; past ``MET`` of them all earlier ones go."""
        if len(self.hashes) + len(hashes) <= MET:
            hashes, values = np.concatenate([self.hashes, hashes]), np.concatenate([self.values, values])
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def _class(z, n=MAP, span=16):
    return np.clip((z + span / 2) * (n / span), 0, n - 1).astype(np.int64)


def _cell(so_far, z, bit):
    """Place in the final table."""
    return ((so_far.astype(np.int64) * FINE + _class(z, FINE, SPAN)) << 1) + bit


def _odds(n0, n1):
    return np.log((n1 + 0.4) / (n0 + 0.4))


def _gate(n0, n1):
    return np.minimum(np.log2(n0 + n1 + 1), GATES - 1).astype(np.int64)


class Examples:
    """Units as examples: log odds and gates of their slots without their own count, from
    tables of all slots and both bits."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray):
        self.odds, self.gates = [], []
        for table in (*counts, pairs):
            n0, n1 = table[::2], table[1::2]
            self.odds.append(np.stack([_odds(np.maximum(n0 - 1, 0), n1), _odds(n0, np.maximum(n1 - 1, 0))], 1)
                             .astype(np.float32).ravel())
            self.gates.append(_gate(np.maximum(n0 + n1 - 1, 0), 0).astype(np.uint8))
        self.size = int(len(pairs) // 2 - 1).bit_length()

    def of(self, t: np.ndarray, k: np.ndarray, c: np.ndarray):
        """For both stages and each bit: stage, bit, bits before it, gates, odds, times."""
        for stage in (0, 1):
            some = [np.flatnonzero(t == x) for x in ((LATE,) if stage else range(-3, LATE, -1))]
            parts = [unit_contexts(int(t[i[0]]), k[i]) for i in some if len(i)]
            if not parts:
                continue
            text = np.concatenate([x[0] for x in parts])
            ctx = [np.concatenate(x) for x in zip(*(x[1] for x in parts))]
            times = c[np.concatenate(some)].astype(float)
            for bit, so_far in _bits(text):
                spread = so_far * _SO_FAR
                slots = [_slot_of(x, spread, self.size if j == PREDICTORS else SLOT_BITS).astype(np.int64)
                         for j, x in enumerate(ctx)]
                yield (stage, bit.astype(np.int64), so_far.astype(np.int64), [g[j] for g, j in zip(self.gates, slots)],
                       [o[2 * j + bit] for o, j in zip(self.odds, slots)], times)

    def weights(self, t: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Gate weights of both stages, learnt from units in their order, over and over until
        ``ROUNDS`` pieces of them have been."""
        out, step = np.full((2, PREDICTORS + 1, GATES), 0.3), [0, 0]
        pieces = -(-len(t) // STEPS)
        for _ in range(-(-ROUNDS // pieces) if pieces else 0):
            for lo in range(0, len(t), STEPS):
                part = slice(lo, lo + STEPS)
                for stage, bit, _, gates, odds, times in self.of(t[part], k[part], c[part]):
                    miss = times * (_sigmoid(sum(w[g] * o for w, g, o in zip(out[stage], gates, odds))) - bit)
                    step[stage] += 1
                    rate = 0.5 / (1 + step[stage] / 400) / times.sum()
                    for w, g, o in zip(out[stage], gates, odds):
                        w -= rate * np.bincount(g, miss * o, GATES)
        return out

    def cells(self, weights: np.ndarray, t: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Zeros and ones of the map's classes: (2, 256, MAP, 2)."""
        out = np.zeros((2, 256 * MAP * 2), np.int64)
        for lo in range(0, len(t), SLICE):
            part = slice(lo, lo + SLICE)
            for stage, bit, so_far, gates, odds, times in self.of(t[part], k[part], c[part]):
                z = sum(w[g] * o for w, g, o in zip(weights[stage], gates, odds))
                cell = ((so_far * MAP + _class(z)) << 1) + bit
                out[stage] += np.bincount(cell, times, 256 * MAP * 2).astype(np.int64)
        return out.reshape(2, 256, MAP, 2)


def _unit_arrays(batch):
    return batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()


def learn_groups(examples: Examples):
    """Kernel over units (t, k, c, g), those of a group after one another: each group's weights."""
    def learnt(group, held):
        w = examples.weights(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["g", "w"])

    def run(batches):
        group, held = None, []
        for batch in batches:
            g, arrays = batch.column(3).to_numpy(), _unit_arrays(batch)
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and g[lo] != group:
                        yield learnt(group, held)
                        held = []
                    group = int(g[lo])
                    held.append([x[lo:hi] for x in arrays])
        if held:
            yield learnt(group, held)
    return run


def map_cells(examples: Examples, weights: np.ndarray):
    """Kernel over units: the task's counts of the map's classes, in chunks for :func:`sum_blobs`."""
    def run(batches):
        out = np.zeros((2, 256, MAP, 2), np.int64)
        for batch in batches:
            out += examples.cells(weights, *_unit_arrays(batch))
        chunks = out.reshape(-1, 2 * CHUNK)
        used = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(used), np.int32)), pa.array(used), pa.array(np.zeros(len(used), np.int64)),
             pa.array([chunks[i].tobytes() for i in used], pa.binary())], ["t", "k", "c", "blob"])
    return run


def mix_of(counts: np.ndarray, pairs: np.ndarray, weights: np.ndarray, cells: np.ndarray) -> Mixer:
    def weighted(weights, table):
        out = np.empty(len(table) // 2, np.float32)
        for lo in range(0, len(out), SLOTS):
            n0, n1 = table[2 * lo:2 * (lo + SLOTS):2].astype(float), table[2 * lo + 1:2 * (lo + SLOTS):2].astype(float)
            out[lo:lo + SLOTS] = weights[_gate(n0, n1)] * _odds(n0, n1)
        return out

    refined = (2 * _sigmoid((np.arange(MAP) + 0.5) * 16 / MAP - 8) + cells[..., 1]) / (2 + cells.sum(-1))
    centre = (np.arange(FINE) + 0.5) * SPAN / FINE - SPAN / 2
    one = 0.5 * _sigmoid(centre) + 0.5 * np.clip(refined, 1e-4, 1 - 1e-4)[:, :, _class(centre)]
    logs = np.log10(np.stack([1 - one, one], axis=-1)).astype(np.float32).reshape(2, -1)
    odds = np.stack([[weighted(w[k], t) for k, t in enumerate(counts)] for w in weights])
    return Mixer(odds, weighted(weights[0][-1], pairs), logs)


def learn(counts: np.ndarray, texts: list[str], pairs: np.ndarray | None = None) -> Mixer:
    """Gate weights and map from a few texts. ``pairs`` are the fifth predictor's counts
    (zeros and ones of each slot in turn)."""
    pairs = np.zeros(2 * SLOTS, np.int64) if pairs is None else pairs
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    p = Pairs.of(data, np.cumsum([0] + [len(t.encode()) for t in texts]))
    found = list(unit_keys(p, so_far_hash(p.text, p.bounds)))
    t = np.concatenate([np.full(len(k), t) for t, k, _ in found])
    k, c = (np.concatenate([x[i] for x in found]) for i in (1, 2))
    examples = Examples(counts, pairs)
    weights = examples.weights(t, k, c)
    return mix_of(counts, pairs, weights, examples.cells(weights, t, k, c))


def learn_units(units: DataFrame, counts: np.ndarray, pairs: np.ndarray, group: int = GROUP) -> Mixer:
    """Gate weights and map from all units (t, k, c)."""
    examples = Examples(counts, pairs)
    groups = max(1, -(-units.count() // group))
    h = F.xxhash64("t", "k")
    dealt = units.select("t", "k", "c", F.pmod(h, F.lit(groups)).alias("g"), h.alias("h")).repartition(groups, "g") \
        .sortWithinPartitions("g", "h", "t", "k").drop("h")
    got = sorted(dealt.mapInArrow(learn_groups(examples), "g long, w binary").collect())     # a KB for a group
    weights = np.full((2, PREDICTORS + 1, GATES), 0.3)
    if got:
        weights = np.mean([np.frombuffer(r.w).reshape(weights.shape) for r in got], axis=0)
    cells = np.zeros((256 * MAP * 4 // (2 * CHUNK), 2 * CHUNK), np.int64)
    shape = "t int, k long, c long, blob binary"
    for r in units.mapInArrow(map_cells(examples, weights), shape).repartition(len(cells), "k") \
            .mapInArrow(sum_blobs, "t int, k long, blob binary").toLocalIterator():      # a row a chunk: a fixed size
        cells[r.k] = np.frombuffer(r.blob, "<i8")
    return mix_of(counts, pairs, weights, cells.reshape(2, 256, MAP, 2))


# --- scoring -----------------------------------------------------------------


def score_texts(mixer: Mixer, known: np.ndarray, logs: np.ndarray):
    """Kernel: per text its words, the sum of ``logs`` over its frequent words and
    their number, its other words' hashes, its score and bytes."""
    def run(batches):
        met = Met()
        for batch in batches:
            for block in W.word_blocks(batch.column(2), block_bytes=BLOCK_BYTES):
                h = block.word_hashes()
                distinct, which = coded(h)
                at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
                hit = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
                value = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(distinct))
                ends = block.bounds
                sums = np.diff(np.append(0, np.cumsum(hit[which]))[ends])
                base = _sums(value[which], ends)
                rare = ~hit[which]
                rare_n = np.diff(np.append(0, np.cumsum(rare))[ends])
                p = Pairs.of(block.data, block.offsets)
                score = _sums(mixer.score(p, met), p.ends)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n_texts), batch.column(1).slice(block.first, block.n_texts),
                     pa.array(np.diff(ends).astype(np.int64)), pa.array(base), pa.array(sums.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rare_n)).astype(np.int32)),
                                              pa.array(h[rare].view(np.int64))),
                     pa.array(score), pa.array(np.diff(block.offsets).astype(np.int64))],
                    ["doc_id", "held_out", "n_words", "base", "n_frequent", "rare", "score", "n_bytes"])
    return run


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's values, added up within the text only."""
    out = np.zeros(len(ends) - 1)
    some = np.flatnonzero(np.diff(ends) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, ends[:-1][some])
    return out


def _least_count(counts: DataFrame, frequent: int) -> int:
    """The least count such that no more than ``frequent`` words reach it, by classes of
    eight to an octave."""
    octave = F.floor(8 * F.log2("c"))
    rows = counts.groupBy(octave.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"))
    least, have = 1 << 62, 0
    for r in sorted(rows.collect(), key=lambda r: -r.k):       # a few hundred classes at most
        have += r.n
        if have > frequent:
            break
        least = r.least
    return least


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def lm_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT,
             group: int = GROUP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte of every row."""
    ship_package(docs.sparkSession)
    spark, kind = docs.sparkSession, dict(docs.dtypes)[doc_id]
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), lower.alias("text"))
    training = rows.where(~F.col("held_out"))

    gathered = write_once(training.select("text").mapInArrow(gather_counts(PAIR_BITS), "t int, k long, c long, blob binary"),
                          "mixing-gathered")
    counts = write_once(gathered.where("t = -1").groupBy(F.col("k").alias("word"))
                        .agg(F.sum("c").alias("c")), "mixing-words")
    totals = {r.k: r.c for r in gathered.where("t = -2").groupBy("k").agg(F.sum("c").alias("c")).collect()}  # two rows
    n_docs, n_words = totals.get(0, 0), totals.get(1, 0)
    n, v = n_words + n_docs, counts.count() + (n_docs > 0)
    z = n + 0.1 * (v + 1)

    blobs = gathered.where("t >= 0").select("t", "k", "c", "blob")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = blobs.repartition(parts, "t", "k").mapInArrow(sum_blobs, "t int, k long, blob binary")
    slots, pairs = np.zeros((PREDICTORS, SLOTS * 2), np.int64), np.zeros(2 << PAIR_BITS, np.int64)
    for r in summed.toLocalIterator():      # (PREDICTORS * SLOTS + 2 ** PAIR_BITS) / CHUNK rows at most: a fixed size
        table = pairs if r.t == PREDICTORS else slots[r.t]
        table[r.k * 2 * CHUNK:(r.k + 1) * 2 * CHUNK] = np.frombuffer(r.blob, "<i8")
    units = write_once(gathered.where("t < -2").groupBy("t", "k").agg(F.sum("c").alias("c")), "mixing-units")
    mixer = learn_units(units, slots, pairs, group)

    top = counts.where(F.col("c") >= _least_count(counts, frequent)).toArrow()      # at most `frequent` rows
    known = top.column(0).to_numpy().view(np.uint64)
    by = np.argsort(known)
    logs = np.log10((top.column(1).to_numpy()[by] + 0.1) / z)
    scored = rows.mapInArrow(score_texts(mixer, known[by], logs), f"""doc_id {kind}, held_out boolean, n_words long,
        base double, n_frequent long, rare array<long>, score double, n_bytes long""")
    scored = write_once(scored.withColumn("row", F.monotonically_increasing_id()), "mixing-scored")  # fixed once written
    others = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    others = others.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10((c + 0.1) / F.lit(z))).alias("more"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_more"))
    end = float(np.log10((n_docs + 0.1) / z))
    out = scored.drop("rare").join(others, "row", "left")
    return out.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_frequent") + F.coalesce("n_more", F.lit(0)) + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + end).alias("base_score"), "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"))
