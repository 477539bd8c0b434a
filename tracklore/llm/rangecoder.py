"""Token ids as range-coded blocks: predictions of order 0 to 2, mixed in the logistic domain, drive an arithmetic coder.

Every block starts from the same empty state, so it is read without any other. Many blocks are
coded beside each other, one numpy lane each: a step codes one id of every lane. An id is either
what followed the last two ids before (order 2), or what followed the last one (order 1), or
one of the block's ids, by how often each was spelled (order 0), or new. Candidates of orders 1 and
2 and their confidences follow every id. How likely they are right comes from counts of how often
predictions of their confidence were, mixed in the logistic domain with weights that follow the
errors; these chances and the spelled ids' shares are brought up to date at fixed steps of a block
(``LEARN``), for all steps since the last at once, and stand still in between. All arithmetic is
on integers, so that writer and reader agree on any machine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Ids of a block, blocks coded beside each other, and slots of a block's tables of predictions.
BLOCK, LANES, SLOTS = 2048, 768, 2048
#: Steps after which chances and shares are learned.
LEARN = (16, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072)
#: Predictions are probabilities of 16 bits, in tables by 12 of them.
_ONE, _FINE = 1 << 16, 1 << 12
#: Shares of spelled ids sum up to 2**_SHARES, and a block's range is cut into 2**_UNITS units for an id.
_SHARES, _UNITS = 12, 28


def _one(value: int, kind: type = np.uint64) -> np.ndarray:
    """A number as an array without axes, which numpy takes as an operand in half the time of a scalar."""
    return np.array(value, kind)


#: The coder's range is 2**32 or more before an id; words of 32 bits leave.
_BOTTOM, _WORD, _LOW, _ZERO = _one(1 << 32), _one(32), _one((1 << 32) - 1), _one(0)
_UNIT_BITS, _WHOLE, _LAST_UNIT = _one(_UNITS), _one(1 << _UNITS), _one((1 << _UNITS) - 1)
_SHARE_BITS, _LAST_SHARE = _one(_SHARES), _one((1 << _SHARES) - 1)
#: A lane's entry of a spelled id: the id, where its share begins and the share.
_ENTRY_ID, _ENTRY_START, _ENTRY_SHARE = _one(25), _one(13), _one(8191)
#: Confidences of a candidate are 0 (there is none) to 7; a state is both and whether the candidates are alike.
_STATES = 128
_SURE, _MISS, _ID, _STATE = _one(7, np.int64), _one(8, np.int64), _one(3, np.int64), _one(1, np.int64)
#: An id that none is, with a confidence of 0.
_NONE = 1 << 40
#: By confidence, after a hit and after a miss: what is added to it, and whether the candidate is replaced.
_TURN = np.array([1, 1, 1, 1, 1, 1, 1, 0, 0, 0, -1, -2, -2, -3, -3, -4])
_REPLACED = np.isin(np.arange(16), (8, 9))
#: Multipliers of the hashes that find candidates, and the bits left out of one.
_FIRST, _SECOND, _THIRD = (_one(x - (1 << 64), np.int64) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_SLOT_BITS = _one(64 - SLOTS.bit_length() + 1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """ln(p / (1 - p)) of a probability of 12 bits, times 256, and its inverse of 16 bits."""
    odds = [round(256 * math.log((i + 0.5) / (_FINE - i - 0.5))) for i in range(_FINE)]
    back = [min(max(round(_ONE / (1 + math.exp(-i / 256))), 48), _ONE - 48) for i in range(-2047, 2048)]
    return np.array(odds, np.int32), np.array(back, np.int32)


_ODDS, _BACK = _tables()
#: The confidences and likeness of each state, and the axes of (sure, sure of order 1, alike) that orders 2, 1 and 0 do not know.
_SURE_TWO, _SURE_ONE, _ALIKE = (x.reshape(8, 8, 2, 1) for x in np.unravel_index(np.arange(_STATES), (8, 8, 2)))
_UNKNOWN = (1, 0, (0, 1, 2))


class _Chance:
    """A bit's probability in each state and lane (the last axis), mixed from what orders 2, 1 and 0 say."""

    def __init__(self, lanes: int):
        shapes = (8, 1, 2, lanes), (1, 8, 2, lanes), (1, 1, 1, lanes)
        self.n, self.hits = ([np.full(s, x, np.int32) for s in shapes] for x in (2, 1))
        self.weight = [np.full((1, 1, 1, lanes), w, np.int32) for w in (24_000, 24_000, 8_000)]

    def predict(self) -> np.ndarray:
        """Probabilities of 16 bits."""
        self.odds = [_ODDS[(h * _FINE - 1) // n] for h, n in zip(self.hits, self.n, strict=True)]
        mixed = sum(o * w for o, w in zip(self.odds, self.weight, strict=True)) >> 16
        self.p = _BACK[np.clip(mixed, -2047, 2047) + 2047]
        return self.p

    def learn(self, n: np.ndarray, hits: np.ndarray) -> None:
        """Of ``n`` predictions in each state, ``hits`` were right."""
        off = (hits << 16) - n * self.p
        for order, axes in enumerate(_UNKNOWN):
            self.n[order] += n.sum(axis=axes, keepdims=True)
            self.hits[order] += hits.sum(axis=axes, keepdims=True)
            slope = (self.odds[order] * off.sum(axis=axes, keepdims=True)).sum(axis=(0, 1, 2), keepdims=True) >> 15
            self.weight[order] = np.clip(self.weight[order] + slope, -100_000, 100_000).astype(np.int32)


class _Model:
    """What all lanes have learned: candidates of orders 1 and 2 with confidences, chances, and the numbers of spelled ids."""

    def __init__(self, lanes: int, most: int):
        self.lane, self.width = np.arange(lanes), most + 1
        self.base, self.states = self.lane * SLOTS, self.lane * _STATES
        # A candidate's id and confidence are one number.
        self.tables = [np.full(lanes * SLOTS, _NONE, np.int64) for _ in range(2)]
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.two, self.one = _Chance(lanes), _Chance(lanes)
        #: How often each number of a lane was spelled; number 0 are new ids.
        self.times = np.zeros((lanes, self.width), np.int32)
        self.n = np.zeros(lanes, np.int64)

    def ready(self, k: int) -> None:
        """Bounds of orders 2 and 1 (``bounds``, in one number, by lane and state) and shares of numbers (``start``, ``share``) for the first ``k`` lanes."""
        two, one = (x.predict().astype(np.int64) for x in (self.two, self.one))
        two[0] = 0
        both = two + np.maximum((_ONE - two) * one >> 16, 1)
        both[:, 0] = two[:, 0]
        both[1:, :, 1] = two[1:, :, 1]
        bounds = (two << (_SHARES + 32) | both << _SHARES).astype(np.uint64)
        self.bounds = np.ascontiguousarray(bounds.reshape(_STATES, -1).T).reshape(-1)
        most = int(self.n[:k].max(initial=0)) + 1
        times = self.times[:k, :most]
        new = times[:, 0] // 2 + 1
        scale = (((1 << _SHARES) - 1 - self.n[:k]) << 12) // (times[:, 1:].sum(axis=1) + new)
        share = (times * scale[:, None] >> 12) + 1
        if self.n[:k].min(initial=most) < most - 1:
            share[np.arange(most) > self.n[:k, None]] = 0
        share[:, 0] = (1 << _SHARES) - share[:, 1:].sum(axis=1)
        self.share, self.start, self.row = share, np.cumsum(share, axis=1) - share, self.lane[:k] * most

    def predict(self, k: int) -> np.ndarray:
        """The states of the first ``k`` lanes; candidates of order 2 and order 1 are kept for ``learn``."""
        self.k, mark = k, self.last[:k] * _FIRST
        two = mark ^ self.before[:k]
        two *= _THIRD
        two = (two.view(np.uint64) >> _SLOT_BITS).view(np.int64)
        two += self.base[:k]
        one = (mark.view(np.uint64) >> _SLOT_BITS).view(np.int64)
        one += self.base[:k]
        self.slots = two, one
        self.found = a, b = self.tables[0][two], self.tables[1][one]
        self.sure = x, y = a & _SURE, b & _SURE
        state = x << _ID
        state += y
        state <<= _STATE
        state += self.states[:k]
        state += (a ^ b) < _MISS
        return state

    def learn(self, ids: np.ndarray, shifted: np.ndarray) -> list[np.ndarray]:
        """``ids`` came (``shifted`` by the bits of a confidence); how orders 2 and 1 were right: below 8 if they were."""
        fresh, turns = shifted + _STATE, []
        for table, slot, cand, sure in zip(self.tables, self.slots, self.found, self.sure, strict=True):
            # The difference of a hit is its confidence.
            turn = cand ^ shifted
            np.minimum(turn, sure | _MISS, out=turn)
            table[slot] = np.where(_REPLACED[turn], fresh, cand + _TURN[turn])
            turns.append(turn)
        np.multiply(self.last[: self.k], _SECOND, out=self.before[: self.k])
        self.last[: self.k] = ids
        return turns

    def gather(self, states: np.ndarray, kind: np.ndarray, number: np.ndarray, keys: np.ndarray, lanes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Learn of some steps: states and kinds (0: order 2, 1: order 1, 2: spelled), and of those spelled the numbers, keys and lanes.

        Returns lanes, keys and numbers of new keys, for the first ``k`` lanes.
        """
        n = np.bincount(states * 3 + kind, minlength=3 * len(self.bounds))
        n_two, n_one, rest = np.ascontiguousarray(n.reshape(-1, 3 * _STATES).T).reshape(8, 8, 2, 3, -1).transpose(3, 0, 1, 2, 4)
        left = n_one + rest
        self.two.learn((left + n_two) * (_SURE_TWO > 0), n_two)
        self.one.learn(left * ((_SURE_ONE > 0) & ((_SURE_TWO == 0) | (_ALIKE == 0))), n_one)
        most = self.share.shape[1]
        self.times[:k, :most] += np.bincount(lanes * most + number, minlength=k * most)[: k * most].reshape(k, most)
        new = (number == 0) & (lanes < k)
        found, times = np.unique((lanes[new].astype(np.uint64) << _WORD) | keys[new].astype(np.uint64), return_counts=True)
        lane, key = (found >> _WORD).astype(np.int64), found & _LOW
        per = np.bincount(lane, minlength=k)[:k]
        number = self.n[lane] + np.arange(1, len(lane) + 1) - (np.cumsum(per) - per)[lane]
        self.n[:k] += per
        self.times[lane, number] = times
        return lane, key, number


class _Writer:
    """A carry-less range coder in each lane, over 64 bits in words of 32."""

    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.out, self.used = np.empty((lanes, most), "<u4"), np.zeros(lanes, np.int64)

    def code(self, start: np.ndarray, size: np.ndarray, bits: np.ndarray, lanes: slice | np.ndarray) -> None:
        """The range becomes its stretch [start, start + size) of 2**bits units."""
        unit = self.range[lanes] >> bits
        low = self.low[lanes] + start * unit
        width = size * unit
        if (go := (width < _BOTTOM).nonzero()[0]).size:
            some, place = low[go], go if isinstance(lanes, slice) else lanes[go]
            used = self.used[place]
            self.out[place, used] = some >> _WORD
            self.used[place] = used + 1
            low[go], width[go] = some << _WORD, _cut(some, width[go]) << _WORD
        self.low[lanes], self.range[lanes] = low, width

    def payloads(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for k, word in enumerate((self.low >> _WORD, self.low & _LOW)):
            self.out[lanes, self.used + k] = word
        return [row[:n].tobytes() for row, n in zip(self.out, (self.used + 2).tolist(), strict=True)]


def _cut(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranges under 2**32, cut where their upper words would differ."""
    return np.minimum(size, _BOTTOM - (low & _LOW))


class _Reader:
    def __init__(self, payloads: list[bytes]):
        self.words = np.zeros((len(payloads), max(map(len, payloads)) // 4 + 4), "<u4")
        for row, payload in zip(self.words, payloads, strict=True):
            row[: len(payload) // 4] = np.frombuffer(payload, "<u4", len(payload) // 4)
        self.low, self.range = np.zeros(len(payloads), np.uint64), np.full(len(payloads), 2**64 - 1, np.uint64)
        self.value, self.used = (self.words[:, 0].astype(np.uint64) << _WORD) | self.words[:, 1], np.full(len(payloads), 2, np.int64)

    def place(self, bits: np.ndarray, last: np.ndarray, lanes: slice | np.ndarray) -> np.ndarray:
        """Which of 2**bits units each lane's value lies in; the ``last`` is larger."""
        self.unit, self.from_ = self.range[lanes] >> bits, self.low[lanes]
        return np.minimum((self.value[lanes] - self.from_) // self.unit, last)

    def narrow(self, start: np.ndarray, size: np.ndarray, lanes: slice | np.ndarray) -> None:
        low, width = self.from_ + start * self.unit, size * self.unit
        if (go := (width < _BOTTOM).nonzero()[0]).size:
            some, place = low[go], go if isinstance(lanes, slice) else lanes[go]
            used = self.used[place]
            self.value[place] = (self.value[place] << _WORD) | self.words[place, np.minimum(used, self.words.shape[1] - 1)]
            self.used[place] = used + 1
            low[go], width[go] = some << _WORD, _cut(some, width[go]) << _WORD
        self.low[lanes], self.range[lanes] = low, width


def _stages(sizes: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Steps from one learning to the next, and their parts (from, to, lanes) of the same lanes; ``sizes`` fall."""
    end, begin = int(sizes[0]), 0
    lanes_at = lambda t: int(np.searchsorted(-sizes, -t))
    for stop in [*(x for x in LEARN if x < end), end]:
        marks = [begin, *sorted({int(s) for s in sizes if begin < s < stop}), stop]
        yield begin, stop, [(a, b, lanes_at(a)) for a, b in zip(marks, marks[1:])]
        begin = stop


#: Bits of the halves that a new id is written in, and the largest.
_HALF_BITS, _HALF, _LAST_HALF = _one(16), _one(0xFFFF, np.int64), _one(0xFFFF)


def _halves(wide: bool) -> tuple[int, ...]:
    """Shifts of the 16-bit halves that a new id is written in."""
    return (16, 0) if wide else (0,)


def _ranks(steps: np.ndarray, wide: bool) -> np.ndarray:
    """Of each id (lanes, steps) its place among the distinct ids of its lane."""
    at = np.uint64 if wide else np.uint32
    keys = steps.astype(at) << at(12)
    keys |= np.arange(steps.shape[1], dtype=at)
    keys.sort(axis=1)
    ids, where = keys >> at(12), (keys & at(4095)).astype(np.int64)
    rank = np.zeros(steps.shape, np.int16)
    np.cumsum(ids[:, 1:] != ids[:, :-1], axis=1, out=rank[:, 1:])
    out = np.empty(steps.shape, np.int16)
    out[np.arange(len(steps))[:, None], where] = rank
    return out


def encode_blocks(ids: np.ndarray, wide: bool, block: int = BLOCK) -> list[bytes]:
    """Payloads of the ids, ``block`` (under 4,096) in each but the last; ids of over 16 bits must be ``wide``."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if not len(ids):
        return []
    lanes, block = -(-len(ids) // block), min(block, len(ids))
    padded = np.zeros(lanes * block, np.uint32)
    padded[: len(ids)] = ids
    padded = padded.reshape(lanes, block)
    sizes = np.full(lanes, block)
    sizes[-1] = len(ids) - (lanes - 1) * block
    model, coder = _Model(lanes, block), _Writer(lanes, (2 + wide) * block + 2)
    ranks, steps = np.ascontiguousarray(_ranks(padded, wide).T), np.ascontiguousarray(padded.T)
    steps = steps.astype(np.int64)
    shifted = steps << _ID
    numbers = np.zeros((lanes, block), np.int16)
    for begin, stop, parts in _stages(sizes):
        model.ready(parts[0][2])
        seen = []
        for a, b, k in parts:
            states, turns = np.empty((b - a, k), np.int64), np.empty((2, b - a, k), np.int64)
            for i, t in enumerate(range(a, b)):
                states[i] = model.predict(k)
                turns[0, i], turns[1, i] = model.learn(steps[t, :k], shifted[t, :k])
            two, one = turns < _MISS
            one &= ~two
            bounds = model.bounds[states]
            high, both = bounds >> _WORD, bounds & _LOW
            start, size = np.where(two, _ZERO, high), np.where(two, high, both - high)
            kind = np.where(two, 0, 2 - one)
            at, lane = np.nonzero(kind == 2)
            rank = ranks[a + at, lane].astype(np.int64)
            number = numbers[lane, rank].astype(np.int64)
            some, unit = both[at, lane], (_WHOLE - both[at, lane]) >> _SHARE_BITS
            place = (model.start[lane, number].astype(np.uint64), model.share[lane, number].astype(np.uint64))
            start[at, lane], size[at, lane] = some + place[0] * unit, place[1] * unit
            new = number == 0
            fresh = lane[new]
            cuts = np.searchsorted(at[new], np.arange(b - a + 1))
            for i in range(b - a):
                coder.code(start[i], size[i], _UNIT_BITS, slice(0, k))
                if cuts[i] < cuts[i + 1]:
                    which = fresh[cuts[i] : cuts[i + 1]]
                    value = steps[a + i, which]
                    for shift in _halves(wide):
                        coder.code((value >> shift & _HALF).view(np.uint64), np.ones(len(which), np.uint64), _HALF_BITS, which)
            seen.append((states.reshape(-1), kind.reshape(-1), number, rank, lane))
        if stop < block:
            lane, rank, number = model.gather(*(np.concatenate(x) for x in zip(*seen, strict=True)), int((sizes > stop).sum()))
            numbers[lane, rank.astype(np.int64)] = number
    return coder.payloads()


def decode_blocks(payloads: list[bytes], counts: list[int], wide: bool) -> list[np.ndarray]:
    """The ids of each payload, ``counts`` of them, as uint32."""
    order = sorted(range(len(counts)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order], np.int64)
    if not len(sizes) or not sizes[0]:
        return [np.zeros(0, np.uint32) for _ in counts]
    lanes, block = len(sizes), int(sizes[0])
    out = np.zeros((block, lanes), np.uint32)
    model, coder = _Model(lanes, block), _Reader([payloads[i] for i in order])
    ids = np.zeros((lanes, block + 1), np.uint64)
    for begin, stop, parts in _stages(sizes):
        model.ready(parts[0][2])
        # An id, where its share begins, and the share, in one number; and whose share each slot is.
        entries = (ids[: len(model.share), : model.share.shape[1]] << _ENTRY_ID | (model.start << 13 | model.share).astype(np.uint64)).reshape(-1)
        slots = np.repeat(np.broadcast_to(np.arange(model.share.shape[1], dtype=np.int16), model.share.shape).reshape(-1), model.share.reshape(-1))
        seen = []
        for a, b, k in parts:
            states, kind = np.empty((b - a, k), np.int64), np.empty((b - a, k), np.int64)
            spelled, all_lanes = [], slice(0, k)
            for i, t in enumerate(range(a, b)):
                states[i] = state = model.predict(k)
                bounds = model.bounds[state]
                high, both = bounds >> _WORD, bounds & _LOW
                spot = coder.place(_UNIT_BITS, _LAST_UNIT, all_lanes)
                below = spot >= high
                rest = spot >= both
                np.add(below, rest, out=kind[i], dtype=np.int64)
                start = high * below
                size = np.where(below, both, high)
                size -= start
                now = np.where(below, model.found[1], model.found[0]) >> _ID
                some, new = rest.nonzero()[0], ()
                if some.size:
                    low = both[some]
                    unit = (_WHOLE - low) >> _SHARE_BITS
                    slot = np.minimum((spot[some] - low) // unit, _LAST_SHARE).view(np.int64)
                    number = slots[(some << _SHARES) + slot]
                    entry = entries[model.row[some] + number]
                    start[some], size[some] = low + (entry >> _ENTRY_START & _LAST_SHARE) * unit, (entry & _ENTRY_SHARE) * unit
                    now[some] = entry >> _ENTRY_ID
                    new = some[number == 0]
                    spelled.append((number, some, t))
                coder.narrow(start, size, all_lanes)
                if len(new):
                    fresh = np.zeros(len(new), np.int64)
                    for shift in _halves(wide):
                        spot = coder.place(_HALF_BITS, _LAST_HALF, new)
                        coder.narrow(spot, np.ones(len(new), np.uint64), new)
                        fresh |= spot.view(np.int64) << shift
                    now[new] = fresh
                out[t, :k] = now
                model.learn(now, now << _ID)
            number, lane = (np.concatenate([s[j] for s in spelled]).astype(np.int64) if spelled else np.zeros(0, np.int64) for j in (0, 1))
            at = np.repeat([s[2] for s in spelled], [len(s[0]) for s in spelled]).astype(np.int64)
            seen.append((states.reshape(-1), kind.reshape(-1), number, out[at, lane], lane))
        if stop < block:
            lane, key, number = model.gather(*(np.concatenate(x) for x in zip(*seen, strict=True)), int((sizes > stop).sum()))
            ids[lane, number] = key
    found = [np.zeros(0, np.uint32)] * lanes
    for lane, i in enumerate(order):
        found[i] = out[: counts[i], lane].copy()
    return found
