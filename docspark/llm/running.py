"""Logistic mixing of context predictors over the words of running texts.

A text is a row of classes of words, closed by the class of its end. The bits
of a class, most significant first, are predicted one by one. Predictors hold
counts of ones and zeros under the bits before it and a context: none, the
class before, the last heavy class farther back in the text (frequent words,
which tell its language), the two classes before (hashed), and what followed
when these two stood last in the same text. A gate (bit, does that match still hold, how often
both were seen) chooses the weights that mix their log-odds; weights are learnt
online, and an adaptive table refines the mixed probability.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

LEVELS = 10
CLASSES = 1 << LEVELS
#: Class of words seen once or never, and of the end of a text.
RARE, END = 0, 1
SLOTS = 20
CONTEXTS = 3
INPUTS = CONTEXTS + 3  # contexts, no context, match, bias
GATES = 8
STEPS = 24
RATE = 0.2
LOT = 8192
#: Classes whose bits are worked on together, so that they stay in a near cache.
BLOCK = 2048
COUNTS = (CONTEXTS << SLOTS) + CLASSES
PRIOR = np.float32(0.4)


def heavy_classes(tokens: np.ndarray) -> np.ndarray:
    """Which classes have more of the training tokens than a like share."""
    out = tokens * CLASSES > 1.5 * tokens.sum()
    out[[RARE, END]] = False
    return out


def squash(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.minimum(np.maximum(x, -12), 12))
    e += 1
    return np.divide(1, e, out=e)


def _cell(x: np.ndarray) -> np.ndarray:
    """Cells of the refinement, by bit."""
    cell = ((x + np.float32(8)) * np.float32(STEPS / 16)).astype(np.int32)
    return np.minimum(np.maximum(cell, 0, out=cell), STEPS - 1, out=cell) + (_NEXT - 1) * np.int32(STEPS)


class Running:
    """Some texts' classes in a row, with what stands before each.

    The bits before a bit of a class, under a leading one, are its node. Slots of
    a context are laid out by bit, then context, then node, so that the first
    bits of all contexts lie close together; a slot twice, plus the bit, is the
    slot of the next bit.
    """

    def __init__(self, classes: np.ndarray, heavy: np.ndarray):
        s = classes.astype(np.uint32)
        n = len(s)
        one, two = np.full(n, END, np.uint32), np.full(n, END, np.uint32)
        one[1:], two[2:] = s[:-1], s[:-2]
        two[one == END] = END  # nothing is known beyond the beginning of a text
        self.classes, self.one, self.two = s, one, two
        at = np.arange(n)
        told = np.maximum.accumulate(np.where(heavy[s] | (s == END), at, -1))
        self.far = np.full(n, END, np.uint32)
        self.far[2:] = np.where(told[:-2] < 0, END, s[told[:-2]])
        self.far[one == END] = END
        self.both = (one * np.uint32(0x9E3779B1)) ^ (two * np.uint32(0x85EBCA77))

    @cached_property
    def expected(self) -> np.ndarray:
        """What followed the last time in the text that the two classes stood there; -1 if never."""
        n = len(self.classes)
        text = np.cumsum(self.one == END).astype(np.uint64)
        key = (text << np.uint64(2 * LEVELS)) | (self.one << np.uint32(LEVELS)) | self.two
        out = np.full(n, -1, np.int32)
        place = n.bit_length()
        if int(text[-1] if n else 0).bit_length() + 2 * LEVELS + place <= 64:
            # keys with their places sort faster than places by their keys
            key = np.sort((key << np.uint64(place)) | np.arange(n, dtype=np.uint64))
            order = (key & np.uint64((1 << place) - 1)).astype(np.int64)
            key >>= np.uint64(place)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        again = key[1:] == key[:-1]
        out[order[1:][again]] = self.classes[order[:-1][again]]
        return out

    def hashed(self, a: int, b: int, node: np.ndarray) -> np.ndarray:
        """Slots of the two classes before, for nodes of the classes from a to b."""
        h = self.both[a:b] ^ (node.astype(np.uint32) * np.uint32(0x2C1B3C6D))
        h *= np.uint32(0x297A2D39)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - SLOTS)
        return h

    def bits(self, a: int, b: int):
        """All bits of the classes from a to b, by bit and class: the bit, slots
        of contexts, does the match still hold, and the bit that it foretells.

        Slots of all contexts but the hashed are told as those of the next bit.
        """
        s, expected = self.classes[a:b].astype(np.int32), self.expected[a:b]
        top = np.int32(1 << LEVELS)
        one, far = self.one[a:b].astype(np.int32) | top, self.far[a:b].astype(np.int32) | top
        wrong = np.where(expected < 0, top, s ^ expected)
        node = s >> _LOW
        below = node | (top >> _LOW)
        slots = (one << _NEXT) | node, (far << _NEXT) | node, self.hashed(a, b, below >> 1), below
        agrees = wrong < (2 << _LOW)
        return node & 1, slots, agrees, (expected >> _LOW) & 1


_NEXT = np.arange(1, LEVELS + 1, dtype=np.int32)[:, None]
_LOW = LEVELS - _NEXT


def _rolled_up(leaves: np.ndarray, counts: np.ndarray) -> None:
    """Adds to zeros and ones of all nodes by slot, from counts by context and class."""
    for j in reversed(range(LEVELS)):
        pairs = leaves.reshape(-1, 2)
        first = len(leaves) // 2
        counts[:, first : 2 * first] += pairs.T
        leaves = pairs.sum(1)


def tally(classes: np.ndarray, heavy: np.ndarray, counts: np.ndarray) -> None:
    """Adds the bits of the classes to counts of zeros and ones by slot."""
    r = Running(classes, heavy)
    for k, before in enumerate((r.one, r.far)):
        leaves = np.bincount((before << np.uint32(LEVELS)) | r.classes, minlength=1 << SLOTS)
        _rolled_up(leaves, counts[:, k << SLOTS : (k + 1) << SLOTS])
    _rolled_up(np.bincount(r.classes, minlength=CLASSES), counts[:, CONTEXTS << SLOTS :])
    size = 1 << SLOTS
    both, one = np.zeros(2 * size, np.int32), np.int32(1)
    for j in range(LEVELS):
        node = (r.classes >> np.uint32(LEVELS - 1 - j)) | np.uint32(2 << j)
        slot = r.hashed(0, len(classes), node >> np.uint32(1))
        slot |= (node & np.uint32(1)) << np.uint32(SLOTS)
        slot.sort()  # slots in order are counted faster
        np.add.at(both, slot.astype(np.intp), one)
    counts[:, 2 << SLOTS : 3 << SLOTS] += both.reshape(2, -1)


#: Inputs that the gate and the foretold bit tell: match, where it holds, and bias.
_MATCH = np.tile(np.repeat([[0, 0], [-2, 2]], GATES // 2, axis=0), (LEVELS, 1)).astype(np.float32)
_BIAS = np.float32(0.3)


class Mixer:
    """Weights per gate and the counts that refine."""

    def __init__(self, counts: np.ndarray, heavy: np.ndarray, learnt: np.ndarray | None = None):
        self.counts, self.heavy = counts, heavy
        self.others = None
        self.start(learnt)

    def start(self, learnt: np.ndarray | None = None) -> None:
        n = LEVELS * GATES * INPUTS
        if learnt is None:
            learnt = np.zeros(n + 2 * LEVELS * STEPS)
            learnt[:n].reshape(-1, INPUTS)[:, : INPUTS - 1] = 0.3
        self.weights = learnt[:n].reshape(LEVELS, GATES, INPUTS).astype(np.float32)
        self.refined = learnt[n:].reshape(2, LEVELS, STEPS).copy()

    def learnt(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.refined.ravel()]).astype(float)

    def _others(self) -> list[np.ndarray]:
        """Log-odds by context, slot and bit, of all bits but that one."""
        if self.others is None:
            zeros, ones = self.counts
            odds = np.empty((2, self.counts.shape[1]), np.float32)
            odds[0] = np.log((ones + PRIOR) / (np.maximum(zeros - 1, 0) + PRIOR))
            odds[1] = np.log((np.maximum(ones - 1, 0) + PRIOR) / (zeros + PRIOR))
            self.others = self._by_context(odds, 1)
        return self.others

    def _by_context(self, odds: np.ndarray, own: int) -> list[np.ndarray]:
        """Log-odds of each context, by slot of the next bit; of the hashed one by
        bit and slot. There the last two bits of a number tell how often the slot
        was seen, so that one look gives both."""
        out = [odds[:, k << SLOTS : (k + 1) << SLOTS] for k in range(CONTEXTS + 1)]
        a, b = (CONTEXTS - 1) << SLOTS, CONTEXTS << SLOTS
        seen = self.counts[0, a:b] + self.counts[1, a:b] - own
        level = (seen > 0) + (seen > 2).astype(np.uint32) + (seen > 20)
        hashed = np.ascontiguousarray(out[CONTEXTS - 1])
        told = (hashed.view(np.uint32) & np.uint32(0xFFFFFFFC)) | level.astype(np.uint32)
        out = [np.ascontiguousarray(x.T).ravel() for x in out]
        out[CONTEXTS - 1] = told.view(np.float32).ravel()
        return out

    def _inputs(self, odds: list[np.ndarray], slots: list[np.ndarray], agrees: np.ndarray, match: np.ndarray):
        """Log-odds of the contexts, gates numbered over all bits, and those with what the match foretells."""
        x = np.empty((CONTEXTS + 1, *match.shape), np.float32)
        for k, slot in enumerate(slots):
            odds[k].take(slot, out=x[k], mode="clip")
        gate = (x[CONTEXTS - 1].view(np.int32) & 3) + agrees * np.int32(GATES // 2)
        gate += (_NEXT - 1) * np.int32(GATES)
        told = gate * 2
        told += match
        return x, gate.ravel().astype(np.intp), told.ravel().astype(np.intp)

    def _mixed(self, x: np.ndarray, gate: np.ndarray, told: np.ndarray) -> np.ndarray:
        *weights, match, bias = np.ascontiguousarray(self.weights.reshape(-1, INPUTS).T)
        mixed = (bias[:, None] * _BIAS + match[:, None] * _MATCH).ravel()[told]
        for own, odds in zip(weights, x, strict=True):
            part = own[gate]
            part *= odds.ravel()
            mixed += part
        return mixed.reshape(LEVELS, -1)

    def learn(self, classes: np.ndarray) -> None:
        """Online: the bits of each lot are predicted, then learnt from.

        The counts hold the texts themselves, so each bit is taken out of its own.
        """
        r = Running(classes, self.heavy)
        odds = self._others()
        each = np.arange(GATES, dtype=np.int8)[:, None]
        cells, n = np.zeros(2 * LEVELS * STEPS, np.int64), LEVELS * GATES
        for begin in range(0, len(classes), LOT):
            slope, bend = np.zeros((2, INPUTS, n))
            for a in range(begin, min(begin + LOT, len(classes)), BLOCK):
                bit, slots, *match = r.bits(a, min(a + BLOCK, begin + LOT))
                np.bitwise_or(slots[CONTEXTS - 1], bit.astype(np.uint32) << np.uint32(SLOTS), out=slots[CONTEXTS - 1])
                x, gate, told = self._inputs(odds, slots, *match)
                mixed = self._mixed(x, gate, told)
                p = squash(mixed)
                error, sure = bit.astype(np.float32) - p, p * (1 - p)
                y = np.empty((2 * len(x) + 3, *bit.shape), np.float32)
                np.multiply(x, error, out=y[: len(x)])
                np.multiply(x, x, out=y[len(x) : -3])
                y[len(x) : -3] *= sure
                y[-3], y[-2], y[-1] = error, sure, error * match[-1]
                gate = (gate.astype(np.int8) & np.int8(GATES - 1)).reshape(LEVELS, 1, -1)
                own = (gate == each).astype(np.float32)
                sums = (own @ y.transpose(1, 2, 0)).reshape(n, -1).T
                slope[: len(x)] += sums[: len(x)]
                bend[: len(x)] += sums[len(x) : -3]
                e, s, e1 = sums[-3:]
                slope[-2:] += _MATCH[:, 1] * (2 * e1 - e), _BIAS * e
                bend[-2:] += _MATCH[:, 1] ** 2 * s, _BIAS**2 * s
                cells += np.bincount((_cell(mixed) * 2 + bit).ravel(), minlength=len(cells))
            self.weights += (RATE * slope / (bend + 50)).T.reshape(self.weights.shape).astype(np.float32)
        self.refined += cells.reshape(LEVELS, STEPS, 2).transpose(2, 0, 1)

    def scorer(self):
        """A function from classes to the log10 probability of each."""
        zeros, ones = self.refined
        both = np.log((self.counts[1] + PRIOR) / (self.counts[0] + PRIOR))
        odds = self._by_context(both[None], 0)
        n = zeros + ones + 4
        share, refined = ((n + 4) / (2 * n)).ravel(), (ones / (2 * n)).ravel()

        def score(classes: np.ndarray) -> np.ndarray:
            r = Running(classes, self.heavy)
            out = np.empty(len(classes))
            for a in range(0, len(classes), BLOCK):
                bit, slots, agrees, match = r.bits(a, a + BLOCK)
                slots = [slot if k == CONTEXTS - 1 else slot >> 1 for k, slot in enumerate(slots)]
                mixed = self._mixed(*self._inputs(odds, slots, agrees, match))
                cell = _cell(mixed)
                p = squash(mixed) * share.take(cell, mode="clip")
                p += refined.take(cell, mode="clip")
                np.abs((1 - bit) - p).prod(0, out=out[a : a + BLOCK])
            return np.log10(out)

        return score
