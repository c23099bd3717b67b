"""Acyclic automata over words that carry counts.

A ``CountAutomaton`` maps phrases of up to ``LEVELS`` words to whole numbers. A
path from the root spells a phrase, and the last arc of the path carries its
number. It is built from sorted phrases, a run of first words after another:
once a run has passed, its states are complete, and each is looked up in a
register, so that states with equal arcs exist once however many prefixes lead
to them. ``union`` adds the numbers of several automata, ``compose`` follows
the phrases of one automaton through another.

Words are byte strings; the alphabet is sorted, so number order is byte order.
Everything runs on arrays: a run's states are looked up in the register together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from affinis.llm.text import mix

LEVELS = 3
#: Compression of an automaton's bytes.
LEVEL = 3
#: Phrases of a run of the builder, unless one first word has more.
RUN = 1 << 20
#: With more words than this the key of a phrase would pass 63 bits.
MOST_WORDS = (1 << 21) - 2
_SALTS = mix(np.arange(1, 3, dtype=np.uint64))


@dataclass(frozen=True)
class Phrases:
    """Sorted distinct phrases: word numbers by column, -1 after the end, and a number each."""

    words: np.ndarray
    numbers: np.ndarray
    alphabet: pa.Array

    def __len__(self) -> int:
        return len(self.numbers)

    def lengths(self) -> np.ndarray:
        return (self.words >= 0).sum(axis=1)

    def select(self, rows: np.ndarray) -> Phrases:
        """Some of the phrases, in order, with the words they use."""
        words = self.words[rows]
        occurs = np.zeros(len(self.alphabet) + 1, dtype=bool)
        occurs[words] = True
        used = np.flatnonzero(occurs[:-1])
        place = np.full(len(self.alphabet) + 1, -1, dtype=np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        return Phrases(place[words], self.numbers[rows], self.alphabet.take(pa.array(used)))

    def texts(self) -> pa.Array:
        """The words of each phrase joined by spaces."""
        out, length = None, self.lengths()
        for level in range(LEVELS):
            # Word numbers of -1 are null, which the join skips.
            column = self.alphabet.take(pa.array(self.words[:, level], mask=length <= level))
            out = column if out is None else pc.binary_join_element_wise(out, column, pa.scalar(b" ", self.alphabet.type), null_handling="skip")
        return out


def keys(words: np.ndarray, size: int) -> np.ndarray:
    """One whole number per phrase over an alphabet of ``size`` words, in the order of the phrases."""
    if size > MOST_WORDS:
        raise ValueError(f"{size} words are too many for keys of 63 bits")
    out = np.zeros(len(words), dtype=np.int64)
    for level in range(words.shape[1]):
        out = out * (size + 1) + (words[:, level].astype(np.int64) + 1)
    return out


def _spelled_out(key: np.ndarray, size: int) -> np.ndarray:
    """The words of each key."""
    words = np.empty((len(key), LEVELS), dtype=np.int32)
    for level in range(LEVELS - 1, -1, -1):
        key, words[:, level] = np.divmod(key, size + 1)
    return words - 1


def summed(words: np.ndarray, numbers: np.ndarray, alphabet: pa.Array, by=np.add) -> Phrases:
    """Phrases in any order, equal ones put together."""
    if not len(words):
        return Phrases(words, numbers, alphabet)
    if len(alphabet) <= MOST_WORDS:
        key = keys(words, len(alphabet))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort(tuple(words[:, level] for level in range(LEVELS - 1, -1, -1)))
        new = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    first = np.flatnonzero(np.concatenate([[True], new]))
    return Phrases(words[order[first]], by.reduceat(numbers[order], first), alphabet)


def joint_alphabet(alphabets: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """(sorted words of all, new numbers of each alphabet's words)."""
    coded = pa.concat_arrays(alphabets).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    new = rank[coded.indices.to_numpy()]
    edges = np.cumsum([0, *(len(one) for one in alphabets)])
    return coded.dictionary.take(order), [new[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


class CountAutomaton:
    """States own consecutive arcs (label, number, target); target -1 leads nowhere, number 0 ends no phrase."""

    def __init__(self, alphabet: pa.Array, label: np.ndarray, number: np.ndarray, target: np.ndarray, bounds: np.ndarray, root: int):
        self.alphabet, self.label, self.number, self.target, self.bounds, self.root = alphabet, label, number, target, bounds, root

    # ---- building ----

    @classmethod
    def build(cls, phrases: Phrases) -> CountAutomaton:
        builder, words, numbers = _Builder(), phrases.words, phrases.numbers
        at = 0
        while at < len(numbers):
            stop = min(at + RUN, len(numbers))
            if stop < len(numbers):
                # A run ends before a first word; one with more phrases than a run holds is taken whole.
                cut = int(np.searchsorted(words[:, 0], words[stop, 0]))
                stop = cut if cut > at else int(np.searchsorted(words[:, 0], words[stop, 0], side="right"))
            builder.add(words[at:stop], numbers[at:stop])
            at = stop
        return cls(phrases.alphabet, *builder.finish())

    # ---- reading ----

    def _below(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``states``, arc) of all arcs of the given states."""
        count = self.bounds[states + 1] - self.bounds[states]
        owner = np.repeat(np.arange(len(states)), count)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.bounds[states], count)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, numbers) of its phrases, shorter ones first."""
        states, prefix = np.array([self.root]), np.full((1, LEVELS), -1, dtype=np.int32)
        rows, numbers = [], []
        for level in range(LEVELS):
            owner, arc = self._below(states)
            prefix = prefix[owner]
            prefix[:, level] = self.label[arc]
            ends = self.number[arc] > 0
            rows.append(prefix[ends])
            numbers.append(self.number[arc][ends])
            onward = self.target[arc] >= 0
            prefix, states = prefix[onward], self.target[arc][onward]
        return np.concatenate(rows), np.concatenate(numbers)

    def phrases(self) -> Phrases:
        return summed(*self.rows(), self.alphabet)

    def compose(self, asked: Phrases) -> np.ndarray:
        """The number of each asked phrase, 0 where there is none: its path is followed level by level."""
        known = pc.index_in(asked.alphabet, value_set=self.alphabet).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.append(known.astype(np.int64), -2)  # -2: the phrase has ended
        size = len(self.alphabet) + 1
        arcs = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)) * size + self.label
        state = np.full(len(asked), self.root, dtype=np.int64)
        found = np.zeros(len(asked), dtype=np.int64)
        for level in range(LEVELS):
            label = known[asked.words[:, level]]
            going = np.flatnonzero((label != -2))
            live = going[(state[going] >= 0) & (label[going] >= 0)]
            wanted = state[live] * size + label[live]
            at = np.minimum(np.searchsorted(arcs, wanted), max(0, len(arcs) - 1))
            hit = arcs[at] == wanted if len(arcs) else np.zeros(0, dtype=bool)
            found[going], state[going] = 0, -1
            found[live[hit]] = self.number[at[hit]]
            state[live[hit]] = self.target[at[hit]]
        return found

    # ---- bytes ----

    def to_bytes(self) -> bytes:
        _, offsets, data = self.alphabet.buffers()
        edges = np.frombuffer(offsets, dtype=np.int64)[self.alphabet.offset : self.alphabet.offset + len(self.alphabet) + 1]
        text = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        arrays = [_narrow(array) for array in (np.diff(edges), text, self.label, self.number, self.target + 1, np.diff(self.bounds), np.array([self.root]))]
        head = np.array([value for array in arrays for value in (array.itemsize, len(array))], dtype=np.int64)
        return zstandard.compress(b"".join([head.tobytes(), *(array.tobytes() for array in arrays)]), LEVEL)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        data = zstandard.decompress(data)
        head, at, arrays = np.frombuffer(data, dtype=np.int64, count=14), 14 * 8, []
        for width, count in zip(head[::2], head[1::2], strict=True):
            arrays.append(np.frombuffer(data, dtype=f"<u{width}", count=count, offset=at))
            at += int(width * count)
        lengths, text, label, number, target, sizes, root = arrays
        edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        alphabet = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(text)])
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return cls(alphabet, label.astype(np.int32), number.astype(np.int64), target.astype(np.int64) - 1, bounds, int(root[0]))


class _Builder:
    """Register of complete states, by a print of their arcs. Deeper states come first; the root is last."""

    def __init__(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        self._arcs = (none.astype(np.int32), none, none)
        self._bounds = np.zeros(1, dtype=np.int64)
        self._prints, self._states = none.astype(np.uint64), none
        self._root: list[tuple[np.ndarray, ...]] = []

    def add(self, words: np.ndarray, numbers: np.ndarray) -> None:
        """A sorted run with all phrases of its first words."""
        targets = np.zeros(0, dtype=np.int64)
        heads = np.zeros((0, LEVELS), dtype=words.dtype)
        for level in range(LEVELS - 1, 0, -1):
            heads, label, number, target, bounds = self._level(words, numbers, level, heads, targets)
            targets = self._registered(label, number, target, bounds)
        _, label, number, target, _ = self._level(words, numbers, 0, heads, targets)
        self._root.append((label, number, target))

    @staticmethod
    def _level(words, numbers, level, heads, targets):
        """Arcs after prefixes of ``level`` words: (prefixes, labels, numbers, targets, bounds by prefix).

        ``heads`` are the prefixes one word longer, which are states ``targets`` already.
        """
        ends = words[:, level] >= 0
        if level + 1 < LEVELS:
            ends &= words[:, level + 1] < 0
        path = np.concatenate([words[ends, : level + 1], heads[:, : level + 1]])
        number = np.concatenate([numbers[ends], np.zeros(len(heads), dtype=numbers.dtype)])
        target = np.concatenate([np.full(int(ends.sum()), -1, dtype=np.int64), targets])
        if len(heads):
            # Both parts are sorted; the stable sort merges them.
            width = int(path[:, -1].max()) + 1
            order = np.argsort(path[:, 0].astype(np.int64) * width + (path[:, 1] if level else 0), kind="stable")
            path, number, target = path[order], number[order], target[order]
        if not len(path):
            return path[:, :level], path[:, level], number, target, np.zeros(1, dtype=np.int64)
        new = np.concatenate([[True], (path[1:] != path[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        path, number, target = path[first], np.maximum.reduceat(number, first), np.maximum.reduceat(target, first)
        head = path[:, :level]
        starts = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]).any(axis=1)]))
        return head[starts], path[:, level], number, target, np.append(starts, len(path))

    def _registered(self, label, number, target, bounds) -> np.ndarray:
        """State numbers of complete states; those that the register lacks are added."""
        groups = len(bounds) - 1
        if not groups:
            return np.zeros(0, dtype=np.int64)
        arcs, size, starts = (label, number, target), np.diff(bounds), bounds[:-1]
        place = (np.arange(len(label)) - np.repeat(starts, size)).astype(np.uint64)
        mixed = mix(label.astype(np.uint64) + number.astype(np.uint64) * _SALTS[0] + mix(target.astype(np.uint64) + place * _SALTS[1]))
        prints = np.add.reduceat(mixed, starts)
        order = np.argsort(prints, kind="stable")
        new = np.concatenate([[True], np.diff(prints[order]) != 0])
        leader = np.empty(groups, dtype=np.int64)
        leader[order] = order[new][np.cumsum(new) - 1]
        # Equal prints are not proof: a state with other arcs than its leader stays a state of its own.
        odd = np.flatnonzero(~_same_arcs(arcs, starts, size, arcs, starts[leader], size[leader]))
        leader[odd] = odd
        chosen = np.flatnonzero(leader == np.arange(groups))
        state = np.full(groups, -1, dtype=np.int64)
        if len(self._prints):
            at = np.minimum(np.searchsorted(self._prints, prints[chosen]), len(self._prints) - 1)
            known, old = np.flatnonzero(self._prints[at] == prints[chosen]), self._states[at]
            mine, theirs = chosen[known], old[known]
            same = _same_arcs(arcs, starts[mine], size[mine], self._arcs, self._bounds[theirs], np.diff(self._bounds)[theirs])
            state[mine[same]] = theirs[same]
        kept = chosen[state[chosen] < 0]
        first = len(self._bounds) - 1
        state[kept] = first + np.arange(len(kept))
        own = np.repeat(starts[kept], size[kept]) + _within(size[kept])
        self._arcs = tuple(np.concatenate([all_, one[own]]) for all_, one in zip(self._arcs, arcs, strict=True))
        self._bounds = np.concatenate([self._bounds, self._bounds[-1] + np.cumsum(size[kept])])
        prints, states = np.concatenate([self._prints, prints[kept]]), np.concatenate([self._states, state[kept]])
        order = np.argsort(prints, kind="stable")
        self._prints, self._states = prints[order], states[order]
        return state[leader]

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        label, number, target = (np.concatenate([all_, *ends]) for all_, *ends in zip(self._arcs, *self._root, strict=True))
        return label, number, target, np.append(self._bounds, len(label)), len(self._bounds) - 1


def _same_arcs(left, left_start, left_size, right, right_start, right_size) -> np.ndarray:
    """Whether states of one set of arcs equal states of another, one by one."""
    same = left_size == right_size
    some = np.flatnonzero(same & (left_size > 0))
    if len(some):
        size = left_size[some]
        step = _within(size)
        a, b = np.repeat(left_start[some], size) + step, np.repeat(right_start[some], size) + step
        equal = np.ones(len(step), dtype=bool)
        for one, other in zip(left, right, strict=True):
            equal &= one[a] == other[b]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return same


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive groups."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _narrow(array: np.ndarray) -> np.ndarray:
    most = int(array.max(initial=0))
    return array.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def union(fragments: list[bytes], least: int = 1) -> tuple[Phrases, int]:
    """(phrases whose numbers add up to ``least`` or more over all automata, sum of the numbers of single words).

    One automaton is read at a time; what is held of all is a key and a number per phrase.
    """
    alphabet, new = joint_alphabet([CountAutomaton.from_bytes(data).alphabet for data in fragments])
    size = len(alphabet)
    held, numbers, single = [], [], 0
    for data, number in zip(fragments, new, strict=True):
        words, own = CountAutomaton.from_bytes(data).rows()
        single += int(own[words[:, 1] < 0].sum())
        words = np.append(number, np.int32(-1))[words]
        held.append(keys(words, size) if size <= MOST_WORDS else words)
        numbers.append(own)
    held, numbers = np.concatenate(held), np.concatenate(numbers)
    if size > MOST_WORDS:
        total = summed(held, numbers, alphabet)
        return total.select(np.flatnonzero(total.numbers >= least)), single
    order = np.argsort(held)
    held, numbers = held[order], numbers[order]
    del order
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(held)), dtype=bool), held[1:] != held[:-1]]))
    sums = np.add.reduceat(numbers, first) if len(first) else numbers
    enough = np.flatnonzero(sums >= least)
    kept = Phrases(_spelled_out(held[first[enough]], size), sums[enough], alphabet)
    return kept.select(np.arange(len(kept))), single
