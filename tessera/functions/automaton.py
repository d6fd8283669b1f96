"""Many names at once in many texts: an Aho-Corasick automaton as flat arrays, run over lanes of bytes by NumPy."""

from __future__ import annotations

import re

import numpy as np

#: Texts are cut into so many lanes at most, which take a step together.
LANES, STEPS = 4096, 128
WORD = np.array([chr(c).isalnum() if c < 128 else False for c in range(256)])


class Automaton:
    """Finds all places of distinct, non-empty byte strings. table[state, class of byte] is the next state; states are trie nodes."""

    def __init__(self, names: list[bytes]):
        self.names = names
        self.longest = max(map(len, names), default=0)
        used = sorted({c for n in names for c in n})
        self.classes = np.zeros(256, np.uint8 if len(used) < 256 else np.int16)
        self.classes[used] = np.arange(1, len(used) + 1)
        kids: list[dict[int, int]] = [{}]
        ends, depth = [-1], [0]
        for k, name in enumerate(names):
            at = 0
            for c in self.classes[list(name)].tolist():
                if c not in kids[at]:
                    kids[at][c] = len(kids)
                    kids.append({}), ends.append(-1), depth.append(depth[at] + 1)
                at = kids[at][c]
            ends[at] = k
        self.ends = np.array(ends)
        self.table = np.zeros((len(kids), len(used) + 1), np.int32)
        #: The next shorter name that ends where a state's does, as a state; 0 is none.
        self.shorter = np.zeros(len(kids), np.int32)
        fail = np.zeros(len(kids), np.int32)
        for at in np.argsort(depth, kind="stable").tolist():  # what a state falls back to is less deep
            back = self.table[fail[at]].copy() if at else self.table[0]
            for c, to in kids[at].items():
                fail[to] = back[c] if at else 0
                back[c] = to
            self.table[at] = back
            self.shorter[at] = fail[at] if ends[fail[at]] >= 0 else self.shorter[fail[at]]
        self.hot = (self.ends >= 0) | (self.shorter > 0)

    def find(self, data: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(name, place of its last byte) of all places in data; gaps are places that no name goes over."""
        classes = self.classes[data]
        classes[gaps] = 0
        lanes = min(LANES, max(1, len(data) // 256))
        width, warm = -(-len(data) // lanes), self.longest  # a lane begins so early that its state is right where it counts
        padded = np.zeros(warm + lanes * width, classes.dtype)
        padded[warm : warm + len(data)] = classes
        view = np.lib.stride_tricks.as_strided(padded, (warm + width, lanes), (padded.itemsize, width * padded.itemsize))
        flat, columns, state = self.table.ravel(), self.table.shape[1], np.zeros(lanes, np.int32)
        states, places = [], []
        for first in range(0, warm + width, STEPS):
            seen = np.empty((min(STEPS, warm + width - first), lanes), np.int32)
            for k in range(len(seen)):
                seen[k] = state = flat[state * columns + view[first + k]]
            step, lane = np.nonzero(self.hot[seen])
            counts = step + first >= warm
            states.append(seen[step[counts], lane[counts]])
            places.append(lane[counts] * width + step[counts] + first - warm)
        state, place = np.concatenate(states), np.concatenate(places)
        names, ends = [], []
        while len(state):
            own = self.ends[state] >= 0
            names.append(self.ends[state[own]]), ends.append(place[own])
            state, place = self.shorter[state], place
            state, place = state[state > 0], place[state > 0]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *names]), np.concatenate([none, *ends])


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with one byte before each and after the last, and the places of those bytes."""
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    gaps = np.concatenate([[0], np.cumsum(sizes + 1)])
    data = np.frombuffer(b"\0" + b"\0".join(t or b"" for t in texts) + b"\0", np.uint8)
    return data, gaps


def standing(automaton: Automaton, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, times) of names that stand between two characters other than letters and digits.

    Both characters belong to a place, so that neighbours don't share one: places of a name are taken from the left.
    Letters and digits are those of ASCII, any other character is one to stand between, but a text's ends are none.
    """
    data, gaps = joined(texts)
    name, last = automaton.find(data, gaps)
    first = last - np.array([len(n) for n in automaton.names], np.int64)[name] + 1
    between = ~WORD[data]
    between[gaps] = False
    free = between[first - 1] & between[last + 1]
    name, first, last = name[free], first[free], last[free]
    text = np.searchsorted(gaps, first, side="right") - 1
    character = np.cumsum((data & 0xC0) != 0x80)  # numbers characters, however many bytes they have
    order = np.lexsort((first, name, text))
    name, text, before, after = name[order], text[order], character[first[order] - 1], character[last[order] + 1]
    new = np.r_[True, (name[1:] != name[:-1]) | (text[1:] != text[:-1])] if len(name) else np.zeros(0, bool)
    keep = np.ones(len(name), bool)
    taken = -1
    clash = np.r_[False, (before[1:] <= after[:-1]) & ~new[1:]] if len(name) else new
    for k in np.flatnonzero(clash | np.r_[clash[1:], False]).tolist():  # runs of places that may share a character
        if not clash[k] or before[k] > taken:
            taken = after[k]
        else:
            keep[k] = False
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return text[starts], name[starts], np.bincount(group, weights=keep, minlength=len(starts)).astype(np.int64)


#: Signs that make a name more than its letters when it is taken as a pattern.
_SIGNS = re.compile(rb"[\\^$.|?*+()\[\]{}]")


def literal_part(name: bytes) -> bytes | None:
    """The longest part that stands in whatever the name matches as a pattern; None where that isn't plain."""
    if not _SIGNS.search(name):
        return name
    if re.search(rb"[\\^$|?*+()\[\]{}]", name):
        return None
    return max(name.split(b"."), key=len) or None


def as_pattern(name: bytes) -> re.Pattern[bytes] | None:
    """The name as a pattern between two characters other than letters and digits; None if it isn't one."""
    point = rb"(?:[^\n\r\x80-\xff]|[\xc0-\xff][\x80-\xbf]*)"
    body = re.sub(rb"\\.|\[[^\]]*\]|\.", lambda m: point if m[0] == b"." else m[0], name)
    try:
        return re.compile(rb"[^A-Za-z0-9\x80-\xbf](?:[\x80-\xbf]*)" + body + rb"[^A-Za-z0-9\x80-\xbf]")
    except re.error:
        return None
