"""A minimal acyclic transducer: a set of byte strings as a shared graph that gives each one its place in their order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Transducer:
    """States in a double array. An arc of state s under byte b is at place base[s] + b, where ``check`` names s.

    ``target`` is the state it leads to and ``out`` how many strings come before all that go through it; the
    outs along a string's path add up to its ordinal. State 0 is the root.
    """

    base: np.ndarray
    final: np.ndarray
    check: np.ndarray
    target: np.ndarray
    out: np.ndarray

    FIELDS = ("base", "final", "check", "target", "out")

    def packed(self) -> list[bytes]:
        return [getattr(self, f).tobytes() for f in self.FIELDS]

    @classmethod
    def unpacked(cls, parts: Iterable[bytes]) -> Transducer:
        return cls(*(np.frombuffer(p, np.bool_ if f == "final" else np.int32) for f, p in zip(cls.FIELDS, parts, strict=True)))

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinals of the strings data[start:end], -1 for strings not in the set. All take their next byte at once; those that fall off are dropped."""
        found = np.full(len(starts), -1, np.int64)
        who, at, end = np.arange(len(starts)), starts, ends
        state, total = np.zeros(len(who), np.int32), np.zeros(len(who), np.int64)
        while len(who):
            over = at == end
            if over.any():
                hit = over & self.final[state]
                found[who[hit]] = total[hit]
                who, at, end, state, total = (v[~over] for v in (who, at, end, state, total))
            place = self.base[state] + data[at]
            live = self.check[place] == state
            if not live.all():
                who, at, end, place, total = (v[live] for v in (who, at, end, place, total))
            state, total, at = self.target[place], total + self.out[place], at + 1
        return found


def build(strings: Iterable[bytes]) -> Transducer:
    """The minimal transducer of strictly ascending strings.

    A string shares the path of the one before as far as both agree; what is below that point is complete, so its
    states are looked up among those that have the same arcs and end, and kept once.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    sizes: list[int] = []

    def settled(final: bool, arcs: list) -> int:
        key = (final, *arcs)
        state = known.get(key)
        if state is None:
            state = known[key] = len(states)
            states.append((final, tuple(arcs)))
            sizes.append(final + sum(sizes[t] for _, t in arcs))
        return state

    path: list[list] = [[False, []]]
    last = None
    for s in strings:
        if last is not None:
            if s <= last:
                raise ValueError("strings must ascend")
            same = 0
            while same < len(last) and last[same] == s[same]:
                same += 1
            for d in range(len(last), same, -1):
                done = settled(*path.pop())
                path[-1][1].append((last[d - 1], done))
        path.extend([False, []] for _ in range(len(s) + 1 - len(path)))
        path[-1][0] = True
        last = s
    while len(path) > 1:
        done = settled(*path.pop())
        path[-1][1].append((last[len(path) - 1], done))
    root = settled(*path[0])
    return _laid_out(states, sizes, root)


def _laid_out(states: list[tuple[bool, tuple]], sizes: list[int], root: int) -> Transducer:
    """The double array: states with many arcs take their places first, single arcs fill the gaps."""
    renamed = list(range(len(states)))
    renamed[root], renamed[0] = 0, root  # states other than these two keep their numbers
    used = bytearray(512)
    base = np.zeros(len(states), np.int32)
    placed: list[tuple[int, int, int, int]] = []
    free, wide = 256, 256
    for i in sorted(range(len(states)), key=lambda i: -len(states[i][1])):
        arcs = states[i][1]
        if not arcs:
            break
        lead = arcs[0][0]
        others = [b - lead for b, _ in arcs[1:]]
        p, tried = (wide if others else free), 0
        while True:
            p = used.find(0, p)
            if p < 0:
                p = len(used)
            if p + 512 > len(used):
                used.extend(bytes(len(used) + 512))
            if not any(used[p + d] for d in others):
                break
            p, tried = p + 1, tried + 1
        if tried > 64:
            wide = p  # what lies before is too dense for states with several arcs
        if not others:
            free = p
        base[renamed[i]] = p - lead
        before = int(states[i][0])
        for b, t in arcs:
            at = p - lead + b
            used[at] = 1
            placed.append((at, renamed[i], renamed[t], before))
            before += sizes[t]
    size = 256 + int(base.max(initial=0)) + 1
    check, target, out = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    if placed:
        at, owner, to, before = np.array(placed, np.int64).T
        check[at], target[at], out[at] = owner, to, before
    final = np.zeros(len(states), np.bool_)
    final[renamed] = [f for f, _ in states]
    return Transducer(base, final, check, target, out)
