"""Two-stage suffix sorting of many short texts at once, with whole-array operations only.

Stage one sorts directly only suffixes that are smaller than their successors (the leftmost of each such run, as
in the improved two-stage method): their stretches up to the next one are named in order and the sequence of names
is ranked by doubling. Stage two induces all others by two scans over the buckets of first symbols: an ascending
scan yields every suffix larger than its successor, a descending one the remaining smaller ones. A scan handles a
bucket's entries as arrays, in waves, so Python work is per bucket and not per suffix.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 257


def join_texts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each ended by a 0 (bytes count as 1 to 256); starts and ends of the texts in it."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    out = np.zeros(int((lengths + 1).sum()), dtype=np.uint16)
    for s, x in zip(starts, texts, strict=True):
        out[s : s + len(x)] = x
        out[s : s + len(x)] += 1
    return out, starts, starts + lengths


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than its successor. Ends of texts count as smaller than all else."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    at = np.append(change, n - 1)
    rises = np.append(t[change] < t[change + 1], True)
    out = np.repeat(rises, np.diff(np.concatenate(([-1], at))))
    out[t == 0] = True
    return out


def _name(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names, in order, of the stretches from each position of ``lms`` to the next one; ends of texts get names of their own."""
    n, m, per = len(t), len(lms), 6
    code = np.zeros(n + per, dtype=np.uint64)
    code[:n] = t.astype(np.uint64) * np.uint64(2) + small
    length = np.append(np.diff(lms), 1) + 1
    length[t[lms] == 0] = 1
    length = np.minimum(length, n - lms)
    rank = np.zeros(m, dtype=np.int64)
    todo, depth = np.arange(m), 0
    while len(todo):
        key = np.zeros(len(todo), dtype=np.uint64)
        for j in range(per):
            inside = length[todo] > depth + j
            key = (key << np.uint64(10)) | np.where(inside, code[np.minimum(lms[todo] + depth + j, n)], np.uint64(0))
        order = np.lexsort((key, rank[todo])) if depth else np.argsort(key, kind="stable")
        o = todo[order]
        k, r = key[order], rank[o]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        group = np.repeat(first, np.diff(np.append(first, len(o))))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        rank[o] = r + (begin - group)
        depth += per
        alone = new & np.append(new[1:], True)
        ended = length[o] <= depth
        # a group whose members have all ended is settled; lengths are equal inside it, since 0 marks an end in the key
        todo = np.sort(o[~alone & ~ended])
    ends = np.flatnonzero(t[lms] == 0)
    rank += len(ends)
    rank[ends] = np.arange(len(ends))
    return rank


def _rank(names: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of ``names`` by doubling; only ties are sorted again."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(m, dtype=np.int64)

    def settle(o: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        rank[o] = base + np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        return o[~(new & np.append(new[1:], True))]

    v = names[order]
    todo = settle(order, np.concatenate(([True], v[1:] != v[:-1])), np.int64(0))
    h = 1
    while len(todo):
        after = todo + h
        second = np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        first = rank[todo]
        o = np.argsort(first.astype(np.uint64) * np.uint64(m + 2) + second.astype(np.uint64))
        f, s, todo = first[o], second[o], todo[o]
        start = np.concatenate(([True], f[1:] != f[:-1]))
        new = start | np.concatenate(([True], s[1:] != s[:-1]))
        begin = np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))
        place = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        rank[todo] = f + (place - begin)
        todo = todo[~(new & np.append(new[1:], True))]
        h *= 2
    return rank


def _spread(positions: np.ndarray, t: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Append positions to the lists of their symbols, in order."""
    if not len(positions):
        return
    symbols = t[positions]
    order = np.argsort(symbols, kind="stable")
    symbols, positions = symbols[order], positions[order]
    cuts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(symbols)), strict=True):
        lists[symbols[a]].append(positions[a:b])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """All suffixes of ``t`` (symbols with 0 at every text's end, the last included) that start inside a text, in order; equal suffixes in any order."""
    small = smaller_than_next(t)
    lms = np.flatnonzero(small & np.concatenate(([True], ~small[:-1])) | (t == 0))
    order = np.argsort(_rank(_name(t, small, lms)))
    none = np.empty(0, dtype=np.int64)
    gather = lambda lists: np.concatenate(lists) if lists else none
    seeds: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    _spread(lms[order], t, seeds)
    large: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]

    def before(x: np.ndarray, of_small: bool) -> np.ndarray:
        p = x[x > 0] - 1
        return p[small[p] == of_small]

    present = np.flatnonzero(np.bincount(t, minlength=SYMBOLS))
    done_large: dict[int, np.ndarray] = {}
    for c in present:
        waves, cur = [], gather(large[c])
        while len(cur):
            waves.append(cur)
            p = before(cur, False)
            same = t[p] == c
            _spread(p[~same], t, large)
            cur = p[same]
        done_large[c] = gather(waves)
        _spread(before(gather(seeds[c]), False), t, large)
    rest: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    out = []
    for c in present[::-1]:
        waves, cur = [], gather(rest[c])
        while len(cur):
            waves.append(cur)
            p = before(cur, True)
            same = t[p] == c
            _spread(p[~same], t, rest)
            cur = p[same]
        _spread(before(done_large[c][::-1], True), t, rest)
        if c:
            out += [*waves, done_large[c][::-1]]
    return gather(out)[::-1]


def equal_prefix_runs(t: np.ndarray, sa: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order, each with at least ``length`` symbols in its text: whether each shares its first ``length`` with the one before.

    ``hashes`` are those of the first ``length`` symbols; equal ones are compared symbol by symbol.
    """
    if not len(sa):
        return np.zeros(0, dtype=bool)
    same = np.zeros(len(sa), dtype=bool)
    at = np.flatnonzero(hashes[sa[1:]] == hashes[sa[:-1]]) + 1
    raw = np.ascontiguousarray(t).view(np.uint8)
    words = np.lib.stride_tricks.as_strided(np.frombuffer(raw.tobytes() + b"\0" * 8, dtype=np.uint8), shape=(len(t), 8), strides=(2, 1))
    for s in range(0, len(at), 200_000):
        x = at[s : s + 200_000]
        a, b = sa[x], sa[x - 1]
        ok = np.ones(len(x), dtype=bool)
        for d in [*range(0, length - 3, 4), length - 4]:
            ok &= (words[a + d].view(np.uint64) == words[b + d].view(np.uint64))[:, 0]
        same[x] = ok
    return same
