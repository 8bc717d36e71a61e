"""Partial and token-set ratios (0 to 100) by their published definitions, on top of the InDel similarity.

The similarity of a string with all windows of another takes one pass: cells of the comparison matrix are combed into a braid, whose strands
tell the longest common subsequence with every window at once (semi-local comparison).  Cells of a diagonal don't depend on each other, so
arrays comb a diagonal in one step, for many strings beside each other.  Where only whole strings are compared, a bit stands for a cell, and
arrays take a letter of many pairs in one step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel: one big integer stands for a row."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    # carries beyond the string's bits never come back, so they are cut off once, at the end
    for own in map(places.get, b):
        if own is not None:
            hit = row & own
            row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common / total length."""
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def lcs_lengths(pairs: list[tuple[str, str]]) -> list[int]:
    """`lcs_length` of many pairs: 63 letters of the shorter string to a number, whose highest bit takes the carry; pairs of like sizes beside each other."""
    out = [0] * len(pairs)
    told = sorted(((-(-len(a) // BITS), len(b), a, b, k) for k, (a, b) in enumerate((*sorted(p, key=len), ) for p in pairs) if a), key=lambda x: x[:2])
    first, own = 0, 0
    for last, (words, steps, *_) in enumerate(told):
        own += words * steps
        if last + 1 == len(told) or (last + 2 - first) * told[last + 1][0] > BESIDE or (last + 2 - first) * told[last + 1][0] * told[last + 1][1] > 1.2 * (own + told[last + 1][0] * told[last + 1][1]) + FEW * told[last + 1][0] * told[last + 1][1]:
            for (*_, k), n in zip(told[first : last + 1], _lcs_lengths([x[2:4] for x in told[first : last + 1]], words)):
                out[k] = int(n)
            first, own = last + 1, 0
    return out


def _lcs_lengths(pairs: list[tuple[str, str]], words: int) -> np.ndarray:
    n, sizes, steps = len(pairs), np.array([len(a) for a, _ in pairs]), max(len(b) for _, b in pairs)
    letters, number = np.unique(codes("".join(a for a, _ in pairs)), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # by number, letter and pair: where the letter stands in the shorter string; the last letter stands nowhere
    where = np.zeros((words, len(letters) + 1, n), np.uint64)
    np.bitwise_or.at(where, (place // BITS, number, owner), np.uint64(1) << (place % BITS).astype(np.uint64))
    taken = np.full((n, steps), len(letters), np.int64)
    for k, (_, b) in enumerate(pairs):
        own = codes(b)
        at = np.minimum(np.searchsorted(letters, own), len(letters) - 1)
        taken[k, : len(b)] = np.where(letters[at] == own, at, len(letters))
    taken = np.ascontiguousarray(taken.T) * n + np.arange(n)
    full, high = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    row = np.full((words, n), full)
    hit, total = np.empty(n, np.uint64), np.empty(n, np.uint64)
    flat = where.reshape(words, -1)
    for at in taken:
        for w in range(words):
            own = row[w]
            flat[w].take(at, out=hit, mode="clip")
            np.bitwise_and(hit, own, out=hit)
            if w:
                np.right_shift(total, high, out=total)
                np.add(total, own, out=total)
                np.add(total, hit, out=total)
            else:
                np.add(own, hit, out=total)
            np.bitwise_xor(own, hit, out=own)
            np.bitwise_and(total, full, out=hit)
            np.bitwise_or(own, hit, out=own)
    # letters beyond a string's end only ever hold carries
    held = np.clip(sizes[None, :] - BITS * np.arange(words)[:, None], 0, BITS).astype(np.uint64)
    return sizes - np.bitwise_count(row & ((np.uint64(1) << held) - np.uint64(1))).sum(axis=0, dtype=np.int64)


def _strands(pairs: list[tuple[np.ndarray, np.ndarray]], above: list[np.ndarray] | None = None) -> np.ndarray:
    """`comb` as a row for each pair, filled up beyond the other's end.  above: strands of what stands before each string, which are combed on.

    Shorter strings are filled up with codes that no text has: such rows and columns leave what is common as it is.  The pairs lie beside
    each other in memory, so a diagonal of all of them is one run of numbers, of two bytes where codes and places fit.
    """
    most, width, n = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs), len(pairs)
    shift = max((-int(x.min()) for x in above), default=0) if above else 0
    small = most + shift + width < 0xFFFE and max(x.max(initial=0) for p in pairs for x in p) < 0xFFFE
    kind, none = (np.uint16, 0xFFFE) if small else (np.uint32, 0x110000)
    turned, across = np.full((n, most), none, kind), np.full((n, width), none + 1, kind)
    for k, (a, b) in enumerate(pairs):
        turned[k, most - len(a) :] = a[::-1]
        across[k, : len(b)] = b
    turned, across = np.ascontiguousarray(turned.T), np.ascontiguousarray(across.T)
    flat = np.repeat(np.arange(most, dtype=kind)[:, None], n, axis=1)
    down = np.repeat(np.arange(most + shift, most + shift + width, dtype=kind)[:, None], n, axis=1)
    for k, x in enumerate(above or ()):
        down[: len(x), k] = x + (most + shift)
    lesser, both, ones = (np.ones((min(most, width), n), kind) for _ in range(3))
    for d in range(most + width - 1):
        top, low = max(0, d - width + 1), min(most - 1, d)
        h, v, m = flat[most - 1 - low : most - top], down[d - low : d - top + 1], low - top + 1
        lo, sum_, one = lesser[:m], both[:m], ones[:m]
        # unlike letters sort their two strands, equal ones let them bounce off each other: h is lifted over v, so that v is the lesser
        np.bitwise_xor(turned[most - 1 - low : most - top], across[d - low : d - top + 1], out=lo)
        np.minimum(lo, one, out=lo)
        np.subtract(lo, one, out=lo)
        np.bitwise_or(lo, h, out=lo)
        np.add(v, h, out=sum_)
        np.minimum(lo, v, out=h)
        np.subtract(sum_, h, out=v)
    return np.ascontiguousarray(down.T).astype(np.int64) - (most + shift)


def comb(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each pair (string, other) of codes: from which place of the other the strand comes that ends at a place (negative: from none)."""
    return [own[: len(b)] for own, (_, b) in zip(_strands(pairs), pairs)]


def best_of_places(start: np.ndarray, size: int, places: list[tuple[int, int]], above: float = 0.0) -> float:
    """The best ratio of a string of a size with the windows of some stretches of another, at most as long and possibly cut at a stretch's end;
    start: the other's strands, along all of it.  Stretches shorter than the string have none."""
    n = len(start)
    places = [x for x in places if x[1] - x[0] >= size]
    if not places or n < size:
        return above
    # a whole window from i to i + size lacks the strands that begin and end in it, in whatever stretch it lies
    ends = np.arange(n)
    first, last = np.maximum(ends - size + 1, 0), np.minimum(start, n - size)
    held = first <= last
    change = np.bincount(first[held], minlength=n + 2) - np.bincount(last[held] + 1, minlength=n + 2)
    lacks = np.cumsum(change)[: n - size + 1]
    best = max(above, max(200.0 * (size - lacks[s : e - size + 1].min()) / (2 * size) for s, e in places))
    # a cut window of c letters scores 2c / (size + c) at most
    least = min(size, max(1, int(best * size / (200.0 - best)))) if best < 200.0 else size
    if least >= size:
        return float(best)
    cut, along = np.arange(least, size), np.arange(size - 1)
    s, e = (np.array(x)[:, None] for x in zip(*places))
    head = np.cumsum(start[s + along] >= s, axis=1)[:, least - 1 :]
    back = np.minimum(e - start[e - size + 1 + along], size) + (size + 1) * np.arange(len(places))[:, None]
    tail = np.cumsum(np.bincount(back.ravel(), minlength=(size + 1) * len(places)).reshape(len(places), -1)[:, :size], axis=1)[:, least:]
    return float(max(best, (200.0 * (cut - np.minimum(head, tail)) / (size + cut)).max()))


def _best_windows(start: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray:
    """`best_window` of many: a row of strands for each other, of which `length` count."""
    n, width = start.shape
    ends, row, size_, length_ = np.arange(width), np.arange(n)[:, None] * (width + 2), size[:, None], length[:, None]
    inside = ends < length_
    first, last = np.maximum(ends - size_ + 1, 0), np.minimum(start, length_ - size_)
    held = inside & (first <= last)
    change = np.bincount((row + first)[held], minlength=n * (width + 2)) - np.bincount((row + last + 1)[held], minlength=n * (width + 2))
    lacks = np.where(ends <= length_ - size_, np.cumsum(change.reshape(n, -1), axis=1)[:, :width], width)
    whole = 200.0 * (size - lacks.min(axis=1)) / (2 * size)
    cut = ends + 1
    head = np.cumsum(start >= 0, axis=1)
    back = np.where(inside & (start >= 0), length_ - start, 0)
    tail = np.cumsum(np.bincount((row + back)[back > 0], minlength=n * (width + 2)).reshape(n, -1), axis=1)[:, 1 : width + 1]
    cuts = np.where(cut < size_, 200.0 * (cut - np.minimum(head, tail)) / (size_ + cut), 0.0)
    return np.maximum(whole, cuts.max(axis=1))


def best_window(start: np.ndarray, size: int) -> float:
    """The best ratio of a string of a size with the windows of another, at most as long and possibly cut at an end; start: the other's strands."""
    return best_of_places(start, size, [(0, len(start))])


def partial_ratio(a: str, b: str, above: float = 0.0) -> float:
    """The best ratio of the shorter string with a window of the longer one (windows may be cut at either end); `above` if none is better."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else above
    if short in long:
        return 100.0
    return max(above, best_window(comb([(codes(short), codes(long))])[0], len(short)))


def token_set_ratio(a: str, b: str, above: float = 0.0) -> float:
    """The best ratio among the common words, and the common words with either side's own ones; `above` if none is better."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return above
    common, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not left or not right):
        return 100.0
    c, cl, cr = " ".join(common), " ".join(common + left), " ".join(common + right)
    best = above
    if common:  # the common words begin both, so what is alike is their length
        best = max(best, 200.0 * len(c) / (len(c) + min(len(cl), len(cr))))
    # no more can be common than the shorter one has
    if 200.0 * min(len(cl), len(cr)) / (len(cl) + len(cr)) > best:
        best = max(best, ratio(cl, cr))
    return best


# --- lines and pages --------------------------------------------------------------------------------------------------------------

#: Letters beside each other in a step of combing, letters to a number, and numbers beside each other in a step of `lcs_lengths`.
CELLS, BITS, BESIDE, FEW = 1 << 16, 63, 1 << 14, 2_000
GRAM = 3
SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


def grams(text: str) -> set[str]:
    """The different runs of three characters inside the words of a text."""
    return {w[k : k + GRAM] for w in set(text.split(" ")) for k in range(len(w) - GRAM + 1)}


def upper_bound(n: int, m: int, here: int, there: int) -> float:
    """No larger can the ratios of a line of n and a candidate of m characters be if each lacks so many of the other's runs: an edit spoils three runs on one side and two on the other at most."""
    part = (here if n <= m else there) / GRAM
    whole = max(here / GRAM, there / GRAM, (here + there) / (2 * GRAM - 1))
    return 100.0 * max(1 - part / (2 * min(n, m)), 1 - whole / (n + m)) + 1e-9


def joined(read: list[str], most: int) -> tuple[str, list[tuple[int, int]]]:
    """A page's lines joined by blanks, and the places of each line and each run of up to `most` lines, without blanks at their ends."""
    page, at, n = " ".join(read), [], 0
    for x in read:
        at.append((n, n + len(x)))
        n += len(x) + 1
    places: dict[tuple[int, int], None] = {}
    for k, (s, _) in enumerate(at):
        for _, e in at[k : k + most]:
            text = page[s:e]
            places[s + len(text) - len(text.lstrip(" ")), e - len(text) + len(text.rstrip(" "))] = None
    return page, [(s, e) for s, e in places if e > s]


class Line:
    """A line, the page's text, the candidates' places (start, end; at word ends) in it, and the best ratio so far."""

    def __init__(self, line: str, page: str, places: list[tuple[int, int]]):
        self.line, self.page, self.best = line, page, 0.0
        self.places = [(s, e) for s, e in places if line and e > s]
        #: Candidates with what their sets of words can reach: (bound, first word, last word, length of the common ones, of both sets)
        self.sets: list[tuple[float, int, int, int, int]] = []
        if any(x in line or line in x for x in (page[s:e] for s, e in self.places)):
            self.best, self.places = 100.0, []
        if self.places:
            self._count_words()

    def _count_words(self) -> None:
        """Lengths of the sets of words, with a blank for each; the ratio of the common words with either side follows from them alone."""
        self.words, self.own = self.page.split(), set(self.line.split())
        before = self._before()
        space = SPACES[np.minimum(codes(self.page), len(SPACES) - 1)]
        begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        s, e = np.array(self.places).T
        first, end = np.searchsorted(begins, s), np.searchsorted(begins, e)
        some = end > first
        if not self.own or not some.any():
            return
        first, end = first[some], end[some]
        size = np.array([len(w) + 1 for w in self.words])
        shared = np.array([w in self.own for w in self.words])
        starts = np.cumsum(end - first) - (end - first)
        at = np.arange(starts[-1] + end[-1] - first[-1]) - np.repeat(starts - first, end - first)
        fresh = size[at] * (before[at] < np.repeat(first, end - first))
        there, both = np.add.reduceat(fresh, starts), np.add.reduceat(fresh * shared[at], starts)
        here = sum(map(len, self.own)) + len(self.own)
        least, total = np.minimum(here, there) - 1, here + there - 2
        if ((both > 0) & (both == least + 1)).any():
            self.best = 100.0
            return
        # the common words begin both sets, so what is alike with either is their length
        alone = np.where(both > 0, 200.0 * (both - 1) / np.maximum(both - 1 + least, 1), 0.0)
        self.best = max(self.best, float(alone.max()))
        self.sets = list(zip((200.0 * least / total).tolist(), first.tolist(), end.tolist(), both.tolist(), total.tolist()))

    def _before(self) -> np.ndarray:
        """Where each word of the page stands before (-1: nowhere)."""
        last: dict[str, int] = {}
        out = []
        for k, w in enumerate(self.words):
            out.append(last.get(w, -1))
            last[w] = k
        return np.array(out, np.int64)

    def unlike_words(self) -> list[tuple[str, str, int, int]]:
        """Of candidates whose sets of words may beat the best ratio: the words of one side only, what is alike besides, and both lengths."""
        out = []
        for bound, first, end, both, total in self.sets:
            if bound > self.best:
                there = set(self.words[first:end])
                out.append((" ".join(sorted(self.own - there)), " ".join(sorted(there - self.own)), both, total))
        return out


def _beside(work: list[tuple]) -> Iterator[list[tuple]]:
    """Parts of like sizes of (string, other, ...), to be combed together: little of a part is filling, and a diagonal of it stays in the processor's memory."""
    work = sorted(work, key=lambda w: (int(6 * math.log2(len(w[1]))), len(w[0])))
    held: list[tuple] = []
    most = width = cells = 0
    for w in work:
        a, b, here = max(most, len(w[0])), max(width, len(w[1])), len(w[0]) * len(w[1])
        if held and ((len(held) + 1) * min(a, b) > CELLS or (len(held) + 1) * a * b > 1.1 * (cells + here) + 6_000 * (a + b)):
            yield held
            held, cells, a, b = [], 0, len(w[0]), len(w[1])
        held.append(w)
        most, width, cells = a, b, cells + here
    if held:
        yield held


def _combed(lines: list[Line]) -> None:
    """Works out partial ratios: the candidates at least as long as their line in one pass over their part of the page; of shorter ones those
    that begin at one place together, each combed on from the one before."""
    wide, narrow = [], []
    for own in lines:
        line, page = codes(own.line), codes(own.page)
        long = [(s, e) for s, e in own.places if e - s >= len(line)]
        if long:
            low, high = min(s for s, _ in long), max(e for _, e in long)
            wide.append((line, page[low:high], own, [(s - low, e - low) for s, e in long]))
        ends: dict[int, list[int]] = {}
        for s, e in sorted(own.places):
            if e - s < len(line):
                ends.setdefault(s, []).append(e)
        narrow += [(page[s : e[0]], line, own, page, s, e, np.arange(len(line)), 0) for s, e in ends.items()]
    for part in _beside(wide):
        for start, (line, other, own, places) in zip(_strands([x[:2] for x in part]), part):
            own.best = best_of_places(start[: len(other)], len(line), places, own.best)
    while narrow:
        further = []
        for part in _beside(narrow):
            strands = _strands([x[:2] for x in part], [x[6] for x in part] if part[0][7] else None)
            sizes, lengths = np.array([x[5][x[7]] - x[4] for x in part]), np.array([len(x[1]) for x in part])
            for start, best, (_, line, own, page, s, e, _, k) in zip(strands, _best_windows(strands, sizes, lengths).tolist(), part):
                own.best = max(own.best, best)
                if k + 1 < len(e):
                    further.append((page[e[k] : e[k + 1]], line, own, page, s, e, start[: len(line)].copy(), k + 1))
        narrow = further


def best_ratios(lines: list[Line]) -> list[float]:
    """The best ratio of each line with any of its candidates: partial ratios first, then those of the sets of words that may still beat them."""
    _combed([own for own in lines if own.best < 100.0])
    asked = [(own, x) for own in lines for x in own.unlike_words()]
    for (own, (_, _, both, total)), alike in zip(asked, lcs_lengths([x[:2] for _, x in asked])):
        own.best = max(own.best, 200.0 * (both + alike) / total)
    return [own.best for own in lines]


def best_ratio(line: str, candidates: list[str]) -> float:
    page, places = "", []
    for c in candidates:
        places.append((len(page), len(page) + len(c)))
        page += c + " "
    return best_ratios([Line(line, page, places)])[0]
