"""Similarity of two texts by their common blocks, as difflib measures it, without its inner loop over pairs of places.

The longest common block of two texts is found on all pairs of equal places at once: as the bits of one number, or, where
that number would be too long, by ranks of blocks of double length. Both give the block that difflib gives: the longest,
of these the first in one text, of these the first in the other.

Very many pairs are compared together: their long blocks come from equal runs of a few letters, which are sorted once for
all texts, their short ones from rows of 64 bits, and a step is a few operations on arrays for all open parts of all pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np

#: Up to so many pairs of places are bits of one number.
BITS = 1 << 22
#: Letters of a run by which long blocks are found.
RUN = 5
#: What is held at once: pairs of equal runs, those of them that are extended together, rows of bits, and words of the table
#: of places. Beyond the first and the last, texts are compared in smaller groups.
HITS, EXTENDED, ROWS, TABLE = 1 << 22, 1 << 17, 1 << 16, 1 << 24
#: Texts of fewer letters than these bits hold are compared together: a length and two places in a text share a number.
PLACE = 21
#: The share of what is open that is expected of a pair, when the first pair of a row is chosen.
EXPECTED = 0.3


def places(b: str) -> dict[str, int]:
    """For each character, the places where it stands, as bits."""
    out: dict[str, int] = {}
    for j, c in enumerate(b):
        out[c] = out.get(c, 0) | 1 << j
    return out


def _by_bits(a: str, at: dict[str, int], lo: int, hi: int) -> tuple[int, int, int]:
    """A row of bits for each character of `a`, with a blank one at its end; a block is a diagonal."""
    width = (hi - lo) // 8 + 1
    inside = (1 << (hi - lo)) - 1
    rows = {c: ((at.get(c, 0) >> lo) & inside).to_bytes(width, "little") for c in set(a)}
    runs = [int.from_bytes(b"".join([rows[c] for c in a]), "little")]
    if not runs[0]:
        return 0, 0, 0
    step = 8 * width + 1
    while longer := runs[-1] & (runs[-1] >> (step << (len(runs) - 1))):
        runs.append(longer)
    found, n = runs[-1], 1 << (len(runs) - 1)
    for k in range(len(runs) - 2, -1, -1):
        if longer := found & (runs[k] >> (step * n)):
            found, n = longer, n + (1 << k)
    i, j = divmod((found & -found).bit_length() - 1, 8 * width)
    return i, j, n


def _by_ranks(a: str, b: str) -> tuple[int, int, int]:
    """Blocks of a length have a rank if they stand in both texts; a longer block is two of them."""
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("int64") + 1
    n = len(a)

    def ranked(key: np.ndarray) -> np.ndarray | None:
        both = np.intersect1d(key[:n], key[n + 1 :])
        both = both[both > 0]
        if not len(both):
            return None
        at = np.minimum(np.searchsorted(both, key), len(both) - 1)
        return np.where(both[at] == key, at + 1, 0)

    def joined(x: np.ndarray, length: int, y: np.ndarray) -> np.ndarray | None:
        key = np.zeros_like(x)
        if length >= len(x):
            return None
        left, right = x[:-length], y[length:]
        key[:-length] = np.where((left > 0) & (right > 0), left * (len(x) + 1) + right, 0)
        return ranked(key)

    first = ranked(np.concatenate([codes(a), [0], codes(b)]))
    if first is None:
        return 0, 0, 0
    runs = [first]
    while (longer := joined(runs[-1], 1 << (len(runs) - 1), runs[-1])) is not None:
        runs.append(longer)
    found, length = runs[-1], 1 << (len(runs) - 1)
    for k in range(len(runs) - 2, -1, -1):
        if (longer := joined(found, length, runs[k])) is not None:
            found, length = longer, length + (1 << k)
    i = int(np.flatnonzero(found[:n])[0])
    return i, int(np.flatnonzero(found[n + 1 :] == found[i])[0]), length


def longest_block(a: str, b: str, at: dict[str, int], lo: int = 0, hi: int | None = None) -> tuple[int, int, int]:
    """Start in `a`, start in b[lo:hi] and length of their longest common block; `at` has the places of b."""
    hi = len(b) if hi is None else hi
    return _by_bits(a, at, lo, hi) if len(a) * (hi - lo) <= BITS else _by_ranks(a, b[lo:hi])


def ratio_over(a: str, b: str, least: float = -1.0, at: dict[str, int] | None = None) -> float | None:
    """The ratio of two texts (the share of characters in common blocks, longest first; the order of the texts matters) if it
    is more than `least`. What is still open counts in full until it is looked at, so texts that can't reach `least` are
    left after a few blocks."""
    whole = len(a) + len(b)
    if not whole:
        return 1.0 if least < 1.0 else None
    at = places(b) if at is None else at
    done, bound = 0, min(len(a), len(b))
    queue = [(-bound, 0, len(a), 0, len(b))] if bound else []
    while queue and 2.0 * bound / whole > least:
        most, i0, i1, j0, j1 = heappop(queue)
        bound += most
        i, j, n = longest_block(a[i0:i1], b, at, j0, j1)
        if n:
            i, j, done, bound = i0 + i, j0 + j, done + n, bound + n
            for part in ((i0, i, j0, j), (i + n, i1, j + n, j1)):
                if open_ := min(part[1] - part[0], part[3] - part[2]):
                    heappush(queue, (-open_, *part))
                    bound += open_
    found = 2.0 * done / whole
    return found if not queue and found > least else None


def letters_bound(a: Counter, b: Counter, whole: int) -> float:
    """What the ratio of two texts is at most, by their letters."""
    return 2.0 * (a & b).total() / max(whole, 1)


def best_of(rows: list[str], proofs: list[str]) -> list[float]:
    """For each row its best ratio with a proof. Those that length and letters allow most come first and set a bar; what
    can't pass it is not looked at."""
    letters = [(p, len(p), Counter(p)) for p in proofs]
    at: dict[str, dict[str, int]] = {}
    out = []
    for row in rows:
        n, own, best = len(row), Counter(row), 0.0
        by_length = sorted(((2.0 * min(n, m) / max(n + m, 1), p, m, c) for p, m, c in letters), key=lambda x: -x[0])
        for bound, p, m, c in by_length:
            if bound <= best:
                break
            if letters_bound(own, c, n + m) > best:
                if p not in at:
                    at[p] = places(p)
                best = max(best, ratio_over(row, p, best, at[p]) or 0.0)
        out.append(best)
    return out


def best_ratios(groups: list[tuple[list[str], list[str]]]) -> list[list[float]]:
    """For the rows and proofs of each group, the best ratio of each row with a proof: as best_of, for all groups together."""
    if max((len(t) for g in groups for x in g for t in x), default=0) < 1 << PLACE:
        pairs = _Pairs(groups)
        if pairs.fits:
            best = pairs.best().tolist()
            ends = np.cumsum([len(rows) for rows, _ in groups]).tolist()
            return [best[end - len(rows) : end] for end, (rows, _) in zip(ends, groups, strict=True)]
        if len(groups) > 1:
            half = len(groups) // 2
            return best_ratios(groups[:half]) + best_ratios(groups[half:])
        rows, proofs = groups[0]
        if len(rows) > 1:
            half = len(rows) // 2
            return [best_ratios([(rows[:half], proofs)])[0] + best_ratios([(rows[half:], proofs)])[0]]
        if len(proofs) > 1:
            half = len(proofs) // 2
            return [[max(x) for x in zip(*(best_ratios([(rows, part)])[0] for part in (proofs[:half], proofs[half:])), strict=True)]]
    return [best_of(rows, proofs) for rows, proofs in groups]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For so many places each: whose a place is, and its number there."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)


def _chunks(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose counts are `most` together, or one place."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


#: Open parts of pairs: pair, start and end in the row, start and end in the proof. Blocks in them: part, start in the row,
#: start in the proof, length; in the order of parts.
_Parts = list[np.ndarray]
_Blocks = list[np.ndarray]


class _Pairs:
    """Each row of a group with each proof of it. All texts stand one after the other in `codes`, with a mark between them;
    places are places there."""

    def __init__(self, groups: list[tuple[list[str], list[str]]]) -> None:
        rows, proofs = [t for r, _ in groups for t in r], [t for _, p in groups for t in p]
        n_rows, n_proofs = (np.array([len(g[side]) for g in groups], dtype=np.int64) for side in (0, 1))
        self.n, self.texts = len(rows), rows + proofs
        self.length = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.start = np.cumsum(self.length + 1) - self.length
        points = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), "<u4")
        seen = np.zeros(int(points.max(initial=0)) + 1, np.int32)
        seen[points] = 1
        rank = np.cumsum(seen, dtype=np.int32) + 1
        letters = int(rank[-1]) + 1
        text, place = _spread(self.length)
        where = self.start[text] + place
        # 0 ends a row and 1 a proof, so no block reaches over an end
        self.codes = np.zeros(len(points) + len(self.texts) + 1, np.uint8 if letters < 256 else np.int32)
        self.codes[where] = rank[points]
        self.codes[(self.start + self.length)[self.n :]] = 1
        # for each letter, bits at its places
        self.words = (len(self.codes) >> 6) + 2
        self.fits = letters * self.words <= TABLE
        if not self.fits:
            return
        self.places = np.zeros(letters * self.words, np.uint64)
        self.line = self.codes.astype(np.int64) * self.words
        np.add.at(self.places, self.line[where] + (where >> 6), np.uint64(1) << (where & 63).astype(np.uint64))

        group = np.repeat(np.arange(len(groups)), n_rows)
        self.per_row = n_proofs[group]
        self.first = np.cumsum(self.per_row) - self.per_row
        self.row, k = _spread(self.per_row)
        self.proof = (self.n + np.cumsum(n_proofs) - n_proofs)[group][self.row] + k
        self.whole = np.maximum(self.length[self.row] + self.length[self.proof], 1)
        self.done = np.zeros(len(self.row), np.int64)
        self.bar = np.zeros(self.n)

        # runs of letters, with the number of their group before them
        bits = letters.bit_length()
        self.run = max(1, min(RUN, (62 - len(groups).bit_length()) // bits))
        key = np.zeros(len(self.codes), np.int64)
        for k in range(self.run):
            key[: len(key) - k] = key[: len(key) - k] << bits | self.codes[k:]
        of, place = _spread(np.maximum(self.length - self.run + 1, 0))
        at = self.start[of] + place
        own = np.concatenate([group, np.repeat(np.arange(len(groups)), n_proofs)])[of] << bits * self.run | key[at]
        key[: self.start[self.n] if proofs else len(key)] = -1
        key[key != -1] = -2
        key[at] = own
        cut = int(np.searchsorted(of, self.n))
        order = cut + np.argsort(key[at[cut:]])
        self.key, self.at, self.of, self.sorted = key, at, of, order
        there = key[at[order]]
        begin = _firsts(there)
        self.hits = np.zeros(cut, np.int64)
        self.begin = np.zeros(cut, np.int64)
        if len(begin):
            # in order, so that what is looked up lies side by side
            asked = key.take(at[:cut])
            mine = np.argsort(asked)
            asked, kinds = asked.take(mine), there.take(begin)
            found = np.minimum(np.searchsorted(kinds, asked), len(begin) - 1)
            self.hits[mine] = np.diff(np.append(begin, len(there))).take(found) * (kinds.take(found) == asked)
            self.begin[mine] = begin.take(found)
        # rows that repeat a few letters over and over are compared on their own
        of_row = np.bincount(of[:cut], self.hits, self.n)
        cells = self.length[: self.n] * np.bincount(self.row, self.length[self.proof], self.n)
        self.alone = (of_row > 1 << 14) & (of_row > cells / 16)
        self.hits[self.alone[of[:cut]]] = 0
        self.fits = int(self.hits.sum()) <= HITS

    def _long(self) -> _Blocks:
        """The blocks of `run` letters or more that can't be extended."""
        codes, key, out = self.codes, self.key, [[np.zeros(0, np.int64)] * 4]
        asked = np.flatnonzero(self.hits)
        for a, b in _chunks(self.hits[asked], EXTENDED):
            x, k = _spread(self.hits[asked[a:b]])
            x = asked[a:b].take(x)
            other = self.sorted.take(self.begin.take(x) + k)
            i, j = self.at.take(x), self.at.take(other)
            mark = codes.take(i - 1)
            first = np.flatnonzero((mark != codes.take(j - 1)) | (mark < 2))
            x, other, i, j = x.take(first), other.take(first), i.take(first), j.take(first)
            n = np.full(len(i), self.run)
            live = np.arange(len(i))
            while len(live):
                live = live.compress(key.take(i.take(live) + n.take(live)) == key.take(j.take(live) + n.take(live)))
                n[live] += self.run
            live = np.arange(len(i))
            for _ in range(self.run - 1):
                live = live.compress(codes.take(i.take(live) + n.take(live)) == codes.take(j.take(live) + n.take(live)))
                n[live] += 1
            row = self.of.take(x)
            first = self.first.take(row)
            out.append([first + self.of.take(other) - self.proof.take(first), i, j, n])
        blocks = [np.concatenate(x) for x in zip(*out, strict=True)]
        order = np.argsort(blocks[0])
        return [x.take(order) for x in blocks]

    def _short(self, parts: _Parts) -> np.ndarray:
        """The longest blocks of parts that have none of `run` letters, as numbers: see _level. Each letter of one text has a
        row of bits, the places of it in a window of the other; windows overlap so far that each block is in one. The text
        that has the rows is the one with which they are fewer."""
        _, i0, i1, j0, j1 = parts
        m, n, step = i1 - i0, j1 - j0, 65 - self.run
        windows = lambda size: np.maximum(1, -(-(size - self.run + 1) // step))
        turned = (n * windows(m) < m * windows(n)).astype(np.int64)
        swapped = lambda x, y: (x + turned * (y - x), y + turned * (x - y))
        (row0, col0), (rows, cols) = swapped(i0, j0), swapped(m, n)
        part, k = _spread(windows(cols))
        left = col0[part] + k * step
        inside = ~np.uint64(0) >> (64 - np.minimum(cols[part] - k * step, 64)).astype(np.uint64)
        high = rows[part] + 1  # a blank row at the end
        out = np.zeros(len(i0), np.int64)
        for a, b in _chunks(high, ROWS):
            own, tall = part[a:b], high[a:b]
            ends = np.cumsum(tall)
            begins = ends - tall
            row, col = np.arange(ends[-1]) + np.repeat(row0.take(own) - begins, tall), np.repeat(left[a:b], tall)
            word, shift = self.line.take(row) + (col >> 6), (col & 63).astype(np.uint64)
            eq = (self.places.take(word) >> shift) | ((self.places.take(word + 1) << np.uint64(1)) << (np.uint64(63) - shift))
            eq &= np.repeat(inside[a:b], tall)
            eq[ends - 1] = 0
            of = np.repeat(own - own[0], tall)
            longest, levels = np.zeros(own[-1] + 1 - own[0], np.int8), []
            # most parts have two letters, so single ones are looked at last
            run = eq.copy()
            run[:-1] &= eq[1:] >> np.uint64(1)
            at = np.flatnonzero(run != 0)
            run, x, size = run.take(at), of.take(at), 2
            while len(at):
                longest[x] = size
                levels.append((size, at, run, x))
                run = run & (eq.take(at + size, mode="clip") >> np.uint64(size))
                more = np.flatnonzero(run != 0)
                at, run, x, size = at.take(more), run.take(more), x.take(more), size + 1
            single = np.flatnonzero(longest.take(own - own[0]) == 0)
            window, k = _spread(tall.take(single))
            at = begins.take(single.take(window)) + k
            at = at.compress(eq.take(at) != 0)
            x = of.take(at)
            longest[x] = 1
            levels.append((1, at, eq.take(at), x))
            for size, at, run, x in levels:
                last = np.flatnonzero(longest.take(x) == size)
                at, run, x = at.take(last), run.take(last), x.take(last) + own[0]
                # the lowest bit, by the exponent of its value
                low = ((run & (~run + np.uint64(1))).astype(np.float64).view(np.int64) >> 52) - 1023 + col.take(at)
                line, turn = row.take(at), turned.take(x)
                i, j = line + turn * (low - line), low + turn * (line - low)
                if len(begin := _firsts(x)):
                    best = np.maximum.reduceat((size << 2 * PLACE) + (i1.take(x) - i << PLACE) + j1.take(x) - j, begin)
                    x = x.take(begin)
                    out[x] = np.maximum(out.take(x), best)
        return out

    def _level(self, parts: _Parts, blocks: _Blocks) -> tuple[_Parts, _Blocks]:
        """Take the longest block of each part; what is open then, and the blocks in that. A block is a number: its length,
        how far its start is from the end of the part in the row, and the same in the proof; so the largest is difflib's."""
        pair, i0, i1, j0, j1 = parts
        part, i, j, n = blocks
        top = np.zeros(len(pair), np.int64)
        if len(begin := _firsts(part)):
            top[part.take(begin)] = np.maximum.reduceat((n << 2 * PLACE) + (i1.take(part) - i << PLACE) + j1.take(part) - j, begin)
        rest = np.flatnonzero(top == 0)
        top[rest] = self._short([x.take(rest) for x in parts])
        size, bi, bj = top >> 2 * PLACE, i1 - (top >> PLACE & (1 << PLACE) - 1), j1 - (top & (1 << PLACE) - 1)
        self.done += np.bincount(pair, size, len(self.done)).astype(np.int64)
        ei, ej = bi + size, bj + size
        before, after = (size > 0) & (bi > i0) & (bj > j0), (size > 0) & (ei < i1) & (ej < j1)
        x, y = np.flatnonzero(before), np.flatnonzero(after)
        open_ = [np.concatenate([s.take(x), t.take(y)]) for s, t in ((pair, pair), (i0, ei), (bi, i1), (j0, ej), (bj, j1))]
        # blocks of `run` letters or more within what is open; shorter ones are found by bits
        number, then = np.cumsum(before) - 1, np.cumsum(after) - 1 + len(x)
        short = np.minimum(n, np.minimum(bi.take(part) - i, bj.take(part) - j))
        x = np.flatnonzero(short >= self.run)
        off = np.maximum(0, np.maximum(ei.take(part) - i, ej.take(part) - j))
        y = np.flatnonzero(n - off >= self.run)
        return open_, [np.concatenate([s.take(x), t.take(y)]) for s, t in ((number.take(part), then.take(part)), (i, i + off), (j, j + off), (short, n - off))]

    def _bounds(self, parts: _Parts) -> np.ndarray:
        """How many letters of each pair are in blocks, if what is open counts in full."""
        return self.done + np.bincount(parts[0], np.minimum(parts[2] - parts[1], parts[4] - parts[3]), len(self.done)).astype(np.int64)

    def best(self) -> np.ndarray:
        """The best ratio of each row. All pairs lose their longest block; then a row's likeliest pair is finished and sets a
        bar, and the others go on as long as they may pass it."""

        def kept(parts: _Parts, blocks: _Blocks, ok: np.ndarray) -> tuple[_Parts, _Blocks]:
            number, left, inside = np.cumsum(ok) - 1, np.flatnonzero(ok), np.flatnonzero(ok.take(blocks[0]))
            return [x.take(left) for x in parts], [number.take(blocks[0].take(inside)), *[x.take(inside) for x in blocks[1:]]]

        def raise_bar() -> None:
            some = np.flatnonzero(self.per_row)
            self.bar[some] = np.maximum(self.bar[some], np.maximum.reduceat(2.0 * self.done / self.whole, self.first[some]))

        if len(self.row):
            ends = self.start + self.length
            pairs = np.flatnonzero(~self.alone[self.row] & (self.length[self.row] > 0) & (self.length[self.proof] > 0))
            number = np.zeros(len(self.row), np.int64)
            number[pairs] = np.arange(len(pairs))
            pair, *blocks = self._long()
            state = self._level([pairs, self.start[self.row[pairs]], ends[self.row[pairs]], self.start[self.proof[pairs]], ends[self.proof[pairs]]], [number[pair], *blocks])
            raise_bar()
            likely = 2.0 * (self.done + EXPECTED * (self._bounds(state[0]) - self.done)) / self.whole
            order = np.lexsort((-likely, self.row))
            chosen = np.zeros(len(self.row), bool)
            chosen[order[_firsts(self.row[order])]] = True
            for ok in (chosen, ~chosen):
                now = kept(*state, ok[state[0][0]])
                while len(now[0][0]):
                    passes = 2.0 * self._bounds(now[0]) / self.whole > self.bar[self.row]
                    now = self._level(*kept(*now, passes.take(now[0][0])))
                    raise_bar()
        for k in np.flatnonzero(self.alone):
            pairs = slice(self.first[k], self.first[k] + self.per_row[k])
            self.bar[k] = best_of([self.texts[k]], [self.texts[p] for p in self.proof[pairs]])[0]
        return self.bar
