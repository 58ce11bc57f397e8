"""Hierarchical navigable small-world graph of one shard, as flat arrays, with searches over many queries at once.

Layer 0 holds every vector, each further layer one in LAYER_RATIO of the layer below, until a layer has at most
ENTRY_ROWS vectors. A vector hangs below the nearest one of the next layer, and its candidates are the vectors that hang
below the nearest of those: all vectors of a layer are inserted at once, through the hierarchy. The links of a layer
are chosen among the best candidates by the usual diversity rule (a candidate that is closer to a link already
chosen than to the vector itself waits), filled up with the nearest of those that waited, and completed by
reverse links. Searches enter at the top layer, which is scanned, and follow the links of each layer below with a
bounded best-first list, all queries of a block stepping together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LAYER_RATIO = 64
ENTRY_ROWS = 1024
#: Places at which a search enters a layer.
SEEDS = 8
CANDIDATES = 24
LINKS = 16
REVERSE = 8
WIDTH = 4  # vectors expanded at one step of a search
#: A search follows what lies less than SLACK below the similarity wanted; its first steps are always taken.
SLACK = 0.2
FIRST_STEPS = 2
BLOCK_FLOATS = 6_000_000
#: Up to so many rows all pairs are compared; above, a row with those that hang below the HANGING * sqrt(m) nearest of the next layer's m vectors.
ALL_PAIRS = 4096
HANGING = 7
#: Vectors of the next layer whose rows give the first lists, and pairs held before lists are renewed.
BESIDE = 12
HELD_PAIRS = 500_000
#: Where a least similarity is given, a row is compared with those below VISIT_MARGIN times as many entries as any pair needs of
#: VISIT_ROWS rows' exact lists; with fewer than VISIT_PAIRS of such pairs with those below HANGING * sqrt(m), as without it.
VISIT_ROWS = 768
VISIT_MARGIN = 1.5
VISIT_PAIRS = 100


def nearest_lists(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, similarities) of the ``count`` most similar other rows of each unit row, best first; -1 where there are fewer."""
    n = len(x)
    count_ = min(count, n - 1)
    out_i, out_s = np.full((n, count), -1, np.int32), np.full((n, count), -2, np.float32)
    if count_ < 1:
        return out_i, out_s
    groups = min(n, max(8 * count_, 64))
    per = -(-n // groups)
    padded = np.zeros((groups * per, x.shape[1]), np.float32)
    padded[:n] = x
    rows = max(1, BLOCK_FLOATS // (groups * per))
    other = np.ascontiguousarray(padded.T)
    for a in range(0, n, rows):
        s = x[a : a + rows] @ other
        s[:, n:] = -3
        m = len(s)
        s[np.arange(m), np.arange(a, a + m)] = -3
        # the count-th greatest of the groups' maxima bounds the wanted values from below
        best = s.reshape(m, groups, per).max(axis=2)
        bound = np.partition(best, groups - count_, axis=1)[:, groups - count_]
        at = np.flatnonzero(s >= np.maximum(bound, -2.5)[:, None])
        r, c = np.divmod(at, groups * per)
        v = s.ravel()[at]
        order = np.lexsort((c, -v, r))
        r, c, v = r[order], c[order], v[order]
        place = np.arange(len(r)) - np.searchsorted(r, np.arange(m))[r]
        keep = place < count_
        out_i[a + r[keep], place[keep]], out_s[a + r[keep], place[keep]] = c[keep], v[keep]
    return out_i, out_s


def _padded(row: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that occur, matrices of their values): entries of equal ``row``, which is sorted, side by side; free places -3 or -1."""
    count = np.bincount(row)
    touched = np.flatnonzero(count)
    at, column = (np.cumsum(count > 0) - 1)[row], np.arange(len(row)) - (np.cumsum(count) - count)[row]
    out = []
    for v in values:
        m = np.full((len(touched), count.max()), -3 if v.dtype.kind == "f" else -1, v.dtype)
        m[at, column] = v
        out.append(m)
    return touched, out


def _keep_best(near: np.ndarray, sim: np.ndarray, row: np.ndarray, other: np.ndarray, s: np.ndarray) -> None:
    """Put (row, other, s) into the lists where they are better than what is there."""
    if not len(row):
        return
    count = near.shape[1]
    order = np.argsort(row, kind="stable")
    row, other, s = row[order], other[order], s[order]
    many = np.flatnonzero(np.bincount(row) > 3 * count)
    if len(many):  # of rows with very many entries only the best are laid side by side
        at = np.flatnonzero(np.isin(row, many))
        at = at[np.lexsort((-s[at], row[at]))]
        keep = np.ones(len(row), bool)
        keep[at[np.arange(len(at)) - np.searchsorted(row[at], row[at]) >= count]] = False
        row, other, s = row[keep], other[keep], s[keep]
    for a in range(0, len(near), 16_384):
        at = slice(*np.searchsorted(row, [a, a + 16_384]))
        if at.start == at.stop:
            continue
        touched, (i, v) = _padded(row[at] - a, other[at], s[at])
        i, v = np.concatenate([near[touched + a], i], axis=1), np.concatenate([sim[touched + a], v], axis=1)
        best = np.argpartition(-v, count - 1, axis=1)[:, :count]
        near[touched + a], sim[touched + a] = np.take_along_axis(i, best, axis=1), np.take_along_axis(v, best, axis=1)


def usual_visits(m: int) -> int:
    return min(m, max(BESIDE, int(np.ceil(HANGING * np.sqrt(m)))))


def fit_visits(x: np.ndarray, entries: np.ndarray, home: np.ndarray, least: float) -> tuple[int, int]:
    """Below how many of the entries nearest to a row the rows of similarity ``least`` to it are looked for: if either row of a pair looks, and if only one does.

    Both from exact lists of VISIT_ROWS rows; ``usual_visits`` at most.
    """
    m = len(entries)
    asked, both, one = np.unique(np.linspace(0, len(x) - 1, VISIT_ROWS).astype(np.int64)), [], []
    for a in range(0, len(asked), 32):
        q = asked[a : a + 32]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -3
        r, c = np.nonzero(s >= least)
        if len(r) > CANDIDATES * len(q):  # as long as lists are
            best = np.argpartition(-s, CANDIDATES - 1, axis=1)[:, :CANDIDATES]
            r, at = np.nonzero(np.take_along_axis(s, best, axis=1) >= least)
            c = best[r, at]
        mine, other = x[q[r]] @ entries.T, x[c] @ entries.T
        at = np.arange(len(r))
        there = (mine > mine[at, home[c]][:, None]).sum(axis=1)
        back = (other > other[at, home[q[r]]][:, None]).sum(axis=1)
        both.append(np.minimum(there, back))
        one.append(np.maximum(there, back))
    usual = usual_visits(m)
    if sum(map(len, one)) < VISIT_PAIRS:
        return usual, usual
    return tuple(int(min(usual, max(BESIDE, np.ceil(VISIT_MARGIN * (np.concatenate(n).max() + 1))))) for n in (both, one))


def hanging_lists(x: np.ndarray, count: int, entries: np.ndarray, home: np.ndarray, visited: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Like ``nearest_lists``, from the rows that hang below the nearest vectors of the layer above.

    ``entries``: the vectors of that layer; ``home``: the one of them that each row hangs below, rows sorted by it. A row is compared with
    all rows below the ``visited`` entries nearest to it, and what is found serves both rows of a pair.
    """
    n, m = len(x), len(entries)
    start = np.searchsorted(home, np.arange(m + 1))
    near, sim = np.full((n, count), -1, np.int32), np.full((n, count), -2, np.float32)
    beside = np.zeros((m, m), bool)
    order = np.argsort(-(entries @ entries.T), axis=1, kind="stable")[:, :BESIDE]
    beside[np.arange(m)[:, None], order] = True
    beside |= beside.T
    np.fill_diagonal(beside, True)
    for h in range(m):  # first lists, from the entries beside one another
        a, b = start[h], start[h + 1]
        cells = np.flatnonzero(beside[h])
        there = np.concatenate([np.arange(start[c], start[c + 1]) for c in cells])
        step = max(1, BLOCK_FLOATS // (8 * len(there) + 1))
        for a in range(start[h], start[h + 1], step):
            mine = np.arange(a, min(a + step, b))
            s = x[mine] @ x[there].T
            s[np.arange(len(mine)), np.searchsorted(there, mine)] = -3
            k = min(count, len(there))
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            near[mine, :k], sim[mine, :k] = there[best], np.take_along_axis(s, best, axis=1)
    near[sim < -2] = -1
    visits = np.empty((m, -(-n // 8)), np.uint8)
    few = usual_visits(m) if visited is None else visited
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ entries.T
        visits[:, a // 8 : -(-min(a + 1024, n) // 8)] = np.packbits((s >= np.partition(s, m - few, axis=1)[:, m - few, None]).T, axis=1)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting, kth = 0, sim.min(axis=1)
    for h in range(m):
        a, b = start[h], start[h + 1]
        if a == b:
            continue
        goes = np.unpackbits(visits[h], count=n)
        for c in np.flatnonzero(beside[h]):
            goes[start[c] : start[c + 1]] = 0
        guests = np.flatnonzero(goes)
        below = np.ascontiguousarray(x[a:b].T)
        step = max(1, BLOCK_FLOATS // (8 * (b - a)))
        for g in range(0, len(guests), step):
            i = guests[g : g + step]
            s = x[i] @ below
            at = np.flatnonzero(s > np.minimum(kth[i][:, None], kth[None, a:b]))
            r, c = np.divmod(at, b - a)
            i, j, s = i[r], a + c, s.ravel()[at]
            # two rows that go to each other's entry meet twice; the second time counts for neither
            again = (home[i] < h) & ((visits[home[i], j >> 3] >> (7 - (j & 7)).astype(np.uint8)) & 1).astype(bool)
            i, j, s = i[~again].astype(np.int32), j[~again].astype(np.int32), s[~again]
            one, two = s > kth[i], s > kth[j]
            held.append((np.concatenate([i[one], j[two]]), np.concatenate([j[one], i[two]]), np.concatenate([s[one], s[two]])))
            waiting += len(held[-1][0])
        if waiting > HELD_PAIRS or h == m - 1:
            _keep_best(near, sim, *(np.concatenate(p) for p in zip(*held))) if held else None
            held, waiting, kth = [], 0, sim.min(axis=1)
    if held:
        _keep_best(near, sim, *(np.concatenate(p) for p in zip(*held)))
    for a in range(0, n, 16_384):
        order = np.argsort(-sim[a : a + 16_384], axis=1, kind="stable")
        near[a : a + 16_384], sim[a : a + 16_384] = np.take_along_axis(near[a : a + 16_384], order, axis=1), np.take_along_axis(sim[a : a + 16_384], order, axis=1)
    return near, sim


def choose_links(x: np.ndarray, near: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """(n, LINKS + REVERSE) link array from candidate lists; -1 marks free places."""
    n, width = near.shape
    links = np.full((n, LINKS + REVERSE), -1, np.int32)
    closeness = np.full((n, LINKS), -2, np.float32)
    for a in range(0, n, 2048):
        c, s = near[a : a + 2048], sim[a : a + 2048]
        y = x[np.maximum(c, 0)]
        between = y @ y.transpose(0, 2, 1)
        kept = np.zeros(c.shape, bool)
        for j in range(width):
            kept[:, j] = (c[:, j] >= 0) & ~((between[:, :j, j] > s[:, j, None]) & kept[:, :j]).any(axis=1)
        # chosen links first, then the nearest of the others
        order = np.argsort(np.where(kept, 0, np.where(c >= 0, 1, 2)), axis=1, kind="stable")[:, :LINKS]
        links[a : a + 2048, : order.shape[1]] = np.take_along_axis(c, order, axis=1)
        closeness[a : a + 2048, : order.shape[1]] = np.take_along_axis(s, order, axis=1)
    # reverse links that the target doesn't have yet, the most similar first; a bounded piece of targets at a time
    source, target = np.repeat(np.arange(n, dtype=np.int32), LINKS), links[:, :LINKS].ravel()
    order = np.argsort(target, kind="stable")
    source, target, closeness = source[order], target[order], closeness.ravel()[order]
    for a in range(0, n, 16_384):
        at = slice(*np.searchsorted(target, [a, a + 16_384]))
        t, o, v = target[at], source[at], closeness[at]
        new = ~(links[t, :LINKS] == o[:, None]).any(axis=1)
        t, o, v = t[new], o[new], v[new]
        by = np.lexsort((o, -v, t))
        t, o = t[by], o[by]
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        keep = rank < REVERSE
        links[t[keep], LINKS + rank[keep]] = o[keep]
    return links


@dataclass
class Graph:
    """``x``: unit rows; ``links[l]``: links of layer l in its own numbering; ``below[l]``: places of layer l + 1 in layer l.

    ``starts``: where in x the rows below each vector of layer 1 begin, with the end; ``visits``: below how many of these a row of at least
    the similarity that the graph was built for is looked for (0 if for none).
    """

    x: np.ndarray
    links: list[np.ndarray]
    below: list[np.ndarray]
    starts: np.ndarray | None = None
    visits: int = 0

    def search_similar(self, queries: np.ndarray, ef: int, wanted: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Like ``search``, for a graph that was built for a least similarity, of rows that are at least as similar as ``wanted``, which isn't less than that.

        All rows below the ``visits`` nearest vectors of layer 1 are compared; from the best of those that are similar enough the links are followed.
        """
        if not self.below or not self.visits:
            return self.search(queries, ef, wanted)
        found, sim = np.full((len(queries), ef), -1, np.int32), np.full((len(queries), ef), -2, np.float32)
        above = np.ascontiguousarray(self.x[self.below[0]].T)
        m = above.shape[1]
        few = min(m, self.visits)
        for a in range(0, len(queries), block):
            q, least = queries[a : a + block], wanted[a : a + block].astype(np.float32) - np.float32(1e-5)
            s = q @ above
            goes = np.ascontiguousarray((s >= np.partition(s, m - few, axis=1)[:, m - few, None]).T)
            held, waiting, any_ = [], 0, False
            for h in range(m):
                i = np.flatnonzero(goes[h])
                if not len(i) or self.starts[h] == self.starts[h + 1]:
                    continue
                under = self.x[self.starts[h] : self.starts[h + 1]].T
                step = max(1, BLOCK_FLOATS // (8 * under.shape[1]))
                for b in range(0, len(i), step):
                    of = i[b : b + step]
                    s = q[of] @ under
                    r, c = np.nonzero(s >= least[of][:, None])
                    if len(r):
                        held.append((of[r], (c + self.starts[h]).astype(np.int32), s[r, c]))
                        waiting, any_ = waiting + len(r), True
                    if waiting > HELD_PAIRS:  # no row meets a query twice, since it hangs below one vector
                        _keep_best(found[a : a + block], sim[a : a + block], *(np.concatenate(p) for p in zip(*held)))
                        held, waiting, least = [], 0, np.maximum(least, sim[a : a + block].min(axis=1))
            if held:
                _keep_best(found[a : a + block], sim[a : a + block], *(np.concatenate(p) for p in zip(*held)))
            if not any_:
                continue
            rows = np.flatnonzero((found[a : a + block] >= 0).any(axis=1))
            order = np.argsort(-sim[a + rows], axis=1, kind="stable")
            first = np.take_along_axis(found[a + rows], order[:, :SEEDS], axis=1)
            for b in range(0, len(rows), 256):
                of = rows[b : b + 256]
                i, s = _follow(self.x, None, self.links[0], q[of], first[b : b + 256], ef, wanted[a + of])
                # what was compared before and what the links led to, each row once
                both, value = np.concatenate([found[a + of], i], axis=1), np.concatenate([sim[a + of], s], axis=1)
                by = np.argsort(both, axis=1, kind="stable")
                both, value = np.take_along_axis(both, by, axis=1), np.take_along_axis(value, by, axis=1)
                value[:, 1:][(both[:, 1:] == both[:, :-1]) | (both[:, 1:] < 0)] = -2
                by = np.argsort(-value, axis=1, kind="stable")[:, :ef]
                sim[a + of] = np.take_along_axis(value, by, axis=1)
                found[a + of] = np.where(sim[a + of] > -2, np.take_along_axis(both, by, axis=1), -1)
        return found, sim

    def search(self, queries: np.ndarray, ef: int, wanted: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(indices, similarities), best first, of about the ``ef`` most similar rows of each unit query; -1 fills up.

        ``wanted``: similarity below which a query's results are of no use; it stops when what it could follow next
        lies more than SLACK below. Queries that enter at the same place are searched together.
        """
        layers = [np.arange(len(self.x), dtype=np.int64)]
        for places in self.below:
            layers.append(layers[-1][places])
        found, sim = np.full((len(queries), ef), -1, np.int32), np.full((len(queries), ef), -2, np.float32)
        if not len(queries):
            return found, sim
        entries = self.x[layers[-1]].T
        if not self.below:  # a single layer, which is scanned
            for a in range(0, len(queries), block):
                s = queries[a : a + block] @ entries
                order = np.argsort(-s, axis=1, kind="stable")[:, :ef]
                found[a : a + block, : order.shape[1]], sim[a : a + block, : order.shape[1]] = order, np.take_along_axis(s, order, axis=1)
            return found, sim
        seeds = min(SEEDS, entries.shape[1])
        at = np.empty((len(queries), seeds), np.int64)
        for a in range(0, len(queries), block):
            s = queries[a : a + block] @ entries
            near = np.argpartition(-s, seeds - 1, axis=1)[:, :seeds]
            at[a : a + block] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)
        together = np.argsort(at[:, 0], kind="stable")
        bound = np.full(len(queries), -2.0) if wanted is None else wanted
        for a in range(0, len(queries), block):
            rows = together[a : a + block]
            start = at[rows]
            for layer in range(len(self.below) - 1, -1, -1):
                start = self.below[layer][start]
                i, v = _follow(self.x, layers[layer] if layer else None, self.links[layer], queries[rows], start, ef if layer == 0 else SEEDS, bound[rows])
                start = np.where(i[:, :SEEDS] >= 0, i[:, :SEEDS], i[:, :1])
            found[rows], sim[rows] = i, v
        return found, sim


_ONE = 1 << 29
_DONE = 1 << 31
_FREE = (2 * _ONE + 2) << 32 | _DONE


def _follow(x: np.ndarray, rows: np.ndarray | None, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search in one layer from the places ``start`` (queries, seeds), all queries together.

    A pool entry is one integer: distance in the upper 32 bits, then a bit that says its links were followed, then the
    place in the layer. So one plain sort of integers keeps the pools in order.
    """
    m, n = len(q), len(links)
    seen = np.zeros(m * n, bool)
    pool = np.full((m, ef), _FREE, np.int64)
    limit = (_ONE - np.floor(np.clip(wanted - SLACK, -1, 1) * _ONE).astype(np.int64)) << 32 | (_DONE - 1)
    kind = np.int32 if m * n < 2**31 else np.int64
    step = 0
    owner, place = np.repeat(np.arange(m, dtype=kind), start.shape[1]), start.ravel()
    while len(owner):
        pair = (owner * kind(n) + place.astype(kind))[place >= 0]
        pair = pair[~seen[pair]]
        if not len(pair):
            break
        pair.sort()
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
        seen[pair] = True
        owner = pair // kind(n)
        place = pair - owner * kind(n)
        sim = np.einsum("ij,ij->i", x[place if rows is None else rows[place]], q[owner])
        code = (_ONE - np.rint(sim.astype(np.float64) * _ONE).astype(np.int64)) << 32 | place
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        touched, count = owner[first], np.diff(np.append(first, len(owner)))
        more = np.full((len(touched), count.max()), _FREE, np.int64)
        more[np.repeat(np.arange(len(touched)), count), np.arange(len(owner)) - np.repeat(first, count)] = code
        merged = np.concatenate([pool[touched], more], axis=1)
        merged.sort(axis=1)
        merged = merged[:, :ef]
        open_ = (merged & _DONE) == 0
        pick = open_ & (np.cumsum(open_, axis=1) <= WIDTH)
        step += 1
        if step > FIRST_STEPS:
            pick &= merged <= limit[touched][:, None]
        r, c = np.nonzero(pick)
        chosen = merged[r, c] & (_DONE - 1)
        merged[r, c] |= _DONE
        pool[touched] = merged
        out = links[chosen]
        owner, place = np.repeat(touched[r], out.shape[1]), out.ravel()
    free = pool == _FREE
    return np.where(free, -1, pool & (_DONE - 1)).astype(np.int32), np.where(free, -2.0, (_ONE - (pool >> 32)) / _ONE).astype(np.float32)


def candidate_lists(x: np.ndarray, count: int, entries: np.ndarray, home: np.ndarray, visited: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    return nearest_lists(x, count) if len(x) <= ALL_PAIRS else hanging_lists(x, count, entries, home, visited)


def build(x: np.ndarray, seed: int = 7, least: float | None = None) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph of the unit rows ``x``, candidate lists of its lowest layer and their similarities, order of the rows in it).

    Rows that hang below the same vector of the next layer lie side by side, and so do such vectors near each other.
    With ``least`` the lists of the lowest layer are sure to hold only rows of at least this similarity (see ``fit_visits``); less similar
    ones in them are good enough for links.
    """
    rng = np.random.default_rng(seed)
    layers = [np.arange(len(x))]  # places in x, lowest layer first
    while len(layers[-1]) > 64 and (len(layers) == 1 or len(layers[-1]) > ENTRY_ROWS):
        layers.append(np.sort(rng.choice(layers[-1], -(-len(layers[-1]) // LAYER_RATIO), replace=False)))
    homes: list[np.ndarray] = []
    pivots = x[layers[-1][:: max(1, len(layers[-1]) // 32)]]
    layers[-1] = layers[-1][np.argsort((x[layers[-1]] @ pivots.T).argmax(axis=1), kind="stable")]
    for level in range(len(layers) - 2, -1, -1):  # from the top down, so that a layer follows the order of the one above
        rows, above = layers[level], np.ascontiguousarray(x[layers[level + 1]].T)
        home = np.concatenate([(x[rows[a : a + 4096]] @ above).argmax(axis=1) for a in range(0, len(rows), 4096)])
        order = np.argsort(home, kind="stable")
        layers[level] = rows[order]
        homes.insert(0, home[order])
    links, below, near, sim = [], [], None, None
    visited, visits, starts = None, 0, None
    vectors = [x[rows] for rows in layers]
    total = len(x)
    del x
    if least is not None and homes:
        visited, visits = fit_visits(vectors[0], vectors[1], homes[0], least)
        starts = np.searchsorted(homes[0], np.arange(len(vectors[1]) + 1))
    for level in range(max(1, len(layers) - 1)):
        own = vectors[level]
        above = min(level + 1, len(layers) - 1)
        i, s = candidate_lists(own, CANDIDATES, vectors[above], homes[level] if homes else np.zeros(len(own), np.int64), None if level else visited)
        links.append(choose_links(own, i, s))
        if level == 0:
            near, sim = i, s
        if level + 1 < len(layers):
            place = np.empty(total, np.int64)
            place[layers[level]] = np.arange(len(layers[level]))
            below.append(place[layers[above]])
    return Graph(vectors[0], links, below, starts, visits), near, sim, layers[0]
