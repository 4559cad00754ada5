"""Sampled segmentations of texts over a piece vocabulary: Gumbel top-k without replacement.

The segmentations of a text are the paths of a lattice whose edges are vocabulary pieces; a path's
probability is proportional to the product of its pieces' probabilities.  Perturbing every path's log-probability
with independent Gumbel noise and taking the k largest is sampling k distinct segmentations without replacement.
The paths are far too many, so the noise is drawn from the top down: a node of the search is a set of paths that
share a prefix, its value the largest perturbed value among them.  The root's value is one Gumbel draw; the
best path below a node follows the exact posterior (backward sums of the lattice) and inherits the value; the
paths that leave it at each step form sibling nodes with Gumbel values truncated at their parent's.  An A*
search pops nodes by value, which is an exact bound, so the first k leaves are the sample.

Where no piece crosses from other text into a blank, the lattice factors into units of blanks and the text after
them; backward sums are made once for each distinct rest of a unit that a task meets, which begins anew when those kept grow
beyond a bound.  A vocabulary with other pieces is sampled over whole texts.  Characters that no piece covers fall back to byte pieces.  Scores of a merge-ranked (BPE) vocabulary are read as a Zipf law over its ranks.

Randomness is a hash of (seed, row key, sample, unit, step): a row's samples don't depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import U64, give_back, mix, powers, ragged, small_batches, span_hashes, stream, text_chunks

SAMPLES = 2
SEED = 20260101
_BYTE = stream(11, 256)
_STEP = stream(404, 8) | U64(1)
_PROBE = 20
_CHUNK = 1 << 18
#: edges beyond which the rests met so far are let go before the next chunk, and bytes of new units that are built at once
_KNOWN, _BUILD = 1 << 19, 1 << 17
#: bits of the places in a new table of rests, of which half may be taken
_TABLE = 17
#: log-probability of a prefix after which a path's siblings are drawn as one (and dealt out if ever that one is
#: popped), and steps looked at first
_FAR, _AHEAD = -80.0, 256


class Vocabulary:
    """Pieces as byte strings (blank for the word mark), log-probabilities, and byte pieces."""

    def __init__(self, pieces: dict[int, bytes], logp: dict[int, float], byte_ids: list[int]):
        ids = np.array(sorted(pieces), np.int64)
        text = [pieces[i] for i in ids.tolist()]
        data = np.frombuffer(b"".join(text), np.uint8)
        lens = np.array([len(t) for t in text])
        ends = np.cumsum(lens)
        keys = span_hashes(_BYTE[data], ends - lens, ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)
        self.logp = np.array([logp[i] for i in ids.tolist()])[order]
        self.lengths = np.unique(lens)
        # keys are sorted, so those with the same leading bits follow each other: where they begin, -1 for none
        head = (self.keys >> U64(64 - _PROBE)).astype(np.int64)
        self.table = np.full(1 << _PROBE, -1, np.int32)
        self.table[head[::-1]] = np.arange(len(head), dtype=np.int32)[::-1]
        self.longest = int(np.bincount(head).max())
        self.byte_ids = np.array(byte_ids, np.int32)
        self.fallback = float(self.logp.min()) - 5
        #: whether a piece goes on into a blank or a line, so that texts can't be cut there
        self.crossing = any(b" " in t.lstrip(b" ") or (b"\n" in t and len(t) > 1) for t in text)
        size = int(max(ids.max(initial=0), self.byte_ids.max(initial=0))) + 1
        full = dict(pieces) | ({int(b): bytes([i]) for i, b in enumerate(byte_ids)} if len(set(byte_ids)) == 256 else {})
        self.piece_len = np.array([len(full.get(i, b"")) for i in range(size)])
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_data = np.frombuffer(b"".join(full.get(i, b"") for i in range(size)), np.uint8)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a SentencePiece model file (read on the driver; a few hundred kB).

        In a model without byte pieces the unknown piece stands for each byte that no piece covers; such texts don't
        decode to themselves.  The ranks of a merge-ranked (BPE) vocabulary are read as a Zipf law, as it has no probabilities.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = {}, [model.unk_id()] * 256
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[i] = piece.replace("▁", " ").encode()
        ranked = sorted(pieces, key=lambda i: -model.get_score(i))
        zipf = -np.log(np.arange(len(ranked)) + 10.0)
        zipf -= np.log(np.exp(zipf).sum())
        return cls(pieces, dict(zip(ranked, zipf.tolist(), strict=True)), byte_ids)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and where those pieces are."""
        begin = self.table[(keys >> U64(64 - _PROBE)).astype(np.int64)]
        on = np.flatnonzero(begin >= 0)
        where, key = begin[on], keys[on]
        ok = self.keys[where] == key
        for step in range(1, self.longest):  # pieces that share their leading bits are few
            late = np.flatnonzero(~ok)
            further = np.minimum(where[late] + step, len(self.keys) - 1)
            found = self.keys[further] == key[late]
            where[late[found]] = further[found]
            ok[late[found]] = True
        return on[ok], where[ok]

    def decode(self, ids: list[int]) -> str:
        """The text of a piece sequence, without the blank put before it."""
        return b"".join(self.piece_data[self.piece_at[i] : self.piece_at[i] + self.piece_len[i]].tobytes() for i in ids).decode()[1:]


class Lattice:
    """The pieces that can follow at each place of the texts met so far, place by place.

    What can follow depends on nothing but the rest of the unit, so there is one node for each distinct rest, whatever units
    end in it, and it is not built again for later texts.  Node 0 is a unit's end.  ``begin`` has the first edge of each node,
    ``left`` the bytes of its rest and ``lead`` the next four of them.  All are let go before a chunk when there are more than ``_KNOWN`` edges.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self._room: dict[str, np.ndarray] = {}
        self._keys, self._nodes = np.zeros(1 << _TABLE, U64), np.full(1 << _TABLE, -1, np.int32)
        self._put("begin", 0, np.zeros(2, np.int64))
        self._put("left", 0, np.zeros(1, np.int32))
        self._put("lead", 0, np.zeros((1, 4), np.uint8))
        self._put("beta", 0, np.zeros(1))
        for name, kind in (("target", np.int32), ("id", np.int32), ("log_share", float), ("log_rest", float), ("upto", float)):
            self._put(name, 0, np.zeros(0, kind))

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Let the array ``name`` go on with ``values`` from ``at`` on."""
        room, size = self._room.get(name), at + len(values)
        if room is None or len(room) < size:
            more = np.empty((size + size // 4, *values.shape[1:]), values.dtype)
            if room is not None:
                more[:at] = room[:at]
            self._room[name] = room = more
        room[at:size] = values
        setattr(self, name, room[:size])

    def units(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The node at which each unit that ``starts``/``ends`` mark in ``text`` begins."""
        if len(self.id) > _KNOWN:
            self._clear()
        keys = span_hashes(_BYTE[text], starts, ends)
        found = self._known(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, at = np.unique(keys[new], return_index=True)
            a, b = starts[new[at]], ends[new[at]]
            upto = np.cumsum(b - a)
            cuts = np.flatnonzero(np.diff(upto // _BUILD, prepend=0)).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(a)], strict=True):
                if i < j:
                    self._build(text, a[i:j], b[i:j])
            found[new] = self._known(keys[new])
        return found

    def _known(self, keys: np.ndarray) -> np.ndarray:
        """The nodes of the rests with these hashes, -1 for those not built."""
        at = self._home(keys)
        node = self._nodes[at]
        off = np.flatnonzero((node >= 0) & (self._keys[at] != keys))
        while len(off):
            at[off] = (at[off] + 1) & (len(self._nodes) - 1)
            node[off] = self._nodes[at[off]]
            off = off[(node[off] >= 0) & (self._keys[at[off]] != keys[off])]
        return node.astype(np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(65 - len(self._nodes).bit_length())).astype(np.int64)

    def _enter(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        """Put distinct new hashes into the table."""
        total = len(self.left) + len(keys)
        if 2 * total > len(self._nodes):
            taken = np.flatnonzero(self._nodes >= 0)
            keys, nodes = np.concatenate([self._keys[taken], keys]), np.concatenate([self._nodes[taken], nodes])
            size = 1 << (2 * total).bit_length()
            self._keys, self._nodes = np.zeros(size, U64), np.full(size, -1, np.int32)
        at = self._home(keys)
        todo = np.arange(len(keys))
        while len(todo):
            open_ = todo[self._nodes[at[todo]] < 0]
            self._nodes[at[open_]] = nodes[open_]  # of several one stays
            todo = todo[self._nodes[at[todo]] != nodes[todo]]
            at[todo] = (at[todo] + 1) & (len(self._nodes) - 1)
        self._keys[at] = keys

    def _build(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        vocabulary = self.vocabulary
        lens = ends - starts
        # a unit of n bytes has n + 1 slots, the last one its end
        first = np.cumsum(lens + 1) - (lens + 1)
        unit = np.repeat(np.arange(len(lens)), lens)
        within = np.arange(len(unit)) - np.repeat(np.cumsum(lens) - lens, lens)
        text = data[starts[unit] + within]
        total = np.zeros(len(text) + 1, U64)
        np.cumsum(_BYTE[text] * powers("up", len(text) + 1)[: len(text)], out=total[1:])
        down = powers("down", len(text) + 1)

        def hashes(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:  # span_hashes over one running sum
            return mix((total[at + n] - total[at]) * down[at] + (n.astype(U64) if isinstance(n, np.ndarray) else U64(n)))

        heads = np.flatnonzero((text & 0xC0) != 0x80)
        left = lens[unit[heads]] - within[heads]
        keys = hashes(heads, left)
        node = self._known(keys)
        new = np.flatnonzero(node < 0)
        if not len(new):
            return
        _, at, rest = np.unique(keys[new], return_index=True, return_inverse=True)
        size = left[new[at]]
        order = np.argsort(size.astype(np.uint16) if lens.max() < 1 << 16 else size, kind="stable")
        base, edges = len(self.left), len(self.id)
        rank = np.empty(len(order), np.int64)
        rank[order] = base + np.arange(len(order))
        node[new] = rank[rest]
        at_slot = np.zeros(len(text) + len(lens), np.int64)
        slot = first[unit] + within
        at_slot[slot[heads]] = node
        new = new[at[order]]
        self._enter(keys[new], node[new])

        # the new nodes' places in the text, shortest rest first, so that edges lead to nodes further up
        left, heads = left[new], heads[new]
        head = text[heads]
        width = np.where(head < 0x80, 1, np.where(head < 0xE0, 2, np.where(head < 0xF0, 3, 4)))
        single = np.zeros(len(new), bool)
        froms, tos, ids, scores = [], [], [], []
        for n in vocabulary.lengths.tolist():
            a = int(np.searchsorted(left, n))
            if a == len(left):
                break
            maybe, where = vocabulary.find(hashes(heads[a:], n))
            hit = maybe + a
            single[hit[width[hit] == n]] = True
            froms.append(hit)
            tos.append(at_slot[slot[heads[hit]] + n])
            ids.append(vocabulary.ids[where])
            scores.append(vocabulary.logp[where])
        bare = np.flatnonzero(~single)
        froms.append(bare)
        tos.append(at_slot[slot[heads[bare]] + width[bare]])
        ids.append(np.full(len(bare), -1, np.int32))
        scores.append(vocabulary.fallback * width[bare])
        fan = np.zeros(len(new), np.int64)
        for a in froms:  # no node twice: it has one edge of each length at most
            fan[a] += 1
        begin = np.concatenate([[0], np.cumsum(fan)])
        place = begin[:-1].copy()
        source, target = np.repeat(np.arange(len(new)), fan), np.empty(int(begin[-1]), np.int64)
        piece, score = np.empty(len(target), np.int32), np.empty(len(target))
        while froms:  # what has been placed is let go
            a, b, i, v = (x.pop() for x in (froms, tos, ids, scores))
            e = place[a]
            target[e], piece[e], score[e] = b, i, v
            place[a] += 1

        self._put("beta", base, np.full(len(new), -np.inf))
        beta = self.beta
        levels = np.flatnonzero(np.diff(left, prepend=-1)).tolist()
        for a, b in zip(levels, [*levels[1:], len(left)], strict=True):
            e, end = begin[a], begin[b]
            v = score[e:end] + beta[target[e:end]]
            group = begin[a:b] - e
            top = np.maximum.reduceat(v, group)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                beta[base + a : base + b] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, fan[a:b])), group))
        with np.errstate(invalid="ignore"):
            score += beta[target]
            score -= np.repeat(beta[base:], fan)
        score[np.isnan(score)] = -np.inf

        upto = np.exp(score)
        many = np.flatnonzero(fan > 1)
        nth = 1
        while len(many):  # summed within a node, so that it doesn't depend on what else is built
            e = begin[many] + nth
            upto[e] += upto[e - 1]
            nth += 1
            many = many[fan[many] > nth]
        upto[begin[1:] - 1] = np.inf

        alone = fan[source] == 1
        with np.errstate(divide="ignore"):
            other = np.log(np.maximum(-np.expm1(score), 0.0))
        other[alone] = -np.inf
        sure = np.flatnonzero(~alone & (score > -1e-9))
        if len(sure):  # next to certain: sum the others themselves
            n = fan[source[sure]]
            group = np.cumsum(n) - n
            others = score[np.repeat(begin[source[sure]] - group, n) + np.arange(int(n.sum()))]
            others[group + sure - begin[source[sure]]] = -np.inf
            other[sure] = np.logaddexp.reduceat(others, group)

        lead = text[np.minimum(heads[:, None] + np.arange(4), len(text) - 1)]
        for name, at, values in (("begin", base, begin + edges), ("left", base, left), ("lead", base, lead), ("target", edges, target),
                                 ("id", edges, piece), ("log_share", edges, score), ("log_rest", edges, other), ("upto", edges, upto)):
            self._put(name, at, values)

    def source(self, edges: np.ndarray | int) -> np.ndarray:
        """The node that each edge leaves."""
        return np.searchsorted(self.begin, edges, "right") - 1

    def pick(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge out of each node that the uniform number falls on."""
        edge = self.begin[nodes]
        on = np.flatnonzero(u > self.upto[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] > self.upto[edge[on]]]
        return edge


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) by key and step."""
    return ((mix(key + np.multiply(U64(step + 1), _STEP[0:1])) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _walk(lattice: Lattice, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follow the posterior from each node to its unit's end: the edges in order, and how many each walk has."""
    live, at = np.flatnonzero(nodes), nodes.copy()
    walked: list[tuple[np.ndarray, np.ndarray]] = []
    counts = np.zeros(len(nodes), np.int64)
    step = 0
    while len(live):
        edge = lattice.pick(at[live], _uniform(keys[live], step))
        walked.append((live, edge))
        counts[live] += 1
        to = lattice.target[edge]
        at[live] = to
        live = live[to != 0]
        step += 1
    offsets = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    for n, (who, edge) in enumerate(walked):
        out[offsets[who] + n] = edge
    return out, counts


def _below(bound: float, loc: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gumbel values with the given locations, truncated at ``bound``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        free = loc - np.log(-np.log(noise))
        out = -np.logaddexp(-bound, -free)
    return np.where(np.isneginf(loc), -np.inf, out)


def _below_one(bound: float, loc: float, noise: float) -> float:
    """``_below`` for a single finite bound."""
    if loc == -math.inf:
        return loc
    a, b = -bound, math.log(-math.log(noise)) - loc
    return -max(a, b) - math.log1p(math.exp(-abs(a - b)))


class _Path:
    """One sampled segmentation of a document: its edges, the unit of each, and the values of the siblings.

    The siblings far down, after a prefix of hardly any probability, are held as one: ``far`` is the largest value among
    them, drawn like any other from ``noise``.  Where that value is popped, ``deal`` gives it to one of them and the rest their values below it.
    """

    def __init__(self, edges: np.ndarray, units: np.ndarray, value: float, lattice: Lattice, key: np.uint64, fresh: int, noise: float):
        self.edges, self.units, self.value, self.lattice, self.key = edges, units, value, lattice, key
        share = lattice.log_share[edges]
        self.logp = float(share.sum())
        n = min(_AHEAD, len(edges))
        while True:  # as far as the prefix keeps any probability to speak of
            upto = np.cumsum(share[:n]) - share[:n]
            if n == len(edges) or upto[-1] < _FAR:
                break
            n = min(2 * n, len(edges))
        n = min(max(int(np.searchsorted(-upto, -_FAR)), min(fresh, n), 1), len(edges))
        self.upto = upto[:n]
        self.siblings = np.full(n, -np.inf)
        self.used: dict[int, list[int]] = {}
        self.far, self.fresh = -np.inf, max(fresh, n)
        if fresh < n:
            self.siblings[fresh:] = _below(value, self._places(fresh, n, self.upto), self._noise(fresh, n))
        if self.fresh < len(edges):
            at = float(share[: self.fresh].sum())
            part = -math.expm1(min(self.logp - at, 0.0))
            self.far = _below_one(value, at + math.log(part) if part > 0 else -math.inf, noise)

    def _noise(self, a: int, b: int) -> np.ndarray:
        return _uniform(self.key + np.arange(a, b, dtype=U64) * _STEP[1], 0)

    def _places(self, a: int, b: int, upto: np.ndarray) -> np.ndarray:
        """Log-probability of the paths that leave at each of the steps ``a`` to ``b``."""
        return upto[a:b] + self.lattice.log_rest[self.edges[a:b]]

    def deal(self) -> None:
        """Replace the common value of the siblings far down by their own."""
        n, value, fresh = len(self.edges), self.far, self.fresh
        share = self.lattice.log_share[self.edges]
        self.upto = np.cumsum(share) - share
        loc = self._places(fresh, n, self.upto)
        weight = np.cumsum(np.exp(loc - loc.max()))
        draw = _uniform(self.key + np.multiply(U64(n), _STEP[1:2]), 4)[0]
        own = min(int(np.searchsorted(weight, draw * weight[-1])), n - fresh - 1)
        self.siblings = np.concatenate([self.siblings, np.full(fresh - len(self.siblings), -np.inf), _below(value, loc, self._noise(fresh, n))])
        self.siblings[fresh + own] = value
        self.far = -np.inf


def sample_chunk(vocabulary: Vocabulary, data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, k: int, lattice: Lattice | None = None) -> list[list[tuple]]:
    """For each text its ``k`` samples (ids, logp, value, inclusion) in falling order of value; fewer if there are fewer.

    The ``lattice`` of former chunks spares building what it holds.
    """
    n = len(bounds) - 1
    lens = np.diff(bounds)
    full = np.flatnonzero(lens > 0)
    if not len(full):
        return [[] for _ in range(n)]
    text = np.full(int(lens.sum()) + len(full), 0x20, np.uint8)
    first = np.cumsum(lens[full] + 1) - (lens[full] + 1)
    body = np.ones(len(text), bool)
    body[first] = False
    text[body] = data
    split = np.zeros(len(text), bool)
    if not vocabulary.crossing:
        blank, line = text == 0x20, text == 0x0A
        split |= line
        split[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
    split[first] = True
    starts = np.flatnonzero(split)
    ends = np.append(starts[1:], len(text))
    lattice = Lattice(vocabulary) if lattice is None else lattice
    first_node = lattice.units(text, starts, ends)
    per = np.append(np.searchsorted(starts, first), len(starts))
    doc = np.repeat(np.arange(len(full)), np.diff(per))
    ordinal = (np.arange(len(starts)) - per[doc]).astype(U64)
    seeds = mix(keys[full])

    def unit_keys(units: np.ndarray, sample: int) -> np.ndarray:
        return mix(seeds[doc[units]] + ordinal[units] * _STEP[2] + np.multiply(U64(sample), _STEP[3:4]))

    everything = np.arange(len(starts))
    edges, counts = _walk(lattice, first_node, unit_keys(everything, 0))
    ofs = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(everything, counts)
    with np.errstate(divide="ignore"):
        roots = -np.log(-np.log(_uniform(seeds, 7)))
    far = _uniform(seeds + np.diff(ofs[per]).astype(U64) * _STEP[1], 3).tolist()
    paths: list[list[_Path]] = []
    for d in range(len(full)):
        a, b = ofs[per[d]], ofs[per[d + 1]]
        paths.append([_Path(edges[a:b], owner[a:b], float(roots[d]), lattice, seeds[d], 0, far[d])])

    def best(d: int) -> tuple[float, int, int]:
        found = (-np.inf, 0, 0)
        for p, path in enumerate(paths[d]):
            j = int(path.siblings.argmax())
            if path.siblings[j] > found[0]:
                found = (float(path.siblings[j]), p, j)
            if path.far > found[0]:
                found = (path.far, p, -1)
        return found

    for sample in range(1, k):
        todo, begin, start_nodes, chosen = [], [], [], []
        draws = seeds + np.multiply(U64(sample), _STEP[4:5])
        turns, rests = _uniform(draws, 1).tolist(), _uniform(draws, 2).tolist()
        own = mix(seeds + np.multiply(U64(sample), _STEP[5:6]))
        for d in range(len(full)):
            value, p, j = best(d)
            if value == -np.inf:
                continue
            if j < 0:
                paths[d][p].deal()
                value, p, j = best(d)
            path = paths[d][p]
            used = path.used.setdefault(j, [int(path.edges[j])])
            node = int(lattice.source(path.edges[j]))
            options = [e for e in range(int(lattice.begin[node]), int(lattice.begin[node + 1])) if e not in used]
            share = np.exp(lattice.log_share[options])
            pick = options[min(int(np.searchsorted(np.cumsum(share), turns[d] * share.sum())), len(options) - 1)]
            used.append(pick)
            others = [e for e in options if e != pick]
            loc = path.upto[j] + np.logaddexp.reduce(lattice.log_share[others]) if others else -np.inf
            path.siblings[j] = _below_one(value, float(loc), rests[d])
            here = int(path.units[j])
            span = np.arange(here, per[d + 1])
            nodes = first_node[span]
            nodes[0] = lattice.target[pick]
            todo.append((d, value, p, j, len(span)))
            begin.append(span)
            start_nodes.append(nodes)
            chosen.append(pick)
        if not todo:
            break
        span = np.concatenate(begin)
        edges, counts = _walk(lattice, np.concatenate(start_nodes), unit_keys(span, sample))
        ofs = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(span, counts)
        upto = ofs[np.concatenate([[0], np.cumsum([n_units for *_, n_units in todo])])]
        sizes = np.diff(upto) + np.array([j + 1 for *_, j, _ in todo])
        far = _uniform(own[[d for d, *_ in todo]] + sizes.astype(U64) * _STEP[1], 3).tolist()
        for i, ((d, value, p, j, _), pick) in enumerate(zip(todo, chosen, strict=True)):
            a, b = upto[i], upto[i + 1]
            path = paths[d][p]
            new = np.concatenate([path.edges[:j], [pick], edges[a:b]])
            units = np.concatenate([path.units[: j + 1], owner[a:b]])
            paths[d].append(_Path(new, units, value, lattice, own[d], j + 1, far[i]))

    out: list[list[tuple]] = [[] for _ in range(n)]
    for d, i in enumerate(full.tolist()):
        limit = best(d)[0]
        for path in paths[d]:
            ids = lattice.id[path.edges]
            bare = np.flatnonzero(ids < 0)
            if len(bare):
                width = np.ones(len(ids), np.int64)
                width[bare] = lattice.left[lattice.source(path.edges[bare])] - lattice.left[lattice.target[path.edges[bare]]]
                ids = np.repeat(ids, width)
                within = np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
                hole = np.flatnonzero(ids < 0)
                ids[hole] = vocabulary.byte_ids[lattice.lead[lattice.source(np.repeat(path.edges, width)[hole]), within[hole]]]
            inclusion = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(path.logp - limit, 700.0))))
            out[i].append((ids, path.logp, path.value, inclusion))
    return out


def _restores(vocabulary: Vocabulary, ids: np.ndarray, text: np.ndarray) -> bool:
    """Whether decoding gives the text again."""
    lens = vocabulary.piece_len[ids]
    total = int(lens.sum())
    if total != len(text) + 1:
        return False
    at = np.repeat(vocabulary.piece_at[ids] - (np.cumsum(lens) - lens), lens) + np.arange(total)
    return bool((vocabulary.piece_data[at[1:]] == text).all())


def sample_segmentations(docs: DataFrame, vocabulary: Vocabulary, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, sample, ids, logp, value, inclusion, decoded): up to ``k`` distinct segmentations of each text.

    ``sample`` counts from 1 in the order of the search, ``logp`` is the segmentation's log-probability,
    ``value`` its perturbed one, ``inclusion`` the probability to be among samples above the next value left
    (1 where nothing is left), ``decoded`` whether the pieces spell the text.  Whole texts are used, of any length.

    Every segmentation that the vocabulary allows can be drawn.  An empty or null text gives one row with no pieces,
    log-probability 0 and inclusion 1.  A text of fewer than ``k`` segmentations gives all of them, so ``k`` may be beyond
    any number.  Values tie with probability zero; a tie goes to the earlier step.  Repeated rows get the same samples; a null
    doc_id counts as key 0.
    Only doc_id and text are read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        lattice = Lattice(voc)
        for batch in batches:
            row_ids = batch.column(0)
            keys = row_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) * _STEP[6] + U64(seed)
            for chunk in text_chunks(batch.column(1), _CHUNK):
                found = sample_chunk(voc, chunk.data, chunk.bounds, keys[chunk.first : chunk.first + len(chunk)], k, lattice)
                rows, ids, stats = [], [], []
                for i, samples in enumerate(found):
                    for j, (pieces, logp, value, inclusion) in enumerate(samples or [(np.zeros(0, np.int32), 0.0, 0.0, 1.0)]):
                        rows.append(chunk.first + i)
                        ids.append(pieces)
                        whole = not samples or _restores(voc, pieces, chunk.data[chunk.bounds[i] : chunk.bounds[i + 1]])
                        stats.append((j + 1, logp, value, inclusion, whole))
                number, logp, value, inclusion, whole = zip(*stats, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [row_ids.take(pa.array(rows)), pa.array(number, pa.int32()), ragged(np.concatenate(ids), np.array([len(x) for x in ids]), pa.int32()),
                     pa.array(logp), pa.array(value), pa.array(inclusion), pa.array(whole)],
                    ["doc_id", "sample", "ids", "logp", "value", "inclusion", "decoded"],
                )
        lattice = None
        give_back()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, sample int, ids array<int>, logp double, value double, inclusion double, decoded boolean")


def decode_segmentations(segmented: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows (doc_id, sample, text): the text that each row's piece ``ids`` spell, without the blank put before it.

    Null or empty ids give an empty text; ids outside the vocabulary raise an error.  Other columns are not read; an empty table
    gives an empty result, repeated rows one row each.
    """
    shared = segmented.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [shared.value.decode(ids) if ids else "" for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["doc_id", "sample", "text"])

    small_batches(segmented.sparkSession)
    base = segmented.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sample").cast("int").alias("sample"), F.col("ids").cast("array<int>").alias("ids"))
    return base.mapInArrow(run, "doc_id long, sample int, text string")
