"""Sampled SentencePiece segmentations without replacement, and exact decoding.

The pieces of a SentencePiece model span a lattice over a text. Pieces never
reach over the beginning of a run of blanks, so the lattice of a text is the chain
of its words' lattices, and the lattice of each distinct word is built once. A word of
more than ``LONGEST_WORD`` bytes is cut there, at the beginning of a character, and no piece reaches over
a cut: work and memory stay in proportion to the text. A piece weighs ``exp(ALPHA * log p)``; where a model's scores are merge
ranks, ``p`` is Zipf's ``1 / (rank + 2.7)``. Backward sums turn the weights into
the probability of each edge, given its start.

Gumbel top-k: every segmentation has its log-probability plus Gumbel noise, and
the k largest are a sample without replacement. They are found by A-star search
with perturbed bounds: the bound of a node is the largest perturbed value below
it, drawn top-down, so a node's best child inherits the bound and the others get
values conditioned to stay below it. The search follows the best child to the
end, keeps every sibling it passes on the agenda, and takes the next sample from
the agenda's maximum. All texts of a batch are searched at once, a step of all
words being one pass of array operations. The noise is a hash of the row's key,
the sample, and the place in the text: results do not depend on batches or tasks.

``kappa`` is the (k+1)-th largest value, and the inclusion score of a sample is
``1 - exp(-exp(log_prob - kappa))``, its probability to be among the values
above kappa.
"""

from __future__ import annotations

import math
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm import textops as tx
from labelspark.llm.tokenfile import tokenizer_path

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
ALPHA = 0.5
SEED = 17
RANK_OFFSET = 2.7
CHUNK = 192 << 10  # bytes of text searched at once
LONGEST = 64  # bytes of a piece looked up
LONGEST_WORD = 1024  # bytes of a word's lattice
KEPT_EDGES = 4_000_000  # edges of word lattices that a task remembers at a time


class Pieces:
    """The vocabulary as a trie over bytes (blank for the model's word mark), with log-probabilities."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        n = sp.get_piece_size()
        byte_id = {}
        normal = []
        for k in range(n):
            if sp.is_byte(k):
                byte_id[int(sp.id_to_piece(k)[1:-1], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                normal.append((sp.id_to_piece(k).replace("▁", " ").encode(), k, sp.get_score(k)))
        scores = np.array([s for _, _, s in normal])
        ranked = len(scores) > 1 and bool((scores == np.round(scores)).all()) and scores.min() < -1000
        log_p = -np.log(RANK_OFFSET - scores) if ranked else scores
        log_p = log_p - np.logaddexp.reduce(log_p)
        self.unknown = sp.unk_id()
        self.byte_id = np.array([byte_id.get(b, self.unknown) for b in range(256)], np.int64)
        self.byte_weight = alpha * (float(log_p.min()) - 1.0)
        self.bytes = [b""] * n
        for b, k in byte_id.items():
            self.bytes[k] = bytes([b])
        keys, child, at = {}, [0], [(-1, 0.0)]
        for (raw, k, _), lp in zip(normal, log_p.tolist()):
            self.bytes[k] = raw
            node = 0
            for b in raw:
                nxt = keys.get((node << 8) | b)
                if nxt is None:
                    nxt = keys[(node << 8) | b] = len(at)
                    at.append((-1, 0.0))
                node = nxt
            at[node] = (k, alpha * lp)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._place(np.array(list(keys), np.int64), np.array(list(keys.values()), np.int64))
        self.piece = np.array([k for k, _ in at], np.int64)
        self.weight = np.array([w for _, w in at])
        # the first two bytes by one look-up
        self.one, self.two = np.full(256, -1, np.int64), np.full(1 << 16, -1, np.int64)
        for key, to in keys.items():
            if key < 256:
                self.one[key] = to
        for b, to in enumerate(self.one.tolist()):
            for c in range(256 if to >= 0 else 0):
                self.two[(b << 8) | c] = keys.get((to << 8) | c, -1)

    def _place(self, keys: np.ndarray, child: np.ndarray) -> None:
        """Children by (state, byte) in a table of four times their number, each at its hash or the next free places."""
        size = 1 << max(4, int(4 * len(keys) - 1).bit_length())
        self.mask, self.keys, self.child = size - 1, np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        left, at = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)  # of several, the first takes the place
            won = np.flatnonzero(free)[one]
            self.keys[at[won]], self.child[at[won]] = keys[left[won]], child[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x9E3779B1) >> 13) & self.mask

    def next(self, keys: np.ndarray) -> np.ndarray:
        """Child of every (state, byte), or -1."""
        at = self._hash(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.child[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.child[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids, without the blank put before a text."""
        return b"".join([self.bytes[k] for k in ids.tolist()])[1:]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions starts[i] .. starts[i] + counts[i] - 1 one after another, and the first of each i."""
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - first, counts), first


class Lattice:
    """Lattices of new words, all in one set of nodes (a node per byte, and one at each end)."""

    def __init__(self, pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        sizes = ends - starts
        at, first = _ragged(starts, sizes)
        raw = data[at]
        word = np.repeat(np.arange(len(starts)), sizes)
        local = np.arange(len(raw)) - first[word]
        self.root = first + np.arange(len(starts))
        node = self.root[word] + local
        left = sizes[word] - local
        lead = (raw & 0xC0) != 0x80  # edges begin where a character does
        src, dst, piece, weight = [], [], [], []
        state, alive = np.zeros(int(lead.sum()), np.int64), np.flatnonzero(lead)
        for d in range(LONGEST):
            ok = left[alive] > d
            state, alive = state[ok], alive[ok]
            if not len(alive):
                break
            if d == 0:
                state = pieces.one[raw[alive]]
            elif d == 1:
                state = pieces.two[(raw[alive].astype(np.int64) << 8) | raw[alive + 1]]
            else:
                state = pieces.next((state << 8) | raw[alive + d])
            ok = state >= 0
            state, alive = state[ok], alive[ok]
            hit = pieces.piece[state] >= 0
            src.append(node[alive[hit]])
            dst.append(node[alive[hit]] + d + 1)
            piece.append(pieces.piece[state[hit]])
            weight.append(pieces.weight[state[hit]])
        # a character that is no piece is spelled by its bytes, as one edge
        chars = np.flatnonzero(lead)
        length = np.diff(np.append(chars, len(raw)))
        length = np.minimum(length, left[chars])
        have = np.zeros(len(raw) + len(starts) + 1, bool)
        first_of = np.zeros(len(have), np.int64)  # bytes of the character at a node
        first_of[node[chars]] = length
        for s, t in zip(src, dst):
            have[s[t - s == first_of[s]]] = True
        bare = ~have[node[chars]]
        src.insert(0, node[chars[bare]])
        dst.insert(0, node[chars[bare]] + length[bare])
        piece.insert(0, -1 - chars[bare])  # minus the place of the character, less one
        weight.insert(0, length[bare] * pieces.byte_weight)
        src, dst, piece, weight = (np.concatenate(x) for x in (src, dst, piece, weight))
        order = np.argsort(src, kind="stable")  # edges came by length, so those of a node stay in order
        self.dst, self.piece, self.raw = dst[order], piece[order], raw
        nodes = len(raw) + len(starts)
        self.edge = np.searchsorted(src[order], np.arange(nodes + 1))
        self.end = np.zeros(nodes, bool)
        self.end[self.root + sizes] = True
        self.log_q = self._probabilities(weight[order], src[order], word, local, sizes)

    def _probabilities(self, weight, src, word, local, sizes) -> np.ndarray:
        """Log-probability of every edge given its start: backward sums, all words at once by distance from the end."""
        nodes = len(self.end)
        beta = np.full(nodes, -np.inf)
        beta[self.end] = 0.0
        counts = np.diff(self.edge)
        node = self.root[word] + local
        distance = sizes[word] - local
        order = np.argsort(distance, kind="stable")
        ranks = distance[order]
        cut = np.searchsorted(ranks, np.arange(1, int(ranks[-1]) + 2 if len(ranks) else 1))
        for d in range(len(cut) - 1):
            some = node[order[cut[d]: cut[d + 1]]]
            some = some[counts[some] > 0]
            if len(some):
                at, first = _ragged(self.edge[some], counts[some])
                value = weight[at] + beta[self.dst[at]]
                top = np.maximum.reduceat(value, first)
                beta[some] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts[some])), first))
        return weight + beta[self.dst] - beta[src]


class Store:
    """Lattices of the words seen, by hash; emptied when it holds ``KEPT_EDGES`` edges."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.used = {"edges": 0, "nodes": 0, "bytes": 0, "words": 0}
        self.parts = {"dst": ("edges", np.int32), "piece": ("edges", np.int32), "log_q": ("edges", np.float64),
                      "lo": ("nodes", np.int64), "count": ("nodes", np.int32), "end": ("nodes", bool),
                      "raw": ("bytes", np.uint8), "root": ("words", np.int64)}
        for name, (_, kind) in self.parts.items():
            setattr(self, name, np.empty(KEPT_EDGES, kind))  # room that is not touched takes no memory

    def _append(self, name: str, values: np.ndarray) -> None:
        n, have = self.used[self.parts[name][0]], getattr(self, name)
        if n + len(values) > len(have):
            wider = np.empty(n + len(values) + (len(have) >> 2), have.dtype)
            wider[:n] = have[:n]
            setattr(self, name, wider)
        getattr(self, name)[n: n + len(values)] = values

    def words(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slot of each distinct word (ascending hashes); unknown ones are added."""
        if self.used["edges"] > KEPT_EDGES:
            self.clear()
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        new = np.flatnonzero(self.keys[at] != hashes) if len(self.keys) else np.arange(len(hashes))
        if len(new):
            lat, used = Lattice(self.pieces, data, starts[new], ends[new]), self.used
            base = used["bytes"]
            for name, values in (("dst", lat.dst + used["nodes"]), ("piece", np.where(lat.piece < 0, lat.piece - base, lat.piece)),
                                 ("log_q", lat.log_q), ("lo", lat.edge[:-1] + used["edges"]), ("count", np.diff(lat.edge)),
                                 ("end", lat.end), ("raw", lat.raw), ("root", lat.root + used["nodes"])):
                self._append(name, values)
            place = np.searchsorted(self.keys, hashes[new])
            self.keys = np.insert(self.keys, place, hashes[new])
            self.slot = np.insert(self.slot, place, used["words"] + np.arange(len(new)))
            self.used = {"edges": used["edges"] + len(lat.dst), "nodes": used["nodes"] + len(lat.end),
                         "bytes": base + len(lat.raw), "words": used["words"] + len(new)}
        return self.slot[np.searchsorted(self.keys, hashes)]


def _word_noise(seed: np.ndarray, sample: int, word: np.ndarray) -> np.ndarray:
    """Hash of a row's key, a sample and the place of a word in the row."""
    h = tx.mix64(seed + np.uint64((sample + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return tx.mix64(h ^ (word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _gumbel(word_noise: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Gumbel noise of an edge, counted from its word's first one."""
    h = tx.mix64(word_noise + edge.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    u = ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
    return -np.log(-np.log(u))


class Search:
    """Perturbed A-star over a batch of texts: chains of word lattices."""

    def __init__(self, lattice: Store, word_of: np.ndarray, first: np.ndarray, seeds: np.ndarray):
        """``word_of``: slot of every word; ``first``: first word of every text (n + 1)."""
        self.lattice, self.word_of, self.first, self.seeds = lattice, word_of, first, seeds
        self.n = len(first) - 1
        self.doc_of = np.repeat(np.arange(self.n), np.diff(first))
        # the best siblings passed, per sample: value, text, word, edge, log-probability before it, place in the path
        self.agenda: list[tuple[np.ndarray, ...]] = []
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []  # edges of each sample in (word, step) order
        self.values, self.log_probs, self.came = [], [], []

    def run(self, samples: int) -> None:
        self.samples = samples
        root = -np.log(-np.log(((tx.mix64(self.seeds ^ np.uint64(0x5EED)) >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)))
        live = np.arange(self.n)
        self._follow(0, live, root, None)
        for s in range(1, samples):
            value, entry = self._best()
            live = np.flatnonzero(np.isfinite(value))
            self._follow(s, live, value, entry)
        self.kappa = self._best()[0]

    def _best(self) -> tuple[np.ndarray, list]:
        """The agenda's largest value per text, and where it is; taken off when followed."""
        value = np.full(self.n, -np.inf)
        at = np.full(self.n, -1)
        source = np.full(self.n, -1)
        for k, (v, doc, *_) in enumerate(self.agenda):
            if len(v):
                cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                top = np.maximum.reduceat(v, cut)
                where = np.flatnonzero(v == np.repeat(top, np.diff(np.append(cut, len(v)))))
                which = np.zeros(self.n, np.int64)
                which[doc[where[::-1]]] = where[::-1]
                d = doc[cut]
                better = top > value[d]
                value[d[better]] = top[better]
                at[d[better]] = which[d[better]]
                source[d[better]] = k
        return value, (source, at)

    def _follow(self, sample: int, live: np.ndarray, bound: np.ndarray, entry) -> None:
        """Follow best children to the end of every live text, from its root or from an agenda entry."""
        lat, chosen = self.lattice, np.zeros(self.n, bool)
        chosen[live] = True
        phi = np.zeros(self.n)  # log-probability up to and with the entry's edge
        begin_word = self.first[:-1].copy()
        parent = np.full(self.n, -1)
        edge_in, left_at = np.full(self.n, -1), np.zeros(self.n, np.int64)
        if entry is not None:
            source, at = entry
            for d in live.tolist():
                k, a = int(source[d]), int(at[d])
                v, _, word, edge, before, place = self.agenda[k]
                parent[d], edge_in[d], begin_word[d], left_at[d] = k, edge[a], word[a], place[a]
                phi[d] = before[a] + lat.log_q[edge[a]]
                v[a] = -np.inf
        keep = chosen[self.doc_of] & (np.arange(len(self.doc_of)) >= begin_word[self.doc_of])
        lane_word = np.flatnonzero(keep)
        node = lat.root[self.word_of[lane_word]].copy()
        entered = np.zeros(len(lane_word), bool)
        if entry is not None and len(lane_word):
            d = self.doc_of[lane_word]
            entered = lane_word == begin_word[d]
            node[entered] = lat.dst[edge_in[d[entered]]]
        doc = self.doc_of[lane_word]
        noise = _word_noise(self.seeds[doc], sample, lane_word - self.first[doc])
        base = lat.lo[lat.root[self.word_of[lane_word]]]
        taken, passed, done = [], [], 0  # (lane, edge) chosen; (place of the chosen one, edge, gap, value) of its siblings
        lanes = np.flatnonzero(~lat.end[node])
        while len(lanes):
            here = node[lanes]
            lo, counts = lat.lo[here], lat.count[here]
            pick = lo.copy()
            many = np.flatnonzero(counts > 1)
            if len(many):
                some = counts[many]
                at, first = _ragged(lo[many], some)
                owner = np.repeat(many, some)
                lane = lanes[owner]
                r = lat.log_q[at] + _gumbel(noise[lane], at - base[lane])
                top = np.repeat(np.maximum.reduceat(r, first), some)
                gap = r - top
                won = np.flatnonzero(gap == 0)
                pick[owner[won[::-1]]] = at[won[::-1]]
                lost = at != pick[owner]
                passed.append((done + owner[lost], at[lost], gap[lost], r[lost]))
            taken.append((lanes, pick))
            done += len(lanes)
            node[lanes] = lat.dst[pick]
            lanes = lanes[~lat.end[node[lanes]]]
        if not taken:
            self.agenda.append(self._siblings([], *[None] * 6, 0))
            self.paths.append((np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)))
        else:
            lane, edge = (np.concatenate([t[k] for t in taken]) for k in range(2))
            order = np.argsort(lane, kind="stable")  # lanes are words in order; steps of a word stay in order
            lane, edge = lane[order], edge[order]
            d = doc[lane]
            q = lat.log_q[edge]
            total = np.cumsum(q)
            cut = np.searchsorted(d, np.arange(self.n + 1))
            offset = np.concatenate([[0.0], total])[cut[:-1]]
            before = total - q - offset[d] + phi[d]
            rank = np.empty(done, np.int64)
            rank[order] = np.arange(done)
            self.agenda.append(self._siblings(passed, rank, before, d, lane_word[lane], cut, bound, self.samples - sample))
            self.paths.append((edge, cut))
            phi = phi + np.where(np.diff(cut) > 0, np.concatenate([[0.0], total])[cut[1:]] - offset, 0.0)
        self.values.append(np.where(chosen, bound, -np.inf))
        self.log_probs.append(np.where(chosen, phi, -np.inf))
        self.came.append((parent, left_at, edge_in))

    def _siblings(self, passed, rank, before, doc, word, cut, bound, wanted: int) -> tuple[np.ndarray, ...]:
        """The ``wanted`` best siblings of each text's path (no later step takes more), by text.

        A sibling's value falls with ``v``, so only those that stay get a value.
        """
        if not passed or wanted < 1:
            return tuple(np.zeros(0, t) for t in (float, int, int, int, float, int))
        near, edge, gap, raw = (np.concatenate([t[k] for t in passed]) for k in range(4))
        near = rank[near]  # a sibling's log-probability before it is that of the chosen edge
        owner = doc[near]
        v = np.log1p(-np.exp(gap)) - (before[near] + raw)
        chosen = []
        for _ in range(wanted):
            least = np.full(self.n, np.inf)
            np.minimum.at(least, owner, v)
            hit = np.flatnonzero(v == least[owner])
            hit = hit[np.isfinite(v[hit])]
            hit = hit[np.unique(owner[hit], return_index=True)[1]]
            chosen.append((hit, v[hit]))
            v[hit] = np.inf
        at, v = (np.concatenate([c[k] for c in chosen]) for k in range(2))
        order = np.argsort(owner[at], kind="stable")
        at, v = at[order], v[order]
        near, owner = near[at], owner[at]
        limit = bound[owner]
        v = v + limit
        value = limit - np.maximum(v, 0.0) - np.log1p(np.exp(-np.abs(v)))
        return value, owner, word[near], edge[at], before[near], near - cut[owner]

    def edges(self, sample: int, d: int) -> np.ndarray:
        """All edges of a sample of a text, from the first word on."""
        path, cut = self.paths[sample]
        own = path[cut[d]: cut[d + 1]]
        parent, place, edge_in = (int(x[d]) for x in self.came[sample])
        if parent < 0:
            return own
        _, cut = self.paths[parent]
        before = self.edges(parent, d)
        # what the path it left had up to the node where the entry's edge begins
        return np.concatenate([before[: len(before) - int(cut[d + 1] - cut[d]) + place], [edge_in], own])


_CHARACTER = np.ones(256, np.int64)  # bytes of a UTF-8 character, by its first one
_CHARACTER[0xC0:0xE0], _CHARACTER[0xE0:0xF0], _CHARACTER[0xF0:] = 2, 3, 4


def _path_ids(pieces: Pieces, lat: Store, edges: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths laid end to end, and where each path's begin (n + 1); a spelled character gives an id per byte."""
    ids = lat.piece[edges].astype(np.int64)
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids, cut
    place = -1 - ids[bare]
    count = np.ones(len(ids), np.int64)
    count[bare] = _CHARACTER[lat.raw[place]]
    out = np.repeat(ids, count)
    at, _ = _ragged((np.cumsum(count) - count)[bare], count[bare])
    spelled, _ = _ragged(place, count[bare])
    out[at] = pieces.byte_id[lat.raw[spelled]]
    return out, np.concatenate([[0], np.cumsum(count)])[cut]


def _round_trips(pieces: Pieces, ids: np.ndarray, cut: np.ndarray, data: np.ndarray, offsets: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the ids of every path decode to its text (a blank goes in front)."""
    size = pieces.size[ids]
    at, _ = _ragged(pieces.start[ids], size)
    got = pieces.flat[at]
    first = np.concatenate([[0], np.cumsum(size)])[cut]
    have, want = np.diff(first), np.diff(offsets)[text]
    good = (have == want + 1) | ((have == 0) & (want == 0))
    some = np.flatnonzero(good & (have > 0))
    place, begin = _ragged(first[some] + 1, want[some])
    source, _ = _ragged(offsets[text[some]], want[some])
    differ = np.concatenate([[0], np.cumsum(got[place] != data[source])])
    good[some] = differ[begin + want[some]] == differ[begin]
    return good


def _cut_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of at most ``LONGEST_WORD`` bytes: longer ones are cut where a character begins."""
    long = np.flatnonzero(ends - starts > LONGEST_WORD)
    if not len(long):
        return starts, ends
    places, _ = _ragged(np.zeros(len(long), np.int64), (ends[long] - starts[long] - 1) // LONGEST_WORD)
    cuts = np.repeat(starts[long], (ends[long] - starts[long] - 1) // LONGEST_WORD) + (places + 1) * LONGEST_WORD
    for _ in range(3):
        cuts = cuts - ((data[cuts] & 0xC0) == 0x80)
    starts = np.sort(np.concatenate([starts, cuts]))
    return starts, np.sort(np.concatenate([ends, cuts]))


def sample_chunk(store: Store, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, samples: int = SAMPLES):
    """Text, sample, ids end to end, where each sample's begin, log_prob, value, kappa and round_trip
    of every sample of a run of texts, in order."""
    n = len(offsets) - 1
    padded = np.insert(data, offsets[:-1], 0x20)
    at = offsets + np.arange(n + 1)
    full = np.diff(offsets) > 0  # an empty text has no lattice and one empty segmentation
    begin = np.zeros(len(padded), bool)
    blank = padded == 0x20
    begin[1:] = blank[1:] & ~blank[:-1]
    begin[at[:-1]] = True
    drop = at[:-1][~full]
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(padded)).astype(np.int64)
    if len(drop):
        keep = ~np.isin(starts, drop)
        starts, ends = starts[keep], ends[keep]
    starts, ends = _cut_words(padded, starts, ends)
    first = np.searchsorted(starts, at)
    if len(starts):
        hashes, one, word_of = np.unique(tx.span_hashes(padded, starts, ends, lower=False), return_index=True, return_inverse=True)
        search = Search(store, store.words(hashes, padded, starts[one], ends[one])[word_of.ravel()], first, seeds)
        search.run(samples)
    rows, told, paths = [], [], []
    for d in range(n):
        if not full[d]:
            rows.append((d, 0))
            told.append((0.0, 0.0, -math.inf))
            paths.append(np.zeros(0, np.int64))
            continue
        for s in range(samples):
            if np.isfinite(search.values[s][d]):
                rows.append((d, s))
                told.append((search.log_probs[s][d], search.values[s][d], search.kappa[d]))
                paths.append(search.edges(s, d))
    text, sample = np.array(rows, np.int64).reshape(-1, 2).T
    log_prob, value, kappa = np.array(told, np.float64).reshape(-1, 3).T
    edges = np.concatenate([np.zeros(0, np.int64), *paths])
    ids, cut = _path_ids(store.pieces, store, edges, np.concatenate([[0], np.cumsum([len(p) for p in paths], dtype=np.int64)]))
    return text, sample, ids, cut, log_prob, value, kappa, _round_trips(store.pieces, ids, cut, data, offsets, text)


def sample_texts(store: Store, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, samples: int = SAMPLES):
    """(text, sample, ids, log_prob, value, kappa) of every sample of a run of texts, in order."""
    text, sample, ids, cut, log_prob, value, kappa, _ = sample_chunk(store, data, offsets, seeds, samples)
    for k in range(len(text)):
        yield int(text[k]), int(sample[k]), ids[cut[k]: cut[k + 1]], float(log_prob[k]), float(value[k]), float(kappa[k])


def worker_store(model: str, alpha: float) -> Store:
    """The store of this Python worker: tasks that follow each other share the vocabulary."""
    kept = sys.modules.setdefault("_piece_stores", types.ModuleType("_piece_stores"))
    name = f"{model} {alpha}"
    if name not in vars(kept):
        vars(kept).clear()  # one model at a time
        setattr(kept, name, Store(Pieces(model, alpha)))
    return vars(kept)[name]


OUT = (("sample", T.IntegerType()), ("n_pieces", T.LongType()), ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()),
       ("inclusion", T.DoubleType()), ("round_trip", T.BooleanType()), ("ids", T.ArrayType(T.IntegerType())))


def encode_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, samples: int = SAMPLES,
                   alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id and up to ``samples`` distinct segmentations of every row, a row each.

    Columns: sample (0 first), n_pieces, log_prob, perturbed (log_prob plus
    noise, falling within a row), inclusion, round_trip (the ids decode to the
    text's bytes), ids. A text with fewer segmentations gives them all, with
    inclusion 1; null counts as the empty text, which has one empty
    segmentation. The noise is seeded by the id as text, so rows with one id and
    text are alike; a null id seeds like the empty string. Other columns are
    ignored; an empty table gives an empty result.
    """
    out = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *[T.StructField(k, t) for k, t in OUT]])
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                         F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(seed)).alias("seed"))

    def run(batches):
        for batch in batches:
            store = worker_store(model, alpha)
            data, offsets = tx.text_buffers(batch.column(1))
            seeds = tx.unsigned(batch.column(2).to_numpy())
            for i, j in tx.doc_chunks(offsets, CHUNK):
                part, at = data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i]
                text, sample, ids, cut, log_prob, value, kappa, same = sample_chunk(store, part, at, seeds[i:j], samples)
                inclusion = -np.expm1(-np.exp(np.minimum(log_prob - kappa, 700.0)))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i + text)), pa.array(sample.astype(np.int32)), pa.array(np.diff(cut)), pa.array(log_prob),
                     pa.array(value), pa.array(inclusion), pa.array(same), lists], out.names)
        worker_store(model, alpha).clear()  # of a worker that waits only the vocabulary stays

    return narrow.mapInArrow(tx.tidy(run), out)


def decode_ids(frame: DataFrame, ids: str = "ids", model: str = MODEL, into: str = "text") -> DataFrame:
    """The frame with the text its piece ids decode to (null ids: null; bytes that are no UTF-8 are replaced)."""
    keep = [c for c in frame.columns if c != into]
    schema = T.StructType([*[frame.schema[c] for c in keep], T.StructField(into, T.StringType())])

    def run(batches):
        pieces = None
        for batch in batches:
            pieces = pieces or Pieces(model)
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)).decode("utf-8", "replace")
                     for x in batch.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return frame.select(*keep).mapInArrow(run, schema)
