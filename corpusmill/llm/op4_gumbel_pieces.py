"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A text is cut before each space, where a piece always starts; each part ("_" and
the letters up to the next space) has a lattice of the vocabulary's pieces, and
characters without a piece become byte pieces. Probabilities are those of a
unigram model: the vocabulary file holds merge ranks, so a piece of rank r
weighs 1 / (r + SHIFT), normalised.

The k segmentations of largest log-probability plus Gumbel noise are a sample
without replacement. They are found by a perturbed A-star search from the top
of the tree of prefixes: the first is an ordinary sample; at each of its steps
the set of all other ways on is a queue entry whose bound, the largest perturbed
value in it, is drawn as a Gumbel value below that of the prefix. The best entry
is opened, sampled to its end, and leaves entries of its own. Entries deep in a
path hold next to no mass and share one entry until that is opened.

All noise is a hash of row key, seed and place, so results do not depend on how
rows are dealt to tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import mix, mix_head, mix_on, per_process, slices

SPACE_MARK = "▁"
SHIFT = 100.0
#: Steps from the top of a path that have a queue entry each.
DEPTH = 96


class Vocabulary:
    """Pieces of a model file as a trie in sorted arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = np.full(256, -1, dtype=np.int32)
        weights = np.zeros(len(self.pieces))
        children: list[dict[str, int]] = [{}]
        ends = [-1]
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                weights[i] = 1 / (SHIFT - model.get_score(i))
                at = 0
                for c in piece:
                    if c not in children[at]:
                        children[at][c] = len(children)
                        children.append({})
                        ends.append(-1)
                    at = children[at][c]
                ends[at] = i
        weights[self.bytes[self.bytes >= 0]] = 1 / (SHIFT + len(self.pieces))
        with np.errstate(divide="ignore"):
            self.logp = np.log(weights / weights.sum())
        moves = sorted((at << 21 | ord(c), to) for at, kids in enumerate(children) for c, to in kids.items())
        # moves from the root by code point, the others in an open hash table
        self.roots = np.full(0x110000, -1, dtype=np.int32)
        for key, to in moves:
            if key >> 21 == 0:
                self.roots[key & 0x1FFFFF] = to
        self.bits = len(moves).bit_length() + 2
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.to = np.full(1 << self.bits, -1, dtype=np.int32)
        self.probes = 1
        for key, to in moves:
            at, probe = self._slot(np.array([key]))[0], 1
            while self.keys[at] >= 0:
                at, probe = (at + 1) & ((1 << self.bits) - 1), probe + 1
            self.keys[at], self.to[at] = key, to
            self.probes = max(self.probes, probe)
        self.ends = np.array(ends, dtype=np.int64)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no byte pieces")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def move(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where no piece goes on."""
        keys = state << 21 | code
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.to[at], -1).astype(np.int64)
        left = np.nonzero((out < 0) & (self.keys[at] >= 0))[0]
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        data = bytearray()
        for i in ids:
            piece = self.pieces[i]
            data += bytes([int(piece[3:5], 16)]) if self.bytes[0] <= i <= self.bytes[255] else piece.replace(SPACE_MARK, " ").encode()
        return data.decode()[1:]


class Lattices:
    """The lattices of distinct parts: nodes are places in parts, edges are sorted by node.

    ``step`` has the cumulative probability of edges over all nodes; that of
    node j's edges lies between j and j + 1.
    """

    def __init__(self, vocabulary: Vocabulary, parts: list[str]):
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        code = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        end = np.repeat(np.cumsum(sizes), sizes)
        inner = np.ones(len(code), dtype=bool)
        self.first = np.cumsum(sizes) - sizes  # by part, in places
        inner[self.first] = False
        real = code == ord(SPACE_MARK)
        code[real & inner] = 0  # a mark of the text itself has no piece, only bytes
        start = np.arange(len(code))
        state = np.zeros(len(code), dtype=np.int64)
        froms, lengths, ids, length = [], [], [], 0
        lone = np.zeros(len(code), dtype=bool)
        while len(start):
            to = vocabulary.move(state, code[start + length]) if length else vocabulary.roots[code].astype(np.int64)
            ok = to >= 0
            start, state = start[ok], to[ok]
            length += 1
            found = vocabulary.ends[state]
            piece = found >= 0
            froms.append(start[piece])
            lengths.append(np.full(int(piece.sum()), length))
            ids.append(found[piece])
            if length == 1:
                lone[start[piece]] = True
            more = start + length < end[start]
            start, state = start[more], state[more]
        # characters without a piece: their bytes
        odd = np.nonzero(~lone)[0]
        raw = np.where(code[odd] == 0, np.where(real[odd], ord(SPACE_MARK), 0), code[odd])
        spelled = np.full((len(odd), 4), -1, dtype=np.int32)
        counts = 1 + (raw > 0x7F) + (raw > 0x7FF) + (raw > 0xFFFF)
        for k, c in enumerate(raw.tolist()):
            data = chr(c).encode()
            spelled[k, : len(data)] = vocabulary.bytes[list(data)]
        froms, lengths = [*froms, odd], [*lengths, np.ones(len(odd), dtype=np.int64)]
        # edges by node: each list holds a node at most once, in order, so its edges take the node's next places
        counts_of = np.bincount(np.concatenate(froms), minlength=len(code))
        self.node_edges = np.append(0, np.cumsum(counts_of))
        free, order = self.node_edges[:-1].copy(), []
        for rows in froms:
            order.append(free[rows])
            free[rows] += 1
        order = np.concatenate(order)
        start = np.repeat(np.arange(len(code)), counts_of)
        length = np.empty(len(start), dtype=np.int64)
        length[order] = np.concatenate(lengths)
        ids, n = np.concatenate(ids).astype(np.int64), len(start) - len(odd)
        logp = np.empty(len(start))
        logp[order[:n]] = vocabulary.logp[ids]
        logp[order[n:]] = counts * vocabulary.logp[vocabulary.bytes[0]]
        # an edge is spelled by one id or, negative, by a row of the bytes of a character
        self.spelling, self.spelled = np.empty(len(start), dtype=np.int32), spelled
        self.spelling[order[:n]] = ids
        self.spelling[order[n:]] = -1 - np.arange(len(odd))
        # what lies ahead, from the last place of each part to the first
        ahead = np.zeros(len(code) + 1)
        done = start + length
        stop = np.repeat(end, counts_of)
        closes, back = done == stop, stop - start
        value = np.empty(len(start))  # of an edge and what lies ahead of it
        longest = int(back.max(initial=0))
        # sixteen bits are sorted by their digits
        by_back = np.argsort(back.astype(np.uint16) if longest < 1 << 16 else back, kind="stable")
        bounds = np.searchsorted(back[by_back], np.arange(1, longest + 2))
        for k in range(len(bounds) - 1):
            rows = by_back[bounds[k] : bounds[k + 1]]
            if not len(rows):
                continue
            now = logp[rows] + np.where(closes[rows], 0, ahead[done[rows]])
            value[rows] = now
            new = np.append(0, np.nonzero(np.diff(start[rows]))[0] + 1)
            top = np.maximum.reduceat(now, new)
            now -= np.repeat(top, np.diff(np.append(new, len(rows))))
            ahead[start[rows[new]]] = top + np.log(np.add.reduceat(np.exp(now), new))
        value -= np.repeat(ahead[:-1], counts_of)
        self.logq = np.minimum(value, 0, out=value)
        total = np.cumsum(np.exp(self.logq))
        at_node = np.append(0, total)[self.node_edges]
        self.step = start + (total - np.repeat(at_node[:-1], counts_of)) / np.repeat(np.diff(at_node), counts_of)
        self.next = np.where(closes, -1, done)

    def ids(self, path: np.ndarray) -> np.ndarray:
        """The ids that spell a path."""
        ids = self.spelling[path]
        odd = ids < 0
        if not odd.any():
            return ids
        wide = np.full((len(ids), self.spelled.shape[1]), -1, dtype=np.int32)
        wide[:, 0] = ids
        wide[odd] = self.spelled[-1 - ids[odd]]
        return wide[wide >= 0]

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge, last = self.node_edges[node], self.node_edges[node + 1] - 1
        several = np.nonzero(edge < last)[0]
        found = np.searchsorted(self.step, node[several] + u[several], side="right")
        edge[several] = np.clip(found, edge[several], last[several])
        return edge


def uniform(keys: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Hashed numbers in (0, 1)."""
    return _unit(mix(keys, place))


def _unit(hashed: np.ndarray) -> np.ndarray:
    out = (mix(hashed, 5) >> np.uint64(12)).astype(np.float64)
    out += 0.5
    out /= 2.0**52
    return out


def gumbel(u):
    return -np.log(-np.log(u))


def below(location, bound: float, u):
    """Gumbel values at ``location`` given that they are under ``bound``."""
    return -np.logaddexp(-bound, -(location + gumbel(u)))


def fresh(lattices: Lattices, part: np.ndarray, keys: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A sampled path for each occurrence of a part: edges in order, and their number.

    Occurrences are walked in the order of their parts (``order``, if known),
    so lattices are read from the first to the last.
    """
    live = np.argsort(part, kind="stable") if order is None else order
    node, head = lattices.first[part[live]], mix_head(keys[live])
    taken, turn = [], 0
    counts = np.zeros(len(part), dtype=np.int64)
    while len(live):
        edge = lattices.choose(node, _unit(mix_on(head, np.uint64(turn))))
        taken.append((live, edge))
        counts[live] += 1
        node = lattices.next[edge]
        on = node >= 0
        live, node, head = live[on], node[on], head[on]
        turn += 1
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int64)
    for turn, (rows, edge) in enumerate(taken):
        out[begin[rows] + turn] = edge
    return out, counts


class Search:
    """The queue of one text. A path is its edges; ``grow`` samples a path's end."""

    def __init__(self, lattices: Lattices, parts: np.ndarray, key: int, k: int):
        self.lattices, self.parts, self.key, self.k = lattices, parts, key, k
        self.queue: list = []
        self.draws = 0
        self.head = mix_head(np.array([key], dtype=np.uint64))

    def _u(self, n: int = 1) -> np.ndarray:
        self.draws += n
        # mix of the key and each place; the key's part of it is worked out once
        hashed = np.arange(self.draws - n, self.draws, dtype=np.uint64)
        hashed += np.uint64(1 << 62)
        return _unit(mix_on(self.head, hashed))

    def _push(self, value: float, *entry) -> None:
        heapq.heappush(self.queue, (-value, len(self.queue) + 1000 * self.draws, entry))

    def add(self, path: np.ndarray, value: float, since: int) -> None:
        """Queue what branches off a path at step ``since`` or later."""
        logq = self.lattices.logq[path]
        stop = min(since + DEPTH, len(path))
        prefix = np.append(0, np.cumsum(logq))
        with np.errstate(divide="ignore"):
            mass = prefix[since:stop] + np.log(-np.expm1(logq[since:stop]))
        bounds = below(mass, value, self._u(stop - since)) if stop > since else np.zeros(0)
        # at most k entries are opened or close the search, so no more than k of a path can matter
        for k in np.argsort(-bounds)[: self.k].tolist():
            if mass[k] > -np.inf:
                self._push(float(bounds[k]), path, since + k, {int(path[since + k])})
        rest = prefix[-1] - prefix[stop]
        if stop < len(path) and rest < 0:
            bound = below(prefix[stop] + np.log(-np.expm1(rest)), value, self._u())
            self._push(float(bound[0]), path, stop, None)

    def run(self, first: np.ndarray, grow) -> list[tuple[np.ndarray, float, float]]:
        """(path, log-probability, log-probability of inclusion), best perturbed value first."""
        value = float(gumbel(self._u())[0])
        found = [(first, value)]
        self.add(first, value, 0)
        limit = -np.inf
        while self.queue:
            negative, _, (path, at, used) = heapq.heappop(self.queue)
            if len(found) == self.k:
                limit = -negative
                break
            value = -negative
            if used is None:
                at = self._open(path, at, value)
                used = {int(path[at])}
            path = self._other(path, at, used, value, grow, len(found))
            found.append((path, value))
        out = []
        for path, _ in found:
            logp = float(self.lattices.logq[path].sum())
            x = logp - limit
            out.append((path, logp, 0.0 if x > 3.5 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))))
        return out

    def _open(self, path: np.ndarray, since: int, value: float) -> int:
        """The step at which the best of a shared entry branches off; the other steps are queued under it."""
        logq = self.lattices.logq[path]
        prefix = np.append(0, np.cumsum(logq))
        with np.errstate(divide="ignore"):
            mass = prefix[since:-1] + np.log(-np.expm1(logq[since:]))
        best = int(np.argmax(mass + gumbel(self._u(len(mass)))))
        bounds = below(mass, value, self._u(len(mass)))
        for k in np.argsort(-bounds)[: self.k + 1].tolist():
            if k != best and mass[k] > -np.inf:
                self._push(float(bounds[k]), path, since + k, {int(path[since + k])})
        return since + best

    def _other(self, path: np.ndarray, at: int, used: set[int], value: float, grow, turn: int) -> np.ndarray:
        """Another way on at a step, sampled to the end; what is left there is queued again."""
        lattices, edge = self.lattices, int(path[at])
        node = int(np.searchsorted(lattices.node_edges, edge, side="right")) - 1
        choices = np.array([e for e in range(lattices.node_edges[node], lattices.node_edges[node + 1]) if e not in used])
        pick = int(choices[np.argmax(lattices.logq[choices] + gumbel(self._u(len(choices))))])
        new = grow(path[:at], pick, turn)
        rest = choices[choices != pick]
        if len(rest):
            mass = float(lattices.logq[path[:at]].sum() + np.logaddexp.reduce(lattices.logq[rest]))
            self._push(float(below(mass, value, self._u())[0]), path, at, used | {pick})
        self.add(new, value, at + 1)
        return new


def sample(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k (ids, log-probability, log-probability of inclusion)."""
    split = pa.compute.split_pattern(pa.array(texts, pa.large_string()), " ")
    sizes = split.value_lengths().to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    part = words.indices.to_numpy().astype(np.int64)
    lattices = Lattices(vocabulary, [SPACE_MARK + p for p in words.dictionary.to_numpy(zero_copy_only=False).tolist()])
    by_part = np.argsort(part, kind="stable")
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    index = np.arange(len(part)) - begin[owner]
    ways = []
    for turn in range(k):
        noise = mix_on(mix_head(mix(keys, turn + 1))[owner], index.astype(np.uint64))
        ways.append(fresh(lattices, part, noise, by_part))
    ends = [np.append(0, np.cumsum(counts)) for _, counts in ways]
    out = []
    for d in range(len(texts)):
        a, b = int(begin[d]), int(begin[d] + sizes[d])

        def grow(prefix: np.ndarray, edge: int, turn: int, a: int = a, b: int = b, d: int = d) -> np.ndarray:
            # the part that the edge stands in is sampled to its end, later parts anew
            done = int((lattices.next[prefix] < 0).sum()) if len(prefix) else 0
            rest, node, step = [edge], int(lattices.next[edge]), 0
            noise = mix(mix(keys[d : d + 1], turn + 101), done)
            while node >= 0:
                rest.append(int(lattices.choose(np.array([node]), uniform(noise, step))[0]))
                node, step = int(lattices.next[rest[-1]]), step + 1
            edges, at = ways[turn][0], ends[turn]
            return np.concatenate([prefix, np.array(rest), edges[at[a + done + 1] : at[b]]])

        search = Search(lattices, part[a:b], int(keys[d]), k)
        first = ways[0][0][ends[0][a] : ends[0][b]]
        rows = []
        for path, logp, inclusion in search.run(first, grow):
            rows.append((lattices.ids(path), logp, inclusion))
        out.append(rows)
    return out


SAMPLES = pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())]))
SCHEMA = "array<struct<ids: array<int>, log_prob: double, log_inclusion: double>>"


def _sampler(path: str, k: int, seed: int):
    def encode(keys: pa.Array, texts: pa.Array) -> pa.Array:
        vocabulary = per_process(f"vocabulary {path}", lambda: Vocabulary(path))
        batch = pa.RecordBatch.from_arrays([keys.fill_null(-(2**63)), texts.fill_null("")], ["key", "text"])
        pieces = []
        for rows in slices(iter([batch]), "text", 2 << 20):
            hashed = mix(rows.column("key").to_numpy(zero_copy_only=False).view(np.uint64), seed)
            found = sample(vocabulary, rows.column("text").to_pylist(), hashed, k)
            flat = [x for doc in found for x in doc]
            counts = np.array([len(x[0]) for x in flat])
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(np.concatenate([x[0] for x in flat]), pa.int32()))
            rows_of = pa.StructArray.from_arrays([ids, pa.array([x[1] for x in flat]), pa.array([x[2] for x in flat])], ["ids", "log_prob", "log_inclusion"])
            pieces.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(doc) for doc in found])), pa.int32()), rows_of))
        return pa.concat_arrays(pieces) if pieces else pa.array([], SAMPLES)

    return encode


def encode(key: Column, text: Column, vocabulary: str, k: int = 2, seed: int = 0) -> Column:
    """Up to ``k`` distinct segmentations of a text: ids, log_prob and log_inclusion, best first.

    log_inclusion is the log-probability that such a draw holds the
    segmentation at all. A text that has fewer than k segmentations gives all
    of them, with log_inclusion 0. Null and empty texts have the one of the
    leading mark. Equal key and text give equal samples; a null key counts as
    the least.
    """
    return F.arrow_udf(_sampler(vocabulary, k, seed), SCHEMA)(key.cast("long"), text)


def _decoder(path: str):
    def texts(ids: pa.Array) -> pa.Array:
        vocabulary = per_process(f"vocabulary {path}", lambda: Vocabulary(path))
        return pa.array([None if x is None else vocabulary.decode(x) for x in ids.to_pylist()], pa.string())

    return texts


def decode(ids: Column, vocabulary: str) -> Column:
    """The text of a column of ids; null stays null."""
    return F.arrow_udf(_decoder(vocabulary), "string")(ids)


def with_samples(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, seed: int = 0, result: str = "samples") -> DataFrame:
    """All columns of ``docs`` and the samples of each text as ``result`` (a column of that name is replaced)."""
    return docs.withColumn(result, encode(F.col(id_col), F.col(text_col), vocabulary, k, seed))
