"""SentencePiece segmentations: Gumbel top-k without replacement over the lattice, and decoding.

The lattice of a text has an arc for every vocabulary piece that fits, and byte pieces for characters
the vocabulary lacks. The vocabulary is of merges, without probabilities: a piece weighs one over its
rank, raised to ``alpha``, so a segmentation's probability is the product of its pieces' weights over
the lattice's total. Wherever two neighbouring characters stand together in no piece, every segmentation
has a border; cut there, the lattice is a chain of small units, each built once.

Search is over perturbed maxima. The root, all segmentations, draws a Gumbel value; the path that
attains it is drawn from the posterior, arc by arc. At every arc of a found path the segmentations that
agree before it and differ there form a branch, whose maximum is a Gumbel value truncated at the path's
own. The best branch of all is expanded next, so segmentations come in the order of their perturbed
log-probability, all distinct, exactly as the top k of one perturbation of the whole lattice. The next
branch's value is the threshold behind the inclusion scores. All random numbers are hashes of the row
key, so a row's result depends neither on its neighbours nor on the partitioning.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.text import Lookup, bounded_batches, chunks, frugal, mix, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LONGEST = "▁", 16
#: Branches of less than exp(-DEEP) of the mass are worked out only where no other is left.
DEEP = 80.0
#: Arcs kept for reuse; beyond that the distinct units are built anew.
KEPT_ARCS = 3_000_000
#: Units of at most so many characters are built together; their weights cannot underflow.
TOGETHER = 60
_CHAR = 0x9FB21C651E98DF25
_STEP, _ROUND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def string_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _CHAR + ord(c) + 1) & (2**64 - 1)
    return int(mix(np.array([h], np.uint64))[0])


class Vocabulary:
    """Pieces of a model file with their ids, weights and bytes; small and of fixed size."""

    def __init__(self, path: str = MODEL, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids, self.weights, self.bytes, self.byte_ids = {}, [0.0] * self.size, [b""] * self.size, [0] * 256
        for i in range(self.size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
                self.weights[i] = (0.5 / self.size) ** alpha
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[name.replace(SPACE, " ")] = i
                self.bytes[i], self.weights[i] = name.replace(SPACE, " ").encode(), 1.0 / (i - 256) ** alpha
        self.prefixes = {p[:j] for p in self.ids for j in range(1, len(p) + 1)}
        names = sorted(self.prefixes)
        keys = np.array([string_hash(x) for x in names], np.uint64)
        pieces = np.array([self.ids.get(x, -1) for x in names], float)
        self.table = Lookup.of(keys, pieces[:, None])
        self.weight = np.array(self.weights)
        # characters by number, and which of them follow each other in some piece; 0: in no longer piece
        chars = sorted({c for p in self.ids if len(p) > 1 for c in p})
        self.char = np.zeros(0x110000, np.uint16)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        number = {c: i for i, c in enumerate(chars, 1)}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self.together[number[a], number[b]] = True


class Lattices:
    """The lattices of distinct units, in flat arrays: nodes with their incoming arcs.

    An arc has its probability given its end, its piece (or a number past the vocabulary for a
    character that only bytes spell), and the node where it begins (-1: the unit's start).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.spelled: dict[str, int] = {}
        self.spelling: list[list[int]] = []
        self.reset()

    def reset(self) -> None:
        self.ends: dict[int, int] = {}
        self.first, self.number = array("i"), array("i")
        self.p, self.upto, self.piece, self.start, self.node = array("d"), array("d"), array("i"), array("i"), array("i")

    def fallback(self, char: str) -> int:
        """The arc of a character without a piece; all segmentations take it, so it needs no weight."""
        raw = char.encode("utf-8", "surrogateescape")
        if len(raw) == 1:
            return self.v.byte_ids[raw[0]]
        if char not in self.spelled:
            self.spelled[char] = self.v.size + len(self.spelling)
            self.spelling.append([self.v.byte_ids[b] for b in raw])
        return self.spelled[char]

    def add_all(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Builds the lattices of short units together, all arcs by length, then all nodes by depth; the last nodes."""
        base, v = len(self.first), self.v
        codes = codes.astype(np.uint64)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        stop, begin = ends[owner], (ends - lengths)[owner]
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for size in range(1, LONGEST + 1):
            inside = at + size <= stop[at]
            at, h = at[inside], h[inside] * np.uint64(_CHAR) + codes[at[inside] + size - 1] + np.uint64(1)
            slot, known = v.table.find(mix(h))
            piece = v.table.values[slot, 0]
            full = known & (piece >= 0)
            found.append((at[full], np.full(full.sum(), size), piece[full].astype(np.int64)))
            if size == 1:
                bare = at[~full]
            at, h = at[known], h[known]
        spelled = [self.fallback(chr(c)) for c in codes[bare].tolist()]
        found.append((bare, np.ones(len(bare), np.int64), np.array(spelled, np.int64)))
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        node = start + size - 1
        order = np.lexsort((start, node))
        start, node, piece = start[order], node[order], piece[order]
        weight = np.ones(len(piece))
        real = piece < v.size
        real[np.isin(start, bare)] = False
        weight[real] = v.weight[piece[real]]
        depth, total, reached = (node - begin[node]), np.zeros(len(codes)), np.zeros(len(piece))
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
        for d in range(depth.max() + 1):
            arcs = by_depth[cuts[d] : cuts[d + 1]]
            s = start[arcs]
            reached[arcs] = weight[arcs] * np.where(s == begin[s], 1.0, total[s - 1])
            np.add.at(total, node[arcs], reached[arcs])
        p = reached / total[node]
        first = np.searchsorted(node, np.arange(len(codes)))
        number = np.diff(np.append(first, len(node)))
        rank, upto = np.arange(len(node)) - first[node], p.copy()
        for r in range(1, number.max()):
            late = np.flatnonzero(rank == r)
            upto[late] += upto[late - 1]
        upto[first + number - 1] = 2.0
        old = len(self.p)
        for held, new in ((self.first, first + old), (self.number, number), (self.piece, piece), (self.start, np.where(start == begin[start], -1, base + start - 1)), (self.node, node + base)):
            held.frombytes(new.astype(np.int32).tobytes())
        self.p.frombytes(p.tobytes())
        self.upto.frombytes(upto.tobytes())
        return ends - 1 + base

    def add(self, unit: str) -> int:
        """Builds the lattice of one unit of any length; its last node."""
        n, base = len(unit), len(self.first)
        ids, weights, prefixes = self.v.ids, self.v.weights, self.v.prefixes
        total, into = [1.0] + [0.0] * n, [[] for _ in range(n + 1)]
        for i in range(n):
            a = total[i]
            if a < 1e-150:  # only ratios matter: lift all that later nodes are built from
                for j in range(i, min(n, i + LONGEST) + 1):
                    total[j] *= 1e150
                    into[j] = [(s, x, w * 1e150) for s, x, w in into[j]]
                a = total[i]
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                part = unit[i:j]
                if part not in prefixes:
                    break
                x = ids.get(part)
                if x is not None:
                    w = a * weights[x]
                    total[j] += w
                    into[j].append((i, x, w))
            if unit[i] not in ids:
                total[i + 1] += a
                into[i + 1].append((i, self.fallback(unit[i]), a))
        for j in range(1, n + 1):
            self.first.append(len(self.p))
            self.number.append(len(into[j]))
            upto, whole = 0.0, sum(w for _, _, w in into[j])
            for s, x, w in into[j]:
                upto += w / whole
                self.p.append(w / whole)
                self.upto.append(upto)
                self.piece.append(x)
                self.start.append(base + s - 1 if s else -1)
                self.node.append(base + j - 1)
            self.upto[-1] = 2.0
        return base + n - 1

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The last node of every unit, and where each text's units begin; an empty text has none."""
        if len(self.p) > KEPT_ARCS:
            self.reset()
        spaced = [" " + t if t else t for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
        codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, new = self.v.char[codes], np.ones(len(codes) + 1, bool)
        new[1:-1] = ~self.v.together[chars[:-1], chars[1:]]
        new[bounds] = True
        edges = np.flatnonzero(new) if len(codes) else np.zeros(1, np.int64)
        starts, ends = edges[:-1], edges[1:]
        key, first, inverse = np.unique(span_hash(codes.astype(np.uint64) + np.uint64(1), starts, ends), return_index=True, return_inverse=True)
        nodes = np.array([self.ends.get(k, -1) for k in key.tolist()], np.int64)
        fresh = np.flatnonzero(nodes < 0)
        begin, length = starts[first[fresh]], (ends - starts)[first[fresh]]
        short = length <= TOGETHER
        if short.any():
            nodes[fresh[short]] = self.add_all(codes[ranges(begin[short], length[short])], length[short])
        for i in np.flatnonzero(~short):
            nodes[fresh[i]] = self.add(codes[begin[i] : begin[i] + length[i]].tobytes().decode("utf-32-le", "surrogatepass"))
        self.ends.update(zip(key[fresh].tolist(), nodes[fresh].tolist(), strict=True))
        return nodes[inverse], np.searchsorted(starts, bounds)

    def view(self) -> Arcs:
        return Arcs(self)


class Arcs:
    """The lattices' arrays as they stand; to be dropped before units are added."""

    def __init__(self, of: Lattices):
        self.first, self.number = np.frombuffer(of.first, np.int32), np.frombuffer(of.number, np.int32)
        self.p, self.upto = np.frombuffer(of.p), np.frombuffer(of.upto)
        self.piece, self.start, self.node = (np.frombuffer(x, np.int32) for x in (of.piece, of.start, of.node))

    def sample(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A path back from each node (-1: none), drawn by its key: the arcs of each, and how many."""
        counts, found = np.zeros(len(nodes), np.int64), []
        at = np.flatnonzero(nodes >= 0)
        now, step = nodes[at], np.uint64(0)
        while len(at):
            draw = uniform(keys[at] + np.array([step]) * _STEP)
            arc = self.first[now]
            left = np.flatnonzero(draw > self.upto[arc])
            while len(left):
                arc[left] += 1
                left = left[draw[left] > self.upto[arc[left]]]
            found.append((at, arc))
            counts[at] += 1
            now = self.start[arc]
            on = now >= 0
            at, now, step = at[on], now[on], step + np.uint64(1)
        offset = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int64)
        for k, (at, arc) in enumerate(found):
            out[offset[at] + k] = arc
        return out, counts


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) by hashing."""
    return ((mix(x) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of [start, start + count) in turn."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Path:
    """One found segmentation of every text of a chunk: arcs in order of units, from each unit's end back."""

    def __init__(self, arcs: Arcs, flat: np.ndarray, counts: np.ndarray, units: np.ndarray, top: np.ndarray, keys: np.ndarray, fresh: np.ndarray | None = None):
        self.flat, self.counts, self.top = flat, counts, top
        self.unit_at = np.concatenate([[0], np.cumsum(counts)])
        self.text_at = self.unit_at[units]
        n = np.diff(self.text_at)
        self.arcs, self.keys, self.fresh = arcs, keys, fresh
        before = np.concatenate([[0.0], np.cumsum(np.log(arcs.p[flat]))])
        self.before = before[:-1] - np.repeat(before[self.text_at[:-1]], n)
        self.log_prob = before[self.text_at[1:]] - before[self.text_at[:-1]]
        self.cost = np.full(len(flat), np.inf)
        self.fill(self.before >= -DEEP)

    def fill(self, which: np.ndarray) -> None:
        """Costs of the branches at some arcs; a branch's value falls as its cost rises."""
        at = np.flatnonzero(which)
        owner = np.searchsorted(self.text_at, at, "right") - 1
        place = at - self.text_at[owner]
        if self.fresh is not None:  # what lies before the arc that made this path belongs to the path it left
            open_ = place > self.fresh[owner]
            at, owner, place = at[open_], owner[open_], place[open_]
        arc = self.flat[at]
        rest = np.maximum(1 - self.arcs.p[arc], 0.0)
        rest[self.arcs.number[self.arcs.node[arc]] == 1] = 0.0
        draw = -np.log(uniform(self.keys[owner] + (place.astype(np.uint64) + np.uint64(1)) * _ROUND))
        with np.errstate(divide="ignore"):
            self.cost[at] = np.log(draw) - (self.before[at] + np.log(rest))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Each text's best branch and its place in ``flat``; -inf where there is none."""
        n = np.diff(self.text_at)
        least, place = np.full(len(n), np.inf), np.zeros(len(n), np.int64)
        full = np.flatnonzero(n)
        if len(full):
            least[full] = np.minimum.reduceat(self.cost, self.text_at[:-1][full])
            # a draw's logarithm is over -38, so no branch as deep as DEEP costs less than DEEP - 38
            if (least[full] > DEEP - 38).any() and (deep := self.before < -DEEP).any():
                unsure = np.repeat(least > DEEP - 38, n) & deep & np.isinf(self.cost)
                if unsure.any():
                    self.fill(unsure)
                    least[full] = np.minimum.reduceat(self.cost, self.text_at[:-1][full])
            hit = np.flatnonzero(self.cost == np.repeat(least, n))
            owner = np.searchsorted(self.text_at, hit, "right") - 1
            place[owner[::-1]] = hit[::-1]
        with np.errstate(invalid="ignore"):
            return np.where(np.isinf(least), -np.inf, -np.logaddexp(-self.top, least)), place


def truncated(location: np.ndarray, top: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Gumbel values at the locations, conditioned to lie below ``top``, from exponential draws."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(location), -np.inf, -np.logaddexp(-top, np.log(draw) - location))


def top_k(arcs: Arcs, nodes: np.ndarray, units: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[Path], list[np.ndarray], np.ndarray]:
    """The k best perturbed segmentations of each text, which texts have a j-th, and the next value."""
    n = len(units) - 1
    owner = np.repeat(np.arange(n), np.diff(units))
    place = np.arange(len(nodes)) - units[:-1][owner]
    unit_keys = mix(keys[owner] + place.astype(np.uint64) * _ROUND)
    flat, counts = arcs.sample(nodes, unit_keys)
    paths = [Path(arcs, flat, counts, units, -np.log(-np.log(uniform(keys ^ _STEP))), mix(keys ^ np.uint64(1)))]
    there, excluded = [np.ones(n, bool)], {}
    for j in range(1, k + 1):
        values, places = zip(*[p.best() for p in paths], strict=True)
        source = np.argmax(np.stack(values), axis=0)
        top = np.stack(values)[source, np.arange(n)]
        if j == k:
            return paths, there, top
        exists = ~np.isneginf(top)
        there.append(exists)
        salt = mix(keys ^ np.uint64(1000 + j))
        # the branch arc of each text: its path, unit and place, and the arc taken instead
        cut_unit, cut_step, new_arc, fresh = units[1:].copy(), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        draws = uniform(salt)
        for i in np.flatnonzero(exists).tolist():
            s = int(source[i])
            path, at = paths[s], int(places[s][i])
            old = int(path.flat[at])
            node = arcs.node[old]
            some = range(int(arcs.first[node]), int(arcs.first[node] + arcs.number[node]))
            out = excluded.setdefault((i, s, at), {old})
            open_ = [a for a in some if a not in out]
            mass = sum(arcs.p[a] for a in open_)
            target, chosen = draws[i] * mass, open_[-1]
            for a in open_:
                target -= arcs.p[a]
                if target <= 0:
                    chosen = a
                    break
            out.add(chosen)
            remaining = sum(arcs.p[a] for a in open_ if a != chosen)
            location = np.array([path.before[at] + (np.log(remaining) if remaining > 0 else -np.inf)])
            value = truncated(location, top[i : i + 1], -np.log(uniform(salt[i : i + 1] + _STEP)))[0]
            path.cost[at] = np.inf if np.isneginf(value) else -value + np.log1p(-np.exp(value - path.top[i]))
            unit = int(np.searchsorted(path.unit_at, at, "right")) - 1
            cut_unit[i], cut_step[i], new_arc[i], fresh[i] = unit, at - path.unit_at[unit], chosen, at - path.text_at[i]
        # draw on: from the new arc's start within its unit, and whole units behind it
        start = np.full(len(nodes), -1, np.int64)
        index = np.arange(len(nodes))
        later = index > cut_unit[owner]
        start[later] = nodes[later]
        cut = np.flatnonzero(exists)
        start[cut_unit[cut]] = arcs.start[new_arc[cut]]
        more, more_counts = arcs.sample(start, mix(unit_keys ^ np.uint64(7919 * j)))
        # units before the cut come from the source path, the cut unit keeps its first steps
        kept = np.zeros(len(nodes), np.int64)
        kept_from = np.zeros(len(nodes), np.int64)
        for s, path in enumerate(paths):
            mine = exists[owner] & (source[owner] == s)
            early = mine & (index < cut_unit[owner])
            kept[early], kept_from[early] = path.counts[early], path.unit_at[:-1][early]
            here = cut[source[cut] == s]
            kept[cut_unit[here]], kept_from[cut_unit[here]] = cut_step[here], path.unit_at[:-1][cut_unit[here]]
        extra = np.zeros(len(nodes), np.int64)
        extra[cut_unit[cut]] = 1
        counts = kept + extra + more_counts
        at = np.cumsum(counts) - counts
        flat = np.empty(counts.sum(), np.int64)
        for s, path in enumerate(paths):
            mine = np.flatnonzero((source[owner] == s) & (kept > 0))
            flat[ranges(at[mine], kept[mine])] = path.flat[ranges(kept_from[mine], kept[mine])]
        flat[(at + kept)[cut_unit[cut]]] = new_arc[cut]
        flat[ranges(at + kept + extra, more_counts)] = more
        paths.append(Path(arcs, flat, counts, units, np.where(exists, top, -np.inf), salt, fresh))
    raise AssertionError("k is at least 1")


def forward(path: Path) -> np.ndarray:
    """Places of a path's arcs in reading order: units in turn, each from its start."""
    ends = np.repeat(path.unit_at[1:], path.counts)
    starts = np.repeat(path.unit_at[:-1], path.counts)
    return starts + ends - 1 - np.arange(len(path.flat))


class Speller:
    """Ids and bytes of pieces and spelled characters, as tables."""

    def __init__(self, lattices: Lattices):
        v = lattices.v
        spelled = [b"".join(v.bytes[b] for b in x) for x in lattices.spelling]
        every = [*v.bytes, *spelled]
        self.lengths = np.array([len(b) for b in every])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(every), np.uint8)
        ids = [[i] for i in range(v.size)] + lattices.spelling
        self.n_ids = np.array([len(x) for x in ids])
        self.id_at = np.cumsum(self.n_ids) - self.n_ids
        self.ids = np.array([i for x in ids for i in x], np.int32)

    def expand(self, pieces: np.ndarray) -> np.ndarray:
        n = self.n_ids[pieces]
        return self.ids[ranges(self.id_at[pieces], n)]

    def text(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        return self.data[ranges(self.offsets[ids], n)]


def row_keys(ids: pa.Array, texts: list[bytes], seed: int) -> np.ndarray:
    """The key of each row: its doc_id and its text's hash."""
    number = np.array([0 if i is None else i for i in ids.to_pylist()], np.int64).view(np.uint64)
    return mix(mix(number + np.uint64(seed)) ^ np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64))


def sampled(docs: DataFrame, k: int = 2, seed: int = 1, alpha: float = 1.0, path: str = MODEL, with_ids: bool = True) -> DataFrame:
    """(doc_id, sample, n_pieces, log_prob, perturbed, inclusion, log_inclusion, ids, ids_hash, decoded_equal) per row and sample.

    log_prob is the natural logarithm of the segmentation's probability in the lattice; inclusion is
    the probability that a draw of k holds it, given the threshold; decoded_equal tells whether the
    ids decode to the text. A text with fewer than k segmentations has a row for each (inclusion 1);
    null and empty texts have the empty one. Every text is taken whole and spells back exactly, also
    one that holds the vocabulary's space mark. Repeated rows repeat their result; a null doc_id is kept and draws as
    0 does. Segmentations of equal perturbed value come in the order in which they are found. Extra columns
    are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared.value)
        speller = Speller(lattices)
        for batch in batches:
            for part, data, texts in chunks(batch):
                raw = data.tobytes()
                cut = [raw[a:b] for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True)]
                doc_ids = batch.column("doc_id")[part.start : part.stop]
                nodes, units = lattices.units([x.decode("utf-8", "surrogateescape") for x in cut])
                if len(speller.n_ids) < shared.value.size + len(lattices.spelling):
                    speller = Speller(lattices)
                arcs = lattices.view()
                paths, there, threshold = top_k(arcs, nodes, units, row_keys(doc_ids, cut, seed), k)
                for j, (found, exists) in enumerate(zip(paths, there, strict=True)):
                    pieces = arcs.piece[found.flat[forward(found)]]
                    n_ids = speller.n_ids[pieces]
                    total = np.concatenate([[0], np.cumsum(n_ids)])[found.text_at]
                    ids = speller.expand(pieces)
                    bytes_at = np.concatenate([[0], np.cumsum(speller.lengths[ids])])[total]
                    spelled = speller.text(ids).tobytes()
                    rows = np.flatnonzero(exists)
                    equal = [spelled[bytes_at[i] : bytes_at[i + 1]] == (b" " + cut[i] if cut[i] else b"") for i in rows]
                    hashes = np.array([xxhash.xxh64_intdigest(ids[total[i] : total[i + 1]].tobytes()) for i in rows], np.uint64)
                    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                        excess = np.where(np.isneginf(threshold), np.inf, found.log_prob - threshold)
                        included = -np.expm1(-np.exp(np.minimum(excess, 700)))
                        log_included = np.where(excess > -30, np.log(included), excess)  # the chance itself may be too small for a double
                    columns = [doc_ids.take(pa.array(rows)), pa.array(np.full(len(rows), j + 1, np.int32)), pa.array(np.diff(total)[rows]), pa.array(found.log_prob[rows]), pa.array(found.top[rows]), pa.array(included[rows]), pa.array(log_included[rows])]
                    if with_ids:
                        lengths = np.diff(total)[rows]
                        columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(ids[ranges(total[rows], lengths)])))
                    yield pa.record_batch([*columns, pa.array(hashes.view(np.int64)), pa.array(equal, pa.bool_())], names)
                del arcs, paths, found

    kinds = {"doc_id": "long", "sample": "int", "n_pieces": "long", "log_prob": "double", "perturbed": "double", "inclusion": "double", "log_inclusion": "double"} | ({"ids": "array<int>"} if with_ids else {}) | {"ids_hash": "long", "decoded_equal": "boolean"}
    names = list(kinds)
    return docs.select("doc_id", "text").mapInArrow(frugal(run), ", ".join(f"{a} {b}" for a, b in kinds.items()))


def decoded(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """``encoded`` with a text column spelled from ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))
    names = [*[c for c in encoded.columns if c != "text"], "text"]
    kept = encoded.select(*names[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value.bytes
        for batch in batches:
            texts = [None if ids is None else b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace")[1:] for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names)

    from pyspark.sql import types as T

    return kept.mapInArrow(frugal(run), T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))
