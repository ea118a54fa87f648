"""SentencePiece encoding and decoding by a batched numpy Viterbi over a public vocabulary.

A text is escaped as the vocabulary's model does (a space in front, spaces as U+2581)
and cut in front of each run of spaces; no piece of a supported vocabulary crosses
such a cut, so the units are segmented on their own and each distinct unit once.
Units advance together, those of equal length to the same end: the hashes of all their
substrings of up to the longest piece's length probe the sorted piece keys, and a
vectorised maximum over the piece lengths stores the back-pointers.

What is maximised is the model's own criterion. For a unigram model it is the sum of the
pieces' scores, ties going to the longer last piece. The scores of a model trained by
merges are ranks, no likelihoods, and may not be summed; there a step is worth nothing
if merging in the order of ranks would have kept its piece and the one before it apart,
and is impossible otherwise. Neighbours that could stay apart make a whole sequence
that merging leaves, and there is exactly one, so the path is the library's result.

A unit of more than LONG characters is cut into overlapping windows that advance as units
of their own; two windows are joined where both have a boundary and the pieces at it
stay apart. Runs of spaces, whose pieces all rank last and alike, are merged from the
left after everything else.

Characters without a piece become byte pieces, and so does U+2581 itself, so that
decoding gives back every text exactly; this is the one difference from the library,
which reads U+2581 as a space. Piece keys are 64-bit hashes; decoding every result
(column exact) would show a collision.

The vocabulary's file stays where it is; its path is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.arrays import mixed, tidy
from millrace.llm.session import documents, small_batches, table

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Stands for a literal U+2581 while units are cut: a lone surrogate, which no text in UTF-8 holds.
HELD = "\udfff"
ROOT = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Below the worst piece: what a character without a piece scores.
UNKNOWN_PENALTY = 10.0
FILTER_BITS = 20
#: Characters of units that advance together.
CELLS = 1 << 17
#: Characters of a window of a longer unit, and of its overlap with the next.
LONG, OVERLAP = 512, 64
#: Distinct units that a task remembers at least; it holds twice as many at most.
REMEMBERED = 60_000
#: Above every rank.
NEVER = np.int64(1) << np.int64(40)


class Keys:
    """Sorted 64-bit keys; their leading bits say where a key would stand, and the few keys that begin alike are compared."""

    def __init__(self, keys: np.ndarray):
        slot = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        filled = np.bincount(slot, minlength=1 << FILTER_BITS)
        self.filter = filled > 0
        self.first = (np.cumsum(filled) - filled).astype(np.int32)
        self.crowd = int(filled.max())
        self.padded = np.append(keys, np.zeros(self.crowd, np.uint64))
        self.count = len(keys)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of keys are among these, and their places."""
        slot = keys >> np.uint64(64 - FILTER_BITS)
        likely = np.flatnonzero(self.filter.take(slot))
        probe = keys.reshape(-1)[likely]
        at = self.first.take(slot.reshape(-1)[likely])
        where, found = [], []
        for i in range(self.crowd):
            hit = self.padded.take(at + i) == probe
            where.append(likely[hit])
            found.append(at[hit] + i)
        return np.concatenate(where), np.concatenate(found)


@dataclass
class Merges:
    """The order of merges by rank, single characters first; left and right are what a rank was merged from."""

    singles: int
    left: np.ndarray
    right: np.ndarray

    def __post_init__(self):
        ranks = np.arange(self.singles, len(self.left))
        pairs = self.key(self.left[ranks], self.right[ranks])
        order = np.argsort(pairs)
        self.pairs, self.rank_at = Keys(pairs[order]), ranks[order]

    @staticmethod
    def key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the neighbours a and b (ranks; -1: a character without a piece) as they are.

        The later of the two merges is undone, again and again; if what then meets across
        the boundary would have been merged before it, the two can't both have come about.
        """
        out = (a < 0) | (b < 0)
        at = np.flatnonzero(~out)
        a, b = a[at], b[at]
        limit = np.full(len(at), NEVER)
        while len(at):
            merged = np.full(len(at), NEVER)
            where, found = self.pairs.probe(self.key(a, b))
            merged[where] = self.rank_at[found]
            single = (a < self.singles) & (b < self.singles)
            fine = merged >= limit
            out[at[fine & single]] = True
            on = fine & ~single
            at, a, b = at[on], a[on], b[on]
            later = a > b
            limit = np.where(later, a, b + 1)  # of equal ranks the left one is merged first
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out


@dataclass
class Vocabulary:
    """Sorted keys of the pieces with their ids and scores or ranks, and the bytes of every id."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    ranks: np.ndarray
    merges: Merges | None
    surfaces: list[bytes]
    byte_ids: list[int]
    space_runs: list[list[int]]
    longest: int
    unknown: float

    def __post_init__(self):
        self.table = Keys(self.keys)
        self.scores_or_none = np.append(self.scores, -np.inf)
        self.ranks_or_none = np.append(self.ranks, -1)
        self.ids_or_none = np.append(self.ids, -1).astype(np.int32)


def key_of(code_points: np.ndarray) -> np.ndarray:
    """The keys of equally long strings, a row of code points each."""
    h = np.zeros(len(code_points), np.uint64)
    for column in code_points.T:
        h = h * ROOT + column.astype(np.uint64) + np.uint64(1)
    return (h + np.uint64(code_points.shape[1])) * SPREAD


def merged_symbols(text: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str]]:
    """The symbols that merging text's characters in the order of ranks leaves, and the last pair merged."""
    symbols, last = list(text), ("", "")
    while True:
        best = min(((rank.get(a + b, len(rank)), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(len(rank), 0))
        if best[0] == len(rank):
            return symbols, last
        i = best[1]
        last = (symbols[i], symbols[i + 1])
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read a model file on the driver: a unigram model or one trained by merges, with the identity normaliser and byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
        raise ValueError("the model normalises texts, so they can't be decoded exactly")
    if model.trainer_spec.model_type not in (1, 2):
        raise ValueError("the model has neither unigram scores nor ranks of merges")
    by_merges = model.trainer_spec.model_type == 2
    pieces = model.pieces
    if any(p.type == 4 for p in pieces):
        raise ValueError("pieces that are cut out before all others aren't supported")
    normal = [i for i, p in enumerate(pieces) if p.type == 1]
    if any(SPACE in pieces[i].piece.lstrip(SPACE) for i in normal):
        raise ValueError("a piece crosses words")
    place = {pieces[i].piece: i for i in normal}
    space_runs, merges, rank = [], None, {}
    if by_merges:
        alike = {x: 0 for x in place if not x.strip(SPACE) and x != SPACE}
        most = max((len(x) for x in alike if len(merged_symbols(x, alike)[0]) == 1), default=1)
        space_runs = [[place[x] for x in merged_symbols(SPACE * k, alike)[0]] for k in range(most + 1)]  # ids of runs of 0, 1, ... spaces
        if any(set(pieces[i].piece[:2]) == {SPACE} and len(pieces[i].piece) > 1 and pieces[i].piece.strip(SPACE) for i in normal):
            raise ValueError("a piece joins several spaces with a word")
        normal = [i for i in normal if pieces[i].piece == SPACE or pieces[i].piece.strip(SPACE)]
        singles = sorted((i for i in normal if len(pieces[i].piece) == 1), key=lambda i: pieces[i].piece)
        longer = sorted((i for i in normal if len(pieces[i].piece) > 1), key=lambda i: -pieces[i].score)
        if len({pieces[i].score for i in longer}) < len(longer) or any(c not in place for i in longer for c in pieces[i].piece):
            raise ValueError("merges of equal rank, or of characters that aren't pieces")
        order = {pieces[i].piece: k for k, i in enumerate(longer)}
        made = [(pieces[i].piece, merged_symbols(pieces[i].piece, order)) for i in longer]
        reached = [(piece, last) for piece, (symbols, last) in made if len(symbols) == 1]
        rank = {pieces[i].piece: k for k, i in enumerate(singles)}
        rank |= {piece: len(singles) + k for k, (piece, _) in enumerate(reached)}
        own = np.arange(len(singles))
        merges = Merges(len(singles), np.concatenate([own, [rank[a] for _, (a, _) in reached]]).astype(np.int64), np.concatenate([own, [rank[b] for _, (_, b) in reached]]).astype(np.int64))
        normal = [i for i in normal if pieces[i].piece in rank]  # merging never gives the others
    keys, ids = [], []
    for n in sorted({len(pieces[i].piece) for i in normal}):
        own = [i for i in normal if len(pieces[i].piece) == n]
        keys.append(key_of(np.array([[ord(c) for c in pieces[i].piece] for i in own])))
        ids += own
    joined = np.concatenate(keys)
    order = np.argsort(joined)
    scores = np.array([pieces[i].score for i in ids])
    ranks = np.array([rank.get(pieces[i].piece, -1) for i in ids], np.int64)
    byte_ids = [0] * 256
    surfaces = []
    for i, p in enumerate(pieces):
        if p.type == 6:
            byte = int(p.piece[3:5], 16)
            byte_ids[byte] = i
            surfaces.append(bytes([byte]))
        else:
            surfaces.append(b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode())
    if not all(byte_ids):
        raise ValueError("the model has no byte pieces")
    return Vocabulary(joined[order], np.array(ids)[order], scores[order], ranks[order], merges, surfaces, byte_ids, space_runs, max(len(pieces[i].piece) for i in normal), float(scores.min()) - UNKNOWN_PENALTY)


Path = tuple[np.ndarray, np.ndarray]  # where a unit's pieces start, and their places among the sorted keys


def batches(units: list[str], v: Vocabulary) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Units that advance together: their numbers, the edges of their paths, and all paths' starts and places end to end."""
    lengths = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        own = order[at : at + max(1, CELLS // int(lengths[order[at]]))]
        at += len(own)
        numbers = own.tolist()
        yield numbers, *_advance([units[i] for i in numbers], lengths[own], v)


def paths(units: list[str], v: Vocabulary) -> list[Path]:
    """The best path of each unit."""
    out: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(units)
    for numbers, edges, starts, places in batches(units, v):
        for i, a, b in zip(numbers, edges[:-1], edges[1:]):
            out[i] = (starts[a:b], places[a:b])
    return out


def _advance(units: list[str], lengths: np.ndarray, v: Vocabulary) -> tuple[list[int], np.ndarray, np.ndarray]:
    """lengths descend; at step j the units of j characters at least are a slice in front."""
    m, n = len(units), int(lengths[0])
    flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.zeros((n, m), np.uint64)  # a step reads one row
    column = np.repeat(np.arange(m), lengths)
    points[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), column] = flat
    active = np.searchsorted(-lengths, -np.arange(n + 1), "right")  # units of j characters at least
    prefix = np.zeros((n + 1, m), np.uint64)
    for i in range(n):
        prefix[i + 1] = prefix[i] * ROOT + points[i] + np.uint64(1)
    most = min(v.longest, n)
    none = len(v.keys)
    place = np.full((most, n, m), none, np.uint16 if none < 1 << 16 else np.int32)  # of the piece of a size that starts somewhere
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for size in range(1, most + 1):  # all substrings of one size, by their start
            power = power * ROOT
            keys = prefix[: n + 1 - size] * -power
            keys += prefix[size:]
            keys += np.uint64(size)
            keys *= SPREAD
            where, found = v.table.probe(keys)
            place[size - 1].reshape(-1)[where] = found
    best = np.full((n + 1, m), -np.inf)
    best[0] = 0.0
    back = np.ones((n + 1, m), np.int8 if most < 128 else np.int32)
    last = np.full((n + 1, m), -1, np.int64)  # the rank of the piece that ends somewhere
    for j in range(1, n + 1):
        k = active[j]
        here, chosen = best[j, :k], back[j, :k]
        for size in range(min(most, j), 0, -1):
            found = place[size - 1, j - size, :k]
            if v.merges is None:
                gain = v.scores_or_none.take(found)
                if size == 1:
                    gain[gain == -np.inf] = v.unknown  # a character without a piece
                reached = best[j - size, :k] + gain
                better = reached > here
                np.copyto(here, reached, where=better)
                np.copyto(chosen, size, where=better)
                continue
            open_ = here < 0
            own = np.flatnonzero(open_ & (found != none) if size > 1 else open_)  # what no longer piece ends is a single character
            if not len(own):
                continue
            rank = v.ranks_or_none.take(found[own])
            if size > 1 and j > size:
                kept = v.merges.apart(last[j - size, own], rank)
                own, rank = own[kept], rank[kept]
            here[own], chosen[own], last[j, own] = 0.0, size, rank
    ends = lengths.copy()
    columns = np.arange(m)
    starts, places = [], []
    while ends.any():
        live = ends > 0
        start = np.where(live, ends - back[ends, columns], 0)
        places.append(np.where(live, place[np.where(live, ends - start, 1) - 1, start, columns].astype(np.int64), -1))
        starts.append(start)
        ends = start
    places_, starts_ = np.stack(places[::-1]).T, np.stack(starts[::-1]).T  # -1 before a unit's first piece
    real = places_ >= 0
    return [0, *np.cumsum(real.sum(1)).tolist()], starts_[real], places_[real]


def joined_windows(unit: str, v: Vocabulary, size: int = LONG) -> Path:
    """The path of a long unit from those of overlapping windows of its characters.

    Where two windows have no boundary that fits (as in the repetition of one letter,
    where they may be out of step), one that begins at a boundary of the left one
    takes the right one's place.
    """
    if v.merges is None or size >= len(unit):
        return paths([unit], v)[0]
    begins = list(range(0, max(1, len(unit) - OVERLAP), size - OVERLAP))
    found = paths([unit[b : b + size] for b in begins], v)
    apart = lambda x, y: v.merges.apart(v.ranks_or_none[x], v.ranks_or_none[y])
    seen: dict[str, Path] = {}
    parts, (held, places), end = [], found[0], size
    for b, (starts, own) in zip(begins[1:], found[1:]):
        if end >= min(b + size, len(unit)):
            continue  # the one held goes further
        starts = starts + b
        shared = np.intersect1d(held[1:], starts, assume_unique=True)
        left, right = np.searchsorted(held, shared), np.searchsorted(starts, shared)
        fits = np.flatnonzero(apart(places[left - 1], own[right]))
        if len(fits):
            cut = fits[len(fits) // 2]
            at, starts, own, end = left[cut], starts[right[cut] :], own[right[cut] :], b + size
        else:
            for at in range(len(held) - 1, int(np.searchsorted(held[1:], b)), -1):
                window = unit[held[at] : held[at] + size]
                if window not in seen:
                    seen[window] = paths([window], v)[0]
                starts, own = seen[window]
                if apart(places[at - 1 : at], own[:1])[0]:
                    starts, end = starts + held[at], int(held[at]) + size
                    break
            else:
                return joined_windows(unit, v, 2 * size)
        parts.append((held[:at], places[:at]))
        held, places = starts, own
    parts.append((held, places))
    return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def ids_of(unit: str, path: Path, v: Vocabulary) -> np.ndarray:
    """The ids of a path, bytes for characters without a piece."""
    out: list[int] = []
    for i, at in zip(v.ids_or_none.take(path[1]).tolist(), path[0].tolist()):
        if i < 0:
            out += [v.byte_ids[b] for b in (SPACE if unit[at] == HELD else unit[at]).encode("utf-8")]
        else:
            out.append(i)
    return np.array(out, np.int32)


def segment(units: list[str], v: Vocabulary) -> list[bytes]:
    """The ids of each unit, as the bytes of 32-bit integers."""
    whole, spaced = units, []
    if v.merges is not None:  # all but the last space of a run are merged afterwards
        spaced = [i for i, u in enumerate(units) if u[1:2] == SPACE]
        units = units.copy()
        for i in spaced:
            units[i] = SPACE + units[i].lstrip(SPACE)
    out = [b""] * len(units)
    for numbers, edges, starts, places in batches([u if len(u) <= LONG else "" for u in units], v):
        ids = v.ids_or_none.take(places)
        data = ids.tobytes()
        for i, a, b in zip(numbers, edges[:-1], edges[1:]):
            out[i] = data[4 * a : 4 * b]
        for k in np.unique(np.searchsorted(edges, np.flatnonzero(ids < 0), "right") - 1).tolist():
            a, b = edges[k], edges[k + 1]
            out[numbers[k]] = ids_of(units[numbers[k]], (starts[a:b], places[a:b]), v).tobytes()
    for i, u in enumerate(units):
        if len(u) > LONG:
            out[i] = ids_of(u, joined_windows(u, v), v).tobytes()
    for i in spaced:
        ids = np.frombuffer(out[i], np.int32)
        k = len(whole[i]) - len(units[i])
        if len(ids) and ids[0] == v.space_runs[1][0]:
            k, ids = k + 1, ids[1:]
        most = len(v.space_runs) - 1
        out[i] = np.array(v.space_runs[most] * (k // most) + v.space_runs[k % most], np.int32).tobytes() + ids.tobytes()
    return out


class Encoder:
    """Encodes batches of texts, remembering a bounded number of units: the latest, and those before them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit integers."""
        cut = [UNIT.findall(SPACE + t.replace(SPACE, HELD).replace(" ", SPACE)) if t else [] for t in texts]
        known, old = self.known, self.old
        new = []
        for u in {u for units in cut for u in units}:
            if u not in known:
                if u in old:
                    known[u] = old[u]
                else:
                    new.append(u)
        known.update(zip(new, segment(new, self.vocabulary)))
        out = [b"".join([known[u] for u in units]) for units in cut]
        if len(known) > REMEMBERED:
            self.known, self.old = {}, dict(islice(known.items(), 2 * REMEMBERED))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(b, np.int32).tolist() for b in self.batch(texts)]


def decode(ids: list[int], surfaces: list[bytes]) -> str:
    """The text of ids: their bytes, without the space put in front."""
    joined = b"".join([surfaces[i] for i in ids]).decode("utf-8", "replace")
    return joined[1:] if joined[:1] == " " else joined


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids, n_ids, exact (whether decoding ids gave back the text).

    One row per row, repeated rows included. Null texts count as empty; an empty text
    has no ids.
    """
    small_batches(docs.sparkSession)
    vocabulary = load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = encoder.batch(texts)
            exact = [decode(np.frombuffer(b, np.int32).tolist(), vocabulary.surfaces) == t for b, t in zip(found, texts)]
            edges = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(b) // 4 for b in found], out=edges[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(found), np.int32))), pa.array(np.diff(edges).astype(np.int64)), pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_ids", "exact"])

    return documents(docs).mapInArrow(tidy(run), "doc_id long, ids array<int>, n_ids long, exact boolean")


def decode_rows(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """encoded (doc_id, ids) -> doc_id, text; null ids give an empty text."""
    small_batches(encoded.sparkSession)
    surfaces = load(model_path).surfaces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(ids or [], surfaces) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def op6_sentencepiece(spark, sf_dir):
    """Every document's ids under the default vocabulary, decoded again to check them."""
    return encode(table(spark, sf_dir, "documents"))
