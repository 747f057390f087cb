"""SentencePiece encoding and decoding with N-best segmentations.

The pieces of a model and their scores span a lattice over a text: an edge for each piece that matches, and one in byte
fallback for each character that is no piece. Forward Viterbi scores (best score from the start to a position) are the exact
remaining cost of a backward A-star search from the end, which therefore leaves the segmentations in order of score and
expands little else.

A lattice is cut where no piece crosses: before a space that follows another character and around line feeds, as far as
the model has no such piece (checked on loading). The N-best of a text are
those of its parts, merged. A part is searched once per task for its best segmentation and the gap to the second; only parts with the smallest gaps of a text can
matter to its N-best, and only those are searched further.

The text is taken as it is, with the space put in front that the model was made with; spaces stand for U+2581, and U+2581 itself goes
to byte fallback, so that decoding gives back any text. Scores of these models are integers (ranks) or floats; sums are doubles.
Where the model was built by merging pairs, its scores are ranks, and the best segmentation here is the one with the largest sum of scores, not the one that
merging gives.

Defined results: null texts are empty; an empty text has no pieces and one segmentation of score 0; ties go to the segmentation found
first, which is the same on every run; texts of any length are encoded whole; rows keep their multiplicity, null ids included; columns other than doc_id
and text are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words

Segmentation = tuple[float, tuple[int, ...]]


_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _rolled(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of strings one character longer."""
    return (hashes ^ (hashes >> np.uint64(29))) * _BASE + codes + np.uint64(1)


class _PieceTable:
    """Hashes of the pieces of one length: up to three slots each are looked at, by different bits of the hash; as many bits as it takes."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        codes = np.array([list(map(ord, p)) for p, _, _ in pieces], dtype=np.uint64)
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for k in range(codes.shape[1]):
            hashes = _rolled(hashes, codes[:, k])
        self.ids = np.array([x[1] for x in pieces])
        self.scores = np.array([x[2] for x in pieces])
        self.hashes = hashes
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have the same hash")
        for self.bits in range(max(8, 2 + len(pieces).bit_length()), 64):
            left, self.slots = np.arange(len(pieces)), []
            for shift in (64 - self.bits, max(0, 64 - 2 * self.bits), max(0, 64 - 3 * self.bits)):
                slot, table = self._slot(hashes[left], shift), np.zeros(1 << self.bits, dtype=np.int32)
                table[slot] = left
                self.slots.append((shift, table))
                left = left[table[slot] != left]
                if not len(left):
                    return

    def _slot(self, hashes: np.ndarray, shift: int) -> np.ndarray:
        return ((hashes * _SPREAD >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash among the pieces, and whether it is one of them."""
        place = np.zeros(hashes.shape, dtype=np.int32)
        hit = np.zeros(hashes.shape, dtype=bool)
        for shift, table in self.slots:
            here = table[self._slot(hashes, shift)]
            found = self.hashes[here] == hashes
            place = np.where(found, here, place)
            hit |= found
        return place, hit


class _Grid:
    """The edges of a long part in one row per end position and one column per width: no object per edge. Read like the lists of a short part."""

    def __init__(self, part: str, tables: dict[int, _PieceTable], longest: int, unknown: float) -> None:
        codes = np.frombuffer(part.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        n, columns = len(codes), {}
        hashes = np.zeros(n, dtype=np.uint64)
        for width in range(1, min(n, longest) + 1):
            hashes = _rolled(hashes[: n - width + 1], codes[width - 1 :])
            if width in tables:
                place, hit = tables[width].find(hashes)
                if width == 1 or hit.any():
                    columns[width] = np.where(hit, tables[width].scores[place], unknown if width == 1 else -np.inf), np.where(hit, tables[width].ids[place], -1)
        columns.setdefault(1, (np.full(n, unknown), np.full(n, -1)))
        self.widths = sorted(columns, reverse=True)
        self.scores = np.full((n + 1, len(columns)), -np.inf)
        self.ids = np.full((n + 1, len(columns)), -1, dtype=np.int32)
        for k, w in enumerate(self.widths):
            self.scores[w:, k], self.ids[w:, k] = columns[w]

    def __len__(self) -> int:
        return len(self.scores)

    def __getitem__(self, end: int) -> list[tuple[int, int, float]]:
        return [(end - w, i, s) for w, i, s in zip(self.widths, self.ids[end].tolist(), self.scores[end].tolist(), strict=True) if s > -np.inf]

    def _rows(self, ends: range) -> Iterator[tuple[int, list[float]]]:
        """Rows of scores, some thousands at a time."""
        for first in range(0, len(ends), 4096):
            part = ends[first : first + 4096]
            yield from zip(part, self.scores[np.array(part)].tolist(), strict=True)

    def forward(self) -> tuple[list[float], list[int]]:
        """Best score from the start to each position, and the width of its last edge."""
        n = len(self) - 1
        best, chosen = [0.0] * (n + 1), [0] * (n + 1)
        for j, row in self._rows(range(1, n + 1)):
            top, width = -np.inf, 0
            for w, s in zip(self.widths, row):
                if w <= j and (score := best[j - w] + s) > top:
                    top, width = score, w
            best[j], chosen[j] = top, width
        return best, chosen

    def second(self, forward: list[float], path: list[tuple[int, int, int]]) -> float:
        """The score of the best path with an edge that the given one lacks."""
        n = len(self) - 1
        behind = [-np.inf] * n + [0.0]
        for j, row in self._rows(range(n, 0, -1)):
            own = behind[j]
            for w, s in zip(self.widths, row):
                if w <= j and own + s > behind[j - w]:
                    behind[j - w] = own + s
        ahead, out = np.array(forward), -np.inf
        ends, starts = np.array([b for _, b, _ in path]), np.array([a for a, _, _ in path])
        for k, w in enumerate(self.widths):
            through = ahead[: n - w + 1] + self.scores[w:, k] + np.array(behind[w:])
            through[starts[ends - starts == w]] = -np.inf
            out = max(out, float(through.max()))
        return out


class PieceLattice:
    """Pieces and scores of a model; N-best of parts and of texts."""

    limit = 300_000
    #: Parts of so many characters and more have their edges in columns.
    long = 2_000
    unknown_penalty = 10.0

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.surface: list[bytes] = []
        self.byte_ids = [0] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(piece[3:5], 16)] = k
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.surface.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.pieces[piece] = (k, float(model.get_score(k)))
                self.surface.append(piece.encode())
        self.longest = max(map(len, self.pieces))
        self.single = {p for p in self.pieces if len(p) == 1}
        # scores far below all ranks mark pieces that are never to be chosen
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - self.unknown_penalty
        inner = [(a, b) for p in self.pieces for a, b in zip(p, p[1:])]
        self.cut_spaces = all(a == " " for a, b in inner if b == " ")
        self.cut_feeds = not any("\n" in pair for pair in inner)
        self.tables: dict[int, _PieceTable] = {}
        for size in range(1, self.longest + 1):
            if own := [(p, *v) for p, v in self.pieces.items() if len(p) == size]:
                self.tables[size] = _PieceTable(own)
        self.nbest_known: dict[tuple[str, int], list[Segmentation]] = {}
        self.loose: dict[str, tuple[bytes, float, float]] = {}
        # ids of whole words with what joins them, their scores and the gaps to the second best
        self.known = words.KnownUnits("<i4", 2, self.limit)
        self.latest: tuple[str, list | _Grid, list[float], list] = ("", [[]], [0.0], [])
        self.feed = self._best_and_gap("\n")

    def _lattice(self, part: str) -> tuple[str, list | _Grid, list[float], list]:
        """The part, its edges by end position, forward scores and best last edges (of a long part: their widths); the latest is remembered."""
        if part != self.latest[0]:
            edges = self._edges(part) if len(part) < self.long else _Grid(part, self.tables, self.longest, self.unknown)
            self.latest = (part, edges, *(self._forward(edges) if isinstance(edges, list) else edges.forward()))
        return self.latest

    def _edges(self, part: str) -> list[list[tuple[int, int, float]]]:
        """By end position: (start, id or -1, score)."""
        n, get = len(part), self.pieces.get
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (found := get(part[i:j])) is not None:
                    out[j].append((i, *found))
                    single = single or j == i + 1
            if not single:
                out[i + 1].append((i, -1, self.unknown))
        return out

    def _forward(self, edges: list[list[tuple[int, int, float]]]) -> tuple[list[float], list[tuple[int, int, float]]]:
        best, back = [0.0] * len(edges), [(0, 0, 0.0)] * len(edges)
        for j in range(1, len(edges)):
            top = None
            for e in edges[j]:
                score = best[e[0]] + e[2]
                if top is None or score > top:
                    top, back[j] = score, e
            best[j] = top if top is not None else -np.inf
        return best, back

    def _ids(self, part: str, start: int, end: int, piece: int) -> tuple[int, ...]:
        return (piece,) if piece >= 0 else tuple(self.byte_ids[b] for b in part[start:end].encode())

    def nbest_part(self, part: str, n: int) -> list[Segmentation]:
        """The n best segmentations of one part, best first: backward A-star with the forward scores as heuristic.

        A position is left at most n times and by n edges, as its n best ways to the end are all that the n best segmentations can use; among ties the newest path
        goes on, so that a run of one character, where very many paths tie, is walked through once.
        """
        _, edges, forward, _ = self._lattice(part)
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], 0, len(part), 0.0, None)]
        count, out, left = 0, [], [0] * len(edges)
        while agenda and len(out) < n:
            _, _, at, behind, chain = heapq.heappop(agenda)
            left[at] += 1
            if left[at] > n:
                continue
            if at == 0:
                ids: list[int] = []
                while chain is not None:
                    step, chain = chain
                    ids.extend(self._ids(part, *step))
                out.append((behind, tuple(ids)))
                continue
            steps = edges[at]
            if len(steps) > n:
                steps = sorted(steps, key=lambda e: forward[e[0]] + e[2])[-n:]
            for start, piece, score in steps:
                count -= 1
                heapq.heappush(agenda, (-(forward[start] + score + behind), count, start, behind + score, ((start, at, piece), chain)))
        return out

    def _best_and_gap(self, part: str) -> tuple[bytes, float, float]:
        """Best segmentation, its score, and how much the second is below it (inf if there is none).

        Any other path takes an edge that the best one lacks, so the second is the best path through such an edge.
        """
        _, edges, forward, back = self._lattice(part)
        if isinstance(edges, _Grid):
            path, at = [], len(part)
            while at:
                path.append((at - back[at], at, int(edges.ids[at, edges.widths.index(back[at])])))
                at = path[-1][0]
            ids = [k for step in reversed(path) for k in self._ids(part, *step)]
            return np.array(ids, dtype="<i4").tobytes(), forward[-1], forward[-1] - edges.second(forward, path)
        backward = [-np.inf] * len(edges)
        backward[-1] = 0.0
        for j in range(len(edges) - 1, 0, -1):
            behind = backward[j]
            for start, _, score in edges[j]:
                if behind + score > backward[start]:
                    backward[start] = behind + score
        chosen, ids, at = set(), [], len(part)
        while at:
            e = back[at]
            chosen.add((e[0], at))
            ids.append(self._ids(part, e[0], at, e[1]))
            at = e[0]
        second = max((forward[e[0]] + e[2] + backward[j] for j in range(1, len(edges)) for e in edges[j] if (e[0], j) not in chosen), default=-np.inf)
        return np.array([k for step in reversed(ids) for k in step], dtype="<i4").tobytes(), forward[-1], forward[-1] - second

    def _many(self, parts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The same for parts of one length, all of whose characters are pieces, at once."""
        size = len(parts[0])
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4").reshape(-1, size).astype(np.uint64)
        score: dict[tuple[int, int], np.ndarray] = {}
        piece: dict[tuple[int, int], np.ndarray] = {}
        hashes = np.zeros(codes.shape, dtype=np.uint64)
        for width in range(1, min(size, self.longest) + 1):
            hashes = _rolled(hashes[:, : size - width + 1], codes[:, width - 1 :])
            if width not in self.tables:
                continue
            place, hit = self.tables[width].find(hashes)
            scores, ids = self.tables[width].scores, self.tables[width].ids
            for i in range(hashes.shape[1]):
                if hit[:, i].any():
                    score[i, i + width] = np.where(hit[:, i], scores[place[:, i]], -np.inf)
                    piece[i, i + width] = ids[place[:, i]]
        by_end: list[list[int]] = [sorted(i for i, j in score if j == end) for end in range(size + 1)]
        forward = np.full((size + 1, len(parts)), -np.inf)
        backward = forward.copy()
        start = np.zeros((size + 1, len(parts)), dtype=np.int64)
        forward[0] = backward[size] = 0.0
        for j in range(1, size + 1):
            for i in by_end[j]:
                new = forward[i] + score[i, j]
                better = new > forward[j]
                forward[j] = np.where(better, new, forward[j])
                start[j] = np.where(better, i, start[j])
        for j in range(size, 0, -1):
            for i in by_end[j]:
                np.maximum(backward[i], backward[j] + score[i, j], out=backward[i])
        on_path = np.zeros((size + 1, len(parts)), dtype=bool)
        on_path[size] = True
        for j in range(size, 0, -1):
            for i in by_end[j]:
                on_path[i] |= on_path[j] & (start[j] == i)
        second = np.full(len(parts), -np.inf)
        chosen = np.full((len(parts), size), -1, dtype=np.int64)
        for (i, j), s in score.items():
            on = on_path[j] & (start[j] == i)
            np.maximum(second, np.where(on, -np.inf, forward[i] + s + backward[j]), out=second)
            chosen[on, i] = piece[i, j][on]
        used = chosen >= 0
        flat, ends = chosen[used].astype("<i4").tobytes(), 4 * np.cumsum(used.sum(axis=1))
        bounds = [0, *ends.tolist()]
        return [flat[x:y] for x, y in zip(bounds, bounds[1:])], forward[size], forward[size] - second

    def _best(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (flat), sizes and (score, gap) rows of parts, those of one length at once."""
        by_size: dict[int, list[int]] = {}
        for k, p in enumerate(parts):
            by_size.setdefault(len(p) if len(p) <= 32 and self.single.issuperset(p) else 0, []).append(k)
        ids: list[bytes] = [b""] * len(parts)
        numbers = np.empty((2, len(parts)))
        for size, group in ((s, g[first : first + 4000]) for s, g in by_size.items() for first in range(0, len(g), 4000)):
            own = [parts[k] for k in group]
            found = self._many(own) if size else tuple(zip(*map(self._best_and_gap, own), strict=True))
            for k, x in zip(group, found[0], strict=True):
                ids[k] = x
            numbers[0, group], numbers[1, group] = found[1], found[2]
        return np.frombuffer(b"".join(ids), dtype="<i4"), np.array([len(x) // 4 for x in ids], dtype=np.int64), numbers

    def _found(self, units: words.Units, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for units: a word after a line feed has that feed before it, any other a space."""
        kinds = units.kind[new].tolist()
        texts = [units.joined[x:y].decode() for x, y in zip(units.starts[new].tolist(), units.ends[new].tolist(), strict=True)]
        flat, sizes, numbers = self._best([t if k == 2 else f" {t}" for t, k in zip(texts, kinds, strict=True)])
        fed = np.flatnonzero(np.array(kinds) == 2)
        if len(fed):
            feed = np.frombuffer(self.feed[0], dtype="<i4")
            starts = np.cumsum(sizes) - sizes
            flat = np.insert(flat, np.repeat(starts[fed], len(feed)), np.tile(feed, len(fed)))
            sizes = sizes.copy()
            sizes[fed] += len(feed)
            numbers[0, fed] += self.feed[1]
        return flat, sizes, numbers

    def part(self, part: str) -> tuple[bytes, float, float]:
        found = self.loose.get(part)
        if found is None:
            if len(self.loose) >= 20_000:
                self.loose.clear()
            found = self.loose[part] = self._best_and_gap(part)
        return found

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        if not (self.cut_spaces and self.cut_feeds):
            return [f" {text}"]
        return re.findall(r" *[^ \n]+|\n| +", f" {text}")

    def nbest(self, text: str, n: int) -> list[Segmentation]:
        """The n best segmentations of a text, best first."""
        parts = self.parts(text)
        found = list(map(self.part, parts))
        choices, order = self._choices(np.array([f[2] for f in found]), parts.__getitem__, n)
        best, out = float(sum(f[1] for f in found)), []
        for picked in self._combined(choices, n):
            other = {k: choices[m][picked[m]][1] for m, k in enumerate(order)}
            ids = [i for k, f in enumerate(found) for i in (other[k] if k in other else np.frombuffer(f[0], dtype="<i4").tolist())]
            out.append((best - self._loss(choices, picked), tuple(ids)))
        return out

    def _choices(self, gaps: np.ndarray, part: Callable[[int], str], n: int) -> tuple[list[list[Segmentation]], list[int]]:
        """N-best of the n - 1 parts with the smallest gaps, and their places: no other part differs in the n best of the text."""
        few = min(n - 1, len(gaps))
        if few < 1:
            return [], []
        order = sorted(k for k in np.argpartition(gaps, few - 1)[:few].tolist() if gaps[k] < np.inf)
        out = []
        for k in order:
            key = (part(k), n)
            if key not in self.nbest_known:
                if len(self.nbest_known) > 20_000:
                    self.nbest_known.clear()
                self.nbest_known[key] = self.nbest_part(*key)
            out.append(self.nbest_known[key])
        return out, order

    @staticmethod
    def _loss(choices: list[list[Segmentation]], picked: tuple[int, ...]) -> float:
        return sum(o[0][0] - o[i][0] for o, i in zip(choices, picked, strict=True))

    @staticmethod
    def _combined(choices: list[list[Segmentation]], n: int) -> list[tuple[int, ...]]:
        """The n best picks, one of each list, by the sum of scores."""
        first = (0,) * len(choices)
        agenda, seen, out = [(0.0, first)], {first}, []
        while agenda and len(out) < n:
            loss, picked = heapq.heappop(agenda)
            out.append(picked)
            for k, options in enumerate(choices):
                if picked[k] + 1 < len(options):
                    new = (*picked[:k], picked[k] + 1, *picked[k + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(agenda, (PieceLattice._loss(choices, new), new))
        return out

    def encode(self, bodies: list[bytes], n: int) -> list[tuple[list[bytes], list[float]]]:
        """For each text (UTF-8): ids (little-endian int32) and scores of the n best segmentations, best first.

        Texts that are words with one space or line feed between any two go by their words, all of a batch at once.
        """
        units = words.Units(bodies)
        regular = units.regular if self.cut_spaces and self.cut_feeds else np.zeros(len(bodies), dtype=bool)
        places = np.empty(0, dtype=np.int64)
        if len(units.keys) and regular.any():
            places, clashes = self.known.places(units, lambda new: self._found(units, new))
            regular = units.without(clashes)
        raw = self.known.ids(places).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.known.size[places])]) * 4
        scores, gaps = self.known.numbers[:, places]
        totals = np.concatenate([[0.0], np.cumsum(scores)])
        out = []
        for k, body in enumerate(bodies):
            x, y = units.bounds[k], units.bounds[k + 1]
            if regular[k]:

                def part(at: int, first: int = x) -> str:
                    word = units.joined[units.starts[first + at] : units.ends[first + at]].decode()
                    return word if units.kind[first + at] == 2 else f" {word}"

                ids, best, bounds = raw[ends[x] : ends[y]], float(totals[y] - totals[x]), ends[x : y + 1] - ends[x]
                choices, order = self._choices(gaps[x:y], part, n)
            else:
                parts = self.parts(body.decode())
                found = list(map(self.part, parts))
                ids, best, bounds = b"".join([f[0] for f in found]), float(sum(f[1] for f in found)), np.cumsum([0, *(len(f[0]) for f in found)])
                choices, order = self._choices(np.array([f[2] for f in found]), parts.__getitem__, n)
            picks = self._combined(choices, n)
            out.append(([ids, *(self._replaced(ids, bounds, order, choices, p) for p in picks[1:])], [best - self._loss(choices, p) for p in picks]))
        return out

    @staticmethod
    def _replaced(ids: bytes, bounds: np.ndarray, order: list[int], choices: list[list[Segmentation]], picked: tuple[int, ...]) -> bytes:
        """The ids of the best segmentation with other segmentations of some parts."""
        out, at = [], 0
        for k, options, pick in zip(order, choices, picked, strict=True):
            if pick:
                out += [ids[at : bounds[k]], np.array(options[pick][1], dtype="<i4").tobytes()]
                at = bounds[k + 1]
        return b"".join([*out, ids[at:]])

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; undecodable bytes become U+FFFD."""
        whole = b"".join(map(self.surface.__getitem__, ids))
        return whole[1:].decode(errors="replace") if whole.startswith(b" ") else whole.decode(errors="replace")


FIELDS = "doc_id long, n_chars long, n_tokens long, ids array<int>, ids_crc32 long, score double, nbest_scores array<double>, nbest_crc32 array<long>, decoded_ok boolean"


def _arrays(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32()))


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"))


def encoded(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """FIELDS for each row of docs(doc_id, text): ids of the best segmentation, scores and sums of the ids of the n best, and whether decoding the best gives the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(model_path)
        for rows in common.slices(batches, 1, 500):
            bodies = rows.column(1).to_pylist()
            both = lattice.encode(bodies, n)
            best = [b[0] for b, _ in both]
            good = [lattice.decode(np.frombuffer(i, dtype="<i4").tolist()) == b.decode() for i, b in zip(best, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0), pa.array([len(b.decode()) for b in bodies], pa.int64()), pa.array([len(b) // 4 for b in best], pa.int64()), _arrays(best),
                    pa.array([zlib.crc32(b) for b in best], pa.int64()), pa.array([s[0] for _, s in both], pa.float64()), pa.array([s for _, s in both], pa.list_(pa.float64())),
                    pa.array([list(map(zlib.crc32, b)) for b, _ in both], pa.list_(pa.int64())), pa.array(good, pa.bool_()),
                ],
                names=[f.split()[0] for f in FIELDS.split(", ")],
            )
        del lattice
        common.release()

    return _bodies(docs).mapInArrow(run, FIELDS)


def segmentations(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """doc_id, rank (from 1), score, ids: the n best segmentations of each row of docs(doc_id, text), fewer where there are no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(model_path)
        for rows in common.slices(batches, 1, 200):
            both = lattice.encode(rows.column(1).to_pylist(), n)
            owner = np.repeat(np.arange(len(both)), [len(s) for _, s in both])
            rank = [k + 1 for _, s in both for k in range(len(s))]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(owner)), pa.array(rank, pa.int32()), pa.array([x for _, s in both for x in s], pa.float64()), _arrays([i for b, _ in both for i in b])],
                names=["doc_id", "rank", "score", "ids"],
            )
        del lattice
        common.release()

    return _bodies(docs).mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decoded(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from tokens(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lattice.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
