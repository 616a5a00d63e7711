"""SentencePiece encoding and decoding of whole texts by a streaming Viterbi pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import per_process
from .words import Powers, chunks, mix

MARK = "▁"


_WIDE = 20  # letters of the segments that are encoded together; longer ones are streamed alone
_SLOTS = 20  # bits of a slot's number


class Slots:
    """A table of 64-bit keys and values in fixed arrays; of two keys with one slot the later one stays."""

    def __init__(self, bits: int = _SLOTS) -> None:
        self.shift = np.uint64(64 - bits)
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is there.  Key 0 is none."""
        at = key >> self.shift
        return self.value[at], self.key[at] == key

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        # Key and value of one of the rows, whichever of equal slots is written last.
        at = key >> self.shift
        self.value[at] = value
        self.key[at] = key
        ok = self.value[at] == value
        self.key[at[~ok]] = 0


class Known:
    """Ids of the segments met so far: 16 MB of slots and at most ``most`` ids, then all is forgotten.  A task has its own."""

    def __init__(self, most: int = 4_000_000) -> None:
        self.slots, self.most = Slots(), most
        self.ids, self.n = np.zeros(1 << 16, np.int32), 0

    def add(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keeps new segments; gives their places: the first id, and the number of ids in the lowest 24 bits."""
        if self.n + len(ids) > self.most and self.n:
            self.slots, self.n = Slots(), 0
        if self.n + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.n], np.zeros(max(self.n, len(ids)), np.int32)))
        self.ids[self.n : self.n + len(ids)] = ids
        place = (self.n + np.cumsum(size) - size) << 24 | size
        self.n += len(ids)
        self.slots.put(key, place)
        return place


@dataclass
class Pieces:
    """Vocabulary of a BPE model with byte fallback: ids of pieces and bytes, and the rank at which a piece is merged.

    Space marks are kept as spaces.  ``inner``: pairs of characters that some piece holds side by side; between any others all
    paths meet.  ``splits``: no piece goes on with a space after another character.  ``keep``: most pairs of pieces remembered.
    """

    ids: dict[str, int]
    rank: dict[str, float]
    byte: list[int]
    raw: list[bytes]
    longest: int
    prefix: bool
    inner: frozenset
    splits: bool
    keep: int = 100_000
    apart: dict = field(default_factory=dict)

    @classmethod
    def load(cls, model: bytes) -> Pieces:
        import sentencepiece  # reads the file; nothing else of the package needs it

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids, rank, byte, raw = {}, {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                byte[value] = i
                raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                piece = piece.replace(MARK, " ")
                ids[piece], rank[piece] = i, -sp.get_score(i)
                raw.append(piece.encode())
        prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        inner = frozenset(p[i : i + 2] for p in ids for i in range(len(p) - 1))
        return cls(ids, rank, byte, raw, max(map(len, ids)), prefix, inner, not any(x[1] == " " != x[0] for x in inner))

    def __post_init__(self) -> None:
        self.text = {i: p for p, i in self.ids.items()}
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in self.ids if len(p) == 1]] = True
        self.alone = np.append(~self.single[:128], np.zeros(128, bool))
        # Pieces by the hash of their letters; those whose slot another one has are in the next table.
        hashes = np.array([_letters_hash(np.array([[*map(ord, p)]], np.uint64))[0] for p in self.ids], np.uint64)
        number = np.array(list(self.ids.values()), np.int64)
        self.tables, h, i = [], hashes, number
        while len(h):
            table = Slots(18)
            table.put(h, i)
            missed = ~table.find(h)[1]
            self.tables.append(table)
            h, i = mix(h[missed]), i[missed]
        self.pairs = Slots()
        size = max(len(self.raw), max(self.text) + 1) + 1
        self.rank_of = np.full(size, np.inf)
        self.rank_of[number] = list(self.rank.values())
        self.size_of = np.zeros(size, np.int64)
        self.size_of[number] = [*map(len, self.ids)]
        self.points_of = np.zeros((size, self.longest), np.uint32)
        for p, i in self.ids.items():
            self.points_of[i, : len(p)] = [*map(ord, p)]
        whole = np.concatenate([self._apart(np.full(len(x), size - 1), x) for x in np.array_split(number, 1 + len(number) // 8192)])
        self.whole = np.zeros(size, bool)
        self.whole[number[whole]] = True

    def encode(self, text: str) -> bytes:
        """Ids of a text, as packed 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()), Known())[0].tobytes()

    def encode_all(self, texts: pa.Array, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each begins.  Texts fall into segments, after which all paths meet."""
        texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
        texts = pa.compute.replace_substring(texts, MARK, " ")
        if self.prefix:
            marked = pa.compute.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
            texts = pa.compute.if_else(pa.compute.equal(texts, ""), texts, marked)
        if not self.splits:
            blobs = [np.frombuffer(self._runs(t), np.int32) if t else np.zeros(0, np.int32) for t in texts.to_pylist()]
            return np.concatenate(blobs or [np.zeros(0, np.int32)]), np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype(np.int64)
        edge = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[edge[0] : edge[-1]] if raw is not None else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin = data == 32
        begin[1:] &= data[:-1] != 32
        alone = self.alone[data]  # spelled in bytes, so what comes before and after does not join
        begin |= alone
        begin[1:] |= alone[:-1]
        begin[edge[:-1][np.diff(edge) > 0]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))
        up, down = _POWERS.upto(len(data))
        key = mix(np.add.reduceat(_BYTE[data] * up[: len(data)], start) * down[start] + (end - start).astype(np.uint64)) | np.uint64(1)
        place, hit = known.slots.find(key)
        if not hit.all():
            new, at, back = np.unique(key[~hit], return_index=True, return_inverse=True)
            at = np.flatnonzero(~hit)[at]
            ids, size = self._segments(data, start[at], end[at])
            held = known.ids[:0] if known.n + len(ids) <= known.most else known.ids
            fresh = known.add(new, ids, size)
            if len(held):  # what was known has been forgotten: its ids are taken from the old array
                return self._gathered([(held, place, hit), (known.ids, fresh[back], ~hit)], len(key), start, edge)
            place[~hit] = fresh[back]
        return self._gathered([(known.ids, place, np.ones(len(key), bool))], len(key), start, edge)

    @staticmethod
    def _gathered(sources, n: int, start: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.zeros(n, np.int64)
        for _, place, rows in sources:
            size[rows] = (place[rows] if len(place) == n else place) & 0xFFFFFF
        ends = np.concatenate(([0], np.cumsum(size)))
        out = np.zeros(ends[-1], np.int32)
        for ids, place, rows in sources:
            place = place[rows] if len(place) == n else place
            own = size[rows]
            offset = np.cumsum(own) - own
            step = np.arange(own.sum()) - np.repeat(offset, own)
            out[np.repeat(ends[:-1][rows], own) + step] = ids[np.repeat(place >> 24, own) + step]
        return out, ends[np.searchsorted(start, edge)]

    def _segments(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, in a row, and how many each has."""
        size = end - start
        flat = data[np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)]
        points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        letters = np.add.reduceat((flat & 0xC0) != 0x80, np.cumsum(size) - size, dtype=np.int64)
        if letters.sum() != len(points):  # broken bytes: one by one
            letters, points = np.full(len(size), _WIDE + 1), np.zeros(0, np.uint32)
        first = np.cumsum(letters) - letters
        short = letters <= _WIDE
        if len(points):
            short &= np.logical_and.reduceat(self.single[points], first)
        blobs: list[np.ndarray] = [None] * len(size)
        for i in np.flatnonzero(~short).tolist():
            blobs[i] = np.frombuffer(self._runs(data[start[i] : end[i]].tobytes().decode("utf-8", "replace")), np.int32)
        count = np.array([0 if b is None else len(b) for b in blobs], np.int64)
        rows = np.flatnonzero(short)
        rows = rows[np.argsort(-letters[rows], kind="stable")]
        ids, number, odd = self._lattice(points, first[rows], letters[rows])
        for i in np.flatnonzero(odd).tolist():
            j = rows[i]
            blobs[j] = np.frombuffer(self._runs(data[start[j] : end[j]].tobytes().decode()), np.int32)
            number[i] = len(blobs[j])
        count[rows] = number
        out = np.zeros(count.sum(), np.int32)
        at = np.cumsum(count) - count
        good = rows[~odd]
        own = number[~odd]
        out[np.repeat(at[good], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)] = ids
        for i, b in enumerate(blobs):
            if b is not None:
                out[at[i] : at[i] + len(b)] = b
        return out, count

    def _lattice(self, points: np.ndarray, first: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The path of ``Stream`` for many segments at once, longest first: ids in a row, how many each has, and which have no path.

        All segments advance by one position at a time; only the last ``longest`` positions can start a piece."""
        m, width = len(first), int(letters.max(initial=0))
        none = np.int64(len(self.rank_of) - 1)
        code = np.zeros((m, width), np.uint64)
        for j in range(width):
            k = int(np.searchsorted(-letters, -j, "left"))  # segments of more than j letters
            code[:k, j] = _point(points[first[:k] + j])
        up, down = _POWERS.upto(width + 1)
        sums = np.zeros((m, width + 1), np.uint64)
        np.cumsum(code * up[:width], axis=1, out=sums[:, 1:])
        back = np.full((m, width + 1), -1, np.int8)
        last = np.full((m, width + 1), none, np.int64)
        back[:, 0] = 0
        for e in range(1, width + 1):
            open_ = np.arange(int(np.searchsorted(-letters, -e, "right")))  # segments of e letters or more
            for s in range(max(0, e - self.longest), e):
                rows = open_[back[open_, s] >= 0]
                piece = self._piece(mix((sums[rows, e] - sums[rows, s]) * down[s] + np.uint64(e - s)))
                there = piece >= 0
                rows, piece = rows[there], piece[there]
                if not len(rows):
                    continue
                ok = self._follows(last[rows, s], piece, none)
                rows, piece = rows[ok], piece[ok]
                back[rows, e], last[rows, e] = s, piece
                open_ = open_[back[open_, e] < 0]
        odd = back[np.arange(m), letters] < 0 if m else np.zeros(0, bool)
        at = np.where(odd, 0, letters)
        steps, rows = [], np.arange(m)
        while True:
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
            steps.append((rows, last[rows, at[rows]]))
            at[rows] = back[rows, at[rows]]
        number = np.zeros(m, np.int64)
        for r, _ in steps:
            number[r] += 1
        ends, ids = np.cumsum(number), np.zeros(int(number.sum()), np.int32)
        for j, (r, piece) in enumerate(steps):  # from the last piece to the first
            ids[ends[r] - 1 - j] = piece
        return ids, number, odd

    def _piece(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by the hash of their letters, -1 where there is none."""
        out, rows = np.full(len(h), -1), np.arange(len(h))
        for table in self.tables:
            value, hit = table.find(h)
            out[rows[hit]] = value[hit]
            rows, h = rows[~hit], mix(h[~hit])
        return out

    def _follows(self, before: np.ndarray, piece: np.ndarray, none: int) -> np.ndarray:
        """Whether each piece may follow the one before it (or begin a segment)."""
        key = mix((before * (none + 1) + piece).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        ok, hit = self.pairs.find(key)
        if not hit.all():
            new, at = np.unique(key[~hit], return_index=True)
            at = np.flatnonzero(~hit)[at]
            b, p = before[at], piece[at]
            found = self.whole[p].astype(np.int64)
            for i in range(0, len(at), 8192):
                rows = i + np.flatnonzero(found[i : i + 8192] & (b[i : i + 8192] != none))
                found[rows] = self._apart(b[rows], p[rows])
            self.pairs.put(new, found)
            ok[~hit] = found[np.searchsorted(new, key[~hit])]
        return ok.astype(bool)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``stays_apart`` for many pairs of ids; the last number stands for nothing on the left.

        ``end`` is where the symbol that starts at a letter ends, ``before`` the start of the symbol ahead, ``rank`` the rank of its join
        with the next one.
        """
        m, one = len(left), self.size_of[left]
        size = one + self.size_of[right]
        width = int(size.max(initial=0))
        points = np.zeros((m, width + 1), np.uint32)
        points[:, : min(width, self.longest)] = self.points_of[left, : min(width, self.longest)]
        row, at = np.nonzero(np.arange(min(width, self.longest)) < self.size_of[right][:, None])
        points[row, one[row] + at] = self.points_of[right[row], at]
        up, down = _POWERS.upto(width + 1)
        sums = np.zeros((m, width + 1), np.uint64)
        np.cumsum(_point(points[:, :width]) * up[:width], axis=1, out=sums[:, 1:])

        def joined(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            out = np.full(len(row), np.inf)
            ok = (end <= size[row]) & (end - start <= self.longest) & (start >= 0)
            r, s, e = row[ok], start[ok], end[ok]
            piece = self._piece(mix((sums[r, e] - sums[r, s]) * down[s] + (e - s).astype(np.uint64)))
            out[ok] = np.where(piece >= 0, self.rank_of[piece], np.inf)
            return out

        place = np.arange(width + 1)
        end = np.broadcast_to(place + 1, (m, width + 1)).copy()
        before = np.broadcast_to(place - 1, (m, width + 1)).copy()
        rank = np.full((m, width + 1), np.inf)
        row, at = np.nonzero(place + 1 < size[:, None])
        rank[row, at] = joined(row, at, at + 2)
        active = np.arange(m)
        while True:
            at = rank[active].argmin(1)
            go = rank[active, at] < np.inf
            active, at = active[go], at[go]
            if not len(active):
                break
            next_ = end[active, at]
            to = end[active, next_]
            end[active, at] = to
            rank[active, next_] = np.inf
            before[active, to] = at
            after = np.where(to < size[active], end[active, np.minimum(to, width)], width + 2)
            rank[active, at] = joined(active, at, after)
            ahead = before[active, at]
            rank[active, np.maximum(ahead, 0)] = np.where(ahead >= 0, joined(active, ahead, to), rank[active, 0])
        return (end[np.arange(m), 0] == np.where(one > 0, one, size)) & (end[np.arange(m), one] == size)

    def _may_follow(self, before: str, piece: str) -> bool:
        return self.stays_apart(before, piece) and (not before or self.stays_apart("", piece))

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether the model, given left + right, ends with these two pieces (with left empty: with right alone).

        Small: the neighbours whose join ranks first are joined, the leftmost first.
        """
        parts = list(left + right)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1e18) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1e18:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts == ([left, right] if left else [right])

    def _runs(self, segment: str) -> bytes:
        """A segment falls into runs between characters that no piece holds side by side."""
        inner = self.inner
        cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in inner]
        return b"".join(self._stream(segment[a:b]) for a, b in zip([0, *cuts], [*cuts, len(segment)]))

    def _stream(self, run: str) -> bytes:
        stream = Stream(self)
        ids = stream.feed(run)
        return np.array(ids + stream.finish(), np.int32).tobytes()

    def decoder(self) -> Decoder:
        return Decoder(self.raw, self.prefix)


class Decoder:
    """Texts of many id lists at once; ids outside the vocabulary count nothing, broken bytes become U+FFFD."""

    def __init__(self, raw: list[bytes], prefix: bool) -> None:
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([*map(len, raw), 0])
        self.at = np.concatenate(([0], np.cumsum(self.size[:-1])))
        self.prefix = prefix

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        ids = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        raw = self.data[np.arange(ends[-1]) + np.repeat(self.at[ids] - ends[:-1], size)].tobytes()
        out = []
        for a, b in zip(ends[offsets[:-1]], ends[offsets[1:]]):
            if self.prefix and raw[a : a + 1] == b" " and b > a:
                a += 1
            out.append(raw[a:b].decode("utf-8", "replace"))
        return out


_POWERS = Powers()
_BYTE = np.random.default_rng(2).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _point(points: np.ndarray) -> np.ndarray:
    """A random odd number for every code point."""
    return mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _letters_hash(points: np.ndarray) -> np.ndarray:
    n = points.shape[1]
    return mix((_point(points) * _POWERS.upto(n)[0][:n]).sum(1, dtype=np.uint64) + np.uint64(n))


class Stream:
    """Viterbi over the lattice of pieces, fed in any portions.

    A position is reached by a piece if its start is reached and the model keeps that piece apart from the one before it;
    the path to the position is then the model's encoding of the text so far.  Only the last ``longest``
    positions can start a later piece.  Where the backpointers of all of them meet, the ids before are final: they leave,
    and only the piece before the boundary is remembered.  So the window stays short however long the text is.
    """

    def __init__(self, vocabulary: Pieces) -> None:
        self.v = vocabulary
        self.before = ""
        self.text = ""
        self.back: list[int] = [0]  # start of the last piece of the path to each position; -1: not reached
        self.widest = 0

    def feed(self, text: str) -> list[int]:
        ids, out, at = self.v.ids, [], 0
        for i, char in enumerate(text):
            if char not in ids:
                # No piece holds it: what comes before is final.
                out += self._extend(text[at:i]) + self.finish()
                out += [self.v.byte[b] for b in char.encode("utf-8", "surrogatepass")]
                self.before, at = "", i + 1
        return out + self._extend(text[at:])

    def _extend(self, text: str) -> list[int]:
        v, out = self.v, []
        ids, longest, apart = v.ids, v.longest, v.apart
        self.text += text
        now, back, end = self.text, self.back, len(self.back)
        while end <= len(now):
            found = -1
            for start in range(end - longest if end > longest else 0, end):
                piece = now[start:end]
                if piece in ids and back[start] >= 0:
                    pair = (now[back[start] : start] if start else self.before, piece)
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) >= v.keep:
                            apart.clear()
                        ok = apart[pair] = v._may_follow(*pair)
                    if ok:
                        found = start
                        break
            back.append(found)
            if end > 2 * longest:
                self.widest = max(self.widest, end)
                out += self._commit(self._meeting())
                now, back, end = self.text, self.back, len(self.back) - 1
            end += 1
        return out

    def finish(self) -> list[int]:
        return self._commit(len(self.text))

    def _meeting(self) -> int:
        """The last boundary on the paths to all positions that a later piece can start from."""
        back = self.back
        alive = {i for i in range(len(back) - self.v.longest, len(back)) if back[i] >= 0}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last])
        return alive.pop()

    def _commit(self, end: int) -> list[int]:
        cuts, text, back = [end], self.text, self.back
        while cuts[-1] > 0:
            cuts.append(back[cuts[-1]])
        pieces = [text[a:b] for b, a in zip(cuts, cuts[1:])][::-1]
        if pieces:
            self.before = pieces[-1]
            self.text = text[end:]
            self.back = [0] + [b - end if b >= end else -1 for b in back[end + 1 :]]
        return [self.v.ids[p] for p in pieces]


def read_model(path: str) -> bytes:
    """The vocabulary file, read once on the driver (well under a megabyte) and sent along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """``(row, ids)`` for every row of docs: the row itself and the ids of its whole text; null for null, none for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = per_process(model, Pieces.load), Known()
        for batch in batches:
            for part in chunks(batch):
                ids, offsets = pieces.encode_all(part.column("text"), known)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=part.column("text").is_null())
                yield pa.RecordBatch.from_arrays([part.column("row"), lists], names=["row", "ids"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """``(row, text)`` for every row with an ``ids`` column: the row itself and the text of its ids; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_process(model, Pieces.load).decoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                # A null list may still span values: its own length counts.
                size = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                flat = pa.compute.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
                texts = pa.array(decoder.decode(flat, np.concatenate(([0], np.cumsum(size)))), pa.string())
                texts = pa.compute.if_else(ids.is_null(), pa.scalar(None, pa.string()), texts)
                yield pa.RecordBatch.from_arrays([part.column("row"), texts], names=["row", "text"])

    rows = rows.select(F.struct(*rows.columns).alias("row"), "ids")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string")
