"""SentencePiece (byte-pair) encoding with seeded merge-dropout, and decoding without loss.

Encoding follows the model's agenda: the candidate merge with the best score, and of equal ones the leftmost, is taken
out first. With dropout it is skipped when a hash of (seed, the row's key, the number of the segment in the text, the
merge's place, split and piece) falls below the rate, so that a row that is encoded again gives the same pieces, and the
same word gives other pieces elsewhere. With rate 0 the pieces are the library's. Pieces never go on from a letter
into a space mark; so a text falls into segments (spaces and the word after them) that are encoded apart.

All segments of a slice of texts run their agendas side by side: a column of a matrix is a segment, and each round
takes every segment's best candidate, skips or merges it and states the two new candidates beside it. Segments that
have no candidate left drop out; the few very long ones run one by one. Memory goes with the slice, not with the
number of different words.

Defined cases: both functions make a column from a column, so a table keeps its rows, none or repeated ones, and other columns, whatever their names; a null text has null pieces, which decode to null; an empty one has none and decodes to an empty one;
characters without a piece, and the space mark itself when it stands in a text, become byte pieces. Ids that the
model doesn't have, or null, decode like the unknown piece; bytes that aren't UTF-8 decode to U+FFFD.
"""

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .buffers import flat, list_array, mix, runs, slices

SPACE = "▁"
RATE, SEED = 0.1, 17
_COMMON = 512
LONGEST = 62  # symbols of a segment that takes part in the rounds
_NONE = np.iinfo(np.int32).max
_SEGMENT = re.compile(rf" *[^ {SPACE}]+|{SPACE}| +")
_U = np.uint64
_MASK = 2**64 - 1


def _mix(x: int) -> int:
    """buffers.mix for one number."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


class PairTable:
    """Piece that two neighbouring pieces make, or -1: hash tables, of which a later one has what an earlier one had no cell for."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int64)
        self.levels = []
        while len(keys):
            bits = max(8, int(len(keys)).bit_length() + 1)
            cell = self._cell(keys, bits, len(self.levels))
            first = np.unique(cell, return_index=True)[1]
            table = np.full((2, 1 << bits), -1, np.int64)
            table[0, cell[first]], table[1, cell[first]] = keys[first], values[first]
            self.levels.append((bits, table[0].copy(), table[1].astype(np.int32)))
            keys, values = np.delete(keys, first), np.delete(values, first)

    @staticmethod
    def _cell(keys: np.ndarray, bits: int, level: int) -> np.ndarray:
        return ((keys.view(np.uint64) * _U(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E018 * level & _MASK | 1)) >> _U(64 - bits)).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(len(keys), -1, np.int32)
        rest = None
        for level, (bits, known, values) in enumerate(self.levels):
            asked = keys if rest is None else keys[rest]
            cell = self._cell(asked, bits, level)
            got = known[cell]
            found = got == asked
            if rest is None:
                out = np.where(found, values[cell], np.int32(-1))
                rest = np.flatnonzero(~found & (got >= 0))  # an empty cell ends the search
            else:
                out[rest[found]] = values[cell[found]]
                rest = rest[~found & (got >= 0)]
            if not len(rest):
                break
        return out


class Vocabulary:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("the model has pieces that go on from a letter into a space")
        self.ids = {names[i]: i for i in plain}
        self.scores = [model.get_score(i) for i in range(n)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        raw = [b""] * n
        for i in plain:
            raw[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        raw[self.unknown] = " ⁇ ".encode()
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        # by piece: the place of its score among all scores, with six bits for a place in a segment; the last entry is that of no piece
        worse = np.unique([-self.scores[i] for i in plain])
        self.order = np.full(n + 1, _NONE, np.int32)
        self.order[plain] = np.searchsorted(worse, [-self.scores[i] for i in plain]) << 6
        self.pairs = PairTable({(self.ids[p[:k]], self.ids[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids})
        # symbols of single characters: the piece, or n + the code point where there is none
        self.symbols = np.arange(0x110000, dtype=np.int32) + n
        for p, i in self.ids.items():
            if len(p) == 1 and p != SPACE:
                self.symbols[ord(p)] = i
        self.symbols[ord(" ")] = self.ids.get(SPACE, n + ord(" "))
        self.size = n
        # the pairs of common characters, which are most of those that a text starts with
        self.common = self.pairs(np.repeat(self.symbols[:_COMMON], _COMMON), np.tile(self.symbols[:_COMMON], _COMMON))

    def starting_pairs(self, points: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The piece of each character with the next one, or -1; of the last one, -1."""
        out = np.full(len(points), -1, np.int32)
        if len(points) > 1:
            a, b = points[:-1], points[1:]
            out[:-1] = self.common[np.minimum(a, _COMMON - 1) * np.uint32(_COMMON) + np.minimum(b, _COMMON - 1)]
            rare = np.flatnonzero((a >= _COMMON) | (b >= _COMMON))
            out[rare] = self.pairs(symbols[rare], symbols[rare + 1])
        return out

    def final(self, symbol: str) -> list[int]:
        i = self.ids.get(symbol)
        return [i] if i is not None else [self.byte_ids[b] for b in symbol.encode()]

    def agenda(self, segment: str, skip) -> list[int]:
        """The pieces of a segment (spaces as marks)."""
        return [i for s in self.merged(segment, skip) for i in self.final(s)]

    def merged(self, segment: str, skip) -> list[str]:
        """The symbols that are left when the agenda is empty. skip(key) tells whether the candidate with this key is skipped."""
        ids, scores = self.ids, self.scores
        symbols: list = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def candidate(left, right):
            piece = ids.get(symbols[left] + symbols[right])
            if piece is not None:
                heapq.heappush(heap, (-scores[piece], left, right, piece, len(symbols[left]) + len(symbols[right])))

        for i in range(n - 1):
            candidate(i, i + 1)
        while heap:
            _, left, right, piece, size = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            if skip is not None and skip((left << 40) ^ (right << 20) ^ piece):
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            if before[left] >= 0:
                candidate(before[left], left)
            if after[left] >= 0:
                candidate(left, after[left])
        return [s for s in symbols if s]


def segments(text: str) -> list[str]:
    """A space goes before the text, as the model wants it."""
    return _SEGMENT.findall(" " + text) if text else []


class Encoder:
    def __init__(self, vocabulary: Vocabulary, rate: float, seed: int):
        self.vocabulary, self.seed = vocabulary, seed
        self.limit = int(rate * 2**32)
        self.mark = [vocabulary.byte_ids[b] for b in SPACE.encode()]

    def pieces(self, segment: str, place: int) -> list[int]:
        """One segment by the agenda itself; `place` is the hash of where it stands."""
        if segment == SPACE:
            return self.mark
        skip = (lambda key: _mix(place ^ key) >> 32 < self.limit) if self.limit else None
        return self.vocabulary.agenda(segment.replace(" ", SPACE), skip)

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the pieces of all texts, and the number of each text's first. keys: a hash of each row's key."""
        known = self.vocabulary
        whole = "".join(" " + t for t in texts if t)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        ends = np.cumsum(sizes)
        space, literal = points == 0x20, points == ord(SPACE)
        begins = np.ones(len(points), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | literal[1:] | literal[:-1]
        begins[ends[ends < len(points)]] = True
        start = np.flatnonzero(begins)
        size = np.diff(start, append=len(points))
        first = np.searchsorted(start, ends - sizes)  # a text's first segment
        row = np.repeat(np.arange(len(texts)), np.diff(first, append=len(start)))
        place = mix(mix(keys.astype(np.int64).view(np.uint64), self.seed)[row] + (np.arange(len(start)) - first[row]).astype(np.uint64))
        symbols = known.symbols[points]
        symbols[literal] = known.size + ord(SPACE)
        pair = known.starting_pairs(points, symbols)
        pair[start[1:] - 1] = -1
        alive = np.ones(len(points), bool)
        widths = [2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 22, 32, LONGEST]
        for narrow, wide in zip([1, *widths], widths):
            chosen = np.flatnonzero((size > narrow) & (size <= wide))
            for part in np.array_split(chosen, len(chosen) // 20_000 + 1):
                self._rounds(symbols, pair, alive, start[part], size[part], place[part], wide)
        for i in np.flatnonzero(size > LONGEST).tolist():
            a, b = int(start[i]), int(start[i] + size[i])
            mine = self._merged_symbols(whole[a:b], int(place[i]))
            symbols[a : a + len(mine)] = mine
            alive[a + len(mine) : b] = False
        at = np.flatnonzero(alive)
        symbols = symbols[at]
        texts_first = np.searchsorted(at, np.concatenate([[0], ends]))
        return self._with_bytes(symbols, texts_first)

    def _merged_symbols(self, segment: str, place: int) -> list[int]:
        """The symbols of one segment, characters without a piece as they are."""
        skip = (lambda key: _mix(place ^ key) >> 32 < self.limit) if self.limit else None
        ids, n = self.vocabulary.ids, self.vocabulary.size
        return [ids[s] if s in ids else n + ord(s) for s in self.vocabulary.merged(segment.replace(" ", SPACE), skip)]

    def _rounds(self, symbols, pair, alive, start, size, place, wide):
        """All agendas of segments of up to `wide` symbols; the results go into symbols and alive.

        Row i of the matrices is the i-th symbol of each segment, a column is a segment; they are addressed as flat arrays.
        """
        known, n = self.vocabulary, len(start)
        if not n:
            return
        lane = np.arange(wide, dtype=np.int64)[:, None]
        at = start + np.minimum(lane, size - 1)
        symbol = symbols[at]
        piece = np.where(lane < size - 1, pair[at], np.int32(-1))
        best = known.order[piece] | lane.astype(np.int32)
        after = np.where(lane < size - 1, lane + 1, wide).astype(np.int8)
        before = np.ascontiguousarray(np.broadcast_to(lane - 1, at.shape).astype(np.int8))
        while True:
            top = best.min(0)
            c = np.flatnonzero(top != _NONE)
            if not len(c):
                break
            top = top[c]
            if len(c) < 0.8 * n:
                symbol, piece, best, after, before = (x.take(c, 1) for x in (symbol, piece, best, after, before))  # in row order, so that reshape gives views
                place, start, n = place[c], start[c], len(c)
                c = np.arange(n)
            s_, p_, b_, a_, f_ = (x.reshape(-1) for x in (symbol, piece, best, after, before))
            left = (top & 63).astype(np.int64)
            li = left * n + c
            right, made = a_[li].astype(np.int64), p_[li]
            b_[li] = _NONE
            if self.limit:
                key = (left << 40) ^ (right << 20) ^ made
                taken = np.flatnonzero((mix(place[c] ^ key.view(np.uint64)) >> _U(32)) >= _U(self.limit))
                c, left, right, made, li = c[taken], left[taken], right[taken], made[taken], li[taken]
            ri = right * n + c
            s_[li] = made
            b_[ri] = _NONE
            where = start[c]
            symbols[where + left] = made
            alive[where + right] = False
            following, previous = a_[ri], f_[li]
            a_[li] = following
            some = np.flatnonzero(following < wide)
            fi = following[some].astype(np.int64) * n + c[some]
            f_[fi] = left[some]
            other = np.flatnonzero(previous >= 0)
            prior = previous[other].astype(np.int64)
            first, second = np.concatenate([li[some], prior * n + c[other]]), np.concatenate([fi, li[other]])
            fresh = known.pairs(s_[first], s_[second])
            p_[first] = fresh
            b_[first] = known.order[fresh] | np.concatenate([left[some], prior]).astype(np.int32)

    def _with_bytes(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        strange = np.flatnonzero(symbols >= self.vocabulary.size)
        if not len(strange):
            return symbols, first
        spelled = [chr(x - self.vocabulary.size).encode() for x in symbols[strange].tolist()]
        count = np.ones(len(symbols), np.int64)
        count[strange] = [len(x) for x in spelled]
        out = np.repeat(symbols, count)
        ends = np.cumsum(count)
        at = np.repeat(ends[strange] - count[strange], count[strange]) + runs(count[strange])
        out[at] = np.array(self.vocabulary.byte_ids, np.int32)[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.concatenate([[0], ends])[first]


def decode(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """The texts of runs of ids; -1 and other ids that the model doesn't have are unknown."""
    ids = np.where((ids < 0) | (ids >= len(vocabulary.sizes)), vocabulary.unknown, ids)
    sizes = vocabulary.sizes[ids]
    data = vocabulary.data[np.repeat(vocabulary.starts[ids], sizes) + runs(sizes)].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes)])[first]
    return [data[a:b].decode("utf-8", "replace").removeprefix(" ") if b > a else "" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


_loaded: dict = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _encoder(path: str, rate: float, seed: int) -> Encoder:
    if (path, rate, seed) not in _loaded:
        _loaded[path, rate, seed] = Encoder(vocabulary(path), rate, seed)
    return _loaded[path, rate, seed]


def encoded(text: str | Column, key: str | Column, path: str, rate: float = RATE, seed: int = SEED) -> Column:
    """array<int> of piece ids. `path` names the model file on every executor, `key` tells rows apart."""
    @arrow_udf("array<int>")
    def encode_texts(texts: pa.Array, keys: pa.Array) -> pa.Array:
        encoder, out = _encoder(path, rate, seed), []
        batch = pa.RecordBatch.from_arrays([texts, keys], names=["text", "key"])
        for part in slices(iter([batch]), "text"):
            column = part.column("text")
            ids, first = encoder.encode([t or "" for t in column.to_pylist()], part.column("key").to_numpy(zero_copy_only=False))
            made = list_array(first, ids, pa.int32())
            out.append(pa.ListArray.from_arrays(made.offsets, made.values, mask=column.is_null()) if column.null_count else made)
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    key = F.col(key) if isinstance(key, str) else key
    return encode_texts(text, F.xxhash64(key))


def decoded(ids: str | Column, path: str) -> Column:
    """The text of an array of piece ids."""
    @arrow_udf("string")
    def decode_ids(column: pa.Array) -> pa.Array:
        known, out = vocabulary(path), []
        for a in range(0, len(column), 500):
            part = column.slice(a, 500)
            values, offsets = part.flatten(), np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = decode(known, values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), offsets)
            out.append(pa.array(texts, pa.string(), mask=part.is_null().to_numpy(zero_copy_only=False)))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return decode_ids(ids)


def with_pieces(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", key_col: str = "doc_id", rate: float = RATE, seed: int = SEED) -> DataFrame:
    """The columns `keep` of docs with ids (as by `encoded`) and lossless, whether they decode to the text. A task holds the pieces of one slice of texts.

    A column of docs named ids or lossless can't be kept, as the result has these names.
    """
    if {"ids", "lossless"} & set(keep):
        raise ValueError("ids and lossless are names of the result")
    rows = docs.select(*[F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text"), F.xxhash64(key_col).alias("key"))

    def run(batches):
        encoder, known = _encoder(path, rate, seed), vocabulary(path)
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            ids, first = encoder.encode([t or "" for t in texts], part.column("key").to_numpy(zero_copy_only=False))
            back = decode(known, ids.astype(np.int64), first)
            made, none = list_array(first, ids, pa.int32()), part.column("text").is_null()
            yield pa.RecordBatch.from_arrays([*(part.column(f"kept{i}") for i in range(len(keep))), pa.ListArray.from_arrays(made.offsets, made.values, mask=none),
                                              pa.array([a is None or a == b for a, b in zip(texts, back)])], names=[*(f"kept{i}" for i in range(len(keep))), "ids", "lossless"])

    kinds = T.StructType([*(T.StructField(f"kept{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    made = rows.mapInArrow(run, kinds)
    return made.select(*[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)], "ids", "lossless")
