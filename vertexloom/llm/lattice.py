"""Subword lattices of many words side by side, on flat byte arrays.

A word's lattice has a place before each of its bytes and one at its end; an arc is a piece that stands between two places. The pieces
are those of an existing vocabulary, with a space mark before the word, and single bytes for characters that have no piece. Windows of
each length a piece may have are hashed and looked up; as no piece holds a space mark but in front, no window runs on into the next
word. The recursions go from place to place for all words at once, in logarithms.
"""

import numpy as np

from .buffers import RangeHash

SPACE = "▁".encode()
_U = np.uint64


def _hash(parts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    return RangeHash(data, 3)(ends - [len(p) for p in parts], ends)


class Lookup:
    """Number of the piece with a given hash, or -1: a table of cells, then one for those that found their cell taken, and so on."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            shift = 64 - max(10, int(len(keys)).bit_length() + 2)
            cell = (keys * _U(2 * len(self.levels) + 1) >> _U(shift)).astype(np.int64)
            first = np.unique(cell, return_index=True)[1]
            known, found = np.zeros(1 << (64 - shift), np.uint64), np.full(1 << (64 - shift), -1, np.int32)
            known[cell[first]], found[cell[first]] = keys[first], values[first]
            self.levels.append((shift, known, found))
            keys, values = np.delete(keys, first), np.delete(values, first)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for level, (shift, known, found) in enumerate(self.levels):
            asked = keys[rest]
            cell = (asked * _U(2 * level + 1) >> _U(shift)).astype(np.int64)
            got = found[cell]
            same = (known[cell] == asked) & (got >= 0)
            out[rest[same]] = got[same]
            rest = rest[~same & (got >= 0)]
        return out


class Pieces:
    """The plain and byte pieces of a vocabulary file: `names` as bytes, the 256 single bytes last, and `rank`, the place of a piece in the vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = []
        for i in range(model.get_piece_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)):
                name = model.id_to_piece(i).encode()
                if SPACE not in name[1:]:
                    names.append((-model.get_score(i), name))
        names.sort()
        self.names = [n for _, n in names]
        self.size = len(self.names) + 256
        keys, sizes = _hash(self.names), np.array([len(n) for n in self.names])
        at = np.arange(len(keys), dtype=np.int32)
        self.by_size = {int(s): Lookup(keys[sizes == s], at[sizes == s]) for s in np.unique(sizes)}

    def arcs(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all arcs in the words of a buffer that begin at `first`, each with its space mark; sorted by end."""
        hashed, starts, ends, found = RangeHash(data, 3), [], [], []
        opens = np.zeros(len(data) + 1, bool)
        opens[first] = True
        mark = np.zeros(len(data), bool)
        mark[:-2] = (data[:-2] == SPACE[0]) & (data[1:-1] == SPACE[1]) & (data[2:] == SPACE[2])
        inner = mark & ~opens[:-1]  # a space mark that the text itself has is spelled in bytes
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        size = 1 + (data[lead] >= 0xC0).astype(np.int64) + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        spelled = np.ones(len(data), bool)  # characters, at their first byte, that have no piece
        for width, lookup in self.by_size.items():
            at = lead[lead + width <= len(data)]
            at = at[~inner[at]]
            piece = lookup(hashed(at, at + width))
            at, piece = at[piece >= 0], piece[piece >= 0]
            starts.append(at)
            ends.append(at + width)
            found.append(piece)
            spelled[at[size[np.searchsorted(lead, at)] == width]] = False
        alone = spelled[lead]
        place = np.repeat(lead[alone], size[alone])
        place = place + np.arange(len(place)) - np.repeat(np.cumsum(size[alone]) - size[alone], size[alone])
        starts.append(place)
        ends.append(place + 1)
        found.append(len(self.names) + data[place].astype(np.int32))
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(found)
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]


def _steps(depth: np.ndarray):
    """Runs of arcs (sorted by depth) that may be taken together: the places they meet are equally far into their words."""
    bounds = np.flatnonzero(np.diff(depth, prepend=-1))
    return zip(bounds, np.append(bounds[1:], len(depth)))


def forward(start, end, weight, first, length) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of the summed weight of all paths to each place, by the place's byte; and, by word, of all paths through it.

    weight: log weights of the arcs. Places that no path reaches have -inf. A word's first place is shared with the last one of
    the word before, so its own paths start from 0 there.
    """
    alpha = np.full(int(first[-1] + length[-1]) + 1 if len(first) else 1, -np.inf)
    word = np.searchsorted(first, start, "right") - 1
    depth = end - first[word]
    order = np.argsort(depth, kind="stable")
    begins = start == first[word]
    for lo, hi in _steps(depth[order]):
        at = order[lo:hi]
        value = np.where(begins[at], 0.0, alpha[start[at]]) + weight[at]
        into, heads = end[at], np.flatnonzero(np.diff(end[at], prepend=-1))
        alpha[into[heads]] = np.logaddexp.reduceat(value, heads)
    return alpha, alpha[first + length]


def expected(start, end, piece, weight, first, length, times, size: int) -> tuple[np.ndarray, float]:
    """Expected number of uses of each piece over all segmentations of the words, `times` each; and the log-likelihood."""
    alpha, total = forward(start, end, weight, first, length)
    beta = np.full(len(alpha), -np.inf)
    word = np.searchsorted(first, start, "right") - 1
    stop = first + length
    back = stop[word] - start
    order = np.argsort(back, kind="stable")
    closes = end == stop[word]
    for lo, hi in _steps(back[order]):
        at = order[lo:hi]
        at = at[np.argsort(start[at], kind="stable")]
        value = np.where(closes[at], 0.0, beta[end[at]]) + weight[at]
        out, heads = start[at], np.flatnonzero(np.diff(start[at], prepend=-1))
        beta[out[heads]] = np.logaddexp.reduceat(value, heads)
    share = np.where(start == first[word], 0.0, alpha[start]) + weight + np.where(closes, 0.0, beta[end]) - total[word]
    return np.bincount(piece, np.exp(share) * times[word], size), float(total @ times)
