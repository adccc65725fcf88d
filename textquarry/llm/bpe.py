"""Byte-level BPE in numpy: vectorised pre-split, padded-matrix merges, piece cache.

One :class:`ByteBpe` lives per Python worker.  Texts arrive as one UTF-8 buffer with
offsets (the Arrow layout), so no Python object is made per text or per piece.

* ``split`` finds the pre-split boundaries of all texts at once from a table of
  character classes.
* ``encode_pieces`` merges distinct pieces: pieces are bucketed by length into padded
  matrices; each round every row merges its leftmost pair of minimum rank (looked up in
  a hash table of pairs); finished rows are compacted away.
* results per distinct piece are kept in a bounded hash table, so a piece is merged once
  per worker, however often it occurs.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np

DEFAULT_TOKENIZER_DIR = os.environ.get("TEXTQUARRY_TOKENIZERS", "/opt/tokenizers")
NO_RANK = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
_CHUNK_BYTES = 2_000_000
_CACHE_PIECES = 400_000
_CACHE_TOKENS = 6_000_000
#: Rows longer than this merge every occurrence of their lowest pair in one round.
_LONG_PIECE = 256


def _mix(keys: np.ndarray) -> np.ndarray:
    k = keys.astype(np.uint64)
    k = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return k ^ (k >> np.uint64(29))


class HashIndex:
    """Open-addressing map from uint64 to int32, looked up and filled by whole arrays."""

    def __init__(self, bits: int):
        self.bits = bits
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        self.used = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where it is absent."""
        slot = (_mix(keys) & self.mask).astype(np.int64)
        out = self.values[slot]
        pending = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(pending):
            slot[pending] = (slot[pending] + 1) & int(self.mask)
            s = slot[pending]
            v = self.values[s]
            out[pending] = v
            pending = pending[(v >= 0) & (self.keys[s] != keys[pending])]
        return out

    def insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are absent."""
        if self.used + len(keys) > (1 << self.bits) // 2:
            old = self.values >= 0
            old_keys, old_values = self.keys[old], self.values[old]
            grown = HashIndex(max(self.bits + 1, int(self.used + len(keys)).bit_length() + 1))
            grown.insert(old_keys, old_values)
            self.__dict__.update(grown.__dict__)
        slot = (_mix(keys) & self.mask).astype(np.int64)
        pending = np.arange(len(keys))
        while len(pending):
            s = slot[pending]
            free = self.values[s] < 0
            _, first = np.unique(s, return_index=True)
            win = np.zeros(len(pending), bool)
            win[first] = True
            win &= free
            self.keys[s[win]] = keys[pending[win]]
            self.values[s[win]] = values[pending[win]]
            pending = pending[~win]
            slot[pending] = (slot[pending] + 1) & int(self.mask)
        self.used += len(keys)


def _char_classes() -> np.ndarray:
    import regex

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = m.span()
            lo, hi = ord(everything[a]), ord(everything[b - 1])
            table[lo : hi + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


class PieceHash:
    """62-bit hashes of the pieces of a buffer, from two polynomials modulo 2**31 - 1.

    The bases and the values of the bytes are drawn anew in every process, so no text can
    be made to collide; two pieces of n bytes share a hash with a chance below (n / 2**30)**2.
    """

    PRIME = 2**31 - 1
    STEP = 1 << 14

    def __init__(self):
        rng = np.random.default_rng()
        self._letters = [rng.integers(1, self.PRIME, 256).astype(np.uint64) for _ in range(2)]
        self._bases = [int(b) for b in rng.integers(1 << 20, self.PRIME - 1, 2)]
        self._powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in range(2)]

    def _grow(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, at least ``n`` of each."""
        p = self.PRIME
        up, down = self._powers[k]
        if len(up) < n:
            base = self._bases[k]
            while len(up) < n:
                more = len(up)
                up = np.concatenate([up, up * np.uint64(pow(base, more, p)) % np.uint64(p)])
                down = np.concatenate([down, down * np.uint64(pow(base, -more, p)) % np.uint64(p)])
            self._powers[k] = (up, down)
        return up, down

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.empty(len(bounds) - 1, np.uint64)
        # some pieces at a time, so that all arrays stay in the cache
        cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(bounds[0], bounds[-1], self.STEP)), len(out))) if len(out) else np.zeros(1, np.int64)
        for x, y in zip(cuts[:-1], cuts[1:]):
            own = bounds[x : y + 1]
            out[x:y] = self._some(data[own[0] : own[-1]], own - own[0])
        return out

    def _some(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        a, b = bounds[:-1], bounds[1:]
        prime, bits = np.uint64(self.PRIME), np.uint64(31)
        out = np.zeros(len(a), np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        for k in range(2):
            up, down = self._grow(k, len(data) + 1)
            part = self._letters[k][data]
            part *= up[: len(data)]
            # below 2**32 and the same modulo the prime
            high = part >> bits
            part &= prime
            part += high
            np.cumsum(part, out=total[1:])
            out <<= bits
            out |= (total[b] - total[a]) % prime * down[a] % prime
        return out


@dataclass
class Encoded:
    """Tokens of a run of texts; offsets have one entry more than there are texts."""

    ids: np.ndarray
    offsets: np.ndarray  # into ids, by text
    piece_token_start: np.ndarray  # into ids, by pre-split piece
    piece_byte_start: np.ndarray  # into the buffer, by pre-split piece, one more at the end


class ByteBpe:
    """Encoder of a byte-level BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, byte_id: np.ndarray, merges: list[tuple[int, int, int]], token_bytes: np.ndarray):
        """``byte_id``: id of each byte; ``merges``: (left, right, joined) ids by rank; ``token_bytes``: bytes of each id."""
        self.byte_id, self.token_bytes = byte_id, token_bytes
        table = np.array(merges, np.int64).reshape(-1, 3)
        self.merged = table[:, 2].astype(np.int32)
        self.pairs = HashIndex(18)
        self.pairs.insert((table[:, 0].astype(np.uint64) << np.uint64(20)) | table[:, 1].astype(np.uint64), np.arange(len(table), dtype=np.int32))
        self.classes = _char_classes()
        self._hash = PieceHash()
        self._reset()

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in printable}
        for n, b in enumerate(x for x in range(256) if x not in names):
            names[b] = chr(256 + n)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        back = {v: k for k, v in names.items()}
        token_bytes = np.zeros(max(vocab.values()) + 1, np.int32)
        for token, i in vocab.items():
            token_bytes[i] = len(token) if all(c in back for c in token) else 0
        return cls(np.array([vocab[names[b]] for b in range(256)], np.int32), [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], token_bytes)

    @classmethod
    def of_bytes(cls, offset: int = 4) -> ByteBpe:
        """The byte tokenizer: ids are bytes plus an offset, and no pair merges."""
        ids = np.arange(256, dtype=np.int32) + offset
        sizes = np.zeros(256 + offset, np.int32)
        sizes[ids] = 1
        return cls(ids, [], sizes)

    def _reset(self) -> None:
        self.index = HashIndex(17)
        self.n_pieces, self.n_tokens = 0, 0
        self.tok_start = np.zeros(1 << 14, np.int64)
        self.tok_len = np.zeros(1 << 14, np.int32)
        self.tokens = np.zeros(1 << 16, np.int32)

    # -- pre-split ---------------------------------------------------------------------

    def layout(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By character: byte position, code point, and whether a piece starts there."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        b0 = b[at]
        cp = b0.copy()
        two = np.flatnonzero(b0 >= 0xC0)
        if len(two):
            p, v0 = at[two], b0[two]
            b1 = b[p + 1] & 63
            v = ((v0 & 0x1F) << 6) | b1
            three = np.flatnonzero(v0 >= 0xE0)
            if len(three):
                p3 = p[three]
                b2 = b[p3 + 2] & 63
                v[three] = ((v0[three] & 0x0F) << 12) | (b1[three] << 6) | b2
                four = np.flatnonzero(v0[three] >= 0xF0)
                if len(four):
                    t4 = three[four]
                    v[t4] = ((v0[t4] & 0x07) << 18) | (b1[t4] << 12) | (b2[four] << 6) | (b[p3[four] + 3] & 63)
            cp[two] = v
        cls = self.classes[np.minimum(cp, 0x10FFFF)]
        n = len(cp)
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        text_start = first[:-1][at]
        start = np.empty(n, bool)
        start[0] = True
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        start |= text_start
        space = cls == SPACE
        # the last white space before a non-space of the same text stands alone or joins it
        join = np.zeros(n, bool)
        join[:-1] = space[:-1] & ~space[1:] & ~text_start[1:]
        start |= join
        blank = np.flatnonzero(join & (cp == 32))
        start[blank + 1] = False
        # contractions: an apostrophe that starts a piece, followed by s t m d re ve ll
        quote = np.flatnonzero(start & (cp == 39))
        if len(quote):
            pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
            fresh = np.concatenate([text_start, np.ones(3, bool)])
            c1 = np.where(fresh[quote + 1], 0, pad[quote + 1])
            c2 = np.where((c1 == 0) | fresh[quote + 2], 0, pad[quote + 2])
            one = np.isin(c1, [ord(c) for c in "stmd"])
            pair = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            took = np.where(one, 1, np.where(pair, 2, 0))
            q, k = quote[took > 0], took[took > 0]
            start[q + 1] = False
            after = q + k + 1
            after = after[after < n]
            start[after] |= cls[after] == LETTER
        return at, cp, start

    def split(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte position where each piece starts.  ``offsets``: byte bounds of the texts."""
        at, _, start = self.layout(data, offsets)
        return at[start]

    def _hashes(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self._hash(data, bounds)

    # -- merges ------------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; negative symbols are padding."""
        key = (np.maximum(a, 0).astype(np.uint64) << np.uint64(20)) | np.maximum(b, 0).astype(np.uint64)
        r = self.pairs.find(key.ravel()).reshape(key.shape)
        return np.where((r < 0) | (a < 0) | (b < 0), NO_RANK, r)

    def _merge_matrix(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all rows of a padded matrix to the end; rows are returned padded by -1."""
        rows, width = m.shape
        out = np.full((rows, width), -1, np.int32)
        if width == 1:
            out[:] = m
            return out, np.ones(rows, np.int64)
        live = np.arange(rows)
        rank = self._ranks(m[:, :-1], m[:, 1:])
        while len(live):
            j = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, j]
            done = best == NO_RANK
            if done.any():
                out[live[done], : m.shape[1]] = m[done]
                keep = ~done
                live, m, rank, j, best = live[keep], m[keep], rank[keep], j[keep], best[keep]
                if not len(live):
                    break
                used = int((m >= 0).sum(1).max())
                m, rank = np.ascontiguousarray(m[:, :used]), np.ascontiguousarray(rank[:, : used - 1])
                row = np.arange(len(live))
            w = m.shape[1]
            col = np.arange(w)
            right = np.concatenate([m[:, 1:], np.full((len(m), 1), -1, np.int32)], 1)
            m = np.where(col[None, :] <= j[:, None], m, right)
            m[row, j] = self.merged[best]
            rank_right = np.concatenate([rank[:, 1:], np.full((len(m), 1), NO_RANK, np.int32)], 1)
            rank = np.where(np.arange(w - 1)[None, :] <= j[:, None], rank, rank_right)
            ahead = np.minimum(j + 1, w - 1)
            last = j == w - 1
            inside = np.minimum(j, w - 2)
            rank[row, inside] = np.where(last, rank[row, inside], self._ranks(m[row, inside], m[row, ahead]))
            before = np.flatnonzero(j > 0)
            if len(before):
                jb = j[before]
                rank[before, jb - 1] = self._ranks(m[before, jb - 1], m[before, jb])
        return out, (out >= 0).sum(1)

    def _merge_long(self, s: np.ndarray) -> np.ndarray:
        """Merge one long piece: every non-overlapping occurrence of the lowest pair at once.

        A merge only makes pairs of higher rank than its own, so this equals merging the
        leftmost one again and again.
        """
        while len(s) > 1:
            rank = self._ranks(s[:-1], s[1:])
            best = rank.min()
            if best == NO_RANK:
                break
            hit = rank == best
            # in a run of overlapping hits every second one counts
            at = np.flatnonzero(hit)
            run = np.cumsum(np.concatenate([[1], (np.diff(at) != 1).astype(np.int64)]))
            firsts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
            at = at[(np.arange(len(at)) - firsts[run - 1]) % 2 == 0]
            s[at] = self.merged[best]
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            s = s[keep]
        return s

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and flat tokens of pieces, in the order given."""
        n = len(start)
        counts = np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in sorted({*range(1, 17), 20, 24, 32, 48, 64, 96, 128, 192, _LONG_PIECE}):
            low = {20: 17, 24: 21, 32: 25, 48: 33, 64: 49, 96: 65, 128: 97, 192: 129, _LONG_PIECE: 193}.get(width, width)
            pick = np.flatnonzero((length >= low) & (length <= width))
            for part in np.array_split(pick, max(1, len(pick) * width // 2_000_000)):
                if not len(part):
                    continue
                col = np.arange(width)
                pos = np.minimum(start[part][:, None] + col, len(data) - 1)
                m = np.where(col < length[part][:, None], self.byte_id[data[pos]], -1).astype(np.int32)
                out, k = self._merge_matrix(m)
                counts[part] = k
                parts.append((part, out, k))
        longs = []
        for i in np.flatnonzero(length > _LONG_PIECE):
            s = self._merge_long(self.byte_id[data[start[i] : start[i] + length[i]]].copy())
            counts[i] = len(s)
            longs.append((i, s))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(bounds[-1], np.int32)
        for part, out, k in parts:
            flat[np.repeat(bounds[part], k) + _ragged(k)] = out[out >= 0]
        for i, s in longs:
            flat[bounds[i] : bounds[i + 1]] = s
        return counts, flat

    def _lookup(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number, in the cache, of each piece; unknown pieces are merged and added."""
        if self.n_pieces > _CACHE_PIECES or self.n_tokens > _CACHE_TOKENS:
            self._reset()
        keys = self._hashes(data, bounds)
        found = self.index.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            src = new[first]
            counts, flat = self.encode_pieces(data, bounds[:-1][src], bounds[1:][src] - bounds[:-1][src])
            base, tokens = self.n_pieces, self.n_tokens
            self.n_pieces, self.n_tokens = base + len(src), tokens + len(flat)
            for name, need in (("tok_start", self.n_pieces), ("tok_len", self.n_pieces), ("tokens", self.n_tokens)):
                have = getattr(self, name)
                if len(have) < need:
                    setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have)), have.dtype)]))
            self.tok_start[base : self.n_pieces] = tokens + np.cumsum(counts) - counts
            self.tok_len[base : self.n_pieces] = counts
            self.tokens[tokens : self.n_tokens] = flat
            self.index.insert(distinct, np.arange(base, self.n_pieces, dtype=np.int32))
            found[new] = self.index.find(keys[new])
        return found

    # -- whole texts -------------------------------------------------------------------

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.split(data, offsets)
        bounds = np.append(start, len(data))
        return bounds, self._lookup(data, bounds)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        bounds, number = self._pieces(data, offsets)
        total = np.concatenate([[0], np.cumsum(self.tok_len[number], dtype=np.int64)])
        by_text = np.searchsorted(bounds[:-1], offsets)
        return np.diff(total[by_text])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Encoded:
        bounds, number = self._pieces(data, offsets)
        length = self.tok_len[number].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.tokens[np.repeat(self.tok_start[number] - total[:-1], length) + np.arange(total[-1])]
        return Encoded(ids, total[np.searchsorted(bounds[:-1], offsets)], total[:-1], bounds)


def _ragged(lengths: np.ndarray) -> np.ndarray:
    """0..k-1 for each k, one after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - lengths, lengths)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; a null counts as an empty text."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, size: int = _CHUNK_BYTES):
    """Ranges of texts of about ``size`` bytes each; a text is never divided."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


#: Name of the tokenizer whose ids are bytes.
BYTES = "bytes"
_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, or of :data:`BYTES`, one per worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe.of_bytes() if path == BYTES else ByteBpe.load(path)
    return _loaded[path]


def byte_bpe_50k(tokenizer_dir: str | None = None) -> str:
    return os.path.join(tokenizer_dir or DEFAULT_TOKENIZER_DIR, "byte_bpe_50k.json")
