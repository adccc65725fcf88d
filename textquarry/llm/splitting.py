"""Splitting texts over a token limit at natural boundaries (balanced targets)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textquarry.llm.bpe import ByteBpe, byte_bpe_50k, chunks, text_buffer, tokenizer

#: Strengths of a cut: paragraph, line, sentence, clause, white space, pre-split piece, any character.
PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, PIECE, CHARACTER = 6, 5, 4, 3, 2, 1, 0
_SENTENCE_END = np.array([ord(c) for c in ".!?…。！？ฯ"], np.uint32)
_CLAUSE_END = np.array([ord(c) for c in ",;:，；、)]}"], np.uint32)
_CLOSING = np.array([ord(c) for c in "\"'”’)]»"], np.uint32)
_THAI_LEADING = np.array([0xE40, 0xE41, 0xE42, 0xE43, 0xE44], np.uint32)


def _marks() -> np.ndarray:
    import sys
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)])


#: Plans of a text at equal distances before it is cut piece by piece.
_ROUNDS = 24

_mark_table: list[np.ndarray] = []


@dataclass
class _Layout:
    """Cut places of a run of texts, by token number."""

    tokens: np.ndarray  # first token of each text, one more at the end
    byte_of: np.ndarray  # byte where each token starts, one more at the end
    starts: np.ndarray  # tokens where a pre-split piece starts
    aligned: np.ndarray  # for each token the nearest one at or before it that starts a character
    by_strength: dict[int, np.ndarray]  # tokens where a cut of this strength may end a piece


def _lay_out(bpe: ByteBpe, data: np.ndarray, off: np.ndarray) -> _Layout:
    e = bpe.encode(data, off)
    byte_of = np.concatenate([[0], np.cumsum(bpe.token_bytes[e.ids], dtype=np.int64)])
    lead = np.append((data & 0xC0) != 0x80, True)
    number = np.arange(len(byte_of))
    aligned = np.maximum.accumulate(np.where(lead[byte_of], number, 0))
    at, cp, start = bpe.layout(data, off)
    if not _mark_table:
        _mark_table.append(_marks())
    space = bpe.classes[np.minimum(cp, 0x10FFFF)] == 3
    n = len(cp)
    before = np.concatenate([[0], cp[:-1]]).astype(np.uint32)
    space_before = np.concatenate([[True], space[:-1]])
    legal = start & ~space_before  # a run of white space goes whole to the next piece
    place = np.flatnonzero(legal)
    where = np.searchsorted(byte_of, at[place])
    strength = np.full(len(place), PIECE, np.int8)
    joined = _mark_table[0][cp[place]] | np.isin(before[place], _THAI_LEADING)
    strength[joined] = CHARACTER
    blank = space[place]
    strength[blank] = BLANK
    spot = place[blank]
    prev = before[spot]
    prev2 = np.where(spot >= 2, cp[np.maximum(spot - 2, 0)], 0)
    kind = np.full(len(spot), BLANK, np.int8)
    kind[np.isin(prev, _CLAUSE_END)] = CLAUSE
    kind[np.isin(prev, _SENTENCE_END) | (np.isin(prev, _CLOSING) & np.isin(prev2, _SENTENCE_END))] = SENTENCE
    # newlines in the run of white space that starts here
    lines = np.concatenate([[0], np.cumsum(cp == 10)])
    nonspace = np.flatnonzero(~space)
    run_end = np.append(nonspace, n)[np.searchsorted(nonspace, spot)]
    breaks = lines[run_end] - lines[spot]
    kind[breaks == 1] = LINE
    kind[breaks > 1] = PARAGRAPH
    strength[blank] = kind
    by = {k: where[strength == k] for k in (PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, PIECE)}
    by[CHARACTER] = np.flatnonzero(lead[byte_of])
    return _Layout(e.offsets, byte_of, np.searchsorted(byte_of, at[start]), aligned, by)


def _nearest(sorted_: np.ndarray, target: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.full(len(target), -(1 << 60))
    k = np.searchsorted(sorted_, target)
    after = sorted_[np.minimum(k, len(sorted_) - 1)]
    before = sorted_[np.maximum(k - 1, 0)]
    return np.where(np.abs(after - target) < np.abs(target - before), after, before)


def _one_by_one(bpe: ByteBpe, data: np.ndarray, lay: _Layout, natural: np.ndarray, text: int, cap: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (text, first token, end token, tokens) of one text, each as long as its own count allows.

    Every piece is counted anew before it is taken.  It ends at the last natural place of
    its new part's second half where there is one.  Where the limit leaves no room for the
    whole overlap and one more character, the overlap is shortened; a character of more
    tokens than the limit, which can't be divided, comes out alone.
    """
    first, last = int(lay.tokens[text]), int(lay.tokens[text + 1])
    aligned, byte_of = lay.aligned, lay.byte_of

    def count(a: int, b: int) -> int:
        raw = data[byte_of[a] : byte_of[b]]
        return int(bpe.counts(raw, np.array([0, len(raw)]))[0])

    def following(at: int) -> int:
        """The next token after ``at`` where a character starts."""
        at += 1
        while at < last and aligned[at] != at:
            at += 1
        return min(at, last)

    def longest(a: int, least: int) -> tuple[int, int]:
        """End and count of the longest piece from ``a`` that reaches ``least`` and fits; end 0 if none does."""
        end = min(a + cap, last)
        while end >= least:
            end = end if end == last else int(aligned[end])
            if end < least:
                break
            n = count(a, end)
            if n <= cap:
                return end, n
            end -= max(1, (n - cap) // 2)
        return 0, 0

    out, begin, done = [], first, first
    while done < last:
        least = following(done)
        end, n = longest(begin, least)
        while not end and begin < done:
            begin = following(begin)
            end, n = longest(begin, least)
        if not end:
            end, n = least, count(begin, least)
        if end < last:
            spot = int(np.searchsorted(natural, end, "right")) - 1
            if spot >= 0 and natural[spot] < end and natural[spot] > done + (end - done) // 2:
                shorter = count(begin, int(natural[spot]))
                if shorter <= cap:
                    end, n = int(natural[spot]), shorter
        out.append((text, begin, end, n))
        done = end
        begin = max(int(aligned[max(first, end - overlap)]), following(begin))
        begin = min(begin, done)
    return out


def _plan(bpe: ByteBpe, data: np.ndarray, lay: _Layout, cap: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first token, end token and token count of every piece, in order."""
    size = np.diff(lay.tokens)
    todo = np.flatnonzero(size > cap)
    natural = np.sort(np.concatenate([v for k, v in lay.by_strength.items() if k >= BLANK]))
    # a text without any natural place is cut into the fewest pieces
    bare = np.searchsorted(natural, lay.tokens[:-1], "right") == np.searchsorted(natural, lay.tokens[1:])
    pieces = -(-(size[todo] - overlap) // (cap - overlap))
    done: list[tuple[np.ndarray, ...]] = []
    for _ in range(_ROUNDS):
        if not len(todo):
            break
        n, first, last = size[todo], lay.tokens[todo], lay.tokens[todo + 1]
        step = (n - overlap) / pieces  # distance of targets
        slack = cap - (step + overlap) - 3  # the start of an overlap may move back to a character
        # half the free room, and less than half a step: windows of neighbours never meet
        width = np.maximum(0, np.floor(np.minimum(slack / 2, step / 2 - 1))).astype(np.int64)
        owner = np.repeat(np.arange(len(todo)), pieces)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
        final = k == pieces[owner]
        target = first[owner] + np.rint(k * step[owner] + overlap).astype(np.int64)
        low, high = target - width[owner], target + width[owner]
        end = np.where(final, last[owner], -1)
        got = np.where(final, PARAGRAPH, -1)
        for s in range(PARAGRAPH, -1, -1):
            open_ = np.flatnonzero(end < 0)
            if not len(open_):
                break
            near = _nearest(lay.by_strength[s], target[open_])
            ok = (near >= low[open_]) & (near <= high[open_]) & (near > first[owner[open_]]) & (near < last[owner[open_]])
            end[open_[ok]], got[open_[ok]] = near[ok], s
        open_ = end < 0
        end[open_] = lay.aligned[target[open_]]
        # the next piece begins `overlap` tokens before, moved back to a place where a piece starts
        begin = np.where(k == 1, first[owner], np.concatenate([[0], end[:-1]]) - overlap)
        inner = np.flatnonzero(k > 1)
        whole = lay.starts[np.maximum(np.searchsorted(lay.starts, begin[inner], "right") - 1, 0)]
        near_start = (begin[inner] - whole <= np.minimum(16, step[owner[inner]] / 4)) & (end[inner] - whole <= cap)
        begin[inner] = np.where(near_start, whole, lay.aligned[begin[inner]])
        begin = np.maximum(begin, first[owner])
        count = end - begin
        forced = np.zeros(len(owner), bool)
        forced[inner] = ~near_start
        forced |= (got <= CHARACTER) & ~final
        check = np.flatnonzero(forced & (count <= cap) & (count > 0))
        if len(check):  # a cut inside a pre-split piece can change the count: count these again
            a, b = lay.byte_of[begin[check]], lay.byte_of[end[check]]
            off = np.concatenate([[0], np.cumsum(b - a)])
            buf = data[np.repeat(a - off[:-1], b - a) + np.arange(off[-1])]
            count[check] = bpe.counts(buf, off)
        previous = np.concatenate([[-1], begin[:-1]])
        bad = (count > cap) | (count <= 0) | ((k > 1) & (begin <= previous))
        # room enough and still no white space: the text has no better place
        wide = (width >= (cap - overlap) // 10) | bare[todo]
        bad |= (got < BLANK) & ~wide[owner]
        again = np.zeros(len(todo), bool)
        again[owner[bad]] = True
        good = ~again[owner]
        done.append((todo[owner[good]], begin[good], end[good], count[good]))
        pieces = np.minimum(pieces + np.maximum(1, pieces // 32), n)[again]
        todo = todo[again]
    rest = [row for t in todo for row in _one_by_one(bpe, data, lay, natural, int(t), cap, overlap)]
    if rest:
        done.append(tuple(np.array(rest, np.int64).T))
    if not done:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    text, begin, end, count = (np.concatenate(x) for x in zip(*done))
    order = np.lexsort((end, text))
    return text[order], begin[order], end[order], count[order]


def split_texts(df: DataFrame, id_col: str, text_col: str, limits: list[tuple[str, int, int]], vocabulary: str | None = None) -> DataFrame:
    """Pieces of every text over the limit, for each (limit_id, max_tokens, overlap_tokens).

    Result: limit_id, ``id_col``, piece_no (from 1), pieces, start_char, end_char,
    piece_tokens, overlap_tokens, piece_text.  ``overlap_tokens`` is what a piece repeats of
    the one before: the overlap asked for, extended back to the nearest place where a
    pre-split piece (or at least a character) starts.  The pieces without what they repeat
    are the text again.  Of each text the fewest pieces are planned at equal distances;
    each target moves to the strongest boundary (paragraph, line, sentence, clause, white
    space, then word and character) within half the free room; pieces are added where a
    piece would pass the limit or no natural place lies in reach.  A text for which 24 such
    plans fail is cut piece by piece, each counted until it fits.  No piece is over the
    limit, but for a single character of more tokens than that.  Texts within the limit,
    empty and null texts give no rows; repeated rows are split as often as they occur.
    Map-only, a text is held whole by one task.
    """
    for _, cap, overlap in limits:
        if not 0 <= overlap < cap:
            raise ValueError("0 <= overlap_tokens < max_tokens is required")
    path = vocabulary or byte_bpe_50k()
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["limit_id", id_col, "piece_no", "pieces", "start_char", "end_char", "piece_tokens", "overlap_tokens", "piece_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for a, b in chunks(off):
                buf, bounds = data[off[a] : off[b]], off[a : b + 1] - off[a]
                lay = _lay_out(bpe, buf, bounds)
                ids = batch.column(0).slice(a, b - a)
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                for limit, cap, overlap in limits:
                    text, begin, end, count = _plan(bpe, buf, lay, cap, overlap)
                    if not len(text):
                        continue
                    x, y = lay.byte_of[begin], lay.byte_of[end]
                    out = np.concatenate([[0], np.cumsum(y - x)])
                    body = buf[np.repeat(x - out[:-1], y - x) + np.arange(out[-1])]
                    strings = pa.StringArray.from_buffers(len(text), pa.py_buffer(out.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes()))
                    head = np.concatenate([[True], text[1:] != text[:-1]])
                    number = np.arange(len(text)) - np.maximum.accumulate(np.where(head, np.arange(len(text)), 0)) + 1
                    total = np.bincount(text, minlength=b - a)[text]
                    repeated = np.where(head, 0, np.concatenate([[0], end[:-1]]) - begin)
                    base = chars[bounds[:-1][text]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([limit] * len(text), pa.string()), ids.take(pa.array(text)), pa.array(number.astype(np.int32)), pa.array(total.astype(np.int32)),
                        pa.array(chars[x] - base), pa.array(chars[y] - base), pa.array(count.astype(np.int32)), pa.array(repeated.astype(np.int32)), strings,
                    ], names=names)

    schema = f"limit_id string, `{id_col}` {id_type}, piece_no int, pieces int, start_char bigint, end_char bigint, piece_tokens int, overlap_tokens int, piece_text string"
    return df.select(id_col, text_col).mapInArrow(run, schema)
