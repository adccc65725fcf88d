"""Personal data in free text: a character-level BiLSTM with CRF transitions, in numpy.

Texts are cut into overlapping windows; both directions of the LSTM run over batches of
windows, the scores of overlapping windows are averaged (weighted towards window centres),
and one Viterbi pass over the whole text picks the tags.  An exact check follows: id
numbers of 13 digits must have a right check digit.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.pii_labels import AT_SIGN, KINDS, ascii_digits, thai_id_valid

#: Tags: 0 outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 160, 112
BATCH = 384
_CHARS_AT_ONCE = 250_000
#: Characters, padding included, that one search for the best path holds at once.
CELLS = 200_000
PAD = 0
SYMBOLS = 232
PLACEHOLDER = {k: f"<{k.upper()}>" for k in KINDS}


@cache
def _symbols() -> np.ndarray:
    """Symbol of each code point: digits of any script alike, rare characters by category."""
    import sys
    import unicodedata

    table = np.full(sys.maxunicode + 1, 231, np.uint8)
    for c in range(0x30000):  # beyond lie rare ideographs, tags and private use
        ch = chr(c)
        if 32 <= c < 127:
            table[c] = c - 31
        elif ch.isdecimal():
            table[c] = ord(str(unicodedata.digit(ch))) - 31
        elif 0xE00 <= c < 0xE80:
            table[c] = 96 + c - 0xE00
        elif ch == "\n":
            table[c] = 224
        elif ch.isspace():
            table[c] = 225
        elif ch == "＠":
            table[c] = 230
        else:
            kind = unicodedata.category(ch)
            table[c] = {"Lu": 227, "Ll": 228}.get(kind, 229 if kind[0] == "L" else 231)
    return table


def encode_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _symbols()[np.minimum(raw, len(_symbols()) - 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(x * np.float32(0.5)) + np.float32(1))


class Tagger:
    """Parameters and both passes.  Gates in the order input, forget, output, candidate."""

    def __init__(self, hidden: int = 64, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self._halved: list[tuple[np.ndarray, np.ndarray]] = []
        f = np.float32
        self.p = {
            "x": rng.normal(0, 0.1, (2, SYMBOLS, 4 * hidden)).astype(f),
            "h": (rng.normal(0, 1, (2, hidden, 4 * hidden)) / np.sqrt(hidden)).astype(f),
            "o": (rng.normal(0, 1, (2 * hidden, TAGS)) / np.sqrt(2 * hidden)).astype(f),
            "b": np.zeros(TAGS, f),
            "t": np.zeros((TAGS, TAGS), f),
        }
        self.p["x"][:, :, hidden : 2 * hidden] += 1  # forget gates begin open

    @staticmethod
    def load() -> Tagger:
        """The parameters that come with the package, as trained by pii_train."""
        body = pkgutil.get_data("textquarry.llm", "pii_weights.npz")
        with np.load(io.BytesIO(body)) as z:
            t = Tagger(z["h"].shape[1])
            t.p = {k: z[k].astype(np.float32) for k in z.files}
        return t

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def states(self, x: np.ndarray, keep: bool = False):
        """Hidden states (time, 2, batch, hidden) of symbols (batch, time); with ``keep`` also what backward needs."""
        n, t = x.shape
        H = self.hidden
        both = np.stack([x, x[:, ::-1]])  # direction, batch, time
        alive = (both != PAD).astype(np.float32)
        h, c = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)
        hs = np.empty((t, 2, n, H), np.float32)
        stored = []
        one = np.arange(2)[:, None]
        for k in range(t):
            z = self.p["x"][one, both[:, :, k]] + np.matmul(h, self.p["h"])
            s = _sigmoid(z[:, :, : 3 * H])
            i, fgt, o = s[:, :, :H], s[:, :, H : 2 * H], s[:, :, 2 * H :]
            g = np.tanh(z[:, :, 3 * H :])
            a = alive[:, :, k, None]
            c2 = fgt * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep:
                stored.append((h, c, i, fgt, o, g, tc, a))
            h, c = h2 * a, c2 * a
            hs[k] = h
        return (hs, stored, both) if keep else hs

    def _run(self, x: np.ndarray, direction: int) -> np.ndarray:
        """Hidden states (time, batch, hidden) of one direction, in its own order of time.

        The gates' weights are halved beforehand, so that one tanh over all of them gives
        the sigmoids as well; all steps work in place.
        """
        n, t = x.shape
        H = self.hidden
        if not self._halved:
            scale = np.ones(4 * H, np.float32)
            scale[: 3 * H] = 0.5
            self._halved = [(np.ascontiguousarray(self.p["x"][d] * scale), np.ascontiguousarray(self.p["h"][d] * scale)) for d in range(2)]
        table, weight = self._halved[direction]
        columns = np.ascontiguousarray((x[:, ::-1] if direction else x).T)
        pad = (columns == PAD).any(1)
        hs = np.empty((t, n, H), np.float32)
        h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
        z, u = np.empty((n, 4 * H), np.float32), np.empty((n, H), np.float32)
        half = np.float32(0.5)
        for k in range(t):
            np.matmul(h, weight, out=z)
            z += table[columns[k]]
            np.tanh(z, out=z)
            gates = z[:, : 3 * H]
            gates *= half
            gates += half
            c *= z[:, H : 2 * H]
            np.multiply(z[:, :H], z[:, 3 * H :], out=u)
            c += u
            h = hs[k]
            np.tanh(c, out=h)
            h *= z[:, 2 * H : 3 * H]
            if pad[k]:
                dead = columns[k] == PAD
                h[dead] = 0
                c[dead] = 0
        return hs

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (batch, time, tags)."""
        H = self.hidden
        out = self._run(x, 0) @ self.p["o"][:H]
        out += (self._run(x, 1) @ self.p["o"][H:])[::-1]
        return out.transpose(1, 0, 2) + self.p["b"]

    def viterbi(self, e: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) of scores (batch, time, tags); texts are padded behind."""
        n, t, k = e.shape
        v = e[:, 0].copy()
        back = np.zeros((t, n, k), np.int8)
        trans = self.p["t"][None]
        for j in range(1, t):
            m = v[:, :, None] + trans
            back[j] = m.argmax(1)
            new = m.max(1) + e[:, j]
            live = (j < length)[:, None]
            v = np.where(live, new, v)
        tags = np.zeros((n, t), np.int8)
        cur = v.argmax(1)
        for j in range(t - 1, -1, -1):
            tags[:, j] = np.where(j < length, cur, 0)
            if j:
                cur = np.where(j < length, back[j][np.arange(n), cur], cur)
        return tags


def _alike(order: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of texts, sorted by size, whose padded matrix has at most CELLS characters; a longer text goes alone."""
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < BATCH and (b - a + 1) * size[order[b]] <= CELLS:
            b += 1
        yield order[a:b]
        a = b


def tag_texts(model: Tagger, texts: list[str]) -> list[np.ndarray]:
    """Tag of every character of each text."""
    encoded = [encode_text(t) for t in texts]
    size = np.array([len(e) for e in encoded])
    base = np.concatenate([[0], np.cumsum(size)])
    total = np.zeros((base[-1], TAGS), np.float32)
    weight = np.zeros((base[-1], 1), np.float32)
    windows = [(i, s, min(s + WINDOW, n)) for i, n in enumerate(size) for s in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE) if n]
    windows.sort(key=lambda w: w[2] - w[1])
    for k in range(0, len(windows), BATCH):
        group = windows[k : k + BATCH]
        width = group[-1][2] - group[-1][1]
        x = np.zeros((len(group), width), np.uint8)
        for r, (i, a, b) in enumerate(group):
            x[r, : b - a] = encoded[i][a:b]
        e = model.scores(x)
        for r, (i, a, b) in enumerate(group):
            n = b - a
            place = np.arange(n, dtype=np.float32)
            # the first window knows the text's beginning, the last its end
            w = np.minimum(place + 1 if a else np.float32(1e3), n - place if b < size[i] else np.float32(1e3))
            w = np.broadcast_to(np.minimum(w, 64.0), (n,))[:, None].astype(np.float32)
            total[base[i] + a : base[i] + b] += e[r, :n] * w
            weight[base[i] + a : base[i] + b] += w
    total /= np.maximum(weight, 1e-6)
    out: list[np.ndarray] = [np.zeros(n, np.int8) for n in size]
    # A run of n tagged characters gains at most n + 1 <= 2n transitions over staying outside.
    # Where every character's score for outside leads by more than that, no path is better.
    lead = total[:, 0] - total[:, 1:].max(1) if len(total) else np.zeros(0, np.float32)
    gain = 2 * float(model.p["t"].max() - model.p["t"][0, 0])
    clear = np.array([n == 0 or bool((lead[a : a + n] > gain).all()) for a, n in zip(base, size)], bool)
    order = np.argsort(size, kind="stable")
    order = order[~clear[order] & (size[order] > 0)]
    for group in _alike(order, size):
        width = int(size[group].max())
        e = np.zeros((len(group), width, TAGS), np.float32)
        for r, i in enumerate(group):
            e[r, : size[i]] = total[base[i] : base[i + 1]]
        tags = model.viterbi(e, size[group])
        for r, i in enumerate(group):
            out[i] = tags[r, : size[i]]
    return out


def spans(text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the tagged pieces; those that can't be what they seem are dropped."""
    found = []
    place = np.flatnonzero(tags)
    if not len(place):
        return found
    kind = (tags[place] - 1) // 2
    begin = tags[place] % 2 == 1
    first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (kind[1:] != kind[:-1]) | begin[1:]]))
    for a, b in zip(first, np.append(first[1:], len(place))):
        x, y, k = int(place[a]), int(place[b - 1]) + 1, KINDS[kind[a]]
        body = text[x:y]
        if plausible(body, k):
            found.append((x, y, k))
    return found


def plausible(body: str, kind: str) -> bool:
    """Exact conditions of a piece: digits enough, an at sign in some form, a right check digit."""
    digits = re.sub(r"\D", "", ascii_digits(body))
    if kind == "email":
        return len(body) >= 5 and bool(AT_SIGN.search(body))
    if kind == "phone":
        return 7 <= len(digits) <= 21
    if kind == "id_number":
        return thai_id_valid(digits) if len(digits) == 13 else len(digits) >= 6
    if kind == "street_address":
        return bool(digits) and len(body) >= 6
    return len(body.strip()) >= 4 and not digits


_models: list[Tagger] = []


def _model() -> Tagger:
    if not _models:
        _models.append(Tagger.load())
    return _models[0]


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= _CHARS_AT_ONCE:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _found(column: pa.Array) -> Iterator[list[list[tuple[int, int, str]]]]:
    model = _model()
    texts = [t or "" for t in column.to_pylist()]
    for a, b in _runs(texts):
        part = texts[a:b]
        # repeated texts are tagged once
        distinct = list(dict.fromkeys(part))
        known = {t: spans(t, tags) for t, tags in zip(distinct, tag_texts(model, distinct))}
        yield [known[t] for t in part]


def _spread(df: DataFrame) -> DataFrame:
    """The rows over enough partitions to keep all cores busy.

    The model takes far longer than reading its input, so few large files must not mean
    few tasks.  Where the scan gives enough partitions the texts stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 3 * cores else df.repartition(4 * cores)


def find_personal_data(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, pii_kind, ordinal, start, end) of every piece of personal data.

    ``ordinal`` counts the pieces of a kind in a text from 1; start and end are character
    offsets.  Null, empty and blank texts have none; repeated rows give repeated results.
    Map-only, but for a spreading of texts over all cores where the input has too few
    partitions for a model that takes far longer than reading.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _found(batch.column(1)):
                owner, kinds, number, start, end = [], [], [], [], []
                for i, pieces in enumerate(part):
                    seen = dict.fromkeys(KINDS, 0)
                    for x, y, k in pieces:
                        seen[k] += 1
                        owner.append(at + i)
                        kinds.append(k)
                        number.append(seen[k])
                        start.append(x)
                        end.append(y)
                at += len(part)
                if owner:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner)), pa.array(kinds), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                        names=[id_col, "pii_kind", "ordinal", "start", "end"],
                    )

    return _spread(df.where(F.length(text_col) > 0).select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, pii_kind string, ordinal int, start int, `end` int")


def redact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, text_col, pieces): every text with its personal data replaced by typed placeholders.

    The rest of a text stays as it is; null stays null.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            for part in _found(batch.column(1)):
                clean = []
                for i, pieces in enumerate(part):
                    text = texts[at + i]
                    for x, y, k in reversed(pieces):
                        text = text[:x] + PLACEHOLDER[k] + text[y:]
                    clean.append(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(clean, pa.string()), pa.array([len(p) for p in part], pa.int32())], names=[id_col, text_col, "pieces"])
                at += len(part)

    return _spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, `{text_col}` string, pieces int")
