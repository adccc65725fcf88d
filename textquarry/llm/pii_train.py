"""Training of the tagger: python -m textquarry.llm.pii_train OUT TABLES...

Reads audit_row and person_name of each directory of tables, labels at most MOST_ROWS
texts of each with :mod:`pii_labels`, adds TEMPLATE_LINES made-up lines of
:mod:`pii_templates`, and fits the model by Adam on the CRF likelihood.  The fit is on a
bounded sample; the tagger then runs over all texts.
"""

from __future__ import annotations

import random
import sys
import time

import numpy as np

from textquarry.llm.pii import KINDS, PAD, SYMBOLS, TAGS, WINDOW, Tagger, encode_text, plausible, spans, tag_texts
from textquarry.llm.pii_labels import Names, common_words, hidden_again, label, look_alikes
from textquarry.llm.pii_templates import Maker

#: Bound of the labelled sample, rows of each directory.
MOST_ROWS = 20_000
#: Made-up lines, whose labels are known.
TEMPLATE_LINES = 40_000


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def crf(e: np.ndarray, tags: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood and its gradients by scores (time, batch, tags) and transitions."""
    t, n, k = e.shape
    alpha = np.empty_like(e)
    alpha[0] = e[0]
    for j in range(1, t):
        new = _logsumexp(alpha[j - 1][:, :, None] + trans[None], 1) + e[j]
        alpha[j] = np.where(mask[j][:, None], new, alpha[j - 1])
    beta = np.zeros_like(e)
    for j in range(t - 2, -1, -1):
        new = _logsumexp(trans[None] + (e[j + 1] + beta[j + 1])[:, None, :], 2)
        beta[j] = np.where(mask[j + 1][:, None], new, beta[j + 1])
    z = _logsumexp(alpha[-1], 1)
    ge = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    gt = np.zeros_like(trans)
    for j in range(1, t):
        pair = np.exp(alpha[j - 1][:, :, None] + trans[None] + (e[j] + beta[j])[:, None, :] - z[:, None, None])
        gt += (pair * mask[j][:, None, None]).sum(0)
    row = np.arange(n)
    gold = 0.0
    for j in range(t):
        gold += (e[j][row, tags[j]] * mask[j]).sum()
        ge[j][row, tags[j]] -= mask[j]
        if j:
            gold += (trans[tags[j - 1], tags[j]] * mask[j]).sum()
            np.add.at(gt, (tags[j - 1], tags[j]), -mask[j].astype(gt.dtype))
    return float(z.sum() - gold), ge, gt


def gradients(model: Tagger, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of a batch of symbols and tags (batch, time)."""
    n, t = x.shape
    H = model.hidden
    hs, stored, both = model.states(x, keep=True)
    wide = np.concatenate([hs[:, 0], hs[::-1, 1]], 2)
    e = wide @ model.p["o"] + model.p["b"]
    mask = (x != PAD).T
    loss, ge, gt = crf(e, tags.T, mask, model.p["t"])
    ge = ge.astype(np.float32) / n
    g = {"t": gt / n, "b": ge.sum((0, 1)), "o": wide.reshape(-1, 2 * H).T @ ge.reshape(-1, TAGS)}
    dwide = ge @ model.p["o"].T
    dh_out = np.stack([dwide[:, :, :H], dwide[::-1, :, H:]], 1)
    dh, dc = np.zeros((2, n, H), np.float32), np.zeros((2, n, H), np.float32)
    g["h"] = np.zeros_like(model.p["h"])
    dzs = np.empty((t, 2, n, 4 * H), np.float32)
    back = model.p["h"].transpose(0, 2, 1)
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, cand, tc, a = stored[k]
        dhk = (dh + dh_out[k]) * a
        dck = dc * a + dhk * o * (1 - tc * tc)
        dz = np.concatenate([dck * cand * i * (1 - i), dck * c * f * (1 - f), dhk * tc * o * (1 - o), dck * i * (1 - cand * cand)], 2)
        dzs[k] = dz
        g["h"] += np.matmul(h.transpose(0, 2, 1), dz)
        dh, dc = np.matmul(dz, back), dck * f
    gx = np.zeros_like(model.p["x"])
    for d in range(2):
        flat = both[d].T.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        gx[d][flat[order][first]] = np.add.reduceat(dzs[:, d].reshape(-1, 4 * H)[order], first, 0)
    g["x"] = gx
    return loss / n, g


def to_tags(text: str, found: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(len(text), np.int8)
    for a, b, k in found:
        c = 1 + 2 * KINDS.index(k)
        tags[a] = c
        tags[a + 1 : b] = c + 1
    return tags


def read(root: str, most: int = MOST_ROWS) -> tuple[list[str], list[tuple[str, str, str]]]:
    import pyarrow.dataset as ds

    texts = [t for t in ds.dataset(f"{root}/audit_row.parquet").head(most, columns=["text"])["text"].to_pylist() if t and t.strip()]
    names = ds.dataset(f"{root}/person_name.parquet").to_table().to_pylist()
    return texts, [(r["name"], r["name_kind"], r["script"]) for r in names]


def exchanged(text: str, found: list[tuple[int, int, str]], made: Maker) -> tuple[str, list[tuple[int, int, str]]] | None:
    """The text with every piece replaced by a made-up one of its kind, and the new spans."""
    out, at, moved = [], 0, []
    for a, b, k in found:
        out.append(text[at:a])
        body = getattr(made, "person" if k == "person_name" else k)()
        start = sum(map(len, out))
        out.append(body)
        moved.append((start, start + len(body), k))
        at = b
    return "".join([*out, text[at:]]), moved


def score(model: Tagger, texts: list[str], names: Names) -> dict[str, tuple[int, int, int]]:
    """By kind: pieces in both, in the labels, found by the tagger (counted by text)."""
    return score_spans(model, [(t, label(t, names)) for t in texts])


def score_spans(model: Tagger, examples: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[str, tuple[int, int, int]]:
    """:func:`score` of texts with their spans."""
    out = {k: [0, 0, 0] for k in KINDS}
    for (text, found), tags in zip(examples, tag_texts(model, [t for t, _ in examples])):
        for k in KINDS:
            want = sum(s[2] == k for s in found)
            got = sum(s[2] == k for s in spans(text, tags))
            out[k] = [out[k][0] + min(want, got), out[k][1] + want, out[k][2] + got]
    return {k: tuple(v) for k, v in out.items()}


def _batch(rows: list[tuple[np.ndarray, np.ndarray]], step: int, worker: int, workers: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of about equal length for one worker; ``rows`` are sorted by length."""
    rng = np.random.default_rng((step, 17))
    first = int(rng.integers(0, max(1, len(rows) - workers * batch + 1)))
    group = rows[first + worker : first + workers * batch : workers]
    width = max(len(x) for x, _ in group)
    x, y = np.zeros((len(group), width), np.uint8), np.zeros((len(group), width), np.int64)
    for r, (a, b) in enumerate(group):
        x[r, : len(a)], y[r, : len(b)] = a, b
    # sometimes a letter is hidden, so that no single name is learnt by heart
    drop = (np.random.default_rng((step, worker)).random(x.shape) < 0.02) & (x >= 34) & (x < 96)
    x[drop] = 228
    return x, y


def fit(model: Tagger, rows: list[tuple[np.ndarray, np.ndarray]], seconds: float, batch: int, workers: int) -> None:
    """Adam with gradients averaged over worker processes, for so many seconds."""
    import multiprocessing as mp

    rng = random.Random(9)
    rows = sorted(rows, key=lambda r: len(r[0]) + rng.random() * 8)
    names = list(model.p)
    bounds = np.cumsum([0] + [model.p[k].size for k in names])
    ctx = mp.get_context("fork")
    params = np.frombuffer(ctx.RawArray("f", int(bounds[-1])), np.float32)
    grads = np.frombuffer(ctx.RawArray("f", int(bounds[-1]) * workers), np.float32).reshape(workers, -1)
    losses = np.frombuffer(ctx.RawArray("d", workers), np.float64)
    go, done, stop = ctx.Barrier(workers + 1), ctx.Barrier(workers + 1), ctx.Value("b", 0)

    def view(flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: flat[a:b].reshape(model.p[k].shape) for k, a, b in zip(names, bounds[:-1], bounds[1:])}

    for k, v in view(params).items():
        v[...] = model.p[k]
    own = Tagger(model.hidden)
    own.p = view(params)

    def work(me: int) -> None:
        step = 0
        while True:
            go.wait()
            if stop.value:
                return
            losses[me], g = gradients(own, *_batch(rows, step, me, workers, batch))
            for k, v in view(grads[me]).items():
                v[...] = g[k]
            step += 1
            done.wait()

    crew = [ctx.Process(target=work, args=(i,), daemon=True) for i in range(workers)]
    for c in crew:
        c.start()
    m, v = np.zeros_like(params), np.zeros_like(params)
    began, step, total = time.time(), 0, 0.0
    while (spent := time.time() - began) < seconds:
        go.wait()
        done.wait()
        g = grads.mean(0)
        g *= min(1.0, 5 / (float(np.sqrt((g * g).sum())) + 1e-6))
        step += 1
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        rate = 5e-3 * min(1, step / 50) * max(0.01, 1 - spent / seconds)
        params -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        total += float(losses.mean())
        if step % 200 == 0:
            print(step, round(spent), "loss", round(total / 200, 3), flush=True)
            total = 0.0
    stop.value = 1
    go.wait()
    for c in crew:
        c.join()
    model.p = {k: x.copy() for k, x in view(params).items()}


def train(out: str, roots: list[str], seconds: float = 600, hidden: int = 64, batch: int = 24, seed: int = 5, workers: int = 8) -> None:
    rng = random.Random(seed)
    texts: list[str] = []
    listed: list[tuple[str, str, str]] = []
    for root in roots:
        t, n = read(root)
        texts += t
        listed += n
    listed = sorted(set(listed))
    names = Names(listed, common_words(texts))
    rng.shuffle(texts)
    plain = [t for t in texts if not label(t, names)]
    words = sorted(names.common)
    made, fresh = Maker(listed, words, seed), Maker([], words, seed + 1)
    examples = [made.line(plain) for _ in range(TEMPLATE_LINES)]
    held = [(t, [s for s in found if s[2] != "id_number" or plausible(t[s[0] : s[1]], s[2])]) for t, found in (fresh.line([]) for _ in range(1_000))]
    for text in texts:
        found = label(text, names, checked=False)
        if not found and not any(c.isdecimal() for c in text) and rng.random() < 0.5:
            continue
        examples.append((text, found))
        for _ in range(3):
            if found and (other := look_alikes(text, found, rng)):
                examples.append((other, label(other, names, checked=False)))
            if found and (other := exchanged(text, found, made)):
                examples.append(other)
        if found and (other := hidden_again(text, found, rng)):
            examples.append((other, label(other, names, checked=False)))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for text, found in examples:
        x, y = encode_text(text), to_tags(text, found)
        # texts with personal data are seen whole, of others one window
        starts = range(0, max(1, len(x) - 40), WINDOW - 40) if found else [rng.randrange(max(1, len(x) - WINDOW + 1))]
        rows += [(x[a : a + WINDOW], y[a : a + WINDOW]) for a in starts]
    print(len(texts), "texts,", len(rows), "windows", flush=True)
    model = Tagger(hidden, seed)
    fit(model, rows, seconds, batch, workers)
    model.save(out)
    print("made-up lines of unlisted names (both, labelled, found):", score_spans(model, held))


if __name__ == "__main__":
    assert SYMBOLS < 256
    train(sys.argv[1], sys.argv[3:], float(sys.argv[2]))
