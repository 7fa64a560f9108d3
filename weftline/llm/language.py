"""Languages of texts and of the passages in them.

A line's features are hashed subwords (byte 3-grams and 5-grams); the averaged embeddings of the features go through a linear
softmax. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows: in a first round on the labels
as they are, in a second without the windows that the first round contradicts. As embedding and softmax are linear, the trained model is one table of
a score for each feature and language, which is all the executors get. It can be written to the shared folder and read again (:func:`save_model`).

Rejection is calibrated on whole texts that are held out before any filtering, so on wrong labels too, and on windows made from them: mixed ones, of two
languages, and foreign ones, in a made-up language (letters exchanged, marks dropped). The confidence of an answer is a logistic function of the margin
between its mean score and the next one's, fitted to whether the label says the same, with a share of wrong labels allowed for; unlike softmax values it is small
where the scores are small. Answers below
the bound, which lets ``FOREIGN`` of the foreign windows pass, are rejected, for whole texts and for passages alike.

Comments are read as neutral, so they belong to what they stand in. The lines of a text are segmented by the best path that pays
for each change of language.

Defined results:
* null, empty and blank texts have no language (no row); a text of only neutral lines is read with them;
* a text's own language is the one with the most characters; ties go to the first in alphabetical order; other languages with runs of at least
  ``least_lines`` lines that aren't blank are its segments, also at the text's end;
* a rejected text comes out with null as its language, a rejected passage not at all;
* equal rows get equal results; texts of any length are read whole; labels that are placeholders or that fewer than ``LEAST_SHARE`` of the labelled rows have name no
  language, nor do those beyond the ``MOST_LABELS`` most frequent;
* without labelled rows there is no model and no row comes out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import staged_path

BUCKETS = 1 << 17  # for each order of n-grams
ORDERS = (3, 5)
DIM = 16
CHUNK = 1 << 20
SAMPLE_ROWS = 160  # labelled rows of each language that the model is fitted on, about
SAMPLE_BYTES = 1 << 16  # longer rows aren't used for fitting
LEAST_SHARE = 0.004  # of the labelled rows
MOST_LABELS = 64
FOREIGN = 0.05  # foreign windows that may pass
PLACEHOLDERS = {"", "?", "-", "unknown", "und", "undefined", "none", "null", "n/a", "na", "other", "mul", "zxx", "text", "misc"}
NEWLINE, SPACE = 10, 32
LINE_FULL = 24.0  # n-grams of a line that count as a full line's evidence


def _seen_bytes() -> np.ndarray:
    """Bytes as features see them: digits are alike, and so are tabs and blanks."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("0") : ord("9") + 1] = ord("0")
    t[9] = SPACE
    return t


_SEEN = _seen_bytes()
_CLOSERS, _QUOTES = np.zeros(256, bool), np.zeros(256, bool)
_CLOSERS[list(b"{}[]();,")] = True
_QUOTES[list(b"\"'`;)~")] = True


@dataclass
class Lines:
    """The lines of several texts: where they start and end in ``data``, whose they are, and what they are like."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    blank: np.ndarray
    neutral: np.ndarray
    closer: np.ndarray  # only brackets and their like: belongs to what it closes
    fence: np.ndarray  # only quotes or a fence, or an end tag: belongs to what holds the passage
    hinge: np.ndarray  # where a passage may begin or end at no cost


def lines_of(raw: np.ndarray, ends: np.ndarray) -> Lines:
    """``raw`` holds the UTF-8 of texts that end at ``ends``, each with a newline as its last byte."""
    data = raw
    cr = np.flatnonzero(raw == 13)
    if len(cr):  # line ends are one byte whatever wrote them, so they can't pass for a language's mark
        pair = raw[np.minimum(cr + 1, len(raw) - 1)] == NEWLINE
        data = raw.copy()
        data[cr[~pair]] = NEWLINE
        ends = ends - np.searchsorted(cr[pair], ends)
        data = np.delete(data, cr[pair])
    stop = np.flatnonzero(data == NEWLINE)
    start = np.r_[0, stop[:-1] + 1]
    text = np.searchsorted(ends, start, "right")
    solid = np.flatnonzero((data > SPACE) & (data != 0xEF) & (data != 0xBB) & (data != 0xBF))
    at = np.searchsorted(solid, start)
    first = np.where(at < len(solid), solid[np.minimum(at, len(solid) - 1)] if len(solid) else 0, len(data))
    blank = first >= stop
    pad = np.r_[data, np.zeros(4, np.uint8)]
    b = [pad[np.minimum(first + k, len(pad) - 1)] for k in range(4)]
    o = lambda c: np.uint8(ord(c))
    slashes = (b[0] == o("/")) & (b[1] == o("/"))
    dashes = (b[0] == o("-")) & (b[1] == o("-")) & (b[2] <= SPACE)
    hashed = (b[0] == o("#")) & ((b[1] <= SPACE) | (b[1] == o("#")))
    opens = (b[0] == o("/")) & (b[1] == o("*"))
    html = (b[0] == o("<")) & (b[1] == o("!")) & (b[2] == o("-")) & (b[3] == o("-"))
    neutral = slashes | dashes | hashed | opens | html
    _blocks(data, start, stop, text, neutral, opens, html)
    _quoted(data, start, stop, text, first, neutral)
    count = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][np.r_[start, len(data)]])
    seen = data > SPACE
    others, marks, quoted = count(seen & ~_CLOSERS[data]), count(seen & ~_QUOTES[data]), count(seen & _QUOTES[data] & ~_CLOSERS[data])
    tick = (b[0] == o("`")) & (b[1] == b[0]) & (b[2] == b[0])
    tag = (b[0] == o("<")) & (((b[1] == o("s")) & ((b[2] == o("c")) | (b[2] == o("t")))) | ((b[1] == o("/")) & (b[2] == o("s")) & ((b[3] == o("c")) | (b[3] == o("t")))))
    end_tag = tag & (b[1] == o("/"))
    lead = np.r_[np.zeros(3, np.uint8), data]
    last = lead[stop + 2]  # the byte before each line's end
    triple = ((last == 34) | (last == 39)) & (lead[stop + 1] == last) & (lead[stop] == last)
    fence = (((marks == 0) & (quoted > 0)) | tick | end_tag) & ~blank
    hinge = (fence | tag | triple | (last == 96)) & ~blank
    return Lines(data, start, stop, text, blank, neutral & ~blank, (others == 0) & ~blank, fence, hinge)


def _blocks(data, start, stop, text, neutral, opens, html) -> None:
    """Marks the lines of comments that go over several lines."""
    for marks, close in ((opens, b"*/"), (html, b"-->")):
        k, where = 0, np.flatnonzero(marks)
        while k < len(where):
            i = j = int(where[k])
            if close not in data[start[i] : stop[i]].tobytes():
                j += 1
                while j < len(start) and text[j] == text[i] and close not in data[start[j] : stop[j]].tobytes():
                    j += 1
                if j >= len(start) or text[j] != text[i]:
                    k += 1  # never closed: no block
                    continue
                neutral[i : j + 1] = True
            k = max(k + 1, int(np.searchsorted(where, j, "right")))


def _quoted(data, start, stop, text, first, neutral) -> None:
    """Marks texts in triple quotes that open a line (what is said about code); those behind an assignment are passages of their own.

    The marks of a text are paired in order, so one that closes isn't taken for one that opens.
    """
    for q in (34, 39):
        hit = data == q
        at = np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:]) if len(data) > 2 else np.zeros(0, int)
        at = at[np.r_[True, np.diff(at) > 2]] if len(at) else at
        line = np.searchsorted(start, at, "right") - 1
        k = 0
        while k + 1 < len(at):
            i, j = int(line[k]), int(line[k + 1])
            if text[i] != text[j]:
                k += 1  # never closed
                continue
            if at[k] == first[i]:
                neutral[i : j + 1] = True
            k += 2


def features(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, first, n): int32 (orders, bytes), and where each line's features begin and how many they are.

    Indentation and runs of blanks are left out: they tell of who wrote a text rather than of its language, and are changed by editors.
    """
    d = _SEEN[lines.data]
    gap = d == SPACE
    keep = np.ones(len(d), bool)
    keep[1:] = ~(gap[1:] & (gap[:-1] | (d[:-1] == NEWLINE)))
    if len(gap):
        keep[0] = not gap[0]
    place = np.r_[0, np.cumsum(keep)]
    first = place[lines.start]
    count = np.diff(np.r_[first, place[-1]])
    d = d[keep]
    # every line begins with the newline before it
    pad = np.r_[np.uint8(NEWLINE), d, np.zeros(8, np.uint8)].astype(np.uint64)
    n = len(d)
    w = pad[:n].copy()
    out = np.empty((len(ORDERS), n), np.int32)
    col = 0
    for k in range(1, max(ORDERS)):
        w |= pad[k : n + k] << np.uint64(8 * k)
        if k + 1 in ORDERS:
            h = (w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
            out[col] = h
            out[col] += col * BUCKETS
            col += 1
    return out, first, count


class Model:
    """``table`` has a score for each feature and language; ``heat`` sharpens them for the path over lines.

    ``slope`` and ``at`` make a confidence of a margin; below ``bound`` an answer is rejected.
    """

    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, heat: float = 1.0, slope: float = 1.0, at: float = 0.0, bound: float = 0.0):
        self.names, self.table, self.bias, self.heat, self.slope, self.at, self.bound = names, table, bias, heat, slope, at, bound

    def confidence(self, scores: np.ndarray, n: np.ndarray, said: int) -> float:
        """Of an answer for lines of these mean scores and numbers of features."""
        z = n @ scores / max(float(n.sum()), 1.0) + self.bias
        return float(1 / (1 + np.exp(-(self.slope * _margin(z, said) + self.at))))

    def line_scores(self, lines: Lines) -> tuple[np.ndarray, np.ndarray]:
        """Mean score of each line for each language, and its number of features."""
        f, first, n = features(lines)
        s = np.take(self.table, f[0], axis=0, mode="clip")
        for k in range(1, len(ORDERS)):
            s += np.take(self.table, f[k], axis=0, mode="clip")
        total = np.add.reduceat(s, first, axis=0)
        n = n.astype(np.float32)
        return total / (n * len(ORDERS))[:, None], n

    def evidence(self, lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities of each line, 0 where it is blank or neutral; and the mean scores and numbers of features they come from."""
        s, n = self.line_scores(lines)
        z = (s + self.bias) * self.heat
        z -= z.max(1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(1, keepdims=True))
        logp = np.maximum(logp, -6.0) * np.minimum(1.0, n / LINE_FULL)[:, None]
        logp[lines.blank | lines.neutral] = 0
        return logp, s, n


def _margin(z: np.ndarray, said: int) -> float:
    others = np.delete(z, said)
    return float(z[said] - others.max()) if len(others) else float(z[said])


def save_model(spark, model: Model, path: str) -> None:
    """Writes a model as rows of at most 64,000 features each, readable by every executor and by later sessions."""
    import pandas as pd

    whole, step = np.vstack([model.bias, model.table]).astype(np.float32), 64_000
    rows = pd.DataFrame([(k, whole[s : s + step].tobytes()) for k, s in enumerate(range(0, len(whole), step))], columns=["part", "scores"])
    head = [model.heat, model.slope, model.at, model.bound]
    spark.createDataFrame(rows, "part int, scores binary").withColumn("names", F.array(*[F.lit(x) for x in model.names])).withColumn("head", F.array(*[F.lit(float(x)) for x in head])).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> Model:
    parts = sorted(spark.read.parquet(path).collect(), key=lambda r: r["part"])  # of fixed size: features x languages
    whole = np.frombuffer(b"".join(r["scores"] for r in parts), np.float32).reshape(-1, len(parts[0]["names"]))
    return Model(list(parts[0]["names"]), whole[1:], whole[0], *parts[0]["head"])


def _foreign(text: str, rng: np.random.Generator) -> str:
    """The text in a made-up language: letters exchanged, marks dropped; words and lines keep their lengths."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    to = "".join(letters[i] for i in rng.permutation(26))
    text = "".join(c if c.isalnum() or c == "\n" else " " for c in text.lower())
    return text.translate(str.maketrans(letters, to))


def _windows(texts: list[str], label: np.ndarray, rng: np.random.Generator):
    """Windows of 1 to 12 lines: feature rows (ragged), labels, and the text of each. Texts are read about a CHUNK at a time."""
    feats, labels, owner, at = [], [], [], 0
    while at < len(texts):
        raw, to = [], at
        while to < len(texts) and (to == at or sum(map(len, raw)) < CHUNK):
            raw.append((texts[to] + "\n").encode("utf-8", "replace"))
            to += 1
        lines = lines_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
        f, first, n = features(lines)
        use = np.flatnonzero(~lines.blank & ~lines.neutral)
        i = 0
        while i < len(use):
            rows = use[i : i + int(rng.choice((1, 2, 3, 5, 8, 12)))]
            rows = rows[lines.text[rows] == lines.text[rows[0]]]
            i += len(rows)
            feats.append(np.concatenate([f[:, first[r] : first[r] + n[r]].ravel() for r in rows]))
            owner.append(at + lines.text[rows[0]])
            labels.append(label[owner[-1]])
        at = to
    return feats, np.array(labels), np.array(owner)


def _sgd(feats: list[np.ndarray], labels: np.ndarray, k: int, epochs: int, rng: np.random.Generator, rate: float = 24.0, batch: int = 64):
    """Embeddings and softmax weights by minibatch gradient descent."""
    emb = rng.normal(0, 0.1, (BUCKETS * len(ORDERS), DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    count = np.bincount(labels, minlength=k)
    weight = (len(labels) / np.maximum(count, 1) / max((count > 0).sum(), 1)).astype(np.float32)
    weight = np.minimum(weight, 4)
    steps, step = epochs * -(-len(labels) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            idx = np.concatenate([feats[r] for r in rows])
            n = np.array([len(feats[r]) for r in rows])
            first = np.r_[0, np.cumsum(n)[:-1]]
            mean = np.add.reduceat(emb[idx], first, axis=0) / n[:, None]
            z = mean @ w + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= weight[labels[rows]][:, None] / len(rows)
            eta = rate * (1 - step / steps)
            step += 1
            back = (p @ w.T) / n[:, None]
            w -= eta / 20 * (mean.T @ p)
            bias -= eta / 20 * p.sum(0)
            # one row for each feature that occurs: sort, sum runs, apply
            o = np.argsort(idx)
            sorted_idx = idx[o]
            cut = np.flatnonzero(np.r_[True, sorted_idx[1:] != sorted_idx[:-1]])
            grad = np.add.reduceat(np.repeat(back, n, axis=0)[o], cut, axis=0)
            emb[sorted_idx[cut]] -= eta * 40 * grad
    return emb @ w, bias


def train(texts: list[str], labels: list[str], seed: int = 5, epochs: int = 3) -> Model:
    """Fits the model; a fifth of the texts is held out whole for the temperature and the rejection."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    feats, wy, owner = _windows(texts, y, rng)
    held_out = rng.random(len(texts)) < 0.2
    fit = np.flatnonzero(~held_out[owner])
    table, bias = _sgd([feats[i] for i in fit], wy[fit], len(names), max(1, epochs // 2), rng)
    # second round: without windows that the first contradicts
    said = np.array([int(np.argmax(table[feats[i]].mean(0) + bias)) for i in fit])
    good = fit[said == wy[fit]]
    if len(good) >= len(names):
        table, bias = _sgd([feats[i] for i in good], wy[good], len(names), epochs, rng)
    check = np.flatnonzero(held_out[owner])
    model = Model(names, table.astype(np.float32), bias.astype(np.float32))
    if not len(check):
        return model
    scores = lambda fs: np.stack([table[f].mean(0) + bias for f in fs])
    z = scores([feats[i] for i in check])
    said, margin = z.argmax(1), np.array([_margin(x, int(x.argmax())) for x in z])
    agrees = said == wy[check]
    # labels that are wrong where the margin is largest are taken for wrong labels, not for wrong answers
    noise = min(0.5, max(0.001, 1 - float(agrees[margin >= np.median(margin)].mean())))
    best = None
    for h in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
        p = np.exp(h * (z - z.max(1, keepdims=True)))
        p = (p / p.sum(1, keepdims=True))[np.arange(len(check)), wy[check]]
        loss = -np.log((1 - noise) * p + noise / len(names)).mean()
        if best is None or loss < best[0]:
            best = (loss, h)
    model.heat = best[1]
    outs = np.flatnonzero(held_out)
    odd, _, _ = _windows([_foreign(texts[i], rng) for i in outs], y[outs], rng)
    odd = [odd[i] for i in rng.permutation(len(odd))[: len(check)]]
    other = check[rng.permutation(len(check))]
    two = wy[check] != wy[other]
    half = lambda f, n: f.reshape(len(ORDERS), -1)[:, :n].ravel()
    even = [min(len(feats[a]), len(feats[b])) // len(ORDERS) for a, b in zip(check[two], other[two], strict=True)]
    mixed = [np.concatenate([half(feats[a], n), half(feats[b], n)]) for a, b, n in zip(check[two], other[two], even, strict=True) if n]
    if odd:
        wrong = [np.array([_margin(x, int(x.argmax())) for x in scores(f)]) for f in (odd, mixed) if f]
        model.slope, model.at = _logistic(np.concatenate([margin, *wrong]), np.concatenate([agrees, np.zeros(sum(map(len, wrong)), bool)]), 1 - noise)
        model.bound = float(1 / (1 + np.exp(-(model.slope * np.quantile(wrong[0], 1 - FOREIGN) + model.at))))
    return model


def _logistic(x: np.ndarray, right: np.ndarray, most: float) -> tuple[float, float]:
    """Slope and offset of the logistic function of ``x`` that, times ``most``, makes ``right`` likeliest: by search over steepness and middle."""
    best = None
    for slope in np.geomspace(0.25, 16, 25):
        for middle in np.quantile(x, np.linspace(0.02, 0.98, 49)):
            p = most / (1 + np.exp(-np.clip(slope * (x - middle), -30, 30)))
            loss = -np.log(np.where(right, np.maximum(p, 1e-9), 1 - p)).mean()
            if best is None or loss < best[0]:
                best = (loss, float(slope), float(-slope * middle))
    return best[1], best[2]


def best_path(logp: np.ndarray, change: float, hinge: np.ndarray | None = None) -> np.ndarray:
    """The languages of a text's lines: most probable path that pays ``change`` for each change, a tenth of it beside a hinge."""
    cost = np.full(len(logp), change)
    if hinge is not None:
        cost[hinge] = cost[1:][hinge[:-1]] = change / 10
    n, k = logp.shape
    score, back = logp[0].copy(), np.zeros((n, k), np.int16)
    own = np.arange(k)
    for i in range(1, n):
        top = int(score.argmax())
        stay = score >= score[top] - cost[i]
        back[i] = np.where(stay, own, top)
        score = np.where(stay, score, score[top] - cost[i]) + logp[i]
    path = np.empty(n, int)
    path[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def segments(model: Model, lines: Lines, n_texts: int, change: float, least_lines: int):
    """For each text its own language and confidence, and its other languages: lists (text, own, confidence), (text, language, lines, confidence)."""
    logp, scores, n = model.evidence(lines)
    first = np.searchsorted(lines.text, np.arange(n_texts))
    last = np.searchsorted(lines.text, np.arange(n_texts), "right")
    total = np.add.reduceat(logp, np.minimum(first, len(logp) - 1), axis=0)
    own, parts = [], []
    size = lines.end - lines.start
    for t in range(n_texts):
        a, b = int(first[t]), int(last[t])
        solid = np.flatnonzero(~lines.blank[a:b]) + a
        if not len(solid):
            continue
        x = logp[solid]
        if not (~lines.neutral[solid]).any():
            own.append((t, -1, 0.0, a, b))  # only comments: read again with them
            continue
        main = int(total[t].argmax())
        gain = np.cumsum(x - x[:, [main]], axis=0)
        room = (gain - np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0)).max()
        if room > change:
            path = best_path(x, change, lines.hinge[solid])
            for i in np.flatnonzero(lines.closer[solid][1:] & (path[1:] != path[:-1])) + 1:
                path[i] = path[i - 1]
            quiet = lines.neutral[solid]
            main = int(np.bincount(path[~quiet], weights=size[solid][~quiet], minlength=x.shape[1]).argmax())
            path[lines.fence[solid]] = main
            # comments between two languages, before the first and behind the last line belong to what holds the passages
            said = np.flatnonzero(~quiet)
            after = np.searchsorted(said, np.flatnonzero(quiet))
            nxt, prev = path[said[np.minimum(after, len(said) - 1)]], path[said[np.maximum(after - 1, 0)]]
            path[quiet] = np.where((after > 0) & (after < len(said)) & (nxt == prev), nxt, main)
            edge = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            ends = np.r_[edge[1:], len(path)]
            for s, e in zip(edge, ends, strict=True):
                if path[s] != main and e - s >= least_lines:
                    seen = np.flatnonzero(~lines.neutral[solid[s:e]])
                    if len(seen):
                        rows = solid[s:e][seen]
                        sure = model.confidence(scores[rows], n[rows], int(path[s]))
                        if sure >= model.bound:
                            parts.append((t, int(path[s]), int(e - s), sure))
            rows = solid[(path == main) & ~quiet]
            rows = rows if len(rows) else solid[~quiet]
        else:
            rows = solid[~lines.neutral[solid]]
        own.append((t, main, model.confidence(scores[rows], n[rows], main), a, b))
    return own, parts


def sample_labelled(docs: DataFrame, text: str, label: str, rows: int = SAMPLE_ROWS, least_share: float = LEAST_SHARE) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled rows: about ``rows`` different texts of each language, by a hash of the text.

    The count reads the labels only. Copies are dropped in each task before they are shuffled, so a group of copies counts once however large it is.
    """
    clean = F.lower(F.trim(F.col(label)))
    named = docs.select(clean.alias("y")).where(F.col("y").isNotNull() & ~F.col("y").isin(*PLACEHOLDERS))
    most = named.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(MOST_LABELS).collect()
    total = sum(r["n"] for r in most)
    counts = {r["y"]: r["n"] for r in most if r["n"] >= max(2, least_share * total)}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, min(1.0, rows / n))])[F.col("y")]
    known = docs.select(clean.alias("y"), F.col(text).alias("t")).where(F.col("y").isin(*counts) & F.octet_length("t").between(40, SAMPLE_BYTES))
    drawn = known.withColumn("h", F.xxhash64("t")).where(F.pmod(F.col("h"), F.lit(1 << 20)) < share * (1 << 20))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = []
            for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if fresh:
                yield batch.take(pa.array(fresh))

    got = {(r["y"], r["t"]) for r in drawn.mapInArrow(once, drawn.schema).select("y", "t").collect()}
    ordered = sorted(got)
    return [t for _, t in ordered], [y for y, _ in ordered]


_TRAINED: dict[tuple, str | None] = {}  # the session's models by the files they were fitted on: where they are kept


def model_of(docs: DataFrame, text: str, label: str) -> Model | None:
    """The model of these documents: fitted once in a session for the same files, kept in the shared folder; None without labelled rows."""
    spark = docs.sparkSession
    files = tuple(sorted(docs.inputFiles()))
    known = (spark.sparkContext.applicationId, text, label, files)
    if files and known in _TRAINED:
        return load_model(spark, _TRAINED[known]) if _TRAINED[known] else None
    texts, labels = sample_labelled(docs, text, label)
    model = train(texts, labels) if texts else None
    if files:
        path = staged_path(spark, "language") if model else None
        if model:
            save_model(spark, model, path)
        _TRAINED[known] = path
    return model


def languages(docs: DataFrame, key: str, text: str, label: str, model: Model | None = None, change: float = 8.0, least_lines: int = 6) -> DataFrame:
    """(key, label, role, lang, confidence, lines): 'own' once for each text, 'segment' for each run in another language.

    A rejected own language comes out as null. ``label`` is carried along as it is.
    """
    if key in ("label", "role", "lang", "confidence", "lines"):
        raise ValueError(f"the key can't be named {key}")
    spark = docs.sparkSession
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("label", T.StringType()), T.StructField("role", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("lines", T.IntegerType())])
    if model is None:
        model = model_of(docs, text, label)
        if model is None:
            return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(model)  # fixed size: features x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                raw, size, to = [], 0, at
                while to < len(texts) and (to == at or size < CHUNK):
                    raw.append((texts[to] or "").encode("utf-8", "replace") + b"\n")
                    size += len(raw[-1])
                    to += 1
                data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
                lines = lines_of(data, ends)
                own, parts = segments(model, lines, len(raw), change, least_lines)
                out = []
                for t, lang, sure, a, b in own:
                    if lang < 0:
                        alone = Lines(lines.data, lines.start[a:b], lines.end[a:b], lines.text[a:b] - t, lines.blank[a:b], np.zeros(b - a, bool), lines.closer[a:b], lines.fence[a:b], lines.hinge[a:b])
                        cut = slice(int(lines.start[a]), int(lines.end[b - 1]) + 1)
                        alone.data, alone.start, alone.end = lines.data[cut], alone.start - cut.start, alone.end - cut.start
                        logp, scores, count = model.evidence(alone)
                        lang = int(logp.sum(0).argmax())
                        sure = model.confidence(scores[~alone.blank], count[~alone.blank], lang)
                    out.append((t, "own", model.names[lang] if sure >= model.bound else None, sure, int((~lines.blank[a:b]).sum())))
                out += [(t, "segment", model.names[k], sure, n) for t, k, n, sure in parts]
                if out:
                    t, role, lang, sure, n = zip(*out, strict=True)
                    rows = pa.array(np.array(t) + at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(role, pa.string()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(n, pa.int32())], names=schema.names)
                at = to

    return docs.select(F.col(key), F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S")).mapInArrow(run, schema)
