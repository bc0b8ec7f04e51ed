"""A linear-chain conditional random field over tokens of whole texts, in numpy batches.

Tokens are maximal runs of word bytes (ASCII letters and digits, bytes from 0x80, and the model's
own joining characters) or of other visible bytes; white space only separates. A token's score for
a label sums rows of small tables, chosen by its shape, length, changes of character class, gap to
the token before it, its word if training saw it, the same of its neighbours, and, if wanted, by
features of the whole file. Weights are fitted by gradient ascent of the penalised likelihood.

Decoding is Viterbi over whole texts. A token whose score for outside exceeds those for the other
labels by more than any transitions beside it could repay is outside in the best path, so the path
is cut there exactly, and only the short stretches between such tokens go through the recursion,
many at a time.

A text of more than ``PIECE`` bytes is tagged in pieces that end at white space, with ``CONTEXT``
bytes beside each; a span belongs to the piece in which it starts. Only a token longer than a piece is
cut. Features of the file are those of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .textnum import slices, word_hashes

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
LOWER, UPPER, DIGIT, JOIN, HIGH = 1, 2, 4, 8, 16
LENGTHS = np.zeros(256, np.uint8)
for _i, _at in enumerate((2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64)):
    LENGTHS[_at:] = _i + 1
SHAPES, MIXES, GAPS, COARSE = 32 * 15 * 2, 8 * 8, 3, 32 * 2 * 8
NEIGHBOURS = (-3, -2, -1, 1, 2, 3)
PIECE, CONTEXT = 1 << 18, 1 << 12
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def tables(joining: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: 0 space, 1 word, 2 other; and the bit of its character class."""
    cls, bit = np.full(256, 2, np.uint8), np.zeros(256, np.uint8)
    cls[[32, 9, 10, 11, 12, 13]] = 0
    for chars, b in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), (joining, JOIN)):
        at = np.frombuffer(chars.encode(), np.uint8)
        cls[at], bit[at] = 1, b
    cls[128:], bit[128:] = 1, HIGH
    return cls, bit


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text of the slice
    word: np.ndarray  # hash
    shape: np.ndarray
    mixed: np.ndarray
    gap: np.ndarray
    coarse: np.ndarray
    of_file: np.ndarray


def parts_of(data: np.ndarray, offsets: np.ndarray):
    """(start, end, core start, core end) of what is tagged at once: the slice, or pieces of its only text."""
    n = len(data)
    if n <= PIECE or len(offsets) > 2:
        yield 0, n, 0, n
        return
    at = 0
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            spaces = np.flatnonzero(SPACES[data[at:end]])
            end = at + int(spaces[-1]) + 1 if len(spaces) else end
        yield max(0, at - CONTEXT), min(n, end + CONTEXT), at, end
        at = end


def file_features(digits, size):
    """From the number of digits and of bytes of whole texts."""
    return np.minimum(16 * digits // np.maximum(size, 1), 3) * 4 + np.searchsorted([200, 2000, 20000], size)


def tokens(data: np.ndarray, offsets: np.ndarray, cls_of: np.ndarray, bit_of: np.ndarray) -> Tokens:
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Tokens(z, z, z, z.astype(np.uint64), z, z, z, z, z)
    cls, bits = cls_of[data], bit_of[data]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    new[offsets[(offsets > 0) & (offsets < n)]] = True
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    kind = cls[at]
    has = np.bitwise_or.reduceat(bits, at)
    change = np.zeros(n + 1, np.int32)
    np.cumsum(bits[1:] != bits[:-1], out=change[2:], dtype=np.int32)
    digit = np.zeros(n + 1, np.int32)
    np.cumsum(bits == DIGIT, out=digit[1:], dtype=np.int32)
    keep = kind > 0
    before = np.empty(len(at), np.int64)  # 0 joined to the token before, 1 after a space, 2 after a line or at the start
    before[0] = 2
    space = ~keep
    lines = np.add.reduceat(data == 10, at) > 0
    before[1:] = np.where(space[:-1], 1 + lines[:-1], 0)
    first = np.isin(at, offsets)
    before[first] = 2
    s, e, has, kind, gap = at[keep], end[keep], has[keep].astype(np.int64), kind[keep].astype(np.int64), before[keep]
    size = np.minimum(e - s, 255)
    length = LENGTHS[size].astype(np.int64)
    changes = np.minimum(change[e] - change[s + 1], 7)
    digits = digit[e] - digit[s]
    ratio = np.minimum(7, (8 * digits) // np.maximum(size, 1))
    punct = kind - 1
    own = np.searchsorted(offsets, s, "right") - 1
    of_file = file_features(digit[offsets[1:]] - digit[offsets[:-1]], np.diff(offsets))
    # An other token is told apart by its first byte's low bits
    lead = data[s].astype(np.int64) & 31
    shape = np.where(punct == 1, lead, has) + 32 * (length + 15 * punct)
    coarse = np.where(punct == 1, lead, has) + 32 * (punct + 2 * np.minimum(length, 7))
    return Tokens(s, e, own, word_hashes(data, s, e), shape, ratio * 8 + changes, gap, coarse, of_file[own])


@dataclass
class Tagger:
    joining: str = ""
    file_features: bool = False
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: list[np.ndarray] = field(default_factory=list)
    trans: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    caution: float = 0.0  # what a token's score for outside is raised by in decoding

    def features(self, t: Tokens) -> list[np.ndarray]:
        """Row numbers in each table, for each token; neighbours don't reach into other texts."""
        at = np.minimum(np.searchsorted(self.words, t.word), max(len(self.words) - 1, 0))
        word = np.where(self.words[at] == t.word, at + 1, 0) if len(self.words) else np.zeros(len(t.word), np.int64)
        out = [t.shape, t.mixed + 64 * (t.shape // 32 // 15), word, t.gap]
        n = len(word)
        for d in NEIGHBOURS:
            i = np.arange(n) + d
            inside = (i >= 0) & (i < n)
            i = np.clip(i, 0, max(n - 1, 0))
            if n:
                inside &= t.text[i] == t.text
            out += [np.where(inside, word[i], len(self.words) + 1), np.where(inside, t.coarse[i], COARSE)] if n else [word, word]
        if self.file_features:
            out.append(t.of_file)
        return out

    def sizes(self) -> list[int]:
        w = len(self.words) + 2
        return [SHAPES, 2 * MIXES, w, GAPS, *[w, COARSE + 1] * len(NEIGHBOURS), *[16] * self.file_features]

    def emissions(self, feats: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(feats[0]), 3), np.float32)
        for w, f in zip(self.weights, feats):
            out += w.astype(np.float32)[f]
        out[:, OUTSIDE] += self.caution
        return out

    # -- training -----------------------------------------------------------------------------

    def fit(self, rows: list[tuple[str, list[tuple[int, int]]]], steps: int = 90, rate: float = 0.2, penalty: float = 0.1, least: int = 5) -> "Tagger":
        """Texts with the spans (code points) to be found; words seen in ``least`` texts get weights."""
        cls_of, bit_of = tables(self.joining)
        texts = pa.array([r[0] for r in rows], pa.large_string())
        parts = [tokens(d, o, cls_of, bit_of) for _, d, o in slices(texts, 1 << 30)]
        t = parts[0]
        base = np.concatenate([[0], np.cumsum([len(r[0].encode()) for r in rows])])
        gold = np.full(len(t.start), OUTSIDE)
        for k, (text, spans) in enumerate(rows):
            for a, b in spans:
                a, b = len(text[:a].encode()), len(text[:b].encode())
                inside = np.flatnonzero((t.start >= base[k] + a) & (t.end <= base[k] + b))
                gold[inside] = INSIDE
                gold[inside[:1]] = BEGIN
        seen = np.unique(np.stack([t.word, t.text.astype(np.uint64)]), axis=1)[0]
        words, count = np.unique(seen, return_counts=True)
        plain = np.unique(t.word[(t.shape < 32 * 15) & (gold == OUTSIDE)])
        self.words = np.intersect1d(words[count >= least], plain)
        feats, sizes = self.features(t), self.sizes()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.stack([f + b for f, b in zip(feats, bounds)], 1)
        n_texts = len(rows)
        first = np.searchsorted(t.text, np.arange(n_texts + 1))
        n = np.diff(first)
        T = int(n.max())
        pos = np.arange(len(gold)) - first[t.text]
        w, tr = np.zeros((bounds[-1], 3)), np.zeros((3, 3))
        moment, speed, mt, st = np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)
        target = np.eye(3)[gold]
        pairs = np.flatnonzero(t.text[1:] == t.text[:-1])
        want = np.zeros((3, 3))
        np.add.at(want, (gold[pairs], gold[pairs + 1]), 1)
        live = np.arange(T)[None, :] < n[:, None]
        for step in range(1, steps + 1):
            e = np.zeros((n_texts, T, 3))
            e[t.text, pos] = w[flat].sum(1)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for i in range(1, T):
                x = alpha[:, i - 1, :, None] + tr
                m = x.max(1)
                alpha[:, i] = np.where(live[:, i, None], m + np.log(np.exp(x - m[:, None]).sum(1)) + e[:, i], alpha[:, i - 1])
            for i in range(T - 2, -1, -1):
                x = tr[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
                m = x.max(2)
                beta[:, i] = np.where(live[:, i + 1, None], m + np.log(np.exp(x - m[..., None]).sum(2)), 0)
            last = alpha[:, -1]
            z = np.log(np.exp(last - last.max(1, keepdims=True)).sum(1)) + last.max(1)
            p = np.exp(alpha + beta - z[:, None, None])[t.text, pos]
            g = np.zeros_like(w)
            diff = target - p
            for k in range(flat.shape[1]):
                for y in range(3):
                    g[:, y] += np.bincount(flat[:, k], diff[:, y], len(w))
            pair = np.exp(alpha[:, :-1, :, None] + tr + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
            gt = want - (pair * live[:, 1:, None, None]).sum((0, 1))
            for x, grad, m, s in ((w, g, moment, speed), (tr, gt, mt, st)):
                grad -= penalty * x
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                x += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            np.clip(tr, -4, 4, out=tr)
        self.weights = [w[a:b] for a, b in zip(bounds, bounds[1:])]
        self.trans = tr
        return self

    # -- decoding -----------------------------------------------------------------------------

    def certain(self, e: np.ndarray) -> np.ndarray:
        """Tokens that are outside in the best path, whatever stands beside them."""
        t, ok = self.trans, np.ones(len(e), bool)
        for y in (BEGIN, INSIDE):
            repay = max(0, (t[:, y] - t[:, OUTSIDE]).max()) + max(0, (t[y] - t[OUTSIDE]).max())
            ok &= e[:, OUTSIDE] - e[:, y] > repay
        return ok

    def labels(self, e: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Viterbi labels of all tokens, given the text that each stands in."""
        n = len(e)
        out = np.full(n, OUTSIDE)
        open_ = np.flatnonzero(~self.certain(e))
        if not len(open_):
            return out
        new = np.ones(len(open_), bool)
        new[1:] = (open_[1:] != open_[:-1] + 1) | (text[open_[1:]] != text[open_[:-1]])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(open_)))
        a = open_[starts]
        b = a + size
        # an outside neighbour, if there is one in the same text, at either end
        left = (a > 0) & (text[np.maximum(a - 1, 0)] == text[a])
        right = (b < n) & (text[np.minimum(b, n - 1)] == text[b - 1])
        order = np.argsort(-size, kind="stable")
        a, size, left, right = a[order], size[order], left[order], right[order]
        T = int(size[0])
        score = e[a] + left[:, None] * self.trans[OUTSIDE]
        back = []
        lives = [int(np.searchsorted(-size, -i, "left")) for i in range(T)]  # stretches longer than i
        final = np.empty((len(a), 3))
        for i in range(1, T + 1):
            live = lives[i] if i < T else 0
            done = slice(live, len(score))
            final[live : len(score)] = score[done] + right[live : len(score), None] * self.trans[:, OUTSIDE]
            if not live:
                break
            x = score[:live, :, None] + self.trans
            best = x.argmax(1)
            back.append(best.astype(np.uint8))
            score = np.take_along_axis(x, best[:, None], 1)[:, 0] + e[a[:live] + i]
        y = final.argmax(1)
        for i in range(T - 1, -1, -1):
            live = lives[i]
            out[a[:live] + i] = y[:live]
            if i:
                y[:live] = back[i - 1][np.arange(live), y[:live]]
        return out

    def spans(self, texts: pa.Array) -> dict[int, list[tuple[int, int]]]:
        """Row -> spans in code points, for the rows that have any."""
        cls_of, bit_of = tables(self.joining)
        found: dict[int, list[tuple[int, int]]] = {}
        for row, whole, offsets in slices(texts):
            parts = list(parts_of(whole, offsets))
            of_file = file_features(sum(int(((whole[c:d] >= 48) & (whole[c:d] <= 57)).sum()) for _, _, c, d in parts), len(whole)) if len(parts) > 1 else None
            before = 0  # code points ahead of the piece's core
            for a, b, lo, hi in parts:
                data = whole[a:b]
                own = offsets if len(parts) == 1 else np.array([0, b - a])
                t = tokens(data, own, cls_of, bit_of)
                if of_file is not None:
                    t.of_file[:] = of_file
                y = self.labels(self.emissions(self.features(t)), t.text)
                hit = np.flatnonzero(y != OUTSIDE)
                points = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=points[1:])
                shift = before - int(points[lo - a])
                before += int(points[hi - a] - points[lo - a])
                if not len(hit):
                    continue
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (t.text[hit[1:]] != t.text[hit[:-1]]) | (y[hit[1:]] == BEGIN)
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(hit)) - 1
                for i, j in zip(hit[at], hit[last]):
                    if lo <= a + t.start[i] < hi:
                        k = t.text[i]
                        base = points[own[k]] - shift
                        found.setdefault(row + int(k), []).append((int(points[t.start[i]] - base), int(points[t.end[j]] - base)))
        return found
