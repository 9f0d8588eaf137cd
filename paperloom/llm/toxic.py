"""Abusive, hateful and sexual passages by a linear-chain conditional random field.

Tokens are words of scripts with spaces and single characters of others, normalised against disguises (case, repeated,
spelled-out, spaced-out and look-alike letters). The field's states are O and the three categories; its features are hashed
n-grams of tokens around each place. All it knows comes from documents labelled by hand: the n-grams that set a category's
documents apart from the unoffending ones mark the first spans, and rounds of fitting and tagging the training documents
again find the spans that these leave out.

Scoring reads every document whole and tags every sentence of it: tokens, hashes and unaries are numpy arrays over a whole
Arrow batch, without a call per string, and forward-backward runs over padded blocks of sentences of like length. The
sentences whose unaries prove that no state but O can reach LEAST (see `hopeless`) are 0 without the recursion, which is
exact and drops none. The best window of a sentence's marginals is its score; a document's score is that of its best sentence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.engine import bounded_sample
from paperloom.llm import codepoints

CATEGORIES = ("abusive", "hateful", "sexual")
STATES = ("O", *CATEGORIES)
#: Bounds of the training data: labelled documents, others that stand for ordinary text, the most characters of one of either, and sentences without a span.
MAX_LABELLED, MAX_OTHERS, MAX_CHARS, MAX_PLAIN = 5000, 1500, 20_000, 3000
#: Bits of the hash of features, and of n-grams that are counted in training.
BITS, COUNT = 18, 22
#: Marginal from which a passage counts, and from which a score is reported as more than 0.
FOUND, LEAST = 0.5, 0.05
#: Times that the training documents are tagged and fitted again.
ROUNDS = 1
N_FEATURES = 7
#: The most tokens that are tagged at once, and how many of the ones before they share.
SPAN, SHARED = 300, 50

#: Spaceless scripts, a character of which is a token.
SPACELESS = "぀-ヺー-ヿ㐀-鿿฀-๿ｦ-ﾟ"
WORD, LETTER, DIGIT, ALONE, END, SPACE, MARK = 1, 2, 4, 8, 16, 32, 64
PATTERNS = ((WORD, r"[\w*]"), (LETTER, r"\p{L}"), (DIGIT, r"\d"), (ALONE, f"[{SPACELESS}]"), (END, r"[\n\r。！？!?।]"), (SPACE, r"\s"), (MARK, r"[.\-_* ・]"))
#: Digits that stand for letters.
LEET = str.maketrans("013457", "oieast")


@lru_cache(maxsize=1)
def chars() -> tuple[np.ndarray, np.ndarray]:
    """(letters in lower case, classes) of all code points."""
    size = 0x110000
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x30000)]))
    kind = np.zeros(size, np.uint8)
    for bit, p in PATTERNS:
        for m in regex.finditer(f"(?:{p})+", every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            kind[a : b + 1] |= bit
    kind[0xD800:0xE000] = 0
    low = np.arange(size, dtype=np.uint32)
    for c in set(every) - set(every.lower()):
        if len(c.lower()) == 1:
            low[ord(c)] = ord(c.lower())
    kind[0x30FB] = MARK
    return low, kind


class Tokens(NamedTuple):
    """Tokens of all texts of a column: hash, hash of the first letters (0 if short), sentence, and of each sentence document and place."""

    h: np.ndarray
    head: np.ndarray
    sent: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def bounds(self) -> np.ndarray:
        return np.searchsorted(self.sent, np.arange(len(self.doc) + 1))


M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Tokens with a digit, and the ends of sentences.
NUMBER, BEFORE, AFTER = (np.uint64(x) for x in (0x1234567, 0x89ABCDE, 0xFEDCBA9))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * M1
    return (h ^ (h >> np.uint64(31))) * M2


@lru_cache(maxsize=8)
def powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, M3, np.uint64))))


def without(c: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of characters that only disguise: marks between single letters (four or more), and all but the first of a letter thrice or oftener."""
    alnum = (k & (LETTER | DIGIT)) != 0
    single = alnum & ((k & LETTER) != 0) & ((k & ALONE) == 0)
    single[1:] &= ~alnum[:-1]
    single[:-1] &= ~alnum[1:]
    link = np.flatnonzero(single[:-2] & ((k[1:-1] & MARK) != 0) & single[2:])
    out = []
    if len(link):
        new = np.ones(len(link), bool)
        new[1:] = (np.diff(link) != 2) | (c[link[1:] + 1] != c[link[:-1] + 1])
        chain = np.cumsum(new) - 1
        out.append(link[np.bincount(chain)[chain] >= 3] + 1)
    same = np.zeros(len(c), bool)
    same[1:] = (c[1:] == c[:-1]) & ((k[1:] & LETTER) != 0)
    third = np.flatnonzero(same[1:] & same[:-1]) + 1
    if len(third):
        out += [third, third - 1]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def tokenize(col: pa.Array) -> Tokens:
    """The tokens of a column of texts. Null is like empty text."""
    cps, bounds = codepoints.split(col)
    n = len(bounds) - 1
    base = bounds[:-1] + np.arange(n) + 3  # a line feed stands between two texts
    buf = np.full(len(cps) + n + 6, 10, np.uint32)
    buf[np.arange(len(cps)) + np.repeat(np.arange(n), np.diff(bounds)) + 3] = cps
    low, kind = chars()
    c, k = low[buf], kind[buf]
    place = None
    drop = without(c, k)
    if len(drop):
        left = np.ones(len(c), bool)
        left[drop] = False
        place = np.flatnonzero(left)
        c, k = c[place], k[place]
    alone = (k & ALONE) != 0
    star = np.flatnonzero((c == 42) | (c == 95))  # between characters of spaceless scripts only a disguise
    star = star[alone[star - 1] & alone[star + 1]]
    k[star] = 0
    word = ((k & WORD) != 0) & ~alone
    first = word.copy()
    first[1:] &= ~word[:-1]
    inside, first = word | alone, first | alone
    # sentences: after marks of their end and line feeds, and after a full stop with white space and a letter
    brk = (k & END) != 0
    stop = np.flatnonzero(c == 46)
    stop = stop[((k[stop + 1] & SPACE) != 0) & ((((k[stop - 1] & WORD) != 0) & ((k[stop - 2] & WORD) != 0)) | (c[stop - 1] == 41))]
    if len(stop):
        solid = np.flatnonzero((k & SPACE) == 0)
        at = np.searchsorted(solid, stop + 1)
        nxt = solid[np.minimum(at, len(solid) - 1)]
        brk[stop[(at < len(solid)) & ((k[nxt] & LETTER) != 0)]] = True
    tc = np.flatnonzero(inside)
    if not len(tc):
        z = np.zeros(0, np.int64)
        return Tokens(z.astype(np.uint64), z.astype(np.uint64), z, z, z, z)
    at = np.flatnonzero(first[tc])
    starts = tc[at]
    size = np.diff(np.append(at, len(tc)))
    sid = np.cumsum(brk)[starts]
    # letters and digits of each token
    kt, ct = k[tc], c[tc]
    digit = (kt & DIGIT) != 0
    has = np.flatnonzero(np.add.reduceat(digit, at, dtype=np.int64)) if digit.any() else np.zeros(0, np.int64)
    number = np.zeros(len(at), bool)
    number[has] = True
    if len(has):
        leet = np.isin(ct, np.frombuffer("013457".encode("utf-32-le"), np.uint32))
        letters = np.add.reduceat((kt & LETTER) != 0, at, dtype=np.int64)[has]
        leets = np.add.reduceat(leet, at, dtype=np.int64)[has]
        last = starts[has] + size[has]
        ok = (letters + leets == size[has]) & (letters > 0) & (leets * 5 <= 3 * size[has]) & (c[starts[has] - 1] != 45) & (c[last] != 45)
        number[has[ok]] = False
        fix = np.repeat(np.isin(np.arange(len(at)), has[ok]), size) & leet
        table = np.arange(128, dtype=np.uint32)
        for a, b in LEET.items():
            table[a] = b
        ct = ct.copy()
        ct[fix] = table[ct[fix]]
    off = np.arange(len(tc)) - np.repeat(at, size)
    v = (ct.astype(np.uint64) + np.uint64(1)) * powers(1 << int(max(6, int(size.max()).bit_length())))[off]
    h = mixed(np.add.reduceat(v, at))
    head = np.where(size > 4, mixed(np.add.reduceat(np.where(off < 4, v, np.uint64(0)), at)), np.uint64(0))
    h[number], head[number] = NUMBER, 0
    own, sent = np.unique(sid, return_inverse=True)
    cut = np.searchsorted(sid, own)
    a, b = starts[cut], (starts + size)[np.append(cut[1:], len(starts)) - 1] - 1
    if place is not None:
        a, b = place[a], place[b]
    doc = np.searchsorted(base, a, "right") - 1
    return Tokens(h, head, sent, doc, a - base[doc], b - base[doc] + 1)


def grams(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, hashed n-grams of two and three tokens) of each token."""
    n = len(t.h)
    p = np.arange(n) + 4 * t.sent + 2
    buf = np.full(n + 4 * len(t.doc) + 2, BEFORE, np.uint64)
    buf[p] = t.h
    last = p[t.bounds()[1:] - 1]
    buf[last + 1] = AFTER
    buf[last + 2] = AFTER
    two = mixed(buf[:-1] * M3 + (buf[1:] ^ M1))
    three = mixed(two[:-1] * M1 + (buf[2:] ^ M2))
    cells, own = np.empty((n, N_FEATURES), np.int32), np.empty((n, 4), np.int32)
    for f, (v, at) in enumerate(((t.h, None), (two, p - 1), (two, p), (three, p - 2), (three, p - 1), (three, p), (t.head, None))):
        v = v if at is None else v[at]
        cells[:, f] = ((v ^ np.uint64(f * 0x51ED27)) * M1 >> np.uint64(64 - BITS)).astype(np.int32)
        if 1 <= f <= 4:
            own[:, f - 1] = (v * M2 >> np.uint64(64 - COUNT)).astype(np.int32)
    return cells, own


def together(texts: list[str], step: int = 256) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """tokenize() and grams() of training texts, some at a time as the arrays of characters are large; token hashes are left out."""
    parts, n = [], 0
    for s in range(0, len(texts), step):
        tk = tokenize(pa.array(texts[s : s + step], pa.string()))
        parts.append((*grams(tk), tk.sent + n, tk.doc + s, tk.start, tk.end))
        n += len(tk.doc)
    x, g, *rest = (np.concatenate(p) for p in zip(*parts))
    none = np.zeros(0, np.uint64)
    return Tokens(none, none, *rest), x, g


class Field:
    """The conditional random field: weights of features and transitions."""

    def __init__(self) -> None:
        self.w = np.zeros((1 << BITS, len(STATES)), np.float32)
        self.t = np.zeros((len(STATES), len(STATES)), np.float32)
        self.bias = np.zeros(len(STATES), np.float32)

    def unary(self, x: np.ndarray) -> np.ndarray:
        u = np.tile(self.bias, (*x.shape[:-1], 1))
        for s in range(0, len(x), 1 << 18):  # bounds what is gathered at a time
            for f in range(x.shape[-1]):
                u[s : s + (1 << 18)] += self.w[x[s : s + (1 << 18), ..., f]]
        return u

    def marginals(self, u: np.ndarray, length: np.ndarray, expect: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of states, summed expected transitions if asked for) of padded unaries, by forward-backward."""
        n, m, s = u.shape
        inside = np.arange(m)[None, :] < length[:, None]
        e = np.exp(u - u.max(2, keepdims=True))
        tr = np.exp(self.t)
        f = np.zeros((n, m, s), np.float32)
        b = np.ones((n, m, s), np.float32)
        f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for i in range(1, m):
            x = (f[:, i - 1] @ tr) * e[:, i]
            f[:, i] = np.where(inside[:, i, None], x / x.sum(1, keepdims=True), f[:, i - 1])
        for i in range(m - 2, -1, -1):
            x = (b[:, i + 1] * e[:, i + 1]) @ tr.T
            b[:, i] = np.where(inside[:, i + 1, None], x / x.sum(1, keepdims=True), 1.0)
        p = f * b
        p /= p.sum(2, keepdims=True)
        exp_t = np.zeros((s, s), np.float32)
        if expect and m > 1:
            x = f[:, :-1, :, None] * tr * (e[:, 1:] * b[:, 1:])[:, :, None, :]
            x /= x.sum((2, 3), keepdims=True)
            exp_t = x[inside[:, 1:]].sum(0)
        return p * inside[:, :, None], exp_t

    def hopeless(self, u: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sentences (from tokens first[i] to first[i + 1]) of which no marginal of a category can reach LEAST.

        A path with some tokens not in O weighs, against the path all in O, at most the product over these tokens of
        exp(their unary over that of O + their best transitions over O to O). So the sum over all such paths is at most
        the product over all tokens of 1 + that factor, less 1, which bounds the odds of every marginal.
        """
        t = self.t - self.t[0, 0]
        best = (t.max(0) + np.maximum(0, t[:, 0]))[1:]
        odds = np.log1p(np.exp(np.minimum(u[:, 1:] - u[:, :1] + best, 30)).sum(1, dtype=np.float64))
        total = np.add.reduceat(odds, first[:-1]) if len(first) > 1 else np.zeros(0)
        return -np.expm1(-total) < LEAST

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = 5, rate: float = 0.3, l2: float = 1e-4) -> None:
        """Maximum likelihood by AdaGrad, in batches of sentences of like length; the order is fixed."""
        order = sorted(range(len(xs)), key=lambda i: (len(xs[i]), i))
        batches = [order[i : i + 64] for i in range(0, len(order), 64)]
        rng = np.random.default_rng(7)
        gw, gt, gb = np.full(self.w.shape, 1e-4, np.float32), np.full(self.t.shape, 1e-2, np.float32), np.full(len(STATES), 1e-2, np.float32)
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                own = batches[k]
                x, length = pad([xs[i] for i in own])
                y, _ = pad([ys[i] for i in own])
                p, exp_t = self.marginals(self.unary(x), length)
                inside = np.arange(x.shape[1])[None, :] < length[:, None]
                g = -p
                r, c = np.nonzero(inside)
                g[r, c, y[r, c]] += 1
                both = inside[:, 1:]
                obs = np.bincount(y[:, :-1][both] * len(STATES) + y[:, 1:][both], minlength=len(STATES) ** 2).reshape(exp_t.shape)
                cells, of = np.unique(x[inside], return_inverse=True)
                gi = np.repeat(g[inside], N_FEATURES, 0)
                dense = np.stack([np.bincount(of.ravel(), gi[:, s], len(cells)) for s in range(len(STATES))], 1).astype(np.float32)
                dense -= l2 * self.w[cells]
                gw[cells] += dense**2
                self.w[cells] += rate * dense / np.sqrt(gw[cells])
                d = obs - exp_t
                gt += d**2
                self.t += rate * 0.3 * d / np.sqrt(gt)
                d = g[inside].sum(0)
                gb += d**2
                self.bias += rate * 0.3 * d / np.sqrt(gb)


def pad(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in xs])
    out = np.zeros((len(xs), max(1, length.max(initial=1)), *xs[0].shape[1:]), xs[0].dtype)
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    return out, length


class Tagger:
    """The field as it is sent to the workers: its size is fixed by BITS, its training data by the bounds above."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        """rows: (text, category of a labelled document, O for none, or "" for one without a label)."""
        self.field = Field()
        self.field.bias[0] = 8.0  # without labels everything is ordinary
        self._fit(rows)

    def _fit(self, rows: list[tuple[str, str]]) -> None:
        of: dict[str, set[str]] = {}
        for t, c in rows:
            of.setdefault(t, set()).add(c)
        # copies of a text are one witness, and none if they disagree
        texts = [(t, *own) for t, cs in sorted(of.items()) if len(own := cs - {""} or cs) == 1]
        label = np.array([("", *STATES).index(c) - 1 for _t, c in texts], np.int64)
        if not (label > 0).any():
            return
        tk, x, g = together([t for t, _c in texts])
        first = tk.bounds()
        kind = label[tk.doc]  # of each sentence
        span, state, sure = first_spans(tk, g, label)
        del g
        for k in range(ROUNDS + 1):
            if k:
                span, state, sure = self._spans(x, first, tk, label)
            xs, ys = [], []
            plain = np.flatnonzero((sure == 0) & ((kind <= 0) | (k > 0)))
            hard = plain[kind[plain] == 0]  # of documents that raters call unoffending, all
            rest = plain[kind[plain] != 0]
            hard, rest = (r[:: max(1, -(-len(r) // MAX_PLAIN))] for r in (hard, rest))
            for i in (*np.flatnonzero(sure > 0), *hard, *rest):
                a, b = int(first[i]), min(int(first[i + 1]), int(first[i]) + SPAN)
                xs.append(x[a:b])
                ys.append(np.where(span[a:b], state[i], 0) if sure[i] > 0 else np.zeros(b - a, np.int64))
            if not any(y.any() for y in ys):
                return
            self.field = Field()
            self.field.fit(xs, ys)

    def _spans(self, x: np.ndarray, first: np.ndarray, tk: Tokens, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans of the training documents as the field sees them now: (token in a span, state of the sentence, 1 a span, 0 plain, -1 neither).

        A document's best sentence of its category is a span if it stands clearly out; passages in unlabelled documents
        count only where the field is sure, and unsure ones teach nothing.
        """
        score, p = self._sentences(x, first, keep=True)
        kind = label[tk.doc]
        best = score[:, 1:].argmax(1) + 1
        top = score[np.arange(len(best)), best]
        own = np.where(kind > 0, score[np.arange(len(best)), np.maximum(kind, 0)], 0.0)
        most = np.zeros(len(label))
        np.maximum.at(most, tk.doc, own)
        state = np.where(kind > 0, kind, best)
        lead = (kind > 0) & (own > 0.15) & (own >= most[tk.doc] - 1e-6)
        sure = np.where(lead | (top >= 0.9) & (kind != 0), 1, np.where(top < 0.15, 0, -1))
        # raters are sometimes wrong: what else the document of a category holds keeps its own category
        state = np.where(lead & (top < 0.9), state, best)
        sure = np.where((kind == 0) & (top >= 0.98), -1, np.where(kind == 0, 0, sure))
        per = np.repeat(np.arange(len(first) - 1), np.diff(first))
        q = p[np.arange(len(p)), state[per]]
        span = q >= np.minimum(0.3, 0.6 * np.maximum.reduceat(q, first[:-1])[per])
        return span, state, sure

    def _sentences(self, x: np.ndarray, first: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(score of each sentence by state, marginals of each token if asked for)."""
        u = self.field.unary(x)
        n = len(first) - 1
        out = np.zeros((n, len(STATES)))
        p_all = np.zeros((len(x), len(STATES)), np.float32) if keep else None
        size = np.diff(first)
        open_ = np.flatnonzero(size > 1 if keep else (size > 1) & ~self.field.hopeless(u, first))
        parts = [(i, a, min(int(first[i + 1]), int(first[i]) + s + SPAN)) for i in open_.tolist() for s in range(0, int(size[i]), SPAN) for a in (int(first[i]) + max(0, s - SHARED),)]
        parts.sort(key=lambda v: (v[2] - v[1], v[0], v[1]))
        for s in range(0, len(parts), 512):
            own = parts[s : s + 512]
            length = np.array([b - a for _i, a, b in own])
            m = int(length.max())
            at = np.minimum(np.array([a for _i, a, _b in own])[:, None] + np.arange(m), len(u) - 1)
            p, _ = self.field.marginals(u[at], length, expect=False)
            if keep:
                inside = np.arange(m)[None, :] < length[:, None]
                np.maximum.at(p_all, at[inside], p[inside])
            # the mean of the surest third, at least four tokens; a passage belongs to the category that it speaks for most
            third = np.maximum(4, length // 3)
            upto = np.cumsum(np.sort(p, 1)[:, ::-1], 1)
            got = upto[np.arange(len(own)), np.minimum(third, m) - 1] / third[:, None]
            np.maximum.at(out, [i for i, _a, _b in own], got)
        return out, p_all

    def score(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, category, score, start, end): a row for each text and category with a score of LEAST or more, of its best passage."""
        tk = tokenize(col)
        if not len(tk.h):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0), z, z
        x, _ = grams(tk)
        s, _ = self._sentences(x, tk.bounds())
        c = s[:, 1:].argmax(1) + 1
        v = s[np.arange(len(c)), c]
        hit = np.flatnonzero(v >= LEAST)
        hit = hit[np.lexsort((hit, -v[hit], c[hit], tk.doc[hit]))]
        new = np.ones(len(hit), bool)
        new[1:] = (tk.doc[hit[1:]] != tk.doc[hit[:-1]]) | (c[hit[1:]] != c[hit[:-1]])
        hit = hit[new]
        return tk.doc[hit], c[hit], v[hit], tk.start[hit], tk.end[hit]


def first_spans(tk: Tokens, g: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (token in a span, state of the sentence, 1 a span, 0 plain, -1 neither) by the n-grams that set offending documents apart.

    A sentence most of whose n-grams occur in several of a category's documents, but hardly in unoffending ones, is a span;
    one with hardly any is plain, the rest teach nothing. So wrong and contradicted labels do little harm.
    """
    # documents of each state that hold each n-gram, by its bucket of 2^COUNT
    by = np.zeros((1 << COUNT, len(STATES)), np.float32)
    edge = np.searchsorted(tk.doc[tk.sent], np.arange(len(label) + 1))
    for d, s in enumerate(np.maximum(label, 0).tolist()):
        by[np.unique(g[edge[d] : edge[d + 1]]), s] += 1
    toxic = by[:, 1:].sum(1)
    n_plain, n_toxic = max(1, int((label <= 0).sum())), max(1, int((label > 0).sum()))
    odd = ((toxic >= 2) & ((by[:, 0] + 1) / n_plain < 0.1 * toxic / n_toxic))[g]
    share = by[:, 1:] / np.maximum(1, toxic)[:, None]
    first = tk.bounds()
    size = np.diff(first)
    votes = np.zeros((len(size), len(CATEGORIES)))
    r, k = np.nonzero(odd)
    np.add.at(votes, tk.sent[r], share[g[r, k]])
    kind = label[tk.doc]
    votes[kind > 0, kind[kind > 0] - 1] += 1e-3
    state = votes.argmax(1) + 1
    ratio = np.add.reduceat(odd.sum(1), first[:-1]) / (4 * size)
    sure = np.where((kind > 0) & (ratio > 0.35), 1, np.where(ratio < 0.05, 0, -1))
    sure = np.where(kind == 0, 0, np.where((kind < 0) & (ratio < 0.2), 0, sure))
    span = odd.sum(1) >= 2
    # names and codes in a span are part of it
    per = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(span)
    if len(at) > 1:
        gap = (np.diff(at) <= 5) & (per[at[1:]] == per[at[:-1]])
        for a, b in zip(at[:-1][gap].tolist(), at[1:][gap].tolist()):
            span[a:b] = True
    return span, state, sure


def labelled(documents: DataFrame, labels: DataFrame) -> list[tuple[str, str]]:
    """(text, category or O) of at most MAX_LABELLED documents, chosen by a hash, whose raters agree, and (text, "") of MAX_OTHERS others.

    Null and unknown categories are left out; so are documents with two different categories, null or empty texts and, for
    training only, texts of more than MAX_CHARS characters.
    """
    known = labels.where(F.col("category").isin("none", *CATEGORIES) & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.min("category").alias("c"), F.max("category").alias("c2")).where("c = c2")
    one = bounded_sample(one, "doc_id", MAX_LABELLED, spare=2)
    short = documents.where(f"text <> '' and length(text) <= {MAX_CHARS}").select("doc_id", "text")
    rows = short.join(F.broadcast(one), "doc_id").select("doc_id", "text", "c").collect()  # one is of MAX_LABELLED rows
    out = [(r["text"], "O" if r["c"] == "none" else r["c"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]
    others = bounded_sample(short.join(F.broadcast(one), "doc_id", "left_anti"), "doc_id", MAX_OTHERS, of=documents.count(), spare=2).collect()
    return out + [(r["text"], "") for r in others]


def scores(documents: DataFrame, labels: DataFrame, all_rows: bool = False) -> DataFrame:
    """doc_id, source, category, score, start_pos, end_pos: a row per document and category with a score of at least FOUND.

    all_rows: a row per document and each of CATEGORIES, with score 0 and no place where it is less than LEAST. Null and empty texts
    have score 0. Without usable labels nothing is known and every score is 0. Repeated rows stay repeated.
    """
    tagger = documents.sparkSession.sparkContext.broadcast(Tagger(labelled(documents, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                doc, cat, score, start, end = tagger.value.score(b.column(2))
                if all_rows:
                    n = len(CATEGORIES)
                    at, got = np.repeat(np.arange(b.num_rows), n), doc * n + cat - 1
                    values = np.zeros((3, len(at)))
                    values[:, got] = score, start, end
                    no = np.ones(len(at), bool)
                    no[got] = False
                    names, score = np.tile(np.array(CATEGORIES, object), b.num_rows), values[0]
                    start, end = (pa.array(v.astype(np.int32), mask=no) for v in values[1:])
                else:
                    hit = score >= FOUND
                    at, names, score = doc[hit], np.array(STATES, object)[cat[hit]], score[hit]
                    start, end = (pa.array(v[hit].astype(np.int32)) for v in (start, end))
                if len(at):
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(names, pa.string()), pa.array(score, pa.float64()), start, end], ["doc_id", "source", "category", "score", "start_pos", "end_pos"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, category string, score double, start_pos int, end_pos int")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """source, category, n_docs, n_found, rate: a row per source, null too, and category."""
    s = scores(documents, labels, all_rows=True)
    return s.groupBy("source", "category").agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") >= FOUND).alias("n_found"), F.avg(F.when(F.col("score") >= FOUND, 1.0).otherwise(0.0)).alias("rate"))
