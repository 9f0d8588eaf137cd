"""One consistent form for text that looks equal but differs in its characters.

Arrow text becomes one array of code points for a whole batch. A table gives each code point's class by a gather; an
expansion table with offsets gives its ordinary form of none, one or several characters; marks are then composed with
the letter before them for all places at once. No string is visited by itself.

Ordinary forms: full-width Latin letters and digits and half-width katakana in their usual width, compatibility letters
and ideographs as what they stand for, a mark composed with its letter where one character for both exists, no invisible
characters, U+0020 for every other space, and Latin letters for look-alikes of other alphabets inside a Latin word.
Full-width punctuation, words wholly in another script, Thai and Lao vowels that only have a compatibility decomposition,
ordinal indicators, the micro sign and joiners that Indic orthography needs stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import codepoints

SIZE = 0x110000
#: Classes of code points.
PLAIN, TWIN, HIDDEN, SPACE, MARK, JOINER = range(6)
#: Alphabets of letters.
LATIN, OTHER = 1, 2
#: Look-alike letters of the Greek and Cyrillic alphabets and the Latin letters that they look like.
LOOKALIKES = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανυιρхасеорсухіјѕԁһӏԛԝкАВЕЅІЈКМНОРСТХУԌԚԜ", "ABEZHIKMNOPTYXoavuipxaceopcyxijsdhlqwkABESIJKMHOPCTXYGQW"))
#: Letters with a compatibility decomposition that are ordinary in their own script or use.
ORDINARY = {0xAA, 0xBA, 0xB5, 0x0E33, 0x0EB3, 0x0EDC, 0x0EDD}
#: Invisible characters outside the category of format characters.
UNSEEN = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x2800, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10))
#: Voicing marks, combining and spacing, by their combining form.
VOICE = {0x3099: 0x3099, 0x309A: 0x309A, 0x309B: 0x3099, 0x309C: 0x309A}


class Tables:
    """Lookup tables, made once in a Python worker by rules over the character database."""

    def __init__(self) -> None:
        self.kind = np.zeros(SIZE, np.uint8)
        self.alphabet = np.zeros(SIZE, np.uint8)
        forms: dict[int, tuple[int, ...]] = {}
        for cp in range(0x80, 0x20000):
            ch = chr(cp)
            cat = unicodedata.category(ch)
            if cat[0] == "C":
                if cat == "Cf" and not 0x600 <= cp <= 0x8E2 and cp not in (0x110BD, 0x110CD):
                    self.kind[cp], forms[cp] = (JOINER if cp in (0x200C, 0x200D) else HIDDEN), ()
                continue
            if cat == "Zs":
                self.kind[cp], forms[cp] = SPACE, (0x20,)
            elif cat[0] in "LN" and (dec := unicodedata.decomposition(ch)):
                if cp in ORDINARY:
                    continue
                to = unicodedata.normalize("NFKC", ch)
                single = not dec.startswith("<") and " " not in dec
                wide = 0xFF10 <= cp <= 0xFF19
                letters = cat[0] == "L" and dec.startswith("<") and all(unicodedata.category(x)[0] in "LM" for x in to)
                if to != ch and (wide or letters or single):
                    self.kind[cp], forms[cp] = TWIN, tuple(map(ord, to))
            elif cat[0] == "M":
                self.kind[cp] = MARK
        for cp in range(0x2E80, 0x2FE0):  # radicals, which are symbols by category
            to = unicodedata.normalize("NFKC", chr(cp))
            if to != chr(cp):
                self.kind[cp], forms[cp] = TWIN, tuple(map(ord, to))
        for cp in range(0x2F800, 0x2FA1E):  # ideographs of the supplementary compatibility block
            to = unicodedata.normalize("NFKC", chr(cp))
            if to != chr(cp):
                self.kind[cp], forms[cp] = TWIN, tuple(map(ord, to))
        for cp in range(0x1D400, 0x1D800):
            to = unicodedata.normalize("NFKC", chr(cp))
            if to != chr(cp) and to.isalnum():
                self.kind[cp], forms[cp] = TWIN, tuple(map(ord, to))
        for cp in UNSEEN:
            self.kind[cp], forms[cp] = HIDDEN, ()
        self.kind[0xFF9E], self.kind[0xFF9F] = TWIN, TWIN
        forms[0xFF9E], forms[0xFF9F] = (0x3099,), (0x309A,)
        for cp in VOICE:
            self.kind[cp] = MARK
        for lo, hi, a in ((0x41, 0x5B, LATIN), (0x61, 0x7B, LATIN), (0xC0, 0x250, LATIN), (0x1E00, 0x1F00, LATIN), (0xFF21, 0xFF3B, LATIN), (0xFF41, 0xFF5B, LATIN), (0x370, 0x400, OTHER), (0x400, 0x530, OTHER), (0x1F00, 0x2000, OTHER)):
            for cp in range(lo, hi):
                if unicodedata.category(chr(cp))[0] == "L":
                    self.alphabet[cp] = a
        # expansion: form of cp is flat[start[cp] : start[cp] + count[cp]]; the plain ones point at themselves
        self.count = np.ones(SIZE, np.uint8)
        self.start = np.full(SIZE, -1, np.int32)
        flat: list[int] = []
        for cp, f in forms.items():
            self.count[cp], self.start[cp] = len(f), len(flat)
            flat += f
        self.flat = np.array(flat, np.uint32)
        self.like = np.arange(SIZE, dtype=np.uint32)
        for a, b in LOOKALIKES.items():
            self.like[ord(a)] = ord(b)
        pairs: dict[int, int] = {}
        for cp in range(0xC0, 0x3200):
            dec = unicodedata.decomposition(chr(cp))
            if dec and not dec.startswith("<") and " " in dec:
                a, b = (int(x, 16) for x in dec.split())
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(cp):
                    for b2 in [b, *[k for k, v in VOICE.items() if v == b and k != b]]:
                        pairs[a << 21 | b2] = cp
        keys = np.array(sorted(pairs), np.int64)
        self.pair, self.whole = keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)

    def compose(self, before: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The one character for a letter and a mark, 0 where there is none."""
        code = before.astype(np.int64) << 21 | mark.astype(np.int64)
        i = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        return np.where(self.pair[i] == code, self.whole[i], 0)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def mixed_words(t: Tables, cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Flags of the letters of another alphabet in words that also have Latin letters; units such as a multiple of the ohm are none."""
    a = t.alphabet[cps]
    other = np.flatnonzero(a == OTHER)
    out = np.zeros(len(cps), bool)
    if not len(other):
        return out
    edge = np.zeros(len(cps) + 1, bool)
    edge[bounds] = True
    # only runs around the few places with another alphabet's letter
    letter = (a > 0) | (t.kind[cps] == HIDDEN) | ((t.kind[cps] == MARK) & (cps < 0x370))
    run = np.ones(len(cps), bool)
    run[1:] = ~letter[1:] | ~letter[:-1] | edge[1:-1]
    word = np.cumsum(run)
    latin = np.unique(word[a == LATIN])
    hit = other[np.isin(word[other], latin)]
    sign = np.isin(cps[hit], (0x3A9, 0x3BC)) & ((hit + 1 == len(cps)) | run[np.minimum(hit + 1, len(cps) - 1)]) & run[np.maximum(hit - 1, 0)]
    out[hit[~sign]] = True
    return out


def odd(cps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Flags of the characters that are not in their ordinary form."""
    t = tables()
    k = t.kind[cps]
    out = (k > 0) & (k < MARK)
    first = np.zeros(len(cps) + 1, bool)
    first[bounds] = True
    m = np.flatnonzero((k == MARK) & ~first[:-1])
    if len(m):
        out[m] = t.compose(cps[m - 1], cps[m]) > 0
    j = np.flatnonzero(k == JOINER)
    if len(j):
        virama = np.zeros(len(j), bool)
        ok = ~first[j]
        virama[ok] = (cps[j[ok] - 1] & 0x7F) == 0x4D
        virama[ok] &= (cps[j[ok] - 1] >= 0x900) & (cps[j[ok] - 1] < 0xE00)
        out[j] = ~virama
    return out | mixed_words(t, cps, bounds)


def canonical(cps: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ordinary form of every value."""
    t = tables()
    flag = odd(cps, bounds)
    if not flag.any():
        return cps, bounds
    cps = np.where(flag & (t.alphabet[cps] == OTHER), t.like[cps], cps).astype(np.uint32)
    n = np.where(flag, t.count[cps], 1).astype(np.int64)
    src = np.repeat(np.arange(len(cps)), n)
    ends = np.concatenate(([0], np.cumsum(n)))
    own = t.start[cps]
    replaced = flag & (own >= 0)
    out = cps[src]
    r = np.flatnonzero(replaced[src])
    out[r] = t.flat[own[src[r]] + r - ends[src[r]]]
    bounds = ends[bounds]
    while True:  # a second round composes a second mark
        first = np.zeros(len(out) + 1, bool)
        first[bounds] = True
        m = np.flatnonzero((t.kind[out] == MARK) & ~first[:-1])
        whole = t.compose(out[m - 1], out[m])
        m, whole = m[whole > 0], whole[whole > 0]
        if len(m) > 1:  # of adjacent marks the first only
            keep = np.concatenate(([True], np.diff(m) > 1))
            m, whole = m[keep], whole[keep]
        if not len(m):
            return out, bounds
        out = out.copy()
        out[m - 1] = whole
        stay = np.ones(len(out), bool)
        stay[m] = False
        bounds = np.concatenate(([0], np.cumsum(stay)))[bounds]
        out = out[stay]


def cells_of(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all cells of a column array<array<string>>, bounds of each value's cells in them)."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    n = len(rows)
    outer = rows.flatten()
    per = np.diff(rows.offsets.to_numpy()).astype(np.int64)
    per[~rows.is_valid().to_numpy(zero_copy_only=False)] = 0
    cells = outer.flatten()
    inner = np.diff(outer.offsets.to_numpy()).astype(np.int64) if len(outer) else np.zeros(0, np.int64)
    if len(outer):
        inner[~outer.is_valid().to_numpy(zero_copy_only=False)] = 0
    upto = np.concatenate(([0], np.cumsum(inner)))
    return cells, upto[np.concatenate(([0], np.cumsum(per)))][: n + 1]


def find(elements: DataFrame) -> DataFrame:
    """elem_id, field of the values with a character not in its ordinary form; field content or rows.

    Null and empty values are none; repeated rows give repeated rows; other columns are ignored. No shuffle, no call per string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            cps, bounds = codepoints.split(b.column(1))
            hit = np.flatnonzero(codepoints.any_in(odd(cps, bounds), bounds))
            cells, of = cells_of(b.column(2))
            ccps, cb = codepoints.split(cells)
            upto = np.concatenate(([0], np.cumsum(codepoints.any_in(odd(ccps, cb), cb))))
            rhit = np.flatnonzero(upto[of[1:]] > upto[of[:-1]])
            at = pa.array(np.concatenate((hit, rhit)).astype(np.int64))
            if len(at):
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(["content"] * len(hit) + ["rows"] * len(rhit))], ["elem_id", "field"])

    return elements.select("elem_id", "content", "rows").mapInArrow(run, "elem_id bigint, field string")


def normal(elements: DataFrame) -> DataFrame:
    """elem_id, content and rows in their ordinary form, nulls and shapes kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            rows = b.column(2)
            outer = rows.values
            for col in (b.column(1), outer.values):
                out = codepoints.join(*canonical(*codepoints.split(col)), col.is_valid().to_numpy(zero_copy_only=False)) if len(col) else col
                done.append(out)
            inner = pa.ListArray.from_arrays(outer.offsets, done[1], mask=outer.is_null() if outer.null_count else None)
            whole = pa.ListArray.from_arrays(rows.offsets, inner, mask=rows.is_null() if rows.null_count else None)
            yield pa.RecordBatch.from_arrays([b.column(0), done[0], whole], ["elem_id", "content", "rows"])

    return elements.select("elem_id", "content", "rows").mapInArrow(run, "elem_id bigint, content string, rows array<array<string>>")


def normal_column(df: DataFrame, key: str, col: str) -> DataFrame:
    """`key`, `col` in its ordinary form."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), codepoints.join(*canonical(*codepoints.split(c)), c.is_valid().to_numpy(zero_copy_only=False))], [key, col])

    return df.select(F.col(key), F.col(col)).mapInArrow(run, f"`{key}` {kinds[key]}, `{col}` string")
