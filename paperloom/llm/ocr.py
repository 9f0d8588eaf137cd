"""Repair of text from scanned pages: furniture by page position, characters and line ends by a trained editor.

Furniture: lines at the top and bottom of a page's text that recur, even slightly misprinted, on other pages of the same
run are running headers. Page numbers are lines whose form - their words with every number as one sign - and place on the
page speak for it, by a perceptron that is trained on the corpus' own pages: forms that stand at their edges with ever other
numbers against all lines inside.

Editor: an averaged perceptron decides at each site of a text between keeping what is there and the operations that the
confusions allow there - replace, delete, insert (one character for two, or two for one) - and at each line end between
joining with nothing, with a space or with a broken word's mark deleted. Confusions are those of a list and those learned
from the corpus: what unknown words of scans have where a known word has something else, and characters that stand where
clean text always has another. It is trained on clean sentences of the same corpus, a bounded sample, into which the same
kinds of noise and line ends are put; so its labels are exact. Sites are found and their hashed features gathered in numpy
for all texts of a batch; words of scripts with spaces are sites only if the lexicon of all texts does not know them.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.engine import bounded_sample, cut
from paperloom.llm import codepoints
from paperloom.llm.sentences import SMALL

# What recognition makes of characters, as (misread, meant). More are learned from the corpus.
LETTERS = (("c", "e"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("cl", "d"), ("ii", "u"), ("b", "h"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("l", "i"), ("e", "c"), ("h", "b"), ("o", "0"), ("f", "t"), ("u", "ii"), ("g", "q"), ("8", "b"), ("6", "b"), ("3", "з"), ("0", "о"))
CHARS = (("一", "ー"), ("ー", "一"), ("問", "間"), ("間", "問"), ("人", "入"), ("入", "人"), ("卜", "ト"), ("ト", "卜"), ("口", "ロ"), ("ロ", "口"), ("カ", "力"), ("力", "カ"), ("曰", "日"), ("日", "曰"), ("夕", "タ"), ("タ", "夕"), ("工", "エ"), ("エ", "工"), ("末", "未"), ("未", "末"), ("ニ", "二"), ("二", "ニ"), ("土", "士"), ("士", "土"), ("ハ", "八"), ("八", "ハ"), ("己", "已"), ("千", "干"), ("治", "冶"), ("オ", "才"), ("才", "オ"), ("ミ", "三"), ("三", "ミ"))
# Marks at the end of a line that break a word. The first also writes compounds.
BREAKS = "-¬‐\xad"

#: Sentences of the training sample, and the share of sites that noise is put into.
SAMPLE, NOISE = 6000, 0.15
BITS = 18
EPOCHS = 4
#: Score from which a character is edited, in a context that the sample may not have.
SURE = 1.5
#: Lines from the top and bottom of a page that can be furniture.
EDGE = 3
#: Bounds of the training data: scanned texts, characters of a text, examples of each kind, words that noise is put into, and copies of a compound.
SCANNED, SHORT, LONG, EXAMPLES, NOISY, COPIES = 3000, 40, 4000, 200_000, 6000, 40
#: A learned confusion: words or contexts that show it, how much oftener than the other way round, and the share of a character's places.
SHOWN, ONE_WAY, SHARE = 20, 4.0, 0.1
#: Places of a character among which a listed confusion must be shown once.
DOUBT = 200
#: Characters of a running header: shorter lines recur by chance, longer ones are text.
HEAD = (5, 90)
#: Recurring lines of a run that its lines are compared with at a time.
BLOCK = 200

PAGE = regex.compile(
    r"^\W*(?:(?:page|seite|p[aá]gina|pág|pag|стр|p|s)\s*\.?\s*\d{1,4}(?:\s*(?:/|of|von|de|sur|из|\|)\s*\d{1,4})?|第\s*\d{1,4}\s*[頁页]|\d{1,4}\s*(?:ページ|頁|页)|\d{1,4}\s*[/|]\s*\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—]|\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4})\W*$",
    regex.I,
)
#: Ends and beginnings of lines that belong to sentences.
BODY = regex.compile(r"[。．、，,;；:：!?！？\-¬‐]$|\p{L}{2}\.$|\)\.$|^[\p{Ll}\p{Pe})（(]")
WORD = regex.compile(r"(?:[^\W_])+")
BLANK_LINE = regex.compile(r"\n[ \t]*\n")
HIDDEN = regex.compile("[\\p{Cf}]")
CJK = regex.compile(r"[぀-ヿ㐀-鿿]")
SPACED_WORD = regex.compile(r"^(?:\p{Latin}|\p{Cyrillic}|\d)+$")
BROKEN = regex.compile(rf"(\p{{L}}+)([{BREAKS}])[ \t]*\r?\n[ \t]*(\p{{L}}+)")


# ---- furniture


#: Characters of a line that is only a page number, at most.
FORM = 24
DIGITS, BLANKS = regex.compile(r"\d+"), regex.compile(r"\s+")


def form(line: str) -> str:
    """A line in small letters with each number as one sign, without white space."""
    return BLANKS.sub("", DIGITS.sub("#", line.lower()))


def can_be_page_no(line: str) -> bool:
    return len(line.strip()) <= FORM and DIGITS.search(line) is not None


def key(line: str) -> str:
    return regex.sub(r"[\W_]+", "", line.lower())


def head_key(line: str) -> str:
    """The key of a line that can be a header: a short one that is neither a page number nor part of a sentence; else empty."""
    s = line.strip()
    if not HEAD[0] <= len(s) <= HEAD[1] or BODY.search(s) or PAGE.match(s):
        return ""
    return k if len(k := key(s)) >= 3 else ""


def hash_text(t: str) -> int:
    b = t.encode()
    return (zlib.crc32(b) << 31) ^ zlib.adler32(b)


def seeds(lines: DataFrame) -> DataFrame:
    """run_id, seed: the lines at the edges of pages that recur exactly, or in their first or second half, on pages of other text in the run.

    Counting is a combining aggregate, so a long run is in no single task.
    """
    half = F.floor(F.length("k") / 2).cast("int")
    parts = F.array(F.concat(F.lit("="), F.col("k")), F.concat(F.lit("<"), F.substring(F.col("k"), F.lit(1), half)), F.concat(F.lit(">"), F.substring(F.col("k"), half + 1, F.length("k"))))
    own = lines.select("run_id", "h", "k", F.explode(parts).alias("part"))
    often = own.groupBy("run_id", "part").agg(F.min("h").alias("h1"), F.max("h").alias("h2"), F.min("k").alias("seed"), F.min(F.length("k")).alias("lo"), F.max(F.length("k")).alias("hi"))
    return often.where("h1 < h2 and hi - lo <= 0.25 * hi + 1").select("run_id", "seed").distinct()


def within(a: str, b: str, most: int) -> bool:
    """Whether two strings are at most so many edits apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        least = i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            least = min(least, row[j])
        if least > most:
            return False
    return row[-1] <= most


# ---- the editor


def classes() -> np.ndarray:
    """Script classes of code points for features."""
    t = np.zeros(0x110000, np.uint8)
    for k, (a, b) in enumerate(((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250), (0x400, 0x530), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x30FC, 0x30FD), (0x3400, 0xA000), (0x3000, 0x3020), (0xFF00, 0xFF60)), 1):
        t[a:b] = k
    t[0x20], t[0x0A] = 12, 13
    t[0x30FC] = 7
    return t


@lru_cache(maxsize=4)
def tables(chars: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(script classes, last edit of each code point or -1)."""
    site = np.full(0x110000, -1, np.int16)
    for i, (a, _b) in enumerate(chars):
        site[ord(a)] = i
    return classes(), site


MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)


def cell(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0x345678)
    for i, p in enumerate(parts):
        h = (h ^ (np.atleast_1d(np.asarray(p, np.uint64)) * MULT[i % 5])) * np.uint64(0x100000001B3)
    return ((h ^ (h >> np.uint64(29))) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def char_features(cps: np.ndarray, at: np.ndarray, chars: tuple[tuple[str, str], ...] = CHARS) -> np.ndarray:
    """Hashed features of the sites of CHARS at the places `at` of a padded array without line feeds."""
    kind, site = tables(chars)
    e = site[cps[at]].astype(np.uint64)
    a, b, c, d = (cps[at + k].astype(np.uint64) for k in (-2, -1, 1, 2))
    ka, kb, kc, kd = (kind[cps[at + k]].astype(np.uint64) for k in (-2, -1, 1, 2))
    ones = np.ones(len(at), np.uint64)
    return np.stack([
        cell(0, e, ones), cell(1, e, b), cell(2, e, c), cell(3, e, a, b), cell(4, e, c, d), cell(5, e, b, c), cell(6, e, kb, kc),
        cell(7, e, ka * np.uint64(16) + kb, kc * np.uint64(16) + kd), cell(8, e, a * np.uint64(1 << 21) + b, c), cell(9, e, b, c * np.uint64(1 << 21) + d),
    ], 1)


def _h(*parts: object) -> int:
    h = 2166136261
    for b in "\x00".join(map(str, parts)).encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return (h ^ h >> 15) & ((1 << BITS) - 1)


def skeletons(letters: tuple[tuple[str, str], ...]) -> dict[str, str] | None:
    """What each letter is written as so that both sides of every confusion are written alike; None where confusions contradict each other."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for a, b in letters:
        if len(a) == len(b) == 1:
            root[max(find(a), find(b))] = min(find(a), find(b))
    longer = {find(min(a, b, key=len)): max(a, b, key=len) for a, b in letters if len(a) + len(b) == 3}

    def write(c: str, depth: int = 0) -> str:
        c = find(c)
        return c if c not in longer or depth > 4 else "".join(write(x, depth + 1) for x in longer[c])

    out = {c: write(c) for pair in letters for x in pair for c in x}
    ok = all("".join(out[c] for c in a) == "".join(out[c] for c in b) for a, b in letters)
    return out if ok else None


def learned_letters(lexicon: dict[str, int], scanned: list[str], listed: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """Confusions (misread, meant) of one or two letters that unknown words of scans show against frequent known ones, most shown first.

    Names differ from each other by any letters, but then about as often one way as the other.
    """
    where: dict[tuple[str, str], set[str]] = {}
    for v, c in lexicon.items():
        if len(v) >= 5 and c >= 5 and v.isalpha():
            for i in range(len(v)):
                for m in (1, 2):
                    if i + m <= len(v):
                        where.setdefault((v[:i], v[i + m :]), set()).add(v)
    words = {w.lower() for t in scanned for w in WORD.findall(t) if SPACED_WORD.match(w)} - lexicon.keys()
    shown: dict[tuple[str, str], set[str]] = {}
    for w in words:
        for i in range(len(w)):
            for m in (1, 2):
                for v in where.get((w[:i], w[i + m :]), ()) if i + m <= len(w) and len(w) >= 5 else ():
                    x, y = w[i : i + m], v[i : len(v) - len(w) + i + m]
                    if x != y and not (len(x) == len(y) == 2 and (x[0] == y[0] or x[1] == y[1])) and not (len(x) != len(y) and (x in y or y in x)):
                        shown.setdefault((x, y), set()).add(w)
    n = {k: len(v) for k, v in shown.items()}
    return sorted((k for k, c in n.items() if k not in listed and c >= SHOWN and c >= ONE_WAY * n.get(k[::-1], 0)), key=lambda k: (-n[k], k))


def learned_chars(clean: list[str], scanned: list[str], listed: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """Confusions (misread, meant) of characters of scripts without spaces that are in no list."""
    n, seen = shown_chars(clean, scanned)
    sure = [k for k, c in n.items() if k not in listed and c >= SHOWN and c >= ONE_WAY * n.get(k[::-1], 0) and c >= SHARE * seen[k[0]]]
    return sorted(sure, key=lambda k: (-n[k], k))


def doubtful_chars(clean: list[str], scanned: list[str], listed: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """Listed confusions that these scans don't have: fewer than one in DOUBT of a character's places, of which there are at least as many, shows them."""
    n, seen = shown_chars(clean, scanned)
    return {k for k in listed if seen[k[0]] >= DOUBT > 0 and n.get(k, 0) * DOUBT < seen[k[0]]}


def shown_chars(clean: list[str], scanned: list[str]) -> tuple[dict[tuple[str, str], int], Counter[str]]:
    """(contexts that show each confusion, places of each character in scans): what scans have between two characters on either side where clean text always has another."""
    kept: dict[tuple[str, str], Counter[str]] = {}
    for t in clean:
        for m in CJK.finditer(t, 2, max(2, len(t) - 2)):
            i = m.start()
            kept.setdefault((t[i - 2 : i], t[i + 1 : i + 3]), Counter())[t[i]] += 1
    seen: Counter[str] = Counter()
    shown: dict[tuple[str, str], set[tuple[str, str]]] = {}
    for t in scanned:
        t = t.replace("\n", "")
        for m in CJK.finditer(t, 2, max(2, len(t) - 2)):
            i = m.start()
            seen[t[i]] += 1
            k = (t[i - 2 : i], t[i + 1 : i + 3])
            own = kept.get(k)
            if own and t[i] not in own:
                for y, c in own.items():
                    if c >= 2:
                        shown.setdefault((t[i], y), set()).add(k)
    return {k: len(v) for k, v in shown.items()}, seen


class Words(NamedTuple):
    """Counts of words of clean texts and of words with a hyphen of all, and texts that have the words of scans."""

    n: dict[str, float]
    hyphened: dict[str, float]
    scanned: list[str]


HYPHENED = regex.compile(r"(?<![\p{L}-])\p{L}+-\p{L}+")


def spaced_words(t: str) -> list[str]:
    return [w.lower() for w in WORD.findall(t) if SPACED_WORD.match(w)]


def words_of(sample: list[str], scanned: list[str]) -> Words:
    n: Counter[str] = Counter()
    hyphened: Counter[str] = Counter()
    for t in sample:
        n.update(spaced_words(t))
    for t in (*sample, *scanned):
        hyphened.update(m.lower() for m in HYPHENED.findall(t))
    return Words(n, hyphened, scanned)


def counted(elements: DataFrame) -> Words:
    """words_of all clean contents of one line and all texts of several lines, of at least SHORT characters.

    Of more than SAMPLE and SCANNED texts a count is the rate in so many; words of clean texts with a rate below 2, and words
    of scans with one below 1, are left out, which bounds what comes to the driver.
    """
    line = F.contains("text", F.lit("\n"))
    text = elements.select(F.col("content").alias("text")).unionByName(elements.where(F.contains("ocr_text", F.lit("\n"))).select(F.col("ocr_text").alias("text")))
    own = text.where(F.length("text") >= SHORT).select("text", line.alias("paged"))
    total = own.agg(F.count_if(~F.col("paged")).alias("clean"), F.count_if("paged").alias("paged")).first()
    unit = {False: max(1.0, total["clean"] / SAMPLE), True: max(1.0, total["paged"] / SCANNED)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[bool, bool], Counter[str]] = {(p, h): Counter() for p in (False, True) for h in (False, True)}

        def out() -> Iterator[pa.RecordBatch]:
            for (paged, hyphen), own in n.items():
                got: Counter[str] = Counter()
                for w, c in own.items():
                    if hyphen or SPACED_WORD.match(w):
                        got[w.lower()] += c
                own.clear()
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([paged] * len(got)), pa.array([hyphen] * len(got)), pa.array(list(got)), pa.array(list(got.values()), pa.int64())], ["paged", "hyphen", "w", "n"])

        for b in batches:
            for t, paged in zip(*(c.to_pylist() for c in b.columns)):
                n[paged, False].update(WORD.findall(t))
                if "-" in t:
                    n[paged, True].update(HYPHENED.findall(t))
            if sum(map(len, n.values())) > 200_000:
                yield from out()
        yield from out()

    rate = F.col("n") / F.when(F.col("paged"), unit[True]).otherwise(unit[False])
    every = own.mapInArrow(run, "paged boolean, hyphen boolean, w string, n bigint").groupBy("paged", "hyphen", "w").agg(F.sum("n").alias("n")).withColumn("n", rate)
    every = every.groupBy("hyphen", "w", F.when(~F.col("hyphen"), F.col("paged")).alias("paged")).agg(F.sum("n").alias("n"))
    rows = every.where(F.col("n") >= F.when(F.col("paged"), 1.0).otherwise(2.0)).collect()
    of = lambda hyphen, paged: {r["w"]: r["n"] for r in rows if r["hyphen"] is hyphen and r["paged"] is paged}
    return Words(of(False, False), of(True, None), [" ".join(sorted(of(False, True)))])


class Editor:
    """Lexicon and perceptron weights; the one bounded by its least rate, the other by BITS."""

    def __init__(self, sample: list[str], scanned: list[str] = (), words: Words | None = None) -> None:
        n, hyphened, read = words or words_of(sample, scanned)
        # a word that is met once may be misread itself
        self.lexicon = {w: int(c) for w, c in n.items() if c >= 2}
        self.letters = (*LETTERS, *learned_letters(self.lexicon, read, {*LETTERS}))
        doubtful = doubtful_chars(sample, scanned, {*CHARS})
        self.chars = (*(k for k in CHARS if k not in doubtful), *learned_chars(sample, scanned, {*CHARS}))
        self.skeleton = skeletons(self.letters)
        self.known = None if self.skeleton is None else {self.bone(w) for w in self.lexicon}
        self.compounds = {w for w, c in hyphened.items() if c >= 2}
        self.parts = {p for w in self.compounds for p in w.split("-")}
        self.grams = {w[i : i + 3] for w in self.lexicon for w in (f"^{w}$",) for i in range(len(w) - 2)}
        self.w = np.zeros(1 << BITS, np.float32)
        self.gaps: dict[tuple[str, str], bool] = {}
        self.forms: dict[tuple, bool] = {}
        self._train(sample, scanned)

    def bone(self, w: str) -> str:
        return "".join(map(self.skeleton.get, w, w))

    # page numbers

    def page_features(self, line: str, top: int, bottom: int) -> list[int]:
        """Features of a line by its form, its signs and its place: lines above and below it, at most EDGE."""
        t, b = min(top, EDGE), min(bottom, EDGE)
        f = form(line) + "!" * (t == b == 0)  # a text of its own is no line of a page
        shape = regex.sub(r"\p{L}+", "a", f)
        listed = PAGE.match(line.strip()) is not None
        return [_h("form", f), _h("shape", shape), _h("place", min(t, b)), _h("shapeplace", shape, min(t, b)), _h("listed", listed), _h("listedplace", listed, min(t, b)), _h("long", min(6, len(f) // 4)), _h("none", "#" in f)]

    def is_page_no(self, line: str, top: int, bottom: int) -> bool:
        """Whether a line is only a page number."""
        line = line.strip()
        if len(line) > FORM or not DIGITS.search(line):
            return False
        k = (form(line), min(top, EDGE), min(bottom, EDGE), PAGE.match(line) is not None)
        if k not in self.forms:
            if len(self.forms) > 200_000:
                self.forms.clear()
            self.forms[k] = float(self.w[self.page_features(line, top, bottom)].sum()) > 0
        return self.forms[k]

    def _page_examples(self, sample: list[str], scanned: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lines of scanned texts: those of a listed form, or of one that has many numbers at edges and none inside, against all others, and bare numbers that are a text of their own.

        Listed forms serve as examples where a corpus has too few pages.
        """
        edge: dict[str, set[str]] = {}
        inner: Counter[str] = Counter()
        lines = [(s, i, len(ls) - 1 - i) for t in scanned for ls in (t.split("\n"),) for i, s in enumerate(ls) if s.strip()]
        for s, i, j in lines:
            f = form(s)
            if can_be_page_no(s):
                if min(i, j) == 0 and i + j > 0:
                    edge.setdefault(f, set()).add(s)
                elif min(i, j) >= EDGE:
                    inner[f] += 1
        own = {f for f, ss in edge.items() if len(ss) >= 5 and len(ss) > 10 * inner[f] and not BODY.search(next(iter(ss)).strip())}
        rows, ys = [], []
        for k, place in ((k, p) for k in range(1, 40) for p in ((0, 9), (9, 0), (2, 9), (9, 9))):
            for s in (f"{k}", f"- {k} -", f"({k})", f"[{k}]", f"{k}/{k + 9}", f"Page {k}", f"Page {k} of 40", f"Seite {k}", f"p. {k}", f"S. {k} von 50", f"第{k}頁", f"{k}ページ", f"стр. {k}", f"Página {k} de 9"):
                rows.append(self.page_features(s, *place))
                ys.append(True)
            for s in (f"v{k}.{k + 1}", f"REQ-{k}", f"Fig. {k}", f"{k}.{k} kg", f"{k} items", f"A{k} and B{k + 1}", f"{k}%", f"{k},{k + 100}.50 EUR", f"x_{k}", f"Report / 1.{k}", f"{k}. Title", f"{k}件", f"第{k}節", f"表{k}", f"No. {k}"):
                rows.append(self.page_features(s, *place))
                ys.append(False)
            for _ in range(6):  # a bare number that is a text of its own
                rows.append(self.page_features(f"{k}", 0, 0))
                ys.append(False)
        for t in sample:
            ws = t.split(" ")
            for i in range(0, len(ws), 3):
                if can_be_page_no(s := " ".join(ws[i : i + 3])) and not PAGE.match(s):
                    rows.append(self.page_features(s, i % 4, EDGE))
                    ys.append(False)
        for s, i, j in lines:
            f = form(s)
            if can_be_page_no(s):
                listed = PAGE.match(s.strip()) is not None
                if listed or f in own:
                    rows.append(self.page_features(s, i, j))
                    ys.append(not (f == "#" and i == j == 0))
                elif f not in edge or inner[f]:
                    rows.append(self.page_features(s, i, j))
                    ys.append(False)
        return np.array(rows, np.int64), np.array(ys)

    # words

    def word_sites(self, w: str) -> list[tuple[int, int]]:
        """(place, edit) of what the confusions allow in a word."""
        return [(i, k) for k, (a, _b) in enumerate(self.letters) for i in range(len(w)) if w.startswith(a, i)]

    def edited(self, w: str, i: int, k: int) -> str:
        a, b = self.letters[k]
        return w[:i] + b + w[i + len(a) :]

    def word_features(self, w: str, i: int, k: int) -> list[int]:
        """Features of an edit in a word that the lexicon doesn't know."""
        v = self.edited(w, i, k)
        a, b = self.letters[k]
        known = self.lexicon.get(v, 0)
        p = f"^{w}$"
        q = f"^{v}$"
        bad = sum(p[j : j + 3] not in self.grams for j in range(max(0, i - 1), min(len(p) - 2, i + len(a) + 1)))
        bad2 = sum(q[j : j + 3] not in self.grams for j in range(max(0, i - 1), min(len(q) - 2, i + len(b) + 1)))
        digit = a.isdigit() and w.replace(a, "").isalpha()
        size = min(3, len(w) // 3)
        return [
            _h("bias", k), _h("known", k, min(4, known.bit_length())), _h("known", known > 0, size), _h("bad", bad, bad2), _h("less", k, np.sign(bad - bad2)),
            _h("digit", k, digit, 0 < i < len(w) - 1), _h("near", k, p[i], p[min(len(p) - 1, i + 1 + len(a))]), _h("kd", known > 0, digit, bad2 == 0),
        ]

    def word_edit(self, w: str) -> tuple[int, int] | None:
        """(place, edit) of the best edit of a word in lower case, if any is better than to keep it."""
        best, top = None, 0.0
        for i, k in self.word_sites(w):
            s = float(self.w[self.word_features(w, i, k)].sum())
            if s > top:
                best, top = (i, k), s
        return best

    def unknown(self, w: str) -> bool:
        """Whether a word, as it is written, is a site: of one script, no code or number, and not in the lexicon."""
        if len(w) < 3 or not SPACED_WORD.match(w) or w.isdigit():
            return False
        if any(c.isdigit() for c in w) and (w.upper() == w or sum(c.isdigit() for c in w) * 2 > len(w) or (w[-1].isdigit() and w[-2].isdigit())):
            return False
        return w.lower() not in self.lexicon

    def repair_word(self, w: str, memo: dict[str, str]) -> str:
        """A word with its edits, several if one leads to a known word only with another."""
        if w in memo:
            return memo[w]
        low, out = w.lower(), w
        # without digits only a word of the lexicon counts, and edits don't change the skeleton
        if self.unknown(w) and len(low) == len(w) and (self.known is None or any(c.isdigit() for c in w) or self.bone(low) in self.known):
            for _ in range(3):
                got = self.word_edit(low)
                if not got:
                    break
                i, k = got
                a, b = self.letters[k]
                up = out[i].isupper()
                out = out[:i] + (b.capitalize() if up else b) + out[i + len(a) :]
                low = self.edited(low, i, k)
                if low in self.lexicon:
                    break
            if (low not in self.lexicon or w[0].isupper() and len(w) < 6) and not any(c.isdigit() for c in w):
                out = w  # names and rare words are no misreadings of each other
            if any(c.isdigit() for c in w) and any(c.isdigit() for c in out):
                out = w
        memo[w] = out
        return out

    # broken words

    def break_features(self, left: str, mark: str, right: str, whole: bool) -> list[int]:
        a, b = left.lower(), right.lower()
        joined, comp = self.lexicon.get(a + b, 0), f"{a}-{b}" in self.compounds
        known = (a in self.lexicon, b in self.lexicon)
        j = joined > 0
        return [_h("br", mark, j), _h("joined", j, comp), _h("parts", mark, *known, j), _h("in", a in self.parts, b in self.parts, j, mark), _h("low", right[0].islower(), left[-1].islower(), mark, j), _h("whole", whole, mark, j), _h("lens", min(4, len(a)), min(4, len(b)), known, j), *(_h("name", n, *known, j, left[0].isupper()) for n in range(3))]

    def gap_features(self, a: str, b: str) -> list[int]:
        """Features of a line end by the characters on both sides."""
        ka, kb = _class(a), _class(b)
        return [_h("gap", ka, kb), _h("gl", a, kb), _h("gr", ka, b), _h("ga", ka), _h("gb", kb), _h("gboth", a, b)]

    def spaced(self, a: str, b: str, memo: dict[tuple[str, str], bool]) -> bool:
        """Whether a line end between two characters is joined with a space rather than with nothing."""
        if (a, b) not in memo:
            memo[a, b] = float(self.w[self.gap_features(a, b)].sum()) > 0
        return memo[a, b]

    def joins(self, left: str, mark: str, right: str, whole: bool) -> bool:
        """Whether the mark at a line end breaks a word, rather than being part of a compound."""
        if (w := self.repair_word(left + right, {})) != left + right:
            left, right = w[: len(left)], w[len(left) :] or right
        return float(self.w[self.break_features(left, mark, right, whole)].sum()) > 0

    # training

    def _train(self, sample: list[str], scanned: list[str]) -> None:
        rng = np.random.default_rng(11)
        groups: list[tuple[np.ndarray, np.ndarray]] = []
        # characters: the meant one is put back for the misread one, in a copy; what is there already is kept
        _kind, site = tables(self.chars)
        back = {ord(b): ord(a) for a, b in self.chars[::-1]}
        put = np.zeros(0x110000, np.uint32)
        for b, a in back.items():
            put[b] = a
        cps = pad(codepoints.split(pa.array([t.replace("\n", "") for t in sample], pa.string()))[0])
        noisy = cps.copy()
        can = np.flatnonzero(put[cps])
        hit = can[rng.random(len(can)) < NOISE]
        noisy[hit] = put[cps[hit]]
        label = np.zeros(len(cps), bool)
        label[hit] = True
        at = np.flatnonzero(site[noisy] >= 0)
        at = at[(at > 1) & (at < len(cps) - 2)]
        if len(at):
            groups.append((char_features(noisy, at, self.chars), label[at]))
        # words
        rows, ys = [], []
        common = sorted(self.lexicon, key=lambda w: (-self.lexicon[w], w))[:NOISY]
        for w in common:
            for k, (a, b) in enumerate(self.letters):
                for i in range(len(w)):
                    if w.startswith(b, i) and rng.random() < 0.5:
                        v = w[:i] + a + w[i + len(b) :]
                        if v not in self.lexicon and len(v) >= 3:
                            for j, k2 in self.word_sites(v):
                                rows.append(self.word_features(v, j, k2))
                                ys.append(self.edited(v, j, k2) == w)
        rare = sorted({w.lower() for t in sample for w in WORD.findall(t) if SPACED_WORD.match(w) and not w.isdigit()} - self.lexicon.keys())
        rare = [rare[i] for i in rng.permutation(len(rare))]
        for w in rare[:NOISY]:  # words that are met once: names
            if self.unknown(w):
                for j, k2 in self.word_sites(w):
                    if self.lexicon.get(self.edited(w, j, k2), 0) == 0:
                        rows.append(self.word_features(w, j, k2))
                        ys.append(False)
        if rows:
            groups.append((np.array(rows, np.int64), np.array(ys)))
        # broken words and compounds
        rows, ys = [], []
        for w in common:
            if len(w) >= 5 and w.isalpha():
                i = int(rng.integers(2, len(w) - 1))
                m = BREAKS[int(rng.integers(len(BREAKS)))]
                rows.append(self.break_features(w[:i], m, w[i:], False))
                ys.append(True)
        for w in rare[: NOISY // 2]:  # names
            if len(w) >= 5 and w.isalpha() and SPACED_WORD.match(w):
                i = int(rng.integers(2, len(w) - 1))
                rows.append(self.break_features(w[:i].capitalize(), "-", w[i:], False))
                ys.append(True)
        for w in sorted(self.compounds):
            a, b = w.split("-")
            for _ in range(max(1, min(COPIES, len(common) // max(1, len(self.compounds)) // 4))):
                rows.append(self.break_features(a, "-", b, False))
                ys.append(False)
        for _ in range(2 * len(rows)):  # two words that aren't one: compounds that the sample may not have
            a, b = common[int(rng.integers(len(common)))], common[int(rng.integers(len(common)))]
            if len(a) > 2 and len(b) > 1 and (a + b).isalpha() and a + b not in self.lexicon:
                rows.append(self.break_features(a, "-", b, False))
                ys.append(False)
        if rows:
            groups.append((np.array(rows, np.int64), np.array(ys)))
        # line ends: put between any two characters of clean text, at a space for the one label and elsewhere in scripts without spaces for the other
        rows, ys = [], []
        for t in sample:
            for i in rng.integers(1, max(2, len(t) - 1), 4).tolist():
                if i + 1 < len(t):
                    if t[i] == " " and t[i - 1] != " " and t[i + 1] != " ":
                        rows.append(self.gap_features(t[i - 1], t[i + 1]))
                        ys.append(True)
                    elif t[i - 1] != " " and t[i] != " " and (CJK.match(t[i - 1]) or CJK.match(t[i])):
                        rows.append(self.gap_features(t[i - 1], t[i]))
                        ys.append(False)
            for i in [m.start() for m in regex.finditer(r"(?<=\S) (?=\S)", t)][:8]:
                rows.append(self.gap_features(t[i - 1], t[i + 1]))
                ys.append(True)
        if rows:
            groups.append((np.array(rows, np.int64), np.array(ys)))
        groups.append(self._page_examples(sample, scanned))
        for x, y in groups:
            self._fit(x, y, rng)

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Averaged perceptron in small batches; a group's features are its own, so groups are fitted one after another."""
        if not len(x):
            return
        if len(x) > EXAMPLES:
            keep = np.sort(rng.permutation(len(x))[:EXAMPLES])
            x, y = x[keep], y[keep]
        w, total = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float64)
        sign = np.where(y, 1.0, -1.0)
        steps = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for s in range(0, len(order), 512):
                own = order[s : s + 512]
                wrong = own[w[x[own]].sum(1) * sign[own] <= 0.5]
                if len(wrong):
                    np.add.at(w, x[wrong].ravel(), np.repeat(sign[wrong], x.shape[1]))
                if s % (512 if len(x) < 32_768 else 4096) == 0:
                    total += w
                    steps += 1
        mean = (total / max(1, steps)).astype(np.float32)
        self.w += mean

    # whole texts

    def char_edits(self, cps: np.ndarray) -> np.ndarray:
        """Places of misread characters of CHARS in a padded array without line feeds."""
        site = tables(self.chars)[1]
        at = np.flatnonzero(site[cps] >= 0)
        if not len(at):
            return at
        return at[self.w[char_features(cps, at, self.chars)].sum(1) > SURE]


def pad(cps: np.ndarray) -> np.ndarray:
    return np.concatenate(([0x0A, 0x0A], cps, [0x0A, 0x0A])).astype(np.uint32)


def body(e: Editor, t: str, heads: set[int]) -> tuple[str, bool]:
    """(text without furniture lines, whether any was a page number)."""
    lines = t.split("\n")
    out, number = [], False
    for i, s in enumerate(lines):
        if i in heads:
            continue
        if s.strip() and e.is_page_no(s, i, len(lines) - 1 - i):
            number = True
            continue
        out.append(s)
    return "\n".join(out), number


def page_hyphens(e: Editor, t: str) -> tuple[str, bool]:
    """(text in which broken words are whole, whether there was any)."""
    found = False

    def one(m: regex.Match) -> str:
        nonlocal found
        left, mark, right = m.groups()
        if CJK.search(left[-1] + right[0]):
            return m.group()
        whole = m.start() > 0 and t[m.start() - 1] in "-_/" or m.end() < len(t) and t[m.end()] in "-_/"
        if not right[0].islower() or not e.joins(left, mark, right, whole):
            return left + mark + right
        found = True
        return left + right + "\n"

    return BROKEN.sub(one, t), found


@lru_cache(maxsize=4096)
def _class(c: str) -> int:
    """A script class for features of line ends; punctuation of scripts without spaces is one of theirs."""
    k = int(classes_of()[ord(c)])
    return 8 if c in "。、」』）「『（！？" else k if k else 20 + "LNPSZC".find(unicodedata.category(c)[0])


@lru_cache(maxsize=1)
def classes_of() -> np.ndarray:
    return classes()


def join_lines(e: Editor, t: str, memo: dict[tuple[str, str], bool]) -> str:
    """Continuous paragraphs: a blank line ends one, other line ends are joined with a space or nothing, as the editor decides by the characters around."""
    out = []
    for para in BLANK_LINE.split(t):
        s = ""
        for line in para.split("\n"):
            line = line.strip()
            if s and line and e.spaced(s[-1], line[0], memo):
                s += " "
            s += line
        if s:
            out.append(s)
    return "\n".join(out)


def repair(e: Editor, texts: list[str], heads: list[set[int]], memo: dict[str, str]) -> list[tuple[set[str], str]]:
    """(kinds shown but for headers, continuous text) of each text."""
    kinds: list[set[str]] = []
    flat: list[str] = []
    for t, f in zip(texts, heads):
        own: set[str] = set()
        s, number = body(e, t, f)
        if number:
            own.add("page_no")
        s, broken = page_hyphens(e, s)
        if broken:
            own.add("hyphen")
        kinds.append(own)
        flat.append(HIDDEN.sub("", join_lines(e, s, e.gaps)))
    cps, bounds = codepoints.split(pa.array(flat, pa.string()))
    # paragraphs' line feeds count as neighbours; sites lie inside, away from the padding
    p = pad(cps)
    hits = e.char_edits(p)
    site = tables(e.chars)[1]
    if len(hits):
        meant = np.array([ord(b) for _a, b in e.chars], np.uint32)
        p[hits] = meant[site[p[hits]]]
        of = np.searchsorted(bounds, hits - 2, "right") - 1
        for i in np.unique(of).tolist():
            kinds[i].add("misread")
            flat[i] = codepoints.text(p[bounds[i] + 2 : bounds[i + 1] + 2])
    out = []
    for own, s in zip(kinds, flat):
        bad = False

        def one(m: regex.Match) -> str:
            nonlocal bad
            w = m.group()
            v = memo.get(w)
            if v is None:
                if len(memo) > 200_000:
                    memo.clear()
                v = e.repair_word(w, memo)
            if v == w:
                return w
            a, b = m.start(), m.end()
            if a and s[a - 1] in "_-/." and (a < 2 or s[a - 2] != " ") or b < len(s) and s[b] in "_/" or (b + 1 < len(s) and s[b] in "-." and s[b + 1].isalnum() and any(c.isdigit() for c in w)):
                return w  # part of an identifier
            bad = True
            return v

        fixed = WORD.sub(one, s)
        if bad:
            own.add("misread")
        out.append((own, fixed))
    return out


def editor(elements: DataFrame) -> Editor:
    """The editor of a corpus. Its words, compounds and confusions of letters are counted in all texts.

    Its weights, forms of page numbers and confusions of characters are trained on at most SAMPLE clean contents of one line,
    and at most SCANNED texts of several lines. For that only, texts of fewer than SHORT or more than LONG characters are left out.
    """
    line = F.contains("text", F.lit("\n"))
    own = elements.select("elem_id", F.explode(F.array("content", "ocr_text")).alias("text"), F.col("content").alias("c")).where(F.length("text").between(SHORT, LONG))
    clean = own.where(~line & (F.col("text") == F.col("c")) & (F.length("text") <= 700))
    paged = own.where(line)
    n = own.agg(F.count_if(~line).alias("clean"), F.count_if(line).alias("paged")).first()
    sample = [[r["text"] for r in bounded_sample(t, "elem_id", k, of=n[c], spare=4).collect()] for t, k, c in ((clean, SAMPLE, "clean"), (paged, SCANNED, "paged"))]
    return Editor(*sample, counted(elements))


def head_candidates(elements: DataFrame) -> DataFrame:
    """elem_id, field, line, run_id, k, h of all lines of texts of several lines that can be running headers; h: hash of the text for lines at its edges, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, col in (("content", b.column(2)), ("ocr_text", b.column(3))):
                for e, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), col.to_pylist()):
                    if t and "\n" in t:
                        lines = t.split("\n")
                        own = [(i, k) for i, s in enumerate(lines) if (k := head_key(s))]
                        if own:
                            h, n = hash_text(t), len(lines)
                            rows += [(e, name, i, r, k, h if i < EDGE or i >= n - EDGE else None) for i, k in own]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["elem_id", "field", "line", "run_id", "k", "h"])

    paged = F.contains("content", F.lit("\n")) | F.contains("ocr_text", F.lit("\n"))
    return elements.where(paged).select("elem_id", "run_id", "content", "ocr_text").mapInArrow(run, "elem_id bigint, field string, line int, run_id bigint, k string, h bigint")


def headers(elements: DataFrame) -> DataFrame:
    """elem_id, heads array<struct<field, line>>: the running headers and footers of each element.

    The recurring lines of a run come in blocks of about BLOCK, and each distinct line of the run is compared with each block,
    so that no run's lines are in one row or task, whatever their number. Only lines are shuffled, no text.
    """
    every = cut(head_candidates(elements))
    often = seeds(every.where("h is not null and length(k) >= 6"))
    parts = often.groupBy("run_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = often.join(parts, "run_id").groupBy("run_id", F.pmod(F.xxhash64("seed"), F.col("parts")).alias("part")).agg(F.collect_set("seed").alias("seeds"))
    cand = every.join(parts.select("run_id"), "run_id", "left_semi")
    pairs = cand.select("run_id", "k").distinct().join(own, "run_id").select("run_id", "k", "seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, of = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = [i for i, (k, xs) in enumerate(zip(ks, of)) if any(within(k, x, max(1, len(x) // 5)) for x in xs)]
            if hit:
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["run_id", "k"])

    hits = pairs.mapInArrow(run, "run_id bigint, k string").distinct()
    return cand.join(hits, ["run_id", "k"]).groupBy("elem_id").agg(F.collect_set(F.struct("field", "line")).alias("heads"))  # at most the lines of an element


def scanned(elements: DataFrame, results: DataFrame) -> DataFrame:
    """elem_id, content, ocr_text, heads of the elements with text of results of type pdf and docx, in any letter case.

    Texts are shuffled once, by element, so no run is in one task.
    """
    runs = results.where(F.lower("file_type").isin("pdf", "docx")).select("run_id").distinct()
    e = elements.where("content <> '' or ocr_text <> ''").select("run_id", "elem_id", "content", "ocr_text")
    if runs.limit(SMALL + 1).count() <= SMALL:
        runs = F.broadcast(runs)
    own = e.join(runs, "run_id", "left_semi")
    return own.join(headers(own), "elem_id", "left").select("elem_id", "content", "ocr_text", "heads")


def repaired(elements: DataFrame, results: DataFrame, keep_text: bool = True) -> DataFrame:
    """elem_id, field, kinds array<string> and, with keep_text, text in continuous paragraphs, of every scanned text.

    Null and empty texts give no row; a text without noise comes back joined, with no kinds; repeated rows stay repeated.
    """
    own_editor = elements.sparkSession.sparkContext.broadcast(editor(elements))
    schema = "elem_id bigint, field string, kinds array<string>" + ", text string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for b in batches:
            own = b.column(3).to_pylist()
            for name, col in (("content", b.column(1)), ("ocr_text", b.column(2))):
                rows = [(i, t) for i, t in enumerate(col.to_pylist()) if t]
                heads = [{h["line"] for h in own[i] or () if h["field"] == name} for i, _t in rows]
                got = repair(own_editor.value, [t for _i, t in rows], heads, memo)
                kinds = [sorted(k | ({"header"} if f else set())) for (k, _), f in zip(got, heads)]
                keep = [n for n, k in enumerate(kinds) if keep_text or k]
                if not keep:
                    continue
                at = pa.array([rows[n][0] for n in keep], pa.int64())
                arrays = [b.column(0).take(at), pa.array([name] * len(keep)), pa.array([kinds[n] for n in keep], pa.list_(pa.string()))]
                if keep_text:
                    arrays.append(pa.array([got[n][1] for n in keep], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, ["elem_id", "field", "kinds", "text"][: len(arrays)])

    return scanned(elements, results).mapInArrow(run, schema)


def found(elements: DataFrame, results: DataFrame) -> DataFrame:
    """elem_id, kind: one row per scanned element and kind of noise that content or ocr_text shows."""
    return repaired(elements, results, keep_text=False).select("elem_id", F.explode("kinds").alias("kind")).distinct()
