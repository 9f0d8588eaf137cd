"""Sentences of documents in many languages and scripts, each with its place.

Scripts with spaces: every mark that can end a sentence, with what closes after it, is a node of a lattice of terminators.
A node's odds come from its context - the token before it, the first character after it, the quotes and brackets around
it; those of a full stop from what the corpus has after that token. The cheapest path through the lattice, on which a piece
without any letter costs extra, gives the sentences.

Scripts without spaces: runs are segmented by the cheapest path through a lattice of dictionary words. A gap - white space in
Thai, a line break of recognised text in Thai, Japanese and Chinese - is a boundary by the odds of the last word before it and
the first word after it: how much oftener they end or open clauses than they stand elsewhere. Full stops of their own are
nodes of the lattice above.

Dictionary, odds of words and odds of tokens are learned from all of the same texts, whose line ends and full stops are
boundaries for sure (see Model and fit). Pairs of quotes and brackets are matched first; no boundary lies inside a pair.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.engine import cut

# Abbreviations that never end a sentence.
NEVER = set(
    "dr mr mrs ms prof dipl ing fig figs sec secs no nos vs cf approx e.g eg i.e ie p pp art arts env vgl ca bzw gem abs nr z z.b b d.h u.a s ver v vol ch eq ref rev "
    "st m mm mme mlle dra sra sr pág pag núm ex n p.ex par chap cap op inkl exkl max min bspw evtl ggf sog tel str lfd geb "
    "т и инж др проф акад гос п пп стр рис табл гл ст см напр т.е т.к им ул тов डॉ क्र श्री सं पृ".split()
)
# Abbreviations that can end a sentence, which they do before a capital letter.
MAYBE = set("etc inc ltd co corp a.m p.m u.s u.k u.s.a e.u ff usw u.s.w al др т.д т.п г гг jr sen cia ltda".split())
# Short names of months, which end no sentence before a number.
MONTHS = set("jan feb mar apr jun jul aug sep sept oct nov dec okt dez janv févr avr juil déc fev set out янв февр авг сент окт нояб дек".split())
# German words after which a number with a point is an ordinal.
ORDINAL = set("am im vom zum bis dem den das die der des beim ab seit zur jede jeder jedem eine einer einem und".split())
# German months.
MONTH_NAMES = set("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())

OPENERS = {"「": "」", "『": "』", "（": "）", "(": ")", "《": "》", "〈": "〉", "【": "】", "[": "]", "«": "»", "„": "“", "“": "”", "‘": "’"}
QUOTES = '"“”„«»「」『』'
BRACKET = regex.compile("[" + regex.escape("".join({*OPENERS, *OPENERS.values(), '"'} - {"’", "‘"})) + "]")
#: Nodes: marks with what closes after them, or a line feed.
NODE = regex.compile(r"""(?:[。！？!?।॥．…]|\.)+(?:["”“»」』）)\]】》〉]|[ \u00a0\u202f]»)*|\n""")
CLOSE_TAIL = regex.compile(r"""(?:["”“»」』）)\]】》〉]|[ \u00a0\u202f]»)+$""")
WORD_PART = regex.compile(r"[\w.̀-ͯऀ-෿]")
CJK = regex.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
THAI = regex.compile(r"[฀-๿]")
#: Runs of a script without spaces, and the white space between two clauses of Thai, which may end with a bracket or a Latin word and begin with a bracket.
RUN = regex.compile(r"[฀-๿]+|[぀-ヺー-ヿ㐀-鿿ｦ-ﾟ]+")
THAI_GAP = regex.compile(r"(?<=[฀-๿)\]}A-Za-z])[ \n]+(?=[(\[{]?[฀-๿])")
SPACES = " \t\r\n 　   ​﻿"


def pairs(t: str, by_line: bool) -> list[tuple[int, int]]:
    """Matched pairs (open, close), outermost only, in order. What never closes is no pair."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in BRACKET.finditer(t):
        c, i = m.group(), m.start()
        if by_line and stack and t.find("\n", stack[0][1], i) >= 0:
            stack = [x for x in stack if t.find("\n", x[1], i) < 0]
        want = [x for x, _ in stack]
        if c == '"':
            k = len(want) - 1 - want[::-1].index('"') if '"' in want else None
            close = k is not None
        else:
            k = next((j for j in range(len(want) - 1, -1, -1) if want[j] == c), None)
            close = k is not None
        if close:
            _x, at = stack[k]
            del stack[k:]
            while out and out[-1][0] > at:
                out.pop()
            out.append((at, i))
        elif c in OPENERS:
            stack.append((OPENERS[c], i))
        elif c == '"':
            stack.append((c, i))
    return out


#: Counts of a kind of script are a rate: times in so many of its texts, where it has more.
UNIT = 3000
#: Longest words of the dictionary, in characters, and how often and in how many contexts on either side it must be seen.
LONGEST, LONGEST_THAI, SEEN, CONTEXTS = 6, 16, 4, 3
#: Odds of words that the sample doesn't have at a gap, of a Thai gap, and of a line break of recognised Japanese or Chinese, most of which are layout.
UNSEEN, THAI_PRIOR, LAYOUT_PRIOR = 0.0, -0.5, -12.0
#: What a piece without a letter costs, such as the number of a list item.
BARE = 20.0
#: Odds that stand for a rule.
SURE = 30.0
#: Times that the corpus must speak against a listed abbreviation to unlist it.
LISTED = 50
STOP = regex.compile(r"([\w.̀-ͯऀ-෿]+)\.(?=[\s\n]|$)[ \t\u00a0]*(\S?)")


class Model:
    """Dictionary and odds of texts; fit() has those of a table. Without texts it only knows the lists above.

    What it keeps is seen at a least rate, so its size is bounded by what UNIT texts hold and the longest words.
    """

    def __init__(self, texts: list[str] = ()) -> None:
        self.words: dict[str, float] = {}
        self.final: dict[str, float] = {}
        self.opening: dict[str, float] = {}
        self.stop: dict[str, float] = {}
        self._tokens(texts)
        self._words(texts)
        self._gaps(texts)

    # spaced scripts

    def _tokens(self, texts: list[str]) -> None:
        """Odds that a full stop after a token ends a sentence: line ends and what begins like a sentence against what goes on in small letters or numbers.

        What begins with a capital may be a name after a listed abbreviation, such as a title.
        """
        yes: Counter[str] = Counter()
        no: Counter[str] = Counter()
        for t in texts:
            for line in t.split("\n"):
                for m in STOP.finditer(line):
                    low, sure = stopped(m)
                    if sure is not None:
                        (yes if sure else no)[low] += 1
        self.set_stop(yes, no)

    def set_stop(self, yes: dict[str, float], no: dict[str, float]) -> None:
        yes, no = defaultdict(int, yes), Counter(dict.fromkeys(NEVER, LISTED)) + Counter(no)
        self.stop = {w: math.log((yes[w] + 1) / (no[w] + 1)) for w in {*yes, *no} if w and no[w] > 1}

    # scripts without spaces

    def _words(self, texts: list[str]) -> None:
        """Words: grams of runs that are frequent, in several contexts on both sides, with the cost of their frequency."""
        n: Counter[str] = Counter()
        left: dict[str, set[str]] = defaultdict(set)
        right: dict[str, set[str]] = defaultdict(set)
        for t in texts:
            for r in RUN.findall(t):
                longest = LONGEST_THAI if THAI.match(r) else LONGEST
                r = f"^{r}$"
                for i in range(1, len(r) - 1):
                    for k in range(1, min(longest, len(r) - 1 - i) + 1):
                        w = r[i : i + k]
                        n[w] += 1
                        if k > 1:
                            left[w].add(r[i - 1])
                            right[w].add(r[i + k])
        self.set_words(n, left, right, sum(n[w] for w in n if len(w) == 1))

    def set_words(self, n: dict[str, float], left: dict[str, set[str]], right: dict[str, set[str]], total: float) -> None:
        total = total or 1
        ok = lambda side, w: len(side[w]) >= CONTEXTS or side[w] & {"^", "$"}
        self.words = {w: -math.log(c / total) for w, c in n.items() if len(w) > 1 and c >= SEEN and ok(left, w) and ok(right, w)}
        self.single = math.log(total) + 2.0  # what no word covers costs by the character
        tails: dict[str, set[int]] = defaultdict(set)
        for w in self.words:
            tails[w[-2:]].add(len(w))
        self.tails = {w: sorted(ks) for w, ks in tails.items()}  # the lengths of the words that end with two characters

    def segment(self, run: str) -> list[str]:
        """Words of the cheapest path through the lattice of dictionary words."""
        n, words, tails, single = len(run), self.words, self.tails, self.single
        cost, back = [0.0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            best, at = cost[i - 1] + single, i - 1
            for k in tails.get(run[i - 2 : i], ()) if i > 1 else ():
                if k > i:
                    break
                c = words.get(run[i - k : i])
                if c is not None and cost[i - k] + c < best:
                    best, at = cost[i - k] + c, i - k
            cost[i], back[i] = best, at
        out = []
        while n:
            out.append(run[back[n] : n])
            n = back[n]
        return out[::-1]

    def _gaps(self, texts: list[str]) -> None:
        """Odds of last and first words: at line ends and full stops, which are boundaries, against the places between all other words."""
        sure: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        else_: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for t in texts:
            for line in t.split("\n"):
                for clause in regex.split(r"[。！？!?]+", line):
                    runs = [self.segment(r) for r in RUN.findall(clause)]
                    for ws in runs:
                        for j, w in enumerate(ws):
                            if j + 1 < len(ws):  # around white space it isn't known
                                else_[0][w] += 1
                            if j:
                                else_[1][w] += 1
                    if runs and RUN.match(clause.strip()[-1:]):
                        sure[0][runs[-1][-1]] += 1
                    if runs and RUN.match(clause.strip()[:1]):
                        sure[1][runs[0][0]] += 1
        self.set_gaps(sure, else_)

    def set_gaps(self, sure: tuple[dict[str, float], ...], else_: tuple[dict[str, float], ...]) -> None:
        for k, own in enumerate((self.final, self.opening)):
            a, b = sum(sure[k].values()), sum(else_[k].values())
            own.update({w: math.log((sure[k][w] + 0.5) / (a + 1)) - math.log((else_[k][w] + 0.5) / (b + 1)) for w in {*sure[k], *else_[k]}})

    def gap(self, before: str, after: str) -> float:
        """Odds that the gap between two stretches of text is a boundary, by the last word of one and the first of the other; what isn't of such a script counts as unseen."""
        last, first = RUN.match(before[::-1]), RUN.search(after)
        w = self.segment(last.group()[::-1])[-1] if last else ""
        v = self.segment(first.group())[0] if first else ""
        return self.final.get(w, UNSEEN) + self.opening.get(v, UNSEEN)


def stopped(m: regex.Match) -> tuple[str, bool | None]:
    """(token, whether the full stop of a match of STOP ends a sentence, None if it doesn't tell)."""
    low, nxt = m.group(1).lower().strip("."), m.group(2)
    if not nxt or low not in NEVER and (nxt.isupper() or CJK.match(nxt)):
        return low, True
    return low, False if nxt.islower() or nxt.isdigit() else None


def fit(texts: DataFrame) -> Model:
    """The model of all texts of a table with content: that of Model, with counts by Spark.

    Of a kind of script - Thai, Japanese and Chinese, other - with more than UNIT texts, a count is a rate, that of UNIT texts;
    what is seen less than once in UNIT texts is no word, context or token. Runs of scripts without spaces meet once,
    with their numbers; grams are counted only where all pairs of characters in them are frequent enough.
    """
    own = texts.where("content <> ''").select("content")
    thai, cjk = F.col("content").rlike("[฀-๿]"), F.col("content").rlike("[぀-ヿ㐀-鿿]")
    kinds = {"thai": thai, "cjk": cjk & ~thai, "other": ~cjk & ~thai}
    got = own.agg(*[F.count_if(k).alias(c) for c, k in kinds.items()]).first()
    unit = {c: max(1.0, got[c] / UNIT) for c in kinds}
    model = Model()
    model.set_stop(*_stops(own, F.when(thai, "thai").when(cjk, "cjk").otherwise("other"), unit))
    if got["thai"] + got["cjk"]:
        runs = _runs(own)
        of = lambda w: unit["thai" if THAI.match(w[0] if w[0] != "^" else w[1]) else "cjk"]
        by_script = runs.groupBy(F.col("run").rlike("^[฀-๿]").alias("thai")).agg(F.sum(F.length("run") * F.col("n")).alias("n")).collect()
        n, left, right = _grams(runs, unit, of)
        model.set_words(n, left, right, sum(r["n"] / unit["thai" if r["thai"] else "cjk"] for r in by_script))
        rows = _places(runs, model).collect()
        column = lambda c: Counter({r["w"]: r[c] / of(r["w"]) for r in rows if r[c]})
        model.set_gaps((column("last"), column("first")), (column("before"), column("after")))
    return model


def _stops(texts: DataFrame, kind: Column, unit: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """How often the full stop after a token ends a sentence and doesn't."""
    # of the places in a token only the first can begin a match, or where the last match ended
    places = F.regexp_extract_all("content", F.lit(r"(?U)(?:\G|(?<![\w.̀-ͯऀ-෿]))[\w.̀-ͯऀ-෿]+\.(?=\s|$)[ \t\u00a0]*\S?"), F.lit(0))
    m = texts.where(F.contains("content", F.lit("."))).select(kind.alias("kind"), F.explode(places).alias("m")).groupBy("kind", "m").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for kind, t, c in zip(*(x.to_pylist() for x in b.columns)):
                if (place := STOP.search(t)) and (got := stopped(place))[1] is not None:
                    n[got[1]][kind, got[0]] += c
            keys = list({**n[0], **n[1]})
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((*zip(*keys), [n[1][k] for k in keys], [n[0][k] for k in keys]), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "w", "yes", "no"])

    each = m.mapInArrow(run, "kind string, w string, yes bigint, no bigint").groupBy("kind", "w").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    per = F.create_map(*[F.lit(x) for kv in unit.items() for x in kv])[F.col("kind")]
    rate = each.groupBy("w").agg(F.sum(F.col("yes") / per).alias("yes"), F.sum(F.col("no") / per).alias("no"))
    rows = rate.where((F.col("no") > 1) | F.col("w").isin(*NEVER)).collect()
    return {r["w"]: r["yes"] for r in rows}, {r["w"]: r["no"] for r in rows}


#: What str.strip() takes for blank, for Java.
BLANK = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _runs(texts: DataFrame) -> DataFrame:
    """run, first, last, n: distinct runs of scripts without spaces, whether they begin and end a clause, and their number."""
    plain = F.when(F.contains("content", F.lit("\u0002")) | F.contains("content", F.lit("\u0003")), F.translate("content", "\u0002\u0003", "  ")).otherwise(F.col("content"))
    marked = F.concat(F.lit("\u0002"), F.regexp_replace(plain, "[。！？!?\n]", "\u0003\u0002"), F.lit("\u0003"))
    one = F.regexp_extract_all(marked, F.lit(rf"(?:\u0002{BLANK}*)?(?:{RUN.pattern})(?:{BLANK}*\u0003)?"), F.lit(0))
    n = texts.where(F.col("content").rlike(RUN.pattern)).select(F.explode(one).alias("m")).groupBy("m").count()
    return cut(n.select(F.regexp_extract("m", RUN.pattern, 0).alias("run"), F.col("m").startswith("\u0002").alias("first"), F.col("m").endswith("\u0003").alias("last"), F.col("count").alias("n")))


#: Characters of runs that are counted at a time.
CHUNK = 1 << 21


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, code points, numbers, is Thai) of the characters of many runs at a time, each run between ^ and $."""
    rs: list[str] = []
    ns: list[int] = []
    size = 0

    def out() -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        text = "".join(f"^{r}$" for r in rs)
        long = np.array([len(r) + 2 for r in rs])
        got = text, np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64), np.repeat(np.array(ns, np.int64), long), np.repeat(np.array([THAI.match(r) is not None for r in rs]), long)
        rs.clear()
        ns.clear()
        return got

    for b in batches:
        for r, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rs.append(r)
            ns.append(n)
            size += len(r) + 2
            if size > CHUNK:
                yield out()
                size = 0
    if rs:
        yield out()


def _grams(runs: DataFrame, unit: dict[str, float], of: Callable[[str], float]) -> tuple[dict[str, float], dict[str, set[str]], dict[str, set[str]]]:
    """(count, characters before, characters after) of the grams of two characters or more, each in units; ^ and $ are the ends of a run."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _text, c, n, thai in _arrays(batches):
            at = np.flatnonzero(c[:-1] != 0x24)
            ks, back = np.unique((c[at] << 21 | c[at + 1]) << 1 | thai[at], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(np.bincount(back, n[at]).astype(np.int64))], ["k", "n"])

    often = lambda thai: F.col("n") >= F.when(thai, unit["thai"]).otherwise(unit["cjk"])
    pairs = runs.select("run", "n").mapInArrow(pairs_of, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).where(often(F.col("k") % 2 == 1)).collect()
    n = {chr(r["k"] >> 22) + chr(r["k"] >> 1 & 0x1FFFFF): r["n"] for r in pairs}
    own = runs.sparkSession.sparkContext.broadcast(np.array(sorted({r["k"] for r in pairs}), np.int64))

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = own.value
        for text, c, n, thai in _arrays(batches):
            k = (c[:-1] << 21 | c[1:]) << 1 | thai[:-1]
            ok = known[np.minimum(np.searchsorted(known, k), len(known) - 1)] == k
            at, h, size = np.flatnonzero(ok), k.astype(np.uint64), 2
            while len(at):
                at = at[at + size < len(c)]
                at = at[ok[at + size - 1] & (size < np.where(thai[at], LONGEST_THAI, LONGEST) + 1)]
                size += 1
                h[at] = h[at] * np.uint64(0x9E3779B97F4A7C15) + c[at + size - 1].astype(np.uint64)
                if len(at):
                    _hs, first, back = np.unique(h[at], return_index=True, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([text[i : i + size] for i in at[first].tolist()]), pa.array(np.bincount(back, n[at]).astype(np.int64))], ["w", "n"])

    if pairs:
        longer = runs.select("run", "n").mapInArrow(grams_of, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
        n |= {r["w"]: r["n"] for r in longer.where(often(F.col("w").rlike("[฀-๿]"))).collect()}
    left: dict[str, set[str]] = defaultdict(set)
    right: dict[str, set[str]] = defaultdict(set)
    for w in n:
        left[w[1:]].add(w[0])
        right[w[:-1]].add(w[-1])
    return {w: c / of(w) for w, c in n.items() if w[0] != "^" and w[-1] != "$" and len(w) <= (LONGEST_THAI if THAI.match(w) else LONGEST)}, left, right


def _places(runs: DataFrame, model: Model) -> DataFrame:
    """w, last, first, before, after: how often a word ends and begins a clause, and stands before and after another one of its run."""
    own = runs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for b in batches:
            for r, first, last, c in zip(*(x.to_pylist() for x in b.columns)):
                ws = own.value.segment(r)
                for w in ws[:-1]:
                    n[w][2] += c
                for w in ws[1:]:
                    n[w][3] += c
                if last:
                    n[ws[-1]][0] += c
                if first:
                    n[ws[0]][1] += c
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), *(pa.array([v[k] for v in n.values()], pa.int64()) for k in range(4))], ["w", "last", "first", "before", "after"])

    each = runs.select("run", "first", "last", "n").mapInArrow(run, "w string, last bigint, first bigint, before bigint, after bigint")
    return each.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("last", "first", "before", "after")])


def thai_gaps(t: str, model: Model) -> list[int]:
    """Gaps of Thai text that are boundaries; the place after each."""
    out = []
    gaps = [m for m in THAI_GAP.finditer(t)]
    for k, m in enumerate(gaps):
        before = t[gaps[k - 1].end() if k else 0 : m.start()]
        after = t[m.end() : gaps[k + 1].start() if k + 1 < len(gaps) else len(t)]
        if model.gap(before, after) + THAI_PRIOR > 0:
            out.append(m.end())
    return out


def odds(t: str, m: regex.Match, start: int, end: int, ocr: bool, pair_at: dict[int, int], cjk: bool, model: Model) -> float:
    """Odds that the node, up to `end`, is the end of the sentence that begins at `start`: of a rule SURE or -SURE, of a full stop those of the token before it."""
    rule = ends(t, m, start, end, ocr, pair_at, cjk)
    if isinstance(rule, bool):
        return SURE if rule else -SURE
    token, first = rule
    low = token.lower()
    if low in model.stop:
        return model.stop[low] + 0.5
    return -1.0 if len(token) == 1 and token.isalpha() and (token.isupper() or token > "\x7f") else 2.0


def ends(t: str, m: regex.Match, start: int, end: int, ocr: bool, pair_at: dict[int, int], cjk: bool) -> bool | tuple[str, str]:
    """What rules say of a node, or (token before, first character after) of a full stop that none decides."""
    s = t[m.start() : end]
    tail = CLOSE_TAIL.search(s)
    mark = s[: tail.start()] if tail else s
    after = t[end : end + 1]
    if not after:
        return True
    spaced = after in SPACES and not (ocr and cjk and after == "\n")
    rest = t[end:end + 40].lstrip(SPACES)
    if not rest:
        return True
    if tail:
        opened = pair_at.get(end - 1, -1)
        quoted = s[-1] in QUOTES
        if opened >= 0:
            if rest[0] in ",，、;；:：-–—)）":
                return False
            if not spaced:
                before = t[opened - 1 : opened]
                return bool(quoted and before in ("：", ":") and (CJK.match(rest) is not None))
            if opened <= start:  # the pair is the whole sentence so far
                if quoted:
                    return rest[0].isupper() and not CJK.search(mark) and "ऀ" > rest[0]
                return True
            if quoted:
                return not rest[0].islower() or regex.match(r"[a-z]\w*[\dA-Z]", rest) is not None
            return any(x in mark for x in "。！？!?।")
    if mark[-1] in "。！？।॥" or mark[0] in "。！？।॥":
        return True
    if mark[0] == "．":
        return not (t[m.start() - 1 : m.start()].isdigit() and after.isdigit())
    if not spaced:
        return ("!" in mark or "?" in mark) and (CJK.match(after) is not None)
    if mark.strip(".…") == "" and (len(mark) > 1 or "…" in mark):
        return not (rest[0].islower() or CJK.match(rest)) and not cjk
    if "!" in mark or "?" in mark:
        return True
    # a single full stop
    a = m.start()
    while a > start and WORD_PART.match(t[a - 1]):
        a -= 1
    token = t[a : m.start()].strip(".")
    low = token.lower()
    first = rest[0]
    if ocr and cjk and after == "\n" and (first.isdigit() or first.islower()):
        return False
    if low in MONTHS:
        return not first.isdigit()
    if low in MAYBE:
        return first.isupper() or first in QUOTES
    if token.isdigit():
        b = a
        while b > start and t[b - 1] in SPACES:
            b -= 1
        c = b
        while c > start and t[c - 1].isalpha():
            c -= 1
        prev = t[c:b]
        nextw = regex.match(r"\w+", rest)
        if len(token) <= 2 and (prev.lower() in ORDINAL or (nextw and nextw.group() in MONTH_NAMES)):
            return False
        return True
    return token, first


def path(t: str, nodes: list[tuple[int, float]]) -> list[int]:
    """The ends on the cheapest path through the nodes (end, odds) of a text: breaking at a node costs its odds' opposite, a piece without a letter or digit-free mark BARE more.

    Linear: of the starts of a piece that ends at a node, those before its last letter differ only in the cost so far.
    """
    n = len(nodes)
    cost, back = [0.0] * (n + 1), [-1] * (n + 1)  # of the best path with a break at node i - 1; 0 is the beginning of the text
    ends_at = [0, *(e for e, _s in nodes)]
    best, best_at, far = math.inf, 0, 0  # the least cost of starts that lie before the last letter
    for j in range(1, n + 1):
        x = ends_at[j] - 1
        while x >= ends_at[j - 1] and not t[x].isalpha():
            x -= 1
        last = x if x >= ends_at[j - 1] else -1
        if last >= 0:
            while far < j and ends_at[far] <= last:
                if cost[far] < best:
                    best, best_at = cost[far], far
                far += 1
        c, at = best, best_at
        for i in range(far, j):
            if cost[i] + BARE < c:
                c, at = cost[i] + BARE, i
        cost[j], back[j] = c - nodes[j - 1][1], at
    j = min(range(n, -1, -1), key=cost.__getitem__)
    out = []
    while j > 0:
        out.append(ends_at[j])
        j = back[j]
    return out[::-1]


#: A model that only knows the lists.
PLAIN = Model()


def spans(t: str | None, ocr: bool = False, model: Model = PLAIN) -> list[tuple[int, int]]:
    """(start, end) of each sentence, white space around it left out; none for null, empty or blank text.

    ocr: line feeds are only layout. Otherwise each ends a sentence.
    """
    if not t or not t.strip(SPACES):
        return []
    own = pairs(t, not ocr)
    pair_at = {b: a for a, b in own}
    cjk = CJK.search(t) is not None and len(CJK.findall(t)) * 5 > len(t)
    cuts: list[int] = []
    nodes: list[tuple[int, float]] = []
    first = start = 0
    k = 0

    def close(upto: int) -> None:
        """The path through the nodes of a stretch that surely ends at `upto`."""
        nonlocal first, start
        cuts.extend(first + e for e in path(t[first:upto], [(e - first, s) for e, s in nodes]) if first + e < upto)
        cuts.append(upto)
        nodes.clear()
        first = start = upto

    for m in NODE.finditer(t):
        i = m.start()
        while k < len(own) and own[k][1] < i:
            k += 1
        if m.group() == "\n":
            if not ocr:
                close(m.end())
            elif k < len(own) and own[k][0] < i:
                continue
            elif cjk and CJK.search(t[i - 1 : i]):
                # the clause that may end here, and what may be the next one
                nxt = t.find("\n", i + 1)
                nodes.append((m.end(), model.gap(t[start:i], t[i + 1 : nxt if nxt > 0 else len(t)]) + LAYOUT_PRIOR))
            continue
        end = m.end()
        while t[end - 1] in '"“' and end - 1 not in pair_at:  # it opens what follows
            end -= 1
        if k < len(own) and own[k][0] < i and own[k][1] >= end:
            continue
        while start < len(t) and t[start] in SPACES:
            start += 1
        score = odds(t, m, start, end, ocr, pair_at, cjk, model)
        nodes.append((end, score))
        if score > 0:
            start = end
    close(len(t))
    if THAI.search(t):
        cuts += [c for c in thai_gaps(t, model) if not any(a < c <= b for a, b in own)]
    cuts = sorted(set(cuts) - {len(t)})
    out = []
    a = 0
    for c in [*cuts, len(t)]:
        x, y = a, c
        while x < y and t[x] in SPACES:
            x += 1
        while y > x and t[y - 1] in SPACES:
            y -= 1
        if y > x:
            out.append((x, y))
        a = c
    return out


def split(df: DataFrame, key: str = "elem_id", model: Model | None = None) -> DataFrame:
    """`key`, field (content or ocr_text), sentence_no from 1, start_pos, sentence. No shuffle. Without a model only the lists are known.

    Null, empty and blank texts give no row; repeated rows repeat their sentences; other columns are ignored.
    """
    kinds = dict(df.dtypes)
    own = df.sparkSession.sparkContext.broadcast(model or PLAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, field, no, pos, text = [], [], [], [], []
            for name, ocr, col in (("content", False, b.column(1)), ("ocr_text", True, b.column(2))):
                for i, t in enumerate(col.to_pylist()):
                    if t:
                        for n, (x, y) in enumerate(spans(t, ocr, own.value), 1):
                            at.append(i)
                            field.append(name)
                            no.append(n)
                            pos.append(x)
                            text.append(t[x:y])
            if at:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array(field), pa.array(no, pa.int32()), pa.array(pos, pa.int32()), pa.array(text, pa.string())], [key, "field", "sentence_no", "start_pos", "sentence"]
                )

    return df.select(F.col(key), "content", "ocr_text").mapInArrow(run, f"`{key}` {kinds[key]}, field string, sentence_no int, start_pos int, sentence string")


#: Run ids, of 8 bytes each, that are sent to every task.
SMALL = 1_000_000


def of_type(elements: DataFrame, results: DataFrame, file_type: str) -> DataFrame:
    """elem_id, content, ocr_text of the elements with text of results of a file type, in any letter case.

    run_id is unique in results; repeated ones count once. Run ids are sent to the tasks while they are no more than SMALL;
    beyond, texts and ids are shuffled.
    """
    runs = results.where(F.lower("file_type") == file_type).select("run_id").distinct()
    e = elements.where("content <> '' or ocr_text <> ''").select("elem_id", "run_id", "content", "ocr_text")
    if runs.limit(SMALL + 1).count() <= SMALL:
        runs = F.broadcast(runs)
    return e.join(runs, "run_id", "left_semi").select("elem_id", "content", "ocr_text")
