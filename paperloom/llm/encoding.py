"""Text that was decoded with the wrong character encoding: found, and restored by mappings learned from near-twins.

1. A vectorised look at the code points sets aside the values with any suspicious character. In each, clusters of such
   characters are tried with the known pairs of (encoding it was read in, encoding it was written in). By the plausibility of
   classes of characters a place is proposed, with its pair; a mark of a lost character is proposed as such. Nothing is
   decided here.
2. All these values are joined with clean near-twins: values that are equal once all non-ASCII characters are stripped. A
   fixed-size filter of keys keeps all but the wanted twins out of the shuffle. Each distinct value is compared with all
   twins of its key, in blocks of bounded size, under all pairs of encodings, and the one that has most of its bytes is its twin.
3. Each pair is aligned character by character: stretches between equal ASCII characters correspond, and within a stretch
   the byte widths of both sides say which garbled characters stand for which clean one; a mark stands for what its twin has
   there. Counts of these mappings give the learned table, whose size is bounded by the number of encodings and characters.
4. The table decides. From it come the transformations of this corpus - the pairs of encodings, and encodings combined that
   were each learned in some pair - and the marks that stand for lost characters. A proposed place is garbled if its
   transformation was learned or learned units cover it; with an empty table nothing is found. The same table restores,
   together with the pair of encodings, whatever still can be.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.engine import cut
from paperloom.llm import codepoints

#: Encodings a text can have been read in, and for each those that it may have been written in.
PAIRS = (
    ("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("cp866", "utf-8"), ("cp437", "utf-8"), ("koi8_r", "utf-8"),
    ("cp932", "utf-8"), ("gbk", "utf-8"), ("big5", "utf-8"),
    ("cp1252", "euc_jp"), ("cp932", "euc_jp"), ("gbk", "euc_jp"), ("mac_roman", "euc_jp"), ("cp1251", "euc_jp"),
    ("cp1252", "cp932"), ("mac_roman", "cp932"), ("gbk", "cp932"), ("cp1251", "cp932"),
    ("cp1252", "gbk"), ("cp1251", "gbk"), ("mac_roman", "gbk"), ("cp932", "gbk"), ("koi8_r", "gbk"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "cp866"), ("cp866", "cp1251"),
)
#: Encodings that single accented letters can have been read in and written in.
SINGLE = (("cp437", "cp1252"), ("cp1251", "cp1252"))
#: Accented letters that are common in European languages.
ACCENTED = "àâäçéèêëîïôöùûüßñãõáíóúÀÂÄÇÈÉÊÎÔÖÜÃÕÁÍÓÚ"
#: How much more plausible (as log-probability) a re-decoded cluster must be.
MARGIN = 5.0
#: The same from which a cluster is a candidate.
WEAK = 1.5
LOST = 0xFFFD
#: Encodings with bytes that have no character, which are read as control characters.
CONTROLS = {"cp1252", "cp1250", "cp1251", "cp932"}


@lru_cache(maxsize=1)
def prior() -> np.ndarray:
    """Log-plausibility of each code point, by classes of characters."""
    p = np.full(0x110000, -12.0, np.float32)
    p[:0x80] = -3.0
    p[0x80:0xA0] = -14.0
    p[0xA0:0xC0] = -8.0
    p[0xC0:0x100] = -7.0
    for cp in map(ord, "àâäçèéêëîïôöùûüßñãõáíóúÀÂÄÇÈÉÊÎÔÖÜÃÕÁÍÓÚ"):
        p[cp] = -4.5
    p[0x100:0x250] = -9.0
    for cp in map(ord, "Œœ"):
        p[cp] = -6.0
    for cp in map(ord, "“”‘’–—…«»•°·×§€№‐"):
        p[cp] = -5.5
    for cp in map(ord, "©®™±½"):
        p[cp] = -6.5
    for cp in map(ord, "ƒˆ˜‰Š‹›ŽšžŸ†‡‚„¨¸´"):
        p[cp] = -9.0
    p[0x370:0x400] = -8.0
    p[0x400:0x460] = -10.0
    p[0x410:0x430] = -5.0
    p[0x430:0x450] = -3.5
    for i, cp in enumerate(map(ord, "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъ")):  # by how common they are
        p[cp] = -2.2 - 0.09 * i
    p[0x401], p[0x451] = -6.0, -5.0
    p[0x900:0x980] = -4.0
    p[0xE00:0xE80] = -4.0
    p[0x2190:0x2600] = -9.0
    p[0x3000:0x3020] = -4.5
    p[0x3041:0x3097] = -3.0
    p[0x30A1:0x30FF] = -4.0
    p[0xFF01:0xFF61] = -5.0
    p[0xFF61:0xFF66] = -8.0
    p[0xFF66:0xFFA0] = -6.0
    # first levels of the two national sets of ideographs: the common ones
    for enc, last in (("euc_jp", 0xCF), ("gb2312", 0xD7)):
        for hi in range(0xB0, last + 1):
            for lo in range(0xA1, 0xFF):
                try:
                    p[ord(bytes((hi, lo)).decode(enc))] = -7.0
                except UnicodeDecodeError:
                    continue
    p[0x2E80:0x2FE0] = -7.0
    p[0xF900:0xFB07] = -7.0
    p[0xE000:0xF900] = -14.0
    p[LOST] = -14.0
    for cp in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xA0, 0x2009, 0x202F, 0x2007):
        p[cp] = -7.0
    return p


@lru_cache(maxsize=1)
def suspect() -> np.ndarray:
    """Code points that make a value worth a closer look."""
    s = prior() <= -6.0
    s[:0x80] = False
    s[[0xC2, 0xC3, 0xD0, 0xD1, 0x20AC]] = True
    # ordinary ideographs, spaces and full-width forms alone are no reason
    p = prior()
    s[(p == -7.0)] = False
    s[0xC0:0x100] |= p[0xC0:0x100] == -7.0
    s[0xFF66:0xFFA0] = True
    return s


#: Within a word of Cyrillic letters, a capital after a small letter.
CAMEL = regex.compile("[а-я](?=[А-Я])")


def plausible(s: str) -> float:
    cps = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return float(prior()[cps].sum()) - 6.0 * len(CAMEL.findall(s))


def _lost(e: UnicodeError) -> tuple[bytes, int]:
    return b"\xff" * (e.end - e.start), e.end


def _kept(e: UnicodeError) -> tuple[bytes, int]:
    return bytes(ord(c) if "\x80" <= c <= "\x9f" else 0xFF for c in e.object[e.start : e.end]), e.end


codecs.register_error("paperloom.lost", _lost)
codecs.register_error("paperloom.kept", _kept)


def encoded(s: str, read: str) -> bytes:
    """The bytes that were read: those without a character as control characters, lost ones as a byte that fits nowhere."""
    return s.encode(read, "paperloom.kept" if read in CONTROLS else "paperloom.lost")


def _byte(c: str, read: str, keep: bool) -> bytes:
    try:
        return c.encode(read)
    except UnicodeEncodeError:
        return bytes([ord(c)]) if keep and "\x80" <= c <= "\x9f" else b"\xff"


#: A stretch of non-ASCII characters, in which a byte of a two-byte character can also look like an ASCII character.
#: A stretch of non-ASCII characters; MIXED, in which a byte of a two-byte character can also look like an ASCII character.
STRETCH = regex.compile(r"[^\x00-\x7F]+")
UNDECODABLE = regex.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]")
#: Kana, or what the bytes of kana look like in other encodings.
JAPANESE = regex.compile("[\u3041-\u30ff]|[\u00a4\u00a5][\u00a1-\u00ff]|[\uff64\uff65]|[\u201a\u0192].")
#: Characters that single-byte encodings have.
WESTERN = regex.compile("[\u0080-\u08ff\u1e00-\u2e7f]+")
MIXED = regex.compile(r"(?:[^\x00-\x7F][\x40-\x7E]?)+")


#: Single-byte encodings of the Cyrillic alphabet.
CYRILLIC = {"cp1251", "cp866", "koi8_r"}
#: How much a language seen elsewhere in the value speaks for its encodings.
HINT = 1.0


def ranked(s: str, pairs: tuple[tuple[str, str], ...] = PAIRS, hint: str = "") -> list[tuple[float, str, str, str]]:
    """(gain, read in, written in, text) of the pairs with a gain, best first."""
    base = plausible(s)
    out = []
    raw: dict[str, bytes] = {}
    for read, written in pairs:
        if read not in raw:
            raw[read] = encoded(s, read)
        b = raw[read]
        if b.count(b"\xff") * (2 if written == "utf-8" else 3) > len(b):
            continue
        u = b.decode(written, "replace")
        if u == s or u.count("\ufffd") * 2 > len(u):
            continue
        if written in CYRILLIC and sum("\u0410" <= c <= "\u044f" for c in u) < max(4, 0.6 * len(u)):
            continue
        if written not in CYRILLIC and written != "utf-8" and sum(c > "\u3000" for c in u) < (3 if read in CYRILLIC else 2):
            continue
        gain = plausible(u) - base
        if gain > 0:
            out.append((gain + HINT * ((hint == "ja") == (written in ("euc_jp", "cp932"))), read, written, u))
    return sorted(out, reverse=True)


def best(s: str, pair: tuple[str, str]) -> tuple[float, str]:
    """(gain, text) of one pair, which may be a loss."""
    u = encoded(s, pair[0]).decode(pair[1], "replace")
    return plausible(u) - plausible(s), u


def clusters(t: str) -> Iterator[tuple[int, int]]:
    """Places to re-decode: stretches around suspicious characters, not joined over more than three others."""
    sus, last = suspect(), 0
    for m in MIXED.finditer(t):
        g = m.group()
        cps = np.frombuffer(g.encode("utf-32-le"), np.uint32)
        up = (cps[1:] >= 0x410) & (cps[1:] < 0x430) & (cps[:-1] >= 0x430) & (cps[:-1] < 0x450)
        if up.any():
            for r in WESTERN.finditer(g):
                if r.end() - r.start() > 3 and regex.search("[а-я][А-Я]", r.group()):
                    yield m.start() + r.start(), m.start() + r.end()
                    last = m.start() + r.end()
        at = np.flatnonzero(sus[cps])
        if not len(at):
            continue
        starts = np.flatnonzero(np.concatenate(([True], np.diff(at) > 4)))
        ends = np.concatenate((starts[1:], [len(at)])) - 1
        for a, b in zip(at[starts].tolist(), (at[ends] + 1).tolist()):
            if WESTERN.fullmatch(g[a:b]):  # the letters around may belong to it
                if 4 <= len(g) <= 16 and max(g) < "\u2e80":
                    a, b = 0, len(g)  # two-byte characters with ASCII second bytes
                while a and WESTERN.match(g[a - 1]):
                    a -= 1
                while b < len(g) and WESTERN.match(g[b]):
                    b += 1
                if b - a == 1 or m.start() + a < last:
                    continue
            last = m.start() + b
            if all(c == "\ufffd" for c in g[a:b]):
                continue
            yield m.start() + a, m.start() + b


def grow(t: str, a: int, b: int, top: tuple[float, str, str, str]) -> tuple[int, int, tuple[float, str, str, str]]:
    """Extends a cluster to both sides while that makes its re-decoding better, judged by a window at the edge."""
    pair = (top[1], top[2])
    for side in (-1, 1):
        while True:
            step = 0
            inner = (a, min(b, a + 8)) if side < 0 else (max(a, b - 8), b)
            have = best(t[inner[0] : inner[1]], pair)[0]
            for k in (1, 2, 3):
                x, y = (inner[0] - k, inner[1]) if side < 0 else (inner[0], inner[1] + k)
                if x < 0 or y > len(t):
                    break
                if best(t[x:y], pair)[0] > have + 0.5:
                    step = k
                    break
            if not step:
                break
            a, b = (a - step, b) if side < 0 else (a, b + step)
    gain, u = best(t[a:b], pair)
    return a, b, (gain, *pair, u)


# Letters of other alphabets that look like Latin ones, which are no trace of an encoding.
ALIKE = set("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονаеорсухі")


@lru_cache(maxsize=1)
def letter_maps() -> list[tuple[str, str, dict[int, int], regex.Pattern]]:
    """For text of single accented letters read in a single-byte encoding of another alphabet: its characters and what they stand for."""
    out = []
    for read, written in SINGLE:
        own: dict[int, int] = {}
        for b in range(0x80, 0x100):
            try:
                g, w = bytes([b]).decode(read), bytes([b]).decode(written)
            except UnicodeDecodeError:
                continue
            if w in ACCENTED and g not in ACCENTED and g not in ALIKE and not "\u00c0" <= g <= "\u024f":
                own[ord(g)] = ord(w)
        chars = regex.escape("".join(map(chr, own)))
        first = regex.escape("".join(c for c in map(chr, own) if c.isalpha() or "\u2500" <= c <= "\u259f"))
        out.append((read, written, own, regex.compile(rf"(?<=[A-Za-zà-ÿ'’])[{chars}](?=[a-zà-ÿ])|(?<![^\W_])[{first}](?=[a-zà-ÿ]{{2}})")))
    return out


def letters(t: str) -> tuple[str, list[tuple[int, int, str, str]]]:
    """(text with single garbled letters restored, their places): letters of another alphabet or signs inside Latin words."""
    for read, written, own, pattern in letter_maps():
        if pattern.search(t):
            c = regex.escape("".join(map(chr, own)))
            at = [m.start() for m in regex.finditer(rf"(?<=[A-Za-zà-ÿ'’])[{c}](?![^\W\d_a-zA-Zà-ÿ])|(?<![^\W_])[{c}](?=[a-zà-ÿ ])", t)]
            u = list(t)
            for i in at:
                u[i] = chr(own[ord(t[i])])
            return "".join(u), [(i, i + 1, read, written) for i in at]
    return t, []


CLEAN, GARBLED, OPEN = 0, 1, 2
#: Pairs whose gain is so much less than the best one's aren't looked at closer.
CLOSE = 15.0


def judge(t: str, pairs: tuple[tuple[str, str], ...] = PAIRS) -> tuple[int, str, list[tuple[int, int, str, str]]]:
    """(state, text with what fits re-decoded, places with their pair of encodings)."""
    state, u, places, _weak = weighed(t, pairs)
    return state, u, places


@lru_cache(maxsize=256)  # texts of a batch, which are judged again
def weighed(t: str, pairs: tuple[tuple[str, str], ...] = PAIRS) -> tuple[int, str, list[tuple[int, int, str, str]], list[tuple[int, int, str, str]]]:
    """judge(), and the weak places that it leaves to the learned table, whatever the state."""
    state = GARBLED if UNDECODABLE.search(t) else CLEAN
    hint = "ja" if JAPANESE.search(t) else ""
    out, places, weak, last = [], [], [], 0
    for a, b in clusters(t):
        if a < last:
            a = last
            if b - a < 2:
                continue
        own = ranked(t[a:b], pairs, hint)
        if not own:
            continue
        a2, b2, top = max((grow(t, a, b, x) for x in own if x[0] > own[0][0] - CLOSE), key=lambda x: x[2][0] + HINT * ((hint == "ja") == (x[2][2] in ("euc_jp", "cp932"))))
        if a2 < last:
            a2 = last
            top = (*(x := best(t[a2:b2], top[1:3]))[:1], top[1], top[2], x[1])
        if top[0] < MARGIN:
            if top[0] > WEAK:  # the learned table decides
                weak.append((a2, b2, top[1], top[2]))
                if state == CLEAN:
                    state = OPEN
                    out += [t[last:a2], t[a2:b2]]
                    places.append((a2, b2, top[1], top[2]))
                    last = b2
            continue
        if all("\uff66" <= c <= "\uff9f" for c in t[a2:b2]):  # a word in half-width katakana, or two-byte characters read so
            if state == CLEAN:
                state = OPEN
        else:
            state = GARBLED
        out += [t[last:a2], top[3]]
        places.append((a2, b2, top[1], top[2]))
        last = b2
    out.append(t[last:])
    return state, "".join(out), places, weak


def restore(t: str, pairs: tuple[tuple[str, str], ...] = PAIRS, single: tuple[tuple[str, str], ...] | None = None) -> tuple[int, str, list[tuple[int, int, str, str]]]:
    """judge(), again on its own result for text that was garbled more than once; single: the pairs of letters()."""
    state, u, places = judge(t, pairs)
    if state != GARBLED:
        v, own = letters(t)
        if own and (single is None or own[0][2:] in single):
            return GARBLED, v, own
    if state == GARBLED and u != t:
        u = deeper(u, pairs)
    return state, u, places


def deeper(u: str, pairs: tuple[tuple[str, str], ...] = PAIRS) -> str:
    """A restored text restored again while that makes it more plausible."""
    while True:
        again, v, _p = judge(u, pairs)
        if again != GARBLED or v == u or plausible(v) <= plausible(u):
            return u
        u = v


def suspicious(col: pa.Array) -> np.ndarray:
    """Rows of a column worth judging, by one gather over all code points."""
    cps, bounds = codepoints.split(col)
    flag = suspect()[cps]
    up = (cps >= 0x410) & (cps < 0x430)
    low = (cps >= 0x430) & (cps < 0x450)
    if low.any():
        flag[1:] |= up[1:] & low[:-1]
        latin = (cps < 0x80) & ((cps | 0x20) >= 0x61) & ((cps | 0x20) <= 0x7A)
        flag[1:] |= low[1:] & latin[:-1]
    return np.flatnonzero(codepoints.any_in(flag, bounds))


def values(elements: DataFrame, results: DataFrame) -> DataFrame:
    """rec_id, field, text of all element contents and result titles that aren't null or empty."""
    e = elements.select(F.col("elem_id").alias("rec_id"), F.lit("content").alias("field"), F.col("content").alias("text"))
    r = results.select(F.col("run_id").alias("rec_id"), F.lit("title").alias("field"), F.col("metadata.title").alias("text"))
    return e.unionByName(r).where("text <> ''")


PLACES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("r", pa.string()), ("w", pa.string())]))
PLACES_SQL = "array<struct<a:int,b:int,r:string,w:string>>"


def judged(vals: DataFrame) -> DataFrame:
    """rec_id, field, text, state, restored, places, weak of all suspicious values, those that show nothing by themselves too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = suspicious(b.column(2))
            got = [(i, *restore(t, PAIRS), weighed(t, PAIRS)[3]) for i, t in zip(rows.tolist(), b.column(2).take(pa.array(rows)).to_pylist())]
            if got:
                at, state, restored, *both = zip(*got)
                at = pa.array(at, pa.int64())
                cols = (pa.array(state, pa.int32()), pa.array(restored, pa.string()), *(pa.array([[dict(zip("abrw", p)) for p in x] for x in places], PLACES) for places in both))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), *cols], ["rec_id", "field", "text", "state", "restored", "places", "weak"])

    return vals.select("rec_id", "field", "text").mapInArrow(run, f"rec_id bigint, field string, text string, state int, restored string, places {PLACES_SQL}, weak {PLACES_SQL}")


#: Slots of the filter of keys: its size is fixed whatever the data.
SLOTS = 1 << 18
ASCII_ONLY = regex.compile(r"[^\x21-\x7E]+")


@lru_cache(maxsize=None)  # the encodings
def fits(read: str) -> frozenset[str]:
    """The non-ASCII characters that an encoding has."""
    own = {bytes([x]).decode(read, "ignore") for x in range(0x80, 0x100)}
    if read in ("cp932", "gbk", "big5"):
        own |= {bytes((x, y)).decode(read, "ignore") for x in range(0x81, 0xFF) for y in range(0x40, 0xFF)}
    if read in CONTROLS:
        own |= set(map(chr, range(0x80, 0xA0)))
    return frozenset(c for c in own if len(c) == 1 and c > "\x7f")


#: Printable ASCII characters of a value that tell its twins apart; with fewer, characters at its beginning or end are part of the key, too.
TELLING, ANCHOR = 8, 4
#: Bytes in the places of a value that the first pass didn't propose so, from which a twin counts, and printable ASCII characters from which a value with marks teaches what they are.
LEAST, LEAST_MARKED = 4, TELLING


HALF_WIDTH = regex.compile("[\uff61-\uff9f]")


@lru_cache(maxsize=2)
def by_read(utf8: bool) -> list[tuple[str, list[str]]]:
    out: dict[str, list[str]] = {}
    for read, written in PAIRS:
        if (written == "utf-8") == utf8:
            out.setdefault(read, []).append(written)
    return list(out.items())


def twin_keys(t: str, places: list[tuple[int, int, str, str]], raw: list[bytes]) -> list[tuple[str, str, int, str]]:
    """What a clean twin of a garbled value has: its printable ASCII characters, and the bytes of all others in the class of encodings (u, d) it was written in.

    The bytes of the places count, whatever they decode to, as some may be lost; a character of a single byte counts twice.
    Where the ASCII characters are too few to tell values apart, a key for the beginning and one for the end, as far as they are whole.
    """
    cls = "u" if all(p[3] == "utf-8" for p in places) else "d"  # where both are mixed, characters are counted
    parts, n, last = [], 0, 0
    for (a, b, _r, w), x in zip(places, raw):
        u = x.decode(w, "replace")
        parts += [t[last:a], u]
        last = b
        if (w == "utf-8") != (cls == "u"):
            n += 2 * (len(u) - len(u.encode("ascii", "ignore")))
        else:
            k = len(x) - len(u.encode("ascii", "ignore"))
            n += 2 * k if w in CYRILLIC or w == "cp1252" else k + len(HALF_WIDTH.findall(u)) if w == "cp932" else k
    parts.append(t[last:])
    whole = "".join(parts)
    rest, n = ASCII_ONLY.sub("", whole), n + sum(len(x.encode()) if cls == "u" else 2 * len(x) for p in parts[::2] for x in STRETCH.findall(p))
    anchors = [""] if len(rest) >= TELLING else [k + x for k, x in (("^", whole[:ANCHOR]), ("$", whole[-ANCHOR:])) if "\ufffd" not in x]
    return [(rest, cls, n, a) for a in anchors]


def likelier(t: str, own: list[tuple[int, int, bytes]], written: str) -> bool:
    """Whether places are more plausible re-decoded, lost characters left out on both sides of the scale."""
    u, v = "".join(x.decode(written, "replace") for _a, _b, x in own), "".join(t[a:b] for a, b, _x in own)
    return plausible(u.replace("\ufffd", "")) > plausible(v.replace("\ufffd", ""))


def readings(t: str, places: list[tuple[int, int, str, str]]) -> Iterator[tuple[list[tuple[int, int, str, str]], bool, str, str, int, str]]:
    """(places, whether they are the first pass's, a key of the twin): those of the first pass and, for each pair of encodings, those that can have been read so, as far as half of them can be re-decoded.

    Pairs whose text is no more plausible than what is there are left out: a twin that has that text wouldn't count (see twins()).
    """
    if places:
        yield from ((places, True, *k) for k in twin_keys(t, places, [encoded(t[a:b], r) for a, b, r, _w in places]))
    for pattern, pairs in ((STRETCH, by_read(True)), (MIXED, by_read(False))):
        spans = [(*m.span(), frozenset(m.group())) for m in pattern.finditer(t)]
        for read, writtens in pairs:
            fit, raw = fits(read), []
            for a, b, cs in spans:
                if not cs.isdisjoint(fit):
                    while t[a] not in fit:
                        a += 1
                    while t[b - 1] > "\x7f" and t[b - 1] not in fit:
                        b -= 1
                    raw.append((a, b, encoded(t[a:b], read)))
            for written in writtens:
                own = [(a, b, x) for a, b, x in raw for u in (x.decode(written, "replace"),) if u.count("\ufffd") * 2 <= len(u) and u != t[a:b]]
                got = [(a, b, read, written) for a, b, _x in own]
                if sum(len(x) for _a, _b, x in own) >= LEAST and got != places and likelier(t, own, written):
                    yield from ((got, False, *k) for k in twin_keys(t, got, [x for _a, _b, x in own]))
    if MARKED.search(t) and len(rest := ASCII_ONLY.sub("", t)) >= LEAST_MARKED:
        yield [], False, rest, "m", 0, ""


MARKED = regex.compile("\ufffd+")


def marks(t: str) -> regex.Pattern:
    """What a twin of a value with marks of lost characters looks like: the same but for at least one other character for each run of marks."""
    parts, last = [], 0
    for m in MARKED.finditer(t):
        parts += [regex.escape(t[last : m.start()]), f"([^\ufffd]{{1,{m.end() - m.start()}}})"]
        last = m.end()
    return regex.compile("".join([*parts, regex.escape(t[last:])]), regex.S)


#: Agreement of a twin that has all bytes.
EXACT = 1.0 + 1e-3
#: Values of a key that are compared at a time: hot keys are cut into blocks of about this many.
BLOCK = 256


def blocks(df: DataFrame, cols: list[str]) -> DataFrame:
    """k, xs: the rows of each key in blocks of about BLOCK, by hash."""
    n = df.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    salted = df.join(n, "k").withColumn("salt", F.pmod(F.xxhash64("text", F.lit(7)), F.col("parts")))
    return salted.groupBy("k", "salt").agg(F.collect_list(F.struct(*cols)).alias("xs")).select("k", "xs")


def laid(t: str, places: list[tuple[int, int, str, str]], written: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The bytes that a clean twin of a garbled value has in `written`, and which of them lie in its places; None where it can't be written so."""
    out, inside, last = [], [], 0
    try:
        for a, b, r, w in [*places, (len(t), len(t), "", "")]:
            own = encoded(t[a:b], r) if r else b""
            if r and w != written:
                own = own.decode(w, "replace").encode(written, "replace")
            out += [t[last:a].encode(written), own]
            inside += [np.zeros(len(out[-2]), bool), np.ones(len(own), bool)]
            last = b
    except UnicodeEncodeError:
        return None
    return np.frombuffer(b"".join(out), np.uint8), np.concatenate(inside)


def stretches(t: str, places: list[tuple[int, int, str, str]], twin: str) -> Iterator[tuple[str, str, str]]:
    """(garbled characters, what the twin has there, read in) of each place."""
    written, at, last = places[0][3], 0, 0
    raw = twin.encode(written)
    for p in places:
        at += len(t[last : p[0]].encode(written))
        n = len(laid(t[p[0] : p[1]], [(0, p[1] - p[0], *p[2:])], written)[0])
        yield t[p[0] : p[1]], raw[at : at + n].decode(written, "replace"), p[2]
        at, last = at + n, p[1]


def nearest(bad: list[tuple[str, list[tuple[int, int, str, str]]]], clean: list[str]) -> Iterator[tuple[int, float, str]]:
    """(index, agreement, twin) of the clean value that has most of the bytes of each garbled one in its places, at least half."""
    sides: dict[str, dict[int, tuple[list[str], np.ndarray]]] = {}
    for i, (t, places) in enumerate(bad):
        written = places[0][3]
        if written not in sides:
            by: dict[int, list[tuple[str, bytes]]] = {}
            for c in clean:
                try:
                    e = c.encode(written)
                except UnicodeEncodeError:
                    continue
                by.setdefault(len(e), []).append((c, e))
            sides[written] = {n: ([c for c, _e in x], np.frombuffer(b"".join(e for _c, e in x), np.uint8).reshape(len(x), n)) for n, x in by.items()}
        own = laid(t, places, written)
        if own is None or len(own[0]) not in sides[written] or not own[1].any():
            continue
        names, m = sides[written][len(own[0])]
        same = (m[:, own[1]] == own[0][own[1]]).mean(1)
        # equal ones: what agrees outside the places, then the order of text
        top = np.flatnonzero(same == same.max())
        if same[top[0]] >= 0.5:
            yield i, *max((float(same[j]) + 1e-3 * float((m[j] == own[0]).mean()), names[j]) for j in top.tolist())


def twins(vals: DataFrame, bad: DataFrame) -> DataFrame:
    """text, same, twin, parts, n: each distinct suspicious value with its nearest clean near-twin and what stands where; n rows have it.

    Near-twins are equal when stripped of non-ASCII characters, and what was stripped has as many bytes. A fixed-size
    filter keeps all other values out of the shuffle. All twins of a key are compared, in blocks, whatever number of values
    shares the key, and the one that agrees with most bytes of the garbled places is the nearest; same is EXACT where all
    agree. A value is tried with the places of the first pass and with all pairs of encodings. Marks of lost characters
    have no bytes left: a value with LEAST_MARKED ASCII characters or more has as its twin one that is equal but for them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(t, [dict(zip("abrw", p)) for p in x], first, n, *key) for t, places, n in zip(*(c.to_pylist() for c in b.columns)) for x, first, *key in readings(t, [tuple(p.values()) for p in places])]
            if got:
                kinds = (pa.string(), PLACES, pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got), kinds)], ["text", "places", "first", "n", "rest", "cls", "len", "anchor"])

    own = bad.groupBy("text").agg(F.first("places").alias("places"), F.count("*").alias("n")).mapInArrow(read, f"text string, places {PLACES_SQL}, first boolean, n long, rest string, cls string, len int, anchor string")
    own = cut(own.select("text", "places", "first", "n", F.xxhash64("rest", "cls", "len", "anchor").alias("k")))
    slots = own.select(F.pmod("k", F.lit(SLOTS)).alias("slot")).distinct()
    # keys of all other values without their texts, which follow once it is known whose are wanted
    near = vals.select("rec_id", "field", "text", F.regexp_replace("text", r"[^\x21-\x7E]+", "").alias("rest"), F.regexp_replace("text", r"[\x00-\x7F]+", "").alias("other")).where("other <> ''")
    telling = F.length("rest") >= TELLING
    kind = lambda c, n: F.struct(F.lit(c).alias("cls"), n.alias("n"))
    two = F.array(kind("u", F.octet_length("other")), kind("d", 2 * F.char_length("other")))
    ends = F.array(F.concat(F.lit("^"), F.left("text", F.lit(ANCHOR))), F.concat(F.lit("$"), F.right("text", F.lit(ANCHOR))))
    near = near.select("rec_id", "field", "rest", F.explode(F.when(telling, F.array_append(two, kind("m", F.lit(0)))).otherwise(two)).alias("x"), F.when(telling, F.array(F.lit(""))).otherwise(ends).alias("anchors"))
    near = near.select("rec_id", "field", "rest", "x", F.explode("anchors").alias("anchor")).select("rec_id", "field", F.xxhash64("rest", "x.cls", "x.n", "anchor").alias("k"))
    near = near.withColumn("slot", F.pmod("k", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi").drop("slot").join(own.select("k").distinct(), "k", "left_semi")
    near = cut(near.join(bad.where(F.col("state") != CLEAN).select("rec_id", "field"), ["rec_id", "field"], "left_anti"))
    slot = F.pmod(F.xxhash64("rec_id", "field"), F.lit(SLOTS)).alias("slot")
    texts = vals.select("rec_id", "field", "text", slot).join(F.broadcast(near.select(slot).distinct()), "slot", "left_semi")
    clean = cut(texts.join(near, ["rec_id", "field"]).select("k", "text").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for xs, ys in zip(b.column(0), b.column(1)):
                xs = [(x["text"], [tuple(p.values()) for p in x["places"]], x["n"], x["first"]) for x in xs.as_py()]
                clean = [y["text"] for y in ys.as_py()]
                for t, _p, n, _f in (x for x in xs if not x[1]):
                    p = marks(t)
                    if m := next((m for y in clean if (m := p.fullmatch(y))), None):
                        got.append((t, [{"g": g, "c": c, "r": ""} for g, c in zip(MARKED.findall(t), m.groups())], n, 0.25, m.string))
                xs = [x for x in xs if x[1]]
                for i, same, twin in nearest([x[:2] for x in xs], clean):
                    t, places, n, first = xs[i]
                    if not first and (same < 0.75 or plausible(twin) <= plausible(t)):
                        continue
                    got.append((t, [dict(zip("gcr", x)) for x in stretches(t, places, twin)], n, same, twin))
            if got:
                kinds = (pa.string(), pa.list_(pa.struct([(x, pa.string()) for x in "gcr"])), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got), kinds)], ["text", "parts", "n", "same", "twin"])

    pairs = blocks(own, ["text", "places", "n", "first"]).join(blocks(clean, ["text"]).withColumnRenamed("xs", "ys"), "k").select("xs", "ys")
    pairs = pairs.mapInArrow(run, "text string, parts array<struct<g:string,c:string,r:string>>, n long, same double, twin string")
    top = pairs.groupBy("text").agg(F.max(F.struct("same", "twin", "parts", "n")).alias("x"))
    return top.select("text", "x.*")


@lru_cache(maxsize=100_000)
def width(c: str, enc: str) -> int:
    try:
        return len(c.encode(enc))
    except UnicodeEncodeError:
        return 1


def align(bad: str, twin: str, read: str) -> list[tuple[str, str, str, str]]:
    """(read in, written in, garbled characters, clean characters) of each aligned place of a value that was read in `read` and its twin.

    Equal beginnings and ends are no part of the change. Between them, the bytes of both sides are compared under each
    encoding that the value may have been written in; the one that explains most of them counts, if that is at least half,
    and the byte widths of the characters on both sides say which correspond.
    """
    i = 0
    while i < min(len(bad), len(twin)) and bad[i] == twin[i]:
        i += 1
    j = 0
    while j < min(len(bad), len(twin)) - i and bad[-1 - j] == twin[-1 - j]:
        j += 1
    g, c = bad[i : len(bad) - j], twin[i : len(twin) - j]
    if not g or not c:
        return []
    raw = np.frombuffer(encoded(g, read), np.uint8)
    most, best_written = 0.5, ""
    for r, written in (*PAIRS, *SINGLE):
        if r == read:
            try:
                meant = np.frombuffer(c.encode(written), np.uint8)
            except UnicodeEncodeError:
                continue
            if len(meant) == len(raw) and (same := float((meant == raw).mean())) >= most:
                most, best_written = same, written
    if not best_written:
        return []
    eg, ec = (np.cumsum([width(x, e) for x in s]) for s, e in ((g, read), (c, best_written)))
    out, x, y = [], 0, 0
    for e in np.intersect1d(eg, ec).tolist():
        x2, y2 = int(np.searchsorted(eg, e)) + 1, int(np.searchsorted(ec, e)) + 1
        if g[x:x2] != c[y:y2]:
            out.append((read, best_written, g[x:x2], c[y:y2]))
        x, y = x2, y2
    return out


#: Clean characters of a unit: aligned widths of the encodings above meet again after fewer, so a longer one is no mapping.
UNIT = 4


def learn(pairs: DataFrame) -> list[tuple[str, str, str, str, int]]:
    """The learned table: for each pair of encodings and garbled characters the clean ones seen most, with the count of the unit.

    Marks of lost characters are units of the pair ("", ""). Its rows are at most the distinct units of the encodings'
    character sets, whatever the data's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(*u, n) for t, w, r, n in zip(*(c.to_pylist() for c in b.columns)) for u in (align(t, w, r) if r else [("", "", t[0], "?")]) if len(u[3]) <= UNIT]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got)], ["read", "written", "unit", "clean", "n"])

    units = pairs.select(F.explode("parts").alias("x"), "n").select("x.g", "x.c", "x.r", "n").mapInArrow(run, "read string, written string, unit string, clean string, n long")
    n = units.groupBy("read", "written", "unit", "clean").agg(F.sum("n").alias("n"))
    top = n.groupBy("read", "written", "unit").agg(F.max(F.struct("n", "clean")).alias("x"), F.sum("n").alias("n"))
    return [(r["read"], r["written"], r["unit"], r["x"]["clean"], r["n"]) for r in top.where(F.length("unit") >= 1).collect()]


#: Aligned units from which a pair of encodings, or a mark, is learned.
SEEN = 2


def transformations(learned: list[tuple[str, str, str, str, int]]) -> set[tuple[str, str]]:
    """The pairs of encodings that the table knows: aligned SEEN times, or of an encoding read in and one written in that both are in such pairs; ("", "") if marks are."""
    n: dict[tuple[str, str], int] = {}
    for r, w, _u, _c, k in learned:
        n[r, w] = n.get((r, w), 0) + k
    known = {p for p, k in n.items() if k >= SEEN}
    reads, writes = {r for r, _w in known}, {w for _r, w in known}
    return known | {(r, w) for r, w in (*PAIRS, *SINGLE) if r in reads and w in writes}


#: A word in half-width katakana: small letters, long marks and voicing marks stand only where they can, and there are some.
WORD = regex.compile("(?=.*[\uff67-\uff70\uff9e\uff9f])(?:[\uff66\uff71-\uff9d][\uff9e\uff9f]?[\uff67-\uff6f]?\uff70?)+")


def learned_place(s: str, units: set[str]) -> bool:
    """Whether learned units of its pair of encodings cover a place, or all but one in four characters of a longer one."""
    i = covered = 0
    while i < len(s):
        n = next((n for n in (4, 3, 2, 1) if s[i : i + n] in units), 0)
        covered += n
        i += n or 1
    return bool(units) and covered >= (len(s) if len(s) < 5 else 0.75 * len(s))


def apply(bad: DataFrame, learned: list[tuple[str, str, str, str, int]]) -> DataFrame:
    """rec_id, field, text, restored, found: the final decision and the restored text, in which what is lost stays marked."""
    by: dict[str, dict[str, set[str]]] = {}
    for r, w, u, _c, _n in learned:
        by.setdefault(r, {}).setdefault(w, set()).add(u)
    units = {u: c for _r, w, u, c, _n in learned if w and len(u) > 1 and all(ord(x) >= 0x80 for x in u)}
    longest = max(map(len, units), default=0)
    known = transformations(learned)
    pairs, single, mark = tuple(p for p in PAIRS if p in known), tuple(p for p in SINGLE if p in known), ("", "") in known

    def rest(t: str) -> str:
        """What re-decoding left, by the longest learned units; only around marks of lost characters."""
        out, i = [], 0
        while i < len(t):
            hit = 0
            if "�" in t[i : i + longest]:
                for n in range(min(longest, len(t) - i), 1, -1):
                    if (u := t[i : i + n]) in units and "�" in u:
                        out.append(units[u])
                        hit = n
                        break
            if not hit:
                out.append(t[i])
            i += hit or 1
        return "".join(out)

    def again(t: str, restored: str, places: list[tuple[int, int, str, str]], weak: list[tuple[int, int, str, str]]) -> str:
        """Re-decodes the weak places that learned units cover, and those that fit several encodings by the one whose units they consist of."""
        # weak places may be proposed with a pair that was not learned
        weak = [p for p in weak if not any(p[0] < b and a < p[1] for a, b, *_ in places)]
        out, last, other = [], 0, False
        for x, y, r, w in sorted({*places, *weak}):
            if x < last:
                continue
            sure = (x, y, r, w) not in weak
            hits = {v: sum(t[i : i + 2] in us for i in range(x, y - 1)) for v, us in by.get(r, {}).items() if v != "utf-8"}
            v = max(hits, key=hits.__getitem__, default=w)
            if w != "utf-8" and hits and hits[v] > hits.get(w, 0):
                # against what looks clearly better, only units that cover the place decide
                covers = [learned_place(t[x:y], by.get(r, {}).get(e, set())) for e in (v, w)]
                if covers == [True, False] or best(t[x:y], (r, v))[0] > best(t[x:y], (r, w))[0] - MARGIN:
                    w, other = v, True
            if not sure:
                if not learned_place(t[x:y], by.get(r, {}).get(w, set())):
                    continue
                other = True
            out += [t[last:x], best(t[x:y], (r, w))[1]]
            last = y
        return deeper("".join([*out, t[last:]]), pairs) if other else restored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _rec, _field, text, state, restored, *both = (c.to_pylist() for c in b.columns)
            found, done = [], []
            for t, s, r, places, weak in zip(text, state, restored, *([[tuple(p.values()) for p in x] for x in c] for c in both)):
                own = places
                if s == GARBLED and not (places and all(p[2:] in known for p in places)):
                    s, r, own = restore(t, pairs, single)  # only by what was learned
                    weak = [*weak, *weighed(t, pairs)[3]]
                    if s == GARBLED and not own:  # a mark alone
                        s = GARBLED if mark else OPEN
                if s == OPEN and any(not WORD.fullmatch(t[x:y]) and learned_place(t[x:y], by.get(e, {}).get(w, set())) for x, y, e, w in {*own, *places, *weak}):
                    s = GARBLED  # the place consists of learned units
                    weak = [*weak, *(p for p in places if p[2:] not in known)]
                    own = [p for p in own if p[2:] in known]
                found.append(s == GARBLED)
                if s == GARBLED:
                    r = again(t, r, own, weak)
                done.append(rest(r) if s == GARBLED else t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(done, pa.string()), pa.array(found)], ["rec_id", "field", "text", "restored", "found"])

    return bad.select("rec_id", "field", "text", "state", "restored", "places", "weak").mapInArrow(run, "rec_id bigint, field string, text string, restored string, found boolean")


def repaired(elements: DataFrame, results: DataFrame) -> DataFrame:
    """rec_id, field, text, restored of every garbled value.

    Null and empty values are none, correctly read text of any script neither. A value that can't be restored, wholly or in part,
    keeps U+FFFD or its garbled characters there. Repeated rows stay repeated.
    """
    vals = values(elements, results)
    bad = cut(judged(vals))
    pairs = cut(twins(vals, bad))
    exact = pairs.where(F.col("same") >= EXACT).select("text", "twin")
    a = apply(bad, learn(pairs)).join(exact, "text", "left")
    told = ~F.col("found") & F.col("twin").isNotNull()  # nothing but the twin shows it
    return a.where("found or twin is not null").select("rec_id", "field", "text", F.when(told, F.col("twin")).otherwise(F.col("restored")).alias("restored"))
