"""Near-duplicate texts by DartMinHash signatures, banded joining and an exact check.

Darts are thrown into the plane of weight and rank of each element: the plane is cut into cells by powers of two, a hash of
(element, cell) says how many darts a cell holds (a Poisson number) and where each lies - its weight, its rank and the
coordinate of the signature it is for. A set keeps the darts below its elements' weights, and for each coordinate the one
of the lowest rank; cells are opened in order of rank until every coordinate has one. Two sets agree in a coordinate with
the probability of their weighted Jaccard similarity, and the cost is about k log k darts per set, whatever its size.

Texts are classed by equality first. Representatives are joined on bands of coordinates; a pair met in any band is tested
on short sketches of the signatures, and what is left exactly, on the sets of substrings of both texts. Exact copies are
expanded only at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.engine import cut, keep
from paperloom.llm import codepoints

#: Characters of a substring, the least characters of a text and the similarity that counts.
GRAM, LEAST, SIMILAR = 10, 300, 0.6
#: Coordinates of a signature, coordinates of a band and times that the coordinates are dealt to bands anew.
K, ROWS, DEALS = 200, 5, 2
#: Coordinates in a sketch, a byte each, and the share that must agree: 3.7 standard deviations below SIMILAR.
SKETCH, AGREE = 96, 0.415
#: Slots of a filter of texts: its size is fixed whatever the data.
SLOTS = 1 << 18
#: Expected darts of a cell of weight 1 on the first level of rank.
UNIT = 1 / 32
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed(*parts: int) -> np.uint64:
    h = 0
    for p in parts:
        h = (h * 0x100000001B3 + p + 0x9E3779B97F4A7C15) % 2**64
    return mix(np.array([h], np.uint64))[0]


@lru_cache(maxsize=64)
def poisson(mean: float) -> np.ndarray:
    """Thresholds of a uniform 64-bit number for 1, 2, ... darts."""
    p, total, out = math.exp(-mean), 0.0, []
    for i in range(1, 64):
        total += p
        if total >= 1 - 1e-12:
            break
        out.append(min(2**64 - 1, int(total * 2**64)))
        p *= mean / i
    return np.array(out, np.uint64)


def grams(cps: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the substrings of n characters of a text, in order."""
    m = len(cps) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c = cps.astype(np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h *= MIX
        h += c[j : j + m]
    return mix(h)


def signatures(x: np.ndarray, of: np.ndarray, n_sets: int, k: int = K, weight: np.ndarray | None = None) -> np.ndarray:
    """n_sets x k array of the darts kept. x: hashes of elements, of: the set of each; an element may be repeated.

    A set without an element of positive weight has zeros.
    """
    out = np.zeros(n_sets * k, np.uint64)
    filled = np.zeros(n_sets * k, bool)
    missing = np.full(n_sets, k)
    has = np.zeros(n_sets, bool)
    if weight is not None:
        x, of, weight = x[weight > 0], of[weight > 0], weight[weight > 0]
    has[of] = True
    missing[~has] = 0
    nus = 1 if weight is None else int(math.log2(1 + weight.max(initial=0))) + 1
    rho = 0
    while True:
        open_sets = missing > 0
        if not open_sets.any():
            return out.reshape(n_sets, k)
        own = slice(None) if open_sets.all() else np.flatnonzero(open_sets[of])
        xs, sets = x[own], of[own]
        keys, ranks, vals = [], [], []
        for nu in range(nus):
            cells = max(1, math.ceil(2.0 ** (nu + rho) * UNIT / 4))  # each of an expectation of four darts at most
            t = poisson(2.0 ** (nu + rho) * UNIT / cells)
            near = None if weight is None or not nu else np.flatnonzero(weight[own] > 2.0**nu - 1)
            xn, sn = (xs, sets) if near is None else (xs[near], sets[near])
            wn = None if weight is None else weight[own] if near is None else weight[own][near]
            for cell in range(cells):
                z = mix(xn ^ seed(nu, rho, cell))
                at = np.flatnonzero(z >= t[0])
                for i in range(len(t)):
                    if i:
                        at = at[z[at] >= t[i]]
                    if not len(at):
                        break
                    y = mix(z[at] + seed(i, 77))
                    y2 = mix(y)
                    keep_at = at
                    if wn is not None:
                        y3 = mix(y2)
                        inside = (2.0**nu - 1) + 2.0**nu * ((y3 >> np.uint64(11)) * 2.0**-53) < wn[at]
                        keep_at, y, y2 = at[inside], y[inside], y2[inside]
                    key = sn[keep_at] * k + ((y >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
                    new = ~filled[key]
                    lo, width = 2.0**rho - 1, 2.0**rho / cells
                    keys.append(key[new])
                    ranks.append(lo + width * (cell + (y2[new] >> np.uint64(11)) * 2.0**-53))
                    vals.append(y[new])
        if keys:
            key, rank, val = np.concatenate(keys), np.concatenate(ranks), np.concatenate(vals)
            order = np.argsort(rank)[::-1]  # the lowest rank is written last
            out[key[order]] = val[order]
            filled[key] = True
            missing = np.where(has, k - filled.reshape(n_sets, k).sum(1), 0)
        rho += 1


@lru_cache(maxsize=4)
def deals(k: int = K, rows: int = ROWS, times: int = DEALS) -> np.ndarray:
    """Coordinates of each band: every deal is a permutation of all coordinates."""
    rng = np.random.default_rng(20)
    return np.concatenate([rng.permutation(k)[: k // rows * rows].reshape(-1, rows) for _ in range(times)])


def bands(sig: np.ndarray) -> np.ndarray:
    """Hash of each band of each signature, the band's number in it."""
    own = deals()
    out = np.zeros((len(sig), len(own)), np.uint64)
    for r in range(own.shape[1]):
        out = mix(out * MIX + sig[:, own[:, r]])
    return mix(out + np.arange(len(own), dtype=np.uint64) * MIX)


def last_texts(elements: DataFrame, results: DataFrame) -> DataFrame:
    """id, text: the non-null content of the text elements of an id's latest run, in elem_ord, joined by a line feed.

    Ties of elem_ord follow elem_id; a null id has no text.
    """
    runs = results.where("id is not null").groupBy("id").agg(F.max("run_id").alias("run_id"))
    e = elements.where("type = 'text' and content is not null").select("run_id", "elem_ord", "elem_id", "content")
    # one row for each run: the array holds a single text, whatever the number of runs
    t = e.join(runs.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("elem_ord", "elem_id", "content"))).alias("x"))
    t = t.select("run_id", F.array_join(F.col("x.content"), "\n").alias("text"))
    return t.join(runs, "run_id").select("id", "text")


def signed(texts: DataFrame) -> DataFrame:
    """h, id, sketch, bands of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                b = whole.slice(s, 64)
                cps, bounds = codepoints.split(b.column(2))
                gs = [grams(cps[i:j]) for i, j in zip(bounds, bounds[1:])]
                sig = signatures(np.concatenate(gs), np.repeat(np.arange(len(gs)), [len(g) for g in gs]), len(gs))
                bs = bands(sig).view(np.int64)
                sk = (sig[:, :SKETCH] & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(1),
                        pa.array([r.tobytes() for r in sk], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(bs) + 1, dtype=np.int32) * bs.shape[1]), pa.array(bs.ravel())),
                    ],
                    ["h", "id", "sketch", "bands"],
                )

    return texts.select("h", "id", "text").mapInArrow(run, "h bigint, id string, sketch binary, bands array<bigint>")


def likely(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs whose sketches agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, SKETCH) for c in b.columns[2:])
                yield b.select([0, 1]).filter(pa.array((x == y).sum(1) >= AGREE * SKETCH))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def similarity(s: str, t: str) -> float:
    """Distinct substrings in both texts divided by those in either."""
    x, y = (np.unique(grams(np.frombuffer(v.encode("utf-32-le"), np.uint32))) for v in (s, t))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def checked(pairs: DataFrame) -> DataFrame:
    """a, b, similarity of the pairs at or above SIMILAR, computed on the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = np.array([similarity(s, t) for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], np.float64)
            rows = pa.array(np.flatnonzero(sims >= SIMILAR))
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(sims).take(rows)], ["a", "b", "similarity"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, h, h2; links: a, b, similarity between the classes of equal texts with h = a and h = b, a < b) of (id, text).

    Texts of fewer than LEAST characters and null ones are no members. Equal texts are one class, told by two hashes of 64 bits
    each, of which the first names it. Classes come first, and one text of each is signed; texts without a copy stay where they are.
    A band that many classes share costs their pairs, but classes that agree in ROWS darts at once mostly are links.
    """
    t = keep(texts.where(F.length("text") >= LEAST).select("id", F.xxhash64("text").alias("h"), F.xxhash64("text", F.lit(7)).alias("h2"), "text"))
    slot = F.pmod("h", F.lit(SLOTS))
    first = cut(t.groupBy("h", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    copied = F.broadcast(first.where("n > 1").select(slot.alias("slot")).distinct())  # at most SLOTS rows
    placed = t.withColumn("slot", slot)
    one = placed.join(copied, "slot", "left_anti").unionByName(placed.join(copied, "slot", "left_semi").join(first.select("id", "h", "h2"), ["id", "h", "h2"], "left_semi"))
    reps = cut(signed(one))
    rows = reps.select("h", F.explode("bands").alias("band"))
    met = rows.alias("l").join(rows.alias("r"), "band").where("l.h < r.h").select(F.col("l.h").alias("a"), F.col("r.h").alias("b")).distinct()
    sk = reps.select("h", "sketch")
    with_a = met.join(sk.select(F.col("h").alias("a"), F.col("sketch").alias("sa")), "a")
    pairs = cut(likely(with_a.join(sk.select(F.col("h").alias("b"), F.col("sketch").alias("sb")), "b")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    near = t.withColumn("slot", slot).join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), "slot", "left_semi")  # most texts have no pair and stay where they are
    own = near.select("id", "h", "text").join(reps.select("h", "id").join(wanted, "h"), ["id", "h"]).select("h", "text")
    both = pairs.join(own.select(F.col("h").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("h").alias("b"), F.col("text").alias("tb")), "b")
    return t.select("id", "h", "h2"), cut(checked(both))


def found(elements: DataFrame, results: DataFrame) -> DataFrame:
    """id_a, id_b: all pairs of different ids, id_a < id_b by code points, that are similar enough.

    The result itself is all pairs, so copies are expanded here; groups() has the same links without that.
    """
    members, link = links(last_texts(elements, results))
    a, b = members.select(F.col("id").alias("x"), F.col("h").alias("a")), members.select(F.col("id").alias("y"), F.col("h").alias("b"))
    between = link.join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    many = members.groupBy("h", "h2").count().where("count > 1").select("h", "h2")
    copies = members.join(many, ["h", "h2"], "left_semi")
    within = copies.withColumnRenamed("id", "id_a").join(copies.withColumnRenamed("id", "id_b"), ["h", "h2"]).where("id_a < id_b").select("id_a", "id_b")
    return between.unionByName(within)


def groups(elements: DataFrame, results: DataFrame) -> DataFrame:
    """id, class_id, n_copies, n_links: the class of equal texts of each id, named by its first id, its size, and the number of other classes that it is similar to."""
    members, link = links(last_texts(elements, results))
    classes = members.groupBy("h", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    n = link.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("n_links"))
    return members.join(classes, ["h", "h2"]).join(n, "h", "left").select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
