"""Splitting oversized items at natural boundaries with bounded-quantifier regular expressions, inside the JVM.

One pattern consumes a core of at most `max_chars - overlap` characters. Its alternatives are ordered by the strength of
the boundary they end at: blank line, line end, end of a sentence, clause mark, white space, and any character as the
fallback. Each alternative is a greedy bounded quantifier, so it takes the longest core that ends at its boundary; a
minimum length keeps a strong boundary right at the start from making tiny pieces. Every piece is its core preceded by the
last `overlap` characters of what came before, so consecutive pieces share exactly `overlap` characters and no piece
exceeds the limit. `regexp_extract_all` gives the cores; offsets and overlaps come from SQL array functions on them, so no
text is scanned again from its start for each piece: offsets are sums over blocks of about the root of the number of cores.
Texts within the limit never meet the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak, as what must lie before and after a cut.
BOUNDARIES = (r"(?<=\n\n)", r"(?<=\n)", r"(?<=[。．！？।॥]|[.!?][ \t])(?![」』）])", r"(?<=[、，,;；:：])", r"(?<=[\t 　])")


def sizes(max_chars: int, overlap: int) -> tuple[int, int]:
    """The most and the least characters of a core."""
    if max_chars < 1 or not 0 <= overlap < max_chars:
        raise ValueError(f"overlap_chars {overlap} must lie between 0 and less than max_chars {max_chars}")
    core = max_chars - overlap
    return core, max(1, core // 2, overlap if overlap <= core else 0)


def pattern(core: int, least: int) -> str:
    """Alternatives in order of strength; (?s) lets a core run over line ends, a surrogate pair counts as one character."""
    return "(?s)" + "|".join([f".{{1,{core}}}\\z", *(f".{{{least},{core}}}(?:{b})" for b in BOUNDARIES), f".{{1,{core}}}"])


def table_text(rows: str = "rows") -> Column:
    """Cells joined by a tab and rows by a line feed, null cells and null rows as empty; null for null rows."""
    return F.array_join(F.transform(F.col(rows), lambda r: F.coalesce(F.array_join(r, "\t", ""), F.lit(""))), "\n")


def pieces(text: Column, max_chars: int, overlap: int) -> Column:
    """array<struct<piece_no int, start_pos int, piece string>>: one piece for a text within the limit, none for null or empty.

    start_pos is the place of the piece's first character, from 0. Each piece without what it shares with the one before,
    joined, gives the text back.
    """
    core, least = sizes(max_chars, overlap)
    back = -(-overlap // least)  # cores that an overlap can reach into: all but the last have `least` characters
    cores = F.regexp_extract_all(text, F.lit(pattern(core, least)), F.lit(0))

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)

    def one(cs: Column, sums: Column, size: Column, i: Column) -> Column:
        b = F.floor(i / size).cast("int")
        start = sums[b] + total(F.transform(F.slice(cs, b * size + 1, i - b * size), F.length))
        lead = F.array_join(F.slice(cs, F.greatest(i - back + 1, F.lit(1)), F.least(i, F.lit(back))), "")
        shared = F.least(F.length(lead), F.lit(overlap))
        lead = F.substring(lead, F.length(lead) - shared + 1, shared)
        return F.struct(i.cast("int").alias("piece_no"), (start - shared).cast("int").alias("start_pos"), F.concat(lead, F.element_at(cs, (i + 1).cast("int"))).alias("piece"))

    def every(cs: Column, size: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), size), lambda b: total(F.transform(F.slice(cs, b * size + 1, size), F.length)))  # of each block
        upto = F.transform(F.array(own), lambda o: F.transform(F.sequence(F.lit(0), size), lambda b: total(F.slice(o, F.lit(1), b))))[0]
        return F.transform(F.array(upto), lambda sums: F.transform(cs, lambda c, i: one(cs, sums, size, i)))[0]

    many = F.transform(F.array(cores), lambda cs: every(cs, F.ceil(F.sqrt(F.size(cs))).cast("int")))[0]
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), F.lit(0).alias("start_pos"), text.alias("piece")))
    none = F.array().cast("array<struct<piece_no:int,start_pos:int,piece:string>>")
    return F.when(F.length(text) > max_chars, many).when(F.length(text) > 0, whole).otherwise(none)


def limits(split_limits: DataFrame) -> dict[str, tuple[int, int]]:
    """max_chars and overlap_chars by item_kind; of repeated kinds the smallest limit. One row per kind of item: a few rows."""
    rows = split_limits.where("item_kind in ('text', 'table') and max_chars is not null").groupBy("item_kind").agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)))).alias("x")).collect()
    return {r["item_kind"]: (r["x"][0], r["x"][1]) for r in rows}


def split_elements(elements: DataFrame, split_limits: DataFrame) -> DataFrame:
    """elem_id, text_pieces, table_pieces (see pieces()); a kind without a limit gives no pieces. No shuffle.

    Null or empty content and rows give empty arrays; repeated rows stay repeated; other columns are ignored.
    """
    own = limits(split_limits)
    none = F.array().cast("array<struct<piece_no:int,start_pos:int,piece:string>>")
    e = elements.select("elem_id", "content", table_text().alias("cells_text"))
    return e.select(
        "elem_id",
        (pieces(F.col("content"), *own["text"]) if "text" in own else none).alias("text_pieces"),
        (pieces(F.col("cells_text"), *own["table"]) if "table" in own else none).alias("table_pieces"),
    )
