"""Splitting oversized items: content-defined chunking, snapped to natural boundaries.

A rolling hash runs over the text. From each cut, the landmark is the place with the smallest hash between the least and
the greatest size of a piece; the cut is the natural boundary nearest to the landmark, of the best kind that the range
holds (comment, paragraph, line, sentence, word), or the landmark itself where there is none. As hash and boundaries depend
on nearby characters only, an edit moves the cuts next to it and later cuts fall back into their old places.

Each piece but the first starts with the last `overlap` characters of the piece before; with them it stays within the limit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 32
PIECES = "item_kind string, item_id long, piece_no int, start_pos int, end_pos int, overlap int, cut_kind string, text string"

#: Kinds of boundary, best first; a cut falls after the match.
BOUNDARIES = (
    ("comment", re.compile(r"\n(?=[^\s():]{1,60} \([a-z_ ]{1,30}\):)")),
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)+")),
    ("line", re.compile(r"\r\n|\n|\r")),
    ("sentence", re.compile(r"[.!?…][\"')\]]*[ \t]+|[。！？]")),
    ("word", re.compile(r"\s+")),
)


def rolling_hash(text: str) -> np.ndarray:
    """A hash of the WINDOW characters before each place 0..len(text), as uint64."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(codes) + 1, np.uint64)
    power = np.uint64(1)
    for back in range(min(WINDOW, len(codes))):
        out[back + 1 :] += mixed[: len(codes) - back] * power
        power = np.uint64((int(power) * 0x100000001B3) & (2**64 - 1))
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(27))


def splits_mark(text: str, at: int) -> bool:
    """Whether a cut here would part a line end or a character from its marks."""
    return 0 < at < len(text) and (text[at - 1 : at + 1] == "\r\n" or "̀" <= text[at] <= "ͯ" or text[at] in "‍️" or text[at - 1] == "‍")


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Ends of the pieces with the kind of each cut; the last end is len(text), of kind ``end``."""
    size = len(text)
    if limit <= 0:
        raise ValueError("the limit must be positive")
    overlap = max(0, min(overlap, limit - 1))
    most = limit - overlap
    least = max(1, most // 2)
    if size <= limit:
        return [(size, "end")]
    hashes = rolling_hash(text)
    found = [(kind, np.array([m.end() for m in pattern.finditer(text)], np.int64)) for kind, pattern in BOUNDARIES]
    out, at = [], 0
    while size - at > (most if at else limit):
        lo, hi = at + least, at + (most if at else limit)
        mark = lo + int(hashes[lo : hi + 1].argmin())
        for kind, ends in found:
            a, b = np.searchsorted(ends, (lo, hi + 1))
            if a < b:
                near = ends[a:b]
                at = int(near[np.abs(near - mark).argmin()])
                break
        else:
            kind, at = "landmark", mark
            while splits_mark(text, at) and at > lo:
                at -= 1
        out.append((at, kind))
    return [*out, (size, "end")]


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items ``item_kind, item_id, text`` longer than their kind's limit, once each, with max_chars and overlap_chars.

    limits is the fixed small table of kinds. Null texts and kinds without a limit are never oversized. Equal rows are told by the
    item's id and 128 bits of hashes of its text, so that whole texts are no keys.
    """
    joined = items.join(F.broadcast(limits.select("item_kind", "max_chars", "overlap_chars")), "item_kind").where(F.char_length("text") > F.col("max_chars"))
    keyed = joined.withColumns({"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})
    return keyed.dropDuplicates(["item_kind", "item_id", "_h1", "_h2"]).drop("_h1", "_h2")


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Ordered pieces of every oversized item: item_kind, item_id, piece_no, start_pos, end_pos, overlap, cut_kind, text.

    ``text`` is the item's text from start_pos to end_pos in code points, its first ``overlap`` ones repeat the piece
    before; dropping them and joining the pieces gives the item. Items within the limit give no rows. Items of one id with
    several texts are split each.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for kind, item, limit, overlap, text in zip(*(batch.column(k).to_pylist() for k in ("item_kind", "item_id", "max_chars", "overlap_chars", "text")), strict=True):
                lap, at = max(0, min(overlap or 0, limit - 1)), 0
                for n, (end, cut_kind) in enumerate(cuts(text, limit, lap)):
                    back = min(lap, at)
                    rows.append((kind, item, n, at - back, end, back, cut_kind, text[at - back : end]))
                    at = end
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return oversized(items, limits).select("item_kind", F.col("item_id").cast("long").alias("item_id"), F.col("max_chars").cast("int").alias("max_chars"), F.col("overlap_chars").cast("int").alias("overlap_chars"), "text").mapInArrow(run, PIECES)


def project_items(curated: DataFrame, chunk: DataFrame) -> DataFrame:
    """The two kinds of items of this project as ``item_kind, item_id, text``."""
    a = curated.select(F.lit("curated").alias("item_kind"), F.col("record_id").alias("item_id"), F.col("formatted_discussion").alias("text"))
    return a.unionByName(chunk.select(F.lit("chunk").alias("item_kind"), F.col("chunk_no").alias("item_id"), "text"))


def found_items(pieces: DataFrame) -> DataFrame:
    """``item_kind, item_id`` of the items that were split."""
    return pieces.where("piece_no = 1").select("item_kind", "item_id").distinct()
