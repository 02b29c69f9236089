"""Splitting oversized texts at natural boundaries by agglomerative merging.

A text above its limit is first cut into atomic segments, each ended by a boundary of some strength
(grapheme < word < clause < sentence < line < paragraph). Adjacent segments wait in a heap, weakest
boundary first; a pair is merged while its combined size plus the overlap fits the limit. What is
left are the pieces; each but the first is then preceded by the ``overlap`` code points before it.
"""

from __future__ import annotations

import heapq

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.arrow import map_lists

GRAPHEME, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

NAMES = ("grapheme", "word", "clause", "sentence", "line", "paragraph")

#: A mark with the white space after it, or white space alone; line breaks in the white space outrank the mark.
_BOUNDARY = regex.compile(r"(?:(?P<s>[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[」』）]*)|(?P<c>[,;:](?=\s)|[、，；：]))\s*|(?P<w>\s+)")
_STRENGTH = {"s": SENTENCE, "c": CLAUSE, "w": WORD}
_BREAK = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028]|(?P<p>\u2029)")
_GRAPHEMES = regex.compile(r"\X")


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments of ``text`` and the strength of the boundary at each end.

    No segment is longer than ``most``; one that would be is cut between grapheme clusters, and a
    single cluster longer than ``most`` between code points.
    """
    ends, strengths, start = [], [], 0

    def close(end: int, strength: int) -> None:
        nonlocal start
        if end - start > most:
            last = start
            for m in _GRAPHEMES.finditer(text, start, end):
                while m.end() - last > most:
                    last = m.start() if m.start() > last else last + most
                    ends.append(last)
                    strengths.append(GRAPHEME)
        ends.append(end)
        strengths.append(strength)
        start = end

    for m in _BOUNDARY.finditer(text):
        breaks = list(_BREAK.finditer(text, m.start(), m.end()))
        if breaks:  # what indents the next line stays with it
            close(breaks[-1].end(), PARAGRAPH if len(breaks) > 1 or breaks[0]["p"] else LINE)
        else:
            close(m.end(), _STRENGTH[m.lastgroup])
    if start < len(text):
        close(len(text), PARAGRAPH)
    return ends, strengths


def piece_cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Start and end of each piece of ``text``, the overlap included, and the strength of the boundary at its end; in order, covering the text."""
    n = len(text)
    if limit < 1 or n <= limit:
        return [(0, n, PARAGRAPH)]
    overlap = max(0, min(overlap, limit - 1))
    most = limit - overlap
    ends, strengths = atoms(text, most)
    count = len(ends)
    starts = [0, *ends[:-1]]
    right, left, alive = list(range(1, count + 1)), list(range(-1, count - 1)), [True] * count
    heap = [(strengths[i], ends[i + 1] - starts[i], i, i + 1, ends[i + 1]) for i in range(count - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j, end = heapq.heappop(heap)
        if not alive[i] or j >= count or not alive[j] or right[i] != j or ends[j] != end or ends[j] - starts[i] != size:
            continue
        if size + (overlap if i else 0) > limit:  # nothing precedes the first piece
            continue
        ends[i], strengths[i], alive[j], k = ends[j], strengths[j], False, right[j]
        right[i] = k
        if k < count:
            left[k] = i
            heapq.heappush(heap, (strengths[i], ends[k] - starts[i], i, k, ends[k]))
        if (h := left[i]) >= 0:
            heapq.heappush(heap, (strengths[h], ends[i] - starts[h], h, i, ends[i]))
    kept = [(starts[i], ends[i], strengths[i]) for i in range(count) if alive[i]]
    short = 0
    while kept[short][1] < overlap:  # too short to share; with the next piece, of at most limit - overlap, it still fits
        short += 1
    kept[: short + 1] = [(0, *kept[short][1:])]
    return [(max(0, a - overlap), b, strength) for a, b, strength in kept]


def piece_bounds(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``."""
    return [(a, b) for a, b, _ in piece_cuts(text, limit, overlap)]


def split_oversized(df: DataFrame, key: str, text: str, limit: str, overlap: str) -> DataFrame:
    """The texts of ``df`` as pieces: ``key, piece_no, n_pieces, char_start, char_end, boundary, piece_text``.

    ``limit`` and ``overlap`` name columns in code points. ``boundary`` names what a piece ends at, ``end`` for
    the last. A text within its limit, or one whose limit is null or below 1, is one piece; so is the empty
    text. A null text gives no row. A null or negative overlap counts as 0, one of the limit or more, which no
    pieces could share, as limit - 1. The shared part is counted in code points as the limit is, so it may begin
    inside a cluster; no piece ends inside one that fits. Repeated rows give repeated pieces, ties between equal
    boundaries go to the smaller, then the earlier pair. Other columns are left out, so their names cannot
    clash. Rows within the limit never leave the JVM.
    """
    columns = (key, "piece_no", "n_pieces", "char_start", "char_end", "boundary", "piece_text")
    fields = f"`{key}` {df.schema[key].dataType.simpleString()}, piece_no int, n_pieces int, char_start int, char_end int, boundary string, piece_text string"
    base = df.select(key, F.col(text).alias("_text"), F.col(limit).cast("long").alias("_limit"), F.coalesce(F.col(overlap).cast("long"), F.lit(0)).alias("_overlap")).where(F.col("_text").isNotNull())
    over = F.coalesce((F.col("_limit") >= 1) & (F.length("_text") > F.col("_limit")), F.lit(False))
    whole = base.where(~over).select(key, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("char_start"), F.length("_text").alias("char_end"), F.lit("end").alias("boundary"), F.col("_text").alias("piece_text"))

    def make():
        def cut(rows: dict) -> dict:
            out: dict[str, list] = {name: [] for name in columns}
            for k, t, most, shared in zip(rows[key], rows["_text"], rows["_limit"], rows["_overlap"]):
                bounds = piece_cuts(t, most, shared)
                out[key] += [k] * len(bounds)
                out["piece_no"] += range(1, len(bounds) + 1)
                out["n_pieces"] += [len(bounds)] * len(bounds)
                out["char_start"] += [a for a, _, _ in bounds]
                out["char_end"] += [b for _, b, _ in bounds]
                out["boundary"] += [*(NAMES[strength] for _, _, strength in bounds[:-1]), "end"]
                out["piece_text"] += [t[a:b] for a, b, _ in bounds]
            return out

        return cut

    return whole.unionByName(map_lists(base.where(over), make, fields))
