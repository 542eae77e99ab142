"""Problem 9: one form for texts that look the same but consist of different characters.

The form is computed on whole Arrow batches: the UTF-8 buffer becomes one numpy array of
code points, lookup tables give each code point's replacement (its compatibility
decomposition where that only concerns width, ligatures or spaces, its canonical
decomposition, the Latin letter it looks like, or nothing), expansion offsets place the
replacements, and combining marks are ordered and composed by array operations. No
string function is called per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..storage import Workspace

SIZE = 0x110000
SPACE, NEWLINE, RETURN = 32, 10, 13

# Ranges of Unicode's Default_Ignorable_Code_Point property, without the Hangul fillers' neighbours.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Letters and marks that are drawn like a Latin letter, digit or ASCII mark.
LOOK_ALIKE = (
    # Cyrillic
    ("асԁеһіјӏорԛѕуԝхүѵ", "acdehijlopqsywxyv"),
    ("АВСЕНІЈКМОРЅТУХԚԜҮӀ", "ABCEHIJKMOPSTYXQWYI"),
    # Greek
    ("αγικοϳνρυϲ", "ayikojvpuc"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    # Armenian
    ("հոսօցզգք", "hnuogqqp"),
    ("ՍՕԼ", "UOL"),
    # Coptic
    ("ⲟⲣⲥ", "opc"),
    ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "BHIKMNOPCTYX"),
    # Lisu
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    # Cherokee
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎩᏃᏀᏒᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYZGRVSLCPKB"),
    # Latin
    ("ɡɑ", "ga"),
    # hyphens and dashes of a hyphen's height, apostrophes, slashes, colon
    ("‐‑‒–−", "-----"),
    ("’ʼ", "''"),
    ("⁄∕", "//"),
    ("∶", ":"),
)
# Letters whose small capital is drawn like the small letter.
SMALL_CAPITALS = "COSUVWZ"
# Compatibility letters that are drawn otherwise than what they decompose to (long s, Greek symbols, a with a half ring).
DRAWN_OTHERWISE = frozenset("ſϐϑϒϕϖϰϱϲϴϵϹẚ")
# Compatibility kinds that change width, style, spacing or ligature but not what is read.
KINDS = ("<wide>", "<narrow>", "<small>", "<compat>", "<noBreak>", "<font>")
BREAKS = (0x85, 0x2028, 0x2029, 0x0B, 0x0C)
#: Bytes of text worked on at a time; a longer text is taken whole.
SLICE = 4 << 20


def _twins() -> dict[int, int]:
    small = {ord(unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {x}")): ord(x.lower()) for x in SMALL_CAPITALS if x != "S"} | {0xA731: ord("s")}
    return small | {ord(a): ord(b) for odd, plain in LOOK_ALIKE for a, b in zip(odd, plain, strict=True)}


class Tables:
    """Replacements of code points, filled as code points are met; they depend on nothing else."""

    #: Bits of ``kind``: the code point is replaced; it may join what stands before it.
    REPLACED, JOINS = 1, 2

    def __init__(self) -> None:
        self.known = np.zeros(SIZE, bool)
        self.kind = np.zeros(SIZE, np.uint8)
        self.mark = np.zeros(SIZE, np.uint8)
        # two replacements of each code point: taken apart, and composed as far as it goes by itself
        self.length = np.zeros((2, SIZE), np.uint8)
        self.start = np.zeros((2, SIZE), np.int32)
        self.pool = np.zeros(0, np.uint32)
        self.twins = _twins()
        self.ignored = np.zeros(SIZE, bool)
        for a, b in IGNORABLE:
            self.ignored[a : b + 1] = True
        pairs = {}
        for c in [*range(0xC0, 0x3400), *range(0xF900, 0x10000), *range(0x11000, 0x12000)]:
            parts = unicodedata.decomposition(chr(c)).split()
            if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(c)) == chr(c):
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = c
        self.pairs = np.array(sorted(pairs), np.int64)
        self.composed = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.seconds = {k & 0x1FFFFF for k in pairs} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))

    def _replacement(self, c: int) -> list[int]:
        if self.ignored[c]:
            return []
        if 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xE000:
            return [c]
        if c in BREAKS:
            return [NEWLINE]
        if c == 9 or unicodedata.category(chr(c)) == "Zs":
            return [SPACE]
        if c in self.twins:
            return [self.twins[c]]
        parts = unicodedata.decomposition(chr(c)).split()
        if parts and (parts[0] in KINDS or parts[0][0] != "<") and chr(c) not in DRAWN_OTHERWISE:
            return [x for p in parts if p[0] != "<" for x in self._replacement(int(p, 16))]
        return [c]

    def learn(self, points: np.ndarray) -> None:
        seen = np.zeros(SIZE, bool)
        seen[points] = True
        new = np.flatnonzero(seen & ~self.known)
        if not len(new):
            return
        apart = [self._replacement(int(c)) for c in new]
        whole = [[ord(x) for x in unicodedata.normalize("NFC", "".join(map(chr, a)))] if not any(0xD800 <= x < 0xE000 for x in a) else a for a in apart]
        for which, added in enumerate((apart, whole)):
            lengths = np.array([len(a) for a in added], np.int64)
            self.length[which, new], self.start[which, new] = lengths, len(self.pool) + np.cumsum(lengths) - lengths
            self.pool = np.concatenate([self.pool, np.array([x for a in added for x in a], np.uint32)])
        # The marks of a replacement must be known too, to be ordered.
        for x in {x for a in (*apart, *whole) for x in a}:
            self.mark[x] = unicodedata.combining(chr(x))
        for c, a, w in zip(new.tolist(), apart, whole, strict=True):
            joins = bool(a) and any(self.mark[x] or x in self.seconds for x in (a[0], w[0]))
            self.kind[c] = self.REPLACED * (w != [c] or c == RETURN) | self.JOINS * joins
        self.known[new] = True

    def replaced(self, points: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """(code points of the replacements, number of them for each given code point)"""
        counts = self.length[which, points].astype(np.int64)
        # place of each replacement in the pool: its start, plus how far this character is into it
        begin = np.cumsum(counts) - counts
        at = np.repeat(self.start[which, points] - begin, counts) + np.arange(int(counts.sum()))
        return self.pool[at], counts

    def compose(self, base: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The composed code point of each pair, 0 where there is none."""
        base, after = base.astype(np.int64), after.astype(np.int64)
        key = base << 21 | after
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        out = np.where(self.pairs[at] == key, self.composed[at], 0).astype(np.int64)
        lead, vowel = base - 0x1100, after - 0x1161
        out = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), 0xAC00 + (lead * 21 + vowel) * 28, out)
        syllable, tail = base - 0xAC00, after - 0x11A7
        return np.where((syllable >= 0) & (syllable < 11172) & (syllable % 28 == 0) & (tail > 0) & (tail < 28), base + tail, out)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, row number of each); null is as empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    lengths = np.diff(starts[offsets - offsets[0]])
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_valid()), lengths, 0)
    return points, np.repeat(np.arange(len(texts)), lengths)


def _strings(points: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=width, minlength=n))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(data))


def _order_marks(points: np.ndarray, row: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of combining marks in canonical order; the sort is stable and leaves starters in place."""
    marks = rank > 0
    if not (marks[1:] & marks[:-1] & (rank[1:] < rank[:-1])).any():
        return points, rank
    run = np.cumsum(~marks | np.concatenate([[True], row[1:] != row[:-1]]))
    order = np.lexsort((rank, run))
    return points[order], rank[order]


def _compose(points: np.ndarray, row: np.ndarray, rank: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Marks are merged into the starters before them, one per starter and pass."""
    tried = np.zeros(len(points), bool)
    while len(points):
        index = np.arange(len(points))
        first = np.concatenate([[True], row[1:] != row[:-1]])
        starter = np.maximum.accumulate(np.where((rank == 0) | first, index, 0))
        before = np.concatenate([[0], rank[:-1]])
        adjacent = starter == index - 1
        # what follows a starter directly, or behind marks of a lower class only
        free = ~first & (rank[starter] == 0) & ((rank > 0) & (adjacent | ((before > 0) & (before < rank))))
        # a starter can only follow directly
        again = np.concatenate([[0], index[:-1]])
        direct = ~first & (rank == 0) & (before == 0)
        with_ = np.where(rank == 0, again, starter)
        open_ = np.flatnonzero((free | direct) & ~tried)
        if not len(open_):
            break
        merged = tables.compose(points[with_[open_]], points[open_])
        tried[open_[merged == 0]] = True
        hit = open_[merged > 0]
        if not len(hit):
            break
        new = merged[merged > 0]
        # the first per starter; two merges must not share a character
        _, keep = np.unique(with_[hit], return_index=True)
        hit, new = hit[keep], new[keep]
        clear = np.concatenate([[True], with_[hit[1:]] != hit[:-1]]) if len(hit) else np.zeros(0, bool)
        hit, new = hit[clear], new[clear]
        points = points.copy()
        points[with_[hit]] = new
        changed = np.zeros(len(points), bool)
        changed[with_[hit]] = True
        tried &= ~changed[with_]
        tried[np.minimum(hit + 1, len(points) - 1)] = False  # what follows now stands behind the merged one
        left = np.ones(len(points), bool)
        left[hit] = False
        points, row, rank, tried = points[left], row[left], rank[left], tried[left]
    return points, row


def _tidy_spaces(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One kind of line break, single spaces, none at the ends of lines."""
    def edges() -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        return new, np.concatenate([new[1:], [True]]) if len(row) else new

    new, last = edges()
    follows = np.concatenate([points[1:], [0]])
    keep = ~((points == RETURN) & ~last & (follows == NEWLINE))
    points, row = np.where(points == RETURN, NEWLINE, points)[keep], row[keep]
    new, last = edges()
    before = np.where(new, NEWLINE, np.concatenate([[NEWLINE], points[:-1]]))
    keep = ~((points == SPACE) & ((before == SPACE) | (before == NEWLINE)))
    points, row = points[keep], row[keep]
    new, last = edges()
    follows = np.where(last, NEWLINE, np.concatenate([points[1:], [NEWLINE]]))
    keep = ~((points == SPACE) & (follows == NEWLINE))
    return points[keep], row[keep]


def _untidy(points: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which spaces stand next to another, at a line's end or at its start."""
    space = points == SPACE
    edge = np.ones(len(points) + 1, bool)  # between characters: is it between two rows
    edge[1:-1] = row[1:] != row[:-1]
    gap = space | (points == NEWLINE)
    after, before = edge[1:].copy(), edge[:-1].copy()
    after[:-1] |= gap[1:]
    before[1:] |= points[:-1] == NEWLINE
    return space & (after | before)


def _formed(texts: pa.Array, tables: Tables) -> pa.Array:
    """Forms of a slice: most texts stay as they are; of the others only those with marks to compose are taken apart."""
    n = len(texts)
    points, row = _points(texts)
    tables.learn(points)
    kind = tables.kind[points]
    hit = kind > 0
    hit |= _untidy(points, row)
    other = np.zeros(n, bool)
    other[row[hit]] = True
    if not other.any():
        return texts
    marked = np.zeros(n, bool)
    marked[row[kind & Tables.JOINS > 0]] = True
    place, made = np.arange(n), [texts]
    total = n
    for which, rows in ((1, other & ~marked), (0, other & marked)):
        if not rows.any():
            continue
        taken = rows[row]
        renumber = np.cumsum(rows) - 1
        out, counts = tables.replaced(points[taken], which)
        own = np.repeat(renumber[row[taken]], counts)
        out, own = _tidy_spaces(out, own)
        if which == 0:
            rank = tables.mark[out].astype(np.int64)
            out, rank = _order_marks(out.astype(np.int64), own, rank)
            out, own = _compose(out, own, rank, tables)
        size = int(rows.sum())
        made.append(_strings(out.astype(np.uint32), own, size))
        place[rows] = total + np.arange(size)
        total += size
    return pa.concat_arrays(made).take(pa.array(place))


def visual_forms(texts: pa.Array, tables: Tables) -> pa.Array:
    """The common form of each text of a batch; null gives an empty text.

    Texts have the same form exactly if they show the same up to the width of characters and
    spaces: full and half width, composed and combining accents, ligatures, letters in mathematical style, invisible characters,
    kinds of spaces and hyphens, and letters of other scripts drawn like Latin ones. Case,
    accents, digits and line breaks are kept. A batch is worked on in slices of SLICE bytes of text, so memory goes by
    that and the longest text.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    parts = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // SLICE)) + 1 if len(texts) else []
    bounds = [0, *map(int, parts), len(texts)]
    return pa.concat_arrays([_formed(texts.slice(a, b - a), tables) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


def with_visual_form(documents: DataFrame, text: str = "text", form: str = "form") -> DataFrame:
    """``documents`` with a string column ``form``; see ``visual_forms``."""
    names = [c for c in documents.columns if c != form]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for part in parts:
            made = visual_forms(part.column(names.index(text)), tables).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*names, form])

    schema = documents.select(*names).withColumn(form, F.lit("")).schema
    return documents.select(*names).mapInArrow(batches, schema)


def same_look_pairs(documents: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: texts that look the same but differ in their characters.

    ``documents``: (doc_id, text). Null texts and texts without visible characters are in no
    pair, nor are equal texts. Forms shared by one text only, however many copies it has, are left out
    before any pair is made.
    """
    formed = with_visual_form(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    marks = ws.keep(formed.where("length(trim(both ' \\n' from form)) > 0").select("doc_id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("own")), "marks")
    # written, so that adaptive execution can split the texts of a form that very many share
    mixed = ws.keep(marks.groupBy("form").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a != b").select("form"), "forms")
    few = ws.keep(marks.join(mixed, "form", "left_semi"), "mixed")
    a = few.select("form", F.col("doc_id").alias("doc_id_a"), F.col("own").alias("own_a"))
    b = few.select("form", F.col("doc_id").alias("doc_id_b"), F.col("own").alias("own_b"))
    return a.join(b, "form").where("own_a != own_b and doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_look_pairs(table(spark, folder, "documents", "doc_id", "text"), Workspace(spark, "p9"))


def p9_forms(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, form): every text in its common form."""
    return with_visual_form(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "form")
