"""Byte-level BPE as a streaming transducer with bounded lookahead.

For a merge list, a sequence of tokens is the encoding of its bytes exactly if every two
neighbours are (their own bytes encode to the two of them). So each prefix of a word has
one last token, found from the tokens that end there. Only positions from which a token
could still reach beyond the bytes seen so far can matter to later bytes: at most the
longest token's length less one, the merge list's lookahead. Where the chains
of last tokens from all these positions meet, everything before is final and emitted.
What is kept is the part behind that point, whatever the length of the text. A word short enough to be
held is encoded by the same neighbours, from its start and with the same lookahead.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table

#: Where the public tokenizers' files are.
FOLDER = "/opt/tokenizers"
# How the public byte-level tokenizers cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")
#: Characters read at a time, and from which length a word is no longer held as a whole.
WINDOW, LONG = 1 << 16, 1 << 10
#: Words and pairs remembered by a worker.
REMEMBERED = 1 << 19


class Vocabulary:
    """Tokens and ranks of a byte-level BPE, with what the transducer asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lookahead = max(map(len, ranks)) - 1
        self.suffixes = {t[k:] for t in ranks for k in range(len(t))}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.own: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """The encoding by definition: the pair of lowest rank is merged until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether a token's own bytes encode to it."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self.merged(self.tokens[token]) == [token]
        return known

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one, by its own bytes; None for a single byte."""
        data = self.tokens[token]
        if len(data) == 1:
            return None
        known = self.halves.get(token)
        if known is None:
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return known

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two tokens can stand next to each other; left -1 is the word's start.

        The merges of both sides are undone from the last to the first, each time the later one. If at some point the two tokens
        at the seam merge earlier than what was undone just before, merging would have crossed the seam. On the right side the seam comes
        first among equals, since merging goes from the left.
        """
        if not self.stands(right):
            return False
        if left < 0:
            return True
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            a, b, before = left, right, float("inf")  # what merges at the seam below this rank would have come first
            while True:
                across = self.ranks.get(self.tokens[a] + self.tokens[b])
                if across is not None and across < before:
                    known = False
                    break
                undo_a, undo_b = self.split(a), self.split(b)
                if undo_a is None and undo_b is None:
                    known = True
                    break
                if undo_b is None or undo_a is not None and a > b:
                    before, a = a, undo_a[1]
                else:
                    before, b = b + 1, undo_b[0]
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[key] = known
        return known


class WordTransducer:
    """Takes a word's bytes piece by piece and yields tokens once no later byte can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.data = bytearray()  # bytes behind the final point
        self.last = [-1]  # last token of each prefix; the first is the one before the final point
        self.checked = 0

    def feed(self, data: bytes) -> Iterator[int]:
        for byte in data:
            self._step(byte)
            if len(self.data) - self.checked >= 256:
                yield from self._stable()
                self.checked = len(self.data)

    def _step(self, byte: int) -> None:
        v = self.vocabulary
        self.data.append(byte)
        end, found = len(self.data), []
        for size in range(1, min(end, v.lookahead + 1) + 1):
            piece = bytes(self.data[end - size :])
            if piece not in v.suffixes:
                break
            token = v.ranks.get(piece)
            if token is not None:
                found.append((size, token))
        for size, token in reversed(found):
            if v.neighbours(self.last[end - size], token):
                self.last.append(token)
                return
        raise ValueError("the vocabulary has no token for a byte")

    def _chain(self, stop: int, end: int) -> list[int]:
        out = []
        while end > stop:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return out[::-1]

    def _stable(self) -> Iterator[int]:
        """Emits what lies before the point where all live positions' chains meet."""
        v, end = self.vocabulary, len(self.data)
        live = {end} | {j for j in range(max(0, end - v.lookahead), end) if bytes(self.data[j:]) in v.prefixes}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - len(v.tokens[self.last[far]]) if far else 0)
        point = live.pop()
        if point > 0:
            yield from self._chain(0, point)
            del self.data[:point]
            del self.last[:point]

    def finish(self) -> Iterator[int]:
        yield from self._chain(0, len(self.data))
        self.data.clear()
        self.last = [-1]
        self.checked = 0


@lru_cache(maxsize=1)
def _plain_pattern() -> re.Pattern:
    """PATTERN with its classes spelled out for the first 65,536 code points, for the standard library's faster matcher."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def spelled(kind: str) -> str:
        return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in regex.findall(f"{kind}+", points))

    letters, numbers, space = spelled(r"\p{L}"), spelled(r"\p{N}"), spelled(r"\s")
    rest = rf" ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+|{rest}")


class Encoder:
    """Text to token ids, without special tokens; their strings are ordinary text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words, self.plain = regex.compile(PATTERN), _plain_pattern()
        self.runs = [regex.compile(r) for r in RUNS]

    def word(self, word: str) -> tuple[int, ...]:
        known = self.vocabulary.words
        ids = known.get(word)
        if ids is None:
            data = word.encode("utf-8")
            if len(data) <= LONG:
                ids = tuple(self.looked_ahead(data))
            else:
                transducer = WordTransducer(self.vocabulary)
                ids = (*transducer.feed(data), *transducer.finish())
            if len(known) >= REMEMBERED:
                known.clear()
            if len(word) <= 64:
                known[word] = ids
        return ids

    def looked_ahead(self, data: bytes) -> list[int]:
        """The encoding of a word held as a whole, token by token.

        From each point the longest token that can follow is tried first, looking ahead no further than the
        vocabulary's lookahead. A point has one encoding before it, so one that leads nowhere is never tried twice: as
        many steps as tokens, or few more.
        """
        v, size = self.vocabulary, len(data)

        def ahead(start: int) -> list[int]:
            found = []
            for end in range(start + 1, size + 1):
                piece = data[start:end]
                token = v.ranks.get(piece)
                if token is not None:
                    found.append(token)
                if piece not in v.prefixes:
                    break
            return found

        ids: list[int] = []
        points, options, dead = [0], [ahead(0)], set()
        while points[-1] < size:
            here, last = points[-1], ids[-1] if ids else -1
            while options[-1]:
                token = options[-1].pop()
                end = here + len(v.tokens[token])
                if end not in dead and v.neighbours(last, token):
                    ids.append(token)
                    points.append(end)
                    options.append(ahead(end))
                    break
            else:
                if not ids:
                    raise ValueError("the vocabulary has no token for a byte")
                dead.add(here)
                points.pop()
                options.pop()
                ids.pop()
        return ids

    def stream(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in parts; holds a window of it, not the whole.

        The last two words of a window wait for what follows (white space before a word and
        contractions depend on it). A word longer than LONG goes to the transducer as it comes.
        """
        rest, run, open_word = "", None, None
        for part, final in _with_final(parts):
            text, at = rest + part, 0
            if open_word is not None:
                end = run.match(text).end()
                if end == len(text) and not final:
                    yield from open_word.feed(text[:-8].encode("utf-8"))
                    rest = text[-8:]
                    continue
                if end < len(text) and run is self.runs[2]:
                    end -= 1  # the last white space before a word belongs to that word's match
                yield from open_word.feed(text[:end].encode("utf-8"))
                yield from open_word.finish()
                open_word, at = None, end
            found = [m.span() for m in self.words.finditer(text, at)]
            held = 0 if final else min(2, len(found))
            for a, b in found[: len(found) - held]:
                yield from self.word(text[a:b])
            rest = text[found[-held][0] :] if held else ""
            if held and found[-1][1] - found[-1][0] > LONG:
                a, b = found[-1]
                if held == 2:
                    yield from self.word(text[found[-2][0] : found[-2][1]])
                run = next(r for r in self.runs if r.match(text[b - 1]))
                open_word = WordTransducer(self.vocabulary)
                yield from open_word.feed(text[a : b - 8].encode("utf-8"))
                rest = text[b - 8 : b]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        if not text:
            return []
        if len(text) > WINDOW:
            return list(self.stream(text[i : i + WINDOW] for i in range(0, len(text), WINDOW)))
        ids: list[int] = []
        known = self.vocabulary.words
        plain = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        for word in (self.plain if plain else self.words).findall(text):
            ids += known.get(word) or self.word(word)
        return ids


def _with_final(parts: Iterable[str]) -> Iterator[tuple[str, bool]]:
    held = None
    for part in parts:
        if held is not None:
            yield held, False
        held = part
    if held is not None:
        yield held, True


class Decoder:
    """Token ids back to text, byte by byte: a state machine over UTF-8 that holds at most three bytes.

    A byte that continues nothing, or a sequence that breaks off, gives U+FFFD.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.held, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def _byte(self, b: int) -> str:
        if self.need:
            if self.low <= b <= self.high:
                self.held.append(b)
                self.need -= 1
                self.low, self.high = 0x80, 0xBF
                if self.need:
                    return ""
                text = self.held.decode("utf-8")
                self.held.clear()
                return text
            self.held.clear()
            self.need, self.low, self.high = 0, 0x80, 0xBF
            return "�" + self._byte(b)
        if b < 0x80:
            return chr(b)
        if not 0xC2 <= b <= 0xF4:
            return "�"
        self.need = 1 + (b >= 0xE0) + (b >= 0xF0)
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
        self.held.append(b)
        return ""

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            token = self.vocabulary.tokens[i]
            if not self.need and token.isascii():
                yield token.decode("ascii")
            else:
                yield "".join(map(self._byte, token))

    def finish(self) -> str:
        broken = "�" if self.need else ""
        self.held.clear()
        self.need = 0
        return broken


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once per worker."""
    return Vocabulary.read(path)


def path_of(folder: str = FOLDER, name: str = "byte_bpe_50k") -> str:
    return f"{folder}/{name}.tiktoken"


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): every text's token ids; null and empty texts give an empty list.

    ``documents``: (doc_id, text). Rows are independent: no shuffle. Repeated rows and null ids stay.
    """
    where = path or path_of()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(where))
        for part in parts:
            lists = [np.array(encoder.encode(t), np.int32) for t in part.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    schema = T.StructType([documents.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select("doc_id", "text").mapInArrow(batches, schema)


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``documents`` but text, with ``tokens``, the number of the text's ids."""
    where = path or path_of()
    names = documents.columns
    kept = [c for c in names if c not in ("text", "tokens")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(where))
        for part in parts:
            counts = pa.array([len(encoder.encode(t)) for t in part.column(names.index("text")).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[part.column(names.index(c)) for c in kept], counts], names=[*kept, "tokens"])

    return documents.mapInArrow(batches, documents.select(*kept).withColumn("tokens", F.lit(0).cast("bigint")).schema)


def decoded(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): ids back to text; an empty list gives an empty text, null gives null."""
    where = path or path_of()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary(where))
        for part in parts:
            texts = [None if ids is None else "".join(decoder.feed(ids)) + decoder.finish() for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(batches, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())]))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents", "doc_id", "text"))


def p7_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): every text encoded and decoded again; null comes back as empty."""
    return decoded(p7_ids(spark, folder))
