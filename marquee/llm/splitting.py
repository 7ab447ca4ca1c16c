"""Problem 10: cutting oversized texts into pieces at natural boundaries.

Lexical-cohesion segmentation: at every paragraph, line and sentence end the words of the block before are compared with
those of the block after; the depth of a valley in that similarity says how likely the topic changes there. A piece ends at
the deepest valley of its size window (from half the limit to the limit); where the window has no such end it ends at the
last word end, else at the last character. The next piece starts the overlap's number of tokens before that cut.

Defined cases: a text of at most the limit, also an empty or null one, is one piece (null text stays null, 0 tokens); cuts
never fall inside a character, so an overlap may be up to three tokens longer than asked for; deeper valleys win, then
stronger boundaries, then later ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marquee.llm.tokenize import REMEMBERED, TOKENIZERS, TrieEncoder, Vocabulary, encoder, slices, spread
from marquee.session import ship

#: Words of the blocks compared on either side of a boundary.
BLOCK = 60
_SENTENCE = re.compile(r"[.!?…。！？]['\"”’»)\]]*$")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
PARAGRAPH, LINE, SENTENCE, WORD, NONE = 4, 3, 2, 1, 0


class WordTable:
    """What cutting needs to know of the words a worker has met: a row of numbers each, and the terms in them."""

    SIZE, BYTES, BLANK, OPENS, BREAKS, LINE_FEED_FIRST, RETURN_LAST, BREAKING, ENDED, WIDE = range(10)

    def __init__(self, e: TrieEncoder):
        self.e = e
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.terms: dict[str, int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.found: list[int] = []  # terms of all words, end to end
        self.starts = [0]
        self.facts, self.flat, self.at = np.zeros((0, 10), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _meet(self, w: str, size: int) -> None:
        blank, breaks = w.isspace(), 0
        if blank and w != " ":
            breaks = w.count("\n") + w.count("\r") - w.count("\r\n")
        ended = not blank and not w[-1].isalnum() and _SENTENCE.search(w) is not None
        self.index[w] = len(self.rows)
        self.rows.append((size, len(w.encode("utf-8")), blank, w[0].isspace(), breaks, w[0] == "\n" and blank, w[-1] == "\r", "\n" in w or "\r" in w, ended, ord(w[-1]) > 0x2FFF))
        if len(w) > 1:
            self.found += [self.terms.setdefault(t.lower(), len(self.terms)) for t in _LETTERS.findall(w)]
        self.starts.append(len(self.found))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' row numbers; words not met before get one."""
        if len(self.rows) > REMEMBERED:
            self.forget()
        index = self.index
        try:
            return np.array([index[w] for w in words], np.int64)
        except KeyError:
            fresh = [w for w in dict.fromkeys(words) if w not in index]
            for w, size in zip(fresh, self.e.sizes(fresh)):
                self._meet(w, size)
            met = len(self.facts)
            self.facts = np.concatenate([self.facts, np.array(self.rows[met:], np.int64)])
            self.flat = np.concatenate([self.flat, np.array(self.found[len(self.flat) :], np.int64)])
            self.at = np.concatenate([self.at, np.array(self.starts[met + 1 :], np.int64)])
            return np.array([index[w] for w in words], np.int64)

    def terms_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the words in order, and the number of terms up to the end of each word."""
        starts, counts = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        upto = np.cumsum(counts)
        return self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - upto + counts, counts)], upto


def boundary_strengths(facts: np.ndarray) -> np.ndarray:
    """By word: what ends with it. White space at a boundary belongs to the side the tokenizer gives it."""
    n = len(facts)
    blank, opening = facts[:, WordTable.BLANK] > 0, facts[:, WordTable.OPENS] > 0
    following = np.append(blank[1:] | opening[1:], True)[:n]  # white space, or the end, comes next
    said = np.maximum.accumulate(np.where(blank, -1, np.arange(n)))  # the last word that isn't blank
    known = said >= 0
    split = np.append(False, (facts[1:, WordTable.LINE_FEED_FIRST] > 0) & (facts[:-1, WordTable.RETURN_LAST] > 0))[:n]  # the two halves of one line end
    upto = np.cumsum(facts[:, WordTable.BREAKS] - split)
    breaks = np.where(blank, upto - np.where(known, upto[said], 0), 0)
    ended, wide = known & (facts[said, WordTable.ENDED] > 0), facts[said, WordTable.WIDE] > 0
    goes_on = np.append(blank[1:] & (facts[1:, WordTable.BREAKING] > 0), False)[:n]  # the cut comes after the white space that follows
    cases = [(breaks > 0) & goes_on, breaks >= 2, breaks == 1, ended & (following | blank | wide), following | blank]
    return np.select(cases, [NONE, PARAGRAPH, LINE, SENTENCE, WORD], NONE)


def valley_depths(codes: np.ndarray, places: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """By gap: how far the similarity of the blocks around it lies below the peaks on both sides.

    codes: the terms of the text in order; places: the number of terms before each gap.
    """
    similarity = np.zeros(len(places))
    for start in range(0, len(places), 24):  # running counts of the terms around so many gaps
        k = places[start : start + 24]
        low, high = max(0, int(k[0]) - block), min(len(codes), int(k[-1]) + block)
        kinds, local = np.unique(codes[low:high], return_inverse=True)
        counts = np.zeros((max(1, len(kinds)), high - low + 1), np.int32)
        counts[local, np.arange(1, high - low + 1)] = 1
        np.cumsum(counts, axis=1, out=counts)
        middle = counts[:, k - low]
        before, after = middle - counts[:, np.maximum(k - block, 0) - low], counts[:, np.minimum(k + block, len(codes)) - low] - middle
        dot, norm = (before * after).sum(axis=0), (before * before).sum(axis=0) * (after * after).sum(axis=0)
        similarity[start : start + 24] = np.where(norm > 0, dot / np.sqrt(np.maximum(norm, 1)), 0.0)
    return climbed(similarity) + climbed(similarity[::-1])[::-1] - 2 * similarity


def climbed(values: np.ndarray) -> np.ndarray:
    """By place: the value reached by going left from it for as long as values don't fall; one pass."""
    if not len(values):
        return values
    stops = np.append(True, values[:-1] < values[1:])
    return values[np.maximum.accumulate(np.where(stops, np.arange(len(values)), 0))]


class Splitter:
    def __init__(self, e: TrieEncoder, limit: int, overlap: int):
        if not 0 <= overlap < limit // 2 - 4:
            raise ValueError("the overlap must be less than half the limit")
        self.e, self.limit, self.overlap, self.table = e, limit, overlap, WordTable(e)

    def pieces(self, text: str, words: list[str] | None = None) -> list[tuple[int, int, int, str]]:
        """(first token, end token, tokens of the piece by itself, text) of the pieces of a text (and its words, if known)."""
        words = self.e.words(text) if words is None else words
        if len(words) <= self.limit:
            total = sum(self.e.sizes(words))
            if total <= self.limit:
                return [(0, total, total, text)]
        numbers = self.table.numbers(words)
        facts = self.table.facts[numbers]
        ends = np.cumsum(facts[:, WordTable.SIZE])  # token position after each word
        total = int(ends[-1])
        if total <= self.limit:
            return [(0, total, total, text)]
        byte_ends = np.cumsum(facts[:, WordTable.BYTES])
        tokens, memory, raw = self.e.vocabulary.tokens, self.e.memory, text.encode("utf-8")

        def byte_at(position: int) -> int:
            """The byte at which a token starts."""
            w = int(np.searchsorted(ends, position, side="right"))
            if w == len(words):
                return len(raw)
            inside = position - int(ends[w] - facts[w, WordTable.SIZE])
            if inside and words[w] not in memory:
                self.e.learn([[words[w]]])
            return int(byte_ends[w] - facts[w, WordTable.BYTES]) + (sum(len(tokens[t]) for t in memory[words[w]][:inside]) if inside else 0)

        def whole(position: int) -> bool:
            """Whether a character starts at this token."""
            b = byte_at(position)
            return b == len(raw) or (raw[b] & 0xC0) != 0x80

        strengths = boundary_strengths(facts)
        natural = np.flatnonzero(strengths >= SENTENCE)
        codes, upto = self.table.terms_of(numbers)
        depths = valley_depths(codes, upto[natural]) if len(natural) else np.zeros(0)
        natural_at, word_at = ends[natural], ends[strengths == WORD]

        def cut(start: int, most: int) -> int:
            low = start + self.limit // 2
            a, b = np.searchsorted(natural_at, [low, most], side="right")
            if a < b:
                return int(natural_at[a + np.lexsort((strengths[natural[a:b]], depths[a:b]))[-1]])
            for places in (word_at, ends):
                k = np.searchsorted(places, most, side="right")
                if k and places[k - 1] > low:
                    return int(places[k - 1])
            end = most
            while not whole(end):
                end -= 1
            return end

        def size(start: int, end: int, piece: str) -> int:
            """Tokens of the piece by itself. Words don't look back, so only those before the first common word end and the
            white space at the piece's end can differ from the text's."""
            last = int(np.searchsorted(ends, end))
            first = int(np.searchsorted(ends, start, side="right"))
            if ends[last] != end or first >= last:
                return sum(self.e.word_sizes(piece)[1])
            fringe = last + 1
            while fringe > first and facts[fringe - 1, WordTable.BLANK]:
                fringe -= 1
            head: list[str] = []
            begin = int(ends[first] - facts[first, WordTable.SIZE])
            if start != begin:  # inside a word: as far as the piece's words and the text's end together
                at = int(byte_ends[first]) - byte_at(start)
                done = 0
                for m in self.e.found(piece):
                    head.append(m)
                    done += len(m.encode("utf-8"))
                    while done > at and first < last:
                        first += 1
                        at += int(facts[first, WordTable.BYTES])
                    if done == at:
                        first += 1
                        break
                if done != at or first > fringe:
                    return sum(self.e.word_sizes(piece)[1])
            tail = self.e.words("".join(words[fringe : last + 1])) if fringe <= last else []
            middle = int(ends[fringe - 1] - (ends[first - 1] if first else 0)) if fringe > first else 0
            return sum(self.e.sizes(head)) + middle + sum(self.e.sizes(tail))

        out, start = [], 0
        while True:
            most = min(start + self.limit, total)
            while True:
                end = total if most == total else cut(start, most)
                piece = raw[byte_at(start) : byte_at(end)].decode("utf-8")
                own = size(start, end, piece)
                if own <= self.limit:
                    break
                most = end - max(1, own - self.limit)  # white space at the edges may be cut differently by itself
            out.append((start, end, own, piece))
            if end == total:
                return out
            start = end - self.overlap
            while not whole(start):
                start -= 1


_splitters: dict[tuple, Splitter] = {}


def splitter(e: TrieEncoder, limit: int, overlap: int) -> Splitter:
    """The worker's splitter; what it knows of words serves all tasks of the Python worker."""
    key = (id(e), limit, overlap)
    if key not in _splitters:
        _splitters[key] = Splitter(e, limit, overlap)
    return _splitters[key]


def split_texts(df: DataFrame, record: str, text: str, *, limit: int = 512, overlap: int = 32, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row per piece: record, piece (from 1), n_pieces, first_token, end_token, n_tokens, text."""
    ship(df.sparkSession)
    tokens = Vocabulary.load(vocabulary, folder).tokens
    names = [record, "piece", "n_pieces", "first_token", "end_token", "n_tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokens)
        cutter = splitter(e, limit, overlap)
        for batch in batches:
            for part in slices(batch, 1, rows=64):
                texts = part.column(1).to_pylist()
                words = [e.words(t) if t else [] for t in texts]
                e.learn(words)
                at, rows = [], []
                for i, t in enumerate(texts):
                    found = cutter.pieces(t, words[i]) if t else [(0, 0, 0, t)]
                    at += [i] * len(found)
                    rows += [(k, len(found), *x) for k, x in enumerate(found, 1)]
                columns = list(zip(*rows))
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *arrays], names)

    kind = df.schema[record].dataType.simpleString()
    schema = f"{record} {kind}, piece bigint, n_pieces bigint, first_token bigint, end_token bigint, n_tokens bigint, text string"
    return spread(df.select(record, df[text].cast("string").alias("text"))).mapInArrow(run, schema)


def oversized(pieces: DataFrame, record: str) -> DataFrame:
    """The records that were cut."""
    return pieces.where("n_pieces > 1 and piece = 1").select(record)
