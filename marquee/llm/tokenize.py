"""Problem 8: encoding of a whole corpus by a public byte-level BPE vocabulary.

The distinct words of a batch that a worker hasn't met are put in lexicographic order, which is the depth-first order of
their trie. The traversal carries one state per depth: the last token of the encoding of the prefix that ends there. The
state of a new depth follows from those above it (a token t that ends the prefix is the last one exactly if t may follow
the last token of the prefix before t), so a prefix shared by many words is encoded once, and a word's ids are read off by
walking back from its end.

Defined cases: an empty and a null text give an empty list; strings that look like special tokens are ordinary text; every
row has a result; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from marquee.session import ship

#: Where the public vocabulary files lie; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern that cuts text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers between batches; beyond it the memory is emptied and filled anew.
REMEMBERED = 400_000
_NONE = 1 << 30


class Vocabulary:
    """Token bytes by id, and the pair each token was merged from; small and of fixed size, so it travels with the tasks."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.lengths = sorted({len(t) for t in tokens})
        self.left, self.right = self._pairs()
        self.merge = {(a, b): t for t, (a, b) in enumerate(zip(self.left, self.right)) if a != t}

    def _pairs(self) -> tuple[array, array]:
        """Each token's two parts: its bytes merged by lower ranks only. A single byte is its own part."""
        left, right = array("i"), array("i")
        for t, token in enumerate(self.tokens):
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                found = [(self.rank.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                r, i = min(found)
                if r >= t:
                    raise ValueError(f"token {t} can't be reached by merges")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            left.append(self.rank[parts[0]] if len(parts) == 2 else t)
            right.append(self.rank[parts[1]] if len(parts) == 2 else t)
        return left, right

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Vocabulary:
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
        if [r for r, _ in ranks] != list(range(len(ranks))):
            raise ValueError("ranks have gaps")
        return cls([t for _, t in ranks])

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves the two tokens side by side.

        The boundary is crossed by a merge of x, the right edge of a, and y, the left edge of b, if that merge comes before
        the merges that bury x or y. The edges are undone from the latest merge back to single bytes.
        """
        merge, left, right = self.merge, self.left, self.right
        deadline = _NONE
        while True:
            made = merge.get((a, b), _NONE)
            if made < deadline:
                return False
            # Undo the later of the two tokens; on equal terms the left one's merge came first.
            if a > b:
                if right[a] == a:
                    if left[b] == b:
                        return True
                    deadline, b = b + 1, left[b]
                else:
                    deadline, a = a, right[a]
            else:
                if left[b] == b:
                    if right[a] == a:
                        return True
                    deadline, a = a, right[a]
                else:
                    deadline, b = b + 1, left[b]


class TrieEncoder:
    """Encodes words by depth-first traversal of the trie of the distinct ones."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        pattern = regex.compile(PATTERN)
        self.words = pattern.findall
        self.found = lambda text: (m.group() for m in pattern.finditer(text))  # the same one by one
        self.memory: dict[str, tuple[int, ...]] = {}

    def _traverse(self, words: Iterable[str]) -> None:
        """Remember the ids of all these words."""
        v = self.vocabulary
        rank, lengths, tokens, follows = v.rank, v.lengths, v.tokens, v.follows
        last: list[int] = [-1]  # by depth: the last token of the path's prefix
        path = b""
        for code, word in sorted((w.encode("utf-8"), w) for w in words):
            whole = rank.get(code)
            if whole is not None:
                self.memory[word] = (whole,)
                continue
            shared, most = 0, min(len(path), len(code))
            while shared < most and path[shared] == code[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(code) + 1):
                for n in lengths:
                    if n > depth:
                        raise ValueError("bytes without an encoding")
                    t = rank.get(code[depth - n : depth])
                    if t is not None and (n == depth or follows(last[depth - n], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError("bytes without an encoding")
            path, depth, ids = code, len(code), []
            while depth:
                ids.append(last[depth])
                depth -= len(tokens[last[depth]])
            self.memory[word] = tuple(ids[::-1])

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        missing = {w for words in texts for w in words} - self.memory.keys()
        if missing:
            self._traverse(missing)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts, end to end."""
        cut = [self.words(t) if t else [] for t in texts]
        self.learn(cut)
        memory, ids, offsets = self.memory, array("i"), [0]
        for words in cut:
            for w in words:
                ids.extend(memory[w])
            offsets.append(len(ids))
        return np.array(offsets, np.int32), np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)

    def sizes(self, words: list[str]) -> list[int]:
        """The number of tokens of each word."""
        memory = self.memory
        try:
            return [len(memory[w]) for w in words]
        except KeyError:
            self.learn([words])
            return [len(self.memory[w]) for w in words]

    def word_sizes(self, text: str) -> tuple[list[str], list[int]]:
        """The words of a text and the number of tokens of each."""
        words = self.words(text)
        return words, self.sizes(words)


_encoders: dict[int, TrieEncoder] = {}


def encoder(tokens: list[bytes]) -> TrieEncoder:
    """The worker's encoder; it lives as long as the Python worker, which is reused between tasks."""
    key = xxhash.xxh3_64_intdigest(b"".join(len(t).to_bytes(4, "little") + t for t in tokens))
    if key not in _encoders:
        _encoders[key] = TrieEncoder(Vocabulary(tokens))
    return _encoders[key]


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and, but for single long texts, so many bytes of text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, n, total = 0, batch.num_rows, 0
    for i in range(n):
        if i > start and (i - start >= rows or total + lengths[i] > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += lengths[i]
    if n > start:
        yield batch.slice(start)


def spread(df: DataFrame) -> DataFrame:
    """Texts over all cores: an input of few partitions is dealt out, so that one long file doesn't keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(3 * cores)


def token_ids(df: DataFrame, record: str, text: str, *, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(record, ids): the token ids of each text, without special tokens; an empty list for empty and null texts."""
    ship(df.sparkSession)
    tokens = Vocabulary.load(vocabulary, folder).tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokens)
        for batch in batches:
            for part in slices(batch, 1):
                offsets, ids = e.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [record, "ids"])

    source = df.select(record, df[text].cast("string").alias("text"))
    return spread(source).mapInArrow(run, f"{record} {df.schema[record].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, text: str, *, keep: list[str], count: str = "n_tokens", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The kept columns and the number of tokens of each text (0 for empty and null ones)."""
    ship(df.sparkSession)
    tokens = Vocabulary.load(vocabulary, folder).tokens
    source = df.select(*keep, df[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, at = encoder(tokens), len(keep)
        for batch in batches:
            for part in slices(batch, at):
                offsets, _ = e.encode(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(np.diff(offsets).astype(np.int64))], [*keep, count])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return spread(source).mapInArrow(run, f"{fields}, `{count}` bigint")
