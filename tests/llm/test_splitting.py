import random
import time

import numpy as np
import pytest

from marquee.llm.splitting import LINE, PARAGRAPH, SENTENCE, Splitter, WordTable, boundary_strengths, climbed, oversized, split_texts, valley_depths
from marquee.llm.tokenize import TrieEncoder, Vocabulary


@pytest.fixture(scope="module")
def encoder():
    return TrieEncoder(Vocabulary.load())


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8)))
    prose = " ".join(word() + rng.choice(["", "", ".", "!"]) for _ in range(900))
    lines = "\r\n".join(" ".join(word() for _ in range(9)) for _ in range(120))
    return [prose, lines, "日本語の文章です。" * 300, "x" * 9000, "🇨🇿🎬" * 400, "\n\n".join(prose[i : i + 300] for i in range(0, 3000, 300)), " " * 4000, "word " * 5000, "".join(rng.choice(["a", "film", " ", "  ", "\n", "\r", "\r\n", "\x1c", "\u3000", "'ll", "…", "é", "7"]) for _ in range(6000))]


@pytest.mark.parametrize("limit,overlap", [(512, 32), (64, 8), (40, 0)])
def test_pieces_cover_the_text(encoder, limit, overlap):
    s = Splitter(encoder, limit, overlap)
    for text in texts():
        pieces = s.pieces(text)
        assert all(n <= limit and n == sum(encoder.word_sizes(t)[1]) for _, _, n, t in pieces)
        joined, end = pieces[0][3].encode(), pieces[0][1]
        offsets, ids = encoder.encode([text])
        for first, last, _, piece in pieces[1:]:
            assert overlap <= end - first <= overlap + 3
            shared = sum(len(encoder.vocabulary.tokens[t]) for t in ids[first:end])
            assert joined.endswith(piece.encode()[:shared])
            joined, end = joined + piece.encode()[shared:], last
        assert joined == text.encode() and end == len(ids)


def test_natural_boundaries(encoder):
    words = encoder.words('He left. "Stop!" she said\n\nNext line\r\nlast')
    table = WordTable(encoder)
    numbers = table.numbers(words)
    strengths = boundary_strengths(table.facts[numbers]).tolist()
    assert SENTENCE in strengths and PARAGRAPH in strengths and LINE in strengths


def test_deepest_valley_is_the_topic_change(encoder):
    a, b = "cook soup salt pepper kitchen plate ".split(), "engine wheel brake tyre garage clutch ".split()
    words = [" " + w for w in (a * 12 + b * 12)]
    gaps = list(range(5, len(words) - 1, 6))
    table = WordTable(encoder)
    codes, upto = table.terms_of(table.numbers(words))
    depths = valley_depths(codes, upto[gaps], 30)
    assert gaps[max(range(len(gaps)), key=lambda i: depths[i])] == len(a) * 12 - 1


def test_peaks_are_reached_in_one_pass():
    def walked(values, i):
        while i and values[i - 1] >= values[i]:
            i -= 1
        return values[i]

    rng = random.Random(4)
    for size in (0, 1, 2, 40):
        values = np.array([rng.randrange(4) for _ in range(size)], float)
        assert climbed(values).tolist() == [walked(values, i) for i in range(size)]


def test_plateaus_take_linear_time(encoder):
    took = []
    for n in (4000, 16000):
        s, text = Splitter(encoder, 512, 32), "The same sentence again. " * n
        start = time.process_time()
        s.pieces(text)
        took.append(time.process_time() - start)
    assert took[1] < 10 * max(took[0], 0.1)


def test_frame(spark):
    df = spark.createDataFrame([(1, "short", 1), (2, None, 1), (3, "", 1), (4, "word " * 700, 1)], "doc_id bigint, text string, piece int")
    out = split_texts(df, "doc_id", "text")
    assert [r.doc_id for r in oversized(out, "doc_id").collect()] == [4]
    rows = {(r.doc_id, r.piece): r for r in out.collect()}
    assert rows[1, 1].text == "short" and rows[2, 1].text is None and rows[3, 1].n_tokens == 0 and rows[4, 2].first_token == rows[4, 1].end_token - 32
    assert split_texts(df.limit(0), "doc_id", "text").count() == 0
