"""Words of operator 10, solved many at once."""

import random
import re

import pytest

from importlake.llm import lattice, registry, sentencepiece_lattice


@pytest.fixture(scope="module")
def known():
    return sentencepiece_lattice.Solved(registry.vocabulary_path(), {})


def made(n, letters, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_words_solved_together_are_solved_as_alone(known):
    words = made(2000, "aeßñ一\U0001f600▁xyzthe\ud800\x00", 64, 1) + made(2000, ["tion", "ung", "e", "st", "é", "▁"], 12, 2) + ["", "a" * 64, "a"]
    assert all(list(memoryview(got).cast("i")) == known.solve(w) for got, w in zip(known.solve_all(words), words)) and known.solve_all([]) == []


def test_places_are_left_when_no_piece_goes_on(known, monkeypatch):
    """All parts of the words up to the longest piece were hashed, 8.2 times the letters of these words."""
    words, seen, mix = made(3000, "abcdefghijklmnopqrstuvwxyz", 24, 3), [], lattice._mix
    monkeypatch.setattr(lattice, "_mix", lambda h: seen.append(h.size) or mix(h))
    known.solve_all(words)
    assert 0 < sum(seen) < 4 * sum(map(len, words))


def test_words_are_cut_alike_by_both_matchers(spark):
    plain = r"[\x00-\x1f▁]| +[^ \x00-\x1f▁]*|[^ \x00-\x1f▁]+"
    texts = made(500, "ab  ▁\n\t\x1f ,é\U0001f600", 30, 4)
    cut = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"regexp_extract_all(t, r'{sentencepiece_lattice.WORD}', 0) as words").collect()
    assert all(r.words == sentencepiece_lattice.FIND.findall(r.t) == re.findall(plain, r.t) for r in cut) and len(cut) == 500
