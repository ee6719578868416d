"""Windows that repeat only inside one piece of one text."""

import random

from tests.llm.test_suffixes import brute, run


def test_repeats_inside_one_piece(spark):
    texts = ["x" * 201, "ab" * 105, None, "日" * 75, "abc" * 66 + "ab", "é" * 100]
    got = run(spark, texts, 200)
    assert got == brute(texts, 200)
    assert got[0][1] == [(0, 201)] and got[1][1] == [(0, 210)] and got[4][1] == got[5][1] == []


def test_short_periods_between_other_text(spark):
    r = random.Random(6)
    texts = []
    for i in range(40):
        unit = "".join(r.choices("abcdefgh", k=r.randrange(1, 40)))
        other = ["".join(r.choices("abcdefghijklmnop ", k=r.randrange(0, 90))) for _ in range(2)]
        texts.append(other[0] + (unit * 99)[: r.randrange(40, 130)] + other[1])
    assert run(spark, texts, 50, gram=8) == brute(texts, 50)
    assert run(spark, texts, 50, gram=8, crowded=1, task_bytes=900) == brute(texts, 50)
