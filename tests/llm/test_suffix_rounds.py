"""The construction with its whole list rewritten every round, and less often."""

import random

import pytest

from hostlens.llm import suffixes as sx


def some_pieces(r):
    alphabet = r.choice(["a", "ab", "abcd", [chr(i) for i in range(256)]])
    out = ["".join(r.choices(alphabet, k=r.randrange(0, 30))).encode("latin1") for _ in range(r.randrange(1, 12))]
    return out + [p * 3 for p in out[:2]] if r.random() < 0.3 else out


@pytest.mark.parametrize("rounds", [1, 2, 3, 16, 100])
def test_any_number_of_rounds_gives_the_same(rounds):
    r = random.Random(rounds)
    for _ in range(200):
        pieces, window = some_pieces(r), r.choice([1, 2, 3, 5, 8, 300])
        starts = [[p[i : i + window] for i in range(len(p) - window + 1)] for p in pieces]
        every = [w for of in starts for w in of]
        got = sx.repeated_windows(pieces, window, rounds)
        assert [x.tolist() for x in got] == [[every.count(w) > 1 for w in of] for of in starts]


def test_the_whole_list_is_not_rewritten_every_round(monkeypatch):
    """What is rewritten grows with the rounds' own suffixes, not with rounds times the list."""
    moved = []
    plain = sx._merged
    monkeypatch.setattr(sx, "_merged", lambda old, *a: moved.append(len(old)) or plain(old, *a))
    r = random.Random(5)
    pieces = [bytes(r.choices(b"abcdefgh", k=320)) for _ in range(50)]
    sx.repeated_windows(pieces, 200)
    assert sum(moved) < 320 * 50 * 320 / 2


def test_references_name_the_pieces_as_before(spark):
    r = random.Random(7)
    texts = ["".join(r.choices("abc dé日", k=n)) for n in (0, 10, 199, 200, 201, 700, 5000)]
    rows = sx._chunks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id", "text")
    got = [tuple(x) for x in sx._references(rows, 200, 32).collect()]
    want = []
    for x in rows.collect():
        whole = bytes(x.text)
        want += [
            (x.chunk, x.row, x.t1, x.t2, start, n, key, *sx._name(whole[start : start + n - 1 + 200]))
            for start, n, key in sx.cut(whole, 200, 32)
        ]
    assert sorted(got) == sorted(want) and len(want) > 10
