"""Guess costs below a limit: equal to the costs without one, and quick for values of any length."""

import random
import time

from lectern.llm import secrets

RANK = secrets.ranks(["correct", "horse", "battery", "staple", "were", "pop"])


def value(rng):
    parts = [
        lambda: rng.choice(["password", "horse", "B4ttery", "qwerty", "zxcvbnm", "2024-05-17", "1999", "abcdefgh", "poiuytrewq", "qwqwqwqwqw"]),
        lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))),
        lambda: "".join(rng.choice("ab1Z/") for _ in range(rng.randrange(1, 8))) * rng.randrange(1, 9),
        lambda: "".join(chr(rng.randrange(33, 127)) for _ in range(rng.randrange(1, 7))),
    ]
    return "".join(rng.choice(parts)() for _ in range(rng.randrange(1, 5)))


def test_below_a_limit_costs_are_the_same():
    rng, below = random.Random(1), 0
    for _ in range(3000):
        v, limit = value(rng), rng.choice([4.0, 6.5, 8.0])
        want = secrets.guess_cost(v, RANK)
        assert secrets.guess_cost(v, RANK, limit) == min(want, limit), (v, limit)
        below += want < limit
    assert below > 300


def test_long_stretches_are_one_part():
    rng = random.Random(2)
    for unit in ("a", "qw", "x1z", "0123456"):
        for head, tail in (("1999", "horse"), ("zz", "!")):
            times = (2150 + rng.randrange(400)) // len(unit)
            v = head + unit * times + unit[: rng.randrange(len(unit))] + tail
            whole = secrets.guess_cost(v, RANK)
            assert abs(secrets.guess_cost(v, RANK, 8.0) - min(whole, 8.0)) < 1e-9, (unit, head, tail, times)


def test_a_megabyte_takes_under_a_second():
    rng, n = random.Random(3), 1 << 20
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for v in ("a" * n, "ab" * (n // 2), "".join(rng.choices("ab", k=n)), "".join(rng.choices(letters, k=n)), "a" * (n // 2) + "b" * (n // 2), ("x1" * 500 + "Qz#") * (n // 1003)):
        began = time.process_time()
        cost = secrets.guess_cost(v, RANK, secrets.STRONG)
        assert time.process_time() - began < 1, (v[:20], time.process_time() - began)
        assert cost <= secrets.STRONG
    assert secrets.guess_cost("a" * n, RANK, 8.0) < 8.0 < secrets.guess_cost("".join(rng.choices(letters, k=100)), RANK)
