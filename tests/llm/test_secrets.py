"""The randomness battery, its p-values and the false-discovery step."""

from __future__ import annotations

import math
import random
import string

import numpy as np
import pytest

from pathloom.llm import secrets

DOC = "doc_id long, text string"
ALPHABETS = {"letters": string.ascii_letters, "lower": string.ascii_lowercase, "mixed": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
WRITTEN = [
    "some_long_function_name_for_tests", "usr/local/lib/python3/site-packages", "AbstractSingletonProxyFactoryBean", "2024-01-15T10-30-00-2024-02-17", "0123456789012345678901234567890123456789",
    "itwasthebestoftimesitwastheworstoftimes", "donaudampfschifffahrtsgesellschaft", "------------------------------------", "the-cat-and-the-hat-and-the-house", "4929123412341234492912341234123449291234",
    "Internationalization/Localization", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "MAX_NUMBER_OF_CONNECTIONS_PER_HOST", "abcabcabcabcabcabcabcabcabcabcabcabc",
]


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_strings_pass_the_battery_and_are_unlike_writing(name):
    rng = random.Random(1)
    keys = ["".join(rng.choice(ALPHABETS[name]) for _ in range(40)) for _ in range(400)]
    assert sum(secrets.randomness(k) >= secrets.ALPHA for k in keys) >= 390
    assert np.mean([secrets.level(k) >= 10 for k in keys]) > (0.9 if name == "lower" else 0.97)


@pytest.mark.parametrize("token", WRITTEN)
def test_writing_has_no_level(token):
    assert secrets.level(token) < 8


def brute_battery(token):
    """The three tests from their textbook formulas."""
    alphabet = next(a for a in secrets.ENCODINGS if set(token) <= set(a))
    x, n, k = [alphabet.index(c) for c in token], len(token), len(alphabet)
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    uniform = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [v >= k / 2 for v in x]
    up, down = high.count(True), high.count(False)
    mean = 1 + 2 * up * down / n
    runs = 1 + sum(high[i] != high[i + 1] for i in range(n - 1))
    even = 2 * tail(abs(runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)))
    m = np.mean(x)
    serial = sum((x[i] - m) * (x[i + 1] - m) for i in range(n - 1)) / sum((v - m) ** 2 for v in x)
    apart = 2 * tail(abs(serial + 1 / n) * math.sqrt(n))
    half = -math.log(uniform * even * apart)
    return math.exp(-half) * (1 + half + half**2 / 2)


def test_battery_equals_its_formulas():
    rng = random.Random(2)
    for name in ALPHABETS:
        for _ in range(30):
            token = "".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randrange(24, 90)))
            assert secrets.randomness(token) == pytest.approx(brute_battery(token))


def test_thresholds_equal_benjamini_hochberg():
    rng = random.Random(3)
    for _ in range(50):
        levels = [rng.choice([0, 0, 0, rng.randrange(40)]) for _ in range(rng.randrange(1, 80))]
        p = sorted(2.0**-v for v in levels)
        passed = [x for i, x in enumerate(p, 1) if x <= 0.01 * i / len(p)]
        want = {v for v in levels if passed and 2.0**-v <= max(passed)}
        got = secrets.thresholds([(2, v, levels.count(v)) for v in set(levels)], 0.01)
        assert {v for v in levels if v >= got[2]} == want and got[0] == secrets.LEVELS


@pytest.mark.parametrize("more", [0, 6, 2000])
def test_the_verdict_does_not_depend_on_the_size_of_the_corpus(spark, more):
    rng = random.Random(5)
    keys = ["".join(rng.choice(ALPHABETS[a]) for _ in range(40)) for a in ("mixed", "letters", "base64", "base32")]
    written = [w for w in WRITTEN if not secrets.base_spans(w)]  # long digits are what the pattern for hex takes
    texts = [f"see {k} and {w}" for k, w in zip(keys, WRITTEN)] + [f"as {w} was" for w in written * (more // 10)] + ["plain words"] * more
    rows = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r.doc_id: r.text for r in secrets.masked(rows).collect()}
    assert all(got[i] == f"see <RANDOM> and {w}" for i, w in enumerate(WRITTEN[:4]))
    assert all(got[i] == texts[i] for i in range(4, len(texts)))
