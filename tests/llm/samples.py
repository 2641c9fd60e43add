"""Small texts and an awkward table."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, id string, h int, t string, ROW string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and copies; columns with clashing names."""
    extra = (1, "x", "y", 2, "z", "w")
    out = [(i, prose(i, 30 + 7 * i), "en" if i % 3 else "de", f"s{i % 4}", 5) for i in range(1, 25)]
    out += [(30, prose(3, 51), "en", "s3", 1), (31, None, "en", "s1", 0), (32, "", None, "s2", 0), (33, " \t\n ", "en", None, 3)]
    out += [(40, "Same text here", "en", "s1", 1), (40, "Same text here", "en", "s1", 1), (41, "same TEXT here", "de", None, 1)]
    out += [(None, prose(1, 37), None, None, None), (None, None, None, None, None), (50, prose(99, 60_000), "en", "s0", 9)]
    out += [(51, "Ünï “quoted” 日本語 テキスト \U0001f600 " + prose(5, 12), "fr", "s9", 2)]
    return [(*r, *extra) for r in out]
