"""Fixtures of the operators on documents."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=0, n=60):
    """Random documents with copies, near copies, repeated passages, empty and null texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7))) for _ in range(200)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage = text(40)
    rows = []
    for k in range(n):
        kind = rnd.randrange(8)
        if kind == 0 and rows:
            t = rnd.choice(rows)[1]
        elif kind == 1 and rows and rows[-1][1]:
            words = rows[-1][1].split()
            t = " ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 :])
        elif kind == 2:
            t = text(rnd.randint(5, 40)) + "\n" + passage + " " + text(rnd.randint(1, 30))
        elif kind == 3:
            t = rnd.choice(["", None, " ", "a", "Of " * 120, "\t\n", "x" * 400])
        else:
            t = text(rnd.randint(1, 120))
        rows.append((k, t, "en", "s", len(t or "")))
    return rows


#: Rows that an operator must not stumble over.
ODD = [
    (None, "some words without an id that are long enough to count here", None, None, None),
    (7, None, None, None, None),
    (7, "", "", "", 0),
    (7, "the same row twice", "en", "s", 18),
    (7, "the same row twice", "en", "s", 18),
    (-3, "\x00\x1f odd \ufffd bytes \U0001f600 and\u00a0spaces", "en", "s", 1),
    (2**62, "word " * 20000, "en", "s", 100000),
]
