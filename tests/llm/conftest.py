import random

import pytest

LONG_WORD = "x" * 30_000
LONG_TEXT = " ".join(f"w{i % 977}" for i in range(20_000))
#: Nulls in any column, empty and long texts, ties, repeated rows, other scripts, control strings.
AWKWARD = [
    (1, "the cat sat on the mat and the cat sat on the mat again today", "en", "a"),
    (1, "the cat sat on the mat and the cat sat on the mat again today", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \n\t ", "de", "b"),
    (5, LONG_WORD, "de", "b"),
    (6, LONG_TEXT, "en", "b"),
    (7, "one", "fr", None),
    (8, "It's   odd:  don't\n\nyou  think? 中文字 été ÀÉ <|endoftext|> \x1c\x85 x", "fr", "c"),
    (None, "a row without an id has words as well you know it does", "en", "c"),
    (9, "The Cat sat ON the mat and the cat sat on the mat again today", "en", "c"),
    (10, "This work is licensed under the GNU General Public License, version 3. And more text follows here", "en", "a"),
    (11, "😀 emoji ﬁ ligature İ dotted ſ long", "tr", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size double, k0 int, digest string"


@pytest.fixture(scope="session")
def awkward(spark):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1.5, 7, "y") for r in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def near_copies(spark):
    """Chains, stars and many short texts with small changes."""
    r = random.Random(5)
    docs, n = [], 0
    for size in (6, 12, 40, 150):
        for _ in range(6):
            base = [f"v{r.randrange(400)}" for _ in range(size)]
            for _ in range(12):
                words = list(base)
                for _ in range(r.randrange(0, 1 + size // 12)):
                    words[r.randrange(size)] = f"n{r.randrange(10**6)}"
                docs.append((n, " ".join(words), "en", "s", 0, "", 0.0, 0, ""))
                n += 1
                if r.random() < 0.3:
                    base = words
    return spark.createDataFrame(docs, SCHEMA).repartition(4)
