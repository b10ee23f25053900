import hashlib
import re

import pytest

ODD = [
    (0, None, None), (1, "", "en"), (2, " \t\n", "en"), (3, "a", None), (4, "the cat sat on the mat and then the cat ran away from the big dog", "en"),
    (5, "the cat sat on the mat and then the cat ran away from the big dog", "en"), (6, "The cat  sat on the mat and then the cat ran away from the big dog", "en"),
    (7, "éàü 日本語 🙂 \x00 x", "fr"), (8, "1234 5678 !!!", "de"), (9, "word " * 30000, "en"), (10, "x" * 120000, "de"), (5, "the cat sat on the mat and then the cat ran away from the big dog", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, a repeated row, and extra columns with awkward names."""
    rows = [(i, t, lang, "v", 1, None) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, norm string, key int, id string").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def thue_morse(size, letters="ab"):
    """Two words of this size that any polynomial modulo a power of two takes for equal, if the size is large enough."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)
