import os
import sys
from pathlib import Path

# small products gain nothing from many threads; before numpy is loaded
for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(name, "1")

import pytest  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parent))

@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and blank and very long texts, repeated rows, ties,
    and columns whose names the operators use themselves."""
    words = [f"w{i}" for i in range(40)]
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "b"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "b"),
        (3, None, "en", "a"),
        (4, "", "de", None),
        (5, " \t\n ", None, "b"),
        (None, "rows without an id stay rows", "en", "c"),
        (6, "one", "en", "c"),
        (7, " ".join(words * 3000), "en", "d"),
        (8, "12 345 !!! 67", None, "a"),
        (9, "K Å İ ſ Ünï\x0bcode\xa0text ''s <|endoftext|> \U0001f600 done", "fr", "a"),
        (9, "same id but another text", "fr", "a"),
    ]
    extra = [(*r, 10 * k, "x", 0.5, k, k, "y") for k, r in enumerate(rows)]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, word string, score double, size long, row long, kept_id string"
    )

@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
