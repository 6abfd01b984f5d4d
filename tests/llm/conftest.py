import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    words = [f"w{i % 997}" for i in range(30_000)]
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "one", None), (4, "  \n\t ", "de"), (5, "a b c d e", "de"), (5, "a b c d e", "de"),
        (6, " ".join(words), "fr"), (7, "x" * 50_000, "fr"), (8, "the cat sat " * 40, "en"), (9, "Ünïcode ñ 漢字 🎉 " * 10, "es"),
        (None, "no id at all here", "en"), (10, "<|endoftext|> 3 < 4 & 'll it's\r\n\u0085  x", "en"),
    ]
    return spark.createDataFrame([(a, b, c, "s", 0, 9, "clash", 0) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, rank int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
