import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, an empty text, copies, near copies, repeated rows, a long word and a long text."""
    base = " ".join(f"word{i} other{i * 7 % 31}" for i in range(60))
    near = base.replace("word30", "changed")
    rows = [
        (1, base, "en", "src0", 1), (2, near, "en", "src1", 2), (3, base, None, None, None), (4, "", "en", "src2", 0), (5, None, "en", "src2", None), (6, "a b", "fr", "src3", 3),
        (6, "a b", "fr", "src3", 3), (7, "x" * 3000, "en", "src0", 3000), (8, "Straße <|endoftext|> İ ﬁ é 你好 !!\nline\nline\n\n " + base, "de", "src9", 9),
        (None, "nobody owns this text at all, it has no key of its own", "en", "zzz", 5), (9, " ".join(f"t{i % 997}" for i in range(4000)), "en", "src4", 7), (10, " \t\n ", "en", "src4", 4),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
