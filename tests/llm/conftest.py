import pytest

#: A small corpus with nulls, empty and blank texts, ties, repeated rows and clashing extra columns.
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs away"),
    (1, None),
    (2, ""),
    (3, "  \t \n "),
    (4, "one"),
    (5, "Ünïcode wörds ß and  double  blanks\nnew line\n\nend "),
    (6, "The quick brown fox jumps over the lazy dog and runs away"),
    (6, "The quick brown fox jumps over the lazy dog and runs away"),
    (7, "word " * 3000),
    (None, "no id here"),
    (8, "x" * 5000),
    (9, "I'll say it's 100% <b>fine</b>… 'tis #1 \u0085 odd space"),
]


@pytest.fixture
def corpus(spark):
    rows = [(d, t, "en", "src0", None if t is None else len(t), "own", 1) for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, w string, line int")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
