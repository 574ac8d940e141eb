import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "kept string, made int, fp double, root string, text_hash string, leaks int, row string, n_tokens string, `odd name` string"
)
WORDS = "the river runs under an old bridge and the town behind it sleeps while boats move slowly, one by one, to the sea.".split()


def prose(words, shift=0):
    return " ".join(WORDS[(i * 7 + i // 3 + shift) % len(WORDS)] for i in range(words)) + "."


# null, empty and blank texts, no id, repeated rows, equal ids, a very long text, other scripts, marks and controls
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\x0c\r "),
    (4, prose(60)),
    (4, prose(60)),
    (4, prose(60)),
    (4, prose(80, 5)),
    (None, prose(60)),
    (None, None),
    (None, "no id and  two blanks"),
    (5, prose(60_000)),
    (6, "x" * 50_000),
    (7, "日本語のテキスト。 Ελληνικά κείμενο и русский текст 🙂 \x00\x01 a\u0301 ﬁ İ ß Σς"),
    (8, "<|endoftext|> and <|startoftext|>  it's\u00a0odd\u2003blank\n\n\nlines \r\n end "),
    (9, "'s 't a'll B'D 12345 #*$%&|<> !!! ... \\ \" ' ` ~"),
    (-10, prose(60)),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd rows with extra columns whose names operators use inside."""
    rows = [(i, t, None, "s", 0, "k", 1, 0.5, "r", "h", 2, "w", "n", "o") for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts_table(spark):
    def make(texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    return make
