import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts that every text operator has to get through."""
    return [None, "", " ", "\n", "\n\n a \n", "one", "One ONE one", "two words", "a b c d e f g", "a b c d e f g",
            "é ñ ß İ ſ \U0001f600", "tab\tvt\x0bff\x0ccr\r\nnl nbsp ls", "x" * 5000, "y " * 5000,
            "long words and more of them " * 4000, "▁ piece marker ▁▁", "<s> </s> <unk> <0x0A>", "0 1 2 3", "!!!"]


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """Such texts with null and repeated ids, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s", "", None][i % 3], None, "x", i, "y") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (5, "other text", "en", "s", 1, None, None, None),
             (None, "no id", "en", "s", 5, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score string, mk_id long, bucket string")
