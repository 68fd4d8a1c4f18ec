import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, n_lines long, _doc string, `_guess` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty, blank and long texts, repeated rows, odd white space, clashing columns."""
    long = " ".join(f"wort{i}" for i in range(12_000))
    line = "a line that is long enough to be counted as one"
    texts = [None, "", " ", "x", "...", "hola mundo", "Straße  über\talles\nund weiter", long, long + " mehr", line, f"{line}\nown {1}", f" {line.upper()} ", f"{line}\n{line}", f"{line}\nb", f"{line}\nc"]
    rows = [(i, t, "es" if i % 2 else None, None, None, "clash", 7, "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[5], rows[9], (None, "null id text here", "es", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def bpe():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
