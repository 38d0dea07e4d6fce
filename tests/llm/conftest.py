import pytest

#: Texts that every operator must handle.
TEXTS = [
    None, "", " ", "one", "one two", "One TWO", " lead", "trail ", "two  spaces", "a\n\n\nb", "a\tb\x0bc", "tab\t\tand   more",
    "x" * 5000, "word " * 30_000, "ÄÖÜ straße İstanbul ΑΣ. é é", "don't I'LL we've 123 4٣5 ½ x²", "日本語 テキスト 🙂🙂",
    "<|endoftext|>", "a <|endoftext|> b<|startoftext|>", "a <|ENDOFTEXT|> b", "a b　c\x85d", "\x1c\x1d x\x00y", "...!!!???",
    "idiot", "THE same line\nTHE same line\nanother | line\n### *** %%%", "one two", "one two",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Every odd text, with null and repeated ids, whole rows repeated, and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, 7, "x", 1.5) for i, t in enumerate(TEXTS)]
    rows += [(None, "a text without an id", None, None, 7, "x", 1.5), (None, None, None, None, None, None, None), rows[3], rows[3], (3, "same id, other text", "en", "src1", 7, "x", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, _row string, score double").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def stored_docs(spark, odd_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    odd_docs.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
