import pytest

#: Columns named like helper columns of the operators.
CLASHING = ("_n_removed", "_copy", "_gone", "_Gone_doc", "_kept", "_bad", "_doc", "_left", "_number", "_key", "_deal", "_hits", "_items")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, short and long texts, repeated rows and clashing column names."""
    long = "\n".join(f"wort{i} und noch ein satz mit nummer {i} am ende der zeile" for i in range(3000))
    rows = [
        (1, "the cat sat on the mat and then it left the house for a walk in the park near by", "en", "s", 1, 7),
        (2, None, "en", "s", None, None),
        (3, "", None, None, 0, 1),
        (4, "   \n\t ", "fr", "s", 5, 1),
        (5, "le chat est sur la table et le chien dort dans la rue pendant la nuit", "fr", "s", 5, 1),
        (5, "le chat est sur la table et le chien dort dans la rue pendant la nuit", "fr", "s", 5, 1),
        (6, "12345 67890", "en", "s", 3, 2),
        (7, long, "de", "s", len(long), 1),
        (8, long, "de", "s", len(long), 1),
        (None, "the cat sat on the mat and then it left the house for a walk in the park near by", "en", None, 3, 1),
        (9, "one", "en", "s", 3, 1),
        (10, "Ünïcode ﷽ 漢字 \U0001f600 end", None, "s", 3, 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `score` long").repartition(3).selectExpr("*", *[f"doc_id as `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
