import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """Documents of all awkward kinds, with a column whose name clashes with results."""
    long = " ".join(f"w{i}x" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while many other animals look on from the old wooden fence by the river"
    data = [
        (1, base), (2, base), (3, base.replace("river", "rivers")), (4, None), (5, ""), (6, "   \n\t "), (7, "one two"), (8, "One TWO"), (9, long), (10, long + " tail"),
        (11, "x" * 70_000), (12, "mail jo@ex.org or +1 (555) 555-1234 now, host 10.0.0.255, card 4111 1111 1111 1111."), (13, "日本語 😀 é" * 50), (14, base), (14, base), (15, " " * 5000),
        (16, "it's <|endoftext|> here's we'll<|im_end|>"), (None, "no id at all here to see"),
    ]
    return spark.createDataFrame([(i, t, "src", 0.5, 7) for i, t in data], "doc_id long, text string, source string, score double, component_id int")
