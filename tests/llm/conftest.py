import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


#: Nulls, empty and long texts, repeated rows and ids, ties; columns that clash with internal names.
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one two three four five six seven eight nine ten " * 900), (5, "word"), (5, "word"), (5, "other"), (None, "no id here"), (None, None), (6, "x" * 70_000), (7, "A b@c.de +1 (017) 555-7713 1.2.3.4 ü日🎉")]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None, 0, 1, "k", 2.0) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, p int, h string, _w double")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
