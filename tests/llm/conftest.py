import os
import subprocess
import sys

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp long, size long, _text string"

#: Nulls in every column, empty and white texts, repeated rows, ties, a long text, names that operators use inside.
ODD = [
    (None, None, None, None, None, None, None, None, None),
    (1, None, "en", None, None, "x", 1, 2, "k"),
    (2, "", "en", "a", 0, "x", 1, 2, "k"),
    (3, " \t\n\x0b\f\r ", "en", "a", 7, None, None, 2, "k"),
    (4, "one", "en", "b", 3, "x", 1, 2, "k"),
    (5, "The same text as another, twice over.\nline two\n", "en", "b", 9, "x", 1, 2, "k"),
    (5, "The same text as another, twice over.\nline two\n", "en", "b", 9, "x", 1, 2, "k"),
    (6, "The same text as another, twice over.\nline two\n", "en", "b", 9, "x", 1, 2, "k"),
    (None, "no id but words and é 漢字 🎉 here", "fr", "c", 9, "x", 1, 2, "k"),
    (7, "long words " * 30000, "en", "b", 9, "x", 1, 2, "k"),
    (8, "x" * 100000, "en", "c", 9, "x", 1, 2, "k"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()
    return [(r.doc_id, r.text, r.source) for r in rows]


@pytest.fixture(scope="session")
def in_bounded_memory():
    """Runs Python code that prints what it finds, in a process of its own; gives the lines and the process's peak in MB."""

    def run(code):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        code += "\nimport resource\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n"
        out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=600)
        assert out.returncode == 0, out.stderr[-2000:]
        *lines, most = out.stdout.split("\n")[:-1]
        return lines, int(most)

    return run
