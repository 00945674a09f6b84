import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SAMPLES = os.path.join(ROOT, "tests", "samples")


@pytest.fixture(scope="session")
def spark():
    from codeweave.session import get_spark
    s = get_spark(cpus=os.environ.get("TEST_CPUS", "*"), shuffle_partitions=8, app="codeweave-tests")
    yield s


@pytest.fixture(scope="session")
def sample_index(spark):
    """Index of the four sample sources (plus an excluded and a broken file)."""
    from codeweave.operators.tables import build_index
    rows = [("demo", "app/" + f, open(os.path.join(SAMPLES, f)).read())
            for f in sorted(os.listdir(SAMPLES))]
    rows += [("demo", "node_modules/x/skip.js", "function skipped() {}"),
             ("demo", "app/readme.md", "# not code"),
             ("demo", "app/broken.py", "def oops(:\n"),
             ("demo", "top.py", "import os\n")]
    corpus = spark.createDataFrame(rows, "repo string, path string, content string")
    return build_index(corpus, persist=True)


def rows_of(df, *cols, **where):
    for k, v in where.items():
        df = df.where(df[k] == v)
    return [tuple(r[c] for c in cols) for r in df.collect()]
