import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from temblor.session import build_session, share_code  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", partitions=4, memory="4g")
    share_code(session)
    yield session


@pytest.fixture
def docs(spark):
    """A frame of documents from texts, or from (id, text) pairs."""
    def make(texts):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(k, t, "en", "src1", None if t is None else len(t)) for k, t in rows], DOCS)
    return make


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with the given frames as tables."""
    def write(**frames):
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write
