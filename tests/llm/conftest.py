import os

import duckdb
import pytest
from llm_helpers import SF


@pytest.fixture(scope="session")
def corpus():
    """``doc_id``, ``text``, ``lang`` of the smallest documents, as Python rows."""
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Documents with NULLs, empty and very long texts, ties, repeats, and columns that clash with the operators' own."""
    texts = [t for _, t, _ in corpus[:30]]
    long = " ".join(texts) * 12
    rows = [(i, t, "en" if i % 2 else "fr", "p") for i, t in enumerate(texts)]
    rows += [(None, None, None, None), (None, texts[0], "fr", "p"), (100, "", "en", None), (101, None, "en", "p"), (102, long, "en", "p"), (102, long, "en", "p"), (103, "...", None, "p"), (104, "日本語の文章 🙂 İstanbul ΑΣ", "ja", "p")]
    rows += [(105, "a" * 40000, "en", "p"), (106, "token = \"0123456789abcdef0123456789abcdef01234567\"", "en", "p")]
    extra = "fingerprint string, lang_pred int, score string, n_bytes int, spans int, removed int, __fp int, probability int"
    full = [(*r, "x", 1, "y", 2, 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, {extra}")


assert os.path.isdir(SF)
