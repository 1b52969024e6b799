import pytest


@pytest.fixture(scope="session")
def documents():
    """Rows (doc_id, text, lang, source, n_chars) with what the operators must bear."""

    def build(spark, texts, **more):
        rows = []
        for i, t in enumerate(texts):
            text = t[1] if isinstance(t, tuple) else t
            doc_id = t[0] if isinstance(t, tuple) else i
            source = t[2] if isinstance(t, tuple) and len(t) > 2 else "s"
            rows.append((doc_id, text, "en", source, len(text or "")))
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return build
