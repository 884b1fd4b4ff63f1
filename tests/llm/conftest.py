import pytest

#: Columns whose names operators use themselves.
CLASH = "n_words long, n_hit long, items string, key long, more long, row string, kept string, score double, kind int, part int, path string, gone_id long, component_id long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def make(spark, rows):
    """Documents with clashing extra columns, from (doc_id, text, lang)."""
    full = [(i, t, g, "s", None if t is None else len(t), *[None] * (CLASH.count(",") + 1)) for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, copies, near copies, repeated rows, passages and a long text."""
    words = [f"word{k * 7919 % 977}x" for k in range(400)]
    base = " ".join(words[:120])
    near = " ".join([*words[:60], "changed", *words[61:120]])
    passage = " ".join(words[200:240])
    rows = [(1, base, "en"), (2, base, "en"), (3, near, "en"), (4, None, "en"), (5, "", None), (6, "   \n\t ", "fr"), (7, "ab", "fr"), (8, "!!! ...", None), (9, f"own start {passage} own end", "de"), (10, f"quite other {passage} finish", "de")]
    rows += [(11, "Ünïcode Straße ÉÀ 漢字 it's 12.5 <|endoftext|> x", "de"), (12, "x" * 300, None), (12, "x" * 300, None), (None, base, "en"), (None, None, None), (13, " ".join(words * 40), "es"), (14, "<|startoftext|>don't İstanbul", "en")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return make(spark, odd_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])
