"""Every operator on a table of nulls, empties, repeats, a very long text and columns with clashing names."""

import pytest

from harborline.llm.decontaminate import contaminated, decontaminate
from harborline.llm.katz import lm_scores
from harborline.llm.pieces import sampled
from harborline.llm.pii import pii, pseudonymised
from harborline.llm.quality import keep_good, quality
from harborline.llm.rules import quality_rules
from harborline.llm.simhash import near_duplicates
from harborline.llm.substrings import substring_dedup
from harborline.llm.toxicity import toxicity
from harborline.llm.urls import url_filter
from harborline.llm.wide import one_of_each

LONG = "many words and more " * 20000
ROWS = [(None, None, None, None, None), (None, "a text without an id", "en", None, 1), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, LONG, "en", "s", 5), (3, LONG, "en", "s", 5), (4, "Ümlaut \U0001f600 ▁ tab\tnew\nline", "de", "s", 9), (5, "x", "en", "s", 1)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("_doc", "_h", "_key", "_n", "_score", "_found", "score", "label", "h", "fp", "row", "key", "kept", "n_words", "template", "marks", "held_out"):
        docs = docs.withColumn(extra, docs.n_chars)
    labels = spark.createDataFrame([(None, None, None), (3, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, None), (1, LONG[:400]), (1, LONG[:400]), (2, "")], "item_id long, text string")
    return docs, labels, items


@pytest.mark.parametrize(
    "run",
    [
        lambda d, n, b: toxicity(d, n), lambda d, n, b: near_duplicates(d), lambda d, n, b: lm_scores(d), lambda d, n, b: quality_rules(d), lambda d, n, b: quality(d, n),
        lambda d, n, b: substring_dedup(d), lambda d, n, b: pii(d, "k"), lambda d, n, b: sampled(d, k=1), lambda d, n, b: url_filter(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"})),
    ],
)
def test_a_row_for_every_row(tables, run):
    assert len(run(*tables).collect()) == len(ROWS)


def test_filters_keep_columns(tables):
    docs, labels, items = tables
    assert {r.doc_id for r in contaminated(docs, items).collect()} == {3}
    assert decontaminate(docs, items).count() == len(ROWS) - 2
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 3, 4, 5} and kept.count() == 5
    assert keep_good(docs, labels).columns == docs.columns and pseudonymised(docs, "k").drop("_n_pii").columns == docs.columns
