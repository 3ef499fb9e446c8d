"""Queries against their SQL on small tables of letters and texts that the given ones lack."""

import duckdb
import pytest
from tests.conftest import same_rows

from quillspark import plans


def twin(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables of (columns, rows)."""
    con = duckdb.connect()
    for t, (columns, rows) in tables.items():
        path = f"{folder}/{t}.parquet"
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(path)
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    return same_rows(plans.QUERIES[name](spark, str(folder)), con.sql(plans.ORACLE_SQL[name]))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
KNOWN = "straße weißer Strasse heißt ster щука ሴት"
TYPED = "strase stßraße wießer weiser heit heißßt stßer щка щуко щкуа ሴ ቈት strade"
LETTERS = (DOCUMENTS, [(i, KNOWN, "en", "a", 0) for i in range(3)] + [(3, TYPED, "en", "a", 0)])
ITEMS = ("item_id long, text string", [(i, w) for i, w in enumerate(TYPED.split())])


@pytest.mark.parametrize("name", ["one_edit_candidates", "scan1_soundslike", "pipe_report"])
def test_letters_of_several_bytes(spark, tmp_path, name):
    ours, theirs = twin(spark, tmp_path, name, documents=LETTERS, benchmark=ITEMS)
    assert ours == theirs and ours


TEXTS = [None, "", "\n", "\nOnne ti.", "3.\nOf the", "3. Of the\nand 4.", "Onne\n4) ti\n12. and\nof &&& it", "Of.\n\n7. The\n\n8. or", "2) an\n   3. is", "Ha\n \nit 3.", "+1 (219) 555\n69.1.2.3 the"]


def test_markdown_of_numbers_and_empty_lines(spark, tmp_path):
    ours, theirs = twin(spark, tmp_path, "markdown_filter", documents=(DOCUMENTS, [(i, t, "en", "a", 0) for i, t in enumerate(TEXTS)]))
    assert ours == theirs and len(ours) == len(TEXTS)
