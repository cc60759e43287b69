"""Words of a line, however they are parted."""

from ledgerloom.llm import line_dedup


def deduped(spark, rows, **how):
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}


def test_tabs_part_words_and_indents_do_not(spark):
    table = "\t".join(f"cell{i}" for i in range(60))
    code = "       return x"
    rows = [(1, table + "\n" + code), (2, "own line\n" + table), (3, "other line\n" + code), (4, "a  b  c  d  e"), (5, "a  b  c  d  e")]
    assert deduped(spark, rows) == {1: rows[0][1], 2: "own line", 3: rows[2][1], 4: rows[3][1], 5: rows[4][1]}


def test_a_long_line_counts_up_to_the_least_number_asked_for(spark):
    line = " ".join(f"w{i}" for i in range(60))
    short = " ".join(f"v{i}" for i in range(20))
    rows = [(1, line + "\nx\n" + short), (2, line + "\ny\n" + short)]
    assert deduped(spark, rows, min_words=50) == {1: rows[0][1], 2: "y\n" + short}
