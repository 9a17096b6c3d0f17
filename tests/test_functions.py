"""Column expressions on texts that are easy to get wrong."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import clean as c
from riskloom.functions import numeric as nm
from riskloom.functions import text as tx
from riskloom.operators import patches as pt
from riskloom.sources import readers as rd


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", expression.alias("v")).orderBy("i").collect()]


def test_dates_of_several_formats(spark):
    got = values(spark, ["2024-02-03T04:05:06Z", "2024-02-03T04:05:06+02:00", " 20240203 ", "2024/02/03", "2024-13-03", "soon", None], c.lenient_timestamp("t"))
    assert got == [
        dt.datetime(2024, 2, 3, 4, 5, 6), dt.datetime(2024, 2, 3, 2, 5, 6), dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 3), None, None, None
    ]


def test_times_as_feeds_write_them(spark):
    texts = ["2022-04-13T03:04:37.331327Z", "2024-01-01 10:00:00+09:00", "2024-01-01T10:00:00", "2024-01-01T10:00:00+0900", "2024-01-01 10:00", "2024-01-01T10:00:00.5-02", "n/a", "", "2024-01-01T25:00:00Z"]
    want = [dt.datetime(2022, 4, 13, 3, 4, 37, 331327), dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 12, 0, 0, 500000), None, None, None]
    assert values(spark, texts, c.lenient_timestamp("t")) == want
    assert values(spark, texts, c.instant("t")) == want
    assert values(spark, ["n/a", "2024-01-01T23:30:00-02:00"], c.utc_iso_text("t")) == [None, "2024-01-02T01:30:00+00:00"]
    assert values(spark, ["n/a", "2024-01-01T23:30:00-02:00"], c.utc_day("t")) == [None, dt.date(2024, 1, 2)]
    assert values(spark, ["n/a", "2.5", "nan", "-1"], nm.first_positive(["t", F.lit("x"), F.lit(7)])) == [7.0, 2.5, 7.0, 7.0]
    assert values(spark, ["n/a", "2", "-1"], nm.scaled_duration("t", F.lit("?"))) == [None, 2.0, None]
    assert values(spark, ["n/a", "2024-01-02T01:00:00+01:00"], nm.whole_days_between(F.lit("2024-01-01"), "t")) == [None, 1]


def test_day_text_falls_back_to_the_leading_part(spark):
    texts = ["2024-02-03T04:05:06Z", "2024-02-03T01:00:00+05:00", "2024-02-03 or so", "2024-2-3", "02/03/2024", None]
    assert values(spark, texts, c.day_text("t")) == ["2024-02-03"] * 4 + ["", ""]


def test_lists(spark):
    assert values(spark, ["a; b,c d", "", None, "0;1;2"], tx.split_list("t")) == [["a", "b", "c", "d"], [], [], ["0", "1", "2"]]
    assert values(spark, ["['a.c', 'b.h']", "a.c;b.h", "[bad", None], tx.parse_list("t")) == [["a.c", "b.h"], ["a.c", "b.h"], [], []]


def test_repository_addresses(spark):
    urls = ["git@Host.org:Own/Lib.git", "http://host.org/own/lib/", "host"]
    assert values(spark, urls, tx.repo_key(tx.https_url("t"))) == ["https://host.org/own/lib", "https://host.org/own/lib", "host"]
    assert values(spark, urls, tx.owner_and_name("t")) == ["own/lib", "own/lib", ""]


def test_repair_words_match_inside_words(spark):
    assert values(spark, ["Prefix added", "new feature"], tx.is_repair_message("t")) == [1, 0]


def test_added_lines_follow_hunk_marks(spark):
    patch = "@@ -1,3 +10,4 @@ f\n a\n-b\n+  c \n+d\n@@ -9 +30 @@\n+e\n\\ No newline"
    df = spark.createDataFrame([(1, patch)], "id int, patch string")
    got = {(r.line_no, r.content) for r in pt.added_lines(df, ["id"], "patch").collect()}
    assert got == {(11, "c"), (12, "d"), (30, "e")}


def test_code_indicators_count_changed_lines_only(spark):
    patch = "--- a/x.c\n+++ b/x.c\n@@ -1 +1 @@\n+if (a == b) {\n+  x = y = sizeof(int);\n- for (;;) break;\n goto out;"
    r = pt.code_indicators(spark.createDataFrame([(1, patch)], "id int, patch string"), ["id"], "patch").first()
    assert (r.f6_added_if, r.s1_added_sizeof, r.s8_removed_break, r.f3_removed_loop, r.s11_added_goto) == (1, 1, 1, 1, 0)
    assert (r.f22_added_assignment, r.f10_added_line, r.f11_removed_line, r.f1_sum_file) == (2, 2, 1, 2)


def test_code_patch_headers(spark):
    rows = [(1, [("a.c", "b.c", "renamed", "+x\n"), (None, "n.h", "new", None), ("gone.cc", None, "deleted", "-y"), ("doc.md", "doc.md", "modified", "+z")])]
    df = spark.createDataFrame(rows, "id int, d array<struct<a_path:string,b_path:string,kind:string,diff:string>>")
    text = df.select(pt.code_patch("d").alias("t")).first().t
    assert text == "--- a/a.c\n+++ b/b.c\n+x\n--- a//dev/null\n+++ b/n.h\n--- a/gone.cc\n+++ b//dev/null\n-y"


def test_report_lines_scale_counts_and_keep_the_first_row(spark):
    def row(no, count, code):
        return f"<tr><td class='line-number'><a><pre>{no}</pre></a></td><td class='covered-line'><pre>{count}</pre></td><td class='code'><pre> {code}</pre></td></tr>"

    html = "<table><tr><td>x</td></tr>" + row(1, "1.5k", "a &lt; b &amp;amp; c") + row(2, "2M", "<span>d</span>") + row(2, "9", "late") + row(3, "", "e") + "</table>"
    got = rd.report_lines(spark.createDataFrame([(1, html)], "id int, html string"), ["id"], "html").orderBy("line_no").collect()
    assert [(r.line_no, r.content, r.execute) for r in got] == [(1, "a < b &amp; c", 1500), (2, "d", 2000000), (3, "e", None)]


def test_config_texts(spark):
    text = "language: c # note\nlanguage: rust\nmain_repo: 'https://x.org/a: b'\nbroken line\n"
    df = spark.createDataFrame([("p", text), ("q", "nothing here")], "project string, t string")
    got = {r.project: (r.language, r.main_repo, r.rate, r.missing) for r in rd.parse_config(df, ["project"], "t", ["language", "main_repo"], ["rate"]).collect()}
    assert got == {"p": ("c", "https://x.org/a: b", None, ""), "q": (None, None, None, "language,main_repo")}


def test_open_and_swapped_date_ranges(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-10')) AS day")
    a, b = F.lit("2024-01-08").cast("date"), F.lit("2024-01-03").cast("date")
    assert [days.filter(c.within_open_ended("day", *ends)).count() for ends in ((a, b), (b, a), (None, b), (a, None), (None, None))] == [6, 6, 3, 3, 10]
