"""Operator 5 against a plain version in Python."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality, queries

from .helpers import ODD, SF, clashing, documents, empty, frame, odd


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def plain(rows, least, share, keep_share):
    """(figures, kept) of each (doc_id, text, host), by sets of texts and lines, without hashes."""
    norm = lambda x: re.sub("[0-9]", "0", " ".join(re.findall(r"[^\x20\x09-\x0D]+", x.lower())))
    lines = [[x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for _, t, _ in rows]
    docs, hosts = defaultdict(set), defaultdict(set)
    for ls, (_, t, host) in zip(lines, rows, strict=True):
        hosts[host or ""].add(t or "")
        for x in ls:
            docs[host or "", norm(x)].add(t or "")
    out = []
    for ls, (i, t, host) in zip(lines, rows, strict=True):
        *figures, failed = base(t)
        gone = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in ls if len(docs[host or "", norm(x)]) > max(least, share * len(hosts[host or ""])))
        out.append((repr(i), *figures, failed, not failed and figures[0] - gone >= keep_share * figures[0], gone))
    return sorted(out)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]


def got(df):
    return sorted((repr(r.doc_id), *(r[c] for c in COLUMNS[1:])) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize(("least", "share"), [(20, 0.002), (2, 0.0), (1, 0.2)])
def test_small_table(spark, least, share):
    docs = documents(spark)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert got(quality.judge(docs, least=least, share=share)) == plain(rows, least, share, 0.25)


@pytest.mark.parametrize("text", ["a b c d e f g h " * 3, "x " * 40, "a\x1cb\x85c d", "one two three four five six seven eight nine one two three four five six seven eight", "", None, "#*$ %&| <>", "a\nb\n a\na\n\n\n", "é" * 9])
def test_figures(text):
    n, chars, symbols, dup, repeat, *_ = quality.figures(text or "")
    assert (n, chars, symbols, dup, repeat) == base(text)[:5]


def test_frequent_lines_leave(spark):
    """A footer in many documents goes; copies of one document keep their lines; a document of footers alone is rejected."""
    own = lambda i: "\n".join(" ".join(f"{w}{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}{c}" for c in "klmnopqrst") for w in ("first", "second", "third"))
    footer = "Read our newsletter every day and tell your friends about this site, 2024"
    rows = [(i, own(i) + "\n" + footer.replace("2024", str(2000 + i)), "en", "h", 0) for i in range(40)]
    rows += [(100 + i, own(77), "en", "h", 0) for i in range(40)]
    rows += [(200, "\n".join([footer] * 1 + ["short tail of it"]), "en", "h", 0), (201, own(5) + "\n" + footer, "en", "other", 0)]
    docs = frame(spark, rows)
    verdicts = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(verdicts[i].kept and verdicts[i].removed_words == 13 for i in range(40))
    assert all(verdicts[100 + i].kept and not verdicts[100 + i].removed_words for i in range(40))
    assert not verdicts[200].kept and verdicts[201].kept and not verdicts[201].removed_words
    left = {r.doc_id: r.text for r in quality.apply(clashing(docs)).collect()}
    assert sorted(left) == sorted(i for i, r in verdicts.items() if r.kept)
    assert all(left[i] == own(i) for i in range(40)) and left[201] == own(5) + "\n" + footer


def test_defined_cases(spark):
    rows = [(i, t, host) for i, t, _, host, _ in ODD]
    assert got(quality.judge(clashing(odd(spark)))) == plain(rows, 20, 0.002, 0.25)
    assert quality.judge(empty(spark)).count() == 0 and quality.apply(empty(spark)).count() == 0
    long = frame(spark, [(None, " ".join(f"w{i}" for i in range(30)), "en", None, 1)] * 3)
    assert quality.apply(clashing(long)).count() == 3


def test_the_query_covers_the_table(spark):
    out = queries.op5_line_frequency(spark, SF)
    assert out.columns == COLUMNS and out.count() == documents(spark).count()


def test_pages_that_share_a_menu_are_many_documents(spark):
    """Each page has 20 menu lines and a line of its own; the menu is in all of them, whichever hashes are least."""
    menu = [f"menu entry {'abcdefghijklmnopqrst'[i]} leads somewhere" for i in range(20)]
    name = lambda i: "abcdefghij"[i // 10] + "abcdefghij"[i % 10]
    docs = frame(spark, [(i, "\n".join([*menu, f"page {name(i)} tells this"]), "en", "h", 0) for i in range(100)])
    frequent = quality.frequent_lines(quality.measure(docs)).collect()
    assert [r.n_docs for r in frequent] == [100] * 20
    assert not any(r.kept for r in quality.judge(docs).collect())


def test_documents_of_numbers_are_distinct(spark):
    """Tables that differ in digits alone are different documents that share their normalised lines."""
    docs = frame(spark, [(i, "\n".join(f"row {j} holds the number {1000 + i * 31 + j}" for j in range(8)), "en", "h", 0) for i in range(40)])
    assert not any(r.kept for r in quality.judge(docs).collect())


def test_lines_leave_by_place(spark):
    rows = [("a\nb\nc\n", [0]), ("a\nb\nc\n", [1, 2]), ("a\n\nb", [0, 2]), ("a", [0]), ("\r\na\n\n", [1])]
    want = ["b\nc\n", "a\n", "", "", "\r\n\n"]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(rows)], "i int, t string, g array<int>")
    assert [r.out for r in df.select("i", quality.without_lines(F.col("t"), F.col("g")).alias("out")).orderBy("i").collect()] == want


def test_the_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(queries.oracle_sql()["op5_line_frequency"])
    names = [d[0] for d in cursor.description]
    want = sorted((repr(row[names.index("doc_id")]), *(row[names.index(c)] for c in COLUMNS[1:])) for row in cursor.fetchall())
    assert got(queries.op5_line_frequency(spark, SF)) == want
