import hashlib
import os
from collections import defaultdict

import pytest

from tablefit.llm import skewed
from tablefit.llm.lines import drop_common_lines
from tablefit.llm.skewed import meet

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(rows, min_chars=20, min_docs=3):
    """(id, lines, dropped, text) by going over all lines."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, LOWER))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for line in lines:
            ids = holders[key(line)]
            last = max(ids, key=lambda d: (d is not None, d))
            if len(key(line)) < min_chars or len(ids) < min_docs or i == last:
                stay.append(line)
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


def test_table_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = plain(rows)
    assert found(drop_common_lines(documents)) == expected
    assert sum(r[2] for r in expected) > 0


@pytest.mark.parametrize("heavy", [1, 8, 4096])
def test_odd_lines(make_docs, monkeypatch, heavy):
    """Short and long keys, case, space, empty lines, many documents of one line."""
    monkeypatch.setattr(skewed, "HEAVY", heavy)
    common, accents = "The very same line of text", "Überall die gleiche Zeile, ÄÖÜ"
    rows = [(i, f"line of document number {i}\n  {common.upper() if i % 2 else common}\t\n\nshort\n{accents}") for i in range(40)]
    rows += [(100, f"{common}\n{common}\n{common}"), (101, "x" * 19 + "\n" + "é" * 19), (102, "x" * 19 + "\n" + "é" * 19),
             (103, "x" * 19 + "\n" + "é" * 19), (104, "y" * 20), (105, "Y" * 20), (106, " " + "y" * 20 + "\r\n"),
             (107, accents.lower()), (108, accents), (109, "é" * 20), (110, "é" * 20), (111, "É" * 20), (112, "é" * 20),
             (113, "a twice repeated line of this\n" * 4), (114, "a twice repeated line of this\n" * 4),
             (115, "no-break space stays here "), (116, " no-break space stays here"), (117, " " * 25)]
    assert found(drop_common_lines(make_docs(rows).repartition(5))) == plain(rows)


def test_edge_cases(make_docs):
    line = "a line that is held by many rows"
    rows = [(None, None), (None, line), (None, f"{line}\nother"), (1, None), (2, ""), (3, "\n"), (4, "\n\n"), (5, line), (5, line),
            (5, f"x\n{line}"), (6, f"{line}\n{line}"), (7, "two rows hold this line only"), (7, "two rows hold this line only"),
            (8, "two rows hold this line only"), (9, f"{line}\n"), (10, ("z" * 30 + "\n") * 20000)]
    assert found(drop_common_lines(make_docs(rows))) == plain(rows)
    assert drop_common_lines(make_docs([])).count() == 0


def test_many_rows_without_an_id(make_docs):
    """Texts of one (null) id are cut at their own places."""
    line = "this line is in every one of the rows"
    rows = [(None, f"{'w' * (i % 7)}\n" * (i % 5) + line) for i in range(300)] + [(1, line), (2, line)]
    assert found(drop_common_lines(make_docs(rows).repartition(4))) == plain(rows)


def test_query_digest(spark, documents):
    from tablefit.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(rows)}
    assert {tuple(r) for r in QUERIES["op13_line_dedup"](spark, SF_DIR).collect()} == expected


def test_meet_sends_no_heavy_key_through_a_shuffle(spark):
    left = spark.range(10_000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS v")
    counts = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("x", counts_x())
    got = meet(left, counts, ["k"], "n", 10_000)
    assert got.count() == 10_000 and got.columns == ["k", "v", "x"]
    assert got.where("x != k * 2").count() == 0


def counts_x():
    from pyspark.sql import functions as F

    return F.col("k") * 2
