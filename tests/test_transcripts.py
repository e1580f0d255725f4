"""The reader that splits files against the one that does not, and against Python's csv."""

import csv
import random

import pytest

from parley.sources import tables, transcripts


@pytest.fixture
def narrow(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    yield lambda n: [spark.conf.set(names[0], str(n)), spark.conf.set(names[1], "0")]
    for name in names:
        spark.conf.unset(name)


def rows(n, seed=1):
    rng = random.Random(seed)
    bits = ['"', '""', "\n", "\r\n", ",", "a b", "é", '{"role":"user"}', "", "\n\n", "x" * 50]
    return [[f"c{i % (n - 5)}", f"u{i}", "", "web", "2024-01-01", "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) or "-"] for i in range(n)]


def save(path, some, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["chat_id", "user_id", "user_name", "from_messenger", "created", "messages"])
        w.writerows(some)


def got(df):
    return [(r.chat_id, r.user_id, r.messages) for r in df.orderBy("ordinal").collect()]


@pytest.mark.parametrize("size", [64, 333, 5000, 1 << 20])
def test_split_sizes(spark, narrow, tmp_path, size):
    """Any split size gives each record once, in the place it has in the file."""
    some = rows(60)
    save(tmp_path / "in.csv", some)
    whole = sorted((r.chat_id, r.user_id, r.messages) for r in tables.read_transcripts(spark, str(tmp_path / "in.csv")).collect())
    narrow(size)
    df = transcripts.read_split(spark, str(tmp_path / "in.csv"))
    assert got(df) == [(r[0], r[1], r[5]) for r in some] and [r.ordinal for r in df.orderBy("ordinal").collect()] == list(range(60))
    assert sorted(got(df)) == whole
    parts = spark.read.option("lineSep", "\n").text(str(tmp_path / "in.csv")).rdd.getNumPartitions()
    assert parts > 10 if size < 400 else parts >= 1


def test_many_files(spark, narrow, tmp_path):
    """The same records in one file or in many, with LF or CRLF ends: the same places, so the same first of an id."""
    some = rows(50, 2)
    for name, n in (("one", 50), ("many", 7)):
        (tmp_path / name).mkdir()
        for k in range(0, 50, n):
            save(tmp_path / name / f"part-{k:03d}.csv", some[k : k + n], "\r\n" if k % 2 else "\n")
    (tmp_path / "many" / "part-999.csv").write_text("")
    narrow(100)
    one, many = (got(transcripts.read_split(spark, str(tmp_path / name))) for name in ("one", "many"))
    assert one == many == [(r[0], r[1], r[5]) for r in some]


def test_edges(spark, tmp_path):
    head = "chat_id,user_id,user_name,from_messenger,created,messages\n"
    (tmp_path / "a.csv").write_text(head)
    (tmp_path / "b.csv").write_text(head + 'c1,u1\n\n\nc2,"u\n\n2",n,web,t,"[]"')
    df = transcripts.read_split(spark, str(tmp_path / "*.csv"))
    assert got(df) == [("c1", "u1", None), ("c2", "u\n\n2", "[]")] and [r.ordinal for r in df.orderBy("ordinal").collect()] == [0, 1]
