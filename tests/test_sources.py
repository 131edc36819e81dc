"""Readers on files written by hand."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from sendledger.schemas import FEED_A_LEADS, FEED_B_LEADS, REPORT_HEADERS
from sendledger.sources import csv_rows, feeds, store as S
from sendledger.sources.csv_rows import csv_cells
from sendledger.sources.reports import read_delivery_reports, read_number_list

CAMPAIGN = {"client": "C 1", "product": "P", "base": "b", "vendor": "v", "channel": "sms"}
HEADER = (
    "Transaction_ID,Message_ID,Mobile,Sender_Name,Text_Message,Type,Length,Cost,Status,Cause,"
    "Channel_Name,Submitted_Time,Delivered_Time,IP,EntityId,TemplateId"
)
ROW = "'77',5,9.19876543210E+11,SEND,hi,T,160x,0.50,Delivered,,ch,4/5/2025 9:07,In Process,1.1.1.1,`9`,`8`"


def put(folder, name, text):
    path = os.path.join(str(folder), name)
    with open(path, "w", newline="", encoding="utf8") as f:
        f.write(text)
    return path


def test_report_row(spark, tmp_path):
    put(tmp_path, "CM_LB 01.csv", "\ufeff" + HEADER + "\r\n" + ROW + "\r\n")
    rows, rejected = read_delivery_reports(spark, str(tmp_path), CAMPAIGN)
    (r,) = rows.collect()
    assert r.asDict() == {
        "transaction_id": "77", "message_id": "5", "mobileNo": "919876543210", "sender": "SEND",
        "text": "hi", "type": "T", "length": "160", "cost": "0.5", "status": "Delivered", "cause": "",
        "channel_name": "ch", "submit_time": "2025-04-05 09:07:00", "delivered_time": None,
        "ip": "1.1.1.1", "entity_id": "9", "template_id": "8", "source": "CM_LB 01", "client": "C 1",
        "product": "P", "base": "b", "circle": "Unknown", "vendor": "v", "channel": "sms",
    }
    assert rejected.count() == 0


def test_many_layouts(spark, tmp_path):
    names = HEADER.split(",")
    cells = dict(zip(names, ROW.split(",")))
    for i in range(3):
        order = names[i:] + names[:i] + ["Extra"] * i
        put(tmp_path, f"f{i}.csv", ",".join(order) + "\n" + ",".join(cells.get(n, "x") for n in order) + "\n")
    spaced = [n.replace("_", "  ").upper() for n in names]
    put(tmp_path, "f3.csv", ",".join(f'" {n} "' for n in spaced) + "\n" + ROW + "\n")
    put(tmp_path, "bad.csv", ",".join(names[2:]) + "\n" + ",".join(ROW.split(",")[2:]) + "\n")
    rows, rejected = read_delivery_reports(spark, str(tmp_path), CAMPAIGN)
    got = rows.collect()
    assert sorted(r["source"] for r in got) == ["f0", "f1", "f2", "f3"]
    assert len({tuple(v for k, v in r.asDict().items() if k != "source") for r in got}) == 1
    (bad,) = rejected.collect()
    assert (bad["source"], sorted(bad["missing"]), bad["reason"]) == (
        "bad", ["message_id", "transaction_id"], "missing columns",
    )


def test_same_name_counts_once(spark, tmp_path):
    for folder in ("a", "b"):
        os.mkdir(tmp_path / folder)
        put(tmp_path / folder, "same.csv", HEADER + "\n" + ROW + "\n")
    rows, rejected = read_delivery_reports(spark, [str(tmp_path / "a"), str(tmp_path / "b")], CAMPAIGN)
    assert rows.count() == 1
    assert [r["reason"] for r in rejected.collect()] == ["same name in batch"]


def test_no_acceptable_file(spark, tmp_path):
    put(tmp_path, "bad.csv", "a,b\n1,2\n")
    rows, rejected = read_delivery_reports(spark, str(tmp_path), CAMPAIGN)
    assert rows.count() == 0
    assert rejected.first()["missing"] == REPORT_HEADERS


@pytest.fixture
def splits(spark):
    """Sets the size of a split; the usual one comes back afterwards."""
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


SPLITS = ["64", "1000", "128m"]


def file_name():
    return F.element_at(F.split("file_path", "/"), -1)


@pytest.mark.parametrize("split_bytes", SPLITS)
def test_splits_make_no_difference(spark, tmp_path, splits, split_bytes):
    """Quoted line ends across split boundaries, against Python's own reader."""
    rng = random.Random(3)
    pieces = ["a", "bc", ",", '"', "\n", " ", "\n\n", "x" * 90]
    expected, width = [], 4
    for i in range(3):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow([f"h{j}" for j in range(width)])
        for k in range(120):
            row = [str(k)] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(3)]
            writer.writerow(row)
            expected.append((f"f{i}.csv", *[c or None for c in row]))
        put(tmp_path, f"f{i}.csv", out.getvalue())
    splits(split_bytes)
    rows = csv_cells(spark, str(tmp_path), width)
    got = rows.select(file_name().alias("f"), "cells").collect()
    got = sorted(((r["f"], *[c or None for c in r["cells"]]) for r in got), key=repr)
    assert got == sorted(expected, key=repr)
    in_order = rows.where("file_path LIKE '%f1.csv'").orderBy("block", "pos").collect()
    assert [int(r["cells"][0]) for r in in_order] == list(range(120))


def test_effect_of_a_line(spark):
    """Against a walk from comma to comma, with either state before; and on long lines."""
    def walk(line, inside):
        for piece in line.split(","):
            lone = lambda text: '"' in text.replace('""', "")
            inside = not lone(piece) if inside else piece.startswith('"') and not lone(piece[1:])
        return inside

    rng = random.Random(8)
    lines = ["".join(rng.choice(['"', '"', '""', ",", "a", " b"]) for _ in range(rng.randrange(0, 14))) for _ in range(5000)]
    lines += ['"' + "x" * 300_000, '""' * 200_000, '"a,' * 100_000, "a," * 100_000 + '"']
    names = {(False, True): csv_rows.SAME, (False, False): csv_rows.OUTSIDE, (True, True): csv_rows.INSIDE, (True, False): csv_rows.TURN}
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(csv_rows._effect(F.col("line")).alias("e"))
    assert [r["e"] for r in rows.collect()] == [names[(walk(x, False), walk(x, True))] for x in lines]


@pytest.mark.parametrize("split_bytes", SPLITS)
def test_stray_quotes_are_text(spark, tmp_path, splits, split_bytes):
    """A quote inside a cell opens nothing, wherever the file is split."""
    lines = [f'{k},3,5" pipe,"a ""b""\nc",{k}' if k % 7 == 0 else f'{k},3,5" pipe,x" y"z,"q"" r"' for k in range(400)]
    put(tmp_path, "f.csv", "a,b,c,d,e\n" + "\n".join(lines) + "\n")
    splits(split_bytes)
    got = {int(r["cells"][0]): r["cells"] for r in csv_cells(spark, str(tmp_path), 5).collect()}
    assert len(got) == 400
    assert got[7] == ["7", "3", '5" pipe', 'a "b"\nc', "7"]
    assert got[8] == ["8", "3", '5" pipe', 'x" y"z', 'q" r']


@pytest.mark.parametrize("split_bytes", SPLITS)
def test_unclosed_file_is_turned_away(spark, tmp_path, splits, split_bytes):
    put(tmp_path, "good.csv", HEADER + "\n" + (ROW + "\n") * 20)
    put(tmp_path, "open.csv", HEADER + "\n" + (ROW + "\n") * 20 + ROW.replace(",hi,", ',"hi,') + "\n" + (ROW + "\n") * 50)
    splits(split_bytes)
    rows, rejected = read_delivery_reports(spark, str(tmp_path), CAMPAIGN)
    assert [(r["source"], r["count"]) for r in rows.groupBy("source").count().collect()] == [("good", 20)]
    assert [(r["source"], r["missing"], r["reason"]) for r in rejected.collect()] == [("open", [], "unclosed quote")]
    with pytest.raises(ValueError, match="open.csv"):
        csv_cells(spark, str(tmp_path), 3)


def test_overlong_cell_is_turned_away(spark, tmp_path, splits, monkeypatch):
    monkeypatch.setattr(csv_rows, "LONGEST_RECORD", 500)
    stray = ROW.replace(",hi,", ',"hi,') + "\n" + (ROW + "\n") * 30 + ROW.replace(",hi,", ',hi",') + "\n"
    put(tmp_path, "long.csv", HEADER + "\n" + stray)
    splits("64")
    rows, rejected = read_delivery_reports(spark, str(tmp_path), CAMPAIGN)
    assert rows.count() == 0 and [r["reason"] for r in rejected.collect()] == ["unclosed quote"]


def test_many_files_are_read_in_one_scan(spark, tmp_path):
    names = HEADER.split(",")
    cells = dict(zip(names, ROW.split(",")))
    for i in range(200):
        order = names[i % 16 :] + names[: i % 16]
        put(tmp_path, f"f{i}.csv", ",".join(order) + "\n" + ",".join(cells[n] for n in order) + "\n")
    put(tmp_path, "short.csv", ",".join(names[1:]) + "\nx\n")
    rows, rejected = read_delivery_reports(spark, str(tmp_path), CAMPAIGN)
    got = rows.collect()
    assert sorted(r["source"] for r in got) == sorted(f"f{i}" for i in range(200))
    assert {r["transaction_id"] for r in got} == {"77"} and {r["template_id"] for r in got} == {"8"}
    assert [r["source"] for r in rejected.collect()] == ["short"]
    plan = rows.select("*")._jdf.queryExecution().executedPlan().toString()  # not run, so planned once
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "value" in x]
    assert len(scans) == 1  # the settled text


def test_number_list_on_one_line(spark, tmp_path, splits):
    put(tmp_path, "one.txt", ",".join(str(9_000_000_000 + i) for i in range(20_000)))
    splits("10000")
    rows, _ = read_number_list(spark, str(tmp_path), {**CAMPAIGN, "date": "2025-04-05"})
    assert rows.rdd.getNumPartitions() > 10
    assert rows.select("mobileNo").distinct().count() == 20_000


def test_number_list(spark, tmp_path):
    put(tmp_path, "my list.v2.txt", "9876543210\r\n 919876543211 ,9876543212,\n12345\n\n")
    rows, invalid = read_number_list(spark, str(tmp_path), {**CAMPAIGN, "sender": "S", "date": "2025-04-05"})
    got = rows.collect()
    assert sorted(r["mobileNo"] for r in got) == ["919876543210", "919876543211", "919876543212"]
    assert {(r["source"], r["status"], r["cause"], r["text"], r["submit_time"], r["sender"]) for r in got} == {
        ("my list.v2", "e", "e", "NA", "2025-04-05", "S")
    }
    assert [(r["source"], r["entry"]) for r in invalid.collect()] == [("my list.v2", "12345")]


def test_feed_dates(spark, tmp_path):
    row = ["4/5/25", "98", "c", "m", "s", "t", "p", "q", "Pune, W", "x", "g"]
    out = io.StringIO()
    csv.writer(out).writerows([FEED_A_LEADS, row])
    put(tmp_path, "leads.csv", out.getvalue())
    (r,) = feeds.read_feed(spark, feeds.sheet_path(str(tmp_path), "A", "leads"), "A", "leads").collect()
    assert (str(r["report_date"]), r["phone"], r["city"]) == ("2025-04-05", "98", "Pune, W")
    row = ["15-Apr-25"] + [""] * (len(FEED_B_LEADS) - 1)
    put(tmp_path, "b.csv", ",".join(FEED_B_LEADS) + "\n" + ",".join(row) + "\n" + ",".join(["4/16/25", *row[1:]]) + "\n")
    rows = feeds.read_feed(spark, str(tmp_path / "b.csv"), "B", "leads").orderBy("lead_date").collect()
    assert [str(r["lead_date"]) for r in rows] == ["2025-04-15", "2025-04-16"]
    assert (rows[0]["first_date"], rows[0]["lead_id"]) == (None, "")


def test_sheet_path():
    assert feeds.sheet_path("/x/", "C", "login") == "/x/login.csv"
    with pytest.raises(ValueError):
        feeds.sheet_path("/x", "A", "login")


def test_templates_missing_column(spark, tmp_path):
    put(tmp_path, "t.csv", 'Text,TemplateId,Count\n"a ""b""\nc",\'1,\n')
    (r,) = feeds.read_templates(spark, str(tmp_path / "t.csv")).collect()
    assert r.asDict() == {"tempid": "'1", "sender": "", "count": "", "text": 'a "b"\nc'}


def test_versioned_table(spark, tmp_path):
    path = str(tmp_path / "mapping")
    schema = spark.range(0).schema
    assert S.read_current(spark, path, schema).count() == 0
    S.replace_table(spark.range(3), path)
    S.replace_table(S.read_current(spark, path, schema).where("id > 0"), path)
    assert sorted(r["id"] for r in S.read_current(spark, path, schema).collect()) == [1, 2]
    S.replace_table(spark.range(0), path)
    assert S.read_current(spark, path, schema).count() == 0


def test_replace_month(spark, tmp_path):
    path = str(tmp_path / "b")
    S.replace_month(spark.range(3), path, "2025-04")
    S.replace_month(spark.range(5), path, "2025-05")
    S.replace_month(spark.range(1), path, "2025-04")
    stored = lambda: S.read_committed(spark, path, S.T.StructType([*spark.range(0).schema.fields, S.T.StructField("month", S.T.StringType())]))
    assert {r["month"]: r["count"] for r in stored().groupBy("month").count().collect()} == {"2025-04": 1, "2025-05": 5}
    S.replace_month(spark.range(0), path, "2025-05")
    assert [tuple(r) for r in stored().collect()] == [(0, "2025-04")]


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    files = spark.createDataFrame(
        [("05/04/2025", "Leads 5-Apr'25.xlsx", "/f/a"), ("01/05/2025", "Leads 1-May'25.xlsx", "/f/b")],
        "date string, filename string, filepath string",
    )
    ledger = lambda: S.read_table(spark, path, S.LEDGER)
    S.ledger_append(S.ledger_filter(files.limit(1), ledger()), path)
    assert [r["filename"] for r in S.ledger_filter(files, ledger()).collect()] == ["Leads 1-May'25.xlsx"]
    S.ledger_append(S.ledger_filter(files, ledger()), path)
    assert ledger().count() == 2 and ledger().where("uploaded_at IS NULL").count() == 0
    assert [r["filepath"] for r in S.files_for_month(ledger(), "Apr").collect()] == ["/f/a"]
