"""Cleaning functions against a plain restatement of their rules, on random texts."""

import random
import re

from pyspark.sql import functions as F

from sendledger.functions import dates as D, text as X
from sendledger.functions.predicates import campaign_token, channel_filter, day_tokens, label, on_days
from sendledger.functions.predicates import CHANNEL_DEFAULT, CHANNEL_RULES, PRODUCT_DEFAULT, PRODUCT_RULES

BLANKS = " \t\n\r ﻿"


def random_texts(alphabet, n=400, longest=14, extra=()):
    rng = random.Random(7)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return [None, "", *extra, *texts]


def applied(spark, texts, function):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    rows = df.select("i", function(F.col("c")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def plain_report_ts(s):
    if s is None or not s.strip(BLANKS) or "in process" in s.lower():
        return None
    t = s[1:] if s[0] in "'\"" else s
    t = (t[:-1] if t and t[-1] in "'\"" else t).strip(BLANKS)
    m = re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})", t)
    if not m:
        return t
    month, day, year, hour, minute = m.groups()
    return f"{year}-{month:0>2}-{day:0>2} {hour:0>2}:{minute}:00"


def test_report_ts(spark):
    texts = random_texts(
        "1024/ :'\"- ", extra=[
            "4/5/2025 9:07", "12/31/2025 23:59", "'4/5/2025 9:07'", '"04/05/2025 09:07"', "4/5/25 9:07",
            "2025-04-05 09:07:00", "In Process", " in process now", "  ", "1/2/2024 - 012 x", "'",
            "4/5/2025 9:07:11", "10/1/2024 0:00",
        ],
    )
    assert applied(spark, texts, D.parse_report_ts) == [plain_report_ts(s) for s in texts]


def test_ids(spark):
    texts = random_texts("1a' `\t", extra=["'123'", " 12 ", "''"])

    def txn(s):
        s = None if s is None else s.strip(BLANKS)
        return None if s is None else (re.sub(r"'|\s+\Z", "", s) or None)

    def tag(s):
        return None if s is None else (s.strip(BLANKS).replace("`", "") or None)

    assert applied(spark, texts, X.clean_txn_id) == [txn(s) for s in texts]
    assert applied(spark, texts, X.clean_tag_id) == [tag(s) for s in texts]


def test_numbers(spark):
    texts = random_texts("120.eE+- x", extra=["160abc", "-4.5e2x", ".5", "5.", "+7", " 8", "1e", "1e+"])

    def whole(s):
        m = re.match(r"\s*([+-]?\d+)", s or "")
        return int(m[1]) if m else None

    def fraction(s):
        m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", s or "")
        return float(m[1]) if m else None

    assert applied(spark, texts, X.lead_int) == [whole(s) for s in texts]
    assert applied(spark, texts, X.lead_float) == [fraction(s) for s in texts]
    assert applied(spark, ["1", "2.50", "0.0", None], lambda c: X.number_text(X.lead_float(c))) == [
        "1", "2.5", "0", None,
    ]


def test_mobiles(spark):
    texts = ["9.19876543210E+11", "919876543210", "", None, "abcE+", "9E+3", "9e+3"]
    assert applied(spark, texts, X.plain_mobile) == [
        "919876543210", "919876543210", None, None, None, "9000", "9e+3",
    ]
    texts = ["919876543210", "9876543210", "5876543210", " 6000000000\r", "91987654321", "9198765432101", "x", "", None]
    assert applied(spark, texts, X.normal_mobile) == [
        "919876543210", "919876543210", None, "916000000000", None, None, None, None, None,
    ]


def test_names(spark):
    paths = ["file:/a/CM_LB%2001.csv", "s3://b/x.csv.csv", "/c/list.v1.txt", "/d/+plus%25", "/e/.hidden"]
    assert applied(spark, paths, X.source_from_path) == [
        "CM_LB 01", "x.csv", "list.v1.txt", "+plus%", ".hidden",
    ]
    assert applied(spark, paths, lambda c: X.source_from_path(c, any_extension=True)) == [
        "CM_LB 01", "x.csv", "list.v1", "+plus%", ".hidden",
    ]
    assert applied(spark, ["Club  A\tB", None], X.name_key) == ["Club_A_B", None]
    assert applied(spark, ["Acme-car B"], X.feed_key) == ["Acme_car_B"]
    assert applied(spark, ["'1'2'", "1'2", None], X.strip_quote) == ["12", "1'2", None]
    assert applied(spark, [" a\tb\r\n", None], X.scrub) == ["ab", None]


def test_sheet_date(spark):
    cells = ["4/5/25", "12/31/2025", "2025-04-05", "a/b", "1/2/3/4", None]
    assert applied(spark, cells, D.sheet_date) == ["2025-04-05", "2025-12-31", "2025-04-05", "a/b", "1/2/3/4", None]


def test_dates_never_fail(spark):
    texts = random_texts("0129/-: Janpr", extra=["31-Feb-25", "31/12/2025", "2025-02-30", "5-Apr-25"])
    layouts = [(D.ISO_DAY,), (D.DAY_MONTH_NAME,), D.US_DAY, (D.DAY_KEY,)]
    for layout in layouts:
        applied(spark, texts, lambda c: D.try_date(c, *layout))
    got = applied(spark, ["5-jan-69", "15-Jan-70", "x"], lambda c: D.try_date(c, D.DAY_MONTH_NAME).cast("string"))
    assert got == ["2069-01-05", "1970-01-15", None]
    got = applied(spark, ["4/5/2025", "4/5/25", "13/1/2025"], lambda c: D.try_date(c, *D.US_DAY).cast("string"))
    assert got == ["2025-04-05", "2025-04-05", None]


def test_dates_in_names(spark):
    names = ["Leads 5-Apr'25.xlsx", "Leads 3rd May.xlsx", "Leads 21 June.xlsx", "Leads.xlsx", "31-Feb'25", None]
    assert applied(spark, names, lambda c: D.date_in_name(c, 2025)) == [
        "05/04/2025", "03/05/2025", "21/06/2025", None, None, None,
    ]
    assert applied(spark, names, lambda c: D.month_in_name(c, "Jan"))[:4] == ["Apr", "May", "Jan", "Jan"]


def test_epoch_text_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.range(1).select(F.lit(1704067199999).alias("c"))
        row = df.select(D.ms_to_text(F.col("c")), D.ms_to_text(F.col("c"), "Asia/Kolkata")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2023-12-31 23:59:59", "2024-01-01 05:29:59")


def test_fields(spark):
    lists = ["1,2,3", "a", "", None]
    assert applied(spark, lists, lambda c: X.nth_field(c, 2)) == ["2", "a", "", None]
    assert applied(spark, lists, lambda c: X.nth_field(c, 9)) == ["3", "a", "", None]


def test_labels(spark):
    names = ["x_cm_lb_1", "CM_LH", "CMxMX", "hn-1", "zz", None]
    assert applied(spark, names, lambda c: label(c, PRODUCT_RULES, PRODUCT_DEFAULT)) == [
        "LB", "LH", "MX", "HN", "OTHERS", "OTHERS",
    ]
    codes = ["A_RC_J_0504", "A_RC_0504", "A_SM_0504", "A_sm_0504", "A_EM_0504"]
    assert applied(spark, codes, lambda c: label(c, CHANNEL_RULES, CHANNEL_DEFAULT)) == [
        "JIO", "RCS", "SMS", "SMS", "OTHERS",
    ]
    assert applied(spark, codes, campaign_token) == ["J", "0504", "0504", "A", "0504"]
    assert applied(spark, codes, lambda c: campaign_token(c, fixed=True)) == ["0504", "0504", "0504", "A", "0504"]
    assert applied(spark, codes, lambda c: channel_filter(c, "RCS")) == [False, True, False, False, False]
    assert applied(spark, codes, lambda c: channel_filter(c, "other")) == [True] * 5
    assert applied(spark, ["A_0504", "A_3102", "A_05x4", None], lambda c: D.tail_date(c, 2025).cast("string")) == [
        "2025-04-05", None, None, None,
    ]


def test_day_tokens_match_both_orders():
    pattern = re.compile(day_tokens("2025-04-05", "2025-04-06"))
    assert all(pattern.search(s) for s in ["A_0504", "A_0405", "x0604y", "0406"])
    assert not pattern.search("A_0704")
    # A whole year finds every day and nothing else.
    year = re.compile(day_tokens("2024-01-01", "2024-12-31"))
    assert year.fullmatch("2902") and year.fullmatch("0229") and not year.fullmatch("3113")
    assert day_tokens("2000-01-01", "2030-12-31") == day_tokens("2024-01-01", "2024-12-31")


def test_single_bound_means_that_day(spark):
    df = spark.sql("SELECT DATE '2024-01-01' + CAST(id AS INT) AS d FROM range(5)")
    assert on_days(df, "d", "2024-01-02", "2024-01-04").count() == 3
    assert on_days(df, "d", start="2024-01-02").count() == 1
    assert on_days(df, "d", end="2024-01-02").count() == 1
    assert on_days(df, "d").count() == 5


def test_empty_dates_are_not_parsed(spark):
    cells = spark.createDataFrame([("",), (None,), (" ",), ("2/3/2024",), ("2/3/24",), ("no day",)], "c string")
    found = cells.select("c", D.try_date(F.col("c"), *D.US_DAY).alias("day"))
    assert "gettimestamp(c" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["c"]: str(r["day"]) for r in found.collect()} == {
        "": "None", None: "None", " ": "None", "2/3/2024": "2024-02-03", "2/3/24": "2024-02-03", "no day": "None",
    }
