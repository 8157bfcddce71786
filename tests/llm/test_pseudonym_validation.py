"""Operator 5: decoys stay and aren't counted; formats with other groups are found."""

from datetime import datetime

from pyspark.sql import functions as F

from fathom.llm import pseudonyms


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(pseudonyms.pseudonymise(docs, "k").collect())]


def test_decoys_stay(spark):
    texts = ["id 4111111111111112.", "ref 1234567890123, 9999 8888 7777 6666", "000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000", "no 3782-822463-10006", "13/13/1999 02/30/2020"]
    for text, row in zip(texts, run(spark, texts)):
        assert row.text == text and row.n_card == row.n_ssn == 0


def test_valid_values_are_replaced(spark):
    rows = run(spark, ["a 3782-822463-10005 b", "a 3782 822463 10005 b", "a 0000 4111 1111 1111 1111 b", "a 4111111111111111, 4111111111111112", "a 12/25/1999 b", "899-99-9999 b"])
    assert [r.n_card for r in rows] == [1, 1, 1, 1, 0, 0] and [r.n_date for r in rows] == [0, 0, 0, 0, 1, 0] and rows[5].n_ssn == 1
    grouped = rows[0].text.split()[1]
    assert grouped != "3782-822463-10005" and [len(g) for g in grouped.split("-")] == [4, 6, 5] and luhn(grouped.replace("-", "")) == 0
    assert rows[1].text == rows[0].text.replace("-", " ")
    assert rows[2].text.startswith("a 0000 ") and "4111 1111 1111 1111" not in rows[2].text and luhn(rows[2].text[7:-2].replace(" ", "")) == 0
    assert rows[3].text.endswith(", 4111111111111112") and luhn(rows[3].text[2:18]) == 0 and rows[3].text[2:18] != "4111111111111111"
    fresh = rows[4].text.split()[1]
    assert fresh != "12/25/1999" and datetime.strptime(fresh, "%m/%d/%Y").day > 12


def test_new_domains_map_onto_themselves(spark):
    days = spark.range(pseudonyms.DAYS_A * pseudonyms.DAYS_B).select(F.expr(f"date_format(date_add(date'{pseudonyms.FIRST_DAY}', cast(id as int)), 'MM/dd/yyyy')").alias("day")).where("substring(day, 4, 2) > '12'")
    image = days.select(F.expr(pseudonyms.date("day", "k")).alias("fresh"))
    assert image.select("fresh").distinct().count() == days.count() == image.select("fresh").intersect(days).count()
    numbers = spark.range(898 * 99).selectExpr("concat(lpad(cast(id div 99 + if(id div 99 >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(id % 99 + 1 as string), 2, '0'), '-0001') as n")
    image = numbers.select(F.expr(pseudonyms.ssn("n", "k")).alias("fresh"))
    assert image.distinct().count() == numbers.count() == image.where(F.col("fresh").rlike("^(?:" + pseudonyms.PATTERNS["ssn"] + ")$")).count()
