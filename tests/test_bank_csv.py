"""Bank CSV as input: declared schema, rejected lines, the bank's label."""
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.operators import labels as LB
from giftrisk.operators import reshape as RS
from giftrisk.sources.bank import BANK_SCHEMA, bank_transactions, read_bank_csv

SF = "/root/testdata/sf0.001"
NAMES = [x.strip().split()[0] for x in BANK_SCHEMA.replace("(18,2)", "").split(",")]


def line(**changed):
    row = dict.fromkeys(NAMES, "") | {"Customer_ID": "1", "Customer_Name": "A B", "Age": "30", "State": "Goa", "Transaction_ID": "7", "Transaction_Date": "2024-02-03",
                                      "Transaction_Amount": "12.50", "Is_Fraud": "1"} | changed
    return ",".join(row[n] for n in NAMES)


def test_lines_that_do_not_fit_are_set_apart(spark, tmp_path):
    bad = [line(Transaction_Amount="n/a"), line(Transaction_Date="soon"), "1,2,3", line(Is_Fraud="yes"), line() + ",extra", line(Transaction_ID="")]
    good = [line(), line(Transaction_ID="8", Customer_Name='"Smith, Ann"', Is_Fraud="0")]
    for i, lines in enumerate((bad[:3] + good[:1], good[1:] + bad[3:], [])):
        (tmp_path / f"part{i}.csv").write_text("\n".join([",".join(NAMES), *lines]) + "\n")
    rows, rejected = read_bank_csv(spark, str(tmp_path))
    got = {r.Transaction_ID: r for r in rows.collect()}
    assert set(got) == {"7", "8"} and got["8"].Customer_Name == "Smith, Ann" and str(got["7"].Transaction_Amount) == "12.50"
    assert (got["7"].Is_Fraud, got["8"].Is_Fraud) == (1, 0) and rows.columns == NAMES
    assert rejected.count() == len(bad) and set(bad[:5]) <= {r.line for r in rejected.collect()}
    assert rows.select("State").count() == 2  # a scan of one column judges lines alike


def test_the_label_rides_through_the_reshape_and_is_swapped(spark):
    bank = bank_transactions(spark, SF).withColumn("Is_Fraud", (F.col("Transaction_ID").cast("long") % 5 == 0).cast("int"))
    with_label, without = RS.donations(bank), RS.donations(bank.drop("Is_Fraud"))
    assert with_label.columns == [*C.DONATION_COLUMNS, "Is_Fraud"] and len(with_label.columns) == 33
    assert with_label.drop("Is_Fraud").exceptAll(without).count() == 0
    assert with_label.where((F.col("Is_Fraud") == 1) != (F.col("Donation_ID").cast("long") % 5 == 0)).count() == 0
    swapped = LB.swap_label(with_label.withColumn("Is_Anomalous", F.lit(1)))
    assert swapped.columns == [*C.DONATION_COLUMNS, "Is_Anomalous"]
