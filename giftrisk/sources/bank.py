"""Bank-transaction fixture from the driver tables (orders ⋈ customer ⋈ nation).

Every attribute the TPC-H-like tables lack is a key-derived draw, so the table
is a deterministic function of the inputs and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from giftrisk import constants as C
from giftrisk.functions.draws import uniform
from giftrisk.session import write_stage
from giftrisk.sources.tables import ensure_parallelism, table


def literal_map(mapping: dict) -> Column:
    """Constant lookup map evaluated inside codegen (no join, no broadcast)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def pick(values: list[str], u: Column) -> Column:
    """Uniform pick from a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.floor(u * len(values)) + 1).cast("int"))


def customer_name(ckey: Column) -> Column:
    world = pick(C.WORLD_NAMES, uniform(ckey, "world", 1))
    usual = F.concat_ws(" ", pick(C.FIRST_NAMES, uniform(ckey, "who", 0)), pick(C.LAST_NAMES, uniform(ckey, "who", 1)))
    return F.when(uniform(ckey, "world", 0) < C.WORLD_NAME_SHARE, world).otherwise(usual)


def transaction_amount(okey: Column) -> Column:
    """A fifth of the order's price; a share of gifts are multiples of ROUND_AMOUNT
    (people give round sums). Money stays decimal: HALF_UP rounding is exact and
    engine-independent."""
    amount = F.round(F.col("o_totalprice").cast("decimal(18,2)") / 5, 2).cast("decimal(18,2)")
    step = F.lit(C.ROUND_AMOUNT).cast("decimal(18,2)")
    whole = (F.greatest(F.round(amount / step, 0), F.lit(1)) * step).cast("decimal(18,2)")
    return F.when(uniform(okey, "tx", 2) < C.ROUND_AMOUNT_SHARE, whole).otherwise(amount)


def clock(secs: Column) -> Column:
    """Seconds of a day as HH:mm:ss; without a key the parts read null."""
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    text = F.concat(two(F.floor(secs / 3600)), F.lit(":"), two(F.floor(secs / 60) % 60), F.lit(":"), two(secs % 60))
    return F.coalesce(text, F.lit("null:null:null"))


def bank_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    orders = ensure_parallelism(orders, "o_orderkey")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    # customer grows with the data: leave the strategy to AQE (sort-merge, or
    # broadcast only when its runtime size is under the threshold).
    df = (orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
          .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"))

    okey, ckey = F.col("o_orderkey"), F.col("o_custkey")
    secs = F.floor(uniform(okey, "tx", 0) * 86400).cast("int")
    state = literal_map(dict(enumerate(C.NATION_STATE)))[F.col("c_nationkey")]
    city = F.concat(F.lit("Branch "), F.col("n_name"))
    return df.select(
        ckey.cast("string").alias("Customer_ID"),
        customer_name(ckey).alias("Customer_Name"),
        F.when(uniform(ckey, "who", 3) < 0.5, "Male").otherwise("Female").alias("Gender"),
        (F.lit(18) + F.floor(uniform(ckey, "who", 2) * 53)).cast("int").alias("Age"),
        state.alias("State"),
        city.alias("City"),
        F.concat(F.lit("BR-"), F.col("c_nationkey").cast("string")).alias("Bank_Branch"),
        literal_map(C.MKTSEGMENT_TO_ACCOUNT)[F.col("c_mktsegment")].alias("Account_Type"),
        okey.cast("string").alias("Transaction_ID"),
        F.col("o_orderdate").cast("date").alias("Transaction_Date"),
        clock(secs).alias("Transaction_Time"),
        transaction_amount(okey).alias("Transaction_Amount"),
        F.lit("M-0001").alias("Merchant_ID"),
        literal_map(C.PRIORITY_TO_TYPE)[F.col("o_orderpriority")].alias("Transaction_Type"),
        F.col("o_orderstatus").alias("Merchant_Category"),
        F.round(F.lit(5000) + F.lit(9.5).cast("decimal(2,1)")
                * F.greatest(F.col("c_acctbal").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")), 2)
        .cast("decimal(18,2)").alias("Account_Balance"),
        pick(C.BANK_DEVICES, uniform(okey, "tx", 1)).alias("Transaction_Device"),
        F.concat_ws(", ", city, state).alias("Transaction_Location"),
        F.lit("Mobile").alias("Device_Type"),
        F.col("o_orderpriority").alias("Transaction_Description"),
        F.lit("").alias("Customer_Contact"),
        F.concat(F.lit("donor"), ckey.cast("string"), F.lit("@example.org")).alias("Customer_Email"),
    )


BANK_SCHEMA = (
    "Customer_ID string, Customer_Name string, Gender string, Age int, State string, City string, Bank_Branch string, "
    "Account_Type string, Transaction_ID string, Transaction_Date date, Transaction_Time string, Transaction_Amount decimal(18,2), "
    "Merchant_ID string, Transaction_Type string, Merchant_Category string, Account_Balance decimal(18,2), Transaction_Device string, "
    "Transaction_Location string, Device_Type string, Transaction_Description string, Customer_Contact string, Customer_Email string, "
    "Is_Fraud int")


def read_bank_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(transactions, rejected) of a headed bank CSV, a file or a folder of files.

    The schema is declared, never inferred. A line that doesn't fit it (a value that
    can't be parsed, too few or too many fields), or that has no Transaction_ID, is
    rejected: ``rejected(line)`` holds it as it was read. All lines are parsed once into
    a table, as a scan of some columns would judge a line by these columns only."""
    bad = "_corrupt_record"
    lines = (spark.read.schema(f"{BANK_SCHEMA}, {bad} string").option("header", True).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", bad).option("multiLine", False).csv(path))
    rows = write_stage(lines, "bank_csv")
    fits = F.col(bad).isNull() & F.col("Transaction_ID").isNotNull()
    as_text = F.to_csv(F.struct(*[c for c in rows.columns if c != bad]))
    return rows.where(fits).drop(bad), rows.where(~fits).select(F.coalesce(bad, as_text).alias("line"))
