"""Sanctions list sources.

Real lists arrive as one JSON document per list with list-specific field
names (payload keys and field names below are fixed values). ``read_payloads``
reads such files; ``derived_payloads`` builds the same shapes from the
customer table (a key-derived ~2 % of customers are "listed" under an exact,
one-deletion, one-swap or reordered variant of their name), so screening is
exercised on data that grows with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from giftrisk import constants as C
from giftrisk.functions.draws import uniform
from giftrisk.sources.bank import customer_name, pick
from giftrisk.sources.tables import table

LISTED_SHARE = 0.02

# FIXED VALUES: fields that may hold an attribute, in order of preference (the first
# that is not empty counts), whatever the list
FIELDS = {
    "name": ["sdnName", "alternateName", "Name", "name", "Names"],
    "programs": ["program", "Programs"],
    "remarks": ["remarks", "Remarks", "OtherInfos"],
    "type": ["sdnType", "GroupType"],
    "id": ["entityID", "EntityID", "GroupID"],
    "country": ["country", "Country"],
}
# the fields our derived lists fill (name, programs, remarks, type, id)
LIST_FIELDS = {
    "SDNs": ("sdnName", "program", "remarks", "sdnType", "entityID"),
    "altNames": ("alternateName", "program", "remarks", "sdnType", "entityID"),
    "deniedPersons": ("name", None, "remarks", None, "entityID"),
    "bisEntities": ("Name", None, "Remarks", None, "EntityID"),
    "euConsolidatedSanctionsList": ("Names", "Programs", "OtherInfos", "GroupType", "EntityID"),
    "ukConsolidatedSanctionsList": ("Names", "Programs", "OtherInfos", "GroupType", "GroupID"),
    "sectoralSanctions": ("Name", "Programs", "Remarks", None, "EntityID"),
}
ARRAY_FIELDS = {"Names", "OtherInfos", "program"}
PROGRAMS = ["SDGT", "SYRIA", "IRAN", "RUSSIA-EO14024", "DPRK", "CYBER2"]


def _variant(name: Column, u: Column) -> Column:
    """Exact / drop one letter / swap two adjacent letters / 'Last First'."""
    n = F.greatest(F.length(name), F.lit(2))
    pos = (F.floor(u * 1000) % (n - 1) + 1).cast("int")  # 1-based, < n
    dropped = F.concat(F.substring(name, 1, pos - 1), F.substring(name, pos + 1, 1000))
    swapped = F.concat(F.substring(name, 1, pos - 1), F.substring(name, pos + 1, 1), F.substring(name, pos, 1),
                       F.substring(name, pos + 2, 1000))
    reordered = F.concat_ws(" ", F.element_at(F.split(name, " "), -1), F.element_at(F.split(name, " "), 1))
    return (F.when(u < 0.25, name).when(u < 0.5, dropped).when(u < 0.75, swapped).otherwise(reordered))


def listed_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    c = c.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("c_custkey")
    name = customer_name(k)
    keys = list(LIST_FIELDS)
    remark = F.when(uniform(k, "sdn", 3) < 0.2, F.repeat(F.lit("Associated with a designated network. "), 12)) \
        .otherwise(F.concat(F.lit("Ref "), k.cast("string")))
    return (c.where(uniform(k, "sdn", 0) < LISTED_SHARE)
            .select(k.cast("string").alias("ref"),
                    _variant(name, uniform(k, "sdn", 1)).alias("name"),
                    pick(keys, uniform(k, "sdn", 2)).alias("list_key"),
                    pick(PROGRAMS, uniform(k, "sdn", 3)).alias("program1"),
                    pick(PROGRAMS, uniform(k, "sdn2", 0)).alias("program0"),
                    remark.alias("remark"),
                    F.when(uniform(k, "sdn2", 2) < 0.7, F.col("n_name")).alias("country"),
                    (uniform(k, "sdn2", 3) < 0.3).alias("other_field"),
                    F.when(uniform(k, "sdn2", 1) < 0.1, "Entity").otherwise("Individual").alias("kind")))


def derived_payloads(spark: SparkSession, sf_dir: str, people: DataFrame | None = None) -> dict[str, DataFrame]:
    """One DataFrame per payload key, each with that list's field names
    (``people`` may be a materialised ``listed_people``)."""
    people = people if people is not None else listed_people(spark, sf_dir)
    out = {}
    for key, (f_name, f_prog, f_rem, f_type, f_id) in LIST_FIELDS.items():
        p = people.where(F.col("list_key") == key)
        cols = [F.concat(F.lit(key[:3].upper() + "-"), F.col("ref")).alias(f_id)]
        cols.append(F.array("name").alias(f_name) if f_name in ARRAY_FIELDS else
                    F.when(F.col("other_field"), "").otherwise(F.col("name")).alias(f_name) if key == "altNames" else
                    F.col("name").alias(f_name))
        if key == "altNames":  # part of this list fills the other name field
            cols.append(F.when(F.col("other_field"), F.col("name")).otherwise("").alias("sdnName"))
        cols.append(F.col("country").alias("country"))
        if f_prog:
            progs = F.array_distinct(F.array("program0", "program1"))
            cols.append(progs.alias(f_prog) if f_prog in ARRAY_FIELDS or key.startswith("eu")
                        else F.col("program1").alias(f_prog))
        cols.append(F.array("remark").alias(f_rem) if f_rem in ARRAY_FIELDS else F.col("remark").alias(f_rem))
        if f_type:
            cols.append(F.col("kind").alias(f_type))
        out[key] = p.select(*cols)
    return out


def _held(document: Column, names: list[str]) -> Column:
    """The first of the fields that holds something, as an array of strings whether it is
    a scalar or an array in this document."""
    found = []
    for n in names:
        c = F.coalesce(F.try_variant_get(document, f"$.{n}", "array<string>"),
                       F.array(F.try_variant_get(document, f"$.{n}", "string")))
        found.append(F.when(F.exists(c, lambda x: F.length(x) > 0), c))
    return F.coalesce(*found)


def read_payloads(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Read ``{path}/{payload_key}.json``: one JSON array a file, or with ``multi_line``
    off one document a line. Documents are read as variants, in one pass without schema
    inference; only the known fields are taken, each kind under its first name. A list
    without a file is left out, which is the same as an empty list."""
    out = {}
    conf = spark._jsc.hadoopConfiguration()
    for key in LIST_FIELDS:
        file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}.json")
        if file.getFileSystem(conf).exists(file):
            raw = (spark.read.option("singleVariantColumn", "v").option("multiLine", multi_line).json(f"{path}/{key}.json"))
            all_of = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
            out[key] = raw.select(F.explode(all_of).alias("d")).select(
                *[_held(F.col("d"), names).alias(names[0]) for names in FIELDS.values()])
    return out


ENTITY_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("list_name", T.StringType()), T.StructField("entity_type", T.StringType()),
    T.StructField("programs", T.ArrayType(T.StringType())), T.StructField("remarks", T.StringType()),
])
