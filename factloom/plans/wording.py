"""Rewards, channels, customers and segments in generated statements, one form for each line number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wording
from .tables import table

KEYS = ("l_orderkey", "l_linenumber", "l_partkey")


def _said(*forms: str):
    return F.element_at(F.lit(list(forms)), F.col("l_linenumber"))


def read_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.floor("l_extendedprice").cast("string")
    n = F.col("l_linenumber")
    raw = (
        F.when(n == 1, F.concat(amount, F.lit(" puan kazanın"))).when(n == 2, F.concat(amount, F.lit(" TL nakit iade"))).when(n == 3, F.concat(amount, F.lit(" TL hediye çeki")))
        .when(n == 4, F.concat(amount, F.lit(" TL hediye çeki çekilişle"))).when(n == 5, F.lit("%10 indirim")).when(n == 6, F.concat(amount, F.lit(" TL indirim"))).otherwise(F.concat(amount, F.lit(" TL")))
    )
    found = table(spark, sf_dir, "lineitem").select(*KEYS, wording.reward(raw).alias("r"))
    return found.select(*KEYS, "r.kind", "r.basis", F.coalesce(F.col("r.points"), F.col("r.money.amount"), F.col("r.rate.value_percent")).cast("double").alias("value"))


def sales_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel of each order's statements: exclusive before positive, then the first."""
    raw = _said("Mobil uygulamadan başvurabilirsiniz", "Sadece şubeden", "İnternet şubesi hariç", "Dijital kanallar üzerinden geçerli", "Kampanya", "Mobil ve İnternet Bankacılığı kanalları üzerinden", "Web sitesi")
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", wording.channel(raw).alias("said"))
    return found.groupBy("l_orderkey").agg(wording.document_channel(F.col("said"), F.col("l_linenumber")).alias("channel"))


def customer_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _said("Tüm müşterilerimize özel", "Sadece yeni müşteriler yararlanabilir", "Emekliler yararlanabilir", "Öğrenciler dahil değildir", "Mevcut ve yeni müşteriler", "Esnaf ve KOBİ müşterilerine özel", "Müşteri temsilcileri")
    said = table(spark, sf_dir, "lineitem").select(*KEYS, wording.new_customers(raw).cast("string").alias("new_only"), F.array_join(wording.segments(raw), ",").alias("segments"))
    return said


_SEVEN = lambda *v: "CASE l_linenumber " + " ".join(f"WHEN {k + 1} THEN {x}" for k, x in enumerate(v)) + " END"
_K = ", ".join(KEYS)

ENTRIES = {
    "read_reward": (
        read_reward,
        f"""SELECT {_K}, {_SEVEN("'points'", "'money'", "'money'", 'NULL', "'discount'", "'discount'", 'NULL')} AS kind,
        {_SEVEN("'campaign_total'", "'campaign_total'", "'campaign_total'", 'NULL', "'per_transaction'", "'per_transaction'", 'NULL')} AS basis,
        CAST({_SEVEN('floor(l_extendedprice)', 'floor(l_extendedprice)', 'floor(l_extendedprice)', 'NULL', '10', 'floor(l_extendedprice)', 'NULL')} AS DOUBLE) AS value FROM lineitem""",
    ),
    "sales_channel": (
        sales_channel,
        """WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'mobile' WHEN 2 THEN 'branch' WHEN 4 THEN 'digital' WHEN 6 THEN 'digital' END AS c, CASE l_linenumber WHEN 2 THEN 2 ELSE 1 END AS p FROM lineitem)
        SELECT l_orderkey, arg_min(c, (-p, l_linenumber)) FILTER (c IS NOT NULL) AS channel FROM s GROUP BY l_orderkey""",
    ),
    "customer_scope": (
        customer_scope,
        f"""SELECT {_K}, {_SEVEN("'false'", "'true'", 'NULL', 'NULL', "'false'", 'NULL', 'NULL')} AS new_only,
        {_SEVEN("''", "''", "'retired'", "''", "''", "'tradesman,sme'", "''")} AS segments FROM lineitem""",
    ),
}
