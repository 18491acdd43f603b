"""Comparisons: dense ranks, common signatures, the gate of a request and its reasons.

Requests are groups of rows of the given tables (a brand, an order, a customer), so one job
compares all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import answers, comparison, messages, ranking
from .tables import spread, table, tasks


def _rank(higher: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = ranking.dense_ranked(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_retailprice"), higher)
        return ranked.select("p_partkey", "p_brand", "rank")

    return run


def waiver_first_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts of an order's lines as fees: 0 is a waiver and precedes every price."""
    line = table(spark, sf_dir, "lineitem")
    ranked = ranking.dense_ranked(line, ["l_orderkey"], F.col("l_extendedprice"), False, F.col("l_discount") == 0)
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "rank")


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks(table(spark, sf_dir, "lineitem"))


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are customers, records their orders, signatures (flag, status) of the lines."""
    line, order = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", n=_tasks(spark, sf_dir)), table(spark, sf_dir, "orders")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("record"), "l_returnflag", "l_linestatus", F.col("l_quantity").alias("value"),
        (F.col("l_discount") == 0).alias("waived"), F.col("l_tax"),
    )


_FACTS_SQL = """(SELECT o_custkey AS request, o_orderkey AS record, l_returnflag, l_linestatus, l_quantity AS value, l_discount = 0 AS waived, l_tax
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def common_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.common_signatures(_line_facts(spark, sf_dir), "request", "record", ["l_returnflag", "l_linestatus"], _tasks(spark, sf_dir))


def waiver_compatible_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.common_fee_signatures(_line_facts(spark, sf_dir), "request", "record", ["l_returnflag"], ["l_linestatus"], "waived", _tasks(spark, sf_dir))


def selected_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one value of each record for the one common signature, or the reason why there is none."""
    facts = _line_facts(spark, sf_dir).where("l_returnflag <> 'R'")
    signature = ["l_returnflag", "l_linestatus"]
    common = ranking.common_signatures(facts, "request", "record", signature)
    return ranking.selected_values(facts, common, "request", "record", signature, "value", "rate_basis_mismatch", "multiple_rate_signatures", "multiple_rate_values_for_signature")


AS_OF = "2000-06-01 00:00:00"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests are a customer's orders of a year; records are the orders, newest first."""
    return table(spark, sf_dir, "orders").withColumn("request", F.col("o_custkey") * 10000 + F.year("o_orderdate")).withColumn("record", F.col("o_orderkey"))


_REQUESTS_SQL = "(SELECT *, o_custkey * 10000 + year(o_orderdate) AS request, o_orderkey AS record FROM orders)"


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate judges, made from columns of the orders."""
    k = F.col("o_orderkey")
    family = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "card").when((F.col("o_orderpriority") == "5-LOW") & (k % 4 == 0), "unknown").otherwise("financing")
    day = F.col("o_orderdate").cast("date")
    return _requests(spark, sf_dir).select(
        "request", "record", F.when(k % 19 == 0, "rejected").otherwise("validated").alias("status"), family.alias("family"), F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        F.when(k % 23 != 0, F.when(k % 7 == 0, "USD").otherwise("TRY")).alias("currency"),
        F.when(k % 29 == 0, F.array().cast("array<string>")).when(k % 11 == 0, F.array(F.lit("c"))).when(k % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("segments"),
        F.when(k % 31 < 2, F.when(k % 2 == 0, "branch").otherwise("mobile")).alias("channel"), F.when(k % 37 == 0, k % 2 == 0).alias("new_customer"), F.when(k % 41 == 0, "sale").alias("mechanism"),
        F.when(k % 13 == 0, k % 2 == 0).alias("secured"), F.when(k % 5 == 0, day).alias("starts_on"), F.when(k % 5 == 0, F.date_add(day, 400)).alias("ends_on"),
        F.when(k % 5 == 0, F.when(k % 10 == 0, "ambiguous").otherwise("stated")).alias("validity_status"),
    )


def comparison_gate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of every request, in the contract's order; null where the request may be compared."""
    return comparison.gate(_contexts(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))


def own_and_peer_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a price over 100000 lack the value; the other orders of the customer get the peers' reason."""
    orders = table(spark, sf_dir, "orders")
    reason = ranking.own_or_peer(orders, "o_custkey", F.col("o_totalprice") < 100000, "rate_missing", "peer_rate_missing")
    return orders.select("o_orderkey", reason.alias("reason"))


def _outcomes(found: DataFrame) -> DataFrame:
    return found.select("request", "record", "comparable", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("value", F.lit(-1.0)).alias("value"), "reason_code")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("request", "record", (-F.col("o_orderkey")).alias("position"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each order, flag and status of its lines, numbered inside the order."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_returnflag", "l_linestatus"))
    # The lines meet once, by order: the groups, the numbers and the join stay where they are.
    line = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", n=_tasks(spark, sf_dir)).groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(
        F.min("l_extendedprice").alias("price"), F.max("l_quantity").alias("quantity"), F.min("l_discount").alias("discount"), F.min("l_partkey").alias("part"),
    ).withColumn("index", number)
    return line.join(_requests(spark, sf_dir).select("request", "record"), F.col("l_orderkey") == F.col("record")).withColumn(
        "evidence_ids", F.when(F.col("part") % 50 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("part").cast("string")))
    )


def _facts_sql() -> str:
    return f"""(SELECT request, record, l_returnflag AS flag, l_linestatus AS st, row_number() OVER (PARTITION BY record ORDER BY l_returnflag, l_linestatus) AS idx, min(l_extendedprice) AS price, max(l_quantity) AS quantity, min(l_discount) AS discount,
        min(l_partkey) AS part, min(l_partkey) % 50 <> 0 AS ev FROM lineitem JOIN {_REQUESTS_SQL} ON l_orderkey = record GROUP BY request, record, l_returnflag, l_linestatus)"""


def term_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms: quantities as months; a group of one line in fifty is ambiguous."""
    status = F.when(F.col("part") % 53 == 0, "ambiguous").otherwise("stated")
    terms = _facts(spark, sf_dir).select("request", "record", "index", status.alias("status"), F.col("quantity").alias("maximum_months"), "evidence_ids")
    return _outcomes(comparison.compared(_members(spark, sf_dir), comparison.term_facts(terms), comparison.TERM, tasks=_tasks(spark, sf_dir)))


def fee_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees: flags are kinds, statuses bases; no discount is a waiver; a part number's last digit makes rates and currencies."""
    by_rate = F.col("part") % 10 == 3
    fees = _facts(spark, sf_dir).select(
        "request", "record", "index", F.when(F.col("part") % 97 == 0, "unknown").otherwise("stated").alias("status"),
        F.when(F.col("l_returnflag") == "R", "annual").otherwise("allocation").alias("kind"), F.when(F.col("l_linestatus") == "O", "one_time").otherwise("per_year").alias("basis"),
        (F.col("discount") == 0).alias("waived"), F.when(~by_rate, F.col("price")).alias("amount"), F.when(F.col("part") % 10 == 7, "USD").otherwise("TRY").alias("currency"),
        F.when(by_rate, F.col("quantity")).alias("percent"), F.lit("monthly").alias("period"), F.lit("unspecified").alias("gross_net_basis"), F.when(F.col("part") % 4 > 0, "Anapara").alias("basis_label"), "evidence_ids",
    )
    return _outcomes(comparison.compared(_members(spark, sf_dir), comparison.fee_facts(fees), comparison.FEE, tasks=_tasks(spark, sf_dir)))


def reward_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards: flags are kinds (money, points, discount), statuses bases; programs, currencies and periods from the part number."""
    money = (F.col("l_returnflag") == "A") | ((F.col("l_returnflag") == "R") & (F.col("part") % 3 == 0))
    rewards = _facts(spark, sf_dir).select(
        "request", "record", "index", F.lit("stated").alias("status"), F.expr("CASE l_returnflag WHEN 'A' THEN 'money' WHEN 'N' THEN 'points' ELSE 'discount' END").alias("kind"),
        F.when(F.col("part") % 61 == 0, "unspecified").when(F.col("l_linestatus") == "O", "per_customer").otherwise("campaign_total").alias("basis"),
        F.when((F.col("l_returnflag") == "N") & (F.col("part") % 43 > 0), F.when(F.col("part") % 2 == 0, "Bonus").otherwise("WORLD")).alias("program_name"), F.when(money, F.col("price")).alias("amount"),
        F.when(F.col("part") % 5 == 0, "USD").otherwise("TRY").alias("currency"), F.when(F.col("l_returnflag") == "N", F.col("quantity")).alias("points"),
        F.when((F.col("l_returnflag") == "R") & ~money, F.col("discount") * 100).alias("percent"), F.when(F.col("part") % 7 == 0, "unspecified").otherwise("monthly").alias("period"),
        F.when(F.col("part") % 8 == 0, F.lit(100)).alias("minimum_spend"), F.lit(None).cast("double").alias("maximum_money"), F.lit(None).cast("double").alias("maximum_points"), "evidence_ids",
    )
    return _outcomes(comparison.compared(_members(spark, sf_dir), comparison.reward_facts(rewards), comparison.REWARD, tasks=_tasks(spark, sf_dir)))


def eligibility_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unranked: whether requests that pass the gate state their context with evidence."""
    members = _requests(spark, sf_dir)
    evidence = members.select("request", "record", F.when(F.col("o_orderkey") % 17 > 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))
    found = comparison.eligibility(members, comparison_gate_reason(spark, sf_dir), evidence)
    return found.select("request", "record", "comparable", "reason_code")


def dimension_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners and reasons of the fee and the term dimension of each request."""
    both = fee_comparison(spark, sf_dir).withColumn("dimension", F.lit("fee")).unionByName(term_comparison(spark, sf_dir).withColumn("dimension", F.lit("term")))
    return answers.verdicts(both.withColumn("rank", F.when(F.col("comparable"), F.col("rank"))))


def explained_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader is told about each record's fee and term, and how often."""
    both = fee_comparison(spark, sf_dir).withColumn("dimension", F.lit("fee")).unionByName(term_comparison(spark, sf_dir).withColumn("dimension", F.lit("term")))
    return both.groupBy("dimension", messages.explanation(F.col("reason_code")).alias("explanation")).agg(F.count("*").alias("n"))


def _compared_sql(facts: str, name: str, levels: tuple[str, ...], many: str, single: bool, higher: bool) -> str:
    """DuckDB SQL of a comparison from ``facts``: request, record, idx, issue, ks (keys from coarse to fine), v, waived, ev."""
    top = max(0, len(levels) - 1)
    mismatch = "".join(f" WHEN NOT coalesce(list_contains(lv, {n}), false) THEN '{reason}'" for n, reason in enumerate(levels))
    count = "count(*)" if single else "count(DISTINCT (waived, coalesce(v, 0)))"
    return f"""
        WITH m AS (SELECT request, record FROM {_REQUESTS_SQL}), n AS (SELECT request, count(*) AS n FROM m GROUP BY 1), f AS ({facts}),
        priced AS (SELECT DISTINCT request, ks[2] AS pair, ks[{top + 1}] AS key FROM f WHERE NOT waived),
        held AS (SELECT request, record, unnest(range({top + 1})) AS lvl, unnest(ks) AS key FROM f WHERE NOT waived
            UNION SELECT request, record, unnest(range(2)), unnest(ks[1:2]) FROM f WHERE waived
            UNION SELECT request, record, 2, ks[2] || unnest(['|money', '|rate']) FROM f WHERE waived
            UNION SELECT f.request, record, {top}, coalesce(p.key, ks[2] || '|waived') FROM f LEFT JOIN priced p ON p.request = f.request AND p.pair = ks[2] WHERE waived),
        c AS (SELECT request, lvl, key FROM held JOIN n USING (request) GROUP BY ALL HAVING count(DISTINCT record) = any_value(n)),
        s AS (SELECT request, list(DISTINCT lvl) AS lv, count(*) FILTER (lvl = {top}) AS common, min(key) FILTER (lvl = {top}) AS key FROM c GROUP BY request),
        i AS (SELECT request, arg_min(issue, (-record, idx, issue)) AS issue FROM f WHERE issue IS NOT NULL GROUP BY request),
        x AS (SELECT f.request, record, {count} AS cnt, min(v) AS v, bool_and(waived) AS waived, bool_or(ev) AS ev FROM f JOIN s USING (request)
            WHERE ks[{top + 1}] = key OR (waived AND starts_with(key, ks[2] || '|')) GROUP BY ALL),
        j AS (SELECT m.request, m.record, m.record IN (SELECT record FROM f) AS has, issue, lv, coalesce(common, 0) AS common, cnt, v, x.waived, coalesce(ev, false) AS ev
            FROM m LEFT JOIN s USING (request) LEFT JOIN i USING (request) LEFT JOIN x USING (request, record)),
        r AS (SELECT *, CASE WHEN NOT has THEN '{name}_missing' WHEN bool_or(NOT has) OVER w THEN 'peer_{name}_missing' WHEN issue IS NOT NULL THEN issue
            WHEN common = 0 THEN CASE WHEN false THEN NULL{mismatch} ELSE '{levels[-1] if levels else many}' END WHEN common > 1 OR max(coalesce(cnt, 0)) OVER w > 1 THEN '{many}'
            WHEN NOT ev THEN '{name}_evidence_missing' WHEN bool_or(NOT ev) OVER w THEN 'peer_{name}_evidence_missing' END AS why FROM j WINDOW w AS (PARTITION BY request))
        SELECT request, record, why IS NULL AS comparable,
        CASE WHEN why IS NULL THEN CAST(dense_rank() OVER (PARTITION BY request ORDER BY CASE WHEN waived THEN 0 ELSE 1 END, CASE WHEN waived THEN 0 ELSE {"-v" if higher else "v"} END) AS BIGINT) ELSE 0 END AS rank,
        CASE WHEN why IS NULL AND NOT waived THEN CAST(v AS DOUBLE) ELSE -1.0 END AS value, coalesce(why, '{"ranked_higher_is_better" if higher else "ranked_lower_is_better"}') AS reason_code FROM r
    """


_GATE_SQL = f"""(WITH o AS (SELECT request, record, o_orderkey AS k, o_orderdate AS seen, o_orderkey % 19 <> 0 AS ok,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'card' WHEN o_orderpriority = '5-LOW' AND o_orderkey % 4 = 0 THEN 'unknown' ELSE 'financing' END AS family,
    CASE WHEN o_orderkey % 23 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'USD' ELSE 'TRY' END END AS currency, CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'c' ELSE 'ab' END AS segments,
    CASE WHEN o_orderkey % 31 < 2 THEN o_orderkey % 2 END AS channel, CASE WHEN o_orderkey % 37 = 0 THEN o_orderkey % 2 END AS newc, CASE WHEN o_orderkey % 41 = 0 THEN 1 END AS mech,
    CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 2 END AS sec, o_orderkey % 10 = 5 AS stated FROM {_REQUESTS_SQL}),
    a AS (SELECT request, count(*) AS n, bool_and(ok) AS ok, bool_or(family = 'unknown') AS unk, count(DISTINCT family) AS families, min(family) AS family, count(currency) AS cn, count(DISTINCT currency) AS cd,
    bool_or(segments = '') AS bare, count(DISTINCT segments) AS sd, count(channel) AS hn, count(DISTINCT channel) AS hd, count(newc) AS wn, count(DISTINCT newc) AS wd, count(mech) AS mn, count(DISTINCT mech) AS md,
    count(sec) AS en, count(DISTINCT sec) AS ed, bool_or(seen > TIMESTAMP '{AS_OF}') AS late, count(*) FILTER (stated) AS vs,
    bool_or(stated AND (CAST(seen AS DATE) > DATE '2000-06-01' OR CAST(seen AS DATE) + 400 < DATE '2000-06-01')) AS off FROM o GROUP BY request)
    SELECT request, CASE WHEN NOT ok THEN 'record_not_validated' WHEN unk THEN 'product_family_unknown' WHEN families > 1 THEN 'product_family_mismatch' WHEN cn < n THEN 'currency_context_unknown'
    WHEN cd > 1 THEN 'currency_context_mismatch' WHEN bare THEN 'customer_segment_context_unknown' WHEN sd > 1 THEN 'customer_segment_context_mismatch'
    WHEN hn BETWEEN 1 AND n - 1 THEN 'sales_channel_context_unknown' WHEN hd > 1 THEN 'sales_channel_context_mismatch' WHEN wn BETWEEN 1 AND n - 1 THEN 'new_customer_context_unknown'
    WHEN wd > 1 THEN 'new_customer_context_mismatch' WHEN mn BETWEEN 1 AND n - 1 THEN 'product_mechanism_context_unknown' WHEN md > 1 THEN 'product_mechanism_context_mismatch'
    WHEN family = 'financing' AND en BETWEEN 1 AND n - 1 THEN 'security_context_unknown' WHEN family = 'financing' AND ed > 1 THEN 'security_context_mismatch'
    WHEN late THEN 'not_observed_as_of' WHEN vs BETWEEN 1 AND n - 1 THEN 'validity_unknown' WHEN off THEN 'campaign_not_active_as_of' END AS gate FROM a)"""


def compare_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison of rates: a customer's orders, whose lines are the rates."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("record"))
    none = F.lit(None)
    rates = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", n=_tasks(spark, sf_dir)).join(orders, F.col("l_orderkey") == F.col("record")).select(
        "request", "record", F.col("l_linenumber").alias("index"), F.lit("stated").alias("status"), F.col("l_quantity").alias("value_percent"), F.col("l_returnflag").alias("kind"),
        F.col("l_linestatus").alias("period"), F.lit("unspecified").alias("gross_net_basis"), none.cast("date").alias("reference_starts_on"), none.cast("date").alias("reference_ends_on"),
        F.lit(12).alias("term_months"), none.cast("string").alias("basis_label"), F.array(F.col("l_partkey").cast("string")).alias("evidence_ids"),
    )
    found = comparison.compared(orders, comparison.rate_facts(rates), comparison.RATE, tasks=_tasks(spark, sf_dir))
    return found.select("request", "record", "comparable", F.coalesce("rank", F.lit(0)).alias("rank"), "reason_code")


def _dense(order: str, part: str) -> str:
    return f"CAST(dense_rank() OVER (PARTITION BY {part} ORDER BY {order}) AS BIGINT)"


ENTRIES = {
    "dense_rank_low": (_rank(False), f"SELECT p_partkey, p_brand, {_dense('p_retailprice', 'p_brand')} AS rank FROM part"),
    "dense_rank_high": (_rank(True), f"SELECT p_partkey, p_brand, {_dense('p_retailprice DESC', 'p_brand')} AS rank FROM part"),
    "waiver_first_rank": (
        waiver_first_rank,
        f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        {_dense("CASE WHEN l_discount = 0 THEN 0 ELSE 1 END, CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END", 'l_orderkey')} AS rank FROM lineitem""",
    ),
    "common_signature": (
        common_signature,
        f"""WITH f AS {_FACTS_SQL}, t AS (SELECT request, count(DISTINCT record) AS n FROM f GROUP BY 1)
        SELECT request, l_returnflag, l_linestatus FROM f JOIN t USING (request) GROUP BY ALL HAVING count(DISTINCT record) = any_value(n)""",
    ),
    "waiver_compatible_signature": (
        waiver_compatible_signature,
        f"""WITH f AS {_FACTS_SQL}, t AS (SELECT request, count(DISTINCT record) AS n FROM f GROUP BY 1),
        w AS (SELECT DISTINCT request, record, l_returnflag FROM f WHERE waived), p AS (SELECT DISTINCT request, record, l_returnflag, l_linestatus FROM f WHERE NOT waived),
        o AS (SELECT DISTINCT request, l_returnflag, l_linestatus FROM p),
        c AS (SELECT request, record, l_returnflag, l_linestatus FROM o JOIN w USING (request, l_returnflag) UNION SELECT request, record, l_returnflag, l_linestatus FROM p),
        priced AS (SELECT request, l_returnflag, l_linestatus FROM c JOIN t USING (request) GROUP BY ALL HAVING count(DISTINCT record) = any_value(n)),
        free AS (SELECT request, l_returnflag, CAST(NULL AS VARCHAR) AS l_linestatus FROM w JOIN t USING (request) WHERE (request, l_returnflag) NOT IN (SELECT (request, l_returnflag) FROM o)
        GROUP BY ALL HAVING count(DISTINCT record) = any_value(n)) SELECT * FROM priced UNION ALL SELECT * FROM free""",
    ),
    "selected_rate": (
        selected_rate,
        f"""WITH f AS (SELECT * FROM {_FACTS_SQL} WHERE l_returnflag <> 'R'), t AS (SELECT request, count(DISTINCT record) AS n FROM f GROUP BY 1),
        c AS (SELECT request, l_returnflag, l_linestatus FROM f JOIN t USING (request) GROUP BY ALL HAVING count(DISTINCT record) = any_value(n)),
        k AS (SELECT request, count(*) AS common FROM c GROUP BY 1),
        v AS (SELECT request, record, count(DISTINCT value) AS vals, min(value) AS value FROM f JOIN c USING (request, l_returnflag, l_linestatus) GROUP BY ALL),
        h AS (SELECT DISTINCT request, record FROM f),
        j AS (SELECT request, record, coalesce(common, 0) AS common, max(coalesce(vals, 0)) OVER (PARTITION BY request) AS worst, value FROM h LEFT JOIN k USING (request) LEFT JOIN v USING (request, record)),
        r AS (SELECT *, CASE WHEN common = 0 THEN 'rate_basis_mismatch' WHEN common > 1 THEN 'multiple_rate_signatures' WHEN worst > 1 THEN 'multiple_rate_values_for_signature' END AS reason FROM j)
        SELECT request, record, CASE WHEN reason IS NULL THEN value END AS value, reason FROM r""",
    ),
    "comparison_gate_reason": (comparison_gate_reason, f"SELECT * FROM {_GATE_SQL}"),
    "eligibility_comparison": (
        eligibility_comparison,
        f"""WITH r AS (SELECT request, record, CASE WHEN gate IS NOT NULL THEN gate WHEN record % 17 = 0 THEN 'eligibility_evidence_missing'
        WHEN bool_or(record % 17 = 0) OVER (PARTITION BY request) THEN 'peer_eligibility_evidence_missing' END AS why FROM {_REQUESTS_SQL} JOIN {_GATE_SQL} USING (request))
        SELECT request, record, why IS NULL AS comparable, coalesce(why, 'eligibility_context_compatible') AS reason_code FROM r""",
    ),
    "fee_comparison": (
        fee_comparison,
        _compared_sql(
            f"""SELECT request, record, idx, CASE WHEN part % 97 = 0 THEN 'fee_basis_unknown' WHEN discount = 0 THEN NULL WHEN part % 10 = 3 AND part % 4 = 0 THEN 'fee_rate_context_unknown' END AS issue,
            [kind, kind || '/' || basis, kind || '/' || basis || CASE WHEN part % 10 = 3 THEN '|rate' ELSE '|money' END,
            kind || '/' || basis || CASE WHEN part % 10 = 3 THEN '|rate' || CASE WHEN part % 4 > 0 THEN 'l' ELSE '' END WHEN part % 10 = 7 THEN '|money USD' ELSE '|money TRY' END] AS ks,
            CASE WHEN part % 10 = 3 THEN quantity ELSE price END AS v, discount = 0 AS waived, ev
            FROM (SELECT *, CASE WHEN flag = 'R' THEN 'annual' ELSE 'allocation' END AS kind, CASE WHEN st = 'O' THEN 'one_time' ELSE 'per_year' END AS basis FROM {_facts_sql()})""",
            "fee", comparison.FEE.levels, comparison.FEE.many, True, False,
        ),
    ),
    "own_and_peer_reason": (
        own_and_peer_reason,
        """SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'rate_missing' WHEN bool_or(o_totalprice < 100000) OVER (PARTITION BY o_custkey) THEN 'peer_rate_missing' END AS reason FROM orders""",
    ),
    "compare_rates": (
        compare_rates,
        f"""WITH m AS (SELECT o_custkey AS request, o_orderkey AS record FROM orders), n AS (SELECT request, count(*) AS n FROM m GROUP BY 1),
        f AS (SELECT request, record, l_returnflag AS k, l_linestatus AS p, l_quantity AS v FROM lineitem JOIN m ON l_orderkey = record),
        c1 AS (SELECT request, k FROM f JOIN n USING (request) GROUP BY ALL HAVING count(DISTINCT record) = any_value(n)),
        c2 AS (SELECT request, k, p FROM f JOIN n USING (request) GROUP BY ALL HAVING count(DISTINCT record) = any_value(n)),
        s AS (SELECT n.request, (SELECT count(*) FROM c1 WHERE c1.request = n.request) AS kinds, (SELECT count(*) FROM c2 WHERE c2.request = n.request) AS common FROM n),
        v AS (SELECT request, record, count(DISTINCT v) AS vals, min(v) AS v FROM f JOIN c2 USING (request, k, p) GROUP BY ALL),
        h AS (SELECT DISTINCT request, record, true AS has FROM f),
        j AS (SELECT m.request, m.record, has, kinds, common, v, bool_or(has IS NULL) OVER w AS gap, max(coalesce(vals, 0)) OVER w AS worst
        FROM m LEFT JOIN h USING (request, record) JOIN s USING (request) LEFT JOIN v USING (request, record) WINDOW w AS (PARTITION BY m.request)),
        r AS (SELECT *, CASE WHEN has IS NULL THEN 'rate_missing' WHEN gap THEN 'peer_rate_missing' WHEN common = 0 AND kinds = 0 THEN 'rate_kind_mismatch' WHEN common = 0 THEN 'rate_period_mismatch'
        WHEN common > 1 THEN 'multiple_rate_signatures' WHEN worst > 1 THEN 'multiple_rate_values_for_signature' END AS why FROM j)
        SELECT request, record, why IS NULL AS comparable, CASE WHEN why IS NULL THEN {_dense('v', 'request')} ELSE 0 END AS rank, coalesce(why, 'ranked_lower_is_better') AS reason_code FROM r""",
    ),
    "term_comparison": (
        term_comparison,
        _compared_sql(
            f"""SELECT request, record, 0 AS idx, CASE WHEN bool_or(part % 53 = 0) THEN 'term_ambiguous' END AS issue, ['t'] AS ks, max(quantity) AS v, false AS waived, bool_or(ev) AS ev
            FROM {_facts_sql()} GROUP BY request, record""",
            "term", (), "term_ambiguous", False, True,
        ),
    ),
    "reward_comparison": (
        reward_comparison,
        _compared_sql(
            f"""SELECT request, record, idx, CASE WHEN part % 61 = 0 THEN 'reward_basis_unknown' WHEN flag = 'N' AND part % 43 = 0 THEN 'reward_program_unknown'
            WHEN flag = 'R' AND part % 3 <> 0 AND part % 7 = 0 THEN 'reward_rate_context_unknown' END AS issue,
            [flag, flag || basis, flag || program, flag || basis || CASE WHEN flag = 'N' THEN program WHEN flag = 'A' OR part % 3 = 0 THEN 'm' || CASE WHEN part % 5 = 0 THEN 'USD' ELSE 'TRY' END
            ELSE 'r' || CASE WHEN part % 7 = 0 THEN 'u' ELSE 'm' END END || CASE WHEN part % 8 = 0 THEN '100' ELSE '' END] AS ks,
            CASE WHEN flag = 'A' OR (flag = 'R' AND part % 3 = 0) THEN price WHEN flag = 'N' THEN quantity ELSE round(discount * 100, 6) END AS v, false AS waived, ev
            FROM (SELECT *, CASE WHEN part % 61 = 0 THEN 'u' WHEN st = 'O' THEN 'c' ELSE 't' END AS basis, CASE WHEN flag = 'N' AND part % 43 > 0 THEN CASE WHEN part % 2 = 0 THEN 'bonus' ELSE 'world' END ELSE '' END AS program
            FROM {_facts_sql()})""",
            "reward", comparison.REWARD.levels, comparison.REWARD.many, True, True,
        ),
    ),
}

ENTRIES["dimension_verdicts"] = (
    dimension_verdicts,
    f"""WITH o AS (SELECT *, 'fee' AS dimension FROM ({ENTRIES["fee_comparison"][1]}) UNION ALL SELECT *, 'term' FROM ({ENTRIES["term_comparison"][1]}))
    SELECT request, dimension, CASE WHEN bool_and(comparable) THEN arg_min(record, (rank, record)) END AS winner, CASE WHEN NOT bool_or(comparable) THEN arg_min(reason_code, record) END AS reason
    FROM o GROUP BY request, dimension HAVING count(*) > 1""",
)

_TOLD = " ".join(f"WHEN '{code}' THEN '{text}'" for code, text in messages.REASONS)
ENTRIES["explained_outcomes"] = (
    explained_outcomes,
    f"""WITH o AS (SELECT reason_code, 'fee' AS dimension FROM ({ENTRIES["fee_comparison"][1]}) UNION ALL SELECT reason_code, 'term' FROM ({ENTRIES["term_comparison"][1]}))
    SELECT dimension, CASE reason_code {_TOLD} END AS explanation, count(*) AS n FROM o GROUP BY ALL""",
)
