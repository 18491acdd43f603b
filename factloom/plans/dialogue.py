"""Answers to customers' questions about their orders, whose lines are the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import bundles, relevance
from .tables import table

_CHARS, _SPARE = 1_500, 100
_INTENTS = ("compare", "detail", "list", "compare", "unknown")


def answer_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question of each customer: what is said, how many citations, and why nothing is."""
    c, line = F.col("c_custkey"), table(spark, sf_dir, "lineitem")
    dimensions = F.when(c % 4 == 0, F.lit(["rate", "eligibility"])).when(c % 4 == 1, F.lit(["fee", "term"])).when(c % 4 == 2, F.lit([]).cast("array<string>")).otherwise(F.lit(["reward"]))
    requests = table(spark, sf_dir, "customer").select(c.alias("request"), F.element_at(F.lit(list(_INTENTS)), (c % 5 + 1).cast("int")).alias("intent"), dimensions.alias("dimensions"), (c % 3 > 0).alias("scoped"))
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    told = line.withColumn("k", F.row_number().over(order)).where("k <= 3").select(
        "l_orderkey", "k", F.struct(F.concat(F.lit("kaynakta "), F.col("l_partkey"), F.lit(" olarak belirtilmiştir")).alias("clause"), F.array(F.struct(F.concat(F.lit("e"), F.col("l_partkey") % 300).alias("id"), F.col("l_partkey").cast("string").alias("quote"))).alias("evidence")).alias("fact"),
    )
    facts = told.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "fact"))), lambda x: x["fact"]).alias("facts"))
    o = F.col("o_orderkey")
    records = table(spark, sf_dir, "orders").join(facts, o == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("request"), (-o).alias("position"), F.col("o_orderpriority").alias("bank_name"), F.concat(F.lit("Ürün "), o).alias("title"),
        F.when(o % 9 == 0, F.array(F.lit("rate"))).when(o % 9 == 1, F.array(F.lit("term"))).otherwise(F.array().cast("array<string>")).alias("present"), F.when(o % 10 > 0, F.col("facts")).otherwise(F.slice("facts", 1, 0)).alias("facts"),
    )
    said = requests.where(F.col("request") % 7 > 2).select("request", F.lit("rate").alias("dimension"), F.concat(F.lit("Müşteri "), F.col("request"), F.lit(" kazandı.")).alias("text"))
    notes = requests.where(F.col("request") % 7 == 1).select("request", F.lit("fee").alias("dimension"), F.lit("Ücret sıralanamadı").alias("text"))
    made = bundles.bundles(requests, records, said, notes, _CHARS, _SPARE)
    cites = F.array_join(F.transform("citations", lambda x: F.concat(x["n"], F.lit(":"), x["id"], F.lit(":"), x["quote"])), ",")
    return made.select("request", F.md5("answer").alias("answer"), F.length("answer").alias("length"), "insufficient", F.md5(cites).alias("citations"), F.size("citations").alias("n"), F.array_join("warnings", ";").alias("warnings"), "compose_allowed")


_QUESTIONS = ("", "konut finansmani", "vakif katilim bankasi icin", "emlak oranlari", "tasit kuveyt turk", "kuveyt turk")
_KEYWORDS = ((), ("urgent",), ("urgent", "konut"), ("nosuchword",), ("med",))
_BANKS = (("vakif-katilim", "Vakıf Katılım Bankası A.Ş."), ("kuveyt-turk", "Kuveyt Türk"), ("emlak", "Emlak Anonim Şirketi"), ("x", "A.Ş."))
_KINDS = ("konut", "tasit", "ihtiyac")


def selected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of their orders answer each customer's question."""
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    pick = lambda values, k: F.element_at(F.lit(list(values)), (k % len(values) + 1).cast("int"))
    words = F.element_at(F.array(*(F.lit(list(k)).cast("array<string>") for k in _KEYWORDS)), (c % len(_KEYWORDS) + 1).cast("int"))
    requests = table(spark, sf_dir, "customer").select(c.alias("request"), pick(_QUESTIONS, c).alias("question"), words.alias("keywords"), F.when(c % 3 == 0, F.lit(["rate", "term"])).otherwise(F.lit(["fee"])).alias("dimensions"), (c % 2 == 0).alias("structured"), F.lit(5).alias("most"))
    records = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request"), o.alias("record"), pick([b for b, _ in _BANKS], o).alias("bank_id"), pick([n for _, n in _BANKS], o).alias("bank_name"),
        F.concat(F.split(F.lower("o_orderpriority"), "[^a-z]+"), F.array(pick(_KINDS, o), F.lit("finansman"))).alias("tokens"), F.when(o % 5 == 0, F.lit(["rate", "fee"])).when(o % 5 == 1, F.lit(["term"])).otherwise(F.array().cast("array<string>")).alias("present"), F.col("o_orderdate").alias("observed_at"),
    )
    return relevance.selected(requests, records).select("request", "record", F.col("nth").cast("bigint").alias("nth"), F.col("score").cast("bigint").alias("score"))


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

ENTRIES = {
    "selected_records": (
        selected_records,
        f"""WITH q AS (SELECT c_custkey AS request, ' ' || {_LIST(_QUESTIONS)}[c_custkey % {len(_QUESTIONS)} + 1] || ' ' AS q, [{", ".join(_LIST(k) + "::VARCHAR[]" for k in _KEYWORDS)}][c_custkey % {len(_KEYWORDS)} + 1] AS ks, CASE WHEN c_custkey % 3 = 0 THEN ['rate', 'term'] ELSE ['fee'] END AS dims, c_custkey % 2 = 0 AS st FROM customer),
        r AS (SELECT o_custkey AS request, o_orderkey AS record, o_orderdate AS seen, o_orderkey % 4 AS b, list_concat(string_split_regex(lower(o_orderpriority), '[^a-z]+'), [{_LIST(_KINDS)}[o_orderkey % 3 + 1], 'finansman']) AS ts,
            CASE o_orderkey % 5 WHEN 0 THEN ['rate', 'fee'] WHEN 1 THEN ['term'] ELSE [] END AS present FROM orders),
        h AS (SELECT *, len(list_filter(ks, lambda k: len(list_filter(ts, lambda t: (starts_with(t, k) OR starts_with(k, t)) AND least(len(t), len(k)) >= 3)) > 0)) AS hits FROM r JOIN q USING (request)),
        t AS (SELECT *, CASE WHEN hits = len(ks) THEN 0 WHEN NOT st THEN NULL WHEN hits > 0 THEN 1 ELSE 2 END AS tier FROM h),
        k AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY request) AS best FROM t WHERE tier IS NOT NULL) WHERE tier = best AND (NOT regexp_matches(q, ' (konut|tasit|ihtiyac)')
            OR (contains(q, ' konut') AND list_contains(ts, 'konut')) OR (contains(q, ' tasit') AND list_contains(ts, 'tasit')))),
        n AS (SELECT *, CASE b WHEN 0 THEN contains(q, ' vakif katilim ') WHEN 1 THEN contains(q, ' kuveyt turk ') WHEN 2 THEN contains(q, ' emlak ') ELSE contains(q, ' x ') OR contains(q, ' a s ') END AS named FROM k),
        m AS (SELECT *, 3 * len(list_filter(dims, lambda d: list_contains(present, d))) + hits AS score FROM (SELECT *, bool_or(named) OVER (PARTITION BY request) AS anyone FROM n) WHERE named OR NOT anyone)
        SELECT request, record, nth, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, seen DESC, record) AS nth FROM m) WHERE nth <= 5""",
    ),
    "answer_bundles": (
        answer_bundles,
        f"""WITH RECURSIVE q AS (SELECT c_custkey AS request, ['{"', '".join(_INTENTS)}'][c_custkey % 5 + 1] AS intent, c_custkey % 3 > 0 AS scoped,
            CASE c_custkey % 4 WHEN 0 THEN ['rate', 'eligibility'] WHEN 1 THEN ['fee', 'term'] WHEN 2 THEN [] ELSE ['reward'] END AS dims FROM customer),
        l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS k FROM lineitem),
        f AS (SELECT l_orderkey, l_partkey AS p, k FROM l WHERE k <= 3 AND l_orderkey % 10 > 0),
        s0 AS (SELECT o_custkey AS request, o_orderkey AS rec, o_orderpriority || ' Ürün ' || o_orderkey || ' ürününde '
            || string_agg(CASE WHEN k > 1 THEN 'Ayrıca ' ELSE '' END || 'kaynakta ' || p || ' olarak belirtilmiştir.', ' ' ORDER BY k) AS sentence FROM f JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, o_orderkey, o_orderpriority),
        s AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY rec DESC) AS pos FROM s0),
        walk(request, pos, used, said) AS (SELECT DISTINCT request, 0::BIGINT, 0::BIGINT, false FROM s
            UNION ALL SELECT w.request, s.pos, CASE WHEN used + len(sentence) + 1 > {_CHARS - _SPARE} THEN used ELSE used + len(sentence) + 1 END, used + len(sentence) + 1 <= {_CHARS - _SPARE} FROM walk w JOIN s ON s.request = w.request AND s.pos = w.pos + 1),
        t AS (SELECT s.* FROM s JOIN walk w ON w.request = s.request AND w.pos = s.pos AND w.said),
        e AS (SELECT t.request, 'e' || (p % 300) AS id, arg_min(p, (pos, k)) AS quote, min((pos, k)) AS first FROM t JOIN f ON l_orderkey = rec GROUP BY ALL),
        c AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY first) AS n FROM e),
        cc AS (SELECT request, string_agg(n || ':' || id || ':' || quote, ',' ORDER BY n) AS cites, count(*) AS n FROM c WHERE n <= {bundles.CITATIONS} GROUP BY 1),
        g AS (SELECT request, count(*) AS n, bool_or(rec % 9 = 0) AS rate, bool_or(rec % 9 = 1) AS term FROM s GROUP BY 1),
        b AS (SELECT request, string_agg(sentence, ' ' ORDER BY pos) AS body FROM t GROUP BY 1),
        j AS (SELECT q.*, coalesce(g.n, 0) AS recs, body, cites, coalesce(cc.n, 0) AS n, CASE request % 4 WHEN 0 THEN coalesce(rate, false) WHEN 1 THEN coalesce(term, false) WHEN 2 THEN true ELSE false END AS stated,
            intent IN ('unknown') OR (intent IN ('detail', 'list') AND NOT scoped) OR body IS NULL AS fails, intent = 'compare' AND coalesce(g.n, 0) >= 2 AND len(dims) > 0 AS ranks
            FROM q LEFT JOIN g USING (request) LEFT JOIN b USING (request) LEFT JOIN cc USING (request)),
        a AS (SELECT *, CASE WHEN fails THEN '{bundles.ABSTAINED}' ELSE trim(left(CASE WHEN stated THEN '' ELSE '{bundles.ABSENCE[0]}' || CASE request % 4 WHEN 0 THEN 'kâr payı oranı' WHEN 1 THEN 'ücret, vade' ELSE 'ödül/fayda' END || '{bundles.ABSENCE[1]} ' END
            || CASE WHEN ranks AND request % 7 > 2 THEN 'Müşteri ' || request || ' kazandı. ' ELSE '' END || body || CASE WHEN ranks AND request % 7 = 1 THEN ' Not: Ücret sıralanamadı.' ELSE '' END, {_CHARS})) END AS answer FROM j)
        SELECT request, md5(answer) AS answer, CAST(len(answer) AS INTEGER) AS length, fails AS insufficient, md5(CASE WHEN fails THEN '' ELSE cites END) AS citations, CAST(CASE WHEN fails THEN 0 ELSE n END AS INTEGER) AS n,
        CASE WHEN intent = 'unknown' THEN '' WHEN intent IN ('detail', 'list') AND NOT scoped THEN '{bundles.UNSCOPED}' WHEN fails OR intent <> 'compare' THEN '' WHEN recs < 2 THEN '{bundles.ONE_RECORD}' WHEN len(dims) = 0 THEN '{bundles.NO_DIMENSION}'
        WHEN request % 7 <= 2 THEN '{bundles.UNRANKED}' ELSE '' END AS warnings, NOT fails AND stated AND intent <> 'compare' AS compose_allowed FROM a""",
    ),
}
