"""Candidate replay, validity of rates, open questions, unique quotes, sessions, queues and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import candidates, signals
from .tables import spread, table

_LINES = ["l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_partkey", "l_extendedprice"]
_NUMBERED = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINES)})"


def candidate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates, their lines as facts with evidence that is wrong in one way or another."""
    k, part = F.col("o_orderkey"), F.col("l_partkey")
    own = table(spark, sf_dir, "orders").select(
        k.alias("candidate"), F.col("o_custkey").alias("document"), F.when(k % 31 == 0, -1).otherwise(F.col("o_custkey")).alias("source_document"), F.col("o_orderpriority").alias("bank"),
        F.when(k % 29 == 0, "other").otherwise(F.col("o_orderpriority")).alias("document_bank"),
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("position", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINES)))
    pointer, raw = F.concat(F.lit("/data/rates/"), F.col("position").cast("string")), part.cast("string")
    expected = lines.select(F.col("l_orderkey").alias("candidate"), "position", pointer.alias("pointer"), F.when(F.col("l_quantity") <= 45, raw).alias("raw"))
    evidence = lines.where(part % 23 != 0).select(
        F.col("l_orderkey").alias("candidate"), "position", F.when(part % 19 == 0, "/data/other").otherwise(pointer).alias("pointer"), F.when(part % 17 == 0, "x").otherwise(raw).alias("quote"),
        F.when(part % 37 == 0, "quote_mismatch").alias("reason"),
    )
    return candidates.replay(own, expected, evidence)


def rates_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that date their own rate by an order's date, against a fixed reference date."""
    day = F.col("o_orderdate").cast("date")
    written = F.date_format(day, "dd.MM.yyyy")
    said = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(written, F.lit(" tarihine kadar geçerli kâr payı oranı %3,20.")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(written, F.lit(" - "), F.date_format(F.date_add(day, 200), "dd.MM.yyyy"), F.lit(" tarihleri arasında oran %1,10.")))
        .otherwise(F.lit("Aylık kâr payı oranı %1,89."))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", candidates.out_of_force(said, F.lit("1999-06-15").cast("date")).alias("out"))


def open_rate_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's lines, as rates, leave the price open; and the fields to ask first."""
    kind = F.when(F.col("l_returnflag") == "R", "ltv_ratio").when(F.col("l_partkey") % 40 == 0, "unknown").otherwise("financing_profit_rate")
    period = F.when(F.col("l_partkey") % 30 == 1, "unspecified").otherwise("monthly")
    rates = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(kind.alias("kind"), period.alias("period"))).alias("rates"), F.collect_set("l_linestatus").alias("states"))
    asked = candidates.priority_fields(F.array(F.lit("O"), F.lit("X")), F.col("states"))
    return rates.select("l_orderkey", candidates.rate_question_open(F.col("rates")).alias("open"), F.array_join(asked, ",").alias("first"))


def unique_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth to thirteenth character of each text as a quote: mostly ambiguous, sometimes unique."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("b1").alias("block_id"), "text")
    quotes = docs.select("document_id", F.substring("text", 10, 4).alias("quote"))
    return candidates.unique_quotes(docs, quotes).select("document_id", "n", "start")


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sessions that are neither revoked nor expired at an instant, with their active users."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")
    sessions = table(spark, sf_dir, "events").where((F.col("event_type") != "error") & (F.col("ts") + F.expr("INTERVAL 30 MINUTES") > at) & (F.col("ts") + F.expr("INTERVAL 8 HOURS") > at) & (F.col("ts") <= at))
    users = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return sessions.join(users, "user_id").select("event_id", "user_id", "c_mktsegment")


def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open order to take next: highest priority, then oldest."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


def recent_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 1,000 events, a report of that size."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "user_id", "event_type")


def derived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nested rates, published without their source forms."""
    rates = F.transform(
        F.array_sort(F.collect_list(F.struct(*_LINES))),
        lambda r: F.struct(r["l_partkey"].cast("string").alias("raw"), r["l_suppkey"].alias("value"), F.struct(r["l_returnflag"].alias("raw"), F.when(r["l_linestatus"] == "O", "open").alias("kind")).alias("basis")),
    )
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.struct(F.concat(F.lit("Order "), F.col("l_orderkey")).alias("title"), rates.alias("rates")).alias("data"))
    return candidates.derived_rows(own).select("l_orderkey", "derived_id")


def fetch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against what was processed of them: labelled ones, some under an older identity or with other content."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("html", 256).alias("clean_sha256"), F.lit("v2").alias("identity"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), "quality", "toxic")
    done = pages.join(marks, "page_id").select("url", F.when(F.col("toxic") == 0, F.col("clean_sha256")).otherwise("other").alias("clean_sha256"), F.when(F.col("quality") == 1, "v2").otherwise("v1").alias("identity"))
    return candidates.fetch_states(pages, done, ["url", "clean_sha256", "identity"]).select("page_id", "state")


# Terms of the documents' invented languages; none begins with another one's beginning.
_TERMS = {"title": ("the", "los"), "summary": (), "rate": ("and", "und"), "term": ("ing", "der"), "fee": ("tion", "que"), "segment": ("ent", "sch"), "channel": ("ment", "ung")}
_FAMILIES = (("title", "summary"), ("rate", "term", "fee"), ("segment", "channel"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents over all tasks, before they are split: a filter of lines would be moved before a shuffle of lines, and steps by document need no second one."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"), "document_id")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as blocks; short ones are headings."""
    lines = _texts(spark, sf_dir).select("document_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return lines.select("document_id", "ordinal", F.col("ordinal").alias("block_id"), F.when(F.length("text") < 60, "heading").otherwise("paragraph").alias("kind"), "text")


def field_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields to ask of each document; in every third one the channel has priority."""
    scores = signals.field_scores(_blocks(spark, sf_dir), _TERMS).withColumn("priority", (F.col("field") == "channel") & (F.col("document_id") % 3 == 0))
    return signals.chosen_fields(scores, _FAMILIES).select("document_id", "field", F.col("nth").cast("bigint").alias("nth"))


def relevant_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks worth reading for the rate and the title, with a hash of their windows."""
    found = signals.relevant_blocks(_blocks(spark, sf_dir), {k: _TERMS[k] for k in ("title", "rate")})
    return found.select("document_id", "block_id", F.col("nth").cast("bigint").alias("nth"), F.col("relevance").cast("bigint").alias("relevance"), F.md5("window").alias("window"))


_BLOCKS_SQL = """(SELECT document_id, ordinal, text, CASE WHEN len(text) < 60 THEN 'heading' ELSE 'paragraph' END AS kind, translate(lower(text), 'ışğüöçâ', 'isguoca') AS k
    FROM (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ordinal FROM documents))"""


def _count_sql(field: str) -> str:
    bonus = {"title": " + CASE WHEN kind = 'heading' THEN 2 ELSE 0 END", "summary": " + CASE WHEN kind = 'paragraph' THEN 1 ELSE 0 END"}.get(field, "")
    return "(" + " + ".join([f"(len(k) - len(replace(k, '{t}', ''))) // {len(t)}" for t in _TERMS[field]] or ["0"]) + bonus + ")"


def _first_sql(*fields: str) -> str:
    return "least(" + ", ".join(f"nullif(instr(k, '{t}'), 0)" for f in fields for t in _TERMS[f]) + ")"


ENTRIES = {
    "field_choice": (
        field_choice,
        f"""WITH b AS {_BLOCKS_SQL}, s AS ({" UNION ALL ".join(f"SELECT document_id, '{f}' AS field, {k} AS family, sum({_count_sql(f)}) AS score FROM b GROUP BY 1" for k, fs in enumerate(_FAMILIES) for f in fs)}),
        p AS (SELECT *, field = 'channel' AND document_id % 3 = 0 AS pr FROM s),
        r AS (SELECT document_id, family, row_number() OVER (PARTITION BY document_id ORDER BY bool_or(pr AND score > 0) DESC, max(score) DESC, sum(score) DESC, family) AS rn FROM p GROUP BY document_id, family),
        c AS (SELECT p.document_id, field, row_number() OVER (PARTITION BY p.document_id ORDER BY pr DESC, score DESC, field) AS nth FROM p JOIN r ON r.document_id = p.document_id AND r.family = p.family AND rn = 1 WHERE score > 0)
        SELECT * FROM c WHERE nth <= 3""",
    ),
    "relevant_blocks": (
        relevant_blocks,
        f"""WITH b AS (SELECT *, {_count_sql("title")} + {_count_sql("rate")} AS relevance, {_first_sql("title", "rate")} AS f FROM {_BLOCKS_SQL}),
        n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY relevance DESC, CASE WHEN kind = 'heading' THEN 0 ELSE 1 END, ordinal) AS nth FROM b WHERE relevance > 0)
        SELECT document_id, CAST(ordinal AS INTEGER) AS block_id, nth, CAST(relevance AS BIGINT) AS relevance,
        md5(CASE WHEN len(text) <= 400 THEN text ELSE substr(text, CAST(coalesce(greatest(0, f - 1 - 160), 0) + 1 AS BIGINT), 400) END) AS window FROM n WHERE nth <= 16""",
    ),
    "derived_rows": (
        derived_rows,
        f"""WITH l AS (SELECT *, {_NUMBERED} AS n FROM lineitem),
        r AS (SELECT l_orderkey, list({{'basis': {{'kind': CASE WHEN l_linestatus = 'O' THEN 'open' END}}, 'value': l_suppkey}} ORDER BY n) AS rates FROM l GROUP BY 1)
        SELECT l_orderkey, 'derived:' || sha256(CAST(to_json({{'rates': rates, 'title': 'Order ' || l_orderkey}}) AS VARCHAR)) AS derived_id FROM r""",
    ),
    "fetch_states": (
        fetch_states,
        """WITH p AS (SELECT page_id, url, sha256(html) AS h FROM pages),
        d AS (SELECT url, h FROM p JOIN labels ON doc_id = page_id WHERE toxic = 0 AND quality = 1)
        SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.url = p.url AND d.h = p.h) THEN 'not_modified' ELSE 'process' END AS state FROM p""",
    ),
    "candidate_replay": (
        candidate_replay,
        f"""WITH l AS (SELECT *, {_NUMBERED} AS n FROM lineitem),
        w AS (SELECT l_orderkey AS k, arg_min(CASE WHEN l_partkey % 37 = 0 THEN 'quote_mismatch' ELSE 'orphan_evidence_pointer' END, n) AS r FROM l WHERE l_partkey % 23 <> 0 AND (l_partkey % 37 = 0 OR l_partkey % 19 = 0) GROUP BY 1),
        b AS (SELECT l_orderkey AS k, arg_min(CASE WHEN l_partkey % 23 = 0 OR l_partkey % 19 = 0 THEN 'unsupported_fact' ELSE 'raw_evidence_mismatch' END, n) AS r
            FROM l WHERE l_partkey % 23 = 0 OR l_partkey % 19 = 0 OR (l_partkey % 17 = 0 AND l_quantity <= 45) GROUP BY 1)
        SELECT o_orderkey AS candidate, CASE WHEN o_orderkey % 31 = 0 THEN 'source_document_mismatch' WHEN o_orderkey % 29 = 0 THEN 'bank_mismatch' ELSE coalesce(w.r, b.r) END AS reason
        FROM orders LEFT JOIN w ON w.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey""",
    ),
    "rates_in_force": (
        rates_in_force,
        """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) < DATE '1999-06-15'
        WHEN 1 THEN CAST(o_orderdate AS DATE) > DATE '1999-06-15' OR CAST(o_orderdate AS DATE) + 200 < DATE '1999-06-15' ELSE false END AS out FROM orders""",
    ),
    "open_rate_question": (
        open_rate_question,
        """SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') = 0 OR bool_or(l_returnflag <> 'R' AND (l_partkey % 40 = 0 OR l_partkey % 30 = 1)) AS open,
        CASE WHEN bool_or(l_linestatus = 'O') THEN 'O' ELSE '' END AS first FROM lineitem GROUP BY 1""",
    ),
    "unique_quotes": (
        unique_quotes,
        """WITH d AS (SELECT doc_id, text, substr(text, 10, 4) AS q FROM documents),
        c AS (SELECT doc_id, text, q, CASE WHEN len(q) > 0 THEN len(list_filter(range(len(text)), lambda i: substr(text, i + 1, len(q)) = q)) ELSE 0 END AS n FROM d)
        SELECT doc_id AS document_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n = 1 THEN instr(text, q) - 1 END AS start FROM c""",
    ),
    "active_sessions": (
        active_sessions,
        """SELECT event_id, user_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'error' AND c_acctbal >= 0
        AND ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-15 12:00:00' AND ts + INTERVAL 8 HOUR > TIMESTAMP '2024-01-15 12:00:00'""",
    ),
    "next_job": (next_job, "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1"),
    "recent_audit": (recent_audit, "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000"),
}
