"""Which of the retrieved records answer a question: keywords, then the kind of financing, then the bank that is named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.normalizers import let
from ..functions.text import fold, words
from .planner import SUBFAMILIES

#: Characters of the shortest keyword that counts.
LEAST = 3
# Fixed values (folded): words at the end of a bank's name that only tell its legal form.
LEGAL_FORMS = ("a", "s", "as", "anonim", "sirketi", "bankasi", "turkiye")


def keyword_hit(tokens: Column, keyword: Column, least: int = LEAST) -> Column:
    """Whether a token and the keyword begin with one another, the shorter with ``least`` characters."""
    return F.exists(tokens, lambda w: (F.startswith(w, keyword) | F.startswith(keyword, w)) & (F.least(F.length(w), F.length(keyword)) >= least))


def bank_keys(bank_id: Column, bank_name: Column, legal_forms: tuple[str, ...] = LEGAL_FORMS) -> Column:
    """Forms by which a question may name a bank: its id, its name, and its name without the legal form at its end."""

    def short(tokens: Column) -> Column:
        kept = F.array_position(F.transform(F.reverse(tokens), lambda t: ~t.isin(*legal_forms)), True)
        return F.when(kept > 0, F.array_join(F.slice(tokens, 1, F.size(tokens) - kept.cast("int") + 1), " ")).otherwise("")

    names = let(words(bank_name), lambda tokens: F.array(F.array_join(tokens, " "), short(tokens)))
    return F.array_distinct(F.filter(F.concat(F.array(fold(F.replace(bank_id, F.lit("-"), F.lit(" ")))), names), lambda k: k != ""))


def selected(requests: DataFrame, records: DataFrame, least: int = LEAST) -> DataFrame:
    """(request, record, nth, score): the records of each request that answer it, best first.

    ``requests``: request, question, keywords and dimensions (arrays), structured (whether it filters by bank, family or type), most. ``records``:
    request, record, bank_id, bank_name, tokens (folded words), present (dimensions in its data), observed_at.

    Records with all keywords, else, only under a structured filter, those with any, else all of them. A question that names a kind of financing keeps
    only records that name it, none if there are none. If it names banks that are among the rest, only theirs stay. The score is three for each
    asked dimension that is there and one for each keyword; then the newest, then the smallest record.
    """
    own = requests.withColumns({
        "_question": F.concat(F.lit(" "), fold(F.coalesce("question", F.lit(""))), F.lit(" ")), "_keys": F.filter(F.transform("keywords", lambda k: fold(k)), lambda k: F.length(k) >= least),
    })
    own = own.withColumn("_kinds", F.array_compact(F.array(*(F.when(F.col("_question").rlike(rf"\b{s}"), s) for s in SUBFAMILIES))))
    both = own.join(records, "request").withColumn("_hits", F.size(F.filter("_keys", lambda k: keyword_hit(F.col("tokens"), k, least))))
    request = Window.partitionBy("request")
    tier = F.when(F.col("_hits") == F.size("_keys"), 0).when(~F.col("structured"), None).when(F.col("_hits") > 0, 1).otherwise(2)
    ranked = both.withColumn("_tier", tier).where("_tier IS NOT NULL").withColumn("_best", F.min("_tier").over(request))
    kept = ranked.where("_tier = _best").where((F.size("_kinds") == 0) | F.exists("_kinds", lambda s: keyword_hit(F.col("tokens"), s, least)))
    named = F.exists(bank_keys(F.col("bank_id"), F.col("bank_name")), lambda k: F.contains(F.col("_question"), F.concat(F.lit(" "), k, F.lit(" "))))
    of_bank = kept.withColumn("_named", named).withColumn("_some", F.max(F.col("_named").cast("int")).over(request)).where("_named OR _some = 0")
    score = 3 * F.size(F.filter("dimensions", lambda d: F.array_contains("present", d))) + F.col("_hits")
    scored = of_bank.withColumn("score", score)
    nth = F.row_number().over(request.orderBy(F.desc("score"), F.desc("observed_at"), F.asc("record")))
    return scored.withColumn("nth", nth).where(F.col("nth") <= F.col("most")).select("request", "record", "nth", "score")
