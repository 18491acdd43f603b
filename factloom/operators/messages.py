"""What a reader is told about each outcome of a comparison, and the identity of a whole report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One sentence for each reason code.
REASONS = (
    ("record_not_validated", "Doğrulanmamış kayıt karşılaştırmaya alınamaz."),
    ("product_family_unknown", "Ürün ailesi yeterince belirli değil."),
    ("product_family_mismatch", "Ürün aileleri farklı."),
    ("currency_context_unknown", "Ürün para birimi bilinmiyor."),
    ("currency_context_mismatch", "Ürün para birimleri farklı."),
    ("customer_segment_context_unknown", "Kanonik müşteri segmenti bilinmiyor."),
    ("customer_segment_context_mismatch", "Müşteri segmentleri farklı."),
    ("sales_channel_context_unknown", "Satış kanalı bilinmiyor."),
    ("sales_channel_context_mismatch", "Satış kanalları farklı."),
    ("new_customer_context_unknown", "Yeni müşteri koşulu bilinmiyor."),
    ("new_customer_context_mismatch", "Yeni müşteri koşulları farklı."),
    ("product_mechanism_context_unknown", "Ürün mekanizması bilinmiyor."),
    ("product_mechanism_context_mismatch", "Ürün mekanizmaları farklı."),
    ("security_context_unknown", "Teminat bağlamı bilinmiyor."),
    ("security_context_mismatch", "Teminat bağlamları farklı."),
    ("as_of_required", "Geçerlilik kontrolü için karşılaştırma tarihi gerekli."),
    ("not_observed_as_of", "Kayıt seçilen tarihte henüz gözlemlenmemişti."),
    ("validity_unknown", "Kampanya geçerliliği bilinmiyor."),
    ("campaign_not_active_as_of", "Kampanya seçilen tarihte aktif değil."),
    ("rate_missing", "Oran bilgisi eksik."),
    ("peer_rate_missing", "Karşılaştırılan kampanyalardan birinin oranı eksik."),
    ("rate_evidence_missing", "Oran için alan düzeyinde kanıt yok."),
    ("peer_rate_evidence_missing", "Karşılaştırılan bir oranın alan düzeyinde kanıtı yok."),
    ("rate_kind_unknown", "Oran türü bilinmiyor."),
    ("rate_period_unknown", "Oran dönemi bilinmiyor."),
    ("rate_basis_unknown", "Oran bazı bilinmiyor."),
    ("rate_term_context_unknown", "Oranın bağlı olduğu vade bilinmiyor."),
    ("rate_gross_net_basis_unknown", "Oranın brüt/net bazı bilinmiyor."),
    ("rate_reference_window_unknown", "Tarihsel oranın referans dönemi bilinmiyor."),
    ("rate_kind_mismatch", "Oran türleri farklı."),
    ("rate_period_mismatch", "Oran dönemleri farklı."),
    ("rate_basis_mismatch", "Oran bazları farklı."),
    ("multiple_rate_signatures", "Birden fazla ortak oran imzası var; açık seçim gerekli."),
    ("multiple_rate_values_for_signature", "Aynı oran imzası için birden fazla değer var."),
    ("term_missing", "Vade bilgisi eksik."),
    ("peer_term_missing", "Karşılaştırılan kampanyalardan birinin vadesi eksik."),
    ("term_evidence_missing", "Vade için alan düzeyinde kanıt yok."),
    ("peer_term_evidence_missing", "Karşılaştırılan bir vadenin alan düzeyinde kanıtı yok."),
    ("term_ambiguous", "Vade bilgisi belirsiz."),
    ("fee_missing", "Ücret bilgisi eksik; sıfır kabul edilmedi."),
    ("peer_fee_missing", "Karşılaştırılan kampanyalardan birinin ücreti eksik."),
    ("fee_evidence_missing", "Ücret için alan düzeyinde kanıt yok."),
    ("peer_fee_evidence_missing", "Karşılaştırılan bir ücretin alan düzeyinde kanıtı yok."),
    ("fee_kind_unknown", "Ücret türü bilinmiyor."),
    ("fee_basis_unknown", "Ücret bazı bilinmiyor."),
    ("fee_not_numeric", "Ücret sayısal olarak karşılaştırılamıyor."),
    ("fee_rate_context_unknown", "Oransal ücretin dönem veya baz bağlamı bilinmiyor."),
    ("fee_kind_mismatch", "Ücret türleri farklı."),
    ("fee_basis_mismatch", "Ücret bazları farklı."),
    ("fee_currency_mismatch", "Ücret para birimleri farklı."),
    ("fee_value_type_mismatch", "Ücret değer türleri farklı."),
    ("multiple_fee_signatures", "Birden fazla ortak ücret imzası var; açık seçim gerekli."),
    ("reward_missing", "Ödül bilgisi eksik."),
    ("peer_reward_missing", "Karşılaştırılan kampanyalardan birinin ödülü eksik."),
    ("reward_evidence_missing", "Ödül için alan düzeyinde kanıt yok."),
    ("peer_reward_evidence_missing", "Karşılaştırılan bir ödülün alan düzeyinde kanıtı yok."),
    ("reward_basis_unknown", "Ödül bazı bilinmiyor."),
    ("reward_program_unknown", "Puan programı bilinmiyor."),
    ("reward_not_numeric", "Ödül sayısal olarak karşılaştırılamıyor."),
    ("reward_rate_context_unknown", "Oransal ödülün oran bağlamı bilinmiyor."),
    ("reward_kind_mismatch", "Ödül türleri farklı."),
    ("reward_basis_mismatch", "Ödül bazları farklı."),
    ("reward_program_mismatch", "Ödül programları farklı."),
    ("reward_context_mismatch", "Ödül eşik veya üst sınırları farklı."),
    ("multiple_reward_signatures", "Birden fazla ortak ödül imzası var; açık seçim gerekli."),
    ("eligibility_evidence_missing", "Uygunluk bağlamı için alan düzeyinde kanıt yok."),
    ("peer_eligibility_evidence_missing", "Karşılaştırılan bir uygunluk bağlamının kanıtı yok."),
    ("eligibility_context_compatible", "Kanonik uygunluk eksenleri uyumlu; sayısal sıralama yapılmadı."),
    ("ranked_lower_is_better", "Aynı bazdaki daha düşük değer bu boyutta önce gelir."),
    ("ranked_higher_is_better", "Aynı bazdaki daha yüksek değer bu boyutta önce gelir."),
)


def explanation(reason_code: Column) -> Column:
    """The sentence of a reason code; a code without one is null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in REASONS for x in pair)), reason_code)


def plain_number(value: Column) -> Column:
    """A decimal as text without trailing zeros or an exponent; zero is 0."""
    text = value.cast("decimal(38,12)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, "0").otherwise(trimmed)


def report_identity(outcomes: DataFrame, ruleset: str, as_of: Column) -> DataFrame:
    """(request, canonical_sha256): the hash of a whole report as JSON, its outcomes in the order (position, dimension).

    ``outcomes``: request, position, record, dimension, comparable, rank, value, unit, reason_code, evidence_ids; ``as_of`` is a column of them. Whatever
    order the rows came in, equal reports have one identity.
    """
    item = F.struct(
        F.col("record").cast("string").alias("campaign_id"), plain_number(F.col("value")).alias("canonical_value"), "comparable", "dimension", F.array_sort(F.coalesce("evidence_ids", F.array().cast("array<string>"))).alias("evidence_ids"), "rank", "reason_code", "unit",
    )
    listed = outcomes.groupBy("request").agg(F.min(as_of).cast("string").alias("as_of"), F.transform(F.array_sort(F.collect_list(F.struct("position", "dimension", item.alias("item")))), lambda x: x["item"]).alias("items"))
    whole = F.to_json(F.struct("as_of", "items", F.lit(ruleset).alias("ruleset_version")), {"ignoreNullFields": "false"})
    return listed.select("request", F.sha2(whole, 256).alias("canonical_sha256"))
