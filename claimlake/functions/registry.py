"""The typed fields of a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Path and kind of every field, in order: fixed values.
FIELDS = [
    ("general.claim_identification.claim_id", "string"), ("general.claim_identification.policy_number", "string"), ("general.claim_identification.date_of_loss", "date"),
    ("general.claim_identification.date_of_report", "date"), ("general.claim_identification.adjuster_handler", "string"), ("general.insured_claimant.insured_name", "string"),
    ("general.insured_claimant.contact_information", "string"), ("general.insured_claimant.relationship_to_policy", "string"), ("general.location.risk_address", "string"),
    ("general.location.site_access_notes", "narrative"), ("general.cause_of_loss.peril_cause", "string"), ("general.cause_of_loss.brief_description", "narrative"),
    ("general.what_happened", "narrative"), ("damages.damaged_items_and_areas", "narrative"), ("damages.occupancy.property_type", "enum"),
    ("damages.occupancy.occupancy_at_time_of_loss", "string"), ("damages.occupancy.use_of_property", "string"), ("financials.reserves.current_total_reserve", "currency"),
    ("financials.reserves.property_damage_reserve", "currency"), ("financials.reserves.business_interruption_reserve", "currency"), ("financials.reserves.other_reserve", "currency"),
    ("financials.estimated_incurred_losses.estimated_total_loss_gross", "currency"), ("financials.estimated_incurred_losses.estimated_total_loss_net", "currency"),
    ("financials.estimated_incurred_losses.property_damage_gross", "currency"), ("financials.estimated_incurred_losses.property_damage_net", "currency"),
    ("financials.estimated_incurred_losses.business_interruption_gross", "currency"), ("financials.estimated_incurred_losses.business_interruption_net", "currency"),
    ("financials.estimated_incurred_losses.extra_expenses", "currency"), ("financials.estimated_incurred_losses.other_losses", "currency"),
    ("financials.applied_deductibles.property_deductible", "currency"), ("financials.applied_deductibles.business_interruption_deductible", "currency"),
    ("coverage.policy_number", "string"), ("coverage.policy_period_start", "date"), ("coverage.policy_period_end", "date"), ("coverage.coverage_type", "string"),
    ("coverage.coverage_limits", "currency"), ("coverage.exclusions_noted", "narrative"),
]


def kind_of(path: Column, extra: dict[str, str] | None = None) -> Column:
    """Kind of a field path, null if it is not registered. A constant map: no join, no shuffle."""
    known = dict(FIELDS) | (extra or {})
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), path)


def field_registry(spark: SparkSession) -> DataFrame:
    """(ord, field_name, kind), one row per field."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("field_name"), F.lit(k).alias("kind")) for i, (n, k) in enumerate(FIELDS)])
    return spark.range(1).select(F.explode(rows).alias("f")).select("f.*")


def labels(spark: SparkSession) -> DataFrame:
    """(ord, field_name, kind, field_label, kind_label): how fields and their kinds are shown."""
    shown = lambda what, c: F.concat(F.lit(f"<{what}:"), F.col(c), F.lit(">"))
    return field_registry(spark).withColumns({"field_label": shown("Field", "field_name"), "kind_label": shown("FieldType", "kind")})


def with_kind(rows: DataFrame, path: str = "path", fallback: str = "string") -> DataFrame:
    """Rows with the kind of their field path; unregistered paths get the fallback."""
    return rows.withColumn("kind", F.coalesce(kind_of(F.col(path)), F.lit(fallback)))
