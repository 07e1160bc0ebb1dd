"""Entity types, their tags, priorities and severities."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (slug, tag, class, priority).
ENTITY_TYPES = (
    ("person", "PERSON", "general", 90),
    ("phone", "PHONE", "general", 100),
    ("email", "EMAIL", "general", 100),
    ("identifier", "ID", "general", 95),
    ("address", "ADDRESS", "general", 95),
    ("credential", "CREDENTIAL", "general", 70),
    ("ip_address", "IP", "general", 100),
    ("url", "URL", "general", 100),
    ("local_path", "LOCAL_PATH", "general", 100),
    ("medical", "MEDICAL", "general", 90),
    ("org", "ORG", "general", 90),
    ("financial", "FINANCE", "computable", 85),
    ("temporal", "DATE", "computable", 85),
    ("percentage", "PERCENTAGE", "computable", 85),
    ("amount", "AMOUNT", "computable", 55),
    ("measurement", "METRIC", "computable", 60),
    ("value", "VALUE", "computable", 50),
)
TAGS = {slug: tag for slug, tag, _, _ in ENTITY_TYPES}
SLUGS = {tag: slug for slug, tag, _, _ in ENTITY_TYPES}
PRIORITY = {slug: p for slug, _, _, p in ENTITY_TYPES}
COMPUTABLE = frozenset(slug for slug, _, kind, _ in ENTITY_TYPES if kind == "computable")
#: Tags whose surfaces may be parts of one another, as names are.
ALIAS_TAGS = ("PERSON", "ORG")
#: Labels of recognised image regions and their tags.
VISUAL_LABELS = {"person": "PERSON", "phone": "PHONE", "email": "EMAIL", "address": "ADDRESS", "amount": "FINANCE", "date": "DATE", "invoice_number": "ID", "transaction_id": "ID"}


def _map(table: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))


def tag_of(slug: Column) -> Column:
    """Tag of an entity type, ENTITY for an unknown one."""
    return F.coalesce(F.try_element_at(_map(TAGS), slug), F.lit("ENTITY"))


def slug_of(tag: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(SLUGS), tag), F.lower(tag))


def priority_of(slug: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(PRIORITY), slug), F.lit(0))


def severity_of(slug: Column) -> Column:
    """high for a known type, medium for any other."""
    return F.when(slug.isin(*TAGS), F.lit("high")).otherwise(F.lit("medium"))


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, "high") for row in ENTITY_TYPES], "slug string, tag string, class string, priority int, severity string")
