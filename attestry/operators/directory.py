"""The directory in normal form: one row per listing and one table per repeated part.

Long child tables keep a listing with very many phones or services from
becoming one oversized row, and let every operator aggregate with partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Directory:
    listing: DataFrame            # id, name, status, website, email, verified_at, ...
    phone: DataFrame              # listing_id, pos, phone_id, number, service_type, country_code
    address: DataFrame            # listing_id, pos, address_1, city, state_province, postal_code
    service: DataFrame            # listing_id, service_id, name
    service_category: DataFrame   # service_id, category_id, name
    listing_category: DataFrame   # listing_id, category_id, name
    schedule_day: DataFrame       # listing_id, day, opens_at, closes_at


def from_documents(docs: DataFrame) -> Directory:
    """Split landed listing documents into the normal form; each split is a narrow explode."""
    d = docs.filter(F.col("id").isNotNull())

    def each(column: str):
        return d.select(F.col("id").alias("listing_id"), F.posexplode(column).alias("pos", "e"))

    services = each("services")
    names = F.concat_ws(" ", F.transform(F.coalesce("categories", F.array()),
                                         lambda c: F.coalesce(c["name"], F.lit(""))))
    return Directory(
        listing=d.select(
            "id", "name", "status", "website", "email", "verified_at", "certified_at",
            "certified", "updated_at", F.col("schedule.hours_known").alias("hours_known"),
            names.alias("category_names")),
        phone=each("phones").select(
            "listing_id", "pos", F.col("e.id").alias("phone_id"), "e.number", "e.service_type",
            "e.country_code"),
        address=each("addresses").select(
            "listing_id", "pos", "e.address_1", "e.city", "e.state_province", "e.postal_code"),
        service=services.select("listing_id", F.col("e.id").alias("service_id"), "e.name"),
        service_category=services.select(
            F.col("e.id").alias("service_id"), F.explode("e.categories").alias("c"))
        .select("service_id", F.col("c.id").alias("category_id"), "c.name"),
        listing_category=each("categories").select(
            "listing_id", F.col("e.id").alias("category_id"), "e.name"),
        schedule_day=each("schedule.schedule_days").select(
            "listing_id", "e.day", "e.opens_at", "e.closes_at"),
    )
