"""Column contracts of the raw files and the typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Money and rate types of the tables.
MONEY = "decimal(18,6)"
CENTS = "decimal(12,2)"
RATE = "decimal(5,4)"

#: Where a raw row stands: file, split and place, sorting as the rows do in the files.
ROW = "_file_row"

#: Names the text of a review in the table of texts, where reviews don't carry it themselves.
TEXT = "_text"

#: Cells of a raw row that say something their column's type can't hold, with the row's place.
REJECTED = "_rejected"

# Raw columns that are kept, with the type each is read as.
LISTING_COLUMNS = {
    "id": "bigint",
    "host_id": "bigint",
    "host_since": "date",
    "host_is_superhost": "flag",
    "host_response_rate": "percent",
    "host_response_time": "string",
    "host_total_listings_count": "int",
    "host_identity_verified": "flag",
    "neighbourhood_cleansed": "string",
    "neighbourhood_group_cleansed": "string",
    "latitude": "double",
    "longitude": "double",
    "property_type": "string",
    "room_type": "string",
    "accommodates": "int",
    "bathrooms": "double",
    "bathrooms_text": "string",
    "bedrooms": "double",
    "beds": "double",
    "amenities": "string",
    "price": "price",
    "minimum_nights": "int",
    "maximum_nights": "int",
    "availability_365": "int",
    "number_of_reviews": "int",
    "number_of_reviews_ltm": "int",
    "first_review": "date",
    "last_review": "date",
    "review_scores_rating": "double",
    "review_scores_cleanliness": "double",
    "review_scores_checkin": "double",
    "review_scores_communication": "double",
    "review_scores_location": "double",
    "review_scores_value": "double",
    "instant_bookable": "flag",
    "calculated_host_listings_count": "int",
    "reviews_per_month": "double",
}

# Columns whose gaps take the market median.
MEDIAN_FILLED = [
    "bedrooms",
    "beds",
    "bathrooms",
    "review_scores_rating",
    "review_scores_cleanliness",
    "review_scores_checkin",
    "review_scores_communication",
    "review_scores_location",
    "review_scores_value",
    "reviews_per_month",
]

# The five sub-scores behind the composite score.
SUB_SCORES = [
    "review_scores_cleanliness",
    "review_scores_checkin",
    "review_scores_communication",
    "review_scores_location",
    "review_scores_value",
]

CALENDAR_REQUIRED = ["listing_id", "date", "available"]

REVIEW_COLUMNS = ["id", "listing_id", "reviewer_id", "reviewer_name", "date", "comments"]

# Where a field comes from: read as is, computed, or invented by a rule.
SYNTHETIC = {
    "neighbourhood_median_price_per_bedroom",
    "estimated_property_value",
    "estimated_annual_roi_pct",
    "is_synthetic_valuation",
    "valuation_multiplier",
}
RAW = set(LISTING_COLUMNS) | set(REVIEW_COLUMNS) | set(CALENDAR_REQUIRED)


def with_provenance(df: DataFrame) -> DataFrame:
    """Carry RAW / DERIVED / SYNTHETIC in each field's metadata."""

    def origin(name: str) -> str:
        if name in SYNTHETIC:
            return "SYNTHETIC"
        return "RAW" if name in RAW else "DERIVED"

    return df.select(*[F.col(c).alias(c, metadata={"provenance": origin(c)}) for c in df.columns])


# The eight normalised tables: column -> type.
TABLES = {
    "neighbourhoods": {
        "neighbourhood_id": "bigint",
        "neighbourhood_name": "string",
        "neighbourhood_group": "string",
    },
    "hosts": {
        "host_id": "bigint",
        "host_since": "date",
        "is_superhost": "int",
        "response_rate_pct": "decimal(5,2)",
        "response_time": "string",
        "identity_verified": "int",
        "total_listings_count": "int",
        "experience_years": "decimal(4,1)",
        "experience_tier": "string",
    },
    "listings": {
        "listing_id": "bigint",
        "host_id": "bigint",
        "neighbourhood_id": "bigint",
        "property_type": "string",
        "room_type": "string",
        "accommodates": "int",
        "bedrooms": "decimal(3,1)",
        "beds": "decimal(3,1)",
        "bathrooms": "decimal(3,1)",
        "amenity_count": "int",
        "base_price": "decimal(10,2)",
        "price_category": "string",
        "minimum_nights": "int",
        "maximum_nights": "int",
        "instant_bookable": "int",
        "first_review_date": "date",
        "last_review_date": "date",
        "is_stale_listing": "int",
    },
    "listing_performance": {
        "listing_id": "bigint",
        "total_nights_tracked": "int",
        "booked_nights": "int",
        "occupancy_rate": "decimal(5,4)",
        "revenue_estimate": "decimal(14,2)",
        "adr": "decimal(10,2)",
        "revpar": "decimal(10,2)",
        "avg_open_listing_price": "decimal(10,2)",
        "pricing_gap": "decimal(10,2)",
        "pricing_signal": "string",
    },
    "listing_valuation": {
        "listing_id": "bigint",
        "estimated_property_value": "decimal(14,2)",
        "estimated_annual_roi_pct": "decimal(12,2)",
        "is_synthetic_valuation": "int",
        "valuation_multiplier": "int",
    },
    "calendar_daily": {
        "listing_id": "bigint",
        "calendar_date": "date",
        "is_available": "int",
        "price": "decimal(10,2)",
    },
    "reviews": {
        "review_id": "bigint",
        "listing_id": "bigint",
        "reviewer_id": "bigint",
        "reviewer_name": "string",
        "review_date": "date",
        "comments": "string",
    },
    "review_scores": {
        "listing_id": "bigint",
        "rating": "decimal(3,2)",
        "cleanliness": "decimal(3,2)",
        "checkin": "decimal(3,2)",
        "communication": "decimal(3,2)",
        "location_score": "decimal(3,2)",
        "value_score": "decimal(3,2)",
        "composite_score": "decimal(3,2)",
    },
}

# Master columns of the hosts table, with their names there.
HOST_NAMES = {
    "host_id": "host_id",
    "host_since": "host_since",
    "host_is_superhost": "is_superhost",
    "host_response_rate": "response_rate_pct",
    "host_response_time": "response_time",
    "host_identity_verified": "identity_verified",
    "host_total_listings_count": "total_listings_count",
    "host_experience_years": "experience_years",
    "host_experience_tier": "experience_tier",
}

# Master columns of the listings table, with their names there.
LISTING_NAMES = {
    "id": "listing_id",
    "host_id": "host_id",
    "neighbourhood_id": "neighbourhood_id",
    "property_type": "property_type",
    "room_type": "room_type",
    "accommodates": "accommodates",
    "bedrooms": "bedrooms",
    "beds": "beds",
    "bathrooms": "bathrooms",
    "amenity_count": "amenity_count",
    "price": "base_price",
    "price_category": "price_category",
    "minimum_nights": "minimum_nights",
    "maximum_nights": "maximum_nights",
    "instant_bookable": "instant_bookable",
    "first_review": "first_review_date",
    "last_review": "last_review_date",
    "is_stale_listing": "is_stale_listing",
}

# Master columns of the scores table, with their names there.
SCORE_NAMES = {
    "id": "listing_id",
    "review_scores_rating": "rating",
    "review_scores_cleanliness": "cleanliness",
    "review_scores_checkin": "checkin",
    "review_scores_communication": "communication",
    "review_scores_location": "location_score",
    "review_scores_value": "value_score",
    "review_score_composite": "composite_score",
}
