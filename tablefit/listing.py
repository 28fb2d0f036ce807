"""Column lists of the rental-listing table: how it is cleaned and modelled."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablefit.functions import features as feat
from tablefit.operators.grouping import Group
from tablefit.specs import CleanSpec, FeatureSpec, Range

# Room types, column names, ranges and group sizes must be these
# for the results to be comparable.

ROOM_TYPES = ["Entire home/apt", "Private room", "Shared room", "Hotel room"]

CATEGORIES = ["property_type", "neighbourhood_cleansed", "cancellation_policy", "bed_type"]

NUMBERS = """
latitude longitude accommodates bathrooms bedrooms beds guests_included
minimum_nights maximum_nights
availability_30 availability_60 availability_90 availability_365
number_of_reviews
review_scores_rating review_scores_accuracy review_scores_cleanliness
review_scores_checkin review_scores_communication review_scores_location
review_scores_value
calculated_host_listings_count reviews_per_month
minimum_minimum_nights maximum_minimum_nights
minimum_maximum_nights maximum_maximum_nights
minimum_nights_avg_ntm maximum_nights_avg_ntm
number_of_reviews_ltm
calculated_host_listings_count_entire_homes
calculated_host_listings_count_private_rooms
calculated_host_listings_count_shared_rooms
""".split()

CURRENCIES = """
price weekly_price monthly_price security_deposit cleaning_fee extra_people
""".split()

FLAGS = """
host_is_superhost host_has_profile_pic host_identity_verified is_location_exact
has_availability instant_bookable is_business_travel_ready
require_guest_profile_picture require_guest_phone_verification
""".split()

LISTING_CLEAN = CleanSpec(
    strings=["listing_id", "host_id", "room_type"],
    dates=["last_scraped", "host_since"],
    categories=CATEGORIES,
    numbers=NUMBERS,
    currencies=CURRENCIES,
    flags=FLAGS,
    snapshot_date="last_scraped",
    snapshot_month="month",
    keep_column="room_type",
    keep_values=ROOM_TYPES,
    order="""
    source_file snapshot_year snapshot_month listing_id host_id last_scraped
    host_since room_type
    """.split(),
    renamed={"listing_id": "id"},
)

MODEL_CATEGORIES = """
room_type property_type_grouped neighbourhood_grouped cancellation_policy bed_type
""".split()

MODEL_NUMBERS = """
snapshot_year snapshot_month
latitude longitude accommodates bathrooms bedrooms beds guests_included
minimum_nights maximum_nights
availability_30 availability_60 availability_90 availability_365
number_of_reviews number_of_reviews_ltm
review_scores_rating review_scores_accuracy review_scores_cleanliness
review_scores_checkin review_scores_communication review_scores_location
review_scores_value
calculated_host_listings_count
calculated_host_listings_count_entire_homes
calculated_host_listings_count_private_rooms
calculated_host_listings_count_shared_rooms
reviews_per_month
host_is_superhost host_has_profile_pic host_identity_verified is_location_exact
has_availability instant_bookable
require_guest_profile_picture require_guest_phone_verification
has_reviews review_score_missing availability_rate
beds_per_guest bedrooms_per_guest bathrooms_per_guest
host_age_days
log_number_of_reviews log_reviews_per_month log_minimum_nights
log_host_listings_count
""".split()

PRICE_LIKE = "set by the host together with the price"
REPEATS_MINIMUM = "repeats minimum_nights"
REPEATS_MAXIMUM = "repeats maximum_nights"

EXCLUDED = {
    "source_file": "says where the row came from, not what it describes",
    "listing_id": "identifier",
    "host_id": "identifier",
    "last_scraped": "raw date; snapshot_year and snapshot_month stand for it",
    "host_since": "raw date; host_age_days stands for it",
    "property_type": "too many levels; property_type_grouped stands for it",
    "neighbourhood_cleansed": "too many levels; neighbourhood_grouped stands for it",
    "price": "label",
    "weekly_price": PRICE_LIKE,
    "monthly_price": PRICE_LIKE,
    "security_deposit": PRICE_LIKE,
    "cleaning_fee": PRICE_LIKE,
    "extra_people": PRICE_LIKE,
    "minimum_minimum_nights": REPEATS_MINIMUM,
    "maximum_minimum_nights": REPEATS_MINIMUM,
    "minimum_maximum_nights": REPEATS_MAXIMUM,
    "maximum_maximum_nights": REPEATS_MAXIMUM,
    "minimum_nights_avg_ntm": REPEATS_MINIMUM,
    "maximum_nights_avg_ntm": REPEATS_MAXIMUM,
    "is_business_travel_ready": "no longer filled",
}

LISTING_FEATURES = FeatureSpec(
    label="price",
    cats=MODEL_CATEGORIES,
    nums=MODEL_NUMBERS,
    excluded=EXCLUDED,
    ranges=[
        Range("price", 50, 5000),
        Range("accommodates", 1, 20),
        Range("bathrooms", 0, 10, allow_null=True),
        Range("bedrooms", 0, 10, allow_null=True),
        Range("beds", 0, 20, allow_null=True),
    ],
    groups=[
        Group("neighbourhood_cleansed", 20, "neighbourhood_grouped"),
        Group("property_type", 12, "property_type_grouped"),
    ],
    other="outros",
    derived={
        "has_reviews": lambda: feat.flag(F.col("number_of_reviews") > 0),
        "review_score_missing": lambda: feat.missing("review_scores_rating"),
        "availability_rate": lambda: feat.ratio("availability_365", 365.0),
        "beds_per_guest": lambda: feat.safe_ratio("beds", "accommodates"),
        "bedrooms_per_guest": lambda: feat.safe_ratio("bedrooms", "accommodates"),
        "bathrooms_per_guest": lambda: feat.safe_ratio("bathrooms", "accommodates"),
        "host_age_days": lambda: feat.days_between("host_since", "last_scraped"),
        "log_number_of_reviews": lambda: feat.log1p_clipped("number_of_reviews"),
        "log_reviews_per_month": lambda: feat.log1p_clipped("reviews_per_month"),
        "log_minimum_nights": lambda: feat.log1p_clipped("minimum_nights"),
        "log_host_listings_count": lambda: feat.log1p_clipped("calculated_host_listings_count"),
    },
)
