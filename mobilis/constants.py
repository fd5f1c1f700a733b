"""Fixed values that results depend on.

FIXED VALUES -- these must stay exactly as written; ride fares, surge scores
and peak flags are defined by them.
"""

# Tariff per (service, vehicle_type): base, per_km, per_min, booking_fee.
TARIFF = [
    ("uber", "mini", 45.0, 12.0, 1.0, 0.0),
    ("uber", "prime", 70.0, 16.0, 1.5, 0.0),
    ("uber", "auto", 35.0, 8.0, 0.5, 0.0),
    ("uber", "moto", 25.0, 6.0, 0.3, 0.0),
    ("ola", "mini", 40.0, 11.0, 0.9, 5.0),
    ("ola", "prime", 65.0, 15.0, 1.3, 5.0),
    ("ola", "auto", 30.0, 7.0, 0.4, 0.0),
    ("ola", "bike", 20.0, 5.0, 0.2, 0.0),
    ("rapido", "bike", 20.0, 4.0, 0.2, 0.0),
]

# High-surge areas per city: centre lat, centre lon, radius km, multiplier.
SURGE_AREAS = [
    ("delhi", 28.6139, 77.2090, 3.0, 0.3),
    ("delhi", 28.5562, 77.1000, 2.0, 0.4),
    ("delhi", 28.5355, 77.3910, 3.0, 0.3),
    ("delhi", 28.4595, 77.0266, 3.0, 0.3),
    ("delhi", 28.7041, 77.1025, 2.0, 0.2),
    ("bangalore", 12.9716, 77.5946, 3.0, 0.3),
    ("bangalore", 12.9784, 77.6408, 2.0, 0.4),
    ("bangalore", 12.9279, 77.6271, 2.0, 0.3),
    ("bangalore", 13.0359, 77.5970, 3.0, 0.3),
    ("bangalore", 12.9538, 77.4907, 2.0, 0.2),
]

# Festival dates: (month, [days], added surge). At most one entry per month,
# so a (month, day) lookup is exclusive like the original if/elif chain.
FESTIVAL_DATES = [
    (1, [1, 14, 26], 0.8),
    (3, [10, 11, 12, 13], 1.2),
    (8, [15, 19, 30], 0.7),
    (9, [7, 8, 9, 17], 0.9),
    (10, [12, 13, 14, 15, 23, 24, 31], 1.0),
    (11, [1, 2, 3, 4, 12, 13, 14], 1.5),
    (12, [24, 25, 31], 1.0),
]

# City-specific monthly extras, added on top of festival dates.
CITY_MONTH_SURGE = [
    ("delhi", 10, 0.3),
    ("bangalore", 8, 0.4),
    ("bangalore", 4, 0.3),
]

# Time-of-day surge bands, checked in this order (first match wins).
PEAK_BANDS = [(8, 11), (16, 21)]          # +0.4
LUNCH_BAND = (13, 15)                     # +0.2
LATE_NIGHT_FROM, LATE_NIGHT_TO = 22, 2    # +0.5 (hour >= 22 or hour <= 2)
PEAK_SURGE, LUNCH_SURGE, LATE_NIGHT_SURGE = 0.4, 0.2, 0.5
WEEKEND_SURGE, FRIDAY_EVENING_SURGE, FRIDAY_EVENING_FROM = 0.3, 0.2, 16
MONSOON_MONTHS, MONSOON_SURGE, BAD_WEATHER_SURGE = (6, 9), 0.3, 0.4
SURGE_MIN, SURGE_MAX = 1.0, 5.0

# Peak hours inside a ride record's demand struct (differs from PEAK_BANDS).
RECORD_PEAK_BANDS = [(7, 10), (17, 20)]

EARTH_RADIUS_KM = 6371.0
URBAN_SPEED_KMH = 25.0
MIN_TRIP_MINUTES = 5

# Ride outlier filter: all bounds are strict.
RIDE_KM_RANGE = (0.5, 100.0)
RIDE_FARE_RANGE = (10.0, 5000.0)
RIDE_MIN_RANGE = (1.0, 180.0)

# Transit rules.
SERVICE_TIME_PATTERN = r"^\d{1,2}:\d{2}:\d{2}$"
MALFORMED_TIME = "00:00:00"
HEADWAY_MAX_SECONDS = 3600
HIGH_FREQUENCY_TRIPS = 100      # routes with more trips are "high"
LOW_FREQUENCY_TRIPS = 50        # routes with fewer trips are "low"
HUB_MIN_ROUTES = 5
ON_TIME_HEADWAY_MIN = 15
HIGH_FREQ_HEADWAY_MIN = 5
STRENGTH_TRIPS_PER_ROUTE = 50
STRENGTH_HEADWAY_MIN = 10

# Assessment texts.
TEXT_TOP_FEATURES = "Top predictive features: "
TEXT_HIGH_FREQUENCY = "High frequency service coverage"
TEXT_RAISE_FREQUENCY = "Consider increasing service frequency"
TEXT_GOOD_HEADWAY = "Good headway consistency"
TEXT_IMPROVE_HEADWAY = "Improve headway consistency"

# Weekday flag columns that the zero-value check skips.
WEEKDAY_COLUMNS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

# Feed files each city must have, and required columns per table.
REQUIRED_FEED_FILES = ["agency.txt", "calendar.txt", "routes.txt", "stop_times.txt", "stops.txt", "trips.txt"]
REQUIRED_COLUMNS = {
    "routes": ["route_id", "route_short_name", "route_long_name"],
    "trips": ["trip_id", "route_id", "service_id"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence", "arrival_time"],
    "agency": ["agency_id", "agency_name", "agency_timezone"],
}
ESSENTIAL_TABLES = ["routes", "trips", "stop_times", "stops"]
LARGE_TABLE_ROWS = 100000

# Model feature columns, in assembler order.
MODEL_FEATURES = ["hour_of_day", "is_weekend", "is_peak_hour", "ride_count", "avg_fare",
                  "avg_price_per_km", "avg_distance_km", "avg_duration_mins", "demand_index"]
HIGH_SURGE_THRESHOLD = 1.5
PEAK_DEMAND_WEIGHT = 1.5
