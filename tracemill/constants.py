"""Fixed values of the location-history domain: distances in metres, times in seconds, speeds in km/h."""

STAY_RADIUS, STAY_MIN = 150.0, 480
MERGE_RADIUS, MERGE_GAP = 250.0, 10_800
WALK_MAX, CYCLE_MAX, FLY_MIN = 7.0, 25.0, 140.0
ACCURACY_MAX = 100.0
LEG_MIN_DISTANCE, LEG_MAX_GAP = 20.0, 1800
TRIP_MIN, AWAY_GAP, NEAR_HOME, BLANK_GAP = 21_600, 28_800, 15_000.0, 86_400
CHAIN_PAUSE = 7200
ISLAND_HOP = 310.0  # a hop beyond twice the stay radius always ends a stay; the rest is margin
EARTH_RADIUS = 6_371_000.0
PLACE_RADIUS, SIMILAR_RADIUS = 300.0, 2000.0
PHOTO_GAP, PHOTO_DISTANCE, PHOTO_DEDUPE = 21_600, 1000.0, 2000.0
STATIONARY_RADIUS = 400.0
SPEED_CEILINGS = {
    "walking": 25, "cycling": 60, "driving": 180, "taxi": 150, "bus": 130, "train": 350,
    "subway": 100, "tram": 80, "ferry": 90, "boating": 80, "flying": 1200,
}
WORLD_COUNTRIES, MOON_DISTANCE, YEAR_DAYS = 195, 384_400_000.0, 365.25
RAIL_MARGIN_MIN, RAIL_MARGIN_MAX = 0.15, 2.5  # degrees
