"""Small frames for tests."""

from hearthline.schemas import LISTING

_n = 0


def make(**over):
    """One listing as a dict, with usual values."""
    global _n
    _n += 1
    base = {"source": "test", "source_listing_id": f"t{_n}", "url": f"https://example.com/{_n}", "title": None, "barrio": "Pance", "conjunto": None, "city": "Cali", "address": None, "lat": 3.4, "lng": -76.53, "geocode_precision": "source", "area_m2": 100.0, "bedrooms": 3, "bathrooms": 2, "parking": 1, "price": 2_000_000.0, "admin": 0.0, "estrato": 4, "currency": "COP", "agency": None, "phone": None, "has_whatsapp": False, "raw_json": None}
    return base | over


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r[f] for f in LISTING.names) for r in rows], LISTING)
