"""How listings are shown: places, money, states, keys and safe cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import missing
from .text import round_half_up

NONE = "—"


def place(otherwise: str = "") -> Column:
    """Barrio / conjunto, else the address, else a placeholder."""
    both = F.nullif(F.concat_ws(" / ", missing(F.col("barrio")), missing(F.col("conjunto"))), F.lit(""))
    return F.coalesce(both, missing(F.col("address")), F.lit(otherwise))


def effective_km(driving: str = "driving_km", straight: str = "distance_km") -> Column:
    return F.coalesce(F.col(driving), F.col(straight))


def source_label(sources: Column, source: Column) -> Column:
    return F.when(F.size(sources) > 0, F.array_join(sources, "+")).otherwise(source)


def pesos(n: Column) -> Column:
    """$ and dots between thousands; a dash for null."""
    return F.coalesce(F.concat(F.lit("$"), F.translate(F.format_number(F.floor(n + 0.5), 0), ",", ".")), F.lit(NONE))


def decimals(n: Column, digits: int = 0) -> Column:
    """Fixed decimals, halves up; a dash for null."""
    return F.coalesce(F.format_string(f"%.{digits}f", round_half_up(n.cast("double"), digits)), F.lit(NONE))


def approximate(precision: Column) -> Column:
    """Whether a location is only approximate."""
    return F.coalesce(~precision.isin("source", "rooftop"), F.lit(False))


def safe_cell(s: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)


def review_state(seen: Column, eligible: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(eligible), "eligible").when(yes(seen), "seen").otherwise("none")


# The states' names in the interface's language.
STATE_NAMES = {"eligible": "Elegible", "seen": "Vista", "none": "Sin estado"}


def state_name(state: Column) -> Column:
    return reduce(lambda c, kv: F.when(state == kv[0], F.lit(kv[1])).otherwise(c), STATE_NAMES.items(), F.lit(STATE_NAMES["none"]))


def identity_keys(source: Column, listing_id: Column, url: Column, links: Column) -> Column:
    """u:url of every link and of the listing, and s:source:id; distinct, in that order."""
    urls = F.transform(F.coalesce(links, F.array()), lambda x: F.concat(F.lit("u:"), missing(x["url"])))
    own = F.array(F.concat(F.lit("u:"), missing(url)), F.concat_ws(":", F.lit("s"), F.coalesce(source, F.lit("")), F.coalesce(listing_id, F.lit(""))))
    return F.array_distinct(F.array_compact(F.concat(urls, own)))


def search_signature(*parts: Column) -> Column:
    """One text for the parameters of a search."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
