"""Whether adverts are still there, from the responses to their URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import once
from ..functions.text import norm

# Phrases of pages of adverts that are gone, and paths that a gone advert redirects to.
DEAD_MARKERS = (
    "ya fue arrendado", "ya fue rentado", "propiedad arrendada", "inmueble arrendado", "no disponible", "ya no esta disponible", "ya no se encuentra disponible", "propiedad no encontrada",
    "inmueble no encontrado", "aviso no disponible", "publicacion finalizada", "este inmueble no esta disponible", "este inmueble ya no se encuentra", "publicacion no disponible",
    "el inmueble que buscas no", "error-404", "pagina no encontrada", "404 not found",
)
SEARCH_PATHS = ("/arriendo", "/buscar", "/search", "/s/", "error-404", "/404")


def verdicts(responses: DataFrame, markers: tuple[str, ...] = DEAD_MARKERS) -> DataFrame:
    """url, is_active, reason, status of responses(url, final_url, status, body, error); the first rule that fits decides."""
    final = F.coalesce("final_url", "url")
    path = F.lower(F.try_parse_url(final, F.lit("PATH")))
    moved = (final != F.col("url")) & path.isNotNull() & (path.isin("", "/") | reduce(lambda a, b: a | b, (F.contains(path, F.lit(p)) for p in SEARCH_PATHS)))
    marker = once(norm(F.col("body")), lambda text: F.get(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)), F.lit(0)))
    status = F.col("status").cast("string")
    said = (  # fixed values: the texts of the reasons
        F.when(F.col("error").isNotNull(), F.concat(F.lit("fetch error (kept): "), "error"))
        .when(F.col("status").isin(404, 410), F.concat(F.lit("HTTP "), status))
        .when(moved, "redirected to search/index")
        .when(F.col("status") >= 500, F.concat(F.lit("server "), status, F.lit(" (kept)")))
    )
    read = F.coalesce(F.concat(F.lit('marker: "'), marker, F.lit('"')), F.lit("ok"))  # bodies are read only where nothing else decides
    judged = responses.withColumn("reason", said.otherwise(read))
    dead = F.col("reason").rlike(r"^(HTTP|redirected|marker)")
    return judged.select("url", (~dead).alias("is_active"), "reason", "status")


def mark_dead(snapshot: DataFrame, judged: DataFrame, now) -> DataFrame:
    """The snapshot with dead URLs inactive and their last_verified_at set."""
    dead = judged.where("not is_active").select("url").distinct().withColumn("_dead", F.lit(True))
    joined = snapshot.join(dead, "url", "left")
    hit = F.col("_dead").isNotNull()
    return joined.withColumn("is_active", F.col("is_active") & ~hit).withColumn("last_verified_at", F.when(hit, now).otherwise(F.col("last_verified_at"))).select(*snapshot.columns)


def with_verdicts(listings: DataFrame, judged: DataFrame) -> DataFrame:
    """Listings with verdict, the reason of their URL's judgement; null where there is none."""
    said = judged.groupBy("url").agg(F.min("reason").alias("verdict"))
    return listings.join(said, "url", "left").select(*listings.columns, "verdict")
