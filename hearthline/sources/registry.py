"""The known sources, and which of them a crawl takes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_folder
from . import html_portals, json_portals
from .stored import write_payloads


class Normalizer(Protocol):
    """The one extension point: payloads of a source (schemas.PAYLOAD) to listings (schemas.LISTING)."""

    def __call__(self, payloads: DataFrame) -> DataFrame: ...


class Source(NamedTuple):
    id: str
    label: str
    tier: str
    domain: str
    normalize: Callable[[DataFrame], DataFrame]


# Ids, labels, tiers (C: hard to reach) and domains of the sources.
SOURCES: tuple[Source, ...] = (
    Source("bienco", "Bienco", "A", "bienco.com.co", json_portals.bienco),
    Source("fincaraiz", "FincaRaíz", "A", "fincaraiz.com.co", json_portals.fincaraiz),
    Source("ciencuadras", "Ciencuadras", "A", "ciencuadras.com", json_portals.ciencuadras),
    Source("properati", "Properati", "A", "properati.com.co", html_portals.properati),
    Source("rentola", "Rentola", "A", "rentola.co.com", html_portals.rentola),
    Source("inmobiliariajr", "Inmobiliaria JR", "A", "inmobiliariajr.com.co", json_portals.inmobiliariajr),
    Source("inmoalfaguara", "Inmobiliaria Alfaguara", "A", "inmoalfaguara.co", html_portals.inmoalfaguara),
    Source("naranjoduque", "Inmobiliaria Naranjo Duque", "A", "inmobiliarianaranjoduque.com", html_portals.naranjoduque),
    Source("elpaisfincaraiz", "FincaRaíz El País", "A", "fincaraiz.elpais.com.co", html_portals.elpaisfincaraiz),
    Source("mitula", "Mitula (agregador)", "B", "casas.mitula.com.co", html_portals.mitula),
    Source("metrocuadrado", "Metrocuadrado", "C", "metrocuadrado.com", json_portals.metrocuadrado),
    Source("arriendo", "Arriendo.com", "A", "arriendo.com", html_portals.arriendo),
    Source("century21", "Century 21 Colombia", "B", "century21colombia.com", html_portals.century21),
)


def select_sources(only: Iterable[str] = (), hard: bool = False) -> tuple[Source, ...]:
    """The named sources whatever their tier, or all but those of tier C unless asked for."""
    wanted = set(only)
    return tuple(s for s in SOURCES if (s.id in wanted if wanted else hard or s.tier != "C"))


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s.id, s.label, s.tier, s.domain) for s in SOURCES], "id string, label string, tier string, domain string")


def route_payloads(payloads: DataFrame, sources: Iterable[Source] = SOURCES) -> DataFrame:
    """The payloads of these sources, read once and written to the shared folder, each source's apart: whoever reads one source then reads
    its own files alone, as of a table that stored.write_payloads wrote. A source with most of all payloads is so many files more."""
    spark = payloads.sparkSession
    wanted = payloads.where(F.col("source").isin(*(s.id for s in sources)))
    path = new_folder(spark, "payloads")
    write_payloads(wanted, path)
    return spark.read.schema(payloads.schema).parquet(path).select(*payloads.columns)


def normalize_all(payloads: DataFrame, sources: Iterable[Source] = SOURCES, agencies: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """The listings of all sources' payloads in one table. agencies(url, agency, phone): whose the adverts of century21 are.

    The payloads are read once and dealt to files by source (route_payloads), unless they come `apart` already, that is from a
    table partitioned by source; each source's normaliser reads its own files.
    """
    sources = tuple(sources)
    payloads = payloads if apart else route_payloads(payloads, sources)
    parts = [s.normalize(payloads.where(F.col("source") == s.id), **({"agencies": agencies} if s.id == "century21" and agencies is not None else {})) for s in sources]
    return reduce(DataFrame.unionByName, parts)
