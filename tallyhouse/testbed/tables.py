"""All layers over one data directory.

As in any lakehouse the raw tables, the clean and quarantine tables and the star
schema are stored: each is written once per session, in the shared folder, when
a query first needs it. Standardised and tagged rows stay lazy, and
``lazy_star`` computes the star schema as one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession

from ..plans import cleanse, retrieval, standardise
from ..plans.star import Star
from ..sources.entities import ENTITIES
from ..sources.store import work_dir, write_files
from .landing import write_landing
from .raw import raw_frame


class Lazily(Mapping):
    """Tables by name, each made when it is first looked up, so a query stores only the tables it needs."""

    def __init__(self, names: Iterable[str], make: Callable[[str], DataFrame]):
        self.names, self.make = list(names), make

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return self.make(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


class Tables:
    """Benchmark tables and everything derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cache
    def raw(self, entity: str) -> DataFrame:
        return write_files(raw_frame(self.spark, self.sf_dir, entity), self.folder(f"raw_{entity}"))

    @cached_property
    def all_raw(self) -> Mapping[str, DataFrame]:
        return Lazily(ENTITIES, self.raw)

    @cache
    def std(self, entity: str) -> DataFrame:
        return standardise.STANDARDISE[entity](self.raw(entity))

    @cache
    def clean(self, entity: str) -> DataFrame:
        return write_files(cleanse.clean(self.raw(entity), entity), self.folder(f"clean_{entity}"))

    @cached_property
    def all_clean(self) -> Mapping[str, DataFrame]:
        return Lazily(ENTITIES, self.clean)

    @cache
    def quarantine(self, entity: str) -> DataFrame:
        return write_files(cleanse.quarantine(self.raw(entity), entity), self.folder(f"quarantine_{entity}"))

    @cached_property
    def all_quarantine(self) -> Mapping[str, DataFrame]:
        return Lazily(ENTITIES, self.quarantine)

    @cache
    def star(self, region_source: str = "customer") -> Star:
        return Star(self.all_clean, region_source, lambda df, name: write_files(df, self.folder(name)))

    @cache
    def lazy_star(self, region_source: str = "customer") -> Star:
        return Star(self.all_clean, region_source)

    @cached_property
    def documents(self) -> DataFrame:
        """Rendered documents; retrieval reads them several times."""
        return write_files(retrieval.documents(self.star()), self.folder("documents"))

    @cached_property
    def _landing_root(self) -> str:
        return work_dir(self.spark, "landing")

    @cache
    def landed(self, entity: str) -> str:
        """Where the regional files of an entity are, written once per session; those of others may be missing there."""
        return write_landing(self.spark, self.sf_dir, self._landing_root, [entity])

    @property
    def landing(self) -> str:
        """Regional files of all entities."""
        return [self.landed(e) for e in ENTITIES][0]

    def folder(self, name: str) -> str:
        return work_dir(self.spark, name)


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, str(sf_dir))
    return _OPEN[key]
