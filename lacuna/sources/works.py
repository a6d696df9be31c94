"""Works as nested JSON records: ingest into the corpus's tables, and a Spark data source that any client can be plugged into.

A record: {"id", "display_name", "publication_year", "cited_by_count", "doi", "abstract_inverted_index": {word: [place]}, "concepts": [{"id",
"display_name", "level", "score"}]}. Ids may be links; their last part counts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from lacuna.functions import text as T
from lacuna.session import stored
from lacuna.sources.corpus import Corpus

RECORD = (
    "id string, display_name string, publication_year int, cited_by_count bigint, doi string, abstract_inverted_index map<string,array<int>>, "
    "concepts array<struct<id:string,display_name:string,level:int,score:double>>, _corrupt string"
)


@dataclass(frozen=True)
class Ingested:
    """works (work, title, text, year, cited, url), work_concepts (work, cid, year, score), concepts (cid, name, level), rejected (value, reason)."""

    works: DataFrame
    work_concepts: DataFrame
    concepts: DataFrame
    rejected: DataFrame

    def corpus(self, **options) -> Corpus:
        return Corpus.from_work_concepts(self.work_concepts.select("work", "cid", "year"), self.concepts, self.works, **options)


def named(mentions: DataFrame) -> DataFrame:
    """(cid, name, level) of every mention -> one row a concept: the first name by code point, the id where there is none, the highest level."""
    name = F.coalesce(F.min(F.nullif(F.trim("name"), F.lit(""))), F.col("cid"))
    return mentions.groupBy("cid").agg(name.alias("name"), F.coalesce(F.max("level"), F.lit(0)).alias("level"))


def ingest(lines: DataFrame, column: str = "value") -> Ingested:
    """Records, one a row of ``column``, parsed once and written to the shared folder; everything else reads what is written.

    Set aside, with a reason: empty rows; what isn't a record of this form ("malformed"), be it one field of a wrong type; records without an
    id. Of several records of a work the most cited counts, then the latest. A work without concepts is a work."""
    record = F.from_json(column, RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select(F.col(column).cast("string").alias("value"), record.alias("r"))
    key = F.nullif(T.short_id(F.col("r.id")), F.lit(""))
    reason = F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "empty").when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "malformed").when(key.isNull(), "no id")
    kept, _ = stored(rows.select(F.when(reason.isNotNull(), F.col("value")).alias("value"), F.when(reason.isNull(), F.col("r")).alias("r"), reason.alias("reason"), key.alias("work")), "records")
    good = kept.where("reason is null")
    title = F.coalesce(F.nullif(F.trim("r.display_name"), F.lit("")), F.lit("(untitled)"))
    doi = F.regexp_replace("r.doi", "^(https?://doi\\.org/|doi:)", "")
    url = F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.col("r.id"))
    best = F.max(F.struct(F.coalesce("r.cited_by_count", F.lit(0)).alias("cited"), F.col("r.publication_year").alias("year"), title.alias("title"), T.rebuilt_abstract(F.col("r.abstract_inverted_index"), 1 << 30).alias("text"), url.alias("url")))
    works = good.groupBy("work").agg(best.alias("w")).select("work", "w.title", "w.text", "w.year", "w.cited", "w.url")
    each = good.select("work", F.col("r.publication_year").alias("year"), F.explode("r.concepts").alias("c"))
    each = each.select("work", F.nullif(T.short_id(F.col("c.id")), F.lit("")).alias("cid"), "year", F.coalesce("c.score", F.lit(0.0)).alias("score"), F.col("c.display_name").alias("name"), "c.level").where("cid is not null")
    mentions = each.groupBy("work", "cid", "year").agg(F.max("score").alias("score"))
    return Ingested(works, mentions, named(each), kept.where("reason is not null").select("value", "reason"))


# --- a source that can be plugged in ------------------------------------------------------------------------------


class WorksClient:
    """What a source has to offer. One's own is a class that takes the reader's options; the format finds it by the option ``client``, as
    "module:Class". ``pages`` runs on the driver, ``records`` in tasks, a page a task, so pages have to be small and picklable."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def pages(self, low: int | None, high: int | None, concepts: frozenset[str] | None) -> list:
        """Pages that hold all works of the years low to high (both included, None: open) that have one of the concepts (None: any)."""
        raise NotImplementedError

    def records(self, page) -> Iterable[str | dict]:
        """The records of a page, as JSON or parsed."""
        raise NotImplementedError


class FolderClient(WorksClient):
    """Files of JSON lines under the option ``path``, in folders named year=... where they are dealt out by year."""

    def pages(self, low, high, concepts) -> list:
        found = []
        for top, folders, files in os.walk(self.options["path"].removeprefix("file:")):
            year = next((p[5:] for p in reversed(top.split(os.sep)) if p.startswith("year=")), None)
            if year is not None and (low, high) != (None, None):
                if not year.lstrip("-").isdigit() or (low is not None and int(year) < low) or (high is not None and int(year) > high):
                    folders.clear()
                    continue
            found += [os.path.join(top, f) for f in files if not f.startswith((".", "_"))]
        return sorted(found)

    def records(self, page) -> Iterator[str]:
        with open(page, encoding="utf-8") as f:
            yield from f


_TABLES = {
    "works": "work string, title string, year int, cited bigint",
    "work_concepts": "work string, cid string, year int",
    "concepts": "cid string, name string, level int",
    "rejected": "value string, reason string",
}


def _short(link) -> str:
    return link.strip(" ").rstrip("/").rsplit("/", 1)[-1].strip(" ") if isinstance(link, str) else ""


class _Page(InputPartition):
    def __init__(self, page):
        super().__init__(page)


class WorksReader(DataSourceReader):
    """Reads one of the tables. Comparisons of ``year`` and equality of ``cid`` with constants are taken over: they choose pages and hold for every row."""

    def __init__(self, client: WorksClient, table: str):
        self.client, self.table = client, table
        self.low = self.high = self.concepts = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        columns = _TABLES[self.table]
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("year",) and "year int" in columns and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = f.value + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(self.low, low)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = f.value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            elif at == ("cid",) and self.table == "work_concepts" and isinstance(f, (EqualTo, In)):
                asked = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.concepts = asked if self.concepts is None else self.concepts & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Page(p) for p in self.client.pages(self.low, self.high, self.concepts)] or [_Page(None)]

    def _in_years(self, year) -> bool:
        if (self.low, self.high) == (None, None):
            return True
        return year is not None and (self.low is None or year >= self.low) and (self.high is None or year <= self.high)

    def _checked(self, record) -> tuple[dict | None, str]:
        if isinstance(record, str):
            if not record.strip():
                return None, "empty"
            try:
                record = json.loads(record)
            except ValueError:
                return None, "malformed"
        fine = isinstance(record, dict) and isinstance(record.get("concepts") or [], list) and isinstance(record.get("publication_year"), (int, type(None)))
        if not fine or not all(isinstance(c, dict) for c in record.get("concepts") or []):
            return None, "malformed"
        return (record, "") if _short(record.get("id")) else (None, "no id")

    def read(self, partition) -> Iterator[tuple]:
        if partition.value is None:
            return
        for raw in self.client.records(partition.value):
            record, reason = self._checked(raw)
            if self.table == "rejected":
                if record is None:
                    yield (raw.rstrip("\n") if isinstance(raw, str) else json.dumps(raw), reason)
                continue
            if record is None or not self._in_years(year := record.get("publication_year")):
                continue
            work = _short(record["id"])
            if self.table == "works":
                yield work, record.get("display_name") or "(untitled)", year, record.get("cited_by_count") or 0
                continue
            for c in record.get("concepts") or []:
                cid = _short(c.get("id"))
                if cid and (self.concepts is None or cid in self.concepts):
                    yield (work, cid, year) if self.table == "work_concepts" else (cid, c.get("display_name"), c.get("level"))


class WorksSource(DataSource):
    """The format "works": options table (works, work_concepts, concepts, rejected), client ("module:Class") and whatever the client reads."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return _TABLES[self.options.get("table", "works")]

    def reader(self, schema) -> DataSourceReader:
        module, _, name = self.options.get("client", f"{__name__}:FolderClient").partition(":")
        client = getattr(import_module(module), name)(dict(self.options))
        return WorksReader(client, self.options.get("table", "works"))


def register(spark: SparkSession) -> None:
    """Makes the format known, with filters passed down to it. Spark keeps the filters of a loaded frame's first plan for its later ones, so a frame of
    this format is for one plan; ``fetched`` loads anew each time and writes what it gets."""
    spark.dataSource.register(WorksSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def fetched(spark: SparkSession, table: str, where: Column | None = None, format: str = "works", **options: str) -> DataFrame:
    """A table of a source, asked for once: the rows that fit, written to the shared folder and read back from there."""
    frame = spark.read.format(format).options(**(options | {"table": table})).load()
    return stored(frame if where is None else frame.where(where), table.replace("_", "-"))[0]


def corpus_from(spark: SparkSession, format: str = "works", year_from: int | None = None, year_to: int | None = None, **options: str) -> Corpus:
    """A corpus from any format that has the tables works, work_concepts and concepts as its option ``table``. The window is a filter on
    year, which the source gets if it takes filters. Counts of works and the corpus's size are those of the window: nothing else is read."""
    bounds = [F.col("year") >= year_from] * (year_from is not None) + [F.col("year") <= year_to] * (year_to is not None)
    window = reduce(Column.__and__, bounds) if bounds else None
    within = fetched(spark, "work_concepts", window, format, **options)
    works = fetched(spark, "works", window, format, **options).withColumns({"text": F.lit(""), "url": F.lit(None).cast("string")})
    return Corpus.from_work_concepts(within, named(fetched(spark, "concepts", None, format, **options)), works)
