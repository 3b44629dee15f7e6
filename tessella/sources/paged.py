"""Paged sources as a Spark data source: answers of search services are landed page by page and scanned in ranges of pages.

    land(rows, path)                                         # or any job that writes the same two tables
    spark.dataSource.register(PagedSource)
    spark.read.format("tessella_pages").schema("source string, page long, id long, ...").option("path", path).load()
    spark.read.format("tessella_pages").option("path", path).option("table", "status").load()
    spark.readStream.format("tessella_pages").schema(...).option("path", path).load()

`bodies` holds a row for each page with the body as it was answered (JSON: results and the key of the next page), `manifest` a row
for each page without its body: source, style, page, key, next, http, n, total, low_year, high_year, file. The manifest is written
after the bodies, so a page that isn't whole is not seen. Planning reads the manifest on the driver, some 100 bytes for a page;
bodies are only read by the tasks, each a range of pages of one source and nothing else, so a task that is tried again reads the same.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tessella.sources.records import page_tokens
from tessella.storage import stored

#: How a source names its pages: by a cursor or token that the page before holds, or by the offset of its first row.
STYLES = ("cursor", "token", "offset")
MANIFEST = ["source", "style", "page", "key", "next", "http", "n", "total", "low_year", "high_year", "file"]
STATUS = "source string, style string, status string, message string, pages long, returned long"
#: Pages that one task reads.
PAGES_PER_TASK = 64


def _key(style, source, page, size: int):
    """The name of a page in requests."""
    return F.when(style == "offset", (page * size).cast("string")).otherwise(F.concat_ws("-", style, F.md5(F.concat_ws(":", source, page.cast("string")))))


def land(rows: DataFrame, path: str, order: list[str], size: int = 100, styles: dict[str, str] | None = None) -> None:
    """Lands rows (source, ...) below `path` as pages of `size` rows, each source in the order of the columns `order`; pages that were landed before stay and the new ones follow them (SRC14, SRC16).

    Rows are numbered within their source by prefix sums over ranges, so no task holds a source. A null source is ''; `styles` gives
    a source's style, cursor by default. A column `year`, if there is one, is summed up by page for pruning. Rows that tie in `order` may
    change places. No rows land no pages.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    payload = F.to_json(F.struct(*(c for c in rows.columns if c != "source")))
    year = F.col("year").cast("int") if "year" in rows.columns else F.lit(None).cast("int")
    dealt = rows.select("source", F.struct(*order).alias("_order"), payload.alias("_row"), year.alias("_year"))
    dealt = stored(dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", "_order").select("*", F.spark_partition_id().alias("_range")))
    had = manifest(spark, path)
    had = had.groupBy("source").agg((F.max("page") + 1).alias("_first"), F.sum("n").alias("_had")) if had is not None else spark.createDataFrame([], "source string, _first long, _had long")
    counts = dealt.groupBy("source", "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each source and range that meet
    before = F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("source", "_range", before.alias("_before"), F.sum("_n").over(W.partitionBy("source")).alias("_total")).join(had, "source", "left").na.fill(0, ["_first", "_had"])
    at = F.col("_before") + F.row_number().over(W.partitionBy("source", "_range").orderBy("_order")) - 1
    numbered = dealt.join(counts, ["source", "_range"]).withColumn("_at", at)
    page = (F.col("_first") + F.floor(F.col("_at") / size)).cast("long")
    pages = numbered.groupBy("source", page.alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "_row"))).alias("_rows"), F.count(F.lit(1)).cast("int").alias("n"), F.max(F.col("_had") + F.col("_total")).alias("total"), F.min("_year").alias("low_year"), F.max("_year").alias("high_year")
    )
    given = F.create_map(*(F.lit(x) for pair in (styles or {"": "cursor"}).items() for x in pair))
    pages = pages.withColumn("style", F.coalesce(F.try_element_at(given, F.col("source")), F.lit("cursor"))).withColumn("http", F.lit(200))
    pages = pages.withColumn("key", _key(F.col("style"), F.col("source"), F.col("page"), size)).withColumn("next", _key(F.col("style"), F.col("source"), F.col("page") + 1, size))
    body = F.concat(F.lit('{"results":['), F.array_join(F.col("_rows._row"), ","), F.lit('],"next":"'), F.col("next"), F.lit('"}'))
    bodies = pages.select(*(c for c in MANIFEST if c != "file"), body.alias("body"))
    landing = f"{path}/bodies/{spark.range(1).select(F.uuid()).first()[0]}"
    bodies.repartitionByRange("source", "page").sortWithinPartitions("source", "page").write.parquet(landing)
    spark.read.parquet(landing).select(*(c for c in MANIFEST if c != "file"), F.col("_metadata.file_path").alias("file")).write.mode("append").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The pages that have been landed, or None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store that tasks read by themselves: file, hdfs, s3, gs and abfs; others are refused by name."""
    try:
        return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}"))
    except pa.ArrowInvalid as why:
        raise ValueError(f"pages can't be read from {uri}: {why}") from why


@dataclass
class Chain:
    """The pages of a source that can be read one after another from the first, and what ends them."""

    source: str
    style: str
    pages: list[dict] = field(default_factory=list)
    message: str = ""

    @property
    def status(self) -> str:
        return "unavailable" if self.message else "ok" if sum(p["n"] for p in self.pages) else "empty"


def chains(rows: list[dict]) -> list[Chain]:
    """Follows each source's pages: a cursor or token names the next page, offsets follow from the total and the size of the first page.

    A page that is missing, failed, or comes a second time ends the chain with a message; what came before stays readable. A page
    landed twice under one key is read once.
    """
    by: dict[str, dict[str, dict]] = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["page"], r["file"])):
        by.setdefault(r["source"], {}).setdefault(r["key"], r)
    out = []
    for source, pages in by.items():
        first = min(pages.values(), key=lambda r: r["page"])
        chain = Chain(source, first["style"])
        total, seen = max(r["total"] for r in pages.values()), 0
        if first["style"] == "offset":
            keys = iter([str(at) for at, _ in page_tokens(total, first["n"])] if first["n"] else [])
            key = next(keys, None)
        else:
            key = first["key"]
        done = set()
        while key is not None and seen < total:
            page = pages.get(key)
            if page is None:
                chain.message = f"page {key} is missing"
            elif key in done:
                chain.message = f"page {key} comes again"
            elif page["http"] != 200:
                chain.message = f"page {key} was answered with {page['http']}"
            if chain.message:
                break
            done.add(key)
            chain.pages.append(page)
            seen += page["n"]
            key = next(keys, None) if first["style"] == "offset" else page["next"]
        if not chain.message and seen < total:
            chain.message = f"{total - seen} of {total} rows are missing"
        out.append(chain)
    return out


@dataclass
class PageRange(InputPartition):
    """Bodies of consecutive pages of one source, by file."""

    source: str
    pages: dict[str, list[int]]


class _Pages:
    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.per_task = int(options.get("pagespertask", PAGES_PER_TASK))
        self.sources: set | None = set(json.loads(options["sources"])) if "sources" in options else None
        self.years = tuple(float(options.get(k, f"{sign}inf")) for k, sign in (("fromyear", "-"), ("toyear", "+")))

    def chains(self) -> list[Chain]:
        fs, at = _place(f"{self.path}/manifest")
        if fs.get_file_info(at).type == pa.fs.FileType.NotFound:
            return []
        return chains(pads.dataset(at, filesystem=fs, format="parquet").to_table(columns=MANIFEST).to_pylist())

    def wanted(self, page: dict) -> bool:
        low, high = page["low_year"], page["high_year"]
        return (self.sources is None or page["source"] in self.sources) and (self.years == (float("-inf"), float("inf")) or (low is not None and high >= self.years[0] and low <= self.years[1]))

    def ranges(self, pages: list[dict]) -> list[PageRange]:
        out = []
        for i in range(0, len(pages), self.per_task):
            files: dict[str, list[int]] = {}
            for p in pages[i : i + self.per_task]:
                files.setdefault(p["file"], []).append(p["page"])
            out.append(PageRange(pages[i]["source"], files))
        return out

    def rows(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for uri, numbers in partition.pages.items():
            fs, at = _place(uri)
            wanted = (pads.field("source") == partition.source) & pads.field("page").isin(numbers)
            for batch in pads.dataset(at, filesystem=fs, format="parquet").to_batches(columns=["page", "body"], filter=wanted, batch_size=16):
                for page, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows = [r | {"source": partition.source, "page": page} for r in json.loads(body)["results"]]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[PageRange]:
        return [r for c in self.chains() for r in self.ranges([p for p in c.pages if self.wanted(p)])] or [PageRange("", {})]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class PushingReader(PageReader):
    """Takes filters from Spark (option pushFilters, and spark.sql.python.filterPushdown.enabled).

    Spark keeps what was pushed with the relation: a frame that is read twice with different filters, as in a union of two of its
    parts, would be scanned with the last ones only. So this is for a frame that is read once; pages() takes sources and years as
    arguments instead.
    """

    def pushFilters(self, filters: list[Filter]):
        """Sources are chosen here; years only rule out pages, so Spark still checks the rows."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("source",) and isinstance(f, EqualTo | EqualNullSafe | In):
                chosen = {f.value} if not isinstance(f, In) else set(f.value)
                self.sources = chosen if self.sources is None else self.sources & chosen
                continue
            if column == ("year",):
                low, high = self.years
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    low = max(low, f.value)
                elif isinstance(f, LessThan | LessThanOrEqual):
                    high = min(high, f.value)
                self.years = (low, high)
            yield f


class StatusReader(_Pages, DataSourceReader):
    """A row for each source: ok, empty, or unavailable with the reason (SRC13, UDF04)."""

    def read(self, partition) -> Iterator[tuple]:
        for c in self.chains():
            yield c.source, c.style, c.status, c.message, len(c.pages), sum(p["n"] for p in c.pages)


class PageStream(_Pages, DataSourceStreamReader):
    """Offsets are the keys of the last pages read, by source: what a client would send to go on."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {c.source: c.pages[-1]["key"] for c in self.chains() if c.pages}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        out = []
        for c in self.chains():
            at = {p["key"]: i + 1 for i, p in enumerate(c.pages)}
            out += self.ranges(c.pages[at.get(start.get(c.source), 0) : at.get(end.get(c.source), 0)])
        return out

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class PagedSource(DataSource):
    """Options: path, table (pages or status), pagesPerTask, sources (a JSON list), fromYear, toYear, pushFilters."""

    @classmethod
    def name(cls) -> str:
        return "tessella_pages"

    def schema(self) -> str:
        return STATUS if self.options.get("table") == "status" else "source string, page long, year int, doi string, title string"

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.options.get("table") == "status":
            return StatusReader(self.options, schema)
        return (PushingReader if self.options.get("pushFilters") == "true" else PageReader)(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageStream(self.options, schema)


def pages(spark: SparkSession, path: str, schema: str, sources: list[str] | None = None, years: tuple[int | None, int | None] = (None, None), **options: str) -> DataFrame:
    """The landed rows; source and page can be among the columns. `sources` and `years` (first, last) choose before anything is read: other sources' pages, and pages without a row in those years, aren't opened; rows of other years are filtered out by the column year."""
    spark.dataSource.register(PagedSource)
    chosen = {"fromYear": years[0], "toYear": years[1], "sources": None if sources is None else json.dumps(sources)}
    out = spark.read.format("tessella_pages").schema(schema).options(path=path, **{k: str(v) for k, v in chosen.items() if v is not None}, **options).load()
    if years[0] is not None:
        out = out.where(F.col("year") >= years[0])
    return out.where(F.col("year") <= years[1]) if years[1] is not None else out


def page_status(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("tessella_pages").options(path=path, table="status").load()


def page_stream(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("tessella_pages").schema(schema).options(path=path, **options).load()
