"""Sharded tar archives: samples, catalog, catalog of catalogs."""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from frameweave.plans.ordering import order_rows
from frameweave.plans.staging import materialise

MEMBER_SCHEMA = "shard string, key string, ext string, bytes binary"
SAMPLE_SCHEMA = "shard string, key string, members map<string, binary>"
CATALOG_SCHEMA = "url string, nsamples long, filesize long, md5sum string, error string"


def _locate(url: str):
    return pafs.FileSystem.from_uri(url) if "://" in url else (pafs.LocalFileSystem(), url)


def open_stream(url: str):
    """Sequential reader for a local path or any URI that Arrow's file systems know."""
    fs, path = _locate(url)
    return fs.open_input_stream(path)


def open_file(url: str):
    """Seekable reader of the same."""
    fs, path = _locate(url)
    return fs.open_input_file(path)


def split_name(name: str) -> tuple[str, str] | None:
    """Sample key and extension: the base name is cut at its first dot."""
    folder, _, base = name.rpartition("/")
    stem, dot, ext = base.partition(".")
    if not dot or not stem:
        return None
    return (f"{folder}/{stem}" if folder else stem), ext.lower()


class _Shard(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class ShardReader(DataSourceReader):
    """One input partition per archive; at most one sample is held at a time.

    With errors="raise" an archive that cannot be read fails the task, which Spark tries again. With
    errors="report" a damaged, absent or forbidden archive gives a row with its url and `error`
    after the samples that could be read; other failures, such as a lost connection, still raise.
    """

    def __init__(self, options, samples: bool):
        self.urls = options["paths"].split("\n")
        self.samples = samples
        self.errors = options.get("errors", "raise")
        if self.errors not in ("raise", "report"):
            raise ValueError(f"unknown errors mode {self.errors!r}")

    def partitions(self) -> Sequence[InputPartition]:
        return [_Shard(u) for u in self.urls]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        read = self._read_samples if self.samples else self._read_members
        blanks = (None,) * (2 if self.samples else 3)
        if self.errors == "raise":
            yield from read(partition.url)
            return
        try:
            for row in read(partition.url):
                yield (*row, None)
        except (tarfile.TarError, EOFError, FileNotFoundError, PermissionError) as e:
            yield (partition.url, *blanks, type(e).__name__)

    def _read_members(self, url: str) -> Iterator[tuple]:
        with open_stream(url) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
            for member in tar:
                name = split_name(member.name) if member.isfile() else None
                if name is not None:
                    data = tar.extractfile(member).read()
                    if len(data) != member.size:
                        raise tarfile.ReadError(f"{url} ends within {member.name}")
                    yield url, name[0], name[1], data

    def _read_samples(self, url: str) -> Iterator[tuple]:
        """Headers first, then the bytes sample by sample, as members need not be neighbours."""
        with open_file(url) as raw, tarfile.open(fileobj=raw, mode="r:*") as tar:
            groups: dict[str, list] = {}
            damage = None
            try:
                for member in tar:
                    name = split_name(member.name) if member.isfile() else None
                    if name is not None:
                        groups.setdefault(name[0], []).append((name[1], member))
            except (tarfile.TarError, EOFError) as e:
                damage = e  # raised once the samples before it are read
            for key, members in groups.items():
                held = {ext: tar.extractfile(member).read() for ext, member in members}
                if all(len(held[ext]) == member.size for ext, member in members):
                    yield url, key, held
                else:
                    damage = damage or tarfile.ReadError(f"{url} ends within {key}")
            if damage:
                raise damage


class ShardSource(DataSource):
    """`spark.read.format("tar_shards").option("paths", "a.tar\nb.tar")`: one row per sample,
    or per member with `.option("rows", "members")`. With `.option("errors", "report")` a column
    `error` is added and unreadable archives are rows instead of failures."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def _samples(self) -> bool:
        return self.options.get("rows", "samples") == "samples"

    def schema(self) -> str:
        schema = SAMPLE_SCHEMA if self._samples() else MEMBER_SCHEMA
        return f"{schema}, error string" if self.options.get("errors") == "report" else schema

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options, self._samples())


def _shard_reader(spark: SparkSession, urls: Sequence[str], rows: str, errors: str) -> DataFrame:
    spark.dataSource.register(ShardSource)
    reader = spark.read.format("tar_shards").option("rows", rows).option("errors", errors)
    return reader.option("paths", "\n".join(urls)).load()


def read_members(spark: SparkSession, urls: Sequence[str], errors: str = "raise") -> DataFrame:
    return _shard_reader(spark, urls, "members", errors)


def read_samples(spark: SparkSession, urls: Sequence[str], errors: str = "raise") -> DataFrame:
    """One row per sample: `members` maps extension to bytes.

    A sample never spans shards, so members are grouped where they are read and no bytes are
    shuffled.
    """
    return _shard_reader(spark, urls, "samples", errors)


def shard_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(url, length) of every archive below a folder, without reading any; stays a table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("url"), "length")


def list_shards(spark: SparkSession, folder: str) -> list[str]:
    """The urls in name order, for folders of few archives."""
    return [r.url for r in shard_listing(spark, folder).select("url").orderBy("url").collect()]


#: Bytes of archives that one task reads, and of samples that it holds at once.
SPLIT_BYTES, HELD_BYTES = 128 << 20, 16 << 20


def _in_splits(rows: DataFrame, order: list[str], size: str, split_bytes: int) -> DataFrame:
    """`rows` in partitions of about `split_bytes` by the running sum of `size`, neighbours together."""
    laid = order_rows(rows, [], order).running(inclusive=False, _at=F.col(size)).df
    laid = materialise(laid.withColumn("split", F.floor(F.col("_at") / split_bytes)).drop("_at", "seq"))
    parts = (laid.agg(F.max("split")).first()[0] or 0) + 1
    return laid.repartitionByRange(parts, "split").sortWithinPartitions(*order)


_INDEX = {"url": "string", "key": "string", "ext": "string", "start": "long", "size": "long", "error": "string"}


def member_index(listing: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(url, key, ext, start, size, error) of all members in the archives of a table (url, length).

    Only headers are read. A compressed archive, whose members cannot be found by position, is one row
    without a key. An archive that is damaged, absent or forbidden gives a last row with `error`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in _headers(url):
                    held.append(row)
                    if len(held) == 10_000:
                        yield _rows(held, _INDEX)
                        held = []
                yield _rows(held, _INDEX)

    packed = _in_splits(listing.select("url", "length"), ["url"], "length", split_bytes)
    return packed.select("url").mapInArrow(run, ", ".join(map(" ".join, _INDEX.items())))


def _rows(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "map<string,binary>": pa.map_(pa.string(), pa.binary())}
    parts = zip(*rows) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, t in zip(parts, columns.values())], list(columns))


def _headers(url: str) -> Iterator[tuple]:
    try:
        with open_file(url) as raw:
            total = raw.size()
            try:
                tar = tarfile.open(fileobj=raw, mode="r:")
            except tarfile.ReadError:
                tarfile.open(fileobj=open_file(url), mode="r:*").close()  # raises for what is no archive at all
                yield url, None, None, None, total, None
                return
            for member in tar:
                name = split_name(member.name) if member.isfile() else None
                if name is not None:
                    if member.offset_data + member.size > total:
                        raise tarfile.ReadError(f"{url} ends within {member.name}")
                    yield url, *name, member.offset_data, member.size, None
    except (tarfile.TarError, EOFError, FileNotFoundError, PermissionError) as e:
        yield url, None, None, None, 0, type(e).__name__


_SAMPLES = {"shard": "string", "key": "string", "members": "map<string,binary>", "error": "string"}


def read_listed(listing: DataFrame, errors: str = "raise", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Samples (shard, key, members) of the archives in a table (url, length), as `read_samples` gives them.

    Names never leave the table, and samples are dealt to tasks by bytes: small archives share a task,
    a large one is read by several, each by the members' positions. With errors="report" a column
    `error` is added and unreadable archives are rows; with "raise" they fail the job.
    """
    if errors not in ("raise", "report"):
        raise ValueError(f"unknown errors mode {errors!r}")
    index = materialise(member_index(listing, split_bytes))
    bad = index.where("error IS NOT NULL")
    if errors == "raise":
        first = bad.limit(1).collect()
        if first:
            raise OSError(f"{first[0].url}: {first[0].error}")
    # A sample's members are few; they need not be neighbours in the archive.
    item = F.struct("start", "ext", "size")
    good = index.where("error IS NULL").groupBy("url", "key").agg(
        F.min("start").alias("first"), F.sum("size").alias("bytes"), F.array_sort(F.collect_list(item)).alias("members")
    )
    good = _in_splits(good, ["url", "first", "key"], "bytes", split_bytes).select("url", "key", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, raw, opened = [], 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                url = row["url"]
                if row["key"] is None:
                    found = ((u, k, m) for u, k, m in _whole_archive(url))
                else:
                    if url != opened:
                        if raw is not None:
                            raw.close()
                        raw, opened = open_file(url), url
                    found = [(url, row["key"], {m["ext"]: raw.read_at(m["size"], m["start"]) for m in row["members"]})]
                for sample in found:
                    held.append((*sample[:2], list(sample[2].items()), None))
                    size += sum(map(len, sample[2].values()))
                    if size >= HELD_BYTES:
                        yield _rows(held, _SAMPLES)
                        held, size = [], 0
        yield _rows(held, _SAMPLES)

    samples = good.mapInArrow(run, ", ".join(map(" ".join, _SAMPLES.items())))
    if errors == "raise":
        return samples.drop("error")
    none = [F.lit(None).cast(t).alias(c) for c, t in list(_SAMPLES.items())[1:3]]
    return samples.unionByName(bad.select(F.col("url").alias("shard"), *none, "error"))


def _whole_archive(url: str) -> Iterator[tuple]:
    return ShardReader({"paths": url}, samples=True)._read_samples(url)


def catalog_listed(listing: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """`shard_catalog` of the archives in a table (url, length), dealt to tasks by bytes."""
    return _in_splits(listing.select("url", "length"), ["url"], "length", split_bytes).select("url").mapInPandas(_describe_all, CATALOG_SCHEMA)


def _describe_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            [_describe(u) for u in batch["url"]], columns=["url", "nsamples", "filesize", "md5sum", "error"]
        ).astype({"nsamples": "Int64", "filesize": "Int64"})


def shard_catalog(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    """Samples, bytes and md5 of every archive; a broken one gets `error` and no count."""
    paths = spark.createDataFrame([(u,) for u in urls], "url string")
    spread = paths.repartition(max(1, min(len(urls), 10_000)), "url")
    return spread.mapInPandas(_describe_all, CATALOG_SCHEMA)


class _Tee:
    """Hash and count what a tar reader consumes."""

    def __init__(self, raw):
        self.raw, self.md5, self.size = raw, hashlib.md5(), 0

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(n)
        self.md5.update(data)
        self.size += len(data)
        return data


def _describe(url: str) -> tuple:
    try:
        with open_stream(url) as raw:
            tee, keys = _Tee(raw), set()
            with tarfile.open(fileobj=tee, mode="r|*") as tar:
                for member in tar:
                    name = split_name(member.name) if member.isfile() else None
                    if name is not None:
                        keys.add(name[0])
            while tee.read(1 << 20):
                pass
            return url, len(keys), tee.size, tee.md5.hexdigest(), None
    except (tarfile.TarError, EOFError, OSError) as e:
        return url, None, None, None, type(e).__name__


def write_shards(df: DataFrame, folder: str, shard: str, key: str, members: dict[str, str]) -> DataFrame:
    """Write one archive per shard value (bounded by the caller) and return its url and size.

    `members` maps an extension to the text column stored under it.
    """
    columns = [shard, key, *members.values()]

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        url = f"{folder.rstrip('/')}/{pdf[shard].iloc[0]}.tar"
        fs, path = _locate(url)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for row in pdf.sort_values(key).itertuples(index=False):
                for ext, column in members.items():
                    data = str(getattr(row, column)).encode()
                    info = tarfile.TarInfo(f"{getattr(row, key)}.{ext}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        fs.move(part, path)  # a retried task leaves one whole archive
        return pd.DataFrame({"url": [url], "nsamples": [len(pdf)]})

    return df.select(*columns).groupBy(shard).applyInPandas(write, "url string, nsamples long")


# ---- catalogs -------------------------------------------------------------------------------


def resolve_catalog(catalog: DataFrame, base: str | None = None) -> DataFrame:
    """One row per shard of a catalog and of its component datasets.

    A shard inherits weight, name and dataset from its component, then from the catalog;
    relative urls are rebased on the component's base, the catalog's, or `base`.
    """
    fields = set(catalog.columns)
    own_base = F.coalesce(F.col("base") if "base" in fields else F.lit(None), F.lit(base))
    direct = catalog.select(
        F.col("name"), F.lit(None).cast("double").alias("weight"), own_base.alias("base"), F.inline("shardlist")
    )
    if "datasets" in fields:
        parts = catalog.select(F.col("name").alias("_top"), own_base.alias("_base"), F.explode("datasets").alias("d"))
        has_base = "base" in parts.schema["d"].dataType.fieldNames()
        parts = parts.select(
            F.coalesce(F.col("d.name"), F.col("_top")).alias("name"),
            F.coalesce(F.col("d.weight"), F.lit(1.0)).alias("weight"),
            (F.coalesce(F.col("d.base"), F.col("_base")) if has_base else F.col("_base")).alias("base"),
            F.inline("d.shardlist"),
        )
        direct = direct.unionByName(parts, allowMissingColumns=True)
    url = F.col("url")
    absolute = url.startswith("/") | url.contains("://") | F.col("base").isNull()
    return direct.withColumns(
        {
            "url": F.when(absolute, url).otherwise(F.concat(F.rtrim(F.col("base"), F.lit("/")), F.lit("/"), url)),
            "weight": F.coalesce(F.col("weight"), F.lit(1.0)),
        }
    ).drop("base")


def catalog_problems(shards: DataFrame) -> DataFrame:
    """Rows that break the catalog contract: no url, no sample count, or a url listed twice."""
    twice = shards.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "url", F.lit("duplicate url").alias("problem")
    )
    bad = shards.select(
        "url",
        F.when(F.col("url").isNull() | (F.col("url") == ""), "no url")
        .when(F.col("nsamples").isNull() | (F.col("nsamples") < 0), "no sample count")
        .alias("problem"),
    ).where(F.col("problem").isNotNull())
    return bad.unionByName(twice)


def catalog_summary(shards: DataFrame) -> DataFrame:
    """Totals, averages and the first and last shard by url."""
    return shards.agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.sum("nsamples").alias("total_samples"),
        F.sum("filesize").alias("total_bytes"),
        F.round(F.avg("nsamples"), 6).alias("avg_samples"),
        F.round(F.avg("filesize"), 6).alias("avg_bytes"),
        F.round(F.sum("filesize") / F.sum("nsamples"), 6).alias("bytes_per_sample"),
        F.min("url").alias("first_shard"),
        F.max("url").alias("last_shard"),
    )
