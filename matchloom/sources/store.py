"""Keyed upserts on plain parquet that stay cheap for as long as batches come.

Rows lie in buckets of their key's hash. A batch writes one segment, a folder per bucket, and then one commit that lists
the segments in force; readers take the newest commit, so they see whole batches only and go on with theirs whatever is
written meanwhile. Equal-sized segments are folded into the next size, so there are few of them, and a read for some
keys opens only those keys' buckets, and only in segments whose key filter, a bitmap of hashes, may know one of them.
Nothing is changed in place: a stopped writer leaves a folder that no commit names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from matchloom.operators.ranking import latest
from matchloom.session import materialize
from matchloom.sources.commits import CommitLog

REMEMBERED = 1024  # batches whose content a commit still knows
BITS_PER_KEY, BITMAP = 16, 32_768  # of a segment's key filter; bits in one stored bitmap


class KeyedStore:
    """Newest row per key.

    ``newest_by``: columns that decide which row of a key wins (default: the batch). ``buckets``: into how many parts keys
    are hashed, fixed when the store begins. ``fan``: so many segments of one size are folded into one of the next.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], newest_by: list[str] | None = None, buckets: int = 16, fan: int = 4):
        self.spark, self.path, self.keys, self.buckets, self.fan = spark, path, keys, buckets, fan
        self.by = newest_by or ["batch"]
        self.log = CommitLog(spark, f"{path}/commits")

    def state(self) -> dict | None:
        """The newest commit: schema, buckets, segments and the contents of recent batches; None before the first batch."""
        return self.log.latest()[1]

    def has(self, batch: int) -> bool:
        now = self.state()
        return now is not None and (str(batch) in now["recent"] or (now["floor"] is not None and batch <= now["floor"]))

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _spot(self, size):
        """A key's place in a filter of ``size`` bits, from 1."""
        return F.pmod(F.xxhash64(*self.keys, F.lit("filter")), size) + 1

    def _write_filter(self, keys: DataFrame, name: str, size: int) -> None:
        spot = keys.select(self._spot(F.lit(size)).alias("s"))
        maps = spot.groupBy(F.bitmap_bucket_number("s").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        maps.write.parquet(f"{self.path}/filters/seg={name}")

    def _maybe(self, now: dict, wanted: DataFrame) -> DataFrame:
        """(keys, seg, bucket): where each wanted key may be stored; never misses one, and is wrong for about one in BITS_PER_KEY."""
        segs = F.array(*[F.struct(F.lit(x["name"]).alias("seg"), F.lit(x["filter"]).alias("size")) for x in now["segments"]])
        asked = wanted.withColumn("x", F.explode(segs)).select(*self.keys, "x.seg", self._bucket(now["n_buckets"]).alias("bucket"), self._spot(F.col("x.size")).alias("s"))
        asked = asked.withColumn("part", F.bitmap_bucket_number("s")).withColumn("at", F.bitmap_bit_position("s"))
        maps = self.spark.read.schema("part long, bits binary, seg string").option("basePath", f"{self.path}/filters").parquet(
            *[f"{self.path}/filters/seg={x['name']}" for x in now["segments"]])
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.expr("shiftright(byte, cast(at % 8 AS int)) & 1") == 1
        return asked.join(maps, ["seg", "part"]).withColumn("byte", byte).where(hit).select(*self.keys, "seg", "bucket")

    def _write(self, rows: DataFrame, buckets: int) -> dict:
        """One segment: the newest row per key, a task per bucket (keys are unique by now, so buckets are even)."""
        name = uuid.uuid4().hex
        newest = latest(rows, self.keys, self.by)
        newest.withColumn("bucket", self._bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/seg={name}")
        schema = StructType(list(newest.schema.fields)).add("bucket", IntegerType())
        back = self.spark.read.schema(schema).parquet(f"{self.path}/data/seg={name}")
        content = F.sum(F.xxhash64(*[c for c in newest.columns if c != "batch"]).cast("decimal(38,0)"))
        per = back.groupBy("bucket").agg(F.count("*").alias("n"), content.alias("h")).collect()  # one row per bucket
        n = sum(r["n"] for r in per)
        size = max(1, -(-n * BITS_PER_KEY // BITMAP)) * BITMAP
        if n:
            self._write_filter(back, name, size)
        return {"name": name, "buckets": sorted(r["bucket"] for r in per), "rows": n, "filter": size,
                "digest": f"{sum(r['n'] for r in per)}:{sum(int(r['h']) for r in per)}", "schema": newest.schema.json()}

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Commits a batch as a whole. Committing it again changes nothing; other content under its number is refused."""
        now = self.state()
        seg = self._write(rows.withColumn("batch", F.lit(batch).cast("long")), now["n_buckets"] if now else self.buckets)
        digest, schema = seg.pop("digest"), seg.pop("schema")

        def step(now: dict | None) -> dict | None:
            now = now or {"n_buckets": self.buckets, "schema": schema, "segments": [], "recent": {}, "floor": None}
            known = now["recent"].get(str(batch))
            if known == digest:
                return None
            if known is not None or (now["floor"] is not None and batch <= now["floor"]):
                raise ValueError(f"batch {batch} is committed with other content, or too long ago to tell")
            recent = {**now["recent"], str(batch): digest}
            floor = now["floor"]
            while len(recent) > REMEMBERED:
                oldest = min(recent, key=int)
                floor = int(oldest)
                del recent[oldest]
            new = [{**seg, "level": 0}] if seg["rows"] else []
            return {**now, "recent": recent, "floor": floor, "segments": now["segments"] + new}

        self.log.change(step)
        self.fold()

    def fold(self, everything: bool = False) -> None:
        """Folds segments of one size while there are ``fan`` of them (or all into one); each fold is a commit of its own."""
        while (now := self.state()) is not None:
            levels: dict[int, list[dict]] = {}
            for s in now["segments"]:
                levels.setdefault(s["level"], []).append(s)
            full = now["segments"] if everything else next((v for _, v in sorted(levels.items()) if len(v) >= self.fan), [])
            if len(full) < 2:
                return
            merged = self._write(self._rows(now, full), now["n_buckets"])
            names = {s["name"] for s in full}
            new = {k: merged[k] for k in ("name", "buckets", "rows", "filter")} | {"level": max(s["level"] for s in full) + 1}

            def step(later: dict | None) -> dict | None:
                if not names <= {s["name"] for s in later["segments"]}:
                    return None  # someone else folded them
                return {**later, "segments": [new] + [s for s in later["segments"] if s["name"] not in names]}

            self.log.change(step)

    def _rows(self, now: dict, segments: list[dict], only: set[tuple[str, int]] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(now["schema"]))
        paths = [f"{self.path}/data/seg={s['name']}/bucket={b}" for s in segments for b in s["buckets"] if only is None or (s["name"], b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, only: DataFrame | None = None) -> DataFrame:
        """Newest row per key. ``only`` (key columns): of these keys; files that cannot hold one of them are not opened."""
        now = self.state()
        if now is None:
            raise ValueError(f"no batch has been committed to {self.path}")
        if only is None:
            rows = self._rows(now, now["segments"])
        else:
            maybe = self._maybe(now, only.select(*self.keys).distinct()) if now["segments"] else only.select(*self.keys, F.lit("").alias("seg"), F.lit(0).alias("bucket")).limit(0)
            known = materialize(maybe, "store-known")
            hit = {(r["seg"], r["bucket"]) for r in known.select("seg", "bucket").distinct().collect()}  # segments x buckets at most
            rows = self._rows(now, now["segments"], hit).join(known.select(*self.keys).distinct(), self.keys, "left_semi")
        return latest(rows, self.keys, self.by).drop("batch")

    def read_or_empty(self, schema, only: DataFrame | None = None) -> DataFrame:
        return self.read(only) if self.state() is not None else self.spark.createDataFrame([], schema)

    def compact(self, target: str | None = None) -> KeyedStore:
        """Folds everything into one segment, or writes that to a new store."""
        if target is None:
            self.fold(everything=True)
            return self
        other = KeyedStore(self.spark, target, self.keys, self.by if self.by != ["batch"] else None, self.buckets, self.fan)
        other.upsert(self.read(), 0)
        return other

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Deletes segments that the newest commit does not name, and older commits, if they are older than so many seconds.

        Readers and writers that take longer would lose their files."""
        version, now = self.log.latest()
        if now is None:
            return 0
        keep = {f"seg={s['name']}" for s in now["segments"]}
        data = CommitLog(self.spark, f"{self.path}/data")
        gone = [n for n in data.list(older_than=older_than) if n.startswith("seg=") and n not in keep]
        for name in gone:
            data.remove(name)
            CommitLog(self.spark, f"{self.path}/filters").remove(name)
        for name in self.log.list(older_than=older_than):
            if name.endswith(".json") and int(name[:-5]) < version:
                self.log.remove(name)
        return len(gone)


def merge(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows whose key is in ``new``, keep the others, add the unseen."""
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update_only(existing: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Set ``fields`` on existing keys; updates without a stored row are dropped."""
    upd = new.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    j = existing.join(upd, keys, "left")
    return j.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in existing.columns])


def vector_rows(rows: DataFrame) -> DataFrame:
    """Vector-table form: unknown category and seniority become '', unknown years 0."""
    return rows.select(
        "candidate_id", "source_dataset", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("experience_years", F.lit(0.0)).alias("experience_years"),
        F.coalesce("seniority_level", F.lit("")).alias("seniority_level"), "embedding")


def lookup(docs: DataFrame, ids: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Documents of a batch of ids; repeated and empty ids are dropped."""
    return docs.join(ids.select(key).where(F.coalesce(F.col(key), F.lit("")) != "").distinct(), key, "left_semi")
