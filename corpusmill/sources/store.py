"""The index as tables: chunks with vectors, metadata, and a fingerprint that says if it is current."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.fingerprint import changed_files
from corpusmill.runtime import materialize
from corpusmill.settings import read_instructions
from corpusmill.sources import onefile


def write_chunks_jsonl(chunks: DataFrame, path: str, path_col: str = "source_path", text_col: str = "chunk_text") -> None:
    """Lines ``{"tex", "source_path"}``, as the studied store names them, in several part files."""
    chunks.select(F.col(text_col).alias("tex"), F.col(path_col).alias("source_path")).write.mode("overwrite").json(path)


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("tex string, source_path string").json(path)
    return rows.select("source_path", F.col("tex").alias("chunk_text"))


class IndexStore:
    """Chunks with vectors in a folder of immutable parts; what is current is said by a manifest that is written last.

    ``segments`` hold chunks (Parquet), ``tombstones`` the files of a segment whose chunks are dead, ``listings`` the
    files that the index was made of and the segment of each.  ``manifests/<generation>.json`` names the parts of
    a state, its settings, fingerprint and dimension, and appears by one rename.  A writer that dies leaves parts that
    no manifest names: readers stay with the last whole state, and :meth:`vacuum` deletes the rest.  Of two
    writers of one generation the second fails.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def config_hash(settings: object) -> str:
        data = asdict(settings) if is_dataclass(settings) and not isinstance(settings, type) else settings
        return hashlib.sha256(json.dumps(data, sort_keys=True, default=str).encode()).hexdigest()

    # ---- manifests

    def _generations(self) -> list[int]:
        where = self._at(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _read(self, generation: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/manifests/{generation:012d}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def manifest(self) -> dict | None:
        """The current state: generation, segments, tombstones, listing, fingerprint, config, dim."""
        known = self._generations()
        return self._read(known[-1]) if known else None

    def _commit(self, found: dict | None, **state: object) -> dict:
        """Makes a state current; it follows ``found``, or else another writer was faster and this one fails."""
        made = {"generation": (found["generation"] if found else 0) + 1, **state}
        target = self._at(f"{self.path}/manifests/{made['generation']:012d}.json")
        draft = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(draft, target, none)  # refuses a target that is there
        return made

    # ---- parts

    def _write(self, df: DataFrame, kind: str) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{kind}/{name}")
        return name

    def _part(self, kind: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}/{name}")

    def _segment(self, chunks: DataFrame, dim: int | None = None) -> tuple[str, int | None]:
        """Writes chunks and measures their vectors; null if there are none."""
        name = self._write(chunks, "segments")
        size = F.size("embedding")
        least, most = self._part("segments", name).agg(F.min(size), F.max(size)).first()
        if least != most or (dim is not None and least is not None and least != dim):
            raise ValueError("vectors differ in length")
        return name, least

    def load(self) -> DataFrame:
        """The live chunks of the current state."""
        found = self.manifest()
        if found is None:
            raise ValueError(f"no index at {self.path}")
        return self._live(found)

    def _live(self, found: dict) -> DataFrame:
        parts = [self._part("segments", s).withColumn("_segment", F.lit(s)) for s in found["segments"]]
        rows = reduce(DataFrame.unionByName, parts)
        if found["tombstones"]:
            dead = reduce(DataFrame.unionByName, [self._part("tombstones", t) for t in found["tombstones"]])
            key = rows[found["path_col"]].eqNullSafe(dead["path"]) & (rows["_segment"] == dead["segment"])
            rows = rows.join(dead, key, "left_anti")
        return rows.drop("_segment")

    # ---- whole builds

    def save(self, chunks: DataFrame, fingerprint: str, settings: object = None) -> None:
        """Replaces the index by ``chunks`` (with ``embedding``); raises if there are none, and the old state stays."""
        found = self.manifest()
        name, dim = self._segment(chunks)
        if dim is None:
            raise ValueError("No vectors created")
        self._commit(found, segments=[name], tombstones=[], listing=None, path_col=None, fingerprint=fingerprint, config=self.config_hash(settings), dim=dim)

    def state(self) -> tuple[str, str, int] | None:
        found = self.manifest()
        return None if found is None else (found["fingerprint"], found["config"], found["dim"])

    def current(self, fingerprint: str, settings: object = None) -> bool:
        found = self.state()
        return found is not None and found[:2] == (fingerprint, self.config_hash(settings))

    def ensure(self, build, fingerprint: str, settings: object = None, mode: str = "auto") -> DataFrame:
        """``reuse`` takes what is there, ``rebuild`` builds, ``auto`` builds if anything changed."""
        if mode not in ("auto", "reuse", "rebuild"):
            raise ValueError(mode)
        there = self.state() is not None
        if mode == "rebuild" or not there or (mode == "auto" and not self.current(fingerprint, settings)):
            self.save(build(), fingerprint, settings)
        return self.load()

    def reload(self, build, instructions_path: str, settings: object = None) -> tuple[DataFrame, tuple[str, str]]:
        """Reads the instructions again and rebuilds; the fingerprint stays the one of the last save, so ``auto`` still sees changed files."""
        found = self.state()
        self.save(build(), found[0] if found else "", settings)
        return self.load(), read_instructions(instructions_path)

    # ---- changes

    def update(self, files: DataFrame, build: Callable[[DataFrame], DataFrame], settings: object = None, path_col: str = "doc_path", fingerprint: str = "") -> dict[str, int]:
        """Brings the index to ``files`` (path, mtime, size; one row a path): only new and modified files are built.

        ``build`` takes those files' rows and returns their chunks, with ``path_col`` and ``embedding``.  Other settings, or an
        index that :meth:`save` made, which has no listing, build all files.  Returns the files by kind of change.
        """
        found, config = self.manifest(), self.config_hash(settings)
        base = found if found and found["listing"] and (found["config"], found["path_col"]) == (config, path_col) else None
        none = self.spark.createDataFrame([], "path string, mtime long, size long, segment string")
        before = self._part("listings", base["listing"]) if base else none
        changes = materialize(changed_files(files, before), "index-changes")
        kinds = {"new": 0, "modified": 0, "gone": 0} | {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        if base and not any(kinds.values()) and base["fingerprint"] == fingerprint:
            return kinds
        name, dim, segments = None, base["dim"] if base else None, list(base["segments"]) if base else []
        touched = changes.filter("change <> 'gone'").select("path")
        if kinds["new"] or kinds["modified"]:
            name, met = self._segment(build(files.join(touched, "path", "left_semi")), dim)
            segments, dim = [*segments, name] if met is not None or not segments else segments, dim or met
        if dim is None:
            raise ValueError("No vectors created")
        listed = files.select("path", F.col("mtime").cast("long").alias("mtime"), F.col("size").cast("long").alias("size"))
        old = before.select("path", "segment").join(touched, "path", "left_anti")
        listing = self._write(listed.join(old, "path", "left").withColumn("segment", F.coalesce("segment", F.lit(name))), "listings")
        tombstones = list(base["tombstones"]) if base else []
        if kinds["modified"] or kinds["gone"]:
            tombstones.append(self._write(before.join(changes.filter("change <> 'new'"), "path", "left_semi").select("path", "segment"), "tombstones"))
        self._commit(found, segments=segments, tombstones=tombstones, listing=listing, path_col=path_col, fingerprint=fingerprint, config=config, dim=dim)
        return kinds

    def compact(self, max_parts: int = 16, max_dead: float = 0.2) -> bool:
        """Rewrites the live chunks as one segment if there are more than ``max_parts`` segments or tombstones, or dead files are more than a share."""
        found = self.manifest()
        if not found or not found["listing"] or not found["tombstones"] and len(found["segments"]) == 1:
            return False
        dead = sum(self._part("tombstones", t).count() for t in found["tombstones"])
        files = self._part("listings", found["listing"])
        if max(len(found["segments"]), len(found["tombstones"])) <= max_parts and dead <= max_dead * files.count():
            return False
        name, _ = self._segment(self._live(found), found["dim"])
        listing = self._write(files.withColumn("segment", F.lit(name)), "listings")
        self._commit(found, **{**{k: v for k, v in found.items() if k != "generation"}, "segments": [name], "tombstones": [], "listing": listing})
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the last ``keep``, and parts that no kept one names; no writer may be at work.  Returns the number deleted."""
        known = self._generations()
        states = [self._read(g) for g in known[-keep:]]
        used = {n for s in states for n in (*s["segments"], *s["tombstones"], s["listing"])} | {f"{g:012d}.json" for g in known[-keep:]}
        gone = 0
        for kind in ("manifests", "segments", "tombstones", "listings"):
            where = self._at(f"{self.path}/{kind}")
            for f in self._fs.listStatus(where) if self._fs.exists(where) else []:
                if f.getPath().getName() not in used:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone


_META = "doc_path string, chunk_id int, text string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``dim, doc_path, chunk_id, chunk_text`` of a metadata file that is one JSON object with ``dim`` and ``chunks``.

    Many tasks read a file that every executor mounts (``onefile``); from other stores one task reads it.
    """
    if "://" not in path:
        dim = onefile.scalars(path).get("dim")
        return onefile.read_object(spark, path, _META).select(F.lit(dim).cast("int").alias("dim"), "doc_path", "chunk_id", F.col("text").alias("chunk_text"))
    rows = spark.read.schema(f"dim int, chunks array<struct<{_META.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", "true").json(path)
    return rows.select("dim", F.explode("chunks").alias("c")).select("dim", "c.doc_path", "c.chunk_id", F.col("c.text").alias("chunk_text"))


def write_metadata(chunks: DataFrame, path: str, dim: int) -> int:
    """``chunk_ord, doc_path, chunk_id, chunk_text`` as that one object, in order of ``chunk_ord``, by many tasks."""
    return onefile.write_object(chunks.select("chunk_ord", "doc_path", "chunk_id", F.col("chunk_text").alias("text")), path, dim=dim)


def metadata_json(chunks: DataFrame, dim: int) -> DataFrame:
    """One JSON row per chunk with the dimension: the metadata file as lines."""
    return chunks.select(F.to_json(F.struct(F.lit(dim).alias("dim"), F.struct("doc_path", "chunk_id", F.col("chunk_text").alias("text")).alias("chunk"))).alias("value"))


def write_source(compiled: DataFrame, path: str, source_col: str = "source") -> None:
    """Compiled sources as text."""
    compiled.select(F.col(source_col).alias("value")).write.mode("overwrite").text(path)
