"""A store of immutable artifacts that many writers may add to at once.

Data lie in folders that are written once; a version is a manifest that names the folders it consists of. A writer stages its folder, checks its
rows against the newest version, and claims the next number: exactly one writer gets it, and the others check again against what that
one has added. So a version is never seen half written, no writer undoes another, and what a lost driver has staged belongs to no version.

Claiming needs a file system that can give a name only once: a hard link on a local disk, a rename that does not replace on HDFS. Object stores without
either are refused.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.sources.graphs import hashed

ARTIFACT = "id string, kind string, hash string, payload string"


class Conflict(ValueError):
    """An artifact is there already with another content."""


class ArtifactStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("versions"))

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The newest version; 0 holds nothing."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("versions"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        stream = self._fs.open(self._at(f"versions/{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["folders"]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The artifacts (id, kind, hash, payload) of a version, the newest unless given."""
        found = self.folders(self.version() if version is None else version)
        return self.spark.read.schema(ARTIFACT).parquet(*[f"{self.path}/data/{f}" for f in found]) if found else self.spark.createDataFrame([], ARTIFACT)

    def _stage(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.select("id", "kind", "hash", "payload").write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _claim(self, version: int, folders: list[str]) -> bool:
        """Whether this writer is the one whose manifest becomes that version."""
        name, scheme = f"versions/{version:08d}.json", self._fs.getScheme()
        draft = self._at(f"versions/{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"folders": folders}).encode()))
        stream.close()
        try:
            if scheme == "file":
                local = lambda p: unquote(urlparse(str(p.toUri())).path)
                os.link(local(draft), local(self._at(name)))
            elif scheme in ("hdfs", "viewfs"):
                options = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
                options[0] = getattr(self._hadoop.fs.Options.Rename, "NONE")
                self._hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self._at(name), options)
            else:
                raise NotImplementedError(f"{scheme} cannot give a name only once")
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self._fs.delete(draft, False)
        return True

    def commit(self, new: DataFrame, tries: int = 20) -> int:
        """Add artifacts (id, kind, payload as JSON) and return the version that holds them.

        What is stored already with the same canonical content is left alone, so a commit may be repeated. An (id, kind) with another content,
        stored or in `new` itself, is a Conflict, and nothing is added.
        """
        rows = new.select(F.col("id").cast("string").alias("id"), "kind", hashed(F.col("payload")).alias("hash"), "payload").dropDuplicates(["id", "kind", "hash"])
        staged = self._stage(rows)
        mine = self.spark.read.schema(ARTIFACT).parquet(f"{self.path}/data/{staged}")
        bad = mine.where("hash IS NULL OR id IS NULL OR kind IS NULL").limit(3).collect()
        twice = mine.groupBy("id", "kind").count().where("count > 1").limit(3).collect()
        if bad or twice:
            raise Conflict(f"artifacts without an id, a kind or JSON: {[(r.id, r.kind) for r in bad]}, with several contents: {[(r.id, r.kind) for r in twice]}")
        for _ in range(tries):
            version = self.version()
            stored = self.read(version).select("id", "kind", F.col("hash").alias("held"))
            met = mine.join(stored, ["id", "kind"])
            clash = met.where("hash <> held").select("id", "kind").limit(3).collect()
            if clash:
                raise Conflict(f"artifacts cannot change: {[tuple(r) for r in clash]}")
            folder = staged
            if not met.isEmpty():
                fresh = mine.join(stored, ["id", "kind"], "left_anti")
                if fresh.isEmpty():
                    return version
                folder = self._stage(fresh)
            if self._claim(version + 1, [*self.folders(version), folder]):
                return version + 1
        raise RuntimeError(f"{tries} other writers came first")

    def vacuum(self) -> int:
        """Delete staged folders that the newest version does not name, while nobody writes; their number."""
        named = set(self.folders(self.version()))
        gone = [s.getPath() for s in self._fs.listStatus(self._at("data")) if s.getPath().getName() not in named]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def evaluation_faults(generations: DataFrame, evaluations: DataFrame) -> DataFrame:
    """(id, fault) of evaluations (id, generation_hash, hash, payload) that may not be merged with generations (id, hash)."""
    body = F.try_parse_json("payload")
    said = F.try_variant_get(body, "$.status", "string")
    reward = F.try_variant_get(body, "$.evaluation.reward_info", "variant").try_cast("map<string,variant>")
    rows = evaluations.join(generations.select("id", F.col("hash").alias("made")), "id", "left")
    fault = (
        F.when(~said.eqNullSafe(F.lit("evaluation_complete")), "only a complete evaluation can be merged")
        .when(~F.col("made").eqNullSafe(F.col("generation_hash")), "evaluation does not match generation")
        .when(~hashed(F.col("payload")).eqNullSafe(F.col("hash")), "evaluation has another hash")
        .when(reward.isNull(), "reward_info is missing")
    )
    return rows.select("id", fault.alias("fault")).where("fault IS NOT NULL")


def merge_evaluation(store: ArtifactStore, evaluations: DataFrame) -> int:
    """Add a `merged` artifact for each evaluation (id, generation_hash, hash, payload): the generation with its reward, under both hashes.

    Generations stay as they are. One evaluation that may not be merged stops all; the same evaluation merged again changes nothing; another one for an
    id that is merged is a Conflict.
    """
    generations = store.read().where("kind = 'generation'")
    bad = evaluation_faults(generations, evaluations).limit(3).collect()
    if bad:
        raise ValueError(f"evaluations that cannot be merged: {[tuple(r) for r in bad]}")
    both = evaluations.alias("e").join(generations.select("id", F.col("payload").alias("generation")), "id")
    fields = F.try_parse_json("generation").try_cast("map<string,variant>")
    reward = F.try_variant_get(F.try_parse_json("payload"), "$.evaluation.reward_info", "variant")
    parts = F.concat(F.transform(F.map_entries(F.map_filter(fields, lambda k, _: k != "reward_info")), lambda f: F.concat(F.to_json(F.array(f["key"])), F.lit(" "), F.to_json(f["value"]))), F.array(F.concat(F.lit('["reward_info"] '), F.to_json(reward))))
    # Names are written by Spark as lists of one text; what stands between the brackets is the name in quotes.
    simulation = F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r'^\[("(?:\\.|[^"\\])*")\] ', "$1:")), ","), F.lit("}"))
    merged = F.concat(F.lit('{"evaluation_sha256":"'), F.col("hash"), F.lit('","generation_sha256":"'), F.col("generation_hash"), F.lit('","simulation":'), simulation, F.lit(',"status":"merged"}'))
    return store.commit(both.select("id", F.lit("merged").alias("kind"), merged.alias("payload")))


def summary(store: ArtifactStore) -> DataFrame:
    """(kind, n) of the newest version."""
    return store.read().groupBy("kind").agg(F.count("*").alias("n"))
