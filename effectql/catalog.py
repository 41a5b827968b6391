"""Tables of the card domain: schemas, a versioned registry, and storage as Parquet with transactions."""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import dml
from .operators.extract import CLAUSE, PREDICATE, UNIT
from .plans.cards import flat

SCHEMAS: dict[str, str] = {
    "schema_migrations": "version int, name string, applied_at timestamp",
    "raw_source": (
        "source_id long, source_name string, source_version string, uri string, file_path string, content_sha256 string, "
        "payload_bytes long, record_count long, fetched_at timestamp, notes string"
    ),
    "raw_card_record": "raw_id long, source_id long, card_id long, external_id string, payload_sha256 string, payload_json string",
    "card": (
        "card_id long, canonical_name string, card_category string, sub_category string, race string, attribute string, level_rank int, "
        "link_rating int, pendulum_scale int, atk int, def int, type_mask long, race_mask long, attribute_mask long, category_mask long, "
        "setcode_mask long, alias_passcode long, text_lang string, raw_text string, primary_source_id long, created_at timestamp, updated_at timestamp"
    ),
    "card_name": "card_id long, lang string, name_kind string, name string, is_primary int",
    "external_id": "card_id long, source string, external_id string",
    "card_archetype": "card_id long, archetype string, archetype_raw string",
    "card_flag": "card_id long, flag string",
    "card_text": "card_id long, lang string, kind string, source string, text string, text_sha256 string, updated_at timestamp",
    "effect_unit": f"unit_id long, card_id long, {UNIT}, parser_version string",
    "effect_clause": f"clause_id long, unit_id long, card_id long, {CLAUSE}",
    "effect_predicate": f"predicate_id long, clause_id long, unit_id long, card_id long, {PREDICATE}",
    "effect_flat": f"predicate_id long, clause_id long, unit_id long, card_id long, {PREDICATE}, {CLAUSE}, {UNIT}, parser_version string",
    "effect_source": "card_id long, signature string, errors int",
}
KEYS: dict[str, list[str]] = {
    "schema_migrations": ["version"], "raw_source": ["source_id"], "raw_card_record": ["raw_id"], "card": ["card_id"],
    "card_name": ["card_id", "lang", "name_kind", "name"], "external_id": ["source", "external_id"], "card_archetype": ["card_id", "archetype"],
    "card_flag": ["card_id", "flag"], "card_text": ["card_id", "lang", "kind", "source"], "effect_unit": ["card_id", "unit_index"],
    "effect_clause": ["unit_id", "clause_index"], "effect_predicate": ["clause_id", "pred_index"],
    "effect_flat": ["predicate_id"], "effect_source": ["card_id"],
}
PARENTS = {
    "raw_card_record": ("raw_source", "source_id"), "card_name": ("card", "card_id"), "external_id": ("card", "card_id"),
    "card_archetype": ("card", "card_id"), "card_flag": ("card", "card_id"), "card_text": ("card", "card_id"), "effect_unit": ("card", "card_id"),
    "effect_clause": ("effect_unit", "unit_id"), "effect_predicate": ("effect_clause", "clause_id"),
    "effect_flat": ("effect_predicate", "predicate_id"), "effect_source": ("card", "card_id"),
}
#: Versions of the registry; each names the tables that it brings.
MIGRATIONS = (
    (1, "canonical_card", ("raw_source", "raw_card_record", "card", "card_name", "external_id", "card_archetype", "card_flag")),
    (2, "card_text", ("card_text",)),
    (3, "effects", ("effect_unit", "effect_clause", "effect_predicate")),
    (4, "incremental_effects", ("effect_flat", "effect_source")),
)
#: Tables that lie in buckets by card_id, so that what is asked of a card meets the card without a shuffle.
BY_CARD = frozenset(n for n, schema in SCHEMAS.items() if "card_id long" in schema and n != "raw_card_record")

#: Segments of a table before the last ones are merged.
SEGMENTS = 8
#: Versions of a table that stay registered, for frames that still read them.
VERSIONS = 8


class MigrationError(RuntimeError):
    """A registry that contradicts the stored ledger."""


@dataclass(frozen=True)
class Segment:
    """A folder of rows of a table, or none ("") for a table that has had no rows yet.

    ``touched``: a folder of card_ids whose rows in earlier segments no longer count.
    """

    rows: str
    n: int = 0
    touched: str | None = None
    bucketed: bool = False


@dataclass
class Manifest:
    """What a version of the store consists of."""

    tables: dict[str, list[Segment]] = field(default_factory=dict)
    #: The last batch of each stream that this version holds.
    streams: dict[str, int] = field(default_factory=dict)
    #: Counts that are kept by differences.
    totals: dict[str, int] = field(default_factory=dict)
    buckets: int = 0

    @classmethod
    def read(cls, text: str) -> Manifest:
        told = json.loads(text)
        if "tables" not in told:  # a folder for each table, as stores were first written
            return cls({name: [Segment(folder, -1)] for name, folder in told.items()})
        return cls({name: [Segment(**s) for s in segments] for name, segments in told["tables"].items()}, told["streams"], told["totals"], told["buckets"])

    def written(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True).encode()

    def copy(self) -> Manifest:
        return Manifest({k: list(v) for k, v in self.tables.items()}, dict(self.streams), dict(self.totals), self.buckets)

    def folders(self, name: str) -> set[str]:
        return {f for s in self.tables.get(name, []) for f in (s.rows, s.touched) if f}


@dataclass
class Delta:
    """A change of a table: ``rows`` are added, and take the place of all rows of the cards in ``touched``, if given.

    ``dealt``: rows lie in tasks by their buckets already (hashed by card_id into as many as there are buckets, or a
    multiple of it), and are written where they lie.
    """

    rows: DataFrame
    touched: DataFrame | None = None
    dealt: bool = False


class Store:
    """Tables under a folder, and manifests that say which segments of a table count.

    A write goes to new folders and counts once a manifest that names them is published, by one rename. A
    ``transaction`` publishes all its writes at once, so a reader sees all tables before or after a
    change, and a change that failed leaves nothing behind but folders that no manifest names; they go
    with the next one.

    A ``Delta`` adds a segment, so that a small change writes little. Readers leave out rows of cards that a
    later segment touches. Beyond SEGMENTS segments the last ones are merged, those that the one before exceeds twice
    in rows; so a row is rewritten as often as the logarithm of the table at most, and a large first segment seldom.

    Tables that belong to cards are bucketed and sorted by card_id, ``buckets`` of them from the first write on;
    their segments are partitions of one catalog table, so that joins by card_id, those with the touched cards
    included, need no shuffle.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self._staged: Manifest | None = None
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: dict[str, list[str]] = {}

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, *parts: str) -> list[str]:
        path, fs = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifests(self) -> list[str]:
        return [x for x in self._listed("_manifests") if x.endswith(".json") and not x.startswith((".", "_"))]

    def _manifest(self, name: str) -> Manifest:
        path, fs = self._path("_manifests", name)
        stream = fs.open(path)
        try:
            return Manifest.read(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> Manifest:
        """The newest version, or, in a transaction, that which it will publish."""
        if self._staged is not None:
            return self._staged
        done = self._manifests()
        return self._manifest(done[-1]) if done else Manifest(buckets=self._buckets)

    def _publish(self, after: Manifest, before: Manifest, number: int) -> None:
        hidden, fs = self._path("_manifests", f"_{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(after.written()))
        out.close()
        target, _ = self._path("_manifests", f"{number:08d}.json")
        if fs.exists(target) or not fs.rename(hidden, target):
            fs.delete(hidden, False)
            raise RuntimeError("another writer has changed the store")
        for name in after.tables:  # the version before stays, for readers that still use it
            kept = after.folders(name) | before.folders(name)
            if after.folders(name) != before.folders(name):
                for folder in self._listed(name):
                    if folder not in kept:
                        fs.delete(self._path(name, folder)[0], True)
        for old in self._manifests()[:-2]:
            fs.delete(self._path("_manifests", old)[0], False)

    @contextmanager
    def transaction(self) -> Iterator[Manifest]:
        """All writes inside count at the end at once, or, after an error, not at all. Inside another one it joins that."""
        if self._staged is not None:
            yield self._staged
            return
        done = self._manifests()
        before = self._manifest(done[-1]) if done else Manifest()
        before.buckets = before.buckets or self._buckets
        self._staged = before.copy()
        try:
            yield self._staged
            for name, segments in list(self._staged.tables.items()):
                if segments != before.tables.get(name):
                    self._merge(name)
            after, self._staged = self._staged, None
            if after != before or not done:
                self._publish(after, before, int(done[-1].split(".")[0]) + 1 if done else 1)
        finally:
            self._staged = None

    # -- segments

    def _save(self, name: str, rows: DataFrame, folder: str, bucketed: bool, dealt: bool = False) -> int:
        """Write rows into a folder of the table; returns how many there were."""
        seen = Observation()
        path, n = f"{self.root}/{name}/{folder}", self.current().buckets
        if bucketed:
            entry = f"effectql_writing_{folder.replace('-', '_')}"
            lying = (rows if dealt else rows.repartition(n, "card_id")).observe(seen, F.count(F.lit(1)).alias("n"))
            lying.write.format("parquet").bucketBy(n, "card_id").sortBy("card_id").option("path", path).saveAsTable(entry)
            self.spark.sql(f"DROP TABLE {entry}")  # the files stay
        else:
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return seen.get["n"]

    def _segment(self, name: str, rows: DataFrame, touched: DataFrame | None = None, dealt: bool = False) -> Segment:
        typed = rows.to(StructType.fromDDL(SCHEMAS[name]))
        version, bucketed = uuid.uuid4().hex, name in BY_CARD
        n = self._save(name, typed, version, bucketed, dealt)
        if touched is None:
            return Segment(version, n, None, bucketed)
        self._save(name, touched.select(F.col("card_id").cast("long")).distinct(), f"{version}-touched", bucketed)
        return Segment(version, n, f"{version}-touched", bucketed)

    def _registered(self, name: str, part: str, folders: list[tuple[int, str]], schema: str) -> DataFrame:
        """The bucketed folders as one catalog table with a partition ``__segment`` for each."""
        key = hashlib.sha256(json.dumps([self.root, name, part, folders]).encode()).hexdigest()[:20]
        table, slot = f"effectql_{name}_{part}_{key}", f"{name}-{part}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(schema))
            n, home = self.current().buckets, f"{self.root}/{name}"
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}, __segment INT) USING parquet PARTITIONED BY (__segment) CLUSTERED BY (card_id) SORTED BY (card_id) INTO {n} BUCKETS LOCATION '{home}'"
            )
            places = " ".join(f"PARTITION (__segment = {k}) LOCATION '{home}/{folder}'" for k, folder in folders)
            self.spark.sql(f"ALTER TABLE {table} ADD {places}")
            known = self._tables.setdefault(slot, [])
            known.append(table)
            if len(known) > VERSIONS:  # their folders are gone by now
                self.spark.sql(f"DROP TABLE IF EXISTS {known.pop(0)}")
        return self.spark.table(table)

    def _rows(self, name: str, segments: list[Segment], part: str = "rows") -> DataFrame:
        """The rows of some neighbouring segments that none of them has replaced."""
        segments = [s for s in segments if s.rows]
        if not segments:  # known to be empty when a plan is made, so that no task is started for it
            return self.spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS[name]))).where("false")
        plain = [s for s in segments if not s.bucketed]
        if plain and len(plain) < len(segments):  # a table of before buckets, changed since: its first segment
            first = self._rows(name, plain)
            rest = segments[len(plain) :]
            touched = self._touched(name, rest, part)
            kept = first if touched is None else first.join(touched.select("card_id").distinct(), "card_id", "left_anti").select(*first.columns)
            return kept.unionByName(self._rows(name, rest, part))
        if plain:
            return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.root}/{name}/{s.rows}" for s in plain))
        rows = self._registered(name, part, [(k, s.rows) for k, s in enumerate(segments)], SCHEMAS[name])
        columns = [c for c in rows.columns if c != "__segment"]
        touched = self._touched(name, segments[1:], part)
        if touched is None:
            return rows.select(*columns)
        later = touched.select("card_id", (F.col("__segment") + 1).alias("__later"))
        same = (rows["card_id"] == later["card_id"]) & (later["__later"] > rows["__segment"])
        return rows.join(later, same, "left_anti").select(*columns)

    def _touched(self, name: str, segments: list[Segment], part: str) -> DataFrame | None:
        """card_id and __segment (its place in ``segments``) of all cards that these segments touch."""
        folders = [(k, s.touched) for k, s in enumerate(segments) if s.touched]
        return self._registered(name, f"{part}_touched", folders, "card_id long") if folders else None

    def _merge(self, name: str, most: int = SEGMENTS) -> None:
        """Merge the last segments of a staged table, if there are more than ``most``.

        Those are merged that the one before them exceeds twice in rows, and at least as many as are too many.
        """
        segments = self.current().tables[name]
        if len(segments) <= most:
            return
        at = most - 1
        while at and segments[at - 1].n <= 2 * sum(s.n for s in segments[at:]):
            at -= 1
        last = segments[at:]
        # what the segments before have of these cards is still to be left out
        ids = [self._touched(name, [s], "merged").select("card_id") for s in last if s.touched] if at else []
        merged = self._segment(name, self._rows(name, last, "merging"), functools.reduce(DataFrame.unionByName, ids) if ids else None)
        segments[at:] = [merged]

    def compact(self) -> None:
        """Merge all segments of each table into one."""
        with self.transaction() as after:
            for name, segments in list(after.tables.items()):
                if any(s.rows for s in segments):
                    self._merge(name, most=1)
                else:
                    self.write(name, self.read(name))

    def folder(self, name: str) -> str | None:
        """The folder of a table that lies in one segment."""
        found = self.current().tables.get(name, [])
        return f"{self.root}/{name}/{found[0].rows}" if len(found) == 1 else None

    def read(self, name: str) -> DataFrame:
        return self._rows(name, self.current().tables.get(name, []))

    def write(self, name: str, rows: DataFrame | Delta) -> None:
        """Replace a table, or change it by a Delta."""
        with self.transaction() as after:
            known = after.tables.get(name, [])
            if not isinstance(rows, Delta):
                after.tables[name] = [self._segment(name, rows)]
            elif any(s.n for s in known):  # -1: not counted
                after.tables[name] = [*known, self._segment(name, rows.rows, rows.touched, rows.dealt)]
            else:
                after.tables[name] = [self._segment(name, rows.rows, dealt=rows.dealt)]

    def registered_batch(self, stream: str) -> int:
        """The last batch of a stream that the store holds; -1 before any."""
        return self.current().streams.get(stream, -1)

    def tables(self) -> dict[str, DataFrame]:
        known = self.current().tables
        return {name: self.read(name) for name in SCHEMAS if name in known or name != "effect_flat"}

    def migrate(self, migrations=MIGRATIONS) -> list[int]:
        """Bring the store to the newest version; returns the versions that were applied now."""
        numbers = [m[0] for m in migrations]
        if len(set(numbers)) < len(numbers):
            raise MigrationError("a version occurs twice")
        known = {r["version"]: r["name"] for r in self.read("schema_migrations").collect()}
        for number, name, _ in migrations:
            if known.get(number, name) != name:
                raise MigrationError(f"version {number} is {known[number]}, not {name}")
        fresh = sorted(m for m in migrations if m[0] not in known)
        if fresh:
            with self.transaction():
                self._apply(fresh)
        return [m[0] for m in fresh]

    def _apply(self, fresh: list[tuple]) -> None:
        known = self.current().tables
        for t in dict.fromkeys(t for _, _, tables in fresh for t in tables):
            if t not in known:
                if t == "effect_flat" and any(s.n for s in known.get("effect_unit", [])):
                    rows = flat(*(self.read(x) for x in ("effect_unit", "effect_clause", "effect_predicate")))
                    self.write(t, rows.select(*StructType.fromDDL(SCHEMAS[t]).names))
                else:
                    known[t] = [Segment("")]
        if fresh:
            rows = self.spark.createDataFrame([(n, name) for n, name, _ in fresh], "version int, name string")
            self.write("schema_migrations", self.read("schema_migrations").unionByName(rows.withColumn("applied_at", F.current_timestamp())))

    def analyze(self, prefix: str = "effectql_") -> list[str]:
        """Register the newest versions as catalog tables and gather statistics of all their columns; returns the names."""
        self.compact()
        names = []
        for name in SCHEMAS:
            folder = self.folder(name)
            if folder:
                table = f"{prefix}{name}"
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                self.spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{folder}'")
                self.spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
                names.append(table)
        return names

    def audit(self) -> DataFrame:
        """table, problem and n: keys that occur twice, and children without parent."""
        parts = []
        for name, keys in KEYS.items():
            parts.append((name, "duplicate key", dml.duplicates(self.read(name), keys)))
        for name, (parent, key) in PARENTS.items():
            parts.append((name, "no parent", dml.orphans(self.read(name), self.read(parent), key, key)))
        rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), F.lit(p).alias("problem"), "n") for t, p, df in parts]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out.where("n > 0")
