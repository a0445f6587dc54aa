"""An append-only store of signals and outcomes that lasts between runs.

    protocol.json            what the store is for; written once
    parts/<hash>/            Parquet, named by the fingerprint of its rows, never changed
    manifests/v00000001.json the parts and sessions of one version

A commit writes its part to a folder of its own, checks it against what is stored, gives it its name, and publishes the next
manifest by one rename that fails if the version exists. Readers see the parts of the last manifest alone, so an append
that fails, or is lost half-way, is not seen; what it staged is removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import kept

RECORDED, ALREADY = "RECORDED", "ALREADY_RECORDED"
SIGNALS = "signal_id string, code string, signal_date date, episode_id string, payload string, first_in_episode boolean"
OUTCOMES = "signal_id string, horizon int, observed_date date, payload string"
FIELDS = {kind: [f.split(" ")[0] for f in schema.split(", ")] for kind, schema in (("signals", SIGNALS), ("outcomes", OUTCOMES))}


class StoreError(ValueError):
    """An append that was refused; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class Store:
    def __init__(self, spark: SparkSession, root: str, protocol: dict):
        """Open the store at ``root``, or found it; another protocol than the one it was founded with is refused."""
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._system = self._path("").getFileSystem(self._conf)
        self._context = self._hadoop.FileContext.getFileContext(self._system.getUri(), self._conf)
        kind = getattr(self._hadoop, "Options$Rename")
        self._no_overwrite = spark.sparkContext._gateway.new_array(kind, 1)
        self._no_overwrite[0] = kind.NONE
        said = json.dumps(protocol, sort_keys=True)
        for folder in ("parts", "manifests", "staged"):
            self._system.mkdirs(self._path(folder))
        if not self._create("protocol.json", said) and json.loads(self._text("protocol.json")) != protocol:
            raise StoreError("PROTOCOL_CONFLICT", "the store was founded for another protocol")

    # Files -------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _text(self, name: str) -> str:
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]

    def _moved(self, source: str, target: str) -> bool:
        """Rename, or leave all as it is and say no if the target exists."""
        if self._system.exists(self._path(target)):
            return False
        try:
            self._context.rename(self._path(source), self._path(target), self._no_overwrite)
        except Exception as error:
            if self._system.exists(self._path(target)):
                return False
            raise StoreError("STORE_WRITE_FAILURE", target) from error
        return True

    def _create(self, name: str, text: str) -> bool:
        """A whole new file, or none: it appears under its name when all of it is written."""
        if self._system.exists(self._path(name)):
            return False
        staged = f"staged/{uuid.uuid4().hex}"
        out = self._system.create(self._path(staged), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        done = self._moved(staged, name)
        if not done:
            self._system.delete(self._path(staged), False)
        return done

    # Reading -----------------------------------------------------------------------------------------

    def head(self) -> dict:
        """The last version's manifest; of a new store, version 0 without parts."""
        found = sorted(s.getPath().getName() for s in self._system.listStatus(self._path("manifests")) if s.getPath().getName().startswith("v"))
        return json.loads(self._text(f"manifests/{found[-1]}")) if found else {"version": 0, "sessions": {}, "parts": []}

    def read(self, kind: str, head: dict | None = None) -> DataFrame:
        """All ``signals`` or ``outcomes`` of a version (the last, unless given), with the part that holds each."""
        parts = [p["name"] for p in (head or self.head())["parts"] if p["kind"] == kind]
        schema = SIGNALS if kind == "signals" else OUTCOMES
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, part string")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/parts/{p}" for p in parts])
        return rows.withColumn("part", F.regexp_extract("_metadata.file_path", r"/parts/([^/]+)/", 1))

    def verify(self) -> DataFrame:
        """part, kind and status of each part of the last version: its rows are hashed again and compared with its name."""
        from barlattice.operators import identity as idn

        head = self.head()
        out = self.spark.createDataFrame([(p["name"], p["kind"], p["rows"]) for p in head["parts"]], "part string, kind string, declared_rows long")
        found = None
        for kind in ("signals", "outcomes"):
            own = idn.fingerprint(self.read(kind, head), ["part"], FIELDS[kind]).select(F.col("part").alias("__part"), "n_rows", "fingerprint")
            found = own if found is None else found.unionByName(own)
        x = out.join(found, F.col("part") == F.col("__part"), "left")
        status = F.when(F.col("n_rows").isNull(), "EMPTY").when(F.col("n_rows") != F.col("declared_rows"), "ROWS_DIFFER").when(F.col("fingerprint") != F.col("part"), "CONTENT_DIFFERS").otherwise("OK")
        return x.select("part", "kind", status.alias("status"))

    # Appending ---------------------------------------------------------------------------------------

    def _commit(self, head: dict, kind: str, rows: DataFrame, sessions: dict) -> dict:
        from barlattice.operators import identity as idn

        staged = f"staged/{uuid.uuid4().hex}"
        target = None
        try:
            rows.write.parquet(f"{self.root}/{staged}")
            schema = SIGNALS if kind == "signals" else OUTCOMES
            back = self.spark.read.schema(schema).parquet(f"{self.root}/{staged}")
            whole = idn.fingerprint(back, [], FIELDS[kind]).first()
            if self._moved(staged, f"parts/{whole.fingerprint}"):
                target = f"parts/{whole.fingerprint}"
            manifest = {"version": head["version"] + 1, "sessions": {**head["sessions"], **sessions}, "parts": [*head["parts"], {"name": whole.fingerprint, "kind": kind, "rows": whole.n_rows}]}
            if not self._create(f"manifests/v{manifest['version']:08d}.json", json.dumps(manifest, sort_keys=True)):
                raise StoreError("STORE_CHANGED", "another append was published first")
            target = None
            return manifest
        finally:
            self._system.delete(self._path(staged), True)
            if target and target.split("/")[1] not in {p["name"] for p in self.head()["parts"]}:
                self._system.delete(self._path(target), True)

    def record_sessions(self, rows: DataFrame) -> dict:
        """Append the signals of whole sessions: signal_id, code, signal_date, episode_id, payload.

        A session that is stored with the same rows is left; with others it is a conflict. A new session before the last
        stored one is refused, and so is a signal_id that is stored or comes twice. The first signal of an episode, by
        date, code and signal_id, is marked. Nothing is stored if anything is refused.
        """
        from barlattice.operators import identity as idn

        rows = kept(rows.select("signal_id", "code", F.col("signal_date").cast("date").alias("signal_date"), "episode_id", "payload"))
        if not rows.where("signal_id IS NULL OR signal_id = '' OR code IS NULL OR signal_date IS NULL OR episode_id IS NULL OR payload IS NULL").isEmpty():
            raise StoreError("SOURCE_INVALID", "a field is missing")
        days = idn.fingerprint(rows, ["signal_date"], ["signal_id", "code", "episode_id", "payload"]).collect()  # one row a session
        head = self.head()
        known, fresh = head["sessions"], {}
        for r in days:
            day = r.signal_date.isoformat()
            if day not in known:
                fresh[day] = {"rows": r.n_rows, "sha256": r.fingerprint}
            elif known[day]["sha256"] != r.fingerprint:
                raise StoreError("SESSION_CONFLICT", f"{day} is stored with other signals")
        if not fresh:
            return {"status": ALREADY, "version": head["version"], "sessions": 0, "signals": 0}
        if known and min(fresh) < max(known):
            raise StoreError("BACKFILL_FORBIDDEN", f"{min(fresh)} precedes {max(known)}")
        dates = self.spark.createDataFrame([(d,) for d in fresh], "d string").select(F.to_date("d").alias("__date"))
        new = kept(rows.join(F.broadcast(dates), F.col("signal_date") == F.col("__date")).drop("__date"))
        stored = self.read("signals", head)
        if not new.groupBy("signal_id").count().where("count > 1").isEmpty() or not new.join(stored.select("signal_id"), "signal_id", "left_semi").isEmpty():
            raise StoreError("SIGNAL_CONFLICT", "a signal_id is stored, or twice in the batch")
        first = new.groupBy("episode_id").agg(F.min(F.struct("signal_date", "code", "signal_id")).alias("f"))
        first = first.join(stored.select("episode_id").distinct(), "episode_id", "left_anti").select(F.col("f.signal_id").alias("__first"))
        new = new.join(first, F.col("signal_id") == F.col("__first"), "left").withColumn("first_in_episode", F.col("__first").isNotNull()).drop("__first")
        manifest = self._commit(head, "signals", new, fresh)
        return {"status": RECORDED, "version": manifest["version"], "sessions": len(fresh), "signals": manifest["parts"][-1]["rows"]}

    def append_outcomes(self, rows: DataFrame) -> dict:
        """Append outcomes of stored signals: signal_id, horizon, observed_date, payload; signals are never changed.

        An outcome that is stored (or comes twice) with the same content is taken once; with another it is a conflict.
        It needs a stored signal and a date not before the signal's. Nothing is stored if anything is refused.
        """
        rows = rows.select("signal_id", F.col("horizon").cast("int").alias("horizon"), F.col("observed_date").cast("date").alias("observed_date"), "payload")
        rows = kept(rows.distinct())
        if not rows.where("signal_id IS NULL OR horizon IS NULL OR observed_date IS NULL OR payload IS NULL").isEmpty():
            raise StoreError("OUTCOME_INVALID", "a field is missing")
        if not rows.groupBy("signal_id", "horizon").count().where("count > 1").isEmpty():
            raise StoreError("OUTCOME_CONFLICT", "two outcomes of one horizon in the batch")
        head = self.head()
        dated = rows.join(self.read("signals", head).select("signal_id", "signal_date"), "signal_id", "left")
        if not dated.where("signal_date IS NULL").isEmpty():
            raise StoreError("SIGNAL_NOT_FOUND", "an outcome of no stored signal")
        if not dated.where("observed_date < signal_date").isEmpty():
            raise StoreError("OUTCOME_INVALID", "an outcome before its signal")
        stored = self.read("outcomes", head).select("signal_id", "horizon", F.col("observed_date").alias("__date"), F.col("payload").alias("__payload"))
        x = kept(rows.join(stored, ["signal_id", "horizon"], "left"))
        if not x.where("__payload IS NOT NULL AND (__payload <> payload OR __date <> observed_date)").isEmpty():
            raise StoreError("OUTCOME_CONFLICT", "an outcome is stored with another content")
        new = x.where("__payload IS NULL").select("signal_id", "horizon", "observed_date", "payload")
        if new.isEmpty():
            return {"status": ALREADY, "version": head["version"], "outcomes": 0}
        manifest = self._commit(head, "outcomes", new, {})
        return {"status": RECORDED, "version": manifest["version"], "outcomes": manifest["parts"][-1]["rows"]}
