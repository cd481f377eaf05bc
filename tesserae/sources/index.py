"""A written index: immutable segments, deletes, and versioned commits.

``path/segments/s`` holds a segment's documents (with each field's length) and
its postings, range-partitioned and sorted by (field, term), so a term's rows
lie in few row groups.  ``path/commits/n.json`` names the segments and deletes
of version n with user data; a commit appears by a rename, so readers see whole
versions.  A delete is a row (id, limit): it hides the id in segments numbered
below the limit, so documents added later survive.  A set norm is a row too.

Segments are merged level by level: as soon as ``merge_factor`` segments stand on
one level of size, they become one of the next.  A writer holds the index's lock.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.similarity import Similarity, decoded_norm
from tesserae.plans import ast as A
from tesserae.plans.search import DOC, POSITIONS, Compiler, Leaf, ScanView, bound, in_terms, norm_name, payload_slot, slot, spread
from tesserae.schema import Schema


def audit(postings: DataFrame) -> DataFrame:
    """One row over (term, doc, tf, positions): counts, and the postings that break an invariant."""
    bad = (F.size("positions") != F.col("tf")) | (F.col("positions") != F.sort_array("positions")) | (F.element_at("positions", 1) < 0)
    per_term = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.count_if(bad).alias("bad"))
    return per_term.agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"), F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))


class Files:
    """Small files beside the tables, by the session's own filesystem layer."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path_of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.root = path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.path_of(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path_of(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all; an existing file is an error."""
        # some filesystems overwrite on a rename, so the check comes first; one writer at a time is the rule here
        if self.fs.exists(self.path_of(f"{self.root}/{name}")):
            raise FileExistsError(f"{name} was written by another")
        temp = self.path_of(f"{self.root}/{name}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temp)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(temp, self.path_of(f"{self.root}/{name}")):
            self.fs.delete(temp, False)
            raise FileExistsError(f"{name} was written by another")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path_of(f"{self.root}/{name}"), True)

    def create_new(self, name: str) -> bool:
        """An empty file; false if it is there already."""
        try:
            return bool(self.fs.createNewFile(self.path_of(f"{self.root}/{name}")))
        except Exception as e:  # some filesystems raise where others say no
            if "exist" in str(e).lower():
                return False
            raise


class LockTaken(RuntimeError):
    pass


class Lock:
    """A file that one holder at a time can create; ``wait`` seconds are spent on getting it."""

    def __init__(self, files: Files, name: str = "write.lock", wait: float = 1.0, poll: float = 0.1):
        self.files, self.name, self.wait, self.poll, self.held = files, name, wait, poll, False

    def obtain(self) -> None:
        until = time.monotonic() + self.wait
        while not self.files.create_new(self.name):
            if time.monotonic() >= until:
                raise LockTaken(f"{self.files.root}/{self.name} is held by another writer")
            time.sleep(self.poll)
        self.held = True

    def release(self) -> None:
        if self.held:
            self.files.delete(self.name)
            self.held = False

    def is_locked(self) -> bool:
        return self.files.fs.exists(self.files.path_of(f"{self.files.root}/{self.name}"))

    def __enter__(self) -> Lock:
        self.obtain()
        return self

    def __exit__(self, *_) -> None:
        self.release()


def unlock(spark: SparkSession, path: str) -> None:
    """Removes the lock that a writer left behind which ended without ``close``."""
    Files(spark, path).delete("write.lock")


@dataclass
class Commit:
    version: int
    segments: list[str] = field(default_factory=list)
    deletes: list[str] = field(default_factory=list)
    next_segment: int = 0
    user_data: dict[str, str] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)  # documents of each segment, deleted ones too
    norms: list[str] = field(default_factory=list)

    def copy(self) -> Commit:
        return Commit(self.version, list(self.segments), list(self.deletes), self.next_segment, dict(self.user_data), dict(self.sizes), list(self.norms))


def commits(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in Files(spark, path).names("commits") if n.endswith(".json")]


def read_commit(spark: SparkSession, path: str, version: int | None = None) -> Commit:
    known = commits(spark, path)
    if not known:
        raise FileNotFoundError(f"no index at {path}")
    version = max(known) if version is None else version
    return Commit(**json.loads(Files(spark, path).read(f"commits/{version:08d}.json")))


class IndexWriter:
    """Adds, updates and deletes documents; nothing shows before ``commit``.

    ``keep`` commits stay readable (1: only the last); ``hold`` keeps one until
    ``release``.  With ``lock`` the writer holds the index until ``close``, and a
    second one raises LockTaken.  ``merge_factor`` segments of one level of size
    are merged when they are committed; None merges only when asked.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema, create: bool = False, keep: int = 1, lock: bool = False, merge_factor: int | None = None, merge_least: int = 1000):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep
        self.merge_factor, self.merge_least = merge_factor, merge_least
        self.files = Files(spark, path)
        self.lock = Lock(self.files)
        if lock:
            self.lock.obtain()
        known = commits(spark, path)
        self.base = read_commit(spark, path) if known else Commit(0)
        self.held: set[int] = set()
        self.now = Commit(self.base.version) if create else self.base.copy()
        self.now.next_segment = self.base.next_segment

    def close(self) -> None:
        self.lock.release()

    def _table(self, folder: str, df: DataFrame) -> str:
        name = f"{folder}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}/{name}")
        return name

    def add(self, docs: DataFrame) -> None:
        """A new segment of documents with distinct ids.

        A document's postings are made within its row, once, by as many tasks as
        there are cores; what is shuffled is one range exchange of the finished
        postings, which are written first, so that its sample reads their keys only.
        """
        n = self.now.next_segment
        docs = spread(docs)
        view = ScanView(docs, self.schema)
        fields = sorted(self.schema.fields)
        name = f"{n:06d}-{uuid.uuid4().hex}"
        lengths = [F.size(view._stream(f)).alias(f"__len_{f}") for f in fields]
        docs.select(*docs.columns, *lengths).write.parquet(f"{self.path}/segments/{name}/docs")
        boost = F.col(self.schema.boost_col).cast("double") if self.schema.boost_col else F.lit(1.0)
        entries = [bound(self._tokens(view, f), self._entries(f)) for f in fields]
        # from the segment's own files, which have the tasks' sizes
        rows = self.spark.read.schema(docs.schema).parquet(f"{self.path}/segments/{name}/docs").select(F.col(self.schema.id_col).alias("doc"), boost.alias("boost"), F.explode(F.concat(*entries)).alias("x"))
        postings = rows.select("x.field", "x.term", "doc", "x.len", "boost", "x.tf", "x.positions", "x.payloads")
        held = f"rewrite/{uuid.uuid4().hex}"
        postings.write.parquet(f"{self.path}/{held}")
        postings = self.spark.read.schema(postings.schema).parquet(f"{self.path}/{held}")
        n_parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        postings.repartitionByRange(n_parts, "field", "term", "doc").sortWithinPartitions("field", "term", "doc").write.parquet(f"{self.path}/segments/{name}/postings")
        self.files.delete(held)
        self.now.segments.append(name)
        self.now.sizes[name] = self.spark.read.parquet(f"{self.path}/segments/{name}/docs").count()  # from the files' footers
        self.now.next_segment = n + 1

    def _tokens(self, view: ScanView, f: str) -> Column:
        payload = self.schema.fields[f].payload
        value = (lambda t: payload(t).cast("double")) if payload else (lambda t: F.lit(None).cast("double"))
        return F.transform(view._stream(f), lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos"), value(t).alias("payload")))

    def _entries(self, f: str) -> Callable[[Column], Column]:
        """A field's postings of one document, of its tokens."""
        paid = self.schema.fields[f].payload is not None
        none = F.lit(None).cast("array<double>")

        def of(tokens: Column) -> Column:
            def entry(term: Column, own: Column) -> Column:
                payloads = F.transform(own, lambda t: t["payload"]) if paid else none
                return F.struct(F.lit(f).alias("field"), term.alias("term"), F.size(tokens).alias("len"), F.size(own).cast("long").alias("tf"), F.transform(own, lambda t: t["pos"]).alias("positions"), payloads.alias("payloads"))

            return in_terms(tokens, entry)

        return of

    def delete_ids(self, ids: DataFrame) -> None:
        rows = ids.select(F.col(ids.columns[0]).alias("id")).distinct().withColumn("below", F.lit(self.now.next_segment))
        self.now.deletes.append(self._table("deletes", rows))

    def delete_terms(self, field_name: str, *terms: str) -> None:
        self.delete_query(A.any_of(*[A.Term(field_name, t) for t in terms], disable_coord=True))

    def delete_query(self, query: A.Query) -> None:
        if self.now.segments:
            self.delete_ids(Compiler(self.reader(), query).hits().select(self.schema.id_col))

    def update(self, field_name: str, term: str, docs: DataFrame) -> None:
        """Deletes what has the term, and adds."""
        self.delete_terms(field_name, term)
        self.add(docs)

    def delete_all(self) -> None:
        self.now.segments, self.now.deletes, self.now.sizes, self.now.norms = [], [], {}, []

    def undelete_all(self) -> None:
        """Documents that deletes hide, and that no merge has left out, show again."""
        self.now.deletes = []

    def set_norm(self, ids: DataFrame, field_name: str, value: float) -> None:
        """The norm of a field of these documents from now on; it holds for the segments there are."""
        rows = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        rows = rows.select("id", F.lit(field_name).alias("field"), decoded_norm(F.lit(float(value))).alias("norm"), F.lit(self.now.next_segment).alias("below"), F.lit(len(self.now.norms)).alias("no"))
        self.now.norms.append(self._table("norms", rows))

    def add_indexes(self, *readers: IndexReader) -> None:
        """Other indexes' live documents, as segments of this one."""
        for r in readers:
            self.add(r.docs())

    def _merge(self, segments: list[str]) -> None:
        """These segments' live documents as one new segment; set norms end with the segments they were set in."""
        part = IndexReader(self.spark, self.path, self.schema, self.now.copy())
        part.commit.segments = list(segments)
        held = f"{self.path}/rewrite/{uuid.uuid4().hex}"
        part.docs().write.parquet(held)
        self.now.segments = [s for s in self.now.segments if s not in segments]
        self.now.sizes = {s: n for s, n in self.now.sizes.items() if s not in segments}
        self.add(self.spark.read.parquet(held))
        self.files.delete(held[len(self.path) + 1 :])

    def optimize(self, max_segments: int = 1) -> None:
        """At most so many segments: the smallest are merged; with one segment, deletes are gone from it."""
        if max_segments < 1:
            raise ValueError("max_segments must be 1 at least")
        extra = len(self.now.segments) - max_segments
        if extra > 0 or max_segments == 1 and self.now.segments and self.now.deletes:
            by_size = sorted(self.now.segments, key=lambda s: (self.now.sizes.get(s, 0), s))
            self._merge(by_size[: extra + 1])
        if max_segments == 1:
            self.now.deletes = []

    def expunge_deletes(self) -> None:
        """Segments with hidden documents are written anew without them; the others stay."""
        if not self.now.deletes or not self.now.segments:
            return
        r = self.reader()
        live = {x["__seg"]: x["n"] for x in r._live(r._all("docs"), self.schema.id_col).groupBy("__seg").agg(F.count("*").alias("n")).collect()}  # a row a segment
        for s in list(self.now.segments):
            n = live.get(int(s[:6]), 0)
            if not n:
                self.now.segments.remove(s)
                self.now.sizes.pop(s, None)
            elif n < self.now.sizes.get(s, n + 1):
                self._merge([s])
        self.now.deletes = []

    def maybe_merge(self) -> bool:
        """Merges as long as ``merge_factor`` segments stand on one level; sizes up to ``merge_least`` are one level."""
        done = False
        while self.merge_factor:
            levels: dict[int, list[str]] = {}
            for s in self.now.segments:
                size = max(self.now.sizes.get(s, 1), self.merge_least)
                levels.setdefault(math.floor(math.log(size / self.merge_least, self.merge_factor) + 1e-9), []).append(s)
            full = [own for _, own in sorted(levels.items()) if len(own) >= self.merge_factor]
            if not full:
                return done
            self._merge(full[0][: self.merge_factor])
            done = True
        return done

    def reader(self) -> IndexReader:
        """A view of what is committed and what is pending."""
        return IndexReader(self.spark, self.path, self.schema, self.now.copy())

    def prepare(self, user_data: dict[str, str] | None = None) -> Commit:
        """Writes the next version beside the commits, where no reader sees it; ``commit`` shows it, ``rollback`` removes it."""
        c = self.now.copy()
        c.version = self.base.version + 1
        c.user_data = dict(user_data or self.now.user_data)
        self.files.delete(f"pending/{c.version:08d}.json")
        self.files.write(f"pending/{c.version:08d}.json", json.dumps(vars(c)))
        self.prepared = c
        return c

    prepared: Commit | None = None

    def commit(self, user_data: dict[str, str] | None = None) -> int:
        if self.prepared is None:
            self.maybe_merge()
            self.prepare(user_data)
        c = self.prepared
        self.files.write(f"commits/{c.version:08d}.json", json.dumps(vars(c)))
        self.files.delete(f"pending/{c.version:08d}.json")
        self.prepared, self.base, self.now = None, c, c.copy()
        for v in commits(self.spark, self.path)[: -self.keep]:
            if v not in self.held:
                self.files.delete(f"commits/{v:08d}.json")
        return c.version

    def rollback(self) -> None:
        if self.prepared is not None:
            self.files.delete(f"pending/{self.prepared.version:08d}.json")
        self.prepared, self.now = None, self.base.copy()

    def hold(self) -> int:
        self.held.add(self.base.version)
        return self.base.version

    def release(self, version: int) -> None:
        self.held.discard(version)


@dataclass
class IndexReader:
    """A version of an index as a view for searching."""

    spark: SparkSession
    path: str
    schema: Schema
    commit: Commit

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: Schema, version: int | None = None) -> IndexReader:
        return cls(spark, path, schema, read_commit(spark, path, version))

    def is_current(self) -> bool:
        return max(commits(self.spark, self.path)) == self.commit.version

    def reopen(self) -> IndexReader:
        return self if self.is_current() else IndexReader.open(self.spark, self.path, self.schema)

    def _all(self, part: str) -> DataFrame:
        if not self.commit.segments:
            raise ValueError("the index has no segments")
        parts = [self.spark.read.parquet(f"{self.path}/segments/{s}/{part}").withColumn("__seg", F.lit(int(s[:6]))) for s in self.commit.segments]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _live(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose document no delete hides."""
        if not self.commit.deletes:
            return rows
        gone = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/deletes/{d}") for d in self.commit.deletes]).groupBy(F.col("id").alias("__gone")).agg(F.max("below").alias("__below"))
        return rows.join(gone, (F.col(key) == F.col("__gone")) & (F.col("__seg") < F.col("__below")), "left_anti")

    def docs(self) -> DataFrame:
        """Live documents with their stored columns."""
        d = self._live(self._all("docs"), self.schema.id_col)
        return d.select(*[c for c in d.columns if not c.startswith("__")])

    def max_doc(self) -> int:
        if all(s in self.commit.sizes for s in self.commit.segments):
            return sum(self.commit.sizes[s] for s in self.commit.segments)
        return self._all("docs").count()

    def num_docs(self) -> int:
        if not self.commit.deletes and all(s in self.commit.sizes for s in self.commit.segments):
            return sum(self.commit.sizes[s] for s in self.commit.segments)
        return self.docs().count()

    def postings(self, f: str) -> DataFrame:
        return self._live(self._all("postings").where(F.col("field") == f), "doc").select("term", F.col("doc").alias(DOC), "tf", "positions")

    def dictionary(self, f: str) -> DataFrame:
        return self.postings(f).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def _norms(self) -> DataFrame | None:
        """(id, field, norm, below) that was set last."""
        if not self.commit.norms:
            return None
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/norms/{n}") for n in self.commit.norms])
        last = rows.groupBy("id", "field").agg(F.max(F.struct("no", "below", "norm")).alias("x"))
        return last.select(F.col("id").alias("__nid"), F.col("field").alias("__nf"), F.col("x.below").alias("__nbelow"), F.col("x.norm").alias("__nset"))

    def _with_set_norms(self, rows: DataFrame, fields: list[str]) -> DataFrame:
        """Rows (DOC, __seg, norms) with set norms in place of those of the lengths; __seg goes."""
        found = self._norms()
        for f in fields if found is not None else ():
            own = found.where(F.col("__nf") == f)
            rows = rows.join(own, (F.col(DOC) == F.col("__nid")) & (F.col("__seg") < F.col("__nbelow")), "left").withColumn(norm_name(f), F.coalesce("__nset", norm_name(f))).drop("__nid", "__nf", "__nbelow", "__nset")
        return rows.drop("__seg")

    def _found(self, leaves: list[Leaf]) -> DataFrame:
        """Postings of the leaves; the test of field and term reaches the sorted files."""
        tests = [(F.col("field") == x.field) & ((F.col("term") == x.term) if x.pred is None else x.pred(F.col("term"))) for x in leaves]
        return self._live(self._all("postings").where(reduce(lambda a, b: a | b, tests)), "doc")

    def doc_freqs(self, leaves: list[Leaf], sim: Similarity) -> tuple[list[int], int]:
        n = self.num_docs()
        if not leaves:
            return [], n
        rows = self._found(leaves).groupBy("field", "term").agg(F.count("*").alias("df")).collect()  # a row per query term
        df = {(r["field"], r["term"]): r["df"] for r in rows}
        return [df.get((x.field, x.term), 0) for x in leaves], n

    def rows(self, leaves: list[Leaf], norm_fields: set[str], columns: set[str], all_docs: bool, sim: Similarity) -> DataFrame:
        out = None
        if leaves:
            aggs: list[Column] = []
            for i, x in enumerate(leaves):
                mine = (F.col("field") == x.field) & ((F.col("term") == x.term) if x.pred is None else x.pred(F.col("term")))
                value = F.transform("positions", lambda _: F.col("term")) if x.terms else F.col("positions")
                kind = "array<string>" if x.terms else POSITIONS
                aggs.append(F.sort_array(F.flatten(F.collect_list(F.when(mine, value)))).cast(kind).alias(slot(i)))
                if self.schema.fields[x.field].payload is not None:
                    paid = F.arrays_zip(F.col("positions").alias("p"), F.col("payloads").alias("v"))
                    aggs.append(F.transform(F.sort_array(F.flatten(F.collect_list(F.when(mine, paid)))), lambda y: sim.payload_score(y["v"]).cast("double")).alias(payload_slot(i)))
            norms = [F.max(F.when(F.col("field") == f, F.struct("len", "boost"))).alias(f"__l_{f}") for f in sorted(norm_fields)]
            out = self._found(leaves).groupBy(F.col("doc").alias(DOC)).agg(*aggs, *norms, F.max("__seg").alias("__seg"))  # a document lives in one segment
            for f in sorted(norm_fields):
                spec = self.schema.fields[f]
                out = out.withColumn(norm_name(f), sim.norm(F.col(f"__l_{f}.len"), F.col(f"__l_{f}.boost") * spec.boost) if spec.norms else F.lit(1.0)).drop(f"__l_{f}")
        if out is not None:
            out = self._with_set_norms(out, sorted(norm_fields))
        if not all_docs and not columns and out is not None:
            return out
        d = self._live(self._all("docs"), self.schema.id_col)
        boost = F.col(self.schema.boost_col).cast("double") if self.schema.boost_col else F.lit(1.0)
        own = [(sim.norm(F.col(f"__len_{f}"), boost * self.schema.fields[f].boost) if self.schema.fields[f].norms else F.lit(1.0)).alias(f"__own_{f}") for f in sorted(norm_fields)]
        base = d.select(F.col(self.schema.id_col).alias("__id"), "__seg", *[F.col(c).alias(f"__c_{c}") for c in sorted(columns)], *own)
        if out is None:
            named = base.select(F.col("__id").alias(DOC), "__seg", *[F.col(f"__own_{f}").alias(norm_name(f)) for f in sorted(norm_fields)], *[f"__c_{c}" for c in sorted(columns)])
            return self._with_set_norms(named, sorted(norm_fields))
        joined = base.join(out, F.col("__id") == F.col(DOC), "left" if all_docs else "inner")
        slots = [F.coalesce(slot(i), F.array().cast("array<string>" if x.terms else POSITIONS)).alias(slot(i)) for i, x in enumerate(leaves)]
        slots += [F.coalesce(payload_slot(i), F.array().cast("array<double>")).alias(payload_slot(i)) for i, x in enumerate(leaves) if self.schema.fields[x.field].payload is not None]
        return joined.select(F.col("__id").alias(DOC), *slots, *[F.coalesce(norm_name(f), f"__own_{f}").alias(norm_name(f)) for f in sorted(norm_fields)], *[f"__c_{c}" for c in sorted(columns)])


@dataclass
class MultiIndexView:
    """Several written indexes of one schema and distinct ids as one view: statistics are sums over all, so scores are comparable."""

    readers: list[IndexReader]

    @property
    def schema(self) -> Schema:
        return self.readers[0].schema

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    def rows(self, leaves: list[Leaf], norm_fields: set[str], columns: set[str], all_docs: bool, sim: Similarity) -> DataFrame:
        return self._union([r.rows(leaves, norm_fields, columns, all_docs, sim) for r in self.readers])

    def doc_freqs(self, leaves: list[Leaf], sim: Similarity) -> tuple[list[int], int]:
        own = [r.doc_freqs(leaves, sim) for r in self.readers]
        return [sum(x) for x in zip(*(df for df, _ in own))], sum(n for _, n in own)

    def postings(self, f: str) -> DataFrame:
        return self._union([r.postings(f) for r in self.readers])

    def dictionary(self, f: str) -> DataFrame:
        return self._union([r.dictionary(f) for r in self.readers]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def multi(*frames: DataFrame) -> DataFrame:
    """Several readers' documents as one; statistics over the union are global."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def parallel(first: DataFrame, *others: DataFrame, on: str = "doc_id") -> DataFrame:
    """The same documents' fields from several tables; the first table that has a field wins.

    All must have one set of ids; a table with more or fewer rows is an error.
    """
    sizes = reduce(DataFrame.union, [x.agg(F.count("*").alias("n")) for x in (first, *others)]).distinct().limit(2).collect()  # one job for all
    if len(sizes) > 1:
        raise ValueError("parallel tables must have one number of documents")
    out = first
    for o in others:
        new = [c for c in o.columns if c == on or c not in out.columns]
        out = out.join(o.select(*new), on)
    return out


def files_as_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, contents) of text files, the time at minutes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.date_format("modificationTime", "yyyyMMddHHmm").alias("modified"), F.decode("content", "UTF-8").alias("contents"))


def fields_of(docs: DataFrame, load: Callable[[str], bool]) -> DataFrame:
    """Stored fields that a selector names."""
    return docs.select(*[c for c in docs.columns if load(c)])
