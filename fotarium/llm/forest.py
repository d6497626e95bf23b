"""Problem 2: new batches against everything accepted before, by a persisted hash forest.

The forest keeps signature permutations of every accepted record as sorted runs of files: tree
`content` starts with the digest and goes on with camera name and size, tree `name` the other way
round; tree `sizes` holds the sizes each digest was seen with. A small index has the first and last
label of every file. A batch locates its entries by range: the prefix of an entry's label is a range
of labels, the index tells which files it touches, only these are read (and of them only the pages
of the ranges, where the entries are few), and rows in a range are verified on the exact keys.
Prefixes are widened from the whole label to the first component alone until the recall measured
on a sample of the batch reaches the target; a target of 1 takes the width that provably holds all.
Accepted records become a new run; runs of one tier merge into one of the next. The rest of the
history is not read. Versions are written before they are used, so load() finds the last whole one."""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotarium.session import materialize, only, shared_dir

#: Prefix widths of labels, from narrow ranges to wide ones; a label has two components of 16 hex digits.
WIDTHS = (32, 24, 16)
#: The width at which a tree's range holds every duplicate: its first component follows from the exact key.
COMPLETE = {"content": 16, "name": 16, "sizes": 64}
EXACT = {"content": ["digest"], "name": ["name", "size"], "sizes": ["digest"]}
#: Probes on which the recall of a width is measured, at most.
SAMPLE = 256
#: Up to so many ranges are pushed into the scan as filters on the label.
PUSHED = 32
#: Probes of a batch of up to so many rows are sent to the tasks that read the touched files; those of larger
#: batches are joined by a shuffle of both.
SENT = 100_000
#: Runs of a tier that are merged into one of the next.
FAN = 4
ROWS_A_FILE = 1_000_000
POSTING = "label string, digest string, name string, size bigint, id bigint, low bigint, high bigint"

# The marks that copying tools put before and after a file's stem.
MARKS_BEFORE = r"^(copy of|kopie von|copie de|copia de|copia di|kopia av) +"
MARKS_AFTER = r"( *\(\d{1,4}\) *| *[-_ ] *(copy|copie|kopie|copia|kopia) *\d{0,4}|~\d{1,4}| +)$"
CAMERA_STEM = r"^[a-z0-9_]{4}\d{4}$"


def digest(text: Column) -> Column:
    """A SHA-256 digest as 64 lower-case hex digits however it was written; null if it is none."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, r"[\s ]+", "")), "^sha-?256[:=]", "")
    return F.when(F.regexp_like(bare, F.lit("^[0-9a-f]{64}$")), bare)


def camera_name(orig: Column) -> Column:
    """The camera's own file name, lower-case, without marks of copying tools (up to four of them);
    null if what is left isn't four letters, digits or `_` and four digits with an extension."""
    name = F.lower(F.trim(F.regexp_replace(orig, r"[\s ]+", " ")))
    stem, ext = F.regexp_extract(name, r"^(.*)\.([a-z0-9]+)$", 1), F.regexp_extract(name, r"^(.*)\.([a-z0-9]+)$", 2)
    for _ in range(4):
        stem = F.regexp_replace(F.regexp_replace(stem, MARKS_BEFORE, ""), MARKS_AFTER, "")
    return F.when(F.regexp_like(stem, F.lit(CAMERA_STEM)), F.concat(stem, F.lit("."), ext))


def records(df: DataFrame, record_id: str, file_digest: bool) -> DataFrame:
    """(id, size, d1, d2, name): each record once; a null id is no record."""
    df = only(df, record_id, "size", "orig", "sha256", *(["file_sha256"] if file_digest else []))
    second = digest(F.col("file_sha256")) if file_digest else F.lit(None).cast("string")
    df = df.filter(F.col(record_id).isNotNull())
    df = df.select(F.col(record_id).cast("bigint").alias("id"), F.col("size").cast("bigint"), digest(F.col("sha256")).alias("d1"), second.alias("d2"), camera_name(F.col("orig")).alias("name"))
    return df.distinct()


def _hex(*cols: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(*cols))), 16, "0")


def _label(tree: str, digest_: Column) -> Column:
    """The label of a record in a tree; null where its first component is."""
    none = F.lit("-" * 16)
    named = F.when(F.col("name").isNotNull() & F.col("size").isNotNull(), _hex("name", "size"))
    own = F.substring(digest_, 1, 16)
    return F.concat(own, F.coalesce(named, none)) if tree == "content" else F.concat(named, F.coalesce(own, none))


def _digest_sizes(recs: DataFrame) -> DataFrame:
    """(digest, low, high): the least and the greatest size of the records a digest stands on."""
    held = recs.select("size", F.explode(F.array("d1", "d2")).alias("digest")).filter(F.col("digest").isNotNull())
    return held.groupBy("digest").agg(F.min("size").alias("low"), F.max("size").alias("high"))


def _postings(recs: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """(tree, POSTING) of accepted records, and of the sizes of the digests seen."""
    each = F.array(*[F.struct(F.lit(t).alias("tree"), _label(t, F.col(d)).alias("label"), F.col(d).alias("digest")) for t, d in (("content", "d1"), ("content", "d2"), ("name", "d1"))])
    flat = recs.select("id", "name", "size", F.inline(each)).filter(F.col("label").isNotNull())
    none = F.lit(None).cast("bigint")
    out = flat.select("tree", "label", "digest", "name", "size", "id", none.alias("low"), none.alias("high"))
    if sizes is not None:
        out = out.unionByName(sizes.select(F.lit("sizes").alias("tree"), F.col("digest").alias("label"), "digest", F.lit(None).cast("string").alias("name"), none.alias("size"), none.alias("id"), "low", "high"))
    return out


def _folded(postings: DataFrame) -> DataFrame:
    """Equal postings as one: the least id, the widest size bounds."""
    return postings.groupBy("tree", "label", "digest", "name", "size").agg(F.min("id").alias("id"), F.min("low").alias("low"), F.max("high").alias("high"))


@dataclass(frozen=True)
class File:
    """One file of a sorted run, with its first and last label."""

    run: str
    tier: int
    tree: str
    file: str
    first: str
    last: str
    rows: int


@dataclass(frozen=True)
class HashForest:
    """All accepted records under `path`. `measured` has, of the last batch, the recall of each width
    by tree; `read` the (files, rows of these files) of each search."""

    spark: SparkSession
    path: str
    version: int = 0
    files: tuple[File, ...] = ()
    measured: dict = field(default_factory=dict, compare=False)
    read: list = field(default_factory=list, compare=False)

    # --- storing -----------------------------------------------------------------------------

    @classmethod
    def of(cls, history: DataFrame, path: str | None = None, known: DataFrame | None = None) -> HashForest:
        """The forest of records that are all accepted, as records() gives them, stored under `path` (a new
        place in the shared folder by default). Digests of `known` records count with their sizes
        though these aren't accepted."""
        spark = history.sparkSession
        empty = cls(spark, path or f"{shared_dir(spark)}/fotarium/forest-{uuid.uuid4().hex}")
        sizes = _digest_sizes(history if known is None else history.unionByName(known))
        sizes = materialize(sizes, "sizes")
        rows = 3 * history.count() + sizes.count()
        return empty._with_placeholders(sizes.filter("low < high").select("digest"))._grown(_postings(history, sizes), rows)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> HashForest:
        """The last whole version stored under `path`."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/index")
        fs = place.getFileSystem(conf)
        whole = [n for n in (s.getPath().getName() for s in (fs.listStatus(place) if fs.exists(place) else [])) if n.endswith(".json")]
        if not whole:
            raise FileNotFoundError(f"no forest in {path}")
        last = max(whole)
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/index/{last}"))
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return cls(spark, path, int(last[1:10]), tuple(File(**f) for f in json.loads(text)))

    def _stored(self, files: tuple[File, ...]) -> HashForest:
        forest = replace(self, version=self.version + 1, files=files)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        name = f"{self.path}/index/v{forest.version:09d}"
        place = jvm.org.apache.hadoop.fs.Path(f"{name}.part")
        fs = place.getFileSystem(conf)
        stream = fs.create(place, True)
        stream.write(bytearray(json.dumps([asdict(f) for f in files]).encode()))  # a record a file
        stream.close()
        whole = jvm.org.apache.hadoop.fs.Path(f"{name}.json")
        fs.delete(whole, False)
        if not fs.rename(place, whole):
            raise OSError(f"can't store {name}")
        return forest

    def _run(self, postings: DataFrame, rows: int, tier: int) -> list[File]:
        """Write postings as a sorted run and return its files."""
        run = uuid.uuid4().hex
        cores = self.spark.sparkContext.defaultParallelism
        parts = max(-(-rows // ROWS_A_FILE), min(cores, -(-rows // 50_000)), 1)
        ordered = postings.repartitionByRange(parts, "tree", "label").sortWithinPartitions("tree", "label")
        ordered.write.partitionBy("tree").parquet(f"{self.path}/runs/{run}")
        if not rows:
            return []
        held = self.spark.read.schema(f"{POSTING}, tree string").parquet(f"{self.path}/runs/{run}")
        seen = held.groupBy("tree", F.col("_metadata.file_path").alias("file")).agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count(F.lit(1)).alias("rows"))
        return [File(run, tier, r["tree"], r["file"], r["first"], r["last"], r["rows"]) for r in seen.collect()]  # a row a file

    def _with_placeholders(self, digests: DataFrame) -> HashForest:
        """The forest with more digests that stand on different sizes."""
        held, rest = [f for f in self.files if f.tree == "placeholders"], self.files
        if len(held) >= 2 * FAN:
            digests, rest = digests.unionByName(self.placeholders()), tuple(f for f in self.files if f.tree != "placeholders")
        place = f"{self.path}/placeholders/{uuid.uuid4().hex}"
        digests.distinct().write.parquet(place)
        return replace(self, files=(*rest, File("", 0, "placeholders", place, "", "", 0)))

    def placeholders(self) -> DataFrame:
        """(digest) of those that stand on records of different sizes and so count as none."""
        places = [f.file for f in self.files if f.tree == "placeholders"]
        held = self.spark.read.schema("digest string").parquet(*places)
        return held.distinct() if len(places) > 1 else held

    def _grown(self, postings: DataFrame, rows: int) -> HashForest:
        new = self._run(postings, rows, 0) if rows else []
        return self._stored(self._merged([*self.files, *new]))

    def _merged(self, files: list[File]) -> tuple[File, ...]:
        """Merge FAN runs of a tier into one of the next, as often as there are so many. A run's tier
        starts from its size, so a large first run isn't merged with small ones."""
        while True:
            rows: dict[str, int] = {}
            tiers: dict[str, int] = {}
            for f in files:
                if f.run:
                    rows[f.run] = rows.get(f.run, 0) + f.rows
                    tiers[f.run] = f.tier
            tiers = {r: max(t, max(0, (rows[r] // 1000).bit_length() // 2)) for r, t in tiers.items()}
            full = next((t for t in sorted(set(tiers.values())) if sum(x == t for x in tiers.values()) >= FAN), None)
            if full is None:
                return tuple(files)
            gone = {r for r, t in tiers.items() if t == full}
            parts = [self._read([f for f in files if f.run in gone and f.tree == t]).withColumn("tree", F.lit(t)) for t in EXACT if any(f.run in gone and f.tree == t for f in files)]
            merged = materialize(_folded(reduce(DataFrame.unionByName, parts)), "merged")
            files = [*[f for f in files if f.run not in gone], *self._run(merged, sum(rows[r] for r in gone), full + 1)]

    # --- searching ---------------------------------------------------------------------------

    def _read(self, files: list[File]) -> DataFrame:
        return self.spark.read.schema(POSTING).parquet(*[f.file for f in files])

    def _touched(self, tree: str, prefixes: DataFrame | list[str], width: int) -> list[File]:
        """The files of a tree that the ranges of the prefixes (column `at`, or a short list) touch. Runs
        are searched by bisection on their files' bounds."""
        runs: dict[str, list[File]] = {}
        for f in self.files:
            if f.tree == tree:
                runs.setdefault(f.run, []).append(f)
        held = [sorted(fs, key=lambda f: f.first) for fs in runs.values()]
        bounds = [([f.first[:width] for f in fs], [f.last[:width] for f in fs]) for fs in held]
        starts = [sum(len(fs) for fs in held[:i]) for i in range(len(held))]

        def locate(at: str) -> Iterator[int]:
            for base, (first, last) in zip(starts, bounds, strict=True):
                yield from range(base + bisect.bisect_left(last, at), base + bisect.bisect_right(first, at))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    seen.update(locate(at))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["n"])

        flat = [f for fs in held for f in fs]
        if isinstance(prefixes, list):
            return [flat[n] for n in sorted({n for at in prefixes for n in locate(at)})]
        numbers = prefixes.select("at").mapInArrow(run, "n int").distinct().collect()  # at most a row a file
        return [flat[r["n"]] for r in numbers]

    def ranges(self, tree: str, probes: DataFrame, width: int, drawn: list[str] | None = None, few_rows: bool = False) -> DataFrame | None:
        """All postings in the ranges of the probes (EXACT keys, `at`: a prefix of `width`) that pass the
        exact check, beside the probe; null if no file is touched. Probes are one row per distinct
        key and prefix, so no hot key meets a hot key. `drawn`: all prefixes, where they are a sample;
        `few_rows`: the probes are known to be at most SENT."""
        few = drawn or sorted({r["at"] for r in probes.select("at").distinct().limit(PUSHED + 1).collect()})
        files = self._touched(tree, few if drawn or len(few) <= PUSHED else probes, width)
        self.read.append((tree, len(files), sum(f.rows for f in files)))
        if not files:
            return None
        rows = self._read(files)
        if len(few) <= PUSHED:
            rows = rows.filter(reduce(Column.__or__, [F.col("label").between(at, at + "~") for at in few]))
        asked = probes.withColumnsRenamed({c: f"p_{c}" for c in (*EXACT[tree], "label") if c in probes.columns})
        met = rows.join(F.broadcast(asked) if few_rows or drawn else asked, F.substring("label", 1, width) == F.col("at"))
        for c in EXACT[tree]:
            met = met.filter(F.col(c) == F.col(f"p_{c}"))
        return met.drop(*[f"p_{c}" for c in EXACT[tree]])

    def _least(self, tree: str, met: DataFrame, false_: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, any_id, bare_id): the least id of the postings met, and of those without a digest."""
        if tree == "name":
            met = met.join(false_.select("digest", F.lit(True).alias("false_")), "digest", "left")
            met = met.withColumn("digest", F.when(F.col("false_").isNull(), F.col("digest")))
        bare = F.when(F.col("digest").isNull(), F.col("id"))
        return met.groupBy(*keys).agg(F.min("id").alias("any_id"), F.min(bare).alias("bare_id"))

    def widened(self, tree: str, labels: DataFrame, target: float) -> int:
        """The prefix width to search with: the narrowest whose recall, measured on up to SAMPLE entries (exact
        keys, `label`) against the complete range, reaches `target`. A sample can't prove a recall of
        1: a target of 1 ends at the complete width."""
        complete = COMPLETE[tree]
        drawn = {tuple(r) for r in labels.orderBy(F.xxhash64("label"), "label").limit(SAMPLE).collect()}
        sample = self.spark.createDataFrame(sorted(drawn), labels.schema).withColumn("at", F.substring("label", 1, complete))
        met = self.ranges(tree, sample, complete, sorted({r[-1][:complete] for r in drawn})) if drawn else None
        recall: dict[int, float] = {}
        if met is not None:
            best = [F.min(F.when(F.substring("label", 1, w) == F.substring("p_label", 1, w), F.col("id"))).alias(f"w{w}") for w in WIDTHS]
            found = met.groupBy("p_label").agg(*best)
            right = found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"w{w}") == F.col(f"w{complete}")).alias(f"w{w}") for w in WIDTHS]).first()
            recall = {w: right[f"w{w}"] / right["n"] for w in WIDTHS} if right["n"] else {}
        self.measured[tree] = recall
        return next((w for w in WIDTHS if w == complete or (target < 1 and recall.get(w, 0.0) >= target)), complete)

    def _search(self, tree: str, written: DataFrame, rows: DataFrame, false_: DataFrame, target: float, names: tuple[str, str], few_rows: bool) -> DataFrame:
        """`rows` with the least id of the postings that each meets in a tree, as `names`; `written` are
        the same rows as a table that is cheap to read again."""
        label = _label(tree, F.col("digest"))
        if not any(f.tree == tree for f in self.files):
            return rows.withColumns({n: F.lit(None).cast("bigint") for n in names})
        labels = written.select(*EXACT[tree], label.alias("label")).filter(F.col("label").isNotNull())
        width = self.widened(tree, labels, target)
        met = self.ranges(tree, labels.select(*EXACT[tree], F.substring("label", 1, width).alias("at")).distinct(), width, few_rows=few_rows)
        if met is None:
            return rows.withColumns({n: F.lit(None).cast("bigint") for n in names})
        least = self._least(tree, met, false_, [*EXACT[tree], "at"]).withColumnsRenamed({"any_id": names[0], "bare_id": names[1]})
        return rows.withColumn("at", F.substring(label, 1, width)).join(least, [*EXACT[tree], "at"], "left").drop("at")

    def admit(self, batch: DataFrame, target: float = 1.0, sizes_known: bool = False) -> tuple[DataFrame, HashForest]:
        """((seen_id, new_id) of the batch's duplicates, the forest with the rest accepted).

        `batch` is as records() gives it and is taken in the order of its ids: a record is accepted
        if it duplicates no record of the forest and none accepted before it in the batch; so
        several successive batches can be taken as one. Two records are duplicates if the new
        one's digest d1 is the other's d1 or d2, or if one of the two has no d1, sizes are equal
        and camera names are. A digest that stands on records of different sizes, as far as seen,
        counts as none. Ids that occur again with other values are taken as so many records.
        Of the history, only files in the ranges of the batch are read. `target` below 1 allows
        narrower ranges and so fewer rows. `sizes_known`: the batch was in `known` of of()."""
        forest, sizes = replace(self, measured={}, read=[]), None
        if not sizes_known:
            sizes = materialize(_digest_sizes(batch), "sizes")
            forest = forest._with_bounds(sizes)
        false_ = forest.placeholders()
        rows = batch.select("id", "size", F.when(F.col("size").isNotNull(), F.col("name")).alias("name"), F.col("d1").alias("digest"))
        rows = rows.join(false_.select("digest", F.lit(True).alias("false_")), "digest", "left")
        rows = rows.withColumn("digest", F.when(F.col("false_").isNull(), F.col("digest"))).drop("false_")
        rows = materialize(rows, "batch")
        few = rows.count() <= SENT
        held = forest._search("content", rows, rows, false_, target, ("c_id", "c_bare"), few)
        held = forest._search("name", rows, held, false_, target, ("n_id", "b_id"), few)
        old = F.least("c_id", F.when(F.col("digest").isNull(), F.col("n_id")).otherwise(F.col("b_id")))
        held = materialize(held.select("id", "size", "name", "digest", old.alias("old_id")), "held")
        new = _settled(held)
        found = _with_least(held, new, "acc")
        least = F.least("old_id", F.when(F.col("acc") < F.col("id"), F.col("acc")))
        found = materialize(found.groupBy(F.col("id").alias("new_id")).agg(F.min(least).alias("seen_id")).filter("seen_id is not null").select("seen_id", "new_id"), "found")
        fresh = new.select("id", "size", F.col("digest").alias("d1"), F.lit(None).cast("string").alias("d2"), "name")
        return found, forest._grown(_postings(fresh, sizes), 2 * fresh.count() + (0 if sizes is None else sizes.count()))

    def _with_bounds(self, sizes: DataFrame) -> HashForest:
        """The forest with the digests that the batch shows on another size than any record before."""
        met = self.ranges("sizes", sizes.select("digest", F.col("digest").alias("at")), 64) if any(f.tree == "sizes" for f in self.files) else None
        every = sizes if met is None else sizes.unionByName(met.select("digest", "low", "high"))
        every = every.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        return self._with_placeholders(every.filter("low < high").select("digest"))


def _with_least(rows: DataFrame, others: DataFrame, out: str) -> DataFrame:
    """`rows` with the least id among `others` that each duplicates, through per-key minima."""
    by_digest = others.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("d_"))
    by_name = others.filter(F.col("name").isNotNull()).groupBy("name", "size").agg(F.min("id").alias("n_"), F.min(F.when(F.col("digest").isNull(), F.col("id"))).alias("b_"))
    rows = rows.join(by_digest, "digest", "left").join(by_name, ["name", "size"], "left")
    least = F.least("d_", F.when(F.col("digest").isNull(), F.col("n_")).otherwise(F.col("b_")))
    return rows.withColumn(out, least).drop("d_", "n_", "b_")


def _settled(held: DataFrame) -> DataFrame:
    """(id, size, name, digest) of the accepted ones of a batch, of records equal in all but the id only the
    first, and of those without a digest and a name none: nothing can duplicate them.

    Each round accepts the records without an open duplicate before them, drops those that duplicate
    one of these, and goes on with the open rest alone: settled rows are not written again. Rounds
    are as many as the longest chain of records each of which waits for the one before."""
    open_ = held.groupBy("digest", "name", "size").agg(F.min("id").alias("id"), F.min("old_id").alias("old_id"))
    open_ = open_.filter(F.col("old_id").isNull() & (F.col("digest").isNotNull() | F.col("name").isNotNull())).drop("old_id")
    open_, accepted = materialize(open_, "open"), []
    while not accepted or not open_.isEmpty():
        flagged = materialize(_with_least(open_, open_, "wait").withColumn("wait", F.coalesce(F.col("wait") < F.col("id"), F.lit(False))), "waiting")
        now = flagged.filter("not wait").drop("wait")
        if flagged.filter("wait").isEmpty():
            return reduce(DataFrame.unionByName, [*accepted, now]).select("id", "size", "name", "digest")
        rest = _with_least(flagged.filter("wait").drop("wait"), now, "acc")
        accepted.append(now)
        open_ = materialize(rest.filter(F.col("acc").isNull() | (F.col("acc") > F.col("id"))).drop("acc"), "open")
    return reduce(DataFrame.unionByName, accepted).select("id", "size", "name", "digest")


def admit_batches(forest: HashForest, recs: DataFrame, starts: list[int], sizes_known: bool = False) -> tuple[DataFrame, HashForest]:
    """((seen_id, new_id), forest) after all batches, in order of id. `starts` has the first id of each
    batch. Batches are taken in blocks of one, four, sixteen and so on, so that their number costs only
    its logarithm in jobs and each record is merged as often; a block gives what its batches would."""
    starts, blocks, at = sorted(set(starts)), [], 0
    while at < len(starts):
        upto = at + 4 ** len(blocks)
        blocks.append((starts[at] if at else None, starts[upto] if upto < len(starts) else None))
        at = upto
    parts = []
    for low, high in blocks or [(None, None)]:
        block = recs
        if low is not None:
            block = block.filter(F.col("id") >= low)
        if high is not None:
            block = block.filter(F.col("id") < high)
        found, forest = forest.admit(block, sizes_known=sizes_known)
        parts.append(found)
    return reduce(DataFrame.unionByName, parts), forest
