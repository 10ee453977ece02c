"""Incremental batch intake and request deduplication (Structured Streaming).

Intake admits whole batches. What has been admitted is keyed state: a streaming aggregation holds the least and the
greatest admitted value of each rule and key, so a micro-batch never reads what was published. A batch that has fully
arrived claims its keys, and its messages ask for them; the state answers with the keys that were named; the answers give
each claim its vote. A batch whose keys all agree is published and commits its values, any other one is refused. Messages
are files that the stream itself reads, all of them, in its next micro-batch, so Spark's own triggers drive the exchange:

    rows -> claims -> answers, votes -> published rows and commits -> answers for the batches that waited
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from boardlake.session import shared_folder
from boardlake.sources.corpora import signature

Rules = Mapping[str, tuple[str, Sequence[str]]]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KEY = ["rule", "key"]
MESSAGE = "rule string, key string, value string"


def facts(df: DataFrame, keep: Sequence[str], rules: Rules) -> DataFrame:
    """(rule, key, value): what each row says about each key; unknown keys say nothing."""
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"),
                              F.to_json(F.struct(*values)).alias("value")) for name, (key, values) in rules.items()])
    return df.select(*keep, F.inline(rows)).where(F.col("key").isNotNull()).distinct()


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def admitted(messages: DataFrame) -> DataFrame:
    """(rule, key, low, high) of every key named by a message: its least and greatest admitted value, null before there is one."""
    return messages.groupBy(*KEY).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def voted(claims: DataFrame, answers: DataFrame) -> DataFrame:
    """Undecided claims (round, batch, rule, key, value, yes) with the votes that ``answers`` allow.

    With an admitted value a claim gets a yes if it says the same, else a no. Without one all claims get a yes that agree
    with the earliest claim of their key and precede any that differs, in the order of (round, batch); the others wait.
    Waiting is always for earlier claims, so it ends. Claims of keys without an answer keep what they have.
    """
    place = F.struct("round", "batch")
    asked = claims.join(answers.withColumn("answered", F.lit(True)), KEY, "left")
    said = asked.where("answered AND low IS NULL").groupBy(*KEY, "value").agg(F.min(place).alias("place"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("place"))
    free = said.withColumn("rank", rank).where("rank <= 2").groupBy(*KEY).agg(
        F.min_by("value", "rank").alias("first"), F.max(F.when(F.col("rank") == 2, F.col("place"))).alias("other"))
    agrees = (F.col("value") == F.col("first")) & (F.col("other").isNull() | (place < F.col("other")))
    yes = F.when(F.col("low").isNotNull(), (F.col("low") == F.col("high")) & (F.col("value") == F.col("low"))).when(
        agrees, True).otherwise(F.col("yes"))
    return asked.join(free, KEY, "left").select("round", "batch", *KEY, "value", yes.alias("yes"))


class _Versions:
    """Tables with one version for each micro-batch; a replayed micro-batch replaces its own."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *map(str, parts))))

    def exists(self, name: str) -> bool:
        return self.files.exists(self._path(name, "_SUCCESS"))

    def numbers(self, name: str) -> list[int]:
        """Complete versions, in order."""
        found = self.files.globStatus(self._path(name, "intake=*", "_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName()[len("intake="):]) for f in found)

    def before(self, name: str, number: int, schema) -> DataFrame:
        """The latest version before ``number``; older ones are removed."""
        old = [n for n in self.numbers(name) if n < number]
        for n in old[:-1]:
            self.files.delete(self._path(name, f"intake={n}"), True)
        if not old:
            nothing = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            return self.spark.range(0).where("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in nothing])
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/intake={old[-1]}")

    def write(self, df: DataFrame, name: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/intake={number}")


class _Intake:
    """One micro-batch: votes are counted, complete batches make claims, decided ones are published or dropped."""

    def __init__(self, schema, published: str, pending: str, batch_id: str, size: str, rules: Rules):
        self.schema, self.published, self.pending = schema, published, pending
        self.batch_id, self.size, self.rules = batch_id, size, rules
        batch_type = schema[batch_id].dataType.simpleString()
        self.vote_schema = f"round bigint, batch {batch_type}, {MESSAGE}, yes boolean"

    def __call__(self, events: DataFrame, number: int) -> None:
        events = _kept(events, "events")
        kinds = {r.new for r in events.select(F.col("row").isNotNull().alias("new")).distinct().collect()}
        if not kinds:
            return
        held: list[DataFrame] = []
        try:
            self._step(events, number, kinds, lambda df: held.append(df.persist()) or df)
        finally:
            for df in held:
                df.unpersist()

    def _step(self, events: DataFrame, number: int, kinds: set[bool], once) -> None:
        """``once`` keeps small tables of keys and batches for the writes below; lost parts are computed again."""
        batch, place, at = self.batch_id, ["round", "batch"], F.lit(number).cast("long")
        tables = _Versions(events.sparkSession, self.pending)
        new = events.where("row IS NOT NULL").select("row.*").withColumn("_round", F.lit(None).cast("long"))
        open_ = tables.before("voting", number, self.vote_schema)
        if False in kinds:
            open_ = once(voted(open_, events.where("row IS NULL").select(*KEY, "low", "high")))
        decided = open_.groupBy(*place).agg(F.bool_and(F.coalesce("yes", F.lit(False))).alias("admitted"),
                                            F.bool_or(~F.col("yes")).alias("bad")).where("admitted OR bad").drop("bad")
        rows = tables.before("rows", number, new.schema).unionByName(new)
        # Batches of which all rows are there and none is being voted on: torn by their own facts, silent, or claiming.
        full = rows.where("_round IS NULL").groupBy(F.col(batch).alias("batch")).agg(
            F.count("*").alias("n"), F.max(self.size).alias("size")).where("n >= size").join(
            open_.select("batch").distinct(), "batch", "left_anti").select("batch")
        said = once(facts(rows.where("_round IS NULL").withColumnRenamed(batch, "batch").join(full, "batch", "left_semi"), ["batch"],
                          self.rules))
        torn = said.groupBy("batch", *KEY).agg(F.count("*").alias("n")).groupBy("batch").agg(F.max("n").alias("most"))
        started = once(full.join(torn, "batch", "left").select(at.alias("round"), "batch", F.when(F.col("most").isNull(), True).when(
            F.col("most") > 1, False).alias("admitted")))
        claims = once(said.join(started.where("admitted IS NULL").select(*place), "batch").select(*place, *KEY, "value"))
        decided = once(decided)
        waiting = rows.where("_round IS NULL").drop("_round").join(
            started.select(F.col("round").alias("_round"), F.col("batch").alias(batch), "admitted"), batch, "left")
        ended = rows.where("_round IS NOT NULL").join(
            decided.select(F.col("round").alias("_round"), F.col("batch").alias(batch), "admitted"), [batch, "_round"], "left").unionByName(
            waiting)
        said_now = claims.select(*KEY, F.lit(None).cast("string").alias("value"))
        if False in kinds:  # keys of refused batches are asked for again, as others may wait there
            said_now = said_now.unionByName(open_.join(decided, place).select(
                *KEY, F.when(F.col("admitted"), F.col("value")).alias("value")))
        still = open_.join(decided, place, "left_anti").unionByName(claims.withColumn("yes", F.lit(None).cast("boolean")))
        published = ended.where("admitted").select(*self.schema.names)
        writes = [lambda: published.write.mode("overwrite").parquet(f"{self.published}/intake={number}"),
                  lambda: tables.write(said_now, "messages", number), lambda: tables.write(still, "voting", number),
                  lambda: tables.write(ended.where("admitted IS NULL").select(new.columns), "rows", number)]
        with ThreadPoolExecutor(len(writes)) as pool:  # small jobs that do not wait for each other
            for done in [pool.submit(w) for w in writes]:
                done.result()


def stream_intake(stream: DataFrame, published: str, pending: str, checkpoint: str, batch_id: str, size: str,
                  rules: Rules, drain: bool = True) -> StreamingQuery:
    """Append admissible batches to the published table, each as a whole.

    A rule ``name: (key, values)`` says that a key has one combination of values: a group one split, the same
    bytes one identity. A batch is refused if it contradicts itself, what is published, or an earlier admitted
    batch; batches that are complete in one micro-batch are taken in the order of their ids. ``size`` is the number of rows of a row's
    batch: rows wait below ``pending`` until their batch is complete and decided, so it does not matter how
    files are cut into micro-batches. Rows of a batch id that come after its decision are a batch of their own.

    The published table is read once, when the stream starts for the first time, to seed the keys; from then on it is only
    appended to. A restarted stream goes on from its checkpoint. Each micro-batch writes its own ``intake=<n>``
    folders in overwrite mode: replayed after a failure it replaces its own output and nothing else.
    With ``drain`` the call returns the stopped query after everything available, messages included, is
    settled; otherwise the query goes on.
    """
    spark = stream.sparkSession
    intake = _Intake(stream.schema, published, pending, batch_id, size, rules)
    tables = _Versions(spark, f"{pending}/messages")
    if not tables.exists("seed"):
        known = facts(spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(published), [], rules)
        known.write.mode("overwrite").parquet(f"{pending}/messages/seed")
    answers = admitted(spark.readStream.schema(MESSAGE).option("recursiveFileLookup", "true")
                       .option("cleanSource", "delete").parquet(f"{pending}/messages"))
    row = F.struct(*[F.col(c) for c in stream.columns])
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in answers.schema]
    events = stream.select(row.alias("row"), *nothing).unionByName(
        answers.withColumn("row", F.lit(None).cast(stream.schema)))
    provider = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        query = events.writeStream.outputMode("update").foreachBatch(intake).option("checkpointLocation", checkpoint).start()
    finally:
        spark.conf.set(PROVIDER, provider)
    if drain:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return query


def stream_dedupe(stream: DataFrame, time: str, delay: str, cols: Sequence[str]) -> DataFrame:
    """First result per content signature; state is dropped behind the watermark."""
    return (stream.withColumn("signature", signature(*cols)).withWatermark(time, delay)
            .dropDuplicatesWithinWatermark(["signature"]))
