"""Secret scans over a ledger of content-addressed blobs; DataFrame functions only.

Every historical version of every path is addressed by the SHA-256 of its text. The ledger is a Parquet folder with
one row per scanned (blob, rule, version) and the spans found there. A run scans only pairs the ledger does not
hold, one carrier row per blob, appends them, and joins the findings of the current rule versions back to all paths.

Positions come without user code: ``split`` gives what lies between the matches of a pattern and
``regexp_extract_all`` the matches, so running lengths are the starts. Lengths count code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import new_path
from .common import id_and_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more count."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: Runs are maximal, so a least length may stand in the pattern: a shorter run holds no longer one.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Cheap patterns that match wherever a rule can count; texts without one are not searched further.
_HINTS = {
    "assign": r"(?i:passw(?:or)?d|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
_BLOCK = 256
_SPANS = "array<struct<start:int,end:int>>"
_LEDGER = f"blob binary, rule string, version int, spans {_SPANS}"


def spans(text: Column, rule: Rule) -> Column:
    """Starts and ends (exclusive, in code points) of the leftmost non-overlapping matches that count.

    Matches are walked in blocks: a block starts behind the lengths of those before it and keeps what counts, so a text
    of very many matches costs little more than their number.
    """
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    sized = F.zip_with(found, counted, lambda m, c: F.struct(F.length(m).alias("width"), (F.length(c) >= rule.least).alias("ok")))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), sized,
                       lambda gap, m: F.struct(gap.alias("gap"), m["width"].alias("width"), m["ok"].alias("ok")))
    none = F.array().cast(_SPANS)

    def walked(block: Column, at: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["width"]
            span = F.array(F.struct(start.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(s["ok"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda acc, n: acc + n)

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is worked out once, however often ``use`` names it: a lambda's argument is."""
        return F.flatten(F.transform(F.array(value), use))

    def of_steps(given: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(given) - 1) / _BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(given, b * _BLOCK + 1, F.lit(_BLOCK)))
        return F.when(F.size(given) == 0, none).otherwise(bound(blocks, of_blocks))

    def of_blocks(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda block: total(F.transform(block, lambda s: s["gap"] + s["width"])))
        return bound(lengths, lambda known: F.flatten(F.transform(
            blocks, lambda block, b: walked(block, total(F.slice(known, F.lit(1), b))))))

    return bound(steps, of_steps)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one is begun where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], _LEDGER).write.parquet(path)
    return spark.read.schema(_LEDGER).parquet(path)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger has not seen, append it, and return per row of ``docs`` doc_id, blob and findings.

    ``findings`` is an array of (start, kind, end, rank) sorted by start, then by the order of the rules; it is empty
    where nothing was found. Rows with equal text, also repeated rows, share one scan. Null text is an empty
    version; a null doc_id is a path like any other. An empty table gives no rows and adds nothing.
    """
    spark = docs.sparkSession
    versions = id_and_text(docs).withColumn("blob", F.unhex(F.sha2("text", 256)))
    wanted = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, version int")
    carriers = versions.select("blob", "doc_id").groupBy("blob").agg(F.min("doc_id").alias("carrier"))
    seen = (
        open_ledger(spark, ledger).select("blob", "rule", "version")
        .join(F.broadcast(wanted), ["rule", "version"])
        .groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules
    )
    names = F.array(*[F.lit(r.name) for r in rules])
    pending = (
        carriers.join(seen, "blob", "left")
        .withColumn("pending", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("pending") > 0)
        .select(F.col("blob").alias("b"), "carrier", "pending")
    )
    texts = versions.join(
        pending, (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("carrier")),
    )
    none = F.array().cast(_SPANS)
    found = texts.select("blob", *[
        F.when(~F.array_contains("pending", r.name), None)
        .when(F.col("text").rlike(_HINTS.get(r.name, r.pattern)), spans(F.col("text"), r)).otherwise(none).alias(r.name)
        for r in rules
    ]).dropDuplicates(["blob"])  # repeated rows of a carrier
    rows = found.select("blob", F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.col(r.name).alias("spans")) for r in rules
    ])).alias("x")).select("blob", "x.*").where(F.col("spans").isNotNull())
    rows.write.mode("append").parquet(ledger)

    rank = F.map_from_arrays(names, F.array(*[F.lit(i) for i in range(len(rules))]))
    hits = (
        spark.read.schema(_LEDGER).parquet(ledger).where(F.size("spans") > 0)
        .join(F.broadcast(wanted), ["rule", "version"])
        .select("blob", F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), rank[F.col("rule")].alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind"),
        )).alias("part"))
        .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("part"))).alias("findings"))  # a pair appended twice is one
    )
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return (
        versions.select("doc_id", "blob").join(hits, "blob", "left")
        .select("doc_id", "blob", F.coalesce("findings", empty).alias("findings"))
    )


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per kind, the spans as text and their SHA-256."""
    text = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(name):
        return F.size(F.filter("findings", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *[count(r.name) for r in rules], F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span found in a text replaced by ``mark``; other columns stay as they are.

    Spans that overlap are replaced as one. Texts without findings, null ones included, are untouched.
    """
    hits = scan(docs, ledger, rules).where(F.size("findings") > 0).groupBy("blob").agg(F.first("findings").alias("_found"))
    cut = F.aggregate(
        "_found",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(
                acc["out"],
                F.when(s["start"] >= acc["at"], F.concat(
                    F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit("")),
            ).alias("out"),
        ),
    )
    clean = F.when(F.col("_found").isNull(), F.col("text")).otherwise(
        F.concat(cut["out"], F.substring(F.col("text"), cut["at"] + 1, F.length("text"))))
    own = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    tagged = docs.select(F.struct("*").alias("_row"), F.col("text"), own.alias("_blob"))
    joined = tagged.join(hits.withColumnRenamed("blob", "_b"), F.col("_blob") == F.col("_b"), "left")
    return joined.withColumn("_clean", clean).select(*[
        F.col("_clean").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns
    ])


def scan_all(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digest(scan(docs, new_path(spark, "ledger")))
