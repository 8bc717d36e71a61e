"""The driver's tables as the engine's input tables.  Integer arithmetic on keys only, so any engine derives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.decimals import dec

LATIN_A_E = ("a", "e")
CYRILLIC_A_E = ("а", "е")


class Tables:
    """Reads the tables of one folder and derives the domain tables from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- documents as positioned text ----------------------------------------------------------------------------------------------

    def raw_lines(self) -> DataFrame:
        rows = self.read("documents").select("doc_id", F.posexplode(F.split("text", "\\n")).alias("i", "line")).where(F.trim("line") != "")
        return rows.withColumn("h", F.col("doc_id") * 31 + F.col("i") * 7)

    def spans(self) -> DataFrame:
        h = lambda m: F.col("h") % m
        line, tail = F.col("line"), F.substring("line", 2, 2**30)
        lookalike = F.translate(line, "".join(LATIN_A_E), "".join(CYRILLIC_A_E))
        text = F.when(h(73) == 0, F.concat(F.substring(line, 1, 1), F.lit("\u200b"), tail)).when(h(73) == 1, F.concat(F.lit("\u202e"), line)).when(h(79) == 0, lookalike).otherwise(line)
        x0 = F.when(h(71) == 1, 590).otherwise(72)
        y0 = 40 + 18 * (F.col("i") % 20) + F.when(h(71) == 0, 2000).otherwise(0)
        rows = self.raw_lines().select(
            "doc_id", F.col("i").alias("span_no"), F.concat_ws("-", "doc_id", "i").alias("span_id"), (F.floor(F.col("i") / 20) + 1).cast("int").alias("page"),
            (F.col("i") % 20 + 1).cast("int").alias("seqno"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
            (x0 + 5 * F.least(F.char_length(line), F.lit(90))).cast("double").alias("x1"), (y0 + 12).cast("double").alias("y1"),
            text.alias("text"), "line", "h",
            F.when(h(53) == 0, 1.5).when(h(53) == 1, 3.0).otherwise(10.0).alias("font_size"),
            F.when((F.col("doc_id") % 97 == 5) | (h(61) == 0), 3).otherwise(0).alias("render_mode"),
            F.when(h(59) == 0, 1.0).when(h(59) == 1, 0.85).otherwise(0.0).alias("r"),
            F.when(h(67) == 0, 0.02).otherwise(1.0).alias("opacity"),
        )
        return rows.withColumns({"g": F.col("r"), "b": F.col("r")})

    def pages(self) -> DataFrame:
        box = [F.lit(float(v)).alias(c) for v, c in ((0, "cx0"), (0, "cy0"), (612, "cx1"), (792, "cy1"))]
        return self.raw_lines().select("doc_id", (F.floor(F.col("i") / 20) + 1).cast("int").alias("page")).distinct().select("*", *box, F.lit(True).alias("ocr_available"))

    def images(self) -> DataFrame:
        def placed(rule, seqno, *box):
            return self.pages().where(rule).select("doc_id", "page", F.lit(seqno).alias("seqno"), *[F.lit(float(v)).alias(c) for v, c in zip(box, ("ix0", "iy0", "ix1", "iy1"))])

        return placed("doc_id % 97 = 5", 0, 0, 0, 612, 600).unionByName(placed("doc_id % 13 = 0", 1000, 60, 30, 560, 120))

    def lines(self) -> DataFrame:
        return self.spans().select("doc_id", "page", F.col("span_no").alias("line_no"), "x0", "y0", "x1", "y1", "text")

    def ocr_lines(self) -> DataFrame:
        seen = self.spans().where("render_mode <> 3 and font_size >= 4 and r < 0.85 and opacity >= 1 and y0 <= 792")
        return seen.select("doc_id", "page", F.col("span_no").alias("line_no"), "h", F.when(F.col("h") % 89 == 0, F.replace("line", F.lit("o"), F.lit("0"))).otherwise(F.col("line")).alias("text"))

    def ocr_words(self) -> DataFrame:
        words = self.ocr_lines().select("doc_id", "page", "line_no", "h", F.posexplode(F.split("text", " ")).alias("word_no", "text"))
        return words.select("doc_id", "page", F.lit(1).alias("block"), F.lit(1).alias("par"), F.col("line_no").alias("line"), "word_no", (20 + (F.col("h") + F.col("word_no")) % 80).cast("double").alias("conf"), "text")

    # -- runs ------------------------------------------------------------------------------------------------------------------------

    def run_lines(self) -> DataFrame:
        by = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
        numbered = self.read("lineitem").withColumn("ordinal", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*by)))
        return numbered.withColumns({"run_id": F.col("l_orderkey"), "requirement_id": F.concat_ws("-", "l_orderkey", "ordinal")})

    def requirements(self, texts: bool = True) -> DataFrame:
        """Without texts there is no need to look up parts."""
        rows = self.run_lines()
        if texts:
            part = self.read("part").select("p_partkey", "p_type", "p_name")
            rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
            lead = F.when(F.col("l_partkey") % 3 == 0, F.lit("5+ years experience with ")).otherwise(F.lit(""))
            text = F.concat(lead, "p_type", F.lit(" "), "p_name")
        else:
            text = F.lit(None).cast("string")
        return rows.select(
            "run_id", "ordinal", "requirement_id", text.alias("text"), F.lit("hard_skill").alias("kind"),
            (F.col("l_partkey") % 3 + 1).cast("int").alias("criticality"), F.when(F.col("l_returnflag") == "R", "preferred").otherwise("required").alias("necessity"),
            F.lit(None).cast("decimal(6,4)").alias("weight"),
        )

    def claims(self, *keys: str) -> DataFrame:
        """Further columns of the rows that they come from can be kept."""
        rows = self.run_lines().where("l_suppkey % 11 <> 7")
        kind = F.when(F.col("l_suppkey") % 5 == 0, "none").when(F.col("l_suppkey") % 5 == 1, "adjacent").otherwise("direct")
        n = (F.col("l_partkey") % 4).cast("int")
        spans = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(F.lit("s"), k))).otherwise(F.array().cast("array<string>"))
        severity = F.when(F.col("l_discount") >= 0.09, "high").when(F.col("l_discount") >= 0.07, "suspicious").otherwise("info")
        return rows.select(
            "run_id", F.col("ordinal").alias("pos"), "requirement_id", (kind != "none").alias("met"), kind.alias("match_type"), spans.alias("evidence_spans"),
            F.lit(None).cast("decimal(6,4)").alias("corroboration"), F.when(severity == "high", dec("0")).when(severity == "suspicious", dec("0.5")).otherwise(dec("1")).alias("integrity_factor"),
            severity.alias("severity"), ((F.col("l_partkey") % 101) / 100).alias("confidence"), F.lit("r").alias("rationale"),
            F.when((kind == "adjacent") & (F.col("l_partkey") % 7 != 0), F.lit("related")).alias("adjacency_note"), *keys,
        )

    def raw_claims(self) -> DataFrame:
        """Claims that cite spans of a document by id; some ids do not exist."""
        n = self.read("documents").count()
        owner = self.read("orders").select(F.col("o_orderkey"), (F.col("o_custkey") % n).alias("doc_id"))
        cites = F.transform(
            F.sequence(F.lit(0), (F.col("l_suppkey") % 3).cast("int")),
            lambda k: F.concat_ws("-", "doc_id", F.when(k == 0, F.col("l_partkey") % 12).when(k == 1, F.col("l_suppkey") % 40).otherwise(F.col("l_partkey") % 5)),
        )
        return self.claims("l_partkey", "l_suppkey", "l_orderkey").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "run_id", "doc_id", "pos", "requirement_id", "met", "match_type", cites.alias("evidence_spans"), "confidence", "rationale", "adjacency_note"
        )

    # -- job texts -------------------------------------------------------------------------------------------------------------------

    def job_texts(self) -> DataFrame:
        kind, text = F.col("doc_id") % 10, F.col("text")
        raw = (
            F.when(kind == 1, F.replace(text, F.lit("\n"), F.lit("\r\n")))
            .when(kind == 2, F.concat(text, F.lit("\n\n\n\nEnd.")))
            .when(kind == 3, F.concat(text, F.lit("\nWe are an equal opportunity employer.")))
            .when(kind == 4, F.concat(F.lit("a\u200bb\u202ec "), text))
            .when(F.col("doc_id") % 100 == 5, F.lit(" \n "))
            .otherwise(text)
        )
        created = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 60)
        return self.read("documents").select((F.col("doc_id") % 50).alias("user_id"), F.col("doc_id").alias("job_id"), created.alias("created_at"), raw.alias("raw_text"))

    def extracted(self) -> DataFrame:
        rows = self.read("documents").where("n_chars >= 60").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
        start, size = F.col("i") * 5, F.char_length("text")
        end = F.when(F.col("i") % 9 == 8, size + 5).otherwise(start + 20)
        quote = F.when(F.col("i") % 4 == 3, F.lit("somewhere else")).otherwise(F.substring("text", start + 1, F.lit(20)))
        return rows.select(
            F.col("doc_id").alias("job_id"), F.col("i").alias("pos"), F.concat(F.lit(" need "), F.col("i"), F.lit(" ")).alias("text"),
            F.when(F.col("i") % 2 == 0, " Hard_Skill ").otherwise("soft_skill").alias("kind"), F.when(F.col("i") % 3 == 0, "PREFERRED").otherwise("required").alias("necessity"),
            (F.col("i") - 2).cast("int").alias("criticality"), start.alias("evidence_start"), end.alias("evidence_end"), quote.alias("evidence_quote"),
        )

    # -- telemetry -------------------------------------------------------------------------------------------------------------------

    def match_runs(self) -> DataFrame:
        o = self.read("orders")
        return o.select(
            F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 200).alias("resume_id"), (F.col("o_orderkey") % 500).alias("job_id"),
            (F.col("o_orderkey") % 2).alias("prompt_version_id"), F.lit("v1").alias("scoring_version"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("processing").alias("state"), F.col("o_orderdate").alias("created_at"),
        )

    def call_facts(self) -> DataFrame:
        rows = self.run_lines()
        when = self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        k = F.col("l_suppkey") % 3
        return rows.join(when, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("requirement_id").alias("call_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("l_partkey") % 4 == 0, "extraction").otherwise("matching").alias("purpose"), "run_id",
            F.when(k == 0, "primary").when(k == 1, "fallback").otherwise("unknown").alias("model"),
            (F.col("l_quantity") * 100).cast("long").alias("input_tokens"), (F.col("l_partkey") % 900).alias("output_tokens"), (F.col("l_partkey") % 70 * 10).alias("cache_read_tokens"),
            (F.col("l_suppkey") % 50).alias("cache_write_tokens"), (F.col("l_partkey") % 3000 + 20).alias("latency_ms"),
            F.when(F.col("l_partkey") % 17 == 0, "refused").when(F.col("l_partkey") % 13 == 0, "error").otherwise("ok").alias("outcome"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("attempt"),
            F.col("o_orderdate").alias("created_at"),
        )

    def state_events(self, events: DataFrame | None = None) -> DataFrame:
        """From the events table, or from a stream of its rows."""
        state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type").isin("view", "click"), "processing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
        e = (self.read("events") if events is None else events).select(F.col("user_id").alias("run_id"), "event_id", "ts", state.alias("state"), "value")
        delta = F.when((F.col("state") == "completed") & (F.col("event_id") % 2 == 0), F.col("value"))
        return e.select("run_id", "event_id", "ts", "state", delta.alias("impact_delta"), F.when(F.col("event_id") % 3 == 0, "model_error").alias("failure_code"))

    def vocabulary(self) -> DataFrame:
        from ..operators.skills import CORPUS_TERMS, vocabulary

        return vocabulary(self.spark, CORPUS_TERMS)
