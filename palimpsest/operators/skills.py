"""Skills of a vocabulary found in spans, with evidence and a confidence that follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .overlap import span_findings

#: Canonical terms and the forms they are written in.
TERMS: dict[str, tuple[str, ...]] = {
    "Python": ("python",),
    "FastAPI": ("fastapi", "fast api"),
    "Django": ("django",),
    "Flask": ("flask",),
    "JavaScript": ("javascript", "js"),
    "TypeScript": ("typescript",),
    "React": ("react", "react.js", "reactjs"),
    "Next.js": ("next.js", "nextjs"),
    "Node.js": ("node.js", "nodejs", "node"),
    "Java": ("java",),
    "Go": ("golang",),
    "Rust": ("rust",),
    "C++": ("c++",),
    "SQL": ("sql",),
    "PostgreSQL": ("postgresql", "postgres"),
    "MySQL": ("mysql",),
    "MongoDB": ("mongodb", "mongo"),
    "Redis": ("redis",),
    "Kafka": ("kafka", "apache kafka"),
    "Docker": ("docker",),
    "Kubernetes": ("kubernetes", "k8s"),
    "AWS": ("aws", "amazon web services"),
    "GCP": ("gcp", "google cloud"),
    "Azure": ("azure",),
    "Terraform": ("terraform",),
    "CI/CD": ("ci/cd", "cicd", "continuous integration"),
    "GraphQL": ("graphql",),
    "REST": ("rest", "restful"),
    "Microservices": ("microservices", "microservice"),
    "Machine Learning": ("machine learning", "ml"),
    "PyTorch": ("pytorch",),
    "TensorFlow": ("tensorflow",),
    "Pandas": ("pandas",),
    "Spark": ("spark", "apache spark"),
    "Airflow": ("airflow", "apache airflow"),
    "Git": ("git",),
    "Linux": ("linux",),
}
#: Terms that the generated corpus does hold.
CORPUS_TERMS = {"THE": ("the", "of the"), "AND": ("and",), "OF": ("of",), "WITH": ("with",), "THIS": ("this",)}
SOURCE = "dictionary_v1"


def vocabulary(spark: SparkSession, terms: dict[str, tuple[str, ...]] = TERMS) -> DataFrame:
    return spark.createDataFrame([(c, a) for c, aliases in terms.items() for a in aliases], "canonical string, alias string")


def match_terms(spans: DataFrame, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, span_id, page, seqno, canonical), one row for a span and term however often it occurs.

    A short list of terms is a row-wise test inside the scan: no join and no shuffle.
    """
    low = F.lower("text")
    hits = [F.when(reduce(Column.__or__, [tx.whole_term(low, a) for a in aliases]), F.lit(c)) for c, aliases in terms.items()]
    return spans.select("doc_id", "span_id", "page", "seqno", F.explode(F.filter(F.array(*hits), lambda c: c.isNotNull())).alias("canonical"))


#: At most so many words are hot: none has more rows than the others' even share.
SHARES = 1024


def _word_list(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"[{tx.WORD_CLASS}]+"), F.lit(0)))


def word_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(word, n) of the wanted words: in how many texts (column low) each stands.  Others have no row."""
    return texts.select(F.explode(_word_list(F.col("low"))).alias("word")).join(words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))


def keyed_by_rarest(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(canonical, alias, word): each alias at the rarest of its words; aliases of which no text has all words are left out."""
    own = terms.select("canonical", "alias", F.explode(_word_list(F.col("alias"))).alias("word")).join(counts, "word", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("b")
    return own.groupBy("canonical", "alias").agg(best).where("b.n > 0").select("canonical", "alias", "b.word")


#: So many aliases go to every task at most: with their words some 2 MB.
SMALL_VOCABULARY = 20_000


def match_vocabulary(spans: DataFrame, vocab: DataFrame, shares: int = SHARES, small: int = SMALL_VOCABULARY) -> DataFrame:
    """The same for a vocabulary table of any size.

    An alias waits at the rarest of its words, so "of the day" meets the spans with "day" only, and a span is compared with the few aliases
    that wait at its words; the whole alias is confirmed in the text.  Up to `small` aliases are broadcast, and spans stay where they are.
    Beyond that (word, span) pairs without texts are dealt out, and the texts meet only the aliases found for them.  A word with more rows
    than a `shares`th of all is dealt out over as many salts as shares it has: there are at most `shares` such words, which is what is
    broadcast, and few aliases wait at each.
    """
    low = F.lower("text")
    terms = vocab.select("canonical", F.lower("alias").alias("alias")).distinct()
    texts = spans.select("doc_id", "span_id", "page", "seqno", low.alias("low"))
    wanted = terms.select(F.explode(_word_list(F.col("alias"))).alias("word")).distinct()
    counts = word_counts(texts, wanted)
    keyed = keyed_by_rarest(terms, counts)
    found = F.expr(rf"rlike(low, concat('(?<![\\p{{L}}\\p{{N}}_])\\Q', alias, '\\E(?![\\p{{L}}\\p{{N}}_])'))")
    words = F.explode(_word_list(F.col("low"))).alias("word")
    own = ["doc_id", "span_id", "page", "seqno"]
    if terms.limit(small + 1).count() <= small:
        met = texts.select(*own, "low", words).join(F.broadcast(keyed), "word")  # at most `small` rows
        return met.where(found).select(*own, "canonical").distinct()
    used = counts.join(keyed.select("word").distinct(), "word", "left_semi")
    total = used.agg(F.ceil(F.sum("n") / shares).alias("share"))  # one row
    hot = used.crossJoin(F.broadcast(total)).where("n > share").select("word", F.ceil(F.col("n") / F.col("share")).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    rows = texts.select("doc_id", "span_id", words).join(F.broadcast(hot), "word", "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "span_id"), salts)).drop("salts")
    waiting = keyed.join(F.broadcast(hot), "word", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    met = rows.join(waiting, ["word", "salt"]).select("doc_id", "span_id", "canonical", "alias")
    asked = met.groupBy("doc_id", "span_id").agg(F.collect_set(F.struct("canonical", "alias")).alias("asked"))
    return texts.join(asked, ["doc_id", "span_id"]).select(*own, "low", F.inline("asked")).where(found).select(*own, "canonical").distinct()


def confidence(support: Column, flagged: Column) -> Column:
    base = F.least(0.6 + 0.1 * (support - 1), F.lit(0.9))
    clean = support - flagged
    return F.when(flagged == 0, F.bround(base, 3)).when(clean == 0, F.lit(0.15)).otherwise(F.bround(base * (clean / support), 3))


def match(spans: DataFrame, findings: DataFrame, terms: dict[str, tuple[str, ...]] | DataFrame = TERMS) -> tuple[DataFrame, DataFrame]:
    """Skills per document, and their evidence (a row for each skill and span)."""
    hits = match_terms(spans, terms) if isinstance(terms, dict) else match_vocabulary(spans, terms)
    flagged = span_findings(spans, findings, severities=["suspicious", "high"]).select("doc_id", "span_id").distinct().withColumn("is_flagged", F.lit(True))
    evidence = hits.join(flagged, ["doc_id", "span_id"], "left").withColumn("is_flagged", F.coalesce("is_flagged", F.lit(False)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "seqno", "span_id"))), lambda s: s["span_id"])
    skills = evidence.groupBy("doc_id", "canonical").agg(F.count("*").alias("support_count"), F.count_if("is_flagged").alias("flagged_support_count"), ordered.alias("span_ids"))
    skills = skills.withColumns({"confidence": confidence(F.col("support_count"), F.col("flagged_support_count")), "source": F.lit(SOURCE)})
    return skills, evidence


def skill_order(skills: DataFrame) -> DataFrame:
    return skills.orderBy("doc_id", F.desc("confidence"), "canonical")
