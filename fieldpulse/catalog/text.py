"""Text jobs over ``documents``, ``conversations`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.catalog import bindings as b
from fieldpulse.catalog.registry import query, quoted as _quote
from fieldpulse.functions.text import is_failure_report, strip_boilerplate
from fieldpulse.operators.merge import classification_counts, classify_missing, fill_stripped
from fieldpulse.plans.embedding import embed, embed_in_slices, embedding_report, pending_texts
from fieldpulse.plans.novelty import parse_verdict, verdict_precision
from fieldpulse.plans.profile import rule_shares, value_shares
from fieldpulse.runtime import scratch_path, spread

# Sentences and words that recur in the test corpus, besides the standard rules.
CORPUS_RULES = (
    r"^eriner thanea\.$",
    r"^the and attion to thanedble the, anea\.$",
    r"^and therhean is the is esndha reedes ha\.$",
    r"\ball rights reserved\b",
)
MARKERS = (r"\bmit license\b", r"\ball rights reserved\b")
PROFILE = {
    "license": r"\blicense\b",
    "rights": r"\ball rights reserved\b",
    "address": r"[a-z0-9._]+@[a-z0-9.]+",
}

_WS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _rule(patterns) -> str:
    return _quote("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_WS}+|{_WS}+$', '', 'g')"


def _strip_sql(source: str, key: str, rules) -> str:
    return f"""
with split as (
  select {key}, text,
         list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)),
                        lambda s: {_trim('s')}) as sentences
  from {source}),
kept as (
  select {key}, text,
         {_trim(f"regexp_replace(array_to_string(list_filter(sentences, lambda s: length(s) > 0 and not regexp_matches(s, {_rule(rules)})), ' '), '{_WS}+', ' ', 'g')")} as k
  from split)
select {key}, case when length(text) > 0 then case when length(k) < 40 then {_trim('text')} else k end else '' end as text,
       coalesce(length(text) > 0 and length(k) < 40, false) as fell_back
from kept"""


_RULES = settings.BOILERPLATE + CORPUS_RULES


@query("strip_boilerplate", _strip_sql("documents", "doc_id", _RULES))
def strip_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(b.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", strip_boilerplate(F.col("text"), _RULES).alias("s")).select(
        "doc_id", "s.text", "s.fell_back"
    )


@query(
    "fill_stripped",
    f"""with s as ({_strip_sql("documents", "doc_id", _RULES)})
select doc_id, case when l.doc_id is null then s.text else 'stored' end as summary_stripped
from s left join labels l using (doc_id)""",
)
def fill_stripped_column(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents have their stripped text already."""
    stored = b.table(spark, sf, "labels").select("doc_id", F.lit("stored").alias("summary_stripped"))
    docs = spread(b.table(spark, sf, "documents").select("doc_id", F.col("text").alias("summary")), "doc_id")
    rows = fill_stripped(docs.join(stored, "doc_id", "left"), patterns=_RULES)
    return rows.select("doc_id", "summary_stripped")


@query("strip_conversations", _strip_sql("conversations", "conv_id, turn", _RULES))
def strip_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(b.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return rows.select(
        "conv_id", "turn", strip_boilerplate(F.col("text"), _RULES).alias("s")
    ).select("conv_id", "turn", "s.text", "s.fell_back")


_FAILURE = f"coalesce(length(text) > 0 and not regexp_matches(text, {_rule(MARKERS)}), false)"


@query("failure_report", f"select doc_id, {_FAILURE} as is_failure_report from documents")
def failure_report(spark: SparkSession, sf: str) -> DataFrame:
    return spread(b.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        "doc_id", is_failure_report(F.col("text"), MARKERS).alias("is_failure_report")
    )


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents are classified already; the others wait."""
    flags = b.table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("is_failure_report"))
    docs = b.table(spark, sf, "documents").select("doc_id", F.col("text").alias("summary"))
    return docs.join(flags, "doc_id", "left")


@query(
    "classify_missing",
    f"""select doc_id, case when l.doc_id is null then {_FAILURE} else quality = 1 end as is_failure_report
from documents d left join labels l using (doc_id)""",
)
def classify(spark: SparkSession, sf: str) -> DataFrame:
    return classify_missing(_flagged(spark, sf), markers=MARKERS).select("doc_id", "is_failure_report")


@query(
    "classification_counts",
    f"""select count(*) as classified, count(*) filter (where f) as failure_report,
       count(*) filter (where not f) as non_failure_report
from (select {_FAILURE} as f from documents anti join labels using (doc_id))""",
)
def classified(spark: SparkSession, sf: str) -> DataFrame:
    return classification_counts(_flagged(spark, sf), markers=MARKERS)


@query(
    "rule_profile",
    """select rule, count(*) filter (where hit) as n, round(count(*) filter (where hit) / count(*), 6) as share from (
"""
    + " union all ".join(
        f"select '{name}' as rule, regexp_matches(text, {_quote('(?i)' + rx)}) as hit from documents"
        for name, rx in PROFILE.items()
    )
    + ") group by 1",
)
def rule_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(b.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rule_shares(docs, F.col("text"), PROFILE).select(
        "rule", "n", F.round("share", 6).alias("share")
    )


@query(
    "source_profile",
    """select source, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share
from documents group by 1""",
)
def source_profile(spark: SparkSession, sf: str) -> DataFrame:
    return value_shares(b.table(spark, sf, "documents"), F.col("source"), "source").select(
        "source", "n", F.round("share", 6).alias("share")
    )


@query(
    "component_profile",
    f"""with {b.SQL_COMPONENTS}
select component, count(*) as n, round(count(*) / (select count(*) from comp), 6) as share
from (select unnest(components) as component from comp) group by 1""",
)
def component_profile(spark: SparkSession, sf: str) -> DataFrame:
    return value_shares(b.order_components(spark, sf), F.col("components"), "component").select(
        "component", "n", F.round("share", 6).alias("share")
    )


_LETTERS = "aeiourstln"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """Deterministic stand-in for an embedding endpoint: letter counts of the whole text."""
    return [[float(t.lower().count(c)) for c in _LETTERS] for t in texts]


@query(
    "embed_missing",
    "select doc_id, "
    + ", ".join(
        f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::double as {c}_count" for c in _LETTERS
    )
    + " from documents anti join labels using (doc_id) where text is not null",
)
def embed_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents stand for those that already have a vector."""
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    stored = b.table(spark, sf, "labels").select("doc_id", F.array(F.lit(0.0)).alias("embedding"))
    todo = pending_texts(docs, stored, ["doc_id"], F.col("text"), "embedding")
    rows = embed(todo, ["doc_id"], letter_counts, spark.sparkContext.defaultParallelism)
    return rows.select(
        "doc_id", *[F.col("vector")[n].cast("double").alias(f"{c}_count") for n, c in enumerate(_LETTERS)]
    )


@query(
    "embedding_report",
    """select count(*) as to_embed, count(*) as embedded,
       count(*) + (select count(*) from labels) as written, 10::bigint as dim
from documents anti join labels using (doc_id)""",
)
def embedded_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A run in slices beside the vectors that labelled documents have already."""
    docs = b.table(spark, sf, "documents")
    zeros = F.array(*[F.lit(0.0).cast("float")] * 10).alias("vector")
    stored = b.table(spark, sf, "labels").select("doc_id", zeros)
    todo = pending_texts(docs, stored, ["doc_id"], F.col("text"), "vector")
    path = scratch_path(spark, "vectors")
    embed_in_slices(todo, ["doc_id"], letter_counts, path, spark.sparkContext.defaultParallelism, slices=2)
    report = embedding_report(todo, stored.unionByName(spark.read.parquet(path)), ["doc_id"])
    return report.select([F.col(c).cast("bigint").alias(c) for c in report.columns])


@query(
    "verdict_precision",
    """select case when quality = 1 then 'known' else 'novel' end as verdict, count(*) as reviewed,
       count(*) filter (where toxic = 0) as confirmed, round(avg((toxic = 0)::int), 6) as precision
from labels group by 1""",
)
def precision(spark: SparkSession, sf: str) -> DataFrame:
    """Quality as the verdict, the absence of toxicity as the reviewer's confirmation."""
    review = b.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "known").otherwise("novel").alias("verdict"),
        (F.col("toxic") == 0).alias("confirmed"),
    )
    return verdict_precision(review).withColumn("precision", F.round("precision", 6))


@query(
    "embed_recalls",
    f"""with {b.SQL_RECALLS}
select campaign_number, make, model, model_year::bigint as model_year,
       (length(lower(t)) - length(replace(lower(t), 'a', '')))::double as a_count
from (select *, trim(concat_ws(' ', summary, consequence)) as t from recalls)""",
)
def embed_recalls(spark: SparkSession, sf: str) -> DataFrame:
    from fieldpulse.operators.merge import RECALL_KEY
    from fieldpulse.plans.embedding import recall_text

    keys = list(RECALL_KEY)
    rows = b.recalls(spark, sf)
    none_yet = rows.select(*keys, F.lit(None).cast("array<float>").alias("embedding"))
    todo = pending_texts(rows, none_yet, keys, recall_text(), "embedding")
    return embed(todo, keys, letter_counts, spark.sparkContext.defaultParallelism).select(
        "campaign_number", "make", "model", F.col("model_year").cast("bigint").alias("model_year"),
        F.col("vector")[0].cast("double").alias("a_count"),
    )


@query(
    "embed_long_texts",
    "select p_partkey, " + ", ".join(
        f"(length(t) - length(replace(t, '{c}', '')))::double as {c}_count" for c in _LETTERS
    ) + """
from (select p_partkey, lower(trim(concat_ws(' ', text, p_name))) as t from part join documents on doc_id = p_partkey)""",
)
def embed_long_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Notices whose text is a whole document: every letter of it reaches the embedder."""
    from fieldpulse.plans.embedding import recall_text

    rows = b.table(spark, sf, "part").join(b.table(spark, sf, "documents"), F.col("doc_id") == F.col("p_partkey")).select(
        "p_partkey", F.col("text").alias("summary"), F.col("p_name").alias("consequence")
    )
    none_yet = rows.select("p_partkey", F.lit(None).cast("array<float>").alias("embedding"))
    todo = pending_texts(rows, none_yet, ["p_partkey"], recall_text(), "embedding")
    vectors = embed(todo, ["p_partkey"], letter_counts, spark.sparkContext.defaultParallelism)
    return vectors.select(
        "p_partkey", *[F.col("vector")[n].cast("double").alias(f"{c}_count") for n, c in enumerate(_LETTERS)]
    )


@query(
    "verdict_parse",
    """select doc_id,
       case when quality = 1 and toxic = 0 then 'known' when quality = 0 and toxic = 0 then 'novel' end as verdict,
       case when quality = 1 and toxic = 0 then source end as recall,
       case when toxic = 0 then lang end as reason,
       case when toxic = 0 then null when quality = 1 then 'unknown verdict' else 'no JSON in response' end as error
from labels join documents using (doc_id)""",
)
def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Prose around one JSON object per labelled document, parsed back."""
    rows = b.table(spark, sf, "labels").join(
        b.table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id"
    )
    verdict = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "known")
        .when(F.col("toxic") == 0, "novel")
        .otherwise("maybe")
    )
    doc = F.to_json(
        F.struct(verdict.alias("verdict"), F.col("source").alias("recall"), F.col("lang").alias("reason"))
    )
    response = F.when(
        (F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("I cannot tell.")
    ).otherwise(F.concat(F.lit("Let me think. "), doc, F.lit(" That is {all}.")))
    return rows.select("doc_id", parse_verdict(response).alias("p")).select("doc_id", "p.*")
