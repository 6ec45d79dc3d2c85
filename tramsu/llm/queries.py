"""Queries of the subpackage over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramsu.llm import answers, contamination, leaks, pieces, quality, questions, sampling, splitting, tokenize, variants
from tramsu.session import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.pairs(variants.entities(read(spark, d, "entities"), read(spark, d, "nicknames")))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return variants.entities(read(spark, d, "entities"), read(spark, d, "nicknames"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = sampling.sample(read(spark, d, "exam_dashboard"), read(spark, d, "exam_blueprint"))
    return report.where("unmet").select("blueprint_id", "bloom")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(read(spark, d, "exam_dashboard"), read(spark, d, "exam_blueprint"))[0]


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(read(spark, d, "exam_dashboard"), read(spark, d, "exam_blueprint"))[1].select(
        "blueprint_id", "bloom", "available", "needed"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    first = leaks.overlaps(read(spark, d, "corpus"), "context_id", "context", "passage").withColumn("record_kind", F.lit("corpus"))
    second = leaks.overlaps(read(spark, d, "qa_pairs"), "qa_id", "question", "question").withColumn("record_kind", F.lit("qa_pairs"))
    both = first.unionByName(second)
    return both.select("record_kind", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    corpus, qa = read(spark, d, "corpus"), read(spark, d, "qa_pairs")
    first = leaks.report(leaks.overlaps(corpus, "context_id", "context", "passage"), corpus, "context_id")
    second = leaks.report(leaks.overlaps(qa, "qa_id", "question", "question"), qa, "qa_id")
    return first.withColumn("record_kind", F.lit("corpus")).unionByName(second.withColumn("record_kind", F.lit("qa_pairs")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, plan = pieces.split_texts(read(spark, d, "corpus"), "context_id", "context")
    return plan.where("piece_no = 2").select(F.regexp_replace("id", r"#\d+$", "").alias("context_id")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_texts(read(spark, d, "corpus"), "context_id", "context")[0].withColumnRenamed("id", "context_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(read(spark, d, "exam_dashboard"), read(spark, d, "documents").select("text", "lang"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.keep_together(read(spark, d, "corpus"), read(spark, d, "qa_pairs"))[1].select("context_id")


def p6_plan(spark: SparkSession, d: str) -> DataFrame:
    return splitting.keep_together(read(spark, d, "corpus"), read(spark, d, "qa_pairs"))[0]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = questions.groups(read(spark, d, "exam_dashboard"))
    return questions.pairs(members).select(F.col("a").alias("item_id_a"), F.col("b").alias("item_id_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return questions.groups(read(spark, d, "exam_dashboard"))[0].withColumnRenamed("key", "item_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(read(spark, d, "documents"))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and the text that its ids decode to."""
    return tokenize.decode(tokenize.encode(read(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(read(spark, d, "documents"), read(spark, d, "exam_items")).select("doc_id", "id")


def p9_places(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(read(spark, d, "documents"), read(spark, d, "exam_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(read(spark, d, "documents")).where("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.kinds(read(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_LEVEL = "regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]', '', 'g')"
_TITLE = r"lower(trim(regexp_replace(nfc_normalize({0}), '[\s\x{{a0}}\x{{200b}}\x{{feff}}]+', ' ', 'g')))"
_REPORT = f"""
with w as (
  select distinct blueprint_id, bloom, {_LEVEL.format('bloom')} as level, {_TITLE.format('title')} as t,
    ceil(greatest(cast(sample_size as decimal(18,0)) * cast(target_share as decimal(12,9)), min_items)) as needed
  from exam_blueprint),
i as (
  select distinct item_id, {_LEVEL.format('bloom')} as level, {_TITLE.format('title')} as t
  from exam_dashboard where not isnan(verifier_score) and verifier_score between 0 and 1)
select blueprint_id, bloom, count(distinct item_id) as available, cast(any_value(needed) as bigint) as needed
from w left join i on w.level = i.level and (w.t is null or w.t = i.t) group by all
"""
_SPLIT = """case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('dev', 'val', 'validation')
  then 'dev' else nullif(lower(trim(split)), '') end"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_report": _REPORT,
        "p2_found": f"select blueprint_id, bloom from ({_REPORT}) where available < needed",
        "p4_found": "select distinct context_id from corpus where length(context) > 1500",
        "p8_round_trip": "select distinct doc_id, coalesce(text, '') as text from documents",
        "p6_found": f"""
with recursive r as (
  select distinct {_TITLE.format('title')} as t, context_id as c, {_SPLIT} as s from corpus
  union select distinct {_TITLE.format('title')}, context_id, {_SPLIT} from qa_pairs),
link as (select distinct a.t as x, b.t as y from r a join r b using (c)),
reach as (select t as x, t as y from (select distinct t from r) union select reach.x, link.y from reach join link on reach.y = link.x),
grp as (select x as t, min(y) as g from reach group by x),
many as (select g from r join grp using (t) where s is not null group by g having count(distinct s) > 1)
select distinct context_id from corpus join grp on {_TITLE.format('title')} = grp.t where g in (select g from many)""",
    }
