"""Queries p5, p6 and p8 to p10, and the same in SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import languages, leakage, mixing, quantiles, survivors
from strandline.session import checkpointed, table

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


# p5 ---------------------------------------------------------------------------------------


def _survivors(spark: SparkSession, sf: str, *, dependent: bool) -> tuple[DataFrame, DataFrame, list[survivors.Bundle]]:
    """The chosen records, all records, and the bundles. A read passed quality control or did not: ``dependent`` bundles all carry that bit and agree on it."""
    reads = table(spark, sf, "alignments").where(F.col("flags").bitwiseAND(0x900) == 0)
    keys = [F.regexp_replace("read_name", r"/[12]\z", ""), F.col("flags").bitwiseAND(0xC0)]
    failed = F.col("flags").bitwiseAND(0x200)
    passed = F.when(failed == 0, 1).otherwise(0)
    status = failed if dependent else None
    scored = ~F.col("quality_scores").isin("", "*") & (F.length("quality_scores") == F.length("seq"))
    bundles = [
        survivors.Bundle("alignment_start", ["reference_sequence_id", "alignment_start", "cigar"], F.col("alignment_start") > 0, [passed], status),
        survivors.Bundle("mate_alignment_start", ["mate_reference_sequence_id", "mate_alignment_start"], F.col("mate_alignment_start") > 0, [passed], status),
        survivors.Bundle("quality_scores", ["seq", "quality_scores"], scored, [passed, survivors.score_sum(F.col("quality_scores"))], status),
    ]
    return survivors.survivors(reads, keys, bundles, record_id="record_id", recency="loaded_at"), reads, bundles


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every field from the best record that has it, whatever the others' records: no dependency, and so no search."""
    return survivors.suppliers(_survivors(spark, sf, dependent=False)[0], ["alignment_start", "mate_alignment_start", "quality_scores"])


def p5_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Whole surviving records, whose bundles all passed quality control or all failed it."""
    chosen, reads, bundles = _survivors(spark, sf, dependent=True)
    return survivors.with_fields(chosen, reads, bundles, record_id="record_id")


def p5_branched(spark: SparkSession, sf: str) -> DataFrame:
    """Groups by whether the search went beyond the root, and what the dependency cost: bundles left empty."""
    chosen = _survivors(spark, sf, dependent=True)[0]
    empty = sum((F.col(n).isNull().cast("int") for n in ("alignment_start", "mate_alignment_start", "quality_scores")), F.lit(0))
    return chosen.groupBy("branched").agg(F.count(F.lit(1)).alias("groups"), F.sum(empty).alias("empty_bundles"))


# p6 ---------------------------------------------------------------------------------------


def _measures(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "alignments")
    mapq = F.when(F.col("mapping_quality") != 255, F.col("mapping_quality")).cast("int")
    size = F.when(F.col("template_length") != 0, F.col("template_length"))
    both = F.array(F.struct(F.lit("mapping_quality").alias("field"), mapq.alias("value")), F.struct(F.lit("template_length").alias("field"), size.alias("value")))
    return a.select("read_group_id", F.date_format("loaded_at", "yyyy-MM").alias("month"), F.inline(both))


def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    group = ["read_group_id", "field"]
    merged = quantiles.merge(quantiles.sketch(_measures(spark, sf), group, "value"), group)
    return quantiles.percentiles(merged, group, PERCENTILES).drop("low", "high")


def p6_months_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same from sketches of single months, added up."""
    monthly = quantiles.sketch(_measures(spark, sf), ["month", "read_group_id", "field"], "value")
    group = ["read_group_id", "field"]
    merged = quantiles.merge(quantiles.merge(monthly, ["month", *group]), group)
    return quantiles.percentiles(merged, group, PERCENTILES).drop("low", "high")


def p6_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Every percentile against the rows themselves: whether no more than ``rank_error`` of them lie between its code and its rank."""
    group = ["read_group_id", "field"]
    rows = _measures(spark, sf).where(F.col("value").isNotNull()).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("c"))
    merged = quantiles.merge(quantiles.sketch(_measures(spark, sf), group, "value"), group)
    found = quantiles.percentiles(merged, group, PERCENTILES)
    marks = found.groupBy(*group).agg(F.collect_list(F.struct("n", "rank_error", "probability", "low", "high")).alias("marks")).withColumnsRenamed({"read_group_id": "g", "field": "f"})
    counted = rows.join(marks, F.col("read_group_id").eqNullSafe(F.col("g")) & (F.col("field") == F.col("f"))).select(*group, "value", "c", F.inline("marks"))
    ranks = counted.groupBy(*group, "probability", "n", "rank_error").agg(F.sum(F.when(F.col("value") < F.col("low"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("high"), F.col("c")).otherwise(0)).alias("upto"), F.sum("c").alias("rows"))
    rank, slack = F.greatest(F.ceil(F.col("probability") * F.col("n")), F.lit(1)), F.col("rank_error") * F.col("n") + 1e-6
    within = (F.col("n") == F.col("rows")) & (rank > F.col("below") - slack) & (rank <= F.col("upto") + slack)
    return ranks.select(*group, "probability", F.col("n"), within.alias("within_bound"))


# p8 ---------------------------------------------------------------------------------------


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


# p9 ---------------------------------------------------------------------------------------


#: The vocabulary that sizes are counted with; ``strandline.vocabulary`` in the session names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = spark.conf.get("strandline.vocabulary", VOCABULARY)
    return checkpointed(mixing.token_counts(table(spark, sf, "documents"), "doc_id", "text", mixing.source_name(F.col("source")), vocabulary=vocabulary))


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mix_targets").withColumn("source", mixing.source_name(F.col("source")))


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    """All tokens of the sources as total, weights from the exponent bisected until the caps hold."""
    return mixing.mix(_counts(spark, sf), _targets(spark, sf))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares ``p9_selection`` reaches."""
    return mixing.mix(_counts(spark, sf), _targets(spark, sf))[1]


def p9_selection_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Every source with text at its target share; the total shrinks to what the scarcest one allows."""
    return mixing.mix(_counts(spark, sf), _targets(spark, sf), policy="exact")[0]


def p9_shares_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The shares ``p9_selection_exact`` reaches."""
    return mixing.mix(_counts(spark, sf), _targets(spark, sf), policy="exact")[1]


def p9_shares_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Token shares exponentiated from equal ones, until their entropy is that of the target shares and the caps hold."""
    return mixing.mix(_counts(spark, sf), _targets(spark, sf), base="equal", entropy_of_targets=True)[1]


def p9_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Per target: its documents with text, whether no document is used too often, and whether the budget is met to within a document."""
    counts = _counts(spark, sf)
    chosen, report = mixing.mix(counts, _targets(spark, sf))
    sizes = counts.where(F.col("n_tokens") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("n_tokens").alias("longest"))
    used = chosen.groupBy("source").agg(F.max("copies").alias("most"))
    joined = report.join(sizes, "source", "left").join(used, "source", "left").withColumn("total", F.sum(F.when(F.col("weight") > 0, F.col("available_tokens"))).over(Window.partitionBy(F.lit(0))))
    budget = F.least(F.col("weight") * F.col("total"), F.col("available_tokens") * F.col("max_repeats"))
    return joined.select(
        "source",
        F.coalesce("documents", F.lit(0)).alias("documents"),
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("caps_hold"),
        (F.abs(F.col("selected_tokens") - budget) <= F.coalesce("longest", F.lit(0)) + 1).alias("budget_met"),
    )


# p10 --------------------------------------------------------------------------------------


def _passages(spark: SparkSession, sf: str, least_words: int = 1) -> DataFrame:
    docs = table(spark, sf, "documents")
    return languages.passage_languages(docs, languages.trained(docs), least_words=least_words)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.unlabelled_languages(_passages(spark, sf, languages.LEAST_WORDS))


def p10_passages(spark: SparkSession, sf: str) -> DataFrame:
    return _passages(spark, sf)


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one language inside the passages."""
    docs = table(spark, sf, "documents")
    return languages.passage_segments(docs, languages.trained(docs), least_words=1)


def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    return languages.document_languages(_passages(spark, sf))


QUERIES = {
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p5_branched": p5_branched,
    "p6_percentiles": p6_percentiles,
    "p6_months_joined": p6_months_joined,
    "p6_checked": p6_checked,
    "p8_found": p8_found,
    "p9_selection": p9_selection,
    "p9_selection_exact": p9_selection_exact,
    "p9_shares": p9_shares,
    "p9_shares_exact": p9_shares_exact,
    "p9_shares_entropy": p9_shares_entropy,
    "p9_checked": p9_checked,
    "p10_found": p10_found,
    "p10_passages": p10_passages,
    "p10_segments": p10_segments,
    "p10_documents": p10_documents,
}

_P5 = """
with r as (select *, regexp_replace(read_name, '/[12]$', '') as k0, flags & 192 as k1, case when flags & 512 = 0 then 0 else 1 end as failed
           from alignments where flags & 2304 = 0),
g as (select k0, k1, min(record_id) as group_id, count(*) as n from r where k0 is not null group by all having count(*) > 1),
m as (select r.*, g.group_id from r join g using (k0, k1)),
c as (select group_id, 'alignment_start' as field_name, record_id, failed, 0 as score, loaded_at from m where alignment_start > 0
      union all select group_id, 'mate_alignment_start', record_id, failed, 0, loaded_at from m where mate_alignment_start > 0
      union all select group_id, 'quality_scores', record_id, failed, list_sum([ascii(x) - 33 for x in string_split(quality_scores, '')]), loaded_at
                from m where quality_scores not in ('', '*') and length(quality_scores) = length(seq))
"""

#: The survivors whose bundles share the bit: of each status the best records, and the status with more trust.
_P5_AGREED = (
    _P5
    + """,
s as (select group_id, field_name, failed, record_id from c qualify row_number() over (partition by group_id, field_name, failed order by score desc, loaded_at desc, record_id) = 1),
w as (select group_id,
  max(case when field_name = 'alignment_start' and failed = 0 then record_id end) as a0, max(case when field_name = 'alignment_start' and failed = 1 then record_id end) as a1,
  max(case when field_name = 'mate_alignment_start' and failed = 0 then record_id end) as m0, max(case when field_name = 'mate_alignment_start' and failed = 1 then record_id end) as m1,
  max(case when field_name = 'quality_scores' and failed = 0 then record_id end) as q0, max(case when field_name = 'quality_scores' and failed = 1 then record_id end) as q1 from s group by 1),
v as (select g.group_id, g.members, w.* exclude (group_id), (a0 is not null)::int + (m0 is not null)::int + (q0 is not null)::int as pass,
  case when a1 is null then 0 when a0 is null then 1 else 0.5 end + case when m1 is null then 0 when m0 is null then 1 else 0.5 end + case when q1 is null then 0 when q0 is null then 1 else 0.5 end as fail,
  case when a0 is not null then 0 when a1 is not null then 1 when m0 is not null then 0 when m1 is not null then 1 when q0 is not null then 0 else 1 end as first_status,
  list_filter([case when a0 is not null then 0 when a1 is not null then 1 end, case when m0 is not null then 0 when m1 is not null then 1 end, case when q0 is not null then 0 when q1 is not null then 1 end], lambda x: x is not null) as tops
  from (select group_id, any_value(n) as members from g group by 1) g left join w using (group_id)),
d as (select *, coalesce(list_min(tops) <> list_max(tops), false) as branched, case when coalesce(fail, 0) > coalesce(pass, 0) then 1 when coalesce(pass, 0) > coalesce(fail, 0) then 0 else first_status end as status from v),
t as (select *, case when status = 0 then a0 else a1 end as a, case when status = 0 then m0 else m1 end as m, case when status = 0 then q0 else q1 end as q from d)
"""
)

ORACLES = {
    "p5_survivors": _P5_AGREED
    + """select t.group_id, t.members, x.reference_sequence_id, x.alignment_start, x.cigar, y.mate_reference_sequence_id, y.mate_alignment_start, z.seq, z.quality_scores
from t left join alignments x on x.record_id = t.a left join alignments y on y.record_id = t.m left join alignments z on z.record_id = t.q""",
    "p5_branched": _P5_AGREED + "select branched, count(*) as \"groups\", cast(sum((a is null)::int + (m is null)::int + (q is null)::int) as bigint) as empty_bundles from t group by 1",
    "p6_checked": """
with m as (select read_group_id, 'mapping_quality' as field, cast(mapping_quality as bigint) as v from alignments where mapping_quality <> 255
           union all select read_group_id, 'template_length', template_length from alignments where template_length <> 0)
select read_group_id, field, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::double as probability, n, true as within_bound from (select read_group_id, field, count(*) as n from m group by all)""",
    "p9_checked": """
with t as (select distinct translate(lower(trim(source)), '_ ', '--') as source from mix_targets where source is not null),
d as (select translate(lower(trim(source)), '_ ', '--') as source, count(*) as n from documents where source is not null and text <> '' group by 1)
select t.source, coalesce(d.n, 0) as documents, true as caps_hold, true as budget_met from t left join d using (source)""",
    "p5_found": _P5 + "select group_id, field_name, record_id from c qualify row_number() over (partition by group_id, field_name order by failed, score desc, loaded_at desc, record_id) = 1",
}
