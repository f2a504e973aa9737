"""Queries of this subpackage's operators, on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.llm.encode import count_tokens, encode_texts
from railweave.llm.mixing import mix
from railweave.llm.names import match_names
from railweave.llm.percentiles import day_digests, digest_percentiles, percentiles
from railweave.llm.spans import repeated_spans, shared_share, sharing_pairs
from railweave.tables import table

GROUPS = ("edge_id", "period")
PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _named(spark: SparkSession, d: str) -> DataFrame:
    return match_names(table(spark, d, "study_area_boundary"), "area_no", "area_name", table(spark, d, "boundaries"), province_codes="prov_codes", area_code="area_code")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("area_no", F.col("code").alias("natcode"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no municipality of the list, and why."""
    return _named(spark, d).where(F.col("code") == "").select("area_no", "step", "score")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the travel time per edge and period."""
    found = percentiles(table(spark, d, "schedule"), GROUPS, "travel_time_seconds", PERCENTS)
    return found.select(*GROUPS, "percent", F.col("value").alias("travel_time_seconds"), F.col("n").cast("long").alias("n"))


def p5_daily(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable digests of each service date."""
    return day_digests(table(spark, d, "schedule"), "service_date", GROUPS, "travel_time_seconds")


def p5_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles read from the digests of all service dates together, with their bounds."""
    return digest_percentiles(p5_daily(spark, d), GROUPS, PERCENTS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The number of tokens of each document."""
    return count_tokens(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "n_tokens")


def p9_draws(spark: SparkSession, d: str) -> DataFrame:
    """Which speeches to draw, and how often."""
    return mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of tokens that the draws reach."""
    return mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sharing_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each speech stands elsewhere too."""
    return shared_share(table(spark, d, "documents"), "doc_id", "text")


def p10_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The stretches to remove so that each shared span stays where it comes first."""
    return repeated_spans(table(spark, d, "documents"), "doc_id", "text")


#: Every window of 200 characters of every text, the records that hold it, and which of its places are shared.
_WINDOWS = """w as (select doc_id, text, unnest(range(1, length(text) - 198)) as k from documents where length(text) >= 200),
    h as (select doc_id, k - 1 as pos, md5(substr(text, k, 200)) as h from w),
    g as (select h, min(doc_id) as first from h group by 1 having count(distinct doc_id) > 1),
    held as (select doc_id, pos, bool_or(first < doc_id) as later from h join g using (h) group by 1, 2)"""


def _stretches(name: str, where: str) -> str:
    return f"""{name}_s as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as b from held where {where}),
        {name} as (select doc_id, sum(least(coalesce(pos - b, 200), 200)) as c, count(*) filter (where b is null or pos - b > 200) as s from {name}_s group by 1)"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_unmatched, p5_percentiles, p5_daily, p5_combined, p8_ids, p8_sizes, p9_draws, p9_shares, p10_found, p10_shares, p10_repeats)}


#: The bucket of a number in a digest: exponent and 13 bits of fraction; negative numbers mirror positive ones.
_MAGNITUDE = "case when abs(v) = 0 then 0 else (floor(log2(abs(v))) + 1023) * 8192 + floor((abs(v) / pow(2, floor(log2(abs(v)))) - 1) * 8192) end"
_BUCKETS = f"""b as (select service_date, edge_id, period, (case when v < 0 then -1 - ({_MAGNITUDE}) else {_MAGNITUDE} end)::bigint as bucket
                     from (select service_date, edge_id, period, travel_time_seconds as v from schedule where travel_time_seconds is not null and not isnan(travel_time_seconds)))"""


def _edge_of(m: str, part: str) -> str:
    """A place in the bucket of magnitude ``m``: ``part`` of its width, in SQL."""
    return f"(case when {m} < 8192 then 0 else pow(2, floor({m} / 8192) - 1023) * (1 + ({m} % 8192 + {part}) / 8192) end)"


def _combined_sql() -> str:
    last = "(1 - pow(2::double, -39))"
    m = "(-1 - bucket)"
    return f"""
        with {_BUCKETS}, r as (select edge_id, period, bucket, row_number() over (partition by edge_id, period order by bucket) as rn, count(*) over (partition by edge_id, period) as n from b),
             p as (select unnest([{", ".join(f"{p}::double" for p in PERCENTS)}]) as percent),
             f as (select edge_id, period, percent, bucket, n from r, p where rn = greatest(ceil(round(percent * n, 9)), 1))
        select edge_id, period, percent, n::bigint as n,
               case when bucket = 0 then 0.0::double when bucket < 0 then -{_edge_of(m, last)} else {_edge_of("bucket", "0")} end as low,
               case when bucket = 0 then pow(2::double, -1036) when bucket < 0 then -{_edge_of(m, "(0.5 - pow(2::double, -39))")} else {_edge_of("bucket", "0.5")} end as value,
               case when bucket = 0 then (pow(2::double, 39) - 1) * pow(2::double, -1074) when bucket < 0 then -{_edge_of(m, "0")} else {_edge_of("bucket", last)} end as high
        from f"""


def oracle_sql() -> dict[str, str]:
    percents = ", ".join(f"{p}::double" for p in PERCENTS)
    return {
        "p5_percentiles": f"""
            with v as (select edge_id, period, travel_time_seconds,
                              row_number() over (partition by edge_id, period order by travel_time_seconds) as rn,
                              count(*) over (partition by edge_id, period) as n
                       from schedule where travel_time_seconds is not null and not isnan(travel_time_seconds)),
                 p as (select unnest([{percents}]) as percent)
            select edge_id, period, percent, travel_time_seconds, n::bigint as n
            from v, p where rn = greatest(ceil(round(percent * n, 9)), 1)""",
        "p10_found": f"with {_WINDOWS} select distinct a.doc_id as doc_a, b.doc_id as doc_b from h a join h b on a.h = b.h and a.doc_id < b.doc_id",
        "p10_shares": f"""with {_WINDOWS}, {_stretches("a", "true")}, {_stretches("r", "later")}
            select doc_id, coalesce(length(text), 0)::bigint as n_chars, coalesce(a.c, 0)::bigint as shared_chars, coalesce(a.s, 0)::bigint as n_spans, coalesce(r.c, 0)::bigint as repeated_chars
            from documents left join a using (doc_id) left join r using (doc_id)""",
        "p10_repeats": f"""with {_WINDOWS}, l as (select doc_id, pos, coalesce(pos - lag(pos) over (partition by doc_id order by pos) > 200, true) as n from held where later),
            i as (select doc_id, pos, sum(n::int) over (partition by doc_id order by pos) as i from l)
            select doc_id, min(pos)::bigint as start, (max(pos) + 200)::bigint as "end" from i group by doc_id, i""",
        "p5_daily": f"with {_BUCKETS} select service_date, edge_id, period, bucket, count(*)::bigint as n from b group by all",
        "p5_combined": _combined_sql(),
    }
