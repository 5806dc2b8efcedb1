"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Its documents are due target/size copies each: the whole
part is certain, and the rest is an inclusion probability p. The documents are ranked by their random
odds divided by their inclusion odds, (u/(1-u)) / (p/(1-p)), and the head of that ranking is taken
whose words come nearest to what the target still lacks.

The ranking is never sorted as a whole: ranks become 52-bit keys, one aggregation finds the 16-bit
bucket in which a source's words reach the target, a second one the key inside that bucket. u comes from a hash
of seed, id and text, so rows that share an id are ranked each by itself; equal rows are taken together. All
documents of a source have the same inclusion odds, as a target is given for each source. One row for each source
passes through windows of one task.

Rows: a null or blank text has size 0 and may be taken or not; null sources form a source of their
own, last in order; repeated rows are each counted; no rows give no rows; other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("bigint")


def _random(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in (0, 1): 13 hex digits of an md5."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(2.0**52)


def _rank_key(u: Column, p: Column) -> Column:
    """52-bit key that orders like the Pareto ranking variable r = (u/(1-u)) / (p/(1-p)): it holds r/(r+1)."""
    above, below = u * (F.lit(1.0) - p), (F.lit(1.0) - u) * p
    return F.floor(above / (above + below) * F.lit(2.0**52)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from source, source_size.

    Weights go by code-point order, null last. Where a target would pass its cap, the excess goes to the
    others by weight until none is above: that is one level λ with target = min(cap, λ·weight), found by
    going through the sources in the order of cap/weight.
    """
    return sizes.sparkSession.sql(f"""
        with w as (select source, source_size, {MOST} * source_size as cap, sum(source_size) over () * {SHARE}D as total,
                     element_at(array({", ".join(map(str, WEIGHTS))}), cast((row_number() over (order by source asc nulls last) - 1) % {len(WEIGHTS)} + 1 as int)) as weight
                   from {{sizes}}),
             c as (select *, row_number() over (order by cap / weight, source nulls last) as k from w),
             l as (select *, (total - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))
                       / sum(weight) over (order by k rows between current row and unbounded following) as level from c),
             m as (select *, min(case when level <= cap / weight then k end) over () as at from l)
        select source, source_size, cast(least(cast(cap as double), weight * max(case when k = at then level end) over ()) as double) as target from m""", sizes=sizes)


def plan_mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, source_size, target, whole, p, last_key: what `take` needs, a row for each source."""
    narrow = materialize(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _random(F.col(id_col), F.col(text_col), seed).alias("u")))
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(rate).cast("bigint")).withColumn("p", rate - F.floor(rate)).withColumn("lacks", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan)
    p, spark = F.col("p"), docs.sparkSession
    keyed = narrow.join(plan.where("p > 0").select(F.col("source").alias("s"), "p"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", _rank_key(F.col("u"), p).alias("key"))
    keyed = keyed.withColumn("bucket", F.shiftright("key", 36))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    crossing = materialize(spark.sql("""
        select b.source, bucket, before, lacks from
          (select source, bucket, words, sum(words) over (partition by source order by bucket) - words as before from {buckets}) b
        join {plan} p on b.source <=> p.source where before <= lacks and lacks < before + words""", buckets=buckets, plan=plan))
    inside = keyed.alias("k").join(crossing.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.bucket") == F.col("c.bucket")))
    inside = inside.groupBy(F.col("k.source").alias("source"), F.col("k.bucket").alias("bucket"), "before", "lacks", "key").agg(F.sum("size").alias("words"))
    last = spark.sql("""
        select source, case when abs(best.reached - lacks) < abs(before - lacks) then best.key else bucket * 68719476736 - 1 end as last_key from
          (select source, bucket, before, lacks, min_by(struct(key, reached), struct(abs(reached - lacks), key)) as best from
            (select *, before + sum(words) over (partition by source order by key) as reached from {inside}) group by all)""", inside=inside)
    last = materialize(last)
    joined = plan.join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    # no crossing bucket: nothing is lacking (p = 0), or all of the source's words together
    return materialize(joined.select("source", "source_size", "target", "whole", "p", F.coalesce("last_key", F.when(p > 0, F.lit(2**52)).otherwise(F.lit(-1))).alias("last_key")))


def take(docs: DataFrame, plan: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """row (docs' columns), size, source_size, target and copies of each row; no shuffle of documents where the plan is small."""
    said = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), word_count(docs[text_col]).alias("size"), _random(docs[id_col], docs[text_col], seed).alias("u"), docs[source_col].alias("own"))
    extra = F.when((F.col("p") > 0) & (_rank_key(F.col("u"), F.col("p")) <= F.col("last_key")), 1).otherwise(0)
    return said.join(plan, F.col("own").eqNullSafe(F.col("source"))).select("row", "size", "source_size", "target", (F.col("whole") + extra).cast("bigint").alias("copies"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs. Odd rows as in the module's notes."""
    taken = take(docs, plan_mix(docs, seed), seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return take(docs, plan_mix(docs)).select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
             (('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u from documents),
 w as (select source, sum(size)::bigint as source_size, 2 * sum(size)::bigint as cap, [3, 1, 2][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight from d group by source),
 c as (select *, sum(source_size) over () * 1.5::double as total, row_number() over (order by cap::double / weight, source nulls last) as k from w),
 l as (select *, (total - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0)::double) / (sum(weight) over (order by k rows between current row and unbounded following))::double as level from c),
 t as (select source, source_size, least(cap::double, weight * (select level from l where level <= cap::double / weight order by k limit 1)) as target from l),
 r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t),
 p as (select *, floor(rate)::bigint as whole, rate - floor(rate) as p, target - floor(rate) * source_size as lacks from r),
 k as (select d.doc_id, d.source, d.size, p.source_size, p.target, p.whole, p.p, p.lacks,
         case when p.p > 0 then u * (1 - p.p) end as above, (1 - u) * p.p as below from d join p on d.source is not distinct from p.source),
 q as (select *, floor(above / (above + below) * 4503599627370496.0::double)::bigint as key from k),
 s as (select *, sum(size) over (partition by source order by key) as reached from q where key is not null),
 b as (select source, min(abs(reached - lacks)) as gap, any_value(lacks) as lacks from s group by source),
 e as (select s.source, min(s.key) as last_key from s join b on s.source is not distinct from b.source where abs(s.reached - s.lacks) = b.gap and b.gap < b.lacks group by s.source)
select q.doc_id, q.size, q.source_size, round(q.target, 6) as target, (q.size * (q.whole + case when q.key <= coalesce(e.last_key, -1) then 1 else 0 end))::bigint as taken
from q left join e on q.source is not distinct from e.source
"""
