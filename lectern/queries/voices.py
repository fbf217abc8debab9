"""Voice samples by name."""

from pyspark.sql import functions as F

from lectern.functions.vectors import dot, normalized, rounded, weighted_sum
from lectern.operators import identity
from lectern.sources.tables import voices

QUERIES, ORACLES = {}, {}

_LIB = "lib as (select vec_id seq, 'n' || label as name, embedding::double[] v from embeddings)"
_SCORES = f"""{_LIB}, p as (select q.seq as query, l.name, l.seq, list_inner_product(q.v, l.v) score from lib q, lib l where q.seq <> l.seq),
s as (select query, name, max(score) score, arg_max(seq, score) first_seq from p group by all),
r as (select *, row_number() over (partition by query order by score desc, first_seq) n, lead(score) over (partition by query order by score desc, first_seq) as nxt from s)"""
_LOO = f"""{_LIB}, p as (select a.seq as query, a.name own_name, b.name, b.seq, list_inner_product(a.v, b.v) score from lib a, lib b where a.seq <> b.seq),
s as (select query, own_name, name, max(score) score, arg_max(seq, score) first_seq from p group by all)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _parts(spark, sf_dir):
    """Every sample as a query against all others."""
    lib = voices(spark, sf_dir)
    return lib.select(F.col("seq").alias("query"), "vec", F.col("seq").alias("own_seq")), lib


#: The tables' vectors are further apart than voices are, so queries ask for less than the defaults.
LOW = 0.30


@query(f"with {_SCORES} select query, name, round(score, 6) score from r where n = 1 and score >= 0.30")
def voice_match(spark, sf_dir):
    return identity.recognize(*_parts(spark, sf_dir), threshold=LOW).withColumn("score", F.round("score", 6))


@query(f"""with {_SCORES}, k as (select * from r where n = 1 and score >= 0.30 and (nxt is null or not score - nxt < 0.01)),
u as (select *, row_number() over (partition by name order by score desc, query) w from k)
select query, name, round(score, 6) score from u where w = 1""")
def voice_match_unique(spark, sf_dir):
    return identity.recognize_each(*_parts(spark, sf_dir), threshold=LOW, margin=0.01).withColumn("score", F.round("score", 6))


@query(f"""with {_SCORES}, k as (select query, score top from r where n = 1 and score >= 0.30 and score - nxt < 0.05),
c as (select r.query, r.name, r.score, row_number() over (partition by r.query order by r.n) place from r join k using (query) where top - r.score < 0.05 and r.name <> 'n3')
select query, place::int place, name, round(score, 6) score from c where place <= 3""")
def close_calls(spark, sf_dir):
    taken = spark.createDataFrame([("n3",)], "name string")
    return identity.close_calls(*_parts(spark, sf_dir), taken=taken, threshold=LOW, margin=0.05).withColumn("score", F.round("score", 6))


@query(f"""with {_LOO}, own as (select query, score own from s where name = own_name),
o as (select *, row_number() over (partition by query order by score desc, first_seq) n, lead(score) over (partition by query order by score desc, first_seq) nxt from s where name <> own_name)
select o.query seq, own_name as name, round(own, 6) own, o.name other, round(score, 6) best, round(score - own, 6) gap, round(coalesce(score - nxt, 0), 6) lead
from o join own using (query) where n = 1 and score - own >= 0.02 and (nxt is null or score - nxt >= 0.01)""")
def suspects(spark, sf_dir):
    x = identity.suspects(voices(spark, sf_dir), 0.02, 0.01)
    return x.select("seq", "name", "other", *[F.round(c, 6).alias(c) for c in ("own", "best", "gap", "lead")])


@query(f"""with {_LOO}, r as (select *, row_number() over (partition by query order by score desc, first_seq) n, lead(score) over (partition by query order by score desc, first_seq) nxt from s),
m as (select (i / 50.0)::double as margin from range(0, 6) t(i)), x as (select margin, name = own_name good, score >= 0.30 and (nxt is null or not score - nxt < margin) hit from r, m where n = 1)
select margin, count(*) evaluated, count(*) filter (hit and good) correct, count(*) filter (hit and not good) wrong, round(count(*) filter (hit and good) / nullif(count(*) filter (hit), 0), 6) as "precision" from x group by margin""")
def margin_sweep(spark, sf_dir):
    return identity.margin_sweep(voices(spark, sf_dir), [i / 50.0 for i in range(6)], LOW).withColumn("precision", F.round("precision", 6))


@query("""with e as (select vec_id, label, embedding from embeddings union all select vec_id + 1000000000, label, embedding from embeddings where vec_id % 3 = 0),
p as (select a.vec_id seq, 'n' || a.label as name, b.vec_id of_seq, row_number() over (partition by a.vec_id order by b.vec_id) n from e a join e b on a.label = b.label and b.vec_id < a.vec_id and list_inner_product(a.embedding::double[], b.embedding::double[]) >= 0.999)
select seq, name, of_seq from p where n = 1""")
def duplicates(spark, sf_dir):
    """Every third sample comes again as a later one."""
    v = voices(spark, sf_dir)
    return identity.duplicates(v.unionByName(v.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)))


_DIMS = "d as (select label, generate_subscripts(embedding, 1) i, unnest(embedding)::double x from embeddings), c as (select label, i, sum(x) x from d group by all), z as (select label, sqrt(sum(x * x)) n from c group by label)"


@query(f"with {_DIMS} select label, list(round(x / n, 5) order by i) as vector from c join z using (label) group by label")
def label_centroids(spark, sf_dir):
    from lectern.sources.tables import table

    x = weighted_sum(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return x.select("label", rounded(normalized(F.col("vector")), 5).alias("vector"))


@query(f"""with {_DIMS}, v as (select label, list(x / n order by i) u from c join z using (label) group by label)
select e.label, count(*) samples, round(avg(list_inner_product(e.embedding::double[], u)), 6) cohesion from embeddings e join v using (label) group by e.label""")
def label_quality(spark, sf_dir):
    from lectern.sources.tables import table

    e = table(spark, sf_dir, "embeddings")
    centre = weighted_sum(e, ["label"], "embedding").withColumn("vector", normalized(F.col("vector")))
    return e.join(centre, "label").groupBy("label").agg(F.count("*").alias("samples"), F.round(F.avg(dot(F.col("embedding"), F.col("vector"))), 6).alias("cohesion"))


@query("select vec_id seq, 'n' || label as name from (select *, row_number() over (partition by label order by vec_id desc) n from embeddings) where n <= 8")
def retention_top8(spark, sf_dir):
    return identity.retain(voices(spark, sf_dir)).select("seq", "name")


@query("select vec_id seq, case label when 3 then 'n5' else 'n' || label end as name from (select *, row_number() over (partition by case label when 3 then 5 else label end order by vec_id desc) n from embeddings) where n <= 8")
def rename_merge(spark, sf_dir):
    return identity.rename(voices(spark, sf_dir), "n3", "n5").select("seq", "name")


@query("select count(*) filter (label = 3) moving, count(*) filter (label = 5) existing, greatest(0, count(*) filter (label in (3, 5)) - 8) dropped from embeddings")
def rename_plan(spark, sf_dir):
    return identity.rename_plan(voices(spark, sf_dir), "n3", "n5")


@query("select vec_id seq, 'n' || label as name from (select *, row_number() over (partition by label order by vec_id) - 1 n from embeddings) where not (label = 1 and n in (0, 4))")
def delete_samples(spark, sf_dir):
    return identity.delete_samples(voices(spark, sf_dir), spark.createDataFrame([("n1", 0), ("n1", 4)], "name string, nth int")).select("seq", "name")


@query("""with e as (select vec_id seq, 'n' || label as name, embedding::double[] v from embeddings union all select vec_id + 1000000000, case when vec_id % 6 = 0 then 'twin' else 'n' || label end, embedding::double[] from embeddings where vec_id % 3 = 0),
p as (select a.seq, a.name own_name, b.name, b.seq of_seq, list_inner_product(a.v, b.v) score from e a join e b on a.seq <> b.seq),
s as (select seq, own_name, name, max(score) score, arg_min(of_seq, -score * 1e12 + of_seq / 1e10) first_seq from p group by all), own as (select seq, score own from s where name = own_name),
o as (select *, row_number() over (partition by seq order by score desc, first_seq) n, lead(score) over (partition by seq order by score desc, first_seq) nxt from s where name <> own_name),
m as (select o.seq, own_name as name, o.name other, score - own gap from o join own using (seq) where n = 1 and score - own >= 0.2 and (nxt is null or score - nxt >= 0.08)),
k as (select *, row_number() over (partition by name order by seq desc) n from e), c as (select name, count(*) n from e group by name)
select 'duplicate' as kind, own_name as name, seq, min(of_seq)::varchar as other, null::double as score from p where own_name = name and of_seq < seq and score >= 0.999 group by all
union all select 'misfiled', name, seq, other, round(gap, 6) from m
union all select 'whole', name, null, null, null from (select name, count(*) s from m group by name) join c using (name) where s = c.n
union all select 'unlike', name, null, null, round(min(list_inner_product(a.v, b.v)), 6) from k a join k b using (name) where a.n <= 8 and b.n <= 8 and a.seq < b.seq group by name having min(list_inner_product(a.v, b.v)) < 0.4""")
def library_health(spark, sf_dir):
    """A library in which every third sample comes twice, half of these under another name: duplicates, misfiled samples, names without one to trust."""
    v = voices(spark, sf_dir)
    again = v.where("seq % 3 = 0").select((F.col("seq") + 1_000_000_000).alias("seq"), F.when(F.col("seq") % 6 == 0, "twin").otherwise(F.col("name")).alias("name"), "vec")
    return identity.health_report(v.unionByName(again)).withColumn("score", F.round("score", 6))
