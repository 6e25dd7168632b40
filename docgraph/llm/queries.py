"""One query per operator over its whole table, and SQL where SQL can express it."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from docgraph.llm import decontaminate, gif, licences, mixing, quality, secrets, sharding, simhash, substrings, tokenids
from docgraph.llm.tables import documents, tokenizer_path


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), secrets.train(secrets.labelled_findings(spark)), path_col="source")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mixing.copies(documents(spark, sf_dir))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.deduplicate(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.tokenize(documents(spark, sf_dir), tokenizer_path())


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = gif.media_features(documents(spark, sf_dir))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.col("n_frames").cast("string")), F.concat(F.lit("duration="), F.col("duration").cast("string")), F.concat(F.lit("histogram="), F.array_join(F.col("histogram").cast("array<string>"), ",")))
    return features.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs.select("doc_id", "text"), model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_secrets, op2_simhash, op3_mixing, op4_substrings, op5_tokenids, op6_licences, op7_decontaminate, op8_sharding, op9_media, op10_quality)}

_SHARDS = """
with hashed as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as bytes,
         ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as bits
  from documents),
paths as (select doc_id, bytes, d.depth::int as depth, bits >> (60 - d.depth)::int as prefix from hashed, (select unnest(range(0, 41)) as depth) d),
sums as (select depth, prefix, sum(bytes)::bigint as shard_bytes, count(*)::bigint as shard_docs from paths group by depth, prefix),
fits as (
  select p.doc_id, p.bytes, p.depth, p.prefix, s.shard_bytes, s.shard_docs,
         row_number() over (partition by p.doc_id order by p.depth) as turn
  from paths p join sums s on p.depth = s.depth and p.prefix = s.prefix
  where s.shard_bytes <= 1048576 or s.shard_docs = 1)
select doc_id, bytes, case when depth = 0 then '' else right(lpad(bin(prefix), 60, '0'), depth) end as shard_id, depth, shard_bytes, shard_docs
from fits where turn = 1
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MIX = f"""
with sized as (select doc_id, source, coalesce(doc_id::varchar, 'null') as key, len({_WORDS})::bigint as size from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as weight,
         3.0::double * source_size as fill
  from sources),
levels as (
  select *, fill / weight as ratio,
         ((sum(source_size) over ())::double - coalesce(sum(fill) over (order by fill / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
         / sum(weight) over (order by fill / weight, source nulls last rows between current row and unbounded following) as level
  from weighed),
first_level as (select level from levels where level <= ratio order by ratio, level limit 1),
planned as (select source, source_size, round(least(fill, (select level from first_level) * weight), 6) as target from levels),
rated as (select source, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate from planned),
tried as (
  select s.source, n.seed, sum(s.size * (floor(r.rate) + (case when ('0x' || substr(md5(n.seed::varchar || ':' || s.key), 1, 13))::bigint::double / 4503599627370496.0 < r.rate - floor(r.rate) then 1 else 0 end))) as got
  from sized s join rated r on s.source is not distinct from r.source, (select unnest(range(0, 32)) as seed) n
  group by s.source, n.seed),
chosen as (
  select source, seed from (
    select t.source, t.seed, row_number() over (partition by t.source order by abs(t.got - r.target), t.seed) as turn
    from tried t join rated r on t.source is not distinct from r.source) x
  where turn = 1)
select s.doc_id, s.size, r.source_size, r.target,
       (s.size * (floor(r.rate) + (case when ('0x' || substr(md5(c.seed::varchar || ':' || s.key), 1, 13))::bigint::double / 4503599627370496.0 < r.rate - floor(r.rate) then 1 else 0 end)))::bigint as taken
from sized s join rated r on s.source is not distinct from r.source join chosen c on s.source is not distinct from c.source
"""

_SUBSTRINGS = f"""
with split as (select doc_id, {_WORDS} as words from documents),
windows as (select doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from split where len(words) >= 13) x),
firsts as (select g, min(doc_id) as first from windows group by g),
covered as (select distinct w.doc_id, w.i + k.k as pos from windows w join firsts f on w.g = f.g, (select unnest(range(0, 13)) as k) k where f.first < w.doc_id),
kept as (
  select s.doc_id, count(*) as n, string_agg(s.word, ' ' order by s.pos) as text
  from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from split) s
  left join covered c on s.doc_id = c.doc_id and s.pos = c.pos where c.pos is null group by s.doc_id)
select s.doc_id, len(s.words)::bigint as n_words, (len(s.words) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from split s left join kept k on s.doc_id = k.doc_id
"""

ORACLES = {"op3_mixing": _MIX, "op4_substrings": _SUBSTRINGS, "op8_sharding": _SHARDS}
