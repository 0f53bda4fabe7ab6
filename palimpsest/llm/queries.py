"""The operators applied, with production parameters, to whole tables; SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter
from .decontaminate import contaminated
from .fixity import audit, warc_index
from .language import identify
from .mixing import take
from .ngram_join import jaccard_components
from .pseudo_likelihood import pseudo_likelihood
from .secrets import find_secrets, secret_digest
from .session import materialize, table
from .toxicity import toxicity_scores
from .vectors import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query
def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC archives, against a replica in which Spark has damaged some: records of which a byte
    differs (id mod 97 is 3), that are lost (5), or that stand only in the replica (7)."""
    fate = F.col("id") % 97
    flip = lambda payload: F.when(fate == 3, F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit("X").cast("binary")))
    records = materialize(warc_index(table(spark, sf_dir, "pages"), also={"flipped": flip}), "warc")
    good = records.where((fate != 7) | fate.isNull())
    return audit(good, records.where((fate != 5) | fate.isNull()).withColumn("hash", F.coalesce("flipped", "hash")))


ORACLE_SQL["op3_warc_fixity"] = """
WITH r AS (
  SELECT page_id, coalesce(url, '') AS u, CAST(floor(page_id / 200) AS BIGINT) AS archive,
    octet_length(encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
      || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10))) AS length
  FROM pages),
o AS (
  SELECT *, CASE WHEN archive IS NOT NULL THEN coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, u, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS "offset"
  FROM r)
SELECT archive, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
  CASE page_id % 97 WHEN 3 THEN 'changed' WHEN 5 THEN 'missing' ELSE 'extra' END AS finding
FROM o WHERE page_id % 97 IN (3, 5, 7)
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL["op5_url_filter"] = url_filter.ORACLE


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op7_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take(table(spark, sf_dir, "documents")).drop("row")


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(table(spark, sf_dir, "documents")))
