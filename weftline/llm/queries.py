"""The pN_ queries of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.canonical import map_values
from weftline.llm.language import languages
from weftline.llm.leakage import leak_places, leaks, without_leaks
from weftline.llm.packing import fill, pack
from weftline.llm.percentiles import group_percentiles


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _seconds(c: str):
    size = F.abs(F.col(c))
    return F.when(size >= 10**17, F.floor(F.col(c) / 10**9)).when(size >= 10**14, F.floor(F.col(c) / 10**6)).when(size >= 10**11, F.floor(F.col(c) / 1000)).otherwise(F.col(c))


def _rtts(spark: SparkSession, folder: str) -> DataFrame:
    """(prb_id, dst_addr, rtt) of every valid reply; a measurement delivered twice counts once (lowest rec_id)."""
    pings = _table(spark, folder, "pings").where(F.col("prb_id").isNotNull() & F.col("dst_addr").isNotNull())
    valid = F.filter(F.transform("result", lambda r: r["rtt"]), lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    one = pings.select("msm_id", "prb_id", _seconds("timestamp").alias("ts"), "rec_id", "dst_addr", valid.alias("rtts")).groupBy("msm_id", "prb_id", "ts").agg(F.min(F.struct("rec_id", "dst_addr", "rtts")).alias("f"))
    return one.select("prb_id", F.col("f.dst_addr").alias("dst_addr"), F.explode("f.rtts").alias("rtt"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    p = group_percentiles(_rtts(spark, folder), ["prb_id", "dst_addr"], "rtt", [0.5, 0.95]).where(F.col("n") >= 30)
    over = F.explode(F.array_compact(F.array(F.when(F.col("at")[0] > 120, F.lit("p50")), F.when(F.col("at")[1] > 250, F.lit("p95")))))
    return p.select("prb_id", "dst_addr", over.alias("stat"))


def p3_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each target over all probes: few groups, one of them with a tenth of all values."""
    p = group_percentiles(_rtts(spark, folder), ["dst_addr"], "rtt", [0.05, 0.5, 0.9, 0.99])
    cut = lambda i: F.floor(F.col("at")[i] * 1000 + 0.5) / 1000
    return p.select("dst_addr", "n", cut(0).alias("p05"), cut(1).alias("p50"), cut(2).alias("p90"), cut(3).alias("p99"))


def _city_map(spark: SparkSession, folder: str) -> DataFrame:
    airports = _table(spark, folder, "airports")
    rows = airports.select("municipality", F.col("iata_code").alias("code"))
    other = airports.select("municipality", F.explode(F.split("keywords", ",")).alias("alias")).select("municipality", F.trim("alias").alias("alias"))
    # country codes are a bounded set: two letters each
    countries = frozenset(r[0].lower() for r in airports.select("iso_country").where(F.length("iso_country") == 2).distinct().collect())
    return map_values(_table(spark, folder, "regions"), "city", rows.select("municipality"), "municipality", rows, "code", other, "alias", countries)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    regions = _table(spark, folder, "regions").select(F.col("id").alias("region_id"), F.col("city").alias("value")).where(F.col("value").rlike(r"\S"))
    return regions.join(_city_map(spark, folder), "value").select("region_id", F.col("entry").alias("municipality")).distinct()


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed values that fit no municipality, with the number of regions."""
    regions = _table(spark, folder, "regions").select(F.col("city").alias("value"))
    return regions.join(_city_map(spark, folder).where(F.col("entry") == ""), "value").groupBy("value").agg(F.count("*").alias("regions"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where(F.col("piece") >= 1).select("doc_id").distinct()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Where every document lies."""
    return _packed(spark, folder)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill(_packed(spark, folder))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each leaked item how many documents hold passages of it, and the longest run of words."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("run").alias("longest"))


def p9_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where the passages stand, in words from the start of the document and of the item."""
    return leak_places(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each source when documents with leaked passages are removed."""
    documents = _table(spark, folder, "documents").select("doc_id", "source")
    return without_leaks(documents, _leaks(spark, folder), "doc_id").groupBy("source").agg(F.count("*").alias("documents"))


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").where(F.length("text") >= 40)
    return languages(docs, "doc_id", "text", "lang")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    wrong = F.col("label").isNull() | (F.lower(F.trim("label")) != F.col("lang"))
    found = _languages(spark, folder).where(F.col("lang").isNotNull() & ((F.col("role") == "segment") | wrong))
    return found.select("doc_id", "lang", F.when(F.col("role") == "own", F.lit("label")).otherwise(F.col("role")).alias("role")).distinct()


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    """How the languages found agree with the labels given."""
    own = _languages(spark, folder).where(F.col("role") == "own")
    return own.groupBy(F.lower(F.trim("label")).alias("label"), "lang").agg(F.count("*").alias("documents"), F.avg("confidence").alias("confidence"))


QUERIES = {f.__name__: f for f in (p3_found, p3_targets, p4_found, p4_unmatched, p8_found, p8_containers, p8_fill, p9_found, p9_items, p9_places, p9_clean, p10_found, p10_labels)}

_TS = "CASE WHEN abs(timestamp) >= 100000000000000000 THEN timestamp // 1000000000 WHEN abs(timestamp) >= 100000000000000 THEN timestamp // 1000000 WHEN abs(timestamp) >= 100000000000 THEN timestamp // 1000 ELSE timestamp END"
_RTTS = f"""one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msm_id, prb_id, {_TS} ORDER BY rec_id) AS k FROM pings WHERE prb_id IS NOT NULL AND dst_addr IS NOT NULL) WHERE k = 1),
rtts AS (SELECT prb_id, dst_addr, rtt FROM (SELECT prb_id, dst_addr, unnest(result).rtt AS rtt FROM one) WHERE rtt IS NOT NULL AND NOT isnan(rtt) AND NOT isinf(rtt) AND rtt >= 0)"""
_GRAMS = "SELECT {0}, unnest(list_transform(range(1, len(l) - 10), lambda i: array_to_string(l[i:i + 11], ' '))) AS g, unnest(range(0, len(l) - 11)) AS pos FROM (SELECT {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS l FROM {1}) WHERE len(l) >= 12"
_HITS = f"d AS ({_GRAMS.format('doc_id', 'documents')}), i AS ({_GRAMS.format('item_id', 'eval_items')}), hits AS (SELECT DISTINCT doc_id, item_id, d.pos, i.pos AS item_pos FROM d JOIN i USING (g)), runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, pos - item_pos ORDER BY pos) AS run FROM hits), places AS (SELECT doc_id, item_id, min(pos) AS \"at\", min(item_pos) AS item_at, (count(*) + 11)::INT AS run FROM runs GROUP BY doc_id, item_id, pos - item_pos, run)"
SQL = {
    "p9_found": f"WITH {_HITS} SELECT DISTINCT doc_id, item_id FROM hits",
    "p9_items": f"WITH {_HITS} SELECT item_id, count(DISTINCT doc_id) AS documents, max(run) AS longest FROM places GROUP BY 1",
    "p9_places": f"WITH {_HITS} SELECT * FROM places",
    "p9_clean": f"WITH {_HITS} SELECT source, count(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits) GROUP BY 1",
    "p3_found": f"WITH {_RTTS}, g AS (SELECT prb_id, dst_addr, quantile_cont(rtt, 0.5) AS a, quantile_cont(rtt, 0.95) AS b FROM rtts GROUP BY ALL HAVING count(*) >= 30) SELECT prb_id, dst_addr, 'p50' AS stat FROM g WHERE a > 120 UNION ALL SELECT prb_id, dst_addr, 'p95' FROM g WHERE b > 250",
    "p3_targets": f"WITH {_RTTS} SELECT dst_addr, count(*) AS n, " + ", ".join(f"floor(quantile_cont(rtt, {q}) * 1000 + 0.5) / 1000 AS {a}" for q, a in ((0.05, "p05"), (0.5, "p50"), (0.9, "p90"), (0.99, "p99"))) + " FROM rtts GROUP BY dst_addr",
    "p8_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 4096",
}
