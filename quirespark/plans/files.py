"""Sources, sinks and incremental state over the test tables. Queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.plans.ledger import PAGES, pages
from quirespark.sources import extractors as E
from quirespark.sources import iiif as II
from quirespark.sources import pages as P
from quirespark.sources import sinks as K
from quirespark.streaming import checkpoint as C


def page_split(s: SparkSession, d: str) -> DataFrame:
    """Documents cut at blank lines as if these were form feeds."""
    docs = s.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(P.split_pages(F.col("text"), "\n\n")).alias("i", "content")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("page_number"), F.length("content").cast("bigint").alias("n_chars"))


def word_confidence(s: SparkSession, d: str) -> DataFrame:
    """Word tables made of the lines of orders, read back as confidences."""
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), F.lit("1"), "l_linenumber", "l_partkey", "l_suppkey", F.lit("40"), F.lit("20"), F.col("l_quantity").cast("int") * 2, F.lit("word")).alias("row"))
    tsv = li.groupBy("l_orderkey").agg(F.concat_ws("\n", F.collect_list("row")).alias("tsv"))
    return tsv.select("l_orderkey", P.tsv_confidence(F.col("tsv")).alias("c")).select("l_orderkey", "c.word_count", "c.mean", "c.min", "c.below_60_count", "c.below_60_ratio")


def alto_confidence(s: SparkSession, d: str) -> DataFrame:
    """ALTO files made of nation's rows, read back as words."""
    n = s.read.parquet(f"{d}/nation.parquet")
    xml = F.concat(F.lit("<alto><Layout><Page ID='p'><PrintSpace><TextLine><String CONTENT='"), F.col("n_name"), F.lit("' HPOS='"), F.col("n_nationkey") * 10, F.lit("' VPOS='5' WIDTH='40' HEIGHT='12' WC='0."), F.col("n_nationkey") % 10, F.lit("'/></TextLine></PrintSpace></Page></Layout></alto>"))
    return n.select("n_nationkey", P.alto(xml.cast("binary")).alias("a")).select("n_nationkey", F.inline("a.words")).select("n_nationkey", "x0", "x1", "confidence", "text")


def manifest_changes(s: SparkSession, d: str) -> DataFrame:
    src = s.read.parquet(f"{d}/sources.parquet").select(F.col("source_key").alias("name"), F.regexp_extract("source_key", r"_(\d+)_", 1).cast("int").alias("position"), F.col("source_sha256").alias("sha256"))
    old = src.filter("position % 10 != 3")
    new = src.filter("position % 10 != 4").withColumn("sha256", F.when(F.col("position") % 10 == 5, F.lit("x")).otherwise(F.col("sha256"))).withColumn("position", F.when(F.col("position") % 10 == 6, F.col("position") + 1).otherwise(F.col("position")))
    return P.manifest_changes(old, new)


def iiif_canvases(s: SparkSession, d: str) -> DataFrame:
    src = s.read.parquet(f"{d}/sources.parquet")
    three = F.to_json(F.struct(F.array(*[F.struct(F.concat("source_key", F.lit(f"/c{i}")).alias("id"), F.array(F.struct(F.array(F.struct(F.struct(F.lit("full").alias("id"), F.array(F.struct(F.concat("source_key", F.lit(f"/s{i}")).alias("id"))).alias("service")).alias("body"))).alias("items"))).alias("items")) for i in (1, 2)]).alias("items")))
    return src.select("source_key", F.inline(P.iiif_canvases(three)))


def image_requests(s: SparkSession, d: str) -> DataFrame:
    """The largest image to ask for of each source, whose information documents are of four kinds: two interfaces, with and without limits, with listed sizes only."""
    src = s.read.parquet(f"{d}/sources.parquet").select("source_key", (F.col("page_count") * 10).alias("w"), (F.col("page_count") * 7).alias("h"), (F.col("page_count") % 4).alias("kind"))
    three, two = '"@context": "http://iiif.io/api/image/3/context.json"', '"@context": "http://iiif.io/api/image/2/context.json"'
    size = F.concat(F.lit(', "width": '), F.col("w"), F.lit(', "height": '), F.col("h"))
    half = lambda k: F.concat(F.lit('{"width": '), F.floor(F.col("w") / k), F.lit(', "height": '), F.floor(F.col("h") / k), F.lit("}"))
    body = F.when(F.col("kind") == 0, F.concat(F.lit("{" + three), size)).otherwise(F.concat(F.lit("{" + two), size))
    rest = F.when(F.col("kind") == 2, F.lit(', "profile": ["level1", {"maxWidth": 1000}]')).when(F.col("kind") == 3, F.concat(F.lit(', "profile": "level0", "maxWidth": 1500, "sizes": ['), half(2), F.lit(", "), half(4), F.lit("]"))).otherwise(F.lit(""))
    info = II.image_info(F.concat(body, rest, F.lit("}")))
    service = F.concat(F.lit("https://images.example/"), "source_key", F.lit("/"))
    return src.select("source_key", II.image_request(service, info).alias("request"))


def transcripts(s: SparkSession, d: str) -> DataFrame:
    t = K.transcripts(pages(s, d).select("job_id", "page_number", F.col("selected_output.text").alias("text")))
    return t.select("job_id", "n_pages", F.md5("transcript").alias("md5"))


def tei(s: SparkSession, d: str) -> DataFrame:
    return K.tei_pages(pages(s, d).select("job_id", "page_number", F.col("selected_output.text").alias("text")))


def inventory(s: SparkSession, d: str) -> DataFrame:
    return K.inventory(s.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL"), "doc_id", "text")


def extraction(s: SparkSession, d: str) -> DataFrame:
    """Every page's selected text through the built-in extractor."""
    p = pages(s, d).select(F.concat_ws("/", "job_id", "page_id").alias("page_id"), F.col("selected_output.text").alias("content"))
    return E.extract(p, "text").select("page_id", F.length("content").cast("bigint").alias("n_chars"), "format", "error")


# event types of the stream as transitions of the automaton
_KIND = {"click": "start", "view": "response", "purchase": "complete", "error": "fail"}


def checkpoint_states(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv]), F.col("event_type")), F.lit("start"))
    return C.fold(e.select(F.col("user_id").alias("page_id"), "ts", kind.alias("kind")))


def event_windows(s: SparkSession, d: str) -> DataFrame:
    return C.windows(s.read.parquet(f"{d}/events.parquet")).select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", "value")


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return C.sessions(s.read.parquet(f"{d}/events.parquet")).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (page_split, word_confidence, alto_confidence, manifest_changes, iiif_canvases, image_requests, transcripts, tei, inventory, extraction, checkpoint_states, event_windows, event_sessions)}
_SRC = r"(SELECT source_key AS name, regexp_extract(source_key, '_(\d+)_', 1)::INTEGER AS position, source_sha256 AS sha256 FROM sources)"
_XML = r"replace(replace(replace(regexp_replace(coalesce({0}, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{fffe}}\x{{ffff}}]', chr(65533), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLES = {
    "page_split": r"SELECT doc_id, i AS page_number, length(p[i]) AS n_chars FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM (SELECT doc_id, CASE WHEN len(p) > 1 AND NOT regexp_matches(p[len(p)], '\S') THEN p[1:len(p) - 1] ELSE p END AS p FROM (SELECT doc_id, string_split(regexp_replace(text, '^\x{feff}', ''), chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL) q) q1) q2",
    "word_confidence": "SELECT l_orderkey, count(*) AS word_count, round(avg(c) / 100, 4) AS mean, min(c)::DOUBLE AS min, count(*) FILTER (c < 60) AS below_60_count, round(count(*) FILTER (c < 60)::DOUBLE / count(*), 4) AS below_60_ratio FROM (SELECT l_orderkey, floor(l_quantity)::INTEGER * 2 AS c FROM lineitem) q GROUP BY 1",
    "alto_confidence": "SELECT n_nationkey, (n_nationkey * 10)::INTEGER AS x0, (n_nationkey * 10 + 40)::INTEGER AS x1, (n_nationkey % 10) / 10.0::DOUBLE AS confidence, n_name AS text FROM nation",
    "manifest_changes": f"SELECT name, CASE WHEN position % 10 = 4 THEN 'missing' WHEN position % 10 = 3 THEN 'added' WHEN position % 10 = 5 THEN 'changed' ELSE 'reordered' END AS change FROM {_SRC} s WHERE position % 10 IN (3, 4, 5, 6)",
    "iiif_canvases": "SELECT source_key, source_key || '/c' || i AS canvas, source_key || '/s' || i AS service FROM sources, (VALUES (1), (2)) v(i)",
    "transcripts": f"SELECT job_id, count(*) AS n_pages, md5(string_agg(coalesce(selected_output.text, ''), chr(12) ORDER BY page_number, coalesce(selected_output.text, ''))) AS md5 FROM {PAGES} p GROUP BY 1",
    "tei": f"""SELECT job_id, '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>' || {_XML.format('job_id')} || '</title></titleStmt></fileDesc></teiHeader><text><body>' || string_agg('<pb n="' || page_number || '"/><ab>' || {_XML.format('selected_output.text')} || '</ab>', '' ORDER BY page_number, {_XML.format('selected_output.text')}) || '</body></text></TEI>' AS tei FROM {PAGES} p GROUP BY job_id""",
    "image_requests": """SELECT source_key, 'https://images.example/' || source_key || '/full/' || CASE kind WHEN 0 THEN 'max' WHEN 1 THEN 'full' WHEN 2 THEN CASE WHEN w <= 1000 THEN 'full' ELSE greatest(1, floor(w * (1000::DOUBLE / w)))::BIGINT || ',' END
 ELSE CASE WHEN w <= 1500 THEN 'full' WHEN w // 2 <= 1500 THEN (w // 2) || ',' WHEN w // 4 <= 1500 THEN (w // 4) || ',' END END || '/0/default.jpg' AS request FROM (SELECT source_key, page_count * 10 AS w, page_count % 4 AS kind FROM sources) q""",
    "inventory": "SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
    "extraction": f"SELECT job_id || '/' || page_id AS page_id, length(coalesce(selected_output.text, '')) AS n_chars, 'text' AS format, NULL::VARCHAR AS error FROM {PAGES} p",
    "event_windows": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "event_sessions": "SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events) q) q1 GROUP BY 1, 2) q2 GROUP BY 1",
}
