"""Queries of the document library, its life cycle and its events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.merged import Library
from quarry.sources.store import new_folder
from quarry.sources.tables import LIBRARY_SQL, library, table
from quarry.streaming import stateful

from .chunks import CHUNKS
from .registry import query


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, title, status, created_s FROM lib WHERE status <> 'deleted'")
def list_documents(spark, sf_dir):
    return library(spark, sf_dir).filter("status <> 'deleted'").select("doc_id", "title", "status", "created_s")


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, title, length(text) AS n FROM lib WHERE source = 'src5' AND status = 'completed'")
def tenant_filter(spark, sf_dir):
    return library(spark, sf_dir).filter((F.col("source") == "src5") & (F.col("status") == "completed")).select("doc_id", "title", F.length("text").cast("long").alias("n"))


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, status, CAST((1704067200 + 60000 - created_s) // 60 AS BIGINT) AS age_minutes FROM lib WHERE status IN ('pending', 'processing') AND created_s < 1704067200 + 60000 - 300")
def stuck_documents(spark, sf_dir):
    """Unfinished documents older than five minutes, at a stated time."""
    now = 1704067200 + 60000
    stuck = library(spark, sf_dir).filter(F.col("status").isin("pending", "processing") & (F.col("created_s") < now - 300))
    return stuck.select("doc_id", "status", F.floor((now - F.col("created_s")) / 60).cast("long").alias("age_minutes"))


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, file_name, text <> '' AS has_content FROM lib WHERE string_split(lower(file_name), '.')[-1] IN ('txt', 'html', 'htm', 'pdf', 'json', 'jsonl')")
def ext_filter(spark, sf_dir):
    ext = F.element_at(F.split(F.lower("file_name"), r"\."), -1)
    return library(spark, sf_dir).filter(ext.isin("txt", "html", "htm", "pdf", "json", "jsonl")).select("doc_id", "file_name", (F.col("text") != "").alias("has_content"))


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, title FROM lib WHERE (contains(lower(title), '7') OR contains(lower(file_name), '.html')) AND status = 'completed'")
def doc_text_filter(spark, sf_dir):
    hit = F.lower("title").contains("7") | F.lower("file_name").contains(".html")
    return library(spark, sf_dir).filter(hit & (F.col("status") == "completed")).select("doc_id", "title")


@query(f"WITH {LIBRARY_SQL} SELECT source, count(*) FILTER (status = 'completed') AS completed, count(*) AS total FROM lib GROUP BY source")
def completed_count(spark, sf_dir):
    return library(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count("*").alias("total"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count({c}) AS non_null FROM {t}" for t, c in (("documents", "text"), ("embeddings", "embedding"), ("pages", "html"), ("conversations", "text"), ("events", "value"), ("labels", "quality"))))
def table_counts(spark, sf_dir):
    each = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.count(c).alias("non_null")) for t, c in (("documents", "text"), ("embeddings", "embedding"), ("pages", "html"), ("conversations", "text"), ("events", "value"), ("labels", "quality"))]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT d.doc_id, sha256(d.text) AS content_hash FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)")
def dedup_reject(spark, sf_dir):
    """Uploads that are rejected: an earlier document has the same content."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = h.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    return h.join(first, "content_hash").filter("doc_id > first").select("doc_id", "content_hash")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_existing(spark, sf_dir):
    """Documents that a migration still has to copy: the target (labels) has no such id."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT 'page' AS kind, page_id AS id, length(html) AS n FROM pages UNION ALL SELECT 'document', doc_id, length(text) FROM documents")
def mixed_sources_union(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("n"))
    return pages.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n")))


@query(f"WITH {LIBRARY_SQL} SELECT l.doc_id, coalesce('relabelled ' || x.quality, l.title) AS title FROM lib l LEFT JOIN labels x ON x.doc_id = l.doc_id UNION ALL SELECT doc_id, 'relabelled ' || quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def upsert_latest(spark, sf_dir):
    """The library after an upsert of newer titles: updated where the id exists, added where not."""
    base = library(spark, sf_dir).select("doc_id", "title")
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("relabelled "), "quality").alias("title"))
    return base.join(new, "doc_id", "left_anti").unionByName(new)


@query("""WITH s AS (SELECT doc_id, status, ts FROM (SELECT doc_id, 'completed' AS status, 1 AS ts FROM documents UNION ALL SELECT doc_id, 'deleted', 2 FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'completed', 3 FROM labels WHERE quality = 0 AND toxic = 1))
SELECT doc_id, arg_max(status, ts) AS status FROM s GROUP BY doc_id""")
def soft_delete_view(spark, sf_dir):
    """Latest state of each document from status events: uploaded, deleted, restored."""
    d, bad = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("quality = 0")
    event = lambda df, status, ts: df.select("doc_id", F.lit(status).alias("status"), F.lit(ts).alias("ts"))
    events = event(d, "completed", 1).union(event(bad, "deleted", 2)).union(event(bad.filter("toxic = 1"), "completed", 3))
    return events.groupBy("doc_id").agg(F.max_by("status", "ts").alias("status"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (value > 5) / NULLIF(count(*), 0), 6) AS success_rate FROM events GROUP BY event_type")
def success_rate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("value") > 5) / F.nullif(F.count("*"), F.lit(0)), 6).alias("success_rate"))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("SELECT user_id, count(*) FILTER (epoch_us(ts) + 1800000000 > 1704240000000000) AS active, count(*) AS n FROM events GROUP BY user_id")
def active_sessions(spark, sf_dir):
    """Sessions of 30 minutes that are open at a stated time, by user."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("us") + 1_800_000_000 > 1_704_240_000_000_000).alias("active"), F.count("*").alias("n"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS seconds, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS BIGINT) AS minutes, strftime(ts, 'Chat %Y-%m-%d %H:%M') AS title FROM events")
def durations(spark, sf_dir):
    us = F.col("us") - 1_704_067_200_000_000
    return events(spark, sf_dir).select("event_id", F.round(us / 1e6, 6).alias("seconds"), F.floor(us / 60_000_000).cast("long").alias("minutes"), F.date_format("ts", "'Chat' yyyy-MM-dd HH:mm").alias("title"))


@query("SELECT event_id, round(40 + 55 * greatest(0.0, least(1.0, value / 20)), 6) AS progress FROM events")
def progress_band(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(T.progress_band(F.col("value") / 20, 40.0, 95.0), 6).alias("progress"))


@query("SELECT event_id, CAST(props->>'$.k' AS INT) AS k, props->>'$.missing' IS NULL AS no_error FROM events")
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k int, missing string")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), parsed["missing"].isNull().alias("no_error"))


@query("SELECT event_id, strftime(CAST(ts AS DATE) + CAST(user_id % 90 AS INT), '%Y-%m-%d') AS retention_until, CAST(ts AS DATE) + CAST(user_id % 90 AS INT) < DATE '2024-02-01' AS expired FROM events")
def retention(spark, sf_dir):
    until = F.date_add(F.col("ts").cast("date"), (F.col("user_id") % 90).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(until, "yyyy-MM-dd").alias("retention_until"), (until < F.lit("2024-02-01").cast("date")).alias("expired"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark, sf_dir):
    """Events of the same user in the hour up to each event."""
    hour = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return events(spark, sf_dir).select("event_id", F.count("*").over(hour).alias("in_window"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid""")
def sessionize(spark, sf_dir):
    """Sessions that end after 30 minutes without an event."""
    e = events(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("us").alias("start_us"), F.count("*").alias("n")).drop("session_window")


@query("SELECT user_id, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id HAVING max(epoch_us(ts)) < (SELECT max(epoch_us(ts)) FROM events) - 3600000000")
def idle_entities(spark, sf_dir):
    """Users without an event in the last hour of the log."""
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max("us").alias("last_us"))
    end = last.agg(F.max("last_us").alias("end"))  # one row
    return last.join(F.broadcast(end)).filter(F.col("last_us") < F.col("end") - 3_600_000_000).drop("end")


@query("SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    w = F.window("t", "1 hour")
    e = events(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total")


@query("""SELECT start_us, count(*) AS n FROM (SELECT CAST((epoch_us(ts) // 900000000 - k) * 900000000 AS BIGINT) AS start_us FROM events, range(0, 4) r(k)) GROUP BY start_us""")
def sliding_counts(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("t", "1 hour", "15 minutes")).agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "n")


@query(f"WITH {LIBRARY_SQL} SELECT doc_id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, status = 'processing' AS recovered FROM lib")
def recover_stuck(spark, sf_dir):
    """What a start after a crash leaves: documents that were being processed wait again."""
    stuck = F.col("status") == "processing"
    return library(spark, sf_dir).select("doc_id", F.when(stuck, "pending").otherwise(F.col("status")).alias("status"), stuck.alias("recovered"))


@query(f"""WITH {LIBRARY_SQL} SELECT doc_id, list_sort(['kind=section', 'lang=' || upper(coalesce(lang, '?')), 'source=' || coalesce(source, '?'), 'title=' || title]) AS metadata FROM lib""")
def metadata_merge(spark, sf_dir):
    """Metadata of a document under that of its section."""
    lang, source = (F.coalesce(c, F.lit("?")) for c in ("lang", "source"))
    base = F.create_map(F.lit("kind"), F.lit("document"), F.lit("lang"), lang, F.lit("source"), source, F.lit("title"), F.col("title"))
    section = F.create_map(F.lit("kind"), F.lit("section"), F.lit("lang"), F.upper(lang))
    entries = F.transform(F.map_entries(T.merged_metadata(base, section)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return library(spark, sf_dir).select("doc_id", F.array_sort(entries).alias("metadata"))


@query("SELECT source, round(avg(r), 6) AS mean_ratio, round(max(r), 6) AS max_ratio FROM (SELECT source, length(text) / greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS r FROM documents) GROUP BY source")
def ratio_summary(spark, sf_dir):
    """Mean and greatest ratio of a measurement: characters a word, by source."""
    ratio = F.length("text") / F.greatest(F.lit(1), T.word_count(F.col("text")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.max(ratio), 6).alias("max_ratio"))


@query("""SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM (SELECT * FROM events WHERE event_type = 'click') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
 ON b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def followed_clicks(spark, sf_dir):
    """Purchases within an hour of a click; the same operator runs over two streams."""
    events = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return stateful.followed(events.filter("event_type = 'click'"), events.filter("event_type = 'purchase'")).select("user_id", "first_id", "second_id")


#: What ``changed_library`` does to all documents, as the state it leaves.
CHANGED = f"""{LIBRARY_SQL}, st AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'New ' || title ELSE title END AS title, CASE WHEN status = 'processing' OR doc_id % 5 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 700) ELSE text END AS text FROM lib WHERE doc_id % 13 <> 0 AND (doc_id % 11 <> 0 OR doc_id % 5 = 0))"""


def changed(spark, sf_dir) -> Library:
    """Documents that are taken up, stopped short and recovered, renamed and cut, deleted softly and for good, with a snapshot on the way and an epoch sent twice."""
    docs, out = library(spark, sf_dir).select("doc_id", "title", "status", "text"), Library(spark, new_folder(spark, "library"))
    busy = F.col("status") == "processing"
    out.upsert(0, docs.filter(~busy))
    out.upsert(1, docs.filter(busy), chunked=False)
    out.delete(2, docs.filter("doc_id % 11 = 0"), soft=True)
    out.compact()
    out.recover(3, before=10)
    fifth = docs.filter("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("New "), "title").alias("title"), F.lit("completed").alias("status"), F.substring("text", 1, 700).alias("text"))
    for _ in range(2):
        out.upsert(4, fifth)
    out.delete(5, docs.filter("doc_id % 13 = 0"))
    return out


@query(f"WITH {CHANGED} SELECT doc_id, title, status, CAST(length(text) AS BIGINT) AS chars FROM st")
def changed_documents(spark, sf_dir):
    """The documents of a library after all its changes, merged as they are read."""
    return changed(spark, sf_dir).documents().select("doc_id", "title", "status", F.length("text").cast("long").alias("chars"))


@query("WITH RECURSIVE " + CHANGED + ", " + CHUNKS.split("RECURSIVE ", 1)[1].replace("FROM documents", "FROM st") + " SELECT doc_id, count(*) AS n_chunks, sha256(string_agg(sha256(chunk), ',' ORDER BY i)) AS chunks_sha256 FROM chunks GROUP BY doc_id")
def changed_chunks(spark, sf_dir):
    """The chunks of these documents: those of the last upsert, without those of documents that are gone."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("chunk_order", F.sha2("chunk", 256).alias("h")))), lambda x: x["h"])
    return changed(spark, sf_dir).chunks().groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sha2(F.array_join(hashes, ","), 256).alias("chunks_sha256"))
