"""Streams over fixed micro-batches, files written and read back, and model selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatterlens import schemas
from chatterlens.functions import labels as lab, scalars as sc
from chatterlens.operators import filters, labeling, training
from chatterlens.plans import texts
from chatterlens.plans.registry import query, r, with_views
from chatterlens.plans.stores import _stored
from chatterlens.plans.streams import _folders
from chatterlens.session import scratch
from chatterlens.sources import readers, store, tables
from chatterlens.streaming import pipelines, replay, sinks


def _turn(key: str, turns: int):
    return F.pmod(F.col(key), F.lit(turns))


# --- streams ------------------------------------------------------------------

@query("stream_ingest", """
SELECT CAST(doc_id % 4 AS INTEGER) AS batch_id, count(*) FILTER (WHERE n_chars >= 200) AS good,
       count(*) FILTER (WHERE n_chars < 200) AS bad,
       CAST(coalesce(sum(length(text)) FILTER (WHERE n_chars >= 200), 0) AS BIGINT) AS chars
FROM documents GROUP BY 1
""")
def stream_ingest(spark, folder):
    """Documents as JSON messages in four batches; those of short texts are cut off."""
    path, checkpoint = _folders(spark, "stream-ingest")
    rows = tables.table(spark, folder, "documents")
    whole = rows.select("doc_id", "n_chars", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("value"))
    broken = F.expr("substring(value, 1, length(value) - 1)")
    wire = whole.select("doc_id", F.when(F.col("n_chars") < 200, broken).otherwise(F.col("value")).alias("value"))
    messages = replay.in_turns(wire, f"{path}-messages", _turn("doc_id", 4), 4)
    sinks.finish(pipelines.ingest(messages.select("value"), path, f"{path}-bad", checkpoint))
    good = sinks.read_batches(spark, path).select("batch_id", F.lit(1).alias("good"), F.length("text").alias("chars"))
    bad = sinks.read_batches(spark, f"{path}-bad").select("batch_id", F.lit(0).alias("good"), F.lit(0).alias("chars"))
    return good.unionByName(bad).groupBy("batch_id").agg(
        F.sum("good").alias("good"), F.count_if(F.col("good") == 0).alias("bad"), F.sum("chars").cast("long").alias("chars"))


@query("stream_of_video", with_views("""
SELECT CAST(comment_id % 3 AS INTEGER) AS batch_id, program_id, count(*) AS "count"
FROM texts WHERE video_id = 'src1' GROUP BY 1, 2
""", "texts"))
def stream_of_video(spark, folder):
    path, checkpoint = _folders(spark, "stream-video")
    arrivals = replay.in_turns(tables.timed_texts(spark, folder), f"{path}-arrivals", _turn("comment_id", 3), 3)
    sinks.finish(sinks.start(
        pipelines.of_video(arrivals, "src1"), lambda batch, n: sinks.write_batch(batch, path, n), checkpoint))
    return sinks.read_batches(spark, path).groupBy("batch_id", "program_id").agg(F.count("*").alias("count"))


@query("stream_notices", with_views("""
WITH rows_ AS (SELECT *, CAST(comment_id % 3 AS INTEGER) AS batch_id FROM texts WHERE is_labeled),
newest AS (
  SELECT batch_id, comment_id, predicted_at, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS p
  FROM rows_ QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY predicted_at DESC, comment_id DESC) <= 3)
SELECT n.batch_id, 'new_predictions' AS type, (SELECT count(*) FROM rows_ x WHERE x.batch_id = n.batch_id) AS "count",
       (SELECT count(*) FROM rows_ x WHERE x.batch_id = n.batch_id) || ' new predictions available' AS message,
       string_agg(comment_id || ':' || p, '|' ORDER BY predicted_at DESC, comment_id DESC) AS recent
FROM newest n GROUP BY n.batch_id
""", "texts"))
def stream_notices(spark, folder):
    path, checkpoint = _folders(spark, "stream-notices")
    predictions = tables.texts(spark, folder).select("comment_id", "text", "labels", "predicted_at")
    arrivals = replay.in_turns(predictions, f"{path}-predictions", _turn("comment_id", 3), 3)
    sinks.finish(pipelines.notify(arrivals, path, checkpoint))
    shown = F.transform("recent_comments", lambda c: F.concat_ws(":", c["comment_id"].cast("string"), c["text"]))
    return sinks.read_batches(spark, path).select(
        "batch_id", "type", "count", "message", F.array_join(shown, "|").alias("recent"))


@query("stream_replay", """
SELECT CAST(c AS INTEGER) AS batch_id, lang AS program_id, count(*) AS "count", CAST(sum(doc_id) AS BIGINT) AS ids
FROM documents, (SELECT unnest([0, 1, 2]) AS c)
WHERE doc_id < (SELECT count(*) FROM documents) AND (c < 2 OR doc_id < (SELECT count(*) // 2 FROM documents)) GROUP BY 1, 2
""")
def stream_replay(spark, folder):
    """Two cycles and a half over all documents, a cycle per batch."""
    path, checkpoint = _folders(spark, "stream-replay")
    rows = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("program_id"), "doc_id")
    count = rows.count()
    ticks = spark.range(2 * count + count // 2).select(
        F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.col("id").alias("value"))
    stream = replay.in_turns(ticks, f"{path}-ticks", F.floor(F.col("value") / F.lit(max(count, 1))), 3)
    cycled = pipelines.cyclic(stream, rows, count)
    sinks.finish(sinks.start(cycled, lambda batch, n: sinks.write_batch(batch, path, n), checkpoint))
    return sinks.read_batches(spark, path).groupBy("batch_id", "program_id").agg(
        F.count("*").alias("count"), F.sum("doc_id").alias("ids"))


@query("stream_late", """
WITH b AS (SELECT CAST(event_id % 4 AS INTEGER) AS batch_id, ts FROM events),
reached AS (
  SELECT batch_id, max(max(ts)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         - INTERVAL 1 HOUR AS watermark FROM b GROUP BY 1)
SELECT batch_id, count(*) AS "rows", max(ts) AS newest, count(*) FILTER (WHERE ts < watermark) AS late
FROM b JOIN reached USING (batch_id) GROUP BY 1
""")
def stream_late(spark, folder):
    """Events in four batches that span the same time, so most are late from the second on."""
    path, checkpoint = _folders(spark, "stream-late")
    events = tables.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"))
    stream = replay.in_turns(events, f"{path}-events", _turn("event_id", 4), 4)
    sinks.finish(pipelines.count_late(stream, 3600, path, checkpoint))
    return sinks.read_batches(spark, path).select(
        "batch_id", "rows", F.col("newest").cast("timestamp_ntz").alias("newest"), "late")


# --- files --------------------------------------------------------------------

@query("json_documents", with_views("""
SELECT text, vi_sentiment AS sentiment, video_id AS entity FROM texts WHERE is_labeled
""", "texts"))
def json_documents(spark, folder):
    """Labeled texts as objects with a ``results`` array, one of about 200 entries
    per file, written and read back."""
    rows = filters.training_projection(tables.texts(spark, folder))
    files = rows.count() // 200 + 1
    packed = rows.groupBy(F.pmod(F.xxhash64("text"), F.lit(files)).alias("file")).agg(
        F.collect_list(F.struct("text", "labels")).alias("results"))
    path = scratch(spark, "json")
    packed.write.partitionBy("file").json(path)
    return readers.json_document(spark, path).select(
        "text", F.col("labels")[0]["sentiment"].alias("sentiment"), F.col("labels")[0]["entity"].alias("entity"))


@query("training_export", with_views("""
SELECT comment_id AS id, text, created_at AS consumed_at, false AS is_used_for_training, vi_sentiment AS sentiment
FROM texts WHERE is_labeled AND program_id <> 'en'
""", "texts"))
def training_export(spark, folder):
    """All unused training rows as JSON lines, read back."""
    path = scratch(spark, "export")
    store.export_training(texts.training_rows(spark, folder), path)
    back = readers.json_lines(
        spark, path, "id bigint, text string, labels array<struct<sentiment:string>>, consumed_at timestamp_ntz, is_used_for_training boolean")
    return back.select("id", "text", "consumed_at", "is_used_for_training", F.col("labels")[0]["sentiment"].alias("sentiment"))


@query("labeling_job", with_views("""
SELECT comment_id AS id, count(*) AS quads, string_agg(phrase || '=' || sentiment, ',' ORDER BY phrase) AS found
FROM quads GROUP BY 1
""", "quads"))
def labeling_job(spark, folder):
    """JSON lines in, labeled JSON lines out, read back."""
    source, out = scratch(spark, "labeling-in"), scratch(spark, "labeling-out")
    readers.write_json(tables.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"), source)
    labeling.run_labeling(spark, source, out)
    back = readers.json_lines(spark, out, schemas._struct(id=schemas.S, labels=schemas.LABELS, error=schemas.S))
    found = F.array_sort(F.transform("labels", lambda q: F.concat(
        q["opinion"], F.lit("="), lab.english_sentiment(q["sentiment"]))))
    return back.filter(F.size("labels") > 0).select(
        F.col("id").cast("long").alias("id"), F.size("labels").cast("long").alias("quads"), F.array_join(found, ",").alias("found"))


@query("store_retention", with_views("""
SELECT program_id, strftime("timestamp", '%Y%m') AS "month", count(*) AS "count" FROM comments
WHERE "timestamp" >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY GROUP BY 1, 2
""", "comments"))
def store_retention(spark, folder):
    """Months beyond the limit are dropped, the month it falls into is rewritten."""
    rows, path = _stored(spark, folder, "store-retention")
    now = rows.agg(F.max("timestamp")).first()[0]
    if now is not None:
        store.apply_retention(spark, path, "comments", 20, now)
    return store.read(spark, path).groupBy("program_id", "month").agg(F.count("*").alias("count"))


# --- model selection ----------------------------------------------------------

@query("best_epochs", f"""
WITH history AS (
  SELECT 'run_' || (user_id % 10) AS run, CAST(event_id % 40 AS INTEGER) AS epoch, {r("avg(value)", 4)} AS f1
  FROM events GROUP BY 1, 2),
marked AS (
  SELECT *, CASE WHEN f1 > coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300)
            THEN epoch END AS own FROM history),
carried AS (SELECT *, max(own) OVER (PARTITION BY run ORDER BY epoch) AS last_best FROM marked),
stops AS (SELECT run, min(epoch) FILTER (WHERE epoch - last_best >= 8) AS stopped_at FROM carried GROUP BY 1),
seen AS (SELECT h.* FROM history h JOIN stops USING (run) WHERE stopped_at IS NULL OR epoch <= stopped_at)
SELECT run, arg_max(epoch, struct_pack(a := f1, b := -epoch)) AS best_epoch, max(f1) AS best_f1, max(epoch) AS last_epoch
FROM seen GROUP BY 1
""")
def best_epochs(spark, folder):
    """Figures of the events as validation scores of ten runs over forty epochs."""
    events = tables.table(spark, folder, "events")
    history = events.groupBy(
        F.concat(F.lit("run_"), F.col("user_id") % 10).alias("run"), (F.col("event_id") % 40).cast("int").alias("epoch")).agg(
        sc.tidy(F.avg("value"), 4).alias("f1"))
    return training.best_epoch(history, patience=8)


@query("deployments", with_views(f"""
WITH losses AS (
  SELECT program_id AS model, {r('''avg(engagement_score) FILTER (WHERE comment_id % 2 = 0)''', 4)} AS loss,
         {r('''avg(engagement_score) FILTER (WHERE comment_id % 2 = 1)''', 4)} AS used
  FROM comments GROUP BY 1),
both_ AS (SELECT model, loss, CASE WHEN model IN ('show_1', 'show_2') THEN 15.0 ELSE used END AS current_loss FROM losses)
SELECT model, loss, CAST(current_loss AS DOUBLE) AS current_loss, CASE WHEN loss < current_loss THEN 'deployed' ELSE 'skipped' END AS decision
FROM both_
""", "comments"))
def deployments(spark, folder):
    """A new model per program against the one in use; two programs have none yet."""
    def losses(half: int) -> DataFrame:
        rows = tables.comments(spark, folder).filter(F.col("comment_id") % 2 == half)
        return rows.groupBy(F.col("program_id").alias("model")).agg(sc.tidy(F.avg("engagement_score"), 4).alias("loss"))
    current = losses(1).filter(~F.col("model").isin("show_1", "show_2"))
    return training.deploy_decisions(losses(0), current)
