"""Queries of the packet source. The driver's tables have no connections, so their bytes are made from events first."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremolo.plans.registry import DETECTIONS, detections, query
from tremolo.sources import frames, records
from tremolo.sources.shared import shared_folder
from tremolo.streaming import folds

#: Packets between two breaks of a server's connection, and how many of the last ones are sent again after it.
BREAK, AGAIN = 5000, 100
_NUMBERS = f"{DETECTIONS}, n AS (SELECT station, event_id, us, row_number() OVER (PARTITION BY station ORDER BY event_id) % 16777216 AS sequence FROM e)"
FOUND = f"""WITH {_NUMBERS}, c AS (SELECT *, event_id // {BREAK} AS connection FROM n UNION ALL SELECT *, event_id // {BREAK} + 1 FROM n WHERE event_id % {BREAK} >= {BREAK - AGAIN}),
f AS (SELECT *, 1 AS k, 'data' AS kind, 520 AS size FROM c UNION ALL SELECT *, 0, 'error', 7 FROM c WHERE event_id % 7 = 0 UNION ALL SELECT *, 2, 'info', 520 FROM c WHERE event_id % 11 = 0),
o AS (SELECT *, sum(size) OVER (PARTITION BY station % 8, connection ORDER BY event_id, k) - size AS begins FROM f)
SELECT (station % 8)::VARCHAR AS server, connection, begins::BIGINT AS "offset", kind, CASE kind WHEN 'data' THEN sequence END::INT AS sequence, CASE kind WHEN 'info' THEN event_id % 2 = 0 END AS more FROM o"""


def _connections(spark, sf_dir) -> str:
    """The folder of a log: eight servers, whose connections break again and again; a packet for each event, error lines
    and answers between them."""
    e = detections(spark, sf_dir).withColumn("sequence", F.row_number().over(W.partitionBy("station").orderBy("event_id")) % (1 << 24))
    parts = F.array((F.col("event_id") / (1 << 30)).cast("int"), (F.col("event_id") % (1 << 30)).cast("int")).alias("samples")
    code = F.lpad(F.conv(F.col("station").cast("string"), 10, 36), 5, "0").alias("code")
    r = records.encode_records(e.select("event_id", "station", "sequence", parts, F.col("us").alias("start_us"), F.lit(records.INT32).alias("encoding"), code), ("event_id", "station", "sequence"))
    text = lambda x: F.encode(x, "US-ASCII")
    none = F.lit(b"")
    error = F.when(F.col("event_id") % 7 == 0, text(F.lit("ERROR\r\n"))).otherwise(none)
    info = F.when(F.col("event_id") % 11 == 0, F.concat(text(F.when(F.col("event_id") % 2 == 0, F.lit("SLINFO *")).otherwise(F.lit("SLINFO  "))), "record")).otherwise(none)
    r = r.withColumn("bytes", F.concat(error, text(F.format_string("SL%06X", F.col("sequence").cast("int"))), F.col("record"), info))
    first = F.floor(F.col("event_id") / BREAK).cast("long")
    sent = r.withColumn("connection", F.explode(F.when(F.col("event_id") % BREAK >= BREAK - AGAIN, F.array(first, first + 1)).otherwise(F.array(first))))
    path = f"{shared_folder(spark)}/connections-{uuid.uuid4().hex}"
    frames.write_log(sent.select((F.col("station") % 8).cast("string").alias("server"), "connection", "event_id", "bytes"), ["event_id"], path).agg(F.sum("length")).collect()
    return path


def _received(spark, sf_dir):
    """Frames of two runs of a stream, the second of which goes on from the progress of the first: at bytes that lie
    within frames."""
    log, path = _connections(spark, sf_dir), f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    for until in (100_003, 1 << 62):
        out = folds.drained(frames.frames(frames.byte_stream(spark, log, until=until)), spark, "frames", path=path)
    return out


@query("stream_frames", FOUND)
def stream_frames(spark, sf_dir):
    """Frames of a live packet stream with the bytes they begin at, over a restart from its checkpoint."""
    return _received(spark, sf_dir).select("server", "connection", "offset", "kind", "sequence", "more")


@query("delivered_records", f"WITH {_NUMBERS} SELECT station, sequence::INT AS sequence, event_id, us FROM n")
def delivered_records(spark, sf_dir):
    """Records of the packet stream, each once though connections begin with what was sent before."""
    r = frames.delivered(_received(spark, sf_dir))
    number = F.col("samples")[0].cast("long") * (1 << 30) + F.col("samples")[1]
    return r.select(F.conv("station", 36, 10).cast("long").alias("station"), "sequence", number.alias("event_id"), F.col("start_us").alias("us"))


@query("resume_commands", f"WITH {_NUMBERS}, l AS (SELECT station, arg_max(sequence, event_id) AS last FROM n GROUP BY station) SELECT station, printf('DATA %06X', (last + 1) % 16777216) AS data_line FROM l")
def resume_commands(spark, sf_dir):
    """The command with which every station goes on after a broken connection."""
    r = frames.resume_commands(frames.delivered(_received(spark, sf_dir), values=()))
    return r.select(F.conv("station", 36, 10).cast("long").alias("station"), "data_line")
