"""Named queries over the test tables, each with SQL for the same rows.

The tables hold no frames, so vectors stand for cell means, events for a sequence of frames, and
the UTF-8 bytes of documents for pixels.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Geometry
from ..functions import pixels
from ..functions.bits import array_sad, as_hex, average_hash, luma, quantised
from ..operators import dedup, hamming_index, search, sequence, stats
from ..session import shared_dir
from ..sources import database, flat, frames, listing
from ..streaming import dedup as streamed

QUERY, TOPK = 7, 50
CHUNK, THRESHOLD = 1200, 20.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Vectors ---------------------------------------------------------------------------------------


def quantized_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = quantised(F.col("embedding"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(cells.cast("array<string>"), ",").alias("cells"))


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = quantised(F.col("embedding"))
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", cells.alias("payload"), average_hash(cells).alias("hash"))


def ahash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir).select(F.col("idx").alias("vec_id"), as_hex(F.col("hash")).alias("hash"))


def _query(spark: SparkSession, sf_dir: str) -> tuple[int, list[int]] | None:
    """Signature and cells of the query vector, as constants for the plan; None if the table lacks it."""
    row = _signed(spark, sf_dir).where(F.col("idx") == QUERY).first()
    return (row["hash"], row["payload"]) if row else None


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their distance to the query vector; none without one."""
    query = _query(spark, sf_dir)
    near = search.distances(_signed(spark, sf_dir), query[0] if query else 0)
    return near if query else near.where("false")


def hamming_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select(F.col("idx").alias("vec_id"), "dist")


def hamming_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.histogram(_near(spark, sf_dir))


def hamming_histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.histogram(_near(spark, sf_dir), dense=True)


def hamming_histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(search.histogram(_near(spark, sf_dir)), TOPK)


def topk_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cutoff(search.histogram(_near(spark, sf_dir)), TOPK)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.candidates(_near(spark, sf_dir), TOPK)


def collect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select(F.col("idx").alias("vec_id"), "dist")


def within_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors up to the cutoff, ties with the last candidate too."""
    near = _near(spark, sf_dir)
    limit = search.cutoff(search.histogram(near), TOPK).first()["cutoff"]
    return search.within(near, limit).select(F.col("idx").alias("vec_id"), "dist")


def candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten candidates with what is known of them."""
    return search.candidates(_near(spark, sf_dir), 10).select(F.col("idx").alias("vec_id"), "dist", "label")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = _query(spark, sf_dir)
    cells = F.array(*map(F.lit, query[1] if query else [0]))
    return search.rerank(_candidates(spark, sf_dir), array_sad(F.col("payload"), cells))


def sad_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select(F.col("idx").alias("vec_id"), "dist", "sad")


def search_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best(_ranked(spark, sf_dir)).withColumnRenamed("idx", "vec_id")


def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, searched among all others."""
    table = _signed(spark, sf_dir)
    asked = table.where("idx % 50 = 0").select(F.col("idx").alias("q_idx"), F.col("hash").alias("q_hash"), F.col("payload").alias("q_payload"))
    return search.search_many(table, asked, TOPK, array_sad(F.col("payload"), F.col("q_payload"))).select("q_idx", F.col("idx").alias("vec_id"), "dist", "sad")


def search_many_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by substring tables."""
    table = _signed(spark, sf_dir)
    asked = table.where("idx % 50 = 0").select(F.col("idx").alias("q_idx"), F.col("hash").alias("q_hash"), F.col("payload").alias("q_payload"))
    return hamming_index.search_many(table, asked, TOPK, array_sad(F.col("payload"), F.col("q_payload"))).select("q_idx", F.col("idx").alias("vec_id"), "dist", "sad")


def _packed(cells: Column) -> Column:
    """Cells of 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(cells, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as frames of a database, which is checked, searched by signatures, and opened where the candidates' pixels are."""
    to = f"{shared_dir(spark)}/database-{uuid.uuid4().hex}"
    rows = sequence.positions(_signed(spark, sf_dir), ["idx"])
    database.store(spark, to, rows.select(F.col("seq").alias("idx"), F.col("idx").cast("int").alias("video_id"), F.lit(0).alias("frame_id"), "hash", _packed(F.col("payload")).alias("content")))
    database.validate(spark, to, 64)
    query = _query(spark, sf_dir)
    top = search.candidates(search.distances(database.signatures(spark, to), query[0] if query else 0), TOPK if query else 0).collect()
    near = spark.createDataFrame(top, "idx long, video_id int, frame_id int, hash long, dist int").select("idx", F.col("video_id").cast("long").alias("vec_id"), "dist")
    pixel = database.payload(spark, to, [r["idx"] for r in top]).select("idx", "content")
    return search.rerank(pixel.join(F.broadcast(near), "idx"), pixels.byte_sad(F.col("content"), bytes(query[1] if query else []))).select("vec_id", "dist", "sad")


# Events ----------------------------------------------------------------------------------------


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of time and id, in chunks."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return sequence.chunked(sequence.positions(events, ["ts", "event_id"]), CHUNK)


def _flagged(spark: SparkSession, sf_dir: str, reset: str | None = None, how=dedup.temporal_dedup) -> DataFrame:
    return how(_sequence(spark, sf_dir), "value", THRESHOLD, lambda a, b: F.abs(a - b), reset=reset)


def temporal_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("event_id", "seq", "keep")


def temporal_dedup_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir, "event_type").select("event_id", "seq", "keep")


def temporal_dedup_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir, "event_type", dedup.temporal_dedup_joined).select("event_id", "seq", "keep")


def temporal_dedup_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream of files, one a micro-batch, whose rows come in no order."""
    to = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = _sequence(spark, sf_dir).select("event_id", "seq", "chunk_id", "value", "event_type")
    rows.repartition(4, F.xxhash64("event_id")).write.parquet(f"{to}/in")
    arrived = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{to}/in")
    out = streamed.temporal_dedup(arrived, "value", THRESHOLD, lambda a, b: abs(a - b), CHUNK, reset="event_type")
    query = out.select("event_id", "seq", "keep").writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("event_id long, seq long, keep boolean").parquet(f"{to}/out")


def dedup_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.compact(_flagged(spark, sf_dir, "event_type")).select("idx", "event_id")


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.build_stats(_flagged(spark, sf_dir))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chunk_stats(_flagged(spark, sf_dir), "event_type")


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as videos, their events as frames."""
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return sequence.number(events, "event_type", ["ts", "event_id"], CHUNK).select("event_id", "video_id", "frame_id", "seq", "chunk_id")


# Bytes of documents ----------------------------------------------------------------------------


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def luma_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The luma of all pixels (three bytes each) of a whole text, summed."""

    @F.pandas_udf("n_pixels long, luma long")
    def lumas(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for c in contents:
            a = np.frombuffer(c, np.uint8)[: len(c) // 3 * 3].reshape(-1, 3).astype(np.int64)
            rows.append((len(a), int((a @ np.array([77, 150, 29]) >> 8).sum())))
        return pd.DataFrame(rows, columns=["n_pixels", "luma"])

    return _bytes(spark, sf_dir).withColumn("f", lumas("content")).select("doc_id", "f.n_pixels", "f.luma")


def luma_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma of three cells of each vector, by column expressions alone."""
    return _signed(spark, sf_dir).select(F.col("idx").alias("vec_id"), luma(F.col("payload")[0], F.col("payload")[1], F.col("payload")[2]).alias("luma"))


def _plane(content: bytes, height: int) -> np.ndarray | None:
    """The luma of a text's bytes as grey pixels in so many rows; None if they are under 8 columns."""
    width = len(content) // height
    return pixels.luma_plane(content[: width * height], Geometry(width, height, 1)) if width >= 8 else None


def grid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the 576 samples of whole texts as grey frames of 18 rows; null for texts too short."""

    @F.pandas_udf("long")
    def total(contents: pd.Series) -> pd.Series:
        planes = [_plane(c, 18) for c in contents]
        return pd.Series([None if p is None else int(pixels.samples(p).sum(dtype=np.int64)) for p in planes], dtype="Int64")

    return _bytes(spark, sf_dir).withColumn("total", total("content")).where("total is not null").select("doc_id", F.col("total").alias("samples"))


def cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell means of whole texts as grey frames of 20 rows, with both ways to treat the edges."""

    @F.pandas_udf("a string, b string")
    def means(contents: pd.Series) -> pd.DataFrame:
        planes = [_plane(c, 20) for c in contents]
        text = lambda p, e: None if p is None else ",".join(map(str, pixels.cell_means(p, e)))
        return pd.DataFrame({"a": [text(p, "truncate") for p in planes], "b": [text(p, "absorb") for p in planes]}, dtype=object)

    return _bytes(spark, sf_dir).withColumn("f", means("content")).where("f.a is not null").select("doc_id", F.col("f.a").alias("truncated"), F.col("f.b").alias("absorbed"))


def document_sad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAD of all bytes of each text to document 0, the shorter one filled up with zeros."""
    rows = _bytes(spark, sf_dir)
    query = rows.where("doc_id = 0").first()
    sad = rows.select("doc_id", pixels.byte_sad(F.col("content"), bytes(query["content"]) if query else b"").alias("sad"))
    return sad if query else sad.where("false")


#: Bytes of a frame that a text is cut into.
PIECE = 256


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as frames of PIECE bytes, the last one filled up with zeros: idx, video_id (the document), frame_id (the piece), hash (the text's bytes), content."""
    whole = _bytes(spark, sf_dir).withColumn("n", F.octet_length("content"))
    rows = whole.where("n > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {PIECE} as int)"))))
    rows = rows.select("doc_id", "piece", F.col("n").cast("long").alias("hash"), F.expr(f"rpad(substring(content, {PIECE} * piece + 1, {PIECE}), {PIECE}, x'00')").alias("content"))
    placed = sequence.positions(rows, ["doc_id", "piece"], "idx")
    return placed.select("idx", F.col("doc_id").cast("int").alias("video_id"), F.col("piece").alias("frame_id"), "hash", "content")


def flat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as frames, written as flat files and read back."""
    to = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    flat.write_flat(_pieces(spark, sf_dir), to, PIECE)
    return flat.read_flat(spark, to, PIECE).select("idx", "video_id", "frame_id", "hash", F.md5("content").alias("digest"))


def listed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as files of a tree, many names with a dot or an underscore in front, listed, numbered and read back."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("source", F.lit(""))).alias("source"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    video = F.expr("concat(if(doc_id % 2 = 0, '', '.'), source)")
    file = F.expr("concat(element_at(array('', '.', '_'), cast(doc_id % 3 + 1 as int)), lpad(cast(doc_id as string), 12, '0'))")
    listing.put(docs.select(video.alias("video"), file.alias("file"), "content"), root)
    contents = frames.scan(spark, root).select("path", F.md5("content").alias("digest"))
    named = frames.manifest(spark, root, CHUNK).join(contents, "path")
    return named.select("video", F.element_at(F.split("path", "/"), -1).alias("file"), "video_id", "frame_id", "seq", "chunk_id", "length", "digest")


def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as frames of a database in three commits: a third of the rows, then twice what follows, the first time with other signatures."""
    to, rows = f"{shared_dir(spark)}/database-{uuid.uuid4().hex}", _pieces(spark, sf_dir)
    third = rows.count() // 3
    database.store(spark, to, rows.where(F.col("idx") < third))
    database.store(spark, to, rows.where(F.col("idx") >= third).withColumn("hash", -F.col("hash")), third)
    database.store(spark, to, rows.where(F.col("idx") >= third), third)
    database.validate(spark, to)
    return database.frames(spark, to).select("idx", "video_id", "frame_id", "hash", F.md5("content").alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quantized_cells, ahash64, hamming_distance, hamming_histogram, hamming_histogram_dense, hamming_histogram_cumulative, topk_cutoff, collect_candidates, within_cutoff, candidate_report,
        sad_rerank, search_best, search_many, search_many_indexed, stored_search, temporal_dedup, temporal_dedup_reset, temporal_dedup_joined, temporal_dedup_streamed, dedup_compaction, build_stats, chunk_stats, sequence_ids,
        luma_project, luma_of_vectors, grid_sample, cell_means, document_sad, flat_round_trip, stored_snapshots, listed_frames,
    )
}

_CELLS = """
c AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 127.5), 0), 255)::INT) AS cells FROM embeddings),
m AS (SELECT *, list_sum(cells)::BIGINT // 64 AS mean FROM c),
h AS (SELECT vec_id, label, cells, list_reduce(list_prepend(0::UBIGINT, list_transform(range(0, 64), lambda k: CASE WHEN cells[k + 1] > mean THEN 1::UBIGINT << k::UBIGINT ELSE 0::UBIGINT END)), lambda a, b: a | b) AS hash FROM m)"""
_NEAR = f"""{_CELLS},
q AS (SELECT hash AS q_hash, cells AS q_cells FROM h WHERE vec_id = {QUERY}),
d AS (SELECT vec_id, label, cells, bit_count(xor(hash, q_hash))::INT AS dist, q_cells FROM h, q)"""
_HIST = f"{_NEAR}, b AS (SELECT dist, count(*) AS n FROM d GROUP BY dist), s AS (SELECT dist, n, sum(n) OVER (ORDER BY dist)::BIGINT AS cum FROM b)"
_TOP = f"{_NEAR}, t AS (SELECT * FROM d ORDER BY dist, vec_id LIMIT {TOPK})"
_RANK = f"{_TOP}, r AS (SELECT vec_id, dist, list_sum(list_transform(range(1, 65), lambda i: abs(cells[i] - q_cells[i])))::BIGINT AS sad FROM t)"
_SEQ = f"""
e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events),
k AS (SELECT *, seq // {CHUNK} AS chunk_id FROM e),
l AS (SELECT *, lag(value) OVER w AS v0, lag(event_type) OVER w AS t0, row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY chunk_id ORDER BY seq)),
f AS (SELECT *, rn = 1 OR abs(value - v0) > {THRESHOLD} AS keep, rn = 1 OR abs(value - v0) > {THRESHOLD} OR event_type <> t0 AS keep_reset FROM l)"""
_BYTES = "x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), y AS (SELECT doc_id, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::INT) AS p FROM x)"


def _cell_sql(last: bool) -> str:
    """Cell means of a text's bytes in 20 rows; last: the last cells take the remainder."""
    end = "CASE WHEN {k} = 7 THEN {side} ELSE ({k} + 1) * ({side} // 8) END" if last else "({k} + 1) * ({side} // 8)"
    rows, cols = end.format(k="i", side="20"), end.format(k="j", side="w")
    return f"""SELECT doc_id, string_agg(mean::VARCHAR, ',' ORDER BY i, j) AS cells FROM (
      SELECT doc_id, i, j, list_sum(flatten(list_transform(range(i * 2, {rows}), lambda r: p[r * w + j * (w // 8) + 1 : r * w + {cols}])))::BIGINT
        // (({rows} - i * 2) * ({cols} - j * (w // 8))) AS mean
      FROM g, (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 8)) AS j)) GROUP BY doc_id"""


ORACLE_SQL: dict[str, str] = {
    "quantized_cells": f"WITH {_CELLS} SELECT vec_id, array_to_string(cells, ',') AS cells FROM c",
    "ahash64": f"WITH {_CELLS} SELECT vec_id, lpad(lower(hex(hash)), 16, '0') AS hash FROM h",
    "hamming_distance": f"WITH {_NEAR} SELECT vec_id, dist FROM d",
    "hamming_histogram": f"WITH {_HIST} SELECT dist, n FROM b",
    "hamming_histogram_dense": f"WITH {_HIST} SELECT i::INT AS dist, coalesce(n, 0) AS n FROM range(0, 65) r(i) LEFT JOIN b ON dist = i",
    "hamming_histogram_cumulative": f"WITH {_HIST} SELECT dist, n, cum FROM s WHERE cum - n < {TOPK}",
    "topk_cutoff": f"WITH {_HIST} SELECT coalesce(min(dist) FILTER (WHERE cum >= {TOPK}), 64)::INT AS cutoff FROM s",
    "collect_candidates": f"WITH {_TOP} SELECT vec_id, dist FROM t",
    "within_cutoff": f"WITH {_HIST} SELECT vec_id, dist FROM d WHERE dist <= (SELECT coalesce(min(dist) FILTER (WHERE cum >= {TOPK}), 64) FROM s)",
    "candidate_report": f"WITH {_NEAR} SELECT vec_id, dist, label FROM d ORDER BY dist, vec_id LIMIT 10",
    "sad_rerank": f"WITH {_RANK} SELECT vec_id, dist, sad FROM r",
    "search_best": f"WITH {_RANK} SELECT true AS found, vec_id, dist, sad, sad::FLOAT AS score FROM r ORDER BY sad, dist, vec_id LIMIT 1",
    "search_many": f"""WITH {_CELLS},
p AS (SELECT a.vec_id AS q_idx, b.vec_id, a.cells AS q_cells, b.cells, bit_count(xor(a.hash, b.hash))::INT AS dist FROM h a, h b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q_idx ORDER BY dist, vec_id) <= {TOPK}),
r AS (SELECT q_idx, vec_id, dist, list_sum(list_transform(range(1, 65), lambda i: abs(cells[i] - q_cells[i])))::BIGINT AS sad FROM t)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY q_idx ORDER BY sad, dist, vec_id) = 1""",
    "temporal_dedup": f"WITH {_SEQ} SELECT event_id, seq, keep FROM f",
    "temporal_dedup_reset": f"WITH {_SEQ} SELECT event_id, seq, keep_reset AS keep FROM f",
    "temporal_dedup_joined": f"WITH {_SEQ} SELECT event_id, seq, keep_reset AS keep FROM f",
    "dedup_compaction": f"WITH {_SEQ} SELECT row_number() OVER (ORDER BY seq) - 1 AS idx, event_id FROM f WHERE keep_reset",
    "build_stats": f"WITH {_SEQ} SELECT count(*) AS frames_total, count(*) FILTER (WHERE keep) AS frames_after_dedup, count(*) FILTER (WHERE keep) AS signatures_written FROM f",
    "chunk_stats": f"WITH {_SEQ} SELECT chunk_id, count(*) AS frames, count(*) FILTER (WHERE keep) AS kept, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS videos FROM f GROUP BY chunk_id",
    "sequence_ids": f"""WITH o AS (SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS video_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::INT AS frame_id,
row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS seq FROM events) SELECT *, seq // {CHUNK} AS chunk_id FROM o""",
    "luma_project": f"WITH {_BYTES} SELECT doc_id, len(p) // 3 AS n_pixels, coalesce(list_sum(list_transform(range(0, len(p) // 3), lambda i: (77 * p[3 * i + 1] + 150 * p[3 * i + 2] + 29 * p[3 * i + 3]) // 256)), 0)::BIGINT AS luma FROM y",
    "luma_of_vectors": f"WITH {_CELLS} SELECT vec_id, ((77 * cells[1] + 150 * cells[2] + 29 * cells[3]) // 256)::INT AS luma FROM c",
    "grid_sample": f"""WITH {_BYTES}, g AS (SELECT doc_id, p, len(p) // 18 AS w FROM y WHERE len(p) // 18 >= 8)
SELECT doc_id, list_sum(list_transform(range(0, 576), lambda s: p[(s // 32) * w + (s % 32) * w // 32 + 1]))::BIGINT AS samples FROM g""",
    "cell_means": f"""WITH {_BYTES}, g AS (SELECT doc_id, p, len(p) // 20 AS w FROM y WHERE len(p) // 20 >= 8)
SELECT doc_id, a.cells AS truncated, b.cells AS absorbed FROM ({_cell_sql(False)}) a JOIN ({_cell_sql(True)}) b USING (doc_id)""",
    "document_sad": f"""WITH {_BYTES}, q AS (SELECT p AS q FROM y WHERE doc_id = 0)
SELECT doc_id, coalesce(list_sum(list_transform(range(1, greatest(len(p), len(q)) + 1), lambda i: abs(coalesce(p[i], 0) - coalesce(q[i], 0)))), 0)::BIGINT AS sad FROM y, q""",
}
_PIECES = f"""WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, length(x) // 2 AS n, x, unnest(range(0, (length(x) // 2 + {PIECE - 1}) // {PIECE})) AS piece FROM x)
SELECT row_number() OVER (ORDER BY doc_id, piece) - 1 AS idx, doc_id::INT AS video_id, piece::INT AS frame_id, n::BIGINT AS hash, md5(unhex(rpad(substr(x, piece * {2 * PIECE} + 1, {2 * PIECE}), {2 * PIECE}, '0'))) AS digest FROM p"""
_TREE = f"""WITH x AS (SELECT (CASE doc_id % 2 WHEN 0 THEN '' ELSE '.' END) || md5(coalesce(source, '')) AS video, (CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.' ELSE '_' END) || lpad(doc_id::VARCHAR, 12, '0') AS file, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT video, file, b, (dense_rank() OVER (ORDER BY video) - 1)::INT AS video_id, (row_number() OVER (PARTITION BY video ORDER BY file) - 1)::INT AS frame_id, row_number() OVER (ORDER BY video, file) - 1 AS seq FROM x)
SELECT video, file, video_id, frame_id, seq, seq // {CHUNK} AS chunk_id, octet_length(b)::BIGINT AS length, md5(b) AS digest FROM n"""
ORACLE_SQL |= {"temporal_dedup_streamed": ORACLE_SQL["temporal_dedup_reset"], "search_many_indexed": ORACLE_SQL["search_many"], "stored_search": ORACLE_SQL["sad_rerank"], "flat_round_trip": _PIECES, "stored_snapshots": _PIECES, "listed_frames": _TREE}
