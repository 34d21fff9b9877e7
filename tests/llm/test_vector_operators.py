import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import ann, media, q_vectors, quality

SF = "/root/testdata/sf0.01"


def test_media_round_trip_and_features(spark):
    rows = [(1, "x" * 1000), (2, None), (3, ""), (4, "x" * 1000), (5, "é" * 96), (6, "long " * 60_000), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = {r.doc_id: r for r in media.digest_media(media.encode(df)).collect()}
    for i, t in rows:
        payload = media.padded((t or "").encode())
        r = got[i]
        assert len(payload) % 192 == 0 and len(payload) >= 192
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.wav(payload)), hashlib.sha256(media.wav(payload)).hexdigest())
    assert got[1].feature == got[4].feature and got[2].feature == got[3].feature
    assert media.digest_media(media.encode(df.limit(0))).count() == 0


def test_resampling_keeps_a_tone_and_blocks_do_not_show():
    t = np.arange(192 * 3000)
    raw = (np.sin(t * 2 * np.pi * 440 / media.RATE_STORED) * 100 + 128).astype(np.uint8).tobytes()
    y = media.resampled(raw)
    assert len(y) == len(raw) * 2 // 3
    part = y[100_000:108_000]
    peak = np.abs(np.fft.rfft(part * np.hanning(len(part)))).argmax() * media.RATE / len(part)
    assert abs(peak - 440) < 2
    before, media.BLOCK = media.BLOCK, 3 << 10
    try:
        assert np.allclose(media.resampled(raw), y, atol=1e-5)
    finally:
        media.BLOCK = before


def test_hysteresis_and_spans():
    energy = np.array([0, 0, 5, 3, 3, 0, 0, 5, 0], np.float32)
    on = media.active(np.repeat(energy[:, None], media.MELS, 1))
    assert on.tolist() == [False, False, True, True, True, False, False, True, False]
    assert [round(a * media.RATE) for a, _ in media.spans(on)] == [2 * media.HOP, 7 * media.HOP]


def plain_log_mel(payload):
    """Log-mels by zero stuffing, one long convolution and a DFT matrix."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    stuffed = np.zeros(len(x) * media.UP)
    stuffed[:: media.UP] = x
    n = media.TAPS * media.UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / media.DOWN) * np.hamming(n)
    first = n // 2 - media.UP  # the taps before an output's own input
    y = np.convolve(stuffed, h / h.sum() * media.UP)[first :: media.DOWN][: len(x) * media.UP // media.DOWN]
    y = np.pad(y, (0, max(0, media.FRAME - len(y))))
    k = np.arange(media.FRAME)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), k) / media.FRAME)
    frames = [y[i : i + media.FRAME] for i in range(0, len(y) - media.FRAME + 1, media.HOP)]
    return np.array([np.log(np.abs(dft @ (f * np.hanning(media.FRAME))) ** 2 @ media._mel() + 1e-6) for f in frames])


@pytest.mark.parametrize("text", ["", "abc " * 3000, "Some text, with é and others. " * 40])
def test_stored_tensors_equal_a_plain_computation(text):
    payload = media.padded(text.encode())
    table = media.read_tensors(media.stored_tensors(media.tensor_table(payload)))
    tensors = table.column("log_mel")
    assert tensors.type.shape == list(media.SHAPE)
    got = np.concatenate([x.to_numpy_ndarray() for x in tensors.chunks]).reshape(-1, media.MELS)
    want = plain_log_mel(payload)
    assert sum(table.column("frames").to_pylist()) == len(want)
    assert np.abs(got[: len(want)] - want).max() < 0.05 and not got[len(want) :].any()
    rows = table.to_pylist()
    assert [r["begin_s"] for r in rows] == [i * media.SHAPE[0] * media.HOP / media.RATE for i in range(len(rows))]
    assert all(abs(r["end_s"] - r["begin_s"] - ((r["frames"] - 1) * media.HOP + media.FRAME) / media.RATE) < 1e-9 for r in rows)
    feature = dict(x.split("=") for x in media.summary(table).split(";"))
    assert feature["frames"] == str(len(want)) and feature["active"] == str(int(media.active(media.log_mel(media.resampled(payload))).sum()))


def test_collision_counting_verifies_few():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((ann.BLOCK_ROWS, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    index, ids, hits = ann.Index(np.arange(len(vectors)), vectors), range(0, len(vectors), 400), 0
    for i in ids:
        gap = np.sqrt(((vectors - vectors[i]) ** 2).sum(1))
        gap[i] = np.inf
        hits += len(set(np.argsort(gap)[:10].tolist()) & set(index.search(i, vectors[i], 10)[1].tolist()))
    assert hits / len(ids) / 10 >= 0.9
    assert index.verified / len(ids) / len(vectors) < 0.1


def test_recall_against_brute_force(spark):
    rows = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got: dict[int, list] = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), block_rows=700, query_rows=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]])
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 11)) and [f[2] for f in found] == sorted(f[2] for f in found)
        assert np.allclose([f[2] for f in found], [d[ids == f[1]][0] for f in found], atol=1e-12)
        hits, total = hits + len(want & {f[1] for f in found}), total + 10
    assert hits / total >= 0.95


def test_ann_edge_cases(spark):
    one = [0.0] * 3 + [1.0]
    rows = [(0, one), (100, one), (1, one), (2, one), (3, [0.0, 0.0, 1.0, 0.0]), (4, None), (5, [0.0] * 4), (6, [float("nan"), 0.0, 0.0, 1.0]), (7, [None, 1.0, 0.0, 0.0]), (8, [float("inf"), 0.0, 0.0, 0.0]), (9, [1.0, 0.0]), (None, one), (1, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 100 = 0"), k=3).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 0.0)]
    few = sorted(tuple(r)[:3] for r in ann.nearest(df.where("vec_id in (0, 3)"), df.where("vec_id = 0"), k=10).collect())
    assert few == [(0, 1, 3)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0


def test_many_equal_vectors_tie_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(1000, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r.vec_id for r in ann.nearest(df, df.where("vec_id = 0"), k=10).orderBy("rank").collect()]
    assert got == list(range(1, 11))


def test_registered_search_covers_all_queries(spark):
    got = q_vectors.op10_nearest_neighbours(spark, SF)
    assert got.groupBy("query_id").count().where("count = 10").count() == 5


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right / len(rows) >= 0.98
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) / len(bad) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.layers, b.layers, strict=True))


def test_prior_is_found_without_negatives():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.85):
        positive = rng.normal(1, 0.5, (1500, 4))
        hidden = rng.random(1500) < share
        unlabelled = np.where(hidden[:, None], rng.normal(1, 0.5, (1500, 4)), rng.normal(-1, 0.5, (1500, 4)))
        assert abs(quality.estimated_prior(positive, unlabelled) - hidden.mean()) < 0.06


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "text of a null id"), (3, "word " * 50_000), (3, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(df, none)
    got = quality.score_documents(df, model).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    negative = spark.createDataFrame([(3, 0), (3, 0), (None, 1), (99, None)], "doc_id long, quality int")
    assert all(r.score == 0.5 for r in quality.score_documents(df, quality.train(df, negative)).collect())  # negatives are not looked at
    kept = quality.keep_predicted(df, model)
    assert kept.columns == df.columns and kept.count() == 5
    assert quality.score_documents(df.limit(0), model).count() == 0
    with pytest.raises(Exception):  # noqa: B017  a table without texts is an error, not an empty result
        quality.score_documents(df.drop("text"), model).count()
