"""The media query builds its tensors, and every byte and span of a text reaches its feature."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from twinlake.llm import media, queries


def features(spark, tmp_path, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), str(tmp_path / "documents.parquet"))
    return {r.doc_id: r.feature for r in queries.op6_media_columns(spark, str(tmp_path)).collect()}


def test_feature_is_read_from_the_stored_tensors(spark, tmp_path):
    texts = ["abc", "é" * 500, ("~" * 700 + "\x7f\x01" * 400) * 12]
    got = features(spark, tmp_path, texts)
    for i, r in enumerate(media.audio_features(media.store_text(spark.read.parquet(f"{tmp_path}/documents.parquet"))).orderBy("doc_id").collect()):
        assert got[i] == r.feature and got[i].endswith(media.tensor_digest(r.tensors))


def test_spans_after_the_eighth_count():
    mel = np.zeros((400, media.MELS), np.float32)
    spans = np.array([[k * 20, k * 20 + 5] for k in range(12)])
    other = spans.copy()
    other[-1, 1] += 1
    assert media.tensor_digest(media.tensor_table(mel, spans)) != media.tensor_digest(media.tensor_table(mel, other))


def test_the_last_bytes_count(spark, tmp_path):
    for units in (1, 2, 3, 4):
        n = units * media.UNIT
        texts = ["a" * n, *("a" * (n - k) + "\x01" + "a" * (k - 1) for k in (1, 2, 17, 40, 64))]
        got = features(spark, tmp_path, texts)
        assert len(set(got.values())) == len(texts)
        assert len(media.resample(media.padded(np.zeros(n, np.float32)))) % media.HOP == 0
