"""Empty tables, clashing and odd column names, nulls, ties, repeated rows and long texts, for every operator and stage."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from twinlake.llm import chat, embedding_dedup, media, mixing, ngram_join, packing, secrets, substring_dedup, suffix_dedup, toxicity

pytest.importorskip("corpus_pipeline")

#: Names that operators use inside or in their results.
NAMES = ["spans", "size", "target", "taken", "part", "score", "predicted", "source_size", "kept", "row", "rid", "h", "key", "cell", "a.b", "c`d", "new_text", "start", "end", "class", "id", "dest", "tie"]
BASE = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
KEY = "Zz9kQ4wXv7Lp2Rt8MnB5cD1e"


def odd(spark, rows):
    """Documents (id, text) with columns of clashing and dotted names and of a map type."""
    base = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(rows)], BASE)
    more = [F.concat(F.lit(f"{n}:"), F.coalesce("text", F.lit("-")).substr(1, 3)).alias(n) for n in NAMES]
    return base.select("*", *more, F.create_map(F.lit("k"), "doc_id").alias("m"))


ROWS = [(1, "one two three"), (2, None), (3, ""), (4, f"pass {KEY} word"), (5, LONG), (5, "same id"), (None, "no id"), (None, "no id"), (None, None), (9, "one two three"), (9, "one two three")]


def plain(df):
    return Counter(tuple(str(v) for v in r) for r in df.collect())


def test_stages_keep_other_columns(spark):
    docs = odd(spark, ROWS)
    model = toxicity.train([], np.empty(0, bool))
    assert plain(toxicity.scored_rows(docs, model).select("row.*")) == plain(docs)
    named = toxicity.score_toxicity(docs, model)
    assert named.columns == [{"score": "score_input", "predicted": "predicted_input"}.get(c, c) for c in docs.columns] + ["score", "predicted"]
    first = ngram_join.keep_one(docs.where("doc_id is not null and not (doc_id in (5, 9) and text not like '%w1x1%')"))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {1, 2, 3, 4, 5}
    masked = secrets.mask_live(docs)
    assert masked.columns == docs.columns
    changed = [r for r in masked.collect() if r.doc_id == 4][0]
    assert changed.text == "pass [secret] word" and changed.n_chars == 18 and changed["a.b"] == "a.b:pas" and changed.m == {"k": 4}
    assert plain(masked.where("doc_id is distinct from 4")) == plain(docs.where("doc_id is distinct from 4"))
    found = secrets.scan_secrets(docs, keep=docs.columns)
    assert found.columns == [{"spans": "spans_input"}.get(c, c) for c in docs.columns] + ["spans"] and found.count() == len(ROWS)
    mixed = mixing.repeat_texts(docs)
    counts = mixing.mix_sources(docs, keep=["size", "m", "part"])
    assert counts.columns == ["doc_id", "size", "source_size", "target", "taken", "size_input", "m", "part"] and counts.count() == len(ROWS)
    assert mixed.columns == docs.columns and sum(len(brute.words(r.text)) for r in mixed.collect()) == sum(r.taken for r in counts.collect())
    assert {r.part for r in mixed.collect()} <= {r.part for r in docs.collect()}


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers

    none = odd(spark, [])
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (
        ngram_join.jaccard_groups(none), ngram_join.keep_one(none), embedding_dedup.near_duplicates(vectors), chat.collapse_snapshots(turns), substring_dedup.drop_repeats(none), secrets.scan_secrets(none),
        secrets.mask_live(none), media.audio_features(media.store_text(none)), packing.pack_documents(none, tokenizer=path), mixing.mix_sources(none), mixing.repeat_texts(none), suffix_dedup.drop_long_matches(none),
    ):
        assert df.collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = odd(spark, ROWS)
    for docs, marks in ((none, labels), (some, labels), (none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")), (some, spark.createDataFrame([(i, 1, 1) for i in range(10)], "doc_id long, quality int, toxic int"))):
        model = toxicity.fit_toxicity(docs, marks)
        assert {r.predicted for r in toxicity.score_toxicity(docs, model).collect()} <= {0}
    for name, texts in (("nothing", []), ("something", ROWS)):
        sf = tmp_path / name
        sf.mkdir()
        odd(spark, texts).coalesce(1).write.parquet(str(sf / "documents.parquet"))
        pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}), str(sf / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(sf)).collect()
        assert (len(out) > 0) == (name == "something")


def test_repeated_and_null_ids(spark):
    rows = [(4, "t " * 80), (4, "t " * 80), (None, "u " * 80), (None, "u " * 80), (None, None), (7, "t " * 80)]
    docs = odd(spark, rows)
    out = suffix_dedup.drop_long_matches(docs).collect()
    # Periodic texts repeat themselves from the second window of two words on.
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in out) == sorted([("4", 160, 158), ("4", 160, 160), ("None", 160, 158), ("None", 160, 160), ("None", 0, 0), ("7", 160, 160)])
    mixed = [tuple(r) for r in mixing.mix_sources(docs).collect()]
    assert len(mixed) == 6 and Counter(map(str, mixed)) == Counter(str(tuple(r)) for r in mixing.mix_sources(docs).collect())
    stored = media.audio_features(media.store_text(docs)).collect()
    assert Counter(str(r.doc_id) for r in stored) == Counter(str(i) for i, _ in rows) and len({r.media_sha256 for r in stored}) == 3
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, 0.01], "x"), (None, [1.0, 0.0], "x"), (3, [0.0, 1.0], "x")], "vec_id long, embedding array<double>, centre string")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_duplicates(vectors).collect())
    assert got == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("3", 0, "3", True), ("None", 0, "None", True)]


def test_packing_of_odd_ids(spark):
    import public_tokenizers

    rows = packing.pack_documents(odd(spark, ROWS), tokenizer=public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter(str(r.doc_id) for r in rows if r.start == 0) == Counter(str(i) for i, _ in ROWS)


def test_ids_are_those_of_the_tokenizer(spark):
    """All documents of sf0.01, by the plain tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encode(r.text or "").tolist() == tokenizer.encode(r.text or "", add_special_tokens=False).ids


def test_long_texts(spark):
    docs = odd(spark, [(1, LONG), (2, LONG), (3, "start " + LONG)])
    words = brute.words(LONG)
    assert {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.drop_repeats(docs).collect()} == {(1, 60_000, 0), (2, 60_000, 60_000), (3, 60_001, 60_000)}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()} == {(1, 59_996, 1), (2, 59_996, 1), (3, 59_997, 1)}
    assert {r.size for r in mixing.mix_sources(docs).collect()} == {len(words), len(words) + 1}
    spans = secrets.digest(secrets.scan_secrets(odd(spark, [(1, f"token={KEY} deadbeef0123456789abcdef01234567 " * 3000)]))).collect()[0]
    assert (spans.n_assign, spans.n_hex) == (3000, 3000) and spans.spans.startswith("assign:0:30,hex:31:63,assign:64:94")
    turns = spark.createDataFrame([(1, 0, "user", LONG), (2, 0, "user", LONG), (2, 1, "user", "b"), (None, 0, "user", "z"), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in chat.collapse_snapshots(turns).collect()} == {(2, 2, 1), (None, 1, 2)}


def test_chat_of_odd_tables(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 1), (1, 0, "user", "a", 2), (2, 0, None, "a", 3), (3, None, "user", None, 4), (None, None, None, None, 5), (None, 1, "user", "new", 6)], "conv_id long, turn long, role string, text string, k int")
    got = {(r.conv_id, r.n_turns, r.n_copies, r.text) for r in chat.collapse_snapshots(turns).collect()}
    line = lambda t: f"<|user|>\n{t}<|end|>\n"
    assert got == {(1, 2, 1, line("a") * 2), (3, 1, 2, line("")), (None, 1, 1, line("new"))}


def test_secret_owners(spark):
    rows = [(1, f"x {KEY}", None), (2, f"y {KEY}", None), (3, "token: aB3dE5gH7jK9mN1p", "a"), (4, "token: aB3dE5gH7jK9mN1p", "b"), (5, "token: aB3dE5gH7jK9mN1p", "c")]
    docs = spark.createDataFrame([(i, t, s, None, 1) for i, t, s in rows], "doc_id long, text string, source string, lang string, owner int")
    got = {r.doc_id: [x["class"] for x in r.spans] for r in secrets.scan_secrets(docs).collect()}
    assert got == {1: ["live"], 2: ["live"], 3: ["example"], 4: ["example"], 5: ["example"]}


def test_kernel_against_a_plain_one():
    """Window values against sums over all gapped subsequences, and the kernel of two strings against its definition."""
    from itertools import combinations

    def weighted(s):
        out = Counter()
        for at in combinations(range(len(s)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN and all(s[i].isascii() and s[i].isalpha() for i in at):
                out["".join(s[i].lower() for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def number(w):
        return sum((ord(c) - 96) * toxicity.LETTERS ** (toxicity.ORDER - 1 - i) for i, c in enumerate(w))

    for text in ("abcdef", "a-b1cde f", "zzzzzz", "Abc d"):
        want = {number(k): v for k, v in weighted(text).items()}
        norm = sum(v * v for v in want.values()) ** 0.5
        got = toxicity.feature_map(text)
        assert got == pytest.approx({k: v / norm for k, v in want.items()})
    r = np.random.default_rng(3)
    weights = r.standard_normal(toxicity.LETTERS**toxicity.ORDER).astype(np.float32)
    weights[[i for i in range(len(weights)) if any(i // toxicity.LETTERS**k % toxicity.LETTERS == 0 for k in range(toxicity.ORDER))]] = 0
    text = "some -te xt"
    raw = np.frombuffer(text.encode(), np.uint8)
    symbols, _ = toxicity.padded(raw, np.array([0, len(raw)]))
    line = " " * toxicity.WINDOW + text + " " * toxicity.SPAN
    starts = [0.0] * len(line)
    for i in range(len(line) - toxicity.SPAN + 1):
        for more in combinations(range(1, toxicity.SPAN), toxicity.ORDER - 1):
            w = line[i] + "".join(line[i + j] for j in more)
            if w.isalpha():
                starts[i] += weights[number(w)] * toxicity.DECAY ** (more[-1] + 1)
    got = toxicity.window_scores(symbols, weights)
    want = [sum(starts[i : i + toxicity.WINDOW]) for i in range(len(got))]
    assert got == pytest.approx(want, abs=1e-3)


def test_features_against_plain_ones():
    """Filterbank, energy and segments against loops over frames and samples."""
    r = np.random.default_rng(8)
    y = (r.standard_normal(media.FRAME + 30 * media.HOP) * np.repeat(r.random(media.FRAME + 30 * media.HOP) > 0.4, 1)).astype(np.float32)
    y[1000:1800] *= 8
    mel, power = media.log_mel(y)
    n = (len(y) - media.FRAME) // media.HOP + 1
    assert mel.shape == (n, media.MELS)
    for k in range(n):
        frame = [float(y[k * media.HOP + i]) * (0.5 - 0.5 * np.cos(2 * np.pi * i / (media.FRAME - 1))) for i in range(media.FRAME)]
        energy = [abs(sum(v * np.exp(-2j * np.pi * f * i / media.FRAME) for i, v in enumerate(frame))) ** 2 for f in range(0, media.FRAME // 2 + 1, 1)] if k in (0, 11, n - 1) else None
        if energy:
            want = [np.log(sum(e * float(media.BANK[f, m]) for f, e in enumerate(energy)) + 1e-6) for m in range(media.MELS)]
            assert mel[k] == pytest.approx(want, abs=2e-3)
        assert power[k] == pytest.approx(10 * np.log10(sum(v * v for v in frame) / media.FRAME + 1e-9), abs=1e-3)
    level, on, want, begin = power - power.mean(), False, [], 0
    for k, v in enumerate([*level.tolist(), -99.0]):
        if not on and v >= 1.0:
            on, begin = True, k
        elif on and v < -1.0:
            want.append([begin, k])
            on = False
    assert media.segments(power).tolist() == want
    x = r.standard_normal(400).astype(np.float32)
    taps = media.UP * media.TAPS
    h = [np.sinc((i - (taps - 1) / 2) / max(media.UP, media.DOWN)) * (0.54 - 0.46 * np.cos(2 * np.pi * i / (taps - 1))) for i in range(taps)]
    scale = media.UP / sum(h)
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    full = [sum(scale * h[j] * up[m * media.DOWN - j] for j in range(taps) if 0 <= m * media.DOWN - j < len(up)) for m in range(len(x) // media.DOWN * media.UP)]
    assert media.resample(x) == pytest.approx(full, abs=1e-4)


def test_embedding_recall_over_many_leaves(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((2500, 48))
    x[800:1500] = x[0] + r.standard_normal((700, 48)) * 0.12
    x[1500:2000] = x[200:700] + r.standard_normal((500, 48)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    degree, component = np.bincount(np.concatenate([a, b]), minlength=len(x)), brute.components(range(len(x)), list(zip(a.tolist(), b.tolist(), strict=True)))
    for options in ({}, {"group": 200, "leaf": 64, "sample_rows": 64}):
        out = {o.vec_id: o for o in embedding_dedup.near_duplicates(df, **options).collect()}
        found = np.array([out[i].n_links for i in range(len(x))])
        assert (found <= degree).all() and found.sum() >= 0.98 * degree.sum() and degree.sum() > 100_000
        assert np.mean([out[i].component_id == component[i] for i in range(len(x))]) > 0.98


def test_embedding_floats_as_given(spark):
    """Vectors of floats travel as floats and are compared in double precision, in leaves that are split on again."""
    r = np.random.default_rng(8)
    x = r.standard_normal((1200, 24))
    x[600:900] = x[:300] + r.standard_normal((300, 24)) * 0.15
    x[900:1150] = x[5] + r.standard_normal((250, 24)) * 0.1
    x = x.astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    degree = np.bincount(np.concatenate([a, b]), minlength=len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for options in ({}, {"group": 100, "leaf": 50, "sample_rows": 64}):
        found = np.zeros(len(x), np.int64)
        for o in embedding_dedup.near_duplicates(df, **options).collect():
            found[o.vec_id] = o.n_links
        assert (found <= degree).all() and found.sum() >= 0.98 * degree.sum() and degree.sum() > 10_000


def test_blocks_of_shared_passages(spark):
    """Documents made of a few passages that many share: large blocks of which few pairs are similar."""
    r = random.Random(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(12)]
    texts = [" ".join(r.sample(passages, 3)) for _ in range(400)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs).collect()} == brute.ngram_join(rows)


def test_payloads_are_lossless(spark):
    for r in media.store_text(odd(spark, [(1, "é" * 301), (2, None), (3, "x" * 576), (4, LONG)])).collect():
        raw = {1: "é" * 301, 2: "", 3: "x" * 576, 4: LONG}[r.doc_id].encode()
        assert media.from_wave(bytes(r.media)) == media.payload(raw) and r.n_bytes == len(raw)
    assert zlib.crc32(b"\xff" * 32) == zlib.crc32(media.payload(b"")[-32:]) and hashlib.sha256(media.payload(b"")).digest() == hashlib.sha256(b"\xff" * 576).digest()
