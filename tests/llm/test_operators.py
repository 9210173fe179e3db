"""The operators against plain versions, on small tables with nulls, empties, copies, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from twinlake.llm import chat, embedding_dedup, media, mixing, ngram_join, packing, secrets, substring_dedup, suffix_dedup, toxicity
from twinlake.llm import _hashing as H

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, kind string, dest int"


def make(spark, texts, ids=None):
    """Documents with three columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}" if k % 7 else None, len(t or ""), 1, "x", 2) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def prose(seed, n, words=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words * 2))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 40)
    r = random.Random(2)
    near = []
    for t in base[:10]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    passage = " ".join(prose(3, 1, 60)[0].split() * 2)
    shared = [f"{a} {passage}\n{b}" for a, b in zip(base[10:20], base[20:30], strict=True)]
    periodic = ["ab " * 300, "x" * 700, "é" * 200]
    return [*base, *near, *shared, *periodic, *base[:5], "", None, "   \n\t ", "one two", "One TWO", "a b c　d e f g", "nul\x00byte " * 30, " ".join(prose(9, 1, 3000))]


def by_id(df, n):
    return {r[0]: tuple(r)[1 : n + 1] for r in df.collect()}


def test_hashes_agree_with_words():
    col = pa.array(["a b  c", None, "", "b c a\tb", "é é"])
    data, at = H.buffer(col)
    start, end, doc = H.words(data, at)
    words = [bytes(data[s:e]) for s, e in zip(start, end, strict=True)]
    assert words == b"a b c b c a b".split() + ["é".encode()] * 2
    assert doc.tolist() == [0, 0, 0, 3, 3, 3, 3, 4, 4]
    h = H.word_hashes(data, start, end)
    assert len(set(h.tolist())) == 4 and h[0] == h[5] and h[1] == h[3] == h[6]
    g = H.windows(h, 2)
    assert g[0] == g[5] and len(set(g.tolist())) == 6


def test_ngram_join(spark, texts):
    rows = list(enumerate(texts))
    got = by_id(ngram_join.jaccard_groups(make(spark, texts)), 2)
    assert got == brute.ngram_join(rows)


def test_ngram_join_odd_ids(spark):
    t = ["a b c d e f g h", "a b c d e f g h", "x y", None]
    out = ngram_join.jaccard_groups(make(spark, t, [5, 5, None, 7])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in out), key=str) == sorted([(5, 5), (5, 5), (None, None), (7, 7)], key=str)
    assert ngram_join.jaccard_groups(make(spark, [])).collect() == []
    kept = ngram_join.keep_one(make(spark, t, [5, 6, 8, 7]))
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 8] and kept.columns == make(spark, []).columns


def test_substring_dedup(spark, texts):
    got = by_id(substring_dedup.digest(substring_dedup.drop_repeats(make(spark, texts))), 3)
    assert got == brute.substring_dedup(list(enumerate(texts)))
    assert substring_dedup.drop_repeats(make(spark, [])).collect() == []


def test_suffix_dedup(spark, texts):
    got = by_id(suffix_dedup.digest(suffix_dedup.drop_long_matches(make(spark, texts))), 4)
    assert got == brute.byte_dedup(list(enumerate(texts)))
    assert suffix_dedup.drop_long_matches(make(spark, [])).collect() == []


def test_repeated_ids_are_rows(spark):
    t = " ".join(str(i) for i in range(60))
    out = substring_dedup.drop_repeats(make(spark, [t, t, None], [4, 4, None])).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_removed) for r in out) == [(False, 60, 0), (False, 60, 60), (True, 0, 0)]


def contexts(r, n, letters, most):
    own = [bytes(r.integers(97, 97 + letters, r.integers(0, most)).astype(np.uint8)) for _ in range(n)]
    return own, np.frombuffer(b"".join(c + b"\xff" for c in own), np.uint8)


def test_run_index():
    r = np.random.default_rng(0)
    text = np.append(r.integers(97, 99, 500).astype(np.uint8), 255).astype(np.uint8)
    raw = text.tobytes()
    assert suffix_dedup.suffix_order(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    for _ in range(30):
        own, text = contexts(r, int(r.integers(1, 8)), 2, 40)
        node = np.sort(r.integers(0, 3, len(own)))
        index, eights = suffix_dedup.build_index(text, np.repeat(node, [len(c) + 1 for c in own])), suffix_dedup.eight_bytes(text)
        asked = [c[2:] + b"ab" for c in own] + contexts(r, 4, 3, 30)[0]
        of = r.integers(0, 4, len(asked))
        size = np.array([len(p) for p in asked])
        got = {}
        for step, who, length in suffix_dedup.matching_statistics(index, eights, np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size, of):
            got |= {(w, size[w] - step): n for w, n in zip(who.tolist(), length.tolist(), strict=True)}
        for q, p in enumerate(asked):
            mine = [c for c, k in zip(own, node, strict=True) if k == of[q]]
            for i in range(len(p)):
                assert got[q, i] == max(n for n in range(len(p) - i + 1) if n == 0 or any(p[i : i + n] in c for c in mine))


def test_run_index_follows_runs_in_a_repetitive_text():
    r = np.random.default_rng(1)
    base = r.integers(97, 123, 170).astype(np.uint8)
    few, many = (suffix_dedup.build_index(np.tile(np.append(base, np.uint8(255)), n)) for n in (10, 1000))
    assert many.rows == 100 * few.rows and all(len(x) < 200 for x in (many.key, many.letter, many.first, many.last, many.to, many.head, many.tail))


def test_repeated_places_in_parts():
    r = np.random.default_rng(2)
    for most in (20, 60, 10_000):
        own = [bytes(r.integers(97, 99, r.integers(5, 20)).astype(np.uint8)) for _ in range(60)]
        group = np.sort(r.integers(0, 5, len(own)))
        size = np.array([len(c) for c in own])
        got = suffix_dedup.repeated_places(np.frombuffer(b"".join(own), np.uint8), np.cumsum(size) - size, size, group, 5, most)
        want = [any(own[i][j : j + 5] in own[o] for o in range(i) if group[o] == group[i]) for i in range(len(own)) for j in range(len(own[i]) - 4)]
        assert got.tolist() == want


def test_embedding_dedup(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((1500, 32))
    x[500:1000] = x[:500] + r.standard_normal((500, 32)) * 0.12
    x[1400] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [None] * 32, 1), (2004, [1.0, 2.0], 1), (2005, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    out = {o.vec_id: o for o in embedding_dedup.near_duplicates(df, group=128, leaf=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    degree = np.bincount(np.concatenate([a, b]), minlength=1500)
    found = np.array([out[i].n_links for i in range(1500)])
    assert len(out) == 1506 and (found <= degree).all() and found.sum() >= 0.9 * degree.sum() and degree.sum() > 500
    assert all(out[i].n_links == 0 and out[i].component_id == i and out[i].kept for i in range(2000, 2006))
    assert out[1400].component_id == 0 and not out[1400].kept


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", None), (4, 0, None, "x"), (5, 0, "user", "x"), (None, None, "user", "lone")]
    out = chat.collapse_snapshots(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in out} == {(3, 3, 1), (4, 1, 2), (None, 1, 1)}
    assert next(r.text for r in out if r.conv_id == 3) == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n<|user|>\n<|end|>\n"


def test_secrets(spark):
    key = "AKIA" + "ABCD1234EFGH5678"
    texts = [
        f'x token = "abc123def456ghi789" {key}', "é password: short Passwd=longer_one deadbeef" + "0" * 20, None, "", "token=token: abcdefgh",
        "Zz9kQ4wXv7Lp2Rt8MnB5cD1e plain", f"api_key={key}", f"API-KEY secret:{key}",
    ]
    out = {r.doc_id: r for r in secrets.digest(secrets.scan_secrets(make(spark, texts))).collect()}
    assert out[0].spans.split(",")[:2] == ["assign:2:29", "access:31:51"]
    assert (out[1].n_assign, out[1].n_hex) == (1, 1) and out[2].spans == out[3].spans == "" and out[4].n_assign == 0
    assert out[5].n_added == 1 and out[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in secrets.mask_live(make(spark, texts)).collect()}
    assert masked[5].text == "[secret] plain" and masked[5].n_chars == 14 and masked[4].text == texts[4]
    assert secrets.scan_secrets(make(spark, [])).collect() == []


def test_media(spark):
    texts = ["abc", "", None, "é" * 500, "abc", "x" * 576, "y" * 40_000]
    out = {r.doc_id: r for r in media.audio_features(media.store_text(make(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        o = out[i]
        assert (o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        table = media.read_tensors(o.tensors)
        assert table.schema.field("tensor").type.shape == [media.PATCH, media.MELS]
        assert sum(table["frames"].to_pylist()) == int(o.feature.split(";")[0].split("=")[1])
    assert out[0].feature == out[4].feature and out[1].media_sha256 == out[2].media_sha256


def test_resampler_keeps_a_tone():
    t = np.arange(8000) / media.RATE
    y = media.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    peak = np.argmax(np.abs(np.fft.rfft(y))) * media.RATE * media.UP / media.DOWN / len(y)
    assert abs(peak - 440) < 2


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [*texts, "a <|endoftext|> b", "word " * 3000]
    rows = packing.pack_documents(make(spark, texts), tokenizer=path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]] and sum(r.length for r in s) <= 1024


def test_hilbert_neighbours_touch():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    walk = cells[np.argsort(packing.hilbert(cells, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_toxicity_learns_and_tolerates_gaps(spark):
    clean, insults = prose(11, 900, 20), ["zorvex", "quilmuk"]
    r = random.Random(5)
    texts, labels = [], []
    for i, t in enumerate(clean):
        bad = i % 5 == 0
        w = t.split()
        if bad:
            w.insert(r.randrange(len(w) + 1), insults[i // 5 % 2])
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    model = toxicity.train(texts, np.array([bool(b) for _, b in labels]))
    probe = ["fine words here", "you zorvex", "you z-orvex", "you zorv3ex", "", None, "quilmuk"]
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(make(spark, probe), model).collect()}
    assert all(out[i] > 0.7 for i in (1, 2, 3, 6)) and all(out[i] < 0.3 for i in (0, 4, 5))
    fitted = toxicity.fit_toxicity(make(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert fitted.slope > 0
    odd = toxicity.score_toxicity(make(spark, texts[:3]), toxicity.train([], np.empty(0, bool)))
    assert all(0 <= r.score <= 1 for r in odd.collect())
    held = make(spark, ["a"] * 4, [1, 2, 3, None]).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id: r.h for r in held} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3)} | {None: True}


def test_mixing(spark, texts):
    docs = make(spark, texts)
    rows = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs).collect()))
    groups = defaultdict(list)
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").replace(" ", "x").replace("　", "x").split()) or texts[r.doc_id] is None or "\x00" in texts[r.doc_id] or r.size == len(brute.words(texts[r.doc_id]))
        assert 0 <= r.taken <= 2 * r.size
        groups[source[r.doc_id]].append(r)
    total = sum(r.size for r in rows)
    want = {s: (sum(r.size for r in g), w) for (s, g), w in zip(sorted(groups.items(), key=lambda x: (x[0] is None, x[0] or "")), (3, 1, 2, 3), strict=True)}
    target, left, free = {}, 1.5 * total, dict(want)
    while free:
        share = {s: left * w / sum(x[1] for x in free.values()) for s, (_, w) in free.items()}
        over = {s for s in free if share[s] > 2 * free[s][0]}
        for s in over or free:
            target[s] = 2 * want[s][0] if over else share[s]
        left -= sum(target[s] for s in over)
        free = {s: x for s, x in free.items() if s not in over} if over else {}
    for s, g in groups.items():
        assert g[0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in g) - g[0].target) <= 1
    mixed = mixing.repeat_texts(docs)
    assert sum(len(brute.words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows) and mixed.columns == docs.columns
