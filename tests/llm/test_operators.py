"""The ten operators against brute-force versions on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cladespark.llm import byte_cnn, components, lm_scoring, ngram_join, packing, personal_data, quality_rules, secrets_scan, sharding, source_mixing, staging, transport_stream, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, spans string, u string, before int, ids string"


def rows():
    rng = random.Random(11)
    syllables = ["an", "er", "the", "on", "ti", "éa", "ß", "ou", "re"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    out = [(i, text(rng.randint(1, 150)), f"s{i % 4}") for i in range(40)]
    out += [(100, base, "s0"), (101, base, "s1"), (102, " ".join(near), "s0"), (102, " ".join(near), "s0")]
    out += [(103, None, "s2"), (104, "", None), (None, "nothing here", "s1"), (None, None, None), (105, "one\ntwo words\n\none\ntwo  words\none", "s3")]
    out += [(106, text(20_000), "s0"), (107, "\t \n\x0b ", "s1"), (108, "é" * 700, "s2"), (109, "a@b.example.com +1 (487) 555-7209 10.0.0.1 4111 1111 1111 1111", "s1")]
    return [(i, t, "en", s, None if t is None else len(t), "x", "y", "z", 1, "w") for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [r[1] for r in rows()]


def test_words_and_grams_match_python():
    column = pa.array(texts())
    for row, end, buf, bounds in words.slices(column, limit=3000):
        start, stop, doc = words.word_spans(buf, bounds)
        got = [[] for _ in range(end - row)]
        for s, e, d in zip(start, stop, doc, strict=True):
            got[d].append(buf[s:e].tobytes().decode())
        assert got == [WORD.findall(t or "") for t in column.to_pylist()[row:end]]
        hashed = words.span_hashes(buf, start, stop)
        assert len(set(hashed.tolist())) == len({w for d in got for w in d})


# 1: transport streams


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 150, 157, 158, 159, 175, 176, 184, 8100, 8191, 8192, 8193, 70_000])
def test_stream_round_trip(size):
    payload = random.Random(size).randbytes(size)
    stream = transport_stream.mux(payload)
    got = transport_stream.demux(stream)
    assert got.payload == payload and len(stream) % 188 == 0 and not got.lost and not got.repeated
    assert got.elementary_packets == -(-size // transport_stream.UNIT)
    assert got.pts == [k * transport_stream.TICKS for k in range(got.elementary_packets)]
    assert got.random_access == [k * transport_stream.UNIT for k in range(0, got.elementary_packets, transport_stream.RANDOM_ACCESS_EVERY)]


def test_stream_damage_is_seen():
    stream = transport_stream.mux(bytes(range(256)) * 40)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert transport_stream.demux(b"".join(packets[:5] + packets[6:])).lost == 1
    repeated = transport_stream.demux(b"".join(packets[:5] + [packets[4]] + packets[5:]))
    assert repeated.repeated == 1 and repeated.payload == bytes(range(256)) * 40
    for bad in (b"", stream[:-1], b"\x00" + stream[1:], stream[:12] + b"\xff" + stream[13:]):
        with pytest.raises(transport_stream.TransportStreamError):
            transport_stream.demux(bad)


def test_long_tables_and_legal_jumps():
    programs = b"".join(k.to_bytes(2, "big") + (0xE000 | transport_stream.PMT_PID).to_bytes(2, "big") for k in range(1, 100))
    section = bytes([0]) + transport_stream._section(0, 1, programs)
    stream = transport_stream.mux(bytes(range(256)) * 40)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    pat = [bytes([0x47, 0x40 if i == 0 else 0, 0, 0x10 | i // 184]) + section[i : i + 184].ljust(184, b"\xff") for i in range(0, len(section), 184)]
    assert len(pat) > 1
    got = transport_stream.demux(b"".join(pat + packets[1:]))
    assert got.programs == 99 and got.payload == bytes(range(256)) * 40 and not got.lost
    with pytest.raises(transport_stream.TransportStreamError):
        transport_stream.demux(b"".join(pat[:1] + packets[1:]))
    one = lambda counter, flags, head: bytes([0x47, head | 1, 0, 0x30 | counter, 1, flags])
    pes = b"\x00\x00\x01\xbd\x00\x00\x80\x00\x00"
    units = [(one(c, f, 0x40) + pes).ljust(188, b"x") for c, f in ((0, 0), (1, 0), (9, 0x80), (10, 0), (12, 0))]
    got = transport_stream.demux(b"".join([*packets[:2], *units]))
    assert (got.lost, got.repeated, got.elementary_packets) == (1, 0, 5)


def test_streams_in_a_column(docs, empty):
    media = transport_stream.store(docs.select("doc_id", "text"))
    got = media.select("text", transport_stream.parsed(media.media).alias("m")).collect()
    for r in got:
        payload = transport_stream.padded(r.text)
        assert (r.m.payload_sha256, r.m.payload_bytes, r.m.tail_crc32) == (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and payload
    assert transport_stream.store(empty.select("text")).count() == 0


# 2: classifier


def test_network_learns_and_covers_long_texts(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "reed", "station"]) for _ in range(rng.randint(5, 300)))
    bad = lambda: " ".join(w + rng.choice(["&&&", "###"]) for w in good().split())
    sample = [good() for _ in range(100)] + [bad() for _ in range(100)]
    labels = np.repeat([1.0, 0.0], 100).astype(np.float32)
    net = byte_cnn.train(sample, labels, epochs=6)
    held = [good() for _ in range(30)] + [bad() for _ in range(30)] + ["", None]
    frame = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    scores = {r.doc_id: r.score for r in byte_cnn.score(frame, net).collect()}
    assert sum((scores[i] >= 0.5) == (i < 30) for i in range(60)) >= 57
    assert scores[60] == scores[61] and 0 <= scores[60] <= 1
    tail = good() * 40 + bad() * 40
    assert byte_cnn.layout(np.frombuffer(tail.encode(), np.uint8), np.array([0, len(tail)]))[1][-1] + byte_cnn.CHUNK >= len(tail)


def test_classifier_without_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert byte_cnn.fit(spark, docs, labels) == 0.5
    assert byte_cnn.score(empty, 0.5).count() == 0
    one = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (5, 1, 0), (6, 1, 0), (6, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert byte_cnn.fit(spark, docs, one) == 1.0


def test_a_long_text_does_not_end_the_sample(spark):
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    usable = labels.filter(byte_cnn.fold(labels.doc_id) != 1)
    (first,) = usable.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").limit(1).select("doc_id").first()
    frame = usable.selectExpr("doc_id", f"if(doc_id = {first}, repeat('long ', 1000), 'short') as text")
    texts, y = byte_cnn.sample(spark, frame, labels, limit=4000)
    assert texts == ["short"] * (usable.count() - 1) and set(y.tolist()) == {0, 1}
    again, _ = byte_cnn.sample(spark, frame.unionByName(frame), labels, limit=4000)
    assert again == texts


def test_network_matches_a_plain_forward_pass():
    net = byte_cnn.Network.random(3)
    rng = random.Random(5)
    cases = [b"", b"a", rng.randbytes(511), rng.randbytes(512), rng.randbytes(513), rng.randbytes(2000)]
    buf, bounds = np.frombuffer(b"".join(cases), np.uint8), np.cumsum([0] + [len(c) for c in cases])
    for case, got in zip(cases, net.scores(buf, bounds), strict=True):
        hop = byte_cnn.CHUNK - byte_cnn.OVERLAP
        count = max(1, -(-max(len(case) - byte_cnn.OVERLAP, 0) // hop))
        pooled = []
        for k in range(count):
            chunk = case[k * hop : k * hop + byte_cnn.CHUNK].ljust(byte_cnn.CHUNK, b"\0")
            seen = [np.concatenate([net.embed[b] for b in chunk[i : i + byte_cnn.WIDTH]]) @ net.filters + net.bias for i in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STEP)]
            pooled.append(np.maximum(np.max(seen, 0), 0))
        logit = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)]) @ net.head + net.offset[0]
        assert got == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)


# 3: language model


def test_scores_match_a_direct_count(docs, empty):
    by_id = {}
    for r in rows():
        by_id.setdefault(r[0], []).append(WORD.findall(r[1] or ""))
    uni, bi = Counter(), Counter()
    for seqs in by_id.values():
        for w in seqs:
            uni.update(w)
            bi.update(zip(w, w[1:]))
    total = sum(uni.values())
    for limit in (1_000_000, 200):
        known = {w for w, n in uni.items() if n * limit >= total}
        fold = lambda w: w if w in known else None  # noqa: E731, B023
        u, b = Counter(), Counter()
        for w, n in uni.items():
            u[fold(w)] += n
        for (x, y), n in bi.items():
            b[fold(x), fold(y)] += n
        for r in lm_scoring.stupid_backoff(docs, max_words=limit).collect():
            want = seen = n = 0
            for seq in by_id[r.doc_id]:
                seq = [fold(w) for w in seq]
                n += len(seq)
                for i, w in enumerate(seq):
                    if i and b[seq[i - 1], w] >= 2:
                        want += math.log(b[seq[i - 1], w] / u[seq[i - 1]])
                        seen += 1
                    else:
                        want += math.log(u[w] / total) + (math.log(0.4) if i else 0)
            assert (r.n_words, r.n_seen) == (n, seen) and r.log_score == pytest.approx(want, abs=1e-6)
    assert lm_scoring.stupid_backoff(empty).count() == 0


def test_words_that_no_task_holds_count_for_themselves(docs):
    by_id = {}
    for r in rows():
        by_id.setdefault(r[0], []).append(WORD.findall(r[1] or ""))
    u, b = Counter(), Counter()
    for seqs in by_id.values():
        for w in seqs:
            u.update(w)
            b.update(zip(w, w[1:]))
    total = sum(u.values())
    assert 0 < sum(n * 200 >= total for n in u.values()) < len(u)
    for held in (200, 1):
        for r in lm_scoring.stupid_backoff(docs, held=held).collect():
            want = seen = n = 0
            for seq in by_id[r.doc_id]:
                n += len(seq)
                for i, w in enumerate(seq):
                    if i and b[seq[i - 1], w] >= 2:
                        want += math.log(b[seq[i - 1], w] / u[seq[i - 1]])
                        seen += 1
                    else:
                        want += math.log(u[w] / total) + (math.log(0.4) if i else 0)
            assert (r.n_words, r.n_seen) == (n, seen) and r.log_score == pytest.approx(want, abs=1e-6)


def test_a_word_below_one_in_a_million_is_no_unknown_word(spark):
    texts = ["common " * 1_000_001, "rara avis", "rara avis", "other bird"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.stupid_backoff(frame).collect()}
    total = 1_000_001 + 6
    assert got[1].n_seen == 1 and got[1].log_score == pytest.approx(math.log(2 / total) + math.log(2 / 2), abs=1e-6)
    assert got[3].n_seen == 0 and got[3].log_score == pytest.approx(2 * math.log(1 / total) + math.log(0.4), abs=1e-6)


# 4: packing


@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(tokenizer_path):
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(tokenizer_path), packing.WordEncoder(tokenizer_path)
    odd = ["İstanbul Σας", "<|endoftext|> a", "don't 'sup they'll x_1 y² ½", "日本語 ok", "áb", "№5 '72", "\x1c\x1d a", "ŒUVRE œ — “x”"]
    for t in [x or "" for x in texts()] + odd:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_is_a_cut_of_one_stream(docs, empty, tokenizer_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    pieces = packing.pack(docs, tokenizer_path, window=64).collect()
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts())
    assert sum(p.length for p in pieces) == total and max(p.sequence_id for p in pieces) == (total - 1) // 64
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for k, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 64 or k == (total - 1) // 64
    whole = {t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts()}
    by_id = {r[0]: r[1] for r in rows()}
    for p in pieces:
        if p.doc_id is not None:
            ids = whole[by_id[p.doc_id]]
            cut = ids[p.start : p.start + p.length].tobytes()
            assert (bytes(p.ids), p.ids_crc32, p.doc_tokens) == (cut, zlib.crc32(cut), len(ids))
    assert packing.pack(empty, tokenizer_path).count() == 0
    joined = packing.sequences(packing.pack(docs, tokenizer_path, window=64)).collect()
    assert all(len(s.ids) == 4 * s.length for s in joined)


# 5: mixing


def filled(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("limit", [10_000, 0])
def test_mix_meets_its_targets(docs, monkeypatch, limit):
    monkeypatch.setattr(source_mixing, "BROADCAST_SOURCES", limit)
    got = source_mixing.mix(docs)[0].collect()
    assert len(got) == len(rows())
    sizes = {}
    for r in rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = filled(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]}
        assert all(r.target == pytest.approx(want[s]) and r.taken in (0, r.size, 2 * r.size) for r in mine)
        rest = max([r.size for r in mine])
        assert abs(sum(r.taken for r in mine) - want[s]) <= rest / 2 + 1e-6
    again = source_mixing.mix(docs.repartition(5))[0].collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mix_takes_longer_documents_oftener_and_repeats_rows(spark, empty):
    rng = random.Random(4)
    frame = spark.createDataFrame([(i, " ".join(["w"] * rng.choice([5, 50])), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    got = source_mixing.mix(frame)[0].collect()
    part = {n: [r.copies - r.whole for r in got if r.source == "s2" and r.size == n] for n in (5, 50)}
    assert np.mean(part[50]) >= np.mean(part[5]) or not any(part[5] + part[50])
    taken = Counter()
    for r in source_mixing.repeated(frame).collect():
        taken[r.doc_id] += 1
    assert taken == Counter({r.doc_id: r.copies for r in got if r.copies})
    assert source_mixing.mix(empty)[0].count() == 0 and source_mixing.repeated(empty).count() == 0


# 6: near copies


def brute_classes(pairs):
    sets = []
    for _, t in pairs:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()))
    near = lambda a, b: a and b and len(a & b) >= 0.8 * len(a | b)
    distinct = [s for s in dict.fromkeys(sets) if s]
    label = {s: i for i, s in enumerate(distinct)}
    links = Counter()
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if near(a, b):
                links[a] += 1
                links[b] += 1
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    least = {}
    for (d, _), s in zip(pairs, sets, strict=True):
        if s and d is not None:
            least[label[s]] = min(d, least.get(label[s], d))
    copies = Counter(sets)
    return Counter((d, least.get(label[s]) if s else d, links[s] if s else 0, copies[s] if s else 1) for (d, _), s in zip(pairs, sets, strict=True))


def near_copies():
    rng = random.Random(9)
    out = []
    for g in range(12):
        base = [f"w{rng.randrange(2000)}" for _ in range(100)]
        for k in range(rng.randint(1, 6)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(100)] = f"x{rng.randrange(5000)}"
            out.append((1000 + 10 * g + k, " ".join(other)))
    shared = " ".join(f"p{i}" for i in range(60))
    out += [(2000 + i, shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(120))) for i in range(30)]
    return out


@pytest.mark.parametrize("block", [500, 3])
def test_classes_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", block)
    pairs = near_copies() + [(r[0], r[1]) for r in rows() if r[0] != 106]
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.jaccard_classes(frame).collect())
    assert got == brute_classes(pairs)


def test_forest_depth_and_empty_table(empty):
    assert ngram_join.floor_depth(0.8, 24, 8, 0.99999) == 4
    assert ngram_join.floor_depth(0.8, 24, 8, 0.5) == 8
    assert ngram_join.floor_depth(0.5, 24, 6, 0.99999) == 1
    with pytest.raises(ValueError, match="recall"):
        ngram_join.floor_depth(0.1, 3, 6, 0.99)
    assert ngram_join.least_agreement(0.8, 144) == 87
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_prefixes_are_shortened_until_the_recall(spark):
    def steps(change):
        rng = random.Random(4)
        pairs = []
        for g in range(40):
            base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
            other = list(base)
            for k in range(change):
                other[20 + 20 * k] = "x"
            pairs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        signed = ngram_join.signatures(spark.createDataFrame(pairs, "doc_id long, text string"), 4).filter("node is not null")
        found, taken = ngram_join.forest_ties(signed, 0.8, 24, 6, 0.99999)
        assert found.distinct().count() == 40
        return taken

    alike, unlike = steps(1), steps(6)
    assert [d for d, _ in unlike] == list(range(6, 6 - len(unlike), -1)) and len(alike) < len(unlike) <= 3
    assert [r for _, r in unlike] == sorted(r for _, r in unlike) and unlike[-1][1] >= 0.99999 or unlike[-1][0] == 4


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.9])
def test_other_thresholds_match_all_pairs(spark, threshold):
    rng = random.Random(12)
    pairs = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(80)]
        for k in range(3):
            other = list(base)
            for _ in range(rng.randint(0, 6)):
                other[rng.randrange(80)] = f"x{rng.randrange(9000)}"
            pairs.append((10 * g + k, " ".join(other)))
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for d, t in pairs for w in [t.split()]}
    distinct = set(sets.values())
    links = {s: sum(s is not o and len(s & o) >= threshold * len(s | o) for o in distinct) for s in distinct}
    got = ngram_join.jaccard_classes(spark.createDataFrame(pairs, "doc_id long, text string"), threshold=threshold).collect()
    assert {r.doc_id: r.n_links for r in got} == {d: links[s] for d, s in sets.items()}


def test_ids_of_any_type(spark, tmp_path):
    from pyspark.sql import functions as F

    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "aabc"]
    frame = spark.createDataFrame([(f"id-{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    assert {(r.doc_id, r.class_id) for r in ngram_join.jaccard_classes(frame).collect()} == {("id-0", "id-0"), ("id-1", "id-0"), ("id-2", "id-2"), ("id-3", "id-3")}
    placed = frame.select("doc_id", sharding.shard_of(sharding.key_of(frame, "doc_id"), 8).alias("a"), sharding.shard_of(sharding.key_of(frame, "doc_id"), 9).alias("b")).collect()
    assert all(0 <= r.a < 8 and r.b in (r.a, 8) for r in placed)
    spark.createDataFrame([("id-0", 1, 0)], "doc_id string, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality_rules.quality_rules(spark, frame, str(tmp_path)).filter(F.col("base_failed")).count() == 4


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(n, find(n)) for e in edges if e[0] != e[1] for n in e}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == want and len(got) == len(want)


def test_lookup_takes_hot_and_rare_values(spark):
    left = spark.createDataFrame([(i % 5 if i > 20 else 99, i) for i in range(100)], "k long, v long")
    right = spark.createDataFrame([(k, n, f"x{k}") for k, n in ((99, 21), (0, 16), (1, 15), (2, 16), (3, 16), (4, 16), (7, 0))], "k long, n long, x string")
    got = staging.lookup(left, right, "k", "n", 100, share=5).collect()
    assert len(got) == 100 and all(r.x == f"x{r.k}" for r in got)


# 7: quality rules


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_counts_match_plain_python(docs):
    extra = ["a b c a b c", "x|y\nx|y\n x|y\n", "#*$%&<> é|\n\n\n", "a\r\na\r\na", "w " * 5000, "a b\na b\nb a b a"]
    frame = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts() + extra)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(frame, "doc_id", "text", np.zeros(quality_rules.BUCKETS)).collect()}
    for i, t in enumerate(texts() + extra):
        want = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def test_ratio_matches_a_direct_count_and_rejects_what_is_unlike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality_rules, "PRIOR", 500)
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "reed", "station"]) for _ in range(80))
    junk = lambda: " ".join(f"{rng.choice('QXZ')}{rng.randrange(9)}&&" for _ in range(80))
    data = [(i, good()) for i in range(60)] + [(100 + i, junk()) for i in range(20)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40)] + [(100, 0, 0), (41, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark, frame, str(tmp_path)).collect()}

    def ids(t):
        b = t.encode()
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(b) - 2)]

    every, trusted = Counter(), Counter()
    for d, t in data:
        every.update(ids(t))
        if d < 40:
            trusted.update(ids(t))
    n, m = sum(every.values()), sum(trusted.values())
    prior = 500 + m / 1000
    score = lambda t: np.mean([math.log((trusted[g] + prior * every[g] / n) / (m + prior) / (every[g] / n)) for g in ids(t)])
    for d, t in data:
        assert got[d].ratio == pytest.approx(score(t), abs=1e-4)
        assert got[d].kept == (d < 100 and not got[d].base_failed)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_all_trusted_rows_count(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_TRUSTED", broadcast)
    spark.range(20_500).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality_rules.trusted_ids(spark, str(tmp_path)).count() == 20_500
    frame = spark.range(20_600).selectExpr("id as doc_id", "if(id < 20500, if(id % 2 = 0, 'abc', concat('cd', char(97 + cast(id % 26 as int)))), 'xyz') as text")
    texts = [r.text for r in frame.orderBy("doc_id").collect()]
    every, trusted = Counter(texts), Counter(texts[:20_500])
    prior = quality_rules.PRIOR + 20_500 / 1000
    for r in quality_rules.quality_rules(spark, frame, str(tmp_path)).filter("doc_id < 60 or doc_id >= 20590").collect():
        g = texts[r.doc_id]
        p = every[g] / 20_600
        assert r.ratio == pytest.approx(math.log((trusted[g] + prior * p) / (20_500 + prior) / p), abs=1e-6)


def test_rules_without_labels_or_rows(spark, docs, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert all(r.kept == (not r.base_failed) and r.ratio == 0 for r in quality_rules.quality_rules(spark, docs, str(tmp_path)).collect())
    assert quality_rules.quality_rules(spark, empty, str(tmp_path)).count() == 0


# 8: secrets

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute_secrets(t):
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda x: (x[1], secrets_scan.KINDS.index(x[0])))


def test_secrets_match_plain_expressions(spark):
    rng = random.Random(8)
    parts = ["token", "TOKEN = ", "api_key:", "apikey='", "password", "passwd = \"", "secret", "=", ": ", "AKIA", "ABCDEF123456", "deadbeef" * 4, "0" * 33, "é", " ", "\n", "x1y2z3w4", "ſecret=abcdefgh", "tokentoken=abcdefghi", "secret:secret:abcdefghij", "AKIAAKIA0123456789"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    machine = secrets_scan.automaton()
    for t in cases:
        got = [(k, s, e) for s, e, k in secrets_scan.scan(t, machine) if k in secrets_scan.BASE]
        assert got == brute_secrets(t), t
    assert secrets_scan.scan(None, machine) == []


def test_long_hostile_texts_take_linear_time():
    import time

    machine, began = secrets_scan.automaton(), time.perf_counter()
    deep = __import__("base64").urlsafe_b64encode(b'{"alg":' + b"[" * 200_000).decode().rstrip("=")
    for t in ("eyJ" * 1_000_000, "eyJa." * 300_000, "password" * 200_000, "-----BEGIN " + "A " * 500_000, "AKIA" * 500_000, deep + ".a.b"):
        assert all(k == "access" for _, _, k in secrets_scan.scan(t, machine))
    for t in ("0" * 5000 + ".1.1.1", "1" * 5_000_000, "1." * 500_000, "+1" + " " * 1_000_000, "a@" * 500_000, "a@" + "b" * 1_000_000):
        spans = personal_data.base_spans(t)
        assert len(spans) == (t.count(".") // 4 if t.startswith("1.") else t.startswith("0"))
    assert time.perf_counter() - began < 60


def test_arrays_in_a_token_are_no_header():
    assert secrets_scan.scan("eyJhbGciXQ.e30.abc", secrets_scan.automaton()) == []


def test_embedded_checksums(spark):
    machine = secrets_scan.automaton()
    body = "0123456789ABCDEFGHIJabcdefghij"
    good = "ghp_" + body + secrets_scan.base62(zlib.crc32(body.encode()), 6)
    assert [k for _, _, k in secrets_scan.scan(f"é {good}.", machine)] == ["github"]
    assert not secrets_scan.scan("ghp_" + body + "000000", machine)
    assert [x[2] for x in secrets_scan.scan("eyJhbGciOiJIUzI1NiJ9.e30.abc", machine)] == ["jwt"]
    assert [x[2] for x in secrets_scan.scan("-----BEGIN RSA PRIVATE KEY-----", machine)] == ["pem"]
    frame = spark.createDataFrame([(1, None), (2, "x" + good)], "doc_id long, text string")
    from pyspark.sql import functions as F

    found = frame.select("doc_id", secrets_scan.joined(secrets_scan.secret_spans(F.col("text"))).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == {1: "", 2: "github:1:41"}


# 9: personal data


def brute_personal(t):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + (i & 1)), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_match_plain_expressions():
    rng = random.Random(7)
    parts = ["a", "b.c", "@", "@x", ".com", ".", "x@y.z", "1", "255", "256", "0010", "10.0.0.1", "4111111111111111", "4111 1111-1111 1111", "+1 (487) 555-7209", "+", "-", " ", "(", "é", "%", "\n", "9" * 20]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert personal_data.base_spans(t) == brute_personal(t), t


def test_contexts_discover_identifiers(spark, empty):
    rng = random.Random(5)
    filler = lambda: " ".join(rng.choice(["red", "blue", "on", "the", "of"]) for _ in range(20))
    data = [(i, f"{filler()} account holder: user{i}@mail.example.com {filler()} of {rng.randrange(10**6)} {filler()}") for i in range(40)]
    data += [(100, f"é {filler()} account holder: QX-8841-77 {filler()}"), (101, filler()), (102, None), (103, "holder: 123")]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    patterns = personal_data.confident_patterns(frame)
    assert len(patterns)
    got = {r.doc_id: (r.text, r.spans) for r in personal_data.spans_of(frame, patterns, ["doc_id"]).collect()}
    text, spans = got[100]
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [("found", "QX-8841-77")]
    assert got[101][1] == [] and got[103][1] == [] and got[102][1] == []
    assert all(len(got[i][1]) == 1 for i in range(40))
    assert len(personal_data.confident_patterns(empty)) == 0
    clean = personal_data.redacted(text, [{"kind": s.kind, "start": s.start, "end": s.end} for s in spans])
    assert "QX-8841-77" not in clean and "<found>" in clean


def test_contexts_count_whatever_else_the_corpus_holds(spark, monkeypatch):
    data = [(i, " ".join(f"w{i}x{k} user{i}.{k}@mail.example.com" for k in range(100))) for i in range(300)]
    data += [(1000 + i, f"account holder: owner{i}@mail.example.com") for i in range(5)]
    data += [(2000, "é account holder: QX-8841-77 and ip 10.0.0.1")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    for block in (personal_data.BLOCK, 1):
        monkeypatch.setattr(personal_data, "BLOCK", block)
        patterns = personal_data.confident_patterns(frame)
        assert len(patterns) == 2
        (r,) = personal_data.spans_of(frame.filter("doc_id = 2000"), patterns, ["doc_id"], clean=True).collect()
        assert [(s.kind, data[-1][1][s.start : s.end]) for s in r.spans] == [("ip", "10.0.0.1"), ("found", "QX-8841-77")]
        assert r.text == "é account holder: <found> and ip <ip>"


def test_contexts_rise_over_all_rounds(spark):
    data = [(i, f"account holder: user{i}@mail.example.com") for i in range(10)] + [(100 + i, f"account holder: QX-88{i:02d}-77") for i in range(40)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    patterns = personal_data.confident_patterns(frame)
    assert len(patterns) == 2
    assert all([s.kind for s in r.spans] == ["found" if r.doc_id >= 100 else "email"] for r in personal_data.spans_of(frame, patterns, ["doc_id"]).collect())


def test_redaction_merges_overlaps():
    spans = [{"kind": "card", "start": 2, "end": 8}, {"kind": "ip", "start": 6, "end": 10}, {"kind": "email", "start": 12, "end": 14}]
    assert personal_data.redacted("ab012345678xyz@!", spans) == "ab<card>8xy"[:0] + "ab<card>" + "ab012345678xyz@!"[10:12] + "<email>" + "ab012345678xyz@!"[14:]
    assert personal_data.redacted(None, spans) is None


# 10: sharding


def brute_jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_and_slots(docs, empty):
    rng = random.Random(1)
    keys = np.array([rng.randrange(-(2**63), 2**63) for _ in range(500)] + [0, -1], np.int64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump(keys, n).tolist() == [brute_jump(int(k), n) for k in keys]
    before, after = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert ((before == after) | (after == 8)).all() and 20 < (after == 8).sum() < 100
    from pyspark.sql import functions as F

    placed = docs.select("doc_id", "text").withColumn("shard", sharding.shard_of(F.col("doc_id"), 8))
    got = sharding.with_slots(placed, "shard", ["doc_id", "text"], runs=3).collect()
    assert len(got) == len(rows())
    for k in range(8):
        mine = sorted(r.slot for r in got if r.shard == k)
        assert mine == list(range(len(mine)))
    assert all(r.shard == brute_jump(r.doc_id or 0, 8) for r in got)
    assert sharding.with_slots(empty.select("doc_id", F.lit(0).alias("shard")), "shard", ["doc_id"]).count() == 0
