"""Each operator against a brute-force version, the library or an exact round trip; then the odd cases."""

import hashlib
import io
import re
import zlib

import duckdb
import numpy as np
import plain
import pytest
from conftest import CLASHING, ROWS, SF
from pyspark.sql import functions as F

from test_near_copies import kept

import corpus_pipeline
from bazaarium.llm import exact_dedup, language_id, line_dedup, mixing, mpeg_audio, queries, sentencepiece_unigram, simhash, sst, token_counts, toxicity

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def texts(rows):
    return [(i, t or "") for i, t in rows]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(queries.BYTE_BPE))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    show = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r)
    assert sorted(map(show, got.select(*names).collect())) == sorted(map(show, want.project(", ".join(names)).fetchall()))


@pytest.fixture(scope="module")
def machine(spark):
    """Trained on sentences made here: insults in toxic ones, their likes in clean ones, and a few wrong labels."""
    rng = np.random.default_rng(7)
    syllables = ["the", "on", "re", "sting", "or", "in", "da", "mo", "ter", "ash", "ful", "low", "est", "pid"]
    rows = []
    for i in range(900):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(60)]
        toxic = i % 5 == 0
        for at in rng.integers(0, 60, 2 * toxic):
            words[at] = rng.choice(["worthless", "pathetic", "stupid"])
        rows.append((i, ". ".join(" ".join(words[k : k + 10]) for k in range(0, 60, 10)), int(toxic) if i % 180 else 1 - int(toxic)))
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))


CLEAN = "the ondare is mo. reonter lowest daful, "


@pytest.mark.parametrize("insult", ["worthless", "Pathetic!", "stupid", "worxthless", "patqhetic", "stuxpid", "worxthqless", "pathxetzic", "worthess", "pathtic", "worth less", "pathe tic", "w o r t h l e s s", "s-t-u-p-i-d"])
def test_plain_and_disguised_insults_are_toxic(machine, insult):
    clean, hit = machine.probability(np.array(machine.scorer.margins([CLEAN * 20, CLEAN * 10 + insult + " " + CLEAN * 10])))
    assert clean < 0.5 <= hit


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    out = queries.op1_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("toxic", "predicted").toPandas()
    assert (out.toxic == out.predicted).mean() >= 0.9
    assert out[out.toxic == 0].predicted.mean() <= 0.02


def test_subsequence_kernel_equals_all_subsequences():
    from itertools import combinations

    def weights(s):
        out = {}
        for at in combinations(range(len(s)), toxicity.ORDER):
            k = "".join(s[i] for i in at)
            out[k] = out.get(k, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def kernel(a, b):
        return sum(v * weights(b).get(k, 0) for k, v in weights(a).items())

    marks, strings = ["abcde", "banana", "xyzw"], ["abxcde", "bananas", "", "wzyx", "aabbccddee", "bxanqana", "abde", "ab"]
    known = set("".join(marks))

    def wanted(s, m):
        s = "".join(c if c in known else "?" for c in s)
        # Letters in order: the most of the landmark's that are a subsequence of the string.
        within = lambda t: all(c in rest for rest in [iter(s)] for c in t)
        most = max(n for n in range(len(m) + 1) for t in combinations(m, n) if within(t))
        enough = most >= toxicity.NEEDED * len(m)
        return kernel(s, m) / kernel(s, s) ** 0.5 if enough else 0.0

    np.testing.assert_allclose(toxicity.Landmarks(marks).kernel(strings), [[wanted(s, m) for m in marks] for s in strings], rtol=1e-4)


def test_toxicity_scores_odd_rows(machine, edge, empty):
    got = toxicity.scored(edge, machine).collect()
    assert len(got) == edge.count()
    assert all(0 <= r.score < 0.5 for r in got)
    assert toxicity.scored(empty, machine).count() == 0


def test_simhash_equals_all_pairs(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == plain.near_groups(rows)


@pytest.mark.parametrize("width", [3, 4])
def test_index_meets_every_near_pair(spark, width):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    all_ = {int(b) for b in base}
    for b in base.tolist():
        for k in range(1, 7):
            all_.add(b ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in sorted(all_)]
    found = simhash.connected_components(simhash.links(spark.createDataFrame(signed, "fp long"), width)).collect()
    got = {r.node: r.component for r in found}
    for (a,) in signed:
        for (b,) in signed:
            if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert got[a] == got[b]


def test_shards_equal_library_and_look_up(docs, rows, tokenizer, tmp_path):
    got = {r.doc_id: r for r in sst.token_shards(docs, queries.vocabulary(queries.BYTE_BPE)).collect()}
    at = 0
    for i, t in sorted(texts(rows)):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    sink = io.BytesIO()
    writer = sst.Writer(sink, 2)
    for i in range(0, 40_000, 2):
        writer.add(sst.key_of(i, i), np.array([i % 60000, 2], "<u2").tobytes())
    writer.close()
    table = sst.Table(sink)
    assert len(table.firsts) > 3 and [x.tolist() for x in table.get(31_338)] == [[31338, 2]] and table.get(31_337) == []
    assert sum(table.may_hold(i) for i in range(1, 40_000, 2)) < 600
    raw = bytearray(sink.getvalue())
    raw[100] ^= 1
    with pytest.raises(ValueError):
        list(sst.Table(io.BytesIO(bytes(raw))))


def test_language_on_held_out(spark):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() >= 0.97


def test_audio_round_trip(docs, rows):
    got = {r.doc_id: r for r in mpeg_audio.audio_column(docs).collect()}
    for i, t in texts(rows):
        raw = t.encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.duration_s == pytest.approx(r.frames * 1152 / 48000)


def test_audio_resynchronises_and_verifies():
    payload = bytes(range(192)) * 12
    data = mpeg_audio.encode(payload, "note")
    whole = mpeg_audio.parse(data)
    at = int(whole.offsets()[3])
    assert mpeg_audio.payload_of(data, whole) == payload and whole.failures == 0
    torn = mpeg_audio.parse(data[:at] + b"garbage" * 9 + data[at:])
    assert torn.frames == whole.frames and torn.skipped == 63
    bent = bytearray(data)
    bent[at + 8] ^= 1
    assert mpeg_audio.parse(bytes(bent)).failures == 1


def test_audio_seek_offsets_and_feature_tell_contents(spark):
    texts_ = [(1, "a" * 5000), (2, "b" * 5000), (3, None)]
    got = {r.doc_id: r for r in mpeg_audio.audio_column(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    stored = {r.doc_id: bytes(r.media) for r in mpeg_audio.store(spark.createDataFrame(texts_, "doc_id long, text string")).collect()}
    assert got[1].feature != got[2].feature
    for i, media in stored.items():
        assert len(got[i].seek_offsets) == got[i].frames and got[i].samples == 1152 * got[i].frames and got[i].sample_rate == 48000
        assert all(media[at : at + 2] == b"\xff\xfa" for at in got[i].seek_offsets)


def bitwise_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if crc >> 15 ^ b else 0)) & 0xFFFF
    return crc


def bits_of(raw):
    return [b >> k & 1 for b in raw for k in range(7, -1, -1)]


#: (header after the sync byte, bytes a frame, bits covered, allocation bits to set): Layer I mono, stereo and joint stereo with bound 8;
#: Layer II mono at 44.1 kHz and 192 kbit/s (table of 30 subbands), with two subbands chosen; MPEG-2 Layer II stereo.
CHECKED_FRAMES = [
    (b"\xfe\x84\xc0", 256, 128, []), (b"\xfe\x84\x00", 256, 256, []), (b"\xfe\x84\x50", 256, 160, []),
    (b"\xfc\xa0\xc0", 626, 44 + 36 + 14 + 4, [3, 4]), (b"\xf4\x84\x00", 384, 2 * 75 + 2, [2]),
]


@pytest.mark.parametrize(("head", "size", "covered", "chosen"), CHECKED_FRAMES)
def test_audio_verifies_layers_one_and_two(head, size, covered, chosen):
    head = b"\xff" + head
    body = [0] * (8 * (size - 6))
    for at in chosen:
        body[at] = 1
    crc = bitwise_crc(bits_of(head[2:]) + body[:covered])
    frame = head + crc.to_bytes(2, "big") + bytes(int("".join(map(str, body[k : k + 8])), 2) for k in range(0, len(body), 8))
    found = mpeg_audio.parse(frame * 5)
    assert (found.frames, found.checks, found.failures, found.skipped) == (5, 5, 0, 0)
    bent = bytearray(frame * 5)
    bent[size + 6] ^= 0x80
    assert mpeg_audio.parse(bytes(bent)).failures == 1


def test_audio_reads_newer_tags_vbri_and_padding():
    # 44.1 kHz at 128 kbit/s: 417 bytes, with padding 418.
    plain_, padded_ = (b"\xff\xfb" + third + b"\xc0" + bytes(n - 4) for third, n in ((b"\x90", 417), (b"\x92", 418)))
    vbri = bytearray(plain_)
    vbri[36:62] = b"VBRI" + bytes(6) + (9999).to_bytes(4, "big") + (7).to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (3, 2, 2, 2))
    vbri[62:68] = b"".join(n.to_bytes(2, "big") for n in (10, 20, 30))
    title = b"\x03" + "Name é".encode() + bytes(200)
    frame = b"TIT2" + bytes([0, 0, len(title) >> 7, len(title) & 127]) + b"\x00\x00" + title
    tag = b"ID3\x04\x00\x00" + bytes([0, 0, len(frame) >> 7, len(frame) & 127]) + frame
    found = mpeg_audio.parse(tag + bytes(vbri) + plain_ + padded_ + padded_ + plain_)
    assert found.tags == {"TIT2": "Name é"} and found.frames == 4 and found.skipped == 0
    assert found.table["kind"] == "VBRI" and found.table["frames"] == 7 and found.table["toc"] == [20, 40, 60]
    start = len(tag) + 417
    assert found.offsets().tolist() == [start, start + 417, start + 835, start + 1253]
    assert found.duration == 4 * 1152 / __import__("fractions").Fraction(44100)


def test_schedule_reads_each_source_to_its_target(docs):
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    goals = {r.source: r.quota for r in mixing.targets(sized).collect()}
    blocks = mixing.mixed_blocks(docs)
    took = {r.source: r.n for r in blocks.groupBy("source").agg(F.sum(F.col("hi") - F.col("lo")).alias("n")).collect()}
    assert took == {s: q for s, q in goals.items() if q}
    plan = mixing.mixture(docs).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in plan)
    # Low discrepancy: each prefix of slots has each source close to its share.
    slots = [r.source for r in blocks.select("slot", "source").distinct().orderBy("slot").collect()]
    total = sum(goals.values())
    for n in range(50, len(slots), 50):
        for s, q in goals.items():
            assert abs(slots[:n].count(s) - n * q / total) < 6


def test_line_dedup_equals_brute_force(docs, rows):
    got = [(r.doc_id, r.text, r.lines_removed) for r in line_dedup.deduplicated(docs).collect()]
    assert plain.counted(got) == plain.counted(plain.lines_kept(rows, line_dedup.chunks))
    assert any(n for _, _, n in got)


def test_chunks_shift():
    text = [f"line {n}" for n in range(400)]
    before, after = (["\n".join(c) for c in line_dedup.chunks("\n".join(x))] for x in (text, ["new", *text[:200], "put in", *text[200:]]))
    assert "\n".join(before) == "\n".join(text)
    assert len(set(before) - set(after)) <= 4


def test_filters_merge_without_loss():
    rng = np.random.default_rng(2)
    parts = [np.unique(rng.integers(0, 5000, 3000).astype(np.uint64) << np.uint64(40)) for _ in range(3)]
    made = [exact_dedup.CountingQuotientFilter.unpacked(exact_dedup.CountingQuotientFilter(p, np.full(len(p), n + 1), 60).packed()) for n, p in enumerate(parts)]
    whole = exact_dedup.CountingQuotientFilter.merged(made)
    want = {}
    for n, p in enumerate(parts):
        for x in p.tolist():
            want[x] = want.get(x, 0) + n + 1
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist(), strict=True)) == want


def test_pieces_equal_brute_force(docs, rows):
    import public_tokenizers

    model, brute = queries.vocabulary(queries.PIECES), plain.Pieces(public_tokenizers.path(queries.PIECES))
    got = {r.doc_id: r.ids for r in sentencepiece_unigram.encoded(docs, model).collect()}
    short = [(i, t) for i, t in texts(rows) if len(t) < 3000]
    assert len(short) > 50
    for i, t in short:
        assert got[i] == brute.encode(t)
    unigram = sentencepiece_unigram.opened(model)
    odd = [t for _, t, *_ in ROWS if t and len(t) < 3000] + ["  two  ", "x" * 90, "漢" * 50, " ", "a\tb\n"]
    for t, packed in zip(odd, unigram.encode(odd), strict=True):
        ids = np.frombuffer(packed, unigram.kind)
        assert ids.tolist() == brute.encode(t) and unigram.decode(ids) == t


def test_texts_come_back(docs, rows):
    model = queries.vocabulary(queries.PIECES)
    back = sentencepiece_unigram.decoded(sentencepiece_unigram.encoded(docs, model), model)
    assert plain.counted((r.doc_id, r.text) for r in back.collect()) == plain.counted(texts(rows))


@pytest.mark.parametrize("hot", [300_000, 5])
def test_token_counts_equal_library(docs, rows, tokenizer, hot):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, queries.vocabulary(queries.BYTE_BPE), hot=hot).collect()}
    for i, t in texts(rows):
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 1024)


OPERATORS = {
    "toxicity": lambda d: toxicity.scored(d, toxicity.fit(d.withColumn("toxic", F.lit(0)))),
    "simhash": simhash.near_groups,
    "shards": lambda d: sst.token_shards(d, queries.vocabulary(queries.BYTE_BPE)),
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "audio": mpeg_audio.audio_column,
    "mixing": mixing.mixture,
    "lines": line_dedup.deduplicated,
    "exact": exact_dedup.exact_groups,
    "pieces": lambda d: sentencepiece_unigram.decoded(sentencepiece_unigram.encoded(d, queries.vocabulary(queries.PIECES)), queries.vocabulary(queries.PIECES)),
    "counts": lambda d: token_counts.token_counts(d, queries.vocabulary(queries.BYTE_BPE)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_table(edge, empty, name):
    out = OPERATORS[name](edge).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in ROWS)
    assert OPERATORS[name](empty).collect() == []


def test_odd_rows_have_defined_results(edge, tokenizer):
    groups = {r.doc_id: r for r in simhash.near_groups(edge).collect()}
    assert {groups[i].component_id for i in (3, 4, 5)} == {3} and {groups[i].component_id for i in (1, 2, 12)} == {1} and groups[4].fingerprint == "0" * 16
    same = {r.doc_id: r for r in exact_dedup.exact_groups(edge).collect()}
    assert (same[1].group_size, same[12].keep_id, same[2].group_size, same[4].keep_id, same[5].group_size) == (3, 1, 1, 3, 1)
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(edge, queries.vocabulary(queries.BYTE_BPE)).collect()}
    assert counts == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in ROWS}
    lines = line_dedup.deduplicated(edge).collect()
    kept = {r.doc_id: r for r in lines}
    assert kept[3].text is None and kept[3].lines_before == 0 and kept[7].lines_removed == 0 and kept[8].lines_removed > 0 and kept[8]["cut"] == CLASHING.index("cut")
    assert plain.counted((r.doc_id, r.text, r.lines_removed) for r in lines) == plain.counted(plain.lines_kept([r[:2] for r in ROWS], line_dedup.chunks))


@pytest.mark.parametrize("n", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, edge, empty, n):
    for table in (edge, empty):
        out = corpus_pipeline.STAGES[n][1](spark, table, SF)
        assert out.collect() == [] or table is edge
        if n + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == table.columns


def test_pipeline_equals_plain_version(spark, docs):
    """The stages one after another without Spark, from the same learned language model; the mix from its SQL."""
    import public_tokenizers
    from bazaarium.llm.tables import held_out

    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    known = [language_id.predicted(model, [t or ""]) for _, t, _ in rows]
    rows = [r for r, (k, p) in zip(rows, known, strict=True) if k[0] != "und" and p[0] >= corpus_pipeline.LEAST_PROBABILITY]
    words = lambda t: len(plain.WORD.findall(t or ""))
    less = plain.passages_kept([r[:2] for r in rows], line_dedup.chunks)
    rows = [(i, t, s) for (i, t, gone), (_, _, s) in zip(less, rows, strict=True) if not gone or words(t)]
    staying = {i for i, _ in kept([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in staying]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    taken = {r[0]: r for r in con.sql(f"SELECT doc_id, size, taken FROM ({queries.OP6_SQL})").fetchall()}
    times = {i: int(k / n + 0.5) for i, n, k in taken.values() if n}
    brute = plain.Pieces(public_tokenizers.path(queries.PIECES))
    want = []
    for i, t, _ in rows:
        if times.get(i):
            ids = brute.encode(t)
            want += [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest())] * times[i]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_pieces", "ids_crc32", "decoded_sha256").collect()
    assert plain.counted(got) == plain.counted(want) and want
