"""What the operators and stages must not leave undone."""

import random

import numpy as np

import corpus_pipeline
from weirflow.llm import flac_media, line_dedup, source_mix

# -- lines ----------------------------------------------------------------------


def test_unique_lines_of_rows_without_doc_id_stay(spark):
    texts = [(None, "a\nb"), (None, "c\nd"), (1, "e\nf"), (1, "g\nh"), (0, "e\nf")]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got) == ["", "a\nb", "c\nd", "e\nf", "g\nh"]


# -- near-duplicates of the pipeline --------------------------------------------


def changed(words, n, rng):
    """words with n of them, ten or more apart, replaced: each change costs five shingles."""
    out = list(words)
    for k in rng.sample(range(len(words) // 10), n):
        out[10 * k + 5] = f"new{rng.random()}"
    return out


def test_near_copies_go(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(words), "en", "s", 0))
        rows.append((100 + i, " ".join(changed(words, 1 + i % 6, rng)), "en", "s", 0))  # Jaccard 0.97 to 0.82
        rows.append((200 + i, " ".join(changed(words, 12, rng)), "en", "s", 0))  # 0.66
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {*range(40), *range(200, 240)}


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(changed(words, 2, rng)), "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [0]


def test_rows_are_judged_by_their_own_text(spark):
    """Null and repeated doc_ids: unrelated texts stay, copies go."""
    texts = [" ".join(f"{k}-{i}" for i in range(60)) for k in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[2] + " more"), (2, texts[3]), (None, texts[3]), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    third = [t for i, t in got if i is None]
    assert len(third) == 1 and third[0] in (texts[2], texts[2] + " more")
    assert sorted((x for x in got if x[0] is not None), key=str) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[3]), (3, None)], key=str)


# -- the mix --------------------------------------------------------------------


def test_a_very_long_document_leaves_no_gap(spark, monkeypatch):
    """Where the target ends in a very long document, the words left over are filled from the blocks after it."""
    monkeypatch.setattr(source_mix, "BLOCK_DOCS", 100)
    monkeypatch.setattr(source_mix, "TRIED", 150)
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(5, 40), "s", "en", 0) for i in range(3000)]
    rows += [(3000 + i, "w " * 20000, "s", "en", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    for seed in range(4):
        got = source_mix.mix(docs, 16, seed).draws.collect()
        left_out = [r["size"] for r in got if len(r["shards"]) == 1]
        short = got[0]["target"] - sum(r["size"] * len(r["shards"]) for r in got)
        assert 0 <= short < 5 <= min(left_out), (seed, short)
        assert all(0 <= s < 16 for r in got for s in r["shards"])


# -- media ----------------------------------------------------------------------


def test_blocks_of_16_bit_samples(spark):
    """A raw frame of 16 bits a sample comes out at that width."""
    x = np.arange(576) * 100 - 30000
    head = bytearray(flac_media.frame_header(0)[:-1])
    head[3] = 0x08
    frame = bytes(head) + bytes([int(flac_media.crc(np.frombuffer(bytes(head), np.uint8)[:, None], flac_media.CRC8)[0])]) + b"\x02" + x.astype(">i2").tobytes()
    frame += int(flac_media.crc(np.frombuffer(frame, np.uint8)[:, None], flac_media.CRC16)[0]).to_bytes(2, "big")
    media = bytearray(flac_media.stream([frame], 576, bytes(16)))
    packed = int.from_bytes(media[18:26], "big")
    media[18:26] = (packed & ~(31 << 36) | 15 << 36).to_bytes(8, "big")
    rows = flac_media.pcm_blocks(spark.createDataFrame([(1, bytes(media))], "doc_id long, media binary")).collect()
    assert [(r["doc_id"], r["sample_offset"], r["n_samples"], bytes(r["pcm"])) for r in rows] == [(1, 0, 576, x.astype("<i2").tobytes())]
