"""Encoding, fingerprints, packing and sharding against plain versions."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import bpe, lzprint, media, packing, sharding


def plain(path):
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


MULTI, TOK, RANKS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_bpe_is_tiktoken(odd, docs, empty):
    encoding = plain(MULTI)
    for table in (odd, docs.select("doc_id", "text")):
        wanted = Counter()
        for r in table.collect():
            ids = np.array(encoding.encode_ordinary(r["text"] or ""), "<u4")
            wanted[r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.round_trip(table, MULTI, P.PATTERN).collect())) == wanted
    assert bpe.round_trip(empty, MULTI, P.PATTERN).count() == 0


def test_bpe_of_long_pieces():
    encoding, vocab, rng = plain(MULTI), bpe.Vocabulary(MULTI, P.PATTERN), np.random.default_rng(3)
    letters = "".join(rng.choice(list("etaoinshrdlu"), 60_000).tolist())
    for text in (letters, letters[:257], letters[:258] * 3, "ab" * 5000, "a" * 3001, "the" * 2000 + "!", "日本語" * 900, " " * 4000, "=" * 1500):
        ids, counts = vocab.encode([text])
        assert ids.tolist() == encoding.encode_ordinary(text) and counts.tolist() == [len(ids)]


def test_bpe_decode_gives_back(odd):
    encoded = bpe.encode(odd, MULTI, P.PATTERN)
    got = Counter((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(encoded, MULTI, P.PATTERN).collect())
    assert got == Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect())


def parse(text):
    seen, ends, begin = set(), [], 0
    while begin < len(text):
        end = begin + 1
        while end < len(text) and text[begin:end] in seen:
            end += 1
        seen.add(text[begin:end])
        ends.append(end)
        begin = end
    return ends


def plain_print(text):
    """The least hashes of the phrases, one by one, and how they are written."""
    begin, found = 0, set()
    for end in parse(text):
        sums, power = 0, 1
        for c in text[begin:end]:
            code = int(lzprint._mix(np.array([ord(c) + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])
            sums, power = (sums + code * power) & 0xFFFFFFFFFFFFFFFF, power * lzprint.BASE & 0xFFFFFFFFFFFFFFFF
        found.add(int(lzprint._mix(np.array([sums], np.uint64))[0]) >> 32)
        begin = end
    least = sorted(found)[: lzprint.SIZE]
    return least, "".join(f"{h:08x}" for h in least)


def plain_likeness(a, b):
    union = sorted({*a, *b})[: lzprint.SIZE]
    return len([h for h in union if h in a and h in b]) / len(union) if a and b else float(not a and not b)


def test_phrases(odd):
    for text in [r["text"] or "" for r in odd.collect()]:
        assert lzprint.phrases(text, set(), 0, len(text))[0] == parse(text)
        for tail in ("", "zz", text[: len(text) // 3]):
            keep = len(text) - len(text) // 3
            own, edited = lzprint.fingerprint_edited(text, tail)
            assert (own == lzprint.fingerprint(text)).all() and (edited == lzprint.fingerprint(text[:keep] + tail)).all()


def test_likeness_of_small_sets():
    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4, 5], np.uint32)
    assert lzprint.likeness(a, b) == 2 / 5 and lzprint.likeness(a, a) == 1
    assert lzprint.likeness(a[:0], a[:0]) == 1 and lzprint.likeness(a[:0], a) == 0


def test_neighbours(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(lzprint, "RANGE", 1 << 17)  # several ranges
    found = {r["doc_id"]: r for r in lzprint.edited_fingerprints(docs).collect()}
    rows = sorted(docs.collect(), key=lambda r: -r["doc_id"])
    for r, after in [*zip(rows, rows[1:] + rows[:1], strict=True)][-40:]:
        n = len(r["text"])
        edited = r["text"][: n - n // 3] + after["text"][: n // 3]
        got = found[r["doc_id"]]
        assert got["n_chars"] == n and got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (plain_print(t) for t in (r["text"], edited, after["text"]))
        assert got["fingerprint"] == own[1] and got["edited_fingerprint"] == other[1]
        assert got["near_next"] == plain_likeness(own[0], following[0]) and got["near_edited"] == plain_likeness(own[0], other[0])
    assert lzprint.edited_fingerprints(odd).count() == odd.count() and lzprint.edited_fingerprints(empty).count() == 0


def test_media_round_trip(odd, empty, docs):
    payload = bytes(range(256)) * 3
    file = media.avi(media.encode_frames(np.frombuffer(payload, np.uint8)))
    assert media.decode_frames(file, *media.read_avi(file)[1:]).tobytes() == payload
    for r in media.stored_and_read(odd).collect():
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= max(192, r["n_bytes"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stored = media.store(docs)
    films = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    clips = {}
    for r in media.clips(stored).collect():
        clips.setdefault(r["doc_id"], []).append((r["clip"], r["start_s"], r["end_s"]))
    for r in media.stored_and_read(docs).collect():
        raw = media.payload_of(texts[r["doc_id"]].encode())
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-16:])
        assert r["media_sha256"] == hashlib.sha256(films[r["doc_id"]]).hexdigest() and r["media_bytes"] == len(films[r["doc_id"]])
        assert [tuple(c) for c in r["clips"]] == sorted(clips[r["doc_id"]])
    assert len(clips) == len(texts) and media.stored_and_read(empty).count() == 0


def test_frames_are_decoded_to_pixels():
    """Pixels by the frame's own tables and quantiser, and by the plain formula of the inverse transform."""
    payload = np.random.default_rng(3).integers(0, 256, 3 * 192).astype(np.uint8)
    film = media.avi(media.encode_frames(payload))
    pixels = np.concatenate(list(media.images(film, *media.read_avi(film)[1:])))
    assert pixels.shape == (3, 96, 128) and (pixels.reshape(3, 12, 8, 16, 8) == payload.reshape(3, 12, 1, 16, 1)).all()
    frames = media.encode_frames(64 + payload // 2)
    frames[:, 7:71] = 16
    film = media.avi(frames)
    assert (media.decode_frames(film, *media.read_avi(film)[1:]).ravel() == payload // 2 * 2).all()
    block = np.random.default_rng(4).integers(-60, 60, (8, 8))
    scale = [2**-0.5, *[1] * 7]
    plain = [[sum(scale[u] * scale[v] * block[u, v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 + 128 for x in range(8)] for y in range(8)]
    assert (media.inverse_transform(block[None]) == np.clip(np.floor(np.array(plain) + 0.5), 0, 255)).all()
    with pytest.raises(ValueError, match="differ"):
        media.samples_of(np.arange(96 * 128, dtype=np.uint8).reshape(1, 96, 128))


def test_media_rejects_others():
    for data in (b"", b"RIFF0000WAVE", media.avi(media.encode_frames(np.zeros(192, np.uint8)))[:-60]):
        with pytest.raises((ValueError, IndexError, KeyError)):
            media.decode_frames(data, *media.read_avi(data)[1:])


def test_other_jpeg_frames():
    payload = np.arange(192, dtype=np.uint8)
    assert (media.block_means(media.encode_frames(payload)[0].tobytes()).ravel() == payload).all()
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0, 8] + [1] * 63)) + media._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head += media._segment(0xC4, bytes([0x00, 1] + [0] * 15 + [3])) + media._segment(0xC4, bytes([0x10, 1, 1] + [0] * 14 + [0, 1])) + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    assert media.block_means(head + b"\x5a\x5a\xff\xd9").tolist() == [[133, 138]]  # DC 5, one AC, end; twice
    film = media.avi(np.stack([np.frombuffer(head + b"\x5a\x5a\xff\xd9", np.uint8)] * 3))
    assert media.decode_any(film, *media.read_avi(film)[1:]).tolist() == [[133, 138]] * 3
    with pytest.raises(ValueError):
        media.block_means(head[:-10].replace(b"\xff\xc0", b"\xff\xc2") + head[-10:])


def test_shots():
    dark, light = np.zeros((10, 192), np.uint8), np.full((7, 192), 200, np.uint8)
    assert media.cuts(np.concatenate([dark, light, dark]), np.array([0])).tolist() == [0, 10, 17]
    assert media.cuts(np.concatenate([dark, light]), np.array([0, 10])).tolist() == [0, 10]


def test_differencing():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 2048, 60)
        found = packing.pack_run(sizes, 2048)
        assert np.bincount(found, weights=sizes).max() <= 2048
    assert packing.differencing([8, 7, 6, 5, 4], 2).tolist().count(0) in (2, 3)


def test_packing(odd, docs, empty):
    encoding = plain(RANKS)
    for table in (odd, docs):
        got = packing.pack(table, TOK, RANKS, P.PATTERN).toPandas()
        sequence = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
        assert sequence.length.sum().max() <= 2048
        assert (sequence.length.cumsum() - sequence.length.transform(lambda x: x) >= 0).all()
        assert (got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length.transform(lambda x: x.cumsum() - x) == got.sort_values(["sequence_id", "offset"]).offset).all()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, pieces in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*encoding.encode_ordinary(texts[doc_id]), 1], "<u4")
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack(empty, TOK, RANKS, P.PATTERN).count() == 0


def test_ids_are_the_tokenizers(docs, odd):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(TOK)
    for text in [r["text"] or "" for table in (docs.limit(60), odd) for r in table.collect()]:
        assert packing.token_ids(text, TOK, RANKS, P.PATTERN).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_special_strings_go_through_the_tokenizer():
    assert 50256 in packing.token_ids("a <|endoftext|> b", TOK, RANKS, P.PATTERN)


def test_sharding(odd, docs, empty):
    for table in (odd, docs):
        got, rows = sharding.shard_by_bytes(table, 4).toPandas(), table.collect()
        assert len(got) == len(rows)
        assert Counter(got["size"]) == Counter(len((r["text"] or "").encode()) + 1 for r in rows)
        assert (got.groupby("shard").slot.max() + 1 == got.groupby("shard").slot.nunique()).all()
    loads, longest = got.groupby("shard")["size"].sum(), got["size"].max()
    assert loads.max() - loads.min() <= 2 * longest
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def test_sharding_by_a_plain_version(spark):
    """Checksums, sizes, slots without gaps, and equal texts together unless their run is long."""
    rng = np.random.default_rng(2)
    texts = [("copy %d " % (k % 40)) * 9 if k % 3 else None if k % 51 == 0 else "own %d " % k * int(rng.integers(1, 60)) for k in range(3000)]
    rows = spark.createDataFrame([(None if k % 7 == 0 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = sharding.shard_by_bytes(rows, 8).toPandas()
    assert Counter(zip(got["size"], got["text_crc32"], strict=True)) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert all(sorted(part) == list(range(len(part))) for _, part in got.groupby("shard").slot)
    loads = got.groupby("shard")["size"].sum()
    mean, crossing = loads.sum() / 8, (got.groupby("text_crc32").shard.nunique() > 1).sum()
    assert loads.max() - loads.min() <= 2 * (mean / 512 + got["size"].max()) and crossing <= 7


def test_many_equal_rows_without_ids(spark):
    rows = spark.range(4000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one and the same text' AS text").repartition(4)
    got = sharding.shard_by_bytes(rows, 4).toPandas()
    assert (abs(got.groupby("shard").size() - 1000) <= 2).all() and all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard").slot)
    pieces = packing.pack(rows, TOK, RANKS, P.PATTERN).toPandas()
    assert len(pieces) == 4000 and pieces.groupby("sequence_id").length.sum().max() <= 2048
