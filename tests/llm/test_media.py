import struct
import zlib

import numpy as np

from skeinbase.llm import images, media


def picture(seed, side=14):
    return images.mosaic(np.random.RandomState(seed).normal(size=side * side), side, 8)


def png(grey, filter_=0):
    rows = b"".join(bytes([filter_]) + (row if filter_ == 0 else np.diff(row, prepend=np.uint8(0)).astype(np.uint8)).tobytes() for row in grey.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_come_back():
    grey = np.rint(picture(1))
    for data in (images.pgm(grey), png(grey), png(grey, 1)):
        assert np.array_equal(images.decode(data), grey)
    for bad in (None, b"", b"not an image", images.pgm(grey)[:50], png(grey)[:80]):
        assert images.decode(bad) is None


def test_crops_and_edits_are_copies_and_others_are_not(spark):
    rng = np.random.RandomState(0)
    big = picture(1)
    rows = [(10, images.pgm(big)), (11, images.pgm(big[10:100, 6:104])), (12, images.pgm(big * 0.8 + 20)), (13, images.pgm(np.clip(big + rng.normal(0, 4, big.shape), 0, 255))), (14, images.pgm(np.rot90(big))), (15, png(np.rint(big)))]
    rows += [(20 + i, images.pgm(picture(50 + i))) for i in range(8)]
    rows += [(40, rows[6][1]), (41, None), (42, None), (43, b"broken"), (None, rows[7][1]), (44, images.pgm(np.zeros((64, 64)))), (45, images.pgm(np.zeros((4, 4))))]
    frame = spark.createDataFrame([(i, d, "x") for i, d in rows], "id long, image binary, content string").repartition(3)
    found = {r.id: r.copy_class for r in media.copies(frame).collect()}
    assert {i: found[i] for i in range(10, 16)} == dict.fromkeys(range(10, 16), 10)
    assert {i: found[i] for i in range(20, 28)} == {i: i for i in range(20, 28)}
    assert found[40] == 20 and found[41] == found[42] == 41 and found[43] == 43 and found[None] == 21 and found[44] == 44
    assert media.copies(frame.limit(0)).collect() == []


def test_agreement_counts_only_matches_of_one_move():
    rng = np.random.RandomState(3)
    left = rng.uniform(0, 100, (12, 2))
    right = left @ np.array([[0.0, 1.0], [-1.0, 0.0]]) * 0.5 + 30
    assert media.agreeing(left, right) == 12
    right[5:] = rng.uniform(0, 100, (7, 2))
    assert 5 <= media.agreeing(left, right) <= 7


def edited(big, kind, rng):
    """A copy of a picture: cut, lit, noisy, turned, or written at half its size."""
    return {
        "cut": lambda: big[rng.randint(4, 16) : -rng.randint(4, 16), rng.randint(4, 16) : -rng.randint(4, 16)], "lit": lambda: big * 0.8 + rng.randint(5, 40),
        "noisy": lambda: np.clip(big + rng.normal(0, 3, big.shape), 0, 255), "turned": lambda: np.rot90(big, rng.randint(1, 4)), "blurred": lambda: (big + np.roll(big, 1, 0) + np.roll(big, 1, 1) + big) / 4,
    }[kind]()


def linked_by_brute_force(a, b):
    """Whether two pictures' matches within HAMMING, of all pairs of descriptors, agree."""
    (pa_, da), (pb, db) = a, b
    if not len(da) or not len(db):
        return False
    apart = np.bitwise_count(da[:, None] ^ db[None]).sum(2)
    i, j = np.nonzero(apart <= media.HAMMING)
    return len(i) >= media.AGREE and media.agreeing(pa_[i], pb[j]) >= media.AGREE


def test_recall_of_edited_copies_against_brute_force(spark):
    rng = np.random.RandomState(11)
    rows, kinds = [], []
    for i in range(12):
        big = picture(200 + i)
        rows.append((100 * i, big))
        for k, kind in enumerate(("cut", "lit", "noisy", "turned", "blurred")):
            rows.append((100 * i + 1 + k, edited(big, kind, rng)))
            kinds.append((100 * i, 100 * i + 1 + k, kind))
    decoded = {i: images.decode(images.pgm(x)) for i, x in rows}
    described = {i: media.describe(x) for i, x in decoded.items()}
    frame = spark.createDataFrame([(i, images.pgm(x)) for i, x in rows], "id long, image binary").repartition(3)
    found = {r.id: r.copy_class for r in media.copies(frame).collect()}
    assert all(found[i] // 100 == i // 100 for i in found)  # no picture is taken for a copy of another
    true = [(a, b) for a, b, _ in kinds if linked_by_brute_force(described[a], described[b])]
    caught = sum(found[a] == found[b] for a, b in true)
    assert len(true) >= 0.9 * len(kinds) and caught >= 0.9 * len(true), (len(kinds), len(true), caught)


def test_every_link_that_meets_the_threshold_is_counted(spark, monkeypatch):
    rng = np.random.RandomState(5)
    rows = []
    for i in range(5):
        big = picture(200 + i)
        rows += [(10 * i + k, x) for k, x in enumerate((big, *(edited(big, kind, rng) for kind in ("cut", "lit", "noisy", "turned", "blurred"))))]
    described = {i: media.describe(images.decode(images.pgm(x))) for i, x in rows}
    ids = sorted(described)
    true = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked_by_brute_force(described[a], described[b])]
    frame = spark.createDataFrame([(i, images.pgm(x)) for i, x in rows], "id long, image binary").repartition(3)
    monkeypatch.setattr(media, "BLOCK", 300)
    monkeypatch.setattr(media, "STRIP", 70)
    assert sorted(map(tuple, media.links(media.descriptors(frame)).select("a", "b").collect())) == true
    found = {r.id: r for r in media.copies(frame).collect()}
    assert {i: r.n_links for i, r in found.items()} == {i: sum(i in pair for pair in true) for i in ids} and len(true) > 50
    assert all(r.copy_class // 10 == i // 10 for i, r in found.items())


def test_products_of_three_distances_are_exact():
    rng = np.random.RandomState(8)
    left, right = (rng.randint(0, 2**63, (n, 2), np.uint64) * np.uint64(2) + rng.randint(0, 2, (n, 2)).astype(np.uint64) for n in (300, 500))
    right[:40] = left[:40]
    for k in range(40):  # k bits apart
        for bit in rng.permutation(media.BITS)[:k]:
            right[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    left[50], right[50], right[51] = 0, 2**64 - 1, 0
    left[51] = 2**64 - 1
    u, v = media.near_pairs(left.view(np.int64), media.packed(right.view(np.int64)))  # as they come from Spark
    assert set(zip(u, v)) == set(zip(*np.nonzero(np.bitwise_count(left[:, None] ^ right[None]).sum(2) <= media.HAMMING))) and len(u) == len(set(zip(u, v)))
    assert {(k, k) for k in range(media.HAMMING + 1)} <= set(zip(u, v)) and (30, 30) not in set(zip(u, v))


def test_only_pairs_with_enough_places_are_fitted(monkeypatch):
    """Two places of one picture lie near eight of another: eight matches agree, but not six places, so that no similarity is sought."""
    code = np.array([0] * 2 + [1] * 8)
    about = np.array([[0, 0], [0, 1], [1, 0], [1, 1]])
    at, bits = np.concatenate([[[10, 10], [50, 50]], about + 10, about + 50]).astype(float), np.full((10, 2), 12345, np.uint64)
    monkeypatch.setattr(media, "fitted", lambda *a: (_ for _ in ()).throw(AssertionError("fitted")))
    rows = np.arange(10)
    assert list(media.linked(code, at, bits, rows, rows)) == []


def test_pictures_of_many_places_are_linked():
    """More than 64 places, whose bits are no longer told apart."""
    r = np.random.RandomState(4)
    n = 80
    place = np.stack(np.divmod(np.arange(n), 9), 1) * 11.0
    bits = r.randint(0, 2**63, (n, 2), np.uint64)
    code, at = np.repeat([0, 1], [n, 7]), np.concatenate([place, place[[1, 65, 12, 70, 33, 79, 40]] + 5])
    rows = np.arange(n + 7)
    found = list(media.linked(code, at, np.concatenate([bits, bits[[1, 65, 12, 70, 33, 79, 40]]]), rows, rows))
    assert [f[:2] for f in found] == [(0, 1)] and abs(found[0][3] - (5 + 5j)) < 1e-6
